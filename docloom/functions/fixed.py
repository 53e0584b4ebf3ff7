"""Texts, word lists and sizes that results depend on."""

# Markers of machine-generated title requests.
TITLE_MARKERS = [
    "### task:",
    "generate a concise",
    "word title with an emoji",
    "summarizing the chat history",
    "### guidelines:",
    "### output:",
    "json format:",
    '"title":',
    "### chat history:",
    "<chat_history>",
]

# Markers of machine-generated tags requests.
TAGS_MARKERS = [
    "### task:",
    "generate 1-3 broad tags",
    "categorizing the main themes",
    "### guidelines:",
    "high-level domains",
    "### output:",
    "json format:",
    '"tags":',
    "### chat history:",
    "<chat_history>",
]

# Markers of any machine-generated request.
GENERAL_MARKERS = [
    "### task:",
    "### guidelines:",
    "### output:",
    "json format:",
    "### chat history:",
    "<chat_history>",
    "generate a",
    "summarizing the chat",
]

# Thresholds of the verdict.
TYPED_THRESHOLD = 0.6
GENERAL_THRESHOLD = 0.5

# Keywords of a suspicious last user message.
SUSPICIOUS_KEYWORDS = [
    "tag",
    "generierung",
    "erstelle tags",
    "klassifizierung",
    "kategorisierung",
    "prompt",
    "system",
    "instruction",
]

# Keywords of the flag set on every incoming message.
FLAG_KEYWORDS = ["tag", "generierung", "erstelle"]

# Request defaults.
DEFAULT_MODEL = "llama3.2:1b"
DEFAULT_TEMPERATURE = 0.7
DEFAULT_MAX_TOKENS = 1000

# Answers to meta requests when the generator fails.
META_FALLBACK_TITLE = '{ "title": "📋 Geschäftliche Anfrage" }'
META_FALLBACK_TAGS = '{ "tags": ["Business", "General"] }'
META_FALLBACK_OTHER = "Entschuldigung, ich kann diese Meta-Anfrage derzeit nicht verarbeiten."

# Error texts.
ERROR_NO_USER = "400: Keine Benutzeranfrage gefunden"
ERROR_TOO_SHORT = "400: Benutzeranfrage zu kurz oder leer"
ERROR_ENGINE = "500: Chat-Engine Fehler: "

# Defaults for missing metadata.
UNKNOWN_DOCUMENT = "Unbekanntes Dokument"
UNKNOWN_FILE = "Unbekannt"
UNKNOWN_TYPE = "unbekannt"
NO_PAGE = "N/A"

# Heading of the appended source block.
SOURCES_HEADING = "\n\n**Referenzierte Quellen:**\n"

# Prompt parts.
SYSTEM_PROMPT = (
    "Du bist ein KI-Assistent für Mitarbeiter eines deutschen Planungsbüros im Baugewerbe. "
    "Deine Aufgabe ist es, Fragen präzise zu beantworten, indem du Informationen aus den "
    "bereitgestellten Dokumenten nutzt. Fasse die relevanten Fakten strukturiert zusammen. "
    "Nenne am Ende deiner Antwort immer das Quelldokument und die Seitenzahl. "
    "Antworte professionell und auf Deutsch."
)
CONTEXT_HEADING = "\n\nKontext aus Dokumenten:"
QUESTION_HEADING = "\n\nFrage: "
ANSWER_CUE = "\n\nAntwort:"
PROMPT_LIMIT = 2000
PROMPT_KEEP = 1500

# Chunk sizes of the three levels, and the overlap.
CHUNK_SIZES = (1024, 512, 256)
CHUNK_OVERLAP = 75

# Retrieval depth and embedding batch size.
TOP_K = 4
EMBED_BATCH = 128

# Metadata keys that are kept.
METADATA_KEYS = ["file_path", "file_directory", "filename", "page_number"]

# Creation time and timing fields of the adapter's records.
OLLAMA_CREATED_AT = "2024-06-07T16:00:00Z"
OLLAMA_TIMINGS = {
    "total_duration": 1000000000,
    "load_duration": 100000000,
    "prompt_eval_duration": 200000000,
    "eval_duration": 700000000,
    "eval_count": 50,
}

# Note on the meta route in audit records.
META_METHOD = "LLM-Only (RAG bypassed)"
