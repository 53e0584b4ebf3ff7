"""SQL that restates each registered query on the given tables (DuckDB dialect)."""

from __future__ import annotations

from ..functions import fixed
from ..functions.text import WHITE_SPACE
from .inputs import META_FAMILIES, META_MARKERS

# The index parameters of the queries: cells, and cells searched per query.
CELLS, PROBES_PER_QUERY = 16, 14


def lit(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def strip(x: str) -> str:
    return f"regexp_replace(regexp_replace({x}, '^{WHITE_SPACE}+', ''), '{WHITE_SPACE}+$', '')"


def any_of(x: str, words: list[str]) -> str:
    return "(" + " OR ".join(f"contains(lower({x}), {lit(w)})" for w in words) + ")"


def share(x: str, words: list[str]) -> str:
    hits = " + ".join(f"contains(lower({x}), {lit(w)})::INT" for w in words)
    return f"(({hits})::DOUBLE / {float(len(words))})"


def meta_text(text: str) -> str:
    parts = []
    for j, marker in enumerate(META_MARKERS):
        families = ", ".join(str(f) for f, members in META_FAMILIES.items() if j in members)
        parts.append(
            f"CASE WHEN conv_id % 4 IN ({families}) AND (conv_id // 4 + turn + {j}) % 5 <> 0 "
            f"THEN {lit(marker)} END"
        )
    return f"concat_ws(' ', {', '.join(parts)}, {text})"


def with_(*ctes: str) -> str:
    return "WITH RECURSIVE " + ",\n".join(ctes) + "\n" if ctes else ""


def preview(x: str, n: int) -> str:
    return f"CASE WHEN length({x}) > {n} THEN substr({x}, 1, {n}) || '...' ELSE {x} END"


# --- derived inputs --------------------------------------------------------------

META_PROMPTS = f"""meta_prompts AS (
  SELECT conv_id, turn, {meta_text('text')} AS content FROM conversations WHERE role = 'user')"""

META_SCORES = f"""meta_scores AS (
  SELECT conv_id, turn, {share('content', fixed.TITLE_MARKERS)} AS title_score,
    {share('content', fixed.TAGS_MARKERS)} AS tags_score,
    {share('content', fixed.GENERAL_MARKERS)} AS general_score
  FROM meta_prompts)"""


def verdict(alias: str = "") -> str:
    t, g, e = f"{alias}title_score", f"{alias}tags_score", f"{alias}general_score"
    return f"""{t} >= 0.6 OR {g} >= 0.6 OR {e} >= 0.5 AS is_meta,
    CASE WHEN {t} >= 0.6 THEN 'title' WHEN {g} >= 0.6 THEN 'tags' WHEN {e} >= 0.5 THEN 'unknown' END AS meta_type,
    CASE WHEN {t} >= 0.6 THEN {t} WHEN {g} >= 0.6 THEN {g} WHEN {e} >= 0.5 THEN {e} ELSE 0.0::DOUBLE END
      AS confidence"""


CHAT_LOG = f"""chat_log AS (
  SELECT conv_id, turn, role = 'user' AS asks,
    CASE WHEN role = 'user' AND conv_id % 17 = 4 THEN 'tool' WHEN conv_id % 3 = 0 THEN upper(role) ELSE role END
      AS role,
    CASE WHEN role = 'user' AND (conv_id + turn) % 5 = 0 THEN {meta_text('text')}
      WHEN role = 'user' AND (conv_id + turn) % 5 = 1 THEN text || ' Etage'
      WHEN role = 'user' AND (conv_id * 3 + turn) % 23 = 2 THEN 'ok'
      WHEN role = 'user' AND (conv_id * 3 + turn) % 23 = 3 THEN chr(9) || ' ' || chr(10)
      ELSE text END AS content
  FROM conversations)"""

# Requests by windows: a question with what came after the last but one, or the turns after the last question.
MESSAGES = """numbered AS (
  SELECT *, sum(asks::INT) OVER (PARTITION BY conv_id ORDER BY turn) AS q,
    sum(asks::INT) OVER (PARTITION BY conv_id) AS n FROM chat_log),
sendings AS (
  SELECT conv_id, q::BIGINT AS req_no, turn, false AS closing FROM numbered WHERE asks
  UNION ALL SELECT DISTINCT conv_id, (n + 1)::BIGINT, NULL, true FROM numbered WHERE NOT asks AND q = n),
messages AS (
  SELECT s.conv_id, s.req_no, s.conv_id || '-' || s.req_no AS request_id, m.role, m.content,
    row_number() OVER (PARTITION BY s.conv_id, s.req_no ORDER BY m.turn) - 1 AS pos
  FROM sendings s JOIN numbered m ON m.conv_id = s.conv_id AND CASE
    WHEN s.closing THEN NOT m.asks AND m.q = m.n
    WHEN m.asks THEN m.q IN (s.req_no - 1, s.req_no)
    ELSE m.q IN (s.req_no - 2, s.req_no - 1) END)"""

REQUESTS = """asked AS (
  SELECT s.conv_id, s.req_no, s.conv_id || '-' || s.req_no AS request_id,
    CASE WHEN s.conv_id % 10 = 9 THEN NULL WHEN s.conv_id % 10 = 8 THEN '' ELSE s.conv_id::VARCHAR END
      AS asked_chat_id,
    CASE WHEN s.conv_id % 4 <> 1 THEN 'modell-a' END AS asked_model,
    CASE WHEN s.conv_id % 4 <> 1 THEN 0.2::DOUBLE END AS asked_temperature,
    CASE WHEN s.conv_id % 4 <> 1 THEN 256 END AS asked_max_tokens,
    a.content AS answer
  FROM sendings s LEFT JOIN chat_log a
    ON a.conv_id = s.conv_id AND a.turn = s.turn + 1 AND lower(a.role) = 'assistant'),
requests AS (
  SELECT *, coalesce(nullif(asked_chat_id, ''), sha256(request_id)) AS chat_id,
    coalesce(asked_chat_id, '') = '' AS new_session, coalesce(asked_model, 'llama3.2:1b') AS model
  FROM asked)"""

RESOLVED = f"""users AS (
  SELECT request_id, content, pos, row_number() OVER (PARTITION BY request_id ORDER BY pos) AS idx,
    length(content) > 10 AND NOT {any_of('content', fixed.SUSPICIOUS_KEYWORDS)} AS usable
  FROM messages WHERE lower(role) = 'user'),
asking AS (
  SELECT r.*, u.n_user_messages, u.last_user, u.usable_content, u.usable_idx
  FROM requests r LEFT JOIN (
    SELECT request_id, count(*) AS n_user_messages, arg_max(content, pos) AS last_user,
      arg_max(content, pos) FILTER (usable) AS usable_content, max(idx) FILTER (usable) AS usable_idx
    FROM users GROUP BY request_id) u USING (request_id)),
scored AS (
  SELECT *, coalesce({share('last_user', fixed.TITLE_MARKERS)}, 0) AS title_score,
    coalesce({share('last_user', fixed.TAGS_MARKERS)}, 0) AS tags_score,
    coalesce({share('last_user', fixed.GENERAL_MARKERS)}, 0) AS general_score
  FROM asking),
judged AS (SELECT *, {verdict()} FROM scored),
doubted AS (
  SELECT *, NOT is_meta AND coalesce({any_of('last_user', fixed.SUSPICIOUS_KEYWORDS)}, false) AS suspicious
  FROM judged),
chosen AS (
  SELECT *, suspicious AND usable_content IS NOT NULL AS alternative_used,
    CASE WHEN suspicious THEN usable_idx END AS alternative_idx,
    CASE WHEN suspicious THEN coalesce(usable_content, last_user) ELSE last_user END AS question
  FROM doubted),
resolved AS (
  SELECT *, CASE WHEN detail IS NULL THEN 200 ELSE 500 END AS status_code,
    CASE WHEN detail IS NOT NULL THEN 'error' WHEN is_meta THEN 'meta' ELSE 'retrieval' END AS route
  FROM (SELECT *, CASE WHEN last_user IS NULL THEN {lit(fixed.ERROR_NO_USER)}
      WHEN NOT is_meta AND length({strip('question')}) < 3 THEN {lit(fixed.ERROR_TOO_SHORT)} END AS detail
    FROM chosen))"""

ENTRIES = """entries AS (
  SELECT r.chat_id, m.req_no, 0 AS step, m.pos,
    CASE WHEN lower(m.role) = 'user' THEN 'user' ELSE 'assistant' END AS role, m.content
  FROM messages m JOIN requests r USING (request_id))"""


def first_arrivals(source: str) -> str:
    return f"""SELECT * FROM {source}
  QUALIFY row_number() OVER (PARTITION BY chat_id, content ORDER BY req_no, step, pos) = 1"""


MERGED = f"merged AS ({first_arrivals('entries')})"

REQ = (CHAT_LOG, MESSAGES, REQUESTS)
RES = (*REQ, RESOLVED)
HIST = (*REQ, ENTRIES, MERGED)


def with_answers(answers: str) -> str:
    """History with the stored answers of ``answers`` (chat_id, req_no, answer)."""
    return f"""stored AS (
  SELECT chat_id, req_no, 1 AS step, 0 AS pos, 'assistant' AS role, answer AS content
  FROM {answers} WHERE answer IS NOT NULL),
events AS (SELECT * FROM entries UNION ALL SELECT * FROM stored),
history AS (
  SELECT * FROM ({first_arrivals('events')}) WHERE step = 0 UNION ALL SELECT * FROM stored)"""


PLAIN_ANSWERS = "plain_answers AS (SELECT chat_id, req_no, answer FROM resolved WHERE route = 'retrieval')"
HISTORY = (*RES, ENTRIES, PLAIN_ANSWERS, with_answers("plain_answers"))

ELEMENTS = """lines AS (
  SELECT doc_id, source, text, unnest(string_split(text, chr(10))) AS line,
    unnest(range(len(string_split(text, chr(10))))) AS elem_idx FROM documents),
elements AS (
  SELECT './PDFs/' || source || '/doc_' || doc_id || '.pdf' AS file_path, './PDFs/' || source AS file_directory,
    'doc_' || doc_id || '.pdf' AS filename, elem_idx,
    CASE WHEN elem_idx % 7 = 6 THEN NULL WHEN elem_idx = 0 THEN 'Title' ELSE 'NarrativeText' END AS type,
    line AS text,
    CASE WHEN (doc_id + elem_idx) % 11 <> 0 THEN 1 + elem_idx // 5 END AS page_number
  FROM lines)"""

LISTING = r"""listing AS (
  SELECT regexp_extract(url, '^https?://([^?#]*?)/?(?:[?#].*)?$', 1)
      || CASE WHEN page_id % 9 = 4 THEN '.PDF' ELSE '.pdf' END AS path,
    1700000000 + (page_id % 7) * 86400 AS modified, strlen(html) AS length
  FROM pages)"""

FILES = """files AS (
  SELECT './PDFs/' || source || '/doc_' || doc_id || '.pdf' AS file_path, strlen(text) AS length FROM documents)"""


def html_tags(tags: str) -> str:
    return rf"regexp_extract_all(html, '(?s)<(?:{tags})(?:\s[^>]*)?>.*?</(?:{tags})>')"


HTML = rf"""marked AS (
  SELECT page_id, unnest(m) AS m, unnest(range(len(m))) AS elem_idx
  FROM (SELECT page_id, {html_tags('h1|p|li')} AS m FROM pages)),
html_elements AS (
  SELECT page_id, elem_idx, CASE regexp_extract(m, '^<(\w+)', 1)
      WHEN 'h1' THEN 'Title' WHEN 'p' THEN 'NarrativeText' ELSE 'ListItem' END AS type,
    {strip("regexp_replace(m, '<[^>]+>', ' ', 'g')")} AS text
  FROM marked)"""

NODES = """nodes AS (
  SELECT 'n' || lpad(vec_id::VARCHAR, 6, '0') AS node_id, 'passage ' || vec_id || chr(10) || 'label ' || label AS text,
    CASE WHEN vec_id % 53 <> 0 THEN 'doc_' || (vec_id % 37) || '.pdf' END AS filename,
    CASE WHEN vec_id % 29 <> 0 THEN 1 + vec_id % 12 END AS page_number, embedding::DOUBLE[] AS embedding, vec_id
  FROM embeddings)"""

HITS = """distances AS (
  SELECT q.vec_id AS query_id, n.node_id, round(list_distance(q.embedding, n.embedding) ** 2, 6) AS distance
  FROM nodes q, nodes n),
hits AS (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY distance, node_id) AS rank FROM distances
  QUALIFY rank <= 4),
found AS (
  SELECT h.*, n.text, n.filename, n.page_number,
    '(Quelle: ' || coalesce(n.filename, 'Unbekanntes Dokument') || ', Seite: '
      || coalesce(n.page_number::VARCHAR, 'N/A') || ')' AS citation,
    coalesce(n.filename, 'Unbekannt') || ':' || coalesce(n.page_number::VARCHAR, 'N/A') AS source
  FROM hits h JOIN nodes n USING (node_id))"""

CITED = """cited AS (
  SELECT query_id, list_sort(list(DISTINCT citation)) AS citations, count(*) AS source_nodes_count,
    count(DISTINCT citation) AS unique_sources_count, string_agg(source, ', ' ORDER BY rank) AS sources
  FROM found GROUP BY query_id)"""

QUESTION_ANSWERS = """answers AS (
  SELECT *, 'Antwort ' || query_id || CASE WHEN query_id % 30 = 0 THEN ' ' || upper(citations[1]) ELSE '' END AS answer
  FROM cited),
judged AS (
  SELECT *, len(list_filter(citations, lambda c: contains(lower(answer), lower(c)))) > 0 AS already_cited
  FROM answers)"""

CONTEXT = """contexts AS (
  SELECT query_id, string_agg(chr(10) || chr(10) || 'Dokument ' || rank || ':' || chr(10) || text, '' ORDER BY rank)
    AS context FROM found GROUP BY query_id)"""


def tokenized(source: str = "documents", doc_id: str = "doc_id") -> str:
    return rf"""tokenized AS (
  SELECT {doc_id} AS doc_id, tokens, len(tokens) AS n FROM (
    SELECT {doc_id}, list_filter(regexp_split_to_array(text, '\s+'), lambda t: t <> '') AS tokens FROM {source}))"""


def starts(n: str, size: int) -> str:
    stride = size - fixed.CHUNK_OVERLAP
    return f"range(0, ceil(greatest({n} - {size}, 0) / {stride}.0)::BIGINT * {stride} + 1, {stride})"


def _chunks() -> str:
    a, b, c = fixed.CHUNK_SIZES
    o = fixed.CHUNK_OVERLAP
    key = "sha256(doc_id || '|' || level || '|' || {})"
    return f"""l0 AS (
  SELECT doc_id, 0 AS level, s // {a - o} AS i0, 0 AS i1, 0 AS i2, s AS tok_start, least(s + {a}, n) AS tok_end,
    (s // {a - o})::VARCHAR AS path, NULL::VARCHAR AS parent
  FROM (SELECT doc_id, n, unnest({starts('n', a)}) AS s FROM tokenized)),
l1 AS (
  SELECT doc_id, 1 AS level, i0, s // {b - o} AS i1, 0 AS i2, tok_start + s AS tok_start,
    least(tok_start + s + {b}, tok_end) AS tok_end, path || '.' || (s // {b - o}) AS path, path AS parent
  FROM (SELECT *, unnest({starts('(tok_end - tok_start)', b)}) AS s FROM l0)),
l2 AS (
  SELECT doc_id, 2 AS level, i0, i1, s // {c - o} AS i2, tok_start + s AS tok_start,
    least(tok_start + s + {c}, tok_end) AS tok_end, path || '.' || (s // {c - o}) AS path, path AS parent
  FROM (SELECT *, unnest({starts('(tok_end - tok_start)', c)}) AS s FROM l1)),
spans AS (SELECT * FROM l0 UNION ALL SELECT * FROM l1 UNION ALL SELECT * FROM l2),
chunks AS (
  SELECT p.doc_id, level, row_number() OVER w - 1 AS chunk_idx, tok_start, tok_end,
    array_to_string(list_slice(tokens, tok_start + 1, tok_end), ' ') AS text,
    {key.format('path').replace('doc_id', 'p.doc_id')} AS node_id,
    CASE WHEN parent IS NOT NULL THEN sha256(p.doc_id || '|' || (level - 1) || '|' || parent) END AS parent_id,
    lag({key.format('path').replace('doc_id', 'p.doc_id')}) OVER w AS prev_id,
    lead({key.format('path').replace('doc_id', 'p.doc_id')}) OVER w AS next_id
  FROM spans p JOIN tokenized t ON p.doc_id = t.doc_id
  WINDOW w AS (PARTITION BY p.doc_id, level ORDER BY i0, i1, i2))"""


CHUNKS = (tokenized(), _chunks())
LEVEL_STATS = """SELECT level, count(*) {times} AS n_nodes, count(DISTINCT node_id) AS n_ids,
  sum(length(text))::BIGINT {times} AS n_chars FROM chunks GROUP BY level"""

ELEMENT_DOCS = "element_docs AS (SELECT file_path || '#' || elem_idx AS doc_id, text FROM elements)"


def vectors(name: str, source: str, key: str, text: str) -> str:
    """Unit vectors of MD5 token buckets as float lists."""
    return rf"""{name}_tokens AS (
  SELECT {key} AS k, unnest(list_filter(regexp_split_to_array(lower({text}), '\s+'), lambda t: t <> '')) AS t
  FROM {source}),
{name}_counts AS (
  SELECT k, ('0x' || substr(md5(t), 1, 8))::BIGINT % 64 AS dim, count(*) AS n FROM {name}_tokens GROUP BY ALL),
{name}_weights AS (
  SELECT k, dim, (n / sqrt(sum(n * n) OVER (PARTITION BY k)))::FLOAT AS weight FROM {name}_counts),
{name}_vectors AS (
  SELECT s.{key} AS k, list_transform(range(64), lambda i: coalesce(w.m[i], 0)::DOUBLE) AS v
  FROM (SELECT DISTINCT {key} FROM {source}) s
  LEFT JOIN (SELECT k, map_from_entries(list((dim, weight))) AS m FROM {name}_weights GROUP BY k) w ON s.{key} = w.k)"""


INDEX_NODES = """index_nodes AS (
  SELECT c.node_id, c.text, 'doc_' || d.doc_id || '.pdf' AS filename,
    CASE WHEN d.doc_id % 7 <> 0 THEN d.doc_id % 12 + 1 END AS page_number
  FROM chunks c JOIN documents d ON c.doc_id = d.doc_id),
retrieval AS (SELECT request_id, question FROM resolved WHERE route = 'retrieval')"""

ANSWERED = (
    *RES,
    *CHUNKS,
    INDEX_NODES,
    vectors("q", "retrieval", "request_id", "question"),
    vectors("n", "index_nodes", "node_id", "text"),
    """request_hits AS (
  SELECT *, row_number() OVER (PARTITION BY request_id ORDER BY distance, node_id) AS rank FROM (
    SELECT q.k AS request_id, n.k AS node_id, round(list_distance(q.v, n.v) ** 2, 6) AS distance
    FROM q_vectors q, n_vectors n)
  QUALIFY rank <= 4),
request_cited AS (
  SELECT request_id, list_sort(list(DISTINCT citation)) AS citations, count(*) AS source_nodes_count,
    count(DISTINCT citation) AS unique_sources_count, string_agg(source, ', ' ORDER BY rank) AS sources
  FROM (SELECT h.*, '(Quelle: ' || n.filename || ', Seite: ' || coalesce(n.page_number::VARCHAR, 'N/A') || ')'
      AS citation, n.filename || ':' || coalesce(n.page_number::VARCHAR, 'N/A') AS source
    FROM request_hits h JOIN index_nodes n USING (node_id))
  GROUP BY request_id)""",
    f"""answered AS (
  SELECT r.* EXCLUDE (route, status_code), c.citations, c.sources, c.source_nodes_count, c.unique_sources_count,
    CASE WHEN r.route = 'retrieval' AND r.answer IS NULL THEN 'error' ELSE r.route END AS route,
    CASE WHEN r.route = 'retrieval' AND r.answer IS NULL THEN 500 ELSE r.status_code END AS status_code,
    CASE WHEN r.route = 'meta' THEN coalesce(r.answer, CASE r.meta_type
        WHEN 'title' THEN {lit(fixed.META_FALLBACK_TITLE)} WHEN 'tags' THEN {lit(fixed.META_FALLBACK_TAGS)}
        ELSE {lit(fixed.META_FALLBACK_OTHER)} END)
      WHEN r.route = 'retrieval' THEN CASE
        WHEN len(list_filter(c.citations, lambda s: contains(lower(r.answer), lower(s)))) > 0 THEN r.answer
        ELSE r.answer || {lit(fixed.SOURCES_HEADING)} || array_to_string(c.citations, chr(10)) END
    END AS response_text
  FROM resolved r LEFT JOIN request_cited c USING (request_id))""",
)

AUDITED = (
    *ANSWERED,
    ENTRIES,
    "cited_answers AS (SELECT chat_id, req_no, response_text AS answer FROM answered WHERE route = 'retrieval')",
    with_answers("cited_answers"),
    """lengths AS (
  SELECT a.request_id, count(h.chat_id) AS history_length
  FROM answered a LEFT JOIN history h ON h.chat_id = a.chat_id AND h.req_no <= a.req_no GROUP BY a.request_id),
audited AS (
  SELECT a.request_id, a.req_no, a.asked_chat_id, a.model, a.question, a.answer, a.response_text, a.sources, a.route,
    CASE WHEN a.route = 'meta' THEN true END AS meta_request_detected,
    CASE WHEN a.route = 'meta' THEN meta_type END AS meta_type,
    CASE WHEN a.route = 'meta' THEN confidence END AS meta_confidence,
    CASE WHEN a.route = 'meta' THEN 'LLM-Only (RAG bypassed)' END AS processing_method,
    CASE WHEN a.route = 'retrieval' THEN suspicious END AS suspicious_message_detected,
    CASE WHEN a.route = 'retrieval' THEN alternative_used END AS alternative_question_used,
    l.history_length AS chat_history_length,
    CASE WHEN a.route = 'retrieval' THEN coalesce(source_nodes_count, 0) ELSE 0 END AS source_nodes_count,
    CASE WHEN a.route = 'retrieval' THEN coalesce(unique_sources_count, 0) ELSE 0 END AS unique_sources_count
  FROM answered a JOIN lengths l USING (request_id) WHERE a.status_code = 200)""",
)

OLLAMA = """ollama AS (
  SELECT a.*, CASE WHEN conv_id % 5 <> 0 THEN m.n ELSE 1 END AS n_messages,
    CASE WHEN conv_id % 25 = 0 THEN '' ELSE m.last END AS last
  FROM asked a JOIN (
    SELECT request_id, count(*) AS n, arg_max(content, pos) AS last FROM messages GROUP BY request_id) m
    USING (request_id))"""

# The adapter's requests: its own sessions, and other messages where a prompt or nothing was given.
OLLAMA_RES = tuple(
    part.replace("FROM asked)", "FROM ollama)")
    .replace("coalesce(nullif(asked_chat_id, ''), sha256(request_id)) AS chat_id", "sha256(request_id) AS chat_id")
    .replace("FROM messages WHERE lower(role) = 'user'", "FROM ollama_messages WHERE lower(role) = 'user'")
    for part in (
        CHAT_LOG,
        MESSAGES,
        REQUESTS.replace("\nrequests AS (", "\n" + OLLAMA + ",\nrequests AS ("),
        """ollama_messages AS (
  SELECT request_id, role, content, pos FROM messages WHERE conv_id % 5 <> 0
  UNION ALL SELECT request_id, 'user', last, 0 FROM ollama WHERE conv_id % 5 = 0)""",
        RESOLVED,
    )
)

ANSWER_TEXT = f"""answer_texts AS (
  SELECT *, CASE WHEN route = 'meta' THEN coalesce(answer, CASE meta_type
      WHEN 'title' THEN {lit(fixed.META_FALLBACK_TITLE)} WHEN 'tags' THEN {lit(fixed.META_FALLBACK_TAGS)}
      ELSE {lit(fixed.META_FALLBACK_OTHER)} END) ELSE answer END AS response_text
  FROM resolved WHERE status_code = 200 AND (route = 'meta' OR answer IS NOT NULL))"""

RESPONSE_ID = "'chatcmpl-' || substr(chat_id, 1, 8) || CASE WHEN route = 'meta' THEN '-meta' ELSE '' END"

_FULL_PROMPT = (
    f"{lit(fixed.SYSTEM_PROMPT + fixed.CONTEXT_HEADING)} || {{}} || {lit(fixed.QUESTION_HEADING)} || {{}} "
    f"|| {lit(fixed.ANSWER_CUE)}"
)

_DEBUG_KEYS = [
    ("meta_request_detected", "CASE WHEN meta_request_detected THEN 'True' ELSE 'False' END"),
    ("meta_type", "meta_type"),
    ("meta_confidence", "meta_confidence::VARCHAR"),
    ("processing_method", "processing_method"),
    ("suspicious_message_detected", "CASE WHEN suspicious_message_detected THEN 'True' ELSE 'False' END"),
    ("alternative_question_used", "CASE WHEN alternative_question_used THEN 'True' ELSE 'False' END"),
    ("chat_history_length", "chat_history_length::VARCHAR"),
    ("source_nodes_count", "source_nodes_count::VARCHAR"),
    ("unique_sources_count", "unique_sources_count::VARCHAR"),
]
_STAMP = "strftime(make_timestamp((1700000000 + req_no) * 1000000), '%Y%m%d_%H%M%S_%g')"
DEBUG_LINES = f"""debug_lines AS (
  SELECT request_id, list_filter([
    '========== DEBUG-EINTRAG ' || {_STAMP} || ' ==========',
    '🔍 EINGEHENDE REQUEST-DATEN: Chat-ID=' || coalesce(asked_chat_id, 'None') || ', Model=' || model,
    {', '.join(f"CASE WHEN {k} IS NOT NULL THEN '🔧 {k}: ' || {v} END" for k, v in _DEBUG_KEYS)},
    '✅ USER-MESSAGE: ''' || substr(question, 1, 100) || '...'' (Länge: ' || length(question) || ')',
    CASE WHEN route = 'retrieval' THEN
      '🤖 RAG-ANTWORT: ''' || substr(answer, 1, 100) || '...'' (Länge: ' || length(answer) || ')' END,
    CASE WHEN route = 'retrieval' THEN '📄 QUELLEN: ' || sources END,
    CASE WHEN route = 'meta' THEN '🎯 META-ANFRAGE: ''' || substr(response_text, 1, 100) || '...''' END,
    '========== ENDE DEBUG-EINTRAG ' || {_STAMP} || ' =========='
  ], lambda x: x IS NOT NULL) AS lines FROM audited)"""

_INFO = " || ".join(
    f"CASE WHEN a.{k} IS NULL THEN '' ELSE '  {k}: ' || {v} || chr(10) END" for k, v in _DEBUG_KEYS
)
_NL = "chr(10)"
SOURCE_TEXT = """source_texts AS (
  SELECT h.request_id, string_agg('  Source ' || rank || ': File=''' || n.filename || ''', Page='''
    || coalesce(n.page_number::VARCHAR, 'N/A') || ''', Score=' || printf('%.4f', exp(-distance)) || chr(10)
    || '  Vorschau: ' || substr(replace(n.text, chr(10), ' '), 1, 100) || '...' || chr(10) || chr(10), '' ORDER BY rank)
    AS source_text
  FROM request_hits h JOIN index_nodes n USING (node_id) GROUP BY h.request_id),
message_texts AS (
  SELECT request_id, count(*) AS n_messages, string_agg('  Message ' || (pos + 1) || ' (Role: ' || role || '):' || chr(10)
    || '  ' || CASE WHEN length(content) > 500 THEN substr(content, 1, 500) || '...' ELSE content END
    || chr(10) || chr(10), '' ORDER BY pos) AS message_text
  FROM messages GROUP BY request_id)"""
_STAMP_A = _STAMP.replace("req_no", "a.req_no")
DEBUG_TEXT = f"""
SELECT a.request_id, '========== DEBUG-EINTRAG ' || {_STAMP_A} || ' ==========' || {_NL} || {_NL}
  || '🔍 EINGEHENDE REQUEST-DATEN:' || {_NL} || '  Chat-ID: ' || coalesce(a.asked_chat_id, 'None') || {_NL}
  || '  Model: ' || a.model || {_NL} || '  Temperature: ' || coalesce(r.asked_temperature, 0.7::DOUBLE) || {_NL}
  || '  Max Tokens: ' || coalesce(r.asked_max_tokens, 1000) || {_NL} || {_NL}
  || '📩 EINGEHENDE MESSAGES (' || m.n_messages || '):' || {_NL} || m.message_text
  || '🔧 VERARBEITUNGS-INFORMATIONEN:' || {_NL} || {_INFO} || {_NL}
  || '✅ FINALE USER-MESSAGE:' || {_NL} || '  ' || a.question || {_NL} || {_NL}
  || CASE WHEN a.route = 'meta' THEN '🎯 META-ANFRAGE ANTWORT:' || {_NL} || '  ' || a.response_text || {_NL} || {_NL}
    ELSE '🤖 RAG-ANTWORT:' || {_NL} || '  ' || a.answer || {_NL} || {_NL}
      || coalesce('📄 QUELLEN:' || {_NL} || s.source_text, '') END
  || '========== ENDE DEBUG-EINTRAG ' || {_STAMP_A} || ' ==========' || {_NL} AS entry
FROM audited a JOIN requests r ON r.request_id = a.request_id JOIN message_texts m ON m.request_id = a.request_id
LEFT JOIN source_texts s ON s.request_id = a.request_id"""

GENERATED = f"""request_contexts AS (
  SELECT h.request_id, string_agg(chr(10) || chr(10) || 'Dokument ' || rank || ':' || chr(10) || n.text, '' ORDER BY rank)
    AS context FROM request_hits h JOIN index_nodes n USING (node_id) GROUP BY h.request_id),
full_prompts AS (
  SELECT r.request_id, r.route AS route0, r.status_code AS status0, r.detail, r.meta_type, r.question,
    {_FULL_PROMPT.format('context', 'r.question')} AS p, c.citations
  FROM resolved r LEFT JOIN request_contexts USING (request_id) LEFT JOIN request_cited c USING (request_id)),
prompted AS (
  SELECT *, CASE route0 WHEN 'meta' THEN question WHEN 'retrieval' THEN CASE WHEN length(p) > {fixed.PROMPT_LIMIT}
    THEN substr(p, 1, {fixed.PROMPT_KEEP}) || {lit(fixed.ANSWER_CUE)} ELSE p END END AS prompt FROM full_prompts),
generated AS (
  SELECT *, CASE WHEN length(prompt) % 7 <> 3 THEN 'Ergebnis zu ' || length(prompt) || ' Zeichen: '
    || substr(prompt, greatest(length(prompt) - 29, 1)) END AS made FROM prompted)"""

PROBES = f"""pivots AS (
  SELECT anchor, row_number() OVER (ORDER BY anchor) AS cell FROM (SELECT DISTINCT embedding AS anchor FROM (
    SELECT embedding FROM nodes ORDER BY md5(node_id), node_id LIMIT {CELLS}))),
homes AS (
  SELECT node_id, embedding, cell FROM nodes, pivots
  QUALIFY row_number() OVER (PARTITION BY node_id ORDER BY round(list_distance(embedding, anchor) ** 2, 6), cell) = 1),
probes AS (
  SELECT vec_id AS query_id, embedding AS asked, cell FROM nodes, pivots
  QUALIFY row_number() OVER (
    PARTITION BY vec_id ORDER BY round(list_distance(embedding, anchor) ** 2, 6), cell) <= {PROBES_PER_QUERY}),
probe_hits AS (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY distance, node_id) AS rank FROM (
    SELECT query_id, node_id, round(list_distance(asked, embedding) ** 2, 6) AS distance
    FROM probes JOIN homes USING (cell))
  QUALIFY rank <= 4)"""

STREAM_ENTRIES = """turns AS (
  SELECT conv_id::VARCHAR AS chat_id, turn, CASE WHEN lower(role) = 'user' THEN 'user' ELSE 'assistant' END AS role,
    lower(role) = 'assistant' AS answers, text AS content FROM conversations),
sent AS (
  SELECT chat_id, turn AS req_no, 0 AS step, turn AS pos, role, content FROM turns
  UNION ALL SELECT chat_id, turn + 1, 0, turn, role, content FROM turns),
stored AS (SELECT chat_id, turn - 1 AS req_no, 1 AS step, 0 AS pos, 'assistant' AS role, content FROM turns WHERE answers),
events AS (SELECT * FROM sent UNION ALL SELECT * FROM stored)"""
STREAM_HISTORY = f"""history AS (
  SELECT * FROM ({first_arrivals('events')}) WHERE step = 0 UNION ALL SELECT * FROM stored)"""

LAST_MESSAGES = """
SELECT chat_id, count(*) AS history_length, arg_max(content, (req_no, step, pos)) FILTER (role = 'user') AS last_user
FROM history GROUP BY chat_id"""
AUDIT_COLUMNS = """request_id, meta_request_detected, meta_type, meta_confidence, processing_method,
  suspicious_message_detected, alternative_question_used, chat_history_length, source_nodes_count, unique_sources_count"""
ENTRY_COLUMNS = "chat_id, req_no, step, pos, role, content"

ORACLES: dict[str, str] = {
    "q_scan_dedup_basename": with_(LISTING) + r"""
SELECT regexp_extract(path, '([^/]*)$', 1) AS filename, path, modified, length FROM listing WHERE path LIKE '%.pdf'
QUALIFY row_number() OVER (PARTITION BY filename ORDER BY modified DESC, path DESC, length DESC) = 1""",
    "q_file_profile": with_(ELEMENTS, FILES) + """
SELECT file_path, length, p.n_pages, round(length / 1024 / 1024, 2) AS size_mb FROM files
LEFT JOIN (SELECT file_path, max(page_number) AS n_pages FROM elements GROUP BY file_path) p USING (file_path)""",
    "q_element_normalize": with_(ELEMENTS) + """
SELECT file_path, file_directory, filename, elem_idx, coalesce(type, 'unbekannt') AS type,
  CASE WHEN elem_idx % 13 <> 5 THEN text ELSE '' END AS text, page_number FROM elements""",
    "q_extract_html_elements": with_(HTML) + "SELECT page_id, elem_idx, type, text FROM html_elements",
    "q_extract_fallback": with_(f"""tagged AS (
  SELECT page_id, {html_tags('pre|table')} AS a, {html_tags('p')} AS b FROM pages),
used AS (
  SELECT page_id, CASE WHEN len(a) > 0 THEN 'blocks' ELSE 'paragraphs' END AS strategy_used,
    unnest(CASE WHEN len(a) > 0 THEN a ELSE b END) AS m FROM tagged)""") + f"""
SELECT page_id, strategy_used, count(*) AS n_elements,
  sum(length({strip("regexp_replace(m, '<[^>]+>', ' ', 'g')")}))::BIGINT AS n_chars FROM used GROUP BY ALL""",
    "q_extract_status": with_(f"""stored AS (
  SELECT page_id, CASE WHEN page_id % 10 = 3 THEN NULL WHEN page_id % 10 = 5 THEN '' ELSE html END AS html FROM pages),
counted AS (SELECT html, len({html_tags('h1|p|li')}) AS n FROM stored),
outcome AS (
  SELECT CASE WHEN html IS NULL THEN 'failed' WHEN n = 0 THEN 'empty' ELSE 'loaded' END AS status,
    CASE WHEN html IS NULL THEN 'ValueError' END AS error, coalesce(n, 0) AS n FROM counted)""") + """
SELECT status, error, count(*) AS n_files, sum(n)::BIGINT AS n_elements FROM outcome GROUP BY ALL""",
    "q_union_elements": with_(ELEMENTS, HTML) + """
SELECT file_path, elem_idx, type, length(text) AS n_chars FROM elements
UNION ALL SELECT 'pages/' || page_id || '.html', elem_idx, type, length(text) FROM html_elements""",
    "q_metadata_whitelist": with_(ELEMENTS) + """
SELECT file_path, elem_idx, 'file_directory,file_path,filename' || CASE WHEN page_number IS NULL THEN ''
  ELSE ',page_number' END AS kept_keys, page_number::VARCHAR AS page_number FROM elements""",
    "q_path_parts": with_(FILES) + r"""
SELECT file_path, regexp_extract(file_path, '^(.*)/', 1) AS file_directory,
  regexp_extract(file_path, '([^/]*)$', 1) AS filename FROM files""",
    "q_node_quality": with_(NODES) + """
SELECT node_id, filename IS NULL OR vec_id % 41 = 0 AS missing_path, page_number IS NULL AS missing_page FROM nodes""",
    "q_elements_by_type": with_(ELEMENTS) + """
SELECT coalesce(type, 'unbekannt') AS type, count(*) AS n_elements FROM elements GROUP BY ALL""",
    "q_pages_per_file": with_(ELEMENTS) + """
SELECT file_path, page_number, row_number() OVER (PARTITION BY file_path ORDER BY page_number) AS place
FROM (SELECT DISTINCT file_path, page_number FROM elements WHERE page_number IS NOT NULL)""",
    "q_file_report": with_(ELEMENTS) + """
SELECT file_path, count(*) AS n_elements, count(DISTINCT page_number) AS n_pages, sum(length(text))::BIGINT AS n_chars
FROM elements GROUP BY file_path""",
    "q_file_report_total": with_(ELEMENTS) + """
SELECT file_path, count(*) AS n_elements FROM elements GROUP BY ROLLUP (file_path)""",
    "q_file_report_text": with_(ELEMENTS) + """
SELECT filename, format('{:,}', sum(length(text))::BIGINT) || ' Zeichen' AS total_text,
  CASE WHEN count(page_number) > 0 THEN count(DISTINCT page_number)::VARCHAR ELSE 'Keine oder nur N/A' END
    AS pages_text, count(*) AS n_elements
FROM elements GROUP BY filename, file_path""",
    "q_metadata_size": with_(ELEMENTS) + """
SELECT sum(length('{"file_path":"' || file_path || '","file_directory":"' || file_directory || '","filename":"'
  || filename || '"' || CASE WHEN page_number IS NULL THEN '' ELSE ',"page_number":' || page_number END || '}'))::BIGINT
  // count(*) AS avg_metadata_size FROM elements""",
    "q_first_elements": with_(ELEMENTS) + """
SELECT file_path, string_agg(length(text) || ':' || coalesce(page_number::VARCHAR, 'N/A'), ' ' ORDER BY elem_idx)
  AS lengths_and_pages, coalesce(array_to_string(list_sort(list(DISTINCT page_number) FILTER (page_number IS NOT NULL)),
  ','), '') AS pages FROM elements WHERE elem_idx < 5 GROUP BY file_path""",
    "q_first_nodes": with_(*CHUNKS) + """
SELECT node_id, length(text) AS n_chars, substr(replace(text, chr(10), ' '), 1, 150) || '...' AS preview
FROM chunks ORDER BY doc_id, level, chunk_idx LIMIT 3""",
    "q_requests_defaults": with_(CHAT_LOG, MESSAGES, REQUESTS) + f"""
SELECT request_id, model, coalesce(asked_temperature, {fixed.DEFAULT_TEMPERATURE}::DOUBLE) AS temperature,
  coalesce(asked_max_tokens, {fixed.DEFAULT_MAX_TOKENS})::BIGINT AS max_tokens FROM requests""",
    "q_role_normalize": with_(CHAT_LOG, MESSAGES) + """
SELECT role, CASE WHEN lower(role) = 'user' THEN 'user' ELSE 'assistant' END AS normalized, count(*) AS n
FROM messages GROUP BY ALL""",
    "q_last_user_message": with_(*RES) + """
SELECT request_id, coalesce(n_user_messages, 0) AS n_user_messages, last_user FROM resolved""",
    "q_message_flags": with_(CHAT_LOG, MESSAGES) + f"""
SELECT request_id, pos, {preview('content', 100)} AS preview, {any_of('content', fixed.FLAG_KEYWORDS)} AS flagged
FROM messages""",
    "q_suspicious": with_(CHAT_LOG) + f"""
SELECT conv_id, turn, {any_of('content', fixed.SUSPICIOUS_KEYWORDS)} AS suspicious FROM chat_log""",
    "q_meta_scores": with_(META_PROMPTS, META_SCORES) + "SELECT * FROM meta_scores",
    "q_meta_classify": with_(META_PROMPTS, META_SCORES) + f"SELECT conv_id, turn, {verdict()} FROM meta_scores",
    "q_meta_stats": with_(META_PROMPTS, META_SCORES) + f"""
SELECT meta_type, count(*) AS n, round(avg(confidence), 6) AS avg_confidence
FROM (SELECT coalesce(meta_type, 'none') AS meta_type, confidence FROM (SELECT {verdict()} FROM meta_scores))
GROUP BY ROLLUP (meta_type)""",
    "q_route_counts": with_(*RES) + "SELECT route, status_code, count(*) AS n FROM resolved GROUP BY ALL",
    "q_meta_fallback": with_(*RES) + f"""
SELECT request_id, meta_type, coalesce(CASE WHEN conv_id % 2 = 1 THEN answer END, CASE meta_type
  WHEN 'title' THEN {lit(fixed.META_FALLBACK_TITLE)} WHEN 'tags' THEN {lit(fixed.META_FALLBACK_TAGS)}
  ELSE {lit(fixed.META_FALLBACK_OTHER)} END) AS response_text FROM resolved WHERE route = 'meta'""",
    "q_alternative_question": with_(*RES) + """
SELECT request_id, suspicious, alternative_used, alternative_idx, question FROM resolved""",
    "q_resolved_message": with_(*RES) + """
SELECT request_id, chat_id, route, meta_type, confidence, suspicious, question FROM resolved""",
    "q_request_validation": with_(*RES) + f"""
SELECT request_id, status_code, detail, length({strip('question')}) AS stripped_length FROM resolved""",
    "q_session_assign": with_(CHAT_LOG, MESSAGES, REQUESTS) + "SELECT request_id, chat_id, new_session FROM requests",
    "q_history_merge": with_(*HIST) + f"SELECT {ENTRY_COLUMNS} FROM merged",
    "q_history_anti_join": with_(*HIST) + f"""
SELECT {ENTRY_COLUMNS} FROM merged m WHERE NOT EXISTS (
  SELECT 1 FROM entries e WHERE e.chat_id = m.chat_id AND e.content = m.content AND e.req_no <= 2)""",
    "q_context_history": with_(*HIST) + f"""
SELECT {ENTRY_COLUMNS} FROM merged
QUALIFY row_number() OVER (PARTITION BY chat_id ORDER BY req_no DESC, step DESC, pos DESC) > 1""",
    "q_history_with_answers": with_(*HISTORY) + f"SELECT {ENTRY_COLUMNS} FROM history",
    "q_history_length": with_(*HISTORY) + "SELECT chat_id, count(*) AS history_length FROM history GROUP BY chat_id",
    "q_history_length_at": with_(*HISTORY) + """
SELECT r.request_id, count(h.chat_id) AS history_length FROM requests r
LEFT JOIN history h ON h.chat_id = r.chat_id AND h.req_no <= r.req_no GROUP BY r.request_id""",
    "q_token_counts": with_(tokenized()) + "SELECT doc_id, n AS n_tokens FROM tokenized",
    "q_chunk_fixed": with_(tokenized()) + f"""
SELECT doc_id, s // {512 - fixed.CHUNK_OVERLAP} AS chunk_idx, s AS tok_start, least(s + 512, n) AS tok_end,
  array_to_string(list_slice(tokens, s + 1, s + 512), ' ') AS text
FROM (SELECT *, unnest({starts('n', 512)}) AS s FROM tokenized)""",
    "q_chunk_hierarchical": with_(*CHUNKS) + """
SELECT node_id, c.doc_id, level, chunk_idx, tok_start, tok_end, c.text, parent_id, d.source
FROM chunks c JOIN documents d ON c.doc_id = d.doc_id""",
    "q_chunk_links": with_(*CHUNKS) + "SELECT node_id, prev_id, next_id FROM chunks",
    "q_chunk_children": with_(*CHUNKS) + """
SELECT parent_id AS node_id, count(*) AS n_children, string_agg(node_id, ',' ORDER BY chunk_idx) AS children
FROM chunks WHERE parent_id IS NOT NULL GROUP BY parent_id""",
    "q_chunk_stats": with_(*CHUNKS) + """
SELECT level, count(*) AS n_nodes, sum(length(text))::BIGINT AS total_chars, max(length(text)) AS max_chars
FROM chunks GROUP BY level""",
    "q_chunk_dedup": with_(*CHUNKS) + """
SELECT node_id, doc_id, level, text FROM chunks
QUALIFY row_number() OVER (PARTITION BY doc_id, text ORDER BY level, chunk_idx) = 1""",
    "q_embed_hash": with_(vectors("t", "documents", "doc_id", "text")) + """
SELECT k AS doc_id, dim, round(weight::DOUBLE, 5) AS weight FROM t_weights""",
    "q_embed_model": with_(vectors("t", "documents", "doc_id", "text")) + """
SELECT k AS doc_id, dim, round(weight::DOUBLE, 5) AS weight FROM t_weights""",
    "q_knn_exact": with_(NODES, HITS) + "SELECT query_id, node_id, distance, rank FROM hits",
    "q_knn_blocks": with_(NODES, HITS) + "SELECT query_id, node_id, distance, rank FROM hits",
    "q_knn_cells": with_(NODES, HITS) + "SELECT query_id, node_id, distance, rank FROM hits",
    "q_knn_scores": with_(NODES, HITS) + """
SELECT query_id, rank, round(exp(-distance), 6) AS score, printf('%.4f', exp(-distance)) AS score_text FROM hits""",
    "q_hits_with_metadata": with_(NODES, HITS) + "SELECT query_id, rank, node_id, filename, page_number FROM found",
    "q_hit_previews": with_(NODES, HITS) + """
SELECT query_id, rank, coalesce(filename, 'Unbekanntes Dokument') AS filename,
  coalesce(page_number::VARCHAR, 'N/A') AS page,
  CASE WHEN rank < 4 THEN round(exp(-distance), 6) ELSE 0.0::DOUBLE END AS score,
  substr(replace(text, chr(10), ' '), 1, 70) || '...' AS preview FROM found""",
    "q_citations": with_(NODES, HITS, CITED) + """
SELECT query_id, array_to_string(citations, ' | ') AS citations FROM cited""",
    "q_source_counts": with_(NODES, HITS, CITED) + """
SELECT query_id, source_nodes_count, unique_sources_count FROM cited""",
    "q_debug_sources": with_(NODES, HITS, CITED) + "SELECT query_id, sources FROM cited",
    "q_already_cited": with_(NODES, HITS, CITED, QUESTION_ANSWERS) + "SELECT query_id, already_cited FROM judged",
    "q_answer_with_sources": with_(NODES, HITS, CITED, QUESTION_ANSWERS) + f"""
SELECT query_id, CASE WHEN already_cited THEN answer
  ELSE answer || {lit(fixed.SOURCES_HEADING)} || array_to_string(citations, chr(10)) END AS answer FROM judged""",
    "q_context_text": with_(NODES, HITS, CONTEXT) + "SELECT query_id, context FROM contexts",
    "q_prompt": with_(NODES, HITS, CONTEXT) + f"""
SELECT query_id, {_FULL_PROMPT.format('context', "'Frage ' || query_id || '?'")} AS prompt FROM contexts""",
    "q_prompt_truncate": with_(f"""prompts AS (
  SELECT doc_id, {_FULL_PROMPT.format("coalesce(text, '')", "coalesce(lang, '')")} AS p FROM documents)""") + f"""
SELECT doc_id, length(p) AS full_length, CASE WHEN length(p) > {fixed.PROMPT_LIMIT}
  THEN substr(p, 1, {fixed.PROMPT_KEEP}) || {lit(fixed.ANSWER_CUE)} ELSE p END AS prompt FROM prompts""",
    "q_text_preview": f"""
SELECT doc_id, length(text) AS n_chars, {preview('text', 100)} AS preview_100, {preview('text', 500)} AS preview_500,
  substr(replace(text, chr(10), ' '), 1, 70) || '...' AS line_70, substr(text, 1, 200) || '...' AS always_200
FROM documents""",
    "q_url_parts": r"""
SELECT page_id, regexp_extract(url, '^https?://([^:/?#]+)', 1) AS host, split_part(url, '?', 1) AS prefix,
  regexp_replace(url, '^(https?://)[^:/?#]+', '\1localhost') AS local_url FROM pages""",
    "q_response_ids": with_(*RES) + f"SELECT request_id, {RESPONSE_ID} AS response_id FROM resolved WHERE status_code = 200",
    "q_openai_response": with_(*ANSWERED) + f"""
SELECT request_id, to_json({{'id': {RESPONSE_ID}, 'object': 'chat.completion', 'created': 1700000000 + req_no,
  'model': model, 'choices': [{{'index': 0, 'message': {{'role': 'assistant', 'content': response_text}},
  'finish_reason': 'stop'}}], 'usage': {{'prompt_tokens': 0, 'completion_tokens': 0, 'total_tokens': 0}},
  'chat_id': chat_id}})::VARCHAR AS response FROM answered WHERE status_code = 200""",
    "q_ollama_to_internal": with_(CHAT_LOG, MESSAGES, REQUESTS.split(",\nrequests AS")[0], OLLAMA) + f"""
SELECT request_id, coalesce(asked_model, 'llama3.2:1b') AS model,
  coalesce(CASE WHEN conv_id % 2 = 0 THEN asked_temperature END, 0.7::DOUBLE) AS temperature,
  coalesce(asked_max_tokens, 1000)::BIGINT AS max_tokens, n_messages, last FROM ollama
UNION ALL
SELECT request_id, coalesce(asked_model, 'llama3.2:1b'), 0.4::DOUBLE, 1000::BIGINT, n_messages, last FROM ollama""",
    "q_ollama_response": with_(*OLLAMA_RES, *ANSWERED[len(RES):]) + f"""
SELECT request_id, to_json({{'model': model, 'created_at': {lit(fixed.OLLAMA_CREATED_AT)},
    'message': {{'role': 'assistant', 'content': response_text}}, 'done': true}})::VARCHAR AS response,
  CASE WHEN conv_id % 3 = 0 THEN to_json({{'model': model, 'created_at': '2025-01-01T00:00:00Z',
      'message': {{'role': 'assistant', 'content': response_text}}, 'done': true}})::VARCHAR
    ELSE to_json({{'model': model, 'created_at': '2025-01-01T00:00:00Z',
      'message': {{'role': 'assistant', 'content': response_text}}, 'done': true,
      {', '.join(f"'{k}': {v}" for k, v in fixed.OLLAMA_TIMINGS.items())}}})::VARCHAR END AS older_response
FROM answered WHERE status_code = 200""",
    "q_answer_requests": with_(*ANSWERED) + """
SELECT request_id, route, status_code, sources, response_text FROM answered""",
    "q_generate": with_(*ANSWERED, GENERATED) + f"""
SELECT request_id, length(prompt) AS prompt_length,
  CASE WHEN route0 = 'retrieval' AND made IS NULL THEN 'error' ELSE route0 END AS route,
  CASE WHEN route0 = 'retrieval' AND made IS NULL THEN 500 ELSE status0 END AS status_code,
  CASE WHEN route0 = 'retrieval' AND made IS NULL
    THEN {lit(fixed.ERROR_ENGINE)} || 'kein Ergebnis bei ' || length(prompt) || ' Zeichen' ELSE detail END AS detail,
  CASE WHEN route0 = 'meta' THEN coalesce(made, CASE meta_type
      WHEN 'title' THEN {lit(fixed.META_FALLBACK_TITLE)} WHEN 'tags' THEN {lit(fixed.META_FALLBACK_TAGS)}
      ELSE {lit(fixed.META_FALLBACK_OTHER)} END)
    WHEN route0 = 'retrieval' THEN CASE
      WHEN len(list_filter(citations, lambda s: contains(lower(made), lower(s)))) > 0 THEN made
      ELSE made || {lit(fixed.SOURCES_HEADING)} || array_to_string(citations, chr(10)) END END AS response_text
FROM generated""",
    "q_debug_records": with_(*AUDITED) + f"SELECT {AUDIT_COLUMNS} FROM audited",
    "q_stream_answers": with_(*AUDITED) + f"SELECT {AUDIT_COLUMNS} FROM audited",
    "q_audit_log": with_(*AUDITED) + f"""
SELECT {AUDIT_COLUMNS}, strftime(make_timestamp((1700000000 + req_no) * 1000000), '%Y-%m-%d') AS day FROM audited""",
    "q_stream_live_sessions": with_(STREAM_ENTRIES, STREAM_HISTORY) + LAST_MESSAGES,
    "q_stream_arrivals": with_(STREAM_ENTRIES) + """
SELECT DISTINCT chat_id, content, CASE WHEN step = 1 THEN req_no END AS answered FROM events""",
    "q_stream_requests": with_(*RES) + """
SELECT CASE WHEN conv_id % 7 = 5 THEN '' ELSE request_id END AS request_id,
  CASE WHEN conv_id % 7 IN (3, 4) THEN 'malformed' WHEN conv_id % 7 = 5 THEN 'no request_id' END AS problem,
  CASE WHEN conv_id % 7 NOT IN (3, 4, 5) THEN route END AS route,
  CASE WHEN conv_id % 7 NOT IN (3, 4, 5) THEN status_code END AS status_code,
  CASE WHEN conv_id % 7 NOT IN (3, 4, 5) THEN question END AS question FROM resolved""",
    "q_debug_lines": with_(*AUDITED, DEBUG_LINES) + """
SELECT request_id, unnest(range(len(lines))) AS line_no, unnest(lines) AS line FROM debug_lines""",
    "q_debug_text": with_(*AUDITED, SOURCE_TEXT) + DEBUG_TEXT,
    "q_knn_probe": with_(NODES, PROBES) + "SELECT query_id, node_id, distance, rank FROM probe_hits",
    "q_knn_recall": with_(NODES, HITS, PROBES) + """
SELECT count(*) AS n_hits, avg((p.node_id IS NOT NULL)::INT) AS recall
FROM hits h LEFT JOIN probe_hits p ON p.query_id = h.query_id AND p.node_id = h.node_id""",
    "q_log_tail": """
SELECT event_id, strftime(ts, '%Y-%m-%d %H:%M:%S,%g') AS logged_at,
  CASE WHEN event_type = 'error' THEN 'ERROR' ELSE 'INFO' END AS level, event_type AS message
FROM events ORDER BY logged_at DESC, event_id DESC LIMIT 100""",
    "q_index_rebuild": with_(*CHUNKS) + LEVEL_STATS.format(times=""),
    "q_index_add": with_(*CHUNKS) + LEVEL_STATS.format(times="* 2"),
    "q_index_add_dedupe": with_(*CHUNKS) + LEVEL_STATS.format(times=""),
    "q_index_delete": "SELECT 0::BIGINT AS n_nodes",
    "q_index_count": with_(*CHUNKS) + "SELECT count(*) AS n_nodes FROM chunks",
    "q_index_reconcile": with_(*CHUNKS) + """
SELECT count(*) AS n_parsed, count(*) AS n_stored, false AS differs FROM chunks""",
    "q_index_contents": with_(*CHUNKS, vectors("n", "chunks", "node_id", "text")) + """
SELECT c.node_id, c.doc_id::VARCHAR AS doc_id, level, chunk_idx, tok_start, tok_end, c.text, parent_id, prev_id, next_id,
  './PDFs/' || d.source || '/doc_' || d.doc_id || '.pdf' AS file_path, './PDFs/' || d.source AS file_directory,
  'doc_' || d.doc_id || '.pdf' AS filename, CASE WHEN d.doc_id % 7 <> 0 THEN d.doc_id % 12 + 1 END AS page_number, vector
FROM chunks c JOIN documents d ON c.doc_id = d.doc_id LEFT JOIN (
  SELECT k, string_agg(w, ' ' ORDER BY w) AS vector FROM (
    SELECT k, format('{}:{:.4f}', dim, round(weight::DOUBLE, 4)) AS w FROM n_weights) GROUP BY k) v ON v.k = c.node_id""",
    "q_index_add_known": with_(*CHUNKS) + """
SELECT node_id, 1 AS times FROM chunks WHERE doc_id::BIGINT % 2 = 0 OR doc_id::BIGINT % 3 = 0""",
    "q_index_fetch": with_(*ANSWERED) + """
SELECT node_id, text, filename, page_number FROM index_nodes WHERE node_id IN (SELECT node_id FROM request_hits)""",
    "q_knn_trained": """
SELECT 4 * count(*) AS n_hits, count(*) AS n_nodes, true AS recall_reached, true AS quarter_read FROM embeddings""",
    "q_build_index": with_(ELEMENTS, ELEMENT_DOCS, tokenized("element_docs"), _chunks()) + LEVEL_STATS.format(times=""),
    "q_stream_history": with_(STREAM_ENTRIES, STREAM_HISTORY) + f"""
SELECT {ENTRY_COLUMNS}, row_number() OVER (PARTITION BY chat_id ORDER BY req_no, step, pos) AS place FROM history""",
    "q_stream_sessions": with_(STREAM_ENTRIES, STREAM_HISTORY) + LAST_MESSAGES,
    "q_stream_ingest": with_(
        "stream_docs AS (SELECT 'doc_' || doc_id || '.pdf#0' AS doc_id, text FROM documents)",
        tokenized("stream_docs"), _chunks()) + LEVEL_STATS.format(times=""),
    "q_stream_classify": with_(
        f"prompts AS (SELECT conv_id, turn, {meta_text('text')} AS content FROM conversations)",
        META_SCORES.replace("FROM meta_prompts", "FROM prompts").replace("SELECT conv_id, turn,", "SELECT conv_id, turn, content,"),
    ) + f"""
SELECT conv_id, turn, {verdict()}, {any_of('content', fixed.SUSPICIOUS_KEYWORDS)} AS suspicious,
  {any_of('content', fixed.FLAG_KEYWORDS)} AS flagged FROM meta_scores""",
}
