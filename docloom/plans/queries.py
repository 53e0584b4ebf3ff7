"""The registered queries: ``name -> (spark, sf_dir) -> DataFrame``."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import fixed
from ..functions import text as X
from ..functions.classify import general_score, is_suspicious, meta_answer, tags_score, title_score, with_verdict
from ..operators import cells
from ..operators import chunks as K
from ..operators import citations as A
from ..operators import conversation as C
from ..operators import elements as G
from ..operators import knn as N
from ..operators import requests as R
from ..operators.embed import embed_hash, embedder, hash_model
from ..operators.generate import generator_column, with_generated
from ..operators.records import (
    AUDIT,
    audit_lines,
    audit_text,
    ollama_response,
    ollama_response_timed,
    response_id,
    source_lines,
)
from ..session import discard, materialize, scratch_path
from ..sources import elements as E
from ..sources import files, logs
from ..schemas import CHAT_REQUEST
from ..sources.chat import from_ollama, stream_lines
from ..sources.index import CODEC, Collection
from ..streaming import history as SH
from ..streaming import sessions as SS
from ..streaming.answers import answer_stream
from ..streaming.audit import audit_stream
from ..streaming.classify import classify
from ..streaming.ingest import ingest_stream
from ..streaming.requests import run_requests
from ..streaming.sink import run_once
from . import answer as P
from . import ingest, inputs

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def query(fn: Query) -> Query:
    QUERIES[fn.__name__] = fn
    return fn


def long(column) -> F.Column:
    return F.col(column).cast("long") if isinstance(column, str) else column.cast("long")


# --- files, elements, extraction -------------------------------------------------


@query
def q_scan_dedup_basename(spark, d):
    found = files.one_per_name(inputs.file_listing(spark, d))
    return found.select("filename", "path", F.unix_timestamp("modificationTime").alias("modified"), "length")


def _document_files(spark, d):
    return inputs.table(spark, d, "documents").select(
        F.concat(F.lit("./PDFs/"), "source", F.lit("/doc_"), "doc_id", F.lit(".pdf")).alias("file_path"),
        F.octet_length("text").cast("long").alias("length"),
    )


@query
def q_file_profile(spark, d):
    profile = G.file_profile(_document_files(spark, d), inputs.elements(spark, d))
    return profile.select("file_path", "length", long("n_pages").alias("n_pages"), "size_mb")


def element_json(spark, d):
    """``file_path, json``: the elements of a document as an extractor returns them."""
    docs = inputs.documents(spark, d)

    def element(line, i):
        page = F.when((F.col("doc_id") + i) % 11 != 0, (1 + F.floor(i / 5)).cast("int"))
        return F.struct(
            F.when(i % 13 != 5, line).alias("text"),
            F.when(i % 7 != 6, F.when(i == 0, "Title").otherwise("NarrativeText")).alias("type"),
            F.struct(page.alias("page_number"), F.lit("de").alias("language")).alias("metadata"),
        )

    return docs.select(
        F.concat(F.lit("./PDFs/"), "source", F.lit("/doc_"), "doc_id", F.lit(".pdf")).alias("file_path"),
        F.to_json(F.transform(F.split("text", "\n"), element)).alias("json"),
    )


@query
def q_element_normalize(spark, d):
    found = E.parse_element_json(element_json(spark, d))
    return found.select(
        "file_path", "file_directory", "filename", long("elem_idx").alias("elem_idx"), "type", "text",
        long("page_number").alias("page_number"),
    )


@query
def q_extract_html_elements(spark, d):
    found = E.html_elements(inputs.table(spark, d, "pages"), "page_id", "html")
    return found.select("page_id", long("elem_idx").alias("elem_idx"), "type", "text")


@query
def q_extract_fallback(spark, d):
    html = F.col("html")
    pages = inputs.table(spark, d, "pages").select(
        "page_id", E.html_tags(html, ["pre", "table"]).alias("a"), E.html_tags(html, ["p"]).alias("b")
    )
    markup, used = E.with_fallback(F.col("a"), F.col("b"), ("blocks", "paragraphs"))
    keep = ["page_id", used.alias("strategy_used")]
    return X.numbered_rows(pages, keep, markup, "i", "m").groupBy(
        "page_id", "strategy_used"
    ).agg(F.count(F.lit(1)).alias("n_elements"), F.sum(F.length(E.html_text(F.col("m")))).alias("n_chars"))


_TAG = re.compile(r"<(h1|p|li)(?:\s[^>]*)?>(.*?)</(?:h1|p|li)>", re.DOTALL)


def _page_extractor(content, strategy="auto"):
    """The example extractor: headings, paragraphs and list items of an HTML page."""
    if content is None:
        raise ValueError("no content")
    return [(E.HTML_TYPES[tag], body, None) for tag, body in _TAG.findall(content)]


@query
def q_extract_status(spark, d):
    return E.extract_status(E.extract(inputs.stored_pages(spark, d), _page_extractor)).drop("seconds")


@query
def q_union_elements(spark, d):
    html = E.html_elements(inputs.table(spark, d, "pages"), "page_id", "html").select(
        F.concat(F.lit("pages/"), "page_id", F.lit(".html")).alias("file_path"), "elem_idx", "type", "text"
    )
    both = G.union_all([inputs.elements(spark, d).select(*html.columns), html])
    return both.select(
        "file_path", long("elem_idx").alias("elem_idx"), "type", long(F.length("text")).alias("n_chars")
    )


@query
def q_metadata_whitelist(spark, d):
    extra = {"languages": F.lit("de"), "coordinates": F.lit("0,0")}
    given = {k: F.col(k).cast("string") for k in fixed.METADATA_KEYS}
    raw = F.create_map(*[x for k, v in {**extra, **given}.items() for x in (F.lit(k), v)])
    present = F.map_filter(raw, lambda k, v: v.isNotNull())
    kept = inputs.elements(spark, d).select("file_path", "elem_idx", G.whitelist(present).alias("m"))
    return kept.select(
        "file_path",
        long("elem_idx").alias("elem_idx"),
        F.array_join(F.array_sort(F.map_keys("m")), ",").alias("kept_keys"),
        F.try_element_at("m", F.lit("page_number")).alias("page_number"),
    )


@query
def q_path_parts(spark, d):
    path = F.col("file_path")
    return _document_files(spark, d).select(
        "file_path", X.dir_name(path).alias("file_directory"), X.base_name(path).alias("filename")
    )


@query
def q_node_quality(spark, d):
    v = F.expr("cast(substring(node_id, 2) as int)")
    path = F.when(v % 41 == 0, "").otherwise(F.col("filename"))
    meta = F.struct(path.alias("file_path"), "page_number")
    checked = G.node_quality(inputs.nodes(spark, d).select("node_id", meta.alias("metadata")))
    return checked.select("node_id", "missing_path", "missing_page")


@query
def q_elements_by_type(spark, d):
    return G.by_type(inputs.elements(spark, d))


@query
def q_pages_per_file(spark, d):
    pages = G.pages_per_file(inputs.elements(spark, d))
    return pages.select("file_path", long("page_number").alias("page_number"), "place")


@query
def q_file_report(spark, d):
    return G.file_report(inputs.elements(spark, d))


@query
def q_file_report_total(spark, d):
    return G.file_report_total(inputs.elements(spark, d))


@query
def q_file_report_text(spark, d):
    return G.file_report_text(G.file_report(inputs.elements(spark, d)))


@query
def q_metadata_size(spark, d):
    return G.metadata_size(inputs.elements(spark, d))


@query
def q_first_elements(spark, d):
    return G.first_elements_report(inputs.elements(spark, d))


@query
def q_first_nodes(spark, d):
    first = G.first_nodes(_chunks(spark, d), ["doc_id", "level", "chunk_idx"])
    return first.select(
        "node_id", long(F.length("text")).alias("n_chars"),
        X.preview_always(X.one_line(F.col("text")), 150).alias("preview"),
    )


# --- requests and classification -------------------------------------------------


def _requests(spark, d):
    return R.with_session(inputs.requests(spark, d))


def _resolved(spark, d):
    return R.resolve(_requests(spark, d))


@query
def q_requests_defaults(spark, d):
    filled = R.with_defaults(inputs.requests(spark, d))
    return filled.select("request_id", "model", "temperature", long("max_tokens").alias("max_tokens"))


@query
def q_role_normalize(spark, d):
    rows = R.message_rows(inputs.requests(spark, d))
    return rows.groupBy("role", R.normalize_role(F.col("role")).alias("normalized")).agg(
        F.count(F.lit(1)).alias("n")
    )


@query
def q_last_user_message(spark, d):
    found = inputs.requests(spark, d).select("request_id", R.user_texts(F.col("messages")).alias("texts"))
    return found.select(
        "request_id", F.size("texts").cast("long").alias("n_user_messages"), R.last_of(F.col("texts")).alias("last_user")
    )


@query
def q_message_flags(spark, d):
    rows = R.message_rows(inputs.requests(spark, d))
    return rows.select(
        "request_id", long("pos").alias("pos"), X.preview(F.col("content"), 100).alias("preview"), "flagged"
    )


@query
def q_suspicious(spark, d):
    return inputs.chat_log(spark, d).select("conv_id", "turn", is_suspicious(F.col("content")).alias("suspicious"))


@query
def q_meta_scores(spark, d):
    text = F.col("content")
    return inputs.meta_prompts(spark, d).select(
        "conv_id", "turn", title_score(text).alias("title_score"), tags_score(text).alias("tags_score"),
        general_score(text).alias("general_score"),
    )


@query
def q_meta_classify(spark, d):
    found = with_verdict(inputs.meta_prompts(spark, d), "content")
    return found.select("conv_id", "turn", "meta.is_meta", F.col("meta.type").alias("meta_type"), "meta.confidence")


@query
def q_meta_stats(spark, d):
    found = with_verdict(inputs.meta_prompts(spark, d), "content")
    kind = F.coalesce("meta.type", F.lit("none")).alias("meta_type")
    return found.select(kind, "meta.confidence").rollup("meta_type").agg(
        F.count(F.lit(1)).alias("n"), F.round(F.avg("confidence"), 6).alias("avg_confidence")
    )


@query
def q_route_counts(spark, d):
    return _resolved(spark, d).groupBy("route", "status_code").agg(F.count(F.lit(1)).alias("n")).select(
        "route", long("status_code").alias("status_code"), "n"
    )


@query
def q_meta_fallback(spark, d):
    meta = _resolved(spark, d).where(F.col("route") == "meta")
    generated = F.when(F.col("conv_id") % 2 == 1, F.col("answer"))
    return meta.select(
        "request_id", F.col("meta.type").alias("meta_type"),
        meta_answer(F.col("meta.type"), generated).alias("response_text"),
    )


@query
def q_alternative_question(spark, d):
    return _resolved(spark, d).select(
        "request_id", "suspicious", "alternative_used", long("alternative_idx").alias("alternative_idx"), "question"
    )


@query
def q_resolved_message(spark, d):
    return _resolved(spark, d).select(
        "request_id", "chat_id", "route", F.col("meta.type").alias("meta_type"), "meta.confidence", "suspicious",
        "question",
    )


@query
def q_request_validation(spark, d):
    return _resolved(spark, d).select(
        "request_id", long("status_code").alias("status_code"), "detail",
        long(F.length(X.strip(F.col("question")))).alias("stripped_length"),
    )


# --- conversations ---------------------------------------------------------------


@query
def q_session_assign(spark, d):
    return _requests(spark, d).select("request_id", "chat_id", "new_session")


def _entry_columns(history):
    return history.select(
        "chat_id", "req_no", long("step").alias("step"), long("pos").alias("pos"), "role", "content"
    )


@query
def q_history_merge(spark, d):
    return _entry_columns(C.merge_history(_requests(spark, d)))


@query
def q_history_anti_join(spark, d):
    entries = C.message_entries(_requests(spark, d))
    history = C.first_arrivals(entries.where(F.col("req_no") <= 2))
    return _entry_columns(C.new_entries(entries, history))


@query
def q_context_history(spark, d):
    return _entry_columns(C.context_history(C.merge_history(_requests(spark, d))))


def _with_answers(resolved):
    answers = resolved.where(F.col("route") == "retrieval").select("chat_id", "req_no", "answer")
    return C.history_with_answers(C.message_entries(resolved), answers)


@query
def q_history_with_answers(spark, d):
    return _entry_columns(_with_answers(materialize(_resolved(spark, d), "resolved")))


@query
def q_history_length(spark, d):
    return C.history_length(_with_answers(materialize(_resolved(spark, d), "resolved")))


@query
def q_history_length_at(spark, d):
    resolved = materialize(_resolved(spark, d), "resolved")
    asked = resolved.select("request_id", "chat_id", "req_no")
    return C.history_length_at(asked, _with_answers(resolved)).select("request_id", "history_length")


# --- chunks ----------------------------------------------------------------------


def _documents(spark, d):
    return inputs.documents(spark, d).select("doc_id", "text")


def _chunks(spark, d):
    return K.chunk_hierarchical(_documents(spark, d))


@query
def q_token_counts(spark, d):
    return K.token_counts(_documents(spark, d)).select("doc_id", long("n_tokens").alias("n_tokens"))


@query
def q_chunk_fixed(spark, d):
    found = K.chunk_fixed(_documents(spark, d), 512)
    spans = [long(c).alias(c) for c in ("chunk_idx", "tok_start", "tok_end")]
    return found.select("doc_id", *spans, "text")


@query
def q_chunk_hierarchical(spark, d):
    docs = inputs.documents(spark, d).select("doc_id", "text", "source")
    spans = [long(c).alias(c) for c in ("level", "chunk_idx", "tok_start", "tok_end")]
    return K.chunk_hierarchical(docs).select("node_id", "doc_id", *spans, "text", "parent_id", "source")


@query
def q_chunk_links(spark, d):
    return _chunks(spark, d).select("node_id", "prev_id", "next_id")


@query
def q_chunk_children(spark, d):
    found = K.children(_chunks(spark, d))
    return found.select(
        "node_id", F.size("children").cast("long").alias("n_children"),
        F.array_join("children", ",").alias("children"),
    )


@query
def q_chunk_stats(spark, d):
    return K.chunk_stats(_chunks(spark, d)).withColumn("level", long("level"))


@query
def q_chunk_dedup(spark, d):
    kept = K.dedupe_texts(_chunks(spark, d))
    return kept.select("node_id", "doc_id", long("level").alias("level"), "text")


# --- embedding, retrieval, citations ---------------------------------------------


def _nonzero(embedded, key):
    return X.numbered_rows(embedded, [key], F.col("embedding"), "dim", "w").where(F.col("w") != 0).select(
        key, long("dim").alias("dim"), F.round(F.col("w").cast("double"), 5).alias("weight")
    )


@query
def q_embed_hash(spark, d):
    return _nonzero(embed_hash(_documents(spark, d)), "doc_id")


embed_model = embedder(hash_model())


@query
def q_embed_model(spark, d):
    return _nonzero(embed_model(_documents(spark, d)), "doc_id")


def _hits(spark, d):
    return N.knn_blocks(inputs.questions(spark, d), inputs.nodes(spark, d))


def _hit_columns(hits):
    return hits.select("query_id", "node_id", "distance", long("rank").alias("rank"))


@query
def q_knn_exact(spark, d):
    return _hit_columns(N.knn_scan(inputs.questions(spark, d), inputs.nodes(spark, d)))


@query
def q_knn_blocks(spark, d):
    return _hit_columns(_hits(spark, d))


@query
def q_knn_cells(spark, d):
    """Every cell probed: exact."""
    return _hit_columns(N.knn_cells(inputs.questions(spark, d), *N.place(inputs.nodes(spark, d)), probes=N.CELLS))


def _probe(spark, d):
    return N.knn_cells(inputs.questions(spark, d), *N.place(inputs.nodes(spark, d)))


@query
def q_knn_probe(spark, d):
    return _hit_columns(_probe(spark, d))


@query
def q_knn_recall(spark, d):
    return N.recall(_probe(spark, d), _hits(spark, d))


@query
def q_knn_scores(spark, d):
    scored = N.with_scores(_hits(spark, d))
    return scored.select("query_id", long("rank").alias("rank"), F.round("score", 6).alias("score"), "score_text")


def _found(spark, d):
    return A.hits_with_metadata(materialize(_hits(spark, d), "hits"), inputs.nodes(spark, d))


@query
def q_hits_with_metadata(spark, d):
    return _found(spark, d).select(
        "query_id", long("rank").alias("rank"), "node_id", "filename", long("page_number").alias("page_number")
    )


@query
def q_hit_previews(spark, d):
    scored = _found(spark, d).withColumn("score", F.when(F.col("rank") < 4, N.score(F.col("distance"))))
    return A.hit_previews(scored).select(
        "query_id", long("rank").alias("rank"), "filename", "page", F.round("score", 6).alias("score"), "preview"
    )


@query
def q_citations(spark, d):
    cited = A.citations(_found(spark, d))
    return cited.select("query_id", F.array_join("citations", " | ").alias("citations"))


@query
def q_source_counts(spark, d):
    return A.citations(_found(spark, d)).select("query_id", "source_nodes_count", "unique_sources_count")


@query
def q_debug_sources(spark, d):
    return A.citations(_found(spark, d)).select("query_id", "sources")


def _answered_questions(spark, d):
    q = F.col("query_id")
    text = F.concat(F.lit("Antwort "), q.cast("string"))
    repeated = F.concat(text, F.lit(" "), F.upper(F.element_at("citations", 1)))
    return A.citations(_found(spark, d)).withColumn(
        "answer", F.when(q % 30 == 0, repeated).otherwise(text)
    )


@query
def q_already_cited(spark, d):
    return _answered_questions(spark, d).select(
        "query_id", A.already_cited(F.col("answer"), F.col("citations")).alias("already_cited")
    )


@query
def q_answer_with_sources(spark, d):
    return _answered_questions(spark, d).select(
        "query_id", A.with_sources(F.col("answer"), F.col("citations")).alias("answer")
    )


@query
def q_context_text(spark, d):
    return A.context_text(_found(spark, d))


@query
def q_prompt(spark, d):
    contexts = A.context_text(_found(spark, d))
    question = F.concat(F.lit("Frage "), F.col("query_id").cast("string"), F.lit("?"))
    return contexts.select("query_id", A.prompt(F.col("context"), question).alias("prompt"))


@query
def q_prompt_truncate(spark, d):
    full = A.prompt(F.col("text"), F.col("lang"))
    docs = inputs.table(spark, d, "documents").select("doc_id", full.alias("full"))
    return docs.select(
        "doc_id", long(F.length("full")).alias("full_length"), A.truncate_prompt(F.col("full")).alias("prompt")
    )


# --- records ---------------------------------------------------------------------


@query
def q_text_preview(spark, d):
    text = F.col("text")
    return inputs.table(spark, d, "documents").select(
        "doc_id",
        long(F.length(text)).alias("n_chars"),
        X.preview(text, 100).alias("preview_100"),
        X.preview(text, 500).alias("preview_500"),
        X.preview_always(X.one_line(text), 70).alias("line_70"),
        X.preview_always(text, 200).alias("always_200"),
    )


@query
def q_url_parts(spark, d):
    url = F.col("url")
    return inputs.table(spark, d, "pages").select(
        "page_id", X.url_host(url).alias("host"), X.url_prefix(url, "?").alias("prefix"),
        X.swap_host(url, "localhost").alias("local_url"),
    )


@query
def q_response_ids(spark, d):
    resolved = _resolved(spark, d).where(F.col("status_code") == 200)
    return resolved.select(
        "request_id", response_id(F.col("chat_id"), F.col("route") == "meta").alias("response_id")
    )


def _created():
    """Epoch seconds of the given requests; a running job uses ``unix_timestamp()``."""
    return F.lit(1700000000).cast("long") + F.col("req_no")


@query
def q_openai_response(spark, d):
    responses = P.respond(_answered(spark, d), _created())
    return responses.select("request_id", F.to_json("response").alias("response"))


@query
def q_ollama_to_internal(spark, d):
    made = from_ollama(inputs.ollama_requests(spark, d))
    older = from_ollama(inputs.ollama_requests(spark, d), use_options=True)
    return made.unionByName(older).select(
        "request_id", "model", "temperature", long("max_tokens").alias("max_tokens"),
        F.size("messages").cast("long").alias("n_messages"), F.try_element_at("messages", F.lit(-1))["content"].alias("last"),
    )


@query
def q_ollama_response(spark, d):
    """Adapter requests through the whole chat job, retrieval and sources included."""
    responses = P.respond(_answered(spark, d, from_ollama(inputs.ollama_requests(spark, d))), _created())
    response, model = F.col("response"), F.col("model")
    at = F.lit("2025-01-01T00:00:00Z")
    return responses.select(
        "request_id",
        F.to_json(ollama_response(response, model)).alias("response"),
        F.to_json(ollama_response_timed(response, model, at, F.col("stream"))).alias("older_response"),
    )


def _document_nodes(spark, d, embed=embed_hash):
    """Chunks of the documents with metadata and vectors."""
    docs = inputs.documents(spark, d).select(
        F.col("doc_id").cast("string").alias("doc_id"),
        "text",
        F.struct(
            F.concat(F.lit("./PDFs/"), "source", F.lit("/doc_"), "doc_id", F.lit(".pdf")).alias("file_path"),
            F.concat(F.lit("./PDFs/"), "source").alias("file_directory"),
            F.concat(F.lit("doc_"), "doc_id", F.lit(".pdf")).alias("filename"),
            F.when(F.col("doc_id") % 7 != 0, (F.col("doc_id") % 12 + 1).cast("int")).alias("page_number"),
        ).alias("metadata"),
    )
    return embed(K.chunk_hierarchical(docs))


def _exact(index):
    """Search that compares each request with every stored node."""
    return lambda queries, k: N.knn_blocks(queries, index.read(), k)


def _answered(spark, d, requests=None):
    """The whole job: documents to an index, requests to cited answers."""
    index = Collection(spark, scratch_path(spark, "answer"), "documents")
    index.rebuild(_document_nodes(spark, d, embed_model))
    requests = inputs.requests(spark, d) if requests is None else requests
    return P.answer_requests(requests, index, embed_model, search=_exact(index))


@query
def q_answer_requests(spark, d):
    return _answered(spark, d).select(
        "request_id", "route", long("status_code").alias("status_code"), "sources", "response_text"
    )


def _audit_columns():
    counts = ("_count", "_length")
    return [long(c).alias(c) if c.endswith(counts) else F.col(c) for c in AUDIT]


@query
def q_debug_records(spark, d):
    return P.audit(_answered(spark, d)).select("request_id", *_audit_columns())


@query
def q_debug_lines(spark, d):
    records = P.audit(_answered(spark, d)).withColumn("logged_at", F.timestamp_seconds(_created()))
    lines = audit_lines(records)
    return lines.select("request_id", long("line_no").alias("line_no"), "line")


def _example_generator():
    def generate(prompt):
        if len(prompt) % 7 == 3:
            raise RuntimeError(f"kein Ergebnis bei {len(prompt)} Zeichen")
        return f"Ergebnis zu {len(prompt)} Zeichen: {prompt[-30:]}"

    return generate


@query
def q_generate(spark, d):
    """Prompts from retrieved passages through the generator hook, errors included."""
    index = _collection(spark, d, embed_model)
    prepared = materialize(P.prepare(inputs.requests(spark, d)).drop("answer"), "prepared")
    found = materialize(P.retrieve(prepared, index, embed_model, search=_exact(index)), "found")
    asked = with_generated(P.prompts(prepared, found), generator_column(_example_generator))
    answered = P.answer(materialize(asked, "generated"), A.citations(found))
    return answered.select(
        "request_id", long(F.length("prompt")).alias("prompt_length"), "route",
        long("status_code").alias("status_code"), "detail", "response_text",
    )


@query
def q_debug_text(spark, d):
    index = _collection(spark, d, embed_model)
    prepared = materialize(P.prepare(inputs.requests(spark, d)), "prepared")
    found = materialize(P.retrieve(prepared, index, embed_model, search=_exact(index)), "found")
    answered = materialize(P.answer(prepared, A.citations(found)), "answered")
    lines = source_lines(N.with_scores(found)).withColumnRenamed("query_id", "request_id")
    records = P.audit(answered).withColumn("logged_at", F.timestamp_seconds(_created()))
    return audit_text(records.join(lines, "request_id", "left"))


@query
def q_log_tail(spark, d):
    lines = logs.parse_lines(inputs.log_lines(spark, d))
    return logs.tail(lines, ["logged_at", "event_id"]).select("event_id", "logged_at", "level", "message")


# --- index -----------------------------------------------------------------------


def _collection(spark, d, embed=embed_hash):
    index = Collection(spark, scratch_path(spark, "index"), "documents")
    index.rebuild(_document_nodes(spark, d, embed))
    return index


def _level_stats(stored):
    return stored.groupBy(long("level").alias("level")).agg(
        F.count(F.lit(1)).alias("n_nodes"), F.countDistinct("node_id").alias("n_ids"),
        F.sum(F.length("text")).alias("n_chars"),
    )


@query
def q_index_rebuild(spark, d):
    index = _collection(spark, d)
    index.rebuild(_document_nodes(spark, d))
    return _level_stats(index.read())


@query
def q_index_add(spark, d):
    index = _collection(spark, d)
    index.add(_document_nodes(spark, d))
    return _level_stats(index.read())


@query
def q_index_add_dedupe(spark, d):
    index = _collection(spark, d)
    index.add(_document_nodes(spark, d), dedupe=True)
    return _level_stats(index.read())


@query
def q_index_delete(spark, d):
    index = _collection(spark, d)
    index.delete_all()
    return index.read().agg(F.count(F.lit(1)).alias("n_nodes"))


@query
def q_index_count(spark, d):
    return _collection(spark, d).read().agg(F.count(F.lit(1)).alias("n_nodes"))


@query
def q_index_reconcile(spark, d):
    """Nodes observed while they were written, against those stored."""
    return _collection(spark, d).reconciled()


@query
def q_index_contents(spark, d):
    """Every stored column after a rebuild, an addition that replaces nothing and a compaction."""
    nodes = materialize(_document_nodes(spark, d), "nodes", CODEC)
    first = F.col("doc_id").cast("long") % 3 == 0
    index = Collection(spark, scratch_path(spark, "index"), "documents")
    index.rebuild(nodes.where(first))
    for batch in ("a", "a", "b"):
        index.add(nodes.where(~first & (F.col("doc_id").cast("long") % 3 == (1 if batch == "a" else 2))), batch=batch)
    discard(nodes)
    index.compact()
    weight = lambda dim, w: F.format_string("%d:%.4f", dim, F.round(w.cast("double"), 4))
    # A node that is stored once has its vector in its row; only those stored more often are gathered by id.
    often = index.read().groupBy("node_id").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("node_id")
    often = index.read().join(materialize(often, "often", CODEC), "node_id", "left_semi")
    shown = X.numbered_rows(often, ["node_id"], F.col("embedding"), "dim", "w").where(F.col("w") != 0)
    joined = F.array_join(F.sort_array(F.collect_list(weight(F.col("dim"), F.col("w")))), " ")
    vectors = materialize(shown.groupBy("node_id").agg(joined.alias("gathered")), "vectors", CODEC)
    own = F.filter(F.transform("embedding", lambda w, dim: F.when(w != 0, weight(dim, w))), lambda w: w.isNotNull())
    own = X.let(own, lambda found: F.when(F.size(found) > 0, F.array_join(F.sort_array(found), " ")))
    return index.read().join(vectors, "node_id", "left").select(
        "node_id", "doc_id", long("level").alias("level"), long("chunk_idx").alias("chunk_idx"), long("tok_start").alias("tok_start"),
        long("tok_end").alias("tok_end"), "text", "parent_id", "prev_id", "next_id", "metadata.file_path", "metadata.file_directory",
        "metadata.filename", long("metadata.page_number").alias("page_number"), F.coalesce("gathered", own).alias("vector"),
    )


@query
def q_index_add_known(spark, d):
    """Additions of known, partly known and new nodes: what the sketches and ids let through."""
    nodes = materialize(_document_nodes(spark, d), "nodes")
    index = Collection(spark, scratch_path(spark, "index"), "documents")
    doc = F.col("doc_id").cast("long")
    index.rebuild(nodes.where(doc % 2 == 0))
    index.add(nodes.where(doc % 3 == 0), dedupe=True)
    known = index.known(nodes.select(F.col("node_id").alias("id")).distinct(), "node")
    kept = nodes.join(known, nodes["node_id"] == known["id"], "left_semi")
    stored = index.read().groupBy("node_id").agg(F.count(F.lit(1)).alias("times"))
    return kept.select("node_id").join(stored, "node_id", "full")


@query
def q_index_fetch(spark, d):
    """The passages that the requests' questions hit, by id, from a rebuild and an addition."""
    nodes = _document_nodes(spark, d, embed_model)
    index = Collection(spark, scratch_path(spark, "index"), "documents")
    later = F.col("doc_id").cast("long") % 3 == 0
    index.rebuild(nodes.where(~later))
    index.add(nodes.where(later))
    prepared = P.prepare(inputs.requests(spark, d)).where(F.col("route") == "retrieval")
    asked = materialize(embed_model(prepared.select(F.col("request_id").alias("query_id"), "question"), "question"), "asked")
    hits = N.knn_blocks(asked, index.read())
    found = index.fetch(hits.select(F.col("node_id").alias("id")))
    return found.select("node_id", "text", "metadata.filename", long("metadata.page_number").alias("page_number"))


def _clustered(spark, d):
    """The vectors, those of one label moved together: (node_id, embedding)."""
    axis = F.transform(F.col("embedding"), lambda x, i: x + F.when(i == F.col("label"), 3.0).otherwise(0.0))
    moved = inputs.table(spark, d, "embeddings").select(F.col("vec_id").cast("string").alias("node_id"), axis.alias("embedding"))
    return moved.withColumn("embedding", F.col("embedding").cast("array<float>"))


@query
def q_knn_trained(spark, d):
    """Trained cells and codes on clustered vectors: recall, and the share of the nodes that a query goes through."""
    nodes = _clustered(spark, d)
    asked = nodes.select(F.col("node_id").alias("query_id"), "embedding")
    model = cells.fit(nodes, cells=24)
    placed = materialize(cells.with_cells(nodes, model), "placed")
    found = N.recall(cells.lookup(asked, placed, model, probes=4), N.knn_blocks(asked, nodes))
    read = cells.share_read(asked, placed, model, probes=4)
    rows = found.select("n_hits", "recall", F.lit(None).cast("double").alias("share"), F.lit(None).cast("long").alias("n_nodes")).unionByName(
        read.select(F.lit(None).cast("long").alias("n_hits"), F.lit(None).cast("double").alias("recall"), "share", "n_nodes")
    )
    one = rows.agg(F.max("n_hits").alias("n_hits"), F.max("n_nodes").alias("n_nodes"), F.max("recall").alias("recall"), F.max("share").alias("share"))
    return one.select("n_hits", "n_nodes", (F.col("recall") >= 0.9).alias("recall_reached"), (F.col("share") <= 0.25).alias("quarter_read"))


@query
def q_build_index(spark, d):
    index = Collection(spark, scratch_path(spark, "index"), "elements")
    index.rebuild(ingest.build_nodes(inputs.document_elements(inputs.documents(spark, d))))
    return _level_stats(index.read())


# --- streams ---------------------------------------------------------------------


def _stream(spark, d, name, files=4):
    """The table as a stream of several files, one per micro-batch."""
    source = inputs.table(spark, d, name)
    folder = scratch_path(spark, f"stream-{name}")
    source.repartition(files).write.parquet(folder)
    return spark.readStream.schema(source.schema).option("maxFilesPerTrigger", 1).parquet(folder)


def _replayed(messages):
    """History entries of a client that sends every turn twice: as it comes and with the next request."""
    sent = F.explode(F.sequence(F.col("turn"), F.col("turn") + 1))
    return messages.select(
        F.col("conv_id").cast("string").alias("chat_id"),
        sent.alias("req_no"),
        F.lit(0).alias("step"),
        F.col("turn").alias("pos"),
        R.normalize_role(F.col("role")).alias("role"),
        F.col("text").alias("content"),
    )


def _stream_entries(spark, d):
    """Replayed messages, and the assistant turns once more as stored answers."""
    turns = _stream(spark, d, "conversations")
    answers = turns.where(F.lower("role") == "assistant").select(
        F.col("conv_id").cast("string").alias("chat_id"), (F.col("turn") - 1).alias("req_no"),
        F.lit(1).alias("step"), F.lit(0).cast("long").alias("pos"), F.lit("assistant").alias("role"),
        F.col("text").alias("content"),
    )
    return _replayed(turns).unionByName(answers)


def _stream_changes(spark, d):
    name = "stream-history"
    return SH.run_history(_stream_entries(spark, d), scratch_path(spark, name), scratch_path(spark, f"{name}-state"))


@query
def q_stream_history(spark, d):
    ordered = SH.ordered_history(_stream_changes(spark, d))
    return ordered.select(
        "chat_id", "req_no", long("step").alias("step"), long("pos").alias("pos"), "role", "content", "place"
    )


@query
def q_stream_sessions(spark, d):
    return SH.session_summary(_stream_changes(spark, d))


@query
def q_stream_ingest(spark, d):
    docs = _stream(spark, d, "documents").select(
        F.concat(F.lit("doc_"), "doc_id", F.lit(".pdf")).alias("file_path"),
        F.lit("./PDFs").alias("file_directory"),
        F.concat(F.lit("doc_"), "doc_id", F.lit(".pdf")).alias("filename"),
        F.lit(0).alias("elem_idx"),
        F.lit(1).alias("page_number"),
        "text",
    )
    index = Collection(spark, scratch_path(spark, "index"), "stream")
    ingest_stream(docs, index, scratch_path(spark, "stream-ingest-state"))
    return _level_stats(index.read())


@query
def q_stream_classify(spark, d):
    conv, turn = F.col("conv_id"), F.col("turn")
    prompts = _stream(spark, d, "conversations").select(
        "conv_id", "turn", inputs.meta_text(conv, turn, F.col("text")).alias("content")
    )
    return run_once(classify(prompts), "stream-classify").drop("content")


@query
def q_stream_live_sessions(spark, d):
    """Length and last user message of each chat from keyed state, no pass over the history."""
    name = "live-sessions"
    changes = SS.run_sessions(_stream_entries(spark, d), scratch_path(spark, name), scratch_path(spark, f"{name}-state"))
    return SS.live_sessions(changes)


@query
def q_stream_arrivals(spark, d):
    """Contents of each chat, first arrivals within a watermark that no row is later than."""
    entries = _stream_entries(spark, d).withColumn("at", F.timestamp_seconds(F.lit(1700000000) + F.col("req_no")))
    name = "arrivals"
    changes = SH.run_arrivals(entries, "at", "3650 days", scratch_path(spark, name), scratch_path(spark, f"{name}-state"))
    return changes.select("chat_id", "content", "answered").distinct()


def _request_lines(spark, d):
    """The requests as JSON lines: some cut off, some with a field of another type, some without an id."""
    conv = F.col("conv_id")
    named = [F.col(f.name) for f in CHAT_REQUEST if f.name != "request_id"]
    identified = F.when(conv % 7 != 5, F.col("request_id")).alias("request_id")
    made = inputs.requests(spark, d).select("conv_id", F.to_json(F.struct(identified, *named)).alias("line"))
    line = F.col("line")
    return made.select(
        F.when(conv % 7 == 3, line.substr(F.lit(1), F.length(line) - 1))
        .when(conv % 7 == 4, F.regexp_replace(line, r'"req_no":(\d+)', '"req_no":"no $1"'))
        .otherwise(line)
        .alias("value")
    )


@query
def q_stream_requests(spark, d):
    """JSON files to resolved requests, and the lines that were set aside."""
    folder, name = scratch_path(spark, "request-lines"), "stream-requests"
    _request_lines(spark, d).write.text(folder)
    requests, quarantine = run_requests(
        stream_lines(spark, folder), scratch_path(spark, name), scratch_path(spark, f"{name}-state")
    )
    kept = requests.select(
        "request_id", "route", long("status_code").alias("status_code"), "question", F.lit(None).cast("string").alias("problem")
    )
    found = F.regexp_extract("line", r'"request_id":"([^"]*)"', 1)
    text = F.lit(None).cast("string")
    return kept.unionByName(
        quarantine.select(
            found.alias("request_id"), text.alias("route"), F.lit(None).cast("long").alias("status_code"),
            text.alias("question"), "problem",
        )
    )


@query
def q_stream_answers(spark, d):
    """The audit records of requests that come in three drops, each run against the stored index and history."""
    index = _collection(spark, d, embed_model)
    asked = materialize(inputs.requests(spark, d), "requests")
    inbox, folder, state = (scratch_path(spark, f"answers-{part}") for part in ("in", "out", "state"))
    n = F.col("req_no")
    for drop in (n <= 1, n.between(2, 4), n > 4):
        asked.where(drop).write.mode("append").parquet(inbox)
        stream = spark.readStream.schema(asked.schema).parquet(inbox)
        answer_stream(stream, index, embed_model, folder, state, F.timestamp_seconds(_created()), search=_exact(index))
    return logs.read_audit(spark, f"{folder}/audit", _audit_schema()).select("request_id", *_audit_columns())


def _audit_schema():
    types = {"meta_confidence": "double", "meta_type": "string", "processing_method": "string"}
    kinds = [f"{c} {types.get(c, 'long' if c.endswith(('_count', '_length')) else 'boolean')}" for c in AUDIT]
    return T.StructType.fromDDL(", ".join(["request_id string", "logged_at timestamp", *kinds]))


@query
def q_audit_log(spark, d):
    """Audit records through the stream's sink, which runs again after its checkpoint is lost."""
    records = P.audit(_answered(spark, d)).withColumn("logged_at", F.timestamp_seconds(_created()))
    schema = _audit_schema()
    inbox, path = scratch_path(spark, "audit-in"), scratch_path(spark, "audit-log")
    records.select(*schema.names).write.parquet(inbox)
    for _ in range(2):
        audit_stream(spark.readStream.schema(schema).parquet(inbox), path, scratch_path(spark, "audit-state"))
    log = logs.read_audit(spark, path, schema)
    return log.select("request_id", F.col("day").cast("string").alias("day"), *_audit_columns())
