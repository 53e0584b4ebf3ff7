"""DuckDB SQL of the operators that SQL can express, written from their contracts."""

from __future__ import annotations

WORD = r"[^\x20\x09-\x0D]+"
GAP = r"[\x20\x09-\x0D]+"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def line_judgement(source: str, max_docs: int = 15, max_share: float = 0.01, min_words: int = 10) -> str:
    """CTEs ending in ``judged``: one row per row of ``source`` with every figure of the line rule."""
    return rf"""
d AS (SELECT row_number() OVER () AS r, * FROM {source}),
w AS (SELECT r, doc_id, coalesce(source, '') AS host, source IS NULL AS no_host, coalesce(text, '') AS text,
    regexp_extract_all(coalesce(text, ''), '{WORD}') AS w,
    list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '{WORD}')) AS l FROM d),
word AS (SELECT r, unnest(w) AS x, generate_subscripts(w, 1) AS i FROM w),
spot AS (SELECT r, i, x || ' ' || lead(x) OVER o || ' ' || lead(x, 2) OVER o || ' ' || lead(x, 3) OVER o || ' ' || lead(x, 4) OVER o AS g
    FROM word WINDOW o AS (PARTITION BY r ORDER BY i)),
gram AS (SELECT r, i, count(*) OVER (PARTITION BY r, g) AS c FROM spot WHERE g IS NOT NULL),
gap AS (SELECT r, least(5, coalesce(lead(i) OVER (PARTITION BY r ORDER BY i), i + 5) - i) AS s FROM gram WHERE c > 1),
rep AS (SELECT r, sum(s)::BIGINT AS n_repeat_words FROM gap GROUP BY r),
line0 AS (SELECT r, host, no_host, unnest(l) AS x FROM w),
line1 AS (SELECT r, host, no_host, trim(regexp_replace(lower(x), '{GAP}', ' ', 'g')) AS x FROM line0),
line AS (SELECT r, host, no_host, x, len(string_split(x, ' ')) AS n FROM line1),
doc AS (SELECT r, host, no_host, list_sort(list(DISTINCT x)) AS own FROM line GROUP BY ALL),
lim AS (SELECT host, no_host, greatest({float(max_docs)}, count(*) * {max_share}) AS lim FROM w GROUP BY ALL),
spread AS (SELECT host, no_host, unnest(own) AS x FROM (SELECT DISTINCT host, no_host, own FROM doc)),
often AS (SELECT host, no_host, x FROM spread JOIN lim USING (host, no_host) GROUP BY host, no_host, x, lim HAVING count(*) > lim),
cut AS (SELECT r, count(*) AS n_removed_lines, sum(line.n)::BIGINT AS n_removed_words, list(DISTINCT x) AS gone
    FROM line JOIN often USING (host, no_host, x) GROUP BY r),
fig AS (SELECT w.r, w.doc_id, len(w)::BIGINT AS n_words, length(array_to_string(w, ''))::BIGINT AS word_chars,
    len(regexp_extract_all(text, '[#*$%&|<>]'))::BIGINT AS n_symbols,
    (len(l) - len(list_distinct(l)))::BIGINT AS n_dup_lines, coalesce(n_repeat_words, 0) AS n_repeat_words,
    coalesce(n_removed_lines, 0) AS n_removed_lines, coalesce(n_removed_words, 0) AS n_removed_words, gone
    FROM w LEFT JOIN rep USING (r) LEFT JOIN cut USING (r)),
base AS (SELECT *, n_words < {min_words} OR 100 * n_repeat_words > 20 * n_words AS base_failed FROM fig),
judged AS (SELECT *, NOT base_failed AND 2 * n_removed_words <= n_words AND n_words - n_removed_words >= {min_words} AS kept FROM base)
"""


OP3 = f"""WITH {line_judgement("documents")}
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_removed_lines, n_removed_words,
    base_failed, kept FROM judged"""


def near(source: str, percent: int = 85) -> str:
    """CTEs ending in ``comp``: component of each document of ``source``."""
    return rf"""
nw AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{UPPER.lower()}'), '{WORD}') AS w FROM {source}),
ns AS (SELECT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
    ELSE list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i+4], ' '))) END) AS s FROM nw),
nc AS (SELECT doc_id, count(*) AS n FROM ns GROUP BY 1),
np AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM ns a JOIN ns b USING (s) WHERE a.doc_id <> b.doc_id GROUP BY 1, 2),
ne AS (SELECT a, b FROM np JOIN nc x ON x.doc_id = a JOIN nc y ON y.doc_id = b WHERE 100 * c >= {percent} * (x.n + y.n - c)),
reach(a, b) AS (SELECT doc_id, doc_id FROM nw UNION SELECT r.a, e.b FROM reach r JOIN ne e ON r.b = e.a),
comp AS (SELECT nw.doc_id, coalesce(n, 0) AS n_shingles, m AS component_id, nw.doc_id = m AS kept
    FROM nw LEFT JOIN nc USING (doc_id) JOIN (SELECT a AS doc_id, min(b) AS m FROM reach GROUP BY 1) USING (doc_id))
"""


OP4 = f"WITH RECURSIVE {near('documents')} SELECT doc_id, n_shingles, component_id, kept FROM comp"



def clustering(k: int = 16, rounds: int = 3) -> str:
    """Plain rounds over all pairs of vectors and centroids."""
    out = [
        """p AS (SELECT vec_id, list_transform(embedding, lambda x: floor(64 * x::DOUBLE)::BIGINT) AS v FROM embeddings
    WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = 64)""",
        f"c0 AS (SELECT row_number() OVER (ORDER BY h) - 1 AS c, v FROM (SELECT sha256('1:' || vec_id) AS h, v FROM p ORDER BY h LIMIT {k}))",
    ]
    for r in range(rounds + 1):
        out.append(f"""d{r} AS (SELECT vec_id, c, p.v, list_sum(list_transform(list_zip(p.v, x.v), lambda z: (z[1] - z[2]) * (z[1] - z[2])))::BIGINT AS d
    FROM p, c{r} x)""")
        out.append(f"a{r} AS (SELECT * FROM d{r} QUALIFY row_number() OVER (PARTITION BY vec_id ORDER BY d, c) = 1)")
        if r < rounds:
            out.append(f"u{r} AS (SELECT c, unnest(v) AS x, generate_subscripts(v, 1) AS i FROM a{r})")
            out.append(f"s{r} AS (SELECT c, i, sum(x) AS s, count(*) AS n FROM u{r} GROUP BY c, i)")
            out.append(f"m{r} AS (SELECT c, list(((s - ((s % n) + n) % n) // n)::BIGINT ORDER BY i) AS v FROM s{r} GROUP BY c)")
            out.append(f"c{r + 1} AS (SELECT c, coalesce(m.v, o.v) AS v FROM c{r} o LEFT JOIN m{r} m USING (c))")
    return "WITH " + ",\n".join(out) + f"""
SELECT vec_id, c::INT AS cluster, d AS distance, (sum(d) OVER (PARTITION BY c))::BIGINT AS cluster_inertia, (sum(d) OVER ())::BIGINT AS inertia,
    sha256(array_to_string(x.v, ',')) AS centroid_sha256 FROM a{rounds} JOIN c{rounds} x USING (c)"""


def repeated_words(window: int = 20) -> str:
    """Every window but the first of its words takes its words away."""
    return rf"""WITH
d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '{WORD}') AS w FROM documents),
starts AS (SELECT doc_id, w, unnest(range(1, len(w) - {window - 2})) AS s FROM d),
win AS (SELECT doc_id, s, array_to_string(w[s:s + {window - 1}], ' ') AS g FROM starts),
again AS (SELECT doc_id, s FROM win QUALIFY row_number() OVER (PARTITION BY g ORDER BY doc_id, s) > 1),
gone AS (SELECT DISTINCT doc_id, unnest(range(s, s + {window})) AS i FROM again),
word AS (SELECT doc_id, unnest(w) AS x, generate_subscripts(w, 1) AS i FROM d),
kept AS (SELECT doc_id, count(*) AS n, string_agg(x, ' ' ORDER BY i) AS t FROM word ANTI JOIN gone USING (doc_id, i) GROUP BY doc_id)
SELECT doc_id, len(w)::BIGINT AS n_words, (len(w) - coalesce(n, 0))::BIGINT AS n_removed, sha256(coalesce(t, '')) AS kept_sha256
FROM d LEFT JOIN kept USING (doc_id)"""


def _levels(name: str, depth: int, fan: int) -> list[str]:
    """CTEs of the levels above ``<name>0`` and of the siblings on each of them."""
    out = []
    for r in range(depth):
        run = f"PARTITION BY seq, pos // {fan} ORDER BY pos ROWS BETWEEN"
        out.append(f"""{name}s{r} AS (SELECT seq, pos,
    coalesce(string_agg(hash, '') OVER ({run} UNBOUNDED PRECEDING AND 1 PRECEDING), '') AS b,
    coalesce(string_agg(hash, '') OVER ({run} 1 FOLLOWING AND UNBOUNDED FOLLOWING), '') AS f FROM {name}{r} WHERE n > 1)""")
        out.append(f"""{name}{r + 1} AS (SELECT seq, pos // {fan} AS pos, n // {fan} + (n % {fan} > 0)::BIGINT AS n, sha256(string_agg(hash, '' ORDER BY pos)) AS hash
    FROM {name}{r} WHERE n > 1 GROUP BY ALL)""")
    ends = " UNION ALL ".join(f"SELECT seq, hash FROM {name}{r} WHERE n = 1" for r in range(depth + 1))
    return [*out, f"{name}_end AS ({ends})"]


def _walk(name: str, state: str, depth: int, fan: int) -> list[str]:
    """CTEs that take (seq, pos, proof, fold) of ``<state>0`` up all levels."""
    return [
        f"""{state}{r + 1} AS (SELECT x.* REPLACE (x.pos // {fan} AS pos, proof || coalesce(b || f, '') AS proof,
    CASE WHEN b IS NULL THEN fold ELSE sha256(b || fold || f) END AS fold) FROM {state}{r} x LEFT JOIN {name}s{r} USING (seq, pos))"""
        for r in range(depth)
    ]


def merkle(fan: int = 16, depth: int = 6, top: int = 4) -> str:
    """Trees of ``depth`` levels for the sources and ``top`` levels above them."""

    def shown(text: str) -> str:
        fields = ("doc_id", "source", "lang", "n_chars", text)
        return "sha256(" + " || ".join(f"coalesce(strlen({f}::VARCHAR) || ':' || {f}::VARCHAR, '-')" for f in fields) + ")"

    crc = """xor(list_reduce(list_prepend(4294967295, list_transform(string_split(doc_id::VARCHAR, ''), lambda c: ascii(c)::BIGINT)),
        lambda a, b: list_reduce([xor(a, b), 0, 0, 0, 0, 0, 0, 0, 0], lambda x, y: xor(x >> 1, (x & 1) * 3988292384))), 4294967295)"""
    lower = f"translate(text, '{UPPER}', '{UPPER.lower()}')"
    out = [
        f"""leaf AS (SELECT doc_id, coalesce(':' || source, '') AS seq, {shown('text')} AS hash,
    CASE WHEN {crc} % 5 = 0 THEN {shown(lower)} ELSE {shown('text')} END AS now FROM documents)""",
        """l0 AS (SELECT *, row_number() OVER (PARTITION BY seq ORDER BY doc_id NULLS FIRST, hash) - 1 AS pos, count(*) OVER (PARTITION BY seq) AS n FROM leaf)""",
        *_levels("l", depth, fan),
        "t0 AS (SELECT '' AS seq, seq AS source, row_number() OVER (ORDER BY seq) - 1 AS pos, count(*) OVER () AS n, hash FROM l_end)",
        *_levels("t", top, fan),
        "v0 AS (SELECT doc_id, seq, pos, hash AS leaf, '' AS proof, now AS fold FROM l0)",
        *_walk("l", "v", depth, fan),
        f"""w0 AS (SELECT doc_id, '' AS seq, t0.pos, leaf, proof, fold, t0.hash AS subroot, t_end.hash AS root
    FROM v{depth} v JOIN t0 ON t0.source = v.seq, t_end)""",
        *_walk("t", "w", top, fan),
    ]
    return "WITH " + ",\n".join(out) + f"""
SELECT doc_id, leaf, subroot, root, sha256(proof) AS proof_sha256, fold AS folded_root, fold = root AS verified FROM w{top}"""


ORACLES = {
    "op3_line_quality": OP3,
    "op4_minmax_near_duplicates": OP4,
    "op11_heap_bounds": clustering(),
    "op12_block_anchors": repeated_words(),
    "op13_merkle_manifest": merkle(),
}
