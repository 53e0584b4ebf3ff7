"""Trained cells and product-quantised codes for an approximate nearest-neighbour lookup.

A vector lies in the cell of its nearest centroid and is stored with a code:
what is left of it after the centroid, cut into parts of ``part`` dimensions,
each named by the nearest word of that part's codebook. A lookup goes through
the cells nearest to each query, adds up distances from a table of all words
(``scan_codes``), keeps the best few and computes those exactly. Only ids and
codes of the searched cells are moved, and the vectors of what was kept.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import fixed
from ..session import materialize
from .knn import DECIMALS, _hits_schema, _matrix, _usable, top_k

# Defaults: cells of an index, cells searched per query, candidates computed exactly per query.
CELLS = 16
PROBES = 4
RERANK = 64
# A word stands for this many dimensions; so many words for each part; training rows for each word or cell.
PART = 8
WORDS = 64
FIT_ROWS = 64
# More cells than this are fitted in two levels, the second in tasks.
ONE_LEVEL = 256
STEPS = 6
# Rows per block of codes and of queries.
BLOCK_NODES = 1 << 15
BLOCK_QUERIES = 4096
# Queries whose distances to a block's codes a task holds at once.
QUERIES = 64


def _squared(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    return (x * x).sum(axis=1)[:, None] + (y * y).sum(axis=1)[None, :] - 2.0 * (x @ y.T)


def lloyd(rows: np.ndarray, k: int, steps: int = STEPS) -> np.ndarray:
    """At most ``k`` centroids of the rows.

    They start at rows drawn by their squared distance to those drawn before
    (with a fixed seed, so the same rows give the same centroids). One that
    loses all its rows moves to the row that is farthest from its own centroid.
    """
    draw, start = np.random.default_rng(0), [0]
    gap = ((rows - rows[0]) ** 2).sum(axis=1)
    while len(start) < k and gap.max() > 0:
        total = np.cumsum(gap)
        start.append(int(np.searchsorted(total, draw.random() * total[-1], side="right")))
        gap = np.minimum(gap, ((rows - rows[start[-1]]) ** 2).sum(axis=1))
    centroids = rows[start].copy()
    for _ in range(steps):
        d = _squared(rows, centroids)
        home = d.argmin(axis=1)
        n = np.bincount(home, minlength=len(centroids))
        sums = np.zeros_like(centroids)
        np.add.at(sums, home, rows)
        far = iter(np.argsort(-d[np.arange(len(rows)), home], kind="stable"))
        for c in range(len(centroids)):
            centroids[c] = sums[c] / n[c] if n[c] else rows[next(far)]
    return centroids


class Cells:
    """Centroids and codebooks, as small as their parameters say; sent to tasks as a whole."""

    def __init__(self, centroids: np.ndarray, books: np.ndarray):
        self.centroids = np.asarray(centroids, np.float64)  # cells, dims
        self.books = np.asarray(books, np.float64)  # parts, words, part

    def __len__(self) -> int:
        return len(self.centroids)

    def arrays(self) -> tuple[np.ndarray, np.ndarray]:
        """What is sent to tasks."""
        return self.centroids, self.books

    def distances(self, vectors: np.ndarray) -> np.ndarray:
        """Squared distances to the centroids, rounded as all distances are."""
        return np.rint(np.maximum(_squared(vectors, self.centroids), 0.0) * 10.0**DECIMALS)

    def _parts(self, rest: np.ndarray) -> np.ndarray:
        parts, _, size = self.books.shape
        wide = np.zeros((len(rest), parts * size))
        wide[:, : rest.shape[1]] = rest
        return wide.reshape(len(rest), parts, size)

    def place(self, vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Cell and code of each vector; the first of equally near centroids and words."""
        home = self.distances(vectors).argmin(axis=1)
        rest = self._parts(vectors - self.centroids[home])
        code = np.empty(rest.shape[:2], np.uint8)
        for p, book in enumerate(self.books):
            code[:, p] = _squared(rest[:, p], book).argmin(axis=1)
        return home, code

    def near(self, queries: np.ndarray, cell: int, codes: np.ndarray) -> np.ndarray:
        """The approximate distance of each query to each code, all of one cell: that to what the code stands for."""
        words = np.concatenate([book[codes[:, p]] for p, book in enumerate(self.books)], axis=1)
        rest = self._parts(queries - self.centroids[cell]).reshape(len(queries), -1)
        return np.maximum(_squared(rest, words), 0.0)

    def rows(self, spark: SparkSession) -> DataFrame:
        """The model as a table of (kind, at, word, vector)."""
        out = [("cell", i, 0, v.tolist()) for i, v in enumerate(self.centroids)]
        out += [("word", p, w, v.tolist()) for p, book in enumerate(self.books) for w, v in enumerate(book)]
        return spark.createDataFrame(out, "kind string, at int, word int, vector array<double>").coalesce(1)

    @staticmethod
    def of_rows(table: DataFrame) -> Cells:
        rows = table.orderBy("kind", "at", "word").collect()
        cells = [r["vector"] for r in rows if r["kind"] == "cell"]
        books: dict[int, list] = {}
        for r in rows:
            if r["kind"] == "word":
                books.setdefault(r["at"], []).append(r["vector"])
        return Cells(np.array(cells), np.array([books[p] for p in sorted(books)]))


def _sample(nodes: DataFrame, rows: int, total: int | None) -> DataFrame:
    """About ``rows`` vectors drawn by the hash of their ids, at most that many; in hash order on the driver."""
    usable = _usable(nodes, "node_id").withColumn("_draw", F.xxhash64(F.col("node_id").cast("string"), F.lit(7)))
    if total and total > 2 * rows:
        share = 1.2 * rows / total
        usable = usable.where(F.col("_draw") < F.lit(int(-(1 << 63) + share * (1 << 64))))
    return usable.orderBy("_draw", "node_id").limit(rows)


def _fine(sample: DataFrame, coarse: np.ndarray, cells: int) -> np.ndarray:
    """The cells below each coarse one, fitted in one task each on its share of the bounded sample."""
    each = -(-cells // len(coarse))
    shared = sample.sparkSession.sparkContext.broadcast(coarse)

    @F.pandas_udf("int")
    def home(vectors: pd.Series) -> pd.Series:
        return pd.Series(_squared(_matrix(vectors), shared.value).argmin(axis=1).astype(np.int32))

    def fit(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values(["_draw", "node_id"])
        found = lloyd(_matrix(group["embedding"]), each)
        return pd.DataFrame({"coarse": group["coarse"].iloc[0], "vector": list(found)})

    fitted = sample.withColumn("coarse", home("embedding")).groupBy("coarse").applyInPandas(fit, "coarse int, vector array<double>")
    rows = sorted((r["coarse"], r["vector"]) for r in fitted.collect())
    return np.array([v for _, v in rows])


def fit(
    nodes: DataFrame, cells: int = CELLS, total: int | None = None, part: int = PART, words: int = WORDS, fit_rows: int = FIT_ROWS
) -> Cells | None:
    """Cells and codebooks from a sample of ``fit_rows`` vectors for each cell and word; None without a vector.

    Up to ``ONE_LEVEL`` cells are fitted at once; more are fitted below the
    square root of their number of coarse cells. ``total`` is the number of
    nodes if known, so that not all of them are ranked for the sample.
    """
    two_levels = cells > ONE_LEVEL
    size = fit_rows * max(cells, words)
    sample = _sample(nodes, size, total)
    sample = materialize(sample, "cell-sample") if two_levels else sample
    coarse = int(np.ceil(np.sqrt(cells))) if two_levels else cells
    held = sample.orderBy("_draw", "node_id").limit(fit_rows * max(coarse, words)).toPandas()
    if held.empty:
        return None
    vectors = _matrix(held["embedding"])
    centroids = lloyd(vectors, coarse)
    if two_levels:
        centroids = _fine(sample, centroids, cells)
    home = _squared(vectors, centroids).argmin(axis=1)
    dims = vectors.shape[1]
    parts = -(-dims // part)
    rest = np.zeros((len(vectors), parts * part))
    rest[:, :dims] = vectors - centroids[home]
    books = np.zeros((parts, words, part))
    for p in range(parts):
        found = lloyd(rest[:, p * part : (p + 1) * part], words)
        books[p] = found[np.minimum(np.arange(words), len(found) - 1)]
    return Cells(centroids, books)


def with_cells(nodes: DataFrame, model: Cells | None) -> DataFrame:
    """Add ``cell`` and ``code``; a node without a vector lies in cell 0 without a code."""
    if model is None:
        return nodes.withColumns({"cell": F.lit(0), "code": F.lit(None).cast("binary")})
    shared = nodes.sparkSession.sparkContext.broadcast(model.arrays())

    @F.pandas_udf("cell int, code binary")
    def place(vectors: pd.Series) -> pd.DataFrame:
        out = pd.DataFrame({"cell": np.zeros(len(vectors), np.int32), "code": None})
        some = vectors.notna().to_numpy()
        if some.any():
            home, code = Cells(*shared.value).place(_matrix(vectors[some]))
            out.loc[some, "cell"] = home.astype(np.int32)
            out.loc[some, "code"] = pd.Series([c.tobytes() for c in code], index=out.index[some], dtype=object)
        return out

    placed = nodes.withColumn("_placed", place("embedding"))
    return placed.select(*nodes.columns, "_placed.cell", "_placed.code")


def probed(queries: DataFrame, model: Cells, probes: int = PROBES) -> DataFrame:
    """(query_id, embedding, cell): the ``probes`` cells nearest to each query."""
    count = min(probes, len(model))
    shared = queries.sparkSession.sparkContext.broadcast(model.arrays())

    @F.pandas_udf("array<int>")
    def nearest(vectors: pd.Series) -> pd.Series:
        d = Cells(*shared.value).distances(_matrix(vectors))
        return pd.Series(list(np.argsort(d, axis=1, kind="stable")[:, :count].astype(np.int32)))

    return _usable(queries, "query_id").select("query_id", "embedding", F.explode(nearest("embedding")).alias("cell"))


def _dealt(rows: DataFrame, key: str, own: str, other: str, counts: DataFrame) -> DataFrame:
    """Each row in its own block of its cell, once for every block of the other side."""
    rows = rows.join(counts, "cell").withColumn(own, F.pmod(F.xxhash64(key), F.col(f"n_{own}")))
    return rows.withColumn(other, F.explode(F.sequence(F.lit(0).cast("long"), F.col(f"n_{other}") - 1))).drop("n_qb", "n_nb")


def _best(near: np.ndarray, keep: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``(row, column, value)`` of the ``keep`` smallest values of each row, the first of equal ones."""
    keep = min(keep, near.shape[1])
    limit = np.partition(near, keep - 1, axis=1)[:, keep - 1]
    r, c = np.nonzero(near <= limit[:, None])
    d = near[r, c]
    order = np.lexsort((d, r))  # stable: columns stay in order
    nth = np.arange(len(r)) - np.searchsorted(r, r)  # rows come in order
    order = order[nth < keep]
    return r[order], c[order], d[order]


def scan_codes(asked: DataFrame, placed: DataFrame, model: Cells, keep: int = RERANK) -> DataFrame:
    """(query_id, cell, node_id, near): the ``keep`` codes nearest to each query in the cells it asks for.

    The nodes of a cell and the queries that ask for it are dealt into blocks
    of bounded size, each met by each; the tasks return at most ``keep`` rows
    per query and block.
    """
    nodes = placed.select("node_id", "cell", "code").where(F.col("code").isNotNull())
    blocks = lambda size: F.ceil(F.count(F.lit(1)) / size)
    counts = nodes.groupBy("cell").agg(blocks(BLOCK_NODES).alias("n_nb")).join(
        asked.groupBy("cell").agg(blocks(BLOCK_QUERIES).alias("n_qb")), "cell"
    )
    counts = materialize(counts, "cell-blocks")
    left = _dealt(asked.select("query_id", "embedding", "cell"), "query_id", "qb", "nb", counts)
    right = _dealt(nodes, "node_id", "nb", "qb", counts)
    shared = asked.sparkSession.sparkContext.broadcast(model.arrays())

    def scan(q: pd.DataFrame, n: pd.DataFrame) -> pd.DataFrame:
        if q.empty or n.empty:
            return pd.DataFrame(columns=["query_id", "cell", "node_id", "near"])
        model = Cells(*shared.value)
        n = n.sort_values("node_id", ignore_index=True)
        codes = np.frombuffer(b"".join(n["code"]), np.uint8).reshape(len(n), -1)
        codes, which = np.unique(codes, axis=0, return_inverse=True)
        ids, cell, vectors = n["node_id"].to_numpy(), int(q["cell"].iloc[0]), _matrix(q["embedding"])
        out = []
        for at in range(0, len(q), QUERIES):
            r, c, d = _best(model.near(vectors[at : at + QUERIES], cell, codes)[:, which.ravel()], keep)
            out.append(pd.DataFrame({"query_id": q["query_id"].to_numpy()[at + r], "cell": cell, "node_id": ids[c], "near": d}))
        return pd.concat(out, ignore_index=True)

    schema = T.StructType(
        [
            T.StructField("query_id", asked.schema["query_id"].dataType),
            T.StructField("cell", T.IntegerType()),
            T.StructField("node_id", placed.schema["node_id"].dataType),
            T.StructField("near", T.DoubleType()),
        ]
    )
    keys = ["cell", "qb", "nb"]
    found = left.groupBy(*keys).cogroup(right.groupBy(*keys))
    window = Window.partitionBy("query_id").orderBy("near", "node_id")
    ranked = found.applyInPandas(scan, schema).withColumn("_r", F.row_number().over(window))
    return ranked.where(F.col("_r") <= keep).drop("_r")


def lookup(
    queries: DataFrame, placed: DataFrame, model: Cells | None, k: int = fixed.TOP_K, probes: int = PROBES, rerank: int = RERANK
) -> DataFrame:
    """The k nearest nodes among the ``rerank`` best codes of the ``probes`` cells nearest to each query.

    ``placed`` has ``node_id, embedding, cell, code``. Distances are exact and
    rounded as everywhere; what is approximate is which nodes are compared.
    A query without a vector finds nothing; a node stored twice is one hit.
    """
    if model is None:
        return top_k(queries.sparkSession.createDataFrame([], _hits_schema(queries, placed)), k)
    asked = materialize(probed(queries, model, probes), "cell-asked")
    found = materialize(scan_codes(asked, placed, model, max(k, rerank)), "cell-found")
    vectors = placed.where(F.col("embedding").isNotNull()).select("cell", "node_id", "embedding")
    vectors = vectors.join(found.select("cell", "node_id").distinct(), ["cell", "node_id"], "left_semi").dropDuplicates(["node_id"])
    questions = asked.select("query_id", F.col("embedding").alias("_q")).dropDuplicates(["query_id"])
    pairs = found.select("query_id", "node_id").distinct().join(vectors, "node_id").join(questions, "query_id")

    @F.pandas_udf("double")
    def distance(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series(np.round(((_matrix(a) - _matrix(b)) ** 2).sum(axis=1), DECIMALS))

    hits = pairs.select("query_id", "node_id", distance("_q", "embedding").alias("distance"))
    return top_k(hits, k)


def share_read(queries: DataFrame, placed: DataFrame, model: Cells, probes: int = PROBES) -> DataFrame:
    """``n_nodes, share``: the mean share of the nodes whose codes a query goes through, one row."""
    nodes = placed.where(F.col("code").isNotNull()).groupBy("cell").agg(F.count(F.lit(1)).alias("n"))
    asked = probed(queries, model, probes).groupBy("cell").agg(F.count(F.lit(1)).alias("asked"))
    met = nodes.join(asked, "cell", "left").select("n", (F.coalesce("asked", F.lit(0)) * F.col("n")).alias("met"), F.lit(0).alias("q"))
    count = _usable(queries, "query_id").select(F.lit(0).alias("n"), F.lit(0).alias("met"), F.lit(1).alias("q"))
    sums = met.unionByName(count).agg(F.sum("n").alias("n_nodes"), F.sum("met").alias("met"), F.sum("q").alias("q"))
    return sums.select("n_nodes", (F.col("met") / (F.col("n_nodes") * F.col("q"))).alias("share"))
