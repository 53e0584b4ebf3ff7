"""k nearest nodes per query by squared Euclidean distance.

Distances are rounded to 6 decimals and ties go to the smaller node id, so
every way of computing the result gives the same rows. The caller chooses by
name; nothing is switched by size.

``knn_scan``    Exact, for a query set that the caller knows to be small: it goes
                to every task as one matrix. A first pass over a share of the
                nodes bounds each query's k-th distance, so that the tasks of
                the second pass return only rows within that bound.
``knn_blocks``  Exact, for query sets of any size: queries and nodes are dealt
                into large blocks and every query block meets every node block.
                What is moved are compressed packs of rows, not rows; a task
                holds its two blocks, compares equal vectors once and goes
                through the nodes in id order.
``knn_cells``   Approximate: a node lies in the cell of its nearest pivot, and a
                query searches the cells of its nearest pivots. An index stores
                the cells (``docloom.sources.index``), so a lookup reads only
                those that are probed.

None emits pairs: a task returns at most k hits per query it was given.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import fixed
from ..session import materialize

DECIMALS = 6
# Largest query matrix that ``knn_scan`` accepts.
SCAN_BYTES = 64 << 20
# Defaults of the stored cells: their number, and how many a lookup searches.
CELLS = 16
PROBES = 14
# One node in so many is read for the first bound of ``knn_scan``.
SAMPLE = 16
# Rows per block, and numbers per block where vectors are long. Large blocks, since a
# query goes to every block of nodes and a node to every block of queries.
BLOCK_NODES, NODE_VALUES = 1 << 19, 1 << 25
BLOCK_QUERIES, QUERY_VALUES = 1 << 18, 1 << 24
# Fewer pairs than this are not dealt to more tasks.
TASK_PAIRS = 1 << 28
# Distances held at once while a task compares a query matrix with a batch of nodes (``_nearest``).
TILE = 4 << 20
# Queries and nodes compared at once while a task goes through its nodes (``_Nearest``); hits in an output batch.
SIDE = 1024
HITS = 1 << 16
# Bytes of rows that a task gathers before it packs them by block.
PACK_BYTES = 32 << 20


def top_k(hits: DataFrame, k: int) -> DataFrame:
    """Rank hits per query and keep the first k (cut on the map side by the group limit)."""
    w = Window.partitionBy("query_id").orderBy("distance", "node_id")
    return hits.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def score(distance: Column) -> Column:
    return F.exp(-distance)


def with_scores(hits: DataFrame) -> DataFrame:
    return hits.withColumn("score", score(F.col("distance"))).withColumn(
        "score_text", F.format_number("score", 4)
    )


def _matrix(vectors: pd.Series) -> np.ndarray:
    return np.stack(vectors.to_numpy()).astype(np.float64)


def _nearest(q: np.ndarray, n: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``(query row, node row, distance)`` of the k nearest node rows per query row.

    Node rows are in node-id order, and ``argmin`` takes the first of equal
    values, so a tie goes to the smaller id however many nodes tie.
    """
    unit = 10.0**DECIMALS
    k = min(k, len(n))
    cols = np.empty((len(q), k), dtype=np.int64)
    dist = np.empty((len(q), k))
    n_sq = (n * n).sum(axis=1) * unit
    step = max(1, TILE // max(1, len(n)))
    for at in range(0, len(q), step):
        part = q[at : at + step]
        rows = np.arange(len(part))
        d = part @ (n.T * (-2.0 * unit))
        d += n_sq[None, :]
        d += (part * part).sum(axis=1)[:, None] * unit
        np.maximum(np.rint(d, out=d), 0.0, out=d)
        for j in range(k):
            c = d.argmin(axis=1)
            cols[at : at + step, j] = c
            dist[at : at + step, j] = d[rows, c]
            d[rows, c] = np.inf
    return np.repeat(np.arange(len(q)), k), cols.ravel(), dist.ravel() / unit


def _places(flags: np.ndarray) -> np.ndarray:
    """Where few flags are set, looked for eight at a time."""
    whole = len(flags) // 8 * 8
    some = np.flatnonzero(flags[:whole].view(np.uint64))
    which, bit = np.nonzero(flags[:whole].reshape(-1, 8)[some])
    return np.concatenate([some[which] * 8 + bit, whole + np.flatnonzero(flags[whole:])])


class _Nearest:
    """The k nearest nodes so far of each query, for nodes that come in id order.

    Single precision, with a margin for its error, finds the few pairs that may
    be nearer than a query's k-th; only those are computed in double precision.
    Of equally near nodes the one that came first stays.
    """

    def __init__(self, queries: np.ndarray, k: int):
        self.queries, self.k, self.seen = queries, k, 0
        self.single = queries.astype(np.float32, copy=False)
        self.square = np.einsum("ij,ij->i", queries, queries, dtype=np.float64)
        self.distance = np.full((len(queries), k), np.inf)  # rounded, in units of the last decimal
        self.node = np.full((len(queries), k), -1, np.int64)
        self.room = np.empty(SIDE * SIDE, np.float32), np.empty(SIDE * SIDE, bool)  # written again for every tile

    def add(self, nodes: np.ndarray) -> None:
        for at in range(0, len(nodes), SIDE):
            some = nodes[at : at + SIDE].astype(np.float64)
            self._first(some) if not self.seen else self._more(some)
            self.seen += len(some)

    def _first(self, nodes: np.ndarray) -> None:
        for at in range(0, len(self.queries), SIDE):
            part = self.queries[at : at + SIDE].astype(np.float64)
            r, c, d = _nearest(part, nodes, self.k)
            found = len(c) // len(part)
            self.node[at : at + SIDE, :found] = c.reshape(len(part), found)
            self.distance[at : at + SIDE, :found] = np.rint(d * 10.0**DECIMALS).reshape(len(part), found)

    def _more(self, nodes: np.ndarray) -> None:
        unit, error = 10.0**DECIMALS, (nodes.shape[1] + 8) * 2.0**-23
        square = np.einsum("ij,ij->i", nodes, nodes)
        right = (nodes.T * -2.0).astype(np.float32)
        plus = square.astype(np.float32)
        longest = np.sqrt(square.max(initial=0.0))
        for at in range(0, len(self.queries), SIDE):
            own = self.square[at : at + SIDE]
            limit = self.distance[at : at + SIDE, -1] / unit
            limit = limit - own + error * ((np.sqrt(own) + longest) ** 2 + limit + 1.0 / unit)
            d, near = (room[: len(own) * len(nodes)].reshape(len(own), len(nodes)) for room in self.room)
            np.matmul(self.single[at : at + SIDE], right, out=d)
            d += plus
            np.greater_equal(d, limit.astype(np.float32)[:, None], out=near)
            hit = _places(np.logical_not(near, out=near).ravel())
            if len(hit):
                r, c = np.divmod(hit, len(nodes))
                self._merge(at + r, c, nodes, square)

    def _merge(self, r: np.ndarray, c: np.ndarray, nodes: np.ndarray, square: np.ndarray) -> None:
        unit = 10.0**DECIMALS
        d = np.einsum("ij,ij->i", self.queries[r], nodes[c], dtype=np.float64)
        d = np.maximum(np.rint((square[c] + self.square[r] - 2.0 * d) * unit), 0.0)
        nearer = d < self.distance[r, -1]
        r, c, d = r[nearer], c[nearer], d[nearer]
        if not len(r):
            return
        rows = np.unique(r)
        whose = np.concatenate([np.repeat(rows, self.k), r])
        d = np.concatenate([self.distance[rows].ravel(), d])
        node = np.concatenate([self.node[rows].ravel(), self.seen + c])
        order = np.lexsort((d, whose))  # stable: those before stay before
        best = order[np.searchsorted(whose[order], rows)[:, None] + np.arange(self.k)]
        self.distance[rows], self.node[rows] = d[best], node[best]

    def hits(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """``(query row, node by number, distance)``."""
        r, j = np.nonzero(self.node >= 0)
        return r, self.node[r, j], self.distance[r, j] / 10.0**DECIMALS


class _Alike:
    """Rows of equal vectors as groups, numbered by their first rows; rows of a group in order.

    Rows are compared by the bits of their vectors, those with equal sums of
    these first: two groups of one vector, should sums collide, change no result.
    """

    def __init__(self, vectors: np.ndarray, rank: np.ndarray):
        bits = vectors.view(f"u{vectors.itemsize}")
        key = np.zeros(len(bits), np.uint64)
        for j in range(bits.shape[1]):
            key *= np.uint64(0x9E3779B97F4A7C15)
            key += bits[:, j]
            key ^= key >> np.uint64(29)
        order = np.lexsort((rank, key))
        first = np.ones(len(order), bool)
        same = np.flatnonzero(key[order[1:]] == key[order[:-1]])
        for at in range(0, len(same), HITS):
            some = same[at : at + HITS]
            first[some + 1] = (bits[order[some + 1]] != bits[order[some]]).any(axis=1)
        starts = np.flatnonzero(first)
        by = np.argsort(rank[order[starts]])
        self.rows = order
        self.starts, self.counts = starts[by], np.diff([*starts, len(order)])[by]
        self.heads = order[self.starts]

    def expand(self, groups: np.ndarray, most: int | None = None) -> tuple[np.ndarray, np.ndarray]:
        """``(place in groups, row)`` of the first ``most`` rows of each of the groups."""
        n = self.counts[groups] if most is None else np.minimum(self.counts[groups], most)
        place = np.repeat(np.arange(len(groups)), n)
        within = np.arange(len(place)) - np.repeat(np.cumsum(n) - n, n)
        return place, self.rows[self.starts[groups][place] + within]


def _id_ranks(ids: pa.Array) -> np.ndarray:
    """The place of each id in their order, those without one first."""
    order = pa.compute.sort_indices(ids, null_placement="at_start").to_numpy()
    rank = np.empty(len(order), np.int64)
    rank[order] = np.arange(len(order))
    return rank


def _block_hits(askers: pa.Array, queries: np.ndarray, ids: pa.Array, vectors: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``(query row, node row, distance)`` of the k nearest nodes per query, ties to the smaller id.

    Equal vectors are compared once. The k nearest nodes lie in the k nearest
    groups of equal ones, ties to the group whose smallest id is smaller.
    """
    rank = _id_ranks(ids)
    asked, alike = _Alike(queries, np.arange(len(askers))), _Alike(vectors, rank)
    best = _Nearest(queries[asked.heads], k)
    for at in range(0, len(alike.heads), SIDE):
        best.add(vectors[alike.heads[at : at + SIDE]])
    r, c, d = best.hits()
    place, node = alike.expand(c, k)
    r, d = r[place], d[place]
    order = np.lexsort((rank[node], d, r))
    r, node, d = r[order], node[order], d[order]
    nth = np.arange(len(r)) - np.searchsorted(r, r)
    kept = nth < k
    r, node, d = r[kept], node[kept], d[kept]
    first, many = np.searchsorted(r, np.arange(len(asked.heads))), np.bincount(r, minlength=len(asked.heads))
    place, query = asked.expand(np.arange(len(asked.heads)))
    n = many[place]
    at = np.repeat(first[place] - (np.cumsum(n) - n), n) + np.arange(n.sum())
    return np.repeat(query, n), node[at], d[at]


def _hits_schema(queries: DataFrame, nodes: DataFrame) -> T.StructType:
    return T.StructType(
        [
            T.StructField("query_id", queries.schema["query_id"].dataType),
            T.StructField("node_id", nodes.schema["node_id"].dataType),
            T.StructField("distance", T.DoubleType()),
        ]
    )


def _usable(vectors: DataFrame, key: str) -> DataFrame:
    """Rows with a vector; a NULL vector is near nothing."""
    return vectors.select(key, "embedding").where(F.col("embedding").isNotNull())


def _scan(queries: pd.DataFrame, nodes: DataFrame, schema: T.StructType, k: int, bound: np.ndarray) -> DataFrame:
    """At most k hits per query and task, none beyond the query's bound."""
    ids, matrix = queries["query_id"].to_numpy(), _matrix(queries["embedding"])
    shared = nodes.sparkSession.sparkContext.broadcast((ids, matrix, bound))

    def local(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        ids, matrix, bound = shared.value
        best = None
        for batch in batches:
            if batch.empty:
                continue
            batch = batch.sort_values("node_id", ignore_index=True)
            r, c, d = _nearest(matrix, _matrix(batch["embedding"]), k)
            near = d <= bound[r]
            found = pd.DataFrame({"r": r[near], "node_id": batch["node_id"].to_numpy()[c[near]], "distance": d[near]})
            if best is not None:
                found = pd.concat([best, found], ignore_index=True)
                found = found.sort_values(["r", "distance", "node_id"]).groupby("r").head(k)
            best = found
        if best is not None:
            best["query_id"] = ids[best["r"].to_numpy()]
            yield best[["query_id", "node_id", "distance"]]

    return nodes.mapInPandas(local, schema)


def knn_scan(queries: DataFrame, nodes: DataFrame, k: int = fixed.TOP_K, sample: int = SAMPLE) -> DataFrame:
    """Exact ``query_id, node_id, distance, rank`` for a small query set.

    More vectors than fit ``SCAN_BYTES`` are an error, not another algorithm.
    One node in ``sample``, drawn by the hash of its id, is searched first;
    its k-th distance bounds what the tasks of the whole search return: about
    ``sample`` times k rows per query together, however many tasks there are.
    """
    schema = _hits_schema(queries, nodes)
    queries, nodes = _usable(queries, "query_id"), _usable(nodes, "node_id")
    first = queries.head()
    if first is None:
        return top_k(nodes.sparkSession.createDataFrame([], schema), k)
    allowed = max(1, SCAN_BYTES // (8 * len(first["embedding"])))
    small = queries.limit(allowed + 1).toPandas()
    if len(small) > allowed:
        raise ValueError(f"more than {allowed} queries: use knn_blocks or knn_cells")
    draw = F.conv(F.substring(F.md5(F.col("node_id").cast("string")), 1, 8), 16, 10).cast("long") % sample
    anything = np.full(len(small), np.inf)
    seen = top_k(_scan(small, nodes.where(draw == 0), schema, k, anything), k)
    kth = seen.where(F.col("rank") == k).select("query_id", "distance").toPandas()
    bound = small["query_id"].map(dict(zip(kth["query_id"], kth["distance"]))).fillna(np.inf).to_numpy(dtype=float)
    return top_k(_scan(small, nodes, schema, k, bound), k)


def knn_blocks(queries: DataFrame, nodes: DataFrame, k: int = fixed.TOP_K) -> DataFrame:
    """Exact, for query sets of any size: all blocks of queries against all blocks of nodes.

    The number of blocks follows from the counts; it decides how the work is
    dealt, not what comes out.
    """
    schema = _hits_schema(queries, nodes)
    one = F.lit(0).alias("cell")
    queries, nodes = _usable(queries, "query_id"), _usable(nodes, "node_id")
    found = _join_cells(queries.select("*", one), nodes.select("*", one), schema, k)
    return top_k(found, k)


def pivots(nodes: DataFrame, cells: int = CELLS) -> np.ndarray:
    """Vectors of the ``cells`` nodes with the smallest id hashes, each once, in order."""
    rows = (
        _usable(nodes, "node_id")
        .orderBy(F.md5(F.col("node_id").cast("string")), "node_id")
        .limit(cells)
        .toPandas()
    )
    return np.unique(_matrix(rows["embedding"]), axis=0) if len(rows) else np.zeros((0, 0))


def _distances(vectors: pd.Series, anchors: np.ndarray) -> np.ndarray:
    """Squared distances to the anchors, rounded as all distances are."""
    v = _matrix(vectors)
    d = (v * v).sum(axis=1)[:, None] + (anchors * anchors).sum(axis=1)[None, :] - 2.0 * (v @ anchors.T)
    return np.rint(np.maximum(d, 0.0) * 10.0**DECIMALS)


def cell_column(anchors: np.ndarray, embedding: str = "embedding") -> Column:
    """The number of the nearest anchor, the first of equally near ones; 0 without a vector."""

    @F.pandas_udf("int")
    def home(vectors: pd.Series) -> pd.Series:
        out = np.zeros(len(vectors), dtype=np.int32)
        some = vectors.notna().to_numpy()
        if some.any() and len(anchors):
            out[some] = _distances(vectors[some], anchors).argmin(axis=1)
        return pd.Series(out)

    return home(embedding)


def _probed(anchors: np.ndarray, probes: int):
    count = min(probes, len(anchors))

    @F.pandas_udf("array<int>")
    def nearest_cells(vectors: pd.Series) -> pd.Series:
        d = _distances(vectors, anchors)
        return pd.Series(list(np.argsort(d, axis=1, kind="stable")[:, :count].astype(np.int32)))

    return nearest_cells("embedding")


def _counts(df: DataFrame) -> dict[int, tuple[int, int]]:
    """Rows and longest vector per cell: one row for each."""
    rows = df.groupBy("cell").agg(F.count(F.lit(1)).alias("n"), F.max(F.size("embedding")).alias("dims")).collect()
    return {r["cell"]: (r["n"], r["dims"]) for r in rows}


def _grid(queries: dict[int, tuple[int, int]], nodes: dict[int, tuple[int, int]], cores: int) -> dict[int, tuple[int, int, int]]:
    """For every cell: its blocks of queries and of nodes, and the number of its first group.

    Blocks are as large as a task may hold; nodes are dealt into more only
    while there are too few groups for the cores.
    """
    out, groups = {}, 0
    for cell in sorted(queries.keys() & nodes.keys()):
        (n_q, dims), (n_n, _) = queries[cell], nodes[cell]
        a = -(-n_q // max(1, min(BLOCK_QUERIES, QUERY_VALUES // max(1, dims))))
        b = -(-n_n // max(1, min(BLOCK_NODES, NODE_VALUES // max(1, dims))))
        b = max(b, min(-(-cores // a), n_q * n_n // (a * TASK_PAIRS)))
        out[cell] = (a, b, groups)
        groups += a * b
    return out


def _per_cell(values: dict[int, int], cell: Column) -> Column:
    """A lookup over one literal per cell."""
    return F.try_element_at(F.array(*[F.lit(values.get(c)).cast("long") for c in range(max(values) + 1)]), cell + 1)


def _firsts(part: pa.Table, k: int) -> pa.Table:
    """The rows of a block without those that k equal vectors of smaller ids precede: they are no query's hits."""
    vectors, ids = _vectors(part.column(1)), part.column(0).chunk(0)
    alike = _Alike(vectors, np.arange(len(ids)))
    if alike.counts.max() <= k:
        return part
    alike = _Alike(vectors, _id_ranks(ids))
    return part.take(pa.array(np.sort(alike.expand(np.arange(len(alike.heads)), k)[1]))).combine_chunks()


def _vectors(column: pa.ChunkedArray) -> np.ndarray:
    return column.chunk(0).flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def _packed(rows: DataFrame, key: str, k: int | None = None) -> DataFrame:
    """``cell, block, n, rows``: ids (``key``) and vectors of the rows of a block that a task has, compressed together.

    With ``k`` a task sends at most so many rows of equal vectors to a block.
    """

    def pack(table: pa.Table) -> pa.RecordBatch:
        own = np.stack([table["cell"].to_numpy(), table["block"].to_numpy()])
        order = np.lexsort((own[1], own[0]))
        own, table = own[:, order], table.select([key, "embedding"]).take(pa.array(order)).combine_chunks()
        starts = [0, *(np.flatnonzero((own[:, 1:] != own[:, :-1]).any(axis=0)) + 1).tolist()]
        n, packs = [], []
        for start, end in zip(starts, [*starts[1:], len(order)]):
            part = table.slice(start, end - start)
            part = part if k is None else _firsts(part, k)
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, table.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
                out.write_table(part)
            n.append(len(part))
            packs.append(sink.getvalue().to_pybytes())
        columns = [pa.array(own[0, starts], pa.int32()), pa.array(own[1, starts], pa.int64()), pa.array(n, pa.int64()), pa.array(packs, pa.binary())]
        return pa.record_batch(columns, names=["cell", "block", "n", "rows"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            if batch.num_rows:
                held.append(batch)
                size += batch.nbytes
            if size >= PACK_BYTES:
                yield pack(pa.Table.from_batches(held))
                held, size = [], 0
        if held:
            yield pack(pa.Table.from_batches(held))

    return rows.mapInArrow(run, "cell int, block long, n long, rows binary")


def _unpacked(packs: list[tuple[int, bytes]]) -> tuple[pa.Array, np.ndarray]:
    """The ids and the vectors of packs of the given numbers of rows; each pack goes as it is opened."""
    ids, vectors, at = [], None, sum(n for n, _ in packs)
    while packs:
        n, pack = packs.pop()
        table = pa.ipc.open_stream(pack).read_all().combine_chunks()
        column = _vectors(table["embedding"])
        if vectors is None:
            vectors = np.empty((at, column.shape[1]), column.dtype)
        at -= n
        vectors[at : at + n] = column
        ids.append(table.column(0).chunk(0))
    return pa.concat_arrays(ids[::-1]), vectors


def _join_cells(probes: DataFrame, placed: DataFrame, schema: T.StructType, k: int) -> DataFrame:
    """k hits per query and block of nodes, for every (query, cell) in ``probes``.

    Only probed cells are read. A cell of b node blocks and a query blocks
    gives a*b groups, one partition each, to which packs of rows are sent:
    first those of the queries, then those of the nodes. Nodes are dealt by their
    vectors, so that equal ones meet in one block and are compared once; a task
    sends at most k of them, so that a frequent vector makes no large block.
    """
    cell = F.col("cell")
    query_counts = _counts(probes)
    placed = placed.where(cell.isin(list(query_counts)) if query_counts else F.lit(False))
    grid = _grid(query_counts, _counts(placed), probes.sparkSession.sparkContext.defaultParallelism)
    if not grid:
        return probes.sparkSession.createDataFrame([], schema)
    a, b, first = (_per_cell({c: g[i] for c, g in grid.items()}, cell) for i in range(3))
    probes = probes.where(cell.isin(list(grid)))
    qb, nb = F.pmod(F.xxhash64("query_id"), a), F.pmod(F.xxhash64("embedding"), b)
    block = F.col("block")
    left = _packed(probes.select("query_id", "embedding", "cell", qb.alias("block")), "query_id").select("n", "rows", F.explode(
        F.transform(F.sequence(F.lit(0).cast("long"), b - 1), lambda x: (first + block * b + x).cast("int"))).alias("group"))
    right = _packed(placed.select("node_id", "embedding", "cell", nb.alias("block")), "node_id", k).select("n", "rows", F.explode(
        F.transform(F.sequence(F.lit(0).cast("long"), a - 1), lambda x: (first + x * b + block).cast("int"))).alias("group"))
    both = left.withColumn("side", F.lit(0)).unionByName(right.withColumn("side", F.lit(1)))
    groups = sum(g[0] * g[1] for g in grid.values())
    dealt = both.repartitionById(groups, F.col("group")).sortWithinPartitions("group", "side")

    def hits(asked: list[tuple[int, bytes]], nodes: list[tuple[int, bytes]]) -> Iterator[pa.RecordBatch]:
        if not asked or not nodes:
            return
        (askers, queries), (ids, vectors) = _unpacked(asked), _unpacked(nodes)
        r, c, d = _block_hits(askers, queries, ids, vectors, k)
        for at in range(0, len(r), HITS):
            part = slice(at, at + HITS)
            yield pa.record_batch([askers.take(pa.array(r[part])), ids.take(pa.array(c[part])), pa.array(d[part])], names=schema.names)

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, packs = None, ([], [])
        for batch in batches:
            for key, side, n, rows in zip(*[batch[c].to_pylist() for c in ("group", "side", "n", "rows")]):
                if key != group:
                    yield from hits(*packs)
                    group, packs = key, ([], [])
                packs[side].append((n, rows))
        yield from hits(*packs)

    return dealt.mapInArrow(compare, schema)


def knn_cells(
    queries: DataFrame, placed: DataFrame, anchors: np.ndarray, k: int = fixed.TOP_K, probes: int = PROBES
) -> DataFrame:
    """The k nearest nodes in the ``probes`` cells with the nearest anchors; exact when these are all.

    ``placed`` has ``node_id, embedding, cell``; where it is partitioned by
    cell, only the probed partitions are read.
    """
    schema = _hits_schema(queries, placed)
    queries = _usable(queries, "query_id")
    if not len(anchors):
        return top_k(queries.sparkSession.createDataFrame([], schema), k)
    probed = queries.select("query_id", "embedding", F.explode(_probed(anchors, probes)).alias("cell"))
    nodes = placed.select("node_id", "embedding", "cell").where(F.col("embedding").isNotNull())
    return top_k(_join_cells(materialize(probed, "knn-probes"), nodes, schema, k), k)


def place(nodes: DataFrame, cells: int = CELLS) -> tuple[DataFrame, np.ndarray]:
    """Nodes with their cells, written once, and the anchors: an index in one call."""
    anchors = pivots(nodes, cells)
    placed = nodes.select("node_id", "embedding").withColumn("cell", cell_column(anchors))
    return materialize(placed, "knn-nodes"), anchors


def recall(approximate: DataFrame, exact: DataFrame) -> DataFrame:
    """Share of the exact hits that the approximate result holds, one row."""
    found = approximate.select("query_id", "node_id", F.lit(1).alias("found"))
    return exact.join(found, ["query_id", "node_id"], "left").agg(
        F.count(F.lit(1)).alias("n_hits"), F.avg(F.coalesce("found", F.lit(0))).alias("recall")
    )
