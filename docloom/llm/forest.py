"""Approximate nearest neighbours by a forest of hash prefixes."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from docloom.session import materialize

DEPTH = 32
BLOCK = 4096


def _usable(table: DataFrame) -> DataFrame:
    """One row per id with a finite vector that is not zero; the smallest vector of repeated ids."""
    vector = F.col("embedding").cast("array<double>")
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    some = F.exists(vector, lambda x: x != 0)
    rows = table.select(F.col("vec_id").cast("long").alias("vec_id"), vector.alias("v")).where(
        F.col("vec_id").isNotNull() & F.col("embedding").isNotNull() & finite & some
    )
    return rows.groupBy("vec_id").agg(F.min("v").alias("v"))


def _planes(trees: int, size: int, seed: int) -> np.ndarray:
    return np.random.default_rng(seed).standard_normal((size, trees * DEPTH))


def _codes(rows: DataFrame, planes: np.ndarray, cuts: np.ndarray, trees: int) -> DataFrame:
    """``rows`` (id, v) as (id, codes, v): one hash string of DEPTH bits per tree, as a number."""
    name = rows.columns[0]
    weight = (1 << np.arange(DEPTH - 1, -1, -1)).astype(np.int64)
    model = rows.sparkSession.sparkContext.broadcast((planes, cuts))

    def run(batches):
        import pyarrow as pa

        lines, edge = model.value
        for batch in batches:
            for part in (batch.slice(i, 2048) for i in range(0, len(batch), 2048)):
                v = part.column("v").flatten().to_numpy().reshape(len(part), -1)
                bits = (v @ lines > edge).reshape(len(part) * trees, DEPTH)
                codes = pa.array(bits @ weight)
                at = pa.array(np.arange(len(part) + 1) * trees, pa.int32())
                yield pa.RecordBatch.from_arrays(
                    [part.column(name), pa.ListArray.from_arrays(at, codes), part.column("v")], names=[name, "codes", "v"]
                )

    return rows.mapInArrow(run, f"{name} long, codes array<long>, v array<double>")


def _entries(coded: DataFrame, name: str, top: int, *more: str) -> DataFrame:
    """One row per tree: its code and the first ``top`` bits of it."""
    out = coded.select(name, *more, F.posexplode("codes").alias("tree", "code"))
    return out.withColumn("top", F.shiftright("code", DEPTH - top))


def _matrix(table, column: str) -> np.ndarray:
    values = table.column(column).combine_chunks()
    return values.flatten().to_numpy().reshape(len(table), -1) if len(table) else np.zeros((0, 0))


def _range(sorted_codes: np.ndarray, codes: np.ndarray, level) -> tuple[np.ndarray, np.ndarray]:
    """First and last place of the codes that share ``level`` leading bits with each code."""
    rest = DEPTH - level
    low = (codes >> rest) << rest
    return np.searchsorted(sorted_codes, low), np.searchsorted(sorted_codes, low + (1 << rest))


def _grouped(index: DataFrame, queries: DataFrame, what, schema: str) -> DataFrame:
    """``what(index rows, query rows)`` within each tree and prefix, in blocks of bounded size.

    The rows of a crowded prefix are dealt over as many parts as they fill
    blocks, and so are its queries; a part meets every query block once.
    """
    key = ["tree", "top"]
    sizes = index.groupBy(*key).agg(F.count("*").alias("_n"))
    asked = queries.groupBy(*key).agg(F.count("*").alias("_q"))
    parts = sizes.join(asked, key).select(
        *key, F.ceil(F.col("_n") / (4 * BLOCK)).alias("_parts"), F.ceil(F.col("_q") / BLOCK).alias("_blocks")
    )
    parts = materialize(parts, "forest-parts")
    cells = [*key, "_part", "_block"]
    left = index.join(parts, key).withColumns({
        "_part": F.pmod(F.xxhash64("uid"), F.col("_parts")),
        "_block": F.explode(F.sequence(F.lit(0).cast("long"), F.col("_blocks") - 1)),
    }).drop("_parts", "_blocks")
    right = queries.join(parts, key).withColumns({
        "_block": F.pmod(F.xxhash64("query_id"), F.col("_blocks")),
        "_part": F.explode(F.sequence(F.lit(0).cast("long"), F.col("_parts") - 1)),
    }).drop("_parts", "_blocks")
    return left.groupBy(*cells).cogroup(right.groupBy(*cells)).applyInArrow(what, schema)


def _levels(index: DataFrame, queries: DataFrame, top: int, wanted: float) -> DataFrame:
    """(query_id, level): the deepest level at which all trees together hold ``wanted`` rows.

    The cursors of a query go up in step: the count at a level adds up the
    rows of every tree that share so many leading bits with it.
    """

    def count(rows, asked):
        import pyarrow as pa

        codes = np.sort(rows.column("code").to_numpy())
        mine, ids = asked.column("code").to_numpy(), asked.column("query_id").to_numpy()
        out_id, out_level, out_n = [], [], []
        for level in range(top, DEPTH + 1):
            first, last = _range(codes, mine, level)
            hit = last > first
            out_id.append(ids[hit])
            out_level.append(np.full(int(hit.sum()), level, np.int32))
            out_n.append((last - first)[hit])
        arrays = [np.concatenate(x) for x in (out_id, out_level, out_n)]
        return pa.table([pa.array(a) for a in arrays], names=["query_id", "level", "n"])

    narrow = index.select("uid", "tree", "code", "top")
    asked = queries.select("query_id", "tree", "code", "top")
    deep = _grouped(narrow, asked, count, "query_id long, level int, n long")
    counts = deep.groupBy("query_id", "level").agg(F.sum("n").alias("n"))
    if top:
        boxes = index.groupBy("tree", "top").agg(F.count("*").alias("n"))
        upper = boxes.select("tree", "n", "top", F.explode(F.sequence(F.lit(0), F.lit(top - 1))).alias("level"))
        upper = upper.withColumn("prefix", F.expr(f"shiftright(top, {top} - level)"))
        upper = upper.groupBy("tree", "level", "prefix").agg(F.sum("n").alias("n"))
        up = asked.select("query_id", "tree", "top", F.explode(F.sequence(F.lit(0), F.lit(top - 1))).alias("level"))
        up = up.withColumn("prefix", F.expr(f"shiftright(top, {top} - level)"))
        shallow = up.join(upper, ["tree", "level", "prefix"]).groupBy("query_id", "level").agg(F.sum("n").alias("n"))
        counts = counts.unionByName(shallow)
    reached = counts.groupBy("query_id").agg(F.max(F.when(F.col("n") >= wanted, F.col("level"))).alias("level"))
    return reached.select("query_id", F.coalesce("level", F.lit(0)).alias("level"))


def forest_search(
    table: DataFrame,
    queries: DataFrame | None = None,
    k: int = 10,
    trees: int = 24,
    share: float = 1.0,
    fit_rows: int = 20_000,
    seed: int = 41,
) -> DataFrame:
    """Each query's ``k`` nearest rows found: query_id, rank, vec_id, score (Euclidean).

    Every tree keeps its rows sorted by a string of 32 bits: the sides of
    random planes, cut at the median of at most ``fit_rows`` rows. A query
    descends to its longest matching prefixes, then all its cursors go up
    together, level by level, until the trees hold ``share`` times the number
    of rows, and ``k + 1`` for each tree (a row in several trees counts in
    each); all rows below these prefixes are compared exactly. Vectors without structure need ``share``
    near 1 for a recall of 0.9; clustered ones stop deep in their cluster.

    Equal vectors are searched once and carry their ``k + 1`` smallest ids, so
    copies fill no bucket. Null, zero and non-finite vectors, and rows without
    an id, take no part; of a repeated id the smallest vector counts; of
    several vector lengths the most frequent takes part (the longer one on
    ties). An empty table gives no rows; further columns are ignored.
    ``queries`` (vec_id, embedding) defaults to the rows with an id divisible
    by 100; a query is never its own neighbour.
    """
    out = "query_id long, rank int, vec_id long, score double"
    spark = table.sparkSession
    rows = materialize(_usable(table), "forest-vectors")
    lengths = rows.groupBy(F.size("v").alias("n")).count().orderBy(F.desc("count"), F.desc("n")).first()
    if lengths is None:
        return spark.createDataFrame([], out)
    size = lengths["n"]
    rows = rows.where(F.size("v") == size)
    asked = rows.where(F.col("vec_id") % 100 == 0) if queries is None else _usable(queries).where(F.size("v") == size)
    asked = asked.select(F.col("vec_id").alias("query_id"), "v")

    place = F.row_number().over(Window.partitionBy("v").orderBy("vec_id"))
    units = rows.withColumn("_n", place).where(F.col("_n") <= k + 1)
    units = units.groupBy("v").agg(F.array_sort(F.collect_list("vec_id")).alias("ids"))
    units = materialize(units.select(F.monotonically_increasing_id().alias("uid"), "v", "ids"), "forest-units")
    count = units.count()

    sample = rows.orderBy(F.xxhash64("vec_id"), "vec_id").limit(fit_rows).select("v").toArrow()
    planes = _planes(trees, size, seed)
    cuts = np.median(_matrix(sample, "v") @ planes, axis=0)
    top = int(np.clip(np.ceil(np.log2(max(count / BLOCK, 1))), 0, 16))
    index = _entries(materialize(_codes(units.select("uid", "v"), planes, cuts, trees), "forest-codes"), "uid", top, "v")
    coded = materialize(_codes(asked, planes, cuts, trees), "forest-queries")
    probes = _entries(coded, "query_id", top, "v")
    wanted = max(share * count, trees * (k + 1))
    levels = materialize(_levels(index, probes, top, wanted), "forest-levels")

    probes = probes.join(levels, "query_id")
    width = F.greatest(F.lit(top) - F.col("level"), F.lit(0))
    first = F.expr(f"shiftleft(shiftright(top, greatest({top} - level, 0)), greatest({top} - level, 0))")
    last = first + F.expr(f"shiftleft(1L, greatest({top} - level, 0))") - 1
    probes = probes.withColumn("top", F.when(width == 0, F.array("top")).otherwise(F.sequence(first, last)))
    probes = probes.withColumn("top", F.explode("top"))

    def nearest(found, asked_):
        import pyarrow as pa

        order = np.argsort(found.column("code").to_numpy(), kind="stable")
        codes, uid = found.column("code").to_numpy()[order], found.column("uid").to_numpy()[order]
        data, mine = _matrix(found, "v")[order], _matrix(asked_, "v")
        level = asked_.column("level").to_numpy().astype(np.int64)
        lo, hi = _range(codes, asked_.column("code").to_numpy(), level)
        out_query, out_uid, out_d = [], [], []
        for i, query in enumerate(asked_.column("query_id").to_numpy()):
            if hi[i] <= lo[i]:
                continue
            gap = data[lo[i] : hi[i]] - mine[i]
            d = np.einsum("ij,ij->i", gap, gap)
            if len(d) > k + 1:
                best = np.flatnonzero(d <= np.partition(d, k)[k])
            else:
                best = np.arange(len(d))
            out_query += [query] * len(best)
            out_uid.append(uid[lo[i] : hi[i]][best])
            out_d.append(d[best])
        arrays = [np.array(out_query, np.int64), *[np.concatenate(x) if x else np.zeros(0) for x in (out_uid, out_d)]]
        kinds = [pa.int64(), pa.int64(), pa.float64()]
        return pa.table([pa.array(a.astype(t.to_pandas_dtype())) for a, t in zip(arrays, kinds)], names=["query_id", "uid", "d"])

    found = _grouped(index, probes.select("query_id", "tree", "top", "code", "level", "v"), nearest, "query_id long, uid long, d double")
    found = found.groupBy("query_id", "uid").agg(F.min("d").alias("d"))
    named = found.join(units.select("uid", "ids"), "uid").select("query_id", F.explode("ids").alias("vec_id"), F.sqrt("d").alias("score"))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy("score", "vec_id"))
    return named.where("vec_id != query_id").withColumn("rank", rank).where(F.col("rank") <= k).select(
        "query_id", "rank", "vec_id", "score"
    )
