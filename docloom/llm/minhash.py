"""Near-duplicate documents: min-max hashing, banding, exact confirmation."""

from __future__ import annotations

import hashlib

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docloom.llm.graph import extended, stars
from docloom.llm.text import GOLDEN, byte_slices, mix, random_words, shingle_set, string_buffers, word_hashes
from docloom.session import materialize

BLOCK = 2048
# Sets compared in one task.
CELL = 1024


def min_max(shingles: np.ndarray, permutations: int, seed: int = 21) -> np.ndarray:
    """The smallest and the largest value under each permutation, side by side.

    One evaluation of a permutation gives two signature values.
    """
    factor = random_words(permutations, seed) | np.uint64(1)
    shift = random_words(permutations, seed + 1)
    low = np.full(permutations, np.iinfo(np.uint64).max, np.uint64)
    high = np.zeros(permutations, np.uint64)
    for i in range(0, len(shingles), BLOCK):
        value = shingles[i : i + BLOCK, None] * factor + shift
        value ^= value >> np.uint64(32)
        np.minimum(low, value.min(axis=0), out=low)
        np.maximum(high, value.max(axis=0), out=high)
    return np.stack([low, high], axis=1).ravel()


def band_keys(signature: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """One 64-bit key per band of ``rows`` signature values."""
    table = signature[: bands * rows].reshape(bands, rows)
    key = np.arange(bands, dtype=np.uint64) * GOLDEN
    for i in range(rows):
        key = mix(key * GOLDEN + table[:, i])
    return key


def _batches(batches, what):
    """``what(doc position, shingles)`` for each text of each batch, in bounded slices."""
    for batch in batches:
        raw, bounds = string_buffers(batch.column("text"))
        for first, last in byte_slices(bounds, 1 << 21):
            part = bounds[first : last + 1]
            hashes, at = word_hashes(raw[part[0] : part[-1]], part - part[0])
            yield batch, first, [
                what(shingle_set(hashes[at[i] : at[i + 1]], _batches.width)) for i in range(last - first)
            ]


_batches.width = 5


def _set_id(shingles: np.ndarray) -> bytes | None:
    return hashlib.blake2b(shingles.tobytes(), digest_size=16).digest() if len(shingles) else None


def signatures(docs: DataFrame, bands: int, rows: int) -> DataFrame:
    """(doc_id, n_shingles, set_id, bands) of each row; ``set_id`` null without words."""

    def run(batches):
        import pyarrow as pa

        def one(s):
            keys = band_keys(min_max(s, -(-bands * rows // 2)), bands, rows) if len(s) else None
            return len(s), _set_id(s), None if keys is None else keys.view(np.int64)

        for batch, first, found in _batches(batches, one):
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id").slice(first, len(found)),
                    pa.array([f[0] for f in found], pa.int64()),
                    pa.array([f[1] for f in found], pa.binary()),
                    pa.array([f[2] for f in found], pa.list_(pa.int64())),
                ],
                names=["doc_id", "n_shingles", "set_id", "bands"],
            )

    schema = "doc_id long, n_shingles long, set_id binary, bands array<long>"
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, schema)


def _sets(docs: DataFrame) -> DataFrame:
    """(cid, shingles) of rows that carry the class they stand for."""

    def run(batches):
        import pyarrow as pa

        for batch, first, found in _batches(batches, lambda s: (_set_id(s), s.view(np.int64))):
            ids = batch.column("set_id").slice(first, len(found)).to_pylist()
            keep = [i for i, f in enumerate(found) if f[0] is not None and f[0] == ids[i]]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("cid").slice(first, len(found)).take(pa.array(keep, pa.int64())),
                    pa.array([found[i][1] for i in keep], pa.list_(pa.int64())),
                ],
                names=["cid", "shingles"],
            )

    return docs.select("cid", "set_id", "text").mapInArrow(run, "cid long, shingles array<long>")


def _confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose full sets reach the similarity."""
    right = pairs.join(sets.select(F.col("cid").alias("b"), F.col("shingles").alias("_y")), "b")
    both = right.join(sets.select(F.col("cid").alias("a"), F.col("shingles").alias("_x")), "a")
    common = F.size(F.array_intersect("_x", "_y"))
    both = both.select("a", "b", (F.size("_x") + F.size("_y")).alias("_total"), common.alias("_common"))
    return both.where(100 * F.col("_common") >= percent * (F.col("_total") - F.col("_common"))).select("a", "b")


def _cell_links(percent: int):
    """Pairs of roots that links among the sets of one cell (cid, root, shingles) join.

    The intersection sizes come from a matrix product over the shingles that
    some but not all sets have. Of each component that the links make, only
    pairs of one of its members with the others are returned.
    """

    def run(rows):
        import pyarrow as pa

        cid, root = (rows.column(c).to_numpy() for c in ("cid", "root"))
        cid, once = np.unique(cid, return_index=True)
        root, lists = root[once], rows.column("shingles").combine_chunks()
        bounds, values = lists.offsets.to_numpy(), lists.values.to_numpy()
        size = np.diff(bounds)[once]
        owner = np.repeat(np.arange(len(once)), size)
        take = np.concatenate([np.arange(bounds[i], bounds[i + 1]) for i in once])
        shingle, column, count = np.unique(values[take], return_inverse=True, return_counts=True)
        common = np.full((len(once), len(once)), float((count == len(once)).sum()), np.float32)
        number = np.cumsum((count > 1) & (count < len(once))) - 1
        some = ((count > 1) & (count < len(once)))[column]
        owner, column = owner[some], number[column[some]]
        for first in range(0, int(number[-1]) + 1 if len(number) else 0, 4096):
            inside = (column >= first) & (column < first + 4096)
            part = np.zeros((len(once), 4096), np.float32)
            part[owner[inside], column[inside] - first] = 1
            common += part @ part.T
        near = 100 * common >= percent * (size[:, None] + size[None, :] - common)
        near &= root[:, None] != root[None, :]
        left, links = near.any(axis=1), []
        for i in range(len(once)):
            if not left[i]:
                continue
            left[i], reached = False, near[i] & left
            while True:
                left &= ~reached
                links += [(root[i], root[j]) for j in np.flatnonzero(reached & (root != root[i]))]
                reached = near[reached].any(axis=0) & left
                if not reached.any():
                    break
        pairs = np.array(links, np.int64).reshape(-1, 2)
        return pa.table([pa.array(pairs.min(axis=1)), pa.array(pairs.max(axis=1))], names=["a", "b"])

    return run


def near_duplicates(docs: DataFrame, percent: int = 85, bands: int = 24, rows: int = 5) -> DataFrame:
    """Component of near-duplicates of every document: doc_id, n_shingles, component_id, kept.

    Texts with equal shingle sets form one class. Classes that share a band
    key of their min-max signature are candidates; a link needs
    ``100 * intersection >= percent * union`` on the full sets. A bucket is
    never expanded into its pairs:

    1. every member is compared with one pivot;
    2. buckets that still hold several components are cut into blocks of about
       ``CELL`` members, and each block is linked up in one task;
    3. members outside the largest component of a bucket of several blocks are
       compared with all its blocks.

    Tasks return at most one link per member, and any two members of a bucket
    end up in one component or have been compared. A pair at the limit shares
    no bucket with probability ``(1 - s ** rows) ** bands``, below 1e-6 with
    the defaults.

    Empty, null and white-space texts have no shingles, are linked with
    nothing and stay. A row without ``doc_id`` cannot be named, so it is linked
    with nothing as well (component null, kept). Rows that repeat an id share
    its component only through their texts. An empty table gives no rows;
    further columns are ignored.
    """
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    rows_ = materialize(signatures(own, bands, rows), "minmax")
    named = rows_.where("doc_id IS NOT NULL AND set_id IS NOT NULL")
    classes = named.groupBy("set_id", "n_shingles", "bands").agg(F.min("doc_id").alias("first_id"))
    classes = materialize(classes.withColumn("cid", F.monotonically_increasing_id()), "minmax-classes")
    bucket = ["band", "key"]
    members = classes.select("cid", F.col("n_shingles").alias("n"), F.posexplode("bands").alias("band", "key"))
    pivots = members.groupBy(*bucket).agg(
        F.min("cid").alias("pivot"), F.min_by("n", "cid").alias("_pn"), F.count("*").alias("members")
    )
    shared = members.join(pivots.where("members > 1"), bucket).select(*bucket, "cid", "n", "pivot", "_pn", "members")
    shared = materialize(shared, "minmax-buckets")

    wanted = shared.select("cid").distinct().join(classes.select("cid", "set_id", "first_id"), "cid")
    sets = _sets(own.join(wanted, own.doc_id == wanted.first_id).select("cid", "set_id", "text"))
    sets = materialize(sets.dropDuplicates(["cid"]), "minmax-sets")

    large, small = F.greatest("n", "_pn"), F.least("n", "_pn")
    pairs = shared.where("pivot != cid").where(100 * small >= percent * large)
    pairs = pairs.select(F.col("pivot").alias("a"), F.col("cid").alias("b")).distinct()
    links = materialize(_confirmed(pairs, sets, percent), "minmax-links")
    roots = stars(links)

    def open_members(least: int) -> DataFrame:
        """Members, with their roots, of the buckets of over ``least`` that hold several components."""
        now = shared.where(F.col("members") > least).join(roots, shared.cid == roots.node, "left").select(
            *bucket, "cid", "members", F.coalesce("root", "cid").alias("root")
        )
        split = now.groupBy(*bucket).agg(F.min("root").alias("_lo"), F.max("root").alias("_hi"))
        now = now.join(split.where("_lo != _hi").select(*bucket), bucket)
        blocks = F.ceil(F.col("members") / CELL)
        return materialize(
            now.withColumns({"blocks": blocks, "block": F.pmod(F.xxhash64("cid"), blocks)}), "minmax-open"
        )

    def linked(cells: DataFrame, keys: list[str]) -> None:
        nonlocal roots
        found = cells.join(sets, "cid").select(*keys, "cid", "root", "shingles")
        found = found.groupBy(*keys).applyInArrow(_cell_links(percent), "a long, b long").distinct()
        found = materialize(found, "minmax-links")
        if not found.isEmpty():
            roots = materialize(extended(roots, stars(found)), "minmax-roots")

    linked(open_members(2), [*bucket, "block"])
    rest = open_members(max(2, CELL))
    if not rest.isEmpty():
        most = rest.groupBy(*bucket, "root").agg(F.count("*").alias("_n"))
        most = most.groupBy(*bucket).agg(F.max_by("root", F.struct("_n", "root")).alias("_most"))
        rest = rest.join(most, bucket)
        outside = F.col("root") != F.col("_most")
        chunks = rest.where(outside).groupBy(*bucket).agg(F.ceil(F.count("*") / CELL).alias("chunks"))
        rest = materialize(rest.join(chunks, bucket), "minmax-outside")
        up_to = lambda c: F.sequence(F.lit(0).cast("long"), F.col(c) - 1)
        inner = rest.withColumn("chunk", F.explode(up_to("chunks")))
        outer = rest.where(outside).drop("block").withColumns(
            {"chunk": F.pmod(F.xxhash64("cid", F.lit(1)), F.col("chunks")), "block": F.explode(up_to("blocks"))}
        )
        keys = [*bucket, "block", "chunk"]
        cells = inner.select(*keys, "cid", "root").unionByName(outer.select(*keys, "cid", "root")).distinct()
        linked(cells, keys)

    named_classes = classes.join(roots, classes.cid == roots.node, "left").select(
        "set_id", "n_shingles", "first_id", F.coalesce("root", "cid").alias("root")
    )
    lowest = named_classes.groupBy("root").agg(F.min("first_id").alias("component_id"))
    found = named_classes.join(lowest, "root").select("set_id", "component_id")
    out = rows_.join(found, "set_id", "left")
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("component_id", "doc_id"))
    return out.select("doc_id", "n_shingles", component.alias("component_id")).withColumn(
        "kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True))
    )


def one_of_each(docs: DataFrame, **parameters) -> DataFrame:
    """The documents that stay, with all their columns; those without an id stay as well."""
    kept = near_duplicates(docs, **parameters).where("kept").select(F.col("doc_id").alias("_kept")).distinct()
    packed = docs.select(F.struct("*").alias("_doc"))
    stay = packed.join(kept, F.col("_doc.doc_id") == F.col("_kept"), "left_semi")
    return stay.unionByName(packed.where("_doc.doc_id IS NULL")).select("_doc.*")
