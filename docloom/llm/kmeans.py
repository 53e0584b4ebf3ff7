"""Centroid clustering with heap-ordered bounds: only vectors whose gap has expired are compared again."""

from __future__ import annotations

import hashlib
import heapq

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docloom.session import discard, materialize

# Components are kept within +-LIMIT, so that a squared distance fits a long.
LIMIT = 1 << 27
# Bounds are real numbers; they are tightened by this share of their size.
SLACK = 1e-9
STATE = "vec_id array<long>, vectors binary, rows array<array<int>>, gaps array<array<double>>"
MOVES = "part string, vec_id array<long>, vectors binary, rows array<array<int>>, gaps array<array<double>>, cluster int, sums array<long>, n long"


def grid(vectors: DataFrame, dims: int = 64, scale: int = 64) -> DataFrame:
    """(vec_id, point): floor(scale * x) of every component as a long.

    Rows without exactly ``dims`` finite components take no part.
    """
    x = F.transform("embedding", lambda v: v.cast("double"))
    finite = F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    bound = lambda v: F.greatest(F.lit(-LIMIT * 1.0), F.least(F.lit(LIMIT * 1.0), v))
    point = F.transform(x, lambda v: F.floor(bound(v * scale)).cast("long"))
    right = (F.size("embedding") == dims) & finite
    return vectors.where(right).select(F.col("vec_id").cast("long").alias("vec_id"), point.alias("point"))


def first_centroids(points: DataFrame, k: int) -> np.ndarray:
    """The k points with the smallest hex SHA-256 of ``1:<vec_id>``; null ids last, ties by the point."""
    key = F.sha2(F.concat(F.lit("1:"), F.col("vec_id").cast("string")), 256)
    rows = points.orderBy(key.asc_nulls_last(), "point").limit(k).collect()
    return np.array([r["point"] for r in rows], np.int64)


def squared(vectors: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    """Exact squared distances of all vectors to all centroids."""
    out = np.empty((len(vectors), len(centroids)), np.int64)
    for j, c in enumerate(centroids):
        d = vectors - c
        out[:, j] = np.einsum("ij,ij->i", d, d)
    return out


def nearest(vectors: np.ndarray, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Nearest centroid of each vector (the first of equal ones), and the lower-upper gap.

    The gap is the distance to the second nearest centroid minus that to the
    nearest, never more than it truly is; without a second one it is infinite.
    """
    d = squared(vectors, centroids)
    home = d.argmin(axis=1)
    at = np.arange(len(d))
    upper = np.sqrt(d[at, home].astype(float))
    d[at, home] = np.iinfo(np.int64).max
    lower = np.sqrt(d.min(axis=1).astype(float)) if len(centroids) > 1 else np.full(len(d), np.inf)
    return home, lower * (1 - SLACK) - upper * (1 + SLACK)


def expiry_offsets(moved: np.ndarray) -> np.ndarray:
    """By how much a round's moves shrink the gaps of each cluster, at most.

    Its own centroid comes ``moved`` nearer or farther, any other one at most
    as much as the one that moved farthest.
    """
    out = np.empty(len(moved))
    for c in range(len(moved)):
        out[c] = moved[c] + max((m for j, m in enumerate(moved) if j != c), default=0.0)
    return out * (1 + SLACK)


class Heaps:
    """Per cluster a heap of (gap plus the drift accumulated when it was pushed, row)."""

    def __init__(self, heaps: list[list[tuple[float, int]]]):
        self.heaps = heaps

    def expired(self, drift: np.ndarray) -> tuple[list[int], list[int]]:
        """Pop the rows whose gap the drift since their push has used up: (rows, their clusters)."""
        rows, homes = [], []
        for c, heap in enumerate(self.heaps):
            while heap and heap[0][0] <= drift[c]:
                rows.append(heapq.heappop(heap)[1])
                homes.append(c)
        return rows, homes

    def push(self, rows, homes, gaps, drift: np.ndarray) -> None:
        for row, c, gap in zip(rows, homes, gaps):
            heapq.heappush(self.heaps[c], (gap + drift[c], row))

    def columns(self) -> tuple[list[list[int]], list[list[float]]]:
        return [[r for _, r in h] for h in self.heaps], [[g for g, _ in h] for h in self.heaps]


def _matrix(raw: bytes, n: int) -> np.ndarray:
    return np.frombuffer(raw, np.int32).reshape(n, -1).astype(np.int64)


def _changes(vectors, rows, old, new, k: int):
    """(cluster, sums, n): what the rows that changed their cluster add to each; ``old`` is -1 for none."""
    out = []
    for c in range(k):
        came, left = rows[new == c], rows[old == c]
        if len(came) or len(left):
            out.append((c, vectors[came].sum(axis=0) - vectors[left].sum(axis=0), len(came) - len(left)))
    return out


def _rows(state, changes) -> pa.RecordBatch:
    """One state row and its changes, told apart by ``part``."""
    full = [("state", *state, None, None, None)]
    full += [("change", None, None, None, None, c, sums.tolist(), n) for c, sums, n in changes]
    kinds = [pa.string(), pa.list_(pa.int64()), pa.binary(), pa.list_(pa.list_(pa.int32())), pa.list_(pa.list_(pa.float64())), pa.int32(), pa.list_(pa.int64()), pa.int64()]
    return pa.RecordBatch.from_arrays(
        [pa.array(c, t) for c, t in zip(zip(*full), kinds)],
        names=["part", "vec_id", "vectors", "rows", "gaps", "cluster", "sums", "n"],
    )


def start(points: DataFrame, centroids: np.ndarray) -> DataFrame:
    """The first assignment: blocks of vectors with their heaps, and each block's sums.

    A block is one batch of rows; its vectors stay with its heaps, so a round
    is a narrow pass without a shuffle of vectors.
    """
    k = len(centroids)

    def run(batches):
        for batch in batches:
            ids = batch.column("vec_id").to_pylist()
            flat = batch.column("point").flatten().to_numpy(zero_copy_only=False)
            vectors = flat.astype(np.int64).reshape(len(ids), -1)
            home, gap = nearest(vectors, centroids)
            heaps = Heaps([[] for _ in range(k)])
            for c in range(k):
                own = np.flatnonzero(home == c)
                heaps.heaps[c] = list(zip(gap[own].tolist(), own.tolist()))
                heapq.heapify(heaps.heaps[c])
            rows = np.arange(len(ids))
            changes = _changes(vectors, rows, np.full(len(ids), -1), home, k)
            yield _rows((ids, vectors.astype(np.int32).tobytes(), *heaps.columns()), changes)

    return points.mapInArrow(run, MOVES)


def advance(state: DataFrame, centroids: np.ndarray, drift: np.ndarray) -> DataFrame:
    """One more assignment: pop what has expired, compare it with all centroids, push it where it belongs."""
    k = len(centroids)

    def run(batches):
        for batch in batches:
            for r in batch.to_pylist():
                vectors = _matrix(r["vectors"], len(r["vec_id"]))
                heaps = Heaps([list(zip(g, own)) for g, own in zip(r["gaps"], r["rows"])])
                rows, old = (np.array(x, np.int64) for x in heaps.expired(drift))
                home, gap = nearest(vectors[rows], centroids) if len(rows) else (old, np.zeros(0))
                heaps.push(rows.tolist(), home.tolist(), gap.tolist(), drift)
                went = home != old
                changes = _changes(vectors, rows[went], old[went], home[went], k)
                yield _rows((r["vec_id"], r["vectors"], *heaps.columns()), changes)

    return state.mapInArrow(run, MOVES)


def _apply(moves: DataFrame, sums: list[list[int]], counts: list[int]) -> None:
    """Add the blocks' changes to the clusters' exact sums; one row for each cluster and component comes back."""
    changes = moves.where("part = 'change'")
    by = changes.select("cluster", "n", F.posexplode("sums").alias("d", "x"))
    total = by.groupBy("cluster", "d").agg(F.sum(F.col("x").cast("decimal(38,0)")).alias("x"), F.sum("n").alias("n"))
    for r in total.collect():
        sums[r["cluster"]][r["d"]] += int(r["x"])
        if r["d"] == 0:
            counts[r["cluster"]] += r["n"]


def digest(centroid: np.ndarray) -> str:
    """SHA-256 of the components as decimal integers, joined by commas."""
    return hashlib.sha256(",".join(str(int(x)) for x in centroid).encode()).hexdigest()


def _final(state: DataFrame, centroids: np.ndarray) -> DataFrame:
    """(vec_id, cluster, distance) of every vector, from the heaps it lies in."""

    def run(batches):
        for batch in batches:
            for r in batch.to_pylist():
                vectors = _matrix(r["vectors"], len(r["vec_id"]))
                home = np.empty(len(vectors), np.int64)
                for c, own in enumerate(r["rows"]):
                    home[own] = c
                d = vectors - centroids[home]
                columns = [pa.array(r["vec_id"], pa.int64()), pa.array(home, pa.int32()), pa.array(np.einsum("ij,ij->i", d, d))]
                yield pa.RecordBatch.from_arrays(columns, names=["vec_id", "cluster", "distance"])

    return state.mapInArrow(run, "vec_id long, cluster int, distance long")


def _lookup(values: list, kind: str, at: Column) -> Column:
    """The value of a cluster: k values as one literal array."""
    return F.get(F.lit(values).cast(f"array<{kind}>"), at)


def cluster(vectors: DataFrame, k: int = 16, rounds: int = 3, dims: int = 64, scale: int = 64) -> DataFrame:
    """vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256 of each vector.

    Lloyd's rounds on the integer grid ``floor(scale * x)``: k points chosen by
    the hash of their ids, each vector to its nearest centroid (ties to the
    smaller number), each centroid to the floor of its vectors' mean; empty
    ones stay. After ``rounds`` rounds all vectors are assigned once more.

    Every cluster of a block of vectors keeps a heap of the gaps between a
    vector's lower bound (any other centroid) and upper bound (its own). A
    gap is offset by the drift the cluster had accumulated when it was pushed,
    so moving centroids costs nothing per vector: what the drift has overtaken
    is popped and compared with all centroids, all else keeps its cluster.
    Gaps are never larger than they truly are and a vector is popped when its
    gap is 0, so the result equals a full comparison, ties included. Sums are
    whole numbers and change by the vectors that moved.

    Vectors that are null, of another length, or hold null, NaN or infinite
    components have no row. A null vec_id is clustered but comes last among
    the first centroids; repeated rows are vectors of their own. Components
    beyond +-2**27 after scaling count as 2**27, as their distances would not
    fit a long. Fewer than k vectors make fewer clusters; an empty table has
    no rows. Further columns are ignored. k and dims bound what the driver
    holds: k * dims sums.
    """
    points = grid(vectors, dims, scale)
    centroids = first_centroids(points, k)
    if not len(centroids):
        schema = "vec_id long, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string"
        return vectors.sparkSession.createDataFrame([], schema)
    k = len(centroids)
    sums, counts = [[0] * dims for _ in range(k)], [0] * k
    drift = np.zeros(k)
    moves = materialize(start(points, centroids), "cluster-state")
    for _ in range(rounds):
        _apply(moves, sums, counts)
        new = centroids.copy()
        for c in range(k):
            if counts[c]:
                new[c] = [x // counts[c] for x in sums[c]]
        drift = drift + expiry_offsets(np.sqrt(((new - centroids) ** 2).sum(axis=1).astype(float)))
        centroids = new
        state = moves.where("part = 'state'").select("vec_id", "vectors", "rows", "gaps")
        after = materialize(advance(state, centroids, drift), "cluster-state")
        discard(moves)
        moves = after
    found = _final(moves.where("part = 'state'").select("vec_id", "vectors", "rows", "gaps"), centroids)
    found = materialize(found, "cluster-found")
    discard(moves)
    inertia = [0] * k
    for r in found.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("d")).collect():
        inertia[r["cluster"]] = int(r["d"])
    at = F.col("cluster")
    return found.select(
        "vec_id", "cluster", "distance", _lookup(inertia, "long", at).alias("cluster_inertia"),
        F.lit(sum(inertia)).cast("long").alias("inertia"), _lookup([digest(c) for c in centroids], "string", at).alias("centroid_sha256"),
    )
