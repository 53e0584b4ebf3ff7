"""The vector index: Parquet segments of a collection, named by a manifest.

``<root>/<collection>/manifests/<version>.json`` lists the segments that make
up the collection and its cells. A write makes new files first and then one
manifest, which appears by a rename: a reader takes the highest version and
sees all of a write or nothing, also while it runs or when it was lost.
There is one writer at a time; readers need no lock.

A segment has

``nodes/segment=<id>``  the nodes of a rebuild or compaction, clustered: folders
                        by level and cell, so that a lookup reads only the
                        cells it searches; or
``loose/segment=<id>``  the nodes of an addition: a few files by level.
``ids/<id>``            the ids of its documents and nodes, by kind and bucket, with
                        the level and cell of each node, so that few nodes are
                        fetched by id from few folders.
``sketch/<id>``         a Bloom filter of them: 64-bit words, four bits an id.

The nodes are staged once in the order they come, and as many tasks as the staged
bytes need (``TASK_BYTES``) write them into their folders with a file open for
each, so the number of files follows from the bytes and no text is shuffled. Staged
files go as soon as their rows are written (``_moved``), so a write holds its rows
twice only for one slice. Only
more folders than ``FOLDERS`` are written after a rebalancing exchange, as the ids are. Small segments are merged when there are many (``compact``).
"""

from __future__ import annotations

import json
import uuid
from functools import reduce

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import fixed
from ..operators import cells as C
from ..operators.sieve import WORD_IDS, mask, sieve, slot
from ..schemas import NODE
from ..session import CLEANUP, discard, materialize, with_conf

# Ids that share a bucket.
BUCKET_IDS = 1 << 20
# Staged bytes that a task writes into the folders of a clustered segment and into those of a loose one, which are
# few, and folders that it keeps open at once.
TASK_BYTES = 32 << 20
LOOSE_BYTES = 8 << 20
FOLDERS = 256
CODEC = "zstd"
LEVELS = 3
# An addition that makes more segments than this merges the small ones.
SEGMENTS = 8
STORED = T.StructType(
    [*NODE.fields, T.StructField("batch", T.StringType()), T.StructField("cell", T.IntegerType()), T.StructField("code", T.BinaryType())]
)
SEGMENT = T.StructType([T.StructField("segment", T.StringType()), *STORED.fields])
EMPTY = {"version": 0, "cells": None, "segments": []}


def _counted(seen: Observation, rows: DataFrame) -> int:
    """Rows observed while ``rows`` were written.

    Adaptive execution drops the observation with a frame that it finds to be
    empty; then the rows are counted.
    """
    try:
        return seen.get["n"]
    except Py4JJavaError:
        return rows.count()


class Collection:
    """A named, persistent set of nodes with vectors and metadata."""

    def __init__(self, spark: SparkSession, root: str, name: str):
        self.spark = spark
        self.folder = f"{root.rstrip('/')}/{name}"

    # --- files and manifests ---

    def _file(self, path: str):
        found = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return found.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), found

    def _listed(self, folder: str) -> list[str]:
        fs, path = self._file(f"{self.folder}/{folder}")
        return sorted(s.getPath().getName() for s in fs.listStatus(path)) if fs.exists(path) else []

    def versions(self) -> list[int]:
        return [int(name[:-5]) for name in self._listed("manifests") if name.endswith(".json")]

    def manifest(self, version: int | None = None) -> dict:
        """The manifest of a version, the newest by default."""
        known = self.versions()
        if not known:
            return EMPTY
        fs, path = self._file(f"{self.folder}/manifests/{version or known[-1]:012d}.json")
        stream = fs.open(path)
        try:
            return json.loads(self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()

    def _commit(self, segments: list[dict], cells: str | None) -> None:
        """Make the segments the collection, by one rename."""
        version = max([0, *self.versions()]) + 1
        text = json.dumps({"version": version, "cells": cells, "segments": segments})
        fs, draft = self._file(f"{self.folder}/manifests/{uuid.uuid4().hex}.draft")
        stream = fs.create(draft)
        stream.write(bytearray(text.encode()))
        stream.close()
        _, final = self._file(f"{self.folder}/manifests/{version:012d}.json")
        if fs.exists(final) or not fs.rename(draft, final):
            raise RuntimeError(f"another writer has committed version {version} of {self.folder}")
        self.vacuum()

    def vacuum(self, keep: int = 2) -> None:
        """Remove what none of the last ``keep`` manifests names, then the manifests before them.

        Readers that began with one of the kept versions find their files.
        """
        known = self.versions()
        last = [self.manifest(v) for v in known[-keep:]]
        named = {s["id"] for m in last for s in m["segments"]} | {m["cells"] for m in last}
        gone = [f"manifests/{v:012d}.json" for v in known[:-keep]]
        gone += [f"manifests/{name}" for name in self._listed("manifests") if name.endswith(".draft")]
        kinds = ("nodes", "loose", "ids", "sketch", "cells")
        gone += [f"{kind}/{name}" for kind in kinds for name in self._listed(kind) if name.removeprefix("segment=") not in named]
        for name in gone:
            fs, path = self._file(f"{self.folder}/{name}")
            fs.delete(path, True)

    def _tree(self, clustered: bool) -> str:
        return f"{self.folder}/{'nodes' if clustered else 'loose'}"

    def _path(self, segment: dict) -> str:
        return f"{self._tree(segment['clustered'])}/segment={segment['id']}"

    def _ids_path(self, segment: dict, table: str) -> str:
        return f"{self.folder}/{table}/{segment['id']}"

    # --- reading ---

    def exists(self) -> bool:
        return bool(self.versions())

    def _nodes(self, segments: list[dict]) -> DataFrame:
        """The rows of the segments, without batches that a later one has replaced."""
        parts = []
        for clustered in (True, False):
            same = [s for s in segments if s["clustered"] == clustered and s["batches"]]
            if same:
                reader = self.spark.read.schema(SEGMENT).option("basePath", self._tree(clustered))
                rows = reader.parquet(*[self._path(s) for s in same])
                for s in same:
                    if s["replaced"]:
                        rows = rows.where((F.col("segment") != s["id"]) | ~F.col("batch").isin(s["replaced"]))
                parts.append(rows.select(*STORED.names))
        return reduce(DataFrame.unionByName, parts) if parts else self.spark.createDataFrame([], STORED)

    def placed(self) -> DataFrame:
        """The stored nodes with the number of their cell and their code."""
        return self._nodes(self.manifest()["segments"]).drop("batch")

    def read(self) -> DataFrame:
        """The stored nodes; empty when there is no collection yet."""
        return self.placed().select(*NODE.names)

    def cells(self) -> C.Cells | None:
        """The trained cells; None without a vector."""
        name = self.manifest()["cells"]
        return C.Cells.of_rows(self.spark.read.parquet(f"{self.folder}/cells/{name}")) if name else None

    def lookup(
        self, queries: DataFrame, k: int = fixed.TOP_K, probes: int = C.PROBES, rerank: int = C.RERANK
    ) -> DataFrame:
        """The k nearest stored nodes in the ``probes`` cells nearest to each query (``cells.lookup``)."""
        return C.lookup(queries, self.placed(), self.cells(), k, probes, rerank)

    def count(self) -> int:
        """The number of nodes, as counted when they were written."""
        return sum(n for s in self.manifest()["segments"] for n in s["batches"].values())

    def reconciled(self) -> DataFrame:
        """One row: nodes that went into the writes, nodes stored, and whether the numbers differ.

        The first were observed on the rows that were parsed and written; only
        the stored ones are counted now.
        """
        stored = self._nodes(self.manifest()["segments"]).agg(F.count(F.lit(1)).alias("n_stored"))
        parsed = F.lit(self.count()).cast("long")
        return stored.select(parsed.alias("n_parsed"), "n_stored", (parsed != F.col("n_stored")).alias("differs"))

    # --- writing ---

    def _bytes(self, paths: list[str]) -> int:
        return sum(fs.getContentSummary(at).getLength() for fs, at in map(self._file, paths))

    def _slices(self, path: str) -> list[tuple[list[str], int]]:
        """The files of a staged table in parts that keep all cores busy, each with its bytes."""
        fs, folder = self._file(path)
        files = sorted((s.getPath().toString(), s.getLen()) for s in fs.listStatus(folder) if s.getPath().getName().endswith(".parquet"))
        least = TASK_BYTES * self.spark.sparkContext.defaultParallelism
        out: list[tuple[list[str], int]] = []
        for name, size in files:
            if out and out[-1][1] < least:
                out[-1] = ([*out[-1][0], name], out[-1][1] + size)
            else:
                out.append(([name], size))
        return out

    def _moved(self, staged: DataFrame, model: C.Cells | None, batch: str, clustered: bool, cells: int) -> dict:
        """The rows of a staged table as one segment; its files go as they are written."""
        out = self._new(clustered)
        n = 0
        for files, size in self._slices(staged._scratch_path):
            part = self.spark.read.schema(staged.schema).parquet(*files)
            shaped = part.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in NODE.fields])
            n += self._write_nodes(C.with_cells(shaped, model).withColumn("batch", F.lit(batch)), out, size, cells)
            for name in files:
                fs, path = self._file(name)
                fs.delete(path, False)
        discard(staged)
        return self._described(out, {batch: n} if n else {}, n)

    def _merged(self, segments: list[dict], cells: int) -> dict:
        """The rows of other segments, which name their cells and batches, as one clustered segment."""
        out = self._new(True)
        n = self._write_nodes(self._nodes(segments), out, self._bytes([self._path(s) for s in segments]), cells)
        counts = self.spark.read.schema(STORED).parquet(self._path(out)).groupBy("batch").count()
        return self._described(out, {r["batch"]: r["count"] for r in counts.collect()}, n)

    @staticmethod
    def _new(clustered: bool) -> dict:
        return {"id": uuid.uuid4().hex, "clustered": clustered, "replaced": []}

    def _write_nodes(self, nodes: DataFrame, segment: dict, size: int, cells: int) -> int:
        """Add the nodes, read from ``size`` bytes, to the segment's folders; their number."""
        at = self._path(segment)
        seen = Observation()
        rows = nodes.select(*STORED.names).observe(seen, F.count(F.lit(1)).alias("n"))
        by, folders = (["level", "cell"], LEVELS * cells) if segment["clustered"] else (["level"], LEVELS)
        if folders > FOLDERS:
            rows = rows.hint("rebalance", *by)
        else:
            rows = rows.coalesce(size // (TASK_BYTES if segment["clustered"] else LOOSE_BYTES) + 1)
        with with_conf(self.spark, {"spark.sql.maxConcurrentOutputFileWriters": str(FOLDERS), CLEANUP: "true"}):
            rows.write.mode("append").partitionBy(*by).option("compression", CODEC).parquet(at)
        return _counted(seen, nodes)

    def _described(self, segment: dict, batches: dict[str, int], n: int) -> dict:
        segment = segment | {"batches": batches, "rows": n, "buckets": n // BUCKET_IDS + 1, "words": n // WORD_IDS + 1}
        if n:
            self._write_ids(segment)
        return segment

    def _write_ids(self, segment: dict) -> None:
        """The segment's ids by bucket, and their sketch."""
        stored = self.spark.read.schema(STORED).parquet(self._path(segment))
        docs = stored.select(F.lit("doc").alias("kind"), F.col("doc_id").alias("id"), "batch").distinct()
        nodes = stored.select(F.lit("node").alias("kind"), F.col("node_id").alias("id"), "batch", "level", "cell")
        ids = docs.unionByName(nodes, allowMissingColumns=True).withColumn("bucket", slot("id", segment["buckets"]))
        with with_conf(self.spark, {CLEANUP: "true"}):
            ids.hint("rebalance", "kind", "bucket").write.partitionBy("kind", "bucket").option("compression", CODEC).parquet(self._ids_path(segment, "ids"))
        ids = self._ids(segment).select("kind", slot("id", segment["words"]).alias("word"), mask("id").alias("bits"))
        words = ids.groupBy("kind", "word").agg(F.bit_or("bits").alias("bits"))
        with with_conf(self.spark, {CLEANUP: "true"}):
            words.hint("rebalance", "kind").write.partitionBy("kind").parquet(self._ids_path(segment, "sketch"))

    def _ids(self, segment: dict) -> DataFrame:
        schema = "id string, batch string, level int, cell int, kind string, bucket long"
        return self.spark.read.schema(schema).parquet(self._ids_path(segment, "ids"))

    def rebuild(self, nodes: DataFrame, cells: int = C.CELLS, batch: str = "rebuild") -> None:
        """Replace everything; ``cells`` is the number of cells to train.

        The nodes are written once before their cells are trained, so nothing
        is parsed or embedded twice.
        """
        seen = Observation()
        staged = materialize(nodes.observe(seen, F.count(F.lit(1)).alias("n")), "index-nodes", CODEC)
        model = C.fit(staged, cells, _counted(seen, staged))
        name = None
        if model is not None:
            name = uuid.uuid4().hex
            model.rows(self.spark).write.parquet(f"{self.folder}/cells/{name}")
        segment = self._moved(staged, model, batch, True, len(model or ()))
        self._commit([segment] if segment["rows"] else [], name)

    def add(self, nodes: DataFrame, dedupe: bool = False, batch: str | None = None) -> None:
        """Append; nodes already stored are stored again unless ``dedupe`` is set.

        ``batch`` names the addition: a second one of the same name replaces
        the first. A collection without cells is built from the nodes.
        """
        nodes = self.unknown(nodes) if dedupe else nodes
        batch = batch or f"add-{uuid.uuid4().hex}"
        now = self.manifest()
        if now["cells"] is None:
            self.rebuild(nodes, batch=batch)
            return
        staged = materialize(nodes, "index-nodes", CODEC)
        segment = self._moved(staged, self.cells(), batch, False, 0)
        kept = []
        for s in now["segments"]:
            if batch in s["batches"]:
                rest = {b: n for b, n in s["batches"].items() if b != batch}
                s = s | {"batches": rest, "replaced": [*s["replaced"], batch]}
            if s["batches"]:
                kept.append(s)
        self._commit([*kept, *([segment] if segment["rows"] else [])], now["cells"])
        if len(kept) + 1 > SEGMENTS:
            self.compact()

    def compact(self, share: float = 0.25) -> None:
        """Merge the segments that hold less than ``share`` of the largest one's rows into one clustered segment.

        Merged segments grow in steps, so a row is written again only a few
        times however many additions follow. If no two are that small, all are merged.
        """
        now = self.manifest()
        most = max((s["rows"] for s in now["segments"]), default=0)
        small = [s for s in now["segments"] if s["rows"] < share * most]
        small = small if len(small) > 1 else now["segments"]
        if len(small) < 2:
            return
        cells = len(self.cells() or ())
        merged = self._merged(small, cells)
        chosen = {s["id"] for s in small}
        kept = [s for s in now["segments"] if s["id"] not in chosen]
        self._commit([*kept, *([merged] if merged["rows"] else [])], now["cells"])

    def delete_all(self) -> None:
        """Empty the collection; a missing one is not an error."""
        if self.exists():
            self._commit([], None)

    # --- membership ---

    def _stored_ids(self, segments: list[dict], ids: DataFrame, kind: str, but: str | None = None) -> DataFrame:
        """Where the ``id``s are stored: ``id, at`` (a segment's place in the list), ``level, cell``.

        Each segment's sketch is asked first; ids are read only from the
        buckets of those that it may hold.
        """
        asked_at = [at for at, s in enumerate(segments) if set(s["batches"]) - {but}]
        none = self.spark.createDataFrame([], "id string, at int, level int, cell int")
        if not asked_at:
            return none
        maybe = []
        for at in asked_at:
            s = segments[at]
            sketch = self.spark.read.schema("word long, bits long, kind string").parquet(self._ids_path(s, "sketch"))
            sketch = sketch.where(F.col("kind") == kind).select("word", "bits")
            asked = ids.select("id", slot("id", s["words"]).alias("word"), mask("id").alias("_mask"), slot("id", s["buckets"]).alias("bucket"))
            hit = asked.join(sketch, "word").where(F.col("bits").bitwiseAND(F.col("_mask")) == F.col("_mask"))
            maybe.append(hit.select("id", "bucket", F.lit(at).alias("segment")))
        maybe = materialize(reduce(DataFrame.unionByName, maybe), "index-maybe")
        buckets: dict[int, list[int]] = {}
        for r in maybe.select("segment", "bucket").distinct().collect():
            buckets.setdefault(r["segment"], []).append(r["bucket"])
        found = []
        for at, wanted in buckets.items():
            stored = self._ids(segments[at]).where((F.col("kind") == kind) & F.col("bucket").isin(sorted(wanted)))
            gone = [*segments[at]["replaced"], *([but] if but else [])]
            stored = stored.where(~F.col("batch").isin(gone)) if gone else stored
            same = stored.join(maybe.where(F.col("segment") == at).select("id"), "id", "left_semi")
            found.append(same.select("id", F.lit(at).alias("at"), "level", "cell"))
        return reduce(DataFrame.unionByName, found) if found else none

    def known(self, ids: DataFrame, kind: str, but: str | None = None) -> DataFrame:
        """The ``id``s that are stored as ids of documents or nodes (``kind``), in another batch than ``but``."""
        return self._stored_ids(self.manifest()["segments"], ids, kind, but).select("id").distinct()

    def fetch(self, ids: DataFrame) -> DataFrame:
        """The stored nodes whose ``node_id`` is one of ``ids.id``, each as often as it is stored.

        For few ids in a large index: the id files say in which segments,
        levels and cells they are, and only those folders are read. The driver gets
        these numbers, at most segments x levels x cells, and no id. For ids
        that are in most cells a join with ``read()`` costs less.
        """
        segments = self.manifest()["segments"]
        wanted = materialize(ids.where("id IS NOT NULL").select("id").distinct(), "index-wanted")
        found = materialize(self._stored_ids(segments, wanted, "node"), "index-found")
        folders: dict[int, dict[int, set]] = {}
        for r in found.select("at", "level", "cell").distinct().collect():
            folders.setdefault(r["at"], {}).setdefault(r["level"], set()).add(r["cell"])
        parts = [self.spark.createDataFrame([], STORED)]
        for at, levels in sorted(folders.items()):
            inside = F.lit(False)
            for level, cells in sorted(levels.items()):
                one = F.col("cell").isin(sorted(cells - {None}))
                inside |= (F.col("level") == level) & (one | F.col("cell").isNull() if None in cells else one)
            parts.append(self._nodes([segments[at]]).where(inside))
        nodes = sieve(reduce(DataFrame.unionByName, parts).select(*NODE.names), "node_id", wanted)
        return nodes.join(wanted.withColumnRenamed("id", "node_id"), "node_id", "left_semi").select(*NODE.names)

    def _unknown(self, rows: DataFrame, column: str, kind: str, but: str | None) -> DataFrame:
        """Ids alone are made distinct and compared; then the rows of the new ones are moved, once."""
        if not self.exists():
            return rows.dropDuplicates([column])
        rows = materialize(rows, "index-new", CODEC)
        ids = materialize(rows.select(F.col(column).alias("id")).distinct(), "index-asked")
        stored = self.known(ids, kind, but).withColumnRenamed("id", "_stored")
        new = materialize(ids.join(stored, F.col("id") == F.col("_stored"), "left_anti"), "index-unknown")
        fresh = rows.join(new, F.col(column) == F.col("id"), "left_semi").dropDuplicates([column])
        return fresh.unionByName(rows.where(F.col(column).isNull()).dropDuplicates([column]))

    def unknown_documents(self, docs: DataFrame, batch: str) -> DataFrame:
        """The documents that no other batch has stored, each id once."""
        return self._unknown(docs, "doc_id", "doc", batch)

    def unknown(self, nodes: DataFrame) -> DataFrame:
        """The nodes whose ids are not stored yet, each id once.

        Both sides of the anti join hold an id once, so no id is a hot key.
        """
        return self._unknown(nodes, "node_id", "node", None)


def reconcile(parsed: DataFrame, stored: DataFrame) -> DataFrame:
    """One row: nodes parsed, nodes stored, and whether the numbers differ."""
    one = F.lit(1)
    both = parsed.select(one.alias("parsed"), F.lit(0).alias("stored")).unionByName(
        stored.select(F.lit(0).alias("parsed"), one.alias("stored"))
    )
    counts = both.agg(
        F.coalesce(F.sum("parsed"), F.lit(0)).alias("n_parsed"),
        F.coalesce(F.sum("stored"), F.lit(0)).alias("n_stored"),
    )
    return counts.withColumn("differs", F.col("n_parsed") != F.col("n_stored"))
