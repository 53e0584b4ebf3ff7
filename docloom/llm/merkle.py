"""Merkle manifest of a dataset: per level, lag and lead windows supply siblings and parents (DataFrame functions only)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docloom.llm.oracles import UPPER
from docloom.session import discard, materialize

FAN = 16
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
PATH = "array<struct<before:string,after:string>>"


def leaf_hash(fields: dict[str, Column]) -> Column:
    """SHA-256 of the fields: ``-`` for null, else the UTF-8 byte count, a colon and the value."""
    shown = [f.cast("string") for f in fields.values()]
    parts = [F.when(f.isNull(), "-").otherwise(F.concat(F.octet_length(f).cast("string"), F.lit(":"), f)) for f in shown]
    return F.sha2(F.concat(*parts), 256)


def leaves(docs: DataFrame, tampered: Column, every: int = 5) -> DataFrame:
    """(seq, doc_id, hash, now): the leaf of each row, and that of the row as it is found later.

    ``seq`` stands for the source, null before all others. ``now`` hashes
    ``tampered`` instead of the text where ``every`` divides the CRC-32 of the
    decimal id; a null id has no checksum and stays as it is.
    """
    fields = {c: F.col(c) for c in FIELDS}
    own = leaf_hash(fields)
    hit = F.crc32(F.col("doc_id").cast("string")) % every == 0
    now = F.when(hit, leaf_hash(fields | {"text": tampered})).otherwise(own)
    seq = F.coalesce(F.concat(F.lit(":"), "source"), F.lit(""))
    return docs.select(seq.alias("seq"), "doc_id", own.alias("hash"), now.alias("now"))


def numbered(rows: DataFrame, keys: list[str], order: list[str], name: str) -> DataFrame:
    """``rows`` with ``pos``, from 0 in each group of ``keys`` by ``order``, and the group's size ``n``.

    The rows are range-partitioned by keys and order, so a group that holds
    most rows spreads over many tasks; only counts by group and partition,
    one row each, are summed up. The result is a table, so places don't move
    when a task is lost. No key is null.
    """
    dealt = rows.repartitionByRange(*[F.col(c) for c in keys + order]).sortWithinPartitions(*keys, *order)
    table = materialize(dealt.withColumn("_at", F.monotonically_increasing_id()), f"{name}-sorted")
    dealt = table.withColumn("_part", F.shiftright("_at", 33))
    counts = dealt.groupBy(*keys, "_part").agg(F.count("*").alias("_c"), F.min("_at").alias("_first"))
    group = Window.partitionBy(*keys) if keys else Window.partitionBy(F.lit(0))
    earlier = group.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    move = F.coalesce(F.sum("_c").over(earlier), F.lit(0)) - F.col("_first")
    counts = counts.select(*keys, "_part", move.alias("_move"), F.sum("_c").over(group).alias("n"))
    joined = dealt.join(counts, [*keys, "_part"])
    placed = materialize(joined.select(*rows.columns, (F.col("_at") + F.col("_move")).alias("pos"), "n"), name)
    discard(table)
    return placed


def with_siblings(nodes: DataFrame) -> DataFrame:
    """Nodes with ``before`` and ``after``, the joined hashes of their run's other nodes, and the parent's place ``up``.

    Fixed-offset lag and lead columns, masked by the slot in the run and the
    run's length; a window holds one run, however long the sequence is.
    """
    nodes = nodes.withColumn("up", F.floor(F.col("pos") / FAN))
    run = Window.partitionBy("seq", "up").orderBy("pos")
    slot = F.col("pos") % FAN
    length = F.least(F.lit(FAN), F.col("n") - F.col("up") * FAN)
    lags = [F.when(slot >= k, F.lag("hash", k).over(run)) for k in range(FAN - 1, 0, -1)]
    leads = [F.when(slot + k < length, F.lead("hash", k).over(run)) for k in range(1, FAN)]
    return nodes.withColumns({"before": F.concat_ws("", *lags), "after": F.concat_ws("", *leads)})


def parents(nodes: DataFrame) -> DataFrame:
    """The next level: each run's first node hashes the run. Sequences that are down to one node end here."""
    first = with_siblings(nodes.where("n > 1")).where(F.col("pos") % FAN == 0)
    up = F.sha2(F.concat("hash", "after"), 256)
    return first.select("seq", F.col("up").alias("pos"), F.ceil(F.col("n") / FAN).alias("n"), up.alias("hash"))


def levels(nodes: DataFrame, name: str) -> list[DataFrame]:
    """All levels of (seq, pos, n, hash), the nodes first; each is a sixteenth of the one below."""
    out = [nodes]
    while (out[-1].agg(F.max("n")).first()[0] or 0) > 1:
        out.append(materialize(parents(out[-1].select("seq", "pos", "n", "hash")), f"{name}-level"))
    return out


def tops(up: list[DataFrame]) -> DataFrame:
    """(seq, hash): the last node of each sequence."""
    found = [level.where("n = 1").select("seq", "hash") for level in up]
    out = found[0]
    for more in found[1:]:
        out = out.unionByName(more)
    return out


def paths(nodes: DataFrame, above: DataFrame | None, ends: DataFrame) -> DataFrame:
    """``nodes`` with the ``path`` to the root (siblings level by level) and the columns of ``ends``.

    A sequence's last node takes them from ``ends`` (by seq), every other one
    adds its siblings to the path of its parent in ``above``. Sixteen nodes
    share a parent, and a sequence meets ``ends`` with one node, so no key is hot.
    """
    last = nodes.where("n = 1").join(ends, "seq")
    if above is None:
        return last
    parent = above.select("seq", F.col("pos").alias("up"), *[c for c in ends.columns if c != "seq"])
    inner = with_siblings(nodes.where("n > 1")).join(parent, ["seq", "up"])
    own = F.array(F.struct("before", "after")).cast(PATH)
    inner = inner.withColumn("path", F.concat(own, "path")).drop("before", "after", "up")
    return inner.unionByName(last)


def folded(leaf: Column, path: Column) -> Column:
    """The root that follows from a leaf and the siblings on its path."""
    return F.aggregate(path, leaf, lambda h, x: F.sha2(F.concat(x["before"], h, x["after"]), 256))


def manifest(docs: DataFrame, tampered: Column | None = None) -> DataFrame:
    """doc_id, leaf, subroot, root, proof_sha256, folded_root, verified of each row.

    Leaves ascend by doc_id within their source; each sixteen consecutive
    nodes make up a parent until one is left, the source's subroot; subroots
    in the order of their sources (null first, by UTF-8 bytes) likewise make
    up the root. The proof of a row is the SHA-256 of its siblings up to the
    root; ``folded_root`` follows from the row as it is found (``tampered``,
    by default the text with A-Z lower-cased, in every fifth row by checksum).

    Rows with a null id come first in their source. Rows of one id are
    ordered by their leaves, so repeated rows are leaves of their own whose
    order makes no difference. Nulls count as ``-``, empty texts as ``0:``;
    texts of any length are hashed in the row and never shuffled. An empty
    table has no rows. Further columns are ignored.
    """
    tampered = F.translate("text", UPPER, UPPER.lower()) if tampered is None else tampered
    found = materialize(leaves(docs.select(*FIELDS), tampered), "merkle-leaves")
    nodes = numbered(found, ["seq"], ["doc_id", "hash"], "merkle-nodes")
    discard(found)
    up = levels(nodes, "merkle")
    subroots = numbered(tops(up).withColumnRenamed("seq", "source"), [], ["source"], "merkle-subroots")
    top = levels(subroots.withColumn("seq", F.lit("")), "merkle-top")

    ends = tops(top).select("seq", F.col("hash").alias("root"), F.array().cast(PATH).alias("path"))
    above = None
    for level in reversed(top):
        above = materialize(paths(level, above, ends), "merkle-paths")
    ends = above.select(F.col("source").alias("seq"), F.col("hash").alias("subroot"), "root", "path")
    above = None
    for level in reversed(up[1:]):
        above = materialize(paths(level, above, ends), "merkle-paths")
    siblings = F.array_join(F.transform("path", lambda x: F.concat(x["before"], x["after"])), "")
    rows = paths(nodes, above, ends).select(
        "doc_id", F.col("hash").alias("leaf"), "subroot", "root", F.sha2(siblings, 256).alias("proof_sha256"),
        folded(F.col("now"), F.col("path")).alias("folded_root"),
    )
    return rows.withColumn("verified", F.col("folded_root") == F.col("root"))
