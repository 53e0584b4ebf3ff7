"""Session defaults and the shared scratch folder."""

from __future__ import annotations

import os
import sys
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

# Spark removes the shuffle files of a query that has ended.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"

_local_scratch: dict[str, str] = {}


def build_session(app: str = "docloom", master: str | None = None, **conf: str) -> SparkSession:
    """A session for tests, the bench and examples; a cluster brings its own."""
    os.environ.setdefault("PYSPARK_PYTHON", sys.executable)
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    defaults = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.ui.enabled": "false",
    }
    for key, value in {**defaults, **conf}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def scratch_dir(spark: SparkSession) -> str:
    """The shared folder named by ``spark.checkpoint.dir``.

    Only a local session without that setting gets a folder of its own; on a
    cluster a machine-local folder would not be seen by the other executors,
    so a missing setting is an error there.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured
    context = spark.sparkContext
    if not context.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
    app_id = context.applicationId
    if app_id not in _local_scratch:
        _local_scratch[app_id] = tempfile.mkdtemp(prefix="docloom-")
    return _local_scratch[app_id]


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path below the scratch folder."""
    return f"{scratch_dir(spark).rstrip('/')}/docloom/{name}-{uuid.uuid4().hex}"


@contextmanager
def with_conf(spark: SparkSession, settings: dict[str, str]) -> Iterator[None]:
    """Session settings that hold inside the block only."""
    kept = {key: spark.conf.get(key, None) for key in settings}
    for key, value in settings.items():
        spark.conf.set(key, value)
    try:
        yield
    finally:
        for key, value in kept.items():
            spark.conf.unset(key) if value is None else spark.conf.set(key, value)


def materialize(df: DataFrame, name: str, codec: str = "snappy") -> DataFrame:
    """Write ``df`` once to the scratch folder and read it back.

    Cuts the lineage and makes later passes read the same rows even when
    executors are lost in between. The shuffle files of the write go when it
    has ended: whatever reads the table needs none of them.
    """
    spark = df.sparkSession
    path = scratch_path(spark, name)
    with with_conf(spark, {CLEANUP: "true"}):
        df.write.option("compression", codec).parquet(path)
    table = spark.read.schema(df.schema).parquet(path)
    table._scratch_path = path
    return table


def discard(*tables: DataFrame) -> None:
    """Remove tables of ``materialize`` that nothing will read again.

    Only for tables whose readers have all been written themselves: a lost
    task of an unwritten reader would look for the files.
    """
    for table in tables:
        path = table.sparkSession._jvm.org.apache.hadoop.fs.Path(table._scratch_path)
        path.getFileSystem(table.sparkSession.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """Redistribute a table scan that has fewer partitions than there are cores.

    For costly narrow work on a few large files or row groups; a table with
    enough splits is left alone. Call it on a scan only: asking a frame with
    a shuffle for its partitions would run that shuffle.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df if df.rdd.getNumPartitions() >= cores else df.repartition(cores, *keys)
