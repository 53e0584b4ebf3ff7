"""File listings."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import base_name

LISTING = ["path", "modificationTime", "length"]


def scan_folder(spark: SparkSession, folder: str, with_content: bool = False) -> DataFrame:
    """Files directly in ``folder`` ending in lower-case ``.pdf``."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.pdf").load(folder)
    return files if with_content else files.select(*LISTING)


def scan_tree(spark: SparkSession, folder: str) -> DataFrame:
    """As ``scan_folder``, below ``folder`` at any depth, one file per base name."""
    files = (
        spark.read.format("binaryFile")
        .option("pathGlobFilter", "*.pdf")
        .option("recursiveFileLookup", "true")
        .load(folder)
    )
    return one_per_name(files.select(*LISTING))


def one_per_name(listing: DataFrame) -> DataFrame:
    """On a name clash the newest file wins, then the greatest path.

    A partial aggregate, so a base name shared by very many files is no hot
    group.
    """
    newest = F.max(F.struct("modificationTime", "path", "length")).alias("f")
    return (
        listing.where(F.col("path").endswith(".pdf"))
        .groupBy(base_name(F.col("path")).alias("filename"))
        .agg(newest)
        .select("filename", "f.path", "f.modificationTime", "f.length")
    )
