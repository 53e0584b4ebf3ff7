"""JSON request lines to resolved requests, broken lines set aside."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.answer import prepare
from ..sources.chat import parse_requests
from .sink import run_to_table


def request_stream(lines: DataFrame) -> DataFrame:
    """Parsed and resolved requests; ``accepted`` is false for the lines that are set aside.

    One narrow pass: a line is parsed once, whatever becomes of it.
    """
    return prepare(parse_requests(lines)).withColumn("accepted", F.col("problem").isNull())


def run_requests(lines: DataFrame, path: str, checkpoint: str) -> tuple[DataFrame, DataFrame]:
    """Run the stream over what is available: the requests, and the quarantine (``line, file, problem``).

    Both are folders of one table that the file sink writes exactly once, so
    no line is in neither and none in both.
    """
    table = run_to_table(request_stream(lines), path, checkpoint, by=("accepted",))
    requests = table.where("accepted").drop("accepted", "problem", "line", "file")
    return requests, table.where("NOT accepted").select("line", "file", "problem")
