"""Incremental index building."""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame

from ..operators.chunks import ChunkParser, hierarchical_parser
from ..operators.embed import embed_hash
from ..plans.ingest import element_documents
from ..sources.index import Collection
from .sink import run_batches


def ingest_stream(
    elements: DataFrame,
    collection: Collection,
    checkpoint: str,
    parser: ChunkParser | None = None,
    embed=embed_hash,
) -> None:
    """Chunk, embed and add the elements that arrived since the last run.

    Documents that another batch has stored are left out before chunking,
    by their ids alone, and a micro-batch has its own folder in the index, so
    one that runs twice stores nothing twice and nothing is embedded twice.
    """
    stream = hashlib.sha256(checkpoint.encode()).hexdigest()[:12]

    def add(batch: DataFrame, number: int) -> None:
        name = f"{stream}-{number}"
        fresh = collection.unknown_documents(element_documents(batch), name)
        nodes = (parser or hierarchical_parser())(fresh)
        collection.add(embed(nodes, "text"), batch=name)

    run_batches(elements, add, checkpoint)
