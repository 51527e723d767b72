"""The retrieval corpus from stored chunks, or from the catalog."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import Settings
from ..operators import chunking, corpus
from ..session import stash
from ..sources import catalog, readers, writers

VERSION = "v0.1.0"


def build(spark: SparkSession, chunks_path: str | None = None, ids: list[str] | None = None, most: int = 3, c: Settings = Settings()) -> tuple[DataFrame, dict]:
    """(corpus, manifest): stored chunks if there are any at the path, else the catalog's samples, chunked."""
    from pyspark.errors import AnalysisException

    chunks, origin = None, "offline_fixtures"
    if chunks_path is not None:
        try:
            # Lines have no number of their own; a row's place in its file stands for the order of arrival.
            rows = readers.read(spark, chunks_path, "chunk")
            chunks = rows.withColumn("pos", F.monotonically_increasing_id()).withColumn("block", F.lit(0))
            origin = f"stored chunks: {chunks_path}"
        except AnalysisException:
            pass
    if chunks is None:
        chunks = chunking.chunk(catalog.load_all(spark, ids, most), c.chunking)
    found = stash(corpus.dedupe(stash(chunks, "chunks")), "corpus")
    per = {r["source_id"]: r["n_chunks"] for r in corpus.manifest(found).orderBy("source_id").collect()}  # a row a source
    return found, {
        "version": VERSION, "n_chunks": sum(per.values()), "n_documents": len(per), "sources": per, "license_notes": catalog.license_notes(),
        "created_utc": writers.now(), "input_path": chunks_path if origin.startswith("stored") else None, "notes": f"Origin={origin}.",
    }
