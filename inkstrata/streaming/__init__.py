"""Increments. Chunking and pairs work within a row, so they run on a stream of documents as they are, and the corpus grows by what each batch adds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..config import Chunking
from ..operators import chunking, corpus


def chunks(docs: DataFrame, c: Chunking = Chunking()) -> DataFrame:
    """Chunks of a stream of documents (doc_id, source, text): stateless, in append mode."""
    return chunking.chunk(chunking.records(docs), c)


def grow_corpus(docs: DataFrame, path: str, checkpoint: str, c: Chunking = Chunking()) -> StreamingQuery:
    """Appends each batch's new chunks to the corpus at ``path``. A batch that runs again adds nothing, as its ids are there."""

    def add(batch: DataFrame, _: int) -> None:
        from pyspark.errors import AnalysisException

        new = corpus.dedupe(batch)
        try:
            new = new.join(batch.sparkSession.read.parquet(path).select("chunk_id"), "chunk_id", "left_anti")
        except AnalysisException:
            pass  # the first batch
        new.withColumn("added", F.current_date()).write.mode("append").parquet(path)

    return chunks(docs, c).writeStream.foreachBatch(add).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
