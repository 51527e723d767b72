"""The retrieval corpus: chunks, one for each id, and its manifest."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T

ORDER = ("pos", "block", "start_sentence")


def dedupe(chunks: DataFrame, order: tuple[str, ...] = ORDER) -> DataFrame:
    """Of equal chunk ids the first non-blank one stays, with n_propositions (also in the metadata) in place of the propositions.

    Rows without an id get the one that their content gives.
    """
    own = T.chunk_id(F.col("source_id"), F.col("section"), F.col("start_sentence"), F.col("end_sentence"), F.col("text"))
    rows = chunks.where(T.strip(F.col("text")) != "").withColumn("chunk_id", F.coalesce(F.nullif(F.col("chunk_id"), F.lit("")), own))
    rows = rows.withColumn("n_propositions", F.size("propositions")).drop("propositions")
    if "metadata" in rows.columns:
        count = F.create_map(F.lit("n_propositions"), F.col("n_propositions").cast("string"))
        rows = rows.withColumn("metadata", F.map_concat(F.map_filter("metadata", lambda k, _: k != "n_propositions"), count))
    w = Window.partitionBy("chunk_id").orderBy(*order)
    return rows.withColumn("_first", F.row_number().over(w)).where("_first = 1").drop("_first")


def manifest(corpus: DataFrame) -> DataFrame:
    """One row a source: its chunks, and the corpus' chunks and sources (which count as its documents)."""
    per = corpus.groupBy("source_id").agg(F.count("*").alias("n_chunks"))
    total = per.agg(F.sum("n_chunks").alias("total_chunks"), F.count("*").alias("n_documents"))
    return per.crossJoin(F.broadcast(total))  # one row
