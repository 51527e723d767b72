"""Sharding by proportional stratified interleaving.

Within each source rows are put in a seeded random order; the r-th of n rows gets the fractional rank (2 r + 1) / (2 n).
Sorted by that, the sources are interleaved in proportion everywhere, so any cut into equal runs matches the mixture. Shards
are such runs: their row counts differ by one at most (the ``rows`` law).

Defined cases: null sources are a source of their own; null doc_ids and repeated rows are rows like any other (rows equal in
id, size and checksum are interchangeable); null text has size 16; fewer rows than shards leave some shards empty; an empty table
gives an empty result. Other columns are never looked at (write_shards carries them along). Of a text only its size and its checksum
travel, so very long ones are like any other.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import join_hot, positions

SHARDS = 40
SEED = 17
#: Bytes that a row counts besides its text.
ROW_BYTES = 16


def ranked(rows: DataFrame, seed: int, ties: list[str], source: str = "source", id_col: str = "doc_id") -> tuple[DataFrame, int]:
    """Adds _stratum (source, null told apart), _key (seeded shuffle), _rank within the source from 0 and _n, its rows.

    One range shuffle by (source, key): a large source spans many partitions, and ranks are differences of places.
    """
    keyed = rows.withColumn("_stratum", F.coalesce(F.concat(F.lit("="), F.col(source).cast("string")), F.lit("null"))).withColumn(
        # The SHA-1's first 60 bits as a number: its order is that of the digits, and range samples are small.
        "_key", F.conv(F.substring(F.sha1(F.concat(F.lit(f"{seed}|"), F.coalesce(F.col(id_col).cast("string"), F.lit("null")))), 1, 15), 16, 10).cast("long")
    )
    placed, total = positions(keyed, ["_stratum", "_key", *ties])
    sizes = placed.groupBy("_stratum").agg(F.min("_pos").alias("_first"), F.count("*").alias("_n"))
    out = join_hot(placed, sizes, "_stratum", "_n", total)
    return out.withColumn("_rank", F.col("_pos") - F.col("_first")).drop("_pos", "_first"), total


def stratified_shards(df: DataFrame, shards: int = SHARDS, seed: int = SEED, source: str = "source", id_col: str = "doc_id", text_col: str = "text", carry: tuple = ()) -> DataFrame:
    """doc_id, size, text_crc32, shard, slot for each row, and the columns of ``carry``."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = df.select(
        F.col(id_col).alias("doc_id"), F.col(source).alias("_source"),
        (F.octet_length(text) + ROW_BYTES).cast("long").alias("size"), F.crc32(text).alias("text_crc32"), *[F.col(c).alias(f"_carry_{c}") for c in carry],
    )
    ties = ["doc_id", "size", "text_crc32"]
    in_source, total = ranked(rows, seed, ties, "_source", "doc_id")
    mixed = in_source.withColumn("_fraction", (F.col("_rank") * 2 + 1) / (F.col("_n") * 2))
    placed, total = positions(mixed, ["_fraction", "_stratum", "_key", *ties], "mixed")
    at = F.col("_pos")
    out = placed.withColumn("shard", F.expr(f"int(_pos * {shards} div {max(total, 1)})")).withColumn(
        "slot", at - F.expr(f"(shard * {total} + {shards - 1}) div {shards}")
    )
    return out.select("doc_id", "size", "text_crc32", "shard", "slot", *[F.col(f"_carry_{c}").alias(c) for c in carry])


def write_shards(df: DataFrame, path: str, shards: int = SHARDS, seed: int = SEED, **cols) -> None:
    """Writes the rows of ``df`` as one folder a shard, each sorted by slot."""
    names = [c for c in df.columns if c not in ("shard", "slot", "size", "text_crc32")]
    rows = stratified_shards(df, shards, seed, carry=tuple(f"`{c}`" if "." in c else c for c in names if c != cols.get("id_col", "doc_id")), **cols)
    rows.repartitionById(shards, F.col("shard")).sortWithinPartitions("slot").write.partitionBy("shard").parquet(path)
