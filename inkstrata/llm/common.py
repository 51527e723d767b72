"""Helpers that the training-data operators share: text slices, skew-safe joins, ranks."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import stash

#: Above this many rows of (long) keys nothing is broadcast; a shuffle join takes over.
BROADCAST_ROWS = 500_000
#: Bits of the largest filter that stands for more keys (32 MB).
FILTER_BITS = 1 << 28
#: Up to this many rows, whatever their keys, a table is broadcast rather than split by its keys.
SMALL_ROWS = 10_000
#: A key is hot if it holds at least 1/HOT_SHARE of all rows, so there are never more than HOT_SHARE hot keys.
HOT_SHARE = 1_000
#: Arrow batches are worked on in slices of at most this many bytes of text.
SLICE_BYTES = 4 << 20


def id_and_text(df: DataFrame, *more: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Only the columns that an operator needs, so that others may have any name; null text counts as empty."""
    return df.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"), *(F.col(c) for c in more))


def slices(batches: Iterator[pa.RecordBatch], text: str = "text", limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Cuts Arrow batches so that each slice has at most ``limit`` bytes of text, or one row."""
    for batch in batches:
        ends = pc.cumulative_sum(pc.fill_null(pc.binary_length(batch.column(text)), 0).cast(pa.int64())).to_numpy()
        at = 0
        while at < batch.num_rows:
            base = ends[at - 1] if at else 0
            to = max(at + 1, int(ends.searchsorted(base + limit, side="right")))
            yield batch.slice(at, to - at)
            at = to


def utf8(batch: pa.RecordBatch, text: str = "text") -> list[bytes]:
    """The texts of a batch as bytes; null is empty."""
    return pc.fill_null(batch.column(text), "").cast(pa.binary()).to_pylist()


def by_size(df: DataFrame, keys: DataFrame, on: str, how: str) -> DataFrame:
    """Inner, semi or anti join with ``keys`` on the right, broadcast only if a count shows that it is small.

    Beyond that a filter of the keys (of bounded size) is broadcast, so that only rows that it lets through, the matching ones and a few
    others, are shuffled: the texts of all others stay where they are.
    """
    n = keys.count()
    if n <= BROADCAST_ROWS:
        return df.join(F.broadcast(keys), on, how)
    bits = 1 << 15
    while bits < min(16 * n, FILTER_BITS):
        bits *= 2
    place = lambda c: F.pmod(F.xxhash64(c), F.lit(bits))
    own = keys.select(place(on).alias("p")).distinct()
    parts = own.groupBy(F.shiftright("p", 15).alias("_part")).agg(F.bitmap_construct_agg(F.col("p").bitwiseAND(F.lit(32767))).alias("_set"))
    parts = stash(parts, "filter")  # FILTER_BITS / 32768 rows of 4 KB at most
    rows = df.withColumn("_place", place(on)).withColumn("_part", F.shiftright("_place", 15)).join(F.broadcast(parts), "_part", "left")
    byte = F.expr("conv(hex(substring(_set, int((_place & 32767) div 8) + 1, 1)), 16, 10)").cast("int")
    hit = F.coalesce(F.expr("_place & 7").cast("int"), F.lit(0))
    rows = rows.withColumn("_might", F.coalesce(F.call_function("shiftright", byte, hit).bitwiseAND(F.lit(1)) == 1, F.lit(False))).drop("_place", "_part", "_set")
    some = rows.where("_might").drop("_might").join(keys, on, how)
    return some if how != "left_anti" else rows.where("not _might").drop("_might").unionByName(some)


def join_hot(left: DataFrame, right: DataFrame, key: str, n: str, rows: int) -> DataFrame:
    """Inner join where ``right`` has one row a key and ``n`` says how many rows of ``left`` have that key.

    Keys with at least ``rows / HOT_SHARE`` rows (at most HOT_SHARE of them) are joined by broadcast and never shuffled,
    the others by shuffle, so that no task gets more than about that share of the rows for one key. A ``right`` that a count
    shows to be small is broadcast as a whole.
    """
    if right.count() <= SMALL_ROWS:
        return left.join(F.broadcast(right), key)
    hot = F.col(n) * HOT_SHARE >= F.lit(rows)
    most = right.where(hot)
    out = left.join(F.broadcast(most), key)
    rest = left.join(F.broadcast(most.select(key)), key, "left_anti").join(right.where(~hot), key)
    return out.unionByName(rest)


def positions(df: DataFrame, order: Sequence, tag: str = "ranked") -> tuple[DataFrame, int]:
    """``df`` with ``_pos``, the row's place from 0 in the order of ``order``; also the number of rows.

    One range shuffle; ranks come from the sorted partitions' sizes, so no task ever sees all rows. The driver gets
    one number for each partition.
    """
    spark = df.sparkSession
    ranged = stash(
        df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_id", F.monotonically_increasing_id()), tag
    )
    part = F.shiftright("_id", 33)
    sizes = {r["p"]: r["n"] for r in ranged.groupBy(part.alias("p")).agg(F.count("*").alias("n")).collect()}
    start, rows = 0, []
    for p in sorted(sizes):
        rows.append((p, start))
        start += sizes[p]
    starts = spark.createDataFrame(rows, "_part long, _start long")
    out = ranged.withColumn("_part", part.cast("long")).join(F.broadcast(starts), "_part")
    return out.withColumn("_pos", F.col("_start") + F.col("_id").bitwiseAND(F.lit((1 << 33) - 1))).drop("_id", "_part", "_start"), start
