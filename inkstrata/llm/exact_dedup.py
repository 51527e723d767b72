"""Exact deduplication by composable polynomial fingerprints.

The fingerprint of a text is its UTF-8 bytes read as a polynomial, modulo two primes. It composes: if text = a + b, then
H(text) = H(a) * B ** len(b) + H(b), so chunks of a huge document are hashed in parallel tasks, each shifted by the length
of what follows, and summed by Spark. Texts with equal fingerprints are compared chunk by chunk in a stream; where the
comparison finds two texts under one fingerprint, that fingerprint's rows are told apart by their SHA-256.

Defined cases: null text is the empty text (all such rows are equal). Null doc_id sorts below every other; a group of only
null ids has a null keep_id and keeps one row. Of rows that repeat the largest doc_id of a group, one copy is kept.
An empty table gives an empty result. Other columns are never looked at. Very long texts are hashed in chunks by several tasks.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import stash
from .common import BROADCAST_ROWS, by_size, id_and_text, join_hot, slices, utf8

#: (prime, base) of the two polynomials: fixed values.
FIELDS = ((2_147_483_647, 1_315_423_911), (2_147_483_629, 1_020_304_057))
CHUNK = 1 << 16
#: Longer texts (bytes) are hashed in chunks by several tasks.
HUGE_BYTES = 4 << 20
#: A group up to this size is compared in one stream; a larger one in as many streams as each has rows.
STREAM_ROWS = 64


def _powers(prime: int, base: int) -> np.ndarray:
    out = np.ones(1, np.uint64)
    while len(out) < CHUNK:
        out = np.concatenate([out, out * np.uint64(pow(base, len(out), prime)) % np.uint64(prime)])
    return out[:CHUNK][::-1].copy()  # base ** (CHUNK - 1) first


_TABLES: dict = {}


def chunk_hash(data: np.ndarray, field: int) -> int:
    """H of at most CHUNK bytes. A sum of CHUNK products of 8 and 31 bits fits 64 bits, so one reduction is enough."""
    table = _TABLES.get(field)
    if table is None:
        table = _TABLES[field] = _powers(*FIELDS[field])
    return int(np.dot(data.astype(np.uint64), table[CHUNK - len(data) :]) % np.uint64(FIELDS[field][0])) if len(data) else 0


def combine(a: int, b: int, len_b: int, field: int) -> int:
    """H(text a + text b) from H(a), H(b) and the bytes of b."""
    prime, base = FIELDS[field]
    return (a * pow(base, len_b, prime) + b) % prime


def polynomial(text: bytes, field: int) -> int:
    data, out = np.frombuffer(text, np.uint8), 0
    for at in range(0, len(data), CHUNK):
        piece = data[at : at + CHUNK]
        out = combine(out, chunk_hash(piece, field), len(piece), field)
    return out


def fingerprint(text: bytes) -> int:
    """Both polynomials in one long below 2 ** 62."""
    return polynomial(text, 0) << 31 | polynomial(text, 1)


def _fp_only(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The columns but for the text, and its fingerprint."""
    for b in slices(batches):
        fps = pa.array([fingerprint(t) for t in utf8(b)], pa.int64())
        keep = [i for i, n in enumerate(b.schema.names) if n != "text"]
        yield pa.RecordBatch.from_arrays([*[b.column(i) for i in keep], fps], names=[*[b.schema.names[i] for i in keep], "fp"])


def _chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Chunks of a huge text, each with the number of bytes that follow it."""
    for b in slices(batches):
        for uid, text in zip(b.column("uid").to_pylist(), utf8(b), strict=True):
            for at in range(0, len(text), HUGE_BYTES // 4):
                piece = text[at : at + HUGE_BYTES // 4]
                yield pa.RecordBatch.from_pydict(
                    {"uid": pa.array([uid], pa.int64()), "after": pa.array([len(text) - at - len(piece)], pa.int64()), "piece": pa.array([piece], pa.binary())}
                )


def _terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each chunk's hash, shifted by what follows: their sum modulo the prime is the text's hash."""
    for b in batches:
        found = [
            [polynomial(p, f) * pow(FIELDS[f][1], n, FIELDS[f][0]) % FIELDS[f][0] for f in (0, 1)]
            for p, n in zip(b.column("piece").to_pylist(), b.column("after").to_pylist(), strict=True)
        ]
        yield pa.RecordBatch.from_arrays(
            [b.column("uid"), pa.array([x[0] for x in found], pa.int64()), pa.array([x[1] for x in found], pa.int64())], names=["uid", "t0", "t1"]
        )


def _fields(df: DataFrame) -> str:
    return ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in df.schema.fields)


def fingerprints(docs: DataFrame, huge_bytes: int = HUGE_BYTES) -> DataFrame:
    """(doc_id, text_sha256, h, fp) of (doc_id, text), one row a row; h is what a text is found by later, without hashing it again by
    polynomials. Texts over ``huge_bytes`` are hashed by several tasks."""
    rows = docs.withColumn("text_sha256", F.sha2(F.col("text"), 256)).withColumn("h", F.xxhash64("text"))
    small = rows.where(F.octet_length("text") <= huge_bytes)
    out = small.mapInArrow(_fp_only, _fields(small.drop("text")) + ", fp long")
    huge = stash(rows.where(F.octet_length("text") > huge_bytes).withColumn("uid", F.monotonically_increasing_id()), "huge")
    if huge.isEmpty():
        return out
    pieces = huge.select("uid", "text").mapInArrow(_chunks, "uid long, after long, piece binary")
    spread = pieces.repartition(max(2, docs.sparkSession.sparkContext.defaultParallelism))
    sums = (
        spread.mapInArrow(_terms, "uid long, t0 long, t1 long").groupBy("uid")
        .agg((F.shiftleft(F.sum("t0") % FIELDS[0][0], 31) + F.sum("t1") % FIELDS[1][0]).alias("fp"))
    )
    return out.unionByName(huge.drop("text").join(sums, "uid").drop("uid"))


def same(a: bytes, b: bytes) -> bool:
    """Chunkwise comparison; ends at the first chunk that differs."""
    return len(a) == len(b) and all(a[i : i + CHUNK] == b[i : i + CHUNK] for i in range(0, len(a), CHUNK))


def _compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of rows sorted by (fp, salt): the first of each (clash false), and one that differs from it if there is one."""
    key, first, clashed = None, b"", False
    for b in slices(batches):
        out: list[tuple] = []
        for fp, salt, salts, text in zip(b.column("fp").to_pylist(), b.column("salt").to_pylist(), b.column("salts").to_pylist(), utf8(b), strict=True):
            if key != (fp, salt):
                key, first, clashed = (fp, salt), text, False
                if salts > 1:
                    out.append((fp, False, text.decode()))
            elif not clashed and not same(first, text):
                clashed = True
                out.append((fp, True, ""))
        yield pa.RecordBatch.from_arrays(
            [pa.array([x[0] for x in out], pa.int64()), pa.array([x[1] for x in out], pa.bool_()), pa.array([x[2] for x in out], pa.string())],
            names=["fp", "clash", "text"],
        )


def _stream(rows: DataFrame) -> DataFrame:
    dealt = rows.repartition("fp", "salt").sortWithinPartitions("fp", "salt")
    return dealt.select("fp", "salt", "salts", "text").mapInArrow(_compare, "fp long, clash boolean, text string")


def clashes(docs: DataFrame, prints: DataFrame) -> DataFrame:
    """Fingerprints (of prints: h, fp) under which the streams found different texts.

    Only texts that share a fingerprint are shuffled; they are found by h. (Different texts with one h may come under each other's
    fingerprint; their rows are told apart as those of any clash are.) A group of n > STREAM_ROWS rows is dealt, row by row, over
    sqrt(n) streams of about sqrt(n) rows; the streams' first rows are then compared with each other.
    """
    each = stash(prints.groupBy("h", "fp").agg(F.count("*").alias("n")), "texts")
    groups = each.groupBy("fp").agg(F.sum("n").alias("n")).where("n > 1")
    salts = F.when(F.col("n") <= STREAM_ROWS, F.lit(1).cast("long")).otherwise(F.ceil(F.sqrt("n"))).alias("salts")
    shared = stash(each.select("h", "fp").join(groups, "fp").select("h", "fp", salts), "shared")
    rows = by_size(docs.withColumn("h", F.xxhash64("text")), shared, "h", "inner").withColumn("salt", F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.col("salts")))
    found = stash(_stream(rows), "compared")
    firsts = found.where("not clash").withColumn("salt", F.lit(0).cast("long")).withColumn("salts", F.lit(1).cast("long"))
    return found.where("clash").select("fp").unionByName(_stream(firsts).where("clash").select("fp")).distinct()


def exact_groups(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row a row of ``df``: doc_id, keep_id, group_size, kept, text_sha256."""
    docs = id_and_text(df, id_col=id_col, text_col=text_col)
    prints = stash(fingerprints(docs), "prints")
    bad = stash(clashes(docs, prints), "clashes")
    rows = prints.withColumn("sub", F.lit(""))
    if (n_bad := bad.count()) > 0:
        told = bad.withColumn("bad", F.lit(True))
        rows = prints.join(F.broadcast(told) if n_bad <= BROADCAST_ROWS else told, "fp", "left")
        rows = rows.withColumn("sub", F.when(F.col("bad"), F.col("text_sha256")).otherwise("")).drop("bad")
    rows = rows.withColumn("key", F.struct("fp", "sub"))
    # Copies of a row count together, so one of them can be the one that stays.
    each = stash(rows.groupBy("key", "doc_id").agg(F.count("*").alias("copies"), F.first("text_sha256").alias("text_sha256")), "each")
    best = stash(each.groupBy("key").agg(F.sum("copies").alias("group_size"), F.count("*").alias("ids"), F.max("doc_id").alias("keep_id")), "best")
    total = each.count()
    out = join_hot(each, best, "key", "ids", total).withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))))
    return out.select(
        "doc_id", "keep_id", "group_size", (F.col("doc_id").eqNullSafe(F.col("keep_id")) & (F.col("copy") == 1)).alias("kept"), "text_sha256"
    )


def drop_exact(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``df`` without the rows that exact_groups doesn't keep; columns unchanged."""
    found = stash(exact_groups(df, id_col, text_col), "exact")
    return keep_kept(df, found, [F.col(id_col), F.sha2(F.coalesce(F.col(text_col), F.lit("")), 256)], ["doc_id", "text_sha256"])


def keep_kept(df: DataFrame, found: DataFrame, key: list, names: list[str]) -> DataFrame:
    """Rows of ``df`` of which ``found`` (columns ``names``, kept) keeps one; ``key`` gives the same columns from ``df``.

    The rows to drop are mostly few: they are broadcast if a count allows it, so that the texts aren't shuffled.
    Rows that repeat a key are first reduced to one.
    """
    mark = F.md5(F.concat_ws("|", *[F.coalesce(F.col(c).cast("string"), F.lit("null")) for c in names]))
    per = stash(
        found.select(mark.alias("_inkstrata_key"), "kept").groupBy("_inkstrata_key").agg(F.max("kept").alias("kept"), F.count("*").alias("n")).where("not kept or n > 1"), "per"
    )
    own = F.md5(F.concat_ws("|", *[F.coalesce(c.cast("string"), F.lit("null")) for c in key]))
    rows = df.withColumn("_inkstrata_key", own)
    out = by_size(rows, per.select("_inkstrata_key"), "_inkstrata_key", "left_anti")
    again = per.where("kept").select("_inkstrata_key")
    if not again.isEmpty():
        out = out.unionByName(by_size(rows, again, "_inkstrata_key", "left_semi").dropDuplicates(["_inkstrata_key"]))
    return out.drop("_inkstrata_key")
