"""SimHash near-duplicates by meet-in-the-middle ball hashing.

A fingerprint is the bitwise majority of the XXH64 hashes (seed 42) of a text's word shingles. Two fingerprints at distance
r or less have a point within r / 2 of both, so every distinct fingerprint emits all variants within half the radius,
variants are shuffled, and those that meet are candidates. Around one variant at most 1 + 64 fingerprints can meet (for
radius 2), so groups are bounded by the method itself; each is linked to its least member, verified by the distance, and
links are deduplicated. Chains of links are followed to whole components.

Defined cases: null text is the empty text; texts without a word have fingerprint zero, which links like any other; texts
with fewer words than a shingle have one shingle. Null doc_ids are passed over in the least id of a component, which is
null only if all its ids are; drop_near keeps a row of each component, also of those that share an id or have none. Repeated rows give repeated rows. An empty table gives an empty result. Other columns are
never looked at. Very long texts are read whole, in time in proportion to their length.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import partial
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import stash
from .common import id_and_text, join_hot, slices, utf8
from .components import components
from .exact_dedup import keep_kept

SHINGLE = 3
RADIUS = 2
SEED = 42


def shingle_hashes(text: bytes, words: int = SHINGLE) -> np.ndarray:
    """XXH64 of each shingle of the lower-cased (A-Z) text, repeats included. bytes.split() cuts at x20 and x09 to x0D."""
    parts = text.lower().split()
    if not parts:
        return np.zeros(0, np.uint64)
    line = b" ".join(parts)
    if len(parts) <= words:
        return np.array([xxhash.xxh64_intdigest(line, SEED)], np.uint64)
    ends = np.cumsum(np.fromiter(map(len, parts), np.int64, len(parts)) + 1) - 1
    starts = np.concatenate([[0], ends[: len(parts) - words] + 1]).tolist()
    digest = xxhash.xxh64_intdigest
    return np.array([digest(line[a:b], SEED) for a, b in zip(starts, ends[words - 1 :].tolist(), strict=True)], np.uint64)


def votes(hashes: np.ndarray, words: int = 1) -> np.ndarray:
    """How many of the hashes have each of 64 * ``words`` bits set. Bits beyond the hashes' own are those of hashes of them."""
    ones = np.zeros((words, 64), np.int64)
    for at in range(0, len(hashes), 1 << 15):
        part = hashes[at : at + (1 << 15)]
        for w in range(words):
            ones[w] += np.unpackbits(_again(part, w).astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int32)
    return ones.ravel()


def _again(hashes: np.ndarray, w: int) -> np.ndarray:
    """The hashes themselves for w = 0, else others made of them (the finalizer of SplitMix64)."""
    if not w:
        return hashes
    out = hashes + np.uint64(w * 0x9E3779B97F4A7C15 & (1 << 64) - 1)
    out = (out ^ (out >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    out = (out ^ (out >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return out ^ (out >> np.uint64(31))


def majority(ones: np.ndarray, n: int) -> int:
    """The fingerprint of 64 bits: 1 where more than half of n hashes have it. Unsigned."""
    return int(np.packbits(2 * ones > n, bitorder="little").view("<u8")[0])


def simhash(text: bytes, words: int = SHINGLE) -> int:
    """A bit is 1 if it is set in more than half the hashes. Unsigned."""
    hashes = shingle_hashes(text, words)
    return majority(votes(hashes), len(hashes))


def ball_points(ones: np.ndarray, n: int, bits: int, segments: int, flips: int) -> np.ndarray:
    """Of each segment of a fingerprint: itself, and each variant with one of its ``flips`` least certain bits flipped.

    The bits in which alike texts differ are those with votes near the half, so the whole ball of ``bits`` variants isn't needed.
    Segments that differ in up to two such bits meet in the middle. A point's upper bits are the segment's number.
    """
    over = (2 * ones[: segments * bits] - n).reshape(segments, bits)
    own = ((over > 0) << np.arange(bits)).sum(axis=1) + (np.arange(segments) << bits)
    unsure = np.argsort(np.abs(over), axis=1, kind="stable")[:, :flips]
    return np.concatenate([own[:, None], own[:, None] ^ (1 << unsure)], axis=1).ravel()


def _prints(batches: Iterator[pa.RecordBatch], words: int) -> Iterator[pa.RecordBatch]:
    for b in slices(batches):
        fps = pa.array(np.array([simhash(t, words) for t in utf8(b)], np.uint64).view(np.int64))
        yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("text_sha256"), fps], names=["doc_id", "text_sha256", "fp"])


def fingerprints(df: DataFrame, words: int = SHINGLE, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, text_sha256, fp) for each row; fp is the unsigned fingerprint in a long's bits."""
    docs = id_and_text(df, id_col=id_col, text_col=text_col)
    kind = docs.schema["doc_id"].dataType.simpleString()
    with_sha = docs.withColumn("text_sha256", F.sha2("text", 256))
    return with_sha.mapInArrow(partial(_prints, words=words), f"doc_id {kind}, text_sha256 string, fp long")


def variants(radius: int) -> list[int]:
    """Masks of all flips of at most ``radius`` of 64 bits, as signed longs."""
    masks = [sum(1 << b for b in c) for k in range(radius + 1) for c in combinations(range(64), k)]
    return [m - (1 << 64) if m >> 63 else m for m in masks]


def links(prints: DataFrame, radius: int = RADIUS) -> DataFrame:
    """(u, v): links between distinct fingerprints (column fp) that connect all pairs at distance ``radius`` (even) or less.

    All that meet at a variant are within radius / 2 of it and so within the radius of each other: a star around the least of
    them connects them, and no more pairs than members are made.
    """
    if radius % 2:
        raise ValueError("the radius must be even, for two halves of it to meet")
    masks = F.array(*[F.lit(m).cast("long") for m in variants(radius // 2)])
    # The few bytes of a fingerprint become 65 rows, so they are dealt over all cores first.
    dealt = prints.select("fp").repartition(max(1, int(prints.sparkSession.conf.get("spark.sql.shuffle.partitions"))))
    near = dealt.select("fp", F.explode(masks).alias("m")).select("fp", F.col("fp").bitwiseXOR(F.col("m")).alias("variant"))
    met = near.withColumn("least", F.min("fp").over(Window.partitionBy("variant")))
    pairs = met.where("fp != least").select(F.col("fp").alias("u"), F.col("least").alias("v"))
    return pairs.where(F.bit_count(F.col("u").bitwiseXOR(F.col("v"))) <= radius).distinct()


def rooted(prints: DataFrame, linked: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """One row a row of ``prints`` (doc_id, text_sha256, fp): also root and component_id. ``linked`` gives (u, v) from distinct fps."""
    distinct = stash(prints.groupBy("fp").agg(F.min("doc_id").alias("least"), F.count("*").alias("n")), "distinct")
    roots = components(linked(distinct.select("fp")))
    named = distinct.join(roots, distinct.fp == roots.node, "left").select("fp", "least", "n", F.coalesce("root", "fp").alias("root"))
    named = stash(named, "named")
    ids = named.groupBy("root").agg(F.min("least").alias("component_id"), F.count("*").alias("members"))
    per_fp = join_hot(named, ids, "root", "members", distinct.count()).select("fp", "n", "root", "component_id")
    out = join_hot(prints, stash(per_fp, "components"), "fp", "n", prints.count())
    return out.select("doc_id", "text_sha256", "fp", "root", "component_id")


def _rooted(df: DataFrame, words: int, radius: int, id_col: str, text_col: str) -> DataFrame:
    return rooted(stash(fingerprints(df, words, id_col, text_col), "simhash"), partial(links, radius=radius))


def near_groups(df: DataFrame, words: int = SHINGLE, radius: int = RADIUS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row a row of ``df``: doc_id, text_sha256, fp, component_id (the least doc_id that is reachable)."""
    return _rooted(df, words, radius, id_col, text_col).drop("root")


def drop_near(df: DataFrame, words: int = SHINGLE, radius: int = RADIUS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``df`` with one row of each component: that of the least doc_id, or of these the least SHA-256 of its text."""
    return drop_rooted(df, _rooted(df, words, radius, id_col, text_col), id_col, text_col)


def drop_rooted(df: DataFrame, found: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``df`` with the row to keep of each component of ``found`` (as rooted gives it)."""
    # A component's own row is one with its id (null if all are); only rows that share that id have to be told apart.
    own = found.where(F.col("doc_id").eqNullSafe(F.col("component_id"))).select("root", "doc_id", "text_sha256")
    best = own.groupBy("root").agg(F.min("text_sha256").alias("best"))
    kept = own.join(best, "root").select("doc_id", "text_sha256", (F.col("text_sha256") == F.col("best")).alias("kept"))
    rest = found.where(~F.col("doc_id").eqNullSafe(F.col("component_id"))).select("doc_id", "text_sha256", F.lit(False).alias("kept"))
    marked = stash(kept.unionByName(rest), "near")
    return keep_kept(df, marked, [F.col(id_col), F.sha2(F.coalesce(F.col(text_col), F.lit("")), 256)], ["doc_id", "text_sha256"])
