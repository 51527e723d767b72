"""An interpolated modified Kneser-Ney bigram model, counted by Spark, kept as sorted arrays and memory-mapped by workers.

Counting: tasks count the words (then the word pairs) of their texts in numpy and send compressed, sorted blocks of keys
and counts, one for each range of shards; blocks are merged in levels. On each level a task merges the blocks of one range that at most
FAN senders made, and sends on one block for each of at most 2 ** SPLIT narrower ranges, until the ranges are single shards and one sender
is left. So neither the number of blocks nor the size of a merge grows with the input, and the followers of a frequent context come
together in a tree. Vocabulary shards are ranges of 64-bit word hashes,
so a word's id is its place in the sorted hash arrays. Pairs are keys of two ids; a pair's shard depends on its context and on
the block of a million ids that its word falls into, so a frequent context is spread over many shards. What the driver sees is
a row of totals for each shard.

Storage: ``spark.checkpoint.dir``/lm-.../: for each vocabulary shard its hashes, counts, continuation counts, context totals
and backoff weights; for each pair shard its keys and counts (as narrow as its largest count allows, up to 64 bits). Workers map these
files; of a store that isn't a mounted file system they hold the arrays in use in memory, HELD_BYTES at most. Files are replaced
atomically, so a task that runs again does no harm; they are removed when the driver ends.

The model has order 2: its pairs alone are about half as many as the tokens here. Triples are estimated to take about as much
disk again as the pairs (see the README); order 3 has been neither built nor measured.

Defined cases: null text is one end token. Null doc_ids hash as the empty string (held out); repeated rows are rows like any
other. Without training tokens every token has probability 1 / (V + 1) = 1. Other columns are never looked at. More than
2 ** 32 different words raise an error.
"""

from __future__ import annotations

import os
import uuid
from collections import OrderedDict
from collections.abc import Iterator
from dataclasses import dataclass, field, replace
from functools import partial

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import new_path, remove_at_end, stash
from .common import id_and_text, slices, utf8

FOLDS = 10
#: Bytes of text for each shard; a shard is merged in one task's memory.
SHARD_BYTES = 32 << 20
#: A task sends its counts when it holds so many keys.
MOST_KEYS = 1_500_000
#: Senders whose blocks are merged at once, and bits by which ranges get narrower, on each level.
FAN, SPLIT = 64, 8
#: Bytes of arrays that a worker holds of a model on a store that isn't mounted.
HELD_BYTES = 256 << 20
END, BEGIN = b"\n", b" "  # neither can be a word
_MIX = np.uint64(0x9E3779B97F4A7C15)


# Files of the model.


def _local(root: str) -> str | None:
    """The path of a root in a file system that is mounted everywhere, or None for another store."""
    if root.startswith("file:"):
        return "/" + root[5:].lstrip("/")
    return root if root.startswith("/") else None


def save(root: str, name: str, data: np.ndarray) -> None:
    if (folder := _local(root)) is not None:
        os.makedirs(folder, exist_ok=True)
        part = f"{folder}/.{name}.{uuid.uuid4().hex}"
        data.tofile(part)
        os.replace(part, f"{folder}/{name}")
    else:
        from pyarrow import fs

        store, path = fs.FileSystem.from_uri(root)
        store.create_dir(path, recursive=True)
        with store.open_output_stream(f"{path}/{name}") as f:
            f.write(data.tobytes())


_OPEN: OrderedDict[tuple[str, str], np.ndarray] = OrderedDict()


def load(root: str, name: str, kind: type) -> np.ndarray:
    """A mapped array, one mapping a worker process; or, of a store that isn't mounted, one of the arrays held last."""
    if (root, name) in _OPEN:
        _OPEN.move_to_end((root, name))
        return _OPEN[root, name]
    folder = _local(root)
    if folder is None:
        from pyarrow import fs

        store, path = fs.FileSystem.from_uri(root)
        with store.open_input_stream(f"{path}/{name}") as src:
            _OPEN[root, name] = np.frombuffer(src.read(), kind)
        held = sum(x.nbytes for (r, _), x in _OPEN.items() if _local(r) is None)
        for key in [k for k in _OPEN if _local(k[0]) is None][:-1]:
            if held <= HELD_BYTES:
                break
            held -= _OPEN.pop(key).nbytes
    else:
        empty = os.path.getsize(f"{folder}/{name}") == 0
        _OPEN[root, name] = np.zeros(0, kind) if empty else np.asarray(np.memmap(f"{folder}/{name}", kind, "r"))
    return _OPEN[root, name]


def narrow(counts: np.ndarray) -> np.ndarray:
    """In the narrowest unsigned type that holds them all."""
    most = int(counts.max(initial=0))
    return counts.astype(next(k for k in (np.uint8, np.uint16, np.uint32, np.uint64) if most <= np.iinfo(k).max))


def load_counts(root: str, name: str, n: int) -> np.ndarray:
    """``n`` counts, whose width follows from the file's size."""
    raw = load(root, name, np.uint8)
    return raw.view({1: np.uint8, 2: np.uint16, 4: np.uint32, 8: np.uint64}[len(raw) // n]) if n else np.zeros(0, np.uint8)


# Blocks of keys and counts.


def pack(*arrays: np.ndarray) -> bytes:
    """The first array, sorted, goes as differences; all are compressed."""
    first = np.diff(arrays[0], prepend=arrays[0].dtype.type(0))
    body = b"".join(np.ascontiguousarray(a.view(np.uint8).reshape(len(a), -1).T).tobytes() for a in (first, *arrays[1:]))
    return len(first).to_bytes(8, "little") + zstandard.ZstdCompressor(level=1).compress(body)


def unpack(block: bytes, *kinds: type) -> list[np.ndarray]:
    n = int.from_bytes(block[:8], "little")
    body, at, out = np.frombuffer(zstandard.ZstdDecompressor().decompress(block[8:]), np.uint8), 0, []
    for kind in kinds:
        size = np.dtype(kind).itemsize
        out.append(np.ascontiguousarray(body[at : at + n * size].reshape(size, n).T).view(kind).reshape(n))
        at += n * size
    out[0] = np.cumsum(out[0], dtype=kinds[0])
    return out


def summed(keys: np.ndarray, *values: np.ndarray) -> list[np.ndarray]:
    """Sorted distinct keys and the sums of their values."""
    order = np.argsort(keys, kind="stable")
    keys = keys[order]
    first = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]]) if len(keys) else np.zeros(0, np.int64)
    return [keys[first], *[np.add.reduceat(v[order], first) if len(keys) else v for v in values]]


# Words.


def tokens(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of the distinct words (END first, BEGIN second), the words of all texts as places in these, tokens a text."""
    seen: dict[bytes, int] = {END: 0, BEGIN: 1}
    parts, lens = [], np.empty(len(texts), np.int64)
    for k, t in enumerate(texts):
        words = t.lower().split()
        words.append(END)
        lens[k] = len(words)
        parts.append(np.fromiter((seen.setdefault(w, len(seen)) for w in words), np.int64, len(words)))
    hashes = np.fromiter((xxhash.xxh64_intdigest(w, 0) for w in seen), np.uint64, len(seen))
    return hashes, np.concatenate(parts) if parts else np.zeros(0, np.int64), lens


@dataclass(frozen=True)
class Model:
    """Where the files are, and the totals. bits: log2 of the number of shards of either kind."""

    root: str
    bits: int
    sizes: np.ndarray  # words of each vocabulary shard
    train_tokens: int = 0
    n_words: int = 0  # distinct training tokens, END included, BEGIN not
    pairs: int = 0
    pair_discounts: tuple = (0.0, 0.0, 0.0)
    word_discounts: tuple = (0.0, 0.0, 0.0)
    word_backoff: float = 0.0
    offsets: np.ndarray = field(default=None)

    def shards(self, keys: np.ndarray, pairs: bool) -> np.ndarray:
        return self.pair_shard(keys) if pairs else self.vocabulary_shard(keys)

    def vocabulary_shard(self, hashes: np.ndarray) -> np.ndarray:
        return (hashes >> np.uint64(64 - self.bits)).astype(np.int64)

    def pair_shard(self, keys: np.ndarray) -> np.ndarray:
        mixed = (keys >> np.uint64(20)) * _MIX
        mixed ^= mixed >> np.uint64(29)
        return ((mixed * _MIX) >> np.uint64(64 - self.bits)).astype(np.int64)


def _runs(shards: np.ndarray) -> Iterator[tuple[int, int, int]]:
    """(shard, from, to) of each run of equal numbers."""
    if len(shards):
        cuts = np.flatnonzero(np.diff(shards)) + 1
        for lo, hi in zip([0, *cuts.tolist()], [*cuts.tolist(), len(shards)], strict=True):
            yield int(shards[lo]), lo, hi


def _place(sorted_keys: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """Places of sorted keys in a sorted array, -1 where they aren't there."""
    if not len(sorted_keys):
        return np.full(len(keys), -1)
    at = np.minimum(np.searchsorted(sorted_keys, keys), len(sorted_keys) - 1)
    return np.where(sorted_keys[at] == keys, at, -1)


def word_ids(model: Model, hashes: np.ndarray) -> np.ndarray:
    """Ids of words, -1 for unknown ones."""
    order = np.argsort(hashes)
    out = np.full(len(hashes), -1, np.int64)
    own = hashes[order]
    for s, lo, hi in _runs(model.vocabulary_shard(own)):
        if model.sizes[s]:
            at = _place(load(model.root, f"word-{s}.hash", np.uint64), own[lo:hi])
            out[order[lo:hi]] = np.where(at >= 0, at + model.offsets[s], -1)
    return out


def word_values(model: Model, ids: np.ndarray, name: str, kind: type) -> np.ndarray:
    """A figure of each word, 0 for unknown ones."""
    order = np.argsort(ids, kind="stable")
    own = ids[order]
    out = np.zeros(len(ids), kind)
    for s, lo, hi in _runs(np.searchsorted(model.offsets, own, side="right") - 1):
        if s >= 0:
            out[order[lo:hi]] = load(model.root, f"word-{s}.{name}", kind)[own[lo:hi] - model.offsets[s]]
    return out


def pair_counts(model: Model, keys: np.ndarray) -> np.ndarray:
    """Counts of distinct sorted pairs, 0 for unknown ones."""
    shards = model.pair_shard(keys)
    order = np.argsort(shards, kind="stable")  # the keys of a shard stay sorted
    out = np.zeros(len(keys), np.int64)
    own, shards = keys[order], shards[order]
    for s, lo, hi in _runs(shards):
        keys = load(model.root, f"pair-{s}.key", np.uint64)
        at = _place(keys, own[lo:hi])
        counts = load_counts(model.root, f"pair-{s}.count", len(keys))
        out[order[lo:hi]] = np.where(at >= 0, counts[at].astype(np.int64), 0) if len(counts) else 0
    return out


# Counting.


def _blocks(shards: np.ndarray, sender: int, keys: np.ndarray, *values: np.ndarray) -> pa.RecordBatch:
    """Rows (part, sender, block): the keys and values of each range of shards."""
    order = np.argsort(shards, kind="stable")
    keys, values = keys[order], [v[order] for v in values]
    runs = list(_runs(shards[order]))
    packed = [pack(keys[a:b], *[v[a:b] for v in values]) for _, a, b in runs]
    return pa.RecordBatch.from_pydict({"part": pa.array([s for s, _, _ in runs], pa.int64()), "sender": pa.array([sender] * len(runs), pa.int64()), "block": pa.array(packed, pa.binary())})


_BLOCK = "part long, sender long, block binary"


def _count(batches: Iterator[pa.RecordBatch], model: Model, pairs: bool, bits: int) -> Iterator[pa.RecordBatch]:
    """Blocks of the counts of words, or of pairs, that this task has seen, for 2 ** bits ranges of shards."""
    held, n = [], 0

    def blocks() -> pa.RecordBatch:
        keys, counts = summed(np.concatenate([k for k, _ in held]), np.concatenate([c for _, c in held]))
        return _blocks(model.shards(keys, pairs) >> (model.bits - bits), TaskContext.get().partitionId(), keys, counts.astype(np.uint64))

    for b in slices(batches):
        hashes, words, lens = tokens(utf8(b))
        if pairs:
            ids = word_ids(model, hashes).astype(np.uint64)
            keys, counts = np.unique(pair_keys(ids[words], ids[1], lens), return_counts=True)
        else:
            keys, counts = hashes, np.bincount(words, minlength=len(hashes))
        held.append((keys, counts))
        n += len(keys)
        if n >= MOST_KEYS:
            yield blocks()
            held, n = [], 0
    if held:
        yield blocks()


def _merge_some(key: tuple, table: pa.Table, model: Model, pairs: bool, bits: int) -> pa.Table:
    """One block for each of the 2 ** bits narrower ranges, of the blocks of some senders."""
    keys, counts = _merged(table, 1)
    return pa.Table.from_batches([_blocks(model.shards(keys, pairs) >> (model.bits - bits), key[1].as_py(), keys, counts)])


def merged_blocks(docs: DataFrame, model: Model, pairs: bool):
    """All counts as rows (part, sender, block) grouped by part, which are shards, with at most FAN senders a part."""
    senders = max(1, docs.rdd.getNumPartitions())
    bits = min(model.bits, SPLIT)
    rows = docs.mapInArrow(partial(_count, model=model, pairs=pairs, bits=bits), _BLOCK)
    while bits < model.bits or senders > FAN:
        bits, senders = min(model.bits, bits + SPLIT), -(-senders // FAN)
        rows = rows.groupBy("part", F.expr(f"sender div {FAN}").alias("senders")).applyInArrow(_by_key(_merge_some, model=model, pairs=pairs, bits=bits), _BLOCK)
    return rows.groupBy("part")


def pair_keys(ids: np.ndarray, begin: np.uint64, lens: np.ndarray) -> np.ndarray:
    """(context, word) of every token as one number."""
    before = np.empty_like(ids)
    before[1:] = ids[:-1]
    before[np.cumsum(lens) - lens] = begin
    return before << np.uint64(32) | ids


def _merged(table: pa.Table, values: int) -> list[np.ndarray]:
    """The sums of a group's blocks of keys and so many values."""
    found = [unpack(x, *[np.uint64] * (values + 1)) for x in table.column("block").to_pylist()]
    return summed(*[np.concatenate(x) for x in zip(*found, strict=True)])


def _merge_words(key: tuple, table: pa.Table, root: str) -> pa.Table:
    shard = key[0].as_py()
    hashes, counts = _merged(table, 1)
    counts = counts.astype(np.int64)
    save(root, f"word-{shard}.hash", hashes)
    save(root, f"word-{shard}.count", counts)
    return pa.table({"shard": [shard], "n": [len(hashes)], "words": [int((counts > 0).sum())], "tokens": [int(counts.sum())]})


def _merge_pairs(key: tuple, table: pa.Table, model: Model) -> pa.Table:
    """Writes a shard's pairs; gives the contexts' and words' figures for the vocabulary's shards, and counts of counts."""
    shard = key[0].as_py()
    keys, counts = _merged(table, 1)
    save(model.root, f"pair-{shard}.key", keys)
    save(model.root, f"pair-{shard}.count", narrow(counts))
    context, word = keys >> np.uint64(32), keys & np.uint64(0xFFFFFFFF)
    figures = [x.astype(np.uint64) for x in summed(context, counts, *[x.astype(np.uint64) for x in (counts == 1, counts == 2, counts >= 3)])]
    after, kinds = np.unique(word, return_counts=True)
    zero = lambda n: np.zeros(n, np.uint64)
    ids, *values = summed(
        np.concatenate([figures[0], after]), *[np.concatenate([f, zero(len(after))]) for f in figures[1:]], np.concatenate([zero(len(figures[0])), kinds.astype(np.uint64)])
    )
    blocks = _blocks(np.searchsorted(model.offsets, ids.astype(np.int64), side="right") - 1, shard, ids, *values)
    of = [int((counts == k).sum()) for k in (1, 2, 3, 4)]
    return pa.table({**{c: blocks.column(c) for c in blocks.schema.names}, **{f"n{k + 1}": pa.array([of[k] if r == 0 else 0 for r in range(blocks.num_rows)], pa.int64()) for k in range(4)}})


def _merge_partials(key: tuple, table: pa.Table) -> pa.Table:
    """One block of the figures of a vocabulary shard, of those of some pair shards."""
    return pa.table({"part": [key[0].as_py()], "sender": [key[1].as_py()], "block": pa.array([pack(*_merged(table, 5))], pa.binary())})


def _merge_figures(key: tuple, table: pa.Table, model: Model) -> pa.Table:
    """Writes context totals, backoff weights and continuation counts of a vocabulary shard."""
    shard = key[0].as_py()
    ids, total, one, two, more, kinds = _merged(table, 5)
    at, n = ids.astype(np.int64) - model.offsets[shard], int(model.sizes[shard])
    whole = lambda v, kind: np.bincount(at, weights=v, minlength=n).astype(kind)
    totals, follows = whole(total, np.float64), whole(kinds, np.int64)
    d = model.pair_discounts
    save(model.root, f"word-{shard}.total", totals)
    save(model.root, f"word-{shard}.backoff", whole(d[0] * one + d[1] * two + d[2] * more, np.float64) / np.maximum(totals, 1))
    save(model.root, f"word-{shard}.follows", follows)
    of = [int((follows == k).sum()) for k in (1, 2, 3, 4)]
    return pa.table({**{f"n{k + 1}": [of[k]] for k in range(4)}, "more": [int((follows >= 3).sum())], "pairs": [int(follows.sum())]})


def discounts(n1: int, n2: int, n3: int, n4: int) -> tuple[float, float, float]:
    """Chen and Goodman's three discounts; where a count of counts is zero, a usual value."""
    y = n1 / (n1 + 2 * n2) if n1 + n2 else 0.5
    found = [k - (k + 1) * y * b / a if a and b else 0.5 * k for k, (a, b) in enumerate(((n1, n2), (n2, n3), (n3, n4)), 1)]
    return tuple(min(max(d, 0.1), k) for k, d in enumerate(found, 1))


def held_out(folds: int = FOLDS):
    return F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))) % folds == 0


def fit(docs: DataFrame, shard_bytes: int = SHARD_BYTES) -> Model:
    """Counts all rows of (doc_id, text) and writes the model's files."""
    spark = docs.sparkSession
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    bits = max(3, (max(1, size // shard_bytes)).bit_length())
    model = Model(new_path(spark, "lm"), bits, np.zeros(1 << bits, np.int64))
    words = merged_blocks(docs, model, False).applyInArrow(_by_key(_merge_words, root=model.root), "shard long, n long, words long, tokens long").collect()
    sizes = np.zeros(1 << bits, np.int64)
    for r in words:
        sizes[r["shard"]] = r["n"]
    if sizes.sum() >= 1 << 32:
        raise OverflowError("more than 2 ** 32 different words")
    model = replace(model, sizes=sizes, offsets=np.cumsum(sizes) - sizes, train_tokens=sum(r["tokens"] for r in words), n_words=sum(r["words"] for r in words))
    if not words:
        return model
    kind = f"{_BLOCK}, n1 long, n2 long, n3 long, n4 long"
    partials = stash(merged_blocks(docs, model, True).applyInArrow(_by_key(_merge_pairs, model=model), kind), "lm-figures")
    model = replace(model, pair_discounts=discounts(*partials.agg(*[F.sum(f"n{k}") for k in (1, 2, 3, 4)]).first()))
    kind = "n1 long, n2 long, n3 long, n4 long, more long, pairs long"
    rows, senders = partials.select("part", "sender", "block"), 1 << bits
    while senders > FAN * 16:  # figures are much smaller than counts
        rows = rows.groupBy("part", F.expr(f"sender div {FAN * 16}").alias("senders")).applyInArrow(_by_key(_merge_partials), _BLOCK)
        senders = -(-senders // (FAN * 16))
    ends = rows.groupBy("part").applyInArrow(_by_key(_merge_figures, model=model), kind)
    t = ends.agg(*[F.sum(c).alias(c) for c in ("n1", "n2", "n3", "n4", "more", "pairs")]).first()
    d = discounts(t["n1"], t["n2"], t["n3"], t["n4"])
    remove_at_end(spark, model.root)
    return replace(model, word_discounts=d, pairs=t["pairs"], word_backoff=d[0] * t["n1"] + d[1] * t["n2"] + d[2] * t["more"])


def _by_key(f, **more):
    return lambda key, table: f(key, table, **more)


# Scoring.


def _cut(counts: np.ndarray, d: tuple) -> np.ndarray:
    return np.maximum(counts - np.array([0.0, *d])[np.minimum(counts, 3)], 0)


def log_probabilities(model: Model, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """log10 of each token's probability, each token's training count, tokens a text."""
    hashes, words, lens = tokens(texts)
    if not model.train_tokens:
        return np.zeros(len(words)), np.zeros(len(words), np.int64), lens
    ids = word_ids(model, hashes)
    counts = word_values(model, ids, "count", np.int64)
    follows = word_values(model, ids, "follows", np.int64)
    total, backoff = (word_values(model, ids, n, np.float64) for n in ("total", "backoff"))
    single = (_cut(follows, model.word_discounts) + model.word_backoff / (model.n_words + 1)) / model.pairs
    before = np.empty_like(words)
    before[1:] = words[:-1]
    before[np.cumsum(lens) - lens] = 1  # BEGIN
    p = single[words]
    known = total[before] > 0
    p[known] *= backoff[before[known]]
    both = np.flatnonzero(known & (ids[words] >= 0))
    keys, place = np.unique(ids[before[both]].astype(np.uint64) << np.uint64(32) | ids[words[both]].astype(np.uint64), return_inverse=True)
    p[both] += _cut(pair_counts(model, keys), model.pair_discounts)[place] / total[before[both]]
    return np.log10(p), counts[words], lens


def _score(batches: Iterator[pa.RecordBatch], model: Model) -> Iterator[pa.RecordBatch]:
    base_total = model.train_tokens + 0.1 * (model.n_words + 1)
    for b in slices(batches):
        logs, counts, lens = log_probabilities(model, utf8(b))
        starts = np.cumsum(lens) - lens
        sums = [np.add.reduceat(x, starts) for x in ((counts > 0).astype(np.int64), np.log10((counts + 0.1) / base_total), logs)]
        yield pa.RecordBatch.from_arrays(
            [b.column("doc_id"), pa.array(lens), pa.array(sums[0]), pa.array(np.full(len(lens), model.train_tokens)), pa.array(sums[1]), pa.array(sums[2])],
            names=["doc_id", "n_tokens", "n_known", "train_tokens", "base_score", "score"],
        )


def score(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, n_tokens, n_known, train_tokens, base_score, score and perplexity for each row of (doc_id, text)."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    ddl = f"doc_id {kind}, n_tokens long, n_known long, train_tokens long, base_score double, score double"
    return docs.mapInArrow(partial(_score, model=model), ddl).withColumn("perplexity", F.pow(F.lit(10.0), -F.col("score") / F.col("n_tokens")))


def score_corpus(df: DataFrame, folds: int = FOLDS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Fits the model on all rows that aren't held out and scores every row."""
    docs = id_and_text(df, id_col=id_col, text_col=text_col)
    model = fit(docs.where(~held_out(folds)))
    return score(docs, model).withColumn("held_out", held_out(folds))
