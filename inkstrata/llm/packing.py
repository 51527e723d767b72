"""Best-fit packing by a grouping genetic algorithm on islands.

A solution is a grouping of pieces into bins (sequences). Crossover injects whole well-filled bins of one parent into the
other, removes the other's bins that hold a duplicate, and best-fits the documents that this displaces: as sets of up to four that fill a
new bin as far as can be, or one by one into the fullest bins with room. The first solutions are best-fit decreasing (the seed), the
same by sets, and the seed with noise. Pieces are dealt into blocks of bounded size; each block is evolved on several islands, and after
each epoch every island's best solution migrates to the next island of its block. An island rests once it has no more bins than the
block's tokens need. A piece as long as a sequence is a sequence of its own.

Blocks would each leave a sequence half empty. So of every block the worst-filled bins (WORST) and those with the most pieces (MANY, for
small pieces fill gaps) are taken apart again, and the pieces of those of FAN_IN blocks are a block of the next level, which is evolved in
the same way, until one block is left: a tree whose nodes are bounded (FAN_IN * (WORST + MANY) bins) and whose levels are the logarithm
of the number of blocks. Bins of seeds, results and bounds are logged.

Blocks are dealt by a hash, or by a column with the documents' places (0, 1, ...): then a block holds neighbours, and sequence ids follow
the order of the documents but for the few pooled ones.

Defined cases: null text packs like the empty text; null or repeated doc_ids are separate documents; an empty table gives
an empty result; other columns are never looked at. Very long texts are cut into many pieces, of which at most one is packed.
"""

from __future__ import annotations

import logging
from collections import defaultdict
from collections.abc import Iterator
from functools import partial

import numpy as np
import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import stash
from .tokens import pieces

#: Pieces a block, islands a block, solutions an island, epochs (with migration between them), children an epoch.
BLOCK, ISLANDS, POPULATION, EPOCHS, CHILDREN = 4096, 3, 4, 2, 6
#: Worst-filled bins and bins with the most pieces that a block passes on, and blocks that pass theirs on together.
WORST, MANY, FAN_IN = 256, 128, 16
_LOG = logging.getLogger(__name__)


def best_fit(lens: list[int], order, most: int, bins: np.ndarray, free: list[int]) -> None:
    """Puts the items of ``order`` each into the fullest bin that still has room, or a new one. Changes bins and free.

    ``slots[c]`` are the bins with room c; ``mask`` has bit c set if there are any, so the tightest fit is one bit scan.
    """
    slots: list[list[int]] = [[] for _ in range(most + 1)]
    mask = 0
    for k, room in enumerate(free):
        if room:
            slots[room].append(k)
            mask |= 1 << room
    for i in order:
        n = lens[i]
        if above := mask >> n:
            room = n + (above & -above).bit_length() - 1
            k = slots[room].pop()
            if not slots[room]:
                mask &= ~(1 << room)
        else:
            k, room = len(free), most
            free.append(most)
        bins[i] = k
        room -= n
        free[k] = room
        if room:
            slots[room].append(k)
            mask |= 1 << room


def best_sets(lens: list[int], items: list[int], most: int) -> list[list[int]]:
    """Bins of the items: each takes the longest one left and the one, two or three others that fill it furthest.

    ``have`` has bit n set if an item of length n is left, ``mirror`` bit most - n: one shift and one AND find all pairs of a sum.
    """
    left: dict[int, list[int]] = defaultdict(list)
    for i in sorted(items, key=lambda i: -lens[i])[::-1]:
        left[lens[i]].append(i)
    have = sum(1 << n for n in left)
    mirror = sum(1 << most - n for n in left)
    out: list[list[int]] = []

    def take(n: int) -> int:
        nonlocal have, mirror
        own = left[n]
        i = own.pop()
        if not own:
            have &= ~(1 << n)
            mirror &= ~(1 << most - n)
        return i

    def pair(total: int, spare: int = 0) -> tuple[int, int] | None:
        """Lengths of two items with this sum (one of length ``spare`` is taken already)."""
        both = have & (mirror >> most - total)
        while both:
            a = both.bit_length() - 1
            b = total - a
            if len(left[a]) > (a == b) + (a == spare) and len(left[b]) > (b == spare):
                return a, b
            both &= ~(1 << a | 1 << b)
        return None

    def others(room: int) -> tuple[int, ...]:
        """Lengths of at most three items with the greatest sum up to ``room``; two are looked for before three."""
        for total in range(room, max(room - 8, 0), -1):
            if have >> total & 1:
                return (total,)
            if two := pair(total):
                return two
            third = have & ((1 << total) - 1)
            for _ in range(24):  # the longest few
                if not third:
                    break
                a = third.bit_length() - 1
                third &= ~(1 << a)
                if two := pair(total - a, a):
                    return a, *two
        below = have & ((1 << room + 1) - 1)
        return (below.bit_length() - 1,) if below else ()

    while have:
        n = have.bit_length() - 1
        own, room = [take(n)], most - n
        while room and have and (more := others(room)):
            own.extend(take(k) for k in more)
            room -= sum(more)
        out.append(own)
    return out


def fitness(bins: np.ndarray, lens: np.ndarray, most: int) -> float:
    """Fewer bins first, then the more uneven their filling (so that some bins can still be emptied)."""
    fill = np.bincount(bins, weights=lens)
    fill = fill[fill > 0] / most
    return -len(fill) + float((fill**2).mean()) if len(fill) else 0.0


def pack(lens: np.ndarray, order, most: int) -> np.ndarray:
    bins = np.full(len(lens), -1, np.int32)
    best_fit(lens.tolist(), order, most, bins, [])
    return bins


def n_bins(bins: np.ndarray) -> int:
    return int(np.count_nonzero(np.bincount(bins))) if len(bins) else 0


def seed_bins(lens: np.ndarray, most: int) -> int:
    """Bins of best-fit decreasing."""
    return n_bins(pack(lens, np.argsort(-lens, kind="stable").tolist(), most))


def crossover(a: np.ndarray, b: np.ndarray, lens: np.ndarray, most: int, rng: np.random.Generator) -> np.ndarray:
    """Injects a random half of b's better-filled bins into a."""
    fill = np.bincount(b, weights=lens)
    good = np.flatnonzero(fill >= np.median(fill))
    chosen = np.zeros(len(fill), bool)
    chosen[good] = rng.random(len(good)) < 0.5
    given = chosen[b]  # items that come with b's bins
    broken = np.zeros(a.max() + 1, bool)
    broken[a[given]] = True  # a's bins with a duplicate go
    stays = ~given & ~broken[a]
    out = np.full(len(a), -1, np.int32)
    names, out[given] = np.unique(b[given], return_inverse=True)
    kept, inverse = np.unique(a[stays], return_inverse=True)
    out[stays] = inverse + len(names)
    placed = out >= 0
    used = np.bincount(out[placed], weights=lens[placed], minlength=len(names) + len(kept))
    left = np.flatnonzero(~placed)
    if rng.random() < 0.5:  # whole sets that fill new bins; only what doesn't goes on to be fitted one by one
        free, rest = (most - used).astype(np.int64).tolist(), []
        for own in best_sets(lens.tolist(), left.tolist(), most):
            if int(lens[own].sum()) >= most - 1:
                out[own] = len(free)
                free.append(most - int(lens[own].sum()))
            else:
                rest.extend(own)
        best_fit(lens.tolist(), sorted(rest, key=lambda i: -lens[i]), most, out, free)
        return out
    # Largest first, ties and near ties in random order.
    left = left[np.argsort(-(lens[left] + rng.random(len(left)) * 16), kind="stable")]
    best_fit(lens.tolist(), left.tolist(), most, out, (most - used).astype(np.int64).tolist())
    return out


def evolve(lens: np.ndarray, people: list[np.ndarray], guest: np.ndarray | None, most: int, seed: int, size: int, children: int) -> list[np.ndarray]:
    """One epoch of one island; the best solution comes first."""
    rng = np.random.default_rng(seed)
    people, bound = list(people), -(-int(lens.sum()) // most)
    rest = lambda: bool(people) and min(map(n_bins, people)) <= bound
    if not people:
        people.append(pack(lens, np.argsort(-lens, kind="stable").tolist(), most))
        if not rest():
            bins = np.empty(len(lens), np.int32)
            for k, own in enumerate(best_sets(lens.tolist(), rng.permutation(len(lens)).tolist(), most)):
                bins[own] = k
            people.append(bins)
        while not rest() and len(people) < size:
            people.append(pack(lens, np.argsort(-(lens + rng.random(len(lens)) * most * 0.25), kind="stable").tolist(), most))
    if guest is not None:
        people.append(guest)
    rank = lambda: people.sort(key=lambda p: -fitness(p, lens, most))
    rank()
    for _ in range(children):
        if rest():
            break
        a, b = rng.choice(len(people), 2, replace=len(people) < 2)
        people.append(crossover(people[a], people[b], lens, most, rng))
        rank()
        del people[size:]
    return people


def _epoch(frames: Iterator[pd.DataFrame], most: int, epoch: int, size: int, children: int) -> Iterator[pd.DataFrame]:
    for frame in frames:
        out = []
        for r in frame.itertuples(index=False):
            lens = np.asarray(r.lens, np.int64)
            people = [np.asarray(p, np.int32) for p in r.people] if r.people is not None else []
            guest = np.asarray(r.guest, np.int32) if r.guest is not None else None
            found = evolve(lens, people, guest, most, hash((int(r.block), int(r.island), epoch)) & 0xFFFFFFFF, size, children)
            out.append((r.block, r.island, r.uids, r.lens, [p.tolist() for p in found], fitness(found[0], lens, most), r.seed if people else seed_bins(lens, most)))
        yield pd.DataFrame(out, columns=["block", "island", "uids", "lens", "people", "fit", "seed"])


def _settle(frames: Iterator[pd.DataFrame], most: int, worst: int, many: int) -> Iterator[pd.DataFrame]:
    """Bin and offset of each item of a block; items of the bins to take apart have bin -1 and are given once more."""
    for frame in frames:
        out = []
        for r in frame.itertuples(index=False):
            own, lens = np.unique(np.asarray(r.bins, np.int64), return_inverse=True)[1], np.asarray(r.lens, np.int64)
            order = np.argsort(own, kind="stable")
            ends = np.cumsum(lens[order])
            first = np.r_[True, own[order][1:] != own[order][:-1]] if len(own) else np.zeros(0, bool)
            base = np.maximum.accumulate(np.where(first, ends - lens[order], 0)) if len(own) else ends
            off = np.empty_like(lens)
            off[order] = ends - lens[order] - base
            apart = np.zeros(int(own.max(initial=-1)) + 1, bool)
            apart[np.argsort(np.bincount(own, weights=lens), kind="stable")[:worst]] = True
            apart[np.argsort(-np.bincount(own), kind="stable")[:many]] = True
            open_ = apart[own]
            out.append((r.block, r.uids, np.where(open_, -1, own), off, np.asarray(r.uids)[open_], lens[open_].astype(np.int32)))
        yield pd.DataFrame(out, columns=["block", "uids", "bins", "offs", "open_uids", "open_lens"])


def evolved(blocks: DataFrame, n_blocks: int, most: int, islands: int, epochs: int, level: int) -> DataFrame:
    """(block, uids, lens, bins) of blocks (block, uids, lens): the best solution of all islands."""
    kind = "block long, island int, uids array<long>, lens array<int>, people array<array<int>>, fit double, seed long"
    state = blocks.withColumn("island", F.explode(F.sequence(F.lit(0), F.lit(islands - 1)))).withColumn("people", F.lit(None).cast("array<array<int>>")).withColumn("seed", F.lit(0).cast("long"))
    n_tasks = max(1, min(n_blocks * islands, blocks.sparkSession.sparkContext.defaultParallelism * 4))
    for epoch in range(epochs):
        if epoch:
            moved = state.select("block", F.pmod(F.col("island") + 1, F.lit(islands)).alias("island"), F.col("people")[0].alias("guest"))
            state = state.join(moved, ["block", "island"])
        else:
            state = state.withColumn("guest", F.lit(None).cast("array<int>"))
        state = stash(
            state.select("block", "island", "uids", "lens", "people", "guest", "seed").repartition(n_tasks, "block", "island")
            .mapInPandas(partial(_epoch, most=most, epoch=epoch, size=POPULATION, children=CHILDREN), kind), "islands"
        )
    best = state.groupBy("block").agg(F.max_by(F.struct("uids", "lens", F.col("people")[0].alias("bins"), "seed"), F.struct("fit", -F.col("island"))).alias("b"))
    best = stash(best.select("block", "b.*"), "best")
    if _LOG.isEnabledFor(logging.INFO):
        tokens = F.aggregate("lens", F.lit(0).cast("long"), lambda s, x: s + x)
        r = best.agg(F.sum("seed"), F.sum(F.size(F.array_distinct("bins"))), F.sum(F.ceil(tokens / most))).first()
        _LOG.info("level %d: %d blocks, bins of seeds %s, of results %s, bound %s", level, n_blocks, *r)
    return best


def pack_pieces(found: DataFrame, most: int = 1024, block: int = BLOCK, islands: int = ISLANDS, epochs: int = EPOCHS, worst: int = WORST, many: int = MANY, place: str | None = None) -> DataFrame:
    """Adds sequence_id and offset to pieces (any columns, length among them), without the column ``place``.

    Sequences of one whole piece have negative ids; of the others, those of a level come after those of the level before.
    """
    cols = [c for c in found.columns if c != place]
    numbered = stash(found.withColumn("_uid", F.monotonically_increasing_id()), "pieces")
    whole = numbered.where(F.col("length") >= most).withColumn("sequence_id", -1 - F.col("_uid")).withColumn("offset", F.lit(0).cast("long"))
    part = numbered.where(F.col("length") < most)
    n_blocks = -(-part.count() // block) or 1
    # At most about block * 1.1 items come together here, whatever the input's size: a document has one partial piece.
    if place is None:
        own = F.pmod(F.xxhash64("_uid"), F.lit(n_blocks))
    else:
        last = part.agg(F.max(place)).first()[0] or 0
        own = F.expr(f"int(`{place}` * {n_blocks} div {last + 1})").cast("long")
    items = stash(part.withColumn("block", own).groupBy("block").agg(F.sort_array(F.collect_list(F.struct("_uid", *cols))).alias("items")), "blocks")
    todo = items.select("block", F.col("items._uid").alias("uids"), F.transform("items", lambda x: x["length"].cast("int")).alias("lens"))
    kind = "block long, uids array<long>, bins array<long>, offs array<long>, open_uids array<long>, open_lens array<int>"
    first, later, level = None, None, 0
    while True:
        best = evolved(todo, n_blocks, most, islands, epochs, level)
        placed = stash(best.select("block", "uids", "lens", "bins").mapInPandas(partial(_settle, most=most, worst=worst * (n_blocks > 1), many=many * (n_blocks > 1)), kind), "placed")
        if level == 0:
            first = placed
        else:
            one = placed.select("block", F.explode(F.arrays_zip("uids", "bins", "offs")).alias("x")).where("x.bins >= 0")
            one = one.select(F.col("x.uids").alias("_uid"), _sequence(level, F.col("x.bins")), F.col("x.offs").alias("offset"))
            later = one if later is None else later.unionByName(one)
        if n_blocks == 1:
            break
        level, n_blocks = level + 1, -(-n_blocks // FAN_IN)
        opened = placed.groupBy(F.expr(f"block div {FAN_IN}").alias("block")).agg(F.sort_array(F.collect_list(F.struct(F.col("block").alias("b"), "open_uids", "open_lens"))).alias("g"))
        todo = opened.select("block", F.flatten("g.open_uids").alias("uids"), F.flatten("g.open_lens").alias("lens"))
    zipped = items.join(first.select("block", "bins", "offs"), "block").select("block", F.explode(F.arrays_zip("items", "bins", "offs")).alias("x"))
    names = [F.col(f"x.items.{c}").alias(c) for c in cols]
    out = zipped.where("x.bins >= 0").select(*names, _sequence(0, F.col("x.bins")), F.col("x.offs").alias("offset"))
    if later is not None:
        out = out.unionByName(zipped.where("x.bins < 0").select(F.col("x.items._uid").alias("_uid"), *names).join(later, "_uid").drop("_uid"))
    return whole.select(*cols, "sequence_id", "offset").unionByName(out)


def _sequence(level: int, bin_: Column) -> Column:
    return (F.lit(level << 57) + F.shiftleft("block", 20) + bin_).alias("sequence_id")


def in_file_order(df: DataFrame, place: str = "_place") -> DataFrame:
    """``df``, read from Parquet files, with the rows' places (0, 1, ...) in the order of the files' names and of the rows in them.

    Another table is written first. The driver gets a row a file.
    """
    try:
        meta = df.metadataColumn("_metadata")
        df.select(meta.getField("row_index")).schema  # noqa: B018  # fails here if there is none
    except AnalysisException:
        df = stash(df, "in-order")
        meta = df.metadataColumn("_metadata")
    rows = df.select("*", meta.getField("file_name").alias("_file"), meta.getField("row_index").alias("_row"))
    sizes = sorted(((len(r["_file"]), r["_file"], r["n"]) for r in rows.groupBy("_file").agg(F.count("*").alias("n")).collect()))
    starts, at = [], 0
    for _, name, n in sizes:
        starts.append((name, at))
        at += n
    told = df.sparkSession.createDataFrame(starts, "_file string, _start long")
    return rows.join(F.broadcast(told), "_file").withColumn(place, F.col("_start") + F.col("_row")).drop("_file", "_row", "_start")


def pack_documents(df: DataFrame, most: int = 1024, end: int = 2, id_col: str = "doc_id", text_col: str = "text", place: str | None = None, **more) -> DataFrame:
    """Tokenizes, cuts and packs documents: doc_id, piece, start, length, ids_crc32, (ids,) sequence_id, offset.

    ``place`` names a column with the documents' places, by which they are dealt into blocks; ``more`` goes to tokens.pieces
    (tokenizer files, with_ids).
    """
    return pack_pieces(pieces(df, most=most, end=end, id_col=id_col, text_col=text_col, place=place, **more), most, place=place)
