"""Mixing sources to target weights by Pfair scheduling.

A source's rows, in a seeded random order, form blocks. The k-th block (from 0) of a source with weight w may not start
before slot floor(k / w) and must be placed before slot ceil((k + 1) / w). Earliest deadline first (of equals the heavier
source) then fills one slot after the other; every deadline is met, so after any number of slots each source is less than one
block away from its share.

Weights are rounded to integers a of ``quanta``, so release times and deadlines repeat after ``quanta`` slots. Unless told, the
quanta are the first of 10,000, 100,000, ... whose rounding moves no source by more than DRIFT blocks from its unrounded target
until the mixture ends. The driver handles the slots of one period, or of the mixture if that is shorter: about one for each
block of the result. A block has BLOCK_ROWS rows, or as many as it takes for the table to have at most MOST_BLOCKS blocks; the bound
of less than one block holds for blocks of any size. There may be any number of sources. Workers join the slots, so no row carries a
whole list.
A source that ends before the others starts again (a further epoch), until the slowest source has been used up once: all
rows are there at least once and the weights hold to the end.

Defined cases: null sources are a source of their own (weights: key None); null doc_ids and repeated rows are rows like any
other; null text is placed like the empty text and stays null; a source with weights but no rows is left out; sources that the weights
don't name are an error, as is a source with rows whose weight is next to nothing (its rows would never come); an empty table gives an
empty result. ``mix`` carries all other columns along, whatever their names; texts' lengths don't matter.
"""

from __future__ import annotations

import heapq
import math
from array import array
from bisect import bisect_right

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import stash
from .common import BROADCAST_ROWS, join_hot, positions
from .sharding import ranked

BLOCK_ROWS = 16
QUANTA = 10_000
#: Most blocks by which rounded weights may move a source from its target.
DRIFT = 0.05
#: Blocks of the largest table, and slots that weights may ask the driver for (only a large source with next to no weight needs more).
MOST_BLOCKS, MOST_SLOTS = 8_000_000, 50_000_000
SEED = 23
#: Default weights: shares of rows to this power.
TEMPERATURE = 0.9


def rounded(weights: dict[str, float], quanta: int) -> dict[str, int]:
    """Integers of at least 1 that sum to ``quanta``, by largest remainder."""
    total = sum(weights.values())
    exact = {s: w / total * (quanta - len(weights)) for s, w in weights.items()}
    out = {s: 1 + math.floor(x) for s, x in exact.items()}
    short = quanta - sum(out.values())
    for s in sorted(exact, key=lambda s: (math.floor(exact[s]) - exact[s], s))[:short]:
        out[s] += 1
    return out


def length(shares: dict[str, int], blocks: dict[str, int]) -> int:
    """Slots within which every source's blocks have been placed: the last deadline."""
    quanta = sum(shares.values())
    return max((-(-n * quanta // shares[s]) for s, n in blocks.items()), default=0)


def fitting(weights: dict[str, float], blocks: dict[str, int]) -> dict[str, int]:
    """Shares that stay within DRIFT blocks of the weights until every source's blocks have been placed."""
    total, quanta = sum(weights.values()), max(QUANTA, 2 * len(weights))
    while quanta <= 10**13:
        shares = rounded(weights, quanta)
        slots = length(shares, blocks)
        if slots > MOST_SLOTS:
            break
        if max(abs(a / quanta - weights[s] / total) for s, a in shares.items()) * slots <= DRIFT:
            return shares
        quanta *= 10
    raise ValueError(f"a mixture of these weights takes more than {MOST_SLOTS} slots")


def period(shares: dict[str, int], most: int | None = None) -> dict[str, array]:
    """Slots of each source's blocks in one period of sum(shares) slots (or its first ``most``), by earliest deadline first."""
    quanta = sum(shares.values())
    waiting = [(0, s, 0) for s in sorted(shares)]  # release of the source's next block
    out: dict[str, array] = {s: array("q") for s in shares}
    ready: list[tuple] = []
    for slot in range(quanta if most is None else min(quanta, most)):
        while waiting and waiting[0][0] <= slot:
            _, s, k = heapq.heappop(waiting)
            heapq.heappush(ready, (-(-(k + 1) * quanta // shares[s]), -shares[s], s))
            if k + 1 < shares[s]:
                heapq.heappush(waiting, ((k + 1) * quanta // shares[s], s, k + 1))
        deadline, _, s = heapq.heappop(ready)
        if deadline <= slot:
            raise ArithmeticError("a deadline was missed")
        out[s].append(slot)
    return out


def schedule(df: DataFrame, weights: dict[str | None, float] | None = None, temperature: float = TEMPERATURE, block_rows: int | None = None,
             quanta: int | None = None, seed: int = SEED, source: str = "source", id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, text_hash, source, epoch, block, release, deadline, slot, position: one row for each place in the mixture."""
    spark = df.sparkSession
    rows = df.select(F.col(id_col).alias("doc_id"), F.col(source).cast("string").alias("source"), F.xxhash64(F.coalesce(F.col(text_col), F.lit(""))).alias("text_hash"))
    in_source, total = ranked(rows, seed, ["doc_id", "text_hash"])
    in_source = stash(in_source, "in_source")
    block_rows = block_rows or max(BLOCK_ROWS, -(-total // MOST_BLOCKS))
    sizes = {r["_stratum"]: r["_n"] for r in sorted(in_source.select("_stratum", "_n").distinct().collect())}  # a row a source
    name = lambda s: "null" if s is None else f"={s}"
    target = {name(s): w for s, w in weights.items() if name(s) in sizes} if weights else {s: (n / total) ** temperature for s, n in sizes.items()}
    if missing := sorted(set(sizes) - set(target)):
        raise ValueError(f"no weight for {missing[:5]}")
    blocks = {s: -(-n // block_rows) for s, n in sizes.items()}
    shares = (rounded(target, max(quanta, 2 * len(target))) if quanta else fitting(target, blocks)) if target else {}
    cycle, most = sum(shares.values()), length(shares, blocks)
    slots = period(shares, most)
    at = lambda s, k: k // shares[s] * cycle + slots[s][k % shares[s]]
    end = max((at(s, blocks[s] - 1) for s in sizes), default=-1)  # the last slot of the source that needs most
    # Blocks that a source has up to the end.
    placed = {s: end // cycle * shares[s] + bisect_right(slots[s], end % cycle) for s in shares}
    plan = spark.createDataFrame([(s, sizes[s], shares[s], placed[s], end) for s in shares], "_stratum string, _n long, a long, blocks long, last long")
    one = "_stratum string, _turn long, _slot long"
    table = pa.table({
        "_stratum": pa.array([s for s in slots for _ in slots[s]], pa.string()), "_turn": pa.array([k for own in slots.values() for k in range(len(own))], pa.int64()),
        "_slot": pa.array([x for own in slots.values() for x in own], pa.int64()),
    })
    turns = stash(spark.createDataFrame(table, one) if shares else spark.createDataFrame([], one), "slots")
    rank = F.col("_rank") + F.col("epoch") * F.col("_n")
    epochs = F.expr(f"(blocks * {block_rows} - 1) div _n")
    dealt = (
        join_hot(in_source.drop("_n"), plan, "_stratum", "_n", total).withColumn("epoch", F.explode(F.sequence(F.lit(0).cast("long"), epochs)))
        .withColumn("block", F.floor(rank / block_rows)).withColumn("_within", rank % block_rows).where("block < blocks").withColumn("_turn", F.expr("block % a"))
        .join(F.broadcast(turns) if table.num_rows <= BROADCAST_ROWS else turns, ["_stratum", "_turn"])
        .withColumn("slot", F.expr(f"block div a * {cycle} + _slot")).where("slot <= last")
        .withColumn("release", F.expr(f"block * {cycle} div a")).withColumn("deadline", F.expr(f"((block + 1) * {cycle} + a - 1) div a"))
        .select("doc_id", "text_hash", "source", "epoch", "block", "release", "deadline", "slot", "_within")
    )
    found, _ = positions(dealt, ["slot", "_within"], "scheduled")
    return found.drop("_within").withColumnRenamed("_pos", "position")


def mix(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", **how) -> DataFrame:
    """``df``'s rows in the order of the schedule, repeated as often as it says; columns unchanged.

    Rows that repeat an id and a text have as many copies as their places say.
    """
    spark = df.sparkSession
    found = stash(schedule(df, id_col=id_col, text_col=text_col, **how).select(
        F.coalesce(F.col("doc_id").cast("string"), F.lit("null")).alias("_mix_id"), F.col("text_hash").alias("_mix_hash"), F.col("position").alias("_mix_at")), "mix")
    places = found.count()
    twice = found.join(  # which places belong to rows of which there are copies: each copy takes its share of them
        df.groupBy(F.coalesce(F.col(id_col).cast("string"), F.lit("null")).alias("_mix_id"), F.xxhash64(F.coalesce(F.col(text_col), F.lit(""))).alias("_mix_hash"))
        .agg(F.count("*").alias("n")).where("n > 1"), ["_mix_id", "_mix_hash"], "left_semi")
    keys = df.withColumn("_mix_id", F.coalesce(F.col(id_col).cast("string"), F.lit("null"))).withColumn("_mix_hash", F.xxhash64(F.coalesce(F.col(text_col), F.lit(""))))
    if not twice.isEmpty():
        keys = keys.dropDuplicates(["_mix_id", "_mix_hash"])
    rows = keys.join(F.broadcast(found) if places <= BROADCAST_ROWS else found, ["_mix_id", "_mix_hash"])
    parts = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    return rows.repartitionById(parts, F.expr(f"int(_mix_at * {parts} div {max(places, 1)})")).sortWithinPartitions("_mix_at").select(*[f"`{c}`" for c in df.columns])
