"""Bins of the genetic algorithm against its seed, one best-fit decreasing over all pieces, and the bound."""

from __future__ import annotations

import math
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from inkstrata.llm import packing, tokens

from . import edges


def bins_of(rows) -> dict:
    """Offsets and lengths by sequence, which must be gapless and no longer than allowed."""
    bins = defaultdict(list)
    for r in rows:
        bins[r["sequence_id"]].append((r["offset"], r["length"]))
    for own in bins.values():
        own.sort()
        assert [o for o, _ in own] == np.cumsum([0, *[n for _, n in own]])[:-1].tolist() and sum(n for _, n in own) <= 1024
    return bins


def hard(n: int, seed: int) -> np.ndarray:
    """Triples that fill a bin exactly, and hardly any other way."""
    rng, out = np.random.default_rng(seed), []
    for _ in range(n):
        a = int(rng.integers(390, 500))
        b = int(rng.integers((1024 - a) // 2 - 100, (1024 - a) // 2))
        out += [a, b, 1024 - a - b]
    return np.array(out)[rng.permutation(3 * n)]


def test_sets_are_a_packing():
    rng = np.random.default_rng(3)
    for lens in (rng.integers(1, 1024, 700), rng.integers(1, 40, 900), hard(60, 1), np.full(50, 512), np.full(50, 1), np.zeros(0, np.int64), np.array([256] * 9 + [512, 768])):
        sets = packing.best_sets(lens.tolist(), list(range(len(lens))), 1024)
        assert sorted(i for s in sets for i in s) == list(range(len(lens))) and all(lens[s].sum() <= 1024 for s in sets)
    assert len(packing.best_sets([512] * 50, list(range(50)), 1024)) == 25


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_evolution_needs_fewer_bins_than_its_seed(seed):
    lens = hard(200, seed)
    people: list = []
    for epoch in range(3):
        people = packing.evolve(lens, people, None, 1024, epoch, 4, 20)
    assert packing.n_bins(people[0]) < packing.seed_bins(lens, 1024)


def test_blocks_together_are_as_good_as_one(spark):
    """Real lengths in small blocks: fewer bins than the blocks' seeds, and no more than one best-fit decreasing over all."""
    df = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    found = packing.stash(tokens.pieces(df), "test")
    rows = packing.pack_pieces(found, block=100).collect()
    part = np.array([r["length"] for r in rows if r["length"] < 1024])
    got = sum(s >= 0 for s in bins_of(rows))
    uids = [r["u"] for r in packing.stash(found.withColumn("_uid", F.monotonically_increasing_id()), "t").where("length < 1024").select(F.pmod(F.xxhash64("_uid"), F.lit(-(-len(part) // 100))).alias("u")).collect()]
    lens = [r["length"] for r in packing.stash(found, "t2").where("length < 1024").select("length").collect()]
    blocks = defaultdict(list)
    for u, n in zip(uids, lens, strict=True):
        blocks[u].append(n)
    seeds = sum(packing.seed_bins(np.array(b), 1024) for b in blocks.values())
    whole, bound = packing.seed_bins(part, 1024), math.ceil(part.sum() / 1024)
    print(f"blocks {len(blocks)}, seeds {seeds}, result {got}, one best-fit decreasing {whole}, bound {bound}")
    assert bound <= got <= whole and got < seeds


def test_levels(spark, monkeypatch):
    monkeypatch.setattr(packing, "FAN_IN", 2)
    rng = np.random.default_rng(8)
    lens = rng.integers(1, 1025, 900).tolist()
    found = packing.stash(spark.createDataFrame([(i, n) for i, n in enumerate(lens)], "doc_id long, length long"), "test")
    rows = packing.pack_pieces(found, block=60, worst=8, many=4).collect()
    assert sorted((r["doc_id"], r["length"]) for r in rows) == list(enumerate(lens))
    bins_of(rows)
    assert len({r["sequence_id"] >> 57 for r in rows if r["sequence_id"] >= 0}) == 5


def test_blocks_by_place_keep_the_order(spark):
    n = 4_000
    df = spark.range(n).selectExpr("id AS doc_id", "repeat('word ', int(20 + id % 300)) AS text").repartition(5, "doc_id").sortWithinPartitions("doc_id")
    ordered = packing.in_file_order(packing.stash(df, "test"))
    place = {r["doc_id"]: r["_place"] for r in ordered.select("doc_id", "_place").collect()}
    assert sorted(place.values()) == list(range(n))
    rows = packing.pack_pieces(packing.stash(tokens.pieces(ordered, place="_place"), "test"), block=500, worst=16, many=8, place="_place").collect()
    bins_of(rows)
    far = [abs(place[r["doc_id"]] * 8 // n - (r["sequence_id"] >> 20)) for r in rows if r["sequence_id"] >> 57 == 0]
    assert len(far) > n // 2 and max(far) == 0 and "_place" not in rows[0].asDict()


def test_order_of_a_table_that_is_not_in_files(spark):
    df = packing.in_file_order(edges.table(spark))
    assert sorted(r["_place"] for r in df.collect()) == list(range(df.count())) and set(edges.table(spark).columns) < set(df.columns)
    assert packing.in_file_order(edges.empty(spark)).count() == 0
