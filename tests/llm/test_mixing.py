"""Mixtures against the weights before they are rounded."""

from __future__ import annotations

from collections import Counter
from itertools import pairwise

import pytest

from inkstrata.llm import mixing


@pytest.mark.parametrize("small", [20, 2_000, 4_900])
def test_shares_follow_unrounded_weights(small):
    sizes = {"hot": 20 * small, **{f"s{i}": 20 + 20 * (i % 3) for i in range(small)}}
    total = sum(sizes.values())
    weights = {s: (n / total) ** mixing.TEMPERATURE for s, n in sizes.items()}
    blocks = {s: -(-n // 16) for s, n in sizes.items()}
    shares = mixing.fitting(weights, blocks)
    slots = mixing.period(shares, most := mixing.length(shares, blocks))
    whole, cycle = sum(weights.values()), sum(shares.values())
    assert sorted(x for own in slots.values() for x in own) == list(range(min(most, cycle)))
    for s, own in slots.items():
        w = weights[s] / whole
        times = [(x + d, k + d) for k, x in enumerate(own) for d in (0, 1)] + [(min(most, cycle), len(own))]
        assert all(abs(k - w * t) < 1 + mixing.DRIFT for t, k in times)
        assert all(a < b for a, b in pairwise(own)) and (most > cycle or len(own) >= blocks[s])


def test_a_small_source_comes_as_often_as_it_is_owed(spark):
    n = 400_000
    df = spark.range(n + 16).selectExpr("id AS doc_id", "'x' AS text", f"if(id < {n}, 'hot', 'small') AS source")
    got = Counter({r["source"]: r["count"] for r in mixing.schedule(df).groupBy("source").count().collect()})
    owed = got["hot"] * (16 / n) ** mixing.TEMPERATURE
    assert abs(got["small"] - owed) < 16 * (1 + mixing.DRIFT)


def test_weights_that_never_end():
    with pytest.raises(ValueError, match="slots"):
        mixing.fitting({"a": 1.0, "b": 0.0}, {"a": 3, "b": 10**6})


def test_ten_thousand_quanta_where_they_are_enough(spark):
    for sf in ("0.001", "0.01"):
        sizes = {str(r["source"]): r["count"] for r in spark.read.parquet(f"/root/testdata/sf{sf}/documents.parquet").groupBy("source").count().collect()}
        total = sum(sizes.values())
        assert sum(mixing.fitting({s: (n / total) ** mixing.TEMPERATURE for s, n in sizes.items()}, {s: -(-n // 16) for s, n in sizes.items()}).values()) == mixing.QUANTA


def test_blocks_grow_with_the_table_and_any_number_of_sources(spark, monkeypatch):
    monkeypatch.setattr(mixing, "MOST_BLOCKS", 50)
    df = spark.range(6_000).selectExpr("id AS doc_id", "'x' AS text", "if(id % 3 = 0, 'hot', 's' || (id % 7)) AS source")
    rows = mixing.schedule(df).orderBy("position").collect()
    n = Counter(r["source"] for r in df.collect())
    weights = {s: (k / 6_000) ** mixing.TEMPERATURE for s, k in n.items()}
    count, whole = Counter(), sum(weights.values())
    blocks = {r["slot"]: r["source"] for r in rows}
    for t in sorted(blocks):
        count[blocks[t]] += 1
        assert all(abs(count[s] - w / whole * (t + 1)) < 1 + mixing.DRIFT for s, w in weights.items())
    assert max(Counter((r["source"], r["block"]) for r in rows).values()) == 120 and {r["doc_id"] for r in rows} == set(range(6_000))
    many = spark.range(12_000).selectExpr("id AS doc_id", "'x' AS text", "CAST(id % 6000 AS string) AS source")
    assert mixing.schedule(many).select("doc_id").distinct().count() == 12_000
