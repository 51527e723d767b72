"""Rules that don't know a text's length, and expectation-maximisation against a plain version of it."""

from __future__ import annotations

import math
import random
import time

import numpy as np
import pytest

from inkstrata.llm import quality


def names() -> list[str]:
    return [r[0] for r in quality.RULES]


def codes(text: str) -> list[int]:
    return [quality.vote(v, *r[1:]) for v, r in zip(quality.figures(text.encode())[5:], quality.RULES, strict=True)]


@pytest.mark.parametrize("many", [15, 700])
def test_votes_are_the_same_on_both_sides_of_2000_words(many):
    rng = random.Random(3)
    words = [f"word{rng.randrange(many)}" for _ in range(40_000)]
    seen = {tuple(codes(" ".join(words[:n]))) for n in (1_990, 1_999, 2_000, 2_001, 10_000, 40_000)}
    assert len(seen) == 1 and dict(zip(names(), *seen, strict=True))["distinct"] == (-1 if many == 15 else 1)


def test_distinct_share():
    rng = np.random.default_rng(2)
    for n in (1, 199, 200, 201, 1_000):
        ids = rng.integers(0, 50, n)
        want = sum(len(set(ids[a : a + 200].tolist())) for a in range(0, n, 200)) / n
        assert quality.distinct_share(ids) == want


def test_stop_words_count_once_whatever_their_case_and_edges():
    share = quality.figures(b'DES "des" (des) es, In in. que! house garden plan')[-1]
    assert share == 7 / 10


def test_long_texts_take_linear_time():
    for text in (b"auth " * 1_000_000, b"x" * 5_000_000, b"a b! " * 1_000_000):
        began = time.time()
        quality.figures(text)
        assert time.time() - began < 20


def plain_em(docs: list[list[int]], rounds: int = 100) -> list[float]:
    """EM over single documents with votes -1, 0, 1, in plain loops."""
    m, good = len(quality.RULES), [(0.95, 0.3, 0.03)[min(2, sum(v == -1 for v in d))] for d in docs]
    prior = {0: {-1: 2.0, 0: 1.0, 1: 0.5}, 1: {-1: 0.5, 0: 1.0, 1: 2.0}}
    for _ in range(rounds):
        table = {}
        for c in (0, 1):
            for r in range(m):
                own = dict(prior[c])
                for d, g in zip(docs, good, strict=True):
                    own[d[r]] += g if c else 1 - g
                table[c, r] = {v: x / sum(own.values()) for v, x in own.items()}
        share = [(sum(1 - g for g in good) + 1) / (len(docs) + 5), (sum(good) + 4) / (len(docs) + 5)]
        new = []
        for d in docs:
            bad, fine = (math.log(share[c]) + sum(math.log(table[c, r][v]) for r, v in enumerate(d)) for c in (0, 1))
            new.append(1 / (1 + math.exp(bad - fine)))
        done = max(abs(a - b) for a, b in zip(new, good, strict=True)) < 1e-9
        if done:
            break
        good = new
    return good


def test_em_is_that_of_a_plain_version():
    rng = random.Random(5)
    docs = []
    for _ in range(400):
        bad = rng.random() < 0.25
        docs.append([rng.choices((-1, 0, 1), (0.5, 0.3, 0.2) if bad else (0.04, 0.26, 0.7))[0] for _ in quality.RULES])
    want = plain_em(docs)
    found, where, counts = np.unique([quality.pattern(d) for d in docs], return_inverse=True, return_counts=True)
    got = quality.fit(found, counts.astype(float))[0][where]
    assert np.allclose(got, want, atol=1e-7)


def test_posterior_of_a_table_is_that_of_a_plain_version(spark):
    df = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    rows = [(r["doc_id"], codes(r["text"] or ""), quality.figures((r["text"] or "").encode())) for r in df.collect()]
    fair = [(d, v) for d, v, f in rows if f[0] >= 20 and 100 * f[4] <= 30 * f[0]]
    want = dict(zip([d for d, _ in fair], plain_em([v for _, v in fair]), strict=True))
    got = {r["doc_id"]: r for r in quality.judge(df).collect()}
    assert all(abs(got[d]["posterior"] - p) < 1e-6 and got[d]["kept"] == (p >= 0.5) for d, p in want.items())
