"""Near copies by shingle sets against all pairs."""

from __future__ import annotations

import random

import pytest

from inkstrata.llm import jaccard

from . import edges


def sets_of(text: str) -> set:
    words = text.lower().split()
    return {" ".join(words[i : i + 5]) for i in range(max(len(words) - 4, 1))} if words else set()


def brute_keep(rows: list[tuple]) -> list:
    sets = [sets_of(t or "") for _, t in rows]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, x in enumerate(sets):
        for j, y in enumerate(sets[:i]):
            if 5 * len(x & y) >= 4 * len(x | y):
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    best = {}
    for i, (d, _) in enumerate(rows):
        best[find(i)] = min(best.get(find(i), d), d)
    return sorted(best.values())


@pytest.mark.parametrize("which", ["docs", "chains", "edited"])
def test_near_copies_are_all_dropped(spark, which, monkeypatch):
    rng = random.Random(3)
    if which == "docs":
        rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()]
    else:
        texts = []
        for g in range(6):
            base = own = [f"g{g}w{rng.randrange(60)}" for _ in range(100)]
            for _ in range(15):
                own = (own if which == "chains" else base)[:]
                for _ in range(rng.randrange(1, 5)):
                    own[rng.randrange(100)] = f"v{rng.randrange(1000)}"
                texts.append(" ".join(own))
        rows = list(enumerate(texts))
    got = jaccard.drop_near(spark.createDataFrame(rows, "doc_id long, text string").repartition(3))
    assert sorted(r["doc_id"] for r in got.collect()) == brute_keep(rows)


def test_the_pipelines_stage_drops_a_copy_at_0_8(spark):
    import corpus_pipeline

    words = [f"w{i}" for i in range(104)]  # 100 shingles, 5 of them lost to each changed word
    near, far = words[:], words[:]
    for i in (50, 80):
        near[i] = far[i] = "new"
    for i in (10, 20, 30):
        far[i] = "other"
    rows = [(1, " ".join(words)), (2, " ".join(near)), (3, " ".join(far))]
    got = corpus_pipeline.drop_near_copies(spark, spark.createDataFrame(rows, "doc_id long, text string"), "")
    assert sorted(r["doc_id"] for r in got.collect()) == [1, 3]


def test_candidates_come_from_simhash_and_balls():
    from inkstrata.llm import simhash

    words = [f"w{i}" for i in range(300)]
    members = jaccard.shingle_set(" ".join(words).encode())
    mark, points = jaccard.fingerprint(members, 20)
    assert mark == simhash.simhash(" ".join(words).encode(), 5)  # no shingle is repeated
    assert len(set(points.tolist())) == jaccard.SEGMENTS * (1 + jaccard.FLIPS)
    own = points.reshape(jaccard.SEGMENTS, -1)
    assert all(bin(int(p) ^ int(r[0])).count("1") == 1 and int(p) >> 20 == k for k, r in enumerate(own) for p in r[1:])


def test_pairs_just_over_0_8_meet():
    rng = random.Random(8)
    met = 0
    for n in range(300):
        words = [f"{n}w{i}" for i in range(104)]  # 100 shingles
        other = words[:]
        for i in rng.sample(range(5, 50, 5), 1) + rng.sample(range(55, 100, 5), 1):
            other[i] = "new"  # 90 of 110 stay
        marks, points = zip(*(jaccard.fingerprint(jaccard.shingle_set(" ".join(x).encode()), 24) for x in (words, other)))
        met += (marks[0] ^ marks[1]).bit_count() <= jaccard.RADIUS and bool(set(points[0].tolist()) & set(points[1].tolist()))
    assert met >= 270


def test_nothing_and_edges(spark):
    assert jaccard.drop_near(edges.empty(spark)).count() == 0
    assert jaccard.drop_near(edges.table(spark)).columns == edges.table(spark).columns


def test_pairs_compared_follow_the_texts_not_the_pairs_of_a_group(spark, monkeypatch):
    compared, whole = [], jaccard._verified
    monkeypatch.setattr(jaccard, "_verified", lambda pairs, sets: (compared.append(pairs.count()), whole(pairs, sets))[1])
    for n in (100, 200):
        words, compared[:] = [f"w{i}" for i in range(100)], []
        rows = [(k, " ".join([*words[: k % 90], f"new{k}", *words[k % 90 + 1 :]])) for k in range(n)]  # 86 shingles of 106 at least are common
        got = jaccard.drop_near(spark.createDataFrame(rows, "doc_id long, text string").repartition(3))
        assert [r["doc_id"] for r in got.collect()] == [0]
        assert n - 1 <= sum(compared) <= 4 * n


def test_pairs_that_are_less_likely_are_compared_too(spark, monkeypatch):
    rows = [(k, " ".join(f"w{i if i != 10 * (k % 9) + 5 else -k}" for i in range(100))) for k in range(12)]
    monkeypatch.setattr(jaccard, "_likely", lambda pairs: pairs.select("u", "v").limit(0))
    got = jaccard.drop_near(spark.createDataFrame(rows, "doc_id long, text string"))
    assert [r["doc_id"] for r in got.collect()] == brute_keep(rows) == [0]
