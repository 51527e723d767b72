"""Contextual extraction on planted texts, and on long ones."""

from __future__ import annotations

import random
import time
from collections import Counter

import pytest

from inkstrata.llm import pii

CALM = "the plan of the house and the garden is made by all in the time that is left for it and for the others who come".split()


def words(rng: random.Random, n: int) -> str:
    return " ".join(rng.choice(CALM) for _ in range(n))


def planted(seed: int) -> tuple[list[tuple], dict[int, list[str]], set[int]]:
    """Rows, the hidden identifiers of some of them, and ids of calm look-alikes with numbers that are nobody's.

    Mail addresses and phones teach contexts; hidden are masked addresses, staff numbers and short dial codes in the same
    contexts, and (for the second round) badge numbers whose context only hidden ones share.
    """
    rng, rows, hidden, calm = random.Random(seed), [], {}, set()
    contexts = ["Please contact owner: {} for this.", "You may reach them via {} today.", "Her account=<{}> is open."]
    for i in range(120):
        seen = f"user{rng.randrange(10**6)}@mail{rng.randrange(50)}.example.com" if i % 3 else f"+1 555 {rng.randrange(100, 999)} {rng.randrange(1000, 9999)}"
        rows.append((len(rows), f"{words(rng, 12)}. {contexts[i % 3].format(seen)} {words(rng, 9)}"))
    staff = [f"ZK-{rng.randrange(10**5, 10**6)}-{rng.randrange(10, 99)}" for _ in range(40)]
    for i in range(90):
        own = staff[i % 40] if i % 2 else f"user{rng.randrange(10**6)}(at)mail-example"
        hidden[len(rows)] = [own]
        rows.append((len(rows), f"{words(rng, 10)}. {contexts[i % 3].format(own)} {words(rng, 8)}"))
    for i in range(30):  # most of these are known by now, eight are found by this context alone
        own = staff[2 * i % 40 + 1] if i < 22 else f"QX/{rng.randrange(10**6, 10**7)}"
        hidden[len(rows)] = [own]
        rows.append((len(rows), f"{words(rng, 8)} and the badge no. {own} was lost {words(rng, 5)}"))
    for i in range(120):
        calm.add(len(rows))
        rows.append((len(rows), f"{words(rng, 6)} in {1900 + i} about {rng.randrange(10**4, 10**6)} people came to room{rng.randrange(100, 999)} of the house {words(rng, 6)}"))
    for i in range(40):  # contexts that resemble the good ones, before ordinary words and numbers
        calm.add(len(rows))
        rows.append((len(rows), f"{words(rng, 6)} so please contact us for {rng.randrange(1000, 9999)} more, via the house {words(rng, 6)}"))
    return rows, hidden, calm


@pytest.mark.parametrize("seed", [1, 2])
def test_planted_identifiers_are_found(spark, seed):
    rows, hidden, calm = planted(seed)
    got = {r["doc_id"]: r for r in pii.find_pii(spark.createDataFrame(rows, "doc_id long, text string").repartition(4)).collect()}
    found, right, false = 0, 0, 0
    for d, text in rows:
        spans = [x.split(":") for x in got[d]["spans"].split(",") if x.startswith("context")]
        own = [text[int(a) : int(b)] for _, a, b in spans]
        found += len(own)
        right += sum(x in hidden.get(d, []) for x in own)
        false += bool(own) and d in calm
    recall, precision = right / sum(map(len, hidden.values())), right / max(found, 1)
    print(f"recall {recall:.3f}, precision {precision:.3f}, calm documents with a span {false}")
    assert recall >= 0.9 and precision >= 0.9 and not false
    assert any(got[d]["spans"] != got[d]["base"] for d in hidden)


def test_the_filter_passes_all_candidates(spark):
    ids = pii.numbered_each([(k % 3, pii._hash(str(k)), 5) for k in range(5_000)])
    known = pii.bloom(spark.createDataFrame([(i,) for i in ids], "pattern long").repartition(3))
    import numpy as np

    every = np.array(pii.numbered_each([(k % 3, pii._hash(str(k)), 5) for k in range(10_000)]))
    hit = np.ones(len(every), bool)
    for at in pii._bits(every, 8 * len(known)):
        hit &= (known[at >> 3] >> (7 - (at & 7)).astype(np.uint8)) & 1 == 1
    assert hit[:5_000].all() and hit[5_000:].mean() < 0.1
    assert pii.bloom(spark.createDataFrame([], "pattern long")).sum() == 0


def test_occurrences_of_plain_text():
    rng = random.Random(4)
    texts = [" ".join(rng.choice(["a:", "B", "c=d", "9", "10", "x#y:z", "É"]) for _ in range(rng.randrange(8))) for _ in range(50)]
    want = Counter()
    for t in texts:
        w = [pii.plain(x) for x in t.split()]
        for i, x in enumerate(w):
            if i + 1 < len(w):
                want[pii.TWO, x, w[i + 1]] += 1
            if i + 2 < len(w):
                want[pii.BOTH, x, w[i + 2]] += 1
            if m := pii.SEPARATOR.search(x):
                want[pii.LABEL, x[: m.end()], None] += 1
    names = pii.numbered_each([(k, pii._hash(a), 0 if b is None else pii._hash(b)) for k, a, b in want])
    assert Counter(pii.occurrences(texts).tolist()) == dict(zip(names, want.values(), strict=True))


@pytest.mark.parametrize("text", ["1.2.3.4," * 600_000, "a1@b.c " * 600_000, "x1y2 " * 1_000_000, "1.2.3.4=" * 600_000, "a" * 2_000_000 + " 1.2.3.4 9.9.9.9"])
def test_long_texts_take_linear_time(text):
    took = []
    for t in (text[: len(text) // 4], text):
        began = time.time()
        base = pii.base_spans(t)
        words = pii.Words(t)
        for _, a, b in base:
            pii.patterns(words, a, b)
        for a, b in pii.instances(t, base):
            pii.patterns(words, a, b)
        pii.occurrences([t])
        took.append(time.time() - began)
    assert took[1] < 40 and took[1] < 9 * took[0] + 1
