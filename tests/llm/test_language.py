"""Predictions of whole texts against a plain convolution; a fit that doesn't depend on the order of rows."""

from __future__ import annotations

import math
import random

import numpy as np

from inkstrata.llm import language

WORDS = {"en": "the house and the garden of all who come with us", "de": "das haus und der garten von allen die mit uns kommen", "fr": "la maison et le jardin de tous ceux qui viennent avec nous"}


def some(rng: random.Random, lang: str, n: int) -> str:
    return " ".join(rng.choice(WORDS[lang].split()) for _ in range(n))


def plain_prediction(net: language.Network, text: bytes) -> tuple[str, float]:
    """Mean log probabilities of windows of 512 bytes that step by 509, each filter by loops over its places."""
    if not language.LETTER.search(text.decode()):
        return "und", 0.0
    logs = []
    for at in range(0, max(len(text), 1), language.WINDOW - 3):
        own = text[at : at + language.WINDOW].ljust(language.WINDOW, b" ")
        h = []
        for w in language.WIDTHS:
            for f in range(language.FILTERS):
                h.append(max(0.0, max(sum(float(net.tables[w][j][own[p + j]][f]) for j in range(w)) + float(net.bias[w][f]) for p in range(language.WINDOW - 3))))
        z = [sum(x * float(net.dense[i][k]) for i, x in enumerate(h)) + float(net.last[k]) for k in range(len(net.labels))]
        norm = max(z) + math.log(sum(math.exp(x - max(z)) for x in z))
        logs.append([x - norm for x in z])
    mean = [sum(x) / len(logs) for x in zip(*logs, strict=True)]
    p = [math.exp(x - max(mean)) for x in mean]
    best = max(range(len(p)), key=lambda k: p[k])
    return net.labels[best], p[best] / sum(p)


def test_predictions_are_those_of_a_plain_version():
    rng = random.Random(2)
    train = [(some(rng, lang, 40).encode(), lang) for lang in WORDS for _ in range(40)]
    net = language.train([t for t, _ in train], [x for _, x in train], epochs=3)
    texts = [some(rng, lang, n).encode() for lang in WORDS for n in (1, 30, 250)] + [b"", b"12 34 !?", b"x", ("é" * 300).encode(), (some(rng, "en", 90) + some(rng, "fr", 90)).encode()]
    got = language.predict(net, net.pairs(), texts)
    for (label, p), t in zip(got, texts, strict=True):
        want, q = plain_prediction(net, t)
        assert abs(p - q) < 1e-4 and (label == want or abs(p - 0.5) < 1e-3), t[:30]


def test_the_fit_ends_once_it_is_settled():
    rng = random.Random(3)
    train = [(some(rng, lang, 60).encode(), lang) for lang in WORDS for _ in range(300)]
    texts, labels = [t for t, _ in train], [x for _, x in train]
    held = [(some(rng, lang, 30).encode(), lang) for lang in WORDS for _ in range(50)]
    for settled in (0.0, language.SETTLED):
        net = language.train(texts, labels, settled=settled)
        got = language.predict(net, net.pairs(), [t for t, _ in held])
        assert sum(a == lang for (a, _), (_, lang) in zip(got, held, strict=True)) >= 0.98 * len(held)


def test_learning_does_not_depend_on_the_order_of_rows(spark):
    rng = random.Random(4)
    rows = [(k % 7, some(rng, lang, 30), lang) for lang in WORDS for k in range(60)]  # ids that many rows share
    nets = []
    for seed, parts in ((1, 1), (2, 5)):
        random.Random(seed).shuffle(rows)
        nets.append(language.learn(spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(parts)))
    assert all(np.array_equal(a, b) for w in language.WIDTHS for a, b in zip(nets[0].tables[w], nets[1].tables[w], strict=True))
