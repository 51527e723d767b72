"""Quality rules as weak supervision.

Each rule votes good (1), bad (-1) or abstains (0) on a document's figures. Expectation-maximisation over the counts of all
vote patterns estimates how each rule votes on good and on bad documents (its accuracies), and the share of good documents;
a document stays if its posterior probability of being good is at least 0.5. A pattern is a number below 3 ** rules, so
what the driver sees is bounded whatever the input's size, and counts cover all documents.

Defined cases: null text has no words and fails the base test, as all texts under 20 words do; null or repeated doc_ids
are rows like any other; without documents that pass the base test the prior decides; an empty table gives an empty result; other
columns are never looked at. Very long texts are read whole, in time and memory in proportion to their length, and by the same rules:
every figure is a share of the text, and that of different words is a mean over windows of SPAN words, so no rule knows a text's length.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import stash
from .common import id_and_text, slices, utf8

WINDOW = 8
MIN_WORDS = 20
REPEAT_PERCENT = 30
#: Words of each window over which different words are counted.
SPAN = 200
#: Frequent function words of English, German, French and Spanish. Words that several of them share count once.
STOP_WORDS = frozenset(
    b"the of and to in that is was for on as with by at from this are be not "
    b"der die das und in den von zu mit im ist des auf eine dem nicht ein als auch es "
    b"le la les de des et en un une du que est pour dans par sur pas au avec qui "
    b"el los las y que se del por con una su para es al lo como o esta".split()
)
#: Fixed random odd factors of a window's hash.
FACTORS = np.random.default_rng(8).integers(0, 2**63, WINDOW, np.uint64) * np.uint64(2) + np.uint64(1)
_WHITE = bytes([9, 10, 11, 12, 13, 32])
_TAILS = bytes(range(0x80, 0xC0))  # bytes of a character after its first
_UPPER = bytes(range(65, 91))
_NO_LETTER = bytes(b for b in range(128) if not chr(b).isalpha())
_EDGE = b"\"'()[]{}<>,;:!?."  # what may stand around a word

#: Rule: figure, bad at or beyond, good at or within, and whether large values are bad.
RULES = (
    ("symbols", 0.15, 0.02, True),
    ("upper", 0.5, 0.2, True),
    ("shouts", 0.15, 0.01, True),
    ("repeats", 0.2, 0.05, True),
    ("dup_lines", 0.3, 0.1, True),
    ("stutter", 0.2, 0.03, True),
    ("top_word", 0.25, 0.15, True),
    ("distinct", 0.15, 0.4, False),
    ("letters", 0.6, 0.85, False),
    ("stop_words", 0.005, 0.05, False),
)


def repeated_words(ids: np.ndarray) -> int:
    """Words inside 8-word windows that are found twice or more, the first ones included."""
    n = len(ids) - WINDOW + 1
    if n < 2:
        return 0
    own = ids.astype(np.uint64)
    hashes = own[:n] * FACTORS[0]
    for k in range(1, WINDOW):
        hashes += own[k : n + k] * FACTORS[k]
    at = np.flatnonzero(pd.Series(hashes).duplicated(keep=False).to_numpy())
    cover = np.zeros(len(ids) + 1, np.int32)
    cover[at] += 1
    cover[at + WINDOW] -= 1
    return int((np.cumsum(cover) > 0).sum())


def distinct_share(ids: np.ndarray, span: int = SPAN) -> float:
    """Different words of each window of ``span`` words (the last may be shorter), summed, over all words."""
    n = len(ids)
    keys = np.arange(n) // span * (int(ids.max(initial=0)) + 1) + ids
    return len(np.unique(keys)) / n


def figures(text: bytes) -> tuple:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words and the figures that RULES name, in their order."""
    words = text.split()
    n = len(words)
    seen: dict[bytes, int] = {}
    ids = np.fromiter((seen.setdefault(w, len(seen)) for w in words), np.int64, n)
    solid = text.translate(None, _WHITE)
    symbols = len(text) - len(text.translate(None, b"#*$%&|<>"))
    lines = [x for x in text.split(b"\n") if x.strip(_WHITE)]
    dup_lines = len(lines) - len(set(lines))
    repeats = repeated_words(ids)
    base = (n, len(solid.translate(None, _TAILS)), symbols, dup_lines, repeats)
    if not n:
        return *base, *[None] * len(RULES)
    counts = np.bincount(ids)
    letters = len(text.translate(None, _NO_LETTER))
    stop = sum(int(counts[k]) for w, k in seen.items() if w.lower().strip(_EDGE) in STOP_WORDS)
    return (
        *base, symbols / n, (len(text) - len(text.translate(None, _UPPER))) / max(letters, 1), text.count(b"!!") / n, repeats / n, dup_lines / max(len(lines), 1),
        int((ids[1:] == ids[:-1]).sum()) / n, counts.max() / n, distinct_share(ids), letters / max(len(solid), 1), stop / n,
    )


def vote(value: float | None, bad: float, good: float, large_is_bad: bool) -> int:
    if value is None:
        return 0
    if not large_is_bad:
        value, bad, good = -value, -bad, -good
    return -1 if value >= bad else int(value <= good)


def pattern(votes: list[int]) -> int:
    """The votes as digits of a number to the base 3, the first rule's last."""
    return sum((v + 1) * 3**k for k, v in enumerate(votes))


_BASE = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def _figures(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in slices(batches):
        rows = [figures(t) for t in utf8(b)]
        codes = [pattern([vote(v, *r[1:]) for v, r in zip(x[len(_BASE) :], RULES, strict=True)]) for x in rows]
        yield pa.RecordBatch.from_arrays(
            [b.column("doc_id"), *[pa.array([x[k] for x in rows], pa.int64()) for k in range(len(_BASE))], pa.array(codes, pa.int32())], names=["doc_id", *_BASE, "pattern"]
        )


def fit(patterns: np.ndarray, counts: np.ndarray, rounds: int = 100) -> tuple[np.ndarray, np.ndarray]:
    """The posterior of each possible pattern, and P(vote | class) as (rule, class, vote).

    The first guess: a document is the worse the more rules vote bad. Pseudo-counts keep every probability off zero.
    """
    m = len(RULES)
    votes = patterns[:, None] // 3 ** np.arange(m) % 3  # 0 bad, 1 abstained, 2 good
    one = np.eye(3)[votes]  # pattern, rule, vote
    good = np.choose(np.minimum((votes == 0).sum(1), 2), [0.95, 0.3, 0.03])
    prior = np.array([[1.0, 0.5, 0.25], [0.25, 0.5, 1.0]]) * 2  # of the classes bad, good
    for _ in range(rounds):
        weight = np.stack([(1 - good) * counts, good * counts])
        table = np.einsum("cp,prv->rcv", weight, one) + prior
        table /= table.sum(2, keepdims=True)
        share = (weight.sum(1) + [1, 4]) / (counts.sum() + 5)
        logs = np.log(share)[None] + np.einsum("prv,rcv->pc", one, np.log(table))
        new = 1 / (1 + np.exp(np.clip(logs[:, 0] - logs[:, 1], -500, 500)))
        if np.abs(new - good).max(initial=0) < 1e-9:
            break
        good = new
    return good, table


def judge(df: DataFrame, threshold: float = 0.5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, posterior; a row a row."""
    docs = id_and_text(df, id_col=id_col, text_col=text_col)
    kind = docs.schema["doc_id"].dataType.simpleString()
    ddl = f"doc_id {kind}, {', '.join(f'{c} long' for c in _BASE)}, pattern int"
    rows = stash(docs.mapInArrow(_figures, ddl), "figures").withColumn(
        "base_failed", (F.col("n_words") < MIN_WORDS) | (F.col("n_repeat_words") * 100 > F.col("n_words") * REPEAT_PERCENT)
    )
    found = rows.groupBy("pattern").agg(F.sum(F.when(F.col("base_failed"), 0).otherwise(1)).alias("n")).collect()  # at most 3 ** rules
    codes, counts = np.array([r["pattern"] for r in found], np.int64), np.array([r["n"] for r in found], float)
    good = fit(codes, counts)[0] if len(codes) else []
    known = df.sparkSession.createDataFrame([(int(c), float(g)) for c, g in zip(codes, good, strict=True)], "pattern int, posterior double")
    return rows.join(F.broadcast(known), "pattern").select(
        "doc_id", *_BASE, "base_failed", (~F.col("base_failed") & (F.col("posterior") >= threshold)).alias("kept"), "posterior"
    )
