"""Personal data by bootstrapped contextual extraction.

Base patterns find emails, IP addresses, card and phone numbers in every whole text; these are the seeds. The words around a
seed induce lexical patterns (two words before; the word before and the word after; a label that ends in a colon or the like).
Identifier-like words (with a digit or an @) in other places are instances of the patterns around them. Spark scores the
graph of patterns and instances in rounds: a pattern is as good as the share of its occurrences that are before known instances
(of which there must be SUPPORT different ones), where occurrences before ordinary words count in full against it and those before
other identifier-like words by UNKNOWN; an instance becomes known if good patterns describe at
least half of its places, and so supports further patterns in the next round. Words in a place that a pattern of high confidence
describes are reported as ``context`` spans; base spans always stay.

Patterns are numbers: hashes of their words (lower case, digits equal), so that all occurrences in a text are found in numpy. One scan
counts those that a Bloom filter of the candidates lets through; a false one has no candidate to be joined to. The filter has 16
bits a candidate up to MOST_BITS; beyond that more false ones are shuffled, with equal results.

Defined cases: null text is the empty text; null or repeated doc_ids are rows like any other; without seeds there are no
patterns and only base spans; an empty table gives an empty result; other columns are never looked at. Very long texts are read
whole: a text's words are found once, so time grows in proportion to it, also without any white space.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import stash
from .common import id_and_text, join_hot, slices, utf8
from .spans import Span, all_of, joined

KINDS = ("email", "ip", "card", "phone", "context")
#: A pattern needs so many different known instances, and this share of its occurrences; an instance this share of its places.
SUPPORT, CONFIDENCE, DESCRIBED, ROUNDS = 3, 0.8, 0.5, 3
#: How much an occurrence before an identifier-like word that isn't known counts against a pattern.
UNKNOWN = 0.25
#: Bits of the largest Bloom filter (16 MB).
MOST_BITS = 1 << 27

LOCAL_PART = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
HOST = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
# Digits can't be given back to what follows, so possessive runs match the same, and a run is tried only from its start.
IP = re.compile(r"(?<![0-9])([0-9]++)\.([0-9]++)\.([0-9]++)\.([0-9]++)")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
DIGIT = re.compile(r"[0-9]")
WORD = re.compile(r"[^\x20\x09-\x0D]+")
EDGE = "\"'()[]{}<>,;:!?."


def emails(text: str) -> Iterator[Span]:
    """The leftmost match at an @ starts with the run of local-part characters before it; linear in the text."""
    end, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > end and text[start - 1] in LOCAL_PART:
            start -= 1
        m = HOST.match(text, at + 1) if start < at else None
        if m:
            end = m.end()
            yield "email", start, end
        at = text.find("@", max(at + 1, end))


def luhn(digits: str) -> bool:
    total = 0
    for k, d in enumerate(reversed(digits)):
        n = int(d) * (1 + k % 2)
        total += n - 9 * (n > 9)
    return total % 10 == 0


def _is_card(m: re.Match) -> bool:
    digits = m[0].replace(" ", "").replace("-", "")
    return 12 <= len(digits) <= 19 and luhn(digits)


def base_spans(text: str) -> list[Span]:
    out = list(emails(text))
    if DIGIT.search(text):
        out += all_of("ip", IP, text, lambda m: all(len(x.lstrip("0")) <= 3 and int(x[-3:]) <= 255 for x in m.groups()))
        out += all_of("card", CARD, text, _is_card)
        if "+" in text:
            out += all_of("phone", PHONE, text, lambda m: 9 <= sum(c.isdigit() for c in m[0]) <= 15)
    return out


TOKEN = re.compile(r"\S+")
SEPARATOR = re.compile(r"[:=#]")
EDGES = re.compile("[" + re.escape(EDGE) + "]*")
#: The kinds of patterns; a pattern's last two bits say its kind.
TWO, BOTH, LABEL = 0, 1, 2
_MIX = np.uint64(0x9E3779B97F4A7C15)


def plain(words: str) -> str:
    """Lower case, all digits equal."""
    return DIGIT.sub("0", words.lower())


def _hash(word: str) -> int:
    return xxhash.xxh64_intdigest(word.encode(), 7)


def _instance(text: str) -> int:
    return xxhash.xxh64_intdigest(text.lower().encode(), 8) - (1 << 63)


def numbered(kind: int, first: np.ndarray, second: np.ndarray) -> np.ndarray:
    """Patterns as signed numbers, from the hashes of their words."""
    mixed = (first ^ (first >> np.uint64(29))) * _MIX + second
    mixed = (mixed ^ (mixed >> np.uint64(32))) * _MIX
    return (((mixed ^ (mixed >> np.uint64(29))) & ~np.uint64(3)) | np.uint64(kind)).view(np.int64)


class Words:
    """The borders of a text's words, found once, and what is asked of a word, once for each."""

    def __init__(self, text: str):
        self.text = text
        self.spans = [m.span() for m in TOKEN.finditer(text)]
        self.starts = [a for a, _ in self.spans]
        self._known: dict[int, tuple[int, int, int, str]] = {}

    def at(self, place: int) -> int:
        """The number of the word at a place."""
        return bisect_right(self.starts, place) - 1

    def of(self, k: int) -> tuple[int, int, int, str]:
        """A word's hash; where its first separator and where what may follow that ends (-1: no separator); its plain form up to the separator."""
        if k not in self._known:
            a, b = self.spans[k]
            word, m = plain(self.text[a:b]), SEPARATOR.search(self.text, a, b)
            name = word[: SEPARATOR.search(word).end()] if m else ""
            self._known[k] = (_hash(word), m.end() if m else -1, m.end() + EDGES.match(self.text[m.end() : b]).end() if m else -1, name)
        return self._known[k]


def patterns(words: Words, start: int, end: int) -> list[tuple[int, int, int]]:
    """The lexical patterns around a span, from whole words before and after those that it touches: (kind, hash, hash)."""
    first, last = words.at(start), words.at(end - 1)
    out = []
    if first >= 2:
        out.append((TWO, words.of(first - 2)[0], words.of(first - 1)[0]))
    if first >= 1 and last + 1 < len(words.spans):
        out.append((BOTH, words.of(first - 1)[0], words.of(last + 1)[0]))
    # A label ends right before the span: in its own word, or else as the whole word before.
    if start > words.starts[first]:
        _, after, free, label = words.of(first)
        if after <= start <= free:
            out.append((LABEL, _hash(label), 0))
    elif first >= 1 and words.of(first - 1)[1] == words.spans[first - 1][1]:
        out.append((LABEL, _hash(words.of(first - 1)[3]), 0))
    return out


def occurrences(texts: list[str]) -> np.ndarray:
    """All patterns of the texts, whatever word is in their place, one for each occurrence."""
    seen: dict[str, int] = {}
    forms: dict[str, int] = {}
    hashes: list[int] = []
    labels: list[int] = []
    parts, ends = [], []
    for text in texts:
        ids = []
        for w in text.split():
            k = seen.get(w)
            if k is None:
                form = plain(w)
                k = forms.get(form)
                if k is None:
                    k = forms[form] = len(hashes)
                    hashes.append(_hash(form))
                    m = SEPARATOR.search(form)
                    labels.append(_hash(form[: m.end()]) if m else 0)
                seen[w] = k
            ids.append(k)
        parts.append(np.array(ids, np.int64))
        ends.append(len(ids))
    ids = np.concatenate(parts) if parts else np.zeros(0, np.int64)
    text_of = np.repeat(np.arange(len(ends)), ends)
    table, label = np.array(hashes, np.uint64), np.array(labels, np.uint64)
    own = table[ids] if len(ids) else np.zeros(0, np.uint64)
    inside = lambda k: text_of[k:] == text_of[: max(0, len(ids) - k)]
    two = numbered(TWO, own[:-1], own[1:])[inside(1)] if len(ids) > 1 else np.zeros(0, np.int64)
    both = numbered(BOTH, own[:-2], own[2:])[inside(2)] if len(ids) > 2 else np.zeros(0, np.int64)
    told = label[ids] if len(ids) else label
    told = told[told > 0]
    return np.concatenate([two, both, numbered(LABEL, told, np.zeros(len(told), np.uint64))])


def _is_identifier(s: str) -> bool:
    return len(s) >= 4 and ("@" in s or len(DIGIT.findall(s)) >= 2)


def instances(text: str, taken: list[Span]) -> Iterator[tuple[int, int]]:
    """Identifier-like words outside the base spans: at least 4 characters, with an @ or two digits; of a word with a label, what follows it."""
    if "@" not in text and not DIGIT.search(text):
        return
    busy = sorted((a, b) for _, a, b in taken)
    k = 0
    for m in WORD.finditer(text):
        word = m[0]
        if not _is_identifier(word):
            continue
        label = SEPARATOR.search(word)
        rest = word[label.end() :].strip(EDGE) if label else ""
        if _is_identifier(rest):
            core, from_ = rest, label.end()
        else:
            core, from_ = word.strip(EDGE), 0
        if len(core) < 4:
            continue
        start = m.start() + from_ + EDGES.match(word, from_).end() - from_
        end = start + len(core)
        while k < len(busy) and busy[k][1] <= start:
            k += 1
        if k == len(busy) or busy[k][0] >= end:
            yield start, end


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Base figures of each text, and its places: (pattern, instance, known, start, end)."""
    place = pa.list_(pa.struct([("pattern", pa.int64()), ("instance", pa.int64()), ("known", pa.bool_()), ("start", pa.int64()), ("end", pa.int64())]))
    for b in slices(batches):
        spans, places = [], []
        for raw in utf8(b):
            text = raw.decode()
            base = base_spans(text)
            spans.append(joined(base, KINDS))
            seen = [(True, s, e) for _, s, e in base] + [(False, s, e) for s, e in instances(text, base)]
            around = [(known, s, e, p) for words in [Words(text) if seen else None] for known, s, e in seen for p in patterns(words, s, e)]
            names = numbered_each([p for *_, p in around])
            places.append([{"pattern": n, "instance": _instance(text[s:e]), "known": known, "start": s, "end": e} for n, (known, s, e, _) in zip(names, around, strict=True)])
        yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(spans, pa.string()), pa.array(places, place)], names=["doc_id", "base", "places"])


def numbered_each(found: list[tuple[int, int, int]]) -> list[int]:
    return [int(numbered(kind, np.array([a], np.uint64), np.array([b], np.uint64))[0]) for kind, a, b in found]


def _bits(patterns: np.ndarray, bits: int) -> list[np.ndarray]:
    """Two places of each pattern in a filter of so many bits (a power of two)."""
    own = patterns.view(np.uint64)
    return [((own >> np.uint64(shift)) & np.uint64(bits - 1)).astype(np.int64) for shift in (2, 31)]


def _filter(batches: Iterator[pa.RecordBatch], bits: int) -> Iterator[pa.RecordBatch]:
    """The set bits of each batch's patterns, in blocks of 4 KB."""
    for b in batches:
        places = np.unique(np.concatenate(_bits(b.column("pattern").to_numpy(zero_copy_only=False), bits)))
        blocks, first = np.unique(places >> 15, return_index=True)
        out = []
        for lo, hi in zip(first.tolist(), [*first[1:].tolist(), len(places)], strict=True):
            own = np.zeros(1 << 15, np.uint8)
            own[places[lo:hi] & 32767] = 1
            out.append(np.packbits(own).tobytes())
        yield pa.RecordBatch.from_pydict({"part": pa.array(blocks, pa.int64()), "set": pa.array(out, pa.binary())})


def _united(key: tuple, table: pa.Table) -> pa.Table:
    whole = np.zeros(4096, np.uint8)
    for x in table.column("set").to_pylist():
        whole |= np.frombuffer(x, np.uint8)
    return pa.table({"part": [key[0].as_py()], "set": [whole.tobytes()]})


def bloom(names: DataFrame) -> np.ndarray:
    """The candidates' filter, unpacked to a byte a bit in each task; 16 MB packed at most, however many there are."""
    bits = 1 << 15
    while bits < min(16 * names.count(), MOST_BITS):
        bits *= 2
    rows = names.select("pattern").mapInArrow(partial(_filter, bits=bits), "part long, set binary").groupBy("part").applyInArrow(_united, "part long, set binary").collect()
    whole = np.zeros((bits >> 15, 4096), np.uint8)
    for r in rows:
        whole[r["part"]] = np.frombuffer(r["set"], np.uint8)
    return whole.reshape(-1)


def _count(batches: Iterator[pa.RecordBatch], known: np.ndarray) -> Iterator[pa.RecordBatch]:
    """Occurrences of what the filter lets through, summed for each batch."""
    bits = 8 * len(known)
    for b in slices(batches):
        names = occurrences([raw.decode() for raw in utf8(b)])
        for at in (0, 1):
            place = _bits(names, bits)[at]
            names = names[(known[place >> 3] >> (7 - (place & 7)).astype(np.uint8)) & 1 == 1]
        names, counts = np.unique(names, return_counts=True)
        yield pa.RecordBatch.from_pydict({"pattern": pa.array(names, pa.int64()), "seen": pa.array(counts, pa.int64())})


def totals(docs: DataFrame, names: DataFrame) -> DataFrame:
    """(pattern, seen): occurrences in all texts, of ``names`` and of a few others; one scan."""
    return docs.select("text").mapInArrow(partial(_count, known=bloom(names)), "pattern long, seen long").groupBy("pattern").agg(F.sum("seen").alias("seen"))


def good_patterns(docs: DataFrame, places: DataFrame, rounds: int = ROUNDS, support: int = SUPPORT, confidence: float = CONFIDENCE) -> DataFrame:
    """(pattern, own) of high confidence and their own places, from places (pattern, instance, known) of docs (text).

    Edges are counted, whatever the number of places. Every round is one aggregate over patterns, one join of the good
    ones back to their edges and one aggregate over instances.
    """
    edges = stash(places.groupBy("pattern", "instance").agg(F.max("known").alias("known"), F.count("*").alias("places")), "edges")
    # Only patterns with enough different instances can ever be good, so the others' edges aren't carried along but for their places.
    sizes = edges.groupBy("pattern").agg(F.count("*").alias("n"), F.sum("places").alias("own")).where(f"n >= {support}")
    sizes = stash(sizes, "sizes")
    seen = sizes.join(totals(docs, sizes), "pattern", "left").select("pattern", "n", "own", F.greatest("own", F.coalesce("seen", F.lit(0))).alias("seen"))
    seen, total = stash(seen, "seen"), edges.count()
    # An instance's places by kind: each place has a pattern of each kind at most.
    kinds = (TWO, BOTH, LABEL)
    of = F.col("pattern").bitwiseAND(F.lit(3))
    by_kind = [F.sum(F.when(of == k, F.col("places")).otherwise(0)).alias(f"all{k}") for k in kinds]
    all_places = stash(edges.where("not known").groupBy("instance").agg(F.count("*").alias("m"), *by_kind), "instances")
    edges = stash(join_hot(edges, seen.select("pattern", "n", "own", "seen"), "pattern", "n", total), "edges")
    found = None
    for k in range(rounds):
        scored = edges if found is None else edges.join(found, "instance", "left").withColumn("known", F.col("known") | F.coalesce("told", F.lit(False)))
        rated = scored.groupBy("pattern").agg(
            F.sum(F.when(F.col("known"), F.col("places")).otherwise(0)).alias("hits"), F.count_if("known").alias("known"), *[F.first(c).alias(c) for c in ("n", "own", "seen")])
        against = F.col("seen") - F.col("own") + (F.col("own") - F.col("hits")) * UNKNOWN
        good = stash(rated.where((F.col("hits") >= confidence * (F.col("hits") + against + 0.5)) & (F.col("known") >= support)).select("pattern", "n", "own"), "good")
        if k == rounds - 1 or good.isEmpty():
            break
        reached = join_hot(edges.where("not known").select("pattern", "instance", "places"), good.select("pattern", "n"), "pattern", "n", total)
        reached = reached.groupBy("instance").agg(*[F.sum(F.when(of == i, F.col("places")).otherwise(0)).alias(f"good{i}") for i in kinds])
        told = reached.join(all_places, "instance").where(F.greatest(*[F.coalesce(F.try_divide(f"good{i}", f"all{i}"), F.lit(0.0)) for i in kinds]) >= DESCRIBED)
        new = stash(told.select("instance", F.lit(True).alias("told")), "told")
        if new.isEmpty() or (found is not None and new.count() == found.count()):
            break
        found = new
    return good.select("pattern", "own")


def find_pii(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, base and spans (joined kind:start:end) for each row of ``df``."""
    docs = id_and_text(df, id_col=id_col, text_col=text_col)
    kind = docs.schema["doc_id"].dataType.simpleString()
    ddl = f"doc_id {kind}, base string, places array<struct<pattern:long,instance:long,known:boolean,start:long,end:long>>"
    rows = stash(docs.mapInArrow(_scan, ddl).withColumn("uid", F.monotonically_increasing_id()), "scanned")
    places = rows.where(F.size("places") > 0).select("uid", F.explode("places").alias("p")).select("uid", "p.*")
    good = good_patterns(docs, places)
    at = join_hot(places.where("not known"), good, "pattern", "own", places.count()).groupBy("uid").agg(F.collect_set(F.struct("start", "end")).alias("more"))
    out = rows.drop("places").join(at, "uid", "left")
    # Base spans are sorted already; the few rows with more are merged and sorted again by start, then kind.
    one = F.filter(F.split(F.col("base"), ","), lambda x: x != "")
    parsed = F.transform(one, lambda x: F.struct(F.split(x, ":")[1].cast("long").alias("start"), F.array_position(F.array(*map(F.lit, KINDS)), F.split(x, ":")[0]).alias("k"), x.alias("s")))
    extra = F.transform("more", lambda x: F.struct(x["start"].alias("start"), F.lit(len(KINDS)).cast("long").alias("k"), F.format_string("context:%d:%d", x["start"], x["end"]).alias("s")))
    both = F.array_sort(F.concat(parsed, extra))
    return out.select("doc_id", "base", F.when(F.col("more").isNull(), F.col("base")).otherwise(F.array_join(F.transform(both, lambda x: x["s"]), ",")).alias("spans"))


def counts(base: str) -> list:
    """Columns with the number of base spans of each kind, from the joined spans."""
    kinds = F.transform(F.split(F.col(base), ","), lambda x: F.split(x, ":")[0])
    return [(F.size(kinds) - F.size(F.array_remove(kinds, k))).cast("long").alias(f"n_{k}") for k in KINDS[:-1]]
