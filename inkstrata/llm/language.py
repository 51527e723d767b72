"""Language identification by a byte convolutional network.

Texts are cut into windows of a fixed number of bytes (neighbours share the widest filter's margin, so no byte pair is
lost). A window's bytes pass filters of several widths, a rectifier, a maximum over the window and a softmax; a text's
prediction is the mean of its windows' log probabilities. Trained in numpy on labelled windows: at most ``most`` documents
(those with the least hash of their id) with at most ``windows`` windows of each, a documented bound on a fit.

A filter sums one table look-up for each byte of its width, and two bytes are looked up at once, so applying the network
takes three gathers a byte. Every window of every whole text is scored.

Defined cases: null text and text without a letter give ``und`` with score 0; so does every text if no label is known. Null
labels aren't learned from. Null or repeated doc_ids are rows like any other. An empty table gives an empty result. Other columns
are never looked at. Very long texts are scored whole, a bounded number of windows at a time.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import id_and_text, slices, utf8

WIDTHS = (2, 3, 4)
FILTERS = 16
WINDOW = 512
#: Bounds of the fit.
MOST_DOCUMENTS, WINDOWS_EACH, EPOCHS, SETTLED = 3_000, 4, 8, 0.005
LETTER = re.compile(r"[^\W\d_]")
PAD = 0x20


@dataclass
class Network:
    """tables[w][j]: (256, FILTERS), what byte j of a width-w filter adds; dense: (features, labels)."""

    labels: list[str]
    tables: dict[int, list[np.ndarray]]
    bias: dict[int, np.ndarray]
    dense: np.ndarray
    last: np.ndarray

    def pairs(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Look-up tables for two bytes at once: first pair of all widths, third byte of 3, second pair of 4."""
        two = lambda a, b: (a[:, None, :] + b[None, :, :]).reshape(65536, -1)
        first = np.concatenate([two(t[0], t[1]) + self.bias[w] for w, t in self.tables.items()], axis=1)
        return first.astype(np.float32), self.tables[3][2].astype(np.float32), two(self.tables[4][2], self.tables[4][3]).astype(np.float32)


def windows(text: bytes, size: int = WINDOW) -> np.ndarray:
    """(n, size) bytes that cover the whole text; the last window is padded with spaces."""
    step = size - max(WIDTHS) + 1
    data = np.frombuffer(text, np.uint8)
    n = max(1, -(-len(data) // step))
    full = np.full((n - 1) * step + size, PAD, np.uint8)
    full[: len(data)] = data
    return np.lib.stride_tricks.sliding_window_view(full, size)[::step]


def features(net_pairs: tuple, data: np.ndarray) -> np.ndarray:
    """Maxima of all filters, rectified: (windows, 3 * FILTERS)."""
    first, third, second = net_pairs
    at = data.astype(np.uint16)
    key = (at[:, :-1] << 8) | at[:, 1:]
    n = data.shape[1] - 3
    out = np.take(first, key[:, :n], axis=0)
    f = third.shape[1]
    out[:, :, f : 2 * f] += np.take(third, data[:, 2 : n + 2], axis=0)
    out[:, :, 2 * f :] += np.take(second, key[:, 2 : n + 2], axis=0)
    return np.maximum(out.max(axis=1), 0)


def log_softmax(x: np.ndarray) -> np.ndarray:
    x = x - x.max(axis=1, keepdims=True)
    return x - np.log(np.exp(x).sum(axis=1, keepdims=True))


def train(texts: list[bytes], labels: list[str], epochs: int = EPOCHS, seed: int = 5, batch: int = 64, settled: float = SETTLED) -> Network:
    """Adam on the cross entropy of single windows of at most WINDOW bytes. The gradient of a maximum goes to its place.

    Ends after an epoch whose mean cross entropy (of each batch before its step) is below ``settled``.
    """
    rng = np.random.default_rng(seed)
    names = sorted(set(labels))
    goal = np.array([names.index(x) for x in labels])
    data = np.full((len(texts), WINDOW), PAD, np.uint8)
    for k, t in enumerate(texts):
        data[k, : min(len(t), WINDOW)] = np.frombuffer(t[:WINDOW], np.uint8)
    params = {f"{w}{j}": rng.normal(0, 0.3, (256, FILTERS)).astype(np.float32) for w in WIDTHS for j in range(w)}
    params |= {f"b{w}": np.zeros(FILTERS, np.float32) for w in WIDTHS}
    params |= {"dense": rng.normal(0, 0.2, (len(WIDTHS) * FILTERS, len(names))).astype(np.float32), "last": np.zeros(len(names), np.float32)}
    m, v = ({k: np.zeros_like(p) for k, p in params.items()} for _ in range(2))
    weight = len(goal) / (len(names) * np.bincount(goal, minlength=len(names)))
    step = 0
    for _ in range(epochs):
        order, loss = rng.permutation(len(goal)), 0.0
        for lo in range(0, len(order), batch):
            own = order[lo : lo + batch]
            x, y, rows = data[own].astype(np.int32), goal[own], np.arange(len(own))[:, None]
            peaks, hidden = {}, []
            for w in WIDTHS:
                n = WINDOW - w + 1
                z = np.take(params[f"{w}0"], x[:, :n], axis=0)
                for j in range(1, w):
                    z += np.take(params[f"{w}{j}"], x[:, j : n + j], axis=0)
                z += params[f"b{w}"]
                peaks[w] = z.argmax(axis=1)
                hidden.append(np.take_along_axis(z, peaks[w][:, None], 1)[:, 0])
            h = np.concatenate(hidden, axis=1)
            act = np.maximum(h, 0)
            logs = log_softmax(act @ params["dense"] + params["last"])
            loss -= float(logs[np.arange(len(own)), y].sum())
            d = np.exp(logs)
            d[np.arange(len(own)), y] -= 1
            d *= (weight[y] / len(own))[:, None]
            grad = {"dense": act.T @ d, "last": d.sum(0)}
            dh = (d @ params["dense"].T) * (h > 0)
            for k, w in enumerate(WIDTHS):
                dw = dh[:, k * FILTERS : (k + 1) * FILTERS]
                grad[f"b{w}"] = dw.sum(0)
                for j in range(w):
                    at = x[rows, peaks[w] + j] * FILTERS + np.arange(FILTERS)[None]
                    grad[f"{w}{j}"] = np.bincount(at.ravel(), weights=dw.ravel(), minlength=256 * FILTERS).reshape(256, FILTERS).astype(np.float32)
            step += 1
            for k, g in grad.items():
                m[k] = 0.9 * m[k] + 0.1 * g
                v[k] = 0.999 * v[k] + 0.001 * g * g
                params[k] -= (0.01 * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.999**step)) + 1e-8)).astype(np.float32)
        if loss < settled * len(goal):
            break
    return Network(names, {w: [params[f"{w}{j}"] for j in range(w)] for w in WIDTHS}, {w: params[f"b{w}"] for w in WIDTHS}, params["dense"], params["last"])


def predict(net: Network, pairs: tuple, texts: list[bytes], at_once: int = 64) -> list[tuple[str, float]]:
    """(label, probability) of each whole text."""
    out: list[tuple[str, float]] = [("und", 0.0)] * len(texts)
    which = [k for k, t in enumerate(texts) if net.labels and LETTER.search(t.decode())]
    total = {k: np.zeros(len(net.labels)) for k in which}
    count = dict.fromkeys(which, 0)
    held, owners, rows = [], [], 0

    def flush() -> None:
        nonlocal held, owners, rows
        if held:
            logs = log_softmax(features(pairs, np.concatenate(held)) @ net.dense + net.last)
            at = 0
            for k, n in owners:
                total[k] += logs[at : at + n].sum(0)
                count[k] += n
                at += n
        held, owners, rows = [], [], 0

    for k in which:
        own = windows(texts[k])
        for lo in range(0, len(own), at_once):
            part = own[lo : lo + at_once]
            held.append(part)
            owners.append((k, len(part)))
            rows += len(part)
            if rows >= at_once:
                flush()
    flush()
    for k in which:
        mean = total[k] / count[k]
        p = np.exp(mean - mean.max())
        p /= p.sum()
        best = int(p.argmax())
        out[k] = (net.labels[best], float(min(1.0, p[best])))
    return out


def _predict(batches: Iterator[pa.RecordBatch], net: Network) -> Iterator[pa.RecordBatch]:
    pairs = net.pairs() if net.labels else ()
    for b in slices(batches):
        found = predict(net, pairs, utf8(b))
        keep = [i for i, n in enumerate(b.schema.names) if n != "text"]
        yield pa.RecordBatch.from_arrays(
            [*[b.column(i) for i in keep], pa.array([x[0] for x in found], pa.string()), pa.array([x[1] for x in found], pa.float64())],
            names=[*[b.schema.names[i] for i in keep], "lang_pred", "score"],
        )


def held_out(id_col: str = "doc_id"):
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit(""))) % 3 == 1


def learn(df: DataFrame, most: int = MOST_DOCUMENTS, each: int = WINDOWS_EACH, id_col: str = "doc_id", text_col: str = "text", label: str = "lang") -> Network:
    """Fits the network on a bounded sample: windows at hashed places of the documents with the least hashed ids."""
    known = df.where(F.col(label).isNotNull() & ~held_out(id_col))
    rows = known.where(F.col(text_col).isNotNull())
    mark = F.xxhash64(F.col(id_col).cast("string"), F.lit(1))
    # Only the windows' characters travel: a place is a hash modulo the text's length.
    places = [F.pmod(F.xxhash64(F.col(id_col).cast("string"), F.lit(10 + k)), F.greatest(F.length(text_col) - WINDOW // 2, F.lit(1))) + 1 for k in range(each)]
    cut = F.array(*[F.substring(F.col(text_col), p.cast("int"), F.lit(WINDOW)) for p in places])
    # Hashes are uniform, so a share of their range holds that share of the rows: hardly more than ``most`` are ever cut, sorted
    # and sent, whatever the number of tasks.
    share = 1.2 * most / max(1, known.count())
    few = rows.where(F.pmod(mark, F.lit(1 << 30)) < F.lit(int(share * (1 << 30))))
    found = few.select(mark.alias("m"), F.col(label).alias("label"), cut.alias("cut")).orderBy("m", "label", "cut").limit(most).collect()
    texts, labels = [], []
    for r in found:
        for t in dict.fromkeys(r["cut"]):
            if LETTER.search(t):
                texts.append(t.encode())
                labels.append(r["label"])
    return train(texts, labels) if texts else Network([], {}, {}, np.zeros((0, 0)), np.zeros(0))


def identify(df: DataFrame, net: Network, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, lang_pred, score for each row."""
    docs = id_and_text(df, id_col=id_col, text_col=text_col)
    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.mapInArrow(partial(_predict, net=net), f"doc_id {kind}, lang_pred string, score double")


def _keep(batches: Iterator[pa.RecordBatch], net: Network, text_col: str, least: float) -> Iterator[pa.RecordBatch]:
    """Rows (in a struct, so that their names can't clash) whose language is told. The text is a view of the struct's field."""
    pairs = net.pairs() if net.labels else ()
    for batch in batches:
        rows = batch.column(0)
        for b in slices(iter([pa.RecordBatch.from_arrays([rows, rows.field(text_col)], names=["row", "text"])])):
            good = [x != "und" and p >= least for x, p in predict(net, pairs, utf8(b))]
            yield pa.RecordBatch.from_arrays([b.column("row").filter(pa.array(good, pa.bool_()))], names=["row"])


def keep_identified(df: DataFrame, net: Network, least: float = 0.4, text_col: str = "text") -> DataFrame:
    """``df`` without the rows whose language can't be told: ``und``, or a score under ``least``; columns unchanged."""
    rows = df.select(F.struct(*[f"`{c}`" for c in df.columns]).alias("row"))
    ddl = f"row {rows.schema['row'].dataType.simpleString()}"
    return rows.mapInArrow(partial(_keep, net=net, text_col=text_col, least=least), ddl).select("row.*")
