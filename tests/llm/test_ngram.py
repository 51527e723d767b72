"""The model's counts are the same however they are merged, and never wrap."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from inkstrata.llm import ngram
from inkstrata.llm.common import id_and_text

from . import edges
from .test_ops import brute_scores


@pytest.mark.parametrize("fan,split,shard_bytes", [(64, 8, 1 << 25), (2, 1, 3_000), (3, 2, 50_000)])
@pytest.mark.parametrize("which", ["docs", "edge"])
def test_levels_of_merging(spark, which, fan, split, shard_bytes, monkeypatch):
    monkeypatch.setattr(ngram, "FAN", fan)
    monkeypatch.setattr(ngram, "SPLIT", split)
    df = edges.table(spark) if which == "edge" else spark.read.parquet("/root/testdata/sf0.001/documents.parquet").repartition(13)
    docs = id_and_text(df)
    model = ngram.fit(docs.where(~ngram.held_out()), shard_bytes)
    key = lambda r: (r[0] is None, r[0] or 0, *r[1:])
    got = sorted(((r["doc_id"], r["n_tokens"], r["n_known"], r["base_score"], r["score"]) for r in ngram.score(docs, model).collect()), key=key)
    want = sorted(((d, n, k, b, s) for d, _, n, k, _, b, s in brute_scores([(r["doc_id"], r["text"]) for r in df.collect()])), key=key)
    assert [g[:3] for g in got] == [w[:3] for w in want]
    assert np.allclose([g[3:] for g in got], [w[3:] for w in want], rtol=1e-9)
    assert fan == 64 or model.bits > split


def test_counts_do_not_wrap(tmp_path):
    big, keys = np.array([3_000_000_000, 2**40, 7], np.uint64), np.array([1, 5, 9], np.uint64)
    table = pa.table({"block": pa.array([ngram.pack(keys, big), ngram.pack(keys[:1], big[:1])], pa.binary())})
    found, counts = ngram._merged(table, 1)
    assert found.tolist() == [1, 5, 9] and counts.tolist() == [6_000_000_000, 2**40, 7]
    for own in (counts, counts[2:], np.array([70_000], np.uint64), np.zeros(0, np.uint64)):
        ngram.save(str(tmp_path), f"c{len(own)}-{int(own.sum())}", ngram.narrow(own))
        assert ngram.load_counts(str(tmp_path), f"c{len(own)}-{int(own.sum())}", len(own)).tolist() == own.tolist()


def test_pairs_that_are_frequent_beyond_32_bits(spark):
    docs = id_and_text(spark.createDataFrame([(1, "a b a b c"), (2, "b a")], "doc_id long, text string"))
    model = ngram.fit(docs)
    hashes, words, _ = ngram.tokens([b"a b"])
    ids = ngram.word_ids(model, hashes).astype(np.uint64)
    pair = np.array([ids[words[0]] << np.uint64(32) | ids[words[1]]])
    shard = int(model.pair_shard(pair)[0])
    keys = np.array(ngram.load(model.root, f"pair-{shard}.key", np.uint64))
    counts = ngram.load_counts(model.root, f"pair-{shard}.count", len(keys)).astype(np.uint64)
    counts[keys == pair[0]] = 2**33 + 5
    ngram.save(model.root, f"pair-{shard}.count", ngram.narrow(counts))
    ngram._OPEN.clear()
    assert ngram.pair_counts(model, pair).tolist() == [2**33 + 5]


def test_a_store_that_is_not_mounted_is_held_in_memory(tmp_path, monkeypatch):
    for k in range(5):
        ngram.save(str(tmp_path), f"x{k}", np.full(1_000, k, np.uint64))
    monkeypatch.setattr(ngram, "_local", lambda root: None)
    monkeypatch.setattr(ngram, "HELD_BYTES", 20_000)
    ngram._OPEN.clear()
    for k in (0, 1, 2, 3, 4, 0, 3):
        assert ngram.load(f"file://{tmp_path}", f"x{k}", np.uint64).tolist() == [k] * 1_000
        assert sum(x.nbytes for x in ngram._OPEN.values()) <= 20_000
    ngram._OPEN.clear()


def test_empty_table(spark):
    model = ngram.fit(id_and_text(edges.empty(spark)))
    assert model.train_tokens == 0 and ngram.score(id_and_text(edges.table(spark)), model).agg(F.sum("score")).first()[0] == 0
