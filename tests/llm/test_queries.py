"""The registered queries and the pipeline."""

from __future__ import annotations

from collections import defaultdict

import pytest

from inkstrata.llm import queries

from ..compare import database, same
from .test_jaccard import brute_keep

SF = "/root/testdata/sf0.001"

COLUMNS = {
    "op1": {"doc_id": "bigint", "held_out": "boolean", "n_tokens": "bigint", "n_known": "bigint", "train_tokens": "bigint", "base_score": "double", "score": "double"},
    "op2": {"doc_id": "bigint", "piece": "int", "start": "bigint", "length": "bigint", "ids_crc32": "bigint", "sequence_id": "bigint", "offset": "bigint"},
    "op3": {"doc_id": "bigint", "size": "bigint", "text_crc32": "bigint", "law": "string", "shard": "int", "slot": "bigint", "grown_shard": "int"},
    "op4": {"doc_id": "bigint", "n_words": "bigint", "word_chars": "bigint", "n_symbols": "bigint", "n_dup_lines": "bigint", "n_repeat_words": "bigint", "base_failed": "boolean", "kept": "boolean"},
    "op5": {"doc_id": "bigint", "fingerprint": "string", "component_id": "bigint"},
    "op6": {"doc_id": "bigint", "held_out": "boolean", "lang_pred": "string", "score": "double"},
    "op7": {"doc_id": "bigint", "n_email": "bigint", "n_ip": "bigint", "n_card": "bigint", "n_phone": "bigint", "base_sha256": "string", "spans": "string"},
    "op8": {"doc_id": "bigint", "n_assign": "bigint", "n_access": "bigint", "n_hex": "bigint", "base_sha256": "string", "spans": "string"},
    "op9": {"doc_id": "bigint", "keep_id": "bigint", "group_size": "bigint", "kept": "boolean", "text_sha256": "string"},
    "op10": {"doc_id": "bigint", "source": "string", "position": "bigint"},
}


@pytest.mark.parametrize("name", [n for n in queries.queries() if n.startswith("op")])
def test_columns_and_rows(spark, name):
    df = queries.queries()[name](spark, SF)
    assert COLUMNS[name.split("_")[0]].items() <= dict(df.dtypes).items()
    assert df.select("doc_id").distinct().count() == 200


@pytest.mark.parametrize("name", queries.oracle_sql())
def test_same_as_sql(spark, name):
    same(queries.queries()[name](spark, SF), database(SF), queries.oracle_sql()[name])


def test_pipeline(spark):
    import corpus_pipeline as p
    from inkstrata.llm.common import stash

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    seen = {}
    for name, stage in p.STAGES:
        seen[name] = docs
        docs = stash(stage(spark, docs, SF), name)
    rows = lambda n: [(r["doc_id"], r["text"]) for r in seen[n].collect()]
    letters = [x for x in rows("language_id") if any(c.isalpha() for c in x[1] or "")]
    assert set(rows("exact_dedup")) <= set(letters) and len(rows("exact_dedup")) >= 0.99 * len(letters)
    last = defaultdict(int)
    for d, t in rows("exact_dedup"):
        last[t] = max(last[t], d)
    assert sorted(rows("simhash_near_dedup")) == sorted((d, t) for t, d in last.items())
    heads = set(brute_keep(rows("simhash_near_dedup")))
    assert sorted(d for d, _ in rows("pfair_mix")) == sorted(heads)
    mixed = rows("genetic_packing")
    assert {d for d, _ in mixed} == heads and len(mixed) >= len(heads)
    pieces = defaultdict(int)
    for r in docs.collect():
        pieces[r["doc_id"]] += r["piece"] == 0
    counts = defaultdict(int)
    for d, _ in mixed:
        counts[d] += 1
    assert pieces == counts
    assert queries.queries()["pipeline"](spark, SF).count() == docs.count()
