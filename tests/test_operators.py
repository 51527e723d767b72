"""Order-dependent operators against the rules run one row after the other; edges; sources, sinks, settings, streams."""

from __future__ import annotations

import json
import random
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from inkstrata.config import Chunking, EvalSet, Filtering, Pairing, Selection, Settings, load_settings
from inkstrata.functions import text as T
from inkstrata.operators import chunking, dedup, evaluation, filtering, pairs, retrieval, selection, similarity
from inkstrata.plans import corpus as corpus_plan
from inkstrata.plans import dataset, rag
from inkstrata.sources import catalog, readers, writers

ROWS = "ord long, pair_id string, source_id string, task string, instruction string, output string"


def made(rng: random.Random, n: int, words: int = 6) -> list[tuple]:
    base = [" ".join(rng.choice("alpha beta gamma delta epsilon zeta eta theta".split()) for _ in range(words)) for _ in range(max(2, n // 4))]
    out = []
    for k in range(n):
        text = rng.choice(base)
        if rng.random() < 0.4:
            text += " " + rng.choice("alpha beta iota".split())
        out.append((k, f"p{rng.randrange(10**6):06d}", rng.choice(["s1", "s2", "", None]), rng.choice(["qa", "summary"]), "same question", text))
    return out


@pytest.mark.parametrize("seed", range(4))
def test_group_caps(spark, seed):
    rng = random.Random(seed)
    rows = made(rng, 120)
    c = Selection(max_per_source=rng.randrange(5, 40), max_per_task=rng.randrange(5, 60), max_per_source_task=rng.randrange(3, 30))
    src, task, joint, want = Counter(), Counter(), Counter(), set()
    for r in rows:
        s, t = r[2] or "unknown", r[3] or "unknown"
        if src[s] < c.max_per_source and task[t] < c.max_per_task and joint[s, t] < c.max_per_source_task:
            want.add(r[0])
            src[s] += 1
            task[t] += 1
            joint[s, t] += 1
    shuffled = rows[:]
    rng.shuffle(shuffled)
    assert {r["ord"] for r in selection.group_caps(spark.createDataFrame(shuffled, ROWS), c).collect()} == want


def plain_tokens(s: str) -> set[str]:
    return set(s.lower().split())


@pytest.mark.parametrize("seed,limit", [(0, 64), (1, 64), (2, 2), (3, 1)])
def test_drop_duplicates(spark, seed, limit, monkeypatch):
    monkeypatch.setattr(dedup, "DIRECT", (1, 32, 3, 32)[seed])
    rng = random.Random(seed)
    rows = made(rng, 90, 9)
    df = spark.createDataFrame(rows, ROWS).repartition(5)
    keyed = sorted(dedup.keyed(df).collect(), key=lambda r: r["ord"])
    want = dict(dedup.sequential([(r["ord"], r["fp"], r["block"], r["tokens"]) for r in keyed], 0.7, limit))
    got = {r["ord"]: r["stage"] for r in dedup.drop_duplicates(df, Filtering(near_dup=0.7, compare_limit=limit)).collect()}
    assert got == want
    assert len(set(want.values())) == 3


@pytest.mark.parametrize("seed", range(3))
def test_diversity(spark, seed):
    rng = random.Random(seed)
    rows = made(rng, 60)
    c = Selection(target_min=0, target_max=rng.choice([5, 1000]), diversity=0.72)
    kept, sets, seen = [], [], set()
    for r in sorted(rows, key=lambda r: (r[2] or "", r[3], r[1])):
        own, bucket = plain_tokens(f"{r[3]} {r[4]} {r[5]}"), (r[2] or "unknown", r[3])
        if len(kept) >= c.target_max:
            continue
        if bucket not in seen or not any(len(own & x) / len(own | x) >= 0.72 for x in sets):
            kept.append(r[1])
            sets.append(own)
            seen.add(bucket)
    got = [r["pair_id"] for r in selection.diversity(spark.createDataFrame(rows, ROWS), c).collect()]
    assert sorted(got) == sorted(kept)


def test_jaccard_pairs(spark):
    rng = random.Random(3)
    sets = [[rng.choice("abcdefgh") for _ in range(rng.randrange(0, 8))] for _ in range(60)]
    rows = [(k, sorted(set(s)), str(k % 2)) for k, s in enumerate(sets)]
    df = spark.createDataFrame(rows, "id long, tokens array<string>, block string")
    for t in (0.5, 0.72, 1.0):
        want = {(a, b) for a, x, p in rows for b, y, q in rows if a < b and p == q and ((len(set(x) & set(y)) / len(set(x) | set(y))) if x or y else 1.0) >= t}
        assert {(r["a"], r["b"]) for r in similarity.jaccard_pairs(df, t, "id", "block").collect()} == want


def packed(hits: list[tuple], most: int) -> str:
    parts, used = [], 0
    for cid, src, text in hits:
        text = text.strip()
        if not text:
            continue
        block = f"[{cid} | {src}]\n{text}"
        if used and used + 2 + len(block) > most:
            if most - used - 2 > 40:
                parts.append(block[: most - used - 2] + "…")
            break
        parts.append(block)
        used += len(block) + 2
        if used >= most:
            break
    return "\n\n".join(parts)


def test_pack_context(spark):
    rng = random.Random(5)
    cases = {q: [(f"c{i}", "s", rng.choice(["", " \t", "x" * rng.randrange(1, 90), "ä" * 30])) for i in range(rng.randrange(0, 6))] for q in range(150)}
    rows = [(q, k + 1, c, s, t) for q, hits in cases.items() for k, (c, s, t) in enumerate(hits)]
    got = {r["query_id"]: r["packed"] for r in evaluation.pack_context(spark.createDataFrame(rows, "query_id long, rank int, chunk_id string, source_id string, text string"), 150).collect()}
    for q, hits in cases.items():
        assert got.get(q, "") == packed(hits, 150)


def windows(n: int, w: int, s: int) -> list[int]:
    out, i = [], 0
    while i < n:
        out.append(i)
        if i + w >= n:
            break
        i += s
    return out


def test_windows(spark):
    for n in range(0, 12):
        for w, s in ((4, 2), (1, 1), (3, 5), (2, 3)):
            got = spark.range(1).select(chunking.starts(F.lit(n), Chunking(window=w, stride=s)).alias("s")).first()["s"]
            assert [i for i in got if i < n] == windows(n, w, s)


def test_long_window_is_cut_at_a_space(spark):
    text = "A" * 30 + " " + "word " * 500 + "end."
    got = spark.createDataFrame([(1, "s", text)], "pos long, source_id string, text string")
    (r,) = chunking.chunk(got).collect()
    assert r["text"] == " ".join(text.split())[:1800].rsplit(" ", 1)[0]
    (r,) = chunking.chunk(spark.createDataFrame([(1, "s", "B" * 3000)], "pos long, source_id string, text string")).collect()
    assert r["text"] == "B" * 1800


@pytest.mark.parametrize("text,want", [
    ('He said. "Yes" it is! No? 1 more. go on.\tNow', ['He said.', '"Yes" it is!', "No? 1 more. go on.", "Now"]), ("", []), ("  \n ", []), ("A. B", ["A.", "B"]), ("a. 'B", ["a.", "'B"]),
])
def test_sentences(spark, text, want):
    assert spark.createDataFrame([(text,)], "t string").select(T.sentences(F.col("t")).alias("s")).first()["s"] == want


def test_sections_by_metadata(spark):
    rows = [("x", "Prepared Remarks", "prepared_remarks"), ("x", " QA ", "qa"), ("x", "q_and_a", "qa"), ("analyst: x", None, "qa"), ("Operator speaks\nx", "", "prepared_remarks"), ("x", "other", "unknown"), (None, None, "unknown")]
    got = spark.createDataFrame([(a, b) for a, b, _ in rows], "t string, m string").select(T.detect_section(F.col("t"), F.col("m")).alias("s")).collect()
    assert [r["s"] for r in got] == [c for *_, c in rows]


@pytest.mark.parametrize("sentence,score", [
    ("too short", 0.0), ("Thank you for the 12 percent of revenue", 0.0), ("CEO: Revenue was 12 percent higher than before.", 1.0), ("We carry on with the plan for now and later on.", 0.85), ("x" * 281, 0.15),
    ("x" * 401, -0.05), ("The plan is one that we all like a lot today", 0.3),
])
def test_proposition_score(spark, sentence, score):
    got = spark.createDataFrame([(sentence,)], "t string").select(T.proposition_score(F.col("t")).alias("s")).first()["s"]
    assert round(got, 9) == round(score, 9)


def test_overlap_and_jaccard_of_nothing(spark):
    none, one = F.array().cast("array<string>"), F.array(F.lit("a"))
    r = spark.range(1).select(T.jaccard(none, none).alias("a"), T.jaccard(none, one).alias("b"), T.overlap(none, none)["f1"].alias("c"), T.overlap(none, one)["precision"].alias("d")).first()
    assert (r["a"], r["b"], r["c"], r["d"]) == (1.0, 0.0, 0.0, 0.0)


def test_query_scores(spark):
    queries = spark.createDataFrame([(1,), (2,), (3,)], "query_id long")
    gold = spark.createDataFrame([(1, 10), (1, 11), (1, 10), (2, 99)], "query_id long, doc_id long")
    hits = spark.createDataFrame([(1, 10, 2), (1, 11, 4), (2, 1, 1), (3, 1, 1)], "query_id long, doc_id long, rank int")
    got = {(r["query_id"], r["k"]): (r["recall"], r["ndcg"]) for r in evaluation.query_scores(gold, hits, queries, (0, 1, 3, 10)).collect()}
    from math import log2

    assert got[1, 0] == got[1, 1] == got[2, 10] == got[3, 10] == (0.0, 0.0)
    ideal = 1 + 1 / log2(3)
    assert got[1, 3] == (0.5, round(1 / log2(3) / ideal, 6)) and got[1, 10] == (1.0, round((1 / log2(3) + 1 / log2(5)) / ideal, 6))


def test_bm25_padding_and_ties(spark):
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(["apple pie", "apple pie", "pear", "", None, "plum"])], "doc_id long, text string")
    queries = spark.createDataFrame([(1, "apple apple"), (2, "nothing here"), (3, "")], "query_id long, query string")
    got = defaultdict(list)
    for r in retrieval.bm25(retrieval.build_index(docs), queries, 4).orderBy("query_id", "rank").collect():
        got[r["query_id"]].append((r["doc_id"], r["score"] > 0))
    assert got[1] == [(0, True), (1, True), (2, False), (3, False)] and got[2] == got[3] == [(i, False) for i in range(4)]


def test_contained(spark):
    docs = spark.createDataFrame([(1, "xx one two three four five six seven yy"), (2, "one two three four five six sevenfold"), (3, "one two three four five six"), (4, "short")], "doc_id long, text string")
    passages = spark.createDataFrame([(1, "one two three four five six seven"), (2, "short"), (3, "absent one two three four five six")], "query_id long, query string")
    assert {(r["query_id"], r["doc_id"]) for r in rag.contained(docs, passages).collect()} == {(1, 1), (1, 2), (2, 4)}
    more = ["one", "e", "ne t", "two three", "ne two thr", "two  three", "three four five", "x one two three fo", "six sevenf", "a", "", "seven yy", "one two three four five six seven", "four five six se"]
    passages = spark.createDataFrame(list(enumerate(more)), "query_id long, query string")
    want = {(i, r["doc_id"]) for r in docs.collect() for i, q in enumerate(more) if q and q in r["text"]}
    assert {(r["query_id"], r["doc_id"]) for r in rag.contained(docs, passages).collect()} == want
    assert rag.contained(docs, passages.where("false")).count() == 0


def test_dense_blocks(spark, monkeypatch):
    vectors = spark.createDataFrame([(i, [float(i % 3), 1.0]) for i in range(20)], "doc_id long, embedding array<double>")
    asked = vectors.where("doc_id < 7").withColumnRenamed("doc_id", "query_id")
    want = sorted(map(tuple, retrieval.dense(vectors, asked, 3).collect()))
    monkeypatch.setattr(retrieval, "QUERY_BLOCK", 2)
    assert sorted(map(tuple, retrieval.dense(vectors, asked, 3).collect())) == want and len(want) == 21
    assert retrieval.dense(vectors, asked.where("false"), 3).count() == 0


def test_split_is_even(spark):
    got = {r["s"]: r["n"] for r in spark.range(4000).select(selection.split(F.col("id").cast("string")).alias("s")).groupBy("s").agg(F.count("*").alias("n")).collect()}
    assert 3000 < got["train"] < 3400 and 300 < got["val"] < 500


def test_pairs_of_chunks(spark):
    chunks = spark.createDataFrame([(1, 0, "c", "s", "x_y", "Some text.", 3, 3, [])], f"pos long, block int, chunk_id string, source_id string, section string, text string, start_sentence int, end_sentence int, propositions {readers.PROPOSITIONS}")
    rows = pairs.generate(chunks).orderBy("k").collect()
    assert [r["task"] for r in rows] == ["qa", "qa", "summary"] and rows[0]["instruction"] == "What did management report in this x y excerpt?"
    assert rows[0]["citations"] == ["[c] Some text."] and "- Some text.\n\nCitations: c#s3." in rows[0]["output"]
    assert pairs.generate(chunks, Pairing(max_qa=0, summary=False)).count() == 0 and pairs.generate(chunks, Pairing(max_qa=4)).count() == 5
    again = pairs.generate(chunks, rewrite=lambda p: F.when(p.contains("TASK: qa"), F.lit("  new ")).otherwise(F.lit(" "))).orderBy("k").collect()
    assert again[0]["output"] == "new" and again[2]["output"] == rows[2]["output"] and again[0]["generator"] == "llm"


def test_judge_by_a_model(spark):
    rows = spark.createDataFrame([("a", "c", "out", ["[c] x"])], "pair_id string, chunk_id string, output string, citations array<string>")
    (r,) = filtering.judge(rows, model=lambda: F.struct(F.lit(0.7).alias("score"), F.lit("").alias("reason"))).collect()
    assert r["kept"] and r["judge_reason"] == "llm_judge"


def test_eval_sample(spark):
    rows = [(f"q{i}", f"p{i}", f"s{i % 3}" if i % 7 else "rare", "qa") for i in range(60)] + [("q1", "p99", "s1", "qa")]
    df = spark.createDataFrame(rows, "query_id string, pair_id string, source_id string, task string")
    got = evaluation.round_robin(df, EvalSet(size=20)).collect()
    counts = Counter(r["source_id"] for r in got)
    assert len(got) == len({r["query_id"] for r in got}) == 20 and set(counts.values()) == {5}


def test_candidates_and_missing_gold(spark):
    made_rows = [(1, "p1", "c1", "Q?", "out", "qa", "s"), (2, "p2", "c1", " Q? ", "out", "qa", "s"), (3, "p3", "c2", "Q?", "", None, ""), (4, "p4", "zz", "Q?", "o", "qa", "s"), (5, "p5", "c1", " ", "o", "qa", "s"), (6, "p6", "c1", "R?", "o", "qa", "s")]
    df = spark.createDataFrame(made_rows, "ord long, pair_id string, chunk_id string, instruction string, output string, task string, source_id string")
    ids = spark.createDataFrame([("c1",), ("c2",)], "chunk_id string")
    got = evaluation.candidates(df, ids, spark.createDataFrame([("p6",)], "pair_id string"))
    assert sorted((r["pair_id"], r["gold_answer"], r["task"], r["source_id"]) for r in got.collect()) == [("p1", "out", "qa", "s"), ("p3", None, "qa", "unknown")]
    assert evaluation.missing_gold(got, ids).count() == 0 and evaluation.missing_gold(got, ids.where("chunk_id = 'c1'")).count() == 1


def test_shuffled_sample(spark):
    rows = [(i, f"q{i % 50}", f"s{i % 3}", "qa") for i in range(60)]
    df = spark.createDataFrame(rows, "ord long, query_id string, source_id string, task string").repartition(4)
    got = evaluation.shuffled_sample(df, EvalSet(size=20))
    assert got == sorted(set(got)) and len(got) == 20 == len(evaluation.shuffled_sample(df.repartition(2), EvalSet(size=20))) and got == evaluation.shuffled_sample(df, EvalSet(size=20))
    assert len(evaluation.shuffled_sample(df, EvalSet(size=500))) == 50 and evaluation.shuffled_sample(df.where("false")) == []
    with pytest.raises(ValueError, match="round_robin"):
        evaluation.shuffled_sample(df, most=10)


def test_corpus_flow(spark, tmp_path):
    found, told = corpus_plan.build(spark)
    assert told["n_chunks"] == found.count() == 4 and told["n_documents"] == 3 and told["input_path"] is None
    meta = {r["section"]: r["metadata"] for r in found.collect()}
    assert meta["prepared_remarks"]["ticker"] == "AAPL" and meta["prepared_remarks"]["section"] == "prepared_remarks" and "n_propositions" in meta["qa"]
    rows = chunking.chunk(catalog.load_all(spark)).drop("pos", "block")
    writers.json_lines(rows.unionByName(rows.withColumn("chunk_id", F.lit(""))), str(tmp_path / "chunks"))
    again, told = corpus_plan.build(spark, str(tmp_path / "chunks"))
    assert again.count() == 5 and told["input_path"]  # the four, and those without an id, which count as one unknown chunk
    assert corpus_plan.build(spark, str(tmp_path / "none"))[1]["n_chunks"] == 4


def test_manifest_and_themes(spark):
    rows = spark.createDataFrame([("a", ["c1", "c2"]), ("b", ["c1"])], "query_id string, gold_chunk_ids array<string>")
    assert tuple(evaluation.eval_manifest(rows).first()) == (2, 2)
    assert [r["theme"] for r in evaluation.themes(spark.createDataFrame([("b",), ("a",), ("b",)], "theme string")).collect()] == ["a", "b"]


def test_catalog(spark):
    assert catalog.catalog(spark).count() == 3 and catalog.load_all(spark).count() == 4 and len(catalog.license_notes()) == 4
    with pytest.raises(KeyError, match="fiqa"):
        catalog.source("none")
    with pytest.raises(ValueError):
        catalog.load(spark, "fiqa", 0)

    def fails(*_):
        raise OSError("HTTP 429: too many requests")

    def breaks(*_):
        raise OSError("gone")

    assert catalog.load(spark, "fiqa", reader=fails).count() == 1 and catalog.load(spark, "fiqa", reader=breaks, auto=True).count() == 1
    with pytest.raises(OSError):
        catalog.load(spark, "fiqa", reader=breaks)
    wide = lambda s, _: s.createDataFrame([(2, "q2", " a2 ", [1]), (1, "", "a" * 13_000, [2]), (3, " ", None, [3])], "pos long, question string, answer string, more array<int>")
    rows = catalog.load(spark, "fiqa", 5, reader=wide).orderBy("pos").collect()
    assert [len(r["text"]) for r in rows] == [12_000, 6] and rows[1]["text"] == "q2\n\na2" and dict(rows[1]["metadata"]) == {"pos": "2"}


def test_json_lines(spark, tmp_path):
    p = tmp_path / "pairs.jsonl"
    p.write_text('{"pair_id": "", "task": null, "output": "ö", "citations": null}\n\n{"pair_id": "x", "n": 1, "metadata": {"a": 1}}\n')
    rows = readers.read(spark, str(p), "pair").orderBy("pair_id").collect()
    assert [(r["pair_id"], r["task"], r["output"], r["citations"], r["metadata"]) for r in rows] == [("unknown", "qa", "ö", [], {}), ("x", "qa", "", [], {"a": "1"})]
    bad = tmp_path / "corpus.jsonl"
    bad.write_text('{"text": "no id"}\n')
    with pytest.raises(Exception, match="chunk_id is missing"):
        readers.read(spark, str(bad), "corpus").collect()
    writers.json_lines(readers.read(spark, str(p), "pair"), str(tmp_path / "out"))
    assert readers.read(spark, str(tmp_path / "out"), "pair").count() == 2
    assert readers.train_ids(spark, None).count() == readers.train_ids(spark, str(tmp_path)).count() == 0


def test_dataset_flow(spark, tmp_path):
    records = catalog.load_all(spark)
    c = Settings.of({"filtering": {"use_judge": True}})
    chosen, decisions, told = dataset.build(records, c)
    assert told["n_selected"] == chosen.count() > 0 and told["n_in"] == 12 and sum(told["by_split"].values()) == told["n_selected"]
    report = writers.filter_report(decisions, str(tmp_path / "filter"))
    assert report["n_in"] >= 12 and not report["decisions_truncated"] and writers.read_report(spark, str(tmp_path / "filter")) == report
    paths = writers.splits(chosen, str(tmp_path / "data"), told)
    manifest = writers.read_report(spark, paths["manifest"])
    assert manifest["report"]["n_selected"] == told["n_selected"] and manifest["files"]["val"] == "val.jsonl"
    assert readers.train_ids(spark, str(tmp_path / "data")).count() == told["n_train"]
    assert {r["split"] for r in dataset.training_plan(chosen, "system").collect()} <= {"train", "val", "test"}


def test_index_and_embeddings_are_kept(spark, tmp_path):
    docs = spark.createDataFrame([(1, "apple pie"), (2, "pear")], "doc_id long, text string")
    writers.index(retrieval.build_index(docs), str(tmp_path / "bm25"))
    queries = spark.createDataFrame([(1, "pear")], "query_id long, query string")
    assert retrieval.bm25(writers.read_index(spark, str(tmp_path / "bm25")), queries, 1).first()["doc_id"] == 2
    writers.embeddings(retrieval.hash_embeddings(docs), str(tmp_path / "dense"))
    assert len(writers.read_embeddings(spark, str(tmp_path / "dense")).first()["embedding"]) == 128
    assert writers.read_embeddings(spark, str(tmp_path / "none")) is None and retrieval.hybrid(None, None) is None
    built = []
    for _ in range(2):
        assert writers.load_or_build(spark, str(tmp_path / "t"), lambda: built.append(1) or docs).count() == 2
    assert built == [1]


def test_panel(spark):
    panel = spark.createDataFrame([("p", "T", "th", "Q?", "Margin 5%", ["dry-run"], True)], "id string, ticker string, theme string, prompt string, context string, must_cite array<string>, refuse_if_missing boolean")
    (r,) = evaluation.compare_panel(panel, adapter=lambda p: F.concat(F.lit("refuse: "), p)).collect()
    assert r["base_citation_hits"] == ["dry-run"] and r["adapter_output"].startswith("refuse: Ticker: T\nTheme: th") and r["notes"].startswith("expect refusal")


@pytest.mark.parametrize("kind,bad", [(Chunking, {"window": 0}), (Filtering, {"near_dup": 1.1}), (Selection, {"train": 0.5}), (Selection, {"max_per_task": 0}), (Selection, {"target_min": 9, "target_max": 8}), (Pairing, {"max_qa": -1})])
def test_settings_are_checked(kind, bad):
    with pytest.raises(ValueError):
        kind(**bad)


def test_settings_file(tmp_path):
    p = tmp_path / "s.json"
    p.write_text(json.dumps({"chunking": {"window": 6, "other": 1}, "retrieval": {"k_values": [1, 2]}, "more": 3}))
    s = load_settings(p)
    assert s.chunking.window == 6 and s.retrieval.k_values == (1, 2) and s.extras == {"more": 3, "chunking": {"other": 1}}


def test_stream_grows_the_corpus(spark, tmp_path):
    from inkstrata import streaming

    src = tmp_path / "in"
    docs = spark.createDataFrame([(1, "s", "Revenue grew 12 percent in the quarter. It will grow again in the next year. ")], "doc_id long, source string, text string")
    docs.write.parquet(str(src))
    for add in (False, True):
        if add:
            docs.withColumn("doc_id", F.lit(2)).unionByName(docs.withColumn("text", F.concat("text", F.lit("Margins were 5% after all of that.")))).withColumn("doc_id", F.col("doc_id").cast("long")).write.mode("append").parquet(str(src))
        stream = spark.readStream.schema(docs.schema).parquet(str(src))
        streaming.grow_corpus(stream, str(tmp_path / "corpus"), str(tmp_path / "state")).awaitTermination()
        rows = spark.read.parquet(str(tmp_path / "corpus"))
        assert rows.count() == rows.select("chunk_id").distinct().count() == (2 if add else 1)


def test_panel_flow(spark, tmp_path):
    from inkstrata.plans import panel

    items = [
        {"id": "p1", "task": "qa", "ticker": "A", "theme": "margin", "prompt": "What is the margin?", "context": "Margin was 18.4%.", "must_cite": ["18.4%"]},
        {"id": "p2", "theme": "cash", "prompt": "What of cash?", "context": "Cash was 5.", "refuse_if_missing": True},
    ]
    (tmp_path / "panel.jsonl").write_text("\n\n".join(map(json.dumps, items)) + "\n")
    src, out, told = (str(tmp_path / n) for n in ("panel.jsonl", "comparison", "metrics"))
    assert panel.compare(spark, src, out) == {"n_items": 2, "out_path": out, "dry_run": True, "themes": ["cash", "margin"]}
    dry = writers.read_report(spark, out)
    assert dry["dry_run"] and dry["meta"] == {} and [r["notes"] for r in dry["rows"]] == ["expect grounded citations", "expect refusal / insufficient-context"]
    panel.compare(spark, src, out, base=lambda p: F.lit("I don't know."), adapter=lambda p: F.when(p.contains("margin"), "The margin was 18.4%.").otherwise("It is not stated."), meta={"run": 1})
    stored = writers.read_report(spark, out)
    assert not stored["dry_run"] and stored["meta"] == {"run": 1} and stored["rows"][0]["adapter_citation_hits"] == ["18.4%"]
    assert [tuple(r) for r in panel.read_comparison(spark, out).orderBy("id").select("id", "task", "must_cite", "base_citation_hits").collect()] == [("p1", "qa", ["18.4%"], []), ("p2", "qa", [], [])]
    got = panel.score(spark, out, told)
    assert got["n_items"] == 2 and got["aggregate"]["adapter"]["citation_hit_rate"] == 1.0 and got["aggregate"]["adapter"]["refusal_accuracy"] == 1.0
    report = writers.read_report(spark, told)
    assert (report["n_citation_items"], report["n_refusal_items"]) == (1, 1) and report["items"][1]["base"]["refusal_correct"] is False
    assert report["aggregate"]["base"]["refusal_accuracy"] == 0.0


def test_prompts_by_label(spark):
    from inkstrata.plans import panel

    cols = "id string, ticker string, theme string, context string, prompt string, ord int"
    items = spark.createDataFrame([("a", "T", "x", "ctx a", "ask a", 1), ("b", "U", "y", "ctx b", "ask b", 2), ("b", "U", "y", "ctx b2", "ask b2", 3)], cols)
    asked = spark.createDataFrame([(1, "b · U · y", "", ""), (2, "none", None, None), (3, "b · U · y", " own ", " "), (4, None, "own", " mine ")], "asked_id int, label string, question string, asked_context string")
    got = {r["asked_id"]: r["prompt"] for r in panel.by_label(asked, items).collect()}
    lead = lambda t, x, c, q: f"Ticker: {t}\nTheme: {x}\n\nContext:\n{c}\n\nQuestion:\n{q}"
    assert got == {1: lead("U", "y", "ctx b2", "ask b2"), 2: lead("T", "x", "ctx a", "ask a"), 3: lead("U", "y", "ctx b2", "own"), 4: lead("T", "x", "mine", "own")}
    got = {r["asked_id"]: r["prompt"] for r in panel.by_label(asked, items.where("false")).collect()}
    assert got[1] == panel.NO_ITEMS and got[4] == lead("CUSTOM", "custom", "mine", "own")


def test_chat_template_hook(spark):
    from pyspark.sql.functions import pandas_udf

    @pandas_udf("string")
    def template(told):
        return told.map(lambda rows: "".join(f"[{r['role'] if isinstance(r, dict) else r[0]}]{r['content'] if isinstance(r, dict) else r[1]}" for r in rows))

    rows = spark.createDataFrame([("a", " ask ", None, " out ", "train"), ("b", "ask", " ctx", "out", "train")], "pair_id string, instruction string, context string, output string, split string")
    assert dataset.training_plan(rows, "sys", template).first()["previews"] == ["[system]sys[user]ask[assistant]out", "[system]sys[user]ask\n\nContext from the source excerpt:\nctx[assistant]out"]


def test_card_values():
    assert [writers.card_value(x) for x in (None, 0.5, 3, "x", {}, {"10": 0.25, "1": None, "b": 2}, True)] == ["TBD", "0.5000", "3", "x", "TBD", "1=TBD, b=2, 10=0.2500", "True"]


def test_bundled_settings(tmp_path):
    from inkstrata import config

    assert config.load_settings() == config.Settings() == config.load_settings("nowhere/default.json")
    (tmp_path / "default.json").write_text('{"retrieval": {"k1": 2.0, "other": 1}, "more": {}}')
    own = config.load_settings(tmp_path / "default.json")
    assert own.retrieval.k1 == 2.0 and own.extras == {"more": {}, "retrieval": {"other": 1}}
    with pytest.raises(FileNotFoundError):
        config.load_settings("nowhere/at_all.json")
    (tmp_path / "x.txt").write_text("")
    with pytest.raises(ValueError, match="JSON or YAML"):
        config.load_settings(tmp_path / "x.txt")
    (tmp_path / "l.json").write_text("[]")
    with pytest.raises(TypeError):
        config.load_settings(tmp_path / "l.json")


def test_stash_and_discard(spark):
    from pathlib import Path

    from inkstrata.session import discard, stash

    kept, gone = stash(spark.range(5)), stash(spark.range(7))
    discard(gone, spark.range(3))
    assert kept.count() == 5 and Path(kept._stashed.removeprefix("file://")).exists() and not Path(gone._stashed.removeprefix("file://")).exists()
