"""Steps that grew too fast or cost too much: results as before, and bounds on what they make."""

from __future__ import annotations

from pyspark.sql import functions as F

from inkstrata.functions import text as T


def test_fast_forms_equal_the_patterns(spark):
    """Stripping, cues and tokens without the slow patterns, over every character of the basic plane and words in odd case."""
    chars = [chr(i) for i in range(1, 0x10000) if not 0xD800 <= i < 0xE000]
    words = [f"x {w} y" for v in (*T.FACT_WORDS, "basis  points", "basis points", "year over-year", "year  over year", "cuſtomer", "mİllion", "out looK", "nothing", "5", "٥") for w in (v, v.upper(), v.title())]
    rows = spark.createDataFrame([(x,) for c in chars for x in (f"{c}a{c}b{c}",)] + [(w,) for w in words], "t string").repartition(8)
    t = F.col("t")
    both = rows.select(
        "t", T.strip(t).alias("a1"), F.regexp_replace(t, r"(?U)^\s+|\s+$", "").alias("a2"), T.has_cue(t, F.lower(t)).alias("b1"), t.rlike(T.FACT_CUES).alias("b2"),
        T.search_tokens(t).alias("c1"), F.transform(F.regexp_extract_all(t, F.lit(r"(?iu)[a-z0-9%]+"), F.lit(0)), F.lower).alias("c2"),
        T.plain(t).alias("d1"), T.squeeze(F.regexp_replace(T.strip(F.lower(t)), r"(?U)[^a-z0-9\s%]+", " ")).alias("d2"),
    )
    assert both.where("a1 != a2 or b1 != b2 or c1 != c2 or d1 != d2").limit(5).collect() == []


def _pairs_by_hand(sets: dict, threshold: float) -> set:
    return {(a, b) for a in sets for b in sets if a < b and (len(sets[a] & sets[b]) / len(sets[a] | sets[b]) if sets[a] | sets[b] else 1.0) >= threshold}


def test_join_passes_on_only_likely_pairs(spark, monkeypatch):
    """Sets that share rare tokens but little else meet in the join and don't leave it; all similar ones do."""
    import random

    from inkstrata.operators import similarity

    r = random.Random(5)
    sets = {}
    for i in range(400):
        sets[i] = set(sets[i - 1]) ^ {f"c{r.randrange(300)}" for _ in range(r.randrange(12))} if i % 4 == 3 else {f"c{r.randrange(300)}" for _ in range(80)} | {f"rare{i // 100}", f"rarer{i // 40}"}
    sets |= {400: set(), 401: set(), 402: {"x"}, 403: {"x"}}
    made, real = {}, similarity.stash
    monkeypatch.setattr(similarity, "stash", lambda df, tag="stash": made.setdefault(tag, real(df, tag)))
    rows = spark.createDataFrame([(k, sorted(v)) for k, v in sets.items()], "ord long, tokens array<string>")
    found = {(x["a"], x["b"]) for x in similarity.jaccard_pairs(rows, 0.72).collect()}
    assert found == _pairs_by_hand(sets, 0.72)
    assert made["candidates"].count() <= 3 * len(found)


def test_rows_alone_in_their_block_are_not_compared(spark, monkeypatch):
    from inkstrata.operators import similarity

    made, real = {}, similarity.stash
    monkeypatch.setattr(similarity, "stash", lambda df, tag="stash": made.setdefault(tag, real(df, tag)))
    rows = spark.createDataFrame([(i, f"b{i % 90}", ["a", "b", "c", f"x{i % 3}"]) for i in range(93)], "ord long, block string, tokens array<string>")
    assert {(x["a"], x["b"]) for x in similarity.jaccard_pairs(rows, 0.88, "ord", "block").collect()} == {(0, 90), (1, 91), (2, 92)}
    assert made["sets"].count() == 6 and made["candidates"].count() == 0  # equal sets are not listed as pairs


def test_groups_under_their_cap_are_not_brought_together(spark):
    """A window over a whole group is left out where the group is under its cap; cuts at large caps are those of the scan."""
    from inkstrata.config import Selection
    from inkstrata.operators import selection

    rows = spark.range(3000).repartition(8).select(F.col("id").alias("ord"), F.lit("s").alias("source_id"), F.when(F.col("id") % 3 == 0, "a").otherwise("b").alias("task"))
    plan = lambda df: df._jdf.queryExecution().optimizedPlan().toString()
    kept = selection.group_caps(rows, Selection(max_per_source=10**9, max_per_source_task=10**9, max_per_task=1500))
    assert "Window" not in plan(kept)
    assert sorted(r["ord"] for r in kept.collect()) == [i for i in range(3000) if i % 3 == 0 or i < 2250]
    assert selection._overflow(rows, "task", 10**6).count() == 0
    assert [tuple(r) for r in selection._overflow(rows, "task", 1200).collect()] == [("b", 1801)]


def test_embeddings_shuffle_no_token(spark):
    from inkstrata.operators import retrieval

    docs = spark.createDataFrame([(1, "One two, TWO three 5% ſK İx"), (2, ""), (3, None), (4, "é !"), (5, "two " * 300)], "doc_id long, text string")
    found = retrieval.hash_embeddings(docs)
    assert "Exchange" not in found._jdf.queryExecution().executedPlan().toString()
    weights = {(r["doc_id"], r["idx"]): r["weight"] for r in retrieval.hash_weights(docs).collect()}
    got = {(r["doc_id"], i): w for r in found.collect() for i, w in enumerate(r["embedding"]) if w}
    assert got == weights and sorted(r["doc_id"] for r in found.collect()) == [1, 2, 3, 4, 5]


def test_scoring_tasks_follow_the_pairs(spark, monkeypatch):
    """However small the postings are, a task sums up no more than PAIRS_A_TASK pairs."""
    from inkstrata.operators import retrieval

    monkeypatch.setattr(retrieval, "PAIRS_A_TASK", 100)
    docs = spark.range(400).select(F.col("id").alias("doc_id"), F.lit("a b c").alias("text"))
    queries = spark.createDataFrame([(i, "a b") for i in range(10)], "query_id long, query string")
    scores = retrieval.bm25_scores(retrieval.index_for(docs, queries), queries)
    sizes = [r["n"] for r in scores.groupBy(F.spark_partition_id()).agg(F.count("*").alias("n")).collect()]
    assert sum(sizes) == 4000 and len(sizes) > 25 and max(sizes) <= 300
