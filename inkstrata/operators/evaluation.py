"""Retrieval metrics, evaluation sets, packed contexts, grounded generation scores, the research panel."""

from __future__ import annotations

import random
from collections import deque
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..config import EvalSet, Retrieval
from ..functions import text as T

# Prompts, placeholders and notes that results depend on.
PROMPT_PARTS = ("Ticker: ", "\nTheme: ", "\n\nContext:\n", "\n\nQuestion:\n")
NO_WEIGHTS = (" dry-run] No weights loaded. Packed context is ", " chars. Run on Kaggle with --run (and optional --adapter-dir) to fill generations.")
NOTES = {True: "expect refusal / insufficient-context", False: "expect grounded citations"}
DRY_RUN = {"base": "[dry-run] base model not loaded; run on Kaggle with --run", "adapter": "[dry-run] adapter not loaded; pass --adapter-dir after QLoRA --run"}


def query_scores(gold: DataFrame, hits: DataFrame, queries: DataFrame, k_values: tuple[int, ...] = Retrieval().k_values) -> DataFrame:
    """(query_id, k, recall, ndcg), 6 digits, from gold (query_id, doc_id) and hits (query_id, doc_id, rank). Without gold 0."""
    golds = gold.where("doc_id is not null").distinct()
    n_gold = golds.groupBy("query_id").agg(F.count("*").alias("n_gold"))
    ks = F.explode(F.array(*map(F.lit, k_values)))
    found = golds.join(hits.select("query_id", "doc_id", "rank"), ["query_id", "doc_id"]).groupBy("query_id").agg(F.collect_list("rank").alias("ranks"))
    rows = queries.select("query_id").distinct().join(n_gold, "query_id", "left").join(found, "query_id", "left").withColumn("k", ks)
    rows = rows.withColumn("top", F.filter(F.coalesce("ranks", F.array().cast("array<int>")), lambda r: r <= F.col("k"))).withColumn("n_gold", F.coalesce("n_gold", F.lit(0)))
    gain = lambda r: 1 / F.log2(r + 1)
    total = lambda a: F.aggregate(F.array_sort(F.transform(a, gain)), F.lit(0.0), lambda s, x: s + x)
    ideal = F.when((F.col("n_gold") > 0) & (F.col("k") > 0), F.sequence(F.lit(1), F.least(F.col("n_gold").cast("int"), F.greatest("k", F.lit(1))))).otherwise(F.array().cast("array<int>"))
    recall = F.coalesce(F.try_divide(F.size("top").cast("double"), F.col("n_gold").cast("double")), F.lit(0.0))
    ndcg = F.coalesce(F.try_divide(total(F.col("top")), total(ideal)), F.lit(0.0))
    return rows.select("query_id", "k", F.round(recall, 6).alias("recall"), F.round(ndcg, 6).alias("ndcg"))


def mean_scores(scores: DataFrame, backend: str) -> DataFrame:
    """(backend, k, mean_recall, mean_ndcg) of the rounded figures."""
    mean = lambda c: F.round(F.coalesce(F.avg(c), F.lit(0.0)), 6)
    return scores.groupBy("k").agg(mean("recall").alias("mean_recall"), mean("ndcg").alias("mean_ndcg")).select(F.lit(backend).alias("backend"), "k", "mean_recall", "mean_ndcg")


def candidates(pairs: DataFrame, corpus_ids: DataFrame, excluded: DataFrame | None = None) -> DataFrame:
    """Evaluation rows from pairs (ord, ...): not excluded (by pair_id), gold chunk in the corpus, one for each query and gold."""
    rows = pairs if excluded is None else pairs.join(excluded.select("pair_id").distinct(), "pair_id", "left_anti")
    rows = rows.withColumn("query", T.strip(T.text_of(F.col("instruction")))).where(F.col("query") != "")
    rows = rows.where(T.text_of(F.col("chunk_id")) != "").join(corpus_ids.select("chunk_id").distinct(), "chunk_id", "left_semi")
    w = Window.partitionBy("query", "chunk_id").orderBy("ord")
    first = rows.withColumn("_n", F.row_number().over(w)).where("_n = 1")
    own = F.coalesce(F.nullif(F.col("pair_id"), F.lit("")), F.col("chunk_id"))
    return first.select(
        "ord",
        T.query_id(own, F.col("query")).alias("query_id"), "query", F.array("chunk_id").alias("gold_chunk_ids"), F.nullif(T.strip(T.text_of(F.col("output"))), F.lit("")).alias("gold_answer"),
        F.lit("grounded_pair").alias("source"), "pair_id", F.coalesce(F.nullif(F.col("task"), F.lit("")), F.lit("qa")).alias("task"),
        F.coalesce(F.nullif(F.col("source_id"), F.lit("")), F.lit("unknown")).alias("source_id"),
    )


def round_robin(rows: DataFrame, c: EvalSet = EvalSet()) -> DataFrame:
    """Up to ``size`` rows with distinct query_id, one from each (source, task) in turn; orders are hashes with the seed."""
    mark = lambda *x: F.sha1(F.concat_ws("|", F.lit(str(c.seed)), *x))
    once = Window.partitionBy("query_id").orderBy("pair_id")
    own = rows.withColumn("_o", F.row_number().over(once)).where("_o = 1").drop("_o")
    w = Window.partitionBy("source_id", "task").orderBy(mark(F.col("query_id")), "query_id")
    turn = own.withColumn("_turn", F.row_number().over(w)).where(F.col("_turn") <= c.size)
    return turn.orderBy("_turn", mark(F.col("source_id"), F.col("task")), "source_id", "task").limit(c.size).drop("_turn")


def shuffled_sample(rows: DataFrame, c: EvalSet = EvalSet(), most: int = 200_000) -> list[str]:
    """The query ids that a seeded Mersenne twister's shuffle of candidates (in order of ``ord``) and the same turns give, sorted.

    For results that must equal those of one machine: three short columns of at most ``most`` candidates come to the driver.
    """
    if rows.count() > most:
        raise ValueError(f"more than {most} candidates; use round_robin")
    listed = [(r["source_id"], r["task"], r["query_id"]) for r in rows.select("ord", "source_id", "task", "query_id").orderBy("ord").collect()]
    twister = random.Random(c.seed)
    twister.shuffle(listed)
    queues: dict[tuple[str, str], deque[str]] = {}
    for source, task, query in listed:
        queues.setdefault((source, task), deque()).append(query)
    turn = list(queues)
    twister.shuffle(turn)
    found: dict[str, None] = {}
    while turn and len(found) < c.size:
        for key in turn:
            if len(found) < c.size:
                found.setdefault(queues[key].popleft())
        turn = [key for key in turn if queues[key]]
    return sorted(found)


def eval_manifest(chosen: DataFrame) -> DataFrame:
    """One row: n_queries, n_unique_gold_chunks."""
    golds = chosen.select(F.explode_outer("gold_chunk_ids").alias("g"))
    return chosen.agg(F.count("*").alias("n_queries")).crossJoin(F.broadcast(golds.agg(F.count_distinct("g").alias("n_unique_gold_chunks"))))  # one row


def themes(panel: DataFrame) -> DataFrame:
    """Sorted distinct themes of a panel."""
    return panel.select("theme").distinct().orderBy("theme")


def missing_gold(rows: DataFrame, corpus_ids: DataFrame) -> DataFrame:
    """Gold ids that the corpus lacks; an evaluation set is sound if there are none."""
    gold = rows.select("query_id", F.explode("gold_chunk_ids").alias("chunk_id"))
    return gold.join(corpus_ids.select("chunk_id").distinct(), "chunk_id", "left_anti")


def pack_context(hits: DataFrame, most: int = Retrieval().context_chars) -> DataFrame:
    """(query_id, n_blocks, packed) from hits (query_id, rank, chunk_id, source_id, text).

    Blocks are joined until one would pass ``most``; of that one the beginning is added if over 40 characters fit. The first
    is never cut. A query has few hits, so its rows come together in one array.
    """
    body = T.strip(T.text_of(F.col("text")))
    block = F.concat(F.lit("["), T.text_of(F.col("chunk_id").cast("string")), F.lit(" | "), T.text_of(F.col("source_id")), F.lit("]\n"), body)
    w = Window.partitionBy("query_id").orderBy("rank")
    before = w.rowsBetween(Window.unboundedPreceding, -1)
    rows = hits.where(body != "").select("query_id", "rank", block.alias("block")).withColumn("n", F.length("block"))
    rows = rows.withColumn("used", F.coalesce(F.sum(F.col("n") + 2).over(before), F.lit(0)))
    over = (F.col("used") > 0) & (F.col("used") + 2 + F.col("n") > most)
    # Nothing is added after a block that doesn't fit, or once the room is used up.
    rows = rows.withColumn("over", over).withColumn("ended", F.coalesce(F.max(F.col("over").cast("int")).over(before), F.lit(0)) == 1)
    room = F.lit(most) - F.col("used") - 2
    piece = F.when(~F.col("over"), F.col("block")).when(room > 40, F.concat(F.substr(F.col("block"), F.lit(1), room.cast("int")), F.lit("…")))
    good = rows.where(~F.col("ended") & ((F.col("used") == 0) | (F.col("used") < most))).withColumn("piece", piece).where("piece is not null")
    return good.groupBy("query_id").agg(F.count("*").alias("n_blocks"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", "piece"))), lambda x: x["piece"]), "\n\n").alias("packed"))


def needles(gold: Column, packed: Column) -> Column:
    """Tokens to look for: shared by gold and context; without gold the context's longer ones; sorted and few."""
    ctx, own = T.metric_tokens(packed), T.metric_tokens(gold)
    shared = F.array_sort(F.array_intersect(own, ctx))
    return (
        F.when(T.text_of(gold) == "", F.slice(F.filter(F.array_sort(ctx), lambda t: F.length(t) >= 4), 1, 8))
        .when(F.size(shared) > 0, F.slice(shared, 1, 12)).otherwise(F.slice(F.array_sort(own), 1, 8))
    )


def generation_scores(rows: DataFrame) -> DataFrame:
    """Adds citation_rate, f1_context, f1_gold, grounded to (answer, packed, gold_answer, ...)."""
    gold = T.text_of(F.col("gold_answer"))
    has = gold != ""
    scored = rows.withColumn("citation_rate", T.citation_rate(F.col("answer"), needles(F.col("gold_answer"), F.col("packed"))))
    answer = T.metric_tokens(F.col("answer"))
    scored = scored.withColumn("f1_context", T.overlap(answer, T.metric_tokens(F.col("packed")))["f1"]).withColumn("_g", T.overlap(answer, T.metric_tokens(gold))["f1"])
    grounded = (F.coalesce(F.col("citation_rate") >= 0.5, F.lit(False)) & (F.col("f1_context") >= 0.05)) | (has & (F.col("_g") >= 0.3) & (F.col("f1_context") >= 0.1))
    return scored.withColumn("f1_gold", F.when(has, F.col("_g"))).withColumn("grounded", F.when(grounded, 1.0).otherwise(0.0)).drop("_g")


def generation_means(scored: DataFrame) -> DataFrame:
    """One row a side; nulls don't count."""
    mean = lambda c, name: F.round(F.avg(c), 6).alias(name)
    return scored.groupBy("side").agg(mean("citation_rate", "citation_hit_rate"), mean("f1_context", "mean_token_f1_vs_context"), mean("f1_gold", "mean_token_f1_vs_gold"), mean("grounded", "grounded_answer_accuracy"))


def placeholder(side: str, packed: Column) -> Column:
    """What stands for an answer when no model is there."""
    before, after = NO_WEIGHTS
    return F.concat(F.lit(f"[{side}{before}"), F.length(packed).cast("string"), F.lit(after))


Generate = Callable[[Column], Column]


def answers(rows: DataFrame, base: Generate | None = None, adapter: Generate | None = None) -> DataFrame:
    """One row a query and side with its answer, from (query, packed, ...); models are columns of the prompt (pandas UDFs)."""
    prompt = T.grounded_prompt(F.col("query"), F.col("packed"))
    made = [rows.withColumn("side", F.lit(s)).withColumn("answer", placeholder(s, F.col("packed")) if f is None else f(prompt)) for s, f in (("base", base), ("adapter", adapter))]
    return made[0].unionByName(made[1])


def prompt(ticker: Column, theme: Column, context: Column, question: Column) -> Column:
    """The panel's prompt."""
    parts = [x for name, c in zip(PROMPT_PARTS, (ticker, theme, context, question), strict=True) for x in (F.lit(name), c)]
    return F.concat(*parts)


def user_text() -> Column:
    """The panel's prompt from the columns ticker, theme, context, prompt."""
    return prompt(*map(F.col, ("ticker", "theme", "context", "prompt")))


def compare_panel(panel: DataFrame, base: Generate | None = None, adapter: Generate | None = None) -> DataFrame:
    """Adds both sides' outputs, their hits and a note to panel items."""
    out = panel
    for side, f in (("base", base), ("adapter", adapter)):
        out = out.withColumn(f"{side}_output", F.lit(DRY_RUN[side]) if f is None else f(user_text()))
        out = out.withColumn(f"{side}_citation_hits", T.citation_hits(F.col(f"{side}_output"), F.col("must_cite")))
    return out.withColumn("notes", F.when(F.col("refuse_if_missing"), NOTES[True]).otherwise(NOTES[False]))


def panel_scores(compared: DataFrame) -> DataFrame:
    """(id, side, f1, jaccard, citation_rate, refused, refusal_correct); the last is null unless a refusal is expected."""
    sides = [compared.select("id", F.lit(s).alias("side"), "context", "must_cite", "refuse_if_missing", F.col(f"{s}_output").alias("output")) for s in ("base", "adapter")]
    rows = sides[0].unionByName(sides[1]).withColumn("o", T.overlap(T.metric_tokens(F.col("output")), T.metric_tokens(F.col("context"))))
    refused = T.is_refusal(F.col("output"))
    return rows.select(
        "id", "side", F.col("o.f1").alias("f1"), F.col("o.jaccard").alias("jaccard"), T.citation_rate(F.col("output"), F.col("must_cite")).alias("citation_rate"),
        refused.alias("refused"), F.when(F.col("refuse_if_missing"), refused).alias("refusal_correct"),
    )


def panel_means(scores: DataFrame) -> DataFrame:
    mean = lambda c, name: F.round(F.avg(c), 4).alias(name)
    return scores.groupBy("side").agg(
        mean("f1", "token_f1_vs_context"), mean("jaccard", "token_jaccard_vs_context"), mean("citation_rate", "citation_hit_rate"), mean(F.col("refusal_correct").cast("double"), "refusal_accuracy")
    )
