"""One query for each operator, over the whole tables. The SQL for them is in ``oracles``."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import fixtures
from .config import Retrieval, Selection
from .functions import text as T
from .operators import chunking, corpus, dedup, evaluation, filtering, retrieval, selection, similarity
from .operators import pairs as pairing
from .plans import dataset, panel, rag
from .session import new_path, remove_at_end, spread, stash
from .sources import catalog, readers, writers

Query = Callable[[SparkSession, str], DataFrame]
TOP = 10


def _table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spread(spark.read.parquet(f"{d}/{name}.parquet"))


def _docs(spark: SparkSession, d: str) -> DataFrame:
    return _table(spark, d, "documents").select("doc_id", T.text_of(F.col("text")).alias("text"), "source")


def _queries(spark: SparkSession, d: str) -> DataFrame:
    return _table(spark, d, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("query"))


def _records(spark: SparkSession, d: str) -> DataFrame:
    """The documents and, with negative ids, hand-made texts with headings, speakers and figures."""
    rows = spark.createDataFrame(fixtures.TEXTS, "doc_id long, source string, text string")
    return chunking.records(_docs(spark, d).select("doc_id", "source", "text").unionByName(rows))


def _chunks(spark: SparkSession, d: str) -> DataFrame:
    return chunking.chunk(_records(spark, d))


def _pairs(spark: SparkSession, d: str) -> DataFrame:
    return dataset.ordered(pairing.generate(_chunks(spark, d)))


def _talks(spark: SparkSession, d: str) -> DataFrame:
    return pairing.from_conversations(_table(spark, d, "conversations")).withColumn("ord", F.col("pos"))


def _item(hits: DataFrame) -> DataFrame:
    return hits.select(F.col("query_id").alias("item_id"), F.col("rank").cast("long").alias("rank"), "doc_id", F.round("score", 6).alias("score"))


# Sources.


def source_catalog(spark: SparkSession, d: str) -> DataFrame:
    return catalog.catalog(spark).select(
        "source_id", "display_name", "role", F.array_join("text_fields", ",").alias("text_fields"), "license_note", F.col("cap").cast("long").alias("cap"), "hf_id", "homepage", "notes", "default_split")


def offline_samples(spark: SparkSession, d: str) -> DataFrame:
    rows = catalog.load_all(spark, most=3)
    return rows.select("source_id", F.length("text").cast("long").alias("chars"), F.sha1("text").alias("sha"), F.size("metadata").cast("long").alias("n_meta"))


def text_coalescing(spark: SparkSession, d: str) -> DataFrame:
    """Each conversation's turns as a row of fields: role is no text field, so it only counts if it is long."""
    rows = _table(spark, d, "conversations")
    parts = T.coalesce_text([F.when(F.col("role") == "user", F.col("text")), F.when(F.col("turn") % 3 == 0, F.col("text"))], [F.col("role"), F.col("text")])
    return rows.select("conv_id", "turn", F.length(parts).cast("long").alias("chars"), F.sha1(parts).alias("sha"))


def source_caps(spark: SparkSession, d: str) -> DataFrame:
    """Records of each source under its cap, texts cut at 12,000 characters."""
    rows = _docs(spark, d).where("text != ''").select("source", "doc_id", F.substring("text", 1, 12_000).alias("text"))
    kept = readers.capped(rows, {"src0": 400, "src1": 20, "src2": 150}, 50, "source", "doc_id")
    return kept.groupBy("source").agg(F.count("*").alias("n"), F.sum(F.length("text")).alias("chars"), F.max("doc_id").alias("last_id"))


# Text.


def sentence_counts(spark: SparkSession, d: str) -> DataFrame:
    s = T.sentences(F.col("text"))
    return _docs(spark, d).select("doc_id", F.size(s).cast("long").alias("n_sentences"), F.length(F.array_join(s, "")).cast("long").alias("chars"))


def section_blocks(spark: SparkSession, d: str) -> DataFrame:
    rows = chunking.split_sections(_records(spark, d).select("pos", "text"))
    return rows.select(F.col("pos").alias("doc_id"), F.col("block").cast("long").alias("block"), "section", F.length("body").cast("long").alias("chars"))


def sentence_windows(spark: SparkSession, d: str) -> DataFrame:
    return _chunks(spark, d).select(
        F.col("pos").alias("doc_id"), "chunk_id", F.col("start_sentence").cast("long").alias("start_sentence"), F.col("end_sentence").cast("long").alias("end_sentence"), F.length("text").cast("long").alias("chars")
    )


def propositions_topk(spark: SparkSession, d: str) -> DataFrame:
    rows = _chunks(spark, d).select(F.col("pos").alias("doc_id"), "chunk_id", F.posexplode("propositions").alias("place", "p"))
    return rows.select("doc_id", "chunk_id", F.col("place").cast("long").alias("place"), F.col("p.source_sentence_index").cast("long").alias("sentence"), F.col("p.score").alias("score"), F.sha1("p.text").alias("sha"))


def token_overlap(spark: SparkSession, d: str) -> DataFrame:
    o = T.overlap(T.metric_tokens(F.col("output")), T.metric_tokens(F.col("instruction")))
    return _talks(spark, d).select("pair_id", o.alias("o")).select("pair_id", "o.precision", "o.recall", "o.f1", "o.jaccard")


def citation_hits(spark: SparkSession, d: str) -> DataFrame:
    """Needles: the instruction's first five tokens in order of the alphabet, and an empty one."""
    needles = F.concat(F.slice(F.array_sort(T.metric_tokens(F.col("instruction"))), 1, 5), F.array(F.lit("")))
    rows = _talks(spark, d).withColumn("needles", needles)
    return rows.select("pair_id", F.size(T.citation_hits(F.col("output"), F.col("needles"))).cast("long").alias("n_hits"), T.citation_rate(F.col("output"), F.col("needles")).alias("rate"))


def refusal_flags(spark: SparkSession, d: str) -> DataFrame:
    talks = _talks(spark, d).select("pair_id", F.col("output").alias("text"))
    made = spark.createDataFrame(fixtures.ANSWERS, "pair_id string, text string")
    return talks.unionByName(made).select("pair_id", T.is_refusal(F.col("text")).alias("refused"))


def chat_texts(spark: SparkSession, d: str) -> DataFrame:
    text = T.chat(F.lit("Answer from the context."), F.col("instruction"), F.col("context"), F.col("output"))
    return _talks(spark, d).select("pair_id", F.length(text).cast("long").alias("chars"), F.sha1(text).alias("sha"))


# Chunks, pairs, corpus.


def grounded_pairs(spark: SparkSession, d: str) -> DataFrame:
    return _pairs(spark, d).select(F.col("pos").alias("doc_id"), "pair_id", "task", "instruction", F.size("citations").cast("long").alias("n_cites"), F.sha1("output").alias("output_sha"), F.sha1(F.array_join("citations", "\n")).alias("cites_sha"))


def corpus_dedupe(spark: SparkSession, d: str) -> DataFrame:
    return corpus.dedupe(_chunks(spark, d)).select("chunk_id", F.col("pos").alias("doc_id"), F.col("n_propositions").cast("long").alias("n_propositions"))


def corpus_manifest(spark: SparkSession, d: str) -> DataFrame:
    return corpus.manifest(corpus.dedupe(_chunks(spark, d)))


def corpus_pairs(spark: SparkSession, d: str) -> DataFrame:
    """Pairs made again from a corpus without propositions."""
    made = pairing.generate(pairing.from_corpus(corpus.dedupe(_chunks(spark, d)).drop("n_propositions")))
    return made.groupBy("source_id", "task").agg(F.count("*").alias("n"), F.sum(F.length("output")).alias("chars"))


# Filters.


def heuristic_filter(spark: SparkSession, d: str) -> DataFrame:
    talks = _talks(spark, d).select("pair_id", "chunk_id", "instruction", "context", "output", "citations")
    made = spark.createDataFrame(fixtures.PAIRS, "pair_id string, chunk_id string, instruction string, context string, output string, citations array<string>")
    return filtering.heuristic(talks.unionByName(made)).select("pair_id", "kept", F.array_join("reasons", ",").alias("reasons"))


def judge_scores(spark: SparkSession, d: str) -> DataFrame:
    made = spark.createDataFrame(fixtures.PAIRS, "pair_id string, chunk_id string, instruction string, context string, output string, citations array<string>")
    rows = _pairs(spark, d).select("pair_id", "chunk_id", "output", "citations").unionByName(made.select("pair_id", "chunk_id", "output", "citations"))
    return filtering.judge(rows).groupBy("pair_id").agg(F.count("*").alias("n"), F.min("judge_score").alias("score"), F.bool_and("kept").alias("kept"))


def filter_report(spark: SparkSession, d: str) -> DataFrame:
    """Both filters in one pass over the pairs."""
    checked = filtering.heuristic(_pairs(spark, d)).select("output", "chunk_id", "citations", F.struct("stage", "kept").alias("h"))
    judged = filtering.judge(checked).select("h", F.struct(F.lit("llm_judge").alias("stage"), "kept").alias("j"))
    return filtering.report(judged.select(F.explode(F.array("h", "j")).alias("x")).select("x.*"))


def exact_dups(spark: SparkSession, d: str) -> DataFrame:
    rows = _docs(spark, d).select("doc_id", T.fingerprint(F.lit("doc"), F.lit(""), F.col("text")).alias("fingerprint"))
    return rows.groupBy("fingerprint").agg(F.count("*").alias("n"), F.min("doc_id").alias("first_id"))


def near_dup_pairs(spark: SparkSession, d: str) -> DataFrame:
    rows = _docs(spark, d).withColumn("tokens", T.pair_tokens(F.lit(""), F.col("text")))
    keyed = rows.select("doc_id", "tokens", T.block_key(F.lit("all"), F.lit("doc"), F.col("text"), F.col("tokens")).alias("block"))
    return similarity.jaccard_pairs(keyed, 0.88, "doc_id", "block").select(F.col("a").alias("id_a"), F.col("b").alias("id_b"), F.round("jaccard", 6).alias("jaccard"))


def diversity_conflicts(spark: SparkSession, d: str) -> DataFrame:
    rows = _talks(spark, d).select("ord", T.token_set(F.concat_ws(" ", "task", "instruction", "output")).alias("tokens"))
    return similarity.jaccard_pairs(rows, 0.72).select(F.col("a").alias("id_a"), F.col("b").alias("id_b"), F.round("jaccard", 6).alias("jaccard"))


def dedup_greedy(spark: SparkSession, d: str) -> DataFrame:
    return dedup.drop_duplicates(_talks(spark, d)).select(F.col("ord").alias("pos"), "stage")


def diversity_greedy(spark: SparkSession, d: str) -> DataFrame:
    return selection.diversity(_talks(spark, d)).select("pair_id", "source_id", "task")


def group_caps(spark: SparkSession, d: str) -> DataFrame:
    """Caps so that only the tasks' cap binds: sources have fewer pairs than theirs."""
    made = stash(_pairs(spark, d).select("ord", "pair_id", "source_id", "task"), "pairs")
    kept = selection.group_caps(made, Selection(max_per_source=10**9, max_per_source_task=10**9))
    return kept.select(F.col("ord.pos").alias("doc_id"), "pair_id", "source_id", "task")


def group_caps_all(spark: SparkSession, d: str) -> DataFrame:
    """Caps of sources, tasks and both that all bind and move each other; every third pair is a summary."""
    rows = _talks(spark, d).select("ord", "pair_id", "source_id", F.when(F.col("ord") % 3 == 0, "summary").otherwise("qa").alias("task"))
    return selection.group_caps(rows, Selection(max_per_source=30, max_per_task=80, max_per_source_task=22)).select("pair_id", "source_id", "task")


def split_round_trip(spark: SparkSession, d: str) -> DataFrame:
    """Splits written as JSON lines and read again, each row with the file it was in."""
    folder = _written(spark, lambda at: writers.splits(_split_talks(spark, d), at))
    parts = [readers.read(spark, f"{folder}/{s}.jsonl", "pair").withColumn("split", F.lit(s)) for s in ("train", "val", "test")]
    rows = parts[0].unionByName(parts[1]).unionByName(parts[2])
    return rows.select("pair_id", "split", "source_id", "task", F.sha1("output").alias("output_sha"), F.size("citations").cast("long").alias("n_cites"))


def train_ids(spark: SparkSession, d: str) -> DataFrame:
    return readers.train_ids(spark, _written(spark, lambda at: writers.splits(_split_talks(spark, d), at)))


def _split_talks(spark: SparkSession, d: str) -> DataFrame:
    rows = _talks(spark, d).drop("ord", "pos")
    return rows.withColumn("split", selection.split(F.col("pair_id")))


def _written(spark: SparkSession, write: Callable[[str], object]) -> str:
    """A new folder in the shared one, filled by ``write`` and removed when the driver ends."""
    folder = new_path(spark, "written")
    write(folder)
    remove_at_end(spark, folder)
    return folder


def jsonl_defaults(spark: SparkSession, d: str) -> DataFrame:
    """Hand-made lines with blank lines, missing and empty fields, read as chunks."""
    folder = _written(spark, lambda at: spark.createDataFrame([(x,) for x in fixtures.LINES], "value string").coalesce(1).write.text(at))
    rows = readers.read(spark, folder, "chunk")
    return rows.select("chunk_id", "source_id", "section", "text", F.col("start_sentence").cast("long").alias("start_sentence"), F.size("propositions").cast("long").alias("n_propositions"), F.size("metadata").cast("long").alias("n_meta"))


def hash_split(spark: SparkSession, d: str) -> DataFrame:
    return _docs(spark, d).select("doc_id", selection.split(F.col("doc_id").cast("string")).alias("split"))


def split_counts(spark: SparkSession, d: str) -> DataFrame:
    return _docs(spark, d).select("source", selection.split(F.col("doc_id").cast("string")).alias("split")).groupBy("source", "split").agg(F.count("*").alias("n"))


def dataset_build(spark: SparkSession, d: str) -> DataFrame:
    """The whole flow: chunks, pairs, filters, duplicates, caps, diversity, split."""
    chosen, _, _ = dataset.build(chunking.records(_docs(spark, d)))
    return chosen.select("pair_id", "source_id", "task", "split")


# Retrieval.


def bm25_stats(spark: SparkSession, d: str) -> DataFrame:
    index = retrieval.build_index(_docs(spark, d))
    return index.stats.crossJoin(index.df.agg(F.count("*").alias("n_terms"), F.sum("df").alias("n_postings"))).select("n", F.round("avgdl", 6).alias("avgdl"), "n_terms", "n_postings")


def bm25_round_trip(spark: SparkSession, d: str) -> DataFrame:
    """The best ten by an index of all terms that was written and read again."""
    folder = _written(spark, lambda at: writers.index(retrieval.build_index(_docs(spark, d)), at))
    return _item(retrieval.bm25(writers.read_index(spark, folder), _queries(spark, d), TOP))


def embedding_round_trip(spark: SparkSession, d: str) -> DataFrame:
    """The best ten by vectors that were written in single precision and read again."""
    own = _table(spark, d, "embeddings").select(F.col("vec_id").alias("doc_id"), "embedding")
    rows = writers.read_embeddings(spark, _written(spark, lambda at: writers.embeddings(own, at)))
    asked = rows.where(F.col("doc_id") % 100 == 0).withColumnRenamed("doc_id", "query_id")
    found = retrieval.dense(rows, asked, TOP)
    return found.select(F.col("query_id").alias("q_id"), F.col("rank").cast("long").alias("rank"), F.col("doc_id").alias("vec_id"), F.round("score", 6).alias("score"))


def bm25_topk(spark: SparkSession, d: str) -> DataFrame:
    docs, queries = _docs(spark, d), _queries(spark, d)
    return _item(retrieval.bm25(retrieval.index_for(docs, queries), queries, TOP))


def hash_embed_dims(spark: SparkSession, d: str) -> DataFrame:
    return retrieval.hash_weights(_docs(spark, d)).select("doc_id", F.col("idx").cast("long").alias("idx"), F.round("weight", 6).alias("weight"))


def dense_topk(spark: SparkSession, d: str) -> DataFrame:
    return _item(rag.embedded(_docs(spark, d), _queries(spark, d), TOP))


def embedding_topk(spark: SparkSession, d: str) -> DataFrame:
    """Queries: the vectors whose id is divisible by 100, against all."""
    rows = _table(spark, d, "embeddings").select(F.col("vec_id").alias("doc_id"), retrieval.as_stored(F.col("embedding")).alias("embedding"))
    asked = rows.where(F.col("doc_id") % 100 == 0).withColumnRenamed("doc_id", "query_id")
    found = retrieval.dense(rows, asked, TOP)
    return found.select(F.col("query_id").alias("q_id"), F.col("rank").cast("long").alias("rank"), F.col("doc_id").alias("vec_id"), F.round("score", 6).alias("score"))


def hybrid_rrf_topk(spark: SparkSession, d: str) -> DataFrame:
    return _item(rag.rankings(_docs(spark, d), _queries(spark, d), TOP)["hybrid-rrf"])


def retrieval_metrics(spark: SparkSession, d: str) -> DataFrame:
    docs, queries = _docs(spark, d), _queries(spark, d)
    return rag.evaluate(docs, queries, rag.contained(docs, queries)).withColumn("k", F.col("k").cast("long"))


# Evaluation.


def _pairs_and_corpus(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """Both from the same chunks, which are made once."""
    chunks = stash(_chunks(spark, d), "chunks")
    return dataset.ordered(pairing.generate(chunks)), corpus.dedupe(chunks)


def eval_candidates(spark: SparkSession, d: str) -> DataFrame:
    made, own = _pairs_and_corpus(spark, d)
    train = made.where(selection.split(F.col("pair_id")) == "train").select("pair_id")
    found = evaluation.candidates(made, own, train)
    return found.select("query_id", "query", F.col("gold_chunk_ids")[0].alias("gold"), "task")


def eval_sample(spark: SparkSession, d: str) -> DataFrame:
    """50 rows, in turn from each source and task: the sample is the feature."""
    found = evaluation.round_robin(evaluation.candidates(*_pairs_and_corpus(spark, d)))
    return found.select("query_id", "source_id", "task")


def eval_manifest(spark: SparkSession, d: str) -> DataFrame:
    return evaluation.eval_manifest(evaluation.round_robin(evaluation.candidates(*_pairs_and_corpus(spark, d))))


def eval_missing_gold(spark: SparkSession, d: str) -> DataFrame:
    """Gold ids that a corpus without its qa sections lacks."""
    made, own = _pairs_and_corpus(spark, d)
    return evaluation.missing_gold(evaluation.candidates(made, own), own.where("section != 'qa'")).select("query_id", "chunk_id")


def _packed(spark: SparkSession, d: str) -> DataFrame:
    docs, queries = _docs(spark, d), _queries(spark, d)
    hits = retrieval.bm25(retrieval.index_for(docs, queries), queries, Retrieval().top_k)
    rows = hits.join(docs, "doc_id").select("query_id", "rank", F.col("doc_id").alias("chunk_id"), F.col("source").alias("source_id"), "text")
    return evaluation.pack_context(rows)


def context_pack(spark: SparkSession, d: str) -> DataFrame:
    return _packed(spark, d).select(F.col("query_id").alias("item_id"), "n_blocks", F.length("packed").cast("long").alias("packed_chars"), F.sha1("packed").alias("packed_sha"))


def generation_scores(spark: SparkSession, d: str) -> DataFrame:
    """The base side's placeholder, and an adapter that repeats the prompt's 200th to 600th character; the query is the gold answer."""
    rows = _queries(spark, d).join(_packed(spark, d), "query_id", "left").withColumn("packed", F.coalesce("packed", F.lit(""))).withColumn("gold_answer", F.col("query"))
    return evaluation.generation_means(evaluation.generation_scores(evaluation.answers(rows, adapter=lambda p: F.substring(p, 200, 400))))


def generation_items(spark: SparkSession, d: str) -> DataFrame:
    """Without gold answers for odd items."""
    gold = F.when(F.col("query_id") % 2 == 0, F.col("query"))
    rows = _queries(spark, d).join(_packed(spark, d), "query_id", "left").withColumn("packed", F.coalesce("packed", F.lit(""))).withColumn("gold_answer", gold)
    scored = evaluation.generation_scores(evaluation.answers(rows, adapter=lambda p: F.substring(p, 200, 400)))
    return scored.select(F.col("query_id").alias("item_id"), "side", "citation_rate", "f1_context", "f1_gold", "grounded")


def flow_counts(spark: SparkSession, d: str) -> DataFrame:
    """What the flow's steps report: records, chunks, propositions; pairs by task."""
    chunks = stash(_chunks(spark, d), "chunks")
    return chunking.counts(chunks).crossJoin(F.broadcast(pairing.counts(pairing.generate(chunks))))  # one row each


def _items(spark: SparkSession, d: str) -> DataFrame:
    """The benchmark's items as a panel."""
    i = F.col("item_id")
    return _table(spark, d, "benchmark").select(
        i.cast("string").alias("id"), F.concat(F.lit("T"), (i % 5).cast("string")).alias("ticker"), F.concat(F.lit("theme "), (i % 7).cast("string")).alias("theme"),
        F.col("text").alias("context"), F.concat(F.lit("What is said in item "), i.cast("string"), F.lit("?")).alias("prompt"), i.alias("ord"))


def panel_themes(spark: SparkSession, d: str) -> DataFrame:
    return evaluation.themes(_items(spark, d))


def panel_prompts(spark: SparkSession, d: str) -> DataFrame:
    """Asked: every item by its label; every third with a question of its own, every sixth with a context; every fourth label is unknown."""
    items, i = _items(spark, d), F.col("ord")
    asked = items.select(
        i.alias("asked_id"), F.when(i % 4 == 0, "unknown").otherwise(panel.label()).alias("label"), F.when(i % 3 == 0, " Why? ").alias("question"), F.when(i % 6 == 0, "\tOwn context. ").alias("asked_context"))
    return panel.by_label(asked, items).select("asked_id", F.sha1("prompt").alias("sha"), F.length("prompt").cast("long").alias("chars"))


def panel_scores(spark: SparkSession, d: str) -> DataFrame:
    return evaluation.panel_means(evaluation.panel_scores(_panel(spark)))


def panel_items(spark: SparkSession, d: str) -> DataFrame:
    return evaluation.panel_scores(_panel(spark))


def _panel(spark: SparkSession) -> DataFrame:
    rows = spark.createDataFrame(fixtures.PANEL, "id string, context string, must_cite array<string>, refuse_if_missing boolean, base_output string, adapter_output string")
    return rows


QUERIES: tuple[Query, ...] = (
    bm25_topk, source_catalog, offline_samples, text_coalescing, source_caps, sentence_counts, section_blocks, sentence_windows, propositions_topk, token_overlap, citation_hits,
    refusal_flags, chat_texts, grounded_pairs, corpus_dedupe, corpus_manifest, corpus_pairs, heuristic_filter, judge_scores, filter_report, exact_dups, near_dup_pairs,
    diversity_conflicts, dedup_greedy, diversity_greedy, group_caps, group_caps_all, hash_split, split_counts, split_round_trip, train_ids, jsonl_defaults, dataset_build, bm25_stats, bm25_round_trip, embedding_round_trip, hash_embed_dims, dense_topk, embedding_topk, hybrid_rrf_topk,
    retrieval_metrics, eval_candidates, eval_sample, eval_manifest, eval_missing_gold, flow_counts, panel_themes, panel_prompts, context_pack, generation_scores, generation_items, panel_scores, panel_items,
)


def queries() -> dict[str, Query]:
    return {q.__name__: q for q in QUERIES}
