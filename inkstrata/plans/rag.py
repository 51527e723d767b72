"""Retrieval flows: three rankings of one query set, their metrics, grounded generation."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import Retrieval
from ..functions import text as T
from ..operators import evaluation, retrieval
from ..session import stash

#: Words, or else characters, of the keys by which passages are looked up.
RUN, GRAM = 5, 3


def embedded(docs: DataFrame, queries: DataFrame, k: int, c: Retrieval = Retrieval()) -> DataFrame:
    """The ranking by hashed embeddings alone."""
    asked = retrieval.hash_embeddings(queries.select(F.col("query_id").alias("doc_id"), F.col("query").alias("text")), c.dim).withColumnRenamed("doc_id", "query_id")
    return retrieval.dense(retrieval.hash_embeddings(docs, c.dim), asked, k)


def rankings(docs: DataFrame, queries: DataFrame, k: int, c: Retrieval = Retrieval()) -> dict[str, DataFrame]:
    """bm25, dense and hybrid-rrf: (query_id, rank, doc_id, score), from docs (doc_id, text) and queries (query_id, query)."""
    pool = max(c.pool, k)
    lexical = stash(retrieval.bm25(retrieval.index_for(docs, queries), queries, pool, c), "bm25")
    vectors = stash(embedded(docs, queries, pool, c), "dense")
    cut = lambda x: x.where(F.col("rank") <= k)
    return {"bm25": cut(lexical), "dense": cut(vectors), "hybrid-rrf": retrieval.fuse(lexical, vectors, k=k, rrf_k=c.rrf_k)}


def evaluate(docs: DataFrame, queries: DataFrame, gold: DataFrame, c: Retrieval = Retrieval()) -> DataFrame:
    """(backend, k, mean_recall, mean_ndcg) of the three rankings; gold is (query_id, doc_id)."""
    gold, out = stash(gold, "gold"), None
    for name, hits in rankings(docs, queries, max(c.k_values), c).items():
        means = evaluation.mean_scores(evaluation.query_scores(gold, hits, queries, c.k_values), name)
        out = means if out is None else out.unionByName(means)
    return out


def contained(docs: DataFrame, passages: DataFrame) -> DataFrame:
    """(query_id, doc_id) where a document contains a passage (query_id, query).

    Candidates share a hashed run of words: a passage's inner words (it may begin or end within a document's word), five of them or
    as many as it has. Passages of one or two words have no inner one; their first three characters are looked up instead. Only
    candidates are searched, whatever the number of passages. Empty passages are found nowhere.
    """
    words = lambda c: F.filter(F.split(c, r"\s+"), lambda w: w != "")
    inner = F.least(F.size("w") - 2, F.lit(RUN))
    whole = passages.where("query != ''").withColumn("w", words(F.col("query"))).withColumn("m", F.greatest(inner, F.lit(0)))
    gram = F.substring(F.col("query"), 1, GRAM)
    keyed = stash(whole.select("query_id", "query", "m", F.when(F.col("m") > 0, F.xxhash64(F.slice("w", F.lit(2), F.greatest("m", F.lit(1))))).otherwise(F.xxhash64(gram)).alias("key"), F.length(gram).alias("g")), "passages")
    sizes = keyed.select("m", F.when(F.col("m") == 0, F.col("g")).otherwise(0).alias("g")).distinct().collect()  # at most RUN + GRAM rows
    text = docs.select("doc_id", T.text_of(F.col("text")).alias("text"))
    split, near = text.select("doc_id", words(F.col("text")).alias("w")), None
    places = lambda n: F.sequence(F.lit(1), F.greatest(n, F.lit(1)))
    for m, g in sorted((r["m"], r["g"]) for r in sizes):
        if m:
            keys = split.select("doc_id", F.explode_outer(F.array_distinct(F.transform(places(F.size("w") - m + 1), lambda i: F.xxhash64(F.slice("w", i, m))))).alias("key"))
        else:
            keys = text.select("doc_id", F.explode_outer(F.array_distinct(F.transform(places(F.length("text") - g + 1), lambda i: F.xxhash64(F.substring("text", i, F.lit(g)))))).alias("key"))
        own = keyed.where((F.col("m") == m) & ((F.col("g") == g) if not m else F.lit(True))).select("query_id", "key")
        found = keys.join(F.broadcast(own) if own.count() <= retrieval.BROADCAST_ROWS else own, "key").select("doc_id", "query_id").distinct()
        near = found if near is None else near.unionByName(found)
    if near is None:
        return docs.sparkSession.createDataFrame([], ", ".join(f"{c} {x.schema[c].dataType.simpleString()}" for x, c in ((passages, "query_id"), (docs, "doc_id"))))
    pairs = stash(near.join(keyed.select("query_id", "query"), "query_id"), "near")
    return pairs.join(text, "doc_id").where(F.col("text").contains(F.col("query"))).select("query_id", "doc_id")


def generate(docs: DataFrame, queries: DataFrame, hits: DataFrame, base: evaluation.Generate | None = None, adapter: evaluation.Generate | None = None, c: Retrieval = Retrieval()) -> DataFrame:
    """Scored answers of both sides, one row a query and side: queries (query_id, query, gold_answer), docs (doc_id, source_id, text)."""
    found = hits.where(F.col("rank") <= c.top_k).select("query_id", "rank", "doc_id").join(docs, "doc_id").withColumn("chunk_id", F.col("doc_id").cast("string"))
    packed = evaluation.pack_context(found, c.context_chars)
    rows = queries.join(packed, "query_id", "left").withColumn("packed", F.coalesce("packed", F.lit("")))
    return evaluation.generation_scores(evaluation.answers(rows, base, adapter))
