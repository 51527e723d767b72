"""BM25 over postings, hashed and given embeddings, reciprocal rank fusion.

Queries are (query_id, query), documents (doc_id, text). Rankings order by the score rounded to 9 digits, then by id: sums
made in another order differ in their last digits, and equal documents must tie.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass
from functools import partial

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..config import Retrieval
from ..functions import text as T
from ..session import new_path, remove_at_end, stash

#: Queries or terms are broadcast up to this many rows; beyond it they are shuffled, or taken in blocks.
BROADCAST_ROWS = 200_000
QUERY_BLOCK = 4_096
#: (document, query) pairs that a task of the scoring step sums up at most, if all match; and its tasks at most.
PAIRS_A_TASK, MOST_TASKS = 500_000, 20_000
#: Documents that a task holds while it reads stored queries.
DOCUMENTS_HELD = 50_000


@dataclass
class Index:
    """postings (doc_id, len, term, tf), docs (doc_id, len), df (term, df), stats (one row: n, avgdl).

    Postings know their document's length, so scoring needs no join with the documents.
    """

    postings: DataFrame
    docs: DataFrame
    df: DataFrame
    stats: DataFrame


def build_index(docs: DataFrame) -> Index:
    """Documents without a token count in n and avgdl, too."""
    return _index(_tokens(docs).withColumn("hit", F.col("term").isNotNull()))


def index_for(docs: DataFrame, queries: DataFrame) -> Index:
    """An index of the queries' terms only: other tokens end in the scan's own stage."""
    terms = query_terms(queries).select("term").distinct().withColumn("hit", F.lit(True))
    return _index(_tokens(docs).join(_small(terms), "term", "left").withColumn("hit", F.coalesce("hit", F.lit(False))).where("hit or head"))


def _counted(docs: DataFrame) -> DataFrame:
    return docs.select("doc_id", T.search_tokens(F.col("text")).alias("tokens")).withColumn("len", F.size("tokens").cast("long"))


def _tokens(docs: DataFrame) -> DataFrame:
    """A row a token, the first of each document marked as its head; one row without a term for a document without tokens."""
    return _counted(docs).select("doc_id", "len", F.posexplode_outer("tokens").alias("at", "term")).select("doc_id", "len", "term", (F.coalesce("at", F.lit(0)) == 0).alias("head"))


def _exploded(rows: DataFrame, *keep: str) -> DataFrame:
    """A row a token. From a plain explode the optimizer infers a filter on the array's size and so computes the array twice."""
    return rows.select(*keep, F.explode_outer("tokens").alias("term")).where("term is not null")


def _index(tokens: DataFrame) -> Index:
    """Documents are read once: counts, combined before they are shuffled, are written, and all else is computed from them.

    A document's head keeps the document known, also if none of its tokens is a hit.
    """
    term = F.when(F.col("hit"), F.col("term")).alias("term")
    counts = stash(tokens.groupBy("doc_id", "len", term).agg(F.count_if("hit").alias("tf"), F.bool_or("head").alias("head")), "postings")
    postings, lens = counts.where("term is not null").select("doc_id", "len", "term", "tf"), counts.where("head").select("doc_id", "len")
    return Index(postings, lens, postings.groupBy("term").agg(F.count("*").alias("df")), stats(lens))


def stats(lens: DataFrame) -> DataFrame:
    return lens.agg(F.count("*").alias("n"), F.coalesce(F.avg("len"), F.lit(0.0)).alias("avgdl"))


def query_terms(queries: DataFrame) -> DataFrame:
    """(query_id, term, qtf): a repeated term counts again."""
    return _exploded(queries.select("query_id", T.search_tokens(F.col("query")).alias("tokens")), "query_id").groupBy("query_id", "term").agg(F.count("*").alias("qtf"))


def _small(df: DataFrame) -> DataFrame:
    return F.broadcast(df) if df.count() <= BROADCAST_ROWS else df


def ranked(scores: DataFrame, k: int) -> DataFrame:
    """Adds rank and keeps those up to k; Spark cuts each task's rows to k before the shuffle."""
    w = Window.partitionBy("query_id").orderBy(F.round("score", 9).desc(), "doc_id")
    return scores.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def bm25_scores(index: Index, queries: DataFrame, c: Retrieval = Retrieval()) -> DataFrame:
    """(query_id, doc_id, score) of documents that have a term of the query; all scores are positive."""
    idf = F.log(1 + (F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    weighted = query_terms(queries).join(index.df, "term").crossJoin(F.broadcast(index.stats)).select("query_id", "term", "avgdl", (F.col("qtf") * idf).alias("w"))
    norm = c.k1 * (1 - c.b + c.b * F.greatest("len", F.lit(1)) / F.greatest("avgdl", F.lit(1e-9)))
    part = F.col("w") * (F.col("tf") * (c.k1 + 1) / (F.col("tf") + norm))
    # Dealt by document once, so a document's scores for all queries, and their ranks within a task, need no other shuffle. Postings are small
    # and the pairs that they make are many, so the number of tasks follows the pairs; it is a given number, which Spark doesn't lessen.
    pairs = index.docs.count() * queries.count()
    tasks = min(MOST_TASKS, max(index.docs.sparkSession.sparkContext.defaultParallelism, -(-pairs // PAIRS_A_TASK)))
    return index.postings.repartition(tasks, "doc_id").join(_small(weighted), "term").groupBy("doc_id", "query_id").agg(F.sum(part).alias("score"))


def bm25(index: Index, queries: DataFrame, k: int = 10, c: Retrieval = Retrieval(), pad: bool = True) -> DataFrame:
    """(query_id, rank, doc_id, score). With ``pad``, queries with fewer than k matches get the least other ids, score 0.

    Such a query has under k matches, so the 2 k least ids hold enough others.
    """
    hits = ranked(bm25_scores(index, queries, c), k).select("query_id", "doc_id", "score", "rank")
    if not pad:
        return hits
    hits = stash(hits, "hits")  # k rows a query, used three times
    short = queries.select("query_id").join(hits.groupBy("query_id").agg(F.count("*").alias("n")), "query_id", "left").withColumn("n", F.coalesce("n", F.lit(0))).where(F.col("n") < k)
    least = index.docs.select("doc_id").orderBy("doc_id").limit(2 * k)
    spare = short.crossJoin(F.broadcast(least)).join(hits.select("query_id", "doc_id"), ["query_id", "doc_id"], "left_anti")  # at most 2 k rows a query
    w = Window.partitionBy("query_id").orderBy("doc_id")
    more = spare.withColumn("rank", (F.col("n") + F.row_number().over(w)).cast("int")).where(F.col("rank") <= k)
    return hits.unionByName(more.select("query_id", "doc_id", F.lit(0.0).alias("score"), "rank"))


def hash_weights(docs: DataFrame, dim: int = 128) -> DataFrame:
    """(doc_id, idx, weight): the non-zero places of hashed, normalised embeddings. Each distinct token of a document is hashed once."""
    terms = _exploded(_counted(docs), "doc_id").groupBy("doc_id", "term").agg(F.count("*").alias("tf"))
    index, sign = T.hash_place(F.col("term"), dim)
    sums = terms.groupBy("doc_id", index.alias("idx")).agg(F.sum(F.col("tf") * sign).alias("w")).where("w != 0")
    norm = F.sqrt(F.sum(F.col("w") * F.col("w")).over(Window.partitionBy("doc_id")))
    return sums.select("doc_id", "idx", (F.col("w") / norm).alias("weight"))


def hash_embeddings(docs: DataFrame, dim: int = 128) -> DataFrame:
    """(doc_id, embedding array<double>); all zero without tokens. What hash_weights gives, within a row: no token is shuffled."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    return _counted(docs).select("doc_id", "tokens").mapInArrow(partial(_hashed, dim=dim), f"doc_id {kind}, embedding array<double>")


def _hashed(batches: Iterator[pa.RecordBatch], dim: int) -> Iterator[pa.RecordBatch]:
    """Each different token of a batch is hashed once; sums of signs are whole numbers, so their order doesn't matter."""
    for batch in batches:
        listed = batch.column("tokens")
        words, rows = listed.flatten().dictionary_encode(), len(listed)
        digests = [hashlib.sha256(w.encode()).digest() for w in words.dictionary.to_pylist()]
        index = np.array([int.from_bytes(x[:4], "little") % dim for x in digests], dtype=np.int64)
        sign = np.array([1.0 if x[4] % 2 == 0 else -1.0 for x in digests])
        code, row = words.indices.to_numpy(zero_copy_only=False), np.repeat(np.arange(rows), np.diff(listed.offsets.to_numpy()))
        out = np.bincount(row * dim + index[code], sign[code], rows * dim).reshape(rows, dim) if len(code) else np.zeros((rows, dim))
        norm = np.sqrt((out * out).sum(axis=1, keepdims=True))
        vectors = pa.ListArray.from_arrays(pa.array(np.arange(rows + 1, dtype=np.int32) * dim), pa.array((out / np.where(norm == 0, 1, norm)).ravel()))
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), vectors], ["doc_id", "embedding"])


def as_stored(embedding: Column) -> Column:
    """What is left of an embedding after it was stored in single precision."""
    return F.transform(embedding.cast("array<float>"), lambda x: x.cast("double"))


def _matrix(vectors: list, dim: int) -> np.ndarray:
    out = np.zeros((len(vectors), dim))
    for r, e in enumerate(vectors):
        n = min(len(e), dim) if e is not None else 0
        out[r, :n] = e[:n] if n else 0
    return out


def _best(docs: np.ndarray, data: list, ids: list, matrix: np.ndarray, k: int) -> Iterator[pd.DataFrame]:
    """The k best of some documents for each query: a matrix product, and a sort of what can be among the best."""
    scores = _matrix(data, matrix.shape[1]) @ matrix.T
    rounded = np.round(scores, 9)
    for q, name in enumerate(ids):
        best = np.lexsort((docs, -rounded[:, q]))[:k]
        yield pd.DataFrame({"query_id": [name] * len(best), "doc_id": docs[best], "score": scores[best, q]})


def _blocks(path: str, size: int) -> Iterator[tuple[list, np.ndarray]]:
    """(ids, matrix) of stored queries, ``size`` at a time."""
    import pyarrow.dataset as ds
    from pyarrow import fs

    store, folder = fs.FileSystem.from_uri(path)
    for batch in ds.dataset(folder, filesystem=store, format="parquet", exclude_invalid_files=True).to_batches(columns=["query_id", "embedding"], batch_size=size):
        vectors = batch.column("embedding").to_pylist()
        if len(vectors):
            yield batch.column("query_id").to_pylist(), _matrix(vectors, max(1, *(len(e) for e in vectors)))


def _task_top(frames: Iterator[pd.DataFrame], ids: list, matrix: np.ndarray | None, path: str | None, size: int, k: int) -> Iterator[pd.DataFrame]:
    """Documents are held up to DOCUMENTS_HELD; stored queries are then read once for all of these."""
    held: list[pd.DataFrame] = []

    def flush() -> Iterator[pd.DataFrame]:
        frame = pd.concat(held, ignore_index=True)
        for names, m in [(ids, matrix)] if path is None else _blocks(path, size):
            yield from _best(frame["doc_id"].to_numpy(), frame["embedding"].tolist(), names, m, k)

    for frame in frames:
        if len(frame):
            held.append(frame)
        if held and sum(map(len, held)) >= (DOCUMENTS_HELD if path else 1):
            yield from flush()
            held = []
    if held:
        yield from flush()


def dense(vectors: DataFrame, queries: DataFrame, k: int = 10) -> DataFrame:
    """(query_id, rank, doc_id, score) by the dot product, from (doc_id, embedding) and (query_id, embedding).

    The vectors are read once. Up to QUERY_BLOCK queries go to the tasks with the plan; more are stored in the shared folder, from which
    each task reads them in blocks. Every task sends k rows a query at most for the documents that it holds at once.
    """
    spark = vectors.sparkSession
    kinds = f"query_id {queries.schema['query_id'].dataType.simpleString()}, doc_id {vectors.schema['doc_id'].dataType.simpleString()}, score double"
    own = queries.select("query_id", "embedding")
    few, path, ids, matrix = own.limit(QUERY_BLOCK + 1).collect(), None, [], None
    if len(few) > QUERY_BLOCK:
        path = new_path(spark, "queries")
        own.write.parquet(path)
        remove_at_end(spark, path)
    else:
        ids, matrix = [r["query_id"] for r in few], _matrix([r["embedding"] for r in few], max((len(r["embedding"]) for r in few), default=1))
    top = vectors.select("doc_id", "embedding").mapInPandas(partial(_task_top, ids=ids, matrix=matrix, path=path, size=QUERY_BLOCK, k=k), kinds)
    return ranked(top, k)


def fuse(*lists: DataFrame, k: int = 10, rrf_k: int = 60) -> DataFrame:
    """(query_id, rank, doc_id, score) by the sum of 1 / (rrf_k + rank) over the lists."""
    parts = [x.select("query_id", "doc_id", T.rrf(F.col("rank"), rrf_k).alias("s")) for x in lists]
    every = parts[0]
    for p in parts[1:]:
        every = every.unionByName(p)
    return ranked(every.groupBy("query_id", "doc_id").agg(F.sum("s").alias("score")), k)


def hybrid(first: DataFrame | None, second: DataFrame | None, k: int = 10, rrf_k: int = 60) -> DataFrame | None:
    """Fuses two rankings; a single one is cut to k; none gives None."""
    lists = [x for x in (first, second) if x is not None]
    if not lists:
        return None
    return fuse(*lists, k=k, rrf_k=rrf_k) if len(lists) > 1 else lists[0].where(F.col("rank") <= k)
