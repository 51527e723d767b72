"""Documents to sections, sections to sentence windows, windows to propositions. All within a row: no shuffle."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import Chunking
from ..functions import text as T


def sections(docs: DataFrame, text: str = "text", told: str | None = None) -> DataFrame:
    """Adds parts, array<struct<section, body>>: heading lines start a section and are removed; blank sections are dropped.

    Without a heading line the whole text is one section, as it is. Steps are columns of their own, so that Spark computes each
    once (an expression that is used inside a lambda is evaluated for every element).
    """
    lines = docs.withColumn("_text", T.text_of(F.col(text))).withColumn("_lines", F.split("_text", T.LINE_BREAK, -1)).withColumn("_low", F.lower("_text"))
    named = lines.withColumn("_names", F.transform(F.transform("_lines", T.strip), T.heading)).withColumn("_first", T.detect_section(F.col("_text"), F.col(told) if told else None, F.col("_low")))
    at = F.filter(F.transform("_names", lambda n, i: F.when(n.isNotNull(), i)), lambda i: i.isNotNull())
    placed = named.withColumn("_starts", F.concat(F.array(F.lit(-1)), at))

    def block(start: Column, k: Column) -> Column:
        end = F.coalesce(F.get("_starts", k + 1), F.size("_lines"))
        body = F.array_join(F.slice("_lines", start + 2, F.greatest(end - start - 1, F.lit(0))), "\n")
        return F.struct(F.when(start < 0, F.col("_first")).otherwise(F.get("_names", start)).alias("section"), body.alias("body"))

    blocks = F.transform(F.transform("_starts", block), lambda x: F.struct(x["section"].alias("section"), T.strip(x["body"]).alias("body")))
    whole = F.array(F.struct(F.col("_first").alias("section"), F.col("_text").alias("body")))
    parts = F.when(F.size("_starts") == 1, whole).otherwise(F.filter(blocks, lambda x: x["body"] != ""))
    return placed.withColumn("parts", parts).drop("_text", "_lines", "_low", "_names", "_first", "_starts")


def starts(n: Column, c: Chunking = Chunking()) -> Column:
    """Where the windows over n sentences start; the last is the first that reaches the end."""
    last = F.greatest(F.ceil((n - c.window) / c.stride), F.lit(0)).cast("int") * c.stride
    return F.when(n > 0, F.sequence(F.lit(0), last, F.lit(c.stride))).otherwise(F.array().cast("array<int>"))


def rated(sents: Column) -> Column:
    """array<struct<minus, text>> of sentences: the score with its sign turned, and the proposition's text."""
    both = F.transform(F.transform(sents, T.without_speaker), lambda own: F.struct(own.alias("own"), F.lower(own).alias("low")))
    return F.transform(both, lambda x: F.struct((-T.own_score(x["own"], x["low"])).alias("minus"), T.own_text(x["own"]).alias("text")))


def best(rates: Column, most: int = 8, min_score: float = 0.45) -> Column:
    """array<struct<text, source_sentence_index, score>>: the best-rated of a window; the index counts within it."""
    numbered = F.transform(rates, lambda x, i: F.struct(x["minus"].alias("minus"), i.alias("i"), x["text"].alias("text")))
    good = F.slice(F.sort_array(F.filter(numbered, lambda x: -x["minus"] >= min_score)), 1, most)
    return F.transform(good, lambda x: F.struct(x["text"].alias("text"), x["i"].alias("source_sentence_index"), F.round(-x["minus"], 3).alias("score")))


def split_sections(docs: DataFrame, text: str = "text", told: str | None = None) -> DataFrame:
    """One row a section: the columns of ``docs`` but for the text, block (from 0), section, body."""
    rest = [c for c in docs.columns if c != text]
    return sections(docs, text, told).select(*rest, F.posexplode_outer("parts").alias("block", "s")).where("s is not null").select(*rest, "block", "s.*")


def chunk(docs: DataFrame, c: Chunking = Chunking(), told: str | None = None) -> DataFrame:
    """Chunks of records (source_id, text, pos, ...): pos, block, chunk_id, source_id, section, text, start_sentence,
    end_sentence, propositions. (pos, block, start_sentence) is their order.

    If there is a column metadata (map<string,string>), its section wins over what the text says, and it is kept with the chunk's.
    Sentences are found and rated once a section; windows are slices of these, and have no white space to squeeze again. (From a plain explode the optimizer infers a filter
    on the array's size and so computes the array twice.)
    """
    meta = ["metadata"] if "metadata" in docs.columns else []
    if meta and told is None:
        docs, told = docs.withColumn("_told", F.try_element_at("metadata", F.lit("section"))), "_told"
    parts = split_sections(docs.select("pos", "source_id", "text", *meta, *([told] if told else [])), told=told)
    rows = parts.withColumn("sents", T.sentences(F.col("body"))).withColumn("rates", rated(F.col("sents"))).withColumn("starts", starts(F.size("sents"), c))
    window = F.transform("starts", lambda i: F.struct(i.alias("start"), F.slice("sents", i + 1, F.lit(c.window)).alias("own"), F.slice("rates", i + 1, F.lit(c.window)).alias("rates")))
    wide = rows.select("pos", "source_id", "block", "section", *meta, F.explode_outer(window).alias("w")).where("w is not null")
    wide = wide.withColumn("line", F.array_join("w.own", " ")).where(F.length("line") >= c.min_chars)
    cut = F.when(F.length("line") > c.max_chars, F.regexp_replace(F.substring("line", 1, c.max_chars), r" [^ ]*\z", "")).otherwise(F.col("line"))
    wide = wide.withColumn("text", cut).withColumn("start_sentence", F.col("w.start")).withColumn("end_sentence", F.col("w.start") + F.size("w.own") - 1)
    return wide.select(
        "pos", "block", T.chunk_id(F.col("source_id"), F.col("section"), F.col("start_sentence"), F.col("end_sentence"), F.col("text")).alias("chunk_id"), "source_id", "section",
        "text", "start_sentence", "end_sentence", best(F.col("w.rates"), c.max_propositions, c.min_score).alias("propositions"),
        *[F.map_concat(F.map_filter(m, lambda k, _: ~k.isin("text", "section")), F.create_map(F.lit("section"), F.col("section"))).alias(m) for m in meta],
    )


def counts(chunks: DataFrame) -> DataFrame:
    """One row: n_records (that have a chunk), n_chunks, n_propositions."""
    return chunks.agg(F.count_distinct("pos").alias("n_records"), F.count("*").alias("n_chunks"), F.coalesce(F.sum(F.size("propositions")), F.lit(0)).cast("long").alias("n_propositions"))


def records(docs: DataFrame, source: str = "source", order: str = "doc_id") -> DataFrame:
    """A table of documents as records."""
    return docs.select(F.coalesce(F.nullif(F.col(source), F.lit("")), F.lit("unknown")).alias("source_id"), T.text_of(F.col("text")).alias("text"), F.col(order).alias("pos"))
