"""Readers. Missing fields get defaults; schemas are given, never inferred."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text as T

PROPOSITIONS = "array<struct<text:string,source_sentence_index:int,score:double>>"
CHUNK = f"chunk_id string, source_id string, section string, text string, start_sentence int, end_sentence int, propositions {PROPOSITIONS}, metadata map<string,string>"
CORPUS = "chunk_id string, source_id string, section string, text string, start_sentence int, end_sentence int, metadata map<string,string>"
PAIR = "pair_id string, chunk_id string, source_id string, task string, instruction string, context string, output string, citations array<string>, metadata map<string,string>"
EVAL = "query_id string, query string, gold_chunk_ids array<string>, gold_answer string, source string, pair_id string, task string, source_id string, metadata map<string,string>"
PANEL = "id string, task string, ticker string, theme string, prompt string, context string, must_cite array<string>, refuse_if_missing boolean"

# What stands for a missing or empty field. None: an empty field stays as it is, but never null.
DEFAULTS = {
    "chunk": {"chunk_id": "unknown", "source_id": "unknown", "section": "unknown"},
    "corpus": {"source_id": "unknown", "section": "unknown"},
    "pair": {"pair_id": "unknown", "task": "qa"},
    "eval": {"source": "grounded_pair", "task": "qa", "source_id": "unknown"},
    "panel": {"task": "qa"},
    "comparison": {},
}
#: Without these a row is an error.
REQUIRED = {"corpus": ("chunk_id",), "eval": ("query_id", "query"), "panel": ("id", "prompt")}
SCHEMAS = {"chunk": CHUNK, "corpus": CORPUS, "pair": PAIR, "eval": EVAL, "panel": PANEL}
NULLABLE = {"eval": ("gold_answer", "pair_id")}


def json_lines(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Blank lines are passed over."""
    return spark.read.schema(schema).option("mode", "FAILFAST").json(path)


def with_defaults(rows: DataFrame, kind: str) -> DataFrame:
    """Every field not null: given defaults for null or empty strings, else '', 0, false, empty arrays and maps."""
    own, free = DEFAULTS.get(kind, {}), NULLABLE.get(kind, ())

    def filled(name: str, dtype: str) -> Column:
        c = F.col(name)
        if name in free:
            return c
        if name in REQUIRED.get(kind, ()):
            return F.when(c.isNull(), F.raise_error(F.lit(f"{kind}: {name} is missing"))).otherwise(c)
        if dtype == "string":
            return F.coalesce(F.nullif(c, F.lit("")), F.lit(own.get(name, "")))
        empty = {"int": F.lit(0), "boolean": F.lit(False)}.get(dtype)
        if empty is None:
            empty = F.create_map().cast(dtype) if dtype.startswith("map") else F.array().cast(dtype)
        return F.coalesce(c, empty)

    return rows.select(*[filled(n, t).alias(n) for n, t in rows.dtypes])


def read(spark: SparkSession, path: str, kind: str) -> DataFrame:
    """chunk, corpus, pair, eval or panel rows from JSON lines."""
    return with_defaults(json_lines(spark, path, SCHEMAS[kind]), kind)


def train_ids(spark: SparkSession, folder: str | None) -> DataFrame:
    """(pair_id) of a dataset's training split; none if there is no folder or no such file."""
    from pyspark.errors import AnalysisException

    none = spark.createDataFrame([], "pair_id string")
    if folder is None:
        return none
    try:
        return read(spark, f"{folder}/train.jsonl", "pair").where("pair_id != ''").select("pair_id").distinct()
    except AnalysisException:
        return none


def capped(rows: DataFrame, caps: dict[str, int] | int, default: int = 50, source: str = "source_id", order: str = "pos") -> DataFrame:
    """The first rows of each source, by its own cap or one for all. Spark applies the row number before it shuffles."""
    w = Window.partitionBy(source).orderBy(order)
    numbered = rows.withColumn("_n", F.row_number().over(w))
    if isinstance(caps, int):
        return numbered.where(F.col("_n") <= caps).drop("_n")
    if not caps:
        return numbered.where(F.col("_n") <= default).drop("_n")
    own = F.create_map(*[x for s, n in caps.items() for x in (F.lit(s), F.lit(n))])
    most = max(default, *caps.values())
    return numbered.where(F.col("_n") <= most).where(F.col("_n") <= F.coalesce(F.try_element_at(own, F.col(source)), F.lit(default))).drop("_n")


def ingest(rows: DataFrame, text_fields: list[str], source_id: str, most: int, order: str, max_chars: int | None = 12_000) -> DataFrame:
    """Records (source_id, text, metadata, pos) from a wide table: text fields are joined, blank rows passed over, long texts cut
    (None: whole), the first ``most`` kept in order; other flat columns become metadata."""
    if most < 1:
        raise ValueError("most must be 1 or more")
    flat = [n for n, t in rows.dtypes if n not in text_fields and not t.startswith(("array", "map", "struct"))]
    text = T.coalesce_text([F.col(n) for n in text_fields], [F.col(n) for n, t in rows.dtypes if t == "string"])
    if max_chars is not None:
        text = F.substring(text, 1, max_chars)
    meta = F.create_map(*[x for n in flat for x in (F.lit(n), F.col(n).cast("string"))]) if flat else F.create_map().cast("map<string,string>")
    found = rows.select(F.lit(source_id).alias("source_id"), text.alias("text"), F.map_filter(meta, lambda _, v: v.isNotNull()).alias("metadata"), F.col(order).alias("pos"))
    return found.where("text != ''").orderBy("pos").limit(most)
