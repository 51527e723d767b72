"""The research panel: compare two models on its items, store the comparison, score it, look items up by label.

A panel has few rows (a page of questions), so a stored comparison or report is one JSON document.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import evaluation
from ..sources import readers, writers

COMPARED = f"{readers.PANEL}, base_output string, adapter_output string, base_citation_hits array<string>, adapter_citation_hits array<string>, notes string"
# Fixed value: what is asked if there is no item at all.
NO_ITEMS = "No panel examples found."


def compare(spark: SparkSession, panel: str, out: str, base: evaluation.Generate | None = None, adapter: evaluation.Generate | None = None, meta: dict | None = None) -> dict:
    """Reads a panel, compares, writes the comparison; gives n_items, out_path, dry_run and the sorted themes."""
    compared = evaluation.compare_panel(readers.read(spark, panel, "panel"), base, adapter)
    told = writers.comparison(compared, out, meta)
    return {"n_items": told["n_items"], "out_path": out, "dry_run": base is None and adapter is None, "themes": sorted({r["theme"] for r in told["rows"]})}


def read_comparison(spark: SparkSession, path: str) -> DataFrame:
    """The rows of a stored comparison; missing fields get defaults."""
    rows = spark.read.schema(f"rows array<struct<{', '.join(f'{n}:{t}' for n, t in (x.rsplit(' ', 1) for x in COMPARED.split(', ')))}>>").option("multiLine", True).json(path)
    wide = rows.select(F.explode("rows").alias("r")).select("r.*")
    return readers.with_defaults(wide, "comparison")


def score(spark: SparkSession, comparison: str, out: str) -> dict:
    """Scores a stored comparison and writes the report: counts, means of both sides, items."""
    told = writers.read_report(spark, comparison)
    rows = read_comparison(spark, comparison)
    payload = writers.metrics(rows, evaluation.panel_scores(rows), out, comparison, bool(told.get("dry_run", False)))
    return {"n_items": payload["n_items"], "dry_run": payload["dry_run"], "out_path": out, "aggregate": payload["aggregate"]}


def label() -> Column:
    return F.concat_ws(" · ", "id", "ticker", "theme")


def by_label(asked: DataFrame, panel: DataFrame) -> DataFrame:
    """(asked_id, prompt) for asked (asked_id, label, question, asked_context): the prompt of the panel's item with the label, or else of its first.

    A question of one's own takes the place of the item's, as does a context if there is one. panel has ``ord``, the items' order; of items
    that share a label the last counts.
    """
    w = Window.partitionBy("label").orderBy(F.desc("ord"))
    last = panel.withColumn("label", label()).withColumn("_n", F.row_number().over(w)).where("_n = 1")
    item = F.struct("ticker", "theme", "context", "prompt").alias("item")
    found = asked.join(last.select("label", item), "label", "left")
    first = panel.orderBy("ord").limit(1).select(F.struct("ticker", "theme", "context", "prompt").alias("spare"))
    rows = found.join(F.broadcast(first), how="left").withColumn("i", F.coalesce("item", "spare"))  # one row
    own = T.strip(T.text_of(F.col("question")))
    context = F.coalesce(F.nullif(T.strip(T.text_of(F.col("asked_context"))), F.lit("")), F.col("i.context"), F.lit(""))
    custom = evaluation.prompt(F.coalesce("i.ticker", F.lit("CUSTOM")), F.coalesce("i.theme", F.lit("custom")), context, own)
    return rows.select("asked_id", F.when(own != "", custom).when(F.col("i").isNotNull(), evaluation.prompt(F.col("i.ticker"), F.col("i.theme"), F.col("i.context"), F.col("i.prompt"))).otherwise(F.lit(NO_ITEMS)).alias("prompt"))
