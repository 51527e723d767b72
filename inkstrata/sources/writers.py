"""Writers: JSON lines, splits with a manifest, reports, indexes. Reports and manifests are small and written by Spark, too, so
that paths may be in any store."""

from __future__ import annotations

import json
from datetime import datetime, timezone

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import Selection
from ..operators.retrieval import Index, as_stored


def json_lines(rows: DataFrame, path: str) -> None:
    rows.write.mode("overwrite").option("ignoreNullFields", "false").json(path)


def report(spark: SparkSession, payload: dict, path: str) -> None:
    """One JSON document."""
    spark.createDataFrame([(json.dumps(payload, indent=2, ensure_ascii=False, default=str),)], "value string").coalesce(1).write.mode("overwrite").text(path)


def read_report(spark: SparkSession, path: str) -> dict:
    return json.loads("\n".join(r["value"] for r in spark.read.text(path, wholetext=True).collect()))


def now() -> str:
    return datetime.now(timezone.utc).strftime("%Y-%m-%dT%H:%M:%SZ")


def splits(chosen: DataFrame, folder: str, told: dict | None = None, c: Selection = Selection()) -> dict[str, str]:
    """train, val and test (by the column split) as folders of JSON lines, sorted by pair_id, a manifest and the report."""
    spark, paths = chosen.sparkSession, {}
    for name in ("train", "val", "test"):
        paths[name] = f"{folder}/{name}.jsonl"
        json_lines(chosen.where(F.col("split") == name).drop("split").orderBy("pair_id"), paths[name])
    paths["manifest"] = f"{folder}/manifest.json"
    fractions = {"train": c.train, "val": c.val, "test": c.test}
    told = None if told is None else told | {"created_utc": now()}
    report(spark, {
        "dataset_version": c.version, "seed": c.seed, "target_min": c.target_min, "target_max": c.target_max, "split_fractions": fractions,
        "files": {k: f"{k}.jsonl" for k in fractions}, "report": told or {},
    }, paths["manifest"])
    if told is not None:
        paths["report"] = f"{folder}/select_report.json"
        report(spark, told, paths["report"])
    return paths


def filter_report(decisions: DataFrame, path: str, most: int = 5_000) -> dict:
    """Counts of all decisions, and the first ``most`` of them (a feature of the report): by ord if there is one, else by pair_id."""
    n, kept = decisions.agg(F.count("*"), F.count_if("kept")).first()
    stages = {r["stage"]: r["n"] for r in decisions.where("not kept").groupBy("stage").agg(F.count("*").alias("n")).collect()}
    payload = {
        "n_in": n, "n_kept": kept, "n_dropped": n - kept, "dropped_by_stage": {s: stages.get(s, 0) for s in ("heuristic", "exact_dup", "near_dup", "llm_judge")},
        "decisions": [r.asDict(recursive=True) for r in decisions.orderBy(*[c for c in ("ord", "pair_id", "stage") if c in decisions.columns]).limit(most).collect()], "decisions_truncated": n > most,
    }
    report(decisions.sparkSession, payload, path)
    return payload


def comparison(compared: DataFrame, path: str, meta: dict | None = None) -> dict:
    """A compared panel as one document: n_items, dry_run (no base has answered), meta, rows by id. A panel has few rows."""
    rows = [r.asDict(recursive=True) for r in compared.orderBy("id").collect()]
    payload = {"n_items": len(rows), "dry_run": all(r["base_output"].startswith("[dry-run]") for r in rows), "meta": meta or {}, "rows": rows}
    report(compared.sparkSession, payload, path)
    return payload


def metrics(compared: DataFrame, scores: DataFrame, path: str, source: str = "memory", dry_run: bool = False) -> dict:
    """A panel's report as one document: counts, the means of both sides, and every item's scores."""
    from ..operators.evaluation import panel_means

    means = {r["side"]: {k: v for k, v in r.asDict().items() if k != "side"} for r in panel_means(scores).collect()}
    n, cited, refusals = compared.agg(F.count("*"), F.count_if(F.size("must_cite") > 0), F.count_if("refuse_if_missing")).first()
    items: dict[str, dict] = {r["id"]: r.asDict() for r in compared.select("id", "task", "theme", "refuse_if_missing", "notes").orderBy("id").collect()}
    for r in scores.collect():
        items[r["id"]][r["side"]] = {k: v for k, v in r.asDict().items() if k not in ("id", "side")}
    empty = dict.fromkeys(("token_f1_vs_context", "token_jaccard_vs_context", "citation_hit_rate", "refusal_accuracy"))
    payload = {
        "n_items": n, "n_citation_items": cited, "n_refusal_items": refusals, "dry_run": dry_run, "source": source,
        "aggregate": {s: means.get(s, empty) for s in ("base", "adapter")}, "items": list(items.values()),
    }
    report(compared.sparkSession, payload, path)
    return payload


def card_value(x: object, digits: int = 4) -> str:
    """A figure as a card shows it: TBD for nothing, floats to ``digits``, maps as k=v in the order of short keys first."""
    if x is None or x == {}:
        return "TBD"
    if isinstance(x, dict):
        return ", ".join(f"{k}={card_value(x[k], digits)}" for k in sorted(x, key=lambda k: (len(str(k)), str(k))))
    return f"{x:.{digits}f}" if isinstance(x, float) else str(x)


def index(found: Index, folder: str) -> None:
    """Postings are clustered by term, so a query's reads skip most of them."""
    found.postings.repartitionByRange("term").sortWithinPartitions("term", "doc_id").write.mode("overwrite").parquet(f"{folder}/postings")
    found.docs.write.mode("overwrite").parquet(f"{folder}/docs")
    found.df.write.mode("overwrite").parquet(f"{folder}/df")
    found.stats.write.mode("overwrite").parquet(f"{folder}/stats")


def read_index(spark: SparkSession, folder: str) -> Index:
    return Index(*[spark.read.parquet(f"{folder}/{n}") for n in ("postings", "docs", "df", "stats")])


def embeddings(vectors: DataFrame, path: str) -> None:
    """(doc_id, embedding) in single precision."""
    vectors.withColumn("embedding", F.col("embedding").cast("array<float>")).write.mode("overwrite").parquet(path)


def read_embeddings(spark: SparkSession, path: str) -> DataFrame | None:
    """None if there are none: a ranking may do without."""
    from pyspark.errors import AnalysisException

    try:
        rows = spark.read.parquet(path)
    except AnalysisException:
        return None
    return rows.withColumn("embedding", as_stored(F.col("embedding")))


def load_or_build(spark: SparkSession, path: str, build) -> DataFrame:
    """The table at ``path``; built and written first if it isn't there."""
    from pyspark.errors import AnalysisException

    try:
        return spark.read.parquet(path)
    except AnalysisException:
        build().write.parquet(path)
        return spark.read.parquet(path)
