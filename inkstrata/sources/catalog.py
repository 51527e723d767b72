"""The catalog of public sources, their offline samples, and loading with a fallback to these."""

from __future__ import annotations

from collections.abc import Callable, Iterable

from pyspark.sql import DataFrame, SparkSession

from .readers import ingest

# The sources, their text fields in order, and how many rows of each are taken.
SOURCES = (
    ("earnings_transcripts", "S&P 500 earnings call transcripts", "primary grounding corpus (prepared remarks + Q&A)", ("transcript", "content", "text"),
     "MIT on the HF card; still public-company disclosures only.", 400),
    ("fiqa", "FiQA financial QA", "seed research-style question distribution", ("question", "answer", "text"),
     "Academic / task release; check the HF card before redistribution.", 200),
    ("finance_alpaca", "Finance-Alpaca / Wealth-Alpaca", "instruction-style finance pairs (style prior only)", ("instruction", "input", "output", "text"),
     "Derived Alpaca + FiQA mix; treat as public research sample.", 150),
)
DEFAULT_CAP = 50
LICENSE_CLOSING = "Public data only. Do not mix paid terminal extracts."

# Offline samples (source, row).
SAMPLES = (
    ("earnings_transcripts", {
        "source_id": "earnings_transcripts", "ticker": "AAPL", "period": "FY2024-Q1", "section": "prepared_remarks",
        "text": "Thank you for joining Apple's first quarter fiscal 2024 results. We set an all-time revenue record of $119.6 billion, up 2 percent year over year, "
                "driven by iPhone and Services."}),
    ("earnings_transcripts", {
        "source_id": "earnings_transcripts", "ticker": "MSFT", "period": "FY2024-Q2", "section": "qa",
        "text": "Analyst: Can you talk about Azure growth excluding the impact of the extra calendar day? CEO: Azure grew 30 percent, and 28 percent constant currency, "
                "with AI services contributing several points."}),
    ("fiqa", {
        "source_id": "fiqa", "question": "What does a beat versus a miss mean on an earnings call?",
        "answer": "A beat means reported EPS or revenue exceeded the consensus estimate; a miss means results came in below that estimate."}),
    ("finance_alpaca", {
        "source_id": "finance_alpaca", "instruction": "Explain prepared remarks versus the Q&A portion of an earnings call.", "input": "",
        "output": "Prepared remarks are a scripted management overview of results and outlook. Q&A is unscripted analyst questioning and is usually richer for research."}),
)
# Source, public id in the store, homepage, notes; all of them read this split.
ORIGINS = {
    "earnings_transcripts": ("kurry/sp500_earnings_transcripts", "https://huggingface.co/datasets/kurry/sp500_earnings_transcripts", "Large corpus. Always stream + cap with max_samples."),
    "fiqa": ("LLukas22/fiqa", "https://sites.google.com/view/fiqa/", "Question style prior; not grounded transcripts."),
    "finance_alpaca": ("gbharti/finance-alpaca", "https://huggingface.co/datasets/gbharti/finance-alpaca", "Style prior only; keep capped."),
}
DEFAULT_SPLIT = "train"
CATALOG = "source_id string, display_name string, role string, text_fields array<string>, license_note string, cap int, hf_id string, hf_config string, homepage string, notes string, default_split string"
#: What an error says when a store limits requests.
LIMIT_CUES = ("429", "rate limit", "ratelimited", "too many requests")

Reader = Callable[[SparkSession, str], DataFrame]


def catalog(spark: SparkSession) -> DataFrame:
    rows = []
    for s, n, r, f, lic, cap in SOURCES:
        stored, homepage, notes = ORIGINS[s]
        rows.append((s, n, r, list(f), lic, cap, stored, None, homepage, notes, DEFAULT_SPLIT))
    return spark.createDataFrame(rows, CATALOG)


def source(source_id: str) -> tuple:
    for s in SOURCES:
        if s[0] == source_id:
            return s
    raise KeyError(f"unknown source {source_id!r}; known: {', '.join(s[0] for s in SOURCES)}")


def license_notes() -> list[str]:
    return [*(f"{s[0]}: {s[4]}" for s in SOURCES), LICENSE_CLOSING]


def offline(spark: SparkSession, source_id: str, most: int) -> DataFrame:
    """The first ``most`` samples as records; metadata is every field but ``text``."""
    fields = source(source_id)[3]
    rows = [r for s, r in SAMPLES if s == source_id][:most]
    names = list(dict.fromkeys(k for r in rows for k in r))
    if not rows:
        return spark.createDataFrame([], "source_id string, text string, metadata map<string,string>, pos long")
    wide = spark.createDataFrame([(k, *[r.get(n) for n in names]) for k, r in enumerate(rows)], ", ".join(["_pos long", *[f"{n} string" for n in names]]))
    from pyspark.sql import functions as F

    from ..functions import text as T

    known = [n for n in fields if n in names]
    meta = [n for n in names if n != "text"]
    text = T.coalesce_text([F.col(n) for n in known], [F.col(n) for n in names])
    values = F.map_filter(F.create_map(*[x for n in meta for x in (F.lit(n), F.col(n))]), lambda _, v: v.isNotNull())
    return wide.select(F.lit(source_id).alias("source_id"), text.alias("text"), values.alias("metadata"), F.col("_pos").alias("pos")).where("text != ''")


def is_limit(e: BaseException) -> bool:
    told = f"{type(e).__name__} {e}".lower()
    return any(c in told for c in LIMIT_CUES)


def load(spark: SparkSession, source_id: str, most: int = 3, reader: Reader | None = None, auto: bool = False) -> DataFrame:
    """Records of a source: offline samples without a ``reader``, else what it gives (with a column pos for the order).

    If reading fails because of a limit on requests, or for any reason with ``auto``, the samples stand in.
    """
    if most < 1:
        raise ValueError("most must be 1 or more")
    if reader is None:
        return offline(spark, source_id, most)
    try:
        rows = reader(spark, source_id)
        fields = [f for f in source(source_id)[3] if f in rows.columns]
        return ingest(rows, fields, source_id, most, "pos")
    except KeyError:
        raise
    except Exception as e:
        if auto or is_limit(e):
            return offline(spark, source_id, most)
        raise


def load_all(spark: SparkSession, ids: Iterable[str] | None = None, most: int | None = None, caps: dict[str, int] | None = None, reader: Reader | None = None, auto: bool = False) -> DataFrame:
    """All sources one after the other, each up to its cap (or ``most`` for all); pos counts on across them."""
    from pyspark.sql import functions as F

    ids = list(ids) if ids is not None else [s[0] for s in SOURCES]
    own = {s[0]: s[5] for s in SOURCES} | (caps or {})
    out = None
    for k, s in enumerate(ids):
        rows = load(spark, s, most if most is not None else own.get(s, DEFAULT_CAP), reader, auto).withColumn("pos", F.col("pos").cast("long") + F.lit(k << 40))
        out = rows if out is None else out.unionByName(rows)
    return out if out is not None else spark.createDataFrame([], "source_id string, text string, metadata map<string,string>, pos long")
