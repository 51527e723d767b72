"""Citation-grounded instruction pairs from chunks, by templates; an optional model rewrites the drafts."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import Pairing
from ..functions import text as T

# The templates that results depend on.
QA_TEMPLATES = (
    "What did management report in this {section} excerpt?",
    "Which quantitative results are stated in the {section} passage?",
    "Summarize the factual claims supported by this {section} excerpt.",
    "According to this {section} excerpt, what happened to the key metrics?",
)
SUMMARY_TEMPLATE = "Write a short research note grounded only in this {section} excerpt."
LEADS = {"qa": "From the {section} excerpt, the supported facts are:", "summary": "Research note from the {section} excerpt (grounded):"}
CLOSING = ". No figures beyond these source sentences."
REWRITE = (
    "Rewrite the draft answer so it reads like a concise research assistant. Keep every number and proper noun exactly as written. Do not add facts. Keep the Citations line intact.\n\nTASK: ",
    "\nCHUNK:\n", "\n\nDRAFT:\n", "\n",
)


def _filled(template: str, label: Column) -> Column:
    before, after = template.split("{section}")
    return F.concat(F.lit(before), label, F.lit(after))


def citations(chunk_id: Column, props: Column, text: Column) -> Column:
    """[chunk#s<sentence>] and the proposition, each; without propositions the text's beginning."""
    found = F.transform(props, lambda p: F.concat(F.lit("["), chunk_id, F.lit("#s"), p["source_sentence_index"].cast("string"), F.lit("] "), p["text"]))
    spare = F.array(F.concat(F.lit("["), chunk_id, F.lit("] "), F.substring(T.strip(text), 1, 240)))
    return F.when(F.size(props) > 0, found).otherwise(spare)


def facts(chunk_id: Column, props: Column) -> Column:
    """The part of an answer that all tasks share: bullets and citations."""
    bullets = F.array_join(F.transform(props, lambda p: F.concat(F.lit("- "), p["text"])), "\n")
    cites = F.array_join(F.transform(props, lambda p: F.concat(chunk_id, F.lit("#s"), p["source_sentence_index"].cast("string"))), "; ")
    return F.concat(F.lit("\n"), bullets, F.lit("\n\nCitations: "), cites, F.lit(CLOSING))


def generate(chunks: DataFrame, c: Pairing = Pairing(), rewrite: Callable[[Column], Column] | None = None) -> DataFrame:
    """Up to three pairs a chunk: pos, block, start_sentence, k (their order), pair_id, chunk_id, source_id, task,
    instruction, context, output, citations, section, generator, n_propositions.

    ``rewrite`` gets the prompt's column and gives a rewritten draft's (say, a pandas UDF); a blank one leaves the draft.
    """
    props = F.filter("propositions", lambda p: T.strip(p["text"]) != "")
    spare = F.array(F.struct(F.substring(T.strip(F.col("text")), 1, 280).alias("text"), F.col("start_sentence").alias("source_sentence_index"), F.lit(0.0).alias("score")))
    rows = chunks.where(T.strip(F.col("text")) != "").withColumn("props", props).withColumn("used", F.when(F.size("props") > 0, F.col("props")).otherwise(spare))
    rows = rows.withColumn("label", T.section_label(F.col("section"))).withColumn("facts", facts(F.col("chunk_id"), F.col("used")))
    rows = rows.withColumn("cites", citations(F.col("chunk_id"), F.col("props"), F.col("text")))
    label = F.col("label")
    asked = [("qa", t) for t in QA_TEMPLATES[: c.max_qa]] + [("summary", SUMMARY_TEMPLATE)] * c.summary
    if not asked:
        rows = rows.where(F.lit(False))
        asked = [("summary", SUMMARY_TEMPLATE)]
    made = F.array(*[
        F.struct(F.lit(k).alias("k"), F.lit(task).alias("task"), _filled(t, label).alias("instruction"), F.concat(_filled(LEADS[task], label), "facts").alias("draft"))
        for k, (task, t) in enumerate(asked)
    ])
    wide = rows.withColumn("m", F.explode(made))
    draft = F.col("m.draft")
    if rewrite is not None:
        task, chunk, before, after = map(F.lit, REWRITE)
        prompt = F.concat(task, F.col("m.task"), chunk, F.col("text"), before, draft, after)
        draft = F.coalesce(F.nullif(T.strip(rewrite(prompt)), F.lit("")), draft)
    return wide.select(
        "pos", "block", "start_sentence", F.col("m.k").alias("k"), T.pair_id(F.col("chunk_id"), F.col("m.task"), F.col("m.instruction")).alias("pair_id"), "chunk_id", "source_id",
        F.col("m.task").alias("task"), F.col("m.instruction").alias("instruction"), F.col("text").alias("context"), draft.alias("output"), F.col("cites").alias("citations"),
        "section", F.lit("template" if rewrite is None else "llm").alias("generator"), F.size("props").alias("n_propositions"),
    )


def counts(pairs: DataFrame) -> DataFrame:
    """One row: n_pairs, n_qa, n_summary."""
    return pairs.agg(F.count("*").alias("n_pairs"), F.count_if(F.col("task") == "qa").alias("n_qa"), F.count_if(F.col("task") == "summary").alias("n_summary"))


def from_conversations(turns: DataFrame) -> DataFrame:
    """A user's turn and the assistant's next one as a pair; the source is the conversation's number modulo 5."""
    from pyspark.sql import Window

    w = Window.partitionBy("conv_id").orderBy("turn")
    nexts = turns.withColumn("next_role", F.lead("role").over(w)).withColumn("output", F.lead("text").over(w))
    rows = nexts.where("role = 'user' and next_role = 'assistant'")
    return rows.select(
        (F.col("conv_id") * 1000 + F.col("turn")).alias("pos"), F.concat_ws(":", F.lit("c"), "conv_id", "turn").alias("pair_id"), F.lit("").alias("chunk_id"),
        F.concat(F.lit("s"), (F.col("conv_id") % 5).cast("string")).alias("source_id"), F.lit("qa").alias("task"), F.col("text").alias("instruction"),
        F.col("text").alias("context"), "output", F.array().cast("array<string>").alias("citations"),
    )


def from_corpus(corpus: DataFrame) -> DataFrame:
    """Chunks again from a corpus without propositions: the text's beginning stands for one of score 0.7."""
    one = F.array(F.struct(F.substring(T.strip(F.col("text")), 1, 280).alias("text"), F.col("start_sentence").alias("source_sentence_index"), F.lit(0.7).alias("score")))
    none = F.filter(one, lambda x: F.lit(False))
    return corpus.withColumn("propositions", F.when(T.strip(F.col("text")) != "", one).otherwise(none))
