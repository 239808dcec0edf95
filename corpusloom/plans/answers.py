"""Answer compositions: prompts, generation, validation and citations for a batch."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as tx
from ..operators import citations, evidence, prompts


def budgeted(questions: DataFrame, selected: DataFrame, window: int = 8192, reserve: int = 512, margin: int = 256) -> DataFrame:
    """Evidence that fits the rendered prompt, with its ``E`` numbers.

    The counter is additive over white space and punctuation, so the cost of an
    item is the count of its JSON text and the fixed part is counted once.
    """
    shown = F.struct(
        F.lit("E1").alias("evidence_id"), *[F.col(c) for c in prompts.EVIDENCE_FIELDS if c in selected.columns and c != "evidence_id"]
    )
    rows = selected.join(questions.select("query_id", "query"), "query_id").withColumn("cost", tx.tok_count(tx.safe_json(shown)).cast("long"))
    fixed = tx.tok_count(prompts.render_v2(F.col("query"), F.array().cast("array<string>")))
    limit = (F.lit(window - reserve - margin) - fixed).cast("long")
    kept = evidence.fit_budget(rows, limit, joiner=1).filter("kept").select("query_id", "position", "evidence_id")
    return selected.join(kept, ["query_id", "position"])


def prompts_for(questions: DataFrame, selected: DataFrame) -> DataFrame:
    return prompts.prompt_v2(questions, budgeted(questions, selected))


def answer_v1(questions: DataFrame, top: DataFrame, generator: str = "extractive", window: int = 8192, output: int = 512, reserve: int = 300) -> DataFrame:
    """Budget, numbered-source prompt and generation over retrieved chunks."""
    costed = top.withColumn("cost", tx.tok_count(F.col("content")).cast("long"))
    kept = evidence.fit_budget(costed, F.lit(window - output - reserve).cast("long")).filter("kept").select("query_id", "position")
    missing = [c for c in ("category", "chapter", "article", "section", "subsection", "page_start", "page_end") if c not in top.columns]
    sources = top.join(kept, ["query_id", "position"]).withColumn("text", F.col("content")).withColumn("title", F.col("document_title"))
    for name in missing:
        sources = sources.withColumn(name, F.lit(None).cast("string"))
    return prompts.generate_batch(prompts.prompt_v1(questions, sources), generator)


def answer_v2(questions: DataFrame, selected: DataFrame, generator: str = "extractive") -> DataFrame:
    """Budget, prompt, generation, validation, citation numbers and answer text."""
    kept = budgeted(questions, selected)
    raw = prompts.generate_batch(prompts.prompt_v2(questions, kept), generator)
    allowed = kept.groupBy("query_id").agg(F.collect_set("evidence_id").alias("allowed_ids"))
    outputs = raw.join(allowed, "query_id", "left").withColumn("allowed_ids", F.coalesce("allowed_ids", F.array().cast("array<string>")))
    valid = prompts.answer_validate(outputs)
    return citations.render_answers(valid, citations.number_citations(valid))
