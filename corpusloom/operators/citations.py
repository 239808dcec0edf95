"""Numbering citations and proving them against stored artifacts."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import ids
from ..session import matching
from . import sweeps


def number_citations(answers: DataFrame) -> DataFrame:
    """``query_id, block_no, place, evidence_id, citation`` numbered by first use."""
    blocks = answers.select("query_id", F.posexplode("answer_blocks").alias("block_no", "b"))
    uses = blocks.select("query_id", "block_no", F.posexplode("b.evidence_ids").alias("place", "evidence_id"))
    first = uses.groupBy("query_id", "evidence_id").agg(F.min(F.struct("block_no", "place")).alias("first"))
    w = Window.partitionBy("query_id").orderBy("first")
    numbered = first.withColumn("citation", F.row_number().over(w)).drop("first")
    return uses.join(numbered, ["query_id", "evidence_id"])


def render_answers(answers: DataFrame, numbered: DataFrame, fallbacks: dict[str, str] | None = None) -> DataFrame:
    """Answer text with ``[n]`` marks; unanswered questions get their status text."""
    fallbacks = fallbacks or {
        "insufficient_evidence": "The available evidence does not allow a reliable answer.",
        "conflicting_evidence": "The sources contradict each other.",
    }
    marks = numbered.groupBy("query_id", "block_no").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("place", "citation"))), lambda x: F.concat(F.lit("["), x["citation"].cast("string"), F.lit("]"))), "").alias("marks")
    )
    blocks = answers.select("query_id", F.posexplode("answer_blocks").alias("block_no", "b")).join(marks, ["query_id", "block_no"], "left")
    text = blocks.groupBy("query_id").agg(
        F.array_join(
            F.transform(F.array_sort(F.collect_list(F.struct("block_no", F.concat("b.text", F.lit(" "), F.coalesce("marks", F.lit(""))).alias("t")))), lambda x: x["t"]), "\n\n"
        ).alias("answer")
    )
    default = None
    for status, words in fallbacks.items():
        default = F.when(F.col("status") == status, words) if default is None else default.when(F.col("status") == status, words)
    return answers.join(text, "query_id", "left").withColumn("answer", F.coalesce(F.nullif(F.trim("answer"), F.lit("")), default, F.lit("")))


def resolve_in_documents(selectors: DataFrame, sources: DataFrame) -> DataFrame:
    """Check each selector at its position, else find its quote with its surroundings; it must be unique.

    A document's selectors read its text together. Without a hit, or with more than one, there is an error.
    ``selectors``: ``document_id, position_start, position_end, exact, prefix, suffix`` and more; ``sources``: ``document_id, text``.
    """

    def answer(text, items):
        return sweeps.find_quotes(text, *[items[c] for c in ("position_start", "position_end", "exact", "prefix", "suffix")])

    found = sweeps.beside_text(selectors, sources, answer)
    start = F.col("answer.start")
    return found.select(
        *selectors.columns,
        start.alias("resolved_start"),
        (start + F.length("exact")).alias("resolved_end"),
        F.col("answer.mode").alias("mode"),
        F.when(F.col("answer").isNull(), "evidence selector cannot be resolved uniquely").alias("error"),
    )


def resolve_citations(numbered: DataFrame, evidence: DataFrame, artifacts: DataFrame, sources: DataFrame) -> DataFrame:
    """One row per citation with its evidence, or the first broken rule.

    ``evidence``: ``query_id, evidence_id, artifact_id, artifact_type,
    document_id, document_version_id, content_sha256, source_sha256, quotes``.
    """
    cited = numbered.select("query_id", "evidence_id", "citation").distinct()
    known = cited.join(evidence, ["query_id", "evidence_id"], "left")
    stored = matching(artifacts, known, "artifact_id").select(
        "artifact_id", F.col("artifact_type").alias("a_type"), F.col("document_version_id").alias("a_version"), F.col("content_sha256").alias("a_sha")
    )
    texts = matching(sources, known, "document_id").select("document_id", F.col("source_sha256").alias("s_sha"), ids.sha256(F.col("text")).alias("t_sha"))
    joined = known.join(stored, "artifact_id", "left").join(texts, "document_id", "left")
    error = (
        F.when(F.col("artifact_id").isNull(), "unknown evidence")
        .when(F.col("a_type").isNull(), "evidence artifact no longer exists")
        .when(F.col("a_type") != F.col("artifact_type"), "evidence artifact type mismatch")
        .when(F.col("a_version") != F.col("document_version_id"), "evidence document version mismatch")
        .when(F.col("a_sha") != F.col("content_sha256"), "evidence content hash mismatch")
        .when(F.coalesce(F.col("s_sha") != F.col("source_sha256"), F.lit(True)), "evidence source representation mismatch")
        .when(F.col("t_sha") != F.col("source_sha256"), "evidence source hash mismatch")
        .when(F.size("quotes") == 0, "evidence has no validated selectors")
    )
    return joined.select(
        "query_id", "citation", "evidence_id", "artifact_id", "document_id",
        F.substring(F.array_join("quotes", "\n"), 1, 300).alias("preview"), error.isNull().alias("source_validated"), error.alias("error"),
    )


def answer_sources_v1(answers: DataFrame, chunks: DataFrame) -> DataFrame:
    """Numbered sources of an answer: preview, title and page fallbacks, scores."""
    rows = answers.select("query_id", F.posexplode("sources").alias("i", "s")).select("query_id", "i", "s.*")
    return rows.join(matching(chunks, rows, "chunk_id"), "chunk_id", "left").select(
        "query_id",
        (F.col("i") + 1).alias("citation"),
        "chunk_id",
        F.coalesce("title", F.lit("Unknown Document")).alias("document_name"),
        F.coalesce("category", F.lit("unknown")).alias("category"),
        F.coalesce("page_start", "page").alias("page"),
        F.substring(F.coalesce("text", F.lit("")), 1, 300).alias("chunk_preview"),
        *[c for c in ("rrf_score", "rerank_score") if c in rows.columns],
    )
