"""Hydrating, reranking and completing finalists."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as tx
from ..session import small_side
from . import plugins

# Order of hierarchy parts in reranker text, and payload fields.
HIERARCHY_KEYS = ("division", "chapter", "article", "section", "clause", "subclause", "item", "annex")
HYDRATED = ("content", "document_title", "canonical_locator", "hierarchy")


def hydrate(candidates: DataFrame, chunks: DataFrame, fields: Sequence[str] = HYDRATED) -> DataFrame:
    """Attach chunk fields to a short candidate list.

    Candidates are bounded by queries x depth, so they travel to the chunks and
    the wide chunk table is not shuffled. Chunks that are missing stay null in
    ``hydrated``; see :func:`missing_chunks`.
    """
    ids = candidates.select("chunk_id").distinct()
    found = chunks.select("chunk_id", *fields).join(small_side(ids, candidates), "chunk_id", "left_semi")
    return candidates.join(found.withColumn("hydrated", F.lit(True)), "chunk_id", "left")


def missing_chunks(hydrated: DataFrame) -> DataFrame:
    return hydrated.filter(F.col("hydrated").isNull()).select("query_id", "chunk_id")


def compact_hierarchy(hierarchy: str, types: dict[str, str]) -> Column:
    """``key=number — title`` parts joined by `` | `` in fixed order."""
    parts = []
    for key in HIERARCHY_KEYS:
        if key not in types:
            continue
        value = F.col(f"{hierarchy}.{key}")
        if types[key] == "string":
            label = F.nullif(value, F.lit(""))
        else:
            label = F.nullif(
                F.concat_ws(" — ", F.nullif(value["number"], F.lit("")), F.nullif(value["title"], F.lit(""))), F.lit("")
            )
        parts.append(F.concat(F.lit(f"{key}="), label))
    return F.concat_ws(" | ", *parts)


def rerank_text(df: DataFrame, hierarchy: str = "hierarchy") -> Column:
    """The text a reranker sees for one candidate."""
    field = df.schema[hierarchy].dataType
    types = {f.name: f.dataType.simpleString() for f in field.fields}
    return F.concat(
        F.lit("Document: "),
        F.col("document_title"),
        F.lit("\nLocator: "),
        F.col("canonical_locator"),
        F.lit("\nHierarchy: "),
        compact_hierarchy(hierarchy, types),
        F.lit("\nContent: "),
        F.col("content"),
    )


def overlap_score(query: Column, text: Column) -> Column:
    """Default scorer: share of distinct query tokens that the text holds."""
    q = F.array_distinct(tx.tok_legal(query))
    return F.when(F.size(q) > 0, F.size(F.array_intersect(q, tx.tok_legal(text))) / F.size(q)).otherwise(0.0)


def rerank(pairs: DataFrame, top: int | None = None, scorer: str | None = None) -> DataFrame:
    """Score ``(query_id, chunk_id, query, text)``, order by score then id, cut.

    Pairs are few and light to move but dear to score: dealt by their number, not by their bytes, which adaptive
    execution would gather in one task.
    """
    pairs = pairs.repartition(int(pairs.sparkSession.conf.get("spark.sql.shuffle.partitions")), "query_id", "chunk_id")
    if scorer is None:
        scored = pairs.withColumn("reranker_score", overlap_score(F.col("query"), F.col("text")))
    else:
        scored = plugins.model_score(pairs, scorer)
    w = Window.partitionBy("query_id").orderBy(F.round("reranker_score", 10).desc(), "chunk_id")
    out = scored.withColumn("reranker_rank", F.row_number().over(w))
    return out if top is None else out.filter(F.col("reranker_rank") <= top)


def rerank_depths(scored: DataFrame, depths: Sequence[int], final: int) -> DataFrame:
    """The same scored candidates cut at several depths before the final top."""
    if not depths or min(depths) <= 0 or final > min(depths):
        raise ValueError("depths must be positive and no smaller than the final top-k")
    each = scored.withColumn("depth", F.explode(F.array(*[F.lit(d) for d in depths]))).filter(
        F.col("rrf_rank") <= F.col("depth")
    )
    w = Window.partitionBy("query_id", "depth").orderBy(F.round("reranker_score", 10).desc(), "chunk_id")
    count = F.count(F.lit(1)).over(Window.partitionBy("query_id", "depth"))
    return (
        each.withColumn("reranked_count", count)
        .withColumn("final_rank", F.row_number().over(w))
        .filter(F.col("final_rank") <= final)
    )


def fetch_payloads(finalists: DataFrame, chunks: DataFrame, required: Sequence[str], version: str = "2.0") -> DataFrame:
    """Full payload of the finalists with the first broken rule in ``error``."""
    ids = finalists.select("chunk_id").distinct()
    wide = chunks.join(small_side(ids, finalists), "chunk_id", "left_semi").withColumn("present", F.lit(True))
    out = finalists.join(wide, "chunk_id", "left")
    missing = F.concat_ws(",", *[F.when(F.col(c).isNull(), F.lit(c)) for c in required])
    return out.withColumn(
        "error",
        F.when(F.col("present").isNull(), "payload is missing")
        .when(F.col("schema_version") != version, "unexpected schema version")
        .when(missing != "", F.concat(F.lit("missing fields: "), missing)),
    ).drop("present")


def resolve_parents(finalists: DataFrame, parents: DataFrame) -> DataFrame:
    """Distinct parents of the finalists; a parent not found becomes a warning."""
    wanted = finalists.groupBy("query_id", "parent_chunk_id").agg(
        F.array_join(F.array_sort(F.collect_set("chunk_id")), ",").alias("children")
    )
    ids = wanted.select("parent_chunk_id").distinct()
    found = parents.join(small_side(ids, finalists), "parent_chunk_id", "left_semi").withColumn("found", F.lit(True))
    out = wanted.join(found, "parent_chunk_id", "left")
    return out.withColumn(
        "warning",
        F.when(F.col("parent_chunk_id").isNull(), "chunk has no parent").when(F.col("found").isNull(), "parent not found"),
    ).drop("found")
