"""Reciprocal-rank fusion of ranked lists, for many queries at once."""

from __future__ import annotations

from collections.abc import Mapping
from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

SOURCES = ("dense", "sparse", "bm25")


def tag(lists: Mapping[str, DataFrame]) -> DataFrame:
    """Stack ranked lists with a ``source`` column."""
    return reduce(
        DataFrame.unionByName,
        [
            df.select("query_id", "chunk_id", "score", "rank", F.lit(name).alias("source"))
            for name, df in lists.items()
        ],
    )


def fuse_rrf(ranked: DataFrame, k: int = 60, top: int | None = None) -> DataFrame:
    """Sum of 1/(k + rank); an id repeated in one list adds again."""
    fused = ranked.groupBy("query_id", "chunk_id").agg(F.sum(1.0 / (k + F.col("rank"))).alias("rrf_score"))
    w = Window.partitionBy("query_id").orderBy(F.round("rrf_score", 12).desc(), "chunk_id")
    out = fused.withColumn("rrf_rank", F.row_number().over(w))
    return out if top is None else out.filter(F.col("rrf_rank") <= top)


def fuse_rrf_weighted(
    ranked: DataFrame,
    weights: Mapping[str, float] | None = None,
    k: int = 60,
    top: int | None = 20,
) -> DataFrame:
    """Weighted fusion of named sources; the lowest rank per source counts.

    ``ranked`` has ``query_id, chunk_id, source, rank, score`` and may have
    ``point_id``. Missing sources leave null ranks, scores and contributions.
    """
    weights = {s: 1.0 for s in SOURCES} | dict(weights or {})
    if k <= 0 or (top is not None and top <= 0) or any(w < 0 for w in weights.values()):
        raise ValueError("k and top must be positive, weights non-negative")
    if "point_id" not in ranked.columns:
        ranked = ranked.withColumn("point_id", F.lit(None).cast("string"))
    aggregates = []
    for s in SOURCES:
        mine = F.col("source") == s
        aggregates += [
            F.min(F.when(mine, F.col("rank"))).alias(f"{s}_rank"),
            F.min_by(F.when(mine, F.col("score")), F.when(mine, F.col("rank"))).alias(f"{s}_score"),
            F.min_by(
                F.when(mine, F.col("point_id")), F.when(mine & F.col("point_id").isNotNull(), F.col("rank"))
            ).alias(f"{s}_point"),
        ]
    out = ranked.groupBy("query_id", "chunk_id").agg(*aggregates)
    for s in SOURCES:
        out = out.withColumn(f"{s}_contribution", F.lit(float(weights[s])) / (k + F.col(f"{s}_rank")))
    out = out.select(
        "query_id",
        "chunk_id",
        F.coalesce(*[f"{s}_point" for s in SOURCES]).alias("point_id"),
        F.array_compact(F.array(*[F.when(F.col(f"{s}_rank").isNotNull(), s) for s in SOURCES])).alias("retrievers"),
        *[f"{s}_{c}" for s in SOURCES for c in ("rank", "score", "contribution")],
        reduce(
            lambda a, b: a + b, [F.coalesce(f"{s}_contribution", F.lit(0.0)) for s in SOURCES]
        ).alias("rrf_score"),
    )
    w = Window.partitionBy("query_id").orderBy(F.round("rrf_score", 12).desc(), "chunk_id")
    out = out.withColumn("rrf_rank", F.row_number().over(w))
    return out if top is None else out.filter(F.col("rrf_rank") <= top)


def source_overlap(ranked: DataFrame, queries: DataFrame) -> DataFrame:
    """Pairwise and triple overlaps, duplicates per source and empty sources."""
    bits = {s: 1 << i for i, s in enumerate(SOURCES)}
    bit = reduce(lambda acc, s: acc.when(F.col("source") == s, bits[s]), SOURCES[1:], F.when(F.col("source") == SOURCES[0], 1))
    per_id = ranked.groupBy("query_id", "chunk_id").agg(
        F.bit_or(bit).alias("mask"), *[F.count_if(F.col("source") == s).alias(f"n_{s}") for s in SOURCES]
    )

    def shared(mask: int):
        return F.count_if(F.col("mask").bitwiseAND(mask) == mask)

    summary = per_id.groupBy("query_id").agg(
        shared(3).alias("dense_sparse"),
        shared(5).alias("dense_bm25"),
        shared(6).alias("sparse_bm25"),
        shared(7).alias("all_three"),
        F.count(F.lit(1)).alias("fused_unique"),
        *[F.sum(f"n_{s}").alias(f"{s}_count") for s in SOURCES],
        *[F.sum(F.greatest(F.col(f"n_{s}") - 1, F.lit(0))).alias(f"{s}_duplicates") for s in SOURCES],
    )
    full = queries.select("query_id").join(summary, "query_id", "left").na.fill(0)
    empty = F.array_compact(F.array(*[F.when(F.col(f"{s}_count") == 0, s) for s in SOURCES]))
    return full.withColumn("empty_sources", F.array_join(empty, ","))
