"""Retrieval compositions: one job answers the whole batch of queries."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators import fusion, lexical, rerank, vectors
from ..session import small_side


@dataclass(frozen=True)
class HybridSettings:
    per_source: int = 30
    rrf_k: int = 60
    rerank_top: int = 15
    final_top: int = 5
    weights: Mapping[str, float] = field(default_factory=lambda: {"dense": 1.0, "sparse": 1.0, "bm25": 1.0})

    def __post_init__(self) -> None:
        if min(self.per_source, self.rrf_k, self.rerank_top, self.final_top) <= 0:
            raise ValueError("counts must be positive")
        if self.final_top > self.rerank_top:
            raise ValueError("final_top cannot exceed rerank_top")
        if any(w < 0 for w in self.weights.values()):
            raise ValueError("weights must be non-negative")


@dataclass(frozen=True)
class Retrieval:
    """Every stage of one batch, as lazy tables."""

    ranked: DataFrame  # source-tagged lists
    fused: DataFrame
    reranked: DataFrame
    final: DataFrame

    def trace(self, queries: DataFrame) -> DataFrame:
        """Counts, overlaps and conditions per query."""
        base = fusion.source_overlap(self.ranked, queries)
        depth = self.reranked.groupBy("query_id").agg(F.count(F.lit(1)).alias("reranked_count"))
        last = self.final.groupBy("query_id").agg(F.count(F.lit(1)).alias("final_count"))
        return base.join(depth, "query_id", "left").join(last, "query_id", "left").na.fill(0)


def check_filters(filters: DataFrame, categories: Sequence[str], allowed: Sequence[str]) -> DataFrame:
    """Filter rows that ask for an unknown key or category."""
    bad_keys = [c for c in filters.columns if c not in {"query_id", *allowed}]
    if bad_keys:
        raise ValueError(f"unsupported filter keys: {bad_keys}")
    return filters.filter(F.col("category").isNotNull() & ~F.col("category").isin(*categories))


def sources(
    queries: DataFrame,
    index: lexical.LexicalIndex,
    points: DataFrame,
    per_source: int,
    where: Column | None = None,
    filters: Sequence[str] = (),
    sparse: bool = True,
) -> DataFrame:
    """Tagged top-k lists. ``queries`` carries ``query, dense, sparse``."""
    keep = list(filters)
    dense_q = queries.select("query_id", F.col("dense").alias("vector"), *keep)
    dense_p = (points if where is None else points.filter(where)).select("chunk_id", F.col("dense").alias("vector"), *keep)
    lists = {"dense": vectors.vec_topk_dense(dense_q, dense_p, per_source, filters=keep)}
    if sparse:
        lists["sparse"] = lexical.vec_topk_sparse(queries, points, per_source, filters=keep, where=where)
    lists["bm25"] = lexical.lex_topk(index, queries, per_source, where=where, filters=keep)
    return fusion.tag(lists)


def retrieve_hybrid(
    queries: DataFrame,
    index: lexical.LexicalIndex,
    points: DataFrame,
    chunks: DataFrame,
    settings: HybridSettings = HybridSettings(),
    where: Column | None = None,
    filters: Sequence[str] = (),
    sparse: bool = True,
    scorer: str | None = None,
) -> Retrieval:
    """Search, fuse, rerank a bounded list, keep the finalists.

    Text joins only after ranking: searches return identifiers, and the chunk
    table is read for the reranked rows alone.
    """
    ranked = sources(queries, index, points, settings.per_source, where, filters, sparse)
    return complete(ranked, queries, chunks, settings, scorer)


def complete(
    ranked: DataFrame,
    queries: DataFrame,
    chunks: DataFrame,
    settings: HybridSettings = HybridSettings(),
    scorer: str | None = None,
    stage: Callable[[DataFrame, str], DataFrame] = lambda df, name: df,
) -> Retrieval:
    """Fuse, hydrate, rerank and cut source-tagged lists.

    ``stage(df, name)`` may write the fused and the reranked lists, where
    several readers would run fusion and the scorer again.
    """
    fused = stage(fusion.fuse_rrf_weighted(ranked, settings.weights, settings.rrf_k, top=None), "fused")
    short = fused.filter(F.col("rrf_rank") <= settings.rerank_top).join(
        small_side(queries.select("query_id", "query"), queries.select("query_id")),
        "query_id",
    )
    full = rerank.hydrate(short, chunks)
    pairs = full.withColumn("text", rerank.rerank_text(full))
    reranked = stage(rerank.rerank(pairs, scorer=scorer), "reranked")
    final = reranked.filter(F.col("reranker_rank") <= settings.final_top).withColumn(
        "final_rank", F.col("reranker_rank")
    )
    return Retrieval(ranked, fused, reranked, final)
