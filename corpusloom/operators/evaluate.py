"""Retrieval quality, latency and grouped means."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as tx
from ..session import matching
from . import percentiles

CUTOFFS = (5, 10, 20, 30)


def distinct_ranked(ranked: DataFrame, keys: Sequence[str] = ("query_id",), id_col: str = "chunk_id") -> DataFrame:
    """Drop repeated ids keeping the first, and close the gaps in the ranks."""
    first = ranked.groupBy(*keys, id_col).agg(F.min("rank").alias("first_rank"))
    w = Window.partitionBy(*keys).orderBy("first_rank", id_col)
    return first.withColumn("rank", F.row_number().over(w)).drop("first_rank")


def _ideal(n: Column, cutoff: int) -> Column:
    """Sum of 1/log2(i + 1) for i up to min(n, cutoff), from a literal table."""
    import math

    sums, total = [0.0], 0.0
    for i in range(1, cutoff + 1):
        total += 1 / math.log2(i + 1)
        sums.append(total)
    return F.get(F.array(*[F.lit(v) for v in sums]), F.least(n, F.lit(cutoff)).cast("int"))


def _gain() -> Column:
    return 1.0 / F.log2(F.col("rank") + 1.0)


def eval_ranking_v2(
    ranked: DataFrame,
    gold: DataFrame,
    meta: DataFrame | None = None,
    cutoffs: Sequence[int] = CUTOFFS,
    keys: Sequence[str] = ("query_id",),
) -> DataFrame:
    """Per query: hit, recall, MRR, binary nDCG, logical-chunk and document hits.

    ``gold`` has ``query_id, chunk_id`` and, for the last two metrics,
    ``logical_chunk_id, document_version_id``; ``meta`` maps chunks to them.
    """
    hits = gold.select("query_id", "chunk_id").distinct().withColumn("gold", F.lit(1))
    sizes = hits.groupBy("query_id").agg(F.count(F.lit(1)).alias("gold_count"))
    clean = distinct_ranked(ranked, keys).filter(F.col("rank") <= max(cutoffs))
    rows = clean.join(hits, ["query_id", "chunk_id"], "left")
    if meta is not None:
        wanted = matching(meta, clean, "chunk_id").select("chunk_id", "logical_chunk_id", "document_version_id")
        rows = rows.join(wanted, "chunk_id", "left")
        for name in ("logical_chunk_id", "document_version_id"):
            known = gold.select("query_id", name).distinct().withColumn(f"gold_{name}", F.lit(1))
            rows = rows.join(known, ["query_id", name], "left")
    aggregates = []
    for c in cutoffs:
        inside = (F.col("gold") == 1) & (F.col("rank") <= c)
        aggregates += [
            F.count_if(inside).alias(f"n_{c}"),
            F.min(F.when(inside, F.col("rank"))).alias(f"first_{c}"),
            F.sum(F.when(inside, _gain())).alias(f"dcg_{c}"),
        ]
        if meta is not None:
            aggregates += [
                F.max(F.when(F.col("rank") <= c, F.col("gold_logical_chunk_id"))).alias(f"logical_{c}"),
                F.max(F.when(F.col("rank") <= c, F.col("gold_document_version_id"))).alias(f"document_{c}"),
            ]
    per_query = rows.groupBy(*keys).agg(*aggregates)
    extra = [k for k in keys if k != "query_id"]
    if extra:  # every stage reports every query, also when it returned nothing
        scope = per_query.select(*extra).distinct()
        sizes = sizes.crossJoin(F.broadcast(scope))  # one row per stage
    out = sizes.join(per_query, list(keys), "left")
    columns: list[Column] = [F.col(k) for k in keys] + [F.col("gold_count")]
    for c in cutoffs:
        found = F.coalesce(F.col(f"n_{c}"), F.lit(0))
        columns += [
            (found > 0).cast("double").alias(f"hit_rate_{c}"),
            (found > 0).cast("double").alias(f"exact_child_hit_rate_{c}"),
            (found / F.col("gold_count")).alias(f"recall_{c}"),
            F.coalesce(1.0 / F.col(f"first_{c}"), F.lit(0.0)).alias(f"mrr_{c}"),
            F.coalesce(F.col(f"dcg_{c}") / _ideal(F.col("gold_count"), c), F.lit(0.0)).alias(f"ndcg_{c}"),
        ]
        if meta is not None:
            columns += [
                F.coalesce(F.col(f"logical_{c}"), F.lit(0)).cast("double").alias(f"logical_chunk_hit_rate_{c}"),
                F.coalesce(F.col(f"document_{c}"), F.lit(0)).cast("double").alias(f"document_hit_rate_{c}"),
            ]
    return out.select(*columns)


def eval_ranking_v1(
    ranked: DataFrame,
    gold: DataFrame,
    k: int = 10,
    cutoffs: Sequence[int] = (1, 3, 5, 10),
    ndcg_cutoffs: Sequence[int] = (3, 5, 10),
    compose: bool = False,
) -> DataFrame:
    """Recall and precision per cut-off, MRR@k, nDCG and first rank (-1 if none).

    Questions without gold do not appear. Repeated ids are not removed.
    """
    if compose:
        ranked = ranked.withColumn("chunk_id", tx.nfc(F.col("chunk_id")))
        gold = gold.withColumn("chunk_id", tx.nfc(F.col("chunk_id")))
    hits = gold.select("query_id", "chunk_id").distinct().withColumn("gold", F.lit(1))
    sizes = hits.groupBy("query_id").agg(F.count(F.lit(1)).alias("gold_count"))
    rows = ranked.filter(F.col("rank") <= k).join(hits, ["query_id", "chunk_id"])
    aggregates = [F.min("rank").alias("first")]
    for c in sorted({*cutoffs, *ndcg_cutoffs}):
        aggregates.append(F.count_if(F.col("rank") <= c).alias(f"n_{c}"))
        aggregates.append(F.sum(F.when(F.col("rank") <= c, _gain())).alias(f"dcg_{c}"))
    out = sizes.join(rows.groupBy("query_id").agg(*aggregates), "query_id", "left")
    columns = [F.col("query_id"), F.col("gold_count")]
    for c in cutoffs:
        found = F.coalesce(F.col(f"n_{c}"), F.lit(0))
        columns += [(found / F.col("gold_count")).alias(f"recall_{c}"), (found / F.lit(c)).alias(f"precision_{c}")]
    columns.append(F.coalesce(1.0 / F.col("first"), F.lit(0.0)).alias(f"mrr_{k}"))
    for c in ndcg_cutoffs:
        columns.append(F.coalesce(F.col(f"dcg_{c}") / _ideal(F.col("gold_count"), c), F.lit(0.0)).alias(f"ndcg_{c}"))
    columns.append(F.coalesce("first", F.lit(-1)).alias("first_rank"))
    return out.select(*columns)


def eval_ranking_dense(
    ranked: DataFrame, gold: DataFrame, k: int = 10, cutoffs: Sequence[int] = (1, 3, 5, 10)
) -> DataFrame:
    """Per question recall and hit per cut-off, MRR and first relevant rank."""
    hits = gold.select("query_id", "chunk_id").distinct().withColumn("gold", F.lit(1))
    sizes = hits.groupBy("query_id").agg(F.count(F.lit(1)).alias("gold_count"))
    rows = ranked.filter(F.col("rank") <= k).join(hits, ["query_id", "chunk_id"])
    per_query = rows.groupBy("query_id").agg(
        F.min("rank").alias("first"),
        *[F.count_if(F.col("rank") <= c).alias(f"n_{c}") for c in cutoffs],
    )
    out = sizes.join(per_query, "query_id", "left")
    columns = [F.col("query_id"), F.col("gold_count")]
    for c in cutoffs:
        found = F.coalesce(F.col(f"n_{c}"), F.lit(0))
        columns += [(found / F.col("gold_count")).alias(f"recall_{c}"), (found > 0).cast("double").alias(f"hit_{c}")]
    columns += [
        F.coalesce(1.0 / F.col("first"), F.lit(0.0)).alias("mrr"),
        F.coalesce("first", F.lit(-1)).alias("first_rank"),
    ]
    return out.select(*columns)


def dense_summary(per_query: DataFrame) -> DataFrame:
    """Means over questions; the mean first rank leaves out questions without a hit."""
    names = [c for c in per_query.columns if c.startswith(("recall_", "hit_", "mrr"))]
    return per_query.agg(
        F.count(F.lit(1)).alias("questions"),
        *[F.avg(c).alias(f"mean_{c}") for c in names],
        F.coalesce(F.avg(F.when(F.col("first_rank") > 0, F.col("first_rank"))), F.lit(0.0)).alias("mean_first_rank"),
    )


DIMENSIONS = ("split", "difficulty", "category", "question_type", "evidence_cardinality")


def eval_grouped(per_query: DataFrame, metrics: Sequence[str], dimensions: Sequence[str] = DIMENSIONS) -> DataFrame:
    """Mean of each metric over all queries and by each dimension, in one pass."""
    sets = [[], *[[F.col(d)] for d in dimensions]]
    grouped = per_query.groupingSets(sets, *[F.col(d) for d in dimensions]).agg(
        *[F.grouping(d).alias(f"g_{d}") for d in dimensions],
        F.count(F.lit(1)).alias("query_count"),
        *[F.avg(m).alias(m) for m in metrics],
    )
    name = reduce(lambda acc, d: acc.when(F.col(f"g_{d}") == 0, d), dimensions[1:], F.when(F.col(f"g_{dimensions[0]}") == 0, dimensions[0]))
    value = reduce(
        lambda acc, d: acc.when(F.col(f"g_{d}") == 0, F.col(d).cast("string")),
        dimensions[1:],
        F.when(F.col(f"g_{dimensions[0]}") == 0, F.col(dimensions[0]).cast("string")),
    )
    return grouped.select(
        F.coalesce(name, F.lit("full")).alias("dimension"),
        F.coalesce(value, F.lit("all")).alias("value"),
        "query_count",
        *metrics,
    )


def latency_summary(samples: DataFrame, value: str, keys: Sequence[str] = (), empty_zero: bool = True) -> DataFrame:
    """Mean, median, nearest-rank p95, min and max. No samples: zero, or null."""
    v = F.col(value)
    sums = samples.groupBy(*keys).agg(F.avg(v).alias("mean"), F.min(v).alias("min"), F.max(v).alias("max"))
    found = percentiles.exact_at(samples, [value], percentiles.summary_indexes(), keys)
    out = percentiles.beside(sums, found, keys).select(
        *keys, "mean", percentiles.middle(value).alias("median"), F.col(f"{value}_p95").alias("p95"), "min", "max"
    )
    return out.na.fill(0.0) if empty_zero else out


def latency_runs(runs: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Totals per run: mean, p50, p95, max and the reranker's share."""
    total = "total_ms"
    sums = runs.groupBy(*keys).agg(
        F.avg(total).alias("mean_ms"),
        F.max(total).alias("max_ms"),
        F.avg("reranker_ms").alias("mean_reranker_ms"),
        F.when(F.sum(total) != 0, 100.0 * F.sum("reranker_ms") / F.sum(total)).otherwise(0.0).alias("reranker_percent"),
    )
    indexes = {"p50": percentiles.index_nearest(0.5), "p95": percentiles.index_nearest(0.95)}
    out = percentiles.beside(sums, percentiles.exact_at(runs, [total], indexes, keys), keys)
    return out.select(
        *keys, "mean_ms", F.col(f"{total}_p50").alias("p50_ms"), F.col(f"{total}_p95").alias("p95_ms"), "max_ms", "mean_reranker_ms", "reranker_percent"
    )


def eval_grouped_by(per_query: DataFrame, metrics: Sequence[str], key: str, dimensions: Sequence[str] = DIMENSIONS) -> DataFrame:
    """:func:`eval_grouped` once per value of ``key``, still in one pass."""
    sets = [[F.col(key)], *[[F.col(key), F.col(d)] for d in dimensions]]
    grouped = per_query.groupingSets(sets, F.col(key), *[F.col(d) for d in dimensions]).agg(
        *[F.grouping(d).alias(f"g_{d}") for d in dimensions],
        F.count(F.lit(1)).alias("query_count"),
        *[F.avg(m).alias(m) for m in metrics],
    )
    name = F.coalesce(*[F.when(F.col(f"g_{d}") == 0, d) for d in dimensions], F.lit("full"))
    value = F.coalesce(*[F.when(F.col(f"g_{d}") == 0, F.col(d).cast("string")) for d in dimensions], F.lit("all"))
    return grouped.select(key, name.alias("dimension"), value.alias("value"), "query_count", *metrics)
