"""Comparing runs, models and answers."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as tx
from ..session import matching
from . import percentiles


def ranked_lists(ranked: DataFrame, keys: Sequence[str] = ("query_id",)) -> DataFrame:
    """Ordered id list per record; a list is as long as its top-k."""
    item = F.struct("rank", "chunk_id")
    return ranked.groupBy(*keys).agg(F.transform(F.array_sort(F.collect_list(item)), lambda x: x["chunk_id"]).alias("ids"))


def compare_rankings(baseline: DataFrame, optimized: DataFrame, keys: Sequence[str] = ("query_id",)) -> DataFrame:
    """Ordered parity per record over the union of records; a missing list is empty."""
    a = ranked_lists(baseline, keys).withColumnRenamed("ids", "baseline")
    b = ranked_lists(optimized, keys).withColumnRenamed("ids", "optimized")
    joined = a.join(b, list(keys), "full_outer")

    def full(name: str):
        return F.when(F.col(name).isNotNull(), F.col(name)).otherwise(F.expr(f"slice(coalesce({name}, optimized, baseline), 1, 0)"))

    return joined.select(*keys, full("baseline").alias("baseline"), full("optimized").alias("optimized")).withColumn(
        "same", F.col("baseline") == F.col("optimized")
    )


def ranking_parity(compared: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    return compared.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("compared_query_count"),
        F.count_if(~F.col("same")).alias("mismatch_count"),
        (F.count_if(~F.col("same")) == 0).alias("exact_parity"),
    )


def compare_latency(baseline: DataFrame, optimized: DataFrame, key: str = "timing") -> DataFrame:
    """Mean per timing key on both sides; only keys that both have."""
    a = baseline.groupBy(key).agg(F.avg("ms").alias("baseline_mean_ms"))
    b = optimized.groupBy(key).agg(F.avg("ms").alias("optimized_mean_ms"))
    delta = F.col("optimized_mean_ms") - F.col("baseline_mean_ms")
    return a.join(b, key).select(
        key,
        "baseline_mean_ms",
        "optimized_mean_ms",
        delta.alias("delta_ms"),
        F.when(F.col("baseline_mean_ms") != 0, 100.0 * delta / F.col("baseline_mean_ms")).otherwise(0.0).alias("change_percent"),
    )


def quality_equal(a: DataFrame, b: DataFrame) -> DataFrame:
    """One row: whether two metric tables hold the same rows."""
    left = a.exceptAll(b).agg(F.count(F.lit(1)).alias("l"))
    right = b.exceptAll(a).agg(F.count(F.lit(1)).alias("r"))
    return left.crossJoin(F.broadcast(right)).select(((F.col("l") == 0) & (F.col("r") == 0)).alias("quality_equal"))  # one row


def compare_strategies(runs: DataFrame, reference: str) -> DataFrame:
    """``strategy, run, stage, query_id, ids`` → stability within and parity with the reference."""
    per = runs.groupBy("stage", "query_id", "strategy").agg(
        F.count_distinct("ids").alias("variants"), F.min_by("ids", "run").alias("ids")
    )
    mine = per.filter(F.col("strategy") == reference).select("stage", "query_id", F.col("ids").alias("expected"))
    return (
        per.join(mine, ["stage", "query_id"], "left")
        .groupBy("strategy", "stage")
        .agg((F.max("variants") == 1).alias("stable"), F.bool_and(F.coalesce(F.col("ids") == F.col("expected"), F.lit(False))).alias("parity"))
    )


def reranker_disagreements(first: DataFrame, second: DataFrame, gold: DataFrame, k: int = 5) -> DataFrame:
    """Order, set and hit disagreements of two runs over the same records."""
    a = ranked_lists(first.filter(F.col("rank") <= k)).withColumnRenamed("ids", "a")
    b = ranked_lists(second.filter(F.col("rank") <= k)).withColumnRenamed("ids", "b")
    truth = gold.groupBy("query_id").agg(F.collect_set("chunk_id").alias("g"))
    rows = a.join(b, "query_id").join(truth, "query_id")
    hit_a, hit_b = F.arrays_overlap("a", "g"), F.arrays_overlap("b", "g")
    return rows.agg(
        F.count_if(F.col("a") != F.col("b")).alias("different_order"),
        F.count_if(F.array_sort("a") != F.array_sort("b")).alias("different_set"),
        F.count_if(hit_a & ~hit_b).alias("first_only_hit"),
        F.count_if(hit_b & ~hit_a).alias("second_only_hit"),
    )


def pair_errors(reports: DataFrame, depth: int = 15, queries: int = 50) -> DataFrame:
    """Reports that may not be compared: other data, other depth, failed queries."""
    facts = reports.agg(F.count_distinct("dataset_sha256").alias("datasets"))
    return reports.crossJoin(F.broadcast(facts)).select(  # one row
        "model",
        F.when(F.col("datasets") > 1, "reports use different datasets")
        .when(F.col("rerank_top_k") != depth, "unexpected rerank depth")
        .when(F.col("successful_query_count") != queries, "unexpected query count")
        .alias("error"),
    ).filter("error is not null")


def reranker_winner(summaries: DataFrame) -> DataFrame:
    """Best by hit, recall, nDCG, MRR, then lower latency."""
    order = F.struct("exact_child_hit_rate_5", "recall_5", "ndcg_5", "mrr_5", (-F.col("mean_latency_ms")).alias("speed"))
    return summaries.agg(F.max_by("model", order).alias("winner"))


def token_f1(pairs: DataFrame, prediction: str = "answer", reference: str = "reference", keys: Sequence[str] = ("query_id",)) -> DataFrame:
    """Multiset token F1 per row; zero when either side has no token."""
    def counts(column: str, name: str) -> DataFrame:
        return pairs.select(*keys, F.explode(tx.tok_answer(F.col(column))).alias("token")).groupBy(*keys, "token").agg(F.count(F.lit(1)).alias(name))

    both = counts(prediction, "p").join(counts(reference, "r"), [*keys, "token"], "full_outer")
    sums = both.groupBy(*keys).agg(
        F.sum(F.least(F.coalesce("p", F.lit(0)), F.coalesce("r", F.lit(0)))).alias("overlap"),
        F.coalesce(F.sum("p"), F.lit(0)).alias("predicted"),
        F.coalesce(F.sum("r"), F.lit(0)).alias("expected"),
    )
    # 2pr/(p+r) with p = overlap/predicted and r = overlap/expected.
    f1 = F.when(F.col("overlap") > 0, 2.0 * F.col("overlap") / (F.col("predicted") + F.col("expected"))).otherwise(0.0)
    return pairs.select(*keys).join(sums.select(*keys, f1.alias("token_f1")), list(keys), "left").na.fill(0.0)


# Warning codes that mark an unusable model output.
INVALID_CODES = ("structured_output_invalid", "invalid_model_evidence_id", "citation_validation_failed")


def answer_score(records: DataFrame) -> DataFrame:
    """Citation scores of answers.

    ``records``: ``status, citations array<struct<chunk_id, document_version_id,
    source_validated>>, relevant_chunk_ids, relevant_document_version_ids,
    block_citations array<array<int>>, warning_codes``.
    """
    chunks = F.array_distinct(F.filter(F.transform("citations", lambda c: c["chunk_id"]), lambda x: x.isNotNull()))
    versions = F.filter(F.transform("citations", lambda c: c["document_version_id"]), lambda x: x.isNotNull())
    gold = F.array_distinct("relevant_chunk_ids")
    n = F.size("citations")
    return records.select(
        *[c for c in records.columns if c.endswith("_id") or c in ("turn", "status")],
        (F.size(F.array_intersect(chunks, gold)) / F.size(gold)).alias("gold_child_citation_recall"),
        F.arrays_overlap(versions, F.col("relevant_document_version_ids")).alias("gold_document_citation_hit"),
        n.alias("citation_count"),
        F.when(F.col("status") != "answered", n == 0)
        .otherwise((n > 0) & F.forall("citations", lambda c: F.coalesce(c["source_validated"], F.lit(False))))
        .alias("all_sources_validated"),
        F.size(F.filter("block_citations", lambda b: F.size(b) == 0)).alias("citation_free_blocks"),
        F.arrays_overlap("warning_codes", F.array(*[F.lit(c) for c in INVALID_CODES])).alias("invalid_output"),
    )


LATENCIES = ("generation_ms", "attempt_ms", "projected_e2e_ms", "provider_total_ms", "client_overhead_ms")


def answer_summary(results: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Success, rates, mean scores, failure counts and five latency summaries per group."""
    done = F.col("completed")

    def rate(c):
        return F.coalesce(F.avg(F.when(done, c.cast("double"))), F.lit(0.0))

    rows = results.withColumn(
        "client_overhead_ms", F.when(done & F.col("provider_total_ms").isNotNull(), F.col("generation_ms") - F.col("provider_total_ms"))
    )
    rows = rows.select(
        "*",
        *[
            (F.col(c) if c == "attempt_ms" else F.when(done, F.col(c))).cast("double").alias(f"m_{c}")
            for c in LATENCIES
        ],
    )
    aggregates = [
        F.count(F.lit(1)).alias("requested_count"),
        F.count_if(done).alias("completed_count"),
        (F.count_if(done) / F.count(F.lit(1))).alias("success_rate"),
        rate(F.col("status") == "answered").alias("answered_rate"),
        rate(~F.col("invalid_output")).alias("valid_output_rate"),
        rate(F.col("all_sources_validated")).alias("all_sources_validated_rate"),
        F.coalesce(F.sum(F.when(done, F.col("citation_free_blocks"))), F.lit(0)).alias("citation_free_block_count"),
        rate(F.col("token_f1")).alias("mean_token_f1"),
        rate(F.col("gold_child_citation_recall")).alias("mean_gold_child_citation_recall"),
        rate(F.col("gold_document_citation_hit")).alias("gold_document_citation_hit_rate"),
        rate(F.coalesce("cached_prompt_tokens", F.lit(0))).alias("mean_cached_prompt_tokens"),
    ]
    for c in LATENCIES:
        m = f"m_{c}"
        aggregates += [
            F.avg(m).alias(f"{c}_mean"),
            F.min(m).alias(f"{c}_min"),
            F.max(m).alias(f"{c}_max"),
        ]
    found = percentiles.exact_at(rows, [f"m_{c}" for c in LATENCIES], percentiles.summary_indexes(), keys)
    out = percentiles.beside(rows.groupBy(*keys).agg(*aggregates), found, keys)
    for c in LATENCIES:
        out = out.withColumns({f"{c}_median": percentiles.middle(f"m_{c}"), f"{c}_p95": F.col(f"m_{c}_p95")})
    return out.drop(*[f"m_{c}_{p}" for c in LATENCIES for p in percentiles.summary_indexes()])


def failure_distribution(results: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    return results.filter(~F.col("completed")).groupBy(*keys, "error_category").agg(F.count(F.lit(1)).alias("failures"))


def model_select(summaries: DataFrame) -> DataFrame:
    """Latency winner and quality leader among models without any failure."""
    perfect = summaries.filter(
        (F.col("success_rate") == 1) & (F.col("valid_output_rate") == 1) & (F.col("all_sources_validated_rate") == 1)
    )
    order = F.struct(
        "mean_gold_child_citation_recall", "gold_document_citation_hit_rate", "mean_token_f1", (-F.col("projected_e2e_ms_mean")).alias("speed")
    )
    return perfect.agg(
        F.count(F.lit(1)).alias("eligible"),
        F.min_by("model", "projected_e2e_ms_mean").alias("latency_winner"),
        F.max_by("model", order).alias("quality_leader"),
    )


def answer_eval_summary(rows: DataFrame) -> DataFrame:
    """Success rate over all questions; times and list sizes over the successes."""
    ok = F.col("error").isNull() | (F.col("error") == "")
    times = [c for c in rows.columns if c.endswith("_time")]
    return rows.agg(
        F.count(F.lit(1)).alias("questions"),
        F.count_if(ok).alias("successes"),
        (F.count_if(ok) / F.count(F.lit(1))).alias("success_rate"),
        *[F.coalesce(F.avg(F.when(ok, F.col(c))), F.lit(0.0)).alias(f"mean_{c}") for c in times],
        F.avg(F.when(ok, F.size("retrieved_chunk_ids"))).alias("mean_retrieved"),
    )


def enrich_contexts(answers: DataFrame, chunks: DataFrame, keys: Sequence[str], fields: Sequence[str]) -> DataFrame:
    """Answers' id lists joined to chunks in order; ids not found are listed."""
    asked = answers.select(*keys, F.posexplode("retrieved_chunk_ids").alias("pos", "chunk_id"))
    found = asked.join(matching(chunks.select("chunk_id", "text", *fields), asked, "chunk_id").withColumn("hit", F.lit(True)), "chunk_id", "left")
    item = F.struct("pos", "chunk_id", F.coalesce("hit", F.lit(False)).alias("hit"), "text", *fields)
    lists = found.groupBy(*keys).agg(F.array_sort(F.collect_list(item)).alias("items"))
    out = answers.join(lists, list(keys), "left")
    hits = F.filter("items", lambda x: x["hit"])
    empty = F.array().cast("array<string>")
    return out.select(
        *answers.columns,
        F.coalesce(F.transform(hits, lambda x: x["text"]), empty).alias("contexts"),
        F.coalesce(F.transform(hits, lambda x: F.to_json(F.struct(x["chunk_id"].alias("chunk_id"), *[x[f].alias(f) for f in fields]))), empty).alias("metadata"),
        F.coalesce(F.transform(F.filter("items", lambda x: ~x["hit"]), lambda x: x["chunk_id"]), empty).alias("missing_ids"),
    )


def judge_samples(rows: DataFrame) -> DataFrame:
    """Rows fit for a judge: question, answer and at least one parsed context."""
    contexts = F.filter(F.coalesce(F.from_json("contexts", "array<string>"), F.array().cast("array<string>")), lambda x: tx.strip(x) != "")
    parsed = rows.withColumn("contexts", contexts)
    blank = reduce(lambda a, b: a | b, [tx.strip(F.coalesce(c, F.lit(""))) == "" for c in ("question", "answer")])
    return parsed.withColumn("usable", ~blank & (F.size("contexts") > 0))
