"""Retrieval metrics, reports and run comparison."""

from __future__ import annotations

from pyspark.sql import functions as F

from corpusloom.functions import text as tx
from corpusloom.operators import compare, evaluate, lexical

from .bindings import EXCHANGES_SQL, GOLD_SQL, exchanges, gold, passages, questions, sql_tok_answer, sql_tok_legal
from .q_search import ALL_SOURCES_SQL, FUSED_SQL, bm25_index, documents, hybrid_run, lex_sql, rerank_sql
from .registry import query, staged, table


def gold_chunks(spark, sf):
    rows = staged(spark, sf, "gold", lambda: gold(spark, sf))
    return rows.select("query_id", F.col("doc_id").alias("chunk_id"), "source", "lang")


def gold_full(spark, sf):
    g = gold_chunks(spark, sf)
    return g.join(chunk_meta(spark, sf), "chunk_id")


def chunk_meta(spark, sf):
    """Copies share a logical chunk; a document version is a source and language."""
    return documents(spark, sf).select(
        F.col("doc_id").alias("chunk_id"), F.md5("text").alias("logical_chunk_id"), F.concat_ws("/", "source", "lang").alias("document_version_id")
    )


def bm25(spark, sf, b: float = 0.75, k: int = 30):
    return staged(spark, sf, f"bm25-{b}-{k}", lambda: lexical.lex_topk(bm25_index(spark, sf), questions(spark, sf), k=k, b=b))


META_SQL = "meta AS (SELECT doc_id AS chunk_id, md5(text) AS logical_chunk_id, source || '/' || lang AS document_version_id FROM documents)"


def v2_sql(src: str, extra_key: str = "", cutoffs=(5, 10, 20, 30), with_meta: bool = True) -> str:
    key = f"{extra_key}, " if extra_key else ""
    cols = []
    for c in cutoffs:
        cols += [
            f"max((hit AND rank <= {c})::INT)::DOUBLE AS hit_rate_{c}",
            f"max((hit AND rank <= {c})::INT)::DOUBLE AS exact_child_hit_rate_{c}",
            f"sum((hit AND rank <= {c})::INT) / any_value(gold_count) AS recall_{c}",
            f"coalesce(1.0 / min(CASE WHEN hit AND rank <= {c} THEN rank END), 0) AS mrr_{c}",
            f"coalesce(sum(CASE WHEN hit AND rank <= {c} THEN 1 / log2(rank + 1) END), 0) / any_value(list_sum(list_transform(range(1, least(gold_count, {c}) + 1), lambda i: 1 / log2(i + 1)))) AS ndcg_{c}",
        ]
        if with_meta:
            cols += [
                f"max((lhit AND rank <= {c})::INT)::DOUBLE AS logical_chunk_hit_rate_{c}",
                f"max((dhit AND rank <= {c})::INT)::DOUBLE AS document_hit_rate_{c}",
            ]
    return f"""
gold_n AS (SELECT query_id, count(*) AS gold_count FROM gold GROUP BY query_id),
judged AS (SELECT {key}r.query_id, r.rank, gold_count, EXISTS (SELECT 1 FROM gold g WHERE g.query_id = r.query_id AND g.doc_id = r.chunk_id) AS hit,
   EXISTS (SELECT 1 FROM gold g JOIN meta gm ON gm.chunk_id = g.doc_id WHERE g.query_id = r.query_id AND gm.logical_chunk_id = m.logical_chunk_id) AS lhit,
   EXISTS (SELECT 1 FROM gold g JOIN meta gm ON gm.chunk_id = g.doc_id WHERE g.query_id = r.query_id AND gm.document_version_id = m.document_version_id) AS dhit
   FROM {src} r JOIN gold_n USING (query_id) JOIN meta m USING (chunk_id)),
metrics AS (SELECT {key}query_id, any_value(gold_count) AS gold_count, {', '.join(cols)} FROM judged GROUP BY {key}query_id)
"""


@query("eval_ranking_v2", f"WITH {lex_sql()}, {GOLD_SQL}, {META_SQL}, {v2_sql('bm25')} SELECT * FROM metrics")
def eval_ranking_v2(spark, sf):
    return evaluate.eval_ranking_v2(bm25(spark, sf), gold_full(spark, sf), chunk_meta(spark, sf))


def v1_sql(src: str) -> str:
    cols = []
    for c in (1, 3, 5, 10):
        n = f"sum((hit AND rank <= {c})::INT)"
        cols += [f"{n} / any_value(gold_count) AS recall_{c}", f"{n} / {c} AS precision_{c}"]
    for c in (3, 5, 10):
        cols.append(
            f"coalesce(sum(CASE WHEN hit AND rank <= {c} THEN 1 / log2(rank + 1) END), 0) / any_value(list_sum(list_transform(range(1, least(gold_count, {c}) + 1), lambda i: 1 / log2(i + 1)))) AS ndcg_{c}"
        )
    first = "min(CASE WHEN hit AND rank <= 10 THEN rank END)"
    return f"""
gold_n AS (SELECT query_id, count(*) AS gold_count FROM gold GROUP BY query_id),
judged AS (SELECT r.query_id, r.rank, gold_count, EXISTS (SELECT 1 FROM gold g WHERE g.query_id = r.query_id AND g.doc_id = r.chunk_id) AS hit FROM {src} r JOIN gold_n USING (query_id)),
metrics AS (SELECT query_id, any_value(gold_count) AS gold_count, {', '.join(cols)}, coalesce(1.0 / {first}, 0) AS mrr_10, coalesce({first}, -1) AS first_rank FROM judged GROUP BY query_id)
"""


@query("eval_ranking_v1", f"WITH {lex_sql()}, {GOLD_SQL}, {v1_sql('bm25')} SELECT * FROM metrics")
def eval_ranking_v1(spark, sf):
    return evaluate.eval_ranking_v1(bm25(spark, sf), gold_chunks(spark, sf))


DENSE_EVAL = "SELECT count(*) AS questions, " + ", ".join(
    f"avg(recall_{c}) AS mean_recall_{c}, avg((recall_{c} > 0)::INT) AS mean_hit_{c}" for c in (1, 3, 5, 10)
) + ", avg(mrr_10) AS mean_mrr, coalesce(avg(CASE WHEN first_rank > 0 THEN first_rank END), 0) AS mean_first_rank FROM metrics"


@query("eval_ranking_dense", f"WITH {ALL_SOURCES_SQL}, {GOLD_SQL}, {v1_sql('dense')} {DENSE_EVAL}")
def eval_ranking_dense(spark, sf):
    ranked = hybrid_run(spark, sf).ranked.filter("source = 'dense'")
    return evaluate.dense_summary(evaluate.eval_ranking_dense(ranked, gold_chunks(spark, sf)))


DIM_SQL = """
dims AS (SELECT query_id, CASE WHEN query_id % 5 = 0 THEN 'dev' ELSE 'test' END AS split, ['easy', 'medium', 'hard'][query_id % 3 + 1] AS difficulty, arg_min(source, doc_id) AS category, arg_min(lang, doc_id) AS question_type,
   CASE WHEN count(*) > 1 THEN 'multi_chunk' ELSE 'single_chunk' END AS evidence_cardinality FROM gold GROUP BY query_id)
"""
_METRICS = ["recall_5", "recall_30", "mrr_10", "ndcg_10", "document_hit_rate_5"]


def dimensions(spark, sf):
    g = gold_chunks(spark, sf).groupBy("query_id").agg(
        F.min_by("source", "chunk_id").alias("category"), F.min_by("lang", "chunk_id").alias("question_type"), F.count(F.lit(1)).alias("n")
    )
    return g.select(
        "query_id",
        F.when(F.col("query_id") % 5 == 0, "dev").otherwise("test").alias("split"),
        F.element_at(F.array(F.lit("easy"), F.lit("medium"), F.lit("hard")), (F.col("query_id") % 3 + 1).cast("int")).alias("difficulty"),
        "category",
        "question_type",
        F.when(F.col("n") > 1, "multi_chunk").otherwise("single_chunk").alias("evidence_cardinality"),
    )


def grouped_sql(key: str = "") -> str:
    k, g = (f"{key}, ", f"{key}, ") if key else ("", "")
    means = ", ".join(f"avg({m}) AS {m}" for m in _METRICS)
    parts = [f"SELECT {k}'full' AS dimension, 'all' AS value, count(*) AS query_count, {means} FROM metrics" + (f" GROUP BY {key}" if key else "")]
    for d in evaluate.DIMENSIONS:
        parts.append(f"SELECT {k}'{d}', {d}, count(*), {', '.join(f'avg({m})' for m in _METRICS)} FROM metrics JOIN dims USING (query_id) GROUP BY {g}{d}")
    return " UNION ALL ".join(parts)


@query("eval_grouped", f"WITH {lex_sql()}, {GOLD_SQL}, {META_SQL}, {v2_sql('bm25')}, {DIM_SQL} {grouped_sql()}")
def eval_grouped(spark, sf):
    per = evaluate.eval_ranking_v2(bm25(spark, sf), gold_full(spark, sf), chunk_meta(spark, sf))
    return evaluate.eval_grouped(per.join(dimensions(spark, sf), "query_id"), _METRICS)


@query(
    "eval_model_loop",
    f"""WITH {lex_sql()}, {GOLD_SQL}, {v1_sql('bm25')} SELECT (SELECT count(*) FROM benchmark) AS questions, count(*) AS evaluated, (SELECT count(*) FROM benchmark) - count(*) AS skipped, avg(recall_5) AS recall_5, avg(precision_5) AS precision_5, avg(mrr_10) AS mrr_10, avg(ndcg_10) AS ndcg_10 FROM metrics""",
)
def eval_model_loop(spark, sf):
    per = evaluate.eval_ranking_v1(bm25(spark, sf), gold_chunks(spark, sf))
    asked = questions(spark, sf).join(per.withColumn("scored", F.lit(1)), "query_id", "left")
    return asked.agg(
        F.count(F.lit(1)).alias("questions"), F.count("scored").alias("evaluated"), F.count_if(F.col("scored").isNull()).alias("skipped"),
        *[F.avg(m).alias(m) for m in ("recall_5", "precision_5", "mrr_10", "ndcg_10")],
    )


STAGES_SQL = """
stages AS (SELECT source AS stage, query_id, chunk_id, rank FROM ranked UNION ALL SELECT 'rrf', query_id, chunk_id, rrf_rank FROM fused WHERE rrf_rank <= 30 UNION ALL SELECT 'reranked', query_id, chunk_id, reranker_rank FROM reranked)
"""


@query(
    "eval_report_v2",
    f"WITH {ALL_SOURCES_SQL}, {FUSED_SQL}, {rerank_sql()}, {STAGES_SQL}, {GOLD_SQL}, {META_SQL}, {v2_sql('stages', 'stage')}, {DIM_SQL} {grouped_sql('stage')}",
)
def eval_report_v2(spark, sf):
    run = hybrid_run(spark, sf)
    stages = (
        run.ranked.select(F.col("source").alias("stage"), "query_id", "chunk_id", "rank")
        .unionByName(run.fused.filter("rrf_rank <= 30").select(F.lit("rrf").alias("stage"), "query_id", "chunk_id", F.col("rrf_rank").alias("rank")))
        .unionByName(run.reranked.select(F.lit("reranked").alias("stage"), "query_id", "chunk_id", F.col("reranker_rank").alias("rank")))
    )
    per = evaluate.eval_ranking_v2(stages, gold_full(spark, sf), chunk_meta(spark, sf), keys=("stage", "query_id"))
    joined = per.join(dimensions(spark, sf), "query_id")
    return evaluate.eval_grouped_by(joined, _METRICS, "stage")


@query(
    "latency_summary",
    "SELECT event_type, avg(value) AS mean, median(value) AS median, quantile_disc(value, 0.95) AS p95, min(value) AS min, max(value) AS max FROM events GROUP BY event_type",
)
def latency_summary(spark, sf):
    return evaluate.latency_summary(table(spark, sf, "events"), "value", ["event_type"])


@query(
    "latency_runs",
    """SELECT event_type, avg(value) AS mean_ms, quantile_disc(value, 0.5) AS p50_ms, quantile_disc(value, 0.95) AS p95_ms, max(value) AS max_ms, avg(value * (event_id % 10) / 10) AS mean_reranker_ms,
       100 * sum(value * (event_id % 10) / 10) / sum(value) AS reranker_percent FROM events GROUP BY event_type""",
)
def latency_runs(spark, sf):
    runs = table(spark, sf, "events").select(
        "event_type", F.col("value").alias("total_ms"), (F.col("value") * (F.col("event_id") % 10) / 10).alias("reranker_ms")
    )
    return evaluate.latency_runs(runs, ["event_type"])


TWO_RUNS = f"{lex_sql(tag='bm25')}, {lex_sql(tag='flat', b=0.0)}"
LISTS_SQL = """
la AS (SELECT query_id, string_agg(chunk_id::VARCHAR, ',' ORDER BY rank) AS a FROM bm25 GROUP BY 1), lb AS (SELECT query_id, string_agg(chunk_id::VARCHAR, ',' ORDER BY rank) AS b FROM flat GROUP BY 1)
"""


@query("compare_rankings", f"WITH {TWO_RUNS}, {LISTS_SQL} SELECT query_id, coalesce(a, '') AS baseline, coalesce(b, '') AS optimized, coalesce(a, '') = coalesce(b, '') AS same FROM la FULL JOIN lb USING (query_id)")
def compare_rankings(spark, sf):
    out = compare.compare_rankings(bm25(spark, sf), bm25(spark, sf, b=0.0))
    return out.select("query_id", F.array_join("baseline", ",").alias("baseline"), F.array_join("optimized", ",").alias("optimized"), "same")


@query(
    "compare_reports",
    """WITH a AS (SELECT event_type AS timing, avg(value) AS baseline_mean_ms FROM events WHERE user_id % 2 = 0 GROUP BY 1), b AS (SELECT event_type AS timing, avg(value) AS optimized_mean_ms FROM events WHERE user_id % 2 = 1 GROUP BY 1)
    SELECT timing, baseline_mean_ms, optimized_mean_ms, optimized_mean_ms - baseline_mean_ms AS delta_ms, 100 * (optimized_mean_ms - baseline_mean_ms) / baseline_mean_ms AS change_percent FROM a JOIN b USING (timing)""",
)
def compare_reports(spark, sf):
    e = table(spark, sf, "events").select(F.col("event_type").alias("timing"), F.col("value").alias("ms"), "user_id")
    return compare.compare_latency(e.filter("user_id % 2 = 0"), e.filter("user_id % 2 = 1"))


@query(
    "compare_report_parity",
    f"""WITH {TWO_RUNS}, {LISTS_SQL} SELECT count(*) AS compared_query_count, sum((a <> b)::INT) AS mismatch_count, sum((a <> b)::INT) = 0 AS exact_parity FROM la JOIN lb USING (query_id)""",
)
def compare_report_parity(spark, sf):
    return compare.ranking_parity(compare.compare_rankings(bm25(spark, sf), bm25(spark, sf, b=0.0)))


@query(
    "compare_strategies",
    f"""WITH {TWO_RUNS}, {LISTS_SQL}, runs AS (SELECT 'sequential' AS strategy, 1 AS run, query_id, a AS ids FROM la UNION ALL SELECT 'sequential', 2, query_id, a FROM la UNION ALL SELECT 'flat', 1, query_id, b FROM lb UNION ALL SELECT 'mixed', 1, query_id, a FROM la UNION ALL SELECT 'mixed', 2, query_id, b FROM lb),
    per AS (SELECT strategy, query_id, count(DISTINCT ids) AS variants, arg_min(ids, run) AS ids FROM runs GROUP BY ALL)
    SELECT strategy, 'bm25' AS stage, max(variants) = 1 AS stable, bool_and(ids = a) AS parity FROM per JOIN la USING (query_id) GROUP BY strategy""",
)
def compare_strategies(spark, sf):
    def run(strategy, number, ranked):
        lists = compare.ranked_lists(ranked)
        return lists.select(F.lit(strategy).alias("strategy"), F.lit(number).alias("run"), F.lit("bm25").alias("stage"), "query_id", F.array_join("ids", ",").alias("ids"))

    a, b = bm25(spark, sf), bm25(spark, sf, b=0.0)
    runs = run("sequential", 1, a).unionByName(run("sequential", 2, a)).unionByName(run("flat", 1, b)).unionByName(run("mixed", 1, a)).unionByName(run("mixed", 2, b))
    return compare.compare_strategies(runs, "sequential")


@query(
    "compare_rerankers",
    f"""WITH {TWO_RUNS}, {GOLD_SQL}, g AS (SELECT query_id, list(doc_id) AS g FROM gold GROUP BY 1),
    x AS (SELECT query_id, list(chunk_id ORDER BY rank) AS a FROM bm25 WHERE rank <= 5 GROUP BY 1), y AS (SELECT query_id, list(chunk_id ORDER BY rank) AS b FROM flat WHERE rank <= 5 GROUP BY 1)
    SELECT sum((a <> b)::INT) AS different_order, sum((list_sort(a) <> list_sort(b))::INT) AS different_set, sum((list_has_any(a, g) AND NOT list_has_any(b, g))::INT) AS first_only_hit, sum((list_has_any(b, g) AND NOT list_has_any(a, g))::INT) AS second_only_hit
    FROM x JOIN y USING (query_id) JOIN g USING (query_id)""",
)
def compare_rerankers(spark, sf):
    return compare.reranker_disagreements(bm25(spark, sf), bm25(spark, sf, b=0.0), gold_chunks(spark, sf))


@query(
    "compare_reranker_winner",
    f"""WITH {TWO_RUNS}, {GOLD_SQL}, {META_SQL}, both_runs AS (SELECT 'bm25' AS model, * FROM bm25 UNION ALL SELECT 'flat', * FROM flat), {v2_sql('both_runs', 'model')},
    s AS (SELECT model, avg(exact_child_hit_rate_5) AS h, avg(recall_5) AS r, avg(ndcg_5) AS n, avg(mrr_5) AS m FROM metrics GROUP BY model) SELECT model AS winner FROM s ORDER BY round(h, 9) DESC, round(r, 9) DESC, round(n, 9) DESC, round(m, 9) DESC, model LIMIT 1""",
)
def compare_reranker_winner(spark, sf):
    both = bm25(spark, sf).withColumn("model", F.lit("bm25")).unionByName(bm25(spark, sf, b=0.0).withColumn("model", F.lit("flat")))
    per = evaluate.eval_ranking_v2(both, gold_full(spark, sf), chunk_meta(spark, sf), keys=("model", "query_id"))
    names = ("exact_child_hit_rate_5", "recall_5", "ndcg_5", "mrr_5")
    summary = per.groupBy("model").agg(*[F.round(F.avg(m), 9).alias(m) for m in names]).withColumn(
        "mean_latency_ms", F.when(F.col("model") == "bm25", 1.0).otherwise(2.0)
    )
    return compare.reranker_winner(summary)


# ------------------------------------------------------------------ answers


def answers(spark, sf):
    return exchanges(spark, sf)


F1_SQL = f"""
ta AS (SELECT conv_id, turn, token, count(*) AS n FROM (SELECT conv_id, turn, unnest({sql_tok_answer('answer')}) AS token FROM exchanges) GROUP BY ALL),
tr AS (SELECT conv_id, turn, token, count(*) AS n FROM (SELECT conv_id, turn, unnest({sql_tok_answer('coalesce(reference, answer)')}) AS token FROM exchanges) GROUP BY ALL),
na AS (SELECT conv_id, turn, sum(n) AS n FROM ta GROUP BY ALL), nr AS (SELECT conv_id, turn, sum(n) AS n FROM tr GROUP BY ALL),
ov AS (SELECT conv_id, turn, sum(least(ta.n, tr.n)) AS o FROM ta JOIN tr USING (conv_id, turn, token) GROUP BY ALL),
f1 AS (SELECT conv_id, turn, coalesce(2 * (o / na.n) * (o / nr.n) / ((o / na.n) + (o / nr.n)), 0) AS token_f1 FROM exchanges LEFT JOIN na USING (conv_id, turn) LEFT JOIN nr USING (conv_id, turn) LEFT JOIN ov USING (conv_id, turn))
"""


@query("answer_token_f1", f"WITH {EXCHANGES_SQL}, {F1_SQL} SELECT conv_id, turn, token_f1 FROM f1")
def answer_token_f1(spark, sf):
    pairs = answers(spark, sf).withColumn("reference", F.coalesce("reference", "answer"))
    return compare.token_f1(pairs, keys=("conv_id", "turn"))


# Words of the answer stand for cited chunks, words of the reference for gold ones.
SCORE_SQL = r"""
rec AS (SELECT conv_id, turn, CASE WHEN conv_id % 4 = 3 THEN 'insufficient_evidence' ELSE 'answered' END AS status, list_distinct(string_split(answer, ' ')) AS cited, list_distinct(string_split(coalesce(reference, answer), ' ')) AS g,
   list_transform(list_distinct(string_split(answer, ' ')), lambda x: x[1]) AS cv, list_distinct(list_transform(string_split(coalesce(reference, answer), ' '), lambda x: x[1])) AS gv,
   string_split(answer, chr(10)) AS blocks, conv_id % 6 = 5 AS invalid FROM exchanges),
scored AS (SELECT conv_id, turn, status, len(list_intersect(cited, g)) / len(g) AS gold_child_citation_recall, list_has_any(cv, gv) AS gold_document_citation_hit, len(cited) AS citation_count,
   CASE WHEN status <> 'answered' THEN len(cited) = 0 ELSE len(list_filter(cited, lambda x: length(x) > 12)) = 0 END AS all_sources_validated,
   len(list_filter(blocks, lambda x: length(x) < 40)) AS citation_free_blocks, invalid AS invalid_output FROM rec)
"""


def scored_answers(spark, sf):
    def words(c):
        return F.split(c, " ", -1)

    ref = F.coalesce("reference", "answer")
    cited = F.transform(
        F.array_distinct(words("answer")),
        lambda x: F.struct(x.alias("chunk_id"), F.substring(x, 1, 1).alias("document_version_id"), (F.length(x) <= 12).alias("source_validated")),
    )
    rec = answers(spark, sf).select(
        "conv_id",
        "turn",
        F.when(F.col("conv_id") % 4 == 3, "insufficient_evidence").otherwise("answered").alias("status"),
        cited.alias("citations"),
        words(ref).alias("relevant_chunk_ids"),
        F.array_distinct(F.transform(words(ref), lambda x: F.substring(x, 1, 1))).alias("relevant_document_version_ids"),
        F.transform(F.split("answer", "\n", -1), lambda x: F.when(F.length(x) < 40, F.array().cast("array<int>")).otherwise(F.array(F.lit(1)))).alias("block_citations"),
        F.when(F.col("conv_id") % 6 == 5, F.array(F.lit("structured_output_invalid"))).otherwise(F.array(F.lit("evidence_id_retry"))).alias("warning_codes"),
    )
    return compare.answer_score(rec)


@query("answer_score", f"WITH {EXCHANGES_SQL}, {SCORE_SQL} SELECT * FROM scored")
def answer_score(spark, sf):
    return scored_answers(spark, sf)


RESULT_SQL = f"""
results AS (SELECT s.*, token_f1, turn % 8 <> 6 AS completed, length(answer)::DOUBLE AS generation_ms, (length(answer) + length(question))::DOUBLE AS attempt_ms, (length(answer) * 2)::DOUBLE AS projected_e2e_ms,
   CASE WHEN conv_id % 2 = 0 THEN length(question)::DOUBLE END AS provider_total_ms, CASE WHEN conv_id % 3 = 0 THEN 'm0' ELSE 'm1' END AS model FROM scored s JOIN f1 USING (conv_id, turn) JOIN exchanges USING (conv_id, turn))
"""


def results(spark, sf):
    pairs = answers(spark, sf)
    f1 = compare.token_f1(pairs.withColumn("reference", F.coalesce("reference", "answer")), keys=("conv_id", "turn"))
    return (
        scored_answers(spark, sf)
        .join(f1, ["conv_id", "turn"])
        .join(pairs, ["conv_id", "turn"])
        .withColumn("completed", F.col("turn") % 8 != 6)
        .withColumn("generation_ms", F.length("answer").cast("double"))
        .withColumn("attempt_ms", (F.length("answer") + F.length("question")).cast("double"))
        .withColumn("projected_e2e_ms", (F.length("answer") * 2).cast("double"))
        .withColumn("provider_total_ms", F.when(F.col("conv_id") % 2 == 0, F.length("question").cast("double")))
        .withColumn("cached_prompt_tokens", F.lit(0))
        .withColumn("model", F.when(F.col("conv_id") % 3 == 0, "m0").otherwise("m1"))
    )


@query(
    "answer_summary",
    f"""WITH {EXCHANGES_SQL}, {F1_SQL}, {SCORE_SQL}, {RESULT_SQL} SELECT model, count(*) AS requested_count, sum(completed::INT) AS completed_count, avg(completed::INT) AS success_rate, avg((status = 'answered')::INT) FILTER (completed) AS answered_rate,
      avg((NOT invalid_output)::INT) FILTER (completed) AS valid_output_rate, avg(all_sources_validated::INT) FILTER (completed) AS all_sources_validated_rate, sum(citation_free_blocks) FILTER (completed) AS citation_free_block_count, avg(token_f1) FILTER (completed) AS mean_token_f1,
      avg(gold_child_citation_recall) FILTER (completed) AS mean_gold_child_citation_recall, avg(gold_document_citation_hit::INT) FILTER (completed) AS gold_document_citation_hit_rate,
      avg(generation_ms) FILTER (completed) AS generation_ms_mean, median(generation_ms) FILTER (completed) AS generation_ms_median, quantile_disc(generation_ms, 0.95) FILTER (completed) AS generation_ms_p95, quantile_disc(attempt_ms, 0.95) AS attempt_ms_p95,
      max(provider_total_ms) FILTER (completed) AS provider_total_ms_max, avg(generation_ms - provider_total_ms) FILTER (completed) AS client_overhead_ms_mean FROM results GROUP BY model""",
)
def answer_summary(spark, sf):
    return compare.answer_summary(results(spark, sf), ["model"]).select(
        "model", "requested_count", "completed_count", "success_rate", "answered_rate", "valid_output_rate", "all_sources_validated_rate", "citation_free_block_count",
        "mean_token_f1", "mean_gold_child_citation_recall", "gold_document_citation_hit_rate", "generation_ms_mean", "generation_ms_median", "generation_ms_p95",
        "attempt_ms_p95", "provider_total_ms_max", "client_overhead_ms_mean",
    )


@query(
    "model_select",
    f"""WITH {EXCHANGES_SQL}, {F1_SQL}, {SCORE_SQL}, {RESULT_SQL}, kept AS (SELECT * FROM results WHERE completed AND NOT invalid_output AND all_sources_validated),
    s AS (SELECT 's' || (conv_id % 7) AS model, avg(gold_child_citation_recall) AS r, avg(gold_document_citation_hit::INT) AS h, avg(token_f1) AS f, avg(projected_e2e_ms) AS ms FROM kept GROUP BY 1)
    SELECT count(*) AS eligible, arg_min(model, ms) AS latency_winner, (SELECT model FROM s ORDER BY r DESC, h DESC, f DESC, ms LIMIT 1) AS quality_leader FROM s""",
)
def model_select(spark, sf):
    kept = results(spark, sf).filter("completed and not invalid_output and all_sources_validated")
    return compare.model_select(compare.answer_summary(kept.withColumn("model", F.concat(F.lit("s"), F.col("conv_id") % 7)), ["model"]))


@query(
    "answer_eval_run",
    f"""WITH {EXCHANGES_SQL} SELECT count(*) AS questions, sum((reference IS NOT NULL)::INT) AS successes, avg((reference IS NOT NULL)::INT) AS success_rate, avg(length(answer)) FILTER (reference IS NOT NULL) AS mean_generation_time,
     avg(len(string_split(question, ' '))) FILTER (reference IS NOT NULL) AS mean_retrieved FROM exchanges""",
)
def answer_eval_run(spark, sf):
    rows = answers(spark, sf).select(
        F.length("answer").cast("double").alias("generation_time"),
        F.split("question", " ", -1).alias("retrieved_chunk_ids"),
        F.when(F.col("reference").isNull(), "no reference").alias("error"),
    )
    return compare.answer_eval_summary(rows)


@query(
    "enrich_contexts",
    f"""WITH {lex_sql(k=10)}, asked AS (SELECT query_id, list_concat(list(chunk_id ORDER BY rank), [-1]) AS ids FROM bm25 GROUP BY 1)
    SELECT query_id, md5(string_agg(text, '~' ORDER BY rank)) AS contexts_md5, string_agg(lang, ',' ORDER BY rank) AS langs, '-1' AS missing FROM bm25 JOIN documents ON doc_id = chunk_id GROUP BY 1""",
)
def enrich_contexts(spark, sf):
    lists = compare.ranked_lists(bm25(spark, sf).filter("rank <= 10")).select(
        "query_id", F.concat("ids", F.array(F.lit(-1).cast("long"))).alias("retrieved_chunk_ids")
    )
    chunks = documents(spark, sf).select(F.col("doc_id").alias("chunk_id"), "text", "lang")
    out = compare.enrich_contexts(lists, chunks, ["query_id"], ["lang"])
    langs = F.transform("metadata", lambda m: F.get_json_object(m, "$.lang"))
    return out.select(
        "query_id", F.md5(F.array_join("contexts", "~")).alias("contexts_md5"), F.array_join(langs, ",").alias("langs"),
        F.array_join(F.transform("missing_ids", lambda x: x.cast("string")), ",").alias("missing"),
    )


@query(
    "judge_samples",
    f"""WITH {EXCHANGES_SQL} SELECT turn, sum((reference IS NOT NULL AND conv_id % 5 <> 0)::INT) AS usable, sum((reference IS NULL OR conv_id % 5 = 0)::INT) AS skipped FROM exchanges GROUP BY turn""",
)
def judge_samples(spark, sf):
    rows = answers(spark, sf).select(
        "turn", "question", "answer",
        F.when(F.col("conv_id") % 5 == 0, "[broken").when(F.col("reference").isNotNull(), F.to_json(F.array("reference"))).otherwise("[]").alias("contexts"),
    )
    return compare.judge_samples(rows).groupBy("turn").agg(F.count_if("usable").alias("usable"), F.count_if(~F.col("usable")).alias("skipped"))


@query(
    "answer_support",
    f"""WITH {EXCHANGES_SQL}, t AS (SELECT conv_id, turn, list_distinct({sql_tok_legal('coalesce(reference, answer)')}) AS r, list_distinct({sql_tok_legal('answer')}) AS e FROM exchanges)
    SELECT conv_id, turn, CASE WHEN len(r) = 0 THEN 1.0 ELSE len(list_intersect(r, e)) / len(r) END AS support, CASE WHEN len(r) = 0 THEN false ELSE len(list_intersect(r, e)) / len(r) < 0.3 END AS weak FROM t""",
)
def answer_support(spark, sf):
    from corpusloom.operators import gold as g

    pairs = answers(spark, sf).select("conv_id", "turn", F.coalesce("reference", "answer").alias("reference_answer"), F.col("answer").alias("evidence"))
    return g.answer_support(pairs).select("conv_id", "turn", "support", "weak")


# ------------------------------------------------------------ gold questions


JACCARD_SQL = r"""
w AS (SELECT id, list_sort(list_distinct(list_filter(string_split_regex(lower(nfc_normalize(replace(text, 'ß', 'ss'))), '[\t-\r\x1C-\x20\x{85}\p{Z}]+'), lambda x: x <> ''))) AS l FROM (SELECT doc_id AS id, text FROM documents)),
r AS (SELECT min(id) AS rep, l FROM w GROUP BY l),
t AS (SELECT rep, len(l) AS n, unnest(l) AS token FROM r),
p AS (SELECT a.rep AS a, b.rep AS b, any_value(a.n) AS na, any_value(b.n) AS nb, count(*) AS k FROM t a JOIN t b ON a.token = b.token AND a.rep < b.rep GROUP BY a.rep, b.rep)
"""


@query(
    "near_dup_questions",
    f"WITH {JACCARD_SQL} SELECT a, b, k / (na + nb - k) AS jaccard FROM p WHERE k / (na + nb - k) > 0.9 UNION ALL SELECT rep, id, 1.0 FROM w JOIN r USING (l) WHERE id <> rep",
)
def near_dup_questions(spark, sf):
    from corpusloom.operators import gold as g

    rows = documents(spark, sf).select(F.col("doc_id").alias("id"), "text")
    return g.near_duplicates(rows, "id", "text", 0.9)


SEED = "seed-1"


@query(
    "gold_build",
    f"""WITH {GOLD_SQL}, r AS (SELECT query_id, 'eval_' || substr(sha256({"trim(b.text, ' ' || chr(10))"} || chr(31) || string_agg(g.doc_id::VARCHAR, ',' ORDER BY g.doc_id)), 1, 24) AS id, count(*) AS n_gold, min(source) AS category, count(DISTINCT source) AS categories
       FROM gold g JOIN benchmark b ON b.item_id = g.query_id GROUP BY query_id, b.text)
    SELECT id, query_id, n_gold, CASE WHEN categories = 1 THEN category END AS category, CASE WHEN categories = 1 THEN NULL ELSE 'record spans several categories' END AS error,
      CASE WHEN row_number() OVER (ORDER BY sha256('{SEED}' || id), id) <= 10 THEN 'dev' ELSE 'test' END AS split FROM r""",
)
def gold_build(spark, sf):
    from corpusloom.operators import gold as g

    asked = questions(spark, sf).select("query_id", F.col("query").alias("question"))
    pairs = gold_chunks(spark, sf).select("query_id", "chunk_id", F.col("source").alias("category"))
    out = g.gold_build(asked, pairs, SEED, dev=10)
    return out.select("id", "query_id", F.size("relevant_chunk_ids").alias("n_gold"), "category", "error", "split")


@query(
    "gold_validate",
    f"""WITH {GOLD_SQL} SELECT 'repeated question' AS rule, text AS item FROM benchmark GROUP BY text HAVING count(*) > 1
    UNION ALL SELECT 'evidence is not in its source', b.item_id::VARCHAR FROM benchmark b WHERE b.item_id NOT IN (SELECT query_id FROM gold)""",
)
def gold_validate(spark, sf):
    from corpusloom.operators import gold as g

    asked = questions(spark, sf).select(F.col("query_id").cast("string").alias("id"), F.col("query").alias("question"))
    supported = gold_chunks(spark, sf).select(F.col("query_id").cast("string").alias("id")).distinct()
    return g.gold_violations(asked, supported)
