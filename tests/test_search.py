import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from corpusloom.functions import text as tx
from corpusloom.operators import compare, evaluate, evidence, fusion, gold, lexical, vectors


def brute_bm25(docs, query, k, k1=1.5, b=0.75):
    toks = {d: t.split() for d, t in docs.items()}
    n, avg = len(docs), sum(map(len, toks.values())) / len(docs)
    df = {}
    for t in toks.values():
        for w in set(t):
            df[w] = df.get(w, 0) + 1
    idf = {w: math.log(n - c + 0.5) - math.log(c + 0.5) for w, c in df.items()}
    floor = 0.25 * sum(idf.values()) / len(idf)
    idf = {w: floor if v < 0 else v for w, v in idf.items()}
    score = {
        d: sum(idf.get(w, 0) * t.count(w) * (k1 + 1) / (t.count(w) + k1 * (1 - b + b * len(t) / avg)) for w in query.split())
        for d, t in toks.items()
    }
    return sorted(score, key=lambda d: (-round(score[d], 10), d))[:k]


def test_bm25_against_brute_force(spark):
    rng = random.Random(3)
    words = [f"w{i}" for i in range(60)]
    docs = {i: " ".join(rng.choice(words[: rng.choice([5, 60])]) for _ in range(rng.randint(0, 30))) for i in range(80)}
    asked = {q: " ".join(rng.choice(words) for _ in range(rng.randint(1, 6))) for q in range(20)}
    asked[20] = "nowhere"
    index = lexical.lex_index(spark.createDataFrame(list(docs.items()), "chunk_id long, content string"), tokenize=tx.tok_ws)
    got = {}
    for r in lexical.lex_topk(index, spark.createDataFrame(list(asked.items()), "query_id long, query string"), k=12).collect():
        got.setdefault(r["query_id"], {})[r["rank"]] = r["chunk_id"]
    for q, text in asked.items():
        assert [got[q][i] for i in sorted(got[q])] == brute_bm25(docs, text, 12), q


def test_fill_ranks_above_negative_scores(spark):
    docs = spark.createDataFrame([(i, "a b") for i in range(1, 7)] + [(7, "c")], "chunk_id long, content string")
    index = lexical.lex_index(docs, tokenize=tx.tok_ws)
    asked = spark.createDataFrame([(1, "a")], "query_id long, query string")
    rows = sorted((r["rank"], r["chunk_id"], r["score"]) for r in lexical.lex_topk(index, asked, k=2).collect())
    assert [r[1] for r in rows] == [7, 1] and rows[0][2] == 0 and rows[1][2] < 0


def test_filters_apply_after_scoring(spark):
    docs = spark.createDataFrame([(1, "a b", "x"), (2, "a", "y"), (3, "c", "y")], "chunk_id long, content string, category string")
    index = lexical.lex_index(docs, tokenize=tx.tok_ws, carry=("category",))
    asked = spark.createDataFrame([(1, "b c", "y"), (2, "b c", None)], "query_id long, query string, category string")
    rows = lexical.lex_topk(index, asked, k=5, filters=("category",)).collect()
    assert {r["chunk_id"] for r in rows if r["query_id"] == 1} == {2, 3}
    assert {r["chunk_id"] for r in rows if r["query_id"] == 2} == {1, 2, 3}


def vec_rows(spark, n, d, key, seed):
    rng = np.random.default_rng(seed)
    return spark.createDataFrame([(i, rng.normal(size=d).tolist()) for i in range(n)], f"{key} long, vector array<double>")


def test_blocks_and_tiles_change_nothing(spark, monkeypatch):
    q, c = vec_rows(spark, 90, 6, "query_id", 1), vec_rows(spark, 170, 6, "chunk_id", 2)
    a = vectors.vec_topk_dense(q, c, 7).collect()
    monkeypatch.setattr(vectors, "SCORE_CELLS", 100)
    b = vectors.vec_topk_dense(q, c, 7, query_cells=120, shares=3).collect()
    assert sorted((r["query_id"], r["rank"], r["chunk_id"]) for r in a) == sorted((r["query_id"], r["rank"], r["chunk_id"]) for r in b)
    assert len(a) == 630


def as_rows(df):
    return sorted((r["query_id"], r["rank"], r["chunk_id"], round(r["score"], 9)) for r in df.collect())


def test_three_by_three_tiles(spark):
    """Filters, string ids and few queries give the same rows over nine tiles as over one."""
    q = vec_rows(spark, 30, 5, "query_id", 3).selectExpr("query_id", "vector", "if(query_id % 3 = 0, null, cast(query_id % 2 as string)) as lang")
    c = vec_rows(spark, 200, 5, "chunk_id", 4).selectExpr("concat('c', chunk_id) as chunk_id", "vector", "cast(chunk_id % 2 as string) as lang")
    one = vectors.vec_topk_dense(q, c, 4, filters=("lang",), shares=1)
    nine = vectors.vec_topk_dense(q, c, 4, filters=("lang",), query_cells=50, shares=3)
    assert as_rows(one) == as_rows(nine) and one.count() == 120
    assert vectors.vec_topk_dense(q.where("false"), c, 4).count() == vectors.vec_topk_dense(q, c.where("false"), 4).count() == 0


def test_inverted_file(spark):
    """Without a limit the widened search is exact and certain, with one it says which queries are not."""
    rng = np.random.default_rng(2)
    centres = rng.normal(size=(12, 8)) * 3
    rows = [(i, (centres[i % 12] + rng.normal(size=8) * 0.4).tolist()) for i in range(600)] + [(900, [0.0] * 8)]
    c = spark.createDataFrame(rows, "chunk_id long, vector array<double>")
    q = spark.createDataFrame([(i, (centres[i % 12] + rng.normal(size=8) * 0.4).tolist()) for i in range(24)], "query_id long, vector array<double>")
    index = vectors.ivf_build(c, cells=12)
    exact = as_rows(vectors.vec_topk_dense(q, c, 5))
    found, went = vectors.vec_topk_ann(q, index, 5, first=0.01, most=None)
    assert as_rows(found) == exact and all(r["certain"] for r in went.collect())
    assert max(r["share"] for r in went.collect()) < 0.5  # clusters: the bound shuts most cells
    found, went = vectors.vec_topk_ann(q, index, 5, first=0.01, most=0.1)
    sure = {r["query_id"] for r in went.collect() if r["certain"]}
    assert [r for r in as_rows(found) if r[0] in sure] == [r for r in exact if r[0] in sure]
    found, _ = vectors.vec_topk_ann(q, index, 1000, most=None)  # more than there are
    assert found.count() == 24 * 601


def lexical_corpus(spark, n=900):
    rng = random.Random(7)
    words = [f"w{int(rng.paretovariate(0.6))}" for _ in range(4000)]
    return spark.createDataFrame([(i, " ".join(rng.choice(words) for _ in range(rng.randint(0, 30))), "ab"[i % 2]) for i in range(n)], "chunk_id long, content string, category string")


def leaf_rows(df):
    """Rows that the scan of a plan without shuffles gave."""
    df.collect()
    plan = df._jdf.queryExecution().executedPlan()
    leaves = plan.collectLeaves()
    return sum(leaves.apply(i).metrics().apply("numOutputRows").value() for i in range(leaves.size()))


def test_stored_index_equals_the_text(spark, tmp_path):
    chunks = lexical_corpus(spark)
    index = lexical.lex_index(chunks, tokenize=tx.tok_ws, carry=("category",))
    stored = lexical.store_index(index, str(tmp_path), buckets=3)
    asked = spark.createDataFrame([(1, "w1 w2 w3", "a"), (2, "w7 w7 w9 nothing", None), (3, "absent words", None), (4, "w40 w1", "b")], "query_id long, query string, category string")
    for filters in ((), ("category",)):
        want = as_rows(lexical.lex_topk(index, asked, 10, filters=filters))
        assert as_rows(lexical.lex_topk(stored, asked, 10, filters=filters)) == want
        assert as_rows(lexical.lex_topk(stored, asked, 10, filters=filters, skip=True)) == want
    where = F.col("category") == "a"
    want = as_rows(lexical.lex_topk(index, asked, 3, where=where, drop_zero=True))
    assert as_rows(lexical.lex_topk(stored, asked, 3, where=where, drop_zero=True, skip=True)) == want
    with pytest.raises(ValueError):
        lexical.lex_topk(index, asked, 3, skip=True)


def test_search_plan_reads_no_text_and_few_postings(spark, tmp_path):
    stored = lexical.store_index(lexical.lex_index(lexical_corpus(spark, 6000), tokenize=tx.tok_ws), str(tmp_path), buckets=2)
    asked = spark.createDataFrame([(1, "w1000")], "query_id long, query string")
    plan = lexical.lex_topk(stored, asked, 5)._jdf.queryExecution().executedPlan().toString()
    assert "content" not in plan
    assert "slot" in plan and "PushedFilters" in plan
    total = stored.terms.count()
    few = leaf_rows(lexical.in_slots(stored.terms, lexical.asked_slots(spark.createDataFrame([("w1000",)], "token string"))))
    many = leaf_rows(lexical.in_slots(stored.terms, lexical.asked_slots(spark.createDataFrame([(f"w{i}",) for i in range(1, 60)], "token string"))))
    assert few < many <= total and few < 0.2 * total


def test_blocks_below_the_kth_score_are_skipped(spark, tmp_path):
    """Only a few blocks hold the rare word often, so the others are shut."""
    rows = [(i, "common " * (1 + i % 5) + ("rare " * 8 if i % 1000 == 3 else "")) for i in range(6000)]
    stored = lexical.store_index(lexical.lex_index(spark.createDataFrame(rows, "chunk_id long, content string"), tokenize=tx.tok_ws), str(tmp_path), buckets=2)
    bounds = stored.blocks.where("token = 'rare'").selectExpr("1L as query_id", "block", "cast(max_tf as double) as bound")
    bounds = bounds.unionByName(stored.blocks.where("token = 'common'").join(bounds.select("block"), "block", "left_anti").selectExpr("1L as query_id", "block", "0.5D as bound"))
    weights = spark.createDataFrame([(1, "rare", 1.0)], "query_id long, token string, w double")
    score = lambda side, on: stored.terms.join(side, on).groupBy("chunk_id", "query_id").agg(F.sum(F.col("w") * F.col("tf")).alias("score"))
    kept = lexical.reaching(bounds, weights, score, 2).select("block").distinct().count()
    assert 0 < kept <= 6 < bounds.count()


def ranked(spark, rows):
    return spark.createDataFrame([(1, c, s, r, 1.0) for s, c, r in rows], "query_id long, chunk_id string, source string, rank int, score double")


def test_rrf_values_ties_and_duplicates(spark):
    rows = fusion.fuse_rrf_weighted(ranked(spark, [("dense", "a", 1), ("dense", "b", 2), ("sparse", "b", 1), ("sparse", "c", 2), ("bm25", "a", 1), ("bm25", "c", 2)])).collect()
    got = {r["chunk_id"]: r for r in rows}
    assert got["a"]["rrf_score"] == pytest.approx(2 / 61) and got["b"]["rrf_score"] == pytest.approx(1 / 61 + 1 / 62)
    assert got["a"]["sparse_rank"] is None and list(got["a"]["retrievers"]) == ["dense", "bm25"]
    twice = fusion.fuse_rrf_weighted(ranked(spark, [("dense", "a", 1), ("dense", "a", 2), ("sparse", "a", 1)])).collect()
    assert len(twice) == 1 and twice[0]["rrf_score"] == pytest.approx(2 / 61) and twice[0]["dense_rank"] == 1
    tie = fusion.fuse_rrf_weighted(ranked(spark, [("dense", "z", 1), ("sparse", "a", 1)])).orderBy("rrf_rank").collect()
    assert [r["chunk_id"] for r in tie] == ["a", "z"]


def test_overlap(spark):
    rows = [(s, str(i), i - lo + 1) for s, lo in (("dense", 0), ("sparse", 10), ("bm25", 20)) for i in range(lo, lo + 30)]
    out = fusion.source_overlap(ranked(spark, rows), spark.createDataFrame([(1,), (2,)], "query_id long")).orderBy("query_id").collect()
    assert out[0]["all_three"] == 10 and out[1]["empty_sources"] == "dense,sparse,bm25"


def test_metrics(spark):
    r = spark.createDataFrame([(1, c, i) for i, c in enumerate("xabz", 1)], "query_id long, chunk_id string, rank int")
    g = spark.createDataFrame([(1, "a"), (1, "b"), (1, "q")], "query_id long, chunk_id string")
    row = evaluate.eval_ranking_v2(r, g, cutoffs=(2, 3)).first()
    assert row["mrr_2"] == 0.5 and row["recall_2"] == pytest.approx(1 / 3) and row["recall_3"] == pytest.approx(2 / 3)


def test_latency(spark):
    row = evaluate.latency_summary(spark.createDataFrame([(float(v),) for v in (1, 2, 3, 4, 100)], "v double"), "v").first()
    assert (row["mean"], row["median"], row["p95"]) == (22, 3, 100)


def test_token_f1(spark):
    pairs = spark.createDataFrame([(1, "ƏMSAL 12,5", "əmsal 12,5"), (2, "", "x"), (3, "a a b", "a c")], "query_id long, answer string, reference string")
    got = {r["query_id"]: r["token_f1"] for r in compare.token_f1(pairs).collect()}
    assert got[1] == 1.0 and got[2] == 0.0 and got[3] == pytest.approx(0.4)


def test_near_duplicates_against_brute_force(spark):
    rng = random.Random(5)
    base = [[f"t{rng.randint(0, 200)}" for _ in range(40)] for _ in range(15)]
    texts = {}
    for i in range(90):
        words = list(base[i % 15])
        for _ in range(rng.randint(0, 3)):
            words[rng.randrange(40)] = f"n{rng.randint(0, 50)}"
        texts[i] = " ".join(words)
    sets = {i: frozenset(t.split()) for i, t in texts.items()}
    rep = {}
    for i in sorted(sets):
        rep.setdefault(sets[i], i)
    want = {(rep[s], i) for i, s in sets.items() if rep[s] != i}
    reps = sorted(rep.values())
    want |= {(a, b) for a in reps for b in reps if a < b and len(sets[a] & sets[b]) / len(sets[a] | sets[b]) > 0.8}
    got = gold.near_duplicates(spark.createDataFrame(list(texts.items()), "id long, text string"), "id", "text", 0.8)
    assert {(r["a"], r["b"]) for r in got.collect()} == want


def test_expansion_caps(spark):
    seeds = spark.createDataFrame([(1, "s", 1)], "query_id long, chunk_id string, final_rank int")
    edges = spark.createDataFrame([("s", "reference", t, "outbound", 1.0, True, i) for i, t in enumerate("ab")], "src string, rel string, dst string, direction string, confidence double, resolved boolean, edge_no int")
    arts = spark.createDataFrame([(t, "child", 1, None, t) for t in "sab"], "artifact_id string, artifact_type string, split_count int, continuation_of string, logical_chunk_id string")
    chosen, notes = evidence.expand(seeds, evidence.inspect_edges(seeds, edges, arts), per_seed=8, per_query=1)
    assert chosen.filter("role = 'expanded'").count() == 1
    assert notes.filter("reason = 'global expansion cap'").count() == 1


def test_budget_skips_and_goes_on(spark):
    items = spark.createDataFrame([(1, 1, 5), (1, 2, 9), (1, 3, 4)], "query_id long, position int, cost long")
    rows = evidence.fit_budget(items, F.lit(10).cast("long")).orderBy("position").collect()
    assert [r["kept"] for r in rows] == [True, False, True] and rows[2]["evidence_id"] == "E2"


def test_percentile_upper(spark):
    from corpusloom.operators import quality

    rng = random.Random(1)
    values = [rng.randint(0, 20) for _ in range(101)]
    rows = spark.createDataFrame([(v,) for v in values], "v int")
    want = sorted(values)[min(100, int(100 * 0.95 + 0.999999))]
    assert quality.percentile_upper(rows, "v", 0.95).first()["v"] == want


def test_pairs_are_scored_by_all_tasks(spark):
    """A few megabytes of pairs are one partition to adaptive execution; scoring them there was one task."""
    from corpusloom.operators import rerank

    rows = [(q, c, "bir iki", f"bir {c}") for q in range(8) for c in range(30)]
    pairs = spark.createDataFrame(rows, "query_id int, chunk_id int, query string, text string").coalesce(1)
    plan = rerank.rerank(pairs)._jdf.queryExecution().optimizedPlan().toString()
    assert "RepartitionByExpression" in plan
    assert rerank.rerank(pairs, top=5).count() == 40


def test_a_batch_leaves_no_row_for_a_pair(spark, tmp_path):
    """Of 2,000 documents that all hold the words of 20 queries, tasks give k rows a query, not 40,000 sums."""
    rows = [(f"d{i:05d}", "common shared " * (1 + i % 7) + f"w{i % 50}") for i in range(2000)]
    chunks = spark.createDataFrame(rows, "chunk_id string, content string").repartition(4)
    stored = lexical.store_index(lexical.lex_index(chunks, tokenize=tx.tok_ws), str(tmp_path), postings=False, bounds=False)
    asked = spark.createDataFrame([(q, f"common shared w{q}") for q in range(20)], "query_id long, query string")
    found = lexical.lex_topk(stored, asked, 3)
    got = as_rows(found)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "MapInArrow" in plan and "Generate" not in plan and "HashAggregate" not in plan
    for q in (0, 7, 19):
        assert [c for i, _, c, _ in got if i == q] == brute_bm25(dict(rows), f"common shared w{q}", 3)


def test_products_with_negative_weights_and_ties(spark, monkeypatch):
    """Small matrices, shared terms whose sum is zero or negative, null filters, and ties by the smaller id."""
    from corpusloom.operators import products

    monkeypatch.setattr(products, "CELLS", 12)
    rows = [(i, ["a"] * (i % 3 > 0) + ["b"] * (i % 2) + ["c"] * (i % 5 == 0), [1.0] * ((i % 3 > 0) + i % 2 + (i % 5 == 0)), "xy"[i % 2]) for i in range(60)]
    frame = spark.createDataFrame(rows, "chunk_id long, terms array<string>, weights array<double>, lang string").repartition(3)
    weights = {1: {"a": 1.0, "b": -1.0}, 2: {"b": -2.0, "c": 0.5}, 3: {"a": 1.0}}
    langs = {1: None, 2: "x", 3: "y"}
    asked = [{"query_id": q, "q_lang": v} for q, v in langs.items()]
    sent = products.Batch(asked, [{"query_id": q, "term": t, "w": w} for q, ws in weights.items() for t, w in ws.items()], "term", ["lang"])
    for only, keep in ((None, lambda s, held: True), ("shared", lambda s, held: held), ("positive", lambda s, held: s > 0)):
        got = {}
        for r in lexical.top_k(products.top_rows(frame, sent, 7, ["lang"], only), 7).collect():
            got.setdefault(r["query_id"], {})[r["rank"]] = (r["chunk_id"], r["score"])
        for q, ws in weights.items():
            want = [(i, sum(ws.get(t, 0) for t in ts), any(t in ws for t in ts)) for i, ts, _, lang in rows if langs[q] in (None, lang)]
            want = sorted(((i, s) for i, s, held in want if keep(s, held)), key=lambda x: (-x[1], x[0]))[:7]
            assert [got.get(q, {})[n] for n in sorted(got.get(q, {}))] == want, (only, q)


def test_encoding_opens_few_texts_at_a_time(spark, monkeypatch):
    """Vectors leave the worker after so many bytes of text, not after a whole batch of rows; the rows are the same."""
    from corpusloom.operators import plugins

    rows = spark.createDataFrame([(i, f"word{i} " * (i % 9), ["x", None][i % 2]) for i in range(200)], "chunk_id long, text string, note string").coalesce(1)
    want = sorted(map(repr, plugins.embed_batch(rows, "text").collect()))
    monkeypatch.setattr(plugins, "ENCODED_BYTES", 300)
    small = plugins.embed_batch(rows, "text")
    assert sorted(map(repr, small.collect())) == want and len(want) == 200

    plugins.register_encoder("call-size", lambda: lambda texts, mode: ([[float(len(texts))] for _ in texts], [([], []) for _ in texts]))
    monkeypatch.setattr(plugins, "ENCODED_BYTES", 1)
    assert {r["dense"][0] for r in plugins.embed_batch(rows, "text", "call-size").where("length(text) > 0").collect()} <= {1.0, 2.0}
