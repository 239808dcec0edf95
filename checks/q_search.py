"""Search over documents with planted passages as questions."""

from __future__ import annotations

from pyspark.sql import functions as F

from corpusloom.functions import text as tx
from corpusloom.operators import fusion, lexical, plugins, rerank, vectors
from corpusloom.plans import hybrid
from corpusloom.session import shared_folder

from .bindings import GOLD_SQL, WS, documents, gold, passages, questions, sql_tok_legal
from .registry import _staged, query, staged, table

# ---------------------------------------------------------------- SQL pieces


def lex_sql(tokens_of=sql_tok_legal, b: float = 0.75, tag: str = "bm25", k: int = 30, where: str = "true") -> str:
    """CTEs ending in ``{tag}(query_id, chunk_id, score, rank)``; brute force."""
    return f"""
{tag}_dt AS (SELECT doc_id AS chunk_id, {tokens_of('text')} AS toks, source, lang FROM documents),
{tag}_qt AS (SELECT query_id, token, count(*) AS qtf FROM (SELECT item_id AS query_id, unnest({tokens_of('text')}) AS token FROM benchmark) GROUP BY ALL),
{tag}_terms AS (SELECT chunk_id, dl, token, count(*) AS tf FROM (SELECT chunk_id, len(toks) AS dl, unnest(toks) AS token FROM {tag}_dt) GROUP BY ALL),
{tag}_stats AS (SELECT count(*) AS n, sum(len(toks)) / count(*) AS avgdl FROM {tag}_dt),
{tag}_raw AS (SELECT token, ln(n - df + 0.5) - ln(df + 0.5) AS idf FROM (SELECT token, count(*) AS df FROM {tag}_terms GROUP BY token), {tag}_stats),
{tag}_idf AS (SELECT token, CASE WHEN idf < 0 THEN 0.25 * (SELECT avg(idf) FROM {tag}_raw) ELSE idf END AS idf FROM {tag}_raw),
{tag}_s AS (SELECT query_id, chunk_id, sum(qtf * idf * tf * 2.5 / (tf + 1.5 * (1 - {b} + {b} * dl / avgdl))) AS score
   FROM {tag}_terms JOIN {tag}_idf USING (token) JOIN {tag}_qt USING (token), {tag}_stats GROUP BY query_id, chunk_id),
{tag} AS (SELECT query_id, chunk_id, score, rank FROM (
   SELECT q.query_id, d.chunk_id, coalesce(score, 0.0) AS score,
          row_number() OVER (PARTITION BY q.query_id ORDER BY round(coalesce(score, 0.0), 10) DESC, d.chunk_id) AS rank
   FROM (SELECT DISTINCT query_id FROM {tag}_qt) q CROSS JOIN {tag}_dt d LEFT JOIN {tag}_s s ON s.query_id = q.query_id AND s.chunk_id = d.chunk_id
   WHERE {where}) WHERE rank <= {k})
"""


def sql_tok_ws(x: str) -> str:
    return f"list_filter(string_split_regex(lower({x}), '[{WS}]+'), lambda w: w <> '')"


def counts_sql(name: str, src: str, key: str) -> str:
    return f"""
{name}_tf AS (SELECT id, token, count(*) AS tf, md5(token) AS h FROM (SELECT {key} AS id, unnest({sql_tok_legal('text')}) AS token FROM {src}) GROUP BY id, token),
{name}_sparse AS (SELECT id, idx, (1 + ln(sum(tf)))::FLOAT::DOUBLE AS val FROM (SELECT id, tf, (('0x' || substr(h, 1, 8))::BIGINT & 2147483647) AS idx FROM {name}_tf) GROUP BY id, idx),
{name}_raw AS (SELECT id, ('0x' || substr(h, 1, 8))::BIGINT % 64 AS dim, sum(CASE WHEN ('0x' || substr(h, 9, 1))::INT < 8 THEN tf ELSE -tf END)::DOUBLE AS v FROM {name}_tf GROUP BY ALL),
{name}_len AS (SELECT id, sqrt(sum(v * v)) AS n FROM {name}_raw GROUP BY id),
{name}_unit AS (SELECT k.{key} AS id, coalesce(r.dim, 0) AS dim, CASE WHEN coalesce(n, 0) = 0 THEN 1.0 ELSE (r.v / n)::FLOAT::DOUBLE END AS v
   FROM {src} k LEFT JOIN {name}_len l ON l.id = k.{key} LEFT JOIN {name}_raw r ON r.id = k.{key} AND l.n > 0),
{name}_norm AS (SELECT id, sqrt(sum(v * v)) AS n FROM {name}_unit GROUP BY id)
"""


VECTORS_SQL = counts_sql("dv", "documents", "doc_id") + "," + counts_sql("qv", "benchmark", "item_id")

DENSE_SQL = """
dense_s AS (SELECT query_id, chunk_id, coalesce(dot, 0.0) / (qn.n * dn.n) AS score FROM
   (SELECT q.item_id AS query_id, d.doc_id AS chunk_id FROM benchmark q CROSS JOIN documents d) p
   JOIN qv_norm qn ON qn.id = query_id JOIN dv_norm dn ON dn.id = chunk_id
   LEFT JOIN (SELECT q.id AS query_id, d.id AS chunk_id, sum(q.v * d.v) AS dot FROM qv_unit q JOIN dv_unit d USING (dim) GROUP BY ALL) USING (query_id, chunk_id)),
dense AS (SELECT query_id, chunk_id, score, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 10) DESC, chunk_id) AS rank
   FROM dense_s QUALIFY rank <= 30)
"""

SPARSE_SQL = """
sparse_s AS (SELECT q.id AS query_id, d.id AS chunk_id, sum(q.val * d.val) AS score FROM qv_sparse q JOIN dv_sparse d USING (idx) GROUP BY ALL),
sparse AS (SELECT query_id, chunk_id, score, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 10) DESC, chunk_id) AS rank
   FROM sparse_s QUALIFY rank <= 30)
"""

RANKED_SQL = """
ranked AS (SELECT 'dense' AS source, * FROM dense UNION ALL SELECT 'sparse', * FROM sparse UNION ALL SELECT 'bm25', * FROM bm25)
"""

FUSED_SQL = """
fused_s AS (SELECT query_id, chunk_id,
   min(CASE WHEN source = 'dense' THEN rank END) AS dense_rank, min(CASE WHEN source = 'sparse' THEN rank END) AS sparse_rank, min(CASE WHEN source = 'bm25' THEN rank END) AS bm25_rank,
   min(CASE WHEN source = 'dense' THEN score END) AS dense_score, min(CASE WHEN source = 'sparse' THEN score END) AS sparse_score, min(CASE WHEN source = 'bm25' THEN score END) AS bm25_score
   FROM ranked GROUP BY ALL),
fused_r AS (SELECT *, coalesce(1.0 / (60 + dense_rank), 0) + coalesce(1.0 / (60 + sparse_rank), 0) + coalesce(1.0 / (60 + bm25_rank), 0) AS rrf_score FROM fused_s),
fused AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(rrf_score, 12) DESC, chunk_id) AS rrf_rank FROM fused_r)
"""


def rerank_sql(depth: int = 15) -> str:
    text = "'Document: ' || d.source || chr(10) || 'Locator: ' || d.doc_id || chr(10) || 'Hierarchy: chapter=' || d.lang || ' — ' || d.source || chr(10) || 'Content: ' || d.text"
    return f"""
qwords AS (SELECT DISTINCT item_id AS query_id, unnest({sql_tok_legal('text')}) AS token FROM benchmark),
qsize AS (SELECT query_id, count(*) AS n FROM qwords GROUP BY query_id),
pairs AS (SELECT f.query_id, f.chunk_id, f.rrf_rank, f.rrf_score, {sql_tok_legal(text)} AS toks FROM fused f JOIN documents d ON d.doc_id = f.chunk_id WHERE rrf_rank <= {depth}),
pscore AS (SELECT p.query_id, p.chunk_id, p.rrf_rank, p.rrf_score, count(w.token) / max(s.n) AS reranker_score
   FROM pairs p JOIN qsize s USING (query_id) LEFT JOIN qwords w ON w.query_id = p.query_id AND list_contains(p.toks, w.token) GROUP BY ALL),
reranked AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(reranker_score, 10) DESC, chunk_id) AS reranker_rank FROM pscore)
"""


# ------------------------------------------------------------- Spark pieces


def points(spark, sf):
    """Stored vectors of the documents, as an embedding run would leave them."""
    rows = documents(spark, sf).select(F.col("doc_id").alias("chunk_id"), "text", F.col("source").alias("category"), "lang")
    return staged(spark, sf, "points", lambda: plugins.embed_batch(rows, "text").drop("text"))


def encoded_questions(spark, sf):
    return staged(spark, sf, "questions", lambda: plugins.embed_batch(questions(spark, sf), "query", mode="query"))


def chunk_table(spark, sf):
    d = documents(spark, sf)
    return d.select(
        F.col("doc_id").alias("chunk_id"),
        F.col("text").alias("content"),
        F.col("source").alias("document_title"),
        F.col("doc_id").cast("string").alias("canonical_locator"),
        F.struct(F.struct(F.col("lang").alias("number"), F.col("source").alias("title")).alias("chapter")).alias("hierarchy"),
        F.lit("2.0").alias("schema_version"),
        F.col("source").alias("parent_chunk_id"),
        F.col("lang"),
    )


def stored_index(spark, sf, name, build):
    """A stored index, written once per session. The questions are a batch, which reads no postings."""
    key = (spark.sparkContext.applicationId, sf, name)
    if key not in _staged:
        _staged[key] = build()
    return _staged[key]


def bm25_index(spark, sf):
    def build():
        chunks = documents(spark, sf).select(F.col("doc_id").alias("chunk_id"), F.col("text").alias("content"), F.col("source").alias("category"), "lang")
        return lexical.store_index(lexical.lex_index(chunks, carry=("category", "lang")), shared_folder(spark), postings=False, bounds=False)

    return stored_index(spark, sf, "bm25", build)


def bounded_index(spark, sf):
    """The same index with block bounds."""
    return stored_index(spark, sf, "bm25-bounds", lambda: lexical.with_bounds(bm25_index(spark, sf), shared_folder(spark)))


def v1_index(spark, sf):
    def build():
        return lexical.store_index(lexical.lex_index(passages(spark, sf), tokenize=tx.tok_ws, compose=False), shared_folder(spark), postings=False, bounds=False)

    return stored_index(spark, sf, "bm25-v1", build)


RANKS = ["dense_rank", "sparse_rank", "bm25_rank"]


def hybrid_run(spark, sf):
    """One retrieval batch; its ranked lists are staged for the queries that read them."""
    asked, pts, chunks = encoded_questions(spark, sf), points(spark, sf), chunk_table(spark, sf)
    ranked = staged(spark, sf, "ranked", lambda: hybrid.sources(asked, bm25_index(spark, sf), pts, 30))
    return hybrid.complete(ranked, asked, chunks, stage=lambda df, name: staged(spark, sf, name, lambda: df))


# ------------------------------------------------------------------ queries

INDEX_TAIL = """SELECT token, df, idf, n, avgdl FROM
   (SELECT token, count(*) AS df FROM bm25_terms GROUP BY token) JOIN bm25_idf USING (token), bm25_stats"""


@query("lex_index", f"WITH {lex_sql()} {INDEX_TAIL}")
def lex_index(spark, sf):
    return lexical.idf_table(bm25_index(spark, sf)).select("token", "df", "idf", "n", "avgdl")


@query("lex_topk_v2", f"WITH {lex_sql(k=10)} SELECT * FROM bm25")
def lex_topk_v2(spark, sf):
    return lexical.lex_topk(bm25_index(spark, sf), questions(spark, sf), k=10)


@query("lex_topk_blocks", f"WITH {lex_sql(k=10)} SELECT * FROM bm25")
def lex_topk_blocks(spark, sf):
    """The same rows when blocks of documents that can't reach a query's ten best are left unread."""
    return lexical.lex_topk(bounded_index(spark, sf), questions(spark, sf), k=10, skip=True)


@query("lex_topk_v1", f"WITH {lex_sql(sql_tok_ws, k=10)} SELECT * FROM bm25")
def lex_topk_v1(spark, sf):
    return lexical.lex_topk(v1_index(spark, sf), questions(spark, sf), k=10)


FILTER_SQL = lex_sql(k=10, where="(q.query_id % 3 = 0 OR d.lang = CASE q.query_id % 3 WHEN 1 THEN 'en' ELSE 'de' END)")


@query("filter_payload", f"WITH {FILTER_SQL} SELECT * FROM bm25")
def filter_payload(spark, sf):
    asked = questions(spark, sf).withColumn(
        "lang", F.when(F.col("query_id") % 3 == 1, "en").when(F.col("query_id") % 3 == 2, "de")
    )
    return lexical.lex_topk(bm25_index(spark, sf), asked, k=10, filters=("lang",))


CENTROID_SQL = """
cent AS (SELECT label AS query_id, i, avg(embedding[i]::DOUBLE) AS v FROM embeddings, unnest(range(1, 65)) AS u(i) GROUP BY ALL),
cn AS (SELECT query_id, sqrt(sum(v * v)) AS n FROM cent GROUP BY ALL),
ev AS (SELECT vec_id AS chunk_id, label, i, embedding[i]::DOUBLE AS v FROM embeddings, unnest(range(1, 65)) AS u(i)),
en AS (SELECT chunk_id, sqrt(sum(v * v)) AS n FROM ev GROUP BY ALL),
es AS (SELECT query_id, chunk_id, sum(c.v * e.v) / max(cn.n * en.n) AS score FROM cent c JOIN ev e USING (i) JOIN cn USING (query_id) JOIN en USING (chunk_id) GROUP BY ALL)
"""


def centroids(spark, sf):
    """Mean vector per label: a query batch that depends on the whole table."""
    e = table(spark, sf, "embeddings")
    cells = e.select("label", F.posexplode("embedding").alias("i", "x")).groupBy("label", "i").agg(
        F.avg(F.col("x").cast("double")).alias("v")
    )
    ordered = F.array_sort(F.collect_list(F.struct("i", "v")))
    return cells.groupBy("label").agg(F.transform(ordered, lambda c: c["v"]).alias("vector")).select(
        F.col("label").alias("query_id"), "vector"
    )


def vector_corpus(spark, sf):
    return table(spark, sf, "embeddings").select(F.col("vec_id").alias("chunk_id"), F.col("embedding").alias("vector"), "label")


@query(
    "vec_topk_dense",
    f"WITH {CENTROID_SQL} SELECT query_id, chunk_id, score, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 10) DESC, chunk_id) AS rank FROM es QUALIFY rank <= 30",
)
def vec_topk_dense(spark, sf):
    return vectors.vec_topk_dense(centroids(spark, sf), vector_corpus(spark, sf), k=30)


@query(
    "vec_topk_dense_filtered",
    f"""WITH {CENTROID_SQL}, kept AS (SELECT es.* FROM es JOIN embeddings ON vec_id = chunk_id WHERE label = query_id)
    SELECT query_id, chunk_id, score, 1 - score AS distance, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 10) DESC, chunk_id) AS rank FROM kept QUALIFY rank <= 10""",
)
def vec_topk_dense_filtered(spark, sf):
    asked = centroids(spark, sf).withColumn("label", F.col("query_id"))
    found = vectors.vec_topk_dense(asked, vector_corpus(spark, sf), k=10, filters=("label",))
    return found.withColumn("distance", 1 - F.col("score"))


def ann_run(spark, sf):
    """The questions searched in an inverted file of all documents: rows found, how it went, and the exact rows."""
    corpus = points(spark, sf).select("chunk_id", F.col("dense").alias("vector"))
    asked = encoded_questions(spark, sf).select("query_id", F.col("dense").alias("vector"))
    found, went = vectors.vec_topk_ann(asked, vectors.ivf_build(corpus), k=10)
    return found, went, vectors.vec_topk_dense(asked, corpus, k=10)


@query("vec_topk_ann")
def vec_topk_ann(spark, sf):
    return ann_run(spark, sf)[0]


@query(
    "vec_ann_recall",
    f"""WITH {VECTORS_SQL}, {DENSE_SQL} SELECT count(DISTINCT query_id) AS queries, count(*) AS exact_rows, true AS recall_is_high, true AS few_pairs FROM dense WHERE rank <= 10""",
)
def vec_ann_recall(spark, sf):
    """Recall of at least 0.9 against the exact result, with less than 0.2 of all pairs compared."""
    found, went, exact = ann_run(spark, sf)
    hit = exact.join(found.select("query_id", "chunk_id", F.lit(1).alias("hit")), ["query_id", "chunk_id"], "left")
    rows = hit.agg(F.countDistinct("query_id").alias("queries"), F.count(F.lit(1)).alias("exact_rows"), (F.count("hit") / F.count(F.lit(1)) >= 0.9).alias("recall_is_high"))
    return rows.crossJoin(F.broadcast(went.agg((F.avg("share") < 0.2).alias("few_pairs"))))


@query("vec_topk_sparse", f"WITH {VECTORS_SQL}, {SPARSE_SQL} SELECT * FROM sparse")
def vec_topk_sparse(spark, sf):
    return lexical.vec_topk_sparse(encoded_questions(spark, sf), points(spark, sf), k=30)


@query(
    "vec_batch",
    f"WITH {VECTORS_SQL}, {DENSE_SQL}, {SPARSE_SQL} SELECT 'dense' AS source, * FROM dense UNION ALL SELECT 'sparse', * FROM sparse",
)
def vec_batch(spark, sf):
    q, p = encoded_questions(spark, sf), points(spark, sf)
    dense = vectors.vec_topk_dense(
        q.select("query_id", F.col("dense").alias("vector")), p.select("chunk_id", F.col("dense").alias("vector")), 30
    )
    return fusion.tag({"dense": dense, "sparse": lexical.vec_topk_sparse(q, p, 30)})


ALL_SOURCES_SQL = f"{VECTORS_SQL}, {DENSE_SQL}, {SPARSE_SQL}, {lex_sql()}, {RANKED_SQL}"


@query(
    "fuse_rrf",
    f"""WITH {ALL_SOURCES_SQL}, f AS (SELECT query_id, chunk_id, sum(1.0 / (60 + rank)) AS rrf_score FROM ranked GROUP BY ALL)
    SELECT query_id, chunk_id, rrf_score, row_number() OVER (PARTITION BY query_id ORDER BY round(rrf_score, 12) DESC, chunk_id) AS rrf_rank FROM f QUALIFY rrf_rank <= 20""",
)
def fuse_rrf(spark, sf):
    return fusion.fuse_rrf(hybrid_run(spark, sf).ranked, top=20)


@query(
    "fuse_rrf_weighted",
    f"""WITH {ALL_SOURCES_SQL}, {FUSED_SQL} SELECT query_id, chunk_id, coalesce(dense_rank, -1) AS dense_rank, coalesce(sparse_rank, -1) AS sparse_rank, coalesce(bm25_rank, -1) AS bm25_rank, dense_score, sparse_score, bm25_score,
       1.0 / (60 + bm25_rank) AS bm25_contribution, concat_ws(',', CASE WHEN dense_rank IS NOT NULL THEN 'dense' END, CASE WHEN sparse_rank IS NOT NULL THEN 'sparse' END, CASE WHEN bm25_rank IS NOT NULL THEN 'bm25' END) AS retrievers,
       rrf_score, rrf_rank FROM fused WHERE rrf_rank <= 20""",
)
def fuse_rrf_weighted(spark, sf):
    out = fusion.fuse_rrf_weighted(hybrid_run(spark, sf).ranked, top=20)
    return out.na.fill(-1, RANKS).select(
        "query_id", "chunk_id", "dense_rank", "sparse_rank", "bm25_rank", "dense_score", "sparse_score", "bm25_score",
        "bm25_contribution", F.array_join("retrievers", ",").alias("retrievers"), "rrf_score", "rrf_rank",
    )


@query(
    "source_overlap",
    f"""WITH {ALL_SOURCES_SQL}, m AS (SELECT query_id, chunk_id, max((source = 'dense')::INT) AS d, max((source = 'sparse')::INT) AS s, max((source = 'bm25')::INT) AS b FROM ranked GROUP BY ALL)
    SELECT item_id AS query_id, coalesce(sum(d * s), 0)::BIGINT AS dense_sparse, coalesce(sum(d * b), 0)::BIGINT AS dense_bm25, coalesce(sum(s * b), 0)::BIGINT AS sparse_bm25, coalesce(sum(d * s * b), 0)::BIGINT AS all_three,
       count(chunk_id) AS fused_unique, coalesce(sum(d), 0)::BIGINT AS dense_count, coalesce(sum(s), 0)::BIGINT AS sparse_count, coalesce(sum(b), 0)::BIGINT AS bm25_count, '' AS empty_sources
    FROM benchmark LEFT JOIN m ON query_id = item_id GROUP BY item_id""",
)
def source_overlap(spark, sf):
    out = fusion.source_overlap(hybrid_run(spark, sf).ranked, questions(spark, sf))
    return out.drop("dense_duplicates", "sparse_duplicates", "bm25_duplicates")


@query(
    "hydrate",
    f"""WITH {ALL_SOURCES_SQL}, {FUSED_SQL} SELECT query_id, chunk_id, rrf_rank, md5(text) AS content_md5, source AS document_title FROM fused JOIN documents ON doc_id = chunk_id WHERE rrf_rank <= 15""",
)
def hydrate(spark, sf):
    short = hybrid_run(spark, sf).fused.filter("rrf_rank <= 15").select("query_id", "chunk_id", "rrf_rank")
    full = rerank.hydrate(short, chunk_table(spark, sf))
    return full.select("query_id", "chunk_id", "rrf_rank", F.md5("content").alias("content_md5"), "document_title")


@query(
    "txt_rerank_input",
    """SELECT doc_id AS chunk_id, md5('Document: ' || source || chr(10) || 'Locator: ' || doc_id || chr(10) || 'Hierarchy: chapter=' || lang || ' — ' || source || chr(10) || 'Content: ' || text) AS text_md5 FROM documents""",
)
def txt_rerank_input(spark, sf):
    chunks = chunk_table(spark, sf)
    return chunks.select("chunk_id", F.md5(rerank.rerank_text(chunks)).alias("text_md5"))


@query(
    "rerank",
    f"WITH {ALL_SOURCES_SQL}, {FUSED_SQL}, {rerank_sql()} SELECT query_id, chunk_id, reranker_score, reranker_rank FROM reranked WHERE reranker_rank <= 5",
)
def rerank_query(spark, sf):
    return hybrid_run(spark, sf).final.select("query_id", "chunk_id", "reranker_score", "reranker_rank")


@query(
    "rerank_depths",
    f"""WITH {ALL_SOURCES_SQL}, {FUSED_SQL}, {rerank_sql(20)}, d AS (SELECT query_id, chunk_id, reranker_score, depth FROM pscore, unnest([5, 10, 15, 20]) AS u(depth) WHERE rrf_rank <= depth)
    SELECT query_id, depth, chunk_id, count(*) OVER (PARTITION BY query_id, depth) AS reranked_count,
       row_number() OVER (PARTITION BY query_id, depth ORDER BY round(reranker_score, 10) DESC, chunk_id) AS final_rank FROM d QUALIFY final_rank <= 5""",
)
def rerank_depths(spark, sf):
    run = hybrid_run(spark, sf)
    short = run.fused.filter("rrf_rank <= 20").join(questions(spark, sf), "query_id")
    full = rerank.hydrate(short, chunk_table(spark, sf))
    scored = rerank.rerank(full.withColumn("text", rerank.rerank_text(full)))
    out = rerank.rerank_depths(scored, (5, 10, 15, 20), 5)
    return out.select("query_id", "depth", "chunk_id", "reranked_count", "final_rank")


@query(
    "fetch_payloads",
    f"""WITH {ALL_SOURCES_SQL}, {FUSED_SQL}, {rerank_sql()} SELECT query_id, chunk_id, reranker_rank, source AS document_title, lang, NULL::VARCHAR AS error
    FROM reranked JOIN documents ON doc_id = chunk_id WHERE reranker_rank <= 5""",
)
def fetch_payloads(spark, sf):
    finalists = hybrid_run(spark, sf).final.select("query_id", "chunk_id", "reranker_rank")
    out = rerank.fetch_payloads(finalists, chunk_table(spark, sf), ["content", "document_title", "canonical_locator"])
    return out.select("query_id", "chunk_id", "reranker_rank", "document_title", "lang", "error")


PARENTS_SQL = "parents AS (SELECT source AS parent_chunk_id, count(*) AS children_total, sum(n_chars)::BIGINT AS chars FROM documents WHERE source <> 'src1' GROUP BY source)"


@query(
    "resolve_parents",
    f"""WITH {ALL_SOURCES_SQL}, {FUSED_SQL}, {rerank_sql()}, {PARENTS_SQL},
    w AS (SELECT query_id, source AS parent_chunk_id, string_agg(chunk_id::VARCHAR, ',' ORDER BY chunk_id) AS children FROM reranked JOIN documents ON doc_id = chunk_id WHERE reranker_rank <= 5 GROUP BY ALL)
    SELECT query_id, parent_chunk_id, children, children_total, chars, CASE WHEN children_total IS NULL THEN 'parent not found' END AS warning FROM w LEFT JOIN parents USING (parent_chunk_id)""",
)
def resolve_parents(spark, sf):
    final = hybrid_run(spark, sf).final.select("query_id", "chunk_id")
    keyed = final.join(chunk_table(spark, sf).select("chunk_id", "parent_chunk_id"), "chunk_id")
    parents = (
        documents(spark, sf)
        .filter("source <> 'src1'")
        .groupBy(F.col("source").alias("parent_chunk_id"))
        .agg(F.count(F.lit(1)).alias("children_total"), F.sum("n_chars").alias("chars"))
    )
    return rerank.resolve_parents(keyed, parents)


V1_SOURCES = f"{VECTORS_SQL}, {DENSE_SQL}, {lex_sql(sql_tok_ws)}"


@query(
    "retrieve_hybrid_v1",
    f"""WITH {V1_SOURCES}, r AS (SELECT query_id, chunk_id, rank FROM dense WHERE rank <= 20 UNION ALL SELECT query_id, chunk_id, rank FROM bm25 WHERE rank <= 20),
    f AS (SELECT query_id, chunk_id, sum(1.0 / (60 + rank)) AS rrf_score FROM r GROUP BY ALL)
    SELECT query_id, chunk_id, rrf_score, row_number() OVER (PARTITION BY query_id ORDER BY round(rrf_score, 12) DESC, chunk_id) AS rrf_rank FROM f QUALIFY rrf_rank <= 10""",
)
def retrieve_hybrid_v1(spark, sf):
    return v1_fused(spark, sf, 20, 10)


def v1_fused(spark, sf, per_source, top):
    ranked = hybrid.sources(encoded_questions(spark, sf), v1_index(spark, sf), points(spark, sf), per_source, sparse=False)
    return fusion.fuse_rrf(ranked, top=top)


@query(
    "retrieve_hybrid_v1_rerank",
    f"""WITH {V1_SOURCES}, r AS (SELECT query_id, chunk_id, rank FROM dense UNION ALL SELECT query_id, chunk_id, rank FROM bm25),
    f AS (SELECT query_id, chunk_id, sum(1.0 / (60 + rank)) AS rrf_score FROM r GROUP BY ALL),
    fused AS (SELECT query_id, chunk_id, rrf_score, row_number() OVER (PARTITION BY query_id ORDER BY round(rrf_score, 12) DESC, chunk_id) AS rrf_rank FROM f), {rerank_sql()}
    SELECT query_id, chunk_id, rrf_rank, reranker_score, reranker_rank FROM reranked WHERE reranker_rank <= 5""",
)
def retrieve_hybrid_v1_rerank(spark, sf):
    short = v1_fused(spark, sf, 30, 15).join(questions(spark, sf), "query_id")
    full = rerank.hydrate(short, chunk_table(spark, sf))
    out = rerank.rerank(full.withColumn("text", rerank.rerank_text(full)), top=5)
    return out.select("query_id", "chunk_id", "rrf_rank", "reranker_score", "reranker_rank")


@query(
    "retrieve_hybrid_v2",
    f"""WITH {ALL_SOURCES_SQL}, {FUSED_SQL}, {rerank_sql()} SELECT query_id, chunk_id, coalesce(f.dense_rank, -1) AS dense_rank, coalesce(f.sparse_rank, -1) AS sparse_rank, coalesce(f.bm25_rank, -1) AS bm25_rank, f.rrf_rank, reranker_score, reranker_rank AS final_rank
    FROM reranked r JOIN fused f USING (query_id, chunk_id) WHERE reranker_rank <= 5""",
)
def retrieve_hybrid_v2(spark, sf):
    return hybrid_run(spark, sf).final.na.fill(-1, RANKS).select(
        "query_id", "chunk_id", "dense_rank", "sparse_rank", "bm25_rank", "rrf_rank", "reranker_score", "final_rank"
    )


@query(
    "export_candidates",
    f"""WITH {VECTORS_SQL}, {DENSE_SQL} SELECT query_id, string_agg(chunk_id || ':' || lang, ',' ORDER BY rank) AS candidates, avg(1 - score) AS mean_distance,
       md5(string_agg(text, chr(10) ORDER BY rank)) AS texts_md5 FROM dense JOIN documents ON doc_id = chunk_id WHERE rank <= 10 GROUP BY query_id""",
)
def export_candidates(spark, sf):
    q, p = encoded_questions(spark, sf), points(spark, sf)
    found = vectors.vec_topk_dense(
        q.select("query_id", F.col("dense").alias("vector")), p.select("chunk_id", F.col("dense").alias("vector")), 10
    )
    full = rerank.hydrate(found, chunk_table(spark, sf), ["content", "lang"])
    item = F.struct("rank", "chunk_id", "content", "lang", (1 - F.col("score")).alias("distance"))
    rows = full.groupBy("query_id").agg(F.array_sort(F.collect_list(item)).alias("c"), F.avg(1 - F.col("score")).alias("mean_distance"))
    return rows.select(
        "query_id",
        F.array_join(F.transform("c", lambda x: F.concat(x["chunk_id"].cast("string"), F.lit(":"), x["lang"])), ",").alias("candidates"),
        "mean_distance",
        F.md5(F.array_join(F.transform("c", lambda x: x["content"]), "\n")).alias("texts_md5"),
    )


@query("gold_pairs", f"WITH {GOLD_SQL} SELECT query_id, doc_id, source, lang FROM gold")
def gold_pairs(spark, sf):
    return gold(spark, sf)
