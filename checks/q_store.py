"""Sources, sinks, vectors and index loading."""

from __future__ import annotations

from pyspark.sql import functions as F

from corpusloom.functions import ids
from corpusloom.operators import points, quality, vectors
from corpusloom.session import shared_folder
from corpusloom.plans import corpus, embedding
from corpusloom.sources import readers, writers

from .bindings import documents, sql_strip
from .q_chunks import meta
from .q_search import VECTORS_SQL
from .q_search import points as stored_points
from .registry import query, staged, table

PATH_SQL = "source || '/' || lpad(doc_id::VARCHAR, 8, '0') || '.md'"


def fresh(spark, name: str) -> str:
    import uuid

    return f"{shared_folder(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


@query("src_corpus", f"SELECT source AS category, {PATH_SQL} AS source_relative_path, md5(text) AS text_md5 FROM documents")
def src_corpus(spark, sf):
    files = documents(spark, sf).select(F.col("source").alias("category"), F.concat("source", F.lit("/"), F.lpad(F.col("doc_id").cast("string"), 8, "0"), F.lit(".md")).alias("source_relative_path"), "text")
    return readers.discover(files).select("category", "source_relative_path", F.md5("text").alias("text_md5"))


# JSON lines as a chunk store holds them: some rows broken, some blank, copies share an id.
CHUNK_LINES_SQL = """
rows AS (SELECT doc_id, CASE doc_id % 7 WHEN 3 THEN '' ELSE md5(text) END AS chunk_id, CASE doc_id % 7 WHEN 4 THEN '   ' ELSE text END AS text, doc_id % 7 = 5 AS broken FROM documents)
"""


def chunk_lines(spark, sf, clean: bool):
    d = documents(spark, sf)
    key = F.md5("text")
    body = F.struct(
        F.when(F.lit(clean), key).when(F.col("doc_id") % 7 == 3, "").otherwise(key).alias("chunk_id"),
        F.col("doc_id").cast("string").alias("document_id"),
        F.when(F.lit(not clean) & (F.col("doc_id") % 7 == 4), "   ").otherwise(F.col("text")).alias("content"),
    )
    line = F.when(F.lit(not clean) & (F.col("doc_id") % 7 == 5), "{broken").otherwise(F.to_json(body))
    root = fresh(spark, "chunk-lines")
    d.select("doc_id", line.alias("value")).repartitionByRange(4, "doc_id").sortWithinPartitions("doc_id").select("value").write.text(root)
    return root


@query(
    "src_chunks",
    f"WITH {CHUNK_LINES_SQL} SELECT chunk_id, doc_id::VARCHAR AS document_id, md5(text) AS text_md5 FROM rows WHERE NOT broken AND chunk_id <> '' AND {sql_strip('text')} <> ''",
)
def src_chunks(spark, sf):
    rows = readers.read_chunks(spark, chunk_lines(spark, sf, clean=False), "skip_bad")
    return rows.select("chunk_id", "document_id", F.md5("text").alias("text_md5"))


@query("src_chunks_first", "SELECT md5(text) AS chunk_id, min(doc_id)::VARCHAR AS document_id FROM documents GROUP BY 1")
def src_chunks_first(spark, sf):
    return readers.read_chunks(spark, chunk_lines(spark, sf, clean=True), "first_wins").select("chunk_id", "document_id")


@query("src_chunks_last", "SELECT md5(text) AS chunk_id, max(doc_id)::VARCHAR AS document_id FROM documents GROUP BY 1")
def src_chunks_last(spark, sf):
    return readers.read_chunks(spark, chunk_lines(spark, sf, clean=True), "last_wins").select("chunk_id", "document_id")


@query(
    "src_embeddings",
    "SELECT vec_id::VARCHAR AS chunk_id, 'm' || (label % 2) AS embedding_model, len(embedding) AS dims, embedding[1]::DOUBLE AS head FROM embeddings WHERE label % 2 = 1",
)
def src_embeddings(spark, sf):
    root = fresh(spark, "vectors")
    e = table(spark, sf, "embeddings")
    e.select(
        F.col("vec_id").cast("string").alias("chunk_id"),
        F.lit("d").alias("document_id"),
        F.concat(F.lit("m"), F.col("label") % 2).alias("embedding_model"),
        "embedding",
    ).write.json(root)
    rows = readers.read_embeddings(spark, root, "m1", strict=False)
    return rows.select("chunk_id", "embedding_model", F.size("embedding").alias("dims"), F.col("embedding")[0].cast("double").alias("head"))


@query(
    "src_gold",
    """WITH cells AS (SELECT item_id, ' ' || array_to_string(string_split(text, ' '), ' | ') || ' | ' AS cell FROM benchmark),
    parts AS (SELECT item_id, list_filter(list_transform(string_split(cell, '|'), lambda x: trim(x, ' ' || chr(10))), lambda x: x <> '') AS l FROM cells)
    SELECT item_id, array_to_string(list_filter(l, lambda x, i: list_position(l, x) = i), '~') AS ids FROM parts""",
)
def src_gold(spark, sf):
    cell = F.concat(F.lit(" "), F.array_join(F.split("text", " "), " | "), F.lit(" | "))
    rows = table(spark, sf, "benchmark").select("item_id", F.col("text").alias("question"), cell.alias("relevant_chunk_ids"))
    return readers.gold_rows(rows).select("item_id", F.array_join("relevant_chunk_ids", "~").alias("ids"))


@query(
    "src_queries",
    """SELECT item_id, CASE item_id % 5 WHEN 3 THEN 1 ELSE 0 END AS position, CASE item_id % 5 WHEN 3 THEN text || '?' WHEN 4 THEN NULL ELSE text END AS query, item_id % 5 = 4 AS bad FROM benchmark
    UNION ALL SELECT item_id, 0, text, false FROM benchmark WHERE item_id % 5 = 3""",
)
def src_queries(spark, sf):
    b = table(spark, sf, "benchmark")
    as_list = F.array(F.col("text"), F.concat("text", F.lit("?")))
    value = (
        F.when(F.col("item_id") % 5 == 0, F.to_json(F.struct(F.col("text").alias("query"))))
        .when(F.col("item_id") % 5 == 1, F.to_json(F.struct(F.col("item_id").alias("query"), F.col("text").alias("question"))))
        .when(F.col("item_id") % 5 == 2, F.to_json(F.struct(F.array(F.struct(F.col("text").alias("user_input"))).alias("queries"))))
        .when(F.col("item_id") % 5 == 3, F.to_json(as_list))
        .otherwise(F.to_json(F.struct(F.col("item_id").alias("query"))))
    )
    rows = readers.query_rows(b.select("item_id", value.alias("value")))
    return rows.select("item_id", "position", "query", F.col("error").isNotNull().alias("bad"))


@query(
    "src_answers",
    "SELECT conv_id, turn, CASE WHEN turn % 3 = 0 THEN array_to_string(string_split(text, ' '), '~') ELSE '' END AS ids FROM conversations",
)
def src_answers(spark, sf):
    c = table(spark, sf, "conversations")
    cell = (
        F.when(F.col("turn") % 3 == 0, F.to_json(F.split("text", " ")))
        .when(F.col("turn") % 3 == 1, F.lit("[broken"))
        .otherwise(F.to_json(F.struct("text")))
    )
    return c.select("conv_id", "turn", F.array_join(readers.answer_ids(cell), "~").alias("ids"))


@query("sink_chunks")
def sink_chunks(spark, sf):
    root = fresh(spark, "build")
    out = corpus.write_corpus(meta(spark, sf), root, stage=lambda df, name: staged(spark, sf, f"corpus-{name}", lambda: df))
    return out["children"].groupBy("category").agg(F.count(F.lit(1)).alias("chunks"))


@query(
    "sink_embeddings",
    "SELECT label % 2 AS model, count(*) AS vectors, md5(string_agg(vec_id::VARCHAR, ',' ORDER BY vec_id)) AS ids_md5 FROM embeddings GROUP BY 1",
)
def sink_embeddings(spark, sf):
    root = fresh(spark, "shards")
    e = table(spark, sf, "embeddings").select(
        F.col("vec_id").alias("chunk_id"), "embedding", (F.col("label") % 2).alias("model_id"), F.lit("v2-test").alias("corpus_version")
    )
    writers.write_embeddings(e, root)
    back = spark.read.parquet(root).groupBy(F.col("model_id").alias("model")).agg(
        F.count(F.lit(1)).alias("vectors"),
        F.md5(F.array_join(F.transform(F.array_sort(F.collect_list("chunk_id")), lambda x: x.cast("string")), ",")).alias("ids_md5"),
    )
    return back


@query(
    "sink_reports",
    "SELECT event_type AS model, count(*) AS n, avg(value) AS mean_ms FROM events GROUP BY 1",
)
def sink_reports(spark, sf):
    root = fresh(spark, "report")
    events = table(spark, sf, "events")
    report = events.groupBy(F.col("event_type").alias("model")).agg(F.count(F.lit(1)).alias("n"), F.avg("value").alias("mean_ms"))
    writers.write_report(report, root)
    return spark.read.option("header", "true").schema("model string, n long, mean_ms double").csv(root)


@query("publish_version", "SELECT label, count(*) AS n FROM embeddings GROUP BY label")
def publish_version(spark, sf):
    root = fresh(spark, "versions")
    e = table(spark, sf, "embeddings")
    writers.publish_version(e, root, "v1", "current_vectors", [lambda t: t.groupBy("vec_id").count().filter("count > 1")])
    try:  # a failing build must leave the view alone
        writers.publish_version(e.union(e), root, "v2", "current_vectors", [lambda t: t.groupBy("vec_id").count().filter("count > 1")])
    except writers.PublishError:
        pass
    return writers.read_current(spark.newSession(), root).groupBy("label").agg(F.count(F.lit(1)).alias("n"))


@query(
    "upsert_points",
    """WITH old AS (SELECT vec_id, label FROM embeddings WHERE label < 7), new AS (SELECT vec_id, max(label + 100) AS label FROM embeddings WHERE label > 3 GROUP BY vec_id)
    SELECT vec_id::VARCHAR AS point_id, label FROM new UNION ALL SELECT vec_id::VARCHAR, label FROM old WHERE vec_id NOT IN (SELECT vec_id FROM new)""",
)
def upsert_points(spark, sf):
    e = table(spark, sf, "embeddings").select(F.col("vec_id").cast("string").alias("point_id"), "label")
    fresh_rows = e.filter("label > 3")
    incoming = fresh_rows.select("point_id", F.lit(0).alias("label"), F.lit(1).alias("seq")).unionByName(
        fresh_rows.select("point_id", (F.col("label") + 100).alias("label"), F.lit(2).alias("seq"))
    )
    return writers.upsert_points(e.filter("label < 7"), incoming)


# ------------------------------------------------------------------ vectors


@query(
    "embed_batch",
    f"""WITH {VECTORS_SQL}, s AS (SELECT id, count(*) AS sparse_size, sum(val) AS sparse_sum FROM dv_sparse GROUP BY id), d AS (SELECT id, sum(v) AS dense_sum, max(v) AS dense_max FROM dv_unit GROUP BY id)
    SELECT doc_id AS chunk_id, coalesce(sparse_size, 0) AS sparse_size, coalesce(sparse_sum, 0) AS sparse_sum, dense_sum FROM documents LEFT JOIN s ON s.id = doc_id JOIN d ON d.id = doc_id""",
)
def embed_batch(spark, sf):
    def total(column):
        return F.aggregate(column, F.lit(0.0), lambda a, x: a + x.cast("double"))

    return stored_points(spark, sf).select(
        "chunk_id", F.size("sparse.indices").alias("sparse_size"), total(F.col("sparse.values")).alias("sparse_sum"), total(F.col("dense")).alias("dense_sum")
    )


@query(
    "embed_incremental",
    f"""WITH {VECTORS_SQL}, d AS (SELECT id, sum(v) AS dense_sum FROM dv_unit GROUP BY id)
    SELECT doc_id AS chunk_id, sha256(text) AS embedding_input_sha256, CASE WHEN doc_id % 4 < 2 THEN 'second' ELSE 'first' END AS run, dense_sum FROM documents JOIN d ON d.id = doc_id""",
)
def embed_incremental(spark, sf):
    """A second run encodes what the first one lacked or had from another text, and returns the whole table."""
    root = f"{fresh(spark, 'resumed')}/vectors"
    d = documents(spark, sf).select(F.col("doc_id").alias("chunk_id"), "text")
    was = d.filter(F.col("chunk_id") % 4 != 0).withColumn("text", F.when(F.col("chunk_id") % 4 == 1, F.concat("text", F.lit(" old"))).otherwise(F.col("text")))
    embedding.embed_corpus(was, root, "text", shards=16, run="first")
    out = embedding.embed_corpus(d, root, "text", shards=16, run="second", redo_stale=True)
    total = F.aggregate("dense", F.lit(0.0), lambda a, x: a + x.cast("double"))
    return out.select("chunk_id", "embedding_input_sha256", "run", total.alias("dense_sum"))


@query(
    "vec_validate",
    """WITH v AS (SELECT vec_id, CASE label WHEN 0 THEN list_transform(embedding, lambda x: x * 2) WHEN 1 THEN embedding[1:63] ELSE embedding END AS e, label FROM embeddings)
    SELECT vec_id AS chunk_id, sqrt(list_sum(list_transform(e, lambda x: x::DOUBLE * x::DOUBLE))) AS norm,
      CASE label WHEN 0 THEN 'dense vector is not normalised' WHEN 1 THEN 'dense dimension mismatch' WHEN 2 THEN 'sparse indices repeat' WHEN 3 THEN 'sparse value is not positive' WHEN 4 THEN 'sparse indices and values differ in length' WHEN 5 THEN 'sparse index is negative' END AS error FROM v""",
)
def vec_validate(spark, sf):
    e = table(spark, sf, "embeddings")
    dense = F.when(F.col("label") == 0, F.transform("embedding", lambda x: (x * 2).cast("float"))).when(F.col("label") == 1, F.slice("embedding", 1, 63)).otherwise(F.col("embedding"))
    idx = F.when(F.col("label") == 2, F.array(F.lit(1), F.lit(1))).when(F.col("label") == 5, F.array(F.lit(-1), F.lit(2))).otherwise(F.array(F.lit(1), F.lit(2)))
    val = F.when(F.col("label") == 3, F.array(F.lit(1.0), F.lit(0.0))).when(F.col("label") == 4, F.array(F.lit(1.0))).otherwise(F.array(F.lit(1.0), F.lit(2.0)))
    rows = e.select(F.col("vec_id").alias("chunk_id"), dense.alias("dense"), F.struct(idx.alias("indices"), val.alias("values")).alias("sparse"))
    return vectors.vec_validate(rows, 64)


@query("vec_artifact_check")
def vec_artifact_check(spark, sf):
    e = table(spark, sf, "embeddings").select(F.col("vec_id").alias("chunk_id"), "embedding", "label")
    hashes = writers.shard_hashes(e, ["chunk_id", "embedding"], shards=16)
    # The manifest remembers one label without its vectors.
    manifest = writers.shard_hashes(e.filter("label <> 3"), ["chunk_id", "embedding"], shards=16)
    return points.artifact_check(e, manifest, hashes)


@query(
    "points_join",
    """SELECT doc_id AS chunk_id, CASE WHEN doc_id % 9 = 0 THEN 'vector without a chunk' WHEN doc_id % 9 = 1 THEN 'stale vector' WHEN source IN ('src1', 'src2') THEN 'category is not allowed' END AS error FROM documents""",
)
def points_join(spark, sf):
    d = documents(spark, sf)
    hashed = ids.sha256(F.col("text"))
    vecs = d.select(F.col("doc_id").alias("chunk_id"), hashed.alias("embedding_input_sha256"))
    chunks = d.filter("doc_id % 9 <> 0").select(
        F.col("doc_id").alias("chunk_id"), F.when(F.col("doc_id") % 9 == 1, "other").otherwise(hashed).alias("expected_sha256"), F.col("source").alias("category")
    )
    allowed = [f"src{i}" for i in range(20) if i not in (1, 2)]
    return points.points_join(vecs, chunks, allowed).select("chunk_id", "error")


@query(
    "points_reconcile",
    """WITH v AS (SELECT md5(text) AS chunk_id, doc_id AS seq, source, doc_id % 11 = 0 AS short, row_number() OVER (PARTITION BY md5(text) ORDER BY doc_id) AS rn FROM documents),
    k AS (SELECT DISTINCT md5(text) AS chunk_id FROM documents WHERE source <> 'src3')
    SELECT CASE WHEN rn > 1 THEN 'duplicate' WHEN k.chunk_id IS NULL THEN 'orphan' WHEN short THEN 'dimension mismatch' ELSE 'loaded' END AS status, count(*) AS n FROM v LEFT JOIN k USING (chunk_id) GROUP BY 1""",
)
def points_reconcile(spark, sf):
    d = documents(spark, sf)
    short = F.when(F.col("doc_id") % 11 == 0, F.array(F.lit(0.0))).otherwise(F.array(F.lit(0.0), F.lit(1.0)))
    vecs = d.select(F.md5("text").alias("chunk_id"), F.col("doc_id").alias("seq"), short.alias("vector"))
    chunks = d.filter("source <> 'src3'").select(F.md5("text").alias("chunk_id"))
    return points.points_reconcile(vecs, chunks, 2).groupBy("status").agg(F.count(F.lit(1)).alias("n"))


@query(
    "collection_check",
    "SELECT count(*) AS actual, count(*) AS expected, sum((label = 9)::INT) AS different, 0 AS unknown_hits FROM embeddings",
)
def collection_check(spark, sf):
    from .q_search import centroids, vector_corpus

    corpus = vector_corpus(spark, sf)
    expected = corpus.select("chunk_id", "label")
    stored = expected.withColumn("label", F.when(F.col("label") == 9, -1).otherwise(F.col("label")))
    found = vectors.vec_topk_dense(centroids(spark, sf), corpus, 1)
    return points.collection_check(stored, expected, found)


@query(
    "assert_contract",
    """WITH c AS (SELECT count(*) AS docs, count(DISTINCT source) AS sources FROM documents), e AS (SELECT count(*) AS n, min(len(embedding)) AS d FROM embeddings)
    SELECT rule, holds FROM c, e, (VALUES ('corpus versions agree', true), ('counts agree', NULL), ('expected model', true), ('expected dimension', true), ('dense and sparse present', false), ('no failed documents', true)) AS t(rule, flag), LATERAL (SELECT coalesce(flag, docs = n) AS holds)""",
)
def assert_contract(spark, sf):
    docs, e = documents(spark, sf), table(spark, sf, "embeddings")
    chunk_side = docs.agg(F.count(F.lit(1)).alias("child_count"), F.lit("v2-a").alias("corpus_version"), F.lit(0).alias("failed"))
    vector_side = e.agg(
        F.count(F.lit(1)).alias("vector_count"), F.lit("v2-a").alias("vector_corpus_version"), F.lit("m").alias("model_id"),
        F.min(F.size("embedding")).alias("dimension"), F.lit(True).alias("has_dense"), F.lit(False).alias("has_sparse"),
    )
    return quality.assert_contract(chunk_side, vector_side, "m", 64)


@query("source_verify", "SELECT doc_id, doc_id % 6 <> 0 AS valid, 'cleaned:' || doc_id || ':' || sha256(text) AS representation_id FROM documents")
def source_verify(spark, sf):
    from corpusloom.operators import catalog

    stored = F.when(F.col("doc_id") % 6 == 0, "other").otherwise(ids.sha256(F.col("text")))
    d = documents(spark, sf).select("doc_id", "text", F.col("doc_id").cast("string").alias("document_version_id"), stored.alias("source_sha256"))
    return catalog.source_verify(d).select("doc_id", "valid", "representation_id")
