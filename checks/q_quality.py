"""Relations, duplicates, reports and assertions."""

from __future__ import annotations

from pyspark.sql import functions as F

from corpusloom.functions import ids
from corpusloom.functions import text as tx
from corpusloom.operators import chunking, quality, relations, structure
from corpusloom.plans import corpus

from .bindings import STRUCTURED_SQL, WS, document_tasks, documents, sql_count, structured
from .q_chunks import atoms_sql, children, meta, split_sql
from .q_structure import CLASSIFIED_SQL, DECISION_CORPUS, LINES_SQL, NODES_SQL, kinds_sql
from .q_text import PROFILE_SQL, _canonical_sql
from .registry import query, staged

# Every node with text, tables too, stands for one chunk; its boundary is the parent.
CHUNKS_SQL = f"""
chunks AS (SELECT document_id, document_id || ':' || node_line AS chunk_id, node_line AS chunk_no, document_id || ':' || boundary_line AS parent_chunk_id,
   locator AS canonical_locator, content, kind, annex, sha256(content) AS content_sha256, {sql_count('content')} AS token_count FROM filled)
"""


def parsed(spark, sf):
    return staged(spark, sf, "parsed", lambda: structure.parse(structured(spark, sf), tasks=document_tasks(spark, sf)))


def node_texts(spark, sf):
    """Nodes with the few columns that stand for a chunk: what is not kept is not gathered, sorted or written either."""
    columns = "document_id", "node_line", "kind", "locator", "content", "boundary_line", "has_children", "line_count"
    return staged(spark, sf, "node-texts", lambda: structure.parse(structured(spark, sf), tasks=document_tasks(spark, sf)).select(*columns, F.col("annex.number").alias("annex")))


def node_chunks(spark, sf):
    nodes = node_texts(spark, sf)
    kept = nodes.filter(
        (F.col("content") != "")
        & ~(F.col("has_children") & (F.col("line_count") == 1) & F.col("kind").isin(*chunking.CONTAINERS))
    )
    key = F.concat("document_id", F.lit(":"), F.col("node_line").cast("string"))
    return kept.select(
        "document_id",
        key.alias("chunk_id"),
        key.alias("logical_chunk_id"),
        F.col("node_line").alias("chunk_no"),
        F.concat("document_id", F.lit(":"), F.col("boundary_line").cast("string")).alias("parent_chunk_id"),
        F.col("locator").alias("canonical_locator"),
        F.array(F.struct(F.col("locator").alias("canonical_locator"))).alias("atomic_units"),
        "content",
        "kind",
        "annex",
        ids.sha256(F.col("content")).alias("content_sha256"),
        tx.tok_count(F.col("content")).alias("token_count"),
        F.lit(1).alias("units"),
        F.when(F.col("kind") == "unclassified", F.array(F.lit("unclassified_structure")))
        .otherwise(F.array().cast("array<string>"))
        .alias("quality_flags"),
    )


@query(
    "rel_siblings",
    atoms_sql(STRUCTURED_SQL, CHUNKS_SQL)
    + " SELECT document_id, chunk_id, lag(chunk_id) OVER w AS previous_sibling, lead(chunk_id) OVER w AS next_sibling FROM chunks WINDOW w AS (PARTITION BY parent_chunk_id ORDER BY chunk_no)",
)
def rel_siblings(spark, sf):
    return relations.siblings(node_chunks(spark, sf))


_P = [
    rf"(?i)(?:bu[{WS}]+[\p{{L}}\p{{N}}_]+ın[{WS}]+)?([0-9]+(?:[-.][0-9]+)+)-ci[{WS}]+(?:yarım)?bənd(?:i|də|in)?",
    rf"(?i)Maddə[{WS}]+([0-9]+(?:-[0-9]+)?)",
    rf"(?i)([0-9]+(?:-[0-9]+)?)-ci[{WS}]+maddə",
    rf"(?i)Əlavə[{WS}]+([0-9]+)",
]
MENTIONS_SQL = ",".join(
    f"m{i} AS (SELECT document_id, chunk_id, canonical_locator, unnest(regexp_extract_all(content, '{p}', 0)) AS raw, unnest(regexp_extract_all(content, '{p}', 1)) AS locator FROM chunks)"
    for i, p in enumerate(_P)
) + """,
mentions AS (SELECT DISTINCT document_id, chunk_id, canonical_locator, raw, locator FROM (SELECT * FROM m0 UNION ALL SELECT * FROM m1 UNION ALL SELECT * FROM m2 UNION ALL SELECT * FROM m3))
"""


@query("rel_extract_refs", atoms_sql(STRUCTURED_SQL, CHUNKS_SQL, MENTIONS_SQL) + " SELECT document_id, chunk_id, raw AS raw_reference, locator AS target_locator FROM mentions")
def rel_extract_refs(spark, sf):
    return relations.mentions(node_chunks(spark, sf)).select("document_id", "chunk_id", "raw_reference", "target_locator")


RESOLVED_SQL = rf"""
keys AS (SELECT DISTINCT document_id, chunk_id, unnest(list_concat(list_concat(regexp_extract_all(canonical_locator, '[0-9]+(?:[-.][0-9]+)+'),
   regexp_extract_all(canonical_locator, 'Maddə[{WS}]([0-9]+(?:-[0-9]+)?)', 1)), regexp_extract_all(canonical_locator, 'Əlavə[{WS}]([0-9]+)', 1))) AS key FROM chunks),
resolved AS (SELECT m.document_id, m.chunk_id, m.canonical_locator, m.raw, m.locator, CASE WHEN count(DISTINCT k.chunk_id) = 1 THEN min(k.chunk_id) END AS target, count(DISTINCT k.chunk_id) = 1 AS resolved
   FROM mentions m LEFT JOIN keys k ON k.document_id = m.document_id AND k.key = m.locator AND k.chunk_id <> m.chunk_id GROUP BY ALL)
"""


def references(spark, sf):
    chunks = node_chunks(spark, sf)
    return relations.resolve(relations.mentions(chunks), relations.locator_keys(chunks))


@query(
    "rel_resolve_refs",
    atoms_sql(STRUCTURED_SQL, CHUNKS_SQL, MENTIONS_SQL, RESOLVED_SQL) + " SELECT document_id, chunk_id, raw AS raw_reference, locator AS target_locator, target AS target_chunk_id, resolved FROM resolved",
)
def rel_resolve_refs(spark, sf):
    return references(spark, sf).select("document_id", "chunk_id", "raw_reference", "target_locator", "target_chunk_id", "resolved")


@query(
    "rel_backlinks",
    atoms_sql(STRUCTURED_SQL, CHUNKS_SQL, MENTIONS_SQL, RESOLVED_SQL) + " SELECT document_id, target AS chunk_id, raw AS raw_reference, canonical_locator AS target_locator, chunk_id AS target_chunk_id FROM resolved WHERE resolved",
)
def rel_backlinks(spark, sf):
    return relations.backlinks(references(spark, sf)).select("document_id", "chunk_id", "raw_reference", "target_locator", "target_chunk_id")


@query(
    "rel_continuations",
    atoms_sql(STRUCTURED_SQL, split_sql("limits", "document_id, node_line"))
    + " SELECT document_id, node_line, count(*) - 1 AS later_pieces FROM parts GROUP BY ALL HAVING count(*) > 1",
)
def rel_continuations(spark, sf):
    pieces = children(spark, sf).filter("table is null and split_count > 1").select(
        "document_id", "chunk_id", "continuation_of", F.col("source_spans")[0]["line_start"].alias("node_line")
    )
    pieces = staged(spark, sf, "split-pieces", lambda: pieces)  # read twice, and small: only pieces of split units
    later = relations.continuations(pieces)
    place = pieces.filter("continuation_of is null").select("document_id", "chunk_id", "node_line")
    return later.join(place, ["document_id", "chunk_id"]).select("document_id", "node_line", F.size("continuations").alias("later_pieces"))


@query(
    "rel_annex_table",
    atoms_sql(STRUCTURED_SQL, CHUNKS_SQL) + " SELECT document_id, chunk_no AS node_line FROM chunks c JOIN located l USING (document_id) WHERE l.node_line = split_part(parent_chunk_id, ':', 2)::BIGINT AND l.annex IS NOT NULL",
)
def rel_annex_table(spark, sf):
    held = children(spark, sf).filter("annex_parent is not null")
    return held.select("document_id", F.col("source_spans")[0]["line_start"].alias("node_line")).distinct()


@query(
    "rel_approved",
    "WITH RECURSIVE " + ",".join([DECISION_CORPUS, LINES_SQL, CLASSIFIED_SQL, kinds_sql("true"), NODES_SQL])
    + """, firsts AS (SELECT document_id, min(node_line) AS first_line FROM heads WHERE kind IN ('section', 'clause') GROUP BY ALL)
    SELECT document_id, document_id || ':' || node_line AS chunk_id, document_id || ':p' || first_line AS approved_document FROM heads JOIN firsts USING (document_id) WHERE kind = 'decision_clause'""",
)
def rel_approved(spark, sf):
    text = F.regexp_replace(F.regexp_replace("text", r"(?m)^a\) ", "1. "), r"(?m)^Maddə (\p{Nd}+)\. ", "$1. ")
    docs = structured(spark, sf).withColumn("text", text).withColumn("profile", F.lit("DECISION_OR_AMENDMENT"))
    nodes = structure.parse(docs)
    chunks = nodes.select(
        "document_id",
        F.concat_ws(":", "document_id", F.col("node_line").cast("string")).alias("chunk_id"),
        F.col("node_line").alias("chunk_no"),
        F.col("kind").alias("node_type"),
        F.concat(F.col("document_id"), F.lit(":p"), F.col("node_line").cast("string")).alias("parent_chunk_id"),
    )
    facts = docs.select("document_id", F.array(F.lit("REGULATION"), F.lit("DECISION_OR_AMENDMENT")).alias("profiles"))
    return relations.approved(chunks, facts)


# -------------------------------------------------------------- duplicates

COPIES_SQL = f"hashed AS (SELECT doc_id, source || '/' || lpad(doc_id::VARCHAR, 8, '0') || '.md' AS path, sha256({_canonical_sql('text')}) AS h FROM documents)"


@query(
    "dedup_documents",
    f"""WITH {COPIES_SQL} SELECT doc_id, arg_min(doc_id, path) OVER (PARTITION BY h) = doc_id AS is_canonical, CASE WHEN arg_min(doc_id, path) OVER (PARTITION BY h) <> doc_id THEN arg_min(doc_id, path) OVER (PARTITION BY h)::VARCHAR END AS duplicate_of FROM hashed""",
)
def dedup_documents(spark, sf):
    rows = documents(spark, sf).select(
        F.col("doc_id").alias("document_id"),
        F.concat("source", F.lit("/"), F.lpad(F.col("doc_id").cast("string"), 8, "0"), F.lit(".md")).alias("source_relative_path"),
        ids.sha256(tx.canonical(F.col("text"))).alias("content_hash"),
    )
    out = corpus.duplicate_documents(staged(spark, sf, "document-hashes", lambda: rows))  # hashed once, read by both sides of the join
    return out.select(
        F.col("document_id").alias("doc_id"),
        F.col("is_canonical_document").alias("is_canonical"),
        F.col("duplicate_of_document_id").cast("string").alias("duplicate_of"),
    )


DOUBLES_SQL = "doubles AS (SELECT document_id, content_sha256, count(*) AS size FROM chunks GROUP BY ALL HAVING count(*) > 1 AND count(*) = count(DISTINCT canonical_locator))"


@query("dedup_chunks", atoms_sql(STRUCTURED_SQL, CHUNKS_SQL, DOUBLES_SQL) + " SELECT * FROM doubles")
def dedup_chunks(spark, sf):
    return quality.duplicate_chunks(node_chunks(spark, sf)).drop("flag")


@query(
    "id_collisions",
    """WITH base AS (SELECT doc_id, source || '/' || lpad(doc_id::VARCHAR, 8, '0') || '.md' AS path, 'doc_' || substr(sha256('guidance' || chr(31) || source), 1, 24) AS base_id, count(*) OVER (PARTITION BY source) AS n FROM documents)
    SELECT doc_id, CASE WHEN n = 1 THEN base_id ELSE 'doc_' || substr(sha256(base_id || chr(31) || path), 1, 24) END AS document_id FROM base""",
)
def id_collisions(spark, sf):
    base = documents(spark, sf).select(
        "doc_id",
        F.concat("source", F.lit("/"), F.lpad(F.col("doc_id").cast("string"), 8, "0"), F.lit(".md")).alias("source_relative_path"),
        ids.document_id(F.col("source"), F.lit("guidance"), F.lit(""), F.lit(None), F.lit(None), F.lit("")).alias("base_id"),
    )
    return corpus.unique_document_ids(base).select("doc_id", "document_id")


# ----------------------------------------------------------------- reports

REPORT_SQL = f"""
spread AS (SELECT document_id, count(*) AS child_count, min(token_count) AS min_tokens, floor(median(token_count))::BIGINT AS median_tokens, max(token_count) AS max_tokens,
   list_sort(list(token_count))[least(count(*), ceil(round((count(*) - 1) * 0.95, 6))::BIGINT + 1)] AS p95_tokens FROM chunks GROUP BY ALL),
tables AS (SELECT document_id, sum((kind = 'table')::INT) AS table_count, sum((kind = 'unclassified')::INT) AS unclassified_node_count FROM heads GROUP BY ALL),
opens AS (SELECT document_id, sum((NOT resolved)::INT) AS unresolved_reference_count FROM resolved GROUP BY ALL),
dups AS (SELECT document_id, sum(size - 1) AS duplicate_chunk_count FROM doubles GROUP BY ALL),
flagged_rows AS (SELECT document_id, 'unclassified_structure' AS flag FROM chunks WHERE kind = 'unclassified' UNION SELECT document_id, 'duplicate_content' FROM doubles UNION SELECT document_id, 'unresolved_reference' FROM resolved WHERE NOT resolved),
flags AS (SELECT document_id, string_agg(flag, ',' ORDER BY flag) AS quality_flags FROM flagged_rows GROUP BY ALL),
reports AS (SELECT c.document_id, CASE WHEN child_count IS NULL AND trim(c.text) <> '' THEN 'failed' ELSE 'success' END AS status, coalesce(child_count, 0) AS child_count, coalesce(table_count, 0) AS table_count,
   coalesce(unclassified_node_count, 0) AS unclassified_node_count, coalesce(unresolved_reference_count, 0) AS unresolved_reference_count, coalesce(duplicate_chunk_count, 0) AS duplicate_chunk_count,
   coalesce(min_tokens, 0) AS min_tokens, coalesce(median_tokens, 0) AS median_tokens, coalesce(p95_tokens, 0) AS p95_tokens, coalesce(max_tokens, 0) AS max_tokens, coalesce(quality_flags, '') AS quality_flags
   FROM corpus c LEFT JOIN spread USING (document_id) LEFT JOIN tables USING (document_id) LEFT JOIN opens USING (document_id) LEFT JOIN dups USING (document_id) LEFT JOIN flags USING (document_id))
"""
_FULL = atoms_sql(STRUCTURED_SQL, CHUNKS_SQL, MENTIONS_SQL, RESOLVED_SQL, DOUBLES_SQL, REPORT_SQL)


def chunk_facts(spark, sf):
    """What reports read of a chunk. They read it many times, percentiles in several passes, so contents are hashed, counted and left once."""
    columns = "document_id", "chunk_id", "parent_chunk_id", "canonical_locator", "kind", "content_sha256", "token_count", "units", "quality_flags"
    return staged(spark, sf, "chunk-facts", lambda: node_chunks(spark, sf).select(*columns))


def reports(spark, sf, docs=None):
    nodes = node_texts(spark, sf).select("document_id", "kind")
    facts = (meta(spark, sf) if docs is None else docs).select("document_id", "profile", "is_empty")
    found = staged(spark, sf, "chunk-references", lambda: references(spark, sf).select("document_id", "chunk_id", "resolved"))  # read twice
    return quality.quality_report(facts, chunk_facts(spark, sf), nodes, found)


@query("quality_report", _FULL + " SELECT * FROM reports")
def quality_report(spark, sf):
    out = reports(spark, sf).withColumn("quality_flags", F.array_join("quality_flags", ","))
    return out.drop("profile", "errors", "atomic_unit_count")


@query(
    "percentile_upper",
    "SELECT event_type, list_sort(list(value))[least(count(*), ceil(round((count(*) - 1) * 0.95, 6))::BIGINT + 1)] AS p95 FROM events GROUP BY event_type",
)
def percentile_upper(spark, sf):
    from .registry import table

    return quality.percentile_upper(table(spark, sf, "events"), "value", 0.95, ["event_type"], "p95")


GATE_SQL = "SELECT document_id, status = 'success' AND NOT contains(quality_flags, 'oversized') AND NOT contains(quality_flags, 'low_text') AND length(quality_flags) >= 0 AS passed, max_tokens FROM reports"


@query("quality_gate", _FULL + " " + GATE_SQL)
def quality_gate(spark, sf):
    return quality.quality_gate(reports(spark, sf)).select("document_id", "passed", "max_tokens")


@query(
    "corpus_manifest",
    _FULL + """ SELECT (SELECT count(*) FROM reports) AS discovered, (SELECT sum((status = 'failed')::INT) FROM reports) AS failed, (SELECT sum(unresolved_reference_count) FROM reports) AS unresolved_references,
      (SELECT sum(unclassified_node_count) FROM reports) AS unclassified_nodes, (SELECT count(*) FROM chunks) AS child_count, (SELECT min(token_count) FROM chunks) AS token_min, (SELECT floor(median(token_count)) FROM chunks)::BIGINT AS token_median,
      (SELECT max(token_count) FROM chunks) AS token_max, (SELECT list_sort(list(token_count))[ceil(round((count(*) - 1) * 0.95, 6))::BIGINT + 1] FROM chunks) AS token_p95,
      (SELECT count(DISTINCT parent_chunk_id) FROM chunks) AS parent_count,
      (SELECT string_agg(kind || '=' || n, ',' ORDER BY kind) FROM (SELECT kind, count(*) AS n FROM chunks GROUP BY kind)) AS chunk_types,
      (SELECT string_agg(flag || '=' || n, ',' ORDER BY flag) FROM (SELECT unnest(string_split(quality_flags, ',')) AS flag, count(*) AS n FROM reports WHERE quality_flags <> '' GROUP BY 1)) AS flags""",
)
def corpus_manifest(spark, sf):
    chunks = chunk_facts(spark, sf).withColumn("chunk_type", F.col("kind"))
    parents = chunks.select("parent_chunk_id").distinct()
    columns = "document_id", "source_relative_path", "profile", "is_empty", "content_hash", "source_sha256"
    docs = staged(spark, sf, "document-facts", lambda: meta(spark, sf).select(*columns))  # texts are made and hashed once
    totals = staged(spark, sf, "reports", lambda: reports(spark, sf, docs))
    out = quality.corpus_manifest(docs, totals, chunks, parents)

    def flat(column):
        return F.array_join(F.transform(F.map_entries(column), lambda e: F.concat(e["key"], F.lit("="), e["value"].cast("string"))), ",")

    return out.select(
        "discovered", "failed", "unresolved_references", "unclassified_nodes", "child_count", "token_min", "token_median", "token_max", "token_p95",
        "parent_count", flat("chunk_types").alias("chunk_types"), flat("flags").alias("flags"),
    )


@query(
    "corpus_dry_run",
    f"""WITH {STRUCTURED_SQL}, {PROFILE_SQL} SELECT count(*) AS discovered, 0 AS empty_documents, ceil(count(*) / 256)::BIGINT AS expected_shards,
     (SELECT string_agg(p || '=' || n, ',' ORDER BY p) FROM (SELECT unnest(string_split(profiles, ',')) AS p, count(*) AS n FROM profiled GROUP BY 1)) AS detected_profiles FROM profiled""",
)
def corpus_dry_run(spark, sf):
    out = quality.dry_run(meta(spark, sf))
    entries = F.transform(F.map_entries("detected_profiles"), lambda e: F.concat(e["key"], F.lit("="), e["value"].cast("string")))
    return out.withColumn("detected_profiles", F.array_join(entries, ","))


@query(
    "assert_document",
    atoms_sql(STRUCTURED_SQL, CHUNKS_SQL) + """, parents AS (SELECT document_id, parent_chunk_id, sum(token_count) AS token_count FROM chunks GROUP BY ALL)
    SELECT 'child token limit exceeded' AS rule, document_id, chunk_id AS item FROM chunks WHERE token_count > 450
    UNION ALL SELECT 'parent token limit exceeded', document_id, parent_chunk_id FROM parents WHERE token_count > 1500""",
)
def assert_document(spark, sf):
    chunks = node_chunks(spark, sf)
    with_next = chunks.join(relations.siblings(chunks).select("chunk_id", "next_sibling"), "chunk_id")
    parents = chunks.groupBy("document_id", "parent_chunk_id").agg(
        F.sum("token_count").alias("token_count"), F.collect_list("chunk_id").alias("child_chunk_ids")
    )
    return quality.assert_document(with_next, parents)


@query(
    "assert_corpus",
    f"WITH {COPIES_SQL} SELECT 'chunk identifier collision' AS rule, NULL::VARCHAR AS document_id, h AS item FROM hashed GROUP BY h HAVING count(*) > 1",
)
def assert_corpus(spark, sf):
    docs = meta(spark, sf)
    plain = documents(spark, sf).select(
        F.col("doc_id").cast("string").alias("document_id"), ids.sha256(tx.canonical(F.col("text"))).alias("chunk_id")
    )
    return quality.assert_corpus(
        docs.select("document_id"), plain, docs.select(F.col("document_id").alias("parent_chunk_id")), docs.select("document_id")
    )
