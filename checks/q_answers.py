"""Evidence, budgets, prompts, answers and citations over retrieved documents."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from corpusloom.functions import ids
from corpusloom.functions import text as tx
from corpusloom.operators import citations, evidence, pages, plugins, prompts
from corpusloom.plans import answers as flows

from .bindings import EXCHANGES_SQL, STRUCTURED_SQL, exchanges, questions, sql_count, sql_strip, structured
from .q_chunks import built
from .q_eval import bm25
from .q_quality import parsed
from .q_search import documents, hybrid_run, lex_sql
from .q_structure import SPANS_SQL, chain_sql
from .q_text import PAGE_BOUNDS_SQL
from .registry import query, staged

# Documents are child artifacts, sources are their parents; edges follow the keys.
GRAPH_SQL = """
seeds AS (SELECT query_id, 'c' || chunk_id AS src, rank AS final_rank FROM bm25 WHERE rank <= 5),
arts AS (SELECT 'c' || doc_id AS artifact_id, 'child' AS artifact_type, CASE WHEN doc_id % 8 = 0 THEN 2 ELSE 1 END AS split_count, CASE WHEN doc_id % 4 = 1 THEN 'c' || (doc_id - 1) END AS continuation_of, md5(text) AS logical_chunk_id FROM documents
   UNION ALL SELECT DISTINCT 'p' || source, 'parent', 1, NULL, NULL FROM documents),
refs AS (SELECT doc_id, (doc_id * 7) % 1009 AS t, CASE WHEN doc_id % 3 = 0 THEN 0.5 ELSE 1.0 END AS confidence, doc_id % 5 <> 0 AS resolved FROM documents),
edges AS (
   SELECT 'c' || doc_id AS src, 'parent' AS rel, 'p' || source AS dst, NULL::DOUBLE AS confidence, true AS resolved FROM documents
   UNION ALL SELECT 'c' || doc_id, 'continuation_of', 'c' || (doc_id - 1), NULL, true FROM documents WHERE doc_id % 4 = 1
   UNION ALL SELECT 'c' || (doc_id - 1), 'continuation', 'c' || doc_id, NULL, true FROM documents WHERE doc_id % 4 = 1
   UNION ALL SELECT 'c' || doc_id, 'previous_sibling', 'c' || (doc_id - 1), NULL, true FROM documents WHERE doc_id > 0
   UNION ALL SELECT 'c' || doc_id, 'next_sibling', 'c' || (doc_id + 1), NULL, true FROM documents
   UNION ALL SELECT 'c' || doc_id, 'reference', 'c' || t, confidence, resolved FROM refs
   UNION ALL SELECT 'c' || t, 'referenced_by', 'c' || doc_id, confidence, true FROM refs WHERE resolved),
inspected AS (SELECT s.query_id, s.final_rank, s.src, e.rel, e.dst, e.confidence, t.artifact_type,
   CASE e.rel WHEN 'continuation_of' THEN 2 WHEN 'continuation' THEN 2 WHEN 'parent' THEN 3 WHEN 'previous_sibling' THEN 4 WHEN 'next_sibling' THEN 4 ELSE 5 END AS priority,
   CASE e.rel WHEN 'parent' THEN 0 WHEN 'continuation_of' THEN 1 WHEN 'continuation' THEN 2 WHEN 'previous_sibling' THEN 3 WHEN 'next_sibling' THEN 4 WHEN 'reference' THEN 5 ELSE 6 END AS rel_no,
   CASE WHEN e.rel IN ('reference', 'referenced_by') AND NOT resolved THEN 'unresolved reference' WHEN e.rel IN ('reference', 'referenced_by') AND e.confidence < 0.8 THEN 'reference confidence below threshold'
        WHEN t.artifact_id IS NULL THEN 'relation target missing'
        WHEN e.rel IN ('previous_sibling', 'next_sibling') AND NOT (o.split_count > 1 OR t.split_count > 1 OR coalesce(t.continuation_of = s.src, false) OR coalesce(o.continuation_of = e.dst, false) OR coalesce(o.logical_chunk_id = t.logical_chunk_id, false))
          THEN 'ordinary sibling lacks structural-completion signal' END AS excluded
   FROM seeds s JOIN edges e USING (src) LEFT JOIN arts o ON o.artifact_id = s.src LEFT JOIN arts t ON t.artifact_id = e.dst),
numbered AS (SELECT *, row_number() OVER (PARTITION BY query_id, src ORDER BY priority, dst, rel_no) AS rn FROM inspected WHERE excluded IS NULL),
merged AS (SELECT query_id, dst, arg_min(priority, final_rank * 100 + rn) AS priority, min(final_rank) AS final_rank, arg_min(rel, final_rank * 100 + rn) AS rel, arg_min(artifact_type, final_rank * 100 + rn) AS artifact_type,
   string_agg(src || '/' || rel, ',' ORDER BY final_rank, rn) AS provenance FROM numbered WHERE rn <= 4 GROUP BY ALL),
ranked_x AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY priority, final_rank, dst) AS position FROM merged)
"""


def graph(spark, sf):
    d = documents(spark, sf)
    child = F.concat(F.lit("c"), F.col("doc_id").cast("string"))

    def c(expr: str):
        return F.concat(F.lit("c"), F.expr(expr).cast("string"))

    arts = d.select(
        child.alias("artifact_id"), F.lit("child").alias("artifact_type"), F.when(F.col("doc_id") % 8 == 0, 2).otherwise(1).alias("split_count"),
        F.when(F.col("doc_id") % 4 == 1, c("doc_id - 1")).alias("continuation_of"), F.md5("text").alias("logical_chunk_id"),
    ).unionByName(
        d.select(F.concat(F.lit("p"), F.col("source")).alias("artifact_id")).distinct().select(
            "artifact_id", F.lit("parent").alias("artifact_type"), F.lit(1).alias("split_count"),
            F.lit(None).cast("string").alias("continuation_of"), F.lit(None).cast("string").alias("logical_chunk_id"),
        )
    )

    def edge(rows, src, rel, dst, confidence=None, resolved=None):
        return rows.select(
            src.alias("src"), F.lit(rel).alias("rel"), dst.alias("dst"), F.lit("structural").alias("direction"),
            (F.lit(None).cast("double") if confidence is None else confidence).alias("confidence"),
            (F.lit(True) if resolved is None else resolved).alias("resolved"), F.lit(0).alias("edge_no"),
        )

    later = d.filter("doc_id % 4 = 1")
    trust = F.when(F.col("doc_id") % 3 == 0, 0.5).otherwise(1.0)
    sure = F.col("doc_id") % 5 != 0
    target = c("(doc_id * 7) % 1009")
    edges = (
        edge(d, child, "parent", F.concat(F.lit("p"), F.col("source")))
        .unionByName(edge(later, child, "continuation_of", c("doc_id - 1")))
        .unionByName(edge(later, c("doc_id - 1"), "continuation", child))
        .unionByName(edge(d.filter("doc_id > 0"), child, "previous_sibling", c("doc_id - 1")))
        .unionByName(edge(d, child, "next_sibling", c("doc_id + 1")))
        .unionByName(edge(d, child, "reference", target, trust, sure))
        .unionByName(edge(d.filter(sure), target, "referenced_by", child, trust))
    )
    seeds = bm25(spark, sf).filter("rank <= 5").select("query_id", F.concat(F.lit("c"), F.col("chunk_id")).alias("chunk_id"), F.col("rank").alias("final_rank"))
    return seeds, edges, arts


def expanded(spark, sf):
    seeds, edges, arts = graph(spark, sf)
    inspected = staged(spark, sf, "inspected", lambda: evidence.inspect_edges(seeds, edges, arts))
    return evidence.expand(seeds, inspected)


CANDIDATES_SQL = """
candidates AS (SELECT query_id, src AS artifact_id, 'seed' AS role, '' AS relation_type, 1 AS priority, final_rank, src || '/' AS provenance FROM seeds
   UNION ALL SELECT query_id, dst, 'expanded', rel, priority, final_rank, provenance FROM ranked_x WHERE position <= 16)
"""


@query("ctx_expand", f"WITH {lex_sql()}, {GRAPH_SQL}, {CANDIDATES_SQL} SELECT * FROM candidates")
def ctx_expand(spark, sf):
    out, _ = expanded(spark, sf)
    paths = F.array_join(F.transform("provenance", lambda p: F.concat(p["seed"], F.lit("/"), F.coalesce(p["rel"], F.lit("")))), ",")
    return out.select("query_id", "artifact_id", "role", F.coalesce("relation_type", F.lit("")).alias("relation_type"), "priority", "final_rank", paths.alias("provenance"))


@query(
    "ctx_expand_diagnostics",
    f"""WITH {lex_sql()}, {GRAPH_SQL}, notes AS (SELECT query_id, 'excluded' AS decision, excluded AS reason FROM inspected WHERE excluded IS NOT NULL
      UNION ALL SELECT query_id, 'included', 'depth-one ' || rel || ' context' FROM numbered UNION ALL SELECT query_id, 'excluded', 'per-seed expansion cap' FROM numbered WHERE rn > 4 UNION ALL SELECT query_id, 'excluded', 'global expansion cap' FROM ranked_x WHERE position > 16)
    SELECT query_id, decision, reason, count(*) AS n FROM notes GROUP BY ALL""",
)
def ctx_expand_diagnostics(spark, sf):
    _, notes = expanded(spark, sf)
    return notes.groupBy("query_id", "decision", "reason").agg(F.count(F.lit(1)).alias("n"))


EVIDENCE_SQL = """
bodies AS (SELECT 'c' || doc_id AS artifact_id, text AS content, doc_id % 3 AS flags, doc_id % 17 <> 0 AS version_ok FROM documents UNION ALL SELECT 'p' || source, min(text), 0, true FROM documents GROUP BY source),
valid AS (SELECT c.*, b.content, b.flags, sha256(b.content) AS h FROM candidates c JOIN bodies b USING (artifact_id) WHERE version_ok AND content <> ''),
firsts AS (SELECT *, row_number() OVER (PARTITION BY query_id, h ORDER BY priority, final_rank, flags, artifact_id) AS copy FROM valid),
selected AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY priority, final_rank, flags, artifact_id) AS position FROM firsts WHERE copy = 1)
"""


def evidence_rows(spark, sf):
    out, _ = expanded(spark, sf)
    d = documents(spark, sf)
    flags = F.slice(F.array(F.lit("a"), F.lit("b")), F.lit(1), (F.col("doc_id") % 3).cast("int"))
    bodies = d.select(
        F.concat(F.lit("c"), F.col("doc_id").cast("string")).alias("artifact_id"), F.col("text").alias("content"), flags.alias("quality_flags"),
        (F.col("doc_id") % 17 != 0).alias("version_ok"), F.col("source").alias("document_title"), F.col("doc_id").cast("string").alias("canonical_locator"),
    ).unionByName(
        d.groupBy("source").agg(F.min("text").alias("content")).select(
            F.concat(F.lit("p"), F.col("source")).alias("artifact_id"), "content", F.array().cast("array<string>").alias("quality_flags"),
            F.lit(True).alias("version_ok"), F.col("source").alias("document_title"), F.col("source").alias("canonical_locator"),
        )
    )
    built_rows = out.join(bodies, "artifact_id").withColumn("content_sha256", ids.sha256(F.col("content")))
    return evidence.select_evidence(built_rows)


def selected(spark, sf):
    return staged(spark, sf, "evidence", lambda: evidence_rows(spark, sf)[0])


@query("ctx_evidence", f"WITH {lex_sql()}, {GRAPH_SQL}, {CANDIDATES_SQL}, {EVIDENCE_SQL} SELECT query_id, position, artifact_id, role, md5(content) AS content_md5 FROM selected")
def ctx_evidence(spark, sf):
    return selected(spark, sf).select("query_id", "position", "artifact_id", "role", F.md5("content").alias("content_md5"))


@query(
    "ctx_selectors",
    chain_sql(SPANS_SQL, PAGE_BOUNDS_SQL) + """, sel AS (SELECT s.document_id, node_line, run, s.page, char_start, char_end, page_start, greatest(page_start, raw_end) AS page_end, c.text FROM spans s JOIN corpus c USING (document_id) LEFT JOIN bounds b ON b.document_id = s.document_id AND b.page = s.page WHERE char_end > char_start)
    SELECT document_id, node_line, char_start AS position_start, coalesce(CASE WHEN page_start <= char_start AND char_end <= page_end THEN char_start - page_start END, -1) AS page_position_start, md5(substr(text, char_start + 1, char_end - char_start)) AS exact_md5,
      md5(substr(text, greatest(char_start - 48, 0) + 1, char_start - greatest(char_start - 48, 0))) AS prefix_md5, md5(substr(text, char_end + 1, 48)) AS suffix_md5 FROM sel""",
)
def ctx_selectors(spark, sf):
    docs = structured(spark, sf)
    spans = parsed(spark, sf).select("document_id", "node_line", F.posexplode("spans").alias("span_no", "s")).select(
        "document_id", "node_line", "span_no", "s.page", "s.char_start", "s.char_end"
    )
    out = evidence.selectors(spans, docs, pages.page_bounds(docs))
    return out.select(
        "document_id", "node_line", "position_start", F.coalesce("page_position_start", F.lit(-1)).alias("page_position_start"),
        F.md5("exact").alias("exact_md5"), F.md5("prefix").alias("prefix_md5"), F.md5("suffix").alias("suffix_md5"),
    )


def budget_sql(cost: str, budget: str, joiner: int) -> str:
    return f"""
costs AS MATERIALIZED (SELECT query_id, position, ({cost})::BIGINT AS cost, ({budget})::BIGINT AS budget FROM selected JOIN benchmark ON item_id = query_id),
walk AS (SELECT query_id, position, cost <= budget AS kept, CASE WHEN cost <= budget THEN cost ELSE 0 END AS used, (cost <= budget)::INT AS n FROM costs WHERE position = 1
   UNION ALL SELECT w.query_id, c.position, w.used + c.cost + CASE WHEN w.n > 0 THEN {joiner} ELSE 0 END <= c.budget,
     CASE WHEN w.used + c.cost + CASE WHEN w.n > 0 THEN {joiner} ELSE 0 END <= c.budget THEN w.used + c.cost + CASE WHEN w.n > 0 THEN {joiner} ELSE 0 END ELSE w.used END,
     w.n + (w.used + c.cost + CASE WHEN w.n > 0 THEN {joiner} ELSE 0 END <= c.budget)::INT
   FROM walk w JOIN costs c ON c.query_id = w.query_id AND c.position = w.position + 1)
"""


_CTX = f"WITH RECURSIVE {lex_sql()}, {GRAPH_SQL}, {CANDIDATES_SQL}, {EVIDENCE_SQL}"


@query(
    "ctx_budget_v2",
    _CTX + f", {budget_sql(sql_count('content') + ' + 12', '8192 - 512 - 256 - ' + sql_count('benchmark.text'), 1)} SELECT query_id, position, cost, kept, CASE WHEN kept THEN 'E' || n END AS evidence_id FROM walk JOIN costs USING (query_id, position)",
)
def ctx_budget_v2(spark, sf):
    rows = selected(spark, sf).join(questions(spark, sf), "query_id").withColumn("cost", (tx.tok_count(F.col("content")) + 12).cast("long"))
    budget = (F.lit(8192 - 512 - 256) - tx.tok_count(F.col("query"))).cast("long")
    return evidence.fit_budget(rows, budget, joiner=1).select("query_id", "position", "cost", "kept", "evidence_id")


@query(
    "ctx_budget_v1",
    _CTX + f", {budget_sql(sql_count('content'), '4096 - 512 - 300', 0)} SELECT query_id, sum(cost) AS initial_tokens, sum(CASE WHEN kept THEN cost ELSE 0 END) AS final_tokens, sum(kept::INT) AS kept_count, CASE WHEN sum(cost) > 0 THEN 100 * (sum(cost) - sum(CASE WHEN kept THEN cost ELSE 0 END)) / sum(cost) ELSE 0 END AS reduction_percent FROM walk JOIN costs USING (query_id, position) GROUP BY query_id",
)
def ctx_budget_v1(spark, sf):
    rows = selected(spark, sf).withColumn("cost", tx.tok_count(F.col("content")).cast("long"))
    out = evidence.fit_budget(rows, F.lit(4096 - 512 - 300).cast("long"))
    used = F.sum(F.when(F.col("kept"), F.col("cost")).otherwise(0))
    return out.groupBy("query_id").agg(
        F.sum("cost").alias("initial_tokens"), used.alias("final_tokens"), F.count_if("kept").alias("kept_count"),
        F.when(F.sum("cost") > 0, 100 * (F.sum("cost") - used) / F.sum("cost")).otherwise(0.0).alias("reduction_percent"),
    )


@query(
    "prompt_v1",
    f"""WITH {lex_sql(k=5)}, blocks AS (SELECT query_id, rank, '--- Document ' || rank || ' ---' || chr(10) || 'Document: ' || doc_id || chr(10) || 'Category: ' || source || chr(10) ||
       CASE WHEN doc_id % 3 = 0 THEN 'Page: 1' || chr(10) WHEN doc_id % 3 = 1 THEN 'Pages: 1-2' || chr(10) ELSE '' END || chr(10) || 'Content:' || chr(10) || {sql_strip('text')} AS block FROM bm25 JOIN documents ON doc_id = chunk_id)
    SELECT query_id, md5('S' || chr(10) || chr(10) || 'Context:' || chr(10) || chr(10) || string_agg(block, chr(10) || chr(10) || '---' || chr(10) || chr(10) ORDER BY rank) || chr(10) || chr(10) || '---' || chr(10) || chr(10) || 'Question: ' || b.text || chr(10) || chr(10) || 'Answer:') AS prompt_md5
    FROM blocks JOIN benchmark b ON b.item_id = query_id GROUP BY query_id, b.text""",
)
def prompt_v1(spark, sf):
    d = documents(spark, sf).select(
        F.col("doc_id").alias("chunk_id"), F.col("doc_id").cast("string").alias("title"), F.col("source").alias("category"), "text",
        *[F.lit(None).cast("string").alias(c) for c in ("chapter", "article", "section", "subsection")],
        F.when(F.col("doc_id") % 3 < 2, 1).alias("page_start"), F.when(F.col("doc_id") % 3 < 2, F.col("doc_id") % 3 + 1).alias("page_end"),
    )
    top = bm25(spark, sf).filter("rank <= 5").select("query_id", "chunk_id", F.col("rank").alias("position"))
    out = prompts.prompt_v1(questions(spark, sf), top.join(d, "chunk_id"), system="S")
    return out.select("query_id", F.md5("prompt").alias("prompt_md5"))


@query("prompt_v2")
def prompt_v2(spark, sf):
    out = flows.prompts_for(questions(spark, sf), selected(spark, sf))
    return out.select("query_id", F.length("prompt").alias("prompt_chars"), F.md5("prompt").alias("prompt_md5"))


@query("generate_batch")
def generate_batch(spark, sf):
    out = prompts.generate_batch(flows.prompts_for(questions(spark, sf), selected(spark, sf)))
    return out.select("query_id", F.md5("raw").alias("raw_md5"), "attempts")


# Model outputs of every kind, one per exchange. An answer's lines are dealt to at most 12 blocks, which the contract
# allows; one that does not fit them is an output to refuse.
OUTPUTS_SQL = """
lined AS (SELECT conv_id, turn, answer, list_filter(string_split(answer, chr(10)), lambda x: x <> '') AS l FROM exchanges),
dealt AS (SELECT conv_id, turn, answer, list_transform(range(0, len(l), greatest(1, ceil(len(l) / 12)::BIGINT)), lambda a: array_to_string(l[a + 1 : a + greatest(1, ceil(len(l) / 12)::BIGINT)], chr(10))) AS bl FROM lined),
judged AS (SELECT conv_id, turn, bl, CASE conv_id % 7 WHEN 0 THEN 'structured_output_invalid' WHEN 1 THEN 'structured_output_invalid' WHEN 2 THEN NULL
   WHEN 3 THEN CASE WHEN length(answer) BETWEEN 1 AND 2000 THEN 'invalid_model_evidence_id' ELSE 'structured_output_invalid' END
   WHEN 4 THEN CASE WHEN length(answer) BETWEEN 1 AND 2000 THEN 'invalid_model_evidence_id' ELSE 'structured_output_invalid' END
   ELSE CASE WHEN len(bl) = 0 OR len(list_filter(bl, lambda x: length(x) > 2000)) > 0 THEN 'structured_output_invalid' END END AS code FROM dealt)
"""


def outputs(spark, sf):
    """Raw outputs: broken, inconsistent, refused, with bad ids, and sound ones."""
    x = exchanges(spark, sf)

    def answer(*evidence_ids, tail=False):
        lines = F.filter(F.split("answer", "\n", -1), lambda t: t != "")
        step = F.greatest(F.lit(1), F.ceil(F.size(lines) / 12).cast("int"))
        starts = F.when(F.size(lines) > 0, F.sequence(F.lit(0), F.size(lines) - 1, step)).otherwise(F.array().cast("array<int>"))
        blocks = F.transform(
            F.transform(starts, lambda a: F.array_join(F.slice(lines, a + 1, step), "\n")),
            lambda t, i: F.struct(t.alias("text"), F.array(F.concat(F.lit("E"), (i % 3 + 1).cast("string")), F.concat(F.lit("E"), (i % 2 + 4).cast("string"))).alias("evidence_ids")),
        )
        one = F.array(F.struct(F.col("answer").alias("text"), F.array(*[F.lit(e) for e in evidence_ids]).alias("evidence_ids"))) if evidence_ids else blocks
        return F.to_json(F.struct(F.lit("answered").alias("status"), one.alias("answer_blocks"), F.array().cast("array<string>").alias("limitations")))

    kind = F.col("conv_id") % 7
    raw = (
        F.when(kind == 0, "{broken")
        .when(kind == 1, '{"status":"answered","answer_blocks":[],"limitations":[]}')
        .when(kind == 2, '{"status":"insufficient_evidence","answer_blocks":[],"limitations":["x"]}')
        .when(kind == 3, answer("E1", "E1"))
        .when(kind == 4, answer("E9"))
        .otherwise(answer())
    )
    allowed = F.array(*[F.lit(f"E{i}") for i in range(1, 6)])
    return x.select(F.concat_ws("/", F.col("conv_id").cast("string"), F.col("turn").cast("string")).alias("query_id"), "conv_id", "turn", raw.alias("raw"), allowed.alias("allowed_ids"))


@query(
    "answer_validate",
    f"""WITH {EXCHANGES_SQL}, {OUTPUTS_SQL} SELECT conv_id, turn, CASE WHEN code IS NULL AND conv_id % 7 IN (5, 6) THEN 'answered' ELSE 'insufficient_evidence' END AS status, code,
      CASE WHEN code IS NULL AND conv_id % 7 IN (5, 6) THEN len(bl) ELSE 0 END AS blocks FROM judged""",
)
def answer_validate(spark, sf):
    return prompts.answer_validate(outputs(spark, sf)).select("conv_id", "turn", "status", "code", F.size("answer_blocks").alias("blocks"))


CITE_SQL = """
blocks AS (SELECT conv_id, turn, unnest(bl) AS text, generate_subscripts(bl, 1) - 1 AS b FROM judged WHERE conv_id % 7 IN (5, 6) AND code IS NULL),
uses AS (SELECT conv_id, turn, b, text, 0 AS place, 'E' || (b % 3 + 1) AS e FROM blocks UNION ALL SELECT conv_id, turn, b, text, 1, 'E' || (b % 2 + 4) FROM blocks),
firsts AS (SELECT conv_id, turn, e, min(b * 10 + place) AS f FROM uses GROUP BY ALL),
nums AS (SELECT *, row_number() OVER (PARTITION BY conv_id, turn ORDER BY f) AS citation FROM firsts),
marks AS (SELECT conv_id, turn, b, any_value(text) AS text, string_agg('[' || citation || ']', '' ORDER BY place) AS m FROM uses JOIN nums USING (conv_id, turn, e) GROUP BY ALL)
"""


@query(
    "cite_resolve",
    f"""WITH {EXCHANGES_SQL}, {OUTPUTS_SQL}, {CITE_SQL} SELECT conv_id, turn, md5(string_agg(text || ' ' || m, chr(10) || chr(10) ORDER BY b)) AS answer_md5, count(*) AS blocks FROM marks GROUP BY ALL
    UNION ALL SELECT conv_id, turn, md5('The available evidence does not allow a reliable answer.'), 0 FROM judged WHERE conv_id % 7 NOT IN (5, 6) OR code IS NOT NULL""",
)
def cite_resolve(spark, sf):
    valid = prompts.answer_validate(outputs(spark, sf))
    numbered = citations.number_citations(valid)
    out = citations.render_answers(valid, numbered)
    return out.select("conv_id", "turn", F.md5("answer").alias("answer_md5"), F.size("answer_blocks").alias("blocks"))


@query(
    "cite_resolve_sources",
    """SELECT 'd' || lpad(doc_id::VARCHAR, 8, '0') AS document_id, CASE doc_id % 5 WHEN 0 THEN 'evidence artifact no longer exists' WHEN 1 THEN 'evidence document version mismatch' WHEN 2 THEN 'evidence content hash mismatch' WHEN 3 THEN 'evidence source hash mismatch' END AS error, doc_id % 5 = 4 AS source_validated, substr(text, 1, 300) AS preview FROM documents""",
)
def cite_resolve_sources(spark, sf):
    d = documents(spark, sf)
    key = F.concat(F.lit("d"), F.lpad(F.col("doc_id").cast("string"), 8, "0"))
    h = ids.sha256(F.col("text"))
    kind = F.col("doc_id") % 5
    numbered = d.select(F.col("doc_id").alias("query_id"), F.lit("E1").alias("evidence_id"), F.lit(1).alias("citation"))
    ev = d.select(
        F.col("doc_id").alias("query_id"), F.lit("E1").alias("evidence_id"), key.alias("artifact_id"), F.lit("child").alias("artifact_type"), key.alias("document_id"),
        F.when(kind == 1, "old").otherwise("v").alias("document_version_id"), F.when(kind == 2, "old").otherwise(h).alias("content_sha256"),
        F.when(kind == 3, "old").otherwise(h).alias("source_sha256"), F.array("text").alias("quotes"),
    )
    arts = d.filter(kind != 0).select(key.alias("artifact_id"), F.lit("child").alias("artifact_type"), F.lit("v").alias("document_version_id"), h.alias("content_sha256"))
    src = d.select(key.alias("document_id"), "text", F.when(kind == 3, "old").otherwise(h).alias("source_sha256"))
    return citations.resolve_citations(numbered, ev, arts, src).select("document_id", "error", "source_validated", "preview")


# Selectors of every word of each document, shifted for every other one; a line per document digests them.
@query(
    "cite_quote_match",
    """WITH w AS (SELECT doc_id, unnest(string_split(text, ' ')) AS exact, generate_subscripts(string_split(text, ' '), 1) AS i FROM documents),
    p AS (SELECT doc_id, exact, i, (sum(length(exact) + 1) OVER (PARTITION BY doc_id ORDER BY i))::BIGINT - length(exact) - 1 AS s FROM w),
    x AS (SELECT doc_id, i, exact, s, text, substr(text, greatest(s - 6, 0) + 1, s - greatest(s - 6, 0)) AS prefix, substr(text, s + length(exact) + 1, 6) AS suffix FROM p JOIN documents USING (doc_id) WHERE exact <> ''),
    f AS (SELECT *, instr(text, prefix || exact || suffix) AS first FROM x),
    n AS (SELECT doc_id, i, s, (doc_id + i) % 2 = 0 AS moved, instr(substr(text, first + 1), prefix || exact || suffix) = 0 AS alone, substr(text, s + 4, length(exact)) = exact AS still FROM f),
    r AS (SELECT doc_id, i, CASE WHEN NOT moved THEN s WHEN still THEN s + 3 WHEN alone THEN s END AS start, CASE WHEN NOT moved OR still THEN 'position' WHEN alone THEN 'quote_fallback' END AS mode FROM n)
    SELECT doc_id, count(*) AS words, count(*) FILTER (mode = 'position') AS in_place, count(*) FILTER (mode = 'quote_fallback') AS found, coalesce(sum(start), 0)::BIGINT AS starts, coalesce(sum(start * i), 0)::BIGINT AS weighed FROM r GROUP BY doc_id""",
)
def cite_quote_match(spark, sf):
    # Laid out before the texts are cut, so that the words need not move.
    d = documents(spark, sf).select(F.col("doc_id").alias("document_id"), "text").repartition("document_id")
    words = F.split("text", " ", -1)
    # Start of each word: the lengths before it, as a running sum over the document's words.
    w = Window.partitionBy("document_id").orderBy("i")
    placed = d.select("document_id", F.posexplode(words).alias("at", "exact")).withColumn("i", F.col("at") + 1)
    placed = placed.withColumn("s", F.sum(F.length("exact") + 1).over(w) - F.length("exact") - 1).filter("exact <> ''")
    spans = placed.select("document_id", "i", F.lit(0).alias("page"), F.col("s").alias("char_start"), (F.col("s") + F.length("exact")).alias("char_end"))
    no_pages = spans.select("document_id", "page", F.lit(0).alias("page_start"), F.lit(0).alias("page_end")).limit(0)
    cut = evidence.selectors(spans, d, no_pages, context=6)
    shift = F.when((F.col("document_id") + F.col("i")) % 2 == 0, 3).otherwise(0)
    asked = cut.select(
        "document_id", "i", "exact", "prefix", "suffix", (F.col("position_start") + shift).alias("position_start"), (F.col("position_end") + shift).alias("position_end")
    )
    found = citations.resolve_in_documents(asked, d)
    return found.groupBy(F.col("document_id").alias("doc_id")).agg(
        F.count(F.lit(1)).alias("words"), F.count_if(F.col("mode") == "position").alias("in_place"), F.count_if(F.col("mode") == "quote_fallback").alias("found"),
        F.coalesce(F.sum("resolved_start"), F.lit(0)).alias("starts"), F.coalesce(F.sum(F.col("resolved_start") * F.col("i")), F.lit(0)).alias("weighed"),
    )


@query(
    "answer_sources_v1",
    f"""WITH {lex_sql(k=5)} SELECT query_id, rank AS citation, chunk_id, CASE WHEN doc_id % 4 = 0 THEN 'Unknown Document' ELSE source END AS document_name, source AS category, CASE WHEN doc_id % 2 = 0 THEN 7 ELSE 9 END AS page, substr(text, 1, 300) AS chunk_preview, score AS rrf_score FROM bm25 JOIN documents ON doc_id = chunk_id""",
)
def answer_sources_v1(spark, sf):
    top = bm25(spark, sf).filter("rank <= 5")
    item = F.struct("rank", F.struct("chunk_id", F.lit(9).alias("page"), F.col("score").alias("rrf_score")).alias("s"))
    rows = top.groupBy("query_id").agg(F.transform(F.array_sort(F.collect_list(item)), lambda x: x["s"]).alias("sources"))
    d = documents(spark, sf).select(
        F.col("doc_id").alias("chunk_id"), F.when(F.col("doc_id") % 4 != 0, F.col("source")).alias("title"), F.col("source").alias("category"),
        F.when(F.col("doc_id") % 2 == 0, 7).alias("page_start"), "text",
    )
    return citations.answer_sources_v1(rows, d)


@query("answer_pipeline_v1")
def answer_pipeline_v1(spark, sf):
    top = hybrid_run(spark, sf).final.select("query_id", "chunk_id", F.col("final_rank").alias("position"), "content", "document_title")
    out = flows.answer_v1(questions(spark, sf), top)
    return out.select("query_id", F.length("prompt").alias("prompt_chars"), F.md5("raw").alias("raw_md5"))


@query("answer_pipeline_v2")
def answer_pipeline_v2(spark, sf):
    out = flows.answer_v2(questions(spark, sf), selected(spark, sf))
    return out.select("query_id", "status", "code", F.length("answer").alias("answer_chars"))


# --------------------------------------------------------------- catalogue


@query(
    "catalog_documents",
    chain_sql() + """, counts AS (SELECT document_id, count(*) AS chunk_count, array_to_string(list_sort(list(DISTINCT number) FILTER (kind = 'article')), ',') AS articles FROM heads GROUP BY ALL),
    pg AS (SELECT document_id, max(page) AS page_count FROM paged GROUP BY ALL)
    SELECT document_id, category AS title, coalesce(page_count, 0) AS page_count, coalesce(chunk_count, 0) AS chunk_count, coalesce(articles, '') AS articles FROM corpus LEFT JOIN counts USING (document_id) LEFT JOIN pg USING (document_id)""",
)
def catalog_documents(spark, sf):
    from corpusloom.operators import catalog

    docs = structured(spark, sf)
    chunks = parsed(spark, sf).select("document_id", F.when(F.col("kind") == "article", F.col("number")).alias("article"))
    out = catalog.catalog_documents(docs.select("document_id", F.col("category").alias("title")), chunks, pages.page_bounds(docs))
    return out.select("document_id", "title", F.coalesce("page_count", F.lit(0)).alias("page_count"), "chunk_count", F.array_join("articles", ",").alias("articles"))


@query(
    "catalog_page",
    chain_sql(SPANS_SQL, PAGE_BOUNDS_SQL) + """, ranges AS (SELECT document_id, node_line, min(page) AS page_start, max(page) AS page_end FROM spans GROUP BY ALL),
    asked AS (SELECT DISTINCT document_id, page, page_text FROM bounds)
    SELECT a.document_id, a.page, md5(page_text) AS page_md5, count(r.node_line) AS chunks FROM asked a LEFT JOIN ranges r ON r.document_id = a.document_id AND a.page BETWEEN r.page_start AND r.page_end GROUP BY ALL""",
)
def catalog_page(spark, sf):
    from corpusloom.operators import catalog

    bounds = pages.page_bounds(structured(spark, sf))
    chunks = parsed(spark, sf).select(
        "document_id", F.col("node_line").cast("string").alias("chunk_id"), F.array_min(F.transform("spans", lambda s: s["page"])).alias("page_start"),
        F.array_max(F.transform("spans", lambda s: s["page"])).alias("page_end"),
    )
    out = catalog.catalog_page(bounds.select("document_id", "page"), bounds, chunks)
    return out.select("document_id", "page", F.md5("page_text").alias("page_md5"), F.size("chunk_ids").alias("chunks"))


@query(
    "catalog_highlight",
    chain_sql(SPANS_SQL) + """, firsts AS (SELECT document_id, node_line, arg_min(char_start, run) AS position_start FROM spans WHERE char_end > char_start GROUP BY ALL)
    SELECT h.document_id, h.node_line::VARCHAR AS chunk_id, coalesce(position_start, -1) AS position_start, CASE WHEN position_start IS NULL THEN 'unresolved' ELSE 'resolved' END AS status FROM heads h LEFT JOIN firsts USING (document_id, node_line)""",
)
def catalog_highlight(spark, sf):
    from corpusloom.operators import catalog

    docs = structured(spark, sf)
    nodes = parsed(spark, sf).withColumn("chunk_id", F.concat_ws(":", "document_id", F.col("node_line").cast("string")))
    spans = nodes.select("document_id", "chunk_id", F.posexplode("spans").alias("span_no", "s")).select("document_id", "chunk_id", "span_no", "s.page", "s.char_start", "s.char_end")
    found = evidence.selectors(spans, docs, pages.page_bounds(docs))
    out = catalog.catalog_highlight(nodes, found)
    return out.select("document_id", F.element_at(F.split("chunk_id", ":"), -1).alias("chunk_id"), F.coalesce("position_start", F.lit(-1)).alias("position_start"), "status")


@query("stream_ingest", "SELECT count(*) AS documents, sum(n_chars) AS chars FROM documents")
def stream_ingest(spark, sf):
    from corpusloom.streaming import ingest

    from .q_store import fresh

    root, inbox = fresh(spark, "stream"), fresh(spark, "inbox")
    docs = structured(spark, sf)
    docs.repartition(2).write.json(inbox)
    ingest.run_once(spark, inbox, root)
    ingest.run_once(spark, inbox, root)  # a replay changes nothing
    stored = ingest.current(spark, root, "documents")
    plain = documents(spark, sf).select(F.concat(F.lit("d"), F.lpad(F.col("doc_id").cast("string"), 8, "0")).alias("document_id"), "n_chars")
    return stored.join(plain, "document_id").agg(F.count(F.lit(1)).alias("documents"), F.sum("n_chars").alias("chars"))
