"""Chunking and relations on documents shaped like numbered legal text."""

from __future__ import annotations

from pyspark.sql import functions as F

from corpusloom.functions import ids
from corpusloom.functions import text as tx
from corpusloom.operators import chunking, relations, structure
from corpusloom.plans import corpus

from .bindings import ITEMIZED_SQL, STRUCTURED_SQL, WS, itemized, sql_count, sql_strip, structured
from .q_structure import CLASSIFIED_SQL, LINES_SQL, NODES_SQL, PATHS_SQL, SPANS_SQL, TABLES_SQL, kinds_sql
from .registry import query, staged

def meta(spark, sf, docs=None):
    """Identified documents; the table's own key stays the identifier."""
    docs = structured(spark, sf) if docs is None else docs
    scores = tx.profile_scores(F.col("text"), F.col("category"), F.col("category"))
    return docs.select(
        "document_id",
        "category",
        "source_relative_path",
        F.concat("document_id", F.lit(".md")).alias("source_file"),
        "text",
        F.col("category").alias("document_title"),
        F.col("category").alias("short_title"),
        F.lit("GUIDANCE").alias("profile"),
        tx.detected_profiles(scores).alias("profiles"),
        ids.version_id(F.col("document_id"), tx.canonical(F.col("text"))).alias("document_version_id"),
        ids.sha256(tx.canonical(F.col("text"))).alias("content_hash"),
        ids.sha256(F.col("text")).alias("source_sha256"),
        F.col("text").rlike(tx.PAGE_MARKER).alias("has_pages"),
        tx.is_blank(F.col("text")).alias("is_empty"),
    )


def built(spark, sf) -> corpus.Corpus:
    return corpus.build_corpus(meta(spark, sf), stage=lambda df, name: staged(spark, sf, f"corpus-{name}", lambda: df))


def children(spark, sf):
    """Children alone, for queries that read no parents."""
    return corpus.build_children(meta(spark, sf), stage=lambda df, name: staged(spark, sf, f"corpus-{name}", lambda: df))



CUT = 120
ATOMS_SQL = rf"""
pieces AS (SELECT *, regexp_matches(t, '^(?:[#|>]|- |\* )') OR regexp_matches(t, '(?i)^(?:[0-9]+(?:[.-][0-9]+)*\.?|[a-zəçşıöüğ]\))[{WS}]+') AS s FROM owned WHERE node_line IS NOT NULL),
glued AS (SELECT document_id, node_line, line_no, CASE WHEN lag(s) OVER w IS NULL THEN '' WHEN s OR lag(s) OVER w THEN chr(10) ELSE ' ' END || t AS piece
   FROM pieces WINDOW w AS (PARTITION BY document_id, node_line ORDER BY line_no)),
contents AS (SELECT document_id, node_line, {sql_strip("string_agg(piece, '' ORDER BY line_no)")} AS content, count(*) AS n_lines FROM glued GROUP BY ALL),
kids AS (SELECT document_id, parent_line AS node_line FROM heads WHERE parent_line > 0 GROUP BY ALL),
noded AS (SELECT l.*, c.content, c.n_lines, k.node_line IS NOT NULL AS has_children, p.kind AS parent_kind, p.title AS parent_title,
   CASE WHEN p.kind IN ('clause', 'subclause', 'paragraph') THEN nullif(pc.content, '') END AS lead_in,
   row_number() OVER (PARTITION BY l.document_id, l.kind, l.locator ORDER BY l.node_line) AS occurrence
   FROM located l JOIN contents c USING (document_id, node_line) LEFT JOIN kids k USING (document_id, node_line)
   LEFT JOIN heads p ON p.document_id = l.document_id AND p.node_line = l.parent_line
   LEFT JOIN contents pc ON pc.document_id = l.document_id AND pc.node_line = l.parent_line),
filled AS (SELECT n.*, c.category FROM noded n JOIN corpus c USING (document_id)
   WHERE content <> '' AND NOT (has_children AND n_lines = 1 AND kind IN ('chapter', 'article', 'section', 'heading', 'annex'))),
useful AS (SELECT * FROM filled WHERE kind <> 'table'),
lead_words AS (SELECT document_id, node_line, i, w, sum({sql_count('w')}) OVER (PARTITION BY document_id, node_line ORDER BY i) AS cum
   FROM (SELECT document_id, node_line, unnest(list_filter(string_split_regex(lead_in, '[{WS}]+'), lambda x: x <> '')) AS w, generate_subscripts(list_filter(string_split_regex(lead_in, '[{WS}]+'), lambda x: x <> ''), 1) AS i FROM useful WHERE lead_in IS NOT NULL)),
lead_cut AS (SELECT document_id, node_line, string_agg(w, ' ' ORDER BY i) AS cut FROM lead_words WHERE i = 1 OR cum <= {CUT} GROUP BY ALL),
prefixed AS (SELECT u.*, concat_ws(chr(10), 'Document: ' || category, 'Chapter: ' || chapter_label, 'Article: ' || article_label, 'Section: ' || section_label, 'Annex: ' || annex_label,
     'Clause: ' || nullif(clause, ''), 'Subclause: ' || nullif(subclause, ''), 'Parent lead-in: ' || cut) AS prefix,
   'unit_' || substr(sha256(document_id || chr(31) || kind || chr(31) || {sql_strip("locator || CASE WHEN occurrence > 1 THEN ' [occurrence ' || occurrence || ']' ELSE '' END")}), 1, 24) AS unit_id
   FROM useful u LEFT JOIN lead_cut USING (document_id, node_line)),
limits AS (SELECT *, {sql_count('prefix')} AS prefix_tokens, greatest(8, 450 - {sql_count('prefix')} - 3) AS budget FROM prefixed)
"""


def split_sql(src: str, keys: str) -> str:
    """Greedy split of ``content`` rows of ``src(keys, content, prefix_tokens, budget)``: ``parts(keys, part_no, text, forced)``."""
    on = " AND ".join(f"a.{k.strip()} = b.{k.strip()}" for k in keys.split(","))
    a_keys = ", ".join(f"a.{k.strip()}" for k in keys.split(","))
    trimmed = sql_strip("x")

    def cut(marks: str, after: str) -> str:
        marked = f"regexp_replace(regexp_replace(content, '([{marks}])[{WS}]+({after})', '\\1' || chr(1) || '\\2', 'g'), '([{marks}])[{WS}]+({after})', '\\1' || chr(1) || '\\2', 'g')"
        return f"list_filter(list_transform(string_split({marked}, chr(1)), lambda x: {trimmed}), lambda x: x <> '')"

    sentences, clauses = cut(".!?…;:", "[A-ZƏÖÜİŞÇĞ0-9]"), cut(",;:", "[^" + WS + "]")
    return f"""
big AS (SELECT {keys}, content, budget FROM {src} WHERE prefix_tokens + 2 + {sql_count('content')} > 450),
sents AS (SELECT {keys}, budget, CASE WHEN len({sentences}) = 1 THEN {clauses} ELSE {sentences} END AS l FROM big),
sent AS (SELECT {keys}, budget, unnest(l) AS t, generate_subscripts(l, 1) AS i FROM sents),
counted_sent AS (SELECT *, {sql_count('t')} AS n FROM sent),
hard_words AS (SELECT {keys}, i, budget, unnest(list_filter(string_split_regex(t, '[{WS}]+'), lambda x: x <> '')) AS w,
   generate_subscripts(list_filter(string_split_regex(t, '[{WS}]+'), lambda x: x <> ''), 1) AS j FROM counted_sent WHERE n > budget),
hard_sized AS MATERIALIZED (SELECT *, {sql_count('w')} AS c FROM hard_words),
hard_walk AS (SELECT {keys}, i, j, 1 AS piece, c AS acc FROM hard_sized WHERE j = 1
   UNION ALL SELECT {a_keys}, a.i, b.j, CASE WHEN a.acc + b.c > b.budget THEN a.piece + 1 ELSE a.piece END, CASE WHEN a.acc + b.c > b.budget THEN b.c ELSE a.acc + b.c END
   FROM hard_walk a JOIN hard_sized b ON {on} AND a.i = b.i AND b.j = a.j + 1),
hard_pieces AS (SELECT {keys}, i, piece, string_agg(w, ' ' ORDER BY j) AS t FROM hard_walk JOIN hard_sized USING ({keys}, i, j) GROUP BY {keys}, i, piece),
units_raw AS (SELECT {keys}, budget, i, 0 AS piece, t, n, 0 AS hard FROM counted_sent WHERE n <= budget
   UNION ALL SELECT {keys}, NULL, i, piece, t, 0, 1 FROM hard_pieces),
units AS MATERIALIZED (SELECT * EXCLUDE (budget), max(budget) OVER (PARTITION BY {keys}) AS budget, row_number() OVER (PARTITION BY {keys} ORDER BY i, piece) AS u FROM units_raw),
unit_walk AS (SELECT {keys}, u, 1 AS part_no, n AS acc, hard FROM units WHERE u = 1
   UNION ALL SELECT {a_keys}, b.u, CASE WHEN a.hard = 1 OR b.hard = 1 OR a.acc + b.n > b.budget THEN a.part_no + 1 ELSE a.part_no END,
     CASE WHEN a.hard = 1 OR b.hard = 1 OR a.acc + b.n > b.budget THEN b.n ELSE a.acc + b.n END, b.hard
   FROM unit_walk a JOIN units b ON {on} AND b.u = a.u + 1),
parts AS (SELECT {keys}, part_no, string_agg(t, ' ' ORDER BY u) AS text FROM unit_walk JOIN units USING ({keys}, u) GROUP BY {keys}, part_no
   UNION ALL SELECT {keys}, 1, content FROM {src} WHERE prefix_tokens + 2 + {sql_count('content')} <= 450)
"""


def atoms_sql(corpus_sql: str = STRUCTURED_SQL, *extra: str) -> str:
    parts = [corpus_sql, LINES_SQL, CLASSIFIED_SQL, kinds_sql(), NODES_SQL, PATHS_SQL, ATOMS_SQL, *extra]
    return "WITH RECURSIVE " + ",".join(parts)


def unit_id_sql(kind: str, locator: str) -> str:
    named = f"{locator} || CASE WHEN occurrence > 1 THEN ' [occurrence ' || occurrence || ']' ELSE '' END"
    return f"'unit_' || substr(sha256(document_id || chr(31) || {kind} || chr(31) || {sql_strip(named)}), 1, 24)"


# Row groups of tables, packed greedily with the header, and all units of both kinds with their split parts.
UNITS_SQL = f"""
t_heads AS (SELECT document_id, node_line, max(CASE WHEN ruled = 1 AND n = 1 THEN array_to_string(cells, ' | ') END) AS hdr, max(CASE WHEN ruled = 1 AND n = 1 THEN array_to_string(cells, '~') END) AS headers,
   max(CASE WHEN ruled = 1 AND n = 1 THEN len(cells) END) AS width, greatest(1, sum((n > 2 * ruled)::INT)) AS total_rows FROM t_cells GROUP BY ALL),
t_named AS (SELECT f.*, h.* EXCLUDE (document_id, node_line), concat_ws(chr(10), 'Document: ' || category, 'Chapter: ' || chapter_label, 'Article: ' || article_label, 'Section: ' || section_label,
     'Annex: ' || annex_label, 'Clause: ' || nullif(clause, ''), 'Subclause: ' || nullif(subclause, '')) || coalesce(chr(10) || 'Table: ' || parent_title, '') || chr(10) || 'Column headers: ' || coalesce(hdr, '') AS prefix,
   coalesce('| ' || hdr || ' |' || chr(10) || '| ' || array_to_string(list_transform(range(width), lambda i: '---'), ' | ') || ' |', '') AS header_md
   FROM filled f JOIN t_heads h USING (document_id, node_line) WHERE kind = 'table'),
t_sized AS (SELECT *, {sql_count('prefix')} AS prefix_tokens, {sql_count('header_md')} AS header_tokens FROM t_named),
t_md AS (SELECT document_id, node_line, n, '| ' || array_to_string(cells, ' | ') || ' |' AS md, len(list_filter(cells, lambda c: regexp_matches(c, '[^ _.-]'))) > 0 AS has_text,
   len(list_filter(cells, lambda c: c <> '')) > 0 AS has_any FROM t_cells WHERE n > 2 * ruled),
t_seq AS MATERIALIZED (SELECT m.document_id, m.node_line, md, row_number() OVER (PARTITION BY m.document_id, m.node_line ORDER BY n) AS r, {sql_count('md')} AS c, header_tokens,
   greatest(1, 450 - prefix_tokens - 8) AS room FROM t_md m JOIN t_sized USING (document_id, node_line) WHERE has_text),
t_walk AS (SELECT document_id, node_line, r, 1 AS grp, header_tokens + c AS tok FROM t_seq WHERE r = 1
   UNION ALL SELECT a.document_id, a.node_line, b.r, CASE WHEN a.tok + b.c > b.room THEN a.grp + 1 ELSE a.grp END, CASE WHEN a.tok + b.c > b.room THEN b.header_tokens + b.c ELSE a.tok + b.c END
   FROM t_walk a JOIN t_seq b ON a.document_id = b.document_id AND a.node_line = b.node_line AND b.r = a.r + 1),
t_groups AS (SELECT document_id, node_line, grp, min(r) AS row_start, max(r) AS row_end, string_agg(md, chr(10) ORDER BY r) AS body FROM t_walk JOIN t_seq USING (document_id, node_line, r) GROUP BY ALL
   UNION ALL SELECT document_id, node_line, 1, 1, 1, (SELECT string_agg(md, chr(10) ORDER BY n) FROM t_md m WHERE m.document_id = s.document_id AND m.node_line = s.node_line AND has_any)
   FROM t_sized s WHERE NOT EXISTS (SELECT 1 FROM t_seq q WHERE q.document_id = s.document_id AND q.node_line = s.node_line)),
t_units AS (SELECT s.*, g.grp, g.row_start, g.row_end, CASE WHEN header_md <> '' THEN concat_ws(chr(10), header_md, nullif(body, '')) ELSE coalesce(body, '') END AS text,
   locator || ', sətirlər ' || row_start || '-' || row_end AS unit_locator FROM t_sized s JOIN t_groups g USING (document_id, node_line)),
every AS (SELECT document_id, node_line, 0 AS grp, locator AS unit_locator, content, lead_in, prefix, prefix_tokens, unit_id, budget FROM limits
   UNION ALL SELECT document_id, node_line, grp, unit_locator, text, lead_in, prefix, prefix_tokens, {unit_id_sql("'table_row_group'", 'unit_locator')}, greatest(8, 450 - prefix_tokens - 3) FROM t_units),
{split_sql("every", "document_id, node_line, grp").strip()},
pieces_of AS (SELECT e.* EXCLUDE (content), part_no, text, count(*) OVER (PARTITION BY document_id, node_line, grp) AS split_count FROM parts JOIN every e USING (document_id, node_line, grp))
"""


def units_sql() -> str:
    return atoms_sql(STRUCTURED_SQL, TABLES_SQL, UNITS_SQL)


@query(
    "chunk_atoms",
    units_sql() + """ SELECT document_id, node_line, unit_id, unit_locator AS locator, part_no AS split_index, split_count, md5(text) AS content_md5, md5(coalesce(lead_in, '')) AS lead_in_md5, prefix_tokens
    FROM pieces_of""",
)
def chunk_atoms(spark, sf):
    units = chunking.atoms(structure.parse(structured(spark, sf)), meta(spark, sf))
    prefix = F.split("embedding_text", "\nText: ", 2)[0]
    return units.select(
        "document_id", "node_line", F.col("logical_unit_id").alias("unit_id"), "locator", "split_index", "split_count", F.md5("content").alias("content_md5"),
        F.md5(F.coalesce("parent_lead_in", F.lit(""))).alias("lead_in_md5"), tx.tok_count(prefix).alias("prefix_tokens"),
    )


@query("txt_embedding_prefix", units_sql() + " SELECT DISTINCT document_id, node_line, md5(prefix) AS prefix_md5 FROM every")
def txt_embedding_prefix(spark, sf):
    units = chunking.atoms(structure.parse(structured(spark, sf)), meta(spark, sf))
    prefix = F.split("embedding_text", "\nText: ", 2)[0]
    return units.select("document_id", "node_line", F.md5(prefix).alias("prefix_md5")).distinct()


@query("chunk_split", units_sql() + " SELECT document_id, node_line, unit_locator AS locator, part_no, md5(text) AS text_md5 FROM pieces_of")
def chunk_split(spark, sf):
    units = chunking.atoms(structure.parse(structured(spark, sf)), meta(spark, sf))
    return units.select("document_id", "node_line", "locator", F.col("split_index").alias("part_no"), F.md5("content").alias("text_md5"))


@query(
    "chunk_table_rows",
    units_sql() + f""" SELECT document_id, node_line, unit_locator AS locator, part_no AS split_index, split_count,
    'table_' || substr(sha256(document_id || chr(31) || {sql_strip('t.locator')} || chr(31) || node_line), 1, 24) AS table_id, row_start, row_end, total_rows, coalesce(headers, '') AS headers,
    md5(p.text) AS text_md5, {sql_count("p.prefix || chr(10) || 'Text: ' || p.text")} AS token_count FROM pieces_of p JOIN (SELECT document_id, node_line, grp, locator, row_start, row_end, total_rows, headers FROM t_units) t USING (document_id, node_line, grp)""",
)
def chunk_table_rows(spark, sf):
    units = chunking.atoms(structure.parse(structured(spark, sf)), meta(spark, sf)).filter("table is not null")
    return units.select(
        "document_id", "node_line", "locator", "split_index", "split_count", "table.table_id", "table.row_start", "table.row_end",
        "table.total_rows", F.array_join("table.column_headers", "~").alias("headers"), F.md5("content").alias("text_md5"), "token_count",
    )


def itemized_drafts(spark, sf):
    docs = itemized(spark, sf)
    return chunking.pack_siblings(chunking.atoms(structure.parse(docs), meta(spark, sf, docs)))


PACK_SQL = split_sql("limits", "document_id, node_line") + f""",
part_counts AS (SELECT document_id, node_line, count(*) AS split_count FROM parts GROUP BY ALL),
unit_rows AS (SELECT p.document_id, p.node_line, p.part_no, p.text, pc.split_count, l.boundary_line, l.parent_line, l.locator, l.prefix_tokens + 2 + {sql_count('p.text')} AS tokens, {sql_count('p.text')} AS ctok,
   {sql_count("'Document: ' || l.category || chr(10) || 'Hierarchy: ' || replace(l.heading_path, ' > ', chr(10))")} AS ptok,
   row_number() OVER (PARTITION BY p.document_id ORDER BY p.node_line, p.part_no) AS a
   FROM parts p JOIN part_counts pc USING (document_id, node_line) JOIN limits l USING (document_id, node_line)),
short_rows AS MATERIALIZED (SELECT *, split_count = 1 AND tokens < 60 AS short FROM unit_rows),
pack_walk AS (SELECT document_id, a, 1 AS chunk_no, short, boundary_line, parent_line, tokens AS t, ctok AS c, ptok AS p FROM short_rows WHERE a = 1
   UNION ALL SELECT x.document_id, b.a,
     CASE WHEN x.short AND b.short AND x.boundary_line = b.boundary_line AND x.parent_line = b.parent_line AND x.t < 180 AND x.p + 2 + x.c + b.ctok <= 450 THEN x.chunk_no ELSE x.chunk_no + 1 END,
     b.short, b.boundary_line, b.parent_line,
     CASE WHEN x.short AND b.short AND x.boundary_line = b.boundary_line AND x.parent_line = b.parent_line AND x.t < 180 AND x.p + 2 + x.c + b.ctok <= 450 THEN x.t + b.tokens ELSE b.tokens END,
     CASE WHEN x.short AND b.short AND x.boundary_line = b.boundary_line AND x.parent_line = b.parent_line AND x.t < 180 AND x.p + 2 + x.c + b.ctok <= 450 THEN x.c + b.ctok ELSE b.ctok END,
     CASE WHEN x.short AND b.short AND x.boundary_line = b.boundary_line AND x.parent_line = b.parent_line AND x.t < 180 AND x.p + 2 + x.c + b.ctok <= 450 THEN x.p ELSE b.ptok END
   FROM pack_walk x JOIN short_rows b ON b.document_id = x.document_id AND b.a = x.a + 1),
drafts AS MATERIALIZED (SELECT document_id, chunk_no, count(*) AS units, string_agg(text, chr(10) || chr(10) ORDER BY a) AS content, sum(ctok) AS ctok, min(w.boundary_line) AS boundary_line,
   min(split_count) AS split_count FROM pack_walk w JOIN short_rows USING (document_id, a) GROUP BY ALL)
"""


@query(
    "chunk_pack_siblings",
    atoms_sql(ITEMIZED_SQL, PACK_SQL) + " SELECT document_id, chunk_no, units, md5(content) AS content_md5, CASE WHEN units > 1 THEN 'short_sibling_pack' WHEN split_count > 1 THEN 'oversized_split' ELSE 'atomic_leaf' END AS packing_reason FROM drafts",
)
def chunk_pack_siblings(spark, sf):
    return itemized_drafts(spark, sf).select(
        "document_id", "chunk_no", F.size("atomic_units").alias("units"), F.md5("content").alias("content_md5"), "packing_reason"
    )


PARENTS_SQL = """
seg_walk AS (SELECT document_id, chunk_no, 1 AS segment, boundary_line, ctok AS t FROM drafts WHERE chunk_no = 1
   UNION ALL SELECT x.document_id, b.chunk_no, CASE WHEN x.boundary_line = b.boundary_line AND x.t + b.ctok <= 1200 THEN x.segment ELSE x.segment + 1 END, b.boundary_line,
     CASE WHEN x.boundary_line = b.boundary_line AND x.t + b.ctok <= 1200 THEN x.t + b.ctok ELSE b.ctok END
   FROM seg_walk x JOIN drafts b ON b.document_id = x.document_id AND b.chunk_no = x.chunk_no + 1)
"""


@query(
    "chunk_parents",
    atoms_sql(ITEMIZED_SQL, PACK_SQL, PARENTS_SQL)
    + " SELECT document_id, segment, count(*) AS children, md5(string_agg(content, chr(10) || chr(10) ORDER BY chunk_no)) AS content_md5, sum(ctok) AS token_count FROM seg_walk JOIN drafts USING (document_id, chunk_no) GROUP BY ALL",
)
def chunk_parents(spark, sf):
    docs = itemized(spark, sf)
    facts = meta(spark, sf, docs)
    nodes = staged(spark, sf, "itemized-nodes", lambda: structure.parse(docs))
    segmented = chunking.parent_segments(chunking.pack_siblings(chunking.atoms(nodes, facts)))
    _, parents = chunking.finish_chunks(segmented, nodes, facts)
    return parents.select(
        "document_id", "segment", F.size("child_chunk_ids").alias("children"), F.md5("content").alias("content_md5"), "token_count"
    )


@query("chunk_children")
def chunk_children(spark, sf):
    c = children(spark, sf)
    return c.select(
        "document_id", "chunk_no", "chunk_id", "parent_chunk_id", "chunk_type", "node_type", "canonical_locator", "page_start", "page_end",
        "split_index", "split_count", "embedding_token_count", "character_count", "sentence_count", "packing_reason", "parser_confidence",
        F.array_join("quality_flags", ",").alias("quality_flags"),
    )



V1_ART = rf"^(?:(?:M[{WS}]*a[{WS}]*d[{WS}]*d[{WS}]*ə)[{WS}]+([0-9]+)|([0-9]+)\.[{WS}]+([^0-9]|$))"
V1_CHA = rf"(?i)^(?:(?:F[{WS}]*ə[{WS}]*s[{WS}]*i[{WS}]*l|B[{WS}]*ö[{WS}]*l[{WS}]*m[{WS}]*ə)[{WS}]+([IVXLCDM0-9]+)|([IVXLCDM0-9]+)[{WS}]+(?:Fəsil|Bölmə))"
V1_SECTIONS_SQL = f"""
v_raw AS (SELECT document_id, category, i AS pos, string_split(text, chr(10))[i] AS raw FROM corpus, unnest(range(1, len(string_split(text, chr(10))) + 1 - (right(text, 1) = chr(10))::INT)) AS u(i)),
v_mark AS (SELECT *, TRY_CAST(regexp_extract(raw, '<!-- PAGE:[{WS}]*([0-9]+)[{WS}]*-->', 1) AS INT) AS marker FROM v_raw),
v_line AS (SELECT *, CASE WHEN marker IS NULL THEN raw ELSE {sql_strip(f"regexp_replace(raw, '<!-- PAGE:[{WS}]*[0-9]+[{WS}]*-->', '', 'g')")} END AS line FROM v_mark),
v_found AS (SELECT *, NOT (marker IS NOT NULL AND line = '') AND {sql_strip('line')} <> '---' AS used, nullif(regexp_extract(line, '{V1_CHA}', 1) || regexp_extract(line, '{V1_CHA}', 2), '') AS ch,
   nullif(regexp_extract(line, '{V1_ART}', 1) || regexp_extract(line, '{V1_ART}', 2), '') AS art FROM v_line),
v_open AS (SELECT *, used AND ch IS NOT NULL AS opens_ch, used AND ch IS NULL AND art IS NOT NULL AS opens_art FROM v_found),
sections AS (SELECT * FROM (SELECT document_id, category, pos, used, coalesce(last_value(marker IGNORE NULLS) OVER w, 1) AS page, sum((opens_ch OR opens_art)::INT) OVER w AS section_no,
     last_value(CASE WHEN opens_ch THEN ch END IGNORE NULLS) OVER w AS chapter, nullif(last_value(CASE WHEN opens_ch THEN '' WHEN opens_art THEN art END IGNORE NULLS) OVER w, '') AS article,
     CASE WHEN opens_ch OR opens_art THEN {sql_strip('line')} ELSE line END AS text FROM v_open WINDOW w AS (PARTITION BY document_id ORDER BY pos ROWS UNBOUNDED PRECEDING)) WHERE used)
"""


def sections(spark, sf):
    return chunking.v1_sections(structured(spark, sf))


@query(
    "chunk_v1_sections",
    f"WITH {STRUCTURED_SQL}, {V1_SECTIONS_SQL} SELECT document_id, section_no, coalesce(chapter, '') AS chapter, coalesce(article, '') AS article, count(*) AS lines, min(page) AS page_start, md5(string_agg(text, chr(10) ORDER BY pos)) AS text_md5 FROM sections GROUP BY ALL",
)
def chunk_v1_sections(spark, sf):
    item = F.struct("pos", "text")
    return sections(spark, sf).groupBy("document_id", "section_no", F.coalesce("chapter", F.lit("")).alias("chapter"), F.coalesce("article", F.lit("")).alias("article")).agg(
        F.count(F.lit(1)).alias("lines"), F.min("page").alias("page_start"),
        F.md5(F.array_join(F.transform(F.array_sort(F.collect_list(item)), lambda x: x["text"]), "\n")).alias("text_md5"),
    )


# The window walks the lines of a section; the overlap start is looked up per cut.
V1_WINDOW_SQL = f"""
v_sized AS MATERIALIZED (SELECT *, length(text) + 1 AS len, row_number() OVER (PARTITION BY document_id, section_no ORDER BY pos) AS n,
   (sum(length(text) + 1) OVER (PARTITION BY document_id, section_no ORDER BY pos))::BIGINT - length(text) - 1 AS before FROM sections),
v_back AS MATERIALIZED (SELECT a.*, greatest(1, (SELECT count(*) FROM v_sized b WHERE b.document_id = a.document_id AND b.section_no = a.section_no AND b.n < a.n AND a.before - b.before <= 500)) AS back FROM v_sized a),
v_walk AS (SELECT document_id, section_no, n, 1::BIGINT AS start, len AS cur, 1 AS part, 1::BIGINT AS part_start FROM v_back WHERE n = 1
   UNION ALL SELECT w.document_id, w.section_no, b.n, CASE WHEN w.cur + b.len > 4000 THEN greatest(w.start, b.n - b.back) ELSE w.start END,
     CASE WHEN w.cur + b.len > 4000 THEN b.before - s.before + b.len ELSE w.cur + b.len END, CASE WHEN w.cur + b.len > 4000 THEN w.part + 1 ELSE w.part END, 0
   FROM v_walk w JOIN v_back b ON b.document_id = w.document_id AND b.section_no = w.section_no AND b.n = w.n + 1
   JOIN v_sized s ON s.document_id = b.document_id AND s.section_no = b.section_no AND s.n = greatest(w.start, b.n - b.back)),
v_parts AS (SELECT document_id, section_no, part, min(start) AS a, max(n) AS z FROM v_walk GROUP BY ALL),
v_total AS (SELECT document_id, section_no, max(part) AS parts FROM v_parts GROUP BY ALL),
v_rows AS (SELECT p.document_id, p.section_no, p.part, t.parts, any_value(chapter) AS chapter, any_value(article) AS article, {sql_strip("string_agg(text, chr(10) ORDER BY n)")} AS text, arg_min(page, n) AS page_start, arg_max(page, n) AS page_end
   FROM v_parts p JOIN v_sized l ON l.document_id = p.document_id AND l.section_no = p.section_no AND l.n BETWEEN p.a AND p.z JOIN v_total t ON t.document_id = p.document_id AND t.section_no = p.section_no GROUP BY ALL),
v_kept AS (SELECT *, row_number() OVER (PARTITION BY document_id ORDER BY section_no, part) AS n FROM v_rows WHERE text <> ''),
v_chunks AS (SELECT document_id || '_' || coalesce(nullif(concat_ws('_', 'ch_' || chapter, 'art_' || article), ''), 'intro') || '_' || min(n) OVER (PARTITION BY document_id, section_no) || CASE WHEN parts > 1 THEN '_part' || part ELSE '' END AS chunk_id,
   document_id, page_start, page_end, text FROM v_kept)
"""
_V1 = f"WITH RECURSIVE {STRUCTURED_SQL}, {V1_SECTIONS_SQL}, {V1_WINDOW_SQL}"


@query("chunk_v1_window", _V1 + " SELECT chunk_id, document_id, page_start, page_end, md5(text) AS text_md5 FROM v_chunks")
def chunk_v1_window(spark, sf):
    return chunking.v1_window(sections(spark, sf)).select("chunk_id", "document_id", "page_start", "page_end", F.md5("text").alias("text_md5"))


@query(
    "doc_v1_metadata",
    _V1 + f""", n AS (SELECT document_id, count(*) AS total_chunks FROM v_chunks GROUP BY ALL), p AS (SELECT document_id, max(marker) AS m FROM v_mark GROUP BY ALL)
    SELECT document_id, category, document_id || '.pdf' AS source_file, greatest(1, coalesce(m, 1)) AS total_pages, coalesce(total_chunks, 0) AS total_chunks, 'az' AS language FROM corpus LEFT JOIN n USING (document_id) LEFT JOIN p USING (document_id)""",
)
def doc_v1_metadata(spark, sf):
    docs = structured(spark, sf)
    return chunking.v1_metadata(chunking.v1_window(sections(spark, sf)), docs).select(
        "document_id", "category", "source_file", "total_pages", "total_chunks", "language"
    )
