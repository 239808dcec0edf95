"""Structure detection on documents shaped like numbered legal text."""

from __future__ import annotations

from pyspark.sql import functions as F

from corpusloom.operators import structure

from .bindings import STRUCTURED_SQL, WS, sql_strip, structured
from .registry import query

S = WS
LINES_SQL = rf"""
raw_lines AS (SELECT document_id, i AS line_no, string_split(text, chr(10))[i] AS raw
   FROM corpus, unnest(range(1, len(string_split(text, chr(10))) + 1 - (right(text, 1) = chr(10))::INT)) AS u(i)),
marked AS (SELECT *, TRY_CAST(regexp_extract_all(raw, '(?i)<!--[{S}]*PAGE:[{S}]*([0-9]+)[{S}]*-->', 1)[-1] AS INT) AS marker FROM raw_lines),
cut AS (SELECT *, CASE WHEN marker IS NULL THEN raw ELSE {sql_strip(f"regexp_replace(raw, '(?i)<!--[{S}]*PAGE:[{S}]*[0-9]+[{S}]*-->', '', 'g')")} END AS text FROM marked),
evented AS (SELECT *, CASE WHEN marker IS NOT NULL AND text = '' THEN 1 WHEN marker IS NOT NULL OR {sql_strip('text')} <> '' THEN 0 END AS event FROM cut),
paged AS (SELECT document_id, line_no, text, marker,
   last_value(marker IGNORE NULLS) OVER (PARTITION BY document_id ORDER BY line_no ROWS UNBOUNDED PRECEDING) AS page,
   (sum(length(raw) + 1) OVER (PARTITION BY document_id ORDER BY line_no))::BIGINT - length(raw) - 1 AS char_start,
   coalesce(last_value(event IGNORE NULLS) OVER (PARTITION BY document_id ORDER BY line_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS pending FROM evented),
lines AS (SELECT document_id, line_no, page, text, {sql_strip('text')} AS t, char_start, char_start + length(text) AS char_end FROM paged
   WHERE NOT (marker IS NULL AND {sql_strip('text')} = '---' AND pending = 1))
"""

_ART = rf"(?i)^(?:M[{S}]*a[{S}]*d[{S}]*d[{S}]*ə|M[{S}]*addə)[{S}]*([0-9]+(?:-[0-9]+)?)[{S}]*\.[{S}]*(.*)$"
_CHA = rf"(?i)^([IVXLCDM]+|[0-9]+)[{S}]+(?:f[{S}]*ə[{S}]*s[{S}]*i[{S}]*l|fəsil|bölmə)(?:\[([0-9]+)\])?[{S}]*(.*)$"
_ANN = rf"(?i)^(?:#+[{S}]*)?Əlavə[{S}]+([0-9]+[A-Za-z]?)[{S}]*\.?[{S}]*(.*)$"
_HEA = rf"^(#{{1,6}})[{S}]+(.+?)[{S}]*$"
_ITE = rf"(?i)^([a-zəçşıöüğ])\)[{S}]*(.*)$"
_NOT = rf"(?i)^(Qeyd)[{S}]*:[{S}]*(.*)$"
_NUM = rf"^([0-9]+(?:[-.][0-9]+){{0,5}})\.?(?:[{S}]+|$)(.*)$"


def _clean(x: str) -> str:
    return f"nullif({sql_strip(f'regexp_replace({x}, ' + chr(39) + rf'\[[0-9]+\][{S}]*$' + chr(39) + ', ' + chr(39) * 2 + ')')}, '')"


CLASSIFIED_SQL = rf"""
ruled AS (SELECT *, CASE WHEN t = '' THEN 'blank' WHEN t[1] = '|' AND t[-1] = '|' THEN 'table' WHEN regexp_matches(t, '{_ART}') THEN 'article'
   WHEN regexp_matches(t, '{_CHA}') THEN 'chapter' WHEN regexp_matches(t, '{_ANN}') THEN 'annex' WHEN regexp_matches(t, '{_HEA}') THEN 'heading'
   WHEN regexp_matches(t, '{_ITE}') THEN 'list_item' WHEN regexp_matches(t, '{_NOT}') THEN 'note'
   WHEN regexp_matches(t, '{_NUM}') AND length(t) < 1000 THEN 'numeric' ELSE 'plain' END AS r FROM lines),
classified AS (SELECT * EXCLUDE (r), CASE r WHEN 'note' THEN 'list_item' ELSE r END AS rule,
   CASE r WHEN 'article' THEN regexp_extract(t, '{_ART}', 1) WHEN 'chapter' THEN regexp_extract(t, '{_CHA}', 1) WHEN 'annex' THEN regexp_extract(t, '{_ANN}', 1)
     WHEN 'heading' THEN length(regexp_extract(t, '{_HEA}', 1))::VARCHAR WHEN 'list_item' THEN regexp_extract(t, '{_ITE}', 1)
     WHEN 'note' THEN regexp_extract(t, '{_NOT}', 1) WHEN 'numeric' THEN regexp_extract(t, '{_NUM}', 1) END AS number,
   CASE r WHEN 'article' THEN {_clean(f"regexp_extract(t, '{_ART}', 2)")} WHEN 'chapter' THEN {_clean(f"regexp_extract(t, '{_CHA}', 3)")}
     WHEN 'annex' THEN nullif({sql_strip(f"regexp_extract(t, '{_ANN}', 2)")}, '') WHEN 'heading' THEN nullif({sql_strip(f"regexp_extract(t, '{_HEA}', 2)")}, '')
     WHEN 'list_item' THEN nullif({sql_strip(f"regexp_extract(t, '{_ITE}', 2)")}, '') WHEN 'note' THEN nullif({sql_strip(f"regexp_extract(t, '{_NOT}', 2)")}, '')
     WHEN 'numeric' THEN nullif({sql_strip(f"regexp_extract(t, '{_NUM}', 2)")}, '') END AS title FROM ruled)
"""


def kinds_sql(decision: str = "false") -> str:
    return f"""
deep AS (SELECT *, {decision} AS decision, CASE WHEN rule = 'numeric' THEN len(string_split_regex(number, '[.-]')) END AS depth FROM classified),
counted AS (SELECT *, coalesce(sum((coalesce(depth, 0) = 1)::INT) OVER (PARTITION BY document_id ORDER BY line_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS lone_before FROM deep),
flagged AS (SELECT *, max((coalesce(depth, 0) = 1 AND number = '1' AND lone_before > 0)::INT) OVER (PARTITION BY document_id ORDER BY line_no ROWS UNBOUNDED PRECEDING) AS ended,
   coalesce(last_value(CASE WHEN rule = 'article' THEN line_no END IGNORE NULLS) OVER b, 0) AS article_line,
   coalesce(last_value(CASE WHEN rule IN ('chapter', 'annex') OR (rule = 'heading' AND number = '1') THEN line_no END IGNORE NULLS) OVER b, 0) AS break_line
   FROM counted WINDOW b AS (PARTITION BY document_id ORDER BY line_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
kinded AS (SELECT * EXCLUDE (rule), rule AS r0, CASE WHEN rule <> 'numeric' THEN rule WHEN decision AND ended = 0 AND depth = 1 THEN 'decision_clause'
   WHEN article_line > break_line AND depth <= 2 THEN 'clause' WHEN depth = 1 THEN 'section' WHEN depth = 2 THEN 'clause' WHEN depth = 3 THEN 'subclause' ELSE 'item' END AS kind FROM flagged),
ranked AS (SELECT *, CASE kind WHEN 'heading' THEN least(number::INT + 2, 6) WHEN 'chapter' THEN 2 WHEN 'annex' THEN 2 WHEN 'article' THEN 3 WHEN 'section' THEN 3
   WHEN 'decision_clause' THEN 4 WHEN 'clause' THEN 4 WHEN 'subclause' THEN 5 WHEN 'item' THEN 6 WHEN 'list_item' THEN 6 END AS rank FROM kinded)
"""


NODES_SQL = f"""
opened AS (SELECT *, lag(kind) OVER (PARTITION BY document_id ORDER BY line_no) AS kind_before,
   {', '.join(f"coalesce(last_value(CASE WHEN rank = {k} THEN line_no END IGNORE NULLS) OVER b, 0) AS o{k}" for k in range(2, 7))}
   FROM ranked WINDOW b AS (PARTITION BY document_id ORDER BY line_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
started AS (SELECT *, greatest(o2, o3, o4, o5, o6) AS top, kind = 'plain' AND greatest(o2, o3, o4, o5, o6) = 0 AS loose,
   rank IS NOT NULL OR (kind = 'table' AND coalesce(kind_before, '') <> 'table')
     OR (kind = 'plain' AND greatest(o2, o3, o4, o5, o6) = 0 AND coalesce(kind_before, '') <> 'plain') AS starts FROM opened),
owned AS (SELECT *, CASE WHEN kind = 'plain' AND NOT loose THEN top WHEN kind = 'blank' THEN NULL
     ELSE max(CASE WHEN starts THEN line_no END) OVER (PARTITION BY document_id ORDER BY line_no ROWS UNBOUNDED PRECEDING) END AS node_line,
   sum(starts::INT) OVER (PARTITION BY document_id ORDER BY line_no) AS nth FROM started),
heads AS (SELECT document_id, line_no AS node_line, coalesce(rank, 7) AS rank, CASE WHEN loose THEN 'p' || line_no ELSE number END AS number, title,
   CASE WHEN loose THEN CASE WHEN nth = 1 THEN 'unclassified' ELSE 'paragraph' END ELSE kind END AS kind,
   CASE WHEN loose THEN 0 ELSE greatest({', '.join(f'CASE WHEN coalesce(rank, 7) > {k} THEN o{k} ELSE 0 END' for k in range(2, 7))}) END AS parent_line
   FROM owned WHERE starts)
"""

# Ancestors by walking parents, which is another way than the open-container test.
PATHS_SQL = """
RECURSIVE_UP AS (SELECT document_id, node_line, node_line AS at, 0 AS up FROM heads
   UNION ALL SELECT c.document_id, c.node_line, h.parent_line, c.up + 1 FROM RECURSIVE_UP c JOIN heads h ON h.document_id = c.document_id AND h.node_line = c.at WHERE h.parent_line > 0),
chain AS (SELECT c.document_id, c.node_line, c.up, h.kind, h.number, h.title,
   concat_ws(' ', CASE h.kind WHEN 'article' THEN 'Maddə' WHEN 'chapter' THEN 'Fəsil' WHEN 'annex' THEN 'Əlavə' WHEN 'clause' THEN 'Bənd' WHEN 'subclause' THEN 'Yarımbənd'
      ELSE upper(h.kind[1]) || h.kind[2:] END, nullif(h.number, ''), '— ' || h.title) AS heading
   FROM RECURSIVE_UP c JOIN heads h ON h.document_id = c.document_id AND h.node_line = c.at),
labels AS (SELECT document_id, node_line, string_agg(heading, ' > ' ORDER BY up DESC) AS heading_path,
   arg_min(CASE WHEN kind = 'annex' THEN number END, CASE WHEN kind = 'annex' THEN up END) AS annex,
   arg_min(CASE WHEN kind = 'article' THEN number END, CASE WHEN kind = 'article' THEN up END) AS article,
   arg_min(CASE WHEN kind = 'section' THEN coalesce(number, title) END, CASE WHEN kind = 'section' THEN up END) AS section,
   arg_min(CASE WHEN kind = 'chapter' THEN concat_ws(' — ', number, title) END, CASE WHEN kind = 'chapter' THEN up END) AS chapter_label,
   arg_min(CASE WHEN kind = 'article' THEN concat_ws(' — ', number, title) END, CASE WHEN kind = 'article' THEN up END) AS article_label,
   arg_min(CASE WHEN kind = 'section' THEN concat_ws(' — ', number, title) END, CASE WHEN kind = 'section' THEN up END) AS section_label,
   arg_min(CASE WHEN kind = 'annex' THEN concat_ws(' — ', number, title) END, CASE WHEN kind = 'annex' THEN up END) AS annex_label,
   arg_min(CASE WHEN kind = 'clause' THEN number END, CASE WHEN kind = 'clause' THEN up END) AS clause,
   arg_min(CASE WHEN kind = 'subclause' THEN number END, CASE WHEN kind = 'subclause' THEN up END) AS subclause,
   coalesce(min(CASE WHEN kind IN ('article', 'section', 'heading', 'annex', 'table') THEN up END), max(up)) AS edge_up,
   arg_min(heading, up) AS heading FROM chain GROUP BY ALL),
located AS (SELECT l.*, h.kind, h.number, h.title, h.rank, h.parent_line, e.at AS boundary_line,
   coalesce(nullif(concat_ws(', ', 'Əlavə ' || annex, 'Maddə ' || article, 'bölmə ' || section,
      CASE WHEN coalesce(h.number, '') <> '' AND h.kind NOT IN ('article', 'section', 'annex', 'chapter') THEN CASE h.kind WHEN 'subclause' THEN 'yarımbənd ' ELSE 'bənd ' END || h.number END), ''), heading) AS locator
   FROM labels l JOIN heads h USING (document_id, node_line) JOIN RECURSIVE_UP e ON e.document_id = l.document_id AND e.node_line = l.node_line AND e.up = l.edge_up)
"""


def chain_sql(*extra: str, decision: str = "false") -> str:
    parts = [STRUCTURED_SQL, LINES_SQL, CLASSIFIED_SQL, kinds_sql(decision), NODES_SQL, *extra]
    return "WITH RECURSIVE " + ",".join(parts)


@query("txt_lines", f"WITH {STRUCTURED_SQL}, {LINES_SQL} SELECT document_id, line_no, coalesce(page, 0) AS page, char_start, char_end, md5(text) AS text_md5 FROM lines")
def txt_lines(spark, sf):
    lines = structure.document_lines(structured(spark, sf))
    return lines.select(
        "document_id", "line_no", F.coalesce("page", F.lit(0)).alias("page"), "char_start", "char_end", F.md5("text").alias("text_md5")
    )


@query("struct_classify_lines", f"WITH {STRUCTURED_SQL}, {LINES_SQL}, {CLASSIFIED_SQL} SELECT document_id, line_no, rule, number, title FROM classified")
def struct_classify_lines(spark, sf):
    out = structure.classify_lines(structure.document_lines(structured(spark, sf)))
    return out.select("document_id", "line_no", "rule", "number", "title")


TABLES_SQL = rf"""
t_lines AS (SELECT o.document_id, o.node_line, row_number() OVER (PARTITION BY o.document_id, o.node_line ORDER BY line_no) AS n,
   string_split(regexp_replace(t, '^\|+|\|+$', '', 'g'), '|') AS cells, text FROM owned o WHERE kind = 'table'),
t_nodes AS (SELECT document_id, node_line, max((n = 2 AND regexp_matches(text, '^[{S}]*\|?(?:[{S}]*:?-{{3,}}:?[{S}]*\|)+[{S}]*$'))::INT) AS ruled, count(*) AS n_lines FROM t_lines GROUP BY ALL),
t_cells AS (SELECT l.document_id, l.node_line, l.n, ruled, list_transform(cells, lambda c: {sql_strip('c')}) AS cells FROM t_lines l JOIN t_nodes USING (document_id, node_line))
"""


@query(
    "struct_tables",
    chain_sql(TABLES_SQL)
    + """ SELECT document_id, node_line, max(CASE WHEN ruled = 1 AND n = 1 THEN array_to_string(cells, '~') ELSE '' END) AS headers,
     sum((n > 2 * ruled)::INT) AS row_count, coalesce(md5(string_agg(array_to_string(cells, '~'), '|' ORDER BY n) FILTER (n > 2 * ruled)), md5('')) AS rows_md5, ruled = 0 AS uncertain,
     sum((n > 2 * ruled AND len(list_filter(cells, lambda c: regexp_matches(c, '[^ _.-]'))) > 0)::INT) AS filled_rows FROM t_cells GROUP BY document_id, node_line, ruled""",
)
def struct_tables(spark, sf):
    t = structure.table_nodes(structure.parse(structured(spark, sf)))
    return t.select(
        "document_id",
        "node_line",
        F.array_join("headers", "~").alias("headers"),
        F.size("rows").alias("row_count"),
        F.md5(F.array_join(F.transform("rows", lambda r: F.array_join(r, "~")), "|")).alias("rows_md5"),
        "uncertain",
        F.size(F.filter("rows", lambda r: F.exists(r, lambda c: c.rlike(r"[^ _.\-]")))).alias("filled_rows"),
    )


# Decisions: the same lines, with every list label turned into a depth-one number.
DECISION_CORPUS = STRUCTURED_SQL.replace("corpus AS", "corpus0 AS") + r""",
corpus AS (SELECT document_id, category, source_relative_path, regexp_replace(regexp_replace(text, '(?m)^a\) ', '1. ', 'g'), '(?m)^Maddə ([0-9]+)\. ', '\1. ', 'g') AS text FROM corpus0)"""


@query(
    "struct_decision_mode",
    "WITH RECURSIVE " + ",".join([DECISION_CORPUS, LINES_SQL, CLASSIFIED_SQL, kinds_sql("true")])
    + " SELECT document_id, line_no, kind, rank FROM ranked WHERE r0 = 'numeric'",
)
def struct_decision_mode(spark, sf):
    text = F.regexp_replace(F.regexp_replace("text", r"(?m)^a\) ", "1. "), r"(?m)^Maddə (\p{Nd}+)\. ", "$1. ")
    docs = structured(spark, sf).withColumn("text", text).withColumn("profile", F.lit("DECISION_OR_AMENDMENT"))
    classified = structure.classify_lines(structure.document_lines(docs))
    kinds = structure.assign_kinds(classified.withColumn("was", F.col("rule")))
    return kinds.filter("was = 'numeric'").select("document_id", "line_no", "kind", "rank")


@query("struct_hierarchy", chain_sql() + " SELECT document_id, node_line, kind, coalesce(number, '') AS number, rank, parent_line FROM heads")
def struct_hierarchy(spark, sf):
    return structure.parse(structured(spark, sf)).select(
        "document_id", "node_line", "kind", F.coalesce("number", F.lit("")).alias("number"), "rank", "parent_line"
    )


@query("struct_continuation", chain_sql() + " SELECT document_id, line_no, node_line FROM owned WHERE node_line IS NOT NULL")
def struct_continuation(spark, sf):
    owned = structure.assign_nodes(
        structure.assign_kinds(structure.classify_lines(structure.document_lines(structured(spark, sf))))
    )
    return owned.select("document_id", "line_no", "node_line")


@query("struct_paths", chain_sql(PATHS_SQL) + " SELECT document_id, node_line, heading_path, locator, boundary_line FROM located")
def struct_paths(spark, sf):
    return structure.parse(structured(spark, sf)).select(
        "document_id", "node_line", F.array_join("heading_path", " > ").alias("heading_path"), "locator", "boundary_line"
    )


SPANS_SQL = """
flips AS (SELECT *, (page IS DISTINCT FROM lag(page) OVER (PARTITION BY document_id, node_line ORDER BY line_no))::INT AS flip FROM owned WHERE node_line IS NOT NULL),
runs AS (SELECT *, sum(flip) OVER (PARTITION BY document_id, node_line ORDER BY line_no) AS run FROM flips),
spans AS (SELECT document_id, node_line, run, any_value(page) AS page, min(char_start) AS char_start, max(char_end) AS char_end, min(line_no) AS line_start, max(line_no) AS line_end FROM runs GROUP BY document_id, node_line, run)
"""


@query("struct_spans", chain_sql(SPANS_SQL) + " SELECT document_id, node_line, coalesce(page, 0) AS page, char_start, char_end, line_start, line_end FROM spans")
def struct_spans(spark, sf):
    nodes = structure.parse(structured(spark, sf))
    return nodes.select("document_id", "node_line", F.explode("spans").alias("s")).select(
        "document_id", "node_line", F.coalesce("s.page", F.lit(0)).alias("page"), "s.char_start", "s.char_end", "s.line_start", "s.line_end"
    )
