"""Text projections and identifiers."""

from __future__ import annotations

from pyspark.sql import functions as F

from corpusloom.functions import ids
from corpusloom.functions import text as tx
from corpusloom.operators import pages

from .bindings import STRUCTURED_SQL, WS, documents, exchanges, sql_count, sql_fold, sql_strip, sql_tok_legal, structured
from .bindings import EXCHANGES_SQL
from .registry import query, table


def _canonical_sql(x: str) -> str:
    unix = rf"regexp_replace({x}, '\r\n?', chr(10), 'g')"
    trimmed = rf"regexp_replace(nfc_normalize({unix}), '(?m)[\t\x0B-\r\x1C-\x20\x{{85}}\p{{Z}}]+$', '', 'g')"
    return sql_strip(trimmed)


@query("txt_canonical", f"SELECT doc_id, sha256({_canonical_sql('text')}) AS content_hash, length({_canonical_sql('text')}) AS n FROM documents")
def txt_canonical(spark, sf):
    canon = tx.canonical(F.col("text"))
    return documents(spark, sf).select("doc_id", ids.sha256(canon).alias("content_hash"), F.length(canon).alias("n"))


RAW_PAGE_SQL = "replace(text, chr(10), '  ' || chr(10) || (doc_id % 500) || chr(10) || chr(10) || chr(10) || chr(10))"


@query(
    "txt_clean_page",
    rf"""WITH raw AS (SELECT doc_id, {RAW_PAGE_SQL} AS t FROM documents),
    kept AS (SELECT doc_id, list_transform(list_filter(string_split(t, chr(10)), lambda x: NOT regexp_matches(x, '^[{WS}]*[0-9]{{1,4}}[{WS}]*$')),
                lambda x: regexp_replace(x, '[{WS}]+$', '')) AS l FROM raw)
    SELECT doc_id, md5({sql_strip("regexp_replace(array_to_string(l, chr(10)), '\\n{3,}', chr(10) || chr(10), 'g')")}) AS page_md5 FROM kept""",
)
def txt_clean_page(spark, sf):
    raw = F.replace(
        F.col("text"), F.lit("\n"), F.concat(F.lit("  \n"), (F.col("doc_id") % 500).cast("string"), F.lit("\n\n\n\n"))
    )
    return documents(spark, sf).select("doc_id", F.md5(tx.clean_page(raw)).alias("page_md5"))


@query(
    "txt_join_pages",
    rf"""WITH cleaned AS (SELECT conv_id, turn, {sql_strip(f"regexp_replace(array_to_string(list_transform(list_filter(string_split(text, chr(10)), lambda x: NOT regexp_matches(x, '^[{WS}]*[0-9]{{1,4}}[{WS}]*$')), lambda x: regexp_replace(x, '[{WS}]+$', '')), chr(10)), '\\n{{3,}}', chr(10) || chr(10), 'g')")} AS body FROM conversations)
    SELECT conv_id AS document_id, md5(string_agg('<!-- PAGE: ' || (turn + 1) || ' -->' || chr(10) || chr(10) || body,
        chr(10) || chr(10) || '---' || chr(10) || chr(10) ORDER BY turn)) AS text_md5, count(*) AS pages
    FROM cleaned WHERE body <> '' GROUP BY conv_id""",
)
def txt_join_pages(spark, sf):
    raw = table(spark, sf, "conversations").select(
        F.col("conv_id").alias("document_id"), (F.col("turn") + 1).alias("page"), "text"
    )
    out = pages.join_pages(raw)
    return out.select("document_id", F.md5("text").alias("text_md5"), "pages")


PAGE_BOUNDS_SQL = f"""
pieces AS (
  SELECT document_id, i,
         string_split_regex(text, '(?i)<!--[{WS}]*PAGE:[{WS}]*[0-9]+[{WS}]*-->')[i] AS piece,
         regexp_extract_all(text, '(?i)<!--[{WS}]*PAGE:[{WS}]*([0-9]+)[{WS}]*-->', 0)[i - 1] AS marker,
         regexp_extract_all(text, '(?i)<!--[{WS}]*PAGE:[{WS}]*([0-9]+)[{WS}]*-->', 1)[i - 1]::INT AS page
  FROM corpus, unnest(range(1, len(string_split_regex(text, '(?i)<!--[{WS}]*PAGE:[{WS}]*[0-9]+[{WS}]*-->')) + 1)) AS u(i)),
placed AS (
  SELECT document_id, i, page, piece,
         (sum(length(piece) + coalesce(length(marker), 0)) OVER (PARTITION BY document_id ORDER BY i))::BIGINT - length(piece) AS raw_start
  FROM pieces),
bounds AS (
  SELECT document_id, i, page, {sql_strip('piece')} AS page_text,
         raw_start + length(piece) - length(regexp_replace(piece, '^[{WS}]+', '')) AS page_start,
         raw_start + length(regexp_replace(piece, '[{WS}]+$', '')) AS raw_end
  FROM placed WHERE page IS NOT NULL)
"""


@query(
    "txt_pages",
    f"""WITH {STRUCTURED_SQL}, {PAGE_BOUNDS_SQL}
    SELECT document_id, page, page_start::BIGINT AS page_start, greatest(page_start, raw_end)::BIGINT AS page_end, md5(page_text) AS page_md5
    FROM bounds QUALIFY row_number() OVER (PARTITION BY document_id, page ORDER BY i DESC) = 1""",
)
def txt_pages(spark, sf):
    bounds = pages.page_bounds(structured(spark, sf))
    return bounds.select("document_id", "page", "page_start", "page_end", F.md5("page_text").alias("page_md5"))


@query("tok_ws", f"SELECT doc_id, array_to_string(list_filter(string_split_regex(lower(text), '[{WS}]+'), lambda x: x <> ''), '~') AS tokens FROM documents")
def tok_ws(spark, sf):
    return documents(spark, sf).select("doc_id", F.array_join(tx.tok_ws(F.col("text")), "~").alias("tokens"))


@query("tok_legal", f"SELECT doc_id, array_to_string({sql_tok_legal('text')}, '~') AS tokens FROM documents")
def tok_legal(spark, sf):
    return documents(spark, sf).select("doc_id", F.array_join(tx.tok_legal(F.col("text")), "~").alias("tokens"))


@query("tok_count", f"SELECT doc_id, {sql_count('text')} AS tokens FROM documents")
def tok_count(spark, sf):
    return documents(spark, sf).select("doc_id", tx.tok_count(F.col("text")).alias("tokens"))


@query(
    "txt_sentences",
    rf"""WITH cut AS (SELECT doc_id, text, list_filter(list_transform(string_split(
        regexp_replace(regexp_replace(text, '([.!?…;:])[{WS}]+([A-ZƏÖÜİŞÇĞ0-9])', '\1' || chr(1) || '\2', 'g'),
                       '([.!?…;:])[{WS}]+([A-ZƏÖÜİŞÇĞ0-9])', '\1' || chr(1) || '\2', 'g'), chr(1)),
        lambda x: {sql_strip('x')}), lambda x: x <> '') AS s FROM documents)
    SELECT doc_id, len(s) AS pieces, md5(array_to_string(s, '~')) AS pieces_md5,
           greatest(1, len(regexp_extract_all(text, '[.!?…]+(?:[{WS}]|$)'))) AS sentence_count FROM cut""",
)
def txt_sentences(spark, sf):
    cut = tx.sentences(F.col("text"))
    return documents(spark, sf).select(
        "doc_id",
        F.size(cut).alias("pieces"),
        F.md5(F.array_join(cut, "~")).alias("pieces_md5"),
        tx.sentence_count(F.col("text")).alias("sentence_count"),
    )


@query(
    "txt_join_lines",
    rf"""WITH {STRUCTURED_SQL}, lines AS (SELECT document_id, i, {sql_strip('string_split(text, chr(10))[i]')} AS t
         FROM corpus, unnest(range(1, len(string_split(text, chr(10))) + 1)) AS u(i)),
    flagged AS (SELECT *, regexp_matches(t, '^(?:[#|>]|- |\* )') OR regexp_matches(t, '(?i)^(?:[0-9]+(?:[.-][0-9]+)*\.?|[a-zəçşıöüğ]\))[{WS}]+') AS s,
         coalesce(lag(t) OVER (PARTITION BY document_id ORDER BY i) = '', false) AS gap FROM lines),
    joined AS (SELECT document_id, i, CASE WHEN lag(s) OVER w IS NULL THEN '' WHEN s OR gap OR lag(s) OVER w THEN chr(10) ELSE ' ' END || t AS piece
         FROM flagged WHERE t <> '' WINDOW w AS (PARTITION BY document_id ORDER BY i))
    SELECT document_id, md5(string_agg(piece, '' ORDER BY i)) AS joined_md5 FROM joined GROUP BY document_id""",
)
def txt_join_lines(spark, sf):
    return structured(spark, sf).select("document_id", F.md5(tx.join_lines(F.col("text"))).alias("joined_md5"))


@query(
    "id_prefixed",
    f"""SELECT doc_id, 'doc_' || substr(sha256({sql_strip('source')} || chr(31) || {sql_strip('lang')} || chr(31) || {sql_strip('nfc_normalize(text)')}), 1, 24) AS document_id,
        'unit_' || substr(sha256('d' || doc_id || chr(31) || 'clause' || chr(31) || {sql_strip('nfc_normalize(text)')}), 1, 24) AS unit_id FROM documents""",
)
def id_prefixed(spark, sf):
    body = F.col("text")
    return documents(spark, sf).select(
        "doc_id",
        ids.prefixed("doc", F.col("source"), F.col("lang"), body, compose=True).alias("document_id"),
        ids.prefixed("unit", F.concat(F.lit("d"), F.col("doc_id")), F.lit("clause"), body, compose=True).alias("unit_id"),
    )


@query(
    "id_words",
    rf"SELECT doc_id, array_to_string(regexp_extract_all({sql_fold('nfc_normalize(text)')}, '[\p{{L}}\p{{N}}_]+'), ' ') AS words FROM documents",
)
def id_words(spark, sf):
    return documents(spark, sf).select("doc_id", tx.identity_words(F.col("text")).alias("words"))


_NAME_HASH = "sha1(decode('{ns}'::BLOB) || text)"


@query(
    "id_point",
    """WITH named AS (SELECT doc_id, 'chunk_' || substr(md5(text), 1, 24) AS chunk_id FROM documents),
    h AS (SELECT doc_id, chunk_id, sha1(unhex('266db0a386b44d21a61edbb1d37dc7f5') || chunk_id::BLOB) AS h FROM named)
    SELECT doc_id, chunk_id, substr(h,1,8)||'-'||substr(h,9,4)||'-5'||substr(h,14,3)||'-'||
       substr('89ab', (('0x'||substr(h,17,1))::INT % 4) + 1, 1)||substr(h,18,3)||'-'||substr(h,21,12) AS point_id FROM h""",
)
def id_point(spark, sf):
    named = documents(spark, sf).select("doc_id", F.concat(F.lit("chunk_"), F.substring(F.md5("text"), 1, 24)).alias("chunk_id"))
    return named.withColumn("point_id", ids.point_id(F.col("chunk_id")))


_LINES = r"string_split_regex(regexp_replace(text, '\r\n?', chr(10), 'g'), '[\n\x0B\x0C\x1C-\x1E\x{85}\x{2028}\x{2029}]')"
_UNQUOTED = """regexp_replace(title, '^[“"]|[”"]$', '', 'g')"""
_HEAD = "list_filter(" + _LINES + "[1:30], lambda x: {s} <> '' AND NOT contains(x, '<!-- PAGE:') AND {s} <> '---')".format(s=sql_strip("x"))
_CAND = rf"list_transform({_HEAD}, lambda x: {sql_strip(rf'''regexp_replace(x, '^#+[{WS}]*|[[]\p{{Nd}}+[]][{WS}]*$', '', 'g')''')})"


@query(
    "doc_title",
    rf"""WITH lines AS (SELECT doc_id, {_CAND} AS c, md5(text) AS stem FROM documents),
    pick AS (SELECT doc_id, stem, CASE WHEN len(list_filter(c, lambda x: length(x) BETWEEN 12 AND 240)) > 0
        THEN list_filter(c, lambda x: length(x) BETWEEN 12 AND 240) ELSE c END AS c FROM lines),
    best AS (SELECT doc_id, coalesce(c[list_position(list_transform(c, lambda x: length(x)), list_max(list_transform(c, lambda x: length(x))))], stem) AS title FROM pick),
    bare AS (SELECT doc_id, title, {sql_strip(_UNQUOTED)} AS b FROM best),
    cut AS (SELECT doc_id, title, regexp_replace(b, '(?i)[{WS}]+Azərbaycan Respubl[iıİ]kas[iıİ]n[iıİ]n.*$', '') AS c FROM bare)
    SELECT doc_id, title, substr(CASE WHEN c = '' THEN title ELSE c END, 1, 160) AS short_title FROM cut""",
)
def doc_title(spark, sf):
    titled = documents(spark, sf).select("doc_id", tx.doc_title(F.md5("text"), F.col("text")).alias("title"))
    return titled.withColumn("short_title", tx.short_title(F.col("title")))


@query(
    "doc_act_number",
    rf"""WITH t AS (SELECT doc_id, 'Qərar № ' || doc_id || '/' || lang || chr(10) || text AS text FROM documents)
    SELECT doc_id, nullif(regexp_extract(substr(text, 1, 5000), '(?im)^[{WS}]*(?:№|Qərar[{WS}]*№)[{WS}]*([\p{{L}}\p{{N}}_/-]+)[{WS}]*$', 1), '') AS act_number FROM t""",
)
def doc_act_number(spark, sf):
    text = F.concat(F.lit("Qərar № "), F.col("doc_id"), F.lit("/"), F.col("lang"), F.lit("\n"), F.col("text"))
    return documents(spark, sf).select("doc_id", tx.act_number(text).alias("act_number"))


PROFILE_SQL = rf"""
sampled AS (SELECT document_id, category, text, {sql_fold("category || chr(10) || substr(text, 1, 20000)")} AS s FROM corpus),
scored AS (SELECT document_id, category,
   CASE WHEN category = 'laws' OR regexp_matches(s, '(?m)^[{WS}]*m[{WS}]*a[{WS}]*d[{WS}]*d[{WS}]*ə[{WS}]+[0-9]+') THEN 4 ELSE 0 END AS p1,
   CASE WHEN regexp_matches(s, '(?m)^[{WS}]*[0-9]+(?:[-.][0-9]+)+\.?(?:[{WS}]|$)') THEN 3 ELSE 0 END AS p2,
   CASE WHEN regexp_matches(text, '(?m)^#{{1,6}}[{WS}]+') OR regexp_matches(s, 'metodoloji|rəhbərlik|təlimat') THEN 2 ELSE 0 END AS p3,
   CASE WHEN regexp_matches(text, '(?m)^[{WS}]*\|.+\|[{WS}]*$') OR regexp_matches(s, 'forma|sorğu|hesabat cədvəli') THEN 3 ELSE 0 END AS p4,
   CASE WHEN regexp_matches(s, 'qərara alır|təsdiq edilməsi barədə|dəyişiklik') THEN 3 ELSE 0 END AS p5 FROM sampled),
profiled AS (SELECT document_id, category,
   CASE greatest(p1,p2,p3,p4,p5) WHEN 0 THEN 'GUIDANCE' WHEN p1 THEN 'LEGAL_ACT' WHEN p2 THEN 'REGULATION' WHEN p3 THEN 'GUIDANCE'
        WHEN p4 THEN 'TABLE_OR_FORM' ELSE 'DECISION_OR_AMENDMENT' END AS profile,
   CASE WHEN p1+p2+p3+p4+p5 = 0 THEN 'GUIDANCE' ELSE concat_ws(',', CASE WHEN p1>0 THEN 'LEGAL_ACT' END, CASE WHEN p2>0 THEN 'REGULATION' END,
        CASE WHEN p3>0 THEN 'GUIDANCE' END, CASE WHEN p4>0 THEN 'TABLE_OR_FORM' END, CASE WHEN p5>0 THEN 'DECISION_OR_AMENDMENT' END) END AS profiles FROM scored)
"""


def profiled(spark, sf):
    scores = tx.profile_scores(F.col("text"), F.col("category"), F.col("category"))
    return structured(spark, sf).select(
        "document_id",
        "category",
        tx.primary_profile(scores).alias("profile"),
        F.array_join(tx.detected_profiles(scores), ",").alias("profiles"),
    )


@query("doc_profile", f"WITH {STRUCTURED_SQL}, {PROFILE_SQL} SELECT document_id, profile, profiles FROM profiled")
def doc_profile(spark, sf):
    return profiled(spark, sf).select("document_id", "profile", "profiles")


@query(
    "doc_type",
    f"""WITH {STRUCTURED_SQL}, {PROFILE_SQL} SELECT document_id, CASE profile WHEN 'LEGAL_ACT' THEN 'law' WHEN 'DECISION_OR_AMENDMENT' THEN 'decision_or_amendment'
        WHEN 'TABLE_OR_FORM' THEN 'table_or_form' WHEN 'REGULATION' THEN 'regulation' ELSE 'guidance' END AS document_type FROM profiled""",
)
def doc_type(spark, sf):
    return profiled(spark, sf).select(
        "document_id", tx.document_type(F.col("profile"), F.col("category")).alias("document_type")
    )


@query(
    "txt_safe_json",
    """SELECT item_id, replace(replace(replace(to_json({'id': item_id, 'question': text || ' <&>'})::VARCHAR, '<', '\\u003c'), '>', '\\u003e'), '&', '\\u0026') AS body FROM benchmark""",
)
def txt_safe_json(spark, sf):
    row = F.struct(F.col("item_id").alias("id"), F.concat("text", F.lit(" <&>")).alias("question"))
    return table(spark, sf, "benchmark").select("item_id", tx.safe_json(row).alias("body"))


def _speech_sql(x: str) -> str:
    out = f"nfc_normalize({x})"
    for pattern, repl in tx.SPEECH_STEPS:
        if "(?<!" in pattern:
            word = "AMB" if "AMB" in pattern else "AZN"
            # RE2 has no look-around; the bound text has no such word.
            out = f"regexp_replace({out}, '(?i)\\b{word}\\b', '{repl}', 'g')"
            continue
        out = f"regexp_replace({out}, '{pattern}', '{repl.replace('$1', chr(92) + '1')}', 'g')"
    return sql_strip(out)


@query(
    "txt_strip_markup",
    f"""WITH marked AS (SELECT conv_id, turn, '## **' || role || '** [1, 2]' || chr(10) || '- `' || text || '` [3] 5 % № [a](b) .' AS md FROM conversations)
    SELECT conv_id, turn, {_speech_sql('md')} AS plain FROM marked""",
)
def txt_strip_markup(spark, sf):
    md = F.concat(F.lit("## **"), F.col("role"), F.lit("** [1, 2]\n- `"), F.col("text"), F.lit("` [3] 5 % № [a](b) ."))
    return table(spark, sf, "conversations").select("conv_id", "turn", tx.strip_markup(md).alias("plain"))


# Markers that a question in the given language is expected to hold.
LANGUAGE_MARKERS = (("en", "the | and | of ", "[w]"), ("de", "der | die | und ", "[äöüß]"), ("fr", "le | la | des ", "[éèêç]"), ("es", "de | la | que ", "[ñíóú]"))


@query(
    "lang_marker_check",
    f"""WITH markers(lang, words, letters) AS (VALUES {', '.join(str(m) for m in LANGUAGE_MARKERS)})
    SELECT doc_id, (right(regexp_replace(text, '[{WS}]+$', ''), 1) IN ('?', '.') AND (regexp_matches(' ' || {sql_fold('text')}, words) OR regexp_matches({sql_fold('text')}, letters))) AS looks_right
    FROM documents JOIN markers USING (lang)""",
)
def lang_marker_check(spark, sf):
    markers = spark.createDataFrame(list(LANGUAGE_MARKERS), "lang string, words string, letters string")
    return pages.language_check(documents(spark, sf), markers).select("doc_id", "looks_right")
