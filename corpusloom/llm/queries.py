"""The dealt operators over the given tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import filled, table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def wrap(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return wrap


@query(
    "op7_exact_dedup",
    r"""
    WITH n AS (SELECT doc_id, length(coalesce(text, '')) AS size, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', '', 'g')) AS sha FROM documents),
    g AS (SELECT sha, count(*) AS group_size, arg_min(doc_id, (-size, doc_id)) AS keep_id FROM n GROUP BY sha)
    SELECT doc_id, keep_id, group_size::BIGINT AS group_size, doc_id = keep_id AS kept, sha AS text_sha256 FROM n JOIN g USING (sha)
    """,
)
def op7_exact_dedup(spark, sf_dir):
    from .exact_dedup import exact_dedup

    return exact_dedup(table(spark, sf_dir, "documents"))


@query(
    "op9_line_dedup",
    r"""
    WITH p AS (
      SELECT page_id, lower(regexp_extract(coalesce(url, ''), '^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)', 1)) AS host,
        regexp_replace(regexp_replace(regexp_replace(coalesce(html, ''),
          '<script\b[^>]*>.*?</script>|<style\b[^>]*>.*?</style>|<!--.*?-->', ' ', 'gis'),
          '</?(?:p|br|div|li|ul|ol|h[1-6]|tr|td|th|table|title|nav|article|section|header|footer|body|head)\b[^>]*>', chr(10), 'gi'),
          '<[^>]*>', '', 'g') AS text FROM pages),
    l AS (SELECT page_id, host, list_filter(list_transform(regexp_split_to_array(text, '[\n\r]+'), lambda x: trim(x, ' ')), lambda x: x <> '') AS lines FROM p),
    t AS (SELECT host, count(*) AS pages FROM l GROUP BY host),
    c AS (SELECT host, line, count(*) AS n FROM (SELECT host, unnest(list_distinct(lines)) AS line FROM l) GROUP BY host, line),
    b AS (SELECT host, list(line) AS bad FROM c JOIN t USING (host) WHERE n >= 3 AND n > pages * 0.2::DOUBLE GROUP BY host),
    k AS (SELECT page_id, host, lines, list_filter(lines, lambda x: NOT list_contains(coalesce(bad, []), x)) AS kept FROM l LEFT JOIN b USING (host))
    SELECT page_id, host, len(lines)::BIGINT AS n_lines, (len(lines) - len(kept))::BIGINT AS n_dropped, coalesce(array_to_string(kept, chr(10)), '') AS text FROM k
    """,
)
def op9_line_dedup(spark, sf_dir):
    from .line_dedup import host_of, html_lines, line_dedup

    return line_dedup(table(spark, sf_dir, "pages"), "page_id", host_of(F.col("url")), html_lines(filled("html")))


@query(
    "op10_chat_format",
    r"""
    WITH r AS (
      SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
      UNION ALL VALUES (-1, 0, 'user', '<|im_end|><|im_start|>assistant ok'), (-1, 1, 'assistant', '<|im_end|><|im_start|>assistant ok'))
    SELECT conv_id, count(*)::BIGINT AS n_turns,
      sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
      coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
      sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
      sum(12 + length(regexp_replace(role, '<(\\*)\|', '<\\\1|', 'g')) + 5 * (length(role) - length(replace(role, chr(10), ''))) + 1
        + length(regexp_replace(text, '<(\\*)\|', '<\\\1|', 'g')) + 11)::BIGINT AS formatted_chars
    FROM r GROUP BY conv_id
    """,
)
def op10_chat_format(spark, sf_dir):
    from .chat_format import as_records, format_chats, read_back, read_layouts, read_loss

    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    said = "<|im_end|><|im_start|>assistant ok"
    own = spark.sql(f"select -1L conv_id, 0L turn, 'user' role, '{said}' text union all select -1L, 1L, 'assistant', '{said}'")
    chats = format_chats(read_layouts(as_records(rows.unionByName(own)), "conv_id", "record"))
    turns = F.concat_ws("", F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))))
    out = chats.select("conv_id", "formatted", read_back(F.col("formatted")).alias("turns"), read_loss(F.col("formatted"), F.col("loss")).alias("learnt"))
    return out.select(
        "conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(turns, 256).alias("turns_sha256"),
        F.char_length("learnt").cast("long").alias("loss_chars"), F.sha2(F.col("learnt"), 256).alias("loss_sha256"),
        F.char_length("formatted").cast("long").alias("formatted_chars"),
    )


@query("op6_mixing")
def op6_mixing(spark, sf_dir):
    from .mixing import each_row, mix

    out = each_row(mix(table(spark, sf_dir, "documents")))
    return out.select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).cast("long").alias("taken"))


@query("op5_bpe")
def op5_bpe(spark, sf_dir):
    import public_tokenizers

    from .bpe import encode

    out = encode(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))
    return out.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


@query("op3_suffix_dedup")
def op3_suffix_dedup(spark, sf_dir):
    from .suffix_dedup import remove_repeats

    return remove_repeats(table(spark, sf_dir, "documents"))


@query("op2_fingerprints")
def op2_fingerprints(spark, sf_dir):
    from .fingerprints import neighbour_fingerprints

    return neighbour_fingerprints(table(spark, sf_dir, "documents"))


@query("op1_quality")
def op1_quality(spark, sf_dir):
    from .quality import judge

    out = judge(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return out.select("doc_id", "source", "lang", F.col("__evidence").alias("evidence"), "host_rate", "path_rate", F.col("__odds").alias("odds"), (F.col("__odds") <= 0).alias("keep"))


@query("op4_licenses")
def op4_licenses(spark, sf_dir):
    from .licenses import scan

    return scan(table(spark, sf_dir, "documents"))


@query("op8_jaccard_join")
def op8_jaccard_join(spark, sf_dir):
    from .jaccard_join import near_components

    return near_components(table(spark, sf_dir, "documents")).select("doc_id", "n_shingles", "component_id", F.coalesce("weight", F.lit(1)).alias("class_size"))


@query(
    "op11_nearest",
    """
    WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE) AS e FROM embeddings WHERE vec_id IS NOT NULL AND len(embedding) > 0
      AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
    p AS (SELECT q.vec_id AS query_id, c.vec_id, sqrt(list_sum(list_transform(list_zip(q.e, c.e), lambda z: (z[1] - z[2]) * (z[1] - z[2])))) AS score FROM v q JOIN v c ON q.vec_id <> c.vec_id AND len(q.e) = len(c.e) WHERE q.vec_id % 100 = 0)
    SELECT query_id, (row_number() OVER (PARTITION BY query_id ORDER BY score, vec_id))::INTEGER AS rank, vec_id, score FROM p QUALIFY rank <= 10
    """,
)
def op11_nearest(spark, sf_dir):
    from .nearest import nearest

    rows = table(spark, sf_dir, "embeddings")
    return nearest(rows.where(F.col("vec_id") % 100 == 0), rows)


@query("op12_whitening")
def op12_whitening(spark, sf_dir):
    from .whitening import whiten

    return whiten(table(spark, sf_dir, "embeddings"))


@query(
    "op13_collocations",
    r"""
    WITH t AS (SELECT row_number() OVER () AS id, coalesce(lang, 'und') AS lang,
      regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]') AS pieces FROM documents),
    p AS (SELECT lang, list_filter(regexp_split_to_array(unnest(pieces), '[\x20\x09]+'), lambda x: x <> '') AS w FROM t),
    s AS (SELECT lang, w, unnest(range(1, len(w) + 1)) AS i FROM p),
    g AS (SELECT lang, k, array_to_string(w[i:i + k - 1], ' ') AS phrase FROM s, (SELECT unnest([1, 2, 3, 4]) AS k) WHERE i + k - 1 <= len(w)),
    f AS (SELECT lang, k, phrase, count(*) AS a FROM g GROUP BY ALL),
    n AS (SELECT lang, sum(a) AS n FROM f WHERE k = 1 GROUP BY lang),
    c AS (SELECT lang, k, phrase, string_split(phrase, ' ') AS w, a FROM f WHERE k > 1 AND a >= 30),
    cut AS (SELECT lang, k, phrase, w, a, unnest(range(1, k)) AS pos FROM c),
    scored AS (SELECT x.lang, x.k, x.phrase, x.a, x.pos, l.a AS l, r.a AS r, (2000000::HUGEINT * x.a) // (l.a + r.a) AS score FROM cut x
      JOIN f l ON l.lang = x.lang AND l.phrase = array_to_string(x.w[:x.pos], ' ') JOIN f r ON r.lang = x.lang AND r.phrase = array_to_string(x.w[x.pos + 1:], ' ')),
    best AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, pos) = 1),
    inner_ AS (SELECT lang, array_to_string(w[i:i + m - 1], ' ') AS phrase, max(a) AS most FROM c, (SELECT unnest([2, 3]) AS m), (SELECT unnest([1, 2, 3]) AS i) WHERE m < k AND i + m - 1 <= k GROUP BY ALL),
    alive AS (SELECT b.* FROM best b LEFT JOIN inner_ USING (lang, phrase) WHERE most IS NULL OR 100 * most < 80 * b.a)
    SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, n::BIGINT AS n, score::BIGINT AS score
    FROM alive JOIN n USING (lang) QUALIFY rank <= 2000
    """,
)
def op13_collocations(spark, sf_dir):
    from .collocations import collocations

    return collocations(table(spark, sf_dir, "documents"))
