"""Spans and quotes of a document read its text together; compared with one search at a time."""

import random

import pytest

from corpusloom.operators import citations, evidence, sweeps

SELECTOR = "document_id string, n int, position_start int, position_end int, exact string, prefix string, suffix string"


def slow(text, start, end, exact, prefix, suffix):
    if None in (text, exact):
        return None, None
    if start is not None and end is not None and 0 <= start <= end and text[start:end] == exact:
        return start, "position"
    if None in (prefix, suffix) or not prefix + exact + suffix:
        return None, None
    piece = prefix + exact + suffix
    hits = [i for i in range(len(text)) if text.startswith(piece, i)]
    return (hits[0] + len(prefix), "quote_fallback") if len(hits) == 1 else (None, None)


@pytest.mark.parametrize("group", [4, 20_000])
def test_quotes_against_single_searches(spark, monkeypatch, group):
    monkeypatch.setattr(sweeps, "GROUP_ROWS", group)
    draw = random.Random(group)
    texts = {"a": "".join(draw.choice("ab ") for _ in range(300)), "b": "ə𝔘ß" * 4 + "aaaa", "empty": "", "null": None}
    rows = []
    for name, text in [*texts.items(), ("missing", None)]:
        for n in range(60):
            body = text or "xyz"
            a = draw.randrange(len(body))
            b = min(len(body), a + draw.randrange(1, 9))
            shift = draw.choice([0, 0, 1, -1, 500])
            rows.append((name, n, a + shift, b + shift, body[a:b], body[max(0, a - 2) : a], body[b : b + 2]))
    rows += [("b", 900, 0, 0, "", "", ""), ("b", 901, 1, 2, "", "", ""), ("b", 902, None, 3, "ß", "𝔘", "a"), ("a", 903, 0, 1, None, "a", "b")]
    rows += rows[:5]  # repeated selectors keep their number
    sources = spark.createDataFrame([(k, v, 1) for k, v in texts.items()], "document_id string, text string, n int")
    out = citations.resolve_in_documents(spark.createDataFrame(rows, SELECTOR), sources).collect()
    got = sorted((r["document_id"], r["n"], r["resolved_start"], r["mode"], r["error"] is None) for r in out)
    want = []
    for name, n, *selector in rows:
        start, mode = slow(texts.get(name), *selector)
        want.append((name, n, start, mode, mode is not None))
    assert repr(got) == repr(sorted(want, key=lambda r: r[:2])) and len(out) == len(rows)


def test_spans_out_of_the_text_have_no_selector(spark):
    sources = spark.createDataFrame([("d", "ab𝔘def"), ("n", None)], "document_id string, text string")
    pages = spark.createDataFrame([("d", 1, 0, 4)], "document_id string, page int, page_start int, page_end int")
    spans = spark.createDataFrame(
        [("d", 0, 1, 1, 3), ("d", 1, 1, 3, 6), ("d", 2, 1, 5, 7), ("d", 3, 1, 2, 2), ("d", 4, None, 0, 1), ("n", 5, 1, 0, 1), ("d", 6, 1, None, 1)],
        "document_id string, span_no int, page int, char_start int, char_end int",
    )
    out = {r["span_no"]: r for r in evidence.selectors(spans, sources, pages, context=2).collect()}
    assert sorted(out) == [0, 1, 4]
    assert (out[0]["exact"], out[0]["prefix"], out[0]["suffix"], out[0]["page_position_start"]) == ("b𝔘", "a", "de", 1)
    assert out[1]["page_position_start"] is None and out[4]["exact"] == "a"


def test_texts_travel_once_per_group(spark):
    """200 spans of one document meet one joined row, not 200."""
    sources = spark.createDataFrame([("d", "word " * 200)], "document_id string, text string")
    rows = spark.createDataFrame([("d", i, i * 5, i * 5 + 4) for i in range(200)], "document_id string, span_no int, char_start int, char_end int")
    seen = sweeps.beside_text(rows, sources, lambda text, items: sweeps.cut_pieces(text, items["char_start"], items["char_end"], 0))
    plan = seen._jdf.queryExecution().optimizedPlan().toString()
    join = plan.index("Join LeftOuter")
    assert plan.index("collect_list", join) > join  # packed below the join with the texts
    assert {r["answer"]["exact"] for r in seen.collect()} == {"word"}


def test_rows_move_once_by_document(spark):
    """Rows with their quotes are what weighs: one exchange for them and one for the texts, whatever the groups."""
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        sources = spark.range(50).selectExpr("cast(id as string) as document_id", "repeat('word ', 20) as text")
        rows = spark.range(1000).selectExpr("cast(id % 50 as string) as document_id", "id as n", "cast(id / 50 as int) as a", "cast(id / 50 as int) + 3 as b")
        seen = sweeps.beside_text(rows, sources, lambda text, items: sweeps.cut_pieces(text, items["a"], items["b"], 0))
        assert len(seen.collect()) == 1000
        plan = seen._jdf.queryExecution().executedPlan().toString()
        assert plan.split("Initial Plan")[-1].count("Exchange hashpartitioning") == 2
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_a_worker_holds_a_bounded_batch(spark):
    """batches of texts with their spans are cut by size; 10,000 rows of them were hundreds of MB in a worker."""
    import pyarrow as pa
    from pyspark.sql import functions as F

    from corpusloom.session import prepare

    @F.arrow_udf("array<long>")
    def held(texts: pa.Array, items: pa.Array) -> pa.Array:
        return pa.array([[texts.nbytes + items.nbytes] * n for n in items.value_lengths().to_pylist()])

    sources = spark.range(60).selectExpr("cast(id as string) as document_id", "repeat('word ', 200000) as text").coalesce(1)
    rows = spark.range(120).selectExpr("cast(id % 60 as string) as document_id", "cast(id as int) as n")
    seen = sweeps.beside_text(rows, sources, lambda text, items: held(text, items["n"]))
    prepare(spark)
    assert seen.count() == 120
    assert seen.selectExpr("max(answer)").first()[0] < 24 << 20


def test_quotes_do_not_move_between_cutting_and_finding(spark):
    """words with their quotes are many times the text; only texts move by document, once for each side."""
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        d = spark.range(40).selectExpr("cast(id as string) as document_id", "repeat('word ', 20) as text").repartition("document_id")
        spans = d.selectExpr("document_id", "explode(sequence(0, 19)) as n").selectExpr("document_id", "n", "0 as page", "n * 5 as char_start", "n * 5 + 4 as char_end")
        pages = spans.selectExpr("document_id", "page", "0 as page_start", "0 as page_end").limit(0)
        found = citations.resolve_in_documents(evidence.selectors(spans, d, pages, context=3).select(*SELECTOR.replace(" string", "").replace(" int", "").split(", ")), d)
        assert found.filter("mode = 'position'").count() == 800
        found.collect()
        plan = found._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[-1]
        assert plan.count("Exchange hashpartitioning") == plan.count("REPARTITION_BY_COL") == 3  # those of d alone
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
