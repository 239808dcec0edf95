import unicodedata
import uuid

from pyspark.sql import functions as F

from corpusloom.functions import ids
from corpusloom.functions import text as tx
from corpusloom.operators import pages


def one(spark, column, **values):
    df = spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} string" for k in values))
    return df.select(column.alias("x")).first()["x"]


def test_legal_tokens(spark):
    got = one(spark, tx.tok_legal(F.col("t")), t="İCARƏÇİNİN öhdəliyi Maddə 7-1.2-də göstərilir.")
    assert got == ["icarəçinin", "öhdəliyi", "maddə", "7-1.2", "də", "göstərilir"]


def test_decomposed_text_is_composed(spark):
    assert one(spark, tx.tok_legal(F.col("t")), t=unicodedata.normalize("NFD", "étude")) == ["étude"]


def test_clean_page(spark):
    assert one(spark, tx.clean_page(F.col("t")), t="\n12\nA  \n\n\n\nB\n 7 \n") == "A\n\nB"


def test_canonical(spark):
    assert one(spark, tx.canonical(F.col("t")), t="a  \r\nb\t\rc\n\n") == "a\nb\nc"


def test_join_lines(spark):
    assert one(spark, tx.join_lines(F.col("t")), t="a\nb\n\nc\n1. d\ne\n| x |") == "a b\nc\n1. d\ne\n| x |"


def test_point_id_matches_uuid5(spark):
    want = str(uuid.uuid5(uuid.UUID(ids.POINT_NAMESPACE), "chunk_ə1"))
    assert one(spark, ids.point_id(F.col("t")), t="chunk_ə1") == want
    known = str(uuid.uuid4())
    assert one(spark, ids.point_id_v1(F.col("t")), t=known.upper()) == known


def test_titles(spark):
    assert one(spark, tx.doc_title(F.col("s"), F.col("t")), s="_Qayda.", t="x") == "Qayda"
    text = "<!-- PAGE: 1 -->\n---\n# A short heading\nThe longest early line of all\nmid"
    assert one(spark, tx.doc_title(F.col("s"), F.col("t")), s="0123456789abcdef0123", t=text) == "The longest early line of all"


def test_strip_markup(spark):
    assert one(spark, tx.strip_markup(F.col("t")), t="## **A** [1, 2]\n- `b` 5 % .") == "A b 5 faiz."


def test_repeated_page_number_keeps_the_last(spark):
    docs = spark.createDataFrame([("d", "<!-- PAGE: 1 --> a\n<!-- page: 2 -->\nb\n<!-- PAGE: 1 -->c")], "document_id string, text string")
    got = {r["page"]: r["page_text"] for r in pages.page_bounds(docs).collect()}
    assert got == {1: "c", 2: "b"}
    assert {r["page"]: r["page_text"] for r in pages.page_bounds(docs, keep="first").collect()}[1] == "a"


def test_composition_guard_covers_every_code_point(spark):
    import unicodedata

    from pyspark.sql import functions as F

    chars = [chr(c) for c in range(0x80, 0x110000) if not 0xD800 <= c < 0xE000]
    changed = [(c,) for c in chars if unicodedata.normalize("NFC", c) != c] + [("e\u0301",), ("\u1100\u1161\u11a8",), ("\u09c7\u09be",)]
    df = spark.createDataFrame(changed, "c string")
    assert df.where(~F.col("c").rlike(tx.composed_class())).count() == 0
    assert [r[0] for r in df.select(tx.nfc(F.col("c"))).collect()] == [unicodedata.normalize("NFC", c) for (c,) in changed]


def test_the_short_class_lets_nothing_pass_that_composition_changes(spark):
    """Code points and their fellows of every range that may change, and punctuation that the long class need not read."""
    chars = [chr(c) for a, b in tx._composed_ranges() for c in (a, b)]
    quiet = "plain text — ’“中Ж \U0001f600"
    rows = spark.createDataFrame([(c,) for c in chars] + [(quiet,)], "c string")
    told = dict(rows.select("c", F.col("c").rlike(tx.steady_class())).collect())
    assert all(told[c] for c in chars) and not told[quiet]


def test_titles_follow_their_sql_on_odd_lines(spark, tmp_path):
    """Quotes, the tail that a short title drops, line breaks other than a line feed, footnotes in other digits."""
    import duckdb

    from checks import q_text
    from checks.registry import ORACLES

    texts = [
        "“Bankların fəaliyyəti haqqında” qayda”", '"Qaydalar toplusu"', "Vergi məcəlləsi  AZƏRBAYCAN RESPUBLİKASININ qanunu", " Azərbaycan Respublikasının",
        "qısa birinci\x0bdaha uzun ikinci sətir\x0cüçüncü", "qısa sətir bir\rdaha uzun ikinci sətir\r\nson", "## Ümumi müddəalar [٣]", "bir sətir ikinci uzun sətir", "\n---\n", "",
        "\n".join(["x"] * 29 + ["otuzuncu uzun sətir", "otuz birinci daha uzun sətir"]), None,
    ]
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    rows.coalesce(1).write.parquet(str(tmp_path / "documents.parquet"))
    got = {r["doc_id"]: (r["title"], r["short_title"]) for r in q_text.doc_title(spark, str(tmp_path)).collect()}
    con = duckdb.connect()
    con.execute("CREATE TABLE documents (doc_id BIGINT, text VARCHAR)")
    con.executemany("INSERT INTO documents VALUES (?, ?)", [[i, t] for i, t in enumerate(texts)])
    assert got == {i: (t, s) for i, t, s in con.execute(ORACLES["doc_title"]).fetchall()}
    assert got[1][1] == "Qaydalar toplusu" and got[2][1] == "Vergi məcəlləsi" and got[5][0] == "daha uzun ikinci sətir"


def test_white_space_is_trimmed_as_the_pattern_says(spark):
    """the listed white space is that of the class, at the ends of a text and nowhere else."""
    marks = [chr(c) for c in range(1, 0x3100) if not 0xD800 <= c < 0xE000]
    texts = [m + "a" + m + "ə b" + m for m in marks] + ["", " ", "  \x85", "a\n", "\n a \n\n", None, "𝔘 "]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    by_pattern = F.regexp_replace("t", f"^[{tx.WS}]+|[{tx.WS}]+$", "")
    wrong = df.filter(~tx.strip(F.col("t")).eqNullSafe(by_pattern) | ~tx.rstrip(F.col("t")).eqNullSafe(F.regexp_replace("t", f"[{tx.WS}]+$", "")))
    assert wrong.count() == 0


def test_lines_are_cut_and_stripped_once(spark):
    """a text's lines are read in several places; each split and each trim stands in the plan once."""
    df = spark.createDataFrame([("# a\n\n b \nc\n1. d\n",)], "t string").select(tx.join_lines(F.col("t")).alias("j"))
    assert df.first()["j"] == "# a\nb c\n1. d"
    plan = df._jdf.queryExecution().analyzed().toString()
    assert plan.count("split(") == 1 and plan.count("btrim(") == 2
