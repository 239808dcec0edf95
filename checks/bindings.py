"""How the driver's tables stand in for the corpus, in Spark and in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.session import spread

from .registry import table

WS = r"\t-\r\x1C-\x20\x{85}\p{Z}"


def sql_strip(x: str) -> str:
    return f"regexp_replace({x}, '^[{WS}]+|[{WS}]+$', '', 'g')"


def sql_fold(x: str) -> str:
    return (
        f"replace(replace(replace(replace(replace(lower({x}),'ß','ss'),'ς','σ'),'ſ','s'),'ﬁ','fi'),'ﬂ','fl')"
    )


def sql_tok_legal(x: str) -> str:
    return (
        f"regexp_extract_all(replace({sql_fold(f'nfc_normalize({x})')}, 'i' || chr(775), 'i'), "
        r"'\p{Nd}+(?:[-.]\p{Nd}+)*|[\p{L}\p{Nl}\p{No}]+(?:[''’][\p{L}\p{Nl}\p{No}]+)*')"
    )


def sql_tok_answer(x: str) -> str:
    return (
        f"regexp_extract_all({sql_fold(f'nfc_normalize({x})')}, "
        r"'\p{Nd}+(?:[.,]\p{Nd}+)*|[\p{L}\p{N}]+')"
    )


def sql_count(x: str) -> str:
    return (
        f"len(regexp_extract_all({x}, "
        r"'[\p{L}\p{N}_]+|[^\p{L}\p{N}_\t-\r\x1C-\x20\x{85}\p{Z}]'))"
    )


# A document with page markers and legal numbering, made from a plain one by
# giving every line the prefix its position asks for.
STRUCTURED_SQL = """
corpus AS (
  SELECT 'd' || lpad(doc_id::VARCHAR, 8, '0') AS document_id, source AS category,
         source || '/' || lpad(doc_id::VARCHAR, 8, '0') || '.md' AS source_relative_path,
         array_to_string(list_transform(string_split(text, chr(10)), lambda x, i:
           CASE i % 12
             WHEN 1 THEN '<!-- PAGE: ' || ((i - 1) // 12 + 1) || ' -->' || chr(10) || '---' || chr(10) || x
             WHEN 2 THEN 'Maddə ' || ((i - 1) // 12 + 1) || '. ' || x
             WHEN 3 THEN ((i - 1) // 12 + 1) || '.1. ' || x
             WHEN 4 THEN ((i - 1) // 12 + 1) || '.1.1. ' || x
             WHEN 5 THEN 'a) ' || x
             WHEN 7 THEN '| ad | dəyər |' || chr(10) || '| --- | --- |' || chr(10) || '| '
                         || replace(x, '|', '/') || ' | ' || ((i - 1) // 12 + 1) || ' |'
             WHEN 8 THEN ((i - 1) // 12 + 1) || ' fəsil ' || x
             WHEN 9 THEN 'Əlavə ' || ((i - 1) // 12 + 1) || '. ' || x
             WHEN 10 THEN x || ' Maddə ' || ((i - 1) // 12)
             WHEN 11 THEN 'Qeyd: ' || x
             WHEN 0 THEN '## ' || x
             ELSE x END), chr(10)) AS text
  FROM documents)
"""


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spread(table(spark, sf_dir, "documents"))


def structured(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``document_id, category, source_relative_path, text`` with legal structure."""
    key = F.lpad(F.col("doc_id").cast("string"), 8, "0")

    def shape(x, i):
        n = i + 1
        block = (F.floor(i / 12) + 1).cast("string")
        slot = n % 12
        return (
            F.when(slot == 1, F.concat(F.lit("<!-- PAGE: "), block, F.lit(" -->\n---\n"), x))
            .when(slot == 2, F.concat(F.lit("Maddə "), block, F.lit(". "), x))
            .when(slot == 3, F.concat(block, F.lit(".1. "), x))
            .when(slot == 4, F.concat(block, F.lit(".1.1. "), x))
            .when(slot == 5, F.concat(F.lit("a) "), x))
            .when(
                slot == 7,
                F.concat(
                    F.lit("| ad | dəyər |\n| --- | --- |\n| "),
                    F.replace(x, F.lit("|"), F.lit("/")),
                    F.lit(" | "),
                    block,
                    F.lit(" |"),
                ),
            )
            .when(slot == 8, F.concat(block, F.lit(" fəsil "), x))
            .when(slot == 9, F.concat(F.lit("Əlavə "), block, F.lit(". "), x))
            .when(slot == 10, F.concat(x, F.lit(" Maddə "), F.floor(i / 12).cast("string")))
            .when(slot == 11, F.concat(F.lit("Qeyd: "), x))
            .when(slot == 0, F.concat(F.lit("## "), x))
            .otherwise(x)
        )

    return documents(spark, sf_dir).select(
        F.concat(F.lit("d"), key).alias("document_id"),
        F.col("source").alias("category"),
        F.concat("source", F.lit("/"), key, F.lit(".md")).alias("source_relative_path"),
        F.array_join(F.transform(F.split("text", "\n", -1), shape), "\n").alias("text"),
    )


def document_tasks(spark: SparkSession, sf_dir: str, rows: int = 2500) -> int:
    """Tasks of about ``rows`` documents each (some megabytes of text), and no fewer than other shuffles have."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-table(spark, sf_dir, "documents").count() // rows))


# Planted passages are the questions; a document that holds one is its answer.
GOLD_SQL = """
gold AS (
  SELECT b.item_id AS query_id, d.doc_id, d.source, d.lang
  FROM benchmark b JOIN documents d ON contains(d.text, b.text))
"""


def questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("query"))


def passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return documents(spark, sf_dir).select(F.col("doc_id").alias("chunk_id"), F.col("text").alias("content"))


def gold(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that contain a planted passage.

    Every passage starts at a token, so the pair is found by an equi-join on a
    rare token of the passage and verified by substring search.
    """
    from corpusloom.operators.gold import contains_pairs

    docs = documents(spark, sf_dir)
    asked = table(spark, sf_dir, "benchmark")
    return contains_pairs(
        docs.select("doc_id", "text", "source", "lang"), "doc_id", asked, "item_id"
    ).withColumnRenamed("item_id", "query_id")


def latencies(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select("event_type", F.col("value").alias("ms"))


def exchanges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Question, answer and the next answer of each conversation turn."""
    from pyspark.sql import Window

    w = Window.partitionBy("conv_id").orderBy("turn")
    turns = table(spark, sf_dir, "conversations")
    asked = turns.select(
        "conv_id",
        "turn",
        "role",
        F.col("text").alias("question"),
        F.lead("text", 1).over(w).alias("answer"),
        F.lead("text", 3).over(w).alias("reference"),
    )
    return asked.filter((F.col("role") == "user") & F.col("answer").isNotNull()).drop("role")


EXCHANGES_SQL = """
exchanges AS (
  SELECT conv_id, turn, question, answer, reference FROM (
    SELECT conv_id, turn, role, text AS question,
           lead(text, 1) OVER w AS answer, lead(text, 3) OVER w AS reference
    FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn))
  WHERE role = 'user' AND answer IS NOT NULL)
"""


# One article per document whose list items are the pieces between full stops:
# many short siblings in a row.
ITEMIZED_SQL = """
corpus AS (
  SELECT 'd' || lpad(doc_id::VARCHAR, 8, '0') AS document_id, source AS category,
         '<!-- PAGE: 1 -->' || chr(10) || 'Maddə 1. ' || source || chr(10) ||
         array_to_string(list_transform(string_split(replace(text, chr(10), ' '), '. '), lambda x, i: 'a) ' || x), chr(10)) AS text
  FROM documents)
"""


def itemized(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = F.split(F.replace(F.col("text"), F.lit("\n"), F.lit(" ")), r"\. ", -1)
    return documents(spark, sf_dir).select(
        F.concat(F.lit("d"), F.lpad(F.col("doc_id").cast("string"), 8, "0")).alias("document_id"),
        F.col("source").alias("category"),
        F.concat(F.col("source"), F.lit("/"), F.col("doc_id"), F.lit(".md")).alias("source_relative_path"),
        F.concat(
            F.lit("<!-- PAGE: 1 -->\nMaddə 1. "),
            F.col("source"),
            F.lit("\n"),
            F.array_join(F.transform(pieces, lambda x: F.concat(F.lit("a) "), x)), "\n"),
        ).alias("text"),
    )
