"""Reading corpora, chunks, vectors, gold questions, queries and answers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text as tx

CHUNK_SCHEMA = (
    "chunk_id string, id string, document_id string, title string, category string, chapter string, article string, "
    "section string, subsection string, page_start int, page_end int, source_file string, text string, content string"
)
VECTOR_SCHEMA = (
    "schema_version string, chunk_id string, logical_chunk_id string, document_id string, document_version_id string, "
    "embedding_input_sha256 string, model_id string, model_revision string, dense array<float>, "
    "sparse struct<indices: array<int>, values: array<float>>"
)
VECTOR_V1_SCHEMA = "chunk_id string, document_id string, embedding_model string, embedding array<float>"
POLICIES = ("skip_bad", "first_wins", "last_wins", "strict")


def read_corpus(spark: SparkSession, root: str) -> DataFrame:
    """Markdown files below ``root``: category is the parent directory."""
    files = spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", "*.md").text(root, wholetext=True)
    path = F.url_decode(F.regexp_replace("_metadata.file_path", r"\+", "%2B"))
    base = root.rstrip("/").split(":", 1)[-1].lstrip("/")
    relative = F.regexp_replace("path", rf"^.*?\Q{base}\E/", "")
    return files.select(F.col("value").alias("text"), path.alias("path")).select(
        F.regexp_extract("path", r"([^/]+)/[^/]+$", 1).alias("category"), relative.alias("source_relative_path"), "text"
    )


def discover(files: DataFrame, document: str | None = None, limit: int | None = None) -> DataFrame:
    """Files in NFC path order, optionally one by name, stem or path; ``limit`` cuts after the sort."""
    path = tx.nfc(F.col("source_relative_path"))
    out = files.withColumn("sort_path", path)
    if document is not None:
        name = F.element_at(F.split("sort_path", "/"), -1)
        wanted = tx.nfc(F.lit(document))
        out = out.filter((name == wanted) | (F.regexp_replace(name, r"\.[^.]*$", "") == wanted) | (F.col("sort_path") == wanted))
    out = out.orderBy("sort_path")
    return (out if limit is None else out.limit(limit)).drop("sort_path")


def read_chunks(spark: SparkSession, root: str, policy: str = "skip_bad", schema: str = CHUNK_SCHEMA) -> DataFrame:
    """Chunk JSON lines under one of four policies.

    ``skip_bad`` drops bad JSON, missing ids and blank text. ``first_wins`` and
    ``last_wins`` fail on bad JSON or ids and keep one row per id in file and
    line order. ``strict`` also fails on duplicates.
    """
    if policy not in POLICIES:
        raise ValueError(f"unknown policy {policy}; expected one of {POLICIES}")
    raw = (
        spark.read.schema(schema + ", _bad string")
        .option("mode", "PERMISSIVE")
        .option("columnNameOfCorruptRecord", "_bad")
        .option("recursiveFileLookup", "true")
        .json(root)
        .select(
            "*",
            F.col("_metadata.file_path").alias("_file"),
            F.col("_metadata.file_block_start").alias("_block"),
            F.monotonically_increasing_id().alias("_row"),
        )
    )
    return apply_policy(raw, policy).drop("_file", "_block", "_row", "_bad", "id")


def apply_policy(raw: DataFrame, policy: str) -> DataFrame:
    has_id = F.coalesce("chunk_id", F.lit("")) != ""
    body = F.coalesce(F.nullif("text", F.lit("")), F.nullif("content", F.lit("")), F.lit(""))
    rows = raw.withColumn("text", body)
    if policy == "skip_bad":
        return rows.filter(F.col("_bad").isNull() & has_id & (tx.strip(F.col("text")) != ""))
    rows = rows.withColumn("chunk_id", F.coalesce(F.nullif("chunk_id", F.lit("")), F.nullif("id", F.lit(""))))
    fatal = F.when(F.col("_bad").isNotNull(), F.concat(F.lit("bad JSON in "), F.col("_file"))).when(
        F.col("chunk_id").isNull(), F.concat(F.lit("record without chunk_id in "), F.col("_file"))
    )
    # in filters, so that pruning a column can't drop the check
    checked = rows.filter(F.when(fatal.isNotNull(), F.raise_error(fatal).cast("boolean")).otherwise(F.lit(True)))
    if policy == "strict":
        n = F.count(F.lit(1)).over(Window.partitionBy("chunk_id"))
        twice = F.concat(F.lit("duplicate chunk_id "), F.col("chunk_id"))
        counted = checked.withColumn("_n", n)
        return counted.filter(F.when(F.col("_n") > 1, F.raise_error(twice).cast("boolean")).otherwise(F.lit(True))).drop("_n")
    # An aggregate, not a window: copies of one id are reduced before the shuffle.
    order = F.struct("_file", "_block", "_row")
    keep = F.min_by if policy == "first_wins" else F.max_by
    names = [c for c in checked.columns if c != "chunk_id"]
    return checked.groupBy("chunk_id").agg(keep(F.struct(*names), order).alias("r")).select("chunk_id", "r.*")


def read_embeddings(spark: SparkSession, root: str, model: str | None = None, strict: bool = True) -> DataFrame:
    """Vector JSON lines, recursively; strict V2 records fail on a bad line."""
    reader = spark.read.schema(VECTOR_SCHEMA if strict else VECTOR_V1_SCHEMA).option("recursiveFileLookup", "true")
    rows = reader.option("mode", "FAILFAST" if strict else "DROPMALFORMED").json(root)
    column = "model_id" if strict else "embedding_model"
    return rows if model is None else rows.filter(F.col(column) == model)


def id_list(cell: Column) -> Column:
    """``a | b`` cells: trimmed, non-empty, first of each kept in order."""
    parts = F.transform(F.split(cell.cast("string"), r"\|", -1), tx.strip)
    return F.coalesce(F.array_distinct(F.filter(parts, lambda x: x != "")), F.array().cast("array<string>"))


def gold_rows(table: DataFrame) -> DataFrame:
    """Gold table with parsed id lists; missing required columns fail."""
    missing = {"question", "relevant_chunk_ids"} - set(table.columns)
    if missing:
        raise ValueError(f"gold table lacks columns: {sorted(missing)}")
    out = table.withColumn("relevant_chunk_ids", id_list(F.col("relevant_chunk_ids")))
    if "expected_document_ids" in table.columns:
        out = out.withColumn("expected_document_ids", id_list(F.col("expected_document_ids")))
    return out


def read_gold(spark: SparkSession, path: str) -> DataFrame:
    rows = spark.read.parquet(path) if path.endswith(".parquet") else spark.read.option("header", "true").option("multiLine", "true").csv(path)
    return gold_rows(rows)


def query_rows(texts: DataFrame, split: str = "all") -> DataFrame:
    """Queries from JSON documents in ``value``: strings, objects, lists or ``{queries: […]}``.

    Entries that are neither give a null ``query`` and an ``error``.
    """
    root = F.try_parse_json("value")
    items = F.coalesce(
        F.try_variant_get(root, "$.queries", "array<variant>"), F.try_variant_get(root, "$", "array<variant>"), F.array(root)
    )
    rows = texts.select(*[c for c in texts.columns if c != "value"], F.posexplode(items).alias("position", "v"))

    def text(path: str) -> Column:
        at = F.try_variant_get("v", path, "variant")
        return F.when(F.schema_of_variant(at) == "STRING", F.try_variant_get("v", path, "string"))

    query = F.coalesce(text("$"), text("$.query"), text("$.question"), text("$.user_input"))
    out = rows.withColumn("query", query).withColumn("split", F.try_variant_get("v", "$.split", "string"))
    if split != "all":
        is_object = F.schema_of_variant("v").startswith("OBJECT")
        out = out.filter(~is_object | F.coalesce(F.col("split") == split, F.lit(False)))
    return out.withColumn(
        "error", F.when(F.col("query").isNull(), "query entries must be strings or objects with a query")
    ).drop("v")


def read_queries(spark: SparkSession, path: str, split: str = "all") -> DataFrame:
    lines = path.endswith(".jsonl")
    texts = spark.read.text(path, wholetext=not lines)
    return query_rows(texts.filter(tx.strip(F.col("value")) != ""), split)


def answer_ids(cell: Column) -> Column:
    """JSON-encoded id lists; malformed or non-list cells become empty lists."""
    return F.coalesce(F.from_json(cell, "array<string>"), F.array().cast("array<string>"))


def read_answers(spark: SparkSession, path: str, lists: tuple[str, ...] = ("Retrieved Chunk IDs", "Retrieved Documents")) -> DataFrame:
    rows = spark.read.option("header", "true").option("multiLine", "true").option("escape", '"').csv(path)
    for name in lists:
        rows = rows.withColumn(name, answer_ids(F.col(f"`{name}`")))
    return rows
