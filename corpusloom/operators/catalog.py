"""Catalogue and viewing queries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import ids


def source_verify(documents: DataFrame) -> DataFrame:
    """Stored source hash against the text, with the representation id."""
    actual = ids.sha256(F.col("text"))
    return documents.withColumn("actual_sha256", actual).select(
        *documents.columns,
        (F.col("actual_sha256") == F.col("source_sha256")).alias("valid"),
        F.concat_ws(":", F.lit("cleaned"), "document_version_id", "actual_sha256").alias("representation_id"),
    )


def catalog_documents(documents: DataFrame, chunks: DataFrame, pages: DataFrame) -> DataFrame:
    """Metadata with page count, chunk count and distinct article labels, by title."""
    per = chunks.groupBy("document_id").agg(
        F.count(F.lit(1)).alias("chunk_count"),
        F.array_sort(F.collect_set("article")).alias("articles"),
    )
    return (
        documents.join(per, "document_id", "left")
        .join(pages.groupBy("document_id").agg(F.max("page").alias("page_count")), "document_id", "left")
        .na.fill(0, ["chunk_count"])
        .withColumn("articles", F.coalesce("articles", F.array().cast("array<string>")))
        .orderBy("title", "document_id")
    )


def pages_in_ranges(requests: DataFrame, ranges: DataFrame) -> DataFrame:
    """``document_id, page, chunk_id`` of the asked pages that lie between ``page_start`` and ``page_end`` of a chunk.

    A range is cut into dyadic blocks, two of each size at most; a page lies in one block of each size. So both sides meet by
    (document, size, block), each hit once, and a document with many pages and chunks is spread over its blocks. Pages count from 0 or 1.
    """
    level = lambda c, k: F.call_function("shiftright", c, k)
    at = (F.col("page") + 1).cast("long")
    sizes = F.sequence(F.lit(0), F.floor(F.log2(at)).cast("int"))
    asked = requests.where("page >= 0").select("document_id", "page").distinct()
    asked = asked.withColumn("size", F.explode(sizes)).withColumn("block", level(at, F.col("size")))

    first, stop = F.greatest(F.col("page_start"), F.lit(0)).cast("long") + 1, F.col("page_end").cast("long") + 2

    def blocks(k: Column) -> Column:
        whole = F.call_function("shiftleft", F.lit(1).cast("long"), k)
        low, high = level(first + whole - 1, k), level(stop, k)
        ends = F.array(F.when(low % 2 == 1, low), F.when(high % 2 == 1, high - 1))
        return F.transform(F.when(low < high, F.filter(ends, lambda x: x.isNotNull())).otherwise(F.array().cast("array<long>")), lambda x: F.struct(k.alias("size"), x.alias("block")))

    held = ranges.where("page_start is not null and page_end >= greatest(page_start, 0)")
    per_size = F.transform(F.sequence(F.lit(0), F.floor(F.log2(stop - first)).cast("int")), blocks)
    held = held.select("document_id", "chunk_id", F.inline(F.flatten(per_size)))
    return asked.join(held, ["document_id", "size", "block"]).select("document_id", "page", "chunk_id")


def catalog_page(requests: DataFrame, pages: DataFrame, chunks: DataFrame) -> DataFrame:
    """Page text and the chunks whose page range holds the page; a page asked twice gives two rows."""
    held = pages_in_ranges(requests, chunks)
    listed = held.groupBy("document_id", "page").agg(F.array_sort(F.collect_list("chunk_id")).alias("chunk_ids"))
    return (
        requests.join(pages.select("document_id", "page", "page_text"), ["document_id", "page"], "left")
        .join(listed, ["document_id", "page"], "left")
        .withColumn("chunk_ids", F.coalesce("chunk_ids", F.array().cast("array<string>")))
        .withColumn("found", F.col("page_text").isNotNull())
    )


def catalog_highlight(chunks: DataFrame, selectors: DataFrame) -> DataFrame:
    """First selector of each chunk, or ``unresolved`` with the reason."""
    first = selectors.groupBy("chunk_id").agg(F.min_by(F.struct("position_start", "position_end", "page", "exact"), "span_no").alias("s"))
    return chunks.select("document_id", "chunk_id").join(first, "chunk_id", "left").select(
        "document_id",
        "chunk_id",
        "s.position_start",
        "s.position_end",
        "s.page",
        F.when(F.col("s").isNull(), "unresolved").otherwise("resolved").alias("status"),
        F.when(F.col("s").isNull(), "no valid source span").alias("reason"),
    )
