"""Page-level text operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as tx
from ..session import small_side


def join_pages(pages: DataFrame) -> DataFrame:
    """Clean ``(document_id, page, text)`` rows and join them into marked text."""
    body = pages.withColumn("body", tx.clean_page(F.col("text"))).filter(F.col("body") != "")
    item = F.struct(
        "page",
        F.concat(F.lit("<!-- PAGE: "), F.col("page").cast("string"), F.lit(" -->\n\n"), F.col("body")).alias("t"),
    )
    return body.groupBy("document_id").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(item)), lambda x: x["t"]), "\n\n---\n\n").alias("text"),
        F.count(F.lit(1)).alias("pages"),
    )


def page_pieces(docs: DataFrame) -> DataFrame:
    """One row per page marker: number, trimmed bounds and text, in order."""
    marker = tx.PAGE_MARKER
    markers = F.regexp_extract_all("text", F.lit(marker), F.lit(0))
    numbers = F.regexp_extract_all("text", F.lit(marker), F.lit(1))
    # Offsets are sums of code-point lengths; regex positions would be UTF-16.
    none = F.array(F.lit(None).cast("string"))
    placed = (
        docs.select(
            "document_id",
            F.posexplode(
                F.arrays_zip(
                    F.split("text", marker, -1).alias("piece"),
                    F.concat(none, markers).alias("marker"),
                    F.concat(none, numbers).alias("number"),
                )
            ).alias("i", "x"),
        )
        .select(
            "document_id",
            "i",
            F.col("x.piece").alias("piece"),
            F.col("x.number").cast("int").alias("page"),
            F.coalesce(F.length("x.marker"), F.lit(0)).alias("marker_length"),
        )
    )
    w = Window.partitionBy("document_id").orderBy("i")
    start = F.sum(F.length("piece") + F.col("marker_length")).over(w) - F.length("piece")
    left = F.length("piece") - F.length(F.regexp_replace("piece", f"^[{tx.WS}]+", ""))
    return (
        placed.withColumn("raw_start", start)
        .filter(F.col("page").isNotNull())
        .select(
            "document_id",
            "i",
            "page",
            (F.col("raw_start") + left).alias("page_start"),
            F.greatest(
                F.col("raw_start") + left, F.col("raw_start") + F.length(tx.rstrip(F.col("piece")))
            ).alias("page_end"),
            tx.strip(F.col("piece")).alias("page_text"),
        )
    )


def page_bounds(docs: DataFrame, keep: str = "last") -> DataFrame:
    """Bounds per page number; of a repeated number the last (or first) marker wins."""
    order = F.col("i").desc() if keep == "last" else F.col("i").asc()
    w = Window.partitionBy("document_id", "page").orderBy(order)
    return page_pieces(docs).withColumn("rn", F.row_number().over(w)).filter("rn = 1").drop("rn", "i")


def language_check(docs: DataFrame, markers: DataFrame) -> DataFrame:
    """Ends like a sentence and has a marker word or letter of its language."""
    folded = tx.casefold(F.col("text"))
    return docs.join(small_side(markers), "lang").withColumn(
        "looks_right",
        tx.rstrip(F.col("text")).rlike(r"[?.]$")
        & (F.expr("(' ' || lower(text)) rlike words") | F.regexp_like(folded, F.col("letters"))),
    )
