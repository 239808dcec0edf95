"""Boilerplate lines by their frequency within a site."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import filled, persist_to_shared

#: A line on more than this part of a site's pages is boilerplate ...
RATIO = 0.2
#: ... if it is on so many pages at least.
MIN_PAGES = 3


def host_of(url: Column) -> Column:
    """Lower-case host of an address, the empty text where there is none."""
    return F.lower(F.regexp_extract(F.coalesce(url, F.lit("")), r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)", 1))


def html_lines(html: Column) -> Column:
    """Visible text of a page, one line for each block element. Scripts, styles and comments go."""
    text = F.regexp_replace(html, r"(?is)<script\b[^>]*>.*?</script>|<style\b[^>]*>.*?</style>|<!--.*?-->", " ")
    text = F.regexp_replace(text, r"(?i)</?(?:p|br|div|li|ul|ol|h[1-6]|tr|td|th|table|title|nav|article|section|header|footer|body|head)\b[^>]*>", "\n")
    return F.regexp_replace(text, r"<[^>]*>", "")


def line_dedup(pages: DataFrame, id_col: str, host: Column, text: Column, ratio: float = RATIO, min_pages: int = MIN_PAGES) -> DataFrame:
    """Per row: ``page_id, host, n_lines, n_dropped, text``, the text without boilerplate lines.

    A line is what stands between line ends, trimmed of blanks; empty lines are not counted and go. The share of a line is
    the pages of its host that contain it over all pages of that host; a line repeated on a page counts once. Lines above
    ``ratio`` and on ``min_pages`` pages at least are dropped, so a site with fewer pages keeps all. Null text is empty, a
    null host is the host "". Repeated rows are pages of their own. Other columns are ignored.

    Counts use partial aggregates, so a hot host costs no more than another. A host has at most
    (mean distinct lines a page) / ratio boilerplate lines; they travel as one array per host.
    """
    lines = F.filter(F.transform(F.split(filled(text), r"[\n\r]+"), lambda x: F.trim(x)), lambda x: x != "")
    split = pages.select(F.col(id_col).alias("page_id"), F.coalesce(host, F.lit("")).alias("host"), lines.alias("lines"))
    split = persist_to_shared(split, "site-lines")
    totals = split.groupBy("host").agg(F.count("*").alias("pages"))
    each = split.select("host", F.explode(F.array_distinct("lines")).alias("line"))
    counts = each.groupBy("host", "line").agg(F.count("*").alias("n")).where(F.col("n") >= min_pages)
    bad = counts.join(totals, "host").where(F.col("n") > F.col("pages") * F.lit(float(ratio)))
    bad = persist_to_shared(bad.groupBy("host").agg(F.collect_list("line").alias("bad")), "site-boilerplate")
    marked = split.join(bad, "host", "left").withColumn(
        "kept", F.when(F.col("bad").isNull(), F.col("lines")).otherwise(F.filter("lines", lambda x: ~F.array_contains("bad", x)))
    )
    return marked.select(
        "page_id", "host", F.size("lines").cast("long").alias("n_lines"), (F.size("lines") - F.size("kept")).cast("long").alias("n_dropped"),
        F.array_join("kept", "\n").alias("text"),
    )
