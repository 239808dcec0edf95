"""Exact duplicates by a 128-bit content hash, with the bytes compared inside equal hashes."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import filled, persist_to_shared


def without_space(text: Column) -> Column:
    """The text without blanks, tabs and line ends."""
    return F.regexp_replace(text, r"[\x20\x09-\x0D]+", "")


def content_hash(text: Column) -> Column:
    return F.unhex(F.md5(text))


def exact_dedup(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    normalise: Callable[[Column], Column] = without_space,
    hash128: Callable[[Column], Column] = content_hash,
) -> DataFrame:
    """One row per row of ``docs``: ``doc_id, keep_id, group_size, kept, text_sha256``.

    Texts are equal when their normal forms are. Of equal texts the row with the most code points in its own text, then
    the smallest id, stays; a row without an id comes after those with one. Null text is the empty text, and all empty
    texts are equal. Rows that repeat an id with an equal text count each; all of them carry ``kept`` when that id stays,
    and :func:`drop_duplicates` keeps one of them. Other columns are ignored, an empty table gives an empty one.

    The rows of a group are only aggregated (partial counts and minima), never gathered, so a group may hold any part of
    the table. Bytes are compared by grouping on (hash, normal form): copies merge before the shuffle, and a hash with two
    normal forms is a collision, whose rows are then grouped by the normal form itself.
    """
    text = filled(text_col)
    normal = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.char_length(text).cast("long").alias("size"), normalise(text).alias("normal"))
    normal = normal.withColumn("hash", hash128(F.col("normal")))
    rows = persist_to_shared(normal.select("doc_id", "size", "hash", F.lit("").alias("exact"), F.sha2("normal", 256).alias("text_sha256")), "dedup-rows")
    forms = normal.select("hash", "normal").distinct()
    collided = persist_to_shared(forms.groupBy("hash").count().where("count > 1").select("hash"), "dedup-collided")
    if not collided.isEmpty():
        exact = normal.join(collided, "hash", "left_semi").select("doc_id", "size", "hash", F.col("normal").alias("exact"), F.sha2("normal", 256).alias("text_sha256"))
        rows = persist_to_shared(rows.join(collided, "hash", "left_anti").unionByName(exact), "dedup-rows-exact")
    best = F.min(F.struct(-F.col("size"), F.col("doc_id").isNull().alias("no_id"), F.col("doc_id")))
    groups = rows.groupBy("hash", "exact").agg(best["doc_id"].alias("keep_id"), F.count("*").alias("group_size"))
    # read back, so that both sides of the join are plain exchanges and a hot group can be split
    groups = persist_to_shared(groups, "dedup-groups")
    return rows.join(groups, ["hash", "exact"]).select(
        "doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), "text_sha256"
    )


def drop_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that :func:`exact_dedup` keeps, with all their columns; of rows that repeat an id and an
    equal text the one with the most code points stays, of those the one with the smallest hash of its text, so that
    reruns agree on the text. Rows alike in all that count as one: any of them stays."""
    decided = exact_dedup(docs, id_col, text_col)
    text = filled(text_col)
    keys = {"__id": F.col(id_col).cast("long"), "__sha": F.sha2(without_space(text), 256), "__size": -F.char_length(text), "__mark": F.xxhash64(text)}
    marked = docs.select("*", *(c.alias(n) for n, c in keys.items()))
    stay = decided.where("kept").groupBy("doc_id", "text_sha256").agg(F.lit(1).alias("one"))
    stay = stay.select(F.col("doc_id").alias("__keep_id"), F.col("text_sha256").alias("__keep_sha"))
    # ids, sizes and hashes only: which of the rows that repeat an id stays
    small = docs.select(*(c.alias(n) for n, c in keys.items())).join(stay, F.col("__id").eqNullSafe(F.col("__keep_id")) & (F.col("__sha") == F.col("__keep_sha")))
    best = small.groupBy("__keep_id", "__keep_sha").agg(F.min(F.struct("__size", "__mark")).alias("__best"))
    same = F.col("__id").eqNullSafe(F.col("__keep_id")) & (F.col("__sha") == F.col("__keep_sha"))
    same &= (F.col("__size") == F.col("__best.__size")) & (F.col("__mark") == F.col("__best.__mark"))
    return marked.join(best, same).dropDuplicates(["__id", "__sha"]).select(*docs.columns)
