"""Vectors meet chunks: resuming, checking and loading an index."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import ids


def embed_todo(chunks: DataFrame, stored: DataFrame) -> DataFrame:
    """Chunks whose vector is missing, in chunk order by id."""
    keys = ["chunk_id", "embedding_input_sha256", "model_revision"]
    return chunks.join(stored.select(*keys), keys, "left_anti")


def embed_stale(chunks: DataFrame, stored: DataFrame) -> DataFrame:
    """Stored vectors whose input changed under the same id and revision."""
    now = chunks.select("chunk_id", "model_revision", F.col("embedding_input_sha256").alias("expected_sha256"))
    return stored.join(now, ["chunk_id", "model_revision"]).filter(F.col("embedding_input_sha256") != F.col("expected_sha256"))


def artifact_check(vectors: DataFrame, manifest: DataFrame, hashes: DataFrame) -> DataFrame:
    """Per shard: hash and count against the manifest; repeated ids overall."""
    compared = manifest.alias("m").join(hashes.alias("h"), "shard", "full_outer").select(
        "shard",
        F.when(F.col("h.rows").isNull(), "shard is missing")
        .when(F.col("m.rows").isNull(), "shard is not in the manifest")
        .when(F.col("h.rows") != F.col("m.rows"), "row count differs")
        .when(F.col("h.shard_sha256") != F.col("m.shard_sha256"), "hash differs")
        .otherwise("ok")
        .alias("status"),
    )
    repeated = vectors.groupBy("chunk_id").agg(F.count(F.lit(1)).alias("n")).agg(F.count_if(F.col("n") > 1).alias("repeated_ids"))
    return compared.crossJoin(F.broadcast(repeated))  # one row


def points_join(vectors: DataFrame, chunks: DataFrame, allowed: Sequence[str]) -> DataFrame:
    """Index points with the first broken rule in ``error``."""
    facts = chunks.withColumn("present", F.lit(True))
    joined = vectors.join(facts, "chunk_id", "left")
    error = (
        F.when(F.col("present").isNull(), "vector without a chunk")
        .when(F.col("embedding_input_sha256") != F.col("expected_sha256"), "stale vector")
        .when(~F.col("category").isin(*allowed), "category is not allowed")
    )
    return joined.select(
        ids.point_id(F.col("chunk_id").cast("string")).alias("point_id"), *[c for c in joined.columns if c != "present"], error.alias("error")
    )


def points_reconcile(vectors: DataFrame, chunks: DataFrame, dims: int) -> DataFrame:
    """Tolerant load: one status per vector row. ``seq`` orders repeated ids."""
    first = vectors.groupBy("chunk_id").agg(F.min("seq").alias("first_seq"))
    known = chunks.select("chunk_id").distinct().withColumn("known", F.lit(True))
    return (
        vectors.join(first, "chunk_id")
        .join(known, "chunk_id", "left")
        .withColumn(
            "status",
            F.when(F.col("seq") > F.col("first_seq"), "duplicate")
            .when(F.col("known").isNull(), "orphan")
            .when(F.size("vector") != dims, "dimension mismatch")
            .otherwise("loaded"),
        )
        .drop("first_seq", "known")
    )


def collection_check(points: DataFrame, expected: DataFrame, found: DataFrame) -> DataFrame:
    """Count equality, metadata equality and a smoke search that returns known ids."""
    counts = points.agg(F.count(F.lit(1)).alias("actual")).crossJoin(
        F.broadcast(expected.agg(F.count(F.lit(1)).alias("expected")))  # one row
    )
    columns = [c for c in expected.columns if c in points.columns]
    different = expected.select(*columns).exceptAll(points.select(*columns)).agg(F.count(F.lit(1)).alias("different"))
    unknown = found.join(expected.select("chunk_id"), "chunk_id", "left_anti").agg(F.count(F.lit(1)).alias("unknown_hits"))
    return counts.crossJoin(F.broadcast(different)).crossJoin(F.broadcast(unknown))  # one row each
