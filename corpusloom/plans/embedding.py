"""Encoding a corpus in shards that a later run can resume."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import ids
from ..operators import plugins
from ..session import persist_to_shared
from ..sources import writers

#: Shards a job writes. A run that dies loses the shards of one job at most.
WAVE = 32


class StaleShards(RuntimeError):
    """Stored shards were made from other inputs than the corpus has now."""


def inputs(chunks: DataFrame, text: str, shards: int) -> DataFrame:
    """Append ``embedding_input_sha256`` and ``shard``."""
    return chunks.withColumn("embedding_input_sha256", ids.sha256(F.col(text))).withColumn("shard", writers.shard_of(shards))


def stored_vectors(spark: SparkSession, root: str, id_type: str) -> DataFrame:
    """What earlier runs left; an empty table if there was none."""
    schema = f"chunk_id {id_type}, embedding_input_sha256 string, model_id string, model_revision string, run string, {plugins.EMBEDDING_FIELDS}, shard int"
    if not writers._exists(spark, root):
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).parquet(root)


def shard_ledger(wanted: DataFrame, stored: DataFrame, model_id: str, revision: str, shards: int) -> DataFrame:
    """``shard, rows, stored_rows, status``: done, missing or stale, by count and hash of the inputs of each shard."""
    same = (F.col("model_id") == model_id) & (F.col("model_revision") == revision)
    keys = ["chunk_id", "embedding_input_sha256"]
    now = writers.shard_hashes(wanted, keys, shards)
    was = writers.shard_hashes(stored.withColumn("embedding_input_sha256", F.when(same, F.col("embedding_input_sha256"))), keys, shards)
    both = now.alias("n").join(was.alias("w"), "shard", "full_outer")
    status = F.when(F.col("w.rows").isNull(), "missing").when((F.col("n.rows") == F.col("w.rows")) & (F.col("n.shard_sha256") == F.col("w.shard_sha256")), "done").otherwise("stale")
    return both.select("shard", F.coalesce("n.rows", F.lit(0)).alias("rows"), F.coalesce("w.rows", F.lit(0)).alias("stored_rows"), status.alias("status"))


def embed_corpus(
    chunks: DataFrame,
    root: str,
    text: str = "embedding_text",
    model_id: str = "hashing",
    revision: str = "1",
    shards: int = 256,
    redo_stale: bool = False,
    run: str = "",
    wave: int = WAVE,
    stop_after: int | None = None,
) -> DataFrame:
    """The vectors of all chunks, encoding only what ``root`` doesn't hold yet.

    A shard is done when its rows have the ids, inputs, model and revision of the corpus; done shards are not touched. Missing
    ones are encoded. Stale ones are refused with :class:`StaleShards`, or with ``redo_stale`` their changed rows are encoded
    anew, rows without a chunk go, and the others are kept. Shards are written ``wave`` a job, each job replacing whole shards,
    so a run that was killed goes on with the shards it had not finished. ``stop_after`` jobs end a run early, for tests.

    ``chunks`` must have unique ids. The list of shards is at most ``shards`` rows.
    """
    spark = chunks.sparkSession
    wanted = inputs(chunks.select("chunk_id", text), text, shards)
    id_type = dict(chunks.dtypes)["chunk_id"]
    ledger = shard_ledger(wanted, stored_vectors(spark, root, id_type), model_id, revision, shards).filter("status <> 'done'")
    open_shards = sorted((r["shard"], r["status"], r["rows"]) for r in ledger.collect())
    stale = [s for s, status, _ in open_shards if status == "stale"]
    if stale and not redo_stale:
        raise StaleShards(f"{len(stale)} shards hold other inputs, e.g. {stale[:5]}")
    gone = [s for s, _, rows in open_shards if rows == 0]
    todo = [s for s, _, rows in open_shards if rows > 0]
    for done, at in enumerate(range(0, len(todo), wave)):
        if stop_after is not None and done >= stop_after:
            break
        names = todo[at : at + wave]
        mine, held = wanted.filter(F.col("shard").isin(names)), stored_vectors(spark, root, id_type).filter(F.col("shard").isin(names))
        held = held.filter((F.col("model_id") == model_id) & (F.col("model_revision") == revision))
        keys = ["chunk_id", "embedding_input_sha256"]
        # written aside first: the shards it is read from are replaced below
        kept = persist_to_shared(held.join(mine.select(*keys), keys, "left_semi").select(*held.columns), "kept-vectors")
        fresh = mine.join(kept.select("chunk_id"), "chunk_id", "left_anti").repartition("shard")
        fresh = plugins.embed_batch(fresh, text, model_id).select(
            *keys, F.lit(model_id).alias("model_id"), F.lit(revision).alias("model_revision"), F.lit(run).alias("run"), "dense", "sparse", "shard"
        )
        both = kept.unionByName(fresh).repartition("shard")
        both.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("shard").parquet(root)
    out = stored_vectors(spark, root, id_type)
    return out.filter(~F.col("shard").isin(gone)) if gone else out
