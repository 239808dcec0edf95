"""Session settings the library relies on, and size checks for broadcasts."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Settings that shape plans. They can be set at run time on an existing session.
PLAN_SETTINGS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # A table hash-partitioned by document joins another one on (document, locator)
    # without shuffling either side again.
    "spark.sql.requireAllClusterKeysForCoPartition": "false",
    # Otherwise every explode of a computed array also filters on the array's
    # size below the shuffle, which evaluates the tokenizer twice.
    "spark.sql.optimizer.excludedRules": "org.apache.spark.sql.catalyst.optimizer.InferFiltersFromGenerate",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    # 10,000 rows, the other bound of a batch, are hundreds of MB where a row is a text with all its spans.
    "spark.sql.execution.arrow.maxBytesPerBatch": "16m",
}

#: Rows of a query-side table that may be broadcast. Beyond it the operators
#: keep the same plan but let Spark shuffle both sides.
SMALL_SIDE_ROWS = 50_000


def build_session(app: str = "corpusloom", cores: str | None = None) -> SparkSession:
    """A local session for tests and benchmarks. On a cluster use spark-submit."""
    cores = cores or os.environ.get("BENCH_CPUS", "8")
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.driver.memory", os.environ.get("CORPUSLOOM_DRIVER_MEMORY", "8g"))
        .config("spark.sql.shuffle.partitions", cores)
        .config("spark.ui.enabled", "false")
    )
    for key, value in PLAN_SETTINGS.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def prepare(spark: SparkSession) -> SparkSession:
    """Apply the plan settings to a session somebody else made."""
    for key, value in PLAN_SETTINGS.items():
        if spark.conf.get(key, None) != value:
            spark.conf.set(key, value)
    return spark


def has_at_most(df: DataFrame, rows: int) -> bool:
    """True when ``df`` has no more than ``rows`` rows. Stops reading early."""
    return df.limit(rows + 1).count() <= rows


def small_side(df: DataFrame, probe: DataFrame | None = None, rows: int = SMALL_SIDE_ROWS) -> DataFrame:
    """Broadcast ``df`` only after counting it (or the ``probe`` that bounds it).

    A table over the bound is returned unhinted, so Spark plans a shuffle join
    and adaptive execution splits its skewed partitions.
    """
    return F.broadcast(df) if has_at_most(df if probe is None else probe, rows) else df


def matching(wide: DataFrame, asked: DataFrame, key: str) -> DataFrame:
    """Rows of a wide table that a short list asks for, found before they are joined or hashed."""
    ids = asked.select(key).distinct()
    return wide.join(small_side(ids), key, "left_semi")


def spread(df: DataFrame) -> DataFrame:
    """Use all cores when the input has fewer splits than the session has cores.

    A table of any size has more splits than that and is returned as it is.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def shared_folder(spark: SparkSession) -> str:
    """Folder that every executor sees; the cluster names it in its settings."""
    configured = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get(
        "spark.checkpoint.dir", None
    )
    if configured:
        return configured
    if spark.sparkContext.master.startswith("local"):
        import tempfile

        return tempfile.mkdtemp(prefix="spark-", dir="/tmp")
    raise ValueError("set spark.checkpoint.dir to a folder that all executors share")


def persist_to_shared(df: DataFrame, name: str) -> DataFrame:
    """Write a reused intermediate as Parquet and read it back.

    Cuts the lineage without relying on executor memory, so losing an executor
    does not recompute the chain behind it.
    """
    import uuid

    spark = df.sparkSession
    path = f"{shared_folder(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    df.write.mode("overwrite").option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)
