"""Mixing sources to target weights by pivotal dependent rounding over a reduction tree."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import persist_to_shared, slices, utf8_buffer

#: Weights of the sources in code-point order, repeating.
WEIGHTS = (3.0, 1.0, 2.0)
#: Words of the mix over words of the table, and the most copies of a document.
SHARE, MOST = 1.5, 2.0
#: Units a task pairs in one bucket, and residuals that meet in one bucket of the next level.
FAN = 4096

_SPACE = np.zeros(256, bool)
_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True


def word_counts(column: pa.Array) -> np.ndarray:
    """Runs of bytes other than blank, tab and line ends, for each text."""
    data, offsets = utf8_buffer(column)
    space = _SPACE[data]
    starts = ~space
    starts[1:] &= space[:-1]
    first = offsets[:-1][offsets[:-1] < offsets[1:]]
    starts[first] = ~space[first]
    return np.diff(np.concatenate([[0], np.cumsum(starts)])[offsets])


def _sized(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    # the running sums take some twenty times the text that is open
    for batch in (piece for whole in batches for piece in slices(whole, "text", 2 << 20)):
        size = pa.array(word_counts(batch.column("text")), pa.int64())
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("source"), batch.column("mark"), size], ["doc_id", "source", "mark", "size"])


def targets(sizes: DataFrame, weights=WEIGHTS, share: float = SHARE, most: float = MOST) -> DataFrame:
    """``source, source_size, target`` from rows ``source, size, n``. One row a source; null is a source and comes last.

    A source's target is min(most x size, level x weight), and the level is raised until the targets reach the share of all
    words. Each round is one aggregate over the sources; a round caps a source at least, or is the last.
    """
    from pyspark.sql import Window

    per = sizes.groupBy("source").agg(F.sum(F.col("size") * F.col("n")).alias("source_size"), F.count("*").alias("units"))
    rank = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1  # rows: one a source
    weight = F.element_at(F.array(*map(F.lit, weights)), (rank % len(weights) + 1).cast("int"))
    per = persist_to_shared(per.withColumn("weight", weight), "mix-sources")
    cap = most * F.col("source_size")
    total = share * (per.agg(F.sum("source_size")).first()[0] or 0)
    level = 0.0
    while True:
        capped = F.lit(level) * F.col("weight") >= cap
        held, free = per.agg(F.sum(F.when(capped, cap).otherwise(0.0)), F.sum(F.when(capped, 0.0).otherwise(F.col("weight")))).first()
        if not free:
            break
        new = (total - (held or 0.0)) / free
        if new <= level * (1 + 1e-15):
            break
        level = new
    return per.withColumn("target", F.least(cap, F.lit(level) * F.col("weight")))


def _uniform(keys: np.ndarray, seed: int) -> np.ndarray:
    """Numbers in (0, 1) from 64-bit keys."""
    x = keys.astype(np.uint64) + np.uint64((seed * 0x9E3779B97F4A7C15) % 2**64)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return ((x ^ (x >> np.uint64(31))) >> np.uint64(11)).astype(np.float64) / 2**53 + 2**-54


def _pivot(seed: int, last: bool):
    """Rounds the fractions of one bucket. ``part`` stays in one row at most, the residual; in the last level it is rounded too."""

    def pivot(rows: pd.DataFrame) -> pd.DataFrame:
        # largest first: small documents come last and settle the large ones, so a small one is left open
        rows = rows.sort_values(["mass", "key", "doc_id", "mark"], ascending=[False, True, True, True], kind="stable").reset_index(drop=True)
        mass, part, up = rows["mass"].to_numpy(float), rows["part"].to_numpy(float).copy(), np.zeros(len(rows), np.int64)
        draw = _uniform(rows["key"].to_numpy(np.int64), seed)
        held = -1  # the row whose fraction is open
        for i in range(len(rows)):
            if part[i] <= 0:
                continue
            if mass[i] == 0:  # nothing to balance: rounded on its own
                up[i], part[i] = draw[i] < part[i], 0.0
                continue
            if held < 0:
                held = i
                continue
            a, b = mass[i] * part[i], mass[held] * part[held]
            gain, lose = min(mass[i] - a, b), min(mass[held] - b, a)
            if draw[i] * (gain + lose) < lose:
                a, b = a + gain, b - gain
                settle = (i, 1) if gain == mass[i] - mass[i] * part[i] else (held, 0)
            else:
                a, b = a - lose, b + lose
                settle = (held, 1) if lose == mass[held] - mass[held] * part[held] else (i, 0)
            part[i], part[held] = min(max(a / mass[i], 0.0), 1.0), min(max(b / mass[held], 0.0), 1.0)
            done, value = settle
            up[done], part[done] = value, 0.0
            held = held if done == i else i
            if part[held] >= 1 - 1e-12:
                up[held], part[held], held = 1, 0.0, -1
            elif part[held] <= 1e-12:
                part[held], held = 0.0, -1
        if last and held >= 0:
            up[held], part[held] = _uniform(rows["key"].to_numpy(np.int64)[held : held + 1], seed + 1)[0] < part[held], 0.0
        rows["part"], rows["more"] = part, rows["more"].to_numpy() + up
        return rows

    return pivot


def mix(docs: DataFrame, seed: int = 7, fan: int = FAN, weights=WEIGHTS, share: float = SHARE, most: float = MOST) -> DataFrame:
    """``doc_id, source, mark, n, size, source_size, target, copies, more``: how often the mix takes each document.

    ``size`` is the words of the text (null: 0). A source's documents are all due target / source_size copies, an integer
    and a fraction; the fractions are rounded so that the words taken stay at the source's target, up to one document, and
    every document's expected copies stay what they were. Documents are dealt to buckets of about ``fan`` by a hash of
    their id; each bucket leaves one open fraction at most, and the open ones meet again in buckets of ``fan`` until one is
    left per source. Draws come from the id, so reruns agree.

    ``n`` rows that repeat id, source and text (``mark`` is the text's hash) are one unit: each gets ``copies``, and ``more`` of them get
    one more. Of the unit's due rows only the fraction of one row is rounded by chance.
    A null source is a source of its own; documents without words get copies and add none. An empty table gives an empty one.
    """
    rows = docs.select(F.col("doc_id").cast("long"), F.col("source").cast("string"), F.col("text").cast("string"), F.xxhash64("text").alias("mark"))
    sized = rows.mapInArrow(_sized, "doc_id long, source string, mark long, size long")
    units = persist_to_shared(sized.groupBy("doc_id", "source", "mark", "size").agg(F.count("*").alias("n")), "mix-units")
    per = persist_to_shared(targets(units, weights, share, most), "mix-targets")
    key = F.xxhash64("doc_id", "mark")
    due = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    buckets = F.ceil(F.col("units") / fan)
    to = per.select(F.col("source").alias("own"), "source_size", "target", "units")
    start = units.join(to, F.col("source").eqNullSafe(F.col("own"))).drop("own").withColumn("due", due).withColumn("rows", (F.col("due") - F.floor("due")) * F.col("n"))
    start = start.select(
        F.coalesce("doc_id", F.lit(0)).alias("doc_id"), F.col("doc_id").isNull().alias("no_id"),  # pandas would read longs with nulls as doubles
        "source", "mark", "n", "size", "source_size", "target", key.alias("key"), F.col("size").cast("double").alias("mass"),
        (F.col("rows") - F.floor("rows")).alias("part"), F.floor("due").alias("copies"), F.floor("rows").alias("more"), F.pmod(key, buckets).alias("bucket"), buckets.alias("buckets"),
    )
    largest = per.agg(F.max(buckets)).first()[0] or 1
    done, level = None, 0
    while True:
        last = largest <= 1
        if level:
            start = start.withColumn("bucket", F.floor(F.col("bucket") / fan)).withColumn("buckets", F.ceil(F.col("buckets") / fan))
        out = persist_to_shared(start.groupBy("source", "bucket").applyInPandas(_pivot(seed + 10 * level, last), start.schema), f"mix-level-{level}")
        settled = out if last else out.where("part = 0")
        done = settled if done is None else done.unionByName(settled)
        if last:
            break
        start, largest, level = out.where("part > 0"), -(-largest // fan), level + 1
    doc_id = F.when(~F.col("no_id"), F.col("doc_id")).alias("doc_id")
    return done.select(doc_id, "source", "mark", "n", "size", "source_size", "target", F.col("copies").cast("int").alias("copies"), "more")


def each_row(mixed: DataFrame, block: int = 4096) -> DataFrame:
    """One row for each of a unit's ``n`` rows, with its own ``copies``. A unit of many rows is dealt out in blocks."""
    blocks = mixed.withColumn("start", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1, F.lit(block).cast("long"))))
    dealt = blocks.repartition("doc_id", "mark", "start")
    rows = dealt.withColumn("no", F.explode(F.sequence("start", F.least(F.col("start") + block, F.col("n")) - 1)))
    return rows.withColumn("copies", F.col("copies") + (F.col("no") < F.col("more")).cast("int")).drop("start", "no", "more", "n")


def apply_mix(docs: DataFrame, salts: int = 256, **options) -> DataFrame:
    """The rows of the mix with all columns of ``docs``, each as often as it is taken.

    Of rows that repeat id, source and text but not all get the same number of copies, those that get one more are told by
    their number, which is counted within ``salts`` parts first, so a large group is numbered by many tasks.
    """
    from pyspark.sql import Window

    names = ["__id", "__source", "__mark"]
    taken = mix(docs, **options).select(F.col("doc_id").alias("__id"), F.col("source").alias("__source"), F.col("mark").alias("__mark"), F.col("copies").alias("__copies"), F.col("more").alias("__more"), F.col("n").alias("__n"))
    taken = persist_to_shared(taken, "mix-taken")
    marked = docs.withColumn("__text_mark", F.xxhash64(F.col("text").cast("string")))
    same = F.col("doc_id").cast("long").eqNullSafe(F.col("__id")) & F.col("source").cast("string").eqNullSafe(F.col("__source")) & (F.col("__text_mark") == F.col("__mark"))
    alike = taken.where("__more in (0, __n)").withColumn("__copies", F.col("__copies") + (F.col("__more") > 0).cast("int")).where("__copies > 0")
    rows = marked.join(alike, same)
    mixed = taken.where("__more not in (0, __n)")
    if not mixed.isEmpty():
        some = persist_to_shared(marked.join(mixed, same).withColumn("__salt", F.pmod(F.monotonically_increasing_id(), F.lit(salts))), "mix-repeated")
        counts = some.groupBy(*names, "__salt").agg(F.count("*").alias("__m"))
        before = F.sum("__m").over(Window.partitionBy(*names).orderBy("__salt")) - F.col("__m")
        counts = counts.withColumn("__before", before).select(*[F.col(c).alias(f"{c}_") for c in (*names, "__salt")], "__before")
        hit = [some[c].eqNullSafe(counts[f"{c}_"]) for c in (*names, "__salt")]
        place = F.col("__before") + F.row_number().over(Window.partitionBy(*names, "__salt").orderBy(F.lit(0)))
        more = some.join(counts, hit).withColumn("__copies", F.col("__copies") + (place <= F.col("__more")).cast("int")).where("__copies > 0")
        rows = rows.select(*docs.columns, "__copies").unionByName(more.select(*docs.columns, "__copies"))
    return rows.withColumn("__copy", F.explode(F.array_repeat(F.lit(1), F.col("__copies")))).select(*docs.columns)
