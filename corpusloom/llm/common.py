"""Small helpers the operators of this package share."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.session import persist_to_shared  # noqa: F401  the folder comes from spark.checkpoint.dir


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def filled(column: str | Column) -> Column:
    """A text column with null read as the empty text."""
    return F.coalesce(F.col(column) if isinstance(column, str) else column, F.lit(""))


def utf8_buffer(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string or binary array and its n + 1 offsets, without copying; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("" if pa.types.is_string(column.type) or pa.types.is_large_string(column.type) else b"")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    buffers = column.buffers()
    if len(column) == 0 or buffers[1] is None:
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    offsets = np.frombuffer(buffers[1], np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data = np.frombuffer(buffers[2], np.uint8) if buffers[2] is not None else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def whole_runs(batches: Iterator[pa.RecordBatch], keys: list[str], rows: int = 20_000) -> Iterator[pa.Table]:
    """Regroup batches sorted by ``keys`` so that no run of equal keys is cut. Runs must be bounded by the caller."""
    held: list[pa.RecordBatch] = []
    n = 0
    for batch in batches:
        if batch.num_rows == 0:
            continue
        if n >= rows:
            # the run at the end of what is held goes on in this batch for so many rows
            last = [held[-1].column(k)[-1] for k in keys]
            same = np.ones(batch.num_rows, bool)
            for k, v in zip(keys, last):
                column = batch.column(batch.schema.get_field_index(k))
                same &= column.to_numpy(zero_copy_only=False) == v.as_py()
            cut = batch.num_rows if same.all() else int(np.argmin(same))
            held.append(batch.slice(0, cut))
            n += cut
            if cut < batch.num_rows:
                yield pa.Table.from_batches(held)
                held, n = [batch.slice(cut)], batch.num_rows - cut
            continue
        held.append(batch)
        n += batch.num_rows
    if n:
        yield pa.Table.from_batches(held)


def slices(batch: pa.RecordBatch, column: str, limit: int) -> Iterator[pa.RecordBatch]:
    """Cut a batch so that each piece has about ``limit`` bytes of ``column``, or one row."""
    import pyarrow.compute as pc

    sums = np.cumsum(np.asarray(pc.fill_null(pc.binary_length(batch.column(column)), 0), dtype=np.int64))
    start = 0
    while start < batch.num_rows:
        stop = max(start + 1, int(np.searchsorted(sums, (sums[start - 1] if start else 0) + limit, "right")))
        yield batch.slice(start, stop - start)
        start = stop
