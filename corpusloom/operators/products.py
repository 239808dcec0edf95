"""Top-k of sums over shared terms, for a batch of queries whose weights fit one matrix.

A row is a document with its terms in an array. A task turns some documents at a time into a matrix of the terms that the
batch asks for, one product scores them for all queries, and of each query only the ``k`` best rows leave the task. No
(term, query) hit and no (document, query) pair is ever a row.
"""

from __future__ import annotations

import copy
import sys
from collections.abc import Iterator, Sequence
from types import SimpleNamespace

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import cloudpickle
from pyspark.sql import DataFrame, Row

cloudpickle.register_pickle_by_value(sys.modules[__name__])  # executors need not have this package

#: Weights of a batch of queries (terms x queries), which every Python worker holds.
WEIGHT_CELLS = 4_000_000
#: Cells of a task's matrices: documents x terms, documents x queries.
CELLS = 2_000_000


class Batch:
    """The weights of a batch of queries as a matrix, and what each query filters on."""

    def __init__(self, asked: Sequence[Row], weights: Sequence[Row], term: str, filters: Sequence[str] = ()):
        self.query_ids = [r["query_id"] for r in asked]
        self.filters = [[r[f"q_{c}"] for r in asked] for c in filters]
        self.terms = list({r[term]: None for r in weights})
        at, number = {t: i for i, t in enumerate(self.terms)}, {q: i for i, q in enumerate(self.query_ids)}
        self.matrix = np.zeros((len(self.query_ids), len(self.terms)))
        for r in weights:
            self.matrix[number[r["query_id"]], at[r[term]]] += r["w"]

    def clipped(self) -> Batch:
        """The same without negative weights, for sums that bound others from above."""
        out = copy.copy(self)
        out.matrix = np.maximum(self.matrix, 0.0)
        return out


class _Best:
    """The k best rows of each query seen so far; ties go to the smaller id."""

    def __init__(self, queries: int, k: int):
        self.k, self.limit = k, np.full(queries, -np.inf)
        self.held: list[tuple[np.ndarray, np.ndarray, np.ndarray] | None] = [None] * queries

    def add(self, scores: np.ndarray, order: np.ndarray, ids: np.ndarray) -> None:
        """``order`` holds rounded scores, minus infinity where a row is no answer; ``ids`` rise."""
        k, n = self.k, order.shape[1]
        least = self.limit if n <= k else np.maximum(self.limit, np.partition(order, n - k, axis=1)[:, n - k])
        fit = (order >= least[:, None]) & (order > -np.inf)
        for q in np.flatnonzero(fit.any(axis=1)).tolist():
            at = np.flatnonzero(fit[q])
            if len(at) > k:
                over = order[q, at] > least[q]
                at = np.concatenate([at[over], at[~over][: k - int(over.sum())]])
            new = (order[q, at], scores[q, at], ids[at])
            if self.held[q] is not None:
                new = tuple(np.concatenate(both) for both in zip(self.held[q], new))
            best = np.lexsort((np.array(new[2].tolist()), -new[0]))[:k]
            self.held[q] = tuple(x[best] for x in new)
            if len(best) == k:
                self.limit[q] = self.held[q][0][-1]


def _chunks(batch: pa.RecordBatch, sent: Batch | SimpleNamespace, columns: Sequence[str]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, list[list]]]:
    """Ids, scores (queries x rows), whether a row shares a term with a query, and columns, of some rows at a time."""
    terms = batch.column("terms")
    found = pc.fill_null(pc.index_in(terms.flatten(), value_set=pa.array(sent.terms, terms.type.value_type)), -1).to_numpy(zero_copy_only=False)
    values = batch.column("weights").flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    sizes = pc.fill_null(pc.list_value_length(terms), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    ends = np.concatenate([[0], np.cumsum(sizes)])
    step = max(1, CELLS // max(1, len(sent.terms), len(sent.query_ids)))
    for a in range(0, batch.num_rows, step):
        part = batch.slice(a, step)
        n = part.num_rows
        ids = part.column("chunk_id")
        order = pc.sort_indices(ids).to_numpy()
        place = np.empty(n, np.int64)
        place[order] = np.arange(n)
        cut = slice(ends[a], ends[a + n])
        hit = found[cut] >= 0
        owner = place[np.repeat(np.arange(n), sizes[a : a + n])[hit]]
        used, column = np.unique(found[cut][hit], return_inverse=True)
        cells = np.bincount(owner * len(used) + column, values[cut][hit], n * len(used)).reshape(n, len(used))
        side = sent.matrix[:, used]
        scores = side @ cells.T
        if (side < 0).any() or (values[cut][hit] <= 0).any():
            held = np.zeros(cells.shape)
            held[owner, column] = 1
            shared = (side != 0).astype(float) @ held.T > 0
        else:
            shared = scores > 0
        kept = ids.take(pa.array(order)).to_numpy(zero_copy_only=False)
        yield kept, scores, shared, [part.column(c).take(pa.array(order)).to_pylist() for c in columns]


def top_rows(rows: DataFrame, sent: Batch, k: int, columns: Sequence[str] = (), only: str | None = None) -> DataFrame:
    """``query_id, chunk_id, score``: the ``k`` best rows of each query in each task.

    ``rows``: ``chunk_id, terms, weights`` and the ``columns`` that the queries filter on; a null filter lets all rows pass.
    ``only``: 'shared' leaves out rows without a term of the query, 'positive' those without a positive score; else
    every row is an answer.
    """
    import pyspark.sql.types as T

    spark = rows.sparkSession
    kind = rows.schema["chunk_id"].dataType
    asked = pa.array(sent.query_ids)
    query_kind = "string" if pa.types.is_string(asked.type) or pa.types.is_null(asked.type) else "long"
    shipped = spark.sparkContext.broadcast(vars(sent))  # plain values, which need no module

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        batch_of = SimpleNamespace(**shipped.value)
        best = _Best(len(batch_of.query_ids), k)
        for batch in batches:
            for ids, scores, shared, held in _chunks(batch, batch_of, columns):
                order = np.round(scores, 10)
                if only == "shared":
                    order[~shared] = -np.inf
                elif only == "positive":
                    order[scores <= 0] = -np.inf
                for wanted, column in zip(batch_of.filters, held):
                    numbers = {v: i for i, v in enumerate(dict.fromkeys(wanted))}
                    codes = np.array([-1 if v is None else numbers.get(v, -1) for v in column])
                    for q, v in enumerate(wanted):
                        if v is not None:
                            order[q, codes != numbers[v]] = -np.inf
                best.add(scores, order, ids)
        for q, rows_of in zip(batch_of.query_ids, best.held):
            if rows_of is not None:
                n = len(rows_of[0])
                yield pa.RecordBatch.from_arrays([pa.array([q] * n), pa.array(rows_of[2].tolist()), pa.array(rows_of[1])], ["query_id", "chunk_id", "score"])

    slim = rows.select("chunk_id", "terms", "weights", *columns)
    if not isinstance(kind, T.StringType):
        slim = slim.withColumn("chunk_id", slim["chunk_id"].cast("long"))
    wire = "string" if isinstance(kind, T.StringType) else "long"
    found = slim.mapInArrow(run, f"query_id {query_kind}, chunk_id {wire}, score double")
    return found.withColumn("chunk_id", found["chunk_id"].cast(kind))


def sums(rows: DataFrame, sent: Batch) -> DataFrame:
    """``query_id, chunk_id, score`` of every query and every row that shares a term with it."""
    shipped = rows.sparkSession.sparkContext.broadcast(vars(sent))
    query_kind = "string" if sent.query_ids and isinstance(sent.query_ids[0], str) else "long"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        batch_of = SimpleNamespace(**shipped.value)
        names = np.array(batch_of.query_ids)
        for batch in batches:
            for ids, scores, shared, _ in _chunks(batch, batch_of, ()):
                q, d = np.nonzero(shared)
                yield pa.RecordBatch.from_arrays([pa.array(names[q].tolist()), pa.array(ids[d].tolist()), pa.array(scores[q, d])], ["query_id", "chunk_id", "score"])

    return rows.select("chunk_id", "terms", "weights").mapInArrow(run, f"query_id {query_kind}, chunk_id {dict(rows.dtypes)['chunk_id']}, score double")
