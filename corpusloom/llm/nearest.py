"""Nearest neighbours by a block matrix join: int8 product tiles bound every distance, survivors are measured in doubles.

1. Queries are cut into groups, candidates into shares of about equal size. A cell of the grid is one group against one share; a
   share is dealt by row number, so no id or repeated vector can fill a cell of its own.
2. In a cell the queries are held, the candidates stream by. Both are quantised to 8 bits a component, with one scale a
   vector. Products of such codes are whole numbers, which float32 products of up to 1,024 dimensions hold exactly.
3. The distance of two quantised vectors is off by at most the lengths of the two quantisation errors (triangle inequality), so
   a tile of products gives a lower and an upper bound for every pair. Pairs whose lower bound is beyond the k-th upper bound of
   their query, or beyond its k-th best distance so far, can't be among its k nearest.
4. The others are measured on the original vectors and go to the query's heap of k.
5. Each cell returns a sorted run of at most k for each query; the runs of a query are merged by a heap.

Nothing is left out by a guess: the result is exact.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import persist_to_shared, whole_runs

#: Components of the queries of a group, and of the candidates of a share (a share is also at least one of each core).
GROUP_CELLS, SHARE_CELLS = 1 << 22, 1 << 25
#: Queries and pairs of a tile.
TILE_QUERIES, TILE_PAIRS = 2048, 1 << 19
#: Dimensions whose 8-bit products add up exactly in float32: 1,024 x 127 x 127 < 2 to the 24th.
EXACT_DIMS = 1024


def sound(vector: Column) -> Column:
    """True for vectors that are neither null, empty nor zero, with finite components only."""
    fine = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce(fine & F.exists(vector, lambda x: x != 0), F.lit(False))


class _Codes:
    """Vectors with 8-bit codes, scales, squared lengths of the quantised vectors and lengths of the errors."""

    def __init__(self, rows: np.ndarray) -> None:
        self.rows = rows
        top = np.abs(rows).max(axis=1)
        self.scale = np.where(top > 0, top, 1.0) / 127.0
        self.codes = np.rint(rows / self.scale[:, None]).astype(np.int8)
        back = self.codes * self.scale[:, None]
        with np.errstate(over="ignore", invalid="ignore"):
            self.square = np.einsum("ij,ij->i", back, back)
            self.error = np.sqrt(np.einsum("ij,ij->i", rows - back, rows - back)) * (1 + 1e-9)

    def cut(self, a: int, b: int) -> "_Codes":
        part = object.__new__(_Codes)
        part.__dict__ = {k: v[a:b] for k, v in self.__dict__.items()}
        return part


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact products of 8-bit codes, by float32 products of blocks of dimensions."""
    out = np.zeros((len(a), len(b)))
    for i in range(0, a.shape[1], EXACT_DIMS):
        out += a[:, i : i + EXACT_DIMS].astype(np.float32) @ b[:, i : i + EXACT_DIMS].astype(np.float32).T
    return out


def distance_bounds(q: _Codes, c: _Codes) -> tuple[np.ndarray, np.ndarray]:
    """Lower and upper bounds of all distances of a tile. Where squares overflow, the bounds are NaN and prove nothing."""
    with np.errstate(over="ignore", invalid="ignore"):
        size = q.square[:, None] + c.square[None, :]
        square = size - 2 * (products(q.codes, c.codes) * (q.scale[:, None] * c.scale[None, :]))
        slack = 1e-13 * size  # rounding of the line above
        off = q.error[:, None] + c.error[None, :]
        return np.sqrt(np.maximum(square - slack, 0)) - off, np.sqrt(np.maximum(square + slack, 0)) + off


def distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Euclidean distances of row pairs, added up in the order of the components."""
    total = np.zeros(len(a))
    with np.errstate(over="ignore"):
        for j in range(a.shape[1]):
            step = a[:, j] - b[:, j]
            total += step * step
    return np.sqrt(total)


class _Heaps:
    """The k nearest of each query so far: heaps of (-distance, -id), so the worst is on top."""

    def __init__(self, ids: np.ndarray, vectors: _Codes, k: int) -> None:
        self.ids, self.vectors, self.k = ids, vectors, k
        self.heaps: list[list[tuple[float, int]]] = [[] for _ in ids]
        self.worst = np.full(len(ids), np.inf)

    def take(self, ids: np.ndarray, rows: np.ndarray) -> tuple[int, int]:
        """Look at candidates; returns how many pairs there were and how many were measured."""
        seen = measured = 0
        candidates = _Codes(rows)
        for a in range(0, len(self.ids), TILE_QUERIES):
            mine = self.vectors.cut(a, a + TILE_QUERIES)
            step = max(1, TILE_PAIRS // len(mine.rows))
            for b in range(0, len(ids), step):
                measured += self._tile(a, mine, ids[b : b + step], candidates.cut(b, b + step))
                seen += len(mine.rows) * len(ids[b : b + step])
        return seen, measured

    def _tile(self, a: int, mine: _Codes, ids: np.ndarray, theirs: _Codes) -> int:
        own = self.ids[a : a + len(mine.rows), None] == ids[None, :]
        low, high = distance_bounds(mine, theirs)
        limit = self.worst[a : a + len(mine.rows)].copy()
        high[own | np.isnan(high)] = np.inf
        if len(ids) > self.k:
            limit = np.minimum(limit, np.partition(high, self.k - 1, axis=1)[:, self.k - 1])
        i, j = np.nonzero(~(low > limit[:, None]) & ~own)
        for start in range(0, len(i), TILE_PAIRS // 8):  # differences of so many pairs are open together
            self._measure(a, mine, ids, theirs, i[start : start + TILE_PAIRS // 8], j[start : start + TILE_PAIRS // 8])
        return len(i)

    def _measure(self, a: int, mine: _Codes, ids: np.ndarray, theirs: _Codes, i: np.ndarray, j: np.ndarray) -> None:
        far = distances(mine.rows[i], theirs.rows[j])
        fit = far <= self.worst[a + i]
        i, j, far = i[fit], j[fit], far[fit]
        order = np.lexsort((ids[j], far, i))
        i, j, far = i[order], j[order], far[order]
        first = np.searchsorted(i, i)  # only the k nearest of each query of this tile can matter
        fit = np.arange(len(i)) - first < self.k
        for q, v, d in zip((a + i[fit]).tolist(), ids[j[fit]].tolist(), far[fit].tolist()):
            heap = self.heaps[q]
            if len(heap) < self.k:
                heapq.heappush(heap, (-d, -v))
            else:
                heapq.heappushpop(heap, (-d, -v))
            if len(heap) == self.k:
                self.worst[q] = -heap[0][0]

    def runs(self) -> list[list[tuple[float, int]]]:
        return [sorted((-d, -v) for d, v in heap) for heap in self.heaps]


def _matrix(column: pa.Array) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(column), -1)


RUNS = "qno long, query_id long, far array<double>, ids array<long>"


def _search(k: int):
    """Cells sorted by (cell, dims), queries (side 0) first."""

    def close(qno: list[int], best: _Heaps) -> pa.RecordBatch:
        runs = best.runs()
        return pa.RecordBatch.from_arrays(
            [pa.array(qno, pa.int64()), pa.array(best.ids, pa.int64()), pa.array([[d for d, _ in r] for r in runs], pa.list_(pa.float64())), pa.array([[v for _, v in r] for r in runs], pa.list_(pa.int64()))],
            ["qno", "query_id", "far", "ids"],
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cell, held, best = None, [], None
        for batch in batches:
            if not batch.num_rows:
                continue
            keys = np.stack([np.asarray(batch.column(c)) for c in ("cell", "dims", "side")], 1)
            cuts = [0, *(np.flatnonzero((keys[1:] != keys[:-1]).any(1)) + 1).tolist(), len(keys)]
            for a, b in zip(cuts, cuts[1:]):
                key, side, part = tuple(keys[a, :2].tolist()), int(keys[a, 2]), batch.slice(a, b - a)
                if key != cell:
                    if best is not None:
                        yield close(qno, best)
                    cell, held, best = key, [], None
                if side == 0:
                    held.append(part)
                    continue
                if held:
                    whole = pa.Table.from_batches(held).combine_chunks()
                    qno = whole.column("qno").to_pylist()
                    best, held = _Heaps(whole.column("id").to_numpy(), _Codes(_matrix(whole.column("vector").chunk(0))), k), []
                if best is not None:
                    best.take(part.column("id").to_numpy(), _matrix(part.column("vector")))
        if best is not None:
            yield close(qno, best)

    return run


def _merge(k: int):
    """Sorted runs of a query, whole queries together, become its k nearest."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in whole_runs(batches, ["qno"]):
            rows: dict[int, list] = {}
            for qno, query_id, far, ids in zip(*(table.column(c).to_pylist() for c in ("qno", "query_id", "far", "ids"))):
                rows.setdefault(qno, [query_id]).append(zip(far, ids))
            out = []
            for query_id, *runs in rows.values():
                for rank, (d, v) in zip(range(1, k + 1), heapq.merge(*runs)):
                    out.append((query_id, rank, v, d))
            kinds = (pa.int64(), pa.int32(), pa.int64(), pa.float64())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out) if out else [()] * 4, kinds)], ["query_id", "rank", "vec_id", "score"])

    return run


def nearest(queries: DataFrame, candidates: DataFrame, k: int = 10, id_col: str = "vec_id", vector_col: str = "embedding", group_cells: int = GROUP_CELLS, share_cells: int = SHARE_CELLS) -> DataFrame:
    """``query_id, rank, vec_id, score``: the ``k`` nearest candidates of each query by Euclidean distance, nearest first.

    Ties go to the smaller id. Candidates with the query's own id are left out. Vectors that are null, empty or zero, or hold
    null or non-finite components, take no part, nor do rows without an id, which no result could name. Vectors of different
    lengths are never compared. Repeated candidate rows count as often as they stand there; a repeated query row is searched
    again. A query with fewer than ``k`` candidates gets all of them. Other columns are ignored; empty tables give no rows.
    Distances are added up component by component in doubles; one that overflows is infinite and ranks last.
    """
    spark = candidates.sparkSession

    def clean(df: DataFrame) -> DataFrame:
        rows = df.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).alias("vector"))
        return rows.where(F.col("id").isNotNull() & sound(F.col("vector"))).withColumn("dims", F.size("vector"))

    # numbered once and written: the numbers stay when a task runs again
    asked = persist_to_shared(clean(queries).withColumn("qno", F.monotonically_increasing_id()), "nearest-queries")
    size = asked.agg(F.sum("dims").alias("cells")).first()["cells"] or 0
    groups = max(1, -(-size // group_cells))
    rows = persist_to_shared(clean(candidates).withColumn("no", F.monotonically_increasing_id()), "nearest-candidates")
    total = rows.agg(F.sum("dims").alias("cells")).first()["cells"] or 0
    shares = max(-(-total // share_cells), -(-spark.sparkContext.defaultParallelism // groups))

    def numbers(n: int) -> Column:
        return F.explode(F.sequence(F.lit(0), F.lit(n - 1)))

    group, share = F.pmod(F.xxhash64("qno"), F.lit(groups)), F.pmod(F.xxhash64("no"), F.lit(shares))
    left = asked.withColumn("other", numbers(shares)).select((group * shares + F.col("other")).cast("int").alias("cell"), F.lit(0).alias("side"), "dims", "id", "qno", "vector")
    right = rows.withColumn("other", numbers(groups)).select((F.col("other") * shares + share).cast("int").alias("cell"), F.lit(1).alias("side"), "dims", "id", F.lit(None).cast("long").alias("qno"), "vector")
    cells = left.unionByName(right).repartitionById(groups * shares, "cell").sortWithinPartitions("cell", "dims", "side")
    runs = cells.mapInArrow(_search(k), RUNS).where(F.size("ids") > 0)
    return runs.repartition("qno").sortWithinPartitions("qno").mapInArrow(_merge(k), "query_id long, rank int, vec_id long, score double")
