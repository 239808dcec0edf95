"""Whitening by Chebyshev-filtered subspace iteration over distributed passes.

The covariance V is never formed. A pass sums Xc'(Xc Q) over all rows, where Xc is centred; each task adds up its blocks of rows and
the small sums (dimensions x block width) are added in a fixed order.

1. Rayleigh-Ritz: a pass gives VQ, and the eigenvectors of Q'VQ turn Q into Ritz vectors with Ritz values.
2. The norm of Vq - eq of each wanted vector certifies it: an eigenvalue lies that near, and the vector is as near as that norm
   over the gap. All wanted ones at rounding level: done.
3. Otherwise a Chebyshev polynomial of V, by its three-term recurrence, one pass a step, is applied to the vectors that are not
   settled. It stays within 1 on [0, smallest Ritz value], the unwanted spectrum, and grows fast above. QR, and again from 1.

The block is wider than what is wanted, so the vectors next in line shield the last wanted ones.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import persist_to_shared, utf8_buffer

#: Vectors of the block beyond the wanted ones; greatest growth of one filter, so that QR keeps the digits of the smallest.
GUARD, GROWTH = 24, 1e9
#: Steps of one filter and filters at most; a spectrum that isn't settled by then is an error, not a guess.
DEGREE, CYCLES = 24, 400
#: Bytes of a stored block, so that an Arrow batch of 10,000 stays small; rows worked on together; bytes of partial sums that the
#: driver takes directly.
BLOCK_BYTES, TILE_ROWS, DIRECT_BYTES = 8 << 10, 4096, 32 << 20
#: Entries that a double, times 64 and floored, still holds exactly.
LARGEST = 2.0**46

BLOCKS = "ids array<long>, x binary, dims int"


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows packed as matrices of 64-bit whole numbers, one row a block and length of vectors."""

    def pack(ids: pa.Array, x: np.ndarray, dims: int) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([ids.to_pylist()], pa.list_(pa.int64())), pa.array([x.tobytes()], pa.binary()), pa.array([dims], pa.int32())], ["ids", "x", "dims"])

    for batch in batches:
        lengths = np.asarray(batch.column("dims"))
        for dims in np.unique(lengths):
            part = batch.filter(pa.array(lengths == dims))
            step = max(1, BLOCK_BYTES // (8 * int(dims)))
            for a in range(0, part.num_rows, step):
                rows = part.slice(a, step)
                c = rows.column("vector").flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(rows.num_rows, dims)
                if np.abs(c).max() >= LARGEST:
                    raise OverflowError("an embedding entry is too large to be whitened exactly")
                yield pack(rows.column("id"), np.floor(64 * c).astype(np.int64) + 1_000_000, int(dims))


def _tiles(batch: pa.RecordBatch, rows: int = TILE_ROWS) -> Iterator[np.ndarray]:
    """The matrix that the blocks of a batch form together, ``rows`` rows at a time."""
    if batch.num_rows:
        x = np.frombuffer(utf8_buffer(batch.column("x"))[0], np.int64).reshape(-1, batch.column("dims")[0].as_py())
        for a in range(0, len(x), rows):
            yield x[a : a + rows]


class Passes:
    """Sums over all rows: a task yields one partial sum; they are added in the order of the tasks."""

    def __init__(self, blocks: DataFrame) -> None:
        self.blocks, self.count = blocks, 0
        self.tasks = blocks.rdd.getNumPartitions()

    def sum(self, one, kind: type = np.float64) -> np.ndarray | None:
        """The sum of ``one(x)`` over the blocks. Few or small partial sums go straight to the driver, others in groups first."""
        self.count += 1

        def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            from pyspark import TaskContext

            total = None
            for batch in batches:
                for x in _tiles(batch):
                    add = one(x)
                    total = add if total is None else total + add
            if total is not None:
                yield pa.RecordBatch.from_arrays([pa.array([TaskContext.get().partitionId()], pa.int32()), pa.array([total.tobytes()], pa.binary()), pa.array([total.nbytes], pa.int64())], ["part", "total", "size"])

        def added(table: pa.Table) -> pa.Table:
            order = np.argsort(table.column("part").to_numpy())
            values = table.column("total").take(pa.array(order)).to_pylist()
            total = np.sum([np.frombuffer(v, kind) for v in values], axis=0, dtype=kind)
            return pa.table({"part": pa.array([table.column("part")[int(order[0])].as_py()], pa.int32()), "total": pa.array([total.tobytes()], pa.binary()), "size": pa.array([total.nbytes], pa.int64())})

        sums = self.blocks.mapInArrow(part, "part int, total binary, size long")
        if self.tasks * self.width * 8 > DIRECT_BYTES:
            fan = max(2, math.isqrt(self.tasks))
            sums = sums.groupBy(F.pmod("part", F.lit(fan))).applyInArrow(added, sums.schema)
        rows = sorted((r["part"], bytes(r["total"])) for r in sums.select("part", "total").collect())
        return np.sum([np.frombuffer(v, kind) for _, v in rows], axis=0, dtype=kind) if rows else None

    width = 1


def centred(x: np.ndarray, n: int, sums: np.ndarray) -> np.ndarray:
    """x - S/n, from whole numbers, so nothing cancels."""
    return (x * n - sums) / n


def leading(times, dims: int, wanted: int, guard: int = GUARD, seed: int = 7) -> tuple[np.ndarray, np.ndarray]:
    """Largest eigenvalues, falling, and eigenvectors of a positive semidefinite matrix of which only products ``times(Q)`` are known."""
    width = min(dims, wanted + guard)
    q, _ = np.linalg.qr(np.random.default_rng(seed).standard_normal((dims, width)))
    best, idle = math.inf, 0
    for _ in range(CYCLES):
        z = times(q)
        h = q.T @ z
        values, turn = np.linalg.eigh((h + h.T) / 2)
        values, turn = values[::-1], turn[:, ::-1]
        q, z = q @ turn, z @ turn
        top = max(values[0], 0.0)
        if top == 0:
            return values[:0], q[:, :0]
        rest = np.linalg.norm(z - q * values, axis=0)
        held = min(wanted, width)
        goal = 4 * np.finfo(float).eps * math.sqrt(dims) * top
        worst = rest[:held].max()
        idle = 0 if worst < best / 2 else idle + 1
        best = min(best, worst)
        if worst <= goal or (worst <= 100 * goal and idle >= 2):
            keep = values[:held] > 1e-12 * top  # a direction without spread has no unit variance
            return values[:held][keep], q[:, :held][:, keep]
        low = values[-1]
        if width == dims or low <= 1e-12 * top:
            q, _ = np.linalg.qr(z + 1e-16 * top * q)  # the block holds all that is left: a plain power step settles it
            continue
        settled = min(int(np.argmax(rest > goal)) if (rest > goal).any() else width, held)
        done = q[:, :settled]
        clear = lambda y: y - done @ (done.T @ y)  # noqa: E731  rounding would bring the settled vectors back, much enlarged
        if idle >= 2:
            low *= 0.8  # a cluster wider than the block: the edge is set below it, else nothing would grow
        # as many steps as keep the growth of the largest within bounds, 2 at least
        rate = math.acosh(max(2 * values[settled] / low - 1, 1 + 1e-9))
        steps = int(min(DEGREE, max(2, math.log(2 * GROWTH) // rate)))
        before, now = q[:, settled:], clear((2 / low) * z[:, settled:] - q[:, settled:])
        for _ in range(steps - 1):
            before, now = now, clear(2 * ((2 / low) * times(now) - now) - before)
        now = clear(now / np.linalg.norm(now, axis=0))
        fresh, _ = np.linalg.qr(now)
        q = np.concatenate([done, fresh], axis=1)
    raise RuntimeError("the leading eigenvectors could not be certified")


WHITENED = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"


def whiten(rows: DataFrame, components: int = 32, guard: int = GUARD, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """``vec_id, component, n, deviation, whitened, explained, identity_error`` of every row and leading component.

    Entries c become x = floor(64 c) + 1,000,000; components are the eigenvectors of the covariance of x (divisor n), numbered
    from 1 by falling eigenvalue. Rows whose vector is null or empty or holds null or non-finite entries are left out; zero
    vectors, repeated rows and rows with a null id stay and count. Directions without spread have no component, so equal rows,
    or a single one, give none. No rows give none. Entries of 2 to the 46th or more, vectors of different lengths and
    deviations beyond a long are errors. Other columns are ignored.
    """
    spark = rows.sparkSession
    vector = F.col(vector_col)
    fine = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    clean = rows.select(F.col(id_col).cast("long").alias("id"), vector.alias("vector"), F.size(vector).alias("dims")).where(F.coalesce(fine, F.lit(False)) & (F.size(vector) > 0))
    blocks = persist_to_shared(clean.mapInArrow(_blocks, BLOCKS), "whitening-blocks")
    lengths = [r["dims"] for r in blocks.groupBy("dims").count().limit(2).collect()]
    if not lengths:
        return spark.createDataFrame([], WHITENED)
    if len(lengths) > 1:
        raise ValueError("vectors differ in length")
    dims, passes = lengths[0], Passes(blocks)
    first = passes.sum(lambda x: np.concatenate([[len(x)], x.sum(axis=0)]).astype(np.int64), np.int64)
    n, sums = int(first[0]), first[1:]
    spread = passes.sum(lambda x: np.square(centred(x, n, sums)).sum(axis=0))
    trace = spread.sum() / n

    def times(q: np.ndarray) -> np.ndarray:
        def one(x: np.ndarray) -> np.ndarray:
            c = centred(x, n, sums)
            return (c.T @ (c @ q)).ravel()

        passes.width = q.size
        return passes.sum(one).reshape(q.shape) / n

    values, vectors = leading(times, dims, components, guard)
    kept = len(values)
    if not kept:
        return spark.createDataFrame([], WHITENED)
    project = vectors / np.sqrt(values)

    def moments(x: np.ndarray) -> np.ndarray:
        w = centred(x, n, sums) @ project
        return np.concatenate([w.sum(axis=0), (w.T @ w).ravel()])

    passes.width = kept * (kept + 1)
    both = passes.sum(moments) / n
    mean, second = both[:kept], both[kept:].reshape(kept, kept)
    off = float(np.abs(second - np.outer(mean, mean) - np.eye(kept)).max())
    explained = values / trace

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, at = batch.column("ids").flatten(), 0
            for x in _tiles(batch, 1024):
                m, far = len(x), x * n - sums
                if np.square(far.astype(np.float64)).sum(axis=1).max() >= 2.0**63 * (1 - 1e-9):
                    raise OverflowError("a deviation does not fit in a long")
                yield pa.RecordBatch.from_arrays(
                    [ids.slice(at, m).take(pa.array(np.repeat(np.arange(m), kept))), pa.array(np.tile(np.arange(1, kept + 1, dtype=np.int32), m)), pa.array(np.full(m * kept, n, np.int64)),
                     pa.array(np.repeat(np.square(far).sum(axis=1), kept)), pa.array((centred(x, n, sums) @ project).ravel()), pa.array(np.tile(explained, m)), pa.array(np.full(m * kept, off))],
                    ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"],
                )
                at += m

    return blocks.mapInArrow(emit, WHITENED)
