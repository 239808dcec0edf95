"""Dense vector search and vector validation."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import persist_to_shared, shared_folder
from .lexical import top_k

#: Numbers of a group of queries that a tile holds (rows x dimensions).
QUERY_CELLS = 4_000_000
#: Scores a task computes in one product (queries x corpus rows).
SCORE_CELLS = 4_000_000


def _unit(rows) -> np.ndarray:
    m = np.asarray(rows if isinstance(rows, np.ndarray) and rows.dtype != object else np.stack(rows), dtype=np.float64)
    norm = np.linalg.norm(m, axis=1, keepdims=True)
    return m / np.where(norm == 0, 1.0, norm)


class _Best:
    """The k best documents of each query seen so far in one task."""

    def __init__(self, query_ids: np.ndarray, matrix: np.ndarray, filters: list[np.ndarray], k: int):
        self.query_ids, self.matrix, self.filters, self.k = query_ids, matrix, filters, k
        self.scores: list[np.ndarray] = [np.empty(0)] * len(query_ids)
        self.ids: list[np.ndarray] = [np.empty(0, dtype=object)] * len(query_ids)

    def add(self, ids: np.ndarray, vectors, columns: list[np.ndarray]) -> None:
        """Take in corpus rows, so many at a time that the product stays bounded."""
        if not len(self.query_ids):
            return
        step = max(1, SCORE_CELLS // len(self.query_ids))
        for start in range(0, len(ids), step):
            cut = slice(start, start + step)
            self._tile(ids[cut], vectors[cut], [c[cut] for c in columns])

    def _tile(self, ids: np.ndarray, vectors, columns: list[np.ndarray]) -> None:
        scores = np.round(self.matrix @ _unit(vectors).T, 10)
        for i in range(len(self.query_ids)):
            row, keep = scores[i], None
            for wanted, column in zip(self.filters, columns):
                if not pd.isna(wanted[i]):
                    same = column == wanted[i]
                    keep = same if keep is None else keep & same
            at = np.arange(len(row)) if keep is None else np.flatnonzero(keep)
            if len(at) > self.k:
                part = row[at]
                # Keep every row that ties with the k-th best; ids decide below.
                at = at[part >= np.partition(part, len(part) - self.k)[len(part) - self.k]]
            both = np.concatenate([self.scores[i], row[at]])
            names = np.concatenate([self.ids[i], ids[at]])
            order = np.lexsort((np.array(names.tolist()), -both))[: self.k] if len(both) else np.empty(0, dtype=np.int64)
            self.scores[i], self.ids[i] = both[order], names[order]

    def frame(self) -> pd.DataFrame:
        return pd.DataFrame(
            {
                "query_id": np.repeat(self.query_ids, [len(s) for s in self.scores]),
                "chunk_id": np.concatenate(self.ids) if len(self.ids) else [],
                "score": np.concatenate(self.scores) if len(self.scores) else [],
            }
        )


def vec_topk_dense(
    queries: DataFrame,
    corpus: DataFrame,
    k: int = 30,
    filters: Sequence[str] = (),
    where: Column | None = None,
    query_cells: int = QUERY_CELLS,
    shares: int | None = None,
) -> DataFrame:
    """Exact cosine top-k of ``(query_id, vector)`` over ``(chunk_id, vector)``.

    A block nested loop on the executors: queries are dealt to groups of about
    ``query_cells`` numbers, the corpus to ``shares``, and each (group, share)
    is one tile. The queries of a tile are held, its corpus rows stream past
    and only the k best of each query leave it, so no pair is ever a row. The
    corpus is read once whatever the number of queries, and no vector passes
    through the driver.
    """
    spark = corpus.sparkSession
    names = list(filters)
    kept = (corpus if where is None else corpus.filter(where)).select("chunk_id", "vector", *names)
    asked = queries.select("query_id", "vector", *names)
    size = asked.agg(F.sum(F.size("vector").cast("long")).alias("cells")).first()["cells"] or 0
    groups = max(1, -(-size // query_cells))
    width = max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    shares = shares or max(1, -(-width // groups))

    def every(n: int) -> Column:
        return F.explode(F.sequence(F.lit(0), F.lit(n - 1)))

    def number(key: str, n: int) -> Column:
        return F.pmod(F.xxhash64(key), F.lit(n)).cast("int")

    left = asked.withColumn("share", every(shares)).withColumn("tile", number("query_id", groups) * shares + F.col("share"))
    right = kept.withColumn("group", every(groups)).withColumn("tile", F.col("group") * shares + number("chunk_id", shares))
    found = _tiles(left, right, names, k, lambda rows: rows.repartitionById(groups * shares, "tile"))
    return top_k(found, k).select("query_id", "chunk_id", "score", "rank")


def _tiles(left: DataFrame, right: DataFrame, names: list[str], k: int, deal: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """The k best corpus rows of ``right`` for the queries of ``left`` that have the same ``tile``; ``deal`` brings tiles together."""
    id_types = dict(left.dtypes)["query_id"], dict(right.dtypes)["chunk_id"]
    vector = F.col("vector").cast("array<double>").alias("vector")
    asked = left.select("tile", F.lit(0).alias("side"), "query_id", F.lit(None).cast(id_types[1]).alias("chunk_id"), vector, *names)
    rows = right.select("tile", F.lit(1).alias("side"), F.lit(None).cast(id_types[0]).alias("query_id"), "chunk_id", vector, *names)

    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        tile, held, best = None, [], None
        for batch in batches:
            for (at, side), part in batch.groupby(["tile", "side"], sort=True):
                if at != tile:
                    if best is not None:
                        yield best.frame()
                    tile, held, best = at, [], None
                if side == 0:
                    held.append(part)
                    continue
                if best is None:
                    if not held:
                        continue
                    mine = pd.concat(held)
                    best = _Best(mine["query_id"].to_numpy(dtype=object), _unit(mine["vector"].to_numpy()), [mine[c].to_numpy(dtype=object) for c in names], k)
                best.add(part["chunk_id"].to_numpy(dtype=object), part["vector"].to_numpy(), [part[c].to_numpy(dtype=object) for c in names])
        if best is not None:
            yield best.frame()

    both = deal(asked.unionByName(rows)).sortWithinPartitions("tile", "side")
    return both.mapInPandas(scan, f"query_id {id_types[0]}, chunk_id {id_types[1]}, score double")


def dot(a: str, b: str) -> Column:
    return F.expr(
        f"aggregate(zip_with({a}, {b}, (x, y) -> cast(x as double) * cast(y as double)), 0D, (s, x) -> s + x)"
    )


def norm(a: str) -> Column:
    return F.sqrt(F.expr(f"aggregate({a}, 0D, (s, x) -> s + cast(x as double) * cast(x as double))"))


#: Rows that centroids are fitted on (those with the smallest hashes), and rows of a part of a large cell.
FIT_ROWS, PART_ROWS = 20_000, 50_000


@dataclass(frozen=True)
class InvertedFile:
    """Unit vectors stored by the cell of their nearest centroid."""

    rows: DataFrame  # chunk_id, vector, cell, far; stored, sorted by cell
    centroids: np.ndarray
    sizes: np.ndarray  # rows of a cell
    radii: np.ndarray  # its largest distance from the centroid

    @property
    def total(self) -> int:
        return int(self.sizes.sum())

    def parts(self) -> DataFrame:
        """``cell, parts``: one row a cell."""
        rows = [(i, max(1, -(-int(n) // PART_ROWS))) for i, n in enumerate(self.sizes)]
        return F.broadcast(self.rows.sparkSession.createDataFrame(rows, "cell int, parts int"))


def ivf_build(corpus: DataFrame, cells: int = 512, fit_rows: int = FIT_ROWS, seed: int = 42, folder: str | None = None) -> InvertedFile:
    """Fit ``cells`` centroids on at most ``fit_rows`` rows and store every vector under its nearest one.

    Centroids, sizes and radii are ``cells`` rows each, whatever the size of the corpus.
    """
    import uuid

    from pyspark.ml.clustering import KMeans
    from pyspark.ml.functions import array_to_vector

    spark = corpus.sparkSession
    length = norm("vector")
    unit = F.transform("vector", lambda x: F.when(length > 0, x.cast("double") / length).otherwise(0.0))
    rows = corpus.select("chunk_id", unit.alias("vector"))
    sample = persist_to_shared(rows.orderBy(F.xxhash64("chunk_id"), "chunk_id").limit(fit_rows).select(array_to_vector("vector").alias("features")), "ivf-sample")
    if sample.isEmpty():
        raise ValueError("an inverted file needs vectors")
    model = KMeans(k=cells, seed=seed, maxIter=10, initSteps=2).fit(sample)
    centres = np.array([np.asarray(c) for c in model.clusterCenters()])
    sent = spark.sparkContext.broadcast(centres)

    def assign(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if len(batch):
                far = _apart(np.stack(batch["vector"].to_numpy()), sent.value)
                yield batch.assign(cell=far.argmin(axis=1).astype(np.int32), far=far.min(axis=1))

    named = rows.mapInPandas(assign, f"chunk_id {dict(rows.dtypes)['chunk_id']}, vector array<double>, cell int, far double")
    # ranges of cells, with the hash behind it, so a large cell is cut too; files are sorted, so a filter on cells skips row groups
    path = f"{(folder or shared_folder(spark)).rstrip('/')}/ivf-{uuid.uuid4().hex}"
    laid = named.repartitionByRange("cell", F.xxhash64("chunk_id")).sortWithinPartitions("cell")
    laid.write.option("parquet.block.size", 16 << 20).option("parquet.page.row.count.limit", 1000).parquet(path)
    stored = spark.read.schema(named.schema).parquet(path)
    sizes, radii = np.zeros(len(centres), np.int64), np.zeros(len(centres))
    for r in stored.groupBy("cell").agg(F.count(F.lit(1)).alias("n"), F.max("far").alias("radius")).collect():
        sizes[r["cell"]], radii[r["cell"]] = r["n"], r["radius"]
    return InvertedFile(stored, centres, sizes, radii)


def _apart(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum((a * a).sum(1)[:, None] + (b * b).sum(1)[None] - 2 * a @ b.T, 0))


def vec_topk_ann(queries: DataFrame, index: InvertedFile, k: int = 30, first: float = 0.05, most: float | None = 0.18) -> tuple[DataFrame, DataFrame]:
    """Top-k over an inverted file, and how it went: ``query_id, share, certain``.

    A query reads its nearest cells until they hold ``first`` of all rows and at least ``k``. Vectors of another cell are no
    nearer than the distance of its centroid less its radius (triangle inequality), so cells that can't reach the k-th best
    are shut; the others are read in turn until they hold ``most`` of the rows (None: all of them, which is exact).
    ``share`` is the part of all pairs that were compared; ``certain`` queries have their exact result.
    """
    spark = index.rows.sparkSession
    sent = spark.sparkContext.broadcast((index.centroids, index.sizes, index.radii))
    kind = dict(queries.dtypes)["query_id"]

    def plan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        centres, sizes, radii = sent.value
        for batch in batches:
            for a in range(0, len(batch), 256):
                part = batch.iloc[a : a + 256]
                if not len(part):
                    continue
                far = _apart(_unit(part["vector"].to_numpy()), centres)
                order = np.argsort(far, axis=1, kind="stable")
                n = sizes[order]
                yield pd.DataFrame({
                    "query_id": np.repeat(part["query_id"].to_numpy(), len(centres)),
                    "cell": order.ravel().astype(np.int32), "n": n.ravel(), "before": (n.cumsum(axis=1) - n).ravel(),
                    "low": (np.take_along_axis(far, order, 1) - radii[order] - 1e-9).ravel(),
                })

    cells = persist_to_shared(queries.select("query_id", "vector").mapInPandas(plan, f"query_id {kind}, cell int, n long, before long, low double"), "ivf-plan")
    cells = cells.filter("n > 0")
    nearest = (F.col("before") < F.lit(int(first * index.total))) | (F.col("before") < k)

    def search(chosen: DataFrame) -> DataFrame:
        # the cells asked for are at most the number of centroids
        asked = [r["cell"] for r in chosen.select("cell").distinct().collect()]
        parts = index.parts()
        left = chosen.select("query_id", "cell").join(queries.select("query_id", "vector"), "query_id").join(parts, "cell")
        left = left.withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
        right = index.rows.filter(F.col("cell").isin(asked)).join(parts, "cell").withColumn("part", F.pmod(F.xxhash64("chunk_id"), F.col("parts")).cast("int"))
        number = (F.col("cell") * F.lit(1 << 20).cast("long") + F.col("part")).alias("tile")
        left, right = left.select(number, "query_id", "vector"), right.select(number, "chunk_id", "vector")
        return _tiles(left, right, [], k, lambda rows: rows.repartition("tile"))

    one = persist_to_shared(top_k(search(cells.filter(nearest)), k).select("query_id", "chunk_id", "score", "rank"), "ivf-first")

    def reach(found: DataFrame) -> DataFrame:
        """Each query's distance to its k-th best; no row where it has fewer."""
        return found.filter(F.col("rank") == k).select("query_id", F.sqrt(F.greatest(2 - 2 * F.col("score"), F.lit(0.0))).alias("reach"))

    def could(found: DataFrame) -> DataFrame:
        return cells.join(reach(found), "query_id", "left").filter(F.col("reach").isNull() | (F.col("low") <= F.col("reach")))

    room = F.lit(True) if most is None else F.col("before") < F.lit(int(most * index.total))
    second = persist_to_shared(could(one).filter(~nearest & room).select("query_id", "cell", "n", "before", "low"), "ivf-second")
    out = one.drop("rank").unionByName(search(second))
    out = persist_to_shared(top_k(out, k).select("query_id", "chunk_id", "score", "rank"), "ivf-found")
    read = cells.filter(nearest).unionByName(second)
    share = read.groupBy("query_id").agg((F.sum("n") / index.total).alias("share"))
    left_out = could(out).join(read.select("query_id", "cell"), ["query_id", "cell"], "left_anti").select("query_id").distinct().withColumn("open", F.lit(True))
    return out, share.join(left_out, "query_id", "left").select("query_id", "share", F.col("open").isNull().alias("certain"))


def query_vector_errors(queries: DataFrame, dims: int) -> DataFrame:
    bad = F.exists("vector", lambda x: F.isnan(x) | (F.abs(x) == float("inf")) | x.isNull())
    return queries.select(
        "query_id",
        F.when(F.size("vector") != dims, "dimension mismatch").when(bad, "vector is not finite").alias("error"),
    ).filter("error is not null")


def vec_validate(vectors: DataFrame, dims: int, allow_empty_sparse: bool = True) -> DataFrame:
    """First broken rule of each vector row; ``error`` is null when it is sound."""
    finite = ~F.exists("dense", lambda x: F.isnan(x) | (F.abs(x) == float("inf")) | x.isNull())
    size = norm("dense")
    idx, val = F.col("sparse.indices"), F.col("sparse.values")
    error = (
        F.when(F.size("dense") != dims, "dense dimension mismatch")
        .when(~finite, "dense vector is not finite")
        .when(~size.between(0.995, 1.005), "dense vector is not normalised")
        .when(F.size(idx) != F.size(val), "sparse indices and values differ in length")
        .when(F.size(F.array_distinct(idx)) != F.size(idx), "sparse indices repeat")
        .when(F.exists(idx, lambda x: x < 0), "sparse index is negative")
        .when(F.exists(val, lambda x: ~(x > 0)), "sparse value is not positive")
    )
    if not allow_empty_sparse:
        error = error.when(F.size(idx) == 0, "sparse vector is empty")
    return vectors.select("chunk_id", size.alias("norm"), error.alias("error"))
