"""Nearest neighbours and whitening against plain numpy."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from corpusloom.llm import nearest as near
from corpusloom.llm import whitening

SCHEMA = "vec_id long, embedding array<float>, cell int, dims string, side int"


def frame(spark, rows):
    return spark.createDataFrame([(i, None if v is None else [None if x is None else float(x) for x in v], 1, "x", 9) for i, v in rows], SCHEMA)


def brute(queries, rows, k):
    out = []
    sound = [(i, np.array(v, dtype=np.float32).astype(float)) for i, v in rows if i is not None and v and all(x is not None and np.isfinite(x) for x in v) and any(v)]
    for q, _ in [r for r in queries if r[0] is not None]:
        for qi, qv in [s for s in sound if s[0] == q][:1]:
            far = sorted((float(near.distances(qv[None], v[None])[0]), i) for i, v in sound if i != qi and len(v) == len(qv))
            out += [(qi, n + 1, i, d) for n, (d, i) in enumerate(far[:k])]
    return sorted(out)


def rows_of(seed, n=400, dims=20):
    draw = np.random.default_rng(seed)
    x = draw.standard_normal((n, dims)).astype(np.float32)
    x[n // 3 : 2 * n // 3] = x[0]  # one vector a third of all rows
    x[-20:] *= 1e-3
    x[-25:-20] *= 1e6
    rows = [(int(i), v.tolist()) for i, v in enumerate(x)]
    return rows + [(1000, None), (1100, []), (1200, [0.0] * dims), (1300, [None] + [1.0] * (dims - 1)), (1400, [float("nan")] * dims), (1500, [float("inf")] + [0.0] * (dims - 1)), (None, [1.0] * dims), (1600, [1.0] * 3), (1700, [2.0] * 3)]


@pytest.mark.parametrize("cells", [(1 << 22, 1 << 25), (60, 800)])
def test_nearest_is_exact(spark, cells):
    rows = rows_of(1)
    table = frame(spark, rows)
    asked = table.where(F.col("vec_id") % 100 == 0)
    got = near.nearest(asked, table, 10, group_cells=cells[0], share_cells=cells[1]).collect()
    assert sorted(map(tuple, got)) == brute([r for r in rows if r[0] is not None and r[0] % 100 == 0], rows, 10)


def test_nearest_few_and_repeated_rows(spark):
    rows = [(100, [1, 0]), (1, [0, 1]), (1, [0, 1]), (2, [1, 1])]
    table = frame(spark, rows)
    got = near.nearest(table.where("vec_id = 100"), table, 10).collect()
    assert sorted(map(tuple, got)) == [(100, 1, 2, 1.0), (100, 2, 1, 2**0.5), (100, 3, 1, 2**0.5)]
    asked = frame(spark, [(100, [1, 0]), (100, [0, 2])])  # one id, two queries: each is searched
    got = near.nearest(asked, table, 1).collect()
    assert sorted(map(tuple, got)) == [(100, 1, 1, 1.0), (100, 1, 2, 1.0)]
    empty = table.where("false")
    assert near.nearest(empty, table).count() == near.nearest(table, empty).count() == near.nearest(empty, empty).count() == 0


def test_huge_components_still_have_ten_neighbours(spark):
    rows = [(i, [3e38 * (-1) ** i, float(i)]) for i in range(0, 30)]
    table = frame(spark, rows)
    got = near.nearest(table.where("vec_id = 0"), table).collect()
    assert sorted(map(tuple, got)) == brute(rows[:1], rows, 10)


def test_bounds_hold_and_few_pairs_are_measured():
    draw = np.random.default_rng(5)
    for scale in (1.0, 1e-30, 1e30):
        a, b = (draw.standard_normal((n, 1500)) * scale for n in (50, 2000))
        b[:50] = a + 1e-9 * scale
        low, high = near.distance_bounds(near._Codes(a), near._Codes(b))
        true = np.linalg.norm(a[:, None] - b[None], axis=2)
        assert (low <= true * (1 + 1e-12)).all() and (high >= true * (1 - 1e-12)).all()
    a, b = draw.standard_normal((64, 32)), draw.standard_normal((20_000, 32))
    heaps = near._Heaps(np.arange(64) + 10**6, near._Codes(a), 10)
    seen, measured = heaps.take(np.arange(20_000), b)
    assert seen == 64 * 20_000 and measured < 0.02 * seen
    codes = draw.integers(-127, 128, (30, 3000)).astype(np.int8)
    assert (near.products(codes, codes) == codes.astype(np.int64) @ codes.astype(np.int64).T).all()


def whitened(spark, rows, components, guard=whitening.GUARD):
    got = whitening.whiten(frame(spark, rows), components, guard).toPandas()
    sound = [(i, np.array(v, dtype=np.float32).astype(float)) for i, v in rows if v and all(x is not None and np.isfinite(x) for x in v)]
    x = np.floor(64 * np.array([v for _, v in sound])).astype(np.int64) + 1_000_000
    return got, [i for i, _ in sound], x


def test_whitening_matches_a_dense_solver(spark):
    draw = np.random.default_rng(3)
    turn, _ = np.linalg.qr(draw.standard_normal((90, 90)))
    x = draw.standard_normal((700, 90)) * (4 * 0.95 ** np.arange(90)) @ turn  # the block of 12 + 8 is filtered out of 90
    rows = [(i, v) for i, v in enumerate(x.tolist())] + [(7, x[7].tolist()), (None, x[8].tolist()), (900, None), (901, []), (902, [None] * 90), (903, [float("inf")] * 90), (904, [0.0] * 90)]
    got, ids, x = whitened(spark, rows, 12, 8)
    n, sums = len(x), x.sum(axis=0)
    c = (x * n - sums) / n
    values, vectors = np.linalg.eigh(c.T @ c / n)
    values, vectors = values[::-1], vectors[:, ::-1]
    want = c @ vectors[:, :12] / np.sqrt(values[:12])
    assert len(got) == n * 12 and set(got.n) == {n} and got.identity_error.max() < 1e-10
    assert np.allclose(got.groupby("component").explained.first(), values[:12] / values.sum(), rtol=1e-12)
    mine = {(None if v != v else int(v), int(k)): w for v, k, w in zip(got.vec_id, got.component, got.whitened)}
    for k in range(1, 13):
        column = np.array([mine[i, k] for i in ids])
        assert min(np.abs(column - want[:, k - 1]).max(), np.abs(column + want[:, k - 1]).max()) < 1e-9
    far = dict(zip(ids, np.square(x * n - sums).sum(axis=1).tolist()))
    assert all(far[None if v != v else int(v)] == d for v, d in zip(got.vec_id, got.deviation))


def test_whitening_of_flat_low_rank_and_trivial_tables(spark):
    draw = np.random.default_rng(4)
    flat = [(i, v) for i, v in enumerate(draw.standard_normal((300, 40)).tolist())]  # hardly any gap
    got, _, x = whitened(spark, flat, 10, 6)
    c = x - x.mean(axis=0)
    values = np.linalg.eigvalsh(c.T @ c / len(x))[::-1]
    assert np.allclose(got.groupby("component").explained.first(), values[:10] / values.sum(), rtol=1e-10)
    low = [(i, [a, b, 0.0, 0.0, 1.0]) for i, (a, b) in enumerate(draw.standard_normal((50, 2)).tolist())]
    got, _, _ = whitened(spark, low, 4, 0)
    assert set(got.component) == {1, 2} and got.identity_error.max() < 1e-10
    for rows in ([], [(1, [1.0, 2.0])], [(1, [1.0]), (2, [1.0])], [(1, None)]):
        assert whitening.whiten(frame(spark, rows)).count() == 0
    with pytest.raises(ValueError):
        whitening.whiten(frame(spark, [(1, [1.0]), (2, [1.0, 2.0])]))


def test_leading_counts_passes_and_skips_no_eigenvalue():
    draw = np.random.default_rng(6)
    for spectrum in (np.linspace(1, 2, 200), 0.9 ** np.arange(200.0), np.repeat([5.0, 1.0], 100), np.concatenate([[1e6], np.linspace(1, 1.5, 199)])):
        turn, _ = np.linalg.qr(draw.standard_normal((200, 200)))
        v = turn @ np.diag(spectrum) @ turn.T
        calls = []
        values, vectors = whitening.leading(lambda q: calls.append(1) or v @ q, 200, 16)
        assert np.allclose(values, np.sort(spectrum)[::-1][:16], rtol=1e-11)
        assert np.abs(v @ vectors - vectors * values).max() < 1e-12 * spectrum.max()
        assert len(calls) < 400
