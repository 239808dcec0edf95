"""Exact percentiles against sorted lists, and bounded plans."""

import math
import random

import pytest
from pyspark.sql import functions as F

from corpusloom.operators import evaluate, percentiles, quality


def nearest(values, q):
    return sorted(values)[max(math.ceil(round(len(values) * q, 6)) - 1, 0)]


def middle(values):
    s = sorted(values)
    return (s[(len(s) - 1) // 2] + s[len(s) // 2]) / 2


@pytest.mark.parametrize("gap", [3, 40, 10_000])
def test_against_sorted_lists(spark, monkeypatch, gap):
    monkeypatch.setattr(percentiles, "GAP_ROWS", gap)
    monkeypatch.setattr(percentiles, "POINTS", 5)
    draw = random.Random(gap)
    lists = {
        "flat": [draw.random() for _ in range(701)],
        "wide": [draw.choice([-1, 1]) * 10 ** draw.uniform(-300, 300) for _ in range(500)],
        "ties": [float(draw.choice([1, 1, 1, 2, 7])) for _ in range(400)],
        "one": [4.0],
        "same": [0.0] * 90,
        None: [float(i) for i in range(100)],
    }
    rows = [(k, v, -v) for k, vs in lists.items() for v in vs] + [("ties", None, None), ("empty", None, 1.0)]
    frame = spark.createDataFrame(rows, "k string, v double, w double")
    found = percentiles.exact_at(frame, ["v", "w"], percentiles.summary_indexes(), ["k"])
    got = {r["k"]["k"]: r for r in found.collect()}
    assert got["empty"]["v_low"] is None and got["empty"]["w_p95"] == 1.0
    for key, values in lists.items():
        assert (got[key]["v_low"] + got[key]["v_high"]) / 2 == middle(values)
        assert got[key]["v_p95"] == nearest(values, 0.95)
        assert got[key]["w_p95"] == nearest([-v for v in values], 0.95)


def test_a_million_values_under_one_key(spark):
    n = 1_000_000
    rows = spark.range(n).select(((F.col("id") * 7_919) % n).cast("double").alias("v"))
    assert quality.percentile_upper(rows, "v", 0.95).first()["v"] == math.ceil(round((n - 1) * 0.95, 6))
    summary = evaluate.latency_summary(rows, "v").first()
    assert (summary["median"], summary["p95"], summary["min"], summary["max"]) == ((n - 1) / 2, 949_999.0, 0.0, n - 1.0)


def test_plan_has_no_window_and_no_percentile_buffer(spark):
    rows = spark.range(50_000).select(F.rand(3).alias("v"), (F.col("id") % 3).alias("k"))
    plan = evaluate.latency_summary(rows, "v", ["k"])._jdf.queryExecution().toString().lower()
    assert "window" not in plan and "percentile" not in plan


def test_empty_tables(spark):
    none = spark.createDataFrame([], "k string, v double")
    assert quality.percentile_upper(none, "v", 0.95, ["k"]).collect() == []
    assert evaluate.latency_summary(none, "v", ["k"]).collect() == []
    row = evaluate.latency_summary(none, "v").first()
    assert row["median"] == 0.0 and row["p95"] == 0.0
    assert evaluate.latency_summary(none, "v", empty_zero=False).first()["median"] is None
