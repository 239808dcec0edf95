"""Packing folds against a plain loop, and their time on one very long run."""

import random
import time

import pytest
from pyspark.sql import functions as F

from corpusloom.operators import chunking


def greedy(sizes, limit):
    out, group, total = [], 1, 0
    for n in sizes:
        if total > 0 and total + n > limit:
            group, total = group + 1, 0
        total += n
        out.append(group)
    return out


def step(s, m):
    new = f"({s}.t > 0 and {s}.t + {m} > 50)"
    return {"g": f"if({new}, {s}.g + 1, {s}.g)", "t": f"if({new}, {m}, {s}.t + {m})"}


def numbers(spark, lists):
    rows = spark.createDataFrame([(x,) for x in lists], "sizes array<int>")
    return [r["g"] for r in rows.select(F.expr(chunking.group_numbers("sizes", {"g": "1", "t": "0"}, step)).alias("g")).collect()]


@pytest.mark.parametrize("n", [0, 1, 2, 255, 256, 257, 512, 1000])
def test_group_numbers(spark, n):
    draw = random.Random(n)
    lists = [[draw.randint(0, 60) for _ in range(n)] for _ in range(3)]
    assert numbers(spark, lists) == [greedy(x, 50) for x in lists]


def test_a_run_of_a_hundred_thousand(spark):
    """Four times the members take about four times as long, not sixteen."""
    draw = random.Random(1)
    long = [draw.randint(0, 60) for _ in range(400_000)]
    numbers(spark, [long[:1000]])
    spent = {}
    for n in (100_000, 400_000):
        start = time.time()
        assert numbers(spark, [long[:n]]) == [greedy(long[:n], 50)]
        spent[n] = time.time() - start
    assert spent[400_000] < 8 * spent[100_000] + 2


def test_long_text_is_cut_within_its_budget(spark):
    draw = random.Random(3)
    sentence = lambda: " ".join("söz%d" % draw.randint(0, 99) for _ in range(draw.randint(1, 60))).capitalize() + draw.choice(".;!?")
    texts = [" ".join(sentence().capitalize() for _ in range(40)) for _ in range(5)] + ["x " * 2000, "a, " * 900, "qısa mətn."]
    rows = spark.createDataFrame([(t, 10) for t in texts], "content string, prefix int")
    got = rows.select("content", chunking.split_to_limit("content", "prefix", 120).alias("s")).collect()
    for r in got:
        assert " ".join(r["s"]["parts"]).split() == r["content"].split()
        assert r["s"]["forced"] == (r["content"].startswith("x "))
    assert len(got[-1]["s"]["parts"]) == 1 and all(len(r["s"]["parts"]) > 5 for r in got[:-1])
