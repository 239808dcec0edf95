"""Phrase collocations against plain Python."""

import collections
import random
import re

import pytest
from pyspark.sql import functions as F

from corpusloom.llm import collocations as col


def brute(rows, top, least, longest, covered=80):
    f, total = collections.Counter(), collections.Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        folded = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", folded):
            w = re.findall(r"[^\x20\x09]+", piece)
            total[lang] += len(w)
            for k in range(1, longest + 1):
                f.update((lang, tuple(w[i : i + k])) for i in range(len(w) - k + 1))
    many = {p: a for p, a in f.items() if a >= least and len(p[1]) > 1}
    most = collections.Counter()
    for (lang, p), a in many.items():
        for m in range(2, len(p)):
            for i in range(len(p) - m + 1):
                most[lang, p[i : i + m]] = max(most[lang, p[i : i + m]], a)
    out = collections.defaultdict(list)
    for (lang, p), a in many.items():
        score, _, left, right = min((2_000_000 * a // (f[lang, p[:k]] + f[lang, p[k:]]), k, f[lang, p[:k]], f[lang, p[k:]]) for k in range(1, len(p)))
        if 100 * most[lang, p] < covered * a:
            out[lang].append((-score, -a, " ".join(p).encode(), left, right))
    return sorted((lang, n + 1, p.decode(), -a, left, right, total[lang], -score) for lang, found in out.items() for n, (score, a, p, left, right) in enumerate(sorted(found)[:top]))


def texts(seed, n=160):
    draw = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(12)] + ["É", "ß", "naïve", "\x1c", "Ab", "aB"]
    phrases = [[draw.choice(vocabulary) for _ in range(draw.randint(2, 6))] for _ in range(10)]
    rows = [(None, None), ("en", ""), ("en", " .,;\t\n"), (None, "a b a b a b a b a b"), ("xx", "only once"), ("en", "x" * 70_000 + " y " * 5)]
    for k in range(n):
        w = []
        for _ in range(draw.randint(1, 25)):
            w += draw.choice(phrases) if draw.random() < 0.5 else [draw.choice(vocabulary)]
            if draw.random() < 0.15:
                w.append(draw.choice(".,;:!?\n\r\x0b\x0c"))
        rows.append((draw.choice(["en", "en", "en", "de", None]), draw.choice([" ", "  ", "\t"]).join(w)))
    return rows + rows[10:30]


@pytest.mark.parametrize("top,least,longest", [(5, 4, 4), (40, 3, 4), (3, 5, 3), (10_000, 4, 4), (7, 4, 2)])
def test_collocations(spark, top, least, longest):
    rows = texts(top)
    table = spark.createDataFrame([(k, *r) for k, r in enumerate(rows)], "doc_id long, lang string, text string")
    table = table.withColumn("phrase", F.lit("p")).withColumn("n", F.lit(0)).withColumn("score", F.lit("s")).repartition(3)
    got = col.collocations(table, top, least, longest).select("lang", "rank", "phrase", "a", "l", "r", "n", "score").collect()
    assert sorted(map(tuple, got)) == brute(rows, top, least, longest)


def test_no_texts(spark):
    empty = spark.createDataFrame([], "lang string, text string")
    assert col.collocations(empty).count() == 0
    assert col.collocations(spark.createDataFrame([(None, None), ("en", "a b")], "lang string, text string")).count() == 0


def test_bound_is_admissible():
    draw = random.Random(2)
    for _ in range(2000):
        f1 = draw.randint(1, 50)
        fp = draw.randint(1, f1)
        a = draw.randint(1, fp)
        r = draw.randint(a, 60)
        assert 2_000_000 * a // (f1 + r) <= 2_000_000 * fp // (f1 + fp)
