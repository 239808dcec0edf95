"""Exact, line and repeated-string removal against plain Python."""

import collections
import hashlib
import random
import re

from pyspark.sql import functions as F

from corpusloom.llm import suffix_dedup
from corpusloom.llm.exact_dedup import drop_duplicates, exact_dedup
from corpusloom.llm.line_dedup import host_of, html_lines, line_dedup

ROWS = [(5, "a b"), (3, "ab "), (9, "a\tb\n"), (4, None), (1, ""), (7, " \n"), (None, "ab"), (2, "c"), (2, "c"), (8, "é" * 50_000), (6, "é" * 50_000 + " ")]


def frame(spark, rows):
    """Rows with columns whose names the operators use themselves."""
    df = spark.createDataFrame(rows, "doc_id long, text string")
    return df.withColumn("hash", F.lit(1)).withColumn("n", F.lit("x")).withColumn("mark", F.lit(2)).withColumn("kept", F.lit(True))


def brute_exact(rows):
    groups = collections.defaultdict(list)
    for i, t in rows:
        groups[re.sub(r"[\x20\x09-\x0D]+", "", t or "")].append((-len(t or ""), i is None, i))
    out = []
    for i, t in rows:
        norm = re.sub(r"[\x20\x09-\x0D]+", "", t or "")
        keep = min(groups[norm], key=lambda x: (x[0], x[1], x[2] or 0))[2]
        out.append((i, keep, len(groups[norm]), i == keep, hashlib.sha256(norm.encode()).hexdigest()))
    return sorted(out, key=repr)


def test_exact_dedup(spark):
    got = exact_dedup(frame(spark, ROWS)).collect()
    assert sorted(map(tuple, got), key=repr) == brute_exact(ROWS)
    assert exact_dedup(frame(spark, [])).count() == 0


def test_exact_dedup_compares_bytes_when_hashes_collide(spark):
    got = exact_dedup(frame(spark, ROWS), hash128=lambda text: F.length(text)).collect()
    assert sorted(map(tuple, got), key=repr) == brute_exact(ROWS)


def test_drop_duplicates_keeps_one_row_of_each_text(spark):
    df = frame(spark, ROWS)
    kept = drop_duplicates(df)
    assert kept.columns == df.columns
    assert sorted(r.doc_id for r in kept.collect()) == [2, 6, 7, 9]


def test_drop_duplicates_keeps_the_longest_of_rows_that_repeat_an_id(spark):
    rows = [(1, "ab"), (1, "a  b"), (1, " ab "), (1, "a b"), (None, "ab"), (2, "x y"), (2, "x z"), (3, None), (3, " "), (None, "only"), (None, " only")]
    for order in (rows, rows[::-1]):
        kept = sorted(((r.doc_id, r.text) for r in drop_duplicates(frame(spark, order)).collect()), key=repr)
        assert [k for k in kept if k[0] != 1] == [(2, "x y"), (2, "x z"), (3, " "), (None, " only")]
        one = [t for i, t in kept if i == 1]
        assert len(one) == 1 and one[0] in ("a  b", " ab ")
        if order is rows:
            first = one
        assert one == first


def test_line_dedup(spark):
    pages = [(i, "http://A.example/x", f"<p>menu</p><p>own {i}</p><p>menu</p>") for i in range(5)]
    pages += [(10, "https://u@b.example:80/y", "<p>menu</p>"), (11, None, None), (12, "no address", ""), (13, "http://c.example", "<script>menu</script><b>x</b>")]
    df = spark.createDataFrame(pages, "page_id long, url string, html string").withColumn("host", F.lit("clash")).withColumn("lines", F.lit(0))
    got = {r.page_id: r for r in line_dedup(df, "page_id", host_of(F.col("url")), html_lines(F.coalesce("html", F.lit("")))).collect()}
    assert len(got) == len(pages)
    assert [(got[i].n_lines, got[i].n_dropped, got[i].text) for i in range(5)] == [(3, 2, f"own {i}") for i in range(5)]
    assert (got[10].host, got[10].text, got[11].host, got[11].text, got[13].text) == ("b.example", "menu", "", "", "x")


def brute_repeats(rows, length=suffix_dedup.LENGTH):
    seen, data = collections.Counter(), [(i, (t or "").encode()) for i, t in rows]
    for _, b in data:
        seen.update(b[p : p + length] for p in range(len(b) - length + 1))
    out = []
    for i, b in data:
        gone = bytearray(len(b))
        for p in range(len(b) - length + 1):
            if seen[b[p : p + length]] > 1:
                gone[p : p + length] = b"\1" * length
        spans = sum(1 for k in range(len(b)) if gone[k] and (k == 0 or not gone[k - 1]))
        out.append((i, len(b), sum(gone), spans, hashlib.sha256(bytes(x for x, g in zip(b, gone) if not g)).hexdigest()))
    return sorted(out, key=repr)


def repeat_rows(seed):
    draw = random.Random(seed)
    base = "".join(draw.choice("abcdefgh ") for _ in range(2500))
    rows = [(0, base), (1, None), (2, ""), (3, "a" * 900), (4, "ab" * 400), (5, "a" * 199), (None, base[100:299]), (6, base[:200]), (7, "z" + base[500:700]), (8, "é" * 300), (9, "é" * 150)]
    for k in range(10, 40):
        s = list(base)
        for _ in range(draw.randint(1, 25)):
            s[draw.randrange(len(s))] = draw.choice("abcdefgh ")
        a = draw.randrange(1200)
        rows.append((k, "".join(s)[a : a + draw.randint(150, 1300)]))
    return [*rows, (70, "dup" * 100), (70, "dup" * 100)]


def test_repeats(spark, monkeypatch):
    rows = repeat_rows(3)
    want = brute_repeats(rows)
    for crowd in (suffix_dedup.CROWD, 3):
        got = suffix_dedup.remove_repeats(frame(spark, rows), crowd=crowd).collect()
        assert sorted(map(tuple, got), key=repr) == want
    assert suffix_dedup.remove_repeats(frame(spark, [])).count() == 0


def test_repeats_over_tiles_and_many_ranges(spark, monkeypatch):
    monkeypatch.setattr(suffix_dedup, "TILE", 512)
    monkeypatch.setattr(suffix_dedup, "RANGE", 20)
    rows = repeat_rows(4)
    got = suffix_dedup.remove_repeats(frame(spark, rows)).collect()
    assert sorted(map(tuple, got), key=repr) == brute_repeats(rows)


def test_loser_tree_merges_front_coded_runs():
    draw = random.Random(1)
    runs = [sorted("".join(draw.choice("ab") for _ in range(draw.randint(0, 9))).encode() for _ in range(draw.randint(0, 40))) for _ in range(7)]
    merged = list(suffix_dedup.LoserTree([suffix_dedup.front_code(r) for r in runs]))
    flat = sorted(x for r in runs for x in r)
    assert [m[0] for m in merged] == flat
    assert [m[1] for m in merged[1:]] == [suffix_dedup.shared(a, b) for a, b in zip(flat, flat[1:])]
    assert all(runs[r][k] == s for s, _, r, k in merged)
