"""Fingerprints, the Jaccard join and license scans against plain Python."""

import collections
import hashlib
import random
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from corpusloom.llm import fingerprints, jaccard_join, licenses

BLANK = re.compile(r"[^\x20\x09-\x0D]+")


def lower(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def frame(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string").withColumn("n", F.lit(1)).withColumn("token", F.lit("x")).withColumn("block", F.lit("y"))


def near_rows(seed):
    draw = random.Random(seed)
    words = [f"w{i}" for i in range(300)]
    base = [draw.choice(words) for _ in range(60)]
    rows = [(0, None), (1, ""), (2, "a b"), (3, "A  b"), (4, "x"), (5, "x"), (6, " \n"), (6, "x"), (90, " ".join(words * 40))]
    shared = "all rights reserved by the owners of this site and its many friends"
    for k in range(100, 220):
        w = base[:]
        for _ in range(draw.randint(0, 3)):
            w[draw.randrange(60)] = draw.choice(words)
        if draw.random() < 0.4:
            w = [draw.choice(words) for _ in range(draw.randint(1, 80))]
        text = " ".join(w)
        if draw.random() < 0.6:
            text = shared + "\n" + text
        if draw.random() < 0.1:
            text = shared + " " + draw.choice(words)
        rows.append((k, text))
    return rows


def brute_components(rows, size=3, percent=90):
    sets = []
    for _, t in rows:
        w = BLANK.findall(lower(t))
        sets.append(frozenset(tuple(w[i : i + size]) for i in range(len(w) - size + 1)) if len(w) >= size else frozenset([tuple(w)] if w else []))
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in range(len(rows)):
        for b in range(a):
            both = len(sets[a] & sets[b])
            if both and 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both):
                root[find(a)] = find(b)
    least = {}
    for k, (i, _) in enumerate(rows):
        least[find(k)] = min(least.get(find(k), i), i)
    return sorted((i, len(sets[k]), least[find(k)]) for k, (i, _) in enumerate(rows))


def test_jaccard_components(spark):
    rows = near_rows(2)
    for options in ({}, {"short": 2}, {"size": 5, "percent": 80}):
        got = jaccard_join.near_components(frame(spark, rows), **options).select("doc_id", "n_shingles", "component_id").collect()
        want = brute_components(rows, **{k: v for k, v in options.items() if k != "short"})
        assert sorted(map(tuple, got)) == want
    assert jaccard_join.near_components(frame(spark, [])).count() == 0


def test_jaccard_components_of_texts_with_bitmaps_of_all_levels(spark):
    """Crowds of copies near the threshold, most of which do not link, with 120, 900 and 4,000 words."""
    draw = random.Random(17)
    rows = []
    for crowd, length in enumerate((120, 120, 900, 4000)):
        base = [f"c{crowd}x{draw.randrange(10**4)}" for _ in range(length)]
        for k in range(60 if length == 120 else 14):
            w = base[:]
            for _ in range(draw.randint(1, max(2, length // 55))):
                w[draw.randrange(length)] = f"e{draw.randrange(10**6)}"
            rows.append((crowd * 1000 + k, " ".join(w[: draw.randint(length - length // 30, length)])))
    for options in ({}, {"short": 5}, {"size": 5, "percent": 80}):
        got = jaccard_join.near_components(frame(spark, rows), **options).select("doc_id", "n_shingles", "component_id").collect()
        assert sorted(map(tuple, got)) == brute_components(rows, **{k: v for k, v in options.items() if k != "short"})


def test_a_pair_is_proposed_in_the_first_of_its_lists():
    sets = [np.arange(k, 400 + k, dtype=np.uint64) for k in range(4)]

    def proposed(token, earlier, centres=False):
        n = len(sets)
        same = {"low": 0, "high": 0, "block": 0, "n": 400, "weight": 1, "place": 5, "rank": 5}
        flags = {"sel": True, "hp": True, "over": False}
        table = pa.table(
            {"token": [token] * n, "cid": list(range(n)), "label": list(range(n)), **{k: [v] * n for k, v in (same | flags).items()},
             "earlier": pa.array(earlier, pa.list_(pa.int64())), "sketch": [jaccard_join.parities(s) for s in sets]}
        )
        out = jaccard_join._propose(80, centres)(iter(table.to_batches()))
        return sorted(p for b in out for p in zip(b.column("a").to_pylist(), b.column("b").to_pylist()))

    everyone = [(a, b) for a in range(4) for b in range(a + 1, 4)]
    assert proposed(1, [[], [], [], []]) == everyone
    # own lists stand between the common one and this
    assert proposed(2, [[1, 10], [1], [11, 1], [12, 13]]) == [(0, 3), (1, 3), (2, 3)]
    assert proposed(2, [[0], [], [], []]) == everyone
    assert proposed(2, [[1, 10], [1], [11, 1], [12, 1]]) == []
    assert proposed(2, [[1, 10], [1], [11, 1], [12, 1]], True) == [(0, 1), (0, 2), (0, 3)]


def test_bitmaps_bound_the_difference_of_sets():
    draw = np.random.default_rng(4)
    for a, b in ((0, 3), (100, 120), (500, 520), (2040, 2060), (2000, 9000), (9000, 8800)):
        common = draw.integers(0, 2**62, min(a, b) // 2)
        x, y = (np.unique(np.concatenate([common, draw.integers(0, 2**62, n - len(common))])).astype(np.uint64) for n in (a, b))
        level, maps = jaccard_join.folded([jaccard_join.parities(x), jaccard_join.parities(y)])
        at = int(level.min())
        assert np.bitwise_count(maps[at][0] ^ maps[at][1]).sum() <= len(np.setxor1d(x, y))
        assert maps[at].shape == (2, jaccard_join.BITS[at] // 64)


def test_keep_one_of_each_component(spark):
    rows = near_rows(5)
    df = frame(spark, rows)
    kept = jaccard_join.keep_one(df)
    want = brute_components(rows)
    assert kept.columns == df.columns
    assert collections.Counter(r.doc_id for r in kept.select("doc_id").collect()) == collections.Counter([w[2] for w in want if w[1] and w[0] == w[2]] + [w[0] for w in want if not w[1]])


def test_keep_one_keeps_a_row_of_components_that_share_an_id(spark):
    draw = random.Random(8)
    a, b, c, d = ([f"{x}{draw.randrange(10**6)}" for _ in range(60)] for x in "abcd")
    text = lambda w, n=0: " ".join(w + ["end"] * n)
    rows = [(7, text(a)), (7, text(b)), (8, text(a, 1)), (None, text(c)), (None, text(c, 1)), (None, text(c)), (None, text(d)), (None, ""), (None, None)]
    kept = [(r.doc_id, (r.text or "").split()[:1]) for r in jaccard_join.keep_one(frame(spark, rows)).collect()]
    assert sorted(kept, key=str) == sorted([(7, a[:1]), (7, b[:1]), (None, c[:1]), (None, d[:1]), (None, []), (None, [])], key=str)
    many = [(None, " ".join(f"t{k}x{i}" for i in range(9))) for k in range(50)]
    assert jaccard_join.keep_one(frame(spark, many)).count() == 50


def test_divide_skip_counts_as_sets_do():
    draw = np.random.default_rng(1)
    for _ in range(60):
        query = np.unique(draw.integers(0, 60, 40)).astype(np.uint64)
        members = [np.unique(np.concatenate([query[draw.random(len(query)) < 0.95], draw.integers(0, 60, 3).astype(np.uint64)])) for _ in range(9)]
        want = [100 * len(np.intersect1d(query, m)) >= 80 * len(np.union1d(query, m)) for m in members]
        assert jaccard_join.divide_skip(query, members, 80).tolist() == want


def test_fingerprints(spark):
    draw = random.Random(3)
    words = [f"t{i}" for i in range(80)]
    rows = [(i * 7, " ".join(draw.choice(words) for _ in range(draw.randint(1, 200)))) for i in range(150)]
    rows += [(5, None), (6, ""), (2000, rows[0][1]), (2001, "Ü" * 4000), (2002, "a\tb\nc  A")]
    got = {r.doc_id: r for r in fingerprints.neighbour_fingerprints(frame(spark, rows)).collect()}
    texts = {i: t or "" for i, t in rows}
    ids = sorted(texts, reverse=True)
    bag = lambda t: collections.Counter(BLANK.findall(t.lower()))
    misses = []
    for k, i in enumerate(ids):
        text, after = texts[i], texts[ids[(k + 1) % len(ids)]]
        third = len(text) // 3
        edited = text[: len(text) - third] + after[:third]
        row = got[i]
        assert (row.n_chars, row.edited_sha256) == (len(text), hashlib.sha256(edited.encode()).hexdigest())
        for other, near in ((edited, row.near_edited), (after, row.near_next)):
            a, b = bag(text), bag(other)
            true = sum((a & b).values()) / sum((a | b).values()) if a or b else 1.0
            misses.append(near - true)
    assert len(got) == len(rows) and got[0].fingerprint == got[2000].fingerprint and got[6].fingerprint == "" and len(got[0].fingerprint) == 512
    assert abs(np.mean(misses)) < 0.02 and np.std(misses) < 0.1


def test_fingerprints_of_odd_tables(spark):
    assert fingerprints.neighbour_fingerprints(frame(spark, [])).count() == 0
    alone = fingerprints.neighbour_fingerprints(frame(spark, [(4, "one two three")])).collect()
    assert alone[0].near_next == 1.0
    repeated = fingerprints.neighbour_fingerprints(frame(spark, [(None, "x"), (4, "y"), (4, "y"), (4, "z")])).collect()
    assert len(repeated) == 4 and len({r.fingerprint for r in repeated}) == 3


def test_licenses(spark):
    mit = licenses.TEMPLATES["mit"]
    texts = [
        None, "", "The MIT-License, the mit\nlicense; amit license", "Apache License apache license Apache", "GNU General Public License", "MIT é license",
        "intro\n" + mit.replace(" copy", "") + "\nend", "x " * 30_000 + mit.upper(), mit.replace(" ", "\n"), "mit " * 5,
    ]
    rows = list(enumerate(texts))
    got = {r.doc_id: r for r in licenses.scan(frame(spark, rows)).collect()}
    word = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")
    for i, t in rows:
        words, places, labels = word.findall(lower(t)), [], set()
        for phrase, label in licenses.PHRASES.items():
            p = phrase.split()
            at = [k for k in range(len(words)) if words[k : k + len(p)] == p]
            places, labels = places + at, labels | ({label} if at else set())
        r = got[i]
        assert (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) == (len(words), len(places), min(places, default=None), max(places, default=None), ",".join(sorted(labels)))
        blocks = [set(word.findall(lower(b))) for b in [*(t or "").split("\n"), t or ""]]
        found = {name for name, text in licenses.TEMPLATES.items() if any(len(b & (s := set(word.findall(lower(text))))) >= 0.8 * len(s) for b in blocks)}
        assert r.labels == ",".join(sorted(labels | found)) and 0 <= r.score <= 1
    assert licenses.scan(frame(spark, [])).count() == 0
