"""Phrase collocations by best-first growth of prefixes with admissible bounds.

Phrases of 2 to ``longest`` words are scored by the lowest of ``floor(SCALE a / (l + r))`` over their cuts, where a, l and r count the
phrase and its two parts. A phrase that grows from the prefix p = (w1 ...) has a <= f(p), and for the cut after w1, l = f(w1) and
r >= a. As x / (f(w1) + x) grows with x, no such phrase scores more than ``floor(SCALE f(p) / (f(w1) + f(p)))``: the prefix's bound.

1. Words, then pairs of frequent words, are counted over all texts; pairs have a score and a bound.
2. Each language opens its prefixes from the best bound on, down to a threshold: the score of its ``2 top``-th pair at first. Opened
   prefixes are grown by a word, whatever grows from them is counted, scored and bounded in turn, level by level.
3. Phrases at or over the threshold also have the phrases counted that hold them one word to the left, which decide whether they
   survive. (Those one word to the right grow from the phrase itself, whose bound is no less than its score.)
4. All survivors at or over the threshold are then known. A language with ``top`` of them is settled, ties included; the others
   lower the threshold (to four times the rank) and open the next prefixes, until nothing is left to open.

Counting reads the texts in blocks, keeps one row a distinct phrase and block, and adds those up in Spark. Which phrases a level may
count is told to the tasks by bitmaps of fixed size (``BITS``), built by Spark: a false hit costs work and changes nothing, for what
is counted is counted at every place, and the tables that are joined are exact.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import filled, persist_to_shared, slices, utf8_buffer

#: Bits of a bitmap (8 MB), text read together, and the scale of scores.
BITS, BLOCK, SCALE = 1 << 26, 2 << 20, 2_000_000

# Fixed values of the public XXH64 algorithm.
_P1, _P2, _P3, _P4, _P5 = 0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x85EBCA77C2B2AE63, 0x27D4EB2F165667C5

_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[0x41:0x5B] += 32
_BREAK = np.zeros(256, bool)
_BREAK[[ord(c) for c in ".,;:!?\n\v\f\r"]] = True
_BLANK = np.zeros(256, bool)
_BLANK[[0x20, 0x09]] = True


def words(texts: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """All words of all texts, the text each is in, and a number that differs between pieces."""
    data, offsets = utf8_buffer(texts)
    n = len(data)
    data = _FOLD[data]
    cut = _BREAK[data]
    letter = ~(cut | _BLANK[data])
    inner = np.zeros(n + 1, bool)  # no word starts or ends between these two letters
    inner[1:-1] = letter[:-1] & letter[1:]
    inner[offsets] = False
    starts, stops = np.flatnonzero(letter & ~inner[:-1]), np.flatnonzero(letter & ~inner[1:]) + 1
    home = np.repeat(np.arange(len(texts)), np.diff(np.searchsorted(starts, offsets)))
    piece = np.cumsum(cut, dtype=np.int32)[starts].astype(np.int64) + home
    bounds = np.concatenate([[0], np.cumsum(stops - starts)]).astype(np.int64)
    found = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(bounds), pa.py_buffer(data[letter])])
    return found, home, piece


def _xx64(value: np.ndarray, seed: np.ndarray) -> np.ndarray:
    """Spark's ``xxhash64`` of longs, which continues from a seed."""
    turn = lambda x, r: (x << np.uint64(r)) | (x >> np.uint64(64 - r))
    h = (seed + np.uint64(_P5 + 8)) ^ (turn(value * np.uint64(_P2), 31) * np.uint64(_P1))
    h = turn(h, 27) * np.uint64(_P1) + np.uint64(_P4)
    h = (h ^ (h >> np.uint64(33))) * np.uint64(_P2)
    h = (h ^ (h >> np.uint64(29))) * np.uint64(_P3)
    return h ^ (h >> np.uint64(32))


def phrase_hash() -> Column:
    """Spark's side of it: the hash of the language, then of each word."""
    return F.xxhash64(F.xxhash64("lang"), F.transform(F.split("phrase", " "), lambda w: F.xxhash64(w)))


def _numbered(key: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct keys in the order they appear, which of them stands at each place, and how often each does."""
    coded = pa.array(key).dictionary_encode()
    at = coded.indices.to_numpy().astype(np.int64)
    return coded.dictionary.to_numpy(), at, np.bincount(at, minlength=len(coded.dictionary))


class _Types:
    """Distinct phrases of a block: which of them stands at each place (-1: none), their words (numbers of the units),
    hashes and counts."""

    def __init__(self, at: np.ndarray, words: np.ndarray, hashes: np.ndarray, count: np.ndarray) -> None:
        self.at, self.words, self.hashes, self.count = at, words, hashes, count

    def cut(self, keep: np.ndarray) -> "_Types":
        """Only the phrases of ``keep``; the others stand nowhere any more."""
        number = np.full(len(keep) + 1, -1)
        number[:-1][keep] = np.arange(keep.sum())
        return _Types(number[self.at], self.words[keep], self.hashes[keep], self.count[keep])

    def member(self, maps: dict, name: str) -> np.ndarray:
        """Which phrases a bitmap holds."""
        at = (self.hashes & np.uint64(BITS - 1)).astype(np.int64)
        return (maps[name].value[at >> 3] >> (at & 7).astype(np.uint8)) & 1 == 1

    def grow(self, places: np.ndarray, unit: "_Units", size: int) -> "_Types":
        """Phrases of ``size`` words that begin at ``places``: the one of this table there and the word behind it."""
        value, at, count = _numbered(self.at[places] * len(unit.text) + unit.at[places + size - 1])
        head, tail = value // max(1, len(unit.text)), value % max(1, len(unit.text))
        whole = np.full(len(self.at), -1)
        whole[places] = at
        return _Types(whole, np.column_stack([self.words[head], tail]), _xx64(unit.word_hashes[tail], self.hashes[head]), count)


class _Units:
    """The words of a block, by language."""

    def __init__(self, batch: pa.RecordBatch) -> None:
        languages = batch.column("lang").dictionary_encode()
        self.names = [x.encode() for x in languages.dictionary.to_pylist()]
        found, home, self.piece = words(batch.column("text"))
        spelt = found.dictionary_encode()
        known = max(1, len(spelt.dictionary))
        tongue = languages.indices.to_numpy()[home].astype(np.int64)
        value, self.at, self.count = _numbered(tongue * known + spelt.indices.to_numpy())
        self.totals = np.bincount(tongue, minlength=len(self.names))
        self.text, self.lang = spelt.dictionary.take(pa.array(value % known)), value // known
        self.spelt, self.word = spelt.dictionary, value % known

    def types(self) -> _Types:
        self.word_hashes = np.array([xxhash.xxh64_intdigest(w, 42) for w in self.spelt.to_pylist()], np.uint64)[self.word]
        start = _xx64(np.array([xxhash.xxh64_intdigest(x, 42) for x in self.names], np.uint64), np.uint64(42))
        return _Types(self.at, np.arange(len(self.text))[:, None], _xx64(self.word_hashes, start[self.lang]), self.count)

    def rows(self, types: _Types) -> pa.RecordBatch:
        parts = [self.text.take(pa.array(types.words[:, i])) for i in range(types.words.shape[1])]
        text = pc.binary_join_element_wise(*parts, pa.scalar(b" ", pa.large_binary()))
        return _batch(self.names, self.lang[types.words[:, 0]], text, types.count)


def _batch(names: list[bytes], lang: np.ndarray, text: pa.Array, n: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(names, pa.binary()).take(pa.array(lang)).cast(pa.string()), text.cast(pa.binary()).cast(pa.string()), pa.array(n.astype(np.int64))], ["lang", "phrase", "n"])


COUNTED = "lang string, phrase string, n long"


def _counting(size: int, maps: dict):
    """Counts of the phrases of ``size`` words in each block that the bitmaps ask for.

    Words: all, and one row with an empty phrase for the number of words. Pairs: of words in ``w``. Longer ones: where all pairs
    inside are in ``2`` and the shorter phrase at the start is in ``open`` or the one behind it in ``held``, or ``asked`` has the phrase.
    """

    def count(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        unit = _Units(batch)
        if size == 1:
            yield _batch(unit.names, unit.lang, unit.text, unit.count)
            yield _batch(unit.names, np.arange(len(unit.names)), pa.array([b""] * len(unit.names), pa.large_binary()), unit.totals)
            return
        ones, piece = unit.types(), unit.piece
        ones = ones.cut(ones.member(maps, "w"))
        good = ones.at >= 0
        pairs = ones.grow(np.flatnonzero(good[:-1] & good[1:] & (piece[:-1] == piece[1:])), unit, 2)
        if size == 2:
            yield unit.rows(pairs)
            return
        pairs = pairs.cut(pairs.member(maps, "2"))
        now = pairs
        for k in range(3, size + 1):
            # all phrases of k words where the k - 1 pairs inside are frequent
            fits = np.ones(max(0, len(now.at) - k + 1), bool)
            for j in range(k - 1):
                fits &= pairs.at[j : j + len(fits)] >= 0
            if k == size and "asked" not in maps:
                opened, held = (np.append(now.member(maps, name), False)[now.at] for name in ("open", "held"))
                fits &= opened[: len(fits)] | held[1 : len(fits) + 1]
            now = now.grow(np.flatnonzero(fits), unit, k)
        yield unit.rows(now.cut(now.member(maps, "asked")) if "asked" in maps else now)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text", BLOCK):
                yield from count(part)

    return run


def bitmap(phrases: DataFrame):
    """A bitmap of the (lang, phrase) rows, broadcast. Its size does not depend on them: at most BITS / 64 rows reach the driver."""
    spot = phrases.select(phrase_hash().bitwiseAND(F.lit(BITS - 1)).alias("spot"))
    cells = spot.select(F.shiftright("spot", 6).alias("cell"), F.expr("shiftleft(1L, cast(spot & 63 as int))").alias("bit"))
    table = cells.groupBy("cell").agg(F.bit_or("bit").alias("bits")).toArrow()
    out = np.zeros(BITS // 64, np.int64)
    out[table.column("cell").to_numpy()] = table.column("bits").to_numpy()
    return phrases.sparkSession.sparkContext.broadcast(out.view(np.uint8))


def _head(k: int) -> Column:
    return F.substring_index("phrase", " ", k)


def _tail(k: int) -> Column:
    return F.substring_index("phrase", " ", -k)


def _ratio(part: Column, whole: Column) -> Column:
    """floor(SCALE part / whole), in decimals: the product may pass 64 bits."""
    return F.call_function("div", part.cast("decimal(20,0)") * F.lit(SCALE).cast("decimal(7,0)"), whole.cast("decimal(20,0)"))


def collocations(docs: DataFrame, top: int = 2000, least: int = 30, longest: int = 4, covered: int = 80, lang_col: str = "lang", text_col: str = "text") -> DataFrame:
    """``lang, rank, phrase, a, l, r, n, score``: each language's first ``top`` phrases by score, count (both falling) and text.

    A-Z are lower-cased; ``.,;:!?`` and line ends split a text into pieces, blanks and tabs pieces into words. A null language
    is ``und``, a null text is empty. Candidates have 2 to ``longest`` words and ``least`` places; the lowest-scoring cut counts, of
    equal ones the first. A candidate is dropped if a longer candidate holds its words and has ``covered`` percent of its places.
    Repeated rows count as often as they stand there; other columns are ignored; no texts give no rows.
    """
    if longest not in (2, 3, 4):
        raise ValueError("phrases have 2 to 4 words at most")
    rows = docs.select(F.coalesce(F.col(lang_col).cast("string"), F.lit("und")).alias("lang"), filled(F.col(text_col).cast("string")).alias("text"))

    def counted(size: int, maps: dict, name: str) -> DataFrame:
        found = rows.mapInArrow(_counting(size, maps), COUNTED).groupBy("lang", "phrase").agg(F.sum("n").alias("n"))
        return persist_to_shared(found.where((F.col("n") >= least) | (F.col("phrase") == "")), name)

    ones = counted(1, {}, "phrases-1")
    totals = ones.where("phrase = ''").select("lang", F.col("n").alias("total"))
    ones = ones.where("phrase <> ''")
    maps = {"w": bitmap(ones)}
    known = {1: ones, 2: counted(2, maps, "phrases-2")}
    maps["2"] = bitmap(known[2])

    def part(df: DataFrame, size: int, phrase: Column, name: str) -> DataFrame:
        side = known[size].select("lang", F.col("phrase").alias(f"{name}_phrase"), F.col("n").alias(name))
        return df.withColumn(f"{name}_phrase", phrase).join(side, ["lang", f"{name}_phrase"]).drop(f"{name}_phrase")

    def scored(df: DataFrame, size: int, name: str) -> DataFrame:
        """Counts of the parts of every cut, the lowest score and the bound of what grows from here."""
        for k in range(1, size):
            df = part(part(df, k, _head(k), f"l{k}"), size - k, _tail(size - k), f"r{k}")
        cuts = [F.struct(_ratio(F.col("n"), F.col(f"l{k}") + F.col(f"r{k}")).alias("score"), F.lit(k).alias("k"), F.col(f"l{k}").alias("l"), F.col(f"r{k}").alias("r")) for k in range(1, size)]
        df = df.withColumn("best", F.array_min(F.array(*cuts)))
        df = df.select("lang", "phrase", F.col("n").alias("a"), "best.l", "best.r", "best.score", _ratio(F.col("n"), F.col("l1") + F.col("n")).alias("bound"), F.lit(size).alias("size"))
        return persist_to_shared(df, name)

    pairs = scored(known[2], 2, "phrases-pairs")
    ranks = pairs.groupBy("lang", "score").agg(F.count("*").alias("m"))  # a score is a whole number up to a million
    falling = Window.partitionBy("lang").orderBy(F.col("score").desc())
    ranks = persist_to_shared(ranks.select("lang", "score", F.sum("m").over(falling).alias("reach")), "phrases-ranks")

    def edge(rank: int) -> DataFrame:
        """The threshold of each language: the score of its pair of that rank, 0 if it has fewer."""
        return ranks.groupBy("lang").agg(F.coalesce(F.max(F.when(F.col("reach") >= rank, F.col("score"))), F.lit(0)).alias("edge"))

    settled: DataFrame | None = None  # languages
    rank, out = 2 * top, None
    cover: dict[int, DataFrame | None] = {k: None for k in range(3, longest + 1)}
    score_tables = {2: pairs}
    while True:
        edges = edge(rank)
        if settled is not None:
            edges = edges.join(settled, "lang", "left_anti")
        edges = persist_to_shared(edges, "phrases-edges")
        for size in range(3, longest + 1):
            below = score_tables[size - 1].join(edges, "lang")
            opened, held = persist_to_shared(below.where("bound >= edge"), "phrases-open"), below.where("score >= edge")
            grown = counted(size, {**maps, "open": bitmap(opened), "held": bitmap(held)}, f"phrases-{size}")
            cover[size] = known[size] = grown
            if size == 4:
                # the first cut of four words needs the count of the last three, which may not have been opened
                heads = opened.select("lang", F.col("phrase").alias("head"), F.col("a").alias("of_head"), "edge")
                tails = part(grown.withColumn("head", _head(3)).join(heads, ["lang", "head"]), 1, _tail(1), "last")
                tails = tails.where(_ratio(F.col("n"), F.col("of_head") + F.col("last")) >= F.col("edge"))  # else another cut is below the threshold
                tails = tails.select("lang", _tail(3).alias("phrase")).distinct().join(known[3], ["lang", "phrase"], "left_anti")
                tails = persist_to_shared(tails, "phrases-tails")
                if not tails.isEmpty():
                    more = counted(3, {**maps, "asked": bitmap(tails)}, "phrases-asked").join(tails, ["lang", "phrase"], "left_semi")
                    known[3] = persist_to_shared(known[3].unionByName(more), "phrases-3")
            own = grown.join(opened.select("lang", F.col("phrase").alias("head")), [grown["lang"] == opened["lang"], _head(size - 1) == F.col("head")], "left_semi")
            score_tables[size] = scored(own, size, f"phrases-scored-{size}")
        alive = None
        for size in range(2, longest + 1):
            mine = score_tables[size].join(edges, "lang").where("score >= edge")
            if size < longest:
                inner = cover[size + 1].select("lang", "n", F.explode(F.array(_head(size), _tail(size))).alias("phrase"))
                inner = inner.groupBy("lang", "phrase").agg(F.max("n").alias("most"))
                mine = mine.join(inner, ["lang", "phrase"], "left").where(F.col("most").isNull() | (F.col("most").cast("decimal(38,0)") * 100 < F.col("a").cast("decimal(38,0)") * covered)).drop("most")
            alive = mine if alive is None else alive.unionByName(mine)
        order = Window.partitionBy("lang").orderBy(F.col("score").desc(), F.col("a").desc(), "phrase")
        best = persist_to_shared(alive.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top), "phrases-best")
        # settled: enough survivors, or nothing below the threshold
        full = best.where(F.col("rank") == top).select("lang").unionByName(edges.where("edge = 0").select("lang")).distinct()
        full = persist_to_shared(full, "phrases-settled")
        done = best.join(full, "lang", "left_semi")
        out = done if out is None else out.unionByName(done)
        settled = full if settled is None else persist_to_shared(settled.unionByName(full), "phrases-settled")
        if edges.join(settled, "lang", "left_anti").isEmpty():
            break
        rank *= 4
    return out.join(totals, "lang").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", F.col("total").alias("n"), "score")
