"""Repeated byte strings by a sparse suffix array, built with a common-prefix-aware distributed merge sort.

Every string of ``LENGTH`` bytes owns an anchor: the first smallest hash among its first ``SPREAD`` eight-byte grams. Equal
strings have their anchors at the same distance, so only suffixes at anchors are sorted, about one in ``SPREAD / 2``. All
strings of an anchor share its core, the ``CORE`` bytes that follow it. The steps:

1. Anchors with a core that occurs once can't be in a repeat. They go by a count of core hashes.
2. A block is all bytes of an anchor's strings. A block that occurs twice is removed at each place, without its text.
3. Of the other blocks one of each kind goes into the sort: each task sorts its suffixes and sends front-coded runs to
   ranges of prefixes; the receiver merges the runs with a loser tree that compares from the known common prefix on.
4. In the merged order, neighbours that share a core stand together. Their strings are compared offset by offset.

Hashes of 64 bits (core) and 64 bits (block or string) together stand for equality. Cores with very many different blocks
are not sorted in one place: their strings are counted by hash, which any number of tasks can share.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import filled, persist_to_shared, slices, utf8_buffer

LENGTH, SPREAD, GRAM = 200, 144, 8
CORE = LENGTH - SPREAD + 1
#: Different blocks of a core up to which they are merged in one range.
CROWD = 20_000
#: Bytes handled at a time; texts are cut into tiles of so many string starts.
TILE = 1 << 20
#: Bytes of text whose suffixes make a run.
RUN_BYTES = 16 << 20
#: Suffixes of a range of the sort, about.
RANGE = 100_000

_BASE = np.uint64(0xD6E8FEB86659FD93)
_INVERSE = np.uint64(pow(0xD6E8FEB86659FD93, -1, 2**64))


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    up = np.full(n, _BASE)
    down = np.full(n, _INVERSE)
    up[0] = down[0] = 1
    return np.cumprod(up, dtype=np.uint64), np.cumprod(down, dtype=np.uint64)


class Hasher:
    """Hashes of substrings from prefix sums of mixed eight-byte grams."""

    def __init__(self) -> None:
        self.up, self.down = _powers(2 * TILE)

    def load(self, data: np.ndarray) -> None:
        n = len(data) - GRAM + 1
        if n > len(self.up):
            self.up, self.down = _powers(n)
        self.grams = np.ndarray((n,), "<u8", np.ascontiguousarray(data), 0, (1,)).copy()
        mixed = self.grams * np.uint64(0x9E3779B97F4A7C15)
        mixed ^= mixed >> np.uint64(29)
        mixed *= np.uint64(0xBF58476D1CE4E5B9)
        mixed ^= mixed >> np.uint64(32)
        mixed *= self.up[:n]
        self.sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mixed, dtype=np.uint64)])

    def of(self, start: np.ndarray, stop: np.ndarray) -> np.ndarray:
        """Of the bytes from start to stop, eight at least."""
        h = (self.sums[stop - GRAM + 1] - self.sums[start]) * self.down[start]
        return h ^ (h >> np.uint64(31))


def _first_smallest(grams: np.ndarray) -> np.ndarray:
    """For each start, the place of the first smallest gram hash among ``SPREAD``."""
    keyed = ((grams * np.uint64(0xC2B2AE3D27D4EB4F)) & np.uint64(0xFFFFFFFF00000000)) | np.arange(len(grams), dtype=np.uint64)
    span = 1
    while 2 * span <= SPREAD:
        keyed = np.minimum(keyed[:-span], keyed[span:])
        span *= 2
    if span < SPREAD:
        keyed = np.minimum(keyed[: span - SPREAD], keyed[SPREAD - span :])
    return (keyed & np.uint64(0xFFFFFFFF)).astype(np.int64)


def _tiles(offsets: np.ndarray) -> Iterator[list[tuple[int, int, int, int]]]:
    """Pieces ``(row, from, to, offset in the text)`` of about a tile together; those of one text overlap by a string less a byte."""
    held, size = [], 0
    for row, (a, b) in enumerate(zip(offsets[:-1].tolist(), offsets[1:].tolist())):
        for start in range(a, max(b - LENGTH + 1, a), TILE):
            stop = min(b, start + TILE + LENGTH - 1)
            if stop - start < LENGTH:
                continue
            if held and size + stop - start > 2 * TILE - LENGTH:
                yield held
                held, size = [], 0
            held.append((row, start, stop, start - a))
            size += stop - start
    if held:
        yield held


def _anchors(data: np.ndarray, offsets: np.ndarray, hasher: Hasher) -> Iterator[tuple[np.ndarray, ...]]:
    """``row, at, first, last, core, block, prefix`` of anchors: ``first`` to ``last`` are the starts of its strings."""
    for pieces in _tiles(offsets):
        lengths = np.array([p[2] - p[1] for p in pieces])
        joined = np.concatenate([data[a:b] for _, a, b, _ in pieces])
        starts = np.concatenate([[0], np.cumsum(lengths)[:-1]])
        hasher.load(joined)
        place = _first_smallest(hasher.grams)
        valid = np.zeros(len(joined), bool)
        for s, n in zip(starts.tolist(), lengths.tolist()):
            valid[s : s + n - LENGTH + 1] = True
        where = np.flatnonzero(valid)
        anchor = place[where]
        heads = np.flatnonzero(np.concatenate([[True], (anchor[1:] != anchor[:-1]) | (where[1:] != where[:-1] + 1)]))
        tails = np.append(heads[1:], len(where)) - 1
        at, first, last = anchor[heads], where[heads], where[tails]
        owner = np.searchsorted(starts, first, "right") - 1
        shift = np.array([p[3] for p in pieces])[owner] - starts[owner]
        shape = (at - first).astype(np.uint64) * np.uint64(1009) + (at - last).astype(np.uint64)
        block = hasher.of(first, last + LENGTH) + shape * np.uint64(0x94D049BB133111EB)
        prefix = (hasher.grams[at].byteswap() >> np.uint64(1)).astype(np.int64)  # orders as the bytes do
        yield np.array([p[0] for p in pieces])[owner], at + shift, first + shift, last + shift, hasher.of(at, at + CORE), block, prefix


ANCHORS = "doc_id long, mark long, at int, first int, last int, core long, block long, prefix long"


def _find_anchors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    hasher = Hasher()
    for batch in batches:
        data, offsets = utf8_buffer(batch.column("text"))
        for row, at, first, last, core, block, prefix in _anchors(data, offsets, hasher):
            take = pa.array(row)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id").take(take), batch.column("mark").take(take), *(pa.array(x.astype(np.int32)) for x in (at, first, last)),
                 *(pa.array(x.view(np.int64)) for x in (core, block)), pa.array(prefix)],
                [f.split(" ")[0] for f in ANCHORS.split(", ")],
            )


# front-coded runs


def shared(a: bytes, b: bytes, known: int = 0) -> int:
    """Length of the common prefix of two strings that share ``known`` bytes."""
    n = min(len(a), len(b))
    if a[known:n] == b[known:n]:
        return n
    low, high = known, n
    while high - low > 1:
        middle = (low + high) // 2
        if a[low:middle] == b[low:middle]:
            low = middle
        else:
            high = middle
    return low + (a[low] == b[low])


def front_code(strings: list[bytes]) -> tuple[list[int], list[bytes]]:
    """Common prefix with the string before, and the rest, of sorted strings."""
    common, rest, before = [], [], b""
    for s in strings:
        n = shared(before, s)
        common.append(n)
        rest.append(s[n:])
        before = s
    return common, rest


class LoserTree:
    """Merges front-coded sorted runs and gives ``(string, common prefix with the one before, run, place in the run)``.

    Each candidate carries its common prefix with the string given last. Of two candidates the one with the longer prefix
    is the smaller; equal prefixes are compared from there on only, and the loser keeps what it shares with the winner.
    """

    def __init__(self, runs: list[tuple[list[int], list[bytes]]]) -> None:
        self.runs, self.next = runs, [0] * len(runs)
        self.size = 1
        while self.size < max(1, len(runs)):
            self.size *= 2
        self.string: list[bytes | None] = [None] * self.size
        self.prefix = [0] * self.size
        self.loser = [-1] * self.size
        for r in range(len(runs)):
            self._pull(r)
        winners = list(range(self.size))
        node = self.size
        while len(winners) > 1:
            node //= 2
            winners = [self._play(a, b, node + i) for i, (a, b) in enumerate(zip(winners[::2], winners[1::2]))]
        self.winner = winners[0]

    def _pull(self, r: int) -> None:
        i = self.next[r]
        common, rest = self.runs[r]
        if i == len(common):
            self.string[r] = None
            return
        self.string[r] = ((self.string[r] or b"")[: common[i]]) + rest[i]
        self.prefix[r] = common[i]  # the run's string before was the one given last
        self.next[r] = i + 1

    def _play(self, a: int, b: int, node: int) -> int:
        x, y = self.string[a], self.string[b]
        if x is None or y is None:
            win, lose = (b, a) if x is None else (a, b)
        elif self.prefix[a] != self.prefix[b]:
            win, lose = (a, b) if self.prefix[a] > self.prefix[b] else (b, a)
        else:
            n = shared(x, y, self.prefix[a])
            win, lose = (a, b) if x[n:] <= y[n:] else (b, a)
            self.prefix[lose] = n
        self.loser[node] = lose
        return win

    def __iter__(self) -> Iterator[tuple[bytes, int, int, int]]:
        while self.string[self.winner] is not None:
            w = self.winner
            yield self.string[w], self.prefix[w], w, self.next[w] - 1
            self._pull(w)
            node = (self.size + w) // 2
            while node:
                w = self._play(w, self.loser[node], node)
                node //= 2
            self.winner = w


RUNS = "part int, run binary, common binary, lengths binary, rest binary, left binary, ids binary, spans binary"


def _write_runs(bounds: list[int]):
    """Sorted, front-coded runs of a batch's suffixes, one row for each range of prefixes."""

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cuts = np.array(bounds, np.int64)
        for batch in (piece for whole in batches for piece in slices(whole, "text", RUN_BYTES)):
            made = []
            for text, doc_id, mark, anchors in zip(*(batch.column(c).to_pylist() for c in ("text", "doc_id", "mark", "anchors"))):
                data = text.encode("utf-8") if isinstance(text, str) else text
                for x in anchors:
                    if not x["sorted"]:
                        continue
                    at, first, last = x["at"], x["first"], x["last"]
                    made.append((x["prefix"], data[at : last + LENGTH], data[first:at], doc_id, mark, at, first, last))
            made.sort(key=lambda m: m[1])
            parts = np.searchsorted(cuts, np.array([m[0] for m in made], np.int64), "right")
            edges = np.flatnonzero(np.diff(parts)) + 1
            rows = []
            for a, b in zip([0, *edges.tolist()], [*edges.tolist(), len(made)]):
                if a == b:
                    continue
                own = made[a:b]
                common, rest = front_code([m[1] for m in own])
                rows.append(
                    (int(parts[a]), hashlib.md5(repr((own[0][3:], b - a)).encode()).digest(), np.array(common, np.uint16).tobytes(), np.array([[len(r), len(m[2])] for r, m in zip(rest, own)], np.uint16).tobytes(),
                     b"".join(rest), b"".join(m[2] for m in own), np.array([m[3:5] for m in own], np.int64).tobytes(), np.array([m[5:8] for m in own], np.int32).tobytes())
                )
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), [pa.int32(), *[pa.binary()] * 7])], [f.split(" ")[0] for f in RUNS.split(", ")])

    return write


FOUND = "doc_id long, mark long, start int, stop int"


def _found(doc_id, mark, start, stop) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array(doc_id, pa.int64()), pa.array(mark, pa.int64()), pa.array(np.asarray(start).astype(np.int32)), pa.array(np.asarray(stop).astype(np.int32))], ["doc_id", "mark", "start", "stop"]
    )


def _repeats(rows: list[tuple[int, bytes, bytes, np.ndarray, np.ndarray]], hasher: Hasher) -> Iterator[pa.RecordBatch]:
    """Repeated strings among blocks ``(group, left, right, ids, span)``: equal offset from the anchor and equal bytes."""
    joined = np.frombuffer(b"".join(r[1] + r[2] for r in rows), np.uint8)
    hasher.load(joined)
    size = np.array([len(r[1]) + len(r[2]) for r in rows])
    begin = np.concatenate([[0], np.cumsum(size)[:-1]])
    counts = size - LENGTH + 1  # strings of a block: first to last
    owner = np.repeat(np.arange(len(rows)), counts)
    offset = np.arange(len(owner)) - np.repeat(np.concatenate([[0], np.cumsum(counts)[:-1]]), counts)
    start = begin[owner] + offset
    distance = np.array([len(r[1]) for r in rows])[owner] - offset
    key = hasher.of(start, start + LENGTH) + distance.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    key ^= np.array([r[0] for r in rows], np.uint64)[owner] * np.uint64(0xC2B2AE3D27D4EB4F)
    order = np.argsort(key, kind="stable")
    same = key[order][1:] == key[order][:-1]
    repeated = np.zeros(len(key), bool)
    repeated[order[1:][same]] = True
    repeated[order[:-1][same]] = True
    hit = np.flatnonzero(repeated)
    if len(hit) == 0:
        return
    heads = np.flatnonzero(np.concatenate([[True], (hit[1:] != hit[:-1] + 1) | (owner[hit[1:]] != owner[hit[:-1]])]))
    tails = np.append(heads[1:], len(hit)) - 1
    a, b = hit[heads], hit[tails]
    ids = np.array([r[3] for r in rows], np.int64)
    first = np.array([r[4][1] for r in rows], np.int64)
    yield _found(ids[owner[a], 0], ids[owner[a], 1], first[owner[a]] + offset[a], first[owner[a]] + offset[b] + LENGTH)


def _merge_runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Merge the runs of each range and resolve neighbours with a common core. Rows come sorted by range and run."""
    hasher = Hasher()

    def resolve(rows: list[dict]) -> Iterator[pa.RecordBatch]:
        runs, extra = [], []
        for r in rows:
            common = np.frombuffer(r["common"], np.uint16).tolist()
            lengths = np.frombuffer(r["lengths"], np.uint16).reshape(-1, 2)
            ends, left_ends = np.cumsum(lengths[:, 0]).tolist(), np.cumsum(lengths[:, 1]).tolist()
            runs.append((common, [r["rest"][a:b] for a, b in zip([0, *ends], ends)]))
            extra.append(([r["left"][a:b] for a, b in zip([0, *left_ends], left_ends)], np.frombuffer(r["ids"], np.int64).reshape(-1, 2), np.frombuffer(r["spans"], np.int32).reshape(-1, 3)))
        group, held, size, closed = 0, [], 0, 0
        for string, prefix, run, place in LoserTree(runs):
            if prefix < CORE:
                group += 1
                closed = len(held)
                if size > 4 * TILE // 3:
                    yield from _repeats(held, hasher)
                    held, size, closed = [], 0, 0
            left, ids, spans = extra[run]
            held.append((group, left[place], string, ids[place], spans[place]))
            size += len(string) + len(left[place])
        if held:
            yield from _repeats(held, hasher)

    part, rows = None, []
    for batch in batches:
        for row in batch.to_pylist():
            if row["part"] != part and rows:
                yield from resolve(rows)
                rows = []
            part = row["part"]
            rows.append(row)
    if rows:
        yield from resolve(rows)


CROWDED = "doc_id long, mark long, start int, core long, distance int, string long"


def _crowded_strings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Every string of the blocks of crowded cores as a hash."""
    hasher = Hasher()
    for batch in (piece for whole in batches for piece in slices(whole, "text", RUN_BYTES)):
        for text, doc_id, mark, anchors in zip(*(batch.column(c).to_pylist() for c in ("text", "doc_id", "mark", "anchors"))):
            data = np.frombuffer(text.encode("utf-8"), np.uint8)
            for x in anchors:
                if x["sorted"]:
                    continue
                first, last = x["first"], x["last"]
                hasher.load(data[first : last + LENGTH])
                start = np.arange(last - first + 1)
                string = hasher.of(start, start + LENGTH).view(np.int64)
                n = len(start)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([doc_id] * n, pa.int64()), pa.array([mark] * n, pa.int64()), pa.array((first + start).astype(np.int32)), pa.array([x["core"]] * n, pa.int64()),
                     pa.array((x["at"] - first - start).astype(np.int32)), pa.array(string)],
                    [f.split(" ")[0] for f in CROWDED.split(", ")],
                )


CUT = "doc_id long, mark long, n_removed long, n_spans long, kept binary"


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in (piece for whole in batches for piece in slices(whole, "text", RUN_BYTES)):
        removed, spans, kept = [], [], []
        for text, found in zip(batch.column("text").to_pylist(), batch.column("found").to_pylist()):
            data = text.encode("utf-8")
            pairs = np.array(sorted((f["start"], f["stop"]) for f in found), np.int64)
            reach = np.maximum.accumulate(pairs[:, 1])
            fresh = np.concatenate([[True], pairs[1:, 0] > reach[:-1]])
            starts, stops = pairs[fresh, 0].tolist(), np.append(reach[:-1][fresh[1:]], reach[-1]).tolist()
            kept.append(b"".join(data[a:b] for a, b in zip([0, *stops], [*starts, len(data)])))
            removed.append(sum(stops) - sum(starts))
            spans.append(len(starts))
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), batch.column("mark"), pa.array(removed, pa.int64()), pa.array(spans, pa.int64()), pa.array(kept, pa.binary())], [f.split(" ")[0] for f in CUT.split(", ")]
        )


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", crowd: int = CROWD) -> DataFrame:
    """``doc_id, n_bytes, n_removed, n_spans, kept_sha256`` of every row: bytes in a repeated string of 200 are removed.

    Null text is empty; texts under 200 bytes stay whole. Rows that repeat an id and a text are occurrences of each other,
    so all their bytes go if there are 200. Texts may have any length; they are read in tiles. Other columns are ignored,
    an empty table gives an empty one.
    """
    keyed = docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(-(2**63))).alias("doc_id"), filled(text_col).alias("text"))
    keyed = keyed.withColumn("mark", F.xxhash64("text"))
    long = keyed.where(F.octet_length("text") >= LENGTH)
    anchors = long.select("doc_id", "mark", "text").mapInArrow(_find_anchors, ANCHORS)
    twice = anchors.groupBy("core").agg(F.count("*").alias("n")).where("n > 1").select("core")
    candidates = persist_to_shared(anchors.join(twice, "core", "left_semi"), "suffix-anchors")
    kinds = candidates.groupBy("core", "block").agg(F.count("*").alias("n"), F.min(F.struct("doc_id", "mark", "at")).alias("chosen"))
    kinds = persist_to_shared(kinds, "suffix-blocks")
    again = kinds.where("n > 1").select("core", "block")
    whole = candidates.join(again, ["core", "block"], "left_semi").select("doc_id", "mark", F.col("first").alias("start"), (F.col("last") + LENGTH).alias("stop"))
    many = persist_to_shared(kinds.groupBy("core").agg(F.count("*").alias("kinds")).where("kinds > 1"), "suffix-cores")
    chosen = kinds.join(many, "core").select("core", "chosen.*", (F.col("kinds") <= crowd).alias("sorted"))
    picked = candidates.join(chosen, ["core", "doc_id", "mark", "at"]).distinct()
    picked = picked.select("doc_id", "mark", F.struct("at", "first", "last", "prefix", "core", "sorted").alias("anchor"))
    lists = persist_to_shared(picked.groupBy("doc_id", "mark").agg(F.collect_list("anchor").alias("anchors")), "suffix-picked")
    spans = persist_to_shared(whole.groupBy("doc_id", "mark").agg(F.collect_set(F.struct("start", "stop")).alias("whole")), "suffix-whole")
    # texts of documents with candidates, once
    wanted = lists.join(spans, ["doc_id", "mark"], "full")
    texts = persist_to_shared(long.dropDuplicates(["doc_id", "mark"]).join(wanted, ["doc_id", "mark"]), "suffix-texts")
    each = lists.select(F.explode("anchors").alias("a")).where("a.sorted")
    n = each.count()
    parts = max(1, -(-n // RANGE))
    bounds = [] if parts == 1 else sorted(set(each.agg(F.percentile_approx("a.prefix", [i / parts for i in range(1, parts)], 10_000)).first()[0]))
    with_list = texts.where(F.col("anchors").isNotNull()).select("doc_id", "mark", "text", "anchors")
    runs = with_list.mapInArrow(_write_runs(bounds), RUNS)
    merged = runs.repartition(max(parts, 1), "part").sortWithinPartitions("part", "run").mapInArrow(_merge_runs, FOUND)
    crowded = with_list.where(F.exists("anchors", lambda a: ~a["sorted"])).mapInArrow(_crowded_strings, CROWDED)
    counted = crowded.groupBy("core", "distance", "string").count().where("count > 1").drop("count")
    crowded = crowded.join(counted, ["core", "distance", "string"], "left_semi").select("doc_id", "mark", "start", (F.col("start") + LENGTH).alias("stop"))
    found = merged.unionByName(crowded).groupBy("doc_id", "mark").agg(F.collect_list(F.struct("start", "stop")).alias("more"))
    found = persist_to_shared(found, "suffix-found")
    none = F.array().cast("array<struct<start:int,stop:int>>")
    cut = texts.select("doc_id", "mark", "text", "whole").join(found, ["doc_id", "mark"], "left")
    cut = cut.select("doc_id", "mark", "text", F.concat(F.coalesce("whole", none), F.coalesce("more", none)).alias("found")).where(F.size("found") > 0)
    cut = persist_to_shared(cut.mapInArrow(_cut, CUT).withColumn("kept_sha256", F.sha2("kept", 256)).drop("kept"), "suffix-cut")
    all_rows = keyed.select("doc_id", "mark", F.octet_length("text").cast("long").alias("n_bytes"), F.sha2("text", 256).alias("sha"))
    out = all_rows.join(cut, ["doc_id", "mark"], "left")
    return out.select(
        F.when(F.col("doc_id") != F.lit(-(2**63)), F.col("doc_id")).alias("doc_id"), "n_bytes", F.coalesce("n_removed", F.lit(0)).cast("long").alias("n_removed"),
        F.coalesce("n_spans", F.lit(0)).cast("long").alias("n_spans"), F.coalesce("kept_sha256", "sha").alias("kept_sha256"),
    )
