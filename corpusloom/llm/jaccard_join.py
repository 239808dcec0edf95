"""Exact Jaccard join on word shingles by a prefix filter with verification, and the components of its links.

T-occurrence search, which was asked for, does not find the candidates here: it only verifies them (step 5).

Two sets of sizes a and b reach the threshold if they share T = ceil(0.9 / 1.9 (a + b)) shingles. The steps:

1. Documents with equal sets form a class; only one of each class is searched.
2. Shingles are ordered by length and hash, long inverted lists last. A class indexes the prefix of its order that any partner must
   meet, so the short lists are merged and long ones never propose a pair. A class whose prefix does not fill up with short
   lists (its shingles are nearly all long) also uses its long ones, dealt to blocks of bounded size.
3. Within a list, size, position and parity bitmaps, whose Hamming distance bounds the symmetric difference from below, leave
   out pairs that can't reach T. All three are exact bounds. Bitmaps grow with the set, so they stay sharp near the threshold.
   Members bring the last lists they were in before. A pair that met in one of those was looked at there and is not proposed again.
4. Every list first proposes its members to its centre, the largest class. Verified links give components, and the other
   pairs are proposed only between different components, so a large group of near copies costs its size, not its square.
5. Verification follows DivideSkip: for a query, the short lists of its candidates are counted (no heap merge), and candidates that
   can still reach T are probed in the long lists by binary search.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import filled, persist_to_shared, slices, utf8_buffer, whole_runs

#: Members up to which an inverted list is short.
SHORT = 400
#: Pairs looked at together.
PAIRS = 200_000
#: Lists before this one that a member brings along: a near pair shares one of so many but for rare cases, which repeat the pair.
SEEN = 8
#: Bits of the parity bitmaps. The first fits sets of up to as many shingles, each further one four times as many.
BITS = (512, 1024, 2048)

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[0x41:0x5B] += 32
_BLANK = np.zeros(256, bool)
_BLANK[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
_BYTES = np.random.default_rng(20240607).integers(1, 2**63, 256, dtype=np.int64).astype(np.uint64) * np.uint64(2) + np.uint64(1)
_BASE = 0xD6E8FEB86659FD93


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Shingler:
    """Sorted distinct keys of the word shingles of texts: 8 bits fall with the shingle's length, 56 are its hash.

    Any order of shingles will do for the prefixes. Long shingles are the rare ones, so they come first: short ones, such
    as three function words, meet by chance in documents that have nothing in common.
    """

    def __init__(self, size: int = 3) -> None:
        self.size = size
        self.up = self.down = np.ones(0, np.uint64)

    def sets(self, column: pa.Array) -> list[np.ndarray]:
        data, offsets = utf8_buffer(column)
        n = len(data)
        if n + 1 > len(self.up):
            self.up, self.down = (np.cumprod(np.concatenate([[np.uint64(1)], np.full(n, np.uint64(b))]), dtype=np.uint64) for b in (_BASE, pow(_BASE, -1, 2**64)))
        data = _LOWER[data]
        blank = _BLANK[data]
        edge = np.ones(n + 1, bool)  # a word starts after a blank or where a text starts
        edge[1:] = np.concatenate([blank, [True]])[:-1] if n else True
        edge[offsets] = True
        starts = np.flatnonzero(~blank & edge[:n])
        stops_at = np.concatenate([blank, [True]])
        stops_at[offsets] = True
        marks = np.flatnonzero(stops_at)
        stops = marks[np.searchsorted(marks, starts, "right")]
        sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(_BYTES[data] * self.up[:n], dtype=np.uint64)])
        widths = stops - starts
        words = _mix((sums[stops] - sums[starts]) * self.down[starts] + (stops - starts).astype(np.uint64))
        first = np.searchsorted(starts, offsets)
        out = []
        for a, b in zip(first[:-1].tolist(), first[1:].tolist()):
            w = words[a:b]
            k = min(self.size, len(w))
            if k == 0:
                out.append(np.zeros(0, np.uint64))
                continue
            h, width = np.full(len(w) - k + 1, np.uint64(k)), np.zeros(len(w) - k + 1, np.int64)
            for i in range(k):
                h = _mix(h * np.uint64(0x9E3779B97F4A7C15) + w[i : len(w) - k + 1 + i])
                width += widths[a + i : b - k + 1 + i]
            out.append(np.unique(h >> np.uint64(8) | (255 - np.minimum(width, 255)).astype(np.uint64) << np.uint64(56)))
        return out


def needed(n, percent: int):
    """Shingles that a set of n must share with any partner."""
    return (percent * n + 99) // 100


def overlap_needed(a, b, percent: int):
    return (percent * (a + b) + 99 + percent) // (100 + percent)


def parities(s: np.ndarray) -> bytes:
    """Bit c tells whether an odd number of shingles hash to c: two bitmaps differ in at most as many bits as the sets in shingles."""
    bits = next((b for k, b in enumerate(BITS) if len(s) <= BITS[0] << 2 * k), BITS[-1])
    odd = np.bincount((s & np.uint64(bits - 1)).astype(np.int64), minlength=bits) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").tobytes()


def folded(bitmaps: list[bytes]) -> tuple[np.ndarray, list[np.ndarray]]:
    """The level of each bitmap, and all bitmaps at each level: larger ones folded, zeros where one is too small."""
    level = np.array([BITS.index(len(b) * 8) for b in bitmaps], np.int64)
    out = [np.zeros((len(bitmaps), bits // 64), np.uint64) for bits in BITS]
    for k in range(len(BITS)):
        rows = np.flatnonzero(level == k)
        whole = np.frombuffer(b"".join(bitmaps[r] for r in rows), np.uint64).reshape(len(rows), BITS[k] // 64)
        for at in range(k, -1, -1):
            out[at][rows] = whole
            half = whole.shape[1] // 2
            whole = whole[:, :half] ^ whole[:, half:]
    return level, out


def _digest(s: np.ndarray) -> tuple[int, int]:
    return tuple(np.frombuffer(hashlib.md5(s.tobytes()).digest(), np.int64).tolist())


MEMBERS = "doc_id long, mark long, n int, k1 long, k2 long"


def _members(size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler = Shingler(size)
        for batch in (piece for whole in batches for piece in slices(whole, "text", 2 << 20)):
            sets = shingler.sets(batch.column("text"))
            keys = [_digest(s) for s in sets]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("mark"), pa.array([len(s) for s in sets], pa.int32()), *(pa.array([k[i] for k in keys], pa.int64()) for i in (0, 1))],
                [f.split(" ")[0] for f in MEMBERS.split(", ")],
            )

    return run


INDEXED = MEMBERS + ", tokens array<long>, sketch binary"


def _indexed(size: int, percent: int):
    """Members with the tokens a class may index and its bitmap."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler = Shingler(size)
        for batch in (piece for whole in batches for piece in slices(whole, "text", 2 << 20)):
            sets = shingler.sets(batch.column("text"))
            keys = [_digest(s) for s in sets]
            tokens, sketches = [], []
            for s in sets:
                p = len(s) - needed(len(s), percent) + 1
                tokens.append(s[: p + p // 8 + 6].view(np.int64))
                sketches.append(parities(s))
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("mark"), pa.array([len(s) for s in sets], pa.int32()), *(pa.array([k[i] for k in keys], pa.int64()) for i in (0, 1)),
                 pa.array(tokens, pa.list_(pa.int64())), pa.array(sketches, pa.binary())],
                [f.split(" ")[0] for f in INDEXED.split(", ")],
            )

    return run


PROPOSED = "a long, b long"


def met_before(lists: pa.ChunkedArray, order: np.ndarray):
    """Tells of members ``i, j``, numbered by ``order``, which pairs have a list of ``lists`` in common."""
    rows = lists.to_pylist()
    size = np.array([len(rows[k]) for k in order.tolist()], np.int64)
    held = np.arange(SEEN) < size[:, None]
    tokens = np.zeros(held.shape, np.int64)
    tokens[held] = np.fromiter((t for k in order.tolist() for t in rows[k]), np.int64, int(size.sum()))

    def met(i: np.ndarray, j: np.ndarray) -> np.ndarray:
        out, theirs, there = np.zeros(len(i), bool), tokens[j], held[j]
        for k in range(SEEN):
            out |= ((tokens[i, k, None] == theirs) & there).any(1) & held[i, k]
        return out

    return met


def _propose(percent: int, centres: bool):
    """Pairs of a list's members that can reach the threshold. ``centres``: only with the list's centre, and (x, x) for
    every other member x of a pair; else all pairs of different labels."""

    def chunk(table: pa.Table) -> Iterator[pa.RecordBatch]:
        col = {c: table.column(c).to_numpy(zero_copy_only=False) for c in ("token", "low", "high", "block", "cid", "n", "place", "rank", "weight", "sel", "hp", "over", "label")}
        change = np.zeros(len(table), np.int64)
        change[1:] = (col["token"][1:] != col["token"][:-1]) | (col["low"][1:] != col["low"][:-1]) | (col["high"][1:] != col["high"][:-1])
        run = np.cumsum(change)
        order = np.lexsort((col["cid"], col["n"], run))
        col, run = {k: v[order] for k, v in col.items()}, run[order]
        bitmaps = table.column("sketch").to_pylist()
        level, maps = folded([bitmaps[k] for k in order.tolist()])
        met = met_before(table.column("earlier"), order)
        n, cid = col["n"].astype(np.int64), col["cid"]
        key = run << 32 | n
        stop = np.searchsorted(key, run << 32 | n * 100 // percent, "right")
        counts = stop - np.arange(len(n)) - 1
        if centres:
            best = np.lexsort((cid, -col["weight"], run))
            heads = np.concatenate([[True], run[1:] != run[:-1]])
            centre = best[heads][run]  # index of the run's centre
        total = np.cumsum(counts)
        found: list[np.ndarray] = []
        a = 0
        while a < len(n):
            b = max(a + 1, int(np.searchsorted(total, (total[a - 1] if a else 0) + PAIRS, "right")))
            size = counts[a:b]
            i = np.repeat(np.arange(a, b), size)
            j = i + 1 + np.arange(len(i)) - np.repeat(np.cumsum(size) - size, size)
            a = b
            chosen = col["sel"][i] & col["sel"][j]
            fit = chosen | (col["hp"][i] & col["hp"][j] & (col["over"][i] | col["over"][j]))
            fit &= (col["low"][i] == col["high"][i]) | (col["block"][i] != col["block"][j])
            if not centres:
                fit &= col["label"][i] != col["label"][j]
            need = overlap_needed(n[i], n[j], percent)
            at_i, at_j = np.where(chosen, col["place"][i], col["rank"][i]), np.where(chosen, col["place"][j], col["rank"][j])
            fit &= np.minimum(n[i] - at_i, n[j] - at_j) >= need
            i, j, need = i[fit], j[fit], need[fit]
            apart, least = np.zeros(len(i), np.int64), np.minimum(level[i], level[j])
            for k, bits in enumerate(maps):
                these = np.flatnonzero(least == k)
                apart[these] = np.bitwise_count(bits[i[these]] ^ bits[j[these]]).sum(1, dtype=np.int64)
            fit = apart <= n[i] + n[j] - 2 * need
            i, j = i[fit], j[fit]
            fit = ~met(i, j)  # else both were in one list before this, where they were looked at with bounds no narrower
            if centres:  # that list may have had another centre, so this one's pairs stay
                able = np.unique(np.concatenate([i[fit], j[fit]]))
                fit = (i == centre[i]) | (j == centre[i])
                i, j = i[fit], j[fit]
                alone = cid[np.setdiff1d(able, np.concatenate([i, j]))]
                found.append(np.stack([alone, alone], 1))
            else:
                i, j = i[fit], j[fit]
            x, y = cid[i], cid[j]
            found.append(np.stack([np.minimum(x, y), np.maximum(x, y)], 1))
        pairs = np.unique(np.concatenate(found), axis=0) if found else np.zeros((0, 2), np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], ["a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in whole_runs(batches, ["token", "low", "high"]):
            yield from chunk(table)

    return run


def _pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    packer = zstandard.ZstdCompressor(3)
    for batch in (piece for whole in batches for piece in slices(whole, "text", 2 << 20)):
        packed = pa.array([packer.compress(t.encode("utf-8")) for t in batch.column("text").to_pylist()], pa.binary())
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("mark"), packed], ["doc_id", "mark", "packed"])


def divide_skip(query: np.ndarray, members: list[np.ndarray], percent: int) -> np.ndarray:
    """Which members share enough with the query: T-occurrence over the inverted lists of the members."""
    sizes = np.array([len(m) for m in members])
    need = overlap_needed(len(query), sizes, percent)
    flat, owner = np.concatenate(members), np.repeat(np.arange(len(members)), sizes)
    at = np.minimum(np.searchsorted(query, flat), len(query) - 1)
    held = query[at] == flat
    at, owner = at[held], owner[held]
    lengths = np.bincount(at, minlength=len(query))
    # as many of the longest lists are left out of the merge as DivideSkip's rule says
    least = int(need.min())
    skip = int(least / (0.01 * np.log2(max(2, lengths.max())) + 1)) if len(members) > 1 else 0
    skip = min(skip, least - 1, len(query))
    longest = np.argsort(-lengths, kind="stable")[:skip]
    is_long = np.zeros(len(query), bool)
    is_long[longest] = True
    counts = np.bincount(owner[~is_long[at]], minlength=len(members))  # the short lists merged
    probes = np.sort(query[longest])
    for m in np.flatnonzero(counts + skip >= need):
        if counts[m] < need[m] and len(probes):
            place = np.minimum(np.searchsorted(members[m], probes), len(members[m]) - 1)
            counts[m] += int((members[m][place] == probes).sum())
    return counts >= need


def _verify(size: int, percent: int, limit: int = 1 << 20):
    """Pairs ``a, b`` with both texts, sorted by a, that reach the threshold. Texts of ``limit`` bytes are open together."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler, opener = Shingler(size), zstandard.ZstdDecompressor()
        unpack = lambda blobs: shingler.sets(pa.array([opener.decompress(b) for b in blobs], pa.binary()))
        last, query = None, None
        for batch in batches:
            a = batch.column("a").to_pylist()
            good = np.zeros(len(a), bool)
            k = 0
            while k < len(a):
                if a[k] != last:
                    last, query = a[k], unpack([batch.column("packed_a")[k].as_py()])[0]
                end, blobs, held = k, [], 0
                while end < len(a) and a[end] == last and (not blobs or held < limit):
                    blobs.append(batch.column("packed_b")[end].as_py())
                    held += zstandard.frame_content_size(blobs[-1])
                    end += 1
                good[k:end] = divide_skip(query, unpack(blobs), percent)
                k = end
            keep = pa.array(good)
            yield pa.RecordBatch.from_arrays([batch.column("a").filter(keep), batch.column("b").filter(keep)], ["a", "b"])

    return run


def components(edges: DataFrame, name: str) -> DataFrame:
    """``cid, label`` of all vertices: each label moves to the smallest of its neighbours', then to its label's label."""
    both = persist_to_shared(edges.select("a", "b").union(edges.select(F.col("b"), F.col("a"))).distinct(), f"{name}-edges")
    labels = persist_to_shared(both.groupBy(F.col("a").alias("cid")).agg(F.least(F.min("b"), F.first("a")).alias("label")), f"{name}-labels")
    while True:
        near = both.join(labels.select(F.col("cid").alias("b"), F.col("label").alias("theirs")), "b").groupBy(F.col("a").alias("cid")).agg(F.min("theirs").alias("theirs"))
        low = labels.join(near, "cid").select("cid", "label", F.least("label", "theirs").alias("new"))
        jump = labels.select(F.col("cid").alias("new"), F.col("label").alias("further"))
        step = persist_to_shared(low.join(jump, "new", "left").select("cid", F.least("new", F.coalesce("further", "new")).alias("new"), "label"), f"{name}-step")
        labels = step.select("cid", F.col("new").alias("label"))
        if step.where("new <> label").isEmpty():
            return labels


def near_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = 3, percent: int = 90, short: int = SHORT) -> DataFrame:
    """``doc_id, mark, n_shingles, component_id, weight, label`` of every row.

    A set holds the distinct runs of ``size`` words (A-Z lower-cased, split at blanks, tabs and line ends), or the whole
    text as one if it has fewer. Rows link when 100 x intersection >= ``percent`` x union; ``component_id`` is the smallest
    id that links reach, the row's own included. Null text and text without words have the empty set, which links with
    nothing, and keep their own id. Equal sets always link, so rows that repeat are one class. A null id counts as larger
    than any other. Other columns are ignored, an empty table gives an empty one. ``mark`` is a hash of the text,
    ``weight`` the rows of its class. ``label`` numbers the components, as their ids may be null or shared; it is null for the
    empty set.

    Shingles are compared by 64-bit keys.
    """
    keyed = docs.select(F.col(id_col).cast("long").alias("doc_id"), filled(F.col(text_col).cast("string")).alias("text")).withColumn("mark", F.xxhash64("text"))
    members = persist_to_shared(keyed.mapInArrow(_members(size), MEMBERS), "join-members")
    indexed = keyed.mapInArrow(_indexed(size, percent), INDEXED).where("n > 0")
    one = F.min_by(F.struct("mark", "tokens", "sketch"), F.struct(F.col("doc_id").isNull(), "doc_id", "mark"))
    classes = indexed.groupBy("k1", "k2", "n").agg(F.min("doc_id").alias("doc_id"), F.count("*").alias("weight"), one.alias("one"))
    classes = classes.select("k1", "k2", "n", "doc_id", "weight", "one.*").withColumn("cid", F.monotonically_increasing_id())
    classes = persist_to_shared(classes, "join-classes")  # written, so the numbers stay
    p = F.col("n") - F.floor((percent * F.col("n") + 99) / 100) + 1

    postings = classes.select("cid", "n", F.posexplode_outer("tokens").alias("rank", "token"))
    df = postings.groupBy("token").agg(F.count("*").alias("df")).where("df > 1")
    shared = persist_to_shared(postings.join(df, "token").withColumn("long", F.col("df") > short), "join-postings")
    long_ranks = shared.where("long").groupBy("cid").agg(F.array_sort(F.collect_list("rank")).alias("long_ranks"))  # a class's own, few
    none = F.array().cast("array<int>")
    spare = F.least(F.col("n"), p + F.floor(p / 8) + 6)
    facts = classes.select("cid", "weight", "sketch")

    def located(rows: DataFrame) -> DataFrame:
        """Which prefix each posting is in: of the plain order (hp), or of the one with long lists last (sel)."""
        rows = rows.join(long_ranks, "cid", "left").withColumn("long_ranks", F.coalesce("long_ranks", none))
        rows = rows.withColumn("over", spare - F.size("long_ranks") < p).withColumn("hp", F.col("rank") < p)
        rows = rows.withColumn("place", F.col("rank") - F.size(F.filter("long_ranks", lambda r: r < F.col("rank"))))
        rows = rows.withColumn("sel", ~F.col("long") & ~F.col("over") & (F.col("place") < p)).where("(sel or hp) and (not long or hp)")
        return rows.drop("long_ranks")

    hard = located(shared.where("long")).where("over").select("token").distinct()
    hard = persist_to_shared(hard, "join-hard")
    easy = shared.where("not long").unionByName(shared.where("long").join(hard, "token", "left_semi"))

    def proposed(extra: DataFrame | None, name: str) -> DataFrame:
        # a class's lists in its order, at most as many as its prefix and an eighth; without spare room long ones pair as well
        last = Window.partitionBy("cid").orderBy("rank").rowsBetween(-SEEN, -1)
        rows = located(easy).withColumn("earlier", F.collect_list(F.when(~F.col("long") | F.col("over"), F.col("token"))).over(last))
        rows = rows.join(facts.withColumn("label", F.lit(0).cast("long")) if extra is None else facts.join(extra, "cid"), "cid")
        rows = rows.withColumn("blocks", F.when(F.col("long"), F.ceil(F.col("df") / short)).otherwise(1))
        rows = rows.withColumn("block", F.pmod(F.xxhash64("cid"), F.col("blocks")).cast("int"))
        rows = rows.withColumn("other", F.explode_outer(F.sequence(F.lit(0), (F.col("blocks") - 1).cast("int"))))
        rows = rows.withColumn("low", F.least("block", "other")).withColumn("high", F.greatest("block", "other"))
        rows = rows.select("token", "low", "high", "block", "cid", "n", "place", "rank", "weight", "sel", "hp", "over", "label", "earlier", "sketch")
        rows = rows.repartition("token", "low", "high").sortWithinPartitions("token", "low", "high")
        return persist_to_shared(rows.mapInArrow(_propose(percent, extra is None), PROPOSED).distinct(), name)

    def verified(pairs: DataFrame, name: str) -> DataFrame:
        sides = pairs.join(texts.withColumnRenamed("cid", "b").withColumnRenamed("packed", "packed_b"), "b")
        sides = sides.join(texts.withColumnRenamed("cid", "a").withColumnRenamed("packed", "packed_a"), "a").sortWithinPartitions("a")
        return persist_to_shared(sides.select("a", "b", "packed_a", "packed_b").mapInArrow(_verify(size, percent), PROPOSED), name)

    first = proposed(None, "join-centres")
    able = persist_to_shared(first.select(F.col("a").alias("cid")).union(first.select("b")).distinct(), "join-able")
    wanted = able.join(classes.select("cid", "doc_id", "mark"), "cid")
    packed = keyed.mapInArrow(_pack, "doc_id long, mark long, packed binary").withColumnRenamed("doc_id", "__id").withColumnRenamed("mark", "__mark")
    texts = packed.join(wanted, F.col("__id").eqNullSafe(F.col("doc_id")) & (F.col("__mark") == F.col("mark"))).select("cid", "packed")
    texts = persist_to_shared(texts.dropDuplicates(["cid"]), "join-texts")
    links = verified(first.where("a < b"), "join-links")
    labels = components(links, "join-first")
    # a pair that is left has both members among those that could pair before
    partners = able.join(labels, "cid", "left").withColumn("label", F.coalesce("label", "cid"))
    more = verified(proposed(partners, "join-rest"), "join-more")
    if not more.isEmpty():
        labels = components(links.unionByName(more), "join-all")
    rooted = classes.select("cid", "k1", "k2", "n", "doc_id", "weight").join(labels, "cid", "left").withColumn("label", F.coalesce("label", "cid"))
    rooted = persist_to_shared(rooted, "join-rooted")
    least = rooted.groupBy("label").agg(F.min("doc_id").alias("component_id"))
    reached = persist_to_shared(rooted.join(least, "label").select("k1", "k2", "n", "component_id", "weight", "label"), "join-components")
    out = members.join(reached, ["k1", "k2", "n"], "left")
    return out.select("doc_id", "mark", F.col("n").cast("long").alias("n_shingles"), F.when(F.col("n") == 0, F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"), "weight", "label")


def keep_one(docs: DataFrame, **options) -> DataFrame:
    """The row with the smallest id of each component, with all columns; rows without words all stay.

    Components that share their smallest id, or have no id at all, keep a row each. Of different texts under that id, the one
    with the smallest hash stays.
    """
    near = near_components(docs, **options).where("n_shingles = 0 or doc_id <=> component_id")
    empty = F.col("n_shingles") == 0
    near = near.groupBy("label", F.when(empty, F.col("doc_id")), F.when(empty, F.col("mark"))).agg(F.min("doc_id").alias("__id"), F.min("mark").alias("__mark"))
    near = near.select("__id", "__mark", F.col("label").alias("__label"))
    marked = docs.withColumn("__text_mark", F.xxhash64(filled(F.col("text").cast("string"))))
    kept = marked.join(near, F.col("doc_id").cast("long").eqNullSafe(F.col("__id")) & (F.col("__text_mark") == F.col("__mark")))
    full = kept.where("__label is not null").dropDuplicates(["__label"])
    return full.unionByName(kept.where("__label is null")).select(*docs.columns)
