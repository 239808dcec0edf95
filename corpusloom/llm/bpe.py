"""BPE by speculation: longest matches are proposed, adjacent pairs are verified, and only failing words are merged."""

from __future__ import annotations

import heapq
import json
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import filled, slices

#: Words a worker remembers: two generations of so many. It bounds memory, not results.
REMEMBERED = 300_000
#: Tested pairs a worker remembers.
PAIRS = 300_000
#: Symbols up to which a word is merged by looking at all its pairs each time.
SHORT = 40
#: Text bytes encoded before a batch is handed on.
OUT_BYTES = 2 << 20

# Fixed values of the vocabulary's format: its white space, its word pattern and its byte alphabet.
_WORDS = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\t-\r \x85\xa0  -     　\p{L}\p{N}]+")

#: Python's split() takes these four for white space too; a text with one of them is split by the vocabulary's own.
_SEPARATORS = regex.compile("[\x1c-\x1f]")
_SPACE = regex.compile(r"[\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]+")


def _alphabet() -> list[str]:
    """A printable character for each byte: itself where it is printable Latin-1, else the next one from 256 on."""
    own = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    spare = iter(range(256, 512))
    return [chr(b if b in own else next(spare)) for b in range(256)]


class WordBpe:
    """Encoder and decoder of one vocabulary file with word ends."""

    def __init__(self, path: str) -> None:
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        model = spec["model"]
        self.end = model["end_of_word_suffix"]
        self.ids: dict[str, int] = model["vocab"]
        merges = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in model["merges"]]
        self.rank = {pair: i for i, pair in enumerate(merges)}
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.split = regex.compile("(" + "|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        self.names = {i: s for s, i in self.ids.items()} | {i: s for s, i in self.special.items()}
        self.coded = {i: i.to_bytes(4, "little") for i in self.names}
        self.width = max(map(len, self.ids))
        self.bytes = str.maketrans({chr(b): c for b, c in enumerate(_alphabet())})
        self.pairs: dict[int, bool] = {}  # code of two ids -> do they stay apart
        self.whole: dict[int, bool] = {}  # id -> do merges reach it
        self.known: dict[str, tuple[bytes, str]] = {}  # by word
        self.seen: dict[str, tuple[bytes, str]] = {}  # by what stands between white space
        self.old: dict[str, tuple[bytes, str]] = {}

    # exact merging

    def symbols(self, word: str) -> list[str]:
        """Byte characters of a word, the last with the word end."""
        plain = word.isascii() and word.isprintable()  # these bytes stand for themselves
        chars = list(word if plain else word.encode("utf-8").decode("latin-1").translate(self.bytes))
        chars[-1] += self.end
        return chars

    def merge(self, parts: list[str]) -> list[str]:
        """Apply merges, the lowest rank first and the leftmost of equal ones; long words with a heap over a linked list."""
        n = len(parts)
        if n <= SHORT:
            parts, none, rank = parts[:], len(self.rank), self.rank
            while len(parts) > 1:
                ranks = [rank.get(p, none) for p in zip(parts, parts[1:])]
                if (least := min(ranks)) == none:
                    break
                i = ranks.index(least)
                parts[i : i + 2] = [parts[i] + parts[i + 1]]
            return parts
        parts, before, after = parts[:], list(range(-1, n - 1)), [*range(1, n), -1]
        heap = [(r, i, parts[i], parts[i + 1]) for i in range(n - 1) if (r := self.rank.get((parts[i], parts[i + 1]))) is not None]
        heapq.heapify(heap)
        while heap:
            _, i, left, right = heapq.heappop(heap)
            j = after[i]
            if j < 0 or parts[i] != left or parts[j] != right:
                continue  # one of them has changed since
            parts[i], parts[j], after[i] = left + right, "", after[j]
            if after[i] >= 0:
                before[after[i]] = i
            for a, b in ((before[i], i), (i, after[i])):
                if a >= 0 and b >= 0 and (r := self.rank.get((parts[a], parts[b]))) is not None:
                    heapq.heappush(heap, (r, a, parts[a], parts[b]))
        return [p for p in parts if p]

    def cut(self, name: str) -> list[str]:
        """The symbols a token's name stands for."""
        return [*name[: -len(self.end) - 1], name[-len(self.end) - 1 :]] if name.endswith(self.end) and len(name) > len(self.end) else [*name]

    def reached(self, token: int) -> bool:
        if token not in self.whole:
            name = self.names[token]
            self.whole[token] = self.merge(self.cut(name)) == [name]
        return self.whole[token]

    # speculation and verification

    def propose(self, parts: list[str]) -> list[int]:
        """Longest match from the left; empty where no token fits."""
        out, i, n, ids = [], 0, len(parts), self.ids
        text = "".join(parts)
        stop = len(text) - len(self.end)  # symbols before the last have one character each
        while i < n:
            for j in range(min(n, i + self.width), i, -1):
                token = ids.get(text[i : len(text) if j == n else min(j, stop)])
                if token is not None:
                    out.append(token)
                    i = j
                    break
            else:
                return []
        return out

    def apart(self, left: int, right: int) -> bool:
        a, b = self.names[left], self.names[right]
        return self.merge(self.cut(a) + self.cut(b)) == [a, b]

    def learn(self, words: list[str]) -> None:
        """Encode new words together: a word's proposal stands if merges reach each of its tokens and no merge crosses
        between two neighbours; then it is what merging gives. The test runs once for each distinct pair of the batch."""
        cut = [self.symbols(w) for w in words]
        proposed = [self.propose(c) for c in cut]
        lengths = np.array([len(p) for p in proposed])
        flat = np.fromiter((t for p in proposed for t in p), np.int64, int(lengths.sum()))
        owner = np.repeat(np.arange(len(words)), lengths)
        good = lengths > 0
        tokens, at = np.unique(flat, return_inverse=True)
        whole = np.array([self.reached(int(t)) for t in tokens], bool)
        np.logical_and.at(good, owner, whole[at])
        beside = owner[1:] == owner[:-1]
        codes, at = np.unique((flat[:-1] << 32 | flat[1:])[beside], return_inverse=True)
        fits = np.empty(len(codes), bool)
        for k, code in enumerate(codes.tolist()):
            if code not in self.pairs:
                self.pairs[code] = self.apart(code >> 32, code & 0xFFFFFFFF)
            fits[k] = self.pairs[code]
        np.logical_and.at(good, owner[1:][beside], fits[at])
        coded, names = self.coded, self.names
        for word, parts, ids, stands in zip(words, cut, proposed, good.tolist()):
            if not stands:
                # symbols that no token names are left out, as the vocabulary has no unknown token
                ids = [self.ids[p] for p in self.merge(parts) if p in self.ids]
            self.known[word] = (b"".join([coded[i] for i in ids]), " ".join([names[i] for i in ids]))

    def pieces(self, text: str) -> list[tuple[str, bool]]:
        if self.split is None or "<|" not in text:
            return [(text, False)]
        return [(p, i % 2 == 1) for i, p in enumerate(self.split.split(text)) if p]

    @staticmethod
    def chunks(text: str) -> list[str]:
        """The normalised text between white space; no word reaches over it."""
        if not text.isascii():
            # capital sigma becomes a plain one everywhere; str.lower() would write a final one at a word's end
            text = unicodedata.normalize("NFC", text).replace("Σ", "σ")
        return [c for c in _SPACE.split(text.lower()) if c] if _SEPARATORS.search(text) else text.lower().split()

    def remember(self, chunks: list[str]) -> None:
        """Encode new chunks: their new words are learnt together."""
        cut = [_WORDS.findall(c) for c in chunks]
        new = {w for words in cut for w in words if w not in self.known}
        if new:
            self.learn(sorted(new))
        for chunk, words in zip(chunks, cut):
            found = [self.known[w] for w in words]
            self.seen[chunk] = found[0] if len(found) == 1 else (b"".join([f[0] for f in found]), " ".join([f[1] for f in found if f[0]]))

    def encode_batch(self, texts: list[str]) -> list[tuple[int, bytes, str]]:
        """Tokens, their ids as little-endian 32-bit numbers, and the decoded text, for each text."""
        split = [[(special, p if special else self.chunks(p)) for p, special in self.pieces(t)] for t in texts]
        words = {w for parts in split for special, ws in parts if not special for w in ws}
        new = words - self.seen.keys()
        if len(self.seen) + len(new) > REMEMBERED:
            self.known = {}
            self.pairs = self.pairs if len(self.pairs) < PAIRS else {}
            self.old, self.seen, new = self.seen, {}, words
        if new and self.old:
            again = new & self.old.keys()
            self.seen.update((w, self.old[w]) for w in again)
            new -= again
        if new:
            self.remember(sorted(new))
        out, seen = [], self.seen
        for parts in split:
            found = []
            for special, ws in parts:
                found += [(self.special[ws].to_bytes(4, "little"), ws)] if special else [seen[w] for w in ws]
            ids = b"".join([f[0] for f in found])
            out.append((len(ids) // 4, ids, " ".join([f[1] for f in found if f[0]])))
        return out

    def decode(self, ids: np.ndarray) -> str:
        return " ".join(self.names[int(i)] for i in ids)


SCHEMA = "doc_id long, n_tokens long, ids binary, decoded string"


def encode(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, n_tokens, ids, decoded`` of every row. ``ids`` are little-endian unsigned 32-bit numbers.

    Whole texts are encoded, of any length. Null is the empty text: no tokens, empty bytes, empty decoded text. Rows that
    repeat are encoded each; other columns are ignored. ``path`` names the vocabulary file on the executors. Map only.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = WordBpe(path)
        for batch in (piece for whole in batches for piece in slices(whole, "text", OUT_BYTES)):
            rows = model.encode_batch(batch.column("text").to_pylist())
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.binary()), pa.array([r[2] for r in rows], pa.string())],
                ["doc_id", "n_tokens", "ids", "decoded"],
            )

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), filled(text_col).alias("text")).mapInArrow(run, SCHEMA)
