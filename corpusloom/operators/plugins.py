"""Models plugged in as batch functions; none is needed by the core.

A plug-in is a factory without arguments. It runs once per Python worker, and
what it returns is called with whole Arrow batches.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, IntegerType

Factory = Callable[[], Callable]

_registry: dict[str, dict[str, Factory]] = {"counter": {}, "encoder": {}, "scorer": {}, "generator": {}}


def _register(kind: str, name: str, factory: Factory) -> None:
    _registry[kind][name] = factory


def register_token_counter(name: str, factory: Factory) -> None:
    """``factory()`` → ``count(list[str]) -> list[int]``."""
    _register("counter", name, factory)


def register_encoder(name: str, factory: Factory) -> None:
    """``factory()`` → ``encode(list[str], mode) -> (dense rows, sparse pairs)``."""
    _register("encoder", name, factory)


def register_scorer(name: str, factory: Factory) -> None:
    """``factory()`` → ``score(list[(query, text)]) -> list[float]``."""
    _register("scorer", name, factory)


def register_generator(name: str, factory: Factory) -> None:
    """``factory()`` → ``generate(list[str]) -> list[str]``."""
    _register("generator", name, factory)


def plugin(kind: str, name: str) -> Factory:
    try:
        return _registry[kind][name]
    except KeyError:
        raise ValueError(f"unknown {kind}: {name}; registered: {sorted(_registry[kind])}") from None


def _once(factory: Factory) -> Callable[[], Callable]:
    cache: list[Callable] = []

    def get() -> Callable:
        if not cache:
            cache.append(factory())
        return cache[0]

    return get


def token_counter(name: str):
    """A registered token counter as a column function."""
    get = _once(plugin("counter", name))

    @F.pandas_udf(IntegerType())
    def count(texts: pd.Series) -> pd.Series:
        return pd.Series(get()(texts.fillna("").tolist()), dtype="int32")

    return count


#: Bytes of text that are encoded before their vectors leave the worker.
ENCODED_BYTES = 2 << 20

EMBEDDING_FIELDS = "dense array<float>, sparse struct<indices: array<int>, values: array<float>>"

# Input prefixes of the older single-vector models.
MODEL_PREFIXES = {"e5": ("passage: ", "query: "), "bge_m3": ("", ""), "jina_v3": ("", ""), "qwen": ("", "")}


def embed_batch(
    rows: DataFrame, text: str, name: str = "hashing", mode: str = "document", batch: int = 8, prefix: str = ""
) -> DataFrame:
    """Append ``dense`` and ``sparse`` to rows, encoding ``batch`` texts per call.

    A Python worker opens about ``ENCODED_BYTES`` of text at a time, or one row, whatever the size of its batches.
    """
    get = _once(plugin("encoder", name))
    columns, limit = rows.columns, ENCODED_BYTES

    def lists(parts: list, kind: pa.DataType) -> pa.Array:
        ends = np.concatenate([[0], np.cumsum([len(p) for p in parts], dtype=np.int64)]).astype(np.int32)
        return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate([np.zeros(0), *map(np.asarray, parts)]), kind, safe=False))

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            sums = np.cumsum(pc.fill_null(pc.binary_length(whole.column(text)), 0).to_numpy(zero_copy_only=False).astype(np.int64))
            start = 0
            while start < whole.num_rows:
                stop = max(start + 1, int(np.searchsorted(sums, (sums[start - 1] if start else 0) + limit, "right")))
                part = whole.slice(start, stop - start)
                start = stop
                texts = [prefix + t for t in part.column(text).to_pylist()]
                dense, sparse = [], []
                for at in range(0, len(texts), batch):
                    d, s = get()(texts[at : at + batch], mode)
                    dense += list(d)
                    sparse += list(s)
                if len(dense) != len(texts) or len(sparse) != len(texts):
                    raise ValueError("encoder returned a different number of vectors")
                pairs = pa.StructArray.from_arrays([lists([i for i, _ in sparse], pa.int32()), lists([v for _, v in sparse], pa.float32())], ["indices", "values"])
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in columns), lists(dense, pa.float32()), pairs], [*columns, "dense", "sparse"])

    schema = ", ".join(f"`{n}` {t}" for n, t in rows.dtypes) + ", " + EMBEDDING_FIELDS
    return rows.mapInArrow(encode, schema)


def model_score(pairs: DataFrame, name: str) -> DataFrame:
    """Append ``reranker_score`` to ``(query, text)`` rows with a registered scorer."""
    get = _once(plugin("scorer", name))

    @F.pandas_udf(DoubleType())
    def score(q: pd.Series, t: pd.Series) -> pd.Series:
        values = list(get()(list(zip(q.tolist(), t.tolist()))))
        if len(values) != len(q):
            raise ValueError("score count does not match candidate count")
        return pd.Series(values, dtype="float64")

    return pairs.withColumn("reranker_score", score("query", "text"))


def hashing_encoder(dims: int = 64) -> Factory:
    """A deterministic encoder for tests and examples: hashed token counts."""

    def build() -> Callable:
        import hashlib
        import math
        import re
        import unicodedata
        from collections import Counter

        token = re.compile(r"\d+(?:[-.]\d+)*|[^\W\d_]+(?:['’][^\W\d_]+)*")
        seen: dict[str, tuple[int, int, int]] = {}

        def place(word: str) -> tuple[int, int, int]:
            if word not in seen:
                if len(seen) >= 200_000:  # what is kept saves time only
                    seen.clear()
                h = hashlib.md5(word.encode()).hexdigest()
                seen[word] = int(h[:8], 16) % dims, 1 if int(h[8], 16) < 8 else -1, int(h[:8], 16) & 0x7FFFFFFF
            return seen[word]

        def encode(texts: list[str], mode: str):
            dense, sparse = [], []
            for text in texts:
                folded = unicodedata.normalize("NFC", text).casefold().replace("i̇", "i")
                counts = Counter(token.findall(folded))
                vector, merged = np.zeros(dims), Counter()
                for word, n in counts.items():
                    at, sign, index = place(word)
                    vector[at] += sign * n
                    merged[index] += n
                length = float(np.sqrt((vector * vector).sum()))
                if length == 0:
                    vector[0], length = 1.0, 1.0
                dense.append(vector / length)
                keys = sorted(merged)
                sparse.append((keys, [1 + math.log(merged[i]) for i in keys]))
            return dense, sparse

        return encode

    return build


def extractive_generator() -> Callable:
    """Answers with the first evidence item's opening sentence, as JSON."""
    import json
    import re

    def generate(prompts: list[str]) -> list[str]:
        out = []
        for prompt in prompts:
            found = re.search(r'"evidence_id":"(E\d+)".*?"content":"((?:[^"\\]|\\.)*)"', prompt, re.S)
            if not found:
                out.append('{"status":"insufficient_evidence","answer_blocks":[],"limitations":["no evidence"]}')
                continue
            text = json.loads(f'"{found.group(2)}"')
            opening = re.split(r"(?<=[.!?])\s", text, maxsplit=1)[0][:2000]
            out.append(
                json.dumps(
                    {
                        "status": "answered",
                        "answer_blocks": [{"text": opening, "evidence_ids": [found.group(1)]}],
                        "limitations": [],
                    },
                    ensure_ascii=False,
                )
            )
        return out

    return generate


def simple_counter() -> Callable:
    import re

    pattern = re.compile(r"\w+|[^\w\s]")
    return lambda texts: [len(pattern.findall(t)) for t in texts]


register_encoder("hashing", hashing_encoder())
register_generator("extractive", extractive_generator)
register_token_counter("word_punctuation", simple_counter)
