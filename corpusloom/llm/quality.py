"""Document quality by hierarchical empirical Bayes: a classifier's evidence and shrunken rates of host and path."""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import persist_to_shared, slices

#: Labelled rows the classifier is fitted on, at most; the ones with the smallest id hashes.
TRAIN_ROWS = 20_000
#: A word is evidence of a toxic text if so many toxic rows, and so large a part of them, hold it, and so large a part of the
#: rows that hold it are toxic. Words that only lean to one side add up to errors over a long text. The model keeps so many.
MIN_ROWS, MIN_PART, PRECISION, MODEL_WORDS = 5, 0.01, 0.97, 20_000
#: Log odds of a document stay within this; the part of the site's log odds that is added.
CLIP, SITE = 8.0, 0.5
#: Edges of the style measures' bins.
EDGES = {
    "capitals": (0.003, 0.03, 0.06, 0.12, 0.25, 0.5),
    "signs": (0.004, 0.01, 0.04, 0.06, 0.1, 0.2, 0.3),
    "distinct": (0.05, 0.15, 0.3, 0.45, 0.55, 0.7, 0.85),
    "bars": (0.01, 0.05, 0.2, 0.4),
    "width": (4.0, 5.0, 5.6, 6.4, 7.2, 8.2, 10.0),
    "lines": (0.3, 0.6, 0.9),
}
_WORD = re.compile(r"[^\W_]+")
_PUNCT = re.compile(r"[!-/:-@\[-`{-~]")
_UPPER = re.compile(r"[A-Z]")


def features(text: str) -> tuple[list[str], set[str]]:
    """Style bins and the distinct lower-case words of a text."""
    tokens = text.split()
    n, size = max(1, len(tokens)), max(1, len(text))
    lines = text.split("\n")
    ascii_only = text.encode("ascii", "ignore")
    capitals = len(ascii_only) - len(ascii_only.translate(None, b"ABCDEFGHIJKLMNOPQRSTUVWXYZ"))
    signs = len(ascii_only) - len(ascii_only.translate(None, b"!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"))
    measures = {
        "capitals": capitals / size, "signs": signs / size, "distinct": len(set(tokens)) / n if n >= 20 else 1.0, "bars": text.count("|") / n,
        "width": size / n, "lines": len(set(lines)) / len(lines),
    }
    if n < 20:
        measures = {k: measures[k] for k in ("bars", "lines")}
    bins = [f"{k} {int(np.searchsorted(EDGES[k], v, 'right'))}" for k, v in measures.items()] if tokens else ["empty"]
    return bins, set(_WORD.findall(text.lower()))


@dataclass(frozen=True)
class Model:
    """Log odds of low quality by style bin, and of a toxic text by word, with their priors."""

    low: dict[str, float]
    low_prior: float
    toxic: dict[str, float]
    toxic_prior: float

    def logit(self, text: str) -> float:
        bins, words = features(text)
        low = self.low_prior + sum(self.low.get(b, 0.0) for b in bins)
        found = words & self.toxic.keys()
        toxic = self.toxic_prior + sum(self.toxic[w] for w in found)
        clean = 1.0 / (1.0 + math.exp(min(low, 30.0))) * 1.0 / (1.0 + math.exp(min(toxic, 30.0)))
        return max(-CLIP, min(CLIP, math.log((1 - clean) / clean) if 0 < clean < 1 else (CLIP if clean <= 0 else -CLIP)))


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Documents of each class that show each feature, summed over a task's rows."""
    counts: dict[str, Counter] = {k: Counter() for k in ("low 0", "low 1", "toxic 0", "toxic 1")}
    for batch in batches:
        for text, quality, toxic in zip(*(batch.column(c).to_pylist() for c in ("text", "quality", "toxic"))):
            bins, words = features(text or "")
            if quality is not None:
                counts[f"low {int(quality == 0)}"].update([*bins, ""])
            if toxic is not None:
                counts[f"toxic {int(toxic != 0)}"].update([*words, ""])
    kinds = [k for k, c in counts.items() for _ in c]
    names = [x for c in counts.values() for x in c]
    sums = [n for c in counts.values() for n in c.values()]
    for a in range(0, len(kinds), 100_000):
        yield pa.RecordBatch.from_arrays([pa.array(kinds[a : a + 100_000], pa.string()), pa.array(names[a : a + 100_000], pa.string()), pa.array(sums[a : a + 100_000], pa.int64())], ["kind", "feature", "n"])


def fit(docs: DataFrame, labels: DataFrame, rows: int = TRAIN_ROWS) -> Model:
    """Count features over a bounded sample of labelled rows; what is collected is the model, of bounded size."""
    sample = labels.where(F.col("doc_id").isNotNull()).select("doc_id", "quality", "toxic").orderBy(F.xxhash64("doc_id"), "doc_id", "quality", "toxic").limit(rows)
    chosen = docs.select("doc_id", F.col("text").cast("string")).join(F.broadcast(sample), "doc_id")  # at most ``rows`` rows are sent
    counts = chosen.mapInArrow(_count, "kind string, feature string, n long").groupBy("feature").pivot("kind", ["low 0", "low 1", "toxic 0", "toxic 1"]).agg(F.sum("n"))
    counts = persist_to_shared(counts.na.fill(0), "quality-counts")
    totals = counts.where("feature = ''").first()
    if totals is None:
        return Model({}, -CLIP, {}, -CLIP)
    odds = lambda a, b, of_a, of_b: math.log((a + 0.5) / (of_a + 1)) - math.log((b + 0.5) / (of_b + 1))
    low_n, ok_n, toxic_n, clean_n = totals["low 1"], totals["low 0"], totals["toxic 1"], totals["toxic 0"]
    styles = counts.where("feature <> '' and `low 0` + `low 1` > 0").collect()  # one row a bin
    sure = F.col("toxic 1") >= PRECISION * (F.col("toxic 1") + F.col("toxic 0"))
    strong = counts.where((F.col("feature") != "") & (F.col("toxic 1") >= max(MIN_ROWS, MIN_PART * toxic_n)) & sure)
    strong = strong.orderBy(F.desc("toxic 1"), "feature").limit(MODEL_WORDS).collect()
    prior = lambda a, b: math.log((a + 0.5) / (b + 0.5))
    return Model(
        {r["feature"]: odds(r["low 1"], r["low 0"], low_n, ok_n) for r in styles} if low_n else {}, prior(low_n, ok_n) if low_n else -CLIP,
        {r["feature"]: odds(r["toxic 1"], r["toxic 0"], toxic_n, clean_n) for r in strong} if toxic_n else {}, prior(toxic_n, clean_n) if toxic_n else -CLIP,
    )


def with_evidence(docs: DataFrame, model: Model, keep_text: bool = True) -> DataFrame:
    """The columns of ``docs`` and ``evidence``, the document's log odds of being bad."""
    columns = docs.columns if keep_text else [c for c in docs.columns if c != "text"]
    schema = T.StructType([*(f for f in docs.schema.fields if f.name in columns), T.StructField("__evidence", T.DoubleType())])

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (piece for whole in batches for piece in slices(whole, "text", 8 << 20)):
            logits = pa.array([model.logit(t or "") for t in batch.column("text").to_pylist()], pa.float64())
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in columns), logits], [*columns, "__evidence"])

    return docs.mapInArrow(score, schema)


def _logit(p: Column) -> Column:
    p = F.greatest(F.lit(1e-6), F.least(F.lit(1 - 1e-6), p))
    return F.ln(p / (1 - p))


def _strength(groups: DataFrame, mean: float) -> float:
    """Pseudo-counts of the prior that the spread of group rates around ``mean`` suggests (method of moments)."""
    spread = F.sum(F.col("n") * F.pow(F.col("bad") / F.col("n") - mean, 2)) / F.sum("n")
    noise = F.sum(F.lit(mean * (1 - mean))) / F.sum("n")
    between = (groups.agg((spread - noise).alias("x")).first()["x"]) or 0.0
    return min(1e6, max(1.0, mean * (1 - mean) / between - 1)) if between > 1e-9 else 1e6


def site_rates(scored: DataFrame, host: str = "source", path: str = "lang") -> DataFrame:
    """``__host, __path, host_rate, path_rate, shift``: a path's rate is shrunk to its host's, and a host's to the global one.

    Groups are sums with partial aggregates. ``shift`` is what a document's log odds gain from its path.
    """
    p = 1 / (1 + F.exp(-F.col("__evidence")))
    paths = scored.groupBy(F.col(host).cast("string").alias("__host"), F.col(path).cast("string").alias("__path")).agg(F.sum(p).alias("bad"), F.count("*").alias("n"))
    paths = persist_to_shared(paths, "quality-paths")
    hosts = paths.groupBy("__host").agg(F.sum("bad").alias("bad"), F.sum("n").alias("n"))
    total = hosts.agg(F.sum("bad").alias("bad"), F.sum("n").alias("n")).first()
    mean = min(1 - 1e-6, max(1e-6, (total["bad"] or 0.0) / total["n"])) if total["n"] else 0.5
    k_host, k_path = _strength(hosts, mean), _strength(paths, mean)
    hosts = hosts.select(F.col("__host").alias("__own"), ((F.col("bad") + k_host * mean) / (F.col("n") + k_host)).alias("host_rate"))
    rates = paths.join(hosts, F.col("__host").eqNullSafe(F.col("__own"))).withColumn("path_rate", (F.col("bad") + k_path * F.col("host_rate")) / (F.col("n") + k_path))
    rates = rates.withColumn("shift", SITE * (_logit(F.col("path_rate")) - math.log(mean / (1 - mean))))
    return persist_to_shared(rates.select("__host", "__path", "host_rate", "path_rate", "shift"), "quality-rates")


def judge(docs: DataFrame, labels: DataFrame, host: str = "source", path: str = "lang", keep_text: bool = False, rows: int = TRAIN_ROWS) -> DataFrame:
    """The columns of ``docs`` (without ``text`` unless asked) and ``__evidence, host_rate, path_rate, __odds``.

    ``__odds`` above 0 says that the document is more likely bad, low in quality or toxic, than not. Null text is the empty
    text; null host and path are groups of their own; repeated rows count each. Without labelled rows nothing is bad.
    Texts never move: only the table of site rates is joined.
    """
    model = fit(docs, labels, rows)
    scored = persist_to_shared(with_evidence(docs.select(*dict.fromkeys(["doc_id", "text", host, path])), model, keep_text=False), "quality-scores")
    rates = site_rates(scored, host, path)
    out = with_evidence(docs, model) if keep_text else scored
    same = F.col(host).cast("string").eqNullSafe(F.col("__host")) & F.col(path).cast("string").eqNullSafe(F.col("__path"))
    return out.join(rates, same).withColumn("__odds", F.col("__evidence") + F.col("shift")).drop("__host", "__path", "shift")


def keep_good(docs: DataFrame, labels: DataFrame, **options) -> DataFrame:
    """The rows of ``docs`` that :func:`judge` does not reject, with their columns."""
    return judge(docs, labels, keep_text=True, **options).where("__odds <= 0").select(*docs.columns)
