"""Context expansion, evidence selection, source selectors and budgets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import ids
from ..functions import text as tx
from . import sweeps

# Relation priorities and the order relations are inspected in.
RELATION_PRIORITY = {
    "parent": 3, "continuation_of": 2, "continuation": 2, "previous_sibling": 4, "next_sibling": 4, "reference": 5,
    "referenced_by": 5, "annex_parent": 6, "table_parent": 6, "approved_document": 7,
}


def _by_relation(values: dict[str, int]) -> Column:
    out = None
    for rel, value in values.items():
        out = F.when(F.col("rel") == rel, value) if out is None else out.when(F.col("rel") == rel, value)
    return out


def corpus_artifacts(children: DataFrame, parents: DataFrame) -> DataFrame:
    """Children and parents of a build as the artifacts that its edges lead to."""
    below = children.select(
        F.col("chunk_id").alias("artifact_id"), F.lit("child").alias("artifact_type"), "split_count", "continuation_of", "logical_chunk_id"
    )
    above = parents.select(
        F.col("parent_chunk_id").alias("artifact_id"), F.lit("parent").alias("artifact_type"), F.lit(None).cast("int").alias("split_count"),
        F.lit(None).cast("string").alias("continuation_of"), F.lit("").alias("logical_chunk_id"),
    )
    return below.unionByName(above)


def inspect_edges(seeds: DataFrame, edges: DataFrame, artifacts: DataFrame, min_confidence: float = 0.8) -> DataFrame:
    """Every edge of every seed with the decision taken on it.

    ``seeds``: ``query_id, chunk_id, final_rank``. ``edges``: ``src, rel, dst,
    direction, confidence, resolved, edge_no``. ``artifacts``: ``artifact_id,
    artifact_type, split_count, continuation_of, logical_chunk_id``.
    """
    target = artifacts.select(
        F.col("artifact_id").alias("dst"), "artifact_type", F.col("split_count").alias("t_split"),
        F.col("continuation_of").alias("t_cont"), F.col("logical_chunk_id").alias("t_logical"),
    )
    own = artifacts.filter("artifact_type = 'child'").select(
        F.col("artifact_id").alias("src"), F.col("split_count").alias("s_split"), F.col("continuation_of").alias("s_cont"),
        F.col("logical_chunk_id").alias("s_logical"),
    )
    rows = (
        seeds.withColumnRenamed("chunk_id", "src")
        .join(edges, "src")
        .join(own, "src", "left")
        .join(target, "dst", "left")
    )
    sibling = F.col("rel").isin("previous_sibling", "next_sibling")
    cited = F.col("rel").isin("reference", "referenced_by")
    structural = F.coalesce(
        (F.coalesce("s_split", F.lit(1)) > 1)
        | (F.coalesce("t_split", F.lit(1)) > 1)
        | F.coalesce(F.col("t_cont") == F.col("src"), F.lit(False))
        | F.coalesce(F.col("s_cont") == F.col("dst"), F.lit(False))
        | F.coalesce((F.col("s_logical") != "") & (F.col("s_logical") == F.col("t_logical")), F.lit(False)),
        F.lit(False),
    )
    why = (
        F.when(cited & (~F.col("resolved") | F.col("dst").isNull()), "unresolved reference")
        .when(cited & (F.col("confidence") < min_confidence), "reference confidence below threshold")
        .when(F.col("artifact_type").isNull(), "relation target missing")
        .when(sibling & ~structural, "ordinary sibling lacks structural-completion signal")
    )
    return rows.filter(cited | F.col("dst").isNotNull()).select(
        "query_id", "final_rank", "src", "rel", "dst", "direction", "confidence", "edge_no", "artifact_type",
        _by_relation(RELATION_PRIORITY).alias("priority"),
        _by_relation({r: i for i, r in enumerate(RELATION_PRIORITY)}).alias("rel_no"),
        why.alias("excluded"),
    )


def expand(seeds: DataFrame, inspected: DataFrame, per_seed: int = 4, per_query: int = 16) -> tuple[DataFrame, DataFrame]:
    """Seeds and their depth-one context, and one diagnostic row per decision.

    Cap per seed by (priority, id), merge provenance per target, then cap per
    query by (priority, seed rank, id).
    """
    usable = inspected.filter(F.col("excluded").isNull())
    w = Window.partitionBy("query_id", "src").orderBy("priority", "dst", "rel_no", "edge_no")
    numbered = usable.withColumn("rn", F.row_number().over(w))
    taken = numbered.filter(F.col("rn") <= per_seed)
    order = F.struct("final_rank", "rn")
    path = F.struct("final_rank", "rn", F.col("src").alias("seed"), "rel", "direction", "confidence")
    merged = taken.groupBy("query_id", "dst").agg(
        F.min_by(F.struct("priority", "final_rank", "rel", "src", "artifact_type"), order).alias("f"),
        F.array_sort(F.collect_list(path)).alias("provenance"),
    ).select("query_id", "dst", "f.*", "provenance")
    g = Window.partitionBy("query_id").orderBy("priority", "final_rank", "dst")
    ranked = merged.withColumn("position", F.row_number().over(g))
    kept = ranked.filter(F.col("position") <= per_query)
    seed_path = F.array(
        F.struct(
            "final_rank", F.lit(0).alias("rn"), F.col("chunk_id").alias("seed"), F.lit(None).cast("string").alias("rel"),
            F.lit(None).cast("string").alias("direction"), F.lit(None).cast("double").alias("confidence"),
        )
    )
    candidates = seeds.select(
        "query_id", F.col("chunk_id").alias("artifact_id"), F.lit("child").alias("artifact_type"), F.lit("seed").alias("role"),
        F.lit(None).cast("string").alias("relation_type"), F.lit(1).alias("priority"), "final_rank", F.col("chunk_id").alias("seed_chunk_id"),
        seed_path.alias("provenance"),
    ).unionByName(
        kept.select(
            "query_id", F.col("dst").alias("artifact_id"), "artifact_type", F.lit("expanded").alias("role"), F.col("rel").alias("relation_type"),
            "priority", "final_rank", F.col("src").alias("seed_chunk_id"), "provenance",
        )
    )

    def note(df: DataFrame, reason: Column, decision: str) -> DataFrame:
        return df.select("query_id", F.col("src").alias("seed_chunk_id"), F.col("rel").alias("relation_type"), F.col("dst").alias("target_id"), F.lit(decision).alias("decision"), reason.alias("reason"))

    diagnostics = (
        note(inspected.filter(F.col("excluded").isNotNull()), F.col("excluded"), "excluded")
        .unionByName(note(usable, F.concat(F.lit("depth-one "), F.col("rel"), F.lit(" context")), "included"))
        .unionByName(note(numbered.filter(F.col("rn") > per_seed), F.lit("per-seed expansion cap"), "excluded"))
        .unionByName(note(ranked.filter(F.col("position") > per_query), F.lit("global expansion cap"), "excluded"))
    )
    return candidates, diagnostics


def parent_excerpt(limit: int = 700) -> Column:
    """``struct(content, char_start, char_end)`` of the first span's head, trimmed.

    Needs ``source_text`` and ``source_spans``.
    """
    start = F.col("source_spans")[0]["char_start"]
    end = F.least(F.col("source_spans")[0]["char_end"], start + limit)
    raw = F.substring(F.col("source_text"), start + 1, end - start)
    left = F.length(raw) - F.length(F.regexp_replace(raw, f"^[{tx.WS}]+", ""))
    body = tx.strip(raw)
    return F.when(
        F.size("source_spans") > 0,
        F.struct(body.alias("content"), (start + left).alias("char_start"), (start + left + F.length(body)).alias("char_end")),
    )


def select_evidence(built: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Order evidence and merge items with equal text into the first of them.

    ``built``: candidates with ``content, content_sha256, version_ok,
    quality_flags``. Equal identifiers have equal text here, so the text hash
    decides. Invalid candidates are listed with their reason.
    """
    hashed = built.withColumn("evidence_text_sha256", ids.sha256(F.col("content"))).withColumn(
        "invalid",
        F.when(F.size("provenance") == 0, "evidence provenance is empty")
        .when(~F.col("version_ok"), "document version mismatch")
        .when(F.coalesce("content", F.lit("")) == "", "evidence content is empty")
        .when(F.coalesce("content_sha256", F.lit("")) == "", "authoritative content hash is missing"),
    )
    valid = hashed.filter(F.col("invalid").isNull())
    order = ("priority", F.coalesce("final_rank", F.lit(9999)), F.size("quality_flags"), "artifact_id")
    same = Window.partitionBy("query_id", "evidence_text_sha256").orderBy(*order)
    ranked = valid.withColumn("copy", F.row_number().over(same)).withColumn("into", F.first("artifact_id").over(same))
    # Candidates per query are bounded by the expansion caps.
    merged = ranked.groupBy("query_id", "evidence_text_sha256").agg(
        F.array_distinct(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("copy", "provenance"))), lambda x: x["provenance"]))).alias("provenance")
    )
    firsts = ranked.filter("copy = 1").drop("provenance", "copy", "into", "invalid").join(merged, ["query_id", "evidence_text_sha256"])
    w = Window.partitionBy("query_id").orderBy(*order)
    selected = firsts.withColumn("position", F.row_number().over(w))
    notes = ranked.filter("copy > 1").select(
        "query_id", F.lit("duplicate_evidence").alias("code"), "artifact_id", F.concat(F.lit("deduplicated into "), F.col("into")).alias("reason")
    ).unionByName(
        hashed.filter(F.col("invalid").isNotNull()).select("query_id", F.lit("invalid_evidence_candidate").alias("code"), "artifact_id", F.col("invalid").alias("reason"))
    )
    return selected, notes


def selectors(spans: DataFrame, sources: DataFrame, page_bounds: DataFrame, context: int = 48) -> DataFrame:
    """Position, page position and quote of every valid span.

    ``spans``: keys with ``document_id, span_no, page, char_start, char_end``.
    A document's spans are cut together, so its text is joined and opened once for them.
    """
    located = spans.join(page_bounds.select("document_id", "page", "page_start", "page_end"), ["document_id", "page"], "left")

    def answer(text, items):
        return sweeps.cut_pieces(text, items["char_start"], items["char_end"], context)

    rows = sweeps.beside_text(located, sources, answer).filter(F.col("answer").isNotNull())
    start, end = F.col("char_start"), F.col("char_end")
    inside = F.col("page_start").isNotNull() & (F.col("page_start") <= start) & (end <= F.col("page_end"))
    keep = [c for c in spans.columns if c not in ("char_start", "char_end")]
    return rows.select(
        *keep,
        start.alias("position_start"),
        end.alias("position_end"),
        F.when(inside, start - F.col("page_start")).alias("page_position_start"),
        F.when(inside, end - F.col("page_start")).alias("page_position_end"),
        F.col("answer.exact").alias("exact"),
        F.col("answer.prefix").alias("prefix"),
        F.col("answer.suffix").alias("suffix"),
    )


def fit_budget(items: DataFrame, budget: Column, joiner: int = 0, keys: tuple[str, ...] = ("query_id",)) -> DataFrame:
    """Skip-greedy: keep items in order while they fit; later smaller ones may.

    ``items``: keys, ``position, cost`` and the columns ``budget`` needs. A
    query's list is bounded by its top-k.
    """
    lists = items.groupBy(*keys).agg(
        F.array_sort(F.collect_list(F.struct("position", "cost"))).alias("items"), F.first(budget).alias("budget")
    )
    fold = (
        "aggregate(items, named_struct('used', 0L, 'n', 0, 'out', cast(array() as array<boolean>)), (s, x) -> "
        f"if(s.used + x.cost + if(s.n > 0, {joiner}, 0) <= budget, "
        f"named_struct('used', s.used + x.cost + if(s.n > 0, {joiner}, 0), 'n', s.n + 1, 'out', array_append(s.out, true)), "
        "named_struct('used', s.used, 'n', s.n, 'out', array_append(s.out, false))))"
    )
    done = lists.select(*keys, "items", "budget", F.expr(fold).alias("f"))
    flat = done.select(
        *keys, "budget", F.col("f.used").alias("used_tokens"), F.explode(F.arrays_zip("items.position", "items.cost", "f.out")).alias("z")
    )
    w = Window.partitionBy(*keys).orderBy("position")
    return (
        flat.select(*keys, "budget", "used_tokens", F.col("z.position").alias("position"), F.col("z.cost").alias("cost"), F.col("z.out").alias("kept"))
        .withColumn("kept_no", F.sum(F.col("kept").cast("int")).over(w))
        .withColumn("evidence_id", F.when(F.col("kept"), F.concat(F.lit("E"), F.col("kept_no").cast("string"))))
        .drop("kept_no")
    )
