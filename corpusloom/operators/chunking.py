"""Node table to retrieval chunks and their parents.

Greedy packing depends on order, so it is a fold over an array. Arrays are cut
into islands first (one node, one run of short siblings, one boundary), and the
fold carries counts; text is attached afterwards.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import ids
from ..functions import text as tx
from . import structure

CONTAINERS = ("chapter", "article", "section", "heading", "annex")


@dataclass(frozen=True)
class ChunkLimits:
    """Token limits; the defaults are the data model's own."""

    pack_below: int = 60
    pack_until: int = 180
    preferred_max: int = 320
    child_max: int = 450
    parent_min: int = 600
    parent_preferred: int = 1200
    parent_max: int = 1500

    def __post_init__(self) -> None:
        if not 0 < self.pack_below <= self.pack_until <= self.preferred_max <= self.child_max:
            raise ValueError("child token limits must be monotonically increasing")
        if not 0 < self.parent_min <= self.parent_preferred <= self.parent_max:
            raise ValueError("parent token limits must be monotonically increasing")


def _count(expr: str) -> str:
    return f"regexp_count({expr}, '{tx.COUNT_TOKEN}')".replace("\\", "\\\\")


def lead_in_cut(lead_in: str, limit: int) -> Column:
    """Leading words of a lead-in up to ``limit`` tokens; at least one word."""
    words = f"filter(split({lead_in}, '[{tx.WS}]+'), w -> w <> '')".replace("\\", "\\\\")
    kept = (
        f"aggregate({words}, named_struct('n', 0, 'c', 0, 'stop', false), (s, w) -> "
        f"if(s.stop or (s.n > 0 and s.c + {_count('w')} > {limit}), named_struct('n', s.n, 'c', s.c, 'stop', true), "
        f"named_struct('n', s.n + 1, 'c', s.c + {_count('w')}, 'stop', false)), s -> s.n)"
    )
    return F.when(F.col(lead_in).isNotNull(), F.expr(f"array_join(slice({words}, 1, {kept}), ' ')"))


def embedding_prefix(lead_in: Column) -> Column:
    """Document, hierarchy and lead-in lines that precede the text of a chunk."""

    def line(name: str, label: str):
        pair = F.col(label)
        return F.when(
            pair.isNotNull(),
            F.concat(F.lit(f"{name}: "), F.concat_ws(" — ", F.nullif(pair["number"], F.lit("")), pair["title"])),
        )

    return F.concat_ws(
        "\n",
        F.concat(F.lit("Document: "), F.col("document_title")),
        line("Chapter", "chapter"),
        line("Article", "article"),
        line("Section", "section"),
        line("Annex", "annex"),
        F.concat(F.lit("Clause: "), F.nullif(F.col("clause"), F.lit(""))),
        F.concat(F.lit("Subclause: "), F.nullif(F.col("subclause"), F.lit(""))),
        F.concat(F.lit("Parent lead-in: "), F.nullif(lead_in, F.lit(""))),
    )


#: Members that a packing fold numbers together.
FOLD_CHUNK = 256


def group_numbers(members: str, state: dict[str, str], step: Callable[[str, str], dict[str, str]]) -> str:
    """SQL for an array of group numbers, one a member, from a greedy fold in time linear in the members.

    ``state`` holds the start of each field, with ``g`` the group's number; ``step(state, member)`` gives the new fields.
    An append copies its array, so numbers are collected in chunks and the chunks in an outer array.
    """

    def fields(values: dict[str, str]) -> str:
        return ", ".join(f"'{k}', {v}" for k, v in values.items())

    fresh = "cast(array() as array<int>)"
    new = step("s", "a")
    inner = (
        f"aggregate(chunk, named_struct('out', {fresh}, {fields({k: f'o.{k}' for k in state})}), "
        f"(s, a) -> named_struct('out', array_append(s.out, {new['g']}), {fields(new)}), "
        f"r -> named_struct('all', array_append(o.all, r.out), {fields({k: f'r.{k}' for k in state})}))"
    )
    chunks = f"transform(sequence(0, (size({members}) - 1) div {FOLD_CHUNK}), i -> slice({members}, cast(i as int) * {FOLD_CHUNK} + 1, {FOLD_CHUNK}))"
    outer = f"aggregate({chunks}, named_struct('all', cast(array() as array<array<int>>), {fields(state)}), (o, chunk) -> {inner}, o -> flatten(o.all))"
    return f"if(size({members}) = 0, {fresh}, {outer})"


def bound(expression: str, name: str, body: str) -> str:
    """SQL that evaluates ``expression`` once and uses it in ``body`` under ``name``."""
    return f"element_at(transform(array({expression}), {name} -> {body}), 1)"


def split_to_limit(content: str, prefix_tokens: str, limit: int, content_tokens: str | None = None) -> Column:
    """``struct(parts, forced)``: text cut by sentences, then clauses, then words.

    ``content_tokens`` names the column of the content's token count, where it has been counted.
    """
    ws = f"[{tx.WS}]+"
    sentence, clause = tx.SENTENCE_BREAK, tx.CLAUSE_BREAK

    def sql(pattern: str) -> str:
        return pattern.replace("\\", "\\\\")

    def cut(pattern: str) -> str:
        trimmed = f"regexp_replace(x, '{sql(f'^{ws}|{ws}$')}', '')"
        return f"filter(transform(split({content}, '{sql(pattern)}', -1), x -> {trimmed}), x -> x <> '')"

    budget = f"greatest(8, {limit} - {prefix_tokens} - 3)"
    pieces = bound(cut(sentence), "whole", f"if(size(whole) = 1, {cut(clause)}, whole)")
    # A sentence over budget becomes hard pieces that stand alone.
    words = f"filter(split(s.t, '{sql(ws)}'), w -> w <> '')"
    hard = (
        f"transform(aggregate({words}, named_struct('done', cast(array() as array<string>), 'cur', '', 'n', 0), (a, w) -> "
        f"if(a.n > 0 and a.n + {_count('w')} > {budget}, "
        f"named_struct('done', array_append(a.done, a.cur), 'cur', w, 'n', {_count('w')}), "
        f"named_struct('done', a.done, 'cur', if(a.cur = '', w, concat(a.cur, ' ', w)), 'n', a.n + {_count('w')})), "
        f"a -> if(a.cur = '', a.done, array_append(a.done, a.cur))), p -> named_struct('t', p, 'n', 0, 'hard', true))"
    )
    sized = f"transform({pieces}, x -> named_struct('t', x, 'n', {_count('x')}))"
    units = (
        f"flatten(transform(sized, s -> if(s.n > {budget}, {hard}, array(named_struct('t', s.t, 'n', s.n, 'hard', false)))))"
    )
    packed = (
        f"aggregate({units}, named_struct('done', cast(array() as array<string>), 'cur', '', 'n', 0), (a, u) -> "
        f"case when u.hard then named_struct('done', array_append(if(a.cur = '', a.done, array_append(a.done, a.cur)), u.t), 'cur', '', 'n', 0) "
        f"when a.cur <> '' and a.n + u.n > {budget} then named_struct('done', array_append(a.done, a.cur), 'cur', u.t, 'n', u.n) "
        f"else named_struct('done', a.done, 'cur', if(a.cur = '', u.t, concat(a.cur, ' ', u.t)), 'n', a.n + u.n) end, "
        f"a -> if(a.cur = '', a.done, array_append(a.done, a.cur)))"
    )
    cut_up = bound(sized, "sized", f"named_struct('parts', {packed}, 'forced', exists(sized, s -> s.n > {budget}))")
    fits = f"{prefix_tokens} + 2 + {content_tokens or _count(content)} <= {limit}"
    return F.expr(f"case when {fits} then named_struct('parts', array({content}), 'forced', false) else {cut_up} end")


def table_groups(limit: int) -> Column:
    """Row groups that fit the budget with the header; needs ``md_rows, header_tokens, table_tokens``."""
    budget = f"greatest(1, {limit} - table_tokens - 8)"
    empty = "cast(array() as array<struct<row_start:int,row_end:int,body:array<string>>>)"
    fold = (
        f"aggregate(transform(md_rows, r -> named_struct('t', r, 'n', {_count('r')})), "
        f"named_struct('done', {empty}, 'cur', cast(array() as array<string>), 'tok', header_tokens, 'start', 1, 'at', 0), (a, r) -> "
        f"if(size(a.cur) > 0 and a.tok + r.n > {budget}, "
        f"named_struct('done', array_append(a.done, named_struct('row_start', a.start, 'row_end', a.at, 'body', a.cur)), 'cur', array(r.t), 'tok', header_tokens + r.n, 'start', a.at + 1, 'at', a.at + 1), "
        f"named_struct('done', a.done, 'cur', array_append(a.cur, r.t), 'tok', a.tok + r.n, 'start', a.start, 'at', a.at + 1)), "
        f"a -> if(size(a.cur) > 0, array_append(a.done, named_struct('row_start', a.start, 'row_end', a.start + size(a.cur) - 1, 'body', a.cur)), a.done))"
    )
    fallback = "array(named_struct('row_start', 1, 'row_end', 1, 'body', any_rows))"
    return F.expr(f"if(size(md_rows) = 0, {fallback}, {fold})")


def _table_columns(nodes: DataFrame) -> DataFrame:
    """Cells of table nodes as Markdown rows; null arrays elsewhere."""
    is_table = F.col("kind") == "table"

    def cells(line):
        return F.transform(F.split(F.regexp_replace(line["text"], r"^\|+|\|+$", ""), r"\|", -1), tx.strip)

    def md(row):
        return F.concat(F.lit("| "), F.array_join(row, " | "), F.lit(" |"))

    ruled = (
        is_table
        & (F.size("lines") >= 2)
        & F.coalesce(F.get("lines", F.lit(1))["raw"].rlike(structure.TABLE_RULE), F.lit(False))
    )
    body = F.when(F.col("ruled"), F.slice("lines", F.lit(3), F.greatest(F.size("lines") - 2, F.lit(0)))).otherwise(F.col("lines"))
    out = nodes.withColumn("ruled", ruled).withColumn("rows", F.when(is_table, F.transform(body, cells)))
    headers = F.when(F.col("ruled"), cells(F.get("lines", F.lit(0)))).otherwise(F.array().cast("array<string>"))
    out = out.withColumn("headers", headers)
    filled = F.filter("rows", lambda r: F.exists(r, lambda c: c.rlike(r"[^ _.\-]")))
    header = F.when(
        F.size("headers") > 0, F.concat(md(F.col("headers")), F.lit("\n"), md(F.transform("headers", lambda _: F.lit("---"))))
    ).otherwise("")
    return (
        out.withColumn("md_rows", F.transform(filled, md))
        .withColumn("any_rows", F.transform(F.filter("rows", lambda r: F.exists(r, lambda c: c != "")), md))
        .withColumn("header_md", header)
        .withColumn("header_tokens", tx.tok_count(F.col("header_md")))
    )


def atoms(nodes: DataFrame, documents: DataFrame, limits: ChunkLimits = ChunkLimits()) -> DataFrame:
    """Atomic units in order. ``documents`` has ``document_id, document_title``."""
    useful = nodes.filter(
        (F.col("content") != "")
        & ~(F.col("has_children") & (F.col("line_count") == 1) & F.col("kind").isin(*CONTAINERS))
    ).join(documents.select("document_id", "document_title"), "document_id")
    base = _table_columns(useful)
    is_table = F.col("kind") == "table"
    suffix = F.when(F.col("occurrence") > 1, F.concat(F.lit(" [occurrence "), F.col("occurrence").cast("string"), F.lit("]"))).otherwise("")
    cut = lead_in_cut("lead_in", min(120, limits.child_max // 3))
    prefix = embedding_prefix(F.when(~is_table, F.col("lead_cut")))
    table_prefix = F.concat(
        F.col("plain_prefix"),
        F.coalesce(F.concat(F.lit("\nTable: "), F.col("parent_title")), F.lit("")),
        F.lit("\nColumn headers: "),
        F.array_join("headers", " | "),
    )
    sized = (
        base.withColumn("lead_cut", cut)
        .withColumn("plain_prefix", prefix)
        .withColumn("prefix", F.when(is_table, table_prefix).otherwise(F.col("plain_prefix")))
        .withColumn("prefix_tokens", tx.tok_count(F.col("prefix")))
        .withColumn("table_tokens", F.col("prefix_tokens"))
    )
    whole = F.array(
        F.struct(F.lit(None).cast("int").alias("row_start"), F.lit(None).cast("int").alias("row_end"), F.array("content").alias("body"))
    )
    grouped = sized.withColumn("groups", F.when(is_table, table_groups(limits.child_max)).otherwise(whole))
    each = grouped.select(
        *[c for c in grouped.columns if c not in ("groups", "content", "lines", "md_rows", "any_rows")],
        F.posexplode("groups").alias("group_no", "g"),
    )
    joined = F.array_join("g.body", "\n")
    body = (
        each.withColumn(
            "body",
            F.when(is_table & (F.col("header_md") != ""), F.concat_ws("\n", "header_md", F.nullif(joined, F.lit("")))).otherwise(joined),
        )
        .withColumn("body_tokens", tx.tok_count(F.col("body")))
        .withColumn("cut", split_to_limit("body", "prefix_tokens", limits.child_max, "body_tokens"))
    )
    unit_locator = F.when(
        is_table,
        F.concat(F.col("locator"), F.lit(", sətirlər "), F.col("g.row_start").cast("string"), F.lit("-"), F.col("g.row_end").cast("string")),
    ).otherwise(F.col("locator"))
    # Counts add up over white space, so a text that stays whole is counted once and its embedding text never.
    whole_body = F.col("prefix_tokens") + 2 + F.col("body_tokens") <= limits.child_max
    text_tokens = F.when(whole_body, F.col("body_tokens")).otherwise(tx.tok_count(F.col("text")))
    counted = body.withColumn("forced", F.col("cut.forced")).withColumn("split_count", F.size("cut.parts"))
    parts = counted.select(
        *[c for c in counted.columns if c not in ("body", "cut")], F.posexplode("cut.parts").alias("part_no", "text")
    ).withColumn("unit_locator", unit_locator).withColumn("content_tokens", text_tokens)
    unit = ids.unit_id(
        F.col("document_id"),
        F.when(is_table, "table_row_group").otherwise(F.col("kind")),
        F.concat("unit_locator", suffix),
    )
    flags = F.array_sort(
        F.array_distinct(
            F.array_compact(
                F.array(
                    F.when(F.col("kind") == "unclassified", "unclassified_structure"),
                    F.when(F.col("footnote"), "heading_footnote_separated"),
                    F.when(is_table & ~F.col("ruled"), "table_structure_uncertain"),
                    F.when(F.col("forced"), "oversized_atomic_unit"),
                )
            )
        )
    )
    # The document prefix joins its text by "Text:", stripped at the end.
    embedding = F.concat(F.col("prefix"), F.lit("\nText: "), F.col("text"))
    table = F.when(
        is_table,
        F.struct(
            ids.prefixed("table", F.col("document_id"), F.col("locator"), F.col("node_line").cast("string")).alias("table_id"),
            F.col("parent_title").alias("title"),
            F.col("headers").alias("column_headers"),
            F.col("g.row_start").alias("row_start"),
            F.col("g.row_end").alias("row_end"),
            F.greatest(F.lit(1), F.size("rows")).alias("total_rows"),
        ),
    )
    w = Window.partitionBy("document_id").orderBy("node_line", "group_no", "part_no")
    return parts.select(
        "document_id",
        "document_title",
        F.row_number().over(w).alias("atom_no"),
        "node_line",
        "kind",
        F.col("locator").alias("node_locator"),
        F.col("unit_locator").alias("locator"),
        unit.alias("logical_unit_id"),
        F.col("text").alias("content"),
        embedding.alias("embedding_text"),
        (F.col("prefix_tokens") + 2 + F.col("content_tokens")).alias("token_count"),
        "content_tokens",
        "heading_path",
        F.struct("chapter", "article", "section", "annex", "clause", "subclause", "item", "heading_path").alias("hierarchy"),
        F.col("lead_in").alias("parent_lead_in"),
        "spans",
        (F.col("part_no") + 1).alias("split_index"),
        "split_count",
        flags.alias("quality_flags"),
        table.alias("table"),
        "parent_line",
        "boundary_line",
        "boundary_kind",
    )


def pack_siblings(units: DataFrame, limits: ChunkLimits = ChunkLimits()) -> DataFrame:
    """Chunk drafts: runs of short siblings merged in order, everything else alone."""
    w = Window.partitionBy("document_id").orderBy("atom_no")
    eligible = (F.col("split_count") == 1) & (F.col("token_count") < limits.pack_below) & F.col("table").isNull()
    # What precedes the text of a pack; only short units start one, so only their headings are counted.
    head = F.concat(F.lit("Document: "), F.col("document_title"), F.lit("\nHierarchy: "), F.array_join("heading_path", "\n"))
    marked = units.withColumn("short", eligible).withColumn("pack_tokens", F.when(F.col("short"), tx.tok_count(head)))
    same = (
        F.col("short")
        & F.coalesce(F.lag("short").over(w), F.lit(False))
        & (F.lag("boundary_line").over(w) == F.col("boundary_line"))
        & (F.lag("parent_line").over(w) == F.col("parent_line"))
    )
    runs = marked.withColumn("starts", F.when(F.coalesce(same, F.lit(False)), 0).otherwise(1)).withColumn(
        "run", F.sum("starts").over(w)
    )
    members = F.struct("atom_no", *[c for c in marked.columns if c not in ("document_id", "atom_no", "document_title", "short")])
    lists = runs.groupBy("document_id", "document_title", "run").agg(F.array_sort(F.collect_list(members)).alias("atoms"))
    sizes = "transform(atoms, a -> named_struct('t', a.token_count, 'c', a.content_tokens, 'p', a.pack_tokens))"

    def step(s: str, m: str) -> dict[str, str]:
        new = f"({s}.g = 0 or {s}.t >= {limits.pack_until} or {s}.p + 2 + {s}.c + {m}.c > {limits.child_max})"
        return {
            "g": f"if({new}, {s}.g + 1, {s}.g)",
            "t": f"if({new}, {m}.t, {s}.t + {m}.t)",
            "c": f"if({new}, {m}.c, {s}.c + {m}.c)",
            "p": f"if({new}, {m}.p, {s}.p)",
        }

    fold = bound(sizes, "sizes", group_numbers("sizes", {"g": "0", "t": "0", "c": "0", "p": "0"}, step))
    grouped = lists.select(
        "document_id", "document_title", "run", F.explode(F.arrays_zip("atoms", F.expr(fold).alias("grp"))).alias("z")
    )
    item = F.col("z.atoms")
    drafts = grouped.groupBy("document_id", "document_title", "run", F.col("z.grp").alias("grp")).agg(
        F.array_sort(F.collect_list(item)).alias("atoms")
    )
    first = F.col("atoms")[0]
    many = F.size("atoms") > 1
    packed = F.concat(
        F.lit("Document: "), F.col("document_title"), F.lit("\nHierarchy: "), F.array_join(first["heading_path"], "\n"),
        F.lit("\nText: "), F.array_join(F.transform("atoms", lambda a: a["content"]), "\n"),
    )
    embedding = F.when(many, packed).otherwise(first["embedding_text"])
    content = F.array_join(F.transform("atoms", lambda a: a["content"]), "\n\n")
    # Counts add up over white space: nothing is counted again.
    content_tokens = F.aggregate("atoms", F.lit(0), lambda n, a: n + a["content_tokens"])
    tokens = F.when(many, first["pack_tokens"] + 2 + content_tokens).otherwise(first["token_count"])
    order = Window.partitionBy("document_id").orderBy("first_atom")
    return (
        drafts.withColumn("first_atom", first["atom_no"])
        .withColumn("embedding_text", embedding)
        .withColumn("content", content)
        .select(
            "document_id",
            "document_title",
            F.row_number().over(order).alias("chunk_no"),
            first["node_line"].alias("node_line"),
            first["kind"].alias("kind"),
            first["node_locator"].alias("node_locator"),
            F.when(many, F.concat(first["locator"], F.lit(" – "), F.element_at("atoms", -1)["locator"]))
            .otherwise(first["locator"])
            .alias("canonical_locator"),
            F.transform(
                "atoms",
                lambda a: F.struct(
                    a["logical_unit_id"].alias("logical_unit_id"), a["locator"].alias("canonical_locator"), a["spans"].alias("source_spans")
                ),
            ).alias("atomic_units"),
            "content",
            "embedding_text",
            tokens.alias("token_count"),
            content_tokens.alias("content_tokens"),
            first["hierarchy"].alias("hierarchy"),
            first["parent_lead_in"].alias("parent_lead_in"),
            F.flatten(F.transform("atoms", lambda a: a["spans"])).alias("source_spans"),
            first["split_index"].alias("split_index"),
            first["split_count"].alias("split_count"),
            F.array_sort(F.array_distinct(F.flatten(F.transform("atoms", lambda a: a["quality_flags"])))).alias("quality_flags"),
            first["table"].alias("table"),
            first["boundary_line"].alias("boundary_line"),
            first["boundary_kind"].alias("boundary_kind"),
            F.when(many, "short_sibling_pack").when(first["split_count"] > 1, "oversized_split").otherwise("atomic_leaf").alias("packing_reason"),
        )
    )


def parent_segments(drafts: DataFrame, limits: ChunkLimits = ChunkLimits()) -> DataFrame:
    """Append ``segment``: consecutive chunks of one boundary up to the parent limit."""
    w = Window.partitionBy("document_id").orderBy("chunk_no")
    flip = F.when(F.lag("boundary_line").over(w) == F.col("boundary_line"), 0).otherwise(1)
    runs = drafts.withColumn("flip", flip).withColumn("island", F.sum("flip").over(w))
    # The drafts travel in their island: numbering them aside and joining back would build them twice.
    member = F.struct("chunk_no", *[c for c in drafts.columns if c not in ("document_id", "chunk_no")])
    lists = runs.groupBy("document_id", "island").agg(F.array_sort(F.collect_list(member)).alias("members"))
    sizes = "transform(members, m -> named_struct('t', m.content_tokens))"

    def step(s: str, m: str) -> dict[str, str]:
        new = f"({s}.t > 0 and {s}.t + {m}.t > {limits.parent_preferred})"
        return {"g": f"if({new}, {s}.g + 1, {s}.g)", "t": f"if({new}, {m}.t, {s}.t + {m}.t)"}

    fold = bound(sizes, "sizes", group_numbers("sizes", {"g": "1", "t": "0"}, step))
    placed = lists.select("document_id", "island", F.explode(F.arrays_zip("members", F.expr(fold).alias("part"))).alias("z"))
    order = Window.partitionBy("document_id").orderBy("island", F.col("z.part"))
    numbered = placed.withColumn("segment", F.dense_rank().over(order))
    return numbered.select("document_id", *[F.col(f"z.members.{c}") for c in drafts.columns if c != "document_id"], "segment")


def _roots(nodes: DataFrame) -> DataFrame:
    """What parents and children read of the node that bounds them."""
    return nodes.select(
        "document_id",
        F.col("node_line").alias("boundary_line"),
        F.col("locator").alias("root_locator"),
        F.col("kind").alias("root_kind"),
        F.col("title").alias("root_title"),
        F.when(F.col("has_children"), F.col("content")).alias("root_lead_in"),
        F.col("annex").isNotNull().alias("in_annex"),
        F.struct("chapter", "article", "section", "annex", "clause", "subclause", "item", "heading_path").alias("root_hierarchy"),
    )


def finish_chunks(
    segmented: DataFrame, nodes: DataFrame, documents: DataFrame, limits: ChunkLimits = ChunkLimits()
) -> tuple[DataFrame, DataFrame]:
    """Children and parents with their identifiers.

    ``documents`` has ``document_id, document_version_id, short_title,
    category, source_file, has_pages``.
    """
    facts = documents.select("document_id", "document_version_id", "short_title", "category", "source_file", "has_pages")
    rows = segmented.join(_roots(nodes), ["document_id", "boundary_line"]).join(facts, "document_id")
    head = Window.partitionBy("document_id", "segment").orderBy("chunk_no")
    units = F.transform("atomic_units", lambda a: a["logical_unit_id"])
    logical = ids.logical_chunk_id(F.col("document_id"), units, F.col("split_index"))
    pages = F.filter(F.transform("source_spans", lambda s: s["page"]), lambda p: p.isNotNull())
    flags = F.array_sort(
        F.array_distinct(
            F.concat(
                "quality_flags",
                F.array_compact(
                    F.array(
                        F.when(F.col("has_pages") & (F.size("pages") == 0), "missing_page_locator"),
                        F.when(F.size(F.array_distinct("pages")) > 1, "cross_page_split"),
                    )
                ),
            )
        )
    )
    staged = (
        rows.withColumn("root_locator", F.first("root_locator").over(head))
        .withColumn("root_kind", F.first("root_kind").over(head))
        .withColumn("content_sha256", ids.sha256(F.col("content")))
        .withColumn("logical_chunk_id", logical)
        .withColumn("pages", pages)
        .withColumn("quality_flags", flags)
        .withColumn("chunk_id", ids.chunk_id(F.col("document_version_id"), F.col("logical_chunk_id"), F.col("content_sha256")))
        .withColumn("parent_chunk_id", ids.parent_id(F.col("document_version_id"), F.col("root_locator"), F.col("segment")))
        .withColumn("article_root_id", ids.prefixed("article", F.col("document_id"), F.col("root_locator")))
        .withColumn("first_unit", F.col("atomic_units")[0]["logical_unit_id"])
    )
    unit_first = F.first("chunk_id").over(Window.partitionBy("document_id", "first_unit").orderBy("chunk_no"))
    siblings = Window.partitionBy("document_id", "parent_chunk_id").orderBy("chunk_no")
    is_table = F.col("table").isNotNull()
    children = staged.withColumn("unit_first", unit_first).select(
        "document_id",
        "document_version_id",
        "chunk_no",
        "chunk_id",
        "logical_chunk_id",
        "parent_chunk_id",
        "article_root_id",
        F.when(is_table, "table_row_group").when(F.size("atomic_units") > 1, "clause_group").otherwise("atomic_unit").alias("chunk_type"),
        F.when(is_table, "table").otherwise(F.col("kind")).alias("node_type"),
        "document_title",
        "short_title",
        "category",
        "source_file",
        "hierarchy",
        "canonical_locator",
        "atomic_units",
        "content",
        "embedding_text",
        "parent_lead_in",
        F.array_min("pages").alias("page_start"),
        F.array_max("pages").alias("page_end"),
        "source_spans",
        F.lag("chunk_id").over(siblings).alias("previous_sibling"),
        F.lead("chunk_id").over(siblings).alias("next_sibling"),
        F.when((F.col("root_kind") == "annex") | F.col("in_annex"), F.col("parent_chunk_id")).alias("annex_parent"),
        F.when(is_table, F.col("parent_chunk_id")).alias("table_parent"),
        "split_index",
        "split_count",
        (F.col("split_index") > 1).alias("is_continuation"),
        F.when(F.col("split_index") > 1, F.col("unit_first")).alias("continuation_of"),
        F.col("token_count").alias("embedding_token_count"),
        F.length("content").alias("character_count"),
        tx.sentence_count(F.col("content")).alias("sentence_count"),
        "packing_reason",
        "content_sha256",
        F.when(F.size("quality_flags") > 0, 0.75).otherwise(0.98).alias("parser_confidence"),
        "quality_flags",
        "table",
        F.lit(True).alias("is_current"),
        F.lit("2.0").alias("schema_version"),
    )
    return children, _parents(staged)


def _parents(rows: DataFrame) -> DataFrame:
    """Parents of the chunks that ``rows`` has with their segment and root."""
    member = F.struct("chunk_no", "chunk_id", "content", "source_spans", "content_tokens")
    return (
        rows.groupBy("document_id", "document_version_id", "parent_chunk_id")
        .agg(
            F.array_sort(F.collect_list(member)).alias("members"),
            F.min("segment").alias("segment"),
            F.min_by(
                F.struct("article_root_id", "document_title", "root_kind", "root_locator", "root_title", "root_hierarchy", "root_lead_in"), "chunk_no"
            ).alias("root"),
        )
        .withColumn("content", F.array_join(F.transform("members", lambda m: m["content"]), "\n\n"))
        .withColumn("spans", F.flatten(F.transform("members", lambda m: m["source_spans"])))
        .select(
            "document_id",
            "document_version_id",
            "parent_chunk_id",
            "segment",
            "root.article_root_id",
            "root.document_title",
            F.col("root.root_kind").alias("parent_type"),
            F.col("root.root_hierarchy").alias("hierarchy"),
            F.col("root.root_locator").alias("canonical_locator"),
            F.col("root.root_title").alias("title"),
            "content",
            F.col("root.root_lead_in").alias("parent_lead_in"),
            F.transform("members", lambda m: m["chunk_id"]).alias("child_chunk_ids"),
            F.array_min(F.transform("spans", lambda s: s["page"])).alias("page_start"),
            F.array_max(F.transform("spans", lambda s: s["page"])).alias("page_end"),
            F.col("spans").alias("source_spans"),
            F.aggregate("members", F.lit(0), lambda n, m: n + m["content_tokens"]).alias("token_count"),
            ids.sha256(F.col("content")).alias("content_sha256"),
        )
    )


def stored_parents(children: DataFrame, nodes: DataFrame) -> DataFrame:
    """Parents of stored children, as :func:`finish_chunks` makes them, without the drafts.

    A chunk begins in the node whose first line its first span begins with; segments count the parents of a document.
    Both sides are laid out by document once for all joins.
    """
    places = nodes.select("document_id", "node_line", "boundary_line").repartition("document_id")
    rows = children.select(
        "document_id", "document_version_id", "parent_chunk_id", "article_root_id", "document_title", "chunk_no", "chunk_id", "content",
        "source_spans", F.col("source_spans")[0]["line_start"].alias("node_line"),
    ).repartition("document_id")
    rooted = rows.join(places, ["document_id", "node_line"]).join(_roots(nodes).repartition("document_id"), ["document_id", "boundary_line"])
    # Counts add up over white space.
    counted = rooted.withColumn("content_tokens", tx.tok_count(F.col("content"))).withColumn("segment", F.col("chunk_no"))
    w = Window.partitionBy("document_id").orderBy("segment")
    return _parents(counted).withColumn("segment", F.row_number().over(w))


# ------------------------------------------------------------ V1 chunker

S = tx.WS
# Section headings of the older chunker.
V1_ARTICLE = rf"^(?:(?:M[{S}]*a[{S}]*d[{S}]*d[{S}]*ə)[{S}]+(\p{{Nd}}+)|(\p{{Nd}}+)\.[{S}]+(?!\p{{Nd}}))"
V1_CHAPTER = (
    rf"(?iu)^(?:(?:F[{S}]*ə[{S}]*s[{S}]*i[{S}]*l|B[{S}]*ö[{S}]*l[{S}]*m[{S}]*ə)[{S}]+([IVXLCDM\p{{Nd}}]+)"
    rf"|([IVXLCDM\p{{Nd}}]+)[{S}]+(?:Fəsil|Bölmə))"
)
V1_PAGE = rf"<!-- PAGE:[{S}]*(\p{{Nd}}+)[{S}]*-->"


def v1_sections(docs: DataFrame) -> DataFrame:
    """Lines with page, section number, chapter and article of the older chunker."""
    laid = docs.select("document_id", "category", tx.unix_lines(F.col("text")).alias("text")).repartition("document_id")
    raw = laid.select("document_id", "category", F.posexplode(F.split("text", "(?<=\n)", -1)).alias("pos", "raw")).filter(
        F.col("raw") != ""
    )
    page = F.regexp_extract("raw", V1_PAGE, 1)
    marked = raw.withColumn("marker", F.when(page != "", page.cast("int"))).withColumn(
        "line", F.when(F.col("marker").isNotNull(), tx.strip(F.regexp_replace("raw", V1_PAGE, ""))).otherwise(F.col("raw"))
    )
    chapter = F.coalesce(
        F.nullif(F.regexp_extract("line", V1_CHAPTER, 1), F.lit("")), F.nullif(F.regexp_extract("line", V1_CHAPTER, 2), F.lit(""))
    )
    article = F.coalesce(
        F.nullif(F.regexp_extract("line", V1_ARTICLE, 1), F.lit("")), F.nullif(F.regexp_extract("line", V1_ARTICLE, 2), F.lit(""))
    )
    w = Window.partitionBy("document_id").orderBy("pos")
    upto = w.rowsBetween(Window.unboundedPreceding, 0)
    used = ~(F.col("marker").isNotNull() & (F.col("line") == "")) & (tx.strip(F.col("line")) != "---")
    found = (
        marked.withColumn("used", used)
        .withColumn("new_chapter", F.when(F.col("used"), chapter))
        .withColumn("new_article", F.when(F.col("used") & F.col("new_chapter").isNull(), article))
    )
    opens = F.col("new_chapter").isNotNull() | F.col("new_article").isNotNull()
    return (
        found.select(
            "document_id",
            "category",
            "pos",
            "used",
            F.coalesce(F.last("marker", ignorenulls=True).over(upto), F.lit(1)).alias("page"),
            F.sum(F.when(opens, 1).otherwise(0)).over(upto).alias("section_no"),
            F.last("new_chapter", ignorenulls=True).over(upto).alias("chapter"),
            F.nullif(
                F.last(F.coalesce("new_article", F.when(F.col("new_chapter").isNotNull(), "")), ignorenulls=True).over(upto),
                F.lit(""),
            ).alias("article"),
            F.when(opens, tx.strip(F.col("line"))).otherwise(F.regexp_replace("line", r"\n+$", "")).alias("text"),
        )
        .filter("used")
        .drop("used")
    )


def v1_window(sections: DataFrame, max_chars: int = 4000, overlap: int = 500) -> DataFrame:
    """Character windows of whole lines inside each section, with overlap."""
    inner = Window.partitionBy("document_id", "section_no").orderBy("pos")
    sized = sections.withColumn("len", F.length("text") + 1)
    line = F.struct("pos", "text", "page", "len", (F.sum("len").over(inner) - F.col("len")).alias("before"))
    lists = (
        sized.withColumn("line", line)
        .groupBy("document_id", "category", "section_no", "chapter", "article")
        .agg(F.array_sort(F.collect_list("line")).alias("lines"))
        .withColumn("befores", F.transform("lines", lambda x: x["before"]))
        .filter(tx.strip(F.array_join(F.transform("lines", lambda x: x["text"]), "\n")) != "")
    )
    back = (
        f"greatest(1, size(filter(slice(befores, greatest(1, s.i - {overlap}), least(s.i, {overlap} + 1)), "
        f"b -> x.before - b <= {overlap})))"
    )
    start = f"greatest(s.start, s.i + 1 - {back})"
    fold = (
        "aggregate(lines, named_struct('out', cast(array() as array<struct<a:int,z:int>>), 'i', 0, 'start', 1, 'n', 0L), (s, x) -> "
        f"if(s.n + x.len > {max_chars} and s.i >= s.start, "
        f"named_struct('out', array_append(s.out, named_struct('a', s.start, 'z', s.i)), 'i', s.i + 1, 'start', {start}, "
        f"'n', x.before - element_at(befores, {start}) + x.len), "
        "named_struct('out', s.out, 'i', s.i + 1, 'start', s.start, 'n', s.n + x.len)), "
        "s -> array_append(s.out, named_struct('a', s.start, 'z', s.i)))"
    )
    parts = lists.withColumn("parts", F.expr(fold)).select(
        "document_id", "category", "section_no", "chapter", "article", "lines", F.size("parts").alias("n_parts"), F.posexplode("parts").alias("part_no", "p")
    )
    cut = F.expr("slice(lines, p.a, p.z - p.a + 1)")
    rows = (
        parts.withColumn("cut", cut)
        .withColumn("text", tx.strip(F.array_join(F.transform("cut", lambda x: x["text"]), "\n")))
        .filter(F.col("text") != "")
    )
    order = Window.partitionBy("document_id").orderBy("section_no", "part_no")
    numbered = rows.withColumn("n", F.row_number().over(order)).withColumn(
        "base", F.min("n").over(Window.partitionBy("document_id", "section_no"))
    )
    where = F.coalesce(
        F.nullif(
            F.concat_ws("_", F.concat(F.lit("ch_"), F.col("chapter")), F.concat(F.lit("art_"), F.col("article"))), F.lit("")
        ),
        F.lit("intro"),
    )
    return numbered.select(
        F.concat(
            F.concat_ws("_", "document_id", where, F.col("base").cast("string")),
            F.when(F.col("n_parts") > 1, F.concat(F.lit("_part"), (F.col("part_no") + 1).cast("string"))).otherwise(""),
        ).alias("chunk_id"),
        "document_id",
        F.col("document_id").alias("title"),
        "category",
        "chapter",
        "article",
        F.get("cut", F.lit(0))["page"].alias("page_start"),
        F.element_at("cut", -1)["page"].alias("page_end"),
        F.concat("document_id", F.lit(".md")).alias("source_file"),
        "text",
        "n",
    )


def v1_metadata(chunks: DataFrame, docs: DataFrame, language: str = "az") -> DataFrame:
    """Per document: pages, chunks and constant facts; documents without chunks count zero."""
    pages = docs.select(
        "document_id",
        "category",
        F.greatest(
            F.lit(1),
            F.coalesce(
                F.array_max(F.transform(F.regexp_extract_all("text", F.lit(V1_PAGE), F.lit(1)), lambda x: x.cast("int"))), F.lit(1)
            ),
        ).alias("total_pages"),
    )
    counts = chunks.groupBy("document_id").agg(F.count(F.lit(1)).alias("total_chunks"))
    return pages.join(counts, "document_id", "left").select(
        "document_id",
        F.col("document_id").alias("title"),
        "category",
        F.concat("document_id", F.lit(".pdf")).alias("source_file"),
        F.concat("document_id", F.lit(".md")).alias("processed_file"),
        "total_pages",
        F.coalesce("total_chunks", F.lit(0)).alias("total_chunks"),
        F.lit(language).alias("language"),
        F.lit("pdfplumber").alias("parser"),
        F.current_timestamp().alias("created_at"),
    )
