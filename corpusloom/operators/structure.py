"""Structure detection: document text to lines to a node table.

A rank stack looks sequential, yet every decision it takes is a running value
over earlier lines. The node a line belongs to, its parent and its path follow
from the latest container line of each rank, so the parse is a few windows
over one layout by document. Documents are shuffled once, before they are cut
into lines; nothing after that moves between partitions.
"""

from __future__ import annotations

from string import ascii_lowercase, ascii_uppercase

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as tx

S = tx.WS
# Heading patterns of the document family.
ARTICLE = rf"(?iu)^(?:M[{S}]*a[{S}]*d[{S}]*d[{S}]*ə|M[{S}]*addə)[{S}]*(\p{{Nd}}+(?:-\p{{Nd}}+)?)[{S}]*\.[{S}]*(.*)$"
CHAPTER = rf"(?iu)^([IVXLCDM]+|\p{{Nd}}+)[{S}]+(?:f[{S}]*ə[{S}]*s[{S}]*i[{S}]*l|fəsil|bölmə)(?:\[(\p{{Nd}}+)\])?[{S}]*(.*)$"
ANNEX = rf"(?iu)^(?:#+[{S}]*)?Əlavə[{S}]+(\p{{Nd}}+[A-Za-z]?)[{S}]*\.?[{S}]*(.*)$"
HEADING = rf"^(#{{1,6}})[{S}]+(.+?)[{S}]*$"
ITEM = rf"(?iu)^([a-zəçşıöüğ])\)[{S}]*(.*)$"
NOTE = rf"(?iu)^(Qeyd)[{S}]*:[{S}]*(.*)$"
NUMERIC = rf"^(\p{{Nd}}+(?:[-.]\p{{Nd}}+){{0,5}})\.?(?:[{S}]+|$)(.*)$"
# "QƏRARA ALIR" in any case: every code point whose upper case is, or has, one of its letters at that place.
DECISION_OPENING = "[Qq][Əə][Rr][Aa][Rr][Aa] [Aa][Ll][Iiı][Rr]"
TABLE_RULE = rf"^[{S}]*\|?(?:[{S}]*:?-{{3,}}:?[{S}]*\|)+[{S}]*$"
CONTAINER_RANKS = {
    "chapter": 2, "annex": 2, "article": 3, "section": 3, "decision_clause": 4,
    "clause": 4, "subclause": 5, "item": 6, "list_item": 6,
}
HEADING_PREFIX = {"article": "Maddə", "chapter": "Fəsil", "annex": "Əlavə", "clause": "Bənd", "subclause": "Yarımbənd"}
BOUNDARY_KINDS = ("article", "section", "heading", "annex", "table")
LEVELS = (2, 3, 4, 5, 6)


def document_lines(docs: DataFrame, drop_rules: str = "after", compose: bool = True, tasks: int | None = None) -> DataFrame:
    """Lines with number, carried page and code-point offsets; markers removed.

    ``drop_rules='after'`` drops a ``---`` line that follows a bare page
    marker; ``'both'`` also drops one that precedes it.

    Documents are dealt to ``tasks`` tasks, or to as many as ``spark.sql.shuffle.partitions`` says. The count is given
    because adaptive execution would merge texts of 64 MB into one task, whose lines and nodes, many times the text, spill.
    """
    decision = F.coalesce(F.col("profile") == "DECISION_OR_AMENDMENT", F.lit(False)) if "profile" in docs.columns else F.lit(False)
    # Composed before the shuffle: a Python step after it would hide the layout from the plan.
    body = tx.nfc(F.col("text")) if compose else F.col("text")
    shuffled = docs.select("document_id", body.alias("text"), decision.alias("decision"))
    shuffled = shuffled.repartition(tasks or int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), "document_id")
    laid = shuffled.select("document_id", tx.unix_lines(F.col("text")).alias("text"), "decision")
    # Decided below the explode: what stands beside a generator is evaluated once a line, and takes the text along.
    # Upper case of a whole text is slow; the pattern lets hardly any text through to it.
    head = F.substring("text", 1, 10000)
    head = head.rlike(DECISION_OPENING) & F.contains(F.upper(head), F.lit("QƏRARA ALIR"))
    decided = laid.select("document_id", "text", (F.col("decision") | head).alias("decision"))
    raw = decided.select("document_id", "decision", F.posexplode(tx.split_lines(F.col("text"))).alias("pos", "raw"))
    marks = F.regexp_extract_all("raw", F.lit(tx.PAGE_MARKER), F.lit(1))
    cut = raw.withColumn("marker", F.try_element_at(marks, F.lit(-1)).cast("int")).withColumn(
        "text",
        F.when(F.col("marker").isNotNull(), tx.strip(F.regexp_replace("raw", tx.PAGE_MARKER, ""))).otherwise(F.col("raw")),
    )
    w = Window.partitionBy("document_id").orderBy("pos")
    before = w.rowsBetween(Window.unboundedPreceding, -1)
    upto = w.rowsBetween(Window.unboundedPreceding, 0)
    is_rule = F.col("marker").isNull() & (tx.strip(F.col("text")) == "---")
    event = F.when(F.col("marker").isNotNull() & (F.col("text") == ""), 1).when(
        F.col("marker").isNotNull() | (tx.strip(F.col("text")) != ""), 0
    )
    out = cut.select(
        "document_id",
        "decision",
        (F.col("pos") + 1).alias("line_no"),
        "text",
        F.col("marker").isNotNull().alias("had_marker"),
        F.last("marker", ignorenulls=True).over(upto).alias("page"),
        (F.sum(F.length("raw") + 1).over(upto) - F.length("raw") - 1).alias("char_start"),
        F.coalesce(F.last(event, ignorenulls=True).over(before), F.lit(0)).alias("pending"),
        F.coalesce(
            F.first(event, ignorenulls=True).over(w.rowsBetween(1, Window.unboundedFollowing)), F.lit(0)
        ).alias("upcoming")
        if drop_rules == "both"
        else F.lit(0).alias("upcoming"),
        is_rule.alias("is_rule"),
    )
    kept = out.filter(~(F.col("is_rule") & ((F.col("pending") == 1) | (F.col("upcoming") == 1))))
    return kept.select(
        "document_id", "decision", "line_no", "page", "text", "char_start",
        (F.col("char_start") + F.length("text")).alias("char_end"), "had_marker",
    )


def classify_lines(lines: DataFrame) -> DataFrame:
    """First matching rule per line: ``rule, number, title`` and heading level."""
    t = F.col("stripped")

    def part(pattern: str, group: int):
        return F.regexp_extract(t, pattern, group)

    def clean(c):
        return F.nullif(tx.strip(F.regexp_replace(c, rf"\[\p{{Nd}}+\][{S}]*$", "")), F.lit(""))

    def plain(c):
        return F.nullif(tx.strip(c), F.lit(""))

    rule = (
        F.when(t == "", "blank")
        .when(t.startswith("|") & t.endswith("|"), "table")
        .when(t.rlike(ARTICLE), "article")
        .when(t.rlike(CHAPTER), "chapter")
        .when(t.rlike(ANNEX), "annex")
        .when(t.rlike(HEADING), "heading")
        .when(t.rlike(ITEM), "list_item")
        .when(t.rlike(NOTE), "note")
        .when(t.rlike(NUMERIC) & (F.length(t) < 1000), "numeric")
        .otherwise("plain")
    )
    r = F.col("rule")
    out = lines.withColumn("stripped", tx.strip(F.col("text"))).withColumn("rule", rule)
    return out.select(
        *lines.columns,
        "stripped",
        F.when(r == "note", "list_item").otherwise(r).alias("rule"),
        F.when(r == "article", part(ARTICLE, 1))
        .when(r == "chapter", part(CHAPTER, 1))
        .when(r == "annex", part(ANNEX, 1))
        .when(r == "heading", F.length(part(HEADING, 1)).cast("string"))
        .when(r == "list_item", part(ITEM, 1))
        .when(r == "note", part(NOTE, 1))
        .when(r == "numeric", part(NUMERIC, 1))
        .alias("number"),
        F.when(r == "article", clean(part(ARTICLE, 2)))
        .when(r == "chapter", clean(part(CHAPTER, 3)))
        .when(r == "annex", plain(part(ANNEX, 2)))
        .when(r == "heading", plain(part(HEADING, 2)))
        .when(r == "list_item", plain(part(ITEM, 2)))
        .when(r == "note", plain(part(NOTE, 2)))
        .when(r == "numeric", plain(part(NUMERIC, 2)))
        .alias("title"),
        F.coalesce((r == "chapter") & (part(CHAPTER, 2) != ""), F.lit(False)).alias("footnote"),
    )


def assign_kinds(classified: DataFrame) -> DataFrame:
    """Node kind and rank of every line, after decision numbering and articles."""
    w = Window.partitionBy("document_id").orderBy("line_no")
    before = w.rowsBetween(Window.unboundedPreceding, -1)
    upto = w.rowsBetween(Window.unboundedPreceding, 0)
    rule, line = F.col("rule"), F.col("line_no")
    depth = F.size(F.split("number", "[.-]"))
    lone = (rule == "numeric") & (F.col("depth") == 1)
    breaks = rule.isin("chapter", "annex") | ((rule == "heading") & (F.col("number") == "1"))
    step = classified.withColumn("depth", F.when(rule == "numeric", depth)).withColumn(
        "lone_before", F.coalesce(F.sum(F.when(lone, 1).otherwise(0)).over(before), F.lit(0))
    )
    step = step.withColumn(
        "restart", lone & (F.col("number") == "1") & (F.col("lone_before") > 0)
    ).select(
        "*",
        F.max(F.when(F.col("restart"), 1).otherwise(0)).over(upto).alias("ended"),
        F.last(F.when(rule == "article", line), ignorenulls=True).over(before).alias("article_line"),
        F.last(F.when(breaks, line), ignorenulls=True).over(before).alias("break_line"),
    )
    inside = F.col("article_line") > F.coalesce("break_line", F.lit(0))
    d = F.col("depth")
    kind = (
        F.when(rule != "numeric", rule)
        .when(F.col("decision") & (F.col("ended") == 0) & (d == 1), "decision_clause")
        .when(F.coalesce(inside, F.lit(False)) & (d <= 2), "clause")
        .when(d == 1, "section")
        .when(d == 2, "clause")
        .when(d == 3, "subclause")
        .otherwise("item")
    )
    rank = F.when(F.col("kind") == "heading", F.least(F.col("number").cast("int") + 2, F.lit(6)))
    for name, value in CONTAINER_RANKS.items():
        rank = rank.when(F.col("kind") == name, value)
    return (
        step.withColumn("kind", kind)
        .withColumn("rank", rank)
        .drop("lone_before", "restart", "ended", "article_line", "break_line", "depth")
    )


def assign_nodes(kinds: DataFrame) -> DataFrame:
    """Owner node of every non-blank line, and the open container per rank."""
    w = Window.partitionBy("document_id").orderBy("line_no")
    before = w.rowsBetween(Window.unboundedPreceding, -1)
    upto = w.rowsBetween(Window.unboundedPreceding, 0)
    me = F.struct(F.col("line_no").alias("line"), "kind", "number", "title")
    open_at = kinds.select(
        "*",
        *[F.last(F.when(F.col("rank") == k, me), ignorenulls=True).over(before).alias(f"open_{k}") for k in LEVELS],
        F.lag("kind").over(w).alias("kind_before"),
    )
    top = F.greatest(*[F.col(f"open_{k}.line") for k in LEVELS])
    plain = F.col("kind") == "plain"
    loose = plain & top.isNull()
    table_start = (F.col("kind") == "table") & (F.coalesce("kind_before", F.lit("")) != "table")
    flagged = open_at.withColumn("top", top).withColumn("loose", loose).withColumn("table_start", table_start)
    # Before the first container every earlier plain line is loose as well.
    loose_start = F.col("loose") & (F.coalesce("kind_before", F.lit("")) != "plain")
    starts = F.col("rank").isNotNull() | F.col("table_start") | loose_start
    placed = flagged.select(
        "*",
        F.last(F.when(F.col("table_start"), F.col("line_no")), ignorenulls=True).over(upto).alias("table_line"),
        F.last(F.when(loose_start, F.col("line_no")), ignorenulls=True).over(upto).alias("loose_line"),
        F.coalesce(F.sum(F.when(starts, 1).otherwise(0)).over(before), F.lit(0)).alias("nodes_before"),
    )
    owner = (
        F.when(F.col("rank").isNotNull(), F.col("line_no"))
        .when(F.col("kind") == "table", F.col("table_line"))
        .when(F.col("loose"), F.col("loose_line"))
        .when(plain, F.col("top"))
    )
    kind = F.when(F.col("loose"), F.when(F.col("nodes_before") == 0, "unclassified").otherwise("paragraph")).otherwise(
        F.col("kind")
    )
    return (
        placed.withColumn("node_line", owner)
        .filter(F.col("node_line").isNotNull())
        .withColumn("kind", kind)
        .withColumn(
            "number", F.when(F.col("loose"), F.concat(F.lit("p"), F.col("line_no").cast("string"))).otherwise(F.col("number"))
        )
        .withColumn("rank", F.coalesce("rank", F.lit(7)))
        .drop("kind_before", "table_start", "table_line", "loose_line", "nodes_before", "top")
    )


def _heading(x):
    prefix = F.when(x["kind"] == "article", HEADING_PREFIX["article"])
    for kind, word in list(HEADING_PREFIX.items())[1:]:
        prefix = prefix.when(x["kind"] == kind, word)
    # Kinds are a closed set of ASCII words; upper case by the rules of Unicode was a tenth of a build's time.
    first = F.translate(F.substring(x["kind"], 1, 1), ascii_lowercase, ascii_uppercase)
    return F.concat_ws(
        " ", prefix.otherwise(F.concat(first, F.substring(x["kind"], 2, 99))), F.nullif(x["number"], F.lit("")), F.concat(F.lit("— "), x["title"])
    )


def with_paths(rows: DataFrame) -> DataFrame:
    """Ancestors, hierarchy labels, headings and locator from the open containers.

    A container of rank k is an ancestor when no later container of a lower
    rank closed it.
    """
    steps, floor = [], F.lit(0)
    for k in LEVELS:
        line = F.col(f"open_{k}.line")
        steps.append(F.when((F.col("rank") > k) & (line > floor), F.col(f"open_{k}")))
        floor = F.greatest(floor, F.coalesce(line, F.lit(0)))
    me = F.struct(F.col("node_line").alias("line"), "kind", "number", "title")
    path = F.when(F.col("kind").isin("paragraph", "unclassified"), F.array_compact(F.array(F.lit(None).cast("struct<line:int,kind:string,number:string,title:string>")))).otherwise(
        F.array_compact(F.array(*steps))
    )
    out = rows.withColumn("path", path).withColumn("chain", F.concat("path", F.array(me)))

    def label(kind: str):
        return F.try_element_at(F.filter("chain", lambda x: x["kind"] == kind), F.lit(-1))

    def pair(kind: str):
        hit = label(kind)
        return F.when(hit.isNotNull(), F.struct(hit["number"].alias("number"), hit["title"].alias("title")))

    edge = F.coalesce(
        F.try_element_at(F.filter("chain", lambda x: x["kind"].isin(*BOUNDARY_KINDS)), F.lit(-1)), F.get("chain", F.lit(0))
    )
    out = out.select(
        *rows.columns,
        "path",
        F.coalesce(F.try_element_at("path", F.lit(-1))["line"], F.lit(0)).alias("parent_line"),
        F.try_element_at("path", F.lit(-1))["kind"].alias("parent_kind"),
        F.try_element_at("path", F.lit(-1))["title"].alias("parent_title"),
        *[pair(k).alias(k) for k in ("chapter", "article", "section", "annex")],
        label("clause")["number"].alias("clause"),
        label("subclause")["number"].alias("subclause"),
        F.try_element_at(F.filter("chain", lambda x: x["kind"].isin("item", "list_item")), F.lit(-1))["number"].alias("item"),
        F.transform("chain", _heading).alias("heading_path"),
        edge["line"].alias("boundary_line"),
        edge["kind"].alias("boundary_kind"),
    )
    leaf = F.when(
        (F.coalesce("number", F.lit("")) != "") & ~F.col("kind").isin("article", "section", "annex", "chapter"),
        F.concat(F.when(F.col("kind") == "subclause", "yarımbənd ").otherwise("bənd "), F.col("number")),
    )
    parts = F.concat_ws(
        ", ",
        F.concat(F.lit("Əlavə "), F.col("annex.number")),
        F.concat(F.lit("Maddə "), F.col("article.number")),
        F.concat(F.lit("bölmə "), F.coalesce(F.nullif("section.number", F.lit("")), "section.title")),
        leaf,
    )
    # The last of the heading path, made by itself: without it the whole path is left out where nobody reads it.
    own = _heading({c: F.col(c) for c in ("kind", "number", "title")})
    return out.withColumn("heading", own).withColumn(
        "locator", F.coalesce(F.nullif(parts, F.lit("")), F.col("heading"))
    )


def node_table(owned: DataFrame) -> DataFrame:
    """One row per node: content, spans per page run, path and locator."""
    inner = Window.partitionBy("document_id", "node_line").orderBy("line_no")
    flip = F.when(~F.col("page").eqNullSafe(F.lag("page").over(inner)), 1).otherwise(0)
    runs = owned.withColumn("flip", flip).withColumn("run", F.sum("flip").over(inner))
    starts = F.col("line_no") == F.col("node_line")
    keep = ("kind", "number", "title", "rank", "footnote", *[f"open_{k}" for k in LEVELS])
    # Only a table's lines are read unstripped further on; others would gather and sort their text twice.
    raw = F.when(F.col("kind") == "table", F.col("text"))
    line = F.struct("line_no", tx.is_structural(F.col("stripped")).alias("structural"), F.col("stripped").alias("text"), raw.alias("raw"))
    spans = runs.groupBy("document_id", "node_line", "run").agg(
        F.first(F.when(starts, F.struct(*keep)), ignorenulls=True).alias("head"),
        F.first("page").alias("page"),
        F.min("char_start").alias("char_start"),
        F.max("char_end").alias("char_end"),
        F.min("line_no").alias("line_start"),
        F.max("line_no").alias("line_end"),
        F.collect_list(line).alias("part"),
    )
    span = F.struct("run", "page", "char_start", "char_end", "line_start", "line_end")
    nodes = spans.groupBy("document_id", "node_line").agg(
        F.first("head", ignorenulls=True).alias("head"),
        F.array_sort(F.collect_list(span)).alias("span_runs"),
        F.array_sort(F.flatten(F.collect_list("part"))).alias("lines"),
    )
    flat = nodes.select(
        "document_id",
        "node_line",
        "head.*",
        F.transform(
            "span_runs",
            lambda s: F.struct(s["page"].alias("page"), s["char_start"].alias("char_start"), s["char_end"].alias("char_end"), s["line_start"].alias("line_start"), s["line_end"].alias("line_end")),
        ).alias("spans"),
        "lines",
    )
    pathed = with_paths(flat)
    w = Window.partitionBy("document_id").orderBy("node_line")
    content = tx.reflow(F.transform("lines", lambda x: F.struct(x["structural"].alias("structural"), x["text"].alias("text"))))
    full = pathed.withColumn("content", content)
    before = w.rowsBetween(Window.unboundedPreceding, -1)

    def latest(rank: int):
        return F.last(F.when(F.col("rank") == rank, F.col("content")), ignorenulls=True).over(before)

    lead_in = F.when(F.col("parent_kind") == "clause", latest(4)).when(F.col("parent_kind") == "subclause", latest(5))
    # Nodes are in pre-order: a node with children is followed by its first child.
    return full.select(
        *[c for c in full.columns if not c.startswith("open_") and c != "lines"],
        # Only tables are read by line further on; elsewhere the lines would repeat the content twice over.
        F.when(F.col("kind") == "table", F.col("lines")).alias("lines"),
        F.row_number().over(w).alias("node_no"),
        F.coalesce(F.lead("parent_line").over(w) == F.col("node_line"), F.lit(False)).alias("has_children"),
        F.nullif(lead_in, F.lit("")).alias("lead_in"),
        F.row_number().over(Window.partitionBy("document_id", "kind", "locator").orderBy("node_line")).alias("occurrence"),
        F.size("lines").alias("line_count"),
    )


def parse(docs: DataFrame, **options) -> DataFrame:
    """``document_id, text[, profile]`` → node table."""
    return node_table(assign_nodes(assign_kinds(classify_lines(document_lines(docs, **options)))))


def table_nodes(nodes: DataFrame) -> DataFrame:
    """Headers, rows and certainty of table nodes."""
    def cells(line):
        return F.transform(
            F.split(F.regexp_replace(line["text"], r"^\|+|\|+$", ""), r"\|", -1), tx.strip
        )

    ruled = (F.size("lines") >= 2) & F.coalesce(F.get("lines", F.lit(1))["raw"].rlike(TABLE_RULE), F.lit(False))
    parsed = nodes.filter("kind = 'table'").withColumn("ruled", ruled)
    body = F.when(F.col("ruled"), F.slice("lines", F.lit(3), F.greatest(F.size("lines") - 2, F.lit(0)))).otherwise(F.col("lines"))
    headers = F.when(F.col("ruled"), cells(F.get("lines", F.lit(0)))).otherwise(F.array().cast("array<string>"))
    return parsed.withColumn("headers", headers).withColumn("rows", F.transform(body, cells)).withColumn(
        "uncertain", ~F.col("ruled")
    )
