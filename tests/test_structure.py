import random

from pyspark.sql import functions as F

from corpusloom.functions import text as tx
from corpusloom.operators import chunking, evidence, relations, structure
from corpusloom.plans import corpus
from corpusloom.session import persist_to_shared


def nodes_of(spark, text, **extra):
    docs = spark.createDataFrame([("d", text)], "document_id string, text string")
    for name, value in extra.items():
        docs = docs.withColumn(name, F.lit(value))
    return structure.parse(docs).orderBy("node_line").collect()


def test_line_kinds(spark):
    text = "M a d d ə 1 . Başlıq\n1-1.2. Mətn\na) item\nQeyd: not\nII fəsil[3] Ad\nƏlavə 4. Forma\n# Üst"
    got = [(n["kind"], n["number"]) for n in nodes_of(spark, text)]
    assert got == [("article", "1"), ("subclause", "1-1.2"), ("list_item", "a"), ("list_item", "Qeyd"), ("chapter", "II"), ("annex", "4"), ("heading", "1")]


def test_lead_in_and_parent(spark):
    rows = nodes_of(spark, "3.5. Siyahı aşağıdadır:\n3.5.1. Birinci")
    assert rows[1]["parent_line"] == rows[0]["node_line"]
    assert rows[1]["lead_in"] == "3.5. Siyahı aşağıdadır:"


def test_spans_cross_pages(spark):
    rows = nodes_of(spark, "<!-- PAGE: 3 -->\nMaddə 1. Ad\nmətn\n<!-- PAGE: 4 -->\n---\ndavam")
    spans = rows[0]["spans"]
    assert [s["page"] for s in spans] == [3, 4] and spans[0]["line_start"] == 2
    assert rows[0]["content"] == "Maddə 1. Ad mətn davam"


def test_decision_numbering_restarts(spark):
    rows = nodes_of(spark, "1. Bir\n2. İki\n1. Qayda\n1.1. Bənd", profile="DECISION_OR_AMENDMENT")
    assert [r["kind"] for r in rows] == ["decision_clause", "decision_clause", "section", "clause"]


def stack_model(lines):
    """A plain stack machine over (rule, number) lines, as the reading of the rules."""
    stack, out, loose, nodes = [], [], None, 0
    ranks = {"chapter": 2, "annex": 2, "article": 3, "section": 3, "clause": 4, "subclause": 5, "item": 6, "list_item": 6}
    table = False
    for i, (rule, number) in enumerate(lines, 1):
        if rule == "blank":
            loose, table = None, False
            continue
        if rule == "table":
            if not table:
                out.append((i, "table", stack[-1][0] if stack else 0))
                nodes += 1
            table, loose = True, None
            continue
        table = False
        if rule == "plain":
            if not stack and loose is None:
                out.append((i, "paragraph" if nodes else "unclassified", 0))
                nodes += 1
                loose = i
            continue
        kind = rule
        if rule == "numeric":
            depth = number.count(".") + 1
            inside = any(k == "article" for _, _, k in stack)
            kind = {1: "clause" if inside else "section", 2: "clause", 3: "subclause"}.get(depth, "item")
        rank = min(2 + int(number), 6) if rule == "heading" else ranks[kind]
        while stack and stack[-1][1] >= rank:
            stack.pop()
        out.append((i, kind, stack[-1][0] if stack else 0))
        stack.append((i, rank, kind))
        nodes, loose = nodes + 1, None
    return out


def test_windows_agree_with_a_stack(spark):
    rng = random.Random(7)
    render = {"blank": "", "table": "| a |", "plain": "mətn", "list_item": "a) b"}
    docs, want = [], {}
    for d in range(300):
        lines = []
        for _ in range(rng.randint(1, 25)):
            rule = rng.choice(["blank", "table", "plain", "plain", "article", "chapter", "annex", "heading", "numeric", "numeric", "list_item"])
            number = {"heading": str(rng.randint(1, 6)), "numeric": rng.choice(["2", "2.1", "2.1.3", "2.1.3.4"])}.get(rule, "5")
            lines.append((rule, number))
        text = "\n".join(
            render.get(rule) if rule in render else {"article": "Maddə 5. x", "chapter": "5 fəsil x", "annex": "Əlavə 5. x", "heading": "#" * int(n if rule == "heading" else 1) + " x", "numeric": f"{n}. x"}[rule]
            for rule, n in lines
        )
        docs.append((str(d), text))
        want[str(d)] = stack_model(lines)
    df = spark.createDataFrame(docs, "document_id string, text string")
    got = {}
    for r in structure.parse(df).select("document_id", "node_line", "kind", "parent_line").collect():
        got.setdefault(r["document_id"], []).append((r["node_line"], r["kind"], r["parent_line"]))
    for d, nodes in want.items():
        assert sorted(got.get(d, [])) == nodes, (d, docs[int(d)])


def build(spark, text, path="laws/a.md"):
    raw = spark.createDataFrame([(path.split("/")[0], path, text)], "category string, source_relative_path string, text string")
    return corpus.build_corpus(persist_to_shared(corpus.describe_documents(raw), "described"))


def test_edit_keeps_logical_ids(spark):
    a = build(spark, "Maddə 1. Ad\n1.1. Birinci bənd\n1.2. İkinci bənd\nMaddə 2. Son\n2.1. Üçüncü").children.collect()
    b = build(spark, "Maddə 1. Ad\n1.1. Birinci bənd\n1.2. İkinci bənd\nMaddə 2. Son\n2.1. Dəyişdi").children.collect()
    assert {r["document_id"] for r in a} == {r["document_id"] for r in b}
    assert {r["logical_chunk_id"] for r in a} == {r["logical_chunk_id"] for r in b}
    assert not {r["chunk_id"] for r in a} & {r["chunk_id"] for r in b}


def test_siblings_pack_within_their_parent_only(spark):
    rows = build(spark, "1. Bir\n1.1. Alfa\n1.2. Beta\n2. İki\n2.1. Qamma").children.orderBy("chunk_no").collect()
    contents = [r["content"] for r in rows]
    assert "1.1. Alfa\n\n1.2. Beta" in contents and not any("1.2" in c and "2.1. Q" in c for c in contents)


def test_oversized_unit_is_split_under_the_limit(spark):
    words = " ".join(f"söz{i}" for i in range(36))
    text = "Maddə 1. Ad\n1.1. " + " ".join(f"Cümlə {words}." for _ in range(20))
    rows = build(spark, text).children.filter("split_count > 1").orderBy("split_index").collect()
    assert len(rows) > 1 and [r["split_index"] for r in rows] == list(range(1, len(rows) + 1))
    assert all(r["embedding_token_count"] <= 450 for r in rows)
    assert " ".join(r["content"] for r in rows).split() == text.split()
    assert all(r["continuation_of"] == rows[0]["chunk_id"] for r in rows[1:])


def test_table_groups_repeat_headers(spark):
    body = "\n".join(f"| sətir {i} | {' '.join(['dəyər'] * 40)} |" for i in range(30)) + "\n| _ | . |"
    rows = build(spark, "# Cədvəl\n| ad | qeyd |\n| --- | --- |\n" + body).children.filter("table is not null").orderBy("chunk_no").collect()
    assert len(rows) > 1 and all("| ad | qeyd |" in r["embedding_text"] for r in rows)
    assert rows[0]["table"]["row_start"] == 1 and rows[-1]["table"]["row_end"] == 30 and rows[0]["table"]["total_rows"] == 31


def test_references_resolve_only_when_unique(spark):
    c = build(spark, "Maddə 1. Ad\n1.1. Maddə 2 ilə\nMaddə 2. Tək məzmun\nMaddə 3. Maddə 9 yoxdur")
    got = {(r["raw_reference"], r["resolved"]) for r in c.references.collect()}
    assert ("Maddə 2", True) in got and ("Maddə 9", False) in got
    assert relations.backlinks(c.references).count() == sum(1 for r in c.references.collect() if r["resolved"])


def test_edges_of_a_build_expand(spark):
    c = build(spark, "Maddə 1. Ad\n1.1. Maddə 2 ilə\nMaddə 2. Tək məzmun\nMaddə 3. Maddə 9 yoxdur")
    seeds = c.children.select(F.lit(1).alias("query_id"), "chunk_id", F.col("chunk_no").alias("final_rank"))
    inspected = evidence.inspect_edges(seeds, c.edges, evidence.corpus_artifacts(c.children, c.parents))
    out, notes = evidence.expand(seeds, inspected)
    roles = {(r["role"], r["relation_type"]) for r in out.collect()}
    assert ("seed", None) in roles and ("expanded", "parent") in roles and ("expanded", "reference") in roles
    assert "unresolved reference" in {r["reason"] for r in notes.collect()}


def test_same_result_for_any_partitioning(spark):
    text = "Maddə 1. Ad\n1.1. Alfa\nmətn\n2. Beta"
    docs = spark.createDataFrame([(str(i), text + f" {i}") for i in range(20)], "document_id string, text string")
    a = structure.parse(docs.repartition(1)).select("document_id", "node_line", "locator").collect()
    b = structure.parse(docs.repartition(16)).select("document_id", "node_line", "locator").collect()
    assert sorted(a) == sorted(b)


def test_limits_are_checked():
    import pytest

    with pytest.raises(ValueError):
        chunking.ChunkLimits(pack_below=200)


def test_decision_is_asked_once_a_document(spark):
    """What stands beside the explode into lines would read the text again for every line."""
    docs = spark.createDataFrame([("d", "1. Bir\nHeç nə\n2. İki")], "document_id string, text string")
    lines = structure.document_lines(docs)
    steps = [s for s in lines._jdf.queryExecution().optimizedPlan().toString().splitlines() if "Generate" in s or "upper(" in s]
    assert [("Generate" in s, "upper(" in s) for s in steps] == [(True, False), (False, True)]
    assert [r["decision"] for r in lines.collect()] == [False, False, False]
    upper = spark.createDataFrame([("d", "1. Bir\nQƏRARA ALIR\n2. İki")], "document_id string, text string")
    assert all(r["decision"] for r in structure.document_lines(upper).collect())


def test_segments_build_their_drafts_once(spark):
    rows = [("d", n, 1 + n // 40, 100, f"c{n}") for n in range(1, 121)]
    drafts = spark.createDataFrame(rows, "document_id string, chunk_no int, boundary_line int, content_tokens int, content string")
    out = chunking.parent_segments(drafts)
    assert "Join" not in out._jdf.queryExecution().optimizedPlan().toString()
    got = {r["chunk_no"]: (r["segment"], r["content"]) for r in out.collect()}
    want, segment, total, edge = {}, 0, 0, None
    for _, n, line, size, content in rows:
        if line != edge or total + size > 1200:
            segment, total, edge = segment + 1, 0, line
        total += size
        want[n] = (segment, content)
    assert got == want


def test_only_tables_carry_their_lines(spark):
    rows = nodes_of(spark, "Maddə 1. Ad\nmətn\n| ad | dəyər |\n| --- | --- |\n| a | 1 |")
    assert [(r["kind"], r["line_count"], r["lines"] and len(r["lines"])) for r in rows] == [("article", 2, None), ("table", 3, 3)]


def test_only_tables_gather_their_lines_unstripped(spark):
    docs = spark.createDataFrame([("d", "Maddə 1. Ad\n  mətn \n | ad |\n| --- |\n| a |")], "document_id string, text string")
    owned = structure.assign_nodes(structure.assign_kinds(structure.classify_lines(structure.document_lines(docs))))
    plan = structure.node_table(owned)._jdf.queryExecution().analyzed().toString()
    assert "raw, CASE WHEN (kind" in plan
    table = structure.parse(docs).filter("kind = 'table'").first()
    assert [x["raw"] for x in table["lines"]] == [" | ad |", "| --- |", "| a |"] and structure.table_nodes(structure.parse(docs)).first()["headers"] == ["ad"]


def test_counts_of_chunks_add_up(spark):
    """Counts of packs, split texts and parents are sums; they must be what counting the text itself gives."""
    long = " ".join(f"söz{i}, cümlə {i} bitdi." for i in range(300))
    text = "Maddə 1. Ad\n1.1. Alfa\na) bir-iki, üç\nb) dörd!\nc) beş\nMaddə 2. Uzun\n" + long + "\n| ad | dəyər |\n| --- | --- |\n| a_b | 1.5 |"
    docs = spark.createDataFrame([("d", text)], "document_id string, text string")
    facts = docs.selectExpr(
        "document_id", "'Bir ad' document_title", "'v' document_version_id", "'Ad' short_title", "'c' category", "'f' source_file", "false has_pages"
    )
    nodes = structure.parse(docs)
    units = chunking.atoms(nodes, facts)
    assert "pack_tokens" not in units.columns  # counted for short units only
    for r in units.select("token_count", "content_tokens", tx.tok_count(F.col("embedding_text")).alias("e"), tx.tok_count(F.col("content")).alias("c")).collect():
        assert (r["token_count"], r["content_tokens"]) == (r["e"], r["c"])
    children, parents = chunking.finish_chunks(chunking.parent_segments(chunking.pack_siblings(units)), nodes, facts)
    got = children.select("embedding_token_count", "packing_reason", tx.tok_count(F.col("embedding_text")).alias("e")).collect()
    assert {r["packing_reason"] for r in got} == {"short_sibling_pack", "oversized_split", "atomic_leaf"}
    assert all(r["embedding_token_count"] == r["e"] for r in got)
    assert all(r["token_count"] == r["c"] for r in parents.select("token_count", tx.tok_count(F.col("content")).alias("c")).collect())


def test_decision_opening_lets_every_spelling_through(spark):
    docs = spark.createDataFrame([(w, w + " 1") for w in ("QƏRARA ALIR", "qərara alır", "Qərara alir", "QƏRARA  ALIR", "qərar")], "document_id string, text string")
    got = {r["document_id"]: r["decision"] for r in structure.document_lines(docs).collect()}
    upper = {r["w"]: r["hit"] for r in docs.selectExpr("document_id w", "contains(upper(text), 'QƏRARA ALIR') hit").collect()}
    assert got == upper and sum(got.values()) == 3


def test_documents_keep_the_tasks_they_are_dealt_to(spark):
    docs = spark.createDataFrame([(f"d{i}", "Maddə 1. Ad\n1. bir") for i in range(40)], "document_id string, text string")
    given = int(spark.conf.get("spark.sql.shuffle.partitions"))
    assert given > 1 and structure.document_lines(docs).rdd.getNumPartitions() == given
    assert structure.document_lines(docs, tasks=7).rdd.getNumPartitions() == 7


def test_manifest_makes_texts_and_chunk_facts_once(spark, monkeypatch):
    from checks import q_quality, registry

    made = {"meta": 0, "node_chunks": 0}

    def counted(name):
        inner = getattr(q_quality, name)

        def run(*args):
            made[name] += 1
            return inner(*args)

        return run

    monkeypatch.setattr(registry, "_staged", {})
    for name in made:
        monkeypatch.setattr(q_quality, name, counted(name))
    q_quality.corpus_manifest(spark, "/root/testdata/sf0.001")
    assert made == {"meta": 1, "node_chunks": 2}  # facts, and references


def test_headings_need_no_case_rules(spark):
    """headings begin with a capital, without upper case by the rules of Unicode, once for every node of a path."""
    df = spark.createDataFrame([("d", "5 fəsil x\nMaddə 1. y\n1.1. z\na) ə\nmətn")], "document_id string, text string")
    nodes = structure.parse(df)
    assert [r["heading"] for r in nodes.orderBy("node_line").collect()] == ["Fəsil 5 — x", "Maddə 1 — y", "Bənd 1.1 — z", "List_item a — ə"]
    assert "upper(" not in str(structure._heading({c: F.col(c) for c in ("kind", "number", "title")}))
