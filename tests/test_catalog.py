import random

from corpusloom.operators import catalog


def test_pages_in_ranges_equal_the_plain_test(spark):
    draw = random.Random(3)
    ranges = [("long", f"c{k}", a, a + draw.choice((0, 1, 2, 7, 300, 4999))) for k, a in enumerate(draw.randint(0, 5000) for _ in range(300))]
    ranges += [("long", "all", 1, 5000), ("short", "one", 0, 0), ("short", "two", 0, 3), ("short", "none", 3, 2), ("short", "open", None, 4), ("short", "end", 2, None)]
    ranges += [("short", "two", 0, 3)]
    asked = [("long", p) for p in range(1, 5001, 7)] + [("short", p) for p in (0, 1, 2, 3, 4, 3)] + [("absent", 1), ("short", None)]
    chunks = spark.createDataFrame(ranges, "document_id string, chunk_id string, page_start int, page_end int")
    requests = spark.createDataFrame(asked, "document_id string, page int")
    got = sorted(tuple(r) for r in catalog.pages_in_ranges(requests, chunks).collect())
    want = sorted((d, p, c) for d, p in set(asked) for e, c, a, b in ranges if p is not None and a is not None and b is not None and d == e and a <= p <= b)
    assert got == want


def test_pages_are_joined_by_block_not_by_document(spark):
    chunks = spark.createDataFrame([("d", f"c{k}", k, k + 1) for k in range(1, 5000)], "document_id string, chunk_id string, page_start int, page_end int")
    requests = spark.createDataFrame([("d", k) for k in range(1, 5001)], "document_id string, page int")
    found = catalog.pages_in_ranges(requests, chunks)
    assert found.count() == 2 * 4999
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    join = next(line for line in plan.splitlines() if "Join Inner" in line)
    assert "size#" in join and "block#" in join and "<=" not in join and ">=" not in join


def test_catalog_page(spark):
    pages = spark.createDataFrame([("d", 1, "one"), ("d", 2, "two"), ("e", 1, "other")], "document_id string, page int, page_text string")
    chunks = spark.createDataFrame([("d", "b", 1, 2), ("d", "a", 2, 2)], "document_id string, chunk_id string, page_start int, page_end int")
    requests = spark.createDataFrame([("d", 2), ("d", 2), ("d", 3), ("e", 1)], "document_id string, page int")
    got = sorted((r.document_id, r.page, r.page_text, r.chunk_ids, r.found) for r in catalog.catalog_page(requests, pages, chunks).collect())
    assert got == [("d", 2, "two", ["a", "b"], True)] * 2 + [("d", 3, None, [], False), ("e", 1, "other", [], True)]
