"""The registered queries against their SQL, on the smallest tables."""

import os

import pytest

import __spark_entry__ as entry
from checks.compare import check, connect

SF = "/root/testdata/sf0.001"
FAST = (
    "lex_topk_v2", "vec_topk_dense", "vec_topk_sparse", "retrieve_hybrid_v2", "txt_pages", "struct_paths", "chunk_split", "chunk_pack_siblings",
    "rel_resolve_refs", "quality_report", "eval_grouped", "ctx_expand", "cite_resolve", "upsert_points",
)


def test_every_oracle_belongs_to_a_query(spark):
    queries, oracles = entry.queries(), entry.oracle_sql()
    assert set(oracles) <= set(queries) and len(queries) > 130


@pytest.mark.skipif(not os.path.isdir(SF), reason="driver tables are absent")
@pytest.mark.parametrize("name", FAST)
def test_query(spark, name):
    ok, note = check(connect(SF), spark, name, entry.queries()[name], entry.oracle_sql()[name], SF)
    assert ok or " 0 rows" in note, note


@pytest.mark.skipif(not os.path.isdir(SF), reason="driver tables are absent")
def test_entry(spark):
    assert entry.entry(spark).count() > 0
