"""Queries read all rows of their tables, not a range of ids."""

from marlstone import queries

DIR = "/root/testdata/sf0.001"


def test_all_rows(spark):
    n = {t: spark.read.parquet(f"{DIR}/{t}.parquet").count() for t in ("lineitem", "orders", "supplier", "customer")}
    rows = lambda name: queries.queries()[name](spark, DIR)
    assert rows("scalar_arithmetic").count() == rows("project_expression").count() == n["lineitem"]
    assert rows("scan_path_alias").count() == n["orders"]
    full = rows("join_full").collect()
    assert sum(r.s_suppkey is not None for r in full) == n["supplier"] and sum(r.c_custkey is not None for r in full) == n["customer"]
    assert any(r.s_suppkey is None for r in full) and any(r.c_custkey is None for r in full) and any(None not in r for r in full)
    top = spark.read.parquet(f"{DIR}/orders.parquet").orderBy("o_totalprice", ascending=False).first().o_totalprice
    assert max(r.v for r in rows("set_top_k_union").collect()) == top
