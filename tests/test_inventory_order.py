"""Queries about an order sort whole tables."""

from marlstone import queries

DIR = "/root/testdata/sf0.001"


def test_whole_orders(spark):
    customers, parts = (spark.read.parquet(f"{DIR}/{t}.parquet") for t in ("customer", "part"))
    rows = lambda name: queries.queries()[name](spark, DIR).collect()
    last, first = [r.k for r in rows("sort_null_default")], [r.k for r in rows("sort_nulls_first")]
    known = sorted(r.c_nationkey for r in customers.where("c_nationkey <> 7").collect())
    none = [None] * (customers.count() - len(known))
    assert none and last == known[::-1] + none and first == none + known
    assert len(rows("scan_ordered_multi_key")) == len(rows("project_alias_order")) == customers.count()
    assert len(rows("sort_by_expression")) == parts.count()
    assert len(rows("sort_by_aggregate")) == len(rows("sort_ordinal")) == customers.select("c_nationkey").distinct().count()
