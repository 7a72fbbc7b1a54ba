"""Queries whose work must not grow faster than their tables."""

import datetime
import decimal
import math
import random
import uuid

import pytest

from marlstone import queries
from marlstone.operators import ranges
from marlstone.sources import is_sorted, parquet

DIR = "/root/testdata/sf0.001"


def made(df, node):
    """Rows that a plan's joins have made, after it ran."""
    df.collect()
    found, left = 0, [df._jdf.queryExecution().executedPlan()]
    while left:
        p = left.pop()
        if p.getClass().getSimpleName() == "AdaptiveSparkPlanExec":
            left.append(p.executedPlan())
            continue
        if p.getClass().getSimpleName().endswith("QueryStageExec"):
            left.append(p.plan())
        if node in p.nodeName():
            found += p.metrics().apply("numOutputRows").value()
        children = p.children()
        left += [children.apply(i) for i in range(children.size())]
    return found


def largest(spark, work):
    """What work() gives, and the most rows that one of its tasks has read from a shuffle."""
    group, sc = uuid.uuid4().hex, spark.sparkContext
    sc.setJobGroup(group, group)
    try:
        out = work()
    finally:
        sc.setLocalProperty("spark.jobGroup.id", None)
    store, most = sc._jsc.sc().statusStore(), 0
    for job in sc.statusTracker().getJobIdsForGroup(group):
        for stage in sc.statusTracker().getJobInfo(job).stageIds:
            tasks = store.taskList(stage, 0, 10000)
            for i in range(tasks.size()):
                m = tasks.apply(i).taskMetrics()
                most = max(most, m.get().shuffleReadMetrics().recordsRead() if m.isDefined() else 0)
    return out, most


def test_count_of_pairs_makes_no_pairs(spark):
    part = spark.read.parquet(f"{DIR}/part.parquet")
    df = queries.queries()["join_string_key"](spark, DIR)
    pairs = sum(r["count"] ** 2 for r in part.groupBy("p_brand", "p_type").count().collect())
    assert df.first().n == pairs > part.count()
    assert 0 < made(df, "Join") <= part.count()


@pytest.mark.parametrize(
    "sql",
    [
        "SELECT count(*) AS n FROM l JOIN r ON l.a = r.a", "SELECT count(*) n FROM l AS x INNER JOIN r AS y ON y.a = x.a AND x.b = y.b", "SELECT COUNT(*) FROM l x JOIN l y ON x.b = y.b",
        "SELECT count(*) AS n FROM l JOIN (SELECT a FROM r WHERE a > 90) r ON l.a = r.a", "SELECT count(*) AS n FROM (SELECT a + 1 AS a FROM l) x JOIN (SELECT a FROM r) y ON x.a = y.a",
        # other texts stay as they are
        "SELECT count(*) AS n FROM l LEFT JOIN r ON l.a = r.a", "SELECT count(*) AS n FROM l JOIN r ON l.a = r.a AND l.b < r.b", "SELECT count(*) AS n FROM l JOIN r ON l.a = r.a WHERE l.b = 'x'",
        "SELECT count(*) AS n FROM l JOIN r ON l.a = r.a GROUP BY l.b", "SELECT count(*) AS n FROM l JOIN r ON l.a = r.a OR l.b = r.b", "SELECT count(*) + 1 AS n FROM l JOIN r ON l.a = r.a", "SELECT count(*) AS n FROM l JOIN r ON l.a = r.a HAVING count(*) > 100",
        "SELECT count(*) AS n FROM l SEMI JOIN r ON l.a = r.a", "SELECT count(*) AS n FROM l JOIN r ON l.a = r.a LIMIT 0", "SELECT count(*) AS n FROM l CROSS JOIN r", "SELECT count(*) AS n FROM l JOIN r ON l.a = l.a",
    ],
)
def test_count_of_pairs(spark, engine, sql):
    engine.bind(
        l=spark.createDataFrame([(1, "x"), (1, "x"), (1, None), (2, "y"), (None, "x"), (None, None)], "a int, b string"),
        r=spark.createDataFrame([(1, "x"), (1, "y"), (2, None), (None, "x"), (3, "x")], "a bigint, b string"),
    )
    got, plain = engine.sql(sql), spark.sql(sql)
    assert got.collect() == plain.collect()
    assert got.dtypes == plain.dtypes


def test_sortedness_of_a_large_file(spark, tmp_path):
    n, path = 3 << 20, str(tmp_path / "one.parquet")
    spark.range(0, n, 1, 1).write.parquet(path)
    found, most = largest(spark, lambda: is_sorted(spark.read.parquet(path), "id"))
    assert found and 0 < most < n * 2 / 3


@pytest.mark.parametrize(
    ("files", "want"),
    [
        ([[1, 1, 2, 3, 3, 4, 5]], True), ([[1, 2, 3, 4, 3, 5, 6]], False), ([[1, 2, 3, 2, 5, 6, 7, 8]], False), ([[1, 2], [2, 3, 4]], True), ([[1, 2, 3], [2, 3, 4]], False), ([[1, 2, 3, 4], [3, 5]], False),
        ([[3, None, 1]], True), ([[1, 2, 3, None], [1]], True), ([[None, None]], True), ([[], [2, 3]], True), ([[]], True), ([[1.0, float("nan")], [2.0]], False), ([[1.0, 2.0], [float("nan")]], True),
    ],
)
def test_sortedness(spark, tmp_path, monkeypatch, files, want):
    kind = "double" if any(isinstance(v, float) for f in files for v in f) else "bigint"
    for k, f in enumerate(files):
        spark.createDataFrame([(v,) for v in f], f"v {kind}").coalesce(1).write.parquet(f"{tmp_path}/{k}.parquet")
    df = spark.read.parquet(*[f"{tmp_path}/{k}.parquet" for k in range(len(files))])
    assert is_sorted(df, "v") is want
    for block in (1, 2, 3):
        monkeypatch.setattr(parquet, "BLOCK_ROWS", block)
        monkeypatch.setattr(parquet, "TASK_ROWS", 2 * block)
        assert is_sorted(df, "v") is want


def test_ranks_of_few_large_groups(spark, monkeypatch):
    monkeypatch.setattr(ranges, "RANGE_ROWS", 1000)
    rows = spark.read.parquet("/root/testdata/sf0.01/lineitem.parquet")
    least = max(r["count"] for r in rows.groupBy("l_returnflag", "l_linestatus").count().collect())
    df, _ = largest(spark, lambda: queries.queries()["window_multi_keys"](spark, "/root/testdata/sf0.01"))
    got, most = largest(spark, lambda: df.collect())
    assert 0 < most < least
    rows.createOrReplaceTempView("plain_lines")
    want = spark.sql(queries.oracle_sql()["window_multi_keys"].replace("FROM lineitem", "FROM plain_lines")).collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, want))


@pytest.fixture(scope="module")
def odd(spark):
    """Rows with ties, nulls, NaN and both zeros."""
    r = random.Random(5)
    pick = lambda *v: r.choice(v)
    rows = [
        (i, pick("a", "a", "a", "b", None), pick(0.0, -0.0, 1.5, -2.5, math.nan, math.inf, -math.inf, None), pick("", "x", "xy", "y", "\u00e9", None), pick(None, -(1 << 63), (1 << 63) - 1, 0, 7),
         pick(None, decimal.Decimal("1.25"), decimal.Decimal("-3.00")), pick(None, datetime.date(1960, 1, 2), datetime.date(2020, 1, 2)), pick(True, False, None), pick(None, datetime.datetime(2020, 1, 2, 3, 4, 5, 6), datetime.datetime(1950, 1, 1)))
        for i in range(900)
    ]
    df = spark.createDataFrame(rows, "i int, g string, d double, s string, n bigint, m decimal(9,2), t date, b boolean, z timestamp")
    df.createOrReplaceTempView("odd")
    return df


@pytest.mark.parametrize("order", ["d", "d DESC", "s", "s DESC", "n", "n DESC NULLS FIRST", "m", "m DESC", "t NULLS FIRST", "t DESC", "b DESC, z", "z DESC, d DESC, s", "d + 1, s DESC", "lower(s) DESC", "i % 7"])
@pytest.mark.parametrize("by", ["", "PARTITION BY g ", "PARTITION BY g, b "])
def test_ranks_by_ranges(spark, engine, monkeypatch, odd, order, by):
    text = f"SELECT i, rank() OVER ({by}ORDER BY {order}) AS r, g, dense_rank() OVER ({by}ORDER BY {order}) AS dr, row_number() OVER ({by}ORDER BY {order}, i) AS n FROM odd WHERE i > 10"
    want = engine.sql(text)
    monkeypatch.setattr(ranges, "RANGE_ROWS", 40)
    got = engine.sql(text)
    assert "Window" in (plan := got._jdf.queryExecution().analyzed().toString()) and "__r" in plan and "__r" not in want._jdf.queryExecution().analyzed().toString()
    assert got.dtypes == want.dtypes
    assert sorted(got.collect(), key=lambda x: x.i) == sorted(want.collect(), key=lambda x: x.i)


@pytest.mark.parametrize(
    ("text", "cut"),
    [
        ("SELECT *, row_number() OVER (ORDER BY i) AS `the number` FROM odd", True), ("SELECT x.i, y.i, rank() OVER (ORDER BY x.i) r FROM odd x JOIN odd y ON x.i = y.i", True),
        ("SELECT i AS k, rank() OVER (ORDER BY d DESC) AS r FROM odd ORDER BY r DESC, k LIMIT 25 OFFSET 5", True), ("SELECT i, rank() OVER (ORDER BY n) AS r FROM odd ORDER BY 2, 1 LIMIT 9", True),
        # an order by what isn't shown, rows that may differ from pass to pass, small groups, and other windows stay as they are
        ("SELECT i, rank() OVER (ORDER BY n) AS r FROM odd ORDER BY s, i LIMIT 9", False), ("SELECT i, row_number() OVER (ORDER BY i) AS r FROM (SELECT i FROM odd ORDER BY i LIMIT 700) t", False),
        ("SELECT i, row_number() OVER (PARTITION BY i ORDER BY n) AS r FROM odd", False), ("SELECT i, count(*) OVER () AS c, row_number() OVER (ORDER BY i) AS r FROM odd", False), ("SELECT count(*) AS c, rank() OVER (ORDER BY count(*)) AS r FROM odd GROUP BY g", False),
        ("SELECT i, row_number() OVER (ORDER BY i) AS r FROM odd UNION ALL SELECT 1, 2", False),
    ],
)
def test_ranks_in_texts(spark, engine, monkeypatch, odd, text, cut):
    want = engine.sql(text)
    monkeypatch.setattr(ranges, "RANGE_ROWS", 40)
    got = engine.sql(text)
    assert ("__r" in got._jdf.queryExecution().analyzed().toString()) == cut
    assert got.dtypes == want.dtypes
    if " LIMIT " in text and "FROM (" not in text:
        assert list(map(str, got.collect())) == list(map(str, want.collect()))
    else:
        assert sorted(map(str, got.collect())) == sorted(map(str, want.collect()))
