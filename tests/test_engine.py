import io

import pytest
from pyspark.sql import functions as F

from marlstone import errors
from marlstone import functions as X
from marlstone import operators as O
from marlstone.cli import main
from marlstone.sources import is_sorted, row_group_count, row_groups, scan_size, total_rows
from marlstone.streaming import windowed_counts

ORDERS = "/root/testdata/sf0.001/orders.parquet"


def test_copy_csv(engine, tmp_path):
    path = str(tmp_path / "out.csv")
    n = engine.sql(f"""COPY (SELECT * FROM VALUES (1, 'plain', NULL), (2, 'a,"b"', true) AS t(id, text, flag) ORDER BY id) TO '{path}' (FORMAT CSV, HEADER true)""")
    assert n == 2 and open(path).read() == 'id,text,flag\n1,plain,\n2,"a,""b""",true\n'


def test_copy_parquet(engine, tmp_path):
    path = str(tmp_path / "out.parquet")
    assert engine.sql(f"COPY (SELECT o_orderkey FROM '{ORDERS}' WHERE o_orderkey <= 10) TO '{path}' (FORMAT PARQUET, COMPRESSION zstd)") == engine.rows(f"SELECT count(*) FROM '{path}'")[0][0]
    assert (tmp_path / "out.parquet").is_file()


def test_catalog_pins_files(engine, spark, tmp_path):
    place = str(tmp_path / "t")
    spark.range(3).coalesce(1).write.parquet(place)
    t = engine.catalog.register("Things", place)
    assert (t.name, t.rows, len(t.files)) == ("things", 3, 1)
    spark.range(4).coalesce(1).write.mode("append").parquet(place)
    assert engine.rows("SELECT count(*) FROM things")[0][0] == 3
    engine.catalog.refresh("THINGS")
    assert engine.rows("SELECT count(*) FROM things")[0][0] == 7
    with pytest.raises(errors.CatalogError):
        engine.catalog.register("bad-name", place)
    with pytest.raises(errors.UnknownTable):
        engine.catalog.get("none")
    spark.createDataFrame([("x",)], "other string").write.mode("append").parquet(place)
    with pytest.raises(errors.SchemaMismatch):
        engine.catalog.refresh("things")


def test_partition_columns_are_text(engine, spark, tmp_path):
    place = str(tmp_path / "p")
    spark.range(4).selectExpr("id", "id % 2 AS k").write.partitionBy("k").parquet(place)
    rows = engine.rows(f"SELECT k, count(*) AS n FROM '{place}' GROUP BY k ORDER BY k")
    assert [tuple(r) for r in rows] == [("0", 2), ("1", 2)]


def test_footers(spark, tmp_path):
    path = str(tmp_path / "s")
    spark.range(100).coalesce(1).write.parquet(path)
    assert total_rows(spark, path) == 100 and row_group_count(spark, path) == 1 and scan_size(spark, path, ["id"]) > 0
    assert row_groups(spark, path, [0]).count() == 100 and row_groups(spark, path, []).count() == 0
    assert is_sorted(spark.read.parquet(path), "id")
    spark.range(100).selectExpr("100 - id AS id").coalesce(1).write.mode("overwrite").parquet(path)
    assert not is_sorted(spark.read.parquet(path), "id")


def test_pushdown(engine):
    r = engine.explain(f"SELECT o_orderkey FROM '{ORDERS}' WHERE o_totalprice > 1000 ORDER BY o_orderkey LIMIT 5")
    assert "o_orderkey" in r.read[0] and "o_custkey" not in r.read[0] and "o_totalprice" in r.pushed[0]
    assert "sort and limit to top-n" in r.rewrites


def test_metrics(engine):
    m = engine.scan_metrics(O.ScanRequest(ORDERS, ("o_orderkey",)))
    assert m.rows == 1500 and m.row_groups >= 1 and m.bytes > 0


@pytest.mark.parametrize("text", ["median(x)", "sum(distinct x)", "sum(*)", "count"])
def test_aggregate_parser_refuses(text):
    from marlstone.operators.aggregate import parse

    with pytest.raises(errors.ParseError):
        parse(text)


def test_null_keys_and_kinds(spark):
    a = spark.createDataFrame([(1, "a"), (2, "b"), (None, "n")], "k int, x string")
    b = spark.createDataFrame([(2, "c"), (None, "m"), (3, "d")], "k int, y string")
    rows = lambda kind: sorted(tuple(r) for r in O.join(a, b, O.JoinRequest((("k", "k"),), kind, left_columns=("x",), right_columns=("y",) if kind not in ("semi", "anti") else None)).collect())
    assert rows("inner") == [("b", "c")]
    assert rows("semi") == [("b",)] and rows("anti") == [("a",), ("n",)]
    assert len(O.join(a, b, O.JoinRequest((("k", "k"),), "full", "l_", "r_")).collect()) == 5


def test_int_div_truncates(spark):
    df = spark.createDataFrame([(-7, 2), (7, -2), (7, 0)], "a bigint, b bigint")
    assert [r[0] for r in df.select(X.int_div(df.a, df.b)).collect()] == [-3, -3, None]


def test_cli(engine, tmp_path):
    def run(*args):
        out = io.StringIO()
        assert main(list(args), engine, out) == 0
        return out.getvalue()

    assert run("query", "SELECT 1 AS a, 'x' AS b") == "1,x\n"
    assert run("aggregate", ORDERS, "--aggregate", "count(*)") == "1500\n"
    assert run("scan", ORDERS, "--columns", "o_orderkey", "--order-by", "o_orderkey", "--limit", "2").count("\n") == 2
    f = tmp_path / "q.sql"
    f.write_text("SELECT 1; SELECT ';';")
    assert run("query-file", str(f)) == "1\n;\n"
    run("catalog", "register", "orders_table", ORDERS)
    assert run("catalog", "list").startswith("orders_table ")


def test_stream_counts_as_the_batch(spark, tmp_path):
    spark.read.parquet("/root/testdata/sf0.001/events.parquet").repartition(2).write.parquet(str(tmp_path / "in"))
    batch = spark.read.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(batch.schema).parquet(str(tmp_path / "in"))
    q = windowed_counts(stream, "ts", ["event_type"]).writeStream.format("memory").queryName("counts").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination()
    assert sorted(map(tuple, spark.table("counts").collect())) == sorted(map(tuple, windowed_counts(batch, "ts", ["event_type"]).collect()))


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())


def test_row_groups_of_files_named_alike(spark, tmp_path):
    import pyarrow as pa
    import pyarrow.parquet as pq

    for folder, at in (("k=a b", 0), ("k=c", 100)):
        (tmp_path / "t" / folder).mkdir(parents=True)
        pq.write_table(pa.table({"v": list(range(at, at + 20))}), tmp_path / "t" / folder / "same.parquet", row_group_size=5)
    got = lambda *g: sorted(r.v for r in row_groups(spark, str(tmp_path / "t"), list(g)).select("v").collect())
    assert got(1) == list(range(5, 10)) and got(4, 7) == [*range(100, 105), *range(115, 120)] and got() == []


def test_csv_headers_are_quoted(engine, tmp_path):
    path = f"{tmp_path}/x.csv"
    assert engine.sql(f"""COPY (SELECT 1 AS "a,b", 2 AS "c""d") TO '{path}' (FORMAT CSV, HEADER true)""") == 1
    assert open(path).read() == '"a,b","c""d"\n1,2\n'


def test_whole_part_beyond_doubles(spark):
    from marlstone.functions import int_div

    df = spark.createDataFrame([(9007199254740993, 1), (-7, 2), (5, 0)], "a long, b long")
    assert [r.q for r in df.select(int_div(F.col("a"), F.col("b")).alias("q")).collect()] == [9007199254740993, -3, None]
