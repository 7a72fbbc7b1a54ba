"""Queries by the engine's calls, without SQL text."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .. import functions as X
from .. import operators as O
from ..engine import Engine
from ..sources import column_constant, column_max, is_sorted, row_group_count, total_rows
from ..streaming import windowed_counts


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def api_scan(spark, d):
    return Engine(spark).scan(O.ScanRequest(f"{d}/orders.parquet", ("o_orderkey", "o_totalprice"), "o_totalprice > 100000", ("o_totalprice desc", "o_orderkey"), 50, 10))


def api_scan_distinct(spark, d):
    return Engine(spark).scan(O.ScanRequest(f"{d}/part.parquet", ("p_brand", "p_type"), distinct=True, order_by=("p_brand", "p_type")))


def api_scan_file_order(spark, d):
    return Engine(spark).scan(O.ScanRequest(f"{d}/nation.parquet", ("n_nationkey", "n_name"), in_file_order=True))


def api_scan_row_groups(spark, d):
    path = f"{d}/lineitem.parquet"
    return O.scan(spark, O.ScanRequest(path, ("l_orderkey", "l_linenumber"), groups=tuple(range(row_group_count(spark, path)))))


def api_key_filter(spark, d):
    keys = table(spark, d, "customer").where("c_acctbal > 9000")
    return O.filtered_by_keys(table(spark, d, "orders"), "o_custkey", keys, "c_custkey").select("o_orderkey", "o_custkey")


def api_footers(spark, d):
    path, df = f"{d}/orders.parquet", table(spark, d, "orders")
    rows = [("rows", total_rows(spark, path)), ("top_key", column_max(df, "o_orderkey")), ("constant", column_constant(df.where("o_custkey = 7"), "o_custkey")), ("sorted", int(is_sorted(df, "o_orderkey")))]
    return spark.createDataFrame(rows, "what string, value long")


def api_aggregate(spark, d):
    return Engine(spark).aggregate(f"{d}/orders.parquet", ["count(*) as n", "count(distinct o_custkey) as customers", "max(o_totalprice) as top", "min(o_orderkey) filter (where o_totalprice > 1000) as first_key"], ["o_orderstatus"], "o_custkey > 5", "n > 1")


def api_join(spark, d):
    r = O.JoinRequest((("o_custkey", "c_custkey"),), "left", left_columns=("o_orderkey",), right_columns=("c_name",), right_where="c_acctbal > 0", memory_limit=1 << 20)
    return Engine(spark).join(f"{d}/orders.parquet", f"{d}/customer.parquet", r)


def api_join_merge(spark, d):
    return O.join(table(spark, d, "nation"), table(spark, d, "supplier"), O.JoinRequest((("n_nationkey", "s_nationkey"),), algorithm="merge", left_columns=("n_name",), right_columns=("s_suppkey",)))


def api_join_hash(spark, d):
    return O.join(table(spark, d, "lineitem"), table(spark, d, "orders"), O.JoinRequest((("l_orderkey", "o_orderkey"),), algorithm="hash", left_columns=("l_orderkey", "l_linenumber"), right_columns=("o_orderstatus",)))


def api_join_full_prefixed(spark, d):
    r = O.JoinRequest((("s_suppkey", "c_custkey"),), "full", "s_", "c_", left_columns=("s_suppkey",), right_columns=("c_custkey",))
    return O.join(table(spark, d, "supplier"), table(spark, d, "customer"), r).toDF("supplier_key", "customer_key")


def api_semi_anti(spark, d):
    c, o = table(spark, d, "customer"), table(spark, d, "orders").where("o_totalprice > 150000")
    a = O.semi_join(c, o, ("c_custkey", "o_custkey")).select("c_custkey", F.lit("with").alias("kind"))
    return O.union(a, O.anti_join(c, o, ("c_custkey", "o_custkey")).select("c_custkey", F.lit("without").alias("kind")), all=True)


def api_windows(spark, d):
    by, order = ["o_custkey"], ["o_totalprice desc", "o_orderkey"]
    return table(spark, d, "orders").select(
        "o_orderkey", O.rank_by("row_number", by, order).alias("rn"), O.rank_by("dense_rank", by, ["o_orderpriority"]).alias("dr"), O.lag("o_orderkey", 1, by, order).alias("prev"), O.lead("o_orderkey", 1, by, order).alias("next"),
        F.round(O.whole("sum", F.col("o_totalprice"), by), 2).alias("total"), O.running("count", F.lit(1), by, order, by_row=True).alias("n"),
    )


def api_sets(spark, d):
    a, b = table(spark, d, "customer").select(F.col("c_nationkey").alias("k")), table(spark, d, "supplier").select(F.col("s_nationkey").alias("k"))
    return O.union(O.intersect(a, b, all=True).withColumn("op", F.lit("i")), O.except_(a, b, all=True).withColumn("op", F.lit("e")), all=True)


def api_top_of_union(spark, d):
    a = table(spark, d, "customer").select(F.col("c_custkey").alias("k"), F.col("c_acctbal").alias("v"))
    b = table(spark, d, "supplier").select(F.col("s_suppkey").alias("k"), F.col("s_acctbal").alias("v"))
    return O.top_of_union([a, b], ["v desc", "k"], 20)


def api_group_distribution(spark, d):
    return O.group_distribution(table(spark, d, "orders"), "o_custkey")


def api_exchange(spark, d):
    df = O.hash_repartition(table(spark, d, "orders").select("o_custkey", "o_totalprice"), 8, "o_custkey")
    return O.gather(df.groupBy("o_custkey").agg(F.count("*").alias("n")))


def api_scalars(spark, d):
    c = F.col
    return table(spark, d, "part").select(
        "p_partkey", X.concat(c("p_brand"), F.nullif(c("p_type"), F.lit("PROMO"))).alias("joined"), X.substring(c("p_name"), 2, 3).alias("part"), X.length(c("p_name")).alias("n"), X.int_div(c("p_partkey"), F.lit(7).cast("bigint")).alias("q"),
        X.floor(c("p_retailprice")).alias("lo"), X.ceil(c("p_retailprice")).alias("hi"), X.round_half_up(c("p_retailprice")).alias("near"), X.absolute(-c("p_size")).alias("size"), X.list_at(F.array(c("p_size"), c("p_size") + 1), 2).alias("second"),
    )


def api_count_if(spark, d):
    return O.aggregate(table(spark, d, "lineitem"), [X.count_if(F.col("l_returnflag") == "R").alias("returned"), X.count_distinct(F.col("l_suppkey")).alias("suppliers"), F.round(X.avg(F.col("l_tax")), 8).alias("tax")], ["l_linestatus"])


def scratch(spark: SparkSession) -> str:
    """A new folder for what a query writes: in the one that executors share, if the cluster names it."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir() or "file://" + tempfile.mkdtemp(prefix="marlstone-")
    return f"{base.rstrip('/')}/scratch-{uuid.uuid4().hex}"


def sink_copy_parquet(spark, d):
    path = scratch(spark) + "/out.parquet"
    engine = Engine(spark)
    n = engine.sql(f"COPY (SELECT o_orderkey, o_totalprice, o_orderstatus FROM '{d}/orders.parquet') TO '{path}' (FORMAT PARQUET, COMPRESSION zstd, ROW_GROUP_SIZE 5000, WRITE_BATCH_SIZE 512)")
    return engine.sql(f"SELECT o_orderkey, o_totalprice, o_orderstatus, {n} AS written FROM '{path}'")


def sink_copy_csv(spark, d):
    path = scratch(spark) + "/out.csv"
    n = Engine(spark).sql(f"COPY (SELECT p_partkey, concat(p_name, ', \"', p_brand, '\"') AS \"name, brand\", nullif(p_size, 7) AS p_size FROM '{d}/part.parquet') TO '{path}' (FORMAT CSV, HEADER true)")
    back = spark.read.option("header", True).option("escape", '"').schema("p_partkey bigint, label string, p_size bigint").option("enforceSchema", True).csv(path)
    return back.withColumn("written", F.lit(n))


def source_partition_folders(spark, d):
    path = scratch(spark) + "/orders"
    table(spark, d, "orders").select("o_orderkey", "o_orderstatus").write.partitionBy("o_orderstatus").parquet(path)
    return Engine(spark).table(path).select("o_orderkey", "o_orderstatus")


def source_catalog_snapshot(spark, d):
    """A registered table has the files of its registration until it is refreshed."""
    folder = scratch(spark)
    part = table(spark, d, "customer").select("c_custkey", "c_nationkey")
    part.where("c_nationkey < 10").write.parquet(f"{folder}/t")
    engine = Engine(spark, tempfile.mkdtemp(prefix="marlstone-") + "/catalog.json")
    engine.catalog.register("pinned", f"{folder}/t")
    part.where("c_nationkey >= 10").write.mode("append").parquet(f"{folder}/t")
    before = engine.sql("SELECT 'before' AS moment, count(*) AS n, sum(c_custkey) AS keys FROM pinned").collect()
    engine.catalog.refresh("pinned")
    after = engine.sql("SELECT 'after' AS moment, count(*) AS n, sum(c_custkey) AS keys FROM pinned").collect()
    return spark.createDataFrame([*before, *after], "moment string, n bigint, keys bigint")


def api_scan_metrics(spark, d):
    m = Engine(spark).scan_metrics(O.ScanRequest(f"{d}/orders.parquet", ("o_orderkey",), "o_totalprice > 100000"))
    return spark.createDataFrame([(m.rows, m.row_groups > 0, m.bytes > 0)], "n bigint, groups boolean, bytes boolean")


def api_explain(spark, d):
    """What a plan report tells: columns read, filters pushed, and how a subquery was rewritten."""
    r = Engine(spark).explain(f"SELECT o_orderkey FROM '{d}/orders.parquet' WHERE o_totalprice > 100000 AND o_custkey IN (SELECT c_custkey FROM '{d}/customer.parquet')")
    facts = [("pushed", any("GreaterThan(o_totalprice" in p for p in r.pushed)), ("pruned", not any("o_orderpriority" in c for c in r.read)), ("semi", "subquery to semi-join" in r.rewrites)]
    return spark.createDataFrame(facts, "what string, holds boolean")


def api_errors(spark, d):
    """The engine's errors by name, for statements that can't run."""
    engine, path = Engine(spark), f"{d}/nation.parquet"
    texts = {
        "column": f"SELECT nope FROM '{path}'", "table": "SELECT 1 FROM no_such_table_here", "cast": f"SELECT CAST(n_name AS BIGINT) AS x FROM '{path}'",
        "ordinal": f"SELECT n_name FROM '{path}' ORDER BY 7", "rows": f"SELECT (SELECT n_name FROM '{path}') AS x", "syntax": "SELECT 1 +", "statement": "DROP TABLE x",
    }
    found = []
    for what, sql in texts.items():
        try:
            engine.rows(sql)
        except Exception as e:
            found.append((what, type(e).__name__))
    return spark.createDataFrame(found, "what string, error string")


def api_latest_per_user(spark, d):
    w = Window.partitionBy("user_id").orderBy(X.sort_key("ts desc"), X.sort_key("event_id desc"))
    return table(spark, d, "events").withColumn("rn", F.row_number().over(w)).where("rn = 1").select("user_id", "event_id", "event_type")


def stream_windowed_counts(spark, d):
    return windowed_counts(table(spark, d, "events"), "ts", ["event_type"], value="value")


PAIRS = {
    api_scan: "SELECT o_orderkey, o_totalprice FROM orders WHERE o_totalprice > 100000 ORDER BY o_totalprice DESC, o_orderkey LIMIT 50 OFFSET 10",
    api_scan_distinct: "SELECT DISTINCT p_brand, p_type FROM part",
    api_scan_file_order: "SELECT n_nationkey, n_name FROM nation",
    api_scan_row_groups: "SELECT l_orderkey, l_linenumber FROM lineitem",
    api_key_filter: "SELECT o_orderkey, o_custkey FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_acctbal > 9000)",
    api_footers: "SELECT 'rows' AS what, count(*) AS value FROM orders UNION ALL SELECT 'top_key', max(o_orderkey) FROM orders UNION ALL SELECT 'constant', min(o_custkey) FROM orders WHERE o_custkey = 7 UNION ALL SELECT 'sorted', CAST(bool_and(o_orderkey >= p) AS INT) FROM (SELECT o_orderkey, coalesce(lag(o_orderkey) OVER (ORDER BY rowid_), o_orderkey) AS p FROM (SELECT o_orderkey, row_number() OVER () AS rowid_ FROM orders))",
    api_aggregate: "SELECT o_orderstatus, count(*) AS n, count(DISTINCT o_custkey) AS customers, max(o_totalprice) AS top, min(o_orderkey) FILTER (WHERE o_totalprice > 1000) AS first_key FROM orders WHERE o_custkey > 5 GROUP BY o_orderstatus HAVING count(*) > 1",
    api_join: "SELECT o_orderkey, c_name FROM orders LEFT JOIN (SELECT * FROM customer WHERE c_acctbal > 0) ON o_custkey = c_custkey",
    api_join_merge: "SELECT n_name, s_suppkey FROM nation JOIN supplier ON n_nationkey = s_nationkey",
    api_join_hash: "SELECT l_orderkey, l_linenumber, o_orderstatus FROM lineitem JOIN orders ON l_orderkey = o_orderkey",
    api_join_full_prefixed: "SELECT s_suppkey AS supplier_key, c_custkey AS customer_key FROM supplier FULL JOIN customer ON s_suppkey = c_custkey",
    api_semi_anti: "SELECT c_custkey, CASE WHEN c_custkey IN (SELECT o_custkey FROM orders WHERE o_totalprice > 150000) THEN 'with' ELSE 'without' END AS kind FROM customer",
    api_windows: "SELECT o_orderkey, row_number() OVER w AS rn, dense_rank() OVER (PARTITION BY o_custkey ORDER BY o_orderpriority) AS dr, lag(o_orderkey) OVER w AS prev, lead(o_orderkey) OVER w AS next, round(sum(o_totalprice) OVER (PARTITION BY o_custkey), 2) AS total, row_number() OVER w AS n FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey)",
    api_sets: "SELECT k, 'i' AS op FROM (SELECT c_nationkey AS k FROM customer INTERSECT ALL SELECT s_nationkey FROM supplier) UNION ALL SELECT k, 'e' FROM (SELECT c_nationkey AS k FROM customer EXCEPT ALL SELECT s_nationkey FROM supplier)",
    api_top_of_union: "SELECT c_custkey AS k, c_acctbal AS v FROM customer UNION ALL SELECT s_suppkey, s_acctbal FROM supplier ORDER BY v DESC, k LIMIT 20",
    api_group_distribution: "SELECT size, count(*) AS groups FROM (SELECT o_custkey, count(*) AS size FROM orders GROUP BY o_custkey) GROUP BY size",
    api_exchange: "SELECT o_custkey, count(*) AS n FROM orders GROUP BY o_custkey",
    api_scalars: "SELECT p_partkey, concat(p_brand, nullif(p_type, 'PROMO')) AS joined, substring(p_name, 2, 3) AS part, length(p_name) AS n, p_partkey // 7 AS q, floor(p_retailprice) AS lo, ceil(p_retailprice) AS hi, round(p_retailprice) AS near, CAST(p_size AS DOUBLE) AS size, p_size + 1 AS second FROM part",
    api_count_if: "SELECT l_linestatus, count(*) FILTER (WHERE l_returnflag = 'R') AS returned, count(DISTINCT l_suppkey) AS suppliers, round(avg(l_tax), 8) AS tax FROM lineitem GROUP BY l_linestatus",
    sink_copy_parquet: "SELECT o_orderkey, o_totalprice, o_orderstatus, (SELECT count(*) FROM orders) AS written FROM orders",
    sink_copy_csv: "SELECT p_partkey, concat(p_name, ', \"', p_brand, '\"') AS label, nullif(p_size, 7) AS p_size, (SELECT count(*) FROM part) AS written FROM part",
    source_partition_folders: "SELECT o_orderkey, o_orderstatus FROM orders",
    source_catalog_snapshot: "SELECT 'before' AS moment, count(*) AS n, CAST(sum(c_custkey) AS BIGINT) AS keys FROM customer WHERE c_nationkey < 10 UNION ALL SELECT 'after', count(*), CAST(sum(c_custkey) AS BIGINT) FROM customer",
    api_scan_metrics: "SELECT count(*) AS n, true AS groups, true AS bytes FROM orders WHERE o_totalprice > 100000",
    api_explain: "SELECT unnest(['pushed', 'pruned', 'semi']) AS what, true AS holds",
    api_errors: "SELECT unnest(['column', 'table', 'cast', 'ordinal', 'rows', 'syntax', 'statement']) AS what, unnest(['UnknownColumn', 'UnknownTable', 'InvalidCast', 'OrdinalOutOfRange', 'SubqueryCardinality', 'ParseError', 'UnsupportedError']) AS error",
    api_latest_per_user: "SELECT user_id, event_id, event_type FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS rn FROM events) WHERE rn = 1",
    stream_windowed_counts: "SELECT date_trunc('day', ts) AS window_start, event_type, count(*) AS n, round(sum(value), 2) AS total FROM events GROUP BY ALL",
}

QUERIES = {f.__name__: f for f in PAIRS}
ORACLE = {f.__name__: sql for f, sql in PAIRS.items()}
