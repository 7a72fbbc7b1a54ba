"""One query or more for each operator of the engine's SQL, over the tables."""

from __future__ import annotations

from .text import both

FILE = "'{dir}/orders.parquet'"

TEXTS: dict[str, str | tuple[str, str]] = {
    # scans and table references
    "scan_projection": "SELECT o_orderkey, o_totalprice FROM orders",
    "scan_path_table": (f"SELECT orders.o_orderkey, o_orderstatus FROM {FILE} WHERE orders.o_totalprice > 100000", "SELECT o_orderkey, o_orderstatus FROM orders WHERE o_totalprice > 100000"),
    "scan_path_alias": (f"SELECT x.o_orderkey FROM {FILE} AS x", "SELECT o_orderkey FROM orders"),
    "scan_ordered_multi_key": "SELECT c_custkey, c_nationkey, c_acctbal FROM customer ORDER BY c_nationkey DESC, c_acctbal, c_custkey",
    "scan_distinct": "SELECT DISTINCT o_orderstatus, o_orderpriority FROM orders",
    "scan_key_set_filtered": "SELECT l_orderkey, l_linenumber FROM lineitem SEMI JOIN (SELECT o_orderkey FROM orders WHERE o_totalprice > 200000) k ON l_orderkey = k.o_orderkey",
    "scan_list_column": ("SELECT vec_id, size(embedding) AS n, embedding[1] AS first_value FROM embeddings", "SELECT vec_id, CAST(len(embedding) AS BIGINT) AS n, embedding[1] AS first_value FROM embeddings"),
    # projection
    "project_expression": "SELECT l_orderkey, l_linenumber, l_extendedprice * (1 - l_discount) AS net, l_quantity + 1 AS more FROM lineitem",
    "project_wildcard": "SELECT * FROM nation",
    "project_qualified_wildcard": "SELECT n.*, r_name FROM nation n JOIN region r ON n.n_regionkey = r.r_regionkey",
    "project_alias_order": "SELECT c_custkey AS id, c_acctbal * 2 AS twice FROM customer ORDER BY twice DESC, id",
    "project_constant": "SELECT r_name, 1 AS one, 'x' AS letter, true AS yes FROM region",
    # predicates
    "filter_comparisons": "SELECT o_orderkey FROM orders WHERE o_totalprice >= 50000 AND o_totalprice < 150000 AND o_orderstatus <> 'F' AND o_custkey > 10 AND o_custkey <= 900",
    "filter_column_to_column": "SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_partkey < l_suppkey",
    "filter_expression_to_expression": "SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_quantity * 2 > l_extendedprice / 500",
    "filter_boolean_logic": "SELECT o_orderkey FROM orders WHERE (o_orderstatus = 'O' OR NOT o_totalprice < 100000) AND NOT (o_custkey < 50 AND o_orderpriority = '5-LOW')",
    "filter_kleene_null": "SELECT count(*) AS n FROM orders WHERE (nullif(o_orderstatus, 'F') = 'O') OR o_totalprice > 100000",
    "filter_between": "SELECT p_partkey FROM part WHERE p_size BETWEEN 10 AND 20 AND p_retailprice NOT BETWEEN 1000 AND 1200",
    "filter_in_list": "SELECT p_partkey FROM part WHERE p_type IN ('PROMO', 'ECONOMY') AND p_size NOT IN (1, 2, 3)",
    "filter_in_list_null": "SELECT p_partkey FROM part WHERE p_size IN (5, NULL, 7)",
    "filter_not_in_list_null": "SELECT p_partkey FROM part WHERE p_size NOT IN (5, NULL)",
    "filter_is_null": "SELECT c_custkey, nullif(c_mktsegment, 'BUILDING') IS NULL AS gone FROM customer WHERE nullif(c_nationkey, 3) IS NOT NULL",
    "filter_like": "SELECT p_partkey FROM part WHERE p_name LIKE 'c%' AND p_name NOT LIKE '%x_' AND p_brand LIKE 'Brand#1_'",
    "filter_like_escape": "SELECT n_nationkey FROM nation WHERE n_name LIKE 'NATION!__' ESCAPE '!' OR n_name NOT LIKE '%!_1%' ESCAPE '!'",
    "filter_ilike": "SELECT p_partkey FROM part WHERE p_name ILIKE '%COLD%' AND p_type NOT ILIKE 'promo'",
    "filter_constants": "SELECT r_regionkey FROM region WHERE true AND 1 = 1",
    "filter_null_predicate": "SELECT r_regionkey FROM region WHERE NULL",
    "filter_having": "SELECT o_custkey, count(*) AS n FROM orders GROUP BY o_custkey HAVING count(*) > 12",
    "filter_having_alias": "SELECT o_custkey, count(*) AS n, max(o_totalprice) AS top FROM orders GROUP BY o_custkey HAVING n > 10 AND top > 100000",
    "filter_list_element": "SELECT vec_id FROM embeddings WHERE embedding[3] > 0.1",
    "filter_date_column": "SELECT o_orderkey FROM orders WHERE o_orderdate >= '1999-01-01' AND o_orderdate < DATE '1999-02-01'",
    # joins
    "join_inner": "SELECT o_orderkey, c_name FROM orders JOIN customer ON o_custkey = c_custkey",
    "join_inner_multi_key": "SELECT a.l_orderkey, a.l_linenumber, b.l_quantity FROM lineitem a JOIN lineitem b ON a.l_orderkey = b.l_orderkey AND a.l_linenumber = b.l_linenumber WHERE a.l_quantity > 45",
    "join_left": "SELECT c_custkey, o_orderkey FROM customer LEFT JOIN orders ON c_custkey = o_custkey",
    "join_right": "SELECT c_custkey, o_orderkey FROM orders RIGHT JOIN customer ON c_custkey = o_custkey",
    "join_full": "SELECT s.s_suppkey, c.c_custkey FROM supplier s FULL OUTER JOIN customer c ON s.s_suppkey = c.c_custkey AND s.s_acctbal > c.c_acctbal",
    "join_semi": "SELECT c_custkey FROM customer SEMI JOIN orders ON c_custkey = o_custkey",
    "join_anti": ("SELECT c_custkey FROM customer LEFT ANTI JOIN (SELECT o_custkey FROM orders WHERE o_totalprice > 150000) o ON c_custkey = o_custkey", "SELECT c_custkey FROM customer ANTI JOIN (SELECT o_custkey FROM orders WHERE o_totalprice > 150000) o ON c_custkey = o_custkey"),
    "join_residual": "SELECT c_custkey, o_orderkey FROM customer LEFT JOIN orders ON c_custkey = o_custkey AND o_totalprice > 150000 AND o_orderstatus = 'O'",
    "join_comma": "SELECT n_name, r_name FROM nation, region WHERE n_regionkey = r_regionkey AND r_name <> 'ASIA'",
    "join_comma_or_key": "SELECT p_partkey, l_orderkey, l_linenumber FROM part, lineitem WHERE (p_partkey = l_partkey AND p_size < 3) OR (p_partkey = l_partkey AND l_quantity > 49)",
    "join_multi_way": "SELECT c_name, o_orderkey, l_linenumber, p_name FROM customer JOIN orders ON c_custkey = o_custkey JOIN lineitem ON l_orderkey = o_orderkey JOIN part ON p_partkey = l_partkey WHERE c_acctbal > 8000",
    "join_cross_with_key": "SELECT n_name, s_name FROM nation CROSS JOIN supplier WHERE n_nationkey = s_nationkey",
    "join_derived": "SELECT a.o_custkey, a.n, b.top FROM (SELECT o_custkey, count(*) AS n FROM orders GROUP BY o_custkey) a JOIN (SELECT o_custkey, max(o_totalprice) AS top FROM orders GROUP BY o_custkey) b ON a.o_custkey = b.o_custkey",
    "join_null_keys": "SELECT a.c_custkey FROM customer a JOIN (SELECT DISTINCT nullif(n_nationkey, 4) AS k FROM nation) b ON nullif(a.c_nationkey, 5) = b.k",
    "join_coalesce_group": "SELECT coalesce(c.c_mktsegment, 'none') AS segment, count(*) AS n, round(sum(o_totalprice), 2) AS total FROM orders o LEFT JOIN (SELECT * FROM customer WHERE c_acctbal > 0) c ON o.o_custkey = c.c_custkey GROUP BY coalesce(c.c_mktsegment, 'none')",
    "join_distinct": "SELECT DISTINCT n_name, c_mktsegment FROM customer JOIN nation ON c_nationkey = n_nationkey",
    "join_string_key": "SELECT count(*) AS n FROM part a JOIN part b ON a.p_brand = b.p_brand AND a.p_type = b.p_type",
    "join_self": "SELECT a.n_name AS x, b.n_name AS y FROM nation a JOIN nation b ON a.n_regionkey = b.n_regionkey WHERE a.n_nationkey < b.n_nationkey",
    "join_star_group": "SELECT r_name, c_mktsegment, count(*) AS n FROM customer, nation, region WHERE c_nationkey = n_nationkey AND n_regionkey = r_regionkey GROUP BY r_name, c_mktsegment",
    # aggregation
    "agg_global": "SELECT count(*) AS n, count(nullif(o_orderstatus, 'F')) AS some, round(sum(o_totalprice), 2) AS total, round(avg(o_totalprice), 6) AS mean, min(o_totalprice) AS lo, max(o_orderpriority) AS hi FROM orders",
    "agg_empty": "SELECT count(*) AS n, sum(o_totalprice) AS total, max(o_custkey) AS top FROM orders WHERE o_orderkey < 0",
    "agg_count_distinct": "SELECT o_orderstatus, count(DISTINCT o_custkey) AS customers, count(DISTINCT lower(o_orderpriority)) AS priorities FROM orders GROUP BY o_orderstatus",
    "agg_sum_int": ("SELECT sum(l_linenumber) AS total, sum(l_partkey) AS parts FROM lineitem", "SELECT CAST(sum(l_linenumber) AS BIGINT) AS total, CAST(sum(l_partkey) AS BIGINT) AS parts FROM lineitem"),
    "agg_decimal": ("SELECT l_returnflag, sum(CAST(l_extendedprice AS DECIMAL(15,2))) AS total, min(CAST(l_extendedprice AS DECIMAL(15,2))) AS lo, round(avg(CAST(l_extendedprice AS DECIMAL(15,2))), 6) AS mean FROM lineitem GROUP BY l_returnflag", "SELECT l_returnflag, CAST(sum(CAST(l_extendedprice AS DECIMAL(15,2))) AS DECIMAL(38,2)) AS total, min(CAST(l_extendedprice AS DECIMAL(15,2))) AS lo, round(avg(CAST(CAST(l_extendedprice AS DECIMAL(15,2)) AS DOUBLE)), 6) AS mean FROM lineitem GROUP BY l_returnflag"),
    "agg_decimal_product": ("SELECT sum(CAST(l_extendedprice AS DECIMAL(12,2)) * (1 - CAST(l_discount AS DECIMAL(4,2)))) AS net FROM lineitem", "SELECT CAST(sum(CAST(l_extendedprice AS DECIMAL(12,2)) * (1 - CAST(l_discount AS DECIMAL(4,2)))) AS DECIMAL(38,4)) AS net FROM lineitem"),
    "agg_min_max_types": "SELECT min(o_orderdate) AS d0, max(o_orderdate) AS d1, min(o_orderpriority) AS p0, max(o_orderkey) AS k1 FROM orders",
    "agg_filter": "SELECT o_orderpriority, count(*) FILTER (WHERE o_orderstatus = 'F') AS f, round(sum(o_totalprice) FILTER (WHERE o_custkey < 500), 2) AS some, count(DISTINCT o_custkey) FILTER (WHERE o_totalprice > 100000) AS rich, max(o_custkey) FILTER (WHERE o_orderkey < 0) AS none FROM orders GROUP BY o_orderpriority",
    "agg_case_filter": "SELECT round(sum(CASE WHEN l_returnflag = 'R' THEN l_extendedprice END), 2) AS returned, CAST(sum(CASE WHEN l_quantity > 25 THEN 1 ELSE 0 END) AS BIGINT) AS many FROM lineitem",
    "agg_over_aggregates": "SELECT l_linestatus, round(100 * sum(l_discount) / sum(l_tax + 1), 6) AS share, CAST(max(l_linenumber) - min(l_linenumber) AS BIGINT) AS span FROM lineitem GROUP BY l_linestatus",
    "agg_group_multi": "SELECT l_returnflag, l_linestatus, l_linenumber, count(*) AS n FROM lineitem GROUP BY l_returnflag, l_linestatus, l_linenumber",
    "agg_group_expression": "SELECT lower(o_orderpriority) AS p, CAST(extract(YEAR FROM o_orderdate) AS BIGINT) AS y, count(*) AS n FROM orders GROUP BY lower(o_orderpriority), CAST(extract(YEAR FROM o_orderdate) AS BIGINT)",
    "agg_group_alias": "SELECT substring(p_name, 1, 3) AS head, count(*) AS n FROM part GROUP BY head",
    "agg_group_ordinal": "SELECT p_type, p_brand, count(*) AS n FROM part GROUP BY 1, 2",
    "agg_group_all": "SELECT c_mktsegment, c_nationkey, count(*) AS n, round(sum(c_acctbal), 2) AS total FROM customer GROUP BY ALL",
    "agg_over_join": "SELECT n_name, round(sum(c_acctbal), 2) AS total, count(*) AS n FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY n_name",
    "agg_over_derived": "SELECT n, count(*) AS customers FROM (SELECT o_custkey, count(*) AS n FROM orders GROUP BY o_custkey) t GROUP BY n",
    "agg_over_union": "SELECT k, count(*) AS n FROM (SELECT c_nationkey AS k FROM customer UNION ALL SELECT s_nationkey AS k FROM supplier) t GROUP BY k",
    "agg_threshold": "SELECT l_orderkey, round(sum(l_quantity), 2) AS q FROM lineitem GROUP BY l_orderkey HAVING sum(l_quantity) > 180",
    "agg_all_null_group": "SELECT c_nationkey, count(nullif(c_nationkey, c_nationkey)) AS n, max(nullif(c_nationkey, c_nationkey)) AS top FROM customer GROUP BY c_nationkey",
    "agg_null_group_key": "SELECT nullif(o_orderstatus, 'F') AS s, count(*) AS n FROM orders GROUP BY nullif(o_orderstatus, 'F')",
    # windows
    "window_row_number": "SELECT o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS rn FROM orders",
    "window_rank": "SELECT p_partkey, rank() OVER (PARTITION BY p_brand ORDER BY p_size) AS r, dense_rank() OVER (PARTITION BY p_brand ORDER BY p_size) AS dr FROM part",
    "window_null_order": "SELECT c_custkey, row_number() OVER (ORDER BY nullif(c_nationkey, 3), c_custkey) AS rn, row_number() OVER (ORDER BY nullif(c_nationkey, 3) DESC, c_custkey) AS rd FROM customer",
    "window_lag_lead": "SELECT o_orderkey, lag(o_totalprice) OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS before1, lag(o_totalprice, 2) OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS before2, lead(o_orderkey, 1) OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS after1 FROM orders",
    "window_whole": "SELECT s_suppkey, round(sum(s_acctbal) OVER (PARTITION BY s_nationkey), 2) AS total, count(*) OVER (PARTITION BY s_nationkey) AS n, round(avg(s_acctbal) OVER (PARTITION BY s_nationkey), 6) AS mean FROM supplier",
    "window_running": "SELECT o_orderkey, round(sum(o_totalprice) OVER (PARTITION BY o_custkey ORDER BY o_orderkey), 2) AS upto, count(*) OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS n, round(avg(o_totalprice) OVER (PARTITION BY o_custkey ORDER BY o_orderkey), 6) AS mean FROM orders",
    "window_running_ties": ("SELECT p_partkey, count(*) OVER (PARTITION BY p_brand ORDER BY p_size) AS n, sum(p_size) OVER (PARTITION BY p_brand ORDER BY p_size) AS total FROM part", "SELECT p_partkey, count(*) OVER (PARTITION BY p_brand ORDER BY p_size) AS n, CAST(sum(p_size) OVER (PARTITION BY p_brand ORDER BY p_size) AS DOUBLE) AS total FROM part"),
    "window_running_rows": "SELECT p_partkey, CAST(sum(p_size) OVER (PARTITION BY p_brand ORDER BY p_size, p_partkey ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS DOUBLE) AS total FROM part",
    "window_no_partition": "SELECT n_nationkey, count(*) OVER () AS n, row_number() OVER (ORDER BY n_name) AS rn FROM nation",
    "window_multi_keys": "SELECT l_orderkey, l_linenumber, row_number() OVER (PARTITION BY l_returnflag, l_linestatus ORDER BY l_extendedprice DESC, l_orderkey, l_linenumber) AS rn FROM lineitem",
    "window_filter_order_limit": "SELECT o_orderkey, rank() OVER (ORDER BY o_totalprice DESC) AS r FROM orders WHERE o_orderstatus = 'O' ORDER BY r, o_orderkey LIMIT 25 OFFSET 5",
    # sort, limit, distinct, sets
    "sort_null_default": "SELECT c_custkey, nullif(c_nationkey, 7) AS k FROM customer ORDER BY k DESC, c_custkey",
    "sort_nulls_first": "SELECT c_custkey, nullif(c_nationkey, 7) AS k FROM customer ORDER BY k NULLS FIRST, c_custkey DESC",
    "sort_ordinal": "SELECT c_nationkey, count(*) AS n FROM customer GROUP BY c_nationkey ORDER BY 2 DESC, 1",
    "sort_by_aggregate": "SELECT c_nationkey FROM customer GROUP BY c_nationkey ORDER BY sum(c_acctbal) DESC, c_nationkey",
    "sort_by_expression": "SELECT p_partkey, p_size * 2 AS d FROM part ORDER BY p_size * 2 DESC, p_partkey",
    "limit_offset": "SELECT l_orderkey, l_linenumber FROM lineitem ORDER BY l_orderkey, l_linenumber LIMIT 30 OFFSET 70",
    "top_n": "SELECT l_orderkey, l_linenumber, l_extendedprice FROM lineitem ORDER BY l_extendedprice DESC, l_orderkey, l_linenumber LIMIT 10",
    "distinct_pair": "SELECT DISTINCT l_suppkey, l_linenumber FROM lineitem",
    "distinct_derived": "SELECT DISTINCT k FROM (SELECT o_custkey % 10 AS k FROM orders) t ORDER BY k",
    "set_union_all": "SELECT c_nationkey AS k FROM customer UNION ALL SELECT s_nationkey FROM supplier",
    "set_union": "SELECT c_nationkey AS k FROM customer UNION SELECT s_nationkey FROM supplier",
    "set_intersect": "SELECT o_custkey AS k FROM orders INTERSECT SELECT c_custkey FROM customer WHERE c_acctbal > 5000",
    "set_intersect_all": "SELECT nullif(c_nationkey, 3) AS k FROM customer INTERSECT ALL SELECT nullif(s_nationkey, 3) FROM supplier",
    "set_except": "SELECT c_custkey AS k FROM customer EXCEPT SELECT o_custkey FROM orders WHERE o_totalprice > 150000",
    "set_except_all": "SELECT c_nationkey AS k FROM customer EXCEPT ALL SELECT s_nationkey FROM supplier",
    "set_nested": "(SELECT n_nationkey AS k FROM nation UNION ALL SELECT r_regionkey FROM region) EXCEPT SELECT s_nationkey FROM supplier WHERE s_acctbal < 0 ORDER BY k DESC LIMIT 10",
    "set_top_k_union": "SELECT o_orderkey AS k, o_totalprice AS v FROM orders UNION ALL SELECT c_custkey, c_acctbal FROM customer ORDER BY v DESC, k LIMIT 15",
    # scalars
    "scalar_literals": ("SELECT r_regionkey, 7 AS i, 1.5 AS f, 'it''s' AS s, CAST(NULL AS VARCHAR) AS n, DATE '2024-02-29' AS d, TIMESTAMP '2024-01-01 10:00:00' AS t FROM region", "SELECT r_regionkey, 7 AS i, CAST(1.5 AS DOUBLE) AS f, 'it''s' AS s, CAST(NULL AS VARCHAR) AS n, DATE '2024-02-29' AS d, TIMESTAMP '2024-01-01 10:00:00' AS t FROM region"),
    "scalar_interval": "SELECT r_regionkey, CAST(DATE '2024-01-31' + INTERVAL '1' MONTH AS DATE) AS m, CAST(DATE '2024-03-01' - INTERVAL '1' DAY AS DATE) AS d, CAST(DATE '2024-02-29' + INTERVAL '1' YEAR AS DATE) AS y FROM region",
    "scalar_arithmetic": "SELECT l_orderkey, l_linenumber, l_quantity + l_tax AS a, l_quantity - l_tax AS s, l_quantity * l_tax AS m, l_extendedprice / l_quantity AS d, -l_linenumber AS neg FROM lineitem",
    "scalar_int_div": ("SELECT o_orderkey, o_custkey div 7 AS q, o_custkey % 7 AS r FROM orders", "SELECT o_orderkey, o_custkey // 7 AS q, o_custkey % 7 AS r FROM orders"),
    "scalar_decimal_literals": "SELECT r_regionkey, CAST(0.06 + 0.01 AS DECIMAL(4,2)) AS x, CAST(0.06 - 0.01 AS DECIMAL(4,2)) AS y FROM region",
    "scalar_cast_text": "SELECT o_orderkey, CAST(o_custkey AS VARCHAR) AS k, CAST(CAST(o_orderdate AS DATE) AS VARCHAR) AS d, CAST(o_totalprice > 1000 AS VARCHAR) AS b FROM orders",
    "scalar_cast_int": ("SELECT o_orderkey, CAST(substring(o_orderpriority, 1, 1) AS INTEGER) AS p FROM orders", "SELECT o_orderkey, CAST(substring(o_orderpriority, 1, 1) AS BIGINT) AS p FROM orders"),
    "scalar_cast_double": "SELECT p_partkey, CAST(p_size AS DOUBLE) AS s, CAST('2.5' AS DOUBLE) AS t FROM part",
    "scalar_cast_date": "SELECT o_orderkey, CAST(o_orderdate AS DATE) AS d, CAST('2020-05-06' AS DATE) AS e FROM orders",
    "scalar_cast_timestamp": ("SELECT r_regionkey, CAST('2024-01-02 03:04:05' AS TIMESTAMP_NTZ) AS t FROM region", "SELECT r_regionkey, CAST('2024-01-02 03:04:05' AS TIMESTAMP) AS t FROM region"),
    "scalar_cast_decimal": "SELECT p_partkey, CAST(p_retailprice AS DECIMAL(12,2)) AS r, CAST(p_size AS DECIMAL(6,1)) AS s, CAST('1.235' AS DECIMAL(6,2)) AS h FROM part",
    "scalar_coalesce": "SELECT o_orderkey, coalesce(nullif(o_orderstatus, 'F'), 'done') AS s, coalesce(NULL, NULL, o_custkey) AS c FROM orders",
    "scalar_case": "SELECT o_orderkey, CASE WHEN o_totalprice > 200000 THEN 'high' WHEN o_totalprice > 100000 THEN 'mid' ELSE 'low' END AS band, CASE o_orderstatus WHEN 'F' THEN 1 WHEN 'O' THEN 2 END AS code FROM orders",
    "scalar_text": ("SELECT p_partkey, lower(p_name) AS l, upper(p_name) AS u, length(p_name) AS n, trim('  a b ') AS t, replace(p_name, 'o', '00') AS r FROM part", "SELECT p_partkey, lower(p_name) AS l, upper(p_name) AS u, CAST(length(p_name) AS BIGINT) AS n, trim('  a b ') AS t, replace(p_name, 'o', '00') AS r FROM part"),
    "scalar_concat": "SELECT p_partkey, concat(p_brand, nullif(p_type, 'PROMO'), '-') AS c FROM part",
    "scalar_substring": "SELECT p_partkey, substring(p_name FROM 2 FOR 3) AS a, substring(p_name FROM 4) AS b, substring(p_name, 1, 100) AS c FROM part",
    "scalar_math": ("SELECT c_custkey, abs(c_acctbal) AS a, round(c_acctbal) AS r, floor(c_acctbal) AS f, ceil(c_acctbal) AS c FROM customer", "SELECT c_custkey, abs(c_acctbal) AS a, round(c_acctbal) AS r, CAST(floor(c_acctbal) AS DOUBLE) AS f, CAST(ceil(c_acctbal) AS DOUBLE) AS c FROM customer"),
    "scalar_extract_year": ("SELECT o_orderkey, extract(YEAR FROM o_orderdate) AS y FROM orders", "SELECT o_orderkey, CAST(extract(YEAR FROM o_orderdate) AS BIGINT) AS y FROM orders"),
    "scalar_struct": ("SELECT n_nationkey, s.a.b AS x, s.c AS y FROM (SELECT n_nationkey, named_struct('a', named_struct('b', n_name), 'c', n_regionkey) AS s FROM nation) t WHERE s.c > 1",
                      "SELECT n_nationkey, s.a.b AS x, s.c AS y FROM (SELECT n_nationkey, struct_pack(a := struct_pack(b := n_name), c := n_regionkey) AS s FROM nation) t WHERE s.c > 1"),
    "scalar_list": ("SELECT n_nationkey, t[1] AS one, t[3] AS three, t[array_length(t)] AS last_one, t[n_regionkey] AS computed, CAST(list_length(t) AS BIGINT) AS n FROM (SELECT n_nationkey, n_regionkey, array(n_nationkey, n_regionkey) AS t FROM nation) q",
                    "SELECT n_nationkey, t[1] AS one, t[3] AS three, t[len(t)] AS last_one, CASE WHEN n_regionkey > 0 THEN t[n_regionkey] END AS computed, CAST(len(t) AS BIGINT) AS n FROM (SELECT n_nationkey, n_regionkey, [n_nationkey, n_regionkey] AS t FROM nation) q"),
    "scalar_struct_list": ("SELECT n_nationkey, s.items[2] AS x FROM (SELECT n_nationkey, named_struct('items', array(n_nationkey, n_regionkey)) AS s FROM nation) q", "SELECT n_nationkey, s.items[2] AS x FROM (SELECT n_nationkey, {'items': [n_nationkey, n_regionkey]} AS s FROM nation) q"),
    "scalar_in_positions": "SELECT upper(substring(c_name, 1, 1)) AS k, count(*) AS n FROM customer WHERE length(c_name) > 5 GROUP BY upper(substring(c_name, 1, 1)) HAVING round(avg(c_acctbal)) > -100000 ORDER BY k",
    "scalar_overflow": ("SELECT r_regionkey, 9223372036854775807 + r_regionkey AS a, -9223372036854775807 - r_regionkey - 1 AS b, 4611686018427387904 * (r_regionkey + 1) AS c, 7 / (r_regionkey - 1) AS d, 7 % (r_regionkey - 1) AS e, r_regionkey div (r_regionkey - 1) AS f FROM region",
                        "SELECT r_regionkey, CASE WHEN r_regionkey = 0 THEN 9223372036854775807 END AS a, CASE WHEN r_regionkey = 0 THEN -9223372036854775808 END AS b, CASE WHEN r_regionkey = 0 THEN 4611686018427387904 END AS c, CASE WHEN r_regionkey <> 1 THEN 7 / (r_regionkey - 1) END AS d, CASE WHEN r_regionkey <> 1 THEN 7 % (r_regionkey - 1) END AS e, CASE WHEN r_regionkey <> 1 THEN r_regionkey // (r_regionkey - 1) END AS f FROM region"),
    "scalar_precedence": "SELECT l_orderkey, l_linenumber, l_quantity - 2 * l_tax - 1 AS a, (l_quantity - 2) * -l_tax + 3 AS b, 1 + 2 * 3 - 4 AS c, l_linenumber % 3 * 2 AS d, 0.5 * l_quantity AS e FROM lineitem",
    "scalar_cast_date_int": ("SELECT o_orderkey, CAST(CAST(o_orderdate AS DATE) AS INTEGER) AS n FROM orders", "SELECT o_orderkey, CAST(date_diff('day', DATE '1970-01-01', CAST(o_orderdate AS DATE)) AS BIGINT) AS n FROM orders"),
    "scalar_substring_clamp": ("SELECT p_partkey, substring(p_name, 0, 3) AS a, substring(p_name FROM -2 FOR 4) AS b, substring(p_name, p_size - 10, 2) AS c FROM part", "SELECT p_partkey, substring(p_name, 1, 3) AS a, substring(p_name, 1, 4) AS b, substring(p_name, greatest(p_size - 10, 1), 2) AS c FROM part"),
    "scalar_list_call": ("SELECT n_nationkey, array(n_nationkey, n_regionkey)[1] AS a, split('x,y', ',')[2] AS b, array(7)[n_regionkey + 2] AS c FROM nation", "SELECT n_nationkey, n_nationkey AS a, 'y' AS b, CAST(NULL AS INTEGER) AS c FROM nation"),
    "filter_between_null": "SELECT n_nationkey FROM nation WHERE NOT (n_nationkey BETWEEN 5 AND NULL) OR n_regionkey BETWEEN NULL AND 0",
    "project_type_word": "SELECT text, n FROM (SELECT n_name AS text, n_nationkey AS n FROM nation) t",
    # subqueries, derived tables, common table expressions
    "sub_derived": "SELECT t.k, t.n FROM (SELECT o_custkey AS k, count(*) AS n FROM orders GROUP BY o_custkey) t WHERE t.n > 5",
    "sub_cte": "WITH big AS (SELECT o_orderkey, o_custkey FROM orders WHERE o_totalprice > 150000) SELECT c_name, big.o_orderkey FROM big JOIN customer ON c_custkey = big.o_custkey",
    "sub_cte_scalar": "WITH t AS (SELECT o_custkey, count(*) AS n FROM orders GROUP BY o_custkey) SELECT o_custkey FROM t WHERE n = (SELECT max(n) FROM t)",
    "sub_scalar": "SELECT o_orderkey FROM orders WHERE o_totalprice > (SELECT 1.5 * avg(o_totalprice) FROM orders)",
    "sub_scalar_empty": "SELECT r_regionkey, (SELECT n_name FROM nation WHERE n_nationkey < 0) AS none FROM region",
    "sub_scalar_having": "SELECT o_custkey, round(sum(o_totalprice), 2) AS total FROM orders GROUP BY o_custkey HAVING sum(o_totalprice) > (SELECT 20 * avg(o_totalprice) FROM orders)",
    "sub_in": "SELECT c_custkey FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_totalprice > 180000)",
    "sub_not_in": "SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_totalprice > 150000)",
    "sub_not_in_null": "SELECT c_custkey FROM customer WHERE c_nationkey NOT IN (SELECT nullif(n_nationkey, 3) FROM nation WHERE n_regionkey = 1)",
    "sub_tuple_in": "SELECT l_orderkey, l_linenumber FROM lineitem WHERE (l_partkey, l_suppkey) IN (SELECT l_partkey, l_suppkey FROM lineitem WHERE l_quantity = 50)",
    "sub_tuple_not_in": "SELECT n_nationkey FROM nation WHERE (n_nationkey, n_regionkey) NOT IN (SELECT c_nationkey, 1 FROM customer WHERE c_acctbal > 1000)",
    "sub_correlated_pair_in": "SELECT l_orderkey, l_linenumber FROM lineitem o WHERE l_suppkey IN (SELECT i.l_suppkey FROM lineitem i WHERE i.l_orderkey = o.l_orderkey AND i.l_quantity > 45)",
    "sub_exists": "SELECT count(*) AS n FROM region WHERE EXISTS (SELECT 1 FROM nation WHERE n_regionkey = 99)",
    "sub_exists_correlated": "SELECT c_custkey FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'P')",
    "sub_not_exists_correlated": "SELECT c_custkey FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'F')",
    "sub_in_or": "SELECT c_custkey FROM customer WHERE c_acctbal > 9500 OR c_custkey IN (SELECT o_custkey FROM orders WHERE o_totalprice > 190000)",
    "sub_exists_or": "SELECT c_custkey FROM customer WHERE c_acctbal < -900 OR NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey)",
    "sub_correlated_scalar": "SELECT c_custkey, (SELECT max(o_totalprice) FROM orders WHERE o_custkey = c_custkey) AS top FROM customer",
    "sub_correlated_min": "SELECT o_orderkey, o_custkey FROM orders o WHERE o_totalprice = (SELECT min(i.o_totalprice) FROM orders i WHERE i.o_custkey = o.o_custkey)",
    "sub_correlated_avg": "SELECT l_orderkey, l_linenumber FROM lineitem l WHERE l_quantity < (SELECT 0.3 * avg(i.l_quantity) FROM lineitem i WHERE i.l_partkey = l.l_partkey)",
    "sub_grouped_in_join": "SELECT c_name, o_orderkey FROM customer JOIN orders ON c_custkey = o_custkey WHERE o_orderkey IN (SELECT l_orderkey FROM lineitem GROUP BY l_orderkey HAVING sum(l_quantity) > 150)",
    "sub_correlated_over_join": "SELECT o_orderkey, c_name FROM orders, customer WHERE o_custkey = c_custkey AND EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_quantity > c_acctbal / 200)",
    "sub_uncorrelated_in_join": "SELECT n_name, s_name FROM nation JOIN supplier ON n_nationkey = s_nationkey WHERE s_acctbal > (SELECT avg(s_acctbal) FROM supplier)",
    "sub_aggregate_with_in": "SELECT o_orderpriority, count(*) AS n FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING') GROUP BY o_orderpriority",
    "sub_exists_unequal": "SELECT l_orderkey, l_linenumber FROM lineitem a WHERE EXISTS (SELECT 1 FROM lineitem b WHERE b.l_orderkey = a.l_orderkey AND b.l_suppkey <> a.l_suppkey AND b.l_quantity > 49)",
}

QUERIES, ORACLE = both(TEXTS)
