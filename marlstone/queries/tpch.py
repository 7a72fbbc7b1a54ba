"""The 22 shapes of TPC-H on the columns that the tables have.

There is no partsupp; where a query needs one, it is the suppliers' parts of lineitem. Ranges of dates
and names are those of the data.
"""

from __future__ import annotations

from .text import both

PARTSUPP = "partsupp AS (SELECT l_partkey AS ps_partkey, l_suppkey AS ps_suppkey, min(l_extendedprice / l_quantity) AS ps_supplycost, sum(l_quantity) AS ps_availqty FROM lineitem GROUP BY l_partkey, l_suppkey)"
REVENUE = "l_extendedprice * (1 - l_discount)"

TEXTS: dict[str, str | tuple[str, str]] = {
    "q01_pricing_summary": f"""SELECT l_returnflag, l_linestatus, round(sum(l_quantity), 2) AS sum_qty, round(sum(l_extendedprice), 2) AS sum_base_price,
        round(sum({REVENUE}), 2) AS sum_disc_price, round(sum({REVENUE} * (1 + l_tax)), 2) AS sum_charge, round(avg(l_quantity), 6) AS avg_qty,
        round(avg(l_extendedprice), 6) AS avg_price, round(avg(l_discount), 6) AS avg_disc, count(*) AS count_order
        FROM lineitem WHERE l_shipdate <= TIMESTAMP '2001-08-01' GROUP BY l_returnflag, l_linestatus ORDER BY l_returnflag, l_linestatus""",
    "q02_minimum_cost_supplier": (f"""WITH {PARTSUPP}, offers AS (SELECT ps_partkey, ps_suppkey, ps_supplycost, min(ps_supplycost) OVER (PARTITION BY ps_partkey) AS cheapest FROM partsupp
        WHERE ps_suppkey IN (SELECT s_suppkey FROM supplier, nation, region WHERE s_nationkey = n_nationkey AND n_regionkey = r_regionkey AND r_name = 'EUROPE') AND ps_partkey IN (SELECT p_partkey FROM part WHERE p_size < 15))
        SELECT s_acctbal, s_name, n_name, p_partkey, p_brand FROM offers, part, supplier, nation WHERE ps_supplycost = cheapest AND p_partkey = ps_partkey AND s_suppkey = ps_suppkey AND s_nationkey = n_nationkey
        ORDER BY s_acctbal DESC, n_name, s_name, p_partkey LIMIT 100""",
        f"""WITH {PARTSUPP} SELECT s_acctbal, s_name, n_name, p_partkey, p_brand FROM part, supplier, partsupp, nation, region
        WHERE p_partkey = ps_partkey AND s_suppkey = ps_suppkey AND p_size < 15 AND s_nationkey = n_nationkey AND n_regionkey = r_regionkey AND r_name = 'EUROPE'
        AND ps_supplycost = (SELECT min(ps_supplycost) FROM partsupp, supplier, nation, region WHERE p_partkey = ps_partkey AND s_suppkey = ps_suppkey AND s_nationkey = n_nationkey AND n_regionkey = r_regionkey AND r_name = 'EUROPE')
        ORDER BY s_acctbal DESC, n_name, s_name, p_partkey LIMIT 100"""),
    "q03_shipping_priority": f"""SELECT l_orderkey, round(sum({REVENUE}), 2) AS revenue, o_orderdate FROM customer, orders, lineitem
        WHERE c_mktsegment = 'BUILDING' AND c_custkey = o_custkey AND l_orderkey = o_orderkey AND o_orderdate < TIMESTAMP '1998-03-15' AND l_shipdate > TIMESTAMP '1998-03-15'
        GROUP BY l_orderkey, o_orderdate ORDER BY revenue DESC, l_orderkey LIMIT 10""",
    "q04_order_priority": """SELECT o_orderpriority, count(*) AS order_count FROM orders WHERE o_orderdate >= TIMESTAMP '1997-07-01' AND o_orderdate < TIMESTAMP '1997-10-01'
        AND EXISTS (SELECT * FROM lineitem WHERE l_orderkey = o_orderkey AND l_shipdate > o_orderdate + INTERVAL 60 DAY) GROUP BY o_orderpriority ORDER BY o_orderpriority""",
    "q05_regional_supplier_revenue": f"""SELECT n_name, round(sum({REVENUE}), 2) AS revenue FROM customer, orders, lineitem, supplier, nation, region
        WHERE c_custkey = o_custkey AND l_orderkey = o_orderkey AND l_suppkey = s_suppkey AND c_nationkey = s_nationkey AND s_nationkey = n_nationkey AND n_regionkey = r_regionkey
        AND r_name = 'ASIA' AND o_orderdate >= TIMESTAMP '1997-01-01' AND o_orderdate < TIMESTAMP '1998-01-01' GROUP BY n_name ORDER BY revenue DESC, n_name""",
    "q06_forecast_revenue": """SELECT round(sum(l_extendedprice * l_discount), 2) AS revenue FROM lineitem WHERE l_shipdate >= TIMESTAMP '1997-01-01' AND l_shipdate < TIMESTAMP '1998-01-01'
        AND l_discount BETWEEN 0.05 AND 0.07 AND l_quantity < 24""",
    "q07_shipping_volume": f"""SELECT supp_nation, cust_nation, l_year, round(sum(volume), 2) AS revenue FROM (SELECT n1.n_name AS supp_nation, n2.n_name AS cust_nation, CAST(extract(YEAR FROM l_shipdate) AS BIGINT) AS l_year, {REVENUE} AS volume
        FROM supplier, lineitem, orders, customer, nation n1, nation n2 WHERE s_suppkey = l_suppkey AND o_orderkey = l_orderkey AND c_custkey = o_custkey AND s_nationkey = n1.n_nationkey AND c_nationkey = n2.n_nationkey
        AND ((n1.n_name = 'NATION_3' AND n2.n_name = 'NATION_7') OR (n1.n_name = 'NATION_7' AND n2.n_name = 'NATION_3')) AND l_shipdate BETWEEN TIMESTAMP '1997-01-01' AND TIMESTAMP '1998-12-31') AS shipping
        GROUP BY supp_nation, cust_nation, l_year ORDER BY supp_nation, cust_nation, l_year""",
    "q08_market_share": f"""SELECT o_year, round(sum(CASE WHEN nation_name = 'NATION_7' THEN volume ELSE 0 END) / sum(volume), 6) AS mkt_share FROM (SELECT CAST(extract(YEAR FROM o_orderdate) AS BIGINT) AS o_year, {REVENUE} AS volume, n2.n_name AS nation_name
        FROM part, supplier, lineitem, orders, customer, nation n1, nation n2, region WHERE p_partkey = l_partkey AND s_suppkey = l_suppkey AND l_orderkey = o_orderkey AND o_custkey = c_custkey AND c_nationkey = n1.n_nationkey
        AND n1.n_regionkey = r_regionkey AND r_name = 'AMERICA' AND s_nationkey = n2.n_nationkey AND o_orderdate BETWEEN TIMESTAMP '1997-01-01' AND TIMESTAMP '1998-12-31' AND p_type = 'ECONOMY') AS all_nations GROUP BY o_year ORDER BY o_year""",
    "q09_profit_by_nation": f"""WITH {PARTSUPP} SELECT nation_name, o_year, round(sum(amount), 2) AS sum_profit FROM (SELECT n_name AS nation_name, CAST(extract(YEAR FROM o_orderdate) AS BIGINT) AS o_year, {REVENUE} - ps_supplycost * l_quantity AS amount
        FROM part, supplier, lineitem, partsupp, orders, nation WHERE s_suppkey = l_suppkey AND ps_suppkey = l_suppkey AND ps_partkey = l_partkey AND p_partkey = l_partkey AND o_orderkey = l_orderkey AND s_nationkey = n_nationkey AND p_name LIKE '%cold%') AS profit
        GROUP BY nation_name, o_year ORDER BY nation_name, o_year DESC""",
    "q10_returned_items": f"""SELECT c_custkey, c_name, round(sum({REVENUE}), 2) AS revenue, c_acctbal, n_name FROM customer, orders, lineitem, nation WHERE c_custkey = o_custkey AND l_orderkey = o_orderkey
        AND o_orderdate >= TIMESTAMP '1997-10-01' AND o_orderdate < TIMESTAMP '1998-01-01' AND l_returnflag = 'R' AND c_nationkey = n_nationkey GROUP BY c_custkey, c_name, c_acctbal, n_name ORDER BY revenue DESC, c_custkey LIMIT 20""",
    "q11_important_stock": (f"""WITH {PARTSUPP}, stock AS (SELECT ps_partkey, sum(ps_supplycost * ps_availqty) AS worth FROM partsupp
        WHERE ps_suppkey IN (SELECT s_suppkey FROM supplier, nation WHERE s_nationkey = n_nationkey AND n_regionkey = 1) GROUP BY ps_partkey)
        SELECT ps_partkey, round(worth, 2) AS stock_value FROM stock WHERE worth > (SELECT sum(worth) * 0.001 FROM stock) ORDER BY stock_value DESC, ps_partkey""",
        f"""WITH {PARTSUPP} SELECT ps_partkey, round(sum(ps_supplycost * ps_availqty), 2) AS stock_value FROM partsupp, supplier, nation WHERE ps_suppkey = s_suppkey AND s_nationkey = n_nationkey AND n_regionkey = 1
        GROUP BY ps_partkey HAVING sum(ps_supplycost * ps_availqty) > (SELECT sum(ps_supplycost * ps_availqty) * 0.001 FROM partsupp, supplier, nation WHERE ps_suppkey = s_suppkey AND s_nationkey = n_nationkey AND n_regionkey = 1) ORDER BY stock_value DESC, ps_partkey"""),
    "q12_priority_counts": """SELECT l_returnflag, CAST(sum(CASE WHEN o_orderpriority = '1-URGENT' OR o_orderpriority = '2-HIGH' THEN 1 ELSE 0 END) AS BIGINT) AS high_line_count,
        CAST(sum(CASE WHEN o_orderpriority <> '1-URGENT' AND o_orderpriority <> '2-HIGH' THEN 1 ELSE 0 END) AS BIGINT) AS low_line_count FROM orders, lineitem WHERE o_orderkey = l_orderkey AND l_returnflag IN ('A', 'R')
        AND l_shipdate >= TIMESTAMP '1997-01-01' AND l_shipdate < TIMESTAMP '1998-01-01' GROUP BY l_returnflag ORDER BY l_returnflag""",
    "q13_customer_distribution": """SELECT c_count, count(*) AS custdist FROM (SELECT c_custkey, count(o_orderkey) AS c_count FROM customer LEFT OUTER JOIN orders ON c_custkey = o_custkey AND o_orderpriority NOT LIKE '%LOW%' GROUP BY c_custkey) AS c_orders
        GROUP BY c_count ORDER BY custdist DESC, c_count DESC""",
    "q14_promo_revenue": f"""SELECT round(100.00 * sum(CASE WHEN p_type LIKE 'PROMO%' THEN {REVENUE} ELSE 0 END) / sum({REVENUE}), 6) AS promo_revenue FROM lineitem, part WHERE l_partkey = p_partkey AND l_shipdate >= TIMESTAMP '1997-09-01' AND l_shipdate < TIMESTAMP '1997-10-01'""",
    "q15_top_supplier": f"""WITH revenue AS (SELECT l_suppkey AS supplier_no, round(sum({REVENUE}), 2) AS total_revenue FROM lineitem WHERE l_shipdate >= TIMESTAMP '1998-01-01' AND l_shipdate < TIMESTAMP '1998-04-01' GROUP BY l_suppkey)
        SELECT s_suppkey, s_name, total_revenue FROM supplier, revenue WHERE s_suppkey = supplier_no AND total_revenue = (SELECT max(total_revenue) FROM revenue) ORDER BY s_suppkey""",
    "q16_parts_suppliers": ("""SELECT p_brand, p_type, p_size, count(DISTINCT l_suppkey) AS supplier_cnt FROM lineitem, part WHERE p_partkey = l_partkey AND p_brand <> 'Brand#45' AND p_type NOT LIKE 'PROMO%' AND p_size IN (9, 14, 19, 23, 36, 45, 49, 3)
        AND l_suppkey NOT IN (SELECT s_suppkey FROM supplier WHERE s_acctbal < 0) GROUP BY p_brand, p_type, p_size ORDER BY supplier_cnt DESC, p_brand, p_type, p_size""",
        f"""WITH {PARTSUPP} SELECT p_brand, p_type, p_size, count(DISTINCT ps_suppkey) AS supplier_cnt FROM partsupp, part WHERE p_partkey = ps_partkey AND p_brand <> 'Brand#45' AND p_type NOT LIKE 'PROMO%' AND p_size IN (9, 14, 19, 23, 36, 45, 49, 3)
        AND ps_suppkey NOT IN (SELECT s_suppkey FROM supplier WHERE s_acctbal < 0) GROUP BY p_brand, p_type, p_size ORDER BY supplier_cnt DESC, p_brand, p_type, p_size"""),
    "q17_small_quantity": """SELECT round(sum(l_extendedprice) / 7.0, 2) AS avg_yearly FROM lineitem, part WHERE p_partkey = l_partkey AND p_brand = 'Brand#13' AND p_size < 40
        AND l_quantity < (SELECT 0.4 * avg(l_quantity) FROM lineitem WHERE l_partkey = p_partkey)""",
    "q18_large_orders": """SELECT c_name, c_custkey, o_orderkey, o_orderdate, o_totalprice, round(sum(l_quantity), 2) AS total_qty FROM customer, orders, lineitem WHERE o_orderkey IN (SELECT l_orderkey FROM lineitem GROUP BY l_orderkey HAVING sum(l_quantity) > 200)
        AND c_custkey = o_custkey AND o_orderkey = l_orderkey GROUP BY c_name, c_custkey, o_orderkey, o_orderdate, o_totalprice ORDER BY o_totalprice DESC, o_orderdate, o_orderkey LIMIT 100""",
    "q19_discounted_revenue": f"""SELECT round(sum({REVENUE}), 2) AS revenue FROM lineitem, part WHERE (p_partkey = l_partkey AND p_brand = 'Brand#12' AND l_quantity >= 1 AND l_quantity <= 11 AND p_size BETWEEN 1 AND 25)
        OR (p_partkey = l_partkey AND p_brand = 'Brand#23' AND l_quantity >= 10 AND l_quantity <= 20 AND p_size BETWEEN 1 AND 35) OR (p_partkey = l_partkey AND p_brand = 'Brand#34' AND l_quantity >= 20 AND l_quantity <= 30 AND p_size BETWEEN 1 AND 45)""",
    "q20_part_promotion": f"""WITH {PARTSUPP} SELECT s_name, s_acctbal FROM supplier, nation WHERE s_suppkey IN (SELECT ps_suppkey FROM partsupp WHERE ps_partkey IN (SELECT p_partkey FROM part WHERE p_name LIKE 'cold%')
        AND ps_availqty > (SELECT 0.5 * sum(l_quantity) FROM lineitem WHERE l_partkey = ps_partkey AND l_suppkey = ps_suppkey AND l_shipdate >= TIMESTAMP '1997-01-01' AND l_shipdate < TIMESTAMP '2001-01-01')) AND s_nationkey = n_nationkey AND n_regionkey < 4 ORDER BY s_name""",
    "q21_waiting_suppliers": """SELECT s_name, count(*) AS numwait FROM supplier, lineitem l1, orders, nation WHERE s_suppkey = l1.l_suppkey AND o_orderkey = l1.l_orderkey AND o_orderstatus = 'F' AND l1.l_shipdate > o_orderdate + INTERVAL 30 DAY
        AND EXISTS (SELECT * FROM lineitem l2 WHERE l2.l_orderkey = l1.l_orderkey AND l2.l_suppkey <> l1.l_suppkey)
        AND NOT EXISTS (SELECT * FROM lineitem l3 WHERE l3.l_orderkey = l1.l_orderkey AND l3.l_suppkey <> l1.l_suppkey AND l3.l_shipdate > o_orderdate + INTERVAL 90 DAY)
        AND s_nationkey = n_nationkey AND n_regionkey = 2 GROUP BY s_name ORDER BY numwait DESC, s_name LIMIT 100""",
    "q22_sales_opportunity": """SELECT cntrycode, count(*) AS numcust, round(sum(c_acctbal), 2) AS totacctbal FROM (SELECT substring(c_mktsegment FROM 1 FOR 2) AS cntrycode, c_acctbal FROM customer WHERE substring(c_mktsegment FROM 1 FOR 2) IN ('BU', 'AU', 'MA')
        AND c_acctbal > (SELECT avg(c_acctbal) FROM customer WHERE c_acctbal > 0.00) AND NOT EXISTS (SELECT * FROM orders WHERE o_custkey = c_custkey AND o_orderdate > TIMESTAMP '2000-06-01')) AS custsale GROUP BY cntrycode ORDER BY cntrycode""",
}

QUERIES, ORACLE = both(TEXTS)
