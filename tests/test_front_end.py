import pytest

from marlstone import errors
from marlstone.operators import ParquetOptions
from marlstone.plans import Copy, Explain, Select, parse_statement, rewrite, split_statements


@pytest.mark.parametrize(
    "sql, expected",
    [
        ("SELECT a FROM t ORDER BY a", "SELECT a FROM t ORDER BY a NULLS LAST"),
        ("SELECT a FROM t ORDER BY a DESC, b NULLS FIRST LIMIT 3", "SELECT a FROM t ORDER BY a DESC NULLS LAST, b NULLS FIRST LIMIT 3"),
        ("SELECT rank() OVER (PARTITION BY a, b ORDER BY f(c, d)) FROM t", "SELECT CAST(rank() OVER (PARTITION BY a, b ORDER BY f(c, d) NULLS LAST) AS BIGINT) FROM t"),
        ("SELECT sum(a) OVER (ORDER BY b ROWS BETWEEN 1 PRECEDING AND CURRENT ROW) FROM t", "SELECT CAST(sum(a) OVER (ORDER BY b NULLS LAST ROWS BETWEEN 1 PRECEDING AND CURRENT ROW) AS DOUBLE) FROM t"),
        ("SELECT 'ORDER BY x' -- ORDER BY y", "SELECT 'ORDER BY x' -- ORDER BY y"),
        ("SELECT concat(a, b)", "SELECT concat(coalesce((a) || '', ''), coalesce((b) || '', ''))"),
        ("SELECT t.l[i + 1]", "SELECT get(t.l, cast((try_add(i, 1)) - 1 AS INT))"),
        ("SELECT CAST(a AS VARCHAR), CAST(b AS VARCHAR(10)), CAST(c AS INTEGER)", "SELECT CAST(a AS STRING), CAST(b AS STRING), CAST(c AS BIGINT)"),
        ("SELECT a WHERE NULL AND b IS NOT NULL", "SELECT a WHERE CAST(NULL AS BOOLEAN) AND b IS NOT NULL"),
        ('SELECT "a b" FROM t', "SELECT `a b` FROM t"),
        ("SELECT array_length(l)", "SELECT CAST(size(l) AS BIGINT)"),
    ],
)
def test_rewrite(sql, expected):
    assert rewrite(sql) == expected


def test_paths_become_views():
    out = rewrite("SELECT * FROM 'x/orders.parquet' JOIN 'y/c.parquet' AS c ON 'a' = b, 'z/d'", lambda p: "v_" + p[0])
    assert out == "SELECT * FROM `v_x` AS `orders` JOIN `v_y` AS c ON 'a' = b, 'z/d'"
    assert rewrite("SELECT * FROM 'a/l.parquet' x, 'b/o.parquet'", lambda p: p[0]) == "SELECT * FROM `a` x, `b` AS `o`"


def test_statements():
    assert split_statements("SELECT ';'; -- x;\nSELECT 2;") == ["SELECT ';'", "-- x;\nSELECT 2"]
    assert isinstance(parse_statement("WITH a AS (SELECT 1) SELECT * FROM a"), Select)
    assert parse_statement("EXPLAIN SELECT 1") == Explain("SELECT 1")
    c = parse_statement("COPY (SELECT (1) AS a) TO 'it''s.csv' (FORMAT CSV, HEADER)")
    assert c == Copy("SELECT (1) AS a", "it's.csv", "csv", True)
    c = parse_statement("COPY (SELECT 1) TO 'a.parquet' (FORMAT PARQUET, COMPRESSION zstd, DICTIONARY false, ROW_GROUP_SIZE 100)")
    assert c.parquet == ParquetOptions("zstd", False, 100)


@pytest.mark.parametrize(
    "sql", ["SELECT 1; SELECT 2", "INSERT INTO t VALUES (1)", "COPY t FROM 'x'", "COPY t TO 'x'", "EXPLAIN ANALYZE SELECT 1", "COPY (SELECT 1) TO 'x' (FORMAT JSON)",
            "COPY (SELECT 1) TO 'x' (FORMAT PARQUET, COMPRESSION brotli)", "COPY (SELECT 1) TO 'x' (FORMAT PARQUET, HEADER true)", "SELECT 'open"]
)
def test_refused(sql):
    with pytest.raises(errors.ParseError):
        parse_statement(sql)


def test_values(engine):
    one = lambda sql: tuple(engine.rows(sql)[0])
    assert one("SELECT concat('a', NULL, 'b'), 'a\\b', 'it''s'") == ("ab", "a\\b", "it's")
    assert one("SELECT t.l[1], t.l[0], t.l[3], t.l[array_length(t.l)] FROM (SELECT array(7, 8) AS l) t") == (7, None, None, 8)
    assert one("SELECT 'a\\b' LIKE 'a\\%', '100%' LIKE '100!%' ESCAPE '!'") == (True, True)
    assert [r[0] for r in engine.rows("SELECT * FROM VALUES (2), (NULL), (1) AS t(a) ORDER BY a")] == [1, 2, None]


@pytest.mark.parametrize(
    "sql, kind",
    [
        ("SELECT nope FROM (SELECT 1 AS a) t", errors.UnknownColumn),
        ("SELECT a FROM (SELECT 1 AS a) t JOIN (SELECT 1 AS a) u ON t.a = u.a", errors.AmbiguousColumn),
        ("SELECT * FROM no_such_table", errors.UnknownTable),
        ("SELECT 1 AS a ORDER BY 2", errors.OrdinalOutOfRange),
        ("SELECT CAST('x' AS BIGINT)", errors.InvalidCast),
        ("SELECT (SELECT x FROM VALUES (1), (2) AS t(x)) AS y", errors.SubqueryCardinality),
        ("SELECT 1 + array(1)", errors.TypeMismatch),
    ],
)
def test_errors(engine, sql, kind):
    with pytest.raises(kind):
        engine.rows(sql)


@pytest.mark.parametrize(
    "sql, want",
    [
        ("SELECT a - b - c * -d FROM t", "SELECT try_subtract(try_subtract(a, b), try_multiply(c, -d)) FROM t"),
        ("SELECT t.*, count(*), 2*x FROM t", "SELECT t.*, count(*), try_multiply(2, x) FROM t"),
        ("SELECT 0.06 + 0.01, 1.5, 1.5BD, CAST(0.1 + 0.2 AS DECIMAL(4, 2))", "SELECT CAST((0.06 + 0.01) AS DOUBLE), 1.5D, 1.5BD, CAST((0.1 + 0.2) AS DECIMAL(4, 2))"),
        ("SELECT text FROM (SELECT 1 AS text) t", "SELECT text FROM (SELECT 1 AS text) t"),
        ("SELECT CASE WHEN a THEN b END * 2", "SELECT try_multiply(CASE WHEN a THEN b END, 2)"),
        ("SELECT d + INTERVAL '1' DAY - INTERVAL 2 MONTHS FROM t", "SELECT d + INTERVAL '1' DAY - INTERVAL 2 MONTHS FROM t"),
        ("SELECT a FROM t WHERE a BETWEEN b AND NULL AND NULL", "SELECT a FROM t WHERE a BETWEEN b AND NULL AND CAST(NULL AS BOOLEAN)"),
        ("SELECT f(x)[2].y[1]", "SELECT get(get(f(x), cast((2) - 1 AS INT)).y, cast((1) - 1 AS INT))"),
        ("SELECT x::int, x::varchar(3)", "SELECT CAST(x AS BIGINT), CAST(x AS STRING)"),
    ],
)
def test_expressions(sql, want):
    assert rewrite(sql) == want


def test_result_types(engine):
    df = engine.sql("SELECT sum(d) AS s, avg(d) AS a, sum(i) AS n, max(d) AS m FROM (SELECT CAST(1.25 AS DECIMAL(9,2)) AS d, 1 AS i) t")
    assert [t for _, t in df.dtypes] == ["decimal(38,2)", "double", "bigint", "decimal(9,2)"]
    df = engine.sql("SELECT floor(1.5) AS a, ceil(2) AS b, round(2.5) AS c, extract(YEAR FROM DATE '2020-02-03') AS d, row_number() OVER (ORDER BY 1) AS e, sum(1) OVER () AS f, length('ab') AS g, 1.5 AS h")
    assert [t for _, t in df.dtypes] == ["double", "double", "double", "bigint", "bigint", "double", "bigint", "double"]
    assert engine.rows("SELECT 9223372036854775807 + 1 AS a, 1 / 0 AS b, 5 % 0 AS c, CAST(DATE '1970-01-11' AS INTEGER) AS d, CAST(0.06 + 0.01 AS DECIMAL(4,2)) = 0.07 AS e")[0] == (None, None, None, 10, True)


def test_concat_of_lists_is_refused(engine):
    from marlstone.errors import EngineError

    with pytest.raises(EngineError):
        engine.rows("SELECT concat(array(1), array(2)) AS x")
