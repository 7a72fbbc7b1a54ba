"""The engine: SQL text, scans, aggregates and joins over Parquet paths and registered tables."""

from __future__ import annotations

import uuid

from pyspark.errors import AnalysisException, ParseException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from . import session
from .errors import translate
from .operators import sinks
from .operators.aggregate import aggregate
from .operators.joins import JoinRequest, join
from .operators.ranges import rank_by_ranges, ranks_here, repeatable
from .operators.scan import Metrics, ScanRequest, scan, scan_metrics
from .plans import Copy, Explain, PlanReport, Select, parse_statement, report, rewrite, split_statements
from .plans.counts import count_by_keys
from .plans.expressions import plain_sums
from .plans.ranks import ranked
from .plans.tokens import meaningful, tokenize
from .sources import Catalog, table_of


class Engine:
    """Runs statements. catalog_path: the file of registered tables."""

    def __init__(self, spark: SparkSession | None = None, catalog_path: str = ".marlstone/catalog.json"):
        self.spark = session.prepare(spark) if spark else session.build()
        self.catalog = Catalog(self.spark, catalog_path)

    def table(self, name: str) -> DataFrame:
        """A path, or a registered table if nothing is there."""
        if name in self.catalog:
            return self.catalog.read(name)
        return table_of(self.spark, name)

    def bind(self, **tables: DataFrame) -> Engine:
        """Makes DataFrames known to SQL by name."""
        for name, df in tables.items():
            df.createOrReplaceTempView(name)
        return self

    def _view(self, path: str) -> str:
        view = "path_" + uuid.uuid4().hex
        self.table(path).createOrReplaceTempView(view)
        return view

    def _registered(self, sql: str) -> None:
        """Views for registered tables that the text names after FROM, JOIN or a comma."""
        known = {t.name for t in self.catalog.list()}
        tokens = tokenize(sql)
        for i in meaningful(tokens):
            if known and tokens[i].kind == "word" and (n := tokens[i].text.lower()) in known:
                self.catalog.read(n).createOrReplaceTempView(n)

    def sql(self, text: str) -> DataFrame | str | int:
        """A SELECT's rows (lazily), an EXPLAIN's text, or the number of rows that a COPY has written."""
        s = parse_statement(text)
        if isinstance(s, Copy):
            return self.copy(s)
        if isinstance(s, Explain):
            return report(self.select(s.sql)).text
        return self.select(s.sql)

    def select(self, sql: str) -> DataFrame:
        if not isinstance(parse_statement(sql), Select):
            raise TypeError("not a SELECT")
        try:
            self._registered(sql)
            df = self._ranked(sql) or self._analyzed(count_by_keys(rewrite(sql, self._view)))
            sums = set(plain_sums(sql))
            wide = [f"decimal(38,{f.dataType.scale})" if i in sums and isinstance(f.dataType, T.DecimalType) else None for i, f in enumerate(df.schema)]
            if not any(wide) or len(set(map(str.lower, df.columns))) < len(df.columns):
                return df
            return df.select(*[df[f"`{c}`"].cast(w).alias(c) if w else df[f"`{c}`"] for c, w in zip(df.columns, wide, strict=True)])
        except Exception as e:
            raise translate(e) from e

    def _ranked(self, sql: str) -> DataFrame | None:
        """A plain SELECT with ranks over groups too large for a task each; none for any other text."""
        r = ranked(sql)
        if r is None:
            return None
        try:
            df = self._analyzed(rewrite(r.base, self._view))
        except (AnalysisException, ParseException):  # the text itself is to tell what is wrong
            return None
        if not repeatable(df):
            return None
        shown, rows, large = df.columns[: -r.hidden], df.count(), False
        # columns by their places, as names may come twice
        df = df.toDF(*[c if c in r.names or i >= len(shown) else f"__column{i}" for i, c in enumerate(df.columns)])
        for o in r.overs:
            if found := rank_by_ranges(df, rows, o.ranks, o.by, o.order):
                df, large = found, True
        if not large:
            return None
        for o in r.overs:
            df = ranks_here(df, {c: k for c, k in o.ranks.items() if df.schema[c].dataType == T.NullType()}, o.by, o.order)
        df = df.select(*df.columns[: len(shown)]).toDF(*[r.names.get(c, c) for c in shown])
        if not r.tail.strip():
            return df
        view = "ranks_" + uuid.uuid4().hex
        df.createOrReplaceTempView(view)
        try:
            return self._analyzed(rewrite(f"SELECT * FROM {view} {r.tail}"))
        except (AnalysisException, ParseException):  # ordered by what isn't shown
            return None

    def _analyzed(self, sql: str) -> DataFrame:
        """A query's rows; the analyzer tells which casts to BIGINT are of dates, and these count days."""
        while True:
            try:
                return self.spark.sql(sql)
            except AnalysisException as e:
                where = e.getQueryContext()
                if not (e.getCondition() or "").startswith("DATATYPE_MISMATCH.CAST_WITH") or '"DATE" to "BIGINT"' not in str(e) or not where:
                    raise
                a, b = where[0].startIndex(), where[0].stopIndex() + 1
                kind = sql[a:b].upper().rindex(" AS ")
                sql = f"{sql[:a]}CAST(unix_date({sql[a:b][5:kind]}) AS BIGINT){sql[b:]}"

    def script(self, text: str) -> list[DataFrame | str | int]:
        """The results of all statements of a text, in order."""
        return [self.sql(s) for s in split_statements(text)]

    def copy(self, s: Copy) -> int:
        df = self.select(s.sql)
        try:
            if s.format == "csv":
                return sinks.write_csv(df, s.path, s.header, s.single)
            return sinks.write_parquet(df, s.path, s.parquet, s.single)
        except Exception as e:
            raise translate(e) from e

    def rows(self, sql: str) -> list:
        """A SELECT's rows in the driver, with the engine's errors."""
        try:
            return self.select(sql).collect()
        except Exception as e:
            raise translate(e) from e

    def explain(self, sql: str) -> PlanReport:
        return report(self.select(sql))

    def scan(self, request: ScanRequest) -> DataFrame:
        source = self.catalog.read(request.path) if request.path in self.catalog else None
        return scan(self.spark, request, source)

    def scan_metrics(self, request: ScanRequest) -> Metrics:
        return scan_metrics(self.spark, request)

    def aggregate(self, name: str, aggregates: list[str], by: list[str] = (), where: str | None = None, having: str | None = None) -> DataFrame:
        return aggregate(self.table(name), aggregates, by, where, having)

    def join(self, left: str, right: str, request: JoinRequest) -> DataFrame:
        return join(self.table(left), self.table(right), request)
