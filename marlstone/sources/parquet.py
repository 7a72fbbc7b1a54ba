"""Reading Parquet and its footers by Spark's own file systems, wherever the files are."""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce
from operator import or_
from urllib.parse import quote

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..errors import SchemaMismatch

#: Rows of a block that is put in order by itself, and of a task, about.
BLOCK_ROWS, TASK_ROWS = 1 << 16, 1 << 20


def table_of(spark: SparkSession, path: str, files: list[str] | None = None) -> DataFrame:
    """A file, a folder (with folders in it, key=value ones as text columns), or chosen files below it."""
    reader = spark.read
    if files is not None:
        return reader.option("basePath", path).parquet(*files)
    if path.endswith(".parquet") or not _nested(spark, path):
        return reader.parquet(path)
    return reader.option("recursiveFileLookup", "true").parquet(path)


def _nested(spark: SparkSession, path: str) -> bool:
    """Whether a folder has folders that are no key=value ones."""
    fs, p = _file_system(spark, path)
    if not fs.exists(p) or fs.getFileStatus(p).isFile():
        return False
    return any(s.isDirectory() and "=" not in (name := s.getPath().getName()) and name[0] not in "_." for s in fs.listStatus(p))


def _file_system(spark: SparkSession, path: str):
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


def list_files(spark: SparkSession, path: str) -> list[tuple[str, int]]:
    """Data files (path, bytes) at or below a path, in order of their paths; hidden ones are left out."""
    fs, p = _file_system(spark, path)
    if fs.getFileStatus(p).isFile():
        return [(path, fs.getFileStatus(p).getLen())]
    out, each = [], fs.listFiles(p, True)
    while each.hasNext():
        f = each.next()
        if f.getPath().getName()[0] not in "_.":
            out.append((f.getPath().toString(), f.getLen()))
    return sorted(out)


@dataclass(frozen=True)
class Footer:
    """What one file's footer tells."""

    path: str
    rows: tuple[int, ...]
    column_bytes: dict[str, int]
    schema: str


def footers(spark: SparkSession, path: str) -> Iterator[Footer]:
    """Footers of the files at or below a path, one at a time."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    for name, _ in list_files(spark, path):
        meta = jvm.org.apache.parquet.hadoop.ParquetFileReader.readFooter(conf, jvm.org.apache.hadoop.fs.Path(name))
        sizes: dict[str, int] = {}
        rows = []
        for block in meta.getBlocks():
            rows.append(block.getRowCount())
            for c in block.getColumns():
                key = c.getPath().toDotString().split(".")[0]
                sizes[key] = sizes.get(key, 0) + c.getTotalSize()
        yield Footer(name, tuple(rows), sizes, meta.getFileMetaData().getSchema().toString())


def same_schema(spark: SparkSession, path: str) -> None:
    """Raises SchemaMismatch unless all files have one schema."""
    found = {f.schema for f in footers(spark, path)}
    if len(found) > 1:
        raise SchemaMismatch(f"{path}: the files have {len(found)} schemas")


def row_group_count(spark: SparkSession, path: str) -> int:
    return sum(len(f.rows) for f in footers(spark, path))


def total_rows(spark: SparkSession, path: str) -> int:
    """Rows by the footers alone."""
    return sum(sum(f.rows) for f in footers(spark, path))


def scan_size(spark: SparkSession, path: str, columns: list[str] | None = None) -> int:
    """Compressed bytes of the columns (all, if none are named)."""
    return sum(n for f in footers(spark, path) for c, n in f.column_bytes.items() if columns is None or c in columns)


def row_groups(spark: SparkSession, path: str, chosen: list[int]) -> DataFrame:
    """The rows of the chosen row groups, numbered from 0 over the files in order of their paths.

    Files without a chosen group aren't read; within a file, a group is a range of its rows.
    """
    k, wanted, pick = 0, {}, set(chosen)
    for f in footers(spark, path):
        at = 0
        for n in f.rows:
            if k in pick:
                wanted.setdefault(f.path, []).append((at, at + n - 1))
            at += n
            k += 1
    if not wanted:
        return spark.read.parquet(path).limit(0)
    row, file = F.col("_metadata.row_index"), F.regexp_replace(F.col("_metadata.file_path"), "^[A-Za-z0-9]+:/+", "/")
    cond = F.lit(False)
    for name, ranges in wanted.items():
        here = re.sub("^[A-Za-z0-9]+:/+", "/", quote(name, safe="/:@!$&'()*+,;=~-._"))
        cond = cond | ((file == here) & reduce(or_, [row.between(a, b) for a, b in ranges]))
    reader = spark.read if len(wanted) == 1 and next(iter(wanted)) == path else spark.read.option("basePath", path)
    return reader.parquet(*wanted).where(cond)


def column_max(df: DataFrame, column: str) -> int | None:
    """Greatest value; Spark takes it from the footers where it can."""
    return df.agg(F.max(column)).first()[0]


def column_constant(df: DataFrame, column: str):
    """The one value of a column without nulls that has just one, else null."""
    lo, hi, n, m = df.agg(F.min(column), F.max(column), F.count(column), F.count("*")).first()
    return lo if lo == hi and n == m else None


def is_sorted(df: DataFrame, column: str) -> bool:
    """Whether a column never falls in the order of file names and rows.

    Rows are numbered over the files and looked at in blocks of a fixed number, which are dealt to as many
    tasks as the rows need; then the blocks' ends are compared.
    """
    rows = df.select(F.col(column).alias("v"), F.col("_metadata.file_path").alias("f"), F.col("_metadata.row_index").alias("i"))
    starts, at = [], 0
    for file, last in rows.groupBy("f").agg(F.max("i")).orderBy("f").collect():  # a row per file
        starts.append((file, at))
        at += last + 1
    if not starts:
        return True
    numbered = rows.join(F.broadcast(df.sparkSession.createDataFrame(starts, "f string, at bigint")), "f").select("v", (F.col("at") + F.col("i")).alias("i"))
    dealt = numbered.withColumn("b", F.floor(F.col("i") / BLOCK_ROWS)).repartition(-(-at // TASK_ROWS), "b")
    per = dealt.withColumn("p", F.lag("v").over(Window.partitionBy("b").orderBy("i"))).groupBy("b").agg(F.max(F.col("v") < F.col("p")).alias("falls"), F.min_by("v", "i").alias("first"), F.max_by("v", "i").alias("last"))
    # a row per block
    ends = per.select("falls", (F.col("first") < F.lag("last").over(Window.orderBy("b"))).alias("steps_down"))
    return ends.agg(F.max(F.greatest("falls", "steps_down"))).first()[0] is not True
