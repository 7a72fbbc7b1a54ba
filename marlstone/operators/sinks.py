"""Sinks: CSV, Parquet, standard output."""

from __future__ import annotations

import sys
import uuid
from dataclasses import dataclass

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from ..errors import ParseError

CODECS = ("snappy", "zstd", "uncompressed")


@dataclass(frozen=True)
class ParquetOptions:
    compression: str = "snappy"
    dictionary: bool = True
    row_group_size: int | None = None
    write_batch_size: int | None = None
    data_page_row_count_limit: int | None = None

    def settings(self) -> dict[str, str]:
        """The writer's options. row_group_size is in rows: the writer checks a group's size that often."""
        if self.compression not in CODECS:
            raise ParseError(f"no such compression: {self.compression}")
        out = {"compression": self.compression, "parquet.enable.dictionary": str(self.dictionary).lower()}
        if self.row_group_size:
            out |= {"parquet.block.row.count.limit": str(self.row_group_size)}
        if self.data_page_row_count_limit:
            out |= {"parquet.page.row.count.limit": str(self.data_page_row_count_limit)}
        if self.write_batch_size:  # rows between two looks at a page's size
            out |= {"parquet.page.size.row.check.min": str(self.write_batch_size), "parquet.page.size.row.check.max": str(self.write_batch_size)}
        return out


def _wide(df: DataFrame) -> bool:
    """Whether rows may be gathered after the work on them; a sorted result is in order in one partition only."""
    return "Sort" not in df._jdf.queryExecution().optimizedPlan().toString()


def counted(df: DataFrame) -> tuple[DataFrame, Observation]:
    """df, and the count of its rows as they are written."""
    seen = Observation()
    return df.observe(seen, F.count(F.lit(1)).alias("rows")), seen


def _quoted(s: str) -> str:
    return '"' + s.replace('"', '""') + '"' if any(c in s for c in ',"\r\n') else s


def _into_file(df: DataFrame, path: str, write, head: str = "") -> None:
    """A folder's single part file becomes the file `path`, after the text `head`."""
    spark = df.sparkSession
    folder = f"{path}.{uuid.uuid4().hex}"
    write(df.repartition(1) if _wide(df) else df.coalesce(1), folder)
    Path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    fs = Path(folder).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    part = next(s.getPath() for s in fs.listStatus(Path(folder)) if s.getPath().getName().startswith("part-"))
    fs.delete(Path(path), True)
    if head:
        out = fs.create(Path(path))
        out.write(bytearray(head.encode()))
        spark.sparkContext._jvm.org.apache.hadoop.io.IOUtils.copyBytes(fs.open(part), out, 1 << 16, True)
    elif not fs.rename(part, Path(path)):
        raise OSError(f"can't write {path}")
    fs.delete(Path(folder), True)


def csv_text(df: DataFrame) -> DataFrame:
    """One column of CSV lines: values with a comma, a quote or a line break are quoted, nulls are empty."""

    def cell(name: str, kind: str):
        if kind.startswith(("array", "struct", "map", "binary")):
            raise ParseError(f"CSV can't hold column {name} of type {kind}")
        s = F.col(f"`{name}`").cast("string")
        if kind != "string":
            return F.coalesce(s, F.lit(""))
        return F.coalesce(F.when(s.rlike('[,"\r\n]'), F.concat(F.lit('"'), F.replace(s, F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(s), F.lit(""))

    return df.select(F.concat_ws(",", *[cell(*c) for c in df.dtypes]).alias("value"))


def write_csv(df: DataFrame, path: str, header: bool = False, single: bool = True) -> int:
    """Writes one file (single) or a folder of parts; returns the rows written."""
    df, seen = counted(df)
    lines, head = csv_text(df), ",".join(map(_quoted, df.columns)) + "\n" if header else ""
    if single:
        _into_file(lines, path, lambda d, p: d.write.option("lineSep", "\n").text(p), head)
    else:
        lines.write.mode("overwrite").text(path)
    return seen.get["rows"]


def write_parquet(df: DataFrame, path: str, options: ParquetOptions | None = None, single: bool = True) -> int:
    """Writes one file (single) or a folder of parts, which is what large results want."""
    settings = (options or ParquetOptions()).settings()
    df, seen = counted(df)
    if single:
        _into_file(df, path, lambda d, p: d.write.options(**settings).parquet(p))
    else:
        df.write.mode("overwrite").options(**settings).parquet(path)
    return seen.get["rows"]


def print_rows(df: DataFrame, out=None, header: bool = False) -> int:
    """Rows as CSV to a stream, a partition at a time."""
    out = out or sys.stdout
    if header:
        out.write(",".join(map(_quoted, df.columns)) + "\n")
    n = 0
    for r in csv_text(df).toLocalIterator():
        out.write(r.value + "\n")
        n += 1
    return n
