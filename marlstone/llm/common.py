"""What the operators share: the shared work folder, staged tables, passing batches through Python."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Callable, Iterator, Mapping

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def work_dir(spark: SparkSession) -> str:
    """A new folder below the one that all executors share.

    The cluster names it in spark.checkpoint.dir. Where that is unset, a local master gets a folder
    of its own; any other master is refused, as its executors wouldn't see each other's files.
    """
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not base:
        if not spark.sparkContext.master.startswith("local["):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="marlstone-")
        spark.sparkContext.setCheckpointDir(base)
    return f"{base.rstrip('/')}/work-{uuid.uuid4().hex}"


def stage(df: DataFrame, path: str) -> DataFrame:
    """Writes df as a table in the shared folder and reads it again: this cuts the lineage."""
    df.write.mode("overwrite").option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def merged(df: DataFrame) -> DataFrame:
    """df for a join by sorting, on the executors. For operators of many joins: adaptive execution would
    send each small side through the driver, which keeps over 1 MB of it, however few rows it has, until
    its garbage is collected. Skewed keys are split as in other joins."""
    return df.hint("merge")


def delete(spark: SparkSession, path: str) -> None:
    """Removes a staged table that nothing reads any more."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def publish(store, own: str, path: str) -> None:
    """Moves a file to its last name in a pyarrow store; the same file may be there, of another attempt."""
    try:
        store.move(own, path)
    except OSError:
        if store.get_file_info(path).size != store.get_file_info(own).size:
            raise
        store.delete_file(own)


def to_uri(path: str) -> str:
    """spark.checkpoint.dir may be a plain path; pyarrow wants a scheme."""
    return path if re.match(r"\w+:", path) else "file://" + path


#: Rows of a batch that goes to Python: texts are long.
BATCH_ROWS = 4096


def keyed(df: DataFrame, **columns: str | Column) -> DataFrame:
    """Only the named inputs, under fixed names: extra columns and clashing names go.

    From here on the session sends Python batches of BATCH_ROWS rows at most.
    """
    df.sparkSession.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS)
    return df.select(*[(df[c] if isinstance(c, str) else c).alias(name) for name, c in columns.items()])


def field(name: str, kind: str) -> T.StructField:
    return T.StructField(name, T._parse_datatype_string(kind), True)


def extend(
    df: DataFrame,
    added: Mapping[str, str],
    make: Callable[[], Callable[[pa.RecordBatch], Mapping[str, pa.Array | list | None]]],
    reads: list[str],
    keep: list[str] | None = None,
) -> DataFrame:
    """df's columns (or those of `keep`) and added ones, computed batch by batch in Python.

    make() runs once per task and returns the function of a batch; that gets the columns `reads`.
    If the function's result has the key "__rows__", a boolean list, only those rows go on. An added
    column takes the place of one of the same name, in any case.
    """
    lower = {a.lower() for a in added}
    passed = [c for c in (df.columns if keep is None else keep) if c.lower() not in lower]
    sent = list(dict.fromkeys([*passed, *reads]))
    df = df.select(*[df[c] for c in sent])
    schema = T.StructType([df.schema[c] for c in passed] + [field(n, k) for n, k in added.items()])
    types = dict(added)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        step = make()
        for batch in batches:
            if not batch.num_rows:
                continue
            got = step(batch)
            rows = got.pop("__rows__", None) if isinstance(got, dict) else None
            cols = [batch.column(sent.index(c)) for c in passed]
            for name, kind in types.items():
                v = got[name]
                cols.append(v if isinstance(v, pa.Array) else pa.array(v, ARROW[kind]))
            out = pa.RecordBatch.from_arrays(cols, names=[*passed, *types])
            yield out if rows is None else out.filter(pa.array(rows, pa.bool_()))

    return df.mapInArrow(run, schema)


_held: dict[tuple, object] = {}


def held(key: tuple, make: Callable[[], object]):
    """What a worker process keeps between its tasks, such as the words it has met: one thing at a time.

    Another key's thing goes, so that a process that runs several operators in turn doesn't hold what
    all of them have gathered.
    """
    if key not in _held:
        _held.clear()
        _held[key] = make()
    return _held[key]


def release() -> None:
    """Drops what the process keeps; operators that keep nothing call it as they begin."""
    _held.clear()


ARROW = {
    "long": pa.int64(), "int": pa.int32(), "double": pa.float64(), "boolean": pa.bool_(),
    "string": pa.string(), "binary": pa.binary(), "array<long>": pa.list_(pa.int64()),
    "array<string>": pa.list_(pa.string()),
}


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


__all__ = ["ARROW", "F", "T", "delete", "documents", "extend", "field", "held", "keyed", "merged", "partitions", "publish", "release", "stage", "to_uri", "work_dir"]
