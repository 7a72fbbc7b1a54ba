"""Registered tables: a JSON file of names, places and the files that each had when it was registered."""

from __future__ import annotations

import json
import os
import re
import tempfile
from dataclasses import asdict, dataclass, field

from pyspark.sql import DataFrame, SparkSession

from ..errors import CatalogError, UnknownTable
from .parquet import footers, list_files, same_schema, table_of


@dataclass
class Table:
    """A registered table. files: those of its snapshot; partitions: its key=value columns."""

    name: str
    location: str
    format: str = "parquet"
    files: list[str] = field(default_factory=list)
    partitions: list[str] = field(default_factory=list)
    rows: int = 0
    row_groups: int = 0
    bytes: int = 0


class Catalog:
    """Tables by lower-case name, kept in `path`."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    def _load(self) -> dict[str, Table]:
        if not os.path.exists(self.path):
            return {}
        with open(self.path) as f:
            return {k: Table(**v) for k, v in json.load(f).items()}

    def _save(self, tables: dict[str, Table]) -> None:
        os.makedirs(os.path.dirname(os.path.abspath(self.path)), exist_ok=True)
        fd, own = tempfile.mkstemp(dir=os.path.dirname(os.path.abspath(self.path)))
        with os.fdopen(fd, "w") as f:
            json.dump({k: asdict(t) for k, t in sorted(tables.items())}, f, indent=1)
        os.replace(own, self.path)

    def _snapshot(self, name: str, location: str, format: str) -> Table:
        if format != "parquet":
            raise CatalogError(f"tables of format {format} can't be scanned")
        files = list_files(self.spark, location)
        if not files:
            raise CatalogError(f"{location} has no files")
        same_schema(self.spark, location)
        keys = list(dict.fromkeys(m for f, _ in files for m in re.findall(r"/([^/=]+)=[^/]*(?=/)", f.removeprefix(location))))
        meta = list(footers(self.spark, location))
        return Table(name, location, format, [f for f, _ in files], keys, sum(sum(m.rows) for m in meta), sum(len(m.rows) for m in meta), sum(n for _, n in files))

    def register(self, name: str, location: str, format: str = "parquet") -> Table:
        """Pins the files that the place has now under a name of letters, digits and underscores."""
        if not re.fullmatch(r"\w+", name, re.A):
            raise CatalogError(f"{name!r} is no table name")
        tables = self._load()
        tables[name.lower()] = self._snapshot(name.lower(), location, format)
        self._save(tables)
        return tables[name.lower()]

    def refresh(self, name: str) -> Table:
        """Pins the files that the table's place has now."""
        t = self.get(name)
        return self.register(t.name, t.location, t.format)

    def get(self, name: str) -> Table:
        t = self._load().get(name.lower())
        if t is None:
            raise UnknownTable(name)
        return t

    def __contains__(self, name: str) -> bool:
        return name.lower() in self._load()

    def list(self) -> list[Table]:
        return [t for _, t in sorted(self._load().items())]

    def read(self, name: str) -> DataFrame:
        """The rows of the pinned files."""
        t = self.get(name)
        return table_of(self.spark, t.location, t.files)
