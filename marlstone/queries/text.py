"""Queries given as SQL text, run by the engine's front end."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ..engine import Engine

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def from_text(sql: str) -> Callable[[SparkSession, str], DataFrame]:
    """A query of the tables that the text names; {dir} in it is the tables' folder."""
    used = [t for t in TABLES if re.search(rf"\b{t}\b", sql)]

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        engine = Engine(spark)
        engine.bind(**{t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in used})
        return engine.select(sql.replace("{dir}", sf_dir))

    return run


def both(texts: dict[str, str | tuple[str, str]]) -> tuple[dict, dict]:
    """Queries and oracle texts; a pair is the engine's text and DuckDB's."""
    queries = {k: from_text(v if isinstance(v, str) else v[0]) for k, v in texts.items()}
    return queries, {k: v if isinstance(v, str) else v[1] for k, v in texts.items()}
