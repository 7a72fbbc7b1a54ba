"""Sessions with the settings that the engine's semantics rest on."""

from __future__ import annotations

from pyspark.sql import SparkSession

#: Set on any session that an engine is given; all can be changed while it runs.
RUNTIME = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.ansi.enabled": "true",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # key=value folders give text columns, whatever the values look like
    "spark.sql.sources.partitionColumnTypeInference.enabled": "false",
}


def build(master: str | None = None, **conf: str) -> SparkSession:
    """A session for stand-alone use; a cluster's own settings stay."""
    b = SparkSession.builder.appName("marlstone")
    if master:
        b = b.master(master)
    for k, v in {**RUNTIME, **conf}.items():
        b = b.config(k, v)
    return b.getOrCreate()


def prepare(spark: SparkSession) -> SparkSession:
    """Sets what the engine needs on a session that was made elsewhere."""
    for k, v in RUNTIME.items():
        spark.conf.set(k, v)
    return spark
