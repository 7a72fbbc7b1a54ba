"""A Spark-first analytics engine: SQL and operators over Parquet."""
