"""The corpus pipeline: language, quality, lines, near duplicates, packing.

Each stage takes (spark, docs, sf_dir) and returns what the next one gets as docs; all but the last
return the columns of documents.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marlstone.llm import langid, line_dedup, near_dup, packing, quality_crf
from marlstone.llm.common import documents, stage, work_dir

#: Documents whose best language has a lower mean probability are rejected, as those without a letter.
LEAST_SCORE = 0.3


def languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a language that the network knows; it learns from the labelled ones of the corpus."""
    return langid.identify(docs, langid.train_on(docs), reject_below=LEAST_SCORE)


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base rules and the verdict on their lines."""
    field = quality_crf.train_on(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return quality_crf.judge(docs, field, only_kept=True)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The same documents without the lines that 10 or more of them share; n_chars is that of the rest."""
    index = line_dedup.index_lines(docs, work_dir(spark) + "/lines")
    return line_dedup.drop_lines(docs, index).withColumn("n_chars", F.length("text").cast("long")).select(docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that of the smallest doc_id, of each group of near duplicates."""
    return near_dup.drop_near_duplicates(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents' pieces in sequences of 2048 ids."""
    import public_tokenizers

    return packing.pack(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language", languages),
    ("quality", quality),
    ("lines", lines),
    ("near_duplicates", near_duplicates),
    ("packing", packed),
]

#: SQL can't express the network, the random field, or the curve; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on documents, each one's result written and read again."""
    docs, folder = documents(spark, sf_dir), work_dir(spark)
    for i, (name, step) in enumerate(STAGES):
        docs = step(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = stage(docs, f"{folder}/{name}")
    return docs
