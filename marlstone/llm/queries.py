"""The queries of this subpackage and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import line_dedup, near_dup
from .ann import op4_nearest_neighbours
from .bpe_codec import op10_byte_bpe
from .html_extract import op2_main_text
from .langid import op5_language_id
from .packing import op9_packing
from .quality_crf import op3_quality_rules
from .token_counts import op6_token_counts
from .token_files import op8_token_files


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_line_dedup": line_dedup.op1_line_dedup,
        "op2_main_text": op2_main_text,
        "op3_quality_rules": op3_quality_rules,
        "op4_nearest_neighbours": op4_nearest_neighbours,
        "op5_language_id": op5_language_id,
        "op6_token_counts": op6_token_counts,
        "op7_near_duplicates": near_dup.op7_near_duplicates,
        "op8_token_files": op8_token_files,
        "op9_packing": op9_packing,
        "op10_byte_bpe": op10_byte_bpe,
        "pipeline": pipeline,
    }


def oracle_sql() -> dict[str, str]:
    return {"op1_line_dedup": line_dedup.SQL, "op7_near_duplicates": near_dup.SQL}
