"""A corpus pipeline over ``documents``: each stage works on what the one before kept."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tidelog.llm.blocks import release
from tidelog.llm.stages import (
    best_fit_packing_stage,
    ngram_jaccard_stage,
    pii_stage,
    suffix_array_stage,
    toxicity_stage,
)
from tidelog.session import work_path

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]

STAGES: list[tuple[str, Stage]] = [
    ("toxicity", toxicity_stage),
    ("ngram_jaccard_join", ngram_jaccard_stage),
    ("suffix_array_dedup", suffix_array_stage),
    ("pii", pii_stage),
    ("best_fit_packing", best_fit_packing_stage),
]

#: SQL can express neither the learned stages nor the byte-pair ids.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the whole ``documents`` table. Each result is written as Parquet to
    the shared folder and read again, so a lost executor repeats one stage at most and the
    shuffles of a stage can go."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        path = work_path(spark, name)
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
        release(spark)
    return docs
