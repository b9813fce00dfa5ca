"""Results kept by key: three Parquet tables in any file system that Spark writes."""

from __future__ import annotations

import logging

from pyspark.errors import AnalysisException
from pyspark.sql import SparkSession

from lattica.operators.walkforward import Result

PARTS = ("predictions", "selection", "metrics")


def path_of(root: str, key: str, name: str) -> str:
    return f"{root.rstrip('/')}/cv_results/{key}/{name}.parquet"


def load(spark: SparkSession, root: str, key: str) -> Result | None:
    """All three tables, or None."""
    try:
        return Result(*(spark.read.parquet(path_of(root, key, name)) for name in PARTS))
    except AnalysisException:
        return None


def save(result: Result, root: str, key: str) -> None:
    """Write the three tables; those there are replaced, with a warning."""
    spark = result.predictions.sparkSession
    if load(spark, root, key) is not None:
        logging.getLogger(__name__).warning("replacing results %s", key)
    for name in PARTS:
        getattr(result, name).write.mode("overwrite").parquet(path_of(root, key, name))


def cached(spark: SparkSession, root: str | None, key: str, compute, load_first: bool = True, keep: bool = True) -> Result:
    """The result kept under key, or else computed, and kept if asked for."""
    if root and load_first and (found := load(spark, root, key)) is not None:
        return found
    result = compute()
    if root and keep:
        save(result, root, key)
    return result
