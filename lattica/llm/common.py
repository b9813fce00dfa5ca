"""Helpers that the training-data operators share."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lattica.sources.tables import materialize, working_dir

__all__ = ["SPACE", "WORD", "crc_mod", "documents", "in_order", "materialize", "n_words", "words", "working_dir"]

#: A word: a run of characters other than space, tab, LF, VT, FF and CR.
WORD = r"[^\x20\x09-\x0D]+"
SPACE = r"[\x20\x09-\x0D]+"


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def words(text: Column) -> Column:
    """The words of a text as an array; null: none."""
    return F.coalesce(F.regexp_extract_all(text, F.lit(f"({WORD})"), F.lit(1)), F.array().cast("array<string>"))


def n_words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def crc_mod(id_col: str, n: int) -> Column:
    """crc32 of the id as text, modulo n."""
    return F.crc32(F.col(id_col).cast("string")) % n


def in_order(df: DataFrame, *keys: Column, name: str) -> DataFrame:
    """df sorted by keys over all partitions and written, with pid (its sorted partition) and idx (its place there)."""
    seen = F.monotonically_increasing_id()
    return materialize(
        df.orderBy(*keys).withColumn("_at", seen).withColumns({"pid": F.shiftright("_at", 33), "idx": F.col("_at").bitwiseAND((1 << 33) - 1)}).drop("_at"),
        name,
    )
