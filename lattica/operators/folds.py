"""Rolling folds on a calendar's numbers."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def rolling_folds(dates: DataFrame, train: int, val: int, step: int | None = None) -> DataFrame:
    """(fold_id, train_start, train_end, val_start, val_end): numbers of dates, ends included. Folds go on while both parts
    fit; step defaults to val. None fits: no rows."""
    step = val if step is None else step
    if min(train, val, step) <= 0:
        raise ValueError("sizes and step must be positive")
    n = dates.agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= train + val)
    starts = n.select(F.posexplode(F.sequence(F.lit(0).cast("bigint"), F.col("n") - train - val, F.lit(step).cast("bigint"))).alias("fold_id", "s"))
    return starts.select(
        F.col("fold_id").cast("bigint").alias("fold_id"), (F.col("s") + 1).alias("train_start"), (F.col("s") + train).alias("train_end"),
        (F.col("s") + train + 1).alias("val_start"), (F.col("s") + train + val).alias("val_end"),
    )


def membership(dates: DataFrame, folds: DataFrame) -> DataFrame:
    """(fold_id, role, date): a range join of the calendar with folds, each a short list of numbers."""
    roles = folds.select("fold_id", F.explode(F.array(F.struct(F.lit("train").alias("role"), F.col("train_start").alias("a"), F.col("train_end").alias("b")), F.struct(F.lit("val").alias("role"), F.col("val_start").alias("a"), F.col("val_end").alias("b")))).alias("r"))
    spread = roles.select("fold_id", "r.role", F.explode(F.sequence("r.a", "r.b")).alias("ord"))
    return spread.join(dates, "ord").select("fold_id", "role", "date")


def best_combination(scores: DataFrame, keys: list[str], order: list[str], score: str = "score") -> DataFrame:
    """Of each key the row of the greatest score; of equal ones the first in grid order; null scores never win."""
    rank = F.struct(F.col(score), *(-F.col(c) for c in order))
    rest = [c for c in scores.columns if c not in keys]
    best = scores.where(F.col(score).isNotNull()).groupBy(*keys).agg(F.max_by(F.struct(*rest), rank).alias("_r"))
    return best.select(*keys, *(F.col(f"_r.{c}").alias(c) for c in rest))


def full_index(dates: DataFrame, models: DataFrame, predictions: DataFrame) -> DataFrame:
    """Predictions on every pair of test date and model; those that were skipped have nulls."""
    return dates.select("date").crossJoin(models.select("model")).join(predictions, ["date", "model"], "left")
