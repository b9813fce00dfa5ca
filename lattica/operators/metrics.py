"""Ranking and classification metrics by group, as plain aggregates."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lattica.sources.tables import materialize


def _by_score(scored: DataFrame, keys: list[str], y: str, p: str) -> DataFrame:
    """Per group and distinct score: positives and negatives, those at this or higher scores, and the group's totals.

    Equal scores are combined first. The distinct ones are sorted over all partitions, whatever their group; a first pass sums
    up each sorted part of a group, a second one counts within the part, so that a group of very many scores is many tasks'
    work."""
    rows = scored.where(F.col(y).isNotNull() & F.col(p).isNotNull())
    per = rows.groupBy(*keys, p).agg(F.sum((F.col(y) == 1).cast("bigint")).alias("pos"), F.sum((F.col(y) != 1).cast("bigint")).alias("neg"))
    per = materialize(per.orderBy(*keys, F.col(p).desc()).withColumn("_part", F.spark_partition_id()), "ranking-steps")
    names = [f"_{k}" for k in keys]
    parts = per.groupBy(*(F.col(k).alias(n) for k, n in zip(keys, names, strict=True)), F.col("_part").alias("_at")).agg(F.sum("pos").alias("_pos"), F.sum("neg").alias("_neg"))
    before = Window.partitionBy(*names).orderBy("_at").rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy(*names)
    parts = parts.select(
        *names, "_at", *(F.coalesce(F.sum(c).over(before), F.lit(0)).alias(f"{c}_before") for c in ("_pos", "_neg")), F.sum("_pos").over(whole).alias("all_pos"), F.sum("_neg").over(whole).alias("all_neg")
    )
    same = F.col("_part") == F.col("_at")
    for k, n in zip(keys, names, strict=True):
        same &= F.col(k).eqNullSafe(F.col(n))
    down = Window.partitionBy(*keys, "_part").orderBy(F.col(p).desc()).rowsBetween(Window.unboundedPreceding, 0)
    inside = per.withColumns({"_cum_pos": F.sum("pos").over(down), "_cum_neg": F.sum("neg").over(down)})
    return inside.join(parts, same).select(*keys, p, "pos", "neg", (F.col("_cum_pos") + F.col("_pos_before")).alias("cum_pos"), (F.col("_cum_neg") + F.col("_neg_before")).alias("cum_neg"), "all_pos", "all_neg")


def _two_classes() -> Column:
    return (F.max("all_pos") > 0) & (F.max("all_neg") > 0)


def ranking(scored: DataFrame, keys: list[str], y: str = "y_true", p: str = "y_pred") -> DataFrame:
    """keys, roc_auc, pr_auc: ties count half in the first and are one step in the second; null with fewer than two classes."""
    steps = _by_score(scored, keys, y, p)
    auc = F.try_divide(F.sum(F.col("pos") * (F.col("all_neg") - F.col("cum_neg") + 0.5 * F.col("neg"))), F.max(F.col("all_pos") * F.col("all_neg")))
    ap = F.sum(F.try_divide(F.col("pos") * 1.0, F.col("all_pos")) * F.try_divide(F.col("cum_pos") * 1.0, F.col("cum_pos") + F.col("cum_neg")))
    return steps.groupBy(*keys).agg(F.when(_two_classes(), auc).alias("roc_auc"), F.when(_two_classes(), ap).alias("pr_auc"))


def oos_metrics(predictions: DataFrame, key: str = "model") -> DataFrame:
    """By model ("all" where there is no such column): roc_auc, pr_auc, precision, recall, f1, neg_brier_score over complete rows.
    Ratios over nothing are 0; a model without complete rows has nulls."""
    if key not in predictions.columns:
        predictions = predictions.withColumn(key, F.lit("all"))
    rows = predictions.dropna(subset=["y_true", "y_pred", "y_pred_binary"])
    tp, fp, fn = (F.sum(((F.col("y_true") == y) & (F.col("y_pred_binary") == b)).cast("bigint")) for y, b in ((1, 1), (0, 1), (1, 0)))
    zero = lambda a, b: F.coalesce(F.try_divide(a * 1.0, b), F.lit(0.0))
    plain = rows.groupBy(key).agg(zero(tp, tp + fp).alias("precision"), zero(tp, tp + fn).alias("recall"), zero(2 * tp, 2 * tp + fp + fn).alias("f1"), (-F.avg((F.col("y_pred") - F.col("y_true")) ** 2)).alias("neg_brier_score"))
    out = predictions.select(key).distinct().join(ranking(rows, [key]), key, "left").join(plain, key, "left")
    return out.select(key, "roc_auc", "pr_auc", "precision", "recall", "f1", "neg_brier_score")


SCORING = {"roc_auc": "roc_auc", "pr_auc": "pr_auc"}


def scoring(name: str | Callable) -> str | Callable:
    """The column of `ranking` for a metric's name; a function of (truth, predictions) is itself."""
    if callable(name):
        return name
    if name not in SCORING:
        raise ValueError(f"unknown metric {name!r}; there are {', '.join(SCORING)}")
    return SCORING[name]
