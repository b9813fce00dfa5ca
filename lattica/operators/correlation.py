"""Rolling correlations. The matrix of a date uses the `lookback` rows before it, of the assets that have all of them and vary.

Two paths with one contract: pairs with sliding frames, all in the JVM, for up to some 150 assets; and chunks of dates, whose
matrices numpy makes and whose features it returns, so that no pair is a row, for more.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lattica.operators.panel import calendar


def _frame(lookback: int, *keys: str):
    return Window.partitionBy(*keys).orderBy("ord").rangeBetween(1 - lookback, 0)


def complete(returns: DataFrame, dates: DataFrame, lookback: int, min_assets: int | None = None) -> DataFrame:
    """(date, ord, asset): the assets of each date's matrix: those that have all of the rows before it and aren't constant.
    Dates with fewer than two, or min_assets, have none."""
    rows = returns.join(F.broadcast(dates), "date").where("ret IS NOT NULL")
    frame = _frame(lookback, "asset")
    held = rows.withColumns({"_n": F.count("ret").over(frame), "_flat": F.max("ret").over(frame) == F.min("ret").over(frame)})
    ends = held.where((F.col("_n") == lookback) & ~F.col("_flat")).select((F.col("ord") + 1).alias("ord"), "asset")
    found = ends.join(F.broadcast(dates), "ord")
    enough = found.groupBy("ord").count().where(F.col("count") >= max(2, min_assets or 2)).select("ord")
    return found.join(F.broadcast(enough), "ord").select("date", "ord", "asset")


def rolling_pairs(returns: DataFrame, lookback: int, min_assets: int | None = None, dates: DataFrame | None = None) -> DataFrame:
    """(date, a1, a2, rho) with a1 < a2 and rho as float, for (date, asset, ret). `dates` defaults to the calendar of returns.

    Returns are taken relative to each asset's first, which changes no correlation and keeps moments small. Pairs meet
    by date, and each pair's moments slide over its rows; the frame ends at a row, and its value goes to the date after it."""
    dates = calendar(returns) if dates is None else dates
    rows = returns.where("ret IS NOT NULL").join(F.broadcast(dates), "date")
    rows = rows.withColumn("x", F.col("ret") - F.first("ret").over(Window.partitionBy("asset").orderBy("ord"))).select("ord", "asset", "x")
    one, two = rows.select("ord", F.col("asset").alias("a1"), F.col("x").alias("x")), rows.select("ord", F.col("asset").alias("a2"), F.col("x").alias("y"))
    pairs = one.join(two, "ord").where("a1 < a2")
    frame = _frame(lookback, "a1", "a2")
    over = {"n": F.count(F.lit(1)), "sx": F.sum("x"), "sy": F.sum("y"), "sxx": F.sum(F.col("x") * F.col("x")), "syy": F.sum(F.col("y") * F.col("y")), "sxy": F.sum(F.col("x") * F.col("y"))}
    moments = pairs.withColumns({k: v.over(frame) for k, v in over.items()} | {"fx": (F.max("x").over(frame) == F.min("x").over(frame)), "fy": (F.max("y").over(frame) == F.min("y").over(frame))})
    spread = (F.col("n") * F.col("sxx") - F.col("sx") ** 2) * (F.col("n") * F.col("syy") - F.col("sy") ** 2)
    rho = F.try_divide(F.col("n") * F.col("sxy") - F.col("sx") * F.col("sy"), F.sqrt(F.greatest(spread, F.lit(0.0))))
    found = moments.where((F.col("n") == lookback) & ~F.col("fx") & ~F.col("fy")).select((F.col("ord") + 1).alias("ord"), "a1", "a2", rho.cast("float").alias("rho"))
    found = found.join(F.broadcast(dates), "ord")
    if min_assets and min_assets > 2:
        found = found.join(complete(returns, dates, lookback, min_assets).select("ord").distinct(), "ord", "left_semi")
    return found.select("date", "a1", "a2", "rho")


def on_date(returns: DataFrame, date: str, lookback: int, min_assets: int | None = None) -> DataFrame:
    """One date's pairs. Only the rows of its window are read on; a date that isn't in the calendar, or too early, has none."""
    dates = calendar(returns)
    at = dates.where(F.col("date") == F.to_date(F.lit(date))).select(F.col("ord").alias("_at"))
    near = dates.join(F.broadcast(at), (F.col("ord") >= F.col("_at") - lookback) & (F.col("ord") <= F.col("_at"))).drop("_at")
    few = returns.join(F.broadcast(near.select("date")), "date", "left_semi")
    return rolling_pairs(few, lookback, min_assets, near).where(F.col("date") == F.to_date(F.lit(date)))


def summary(pairs: DataFrame) -> DataFrame:
    """(date, avg_abs_corr, std_abs_corr): population deviation."""
    size = F.abs(F.col("rho").cast("double"))
    return pairs.groupBy("date").agg(F.avg(size).alias("avg_abs_corr"), F.stddev_pop(size).alias("std_abs_corr"))


def matrix_of(window: np.ndarray) -> np.ndarray:
    """Float32 correlations of a window's columns."""
    x = window - window.mean(0)
    x /= np.sqrt((x * x).sum(0))
    return np.clip(x.T @ x, -1, 1).astype(np.float32)


def chunked(returns: DataFrame, lookback: int, each, schema: str, chunk: int | None = None, min_assets: int | None = None) -> DataFrame:
    """each(date, assets, matrix) -> rows, over the matrices of all dates, in chunks of dates with the rows before them. A
    chunk is a task's group: (chunk + lookback) dates of all assets, however long the calendar. By default a chunk is as long as
    the rows before it, so that a return is copied twice at most, or 64 dates."""
    chunk = chunk or max(64, lookback)
    dates = calendar(returns)
    rows = returns.where("ret IS NOT NULL").join(F.broadcast(dates), "date")
    first, last = F.floor((F.col("ord") - 1) / chunk), F.floor((F.col("ord") + lookback - 1) / chunk)
    rows = rows.select("date", "ord", "asset", "ret", F.explode(F.sequence(first, last)).alias("chunk"))
    # Dates without any return are in the calendar too, and must label a matrix.
    marks = dates.select("date", "ord", F.floor((F.col("ord") - 1) / chunk).alias("chunk"), F.lit(None).cast(returns.schema["asset"].dataType).alias("asset"), F.lit(None).cast("double").alias("ret"))
    columns = [c.strip().split()[0] for c in schema.split(",")]

    def solve(group: pd.DataFrame) -> pd.DataFrame:
        k = int(group["chunk"].iloc[0])
        labels = group[group["asset"].isna()].sort_values("ord")
        data = group[group["asset"].notna()]
        wide = data.pivot(index="ord", columns="asset", values="ret").sort_index()
        out: list[tuple] = []
        ords = wide.index.to_numpy()
        values, assets = wide.to_numpy(), wide.columns.to_numpy().astype(np.int64)
        for date, o in zip(labels["date"], labels["ord"], strict=True):
            if o <= lookback or o - 1 < k * chunk - lookback:
                continue
            a, b = np.searchsorted(ords, [o - lookback, o])
            if b - a < lookback:
                continue
            window = values[a:b]
            keep = ~np.isnan(window).any(0)
            keep[keep] = window[:, keep].max(0) != window[:, keep].min(0)
            if keep.sum() >= max(2, min_assets or 2):
                out += each(date, assets[keep], matrix_of(window[:, keep]))
        return pd.DataFrame(out, columns=columns)

    both = rows.unionByName(marks)
    return both.groupBy("chunk").applyInPandas(solve, schema)


def eigen(returns: DataFrame, lookback: int, chunk: int | None = None, min_assets: int | None = None) -> DataFrame:
    """(date, eig1, eig1_ratio): greatest eigenvalue of each date's matrix, and its share of their sum."""

    def each(date, assets: np.ndarray, rho: np.ndarray) -> list[tuple]:
        values = np.linalg.eigvalsh(rho)
        return [(date, float(values[-1]), float(values[-1] / values.sum()))]

    return chunked(returns, lookback, each, "date date, eig1 double, eig1_ratio double", chunk, min_assets)

