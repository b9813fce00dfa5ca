"""Targets: features of the market series and labels from their quantiles."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lattica.functions.series import below, by, drawdown, forward_max_drawdown, growth, realized_volatility, rolling_quantile


def _warm(df: DataFrame, window: int) -> DataFrame:
    """Without the first window + 1 rows."""
    return df.withColumn("_n", F.row_number().over(by())).where(F.col("_n") > window + 1).drop("_n")


def volatility(market: DataFrame, window: int, frequency: str = "d") -> DataFrame:
    """(date, raw): annualised realized volatility of mkt_ret."""
    return _warm(market.select("date", realized_volatility("mkt_ret", window, frequency).alias("raw")), window)


def max_drawdown(market: DataFrame, window: int) -> DataFrame:
    """(date, raw): growth over the window against its greatest value in all history."""
    return _warm(market.withColumn("g", growth("mkt_ret", window)).select("date", drawdown("g").alias("raw")), window)


def forward_drawdown(market: DataFrame, window: int) -> DataFrame:
    """(date, raw): greatest fall over the next window rows."""
    return market.select("date", forward_max_drawdown("mkt_ret", window).alias("raw"))


FEATURES = {"realized_volatility": volatility, "maximum_drawdown": max_drawdown, "forward_max_drawdown": forward_drawdown}


def labelled(feature: DataFrame, window: int, quantile: float) -> DataFrame:
    """(date, raw, label): label 1 where raw is under its own rolling quantile; 0 too where either is null."""
    with_bound = feature.withColumn("_q", rolling_quantile("raw", window, quantile))
    return with_bound.select("date", "raw", below("raw", "_q").alias("label"))


def target(market: DataFrame, variable: str, window: int, quantile: float, frequency: str = "d") -> DataFrame:
    """(date, raw, target) for a target variable by name; dummy_<feature> gives a label, <feature> the feature itself."""
    name = variable.removeprefix("dummy_")
    if name not in FEATURES:
        raise ValueError(f"unknown target variable {variable!r}; there are {', '.join(FEATURES)}, each also as dummy_")
    options = (frequency,) if name == "realized_volatility" else ()
    feature = FEATURES[name](market, window, *options)
    if variable.startswith("dummy_"):
        return labelled(feature, window, quantile).withColumnRenamed("label", "target")
    return feature.withColumn("target", F.col("raw"))


def led(df: DataFrame, column: str, horizon: int) -> DataFrame:
    """df with column moved `horizon` rows back in time, as <column>_to_predict."""
    moved = F.lead(column, horizon).over(by()) if horizon else F.col(column)
    return df.withColumn(f"{column}_to_predict", moved)
