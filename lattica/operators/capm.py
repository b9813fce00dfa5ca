"""Rolling CAPM betas and idiosyncratic returns."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lattica.functions.series import bounded_fill
from lattica.operators.panel import calendar, common_dates, dense, reindexed


def rolling_beta(excess: DataFrame, lookback: int) -> DataFrame:
    """excess (date, ord, asset, ra, rm) with beta: sample covariance over variance of the last `lookback` numbers of the calendar, if the
    asset has a complete row at each of them. Frames are ranges of ord, so dates without a row need none."""
    frame = Window.partitionBy("asset").orderBy("ord").rangeBetween(1 - lookback, 0)
    both = F.col("ra").isNotNull() & F.col("rm").isNotNull()
    whole = F.count(F.when(both, 1)).over(frame) == lookback
    beta = F.try_divide(F.covar_samp("ra", "rm").over(frame), F.var_samp("rm").over(frame))
    return excess.withColumn("beta", F.when(whole, beta))


def excess_returns(returns: DataFrame, market: DataFrame, rf: DataFrame, limit_rf: int | None) -> DataFrame:
    """(date, ord, asset, ra, rm): the panel's returns over the risk-free rate, and the market's, on the dates that both have; ord numbers
    these dates. The rate is carried forward over limit_rf dates of the panel's calendar."""
    dates = calendar(returns)
    rates = reindexed(rf, dates).withColumn("rf", bounded_fill("rf", limit_rf))
    by_date = calendar(common_dates(returns, market)).join(market, "date").join(rates, "date").select("date", "ord", (F.col("mkt_ret") - F.col("rf")).alias("rm"), "rf")
    return returns.join(F.broadcast(by_date), "date").select("date", "ord", "asset", (F.col("ret") - F.col("rf")).alias("ra"), "rm")


def idiosyncratic_rows(returns: DataFrame, market: DataFrame, rf: DataFrame, lookback: int, limit_beta: int | None, limit_rf: int | None) -> DataFrame:
    """(date, asset, idio) for the rows of the panel on dates that the market has: excess return less beta times the market's. beta is
    carried over limit_beta dates of those at most, which the differences of their numbers decide."""
    fitted = rolling_beta(excess_returns(returns, market, rf, limit_rf), lookback)
    carried = Window.partitionBy("asset").orderBy("ord").rangeBetween(Window.unboundedPreceding if limit_beta is None else -limit_beta, 0)
    beta = F.last("beta", ignorenulls=True).over(carried)
    return fitted.withColumn("beta", beta).select("date", "asset", (F.col("ra") - F.col("beta") * F.col("rm")).alias("idio"))


def idiosyncratic(returns: DataFrame, market: DataFrame, rf: DataFrame, lookback: int, limit_beta: int | None, limit_rf: int | None) -> DataFrame:
    """idiosyncratic_rows on all pairs of the panel's dates and assets, with nulls: for presentation, the engine keeps panels long."""
    idio = idiosyncratic_rows(returns, market, rf, lookback, limit_beta, limit_rf)
    return dense(returns.select("date", "asset").join(idio, ["date", "asset"], "left"), calendar(returns))


def network_returns(returns: DataFrame, kind: str = "raw", idio: DataFrame | None = None) -> DataFrame:
    """(date, asset, ret) that the network is built from: raw returns, or idiosyncratic ones without dates that have none."""
    if kind == "raw":
        return returns
    if kind != "idio" or idio is None:
        raise ValueError(f"returns of kind {kind!r} need to be computed first")
    some = idio.where("idio IS NOT NULL").select("date").distinct()
    return idio.join(some, "date", "left_semi").withColumnRenamed("idio", "ret")
