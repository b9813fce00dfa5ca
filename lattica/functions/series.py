"""Window expressions over series: frames count rows, and a result is null until its frame is full and complete."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, Window, WindowSpec
from pyspark.sql import functions as F

#: Periods a year by frequency.
PERIODS = {"d": 252, "w": 52, "m": 12, "y": 1}


def by(key: str | None = None, order: str = "date") -> WindowSpec:
    return (Window.partitionBy(key) if key else Window.partitionBy()).orderBy(order)


def full(x: str, n: int, of: Callable[[str], Column], key: str | None = None, order: str = "date") -> Column:
    """of(x) over the last n rows, if all have x."""
    frame = by(key, order).rowsBetween(1 - n, 0)
    return F.when(F.count(x).over(frame) == n, of(x).over(frame))


def lagged_change(x: str, key: str | None = None, order: str = "date") -> Column:
    """x over its value in the row before, less 1; null if either is null."""
    return F.try_divide(F.col(x), F.lag(x).over(by(key, order))) - 1


def cumulative_return(r: str, key: str | None = None, order: str = "date") -> Column:
    """Product of 1 + r up to here, less 1. Null rows stay null and are skipped by the product."""
    upto = by(key, order).rowsBetween(Window.unboundedPreceding, 0)
    return F.when(F.col(r).isNotNull(), F.product(1 + F.col(r)).over(upto) - 1)


def realized_volatility(r: str, n: int, frequency: str = "d", key: str | None = None) -> Column:
    """Sample deviation of the last n returns, a year's. An unknown frequency is a KeyError."""
    return full(r, n, F.stddev_samp, key) * (PERIODS[frequency] ** 0.5)


def growth(r: str, n: int, key: str | None = None) -> Column:
    """Product of 1 + r over the last n rows."""
    return full(r, n, lambda x: F.product(1 + F.col(x)), key)


def drawdown(g: str, key: str | None = None, order: str = "date") -> Column:
    """g over its greatest value so far, less 1."""
    return F.try_divide(F.col(g), F.max(g).over(by(key, order).rowsBetween(Window.unboundedPreceding, 0))) - 1


def forward_max_drawdown(r: str, n: int, key: str | None = None, order: str = "date") -> Column:
    """Least drawdown of the growth over the next n returns, whose running maximum starts at the first of them. Null where
    fewer than n follow or one is null."""
    ahead = F.collect_list(r).over(by(key, order).rowsBetween(1, n))
    start = F.struct(F.lit(1.0).alias("g"), F.lit(None).cast("double").alias("top"), F.lit(0.0).alias("low"))

    def step(a: Column, x: Column) -> Column:
        g = a["g"] * (1 + x)
        top = F.greatest(a["top"], g)
        return F.struct(g.alias("g"), top.alias("top"), F.least(a["low"], g / top - 1).alias("low"))

    return F.when(F.size(ahead) == n, F.aggregate(ahead, start, step, lambda a: a["low"]))


def rolling_quantile(f: str, n: int, q: float, key: str | None = None) -> Column:
    """Exact interpolated quantile of the last n values."""
    return full(f, n, lambda x: F.percentile(x, F.lit(q)), key)


def below(f: str, bound: str) -> Column:
    """1 where f is under bound, else 0, also where either is null."""
    return F.coalesce((F.col(f) < F.col(bound)).cast("int"), F.lit(0))


def bounded_fill(x: str, limit: int | None, key: str | None = None, order: str = "date") -> Column:
    """x carried forward over `limit` rows at most; None: without limit."""
    return F.last(x, ignorenulls=True).over(by(key, order).rowsBetween(Window.unboundedPreceding if limit is None else -limit, 0))


def mantegna_distance(rho: str | Column) -> Column:
    """sqrt(2 (1 - rho)) of a correlation clipped to [-1, 1]."""
    return F.sqrt(2 * (1 - F.greatest(F.lit(-1.0), F.least(F.lit(1.0), F.col(rho) if isinstance(rho, str) else rho))))


def logistic(s: str | Column) -> Column:
    return 1 / (1 + F.exp(-(F.col(s) if isinstance(s, str) else s)))
