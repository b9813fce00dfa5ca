"""Calendars, universes, alignment and joins of panels."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lattica.functions.series import by


def calendar(panel: DataFrame) -> DataFrame:
    """(date, ord): the distinct dates, numbered from 1. One row a date, so one task numbers them."""
    return panel.select("date").distinct().withColumn("ord", F.row_number().over(by()).cast("bigint"))


def universe(panel: DataFrame) -> DataFrame:
    """(date, assets): each date's assets, ascending."""
    return panel.groupBy("date").agg(F.sort_array(F.collect_list("asset")).alias("assets"))


def pivoted(panel: DataFrame, assets: list[int], value: str = "ret") -> DataFrame:
    """A column a<id> for each asset: for presentation only, the engine keeps panels long. A date and asset that occur more
    than once are an error."""
    twice = F.raise_error(F.concat(F.lit("a panel has one row a date and asset; repeated: "), F.min("date").cast("string")))
    wide = panel.groupBy("date").pivot("asset", assets).agg(F.when(F.count(F.lit(1)) <= 1, F.first(value)).otherwise(twice))
    return wide.select("date", *(F.col(f"`{a}`").alias(f"a{a}") for a in assets))


def duplicates(panel: DataFrame) -> DataFrame:
    """(date, asset) pairs that occur more than once; a panel has none."""
    return panel.groupBy("date", "asset").count().where("count > 1").drop("count")


def keep_last(df: DataFrame, key: str = "date", sequence: str = "seq") -> DataFrame:
    """Of each key the row that is last by sequence. An aggregate, so that a frequent key is combined before the shuffle."""
    rest = [c for c in df.columns if c != key]
    return df.groupBy(key).agg(F.max_by(F.struct(*rest), sequence).alias("_r")).select(key, *(F.col(f"_r.{c}").alias(c) for c in rest))


def reindexed(df: DataFrame, dates: DataFrame) -> DataFrame:
    """df on all of dates: nulls where it has none; its other dates go."""
    return dates.select("date").join(df, "date", "left")


def reindexed_panel(df: DataFrame, dates: DataFrame, assets: DataFrame) -> DataFrame:
    """A panel on all pairs of dates and assets. Both lists are key lists, a row a date and a row an asset."""
    return dates.select("date").crossJoin(assets.select("asset")).join(df, ["date", "asset"], "left")


def dense(df: DataFrame, dates: DataFrame) -> DataFrame:
    """A panel with a row of nulls on those of dates (date, ord from 1 on) where an asset has none; rows on other dates go. Each row
    gives the missing dates up to the asset's next row, the first one those before it too, so no list of assets meets a list of
    dates. An asset without a row on any of dates isn't there."""
    numbered = df.join(F.broadcast(dates.withColumn("_n", F.count(F.lit(1)).over(Window.partitionBy()))), "date").drop("date")
    line = Window.partitionBy("asset").orderBy("ord")
    first = F.when(F.row_number().over(line) == 1, F.lit(1).cast("bigint")).otherwise(F.col("ord"))
    spread = numbered.withColumns({"_from": first, "_to": F.coalesce(F.lead("ord").over(line) - 1, F.col("_n"))}).withColumn("_at", F.explode(F.sequence("_from", "_to")))
    values = [c for c in df.columns if c not in ("date", "asset")]
    own = spread.select(F.col("_at").alias("ord"), "asset", *(F.when(F.col("_at") == F.col("ord"), F.col(c)).alias(c) for c in values))
    return own.join(F.broadcast(dates), "ord").select(*df.columns)


def common_dates(*frames: DataFrame) -> DataFrame:
    """Dates that all frames have."""
    return reduce(lambda a, b: a.join(b, "date", "left_semi"), frames[1:], frames[0].select("date").distinct())


def asof(left: DataFrame, right: DataFrame, key: str | None = None) -> DataFrame:
    """left with the columns of the last row of right up to its date (exact matches count). That row's nulls are kept;
    without one the columns are null. One sort of both sides by date, not a join."""
    carried = [c for c in right.columns if c not in ("date", key)]
    kept = [c for c in left.columns if c not in ("date", key)]
    keys = ["date", *([key] if key else [])]
    void = lambda df, names: F.lit(None).cast(df.select(F.struct(*names)).schema[0].dataType)
    l_side = left.select(*keys, F.struct(F.lit(1).alias("_l"), *kept).alias("_left"), void(right, carried).alias("_right"), F.lit(1).alias("_side"))
    r_side = right.select(*keys, F.lit(None).cast(l_side.schema["_left"].dataType).alias("_left"), F.struct(*carried).alias("_right"), F.lit(0).alias("_side"))
    frame = (Window.partitionBy(key) if key else Window.partitionBy()).orderBy("date", "_side").rowsBetween(Window.unboundedPreceding, 0)
    both = l_side.unionByName(r_side).withColumn("_right", F.last("_right", ignorenulls=True).over(frame)).where("_side = 1")
    return both.select(*keys, *(F.col(f"_left.{c}").alias(c) for c in kept), *(F.col(f"_right.{c}").alias(c) for c in carried))


def cropped(df: DataFrame, column: str) -> DataFrame:
    """df from the first date on that has the column: one scalar, compared."""
    first = df.where(F.col(column).isNotNull()).agg(F.min("date").alias("_first"))
    return df.crossJoin(F.broadcast(first)).where("date >= _first").drop("_first")
