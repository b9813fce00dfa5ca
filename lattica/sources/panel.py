"""The roles of a market study played by order tables: asset prices, a market level, a risk-free rate."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lattica.functions.series import lagged_change
from lattica.sources.tables import table

#: Rows of a file that are added up as one run; runs' sums are then added up in order of files and rows.
RUN = 2**24


def month(column: str) -> F.Column:
    return F.to_date(F.date_trunc("month", column))


def mean_in_order(rows: DataFrame, key: F.Column, x: F.Column, name: str, run: int = RUN) -> DataFrame:
    """(date, name): mean of x by key, added up in the order in which the files hold the rows; null without a value. avg() adds up
    tasks' sums as they come in, so its last bits vary from run to run, and labels of equal falls hang on them."""
    place = (F.col("_metadata.file_path").alias("file"), F.expr(f"_metadata.row_index div {run}").alias("run"), F.col("_metadata.row_index").alias("row"))
    placed = rows.select(key.alias("date"), x.alias("x"), *place)
    upto = Window.partitionBy("date", "run", "file").orderBy("row").rowsBetween(Window.unboundedPreceding, 0)
    summed = placed.select("date", "run", "file", "row", F.sum("x").over(upto).alias("total"), F.count("x").over(upto).alias("n"))
    runs = summed.groupBy("date", "run", "file").agg(F.max_by("total", "row").alias("total"), F.max("n").alias("n"))
    ordered = F.array_sort(F.collect_list(F.struct("file", "run", "total")))
    total = F.aggregate(ordered, F.lit(0.0), lambda s, r: s + F.coalesce(r["total"], F.lit(0.0)))
    return runs.groupBy("date").agg(F.try_divide(total, F.sum("n")).alias(name))


def price_panel(spark: SparkSession, sf_dir: str, daily: bool = False) -> DataFrame:
    """(date, asset, px): mean unit price by month, or day, and brand. Only the join key and the brand of part are read."""
    date = F.to_date("l_shipdate") if daily else month("l_shipdate")
    items = table(spark, sf_dir, "lineitem").select("l_partkey", date.alias("date"), (F.col("l_extendedprice") / F.col("l_quantity")).alias("px"))
    parts = table(spark, sf_dir, "part").select("p_partkey", F.substring("p_brand", 7, 9).cast("bigint").alias("asset"))
    return items.join(parts, F.col("l_partkey") == F.col("p_partkey")).groupBy("date", "asset").agg(F.avg("px").alias("px"))


def returns(panel: DataFrame) -> DataFrame:
    """(date, asset, ret) of (date, asset, px)."""
    return panel.select("date", "asset", lagged_change("px", "asset").alias("ret"))


def market_level(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(date, level): mean order price by month."""
    return mean_in_order(table(spark, sf_dir, "orders"), month("o_orderdate"), F.col("o_totalprice"), "level")


def risk_free(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(date, rf): a twelfth of the mean tax by month, without June to August."""
    items = table(spark, sf_dir, "lineitem").where(~F.month("l_shipdate").isin(6, 7, 8))
    return items.groupBy(month("l_shipdate").alias("date")).agg((F.avg("l_tax") / 12).alias("rf"))
