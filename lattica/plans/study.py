"""A whole study by configuration: tables in, series, networks, walk-forward results out."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lattica.functions.series import cumulative_return, lagged_change
from lattica.operators import capm, correlation, labels, network, panel, tiles, walkforward
from lattica.sources import cache, charts
from lattica.sources.config import Config, registry
from lattica.sources.tables import materialize, nan_to_null

#: Assets from which a date's matrix (8 bytes a pair, some of them held at once) isn't made in one task.
TILED_FROM = 3000


@dataclass
class Study:
    """Lazy frames of a study whose Parquet files lie under root (any file system that Spark reads). asset names the id
    column of the returns; is_level tells whether the market file holds levels or returns."""

    spark: SparkSession
    config: Config
    root: str
    asset: str = "permno"
    is_level: bool = True

    def table(self, stem: str | None) -> DataFrame:
        """A configured file by its stem; an AttributeError if it isn't there, or is one that the configuration skips."""
        files = registry(list(self.config.filenames_to_load), tuple(x.rsplit("/", 1)[-1].rsplit(".", 1)[0] for x in self.config.filenames_to_skip))
        name = (stem or "").rsplit("/", 1)[-1].rsplit(".", 1)[0]
        if name not in files:
            raise AttributeError(f"no file {stem!r} is configured; there are {', '.join(files)}")
        return nan_to_null(self.spark.read.parquet(f"{self.root.rstrip('/')}/{files[name]}")).withColumn("date", F.to_date("date"))

    @cached_property
    def returns(self) -> DataFrame:
        return self.table(self.config.dates_filename).select("date", F.col(self.asset).cast("bigint").alias("asset"), F.col("ret").cast("double").alias("ret"))

    @cached_property
    def market(self) -> DataFrame:
        """(date, mkt_ret, cumulative_return) of the benchmark column, by default the first."""
        found = self.table(self.config.mkt_returns_filename)
        columns = [c for c in found.columns if c != "date"]
        name = self.config.mkt_benchmark_column or columns[0]
        if name not in columns:
            raise ValueError(f"no column {name!r}; there are {', '.join(columns)}")
        found = found.select("date", F.col(f"`{name}`").cast("double").alias("level"))
        found = found.select("date", (lagged_change("level") if self.is_level else F.col("level")).alias("mkt_ret")).where("mkt_ret IS NOT NULL")
        return found.withColumn("cumulative_return", cumulative_return("mkt_ret"))

    @cached_property
    def risk_free(self) -> DataFrame:
        """(date, rf): the first column; of repeated dates the row that the files hold last."""
        found = self.table(self.config.rf_returns_filename)
        first = next(c for c in found.columns if c != "date")
        return panel.keep_last(found.select("date", F.col(f"`{first}`").cast("double").alias("rf"), F.monotonically_increasing_id().alias("seq"))).drop("seq")

    @cached_property
    def idiosyncratic(self) -> DataFrame:
        """(date, asset, idio) of the panel's rows."""
        c = self.config
        return capm.idiosyncratic_rows(self.returns, self.market.select("date", "mkt_ret"), self.risk_free, c.lookback_corr, c.limit_ffill_betas, c.limit_ffill_rf)

    @cached_property
    def network_returns(self) -> DataFrame:
        """Raw or idiosyncratic returns from the first date that has a target."""
        idio = None if self.config.returns_type == "raw" else self.idiosyncratic
        first = self.aligned.agg(F.min("date").alias("first"))
        found = capm.network_returns(self.returns, self.config.returns_type, idio).join(F.broadcast(first), F.expr("date >= first"), "left_semi")
        return materialize(found, "network-returns")

    def head(self, frame: DataFrame, n: int = 5) -> DataFrame:
        """The first n rows of a frame by date, and asset or model where it has them: a report, not an input."""
        return frame.orderBy(*(c for c in ("date", "asset", "model") if c in frame.columns)).limit(n)

    @cached_property
    def target(self) -> DataFrame:
        """(date, raw, target) on the market's dates."""
        c = self.config
        return labels.target(self.market.select("date", "mkt_ret"), c.target_variable, c.target_variable_rolling_window, c.quantile_for_dummy, c.data_freq)

    @cached_property
    def aligned(self) -> DataFrame:
        """The calendar with target, raw target and market as of each date, from the first that has a target, and the target to
        predict."""
        dates = panel.calendar(self.returns).select("date")
        frame = panel.cropped(panel.asof(panel.asof(dates, self.target), self.market), "target")
        return labels.led(frame, "target", self.config.forecasting_horizon)

    @cached_property
    def features(self) -> DataFrame:
        """The sixteen features by date and threshold, written once; by tiles where a matrix of all assets is large."""
        make = tiles.features if self.network_returns.select("asset").distinct().count() > TILED_FROM else network.all_features
        return materialize(make(self.network_returns, self.config.lookback_corr, list(self.config.threshold_grid)), "study-features")

    def sample_graph(self, threshold: float | None = None) -> DataFrame:
        """Edges of the date in the middle."""
        pairs = materialize(correlation.rolling_pairs(self.network_returns, self.config.lookback_corr), "study-pairs")
        edge = network.edges(pairs, self.config.threshold_grid[0] if threshold is None else threshold)
        return edge.join(F.broadcast(network.middle_date(pairs)), "date", "left_semi")

    def charts(self, folder: str | None = None) -> dict:
        """Three line charts by name, saved as PNG files where a folder is given: the target to predict with the raw target, the
        target to predict with the market's cumulative return, and that with the raw target."""
        pairs = {"target_and_raw": ("target_to_predict", "raw"), "target_and_market": ("target_to_predict", "cumulative_return"), "market_and_raw": ("cumulative_return", "raw")}
        return {name: charts.line_chart(self.aligned, y, y2, title=name.replace("_", " "), save_to=f"{folder}/{name}.png" if folder else None) for name, (y, y2) in pairs.items()}

    def walk(self, kind: str = "simple", outer: int | None = None, cache_root: str | None = None, features: DataFrame | None = None, metric: str | Callable | None = None, label: str = "") -> walkforward.Result:
        """Walk-forward results, kept under a key of all settings where a cache is given. features (date, threshold, numbers)
        and metric, a name or a function of truth and predictions, take the place of the study's own; label then names them in
        the key."""
        c = self.config
        if cache_root and not label and (features is not None or callable(metric)):
            raise ValueError("features or a metric of one's own need a label to be kept under")
        scheme = walkforward.Scheme(kind, c.lookback_corr, c.inner_train_size, c.inner_val_size, c.target_variable_rolling_window if kind != "nested_expanding" else 0, c.inner_step_size, outer)
        grid = walkforward.Grid(c.models(), list(c.threshold_grid))
        target = self.aligned.select("date", F.col("target_to_predict").alias("y"))
        own = ({"label": label} if label else {}) | ({"metric": metric} if isinstance(metric, str) else {})
        key = c.cache_key(scheme=repr(scheme), root=self.root, asset=self.asset, is_level=self.is_level, **own)
        return cache.cached(self.spark, cache_root, key, lambda: walkforward.run(self.network_returns, self.features if features is None else features, target, scheme, grid, metric or c.scoring_metric), c.load_or_compute_cv == "load", c.save_cv)
