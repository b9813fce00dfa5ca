"""Walk-forward validation: chunks of neighbouring folds are groups whose models a task fits and scores; the best combination
is an aggregate; refits are groups of test dates again. No loop over dates on the driver."""

from __future__ import annotations

import json
import math
from collections.abc import Callable
from dataclasses import dataclass, field
from functools import cached_property

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lattica.functions.series import by
from lattica.operators.folds import best_combination, full_index
from lattica.operators.metrics import oos_metrics, scoring
from lattica.operators.models import BINNED, SCORES, Bins, Predictor, fit
from lattica.operators.panel import calendar
from lattica.sources.tables import materialize


#: Folds, or test dates, next to each other whose rows are sent to one group: a row is copied once a chunk that needs it,
#: not once a fold.
CHUNK = 8
#: Chunks of test dates of an expanding scheme at most. Each needs all rows before it, so rows are copied as often as there are
#: chunks, on average half of them: what is shuffled grows as the calendar, not as its square.
EXPANDING_CHUNKS = 64


@dataclass(frozen=True)
class Scheme:
    """Sizes in rows of the network's calendar. kind: simple (train, then validation, then `horizon` rows, then the test date),
    nested_rolling (inner folds over the `outer` rows up to `horizon` before the test date; refitted on all `outer`
    rows) or nested_expanding (inner folds over all rows before the test date; no horizon). purge_refit also keeps a
    nested refit `horizon` rows away."""

    kind: str
    lookback: int
    train: int
    val: int
    horizon: int = 0
    step: int | None = None
    outer: int | None = None
    purge_refit: bool = False

    def __post_init__(self):
        if self.kind not in ("simple", "nested_rolling", "nested_expanding"):
            raise ValueError(f"unknown scheme {self.kind!r}")
        if self.kind == "nested_rolling" and not self.outer:
            raise ValueError("nested_rolling needs outer")

    @property
    def history(self) -> int:
        """Rows that must stand before a test date."""
        inner = self.lookback + self.train + self.val
        return {"simple": inner + self.horizon, "nested_rolling": max(self.lookback + (self.outer or 0), inner + self.horizon), "nested_expanding": inner}[self.kind]

    @property
    def stride(self) -> int:
        return self.step or self.val

    @property
    def reach(self) -> int | None:
        """From the first to the last start of a test date's inner folds, negative if there is none; None: from the calendar's first
        row on."""
        if self.kind == "nested_expanding":
            return None
        room = 0 if self.kind == "simple" else self.outer - self.horizon - self.train - self.val
        return room // self.stride * self.stride

    def last(self) -> F.Column:
        """Of test row i (from 0): where its last inner fold starts; null without one."""
        i = F.col("i")
        if self.kind == "nested_expanding":
            room = i - self.train - self.val
            return F.when(room >= 0, room - F.pmod(room, F.lit(self.stride)))
        begin = i - self.horizon - self.val - self.train if self.kind == "simple" else i - self.outer
        return begin + self.reach if self.reach >= 0 else F.lit(None).cast("bigint")

    def spans(self, ready: DataFrame) -> DataFrame:
        """(train_start, train_end, val_end): the distinct inner folds of the test rows; a row of the calendar starts one at most."""
        last = ready.select(self.last().alias("last")).where("last IS NOT NULL")
        if self.kind == "nested_expanding":
            starts = last.agg(F.max("last").alias("last")).where("last IS NOT NULL").select(F.explode(F.sequence(F.lit(0).cast("bigint"), "last", F.lit(self.stride).cast("bigint"))).alias("s"))
        else:
            starts = last.select(F.explode(F.sequence(F.col("last") - self.reach, "last", F.lit(self.stride).cast("bigint"))).alias("s")).distinct()
        return starts.select(F.col("s").alias("train_start"), (F.col("s") + self.train).alias("train_end"), (F.col("s") + self.train + self.val).alias("val_end"))

    def refit(self) -> tuple[F.Column, F.Column]:
        i = F.col("i")
        if self.kind == "simple":
            return i - self.horizon - self.val - self.train, i - self.horizon
        end = i - self.horizon if self.purge_refit else i
        return (i - self.outer if self.kind == "nested_rolling" else F.lit(0).cast("bigint")), end


@dataclass(frozen=True)
class Grid:
    """Models by label: (registry name, fixed parameters, list of parameter sets)."""

    models: dict[str, tuple[str, dict, list[dict]]]
    thresholds: list[float] = field(default_factory=lambda: [0.5])

    def rows(self, spark) -> DataFrame:
        found = [
            (label, name, t, i, json.dumps(fixed | theta, sort_keys=True), json.dumps(theta, sort_keys=True), j)
            for label, (name, fixed, thetas) in self.models.items()
            for i, t in enumerate(self.thresholds)
            for j, theta in enumerate(thetas)
        ]
        return spark.createDataFrame(found, "model string, kind string, threshold double, threshold_ord int, parameters string, theta string, theta_ord int")


@dataclass(frozen=True)
class Result:
    predictions: DataFrame
    selection: DataFrame
    metrics: DataFrame


def _rows_of(spans: DataFrame, rows: DataFrame, start: str, end: str) -> DataFrame:
    """The rows that each chunk of spans needs, once a chunk: rows with their chunk."""
    reach = spans.groupBy("chunk").agg(F.min(start).alias("lo"), F.max(end).alias("hi"))
    return reach.select(F.col("chunk").alias("part"), F.explode(F.sequence("lo", F.col("hi") - 1)).alias("i")).join(rows, "i")


class Rows:
    """A group's rows of one threshold, in order of number. Bins are made once, when a model first asks, for all folds of the group."""

    def __init__(self, group: pd.DataFrame):
        self.i, self.x, self.y = group["i"].to_numpy(), np.array(group["x"].tolist()), group["y"].to_numpy()

    @cached_property
    def bins(self) -> Bins:
        return Bins.of(self.x)

    def fit(self, kind: str, rows: np.ndarray | slice, parameters: dict, near: np.ndarray | None = None) -> Predictor:
        return fit(kind, self.x[rows], self.y[rows], parameters, near, self.bins.take(rows) if kind in BINNED else None)


def _by_threshold(group: pd.DataFrame) -> dict[float, Rows]:
    return {t: Rows(g) for t, g in group.sort_values("i").groupby("threshold")}


def refit_chunk(scheme: Scheme, n_dates: int) -> int:
    """Test dates of a chunk of refits, on a calendar of so many dates."""
    return max(CHUNK, math.ceil(n_dates / EXPANDING_CHUNKS)) if scheme.kind == "nested_expanding" else CHUNK


def majority(spans: DataFrame, labels: DataFrame, dates: DataFrame) -> DataFrame:
    """date, model, y_true, y_pred, n_obs of spans (date, i, model, start, end): the most frequent label of the calendar's numbers from
    start to end, the lesser one of a tie, from counts up to either. Features play no part, neither on the test date nor before. Dates
    without a label, and spans without one, have no row. labels is (date, y), a row a date at most."""
    upto = by(order="i").rowsBetween(Window.unboundedPreceding, -1)
    label = dates.join(labels.where("y IS NOT NULL"), "date", "left")
    counts = label.select("i", "y", F.count("y").over(upto).alias("n"), F.coalesce(F.sum((F.col("y") == 1).cast("long")).over(upto), F.lit(0)).alias("pos"))
    at = lambda name: counts.select(F.col("i").alias(name), F.col("n").alias(f"n_{name}"), F.col("pos").alias(f"pos_{name}"))
    n, pos = F.col("n_end") - F.col("n_start"), F.col("pos_end") - F.col("pos_start")
    own = counts.where("y IS NOT NULL").select("i", F.col("y").cast("int").alias("y_true"))
    found = spans.join(own, "i").join(at("start"), "start").join(at("end"), "end").where(n > 0)
    return found.select("date", "model", "y_true", (2 * pos > n).cast("double").alias("y_pred"), n.cast("long").alias("n_obs"))


def run(returns: DataFrame, feature: DataFrame, target: DataFrame, scheme: Scheme, grid: Grid, metric: str | Callable = "pr_auc", test_dates: DataFrame | None = None) -> Result:
    """Predictions of target (date, y) from feature (date, threshold, numbers) for the test dates of the calendar of returns, by
    default all that have the history.

    Rows with a null feature or y are left out, so dates of edgeless networks are. A test date without them is skipped. One
    for which no combination has a score is predicted by the majority of all labels of its refit range, whether or not it or
    they have features. The simple scheme gives every pair of test date and model a row. Inner folds that several test dates
    share are fitted once, and each date takes the mean over its own, to twelve decimals, so that equal scores tie whatever
    their order. Refits of neighbouring dates start from each other's
    weights. metric is a name, or a function of (y, p), arrays of a fold's validation rows, where NaN is no score. Results are
    sorted by date and model.
    """
    score_of = SCORES[scoring(metric)] if isinstance(metric, str) else scoring(metric)
    spark = returns.sparkSession
    names = [c for c in feature.columns if c not in ("date", "threshold")]
    dates = calendar(returns).withColumn("i", F.col("ord") - 1).drop("ord")
    rows = feature.join(target.select("date", F.col("y").cast("int").alias("y")), "date").dropna(subset=[*names, "y"]).join(F.broadcast(dates), "date")
    rows = materialize(rows.select("i", "threshold", "y", F.array(*(F.col(c).cast("double") for c in names)).alias("x")), "walk-rows")
    tests = dates if test_dates is None else dates.join(test_dates.select("date"), "date", "left_semi")
    ready = tests.join(F.broadcast(returns.select("date").distinct()), "date", "left_semi").join(target.select("date"), "date", "left_semi").where(F.col("i") >= scheme.history)
    ready = ready.where(scheme.last().isNotNull())  # without an inner fold there is neither a choice nor a fallback
    combos = grid.rows(spark)

    own = ["train_start", "train_end", "val_end"]
    plan = [(r["model"], r["kind"], r["threshold"], r["threshold_ord"], r["parameters"], r["theta"], r["theta_ord"]) for r in combos.collect()]  # the grid, a configuration

    def scores(_, fold: pd.DataFrame, group: pd.DataFrame) -> pd.DataFrame:
        out = []
        columns = [*own, "model", "threshold", "threshold_ord", "theta", "theta_ord", "kind", "parameters", "score"]
        parts = _by_threshold(group)
        for start, split, end in fold[own].itertuples(index=False):
            for model, kind, threshold, t_ord, parameters, theta, j in plan:
                if threshold not in parts:
                    continue
                part = parts[threshold]
                a, b, c = np.searchsorted(part.i, [start, split, end])
                if a < b < c:
                    p = part.fit(kind, slice(a, b), json.loads(parameters))(part.x[b:c])
                    out.append((start, split, end, model, threshold, t_ord, theta, j, kind, parameters, score_of(part.y[b:c], p)))
        return pd.DataFrame(out, columns=columns).astype({"score": float})

    spans = materialize(scheme.spans(ready).withColumn("chunk", F.floor(F.col("train_start") / CHUNK)), "walk-spans")
    near = _rows_of(spans, rows, "train_start", "val_end")
    scored = spans.groupBy("chunk").cogroup(near.groupBy("part")).applyInPandas(scores, "train_start long, train_end long, val_end long, model string, threshold double, threshold_ord int, theta string, theta_ord int, kind string, parameters string, score double")
    scored = scored.withColumn("score", F.when(~F.isnan("score"), F.col("score")))
    scored = materialize(scored, "walk-scores")
    # A test date's mean is that over a range of starts, one stride apart, up to its last one: a row for each start and combination
    # holds it, so test dates don't meet all their folds.
    combination = ["model", "threshold_ord", "theta_ord"]
    every = spans.select("train_start").crossJoin(F.broadcast(combos)).join(scored.select("train_start", *combination, "score"), ["train_start", *combination], "left")
    line = Window.partitionBy(*combination, F.col("train_start") % scheme.stride).orderBy("train_start")
    over = line.rangeBetween(Window.unboundedPreceding if scheme.reach is None else -max(scheme.reach, 0), 0)
    means = every.withColumn("score", F.round(F.avg("score").over(over), 12)).where("score IS NOT NULL")
    mean = ready.select("date", scheme.last().alias("train_start")).join(means, "train_start").drop("train_start")
    best = materialize(best_combination(mean, ["date", "model"], ["threshold_ord", "theta_ord"]), "walk-best")

    start, end = scheme.refit()
    models = combos.select("model").distinct()
    refits = ready.withColumns({"start": start, "end": end})
    chunk = refit_chunk(scheme, dates.count())
    span = refits.join(best, "date").withColumns({"last": F.greatest(F.col("end"), F.col("i") + 1), "chunk": F.floor(F.col("i") / chunk)})
    span = span.select("chunk", "date", "i", "model", "kind", "parameters", "threshold", "start", "end", "last")

    def predict(_, wanted: pd.DataFrame, group: pd.DataFrame) -> pd.DataFrame:
        out = []
        parts = _by_threshold(group)
        near: dict[tuple, np.ndarray] = {}
        for r in wanted.sort_values(["model", "i"]).itertuples(index=False):
            if r.threshold not in parts:
                continue
            part = parts[r.threshold]
            test = np.searchsorted(part.i, r.i)
            train = np.arange(*np.searchsorted(part.i, [r.start, r.end]))
            if test == len(part.i) or part.i[test] != r.i:
                continue
            train = train[train != test]
            if len(train):
                key = (r.kind, r.parameters, r.threshold)
                model = part.fit(r.kind, train, json.loads(r.parameters), near.get(key))
                near[key] = getattr(model, "weights", None)
                out.append((r.date, r.model, int(part.y[test]), float(model(part.x[test : test + 1])[0]), len(train)))
        return pd.DataFrame(out, columns=["date", "model", "y_true", "y_pred", "n_obs"])

    found = span.groupBy("chunk").cogroup(_rows_of(span, rows, "start", "last").groupBy("part")).applyInPandas(predict, "date date, model string, y_true int, y_pred double, n_obs long")
    unscored = refits.crossJoin(models).join(best.select("date", "model"), ["date", "model"], "left_anti")
    found = found.unionByName(majority(unscored, target.select("date", "y"), dates))
    found = materialize(found.join(best.select("date", "model", "threshold", "theta", "score"), ["date", "model"], "left"), "walk-found")
    name = "validation_score" if scheme.kind == "simple" else "inner_cv_score"
    predictions = found.select(
        "date", "model", "y_true", "y_pred", (F.col("y_pred") >= 0.5).cast("int").alias("y_pred_binary"), F.col("threshold").alias("best_threshold"), F.col("score").alias(name)
    )
    theta = F.from_json("theta", "map<string,string>").alias("best_theta")
    at = ready.select("date", "i", start.alias("refit_start"), end.alias("refit_end"))
    selection = found.join(at, "date").select("date", "model", F.lit(scheme.kind).alias("scheme"), "refit_start", "refit_end", F.col("threshold").alias("best_threshold"), theta, F.col("score").alias(name), F.col("n_obs").alias("n_refit_obs"))
    metrics = oos_metrics(predictions)
    if scheme.kind == "simple":
        predictions = full_index(tests, models, predictions)
        selection = full_index(tests, models, selection)
    else:
        predictions, selection = predictions.drop("model"), selection.drop("model")
    order = [c for c in ("date", "model") if c in predictions.columns]
    return Result(predictions.orderBy(*order), selection.orderBy(*order), metrics)


def describe(predictions: DataFrame, score: str) -> DataFrame:
    """count, mean, sample deviation, least, quartiles and greatest of a score column: one row."""
    s = F.col(score)
    return predictions.agg(
        F.count(s).alias("n"), F.avg(s).alias("mean"), F.stddev_samp(s).alias("std"), F.min(s).alias("min"), F.percentile(s, F.lit(0.25)).alias("q25"),
        F.percentile(s, F.lit(0.5)).alias("q50"), F.percentile(s, F.lit(0.75)).alias("q75"), F.max(s).alias("max"),
    )
