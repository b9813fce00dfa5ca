"""Hand-made fixtures, one for each rule that is easily got wrong."""

import datetime as dt

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from lattica.functions import series as S
from lattica.operators import capm, components, correlation, folds, labels, metrics, models, network, panel, tiles, walkforward
from lattica.plans import catalogue
from lattica.sources import cache
from lattica.sources import panel as source
from lattica.sources.config import Config, key_of, registry
from lattica.sources.tables import nan_to_null
from tests.compare import SF, TABLES, duck, key

DAY = dt.date(2020, 1, 1)


def days(n, first=0):
    return [DAY + dt.timedelta(first + i) for i in range(n)]


def series(spark, values, name="x"):
    return spark.createDataFrame(list(zip(days(len(values)), values)), f"date date, {name} double")


def column(df, name):
    return [r[name] for r in df.orderBy("date").collect()]


def near(a, b):
    return len(a) == len(b) and all((x is None) == (y is None) and (x is None or abs(x - y) < 1e-9) for x, y in zip(a, b))


def test_changes_of_levels(spark):
    df = series(spark, [100.0, 110.0, 99.0, None, 120.0, 120.0])
    assert near(column(df.select("date", S.lagged_change("x").alias("r")), "r"), [None, 0.1, -0.1, None, None, 0.0])


def test_bounded_fill(spark):
    df = series(spark, [1.0, None, None, None, 2.0, None])
    assert column(df.select("date", S.bounded_fill("x", 2).alias("y")), "y") == [1, 1, 1, None, 2, 2]
    assert column(df.select("date", S.bounded_fill("x", None).alias("y")), "y") == [1, 1, 1, 1, 2, 2]


def test_forward_drawdown_starts_at_the_first_value(spark):
    r = [0.5, -0.1, 0.2, -0.3, 0.1, -0.2, 0.0, 0.1]
    got = column(series(spark, r).select("date", S.forward_max_drawdown("x", 3).alias("d")), "d")
    want = []
    for t in range(len(r)):
        part = r[t + 1 : t + 4]
        g = np.cumprod(1 + np.array(part))
        want.append(float((g / np.maximum.accumulate(g) - 1).min()) if len(part) == 3 else None)
    assert near(got, want)
    made = labels.labelled(series(spark, r, "mkt_ret").select("date", S.forward_max_drawdown("mkt_ret", 3).alias("raw")), 3, 0.5)
    assert [x for x in column(made, "label")[-3:]] == [0, 0, 0]


def test_unknown_names_raise(spark):
    with pytest.raises(ValueError):
        labels.target(series(spark, [0.1], "mkt_ret"), "dummy_nothing", 2, 0.1)
    with pytest.raises(KeyError):
        S.realized_volatility("x", 3, "q")
    with pytest.raises(ValueError):
        metrics.scoring("accuracy")
    with pytest.raises(ValueError):
        walkforward.Scheme("other", 1, 1, 1)
    with pytest.raises(ValueError):
        walkforward.Scheme("nested_rolling", 1, 1, 1)


def test_asof_keeps_a_rows_nulls(spark):
    left = spark.createDataFrame([(d,) for d in (days(10)[i] for i in (0, 4, 9))], "date date")
    right = spark.createDataFrame([(days(10)[0], 1.0), (days(10)[3], None), (days(10)[6], 3.0)], "date date, v double")
    assert column(panel.asof(left, right), "v") == [1.0, None, 3.0]
    assert column(panel.asof(left, right.where("date > '2020-01-02'")), "v") == [None, None, 3.0]


def test_last_of_duplicates(spark):
    df = spark.createDataFrame([(DAY, 1, 5.0), (DAY, 3, 7.0), (DAY, 2, 6.0), (days(2)[1], 1, None)], "date date, seq int, v double")
    assert column(panel.keep_last(df), "v") == [7.0, None]
    assert panel.duplicates(df.select("date", F.lit(1).alias("asset"))).count() == 1


def returns_of(spark, matrix):
    rows = [(d, a, None if np.isnan(v) else float(v)) for d, line in zip(days(len(matrix)), matrix) for a, v in enumerate(line)]
    return spark.createDataFrame(rows, "date date, asset bigint, ret double")


def brute_pairs(matrix, lookback):
    out = {}
    for t in range(lookback, len(matrix)):
        w = matrix[t - lookback : t]
        ok = [a for a in range(w.shape[1]) if not np.isnan(w[:, a]).any() and w[:, a].max() != w[:, a].min()]
        for i, a in enumerate(ok):
            for b in ok[i + 1 :]:
                out[days(len(matrix))[t], a, b] = np.corrcoef(w[:, a], w[:, b])[0, 1]
    return out


@pytest.fixture(scope="module")
def matrix():
    rng = np.random.default_rng(11)
    x = rng.normal(size=(40, 6)) * 0.02 + rng.normal(size=(40, 1)) * 0.02
    x[7, 1] = np.nan  # inside windows
    x[20, 2] = np.nan  # on a date, and in the windows after it
    x[10:30, 3] = 0.01  # constant for a while
    return x


def test_correlations_use_rows_before_the_date(spark, matrix):
    got = {(r.date, r.a1, r.a2): r.rho for r in correlation.rolling_pairs(returns_of(spark, matrix), 8).collect()}
    want = brute_pairs(matrix, 8)
    assert set(got) == set(want) and all(abs(got[k] - v) < 1e-5 for k, v in want.items())
    assert (days(40)[20], 0, 2) in got  # no value on the date itself is needed


def test_one_date_alone(spark, matrix):
    rows = correlation.on_date(returns_of(spark, matrix), str(days(40)[15]), 8).collect()
    want = {k: v for k, v in brute_pairs(matrix, 8).items() if k[0] == days(40)[15]}
    assert len(rows) == len(want) and all(abs(r.rho - want[r.date, r.a1, r.a2]) < 1e-5 for r in rows)
    assert correlation.on_date(returns_of(spark, matrix), "1999-01-01", 8).count() == 0


def test_both_paths_agree_and_look_only_back(spark, matrix):
    returns = returns_of(spark, matrix)
    pairs = {r.date: r for r in network.features(returns, 8, 0.4).collect()}
    chunks = {r.date: r for r in network.all_features(returns, 8, [0.4], chunk=7).collect()}
    assert set(pairs) == set(chunks) and len(pairs) == 32
    for d, r in pairs.items():
        for c in network.FEATURES[:-2]:
            a, b = r[c], chunks[d][c]
            assert (a is None and b is None) or abs(a - b) < 1e-4, (d, c, a, b)
        assert 0 <= r.density <= 1 and 1 - 1e-6 <= chunks[d].eig1 <= r.n_nodes + 1e-6 and (r.lcc_ratio is None) == (r.n_edges == 0)
    later = matrix.copy()
    later[25:] += 1
    changed = {r.date: r for r in network.all_features(returns_of(spark, later), 8, [0.4], chunk=7).collect()}
    assert all(changed[d] == chunks[d] for d in days(26)[8:])


@pytest.mark.parametrize("chunk", [None, 7])
@pytest.mark.parametrize("least", [None, 5])
def test_eigenvalues_equal_numpy(spark, matrix, chunk, least):
    got = {r.date: r for r in correlation.eigen(returns_of(spark, matrix), 8, chunk, least).collect()}
    want = {}
    for t in range(8, len(matrix)):
        w = matrix[t - 8 : t]
        ok = [a for a in range(w.shape[1]) if not np.isnan(w[:, a]).any() and w[:, a].max() != w[:, a].min()]
        if len(ok) >= (least or 2):
            values = np.linalg.eigvalsh(np.corrcoef(w[:, ok].T))
            want[days(len(matrix))[t]] = (values[-1], values[-1] / len(ok))
    assert set(got) == set(want) and (least is None or 0 < len(want) < 32)
    assert all(abs(got[d].eig1 - a) < 1e-4 and abs(got[d].eig1_ratio - b) < 1e-4 for d, (a, b) in want.items())


@pytest.mark.parametrize("least", [3, 6])
def test_least_number_of_assets(spark, matrix, least):
    pairs = brute_pairs(matrix, 8)
    size = {}
    for d, a, b in pairs:
        size.setdefault(d, set()).update((a, b))
    want = {k for k in pairs if len(size[k[0]]) >= least}
    got = {(r.date, r.a1, r.a2) for r in correlation.rolling_pairs(returns_of(spark, matrix), 8, least).collect()}
    assert got == want and want and (least == 3 or len(want) < len(pairs))


def graph(spark, nodes, edges):
    node = spark.createDataFrame([(DAY, a) for a in nodes], "date date, asset bigint")
    edge = spark.createDataFrame([(DAY, a, b, w) for a, b, w in edges], "date date, a1 bigint, a2 bigint, weight float")
    return node, edge


def test_triangle_with_a_negative_edge(spark):
    node, edge = graph(spark, [1, 2, 3, 4], [(1, 2, 0.8), (1, 3, -0.9), (2, 3, 0.6)])
    c = network.clustering(node, edge).first().clustering
    scale = np.float32(0.8).astype(float)
    one = np.cbrt(float(np.float32(0.8)) * float(np.float32(-0.9)) * float(np.float32(0.6)) / scale**3)
    assert abs(c - 3 * one / 4) < 1e-9
    d = network.degrees(node, edge).first()
    assert (d.n_nodes, d.n_edges) == (4, 3) and abs(d.density - 0.5) < 1e-12 and abs(d.avg_weighted_degree - 0.25) < 1e-6


def test_edgeless_and_two_components(spark):
    node, edge = graph(spark, [1, 2, 3], [])
    assert network.lcc(node, edge).first().lcc_ratio is None and network.clustering(node, edge).first().clustering == 0
    w = network.edge_weights(node, edge).first()
    assert (w.avg_edge_weight, w.std_edge_weight, w.max_edge_weight) == (0, 0, 0)
    node, edge = graph(spark, [1, 2, 3, 4, 5], [(1, 2, 0.9), (2, 3, 0.9), (1, 3, 0.9), (4, 5, 0.9)])
    assert network.lcc(node, edge).first().lcc_ratio == 0.6


def test_threshold_is_compared_as_float(spark):
    pairs = spark.createDataFrame([(DAY, 1, 2, 0.75), (DAY, 1, 3, 0.8), (DAY, 2, 3, -0.8)], "date date, a1 bigint, a2 bigint, rho float")
    assert network.edges(pairs, 0.8).count() == 2 and network.edges(pairs, 0.75).count() == 3
    assert network.edges(pairs, 0.8, absolute=False).count() == 1
    assert {r.weight > 0 for r in network.edges(pairs, 0.8, keep_sign=False).collect()} == {True}


@pytest.mark.parametrize("step", [2, None])
def test_folds(spark, step):
    dates = panel.calendar(spark.createDataFrame([(d,) for d in days(10)], "date date"))
    rows = folds.rolling_folds(dates, 4, 2, step).orderBy("fold_id").collect()
    assert [r.train_start - 1 for r in rows] == [0, 2, 4] and all(r.train_end + 1 == r.val_start for r in rows)
    assert folds.rolling_folds(dates, 9, 2).count() == 0
    with pytest.raises(ValueError):
        folds.rolling_folds(dates, 4, 2, 0)


def test_ties_of_scores_and_of_the_grid(spark):
    y = np.array([1, 0, 1, 0, 1, 0, 0, 1])
    p = np.array([0.9, 0.9, 0.8, 0.4, 0.4, 0.4, 0.2, 0.1])
    df = spark.createDataFrame([("m", int(a), float(b), int(b >= 0.5)) for a, b in zip(y, p)] + [("one", 1, 0.3, 0), ("none", None, None, None)], "model string, y_true int, y_pred double, y_pred_binary int")
    got = {r.model: r for r in metrics.oos_metrics(df).collect()}
    auc = np.mean([(a > b) + 0.5 * (a == b) for a in p[y == 1] for b in p[y == 0]])
    assert abs(got["m"].roc_auc - auc) < 1e-12 and abs(got["m"].pr_auc - models.average_precision(y, p)) < 1e-12
    assert abs(models.roc_auc(y, p) - auc) < 1e-12
    assert got["one"].roc_auc is None and got["one"].precision == 0 and got["none"].f1 is None and got["none"].neg_brier_score is None
    grid = spark.createDataFrame([("a", 0, 1, 0.5), ("a", 0, 0, 0.5), ("a", 1, 0, None), ("b", 0, 0, None)], "model string, t int, j int, score double")
    best = folds.best_combination(grid, ["model"], ["t", "j"]).collect()
    assert [(r.model, r.t, r.j) for r in best] == [("a", 0, 0)]


def test_logistic_regression_is_a_stationary_point():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(60, 3))
    y = (x[:, 0] + rng.normal(size=60) > 0.8).astype(int)
    fit = models.logistic_regression(x, y, C=0.7, class_weight="balanced")
    grid = np.vstack([np.zeros(3), np.eye(3)])
    odds = np.log(fit(grid) / (1 - fit(grid)))
    w = np.r_[odds[1:] - odds[0], odds[0]]
    sign, weight = np.where(y == 1, 1, -1), np.where(y == 1, 60 / (2 * y.sum()), 60 / (2 * (60 - y.sum())))
    design = np.column_stack([x, np.ones(60)])
    gradient = w - 0.7 * design.T @ (weight * sign / (1 + np.exp(sign * (design @ w))))
    assert np.abs(gradient).max() < 1e-6
    assert models.fit("LogisticRegression", x, np.zeros(60), {})(x[:2]).tolist() == [0, 0]
    for kind in ("RandomForestClassifier", "GradientBoostingClassifier"):
        assert models.roc_auc(y, models.fit(kind, x, y, {"n_estimators": 20, "max_depth": 3})(x)) > 0.85


def brute_majority(labels):
    """The most frequent label, 0 on ties; None without one."""
    known = [v for v in labels if v is not None]
    return float(2 * sum(known) > len(known)) if known else None


def brute_walk(dates, x, y, scheme, thetas, metric):
    """Simple scheme by loops: {date: (y, p, score, refit rows)}. Without a score, the majority of all labels of the refit range."""
    out = {}
    index = {d: i for i, d in enumerate(dates)}
    for d in dates[scheme.history :]:
        i = index[d]
        rows = lambda a, b: [k for k in range(a, b) if dates[k] in x and y[dates[k]] is not None]  # noqa: B023,E731
        end = i - scheme.horizon
        train, val = rows(end - scheme.val - scheme.train, end - scheme.val), rows(end - scheme.val, end)
        best = None
        for theta in thetas:
            get = lambda r: (np.array([x[dates[k]] for k in r]), np.array([y[dates[k]] for k in r]))
            if not train or not val:
                continue
            s = models.SCORES[metric](get(val)[1], models.fit("LogisticRegression", *get(train), theta)(get(val)[0]))
            if s is not None and (best is None or s > best[0]):
                best = (s, theta)
        if best and d in x and y[d] is not None:
            xs, ys = get(rows(end - scheme.val - scheme.train, end))
            out[d] = (y[d], float(models.fit("LogisticRegression", xs, ys, best[1])(np.array([x[d]]))[0]), best[0], len(ys))
        elif not best and y[d] is not None:
            labels = [y[dates[k]] for k in range(end - scheme.val - scheme.train, end)]
            if (p := brute_majority(labels)) is not None:
                out[d] = (y[d], p, None, sum(v is not None for v in labels))
    return out


def test_simple_walk_equals_loops_and_caches(spark, tmp_path):
    rng = np.random.default_rng(8)
    dates = days(60)
    x = {d: rng.normal(size=2) for i, d in enumerate(dates) if i >= 6 and i % 11}
    y = {d: int(rng.random() < 0.4) for d in dates}
    returns = spark.createDataFrame([(d, 1, 0.0) for d in dates], "date date, asset bigint, ret double")
    feature = spark.createDataFrame([(d, 0.5, *map(float, v)) for d, v in x.items()], "date date, threshold double, f double, g double")
    target = spark.createDataFrame(list(y.items()), "date date, y int")
    scheme = walkforward.Scheme("simple", 6, 20, 8, 2)
    thetas = [{"C": 0.1}, {"C": 10.0}]
    grid = walkforward.Grid({"m": ("LogisticRegression", {}, thetas)}, [0.5])
    result = walkforward.run(returns, feature, target, scheme, grid, "roc_auc")
    want = brute_walk(dates, x, y, scheme, thetas, "roc_auc")
    rows = {r.date: r for r in result.predictions.collect()}
    assert len(rows) == 60
    for d, r in rows.items():
        if d in want:
            assert r.y_true == want[d][0] and abs(r.y_pred - want[d][1]) < 1e-6
            assert (r.validation_score is None) == (want[d][2] is None) and (want[d][2] is None or abs(r.validation_score - want[d][2]) < 1e-9)
        else:
            assert r.y_pred is None
    key = key_of({"a": 1})
    made = cache.cached(spark, str(tmp_path), key, lambda: result)
    again = cache.cached(spark, str(tmp_path), key, lambda: pytest.fail("computed twice"))
    assert again.predictions.count() == made.predictions.count() == 60 and cache.load(spark, str(tmp_path), "other") is None


def brute_nested(dates, x, y, scheme, thetas, score):
    """Nested schemes by loops: {date: (y, p, mean score, refit rows)}."""
    out = {}
    for i in range(scheme.history, len(dates)):
        rolling = scheme.kind == "nested_rolling"
        begin, end = (i - scheme.outer, i - scheme.horizon) if rolling else (0, i)
        if begin + scheme.train + scheme.val > end:
            continue
        rows = lambda a, b: [k for k in range(a, b) if dates[k] in x and y[dates[k]] is not None]
        get = lambda r: (np.array([x[dates[k]] for k in r]), np.array([y[dates[k]] for k in r]))
        best = None
        for theta in thetas:
            found, s = [], begin
            while s + scheme.train + scheme.val <= end:
                train, val = rows(s, s + scheme.train), rows(s + scheme.train, s + scheme.train + scheme.val)
                if train and val:
                    found.append(score(get(val)[1], models.fit("LogisticRegression", *get(train), theta)(get(val)[0])))
                s += scheme.step or scheme.val
            found = [v for v in found if v is not None]
            if found and (best is None or np.mean(found) > best[0] + 1e-12):
                best = (np.mean(found), theta)
        refit = range(i - scheme.outer if rolling else 0, i)
        if best and dates[i] in x and y[dates[i]] is not None:
            out[dates[i]] = (y[dates[i]], float(models.fit("LogisticRegression", *get(rows(refit[0], i)), best[1])(np.array([x[dates[i]]]))[0]), best[0], len(rows(refit[0], i)))
        elif not best and y[dates[i]] is not None:
            labels = [y[dates[k]] for k in refit]
            if (p := brute_majority(labels)) is not None:
                out[dates[i]] = (y[dates[i]], p, None, sum(v is not None for v in labels))
    return out


@pytest.mark.parametrize("scheme", [walkforward.Scheme("nested_rolling", 6, 14, 6, 2, step=3, outer=30), walkforward.Scheme("nested_expanding", 6, 14, 6, step=5), walkforward.Scheme("nested_expanding", 6, 14, 6)])
@pytest.mark.parametrize("metric", ["roc_auc", lambda y, p: -float(np.mean((y - p) ** 2))])
def test_nested_walks_equal_loops(spark, scheme, metric):
    rng = np.random.default_rng(9)
    dates = days(48)
    x = {d: rng.normal(size=2) for i, d in enumerate(dates) if i >= 6 and i % 11}
    y = {d: int(rng.random() < 0.4 + 0.2 * (x[d][0] > 0 if d in x else 0)) for d in dates}
    returns = spark.createDataFrame([(d, 1, 0.0) for d in dates], "date date, asset bigint, ret double")
    feature = spark.createDataFrame([(d, 0.5, *map(float, v)) for d, v in x.items()], "date date, threshold double, f double, g double")
    thetas = [{"C": 0.1}, {"C": 10.0}]
    grid = walkforward.Grid({"m": ("LogisticRegression", {}, thetas)}, [0.5])
    result = walkforward.run(returns, feature, spark.createDataFrame(list(y.items()), "date date, y int"), scheme, grid, metric)
    want = brute_nested(dates, x, y, scheme, thetas, models.SCORES[metric] if isinstance(metric, str) else metric)
    got = result.predictions.collect()
    assert [r.date for r in got] == sorted(want) and want
    for r in got:
        assert r.y_true == want[r.date][0] and abs(r.y_pred - want[r.date][1]) < 1e-6 and abs(r.inner_cv_score - want[r.date][2]) < 1e-9


SCHEMES = [
    walkforward.Scheme("simple", 4, 8, 3, 1), walkforward.Scheme("nested_rolling", 4, 6, 3, 2, step=3, outer=14), walkforward.Scheme("nested_rolling", 4, 6, 3, outer=14),
    walkforward.Scheme("nested_expanding", 4, 6, 3, step=3), walkforward.Scheme("nested_expanding", 4, 6, 3, step=2), walkforward.Scheme("nested_rolling", 4, 6, 3, 2, step=1, outer=14),
]


@pytest.mark.parametrize("scheme", SCHEMES)
def test_walks_through_edgeless_dates_equal_loops(spark, scheme):
    """Features on the first 14 of 40 dates and on four near the end; labels with gaps. Where no combination has a score, labels alone
    decide, whether or not a date has features."""
    rng = np.random.default_rng(12)
    dates = days(40)
    x = {d: rng.normal(size=2) for i, d in enumerate(dates) if 2 <= i < 14 or i in (25, 26, 36, 38)}
    y = {d: None if i in (7, 20, 21, 33) else int(rng.random() < 0.55) for i, d in enumerate(dates)}
    returns = spark.createDataFrame([(d, 1, 0.0) for d in dates], "date date, asset bigint, ret double")
    feature = spark.createDataFrame([(d, 0.5, *map(float, v)) for d, v in x.items()], "date date, threshold double, f double, g double")
    thetas = [{"C": 0.1}, {"C": 10.0}]
    grid = walkforward.Grid({"m": ("LogisticRegression", {}, thetas)}, [0.5])
    result = walkforward.run(returns, feature, spark.createDataFrame(list(y.items()), "date date, y int"), scheme, grid, "roc_auc")
    want = brute_walk(dates, x, y, scheme, thetas, "roc_auc") if scheme.kind == "simple" else brute_nested(dates, x, y, scheme, thetas, models.SCORES["roc_auc"])
    got = {r.date: r for r in result.predictions.where("y_pred IS NOT NULL").collect()}
    picked = {r.date: r for r in result.selection.where("n_refit_obs IS NOT NULL").collect()}
    assert set(got) == set(picked) == set(want)
    for d, (truth, p, score, n) in want.items():
        assert got[d].y_true == truth and abs(got[d].y_pred - p) < 1e-6 and picked[d].n_refit_obs == n
        assert (got[d].best_threshold is None) == (score is None)
    assert sum(w[2] is None for w in want.values()) >= (10 if scheme.kind == "simple" else 0) and len(want) > 3
    assert scheme.kind != "simple" or any(d not in x for d in want)


def test_a_scheme_without_room_for_a_fold_predicts_nothing(spark):
    dates = days(40)
    returns = spark.createDataFrame([(d, 1, 0.0) for d in dates], "date date, asset bigint, ret double")
    feature = spark.createDataFrame([(d, 0.5, float(i % 3)) for i, d in enumerate(dates)], "date date, threshold double, f double")
    target = spark.createDataFrame([(d, i % 2) for i, d in enumerate(dates)], "date date, y int")
    grid = walkforward.Grid({"m": ("LogisticRegression", {}, [{}])}, [0.5])
    for scheme, n in ((walkforward.Scheme("nested_rolling", 4, 6, 3, 2, outer=10), 0), (walkforward.Scheme("nested_rolling", 4, 6, 3, 2, outer=11), 25)):
        assert walkforward.run(returns, feature, target, scheme, grid, "roc_auc").predictions.count() == n


def test_majorities_need_no_features(spark):
    dates = panel.calendar(spark.createDataFrame([(d,) for d in days(12)], "date date")).withColumn("i", F.col("ord") - 1).drop("ord")
    label = [1, 1, 0, None, 0, 0, 1, None, None, 1, 1, 0]
    labels = spark.createDataFrame(list(zip(days(12), label)), "date date, y int")
    spans = [(i, a, b) for i in range(12) for a in range(i + 1) for b in range(a, i + 1)]
    df = spark.createDataFrame(spans, "i bigint, start bigint, end bigint").join(dates, "i").withColumn("model", F.concat_ws("-", "start", "end"))
    got = {(r.date, r.model): (r.y_true, r.y_pred, r.n_obs) for r in walkforward.majority(df, labels, dates).collect()}
    want = {}
    for i, a, b in spans:
        known = [v for v in label[a:b] if v is not None]
        if known and label[i] is not None:
            want[days(12)[i], f"{a}-{b}"] = (label[i], brute_majority(known), len(known))
    assert got == want


def test_rows_of_expanding_refits_grow_with_the_calendar():
    scheme = walkforward.Scheme("nested_expanding", 4, 6, 3)
    copied = {}
    for n in (1_000, 10_000, 100_000):
        chunk = walkforward.refit_chunk(scheme, n)
        copied[n] = sum(min(n, (k + 1) * chunk) for k in range(-(-n // chunk))) / n
    assert copied[1_000] <= 33 and copied[100_000] < 33.5 and copied[100_000] < 1.1 * copied[1_000]
    assert walkforward.refit_chunk(walkforward.Scheme("simple", 4, 6, 3), 10**6) == walkforward.CHUNK


def test_a_start_nearby_changes_no_fit():
    rng = np.random.default_rng(3)
    x, near = rng.normal(size=(300, 4)), None
    y = (x[:, 0] - x[:, 1] + rng.normal(size=300) > 0.5).astype(int)
    for n in range(40, 300, 20):
        cold = models.logistic_regression(x[:n], y[:n], C=3.0, class_weight="balanced")
        warm = models.logistic_regression(x[:n], y[:n], C=3.0, class_weight="balanced", start=near)
        assert np.abs(cold(x) - warm(x)).max() < 1e-7
        near = warm.weights
    assert np.abs(models.logistic_regression(x, y, start=np.full(5, 40.0))(x) - models.logistic_regression(x, y)(x)).max() < 1e-7


def brute_tree(x, y, w, depth, leaf, value):
    """A tree by trying every split of every column: nested tuples (column, bound, left, right) or a value."""
    if depth == 0 or len(y) < 2 * leaf or len(set(y)) == 1:
        return value(x, y, w)

    def loss(m):
        mean = (w[m] * y[m]).sum() / w[m].sum()
        return float((w[m] * (y[m] - mean) ** 2).sum())

    whole, best = loss(np.ones(len(y), bool)), None
    for c in range(x.shape[1]):
        at = sorted(set(x[:, c]))
        for a, b in zip(at, at[1:]):
            left = x[:, c] <= (a + b) / 2
            if min(left.sum(), (~left).sum()) >= leaf:
                gain = whole - loss(left) - loss(~left)
                if gain > 1e-12 and (best is None or gain > best[0] + 1e-12):
                    best = (gain, c, (a + b) / 2, left)
    if best is None:
        return value(x, y, w)
    _, c, bound, left = best
    return c, bound, *(brute_tree(x[m], y[m], w[m], depth - 1, leaf, value) for m in (left, ~left))


def brute_value(tree, row):
    while isinstance(tree, tuple):
        tree = tree[2] if row[tree[0]] <= tree[1] else tree[3]
    return tree


@pytest.mark.parametrize("balanced", [None, "balanced"])
def test_a_forest_of_one_tree_is_the_brute_force_tree(balanced):
    rng = np.random.default_rng(5)
    x = rng.integers(0, 12, (60, 3)).astype(float)
    y = (x[:, 0] + x[:, 1] * (x[:, 2] > 5) + rng.normal(size=60) * 3 > 9).astype(int)
    w = np.ones(60) if balanced is None else np.where(y == 1, 30 / y.sum(), 30 / (60 - y.sum()))
    for depth, leaf in ((2, 1), (4, 3), (None, 1)):
        tree = brute_tree(x, y, w, -1 if depth is None else depth, leaf, lambda x, y, w: float((y * w).sum() / w.sum()))
        mine = models.random_forest(x, y, 1, depth, leaf, max_features=None, bootstrap=False, class_weight=balanced)
        grid = rng.uniform(-1, 13, (200, 3))
        assert np.allclose(mine(grid), [brute_value(tree, row) for row in grid])
    forest = models.random_forest(x, y, 30, 4, random_state=2)
    assert np.array_equal(forest(x), models.random_forest(x, y, 30, 4, random_state=2)(x)) and models.roc_auc(y, forest(x)) > 0.9
    with pytest.raises(ValueError):
        models.random_forest(x, y, 1, class_weight="odd")


@pytest.mark.parametrize("kind", models.BINNED)
def test_bins_that_folds_share_change_no_model(kind):
    rng = np.random.default_rng(8)
    x = np.round(rng.normal(size=(90, 4)), 1)
    y = (x[:, 0] + x[:, 2] + rng.normal(size=90) > 0.4).astype(int)
    whole = models.Bins.of(x)
    for a, b in ((0, 40), (13, 90)):
        own = models.fit(kind, x[a:b], y[a:b], {"n_estimators": 5, "max_depth": 4})
        shared = models.fit(kind, x[a:b], y[a:b], {"n_estimators": 5, "max_depth": 4}, bins=whole.take(slice(a, b)))
        assert np.array_equal(own(x), shared(x))


def test_boosting_equals_brute_force():
    rng = np.random.default_rng(7)
    x = rng.integers(0, 9, (50, 2)).astype(float)
    y = (x[:, 0] * x[:, 1] + rng.normal(size=50) * 8 > 18).astype(int)
    mine = models.gradient_boosting(x, y, n_estimators=6, learning_rate=0.3, max_depth=2, min_samples_leaf=2)
    score = np.full(50, np.log(y.mean() / (1 - y.mean())))
    grid = rng.uniform(0, 9, (100, 2))
    on_grid = np.full(100, score[0])
    for _ in range(6):
        p = 1 / (1 + np.exp(-score))
        by_rest = dict(zip(map(tuple, np.column_stack([x, y - p])), p * (1 - p)))
        newton = lambda xs, rest, w: float(rest.sum() / sum(by_rest[(*a, b)] for a, b in zip(xs.tolist(), rest.tolist())))  # noqa: B023,E731
        tree = brute_tree(x, y - p, np.ones(50), 2, 2, newton)
        score = score + 0.3 * np.array([brute_value(tree, r) for r in x])
        on_grid = on_grid + 0.3 * np.array([brute_value(tree, r) for r in grid])
    assert np.allclose(mine(x), 1 / (1 + np.exp(-score))) and np.allclose(mine(grid), 1 / (1 + np.exp(-on_grid)))


def test_components_of_many_graphs(spark):
    rng = np.random.default_rng(4)
    edges, want = [], {}
    for g in range(6):
        n = 40
        own = [(i, i + 1) for i in range(30)] if g == 0 else [(0, i) for i in range(1, 25)] if g == 1 else [(int(a), int(b)) for a, b in rng.integers(0, n, (n // 2 + 4 * g, 2))]
        order = rng.permutation(n)
        own = [(int(order[a]), int(order[b])) for a, b in own]
        edges += [(g, None if g == 2 else "k", a, b) for a, b in own]
        parent = list(range(n))
        for _ in range(n):
            for a, b in own:
                parent[a] = parent[b] = min(parent[a], parent[b])
        want |= {(g, i): parent[i] for a in own for i in a if a[0] != a[1]}
    df = spark.createDataFrame(edges, "g int, h string, u bigint, v bigint").withColumn("h", F.coalesce("h", F.lit("")))
    got = {(r.g, r.node): r.component for r in components.components(df, ["g", "h"]).collect()}
    assert set(got) == set(want)
    pairs = {(k[0], got[k], want[k]) for k in want}
    assert len(pairs) == len({(g, a) for g, a, _ in pairs}) == len({(g, b) for g, _, b in pairs})
    assert components.components(df.where("u < 0"), ["g", "h"]).count() == 0


def test_network_features_use_no_python_worker(spark):
    pairs = spark.createDataFrame([(DAY, 1, 2, 0.9), (DAY, 1, 3, 0.8), (DAY, 2, 3, 0.2)], "date date, a1 bigint, a2 bigint, rho float")
    edge = network.edges(pairs, 0.5)
    node = spark.createDataFrame([(DAY, a) for a in (1, 2, 3, 4)], "date date, asset bigint")
    for found in (network.lcc(node, edge), network.clustering(node, edge), network.degrees(node, edge)):
        plan = found._jdf.queryExecution().executedPlan().toString()
        assert "Python" not in plan and "Pandas" not in plan and "Arrow" not in plan


def test_clustering_of_hubs_equals_numpy(spark):
    """A graph of two hubs that see all others: wedges from the hubs would be the square of its size."""
    rng = np.random.default_rng(11)
    n = 60
    w = np.zeros((n, n))
    for a, b in {(0, k) for k in range(1, n)} | {(1, k) for k in range(2, n)} | {tuple(sorted(map(int, rng.integers(0, n, 2)))) for _ in range(50)}:
        if a != b:
            w[a, b] = w[b, a] = np.float32(rng.choice([-1, 1]) * rng.uniform(0.5, 1))
    node, edge = graph(spark, range(n), [(a, b, float(w[a, b])) for a in range(n) for b in range(a + 1, n) if w[a, b]])
    root = np.cbrt(w / w.max())
    k = (w != 0).sum(1)
    want = (np.where(k > 1, np.einsum("ij,jk,ki->i", root, root, root) / np.maximum(k * (k - 1), 1), 0)).mean()
    assert abs(network.clustering(node, edge).first().clustering - want) < 1e-9
    out = network.oriented(edge).groupBy("date", "u").count().agg(F.max("count")).first()[0]
    assert network.oriented(edge).count() == edge.count() and out <= (2 * edge.count()) ** 0.5


@pytest.mark.parametrize("block,absolute,keep_sign,least", [(5, True, True, None), (3, False, True, 4), (7, True, False, None), (100, True, True, None)])
def test_tiles_equal_whole_matrices(spark, block, absolute, keep_sign, least):
    rng = np.random.default_rng(block)
    common = rng.normal(size=(2, 60))
    data = np.array([common[a % 2] * (a % 3) + rng.normal(size=60) * 1.5 for a in range(17)]).T
    data[10, 3], data[20:40, 5], data[:, 9], data[30, :], data[45:, 11:] = np.nan, np.nan, 1.0, np.nan, np.nan
    returns = returns_of(spark, data)
    sort = lambda df: df.orderBy("date", "threshold").collect()
    want = sort(network.all_features(returns, 8, [0.3, 0.7, 0.99], absolute, keep_sign, least))
    got = sort(tiles.features(returns, 8, [0.3, 0.7, 0.99], absolute, keep_sign, least, block=block, chunk=16))
    assert len(got) == len(want) > 60
    for a, b in zip(got, want):
        for x, y in zip(a, b):
            assert x == y or abs(x - y) < 2e-6, (a, b)
    assert any(r.lcc_ratio is None for r in want) and any(r.clustering for r in want)


def test_tiles_of_nothing(spark):
    assert tiles.features(spark.createDataFrame([], "date date, asset bigint, ret double"), 8, [0.5]).count() == 0


def test_forests_of_tiles_connect_what_their_edges_connect():
    rng = np.random.default_rng(1)
    for n, m in ((30, 10), (30, 60), (200, 190), (1, 0)):
        a, b = rng.integers(0, n, (2, m))
        forest = tiles.Forest(n)
        for k in range(0, m, 25):
            forest.add(a[k : k + 25], b[k : k + 25])
        up = list(range(n))
        for _ in range(n):
            for x, y in zip(a, b):
                up[x] = up[y] = min(up[x], up[y])
        assert len(set(zip(up, forest.label.tolist()))) == len(set(up)) == len(set(forest.label.tolist())) and len(forest.edges) == n - len(set(up))


def test_rankings_are_split_over_tasks(spark):
    rng = np.random.default_rng(13)
    rows = [(m, int(rng.random() < 0.3), float(np.round(rng.random(), d))) for m, d, n in (("one", 6, 3000), ("two", 1, 500), (None, 3, 200)) for _ in range(n)] + [("three", 1, 0.5), ("two", None, 0.1), ("one", 1, None)]
    df = spark.createDataFrame(rows, "model string, y_true int, y_pred double").repartition(7)
    got = {r.model: r for r in metrics.ranking(df, ["model"]).collect()}
    for m in ("one", "two", None):
        y, p = (np.array([r[k] for r in rows if r[0] == m and None not in r[1:]]) for k in (1, 2))
        assert abs(got[m].roc_auc - models.roc_auc(y, p)) < 1e-12 and abs(got[m].pr_auc - models.average_precision(y, p)) < 1e-12
    assert got["three"].roc_auc is None
    steps = metrics._by_score(df, ["model"], "y_true", "y_pred")
    plan = steps._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning(model" in plan and "_part" in plan and "SinglePartition" not in plan


def test_dense_panels_equal_pandas(spark):
    rng = np.random.default_rng(2)
    dates = days(20)
    rows = [(d, a, float(i)) for i, d in enumerate(dates) for a in (1, 2, 3) if rng.random() < 0.4] + [(dates[9], 4, 1.0)]
    df = spark.createDataFrame(rows, "date date, asset bigint, v double")
    got = {(r.date, r.asset): r.v for r in panel.dense(df, panel.calendar(spark.createDataFrame([(d,) for d in dates], "date date"))).collect()}
    want = pd.DataFrame(rows, columns=["date", "asset", "v"]).pivot(index="date", columns="asset", values="v").reindex(dates)
    assert len(got) == 20 * want.shape[1] and all((got[d, a] is None) == np.isnan(want.loc[d, a]) and got[d, a] in (None, want.loc[d, a]) for d, a in got)
    plan = panel.dense(df, panel.calendar(df))._jdf.queryExecution().executedPlan().toString()
    assert "Cartesian" not in plan and "NestedLoop" not in plan


def test_capm_has_no_cross_join(spark):
    returns = spark.createDataFrame([(d, a, 0.1) for d in days(9) for a in (1, 2)], "date date, asset bigint, ret double")
    series = lambda name: spark.createDataFrame([(d, 0.1) for d in days(9)], f"date date, {name} double")
    plan = capm.idiosyncratic(returns, series("mkt_ret"), series("rf"), 4, 2, 2)._jdf.queryExecution().executedPlan().toString()
    assert "Cartesian" not in plan and "NestedLoop" not in plan


def test_idiosyncratic_returns_equal_loops(spark):
    """Against pandas, with gaps of the risk-free rate and of betas within and beyond their limits."""
    rng = np.random.default_rng(4)
    dates, n, look = days(60), 60, 5
    rf = {d: 0.001 * rng.random() for i, d in enumerate(dates) if i not in (10, 11, 20, 21, 22, 23)}
    market = {d: rng.normal() / 50 for i, d in enumerate(dates) if i not in (33, 34)}
    panel_of = {a: {d: rng.normal() / 40 for i, d in enumerate(dates) if a != 2 or i not in (45, 46)} for a in (1, 2)}
    returns = spark.createDataFrame([(d, a, v) for a, x in panel_of.items() for d, v in x.items()], "date date, asset bigint, ret double")
    mkt = spark.createDataFrame(list(market.items()), "date date, mkt_ret double")
    rates = spark.createDataFrame(list(rf.items()), "date date, rf double")
    got = {(r.date, r.asset): r.idio for r in capm.idiosyncratic(returns, mkt, rates, look, 3, 2).collect()}
    wide = pd.DataFrame(panel_of).reindex(dates)
    free = pd.Series(rf).reindex(dates).ffill(limit=2)
    shared = [d for d in dates if d in market]
    over, over_m = wide.loc[shared].sub(free[shared], axis=0), pd.Series(market)[shared] - free[shared]
    beta = over.rolling(look).cov(over_m).div(over_m.rolling(look).var(), axis=0).ffill(limit=3)
    want = (over - beta.mul(over_m, axis=0)).reindex(dates)
    known = 0
    for d in dates:
        for a in (1, 2):
            v, w = got[d, a], want.loc[d, a]
            assert (v is None) == bool(np.isnan(w)) and (v is None or abs(v - w) < 1e-12), (d, a, v, w)
            known += v is not None
    assert known > 50 and any(got[d, 1] is None for d in dates[30:])
    used = capm.network_returns(returns, "idio", capm.idiosyncratic(returns, mkt, rates, look, 3, 2))
    assert used.select("date").distinct().count() == int(want.notna().any(axis=1).sum())


def test_pivot_of_repeated_rows_is_an_error(spark):
    rows = spark.createDataFrame([(DAY, 1, 0.1), (DAY, 2, 0.2)], "date date, asset bigint, ret double")
    assert panel.pivoted(rows, [1, 2]).first()[1:] == (0.1, 0.2)
    with pytest.raises(Exception, match="one row a date and asset"):
        panel.pivoted(rows.union(rows), [1, 2]).collect()


def test_keys_of_settings_are_those_of_the_query(spark):
    found = {r.c_mktsegment: r.cache_key for r in catalogue.QUERIES["cache_key"](spark, SF).collect()}
    assert found and all(key_of({"model": k, "lookback": 12}) == v for k, v in found.items())


def test_configuration():
    text = '{"data": {"FILENAMES_TO_LOAD": ["a.parquet"], "RETURNS_TYPE": null}, "cv": {"LOOKBACK_CORR": 12, "MODEL_GRID": [{"model": "LogisticRegression", "model_kwargs": {"max_iter": 9}, "param_grid": [{"C": 1.0}]}]}}'
    config = Config.from_json(text)
    assert config.returns_type == "raw" and config.lookback_corr == 12 and config.filenames_to_load == ("a.parquet",)
    assert config.models() == {"LogisticRegression": ("LogisticRegression", {"max_iter": 9}, [{"C": 1.0}])}
    assert config.cache_key() != config.cache_key(scheme="simple") and len(config.cache_key()) == 16
    with pytest.raises(KeyError):
        Config.from_json('{"MODEL_GRID": [{"model": "Unknown"}]}')
    assert registry(["x/a.parquet", "b.parquet"], skip=("b",)) == {"a": "x/a.parquet"}
    for bad in (["a.parquet", "y/a.csv"], [3]):
        with pytest.raises(ValueError):
            registry(bad)


def test_nan_is_null(spark):
    assert [r.x for r in nan_to_null(spark.createDataFrame([(float("nan"),), (1.0,)], "x double")).collect()] == [None, 1.0]


def test_entry_has_a_row_a_date(spark):
    import __spark_entry__

    rows = __spark_entry__.entry(spark).collect()
    assert rows and len({r.date for r in rows}) == len(rows)
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


@pytest.fixture
def split_size(spark):
    """Sets the bytes of a file that a task reads."""
    name = "spark.sql.files.maxPartitionBytes"
    before = spark.conf.get(name)
    yield lambda size: spark.conf.set(name, size)
    spark.conf.set(name, before)


def test_levels_are_added_up_in_the_order_of_the_rows(spark, tmp_path, split_size):
    """In runs of a file's rows, whatever tasks read them; nulls are skipped, and a month of nulls has none."""
    random, folder = np.random.default_rng(4), tmp_path / "orders.parquet"
    folder.mkdir()
    files = []
    for i in range(2):
        month = random.integers(1, 4, 60)
        x = [None if m == 3 or random.random() < 0.1 else float(10.0 ** random.integers(0, 17) / 3) for m in month]
        pd.DataFrame({"o_orderdate": np.array([f"2020-{m:02}-05" for m in month], "datetime64[us]"), "o_totalprice": x}).to_parquet(folder / f"{i}.parquet", row_group_size=7)
        files.append(list(zip(month, x)))
    split_size(500)
    rows = spark.read.parquet(str(folder))
    assert rows.rdd.getNumPartitions() > 8
    for run in (60, 11):
        want = []
        for m in (1, 2):
            total, n = 0.0, 0
            for held in files:
                for start in range(0, len(held), run):
                    part = 0.0
                    for _, x in [r for r in held[start : start + run] if r[0] == m and r[1] is not None]:
                        part, n = part + x, n + 1
                    total += part
            want.append(total / n)
        found = source.market_level(spark, str(tmp_path)) if run == 60 else source.mean_in_order(rows, source.month("o_orderdate"), F.col("o_totalprice"), "level", run)
        assert column(found, "level") == [*want, None]


@pytest.mark.parametrize("name", ["fwd_drawdown_dummy", "crop_first_valid", "wf_two_nested_expanding", "wf_two_nested_rolling"])
def test_labels_of_many_tasks_equal_the_sql_in_one_thread(spark, tmp_path, split_size, name):
    """DuckDB adds up means in the order of the rows if it has one thread; with more, labels of equal falls vary from run to run."""
    orders = pd.concat([pd.read_parquet(f"{SF}/orders.parquet")] * 12, ignore_index=True)
    orders["o_orderkey"] = np.arange(len(orders))
    for t in TABLES:
        (tmp_path / f"{t}.parquet").symlink_to(f"{SF}/{t}.parquet") if t != "orders" else orders.to_parquet(tmp_path / "orders.parquet", row_group_size=10_000)
    split_size(100_000)
    df = catalogue.QUERIES[name](spark, str(tmp_path))
    con = duck(tmp_path)
    con.sql("SET threads = 1")
    theirs = con.sql(catalogue.ORACLES[name]).select(*[f'"{c}"' for c in sorted(df.columns)]).fetchall()
    assert sorted(map(key, df.select(*sorted(df.columns)).collect())) == sorted(map(key, theirs))
