"""One query for each operator, over the tables of a folder."""

from __future__ import annotations

from functools import partial

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lattica.functions import series as S
from lattica.operators import capm, correlation, folds, labels, metrics, network, panel, tiles, walkforward
from lattica.sources import panel as source
from lattica.sources.tables import materialize, table

#: Parameters of the study on these tables: correlation rows, label rows, quantile, threshold, horizon, fill limits. The
#: risk-free series lacks three months of each year, which RF_LIMIT bridges.
LOOKBACK, WINDOW, QUANTILE, THRESHOLD, HORIZON, LIMIT, RF_LIMIT = 12, 6, 0.1, 0.5, 2, 2, 3
#: The brands of the tables.
ASSETS = list(range(1, 26))
DATE = "1998-01-01"


def _rounded(df: DataFrame) -> DataFrame:
    """Floats to six decimals (zero without a sign), for comparison."""
    return df.withColumns({c: F.round(F.col(c).cast("double"), 6) + F.lit(0.0) for c, kind in df.dtypes if kind in ("double", "float")})


def _returns(spark: SparkSession, d: str) -> DataFrame:
    return source.returns(source.price_panel(spark, d))


def _market(spark: SparkSession, d: str) -> DataFrame:
    return source.market_level(spark, d).select("date", S.lagged_change("level").alias("mkt_ret"))


def _known_market(spark: SparkSession, d: str) -> DataFrame:
    return _market(spark, d).where("mkt_ret IS NOT NULL")


def calendar(spark, d):
    return panel.calendar(source.price_panel(spark, d))


def universe(spark, d):
    return panel.universe(source.price_panel(spark, d)).select("date", F.array_join("assets", ",").alias("assets"))


def pivot_returns(spark, d):
    return _rounded(panel.pivoted(_returns(spark, d), ASSETS))


def dedup_last(spark, d):
    orders = table(spark, d, "orders").select(F.to_date("o_orderdate").alias("date"), F.col("o_orderkey").alias("seq"), F.col("o_totalprice").alias("value"))
    return _rounded(panel.keep_last(orders))


def reindex_calendar(spark, d):
    return _rounded(panel.reindexed(source.risk_free(spark, d), calendar(spark, d)))


def common_calendar(spark, d):
    return panel.common_dates(source.price_panel(spark, d), _known_market(spark, d), source.risk_free(spark, d))


def market_returns(spark, d):
    return _rounded(_market(spark, d))


def cumulative_return(spark, d):
    return _rounded(_market(spark, d).select("date", S.cumulative_return("mkt_ret").alias("cumulative_return")))


def realized_vol(spark, d):
    return _rounded(labels.volatility(_market(spark, d), WINDOW, "m"))


def max_drawdown(spark, d):
    return _rounded(labels.max_drawdown(_market(spark, d), WINDOW))


def forward_max_drawdown(spark, d):
    return _rounded(labels.forward_drawdown(_market(spark, d), WINDOW))


def rolling_quantile(spark, d):
    return _rounded(_market(spark, d).select("date", S.rolling_quantile("mkt_ret", WINDOW, QUANTILE).alias("q")))


def _dummy(spark, d, variable):
    return _rounded(labels.target(_known_market(spark, d), variable, WINDOW, QUANTILE, "m"))


vol_dummy = partial(_dummy, variable="dummy_realized_volatility")
drawdown_dummy = partial(_dummy, variable="dummy_maximum_drawdown")
fwd_drawdown_dummy = partial(_dummy, variable="dummy_forward_max_drawdown")


def label_lead(spark, d):
    return labels.led(fwd_drawdown_dummy(spark, d).select("date", "target"), "target", HORIZON)


def bounded_ffill(spark, d):
    rates = panel.reindexed(source.risk_free(spark, d), calendar(spark, d))
    return _rounded(rates.select("date", "rf", S.bounded_fill("rf", LIMIT).alias("rf_filled")))


def rolling_beta(spark, d):
    excess = capm.excess_returns(_returns(spark, d), _known_market(spark, d), source.risk_free(spark, d), RF_LIMIT)
    found = capm.rolling_beta(excess, LOOKBACK).select("date", "asset", "beta")
    return _rounded(panel.dense(found, panel.calendar(found)))


def _idio(spark, d):
    return capm.idiosyncratic(_returns(spark, d), _known_market(spark, d), source.risk_free(spark, d), LOOKBACK, LIMIT, RF_LIMIT)


def idio_returns(spark, d):
    return _rounded(_idio(spark, d))


def network_returns(spark, d):
    return _rounded(capm.network_returns(_returns(spark, d), "idio", _idio(spark, d)))


def asof_market(spark, d):
    return _rounded(panel.asof(calendar(spark, d), _market(spark, d)))


def _aligned(spark, d):
    market = _known_market(spark, d).withColumn("cumulative_return", S.cumulative_return("mkt_ret"))
    target = labels.target(_known_market(spark, d), "dummy_forward_max_drawdown", WINDOW, QUANTILE)
    return panel.asof(panel.asof(calendar(spark, d).select("date"), target), market)


def aligned_frame(spark, d):
    return _rounded(_aligned(spark, d))


def crop_first_valid(spark, d):
    return _rounded(panel.cropped(_aligned(spark, d), "target"))


def analytics_frame(spark, d):
    """The series that are plotted: target to predict, raw target and cumulative market return."""
    frame = panel.cropped(_aligned(spark, d), "target")
    to_predict = labels.led(frame.select("date", "target"), "target", HORIZON).select("date", F.col("target_to_predict"))
    return _rounded(frame.select("date", "raw", "cumulative_return").join(to_predict, "date", "left"))


def rolling_corr(spark, d):
    return _rounded(correlation.rolling_pairs(_returns(spark, d), LOOKBACK))


def corr_on_date(spark, d):
    return _rounded(correlation.on_date(_returns(spark, d), DATE, LOOKBACK))


def corr_distance(spark, d):
    pairs = correlation.rolling_pairs(_returns(spark, d), LOOKBACK)
    return _rounded(pairs.select("date", "a1", "a2", S.mantegna_distance(F.col("rho").cast("double")).alias("distance")))


def corr_summary(spark, d):
    return _rounded(correlation.summary(correlation.rolling_pairs(_returns(spark, d), LOOKBACK)))


def _edges(spark, d, absolute=True, keep_sign=True):
    return network.edges(correlation.rolling_pairs(_returns(spark, d), LOOKBACK), THRESHOLD, absolute, keep_sign)


def threshold_edges(spark, d):
    return _rounded(_edges(spark, d))


def threshold_edges_signed(spark, d):
    return _rounded(_edges(spark, d, absolute=False))


def threshold_edges_unsigned(spark, d):
    return _rounded(_edges(spark, d, keep_sign=False))


def _nodes(spark, d):
    return network.nodes(_returns(spark, d), LOOKBACK)


def net_degree(spark, d):
    found = network.degrees(_nodes(spark, d), _edges(spark, d))
    return _rounded(found.select("date", "n_nodes", "n_edges", "density", "avg_degree", "std_degree"))


def net_weighted_degree(spark, d):
    return _rounded(network.degrees(_nodes(spark, d), _edges(spark, d)).select("date", "avg_weighted_degree", "std_weighted_degree"))


def net_edge_weight(spark, d):
    return _rounded(network.edge_weights(_nodes(spark, d), _edges(spark, d)))


def net_clustering(spark, d):
    return _rounded(network.clustering(_nodes(spark, d), _edges(spark, d)))


def net_lcc(spark, d):
    return _rounded(network.lcc(_nodes(spark, d), _edges(spark, d)))


def net_eigen(spark, d):
    return _rounded(correlation.eigen(_returns(spark, d), LOOKBACK))


def net_features(spark, d):
    return _rounded(network.features(_returns(spark, d), LOOKBACK, THRESHOLD))


def net_features_all(spark, d):
    """The sixteen features by the chunk path."""
    return _rounded(network.all_features(_returns(spark, d), LOOKBACK, [THRESHOLD]))


def net_features_tiled(spark, d):
    """The sixteen features by tiles of eight brands."""
    return _rounded(tiles.features(_returns(spark, d), LOOKBACK, [THRESHOLD], block=8))


def sample_graph(spark, d):
    pairs = correlation.rolling_pairs(_returns(spark, d), LOOKBACK)
    return _rounded(network.edges(pairs, THRESHOLD).join(F.broadcast(network.middle_date(pairs)), "date", "left_semi"))


def features_for_window(spark, d):
    pairs = correlation.rolling_pairs(_returns(spark, d), LOOKBACK)
    return _rounded(network.in_window(correlation.summary(pairs), calendar(spark, d), 20, 40))


def features_for_dates(spark, d):
    pairs = correlation.rolling_pairs(_returns(spark, d), LOOKBACK)
    wanted = calendar(spark, d).where("ord % 5 = 0").select("date")
    return _rounded(network.on_dates(correlation.summary(pairs), wanted))


def rolling_folds(spark, d):
    return folds.rolling_folds(calendar(spark, d), 24, 6, 3)


def fold_membership(spark, d):
    return folds.membership(calendar(spark, d), rolling_folds(spark, d))


def _grid_scores(spark, d):
    """Scores of a grid by source: coarse, so that combinations tie."""
    docs = table(spark, d, "events").select("event_type", "user_id", "value")
    cells = docs.select(F.col("event_type").alias("model"), (F.col("user_id") % 3).alias("threshold_ord"), (F.col("user_id") % 4).alias("theta_ord"), "value")
    return cells.groupBy("model", "threshold_ord", "theta_ord").agg(F.round(F.avg("value"), 0).alias("score"))


def grid_argmax(spark, d):
    return folds.best_combination(_grid_scores(spark, d), ["model"], ["threshold_ord", "theta_ord"])


def cv_full_index(spark, d):
    models = table(spark, d, "documents").select(F.col("lang").alias("model")).where("model IS NOT NULL").distinct()
    market = _market(spark, d).select("date", "mkt_ret", F.lit("en").alias("model"))
    return _rounded(folds.full_index(calendar(spark, d), models, market))


def _scores(spark, d):
    """Labels as truth, relative length as prediction, source as model."""
    docs = table(spark, d, "documents").select("doc_id", "source", "n_chars")
    longest = docs.agg(F.max("n_chars").alias("longest"))
    found = docs.join(table(spark, d, "labels").select("doc_id", "quality"), "doc_id").crossJoin(F.broadcast(longest))
    p = F.col("n_chars") / F.col("longest")
    return found.select(F.col("source").alias("model"), F.col("quality").alias("y_true"), p.alias("y_pred"), (p >= 0.05).cast("int").alias("y_pred_binary"))


def roc_auc(spark, d):
    return _rounded(metrics.ranking(_scores(spark, d), ["model"]).select("model", "roc_auc"))


def pr_auc(spark, d):
    return _rounded(metrics.ranking(_scores(spark, d), ["model"]).select("model", "pr_auc"))


def oos_metrics(spark, d):
    return _rounded(metrics.oos_metrics(_scores(spark, d)))


def score_describe(spark, d):
    return _rounded(walkforward.describe(_scores(spark, d), "y_pred"))


def logistic_map(spark, d):
    return _rounded(_scores(spark, d).groupBy("model").agg(F.avg(S.logistic(F.col("y_pred") * 4 - 1)).alias("p")))


def cache_key(spark, d):
    """Keys of settings that the segments stand for: 16 hex digits of SHA-256 over canonical JSON."""
    names = table(spark, d, "customer").select("c_mktsegment").distinct()
    text = F.concat(F.lit('{"lookback": 12, "model": "'), F.col("c_mktsegment"), F.lit('"}'))
    return names.select("c_mktsegment", F.substring(F.sha2(text, 256), 1, 16).alias("cache_key"))


#: The walks' grid of thresholds and of C, and the quantile of their labels.
WALK_THRESHOLDS, WALK_C, WALK_QUANTILE = [0.4, THRESHOLD], [0.1, 1.0], 0.3
LOGISTIC = {"logistic": ("LogisticRegression", {"class_weight": "balanced"}, [{"C": c} for c in WALK_C])}
SIMPLE = walkforward.Scheme("simple", LOOKBACK, 24, 8, HORIZON)
ROLLING = walkforward.Scheme("nested_rolling", LOOKBACK, 18, 6, HORIZON, step=6, outer=36)
EXPANDING = walkforward.Scheme("nested_expanding", LOOKBACK, 24, 8, step=8)


def _walk(spark, d, scheme: walkforward.Scheme, models: dict = LOGISTIC, names: tuple[str, ...] = network.FEATURES) -> DataFrame:
    returns = _returns(spark, d).where("ret IS NOT NULL")
    feature = network.all_features(returns, LOOKBACK, WALK_THRESHOLDS).select("date", "threshold", *names)
    target = labels.target(_known_market(spark, d), "dummy_forward_max_drawdown", WINDOW, WALK_QUANTILE).select("date", F.col("target").alias("y"))
    target = materialize(target, "walk-target")
    grid = walkforward.Grid(models, WALK_THRESHOLDS)
    return _rounded(walkforward.run(returns, feature, target, scheme, grid, "roc_auc").predictions)


def wf_simple(spark, d):
    return _walk(spark, d, SIMPLE)


def wf_nested_rolling(spark, d):
    return _walk(spark, d, ROLLING)


def wf_ensembles(spark, d):
    """The simple scheme with forests and boosted trees."""
    models = {"forest": ("RandomForestClassifier", {"n_estimators": 10, "max_depth": 3, "random_state": 1}, [{}]), "boosting": ("GradientBoostingClassifier", {"n_estimators": 10, "max_depth": 2, "random_state": 1}, [{}])}
    return _walk(spark, d, SIMPLE, models)


def wf_nested_expanding(spark, d):
    return _walk(spark, d, EXPANDING)


#: Walks on two of the features, which SQL can fit too; these vary little, so their weights are penalised less.
TWO, TWO_C = ("density", "avg_abs_corr"), [10.0, 300.0]
LOGISTIC_TWO = {"logistic": ("LogisticRegression", {"class_weight": "balanced"}, [{"C": c} for c in TWO_C])}


def wf_two_simple(spark, d):
    return _walk(spark, d, SIMPLE, LOGISTIC_TWO, TWO)


def wf_two_nested_rolling(spark, d):
    return _walk(spark, d, ROLLING, LOGISTIC_TWO, TWO)


def wf_two_nested_expanding(spark, d):
    return _walk(spark, d, EXPANDING, LOGISTIC_TWO, TWO)
