import datetime as dt
import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from lattica.plans.study import Study
from lattica.sources import charts, tables
from lattica.sources.config import Config


@pytest.fixture
def study(spark, tmp_path):
    rng = np.random.default_rng(6)
    days = [dt.date(2021, 1, 1) + dt.timedelta(i) for i in range(90)]
    common = rng.normal(size=90) * 0.01
    spark.createDataFrame([(d, 100 + a, float(common[i] + rng.normal() * 0.01) if (i + a) % 37 else None) for i, d in enumerate(days) for a in range(6)], "date date, permno bigint, ret double").write.parquet(f"{tmp_path}/ret.parquet")
    level = np.cumprod(1 + common)
    spark.createDataFrame([(d, 1.0, float(x)) for d, x in zip(days, level)], "date date, other double, bench double").write.parquet(f"{tmp_path}/mkt.parquet")
    spark.createDataFrame([(d, 0.0001) for d in days if d.day != 5] + [(days[3], 0.0002)], "date date, rf double").coalesce(1).write.parquet(f"{tmp_path}/rf.parquet")
    settings = {
        "FILENAMES_TO_LOAD": ["ret.parquet", "mkt.parquet", "rf.parquet"], "DATES_FILENAME": "ret", "MKT_RETURNS_FILENAME": "mkt", "RF_RETURNS_FILENAME": "rf", "RETURNS_TYPE": "idio",
        "MKT_BENCHMARK_COLUMN": "bench", "LIMIT_FFILL_BETAS": 2, "LIMIT_FFILL_RF": 2, "LOOKBACK_CORR": 8, "INNER_TRAIN_SIZE": 20, "INNER_VAL_SIZE": 8, "INNER_STEP_SIZE": 8, "TARGET_VARIABLE_ROLLING_WINDOW": 4,
        "QUANTILE_FOR_DUMMY": 0.5, "THRESHOLD_GRID": [0.2], "LOAD_OR_COMPUTE_CV": "load", "SAVE_CV": True,
        "MODEL_GRID": [{"model": "LogisticRegression", "model_kwargs": {"class_weight": "balanced"}, "param_grid": [{"C": 1.0}]}],
    }
    return Study(spark, Config.from_json(json.dumps(settings)), str(tmp_path))


def test_study_end_to_end(study, tmp_path):
    assert study.risk_free.where("rf = 0.0002").count() == 1
    frame = study.aligned
    assert frame.count() == 89 and {"target", "raw", "mkt_ret", "cumulative_return", "target_to_predict"} < set(frame.columns)
    assert study.network_returns.where("ret IS NOT NULL").count() > 300
    assert study.sample_graph().select("date").distinct().count() == 1
    result = study.walk(cache_root=str(tmp_path))
    assert result.predictions.where("y_pred IS NOT NULL").count() > 10 and result.metrics.count() == 1
    assert study.walk(cache_root=str(tmp_path)).predictions.count() == result.predictions.count()
    for kind, outer in (("nested_rolling", 40), ("nested_expanding", None)):
        assert study.walk(kind, outer).predictions.count() > 5
    study.config = Config.from_json('{"MKT_BENCHMARK_COLUMN": "none", "FILENAMES_TO_LOAD": ["mkt.parquet"], "MKT_RETURNS_FILENAME": "mkt"}')
    study.__dict__.pop("market", None)
    with pytest.raises(ValueError):
        study.market
    with pytest.raises(AttributeError):
        study.table("absent")
    study.config = Config.from_json('{"FILENAMES_TO_LOAD": ["mkt.parquet", "data/unread.parquet"], "FILENAMES_TO_SKIP": ["data/unread.parquet"]}')
    assert study.table("mkt").count() == 90
    with pytest.raises(AttributeError, match="there are mkt$"):
        study.table("unread")


def test_features_of_large_universes_come_by_tiles(study, monkeypatch):
    from lattica.plans import study as module

    whole = study.features.orderBy("date").collect()
    monkeypatch.setattr(module, "TILED_FROM", 5)
    study.__dict__.pop("features")
    tiled = study.features.orderBy("date").collect()
    assert len(whole) == len(tiled) >= 50
    assert all(x == y or abs(x - y) < 2e-6 for a, b in zip(whole, tiled) for x, y in zip(a, b))


def test_charts_heads_and_own_features(study, tmp_path, monkeypatch):
    drawn = []
    monkeypatch.setattr(charts, "line_chart", lambda frame, y, y2, title, save_to: drawn.append((y, y2, save_to)) or frame.select("date", y, y2).count())
    assert all(n > 0 for n in study.charts("out").values())
    assert drawn[0] == ("target_to_predict", "raw", "out/target_and_raw.png") and len(drawn) == 3
    assert [r.date for r in study.head(study.aligned, 3).collect()] == sorted(r.date for r in study.aligned.collect())[:3]
    first = study.aligned.agg({"date": "min"}).first()[0]
    assert study.network_returns.agg({"date": "min"}).first()[0] >= first
    own = study.features.select("date", "threshold", F.lit(1.0).alias("constant"), "density")
    brier = lambda y, p: -float(np.mean((y - p) ** 2))
    result = study.walk("simple", features=own, metric=brier)
    scores = [r.validation_score for r in result.predictions.collect() if r.validation_score is not None]
    assert scores and all(-1 <= s <= 0 for s in scores)
    with pytest.raises(ValueError):
        study.walk("simple", cache_root=str(tmp_path), metric=brier)


def test_release_removes_what_was_materialized(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(tables, "working_dir", lambda spark: f"file://{tmp_path}/application")
    assert tables.materialize(spark.range(3), "kept").count() == 3 and list(tmp_path.rglob("*.parquet"))
    tables.release(spark)
    assert not list(tmp_path.rglob("*.parquet"))
