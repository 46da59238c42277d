"""Stored detectors: exact round trip, versions, and scoring plans that start no job."""

import pytest
from pyspark.sql import functions as F

from helpers import frame, series_rows
from ledgerlark.config import ForestConfig
from ledgerlark.operators import detectors, features
from ledgerlark.sources import models


def training(spark, nulls=False):
    rows = series_rows([100 + 7 * (i % 13) + (400 if i % 61 == 5 else 0) for i in range(240)])
    return features.calendar_features(frame(spark, rows, series_rows([5, 6, 7] * 30, account="b")))


@pytest.fixture(scope="module")
def fitted(spark):
    df = training(spark)
    return [detectors.fit_forest(df, ForestConfig(trees=12)), detectors.fit_reconstruction(df)]


def scores(model, df):
    return [(r.if_score, r.if_anomaly) for r in model.transform(df).orderBy("account_id", "bucket").collect()]


def test_stored_models_score_alike(spark, fitted, tmp_path):
    df = training(spark).withColumn("total_cost", F.when(F.minute("bucket") != 3, F.col("total_cost")))
    for i, model in enumerate(fitted):
        root = str(tmp_path / f"m{i}")
        tag = models.save(spark, model, root)
        again = models.load(spark, root)
        assert type(again) is type(model) and again.record(tag) == model.record(tag)
        assert scores(again, df) == scores(model, df)


def test_building_a_scoring_plan_starts_no_job(spark, fitted, tmp_path):
    df = training(spark)
    for i, model in enumerate(fitted):
        models.save(spark, model, str(tmp_path / f"j{i}"), "v1")
    sc = spark.sparkContext
    sc.setJobGroup("building", "no job may start")
    try:
        frames = [models.load(spark, str(tmp_path / f"j{i}")).transform(df) for i in range(len(fitted))]
        assert len(sc.statusTracker().getJobIdsForGroup("building")) == 0
        assert frames[0].count() == df.count()
        assert len(sc.statusTracker().getJobIdsForGroup("building")) > 0
    finally:
        sc.setLocalProperty("spark.jobGroup.id", None)


def test_versions(spark, fitted, tmp_path):
    root = str(tmp_path / "v")
    forest, linear = fitted
    with pytest.raises(FileNotFoundError):
        models.load(spark, root)
    assert models.versions(spark, root).collect() == []
    for tag, model in (("v1", forest), ("v2", linear), ("v3", forest)):
        assert models.save(spark, model, root, tag) == tag
    with pytest.raises(FileExistsError):
        models.save(spark, linear, root, "v2")
    (tmp_path / "v" / "v9").mkdir()  # an unfinished version is none
    assert [tuple(r) for r in models.versions(spark, root).collect()] == [
        ("v1", "forest", 330), ("v2", "reconstruction", 330), ("v3", "forest", 330)]
    assert isinstance(models.load(spark, root), detectors.IsolationForest)
    assert isinstance(models.load(spark, root, "v2"), detectors.Reconstruction)
    assert models.prune(spark, root, 2) == ["v1"]
    assert {r.model_version for r in models.records(spark, root).collect()} == {"v2", "v3"}
    with pytest.raises(FileNotFoundError):
        models.load(spark, root, "v1")
    with pytest.raises(ValueError):
        models.prune(spark, root, 0)


def test_fit_does_not_depend_on_row_order(spark, fitted):
    df = training(spark)
    for shuffled in (df.repartition(7, "bucket"), df.orderBy(F.desc("total_cost"))):
        again = detectors.fit_forest(shuffled, ForestConfig(trees=12))
        assert again.record() == fitted[0].record()
        linear = detectors.fit_reconstruction(shuffled)
        for a, b in zip(linear.components, fitted[1].components):
            assert a == pytest.approx(b, abs=1e-9)


def test_null_keys_draw_apart(spark):
    rows = series_rows([float(i) for i in range(80)], account=None) + series_rows([float(i) for i in range(80)], service=None)
    model = detectors.fit_forest(frame(spark, rows), ForestConfig(trees=4, max_samples=32), features=["total_cost"])
    assert model.nodes.groupby("tree").size().min() > 1 and model.train_rows == 160
