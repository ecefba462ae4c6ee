"""The kernel stage and the neighbour model: against plain versions, in grids and pipelines, saved and loaded."""

import numpy as np
import pytest
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import LinearSVC
from pyspark.ml.util import DefaultParamsReader
from pyspark.sql import functions as F

from ridgeline.plans import classify, stages


@pytest.fixture(scope="module")
def rings(spark):
    """Two rings around one centre: no line parts them."""
    rng = np.random.default_rng(1)
    angle, radius = rng.random(240) * 2 * np.pi, np.where(np.arange(240) % 2, 1.0, 3.0) + rng.normal(0, 0.2, 240)
    rows = [(i, [float(r * np.cos(a)), float(r * np.sin(a))], i % 2) for i, (a, r) in enumerate(zip(angle, radius, strict=True))]
    return spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int").coalesce(1).cache()


def accuracy(model, rows):
    return model.transform(classify.features(rows)).agg(F.avg((F.col("prediction") == F.col("target")).cast("double"))).first()[0]


def test_products_are_near_the_kernel(spark):
    rng = np.random.default_rng(2)
    x = rng.standard_normal((30, 5))
    df = classify.features(spark.createDataFrame([(i, v.tolist(), 0) for i, v in enumerate(x)], "vec_id long, embedding array<double>, label int"))
    made = stages.RandomFourierFeatures(inputCol="features", outputCol="wide", gamma=0.3, size=4096).transform(df)
    z = np.array([r.wide.toArray() for r in made.orderBy("vec_id").collect()])
    want = np.exp(-0.3 * ((x[:, None] - x[None]) ** 2).sum(2))
    assert np.abs(z @ z.T - want).max() < 0.1


@pytest.mark.parametrize("weights", ["uniform", "distance"])
@pytest.mark.parametrize("metric, order", [("euclidean", 2), ("manhattan", 1), ("chebyshev", np.inf)])
def test_votes_equal_plain(spark, rings, monkeypatch, metric, order, weights):
    monkeypatch.setattr(stages, "BLOCK_BYTES", 500)  # many blocks
    rows = classify.features(rings.withColumn("label", F.col("vec_id").cast("int") % 3))
    fit, told = rows.filter("vec_id < 100"), rows.filter("vec_id >= 100")
    model = stages.NearestNeighbours(k=4, metric=metric, weights=weights, featuresCol="features", labelCol="target").fit(fit)
    known = [(np.array(r.embedding), r.target) for r in fit.collect()]
    got = model.transform(told).select("embedding", "prediction").collect()
    for r in got:
        near = sorted((round(float(np.linalg.norm(x - np.array(r.embedding), order)), 9), y) for x, y in known)[:4]
        votes = {}
        for d, y in near:
            votes[y] = votes.get(y, 0) + (1 if weights == "uniform" else 1 / d)
        assert r.prediction == min(votes, key=lambda y: (-round(votes[y], 9), y))


def test_own_rows_win_by_distance(spark, rings):
    rows = classify.features(rings)
    model = stages.NearestNeighbours(k=5, weights="distance", featuresCol="features", labelCol="target").fit(rows)
    assert accuracy(model, rings) == 1.0
    assert stages.NearestNeighbours(featuresCol="features", labelCol="target").fit(rows.limit(0)).transform(rows.limit(3)).filter("prediction IS NULL").count() == 3


def test_saved_models_load_and_say_the_same(spark, rings, tmp_path):
    rows = classify.features(rings)
    wide = stages.RandomFourierFeatures(inputCol="features", outputCol="wide", gamma=1.0)
    piped = Pipeline(stages=[wide, LinearSVC(featuresCol="wide", labelCol="target", regParam=0.001, maxIter=30)]).fit(rows)
    near = stages.NearestNeighbours(k=3, metric="manhattan", featuresCol="features", labelCol="target").fit(rows)
    for name, model, kind in (("p", piped, PipelineModel), ("n", near, stages.NearestModel)):
        model.write().overwrite().save(str(tmp_path / name))
        again = DefaultParamsReader.loadParamsInstance(str(tmp_path / name), spark)
        assert isinstance(again, kind)
        said = lambda m: [r.prediction for r in m.transform(rows).orderBy("vec_id").collect()]
        assert said(again) == said(model)
    assert accuracy(piped, rings) > 0.95


def test_grid_takes_the_neighbour_model(spark, rings):
    model, held = classify.train_test(rings.limit(120), "knn", folds=2)
    assert isinstance(model, stages.NearestModel) and held >= 0.9
