"""Estimators have the reference's settings where MLlib has them."""

import inspect

import numpy as np
import pytest
from pyspark.sql import functions as F

from corpusloom.operators import boosting, models


def test_settings_of_the_reference(spark):
    b = models.backends(64)
    of = lambda name, *params: tuple(b[name].getOrDefault(p) for p in params)
    assert of("random_forest", "numTrees", "maxDepth") == (400, 30)  # MLlib's deepest
    assert of("gbt", "maxIter", "maxDepth", "stepSize", "subsamplingRate") == (400, 6, 0.1, 0.9)
    assert of("mlp", "layers", "maxIter") == ([64, 256, 128, 2], 300) and of("logreg", "maxIter") == (2000,)
    sweep = inspect.signature(models.seed_sweep).parameters
    assert list(sweep["seeds"].default) == [0, 1, 2, 3, 4] and set(sweep["names"].default) == set(b)


def test_a_model_comes_back_from_disk(spark, tmp_path):
    rows = spark.createDataFrame([([float(i % 7), float(i % 3)], int(i % 7 > 3)) for i in range(80)], "x array<double>, y int")
    model = models.fit(rows, "logreg", 2)
    models.save(model, f"file://{tmp_path}/m")
    same = models.predict(models.load(f"file://{tmp_path}/m"), rows).collect()
    assert same == models.predict(model, rows).collect() and models.available() == sorted(models.backends(2))


def test_oversampling_is_exact(spark):
    rows = spark.range(1000).select(F.col("id").alias("k"), (F.col("id") % 10 < 3).cast("int").alias("y"))
    got = models.oversampled(rows, "k")
    assert {r["y"]: r["count"] for r in got.groupBy("y").count().collect()} == {0: 700, 1: 700} and got.columns == rows.columns
    times = {r["count"] for r in got.where("y = 1").groupBy("k").count().collect()}
    assert times == {2, 3}


def test_boosted_trees(spark, tmp_path):
    rng = np.random.default_rng(4)
    x = rng.normal(size=(1200, 6))
    y = ((x[:, 0] > 0) ^ (x[:, 1] > 0.3)).astype(int)  # no line divides them
    rows = spark.createDataFrame([(i, v.tolist(), int(c)) for i, (v, c) in enumerate(zip(x, y))], "k int, x array<double>, y int")
    model = models.fit(rows.where("k < 800"), "gbt", 6)
    held = models.predict(model, rows.where("k >= 800")).toPandas()
    assert (held.y == held.y_pred).mean() > 0.95 and held.p_ai.between(0, 1).all()
    imp = models.importances(model, 6)
    assert imp.sum() == pytest.approx(1) and imp[:2].sum() > 0.8
    models.save(model, f"file://{tmp_path}/b")
    assert models.predict(models.load(f"file://{tmp_path}/b"), rows).collect() == models.predict(model, rows).collect()
    assert model.feature.shape == (400, 63) and models.predict(model, rows.limit(0)).count() == 0
    flat = boosting.grow(np.zeros((10, 2)), np.ones(10), np.ones(10), rounds=3)
    assert (flat.margin(np.zeros((2, 2))) > 0).all()
