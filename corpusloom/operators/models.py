"""Classifiers over feature vectors by MLlib, class weights, oversampling, importances and the fusion of blocks.

What MLlib has no counterpart for: an RBF kernel (svm is linear, without probabilities), trees deeper than 30, Adam and
early stopping. gbt stands for hist_gbm, gradient_boosting and xgboost, with the settings of the last: boosting.py fits it
in one task up to 50,000 rows, MLlib beyond.
"""

from __future__ import annotations

from multiprocessing.pool import ThreadPool

import numpy as np
import pandas as pd
from pyspark import inheritable_thread_target
from pyspark.ml.classification import GBTClassifier, LinearSVC, LogisticRegression, MultilayerPerceptronClassifier, RandomForestClassifier
from pyspark.ml.feature import StandardScaler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml import Pipeline, PipelineModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from corpusloom.operators import boosting
from corpusloom.operators.corpus import with_global_rank
from corpusloom.session import table, written
from corpusloom.sources.io import exists


#: Rows of a partition of training data, and fits that a sweep has under way at a time.
ROWS, AT_ONCE = 50_000, 8


def backends(width: int, seed: int = 42, total: float = 1000.0, c: float = 1.0) -> dict:
    """Name -> estimator; fixed settings as far as MLlib has them. total: the sum of the weights, which c is held against."""
    common = {"featuresCol": "features", "labelCol": "y"}
    return {
        "logreg": LogisticRegression(**common, weightCol="weight", maxIter=2000, regParam=1 / (c * total)),
        "random_forest": RandomForestClassifier(**common, weightCol="weight", numTrees=400, maxDepth=30, seed=seed),
        "gbt": GBTClassifier(**common, weightCol="weight", maxIter=400, maxDepth=6, stepSize=0.1, subsamplingRate=0.9, seed=seed),
        "svm": LinearSVC(**common, weightCol="weight", maxIter=50, regParam=1 / (c * total)),
        "mlp": MultilayerPerceptronClassifier(**common, layers=[width, 256, 128, 2], maxIter=300, seed=seed),
    }


def weighted(df: DataFrame, y: str = "y") -> DataFrame:
    """df with weight = total / (classes * count of the class)."""
    n = df.groupBy(y).agg(F.count("*").alias("_n"))
    w = n.select(y, (F.sum("_n").over(W.partitionBy()) / (F.count("*").over(W.partitionBy()) * F.greatest("_n", F.lit(1)))).alias("weight"))  # one row a class
    return df.join(F.broadcast(w), y)


def oversampled(df: DataFrame, k: str, y: str = "y", seed: str = "42") -> DataFrame:
    """df with rows of smaller classes repeated to the largest class's size exactly: whole copies, and once more the first by hash."""
    n = df.groupBy(y).agg(F.count("*").alias("_n"))
    n = n.select(y, "_n", F.max("_n").over(W.partitionBy()).alias("_most"))  # one row a class
    hashed = df.withColumn("_h", F.concat(F.md5(F.concat(F.lit(f"{seed}:"), F.col(k).cast("string"))), F.col(k).cast("string")))
    ranked = with_global_rank(hashed, "_h", "_rank", part=[y]).join(F.broadcast(n), y)
    times = F.floor(F.col("_most") / F.col("_n")) + (F.col("_rank") <= F.col("_most") % F.col("_n")).cast("int")
    return ranked.withColumn("_copy", F.explode(F.sequence(F.lit(1), times.cast("int")))).select(*df.columns)


def available() -> list[str]:
    """Names of the backends."""
    return sorted(backends(1))


def fit(train: DataFrame, backend: str, width: int, seed: int = 42):
    """A pipeline of scaler and classifier over `x` (array) and `y` (0 or 1)."""
    if backend not in available():
        raise ValueError(f"unknown backend {backend!r}: {available()}")
    n = train.count()
    if backend == "gbt" and 0 < n <= boosting.IN_ONE_TASK:
        return boosting.fit(weighted(train.select("x", "y")), seed)
    rows = weighted(train.select(array_to_vector(F.col("x").cast("array<double>")).alias("raw"), "y")).coalesce(max(1, -(-n // ROWS)))
    return Pipeline(stages=[StandardScaler(inputCol="raw", outputCol="features", withMean=True), backends(width, seed, max(n, 1))[backend]]).fit(rows)


def fit_all(train: DataFrame, jobs: list[tuple[str, int]], width: int) -> list:
    """Models of (backend, seed), several under way at a time: rounds of small jobs leave most of a cluster idle."""
    train = written(train.select("x", "y"), "train")
    return parallel([lambda b=b, s=s: fit(train, b, width, s) for b, s in jobs])


def parallel(calls: list) -> list:
    with ThreadPool(min(AT_ONCE, max(1, len(calls)))) as pool:
        return pool.map(inheritable_thread_target(lambda call: call()), calls)


def save(model, path: str) -> None:
    if isinstance(model, boosting.Boosted):
        return model.save(SparkSession.active(), path)
    model.write().overwrite().save(path)


def load(path: str):
    """A model as save() wrote it; predict() gives the same with it."""
    spark = SparkSession.active()
    if not exists(spark, f"{path}/metadata"):
        return boosting.load(spark, path)
    return PipelineModel.load(path)


def predict(model, rows: DataFrame) -> DataFrame:
    """rows with p_ai (where the classifier has probabilities) and y_pred."""
    if isinstance(model, boosting.Boosted):
        return model.transform(rows)
    out = model.transform(rows.withColumn("raw", array_to_vector(F.col("x").cast("array<double>"))))
    p = vector_to_array("probability")[1] if "probability" in out.columns else F.lit(None).cast("double")
    return out.select(*rows.columns, p.alias("p_ai"), F.col("prediction").cast("int").alias("y_pred"))


def labelled(spark, d) -> DataFrame:
    """vec_id, x, y: vectors, whether their label is in the upper half, and a part by md5 for hold-out."""
    e = table(spark, d, "embeddings")
    held = F.substring(F.md5(F.col("vec_id").cast("string")), 1, 1).isin(*"0123")
    return e.select("vec_id", F.col("embedding").alias("x"), (F.col("label") >= 5).cast("int").alias("y"), held.alias("held"))


def _scores(backend):
    def query(spark, d):
        e = labelled(spark, d)
        width = e.select(F.max(F.size("x"))).first()[0] or 1
        m = fit(e.where("not held"), backend, width)
        return predict(m, e.where("held")).select("vec_id", "y", "y_pred", F.round("p_ai", 6).alias("p_ai"))

    return query


def importances(model, width: int) -> np.ndarray:
    """Of the features, summing to 1: what trees have, absolute weights else."""
    if isinstance(model, boosting.Boosted):
        return model.importances()
    c = model.stages[-1]
    if hasattr(c, "featureImportances"):
        return c.featureImportances.toArray()
    w = np.abs(c.coefficients.toArray())
    return w / w.sum() if w.sum() else w


def forest_importance(spark, d):
    e = labelled(spark, d)
    width = e.select(F.max(F.size("x"))).first()[0] or 1
    w = importances(fit(e, "random_forest", width), width)
    return spark.createDataFrame([(i, float(x)) for i, x in enumerate(w)], "dim int, importance double")


def topk_features(spark, d, k=10):
    """How many backends have a feature among their first k, and its mean importance there."""
    e = labelled(spark, d)
    width = e.select(F.max(F.size("x"))).first()[0] or 1
    rows, names = [], ("logreg", "random_forest", "gbt", "svm")
    for b, m in zip(names, fit_all(e, [(b, 42) for b in names], width), strict=True):
        w = importances(m, width)
        rows += [(b, int(i), float(w[i])) for i in np.argsort(-w, kind="stable")[:k]]
    t = spark.createDataFrame(rows, "backend string, dim int, importance double")
    return t.groupBy("dim").agg(F.count("*").alias("n"), F.round(F.avg("importance"), 6).alias("mean_importance"))


def permutation_importance(spark, d, repeats=10):
    """Loss of accuracy when one block of the vectors is taken from another row; rows are paired by rank in an order by hash."""
    from corpusloom.operators.features import BLOCKS
    from corpusloom.operators.splits import ordered

    e = labelled(spark, d)
    width = e.select(F.max(F.size("x"))).first()[0] or 1
    m = fit(e.where("not held"), "logreg", width)
    rows = e.where("held").withColumn("k", F.col("vec_id").cast("string"))
    acc = lambda df: predict(m, df).agg(F.avg((F.col("y") == F.col("y_pred")).cast("double"))).first()[0] or 0.0
    base, out = acc(rows), []
    here = ordered(rows, "k", "base").drop("n")
    for r in range(repeats):
        other = ordered(rows.select("k", F.col("x").alias("ox")), "k", f"perm{r}").select("r", "ox")
        both = here.join(other, "r")
        for name, first, size in BLOCKS:
            mixed = F.concat(F.slice("x", 1, first - 1) if first > 1 else F.slice("x", 1, 0), F.slice("ox", first, size), F.slice("x", first + size, width))
            out.append((name, r, base - acc(both.withColumn("x", mixed))))
    t = spark.createDataFrame(out, "block string, repeat int, loss double")
    return t.groupBy("block").agg(F.round(F.avg("loss"), 6).alias("mean_loss"), F.round(F.stddev_pop("loss"), 6).alias("std_loss"))


def seed_sweep(spark, d, seeds=range(5), names=("logreg", "random_forest", "gbt", "svm", "mlp")):
    """Accuracy on the hold-out by backend and seed."""
    e = labelled(spark, d)
    width = e.select(F.max(F.size("x"))).first()[0] or 1
    jobs = [(b, s) for b in names for s in seeds]
    models = fit_all(e.where("not held"), jobs, width)
    right = lambda m: float(predict(m, e.where("held")).agg(F.avg((F.col("y") == F.col("y_pred")).cast("double"))).first()[0] or 0.0)
    out = [(b, s, a) for (b, s), a in zip(jobs, parallel([lambda m=m: right(m) for m in models]), strict=True)]
    return spark.createDataFrame(out, "backend string, seed int, accuracy double")


def oversample(spark, d):
    """Rows by class after oversampling labels 0 to 2 against the rest."""
    e = table(spark, d, "embeddings").select("vec_id", (F.col("label") <= 2).cast("int").alias("y"))
    return oversampled(e, "vec_id").groupBy("y").agg(F.count("*").alias("n"), F.countDistinct("vec_id").alias("n_distinct"))


def projected(rows: DataFrame, width: int, hidden: int = 256, out: int = 128, seed: int = 42) -> DataFrame:
    """vec_id, z: a seeded two-layer projection (ReLU between) of `x`, in Arrow batches."""
    rng = np.random.default_rng(seed)
    a, b = rng.normal(0, width**-0.5, (width, hidden)), rng.normal(0, hidden**-0.5, (hidden, out))

    def go(batches):
        for p in batches:
            x = np.array([np.resize(np.asarray(v, float), width) for v in p["x"]]).reshape(-1, width)
            yield pd.DataFrame({"vec_id": p["vec_id"], "z": list(np.maximum(x @ a, 0) @ b)})

    return rows.select("vec_id", "x").mapInPandas(go, "vec_id bigint, z array<double>")


def fused(blocks: list[np.ndarray], method: str, weights: dict[str, np.ndarray]) -> np.ndarray:
    """Forward pass over blocks already of one width: concat and mlp (same layers), attention (4 heads), gating (vector gate)."""
    x = np.stack(blocks, 1)  # rows, blocks, width
    n, k, w = x.shape
    if method in ("concat", "mlp"):
        return np.maximum(x.reshape(n, k * w) @ weights["w"] + weights["b"], 0)
    if method == "gating":
        g = 1 / (1 + np.exp(-(x.reshape(n, k * w) @ weights["g"]).reshape(n, k, w)))
        return (g * x).sum(1)
    if method == "attention":
        heads, size = 4, w // 4
        q, key, v = (np.einsum("nkw,wo->nko", x, weights[c]).reshape(n, k, heads, size) for c in ("q", "k", "v"))
        s = np.einsum("nihd,njhd->nhij", q, key) / np.sqrt(size)
        s = np.exp(s - s.max(-1, keepdims=True))
        s /= s.sum(-1, keepdims=True)
        return np.einsum("nhij,njhd->nihd", s, v).reshape(n, k, w).mean(1)
    raise ValueError(f"unknown method {method!r}")


def projection(spark, d):
    e = table(spark, d, "embeddings").select("vec_id", F.col("embedding").alias("x"))
    z = projected(e, 64)
    return z.select("vec_id", F.size("z").alias("width"), F.round(F.aggregate("z", F.lit(0.0), lambda s, v: s + v), 4).alias("sum_z"))


QUERIES = {"logreg_scores": _scores("logreg"), "svm_scores": _scores("svm"), "forest_importance": forest_importance, "topk_features": topk_features, "permutation_importance": permutation_importance, "seed_sweep": seed_sweep, "oversample": oversample, "projection": projection}
SQL = {"oversample": "with c as (select (label <= 2)::int as y, count(*) as n from embeddings group by 1) select y, max(n) over () as n, n as n_distinct from c"}
