"""Site classification: nearest votes, and tree, forest and linear models with cross-validated grids."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ridgeline.plans.stages import NearestNeighbours, RandomFourierFeatures

#: Stands for a missing label.
MISSING = -(1 << 40)


def nearest_votes(queries: DataFrame, rows: DataFrame, k: int, most: int = 4096) -> DataFrame:
    """vec_id, predicted for each query: majority of its k nearest rows (squared distance; ties by id, then label).

    Queries go to every row in blocks of at most ``most`` vectors, so what is sent has a bound;
    each task keeps k rows a query and one tile of distances, and only those rows are shuffled."""
    import numpy as np
    import pyarrow as pa

    from ridgeline.plans.nearest import Nearest, matrix

    ids = [r["vec_id"] for r in queries.select("vec_id").orderBy("vec_id").toLocalIterator()]
    best = None
    for at in range(0, max(1, len(ids)), most):
        low, high = (ids[at], ids[min(len(ids), at + most) - 1]) if ids else (0, -1)
        block = queries.filter(F.col("vec_id").between(low, high)).select("vec_id", "embedding").toArrow().combine_chunks()
        name = block["vec_id"].to_numpy()
        point = matrix(block["embedding"].combine_chunks()) if len(name) else np.zeros((0, 0))

        def near(batches, name=name, point=point):
            place = np.arange(len(name))
            search = Nearest(-1 - place, point, k)  # a query has no row of its own here
            for batch in batches:
                if len(batch) and len(name):
                    tags = batch.column(1).cast(pa.int64()).fill_null(MISSING).to_numpy()
                    search.add(batch.column(0).to_numpy(), matrix(batch.column(2)), tags)
            for query, d, row, tag in search.found():
                yield pa.RecordBatch.from_pydict({"vec_id": name[-1 - query], "rid": row, "label": pa.array(tag, pa.int32(), mask=tag == MISSING), "d": d})

        part = rows.select("vec_id", F.col("label").cast("int"), "embedding").filter(F.col("embedding").isNotNull()).mapInArrow(near, "vec_id long, rid long, label int, d double")
        best = part if best is None else best.unionByName(part)
    near_k = best.withColumn("rn", F.row_number().over(Window.partitionBy("vec_id").orderBy("d", "rid"))).filter(F.col("rn") <= k)
    votes = near_k.groupBy("vec_id", "label").agg(F.count(F.lit(1)).alias("n"))
    return votes.groupBy("vec_id").agg(F.min_by("label", F.struct(-F.col("n"), "label")).alias("predicted"))


def features(rows: DataFrame, signal: str = "embedding", label: str = "label") -> DataFrame:
    """MLlib's columns: a vector and a double label."""
    from pyspark.ml.functions import array_to_vector

    return rows.select("*", array_to_vector(F.col(signal).cast("array<double>")).alias("features"), F.col(label).cast("double").alias("target"))


def trained(rows: DataFrame, kind: str = "rf", folds: int = 5, seed: int = 42):
    """The best model of a small grid by cross-validated accuracy. kind: rf, dt, knn, svc (linear and radial kernels) or linear."""
    from pyspark.ml import Pipeline
    from pyspark.ml.classification import DecisionTreeClassifier, LinearSVC, RandomForestClassifier
    from pyspark.ml.evaluation import MulticlassClassificationEvaluator
    from pyspark.ml.tuning import CrossValidator, ParamGridBuilder

    columns = {"featuresCol": "features", "labelCol": "target"}
    if kind == "rf":
        model = RandomForestClassifier(seed=seed, **columns)
        grid = ParamGridBuilder().addGrid(model.numTrees, [10, 50]).addGrid(model.impurity, ["gini", "entropy"])
    elif kind == "dt":
        model = DecisionTreeClassifier(seed=seed, **columns)
        grid = ParamGridBuilder().addGrid(model.impurity, ["gini", "entropy"]).addGrid(model.maxDepth, [5, 10])
    elif kind == "knn":
        model = NearestNeighbours(**columns)
        grid = ParamGridBuilder().addGrid(model.k, [3, 7]).addGrid(model.weights, ["uniform", "distance"])
    elif kind == "svc":
        gamma, wide = scale_gamma(rows), RandomFourierFeatures(inputCol="features", outputCol="wide", seed=seed)
        model = Pipeline(stages=[])
        linear = [[LinearSVC(regParam=0.01, maxIter=30, **columns)]]
        radial = [[wide.copy({wide.gamma: g}), LinearSVC(featuresCol="wide", labelCol="target", regParam=0.001, maxIter=30)] for g in (gamma / 4, gamma)]
        grid = ParamGridBuilder().addGrid(model.stages, linear + radial)
    elif kind == "linear":
        model = LinearSVC(maxIter=50, **columns)
        grid = ParamGridBuilder().addGrid(model.regParam, [0.01, 0.1, 1.0])
    else:
        raise ValueError(f"unknown classifier {kind}")
    accuracy = MulticlassClassificationEvaluator(labelCol="target", metricName="accuracy")
    known = features(rows).cache()
    best = CrossValidator(estimator=model, estimatorParamMaps=grid.build(), evaluator=accuracy, numFolds=folds, seed=seed).fit(known).bestModel
    known.unpersist()
    return best


def scale_gamma(rows: DataFrame, signal: str = "embedding") -> float:
    """One over the number of features times the variance of all their values."""
    row = rows.select(F.size(signal).alias("n"), F.explode(signal).alias("v")).agg(F.max("n").alias("n"), F.var_pop("v").alias("v")).first()
    return 1.0 / max(1e-12, (row["n"] or 1) * (row["v"] or 1.0))


def train_test(rows: DataFrame, kind: str = "rf", test: float = 0.3, folds: int = 5, seed: int = 42):
    """(model, accuracy on the held-out part)."""
    from pyspark.ml.evaluation import MulticlassClassificationEvaluator

    fit, held = rows.randomSplit([1 - test, test], seed)
    model = trained(fit, kind, folds, seed)
    return model, MulticlassClassificationEvaluator(labelCol="target", metricName="accuracy").evaluate(model.transform(features(held)))
