"""Pipeline stages that MLlib lacks: random Fourier features (a kernel for linear models), and exact nearest neighbours.

Both are estimators or transformers that CrossValidator and Pipeline take, save and load like MLlib's own.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import keyword_only
from pyspark.ml import Estimator, Model, Transformer
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.param.shared import HasFeaturesCol, HasInputCol, HasLabelCol, HasOutputCol, HasPredictionCol, HasSeed
from pyspark.ml.util import DefaultParamsReadable, DefaultParamsReader, DefaultParamsWritable, DefaultParamsWriter, MLReadable, MLReader, MLWritable, MLWriter
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Training vectors of one block, in bytes; a task holds one block at a time.
BLOCK_BYTES = 32 << 20


class RandomFourierFeatures(Transformer, HasInputCol, HasOutputCol, HasSeed, DefaultParamsReadable, DefaultParamsWritable):
    """Vectors whose inner products are about exp(-gamma * squared distance): cosines along ``size`` random directions.

    The directions follow from the seed and the vectors' length, so a saved stage needs no more than its parameters."""

    gamma = Param(Params._dummy(), "gamma", "of the kernel exp(-gamma * squared distance)", TypeConverters.toFloat)
    size = Param(Params._dummy(), "size", "features made", TypeConverters.toInt)

    @keyword_only
    def __init__(self, *, inputCol=None, outputCol=None, gamma=1.0, size=256, seed=42):  # noqa: N803  (MLlib's names)
        super().__init__()
        self._setDefault(gamma=1.0, size=256, seed=42)
        self._set(**{k: v for k, v in self._input_kwargs.items() if v is not None})

    def _transform(self, dataset: DataFrame) -> DataFrame:
        gamma, size, seed = self.getOrDefault(self.gamma), self.getOrDefault(self.size), self.getOrDefault(self.seed)

        @F.pandas_udf("array<double>")
        def made(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
            along = shift = None
            for batch in batches:
                x = np.array(batch.tolist(), float).reshape(len(batch), -1)
                if along is None and len(batch):
                    rng = np.random.default_rng(seed)
                    along, shift = rng.standard_normal((x.shape[1], size)) * np.sqrt(2 * gamma), rng.random(size) * 2 * np.pi
                yield pd.Series(list(np.cos(x @ along + shift) * np.sqrt(2 / size)) if len(batch) else [])

        return dataset.withColumn(self.getOutputCol(), array_to_vector(made(vector_to_array(self.getInputCol()))))


def _nearest(sent, k: int, metric: str):
    """A function of vectors: the k nearest of a block of training rows, by (distance to nine digits, label)."""

    @F.pandas_udf("array<struct<d:double,y:double>>")
    def nearest(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        points, labels = sent.value
        for batch in batches:
            out = []
            for v in batch:
                away = np.abs(points - np.asarray(v, float))
                d = {"euclidean": lambda a: np.sqrt((a * a).sum(1)), "manhattan": lambda a: a.sum(1), "chebyshev": lambda a: a.max(1)}[metric](away).round(9)
                best = np.lexsort((labels, d))[:k]
                out.append([{"d": float(d[i]), "y": float(labels[i])} for i in best])
            yield pd.Series(out)

    return nearest


class _NearestParams(HasFeaturesCol, HasLabelCol, HasPredictionCol):
    k = Param(Params._dummy(), "k", "neighbours that vote", TypeConverters.toInt)
    weights = Param(Params._dummy(), "weights", "uniform, or distance: by its inverse", TypeConverters.toString)
    metric = Param(Params._dummy(), "metric", "euclidean, manhattan or chebyshev", TypeConverters.toString)

    def __init__(self, *args):
        super().__init__(*args)
        self._setDefault(k=5, weights="uniform", metric="euclidean", featuresCol="features", labelCol="label", predictionCol="prediction")


class NearestNeighbours(Estimator, _NearestParams, DefaultParamsReadable, DefaultParamsWritable):
    """Exact vote of the k nearest training rows; ties in distance go to the smaller label, ties in votes too."""

    @keyword_only
    def __init__(self, *, k=5, weights="uniform", metric="euclidean", featuresCol="features", labelCol="label", predictionCol="prediction"):  # noqa: N803
        super().__init__()
        self._set(**self._input_kwargs)

    def _fit(self, dataset: DataFrame) -> NearestModel:
        rows = dataset.select(vector_to_array(self.getFeaturesCol()).alias("x"), F.col(self.getLabelCol()).cast("double").alias("y"))
        return self._copyValues(NearestModel(rows))


class NearestModel(Model, _NearestParams, MLWritable, MLReadable):
    """The training rows (x array<double>, y double). Rows to be told are scanned once for each block of training rows and never shuffled."""

    def __init__(self, rows: DataFrame | None = None):
        super().__init__()
        self.rows = rows

    def _blocks(self) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        held, labels = [], []
        for r in self.rows.dropna().toLocalIterator():
            held.append(r["x"])
            labels.append(r["y"])
            if 8 * len(held) * len(held[0]) >= BLOCK_BYTES:
                yield np.array(held), np.array(labels)
                held, labels = [], []
        if held:
            yield np.array(held), np.array(labels)

    def _transform(self, dataset: DataFrame) -> DataFrame:
        k, metric = self.getOrDefault(self.k), self.getOrDefault(self.metric)
        inverse = self.getOrDefault(self.weights) == "distance"
        if metric not in ("euclidean", "manhattan", "chebyshev"):
            raise ValueError(f"unknown metric {metric}")
        x = vector_to_array(self.getFeaturesCol())
        near = [_nearest(dataset.sparkSession.sparkContext.broadcast(block), k, metric)(x) for block in self._blocks()]  # each of BLOCK_BYTES
        if not near:
            return dataset.withColumn(self.getPredictionCol(), F.lit(None).cast("double"))
        best = F.slice(F.array_sort(F.concat(*near)), 1, k)
        exact = F.exists("_near", lambda n: n["d"] == 0)
        weight = (lambda n: F.when(exact, (n["d"] == 0).cast("double")).otherwise(1 / n["d"])) if inverse else (lambda n: F.lit(1.0))
        votes = lambda y: F.aggregate(F.filter("_near", lambda n: n["y"] == y), F.lit(0.0), lambda s, n: s + weight(n))
        top = F.array_min(F.transform(F.array_distinct(F.transform("_near", lambda n: n["y"])), lambda y: F.struct((-votes(y)).alias("v"), y.alias("y"))))
        return dataset.withColumn("_near", best).withColumn(self.getPredictionCol(), top["y"]).drop("_near")

    def copy(self, extra=None) -> NearestModel:
        made = super().copy(extra)
        made.rows = self.rows
        return made

    def write(self) -> MLWriter:
        return _NearestWriter(self)

    @classmethod
    def read(cls) -> MLReader:
        return _NearestReader(cls)


class _NearestWriter(MLWriter):
    def __init__(self, model: NearestModel):
        super().__init__()
        self.model = model

    def saveImpl(self, path: str) -> None:  # noqa: N802
        DefaultParamsWriter.saveMetadata(self.model, path, self.sparkSession)
        self.model.rows.write.parquet(f"{path}/rows")


class _NearestReader(MLReader):
    def __init__(self, cls: type):
        super().__init__()
        self.cls = cls

    def load(self, path: str) -> NearestModel:
        metadata = DefaultParamsReader.loadMetadata(path, self.sparkSession)
        model = self.cls(self.sparkSession.read.parquet(f"{path}/rows"))
        model._resetUid(metadata["uid"])
        DefaultParamsReader.getAndSetParams(model, metadata)
        return model
