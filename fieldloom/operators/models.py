"""Models plug in as batch functions; no weights are part of this engine."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame, functions as F


def scorer(make: Callable[[], Callable[[np.ndarray], np.ndarray]], shapes: list[list[int]], batch_size: int = 64):
    """A column function over array columns from a model: `make` loads it once a worker and returns its batch function."""
    from pyspark.ml.functions import predict_batch_udf
    from pyspark.sql.types import DoubleType

    return predict_batch_udf(make, return_type=DoubleType(), batch_size=batch_size, input_tensor_shapes=shapes)


def stand_in() -> Callable[[np.ndarray], np.ndarray]:
    """A deterministic stand-in for a model, for tests of the plumbing. Its scores are not a model's results."""
    return lambda x: np.tanh(np.asarray(x, float).reshape(len(x), -1) @ np.cos(np.arange(np.asarray(x[0]).size)))


def kmeans(df: DataFrame, vector: str, k: int, seed: int = 42) -> DataFrame:
    """df with cluster."""
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.functions import array_to_vector

    v = df.withColumn("__v", array_to_vector(F.col(vector)))
    return KMeans(k=k, seed=seed, featuresCol="__v", predictionCol="cluster").fit(v).transform(v).drop("__v")


def pca(df: DataFrame, vector: str, k: int) -> DataFrame:
    """df with components: the centred vectors' first k principal coordinates."""
    from pyspark.ml.feature import PCA, StandardScaler
    from pyspark.ml.functions import array_to_vector, vector_to_array

    v = df.withColumn("__v", array_to_vector(F.col(vector)))
    v = StandardScaler(withMean=True, withStd=False, inputCol="__v", outputCol="__c").fit(v).transform(v)
    out = PCA(k=k, inputCol="__c", outputCol="__p").fit(v).transform(v)
    return out.withColumn("components", vector_to_array("__p")).drop("__v", "__c", "__p")
