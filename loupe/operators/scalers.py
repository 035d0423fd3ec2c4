"""Scalers (C1-C6) on the ``features`` vector, fitted on training rows only.

Statistics come from one ``Summarizer`` aggregate (tree-aggregated, d doubles per task).
Two deliberate differences from Spark's own scalers, to keep the reference's results:
standard scaling divides by the population std and leaves constant columns unscaled; min-max
maps a constant column to 0, not 0.5.
"""

from __future__ import annotations

import numpy as np
from pyspark.ml.feature import Binarizer, ElementwiseProduct, MaxAbsScaler, Normalizer
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.linalg import Vectors
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

FEATURES = "features"
SCALERS = {"NOS": "No scaling", "STA": "Standard scaler", "MIX": "Min-max scaler", "MAX": "Max-absolute scaler",
           "NRM": "Normalizer", "BIN": "Binarizer"}


class FittedScaler:
    def __init__(self, fn):
        self.fn = fn

    def transform(self, df: DataFrame) -> DataFrame:
        return self.fn(df)


def _swap(df: DataFrame, tmp: str) -> DataFrame:
    return df.drop(FEATURES).withColumnRenamed(tmp, FEATURES)


def fit_scaler(code: str, train: DataFrame) -> FittedScaler:
    if code == "NOS":
        return FittedScaler(lambda d: d)
    if code == "STA":
        s = train.agg(Summarizer.metrics("variance", "count").summary(F.col(FEATURES)).alias("s")).first()["s"]
        n = float(s["count"])
        std = np.sqrt(s["variance"].toArray() * (n - 1) / n) if n > 1 else np.zeros(len(s["variance"]))
        scale = np.where(std > 0, 1.0 / np.where(std > 0, std, 1.0), 1.0)
        ep = ElementwiseProduct(scalingVec=Vectors.dense(scale), inputCol=FEATURES, outputCol="_scaled")
        return FittedScaler(lambda d: _swap(ep.transform(d), "_scaled"))
    if code == "MIX":
        s = train.agg(Summarizer.metrics("min", "max").summary(F.col(FEATURES)).alias("s")).first()["s"]
        lo, hi = s["min"].toArray(), s["max"].toArray()
        rng = hi - lo
        scale = np.where(rng > 0, 1.0 / np.where(rng > 0, rng, 1.0), 1.0)
        lo_a = F.array(*[F.lit(float(v)) for v in lo])
        sc_a = F.array(*[F.lit(float(v)) for v in scale])

        def mix(d: DataFrame) -> DataFrame:
            x = vector_to_array(F.col(FEATURES))
            y = F.zip_with(F.zip_with(x, lo_a, lambda a, b: a - b), sc_a, lambda a, b: a * b)
            return d.withColumn(FEATURES, array_to_vector(y))
        return FittedScaler(mix)
    if code == "MAX":
        m = MaxAbsScaler(inputCol=FEATURES, outputCol="_scaled").fit(train)
        return FittedScaler(lambda d: _swap(m.transform(d), "_scaled"))
    if code == "NRM":
        nz = Normalizer(inputCol=FEATURES, outputCol="_scaled", p=2.0)
        return FittedScaler(lambda d: _swap(nz.transform(d), "_scaled"))
    if code == "BIN":
        b = Binarizer(threshold=0.0, inputCol=FEATURES, outputCol="_scaled")
        return FittedScaler(lambda d: _swap(b.transform(d), "_scaled"))
    raise KeyError(code)
