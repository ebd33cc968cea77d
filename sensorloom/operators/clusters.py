"""Clusters and projections of sensors and points, with Spark's own models."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml.clustering import KMeans
from pyspark.ml.feature import PCA, StandardScaler, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SENSOR_FEATURES = ("Anomaly_Pct", "Num_Events", "Peak_RZ", "Max_DTW_Dist", "Z_Points", "ISO_Points", "DTW_Points")


def scaled(df: DataFrame, features: Sequence[str], out: str = "scaled", fit_on: DataFrame | None = None) -> DataFrame:
    """A vector of the features with mean 0 and deviation 1; nulls, NaN and infinity count as 0."""

    def clean(x: DataFrame) -> DataFrame:
        value = lambda c: F.col(c).cast("double")
        ready = x.withColumns({f"_{c}": F.coalesce(F.when(~F.isnan(value(c)) & (F.abs(value(c)) != float("inf")), value(c)), F.lit(0.0)) for c in features})
        return VectorAssembler(inputCols=[f"_{c}" for c in features], outputCol="_raw").transform(ready).drop(*[f"_{c}" for c in features])

    rows = clean(df)
    model = StandardScaler(inputCol="_raw", outputCol=out, withMean=True, withStd=True).fit(rows if fit_on is None else clean(fit_on))
    return model.transform(rows).drop("_raw")


def clustered(df: DataFrame, features: Sequence[str], *, k: int = 3, seed: int = 42, fit_on: DataFrame | None = None, out: str = "Cluster") -> DataFrame:
    """KMeans over the scaled features, fitted on ``fit_on`` if given. No more clusters than rows; one row or none: cluster 0."""
    base = df if fit_on is None else fit_on
    k = min(k, base.limit(k).count())
    if k <= 1:
        return df.withColumn(out, F.lit(0))
    train = scaled(base, features, fit_on=base)
    model = KMeans(k=k, seed=seed, featuresCol="scaled", predictionCol=out).fit(train)
    return model.transform(scaled(df, features, fit_on=base)).drop("scaled")


def projected(df: DataFrame, features: Sequence[str], *, fit_on: DataFrame | None = None) -> DataFrame:
    """Adds ``PC1`` and ``PC2``, the first two principal components of the scaled features; their signs are arbitrary."""
    base = df if fit_on is None else fit_on
    model = PCA(k=2, inputCol="scaled", outputCol="_pc").fit(scaled(base, features, fit_on=base))
    rows = model.transform(scaled(df, features, fit_on=base))
    pc = vector_to_array("_pc")
    return rows.withColumns({"PC1": pc[0], "PC2": pc[1]}).drop("_pc", "scaled")
