"""Anomaly models on feature columns."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.ml import Pipeline
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import PCA, Imputer, StandardScaler, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def _scaled(columns: list[str]) -> list:
    named = [f"{c}_in" for c in columns]
    return [Imputer(strategy="median", inputCols=columns, outputCols=named, relativeError=0.0), VectorAssembler(inputCols=named, outputCol="raw_features"), StandardScaler(withMean=True, inputCol="raw_features", outputCol="features")]


def _typed(df: DataFrame, columns: list[str]) -> DataFrame:
    return df.withColumns({c: F.col(c).cast("double") for c in columns})


def logistic_scores(train: DataFrame, test: DataFrame, columns: list[str], c: float = 0.25, l1: bool = False) -> DataFrame:
    """Balanced logistic regression: median imputation, standardisation, L2 (or L1) of strength 1 / (c * weight); adds ``score``."""
    n = train.agg(F.count_if(F.col("label") == 1).alias("p"), F.count_if(F.col("label") == 0).alias("q")).first()
    if not n.p or not n.q:
        raise ValueError("both classes are needed")
    total = n.p + n.q
    weighted = _typed(train, columns).where(F.col("label").isin(0, 1)).withColumn("weight", F.when(F.col("label") == 1, total / (2.0 * n.p)).otherwise(total / (2.0 * n.q)))
    model = Pipeline(stages=[*_scaled(columns), LogisticRegression(weightCol="weight", regParam=1 / (c * total), elasticNetParam=float(l1), standardization=False)]).fit(weighted)
    return model.transform(_typed(test, columns)).withColumn("score", vector_to_array("probability")[1]).select(*test.columns, "score")


def pca_scores(normal: DataFrame, test: DataFrame, columns: list[str], k: int = 10) -> DataFrame:
    """Squared reconstruction error off the principal axes of normal rows; adds ``score``."""
    n = normal.count()
    k = max(1, min(n - 1, len(columns), k))
    model = Pipeline(stages=[*_scaled(columns), PCA(k=k, inputCol="features", outputCol="axes")]).fit(_typed(normal, columns))
    axes = model.stages[-1].pc.toArray()

    @F.pandas_udf("double")
    def error(x: pd.Series) -> pd.Series:
        m = np.stack(x.to_numpy())
        return pd.Series(((m - m @ axes @ axes.T) ** 2).sum(1))

    return model.transform(_typed(test, columns)).withColumn("score", error(vector_to_array("features"))).select(*test.columns, "score")


def _path(n: float) -> float:
    """Mean path length of an unsuccessful search among n."""
    return 0.0 if n <= 1 else 1.0 if n == 2 else 2 * (np.log(n - 1) + 0.5772156649) - 2 * (n - 1) / n


def _grow(x: np.ndarray, rng: np.random.Generator, left: int):
    if left == 0 or len(x) <= 1 or (x == x[0]).all():
        return _path(len(x))
    spread = np.flatnonzero(x.max(0) > x.min(0))
    f = int(rng.choice(spread))
    cut = rng.uniform(x[:, f].min(), x[:, f].max())
    low = x[:, f] < cut
    return f, cut, _grow(x[low], rng, left - 1), _grow(x[~low], rng, left - 1)


def _depth(tree, x: np.ndarray, depth: int = 0) -> np.ndarray:
    if not isinstance(tree, tuple):
        return np.full(len(x), depth + tree)
    out, low = np.empty(len(x)), x[:, tree[0]] < tree[1]
    out[low], out[~low] = _depth(tree[2], x[low], depth + 1), _depth(tree[3], x[~low], depth + 1)
    return out


def isolation_forest_scores(normal: DataFrame, test: DataFrame, columns: list[str], trees: int = 200, rows: int = 256, seed: int = 7) -> DataFrame:
    """Isolation forest (Liu et al., 2008): each tree sees at most ``rows`` rows of a bounded sample, drawn by a hash of ``event_id``; adds ``score``, larger is odder."""
    sample = _typed(normal, columns).select(*columns, F.xxhash64("event_id").alias("h")).orderBy("h").limit(rows * 40).select(*columns).toPandas().to_numpy(float)
    sample = np.nan_to_num(sample)
    rng = np.random.default_rng(seed)
    size = min(rows, len(sample))
    forest = [_grow(sample[rng.choice(len(sample), size, replace=False)], rng, int(np.ceil(np.log2(max(size, 2))))) for _ in range(trees)]

    @F.pandas_udf("double")
    def oddness(*cols: pd.Series) -> pd.Series:
        x = np.nan_to_num(np.stack([c.to_numpy(float) for c in cols], 1))
        return pd.Series(2 ** (-np.mean([_depth(t, x) for t in forest], 0) / max(_path(size), 1e-9)))

    return test.withColumn("score", oddness(*(F.col(c).cast("double") for c in columns)))
