"""Low-dimensional views of embeddings."""

from __future__ import annotations

import numpy as np
from pyspark.ml.feature import PCA
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def principal_components(rows: DataFrame, key: str, column: str, k: int = 5) -> DataFrame:
    """``key, components`` (array of ``k``): centred first, each component's sign such that its largest loading is
    positive. Null embeddings are left out. The covariance is gathered by tree aggregation, its size that of the
    embedding, not of the rows."""
    data = rows.where(F.col(column).isNotNull()).select(key, array_to_vector(F.col(column).cast("array<double>")).alias("v"))
    mean = data.agg(Summarizer.mean(F.col("v")).alias("m")).first()["m"]
    if mean is None:
        return rows.sparkSession.createDataFrame([], f"`{key}` {dict(rows.dtypes)[key]}, components array<double>")
    loadings = PCA(k=k, inputCol="v", outputCol="p").fit(data).pc.toArray()
    loadings = loadings * np.sign(loadings[np.abs(loadings).argmax(0), np.arange(loadings.shape[1])])
    centre = F.array(*[F.lit(float(x)) for x in mean])
    axes = [F.array(*[F.lit(float(x)) for x in loadings[:, j]]) for j in range(loadings.shape[1])]
    centred = F.zip_with(vector_to_array("v"), centre, lambda a, b: a - b)

    def dot(axis):
        return F.aggregate(F.zip_with(F.col("c"), axis, lambda a, b: a * b), F.lit(0.0), lambda s, x: s + x)

    return data.select(key, centred.alias("c")).select(key, F.array(*[dot(a) for a in axes]).alias("components"))


def neighbour_map(points: np.ndarray, perplexity: float = 30.0, steps: int = 300, seed: int = 0) -> np.ndarray:
    """t-SNE in two dimensions for a few thousand points, after PCA; exact, on the driver."""
    n = len(points)
    d = ((points[:, None] - points[None]) ** 2).sum(-1)
    p = np.zeros((n, n))
    for i in range(n):
        low, high, beta = 0.0, np.inf, 1.0
        for _ in range(50):
            row = np.exp(-(d[i] - d[i][np.arange(n) != i].min()) * beta)
            row[i] = 0
            row /= row.sum()
            entropy = -(row[row > 0] * np.log(row[row > 0])).sum()
            if abs(entropy - np.log(min(perplexity, max(2, (n - 1) / 3)))) < 1e-4:
                break
            low, high = (beta, high) if entropy > np.log(min(perplexity, max(2, (n - 1) / 3))) else (low, beta)
            beta = beta * 2 if high == np.inf else (low + high) / 2
        p[i] = row
    p = np.maximum((p + p.T) / (2 * n), 1e-12)
    y, velocity = np.random.default_rng(seed).normal(0, 1e-4, (n, 2)), 0.0
    for step in range(steps):
        q = 1 / (1 + ((y[:, None] - y[None]) ** 2).sum(-1))
        np.fill_diagonal(q, 0)
        force = ((4.0 if step < 100 else 1.0) * p - q / q.sum()) * q
        gradient = 4 * (np.diag(force.sum(1)) - force) @ y
        velocity = (0.5 if step < 100 else 0.8) * velocity - max(n / 12, 50) * gradient
        y = y + velocity
    return y
