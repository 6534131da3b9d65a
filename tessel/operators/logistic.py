"""Logistic regression by full-batch descent: gradients and curvatures are summed in tasks, the driver holds the weights."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessel.session import settle


def fit(rows: DataFrame, features: list[str], label: str, l2: float = 1e-2, steps: int = 100, tolerance: float = 1e-12) -> tuple[np.ndarray, float, int]:
    """Weights by feature, bias, and steps taken, of mean log loss + l2 / 2 * |w|^2 on standardized features.

    Features have mean 0 and deviation 1 (the population's; a constant one stays), the bias isn't penalized, the weights
    are given back for features as they are. Each step is one pass over ``rows``; its size is halved until the loss falls.
    Rows with a null are left out.
    """
    held = settle(rows.select(*[F.col(c).cast("double").alias(c) for c in [*features, label]]).dropna(), "fit-rows")
    first = held.agg(F.count("*"), *[f(c) for c in features for f in (F.avg, F.stddev_pop)]).first()
    n, d = first[0], len(features)
    if n == 0:
        return np.zeros(d), 0.0, 0
    mean, deviation = np.array(first[1::2]), np.array(first[2::2])
    deviation = np.where(deviation < 1e-9, 1.0, deviation)
    w = np.zeros(d + 1)  # the bias last
    loss, gradient, curvature = _sums(held, features, label, mean, deviation, w, n, l2)
    for step in range(steps):
        if np.abs(gradient).max() < tolerance:
            return w[:-1] / deviation, float(w[-1] - (w[:-1] * mean / deviation).sum()), step
        move = np.linalg.solve(curvature + 1e-12 * np.eye(d + 1), gradient)
        for _ in range(30):
            found = _sums(held, features, label, mean, deviation, w - move, n, l2)
            if found[0] <= loss + 1e-15:
                break
            move = move / 2
        w, (loss, gradient, curvature) = w - move, found
    return w[:-1] / deviation, float(w[-1] - (w[:-1] * mean / deviation).sum()), steps


def _sums(held: DataFrame, features: list[str], label: str, mean: np.ndarray, deviation: np.ndarray, w: np.ndarray, n: int, l2: float) -> tuple[float, np.ndarray, np.ndarray]:
    """Loss, gradient and curvature at w: a row of sums from each task."""
    d = len(w)

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = np.zeros(1 + d + d * d)
        for b in batches:
            x = np.stack([*((b.column(c).to_numpy() - m) / s for c, m, s in zip(features, mean, deviation, strict=True)), np.ones(b.num_rows)], 1)
            y, z = b.column(label).to_numpy(), x @ w
            p = 1 / (1 + np.exp(-np.clip(z, -500, 500)))
            out += np.concatenate([[(np.logaddexp(0, z) - y * z).sum()], x.T @ (p - y), ((x * (p * (1 - p))[:, None]).T @ x).ravel()])
        yield pa.RecordBatch.from_arrays([pa.array([out.tolist()], pa.list_(pa.float64()))], ["sums"])

    each = held.mapInArrow(sums, "sums array<double>")
    total = np.array(each.agg(*[F.sum(F.get("sums", F.lit(i))) for i in range(1 + d + d * d)]).first(), float)
    penalty = np.append(np.full(d - 1, l2), 0.0)
    return total[0] / n + (penalty * w * w).sum() / 2, total[1 : 1 + d] / n + penalty * w, total[1 + d :].reshape(d, d) / n + np.diag(penalty)
