"""Risk with its uncertainty: a small network whose weights are Gaussians, fitted by gradients that tasks sum.

A step draws one noise for all rows; tasks sum the gradient and loss of their rows, Spark sums those by place, and a few hundred
numbers reach the driver, however many rows there are. The training table is written once and read by each step. Rows with a null
feature or label teach nothing; rows to score with a null feature have null results."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.scratch import released, written
from .risk import risk_band

ROWS_AT_ONCE = 512


@dataclass(frozen=True)
class Shape:
    """Places of a flat array of weights: in to hidden, hidden bias, hidden to out, out bias."""

    n: int
    hidden: int

    @property
    def size(self) -> int:
        return self.n * self.hidden + 2 * self.hidden + 1

    def parts(self, w: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """The four parts of one array of weights, or of many on a first axis."""
        a, b = self.n * self.hidden, (self.n + 1) * self.hidden
        lead = w.shape[:-1]
        return w[..., :a].reshape(*lead, self.n, self.hidden), w[..., a:b], w[..., b : b + self.hidden], w[..., -1]


@dataclass(frozen=True)
class Fit:
    features: tuple[str, ...]
    shape: Shape
    mean: np.ndarray
    deviation: np.ndarray
    losses: tuple[float, ...]

    def drawn(self, draws: int, seed: int) -> np.ndarray:
        """Weights of each draw, one row each."""
        return self.mean + self.deviation * np.random.default_rng(seed).normal(size=(draws, self.shape.size))


def probabilities(shape: Shape, weights: np.ndarray, x: np.ndarray) -> np.ndarray:
    """A row for each row of x, a column for each row of weights."""
    first, bias, last, out = shape.parts(weights)
    h = np.maximum(np.einsum("rn,dnh->rdh", x, first, optimize=True) + bias, 0)
    return 1 / (1 + np.exp(-np.clip(np.einsum("rdh,dh->rd", h, last, optimize=True) + out, -30, 30)))


def gradient(shape: Shape, w: np.ndarray, x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Sums over rows: the gradient of the negative log likelihood by each weight, then the loss and the number of rows."""
    first, bias, last, out = shape.parts(w)
    a = x @ first + bias
    h = np.maximum(a, 0)
    z = np.clip(h @ last + out, -30, 30)
    wrong = 1 / (1 + np.exp(-z)) - y
    back = np.outer(wrong, last) * (a > 0)
    loss = np.sum(np.logaddexp(0, z) - y * z)
    return np.concatenate([(x.T @ back).ravel(), back.sum(0), h.T @ wrong, [wrong.sum(), loss, len(y)]])


def _summed(rows: DataFrame, features: list[str], shape: Shape, w: np.ndarray) -> np.ndarray:
    """gradient() over all rows: one array leaves each task, one number for each place reaches the driver."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros(shape.size + 2)
        for f in frames:
            total += gradient(shape, w, f[features].to_numpy(float), f["_y"].to_numpy(float))
        yield pd.DataFrame({"g": [total.tolist()]})

    placed = rows.mapInPandas(run, "g array<double>").select(F.posexplode("g").alias("at", "v"))
    out = np.zeros(shape.size + 2)
    for r in placed.groupBy("at").agg(F.sum("v").alias("v")).collect():
        out[r["at"]] = r["v"]
    return out


def fit(train: DataFrame, features: list[str], label: str, hidden: int = 8, steps: int = 80, patience: int = 20, rate: float = 0.1, seed: int = 7) -> Fit:
    """A posterior over the network's weights, by back-propagation through samples of them under a unit Gaussian prior.

    Every row of train counts in every step; fitting stops after `patience` steps without a better loss."""
    known = train.dropna(subset=[*features, label])
    rows = written(known.select(*[F.col(f).cast("double").alias(f) for f in features], F.col(label).cast("double").alias("_y")), "train")
    shape, rng = Shape(len(features), hidden), np.random.default_rng(seed)
    value = np.concatenate([rng.normal(0, 0.3, shape.size), np.full(shape.size, -3.0)])  # means, then softplus-inverse deviations
    first, second, losses = np.zeros_like(value), np.zeros_like(value), []
    best, since, kept = float("inf"), 0, value.copy()
    for t in range(1, steps + 1):
        mean, rho = value[: shape.size], value[shape.size :]
        deviation, noise = np.logaddexp(0, rho), rng.normal(size=shape.size)
        *sums, loss, n = _summed(rows, features, shape, mean + deviation * noise)
        if not n:
            break
        g = np.array(sums) / n
        by_rho = (g * noise + (deviation - 1 / deviation) / n) / (1 + np.exp(-rho))
        g = np.concatenate([g + mean / n, by_rho])
        losses.append(loss / n)
        if losses[-1] < best - 1e-4:
            best, since, kept = losses[-1], 0, value.copy()
        elif (since := since + 1) >= patience:
            break
        first, second = 0.9 * first + 0.1 * g, 0.999 * second + 0.001 * g**2
        value = value - rate * (first / (1 - 0.9**t)) / (np.sqrt(second / (1 - 0.999**t)) + 1e-8)
    released(rows)
    return Fit(tuple(features), shape, kept[: shape.size], np.logaddexp(0, kept[shape.size :]), tuple(losses))


def posterior_draws(model: Fit, rows: DataFrame, key: str, draws: int = 500, seed: int = 11) -> DataFrame:
    """key, draw, probability in long form: `draws` rows for each row, for those who want the draws themselves."""
    features, shape, weights = list(model.features), model.shape, model.drawn(draws, seed)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for at in range(0, len(frame), ROWS_AT_ONCE):
                part = frame.iloc[at : at + ROWS_AT_ONCE]
                p = probabilities(shape, weights, part[features].to_numpy(float))
                yield pd.DataFrame({key: part[key].repeat(draws).to_numpy(), "draw": np.tile(np.arange(draws), len(part)), "probability": p.ravel()})

    return rows.select(key, *features).mapInPandas(run, f"`{key}` {rows.schema[key].dataType.simpleString()}, draw int, probability double")


def posterior_summary(model: Fit, rows: DataFrame, key: str, draws: int = 500, seed: int = 11) -> DataFrame:
    """key, n_draws, mean, std, q05, q95, band: the draws of a row are made and summed up where the row is, one row out for each."""
    features, shape, weights = list(model.features), model.shape, model.drawn(draws, seed)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for at in range(0, len(frame), ROWS_AT_ONCE):
                part = frame.iloc[at : at + ROWS_AT_ONCE]
                p = probabilities(shape, weights, part[features].to_numpy(float))
                low, high = np.percentile(p, [5, 95], axis=1)
                yield pd.DataFrame({key: part[key].to_numpy(), "n_draws": draws, "mean": p.mean(1), "std": p.std(1), "q05": low, "q95": high})

    kind = rows.schema[key].dataType.simpleString()
    out = rows.select(key, *features).mapInPandas(run, f"`{key}` {kind}, n_draws long, mean double, std double, q05 double, q95 double")
    return out.withColumn("band", risk_band(F.col("mean")))
