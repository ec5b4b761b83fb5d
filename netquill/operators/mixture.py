"""One-dimensional Bayesian Gaussian mixtures per column, as an invertible transform.

Fitting runs once per column on fine bins of all rows inside a grouped pandas map
(columns in parallel); encoding and decoding are column expressions.
"""

from __future__ import annotations

import math
from dataclasses import dataclass
from typing import ClassVar

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from netquill.operators.clean import melt_numbers
from netquill.operators.transforms import Step, _step

COMPONENTS, PRIOR, LEAST_WEIGHT, BIN = 10, 0.001, 0.005, 1 / 1024
WIDTH, CLIP = 4.0, 0.99


def _digamma(x: np.ndarray) -> np.ndarray:
    out = np.zeros_like(x, dtype=float)
    x = np.array(x, float)
    while (x < 6).any():
        low = x < 6
        out[low] -= 1 / x[low]
        x[low] += 1
    i = 1 / (x * x)
    return out + np.log(x) - 0.5 / x - i * (1 / 12 - i * (1 / 120 - i / 252))


def fit_values(x: np.ndarray, components: int = COMPONENTS, prior: float = PRIOR, rounds: int = 200, seed: int = 0, times: np.ndarray | None = None, spread_in: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Weights, means and deviations by variational inference with a stick-breaking prior; weak components are dropped.

    times: how many values stand at each x; spread_in: their variance around it.
    """
    x = np.asarray(x, float)
    ok = np.isfinite(x)
    times = np.ones(len(x))[ok] if times is None else np.asarray(times, float)[ok]
    inner = np.zeros(len(x))[ok] if spread_in is None else np.maximum(np.asarray(spread_in, float)[ok], 0)
    x = x[ok]
    if not len(x):
        return np.ones(1), np.zeros(1), np.ones(1)
    total, centre = times.sum(), float(np.average(x, weights=times))
    k, spread = min(components, len(np.unique(x))), max(float(np.average((x - centre) ** 2 + inner, weights=times)), 1e-12)
    rng = np.random.default_rng(seed)
    means = [x[rng.choice(len(x), p=times / total)]]
    for _ in range(k - 1):  # k-means++ seeds, then a few Lloyd rounds
        d = np.min((x[:, None] - np.array(means)) ** 2, axis=1) * times
        means.append(x[rng.choice(len(x), p=d / d.sum())] if d.sum() > 0 else x[0])
    means = np.array(means)
    for _ in range(10):
        near = np.argmin(np.abs(x[:, None] - means), axis=1)
        means = np.array([np.average(x[near == j], weights=times[near == j]) if (near == j).any() else means[j] for j in range(k)])
    resp = np.eye(k)[np.argmin(np.abs(x[:, None] - means), axis=1)]
    last = -np.inf
    for _ in range(rounds):
        mass = resp * times[:, None]
        n = mass.sum(0) + 1e-10
        xbar = mass.T @ x / n
        s = np.maximum((mass * ((x[:, None] - xbar) ** 2 + inner[:, None])).sum(0) / n, 1e-12)
        a, b = 1 + n, prior + np.concatenate((np.cumsum(n[::-1])[::-1][1:], [0]))
        beta, nu = 1 + n, 1 + n
        m = (centre + n * xbar) / beta
        w = spread + n * s + n / beta * (xbar - centre) ** 2
        stick = _digamma(a) - _digamma(a + b)
        rest = np.concatenate(([0], np.cumsum(_digamma(b) - _digamma(a + b))[:-1]))
        log_precision = _digamma(nu / 2) + math.log(2) - np.log(w)
        logp = stick + rest + 0.5 * log_precision - 0.5 * (1 / beta + nu / w * ((x[:, None] - m) ** 2 + inner[:, None]))
        top = logp.max(1, keepdims=True)
        z = np.exp(logp - top)
        resp = z / z.sum(1, keepdims=True)
        score = float(np.average(top[:, 0] + np.log(z.sum(1)), weights=times))
        if abs(score - last) < 1e-6:
            break
        last = score
    weights = (resp * times[:, None]).sum(0) / total
    keep = weights > LEAST_WEIGHT
    keep[np.argmax(weights)] = True
    order = np.argsort(m[keep])
    return (weights[keep] / weights[keep].sum())[order], m[keep][order], np.sqrt(w / nu)[keep][order]


@_step
@dataclass(frozen=True)
class Mixture(Step):
    """c becomes c__normalized and c__component. seed None: the likeliest component; else one drawn by its posterior."""

    kind: ClassVar[str] = "mixture"
    weights: dict[str, list[float]]
    means: dict[str, list[float]]
    deviations: dict[str, list[float]]
    low: dict[str, float]
    high: dict[str, float]
    digits: dict[str, int | None]
    seed: int | None = None

    def _component(self, c: str) -> Column:
        x = F.col(c).cast("double")
        scores = []
        for k, (w, m, s) in enumerate(zip(self.weights[c], self.means[c], self.deviations[c])):
            logp = F.lit(math.log(w) - math.log(s)) - (x - F.lit(m)) * (x - F.lit(m)) / F.lit(2 * s * s)
            scores.append(logp if self.seed is None else logp - F.log(-F.log(F.rand(self.seed + 31 * k))))
        scores = F.array(*scores)
        return F.array_position(scores, F.array_max(scores)).cast("int") - 1

    def forward(self, df):
        df = df.withColumns({f"{c}__component": self._component(c) for c in self.means})
        arr = lambda v: F.array(*[F.lit(float(x)) for x in v])
        norm = {}
        for c in self.means:
            k = F.col(f"{c}__component")
            z = (F.col(c) - F.get(arr(self.means[c]), k)) / (F.lit(WIDTH) * F.get(arr(self.deviations[c]), k))
            norm[f"{c}__normalized"] = F.least(F.greatest(z, F.lit(-CLIP)), F.lit(CLIP))
        return df.withColumns(norm).drop(*self.means)

    def inverse(self, df):
        arr = lambda v: F.array(*[F.lit(float(x)) for x in v])
        out = {}
        for c in self.means:
            k = F.least(F.greatest(F.round(f"{c}__component").cast("int"), F.lit(0)), F.lit(len(self.means[c]) - 1))
            z = F.least(F.greatest(F.col(f"{c}__normalized"), F.lit(-1.0)), F.lit(1.0))
            x = z * F.lit(WIDTH) * F.get(arr(self.deviations[c]), k) + F.get(arr(self.means[c]), k)
            x = F.least(F.greatest(x, F.lit(self.low[c])), F.lit(self.high[c]))
            out[c] = x if self.digits[c] is None else F.round(x, self.digits[c])
        return df.withColumns(out).drop(*[f"{c}__{s}" for c in self.means for s in ("normalized", "component")])


def binned(df: DataFrame, columns: list[str], step: float = BIN) -> DataFrame:
    """(column, n, mean, var) of all finite values in bins that widen with their size: step wide about 0, a share step of it farther off."""
    cells = melt_numbers(df, columns).where("value is not null and not isnan(value) and abs(value) < double('inf')")
    at = F.floor(F.asinh("value") / F.lit(step)).cast("long")
    got = cells.groupBy("column", at.alias("bin")).agg(F.count("*").alias("n"), F.avg("value").alias("mean"), F.var_pop("value").alias("var"))
    return got.select("column", "n", "mean", "var")


def fit_mixture(df: DataFrame, columns: list[str], share: float = 1.0, components: int = COMPONENTS, seed: int = 0, draw_seed: int | None = None) -> Mixture:
    """Fits on the counts, means and variances of fine bins of all rows, so row order and partitioning don't matter.

    A column has some 100,000 bins at most, whatever its size. share: fit on a
    random part of the rows instead.
    """
    edges = df.agg(*[f(F.col(c).cast("double")).alias(f"{k}|{c}") for c in columns for k, f in (("lo", F.min), ("hi", F.max))], *[F.max((F.col(c).cast("double") != F.round(F.col(c).cast("double"), 0)).cast("int")).alias(f"frac|{c}") for c in columns]).first()
    rows = df.select(*columns)
    bins = binned(rows if share >= 1 else rows.sample(fraction=share, seed=seed), columns)

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("mean")
        w, m, s = fit_values(pdf["mean"].to_numpy(), components, seed=seed, times=pdf["n"].to_numpy(), spread_in=pdf["var"].to_numpy())
        return pd.DataFrame({"column": [pdf["column"].iloc[0]], "w": [w.tolist()], "m": [m.tolist()], "s": [s.tolist()]})

    got = bins.groupBy("column").applyInPandas(run, "column string, w array<double>, m array<double>, s array<double>").collect()
    by = {r["column"]: r for r in got}
    pick = lambda k, other: {c: list(by[c][k]) if c in by else other for c in columns}
    return Mixture(pick("w", [1.0]), pick("m", [0.0]), pick("s", [1.0]), {c: float(edges[f"lo|{c}"] or 0.0) for c in columns}, {c: float(edges[f"hi|{c}"] or 0.0) for c in columns}, {c: 0 if edges[f"frac|{c}"] == 0 else None for c in columns}, draw_seed)
