"""A small variational autoencoder in numpy: trained in passes over all rows, decoding in parallel.

Each epoch deals all rows to partitions at random and streams them to the
driver, which holds one partition at a time. Generation is exact in number and
repeatable, as each row's latent numbers come from its id.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass, replace

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from netquill.operators.clean import to_type
from netquill.plans.transform_plan import Prepared, prepare, restore


def privacy_spent(noise: float, share: float, steps: int, delta: float) -> float:
    """epsilon of steps rounds of Gaussian noise (times the clip) on a random share of the rows, by Renyi accounting over whole orders."""
    if noise <= 0:
        return math.inf
    best = math.inf
    for order in range(2, 129):
        if share >= 1:
            one = order / (2 * noise**2)
        else:  # sum over how many of order rows are drawn
            terms = [math.lgamma(order + 1) - math.lgamma(k + 1) - math.lgamma(order - k + 1) + k * math.log(share) + (order - k) * math.log1p(-share) + k * (k - 1) / (2 * noise**2) for k in range(order + 1)]
            top = max(terms)
            one = (top + math.log(sum(math.exp(t - top) for t in terms))) / (order - 1)
        best = min(best, steps * one + math.log1p(-1 / order) - math.log(delta * order) / (order - 1))
    return max(best, 0.0)


def noise_for(epsilon: float, delta: float, share: float, steps: int) -> float:
    """The least noise, to 0.1 %, that keeps within (epsilon, delta)."""
    low, high = 1e-2, 1.0
    while privacy_spent(high, share, steps, delta) > epsilon:
        high *= 2
    while high / low > 1.001:
        mid = math.sqrt(low * high)
        low, high = (mid, high) if privacy_spent(mid, share, steps, delta) > epsilon else (low, mid)
    return high


@dataclass(frozen=True)
class Settings:
    hidden: int = 64
    latent: int = 8
    epochs: int = 30
    batch: int = 256
    rate: float = 1e-3
    beta: float = 0.2
    patience: int = 5
    clip: float | None = None
    noise: float = 0.0
    epsilon: float | None = None
    delta: float = 1e-5
    covariance: float = 0.0
    seed: int = 0


class Autoencoder:
    """Two hidden layers each way; Gaussian likelihood for numbers, softmax for each block of flags.

    covariance: weight of the squared gap between a batch's covariance and that
    of what is decoded from it. clip and noise: each row's gradient is cut to that norm and Gaussian noise of
    noise * clip is added to the sum (DP-SGD). With epsilon, train() finds the noise
    that all epochs together may need to stay within (epsilon, delta).
    """

    def __init__(self, width: int, blocks: list[tuple[int, int]], settings: Settings = Settings()):
        self.s, self.blocks = settings, blocks
        rng = np.random.default_rng(settings.seed)
        sizes = [(width, settings.hidden), (settings.hidden, settings.hidden), (settings.hidden, 2 * settings.latent), (settings.latent, settings.hidden), (settings.hidden, settings.hidden), (settings.hidden, width)]
        self.w = [rng.normal(0, np.sqrt(2 / a), (a, b)) for a, b in sizes]
        self.b = [np.zeros(b) for _, b in sizes]
        self.rng = rng

    def _decode(self, z: np.ndarray):
        h3 = np.maximum(z @ self.w[3] + self.b[3], 0)
        h4 = np.maximum(h3 @ self.w[4] + self.b[4], 0)
        return h3, h4, h4 @ self.w[5] + self.b[5]

    def _output(self, raw: np.ndarray) -> np.ndarray:
        out = raw.copy()
        for a, b in self.blocks:
            e = np.exp(out[:, a:b] - out[:, a:b].max(1, keepdims=True))
            out[:, a:b] = e / e.sum(1, keepdims=True)
        return out

    def _gradients(self, x: np.ndarray):
        n, k = len(x), self.s.latent
        h1 = np.maximum(x @ self.w[0] + self.b[0], 0)
        h2 = np.maximum(h1 @ self.w[1] + self.b[1], 0)
        mv = h2 @ self.w[2] + self.b[2]
        mu, lv = mv[:, :k], np.clip(mv[:, k:], -8, 8)
        eps = self.rng.normal(size=mu.shape)
        z = mu + eps * np.exp(lv / 2)
        h3, h4, raw = self._decode(z)
        out = self._output(raw)
        d5 = out - x
        loss = 0.5 * (d5**2).sum(1).mean()
        if self.s.covariance and n > 1:
            centred = out - out.mean(0)
            gap = centred.T @ centred / n - np.cov(x.T, bias=True).reshape(x.shape[1], -1)
            loss += self.s.covariance * float((gap**2).sum())
            d5 = d5 + 4 * self.s.covariance * centred @ gap
        layers = [None] * 6
        layers[5] = (h4, d5)
        d4 = (d5 @ self.w[5].T) * (h4 > 0)
        layers[4] = (h3, d4)
        d3 = (d4 @ self.w[4].T) * (h3 > 0)
        layers[3] = (z, d3)
        dz = d3 @ self.w[3].T
        dmv = np.concatenate((dz + self.s.beta * mu, dz * eps * np.exp(lv / 2) / 2 + self.s.beta * (np.exp(lv) - 1) / 2), axis=1)
        layers[2] = (h2, dmv)
        d2 = (dmv @ self.w[2].T) * (h2 > 0)
        layers[1] = (h1, d2)
        layers[0] = (x, (d2 @ self.w[1].T) * (h1 > 0))
        if self.s.clip:  # a row's gradient norm, without forming it
            norm = np.sqrt(sum((a**2).sum(1) * (d**2).sum(1) + (d**2).sum(1) for a, d in layers))
            scale = np.minimum(1, self.s.clip / np.maximum(norm, 1e-12))[:, None]
            layers = [(a, d * scale) for a, d in layers]
        grads = [(a.T @ d / n, d.sum(0) / n) for a, d in layers]
        if self.s.clip and self.s.noise:
            sigma = self.s.noise * self.s.clip / n
            grads = [(g + self.rng.normal(0, sigma, g.shape), h + self.rng.normal(0, sigma, h.shape)) for g, h in grads]
        return loss, grads

    def _batches(self, chunks: Iterable[np.ndarray]) -> Iterator[np.ndarray]:
        rest = None
        for x in chunks:
            x = x[self.rng.permutation(len(x))]
            x = x if rest is None else np.concatenate((rest, x))
            full = len(x) // self.s.batch * self.s.batch
            for i in range(0, full, self.s.batch):
                yield x[i : i + self.s.batch]
            rest = x[full:]
        if rest is not None and len(rest):
            yield rest

    def fit(self, chunks: Callable[[int], Iterable[np.ndarray]]) -> Autoencoder:
        """chunks(epoch): all rows, in parts. Adam; stops once the loss has not improved for patience epochs, and keeps the best weights."""
        m = [(np.zeros_like(w), np.zeros_like(b)) for w, b in zip(self.w, self.b)]
        v = [(np.zeros_like(w), np.zeros_like(b)) for w, b in zip(self.w, self.b)]
        step, best, kept, waited = 0, np.inf, None, 0
        for epoch in range(self.s.epochs):
            losses = []
            for x in self._batches(chunks(epoch)):
                loss, grads = self._gradients(x)
                losses.append(loss)
                step += 1
                for layer, pair in enumerate(grads):
                    for j, (target, g) in enumerate(zip((self.w[layer], self.b[layer]), pair)):
                        m[layer][j][...] = 0.9 * m[layer][j] + 0.1 * g
                        v[layer][j][...] = 0.999 * v[layer][j] + 0.001 * g * g
                        target -= self.s.rate * (m[layer][j] / (1 - 0.9**step)) / (np.sqrt(v[layer][j] / (1 - 0.999**step)) + 1e-8)
            if not losses:
                break
            mean = float(np.mean(losses))
            if mean < best - 1e-4:
                best, kept, waited = mean, ([w.copy() for w in self.w], [b.copy() for b in self.b]), 0
            else:
                waited += 1
                if waited >= self.s.patience:
                    break
        if kept:
            self.w, self.b = kept
        return self

    def generate(self, ids: np.ndarray) -> np.ndarray:
        z = np.stack([np.random.default_rng((self.s.seed, int(i))).normal(size=self.s.latent) for i in ids]) if len(ids) else np.zeros((0, self.s.latent))
        out = self._output(self._decode(z)[2])
        for a, b in self.blocks:  # one flag of each block
            at = out[:, a:b].argmax(1)
            out[:, a:b] = 0
            out[np.arange(len(out)), a + at] = 1
        return out


def stream(data: DataFrame, seed: int) -> Iterator[np.ndarray]:
    """All rows as arrays of doubles (null: 0), dealt to partitions at random, one partition at the driver at a time."""
    width = len(data.columns)
    dealt = data.repartition(data.sparkSession.sparkContext.defaultParallelism * 4, F.rand(seed))

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in parts:
            yield pd.DataFrame({"x": [np.nan_to_num(pdf.to_numpy(float)).tobytes()]})

    for r in dealt.mapInPandas(run, "x binary").toLocalIterator():
        yield np.frombuffer(r.x, float).reshape(-1, width)


def train(prepared: Prepared, settings: Settings = Settings()) -> Autoencoder:
    names, blocks, at = prepared.data.columns, [], 0
    for size in prepared.categories.values():
        blocks.append((at, at + size))
        at += size
    data = to_type(prepared.data).select(*[F.col(f"`{c}`") for c in names])
    if settings.epsilon is not None:
        n = max(1, data.count())
        steps = settings.epochs * -(-n // settings.batch)
        settings = replace(settings, clip=settings.clip or 1.0, noise=noise_for(settings.epsilon, settings.delta, min(1.0, settings.batch / n), steps))
    return Autoencoder(len(names), blocks, settings).fit(lambda epoch: stream(data, settings.seed + epoch))


def generate(spark: SparkSession, model: Autoencoder, prepared: Prepared, n: int, partitions: int | None = None) -> DataFrame:
    """Exactly n rows in the original columns."""
    names = prepared.data.columns
    shared = spark.sparkContext.broadcast(model)

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in parts:
            yield pd.DataFrame(shared.value.generate(pdf["id"].to_numpy()), columns=names)

    rows = spark.range(n, numPartitions=partitions) if partitions else spark.range(n)
    return restore(rows.mapInPandas(run, ", ".join(f"`{c}` double" for c in names)), prepared.steps, prepared.columns)


def synthesise(df: DataFrame, continuous: list[str], categorical: list[str], n: int, config: dict | None = None, settings: Settings = Settings()) -> DataFrame:
    """Prepare, train, generate, restore."""
    config = config or {"transforms": {"default": [{"method": "standard"}]}}
    ready = prepare(df.select(*continuous, *categorical), continuous, categorical, config)
    return generate(df.sparkSession, train(ready, settings), ready, n)
