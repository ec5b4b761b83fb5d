"""Elastic sketch: a heavy part of voted buckets and a light part of small counters.

Its content depends on the order of arrival, so one group (a column, or a column
and shard) is walked in a stated order by a grouped pandas map; sketches of
shards are merged afterwards. Order: the given key, or that of first sight.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SLOTS, LAMBDA, TOP = 8, 8, 255


class Elastic:
    """buckets of SLOTS (key, votes, flag); light counters that stop at TOP."""

    def __init__(self, buckets: int = 3, light: int = 195):
        self.buckets: list[dict[str, list]] = [{} for _ in range(buckets)]
        self.against = [0] * buckets
        self.light = np.zeros(light, np.int64)

    def _at(self, x: str, seed: int, n: int) -> int:
        return xxhash.xxh64_intdigest(x.encode(), seed) % n

    def _add_light(self, x: str, n: int) -> None:
        i = self._at(x, 2, len(self.light))
        self.light[i] = min(TOP, self.light[i] + n)

    def insert(self, x: str, n: int = 1) -> None:
        b = self._at(x, 1, len(self.buckets))
        slots = self.buckets[b]
        if x in slots:
            slots[x][0] += n
        elif len(slots) < SLOTS:
            slots[x] = [n, False]
        else:
            self.against[b] += n
            low = min(slots, key=lambda k: (slots[k][0], k))
            if self.against[b] >= LAMBDA * slots[low][0]:
                votes, _ = slots.pop(low)
                i = self._at(low, 2, len(self.light))
                self.light[i] = max(self.light[i], min(TOP, votes))  # a swapped key keeps the greater count
                slots[x] = [n, True]
                self.against[b] = 0
            else:
                self._add_light(x, n)

    def query(self, x: str) -> int:
        slot = self.buckets[self._at(x, 1, len(self.buckets))].get(x)
        light = int(self.light[self._at(x, 2, len(self.light))])
        return light if slot is None else slot[0] + (light if slot[1] else 0)

    def heavy(self) -> list[tuple[str, int]]:
        return [(k, self.query(k)) for b in self.buckets for k in b]

    def space(self) -> int:
        """Bytes: 4 for a key, 4 for votes and flag, 4 for the votes against; 1 for a counter."""
        return len(self.buckets) * (SLOTS * 8 + 4) + len(self.light)

    def largest(self) -> int:
        return max([n for _, n in self.heavy()], default=0)

    def cardinality(self) -> float:
        """Linear counting on the light part, and heavy keys that were never in it."""
        m, zeros = len(self.light), int((self.light == 0).sum())
        return (m * math.log(m / zeros) if zeros else float(m)) + sum(not f for b in self.buckets for _, f in b.values())

    def distribution(self, epochs: int = 10) -> np.ndarray:
        """Estimated number of keys of each size, by expectation maximisation over counters that hold one or two keys."""
        counters = np.bincount(self.light, minlength=TOP + 1).astype(float)
        m, size = len(self.light), TOP + 1
        n = np.maximum(counters, 0)
        n[0] = 0
        for _ in range(epochs):
            load = n.sum() / m
            share = n / max(n.sum(), 1e-12)
            new = np.zeros(size)
            for v in np.flatnonzero(counters[1:]) + 1:
                one = load * share[v]
                j = np.arange(1, v)
                two = load * load / 2 * share[j] * share[v - j]
                total = one + two.sum()
                if total <= 0:
                    new[v] += counters[v]
                    continue
                new[v] += counters[v] * one / total
                np.add.at(new, j, counters[v] * two / total)
                np.add.at(new, v - j, counters[v] * two / total)
            n = new
        for _, k in self.heavy():
            if k >= len(n):
                n = np.append(n, np.zeros(k + 1 - len(n)))
            n[k] += 1
        return n

    def pmf(self) -> np.ndarray:
        n = self.distribution()
        return n / max(n.sum(), 1e-12)

    def cdf(self) -> np.ndarray:
        return np.cumsum(self.pmf())

    def entropy(self, base: float = math.e) -> float:
        """Of the rows' keys: sum over sizes k of n_k * -(k / t) log(k / t)."""
        n = self.distribution()
        k = np.arange(len(n))
        t = float((n * k).sum())
        ok = (n > 0) & (k > 0)
        return float(-(n[ok] * k[ok] / t * np.log(k[ok] / t)).sum() / math.log(base)) if t else 0.0


def elastic_summaries(df: DataFrame, columns: list[str], order: str, buckets: int = 3, light: int = 195) -> DataFrame:
    """(column, cardinality, entropy, largest, space): one sketch per column, columns in parallel.

    The sketch depends on the order of its rows, so a column's rows are walked in
    order by one task, batch by batch; memory is the sketch's.
    """
    cells = F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).cast("string").alias("value")) for c in columns])
    rows = df.select(F.col(order).alias("o"), F.explode(cells).alias("x")).select("x.column", "o", "x.value").where("value is not null")

    def walk(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        name, sketch = None, None

        def out():
            return pd.DataFrame({"column": [name], "cardinality": [sketch.cardinality()], "entropy": [sketch.entropy()], "largest": [sketch.largest()], "space": [sketch.space()]})

        for pdf in parts:
            for c, v in zip(pdf["column"], pdf["value"]):
                if c != name:
                    if sketch is not None:
                        yield out()
                    name, sketch = c, Elastic(buckets, light)
                sketch.insert(v)
        if sketch is not None:
            yield out()

    ordered = rows.repartition("column").sortWithinPartitions("column", "o", "value").select("column", "value")
    return ordered.mapInPandas(walk, "column string, cardinality double, entropy double, largest long, space long")
