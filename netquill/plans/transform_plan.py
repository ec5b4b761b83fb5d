"""Turns a transform configuration into fitted steps, and runs them forward and back.

{"transforms": {"custom": [{"method": .., "columns": [..]}], "default": [{"method": ..}]}}:
custom lists come first, then each default method on the continuous columns that
no custom list names, in order; categoricals are one-hot encoded last.
"""

from __future__ import annotations

import json
from dataclasses import dataclass
from pathlib import Path

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from netquill.operators import transforms as T
from netquill.operators.mixture import Mixture, fit_mixture

#: Each method as the simple methods it is made of.
METHODS = {
    "standard": ["standard"], "minmax": ["minmax"], "robust": ["robust"], "log": ["log"], "GMM": ["GMM"], "bits": ["bits"],
    "GMM_log": ["log", "GMM"], "log_GMM": ["log", "GMM"], "log_robust": ["log", "robust"], "log_minmax": ["log", "minmax"], "log_minmax_GMM": ["log", "minmax", "GMM"],
}


@dataclass(frozen=True)
class Prepared:
    """A transformed table, its fitted steps, and what the columns are."""

    data: DataFrame
    steps: list[T.Step]
    columns: list[str]
    continuous: list[str]
    categories: dict[str, int]


def _fit(method: str, df: DataFrame, columns: list[str], epsilon: float) -> T.Step:
    if method == "log":
        return T.Log(list(columns), epsilon)
    if method == "bits":
        return T.Bits(list(columns))
    fits = {"standard": T.fit_standard, "minmax": T.fit_minmax, "robust": T.fit_robust, "GMM": fit_mixture}
    return fits[method](df, list(columns))


def prepare(df: DataFrame, continuous: list[str], categorical: list[str], config: dict | None = None, epsilon: float = T.EPSILON) -> Prepared:
    """Without a configuration the table comes back as it is, categoricals too."""
    spec = (config or {}).get("transforms") or {}
    if not spec:
        return Prepared(df, [], df.columns, list(continuous), {})
    custom = [(x["method"], [c for c in x["columns"] if c in df.columns]) for x in spec.get("custom", [])]
    named = {c for _, cs in custom for c in cs}
    rest = [c for c in continuous if c not in named and c not in categorical]
    jobs = custom + [(x["method"], rest) for x in spec.get("default", [])]
    steps, out, hot = [], df, list(categorical)
    for method, cols in jobs:
        if method not in METHODS:
            raise ValueError(f"unknown transform: {method}")
        for simple in METHODS[method] if cols else []:
            step = _fit(simple, out, cols, epsilon)
            out = step.forward(out)
            steps.append(step)
            if isinstance(step, Mixture):
                hot += [f"{c}__component" for c in step.means]
            elif isinstance(step, T.Bits):
                hot += [f"{c}__bit{i}" for c in step.columns for i in range(step.width)]
    hot = [c for c in hot if c in out.columns]
    if hot:
        step = T.fit_onehot(out, hot)
        out = step.forward(out)
        steps.append(step)
    sizes = {c: len(v) for c, v in steps[-1].categories.items()} if hot else {}
    flags = {n for c in sizes for n in steps[-1].names(c)}
    return Prepared(out, steps, df.columns, [c for c in out.columns if c not in flags], sizes)


def restore(df: DataFrame, steps: list[T.Step], columns: list[str]) -> DataFrame:
    """The original columns, in order."""
    for step in reversed(steps):
        df = step.inverse(df)
    return df.select(*columns)


def export(df: DataFrame, kind: str = "float") -> DataFrame:
    return df.select(*[F.col(c).cast(kind).alias(c) for c in df.columns])


def save_steps(steps: list[T.Step], columns: list[str], path: str) -> None:
    Path(path).write_text(json.dumps({"columns": columns, "steps": [s.to_dict() for s in steps]}))


def load_steps(path: str) -> tuple[list[T.Step], list[str]]:
    d = json.loads(Path(path).read_text())
    return [T.Step.from_dict(s) for s in d["steps"]], d["columns"]
