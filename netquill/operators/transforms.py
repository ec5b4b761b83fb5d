"""Invertible column transforms: fitted parameters are frozen values, steps are column expressions.

A fitted step holds all it needs, so an unfitted one cannot exist. plan() in
netquill.plans.transform_plan folds the steps of a table into few projections.
"""

from __future__ import annotations

from dataclasses import asdict, dataclass, field
from typing import ClassVar

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from netquill.operators import ranges
from netquill.operators.clean import melt_numbers

EPSILON = 1e-6
STEPS: dict[str, type] = {}


def _step(cls):
    STEPS[cls.kind] = cls
    return cls


@dataclass(frozen=True)
class Step:
    """One fitted transform of some columns."""

    kind: ClassVar[str] = ""

    def forward(self, df: DataFrame) -> DataFrame:
        raise NotImplementedError

    def inverse(self, df: DataFrame) -> DataFrame:
        raise NotImplementedError

    def to_dict(self) -> dict:
        return {"kind": self.kind, **asdict(self)}

    @staticmethod
    def from_dict(d: dict) -> Step:
        return STEPS[d["kind"]](**{k: v for k, v in d.items() if k != "kind"})


@_step
@dataclass(frozen=True)
class Affine(Step):
    """(x - shift) / scale for each column; standard, min-max and robust scaling are of this form."""

    kind: ClassVar[str] = "affine"
    shift: dict[str, float]
    scale: dict[str, float]

    def forward(self, df):
        return df.withColumns({c: (F.col(c) - F.lit(self.shift[c])) / F.lit(self.scale[c]) for c in self.shift})

    def inverse(self, df):
        return df.withColumns({c: F.col(c) * F.lit(self.scale[c]) + F.lit(self.shift[c]) for c in self.shift})


def _fit(df: DataFrame, columns: list[str], shift, scale) -> Affine:
    row = df.agg(*[f(F.col(c).cast("double")).alias(f"{k}|{c}") for c in columns for k, f in (("a", shift), ("b", scale))]).first()
    use = lambda x: 1.0 if x is None or x == 0 else float(x)  # noqa: E731  a constant column keeps its scale
    return Affine({c: float(row[f"a|{c}"] or 0.0) for c in columns}, {c: use(row[f"b|{c}"]) for c in columns})


def fit_standard(df: DataFrame, columns: list[str]) -> Affine:
    """By mean and population standard deviation."""
    return _fit(df, columns, F.avg, F.stddev_pop)


def fit_minmax(df: DataFrame, columns: list[str]) -> Affine:
    """To [0, 1]; a constant column becomes 0."""
    return _fit(df, columns, F.min, lambda c: F.max(c) - F.min(c))


def fit_robust(df: DataFrame, columns: list[str]) -> Affine:
    """By median and interquartile range, exact, from value counts."""
    counts = melt_numbers(df, columns).where("value is not null").groupBy("column", "value").agg(F.count("*").alias("n"))
    q = {r["column"]: r.q for r in ranges.quantiles(counts, ["column"], "value", "n", [0.25, 0.5, 0.75]).collect()}
    wide = {c: q[c][2] - q[c][0] if c in q else 0.0 for c in columns}
    return Affine({c: q[c][1] if c in q else 0.0 for c in columns}, {c: wide[c] or 1.0 for c in columns})


@_step
@dataclass(frozen=True)
class Log(Step):
    kind: ClassVar[str] = "log"
    columns: list[str]
    epsilon: float = EPSILON

    def forward(self, df):
        return df.withColumns({c: F.log(F.col(c) + F.lit(self.epsilon)) for c in self.columns})

    def inverse(self, df):
        return df.withColumns({c: F.exp(F.col(c)) - F.lit(self.epsilon) for c in self.columns})


@_step
@dataclass(frozen=True)
class OneHot(Step):
    """A 0/1 column for each sorted category, ahead of the other columns; values unseen when fitting get zeros and decode to null."""

    kind: ClassVar[str] = "onehot"
    categories: dict[str, list]
    integral: list[str] = field(default_factory=list)

    def names(self, c: str) -> list[str]:
        return [f"{c}__{i}" for i in range(len(self.categories[c]))]

    def forward(self, df):
        hot = [F.coalesce((F.col(c) == F.lit(v)).cast("int"), F.lit(0)).alias(n) for c, vs in self.categories.items() for n, v in zip(self.names(c), vs)]
        return df.select(*hot, *[c for c in df.columns if c not in self.categories])

    def inverse(self, df):
        def back(c: str) -> Column:
            flags = F.array(*[F.col(n).cast("double") for n in self.names(c)])
            best = F.array_max(flags)
            return F.when(best > 0, F.get(F.array(*[F.lit(v) for v in self.categories[c]]), (F.array_position(flags, best) - 1).cast("int"))).alias(c)

        own = {n for c in self.categories for n in self.names(c)}
        return df.select(*[c for c in df.columns if c not in own], *[back(c) for c in self.categories])


def fit_onehot(df: DataFrame, columns: list[str]) -> OneHot:
    """Categories in sorted order, from one aggregation over all columns."""
    row = df.agg(*[F.sort_array(F.collect_set(c)).alias(c) for c in columns]).first() if columns else {}
    return OneHot({c: list(row[c]) for c in columns})


@_step
@dataclass(frozen=True)
class Bits(Step):
    """c__bit0 (lowest) and so on, for integers from 0 to 2**width - 1."""

    kind: ClassVar[str] = "bits"
    columns: list[str]
    width: int = 32

    def forward(self, df):
        bits = {f"{c}__bit{i}": F.shiftright(F.col(c).cast("long"), i).bitwiseAND(1).cast("int") for c in self.columns for i in range(self.width)}
        return df.withColumns(bits).drop(*self.columns)

    def inverse(self, df):
        whole = {c: sum((F.col(f"{c}__bit{i}").cast("long") * F.lit(1 << i) for i in range(self.width)), F.lit(0).cast("long")) for c in self.columns}
        return df.withColumns(whole).drop(*[f"{c}__bit{i}" for c in self.columns for i in range(self.width)])


def ip_to_number(c: Column) -> Column:
    """Dotted IPv4 text as a number to base 256."""
    return F.aggregate(F.split(c, "[.]"), F.lit(0).cast("long"), lambda acc, x: acc * 256 + x.cast("long"))


def number_to_ip(c: Column) -> Column:
    return F.concat_ws(".", *[F.shiftright(c, s).bitwiseAND(255).cast("string") for s in (24, 16, 8, 0)])
