"""Private Bayesian-network synthesis: describe a table, learn a network, sample rows.

Each attribute becomes small integer codes; all pairs' joint counts come from one
shuffle, conditionals from one aggregation per network edge set, and rows are
sampled by joins of spark.range() with the conditional tables. The privacy
budget is split explicitly and sums to epsilon.
"""

from __future__ import annotations

import json
import math
from dataclasses import asdict, dataclass, field
from itertools import combinations
from pathlib import Path

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from netquill.operators import clean
from netquill.sources import tables

BINS, CATEGORICAL = 20, 20


@dataclass(frozen=True)
class Attribute:
    """bins: categories in order, or left edges of equal-width bins; the code len(bins) means missing."""

    name: str
    kind: str
    categorical: bool
    candidate_key: bool
    low: float | None
    high: float | None
    missing_rate: float
    bins: list = field(default_factory=list)
    probabilities: list[float] = field(default_factory=list)


@dataclass(frozen=True)
class Description:
    rows: int
    attributes: list[Attribute]
    edges: list[tuple[str, list[str]]] = field(default_factory=list)
    epsilon: float = 0.0
    spent: dict[str, float] = field(default_factory=dict)

    def get(self, name: str) -> Attribute:
        return next(a for a in self.attributes if a.name == name)

    def dumps(self) -> str:
        return json.dumps(asdict(self), default=str)

    def save(self, path: str) -> None:
        Path(path).write_text(self.dumps())

    @staticmethod
    def load(path: str) -> Description:
        return Description.loads(Path(path).read_text())

    @staticmethod
    def loads(text: str) -> Description:
        d = json.loads(text)
        return Description(d["rows"], [Attribute(**a) for a in d["attributes"]], [(c, list(p)) for c, p in d["edges"]], d["epsilon"], d["spent"])


def number_of(df: DataFrame, name: str) -> Column:
    """What an attribute is binned by: its number, its epoch seconds, or its text's length."""
    kind = dict(df.dtypes)[name]
    if kind == "string":
        return F.length(name).cast("double")
    return F.unix_timestamp(F.col(name).cast("timestamp")).cast("double") if kind.startswith(("timestamp", "date")) else F.col(name).cast("double")


def describe(df: DataFrame, bins: int = BINS, categorical_at_most: int = CATEGORICAL, categorical: list[str] | None = None) -> Description:
    """Random mode: types, keys, roles and domains of each attribute; columns that are all null are dropped."""
    facts = {r["column"]: r for r in clean.column_facts(df, categorical_at_most).collect()}
    kept = [c for c in df.columns if facts[c].missing_rate is None or facts[c].missing_rate < 1]
    types = {r["column"]: r["type"] for r in clean.infer_types(df.select(*kept)).collect()}
    edges = df.agg(*[f(number_of(df, c)).alias(f"{c}|{k}") for c in kept for k, f in (("lo", F.min), ("hi", F.max))]).first()
    out = []
    chosen = [c for c in kept if (c in categorical if categorical is not None else facts[c].is_categorical)]
    values = df.agg(*[F.sort_array(F.collect_set(F.col(c).cast("string") if dict(df.dtypes)[c] in ("boolean",) or dict(df.dtypes)[c].startswith(("timestamp", "date")) else F.col(c))).alias(c) for c in chosen]).first() if chosen else {}
    for c in kept:
        lo, hi = edges[f"{c}|lo"], edges[f"{c}|hi"]
        cats = list(values[c]) if c in chosen else None
        width = ((hi - lo) / bins if hi > lo else 1.0) if cats is None and lo is not None else None
        edge = cats if cats is not None else [lo + i * width for i in range(bins if hi > lo else 1)] if lo is not None else []
        out.append(Attribute(c, types[c], cats is not None, bool(facts[c].is_candidate_key), lo, hi, float(facts[c].missing_rate or 0.0), edge, [1 / len(edge)] * len(edge) if edge else []))
    return Description(int(next(iter(facts.values())).n_rows), out)


def encode(df: DataFrame, d: Description, names: list[str] | None = None) -> DataFrame:
    """Codes of the named attributes: place of the category, or of the last edge not above the value; missing is the number of bins."""

    def code(a: Attribute) -> Column:
        n = len(a.bins)
        if a.categorical:
            at = F.array_position(F.array(*[F.lit(v) for v in a.bins]), F.col(a.name) if not isinstance(a.bins[0], str) else F.col(a.name).cast("string")).cast("int") - 1
            return F.coalesce(F.when(at >= 0, at), F.lit(n))
        x = number_of(df, a.name)
        edges = F.array(*[F.lit(float(b)) for b in a.bins])
        return F.when(x.isNull(), n).otherwise(F.greatest(F.size(F.filter(edges, lambda e: e <= x)) - 1, F.lit(0)))

    return df.select(*[code(d.get(c)).cast("int").alias(c) for c in names or [a.name for a in d.attributes]])


def laplace(u: Column, scale: float) -> Column:
    """A Laplace number from u in (0, 1)."""
    v = u - 0.5
    return -F.lit(scale) * F.signum(v) * F.log(F.greatest(1 - 2 * F.abs(v), F.lit(1e-300)))


def noise_draw(seed: int, *cols: str) -> Column:
    """A number in (0, 1) from the cell's key, the same at any partitioning."""
    return (F.shiftrightunsigned(F.xxhash64(F.lit(seed), *cols), 11).cast("double") + 0.5) / F.lit(float(1 << 53))


def marginals(codes: DataFrame, d: Description, epsilon: float = 0.0, seed: int = 0) -> DataFrame:
    """(attribute, code, probability); with epsilon, Laplace noise of scale (2 / n) / (epsilon / m) on each share, cut at 0, renormalised."""
    names = codes.columns
    n = F.array(*[F.struct(F.lit(c).alias("attribute"), F.col(c).alias("code")) for c in names])
    counts = codes.select(F.explode(n).alias("x")).select("x.*").groupBy("attribute", "code").agg(F.count("*").alias("n"))
    grid = codes.sparkSession.createDataFrame([(c, i) for c in names for i in range(len(d.get(c).bins) + (d.get(c).missing_rate > 0))], "attribute string, code int")
    share = F.coalesce("n", F.lit(0)) / F.lit(max(1, d.rows))
    if epsilon > 0:
        share = F.greatest(share + laplace(noise_draw(seed, "attribute", "code"), 2 / max(1, d.rows) / (epsilon / len(names))), F.lit(0.0))
    full = grid.join(counts, ["attribute", "code"], "left").select("attribute", "code", share.alias("p"))
    total = full.groupBy("attribute").agg(F.sum("p").alias("t"))
    return full.join(total, "attribute").select("attribute", "code", F.when(F.col("t") > 0, F.col("p") / F.col("t")).otherwise(F.lit(0.0)).alias("probability"))


def mutual_informations(codes: DataFrame, children: list[str], parents: list[tuple[str, ...]], rows: int) -> dict[tuple[str, tuple[str, ...]], float]:
    """I(child; parents) in nats for each pair, from one exploded aggregation of joint counts."""
    asks = [(c, p) for c in children for p in parents if c not in p]
    if not asks:
        return {}
    cells = F.array(*[F.struct(F.lit(i).alias("ask"), F.col(c).alias("x"), F.concat_ws("|", *[F.col(q).cast("string") for q in p]).alias("y")) for i, (c, p) in enumerate(asks)])
    joint = codes.select(F.explode(cells).alias("e")).select("e.*").groupBy("ask", "x", "y").agg(F.count("*").cast("double").alias("n"))
    gx = joint.groupBy("ask", "x").agg(F.sum("n").alias("nx"))
    gy = joint.groupBy("ask", "y").agg(F.sum("n").alias("ny"))
    mi = joint.join(gx, ["ask", "x"]).join(gy, ["ask", "y"]).groupBy("ask").agg(F.sum(F.col("n") / rows * F.log(F.col("n") * rows / (F.col("nx") * F.col("ny")))).alias("mi"))
    return {asks[r.ask]: float(r.mi) for r in mi.collect()}


def sensitivity(rows: int) -> float:
    """Of mutual information under change of one row."""
    n = max(2, rows)
    return 2 / n * math.log((n + 1) / 2) + (n - 1) / n * math.log((n + 1) / (n - 1))


def learn_network(codes: DataFrame, rows: int, parents: int = 1, epsilon: float = 0.0, seed: int = 0) -> list[tuple[str, list[str]]]:
    """[(child, parents)] in order of sampling: each step adds the attribute whose parents tell most of it, or draws it by the exponential mechanism."""
    rng = np.random.default_rng(seed)
    names = sorted(codes.columns)
    first = names[int(rng.integers(len(names)))] if epsilon > 0 else names[0]
    done, edges, known = [first], [(first, [])], {}
    while len(done) < len(names):
        sets = [p for k in range(1, min(parents, len(done)) + 1) for p in combinations(done, k) if k == min(parents, len(done))]
        fresh = [p for p in sets if p not in known.get("sets", set())]
        known.setdefault("sets", set()).update(fresh)
        known.update(mutual_informations(codes, [c for c in names if c not in done], fresh, rows))
        options = [(c, p) for c in names if c not in done for p in sets]
        scores = np.array([known[o] for o in options])
        if epsilon > 0:
            z = scores * (epsilon / (len(names) - 1)) / (2 * sensitivity(rows))
            w = np.exp(z - z.max())
            pick = options[int(rng.choice(len(options), p=w / w.sum()))]
        else:
            pick = min(options, key=lambda o: (-known[o], o))
        edges.append((pick[0], list(pick[1])))
        done.append(pick[0])
    return edges


def conditionals(codes: DataFrame, edges: list[tuple[str, list[str]]], sizes: dict[str, int], epsilon: float = 0.0, seed: int = 0) -> DataFrame:
    """(child, parents string, code, probability): each network entry's table, with Laplace noise on counts where epsilon is given."""
    out = None
    for i, (c, ps) in enumerate(edges):
        key = F.concat_ws("|", *[F.col(p).cast("string") for p in ps]) if ps else F.lit("")
        n = codes.groupBy(key.alias("parents"), F.col(c).alias("code")).agg(F.count("*").cast("double").alias("n"))
        if epsilon > 0:
            every = codes.sparkSession.createDataFrame([(x,) for x in range(sizes[c])], "code int")
            grid = n.select("parents").distinct().crossJoin(F.broadcast(every))
            scale = 2 / (epsilon / len(edges))
            n = grid.join(n, ["parents", "code"], "left").select("parents", "code", F.greatest(F.coalesce("n", F.lit(0.0)) + laplace(noise_draw(seed + i + 1, "parents", "code"), scale), F.lit(0.0)).alias("n"))
        total = n.groupBy("parents").agg(F.sum("n").alias("t"))
        one = n.join(total, "parents").select(F.lit(c).alias("child"), "parents", "code", F.when(F.col("t") > 0, F.col("n") / F.col("t")).otherwise(1.0 / sizes[c]).alias("probability"))
        out = one if out is None else out.union(one)
    return out


def uniform(seed: int, salt: str) -> Column:
    """A number in [0, 1) from the row's id, the same at any partitioning."""
    return (F.shiftrightunsigned(F.xxhash64("id", F.lit(f"{seed}|{salt}")), 11).cast("double") + 0.5) / F.lit(float(1 << 53))


def _cumulative(table: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, codes array, sums array) for inverse sampling; a table of at most the product of bin numbers."""
    rows = table.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct("code", "probability"))).alias("x"))
    sums = F.transform(F.sequence(F.lit(1), F.size("x")), lambda i: F.aggregate(F.slice("x", 1, i), F.lit(0.0), lambda acc, v: acc + v.probability))
    return rows.select(*keys, F.transform("x", lambda v: v.code).alias("codes"), sums.alias("sums"))


def _drawn(u: Column) -> Column:
    at = F.size(F.filter("sums", lambda s: s <= u))
    return F.get("codes", F.least(at, F.size("codes") - 1))


def sample_codes(spark: SparkSession, n: int, edges: list[tuple[str, list[str]]], tables: DataFrame, marginal: DataFrame, seed: int = 0) -> DataFrame:
    """(id, one code column per attribute) of exactly n rows, parents before children; a parent combination that was never seen falls back to the marginal."""
    out = spark.range(n)
    for c, ps in edges:
        own = _cumulative(tables.where(F.col("child") == c).select("parents", "code", "probability"), ["parents"])
        rest = _cumulative(marginal.where(F.col("attribute") == c).select("attribute", "code", "probability"), ["attribute"]).select(F.col("codes").alias("m_codes"), F.col("sums").alias("m_sums"))
        key = F.concat_ws("|", *[F.col(p).cast("string") for p in ps]) if ps else F.lit("")
        out = out.withColumn("parents", key).join(own, "parents", "left").crossJoin(F.broadcast(rest))
        out = out.withColumn("codes", F.coalesce("codes", "m_codes")).withColumn("sums", F.coalesce("sums", "m_sums")).withColumn(c, _drawn(uniform(seed, c))).drop("parents", "codes", "sums", "m_codes", "m_sums")
    return out


def sample_independent(spark: SparkSession, n: int, marginal: DataFrame, names: list[str], seed: int = 0) -> DataFrame:
    return sample_codes(spark, n, [(c, []) for c in names], marginal.select(F.col("attribute").alias("child"), F.lit("").alias("parents"), "code", "probability"), marginal, seed)


def decode(codes: DataFrame, d: Description, seed: int = 0) -> DataFrame:
    """Values: the category, or a uniform draw within the bin; integers are rounded, texts get the drawn length, times are epoch seconds."""

    def value(a: Attribute) -> Column:
        code, n = F.col(a.name), len(a.bins)
        if a.categorical:
            got = F.get(F.array(*[F.lit(v) for v in a.bins]), code)
        else:
            width = (a.bins[1] - a.bins[0]) if n > 1 else 0.0
            got = F.get(F.array(*[F.lit(float(b)) for b in a.bins]), code) + F.lit(float(width)) * uniform(seed, f"{a.name}/in")
            if a.kind in ("Integer", "DateTime", "SocialSecurityNumber"):
                got = F.round(got).cast("long")
            elif a.kind == "String":
                got = F.rpad(F.md5(F.concat_ws("|", F.lit(a.name), F.col("id").cast("string")).cast("binary")), F.round(got).cast("int"), "x")
        return F.when(code < n, got).alias(a.name)

    return codes.select("id", *[value(a) for a in d.attributes if a.name in codes.columns])


def sample_random(spark: SparkSession, n: int, d: Description, seed: int = 0) -> DataFrame:
    """Random mode: every attribute uniform over its categories or its range."""
    codes = spark.range(n)
    for a in d.attributes:
        codes = codes.withColumn(a.name, F.floor(uniform(seed, a.name) * max(1, len(a.bins))).cast("int"))
    return decode(codes, d, seed)


def candidate_keys(spark: SparkSession, n: int, d: Description, seed: int = 0) -> DataFrame:
    """(id, distinct values for each candidate key): counted, spread over the range, numbered texts, or shuffled nine-digit numbers."""
    out = spark.range(n)
    for a in d.attributes:
        if a.candidate_key:
            if a.kind == "Float" or a.kind == "DateTime":
                v = F.lit(float(a.low or 0)) + F.col("id") * F.lit(((a.high or 0) - (a.low or 0)) / max(1, n))
                v = v.cast("long") if a.kind == "DateTime" else v
            elif a.kind == "String":
                v = F.concat(F.substring(F.md5(F.lit(f"{seed}|{a.name}").cast("binary")), 1, 4), F.col("id").cast("string"))
            elif a.kind == "SocialSecurityNumber":
                v = F.pmod(F.col("id") * 387_420_489 + seed, F.lit(999_999_937)) + 1  # a prime modulus: no value twice
            else:
                v = F.col("id")
            out = out.withColumn(a.name, v)
    return out


def learn(df: DataFrame, parents: int = 1, epsilon: float = 0.0, seed: int = 0, **how) -> tuple[Description, DataFrame, DataFrame]:
    """Correlated mode: (description, conditional tables, marginals). epsilon is split into thirds: network, conditionals, marginals."""
    d = describe(df, **how)
    names = [a.name for a in d.attributes if not a.candidate_key and a.bins]
    codes = tables.written(encode(df, d, names))
    part = epsilon / 3
    edges = learn_network(codes, d.rows, parents, part, seed)
    sizes = {c: len(d.get(c).bins) + (d.get(c).missing_rate > 0) for c in names}
    given = conditionals(codes, edges, sizes, part, seed)
    spent = {k: part for k in ("network", "conditionals", "marginals")}
    return Description(d.rows, d.attributes, edges, epsilon, spent), given, marginals(codes, d, part, seed)


def synthesise(df: DataFrame, rows: int | None = None, parents: int = 1, epsilon: float = 2.0, seed: int = 0, ips: list[str] = (), **how) -> DataFrame:
    """End to end: addresses to numbers, learn, sample the same number of rows, decode."""
    from netquill.operators.transforms import ip_to_number, number_to_ip

    df = df.withColumns({c: ip_to_number(F.col(c)) for c in ips}) if ips else df
    d, given, marginal = learn(df, parents, epsilon, seed, **how)
    out = decode(sample_codes(df.sparkSession, rows or d.rows, d.edges, given, marginal, seed), d, seed)
    keys = candidate_keys(df.sparkSession, rows or d.rows, d, seed)
    out = out.join(keys, "id") if len(keys.columns) > 1 else out
    out = out.withColumns({c: number_to_ip(F.col(c).cast("long")) for c in ips}) if ips else out
    return out.select(*[c for c in df.columns if c in out.columns])


def adjacency(spark: SparkSession, edges: list[tuple[str, list[str]]], expanded: dict[str, list[str]]) -> DataFrame:
    """(parent, child) of expanded columns; expanded maps an attribute to its columns."""
    rows = [(p2, c2) for c, ps in edges for p in ps for p2 in expanded.get(p, [p]) for c2 in expanded.get(c, [c])]
    return spark.createDataFrame(rows, "parent string, child string")
