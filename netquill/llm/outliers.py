"""Quality rules by robust multivariate outliers, in DataFrame operations only.

Each document becomes a vector of transformed statistics. Per language, and then
per language and source, the minimum-covariance-determinant estimate is sought
by concentration steps: the h nearest rows by Mahalanobis distance give the next
mean and covariance. Distances are counted in narrow bins, so the h-th smallest
is found from mergeable counts and no group is gathered or sorted. Of several
starts the least determinant wins; one reweighting step follows. A document
beyond the chi-squared quantile is rejected.
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from netquill.llm.common import let, stash, upto, words_of

SYMBOLS = "#*$%&|<>"
#: Least standard deviation of each statistic: what clean texts differ by anyway.
FLOORS = (0.3, 0.15, 0.3, 0.4, 0.06)
P = len(FLOORS)
#: Share of rows in the concentrated subset.
SUBSET = 0.75
#: Rows that the estimate above a group counts for in the group's own.
PRIOR_ROWS = 40.0
STEPS = 4
CUTOFF = 0.9999


def chi2_cdf(x: float, df: int) -> float:
    """For odd df."""
    term, total = 1.0, 0.0
    for k in range(1, (df - 1) // 2 + 1):
        total += term
        term *= x / (2 * k + 1)
    return math.erf(math.sqrt(x / 2)) - math.sqrt(2 * x / math.pi) * math.exp(-x / 2) * total


def chi2_quantile(q: float, df: int) -> float:
    lo, hi = 0.0, 1000.0
    for _ in range(100):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if chi2_cdf(mid, df) < q else (lo, mid)
    return lo


def consistency(share: float) -> float:
    """What the covariance of the nearest share of a normal sample has to be multiplied by."""
    return share / chi2_cdf(chi2_quantile(share, P), P + 2)


def _repeated(w: Column) -> Column:
    """Words that lie in a 5-word window found twice or more."""

    def covered(h: Column) -> Column:
        pairs = F.array_sort(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))
        twice = let(pairs, lambda s: F.filter(F.transform(s, lambda e, j: F.when((F.get(s, j - 1).h == e.h) | (F.get(s, j + 1).h == e.h), e.i)), lambda i: i.isNotNull()))
        gaps = let(F.array_sort(twice), lambda at: F.transform(at, lambda x, j: F.least(F.lit(5), F.coalesce(F.get(at, j + 1), x + 5) - x)))
        return F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0)).otherwise(F.aggregate(gaps, F.lit(0), lambda a, x: a + x))

    return let(F.transform(upto(F.size(w) - 4), lambda i: F.xxhash64(*[F.get(w, i + j) for j in range(5)])), covered)


def base_statistics(text: Column) -> Column:
    """Struct of n_words, word_chars, n_symbols, n_dup_lines and n_repeat_words (long)."""
    text = F.coalesce(text, F.lit(""))
    symbols = F.length(text) - F.length(F.regexp_replace(text, "[#*$%&|<>]+", ""))
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    of_words = let(words_of(text), lambda w: F.struct(F.size(w).alias("n"), F.length(F.array_join(w, "")).alias("c"), _repeated(w).alias("r")))
    return F.struct(of_words.alias("w"), symbols.cast("long").alias("n_symbols"), let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines"))


def _vector() -> list[Column]:
    n, c = F.col("n_words").cast("double"), F.col("word_chars").cast("double")
    return [F.log(n), F.log(c / n), F.log1p(F.lit(100.0) * F.col("n_symbols") / c), F.log1p(F.col("n_dup_lines").cast("double")), F.col("n_repeat_words") / n]


def _lower() -> list[tuple[int, int]]:
    return [(i, j) for i in range(P) for j in range(i + 1)]


def _cholesky(df: DataFrame) -> DataFrame:
    """Adds c_ij, the Cholesky factor of s_ij with the floors on its diagonal, and logdet."""
    for i, j in _lower():
        rest = reduce(lambda a, b: a - b, [F.col(f"c_{i}{k}") * F.col(f"c_{j}{k}") for k in range(j)], F.col(f"s_{i}{j}") + (F.lit(FLOORS[i] ** 2) if i == j else F.lit(0.0)))
        df = df.withColumn(f"c_{i}{j}", F.sqrt(F.greatest(rest, F.lit(1e-12))) if i == j else rest / F.col(f"c_{j}{j}"))
    return df.withColumn("logdet", reduce(lambda a, b: a + b, [F.log(F.col(f"c_{i}{i}")) for i in range(P)]))


def _distance(df: DataFrame) -> DataFrame:
    """Adds d2, the squared Mahalanobis distance, from x_i, m_i and c_ij."""
    for i in range(P):
        rest = reduce(lambda a, b: a - b, [F.col(f"c_{i}{k}") * F.col(f"z_{k}") for k in range(i)], F.col(f"x_{i}") - F.col(f"m_{i}"))
        df = df.withColumn(f"z_{i}", rest / F.col(f"c_{i}{i}"))
    return df.withColumn("d2", reduce(lambda a, b: a + b, [F.col(f"z_{i}") * F.col(f"z_{i}") for i in range(P)])).drop(*[f"z_{i}" for i in range(P)])


def _moments(rows: DataFrame, keys: list[str], prior: DataFrame | None, up: list[str], factor: float) -> DataFrame:
    """Mean and covariance of each group, blended with those of the group above it."""
    sums = [F.count("*").cast("double").alias("rows")] + [F.avg(f"x_{i}").alias(f"m_{i}") for i in range(P)] + [F.covar_pop(f"x_{i}", f"x_{j}").alias(f"s_{i}{j}") for i, j in _lower()]
    got = rows.groupBy(*keys).agg(*sums)
    got = got.select(*keys, "rows", *[f"m_{i}" for i in range(P)], *[(F.col(f"s_{i}{j}") * factor).alias(f"s_{i}{j}") for i, j in _lower()])
    if prior is not None:
        above = prior.select(*[F.col(k).alias(f"up_{k}") for k in up], *[F.col(f"m_{i}").alias(f"pm_{i}") for i in range(P)], *[F.col(f"s_{i}{j}").alias(f"ps_{i}{j}") for i, j in _lower()])
        got = got.join(above, reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"up_{k}")) for k in up], F.lit(True)), "left")
        blend = lambda own, other: ((F.col("rows") * own + F.lit(PRIOR_ROWS) * other) / (F.col("rows") + F.lit(PRIOR_ROWS)))
        got = got.select(*keys, "rows", *[blend(F.col(f"m_{i}"), F.col(f"pm_{i}")).alias(f"m_{i}") for i in range(P)], *[blend(F.col(f"s_{i}{j}"), F.col(f"ps_{i}{j}")).alias(f"s_{i}{j}") for i, j in _lower()])
    return got


def _join(rows: DataFrame, params: DataFrame, keys: list[str]) -> DataFrame:
    right = params.select(*[F.col(k).alias(f"of_{k}") for k in keys], *[c for c in params.columns if c not in keys and c != "rows"])
    on = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"of_{k}")) for k in keys], F.lit(True))
    return rows.join(right, on).drop(*[f"of_{k}" for k in keys])


def _bin(d2: Column) -> Column:
    """Bins of 1 % each."""
    return F.floor(F.log1p(d2) * 100).cast("int")


def mcd(rows: DataFrame, keys: list[str], starts: list[DataFrame], prior: DataFrame | None = None, up: list[str] = ()) -> DataFrame:
    """Reweighted MCD of each group of rows (x_0...): keys, m_i, s_ij, c_ij.

    starts: estimates to begin with, each with keys, m_i and s_ij.
    """
    at, got = [*keys, "start"], None
    now = reduce(DataFrame.unionByName, [s.select(*keys, *[f"m_{i}" for i in range(P)], *[f"s_{i}{j}" for i, j in _lower()], F.lit(k).alias("start")) for k, s in enumerate(starts)])
    now = stash(_cholesky(now), "start")
    for step in range(STEPS):
        far = _distance(_join(rows, now.withColumnRenamed("start", "begun"), keys).withColumnRenamed("begun", "start")).select(*at, *[f"x_{i}" for i in range(P)], _bin(F.col("d2")).alias("bin"))
        counts = far.groupBy(*at, "bin").agg(F.count("*").alias("k"))
        upto_bin = F.sum("k").over(Window.partitionBy(*at).orderBy("bin"))
        every = F.sum("k").over(Window.partitionBy(*at))
        limit = counts.select(*at, "bin", upto_bin.alias("below"), every.alias("n")).where(F.col("below") >= F.ceil(F.col("n") * SUBSET)).groupBy(*at).agg(F.min("bin").alias("limit"))
        near = _join(far, stash(limit, "limit"), at).where("bin <= limit")
        got = stash(_cholesky(_moments(near, at, prior, list(up), consistency(SUBSET))), "step")
        now = got
    best = got.withColumn("place", F.row_number().over(Window.partitionBy(*keys).orderBy("logdet", "start"))).where("place = 1").drop("place", "start")
    inside = _distance(_join(rows, best, keys)).where(F.col("d2") <= chi2_quantile(0.975, P)).select(*keys, *[f"x_{i}" for i in range(P)])
    last = stash(_cholesky(_moments(inside, keys, prior, list(up), consistency(0.975))), "reweighted")
    lost = best.join(last.select(*[F.col(k).alias(f"of_{k}") for k in keys]), reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"of_{k}")) for k in keys], F.lit(True)), "left_anti")
    return last.unionByName(lost.select(*last.columns))


def _medians(rows: DataFrame, keys: list[str]) -> DataFrame:
    """A start from each coordinate's median and MAD, from counts of values to 1/500."""

    def middle(df: DataFrame, name: str) -> DataFrame:
        counts = df.groupBy(*keys, "i", "b").agg(F.count("*").alias("k"))
        w = Window.partitionBy(*keys, "i")
        got = counts.select(*keys, "i", "b", F.sum("k").over(w.orderBy("b")).alias("below"), F.sum("k").over(w).alias("n"))
        return got.where("below * 2 >= n").groupBy(*keys, "i").agg((F.min("b") / 500.0).alias(name))

    long = rows.select(*keys, F.posexplode(F.array(*[f"x_{i}" for i in range(P)])).alias("i", "x"))
    med = stash(middle(long.withColumn("b", F.round(F.col("x") * 500).cast("long")), "med"), "medians")
    mad = middle(_join(long, med, [*keys, "i"]).withColumn("b", F.round(F.abs(F.col("x") - F.col("med")) * 500).cast("long")), "mad")
    both = _join(med, mad, [*keys, "i"])
    pick = lambda c, i: F.max(F.when(F.col("i") == i, F.col(c)))
    wide = both.groupBy(*keys).agg(*[pick("med", i).alias(f"m_{i}") for i in range(P)], *[pick("mad", i).alias(f"d_{i}") for i in range(P)])
    return wide.select(*keys, *[f"m_{i}" for i in range(P)], *[(F.pow(F.col(f"d_{i}") * 1.4826, 2) if i == j else F.lit(0.0)).alias(f"s_{i}{j}") for i, j in _lower()])


def quality_rules(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", source_col: str = "source", cutoff: float = CUTOFF) -> DataFrame:
    """(id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, d2, kept) for each row.

    Statistics are estimated over every row with a word. Null texts count as
    empty; rows without a word fail the base rules and have a null d2. Null
    languages and sources form groups of their own; a group of few rows leans on
    its language's estimate (PRIOR_ROWS). Repeated rows get equal results, null
    ids are allowed, other columns are left out, and an empty table gives an
    empty result.
    """
    s = docs.select(F.col(id_col).alias("id"), F.col(lang_col).alias("lang"), F.col(source_col).alias("source"), base_statistics(F.col(text_col)).alias("s"))
    s = s.select("id", "lang", "source", F.col("s.w.n").cast("long").alias("n_words"), F.col("s.w.c").cast("long").alias("word_chars"), "s.n_symbols", "s.n_dup_lines", F.col("s.w.r").cast("long").alias("n_repeat_words"))
    s = stash(s, "statistics")
    some = F.col("n_words") > 0
    xs = [F.when(some, v).alias(f"x_{i}") for i, v in enumerate(_vector())]
    rows = s.where(some).select("lang", "source", *xs)
    by_lang = mcd(rows, ["lang"], [_medians(rows, ["lang"]), _moments(rows, ["lang"], None, [], 1.0)])
    groups = rows.select("lang", "source").distinct()
    from_lang = _join(groups, by_lang, ["lang"])
    both = mcd(rows, ["lang", "source"], [from_lang, _moments(rows, ["lang", "source"], by_lang, ["lang"], 1.0)], by_lang, ["lang"])
    pairs = both.select(F.col("lang").alias("of_lang"), F.col("source").alias("of_source"), *[f"m_{i}" for i in range(P)], *[f"c_{i}{j}" for i, j in _lower()])
    scored = s.select("*", *xs).join(pairs, F.col("lang").eqNullSafe(F.col("of_lang")) & F.col("source").eqNullSafe(F.col("of_source")), "left")
    failed = (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))
    kept = ~failed & (F.coalesce(F.col("d2"), F.lit(0.0)) <= chi2_quantile(cutoff, P))
    return _distance(scored).select("id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", failed.alias("base_failed"), "d2", kept.alias("kept"))
