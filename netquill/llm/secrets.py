"""Secret scans by character Markov models, in DataFrame operations only.

Three base rules give spans that always stay. Two first-order character models
are counted over distinct labelled samples, with one added to each cell: random
strings (what the base rules found) and ordinary identifiers (runs that several
texts share), and samples that the caller brings. Every run of 16 or more
characters that touches no base span is reported if the log-likelihood ratio of
its transitions is above THRESHOLD for each of them. The model has 2 * 67 * 67
cells at any size of the corpus.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from netquill.llm.common import let, running, stash, upto

# Fixed values of the base rules.
ASSIGN = r"""((?:[Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd])|(?:[Pp][Aa][Ss][Ss][Ww][Dd])|(?:[Ss][Ee][Cc][Rr][Ee][Tt])|(?:[Tt][Oo][Kk][Ee][Nn])|(?:[Aa][Pp][Ii]_?[Kk][Ee][Yy]))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]+"
HEX = r"[0-9a-f]{32,}"
#: What ACCESS matches, where it is long enough to stay.
ACCESS_WHOLE = r"AKIA[A-Z0-9]{12,}"
KINDS = ("assign", "access", "hex", "markov")
KEYWORDS = ("password", "passwd", "secret", "token", "api_key", "apikey")

RUN = r"[A-Za-z0-9+/_=-]{12,}"
LEAST = 16
ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-"
A = len(ALPHABET)
#: Nats a transition by which a run has to be likelier as a random string.
THRESHOLD = 0.7

_SPAN = "array<struct<start:int,stop:int,kind:int,value:string>>"


def _spans(text: Column, pattern: str, kind: int, group: int = 0, least: int = 0, maybe: Column | None = None) -> Column:
    """Leftmost non-overlapping matches, in code points; those whose group is shorter than least are dropped."""

    def placed(whole: Column) -> Column:
        values = F.regexp_extract_all(text, F.lit(pattern), F.lit(group)) if group else whole
        steps = F.zip_with(F.slice(F.split(text, pattern, -1), 1, F.size(whole)), whole, lambda p, m: F.length(p) + F.length(m))
        rows = let(F.struct(running(steps, lambda a, b: a + b).alias("stop"), whole.alias("m"), values.alias("v")), lambda x: F.transform(x.stop, lambda stop, i: F.struct((stop - F.length(F.get(x.m, i))).alias("start"), stop.alias("stop"), F.lit(kind).alias("kind"), F.get(x.v, i).alias("value"))))
        return F.when(F.size(whole) == 0, F.array().cast(_SPAN)).otherwise(F.filter(rows, lambda s: F.length(s.value) >= least))

    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    if maybe is not None:
        found = F.when(maybe, found).otherwise(F.array().cast("array<string>"))
    return let(found, placed)


def _untouched(runs: Column, spans: Column) -> Column:
    """The runs that overlap no span; neither kind overlaps its own. One pass over both, in order of their starts."""
    place = F.array_sort(F.concat(F.transform(runs, lambda r, i: F.struct(r.start.alias("start"), r.stop.alias("stop"), i.alias("i"))), F.transform(spans, lambda s: F.struct(s.start.alias("start"), s.stop.alias("stop"), F.lit(-1).alias("i")))))
    big = 2**31 - 1
    before = lambda p: running(F.transform(p, lambda x: F.when(x.i < 0, x.stop).otherwise(F.lit(0))), lambda a, b: F.greatest(a, b))
    after = lambda p: F.reverse(running(F.reverse(F.transform(p, lambda x: F.when(x.i < 0, x.start).otherwise(F.lit(big)))), lambda a, b: F.least(a, b)))

    def alone(x: Column) -> Column:
        free = F.transform(x.p, lambda e, k: F.when((e.i >= 0) & (F.get(x.b, k) <= e.start) & (F.get(x.a, k) >= e.stop), e.i))
        return F.transform(F.array_sort(F.filter(free, lambda i: i.isNotNull())), lambda i: F.get(x.r, i))

    whole = let(F.struct(place.alias("p"), runs.alias("r")), lambda y: let(F.struct(y.p.alias("p"), y.r.alias("r"), before(y.p).alias("b"), after(y.p).alias("a")), alone))
    return F.when((F.size(runs) == 0) | (F.size(spans) == 0), runs).otherwise(whole)


def _base(text: Column) -> Column:
    lower = F.lower(text)
    keyword = F.lit(False)
    for k in KEYWORDS:
        keyword = keyword | F.contains(lower, F.lit(k))
    return F.struct(_spans(text, ASSIGN, 0, 2, 8, keyword).alias("assign"), _spans(text, ACCESS, 1, 0, 16, F.contains(text, F.lit("AKIA"))).alias("access"), _spans(text, HEX, 2).alias("hex"), _spans(text, RUN, 3).alias("runs"))


def _joined(spans: Column) -> Column:
    names = F.array(*[F.lit(k) for k in KINDS])
    by_place = F.array_sort(F.transform(spans, lambda s: F.struct(s.start.alias("start"), s.kind.alias("kind"), s.stop.alias("stop"))))
    return F.array_join(F.transform(by_place, lambda s: F.concat_ws(":", F.get(names, s.kind), s.start.cast("string"), s.stop.cast("string"))), ",")


def _transitions(samples: DataFrame, label: int) -> DataFrame:
    """samples: (value). Counts of adjacent characters over distinct values."""
    chars = samples.select("value").distinct().select(F.split("value", "").alias("c"))
    pairs = chars.select(F.explode(let(F.col("c"), lambda c: F.transform(upto(F.size(c) - 1), lambda i: F.concat(F.get(c, i), F.get(c, i + 1))))).alias("pair"))
    return pairs.groupBy("pair").agg(F.count("*").alias("n")).withColumn("label", F.lit(label))


def log_ratios(secret: DataFrame, ordinary: DataFrame) -> np.ndarray:
    """A * A log-ratios of the transition probabilities; zeros without samples."""
    counts = np.ones((2, A, A))
    for r in _transitions(secret, 0).union(_transitions(ordinary, 1)).collect():  # at most 2 * A * A rows count
        i, j = ALPHABET.find(r.pair[0]), ALPHABET.find(r.pair[1])
        if i >= 0 and j >= 0:
            counts[r.label, i, j] += r.n
    p = counts / counts.sum(2, keepdims=True)
    return np.log(p[0] / p[1]).reshape(-1)


def score(value: Column, ratios: np.ndarray) -> Column:
    """Log-likelihood ratio of the transitions of a string over ALPHABET."""
    at = lambda c: F.instr(F.lit(ALPHABET), c)
    cells = F.lit(ratios)
    codes = F.transform(F.split(value, ""), lambda c: at(c))
    return let(codes, lambda c: F.aggregate(upto(F.size(c) - 1), F.lit(0.0), lambda acc, i: acc + F.coalesce(F.get(cells, (F.get(c, i) - 1) * A + F.get(c, i + 1) - 1), F.lit(0.0))))


def labelled_samples(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Values of random strings and of ordinary identifiers, from rows (key, base, runs).

    Random strings: what the base rules found. Ordinary identifiers: runs that
    stand in two or more different texts and hold no base span, whatever their
    length; a secret is hardly written twice.
    """
    secret = rows.select(F.explode("base.value").alias("value"))
    seen = rows.select("key", F.explode(F.array_distinct("runs.value")).alias("value"))
    ordinary = seen.groupBy("value").agg(F.min("key").alias("a"), F.max("key").alias("b")).where("a <> b").select("value")
    return secret, ordinary


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", labelled: DataFrame | None = None, threshold: float = THRESHOLD) -> DataFrame:
    """(id, n_assign, n_access, n_hex, base, spans) for each row; base and spans are joined kind:start:end.

    labelled: further samples (value string, secret boolean). Null and empty
    texts have no spans. Texts are read whole, and the work grows but little
    faster than a text's length. Spans of one start (ties) go by kind. Repeated
    rows get equal results and count as one text in training, null ids are
    allowed, other columns are left out, and an empty table gives an empty result.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.col(id_col).alias("id"), F.xxhash64(text).alias("key"), _base(text).alias("s"))
    rows = rows.select("id", "key", *[F.size(f"s.{k}").cast("long").alias(f"n_{k}") for k in KINDS[:3]], F.concat("s.assign", "s.access", "s.hex").alias("base"), "s.assign", "s.runs")
    clear = _untouched(F.filter("runs", lambda c: ~c.value.rlike(f"{HEX}|{ACCESS_WHOLE}")), F.col("assign"))
    rows = stash(rows.withColumn("runs", clear).drop("assign"), "spans")
    secret, ordinary = labelled_samples(rows)
    if labelled is not None:
        secret = secret.union(labelled.where("secret").select("value"))
        ordinary = ordinary.union(labelled.where("not secret").select("value"))
    ratios = log_ratios(secret, ordinary)
    more = F.filter("runs", lambda c: F.when(F.length(c.value) >= LEAST, score(c.value, ratios) > threshold * (F.length(c.value) - 1)).otherwise(F.lit(False)))
    return rows.select("id", "n_assign", "n_access", "n_hex", _joined(F.col("base")).alias("base"), _joined(F.concat("base", more)).alias("spans"))
