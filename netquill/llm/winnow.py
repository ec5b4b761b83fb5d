"""Benchmark decontamination by winnowing, in DataFrame operations only.

Of every `window - K + 1` consecutive K-word hashes the least is the window's
fingerprint, on both sides, so a document's window that equals an item's has a
fingerprint of the benchmark. Each such hit is extended to its whole window, and
the window's words are joined with the benchmark's windows, so a hash that merely
collides reports nothing. Items of fewer than `window` words, for which winnowing
guarantees nothing, are looked up by the hash of the whole item among all word
runs of that length.

Up to LITERALS benchmark fingerprints stand in the plan itself, and one scan of
the documents finds all hits; more are joined, and the texts that met one are
fetched again.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from netquill.llm.common import ascii_lower, let, matched, row_of, stash, text_key, upto

#: Letters a-z, digits and every character beyond ASCII.
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
K = 5
#: Most fingerprints that a plan holds.
LITERALS = 16_384


def _words(text: Column) -> Column:
    return F.coalesce(F.regexp_extract_all(ascii_lower(text), F.lit(WORD), F.lit(0)), F.array().cast("array<string>"))


def _grams(words: Column, k: int) -> Column:
    return F.transform(upto(F.size(words) - (k - 1)), lambda i: F.xxhash64(*[F.get(words, i + j) for j in range(k)]))


def _least(words: Column, window: int) -> Column:
    """The least K-word hash of each window, by the window's first word."""
    k = min(K, window)
    wide = window - k + 1
    cells = [lambda h, i, j=j: F.get(h, i + j) for j in range(wide)]
    return let(_grams(words, k), lambda h: F.transform(upto(F.size(h) - (wide - 1)), lambda i: F.least(*[c(h, i) for c in cells]) if wide > 1 else cells[0](h, i)))


def _candidates(words: Column, window: int, short: list[int], wanted: list[int] | None) -> Column:
    """(at, n, run) for each run of words whose hash is wanted (None: all runs): windows, and runs of the short items' lengths."""

    def runs(hashes: Column, n: int) -> Column:
        cell = lambda at: F.struct(at.alias("at"), F.lit(n).alias("n"), F.array_join(F.slice(words, at + 1, n), " ").alias("run"))
        if wanted is None:
            return F.transform(upto(F.size(hashes)), cell)
        places = F.filter(F.transform(hashes, lambda h, i: F.when(h.isin(wanted), i)), lambda i: i.isNotNull())
        return F.transform(places, cell)

    def found(hashes: Column, n: int) -> Column:
        return let(hashes, lambda h: runs(h, n))  # a second parameter would be taken for the place in the array

    return F.concat(found(_least(words, window), window), *[found(_grams(words, n), n) for n in short])


def _fingerprints(words: Column, window: int, short: list[int]) -> Column:
    return F.array_distinct(F.concat(_least(words, window), *[_grams(words, n) for n in short]))


def contamination(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", window: int = 10) -> DataFrame:
    """(id, k1, k2, n_words, n_hit, items array<string>) for each row of docs.

    k1 and k2 are the text's key. Null and word-free texts have no words and no
    hits. Texts are read whole; what is done for one grows with its length alone,
    however often a passage repeats in it or among the items. Repeated rows get
    equal results, and equal texts are judged once. Items that are null or have no
    words are left out; an item without an id counts for n_hit and is not in
    items; items with equal windows (ties) are all named. Other columns are left
    out. Empty tables on either side are allowed.
    """
    words = _words(F.col(text_col))
    items = benchmark.select(F.col(item_col).cast("string").alias("item"), _words(F.col(item_text_col)).alias("iw")).where(F.size("iw") > 0)
    items = stash(items.withColumn("n", F.least(F.size("iw"), F.lit(window))), "items")
    short = sorted(r.n for r in items.where(F.col("n") < window).select("n").distinct().collect())  # fewer than window
    starts = F.transform(upto(F.size("iw") - F.col("n") + 1), lambda i: F.array_join(F.slice("iw", i + 1, F.col("n")), " "))
    windows = items.select("item", F.explode(starts).alias("run")).groupBy("run").agg(F.sort_array(F.collect_set("item")).alias("item_ids"))
    windows = stash(windows, "windows")
    prints = F.when(F.col("n") >= window, _least(F.col("iw"), window))
    for n in short:
        prints = prints.when(F.col("n") == n, _grams(F.col("iw"), n))
    wanted = stash(items.select(F.explode(prints).alias("h")).distinct(), "wanted")
    few = [r.h for r in wanted.limit(LITERALS + 1).collect()]

    if len(few) <= LITERALS:
        found = let(words, lambda w: F.struct(F.size(w).cast("long").alias("n_words"), _candidates(w, window, short, few).alias("runs")))
        rows = stash(docs.select(F.col(id_col).alias("id"), *text_key(F.col(text_col)), found.alias("f")).select("id", "k1", "k2", "f.n_words", "f.runs"), "found")
        met = rows.where(F.size("runs") > 0).groupBy("k1", "k2").agg(F.first("runs").alias("runs"))
    else:
        picked = let(words, lambda w: F.struct(F.size(w).cast("long").alias("n_words"), _fingerprints(w, window, short).alias("hs")))
        rows = stash(docs.select(F.col(id_col).alias("id"), *text_key(F.col(text_col)), picked.alias("p")).select("id", "k1", "k2", "p.n_words", "p.hs"), "picked")
        keys = stash(rows.select("k1", "k2", F.explode("hs").alias("h")).join(wanted, "h").select("k1", "k2").distinct(), "met")
        texts = matched(docs.select(*text_key(F.col(text_col)), F.col(text_col).alias("t")), keys, ["k1", "k2"], "left_semi")
        met = texts.groupBy("k1", "k2").agg(F.first("t").alias("t")).select("k1", "k2", let(_words(F.col("t")), lambda w: _candidates(w, window, short, None)).alias("runs"))
    hits = met.select("k1", "k2", F.explode("runs").alias("r")).select("k1", "k2", "r.*").join(windows, "run")
    hits = hits.groupBy("k1", "k2").agg(F.collect_set(F.struct("at", "n")).alias("at"), F.collect_set("item_ids").alias("items"))
    places = F.flatten(F.transform("at", lambda x: F.sequence(x["at"], x["at"] + x["n"] - 1)))
    hits = stash(hits.select("k1", "k2", F.size(F.array_distinct(places)).cast("long").alias("n_hit"), F.sort_array(F.array_distinct(F.flatten("items"))).alias("items")), "hits")
    got = rows.select("id", "k1", "k2", "n_words").join(hits, ["k1", "k2"], "left")
    return got.select("id", "k1", "k2", "n_words", F.coalesce("n_hit", F.lit(0).cast("long")).alias("n_hit"), F.coalesce("items", F.array().cast("array<string>")).alias("items"))


def clean(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", **more) -> DataFrame:
    """The rows of docs without any hit, with the same columns, whatever their names.

    Decided by contamination(): rows with null, empty or word-free texts stay,
    repeated rows stay or go together, and without items every row stays.
    """
    bad = contamination(docs, benchmark, id_col, text_col, **more).where("n_hit > 0").select("k1", "k2").distinct()
    keyed = docs.select(row_of(docs), *text_key(F.col(text_col)))
    return matched(keyed, stash(bad, "contaminated"), ["k1", "k2"], "left_anti").select("row.*")
