"""Quality by the perplexity of an interpolated modified Kneser-Ney model of word pairs.

Words are runs of bytes other than ASCII white space, as they stand, by their
64-bit hash; a mark stands before the first and after the last. Pairs of all
trusted texts are counted in each task and summed in hash shards. Context
totals, continuation counts and discounts come from those counts, and the
model is a table with a row for each word and each pair that was seen, so it
grows with the corpus and no task holds it.

With a(v, w) the discounted share of a pair, g(v) the mass that a context leaves
and p(w) the continuation probability, log(a + g p) = log p(w) + log g(v) +
log(1 + a / (g p)). The first two belong to words, the last to the pair and is 0
for one never seen. So a text's log-likelihood is a sum of values of its words and
pairs: its grams are joined with the table and summed, once for each different
text. Pairs are counted in PARTS parts and texts scored in PASSES; the
table stands in buckets by model and key, so a pass moves only its grams. Words
and pairs of more than 1 / HOT of all counts, of which there can be HOT at most,
are looked up where the text is; the others are the sharded join.

Texts fall into two folds by hash, and each is scored by the model of the other
fold's trusted texts. So no text is scored by a model that has seen it, and
trusted and other documents are held to one measure. Each language's threshold is
a quantile of its trusted documents' scores, from mergeable counts in narrow bins.
"""

from __future__ import annotations

import math
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from netquill.llm.common import drop_stash, matched, release, row_of, stash, text_key

#: Share of trusted documents of a language that stay.
QUANTILE = 0.995
#: Words at the language's mean that every text is taken to have besides its own.
PRIOR_WORDS = 20.0
BINS = 2000.0
#: Words of a block whose pairs a task counts at once.
BLOCK = 1 << 21
#: A word or pair of more than 1 / HOT of all counts is hot.
HOT = 1 << 17
#: Parts of the pairs (half of them each fold's) and of the texts that are worked on one after the other, so that only one lies in shuffle files.
PARTS, PASSES = 2, 6
#: Cuts of a part of the pairs, and of the finished table, for the same reason.
CUTS = 3
#: Rows of a shard of the finished table, and texts whose sums a task holds.
SHARD_ROWS, HELD = 250_000, 1 << 21
#: Different words whose hash a task remembers.
CACHE = 1 << 20
#: The mark before the first and after the last word.
MARK = np.uint64(0x9E3779B97F4A7C15)
TURN = 23
LEAST_MASS = 1e-9


class _Hashes(dict):
    """XXH64 (seed 42) of a word, worked out once."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= CACHE:
            self.clear()
        got = self[word] = xxhash.xxh64_intdigest(word, 42)
        return got


def sequence(raw: bytes, hashes: dict) -> np.ndarray:
    """The mark, the words' hashes and the mark; empty without words."""
    words = raw.split()
    if not words:
        return np.zeros(0, np.uint64)
    out = np.empty(len(words) + 2, np.uint64)
    out[0] = out[-1] = MARK
    out[1:-1] = np.fromiter(map(hashes.__getitem__, words), np.uint64, len(words))
    return out


def pair_key(v: np.ndarray, w: np.ndarray) -> np.ndarray:
    return v ^ ((w << np.uint64(TURN)) | (w >> np.uint64(64 - TURN)))


def _pair_key(v: str, w: str) -> Column:
    return F.expr(f"{v} ^ (shiftleft({w}, {TURN}) | shiftrightunsigned({w}, {64 - TURN}))")


def _signed(x: np.ndarray) -> pa.Array:
    return pa.array(np.ascontiguousarray(x).view(np.int64))


def pair_counts(texts: DataFrame, fold: int, part: int = 0, parts: int = 1) -> DataFrame:
    """(v, w, n): how often w follows v in texts (text) of a fold, summed over blocks of each task and then in shards; one of parts by the pair's hash."""

    def run(batches):
        hashes, held, size = _Hashes(), [], 0

        def counted():
            v = np.concatenate([s[:-1] for s in held])
            w = np.concatenate([s[1:] for s in held])
            key = pair_key(v, w)
            if parts > 1:
                own = np.flatnonzero(key % np.uint64(parts) == part)
                v, w, key = v[own], w[own], key[own]
            order = np.argsort(key)
            key = key[order]
            first = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1]))) if len(key) else order
            n, at = np.diff(first, append=len(key)), order[first]
            for i in range(0, len(at), 1 << 16):
                j = at[i : i + (1 << 16)]
                yield pa.RecordBatch.from_arrays([_signed(v[j]), _signed(w[j]), pa.array(n[i : i + (1 << 16)])], names=["v", "w", "n"])
            held.clear()

        for b in batches:
            for t in b.column(0).cast(pa.large_binary()):
                s = sequence(t.as_py(), hashes)
                if len(s):
                    held.append(s)
                    size += len(s)
                if size >= BLOCK:
                    yield from counted()
                    size = 0
        if held:
            yield from counted()

    own = texts.where(F.col("text").isNotNull() & (F.xxhash64("text").bitwiseAND(F.lit(1)) == fold))
    return own.mapInArrow(run, "v bigint, w bigint, n bigint").groupBy("v", "w").agg(F.sum("n").alias("n"))


def discounts(n1: float, n2: float, n3: float, n4: float) -> list[float]:
    """Of counts 1, 2 and 3 or more, from how many grams have counts 1 to 4."""
    y = n1 / max(1.0, n1 + 2 * n2)
    raw = (1 - 2 * y * n2 / max(1.0, n1), 2 - 3 * y * n3 / max(1.0, n2), 3 - 4 * y * n4 / max(1.0, n3))
    return [min(max(v, 0.0), float(k + 1)) for k, v in enumerate(raw)]


def _off(n: Column, d: list[float]) -> Column:
    return F.when(n >= 3, d[2]).when(n == 2, d[1]).when(n == 1, d[0]).otherwise(0.0)


def values(texts: DataFrame) -> tuple[DataFrame, DataFrame, list[float]]:
    """(key, val0, val1) of all words and pairs of texts (text), the hot rows of it, and each model's log-probability of a word never seen.

    A pair that both folds have has a row for each, with 0 for the other. val0 and val1 are of the models of fold 0 and fold 1; one that has no texts is
    that of all. A text's log-likelihood is the sum of its grams' values and of the
    log-probability of an unseen word for each of its words and the end.
    """
    spark, held, models = texts.sparkSession, [], (0, 1)
    parts = max(1, PARTS // 2)
    for m in models:
        for k in range(parts):
            held.append((m, stash(pair_counts(texts, m, k, parts), f"pairs{m}_{k}")))
            release(spark)
    has = [sum(p.agg(F.sum("n")).first()[0] or 0 for m, p in held if m == k) for k in models]
    one_model = not has[0] or not has[1]

    def counts(m: int) -> list[Column]:
        """The pair's count in each model; a pair of both folds has a row for each."""
        return [F.col("n") if one_model or m == k else F.lit(0).cast("long") for k in models]

    pairs = reduce(DataFrame.union, [part.select("v", "w", *[c.alias(f"n{k}") for k, c in zip(models, counts(m))]) for m, part in held])
    at = pairs.agg(F.sum(F.col("n0") + F.col("n1")), *[F.count_if(F.col(f"n{m}") == k) for m in models for k in (1, 2, 3, 4)]).first()
    total, off = at[0] or 0, [discounts(*map(float, at[1 + 4 * m : 5 + 4 * m])) for m in models]
    one = lambda c: F.sum(c.cast("long"))
    as_context = [c for m in models for c in (F.col(f"n{m}").alias(f"c{m}"), *[(F.col(f"n{m}") == k).cast("long").alias(f"n{k}_{m}") for k in (1, 2)], (F.col(f"n{m}") >= 3).cast("long").alias(f"n3_{m}"), F.lit(0).cast("long").alias(f"t{m}"))]
    as_word = [c for m in models for c in (*[F.lit(0).cast("long").alias(k) for k in (f"c{m}", f"n1_{m}", f"n2_{m}", f"n3_{m}")], (F.col(f"n{m}") > 0).cast("long").alias(f"t{m}"))]
    both = pairs.select(F.col("v").alias("x"), *as_context).union(pairs.select(F.col("w").alias("x"), *as_word))
    counted = words = stash(both.groupBy("x").agg(*[F.sum(c).alias(c) for c in both.columns[1:]]), "words")
    del both, pairs
    release(spark)
    seen = words.agg(*[c for m in models for c in (F.sum(f"t{m}"), one(F.col(f"t{m}") > 0), *[one(F.col(f"t{m}") == k) for k in (1, 2, 3, 4)], one(F.col(f"t{m}") >= 3))]).first()
    unseen, cols = [], []
    for m in models:
        t, v, k1, k2, k3, k4, more = (float(x or 0) for x in seen[7 * m : 7 * m + 7])
        d = discounts(k1, k2, k3, k4)
        rest = max((d[0] * k1 + d[1] * k2 + d[2] * more) / max(t, 1.0), LEAST_MASS) / (v + 1) if t else 1.0
        unseen.append(math.log(rest))
        n = F.col(f"t{m}")
        cols.append(((n - _off(n, d)) / max(t, 1.0) + F.lit(rest)).alias(f"p{m}"))
        mass = reduce(lambda a, b: a + b, [F.col(f"n{k}_{m}") * off[m][k - 1] for k in (1, 2, 3)]) / F.col(f"c{m}")
        cols.append(F.when(F.col(f"c{m}") > 0, F.greatest(mass, F.lit(LEAST_MASS))).otherwise(F.lit(1.0)).alias(f"g{m}"))
    words = words.select("x", (F.col("c0") + F.col("c1")).alias("c"), "c0", "c1", *cols)
    hot = F.col("c") > F.lit(total / HOT)
    of_words = words.select(F.col("x").alias("key"), *[(F.log(f"p{m}") + F.log(f"g{m}") - F.lit(unseen[m])).cast("float").alias(f"val{m}") for m in models], hot.alias("hot"))
    left = [words.select(F.col("x").alias("v"), (F.col(f"c{m}") * F.col(f"g{m}")).alias("left"), hot.alias("hot")) for m in models]
    right = [words.select(F.col("x").alias("w"), f"p{m}", hot.alias("hot")) for m in models]

    def with_words(rows: DataFrame, side: DataFrame, name: str) -> DataFrame:
        """A hot word's row goes to the pairs, at most HOT rows; the other pairs are joined by key."""
        new = [c for c in side.columns if c not in (name, "hot")]
        few = F.broadcast(side.where("hot").select(name, F.struct(*new).alias("known")))
        tried = rows.join(few, name, "left")
        cold = tried.where("known is null").drop("known").join(side.where("not hot").drop("hot"), name)
        return tried.where("known is not null").select(*rows.columns, "known.*").unionByName(cold.select(*rows.columns, *new))

    tables = [stash(of_words, "word_values")]
    for k, (m, part) in enumerate(held):
        gain = F.log1p((F.col("n") - _off(F.col("n"), off[m])) / (F.col("left") * F.col(f"p{m}"))).cast("float")
        for c in range(CUTS):
            cut = part.where(F.pmod(F.xxhash64("v", "w"), F.lit(CUTS)) == c)
            full = with_words(with_words(cut, left[m], "v"), right[m], "w")
            vals = [(gain if one_model or m == j else F.lit(0.0).cast("float")).alias(f"val{j}") for j in models]
            tables.append(stash(full.select(_pair_key("v", "w").alias("key"), *vals, (F.col("n") > F.lit(total / HOT)).alias("hot")), f"pair_values{k}_{c}"))
            del cut, full
            release(spark)
        drop_stash(part)
    del words, left, right, of_words
    drop_stash(counted)
    table = reduce(DataFrame.union, tables)
    return table.drop("hot"), table.where("hot").drop("hot"), unseen


def _narrow(x: np.ndarray) -> np.ndarray:
    """x in the fewest bytes that hold it; _wide() reads it again."""
    most = int(x.max()) if len(x) else 0
    return x.astype(np.uint8 if most < 1 << 8 else np.uint16 if most < 1 << 16 else np.uint32)


def _wide(raw: bytes, n: int) -> np.ndarray:
    return np.frombuffer(raw, f"u{len(raw) // n}" if n else "u1")


def _cut(x: np.ndarray, sizes: np.ndarray) -> pa.Array:
    """x as binary values, each of so many items."""
    ends = np.zeros(len(sizes) + 1, np.int32)
    np.cumsum(sizes * x.itemsize, out=ends[1:])
    return pa.Array.from_buffers(pa.binary(), len(sizes), [None, pa.py_buffer(ends), pa.py_buffer(np.ascontiguousarray(x))])


def _rows(kind: int, shard: np.ndarray, block: int, n: int, a: pa.Array, b: pa.Array, c: pa.Array | None = None) -> pa.RecordBatch:
    size = len(shard)
    columns = [pa.array(np.full(size, kind, np.int32)), pa.array(shard.astype(np.int32)), pa.array(np.full(size, block, np.int64)), pa.array(np.full(size, n, np.int32)), a, b, c if c is not None else pa.nulls(size, pa.binary())]
    return pa.RecordBatch.from_arrays(columns, names=["kind", "shard", "block", "n", "a", "b", "c"])


_PACKED = "kind int, shard int, block bigint, n int, a binary, b binary, c binary"
#: What a row of _PACKED holds: keys and values of the model; keys, how often each stands, and in which texts of a block;
#: a block's texts, their sums so far and their sizes; texts of a block by number, and what to add to their sums.
MODEL, GRAMS, TEXTS, SUMS = range(4)


def _shard(key: np.ndarray, bits: int) -> np.ndarray:
    return (key >> np.uint64(64 - bits)).astype(np.uint16 if bits <= 16 else np.uint32)


def by_model(table: DataFrame) -> tuple[DataFrame, int]:
    """The values other than 0 of each model m, packed in shards by the first bits of the key; and how many bits."""
    bits = max(6, math.ceil(math.log2(max(1, table.count() / SHARD_ROWS))))

    def run(batches):
        held, size = [], 0

        def packed():
            key = np.concatenate([k for k, _ in held])
            for m in (0, 1):
                val = np.concatenate([v[m] for _, v in held])
                own = np.flatnonzero(val)
                shard = _shard(key[own], bits)
                own = own[np.argsort(shard, kind="stable")]
                sizes = np.bincount(shard, minlength=1 << bits)
                some = np.flatnonzero(sizes)
                rows = _rows(MODEL, some, 0, m, _cut(key[own], sizes[some]), _cut(val[own], sizes[some]))
                yield pa.RecordBatch.from_arrays([rows.column(3), *rows.columns], names=["m", *rows.schema.names])
            held.clear()

        for b in batches:
            held.append((b.column(0).to_numpy().view(np.uint64), [b.column(1 + m).to_numpy(zero_copy_only=False) for m in (0, 1)]))
            size += b.num_rows
            if size >= BLOCK >> 1:
                yield from packed()
                size = 0
        if held:
            yield from packed()

    return stash(table.select("key", "val0", "val1").mapInArrow(run, f"m int, {_PACKED}"), "model", split="m"), bits


def _found(keys: np.ndarray, vals: np.ndarray, asked: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which of asked are among the sorted keys, and their values, else 0. asked in order, which is fast."""
    if not len(keys):
        return np.zeros(len(asked), bool), np.zeros(len(asked))
    at = np.minimum(np.searchsorted(keys, asked), len(keys) - 1)
    hit = keys[at] == asked
    return hit, np.where(hit, vals[at], 0.0)


def text_scores(docs: DataFrame, text_col: str, table: DataFrame, bits: int, hot: DataFrame, unseen: list[float], passes: int | None = None) -> DataFrame:
    """(t, nll, n) of each different text with a word: t is xxhash64 of the text, n its words and the end.

    table, bits: those of by_model(). A pass takes texts of one fold, so one model's
    values. Texts are taken in blocks; each gram of a block that is not hot goes to
    its shard once, with the texts it stands in, meets the model there, and what its
    texts gain comes back to the block. Rows are packed: one for each block and shard.
    """
    spark = docs.sparkSession
    known = hot.toArrow()  # at most 2 * HOT rows
    key = known.column("key").to_numpy().view(np.uint64)
    by = np.argsort(key)
    own = [by[known.column(f"val{m}").to_numpy()[by] != 0] for m in (0, 1)]
    shared = spark.sparkContext.broadcast([(key[own[m]], known.column(f"val{m}").to_numpy()[own[m]].astype(np.float64)) for m in (0, 1)])

    def sent(batches, m):
        hashes, seen, held, size, block = _Hashes(), set(), [], 0, TaskContext.get().partitionId() << 32
        keys, vals = shared.value[m]  # of hot words and pairs

        def packed():
            sizes = np.array([len(s) for _, s in held])
            s = np.concatenate([s for _, s in held])
            inner = np.ones(len(s), bool)
            inner[np.cumsum(sizes) - 1] = False
            at = np.flatnonzero(inner)
            v = s[at]
            grams = np.concatenate((v, pair_key(v, s[at + 1])))
            own = np.tile(np.repeat(np.arange(len(held), dtype=np.uint32), sizes - 1), 2)
            order = np.argsort(grams)
            grams, own = grams[order], own[order]
            first = np.flatnonzero(np.concatenate(([True], grams[1:] != grams[:-1])))
            runs, asked = np.diff(first, append=len(grams)), grams[first]
            hit, val = _found(keys, vals, asked)
            ll = np.bincount(own, np.repeat(val, runs), len(held)) + (sizes - 1) * unseen[m]
            yield _rows(TEXTS, np.array([block % (1 << bits)]), block, len(held), *[_cut(x, np.array([len(held)])) for x in (np.array([t for t, _ in held], np.int64), ll, (sizes - 1).astype(np.int64))])
            own, runs, asked = own[np.repeat(~hit, runs)], runs[~hit], asked[~hit]
            if len(asked):
                shard = _shard(asked, bits)
                start = np.flatnonzero(np.concatenate(([True], shard[1:] != shard[:-1])))
                yield _rows(GRAMS, shard[start], block, len(held), _cut(asked, np.diff(start, append=len(asked))), _cut(_narrow(runs), np.diff(start, append=len(asked))), _cut(_narrow(own), np.add.reduceat(runs, start)))

        for b in batches:
            for t, raw in zip(b.column(0).to_pylist(), b.column(1).cast(pa.large_binary())):
                if t in seen:
                    continue
                seen.add(t)
                s = sequence(raw.as_py(), hashes)
                if len(s):
                    held.append((t, s))
                    size += len(s)
                if size >= BLOCK >> 1:
                    yield from packed()
                    held, size, block = [], 0, block + 1
        if held:
            yield from packed()

    def met(batches):
        at, parts, keys, vals, sums, size = None, [], None, None, {}, 0

        def gained():
            for block, x in sums.items():
                some = np.flatnonzero(x)
                if len(some):
                    yield _rows(SUMS, np.zeros(1), block, len(some), _cut(_narrow(some), np.array([len(some)])), _cut(x[some], np.array([len(some)])))

        for b in batches:
            through = np.flatnonzero(b.column(0).to_numpy() == TEXTS)
            if len(through):
                yield b.take(pa.array(through))
            for kind, shard, block, n, a, v, c in zip(*[b.column(i).to_pylist() for i in range(4)], *[b.column(i) for i in range(4, 7)]):
                if shard != at:
                    at, parts, keys = shard, [], None
                if kind == MODEL:
                    parts.append((np.frombuffer(a.as_py(), np.uint64), np.frombuffer(v.as_py(), np.float32)))
                elif kind == GRAMS:
                    if keys is None:
                        keys = np.concatenate([k for k, _ in parts]) if parts else np.zeros(0, np.uint64)
                        order = np.argsort(keys)
                        keys, vals = keys[order], (np.concatenate([x for _, x in parts]) if parts else np.zeros(0, np.float32))[order]
                        parts = []
                    asked = np.frombuffer(a.as_py(), np.uint64)
                    runs = _wide(v.as_py(), len(asked))
                    own = _wide(c.as_py(), int(runs.sum()))
                    gain = np.bincount(own, np.repeat(_found(keys, vals, asked)[1], runs), n)
                    if block in sums:
                        sums[block] += gain
                    else:
                        sums[block] = gain
                        size += n
                    if size >= HELD:
                        yield from gained()
                        sums, size = {}, 0
        yield from gained()

    def ended(batches):
        t = None
        out = lambda: pa.RecordBatch.from_arrays([pa.array(t), pa.array(-ll), pa.array(n)], names=["t", "nll", "n"])
        for b in batches:
            for kind, size, a, v, c in zip(b.column(0).to_pylist(), b.column(3).to_pylist(), *[b.column(i) for i in range(4, 7)]):
                if kind == TEXTS:
                    if t is not None:
                        yield out()
                    t, ll, n = np.frombuffer(a.as_py(), np.int64), np.frombuffer(v.as_py(), np.float64).copy(), np.frombuffer(c.as_py(), np.int64)
                else:
                    ll[_wide(a.as_py(), size)] += np.frombuffer(v.as_py(), np.float64)
        if t is not None:
            yield out()

    texts = docs.select(F.xxhash64(F.col(text_col).cast("string")).alias("t"), F.col(text_col).cast("string").alias("text")).where("text is not null")
    each = max(1, (passes or PASSES) // 2)

    def scored(m: int, j: int) -> DataFrame:
        part = texts.where((F.expr("t & 1") == 1 - m) & (F.pmod(F.shiftright("t", 1), F.lit(each)) == j))
        grams = part.mapInArrow(lambda batches: sent(batches, m), _PACKED)
        own = table.where(F.col("m") == m).select("kind", "shard", "block", "n", "a", "b", "c")
        sums = own.union(grams).repartition("shard").sortWithinPartitions("shard", "kind").mapInArrow(met, _PACKED)
        whole = sums.repartition("block").sortWithinPartitions("block", "kind").mapInArrow(ended, "t bigint, nll double, n bigint")
        return stash(whole.groupBy("t").agg(F.max("nll").alias("nll"), F.max("n").alias("n")), f"scores{m}_{j}")

    out = []
    for m in (0, 1):
        for j in range(each):
            out.append(scored(m, j))
            release(spark)  # a part's shuffle goes before the next begins
    shared.unpersist()
    return reduce(DataFrame.union, out)


def trusted_ids(labels: DataFrame) -> DataFrame:
    """Documents whose labels all say good and none says toxic."""
    per = labels.where("doc_id is not null").groupBy(F.col("doc_id").alias("id")).agg(F.min("quality").alias("q"), F.max(F.coalesce("toxic", F.lit(0))).alias("t"))
    return per.where("q = 1 and t = 0").select("id")


def smoothed(nll: Column, n: Column, mean: Column) -> Column:
    return (nll + F.lit(PRIOR_WORDS) * mean) / (n + F.lit(PRIOR_WORDS))


def thresholds(scores: DataFrame, quantile: float) -> DataFrame:
    """(every, lang, mean, worst) from trusted rows of (lang, nll, n); the row with every = true holds for other languages."""
    both = scores.select(F.lit(False).alias("every"), "lang", "nll", "n").union(scores.select(F.lit(True), F.lit(None).cast("string"), "nll", "n"))
    means = both.groupBy("every", "lang").agg((F.sum("nll") / F.greatest(F.sum("n"), F.lit(1))).alias("mean"))
    means = stash(means, "means")
    m = means.select(F.col("every").alias("e2"), F.col("lang").alias("l2"), "mean")
    binned = both.join(m, (F.col("every") == F.col("e2")) & F.col("lang").eqNullSafe(F.col("l2"))).groupBy("every", "lang", "mean", F.floor(smoothed(F.col("nll"), F.col("n"), F.col("mean")) * BINS).alias("bin")).agg(F.count("*").alias("k"))
    w = Window.partitionBy("every", "lang")
    at = binned.select("every", "lang", "mean", "bin", F.sum("k").over(w.orderBy("bin")).alias("below"), F.sum("k").over(w).alias("all"))
    return at.where(F.col("below") >= F.col("all") * quantile).groupBy("every", "lang", "mean").agg(((F.min("bin") + 1) / BINS).alias("worst"))


def judge(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", quantile: float = QUANTILE) -> DataFrame:
    """(id, lang, k1, k2, n, nll, score, worst, kept) for each row of docs.

    A text is kept if its mean negative log-likelihood per word, smoothed by
    PRIOR_WORDS, is at most (ties included) the quantile of its language's trusted
    documents. A language without any is held to the quantile of all. Texts are
    read whole. Null and empty texts, and those of white space, are not kept.
    Without trusted documents every text with a word is kept. Repeated rows get
    equal results, null ids are never trusted, null languages are one language,
    and other columns are left out. An empty table gives an empty result.
    """
    text = F.col(text_col).cast("string")
    trusted = stash(trusted_ids(labels), "trusted")
    good = matched(docs.select(F.col(id_col).alias("id"), text.alias("text")), trusted, ["id"], "left_semi")
    table, hot, unseen = values(good.select("text"))
    hot = stash(hot, "hot")
    model, bits = by_model(table)
    drop_stash(table)
    scores = stash(text_scores(docs, text_col, model, bits, hot, unseen), "scores")
    drop_stash(model)
    rows = docs.select(F.col(id_col).alias("id"), F.col(lang_col).alias("lang"), *text_key(text))
    scored = rows.join(scores, F.col("k1") == F.col("t"), "left").select("id", "lang", "k1", "k2", F.coalesce("n", F.lit(0).cast("long")).alias("n"), F.coalesce("nll", F.lit(0.0)).alias("nll"))
    scored = stash(scored, "scored")
    own = matched(scored, trusted, ["id"], "left_semi")
    limits = stash(thresholds(own.where("n > 0"), quantile), "thresholds")
    per = limits.where("not every").select(F.col("lang").alias("of"), F.struct("mean", "worst").alias("own"))
    rest = limits.where("every").first()
    other = F.struct(F.lit(rest.mean).alias("mean"), F.lit(rest.worst).alias("worst")) if rest else F.lit(None).cast("struct<mean:double,worst:double>")
    got = scored.join(per, F.col("lang").eqNullSafe(F.col("of")), "left").withColumn("limit", F.coalesce("own", other))
    got = got.select("id", "lang", "k1", "k2", "n", "nll", smoothed(F.col("nll"), F.col("n"), F.col("limit.mean")).alias("score"), F.col("limit.worst").alias("worst"))
    return got.withColumn("kept", (F.col("n") > 0) & F.coalesce(F.col("score") <= F.col("worst"), F.lit(True)))


def keep_good(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", **more) -> DataFrame:
    """The rows of docs that judge() keeps, with the same columns, whatever their names.

    Rows of equal text and language stay or go together; null and empty texts go.
    """
    key = F.xxhash64(F.coalesce("lang", F.lit("")), F.col("lang").isNull()).alias("of_lang")
    bad = judge(docs, labels, id_col, text_col, lang_col, **more).where("not kept").select("k1", "k2", key).distinct()
    keyed = docs.select(row_of(docs), F.col(lang_col).cast("string").alias("lang"), *text_key(F.col(text_col).cast("string"))).select("row", "k1", "k2", key)
    return matched(keyed, stash(bad, "rejected"), ["k1", "k2", "of_lang"], "left_anti").select("row.*")
