"""SimHash near-duplicates by a binary trie self-join.

Fingerprints come from an Arrow map. Equal fingerprints form one node. Nodes go
into tries: for a budget of k bits, one of k + 1 blocks of a close pair is equal
(pigeonhole), so k + 1 rotations bring each block to the front, and the rows are
dealt by that block. A task walks the sorted fingerprints as a binary trie, two
trie nodes at a time, adds a differing bit when their branches part, and drops
the pair of nodes once it exceeds the budget. It returns a spanning forest, not
all pairs, so a group of near copies costs rows in proportion to its size.
A bucket above a set size is cut again by the blocks of its remaining bits.

Where a similarity is asked for, tries only propose: the components of their
loose links are compared pair by pair on the shingle sets, in blocks of nodes,
and only pairs that reach the similarity link.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from netquill.llm.common import matched, row_of, stash, text_key
from netquill.llm.components import components

#: Rows of a trie bucket above which it is cut by further blocks.
BUCKET_ROWS = 50_000
#: Rows a trie task gathers before it walks them (whole buckets).
CHUNK_ROWS = 200_000
SLICE = 1 << 16
#: Hashes times words counted at once, 4 MB.
GROUP_CELLS = 1 << 19
#: Words of 64 bits that a pair is tested on before it becomes a candidate.
CHECK_WORDS = 3
#: Nodes of a loose component in one block; a task compares one block with itself or another.
BLOCK_NODES = 1024
#: Share of all fingerprint bits beyond which shingle sets are not compared (about a Jaccard similarity of 0.55).
FAR = 0.25


def _hashes(raw: bytes, k: int):
    """XXH64 (seed 42) of every k-word shingle, in slices."""
    words = raw.lower().split()
    if not words:
        return
    joined = b" ".join(words)
    if len(words) < k:
        yield np.array([xxhash.xxh64_intdigest(joined, 42)], np.uint64)
        return
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))[: len(words) - k + 1].tolist()
    ends, digest = ends[k - 1 :].tolist(), xxhash.xxh64_intdigest
    for i in range(0, len(starts), SLICE):
        yield np.array([digest(joined[s:e], 42) for s, e in zip(starts[i : i + SLICE], ends[i : i + SLICE])], np.uint64)


def _mixed(h: np.ndarray, j: int) -> np.ndarray:
    """The j-th further 64 bits drawn from each hash."""
    with np.errstate(over="ignore"):
        z = h + np.uint64(0x9E3779B97F4A7C15) * np.uint64(j)
        z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return z ^ (z >> np.uint64(31))


def _planes(x: np.ndarray) -> list[np.ndarray]:
    """How often each bit is set over the first axis, as planes of binary digits: adders take three rows of one weight to a sum and a carry."""
    planes = []
    while True:
        carries = []
        while len(x) > 2:
            m = len(x) // 3
            a, b, c = x[:m], x[m : 2 * m], x[2 * m : 3 * m]
            odd = a ^ b
            carries.append((a & b) | (odd & c))
            x = np.concatenate((odd ^ c, x[3 * m :]))
        if len(x) == 2:
            carries.append(x[:1] & x[1:])
            x = x[:1] ^ x[1:]
        planes.append(x[0])
        if not carries:
            return planes
        x = np.concatenate(carries)


def _bit_counts(x: np.ndarray) -> np.ndarray:
    """x (rows, sets, words): the counts of each set's bits, (sets, words * 64)."""
    counts = np.zeros((x.shape[1], x.shape[2] * 64), np.int64)
    for k, plane in enumerate(_planes(x)):
        counts += np.unpackbits(np.ascontiguousarray(plane).view(np.uint8), axis=1, bitorder="little").astype(np.int64) << k
    return counts


def majorities(hashes: list[np.ndarray], n64: int) -> np.ndarray:
    """(sets, n64) words; a bit is set if it is in over half of the set's hashes. Sets of like size are counted at once."""
    size = np.array([len(h) for h in hashes], np.int64)
    out, order, i = np.zeros((len(hashes), n64), np.uint64), np.argsort(size, kind="stable"), 0

    def put(sets: np.ndarray, counts: np.ndarray) -> None:
        out[sets] = np.packbits((counts * 2 > size[sets][:, None]).astype(np.uint8), axis=1, bitorder="little").view("<u8")

    while i < len(order):
        j, room = i + 1, GROUP_CELLS // n64
        while j < len(order) and (j + 1 - i) * size[order[j]] <= room:
            j += 1
        sets, longest = order[i:j], int(size[order[j - 1]])
        i = j
        if longest * n64 > GROUP_CELLS:  # one very long set
            h, counts = hashes[sets[0]], np.zeros((1, n64 * 64), np.int64)
            for at in range(0, longest, SLICE):
                part = h[at : at + SLICE]
                counts += _bit_counts(np.stack([part if w == 0 else _mixed(part, w) for w in range(n64)], axis=1)[:, None, :])
            put(sets, counts)
        elif longest:
            x = np.zeros((longest, len(sets), n64), np.uint64)
            flat = np.concatenate([hashes[k] for k in sets])
            n = size[sets]
            of = np.repeat(np.arange(len(sets)), n)
            row = np.arange(len(flat)) - np.repeat(np.cumsum(n) - n, n)
            for w in range(n64):
                x[row, of, w] = flat if w == 0 else _mixed(flat, w)
            put(sets, _bit_counts(x))
    return out


def _all_hashes(raw: bytes | None, shingle: int) -> np.ndarray:
    return np.concatenate([*_hashes(raw or b"", shingle), np.zeros(0, np.uint64)])


def fingerprints(docs: DataFrame, id_col: str, text_col: str, shingle: int, n64: int = 1) -> DataFrame:
    """(id, fp array<long>) for each row of docs; nulls and empty texts have zeros."""
    kind = docs.schema[id_col].dataType

    def run(batches):
        for b in batches:
            got = majorities([_all_hashes(t.as_py(), shingle) for t in b.column(1).cast(pa.large_binary())], n64)
            flat = pa.array(got.view(np.int64).reshape(-1))
            offsets = pa.array(np.arange(0, got.size + 1, n64, dtype=np.int32))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.ListArray.from_arrays(offsets, flat)], names=["id", "fp"])

    return docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, f"id {kind.simpleString()}, fp array<bigint>")


def shingle_set(raw: bytes | None, k: int) -> np.ndarray:
    """Sorted distinct XXH64 of the k-word shingles."""
    return np.unique(_all_hashes(raw, k))


def set_fingerprints(docs: DataFrame, id_col: str, text_col: str, shingle: int, n64: int) -> DataFrame:
    """(id, k1, k2, s1, s2 long, fp array<long>) for each row: keys of the text and of its shingle set, and the bits of the set."""
    kind = docs.schema[id_col].dataType

    def run(batches):
        for b in batches:
            sets = [shingle_set(t.as_py(), shingle) for t in b.column(3).cast(pa.large_binary())]
            key = np.array([divmod(xxhash.xxh3_128_intdigest(h.tobytes()), 1 << 64) for h in sets], np.uint64).reshape(-1, 2)
            got = majorities(sets, n64)
            fp = pa.ListArray.from_arrays(pa.array(np.arange(0, got.size + 1, n64, dtype=np.int32)), pa.array(got.view(np.int64).reshape(-1)))
            yield pa.RecordBatch.from_arrays([*b.columns[:3], *[pa.array(np.ascontiguousarray(key[:, i]).view(np.int64)) for i in (0, 1)], fp], names=["id", "k1", "k2", "s1", "s2", "fp"])

    text = F.col(text_col).cast("string")
    return docs.select(F.col(id_col).alias("id"), *text_key(text), text.alias("text")).mapInArrow(run, f"id {kind.simpleString()}, k1 bigint, k2 bigint, s1 bigint, s2 bigint, fp array<bigint>")


def _labels(n: int, a: np.ndarray, b: np.ndarray, lab: np.ndarray) -> np.ndarray:
    """Labels (smallest index of a component) after joining a[i] with b[i]."""
    while len(a):
        la, lb = lab[a], lab[b]
        differ = la != lb
        if not differ.any():
            break
        a, b, la, lb = a[differ], b[differ], la[differ], lb[differ]
        np.minimum.at(lab, np.maximum(la, lb), np.minimum(la, lb))
        while True:
            up = lab[lab]
            if np.array_equal(up, lab):
                break
            lab = up
    return lab


def trie_links(v: np.ndarray, start: np.ndarray, stop: np.ndarray, depth: np.ndarray, width: int, budget: int, same=None, slice_pairs: int = 1 << 18) -> np.ndarray:
    """Component labels of v's entries, linked if width top bits differ in at most budget places.

    v: uint64 sorted within each bucket [start, stop), whose entries share the
    first depth bits. same(i, j): further test of candidate pairs. The budget is
    raised step by step; pairs of trie nodes that are wholly in one component
    are dropped, so dense groups are not compared pair by pair.
    """
    n = len(v)
    lab, differs = np.arange(n), None
    ok = stop - start > 1
    roots = (start[ok], stop[ok], depth[ok])

    def uniform():
        out = np.zeros(n + 1, np.int64)
        out[2:] = np.cumsum(lab[1:] != lab[:-1])
        return out  # entries lo..hi-1 have one label if out[hi] == out[lo + 1]

    for allowed in range(budget + 1):
        stack = [(roots[0], roots[1], roots[0], roots[1], roots[2], np.zeros(len(roots[0]), np.int64))]
        differs = uniform()
        while stack:
            lo1, hi1, lo2, hi2, dep, acc = stack.pop()
            if len(lo1) > slice_pairs // 4:
                stack.append(tuple(x[: len(lo1) // 2] for x in (lo1, hi1, lo2, hi2, dep, acc)))
                stack.append(tuple(x[len(lo1) // 2 :] for x in (lo1, hi1, lo2, hi2, dep, acc)))
                continue
            done = (differs[hi1] == differs[lo1 + 1]) & (differs[hi2] == differs[lo2 + 1]) & (lab[lo1] == lab[lo2])
            own = lo1 == lo2
            n1, n2 = hi1 - lo1, hi2 - lo2
            live = ~done & (n1 > 0) & (n2 > 0) & (acc <= allowed) & ~(own & (n1 == 1))
            small = live & (n1 * n2 <= 64)
            if small.any():
                a0, b0, m1, m2 = lo1[small], lo2[small], n1[small], n2[small]
                size = m1 * m2
                at = np.repeat(np.arange(len(size)), size)
                k = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
                i, j = a0[at] + k // m2[at], b0[at] + k % m2[at]
                near = (i < j) & (np.bitwise_count((v[i] ^ v[j]) >> np.uint64(64 - width)) <= allowed) & (lab[i] != lab[j])
                i, j = i[near], j[near]
                if same is not None and len(i):
                    near = same(i, j)
                    i, j = i[near], j[near]
                if len(i):
                    lab = _labels(n, i, j, lab)
                    differs = uniform()
            live &= ~small
            if not live.any():
                continue
            lo1, hi1, lo2, hi2, dep, acc, own = (x[live] for x in (lo1, hi1, lo2, hi2, dep, acc, own))
            spent = dep >= width  # no bit is left: halves, which differ in nothing
            m1, m2 = _part(v, lo1, hi1, dep, spent), _part(v, lo2, hi2, dep, spent)
            step, d = (~spent).astype(np.int64), dep + ~spent
            other = ~own
            parts = [(lo1, m1, lo2, m2, d, acc), (m1, hi1, m2, hi2, d, acc), (lo1, m1, m2, hi2, d, acc + step)]
            parts.append(tuple(x[other] for x in (m1, hi1, lo2, m2, d, acc + step)))
            across = [np.concatenate(x) for x in zip(*parts[2:])]
            within = [np.concatenate(x) for x in zip(*parts[:2])]
            for p in (across, within):
                keep = (p[1] > p[0]) & (p[3] > p[2]) & (p[5] <= allowed)
                if keep.any():
                    stack.append(tuple(x[keep] for x in p))
    return lab


def _part(v: np.ndarray, lo: np.ndarray, hi: np.ndarray, dep: np.ndarray, spent: np.ndarray) -> np.ndarray:
    """Where the branch of bit 1 begins in each range; the middle where no bit is left."""
    shift = np.where(spent, 0, 63 - dep).astype(np.uint64)
    a, b = lo.copy(), hi.copy()
    while True:
        open_ = a < b
        if not open_.any():
            break
        mid = (a + b) // 2
        one = (v[np.minimum(mid, len(v) - 1)] >> shift) & np.uint64(1) == 1
        b = np.where(open_ & one, mid, b)
        a = np.where(open_ & ~one, mid + 1, a)
    return np.where(spent, (lo + hi) // 2, a)


def _rotations(rows: DataFrame, depth: int, width: int, budget: int) -> tuple[DataFrame, int]:
    """Each row once for each block of the bits after depth; and the depth that the block then covers."""
    rest = width - depth
    block = -(-rest // (budget + 1))
    need = rest - budget * block
    mask = ((1 << rest) - 1) << (64 - width)

    def turned(r):
        if not r:
            return "v"
        low = f"(v & {_signed(mask)}L)" if depth or width < 64 else "v"
        high = f"(v & {_signed(~mask & (2**64 - 1))}L) | " if depth else ""
        return f"({high}((shiftleft({low}, {r * block}) | shiftrightunsigned({low}, {rest - r * block})) & {_signed(mask)}L))"

    each = F.explode(F.array(*[F.struct((F.col("path") * (budget + 2) + (r + 1)).alias("path"), F.expr(turned(r)).alias("v")) for r in range(budget + 1)])).alias("x")
    kept = [c for c in rows.columns if c not in ("path", "v", "prefix")]
    return rows.select(*kept, each).select(*kept, "x.path", "x.v").withColumn("prefix", F.shiftrightunsigned("v", 64 - depth - need)), depth + need


def _signed(x: int) -> int:
    return x - (1 << 64) if x >= 1 << 63 else x


def trie_edges(nodes: DataFrame, width: int, budget: int, check_bits: int | None = None) -> DataFrame:
    """Spanning edges (u, v) between nodes whose fingerprints are near.

    nodes: (node long, t int, v long, chk array<long>): v holds width bits from
    the top, and t separates tables. check_bits: most bits of chk that a linked
    pair may differ in.
    """
    rows, depth = _rotations(nodes.withColumn("path", F.lit(0).cast("long")), 0, width, budget)
    levels, key = [], ["t", "path", "prefix"]
    while True:
        last = width - depth - budget * -(-(width - depth) // (budget + 1)) < 1
        hot = None if last else stash(rows.groupBy(*key).agg(F.count("*").alias("n")).where(F.col("n") > BUCKET_ROWS).select(*key), "hot")
        if hot is None or hot.isEmpty():
            levels.append(rows.withColumn("depth", F.lit(depth)))
            break
        levels.append(rows.join(hot, key, "left_anti").withColumn("depth", F.lit(depth)))
        rows, depth = _rotations(rows.join(hot, key, "left_semi"), depth, width, budget)
    cols = ["t", "path", "prefix", "depth", "v", "node", "chk"]
    dealt = reduce(DataFrame.union, [x.select(*cols) for x in levels]).repartition(*key).sortWithinPartitions("t", "path", "prefix", "v")

    def run(batches):
        held, rows_held = [], 0
        for b in batches:
            if not b.num_rows:
                continue
            held.append(b)
            rows_held += b.num_rows
            if rows_held >= CHUNK_ROWS:
                whole = pa.Table.from_batches(held).combine_chunks()
                key_at = [whole.column(i).to_numpy() for i in range(3)]
                last = np.flatnonzero(np.any([k[1:] != k[:-1] for k in key_at], axis=0))
                if len(last):  # the last bucket may go on
                    cut = int(last[-1]) + 1
                    yield from _walk(whole.slice(0, cut), width, budget, check_bits)
                    held = whole.slice(cut).combine_chunks().to_batches()
                    rows_held = whole.num_rows - cut
                else:
                    held = whole.to_batches()
        if held:
            yield from _walk(pa.Table.from_batches(held).combine_chunks(), width, budget, check_bits)

    return dealt.mapInArrow(run, "u bigint, v bigint")


def _walk(rows: pa.Table, width: int, budget: int, check_bits: int | None):
    t, path, prefix, depth, v, node = (rows.column(i).to_numpy() for i in range(6))
    if not len(v):
        return
    new = np.concatenate(([True], (t[1:] != t[:-1]) | (path[1:] != path[:-1]) | (prefix[1:] != prefix[:-1])))
    v = v.view(np.uint64)
    start = np.flatnonzero(new)
    stop = np.append(start[1:], len(v))
    by = np.lexsort((v, np.cumsum(new)))
    v, node = v[by], node[by]
    same = None
    if check_bits is not None:
        flat = rows.column(6).combine_chunks()
        flat = (flat.chunk(0) if isinstance(flat, pa.ChunkedArray) else flat).flatten().to_numpy()
        chk = flat.view(np.uint64).reshape(len(v), -1)[by]
        same = lambda i, j: np.bitwise_count(chk[i] ^ chk[j]).sum(1, dtype=np.int64) <= check_bits
    lab = trie_links(v, start, stop, depth[start].astype(np.int64), width, budget, same)
    least = node.copy()
    np.minimum.at(least, lab, node)
    least = least[lab]  # the same end in every bucket that holds it, so that edges of many tables coincide
    far = np.flatnonzero(node != least)
    if len(far):
        yield pa.RecordBatch.from_arrays([pa.array(node[far]), pa.array(least[far])], names=["u", "v"])


def exact_edges(docs: DataFrame, text_col: str, shingle: int, loose: DataFrame, similarity: float) -> DataFrame:
    """Spanning edges (u, v) of the pairs in a loose component whose shingle sets have at least that Jaccard similarity.

    loose: (node, component, k1, k2, fp), one row for each node and the key of one
    of its texts. Every pair of a component meets in one task, by blocks of
    BLOCK_NODES nodes.
    """
    text = F.col(text_col).cast("string")
    texts = matched(docs.select(*text_key(text), text.alias("text")), loose.select("k1", "k2"), ["k1", "k2"], "left_semi")
    one = texts.groupBy("k1", "k2").agg(F.first("text").alias("text")).join(loose, ["k1", "k2"])

    def sets(batches):
        for b in batches:
            got = [shingle_set(t.as_py(), shingle) for t in b.column(2).cast(pa.large_binary())]
            at = np.concatenate(([0], np.cumsum([len(x) for x in got]))).astype(np.int32)
            flat = np.concatenate([*got, np.zeros(0, np.uint64)]).view(np.int64)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(3), pa.ListArray.from_arrays(pa.array(at), pa.array(flat))], names=["node", "component", "fp", "sh"])

    held = stash(one.select("node", "component", "text", "fp").mapInArrow(sets, "node bigint, component bigint, fp array<bigint>, sh array<bigint>"), "shingles")
    size = held.groupBy("component").agg(F.ceil(F.count("*") / BLOCK_NODES).cast("int").alias("blocks"))
    own = F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int")
    rows = held.join(size, "component").withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    key = ["component", "i", "j"]
    rows = rows.withColumn("i", F.least("own", "other")).withColumn("j", F.greatest("own", "other"))
    dealt = rows.select(*key, "own", "node", "fp", "sh").repartition(*key).sortWithinPartitions(*key)

    def run(batches):
        now, group = None, []
        for b in batches:
            keys = list(zip(*(b.column(k).to_pylist() for k in range(3))))
            own, node = b.column(3).to_pylist(), b.column(4).to_pylist()
            for r, k in enumerate(keys):
                if k != now and group:
                    yield from _compare(now, group, similarity)
                    group = []
                now = k
                group.append((own[r], node[r], b.column(5)[r].values.to_numpy().view(np.uint64), b.column(6)[r].values.to_numpy().view(np.uint64)))
        if group:
            yield from _compare(now, group, similarity)

    return dealt.mapInArrow(run, "u bigint, v bigint")


def _compare(key: tuple, group: list, similarity: float):
    """Verified edges between the two blocks of a group, or within its only one; nearest pairs first."""
    _, i, j = key
    first = [g for g in group if g[0] == i]
    second = first if i == j else [g for g in group if g[0] == j]
    if not first or not second:
        return
    fa, fb = np.stack([g[2] for g in first]), np.stack([g[2] for g in second])
    na, nb = np.array([len(g[3]) for g in first]), np.array([len(g[3]) for g in second])
    most, found = int(FAR * 64 * fa.shape[1]), []
    for a in range(len(first)):
        d = np.bitwise_count(fb ^ fa[a]).sum(1, dtype=np.int64)
        ok = (d <= most) & (np.minimum(nb, na[a]) >= similarity * np.maximum(nb, na[a]) - 1e-6)
        if i == j:
            ok[: a + 1] = False
        b = np.flatnonzero(ok)
        found.append(np.stack((d[b], np.full(len(b), a), b), axis=1))
    pairs = np.concatenate(found)
    up: dict[int, int] = {}

    def root(x):
        while x in up:
            x = up[x]
        return x

    us, vs = [], []
    for _, a, b in pairs[np.argsort(pairs[:, 0], kind="stable")].tolist():
        u, v = first[a], second[b]
        ru, rv = root(u[1]), root(v[1])
        if ru == rv:
            continue
        both = len(np.intersect1d(u[3], v[3], assume_unique=True))
        union = len(u[3]) + len(v[3]) - both
        if union and both / union >= similarity:
            up[max(ru, rv)] = min(ru, rv)
            us.append(u[1])
            vs.append(v[1])
    if us:
        yield pa.RecordBatch.from_arrays([pa.array(us, pa.int64()), pa.array(vs, pa.int64())], names=["u", "v"])


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 5, width: int = 32, tables: int = 40, budget: int = 2, check: float | None = 0.24, similarity: float = 0.8) -> DataFrame:
    """(id, fp array<long>, component_id), and component, k1 and k2 where texts are compared, for each row of docs.

    Two texts link if their shingle sets have at least that Jaccard similarity,
    compared exactly. Compared are all pairs of a loose component: there two
    texts hang together if, in one of the tables of width bits, at most budget
    bits differ and at most the share check of the first 64 * CHECK_WORDS bits
    (two sets of similarity 0.8 differ in 0.1515 of the bits on average).
    No pair below the similarity links; one that reaches it is missed with the
    probability that README.md tables. component_id is the smallest id
    reachable, itself included; component numbers the components, and k1 and k2
    are the text's key. With tables=1, width=64 and check=None there is no
    comparison, and links are exactly the pairs of fingerprints (in which a
    repeated shingle counts each time) within the budget.

    Null ids are allowed: they never lower a component_id and get null only if
    no linked row has an id. Null, empty and white-space texts have an all-zero
    fingerprint and are equal to each other. Texts are read whole. Repeated rows
    get equal results. Other columns are left out. An empty table gives an empty
    result.
    """
    n64 = -(-width * tables // 64)
    if check is None:
        if n64 != 1:
            raise ValueError("several tables need a comparison")
        fps = stash(fingerprints(docs, id_col, text_col, shingle, n64).withColumn("node", F.col("fp")[0]), "fingerprints")
        classes = stash(fps.groupBy("node").agg(F.min("id").alias("first"), F.first("fp").alias("fp")), "classes")
    else:
        fps = stash(set_fingerprints(docs, id_col, text_col, shingle, n64), "fingerprints")
        classes = fps.groupBy("s1", "s2").agg(F.min("id").alias("first"), F.first("fp").alias("fp"), F.min(F.struct("k1", "k2")).alias("k"))
        classes = stash(classes.select(F.monotonically_increasing_id().alias("node"), "s1", "s2", "first", "fp", "k.k1", "k.k2"), "classes")
    per = 64 // width
    top = [F.expr(f"shiftleft(shiftrightunsigned(fp[{t // per}], {width * (t % per)}), {64 - width})") for t in range(tables)]
    chk = F.slice("fp", 1, CHECK_WORDS) if check is not None else F.lit(None).cast("array<bigint>")
    nodes = classes.select("node", chk.alias("chk"), F.posexplode(F.array(*top)).alias("t", "v"))
    edges = stash(trie_edges(nodes, width, budget, None if check is None else int(check * 64 * CHECK_WORDS)), "edges")
    linked = components(edges)
    if check is not None:
        loose = stash(linked.join(classes.select("node", "k1", "k2", "fp"), "node"), "loose")
        linked = components(stash(exact_edges(docs, text_col, shingle, loose, similarity), "exact_edges"))
    member = stash(linked.join(classes.select("node", "first"), "node"), "members")
    lowest = member.groupBy("component").agg(F.min("first").alias("lowest"))
    named = member.join(lowest, "component").select("node", "component", "lowest")
    own = [] if check is None else ["s1", "s2"]
    ids = classes.select("node", "first", *own).join(named, "node", "left").select("node", *own, F.coalesce("component", "node").alias("component"), F.coalesce("lowest", "first").alias("component_id"))
    ids = stash(ids, "component_ids")
    if check is None:
        return fps.join(ids, "node").select("id", "fp", "component_id")
    return fps.join(ids, ["s1", "s2"]).select("id", "fp", "component_id", "component", "k1", "k2")


def first_of_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **how) -> DataFrame:
    """One row of each group of near copies, with docs' columns, whatever their names.

    Rows are told apart by id and text, so a row stays if only its id is that of a
    near copy. Of a group the smallest id stays, any id before none, ties by the
    text's key; of rows equal in both the one whose other columns hash lowest.
    """

    def keys(id_: Column) -> list[Column]:
        known = [F.coalesce(id_.cast("string"), F.lit("")), id_.isNull(), F.col("k1"), F.col("k2")]
        return [F.xxhash64(*known).alias("r1"), F.xxhash64(F.lit(1), *known).alias("r2")]

    got = near_duplicates(docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")), "id", "text", **how)
    got = got.groupBy("component", "id", "k1", "k2").agg(F.count("*").alias("n")).select("component", F.struct(F.col("id").isNull().alias("none"), "id", "k1", "k2").alias("x"), "n", *keys(F.col("id")))
    got = stash(got, "rows")
    best = got.groupBy("component").agg(F.min(F.struct("x", "n", "r1", "r2")).alias("b"), F.count("*").alias("m"))
    best = stash(best.where((F.col("m") > 1) | (F.col("b.n") > 1)).select("component", "b.r1", "b.r2", "b.n"), "best")
    go = got.join(best.select("component", F.col("r1").alias("b1"), F.col("r2").alias("b2")), "component").where((F.col("r1") != F.col("b1")) | (F.col("r2") != F.col("b2")))
    keyed = docs.select(row_of(docs), F.col(id_col).alias("id"), *text_key(F.col(text_col).cast("string"))).select("row", *keys(F.col("id")))
    left = matched(keyed, stash(go.select("r1", "r2"), "copies"), ["r1", "r2"], "left_anti")
    twice = stash(best.where("n > 1").select("r1", "r2"), "twice")
    once = matched(left, twice, ["r1", "r2"], "left_anti").select("row")
    several = matched(left, twice, ["r1", "r2"], "left_semi").groupBy("r1", "r2").agg(F.min_by("row", F.xxhash64(F.to_json("row"))).alias("row")).select("row")
    return once.union(several).select("row.*")


def hex16(word: Column) -> Column:
    """16 lowercase hex digits of a long, taken as unsigned."""
    return F.lpad(F.lower(F.hex(word)), 16, "0")
