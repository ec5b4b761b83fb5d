"""Removal of repeated byte strings by suffix arrays.

Every SPAN-byte string has an anchor, the K-byte gram of least hash in it, so
equal strings have equal anchors at equal offsets. All strings that an anchor can
belong to lie in its context, the bytes from SPAN - K before it to SPAN after its
start. Hashes of anchors only route: contexts whose anchor stands at two or more
places go with their bytes to the shard of that anchor. There they are sorted;
contexts that are byte for byte equal are removed whole. An anchor's strings fall
into four classes by its offset; the bytes that all strings of a class hold (its
core) have to be equal too, and so the blocks of classes whose core stands twice
are what the shard's suffix array takes: Larsson-Sadakane refinement sorts their
suffixes, Kasai's pass gives the common prefixes, and neighbours that share SPAN
bytes at different places of the input are repeats. An anchor with very many
contexts is dealt over shards by class and core. A shard that is still too large
is cut, and its parts are merged by binary search in sorted runs of their distinct
strings.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from netquill.llm.common import drop_stash, matched, release, stash

SPAN, K = 200, 64
WIDE = SPAN - K + 1
#: Bytes of a context before its anchor, and in all.
BEFORE, CONTEXT = SPAN - K, 2 * SPAN - K
#: Class j of an anchor: the strings in which it begins at byte STEP * j to STEP * (j + 1) - 1.
CLASSES, STEP = 4, 35
#: Bytes that all strings of a class hold.
CORE = SPAN - STEP + 1
#: Bytes hashed at a time, texts looked through for their own repeats, and contexts in one suffix array.
PIECE, CHUNK_BYTES, SHARD_BYTES = 1 << 21, 1 << 24, 1 << 19
#: Contexts of one anchor in one shard.
SHARD_CONTEXTS = 2_048
CHUNK_ROWS = 300_000
# Fixed values of the hash: odd 64-bit multipliers.
_M = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB)]


def gram_hashes(data: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each K-byte gram, by doubling."""
    h = (data.astype(np.uint64) + np.uint64(1)) * _M[5]
    h ^= h >> np.uint64(29)
    step = 1
    for m in _M:
        h = h[:-step] * m + h[step:]
        h ^= h >> np.uint64(31)
        step *= 2
    return h


def _anchors(h: np.ndarray, begin: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Anchors of the strings that start in the ranges [begin, end): their places, and the first and last start of each one's strings."""
    n = len(h)
    mask = (np.uint64(1) << np.uint64(n.bit_length())) - np.uint64(1)
    grid = np.full((-(-n // WIDE) + 1) * WIDE, np.uint64(2**64 - 1))
    grid[:n] = (h & ~mask) | np.arange(n, dtype=np.uint64)
    grid = grid.reshape(-1, WIDE)
    after = np.minimum.accumulate(grid, axis=1).reshape(-1)
    before = np.minimum.accumulate(grid[:, ::-1], axis=1)[:, ::-1].reshape(-1)
    m = n - WIDE + 1
    low = np.minimum(before[:m], after[WIDE - 1 : WIDE - 1 + m])
    ok = np.zeros(m + 1, np.int64)
    np.add.at(ok, begin, 1)
    np.add.at(ok, end, -1)
    starts = np.flatnonzero(np.cumsum(ok[:m]) > 0)
    at = (low[starts] & mask).astype(np.int64)
    new = np.ones(len(at), bool)
    new[1:] = at[1:] != at[:-1]
    first = np.flatnonzero(new)
    return at[first], starts[first], starts[np.append(first[1:], len(at)) - 1] if len(at) else starts


def _mix(h: np.ndarray, salt) -> np.ndarray:
    h = (h ^ (h >> np.uint64(32))) * _M[1] + np.asarray(salt).astype(np.uint64) * _M[2]
    return (h ^ (h >> np.uint64(29))) * _M[3]


def _pieces(texts: list[bytes]):
    """(data, doc of each part, its start in data, its offset in the doc, first and end string start, doc bounds), PIECE bytes or so at a time."""
    part, size = [], 0
    for d, t in enumerate(texts):
        for s in range(0, max(0, len(t) - SPAN + 1), PIECE):
            e = min(s + PIECE, len(t) - SPAN + 1)
            lo, hi = max(0, s - 2 * SPAN), min(len(t), e + 3 * SPAN)
            part.append((d, lo, hi, s, e))
            size += hi - lo
            if size >= PIECE:
                yield _piece(texts, part)
                part, size = [], 0
    if part:
        yield _piece(texts, part)


def _piece(texts, part):
    data = np.frombuffer(b"".join(texts[d][lo:hi] for d, lo, hi, _, _ in part), np.uint8)
    doc, lo, hi, s, e = (np.array(x, np.int64) for x in zip(*part))
    size = np.array([len(texts[d]) for d in doc], np.int64)
    at = np.cumsum(hi - lo) - (hi - lo)
    return data, doc, at, lo, at + s - lo, at + e - lo, size


def anchors(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Anchors of all texts: text, place in it, the gram's hash, and a hash of the context that only chooses what is compared."""
    out = []
    for data, doc, at, lo, begin, end, size in _pieces(texts):
        g = gram_hashes(data)
        p, _, _ = _anchors(g, begin, end)
        if not len(p):
            continue
        part = np.searchsorted(at, p, "right") - 1
        zero = at[part] - lo[part]  # where the text's byte 0 is, or would be
        first, last = np.maximum(p - BEFORE, zero), np.minimum(p + SPAN, zero + size[part])
        x = (p - first).astype(np.uint64) * _M[0] + (last - p).astype(np.uint64)
        for o in range(0, CONTEXT, K):
            x = _mix(x ^ g[np.minimum(first + o, last - K)], o)
        out.append((doc[part], p - zero, _mix(g[p], 0), x))
    if not out:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(0, np.uint64)
    doc, pos, h, x = map(np.concatenate, zip(*out))
    fresh = np.ones(len(pos), bool)
    fresh[1:] = (doc[1:] != doc[:-1]) | (pos[1:] != pos[:-1])  # two pieces of a text may each have some strings of an anchor
    return doc[fresh], pos[fresh], h[fresh], x[fresh]


def _groups(*keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """An order that sorts by keys, and the start flags of equal runs in it."""
    by = np.lexsort(keys[::-1])
    new = np.ones(len(by), bool)
    if len(by):
        new[1:] = np.any([k[by][1:] != k[by][:-1] for k in keys], axis=0)
    return by, new


_ROW = "kind int, h bigint, k1 bigint, k2 bigint, place bigint, a bigint, b bigint"
_NAMES = ["h", "k1", "k2", "place", "a", "b"]


def _key(raw: bytes) -> tuple[int, int]:
    d = hashlib.sha256(raw).digest()
    return int.from_bytes(d[:8], "big", signed=True), int.from_bytes(d[8:16], "big", signed=True)


def _row(kind: int, **cols) -> pa.RecordBatch:
    """A batch of _ROW; columns that are not given are 0."""
    n = len(cols["k1"])
    as_long = lambda x: x.view(np.int64) if x.dtype == np.uint64 else x.astype(np.int64)
    full = [pa.array(as_long(np.ascontiguousarray(cols[k])) if k in cols else np.zeros(n, np.int64)) for k in _NAMES]
    return pa.RecordBatch.from_arrays([pa.array(np.full(n, kind, np.int32)), *full], names=["kind", *_NAMES])


def _stretches(k1, k2, start, stop):
    """The same bytes in fewest stretches."""
    by = np.lexsort((start, k2, k1))
    k1, k2, start, stop = k1[by], k2[by], start[by], stop[by]
    doc = np.ones(len(by), bool)
    doc[1:] = (k1[1:] != k1[:-1]) | (k2[1:] != k2[:-1])
    base = (np.cumsum(doc) - 1) * np.int64(1 << 40)  # texts one after the other
    reach = np.maximum.accumulate(stop + base)
    new = doc.copy()
    new[1:] |= (start + base)[1:] > reach[:-1]
    at = np.flatnonzero(new)
    return k1[at], k2[at], start[at], (reach - base)[np.append(at[1:], len(by)) - 1] if len(by) else stop


def _known(k1, k2, start, stop) -> pa.RecordBatch:
    k1, k2, start, stop = _stretches(k1, k2, start, stop)
    return _row(0, h=_mix(k1.view(np.uint64), 1), k1=k1, k2=k2, place=start, a=stop)


def _context(text: bytes, pos: int) -> bytes:
    return text[max(0, pos - BEFORE) : pos + SPAN]


def _chunk(texts: list[bytes], copies: list[int]):
    """Rows of a chunk's different texts; copies: how often each stands in it."""
    keys = np.array([_key(t) for t in texts], np.int64).reshape(-1, 2)
    whole = np.flatnonzero(np.array(copies) > 1)
    if len(whole):
        yield _known(keys[whole, 0], keys[whole, 1], np.zeros(len(whole), np.int64), np.array([len(texts[i]) for i in whole], np.int64))
    doc, pos, h, x = anchors(texts)
    if not len(h):
        return
    by, new = _groups(h, x)
    begin = np.flatnonzero(new)
    size = np.diff(np.append(begin, len(by)))
    keep, many, found = np.ones(len(h), bool), np.zeros(len(h), np.int64), []
    many[np.array(copies)[doc] > 1] = 1
    for b, n in zip(begin[size > 1].tolist(), size[size > 1].tolist()):
        rep = by[b]
        first = _context(texts[doc[rep]], pos[rep])
        same = [i for i in by[b + 1 : b + n].tolist() if _context(texts[doc[i]], pos[i]) == first]
        if same:
            many[rep] = 1
            keep[same] = False
            found += [rep, *same]
    if found:
        i = np.array(found)
        yield _known(keys[doc[i], 0], keys[doc[i], 1], np.maximum(pos[i] - BEFORE, 0), np.minimum(pos[i] + SPAN, np.array([len(t) for t in texts], np.int64)[doc[i]]))
    i = np.flatnonzero(keep)
    for j in range(0, len(i), 1 << 16):
        r = i[j : j + (1 << 16)]
        yield _row(1, h=h[r], k1=keys[doc[r], 0], k2=keys[doc[r], 1], place=pos[r], b=many[r])


def _map_anchors(batches):
    """Kind 0: stretches [place, a) that repeat within a chunk of texts. Kind 1: one of the anchors of each different context; b: 1 if its context is known to repeat."""
    held, size = {}, 0
    for b in batches:
        for t in b.column(0).cast(pa.large_binary()):
            raw = t.as_py()
            if raw is None or len(raw) < SPAN:
                continue
            if raw in held:
                held[raw] += 1
                continue
            held[raw] = 1
            size += len(raw)
            if size >= CHUNK_BYTES:
                yield from _chunk(list(held), list(held.values()))
                held, size = {}, 0
    if held:
        yield from _chunk(list(held), list(held.values()))


def _by_key(batches, columns: int, limit: int, weigh=None):
    """Tables of whole runs of equal leading columns, limit rows (or weight) or more each."""
    held, size = [], 0
    for b in batches:
        if not b.num_rows:
            continue
        held.append(b)
        size += weigh(b) if weigh else b.num_rows
        if size < limit:
            continue
        whole = pa.Table.from_batches(held).combine_chunks()
        keys = [whole.column(i).to_numpy() for i in range(columns)]
        last = np.flatnonzero(np.any([k[1:] != k[:-1] for k in keys], axis=0))
        cut = int(last[-1]) + 1 if len(last) else 0
        if cut:
            yield whole.slice(0, cut)
        held = whole.slice(cut).combine_chunks().to_batches()
        size = sum(weigh(x) if weigh else x.num_rows for x in held)
    if held:
        yield pa.Table.from_batches(held).combine_chunks()


def _map_judge(batches):
    """From anchors in order of h and place. Kind 0: contexts of texts that stand twice. Kind 1: anchors whose gram stands at two or more places (b: 1 if the context is known to repeat).

    One place is held back until the next is seen, and no anchor's places together.
    """
    last, before = None, False  # the last place, and whether its gram stood before it
    for b in batches:
        if not b.num_rows:
            continue
        cols = [b.column(i).to_numpy() for i in range(5)]
        if last is not None:
            cols = [np.concatenate(([x], c)) for x, c in zip(last, cols)]
        h, k1, k2, place, many = cols
        fresh = np.ones(len(h), bool)
        fresh[1:] = (h[1:] != h[:-1]) | (k1[1:] != k1[:-1]) | (k2[1:] != k2[:-1]) | (place[1:] != place[:-1])
        at = np.flatnonzero(fresh)
        twice = np.diff(np.append(at, len(h))) > 1  # one text in several tasks
        flag = np.maximum.reduceat(many, at) | twice
        h, k1, k2, place = (c[at] for c in (h, k1, k2, place))
        near = np.zeros(len(at) + 1, bool)
        near[1:-1] = h[1:] == h[:-1]
        near[0] = before
        last, before = (h[-1], k1[-1], k2[-1], place[-1], flag[-1]), bool(near[-2])
        yield from _judged(h[:-1], k1[:-1], k2[:-1], place[:-1], flag[:-1], near[:-2] | near[1:-1], twice[:-1])
        if twice[-1]:
            yield from _judged(*(np.array([x]) for x in last), np.array([False]), np.array([True]))
    if last is not None:
        yield from _judged(*(np.array([x]) for x in last), np.array([before]), np.array([False]))


def _judged(h, k1, k2, place, flag, asked, twice):
    if twice.any():
        yield _known(k1[twice], k2[twice], np.maximum(place[twice] - BEFORE, 0), place[twice] + SPAN)
    if asked.any():
        yield _row(1, h=h[asked], k1=k1[asked], k2=k2[asked], place=place[asked], b=flag[asked])


def _words(data: np.ndarray) -> np.ndarray:
    """The 8 bytes from each place as a number, zeros after the end; SPAN places more than data has."""
    n = len(data) + SPAN
    padded = np.concatenate((data, np.zeros(SPAN + 8, np.uint8))).astype(np.uint64)
    word = np.zeros(n, np.uint64)
    for i in range(8):
        word = (word << np.uint64(8)) | padded[i : i + n]
    return word


def suffix_array(data: np.ndarray, start: np.ndarray, stop: np.ndarray) -> np.ndarray:
    """Places of all suffixes with SPAN or more bytes left in their part, in order of their first SPAN bytes.

    Larsson-Sadakane: places are sorted by 8 bytes, then groups that are still
    tied are sorted by the rank of the place as many bytes on, which doubles what
    is compared; a rank is the group's first index, so settled ranks stay.
    """
    n = len(data)
    left = np.repeat(stop, stop - start) - np.arange(n)
    word = _words(data)[:n]
    known, length = np.flatnonzero(left >= 8), 8
    order = known[np.argsort(word[known], kind="stable")]
    new = np.concatenate(([True], word[order][1:] != word[order][:-1]))
    rank = np.full(n, -1, np.int64)
    rank[order] = np.maximum.accumulate(np.where(new, np.arange(len(order)), 0))
    at = np.arange(len(order))  # the indexes of order that are not settled
    while length < SPAN:
        ahead = min(length, SPAN - length)
        size = np.diff(np.append(np.flatnonzero(new), len(order)))
        tied = np.repeat(size > 1, size)
        at = np.flatnonzero(tied)
        p = order[at]
        on = left[p] >= length + ahead
        second = np.where(on, rank[np.minimum(p + ahead, n - 1)], -1 - p)  # too short to matter: apart
        by = np.lexsort((second, rank[p]))
        p, second, first = p[by], second[by], rank[p][by]
        order[at] = p
        fresh = np.ones(len(p), bool)
        fresh[1:] = (first[1:] != first[:-1]) | (second[1:] != second[:-1])
        new[at] = fresh
        rank[p] = np.maximum.accumulate(np.where(fresh, at, 0))
        length += ahead
    return order[left[order] >= SPAN]


def common_prefixes(data: np.ndarray, start: np.ndarray, stop: np.ndarray, order: np.ndarray) -> np.ndarray:
    """Bytes (SPAN at most) that each entry of order shares with the one before it.

    Kasai's pass, one step of all parts at a time: a suffix shares with its
    predecessor at least one byte less than the suffix one byte earlier did. That
    holds below SPAN bytes only, as equal strings stand in any order.
    """
    n = len(data)
    prev = np.full(n + 1, -1, np.int64)
    prev[order[1:]] = order[:-1]
    inside = np.zeros(n + 1, bool)
    inside[order] = True
    word = _words(data)
    out = np.zeros(n, np.int64)
    carry, parts = np.zeros(len(start), np.int64), np.arange(len(start))
    for t in range(int((stop - start).max(initial=0)) - SPAN + 1):
        parts = parts[start[parts] + t <= stop[parts] - SPAN]
        p = start[parts] + t
        q = prev[p]
        shared = np.where(q >= 0, carry[parts], 0)
        open_ = np.flatnonzero((q >= 0) & (shared < SPAN))
        while len(open_):
            differ = word[p[open_] + shared[open_]] ^ word[q[open_] + shared[open_]]
            equal = np.where(differ == 0, 8, sum((differ < np.uint64(1 << (64 - 8 * i))).astype(np.int64) for i in range(1, 8)))
            shared[open_] = np.minimum(shared[open_] + equal, SPAN)
            open_ = open_[(equal == 8) & (shared[open_] < SPAN)]
        out[p] = shared
        carry[parts] = np.where((q >= 0) & inside[q + 1] & (shared < SPAN), np.maximum(shared - 1, 0), 0)
    return out[order]


def _shard_parts(batches):
    """(table, cut): whole runs of equal (h, a), SHARD_BYTES or more; cut: a part of one run that is longer, so nothing is held whole."""
    held, size, cut = [], 0, False
    for b in batches:
        for at in range(0, b.num_rows, SHARD_CONTEXTS):
            part = b.slice(at, SHARD_CONTEXTS)
            held.append(part)
            size += part.column(2).nbytes
            if size < SHARD_BYTES and sum(x.num_rows for x in held) < 4 * SHARD_CONTEXTS:
                continue
            whole = pa.Table.from_batches(held).combine_chunks()
            h, a = whole.column(0).to_numpy(), whole.column(1).to_numpy()
            last = np.flatnonzero((h[1:] != h[:-1]) | (a[1:] != a[:-1]))
            if cut:  # the run that was cut ends in its own part
                first = int(last[0]) + 1 if len(last) else whole.num_rows
                yield whole.slice(0, first), True
                whole, last = whole.slice(first), last[1:] - first
                cut = not whole.num_rows
            if len(last):
                yield whole.slice(0, int(last[-1]) + 1), False
                whole = whole.slice(int(last[-1]) + 1)
            elif whole.num_rows >= 2 * SHARD_CONTEXTS:
                yield whole, True
                whole, cut = whole.slice(0, 0), True
            held = whole.combine_chunks().to_batches() if whole.num_rows else []
            size = sum(x.column(2).nbytes for x in held)
    if held:
        whole = pa.Table.from_batches(held).combine_chunks()
        if cut:
            h, a = whole.column(0).to_numpy(), whole.column(1).to_numpy()
            last = np.flatnonzero((h[1:] != h[:-1]) | (a[1:] != a[:-1]))
            first = int(last[0]) + 1 if len(last) else whole.num_rows
            yield whole.slice(0, first), True
            whole = whole.slice(first)
        if whole.num_rows:
            yield whole, False


def _equal(keys: list, k1, k2, place, size, known):
    """Index of the first of each run of equal keys, whether it is known to repeat now, and the stretches that this tells."""
    new = np.array([True, *(x != y for x, y in zip(keys[1:], keys))], bool)
    first, run = np.flatnonzero(new), np.cumsum(new) - 1
    flag = (np.bincount(run) > 1) | (np.bincount(run, known) > 0)
    told = flag[run] & ~known
    return first, flag, _known(k1[told], k2[told], place[told], place[told] + size[told]) if told.any() else None


def _map_shards(batches):
    """Kind 0: stretches that repeat within a shard. Kind 2: the distinct strings of a shard that was cut (h, a: 128-bit hash; b: known to repeat)."""
    for t, cut_ in _shard_parts(batches):
        h, shard, k1, k2, place, b = (t.column(i).to_numpy() for i in (0, 1, 3, 4, 5, 6))
        texts, off, known = t.column(2).to_pylist(), b >> 1, (b & 1) > 0
        size = np.array([len(x) for x in texts], np.int64)
        first, flag, told = _equal(list(zip(h.tolist(), shard.tolist(), texts)), k1, k2, place, size, known)
        if told is not None:
            yield told
        cores, blocks = {}, []
        for i, f in zip(first.tolist(), flag.tolist()):
            for j, at, core, block in _blocks(texts[i], int(off[i])):
                key = (h[i], shard[i], j, core)
                cores[key] = cores.get(key, 0) + 1
                blocks.append((key, block, i, at, f))
        blocks = sorted((x for x in blocks if cut_ or cores[x[0]] > 1), key=lambda x: x[:2])
        if not blocks:
            continue
        keys, raws, of, at, flag = zip(*blocks)
        of, at, flag, size = np.array(of), np.array(at), np.array(flag), np.array([len(x) for x in raws])
        first, flag, told = _equal([(k, r) for k, r in zip(keys, raws)], k1[of], k2[of], place[of] + at, size, flag)
        if told is not None:
            yield told
        cores = {}
        for i in first.tolist():
            cores[keys[i]] = cores.get(keys[i], 0) + 1
        some = np.array([cut_ or cores[keys[i]] > 1 for i in first.tolist()])
        if not some.any():
            continue
        first, flag = first[some], flag[some]
        data, stop = np.frombuffer(b"".join(raws[i] for i in first), np.uint8), np.cumsum(size[first])
        start, of, at = stop - size[first], of[first], at[first]
        order = suffix_array(data, start, stop)
        if not len(order):
            continue
        shared = common_prefixes(data, start, stop, order)
        part = np.searchsorted(stop, order, "right")
        one, two, where = k1[of][part], k2[of][part], place[of][part] + at[part] + order - start[part]
        run = np.cumsum(np.concatenate(([True], shared[1:] < SPAN))) - 1
        by, new = _groups(run, one, two, where)  # one place may stand in several contexts
        places = np.bincount(run[by][new], minlength=run[-1] + 1)
        repeats = (places > 1) | (np.bincount(run, flag[part]) > 0)
        hit = repeats[run] & ~flag[part]
        if hit.any():
            yield _known(one[hit], two[hit], where[hit], where[hit] + SPAN)
        if cut_:
            several = np.flatnonzero(np.concatenate(([True], run[1:] != run[:-1])))
            hashes = np.array([divmod(xxhash.xxh3_128_intdigest(data[o : o + SPAN].tobytes()), 1 << 64) for o in order[several].tolist()], np.uint64)
            yield _row(2, h=hashes[:, 0], a=hashes[:, 1], k1=one[several], k2=two[several], place=where[several], b=repeats[run[several]].astype(np.int64))


def _map_merge(batches):
    """Strings of different shards that are equal: binary search of each hash's range in the sorted run."""
    for t in _by_key(batches, 2, CHUNK_ROWS):
        h, a, k1, k2, place, done = (t.column(i).to_numpy() for i in range(6))
        by, new = _groups(h, a, k1, k2, place)  # one place may stand in several blocks
        by = by[new]
        wide = np.array(list(zip(h[by].tolist(), a[by].tolist())), dtype=[("h", "<i8"), ("a", "<i8")])
        lo, hi = np.searchsorted(wide, wide, "left"), np.searchsorted(wide, wide, "right")
        hit = by[(hi - lo > 1)]
        hit = hit[done[hit] == 0]
        if len(hit):
            yield _known(k1[hit], k2[hit], place[hit], place[hit] + SPAN)


def _with_key(docs: DataFrame, text: Column) -> DataFrame:
    sha = F.sha2(text.cast("binary"), 256)
    signed = lambda i: F.conv(F.substring(sha, i, 16), 16, -10).cast("long")
    return docs.withColumn("sha", sha).withColumn("k1", signed(1)).withColumn("k2", signed(17))


def _texts_of(docs: DataFrame, text_col: str, keys: DataFrame) -> DataFrame:
    """(k1, k2, text), each text of the keys once."""
    texts = docs.select(F.col(text_col).cast("string").alias("text")).where(F.octet_length("text") >= SPAN)
    asked = matched(_with_key(texts, F.col("text")).select("k1", "k2", "text"), stash(keys.select("k1", "k2"), "keys"), ["k1", "k2"], "left_semi")
    return asked.groupBy("k1", "k2").agg(F.first("text").alias("text"))


def _blocks(raw: bytes, off: int):
    """(class, first byte, core, block) of each class of a context's strings; off: where the anchor begins."""
    for j in range(CLASSES):
        at = off - STEP * j  # the class's last start
        if at < 0 or at + CORE > len(raw):
            continue
        first = max(0, at - STEP + 1)
        block = raw[first : at + SPAN]
        if len(block) >= SPAN:
            yield j, first, raw[at : at + CORE], block


def _map_extract(batches):
    """Bytes of the contexts asked for, and what anchors begin at (b: 2 * place in the bytes, plus 1 if known to repeat).

    Of an anchor with very many contexts each class's block goes alone, to the
    shard (a) that the class and its core choose; of others a is 0.
    """
    names, kinds = ["h", "a", "bytes", "k1", "k2", "place", "b"], [pa.int64(), pa.int64(), pa.binary(), *[pa.int64()] * 4]
    out = lambda rows: pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=names)
    rows = []
    for b in batches:
        for i in range(b.num_rows):
            k1, k2, text = b.column(0)[i].as_py(), b.column(1)[i].as_py(), b.column(2)[i].as_py().encode()
            for x in b.column(3)[i].as_py():
                raw, first = _context(text, x["place"]), max(0, x["place"] - BEFORE)
                off = x["place"] - first
                if x["hot"]:
                    for j, at, core, block in _blocks(raw, off):
                        rows.append((x["h"], 1 + (xxhash.xxh64_intdigest(core, j) >> 2), block, k1, k2, first + at, x["b"] + 2 * (off - at)))
                else:
                    rows.append((x["h"], 0, raw, k1, k2, first, x["b"] + 2 * off))
            if len(rows) >= 1 << 14:
                yield out(rows)
                rows = []
    if rows:
        yield out(rows)


def cut(text: bytes, spans: list[tuple[int, int]]) -> tuple[bytes, int, int]:
    """What is left without the spans, bytes removed, and maximal removed runs. Spans may go beyond the text's end."""
    left, at, removed, runs = [], 0, 0, 0
    end = -1
    for s, e in sorted(spans):
        e = min(e, len(text))
        if s > end:
            runs += 1
            left.append(text[at:s])
            removed += e - s
        else:
            removed += max(0, e - end)
        end = max(end, e)
        at = end
    left.append(text[at:])
    return b"".join(left), removed, runs


def _map_cut(batches):
    for b in batches:
        out = []
        for k1, k2, text, spans in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).cast(pa.large_binary()).to_pylist(), b.column(3).to_pylist()):
            kept, removed, runs = cut(text, [(s["place"], s["a"]) for s in spans])
            out.append((k1, k2, removed, runs, hashlib.sha256(kept).hexdigest(), kept))
        cols = list(zip(*out)) or [()] * 6
        yield pa.RecordBatch.from_arrays([*[pa.array(c, pa.int64()) for c in cols[:4]], pa.array(cols[4], pa.string()), pa.array(cols[5], pa.binary())], names=["k1", "k2", "n_removed", "n_spans", "kept_sha256", "kept"])


def repeated_stretches(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """(k1, k2, place, a): stretches [place, a) of the text with that key that also start elsewhere."""
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    first = stash(docs.select(F.col(text_col).cast("string").alias("text")).mapInArrow(_map_anchors, _ROW), "anchors")
    dealt = first.where("kind = 1").select("h", "k1", "k2", "place", "b").repartition("h").sortWithinPartitions("h", "k1", "k2", "place")
    judged = stash(dealt.mapInArrow(_map_judge, _ROW), "judged")
    release(docs.sparkSession)
    asks = judged.where("kind = 1")
    hot = asks.groupBy("h").agg(F.count("*").alias("n")).where(F.col("n") > SHARD_CONTEXTS).select("h", F.lit(True).alias("hot"))  # few: each has very many rows
    asks = asks.join(hot, "h", "left").groupBy("k1", "k2").agg(F.collect_list(F.struct("h", F.coalesce("hot", F.lit(False)).alias("hot"), "b", "place")).alias("asks"))
    asks = stash(asks, "asks")
    pulled = _texts_of(docs, text_col, asks).join(asks, ["k1", "k2"]).select("k1", "k2", "text", "asks").mapInArrow(_map_extract, "h bigint, a bigint, bytes binary, k1 bigint, k2 bigint, place bigint, b bigint")
    sorted_ = stash(pulled.repartition(parts, "h", "a").sortWithinPartitions("h", "a", "bytes").mapInArrow(_map_shards, _ROW), "shards")
    drop_stash(asks)
    runs = sorted_.where("kind = 2").select("h", "a", "k1", "k2", "place", "b").repartition("h", "a").sortWithinPartitions("h", "a")
    merged = runs.mapInArrow(_map_merge, _ROW)
    found = first.where("kind = 0").union(judged.where("kind = 0")).union(sorted_.where("kind = 0")).union(merged)
    return found.select("k1", "k2", "place", "a")


def dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_bytes, n_removed, n_spans, kept_sha256, kept) for each row of docs; kept is null where nothing went.

    Null texts count as empty. Repeated rows are copies of one another, so all of
    a text of SPAN bytes or more goes. Texts are read whole, in pieces of PIECE
    bytes. Which of several equal strings comes first (ties) makes no difference:
    all go. Null ids are allowed. Other columns are left out. An empty table gives
    an empty result.
    """
    found = repeated_stretches(docs, text_col).groupBy("k1", "k2").agg(F.collect_set(F.struct("place", "a")).alias("spans"))
    found = stash(found, "spans")
    cuts = _texts_of(docs, text_col, found).join(found, ["k1", "k2"]).select("k1", "k2", "text", "spans")
    cuts = stash(cuts.mapInArrow(_map_cut, "k1 bigint, k2 bigint, n_removed bigint, n_spans bigint, kept_sha256 string, kept binary"), "cuts")
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = _with_key(docs.select(F.col(id_col).alias("id"), text.alias("t")), F.col("t")).select("id", F.octet_length("t").cast("long").alias("n_bytes"), "sha", "k1", "k2")
    zero = F.lit(0).cast("long")
    got = rows.join(cuts, ["k1", "k2"], "left")
    return got.select("id", "n_bytes", F.coalesce("n_removed", zero).alias("n_removed"), F.coalesce("n_spans", zero).alias("n_spans"), F.coalesce("kept_sha256", "sha").alias("kept_sha256"), "kept")
