"""Removal of long byte strings that occur elsewhere, by sorting suffixes.

Every string of ``least`` bytes has an anchor among its first GAP + 1 places, chosen by its bytes alone
(the smallest hash of 16 bytes). Occurrences of one string therefore share an anchor and the
bytes behind it up to ``least`` - GAP, and meet under the hash of those. Anchors whose whole surroundings
are equal stand for one another: in a batch after a comparison of their bytes, between batches by a
128-bit digest of them. Where surroundings differ, the suffixes behind the anchors, and the reversed
prefixes before them, are merge-sorted: two are compared by binary search for their common extension
over prefix polynomial hashes, so a comparison takes a logarithm of their length, and neighbours are
checked byte by byte against collisions. The sorted order tells for each place whether a whole string
that covers it occurs elsewhere. A group of too many surroundings is halved first: a common string
reaches at least half its way before the anchor, or the rest behind it, so it is found among those
that are equal there.
"""

from __future__ import annotations

import hashlib
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import partitions, prepare, table, tidy, whole_ids, written
from .removals import id_of, identity

#: Bytes of the strings that go; of shorter ones that are counted besides: some fifty words.
LENGTH, ALSO = 400, 250
GRAM = 16
#: Bytes of text that are scanned at once; longer texts are scanned in overlapping pieces.
PIECE = 1 << 20
#: Contexts of several groups that are sorted at once, and of one group, in some 200 MB; a larger one is halved.
AT_ONCE, MOST = 8192, 50_000
_BASES = (0x9E3779B97F4A7C15, 0xD1B54A32D192ED03)
_MIX = (np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB))


def _gap(length: int) -> int:
    return length // 2 - 1


@cache
def _tables(which: int) -> np.ndarray:
    return np.random.default_rng(0x51F1 + which).integers(1, 1 << 63, 256, np.int64).astype(np.uint64)


_powers: dict[tuple[int, int], np.ndarray] = {}


def powers(base: int, n: int) -> np.ndarray:
    """base ** 0 .. base ** n modulo 2 ** 64, kept between calls."""
    for size in (1 << 17, 1 << 18, 1 << 19, 1 << 20, 1 << 21, 1 << 22, 1 << 23):
        if n < size:
            break
    else:
        size = n + 1
    if (base, size) not in _powers:
        out = np.full(size, base, np.uint64)
        out[0] = 1
        _powers[base, size] = np.cumprod(out, dtype=np.uint64)
    return _powers[base, size][: n + 1]


def _scramble(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * _MIX[0]
    x = (x ^ (x >> np.uint64(29))) * _MIX[1]
    return x ^ (x >> np.uint64(32))


class Hashes:
    """Polynomial prefix hashes of a buffer, twice: any substring's hash from two of them."""

    def __init__(self, data: np.ndarray, which: int):
        base = _BASES[which]
        n = len(data)
        self.sums = np.zeros(n + 1, np.uint64)
        np.cumsum(_tables(which)[data] * powers(base, n)[:n], out=self.sums[1:])
        self.back = powers(pow(base, -1, 1 << 64), n)

    def of(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return _scramble((self.sums[b] - self.sums[a]) * self.back[a] + (b - a).astype(np.uint64))


def _grams(data: np.ndarray) -> np.ndarray:
    h, span = _tables(0)[data], 1
    while span < GRAM:
        h = h[:-span] * np.uint64(_BASES[0] + 2 * span) + h[span:]
        h ^= h >> np.uint64(37)
        span *= 2
    return _scramble(h)


def _anchors(data: np.ndarray, start: np.ndarray, stop: np.ndarray, least: int) -> np.ndarray:
    """Anchors of the strings that begin in [start, stop) of the buffer's pieces, once each."""
    window = _gap(least) + 1
    h = _grams(data)
    if len(h) < window:
        return np.zeros(0, np.int64)
    low = (h & np.uint64(0xFFFFFFFF00000000)) | np.arange(len(h), dtype=np.uint64)
    span = 1
    full = len(low) - window + 1
    while 2 * span <= window:
        low = np.minimum(low[:-span], low[span:])
        span *= 2
    low = np.minimum(low[:full], low[window - span : window - span + full])
    valid = np.zeros(len(data) + 1, np.int8)
    ok = stop > start
    np.add.at(valid, start[ok], 1)
    np.add.at(valid, stop[ok], -1)
    at = np.flatnonzero(np.cumsum(valid[:full]) > 0)
    a = (low[at] & np.uint64(0xFFFFFFFF)).astype(np.int64)
    return a[np.concatenate([[True], a[1:] != a[:-1]])] if len(a) else a


def keyed(df: DataFrame, doc_id: str, text: str) -> DataFrame:
    """(doc, k, data): id with null last, a hash that tells rows of one id apart, the text's bytes."""
    whole_ids(df, doc_id)
    whole = F.coalesce(F.col(text).cast("binary"), F.lit(b""))
    doc, k = identity(doc_id, whole)
    return df.select(doc.alias("doc"), k.alias("k"), whole.alias("data"))


def _pieces(batches, length, least):
    """Lists of (doc, k, first byte of the piece, bytes, size of the text, range whose anchors count)."""
    held, size = [], 0
    for batch in batches:
        for doc, k, data in zip(*(batch.column(i) for i in range(3)), strict=True):
            doc, k, data = doc.as_py(), k.as_py(), data.as_py()
            n = len(data)
            if n < least:
                continue
            for c in range(0, n, PIECE):
                to = min(n, c + PIECE)
                a, b = max(0, c - length), min(n, to + length + GRAM)
                held.append((doc, k, a, data[a:b], n, c, to))
                size += b - a
                if size >= PIECE:
                    yield held
                    held, size = [], 0
    if held:
        yield held


def _merged(doc: np.ndarray, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Overlapping or touching ranges of one document as one."""
    order = np.lexsort((a, doc))
    doc, a, b = doc[order], a[order], b[order]
    if not len(a):
        return doc, a, b
    reach = np.empty_like(b)
    shift = doc.astype(np.int64) * (int(b.max()) + 2)
    reach = np.maximum.accumulate(b + shift) - shift
    new = np.ones(len(a), bool)
    new[1:] = (doc[1:] != doc[:-1]) | (a[1:] > reach[:-1])
    last = np.append(np.flatnonzero(new)[1:] - 1, len(a) - 1)
    return doc[new], a[new], reach[last]


_MET = "h long, c long, x long, doc long, k long, a long, l int, r int, n int, b long, sure boolean, whole boolean"


def _equal_bytes(data: np.ndarray, i: np.ndarray, j: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Whether the ``size`` bytes from i and those from j are the same."""
    out = np.ones(len(i), bool)
    if not len(i):
        return out
    width = np.arange(int(size.max()))
    for at in range(0, len(i), 4096):
        own = slice(at, at + 4096)
        inside = width < size[own, None]
        x = data[np.where(inside, i[own, None] + width, 0)]
        y = data[np.where(inside, j[own, None] + width, 0)]
        out[own] = (x == y).all(axis=1)
    return out


def _digests(raw: memoryview, a: np.ndarray, l: np.ndarray, r: np.ndarray) -> tuple[np.ndarray, np.ndarray]:  # noqa: E741
    """128 bits for the bytes around each place, and for how many of them stand before it."""
    of = hashlib.blake2b
    both = b"".join(of(raw[p - x : p + y], digest_size=16, salt=x.to_bytes(4, "little") + y.to_bytes(4, "little")).digest() for p, x, y in zip(a.tolist(), l.tolist(), r.tolist(), strict=True))
    return tuple(np.frombuffer(both, np.int64).reshape(-1, 2).T)


def _met(batches, length, least):
    """An anchor for each row: the hash h of the bytes behind it, the digest (c, x) of all its surroundings, and their sizes l and r.

    Surroundings that occur twice in a batch are settled here: their ranges come as sure rows
    (whole: of ``length`` bytes at least), and one of them goes on to meet other batches.
    """
    gap = _gap(least)
    for held in _pieces(batches, length, least):
        raw = b"".join(p[3] for p in held)
        data = np.frombuffer(raw, np.uint8)
        sizes = np.array([len(p[3]) for p in held])
        at = np.cumsum(sizes) - sizes
        first, total, c, to = (np.array([p[i] for p in held], np.int64) for i in (2, 4, 5, 6))
        begin = at + np.maximum(0, c - gap) - first
        end = at + np.minimum(to, total - least + 1) - first
        a = _anchors(data, begin, end, least)
        of = np.searchsorted(at, a, "right") - 1
        place = a - at[of] + first[of]
        ours = (place >= c[of]) & (place < to[of])
        a, of, place = a[ours], of[ours], place[ours]
        if not len(a):
            continue
        l = np.minimum(gap, place)  # noqa: E741
        r = np.minimum(length, total[of] - place)
        one, two = Hashes(data, 0), Hashes(data, 1)
        h = one.of(a, a + least - gap)
        ctx = two.of(a - l, a + r) ^ _scramble((l * 4096 + r).astype(np.uint64))
        doc, k = np.array([p[0] for p in held])[of], np.array([p[1] for p in held])[of]
        order = np.lexsort((ctx, h))
        h, ctx, doc, k, place, l, r, of, a = (x[order] for x in (h, ctx, doc, k, place, l, r, of, a))  # noqa: E741
        same = np.flatnonzero((h[1:] == h[:-1]) & (ctx[1:] == ctx[:-1]) & (l[1:] == l[:-1]) & (r[1:] == r[:-1]))
        same = same[_equal_bytes(data, (a - l)[same], (a - l)[same + 1], (l + r)[same])]
        new = np.ones(len(h), bool)
        new[same + 1] = False
        group = np.cumsum(new) - 1
        n = np.bincount(group)
        twice = n[group] > 1
        _, ids = np.unique(np.stack([doc, k]), axis=1, return_inverse=True)
        ids = ids.reshape(-1)
        where = np.zeros(int(ids.max()) + 1, np.int64)
        where[ids] = np.arange(len(ids))
        settled = []
        for whole in (True, False):
            own = twice & ((l + r >= length) == whole)
            settled.append((*_merged(ids[own], (place - l)[own], (place + r)[own]), whole))
        md, ma, mb = (np.concatenate([x[i] for x in settled]) for i in range(3))
        mw = np.concatenate([np.full(len(x[0]), x[3]) for x in settled])
        z, m = len(md), int(new.sum())
        digest = _digests(memoryview(raw), a[new], l[new], r[new])
        none, zero = np.zeros(z, np.int64), np.zeros(m, np.int64)
        columns = [
            np.concatenate([h[new].view(np.int64), md * 7919 + ma]),
            np.concatenate([digest[0], none]),
            np.concatenate([digest[1], none]),
            np.concatenate([doc[new], doc[where[md]]]),
            np.concatenate([k[new], k[where[md]]]),
            np.concatenate([place[new], ma]),
            np.concatenate([l[new], none]).astype(np.int32),
            np.concatenate([r[new], none]).astype(np.int32),
            np.concatenate([np.minimum(n, 2), none]).astype(np.int32),
            np.concatenate([zero, mb]),
            np.concatenate([zero.astype(bool), np.ones(z, bool)]),
            np.concatenate([zero.astype(bool), mw]),
        ]
        yield pa.RecordBatch.from_arrays([pa.array(x) for x in columns], ["h", "c", "x", "doc", "k", "a", "l", "r", "n", "b", "sure", "whole"])


_SETTLED = "h long, doc long, k long, a long, b long, whole boolean, want boolean"
_SETTLED_KINDS = (pa.int64(),) * 5 + (pa.bool_(),) * 2


def _settle(batches, length, most):
    """Of rows by (sure, h, c, x): ranges [a, b) of settled anchors (h null), and one anchor of each surroundings of a mixed group.

    A mixed group of more than ``most`` surroundings is named once more, without a document. Only the
    last row and the first surroundings of the group at hand are held.
    """
    group = run = first = rep = None
    twice, kinds = False, 0

    def range_of(doc, k, a, l, r):  # noqa: E741
        return (None, doc, k, a - l, a + r, l + r >= length, False)

    def closed(out):
        """One anchor of the surroundings at hand, if the group has others."""
        h, doc, k, a, _, _ = rep
        out.append((h, doc, k, a, a, False, not twice))

    def ended(out):
        if group is not None and kinds > 1:
            closed(out)
            if kinds > most:
                out.append((group, None, None, None, None, False, False))

    for batch in batches:
        out: list[tuple] = []
        h, sure = batch.column(0).to_numpy(), batch.column(10).to_numpy(zero_copy_only=False).astype(bool)
        # Hashes that stand alone inside a batch of rows meet nothing.
        near = np.ones(len(h), bool)
        near[1:-1] = (h[1:-1] == h[2:]) | (h[1:-1] == h[:-2])
        rows = batch.filter(pa.array(near | sure))
        for h, c, x, doc, k, a, l, r, n, b, sure, whole in zip(*(v.to_numpy(zero_copy_only=False).tolist() for v in rows.columns), strict=True):  # noqa: E741
            if sure:
                out.append((None, doc, k, a, b, whole, False))
                continue
            if h != group:
                ended(out)
                group, run, kinds = h, (c, x), 1
                rep, twice, first = (h, doc, k, a, l, r), n > 1, n
            elif (c, x) != run:
                closed(out)
                run, kinds = (c, x), kinds + 1
                rep, twice, first = (h, doc, k, a, l, r), n > 1, n
            else:
                if first == 1:
                    out.append(range_of(*rep[1:]))
                    first = 2
                twice = True
                if n == 1:
                    out.append(range_of(doc, k, a, l, r))
        if out:
            yield _rows(out, ("h", "doc", "k", "a", "b", "whole", "want"), _SETTLED_KINDS)
    out = []
    ended(out)
    if out:
        yield _rows(out, ("h", "doc", "k", "a", "b", "whole", "want"), _SETTLED_KINDS)


def _rows(rows, names, kinds):
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], list(names))


# Sorting suffixes


def _extensions(symbols: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """How many first symbols rows i and j have in common, by comparison."""
    out = np.empty(len(i), np.int64)
    for at in range(0, len(i), 4096):
        differ = symbols[i[at : at + 4096]] != symbols[j[at : at + 4096]]
        out[at : at + 4096] = np.where(differ.any(axis=1), differ.argmax(axis=1), symbols.shape[1])
    return out


def suffix_order(group: np.ndarray, text: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Merge sort of rows by (group, bytes); also the common extension of each with the one before, -1 between groups.

    text: (rows, width) bytes, of which ``size`` count; group must rise. Comparisons look for the
    common extension by binary search over prefix hashes. Neighbours are then compared by bytes; if
    a hash has deceived, the rows are sorted without hashes.
    """
    n, width = text.shape
    symbols = np.where(np.arange(width) < size[:, None], text.astype(np.int16) + 1, 0)
    hashes = np.zeros((n, width + 1), np.uint32)  # the upper halves of 64 bits
    codes = np.random.default_rng(9).integers(1, 1 << 63, 257, np.int64).astype(np.uint64)
    for at in range(0, n, 2048):
        sums = np.cumsum(codes[symbols[at : at + 2048]] * powers(_BASES[1], width)[:width], axis=1, dtype=np.uint64)
        hashes[at : at + 2048, 1:] = sums >> np.uint64(32)

    def common(i, j):
        low, high = np.zeros(len(i), np.int64), np.full(len(i), width)
        while (open_ := low < high).any():
            mid = (low + high + 1) // 2
            same = hashes[i, mid] == hashes[j, mid]
            low, high = np.where(open_ & same, mid, low), np.where(open_ & ~same, mid - 1, high)
        return low

    def before(i, j, ties):
        """Whether row i stands before row j; ties: what equal rows give."""
        out = group[i] < group[j]
        at = np.flatnonzero(group[i] == group[j])
        x, y = i[at], j[at]
        k = common(x, y)
        last = np.minimum(k, width - 1)
        out[at] = np.where(k == width, ties[at], symbols[x, last] < symbols[y, last])
        return out

    order, run = np.arange(n), 1
    while run < n:
        place = np.arange(n)
        block = place // (2 * run)
        left = place % (2 * run) < run
        # Each element's place among the other run's, for all pairs of runs at once.
        a = np.where(left, block * 2 * run + run, block * 2 * run)
        low, high = np.minimum(a, n), np.minimum(a + run, n)
        start = low.copy()
        while (at := np.flatnonzero(low < high)).size:
            mid = (low[at] + high[at]) // 2
            smaller = before(order[mid], order[place[at]], ~left[at])
            low[at] = np.where(smaller, mid + 1, low[at])
            high[at] = np.where(smaller, high[at], mid)
        mine = place - np.where(left, block * 2 * run, block * 2 * run + run)
        new = np.empty_like(order)
        new[block * 2 * run + mine + (low - start)] = order
        order, run = new, 2 * run
    prev, here = order[:-1], order[1:]
    exact = _extensions(symbols, prev, here)
    same = group[prev] == group[here]
    k = np.minimum(exact, width - 1)
    if (same & (symbols[prev, k] > symbols[here, k])).any():
        order = np.array(sorted(range(n), key=lambda i: (group[i], symbols[i].tolist())), np.int64)
        prev, here = order[:-1], order[1:]
        exact = _extensions(symbols, prev, here)
        same = group[prev] == group[here]
    return order, np.concatenate([[-1], np.where(same, exact, -1)]) if n else np.zeros(0, np.int64)


def covered(group: np.ndarray, lefts: list[bytes], rights: list[bytes], gap: int, width: int, from_: np.ndarray, to: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each anchor the largest and the smallest d such that the string from d bytes before it occurs at another anchor of its group.

    lefts: up to ``gap`` bytes before the anchors; rights: up to ``width`` bytes behind the part that a
    group shares; d lies in [from_, to] of an anchor's group. -1 where there is no such d. First for strings that end ``width`` - d bytes
    behind the shared part, then, if that is shorter, for those that end ``gap`` - d behind it.
    """
    n = len(group)

    def matrix(parts, wide):
        out, size = np.zeros((n, wide), np.uint8), np.array([len(p) for p in parts])
        for i, p in enumerate(parts):
            out[i, : len(p)] = np.frombuffer(p, np.uint8)
        return out, size

    (left_order, left_lcp), left_size = _sorted(group, *matrix([p[::-1] for p in lefts], gap))
    (right_order, right_lcp), right_size = _sorted(group, *matrix(rights, width))
    told = []
    classes = [np.empty(n, np.int64), np.empty(n, np.int64)]
    for reach in dict.fromkeys((width, gap)):
        most, least = np.full(n, -1), np.full(n, -1)
        for d in range(gap + 1):
            able = np.flatnonzero((left_size >= d) & (right_size >= reach - d) & (from_ <= d) & (d <= to))
            if len(able) < 2:
                continue
            for out, order, lcp, need in ((classes[0], left_order, left_lcp, d), (classes[1], right_order, right_lcp, reach - d)):
                out[order] = np.cumsum(lcp < need)
            both = classes[0][able] * (n + 1) + classes[1][able]
            _, back, count = np.unique(both, return_inverse=True, return_counts=True)
            found = able[count[back] > 1]
            most[found] = d
            least[found] = np.where(least[found] < 0, d, least[found])
        told.append((most, least))
    return told


def _sorted(group, text, size):
    return suffix_order(group, text, size), size


_CONTEXT = "h long, x long, doc long, k long, a long, want boolean, lo int, hi int, left binary, right binary"
_FOUND = "doc long, k long, a long, b long, whole boolean"


def _leaves(batches, length, least):
    """Of contexts by (h, x): the ranges that their groups settle."""
    gap = _gap(least)
    width = length - least + gap
    held: list[tuple] = []

    def settle(rows):
        names: dict = {}
        group = np.array([names.setdefault(v[:2], len(names)) for v in rows])
        told = covered(group, [v[8] for v in rows], [v[9] for v in rows], gap, width, np.array([v[6] for v in rows]), np.array([v[7] for v in rows]))
        out = []
        for size, (most, fewest) in zip(dict.fromkeys((length, least)), told, strict=True):
            out += [(v[2], v[3], v[4] - m, v[4] - f + size, size == length) for v, m, f in zip(rows, most.tolist(), fewest.tolist(), strict=True) if v[5] and m >= 0]
        if out:
            yield _rows(out, ("doc", "k", "a", "b", "whole"), (pa.int64(),) * 4 + (pa.bool_(),))

    for batch in batches:
        for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if len(held) >= AT_ONCE and held[-1][:2] != row[:2]:
                yield from settle(held)
                held = []
            held.append(row)
    if held:
        yield from settle(held)


def _contexts(batches, length, least):
    gap = _gap(least)
    for batch in batches:
        for doc, k, data, needs in zip(*(batch.column(i) for i in range(4)), strict=True):
            doc, k, data = doc.as_py(), k.as_py(), data.as_py()
            out = []
            for need in needs.as_py():
                a = need["a"]
                behind = a + least - gap
                check = int.from_bytes(hashlib.blake2b(data[a:behind], digest_size=8).digest(), "little", signed=True)
                out.append((need["h"], check, doc, k, a, need["want"], 0, gap, data[max(0, a - gap) : a], data[behind : a + length]))
            yield _rows(out, ("h", "x", "doc", "k", "a", "want", "lo", "hi", "left", "right"), (pa.int64(),) * 5 + (pa.bool_(), pa.int32(), pa.int32(), pa.binary(), pa.binary()))


def _tail(n) -> Column:
    """The last ``n`` of the bytes before an anchor, or all."""
    return F.substring("left", F.greatest(F.lit(1), F.octet_length("left") - n + 1), n)


def _halved(contexts: DataFrame, length: int, least: int, size: int, most: int) -> list[DataFrame]:
    """The ranges that groups of more than ``most`` contexts settle by strings of ``size`` bytes.

    A string from d bytes before the anchor, lo <= d <= hi, needs d bytes before it and reach - d
    behind the shared part. Contexts that are equal in all that any d needs have all these strings
    in common: their ranges are told, and one of them stays to meet others. What is still a large
    group is halved: a string holds the mid + 1 bytes before the anchor (d > mid) or the reach - mid
    behind (d <= mid), so each half of the d's is looked for among contexts that are equal there.
    What is alone goes. A round reads and writes what is large only.
    """
    gap, n = _gap(least), partitions(contexts)
    reach = size - least + gap
    columns = [c.split()[0] for c in _CONTEXT.split(", ")]
    # Bytes that no d of a half needs are cut off.
    needed = {"left": _tail(F.col("hi")), "right": F.substring("right", F.lit(1), F.lit(reach) - F.col("lo"))}
    found, large = [], contexts.withColumns(needed)
    while True:
        needs = (F.octet_length("left") >= F.col("hi")) & (F.octet_length("right") >= F.lit(reach) - F.col("lo"))
        own = large.withColumn("s", F.when(needs, F.sha2(F.concat("left", "right"), 256)))
        again = own.where("s IS NOT NULL").groupBy("h", "x", "s").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("doc", "k", "a")).alias("one")).where("n > 1").drop("n")
        now = written(own.join(again, ["h", "x", "s"], "left"), "halves")
        equal = now.where("one IS NOT NULL")
        found.append(equal.where("want").select("doc", "k", (F.col("a") - F.col("hi")).alias("a"), (F.col("a") - F.col("lo") + size).alias("b"), F.lit(size == length).alias("whole")))
        rest = now.where("one IS NULL OR one = struct(doc, k, a)").withColumn("want", F.expr("want AND one IS NULL")).where("lo < hi").select(*columns)
        sizes = rest.groupBy("h", "x").agg(F.count(F.lit(1)).alias("n"), F.bool_or("want").alias("asks")).where("n > 1 AND asks").drop("asks").checkpoint()
        found.append(_joined(rest.join(sizes.where(F.col("n") <= most).drop("n"), ["h", "x"]).select(*columns), n, length, least))
        over = sizes.where(F.col("n") > most).drop("n")
        if over.isEmpty():
            return found
        many = rest.join(over, ["h", "x"]).withColumn("mid", F.expr("(lo + hi) div 2").cast("int"))
        before = F.when(F.octet_length("left") > F.col("mid"), _tail(F.col("mid") + 1))
        behind = F.when(F.octet_length("right") >= F.lit(reach) - F.col("mid"), F.substring("right", F.lit(1), F.lit(reach) - F.col("mid")))
        sides = F.array(F.struct(before.alias("s"), (F.col("mid") + 1).alias("lo"), F.col("hi").alias("hi"), F.lit(1).alias("side")), F.struct(behind.alias("s"), F.col("lo").alias("lo"), F.col("mid").alias("hi"), F.lit(2).alias("side")))
        each = many.select("h", "x", "doc", "k", "a", "want", "left", "right", F.explode(F.filter(sides, lambda v: v["s"].isNotNull())).alias("v"))
        large = each.select(F.xxhash64("h", "v.s", "v.side").alias("h"), F.xxhash64("x", F.sha1("v.s"), "v.side").alias("x"), "doc", "k", "a", "want", "v.lo", "v.hi", "left", "right")
        large = large.withColumns(needed)


def _joined(contexts: DataFrame, n: int, length: int, least: int) -> DataFrame:
    return contexts.repartition(n, "h").sortWithinPartitions("h", "x").mapInArrow(lambda x: tidy(_leaves(x, length, least)), _FOUND)


def _union(ranges: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[list[int]] = []
    for a, b in sorted(ranges):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return out


_KEPT = [("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("n_repeated", pa.int64()), ("kept", pa.binary())]


def _kept(batches):
    for batch in batches:
        out = []
        for data, ranges in zip(batch.column(1), batch.column(2), strict=True):
            data, ranges = data.as_py(), ranges.as_py() or ()
            spans = _union([(x["a"], x["b"]) for x in ranges if x["whole"]])
            every = _union([(x["a"], x["b"]) for x in ranges])
            at, parts = 0, []
            for a, b in spans:
                parts.append(data[at:a])
                at = b
            kept = b"".join([*parts, data[at:]])
            out.append((len(data), len(data) - len(kept), len(spans), sum(b - a for a, b in every), kept))
        columns = zip(*out, strict=True) if out else [()] * len(_KEPT)
        yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, t) for c, (_, t) in zip(columns, _KEPT, strict=True))], ["doc_id", *(n for n, _ in _KEPT)])


def dedup(df: DataFrame, doc_id: str = "doc_id", text: str = "text", length: int = LENGTH, also: int | None = ALSO, most: int = MOST) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, n_repeated, kept: every byte goes that a ``length``-byte string covers which starts anywhere else too.

    n_repeated counts, besides, the bytes that such strings of ``also`` bytes cover (those that went
    included); None counts those that went. Strings are compared as UTF-8 bytes within whole texts (null: empty) and judged on the input;
    overlapping occurrences count, first ones are not spared. ``kept`` is binary, since a range may
    end inside a character. A row that repeats another (id and text) repeats its strings, so both
    lose them. Ids must be whole numbers or null (TypeError); an empty table gives an empty result;
    other columns are not looked at.

    The texts are shuffled once (both joins reuse it), the anchors as one row for about ``also`` /
    4 bytes. No task sorts more than ``most`` contexts of one group.
    """
    prepare(df.sparkSession)
    least = min(also or length, length)
    if least < 2 * GRAM:
        raise ValueError(f"strings must have {2 * GRAM} bytes at least")
    n = partitions(df)
    met = keyed(df, doc_id, text).mapInArrow(lambda x: tidy(_met(x, length, least)), _MET)
    dealt = met.repartition(n, "h").sortWithinPartitions("sure", "h", "c", "x")
    settled = written(dealt.mapInArrow(lambda x: _settle(x, length, most), _SETTLED), "suffix")
    docs = keyed(df, doc_id, text).repartition(n, "doc", "k")
    needs = settled.where("h IS NOT NULL AND doc IS NOT NULL").groupBy("doc", "k").agg(F.collect_list(F.struct("a", "h", "want")).alias("needs"))
    contexts = docs.join(needs, ["doc", "k"]).select("doc", "k", "data", "needs").mapInArrow(lambda x: _contexts(x, length, least), _CONTEXT)
    contexts = written(contexts, "contexts")
    hot = settled.where("h IS NOT NULL AND doc IS NULL").select("h")
    if hot.isEmpty():
        found = [_joined(contexts, n, length, least)]
    else:
        found = [_joined(contexts.join(hot, "h", "left_anti"), n, length, least)]
        for size in dict.fromkeys((length, least)):
            found += _halved(contexts.join(hot, "h", "left_semi"), length, least, size, most)
    ranges = settled.where("h IS NULL").select("doc", "k", "a", "b", "whole")
    for more in found:
        ranges = ranges.unionByName(more)
    mine = ranges.groupBy("doc", "k").agg(F.collect_list(F.struct("a", "b", "whole")).alias("ranges"))
    kind = df.schema[doc_id].dataType.simpleString()
    joined = docs.join(mine, ["doc", "k"], "left").select(id_of("doc", "k", kind).alias("doc_id"), "data", "ranges")
    return joined.mapInArrow(_kept, f"doc_id {kind}, n_bytes long, n_removed long, n_spans long, n_repeated long, kept binary")


def op3_suffix_dedup(spark, sf_dir):
    got = dedup(table(spark, sf_dir, "documents"))
    return got.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"), "n_repeated")


QUERIES = {"op3_suffix_dedup": op3_suffix_dedup}
ORACLES: dict[str, str] = {}
