"""Document fingerprints from closed syncmers.

A k-mer is an anchor where its smallest inner s-mer stands at its first or last place: a choice that
depends on the k-mer alone, so equal passages have equal anchors wherever they stand. A fingerprint
keeps the anchors with the smallest hashes, in the order of their places in the text; the likeness
of two is the share of the smallest hashes of both that each holds, as far as they come in one order.
"""

from __future__ import annotations

import base64
import hashlib
from bisect import bisect_left
from math import isqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import let, partitions, prepare, table, whole_ids

K, S = 16, 5
#: Anchors in a fingerprint; the operator ``positions`` returns all of a text's.
ANCHORS = 64
_M1, _M2, _M3 = (np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB))
#: Ranges of ids for each partition, how exact their bounds are, and the ids a range, chosen by hash, that bounds are taken from.
SHARES, ACCURACY, CHOSEN = 4, 20_000, 64


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * _M2
    x = (x ^ (x >> np.uint64(27))) * _M3
    return x ^ (x >> np.uint64(31))


def _whole(text: str) -> tuple[np.ndarray, np.ndarray]:
    return np.zeros(1, np.int64), np.array([int.from_bytes(hashlib.blake2b(text.encode("utf-8", "replace"), digest_size=4).digest(), "little")], np.uint32)


def anchors(text: str) -> tuple[np.ndarray, np.ndarray]:
    """(place, 32-bit hash) of each closed syncmer. A text that has none, being short, has one anchor, itself; an empty one has none."""
    c = np.frombuffer(text.encode("utf-32-le", "replace"), np.uint32).astype(np.uint64)
    if not len(c):
        return np.zeros(0, np.int64), np.zeros(0, np.uint32)
    if len(c) < K:
        return _whole(text)
    h = c[: len(c) - S + 1].copy()
    for i in range(1, S):
        h *= _M1
        h += c[i : len(c) - S + 1 + i]
    h = _mix(h)
    w = K - S + 1
    low, span = h, 1
    while 2 * span <= w:
        low = np.minimum(low[:-span], low[span:])
        span *= 2
    low = np.minimum(low[: len(h) - w + 1], low[w - span : w - span + len(h) - w + 1])
    at = np.flatnonzero((low == h[: len(low)]) | (low == h[w - 1 :]))
    if not len(at):
        return _whole(text)
    rest = np.zeros(len(at), np.uint64)
    for i in range(0, K - S, S):
        rest = _mix(rest + h[at + i])
    return at, (_mix(rest + h[at + K - S]) >> np.uint64(32)).astype(np.uint32)


def distinct(text: str | None) -> np.ndarray:
    """The different hashes of all anchors, in the order of their first places."""
    h, first = np.unique(anchors(text or "")[1], return_index=True)
    return h[np.argsort(first)]


def sketch(h: np.ndarray) -> str:
    """base64 of the smallest ``ANCHORS`` of different hashes, in their order."""
    if len(h) > ANCHORS:
        h = h[h <= np.partition(h, ANCHORS - 1)[ANCHORS - 1]]
    return base64.b64encode(h.astype("<u4").tobytes()).decode()


def fingerprint(text: str | None) -> str:
    """base64 of the anchors' hashes in text order, 4 bytes each; '' for a null or empty text."""
    return sketch(distinct(text))


def likeness(a: str, b: str) -> float:
    """0 to 1; equal fingerprints have 1.0. That of an empty text is like no other."""
    if a == b:
        return 1.0
    x, y = (np.frombuffer(base64.b64decode(v), "<u4") for v in (a, b))
    if not len(x) or not len(y):
        return 0.0
    union = np.union1d(x, y)[:ANCHORS]
    both = set(np.intersect1d(np.intersect1d(x, y), union).tolist())
    place = {v: i for i, v in enumerate(y.tolist())}
    ends: list[int] = []  # longest run that rises in both texts
    for v in x.tolist():
        if v in both:
            k = bisect_left(ends, place[v])
            ends[k : k + 1] = [place[v]]
    return len(ends) / len(union)


def overlap(x: np.ndarray, y: np.ndarray) -> float:
    """What ``likeness`` estimates: the share of all anchors of both texts that each holds, as far as they come in one order."""
    if np.array_equal(x, y):
        return 1.0
    if not len(x) or not len(y):
        return 0.0
    by = np.argsort(y)
    at = by[np.minimum(np.searchsorted(y, x, sorter=by), len(y) - 1)]
    places = at[y[at] == x].tolist()
    ends: list[int] = []
    for p in places:
        k = len(ends) if not ends or p > ends[-1] else bisect_left(ends, p)
        ends[k : k + 1] = [p]
    return len(ends) / (len(x) + len(y) - len(places))


def edited(text: str, following: str) -> str:
    """The last third of the text replaced by as many characters of the beginning of the next one."""
    cut = len(text) // 3
    return text[: len(text) - cut] + following[:cut]


def _rank(value: Column, bounds: list[int]) -> Column:
    """How many of the rising bounds are at most ``value``: looked for among every s-th, then among the s from there on."""
    if not bounds:
        return F.lit(0)
    s = isqrt(len(bounds)) + 1
    listed = lambda of: F.split(F.lit(",".join(map(str, of))), ",").cast("array<long>")
    upto = lambda found: F.size(F.filter(found, lambda b: b <= value))
    inside = lambda g: F.when(g == 0, 0).otherwise((g - 1) * s + upto(F.slice(listed(bounds), F.greatest((g - 1) * s, F.lit(0)) + 1, F.lit(s))))
    return let(upto(listed(bounds[::s])), inside)


def _dealt(df: DataFrame, doc_id: str) -> DataFrame:
    """Adds _part: ranges of ids of about equal row counts, rising as the ids fall; null ids come last.

    The bounds are quantiles of ids that a hash chooses, so that the one task that finds them gets
    some ``CHOSEN`` ids a range at every size; rows are dealt by them, and none is left out.
    """
    pieces = SHARES * partitions(df)
    shares = [k / pieces for k in range(1, pieces)]
    step = max(1, df.count() // (CHOSEN * pieces))
    chosen = df.where(F.pmod(F.xxhash64(doc_id), F.lit(step)) == 0)
    bounds = chosen.agg(F.percentile_approx(doc_id, shares, max(ACCURACY, 10 * pieces)).alias("q")).first()["q"]
    bounds = sorted({int(b) for b in bounds or ()})
    part = F.lit(len(bounds)) - _rank(F.col(doc_id).cast("long"), bounds)
    return df.withColumn("_part", F.when(F.col(doc_id).isNull(), F.lit(len(bounds) + 1)).otherwise(part).cast("int"))


def _first_of_parts(dealt: DataFrame, doc_id: str, text: str) -> DataFrame:
    """The first row of each range, to stand after the last row of the range before it."""
    heads = [(r["_part"], r["first"]) for r in dealt.groupBy("_part").agg(F.max(doc_id).alias("first")).collect()]
    heads.sort()
    before = [(p, i, heads[k - 1][0]) for k, (p, i) in enumerate(heads)]
    to = dealt.sparkSession.createDataFrame(before, "_own int, _first long, _before int")  # a row a range
    some = dealt.join(F.broadcast(to), (F.col("_part") == F.col("_own")) & F.col(doc_id).cast("long").eqNullSafe(F.col("_first")))
    least = some.groupBy("_before").agg(F.min(F.struct(F.col(text).isNotNull().alias("x"), F.col(text).alias("t"))).alias("m"))
    return least.select(F.col("_before").alias("_part"), F.col("m.t").alias(text))


def in_order(df: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, text, _part, _head): documents by falling id in each _part, then the next part's first.

    The texts are shuffled once. Rows with equal ids stand in the order of their texts, nulls first.
    """
    dealt = _dealt(df.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")), "doc_id")
    heads = _first_of_parts(dealt, "doc_id", "text").select(F.lit(None).cast(dealt.schema["doc_id"].dataType).alias("doc_id"), "text", "_part", F.lit(1).alias("_head"))
    both = dealt.withColumn("_head", F.lit(0)).unionByName(heads)
    order = ["_part", "_head", F.col("doc_id").desc_nulls_last(), F.col("text").asc_nulls_first()]
    return both.repartition(partitions(df), "_part").sortWithinPartitions(*order)


def positions(df: DataFrame, text: str = "text") -> DataFrame:
    """``df`` with places and hashes: all anchors of each whole text, in its order.

    Equal passages of K characters or more have equal anchors at equal distances, so two texts can
    be matched by place. Null and empty texts have none; repeated rows have equal ones; columns of
    these names are replaced.
    """
    prepare(df.sparkSession)
    df = df.drop("places", "hashes")

    def run(batches):
        for batch in batches:
            found = [anchors(t.as_py() or "") for t in batch.column(batch.schema.get_field_index(text))]
            more = [pa.array([x[0] for x in found], pa.list_(pa.int32())), pa.array([x[1].astype(np.int64) for x in found], pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays([*batch.columns, *more], [*batch.schema.names, "places", "hashes"])

    ddl = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema), "places array<int>, hashes array<long>"])
    return df.mapInArrow(run, ddl)


def fingerprints(df: DataFrame, doc_id: str = "doc_id", text: str = "text", exact: bool = False) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next.

    A fingerprint holds ``ANCHORS`` anchors at most. With ``exact`` there follow, of all anchors
    of the whole texts: n_anchors (the different ones), overlap_edited, overlap_next.

    The edited text has its last third replaced from the next document by falling id; after the last
    comes the first, so a lone document follows itself. Null texts are empty, with '' as fingerprint.
    Rows with equal ids follow one another by text. Ids must be whole numbers (TypeError); other
    columns of the input are not looked at.
    """
    prepare(df.sparkSession)
    whole_ids(df, doc_id)
    ordered = in_order(df, doc_id, text)
    id_type = ordered.schema["doc_id"].dataType.simpleString()

    def run(batches):
        held = None
        for batch in batches:
            out = []
            for i, t, part, head in zip(*(batch.column(k).to_pylist() for k in range(4)), strict=True):
                t = t or ""
                whole = distinct(t)
                own = sketch(whole)
                if held and held[3] == part:
                    j, before, print_, _, every = held
                    changed = edited(before, t)
                    changed_whole = distinct(changed)
                    again = sketch(changed_whole)
                    digest = hashlib.sha256(changed.encode("utf-8", "replace")).hexdigest()
                    more = (len(every), overlap(every, changed_whole), overlap(every, whole)) if exact else ()
                    out.append((j, len(before), digest, print_, again, likeness(print_, again), likeness(print_, own), *more))
                held = None if head else (i, t, own, part, whole)
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), told, strict=True)], schema=told)

    kinds = {"bigint": pa.int64(), "int": pa.int32(), "string": pa.string()}
    more = [("n_anchors", pa.int64()), ("overlap_edited", pa.float64()), ("overlap_next", pa.float64())] if exact else []
    told = pa.schema([("doc_id", kinds.get(id_type, pa.int64())), ("n_chars", pa.int64()), ("edited_sha256", pa.string()), ("fingerprint", pa.string()), ("edited_fingerprint", pa.string()), ("near_edited", pa.float64()), ("near_next", pa.float64()), *more])
    ddl = f"doc_id {id_type}, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
    return ordered.select("doc_id", "text", "_part", "_head").mapInArrow(run, ddl + (", n_anchors long, overlap_edited double, overlap_next double" if exact else ""))


def op9_syncmer_fingerprints(spark, sf_dir):
    return fingerprints(table(spark, sf_dir, "documents"), exact=True)


QUERIES = {"op9_syncmer_fingerprints": op9_syncmer_fingerprints}
ORACLES: dict[str, str] = {}
