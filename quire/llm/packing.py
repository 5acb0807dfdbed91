"""Packing by length: buckets whose ends minimise padding, and token-budget batches inside each.

Lengths are those of the byte-level BPE encoding; a segment is the range [start, start + n_tokens) of
its document's ids.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from . import bpe
from .common import prepare, table

MAX_LEN = 2048
BUCKETS = 16
BUDGET = 65_536
#: Batches that are numbered together; a larger bucket is split by hash, at one partial batch a part.
TOGETHER = 32


def bucket_ends(histogram: dict[int, int], buckets: int) -> list[int]:
    """Ends of at most ``buckets`` buckets over lengths with counts that minimise the padding in all.

    Dynamic programming over the distinct lengths: exact. The last end is the largest length.
    """
    lengths = np.array(sorted(k for k, c in histogram.items() if c > 0), np.float64)
    if not len(lengths):
        return []
    counts = np.array([histogram[int(k)] for k in lengths], np.float64)
    c, t = (np.concatenate([[0.0], np.cumsum(x)]) for x in (counts, counts * lengths))
    n = len(lengths)
    best = np.full(n + 1, np.inf)
    best[0] = 0.0
    cuts = []
    for _ in range(min(buckets, n)):
        new, cut = best.copy(), np.arange(n + 1)
        for j in range(1, n + 1):
            cost = best[:j] + lengths[j - 1] * (c[j] - c[:j]) - (t[j] - t[:j])
            i = int(cost.argmin())
            if cost[i] < new[j]:
                new[j], cut[j] = cost[i], i
        cuts.append(cut)
        best = new
    ends, j = [], n
    for cut in reversed(cuts):
        if j and cut[j] != j:
            ends.append(int(lengths[j - 1]))
            j = int(cut[j])
    return ends[::-1]


def _choose(value: Column, table_: dict[int, int]) -> Column:
    return F.create_map(*(F.lit(x) for kv in table_.items() for x in kv))[value]


def pack(df: DataFrame, doc_id: str = "doc_id", text: str = "text", length: str | None = None, max_len: int = MAX_LEN, buckets: int = BUCKETS, budget: int = BUDGET) -> DataFrame:
    """doc_id, segment, start, n_tokens, bucket_len, batch_id, slot: one row for each segment.

    A document of more than ``max_len`` tokens is cut into segments of that length and a rest.
    Tokens are those of the whole text's byte-level BPE, unless ``length`` names a column of counts
    (null: 0; the text then only tells rows of one id apart). A batch holds ``budget`` // bucket_len segments (one at least) of one bucket;
    only the last of each part of a bucket has fewer. Documents without tokens get one row with 0
    tokens and null bucket, batch and slot. A repeated row is packed as often as it is there; its
    copies are numbered by a count, so a third of all rows being one are dealt out like others.
    Rows with a null id are packed too. Columns of the input that aren't named are not looked at; an
    empty table gives an empty result. What reaches the driver is the histogram, max_len rows at most.
    """
    prepare(df.sparkSession)
    k = F.xxhash64(F.coalesce(F.col(text), F.lit(""))).alias("k")
    if length:
        slim = df.select(F.col(doc_id).alias("doc_id"), k, F.coalesce(F.col(length), F.lit(0)).cast("long").alias("n"))
    else:
        slim = bpe.counts(df.select(F.col(doc_id).alias("doc_id"), k, F.col(text).alias("text")), "text", "n")
    slim = slim.groupBy("doc_id", "k", "n").agg(F.count(F.lit(1)).alias("copies")).checkpoint()
    copies = slim.select("doc_id", "k", "n", F.explode(F.sequence(F.lit(1).cast("long"), "copies")).alias("copy"))
    cut = copies.withColumn("segment", F.explode(F.sequence(F.lit(0).cast("long"), F.greatest(F.lit(0).cast("long"), F.expr(f"(n - 1) div {max_len}")))))
    cut = cut.select("doc_id", "k", "copy", "segment", (F.col("segment") * max_len).alias("start"), F.least(F.lit(max_len).cast("long"), F.col("n") - F.col("segment") * max_len).alias("n_tokens"))
    told = ["doc_id", "segment", "start", "n_tokens"]
    histogram = {r["n_tokens"]: r["count"] for r in cut.where("n_tokens > 0").groupBy("n_tokens").count().collect()}
    ends = bucket_ends(histogram, buckets)
    if not ends:
        return cut.select(*told, F.lit(None).cast("long").alias("bucket_len"), F.lit(None).cast("string").alias("batch_id"), F.lit(None).cast("long").alias("slot"))
    within, at = dict.fromkeys(ends, 0), 0
    for n in sorted(histogram):
        at += n > ends[at]
        within[ends[at]] += histogram[n]
    room = {e: max(1, budget // e) for e in ends}
    end_of = F.array_min(F.filter(F.lit(ends).cast("array<long>"), lambda e: e >= F.col("n_tokens")))
    cut = cut.withColumn("bucket_len", F.when(F.col("n_tokens") > 0, end_of))
    own = F.xxhash64("doc_id", "k", "copy", "segment")
    parts = _choose(F.col("bucket_len"), {e: -(-n // (TOGETHER * room[e])) for e, n in within.items()})
    cut = cut.withColumn("_part", F.pmod(own, F.coalesce(parts, F.lit(1024))))
    order = Window.partitionBy("bucket_len", "_part").orderBy("doc_id", "segment", "k", "copy")
    row = F.row_number().over(order).cast("long") - 1
    cut = cut.withColumns({"_row": row, "_holds": _choose(F.col("bucket_len"), room).cast("long")})
    batch = F.concat_ws("-", "bucket_len", "_part", F.expr("_row div _holds"))
    return cut.select(*told, "bucket_len", F.when(F.col("bucket_len").isNotNull(), batch).alias("batch_id"), F.expr("_row % _holds").alias("slot"))


def op2_packing(spark, sf_dir):
    return pack(table(spark, sf_dir, "documents"))


QUERIES = {"op2_packing": op2_packing}
ORACLES: dict[str, str] = {}
