"""Choosing, bucketing and totalling: what is kept, and what that saves."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Formats that compete, in the order that settles ties.
FORMATS = ("WebP", "AVIF", "JXL")


def allowed(policy: str, media_type: Column, fixed: str = "WebP") -> Column:
    """The formats that are tried for an image: one fixed, AVIF for photographs and WebP else, or all."""
    if policy == "best":
        return F.array(*map(F.lit, FORMATS))
    if policy == "auto":
        return F.array(F.when(media_type.isin("image/jpeg", "image/jpg"), "AVIF").otherwise("WebP"))
    return F.array(F.lit(fixed))


def smallest(candidates: DataFrame, key: str, size: str = "size", order: str = "ord") -> DataFrame:
    """One row of each key: the smallest, the first of equals. Null sizes (failed encodings) don't compete."""
    columns = [c for c in candidates.columns if c != key]
    best = F.min_by(F.struct(*columns), F.struct(size, order))
    return candidates.where(F.col(size).isNotNull()).groupBy(key).agg(best.alias("x")).select(key, "x.*")


def never_larger(original: Column, new: Column) -> Column:
    """Whether the original is kept: where the new one isn't smaller, or failed."""
    return ~F.coalesce(new < original, F.lit(False))


def first_of(df: DataFrame, key: str, order: str) -> DataFrame:
    """The first row of each key; later ones are dropped."""
    columns = [c for c in df.columns if c != key]
    return df.groupBy(key).agg(F.min_by(F.struct(*columns), F.col(order)).alias("x")).select(key, "x.*").select(*df.columns)


def shallowest(paths: DataFrame, key: str, path: str = "path", order: str = "ord") -> DataFrame:
    """The path with the fewest parts of each key, the first of equals."""
    return paths.groupBy(key).agg(F.min_by(path, F.struct(F.size(F.split(path, "/")), order)).alias(path))


def size_buckets(df: DataFrame, size: str, *sums: str, small: int = 200 * 1024, large: int = 1024 * 1024) -> DataFrame:
    """bucket (small, medium, large, ALL), n and the sums, by a size in bytes."""
    bucket = F.when(F.col(size) < small, "small").when(F.col(size) < large, "medium").otherwise("large")
    out = df.withColumn("bucket", bucket).rollup("bucket").agg(F.count(F.lit(1)).alias("n"), *(F.sum(s).alias(s) for s in sums))
    return out.withColumn("bucket", F.coalesce("bucket", F.lit("ALL")))


def contest(df: DataFrame, config: str, a: str, b: str) -> DataFrame:
    """For each configuration: rows where b is smaller (wins) or larger (losses), both sums, and the sum of the smaller ones."""
    return df.groupBy(config).agg(
        F.count_if(F.col(b) < F.col(a)).alias("wins"),
        F.count_if(F.col(b) > F.col(a)).alias("losses"),
        F.sum(a).alias(f"sum_{a}"),
        F.sum(b).alias(f"sum_{b}"),
        F.sum(F.least(a, b)).alias("sum_safe"),
    )


def upper_median(values: Column) -> Column:
    """The element at n / 2 of the sorted values, counted from 0: of an even number the larger middle one. An aggregate."""
    kept = F.sort_array(F.collect_list(values))
    return F.get(kept, F.floor(F.size(kept) / 2).cast("int"))


def interpolated(curve: DataFrame, key: str, score: str, value: str, target: Column) -> DataFrame:
    """The value of each key's curve at a target score, on the first pair of neighbours by score that spans it; null outside.

    Where neighbours have equal scores (to 1e-9) the first one's value holds.
    """
    order = Window.partitionBy(key).orderBy(score, value)
    pairs = curve.withColumns({"_s": F.lead(score).over(order), "_v": F.lead(value).over(order), "_t": target})
    low, high = F.least(score, "_s"), F.greatest(score, "_s")
    spans = F.col("_s").isNotNull() & (F.col("_t") >= low) & (F.col("_t") <= high)
    share = F.when(F.abs(F.col("_s") - F.col(score)) < 1e-9, F.lit(0.0)).otherwise((F.col("_t") - F.col(score)) / (F.col("_s") - F.col(score)))
    at = F.when(spans, F.col(value) + share * (F.col("_v") - F.col(value)))
    return pairs.groupBy(key).agg(F.min_by(at, F.when(spans, F.struct(score, value))).alias(value))


def every(df: DataFrame, key: str, order: str, take: int) -> DataFrame:
    """About ``take`` rows of each key at even steps in an order."""
    by = Window.partitionBy(key)
    step = F.greatest(F.lit(1), F.floor(F.count(F.lit(1)).over(by) / take))
    row = F.row_number().over(by.orderBy(order)) - 1
    return df.withColumns({"_step": step, "_row": row}).where((F.col("_row") % F.col("_step") == 0) & (F.floor(F.col("_row") / F.col("_step")) < take)).drop("_step", "_row")


def offsets(entries: DataFrame, book: str = "book_id", order: str = "ord", size: str = "size", streamed: str = "streamed") -> DataFrame:
    """Adds start and stop: where each streamed entry lies in its book's stream; null for the others."""
    before = Window.partitionBy(book).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    start = F.coalesce(F.sum(F.when(F.col(streamed), F.col(size)).otherwise(0)).over(before), F.lit(0))
    return entries.withColumn("start", F.when(F.col(streamed), start)).withColumn("stop", F.when(F.col(streamed), start + F.col(size)))


def archive_stats(entries: DataFrame, book: str = "book_id", size: str = "size", streamed: str = "streamed") -> DataFrame:
    """(book, stream_entries, stored_entries, stream_bytes, total_bytes) of each archive."""
    return entries.groupBy(book).agg(
        F.count_if(F.col(streamed)).alias("stream_entries"),
        F.count_if(~F.col(streamed)).alias("stored_entries"),
        F.coalesce(F.sum(F.when(F.col(streamed), F.col(size))), F.lit(0)).alias("stream_bytes"),
        F.sum(size).alias("total_bytes"),
    )


def format_labels(images: DataFrame, book: str = "book_id", order: str = "ord", label: str = "format") -> DataFrame:
    """(book, converted, kept, label): the distinct formats in the order they first came, WebP for none."""
    seen = F.array_sort(F.collect_list(F.when(F.col(label).isNotNull(), F.struct(order, label))))
    return images.groupBy(book).agg(F.count_if(~F.col("kept")).alias("converted"), F.count_if(F.col("kept")).alias("kept"), seen.alias("s")).select(
        book, "converted", "kept", F.coalesce(F.nullif(F.array_join(F.array_distinct(F.transform("s", lambda x: x[label])), "/"), F.lit("")), F.lit("WebP")).alias("label")
    )


def weighted_upper_median(counts: DataFrame, key: str, value: str, n: str) -> DataFrame:
    """(key, value): the upper median of values with counts; only distinct values are ordered."""
    by = Window.partitionBy(key)
    reach = F.sum(n).over(by.orderBy(value))
    half = F.floor(F.sum(n).over(by) / 2) + 1
    return counts.withColumns({"_reach": reach, "_half": half}).where("_reach >= _half").groupBy(key).agg(F.min(value).alias(value))


def success_means(df: DataFrame, level: str, score: str, size: str) -> DataFrame:
    """For each level: rows, rows with a score, their mean (NaN where there are none) and their KB. Null and NaN scores are failures."""
    ok = F.col(score).isNotNull() & ~F.isnan(score)
    return df.groupBy(level).agg(
        F.count(F.lit(1)).alias("n"),
        F.count_if(ok).alias("measured"),
        F.coalesce(F.avg(F.when(ok, F.col(score))), F.lit(float("nan"))).alias("mean"),
        (F.coalesce(F.sum(F.when(ok, F.col(size))), F.lit(0)) / 1024.0).alias("kilobytes"),
    )


def codec_totals(df: DataFrame) -> DataFrame:
    """For each codec of rows (codec, original, packed, same): files, bytes before and after, their ratio, and whether every file came back the same."""
    out = df.groupBy("codec").agg(F.count(F.lit(1)).alias("files"), F.sum("original").cast("long").alias("original"), F.sum("packed").cast("long").alias("packed"), F.every("same").alias("lossless"))
    return out.withColumn("ratio", F.try_divide(F.col("packed").cast("double"), F.col("original").cast("double")))


def named(df: DataFrame, key: str, order: str, prefix: str) -> DataFrame:
    """``df`` with name: the prefix and a number of three digits or more, from 1 on in each key's order."""
    at = F.row_number().over(Window.partitionBy(key).orderBy(order))
    return df.withColumn("name", F.format_string(f"{prefix}%03d", at))
