"""Image policy: what is encoded, at which quality, what is kept. Encoders come from outside.

An encoder is a function (data, quality, format) -> bytes or None; the engine has none of its own.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.functions import numbers as N
from quire.functions import predicates as P
from quire.functions import text as T

from .selection import FORMATS, allowed, never_larger, smallest

Encoder = Callable[[bytes, int, str], bytes | None]
#: File extension and media type of each format.
EXTENSIONS = {"WebP": "webp", "AVIF": "avif", "JXL": "jxl"}
TYPES = {"WebP": "image/webp", "AVIF": "image/avif", "JXL": "image/jxl"}


def optimized(items: DataFrame, entries: DataFrame, encoder: Encoder | None, quality: int = 80, policy: str = "fixed", fixed: str = "WebP") -> DataFrame:
    """(book_id, ord, id, href, name, original_size, new_size, kept, format, new_href, new_type, is_cover, new_data) of raster items with an entry.

    items: (book_id, ord, id, href, media_type, cover_id); entries: (book_id, path, data) with paths
    relative to the package. A JPEG is never encoded at a higher quality than it was saved at. What
    isn't smaller than the original is kept; an image that no encoder takes has no row.
    """
    quality = max(1, min(100, quality))
    rows = items.where(P.is_raster("media_type")).withColumn("path", T.unquote("href")).join(entries.select("book_id", "path", "data"), ["book_id", "path"])
    source = F.when(F.col("media_type") != "image/png", N.jpeg_quality("data"))
    rows = rows.withColumn("quality", F.least(F.lit(quality), source))
    tried = rows.select("*", F.posexplode(allowed(policy, F.col("media_type"), fixed)).alias("cand", "format"))

    def run(frames):
        for f in frames:
            yield f.assign(new_data=[encoder(bytes(d), int(q), k) if encoder else None for d, q, k in zip(f["data"], f["quality"], f["format"], strict=True)])

    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in tried.schema), "new_data binary"])
    coded = tried.mapInPandas(run, schema).withColumn("new_size", F.octet_length("new_data").cast("long"))
    key = F.struct("book_id", "ord")
    best = smallest(coded.withColumn("_key", key), "_key", "new_size", "cand").drop("_key")
    original = F.octet_length("data").cast("long")
    kept = never_larger(original, F.col("new_size"))
    mapped = lambda table: T.mapped(F.col("format"), table)
    new_path = F.concat(F.regexp_replace("path", "\\.[^./]*$", ""), F.lit("."), mapped(EXTENSIONS))
    return best.select(
        "book_id", "ord", "id", "href", T.basename("path").alias("name"), original.alias("original_size"), F.when(kept, original).otherwise(F.col("new_size")).alias("new_size"), kept.alias("kept"),
        F.when(~kept, F.col("format")).alias("format"), F.when(~kept, new_path).alias("new_href"), F.when(~kept, mapped(TYPES)).alias("new_type"),
        P.is_cover_item("id", "href", "cover_id").alias("is_cover"), F.when(~kept, F.col("new_data")).alias("new_data"), F.col("path"),
    )


def changes(images: DataFrame) -> DataFrame:
    """What an image run changes in manifests: (book_id, ord, href, new_href decoded, new_type, is_cover)."""
    return images.where(~F.col("kept")).select("book_id", "ord", "href", "new_href", "new_type", "is_cover")


__all__ = ["EXTENSIONS", "FORMATS", "TYPES", "changes", "optimized"]
