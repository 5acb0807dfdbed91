"""Taking numbered parts out of texts, shared by the line and the sentence operators.

A row is known by its id and a hash of its text, so rows that repeat an id keep apart, and rows that
repeat both are one document. Parts of such a document are never repeats of one another's. The hash's
last bit says that the id is null, which stands behind all others.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import partitions, tidy, whole_ids

#: Stands for a null id in the order of ids: last.
LAST = np.iinfo(np.int64).max
#: Texts that are put together at once.
ROWS = 500
SCHEMA = "h long, doc long, k long, a int, b int, sure boolean"


def identity(doc_id: str, whole: Column) -> tuple[Column, Column]:
    """The id as a long with null last, and the hash that tells rows of one id apart; its last bit marks a null id."""
    flag = F.col(doc_id).isNull().cast("long")
    return F.coalesce(F.col(doc_id).cast("long"), F.lit(int(LAST))), F.xxhash64(whole).bitwiseAND(F.lit(-2)).bitwiseOR(flag)


def id_of(doc: str, k: str, kind: str) -> Column:
    """The id again."""
    return F.when(F.col(k).bitwiseAND(F.lit(1)) == 0, F.col(doc)).cast(kind)


def keyed(df: DataFrame, doc_id: str, text: str) -> DataFrame:
    """(doc, k, text) by identity()."""
    whole_ids(df, doc_id)
    whole = F.coalesce(F.col(text), F.lit(""))
    doc, k = identity(doc_id, whole)
    return df.select(doc.alias("doc"), k.alias("k"), whole.alias("text"))


def slices(batches: Iterator[pa.RecordBatch], most: int = 1 << 22) -> Iterator[tuple[np.ndarray, np.ndarray, list[str]]]:
    """(doc, k, texts) of about ``most`` characters at once."""
    for batch in batches:
        doc, k, text = batch.column(0).to_numpy(zero_copy_only=False), batch.column(1).to_numpy(zero_copy_only=False), batch.column(2)
        sizes = np.cumsum(pa.compute.binary_length(text).to_numpy(zero_copy_only=False))
        a = 0
        while a < len(doc):
            b = max(a + 1, int(np.searchsorted(sizes, (sizes[a - 1] if a else 0) + most)))
            yield doc[a:b], k[a:b], text.slice(a, b - a).to_pylist()
            a = b


def gathered(found: DataFrame) -> DataFrame:
    """(doc, k, parts): the ranges of a document's removed parts, which may overlap, as (from, to) in one long each."""
    packed = F.col("a").cast("long") * (1 << 32) + F.col("b")
    return found.groupBy("doc", "k").agg(F.collect_list(packed).alias("parts"))


def applied(df: DataFrame, found: DataFrame, doc_id: str, text: str, split: Callable[[str], list[str]], total: str, removed: str) -> DataFrame:
    """``df`` with the parts taken out of its texts, and the counts of parts and of removed parts.

    The rows keep all their columns but those named like the counts, which are replaced; a null
    text stays null with counts 0.
    """
    df = df.drop(total, removed)
    doc, k = identity(doc_id, F.coalesce(F.col(text), F.lit("")))
    names = df.columns
    whole = df.select(F.struct(*(F.col(f"`{c}`") for c in names)).alias("row"), doc.alias("doc"), k.alias("k"))
    joined = whole.join(gathered(found), ["doc", "k"], "left").select("row", "parts")

    def run(batches):
        for batch in (b.slice(i, ROWS) for b in batches for i in range(0, b.num_rows, ROWS)):
            row = batch.column(0)
            at, columns = row.type.get_field_index(text), row.flatten()
            out, n, gone = [], [], []
            for t, parts in zip(columns[at], batch.column(1), strict=True):
                t = t.as_py()
                drop = {i for x in parts.as_py() or () for i in range(x >> 32, x & 0xFFFFFFFF)}
                pieces = split(t) if t else []
                n.append(len(pieces))
                gone.append(len(drop))
                if drop:
                    t = "".join(p for i, p in enumerate(pieces) if i not in drop)
                out.append(t)
            columns[at] = pa.array(out, pa.string())
            yield pa.RecordBatch.from_arrays([*columns, pa.array(n, pa.int64()), pa.array(gone, pa.int64())], [*names, total, removed])

    ddl = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema), f"{total} long", f"{removed} long"])
    return joined.mapInArrow(lambda x: tidy(run(x)), ddl)


def dealt(found: DataFrame) -> DataFrame:
    """Rows of one key together, in the order of documents; rows that are settled already go anywhere."""
    key = F.when(F.col("sure"), F.xxhash64("doc", "a")).otherwise(F.col("h"))
    return found.repartition(partitions(found), key).sortWithinPartitions("sure", "h", "doc", "k", "a", "b")
