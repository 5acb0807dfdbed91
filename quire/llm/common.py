"""Helpers shared by the training-data operators."""

from __future__ import annotations

import atexit
import contextlib
import ctypes
import os
import re
import tempfile
import uuid
from collections.abc import Iterator
from pathlib import Path

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegralType, NullType

ROOT = str(Path(__file__).resolve().parents[2])

#: Bytes of rows that Python workers get at once, unless the session says otherwise: texts are long, and workers hold a batch several times over.
BATCH_BYTES = 8 << 20
_BATCH = "spark.sql.execution.arrow.maxBytesPerBatch"

#: ASCII white space, [\x20\x09-\x0D]: what separates words in every contract of this subpackage.
BLANKS = " \t\n\x0b\x0c\r"


def prepare(spark: SparkSession) -> SparkSession:
    """Let Python workers import this package, bound their batches, and make sure there is a checkpoint folder.

    The cluster names the folder in ``spark.checkpoint.dir``; only where that is unset and the
    master is local (tests, a laptop) is a temporary one made.
    """
    sc = spark.sparkContext
    known = sc.environment.get("PYTHONPATH", "")
    if ROOT not in known.split(os.pathsep):
        sc.environment["PYTHONPATH"] = os.pathsep.join(x for x in (ROOT, known) if x)
    if spark.conf.get(_BATCH, None) is None:
        spark.conf.set(_BATCH, str(BATCH_BYTES))
    if sc.getCheckpointDir() is None:
        named = spark.conf.get("spark.checkpoint.dir", None)
        if not named and not re.fullmatch(r"local(\[.*\])?", sc.master):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="quire-"))
    return spark


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return prepare(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder that the driver and all executors see."""
    return prepare(spark).sparkContext.getCheckpointDir()


def _remove(spark: SparkSession, path: str) -> None:
    try:
        jvm = spark.sparkContext._jvm
        where = jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)
    except Exception:  # noqa: BLE001  the session has ended before the interpreter
        pass


def new_folder(spark: SparkSession, what: str) -> str:
    """A path of its own in the shared folder, removed when the driver ends."""
    path = f"{shared_folder(spark)}/{what}-{uuid.uuid4().hex}"
    atexit.register(_remove, spark, path)
    return path


def written(df: DataFrame, what: str) -> DataFrame:
    """``df`` as a table in the shared folder: computed once, whichever executors are lost later."""
    path = new_folder(df.sparkSession, what)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def tidy(batches: Iterator) -> Iterator:
    """The batches; at their end the worker gives its free memory back, as it lives on beside later stages'."""
    yield from batches
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # a C library of another kind
        ctypes.CDLL(None).malloc_trim(0)


def let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` computed once per row."""
    return F.transform(F.array(value), body)[0]


def words_of(text: Column) -> Column:
    """Words [^\\x20\\x09-\\x0D]+ of a text as an array; none for null, empty or blank texts."""
    bare = F.btrim(F.coalesce(text, F.lit("")), F.lit(BLANKS))
    return F.when(bare == "", F.array().cast("array<string>")).otherwise(F.split(bare, "[\\x20\\x09-\\x0D]+"))


def partitions(df: DataFrame) -> int:
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def whole_ids(df: DataFrame, doc_id: str) -> None:
    """Raises a TypeError unless the ids are whole numbers (or a column of nulls)."""
    kind = df.schema[doc_id].dataType
    if not isinstance(kind, IntegralType | NullType):
        raise TypeError(f"{doc_id} is {kind.simpleString()}: ids must be whole numbers")
