"""What queries are made of: tables, literal rows that both engines read, and a registry."""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession

from quire.session import reachable

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    """Registers a query under its function's name, with the SQL that says the same."""

    def keep(f):
        QUERIES[f.__name__] = wraps(f)(lambda spark, sf_dir: f(reachable(spark), sf_dir))
        if sql is not None:
            ORACLES[f.__name__] = sql.strip()
        return f

    return keep


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


class Literals:
    """A few rows as a VALUES list. Texts hold neither quotes nor backslashes, so that both dialects read them alike."""

    def __init__(self, columns: str, values: str):
        self.sql = f"(SELECT * FROM (VALUES {values.strip()}) AS t({columns}))"

    def df(self, spark: SparkSession) -> DataFrame:
        return spark.sql(f"SELECT * FROM {self.sql}")


#: Lines of documents as blocks: a source is a book, a document its page, a line a block.
BLOCKS_SQL = """
docs AS (SELECT source AS book_id, doc_id AS page_num, text FROM documents WHERE text IS NOT NULL),
blocks AS (SELECT book_id, page_num, i - 1 AS seq, string_split(text, chr(10))[i] AS text
           FROM (SELECT *, unnest(range(1, len(string_split(text, chr(10))) + 1)) AS i FROM docs))"""


def blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import functions as F

    docs = table(spark, sf_dir, "documents").where("text IS NOT NULL")
    return docs.select(F.col("source").alias("book_id"), F.col("doc_id").alias("page_num"), F.posexplode(F.split("text", "\n")).alias("seq", "text"))
