"""Containers as rows of entries, and folders of files.

``entries`` reads whole ZIP files that Spark has listed; nothing is opened but by Spark's readers, so
any file system works. ``ContainerSource`` is the same as a data source, with a filter on paths pushed
down to what is decompressed.
"""

from __future__ import annotations

import io
import zipfile

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, In, InputPartition

from quire.functions import predicates as P
from quire.functions import text as T

#: Limits of a container, and of a ZIP of Markdown files.
ENTRIES, BYTES = 50_000, 1 << 30
MARKDOWN_ENTRIES, MARKDOWN_BYTES = 5_000, 200 << 20

SCHEMA = "book_id string, ord int, path string, data binary, error string"


def unsafe(path: str) -> bool:
    """Whether an entry would be written outside its folder."""
    parts = path.replace("\\", "/").split("/")
    return not path or path[0] in "/\\" or ".." in parts or (len(path) > 1 and path[1] == ":")


def entries_of(data: bytes, most: int = ENTRIES, size: int = BYTES, wanted=None, by_header: bool = False) -> list[tuple[int, str, bytes]]:
    """(ord, path, data) of a ZIP file; folders and unsafe entries are skipped, only wanted paths decompressed.

    ValueError beyond the limits. Sizes are counted as they are read, or as headers give them.
    """
    try:
        z = zipfile.ZipFile(io.BytesIO(data))
    except (zipfile.BadZipFile, ValueError) as e:
        raise ValueError(f"no readable ZIP file: {e}") from None
    infos = z.infolist()
    if len(infos) > most:
        raise ValueError(f"{len(infos)} entries, {most} at most")
    out, total, n = [], 0, 0
    for info in infos:
        if info.is_dir() or unsafe(info.filename):
            continue
        if by_header and (total := total + info.file_size) > size:
            raise ValueError(f"more than {size} bytes")
        if wanted is None or info.filename in wanted:
            try:
                with z.open(info) as f:
                    part = f.read(size - total + 1 if not by_header else -1)
            except (zipfile.BadZipFile, NotImplementedError, RuntimeError, EOFError) as e:
                raise ValueError(f"{info.filename}: {e}") from None
            if not by_header and (total := total + len(part)) > size:
                raise ValueError(f"more than {size} bytes")
            out.append((n, info.filename, part))
        n += 1
    return out


def entries(spark: SparkSession, path: str, glob: str = "*.epub", paths: list[str] | None = None, most: int = ENTRIES, size: int = BYTES) -> DataFrame:
    """Entries of all containers under a path, found at any depth; book_id is the file's URI.

    A container that can't be read, or exceeds the limits, is one row with an error.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", glob).load(path)
    return read(files.select(F.col("path").alias("book_id"), F.col("content").alias("data")), paths, most, size)


def read(files: DataFrame, paths: list[str] | None = None, most: int = ENTRIES, size: int = BYTES, by_header: bool = False) -> DataFrame:
    """Entries of ZIP files that are rows (book_id, data)."""
    wanted = None if paths is None else set(paths)

    def run(frames):
        for f in frames:
            for book, data in zip(f["book_id"], f["data"], strict=True):
                try:
                    rows = [(book, i, p, d, None) for i, p, d in entries_of(bytes(data), most, size, wanted, by_header)]
                except ValueError as e:
                    rows = [(book, None, None, None, str(e))]
                yield pd.DataFrame(rows, columns=["book_id", "ord", "path", "data", "error"]).astype({"ord": "Int32"})

    return files.select("book_id", "data").mapInPandas(run, SCHEMA)


def entry(found: DataFrame, path: str) -> DataFrame:
    """(book_id, data) of one path; data is null where a book lacks it."""
    return found.groupBy("book_id").agg(F.max(F.when(F.col("path") == path, F.col("data"))).alias("data"))


def packages(found: DataFrame) -> DataFrame:
    """(book_id, path, xml): the package document that each container names; null xml where it is missing."""
    from quire.operators.package import CONTAINER, package_path

    roots = found.where(F.col("path") == CONTAINER).select("book_id", package_path(F.decode("data", "UTF-8")).alias("path"))
    texts = found.where(F.lower("path").endswith(".opf")).select("book_id", "path", F.decode("data", "UTF-8").alias("xml"))
    return roots.join(texts, ["book_id", "path"], "left")


def files_with(spark: SparkSession, path: str, ext: str) -> DataFrame:
    """Paths of all files with an extension, whatever its case, at any depth; each once, in order."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path", "modificationTime", "length")
    return found.where(P.has_extension("path", ext)).dropDuplicates(["path"]).orderBy("path")


def markdown_folder(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(files, assets) of one folder, not those below it: Markdown files (book_id, path, text), other files (book_id, path, data)."""
    found = spark.read.format("binaryFile").load(path).select(F.lit(path).alias("book_id"), T.basename("path").alias("path"), F.col("content").alias("data"))
    return _markdown(found)


def markdown_zips(files: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(files, assets, covers) of ZIP files (book_id, data); covers: the shallowest cover image's path of each."""
    found = read(files, None, MARKDOWN_ENTRIES, MARKDOWN_BYTES, by_header=True).where(F.col("error").isNull())
    texts, assets = _markdown(found)
    from quire.operators.selection import shallowest

    return texts, assets, shallowest(found.where(P.is_cover_file("path") & ~P.is_finder_junk("path")), "book_id")


def _markdown(found: DataFrame) -> tuple[DataFrame, DataFrame]:
    clean = found.where(~P.is_finder_junk("path"))
    texts = clean.where(P.is_markdown("path")).select("book_id", "path", F.decode("data", "UTF-8").alias("text"))
    return texts, clean.where(~P.is_markdown("path")).select("book_id", "path", "data")


def register(spark: SparkSession) -> None:
    """Makes ``zip_entries`` known to a session, with filters pushed down to it."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(ContainerSource)


class ContainerSource(DataSource):
    """``spark.read.format("zip_entries").load(file)`` on a file system that executors share; see ``register``.

    Options: path (a file or a glob), maxEntries, maxBytes. Equality and IN on ``path`` are pushed
    down: other entries aren't decompressed.
    """

    @classmethod
    def name(cls) -> str:
        return "zip_entries"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return _Reader(self.options)


class _Reader(DataSourceReader):
    def __init__(self, options):
        self.files, self.wanted = options["path"], None
        self.most, self.size = int(options.get("maxEntries", ENTRIES)), int(options.get("maxBytes", BYTES))

    def pushFilters(self, filters):
        for f in filters:
            values = {f.value} if isinstance(f, EqualTo) else set(f.value) if isinstance(f, In) else None
            if values is not None and f.attribute == ("path",):
                self.wanted = values if self.wanted is None else self.wanted & values
            else:
                yield f

    def partitions(self):
        import glob

        return [InputPartition(x) for x in sorted(glob.glob(self.files))]

    def read(self, partition):
        with open(partition.value, "rb") as f:
            data = f.read()
        try:
            for i, p, d in entries_of(data, self.most, self.size, self.wanted):
                yield partition.value, i, p, d, None
        except ValueError as e:
            yield partition.value, None, None, None, str(e)
