"""python -m quire optimize|archive|restore|show|set|import: thin commands over the operators.

What can't be read is told on the standard error stream, and makes the exit code 1.
"""

from __future__ import annotations

import argparse
import sys
from pathlib import Path

from pyspark.sql import functions as F

from quire.functions import text as T
from quire.operators import archive, markup, metadata, modernize
from quire.session import local_session
from quire.sources import containers


#: What ``set`` takes; of lists any number.
LISTS = ("authors", "subjects")
FIELDS = ("title", "subtitle", "authors", "language", "publisher", "date", "description", "subjects", "isbn", "series", "position")


def _save(rows, folder: Path) -> None:
    """Writes (name, data) rows one at a time; a command's output is a handful of files."""
    folder.mkdir(parents=True, exist_ok=True)
    for r in rows.toLocalIterator():
        (folder / r["name"]).write_bytes(bytes(r["data"]))
        print(folder / r["name"])


def _told(errors) -> int:
    """Prints (book_id, error) rows; the exit code that they make."""
    code = 0
    for r in errors.toLocalIterator():
        print(f"{r['book_id']}: {r['error']}", file=sys.stderr)
        code = 1
    return code


def main(argv: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(prog="quire", description=__doc__)
    commands = parser.add_subparsers(dest="command", required=True)
    for name in ("optimize", "archive", "restore", "show", "set", "import"):
        sub = commands.add_parser(name)
        sub.add_argument("input", help="a folder")
        sub.add_argument("-o", "--output", default="out", type=Path)
        sub.add_argument("--target", choices=["3.3", "3.4"], help="3.3 unless said; restore makes books anew only if this, --policy or --spans is given")
        sub.add_argument("--policy", choices=["fixed", "auto", "best"], help="of images; restore takes 3.4 for its target then")
        sub.add_argument("--spans", action="store_true")
        if name == "set":
            for field in FIELDS:
                sub.add_argument(f"--{field}", action="append" if field in LISTS else "store")
    args = parser.parse_args(argv)
    spark = local_session()
    named = T.stem("book_id")
    if args.command == "import":
        files, assets = containers.markdown_folder(spark, args.input)
        found = markup.markdown_books(files, assets)
        books = found.where("kind = 'book'").select("book_id", "title", F.lit("en").alias("language"), F.lit("2000-01-01T00:00:00Z").alias("modified"))
        pictures = found.where("kind = 'image'").select("book_id", "number", F.col("body").alias("path")).join(assets, ["book_id", "path"]).select("book_id", "number", T.extension("path").alias("ext"), "data")
        made = archive.containers(markup.book_entries(found.where("kind = 'chapter'"), pictures, books))
        _save(made.join(books, "book_id").select(F.concat(T.slugify("title"), F.lit(".epub")).alias("name"), "data"), args.output)
        return 0
    asked = args.target or ("3.4" if args.policy and args.command == "restore" else "3.3")
    options = modernize.Options(target=asked, policy=args.policy, spans=args.spans)
    if args.command == "restore":
        packed = spark.read.format("binaryFile").option("pathGlobFilter", "*.eparc").load(args.input).select(F.col("path").alias("book_id"), F.col("content").alias("data"))
        entries, errors = modernize.restored(packed, options if args.target or args.policy or args.spans else None)
        _save(archive.containers(entries).select(F.concat(named, F.lit(".epub")).alias("name"), "data"), args.output)
        return _told(errors)
    scanned = containers.entries(spark, args.input)
    entries = scanned.where("error IS NULL")
    errors = scanned.where("error IS NOT NULL").select("book_id", "error")
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.epub").load(args.input)
    originals = files.select(F.col("path").alias("book_id"), T.basename("path").alias("filename"), F.col("length").alias("size"), F.sha2("content", 256).alias("sha256"))
    if args.command == "archive":
        _save(archive.archived(entries, originals, "2000-01-01T00:00:00Z").select(F.concat(named, F.lit(".eparc")).alias("name"), "data"), args.output)
    elif args.command == "set":
        books = modernize.books(entries)
        errors = errors.unionByName(modernize.problems(entries))
        good = books.where("error IS NULL")
        value = {f: getattr(args, f) for f in ("title", "subtitle", "authors", "language", "publisher", "date", "description", "subjects", "isbn")}
        fields = [F.lit(v).cast("array<string>" if f in LISTS else "string").alias(f) for f, v in value.items()]
        series = F.struct(F.lit(args.series).cast("string").alias("name"), F.lit(args.position).cast("string").alias("position"))
        updates = good.select("book_id", *fields, F.when(F.lit(args.series is not None), series).alias("series"))
        new = metadata.updated(good, updates, options.modified).join(good.select("book_id", "opf"), "book_id").where("xml IS NOT NULL")
        new = new.select("book_id", F.col("opf").alias("path"), F.col("xml").cast("binary").alias("new_data"))
        _save(archive.containers(archive.replaced(entries, new)).select(F.concat(named, F.lit(".epub")).alias("name"), "data"), args.output)
    elif args.command == "show":
        errors = errors.unionByName(modernize.problems(entries))
        books = modernize.books(entries).where("error IS NULL")
        elements = books.select("book_id", F.inline("info.elements"))
        md = metadata.read(elements, books.select("book_id", "info.version", "info.unique_identifier"))
        for r in metadata.as_text(md).toLocalIterator():
            print(r["text"])
    else:
        errors = errors.unionByName(modernize.problems(entries))
        new, shots, lint = modernize.modernized(entries, options)
        done = modernize.reports(originals, new, shots, lint, options, "2000-01-01 00:00:00")
        _save(done.select(T.output_name(named, asked).alias("name"), "data"), args.output)
    return _told(errors)


if __name__ == "__main__":
    sys.exit(main())
