"""Containers, solid archives and packages with method 93, out of entries and back.

Entries are rows (book_id, ord, path, data). A container is built in one task: it is one file. What is
decided about entries (stored or streamed, offsets, checksums, statistics) is decided on rows.
"""

from __future__ import annotations

import io
import json
import struct
import zipfile
import zlib

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.functions import numbers as N
from quire.functions import predicates as P
from quire.functions import text as T

MIMETYPE = b"application/epub+zip"
#: Fixed values of the archive format.
FORMAT, VERSION, LEVEL = "eparc", 1, 19
MANIFEST, STREAM, MEDIA = "manifest.json", "data.zst", "media/"
_STAMP = (1980, 1, 1, 0, 0, 0)


def classified(entries: DataFrame) -> DataFrame:
    """Adds streamed, size, crc32 and source_format to entries."""
    verbatim = P.is_verbatim("path")
    return entries.withColumns({"streamed": ~verbatim, "size": F.octet_length("data").cast("long"), "crc32": N.crc32_hex("data"), "source_format": F.when(verbatim, T.extension("path"))})


def intact(data, crc32) -> Column:
    return F.coalesce(N.crc32_hex(data) == T._c(crc32), F.lit(False))


def _zip(parts: list[tuple[str, bytes, int]]) -> bytes:
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for path, data, how in parts:
            info = zipfile.ZipInfo(path, _STAMP)
            info.compress_type = how
            z.writestr(info, data)
    return out.getvalue()


def container_of(entries: list[tuple[str, bytes]]) -> bytes:
    """A conformant container: the mimetype first and stored, the rest deflated; a missing mimetype is made."""
    own = dict(entries).get("mimetype", MIMETYPE)
    return _zip([("mimetype", own, zipfile.ZIP_STORED), *((p, d, zipfile.ZIP_DEFLATED) for p, d in entries if p != "mimetype")])


def containers(entries: DataFrame) -> DataFrame:
    """(book_id, data): the container of each book's entries, in their order."""
    return _packed(entries, container_of)


def _packed(entries: DataFrame, pack) -> DataFrame:
    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("ord")
        return pd.DataFrame({"book_id": [rows["book_id"].iloc[0]], "data": [pack([(p, bytes(d) if d is not None else b"") for p, d in zip(rows["path"], rows["data"], strict=True)])]})

    return entries.select("book_id", "ord", "path", "data").groupBy("book_id").applyInPandas(run, "book_id string, data binary")


def replaced(entries: DataFrame, new: DataFrame) -> DataFrame:
    """Entries with some replaced by (book_id, path, new_data)."""
    return entries.join(new, ["book_id", "path"], "left").select("book_id", "ord", "path", F.coalesce("new_data", "data").alias("data"))


# Solid archives


def archived(entries: DataFrame, originals: DataFrame, created: str, level: int = LEVEL) -> DataFrame:
    """(book_id, data): an archive of each book: all that isn't compressed yet as one zstd frame, the rest as it is.

    originals: (book_id, filename, size, sha256) of the containers that the entries are from.
    """
    rows = classified(entries).join(originals.select("book_id", "filename", F.col("size").alias("o_size"), "sha256"), "book_id")

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        import zstandard

        rows = rows.sort_values("ord")
        one = rows.iloc[0]
        listed = []
        for r in rows.itertuples():
            listed.append({"path": r.path, "store": "stream" if r.streamed else "verbatim", "size": int(r.size), "crc32": r.crc32} | ({} if r.streamed else {"media_format": "original", "source_format": r.source_format}))
        info = {
            "format": FORMAT, "format_version": VERSION, "tool": "quire", "created": created,
            "source": {"filename": one.filename, "size": int(one.o_size), "sha256": one.sha256},
            "epub_version": _version([(r.path, bytes(r.data)) for r in rows.itertuples()]),
            "codec": {"name": "zstd", "implementation": "zstandard", "level": level, "mode": "solid"}, "entries": listed,
        }
        stream = zstandard.ZstdCompressor(level=level).compress(b"".join(bytes(r.data) for r in rows.itertuples() if r.streamed))
        parts = [(MANIFEST, json.dumps(info, indent=2).encode()), (STREAM, stream), *((MEDIA + r.path, bytes(r.data)) for r in rows.itertuples() if not r.streamed)]
        return pd.DataFrame({"book_id": [one.book_id], "data": [_zip([(p, d, zipfile.ZIP_STORED) for p, d in parts])]})

    return rows.groupBy("book_id").applyInPandas(run, "book_id string, data binary")


def _version(entries: list[tuple[str, bytes]]) -> str | None:
    from .package import info_of

    for path, data in entries:
        if path.lower().endswith(".opf"):
            return (info_of(data.decode("utf-8", "replace")) or {}).get("version")
    return None


def restored_of(data: bytes) -> list[tuple[str, bytes]]:
    """The entries of an archive in their order. ValueError where it is another format, newer, cut or changed."""
    import zstandard

    try:
        z = zipfile.ZipFile(io.BytesIO(data))
        info = json.loads(z.read(MANIFEST))
    except (zipfile.BadZipFile, KeyError, ValueError) as e:
        raise ValueError(f"no readable archive: {e}") from None
    if info.get("format") != FORMAT:
        raise ValueError(f"another format: {info.get('format')}")
    if info["format_version"] > VERSION:
        raise ValueError(f"format version {info['format_version']} is newer than {VERSION}")
    total = sum(e["size"] for e in info["entries"] if e["store"] == "stream")
    try:
        stream = zstandard.ZstdDecompressor().decompressobj().decompress(z.read(STREAM))
    except zstandard.ZstdError as e:
        raise ValueError(f"the stream can't be decompressed: {e}") from None
    if len(stream) != total:
        raise ValueError(f"the stream has {len(stream)} bytes, {total} were expected")
    out, at = [], 0
    for e in info["entries"]:
        if e["store"] == "stream":
            part, at = stream[at : at + e["size"]], at + e["size"]
        else:
            part = z.read(MEDIA + e["path"])
        if f"{zlib.crc32(part):08x}" != e["crc32"]:
            raise ValueError(f"{e['path']} has changed")
        out.append((e["path"], part))
    return out


_ENTRIES = "book_id string, ord int, path string, data binary, error string"


def _unpacked(archives: DataFrame, unpack) -> DataFrame:
    def run(frames):
        for f in frames:
            out = []
            for book, data in zip(f["book_id"], f["data"], strict=True):
                try:
                    out += [(book, i, p, d, None) for i, (p, d) in enumerate(unpack(bytes(data)))]
                except ValueError as e:
                    out.append((book, None, None, None, str(e)))
            yield pd.DataFrame(out, columns=["book_id", "ord", "path", "data", "error"]).astype({"ord": "Int32"})

    return archives.select("book_id", "data").mapInPandas(run, _ENTRIES)


def restored(archives: DataFrame) -> DataFrame:
    """Entries of archives (book_id, data); a broken archive is one row with an error."""
    return _unpacked(archives, restored_of)


# Method 93: entries compressed one by one with zstd, with or without a dictionary in common


def packed_of(entries: list[tuple[str, bytes]], level: int = LEVEL, dictionary: bytes | None = None) -> bytes:
    """A ZIP archive by method 93; the mimetype is stored, and a dictionary behind it."""
    import zstandard

    plain = zstandard.ZstdCompressor(level=level)
    primed = zstandard.ZstdCompressor(level=level, dict_data=zstandard.ZstdCompressionDict(dictionary)) if dictionary else plain
    rows: list[tuple[str, int, bytes, bytes]] = []
    for path, data in entries:
        if path == "mimetype":
            rows.append((path, 0, data, data))
        else:
            rows.append((path, 93, data, (primed if _text(path) else plain).compress(data)))
    if dictionary:
        at = next((i + 1 for i, r in enumerate(rows) if r[0] == "mimetype"), 0)
        rows.insert(at, (P.DICTIONARY, 0, dictionary, dictionary))
    out, index = bytearray(), bytearray()
    for path, method, data, payload in rows:
        name, where = path.encode(), len(out)
        if len(name) > 0xFFFF or max(where, len(payload), len(data)) > 0xFFFFFFFF:
            raise ValueError(f"{path} doesn't fit")
        common = struct.pack("<HHHHHIIIHH", 63 if method else 20, 0, method, 0, 0x21, zlib.crc32(data), len(payload), len(data), len(name), 0)
        out += b"PK\x03\x04" + common + name + payload
        index += b"PK\x01\x02" + struct.pack("<H", 20) + common + struct.pack("<HHHII", 0, 0, 0, 0, where) + name
    return bytes(out + index + b"PK\x05\x06" + struct.pack("<HHHHIIH", 0, 0, len(rows), len(rows), len(index), len(out), 0))


def _text(path: str) -> bool:
    return path not in ("mimetype", P.DICTIONARY) and path.rpartition(".")[2].lower() in P.TEXTS


def trained_of(entries: list[tuple[str, bytes]], divisor: int = 8, least: int = 4096, most: int = 112_640, files: int = 2) -> bytes | None:
    """A dictionary of a book's text entries, or None where there is too little to learn from."""
    import zstandard

    texts = [d for p, d in entries if _text(p)]
    total = sum(map(len, texts))
    if total < least or len(texts) < files:
        return None
    chunks = [d[i : i + 1024] for d in texts for i in range(0, len(d), 1024)]
    try:
        return zstandard.train_dictionary(max(least, min(most, total // divisor)), chunks).as_bytes()
    except zstandard.ZstdError:
        return None


def best_of(entries: list[tuple[str, bytes]], level: int = LEVEL) -> bytes:
    """The smaller of both ways; of equals the one without a dictionary."""
    alone = packed_of(entries, level)
    shared = trained_of(entries)
    with_ = packed_of(entries, level, shared) if shared else alone
    return with_ if len(with_) < len(alone) else alone


def packed(entries: DataFrame, level: int = LEVEL, way: str = "best") -> DataFrame:
    """(book_id, data) by method 93; way: plain, shared or best."""
    ways = {"plain": lambda e: packed_of(e, level), "shared": lambda e: packed_of(e, level, trained_of(e)), "best": lambda e: best_of(e, level)}
    return _packed(entries, ways[way])


def records_of(data: bytes) -> list[tuple[str, int, int, int, int, int]]:
    """(name, method, crc, size, start, stop) by the central directory, every bound checked."""

    def at(i, form):
        size = struct.calcsize(form)
        if i < 0 or i + size > len(data):
            raise ValueError("the archive is cut")
        return struct.unpack_from(form, data, i)

    end = data.rfind(b"PK\x05\x06", max(0, len(data) - 65_557))
    if end < 0:
        raise ValueError("no end of a central directory")
    count, _, pos = at(end + 10, "<HII")
    out = []
    for _ in range(count):
        if at(pos, "<4s")[0] != b"PK\x01\x02":
            raise ValueError("a broken central directory")
        method, crc, packed_size, size, n, extra, comment, where = at(pos + 10, "<H4xIIIHHH8xI")
        name = at(pos + 46, f"<{n}s")[0].decode("utf-8", "replace")
        if at(where, "<4s")[0] != b"PK\x03\x04":
            raise ValueError(f"no header of {name}")
        start = where + 30 + sum(at(where + 26, "<HH"))
        at(start, f"<{packed_size}s")
        out.append((name, method, crc, size, start, start + packed_size))
        pos += 46 + n + extra + comment
    return out


def unpacked_of(data: bytes) -> list[tuple[str, bytes]]:
    """Entries of a method 93 archive in order, checked; its dictionary isn't one."""
    import zstandard

    rows = records_of(data)
    shared = next((data[r[4] : r[5]] for r in rows if r[0] == P.DICTIONARY), None)
    plain = zstandard.ZstdDecompressor()
    primed = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(shared)) if shared else plain
    out = []
    for name, method, crc, size, start, stop in rows:
        if name == P.DICTIONARY:
            continue
        part = data[start:stop]
        if method == 93:
            try:
                part = (primed if _text(name) else plain).decompress(part, max_output_size=size)
            except zstandard.ZstdError as e:
                raise ValueError(f"{name}: {e}") from None
        elif method:
            raise ValueError(f"{name} is by method {method}")
        if zlib.crc32(part) != crc:
            raise ValueError(f"{name} has changed")
        out.append((name, part))
    return out


def unpacked(archives: DataFrame) -> DataFrame:
    """Entries of method 93 archives; a broken one is one row with an error."""
    return _unpacked(archives, unpacked_of)


def codec_sizes(entries: DataFrame, levels: tuple[int, ...] = (3, 19)) -> DataFrame:
    """(book_id, codec, raw, packed) of each book's entries one by one: deflate, and zstd at some levels; round trips are checked."""

    def run(frames):
        import zstandard

        for f in frames:
            out = []
            for book, data in zip(f["book_id"], f["data"], strict=True):
                raw = bytes(data or b"")
                tried = {"deflate": (zlib.compress(raw, 6), zlib.decompress)}
                for n in levels:
                    tried[f"zstd-{n}"] = (zstandard.ZstdCompressor(level=n).compress(raw), zstandard.ZstdDecompressor().decompress)
                for codec, (small, back) in tried.items():
                    if back(small) != raw:
                        raise ValueError(f"{codec} doesn't give back what it was given")
                    out.append((book, codec, len(raw), len(small)))
            yield pd.DataFrame(out, columns=["book_id", "codec", "raw", "packed"])

    each = entries.select("book_id", "data").mapInPandas(run, "book_id string, codec string, raw long, packed long")
    return each.groupBy("book_id", "codec").agg(F.sum("raw").alias("raw"), F.sum("packed").alias("packed"))
