"""WARC records in ZIP-packaged archives, read by range.

An archive is a ZIP file whose members are stored: WARC files under ``archive/``, in which every
record of a ``.warc.gz`` is a gzip member of its own, and under ``indexes/`` lines that tell where
records are. The reader parses the ZIP's (or ZIP64's) central directory, finds where the stored
members begin, and reads single records by their offsets; nothing is extracted. Index lines may be
JSON, CDXJ (key, time, JSON) or CDX with a line of field letters; WARC files that no index names are
walked record by record. The writer makes one WARC file and one index of JSON lines an archive.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import json
import re
import struct
import uuid
import zipfile
import zlib

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import new_folder, prepare, table, whole_ids, written

DATA, INDEX = "archive/data.warc.gz", "indexes/index.cdx"
#: Equal payloads from this size on are stored once.
REVISIT_FROM = 1000
#: An archive is closed at so many records or bytes.
ARCHIVE_RECORDS, ARCHIVE_BYTES = 20_000, 1 << 28
#: Records that one task reads at a time.
BLOCK = 256
#: Records that the reader returns.
TYPES = ("response", "revisit", "resource")
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def _store(uri: str):
    """(file system, path) of a URI that the driver and executors share."""
    if "://" not in uri and not uri.startswith("file:"):
        return fs.LocalFileSystem(), uri
    return fs.FileSystem.from_uri(re.sub("^file:/+", "file:///", uri))


# Records


def _member(data: bytes) -> bytes:
    z = zlib.compressobj(1, zlib.DEFLATED, 31)
    return z.compress(data) + z.flush()


def record(page_id, url, payload: bytes, digest: str, refers_to=None) -> bytes:
    """One record: a response with its payload, or a revisit of the response of page ``refers_to``."""
    revisit = refers_to is not None
    head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = head if revisit else head + payload
    name = lambda i: f"<urn:x-page:{'' if i is None else i}>"
    fields = [
        ("WARC-Type", "revisit" if revisit else "response"),
        ("WARC-Record-ID", name(page_id)),
        ("WARC-Date", "2000-01-01T00:00:00Z"),
        ("WARC-Target-URI", re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url or f"urn:x-page:{page_id}")),
        ("WARC-Payload-Digest", "sha1:" + base64.b32encode(bytes.fromhex(digest)).decode()),
        *([("WARC-Refers-To", name(refers_to)), ("WARC-Profile", PROFILE)] if revisit else []),
        ("Content-Type", "application/http;msgtype=response"),
        ("Content-Length", str(len(block))),
    ]
    return ("WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in fields) + "\r\n").encode() + block + b"\r\n\r\n"


def parse(data: bytes) -> dict:
    """Fields (lower case), block and, of HTTP records, payload and payload_bytes."""
    head, _, rest = data.partition(b"\r\n\r\n")
    first, *lines = head.decode("utf-8", "replace").split("\r\n")
    if not first.startswith("WARC/"):
        raise ValueError("not a WARC record")
    fields = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines)}
    block = rest[: int(fields["content-length"])]
    if len(block) != int(fields["content-length"]):
        raise ValueError("a record is shorter than its Content-Length")
    http, _, payload = block.partition(b"\r\n\r\n") if block.startswith(b"HTTP/") else (b"", b"", block)
    length = re.search(rb"(?im)^content-length:\s*(\d+)", http)
    chunked = re.search(rb"(?im)^transfer-encoding:.*chunked", http) is not None
    told = int(length[1]) if length else None if fields.get("warc-type") == "revisit" else len(payload)
    return {"fields": fields, "block": block, "payload": payload, "payload_bytes": told, "chunked": chunked}


def plain(data: bytes) -> bytes:
    """A record's bytes, out of its gzip member if it has one."""
    return zlib.decompress(data, 31) if data[:2] == b"\x1f\x8b" else data


# Archives


class Members:
    """The members of a ZIP archive, from its central directory; the file is only read by range."""

    def __init__(self, file):
        self.file = file
        size = file.size()
        tail = self.read(max(0, size - 65_557), min(size, 65_557))
        at = tail.rfind(b"PK\x05\x06")
        if at < 0:
            raise ValueError("no end of a central directory")
        count, length, start = struct.unpack("<HII", tail[at + 10 : at + 20])
        end = size - len(tail) + at
        if 0xFFFF == count or 0xFFFFFFFF in (length, start):
            locator = self.read(end - 20, 20)
            if locator[:4] == b"PK\x06\x07":
                (at64,) = struct.unpack("<Q", locator[8:16])
                big = self.read(at64, 56)
                if big[:4] != b"PK\x06\x06":
                    raise ValueError("no ZIP64 end of a central directory")
                count, length, start = struct.unpack("<QQQ", big[32:56])
        directory, i, self.by_name = self.read(start, length), 0, {}
        for _ in range(count):
            if directory[i : i + 4] != b"PK\x01\x02":
                raise ValueError("a broken central directory")
            method, packed, plain, n, extra, comment, offset = struct.unpack("<H8xIIHHH8xI", directory[i + 10 : i + 46])
            name = directory[i + 46 : i + 46 + n].decode("utf-8", "replace")
            more, j = directory[i + 46 + n : i + 46 + n + extra], 0
            while j + 4 <= len(more):
                kind, long = struct.unpack("<HH", more[j : j + 4])
                if kind == 1:  # ZIP64: only the values that don't fit, in this order
                    values = iter(struct.unpack(f"<{long // 8}Q", more[j + 4 : j + 4 + long // 8 * 8]))
                    plain, packed, offset = (next(values) if v == 0xFFFFFFFF else v for v in (plain, packed, offset))
                j += 4 + long
            self.by_name[name] = (method, packed, offset)
            i += 46 + n + extra + comment

    def read(self, start: int, length: int) -> bytes:
        self.file.seek(start)
        data = self.file.read(length)
        if len(data) != length:
            raise ValueError("an archive ends too early")
        return data

    def stored(self, name: str) -> tuple[int, int]:
        """(start, length) of a member's bytes in the archive; compressed members can't be read by range."""
        method, length, offset = self.by_name[name]
        if method:
            raise ValueError(f"{name} is compressed")
        head = self.read(offset, 30)
        if head[:4] != b"PK\x03\x04":
            raise ValueError(f"no header of {name}")
        n, extra = struct.unpack("<HH", head[26:30])
        return offset + 30 + n + extra, length


def _walk_gzip(members: Members, start: int, length: int):
    """(offset, length) of each gzip member."""
    at = 0
    while at < length:
        z, used = zlib.decompressobj(31), 0
        while not z.eof:
            part = members.read(start + at + used, min(1 << 16, length - at - used))
            if not part:
                raise ValueError("a record ends too early")
            z.decompress(part)
            used += len(part)
        used -= len(z.unused_data)
        yield at, used
        at += used


def _walk_plain(members: Members, start: int, length: int):
    """(offset, length) of each record that isn't compressed, by the lengths in their heads."""
    at = 0
    while at < length:
        head = b""
        while b"\r\n\r\n" not in head:
            part = members.read(start + at + len(head), min(1 << 12, length - at - len(head)))
            if not part:
                raise ValueError("a record ends too early")
            head += part
        told = re.search(rb"(?im)^content-length:\s*(\d+)", head.partition(b"\r\n\r\n")[0])
        if told is None:
            raise ValueError("a record without Content-Length")
        used = head.index(b"\r\n\r\n") + 4 + int(told[1]) + 4
        if at + used > length:
            raise ValueError("a record ends too early")
        yield at, used
        at += used


def index_entries(lines: list[str]):
    """(WARC file or None, offset, length or None) of index lines in any of the three forms; others are passed over."""
    letters = None
    for line in lines:
        if line[:5].strip() == "CDX":
            letters = line.split()[1:]
        elif (at := line.find("{")) >= 0:
            x = json.loads(line[at:])
            if "offset" in x:
                yield x.get("filename"), int(x["offset"]), int(x["length"]) if "length" in x else None
        elif letters and len(fields := line.split()) == len(letters) and {"V", "g"} <= set(letters):
            x = dict(zip(letters, fields, strict=True))
            yield x["g"], int(x["V"]), int(x["S"]) if x.get("S", "-").isdigit() else None


def locate(file) -> list[tuple[int, list[tuple[int, int]]]]:
    """For each WARC file in the archive: where it begins, and (offset, length) of its records.

    By the indexes, in the order of offsets and each record once; an entry without a file name is of
    the only file. A file that no entry names, or whose entries lack lengths, is walked.
    """
    members = Members(file)
    data = sorted(n for n in members.by_name if n.startswith("archive/") and n.endswith((".warc", ".warc.gz")))
    if not data:
        raise ValueError("no WARC file in the archive")
    short = {n.removeprefix("archive/"): n for n in data}
    told: dict[str, set] = {n: set() for n in data}
    for name in sorted(members.by_name):
        if not name.startswith("indexes/") or name.endswith("/"):
            continue
        raw = members.read(*members.stored(name))
        raw = gzip.decompress(raw) if raw[:2] == b"\x1f\x8b" else raw
        for named, offset, length in index_entries(raw.decode("utf-8", "replace").splitlines()):
            at = data[0] if named is None and len(data) == 1 else short.get((named or "").removeprefix("archive/"))
            if at is not None:
                told[at].add((offset, length))
    out = []
    for name in data:
        start, length = members.stored(name)
        places = told[name]
        if not places or any(n is None for _, n in places):
            walk = _walk_gzip if name.endswith(".gz") else _walk_plain
            places = walk(members, start, length)
        out.append((start, sorted(places)))
    return out


def write(df: DataFrame, folder: str, records: int = ARCHIVE_RECORDS, size: int = ARCHIVE_BYTES) -> DataFrame:
    """Writes rows (page_id, url, payload, payload_digest, refers_to) to archives in a shared folder.

    Ids must be whole numbers (TypeError). Returns a table (path, records) of the archives. A task writes files of its own under new names,
    so a task that is run again after a loss leaves no half archive in the table. Null payloads are
    empty; a null url is named by the page.
    """
    whole_ids(df, "page_id")
    store, path = _store(folder)
    store.create_dir(path, recursive=True)

    def run(batches):
        store, path = _store(folder)
        done, rows = [], []
        index: list[str] = []
        at, z, out, member, name = 0, None, None, None, ""

        def close():
            nonlocal z
            if z is None:
                return
            member.close()
            z.writestr(INDEX, "".join(index))
            z.close()
            out.close()
            done.append((name, len(index)))
            z = None

        for batch in batches:
            columns = [batch.column(batch.schema.get_field_index(c)) for c in ("page_id", "url", "payload", "payload_digest", "refers_to")]
            for rows in zip(*columns, strict=True):
                page_id, url, payload, digest, refers_to = (x.as_py() for x in rows)
                if z is None:
                    name, at, index = f"{path}/pages-{uuid.uuid4().hex}.wacz", 0, []
                    out = store.open_output_stream(name)
                    z = zipfile.ZipFile(out, "w", zipfile.ZIP_STORED, allowZip64=True)
                    member = z.open(zipfile.ZipInfo(DATA), "w", force_zip64=True)
                data = _member(record(page_id, url, payload or b"", digest, refers_to))
                member.write(data)
                index.append(json.dumps({"page": page_id, "url": url, "digest": digest, "offset": at, "length": len(data)}) + "\n")
                at += len(data)
                if len(index) >= records or at >= size:
                    close()
        close()
        yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in done], pa.string()), pa.array([x[1] for x in done], pa.int64())], ["path", "records"])

    return written(df.mapInArrow(run, "path string, records long"), "archives")


def read(archives: DataFrame, folder: str, payload: bool = False) -> DataFrame:
    """The records of archives (path): page_id, url, payload_bytes, payload_digest, record_type, refers_to[, payload].

    An archive's records are dealt out in blocks of consecutive ones. Responses, resources and
    revisits are returned, records about the crawl are not. A response's digest and length are those
    of the payload that was read, which must agree with its header; a revisit has those that its
    header tells, null where it tells none, and no payload. Records of other writers have a null
    page_id, as their ids are no pages'. A broken archive raises an error.
    """

    def blocks(batches):
        store, _ = _store(folder)
        for batch in batches:
            for path in batch.column(0).to_pylist():
                with store.open_input_file(path) as f:
                    found = locate(f)
                for start, own in ((start, places[i : i + BLOCK]) for start, places in found for i in range(0, len(places), BLOCK)):
                    yield pa.RecordBatch.from_arrays([pa.array([path]), pa.array([start], pa.int64()), pa.array([[a for a, _ in own]], pa.list_(pa.int64())), pa.array([[b for _, b in own]], pa.list_(pa.int64()))], ["path", "start", "offsets", "lengths"])

    def records(batches):
        store, _ = _store(folder)
        for batch in batches:
            for path, start, offsets, lengths in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                rows = []
                with store.open_input_file(path) as f:
                    for at, n in zip(offsets, lengths, strict=True):
                        f.seek(start + at)
                        x = parse(plain(f.read(n)))
                        if x["fields"].get("warc-type") in TYPES:
                            rows.append(_told(x, payload))
                yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, (_, t) in enumerate(kinds)], [n for n, _ in kinds])

    kinds = [("page_id", pa.int64()), ("url", pa.string()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64())] + [("payload", pa.binary())] * payload
    listed = archives.select("path").mapInArrow(blocks, "path string, start long, offsets array<long>, lengths array<long>")
    ddl = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long" + ", payload binary" * payload
    return listed.repartition(int(archives.sparkSession.conf.get("spark.sql.shuffle.partitions"))).mapInArrow(records, ddl)


def _page(name: str | None):
    found = re.fullmatch(r"<urn:x-page:(-?\d+)>", name or "")
    return int(found[1]) if found else None


def _sha1(value: str | None) -> str | None:
    """The hex form of a digest that a header gives in base 32 or 16; None where it isn't SHA-1."""
    kind, _, digest = (value or "").partition(":")
    if kind.lower() != "sha1":
        return None
    return digest.lower() if re.fullmatch("[0-9a-fA-F]{40}", digest) else base64.b32decode(digest.upper()).hex()


def _told(x: dict, payload: bool) -> tuple:
    fields = x["fields"]
    digest = _sha1(fields.get("warc-payload-digest"))
    revisit = fields["warc-type"] == "revisit"
    size = x["payload_bytes"]
    if not revisit:
        own, size = hashlib.sha1(x["payload"]).hexdigest(), len(x["payload"])
        if digest not in (None, own) or (not x["chunked"] and size != x["payload_bytes"]):
            raise ValueError("a payload differs from its digest")
        digest = own
    return (_page(fields.get("warc-record-id")), fields.get("warc-target-uri"), size, digest, fields["warc-type"], _page(fields.get("warc-refers-to")), *([None if revisit else x["payload"]] if payload else []))


def deduplicated(pages: DataFrame, least: int = REVISIT_FROM) -> DataFrame:
    """page_id, url, payload, payload_digest, refers_to: of equal payloads of ``least`` bytes the largest page_id is stored.

    Null html is empty. Rows that repeat the largest page_id are all responses; a null page_id
    revisits it, unless all are null. Only digests that occur twice are joined back.
    """
    own = pages.select("page_id", "url", F.coalesce(F.col("html"), F.lit("")).cast("binary").alias("payload"))
    own = own.withColumn("payload_digest", F.sha1("payload"))
    large = F.octet_length("payload") >= least
    kept = own.where(large).groupBy("payload_digest").agg(F.max("page_id").alias("_first"), F.count(F.lit(1)).alias("_n")).where("_n > 1").drop("_n")
    refers = F.when(large & F.col("_first").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("_first")), F.col("_first"))
    return own.join(kept, "payload_digest", "left").select("page_id", "url", "payload", "payload_digest", refers.alias("refers_to"))


def op10_warc(spark, sf_dir):
    pages = table(spark, sf_dir, "pages")
    folder = new_folder(prepare(spark), "warc")
    archives = write(deduplicated(pages), folder)
    return read(archives, folder).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


SQL = """
WITH p AS (
  SELECT page_id, octet_length(encode(coalesce(html, ''))) AS n, sha1(coalesce(html, '')) AS d FROM pages),
kept AS (SELECT d, max(page_id) AS first FROM p WHERE n >= 1000 GROUP BY d)
SELECT page_id, n::BIGINT AS payload_bytes, p.d AS payload_digest,
       CASE WHEN first IS NOT NULL AND page_id IS DISTINCT FROM first THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN page_id IS DISTINCT FROM first THEN first END AS refers_to
FROM p LEFT JOIN kept ON kept.d = p.d AND p.n >= 1000
"""
QUERIES = {"op10_warc": op10_warc}
ORACLES = {"op10_warc": SQL}
