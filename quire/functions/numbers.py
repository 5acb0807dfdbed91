"""Scalar functions over numbers, sizes, bytes and matrices."""

from __future__ import annotations

import struct

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import _c


def commas(x) -> Column:
    """An integer with commas between thousands."""
    return F.format_number(_c(x), 0)


def commas1(x) -> Column:
    """One decimal, halves away from zero, commas between thousands."""
    return F.format_number(F.round(_c(x).cast("double"), 1), 1)


def megabytes(x) -> Column:
    return _c(x) / F.lit(1024.0 * 1024.0)


def size_display(x) -> Column:
    """Bytes as MB with two decimals, KB with one, or B."""
    n = _c(x)
    return F.when(n >= 1 << 20, F.format_string("%.2f MB", megabytes(n))).when(n >= 1024, F.format_string("%.1f KB", n / F.lit(1024.0))).otherwise(F.concat(n.cast("string"), F.lit(" B")))


def percent(part, whole) -> Column:
    """100 part / whole, 0 of nothing."""
    return F.coalesce(F.try_divide(_c(part) * 100.0, _c(whole)), F.lit(0.0))


def saved_percent(before, after) -> Column:
    """By how much the size fell; below 0 if it grew, 0 of nothing."""
    return F.when(_c(before) > 0, (_c(before) - _c(after)) / _c(before) * 100.0).otherwise(F.lit(0.0))


def rate(size, seconds) -> Column:
    """MB (of 10^6 bytes) a second, 0 in no time."""
    return F.coalesce(F.try_divide(_c(size) / 1e6, _c(seconds)), F.lit(0.0))


def clamp(x, low, high) -> Column:
    return F.greatest(F.least(_c(x), F.lit(high)), F.lit(low))


def avif_quality(q) -> Column:
    """The AVIF quality that looks like a WebP quality; single precision. Fixed coefficients."""
    x = clamp(_c(q).cast("float"), 45.0, 95.0).cast("float")
    y = F.lit(0.017529).cast("float") * x * x - F.lit(1.70862).cast("float") * x + F.lit(95.783).cast("float")
    return clamp(y, 1.0, 100.0)


def jxl_distance(q) -> Column:
    """The JPEG XL distance that looks like a WebP quality; single precision. Fixed coefficients."""
    x = _c(q).cast("float")
    y = F.lit(-0.000494).cast("float") * x * x + F.lit(0.01808).cast("float") * x + F.lit(3.639).cast("float")
    return clamp(y, 0.4, 15.0)


def crc32_hex(x) -> Column:
    return F.lpad(F.lower(F.hex(F.crc32(_c(x)))), 8, "0")


def dictionary_size(corpus, files, divisor: int = 8, least: int = 4096, most: int = 112_640, files_least: int = 2) -> Column:
    """Bytes of a shared dictionary: an eighth of the corpus from 4 to 110 KiB; null for too little text."""
    size = F.greatest(F.lit(least), F.least(F.lit(most), F.floor(_c(corpus) / divisor)))
    return F.when((_c(corpus) >= least) & (_c(files) >= files_least), size.cast("long"))


def multiplied(a, b) -> Column:
    """Two affine matrices (a b c d e f) of row vectors, the first applied first."""
    x, y = _c(a), _c(b)
    cell = lambda r, c: x[2 * r] * y[c] + x[2 * r + 1] * y[2 + c] + (y[4 + c] if r == 2 else F.lit(0.0))
    return F.array(*(cell(r, c) for r in range(3) for c in range(2)))


def moved(m, dx, dy) -> Column:
    """The matrix with a translation before it."""
    return multiplied(F.array(*(F.lit(v) for v in (1.0, 0.0, 0.0, 1.0)), _c(dx), _c(dy)), m)


def run_size(size, m) -> Column:
    """A font size under a matrix, in its vertical direction."""
    return _c(size) * F.sqrt(_c(m)[2] * _c(m)[2] + _c(m)[3] * _c(m)[3])


def run_width(advance, size, m) -> Column:
    return _c(advance) * _c(size) * F.sqrt(_c(m)[0] * _c(m)[0] + _c(m)[1] * _c(m)[1])


def data_uri(x) -> Column:
    """The bytes of base64 text, with or without ``data:...,`` before it; null if it is none."""
    bare = F.regexp_replace(F.when(_c(x).startswith("data:"), F.regexp_replace(_c(x), "^[^,]*,", "")).otherwise(_c(x)), "(?U)\\s", "")
    return F.try_to_binary(bare, F.lit("base64"))


def hex_code(x) -> Column:
    """The number of hex digits; null if they are none."""
    return F.when(_c(x).rlike("^[0-9A-Fa-f]{1,8}$"), F.conv(_c(x), 16, 10).cast("long"))


def hex_text(x) -> Column:
    """Text of hex digits in fours as UTF-16; null unless there are whole fours."""
    return F.when(_c(x).rlike("^([0-9A-Fa-f]{4})+$"), F.decode(F.unhex(_c(x)), "UTF-16BE"))


def utc_stamp(x) -> Column:
    return F.date_format(_c(x), "yyyy-MM-dd'T'HH:mm:ss'Z'")


def components(space, icc) -> Column:
    """Channels of an image's colour space: 1, 3 or null."""
    return F.when(_c(space) == "DeviceGray", 1).when(_c(space) == "DeviceRGB", 3).when((_c(space) == "ICCBased") & _c(icc).isin(1, 3), _c(icc))


#: The luminance table of the JPEG standard, row by row.
LUMINANCE = (
    16, 11, 10, 16, 24, 40, 51, 61,
    12, 12, 14, 19, 26, 58, 60, 55,
    14, 13, 16, 24, 40, 57, 69, 56,
    14, 17, 22, 29, 51, 87, 80, 62,
    18, 22, 37, 56, 68, 109, 103, 77,
    24, 35, 55, 64, 81, 104, 113, 92,
    49, 64, 78, 87, 103, 121, 120, 101,
    72, 92, 95, 98, 112, 100, 103, 99,
)


def _segments(data: bytes):
    """(marker, payload) of a JPEG's headers, up to the scan or the first broken segment."""
    at = 2
    while at + 4 <= len(data):
        lead, marker, size = struct.unpack_from(">BBH", data, at)
        if lead != 0xFF:
            at += 1
        elif marker in (0xD8, 0xD9) or 0xD0 <= marker <= 0xD7:
            at += 2
        elif size < 2 or at + 2 + size > len(data) or marker == 0xDA:
            return
        else:
            yield marker, data[at + 4 : at + 2 + size]
            at += 2 + size


def jpeg_quality_of(data: bytes | None) -> int | None:
    """The quality (1 to 100) a JPEG was saved at, by its luminance table; null if there is none."""
    for marker, body in _segments(data or b""):
        while marker == 0xDB and body:
            wide, which = body[0] >> 4, body[0] & 15
            size = 128 if wide == 1 else 64
            table, body = body[1 : 1 + size], body[1 + size :]
            if len(table) < size:
                break
            if wide == 0 and which == 0:
                ratios = [100.0 * q / s for q, s in zip(table, LUMINANCE, strict=True) if 0 < q < 255]
                if not ratios:
                    return None
                mean = sum(ratios) / len(ratios)
                quality = (200.0 - mean) / 2.0 if mean < 100.0 else 5000.0 / mean
                return max(1, min(100, int(quality + 0.5)))
    return None


def jpeg_quality(x) -> Column:
    return F.pandas_udf(lambda s: pd.Series([jpeg_quality_of(v) for v in s], dtype="Int32"), "int")(_c(x))
