"""Scalar functions over strings, paths, URLs and markup: Column in, Column out.

Null in, null out, unless a docstring says otherwise. White space and letters are Unicode's, written
``(?U)\\s`` and ``\\p{IsAlphabetic}``; where only ASCII letters change case, that is said.
"""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
SPACES = "(?U)\\s+"


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def ascii_lower(x) -> Column:
    """A-Z in lower case, all else as it is."""
    return F.translate(_c(x), UPPER, LOWER)


def collapse(x) -> Column:
    """Runs of white space as one space, none at the ends."""
    return F.btrim(F.regexp_replace(_c(x), SPACES, " "))


def strip(x) -> Column:
    return F.regexp_replace(_c(x), "(?U)^\\s+|\\s+$", "")


def non_blank(x) -> Column:
    """Trimmed; null if nothing is left."""
    return F.nullif(strip(x), F.lit(""))


# Paths and URLs


def quote(x) -> Column:
    """Percent-encoded but for A-Z a-z 0-9 _ . - ~ and /."""
    out = F.url_encode(_c(x))
    for a, b in (("+", "%20"), ("*", "%2A"), ("%2F", "/"), ("%7E", "~")):
        out = F.replace(out, F.lit(a), F.lit(b))
    return out


def unquote(x) -> Column:
    """Percent-decoded; ``+`` and a ``%`` without two hexadecimal digits behind it stay, bytes that aren't UTF-8 become U+FFFD."""
    whole = F.regexp_replace(F.replace(_c(x), F.lit("+"), F.lit("%2B")), "%(?![0-9A-Fa-f]{2})", "%25")
    return F.coalesce(F.try_url_decode(whole), _c(x))


def basename(x) -> Column:
    return F.substring_index(_c(x), "/", -1)


def dirname(x) -> Column:
    """What stands before the last slash, '' without one."""
    return F.regexp_replace(_c(x), "/?[^/]*$", "")


def with_ext(x, ext: str) -> Column:
    """The last name's extension replaced, or added where it has none."""
    return F.concat(F.regexp_replace(_c(x), "\\.[^./]*$", ""), F.lit(f".{ext}"))


def extension(x) -> Column:
    """Lower-case text behind the last dot, the whole name without one."""
    return F.lower(F.substring_index(_c(x), ".", -1))


def stem(x) -> Column:
    """A name without its last extension; a leading dot starts no extension."""
    return F.regexp_replace(basename(x), "(?s)^(.+)\\.[^.]*$", "$1")


def backslashes(x) -> Column:
    return F.replace(_c(x), F.lit("\\"), F.lit("/"))


def https_host(x) -> Column:
    """The host of an https URL, null for any other."""
    return F.when(_c(x).startswith("https://"), F.regexp_extract(_c(x), "^https://([^/]*)", 1))


def https_path(x) -> Column:
    return F.when(_c(x).startswith("https://"), F.coalesce(F.nullif(F.regexp_extract(_c(x), "^https://[^/]*(/.*)$", 1), F.lit("")), F.lit("/")))


def redirect(host, location) -> Column:
    """Where a Location header leads: always https."""
    at = _c(location)
    return (
        F.when(at.startswith("https://"), at)
        .when(at.startswith("http://"), F.concat(F.lit("https://"), F.substring(at, 8, 1 << 30)))
        .when(at.startswith("/"), F.concat(F.lit("https://"), _c(host), at))
        .otherwise(F.concat(F.lit("https://"), _c(host), F.lit("/"), at))
    )


def client_ip(forwarded, peer) -> Column:
    """The first forwarded entry if it is an address, else the peer's."""
    first = strip(F.split(F.coalesce(_c(forwarded), F.lit("")), ",")[0])
    byte = "(25[0-5]|2[0-4][0-9]|1[0-9]{2}|[1-9]?[0-9])"
    four = first.rlike(f"^{byte}(\\.{byte}){{3}}$")
    six = first.rlike("^[0-9A-Fa-f:.]*:[0-9A-Fa-f:.]*$") & first.rlike("^(([0-9A-Fa-f]{1,4}:){7}[0-9A-Fa-f]{1,4}|(([0-9A-Fa-f]{1,4}:){0,6}[0-9A-Fa-f]{0,4})?::(([0-9A-Fa-f]{1,4}:){0,6}[0-9A-Fa-f]{1,4})?)$")
    return F.when(four | six, first).otherwise(_c(peer))


# Names


_ROMAN = {  # letters that decomposition leaves whole
    "ı": "i", "ß": "ss", "æ": "ae", "Æ": "AE", "œ": "oe", "Œ": "OE", "ø": "o", "Ø": "O", "đ": "d", "Đ": "D",
    "ð": "d", "Ð": "D", "þ": "th", "Þ": "Th", "ł": "l", "Ł": "L", "–": "-", "—": "-", "‘": "'", "’": "'", "“": '"', "”": '"',
}


def romanize(s: str) -> str:
    """Letters as plain ASCII where decomposition or a small table has them; others are dropped.

    Scripts other than Latin are not transliterated.
    """
    return "".join(_ROMAN.get(c, c) for c in unicodedata.normalize("NFKD", "".join(_ROMAN.get(c, c) for c in s)) if not unicodedata.combining(c))


def _slug(s: str | None) -> str | None:
    if s is None:
        return None
    out = ""
    for c in romanize(s):
        if c.isascii() and (c.isalnum() or c in ".-"):
            out += c
        elif (c.isspace() or c == "_") and not out.endswith("_"):
            out += "_"
    return out.strip("_") or "output"


def slugify(x) -> Column:
    """An ASCII file name: white space and _ runs are one _, other signs go, ``output`` if nothing is left."""
    return F.pandas_udf(lambda s: pd.Series([_slug(v) for v in s], dtype=object), "string")(_c(x))


def output_name(stem_, version: str = "3.3", kepub: bool | Column = False, packed: bool | Column = False) -> Column:
    """``book_v3.3.epub``, ``book_v3.3.kepub.epub`` or, packed for research, ``book_zstd-experimental.epub``."""
    version, kepub, packed = (F.lit(x) for x in (version, kepub, packed))
    base = F.when(kepub, F.concat(_c(stem_), F.lit("_v"), version, F.lit(".kepub"))).when(packed, _c(stem_)).otherwise(F.concat(_c(stem_), F.lit("_v"), version))
    return F.concat(base, F.when(packed, F.lit("_zstd-experimental.epub")).otherwise(F.lit(".epub")))


def decoded_name(name) -> Column:
    new = F.replace(_c(name), F.lit("_zstd-experimental.epub"), F.lit("_decoded.epub"))
    return F.when(new.endswith("_decoded.epub"), new).otherwise(F.concat(stem(name), F.lit("_decoded.epub")))


def sibling(path, ext: str) -> Column:
    """The path with its name's extension replaced, in the same folder ('.' without one)."""
    folder = F.when(_c(path).contains("/"), dirname(path)).otherwise(F.lit("."))
    return F.concat(folder, F.lit("/"), stem(path), F.lit(f".{ext}"))


def sanitize_filename(x, default: str = "output.epub") -> Column:
    """Letters, digits, blanks and . ( ) _ - of ASCII; any other sign is _; a default for nothing."""
    return F.coalesce(F.nullif(F.btrim(F.regexp_replace(_c(x), "[^A-Za-z0-9 .()_-]", "_")), F.lit("")), F.lit(default))


def sanitize_image_id(x) -> Column:
    last = F.regexp_replace(_c(x), "(?s)^.*[/\\\\]", "")
    return F.coalesce(F.nullif(F.regexp_replace(last, "[^A-Za-z0-9._-]", "_"), F.lit("")), F.lit("image"))


def capitalize(x) -> Column:
    return F.concat(F.upper(F.left(_c(x), F.lit(1))), F.lower(F.substring(_c(x), 2, 1 << 30)))


def local_name(x) -> Column:
    return F.substring_index(_c(x), ":", -1)


def author_display(x) -> Column:
    """``Last, First`` as ``First Last``; names with no comma or several stay."""
    return F.regexp_replace(_c(x), "^([^,]+),\\s*([^,]+)$", "$2 $1")


def series(x) -> Column:
    """struct(name, position): a position is digits and dots behind the last colon."""
    at = F.regexp_extract(_c(x), "(?s)^(.*):([0-9.]+)$", 2)
    name = F.when(at != "", F.regexp_extract(_c(x), "(?s)^(.*):([0-9.]+)$", 1)).otherwise(_c(x))
    return F.struct(name.alias("name"), F.nullif(at, F.lit("")).alias("position"))


def series_display(name, position) -> Column:
    return F.when(_c(position).isNotNull(), F.concat(_c(name), F.lit(":"), _c(position))).otherwise(_c(name))


def clipped(x, most: int) -> Column:
    """The first characters and … where there are more."""
    return F.when(F.length(_c(x)) > most, F.concat(F.left(_c(x), F.lit(most)), F.lit("…"))).otherwise(_c(x))


def lines(x) -> Column:
    """Trimmed lines that aren't blank, null if there are none."""
    kept = F.filter(F.transform(F.split(_c(x), "\r?\n"), strip), lambda v: v != "")
    return F.when(F.size(kept) > 0, kept)


# Markup


def xml_escape(x) -> Column:
    """& < > \" escaped, control characters that XML 1.0 forbids dropped."""
    out = F.regexp_replace(_c(x), "[\\x00-\\x08\\x0B\\x0C\\x0E-\\x1F]", "")
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        out = F.replace(out, F.lit(a), F.lit(b))
    return out


def json_string(x) -> Column:
    """A text as a JSON string, quotes included."""
    return F.regexp_extract(F.to_json(F.struct(_c(x).alias("v"))), '(?s)^\\{"v":(.*)\\}$', 1)


def strip_doctype(x) -> Column:
    """Without its first document type."""
    return F.regexp_replace(_c(x), "(?is)^(.*?)<!DOCTYPE[^>]*>", "$1")


def standard_doctype(x) -> Column:
    return F.regexp_replace(_c(x), "(?i)<!DOCTYPE\\s+html[^>]*>", "<!DOCTYPE html>")


def xhtml_namespace(x) -> Column:
    named = 'xmlns="http://www.w3.org/1999/xhtml"'
    return F.when(~_c(x).contains(named), F.replace(_c(x), F.lit("<html"), F.lit(f"<html {named}"))).otherwise(_c(x))


# Text


def letters_only(x) -> Column:
    """Letters with A-Z in lower case; all else is one space."""
    return F.btrim(F.regexp_replace(ascii_lower(x), "[^\\p{IsAlphabetic}]+", " "))


def template(x) -> Column:
    """Letters only, without tokens that are roman numbers: what recurs in running heads."""
    tokens = F.filter(F.split(letters_only(x), " "), lambda t: ~t.rlike("^[ivxlcdm]{1,8}$"))
    return F.array_join(tokens, " ")


def dehyphenated(x) -> Column:
    """Words that a line's end has cut are joined, white space is collapsed."""
    return collapse(F.regexp_replace(_c(x), "(?U)(\\p{L})-\\s+(\\p{Ll})", "$1$2"))


#: What may stand between a sentence's end and the white space behind it.
CLOSERS = "'\"”’»…"


def sentences(x) -> Column:
    """Segments that add up to the text: each ends behind [.!?], closing marks and white space."""
    end = f"[.!?][{CLOSERS}]*(?U:\\s)+"
    return F.regexp_extract_all(_c(x), F.lit(f"(?s).*?{end}|.+"), F.lit(0))


# Codes


#: Language codes of three letters and their codes of two.
LANGUAGES = {
    "eng": "en", "tur": "tr", "kor": "ko", "ger": "de", "deu": "de", "fre": "fr", "fra": "fr", "spa": "es", "ita": "it",
    "rus": "ru", "ara": "ar", "jpn": "ja", "chi": "zh", "zho": "zh", "por": "pt", "dut": "nl", "nld": "nl", "gre": "el",
    "ell": "el", "heb": "he", "hin": "hi", "fas": "fa", "per": "fa", "pol": "pl", "swe": "sv", "ukr": "uk",
}
#: Guide types that are named differently as landmarks.
LANDMARKS = {"text": "bodymatter", "title-page": "titlepage", "acknowledgements": "acknowledgments"}
#: Image types by file extension.
IMAGE_TYPES = {
    "png": "image/png", "jpg": "image/jpeg", "jpeg": "image/jpeg", "gif": "image/gif", "webp": "image/webp", "svg": "image/svg+xml",
    "avif": "image/avif", "jxl": "image/jxl", "bmp": "image/bmp", "tif": "image/tiff", "tiff": "image/tiff",
}


def mapped(x, table: dict[str, str], default: Column | None = None) -> Column:
    """The table's value; without one the default, or null."""
    found = F.create_map(*(F.lit(v) for kv in table.items() for v in kv))[x]
    return F.coalesce(found, default) if default is not None else found


def language(x) -> Column:
    low = ascii_lower(x)
    return mapped(low, LANGUAGES, low)


def landmark(x) -> Column:
    return mapped(_c(x), LANDMARKS, _c(x))


def image_type(ext) -> Column:
    return mapped(_c(ext), IMAGE_TYPES)


def primary_subtag(x) -> Column:
    return ascii_lower(F.split(_c(x), "[-_]")[0])


def isbn(x) -> Column:
    """Without white space and hyphens; no check of its digits."""
    return F.regexp_replace(_c(x), "(?U)[\\s-]", "")


def error_class(message, status) -> Column:
    m = ascii_lower(message)
    return (
        F.when((_c(status) == 429) | m.contains("too many requests") | m.contains("server busy"), "busy")
        .when(m.contains("429") | m.contains("rate limited"), "rate_limited")
        .when(m.contains("not found"), "not_found")
        .when(m.contains("enter an isbn"), "no_isbn")
        .otherwise("failed")
    )


def ui_language(saved, wanted, known: list[str]) -> Column:
    """The saved language if it is known, else the first wanted one whose primary subtag is, else en."""
    has = F.array(*map(F.lit, known))
    first = F.get(F.filter(F.transform(_c(wanted), primary_subtag), lambda v: F.array_contains(has, v)), F.lit(0))
    return F.coalesce(F.when(F.array_contains(has, _c(saved)), _c(saved)), first, F.lit("en"))


def display_date(iso, lang) -> Column:
    """yyyy-mm-dd as dd.mm.yyyy, year first for ja, ko and zh; other texts stay."""
    y, m, d = (F.regexp_extract(_c(iso), "^(\\d{4})-(\\d{2})-(\\d{2})$", i) for i in (1, 2, 3))
    return F.when(y == "", _c(iso)).when(_c(lang).isin("ja", "ko", "zh"), F.concat_ws(".", y, m, d)).otherwise(F.concat_ws(".", d, m, y))


def iso_date(shown) -> Column:
    """d.m.yyyy or yyyy.m.d, with . / - or ; between, as yyyy-mm-dd; other texts stay."""
    a = "^\\s*(\\d{1,2})[./;-](\\d{1,2})[./;-](\\d{4})\\s*$"
    b = "^\\s*(\\d{4})[./;-](\\d{1,2})[./;-](\\d{1,2})\\s*$"
    part = lambda p, i, n: F.lpad(F.regexp_extract(_c(shown), p, i), n, "0")
    return (
        F.when(_c(shown).rlike(a), F.concat_ws("-", part(a, 3, 4), part(a, 2, 2), part(a, 1, 2)))
        .when(_c(shown).rlike(b), F.concat_ws("-", part(b, 1, 4), part(b, 2, 2), part(b, 3, 2)))
        .otherwise(_c(shown))
    )
