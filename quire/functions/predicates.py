"""Predicates and classifications: boolean columns, with false for null unless said otherwise."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import IMAGE_TYPES, _c, ascii_lower, basename, collapse, extension, letters_only, stem, strip

#: Extensions that are stored as they are, being compressed already.
VERBATIM = (
    "jpg", "jpeg", "png", "gif", "webp", "avif", "jxl", "jp2", "j2k", "jpf", "jpx", "heic", "heif", "tif", "tiff",
    "woff", "woff2", "mp3", "m4a", "aac", "ogg", "oga", "opus", "flac", "mp4", "m4v", "webm", "mov", "mkv", "avi",
    "zip", "gz", "zst", "br", "xz", "7z", "rar",
)
#: Text entries, documents and reference-bearing entries by extension.
TEXTS = ("xhtml", "html", "htm", "css", "opf", "ncx", "xml", "svg", "txt", "json")
DOCUMENTS = ("html", "xhtml", "htm")
REFERRING = ("xhtml", "html", "htm", "css", "svg", "ncx")
MARKDOWN = ("md", "markdown", "mdown", "mkd", "mkdn")
#: Raster types that are encoded anew; font types and what is wrong with others.
RASTERS = ("image/jpeg", "image/jpg", "image/png")
TTF_RIGHT = ("font/ttf", "application/font-sfnt")
TTF_WRONG = ("application/x-font-ttf", "application/x-font-truetype", "application/x-truetype-font", "application/octet-stream")
#: Elements that never have an end tag; those whose text is left alone; those that start a paragraph.
VOID = ("br", "hr", "wbr", "img", "input", "link", "meta", "area", "base", "col", "embed", "source", "track", "param")
SKIPPED = ("script", "style", "pre", "audio", "video", "svg", "math")
BLOCKS = (
    "p", "div", "h1", "h2", "h3", "h4", "h5", "h6", "li", "blockquote", "ol", "ul", "dl", "dd", "dt", "table", "tr", "td", "th",
    "section", "article", "aside", "header", "footer", "nav", "figure", "figcaption", "caption", "main",
)
#: Fixed value: the path that a container's shared dictionary is stored under.
DICTIONARY = "META-INF/zstd-dict.bin"


def is_raster(media_type) -> Column:
    return F.coalesce(_c(media_type).isin(*RASTERS), F.lit(False))


def is_verbatim(path) -> Column:
    return F.coalesce((_c(path) == "mimetype") | extension(path).isin(*VERBATIM), F.lit(False))


def is_text(path) -> Column:
    return F.coalesce((_c(path) != "mimetype") & extension(path).isin(*TEXTS), F.lit(False))


def is_dictionary_text(path) -> Column:
    return is_text(path) & (_c(path) != DICTIONARY)


def _has_ext(path, exts) -> Column:
    """By a real extension: a name that has a dot, not only a leading one."""
    return F.coalesce(basename(path).rlike("(?s)^.+\\.[^.]*$") & extension(basename(path)).isin(*exts), F.lit(False))


def is_document(path) -> Column:
    return _has_ext(path, DOCUMENTS)


def is_referring(path) -> Column:
    return _has_ext(path, REFERRING)


def is_markdown(path) -> Column:
    return _has_ext(path, MARKDOWN)


def has_extension(path, ext: str) -> Column:
    return _has_ext(path, (ext.lower(),))


def is_cover_file(path) -> Column:
    return _has_ext(path, tuple(IMAGE_TYPES)) & (ascii_lower(stem(path)) == "cover")


def is_finder_junk(path) -> Column:
    return F.coalesce(F.array_contains(F.split(_c(path), "/"), "__MACOSX") | basename(path).startswith("._"), F.lit(False))


def escapes(path) -> Column:
    """Whether an entry would be written outside its folder."""
    return F.coalesce(_c(path).startswith("/") | _c(path).startswith("\\") | _c(path).rlike("(^|[/\\\\])\\.\\.([/\\\\]|$)") | _c(path).rlike("^[A-Za-z]:"), F.lit(True))


def is_ttf(href) -> Column:
    return F.coalesce(extension(href) == "ttf", F.lit(False))


def needs_ttf_type(media_type) -> Column:
    """Null, blank and legacy types; the right ones and unknown ones are left."""
    t = strip(F.coalesce(_c(media_type), F.lit("")))
    return (t == "") | t.isin(*TTF_WRONG)


def has_html_syntax(markup) -> Column:
    """Whether an element without content isn't closed by ``/>``."""
    tags = F.regexp_extract_all(_c(markup), F.lit(f"(?is)<(?:{'|'.join(VOID)})\\b[^>]*>"), F.lit(0))
    return F.coalesce(F.exists(tags, lambda t: ~F.regexp_replace(t, "(?U)\\s+$", "").endswith("/>")), F.lit(False))


def is_page_number(block) -> Column:
    """Up to six bytes of digits or of roman letters."""
    t = strip(block)
    return F.coalesce((F.octet_length(t) <= 6) & t.rlike("^([0-9]+|[ivxlcdmIVXLCDM]+)$"), F.lit(False))


def is_roman(token) -> Column:
    return F.coalesce(_c(token).rlike("^[ivxlcdm]{1,8}$"), F.lit(False))


def count_of(x, pattern: str) -> Column:
    """Characters of a class."""
    return F.length(F.regexp_replace(_c(x), f"[^{pattern}]", ""))


def is_heading(block, born_digital=None, big_font=None) -> Column:
    """At most twelve words, no ASCII digit, three letters, of which 85 % upper case; or a large font on a born-digital page."""
    words = F.size(F.split(collapse(block), " "))
    letters, upper = count_of(block, "\\p{IsAlphabetic}"), count_of(block, "\\p{IsUppercase}&&[\\p{IsAlphabetic}]")
    caps = (upper / letters).cast("float") >= F.lit(0.85).cast("float")
    large = F.lit(False) if big_font is None or born_digital is None else _c(born_digital) & F.array_contains(_c(big_font), letters_only(block))
    return F.coalesce((words <= 12) & ~_c(block).rlike("[0-9]") & (letters >= 3) & (caps | large), F.lit(False))


def passes_letter_gate(text) -> Column:
    """False where at least 50 characters aren't white space and under 45 % of them are letters."""
    solid = F.length(F.regexp_replace(_c(text), "(?U)\\s", ""))
    letters = count_of(text, "\\p{IsAlphabetic}")
    return ~F.coalesce((solid >= 50) & (letters.cast("float") < solid.cast("float") * F.lit(0.45).cast("float")), F.lit(False))


def is_on(x) -> Column:
    return F.coalesce(strip(x).isin("true", "on", "1"), F.lit(False))


def has_isbn(source, identifiers) -> Column:
    """By a source that names one, or an identifier's scheme or value. identifiers: array<struct<value, scheme>>."""
    named = F.exists(_c(identifiers), lambda i: F.coalesce(F.lower(i["scheme"]) == "isbn", F.lit(False)) | F.coalesce(ascii_lower(i["value"]).contains("isbn"), F.lit(False)))
    return F.coalesce(_c(source).contains("isbn"), F.lit(False)) | F.coalesce(named, F.lit(False))


def is_cover_item(item_id, href, cover_id) -> Column:
    return F.coalesce(_c(cover_id) == _c(item_id), F.lit(False)) | F.lower(_c(item_id)).contains("cover") | F.lower(_c(href)).contains("cover")


def is_full_page(images) -> Column:
    """Whether an image has more than 400 000 pixels. images: array<struct<w, h>>."""
    return F.coalesce(F.exists(_c(images), lambda i: i["w"] * i["h"] > 400_000), F.lit(False))


def has_text_layer(shown_bytes) -> Column:
    return F.coalesce(_c(shown_bytes) >= 100, F.lit(False))
