"""Queries of scalar functions and predicates."""

from __future__ import annotations

from pyspark.sql import functions as F

from quire.functions import numbers as N
from quire.functions import predicates as P
from quire.functions import text as T

from .base import Literals, query, table

VOID = "br|hr|wbr|img|input|link|meta|area|base|col|embed|source|track|param"
MARKUP = Literals("id, html", """
 (-1, '<!DOCTYPE html PUBLIC "-//W3C//DTD XHTML 1.1//EN"><html><body><br/><img src="a.png" /></body></html>'),
 (-2, '<!doctype HTML><html xmlns="http://www.w3.org/1999/xhtml"><hr ></html>'),
 (-3, '<p>none</p>'), (-4, '<!DOCTYPE html><!DOCTYPE html SYSTEM "x"><HTML><IMG SRC="x"></HTML>'), (-5, '<html><wbr/ ></html>')""")  # fmt: skip
PAGES = f"(SELECT page_id AS id, html FROM pages UNION ALL SELECT * FROM {MARKUP.sql})"


def _pages(spark, sf):
    return table(spark, sf, "pages").select(F.col("page_id").cast("int").alias("id"), "html").unionByName(MARKUP.df(spark))


@query(f"""
SELECT id, len(list_filter(regexp_extract_all(html, '(?is)<(?:{VOID})\\b[^>]*>'), lambda x: NOT rtrim(x) LIKE '%/>')) > 0 AS html_syntax,
       regexp_replace(html, '<!DOCTYPE\\s+html[^>]*>', '<!DOCTYPE html>', 'gi') AS html
FROM {PAGES}""")
def html_syntax_lint(spark, sf):
    return _pages(spark, sf).select("id", P.has_html_syntax("html").alias("html_syntax"), T.standard_doctype("html").alias("html"))


@query(f"""
SELECT id, CASE WHEN contains(html, 'xmlns="http://www.w3.org/1999/xhtml"') THEN html
                ELSE replace(html, '<html', '<html xmlns="http://www.w3.org/1999/xhtml"') END AS html,
       regexp_replace(html, '<!DOCTYPE[^>]*>', '', 'i') AS bare
FROM {PAGES}""")
def xhtml_namespace(spark, sf):
    return _pages(spark, sf).select("id", T.xhtml_namespace("html").alias("html"), T.strip_doctype("html").alias("bare"))


PATHS = Literals("id, path", """
 (-1, 'a.b/c'), (-2, 'x/y.jpg'), (-3, 'noext'), (-4, '.hid'), (-5, 'OEBPS/images/Cover.PNG'), (-6, 'mimetype'), (-7, 'a b/c~d*e_x.tar.GZ'),
 (-8, '__MACOSX/._a.md'), (-9, 'x/cover.jpeg'), (-10, 'notes.MKD'), (-11, 'fonts/f.TTF'), (-12, 'META-INF/zstd-dict.bin'), (-13, 'a/._b.md'), (-14, '100%25+x')""")  # fmt: skip
_PATHS = f"(SELECT page_id AS id, url AS path FROM pages UNION ALL SELECT * FROM {PATHS.sql})"


def _paths(spark, sf):
    return table(spark, sf, "pages").select(F.col("page_id").cast("int").alias("id"), F.col("url").alias("path")).unionByName(PATHS.df(spark))


@query(f"""
SELECT id, replace(url_encode(path), '%2F', '/') AS quoted, url_decode(path) AS unquoted, regexp_extract(path, '[^/]*$') AS name,
       regexp_replace(path, '\\.[^./]*$', '') || '.webp' AS webp, lower(regexp_extract(path, '[^.]*$')) AS ext,
       CASE WHEN starts_with(path, 'https://') THEN regexp_extract(path, '^https://([^/]*)', 1) END AS host
FROM {_PATHS}""")
def url_scalars(spark, sf):
    p = F.col("path")
    return _paths(spark, sf).select("id", T.quote(p).alias("quoted"), T.unquote(p).alias("unquoted"), T.basename(p).alias("name"), T.with_ext(p, "webp").alias("webp"), T.extension(p).alias("ext"), T.https_host(p).alias("host"))


def _listed(values):
    return "(" + ", ".join(f"'{v}'" for v in values) + ")"


_EXT = "lower(regexp_extract(path, '[^.]*$'))"
_NAME = "regexp_extract(path, '[^/]*$')"
_NAMED = f"regexp_matches({_NAME}, '^.+\\.[^.]*$') AND lower(regexp_extract({_NAME}, '[^.]*$'))"


@query(f"""
SELECT id, path = 'mimetype' OR {_EXT} IN {_listed(P.VERBATIM)} AS verbatim, path <> 'mimetype' AND {_EXT} IN {_listed(P.TEXTS)} AS is_text,
       {_NAMED} IN {_listed(P.DOCUMENTS)} AS document, {_NAMED} IN {_listed(P.MARKDOWN)} AS markdown,
       {_NAMED} IN {_listed(T.IMAGE_TYPES)} AND lower(regexp_replace({_NAME}, '\\.[^.]*$', '')) = 'cover' AS cover,
       list_contains(string_split(path, '/'), '__MACOSX') OR starts_with({_NAME}, '._') AS junk, {_EXT} = 'ttf' AS ttf,
       CASE {" ".join(f"WHEN {_EXT} = '{k}' THEN '{v}'" for k, v in T.IMAGE_TYPES.items())} END AS image_type
FROM {_PATHS}""")
def path_predicates(spark, sf):
    p = F.col("path")
    return _paths(spark, sf).select(
        "id", P.is_verbatim(p).alias("verbatim"), P.is_text(p).alias("is_text"), P.is_document(p).alias("document"), P.is_markdown(p).alias("markdown"),
        P.is_cover_file(p).alias("cover"), P.is_finder_junk(p).alias("junk"), P.is_ttf(p).alias("ttf"), T.image_type(T.extension(p)).alias("image_type"),
    )


CODES = Literals("id, code, kind, isbn, series, message, status, name, media", """
 (1, 'TUR', 'text', '978-0 14 0', 'Dune:2', 'HTTP 429 slow down', 500, 'My Book (1).epub', 'application/x-font-ttf'),
 (2, 'en-US', 'title-page', '978', 'A: B', 'Book not found', 404, '  ?*  ', ''), (3, 'zho', 'cover', '-', 'A:1:2.5', 'Server busy', 503, 'a/b.epub', 'font/ttf'),
 (4, 'pt_BR', 'acknowledgements', 'X 1-2', 'N:', 'enter an ISBN', 400, 'ok', 'application/octet-stream'), (5, 'xx', 'toc', ' ', ':3', 'boom', 429, '', 'font/woff'),
 (6, 'GER', 'index', '0-306-40615-2', 'no colon', 'rate limited', 400, 'çay.epub', ' application/font-sfnt ')""")  # fmt: skip


@query(f"""
SELECT id, CASE lower(code) {" ".join(f"WHEN '{k}' THEN '{v}'" for k, v in T.LANGUAGES.items())} ELSE lower(code) END AS lang,
       lower(regexp_extract(code, '^[^-_]*')) AS subtag,
       CASE kind WHEN 'text' THEN 'bodymatter' WHEN 'title-page' THEN 'titlepage' WHEN 'acknowledgements' THEN 'acknowledgments' ELSE kind END AS landmark,
       regexp_replace(isbn, '[\\s-]', '', 'g') AS isbn,
       CASE WHEN regexp_matches(series, '^.*:[0-9.]+$') THEN regexp_extract(series, '^(.*):([0-9.]+)$', 1) ELSE series END AS series_name,
       CASE WHEN regexp_matches(series, '^.*:[0-9.]+$') THEN regexp_extract(series, '^(.*):([0-9.]+)$', 2) END AS series_pos,
       CASE WHEN status = 429 OR contains(lower(message), 'too many requests') OR contains(lower(message), 'server busy') THEN 'busy'
            WHEN contains(lower(message), '429') OR contains(lower(message), 'rate limited') THEN 'rate_limited'
            WHEN contains(lower(message), 'not found') THEN 'not_found' WHEN contains(lower(message), 'enter an isbn') THEN 'no_isbn' ELSE 'failed' END AS error,
       coalesce(nullif(trim(regexp_replace(name, '[^A-Za-z0-9 .()_-]', '_', 'g')), ''), 'output.epub') AS file_name,
       trim(media) IN ('', {", ".join(f"'{v}'" for v in P.TTF_WRONG)}) AS ttf_fix,
       upper(left(kind, 1)) || lower(substr(kind, 2)) AS capital
FROM {CODES.sql}""")
def code_maps(spark, sf):
    s = T.series("series")
    return CODES.df(spark).select(
        "id", T.language("code").alias("lang"), T.primary_subtag("code").alias("subtag"), T.landmark("kind").alias("landmark"), T.isbn("isbn").alias("isbn"), s["name"].alias("series_name"), s["position"].alias("series_pos"),
        T.error_class("message", F.col("status")).alias("error"), T.sanitize_filename("name").alias("file_name"), P.needs_ttf_type("media").alias("ttf_fix"), T.capitalize("kind").alias("capital"),
    )


@query("""
SELECT doc_id, CASE lower(lang) WHEN 'eng' THEN 'en' ELSE lower(lang) END AS lang, lower(regexp_extract(lang, '^[^-_]*')) AS subtag FROM documents""")
def lang_map(spark, sf):
    return table(spark, sf, "documents").select("doc_id", T.language(F.col("lang")).alias("lang"), T.primary_subtag("lang").alias("subtag"))


CLIENTS = Literals("id, forwarded, peer, saved, wanted, shown, iso, lang", """
 (1, '10.0.0.1, 1.2.3.4', '9.9.9.9', 'tr', 'en-GB', '1.2.2024', '2024-02-01', 'de'), (2, 'unknown', '9.9.9.9', 'xx', 'de-AT', '2024/12/3', '2024-12-03', 'ja'),
 (3, '256.1.1.1', '8.8.8.8', NULL, 'xx', 'May 2024', 'n.d.', 'en'), (4, NULL, '7.7.7.7', NULL, 'ko', '31;1;1999', '1999-1-31', 'zh'), (5, ' 2001.0.0.1 ', 'p', 'en', 'fr', '1-2-24', '0001-01-01', 'ko')""")  # fmt: skip
_KNOWN = ("en", "tr", "de", "fr", "ko")


@query(f"""
WITH c AS (SELECT *, trim(string_split(coalesce(forwarded, ''), ',')[1]) AS first, string_split(wanted, '-')[1] AS want FROM {CLIENTS.sql})
SELECT id, CASE WHEN regexp_matches(first, '^((25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])[.]){{3}}(25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])$') THEN first ELSE peer END AS ip,
       CASE WHEN saved IN {_listed(_KNOWN)} THEN saved WHEN want IN {_listed(_KNOWN)} THEN want ELSE 'en' END AS ui,
       CASE WHEN regexp_matches(shown, '^[0-9]{{1,2}}[./;-][0-9]{{1,2}}[./;-][0-9]{{4}}$') THEN regexp_extract(shown, '[0-9]{{4}}$') || '-' || lpad(regexp_extract(shown, '^[0-9]+[./;-]([0-9]+)', 1), 2, '0') || '-' || lpad(regexp_extract(shown, '^[0-9]+'), 2, '0')
            WHEN regexp_matches(shown, '^[0-9]{{4}}[./;-][0-9]{{1,2}}[./;-][0-9]{{1,2}}$') THEN regexp_extract(shown, '^[0-9]{{4}}') || '-' || lpad(regexp_extract(shown, '^[0-9]+[./;-]([0-9]+)', 1), 2, '0') || '-' || lpad(regexp_extract(shown, '[0-9]+$'), 2, '0')
            ELSE shown END AS iso_date,
       CASE WHEN NOT regexp_matches(iso, '^[0-9]{{4}}-[0-9]{{2}}-[0-9]{{2}}$') THEN iso WHEN lang IN ('ja', 'ko', 'zh') THEN replace(iso, '-', '.')
            ELSE substr(iso, 9, 2) || '.' || substr(iso, 6, 2) || '.' || left(iso, 4) END AS shown_date
FROM c""")
def client_scalars(spark, sf):
    return CLIENTS.df(spark).select("id", T.client_ip("forwarded", "peer").alias("ip"), T.ui_language("saved", F.array("wanted"), list(_KNOWN)).alias("ui"), T.iso_date("shown").alias("iso_date"), T.display_date("iso", "lang").alias("shown_date"))


@query("""
SELECT doc_id, length(regexp_replace(text, '[\\s\\x{85}\\x{A0}\\x{1680}\\x{2000}-\\x{200A}\\x{2028}\\x{2029}\\x{202F}\\x{205F}\\x{3000}\\x{0B}]', '', 'g'))::BIGINT AS solid, length(regexp_replace(text, '[^\\p{L}]', '', 'g'))::BIGINT AS letters,
       NOT (solid >= 50 AND letters::FLOAT < solid::FLOAT * 0.45::FLOAT) AS passes
FROM documents""")
def quality_gate(spark, sf):
    docs = table(spark, sf, "documents")
    solid = F.length(F.regexp_replace("text", "(?U)\\s", ""))
    return docs.select("doc_id", solid.cast("long").alias("solid"), P.count_of("text", "\\p{IsAlphabetic}").cast("long").alias("letters"), P.passes_letter_gate("text").alias("passes"))


@query("""
SELECT doc_id, sha256(text) AS sha256, length(text)::BIGINT AS n_chars, replace(replace(replace(replace(regexp_replace(text, '[\\x00-\\x08\\x0B\\x0C\\x0E-\\x1F]', '', 'g'), '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '"', '&quot;') AS escaped,
       CASE WHEN length(text) > 300 THEN left(text, 300) || '…' ELSE text END AS clipped
FROM documents""")
def text_scalars(spark, sf):
    return table(spark, sf, "documents").select("doc_id", F.sha2("text", 256).alias("sha256"), F.length("text").cast("long").alias("n_chars"), T.xml_escape("text").alias("escaped"), T.clipped("text", 300).alias("clipped"))


@query("""
SELECT l_orderkey, l_linenumber, format('{:,}', round(l_extendedprice)::BIGINT) AS whole, format('{:,.1f}', round(l_extendedprice, 1)) AS one,
       CASE WHEN l_extendedprice > 0 THEN (l_extendedprice - l_quantity) / l_extendedprice * 100.0 ELSE 0.0 END AS saved,
       greatest(least(l_quantity, 40.0), 5.0) AS clamped, coalesce(l_quantity * 100.0 / nullif(l_tax, 0), 0.0) AS share,
       strftime(l_shipdate, '%Y-%m-%dT%H:%M:%SZ') AS stamp
FROM lineitem""")
def number_scalars(spark, sf):
    li = table(spark, sf, "lineitem")
    whole = F.floor(F.col("l_extendedprice") + 0.5).cast("long")
    return li.select(
        "l_orderkey", "l_linenumber", N.commas(whole).alias("whole"), N.commas1("l_extendedprice").alias("one"), N.saved_percent("l_extendedprice", "l_quantity").alias("saved"),
        N.clamp("l_quantity", 5.0, 40.0).alias("clamped"), N.percent("l_quantity", "l_tax").alias("share"), N.utc_stamp("l_shipdate").alias("stamp"),
    )


@query("""
SELECT p_partkey, p_size, greatest(least((0.017529::FLOAT * q * q - 1.70862::FLOAT * q + 95.783::FLOAT)::FLOAT, 100.0), 1.0)::DOUBLE AS avif,
       greatest(least((-0.000494::FLOAT * w * w + 0.01808::FLOAT * w + 3.639::FLOAT)::FLOAT, 15.0), 0.4)::DOUBLE AS jxl
FROM (SELECT *, greatest(least(p_size + 40, 95), 45)::FLOAT AS q, (p_size + 40)::FLOAT AS w FROM part)""")
def calibrated_quality(spark, sf):
    q = F.col("p_size") + 40
    return table(spark, sf, "part").select("p_partkey", "p_size", N.avif_quality(q).cast("double").alias("avif"), N.jxl_distance(q).cast("double").alias("jxl"))


@query()
def slugify(spark, sf):
    first = F.split("text", "\n")[0]
    return table(spark, sf, "documents").select("doc_id", T.slugify(first).alias("slug"), T.output_name(T.slugify(first)).alias("output"))


#: The 32-bit cyclic redundancy check by its definition: a table of the reversed polynomial, a step a byte.
_CRC_TABLE = "list_transform(range(256), lambda c: list_reduce(list_prepend(c, [0, 0, 0, 0, 0, 0, 0, 0]), lambda a, z: CASE WHEN a & 1 = 1 THEN xor(a >> 1, 3988292384) ELSE a >> 1 END))"


@query(f"""WITH t AS (SELECT {_CRC_TABLE} AS steps),
h AS (SELECT doc_id, hex(encode(text)) AS h FROM documents),
b AS (SELECT doc_id, h, list_transform(range(1, length(h), 2), lambda i: ('0x' || substr(h, i, 2))::BIGINT) AS bytes FROM h),
c AS (SELECT doc_id, xor(list_reduce(list_prepend(4294967295, bytes), lambda a, x: xor(a >> 8, steps[(xor(a, x) & 255) + 1])), 4294967295) AS crc FROM b, t)
SELECT doc_id, lpad(printf('%x', crc), 8, '0') AS crc32, false AS changed_passes FROM c""")
def crc_integrity(spark, sf):
    from quire.operators.archive import intact

    docs = table(spark, sf, "documents")
    return docs.select("doc_id", N.crc32_hex("text").alias("crc32"), intact(F.concat("text", F.lit("x")), N.crc32_hex("text")).alias("changed_passes"))


MATRICES = Literals("id, a, b, c, d, e, f, size, advance", """
 (1, 1.0, 0.0, 0.0, 1.0, 0.0, 0.0, 12.0, 2.5), (2, 0.5, 0.25, -0.25, 0.5, 10.0, 20.0, 10.0, 1.0), (3, 0.0, 1.0, -1.0, 0.0, 5.0, -5.0, 8.0, 0.0)""")  # fmt: skip


@query(f"""
SELECT id, sqrt(a * a + b * b) * advance * size AS width, sqrt(c * c + d * d) * size AS font, a * 3 + c * 4 + e AS x, b * 3 + d * 4 + f AS y
FROM (SELECT id, a::DOUBLE AS a, b::DOUBLE AS b, c::DOUBLE AS c, d::DOUBLE AS d, e::DOUBLE AS e, f::DOUBLE AS f, size::DOUBLE AS size, advance::DOUBLE AS advance FROM {MATRICES.sql})""")
def matrix_geometry(spark, sf):
    m = F.array(*(F.col(x).cast("double") for x in "abcdef"))
    to = N.moved(m, F.lit(3.0), F.lit(4.0))
    return MATRICES.df(spark).select("id", N.run_width(F.col("advance").cast("double"), F.col("size").cast("double"), m).alias("width"), N.run_size(F.col("size").cast("double"), m).alias("font"), to[4].alias("x"), to[5].alias("y"))
