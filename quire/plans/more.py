"""Queries of operators that the other modules leave out: whole tables as paths, containers, packages, figures and streams of drawing operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from quire.functions import numbers as N
from quire.functions import predicates as P
from quire.functions import text as T
from quire.operators import archive as A
from quire.operators import geometry as G
from quire.operators import lookup as L
from quire.operators import markup as M
from quire.operators import modernize
from quire.operators import package as K
from quire.operators import selection as S
from quire.sources import containers as C

from .base import query, table
from .books import _ENTRIES, _SENTENCES, _WS, _entries
from .scalars import _EXT, _NAME, _NAMED, _PATHS, _listed, _paths

_PLAIN = "translate(coalesce(text, ''), '<>&', '   ')"
_STEM = f"regexp_replace({_NAME}, '^(.+)\\.[^.]*$', '\\1', 's')"
_IMAGE = "regexp_replace(regexp_replace(path, '^.*[/\\\\]', '', 's'), '[^A-Za-z0-9._-]', '_', 'g')"


@query(f"""
WITH p AS (SELECT id, path, {_STEM} AS stem, {_NAME} AS name FROM {_PATHS})
SELECT id, stem, CASE WHEN contains(path, '/') THEN regexp_replace(path, '/?[^/]*$', '') ELSE '.' END || '/' || stem || '.json' AS beside,
       stem || '_decoded.epub' AS decoded, stem || '_v3.4.epub' AS output, stem || '_v3.3.kepub.epub' AS kepub, stem || '_zstd-experimental.epub' AS packed,
       replace(path, '/', chr(92)) AS windows, CASE WHEN {_IMAGE} = '' THEN 'image' ELSE {_IMAGE} END AS image_id,
       path <> 'mimetype' AND {_EXT} IN {_listed(P.TEXTS)} AND path <> '{P.DICTIONARY}' AS in_dictionary,
       {_NAMED} = 'md' AS markdown, starts_with(path, '/') OR regexp_matches(path, '(^|/)\\.\\.(/|$)') OR regexp_matches(path, '^[A-Za-z]:') AS escapes
FROM p""")
def path_variants(spark, sf):
    p = F.col("path")
    windows = F.replace(p, F.lit("/"), F.lit("\\"))
    return _paths(spark, sf).select(
        "id", T.stem(p).alias("stem"), T.sibling(p, "json").alias("beside"), T.decoded_name(T.basename(p)).alias("decoded"),
        T.output_name(T.stem(p), "3.4").alias("output"), T.output_name(T.stem(p), kepub=True).alias("kepub"), T.output_name(T.stem(p), packed=True).alias("packed"),
        F.replace(T.backslashes(windows), F.lit("/"), F.lit("\\")).alias("windows"), T.sanitize_image_id(windows).alias("image_id"), P.is_dictionary_text(p).alias("in_dictionary"),
        P.has_extension(p, "MD").alias("markdown"), P.escapes(p).alias("escapes"),
    )


@query(f"""
SELECT id, CASE WHEN starts_with(path, 'https://') THEN coalesce(nullif(regexp_extract(path, '^https://[^/]*(/.*)$', 1), ''), '/') END AS path,
       CASE WHEN starts_with(path, 'https://') THEN path WHEN starts_with(path, 'http://') THEN 'https://' || substr(path, 8)
            WHEN starts_with(path, '/') THEN 'https://a.example' || path ELSE 'https://a.example/' || path END AS leads_to,
       CASE WHEN id % 2 = 0 THEN 'https://a.example' || regexp_extract(path, '^https?://[^/]*(/.*)$', 1) END AS within
FROM {_PATHS}""")
def link_targets(spark, sf):
    p = F.col("path")
    inner = F.regexp_extract(p, "^https?://[^/]*(/.*)$", 1)
    within = F.when(F.col("id") % 2 == 0, F.when(inner != "", T.redirect(F.lit("a.example"), inner)).otherwise("https://a.example"))
    return _paths(spark, sf).select("id", T.https_path(p).alias("path"), T.redirect(F.lit("a.example"), p).alias("leads_to"), within.alias("within"))


_WORDS = "string_split(regexp_replace(trim(text), '\\s+', ' ', 'g'), ' ')"


@query(f"""
WITH d AS (SELECT doc_id, source, lang, coalesce(text, '') AS text FROM documents),
l AS (SELECT *, list_filter(list_transform(regexp_split_to_array(text, '\\r?\\n'), lambda x: regexp_replace(x, '^\\s+|\\s+$', '', 'g')), lambda x: x <> '') AS ls, {_WORDS} AS w FROM d)
SELECT doc_id, to_json(text)::VARCHAR AS json, len(ls)::INT AS n_lines, ls[1] AS first_line, md5(array_to_string(ls, chr(10))) AS lines_md5,
       nullif(regexp_replace(text, '^\\s+|\\s+$', '', 'g'), '') AS trimmed, lang AS local,
       CASE WHEN contains(w[1], ',') OR contains(w[2], ',') OR w[1] = '' OR w[2] IS NULL THEN NULL ELSE w[2] || ' ' || w[1] END AS author,
       CASE WHEN doc_id % 3 = 0 THEN source ELSE source || ':' || (doc_id % 3) || '.5' END AS series, doc_id % 4 < 3 AS flag
FROM l""")
def text_variants(spark, sf):
    d = table(spark, sf, "documents").withColumn("text", F.coalesce("text", F.lit("")))
    w = F.split(T.collapse("text"), " ")
    first, second = F.get(w, 0), F.get(w, 1)
    plain = (first != "") & second.isNotNull() & ~first.contains(",") & ~second.contains(",")
    kept = T.lines("text")
    position = F.when(F.col("doc_id") % 3 != 0, F.concat((F.col("doc_id") % 3).cast("string"), F.lit(".5")))
    said = F.element_at(F.array(*map(F.lit, ("true", " on ", "1", "off"))), (F.col("doc_id") % 4 + 1).cast("int"))
    return d.select(
        "doc_id", T.json_string("text").alias("json"), F.coalesce(F.size(kept), F.lit(0)).alias("n_lines"), F.get(kept, 0).alias("first_line"), F.md5(F.coalesce(F.array_join(kept, "\n"), F.lit(""))).alias("lines_md5"),
        T.non_blank("text").alias("trimmed"), T.local_name(F.concat(F.lit("dc:"), "lang")).alias("local"), F.when(plain, T.author_display(F.concat(first, F.lit(", "), second))).alias("author"),
        T.series_display("source", position).alias("series"), P.is_on(said).alias("flag"),
    )


@query("""
SELECT doc_id, ('0x' || printf('%x', doc_id))::BIGINT AS code, chr((65 + doc_id % 26)::INT) || chr((1072 + doc_id % 32)::INT) AS text, NULL::VARCHAR AS odd
FROM documents""")
def hex_codes(spark, sf):
    d = table(spark, sf, "documents").select("doc_id")
    latin, cyrillic = F.hex(65 + F.col("doc_id") % 26), F.hex(1072 + F.col("doc_id") % 32)
    units = F.concat(F.lpad(latin, 4, "0"), F.lpad(cyrillic, 4, "0"))
    return d.select("doc_id", N.hex_code(F.lower(F.hex("doc_id"))).alias("code"), N.hex_text(units).alias("text"), N.hex_text(F.concat(units, F.lit("0"))).alias("odd"))


_HOST = "regexp_extract(url, '//([^/]*)', 1)"


@query(f"""
WITH p AS (SELECT {_HOST} AS book_id, page_id AS ord, url AS path, len(string_split(url, '/')) AS depth FROM pages)
SELECT book_id, arg_min(path, ord) AS first, arg_min(path, (depth, ord)) AS shallowest FROM p GROUP BY book_id""")
def first_choices(spark, sf):
    p = table(spark, sf, "pages").select(F.regexp_extract("url", "//([^/]*)", 1).alias("book_id"), F.col("page_id").alias("ord"), F.col("url").alias("path"))
    first = S.first_of(p, "book_id", "ord").select("book_id", F.col("path").alias("first"))
    return first.join(S.shallowest(p, "book_id").withColumnRenamed("path", "shallowest"), "book_id")


@query("""
WITH t AS (SELECT doc_id, ['image/jpeg', 'image/jpg', 'image/png', 'image/gif', 'text/css'][doc_id % 5 + 1] AS media, ['uuid', 'ISBN', 'doi'][doc_id % 3 + 1] AS scheme,
                  ['urn:isbn:' || doc_id, 'URN:ISBN:' || doc_id, 'urn:uuid:' || doc_id, 'x'][doc_id % 4 + 1] AS value FROM documents)
SELECT doc_id, doc_id % 5 < 3 AS raster, lower(scheme) = 'isbn' OR contains(lower(value), 'isbn') AS isbn, doc_id % 7 = 0 OR doc_id % 11 = 0 AS cover,
       CASE doc_id % 4 WHEN 0 THEN 1 WHEN 1 THEN 3 WHEN 2 THEN CASE WHEN doc_id % 6 IN (1, 3) THEN doc_id % 6 END END::INT AS channels
FROM t""")
def item_flags(spark, sf):
    d = F.col("doc_id")
    pick = lambda values, n: F.element_at(F.array(*values), (d % n + 1).cast("int"))
    name = d.cast("string")
    media = pick([F.lit(x) for x in ("image/jpeg", "image/jpg", "image/png", "image/gif", "text/css")], 5)
    scheme = pick([F.lit(x) for x in ("uuid", "ISBN", "doi")], 3)
    value = pick([F.concat(F.lit("urn:isbn:"), name), F.concat(F.lit("URN:ISBN:"), name), F.concat(F.lit("urn:uuid:"), name), F.lit("x")], 4)
    item = F.when(d % 7 == 0, F.lit("c")).otherwise(name)
    href = F.when(d % 11 == 0, F.concat(F.lit("images/COVER"), name)).otherwise(F.lit("images/x"))
    space = pick([F.lit(x) for x in ("DeviceGray", "DeviceRGB", "ICCBased", "Indexed")], 4)
    return table(spark, sf, "documents").select("doc_id", P.is_raster(media).alias("raster"), P.has_isbn(F.lit(None).cast("string"), F.array(F.struct(value.alias("value"), scheme.alias("scheme")))).alias("isbn"), P.is_cover_item(item, href, F.lit("c")).alias("cover"), N.components(space, (d % 6).cast("int")).alias("channels"))



def _package(page_id):
    """A package document of as many navigation files as the page's number says, the last of which counts."""
    name = page_id.cast("string")
    items = F.transform(F.sequence(F.lit(0).cast("long"), page_id % 3), lambda k: F.format_string('<item id="n%d" href="n%d.ncx" media-type="application/x-dtbncx+xml"/>', k, k))
    nav = F.when(page_id % 2 == 0, '<item id="v" href="v.xhtml" media-type="application/xhtml+xml" properties="scripted nav"/>').otherwise("")
    head = F.concat(F.lit('<package version="'), F.when(page_id % 2 == 0, "3.0").otherwise("2.0"), F.lit('" unique-identifier="u'), name, F.lit('"><metadata xmlns:dc="http://purl.org/dc/elements/1.1/"><dc:title id="t">T'), name, F.lit('</dc:title><meta name="cover" content="c'), name, F.lit('"/></metadata>'))
    guide = F.when(page_id % 5 == 0, '<guide><reference type="toc" href="t" title="x"/></guide>').otherwise("")
    return F.concat(head, F.lit("<manifest>"), F.array_join(items, ""), nav, F.lit("</manifest>"), guide, F.lit("</package>"))


_TOLD = "CASE WHEN page_id % 2 = 0 THEN '3.0' ELSE '2.0' END AS version, 'u' || page_id AS unique_identifier, 'c' || page_id AS cover_id, page_id % 2 = 0 AS nav_exists, 'n' || (page_id % 3) || '.ncx' AS ncx_href, page_id % 5 = 0 AS has_guide, (page_id % 3 + 1 + CASE WHEN page_id % 2 = 0 THEN 1 ELSE 0 END)::INT AS items, 'T' || page_id AS title"


@query(f"SELECT page_id, {_TOLD} FROM pages")
def package_info(spark, sf):
    p = table(spark, sf, "pages").select("page_id", K.info(_package(F.col("page_id"))).alias("x"))
    return p.select("page_id", "x.version", "x.unique_identifier", "x.cover_id", "x.nav_exists", "x.ncx_href", "x.has_guide", F.size("x.items").alias("items"), F.col("x.elements")[0]["text"].alias("title"))


@query(f"SELECT page_id::VARCHAR AS book_id, 'OEBPS/p' || page_id || '.opf' AS path, {_TOLD}, coalesce(octet_length(encode(html)), 0)::INT AS page_bytes FROM pages")
def container_packages(spark, sf):
    """Containers written and scanned again: the package that each names is found and read, and one entry is looked up."""
    found = C.read(A.containers(_books(spark, sf)))
    told = C.packages(found).select("book_id", "path", K.info("xml").alias("x"))
    page = C.entry(found, "page.html").select("book_id", F.octet_length("data").alias("page_bytes"))
    out = told.join(page, "book_id")
    return out.select("book_id", "path", "x.version", "x.unique_identifier", "x.cover_id", "x.nav_exists", "x.ncx_href", "x.has_guide", F.size("x.items").alias("items"), F.col("x.elements")[0]["text"].alias("title"), "page_bytes")


def _books(spark, sf):
    """Entries of a book for each page: what names the package, a decoy, the package, the page."""
    p = table(spark, sf, "pages").select("page_id", F.coalesce("html", F.lit("")).alias("html"))
    name = F.col("page_id").cast("string")
    path = F.concat(F.lit("OEBPS/p"), name, F.lit(".opf"))
    root = F.concat(F.lit('<container xmlns="urn:oasis:names:tc:opendocument:xmlns:container"><rootfiles><rootfile full-path="'), path, F.lit('" media-type="application/oebps-package+xml"/></rootfiles></container>'))
    parts = F.array(*(F.struct(F.lit(i).cast("long").alias("ord"), n.alias("path"), d.cast("binary").alias("data")) for i, (n, d) in enumerate(((F.lit(K.CONTAINER), root), (F.lit("a.opf"), F.lit("<package/>")), (path, _package(F.col("page_id"))), (F.lit("page.html"), F.col("html"))))))
    return p.select(name.alias("book_id"), F.explode(parts).alias("x")).select("book_id", "x.*")


@query(f"""WITH {_ENTRIES} SELECT book_id, count(*) AS entries, count(*) FILTER (ord % 4 = 0) AS changed, sum(CASE WHEN ord % 4 = 0 THEN 3 ELSE size END)::BIGINT AS bytes FROM e GROUP BY book_id""")
def container_replace(spark, sf):
    """Containers written with some entries replaced, and scanned again."""
    entries = _entries(spark, sf)
    new = entries.where(F.col("ord") % 4 == 0).select("book_id", "path", F.lit("new").cast("binary").alias("new_data"))
    back = C.read(A.containers(A.replaced(entries, new))).where("path <> 'mimetype'")
    size = F.octet_length("data")
    return back.groupBy("book_id").agg(F.count(F.lit(1)).alias("entries"), F.count_if(F.decode("data", "UTF-8") == "new").alias("changed"), F.sum(size).cast("long").alias("bytes"))


@query("""
WITH s AS (SELECT source AS book_id, (doc_id % 50)::INT AS page_num, octet_length(encode(coalesce(text, ''))) AS n, doc_id FROM documents)
SELECT book_id, page_num, sum(CASE WHEN doc_id % 5 < 4 THEN n + CASE WHEN doc_id % 5 = 3 THEN 2 ELSE 0 END ELSE 0 END)::BIGINT AS shown_bytes FROM s GROUP BY ALL""")
def shown_bytes(spark, sf):
    """Every text is what one operator shows: Tj, ', " and TJ (with a second string) count, others don't."""
    d = F.col("doc_id")
    op = F.element_at(F.array(*map(F.lit, ("Tj", "'", '"', "TJ", "Td"))), (d % 5 + 1).cast("int"))
    own = F.coalesce("text", F.lit("")).cast("binary")
    strings = F.when(op == "TJ", F.array(own, F.lit(b"ab"))).otherwise(F.array(own))
    operators = table(spark, sf, "documents").select(F.col("source").alias("book_id"), (d % 50).cast("int").alias("page_num"), op.alias("op"), strings.alias("strings"))
    return G.shown_bytes(operators)


@query("""
SELECT page_id, printf('%04X', page_id % 4096) AS code, chr((65 + page_id % 26)::INT) AS single, 3::INT AS ranged, chr((946 + page_id % 10)::INT) AS second, 2::INT AS code_len
FROM pages""")
def glyph_maps(spark, sf):
    """A character map for each page: one code by itself, a range of three from a letter on."""
    i = F.col("page_id")
    code = F.format_string("%04X", i % 4096)
    start = F.format_string("%04X", 8192 + i % 4096)
    end = F.format_string("%04X", 8194 + i % 4096)
    cmap = F.concat(F.lit("1 beginbfchar\n<"), code, F.lit("> <"), F.format_string("%04X", 65 + i % 26), F.lit(">\nendbfchar\n1 beginbfrange\n<"), start, F.lit("> <"), end, F.lit("> <"), F.format_string("%04X", 945 + i % 10), F.lit(">\nendbfrange\n"))
    found = table(spark, sf, "pages").select("page_id", code.alias("code"), G.glyph_map(cmap.cast("binary")).alias("x"))
    at = F.conv("code", 16, 10).cast("int")
    return found.select("page_id", "code", F.element_at("x.map", at).alias("single"), (F.size("x.map") - 1).alias("ranged"), F.element_at("x.map", F.lit(8193) + (i % 4096).cast("int")).alias("second"), F.col("x.code_len").alias("code_len"))


@query("""
SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN 'jpeg' WHEN 1 THEN CASE WHEN doc_id % 3 = 0 THEN NULL ELSE 'png' END WHEN 2 THEN 'jpeg' END AS kind FROM documents""")
def figure_kinds(spark, sf):
    d = F.col("doc_id")
    filters = F.when(d % 4 == 0, F.array(F.lit("DCTDecode"))).when(d % 4 == 1, F.array(F.lit("FlateDecode"))).when(d % 4 == 2, F.array(F.lit("FlateDecode"), F.lit("DCTDecode"))).otherwise(F.array(F.lit("JPXDecode")))
    return table(spark, sf, "documents").select("doc_id", G.figure_kind(filters, F.when(d % 3 == 0, 1).otherwise(8), F.lit("DeviceRGB")).alias("kind"))


@query("""
WITH n AS (SELECT doc_id, doc_id // 8 AS tree, doc_id % 8 AS k FROM documents), m AS (SELECT tree, max(CASE WHEN k % 4 = 0 THEN 1 ELSE 0 END) AS x, list(k) AS ks FROM n GROUP BY tree)
SELECT n.tree::VARCHAR AS book_id, n.k AS node_id, 'v' || (k - k % 4) AS value FROM n JOIN m USING (tree)
WHERE len(list_filter(range(k - k % 4, k + 1), lambda v: list_contains(ks, v))) = k % 4 + 1""")
def inherited_values(spark, sf):
    """Chains of four nodes: the first has a value, each other asks the one before it."""
    d = F.col("doc_id")
    k = d % 8
    nodes = table(spark, sf, "documents").select(F.floor(d / 8).cast("string").alias("book_id"), k.alias("node_id"), F.when(k % 4 != 0, k - 1).alias("parent_id"), F.when(k % 4 == 0, F.concat(F.lit("v"), k.cast("string"))).alias("value"))
    return G.inherited(nodes)


@query("""
SELECT event_type AS level, count(*) AS n, count(value) FILTER (value < 50) AS measured, avg(value) FILTER (value < 50) AS mean,
       coalesce(sum(event_id) FILTER (value < 50), 0) / 1024.0 AS kilobytes FROM events GROUP BY event_type""")
def success_means(spark, sf):
    """Values from 50 on count as failures."""
    rows = table(spark, sf, "events").select(F.col("event_type").alias("level"), F.when(F.col("value") < 50, F.col("value")).alias("score"), F.col("event_id").alias("bytes"))
    return S.success_means(rows, "level", "score", "bytes")


@query("""
SELECT l_returnflag || l_linestatus AS codec, count(*) AS files, sum(l_orderkey)::BIGINT AS original, sum(l_partkey)::BIGINT AS packed, sum(l_partkey) / sum(l_orderkey)::DOUBLE AS ratio,
       bool_and(l_linenumber > 0) AS lossless FROM lineitem GROUP BY ALL""")
def codec_totals(spark, sf):
    rows = table(spark, sf, "lineitem").select(F.concat("l_returnflag", "l_linestatus").alias("codec"), F.col("l_orderkey").alias("original"), F.col("l_partkey").alias("packed"), (F.col("l_linenumber") > 0).alias("same"))
    return S.codec_totals(rows)


@query("""
WITH e AS (SELECT doc_id, source, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS n FROM documents)
SELECT source AS book_id, doc_id, 'img' || lpad(n::VARCHAR, greatest(3, length(n::VARCHAR))::INT, '0') AS name FROM e""")
def sequence_names(spark, sf):
    return S.named(table(spark, sf, "documents").select(F.col("source").alias("book_id"), "doc_id"), "book_id", "doc_id", "img")


@query("""
SELECT page_id, array_to_string(list_sort(map_keys(m)), ',') AS keys, array_to_string(list_transform(list_sort(map_keys(m)), lambda k: m[k]), ',') AS vals
FROM (SELECT page_id, CASE WHEN page_id % 2 = 0 THEN map(['href', 'id', 'media-type', 'properties'], ['new' || page_id, 'i' || page_id, 'image/webp', 'old'])
                           ELSE map(['href', 'id', 'media-type', 'properties'], ['new' || page_id, 'i' || page_id, 'image/webp', 'cover-image']) END AS m FROM pages)""")
def attribute_overrides(spark, sf):
    i = F.col("page_id").cast("string")
    base = F.when(F.col("page_id") % 2 == 0, F.create_map(F.lit("id"), F.concat(F.lit("i"), i), F.lit("href"), F.lit("old"), F.lit("properties"), F.lit("old"))).otherwise(F.create_map(F.lit("id"), F.concat(F.lit("i"), i), F.lit("href"), F.lit("old")))
    over = F.create_map(F.lit("href"), F.concat(F.lit("new"), i), F.lit("media-type"), F.lit("image/webp"))
    found = table(spark, sf, "pages").select("page_id", base.alias("base"), over.alias("over")).select("page_id", K.overridden("base", "over", F.create_map(F.lit("properties"), F.lit("cover-image"))).alias("m"))
    keys = F.array_sort(F.map_keys("m"))
    return found.select("page_id", F.array_join(keys, ",").alias("keys"), F.array_join(F.transform(keys, lambda k: F.col("m")[k]), ",").alias("vals"))


@query("""
SELECT page_id::VARCHAR AS book_id, '3.0' AS version, false AS has_guide, 'T' || page_id AS title, 4 AS entries,
       md5(CASE WHEN contains(h, 'xmlns="http://www.w3.org/1999/xhtml"') THEN h ELSE replace(h, '<html', '<html xmlns="http://www.w3.org/1999/xhtml"') END) AS page_md5
FROM (SELECT page_id, regexp_replace(coalesce(html, ''), '<!DOCTYPE\\s+html[^>]*>', '<!DOCTYPE html>', 'gi') AS h FROM pages)""")
def modernized_books(spark, sf):
    """A book for each page, made anew: its package, and its page as a document."""
    new, _, _ = modernize.modernized(_books(spark, sf), modernize.Options())
    xml = F.max(F.when(F.col("path").startswith("OEBPS/p"), F.decode("data", "UTF-8"))).alias("xml")
    page = F.max(F.when(F.col("path") == "page.html", F.md5("data"))).alias("page_md5")
    told = new.groupBy("book_id").agg(F.count(F.lit(1)).cast("int").alias("entries"), xml, page).withColumn("x", K.info("xml"))
    return told.select("book_id", "x.version", "x.has_guide", F.filter("x.elements", lambda e: e["tag"] == "title")[0]["text"].alias("title"), "entries", "page_md5")


@query("""
SELECT page_id::VARCHAR AS book_id, 'N' || page_id AS title, CASE WHEN page_id % 2 = 0 THEN 'A' || page_id || '|B' ELSE '' END AS creators,
       'c' || page_id AS cover_id, (2 + CASE WHEN page_id % 2 = 0 THEN 6 ELSE 0 END + 1 + 1)::INT AS elements
FROM pages""")
def updated_packages(spark, sf):
    """Every package gets a new title, every second one two authors; what was there stays but for the title."""
    from quire.operators import metadata

    books = modernize.books(_books(spark, sf))
    name, even = F.col("book_id"), F.col("book_id").cast("long") % 2 == 0
    empty = [F.lit(None).cast("string").alias(c) for c in ("subtitle", "language", "publisher", "date", "description", "isbn")]
    updates = books.select("book_id", F.concat(F.lit("N"), name).alias("title"), F.when(even, F.array(F.concat(F.lit("A"), name), F.lit("B"))).alias("authors"), F.lit(None).cast("array<string>").alias("subjects"), F.lit(None).cast("struct<name:string,position:string>").alias("series"), *empty)
    told = metadata.updated(books, updates, "2000-01-01T00:00:00Z").select("book_id", K.info("xml").alias("x"))
    of = lambda tag: F.array_join(F.transform(F.filter("x.elements", lambda e: e["tag"] == tag), lambda e: e["text"]), "|")
    return told.select("book_id", of("title").alias("title"), of("creator").alias("creators"), "x.cover_id", F.size("x.elements").alias("elements"))


_LINED = f"""l AS (SELECT doc_id, source, list_filter(list_transform(regexp_split_to_array(coalesce(text, ''), '\\r?\\n'), lambda x: trim(regexp_replace(x, '[{_WS}]+', ' ', 'g'))), lambda x: x <> '') AS ls FROM documents),
lines AS (SELECT source AS book_id, doc_id AS page_num, i, regexp_extract(ls[i], '^[^ ]+') AS w, regexp_extract(ls[i], '^[^ ]+ (.*)$', 1) AS rest, CASE WHEN i % 5 = 0 THEN 20.0::FLOAT ELSE 0.0::FLOAT END AS x, (-12 * i - 24 * (i // 3))::FLOAT AS y
          FROM (SELECT *, unnest(range(1, len(ls) + 1)) AS i FROM l))"""


@query(f"""WITH {_LINED},
told AS (SELECT *, CASE WHEN rest = '' THEN w ELSE w || CASE WHEN i % 2 = 0 THEN ' ' ELSE '' END || rest END AS line, lag(y) OVER (PARTITION BY book_id, page_num ORDER BY i) - y AS gap, min(x) OVER (PARTITION BY book_id, page_num) AS margin FROM lines),
medians AS (SELECT book_id, page_num, list_sort(list(gap))[count(gap) // 2 + 1] AS median FROM told WHERE gap > 0 GROUP BY ALL),
marked AS (SELECT *, gap IS NULL OR coalesce(gap > median * 1.6::FLOAT, false) OR x > margin + 10 AS opens FROM told LEFT JOIN medians USING (book_id, page_num)),
paras AS (SELECT *, sum(opens::INT) OVER (PARTITION BY book_id, page_num ORDER BY i) AS p FROM marked)
SELECT book_id, page_num::INT AS page_num, (p - 1)::INT AS seq, string_agg(line, ' ' ORDER BY i) AS text FROM paras GROUP BY book_id, page_num, p""")
def paragraph_blocks(spark, sf):
    """Lines of documents as two runs each, a little apart in height; some gaps between lines are wide, some lines are indented."""
    i, first = F.col("i"), F.regexp_extract("line", "^[^ ]+", 0)
    rest = F.regexp_extract("line", "^[^ ]+ (.*)$", 1)
    x = F.when(i % 5 == 0, 20.0).otherwise(0.0)
    y = -12.0 * i - 24.0 * F.floor(i / 3)
    end = x + F.length(first) * 5.0
    start = end + F.when(i % 2 == 0, 3.0).otherwise(1.0)
    run = lambda k, text, a, b, h: F.struct((2 * i + k).cast("int").alias("seq"), text.alias("text"), F.lit(10.0).cast("float").alias("font_size"), a.cast("float").alias("x"), b.cast("float").alias("end_x"), h.cast("float").alias("y"))
    runs = F.array(run(0, first, x, end, y), run(1, rest, start, start + 50.0, y - i % 4))
    return G.blocks(_lines(spark, sf).select("book_id", "page_num", F.inline(runs)))


def _lines(spark, sf):
    d = table(spark, sf, "documents").select(F.col("source").alias("book_id"), F.col("doc_id").cast("int").alias("page_num"), "text")
    kept = F.filter(F.transform(F.split(F.coalesce("text", F.lit("")), "\r?\n"), T.collapse), lambda t: t != "")
    return d.select("book_id", "page_num", F.posexplode(kept).alias("i", "line")).withColumn("i", F.col("i") + 1)


@query("""WITH s AS (SELECT doc_id, (doc_id % 50)::INT AS page_num, source, octet_length(encode(lang)) AS n, lang FROM documents WHERE lang IS NOT NULL AND source IS NOT NULL)
SELECT source AS book_id, doc_id::INT AS page_num, k::INT AS seq, CASE k WHEN 1 THEN 'x' || lang ELSE lang END AS text, CASE k WHEN 2 THEN 20.0 ELSE 10.0 END::FLOAT AS font_size,
       CASE k WHEN 0 THEN 100 WHEN 1 THEN 100 ELSE 200 END::FLOAT AS x, CASE k WHEN 0 THEN 100 + 5 * n WHEN 1 THEN 100 + 5 * (n + 1) + 10 ELSE 200 + 10 * n END::FLOAT AS end_x,
       CASE k WHEN 0 THEN doc_id % 700 WHEN 1 THEN doc_id % 700 - 12 ELSE 2 * (doc_id % 700) - 24 END::FLOAT AS y
FROM (SELECT *, unnest(range(3)) AS k FROM s)""")
def drawn_runs(spark, sf):
    """Every document draws its language three times: plainly, on the next line with a shifted part, and at twice the size."""
    d = table(spark, sf, "documents").where("lang IS NOT NULL AND source IS NOT NULL")
    own = F.col("lang").cast("binary")
    none, bare = F.array().cast("array<float>"), F.array().cast("array<binary>")
    numbers = lambda *v: F.array(*(F.lit(x).cast("float") for x in v))
    steps = [("BT", none, None, bare), ("Tf", numbers(10), "F", bare), ("Td", numbers(100, F.col("doc_id") % 700), None, bare), ("Tj", none, None, F.array(own)), ("TL", numbers(12), None, bare), ("T*", none, None, bare),
             ("TJ", numbers(-1000), None, F.array(F.lit(b"x"), own)), ("q", none, None, bare), ("cm", numbers(2, 0, 0, 2, 0, 0), None, bare), ("odd", none, None, bare), ("Tj", none, None, F.array(own)), ("Q", none, None, bare)]
    rows = F.array(*(F.struct(F.lit(i).alias("seq"), F.lit(op).alias("op"), n.alias("numbers"), F.lit(name).cast("string").alias("name"), s.alias("strings")) for i, (op, n, name, s) in enumerate(steps)))
    return G.runs(d.select(F.col("source").alias("book_id"), F.col("doc_id").cast("int").alias("page_num"), F.inline(rows)))


@query(f"""WITH t AS (SELECT doc_id, {_SENTENCES.replace('text', _PLAIN)} AS parts, {_PLAIN} AS plain FROM documents)
SELECT doc_id, md5('<html><head>{M.STYLE}</head><body><div id="book-columns"><div id="book-inner"><p>' || CASE WHEN regexp_matches(plain, '[^{_WS}]') THEN array_to_string(list_transform(parts, lambda s, i: '<span class="koboSpan" id="kobo.1.' || i || '">' || s || '</span>'), '') ELSE plain END
   || '</p><pre>A. B.</pre>' || '<span class="koboSpan" id="kobo.2.1"><img src="a"/></span>' || '</div></div></body></html>') AS spans_md5 FROM t""")
def paragraph_spans(spark, sf):
    """A document's text as one paragraph, before preformatted text and an image."""
    plain = F.translate(F.coalesce("text", F.lit("")), "<>&", "   ")
    page = F.concat(F.lit("<html><head></head><body><p>"), plain, F.lit('</p><pre>A. B.</pre><img src="a"/></body></html>'))
    return table(spark, sf, "documents").select("doc_id", F.md5(M.spans(page)).alias("spans_md5"))


@query("""WITH d AS (SELECT source, doc_id, row_number() OVER (PARTITION BY source ORDER BY lpad((999999999 - doc_id)::VARCHAR, 9, '0')) AS n FROM documents WHERE source IS NOT NULL)
SELECT source AS book_id, 'chapter' AS kind, n AS number, 'D' || doc_id || ' x' AS title,
       '<h1>D' || doc_id || ' <em>x</em></h1>' || chr(10) || '<ul>' || chr(10) || '<li>a' || doc_id || '</li>' || chr(10) || '<li>b</li>' || chr(10) || '</ul>' || chr(10) || '<blockquote>' || chr(10) || '<p><code>q</code></p>' || chr(10) || '</blockquote>' || chr(10) || '<p><a href="/u' || doc_id || '">l</a></p>' || chr(10) AS body
FROM d UNION ALL SELECT source, 'book', 0, 'D' || doc_id || ' x', NULL FROM d WHERE n = 1""")
def markdown_order(spark, sf):
    """Markdown files named against the order of their ids: a heading, a list, a quote and a link by reference in each."""
    d = table(spark, sf, "documents").where("source IS NOT NULL")
    name = F.col("doc_id").cast("string")
    text = F.concat(F.lit("# D"), name, F.lit(" *x*\n\n- a"), name, F.lit("\n- b\n\n> `q`\n\n[l][r]\n\n[R]: /u"), name)
    return M.markdown_books(d.select(F.col("source").alias("book_id"), F.concat(F.lpad((F.lit(999999999) - F.col("doc_id")).cast("string"), 9, "0"), F.lit(".md")).alias("path"), text.alias("text")))


_ASCII = "regexp_replace(coalesce(text, ''), '[^A-Za-z0-9.\\-_ \\t\\n\\r\\f\\x0B]', '', 'g')"


@query(f"""WITH s AS (SELECT doc_id, coalesce(nullif(trim(regexp_replace({_ASCII}, '[_ \\t\\n\\r\\f\\x0B]+', '_', 'g'), '_'), ''), 'output') AS slug FROM documents)
SELECT doc_id, md5(slug) AS slug_md5, md5(slug || '_v3.3.epub') AS output_md5 FROM s""")
def plain_slugs(spark, sf):
    """Whole texts without what isn't ASCII as file names."""
    ascii_ = F.regexp_replace(F.coalesce("text", F.lit("")), "[^\\x00-\\x7F]", "")
    return table(spark, sf, "documents").select("doc_id", F.md5(T.slugify(ascii_)).alias("slug_md5"), F.md5(T.output_name(T.slugify(ascii_))).alias("output_md5"))


@query("""WITH c AS (SELECT conv_id, count(*) AS n FROM conversations WHERE conv_id IS NOT NULL GROUP BY conv_id)
SELECT conv_id::VARCHAR AS book_id, (n + 5)::INT AS entries, (n + 2)::INT AS items, '3.0' AS version, true AS nav_exists, 'B<' || conv_id || '>' AS title,
       md5(array_to_string(list_concat(['mimetype', 'META-INF/container.xml', 'OEBPS/images/img001.png'], list_transform(range(1, n + 1), lambda i: 'OEBPS/ch' || lpad(i::VARCHAR, greatest(3, length(i::VARCHAR))::INT, '0') || '.xhtml'), ['OEBPS/nav.xhtml', 'OEBPS/content.opf']), ',')) AS paths_md5
FROM c""")
def scratch_books(spark, sf):
    """Books made from scratch out of conversations: a chapter a turn, and one image."""
    turns = table(spark, sf, "conversations").where("conv_id IS NOT NULL").select(F.col("conv_id").cast("string").alias("book_id"), "turn")
    chapters = S.named(turns, "book_id", "turn", "").select("book_id", F.col("name").cast("long").alias("number"), F.concat(F.lit("T"), "turn").alias("title"), F.lit("<p/>").alias("body"))
    books = turns.select("book_id").distinct()
    images = books.select("book_id", F.lit(1).cast("long").alias("number"), F.lit("png").alias("ext"), F.lit(b"\x89PNG").alias("data"))
    entries = M.book_entries(chapters, images, books.select("book_id", F.concat(F.lit("B<"), "book_id", F.lit(">")).alias("title"), F.lit("en").alias("language"), F.lit("2000-01-01T00:00:00Z").alias("modified")))
    xml = F.max(F.when(F.col("path").endswith(".opf"), F.decode("data", "UTF-8"))).alias("xml")
    paths = F.md5(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ord", "path"))), lambda e: e["path"]), ",")).alias("paths_md5")
    told = entries.groupBy("book_id").agg(F.count(F.lit(1)).cast("int").alias("entries"), xml, paths).withColumn("x", K.info("xml"))
    return told.select("book_id", "entries", F.size("x.items").alias("items"), "x.version", "x.nav_exists", F.filter("x.elements", lambda e: e["tag"] == "title")[0]["text"].alias("title"), "paths_md5")


@query("""SELECT c_custkey, ['a', 'a', 'b', 'b', 'b', NULL][c_custkey % 6 + 1] AS provider FROM customer""")
def provider_names(spark, sf):
    named = F.element_at(F.array(*map(F.lit, ("openlibrary", "ol", "google", "googlebooks", "google-books", "other"))), (F.col("c_custkey") % 6 + 1).cast("int"))
    return table(spark, sf, "customer").select("c_custkey", L.provider(named).alias("provider"))
