"""Queries over packages, metadata, lookups, navigation and state."""

from __future__ import annotations

from pyspark.sql import functions as F

from quire.functions import predicates as P

from quire.operators import lookup as L
from quire.operators import metadata as D
from quire.operators import nav as V
from quire.operators import package as K
from quire.streaming import state as S

from .base import Literals, query, table

_N = "CAST(NULL AS VARCHAR(99))"
ELEMENTS = Literals("book_id, ord, tag, elem_id, refines, property, name, content, scheme, role, file_as, text", f"""
 ('a', 0, 'identifier', 'uid', {_N}, {_N}, {_N}, {_N}, 'ISBN', {_N}, {_N}, '9780140328721'), ('a', 1, 'title', 't1', NULL, NULL, NULL, NULL, NULL, NULL, NULL, 'Main'),
 ('a', 2, 'meta', NULL, '#t1', 'title-type', NULL, NULL, NULL, NULL, NULL, 'main'), ('a', 3, 'title', 't2', NULL, NULL, NULL, NULL, NULL, NULL, NULL, 'Sub'),
 ('a', 4, 'meta', NULL, '##t2', 'title-type', NULL, NULL, NULL, NULL, NULL, 'subtitle'), ('a', 5, 'creator', 'c1', NULL, NULL, NULL, NULL, NULL, 'edt', 'X, Y', 'Y X'),
 ('a', 6, 'meta', NULL, '#c1', 'role', NULL, NULL, NULL, NULL, NULL, 'aut'), ('a', 7, 'meta', NULL, '#c1', 'role', NULL, NULL, NULL, NULL, NULL, 'trl'),
 ('a', 8, 'language', NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, 'tr'), ('a', 9, 'subject', NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, 'S1'),
 ('a', 10, 'subject', NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, 'S2'), ('a', 11, 'meta', 'k1', NULL, 'belongs-to-collection', NULL, NULL, NULL, NULL, NULL, 'A set'),
 ('a', 12, 'meta', NULL, '#k1', 'collection-type', NULL, NULL, NULL, NULL, NULL, 'set'), ('a', 13, 'meta', 'k2', NULL, 'belongs-to-collection', NULL, NULL, NULL, NULL, NULL, 'A series'),
 ('a', 14, 'meta', NULL, '#k2', 'group-position', NULL, NULL, NULL, NULL, NULL, '2'), ('a', 15, 'meta', NULL, NULL, 'dcterms:modified', NULL, NULL, NULL, NULL, NULL, '2020-01-01T00:00:00Z'),
 ('b', 0, 'title', NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, 'Old'), ('b', 1, 'meta', NULL, NULL, NULL, 'calibre:series', 'First', NULL, NULL, NULL, NULL),
 ('b', 2, 'meta', NULL, NULL, NULL, 'calibre:series', 'Last', NULL, NULL, NULL, NULL), ('b', 3, 'meta', NULL, NULL, NULL, 'calibre:series_index', '3', NULL, NULL, NULL, NULL),
 ('b', 4, 'source', 'src', NULL, NULL, NULL, NULL, NULL, NULL, NULL, 'urn:isbn:123'), ('b', 5, 'meta', NULL, '#src', 'source-of', NULL, NULL, NULL, NULL, NULL, 'PageBreak'),
 ('b', 6, 'identifier', 'gen-isbn', NULL, NULL, NULL, NULL, NULL, NULL, NULL, 'urn:isbn:1'), ('c', 0, 'meta', NULL, NULL, 'pageBreakSource', NULL, NULL, NULL, NULL, NULL, 'x')""")  # fmt: skip
PACKAGES = Literals("book_id, version, unique_identifier", "('a', '3.0', 'uid'), ('b', '2.0', ''), ('c', '3.0', 'none'), ('d', '2.0', '')")

_REFINES = f"""el AS {ELEMENTS.sql},
ref AS (SELECT book_id, regexp_replace(refines, '^#+', '') AS elem_id, property, min_by(text, ord) AS value FROM el WHERE tag = 'meta' AND refines IS NOT NULL AND property IS NOT NULL AND text IS NOT NULL GROUP BY ALL)"""


@query(f"WITH {_REFINES} SELECT * FROM ref")
def metadata_refines(spark, sf):
    return D.refinements(ELEMENTS.df(spark))


_READ = f"""{_REFINES}, titles AS (SELECT e.book_id, ord, text, value AS kind FROM el e LEFT JOIN ref r ON r.book_id = e.book_id AND r.elem_id = e.elem_id AND r.property = 'title-type' WHERE tag = 'title' AND text IS NOT NULL),
people AS (SELECT e.book_id, ord, text, coalesce(value, role) AS role FROM el e LEFT JOIN ref r ON r.book_id = e.book_id AND r.elem_id = e.elem_id AND r.property = 'role' WHERE tag = 'creator'),
coll AS (SELECT e.book_id, min_by(text, ord) AS name, min_by(p.value, ord) AS pos FROM el e LEFT JOIN ref t ON t.book_id = e.book_id AND t.elem_id = e.elem_id AND t.property = 'collection-type'
         LEFT JOIN ref p ON p.book_id = e.book_id AND p.elem_id = e.elem_id AND p.property = 'group-position' WHERE e.property = 'belongs-to-collection' AND coalesce(t.value, '') <> 'set' GROUP BY e.book_id),
old AS (SELECT book_id, max_by(content, ord) FILTER (name = 'calibre:series') AS name, max_by(content, ord) FILTER (name = 'calibre:series_index') AS pos FROM el GROUP BY book_id)"""


@query(f"""WITH {_READ}
SELECT p.book_id, p.version AS epub_version,
  (SELECT string_agg(text || ':' || coalesce(kind, ''), '|' ORDER BY ord) FROM titles t WHERE t.book_id = p.book_id) AS titles,
  (SELECT string_agg(text || ':' || role, '|' ORDER BY ord) FROM people c WHERE c.book_id = p.book_id) AS creators,
  (SELECT string_agg(text, '|' ORDER BY ord) FROM el s WHERE s.book_id = p.book_id AND tag = 'subject') AS subjects,
  coalesce(coll.name, old.name) AS series, CASE WHEN coll.name IS NOT NULL THEN coll.pos WHEN old.name IS NOT NULL THEN old.pos END AS position,
  (SELECT min_by(text, ord) FROM el m WHERE m.book_id = p.book_id AND property = 'dcterms:modified') AS modified
FROM {PACKAGES.sql} p LEFT JOIN coll ON coll.book_id = p.book_id LEFT JOIN old ON old.book_id = p.book_id""")
def metadata_read(spark, sf):
    md = D.read(ELEMENTS.df(spark), PACKAGES.df(spark))
    joined = lambda c, f: F.nullif(F.array_join(F.transform(c, f), "|"), F.lit(""))
    return md.select(
        "book_id", "epub_version", joined("titles", lambda t: F.concat(t["value"], F.lit(":"), F.coalesce(t["title_type"], F.lit("")))).alias("titles"),
        joined("creators", lambda c: F.concat(c["name"], F.lit(":"), c["role"])).alias("creators"), joined("subjects", lambda s: s).alias("subjects"),
        F.col("series.name").alias("series"), F.col("series.position").alias("position"), "modified",
    )


@query(f"""WITH {_READ}
SELECT p.book_id, (SELECT min_by(text, ord) FROM titles t WHERE t.book_id = p.book_id AND coalesce(kind, '') <> 'subtitle') AS title,
  (SELECT min_by(text, ord) FROM titles t WHERE t.book_id = p.book_id AND kind = 'subtitle') AS subtitle,
  (SELECT string_agg(text, ', ' ORDER BY ord) FROM people c WHERE c.book_id = p.book_id) AS authors, (SELECT min_by(text, ord) FROM el l WHERE l.book_id = p.book_id AND tag = 'language') AS language,
  coalesce((SELECT min_by(CASE WHEN lower(scheme) = 'isbn' THEN text ELSE substr(text, 10) END, ord) FROM el i WHERE i.book_id = p.book_id AND tag = 'identifier' AND (lower(scheme) = 'isbn' OR starts_with(text, 'urn:isbn:'))),
           (SELECT min_by(substr(text, 10), ord) FROM el s WHERE s.book_id = p.book_id AND tag = 'source' AND starts_with(text, 'urn:isbn:'))) AS isbn
FROM {PACKAGES.sql} p""")
def title_form(spark, sf):
    return D.form(D.read(ELEMENTS.df(spark), PACKAGES.df(spark))).withColumn("authors", F.nullif("authors", F.lit("")))


@query()
def metadata_text(spark, sf):
    md = D.read(ELEMENTS.df(spark), PACKAGES.df(spark))
    return D.as_text(md).join(D.as_json(md), "book_id")


@query(f"WITH el AS {ELEMENTS.sql} SELECT book_id, 'urn:isbn:123' AS value FROM el WHERE tag = 'source' AND elem_id = 'src'")
def page_break_source(spark, sf):
    return K.page_break_source(ELEMENTS.df(spark).select("book_id", "ord", "tag", "elem_id", "refines", "property", "text"))


UPDATES = Literals("book_id, title, subtitle, author1, author2, language, publisher, subject, series, position, isbn", f"""
 ('a', 'New & better', {_N}, 'First', 'Second', {_N}, 'House', {_N}, 'Saga', '4', '978'), ('b', NULL, 'Below', NULL, NULL, 'en', NULL, 'Topic', NULL, NULL, '999')""")


def _updates(spark):
    u = UPDATES.df(spark)
    some = lambda *c: F.when(F.col(c[0]).isNotNull(), F.array(*c))
    return u.select("book_id", "title", "subtitle", some("author1", "author2").alias("authors"), "language", "publisher", F.lit(None).cast("string").alias("date"), F.lit(None).cast("string").alias("description"), some("subject").alias("subjects"), F.when(F.col("series").isNotNull(), F.struct(F.col("series").alias("name"), "position")).alias("series"), "isbn")


@query(f"""WITH el AS {ELEMENTS.sql}, u AS {UPDATES.sql},
kinds AS (SELECT book_id, regexp_replace(refines, '^#+', '') AS elem_id, max_by(text, ord) AS kind FROM el WHERE property = 'title-type' AND refines IS NOT NULL GROUP BY ALL),
j AS (SELECT el.*, kind, u.title, u.subtitle, u.author1, u.language AS u_lang, u.publisher, u.subject, u.series, u.isbn FROM el JOIN u USING (book_id) LEFT JOIN kinds k ON k.book_id = el.book_id AND k.elem_id = el.elem_id),
g AS (SELECT *, coalesce((tag = 'title' AND CASE WHEN kind = 'subtitle' THEN subtitle IS NOT NULL ELSE title IS NOT NULL END) OR (tag = 'creator' AND author1 IS NOT NULL) OR (property = 'belongs-to-collection' AND series IS NOT NULL), false) AS named,
   coalesce((tag = 'language' AND u_lang IS NOT NULL) OR (tag = 'publisher' AND publisher IS NOT NULL) OR (tag = 'subject' AND subject IS NOT NULL) OR (tag = 'identifier' AND elem_id = 'gen-isbn' AND isbn IS NOT NULL)
   OR (name IN ('calibre:series', 'calibre:series_index') AND series IS NOT NULL) OR property = 'dcterms:modified', false) AS plain FROM j)
SELECT book_id, ord FROM g WHERE named OR plain
UNION SELECT e.book_id, e.ord FROM el e WHERE refines IS NOT NULL AND EXISTS (SELECT 1 FROM g WHERE named AND g.book_id = e.book_id AND g.elem_id = regexp_replace(e.refines, '^#+', ''))""")
def metadata_drop_plan(spark, sf):
    return D.dropped(ELEMENTS.df(spark), D.named_updates(_updates(spark)))


@query()
def metadata_write(spark, sf):
    return D.written(ELEMENTS.df(spark), D.named_updates(_updates(spark)), "2000-01-01T00:00:00Z")


# A merge for every document: its language against a made-up record of another edition.

_PAIRS = """pairs AS (SELECT doc_id::VARCHAR AS book_id, lang, CASE doc_id % 4 WHEN 0 THEN NULL WHEN 1 THEN 'en-US' WHEN 2 THEN 'DE' ELSE 'tr' END AS el, doc_id % 3 = 0 AS has, doc_id % 5 = 0 AS ow, doc_id % 7 = 0 AS allow, doc_id % 2 = 0 AS descr FROM documents)"""
_EDITION_OK = "(el IS NULL OR lower(string_split(el, '-')[1]) = lower(lang) OR allow)"
_FITS = {"edition": _EDITION_OK, "work": "(lower(lang) = 'en' OR allow)", "any": "true"}


def _merge_sql():
    parts = []
    for i, (field, kind) in enumerate(D.MERGED):
        omit = "WHEN NOT descr THEN 'omitted' " if field == "description" else ""
        decision = f"CASE {omit}WHEN has AND NOT ow THEN 'already_set' WHEN NOT {_FITS[kind]} THEN 'language_mismatch' ELSE 'set' END"
        parts.append(f"SELECT book_id, {i}::BIGINT AS pos, '{field}' AS field, {decision} AS decision FROM pairs WHERE lang IS NOT NULL")
    return f"WITH {_PAIRS}, d AS ({' UNION ALL '.join(parts)}) SELECT *, CASE WHEN decision = 'set' THEN 'new ' || field END AS value FROM d"


@query(_merge_sql())
def enrich_plan(spark, sf):
    k = F.col("doc_id")
    docs = table(spark, sf, "documents").select(
        k.cast("string").alias("book_id"), "lang", F.when(k % 4 == 1, "en-US").when(k % 4 == 2, "DE").when(k % 4 == 3, "tr").alias("edition_language"),
        *((k % 3 == 0).alias(f"has_{f}") for f, _ in D.MERGED), *(F.lit(f"new {f}").alias(f"new_{f}") for f, _ in D.MERGED),
        (k % 5 == 0).alias("overwrite"), (k % 7 == 0).alias("allow_foreign"), (k % 2 == 0).alias("with_description"),
    )
    return D.merge_plan(docs)


# Packages

ITEMS = Literals("book_id, ord, id, href, media_type, properties", f"""
 ('a', 1, 'i1', 'images/a%20b.jpg', 'image/jpeg', {_N}), ('a', 2, 'i2', 'f.TTF', 'application/x-font-ttf', NULL), ('a', 3, 'i3', 'g.ttf', 'font/ttf', NULL), ('a', 4, 'nav', 'nav.xhtml', 'application/xhtml+xml', 'nav'),
 ('a', 5, 'cover', 'images/c.png', 'image/png', NULL), ('b', 1, 'i1', 'images/a%20b.jpg', 'image/jpeg', NULL), ('b', 2, 'i2', 'h.ttf', NULL, 'x')""")
CHANGES = Literals("book_id, ord, href, new_href, new_type, is_cover", """
 ('a', 1, 'images/a%20b.jpg', 'images/a b.webp', 'image/webp', false), ('a', 2, 'images/c.png', 'images/c.avif', 'image/avif', true)""")


@query(f"""SELECT i.book_id, i.ord, id, coalesce(new_href, i.href) AS href,
  CASE WHEN new_href IS NOT NULL THEN new_type WHEN lower(regexp_extract(i.href, '[^.]*$')) = 'ttf' AND trim(coalesce(media_type, '')) IN ('', {", ".join(f"'{v}'" for v in P.TTF_WRONG)}) THEN 'font/ttf' ELSE media_type END AS media_type,
  CASE WHEN is_cover THEN 'cover-image' ELSE properties END AS properties
FROM {ITEMS.sql} i LEFT JOIN {CHANGES.sql} c ON c.book_id = i.book_id AND c.href = i.href""")
def manifest_rewrite(spark, sf):
    return K.manifest(ITEMS.df(spark), CHANGES.df(spark).drop("ord"))


CONTENTS = Literals("book_id, path, content", """
 ('a', 'x.xhtml', '<img src="images/a%20b.jpg"/> a%20b.jpg aa b.jpg images/c.png c.png'), ('a', 'y.css', 'url(c.png) bc.png'), ('b', 'x.xhtml', 'images/c.png')""")


def _nested():
    text = "content"
    for old, new in (("images/a%20b.jpg", "images/a b.webp"), ("images/a b.jpg", "images/a b.webp"), ("images/c.png", "images/c.avif")):
        for f in (lambda s: s, lambda s: s.replace("%", "%25").replace(" ", "%20"), lambda s: s.rpartition("/")[2]):
            text = f"replace({text}, '{f(old)}', '{f(new)}')"
    return text


@query(f"SELECT book_id, path, CASE WHEN book_id = 'a' THEN {_nested()} ELSE content END AS content FROM {CONTENTS.sql}")
def ref_rewrite(spark, sf):
    pairs = K.reference_pairs(CHANGES.df(spark))
    rows = CONTENTS.df(spark).where(P.is_referring("path")).join(pairs, "book_id", "left")
    return rows.select("book_id", "path", K.rereferenced("content", "pairs").alias("content"))


FEATURES = Literals("book_id, ord, tag, property, fallback, prefix", f"""
 ('a', 0, 'package', {_N}, {_N}, 'foo: http:x msv: http:y prism: http:z xsd http:w'), ('a', 1, 'meta', 'rendition:flow', NULL, NULL), ('a', 2, 'meta', 'rendition:layout', NULL, NULL), ('a', 3, 'item', NULL, 'i9', NULL),
 ('a', 4, 'item', NULL, 'i8', NULL), ('a', 5, 'collection', NULL, NULL, NULL), ('a', 6, 'meta', 'rendition:flow', NULL, NULL), ('b', 0, 'package', NULL, NULL, NULL), ('b', 1, 'meta', 'rendition:spread', NULL, NULL)""")


@query("""SELECT * FROM (VALUES ('a', 'outdated rendition property `rendition:flow`|manifest content fallback (`fallback` attribute)|`collection` element|deprecated reserved prefix `msv`|deprecated reserved prefix `prism`'),
 ('b', 'outdated rendition property `rendition:spread`')) t(book_id, features)""")
def outdated_lint(spark, sf):
    return K.outdated(FEATURES.df(spark)).select("book_id", F.array_join("features", "|").alias("features"))


# Navigation

_TREE = """points AS (
  SELECT 'world' AS book_id, 'r' || r_regionkey AS node_id, NULL AS parent_id, r_regionkey AS ord, r_name AS title, CASE WHEN r_regionkey % 2 = 0 THEN 'r' || r_regionkey || '.xhtml' ELSE '' END AS href FROM region
  UNION ALL SELECT 'world', 'n' || n_nationkey, 'r' || n_regionkey, n_nationkey, n_name, 'sub/' || n_nationkey || '.xhtml' FROM nation)"""


@query(f"""WITH {_TREE}, kids AS (SELECT parent_id, string_agg('<li><a href="' || href || '">' || title || '</a></li>', '' ORDER BY ord) AS inner_ FROM points WHERE parent_id IS NOT NULL GROUP BY parent_id)
SELECT book_id, '<ol>' || string_agg('<li>' || CASE WHEN href = '' THEN '<span>' || title || '</span>' ELSE '<a href="' || href || '">' || title || '</a>' END || coalesce('<ol>' || inner_ || '</ol>', '') || '</li>', '' ORDER BY ord) || '</ol>' AS markup
FROM points p LEFT JOIN kids ON kids.parent_id = p.node_id WHERE p.parent_id IS NULL GROUP BY book_id""")
def nav_tree(spark, sf):
    r, n = table(spark, sf, "region"), table(spark, sf, "nation")
    key = lambda p, c: F.concat(F.lit(p), F.col(c).cast("string"))
    roots = r.select(F.lit("world").alias("book_id"), key("r", "r_regionkey").alias("node_id"), F.lit(None).cast("string").alias("parent_id"), F.col("r_regionkey").cast("int").alias("ord"), F.col("r_name").alias("title"), F.when(F.col("r_regionkey") % 2 == 0, F.concat(key("r", "r_regionkey"), F.lit(".xhtml"))).otherwise("").alias("href"))
    leaves = n.select(F.lit("world"), key("n", "n_nationkey"), key("r", "n_regionkey"), F.col("n_nationkey").cast("int"), "n_name", F.concat(key("sub/", "n_nationkey"), F.lit(".xhtml")))
    return V.outline(roots.union(leaves))


GUIDE = Literals("book_id, ord, ref_type, href, title", "('a', 1, 'text', 'a.xhtml', 'Start'), ('a', 2, 'title-page', 't.xhtml', 'T'), ('a', 0, 'cover', 'c.xhtml', 'C & D')")


@query("""SELECT 'a' AS book_id, '<li><a epub:type="cover" href="c.xhtml">C &amp; D</a></li><li><a epub:type="bodymatter" href="a.xhtml">Start</a></li><li><a epub:type="titlepage" href="t.xhtml">T</a></li>' AS markup""")
def landmarks(spark, sf):
    return V.landmarks(GUIDE.df(spark))


# Answers of providers

ANSWERS = Literals("kind, key, body", """
 ('view', '111', '{"ISBN:111": {"title": " T ", "authors": [{"name": "A"}, {"name": "B"}], "publishers": [{"name": "P"}], "publish_date": "1999", "identifiers": {"isbn_13": ["9781"]}, "cover": {"medium": "m"}}}'),
 ('view', '222', '{}'), ('view', '333', '{"ISBN:333": {"title": "", "subjects": [{"name": "S"}]}}'), ('edition', '111', '{"languages": [{"key": "/languages/tur"}], "works": [{"key": "/works/W1"}]}'),
 ('edition', '333', 'broken {'), ('work', '/works/W1', '{"description": {"type": "t", "value": "Long"}, "subjects": ["W"]}')""")


@query("""SELECT * FROM (VALUES ('111', 'T', 'A, B', 'P', '1999', '9781', 'm', 'tr', 'Long', 'W'), ('333', NULL, '', NULL, NULL, NULL, NULL, NULL, NULL, 'S')) t(isbn, title, authors, publisher, date, isbn13, cover_url, edition_language, description, subjects)""")
def provider_records(spark, sf):
    got = L.fetched_a(ANSWERS.df(spark))
    return got.select("isbn", "title", F.array_join("authors", ", ").alias("authors"), "publisher", "date", "isbn13", "cover_url", "edition_language", "description", F.array_join("subjects", ", ").alias("subjects"))


VOLUMES = Literals("id, body", """
 (1, '{"items": [{"volumeInfo": {"title": "G", "authors": [" X ", ""], "description": "D", "language": "en", "industryIdentifiers": [{"type": "ISBN_10", "identifier": "1"}, {"type": "ISBN_13", "identifier": "2"}], "imageLinks": {"smallThumbnail": "s"}}}]}'),
 (2, '{"totalItems": 0}'), (3, 'no json')""")


@query("SELECT * FROM (VALUES (1, 'G', 'X', 'D', '2', 's', 'en'), (2, NULL, NULL, NULL, NULL, NULL, NULL), (3, NULL, NULL, NULL, NULL, NULL, NULL)) t(id, title, authors, description, isbn13, cover_url, edition_language)")
def provider_volumes(spark, sf):
    v = VOLUMES.df(spark).select("id", L.view_b("body").alias("v"))
    return v.select("id", "v.title", F.array_join("v.authors", ", ").alias("authors"), "v.description", "v.isbn13", "v.cover_url", "v.edition_language")


@query("""WITH t AS (SELECT conv_id, turn, 'see ![x](img-0.png) ' || coalesce(text, '') AS md FROM conversations),
n AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS page FROM t)
SELECT conv_id AS doc_id, string_agg(replace(md, '](img-0.png)', '](./p' || page || '_img-0.png)'), chr(10) || chr(10) ORDER BY turn) AS markdown, count(*) AS images FROM n GROUP BY conv_id""")
def ocr_stitch(spark, sf):
    """Conversations as OCR answers, a turn a page, each with one image."""
    page = F.struct(F.concat(F.lit("see ![x](img-0.png) "), F.coalesce("text", F.lit(""))).alias("markdown"), F.array(F.struct(F.lit("img-0.png").alias("id"), F.lit("data:image/png;base64,iVBORw0K").alias("image_base64"))).alias("images"))
    pages = table(spark, sf, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", page.alias("p")))).alias("rows"))
    answers = pages.select(F.col("conv_id").alias("doc_id"), F.to_json(F.struct(F.transform("rows", lambda r: r["p"]).alias("pages"))).alias("body"))
    return L.stitched(answers).select("doc_id", "markdown", F.size("images").cast("long").alias("images"))


# State by key

_BUCKET = """r AS (SELECT user_id, event_id, epoch_us(ts) / 1e6 AS t, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM events)"""


@query(f"""WITH RECURSIVE {_BUCKET},
b AS (SELECT user_id, event_id, n, t, 5.0::DOUBLE AS tokens, true AS allowed FROM r WHERE n = 1
  UNION ALL SELECT r.user_id, r.event_id, r.n, r.t, CASE WHEN least(6.0, tokens + greatest(0.0, r.t - b.t) * 0.2) >= 1 THEN least(6.0, tokens + greatest(0.0, r.t - b.t) * 0.2) - 1 ELSE least(6.0, tokens + greatest(0.0, r.t - b.t) * 0.2) END,
    least(6.0, tokens + greatest(0.0, r.t - b.t) * 0.2) >= 1 FROM b JOIN r ON r.user_id = b.user_id AND r.n = b.n + 1)
SELECT user_id::VARCHAR AS key, event_id AS seq, allowed, round(tokens, 4) AS tokens FROM b""")
def token_bucket(spark, sf):
    requests = table(spark, sf, "events").select(F.col("user_id").cast("string").alias("key"), F.col("event_id").alias("seq"), "ts")
    return S.limited(requests).withColumn("tokens", F.round("tokens", 4))


@query("""WITH m AS (SELECT user_id, max(ts) AS last FROM events GROUP BY user_id), n AS (SELECT max(ts) AS now FROM events)
SELECT user_id::VARCHAR AS key, last FROM m, n WHERE epoch_us(now) - epoch_us(last) >= 600000000""")
def idle_prune(spark, sf):
    e = table(spark, sf, "events").select(F.col("user_id").cast("string").alias("key"), "ts")
    now = e.agg(F.max("ts")).first()[0]
    return S.idle(e, F.lit(now))


@query("""WITH x AS (SELECT user_id::VARCHAR AS token, ts, event_id AS seq, event_id % 3 <> 0 AS get FROM events),
b AS (SELECT token, ts, CASE WHEN get THEN seq ELSE 0 END AS seq, get::INT AS kind FROM x),
p AS (SELECT *, last_value(CASE WHEN kind = 0 THEN ts END IGNORE NULLS) OVER (PARTITION BY token ORDER BY ts, kind, seq ROWS UNBOUNDED PRECEDING) AS put FROM b),
n AS (SELECT *, sum(kind) OVER (PARTITION BY token, put ORDER BY ts, kind, seq ROWS UNBOUNDED PRECEDING) AS nth FROM p)
SELECT token, seq, coalesce(put IS NOT NULL AND nth = 1 AND epoch_us(ts) - epoch_us(put) < 300000000, false) AS found FROM n WHERE kind = 1""")
def ttl_one_shot(spark, sf):
    e = table(spark, sf, "events").select(F.col("user_id").cast("string").alias("token"), "ts", F.col("event_id").alias("seq"))
    return S.read_once(e.where("seq % 3 = 0").select("token", "ts"), e.where("seq % 3 <> 0"))



