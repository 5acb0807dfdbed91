"""Queries over books, pages, entries and archives."""

from __future__ import annotations

from pyspark.sql import functions as F

from quire.functions import predicates as P
from quire.functions import text as T
from quire.operators import archive as A
from quire.operators import geometry as G
from quire.operators import markup as M
from quire.operators import report as R
from quire.operators import selection as S
from quire.operators import structure as B

from .base import BLOCKS_SQL, Literals, blocks, query, table

_WS = "\\s\\x{0B}\\x{85}\\x{A0}\\x{1680}\\x{2000}-\\x{200A}\\x{2028}\\x{2029}\\x{202F}\\x{205F}\\x{3000}"
_LETTERS = "trim(regexp_replace(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\p{L}]+', ' ', 'g'))"
_TEMPLATE = f"array_to_string(list_filter(string_split({_LETTERS}, ' '), lambda x: NOT regexp_matches(x, '^[ivxlcdm]{{1,8}}$')), ' ')"
_CLEAN = f"trim(regexp_replace(regexp_replace(text, '(\\p{{L}})-[{_WS}]+(\\p{{Ll}})', '\\1\\2', 'g'), '[{_WS}]+', ' ', 'g'))"
_NUMBER = f"(strlen(regexp_replace(text, '^[{_WS}]+|[{_WS}]+$', '', 'g')) <= 6 AND regexp_matches(regexp_replace(text, '^[{_WS}]+|[{_WS}]+$', '', 'g'), '^([0-9]+|[ivxlcdmIVXLCDM]+)$'))"
_HEADING = "(len(string_split(text, ' ')) <= 12 AND NOT regexp_matches(text, '[0-9]') AND length(regexp_replace(text, '[^\\p{L}]', '', 'g')) >= 3 AND (length(regexp_replace(text, '[^\\p{Lu}]', '', 'g')) / length(regexp_replace(text, '[^\\p{L}]', '', 'g')))::FLOAT >= 0.85::FLOAT)"

_HEADS = f"""
pages_ AS (SELECT book_id, page_num, min_by(text, seq) AS a, max_by(text, seq) AS b, count(*) AS n FROM blocks GROUP BY ALL),
ends AS (SELECT book_id, a AS text FROM pages_ UNION ALL SELECT book_id, b FROM pages_ WHERE n > 1),
least_ AS (SELECT book_id, greatest(5, count(*) // 30) AS least FROM pages_ GROUP BY book_id),
heads AS (SELECT book_id, template, n FROM (SELECT book_id, {_TEMPLATE} AS template, count(*) AS n FROM ends GROUP BY ALL) JOIN least_ USING (book_id)
          WHERE strlen(template) > 3 AND n >= least)"""
_KEPT = f"""
kept AS (SELECT * FROM (SELECT book_id, page_num, seq, {_CLEAN} AS text FROM (SELECT *, {_TEMPLATE} AS template FROM blocks WHERE NOT {_NUMBER}) b
         WHERE NOT EXISTS (SELECT 1 FROM heads h WHERE h.book_id = b.book_id AND h.template = b.template)) WHERE text <> '')"""


@query(f"WITH {BLOCKS_SQL}, {_HEADS} SELECT book_id, template, n FROM heads")
def recurrence_templates(spark, sf):
    return B.recurring(blocks(spark, sf))


@query(f"WITH {BLOCKS_SQL}, {_HEADS}, {_KEPT} SELECT book_id, page_num, seq::INT AS seq, text FROM kept")
def clean_blocks(spark, sf):
    return B.cleaned(blocks(spark, sf)).select("book_id", "page_num", "seq", "text")


@query(f"WITH {BLOCKS_SQL}, {_HEADS}, {_KEPT} SELECT book_id, page_num, seq::INT AS seq, text FROM kept WHERE {_HEADING}")
def heading_candidates(spark, sf):
    return B.cleaned(blocks(spark, sf)).where(P.is_heading("text")).select("book_id", "page_num", "seq", "text")


@query(f"""WITH {BLOCKS_SQL}, {_HEADS}, {_KEPT},
items AS (SELECT *, {_HEADING} AS head FROM kept),
islands AS (SELECT *, sum(head::INT) OVER (PARTITION BY book_id ORDER BY page_num, seq) AS island FROM items),
bodies AS (SELECT *, sum(CASE WHEN head THEN 0 ELSE strlen(text) END) OVER (PARTITION BY book_id, island) AS body FROM islands),
made AS (SELECT *, head AND body >= 400 AS promoted, sum((head AND body >= 400)::INT) OVER (PARTITION BY book_id ORDER BY page_num, seq) AS chapter FROM bodies)
SELECT book_id, chapter::BIGINT AS chapter, max(CASE WHEN promoted THEN text END) AS title, count(*) FILTER (NOT promoted) AS paragraphs
FROM made GROUP BY book_id, chapter""")
def chapterize(spark, sf):
    return B.book(blocks(spark, sf)).select("book_id", "chapter", "title", F.size("blocks").cast("long").alias("paragraphs"))


_ISLANDS = """
islands AS (SELECT *, sum(head::INT) OVER (PARTITION BY book_id ORDER BY page_num, seq) AS island FROM items),
bodies AS (SELECT *, sum(CASE WHEN head THEN 0 ELSE strlen(text) END) OVER (PARTITION BY book_id, island) AS body FROM islands),
made AS (SELECT *, head AND body >= 400 AS promoted, sum((head AND body >= 400)::INT) OVER (PARTITION BY book_id ORDER BY page_num, seq) AS chapter FROM bodies)"""
_MADE = f"items AS (SELECT *, {_HEADING} AS head FROM kept), {_ISLANDS}"
_XML = "replace(replace(replace(replace(regexp_replace({0}, '[\\x00-\\x08\\x0B\\x0C\\x0E-\\x1F]', '', 'g'), '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), chr(34), '&quot;')"


@query(f"""WITH {BLOCKS_SQL}, {_HEADS}, {_KEPT}, {_MADE},
chapters AS (SELECT book_id, chapter, max(CASE WHEN promoted THEN text END) AS title,
   coalesce(string_agg('<p>' || {_XML.format('text')} || '</p>' || chr(10), '' ORDER BY page_num, seq) FILTER (NOT promoted), '') AS body FROM made GROUP BY ALL),
n AS (SELECT *, row_number() OVER (PARTITION BY book_id ORDER BY chapter) AS number FROM chapters),
t AS (SELECT book_id, number, coalesce(title, 'Section ' || number) AS title, body FROM n)
SELECT book_id, number, title, sha256('<h1>' || {_XML.format('title')} || '</h1>' || chr(10) || body) AS body_sha256 FROM t""")
def reflow_chapters(spark, sf):
    return B.rendered(B.book(blocks(spark, sf))).select("book_id", "number", "title", F.sha2("body", 256).alias("body_sha256"))


@query(f"""WITH {BLOCKS_SQL}, {_HEADS}, {_KEPT}, {_MADE},
chapters AS (SELECT book_id, count(DISTINCT chapter) AS chapters, count(*) FILTER (NOT promoted) AS paragraphs FROM made GROUP BY book_id),
texts AS (SELECT book_id, count(*) FILTER (regexp_matches(text, '[^{_WS}]')) AS with_text, sum(length(regexp_replace(text, '[{_WS}]', '', 'g'))) AS solid,
   sum(length(regexp_replace(text, '[^\\p{{L}}]', '', 'g'))) AS letters FROM blocks GROUP BY book_id)
SELECT book_id, coalesce(chapters, 0)::BIGINT AS chapters, coalesce(paragraphs, 0)::BIGINT AS paragraphs,
       CASE WHEN with_text = 0 THEN 'no_text' WHEN chapters IS NULL THEN 'nothing_left' WHEN solid >= 50 AND letters::FLOAT < solid::FLOAT * 0.45::FLOAT THEN 'not_prose' ELSE 'ok' END AS status
FROM texts LEFT JOIN chapters USING (book_id)""")
def import_status(spark, sf):
    return B.imported(blocks(spark, sf))


_SENTENCES = f"list_filter(string_split(regexp_replace(text, '([.!?][''\"”’»…]*[{_WS}]+)', '\\1' || chr(1), 'g'), chr(1)), lambda x: x <> '')"


@query(f"""WITH s AS (SELECT doc_id, {_SENTENCES} AS parts FROM documents)
SELECT doc_id, (i - 1)::INT AS seg, parts[i] AS text FROM (SELECT *, unnest(range(1, len(parts) + 1)) AS i FROM s)""")
def sentence_segments(spark, sf):
    return table(spark, sf, "documents").select("doc_id", F.posexplode(T.sentences("text")).alias("seg", "text"))


@query(f"""WITH t AS (SELECT conv_id, turn, text, {_SENTENCES} AS parts FROM conversations WHERE text IS NOT NULL AND regexp_matches(text, '[^{_WS}]')),
para AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS p FROM t)
SELECT conv_id::VARCHAR AS book_id, p AS para, i::BIGINT AS seg, parts[i] AS text FROM (SELECT *, unnest(range(1, len(parts) + 1)) AS i FROM para)""")
def span_numbering(spark, sf):
    turns = table(spark, sf, "conversations").where(F.col("text").isNotNull() & (T.strip("text") != ""))
    rows = turns.select(F.col("conv_id").cast("string").alias("book_id"), F.lit(1).alias("page_num"), F.col("turn").alias("seq"), F.lit(1).alias("opens"), "text")
    return B.numbered_segments(rows)


@query()
def sentence_spans(spark, sf):
    return table(spark, sf, "pages").select("page_id", F.sha2(M.spans("html"), 256).alias("spans_sha256"))


@query(f"""WITH {BLOCKS_SQL}, p AS (SELECT book_id, page_num, strlen(string_agg(text, '')) AS shown, page_num % 5 < 2 AS scan FROM blocks GROUP BY ALL),
v AS (SELECT book_id, count(*) AS pages, count(*) FILTER (shown >= 100) AS with_text, count(*) FILTER (scan) AS scans FROM p GROUP BY book_id)
SELECT *, CASE WHEN 2 * with_text >= pages THEN 'text_layer' ELSE 'scan' END AS tier, 2 * scans < pages AS born_digital FROM v""")
def tier_vote(spark, sf):
    pages = blocks(spark, sf).groupBy("book_id", "page_num").agg(F.sum(F.octet_length("text")).alias("shown_bytes")).withColumn("full_page_image", F.col("page_num") % 5 < 2)
    return B.tiers(pages)


# Sizes and choices

_CANDIDATES = """cand AS (
  SELECT doc_id, length(text)::BIGINT AS original, ord, format, (length(text) * num // den)::BIGINT AS size
  FROM documents, (VALUES (0, 'WebP', 9, 10), (1, 'AVIF', 8 , 9), (2, 'JXL', 11, 10)) f(ord, format, num, den))"""


def _candidates(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id", F.length("text").cast("long").alias("original"))
    # Three made-up encodings stand in for codecs, which are supplied from outside.
    sizes = F.array(*(F.struct(F.lit(i).alias("ord"), F.lit(n).alias("format"), F.floor(F.col("original") * a / b).cast("long").alias("size")) for i, (n, a, b) in enumerate((("WebP", 9, 10), ("AVIF", 8, 9), ("JXL", 11, 10)))))
    return docs.select("doc_id", "original", F.inline(sizes))


@query(f"""WITH {_CANDIDATES}
SELECT doc_id, min(original) AS original, min_by(format, (size, ord)) AS format, min(size) AS size, min(size) >= min(original) AS kept FROM cand GROUP BY doc_id""")
def best_candidate(spark, sf):
    best = S.smallest(_candidates(spark, sf), "doc_id")
    return best.select("doc_id", "original", "format", "size", S.never_larger(F.col("original"), F.col("size")).alias("kept"))


@query("""WITH d AS (SELECT doc_id, source, CASE WHEN lang = 'en' THEN 'image/jpeg' ELSE 'image/png' END AS media_type, length(text) AS n FROM documents)
SELECT doc_id, CASE WHEN media_type = 'image/jpeg' THEN 'AVIF' ELSE 'WebP' END AS format, n >= 1000 AS kept FROM d""")
def policy_auto(spark, sf):
    media = F.when(F.col("lang") == "en", "image/jpeg").otherwise("image/png")
    return table(spark, sf, "documents").select("doc_id", S.allowed("auto", media)[0].alias("format"), S.never_larger(F.lit(1000), F.length("text")).alias("kept"))


@query("""WITH i AS (SELECT source AS book_id, doc_id AS ord, length(text) % 3 = 0 AS kept, CASE WHEN length(text) % 3 <> 0 THEN CASE WHEN lang = 'en' THEN 'AVIF' ELSE 'WebP' END END AS format FROM documents),
f AS (SELECT book_id, format, min(ord) AS first FROM i WHERE format IS NOT NULL GROUP BY ALL)
SELECT i.book_id, count(*) FILTER (NOT kept) AS converted, count(*) FILTER (kept) AS kept,
       coalesce((SELECT string_agg(format, '/' ORDER BY first) FROM f WHERE f.book_id = i.book_id), 'WebP') AS label
FROM i GROUP BY i.book_id""")
def format_label(spark, sf):
    return S.format_labels(_images(spark, sf))


def _images(spark, sf):
    n = F.length("text")
    kept = n % 3 == 0
    return table(spark, sf, "documents").select(
        F.col("source").alias("book_id"), F.col("doc_id").alias("ord"), F.concat(F.lit("img"), F.col("doc_id").cast("string"), F.lit(".jpg")).alias("name"), n.cast("long").alias("original_size"),
        F.floor(n * 0.75).cast("long").alias("new_size"), kept.alias("kept"), F.when(~kept, F.when(F.col("lang") == "en", "AVIF").otherwise("WebP")).alias("format"),
    )


@query("""SELECT book_id, ord, rpad(left(name, 29), 30, ' ') || ' | ' || lpad(format('{:,.1f}', round(original_size / 1024.0, 1)), 13, ' ') || ' | ' ||
  CASE WHEN kept THEN lpad('—', 9, ' ') || ' | ' || lpad('kept', 10, ' ')
       ELSE lpad(format('{:,.1f}', round(new_size / 1024.0, 1)), 9, ' ') || ' | ' || lpad(format('{:.1f}', round((original_size - new_size) / original_size * 100.0, 1)), 9, ' ') || '%' END AS line
FROM (SELECT source AS book_id, doc_id AS ord, 'img' || doc_id || '.jpg' AS name, length(text) AS original_size, floor(length(text) * 0.75)::BIGINT AS new_size, length(text) % 3 = 0 AS kept FROM documents WHERE length(text) > 0)""")
def audit_report_rows(spark, sf):
    return R.image_lines(_images(spark, sf).where("original_size > 0"))


_REPORT_ROWS = """i AS (SELECT source AS book_id, doc_id AS ord, lang, length(text) AS o, floor(length(text) * 0.75)::BIGINT AS n, length(text) % 3 = 0 AS kept,
  rpad(left('img' || doc_id || '.jpg', 29), 30, ' ') || ' | ' || lpad(format('{:,.1f}', round(length(text) / 1024.0, 1)), 13, ' ') || ' | ' || CASE WHEN length(text) % 3 = 0 THEN lpad('—', 9, ' ') || ' | ' || lpad('kept', 10, ' ')
   ELSE lpad(format('{:,.1f}', round(floor(length(text) * 0.75) / 1024.0, 1)), 9, ' ') || ' | ' || lpad(format('{:.1f}', round((length(text) - floor(length(text) * 0.75)) / length(text) * 100.0, 1)), 9, ' ') || '%' END AS line FROM documents WHERE length(text) > 0)"""
_SIZE = "lpad(format('{{:,}}', {0}::BIGINT), 16, ' ') || ' bytes = ' || format('{{:.2f}}', {0} / 1048576.0) || ' MB'"


@query(f"""WITH {_REPORT_ROWS},
b AS (SELECT book_id, sum(o) AS o, sum(n) AS n, count(*) FILTER (NOT kept) AS converted, count(*) FILTER (kept) AS kept, string_agg(line, chr(10) ORDER BY ord) AS lines,
  array_to_string(list_transform(list_sort(list_filter([min(struct_pack(p := ord, f := 'AVIF')) FILTER (NOT kept AND lang = 'en'), min(struct_pack(p := ord, f := 'WebP')) FILTER (NOT kept AND lang IS DISTINCT FROM 'en')], lambda x: x IS NOT NULL)), lambda x: x.f), '/') AS label FROM i GROUP BY book_id)
SELECT book_id, array_to_string(['Book audit of 2000-01-01 00:00:00', repeat('-', 72), rpad('from', 16, ' ') || book_id || '.epub', rpad('to', 16, ' ') || book_id || '_v3.3.epub',
  '', 'Bytes', repeat('-', 72), rpad('before', 16, ' ') || {_SIZE.format('o')}, rpad('after', 16, ' ') || {_SIZE.format('n')}, rpad('saved', 16, ' ') || {_SIZE.format('(o - n)')},
  rpad('share saved', 16, ' ') || lpad(format('{{:.1f}}', round((o - n) / o * 100.0, 1)), 16, ' ') || ' %', '', 'Steps towards EPUB 3.3', repeat('-', 72),
  '* package document raised to version 3.0', '* time of the last change set in the metadata (UTC)', '* navigation document built from the old table of contents',
  '* document types of all content documents replaced by that of HTML5', '* guide turned into a hidden list of landmarks', '', 'Images', repeat('-', 72),
  'encoded as ' || label || ': ' || converted || '; left as they were, being no larger: ' || kept,
  rpad('name', 30, ' ') || ' | ' || lpad('KB before', 13, ' ') || ' | ' || lpad('KB after', 9, ' ') || ' | ' || lpad('saved', 10, ' '), lines], chr(10)) AS report FROM b""")
def audit_reports(spark, sf):
    images = _images(spark, sf).where("original_size > 0")
    books = images.groupBy("book_id").agg(F.sum("original_size").alias("original_size"), F.sum("new_size").alias("final_size"))
    books = books.select("book_id", F.concat("book_id", F.lit(".epub")).alias("input_name"), T.output_name("book_id").alias("output_name"), "original_size", "final_size", F.lit("3.3").alias("version"))
    none = spark.createDataFrame([], "book_id string, features array<string>")
    return R.texts(books, images, none, "2000-01-01 00:00:00")


@query("""SELECT count(*) AS archives, sum(o)::BIGINT AS original_size, sum(a)::BIGINT AS archive_size, (sum(o) - sum(a)) / sum(o) * 100.0 AS saved_pct
FROM (SELECT source, sum(length(text)) AS o, sum(length(text) // 3) AS a FROM documents GROUP BY source)""")
def library_totals(spark, sf):
    docs = table(spark, sf, "documents")
    return R.library(docs.groupBy("source").agg(F.sum(F.length("text").cast("long")).alias("original_size"), F.sum(F.expr("length(text) div 3")).alias("archive_size")))


@query("""WITH d AS (SELECT doc_id, strlen(text)::BIGINT AS raw, strlen(text) // 2 AS packed FROM documents),
b AS (SELECT CASE WHEN raw < 1024 THEN 'small' WHEN raw < 8192 THEN 'medium' ELSE 'large' END AS bucket, raw, packed FROM d)
SELECT coalesce(bucket, 'ALL') AS bucket, count(*) AS n, sum(raw)::BIGINT AS raw, sum(packed)::BIGINT AS packed FROM b GROUP BY ROLLUP (bucket)""")
def text_size_buckets(spark, sf):
    docs = table(spark, sf, "documents").select(F.octet_length("text").cast("long").alias("raw"), F.expr("octet_length(text) div 2").alias("packed"))
    return S.size_buckets(docs, "raw", "raw", "packed", small=1024, large=8192)


@query("""WITH d AS (SELECT p.cfg, length(text)::BIGINT AS alone, (length(text) * 8 // 9 + p.cost)::BIGINT AS shared FROM documents, (VALUES ('small', 40), ('large', 400)) p(cfg, cost))
SELECT cfg, count(*) FILTER (shared < alone) AS wins, count(*) FILTER (shared > alone) AS losses, sum(alone)::BIGINT AS sum_alone, sum(shared)::BIGINT AS sum_shared, sum(least(alone, shared))::BIGINT AS sum_safe
FROM d GROUP BY cfg""")
def dict_sweep(spark, sf):
    docs = table(spark, sf, "documents").select(F.length("text").cast("long").alias("alone"))
    rows = docs.select("alone", F.inline(F.array(*(F.struct(F.lit(c).alias("cfg"), F.expr(f"alone * 8 div 9 + {n}").alias("shared")) for c, n in (("small", 40), ("large", 400))))))
    return S.contest(rows, "cfg", "alone", "shared")


@query("""SELECT l_returnflag, list_sort(list(l_quantity))[count(*) // 2 + 1] AS median FROM lineitem GROUP BY l_returnflag""")
def upper_median(spark, sf):
    # At scale the values of a group are counted first; a group's distinct values are few.
    counts = table(spark, sf, "lineitem").groupBy("l_returnflag", "l_quantity").agg(F.count(F.lit(1)).alias("n"))
    return S.weighted_upper_median(counts, "l_returnflag", "l_quantity", "n").withColumnRenamed("l_quantity", "median")


CURVES = Literals("curve, knob, score, size", """
 ('a', 50, 10.0, 100.0), ('a', 60, 20.0, 150.0), ('a', 70, 30.0, 300.0), ('b', 50, 12.0, 80.0), ('b', 60, 12.0, 90.0), ('b', 70, 50.0, 400.0), ('c', 50, 40.0, 10.0), ('c', 60, 60.0, 20.0)""")  # fmt: skip


@query(f"""WITH c AS (SELECT curve, score::DOUBLE AS score, size::DOUBLE AS size FROM {CURVES.sql}),
p AS (SELECT *, lead(score) OVER w AS s2, lead(size) OVER w AS v2 FROM c WINDOW w AS (PARTITION BY curve ORDER BY score, size)),
h AS (SELECT curve, min_by(size + CASE WHEN abs(s2 - score) < 1e-9 THEN 0 ELSE (25.0 - score) / (s2 - score) END * (v2 - size), (score, size)) AS size FROM p WHERE s2 IS NOT NULL AND 25.0 BETWEEN score AND s2 GROUP BY curve)
SELECT DISTINCT c.curve, h.size FROM c LEFT JOIN h USING (curve)""")
def curve_interp(spark, sf):
    curves = CURVES.df(spark).withColumns({"score": F.col("score").cast("double"), "size": F.col("size").cast("double")})
    return S.interpolated(curves, "curve", "score", "size", F.lit(25.0))


@query("""WITH n AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY doc_id) - 1 AS i, greatest(count(*) OVER (PARTITION BY source) // 7, 1) AS step FROM documents)
SELECT source, doc_id FROM n WHERE i % step = 0 AND i // step < 7""")
def every_kth(spark, sf):
    return S.every(table(spark, sf, "documents").select("source", "doc_id"), "source", "doc_id", 7)


# Entries and archives

_ENTRIES = """e AS (SELECT regexp_extract(url, '//([^/]*)', 1) AS book_id, page_id AS ord, CASE page_id % 3 WHEN 0 THEN 'a/' || page_id || '.xhtml' WHEN 1 THEN 'i/' || page_id || '.png' ELSE 'f/' || page_id || '.otf' END AS path,
  octet_length(encode(html)) AS size, page_id % 3 <> 1 AS streamed FROM pages WHERE html IS NOT NULL)"""


def _entries(spark, sf):
    k = F.col("page_id") % 3
    name = F.col("page_id").cast("string")
    path = F.when(k == 0, F.concat(F.lit("a/"), name, F.lit(".xhtml"))).when(k == 1, F.concat(F.lit("i/"), name, F.lit(".png"))).otherwise(F.concat(F.lit("f/"), name, F.lit(".otf")))
    return table(spark, sf, "pages").where("html IS NOT NULL").select(F.regexp_extract("url", "//([^/]*)", 1).alias("book_id"), F.col("page_id").alias("ord"), path.alias("path"), F.col("html").cast("binary").alias("data"))


@query(f"""WITH {_ENTRIES} SELECT book_id, ord, path, size::BIGINT AS size, streamed,
  CASE WHEN streamed THEN coalesce(sum(CASE WHEN streamed THEN size ELSE 0 END) OVER w, 0)::BIGINT END AS start,
  CASE WHEN streamed THEN (coalesce(sum(CASE WHEN streamed THEN size ELSE 0 END) OVER w, 0) + size)::BIGINT END AS stop
FROM e WINDOW w AS (PARTITION BY book_id ORDER BY ord ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)""")
def archive_offsets(spark, sf):
    return S.offsets(A.classified(_entries(spark, sf))).select("book_id", "ord", "path", "size", "streamed", "start", "stop")


@query(f"""WITH {_ENTRIES} SELECT book_id, count(*) FILTER (streamed) AS stream_entries, count(*) FILTER (NOT streamed) AS stored_entries,
  coalesce(sum(size) FILTER (streamed), 0)::BIGINT AS stream_bytes, sum(size)::BIGINT AS total_bytes FROM e GROUP BY book_id""")
def archive_stats(spark, sf):
    return S.archive_stats(A.classified(_entries(spark, sf)))


@query(f"""WITH {_ENTRIES} SELECT book_id, count(*) AS entries, count(*) AS restored, true AS same FROM e GROUP BY book_id""")
def archive_roundtrip(spark, sf):
    """Archives of all hosts' pages, restored and compared entry by entry."""
    entries = _entries(spark, sf)
    originals = entries.groupBy("book_id").agg(F.concat(F.first("book_id"), F.lit(".epub")).alias("filename"), F.sum(F.octet_length("data")).cast("long").alias("size"), F.lit("").alias("sha256"))
    back = A.restored(A.archived(entries, originals, "2000-01-01T00:00:00Z", level=3)).select("book_id", "path", F.col("data").alias("again"))
    both = entries.join(back, ["book_id", "path"], "left").groupBy("book_id")
    return both.agg(F.count(F.lit(1)).alias("entries"), F.count("again").alias("restored"), F.every(F.col("data") == F.col("again")).alias("same"))


@query(f"""WITH {_ENTRIES} SELECT book_id, count(*) + 1 AS entries, true AS same FROM e GROUP BY book_id""")
def container_roundtrip(spark, sf):
    """Containers of all hosts' pages, scanned again; the mimetype comes first."""
    from quire.sources.containers import read

    entries = _entries(spark, sf)
    back = read(A.containers(entries)).select("book_id", F.col("ord").alias("n"), "path", F.col("data").alias("again"))
    joined = back.join(entries, ["book_id", "path"], "left")
    ok = F.when(F.col("path") == "mimetype", (F.col("n") == 0) & (F.col("again") == F.lit(A.MIMETYPE))).otherwise(F.col("data") == F.col("again"))
    return joined.groupBy("book_id").agg(F.count(F.lit(1)).alias("entries"), F.every(F.coalesce(ok, F.lit(False))).alias("same"))


@query(f"""WITH {_ENTRIES} SELECT book_id, count(*) AS entries, true AS same, true AS never_larger FROM e GROUP BY book_id""")
def method93_roundtrip(spark, sf):
    entries = _entries(spark, sf)
    best, plain = A.packed(entries, 3), A.packed(entries, 3, "plain")
    sizes = best.select("book_id", F.octet_length("data").alias("a")).join(plain.select("book_id", F.octet_length("data").alias("b")), "book_id")
    back = A.unpacked(best).select("book_id", "path", F.col("data").alias("again"))
    both = entries.join(back, ["book_id", "path"], "left").groupBy("book_id").agg(F.count(F.lit(1)).alias("entries"), F.every(F.coalesce(F.col("data") == F.col("again"), F.lit(False))).alias("same"))
    return both.join(sizes, "book_id").select("book_id", "entries", "same", (F.col("a") <= F.col("b")).alias("never_larger"))


@query()
def codec_bench(spark, sf):
    sizes = A.codec_sizes(_entries(spark, sf).where(P.is_text("path")))
    return sizes.groupBy("codec").agg(F.sum("raw").alias("raw"), F.sum("packed").alias("packed"))


# Positioned text

_RUN = """r AS (SELECT event_id // 40 AS page, event_id AS seq, (event_id % 7 + 6)::FLOAT AS font, (value)::FLOAT AS y FROM events)"""


def _runs(spark, sf):
    e = table(spark, sf, "events")
    word = F.concat(F.col("event_type"), F.lit(" "), F.col("event_id").cast("string"))
    x = (F.col("event_id") % 5 * 100).cast("float")
    font = (F.col("event_id") % 7 + 6).cast("float")
    return e.select(F.lit("b").alias("book_id"), F.floor(F.col("event_id") / 40).cast("int").alias("page_num"), F.col("event_id").cast("int").alias("seq"), word.alias("text"), font.alias("font_size"), x.alias("x"), (x + font * F.length(word) * 0.5).cast("float").alias("end_x"), F.col("value").cast("float").alias("y"))


@query(f"""WITH {_RUN} SELECT 'b' AS book_id, page::INT AS page_num, greatest(list_sort(list(font))[count(*) // 2 + 1], 1.0)::FLOAT AS median FROM r GROUP BY page""")
def page_font_median(spark, sf):
    return _runs(spark, sf).groupBy("book_id", "page_num").agg(F.greatest(S.upper_median(F.col("font_size")), F.lit(1.0).cast("float")).alias("median"))


@query("""WITH e AS (SELECT (event_id // 40)::INT AS page_num, event_id, event_type, (event_id % 7 + 6)::FLOAT AS font FROM events),
m AS (SELECT page_num, greatest(list_sort(list(font))[count(*) // 2 + 1], 1.0)::FLOAT AS median FROM e GROUP BY page_num)
SELECT 'b' AS book_id, page_num, string_agg(trim(regexp_replace(lower(event_type), '[^a-z]+', ' ', 'g')), '|' ORDER BY event_id) AS big_font
FROM e JOIN m USING (page_num) WHERE font >= median * 1.3::FLOAT AND strlen(trim(regexp_replace(lower(event_type), '[^a-z]+', ' ', 'g'))) > 2 GROUP BY page_num""")
def big_font(spark, sf):
    return G.big_fonts(_runs(spark, sf)).select("book_id", "page_num", F.array_join("big_font", "|").alias("big_font"))


@query()
def geometry_blocks(spark, sf):
    return G.blocks(_runs(spark, sf))


@query("""WITH e AS (SELECT event_id, user_id, (event_id % 11 * 50 + 10)::BIGINT AS w, (event_id % 13 * 70 + 5)::BIGINT AS h FROM events)
SELECT 'b' AS book_id, user_id::INT AS page_num, min_by(event_id, (-(w * h), event_id)) AS ord, max(w * h) > 400000 AS full_page FROM e GROUP BY user_id""")
def largest_image(spark, sf):
    e = table(spark, sf, "events")
    images = e.select(F.lit("b").alias("book_id"), F.col("user_id").cast("int").alias("page_num"), F.col("event_id").alias("ord"), (F.col("event_id") % 11 * 50 + 10).alias("w"), (F.col("event_id") % 13 * 70 + 5).alias("h"))
    return G.page_scan(images).select("book_id", "page_num", "ord", P.is_full_page(F.array(F.struct("w", "h"))).alias("full_page"))


# Chapters of plain text

MD = Literals("book_id, ord, text", """
 ('m', 1, 'intro'), ('m', 2, '# One'), ('m', 3, 'text'), ('m', 4, '## Sub'), ('m', 5, '#no heading'), ('m', 6, '# Two '), ('n', 1, ''), ('n', 2, '# Only'), ('n', 3, ' ')""")  # fmt: skip


@query(f"""WITH l AS (SELECT book_id, ord, text FROM {MD.sql} UNION ALL SELECT conv_id::VARCHAR, turn, CASE WHEN role = 'user' THEN '# ' || text ELSE text END FROM conversations WHERE text IS NOT NULL),
h AS (SELECT *, regexp_matches(text, '^# +[^ ]') AS head, sum(regexp_matches(text, '^# +[^ ]')::INT) OVER (PARTITION BY book_id ORDER BY ord) AS chapter FROM l)
SELECT book_id, chapter::BIGINT AS chapter, max(CASE WHEN head THEN trim(regexp_replace(text, '^# +', '')) END) AS title, count(*) FILTER (trim(text) <> '') AS n_lines
FROM h GROUP BY book_id, chapter HAVING count(*) FILTER (trim(text) <> '') > 0""")
def md_chapters(spark, sf):
    turns = table(spark, sf, "conversations").where("text IS NOT NULL")
    lines = turns.select(F.col("conv_id").cast("string").alias("book_id"), F.col("turn").cast("int").alias("ord"), F.when(F.col("role") == "user", F.concat(F.lit("# "), "text")).otherwise(F.col("text")).alias("text"))
    return M.heading_chapters(MD.df(spark).unionByName(lines))


@query()
def markdown_import(spark, sf):
    docs = table(spark, sf, "documents").where("text IS NOT NULL")
    files = docs.select(F.col("source").alias("book_id"), F.concat(F.lpad(F.col("doc_id").cast("string"), 9, "0"), F.lit(".md")).alias("path"), F.concat(F.lit("# Document "), F.col("doc_id").cast("string"), F.lit("\n\n"), "text").alias("text"))
    return M.markdown_books(files).select("book_id", "kind", "number", "title", F.sha2("body", 256).alias("body_sha256"))
