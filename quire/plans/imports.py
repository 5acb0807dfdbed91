"""Queries of whole imports: documents as pages of books, conversations as answers of an OCR service."""

from __future__ import annotations

from pyspark.sql import functions as F

from quire.functions import text as T
from quire.operators import imports as I

from .base import query, table
from .books import _HEADING, _HEADS, _ISLANDS, _KEPT, _LETTERS, _WS

_LARGE = "(len(string_split(text, ' ')) <= 12 AND NOT regexp_matches(text, '[0-9]') AND length(regexp_replace(text, '[^\\p{L}]', '', 'g')) >= 3)"


@query(f"""
WITH p AS (SELECT source AS book_id, doc_id AS page_num, doc_id % 5 < 2 AS image, CASE WHEN length(source) % 5 = 0 THEN 0 ELSE octet_length(encode(coalesce(text, ''))) END AS shown,
                  list_filter(list_transform(regexp_split_to_array(coalesce(text, ''), '\r?\n'), lambda x: trim(regexp_replace(x, '[{_WS}]+', ' ', 'g'))), lambda x: x <> '') AS ls
           FROM documents WHERE source IS NOT NULL),
tiers AS (SELECT book_id, CASE WHEN 2 * count(*) FILTER (shown >= 100) >= count(*) THEN 'text_layer' ELSE 'scan' END AS tier FROM p GROUP BY book_id),
q AS (SELECT * FROM p JOIN tiers USING (book_id)),
blocks AS (SELECT book_id, page_num, i - 1 AS seq, ls[i] AS text FROM (SELECT *, unnest(range(1, len(ls) + 1)) AS i FROM q WHERE CASE WHEN tier = 'scan' THEN page_num % 2 = 0 ELSE page_num % 7 <> 0 END)
           UNION ALL SELECT book_id, page_num, 0, array_to_string(ls, ' ') FROM q WHERE tier = 'text_layer' AND page_num % 7 = 0 AND len(ls) > 0),
large AS (SELECT book_id, page_num, {_LETTERS} AS letters FROM (SELECT *, ls[1] AS text FROM q WHERE tier = 'text_layer' AND NOT image AND page_num % 3 = 0 AND len(ls) > 2) WHERE strlen({_LETTERS}) > 2),
{_HEADS}, {_KEPT},
items AS (SELECT k.*, {_HEADING} OR ({_LARGE} AND coalesce({_LETTERS} = letters, false)) AS head FROM kept k LEFT JOIN large USING (book_id, page_num)), {_ISLANDS},
sums AS (SELECT book_id, count(DISTINCT chapter) AS chapters, count(*) FILTER (NOT promoted) AS paragraphs, sum(length(regexp_replace(text, '[{_WS}]', '', 'g'))) FILTER (NOT promoted) AS solid,
                sum(length(regexp_replace(text, '[^\\p{{L}}]', '', 'g'))) FILTER (NOT promoted) AS letters FROM made GROUP BY book_id)
SELECT t.book_id, tier, coalesce(chapters, 0)::BIGINT AS chapters, coalesce(paragraphs, 0)::BIGINT AS paragraphs,
       CASE WHEN chapters IS NULL THEN CASE WHEN tier = 'scan' THEN 'unread_scan' WHEN t.book_id NOT IN (SELECT book_id FROM blocks) THEN 'undecoded_fonts' ELSE 'no_text' END
            WHEN solid >= 50 AND sums.letters::FLOAT < solid::FLOAT * 0.45::FLOAT THEN 'not_prose' ELSE 'ok' END AS status
FROM tiers t LEFT JOIN sums USING (book_id)""")
def page_imports(spark, sf):
    """A source is a book, a document a page, some without a text but with drawn lines; the first line of every third is set in a large font."""
    d = table(spark, sf, "documents").select(F.col("source").alias("book_id"), F.col("doc_id").alias("page_num"), F.coalesce("text", F.lit("")).alias("text"))
    shown = F.when(F.length("book_id") % 5 == 0, 0).otherwise(F.octet_length("text"))
    pages = d.select("book_id", "page_num", F.when(F.col("page_num") % 7 != 0, F.col("text")).alias("text"), shown.alias("shown_bytes"), (F.col("page_num") % 5 < 2).alias("full_page_image"))
    kept = F.filter(F.transform(F.split("text", "\r?\n"), T.collapse), lambda t: t != "")
    font = F.when((F.col("seq") == 0) & (F.col("page_num") % 3 == 0), 14.0).otherwise(10.0).cast("float")
    rows = d.select("book_id", F.col("page_num").cast("int").alias("page_num"), F.posexplode(kept).alias("seq", "text"))
    runs = rows.select("book_id", "page_num", "seq", "text", font.alias("font_size"), F.lit(0.0).cast("float").alias("x"), F.lit(100.0).cast("float").alias("end_x"), (F.col("seq") * -12.0).cast("float").alias("y"))
    scanned = d.where("page_num % 2 = 0")
    return I.pages_books(pages, runs, scanned)[1]


@query("""
WITH c AS (SELECT conv_id, turn, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS number FROM conversations WHERE conv_id IS NOT NULL),
b AS (SELECT DISTINCT conv_id, CASE conv_id % 8 WHEN 3 THEN 'no_key' WHEN 4 THEN 'unknown_provider' WHEN 5 THEN 'refused' WHEN 6 THEN 'no_text' ELSE 'ok' END AS status FROM c)
SELECT conv_id::VARCHAR AS book_id, status, CASE WHEN status = 'refused' THEN 'too many' END AS error, CASE WHEN status = 'ok' THEN number END AS number, CASE WHEN status = 'ok' THEN 'Turn ' || turn END AS title,
       CASE WHEN status = 'ok' THEN '<h1>Turn ' || turn || '</h1>' || chr(10) || '<p><img src="images/img' || lpad(number::VARCHAR, greatest(3, length(number::VARCHAR))::INT, '0') || '.png" alt="x"/></p>' || chr(10) END AS body,
       CASE WHEN status = 'ok' THEN 'p' || (number - 1) || '_img-0.png' END AS image
FROM c JOIN b USING (conv_id) WHERE status = 'ok' OR number = 1""")
def answer_imports(spark, sf):
    """Conversations as answers, a turn a page with a heading and an image; every eighth each lacks a key, a known provider, an answer or text."""
    turns = table(spark, sf, "conversations").where("conv_id IS NOT NULL")
    own = F.concat(F.lit("# Turn "), F.col("turn").cast("string"), F.lit("\n\n![x](img-0.png)"))
    text = F.when(F.col("conv_id") % 8 == 6, "  ").otherwise(own)
    images = F.when(F.col("conv_id") % 8 != 6, F.array(F.struct(F.lit("img-0.png").alias("id"), F.lit("data:image/png;base64,iVBORw0K").alias("image_base64"))))
    pages = turns.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", F.struct(text.alias("markdown"), images.alias("images")).alias("p")))).alias("rows"))
    kind = F.col("conv_id") % 8
    body = F.when(kind == 5, '{"message": "too many"}').otherwise(F.to_json(F.struct(F.transform("rows", lambda r: r["p"]).alias("pages"))))
    answers = pages.select(F.col("conv_id").cast("string").alias("book_id"), F.when(kind == 4, "other").otherwise("mistral").alias("provider"), F.when(kind == 3, " ").otherwise("k").alias("key"), F.when(kind == 5, 429).otherwise(200).alias("code"), body.alias("body"))
    rows, _, outcomes = I.answers_books(answers)
    chapters = rows.where("kind = 'chapter'").select("book_id", "number", "title", "body")
    shots = rows.where("kind = 'image'").select("book_id", "number", F.col("body").alias("image"))
    return outcomes.join(chapters.join(shots, ["book_id", "number"], "left"), "book_id", "left")
