"""Whole imports: books out of pages that are read as text or drawn by operators, and out of an OCR service's answers.

A book that can't be made never stops the others: it has a status that says why.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.functions import predicates as P
from quire.functions import text as T
from quire.operators import geometry as G
from quire.operators import lookup as L
from quire.operators import markup as M
from quire.operators import structure as B

_PAGE = ["book_id", "page_num"]


# Pages


def page_blocks(pages: DataFrame, runs: DataFrame) -> DataFrame:
    """(book_id, page_num, seq, text): the lines of each page's text, white space collapsed and blank ones gone.

    Pages (book_id, page_num, text) without any have the paragraphs of their positioned runs (see
    ``geometry.runs``); those without runs either have no row. Null texts are empty.
    """
    kept = F.filter(F.transform(F.split(F.coalesce("text", F.lit("")), "\r?\n"), T.collapse), lambda t: t != "")
    lines = pages.select(*_PAGE, kept.alias("lines"))
    read = lines.select(*_PAGE, F.posexplode("lines").alias("seq", "text"))
    bare = lines.where(F.size("lines") == 0).select(*_PAGE)
    return read.unionByName(G.blocks(runs.join(bare, _PAGE, "left_semi")))


def page_signals(pages: DataFrame, runs: DataFrame) -> DataFrame:
    """(book_id, page_num, born_digital, big_font[, figures]) of pages (book_id, page_num, full_page_image, digital_book[, figures]).

    Large fonts count on pages that aren't images of pages, figures in books that are born digital.
    """
    digital = ~F.coalesce("full_page_image", F.lit(False))
    large = G.big_fonts(runs.join(pages.where(digital).select(*_PAGE), _PAGE, "left_semi"))
    out = pages.join(large, _PAGE, "left")
    figures = [F.when(F.col("digital_book"), F.col("figures")).alias("figures")] if "figures" in pages.columns else []
    return out.select(*_PAGE, digital.alias("born_digital"), F.coalesce("big_font", F.array().cast("array<string>")).alias("big_font"), *figures)


def pages_books(pages: DataFrame, runs: DataFrame, scanned: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(chapters, outcomes) of pages (book_id, page_num, text, shown_bytes, full_page_image[, figures]).

    runs: positioned runs of the pages. scanned: (book_id, page_num, text) that OCR has read of books
    without a text layer; their own texts and runs don't count. chapters are those of
    ``structure.book``, also of books that fail. outcomes: (book_id, tier, chapters, paragraphs,
    status); status is ok, unread_scan (OCR found nothing), undecoded_fonts (a text layer, but no page has
    a block), no_text (blocks, but nothing but page numbers and running heads) or not_prose (the paragraphs
    are mostly no letters). Every book of ``pages`` has one outcome; rows without a book are left out.
    """
    tiers = B.tiers(pages.where(F.col("book_id").isNotNull())).select("book_id", "tier", F.col("born_digital").alias("digital_book"))
    told = pages.join(tiers, "book_id")
    layered = told.where("tier = 'text_layer'")
    own_runs = runs.join(tiers.where("tier = 'text_layer'").select("book_id"), "book_id", "left_semi")
    blocks = page_blocks(layered, own_runs)
    if scanned is not None:
        seen = scanned.join(tiers.where("tier = 'scan'").select("book_id"), "book_id", "left_semi")
        blocks = blocks.unionByName(page_blocks(seen, runs.limit(0)))
    chapters = B.book(blocks, page_signals(layered, own_runs))
    paragraphs = F.transform(F.filter("blocks", lambda b: b["kind"] == "paragraph"), lambda b: b["text"])
    texts = chapters.select("book_id", F.size(paragraphs).alias("n"), F.array_join(paragraphs, " ").alias("text"))
    sums = texts.groupBy("book_id").agg(F.count(F.lit(1)).alias("chapters"), F.sum("n").alias("paragraphs"), F.sum(F.length(F.regexp_replace("text", "(?U)\\s", ""))).alias("solid"), F.sum(P.count_of("text", "\\p{IsAlphabetic}")).alias("letters"))
    whole = tiers.join(sums, "book_id", "left").join(blocks.select("book_id", F.lit(True).alias("has_blocks")).distinct(), "book_id", "left")
    bad = (F.col("solid") >= 50) & (F.col("letters").cast("float") < F.col("solid").cast("float") * F.lit(0.45).cast("float"))
    none = F.when(F.col("tier") == "scan", "unread_scan").when(F.col("has_blocks").isNull(), "undecoded_fonts").otherwise("no_text")
    status = F.when(F.col("chapters").isNull(), none).when(bad, "not_prose").otherwise("ok")
    return chapters, whole.select("book_id", "tier", F.coalesce("chapters", F.lit(0)).cast("long").alias("chapters"), F.coalesce("paragraphs", F.lit(0)).cast("long").alias("paragraphs"), status.alias("status"))


# Answers of an OCR service


@dataclass(frozen=True)
class Provider:
    label: str
    key: str


#: Services by their id, with the name that is shown and the variable that holds the key.
PROVIDERS = {"mistral": Provider("Mistral OCR", "MISTRAL_API_KEY")}


def answers_books(answers: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(rows, images, outcomes) of OCR answers (book_id, provider, key, code, body).

    rows: those of ``markup.markdown_books``; images: (book_id, path, data) that their pages brought.
    outcomes: (book_id, status, error); status is ok, unknown_provider, no_key (null or blank), refused (a
    code other than 200; error says what the answer does) or no_text. Rows without an id are left out.
    """
    known = F.coalesce(F.col("provider").isin(*PROVIDERS), F.lit(False))
    first = F.when(~known, "unknown_provider").when(T.non_blank("key").isNull(), "no_key").when(F.coalesce(F.col("code") != 200, F.lit(True)), "refused")
    asked = answers.where(F.col("book_id").isNotNull()).withColumn("status", first)
    read = L.stitched(asked.where("status IS NULL").select(F.col("book_id").alias("doc_id"), "body")).withColumnRenamed("doc_id", "book_id")
    read = read.withColumn("status", F.when(T.non_blank("markdown").isNull(), "no_text").otherwise("ok"))
    good = read.where("status = 'ok'")
    images = good.select("book_id", F.inline("images")).withColumnRenamed("name", "path")
    rows = M.markdown_books(good.select("book_id", F.lit("book.md").alias("path"), F.col("markdown").alias("text")), images)
    failed = asked.where("status IS NOT NULL").select("book_id", "status", F.when(F.col("status") == "refused", L.error_text("body")).alias("error"))
    return rows, images, failed.unionByName(read.select("book_id", "status", F.lit(None).cast("string").alias("error")))
