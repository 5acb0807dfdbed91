"""Books out of pages: running heads, headings, chapters, and what kind of input a book is.

Blocks are rows (book_id, page_num, seq, text); a book's order is (page_num, seq). Windows run over
one book, the unit that the library is partitioned by; counts are aggregated before they are joined.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quire.functions import predicates as P
from quire.functions import text as T

#: Bytes of body text that make a heading a chapter's.
CHAPTER_BYTES = 400


def recurring(blocks: DataFrame) -> DataFrame:
    """(book_id, template, n): templates of pages' first and last blocks that recur on 1/30 of the pages, five at least.

    A page of one block counts it once. Templates of up to three bytes don't count.
    """
    pages = blocks.groupBy("book_id", "page_num").agg(F.min(F.struct("seq", "text")).alias("a"), F.max(F.struct("seq", "text")).alias("b"), F.count(F.lit(1)).alias("n"))
    least = pages.groupBy("book_id").agg(F.greatest(F.lit(5), F.floor(F.count(F.lit(1)) / 30)).alias("least"))
    ends = F.when(F.col("n") > 1, F.array("a.text", "b.text")).otherwise(F.array("a.text"))
    counted = pages.select("book_id", F.explode(ends).alias("text")).groupBy("book_id", T.template("text").alias("template")).agg(F.count(F.lit(1)).alias("n"))
    return counted.join(least, "book_id").where((F.octet_length("template") > 3) & (F.col("n") >= F.col("least"))).select("book_id", "template", "n")


def cleaned(blocks: DataFrame) -> DataFrame:
    """Blocks without page numbers and running heads, hyphens and white space mended, empty ones gone."""
    heads = recurring(blocks).select("book_id", "template")
    kept = blocks.where(~P.is_page_number("text")).withColumn("template", T.template("text")).join(heads, ["book_id", "template"], "left_anti")
    return kept.drop("template").withColumn("text", T.dehyphenated("text")).where(F.col("text") != "")


def _order(*more) -> Window:
    return Window.partitionBy("book_id").orderBy("page_num", "seq", *more)


def chapterized(items: DataFrame, least: int = CHAPTER_BYTES) -> DataFrame:
    """Adds heading (boolean), promoted (boolean) and chapter (from 0) to items (book_id, page_num, seq, kind, text).

    kind: heading, body or figure. A heading is a chapter's title if the body up to the next heading
    has ``least`` bytes; else it is a paragraph of the chapter before. Chapter 0 is what comes first.
    """
    is_head = F.col("kind") == "heading"
    island = F.sum(is_head.cast("int")).over(_order().rowsBetween(Window.unboundedPreceding, 0))
    items = items.withColumn("_island", island)
    body = F.sum(F.when(F.col("kind") == "body", F.octet_length("text")).otherwise(0)).over(Window.partitionBy("book_id", "_island"))
    items = items.withColumn("promoted", is_head & (body >= least))
    chapter = F.sum(F.col("promoted").cast("int")).over(_order().rowsBetween(Window.unboundedPreceding, 0))
    return items.withColumn("chapter", chapter).drop("_island")


def book(blocks: DataFrame, pages: DataFrame | None = None) -> DataFrame:
    """(book_id, chapter, title, paragraphs): the chapters of each book that have a title or a block.

    pages: (book_id, page_num, born_digital, big_font array<string>, figures array<struct<data, media_type, ext>>);
    a page's figures follow its text. Adds figures, (page_num, number in the page) of each.
    """
    kept = cleaned(blocks)
    if pages is not None:
        kept = kept.join(pages.select("book_id", "page_num", "born_digital", "big_font"), ["book_id", "page_num"], "left")
        head = P.is_heading("text", F.coalesce("born_digital", F.lit(False)), F.coalesce("big_font", F.array().cast("array<string>")))
    else:
        head = P.is_heading("text")
    items = kept.select("book_id", "page_num", "seq", F.when(head, "heading").otherwise("body").alias("kind"), "text")
    if pages is not None and "figures" in pages.columns:
        figures = pages.select("book_id", "page_num", F.posexplode("figures").alias("i", "f"))
        items = items.unionByName(figures.select("book_id", "page_num", (F.lit(1 << 30) + F.col("i")).alias("seq"), F.lit("figure").alias("kind"), F.col("i").cast("string").alias("text")))
    rows = chapterized(items)
    order = F.struct("page_num", "seq", F.when(F.col("kind") == "figure", "figure").otherwise("paragraph").alias("kind"), "text")
    chapters = rows.groupBy("book_id", "chapter").agg(
        F.max(F.when(F.col("promoted"), F.col("text"))).alias("title"),
        F.array_sort(F.collect_list(F.when(~F.col("promoted"), order))).alias("blocks"),
    )
    out = chapters.where(F.col("title").isNotNull() | (F.size("blocks") > 0))
    return out.select("book_id", "chapter", "title", F.transform("blocks", lambda b: F.struct(b["kind"].alias("kind"), b["text"].alias("text"), b["page_num"].alias("page_num"))).alias("blocks"))


def rendered(chapters: DataFrame) -> DataFrame:
    """(book_id, number, title, body): XHTML of each chapter; untitled ones are ``Section n``."""
    number = F.row_number().over(Window.partitionBy("book_id").orderBy("chapter"))
    rows = chapters.withColumn("number", number).withColumn("title", F.coalesce("title", F.concat(F.lit("Section "), F.col("number").cast("string"))))
    figures = F.coalesce(F.sum(F.size(F.filter("blocks", lambda b: b["kind"] == "figure"))).over(Window.partitionBy("book_id").orderBy("chapter").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    rows = rows.withColumn("_before", figures)

    def block(b: Column, i: Column) -> Column:
        nth = F.size(F.filter(F.slice(F.col("blocks"), 1, i + 1), lambda x: x["kind"] == "figure")) + F.col("_before")
        figure = F.concat(F.lit('<div class="figure"><img src="images/fig'), F.lpad(nth.cast("string"), 3, "0"), F.lit('" alt=""/></div>\n'))
        return F.when(b["kind"] == "figure", figure).otherwise(F.concat(F.lit("<p>"), T.xml_escape(b["text"]), F.lit("</p>\n")))

    body = F.concat(F.lit("<h1>"), T.xml_escape("title"), F.lit("</h1>\n"), F.array_join(F.transform("blocks", block), ""))
    return rows.select("book_id", F.col("number").cast("long").alias("number"), "title", body.alias("body"))


def tiers(pages: DataFrame) -> DataFrame:
    """(book_id, pages, with_text, scans, tier, born_digital) of pages (shown_bytes, full_page_image boolean).

    A text layer needs text on half of the pages; a book is born digital if fewer than half are scans.
    """
    votes = pages.groupBy("book_id").agg(F.count("page_num").alias("pages"), F.count_if(P.has_text_layer("shown_bytes") & F.col("page_num").isNotNull()).alias("with_text"), F.count_if(F.col("full_page_image")).alias("scans"))
    layer = (F.col("pages") > 0) & (2 * F.col("with_text") >= F.col("pages"))
    return votes.select("*", F.when(layer, "text_layer").otherwise("scan").alias("tier"), ((F.col("pages") > 0) & (2 * F.col("scans") < F.col("pages"))).alias("born_digital"))


def imported(blocks: DataFrame) -> DataFrame:
    """(book_id, chapters, paragraphs, status): what an import makes of each book; a book's failure is a status, never an error."""
    texts = blocks.groupBy("book_id").agg(F.count_if(T.collapse("text") != "").alias("with_text"), F.sum(F.length(F.regexp_replace("text", "(?U)\\s", ""))).alias("solid"), F.sum(P.count_of("text", "\\p{IsAlphabetic}")).alias("letters"))
    chapters = book(blocks).groupBy("book_id").agg(F.count(F.lit(1)).alias("chapters"), F.sum(F.size("blocks")).alias("paragraphs"))
    bad = (F.col("solid") >= 50) & (F.col("letters").cast("float") < F.col("solid").cast("float") * F.lit(0.45).cast("float"))
    status = F.when(F.col("with_text") == 0, "no_text").when(F.col("chapters").isNull(), "nothing_left").when(bad, "not_prose").otherwise("ok")
    return texts.join(chapters, "book_id", "left").select("book_id", F.coalesce("chapters", F.lit(0)).cast("long").alias("chapters"), F.coalesce("paragraphs", F.lit(0)).cast("long").alias("paragraphs"), status.alias("status"))


def numbered_segments(blocks: DataFrame) -> DataFrame:
    """(book_id, para, seg, text): sentences of text blocks, numbered from 1 within paragraphs.

    Blocks are rows (book_id, page_num, seq, opens, text); ``opens`` block elements are opened before
    the text. Text before any block is paragraph 1. Blank texts make no segments.
    """
    para = F.sum("opens").over(_order().rowsBetween(Window.unboundedPreceding, 0))
    rows = blocks.withColumn("para", F.greatest(para, F.lit(1)))
    cut = rows.where(T.strip("text") != "").select("book_id", "page_num", "seq", "para", F.posexplode(T.sentences("text")).alias("i", "text"))
    seg = F.row_number().over(Window.partitionBy("book_id", "para").orderBy("page_num", "seq", "i"))
    return cut.select("book_id", F.col("para").cast("long").alias("para"), seg.cast("long").alias("seg"), "text")
