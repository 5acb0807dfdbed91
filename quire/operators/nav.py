"""Navigation documents out of trees of points and lists of landmarks.

Points are rows (book_id, node_id, parent_id, ord, title, href); a root's parent is null. Titles are
escaped.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.functions import text as T

#: Levels that are followed; a tree is walked level by level, each a join on the points' keys.
DEPTH = 32


def paths(points: DataFrame) -> DataFrame:
    """Adds depth (from 0) and path, the orders from the root down: sorted by it, points stand as they are read."""
    spark = points.sparkSession
    points.createOrReplaceTempView("quire_points")
    return spark.sql(
        f"""WITH RECURSIVE tree (book_id, node_id, title, href, depth, path) AS (
              SELECT book_id, node_id, title, href, 0, array(ord) FROM quire_points WHERE parent_id IS NULL
              UNION ALL
              SELECT p.book_id, p.node_id, p.title, p.href, t.depth + 1, array_append(t.path, p.ord)
              FROM quire_points p JOIN tree t ON p.book_id = t.book_id AND p.parent_id = t.node_id WHERE t.depth < {DEPTH})
            SELECT * FROM tree"""
    )


def outline(points: DataFrame) -> DataFrame:
    """(book_id, markup): the nested list of each book's points. Those without an href are spans."""
    tree = paths(points)
    title = T.xml_escape(F.coalesce(F.nullif(T.strip("title"), F.lit("")), F.lit("Untitled")))
    href = T.backslashes(F.coalesce("href", F.lit("")))
    item = F.when(href == "", F.concat(F.lit("<span>"), title, F.lit("</span>"))).otherwise(F.concat(F.lit('<a href="'), T.xml_escape(href), F.lit('">'), title, F.lit("</a>")))
    rows = tree.select("book_id", F.struct("path", "depth", item.alias("item")).alias("r")).groupBy("book_id").agg(F.array_sort(F.collect_list("r")).alias("rows"))

    def between(x, i):
        before = F.when(i > 0, F.col("rows")[F.greatest(i - 1, F.lit(0))]["depth"]).otherwise(F.lit(-1))
        opened = F.when(x["depth"] > before, "<ol><li>").otherwise(F.concat(F.repeat(F.lit("</li></ol>"), before - x["depth"]), F.lit("</li><li>")))
        return F.concat(opened, x["item"])

    last = F.element_at("rows", -1)["depth"]
    return rows.select("book_id", F.concat(F.array_join(F.transform("rows", between), ""), F.repeat(F.lit("</li></ol>"), last + 1)).alias("markup"))


def landmarks(guide: DataFrame) -> DataFrame:
    """(book_id, markup): a list of the guide's references (book_id, ord, ref_type, href, title)."""
    item = F.concat(F.lit('<li><a epub:type="'), T.xml_escape(T.landmark("ref_type")), F.lit('" href="'), T.xml_escape(T.backslashes("href")), F.lit('">'), T.xml_escape("title"), F.lit("</a></li>"))
    return guide.groupBy("book_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ord", item.alias("x")))), lambda r: r["x"]), "").alias("markup"))


def documents(books: DataFrame, points: DataFrame, guide: DataFrame) -> DataFrame:
    """(book_id, nav): the navigation document of each book (book_id, doc_title); untitled ones are a table of contents."""
    toc, marks = outline(points).withColumnRenamed("markup", "toc"), landmarks(guide).withColumnRenamed("markup", "marks")
    title = T.xml_escape(F.coalesce(F.nullif("doc_title", F.lit("")), F.lit("Table of Contents")))
    head = F.concat(
        F.lit('<?xml version="1.0" encoding="utf-8"?>\n<!DOCTYPE html>\n<html xmlns="http://www.w3.org/1999/xhtml" xmlns:epub="http://www.idpf.org/2007/ops" lang="en" xml:lang="en">\n<head><title>'),
        title, F.lit('</title><meta charset="utf-8" /></head>\n<body>\n<nav epub:type="toc" id="toc"><h1>'), title, F.lit("</h1>"),
    )
    list_ = F.coalesce("toc", F.lit("<p>No table of contents available.</p>"))
    extra = F.coalesce(F.concat(F.lit('\n<nav epub:type="landmarks" id="landmarks" hidden=""><h2>Guide Landmarks</h2><ol>'), "marks", F.lit("</ol></nav>")), F.lit(""))
    rows = books.join(toc, "book_id", "left").join(marks, "book_id", "left")
    return rows.select("book_id", F.concat(head, list_, F.lit("</nav>"), extra, F.lit("\n</body>\n</html>")).alias("nav"))
