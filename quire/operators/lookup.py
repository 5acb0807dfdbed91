"""Catalogue records: answers of two providers as rows of one shape, and OCR answers stitched.

The engine asks nobody: answers come as a table (provider, isbn, kind, body). ``Transport`` is what a
program that does ask has to offer.
"""

from __future__ import annotations

from typing import Protocol

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.functions import numbers as N
from quire.functions import text as T


class Transport(Protocol):
    def get(self, url: str) -> str: ...


#: The names that each provider goes by.
PROVIDERS = {"openlibrary": "a", "ol": "a", "google": "b", "googlebooks": "b", "google-books": "b"}


def provider(name) -> Column:
    """a or b; null for an unknown provider."""
    return T.mapped(T._c(name), PROVIDERS)


def _text(v, path: str) -> Column:
    """A string at a path, trimmed; null if it is blank or no string."""
    return T.non_blank(F.try_variant_get(v, path, "string")) if path else T.non_blank(v)


def _named(found) -> Column:
    return F.filter(F.transform(F.coalesce(found, F.array().cast("array<struct<name:string>>")), lambda o: o["name"]), lambda n: n.isNotNull())


_A = "struct<title:string,subtitle:string,authors:array<struct<name:string>>,publishers:array<struct<name:string>>,publish_date:string,subjects:array<struct<name:string>>,identifiers:struct<isbn_13:array<string>>,cover:struct<large:string,medium:string>>"
_B = "struct<items:array<struct<volumeInfo:struct<title:string,subtitle:string,authors:array<string>,publisher:string,publishedDate:string,categories:array<string>,description:string,language:string,industryIdentifiers:array<struct<type:string,identifier:string>>,imageLinks:struct<thumbnail:string,smallThumbnail:string>>>>>"
_EDITION = "struct<languages:array<struct<key:string>>,works:array<struct<key:string>>>"
_WORK = "struct<description:string,subjects:array<string>>"


def view_a(body) -> Column:
    """A record of provider a: the first value of the answer's object; null where there is none."""
    first = F.get(F.map_values(F.from_json(T._c(body), f"map<string,{_A}>")), F.lit(0))
    return F.when(
        first.isNotNull(),
        F.struct(
            T.non_blank(first["title"]).alias("title"),
            T.non_blank(first["subtitle"]).alias("subtitle"),
            _named(first["authors"]).alias("authors"),
            F.get(_named(first["publishers"]), F.lit(0)).alias("publisher"),
            T.non_blank(first["publish_date"]).alias("date"),
            _named(first["subjects"]).alias("subjects"),
            F.get(first["identifiers"]["isbn_13"], F.lit(0)).alias("isbn13"),
            F.coalesce(first["cover"]["large"], first["cover"]["medium"]).alias("cover_url"),
        ),
    )


def edition(body) -> Column:
    """struct(language, work): an edition's first language by two letters, and its first work; nulls for broken JSON."""
    v = F.from_json(T._c(body), _EDITION)
    key = F.get(v["languages"], F.lit(0))["key"]
    return F.struct(T.language(F.regexp_replace(key, "^(/languages/)+", "")).alias("language"), F.get(v["works"], F.lit(0))["key"].alias("work"))


def work(body) -> Column:
    """struct(description, subjects) of a work; a description is a string or has a value."""
    v = F.from_json(T._c(body), _WORK)
    raw = v["description"]
    inner = F.get_json_object(raw, "$.value")
    return F.struct(F.when(F.ltrim(raw).startswith("{"), inner).otherwise(raw).alias("description"), F.coalesce(v["subjects"], F.array().cast("array<string>")).alias("subjects"))


def view_b(body, with_description: bool = True) -> Column:
    """A record of provider b: its first item; null where there is none."""
    info = F.get(F.from_json(T._c(body), _B)["items"], F.lit(0))["volumeInfo"]
    strings = lambda v: F.filter(F.transform(F.coalesce(v, F.array().cast("array<string>")), T.strip), lambda s: s != "")
    number = F.get(F.filter(info["industryIdentifiers"], lambda i: i["type"] == "ISBN_13"), F.lit(0))["identifier"]
    return F.when(
        info.isNotNull(),
        F.struct(
            T.non_blank(info["title"]).alias("title"),
            T.non_blank(info["subtitle"]).alias("subtitle"),
            strings(info["authors"]).alias("authors"),
            T.non_blank(info["publisher"]).alias("publisher"),
            T.non_blank(info["publishedDate"]).alias("date"),
            strings(info["categories"]).alias("subjects"),
            F.when(F.lit(with_description), T.non_blank(info["description"])).alias("description"),
            number.alias("isbn13"),
            F.coalesce(info["imageLinks"]["thumbnail"], info["imageLinks"]["smallThumbnail"]).alias("cover_url"),
            T.non_blank(info["language"]).alias("edition_language"),
        ),
    )


def fetched_a(answers: DataFrame, with_description: bool = True) -> DataFrame:
    """(isbn, record fields) of provider a's answers (isbn or work key as ``key``, kind view, edition or work, body).

    Works are only followed for a description; they fill in subjects where the view has none.
    """
    views = answers.where("kind = 'view'").select(F.col("key").alias("isbn"), view_a("body").alias("v")).where("v is not null").select("isbn", "v.*")
    editions = answers.where("kind = 'edition'").select(F.col("key").alias("isbn"), edition("body").alias("e")).select("isbn", F.col("e.language").alias("edition_language"), F.col("e.work").alias("work_key"))
    out = views.join(editions, "isbn", "left")
    if not with_description:
        return out.drop("work_key").withColumn("description", F.lit(None).cast("string"))
    works = answers.where("kind = 'work'").select(F.col("key").alias("work_key"), work("body").alias("w"))
    out = out.join(works, "work_key", "left")
    return out.withColumns({"description": F.col("w.description"), "subjects": F.when(F.size("subjects") > 0, F.col("subjects")).otherwise(F.coalesce("w.subjects", "subjects"))}).drop("w", "work_key")


def error_text(body) -> Column:
    """What an answer says went wrong: its message, detail or error, or its text; 300 characters."""
    said = F.coalesce(*(F.get_json_object(T._c(body), f"$.{k}") for k in ("message", "detail", "error")), T.strip(body))
    return T.clipped(said, 300)


_OCR = "struct<pages:array<struct<markdown:string,images:array<struct<id:string,image_base64:string>>>>>"


def stitched(answers: DataFrame) -> DataFrame:
    """(doc_id, markdown, images) of OCR answers (doc_id, body): pages in order with a blank line between.

    A page's images get the page's number before their name, and its links follow. Images without an
    id or that can't be decoded are left out. Markdown is null where there are no pages.
    """
    kept = lambda p, i: F.filter(
        F.transform(F.coalesce(p["images"], F.array().cast("array<struct<id:string,image_base64:string>>")), lambda m: F.struct(m["id"].alias("id"), F.concat(F.lit("p"), i.cast("string"), F.lit("_"), T.sanitize_image_id(m["id"])).alias("name"), N.data_uri(m["image_base64"]).alias("data"))),
        lambda m: (m["id"] != "") & m["data"].isNotNull(),
    )

    def linked(text, m):
        new = F.concat(F.lit("](./"), m["name"], F.lit(")"))
        return F.replace(F.replace(text, F.concat(F.lit("]("), m["id"], F.lit(")")), new), F.concat(F.lit("](./"), m["id"], F.lit(")")), new)

    pages = answers.select("doc_id", F.from_json("body", _OCR)["pages"].alias("pages"))
    pages = pages.withColumn("pages", F.transform("pages", lambda p, i: F.struct(F.coalesce(p["markdown"], F.lit("")).alias("text"), kept(p, i).alias("images"))))
    texts = F.transform("pages", lambda p: F.aggregate(p["images"], p["text"], linked))
    # Nothing stands between pages until some text has come.
    joined = F.aggregate(texts, F.lit(""), lambda a, t: F.concat(a, F.when(a != "", F.lit("\n\n")).otherwise(F.lit("")), t))
    images = F.flatten(F.transform("pages", lambda p: F.transform(p["images"], lambda m: F.struct(m["name"].alias("name"), m["data"].alias("data")))))
    return pages.select("doc_id", joined.alias("markdown"), images.alias("images"))
