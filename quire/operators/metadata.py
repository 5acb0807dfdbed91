"""Bibliographic metadata out of package elements, updates of it, and a language-aware merge.

Elements of a book's metadata are rows (book_id, ord, tag, elem_id, refines, property, name, content,
scheme, role, file_as, text) in document order; texts are trimmed and null if blank.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quire.functions import text as T


def _bare(x) -> Column:
    return F.regexp_replace(F.col(x), "^#+", "")


def refinements(elements: DataFrame) -> DataFrame:
    """(book_id, elem_id, property, value): the first text that refines an id by each property."""
    metas = elements.where((F.col("tag") == "meta") & F.col("refines").isNotNull() & F.col("property").isNotNull() & F.col("text").isNotNull())
    return metas.groupBy("book_id", _bare("refines").alias("elem_id"), "property").agg(F.min_by("text", "ord").alias("value"))


def legacy(elements: DataFrame) -> DataFrame:
    """(book_id, name, content): the last of each named pair."""
    return elements.where((F.col("tag") == "meta") & F.col("name").isNotNull() & F.col("content").isNotNull()).groupBy("book_id", "name").agg(F.max_by("content", "ord").alias("content"))


def refined(elements: DataFrame, *properties: str) -> DataFrame:
    """Elements with a column by_<property> for each property that refines them."""
    wide = refinements(elements).where(F.col("property").isin(*properties)).groupBy("book_id", "elem_id").agg(*(F.max(F.when(F.col("property") == p, F.col("value"))).alias(f"by_{p.replace('-', '_')}") for p in properties))
    return elements.join(wide, ["book_id", "elem_id"], "left")


def read(elements: DataFrame, packages: DataFrame) -> DataFrame:
    """One row for each package (book_id, version, unique_identifier): its metadata.

    Refinements come before attributes; of single values the first counts; a series is the first
    collection that is no set, else the legacy pair.
    """
    rows = refined(elements, "title-type", "role", "file-as", "identifier-type", "collection-type", "group-position")
    rows = rows.join(packages.select("book_id", "unique_identifier"), "book_id")
    is_tag = lambda *t: F.col("tag").isin(*t) & F.col("text").isNotNull()
    listed = lambda when, *what: F.transform(F.array_sort(F.collect_list(F.when(when, F.struct("ord", F.struct(*what).alias("v"))))), lambda x: x["v"])
    texts = lambda tag: F.transform(F.array_sort(F.collect_list(F.when(is_tag(tag), F.struct("ord", "text")))), lambda x: x["text"])
    first = lambda tag: F.min_by(F.when(is_tag(tag), F.col("text")), F.when(is_tag(tag), F.col("ord")))
    person = (F.col("text").alias("name"), F.coalesce("by_role", "role").alias("role"), F.coalesce("by_file_as", "file_as").alias("file_as"))
    series = is_tag("meta") & (F.col("property") == "belongs-to-collection") & (F.coalesce("by_collection_type", F.lit("")) != "set")
    modified = is_tag("meta") & F.col("refines").isNull() & (F.col("property") == "dcterms:modified")
    unique = F.coalesce((F.col("unique_identifier") != "") & (F.col("elem_id") == F.col("unique_identifier")), F.lit(False))
    out = rows.groupBy("book_id").agg(
        listed(is_tag("title"), F.col("text").alias("value"), F.col("by_title_type").alias("title_type")).alias("titles"),
        listed(is_tag("creator"), *person).alias("creators"),
        listed(is_tag("contributor"), *person).alias("contributors"),
        texts("language").alias("languages"),
        listed(is_tag("identifier"), F.col("text").alias("value"), F.coalesce("by_identifier_type", "scheme").alias("scheme"), unique.alias("unique")).alias("identifiers"),
        *(first(t).alias(t) for t in ("source", "publisher", "date", "description", "rights")),
        texts("subject").alias("subjects"),
        F.min_by(F.when(modified, F.col("text")), F.when(modified, F.col("ord"))).alias("modified"),
        F.min_by(F.when(series, F.struct(F.col("text").alias("name"), F.col("by_group_position").alias("position"))), F.when(series, F.col("ord"))).alias("_series"),
    )
    old = legacy(elements).where(F.col("name").isin("calibre:series", "calibre:series_index")).groupBy("book_id").agg(F.max(F.when(F.col("name") == "calibre:series", F.col("content"))).alias("old_name"), F.max(F.when(F.col("name") == "calibre:series_index", F.col("content"))).alias("old_position"))
    out = packages.select("book_id", F.col("version").alias("epub_version")).join(out, "book_id", "left").join(old, "book_id", "left")
    pair = F.when(F.col("old_name").isNotNull(), F.struct(F.col("old_name").alias("name"), F.col("old_position").alias("position")))
    return out.withColumn("series", F.coalesce("_series", pair)).drop("_series", "old_name", "old_position")


def form(md: DataFrame) -> DataFrame:
    """The flat fields of a form: main title and subtitle, authors, first language, an ISBN from scheme, id or source."""
    sub = lambda t: F.coalesce(t["title_type"] == "subtitle", F.lit(False))
    urn = lambda x: F.when(x.startswith("urn:isbn:"), F.substring(x, 10, 1 << 30))
    numbers = F.filter(F.transform("identifiers", lambda i: F.when(F.coalesce(F.lower(i["scheme"]) == "isbn", F.lit(False)), i["value"]).otherwise(urn(i["value"]))), lambda v: v.isNotNull())
    return md.select(
        "book_id",
        F.get(F.filter("titles", lambda t: ~sub(t)), F.lit(0))["value"].alias("title"),
        F.get(F.filter("titles", sub), F.lit(0))["value"].alias("subtitle"),
        F.array_join(F.transform("creators", lambda c: c["name"]), ", ").alias("authors"),
        F.get("languages", F.lit(0)).alias("language"),
        F.coalesce(F.get(numbers, F.lit(0)), urn(F.col("source"))).alias("isbn"),
    )


#: Fields of an update that replace all elements of one tag.
REPLACED = {"authors": "creator", "language": "language", "publisher": "publisher", "date": "date", "description": "description", "subjects": "subject"}


def dropped(elements: DataFrame, updates: DataFrame) -> DataFrame:
    """(book_id, ord): elements that an update replaces, and what refines them.

    updates: (book_id, title, subtitle, authors, language, publisher, date, description, subjects,
    series struct<name, position>, isbn); null leaves a field. Titles go by their type (main unless
    it is refined), identifiers only if an update wrote them, the modification date always.
    """
    kinds = elements.where((F.col("tag") == "meta") & (F.col("property") == "title-type") & F.col("refines").isNotNull() & F.col("text").isNotNull()).groupBy("book_id", _bare("refines").alias("elem_id")).agg(F.max_by("text", "ord").alias("kind"))
    rows = elements.join(kinds, ["book_id", "elem_id"], "left").join(updates, "book_id")
    tag = F.col("tag")
    is_sub = F.coalesce(F.col("kind") == "subtitle", F.lit(False))
    title = (tag == "title") & F.when(is_sub, F.col("u_subtitle").isNotNull()).otherwise(F.col("u_title").isNotNull())
    whole = F.lit(False)
    for field, name in REPLACED.items():
        whole = whole | ((tag == name) & F.col(f"u_{field}").isNotNull())
    number = (tag == "identifier") & (F.col("elem_id") == "gen-isbn") & F.col("u_isbn").isNotNull()
    collection = (tag == "meta") & (F.col("property") == "belongs-to-collection") & F.col("u_series").isNotNull()
    old_series = (tag == "meta") & F.col("name").isin("calibre:series", "calibre:series_index") & F.col("u_series").isNotNull()
    stale = (tag == "meta") & (F.col("property") == "dcterms:modified")
    go = [F.coalesce(x, F.lit(False)) for x in (title, whole, number, collection, old_series, stale)]
    direct = rows.where(go[0] | go[1] | go[2] | go[3] | go[4] | go[5])
    ids = rows.where((go[0] | ((tag == "creator") & go[1]) | go[3]) & F.col("elem_id").isNotNull()).select("book_id", F.col("elem_id").alias("_id")).distinct()
    followers = elements.where((tag == "meta") & F.col("refines").isNotNull()).withColumn("_id", _bare("refines")).join(ids, ["book_id", "_id"], "left_semi")
    return direct.select("book_id", "ord").unionByName(followers.select("book_id", "ord")).distinct()


def named_updates(updates: DataFrame) -> DataFrame:
    """Updates with their fields under u_ names, as ``dropped`` and ``written`` take them."""
    return updates.select("book_id", *(F.col(c).alias(f"u_{c}") for c in updates.columns if c != "book_id"))


def injected(updates: DataFrame, modified: str) -> DataFrame:
    """(book_id, seq, tag, attrs, text): the fresh elements of an update, in the order they are written."""
    def el(when, tag, attrs, text):
        return F.when(when, F.array(F.struct(F.lit(tag).alias("tag"), (attrs if isinstance(attrs, Column) else F.lit(attrs)).alias("attrs"), text.cast("string").alias("text")))).otherwise(F.array().cast("array<struct<tag:string,attrs:string,text:string>>"))

    u = lambda c: F.col(f"u_{c}")
    has = lambda c: u(c).isNotNull()
    one = lambda tag, attrs, text: F.struct(F.lit(tag).alias("tag"), attrs.alias("attrs"), text.cast("string").alias("text"))
    person = lambda a, i: F.array(
        one("dc:creator", F.concat(F.lit('id="gen-creator-'), i.cast("string"), F.lit('"')), a),
        one("meta", F.concat(F.lit('refines="#gen-creator-'), i.cast("string"), F.lit('" property="role" scheme="marc:relators"')), F.lit("aut")),
        one("meta", F.concat(F.lit('refines="#gen-creator-'), i.cast("string"), F.lit('" property="display-seq"')), i + 1),
    )
    none = F.array().cast("array<struct<tag:string,attrs:string,text:string>>")
    parts = F.concat(
        el(has("title"), "dc:title", 'id="gen-title"', u("title")),
        el(has("title"), "meta", 'refines="#gen-title" property="title-type"', F.lit("main")),
        el(has("subtitle"), "dc:title", 'id="gen-subtitle"', u("subtitle")),
        el(has("subtitle"), "meta", 'refines="#gen-subtitle" property="title-type"', F.lit("subtitle")),
        F.coalesce(F.flatten(F.transform(u("authors"), person)), none),
        *(el(has(c), f"dc:{c}", "", u(c)) for c in ("language", "publisher", "date", "description")),
        F.coalesce(F.transform(u("subjects"), lambda s: one("dc:subject", F.lit(""), s)), none),
        el(has("isbn"), "dc:identifier", 'id="gen-isbn"', F.concat(F.lit("urn:isbn:"), u("isbn"))),
        el(has("series"), "meta", 'property="belongs-to-collection" id="gen-series"', u("series")["name"]),
        el(has("series"), "meta", 'refines="#gen-series" property="collection-type"', F.lit("series")),
        el(u("series")["position"].isNotNull(), "meta", 'refines="#gen-series" property="group-position"', u("series")["position"]),
        el(F.lit(True), "meta", 'property="dcterms:modified"', F.lit(modified)),
    )
    return updates.select("book_id", F.posexplode(parts).alias("seq", "e")).select("book_id", "seq", "e.tag", "e.attrs", "e.text")


def written(elements: DataFrame, updates: DataFrame, modified: str) -> DataFrame:
    """(book_id, pos, tag, text): each book's elements after an update: those that stay in order, then the fresh ones."""
    stay = elements.join(dropped(elements, updates), ["book_id", "ord"], "left_anti").select("book_id", F.lit(0).alias("fresh"), F.col("ord").cast("int").alias("n"), F.col("tag"), "text")
    new = injected(updates, modified).select("book_id", F.lit(1).alias("fresh"), F.col("seq").alias("n"), T.local_name("tag").alias("tag"), "text")
    pos = F.row_number().over(Window.partitionBy("book_id").orderBy("fresh", "n"))
    return stay.unionByName(new).select("book_id", pos.cast("long").alias("pos"), "tag", "text")


def updated(packages: DataFrame, updates: DataFrame, modified: str) -> DataFrame:
    """(book_id, xml): the package documents (book_id, xml, info) of books after their update.

    updates: as ``dropped`` takes them, before their fields are named u_. Books without an update
    are not returned; one whose package has no metadata gets null.
    """
    from . import package

    named = named_updates(updates)
    elements = packages.select("book_id", F.inline("info.elements"))
    gone = dropped(elements, named).groupBy("book_id").agg(F.collect_set("ord").alias("gone"))
    fresh = injected(named, modified).groupBy("book_id").agg(F.array_sort(F.collect_list(F.struct("seq", "tag", "attrs", "text"))).alias("fresh"))

    def run(xml: pd.Series, drop: pd.Series, new: pd.Series) -> pd.Series:
        out = []
        for x, d, n in zip(xml, drop, new, strict=True):
            try:
                out.append(package.updated_of(x, set(() if d is None else map(int, d)), [(v["tag"], v["attrs"], v["text"]) for v in n]))
            except ValueError:
                out.append(None)
        return pd.Series(out, dtype=object)

    rows = packages.select("book_id", "xml").join(fresh, "book_id").join(gone, "book_id", "left")
    return rows.select("book_id", F.pandas_udf(run, "string")("xml", "gone", "fresh").alias("xml"))


#: Fields in the order they are considered, with what decides whether their language fits.
MERGED = (("title", "edition"), ("subtitle", "edition"), ("authors", "edition"), ("publisher", "edition"), ("date", "any"), ("isbn", "any"), ("subjects", "work"), ("description", "work"))


def merge_plan(pairs: DataFrame) -> DataFrame:
    """(book_id, pos, field, decision, value): what a lookup would fill in.

    pairs: book_id, lang (of the book; null: status no_language), edition_language, has_<field>
    booleans, new_<field> strings (null: nothing found), overwrite, allow_foreign, with_description.
    Decisions: set, already_set, language_mismatch, omitted. Edition fields need the edition's
    language to be the book's or unknown; works' fields an English book; or foreign ones allowed.
    """
    book = T.primary_subtag("lang")
    edition = F.col("edition_language").isNull() | (T.primary_subtag("edition_language") == book) | F.col("allow_foreign")
    fits = {"edition": edition, "work": (book == "en") | F.col("allow_foreign"), "any": F.lit(True)}

    def row(i, field, kind):
        decision = F.when(F.col(f"has_{field}") & ~F.col("overwrite"), "already_set").when(~fits[kind], "language_mismatch").otherwise("set")
        if field == "description":
            decision = F.when(~F.col("with_description"), "omitted").otherwise(decision)
        return F.struct(F.lit(i).cast("long").alias("pos"), F.lit(field).alias("field"), decision.alias("decision"), F.col(f"new_{field}").alias("value"))

    rows = F.array(*(row(i, f, k) for i, (f, k) in enumerate(MERGED)))
    out = pairs.where(F.col("lang").isNotNull()).select("book_id", F.explode(rows).alias("r")).select("book_id", "r.*")
    return out.where(F.col("value").isNotNull()).withColumn("value", F.when(F.col("decision") == "set", F.col("value")))


def as_text(md: DataFrame) -> DataFrame:
    """(book_id, text): a table of what is there, labels padded to 14 characters."""
    line = lambda label, v: F.when(v.isNotNull(), F.concat(F.rpad(F.lit(label), 14, " "), v))
    some = lambda label, v: F.transform(v, lambda x: F.concat(F.rpad(F.lit(label), 14, " "), x))
    extras = lambda c: F.array_join(F.array_compact(F.array(c["role"], F.concat(F.lit("file-as: "), c["file_as"]))), "; ")
    person = lambda c: F.when(extras(c) == "", c["name"]).otherwise(F.concat(c["name"], F.lit("  ["), extras(c), F.lit("]")))
    label = lambda t: F.when(t == "subtitle", "Subtitle:").when(t == "short", "Short title:").when(t == "collection", "Collection:").when(t == "edition", "Edition:").when(t == "expanded", "Full title:").otherwise("Title:")
    titles = F.transform("titles", lambda t: F.concat(F.rpad(label(F.coalesce(t["title_type"], F.lit(""))), 14, " "), t["value"]))
    joined = lambda c: F.nullif(F.array_join(F.coalesce(F.col(c), F.array().cast("array<string>")), ", "), F.lit(""))
    series = F.when(F.col("series.position").isNotNull(), F.concat(F.col("series.name"), F.lit(" (#"), F.col("series.position"), F.lit(")"))).otherwise(F.col("series.name"))
    none = F.array().cast("array<string>")
    parts = F.concat(
        F.array(line("EPUB version:", F.col("epub_version"))),
        F.coalesce(titles, none),
        F.coalesce(some("Author:", F.transform("creators", person)), none),
        F.coalesce(some("Contributor:", F.transform("contributors", person)), none),
        F.array(line("Language:", joined("languages"))),
        F.coalesce(some("Identifier:", F.transform("identifiers", lambda i: i["value"])), none),
        F.array(line("Source:", F.col("source")), line("Publisher:", F.col("publisher")), line("Date:", F.col("date")), line("Series:", series), line("Subjects:", joined("subjects")), line("Description:", T.clipped(T.collapse("description"), 200)), line("Rights:", F.col("rights")), line("Modified:", F.col("modified"))),
    )
    text = F.array_join(F.array_compact(parts), "\n")
    return md.select("book_id", F.concat(F.when(text == "", "(no metadata found)").otherwise(text), F.lit("\n")).alias("text"))


def as_json(md: DataFrame) -> DataFrame:
    """(book_id, json): all fields in one order, nulls included."""
    fields = [c for c in md.columns if c != "book_id"]
    return md.select("book_id", F.to_json(F.struct(*fields), {"ignoreNullFields": "false"}).alias("json"))

