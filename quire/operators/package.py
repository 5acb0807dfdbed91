"""Package documents: what they say, what is outdated in them, and how they are rewritten.

Decisions are made on rows (manifest items, elements); one pass over the markup carries them out,
leaving every byte that isn't concerned as it was.
"""

from __future__ import annotations

import xml.etree.ElementTree as ET

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quire.functions import predicates as P
from quire.functions import text as T
from quire.functions.events import events, tag

#: Rendition properties and prefixes that are out of date.
OLD_PROPERTIES = ("rendition:flow", "rendition:orientation", "rendition:spread", "rendition:align-x-center")
OLD_PREFIXES = ("xsd", "msv", "prism")
DC, DCTERMS = "http://purl.org/dc/elements/1.1/", "http://purl.org/dc/terms/"
CONTAINER = "META-INF/container.xml"


def package_path(container_xml) -> Column:
    """The package document that a container names first."""
    return F.nullif(F.xpath_string(T.strip_doctype(container_xml), F.lit("//*[local-name()='rootfile']/@full-path")), F.lit(""))


INFO = (
    "struct<version:string, unique_identifier:string, prefix:string, cover_id:string, nav_exists:boolean, ncx_href:string, has_guide:boolean, "
    "items:array<struct<id:string,href:string,media_type:string,properties:string,fallback:string>>, guide:array<struct<ref_type:string,href:string,title:string>>, "
    "elements:array<struct<ord:int,tag:string,elem_id:string,refines:string,property:string,name:string,content:string,scheme:string,role:string,file_as:string,text:string>>, error:string>"
)


def _local(x: str) -> str:
    return x.rpartition("}")[2]


def _attr(node, name: str):
    return next((v for k, v in node.attrib.items() if _local(k) == name), None)


def info_of(xml: str | None) -> dict | None:
    """What a package document says; a broken one gives only ``error``."""
    if xml is None:
        return None
    try:
        root = ET.fromstring(xml.encode())
    except ET.ParseError as e:
        return {"error": f"not well-formed: {e}"}
    nodes = [n for n in root.iter() if isinstance(n.tag, str)]
    named = lambda name: [n for n in nodes if _local(n.tag) == name]
    metadata = next(iter(named("metadata")), None)
    elements = []
    for i, n in enumerate(c for c in (metadata if metadata is not None else ()) if isinstance(c.tag, str)):
        a = n.attrib.get
        elements.append({"ord": i, "tag": _local(n.tag), "elem_id": a("id"), "refines": a("refines"), "property": a("property"), "name": a("name"), "content": a("content"), "scheme": _attr(n, "scheme"), "role": _attr(n, "role"), "file_as": _attr(n, "file-as"), "text": (n.text or "").strip() or None})
    manifest = next(iter(named("manifest")), None)
    items = [{"id": n.get("id", ""), "href": n.get("href", ""), "media_type": n.get("media-type", ""), "properties": n.get("properties"), "fallback": n.get("fallback")} for n in (manifest if manifest is not None else ()) if isinstance(n.tag, str) and _local(n.tag) == "item"]
    guide = named("guide")
    return {
        "version": root.get("version"),
        "unique_identifier": root.get("unique-identifier", ""),
        "prefix": root.get("prefix"),
        "cover_id": next((e["content"] for e in elements if e["tag"] == "meta" and e["name"] == "cover"), None),
        "nav_exists": any("nav" in (i["properties"] or "").split() for i in items),
        "ncx_href": next((i["href"] for i in reversed(items) if i["media_type"] == "application/x-dtbncx+xml"), None),
        "has_guide": bool(guide),
        "items": items,
        "guide": [{"ref_type": n.get("type", ""), "href": n.get("href", ""), "title": n.get("title", "")} for g in guide for n in g if isinstance(n.tag, str) and _local(n.tag) == "reference"],
        "elements": elements,
        "error": None,
    }


_FIELDS = ("version", "unique_identifier", "prefix", "cover_id", "nav_exists", "ncx_href", "has_guide", "items", "guide", "elements", "error")


def info(xml) -> Column:
    """A struct of all that ``info_of`` finds."""

    def run(s: pd.Series) -> pd.DataFrame:
        found = [info_of(v) or {} for v in s]
        return pd.DataFrame({f: pd.Series([x.get(f) for x in found], dtype=object) for f in _FIELDS})

    return F.pandas_udf(run, INFO)(T._c(xml))


def outdated(elements: DataFrame) -> DataFrame:
    """(book_id, features): what is out of date, each once, in document order.

    elements: (book_id, ord, tag, property, fallback, prefix), all of a document's elements.
    """
    prefixes = F.filter(F.split(F.coalesce("prefix", F.lit("")), "(?U)\\s+"), lambda t: t.isin(*(f"{p}:" for p in OLD_PREFIXES)))
    found = (
        F.when((F.col("tag") == "item") & F.col("fallback").isNotNull(), F.array(F.lit("manifest content fallback (`fallback` attribute)")))
        .when((F.col("tag") == "meta") & F.col("property").isin(*OLD_PROPERTIES), F.array(F.concat(F.lit("outdated rendition property `"), "property", F.lit("`"))))
        .when(F.col("tag") == "collection", F.array(F.lit("`collection` element")))
        .when(F.col("tag") == "package", F.transform(prefixes, lambda t: F.concat(F.lit("deprecated reserved prefix `"), F.rtrim(t, F.lit(":")), F.lit("`"))))
    )
    late = (F.col("tag") == "package").cast("int")
    rows = elements.select("book_id", late.alias("late"), "ord", F.posexplode(found).alias("i", "feature"))
    ordered = F.array_sort(F.collect_list(F.struct("late", "ord", "i", "feature")))
    return rows.groupBy("book_id").agg(F.array_distinct(F.transform(ordered, lambda x: x["feature"])).alias("features"))


def page_break_source(elements: DataFrame) -> DataFrame:
    """(book_id, value): the source that page breaks come from, if no element says so already.

    The first ``source-of`` meta that reads pagebreak names a source by its id.
    """
    metas = elements.where(F.col("tag") == "meta")
    done = metas.where(F.col("property") == "pageBreakSource").select("book_id").distinct()
    says = (F.col("property") == "source-of") & (F.lower(F.trim("text")) == "pagebreak") & F.col("refines").isNotNull()
    first = metas.where(says).groupBy("book_id").agg(F.min_by(F.regexp_replace("refines", "^#+", ""), "ord").alias("elem_id"))
    sources = elements.where(F.col("tag") == "source").groupBy("book_id", "elem_id").agg(F.min_by("text", "ord").alias("value"))
    out = first.join(done, "book_id", "left_anti").join(sources, ["book_id", "elem_id"])
    return out.select("book_id", F.trim("value").alias("value")).where("value <> ''")


def overridden(base, overrides, missing=None) -> Column:
    """Attributes (maps) with some replaced or added, and others added only where they lack."""
    out = F.map_filter(T._c(base), lambda k, v: ~F.map_contains_key(T._c(overrides), k))
    out = F.map_concat(out, T._c(overrides))
    if missing is not None:
        out = F.map_concat(F.map_filter(T._c(missing), lambda k, v: ~F.map_contains_key(out, k)), out)
    return out


def manifest(items: DataFrame, changes: DataFrame) -> DataFrame:
    """Items (book_id, ord, id, href, media_type, properties) after an image run, with TrueType types mended.

    changes: (book_id, href, new_href, new_type, is_cover), one for an href.
    """
    rows = items.join(changes, ["book_id", "href"], "left")
    hit = F.col("new_href").isNotNull()
    font = ~hit & P.is_ttf("href") & P.needs_ttf_type("media_type")
    return rows.select(
        "book_id", "ord", "id", F.coalesce("new_href", "href").alias("href"),
        F.when(hit, F.col("new_type")).when(font, "font/ttf").otherwise(F.col("media_type")).alias("media_type"),
        F.when(hit & F.col("is_cover"), "cover-image").otherwise(F.col("properties")).alias("properties"),
    )


def reference_pairs(changes: DataFrame) -> DataFrame:
    """(book_id, pairs): old and new hrefs, raw and decoded, in order; the first of an old one counts.

    changes: (book_id, ord, href, new_href) with decoded new hrefs.
    """
    both = changes.select("book_id", "ord", "new_href", F.posexplode(F.array("href", T.unquote("href"))).alias("i", "old"))
    first = both.withColumn("n", F.row_number().over(Window.partitionBy("book_id", "old").orderBy("ord", "i"))).where("n = 1")
    pairs = F.array_sort(F.collect_list(F.struct("ord", "i", "old", F.col("new_href").alias("new"))))
    return first.groupBy("book_id").agg(F.transform(pairs, lambda p: F.struct(p["old"].alias("old"), p["new"].alias("new"))).alias("pairs"))


def rereferenced(content, pairs) -> Column:
    """Content with hrefs replaced in order: plain, quoted, then by name alone; as texts, wherever they stand."""

    def one(text, p):
        for f in (lambda x: x, T.quote, T.basename):
            text = F.replace(text, f(p["old"]), f(p["new"]))
        return text

    return F.aggregate(F.coalesce(T._c(pairs), F.array().cast("array<struct<old:string,new:string>>")), T._c(content), one)


def rewritten_of(xml: str, modified: str, page_break: str | None = None, add_nav: bool = False, drop_guide: bool = True, items: dict[str, dict[str, str]] | None = None) -> str:
    """A package document of version 3.0: name spaces, a fresh date, no guide, items as decided (by href)."""
    out: list[str] = []
    stack: list[str] = []
    skip = 0
    seen = False
    fresh = f'\n    <meta property="dcterms:modified">{modified}</meta>'
    for e in events(xml):
        if skip:
            skip += (e.kind == "start") - (e.kind == "end")
            continue
        name, inside = e.local, stack[-1] if stack else ""
        if e.kind in ("start", "empty"):
            stale = name == "meta" and "metadata" in stack and e.attributes().get("property") == "dcterms:modified"
            if (name == "guide" and drop_guide) or stale:
                skip = e.kind == "start"
                continue
            if name == "package":
                out.append(tag(e, {"version": "3.0"}))
            elif name == "metadata":
                seen = True
                out.append(tag(e, None, {"xmlns:dc": DC, "xmlns:dcterms": DCTERMS}))
            elif name == "item" and inside == "manifest" and (new := (items or {}).get(e.attributes().get("href", ""))):
                out.append(tag(e, new))
            else:
                out.append(e.raw)
            if e.kind == "start":
                stack.append(name)
            continue
        if e.kind == "end":
            if stack:
                stack.pop()
            if name == "metadata":
                out.append(fresh + (f'\n    <meta property="pageBreakSource">{_escaped(page_break)}</meta>' if page_break else "") + "\n  ")
            elif name == "manifest" and add_nav:
                out.append('\n    <item id="nav" href="nav.xhtml" media-type="application/xhtml+xml" properties="nav"/>\n  ')
            elif name == "package" and not seen:
                out.append(f'\n  <metadata xmlns:dc="{DC}" xmlns:dcterms="{DCTERMS}">{fresh}\n  </metadata>\n')
        out.append(e.raw)
    return "".join(out)


def _escaped(s: str) -> str:
    return s.replace("&", "&amp;").replace("<", "&lt;").replace(">", "&gt;")


def rewritten(xml, modified: str, page_break, add_nav, items) -> Column:
    """``rewritten_of`` as a column; items: map<href, map<attribute, value>>."""
    return F.pandas_udf(
        lambda x, p, n, i: pd.Series([None if a is None else rewritten_of(a, modified, b or None, bool(c), True, {k: dict(v) for k, v in (d or {}).items()}) for a, b, c, d in zip(x, p, n, i, strict=True)], dtype=object),
        "string",
    )(T._c(xml), T._c(page_break), T._c(add_nav), T._c(items))


def updated_of(xml: str, drop: set[int], fresh: list[tuple[str, str, str]]) -> str:
    """A package document without the metadata children of these numbers, and with fresh ones before the end.

    Raises ValueError where there is no metadata.
    """
    out, depth, number, skip, seen = [], 0, -1, 0, False
    for e in events(xml):
        if skip:
            skip += (e.kind == "start") - (e.kind == "end")
            continue
        if e.kind in ("start", "empty"):
            if depth == 1:
                number += 1
                if number in drop:
                    skip = e.kind == "start"
                    continue
            if e.kind == "start" and (depth or (e.local == "metadata" and not seen)):
                depth += 1
                seen = True
        elif e.kind == "end" and depth:
            depth -= 1
            if not depth:
                out.append("".join(f"\n    <{t}{' ' + a if a else ''}>{_escaped(v or '')}</{t}>" for t, a, v in fresh) + "\n  ")
        out.append(e.raw)
    if not seen:
        raise ValueError("no metadata element")
    return "".join(out)
