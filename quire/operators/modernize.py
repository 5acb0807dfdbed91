"""A whole library brought up to date: images, references, navigation, markup and packages, stage by stage.

Entries are rows (book_id, ord, path, data). Every decision is a join or an aggregate over all books;
a book that can't be read gets an error and stays as it is.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.functions import predicates as P
from quire.functions import text as T
from quire.sources.containers import packages

from . import archive, images, markup, nav, package, report


@dataclass(frozen=True)
class Options:
    """quality: 1 to 100. target: 3.3 or 3.4. policy: fixed, auto or best (None: fixed for 3.3, auto for 3.4)."""

    quality: int = 80
    target: str = "3.3"
    policy: str | None = None
    fixed: str = "WebP"
    spans: bool = False
    modified: str = "2000-01-01T00:00:00Z"

    @property
    def images(self) -> str:
        return self.policy or ("auto" if self.target == "3.4" else "fixed")


def books(entries: DataFrame) -> DataFrame:
    """(book_id, opf, folder, info, error): the package of each book."""
    found = packages(entries).withColumn("info", package.info("xml"))
    problem = F.when(F.col("path").isNull(), "no package is named").when(F.col("xml").isNull(), "the package is missing").otherwise(F.col("info.error"))
    return found.select("book_id", F.col("path").alias("opf"), "xml", F.when(F.col("path").contains("/"), F.concat(T.dirname("path"), F.lit("/"))).otherwise("").alias("folder"), "info", problem.alias("error"))


def modernized(entries: DataFrame, options: Options = Options(), encoder: images.Encoder | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(entries, images, lint): the new entries in order, what became of each image, and what is out of date.

    lint: (book_id, feature), for 3.4 also documents in HTML syntax. Images go first, then references,
    so that navigation and packages carry the new names; spans come last.
    """
    every = books(entries)
    good = every.where("error IS NULL")
    rows = entries.join(good.select("book_id", "folder", "opf"), "book_id")
    local = rows.select("book_id", F.substring_index("path", "/", -1).alias("_n"), F.expr("substring(path, length(folder) + 1)").alias("path"), "data")
    items = good.select("book_id", "info.cover_id", F.posexplode("info.items").alias("ord", "i")).select("book_id", "cover_id", "ord", "i.id", "i.href", "i.media_type", "i.properties")
    shots = images.optimized(items, local, encoder, options.quality, options.images, options.fixed)
    changed = images.changes(shots)

    # Images: new bytes under new names.
    swaps = shots.where(~F.col("kept")).join(good.select("book_id", "folder"), "book_id")
    swaps = swaps.select("book_id", F.concat("folder", "path").alias("path"), F.concat("folder", "new_href").alias("new_path"), "new_data")
    rows = rows.join(swaps, ["book_id", "path"], "left").select("book_id", "ord", F.coalesce("new_path", "path").alias("path"), F.coalesce("new_data", "data").alias("data"), "folder", "opf")

    # Documents: references, document types, name spaces, spans.
    pairs = package.reference_pairs(changed)
    text = F.decode("data", "UTF-8")
    rows = rows.join(pairs, "book_id", "left")
    content = package.rereferenced(text, "pairs")
    document = T.xhtml_namespace(T.standard_doctype(content))
    if options.spans:
        document = markup.spans(document)
    # Python runs over documents only: the other rows go past it.
    docs = rows.where(P.is_document("path")).select("book_id", "ord", "path", document.cast("binary").alias("data"))
    refs = rows.where(P.is_referring("path") & ~P.is_document("path")).select("book_id", "ord", "path", content.cast("binary").alias("data"))
    rest = rows.where(~P.is_referring("path") & (F.col("path") != F.col("opf"))).select("book_id", "ord", "path", "data")

    # Packages: items as decided, a navigation document where there was none.
    new_items = package.manifest(items, changed.drop("ord").withColumn("new_href", T.quote("new_href")))
    old = items.select("book_id", "ord", F.col("href").alias("old"))
    differ = new_items.join(old, ["book_id", "ord"]).join(items.select("book_id", "ord", F.col("media_type").alias("old_type")), ["book_id", "ord"])
    differ = differ.where(~F.col("href").eqNullSafe(F.col("old")) | ~F.col("media_type").eqNullSafe(F.col("old_type")))
    attributes = F.map_filter(F.create_map(F.lit("href"), F.col("href"), F.lit("media-type"), F.col("media_type"), F.lit("properties"), F.when(F.col("properties") == "cover-image", F.col("properties"))), lambda k, v: v.isNotNull())
    decided = differ.groupBy("book_id").agg(F.map_from_entries(F.collect_list(F.struct("old", attributes.alias("a")))).alias("decided"))
    sources = package.page_break_source(_elements(good)) if options.target == "3.4" else good.limit(0).select("book_id", F.lit("").alias("value"))
    needs = good.where(~F.col("info.nav_exists") & F.col("info.ncx_href").isNotNull())
    navs = _navigation(needs, rows)
    made = navs.select("book_id", F.lit(True).alias("made"))
    opfs = good.join(decided, "book_id", "left").join(sources, "book_id", "left").join(made, "book_id", "left")
    none = F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<map<string,string>>"))
    new_xml = package.rewritten("xml", options.modified, "value", F.coalesce("made", F.lit(False)), F.coalesce("decided", none))
    opf_rows = opfs.select("book_id", F.lit(1 << 29).alias("ord"), F.col("opf").alias("path"), new_xml.cast("binary").alias("data"))
    nav_rows = navs.select("book_id", F.lit((1 << 29) + 1).alias("ord"), "path", F.col("nav").cast("binary").alias("data"))
    out = docs.unionByName(refs).unionByName(rest).unionByName(opf_rows).unionByName(nav_rows)
    bad = entries.join(every.where("error IS NOT NULL").select("book_id"), "book_id", "left_semi").select("book_id", "ord", "path", "data")

    lint = package.outdated(_features(good)).select("book_id", F.explode("features").alias("feature"))
    if options.target == "3.4":
        syntax = docs.where(P.has_html_syntax(F.decode("data", "UTF-8"))).select("book_id", F.concat(F.lit("content document `"), T.basename("path"), F.lit("` uses HTML syntax (EPUB 3.4 requires XHTML)")).alias("feature"))
        lint = lint.unionByName(syntax)
    return out.unionByName(bad), shots.drop("new_data"), lint


def restored(archives: DataFrame, options: Options | None = None, encoder: images.Encoder | None = None) -> tuple[DataFrame, DataFrame]:
    """(entries, errors) of archives (book_id, data): as they were packed, or made anew for a target if options are given.

    errors: (book_id, error) of archives that can't be read, and of books that can't be made anew; the latter's entries stay as they were.
    """
    found = archive.restored(archives)
    errors = found.where("error IS NOT NULL").select("book_id", "error")
    entries = found.where("error IS NULL").select("book_id", "ord", "path", "data")
    if options is None:
        return entries, errors
    return modernized(entries, options, encoder)[0], errors.unionByName(problems(entries))


def problems(entries: DataFrame) -> DataFrame:
    """(book_id, error) of books whose package can't be found or read."""
    every = entries.select("book_id").distinct()
    return every.join(books(entries).select("book_id", F.lit(True).alias("known"), "error"), "book_id", "left").select("book_id", F.when(F.col("known").isNull(), "no package is named").otherwise(F.col("error")).alias("error")).where("error IS NOT NULL")


def _elements(good: DataFrame) -> DataFrame:
    return good.select("book_id", F.inline("info.elements"))


def _features(good: DataFrame) -> DataFrame:
    """Elements of packages as the lint wants them: the package, metadata, then items."""
    text = lambda: F.lit(None).cast("string")
    root = good.select("book_id", F.lit(0).alias("ord"), F.lit("package").alias("tag"), text().alias("property"), text().alias("fallback"), F.col("info.prefix").alias("prefix"))
    metas = _elements(good).select("book_id", (F.col("ord") + 1).alias("ord"), "tag", "property", text().alias("fallback"), text().alias("prefix"))
    items = good.select("book_id", F.posexplode("info.items").alias("i", "x")).select("book_id", (F.lit(1 << 20) + F.col("i")).alias("ord"), F.lit("item").alias("tag"), text().alias("property"), F.col("x.fallback").alias("fallback"), text().alias("prefix"))
    return root.unionByName(metas).unionByName(items)


_POINTS = "book_id string, node_id string, parent_id string, ord int, title string, href string, doc_title string"


def _navigation(needs: DataFrame, rows: DataFrame) -> DataFrame:
    """(book_id, path, nav) of books that have an ncx but no navigation document."""
    import xml.etree.ElementTree as ET

    import pandas as pd

    wanted = needs.select("book_id", "folder", F.concat("folder", T.unquote("info.ncx_href")).alias("path"), F.col("info.guide").alias("guide"))
    texts = wanted.join(rows.select("book_id", "path", "data"), ["book_id", "path"]).select("book_id", T.strip_doctype(F.decode("data", "UTF-8")).alias("ncx"))

    def run(frames):
        for f in frames:
            out = []
            for book, ncx in zip(f["book_id"], f["ncx"], strict=True):
                local = lambda n: n.tag.rpartition("}")[2] if isinstance(n.tag, str) else ""
                try:
                    root = ET.fromstring(ncx.encode())
                except ET.ParseError:
                    continue  # a broken table of contents leaves the book without one
                label = lambda n, name: next(("".join(t.itertext()).strip() for c in n if local(c) == name for t in c if local(t) == "text"), "")
                title = label(root, "docTitle")
                out.append((book, None, None, -1, None, None, title))
                open_ = [(n, None) for n in root.iter() if local(n) == "navMap"][:1]
                count = 0
                while open_:
                    node, parent = open_.pop()
                    for i, p in enumerate(c for c in node if local(c) == "navPoint"):
                        count += 1
                        href = next((c.get("src", "") for c in p if local(c) == "content"), "")
                        out.append((book, str(count), parent, i, label(p, "navLabel"), href, None))
                        open_.append((p, str(count)))
            yield pd.DataFrame(out, columns=["book_id", "node_id", "parent_id", "ord", "title", "href", "doc_title"])

    points = texts.mapInPandas(run, _POINTS)
    guide = wanted.select("book_id", F.posexplode("guide").alias("ord", "g")).select("book_id", "ord", "g.ref_type", "g.href", "g.title")
    titles = points.where("ord = -1").select("book_id", "doc_title")
    made = nav.documents(titles, points.where("ord >= 0").drop("doc_title"), guide)
    return made.join(wanted.select("book_id", "folder"), "book_id").select("book_id", F.concat("folder", F.lit("nav.xhtml")).alias("path"), "nav")


def reports(originals: DataFrame, entries: DataFrame, shots: DataFrame, lint: DataFrame, options: Options, stamp: str) -> DataFrame:
    """(book_id, data, report): the new containers and their audit reports. originals: (book_id, filename, size)."""
    packed = archive.containers(entries)
    sized = packed.select("book_id", F.octet_length("data").cast("long").alias("final_size"))
    rows = originals.join(sized, "book_id").select("book_id", F.col("filename").alias("input_name"), T.output_name(T.stem("filename"), options.target).alias("output_name"), F.col("size").alias("original_size"), "final_size", F.lit(options.target).alias("version"))
    features = lint.groupBy("book_id").agg(F.array_sort(F.collect_set("feature")).alias("features"))
    return packed.join(report.texts(rows, shots, features, stamp), "book_id")
