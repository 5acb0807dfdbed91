"""Operators on markup: sentence spans in XHTML, Markdown to XHTML, and from-scratch books."""

from __future__ import annotations

import html
import re
from posixpath import normpath

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quire.functions.events import events
from quire.functions.predicates import BLOCKS, SKIPPED
from quire.functions.text import CLOSERS, IMAGE_TYPES, _c

_SENTENCE = re.compile(f"[.!?][{CLOSERS}]*\\s+")
#: The style element, classes and ids that reading devices look for.
STYLE = '<style type="text/css" class="kobostylehacks">div#book-inner { margin-top: 0; margin-bottom: 0;}</style>'


def cut(text: str) -> list[str]:
    """Sentence segments that add up to the text."""
    out, at = [], 0
    for m in _SENTENCE.finditer(text):
        out.append(text[at : m.end()])
        at = m.end()
    return out + [text[at:]] * (at < len(text))


def spans_of(xhtml: str) -> str:
    """Body text in numbered spans, a sentence each; paragraphs are counted by block elements and images.

    Text of scripts, styles, preformatted and embedded content stays; entities are never cut.
    """
    out: list[str] = []
    held: list[str] = []
    in_body, skip, para, seg = False, 0, 0, 0

    def span(inner: str) -> str:
        return f'<span class="koboSpan" id="kobo.{para}.{seg}">{inner}</span>'

    def flush():
        nonlocal para, seg
        text = "".join(held)
        held.clear()
        if not text.strip():
            out.append(text)
            return
        para = max(para, 1)
        for s in cut(text):
            if s.strip():
                seg += 1
                out.append(span(s))
            else:
                out.append(s)

    for e in events(xhtml):
        name = e.local.lower()
        if e.kind == "text" and in_body and not skip:
            held.append(e.raw)
            continue
        flush()
        if e.kind == "empty" and name == "img" and in_body and not skip:
            para, seg = para + 1, 1
            out.append(span(e.raw))
            continue
        if e.kind == "start" and name == "body":
            in_body = True
            out.append(e.raw + '<div id="book-columns"><div id="book-inner">')
            continue
        if e.kind == "end" and name in ("body", "head"):
            in_body = in_body and name != "body"
            out.append(("</div></div>" if name == "body" else STYLE) + e.raw)
            continue
        if e.kind == "start":
            if name in SKIPPED:
                skip += 1
            elif in_body and not skip and name in BLOCKS:
                para, seg = para + 1, 0
        elif e.kind == "end" and name in SKIPPED and skip:
            skip -= 1
        out.append(e.raw)
    flush()
    return "".join(out)


def spans(xhtml) -> Column:
    return F.pandas_udf(lambda s: pd.Series([None if v is None else spans_of(v) for v in s], dtype=object), "string")(_c(xhtml))


# Markdown: headings, paragraphs, lists, quotes, fenced and indented code, rules, tables, emphasis, code, links, images.


def esc(s: str) -> str:
    s = re.sub(r"[\x00-\x08\x0B\x0C\x0E-\x1F]", "", s)
    return s.replace("&", "&amp;").replace("<", "&lt;").replace(">", "&gt;").replace('"', "&quot;")


_RULE = re.compile(r" {0,3}([-*_])[ \t]*(?:\1[ \t]*){2,}$")
_HEAD = re.compile(r" {0,3}(#{1,6})(?:[ \t]+(.*?))?(?:[ \t]+#+)?[ \t]*$")
_FENCE = re.compile(r" {0,3}(`{3,}|~{3,})[ \t]*([^`\s]*)[^`]*$")
_BULLET = re.compile(r"( {0,3})(?:([-+*])|(\d{1,9})[.)])([ \t]+|$)(.*)$")
_CELLS = re.compile(r"[ \t]*\|?[ \t]*:?-+:?[ \t]*(?:\|[ \t]*:?-+:?[ \t]*)*\|?[ \t]*$")
_INLINE = re.compile(
    r"(?P<esc>\\[!-/:-@\[-`{-~])|(?P<tick>`+)(?P<code>.+?)(?<!`)(?P=tick)(?!`)|(?P<img>!)?\[(?P<label>(?:[^\[\]]|\[[^\]]*\])*)\]\(\s*<?(?P<url>[^\s)>]*)>?(?:\s+[\"'(].*?[\"')])?\s*\)"
    r"|(?P<shown>!)?\[(?P<named>(?:[^\[\]]|\[[^\]]*\])+)\](?:\[(?P<ref>[^\[\]]*)\])?"
    r"|<(?P<auto>https?://[^\s<>]+)>|(?P<raw></?[A-Za-z][^<>]*>|<!--.*?-->)|(?P<strong>\*\*|__)(?=\S)(?P<bold>.+?)(?<=\S)(?P=strong)"
    r"|(?P<del>~~)(?=\S)(?P<gone>.+?)(?<=\S)~~|(?P<em>\*|(?<!\w)_)(?=\S)(?P<slanted>.+?)(?<=\S)(?P=em)(?!(?<=_)\w)|(?P<hard> {2,}\n|\\\n)|(?P<ent>&(?:#\d+|#x[0-9A-Fa-f]+|\w+);)",
    re.S,
)

_DEFINITION = re.compile(r" {0,3}\[((?:[^\[\]\\]|\\.)+)\]:[ ]*<?([^\s<>]+)>?(?:\s+(?:\"[^\"]*\"|'[^']*'|\([^()]*\)))?\s*$")


def _label(s: str) -> str:
    return " ".join(s.split()).casefold()


class Markdown:
    """One book's Markdown files, in order: chapters (title or none, body), image names and the first top-level title.

    ``image(url)`` gives the extension of a local image that can be embedded, or None. Raw HTML is
    dropped, footnotes are left as text. Links and images by reference follow their file's definitions.
    """

    def __init__(self, image=lambda url: None):
        self.chapters, self.images, self.first, self.image, self.links = [], [], None, image, {}

    def add(self, text: str) -> None:
        self.body, self.title = [], None
        lines = text.replace("\r\n", "\n").replace("\t", "    ").split("\n")
        self.links = self.definitions(lines)
        self.blocks(lines, 0)
        self.flush()

    def definitions(self, lines: list[str]) -> dict[str, str]:
        """What a file's labels lead to; of several definitions the first holds. Those inside fences don't count."""
        links: dict[str, str] = {}
        fence = None
        for line in lines:
            if fence is None and (m := _FENCE.match(line)):
                fence = m[1]
            elif fence is not None:
                fence = None if re.match(rf" {{0,3}}{fence[0]}{{{len(fence)},}}\s*$", line) else fence
            elif m := _DEFINITION.match(line):
                links.setdefault(_label(m[1]), m[2])
        return links

    def flush(self) -> None:
        body = "".join(self.body)
        if body.strip():
            self.chapters.append((self.title, body))
        self.body, self.title = [], None

    def heading(self, level: int, text: str, depth: int) -> None:
        if level == 1 and not depth:
            self.flush()
        self.body.append(f"<h{level}>{self.inline(text)}</h{level}>\n")
        plain = self.plain(text).strip()
        if level == 1:
            self.title = plain if self.title is None else self.title
            self.first = plain if self.first is None else self.first

    def blocks(self, lines: list[str], depth: int, tight: bool = False) -> None:
        i, para = 0, []

        def close():
            if para:
                inner = self.inline("\n".join(x.lstrip() for x in para).rstrip())
                if inner:
                    self.body.append(inner if tight else f"<p>{inner}</p>\n")
                para.clear()

        while i < len(lines):
            line = lines[i]
            if not line.strip():
                close()
                i += 1
            elif m := _FENCE.match(line):
                close()
                inside, i = [], i + 1
                while i < len(lines) and not re.match(rf" {{0,3}}{m[1][0]}{{{len(m[1])},}}\s*$", lines[i]):
                    inside.append(lines[i])
                    i += 1
                i += 1
                kind = f' class="language-{esc(m[2])}"' if m[2] else ""
                self.body.append(f"<pre><code{kind}>{esc(''.join(x + chr(10) for x in inside))}</code></pre>\n")
            elif not para and line.startswith("    "):
                inside = []
                while i < len(lines) and (lines[i].startswith("    ") or not lines[i].strip()):
                    inside.append(lines[i][4:])
                    i += 1
                self.body.append(f"<pre><code>{esc(chr(10).join(inside).rstrip() + chr(10))}</code></pre>\n")
            elif m := _HEAD.match(line):
                close()
                self.heading(len(m[1]), m[2] or "", depth)
                i += 1
            elif para and (m := re.match(r" {0,3}(=+|-+)\s*$", line)):
                text = "\n".join(x.strip() for x in para)
                para.clear()
                self.heading(1 if m[1][0] == "=" else 2, text, depth)
                i += 1
            elif _RULE.match(line):
                close()
                self.body.append("<hr/>\n")
                i += 1
            elif re.match(r" {0,3}>", line):
                close()
                inside = []
                while i < len(lines) and lines[i].strip() and (re.match(r" {0,3}>", lines[i]) or inside):
                    inside.append(re.sub(r"^ {0,3}> ?", "", lines[i]))
                    i += 1
                self.body.append("<blockquote>\n")
                self.blocks(inside, depth + 1)
                self.body.append("</blockquote>\n")
            elif (m := _BULLET.match(line)) and (not para or (m[5] and m[3] in (None, "1"))):
                close()
                i = self.listed(lines, i, depth)
            elif not para and "|" in line and i + 1 < len(lines) and "-" in lines[i + 1] and _CELLS.match(lines[i + 1]):
                i = self.table(lines, i)
            elif not para and _DEFINITION.match(line):
                i += 1
            elif not para and re.match(r" {0,3}<(?:[A-Za-z/!?])", line):
                while i < len(lines) and lines[i].strip():
                    i += 1
            else:
                para.append(line)
                i += 1
        close()

    def listed(self, lines: list[str], i: int, depth: int) -> int:
        first = _BULLET.match(lines[i])
        items: list[list[str]] = []
        loose = False
        while i < len(lines) and (m := _BULLET.match(lines[i])) and m[2] == first[2] and (m[3] is None) == (first[3] is None) and not _RULE.match(lines[i]):
            width = len(m[0]) - len(m[5])
            item = [m[5]]
            i += 1
            while i < len(lines):
                if not lines[i].strip():
                    j = next((k for k in range(i, len(lines)) if lines[k].strip()), None)
                    if j is None or not lines[j].startswith(" " * width):
                        break
                    item += [""] * (j - i)
                    loose, i = True, j
                elif lines[i].startswith(" " * width):
                    item.append(lines[i][width:])
                    i += 1
                elif _BULLET.match(lines[i]) or _HEAD.match(lines[i]) or _FENCE.match(lines[i]) or _RULE.match(lines[i]) or not item[-1]:
                    break
                else:
                    item.append(lines[i].lstrip())
                    i += 1
            items.append(item)
            j = next((k for k in range(i, len(lines)) if lines[k].strip()), None)
            if j is not None and j > i and (m := _BULLET.match(lines[j])) and m[2] == first[2] and (m[3] is None) == (first[3] is None):
                loose, i = True, j
        name = "ol" if first[3] else "ul"
        start = f' start="{int(first[3])}"' if first[3] and int(first[3]) != 1 else ""
        self.body.append(f"<{name}{start}>\n")
        for item in items:
            self.body.append("<li>")
            self.blocks(item, depth + 2, not loose)
            self.body.append("</li>\n")
        self.body.append(f"</{name}>\n")
        return i

    def table(self, lines: list[str], i: int) -> int:
        row = lambda x, t: "".join(f"<{t}>{self.inline(c.strip())}</{t}>" for c in re.split(r"(?<!\\)\|", x.strip().strip("|")))
        self.body.append(f"<table>\n<thead>\n<tr>{row(lines[i], 'th')}</tr>\n</thead>\n")
        i += 2
        while i < len(lines) and "|" in lines[i]:
            self.body.append(f"<tr>{row(lines[i], 'td')}</tr>\n")
            i += 1
        self.body.append("</table>\n")
        return i

    def inline(self, text: str) -> str:
        out, at, start = [], 0, 0
        while m := _INLINE.search(text, start):
            if m["named"] is not None and _label(m["ref"] or m["named"]) not in self.links:
                start = m.start() + 1  # no reference: the bracket is text
                continue
            out.append(esc(text[at : m.start()]))
            at = start = m.end()
            if m["esc"]:
                out.append(esc(m["esc"][1]))
            elif m["code"] is not None:
                out.append(f"<code>{esc(m['code'].strip() if m['code'].strip() else m['code'])}</code>")
            elif m["url"] is not None:
                out.append(self.picture(m["url"], self.plain(m["label"])) if m["img"] else f'<a href="{esc(m["url"])}">{self.inline(m["label"])}</a>')
            elif m["named"] is not None:
                url = self.links[_label(m["ref"] or m["named"])]
                out.append(self.picture(url, self.plain(m["named"])) if m["shown"] else f'<a href="{esc(url)}">{self.inline(m["named"])}</a>')
            elif m["auto"]:
                out.append(f'<a href="{esc(m["auto"])}">{esc(m["auto"])}</a>')
            elif m["bold"] is not None:
                out.append(f"<strong>{self.inline(m['bold'])}</strong>")
            elif m["gone"] is not None:
                out.append(f"<del>{self.inline(m['gone'])}</del>")
            elif m["slanted"] is not None:
                out.append(f"<em>{self.inline(m['slanted'])}</em>")
            elif m["hard"]:
                out.append("<br/>\n")
            elif m["ent"]:
                out.append(esc(html.unescape(m["ent"])))
        return "".join([*out, esc(text[at:])])

    def plain(self, text: str) -> str:
        """The text of inline markup, as it stands in titles and alternative texts."""
        keep = (self.images, self.image)
        self.images, self.image = [], lambda url: None
        try:
            return html.unescape(re.sub(r"<[^>]*>", "", self.inline(text))).replace("\n", " ")
        finally:
            self.images, self.image = keep

    def picture(self, url: str, alt: str) -> str:
        if url.startswith(("http://", "https://")):
            return f'<img src="{esc(url)}" alt="{esc(alt)}"/>'
        ext = self.image(url)
        if ext is None:
            return esc(alt)
        self.images.append(url)
        return f'<img src="images/img{len(self.images):03d}.{ext}" alt="{esc(alt)}"/>'


_COLLECTED = "book_id string, kind string, number long, title string, body string"


def markdown_books(files: DataFrame, assets: DataFrame | None = None) -> DataFrame:
    """(book_id, kind, number, title, body) of Markdown files (book_id, path, text), in the order of their paths.

    kind: book (title: the first top-level heading or the first file's name), chapter (untitled ones
    are ``Section n``, a lone one has the book's title) or image (body: its path). assets: (book_id,
    path) of images that can be embedded. A book is rendered in one task, being one reader's text.
    """
    rows = files.select("book_id", "path", "text")
    names = (assets if assets is not None else files.limit(0)).select("book_id", "path")

    def run(texts: pd.DataFrame, have: pd.DataFrame) -> pd.DataFrame:
        known, out = set(have["path"]) if len(have) else set(), []  # an empty side comes without columns
        if not len(texts):
            return pd.DataFrame(out, columns=["book_id", "kind", "number", "title", "body"])
        texts = texts.sort_values("path")
        book = texts["book_id"].iloc[0]
        folder = ""

        def image(url):
            ext = url.rpartition(".")[2].lower()
            return ext if ext in IMAGE_TYPES and normpath(folder + url) in known else None

        md = Markdown(image)
        found = []
        for path, text in zip(texts["path"], texts["text"], strict=True):
            folder = path[: path.rfind("/") + 1]
            before = len(md.images)
            md.add(text or "")
            found += [normpath(folder + u) for u in md.images[before:]]
        name = re.sub(r"(?s)^(.+)\.[^.]*$", r"\1", texts["path"].iloc[0].rpartition("/")[2])
        title = md.first or name
        out.append((book, "book", 0, title, None))
        for i, (t, body) in enumerate(md.chapters, 1):
            out.append((book, "chapter", i, t or (title if len(md.chapters) == 1 else f"Section {i}"), body))
        out += [(book, "image", i, None, p) for i, p in enumerate(found, 1)]
        return pd.DataFrame(out, columns=["book_id", "kind", "number", "title", "body"])

    return rows.groupBy("book_id").cogroup(names.groupBy("book_id")).applyInPandas(run, _COLLECTED)


def heading_chapters(lines: DataFrame) -> DataFrame:
    """(book_id, chapter, title, n_lines): lines (book_id, ord, text) split at top-level ``# `` headings.

    What comes before the first is a chapter without a title, if it isn't blank.
    """
    head = F.coalesce(F.col("text").rlike("^# +[^ ]"), F.lit(False))
    chapter = F.sum(head.cast("int")).over(Window.partitionBy("book_id").orderBy("ord").rowsBetween(Window.unboundedPreceding, 0))
    rows = lines.withColumns({"chapter": chapter, "_head": head})
    out = rows.groupBy("book_id", "chapter").agg(
        F.max(F.when(F.col("_head"), F.trim(F.regexp_replace("text", "^# +", "")))).alias("title"),
        F.count_if(F.trim("text") != "").alias("n_lines"),
    )
    return out.where("n_lines > 0")


def book_entries(chapters: DataFrame, images: DataFrame, books: DataFrame) -> DataFrame:
    """(book_id, ord, path, data): the entries of books made from scratch.

    chapters: (book_id, number, title, body); images: (book_id, number, ext, data); books: (book_id,
    title, language, modified). The first image named cover in ``books.cover`` isn't treated apart.
    """
    e = lambda c: F.replace(F.replace(F.replace(F.replace(F.col(c), F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;")), F.lit('"'), F.lit("&quot;"))
    n3 = lambda c: F.lpad(F.col(c).cast("string"), 3, "0")
    media = F.create_map(*(F.lit(v) for kv in IMAGE_TYPES.items() for v in kv))
    listed = lambda df, item: df.groupBy("book_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("number", item.alias("x")))), lambda r: r["x"]), "").alias("x"))
    item = lambda: F.concat(F.lit('  <item id="ch'), n3("number"), F.lit('" href="ch'), n3("number"), F.lit('.xhtml" media-type="application/xhtml+xml"/>\n'))
    pictures = F.concat(F.lit('  <item id="img'), n3("number"), F.lit('" href="images/img'), n3("number"), F.lit("."), F.col("ext"), F.lit('" media-type="'), media[F.col("ext")], F.lit('"/>\n'))
    manifest = listed(chapters, item()).withColumnRenamed("x", "items")
    spine = listed(chapters, F.concat(F.lit('  <itemref idref="ch'), n3("number"), F.lit('"/>\n'))).withColumnRenamed("x", "spine")
    toc = listed(chapters, F.concat(F.lit('    <li><a href="ch'), n3("number"), F.lit('.xhtml">'), e("title"), F.lit("</a></li>\n"))).withColumnRenamed("x", "toc")
    shown = listed(images, pictures).withColumnRenamed("x", "pictures")
    count = chapters.groupBy("book_id").agg(F.count(F.lit(1)).alias("n"))
    whole = books.join(manifest, "book_id").join(spine, "book_id").join(toc, "book_id").join(shown, "book_id", "left").join(count, "book_id")
    container = '<?xml version="1.0"?>\n<container version="1.0" xmlns="urn:oasis:names:tc:opendocument:xmlns:container">\n  <rootfiles><rootfile full-path="OEBPS/content.opf" media-type="application/oebps-package+xml"/></rootfiles>\n</container>'
    head = F.concat(F.lit('<?xml version="1.0" encoding="utf-8"?>\n<html xmlns="http://www.w3.org/1999/xhtml" xml:lang="'), e("language"), F.lit('"><head><title>'))
    nav = F.concat(F.lit('<?xml version="1.0" encoding="utf-8"?>\n<html xmlns="http://www.w3.org/1999/xhtml" xmlns:epub="http://www.idpf.org/2007/ops" xml:lang="'), e("language"), F.lit('">\n<head><title>Contents</title></head>\n<body><nav epub:type="toc"><h1>Contents</h1><ol>\n'), "toc", F.lit("</ol></nav></body></html>"))
    opf = F.concat(
        F.lit('<?xml version="1.0" encoding="utf-8"?>\n<package xmlns="http://www.idpf.org/2007/opf" version="3.0" unique-identifier="bookid">\n <metadata xmlns:dc="http://purl.org/dc/elements/1.1/">\n  <dc:identifier id="bookid">urn:uuid:quire-import-'),
        F.col("n").cast("string"), F.lit("</dc:identifier>\n  <dc:title>"), e("title"), F.lit("</dc:title>\n  <dc:language>"), e("language"), F.lit('</dc:language>\n  <meta property="dcterms:modified">'), "modified", F.lit("</meta>\n </metadata>\n <manifest>\n"),
        F.lit('  <item id="nav" href="nav.xhtml" media-type="application/xhtml+xml" properties="nav"/>\n'), F.coalesce("pictures", F.lit("")), "items", F.lit(" </manifest>\n <spine>\n"), "spine", F.lit(" </spine>\n</package>"),
    )
    entry = lambda path, data: F.struct(F.lit(path).alias("path"), data.cast("binary").alias("data"))
    fixed = whole.select("book_id", F.posexplode(F.array(entry("mimetype", F.lit("application/epub+zip")), entry("META-INF/container.xml", F.lit(container)))).alias("ord", "e"))
    last = whole.select("book_id", F.posexplode(F.array(entry("OEBPS/nav.xhtml", nav), entry("OEBPS/content.opf", opf))).alias("i", "e")).withColumn("ord", F.lit(3_000_000) + F.col("i")).drop("i")
    texts = chapters.join(books.select("book_id", "language"), "book_id").select("book_id", (F.lit(2_000_000) + F.col("number")).cast("int").alias("ord"), F.struct(F.concat(F.lit("OEBPS/ch"), n3("number"), F.lit(".xhtml")).alias("path"), F.concat(head, e("title"), F.lit("</title></head>\n<body>\n"), "body", F.lit("</body></html>")).cast("binary").alias("data")).alias("e"))
    shots = images.select("book_id", (F.lit(1_000_000) + F.col("number")).cast("int").alias("ord"), F.struct(F.concat(F.lit("OEBPS/images/img"), n3("number"), F.lit("."), "ext").alias("path"), "data").alias("e"))
    out = fixed.unionByName(last).unionByName(texts).unionByName(shots)
    return out.select("book_id", F.row_number().over(Window.partitionBy("book_id").orderBy("ord")).alias("ord"), "e.path", "e.data")
