"""Cases that the supplied tables don't have, by literal rows."""

import io
import zipfile

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quire.functions import numbers as N
from quire.functions import predicates as P
from quire.functions import text as T
from quire.functions.events import events
from quire.operators import archive as A
from quire.operators import geometry as G
from quire.operators import imports
from quire.operators import lookup as L
from quire.operators import markup as M
from quire.operators import nav as V
from quire.operators import package as K
from quire.operators import selection as S
from quire.operators import structure as B
from quire.sources import containers as C
from quire.streaming import state


def one(spark, column, value=None, **more):
    row = {"x": value} | more
    df = spark.createDataFrame([tuple(row.values())], ", ".join(f"{k} {'string' if v is None or isinstance(v, str) else 'binary' if isinstance(v, bytes) else 'double' if isinstance(v, float) else 'long'}" for k, v in row.items()))
    return df.select(column).first()[0]


@pytest.mark.parametrize(
    ("f", "x", "want"),
    [
        (T.quote, "a b/c~d*e_é", "a%20b/c~d%2Ae_%C3%A9"), (T.unquote, "a+b%20c", "a+b c"), (T.unquote, "100%", "100%"), (T.unquote, "50%+%zz %41%", "50%+%zz A%"), (T.unquote, "%FF%41", "\ufffdA"), (T.basename, "a/b/c.d", "c.d"),
        (T.extension, "noext", "noext"), (T.extension, "a.TAR.Gz", "gz"), (T.slugify, "Işık Doğudan", "Isik_Dogudan"), (T.slugify, " a ! _ b ", "a_b"), (T.slugify, "!!", "output"),
        (T.capitalize, "hELLO wORLD", "Hello world"), (T.local_name, "dc:title", "title"), (T.author_display, "Doe, Jane", "Jane Doe"), (T.author_display, "A, B, C", "A, B, C"),
        (T.letters_only, "İSTANBUL É1 Abc", "İstanbul É abc"), (T.template, "INTRODUCTION ix 12", "introduction"), (T.dehyphenated, "exam-\n ple  of it A- B", "example of it A- B"),
        (T.strip_doctype, "<!DOCTYPE a><x/><!doctype b>", "<x/><!doctype b>"), (T.json_string, 'a"b\\\n\t', '"a\\"b\\\\\\n\\t"'), (T.sanitize_image_id, "a\\b/im g?.png", "im_g_.png"), (T.sanitize_image_id, "a/", "image"),
        (T.non_blank, "   ", None), (T.xml_escape, 'a<b>&"\x01\t', "a&lt;b&gt;&amp;&quot;\t"), (T.decoded_name, "b_zstd-experimental.epub", "b_decoded.epub"), (T.decoded_name, "b.epub", "b_decoded.epub"),
        (N.crc32_hex, "abc", "352441c2"), (N.hex_text, "00660069", "fi"), (N.hex_text, "006", None), (N.hex_code, "00Ff", 255), (N.hex_code, "zz", None),
        (P.is_page_number, " xiv ", True), (P.is_page_number, "1234567", False), (P.is_page_number, "a1", False), (P.is_heading, "CHAPTER ONE", True), (P.is_heading, "Chapter 1", False), (P.is_heading, "AB", False),
        (P.is_on, " on ", True), (P.is_on, None, False), (P.escapes, "a/../b", True), (P.escapes, "a/b..c", False), (P.has_html_syntax, "<br />", False), (P.has_html_syntax, "<BR>", True),
        (L.provider, "ol", "a"), (L.provider, "other", None), (L.error_text, '{"detail": "no"}', "no"), (L.error_text, " plain ", "plain"),
    ],
)
def test_scalars(spark, f, x, want):
    assert one(spark, f(F.col("x")), x) == want


def test_numbers(spark):
    assert one(spark, N.commas1("x"), 1234567.25) == "1,234,567.3" and one(spark, N.commas1("x"), -0.25) == "-0.3"
    assert one(spark, N.size_display("x"), 1536) == "1.5 KB" and one(spark, N.size_display("x"), 3 << 20) == "3.00 MB"
    assert one(spark, N.dictionary_size("x", F.lit(2)), 4095) is None and one(spark, N.dictionary_size("x", F.lit(2)), 10_000_000) == 112_640
    assert bytes(one(spark, N.data_uri("x"), "data:image/png;base64,iVBO Rw==")).hex() == "89504e47"
    assert [one(spark, N.saved_percent("x", F.lit(5))), one(spark, N.rate("x", F.lit(0.0)), 5)] == [0.0, 0.0]


def jpeg(table, wide=0):
    body = bytes([wide << 4]) + bytes(table)
    return b"\xff\xd8\xff\xdb" + (len(body) + 2).to_bytes(2, "big") + body + b"\xff\xda\x00\x02"


def test_jpeg_quality():
    for q in (10, 40, 60, 75, 90):
        scale = 5000 / q if q < 50 else 200 - 2 * q
        table = [max(1, min(255, int((v * scale + 50) / 100))) for v in N.LUMINANCE]
        assert abs(N.jpeg_quality_of(jpeg(table)) - q) <= 3
    assert N.jpeg_quality_of(None) is N.jpeg_quality_of(b"\xff\xd8") is N.jpeg_quality_of(jpeg([255] * 64)) is None


@given(st.text(alphabet=st.sampled_from(list("ab.!?\"’ \n …1")), max_size=40))
@settings(max_examples=200, deadline=None)
def test_sentences_add_up(text):
    assert "".join(M.cut(text)) == text
    assert all(p for p in M.cut(text))


def test_sentences_in_both_forms(spark):
    for text in ('Hi "you." Ok?! Done… End. ', "3.14 e.g. x", "", "a. b"):
        assert (one(spark, T.sentences("x"), text) or []) == M.cut(text)


def test_spans():
    out = M.spans_of("<html><head><title>t</title></head><body><p>Hello world. Second &amp; more!</p><script>a. b.</script><img src='x'/><p> </p>tail</body></html>")
    assert '<span class="koboSpan" id="kobo.1.1">Hello world. </span><span class="koboSpan" id="kobo.1.2">Second &amp; more!</span>' in out
    assert "<script>a. b.</script>" in out and "id=\"kobo.2.1\"><img src='x'/></span>" in out and 'id="kobo.3.1">tail</span>' in out
    assert 'id="book-columns"' in out and "kobostylehacks" in out


@given(st.text(alphabet=st.sampled_from(list("<>/!-a b=\"'&;?")), max_size=60))
@settings(max_examples=300, deadline=None)
def test_events_add_up(text):
    assert "".join(e.raw for e in events(text)) == text


@pytest.mark.parametrize(
    ("md", "want"),
    [
        ("a **b** *c* `d<e` ~~f~~", "<p>a <strong>b</strong> <em>c</em> <code>d&lt;e</code> <del>f</del></p>\n"),
        ("- a\n- b\n  - c", "<ul>\n<li>a</li>\n<li>b<ul>\n<li>c</li>\n</ul>\n</li>\n</ul>\n"),
        ("3. a\n4. b", '<ol start="3">\n<li>a</li>\n<li>b</li>\n</ol>\n'),
        ("> q\n> r", "<blockquote>\n<p>q\nr</p>\n</blockquote>\n"),
        ("```py\nx < 1\n```", '<pre><code class="language-py">x &lt; 1\n</code></pre>\n'),
        ("a | b\n--|--\n1 | 2", "<table>\n<thead>\n<tr><th>a</th><th>b</th></tr>\n</thead>\n<tr><td>1</td><td>2</td></tr>\n</table>\n"),
        ("x <b>raw</b> y", "<p>x raw y</p>\n"), ("[l](u?a=1&b=2)", '<p><a href="u?a=1&amp;b=2">l</a></p>\n'), ("![alt](missing.png)", "<p>alt</p>\n"), ("![r](https://x/y.png)", '<p><img src="https://x/y.png" alt="r"/></p>\n'),
        ("a\n\n---\n\nb", "<p>a</p>\n<hr/>\n<p>b</p>\n"), ("Title\n---", "<h2>Title</h2>\n"), ("a  \nb", "<p>a<br/>\nb</p>\n"), ("snake_case_name", "<p>snake_case_name</p>\n"),
        ("a [b *c*][X  y] [x Y] [x y][]\n\n[x y]: /u?a=1&b=2 'title'\n[X Y]: /second", '<p>a <a href="/u?a=1&amp;b=2">b <em>c</em></a> <a href="/u?a=1&amp;b=2">x Y</a> <a href="/u?a=1&amp;b=2">x y</a></p>\n'),
        ("![pic][p] [none] *[a* b]\n\n[p]: <https://x/y.png>", '<p><img src="https://x/y.png" alt="pic"/> [none] <em>[a</em> b]</p>\n'), ("```\n[a]: b\n```\n[a]", "<pre><code>[a]: b\n</code></pre>\n<p>[a]</p>\n"),
    ],
)
def test_markdown(md, want):
    book = M.Markdown()
    book.add(md)
    assert [b for _, b in book.chapters] == [want]


def test_markdown_chapters_and_books(spark):
    files = spark.createDataFrame([("b", "2.md", "# Two\nx"), ("b", "1.md", "intro\n\n# One *x*\n![a](./p.png)\n> # not a chapter"), ("c", "only.md", "text")], "book_id string, path string, text string")
    assets = spark.createDataFrame([("b", "p.png")], "book_id string, path string")
    rows = {(r["book_id"], r["kind"], r["number"]): r for r in M.markdown_books(files, assets).collect()}
    assert [rows["b", "chapter", i]["title"] for i in (1, 2, 3)] == ["Section 1", "One x", "Two"]
    assert rows["b", "book", 0]["title"] == "One x" and rows["c", "book", 0]["title"] == rows["c", "chapter", 1]["title"] == "only"
    assert 'src="images/img001.png"' in rows["b", "chapter", 2]["body"] and rows["b", "image", 1]["body"] == "p.png"
    books = spark.createDataFrame([("b", "One", "en", "2000-01-01T00:00:00Z")], "book_id string, title string, language string, modified string")
    chapters = M.markdown_books(files, assets).where("kind = 'chapter'")
    images = spark.createDataFrame([("b", 1, "png", b"\x89PNG")], "book_id string, number long, ext string, data binary")
    entries = M.book_entries(chapters, images, books).orderBy("ord").collect()
    assert [e["path"] for e in entries] == ["mimetype", "META-INF/container.xml", "OEBPS/images/img001.png", "OEBPS/ch001.xhtml", "OEBPS/ch002.xhtml", "OEBPS/ch003.xhtml", "OEBPS/nav.xhtml", "OEBPS/content.opf"]
    info = K.info_of(bytes(entries[-1]["data"]).decode())
    assert info["error"] is None and info["nav_exists"] and len(info["items"]) == 5


OPF = """<?xml version="1.0"?><package xmlns="http://www.idpf.org/2007/opf" version="2.0" unique-identifier="uid" prefix="xsd: http://x">
 <metadata xmlns:dc="http://purl.org/dc/elements/1.1/"><dc:title>A &amp; B</dc:title><dc:identifier id="uid">1</dc:identifier><meta name="cover" content="c"/><meta property="dcterms:modified">old</meta></metadata>
 <manifest><item id="c" href="c.png" media-type="image/png"/><item id="n" href="toc.ncx" media-type="application/x-dtbncx+xml"/></manifest>
 <spine/><guide><reference type="text" href="a.xhtml" title="T"/></guide></package>"""


def test_package_documents(spark):
    info = K.info_of(OPF)
    assert (info["version"], info["cover_id"], info["ncx_href"], info["has_guide"], info["nav_exists"]) == ("2.0", "c", "toc.ncx", True, False)
    assert one(spark, K.info("x")["guide"][0]["title"], OPF) == "T" and K.info_of("<a>")["error"]
    out = K.rewritten_of(OPF, "2000-01-01T00:00:00Z", "src", True, True, {"c.png": {"href": "c.webp", "media-type": "image/webp", "properties": "cover-image"}})
    again = K.info_of(out)
    assert again["version"] == "3.0" and not again["has_guide"] and again["nav_exists"] and again["items"][0]["href"] == "c.webp"
    assert [e["text"] for e in again["elements"] if e["property"] == "dcterms:modified"] == ["2000-01-01T00:00:00Z"] and "<dc:title>A &amp; B</dc:title>" in out
    fresh = K.updated_of(OPF, {0, 3}, [("dc:title", "", "C < D")])
    assert [e["text"] for e in K.info_of(fresh)["elements"]] == ["1", None, "C < D"]
    with pytest.raises(ValueError, match="metadata"):
        K.updated_of("<package/>", set(), [])
    assert K.info_of(K.rewritten_of("<package><manifest/></package>", "t"))["elements"][0]["text"] == "t"
    root = '<container xmlns="urn:x"><rootfiles><rootfile full-path="OEBPS/c.opf"/></rootfiles></container>'
    assert one(spark, K.package_path("x"), root) == "OEBPS/c.opf"


def test_structure_thresholds(spark):
    def book(pages):
        rows = [("b", p, i, t) for p, blocks in enumerate(pages) for i, t in enumerate(blocks)]
        return spark.createDataFrame(rows, "book_id string, page_num int, seq int, text string")

    for n, gone in ((4, False), (5, True)):
        pages = [["RUNNING HEAD xi", f"body text number {'abcdefgh'[i]} here", str(i)] for i in range(n)] + [["other"]]
        left = [r["text"] for r in B.cleaned(book(pages)).collect()]
        assert ("RUNNING HEAD xi" not in left) == gone and not any(t.isdigit() for t in left)
    for size, title in ((399, None), (400, "CHAPTER ONE")):
        (chapter,) = B.book(book([["CHAPTER ONE", "é" * (size // 2) + "a" * (size % 2)]])).collect()
        assert chapter["title"] == title


def test_figures_and_rendering(spark):
    blocks = spark.createDataFrame([("b", 1, 0, "HEAD LINE"), ("b", 1, 1, "x" * 400), ("b", 2, 0, "big words")], "book_id string, page_num int, seq int, text string")
    pages = spark.createDataFrame([("b", 1, True, [], ["f"]), ("b", 2, True, ["big words"], ["g", "h"])], "book_id string, page_num int, born_digital boolean, big_font array<string>, figures array<string>")
    (r,) = B.rendered(B.book(blocks, pages)).collect()
    assert r["title"] == "HEAD LINE" and [r["body"].index(f"fig00{i}") for i in (1, 2, 3)] == sorted(r["body"].index(f"fig00{i}") for i in (1, 2, 3))
    assert "<p>big words</p>" in r["body"]


def test_lines_and_blocks_of_runs():
    runs = [("Hel", 10.0, 0.0, 15.0, 100.0), ("lo", 10.0, 15.5, 25.0, 101.0), ("world", 10.0, 30.0, 55.0, 100.0), ("next", 10.0, 0.0, 20.0, 88.0), ("more", 10.0, 0.0, 20.0, 76.0), ("Indented", 10.0, 12.0, 50.0, 64.0), ("far", 10.0, 0.0, 10.0, 30.0)]
    assert G.blocks_of(runs) == ["Hello world next more", "Indented", "far"]
    assert G.blocks_of([]) == [] and G.blocks_of([(" ", 1.0, 0.0, 0.0, 0.0)]) == []


def test_glyphs_widths_and_operators():
    cmap = b"2 beginbfchar <0041> <0061> <42> <00660069> endbfchar beginbfrange <0050> <0052> <0070> <0060> <0061> [<0078> <0079>] endbfrange"
    glyphs, width = G.glyphs_of(cmap)
    assert glyphs == {0x41: "a", 0x42: "fi", 0x50: "p", 0x51: "q", 0x52: "r", 0x60: "x", 0x61: "y"} and width == 2
    assert G.glyphs_of(b"") is G.glyphs_of(None) is None
    assert G.composite_widths([1, [500, 600], 5, 7, 250], 800) == ({1: 0.5, 2: 0.6, 5: 0.25, 6: 0.25, 7: 0.25}, 0.8)
    assert G.decoded(b"\x00A\x00\x42\x00", glyphs, 2, {0x41: 0.5}, 1.0) == ("afi", 1.5)
    ops = [("BT", []), ("Tf", ["F", 10]), ("Td", [100, 200]), ("Tj", [b"ab"]), ("TL", [12]), ("T*", []), ("TJ", [[b"c", -1000, b"d"]]), ("q", []), ("cm", [2, 0, 0, 2, 0, 0]), ("Tj", [b"e"]), ("Q", []), ("'", [b"f"])]
    got = G.runs_of(ops)
    assert [(t, round(s), round(x), round(e), round(y)) for t, s, x, e, y in got] == [("ab", 10, 100, 110, 200), ("cd", 10, 100, 120, 188), ("e", 20, 200, 210, 376), ("f", 10, 100, 105, 176)]


def test_inherited_values(spark):
    rows = [("b", 1, None, "root"), ("b", 2, 1, None), ("b", 3, 2, None), ("b", 4, 3, "own"), ("b", 5, 9, None), ("b", 6, 6, None)]
    df = spark.createDataFrame(rows, "book_id string, node_id int, parent_id int, value string")
    assert {r["node_id"]: r["value"] for r in G.inherited(df).collect()} == {1: "root", 2: "root", 3: "root", 4: "own"}
    chain = spark.createDataFrame([("b", i, i - 1 if i else None, None if i else "v") for i in range(20)], "book_id string, node_id int, parent_id int, value string")
    assert sorted(r["node_id"] for r in G.inherited(chain).collect()) == list(range(17))
    assert sorted(r["node_id"] for r in G.inherited(chain, 5).collect()) == list(range(6))


PAGES = "book_id string, page_num int, text string, shown_bytes int, full_page_image boolean, figures array<string>"
RUNS = "book_id string, page_num int, seq int, text string, font_size float, x float, end_x float, y float"


def test_imports_of_pages(spark):
    prose = "these are words " * 30
    pages = [("ok", 1, f"  Small   head\n\n{prose}", 500, False, ["f"]), ("ok", 2, None, 0, True, ["g"]), ("ok", 3, " \n", 200, False, None), ("sign", 1, "+-*/ " * 20, 100, False, None), ("mute", 1, None, 100, False, None),
             ("number", 1, "12", 100, False, None), ("scan", 1, "hidden", 5, True, ["s"]), ("unread", 1, None, None, None, None), (None, 1, "x", 100, False, None)]
    runs = [("ok", 1, 0, "small HEAD", 20.0, 0.0, 9.0, 90.0), ("ok", 1, 1, "a", 10.0, 0.0, 9.0, 70.0), ("ok", 1, 2, "b", 10.0, 0.0, 9.0, 50.0), ("ok", 3, 0, "drawn", 10.0, 0.0, 9.0, 50.0), ("ok", 3, 1, "line", 10.0, 0.0, 9.0, 38.0), ("scan", 1, 0, "not used", 10.0, 0.0, 9.0, 50.0)]
    scanned = [("scan", 1, "read words"), ("ok", 2, "not used")]
    books = imports.pages_books(spark.createDataFrame(pages, PAGES), spark.createDataFrame(runs, RUNS), spark.createDataFrame(scanned, "book_id string, page_num int, text string"))
    chapters, outcomes = ({r["book_id"]: r for r in df.collect()} for df in books)
    assert {k: (r["tier"], r["chapters"], r["paragraphs"], r["status"]) for k, r in outcomes.items()} == {
        "ok": ("text_layer", 1, 2, "ok"), "sign": ("text_layer", 1, 1, "not_prose"), "mute": ("text_layer", 0, 0, "undecoded_fonts"), "number": ("text_layer", 0, 0, "no_text"),
        "scan": ("scan", 1, 1, "ok"), "unread": ("scan", 0, 0, "unread_scan"),
    }
    assert chapters["ok"]["title"] == "Small head" and [(b["kind"], b["text"]) for b in chapters["ok"]["blocks"]] == [("paragraph", prose.strip()), ("figure", "0"), ("figure", "0"), ("paragraph", "drawn line")]
    assert [b["text"] for b in chapters["scan"]["blocks"]] == ["read words"]
    empty = imports.pages_books(spark.createDataFrame([], PAGES), spark.createDataFrame([], RUNS))
    assert [df.count() for df in empty] == [0, 0]


def test_imports_of_answers(spark):
    page = '{"pages": [{"markdown": "# T\\n\\n![a](i.png) [far](./i.png)", "images": [{"id": "i.png", "image_base64": "iVBORw0K"}]}]}'
    rows = [("a", "mistral", "k", 200, page), ("b", "mistral", " ", 200, page), ("c", None, "k", 200, page), ("d", "mistral", "k", 500, "down"), ("e", "mistral", "k", 200, None), ("f", "mistral", "k", None, None), (None, "mistral", "k", 200, page)]
    found, images, outcomes = imports.answers_books(spark.createDataFrame(rows, "book_id string, provider string, key string, code int, body string"))
    assert {r["book_id"]: (r["status"], r["error"]) for r in outcomes.collect()} == {"a": ("ok", None), "b": ("no_key", None), "c": ("unknown_provider", None), "d": ("refused", "down"), "e": ("no_text", None), "f": ("refused", None)}
    kinds = {r["kind"]: r for r in found.collect()}
    assert set(kinds) == {"book", "chapter", "image"} and kinds["image"]["body"] == "p0_i.png" and '<img src="images/img001.png" alt="a"/>' in kinds["chapter"]["body"]
    assert [(r["book_id"], r["path"], bytes(r["data"])[:4]) for r in images.collect()] == [("a", "p0_i.png", b"\x89PNG")]


ENTRIES = [("mimetype", A.MIMETYPE), ("META-INF/container.xml", b"<container/>"), ("OEBPS/content.opf", OPF.encode()), *((f"OEBPS/ch{i}.xhtml", f"<html><body>{'repetitive chapter text ' * 200}{i}</body></html>".encode()) for i in range(8)), ("OEBPS/i.png", bytes(range(256)) * 16), ("OEBPS/f.otf", b"OTTO" * 100), ("empty.txt", b"")]


def rows(spark):
    return spark.createDataFrame([("b", i, p, d) for i, (p, d) in enumerate(ENTRIES)], "book_id string, ord int, path string, data binary")


def test_archives_come_back_and_notice_damage(spark):
    originals = spark.createDataFrame([("b", "b.epub", 1000, "00")], "book_id string, filename string, size long, sha256 string")
    packed = A.archived(rows(spark), originals, "2000-01-01T00:00:00Z")
    back = A.restored(packed).orderBy("ord").collect()
    assert [(r["path"], bytes(r["data"])) for r in back] == ENTRIES and not any(r["error"] for r in back)
    data = bytes(packed.first()["data"])
    info = zipfile.ZipFile(io.BytesIO(data))
    assert info.namelist()[:2] == [A.MANIFEST, A.STREAM] and all(i.compress_type == zipfile.ZIP_STORED for i in info.infolist()) and b'"epub_version": "2.0"' in info.read(A.MANIFEST)
    for old, new in ((b'"format": "eparc"', b'"format": "other"'), (b'"format_version": 1', b'"format_version": 2'), (b'"size": 12,', b'"size": 13,')):
        parts = [(n, info.read(n).replace(old, new) if n == A.MANIFEST else info.read(n), zipfile.ZIP_STORED) for n in info.namelist()]
        with pytest.raises(ValueError):
            A.restored_of(A._zip(parts))
    for broken in (b"", data[:200]):
        with pytest.raises(ValueError):
            A.restored_of(broken)
    bad = spark.createDataFrame([("x", b"junk")], "book_id string, data binary")
    assert A.restored(bad).first()["error"]


def test_method_93(spark):
    for way in (A.packed_of(ENTRIES), A.packed_of(ENTRIES, 3, A.trained_of(ENTRIES)), A.best_of(ENTRIES)):
        assert A.unpacked_of(way) == ENTRIES
    assert len(A.best_of(ENTRIES)) <= len(A.packed_of(ENTRIES)) and A.trained_of(ENTRIES[:3]) is None
    data = A.packed_of(ENTRIES)
    for broken in (b"", data[:-30], data[:60] + b"\xff" + data[61:]):
        with pytest.raises(ValueError):
            A.unpacked_of(broken)
    # A conformant container out of the decoded entries.
    z = zipfile.ZipFile(io.BytesIO(A.container_of(A.unpacked_of(data))))
    assert z.namelist()[0] == "mimetype" and z.infolist()[0].compress_type == zipfile.ZIP_STORED and z.read("OEBPS/f.otf") == b"OTTO" * 100


def test_container_sources(spark, tmp_path):
    (tmp_path / "sub").mkdir()
    good = A.container_of([e for e in ENTRIES if e[0] != "META-INF/container.xml"] + [("META-INF/container.xml", b'<container><rootfiles><rootfile full-path="OEBPS/content.opf"/></rootfiles></container>')])
    (tmp_path / "a.epub").write_bytes(good)
    (tmp_path / "sub" / "b.epub").write_bytes(b"junk")
    found = C.entries(spark, str(tmp_path)).cache()
    assert found.where("error IS NULL").count() == len(ENTRIES) and found.where("error IS NOT NULL").count() == 1
    assert C.packages(found).first()["xml"] == OPF and bytes(C.entry(found.where("error IS NULL"), "empty.txt").first()["data"]) == b""
    assert C.entries(spark, str(tmp_path), paths=["mimetype"]).where("error IS NULL").count() == 1
    assert C.files_with(spark, str(tmp_path), "EPUB").count() == 2
    C.register(spark)
    one_path = spark.read.format("zip_entries").load(str(tmp_path / "a.epub")).where("path = 'mimetype'")
    assert [bytes(r["data"]) for r in one_path.collect()] == [A.MIMETYPE]
    evil = io.BytesIO()
    with zipfile.ZipFile(evil, "w") as z:
        for name in ("../x", "/abs", "ok.txt", "d/"):
            z.writestr(name, "12345")
    assert [p for _, p, _ in C.entries_of(evil.getvalue())] == ["ok.txt"]
    for limits in ({"most": 3}, {"size": 4}, {"size": 4, "by_header": True}):
        with pytest.raises(ValueError):
            C.entries_of(evil.getvalue(), **limits)
    swapped = A.replaced(rows(spark), spark.createDataFrame([("b", "empty.txt", b"new")], "book_id string, path string, new_data binary"))
    assert bytes(swapped.where("path = 'empty.txt'").first()["data"]) == b"new" and swapped.count() == len(ENTRIES)


def test_markdown_sources(spark, tmp_path):
    for name, data in (("b.MD", "# B"), ("a.md", "# A"), ("._c.md", "x"), ("cover.png", "p"), ("note.txt", "t")):
        (tmp_path / name).write_text(data)
    files, assets = C.markdown_folder(spark, str(tmp_path))
    assert sorted(r["path"] for r in files.collect()) == ["a.md", "b.MD"] and assets.count() == 2
    z = io.BytesIO()
    with zipfile.ZipFile(z, "w") as out:
        for name in ("x/deep/cover.png", "y/cover.jpg", "z/cover.png", "x/1.md", "__MACOSX/x/1.md"):
            out.writestr(name, "t")
    files, _, covers = C.markdown_zips(spark.createDataFrame([("b", z.getvalue())], "book_id string, data binary"))
    assert [r["path"] for r in files.collect()] == ["x/1.md"] and covers.first()["path"] == "y/cover.jpg"


def test_navigation_documents(spark):
    points = spark.createDataFrame([("b", "1", None, 1, "A & B", "a.xhtml"), ("b", "2", "1", 1, " ", "x\\y.xhtml"), ("b", "3", "2", 1, "deep", ""), ("b", "4", None, 2, "C", "c.xhtml")], "book_id string, node_id string, parent_id string, ord int, title string, href string")
    guide = spark.createDataFrame([("b", 1, "text", "a.xhtml", "T")], "book_id string, ord int, ref_type string, href string, title string")
    books = spark.createDataFrame([("b", "Book"), ("e", "")], "book_id string, doc_title string")
    out = {r["book_id"]: r["nav"] for r in V.documents(books, points, guide).collect()}
    assert '<ol><li><a href="a.xhtml">A &amp; B</a><ol><li><a href="x/y.xhtml">Untitled</a><ol><li><span>deep</span></li></ol></li></ol></li><li><a href="c.xhtml">C</a></li></ol>' in out["b"]
    assert "bodymatter" in out["b"] and "No table of contents" in out["e"] and "Table of Contents" in out["e"] and "landmarks" not in out["e"]


def test_choices(spark):
    df = spark.createDataFrame([("a", 0, 5), ("a", 1, 5), ("a", 2, None), ("b", 0, None)], "key string, ord int, size int")
    assert [(r["key"], r["ord"]) for r in S.smallest(df, "key").collect()] == [("a", 0)]
    assert spark.createDataFrame([(1,), (2,), (3,), (4,)], "x int").agg(S.upper_median(F.col("x"))).first()[0] == 3
    attrs = spark.sql("SELECT map('a', '1', 'b', '2') AS base, map('b', '9', 'c', '3') AS over, map('a', '0', 'd', '4') AS less")
    assert attrs.select(K.overridden("base", "over", "less")).first()[0] == {"a": "1", "b": "9", "c": "3", "d": "4"}


def test_token_bucket_rule_and_stream(spark, tmp_path):
    tokens, last, got = None, None, []
    for now in (0, 0, 0, 0, 0, 0, 0, 4, 10):
        tokens, ok = state.step(tokens, last, now)
        last = now
        got.append(ok)
    assert got == [True] * 6 + [False, False, True]
    rows = [("k", i, f"2024-01-01 00:00:{s:02d}") for i, s in enumerate((0, 0, 0, 0, 0, 0, 0, 4, 10))] + [("j", 9, "2024-01-01 00:00:01")]
    df = spark.createDataFrame(rows, "key string, seq long, t string").select("key", "seq", F.to_timestamp("t").alias("ts"))
    batch = {(r["key"], r["seq"]): r["allowed"] for r in state.limited(df).collect()}
    assert [batch["k", i] for i in range(9)] == got and batch["j", 9]
    df.coalesce(1).write.parquet(str(tmp_path / "in"))
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    stream = spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))
    q = state.limited_stream(stream).writeStream.format("memory").queryName("buckets").option("checkpointLocation", str(tmp_path / "c")).outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert {(r["key"], r["seq"]): r["allowed"] for r in spark.table("buckets").collect()} == batch


def test_entries_are_read_once(spark, tmp_path):
    t = lambda s: f"2024-01-01 00:{s // 60:02d}:{s % 60:02d}"
    rows = [("a", 0, t(0), "put"), ("a", 1, t(10), "get"), ("a", 2, t(20), "get"), ("b", 3, t(0), "put"), ("b", 4, t(300), "get"), ("c", 5, t(5), "get"), ("d", 6, t(0), "put"), ("d", 7, t(299), "get")]
    df = spark.createDataFrame(rows, "token string, seq long, t string, kind string").select("token", "seq", F.to_timestamp("t").alias("ts"), "kind")
    want = {1: True, 2: False, 4: False, 5: False, 7: True}
    assert {r["seq"]: r["found"] for r in state.read_once(df.where("kind = 'put'"), df.where("kind = 'get'")).collect()} == want
    df.coalesce(1).write.parquet(str(tmp_path / "in"))
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    stream = spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))
    q = state.read_once_stream(stream).writeStream.format("memory").queryName("once").option("checkpointLocation", str(tmp_path / "c")).outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert {r["seq"]: r["found"] for r in spark.table("once").collect()} == want


def test_a_second_entry_outlives_the_first_ones_timer(spark, tmp_path):
    """Two entries of one token in micro-batches of their own, then time that passes, then a read."""
    at = lambda s: f"2024-01-01 00:{s // 60:02d}:{s % 60:02d}"
    steps = [("a", 0, 0, "put"), ("a", 1, 200, "put"), ("z", 2, 350, "put"), ("z", 3, 400, "put"), ("a", 4, 450, "get")]
    rows = lambda some: spark.createDataFrame([(k, n, at(s), kind) for k, n, s, kind in some], "token string, seq long, t string, kind string").select("token", "seq", F.to_timestamp("t").alias("ts"), "kind")
    batch = {r["seq"]: r["found"] for r in state.read_once(rows(steps).where("kind = 'put'"), rows(steps).where("kind = 'get'")).collect()}
    assert batch == {4: True}
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    schema, told = rows(steps).schema, {}
    for i, step in enumerate(steps):
        rows([step]).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        stream = spark.readStream.schema(schema).parquet(str(tmp_path / "in"))
        q = state.read_once_stream(stream).writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "c")).outputMode("append").trigger(availableNow=True).start()
        q.awaitTermination(120)
    told = {r["seq"]: r["found"] for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    assert told == batch


def test_sentences_add_up_whatever_signs_they_hold(spark):
    texts = ["One. Two\u0001three. Four", "\u0001", "a\n\nb! \u0001 c?\u00a0d", "", " . ", "x" * 200_000 + ". y"]
    for r in spark.createDataFrame([(t,) for t in texts], "t string").select("t", T.sentences("t").alias("s")).collect():
        assert "".join(r["s"]) == r["t"] and all(r["s"])
    assert spark.createDataFrame([("One. Two\u0001three. Four",)], "t string").select(T.sentences("t").alias("s")).first()["s"] == ["One. ", "Two\u0001three. ", "Four"]
