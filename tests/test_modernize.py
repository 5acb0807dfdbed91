import io
import zipfile

from quire.operators import archive as A
from quire.operators import modernize as M
from quire.operators import package as K

CONTAINER = b'<container xmlns="urn:c"><rootfiles><rootfile full-path="OEBPS/c.opf"/></rootfiles></container>'
OPF = b"""<package xmlns="http://www.idpf.org/2007/opf" version="2.0" prefix="msv: http://x"><metadata xmlns:dc="http://purl.org/dc/elements/1.1/"><dc:title>T</dc:title></metadata>
<manifest><item id="ncx" href="toc.ncx" media-type="application/x-dtbncx+xml"/><item id="p" href="a%20b.png" media-type="image/png"/><item id="q" href="tiny.png" media-type="image/png"/><item id="f" href="f.ttf" media-type=""/><item id="c" href="c1.xhtml" media-type="application/xhtml+xml"/></manifest>
<guide><reference type="text" href="c1.xhtml" title="Start"/></guide></package>"""
NCX = b"""<!DOCTYPE ncx PUBLIC "x" "y"><ncx><docTitle><text>Book</text></docTitle><navMap><navPoint><navLabel><text>One</text></navLabel><content src="c1.xhtml"/><navPoint><navLabel><text>Sub</text></navLabel><content src="c1.xhtml#s"/></navPoint></navPoint></navMap></ncx>"""
PAGE = b'<!DOCTYPE html PUBLIC "-//W3C//DTD XHTML 1.1//EN" "x"><html><head></head><body><p>One. Two.</p><img src="a%20b.png"><img src="tiny.png"/></body></html>'


def encoder(data, quality, kind):
    return data[: len(data) // 2] if len(data) > 100 and quality == 80 else data + b"x"


def test_a_book_is_modernized_and_a_broken_one_is_left(spark):
    entries = [("mimetype", A.MIMETYPE), ("META-INF/container.xml", CONTAINER), ("OEBPS/c.opf", OPF), ("OEBPS/toc.ncx", NCX), ("OEBPS/c1.xhtml", PAGE), ("OEBPS/a b.png", b"p" * 1000), ("OEBPS/tiny.png", b"t" * 10), ("OEBPS/f.ttf", b"ttf")]
    rows = [("b", i, p, d) for i, (p, d) in enumerate(entries)] + [("x", 0, "META-INF/container.xml", CONTAINER)]
    df = spark.createDataFrame(rows, "book_id string, ord int, path string, data binary")
    options = M.Options(target="3.4", spans=True, policy="fixed")
    new, shots, lint = M.modernized(df, options, encoder)
    got = {(r["book_id"], r["path"]): bytes(r["data"]) for r in new.collect()}
    assert got["x", "META-INF/container.xml"] == CONTAINER
    assert len(got["b", "OEBPS/a b.webp"]) == 500 and ("b", "OEBPS/a b.png") not in got and got["b", "OEBPS/tiny.png"] == b"t" * 10
    info = K.info_of(got["b", "OEBPS/c.opf"].decode())
    items = {i["id"]: i for i in info["items"]}
    assert info["version"] == "3.0" and not info["has_guide"] and items["p"]["href"] == "a%20b.webp" and items["p"]["media_type"] == "image/webp" and items["f"]["media_type"] == "font/ttf" and items["nav"]["href"] == "nav.xhtml"
    page = got["b", "OEBPS/c1.xhtml"].decode()
    assert page.startswith("<!DOCTYPE html><html xmlns=") and 'src="a b.webp"' in page and 'id="kobo.1.2"' in page
    nav = got["b", "OEBPS/nav.xhtml"].decode()
    assert '<a href="c1.xhtml">One</a><ol><li><a href="c1.xhtml#s">Sub</a>' in nav and "bodymatter" in nav
    assert {(r["name"], r["kept"]) for r in shots.collect()} == {("a b.png", False), ("tiny.png", True)}
    features = {r["feature"] for r in lint.collect()}
    assert any("msv" in f for f in features) and any("HTML syntax" in f for f in features)
    originals = spark.createDataFrame([("b", "b.epub", 9000)], "book_id string, filename string, size long")
    done = M.reports(originals, new, shots, lint, options, "2000-01-01 00:00:00").where("book_id = 'b'").first()
    assert "encoded as WebP: 1; left as they were, being no larger: 1" in done["report"] and "b_v3.4.epub" in done["report"]
    assert zipfile.ZipFile(io.BytesIO(bytes(done["data"]))).namelist()[0] == "mimetype"


def test_books_without_a_package_are_told(spark):
    rows = [("x", 0, "META-INF/container.xml", CONTAINER), ("y", 0, "a.html", b""), ("z", 0, "META-INF/container.xml", CONTAINER), ("z", 1, "OEBPS/c.opf", b"<package")]
    got = {r["book_id"]: r["error"] for r in M.problems(spark.createDataFrame(rows, "book_id string, ord int, path string, data binary")).collect()}
    assert got["x"] == "the package is missing" and got["y"] == "no package is named" and got["z"].startswith("not well-formed")


def test_commands(spark, tmp_path, capsys):
    from quire.__main__ import main

    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "b.epub").write_bytes(A.container_of([("META-INF/container.xml", CONTAINER), ("OEBPS/c.opf", OPF), ("OEBPS/toc.ncx", NCX), ("OEBPS/c1.xhtml", PAGE)]))
    main(["archive", str(tmp_path / "in"), "-o", str(tmp_path / "arc")])
    main(["restore", str(tmp_path / "arc"), "-o", str(tmp_path / "back")])
    assert zipfile.ZipFile(tmp_path / "back" / "b.epub").read("OEBPS/c.opf") == OPF
    assert main(["restore", str(tmp_path / "arc"), "-o", str(tmp_path / "again"), "--target", "3.4", "--spans"]) == 0
    again = zipfile.ZipFile(tmp_path / "again" / "b.epub")
    assert "OEBPS/nav.xhtml" in again.namelist() and b"kobo.1.1" in again.read("OEBPS/c1.xhtml")
    (tmp_path / "arc" / "broken.eparc").write_bytes(b"no archive")
    capsys.readouterr()
    assert main(["restore", str(tmp_path / "arc"), "-o", str(tmp_path / "back")]) == 1
    assert "broken.eparc: " in capsys.readouterr().err
    assert main(["set", str(tmp_path / "in"), "-o", str(tmp_path / "set"), "--title", "New & old", "--authors", "A", "--authors", "B", "--series", "S", "--position", "2"]) == 0
    info = K.info_of(zipfile.ZipFile(tmp_path / "set" / "b.epub").read("OEBPS/c.opf").decode())
    assert [e["text"] for e in info["elements"] if e["tag"] in ("title", "creator")] == ["New & old", "A", "B"] and any(e["property"] == "group-position" and e["text"] == "2" for e in info["elements"])
    capsys.readouterr()
    main(["show", str(tmp_path / "in")])
    assert "Title:        T" in capsys.readouterr().out
    main(["optimize", str(tmp_path / "in"), "-o", str(tmp_path / "new")])
    assert "OEBPS/nav.xhtml" in zipfile.ZipFile(tmp_path / "new" / "b_v3.3.epub").namelist()
    (tmp_path / "md").mkdir()
    (tmp_path / "md" / "1.md").write_text("# My Book\ntext")
    main(["import", str(tmp_path / "md"), "-o", str(tmp_path / "made")])
    assert (tmp_path / "made" / "My_Book.epub").exists()
