import base64
import hashlib
import io
import itertools
import random
import zipfile
from pathlib import Path

import numpy as np
import pyarrow as pa
import public_tokenizers
import pytest
import tiktoken
from pyarrow import fs
from pyspark.sql import functions as F

import corpus_pipeline
from quire.llm import bpe, packing, syncmers, warc
from quire.llm.common import new_folder


# Packing


def padding(histogram, ends):
    return sum(c * (min(e for e in ends if e >= n) - n) for n, c in histogram.items())


def test_bucket_ends_are_optimal():
    rng = random.Random(1)
    for _ in range(60):
        histogram = {n: rng.randint(1, 9) for n in rng.sample(range(1, 30), rng.randint(1, 9))}
        k = rng.randint(1, 5)
        best = min(padding(histogram, [*c, max(histogram)]) for r in range(min(k, len(histogram))) for c in itertools.combinations(sorted(histogram)[:-1], r))
        ends = packing.bucket_ends(histogram, k)
        assert len(ends) <= k and ends[-1] == max(histogram) and padding(histogram, ends) == best


def test_batches_hold_the_budget_and_every_token(spark, monkeypatch):
    monkeypatch.setattr(packing, "TOGETHER", 4)
    rng = random.Random(2)
    docs = [(i, " ".join("w" * rng.randint(0, 90)), "x") for i in range(150)] + [(1, "a b", "x"), (1, "a b", "x"), (None, None, "x"), (7, "", "x")]
    df = spark.createDataFrame([(*d, len((d[1] or "").split()) or None) for d in docs], "doc_id long, text string, slot string, n int")
    rows = packing.pack(df, length="n", max_len=32, buckets=4, budget=100).collect()
    assert sum(r["n_tokens"] for r in rows) == sum(len((t or "").split()) for _, t, _ in docs)
    batches = {}
    for r in rows:
        if not r["n_tokens"]:
            assert r["batch_id"] is None and r["slot"] is None
            continue
        assert r["n_tokens"] <= r["bucket_len"] and r["start"] == 32 * r["segment"]
        batches.setdefault(r["batch_id"], []).append(r)
    for held in batches.values():
        e = held[0]["bucket_len"]
        assert {r["bucket_len"] for r in held} == {e} and len(held) <= max(1, 100 // e)
        assert sorted(r["slot"] for r in held) == list(range(len(held)))
    assert len({r["bucket_len"] for r in rows if r["bucket_len"]}) <= 4
    assert packing.pack(df.limit(0)).count() == 0


def test_whole_packing_against_brute_force(spark, monkeypatch):
    monkeypatch.setattr(packing, "TOGETHER", 1000)
    rng = random.Random(3)
    docs = [(i if i % 9 else None, rng.choice(["", " ", "a", "été "]) + " ".join(rng.choices(["cat", "Straße", "日本語", "12.5", "\n\n", "supercalifragilistic"], k=rng.choice([0, 1, 5, 40])))) for i in range(60)]
    docs += [(4, "one two")] * 7 + [(5, None)]
    library = bpe_library()
    lengths = [len(library.encode_ordinary(t or "")) for _, t in docs]
    pieces = []
    for (d, t), n in zip(docs, lengths, strict=True):
        pieces += [(d, s, 24 * s, min(24, n - 24 * s), t) for s in range(max(1, -(-n // 24)))]
    histogram = {n: sum(p[3] == n for p in pieces) for n in {p[3] for p in pieces} - {0}}
    best = min((padding(histogram, c), c) for r in (1, 2, 3) for c in itertools.combinations(sorted(histogram), r) if c[-1] == max(histogram))
    rows = packing.pack(spark.createDataFrame(docs, "doc_id long, text string").repartition(3), max_len=24, buckets=3, budget=70).collect()
    ends = sorted({r["bucket_len"] for r in rows} - {None})
    assert padding(histogram, ends) == best[0]
    want = [(d, s, a, 0, None, None, None) for d, s, a, n, _ in pieces if not n]
    for e in ends:
        held = [p for p in pieces if p[3] and min(x for x in ends if x >= p[3]) == e]
        parts = -(-len(held) // (packing.TOGETHER * (70 // e)))
        assert parts == 1
        held.sort(key=lambda p: (p[0] is not None, p[0] or 0, p[1]))
        for i in range(len(held)):
            tied = sorted({p[3] for p in held if p[:2] == held[i][:2]})
            want.append((*held[i][:3], tied, e, f"{e}-0-{i // (70 // e)}", i % (70 // e)))
    got = sorted(map(tuple, rows), key=lambda r: (r[4] or 0, r[5] or "", r[6] or 0, repr(r)))
    want.sort(key=lambda r: (r[4] or 0, r[5] or "", r[6] or 0, repr(r)))
    assert len(got) == len(want)
    for g, w in zip(got, want, strict=True):  # rows of one id stand in the order of a hash
        assert (*g[:3], *g[4:]) == (*w[:3], *w[4:]) and (g[3] in w[3] if w[3] else not g[3])
    assert sorted((r[0] is None, r[0] or 0, *r[1:4]) for r in got) == sorted((p[0] is None, p[0] or 0, *p[1:4]) for p in pieces)


def bpe_library():
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, Path(public_tokenizers.path(bpe.RANKS)).read_bytes().splitlines())}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


# Fingerprints


def slow_anchors(text):
    c = [ord(x) for x in text]
    m, mask = 0x9E3779B97F4A7C15, (1 << 64) - 1

    def mix(x):
        x = (x ^ (x >> 30)) * 0xBF58476D1CE4E5B9 & mask
        x = (x ^ (x >> 27)) * 0x94D049BB133111EB & mask
        return x ^ (x >> 31)

    def inner(i):
        h = 0
        for x in c[i : i + syncmers.S]:
            h = (h * m + x) & mask
        return mix(h)

    w = syncmers.K - syncmers.S + 1
    out = []
    for i in range(len(c) - syncmers.K + 1):
        s = [inner(i + j) for j in range(w)]
        if min(s) in (s[0], s[-1]):
            out.append(i)
    return out


def test_anchors_are_closed_syncmers_and_context_free():
    rng = random.Random(1)
    text = "".join(rng.choices("abc dé", k=300))
    at, h = syncmers.anchors(text)
    assert at.tolist() == slow_anchors(text)
    moved, g = syncmers.anchors("zz" + text[50:250] + "q")
    inside = {int(a): int(x) for a, x in zip(at, h, strict=True) if 50 <= a <= 250 - syncmers.K}
    assert {int(a) - 2 + 50: int(x) for a, x in zip(moved, g, strict=True) if 2 <= a <= 202 - syncmers.K} == inside


def test_likeness_is_about_what_two_texts_share():
    rng = random.Random(3)
    word = lambda: "".join(rng.choices("abcdefgh", k=6))
    a, b = (" ".join(word() for _ in range(400)) for _ in range(2))
    fa, fb, fe = (syncmers.fingerprint(x) for x in (a, b, syncmers.edited(a, b)))
    assert syncmers.likeness(fa, fa) == 1 and syncmers.likeness(fa, fb) < 0.1
    assert 0.3 < syncmers.likeness(fa, fe) < 0.75
    assert syncmers.likeness("", "") == 1 and syncmers.likeness(fa, "") == 0
    short = ["alpha beta gamma", "unrelated words!", "a", "", *("".join(rng.choices("abcdefgh ", k=rng.randint(16, 22))) for _ in range(200))]
    prints = [syncmers.fingerprint(x) for x in short]
    assert all(prints[:3]) and all(prints[4:]) and len(set(prints)) == len(set(short))
    assert syncmers.likeness(prints[0], prints[1]) == syncmers.likeness(prints[0], "") == 0
    assert syncmers.fingerprint(None) == syncmers.fingerprint("") == ""
    assert len(base64.b64decode(syncmers.fingerprint("short"))) == 4


def plain_print(text):
    """A fingerprint by the words of the module's description: slow, and without its code but the two hashes."""
    m, mask = 0x9E3779B97F4A7C15, (1 << 64) - 1

    def mix(x):
        x = (x ^ (x >> 30)) * 0xBF58476D1CE4E5B9 & mask
        x = (x ^ (x >> 27)) * 0x94D049BB133111EB & mask
        return x ^ (x >> 31)

    def inner(x):
        h = 0
        for c in x:
            h = (h * m + ord(c)) & mask
        return mix(h)

    first = {}
    for i in slow_anchors(text):
        h = 0
        for j in (0, 5, 10):
            h = mix((h + inner(text[i + j : i + j + 5])) & mask)
        first.setdefault(mix((h + inner(text[i + 11 : i + 16])) & mask) >> 32, i)
    if not first and text:
        first = {int.from_bytes(hashlib.blake2b(text.encode(), digest_size=4).digest(), "little"): 0}
    return sorted(sorted(first)[:64], key=first.get)


def plain_likeness(x, y):
    if x == y:
        return 1.0
    if not x or not y:
        return 0.0
    union = sorted({*x, *y})[:64]
    a, b = ([v for v in z if v in x and v in y and v in union] for z in (x, y))
    best = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i, v in enumerate(a):
        for j, w in enumerate(b):
            best[i + 1][j + 1] = best[i][j] + 1 if v == w else max(best[i][j + 1], best[i + 1][j])
    return best[-1][-1] / len(union)


def test_whole_query_against_a_plain_version(spark, tmp_path):
    rng = random.Random(12)
    word = lambda: "".join(rng.choices("abcdeé\U0001f600", k=rng.randint(1, 7)))
    docs = [(rng.choice([3 * i, 2**40 + i]), " ".join(word() for _ in range(rng.choice([0, 1, 3, 30, 400])))) for i in range(30)]
    docs += [(2**62, docs[3][1]), (-5, None), (2**63 - 1, "x" * 40)]
    spark.createDataFrame([(d, t, "en", "s", 0) for d, t in docs], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    order = sorted(docs, reverse=True, key=lambda x: x[0])
    want = {}
    for i, (d, t) in enumerate(order):
        t, following = t or "", order[(i + 1) % len(order)][1] or ""
        changed = t[: len(t) - len(t) // 3] + following[: len(t) // 3]
        own, new, after = map(plain_print, (t, changed, following))
        want[d] = (len(t), hashlib.sha256(changed.encode()).hexdigest(), own, new, plain_likeness(own, new), plain_likeness(own, after))
    shown = lambda v: np.frombuffer(base64.b64decode(v), "<u4").tolist()
    got = {r["doc_id"]: (r["n_chars"], r["edited_sha256"], shown(r["fingerprint"]), shown(r["edited_fingerprint"]), r["near_edited"], r["near_next"]) for r in syncmers.op9_syncmer_fingerprints(spark, str(tmp_path)).collect()}
    assert got == want


def test_the_query_compares_all_anchors_of_long_texts(spark, tmp_path):
    rng = random.Random(14)
    word = lambda: "".join(rng.choices("abcdefgh", k=5))
    passage = " ".join(word() for _ in range(20))
    docs = [(i, " ".join([*(word() for _ in range(300)), *([passage] if i % 3 else []), *(word() for _ in range(200))])) for i in range(5)]
    docs += [(5, docs[4][1][300:] + docs[4][1][:300]), (6, None), (7, ""), (8, "short"), (9, "short")]
    spark.createDataFrame(docs, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")

    def every(text):
        at, h = syncmers.anchors(text)
        assert at.tolist() == slow_anchors(text) or len(at) < 2
        return list(dict.fromkeys(h.tolist()))

    def shared(x, y):
        if x == y:
            return 1.0
        a, b = ([v for v in z if v in both] for both in [{*x} & {*y}] for z in (x, y))
        best = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i, v in enumerate(a):
            for j, w in enumerate(b):
                best[i + 1][j + 1] = best[i][j] + 1 if v == w else max(best[i][j + 1], best[i + 1][j])
        return best[-1][-1] / len({*x, *y})

    order = sorted(docs, reverse=True)
    want = {}
    for i, (d, t) in enumerate(order):
        t, following = t or "", order[(i + 1) % len(order)][1] or ""
        x, e, y = map(every, (t, t[: len(t) - len(t) // 3] + following[: len(t) // 3], following))
        want[d] = (len(x), shared(x, e), shared(x, y))
    got = {r["doc_id"]: r for r in syncmers.op9_syncmer_fingerprints(spark, str(tmp_path)).collect()}
    assert {d: (r["n_anchors"], r["overlap_edited"], r["overlap_next"]) for d, r in got.items()} == want
    assert want[2][0] > 64 and want[2][2] > 0 == want[1][2]


def test_one_far_id_does_not_gather_all_others(spark):
    df = spark.createDataFrame([(i, "t") for i in range(400)] + [(2**60, "t")], "doc_id long, text string")
    sizes = [r["count"] for r in syncmers._dealt(df, "doc_id").groupBy("_part").count().collect()]
    assert len(sizes) >= 12 and max(sizes) < 100


@pytest.mark.parametrize("n", [0, 1, 2, 3, 15, 16, 17, 100])
def test_ranks_among_bounds(spark, n):
    rng = random.Random(n)
    bounds = sorted({rng.randint(-50, 2**62) if i % 3 else rng.randint(-50, 50) for i in range(n)})
    ids = [-51, 0, 2**63 - 1, *bounds, *(b + 1 for b in bounds)]
    df = spark.createDataFrame([(i,) for i in ids], "v long")
    assert {r["v"]: r["rank"] for r in df.select("v", syncmers._rank(F.col("v"), bounds).alias("rank")).collect()} == {i: sum(b <= i for b in bounds) for i in ids}


def test_ranges_from_few_chosen_ids_lose_no_row(spark, monkeypatch):
    monkeypatch.setattr(syncmers, "CHOSEN", 1)
    docs = [(i * i if i % 5 else None, f"text {i} " * 9) for i in range(400)] + [(7, "hot")] * 200
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    order = sorted(docs, key=lambda x: (x[0] is None, -(x[0] or 0), x[1].encode()))
    texts = [t for _, t in order]
    want = sorted(syncmers.hashlib.sha256(syncmers.edited(t, texts[(i + 1) % len(texts)]).encode()).hexdigest() for i, t in enumerate(texts))
    assert sorted(r["edited_sha256"] for r in syncmers.fingerprints(df).collect()) == want


def test_all_anchors_with_their_places(spark):
    rng = random.Random(2)
    text = "".join(rng.choices("abc é", k=500))
    df = spark.createDataFrame([(1, text, 0), (2, None, 0), (3, "short", 0)], "doc_id long, text string, places int")
    got = {r["doc_id"]: r for r in syncmers.positions(df).collect()}
    assert got[1]["places"] == slow_anchors(text) and len(got[1]["hashes"]) == len(got[1]["places"])
    assert got[2]["places"] == [] and got[3]["places"] == [0]
    with pytest.raises(TypeError, match="whole numbers"):
        syncmers.fingerprints(spark.createDataFrame([("a", "b")], "doc_id string, text string"))


@pytest.mark.parametrize("n", [0, 1, 2, 90])
def test_fingerprints_follow_falling_ids(spark, n):
    rng = random.Random(n)
    docs = [(rng.choice([i, i * 1000]), "".join(rng.choices("abc é\U0001f600", k=rng.choice([0, 2, 40, 200])))) for i in range(n)]
    docs += [(3, None), (3, "tie"), (3, "tie"), (None, "none"), (None, None)] if n > 2 else []
    df = spark.createDataFrame([(d, t, 0) for d, t in docs], "doc_id long, text string, n_chars int").repartition(3)
    order = sorted(docs, key=lambda x: (x[0] is None, -(x[0] or 0), x[1] is not None, (x[1] or "").encode()))
    want = []
    for i, (d, t) in enumerate(order):
        t, following = t or "", order[(i + 1) % len(order)][1] or ""
        cut = len(t) // 3
        e = t[: len(t) - cut] + following[:cut]
        f = syncmers.fingerprint(t)
        want.append((d, len(t), hashlib.sha256(e.encode()).hexdigest(), f, syncmers.fingerprint(e), syncmers.likeness(f, syncmers.fingerprint(e)), syncmers.likeness(f, syncmers.fingerprint(following))))
    got = [tuple(r) for r in syncmers.fingerprints(df).collect()]
    assert sorted(got, key=repr) == sorted(want, key=repr)


# Archives


def archive(records, deflate=False, index=True):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED if deflate else zipfile.ZIP_STORED) as z:
        z.writestr("datapackage.json", "{}" * 50)
        parts = [warc._member(r) for r in records]
        z.writestr(warc.DATA, b"".join(parts))
        if index:
            at = np.cumsum([0, *map(len, parts)])
            z.writestr(warc.INDEX, "".join(f'{{"offset": {a}, "length": {len(p)}}}\n' for a, p in zip(at, parts, strict=False)))
    return out.getvalue()


class Bytes(io.BytesIO):
    def size(self):
        return len(self.getvalue())


def test_ranges_of_stored_members_with_and_without_an_index():
    bodies = [b"x" * 5, b"", b"\r\n\r\n" + bytes(range(256)) * 300]
    records = [warc.record(i, f"http://a/{i}", b, hashlib.sha1(b).hexdigest()) for i, b in enumerate(bodies)]
    for index in (True, False):
        data = archive(records, index=index)
        ((start, places),) = warc.locate(Bytes(data))
        got = [warc.parse(warc.zlib.decompress(data[start + a : start + a + n], 31)) for a, n in places]
        assert [x["payload"] for x in got] == bodies
        assert [x["fields"]["warc-target-uri"] for x in got] == [f"http://a/{i}" for i in range(3)]
    with pytest.raises(ValueError, match="compressed"):
        warc.locate(Bytes(archive(records, deflate=True)))
    for broken in (b"", data[:100], data[:-30]):
        with pytest.raises((ValueError, KeyError)):
            warc.locate(Bytes(broken))


def test_zip64_directories(monkeypatch):
    monkeypatch.setattr(zipfile, "ZIP64_LIMIT", 40)
    monkeypatch.setattr(zipfile, "ZIP_FILECOUNT_LIMIT", 1)
    body = bytes(200)
    data = archive([warc.record(1, None, body, hashlib.sha1(body).hexdigest())])
    assert b"PK\x06\x06" in data and b"PK\x06\x07" in data
    ((start, ((a, n),)),) = warc.locate(Bytes(data))
    assert warc.parse(warc.zlib.decompress(data[start + a : start + a + n], 31))["payload"] == body


def test_archives_round_trip_on_odd_pages(spark):
    big, other = "é" * 600, "y" * 2000
    rows = [(1, "http://a/ b\r\nX: y", big), (2, None, big), (9, "u", big), (9, "u", big), (None, "n", big), (4, "u", None), (5, "u", "small"), (6, "u", "small"), (7, "u", other), (8, "u", "z" * 999)]
    df = spark.createDataFrame([(*r, 0) for r in rows], "page_id long, url string, html string, payload int")
    folder = new_folder(spark, "warc-test")
    got = warc.read(warc.write(warc.deduplicated(df), folder, records=3), folder, payload=True).collect()
    assert len(got) == len(rows)
    for page_id, _, html in rows:
        body = (html or "").encode()
        r = next(x for x in got if x["page_id"] == page_id and x["payload_bytes"] == len(body))
        revisit = html == big and page_id != 9
        assert r["record_type"] == ("revisit" if revisit else "response")
        assert r["refers_to"] == (9 if revisit else None)
        assert r["payload_digest"] == hashlib.sha1(body).hexdigest()
        assert r["payload"] == (None if revisit else body)
    empty = new_folder(spark, "warc-test")
    assert warc.read(warc.write(warc.deduplicated(df.limit(0)), empty), empty).count() == 0


def foreign(kind, url, payload, head=b"HTTP/1.1 200 OK\r\n\r\n", **fields):
    """A record as other writers make it, put together by hand."""
    block = head + payload
    more = "".join(f"{k.replace('_', '-')}: {v}\r\n" for k, v in fields.items())
    return f"WARC/1.0\r\nWARC-Type: {kind}\r\nWARC-Record-ID: <urn:uuid:{len(url)}-{kind}>\r\nWARC-Target-URI: {url}\r\n{more}Content-Length: {len(block)}\r\n\r\n".encode() + block + b"\r\n\r\n"


def test_archives_of_other_writers(spark, tmp_path):
    sha = lambda b: "sha1:" + base64.b32encode(hashlib.sha1(b).digest()).decode()
    one = [foreign("warcinfo", "", b"software: x", b""), foreign("response", "http://a/1", b"first", WARC_Payload_Digest=sha(b"first")), foreign("request", "http://a/1", b"", b"GET / HTTP/1.1\r\n\r\n")]
    two = [foreign("response", "http://a/2", b"5\r\nhello\r\n0\r\n\r\n", b"HTTP/1.1 200 OK\r\nContent-Length: 5\r\nTransfer-Encoding: chunked\r\n\r\n"), foreign("resource", "urn:3", b"plain \r\n\r\n bytes", b"")]
    three = [foreign("response", "http://a/4", b"fourth"), foreign("revisit", "http://a/5", b"", WARC_Payload_Digest="sha1:" + hashlib.sha1(b"first").hexdigest())]
    four = [foreign("response", "http://a/6", b"sixth"), foreign("response", "http://a/7", b"seventh")]
    gz = lambda records: [warc.gzip.compress(r) for r in records]
    at = lambda parts: list(np.cumsum([0, *map(len, parts)]))
    a, c, d = gz(one), gz(three), gz(four)
    cdxj = f'a)/1 20200101000000 {{"url": "http://a/1", "filename": "rec-1.warc.gz", "offset": "{at(a)[1]}", "length": "{len(a[1])}"}}\n'
    cdx = " CDX N b a m s k r M S V g\n" + "".join(f"a)/{i} 20200101 http://a/{i} text/html 200 X - - {len(x)} {p} nested/rec-3.warc.gz\n" for i, (x, p) in enumerate(zip(c, at(c), strict=False)))
    with zipfile.ZipFile(tmp_path / "x.wacz", "w", zipfile.ZIP_STORED) as z:
        z.writestr("archive/rec-1.warc.gz", b"".join(a))
        z.writestr("archive/rec-2.warc", b"".join(two))
        z.writestr("archive/nested/rec-3.warc.gz", b"".join(c))
        z.writestr("archive/rec-4.warc.gz", b"".join(d))
        z.writestr("archive/readme.txt", "no records")
        z.writestr("indexes/index.cdxj", cdxj)
        z.writestr("indexes/other.cdx.gz", warc.gzip.compress(cdx.encode()))
        z.writestr("indexes/four.cdxj", '!meta 0 {"format": "x"}\na)/6 2020 {"filename": "rec-4.warc.gz", "offset": 0}\n')
    got = {r["url"]: r for r in warc.read(spark.createDataFrame([(str(tmp_path / "x.wacz"),)], "path string"), str(tmp_path), payload=True).collect()}
    bodies = {"http://a/1": b"first", "http://a/2": b"5\r\nhello\r\n0\r\n\r\n", "urn:3": b"plain \r\n\r\n bytes", "http://a/4": b"fourth", "http://a/5": None, "http://a/6": b"sixth", "http://a/7": b"seventh"}
    assert {u: None if r["payload"] is None else bytes(r["payload"]) for u, r in got.items()} == bodies
    assert all(r["payload_digest"] == hashlib.sha1(bodies[u] or b"first").hexdigest() and r["page_id"] is None for u, r in got.items())
    assert got["http://a/5"]["record_type"] == "revisit" and got["http://a/5"]["payload_bytes"] is None and got["urn:3"]["record_type"] == "resource"


def test_a_changed_payload_is_noticed():
    body = b"x" * 50
    data = warc.record(1, "u", body, hashlib.sha1(body).hexdigest()).replace(b"xxx", b"xyx", 1)
    with pytest.raises(ValueError, match="differs"):
        warc._told(warc.parse(data), False)


# The pipeline


def test_pipeline_stage_by_stage(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    columns, before = docs.columns, docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        after = corpus_pipeline.written(stage(spark, before, sf), f"test-{name}")
        assert after.columns == columns
        assert after.select("doc_id").distinct().count() == after.count() <= before.count()
        if name in ("lines", "passages"):
            assert after.count() == before.count()
        before = after
    last = corpus_pipeline.STAGES[-1][1](spark, before, sf)
    library = bpe_library()
    tokens = sum(len(library.encode_ordinary(r["text"] or "")) for r in before.select("text").collect())
    assert last.agg({"n_tokens": "sum"}).first()[0] == tokens
    assert last.select("doc_id").distinct().count() == before.count()
    assert sorted(map(tuple, corpus_pipeline.run(spark, sf).collect()), key=repr) == sorted(map(tuple, last.collect()), key=repr)


def test_pipeline_of_nothing_and_of_odd_rows(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    odd = spark.createDataFrame([(None, None, None, None, None), (1, "", "en", "s", 0), (2, "the cat", "en", "s", 7), (2, "the cat", "en", "s", 7)], docs.schema)
    for start in (docs.limit(0), odd):
        now = start
        for _, stage in corpus_pipeline.STAGES:
            now = stage(spark, now, sf)
        assert now.count() <= start.count()


def test_pipeline_gives_what_a_small_corpus_should(spark, tmp_path):
    """Expected by hand: which documents stay, and what is left of their texts."""
    line = "Subscribe to our weekly letter and never miss a story again.\n"
    english = ["The old harbour wakes before the sun has touched its grey stone walls.", "Boats leave in silence while the bakers carry bread along the quay.", "Nobody speaks of the storm that broke the lighthouse many winters ago."]
    english[:0] = ["A narrow road climbs from the square towards the abandoned monastery.", "Travellers rest there under two chestnut trees and drink cold water.", "From the terrace you can count eleven islands on a clear morning.", "The smallest of them belongs to a family of goat herders.", "They sell white cheese and honey at the ferry landing."]
    other = ["Our garden grows beans and onions behind the tall wooden fence.", "Each evening my sister waters the plants with rain from the barrel.", "When autumn comes we share the harvest with all the neighbours."]
    french = ["Le marché ouvre ses portes quand la brume quitte les toits.", "Les vendeurs crient les prix des poissons et des oranges.", "Une vieille femme choisit ses légumes avec beaucoup de soin."]
    passage = "".join(x + "\n" for x in ("La rivière traverse la ville depuis des siècles.", "Ses ponts relient les quartiers du nord au sud.", "Chaque printemps elle monte et inonde les caves.", "Les habitants la craignent mais ils l'aiment aussi."))
    fields = ["Dans les champs du sud le vent porte une odeur de lavande.", "Les enfants courent entre les rangs jusqu'au soir.", "Plus tard on allume un feu près de la grange."]
    text = lambda parts: "".join(p + "\n" for p in parts)
    docs = [
        (1, text(english) + line, "en"),
        (2, text([*english[:-1], english[-1].replace("ago.", "past.")]) + line, "en"),  # a near copy of 1
        (3, "12345 !! 67\n", "en"),  # no letter
        (4, text(other[:1]) + line + text(other[1:]), "en"),  # a line of six documents
        (5, line + text(french) + passage, "fr"),
        (6, text(fields[:2]) + passage + text(fields[2:]) + line, "fr"),  # a passage of 5
        (7, None, "fr"),
        (8, text(english) + line, "en"),  # a copy of 1
    ]
    spark.createDataFrame([(d, t, k, "s", len(t or "")) for d, t, k in docs], "doc_id long, text string, lang string, source string, n_chars long").repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    want = {1: docs[0][1], 4: text(other), 5: text(french) + passage, 6: text(fields)}
    library = bpe_library()
    lengths = {d: len(library.encode_ordinary(t)) for d, t in want.items()}
    rows = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert {r["doc_id"]: r["n_tokens"] for r in rows} == lengths
    assert all(r["segment"] == r["start"] == 0 and r["bucket_len"] == r["n_tokens"] for r in rows)  # a bucket for each length
    slots = {}
    for r in sorted(rows, key=lambda r: r["doc_id"]):
        slots.setdefault(r["batch_id"], []).append((r["n_tokens"], r["slot"]))
    assert sorted(slots) == sorted({f"{n}-0-0" for n in lengths.values()})
    assert all([s for _, s in held] == list(range(len(held))) for held in slots.values())
