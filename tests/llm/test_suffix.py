import hashlib
import random
from collections import Counter

import numpy as np
import pytest

from quire.llm import suffix


def brute(texts, length):
    """Marks of the covered bytes."""
    seen = Counter(t[i : i + length] for t in texts for i in range(len(t) - length + 1))
    out = []
    for t in texts:
        mark = bytearray(len(t))
        for i in range(len(t) - length + 1):
            if seen[t[i : i + length]] > 1:
                mark[i : i + length] = b"\1" * length
        out.append(bytes(mark))
    return out


def expected(text, mark):
    kept = bytes(c for c, m in zip(text, mark, strict=True) if not m)
    return len(text), sum(mark), bytes(mark).replace(b"\0", b" ").split().__len__(), hashlib.sha256(kept).hexdigest()


def test_merge_sort_with_hashed_comparisons():
    rng = np.random.default_rng(0)
    for _ in range(150):
        n, w = int(rng.integers(1, 40)), int(rng.integers(1, 8))
        group, size = np.sort(rng.integers(0, 4, n)), rng.integers(0, w + 1, n)
        text = np.where(np.arange(w) < size[:, None], rng.integers(0, 2, (n, w)), 0).astype(np.uint8)
        order, lcp = suffix.suffix_order(group, text, size)
        rows = [(group[i], bytes(text[i, : size[i]])) for i in range(n)]
        assert list(order) == sorted(range(n), key=lambda i: (rows[i], i))
        for k in range(1, n):
            (g, a), (f, b) = rows[order[k - 1]], rows[order[k]]
            same = next((i for i in range(min(len(a), len(b))) if a[i] != b[i]), min(len(a), len(b)))
            assert lcp[k] == (-1 if g != f else w if a == b else same)


def test_a_deceived_hash_is_noticed(monkeypatch):
    monkeypatch.setattr(suffix, "powers", lambda base, n: np.zeros(n + 1, np.uint64))
    text = np.array([[2, 1], [1, 2], [1, 1]], np.uint8)
    order, lcp = suffix.suffix_order(np.zeros(3, int), text, np.full(3, 2))
    assert order.tolist() == [2, 1, 0] and lcp.tolist() == [-1, 1, 0]


def corpus(seed, length):
    rng = random.Random(seed)
    letters = "abcdefghij é" if seed % 3 else "ab"
    base = ["".join(rng.choices(letters, k=rng.randint(length // 2, 3 * length))) for _ in range(4)]
    texts = []
    for _ in range(rng.randint(4, 14)):
        parts = [rng.choice(base)[rng.randint(0, length // 2) : rng.randint(length // 2, 3 * length)] if rng.random() < 0.7 else "".join(rng.choices("wxyz", k=rng.randint(0, 60))) for _ in range(rng.randint(0, 5))]
        texts.append("".join(parts) if rng.random() > 0.1 else "a" * rng.randint(0, 4 * length))
    return [None, "", "short", *texts, texts[0]]


def told(rows):
    return {r["doc_id"]: (r["n_bytes"], r["n_removed"], r["n_spans"], hashlib.sha256(r["kept"]).hexdigest(), r["n_repeated"]) for r in rows}


def wanted(texts, length, also):
    raw = [(t or "").encode() for t in texts]
    return {i: (*expected(t, m), sum(s)) for i, (t, m, s) in enumerate(zip(raw, brute(raw, length), brute(raw, also), strict=True))}


@pytest.mark.parametrize("seed", range(6))
def test_query_against_brute_force(spark, seed):
    length, also = ((40, 32), (64, 64), (400, 250))[seed % 3]
    texts = corpus(seed, length)
    df = spark.createDataFrame([(i, t, i) for i, t in enumerate(texts)], "doc_id long, text string, data int").repartition(3)
    assert told(suffix.dedup(df, length=length, also=also).collect()) == wanted(texts, length, also)


@pytest.mark.parametrize("seed", range(4))
def test_large_groups_are_halved(spark, seed):
    """Many different texts around few passages: groups of more than ``most`` contexts, halved down to one d."""
    rng = random.Random(seed)
    base = ["".join(rng.choices("abcdefgh" if seed % 2 else "abcé日", k=90 if seed % 2 else 50)) for _ in range(2)]
    texts = []
    for _ in range(40):
        p, edge = rng.choice(base), rng.choice(["", "xyxyxyxyxy", "yx"])
        texts.append("".join(rng.choices("xy", k=rng.randint(0, 30))) + edge + p[rng.choice([0, 0, 0, 20]) :] + edge + "".join(rng.choices("xy", k=rng.randint(0, 30))))
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    want = wanted(texts, 60, 40)
    for most in (3, 10):
        assert told(suffix.dedup(df, length=60, also=40, most=most).collect()) == want


def test_equal_hashes_of_different_bytes_are_told_apart():
    data = np.frombuffer(b"abcabdabc", np.uint8)
    at = lambda *x: np.array(x)
    assert suffix._equal_bytes(data, at(0, 0, 0), at(3, 6, 3), at(3, 3, 2)).tolist() == [False, True, True]
    c, x = suffix._digests(memoryview(b"aaaaaa"), at(2, 3, 2, 2), at(1, 1, 2, 1), at(2, 2, 1, 3))
    assert len({*zip(c.tolist(), x.tolist(), strict=True)}) == 3


def test_long_texts_in_pieces(spark, monkeypatch):
    text = "".join(random.Random(3).choices("abcdef ", k=9000))
    df = spark.createDataFrame([(1, text), (2, text[2000:7000] + "#")], "doc_id long, text string")
    got = {r["doc_id"]: (r["n_removed"], r["n_spans"]) for r in suffix.dedup(df).collect()}
    assert got == {1: (5000, 1), 2: (5000, 1)}


def test_repeated_rows_null_ids_and_empty_tables(spark):
    text = "".join(random.Random(5).choices("abcdef ", k=900))
    df = spark.createDataFrame([(1, text), (1, text), (None, text[:300]), (7, "x" * 500)], "doc_id long, text string")
    got = sorted((r["doc_id"] or 0, r["n_removed"]) for r in suffix.dedup(df).collect())
    assert got == [(0, 0), (1, 900), (1, 900), (7, 500)]
    edge = spark.createDataFrame([(2**63 - 1, text), (None, text), (None, None)], "doc_id long, text string")
    rows = sorted(((r["doc_id"], r["n_removed"]) for r in suffix.dedup(edge, also=None).collect()), key=repr)
    assert rows == [(2**63 - 1, 900), (None, 0), (None, 900)]
    with pytest.raises(TypeError, match="whole numbers"):
        suffix.dedup(edge.select(suffix.F.lit("a").alias("doc_id"), "text"))
    assert suffix.dedup(df.limit(0)).count() == 0
