import re
from collections import Counter

from quire.llm import quality


def brute(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    seen = Counter(windows)
    covered = {j for i, w in enumerate(windows) if seen[w] > 1 for j in range(i, i + 3)}
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    symbols = sum(c in quality.SYMBOLS for c in text)
    return len(words), sum(map(len, words)), symbols, len(lines) - len(set(lines)), len(covered)


TEXTS = [None, "", " \t\n", "a", "a b", "a b c", "a b c a b c", "a a a a", "x y z\x1fw \x85", "a\nb\n\na\n a\n", "#|<> $ é😀", "a b c d a b c e b c d " * 50]


def test_measures_match_brute_force(spark):
    df = spark.createDataFrame([(i, t, 7) for i, t in enumerate(TEXTS)], "doc_id long, text string, n_words int")
    for r in quality.measure(df).collect():
        got = (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"])
        assert got == brute(TEXTS[r["doc_id"]]), TEXTS[r["doc_id"]]


def test_hosts_pull_documents_along(spark):
    good, bad = " ".join(f"w{i}" for i in range(60)), "x"
    rows = [(i, bad, "spam") for i in range(200)] + [(1000, good, "spam")] + [(2000 + i, good + f" {i}", "fine") for i in range(200)] + [(3000, None, None), (3000, None, None)]
    got = quality.judge(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()
    assert len(got) == len(rows)
    kept = {r["doc_id"]: r["kept"] for r in got}
    assert not kept[1000] and all(kept[2000 + i] for i in range(200)) and not kept[3000]
    assert not next(r for r in got if r["doc_id"] == 1000)["base_failed"]


def test_empty_table(spark):
    assert quality.judge(spark.createDataFrame([], "doc_id long, text string, source string")).count() == 0
