import random
import re

import numpy as np
import pytest
import xxhash

from quire.llm import linetree, spans


def test_parts_add_up():
    for t in ["", "a", "a. b.", "\n\na\r\n b.\n", 'He said "go." Then. ', "x\n", "a.b c!?  d"]:
        assert "".join(spans.sentences(t)) == t
        assert "".join(linetree.split_lines(t)) == t


def brute_spans(docs, least, count, alone):
    """The sentences to remove of (doc, text) in order."""
    cut = {d: spans.sentences(t or "") for d, t in docs}
    words = {d: [len(s.split()) for s in c] for d, c in cut.items()}
    found = []
    for d in sorted(cut):
        n, w = len(cut[d]), words[d]
        own = set()
        for i in range(n):
            j = next((j for j in range(i + count, n + 1) if sum(w[i:j]) >= least), None)
            own |= {(i, j)} if j else set()
            k = next((k for k in range(i + 1 - count, -1, -1) if sum(w[k : i + 1]) >= least), None)
            own |= {(k, i + 1)} if k is not None else set()
            own |= {(i, i + 1)} if w[i] >= alone else set()
        found += [(d, a, b, tuple(" ".join(s.split()) for s in cut[d][a:b])) for a, b in own]
    first, gone = {}, {d: set() for d in cut}
    for d, a, b, key in sorted(found, key=lambda x: x[:2]):
        if first.setdefault(key, (d, a)) != (d, a):
            gone[d] |= set(range(a, b))
    return {d: "".join(s for i, s in enumerate(c) if i not in gone[d]) for d, c in cut.items()}


def test_spans_against_brute_force(spark):
    for seed in range(4):
        rng = random.Random(seed)
        pool = [" ".join(rng.choices("abcdef", k=rng.randint(1, 9))) + rng.choice([". ", "! ", "?\n", "\n"]) for _ in range(14)]
        passages = ["".join(rng.choices(pool, k=rng.randint(2, 6))) for _ in range(5)]
        docs = []
        for i in range(40):
            parts = [rng.choice(passages) if rng.random() < 0.6 else f"own {i} {j} words here. " for j in range(rng.randint(0, 6))]
            docs.append((i, "".join(parts)))
        docs.append((50, None))
        df = spark.createDataFrame([(d, t, "x") for d, t in docs], "doc_id long, text string, n_removed string").repartition(3)
        got = {r["doc_id"]: r["text"] for r in spans.dedup(df, least=8, count=2, alone=9).collect()}
        assert got[50] is None
        want = brute_spans(docs, 8, 2, 9)
        assert {d: t or "" for d, t in got.items()} == want


def test_a_passage_of_fifty_words_goes_and_clean_text_stays(spark):
    rng = random.Random(2)
    sentence = lambda: " ".join("".join(rng.choices("abcdefg", k=5)) for _ in range(rng.randint(6, 14))).capitalize() + ". "
    passage = "".join(sentence() for _ in range(6))
    clean = {i: [sentence() for _ in range(8)] for i in range(6)}
    docs = [(i, "".join(c[:4]) + (passage if i % 2 else "") + "".join(c[4:])) for i, c in clean.items()]
    got = {r["doc_id"]: r["text"] for r in spans.dedup(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    assert got[1] == docs[1][1]
    for i in (0, 2, 4):
        assert got[i] == docs[i][1]
    for i in (3, 5):
        assert got[i] == "".join(clean[i])


def test_span_rows_that_repeat_and_empty_tables(spark):
    text = "one two three four five six seven eight nine ten eleven twelve thirteen. " * 3
    df = spark.createDataFrame([(1, text), (1, text), (None, text)], "doc_id long, text string")
    rows = spans.dedup(df).collect()
    assert sorted((r["doc_id"] or 0, r["n_removed"]) for r in rows) == [(0, 3), (1, 2), (1, 2)]
    assert spans.dedup(df.limit(0)).count() == 0


def plain_tokens(line):
    """What a line's tokens are, by the words of the module's description."""
    own = line.split()
    letter = lambda w: any(c.isalpha() for c in w)
    digit = lambda w: any(c.isdigit() for c in w)
    masked = ["<*>" if digit(w) and not letter(w) else re.sub("[0-9]+", "<*>", w) for w in own]
    words = sum(letter(w) and not digit(w) for w in own)
    others = sum(m.count("<*>") if digit(w) else not letter(w) for w, m in zip(own, masked, strict=True))
    return masked if not any(map(digit, own)) or words >= others else [" ".join(own)]


def brute_lines(docs, depth=3, alike=0.6, documents=5, long=30):
    """Templates as lists of words, compared with all others; lines enter by the hash of their tokens."""
    rows = {}
    for d, t in docs:
        for i, line in enumerate(re.findall(r"[^\n]*\n|[^\n]+", t or "")):
            own = tuple(plain_tokens(line))
            if own:
                rows.setdefault(own, []).append((d, i, " ".join(line.split())))
    signed = lambda own: (h := xxhash.xxh3_64_intdigest(" ".join(own))) - (h >> 63 << 64)
    templates = {}
    for own in sorted(rows, key=signed):
        leaf = templates.setdefault((len(own), own[:depth]), [])
        tail = own[depth:]
        scores = [sum(a == b != "<*>" for a, b in zip(tail, first[depth:], strict=True)) for first, _ in leaf]
        if tail and scores and max(scores) >= alike * len(tail) - 1e-9:
            leaf[scores.index(max(scores))][1].extend(rows[own])
        else:
            leaf.append((own, list(rows[own])))
    gone = {d: set() for d, _ in docs}
    for leaf in templates.values():
        for _, found in leaf:
            if len({d for d, _, _ in found}) >= documents:
                head = min(d for d, _, _ in found)
                for d, i, _ in found:
                    gone[d] |= {i} - ({i} if d == head else set())
            else:
                for d, i, line in found:
                    if len(line.encode()) >= long and d != min(x for x, _, other in found if other == line):
                        gone[d].add(i)
    return {d: "".join(x for i, x in enumerate(re.findall(r"[^\n]*\n|[^\n]+", t or "")) if i not in gone[d]) for d, t in docs}


def test_the_index_of_a_large_leaf_finds_what_a_scan_finds(monkeypatch):
    rng = np.random.default_rng(3)
    for width in (4, 5, 8, 13):
        lines = [np.concatenate([[7, 7, 7], rng.integers(0, 6, width - 3)]).astype(np.uint32) for _ in range(400)]
        places = []
        for scanned in (10**9, 0):
            monkeypatch.setattr(linetree, "SCANNED", scanned)
            leaf = linetree.Leaf(linetree.ALIKE)
            places.append([leaf.place(x) for x in lines])
        assert places[0] == places[1] and 3 < max(places[0]) < 399


def test_lines_against_brute_force(spark):
    for seed in range(3):
        rng = random.Random(seed)
        frames = ["Page {} of {}", "Posted on {} by user {}", "All rights reserved.", "the quick brown {w} jumps over", "a {w} b c {w}", "we all like {w} and the {w} of a house so much", "Chapter {} 1.5 2", "all {w} of our offices are closed this week"]
        docs = []
        for i in range(60):
            out = []
            for _ in range(rng.randint(0, 8)):
                f = rng.choice(frames) if rng.random() < 0.5 else "own text {w} {w} {w} " + str(i)
                out.append(f.replace("{w}", rng.choice(["cat", "dog", "eel", "fox"])).format(*(rng.randint(0, 99) for _ in range(2))) if "{}" in f else f.replace("{w}", rng.choice(["cat", "dog", "eel"])))
            docs.append((i, "\n".join(out)))
        df = spark.createDataFrame([*docs, (99, None)], "doc_id long, text string").repartition(3)
        got = {r["doc_id"]: r["text"] for r in linetree.dedup(df).collect()}
        assert got.pop(99) is None
        assert got == brute_lines(docs)
        assert got != dict(docs)


def test_templates_generalise_variable_fields(spark):
    docs = [(i, f"Unique words of document {i} {'xyz'[i % 3] * (i + 1)}\nLog in as user{i} from 10.0.0.{i} at noon\n") for i in range(8)]
    got = {r["doc_id"]: r for r in linetree.dedup(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    assert got[0]["text"] == docs[0][1] and got[0]["n_dropped"] == 0
    assert all("Log in" not in got[i]["text"] for i in range(1, 8))
    assert linetree.dedup(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_a_repeat_that_begins_and_ends_inside_sentences_goes(spark):
    rng = random.Random(5)
    words = lambda n: ["".join(rng.choices("abcdefg", k=6)) for _ in range(n)]
    docs, least = [], {}
    for i, (head, inner, tail) in enumerate([(18, [15], 18), (24, [], 27), (12, [26], 13), (51, [], 0), (12, [13, 14], 12), (0, [], 88), (25, [1], 25)]):
        shared = words(head) + [w for n in inner for w in [*words(n - 1), "end."]] + words(tail)
        if inner and head:
            shared[head - 1] += "."
        for j in (0, 1):
            docs.append((2 * i + j, " ".join([*words(rng.randint(1, 40)), *shared, *words(rng.randint(1, 40))]) + "."))
        least[2 * i + 1] = len(shared) - 2 * spans.PIECE + 1
    got = {r["doc_id"]: r["text"] for r in spans.dedup(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    for d, t in docs:
        gone = len(t.split()) - len(got[d].split())
        assert gone == 0 if d % 2 == 0 else gone >= least[d] >= spans.WORDS, d


def test_cuts_of_long_sentences_depend_on_their_neighbourhood_alone():
    rng = random.Random(6)
    for _ in range(300):
        words = rng.choices("abcdefghijklmnop" if rng.random() < 0.8 else "a", k=rng.randint(0, 120))
        words = [w + rng.choice([" ", " ", " ", " ", "  ", ". ", "\n"]) if rng.random() < 0.2 else w + " " for w in words]
        parts = spans.sentences("".join(words))
        assert "".join(parts) == "".join(words) and all(len(p.split()) <= spans.PIECE for p in parts)
        ends = lambda s: set(np.cumsum([len(p.split()) for p in spans.sentences(s)]).tolist())
        a = rng.randint(0, len(words))
        inside = ends("".join(words)), {x + a for x in ends("".join(words[a:]))}
        first = min((x for x in inside[0] & inside[1] if x >= a), default=len(words))
        assert first <= a + spans.PIECE and {x for x in inside[0] if x > first} == {x for x in inside[1] if x > first}


def test_different_lines_of_one_beginning_stay(spark):
    words = [f"{a}{b}" for a in ("gold", "milk", "rice", "salt", "wool", "corn") for b in ("en", "ish")]
    frames = [lambda i: f"The price of {words[i]} rose{words[-i]}.", lambda i: " ".join(["We also saw", *(words[(i * k + k) % 12] + "abcdefg"[k] for k in range(7))])]
    docs = [(i, "\n".join([f(i) for f in frames] + [f"Read all about {words[i]} on our news page today"])) for i in range(10)]
    got = {r["doc_id"]: r["text"].split("\n") for r in linetree.dedup(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    for i, text in docs:
        assert got[i][:2] == text.split("\n")[:2]
        assert (len(got[i]) == 3 and got[i][2] != "") == (i == 0)


def test_lines_of_numbers_and_unspaced_lines_are_compared_as_they_are(spark):
    forms = ["{0}", "{0}.5 2.{0}", "2024-05-{0} 12:{0}", "| {0} | {1} | 7 |", "{0} apples {1}", "今天的价格是{0}元在市场{word}", "A{0} B{1}"]
    words = ["上海", "北京", "广州", "深圳", "成都", "武汉", "西安", "南京"]
    text = lambda i: "\n".join(f.format(10 + i, 90 - i, word=words[i]) for f in forms) + f"\nSeite {i} von 20\n第{i}页共9页\nuser{i} has just logged in\n"
    docs = [(i, text(i)) for i in range(8)] + [(8 + i, "1.5 2.5 and\n2.5 1.5 7 8 9 10\n") for i in range(6)]
    got = {r["doc_id"]: r["text"] for r in linetree.dedup(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    for i in range(1, 8):
        assert got[i] == "".join(line + "\n" for line in docs[i][1].split("\n")[: len(forms)])
    assert got[0] == docs[0][1] and got[8] == docs[8][1]
    assert all(got[9 + i] == "" for i in range(5))


def test_long_lines_that_recur_word_for_word_go_from_the_second_document_on(spark):
    same, number = "Subscribe to our weekly letter and never miss a story again.", "Our office on 12 Main Street is open until 18:30 every day."
    docs = [(i, f"{same}\nRead more\n{number if i < 4 else number.replace('12', '77')}\nown line of {'abcd'[i % 4]}{'xyz'[i % 3]}\n") for i in (2, 3, 4)] + [(9, f"{same}\n{same}\n")]
    docs += [(20 + i, f"文章的版权属于作者本人所有未经许可不得转载\n{'甲乙'[i]}\n") for i in range(2)]
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    got = {r["doc_id"]: r["text"] for r in linetree.dedup(df).collect()}
    want = {d: t for d, t in docs}
    want[3] = "Read more\n" + want[3].split("\n")[3] + "\n"
    want[4] = want[4].replace(same + "\n", "")
    want[9], want[21] = "", "乙\n"
    assert got == want


def test_clashing_names_and_ids_at_the_edge(spark):
    line = "Subscribe to our weekly letter and never miss a story again.\n"
    text = line + "one two three four five six seven eight nine ten eleven twelve thirteen. " * 3
    rows = [(1, text), (2**63 - 1, text), (None, text), (2**63 - 1, text), (-4, text)]
    names = ["parts", "row", "doc", "k", "h", "i", "_k", "n_lines"]
    df = spark.createDataFrame([(*r, *range(len(names))) for r in rows], f"doc_id long, text string, {', '.join(f'`{n}` int' for n in names)}")
    for module, count in ((linetree, "n_dropped"), (spans, "n_removed")):
        got = module.dedup(df).collect()
        assert sorted((r["doc_id"] is None, r["doc_id"] or 0, r[count] > 0) for r in got) == [(False, -4, module is spans), (False, 1, True), (False, 2**63 - 1, True), (False, 2**63 - 1, True), (True, 0, True)]
        assert all([r[n] for n in names[:-1]] == list(range(len(names) - 1)) for r in got)
        kept = {r["text"] for r in got if r["doc_id"] == -4}
        assert len(kept) == 1 and line in kept.pop()
        with pytest.raises(TypeError, match="whole numbers"):
            module.dedup(spark.createDataFrame([("a", "b")], "doc_id string, text string"))
