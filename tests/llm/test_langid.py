import itertools
import math

import numpy as np

from quire.llm import langid


def test_forward_sums_all_segmentations():
    vocab = langid.Vocabulary.of(None)
    rng = np.random.default_rng(1)
    p = rng.random((vocab.size + 1, 3)) / vocab.size
    p[-1] = 0
    words = ["▁the", "▁ab", "▁não", "▁x\U0001f600y", "▁", "▁" + "abc" * 30]

    def brute(word):
        total = np.zeros(3)
        for cuts in itertools.product([0, 1], repeat=len(word) - 1):
            at = [0, *(i + 1 for i, c in enumerate(cuts) if c), len(word)]
            prob = np.ones(3)
            for a, b in itertools.pairwise(at):
                piece = word[a:b]
                if piece in vocab.id:
                    prob *= p[vocab.id[piece]]
                elif len(piece) == 1:
                    prob *= np.prod(p[vocab.spelled(piece)], axis=0)
                else:
                    prob *= 0
            total += prob
        return np.log(total)

    got = langid.score_words(vocab, words, p)
    for w, g in zip(words[:-1], got, strict=False):
        assert np.allclose(g, brute(w), atol=1e-9)
    long = np.array([langid._score_long(vocab, w, p) for w in words])
    assert np.allclose(got, long, atol=1e-6)


def test_expected_counts_add_up_and_the_long_way_agrees():
    vocab = langid.Vocabulary.of(None)
    flat = np.full(vocab.size + 1, 1 / vocab.size)
    flat[-1] = 0
    for w in ("▁hello", "▁x\U0001f600y", "▁ab"):
        got = langid.expect(vocab, [w], np.array([2.0]), flat)
        chars = sum(n * (1 if i in vocab.byte.values() else len(piece)) for piece, i in vocab.id.items() if (n := got[i]))
        spelled = sum(got[i] for i in vocab.byte.values())
        assert math.isclose(chars + spelled / 4, 2 * len(w), rel_tol=1e-6)
        long = np.zeros(vocab.size + 1)
        langid._expect_long(vocab, w, 2.0, flat[:, None], long)
        assert np.allclose(long[:-1], got, atol=1e-9)


def test_held_out_accuracy(spark):
    got = langid.op7_language_id(spark, "/root/testdata/sf0.01")
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "lang")
    rows = got.join(docs, "doc_id").collect()
    assert len(rows) == docs.count()
    held = [r for r in rows if r["held_out"]]
    assert held
    assert sum(r["lang"] == r["lang_pred"] for r in held) / len(held) > 0.97
    assert all(0 <= r["score"] <= 1 for r in rows)


def test_nulls_empty_and_clashing_columns(spark):
    rows = [(1, "the cat and the dog", "en"), (2, "le chat et le chien", "fr"), (3, None, "en"), (4, "123 !?", "fr"), (5, "the", None), (5, "the", None), (None, "le", None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string").withColumn("score", langid.F.lit("x"))
    got = langid.predict(df, langid.train(df)).collect()
    assert len(got) == len(rows)
    told = {(r["doc_id"], r["text"]): (r["lang_pred"], r["score"]) for r in got}
    assert told[3, None] == told[4, "123 !?"] == ("und", 0.0)
    assert told[5, "the"][0] == "en" and told[None, "le"][0] == "fr"
    empty = df.limit(0)
    assert langid.predict(empty, langid.train(empty)).count() == 0
    assert {r["lang_pred"] for r in langid.predict(df, langid.train(empty)).collect()} == {"und"}


def plain_arcs(vocab, word):
    """All steps through a word, written without the module's tables."""
    for i, c in enumerate(word):
        for j in range(i + 1, len(word) + 1):
            if word[i:j] in vocab.id:
                yield i, j, [vocab.id[word[i:j]]]
        if c not in vocab.id:
            yield i, i + 1, [vocab.byte[b] for b in c.encode()]


def forward(arcs, n, logs):
    out = np.full((n + 1, logs.shape[1]), -np.inf)
    out[0] = 0.0
    for i, j, ids in arcs:
        out[j] = np.logaddexp(out[j], out[i] + logs[ids].sum(axis=0))
    return out


def odd_words():
    rng = np.random.default_rng(7)
    letters = ("abcdefghij", "ሀለሐመ", "\U0001f600\U0001f601€", "thequickéü")
    return ["▁" + "".join(rng.choice(list(a), n)) for n in range(1, 60) for a in letters]


def test_words_of_any_length_and_spelling_keep_their_probability():
    vocab = langid.Vocabulary.of(None)
    p = np.random.default_rng(0).random((vocab.size + 1, 3)) ** 6 + 1e-9
    p[-1] = 0
    p /= p.sum(axis=0)
    words = odd_words()
    with np.errstate(divide="ignore"):
        logs = np.log(p)
    want = np.array([forward(plain_arcs(vocab, w), len(w), logs)[-1] for w in words])
    assert want.min() < -800
    assert np.allclose(langid.score_words(vocab, words, p), want, rtol=1e-9)
    assert np.allclose([langid._score_long(vocab, w, p) for w in words], want, rtol=1e-9)
    flat = np.full(vocab.size + 1, 1 / vocab.size)
    flat[-1] = 0
    for w in words:
        long = np.zeros(vocab.size + 1)
        langid._expect_long(vocab, w, 3.0, flat[:, None], long)
        assert np.allclose(langid.expect(vocab, [w], np.array([3.0]), flat), long[:-1], rtol=1e-6, atol=1e-9)


def test_signs_that_are_no_letters():
    assert not any(map(langid.has_letter, (None, "", "½ ²", "Ⅷ 1", "__ 12 !", "٣ ५")))
    assert all(map(langid.has_letter, ("a", "½ x", "語", "ª", "_é")))


def test_whole_predictions_against_brute_force(spark):
    rows = [("the cat sat on the mat", "en"), ("a dog and the cat", "en"), ("le chat est sur le tapis", "fr"), ("un chien et le chat", "fr"), ("ሀለሐ መሠ", "am"), ("x", None), (None, "fr"), ("", "en")]
    asked = ["the mat", "le tapis est", "ሐመሠለሀ" * 6, "½ ²", None, "", "chat " * 40 + "the", "qqq www"]
    vocab = langid.Vocabulary.of(None)
    flat = np.full((vocab.size + 1, 1), -math.log(vocab.size))
    langs = sorted({k for _, k in rows if k})
    counts = {k: np.zeros(vocab.size) for k in langs}
    for text, lang in rows:
        for w in (text or "").split() if lang else []:
            word = "▁" + w
            ahead = forward(plain_arcs(vocab, word), len(word), flat)[:, 0]
            mirrored = sorted(((len(word) - j, len(word) - i, ids) for i, j, ids in plain_arcs(vocab, word)), key=lambda x: x[0])
            behind = forward(mirrored, len(word), flat)[::-1, 0]
            for i, j, ids in plain_arcs(vocab, word):
                for k in ids:
                    counts[lang][k] += math.exp(ahead[i] + flat[ids].sum() + behind[j] - ahead[-1])
    logs = np.log(np.stack([(c + langid.SMOOTHING) / (c + langid.SMOOTHING).sum() for c in counts.values()], axis=1))
    df = spark.createDataFrame(rows, "text string, lang string").repartition(3)
    got = langid.predict(spark.createDataFrame([(i, t) for i, t in enumerate(asked)], "doc_id long, text string"), langid.train(df)).collect()
    for r in got:
        if not r["text"] or not any(c.isalpha() for c in r["text"]):
            assert (r["lang_pred"], r["score"]) == ("und", 0.0)
            continue
        total = sum(forward(plain_arcs(vocab, "▁" + w), len(w) + 1, logs)[-1] for w in r["text"].split())
        share = np.exp(total - total.max())
        assert r["lang_pred"] == langs[int(total.argmax())]
        assert abs(r["score"] - share.max() / share.sum()) < 1e-5
