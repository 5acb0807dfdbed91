"""Language identification by unigrams summed over all segmentations.

Every language has a probability for each piece of one fixed public vocabulary. A word's probability
is the sum over all ways to cut it into pieces (forward algorithm); a text's is the product over its
words, since pieces never cross white space. Training counts pieces by the forward-backward
expectation over all segmentations of all training texts, from equal probabilities.
"""

from __future__ import annotations

import re
import uuid
from collections import Counter
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute
import public_tokenizers
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import prepare, table, tidy

VOCABULARY = "piece_bpe_32k.model"
#: Words longer than this are summed one by one, not by the matrix of their length.
LONG = 40
#: Characters after which sums are rescaled: fewer than make a double vanish, even where each is spelled in four bytes.
RESCALE = 4
#: Words whose probabilities a worker keeps.
CACHE = 250_000
AT_ONCE = 1 << 21
SMOOTHING = 0.01
_WORD = re.compile(r"[^\W\d_]")
_ODD, _SHIFT, _BASE = np.uint64(0x9E3779B97F4A7C15), np.uint64(43), np.uint64(0xD1B54A32D192ED03)
_SCORES: dict = {}


def has_letter(text: str | None) -> bool:
    """Whether a text has a character of one of Unicode's letter categories; number signs like \u00bd are none."""
    return any(m[0].isalpha() for m in _WORD.finditer(text or ""))


def _step(h: np.ndarray, c) -> np.ndarray:
    """The hash of a text with one more character."""
    h = (h + c + np.uint64(1)) * _BASE
    return h ^ (h >> np.uint64(29))


class Vocabulary:
    """Pieces by their text, and by a 64-bit hash of it that is computed for many words at once."""

    _known: dict[str, Vocabulary] = {}

    def __init__(self, path: str):
        from sentencepiece import SentencePieceProcessor

        model = SentencePieceProcessor(model_file=path)
        self.size = model.get_piece_size()
        self.id = {model.id_to_piece(i): i for i in range(self.size) if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i))}
        self.byte = {i: model.piece_to_id(f"<0x{i:02X}>") for i in range(256)}
        self.longest = max(map(len, self.id))
        self.keys = np.zeros(self.size + 1, np.uint64)
        self.tables = []
        for word, k in self.id.items():
            h = np.zeros(1, np.uint64)
            for c in word:
                h = _step(h, np.uint64(ord(c)))
            self.keys[k] = h[0]
        left = np.array(list(self.id.values()))
        while len(left):  # what collides in a table goes to the next
            odd = _ODD + np.uint64(2 * len(self.tables))
            slot = (self.keys[left] * odd >> _SHIFT).astype(np.int64)
            table = np.full(1 << (64 - int(_SHIFT)), self.size, np.int32)
            table[slot] = left
            self.tables.append((odd, table))
            left = left[table[slot] != left]

    def find(self, h: np.ndarray) -> np.ndarray:
        """Pieces with these hashes, -1 where there is none."""
        out = np.full(len(h), -1, np.int32)
        for odd, table in self.tables:
            k = table[(h * odd >> _SHIFT).astype(np.int64)]
            out = np.where(self.keys[k] == h, k, out)
        return out

    @classmethod
    def of(cls, path: str | None) -> Vocabulary:
        path = path or public_tokenizers.path(VOCABULARY)
        if path not in cls._known:
            cls._known[path] = cls(path)
        return cls._known[path]

    def spelled(self, char: str) -> list[int]:
        """A character outside the vocabulary is its UTF-8 bytes."""
        return [self.byte[b] for b in char.encode("utf-8", "replace")]

    def arcs(self, word: str):
        """(from, to, pieces) of every way one step can go; several pieces only for spelled characters."""
        get, n = self.id.get, len(word)
        for i in range(n):
            found = False
            for j in range(i + 1, min(n, i + self.longest) + 1):
                k = get(word[i:j])
                if k is not None:
                    found |= j == i + 1
                    yield i, j, (k,)
            if not found:
                yield i, i + 1, self.spelled(word[i])


def _by_length(words: list[str]):
    groups: dict[int, list[int]] = {}
    for i, w in enumerate(words):
        groups.setdefault(len(w), []).append(i)
    return groups.items()


def _steps(vocab: Vocabulary, words: list[str], n: int, p: np.ndarray):
    """(i, j, rows, ids, probabilities) of the pieces that words of length n have from i to j.

    ids is None for characters outside the vocabulary, which are spelled in bytes.
    """
    chars = np.ascontiguousarray(np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), np.uint32).reshape(len(words), n).T.astype(np.uint64))
    for i in range(n):
        h = np.zeros(len(words), np.uint64)
        for j in range(i + 1, min(n, i + vocab.longest) + 1):
            h = _step(h, chars[j - 1])
            ids = vocab.find(h)
            rows = np.flatnonzero(ids >= 0)
            if len(rows):
                yield i, j, rows, ids[rows], p[ids[rows]]
            if j == i + 1 and len(rows) < len(words):
                rows = np.flatnonzero(ids < 0)
                yield i, j, rows, None, np.stack([np.prod(p[vocab.spelled(words[r][i])], axis=0) for r in rows])


def _forward(steps, n: int, rows: int, wide: int, reach: int) -> tuple[np.ndarray, np.ndarray]:
    """Sums over all ways from 0 to each place, and the logarithms of what they were divided by.

    Steps must rise by their begin. Every RESCALE places the sums that are open there (a step reaches
    ``reach`` places at most) are divided by their largest, so no length and no spelling underflows.
    """
    alpha, shift = np.zeros((n + 1, rows, wide)), np.zeros((n + 1, rows, wide))
    alpha[0] = 1.0
    scaled = 0
    for i, j, at, _, step in steps:
        if i >= scaled + RESCALE:
            scaled = i
            top = alpha[i : i + reach + 1].max(axis=0)
            alpha[i : i + reach + 1] /= top
            shift[i:] += np.log(top)
        alpha[j, at] += alpha[i, at] * step
    return alpha, shift


def score_words(vocab: Vocabulary, words: list[str], p: np.ndarray) -> np.ndarray:
    """Natural logarithms of the words' probabilities, a column per language. p: (pieces + 1, languages), last row 0."""
    out = np.empty((len(words), p.shape[1]))
    for n, at in _by_length(words):
        own = [words[i] for i in at]
        if n > LONG:
            for i, w in zip(at, own, strict=True):
                out[i] = _score_long(vocab, w, p)
            continue
        alpha, shift = _forward(_steps(vocab, own, n, p), n, len(own), p.shape[1], vocab.longest)
        out[at] = np.log(alpha[n]) + shift[n]
    return out


def _score_long(vocab: Vocabulary, word: str, p: np.ndarray) -> np.ndarray:
    n = len(word)
    alpha = np.zeros((n + 1, p.shape[1]))
    alpha[0] = 1.0
    shift, near = np.zeros(p.shape[1]), 0
    for i, j, ids in vocab.arcs(word):
        if i >= near + RESCALE:
            near = i
            top = alpha[i : i + vocab.longest + 1].max(axis=0)
            alpha[i : i + vocab.longest + 1] /= top
            shift += np.log(top)
        alpha[j] += alpha[i] * (p[ids[0]] if len(ids) == 1 else np.prod(p[ids], axis=0))
    return shift + np.log(alpha[n])


def expect(vocab: Vocabulary, words: list[str], weights: np.ndarray, p: np.ndarray) -> np.ndarray:
    """Expected number of each piece over all segmentations of the words, each as often as its weight. p: (pieces + 1,)."""
    out = np.zeros(vocab.size + 1)
    p = p[:, None]
    for n, at in _by_length(words):
        own, w = [words[i] for i in at], weights[at]
        if n > LONG:
            for word, weight in zip(own, w, strict=True):
                _expect_long(vocab, word, weight, p, out)
            continue
        steps = list(_steps(vocab, own, n, p))
        alpha, shift = (x[:, :, 0] for x in _forward(steps, n, len(own), 1, vocab.longest))
        # beta[i] * exp(back[i]) sums all ways from i to the end.
        beta, back = np.zeros((n + 1, len(own))), np.zeros((n + 1, len(own)))
        beta[n] = 1.0
        scaled = n
        total = np.log(alpha[n]) + shift[n]
        pieces, shares = [], []
        for i, j, rows, ids, step in sorted(steps, key=lambda x: -x[1]):
            if j <= scaled - RESCALE:
                scaled = j
                low = max(0, j - vocab.longest)
                top = beta[low : j + 1].max(axis=0)
                beta[low : j + 1] /= top
                back[: j + 1] += np.log(top)
            after = step[:, 0] * beta[j, rows]
            beta[i, rows] += after
            share = w[rows] * alpha[i, rows] * after * np.exp(shift[i, rows] + back[j, rows] - total[rows])
            if ids is not None:
                pieces.append(ids)
                shares.append(share)
            else:
                for r, x in zip(rows, share, strict=True):
                    np.add.at(out, vocab.spelled(own[r][i]), x)
        out += np.bincount(np.concatenate([*pieces, [vocab.size]]), np.concatenate([*shares, [0.0]]), vocab.size + 1)
    return out[:-1]


def _expect_long(vocab, word, weight, p, out) -> None:
    """A very long word in linear time: forward and backward values are rescaled at every place."""
    n, arcs = len(word), list(vocab.arcs(word))
    into: list[list] = [[] for _ in range(n + 1)]
    outof: list[list] = [[] for _ in range(n + 1)]
    for i, j, ids in arcs:
        step = float(np.prod(p[list(ids), 0]))
        into[j].append((i, step, ids))
        outof[i].append((j, step))
    log_a, log_b = np.full(n + 1, -np.inf), np.full(n + 1, -np.inf)
    log_a[0] = log_b[n] = 0.0
    for j in range(1, n + 1):
        if into[j]:
            log_a[j] = np.logaddexp.reduce([log_a[i] + np.log(s) for i, s, _ in into[j]])
    for i in range(n - 1, -1, -1):
        if outof[i]:
            log_b[i] = np.logaddexp.reduce([log_b[j] + np.log(s) for j, s in outof[i]])
    for j in range(1, n + 1):
        for i, s, ids in into[j]:
            share = weight * np.exp(min(0.0, log_a[i] + np.log(s) + log_b[j] - log_a[n]))
            np.add.at(out, list(ids), share)


def train(df: DataFrame, text: str = "text", lang: str = "lang", path: str | None = None) -> tuple[list[str], np.ndarray]:
    """(languages in order, probabilities by piece and language) from all rows with a language.

    Each task sums expected counts for the fixed vocabulary, so what is shuffled and sent to the
    driver is bounded by pieces x languages, not by texts. Rows without a language or without
    words teach nothing; a repeated row counts as often as it is there.
    """
    prepare(df.sparkSession)
    given = df.where(F.col(lang).isNotNull()).select(F.col(lang).cast("string").alias("lang"), F.col(text).alias("text"))

    def run(batches):
        vocab = Vocabulary.of(path)
        flat = np.full(vocab.size + 1, 1.0 / vocab.size)
        flat[-1] = 0.0
        seen: dict[str, Counter] = {}
        sums: dict[str, np.ndarray] = {}

        def settle():
            for k, words in seen.items():
                got = expect(vocab, ["▁" + w for w in words], np.fromiter(words.values(), float, len(words)), flat)
                sums[k] = sums[k] + got if k in sums else got
            seen.clear()

        for batch in batches:
            for k, t in zip(batch.column(0).to_pylist(), (x.as_py() for x in batch.column(1)), strict=True):
                seen.setdefault(k, Counter()).update((t or "").split())
                if sum(map(len, seen.values())) > CACHE:
                    settle()
        settle()
        for k, v in sums.items():
            at = np.flatnonzero(v > 1e-9)
            yield pa.RecordBatch.from_arrays([pa.array([k] * len(at), pa.string()), pa.array(at.astype(np.int32)), pa.array(v[at])], ["lang", "piece", "n"])

    counted = given.mapInArrow(lambda x: tidy(run(x)), "lang string, piece int, n double").groupBy("lang", "piece").agg(F.sum("n").alias("n"))
    got = counted.toArrow()
    langs = sorted(set(got.column("lang").to_pylist()))
    vocab = Vocabulary.of(path)
    p = np.zeros((vocab.size + 1, len(langs)))
    if langs:
        at = {k: i for i, k in enumerate(langs)}
        p[got.column("piece").to_numpy(), [at[k] for k in got.column("lang").to_pylist()]] = got.column("n").to_numpy()
        p[:-1] += SMOOTHING
        p[:-1] /= p[:-1].sum(axis=0)
    return langs, p


def predict(df: DataFrame, model: tuple[list[str], np.ndarray], text: str = "text", path: str | None = None) -> DataFrame:
    """Adds lang_pred and score, the posterior of that language under equal priors.

    Texts that are null or have no letter of Unicode's categories L get ``und`` and 0.0, as all do where nothing was learned.
    Ties go to the first language in order. Columns of these names are replaced.
    """
    spark = prepare(df.sparkSession)
    df = df.drop("lang_pred", "score")
    shared = spark.sparkContext.broadcast((model[0], model[1].astype(np.float64)))  # pieces x languages: bounded

    token = uuid.uuid4().hex

    def run(batches):
        vocab = Vocabulary.of(path)
        langs, p = shared.value
        if _SCORES.get("model") != token:  # a worker remembers the words of one model between tasks
            _SCORES.update(model=token, words={}, logs=np.zeros((0, len(langs))))

        def scored(texts: list[str | None]):
            if len(_SCORES["words"]) > CACHE:
                _SCORES.update(words={}, logs=np.zeros((0, len(langs))))
            known = _SCORES["words"]
            words = [t.split() if has_letter(t) else [] for t in texts]
            fresh = list(set(chain.from_iterable(words)) - known.keys())
            if fresh:
                known.update(zip(fresh, range(len(known), len(known) + len(fresh)), strict=True))
                _SCORES["logs"] = np.concatenate([_SCORES["logs"], score_words(vocab, ["▁" + w for w in fresh], p)])
            for own in words:
                if not own or not langs:
                    yield "und", 0.0
                    continue
                ids = np.fromiter(map(known.__getitem__, own), np.int64, len(own))
                total = _SCORES["logs"][ids].sum(axis=0)
                best = int(total.argmax())
                yield langs[best], round(float(1.0 / np.exp(total - total[best]).sum()), 6)

        for batch in batches:
            column = batch.column(batch.schema.get_field_index(text))
            sizes = np.cumsum(pa.compute.fill_null(pa.compute.binary_length(column), 0).to_numpy(zero_copy_only=False))
            told, a = [], 0
            while a < len(column):
                b = max(a + 1, int(np.searchsorted(sizes, (sizes[a - 1] if a else 0) + AT_ONCE)))
                told += scored(column.slice(a, b - a).to_pylist())
                a = b
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([x for x, _ in told], pa.string()), pa.array([x for _, x in told], pa.float64())], [*batch.schema.names, "lang_pred", "score"])

    ddl = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema), "lang_pred string, score double"])
    return df.mapInArrow(lambda x: tidy(run(x)), ddl)


def held_out(doc_id: str = "doc_id"):
    """crc32 of the id as text, modulo 4, is 2; false for a null id."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % 4 == 2, F.lit(False))


def op7_language_id(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    model = train(docs.where(~held_out()))
    told = predict(docs.select("doc_id", held_out().alias("held_out"), "text"), model)
    return told.select("doc_id", "held_out", "lang_pred", "score")


QUERIES = {"op7_language_id": op7_language_id}
ORACLES: dict[str, str] = {}
