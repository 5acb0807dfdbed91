"""Line dedup by a tree of log templates.

Lines go down a tree of fixed depth: by their number of tokens, then by their leading tokens, with
numbers as variable fields. In a leaf a line joins the template that it resembles most; templates stay
as their first line was, so they can't drift. Templates that recur across documents are dropped
everywhere but in the first document that has them; lines that recur word for word, from the second
document on unless they are very short.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import partitions, prepare, table, tidy
from .removals import applied, keyed, slices

#: Leading tokens that choose a leaf; share of equal places behind them at which a line joins a template; documents that make it recurring.
DEPTH, ALIKE, DOCUMENTS = 3, 0.6, 5
#: Bytes from which a line that recurs word for word goes from the second document on.
LONG = 30
FIELD = "<*>"
_DIGIT = re.compile(r"\d")
_DIGITS = re.compile(r"\d+")
_LETTER = re.compile(r"[^\W\d_]")
#: Letters of scripts that don't put spaces between words; each stands for a word.
_UNSPACED = re.compile("[\u0e00-\u0eff\u1000-\u109f\u1780-\u17ff\u3040-\u30ff\u3400-\u9fff\U00020000-\U0003ffff]")
_CACHE = 200_000
#: Templates of a leaf that are all compared; more are looked up by an index.
SCANNED = 64


def split_lines(text: str) -> list[str]:
    """Parts that add up to the text, each with its \\n."""
    return re.findall(r"[^\n]*\n|[^\n]+", text)


def tokens(line: str) -> list[str]:
    """The line's tokens, numbers as variable fields and digits inside words masked.

    A line whose words without digits are fewer than its other tokens tells nothing but its numbers:
    it is one token, itself, so that only equal lines are like it.
    """
    own = line.split()
    if not _DIGIT.search(line):
        return own
    words = fields = 0
    out = []
    for w in own:
        if not _DIGIT.search(w):
            words += _LETTER.search(w) is not None
            fields += _LETTER.search(w) is None
            out.append(w)
        elif not _LETTER.search(w):
            fields += 1
            out.append(FIELD)
        else:
            masked = _DIGITS.sub(FIELD, w)
            words += len(_UNSPACED.findall(w))
            fields += masked.count(FIELD)
            out.append(masked)
    return out if words >= fields else [" ".join(own)]


class Codes(dict):
    """32-bit hashes of tokens, 1 at least; 0 is a variable field."""

    def __init__(self):
        super().__init__({FIELD: 0})

    def __missing__(self, token: str) -> int:
        self[token] = code = xxhash.xxh32_intdigest(token) or 1
        return code


class Leaf:
    """The templates of one leaf, each an array of 32-bit token hashes; 0 is a variable field.

    A leaf of many templates keeps an index by place and token. Of a line's c constant tokens a
    template must share ``need``, so it shares one of any c - need + 1: the rarest are looked up, and
    only what they name is compared.
    """

    def __init__(self, alike: float, depth: int = DEPTH):
        self.alike, self.depth, self.n, self.at = alike, depth, 0, np.zeros((4, 0), np.uint32)
        self.index: dict[tuple[int, int], list[int]] = {}
        self.indexed = 0

    def _candidates(self, tail: np.ndarray, need: int) -> np.ndarray:
        for t in range(self.indexed, self.n):
            for i, code in enumerate(self.at[t, self.depth :].tolist()):
                if code:
                    self.index.setdefault((i, code), []).append(t)
        self.indexed = self.n
        lists = sorted((self.index.get((i, code), ()) for i, code in enumerate(tail.tolist()) if code), key=len)
        lists = lists[: max(0, len(lists) - need + 1)]
        return np.array(sorted(set().union(*lists)), np.int64)

    def place(self, line: np.ndarray) -> int:
        """The template that the line joins: the most alike one, the first of several, or a new one.

        Only constant tokens behind the leading ones count, which all lines of a leaf share.
        """
        if not self.n:
            self.at = np.zeros((4, len(line)), np.uint32)
        tail = line[self.depth :]
        if self.n and len(tail):
            need = int(np.ceil(self.alike * len(tail) - 1e-9))
            at = self._candidates(tail, need) if self.n > SCANNED else np.arange(self.n)
            if len(at):
                same = ((self.at[at, self.depth :] == tail) & (tail != 0)).sum(axis=1)
                best = int(same.argmax())
                if same[best] >= need:
                    return int(at[best])
        if self.n == len(self.at):
            self.at = np.concatenate([self.at, np.zeros_like(self.at)])
        self.at[self.n] = line
        self.n += 1
        return self.n - 1


def _rows(batches, depth, documents, long=LONG):
    """One row for each line of a document: its leaf, hash and place, the hash of its own text if that is long; the tokens' hashes stand in a batch's first row of a line.

    A line in ``documents`` documents of one batch recurs for certain: all rows but its first
    document's are settled here, and only that one goes on, marked with the count.
    """
    known = Codes()
    for doc, k, texts in slices(batches):
        if len(known) > _CACHE:
            known = Codes()
        seen: dict[int, list] = {}
        for d, key, t in sorted(zip(doc.tolist(), k.tolist(), texts, strict=True), key=lambda x: x[:2]):
            for i, line in enumerate(split_lines(t)):
                own = tokens(line)
                if not own:
                    continue
                whole = " ".join(own)
                h = xxhash.xxh3_64_intdigest(whole)
                raw = " ".join(line.split()) if _DIGIT.search(line) else whole
                x = (h if raw == whole else xxhash.xxh3_64_intdigest(raw)) if long is not None and (len(raw) >= long or len(raw.encode()) >= long) else None
                entry = seen.get(h)
                if entry is None:
                    leaf = xxhash.xxh3_64_intdigest(f"{len(own)} " + " ".join(own[:depth]))
                    entry = seen[h] = [leaf, np.fromiter(map(known.__getitem__, own), np.uint32, len(own)).tobytes(), []]
                entry[2].append((d, key, i, x))
        out = []
        for h, (leaf, sig, places) in seen.items():
            head = places[0][:2]
            n = len({p[:2] for p in places}) if len(places) >= documents else 0
            for j, (d, key, i, x) in enumerate(places):
                settled = n >= documents and (d, key) != head
                out.append((leaf, h, d, key, i, sig if not j else None, settled, n if not j else 0, None if n >= documents or x is None else x - (x >> 63 << 64)))
        if out:
            columns = list(zip(*out, strict=True))
            wide = [pa.array(np.array(columns[j], np.uint64).view(np.int64)) for j in (0, 1)]
            rest = [pa.array(columns[2], pa.int64()), pa.array(columns[3], pa.int64()), pa.array(columns[4], pa.int32()), pa.array(columns[5], pa.binary()), pa.array(columns[6], pa.bool_()), pa.array(columns[7], pa.int32()), pa.array(columns[8], pa.int64())]
            yield pa.RecordBatch.from_arrays(wide + rest, ["leaf", "h", "doc", "k", "i", "sig", "sure", "n", "x"])


_ROWS = "leaf long, h long, doc long, k long, i int, sig binary, sure boolean, n int, x long"


class _Template:
    """What is known of a template: its documents up to the number that makes it recurring, its first document's rows, others that wait."""

    __slots__ = ("docs", "first", "held", "recurs", "waiting")

    def __init__(self):
        self.docs, self.recurs, self.first, self.held, self.waiting = set(), False, None, [], []


def _copies(templates: list[_Template]):
    """(d, k, i) of long lines that stand word for word in an earlier document, of templates that don't recur: all their rows wait."""
    for t in templates:
        if t.recurs or not t.waiting:
            continue
        first: dict[int, tuple] = {}
        rows = [r for r in t.waiting + t.held if r[3] is not None]
        for d, k, _, x in rows:
            first[x] = min(first.get(x, (d, k)), (d, k))
        yield from (r[:3] for r in rows if r[:2] != first[r[3]])


def _recurring(batches, depth, alike, documents):
    """Of rows by (sure, leaf, h, no sig last, ...): (doc, k, a, b) of lines to drop. Memory: the templates of one leaf."""
    leaf_id, leaf, last, current = None, None, None, None
    templates: list[_Template] = []
    for batch in batches:
        out = []
        for lf, h, d, k, i, sig, sure, n, own in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if sure:
                out.append((d, k, i))
                continue
            if lf != leaf_id:
                out += _copies(templates)
                leaf_id, leaf, templates, last = lf, Leaf(alike, depth), [], None
            if h != last:
                last, t = h, leaf.place(np.frombuffer(sig, np.uint32))
                if t == len(templates):
                    templates.append(_Template())
                current = templates[t]
            x, who, row = current, (d, k), (d, k, i, own)
            if not x.recurs:
                x.docs.add(who)
                x.recurs = n >= documents or len(x.docs) >= documents
            if x.first is None or who < x.first:
                x.waiting += x.held
                x.first, x.held = who, [row]
            elif who == x.first:
                x.held.append(row)
            else:
                x.waiting.append(row)
            if x.recurs:
                x.docs = ()
                out += (r[:3] for r in x.waiting)
                x.waiting = []
        if out:
            yield _dropped(out)
    out = list(_copies(templates))
    if out:
        yield _dropped(out)


def _dropped(rows: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True))
    a = np.array(columns[2], np.int32)
    return pa.RecordBatch.from_arrays([pa.array(columns[0], pa.int64()), pa.array(columns[1], pa.int64()), pa.array(a), pa.array(a + 1, pa.int32())], ["doc", "k", "a", "b"])


def recurring(df: DataFrame, doc_id: str = "doc_id", text: str = "text", depth: int = DEPTH, alike: float = ALIKE, documents: int = DOCUMENTS, long: int | None = LONG) -> DataFrame:
    """(doc, k, a, b): lines [a, b) whose template recurs in at least ``documents`` documents, or that recur word for word in two and have ``long`` bytes (None: none), but for the first document.

    Lines enter a leaf in the order of their hashes, so the templates don't depend on how the input
    is dealt out.
    """
    rows = keyed(df, doc_id, text).mapInArrow(lambda x: tidy(_rows(x, depth, documents, long)), _ROWS)
    key = F.when(F.col("sure"), F.xxhash64("doc", "i")).otherwise(F.col("leaf"))
    order = ["sure", "leaf", "h", F.col("sig").isNull(), "doc", "k", "i"]
    return rows.repartition(partitions(df), key).sortWithinPartitions(*order).mapInArrow(lambda x: tidy(_recurring(x, depth, alike, documents)), "doc long, k long, a int, b int")


def dedup(df: DataFrame, doc_id: str = "doc_id", text: str = "text", depth: int = DEPTH, alike: float = ALIKE, documents: int = DOCUMENTS, long: int | None = LONG) -> DataFrame:
    """``df`` with its texts rid of lines of recurring templates. Adds n_lines and n_dropped (columns of these names are replaced).

    Ids must be whole numbers or null (TypeError).

    The first document by id (null last) that has a template keeps all its lines of it, so nothing
    is lost from the corpus. Lines without a token are kept. Null texts stay null; rows that repeat
    id and text are one document; an empty table stays empty; other columns stay as they are.
    """
    prepare(df.sparkSession)
    return applied(df, recurring(df, doc_id, text, depth, alike, documents, long), doc_id, text, split_lines, "n_lines", "n_dropped")


def op8_line_dedup(spark, sf_dir):
    return dedup(table(spark, sf_dir, "documents").select("doc_id", "text"))


QUERIES = {"op8_line_dedup": op8_line_dedup}
ORACLES: dict[str, str] = {}
