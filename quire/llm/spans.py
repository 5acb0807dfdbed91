"""Substring dedup by sliding spans of consecutive sentences.

A repeat seldom begins and ends with a sentence. Long sentences are therefore cut at words that their
neighbours choose, so equal passages are cut alike wherever they stand in their sentences: of every
verbatim repeat of 2 * PIECE + WORDS - 1 words all but PIECE - 1 words at its beginning and PIECE at
its end are whole parts, enough for a span, and go.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame

from .common import prepare, table, tidy
from .removals import SCHEMA, applied, dealt, keyed, slices

#: A span is a shortest run of at least so many sentences and words.
SENTENCES, WORDS = 2, 25
#: Sentences of more words are cut, into parts of as many words at most.
PIECE = 13
_END = re.compile(r"[.!?][\"')\]’”»]*\s+|\n\s*")
_M = 0x9E3779B97F4A7C15
_INVERSE = pow(_M, -1, 1 << 64)
#: Whether a code point is white space; the last entry stands for all above.
_BLANK = np.array([chr(c).isspace() for c in range(0x3001)] + [False])


def _powers(n: int, base: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[:1] = 1
    return np.cumprod(out, dtype=np.uint64)


def _cuts(text: str, ends: list[int]) -> list[int]:
    """Where words begin that have the smallest hash, the last of several, of any PIECE consecutive ones of a long sentence."""
    c = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    blank = _BLANK[np.minimum(c, 0x3001)]
    edges = np.flatnonzero(np.diff(blank, prepend=True, append=True))
    first, last = edges[::2], edges[1::2]
    n = len(first)
    if n <= PIECE:
        return []
    of = np.searchsorted(ends, first, "right")
    begins = np.flatnonzero(np.diff(of, prepend=-1))
    size = np.diff(begins, append=n)
    at = np.repeat(begins, size)
    whole = np.arange(n - PIECE + 1)
    whole = whole[(of[: n - PIECE + 1] == of[PIECE - 1 :]) & (np.repeat(size, size)[: n - PIECE + 1] > PIECE)]
    if not len(whole):
        return []
    summed = np.concatenate([np.zeros(1, np.uint64), np.cumsum((c + np.uint64(1)) * _powers(len(c), _M), dtype=np.uint64)])
    h = (summed[last] - summed[first]) * _powers(len(c), _INVERSE)[first]
    h = (h ^ (h >> np.uint64(32))) * np.uint64(_M)
    low = ((h >> np.uint64(33)).astype(np.int64) << 32) + np.arange(n - 1, -1, -1)
    span = 1
    while 2 * span <= PIECE:
        low, span = np.minimum(low[:-span], low[span:]), 2 * span
    low = np.minimum(low[: n - PIECE + 1], low[PIECE - span : n - span + 1])
    chosen = n - 1 - (low[whole] & 0xFFFFFFFF)
    return first[chosen[chosen > at[chosen]]].tolist()


def sentences(text: str) -> list[str]:
    """Parts that add up to the text: each ends behind [.!?], closing marks and white space, or a line's end.

    Sentences of more than PIECE words are cut before words that are chosen by the PIECE words around them.
    """
    if not text:
        return []
    ends = [m.end() for m in _END.finditer(text)]
    if not ends or ends[-1] < len(text):
        ends.append(len(text))
    marks = [0, *ends]
    if any(b - a > 2 * PIECE for a, b in zip(marks, ends, strict=False)):
        marks = sorted({*marks, *_cuts(text, ends)})
    return [text[a:b] for a, b in zip(marks, marks[1:], strict=False)]


def runs(words: np.ndarray, first: np.ndarray, last: np.ndarray, least: int, count: int, alone: int | None) -> np.ndarray:
    """(a, b) of the spans: from every sentence the shortest run forward, to every sentence the shortest backward; sentences of ``alone`` words, if asked for.

    words: by sentence; first, last: the bounds of its document. Runs never leave a document.
    """
    n = len(words)
    total = np.concatenate([[0], np.cumsum(words)])
    at = np.arange(n)
    forward = np.maximum(at + count, np.searchsorted(total, total[:-1] + least))
    ok = forward <= last
    backward = np.minimum(at + 1 - count, np.searchsorted(total, total[1:] - least, "right") - 1)
    back = backward >= first
    whole = words >= (alone or np.inf)
    pairs = [(at[ok], forward[ok]), (backward[back], at[back] + 1), (at[whole], at[whole] + 1)]
    a, b = (np.concatenate([p[k] for p in pairs]) for k in (0, 1))
    return np.unique(a * (n + 1) + b) if n else a


def _spans(batches, least, count, alone):
    for doc, k, texts in slices(batches, 1 << 20):
        cut = [sentences(t) for t in texts]
        sizes = np.array([len(c) for c in cut], np.int64)
        ends = np.cumsum(sizes)
        if not len(ends) or not ends[-1]:
            continue
        split = [s.split() for c in cut for s in c]
        words = np.fromiter(map(len, split), np.int64, len(split))
        hashes = np.fromiter((xxhash.xxh3_64_intdigest(" ".join(s)) for s in split), np.uint64, len(split))
        of = np.repeat(np.arange(len(doc)), sizes)
        first = (ends - sizes)[of]
        packed = runs(words, first, ends[of], least, count, alone)
        n = len(words)
        a, b = packed // (n + 1), packed % (n + 1)
        summed = np.concatenate([np.zeros(1, np.uint64), np.cumsum(hashes * _powers(n, _M), dtype=np.uint64)])
        h = (summed[b] - summed[a]) * _powers(n, _INVERSE)[a]
        h ^= h >> np.uint64(29)
        h = h * np.uint64(_M) + (b - a).astype(np.uint64)
        d, key, start = doc[of[a]], k[of[a]], (a - first[a]).astype(np.int32)
        # Within a batch only the first of a span can be the first of all; the others are settled here.
        order = np.lexsort((start, key, d, h))
        d, key, h, a, b, start = (x[order] for x in (d, key, h, a, b, start))
        new = np.ones(len(h), bool)
        new[1:] = h[1:] != h[:-1]
        head = np.maximum.accumulate(np.where(new, np.arange(len(h)), 0))
        same = (d == d[head]) & (key == key[head]) & (start == start[head])
        yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(d), pa.array(key), pa.array(start), pa.array((start + (b - a)).astype(np.int32)), pa.array(~same)], ["h", "doc", "k", "a", "b", "sure"])


def _not_first(batches):
    """Of rows in the order of dealt(): the settled ones, and of each span all but its first."""
    held = None
    for batch in batches:
        h, d, k, a, b, sure = (c.to_numpy(zero_copy_only=False) for c in batch.columns)
        if not len(h):
            continue
        if held is not None:
            h, d, k, a = (np.concatenate([[x], y]) for x, y in zip(held, (h, d, k, a), strict=True))
            b, sure = np.append(np.zeros(1, b.dtype), b), np.append(False, sure)
        new = np.ones(len(h), bool)
        new[1:] = h[1:] != h[:-1]
        head = np.maximum.accumulate(np.where(new, np.arange(len(h)), 0))
        out = sure.astype(bool) | ~((d == d[head]) & (k == k[head]) & (a == a[head]))
        if held is not None:
            out[0] = False
        if not sure[-1]:
            held = (h[head[-1]], d[head[-1]], k[head[-1]], a[head[-1]])
        yield pa.RecordBatch.from_arrays([pa.array(x[out], t) for x, t in ((d, pa.int64()), (k, pa.int64()), (a, pa.int32()), (b, pa.int32()))], ["doc", "k", "a", "b"])


def repeated(df: DataFrame, doc_id: str = "doc_id", text: str = "text", least: int = WORDS, count: int = SENTENCES, alone: int | None = None) -> DataFrame:
    """(doc, k, a, b): spans of sentences [a, b) that occur in an earlier document, or earlier in the same one."""
    spans = keyed(df, doc_id, text).mapInArrow(lambda x: tidy(_spans(x, least, count, alone)), SCHEMA)
    return dealt(spans).mapInArrow(_not_first, "doc long, k long, a int, b int")


def dedup(df: DataFrame, doc_id: str = "doc_id", text: str = "text", least: int = WORDS, count: int = SENTENCES, alone: int | None = None) -> DataFrame:
    """``df`` with its texts rid of sentences that a non-first repeated span covers.

    Adds n_sentences and n_removed (columns of these names are replaced), which count the parts of a cut sentence each. Spans are compared with white space made single.
    ``alone`` makes one part of so many words a span too, beyond the method's runs of several. Ids must be whole numbers or null (TypeError). The first
    occurrence, by document id (null last) and place, always stays. Null texts stay null; texts of
    fewer words than a span has are never touched; rows that repeat id and text are one document
    and are all kept. An empty table stays empty. Other columns are returned as they are.
    """
    prepare(df.sparkSession)
    return applied(df, repeated(df, doc_id, text, least, count, alone), doc_id, text, sentences, "n_sentences", "n_removed")


def op4_substring_dedup(spark, sf_dir):
    return dedup(table(spark, sf_dir, "documents").select("doc_id", "text"))


QUERIES = {"op4_substring_dedup": op4_substring_dedup}
ORACLES: dict[str, str] = {}
