"""Byte-level BPE over Arrow batches with the tokenizers library, and the way back.

A rank file is turned once per worker into a ``tokenizers`` model: every byte gets a printable
character (the usual byte table), every split of a ranked token into two ranked tokens is a merge,
in the order of the token's rank, and a piece that is itself a token is taken whole.
"""

from __future__ import annotations

import base64
import os
import re
from array import array
from functools import cached_property
from itertools import chain
from pathlib import Path

import numpy as np
import pyarrow as pa
import public_tokenizers
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import prepare, table

RANKS = "byte_bpe_multi_50k.tiktoken"
#: Entries of chunks and of pieces that a worker remembers at least; each takes some 200 bytes.
CHUNKS, PIECES = 200_000, 100_000
#: Characters of text that are handled together.
AT_ONCE = 1 << 21
_EDGES = re.compile(r"\s | \s")
_BREAKS = re.compile(r"(?<=\S)(?=[ \n])")
#: Chunks of more characters aren't remembered.
SHORT = 48


def byte_table() -> list[str]:
    """The character that stands for each byte: itself where printable, else one from 256 on."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    spare = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(spare)) for b in range(256)]


class Cache(dict):
    """Remembers at least the last ``size`` entries, at most twice as many: what the older half still serves moves up."""

    def __init__(self, size: int):
        super().__init__()
        self.size, self.old = size, {}

    def lacks(self, keys) -> list[str]:
        """The keys that aren't known; those in the older half are brought back."""
        if len(self) > self.size:
            self.old = dict(self)
            self.clear()
        fresh = set(keys) - self.keys()
        back = fresh & self.old.keys()
        self.update((k, self.old[k]) for k in back)
        return list(fresh - back)


class Codec:
    """Encodes and decodes by one rank file."""

    _known: dict[str, Codec] = {}

    def __init__(self, path: str):
        import regex

        lines = Path(path).read_bytes().splitlines()
        self.ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
        self.shown = byte_table()
        back = {c: b for b, c in enumerate(self.shown)}
        self.bytes_of = [b""] * (max(self.ranks.values()) + 1)
        for token, rank in self.ranks.items():
            self.bytes_of[rank] = bytes(back[c] for c in self._text(token))
        self.split = regex.compile(public_tokenizers.PATTERN).findall
        self.find = regex.compile(public_tokenizers.PATTERN).finditer
        self.pieces, self.chunks = Cache(PIECES), Cache(CHUNKS)

    @classmethod
    def of(cls, path: str) -> Codec:
        if path not in cls._known:
            cls._known[path] = cls(path)
        return cls._known[path]

    def _text(self, token: bytes) -> str:
        return "".join(self.shown[b] for b in token)

    @cached_property
    def model(self):
        """The library's model, built when a piece is first encoded."""
        from tokenizers import Tokenizer, models, pre_tokenizers

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        ranks, text, merges = self.ranks, {t: self._text(t) for t in self.ranks}, []
        for token in sorted(ranks, key=ranks.get):
            splits = [(token[:i], token[i:]) for i in range(1, len(token)) if token[:i] in ranks and token[i:] in ranks]
            merges += [(text[a], text[b]) for a, b in sorted(splits, key=lambda x: (ranks[x[0]], ranks[x[1]]))]
        model = Tokenizer(models.BPE(vocab={text[t]: r for t, r in ranks.items()}, merges=merges, ignore_merges=True))
        model.pre_tokenizer = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)
        return model

    def _learn(self, pieces) -> None:
        """Encode pieces that aren't known yet, all in one call of the library."""
        fresh = self.pieces.lacks(pieces)
        for p, e in zip(fresh, self.model.encode_batch_fast(fresh, add_special_tokens=False), strict=True):
            self.pieces[p] = array("i", e.ids).tobytes()

    @staticmethod
    def chunked(text: str) -> list[str]:
        """Parts that the pattern's matches never cross: blanks behind a non-blank start a match."""
        if _EDGES.search(text):
            return _BREAKS.split(text)
        first, *rest = text.split(" ")
        return [first, *[" " + x for x in rest]]

    def matches(self, chunk: str) -> list[str]:
        """The pattern's matches; words of letters, alone or with a full stop or comma behind, need no search."""
        word = chunk[1:] if chunk[:1] == " " else chunk
        if word.isalpha():
            return [chunk]
        if word[-1:] in (".", ",") and word[:-1].isalpha():
            return [chunk[:-1], chunk[-1]]
        return self.split(chunk)

    def packed(self, texts: list[str]) -> list[bytes]:
        """The ids of each text, 4 bytes each."""
        parts = [self.chunked(t) for t in texts]
        known, fresh = self.chunks, self.chunks.lacks(chain.from_iterable(parts))
        if fresh:
            cut = [self.matches(c) for c in fresh]
            self._learn(chain.from_iterable(cut))
            get = self.pieces.__getitem__
            found = [b"".join(map(get, m)) for m in cut]
            known.update((c, ids) for c, ids in zip(fresh, found, strict=True) if len(c) <= SHORT)
            long = {c: ids for c, ids in zip(fresh, found, strict=True) if len(c) > SHORT}
            for p in (p for m in cut for p in m if len(p) > SHORT):
                self.pieces.pop(p, None)
            if long:
                get = lambda c: long[c] if c in long else known[c]
                return [b"".join(map(get, p)) for p in parts]
        get = known.__getitem__
        return [b"".join(map(get, p)) for p in parts]

    def encode(self, texts: list[str]) -> list[list[int]]:
        return [np.frombuffer(x, np.int32).tolist() for x in self.packed(texts)]

    def offsets(self, text: str) -> list[tuple[int, int]]:
        """For each id the characters [from, to) that its bytes touch; tokens that share a split character overlap."""
        out = []
        for m in self.find(text):
            (e,) = self.model.encode_batch([m[0]], add_special_tokens=False)
            at = np.repeat(np.arange(len(m[0])), [len(c.encode("utf-8", "surrogatepass")) for c in m[0]])
            b = 0
            for i in e.ids:
                n = len(self.bytes_of[i])
                out.append((m.start() + int(at[b]), m.start() + int(at[b + n - 1]) + 1))
                b += n
        return out

    def decode(self, ids) -> bytes:
        return b"".join(map(self.bytes_of.__getitem__, ids))


def _runs(sizes, most=AT_ONCE):
    """(from, to) of consecutive rows of about ``most`` in all."""
    start, total = 0, 0
    for i, n in enumerate(sizes):
        if total + n > most and i > start:
            yield start, i
            start, total = i, 0
        total += n
    if start < len(sizes):
        yield start, len(sizes)


def _with(batch: pa.RecordBatch, **more: pa.Array) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([*batch.columns, *more.values()], [*batch.schema.names, *more])


def encode(df: DataFrame, text: str = "text", ids: str = "ids", offsets: str | None = None, decoded: str | None = None, path: str | None = None) -> DataFrame:
    """Adds the token ids of each whole text, and their character offsets and the bytes that they decode to if columns are named.

    Null and empty texts get an empty array. Special tokens are never made; their strings are
    ordinary text. Columns of these names in the input are replaced. Rows are handled one
    by one, so repeated rows get equal ids and an empty table stays empty.
    """
    prepare(df.sparkSession)
    df = df.drop(*(c for c in (ids, offsets, decoded) if c))
    named = {ids: pa.list_(pa.int32())} | ({offsets: pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))} if offsets else {})
    ddl = f"{ids} array<int>" + (f", {offsets} array<struct<start:int,end:int>>" if offsets else "") + (f", {decoded} binary" if decoded else "")

    def run(batches):
        codec = Codec.of(path or public_tokenizers.path(RANKS))
        for batch in batches:
            column = batch.column(batch.schema.get_field_index(text))
            for a, b in _runs(pa.compute.fill_null(pa.compute.binary_length(column), 0).to_pylist()):
                texts = [t or "" for t in column.slice(a, b - a).to_pylist()]
                coded = codec.packed(texts)
                ends = np.cumsum([0, *(len(x) // 4 for x in coded)], dtype=np.int32)
                flat = np.frombuffer(b"".join(coded), np.int32)
                more = {ids: pa.ListArray.from_arrays(pa.array(ends), pa.array(flat))}
                if offsets:
                    pairs = [[{"start": s, "end": e} for s, e in codec.offsets(t)] for t in texts]
                    more[offsets] = pa.array(pairs, named[offsets])
                if decoded:
                    more[decoded] = pa.array([codec.decode(np.frombuffer(x, np.int32).tolist()) for x in coded], pa.binary())
                yield _with(batch.slice(a, b - a), **more)

    return df.mapInArrow(run, ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema), ddl]))


_COUNTERS: dict = {}


def _counter(path: str):
    """The tiktoken library's encoder of a rank file: several times faster where only counts are asked for."""
    if path not in _COUNTERS:
        import tiktoken

        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, Path(path).read_bytes().splitlines())}
        _COUNTERS[path] = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
    return _COUNTERS[path]


def counts(df: DataFrame, text: str = "text", out: str = "n_tokens", path: str | None = None) -> DataFrame:
    """Replaces ``text`` by the number of ids that encode() gives it; 0 for null and empty texts. Other columns stay."""
    prepare(df.sparkSession)
    others = [f for f in df.schema if f.name not in (text, out)]

    def run(batches):
        count = _counter(path or public_tokenizers.path(RANKS))
        for batch in batches:
            n = [len(count(t.as_py() or "")) for t in batch.column(batch.schema.get_field_index(text))]
            yield _with(batch.select([f.name for f in others]), **{out: pa.array(n, pa.int64())})

    return df.mapInArrow(run, ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in others), f"{out} long"]))


def decode(df: DataFrame, ids: str = "ids", out: str = "decoded", path: str | None = None) -> DataFrame:
    """Replaces the ids by the bytes they stand for (binary; a null array gives no bytes).

    Bytes are joined before anything reads them as UTF-8, so a character whose bytes are split
    between tokens comes back whole.
    """
    prepare(df.sparkSession)
    df = df.drop(out)
    others = [f for f in df.schema if f.name != ids]

    def run(batches):
        codec = Codec.of(path or public_tokenizers.path(RANKS))
        for batch in batches:
            k = batch.schema.get_field_index(ids)
            column, kept = batch.column(k), batch.drop_columns([ids])
            for a, b in _runs(pa.compute.fill_null(pa.compute.list_value_length(column), 0).to_pylist()):
                found = [codec.decode(x or ()) for x in column.slice(a, b - a).to_pylist()]
                yield _with(kept.slice(a, b - a), **{out: pa.array(found, pa.binary())})

    return df.mapInArrow(run, ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in others), f"{out} binary"]))


def op6_byte_bpe(spark, sf_dir):
    coded = encode(table(spark, sf_dir, "documents").select("doc_id", "text"), decoded="decoded")
    joined = F.array_join(F.col("ids").cast("array<string>"), ",")
    return coded.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(joined, 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


QUERIES = {"op6_byte_bpe": op6_byte_bpe}
ORACLES: dict[str, str] = {}
