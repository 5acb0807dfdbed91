import base64
import hashlib
import random
from pathlib import Path

import public_tokenizers
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st

from quire.llm import bpe

PATH = public_tokenizers.path(bpe.RANKS)


@pytest.fixture(scope="module")
def library():
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, Path(PATH).read_bytes().splitlines())}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


TEXTS = [None, "", " ", "  a  b ", "it's  we'll\n\n\tx", "a" * 3000, "ab" * 500 + " " * 400, "日本語テキスト😀🏽 é", "<|endoftext|> <b>\r\n", " x y ​", "1234 56.78", "\x00\x1f a\x85b"]


def test_ids_equal_the_library_on_odd_texts(library):
    codec = bpe.Codec.of(PATH)
    for t in TEXTS:
        assert codec.encode([t or ""])[0] == library.encode_ordinary(t or ""), repr(t)


@given(st.text(alphabet=st.sampled_from(list("abcTh e\n\t'sé ü.,#1😀日 ")), max_size=60))
@settings(max_examples=300, deadline=None)
def test_ids_and_round_trip_on_random_texts(library, text):
    codec = bpe.Codec.of(PATH)
    ids = codec.encode([text])[0]
    assert ids == library.encode_ordinary(text)
    assert codec.decode(ids) == text.encode()


def test_caches_forget_without_harm(library):
    codec = bpe.Codec(PATH)
    codec.pieces.size = codec.chunks.size = 5
    rng = random.Random(4)
    for _ in range(60):
        texts = ["".join(rng.choices(["the", " ", "  ", "\n", " \n x", "über", "1", "!", "\x1c", "\x85", "\u3000", "z" * 60, "日本"], k=rng.randint(0, 30))) for _ in range(5)]
        assert codec.encode(texts) == [library.encode_ordinary(t) for t in texts]
    assert all(len(c) <= bpe.SHORT for c in codec.chunks)


def test_offsets_cover_every_character(library):
    codec = bpe.Codec.of(PATH)
    for t in filter(None, TEXTS):
        spans = codec.offsets(t)
        assert len(spans) == len(codec.encode([t])[0])
        assert {i for a, b in spans for i in range(a, b)} == set(range(len(t)))
        assert spans == sorted(spans)


def test_query_on_whole_documents(spark, sf, library):
    got = {r["doc_id"]: r for r in bpe.op6_byte_bpe(spark, sf).collect()}
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()
    assert len(got) == len(docs)
    for doc_id, text in docs:
        ids = library.encode_ordinary(text or "")
        assert got[doc_id]["n_tokens"] == len(ids)
        assert got[doc_id]["ids_sha256"] == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert got[doc_id]["decoded_sha256"] == hashlib.sha256((text or "").encode()).hexdigest()


def test_nulls_clashing_columns_repeated_rows_and_empty_tables(spark):
    rows = [(None, None, 1), (1, "a b", 2), (1, "a b", 2), (2, "", None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, ids int")
    back = bpe.decode(bpe.encode(df, offsets="spans", decoded="own"), out="decoded").collect()
    assert sorted(bytes(r["decoded"]) for r in back) == [b"", b"", b"a b", b"a b"]
    assert all(bytes(r["own"]) == bytes(r["decoded"]) for r in back)
    assert sorted((r["doc_id"] or 0, r["n"]) for r in bpe.counts(df, out="n").collect()) == [(0, 0), (1, 2), (1, 2), (2, 0)]
    assert bpe.decode(bpe.encode(df.limit(0))).count() == 0
