from __future__ import annotations

import base64
import random

import numpy as np
import public_tokenizers as P
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st

from scriptloom.llm import bpe

PATH = P.path("byte_bpe_multi_50k.tiktoken")


@pytest.fixture(scope="module")
def codec():
    with open(PATH, "rb") as f:
        return bpe.BytePairCodec(f.read(), P.PATTERN)


@pytest.fixture(scope="module")
def library(codec):
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=codec.ranks, special_tokens={})


def ids(codec, text):
    return np.frombuffer(codec.encode(text), dtype="<u4").tolist()


def test_any_text_is_encoded_as_the_library_does(codec, library):
    @settings(max_examples=300, deadline=None)
    @given(st.text(max_size=80))
    def check(t):
        assert ids(codec, t) == library.encode_ordinary(t)
        assert codec.decode(codec.encode(t)) == t.encode()

    check()


@pytest.mark.parametrize("text", ["a" * 30_000, "ab" * 9_000, "!" * 20_000, " " * 20_000, "é" * 9_000, "日本" * 4_000, "<|endoftext|> it's"])
def test_long_pieces(codec, library, text):
    assert ids(codec, text) == library.encode_ordinary(text)


def test_random_letters_and_the_second_vocabulary(library):
    with open(P.path("byte_bpe_50k.tiktoken"), "rb") as f:
        other = bpe.BytePairCodec(f.read(), P.PATTERN)
    lib = tiktoken.Encoding("other", pat_str=P.PATTERN, mergeable_ranks=other.ranks, special_tokens={})
    rng = random.Random(5)
    for _ in range(500):
        t = "".join(rng.choice("etaoinshrdlu") for _ in range(rng.randint(1, 60)))
        assert ids(other, t) == lib.encode_ordinary(t)


def test_round_trip_over_a_table(docs, corpus, library):
    got = {r.doc_id: r for r in bpe.round_trip(docs.selectExpr("doc_id", "text", "lang AS ids", "1 AS decoded"), PATH, P.PATTERN).collect()}
    for r in corpus:
        t = r[1] or ""
        assert np.frombuffer(bytes(got[r[0]].ids), dtype="<u4").tolist() == library.encode_ordinary(t)
        assert bytes(got[r[0]].decoded) == t.encode()


def test_the_two_steps_apart(docs, corpus):
    ids = bpe.encode(docs.select("doc_id", "text", "lang"), PATH, P.PATTERN)
    assert ids.columns == ["doc_id", "text", "lang", "ids"]
    got = {r.doc_id: bytes(r.decoded) for r in bpe.decode(ids, PATH, P.PATTERN).collect()}
    assert got == {r[0]: (r[1] or "").encode() for r in corpus}


def test_empty_table(no_docs):
    assert bpe.round_trip(no_docs, PATH, P.PATTERN).count() == 0


def test_bad_vocabularies_are_refused():
    with pytest.raises(ValueError):
        bpe.BytePairCodec(base64.b64encode(b"a") + b" 0\n", P.PATTERN)
    with pytest.raises(ValueError):
        bpe.BytePairCodec(base64.b64encode(b"a") + b" 3\n", P.PATTERN)


def test_a_worker_codes_a_batch_in_small_slices(spark, monkeypatch):
    """Of a batch of 10,000 rows a worker holds ids and decoded bytes of one small slice at a time; a text is never cut."""
    import pyarrow as pa

    found, df = [], spark.createDataFrame([(1, "a")], "doc_id long, text string")
    monkeypatch.setattr(type(df), "mapInArrow", lambda self, f, schema: found.append(f) or self)
    bpe.round_trip(df, PATH, P.PATTERN)
    texts = [f"word{i} " * (100 + i % 7) for i in range(9000)] + ["x y " * 500_000, "", None]
    batch = pa.RecordBatch.from_arrays([pa.array(texts), pa.array(range(len(texts)))], names=["text", "doc_id"])
    out = list(found[0](iter([batch])))
    assert b"".join(x or b"" for b in out for x in b.column("decoded").to_pylist()).decode() == "".join(t or "" for t in texts)
    assert [i for b in out for i in b.column("doc_id").to_pylist()] == list(range(len(texts)))
    assert max(b.column("decoded").nbytes for b in out[:-1]) < 1 << 20  # the last one holds the long text
