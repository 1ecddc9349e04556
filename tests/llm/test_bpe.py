import base64
from pathlib import Path

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from glyphmill.llm import bpe

FILE = Path(bpe.TOKENIZER_DIR, bpe.VOCABULARY)
pytestmark = pytest.mark.skipif(not FILE.exists(), reason="no vocabulary files")


@pytest.fixture(scope="module")
def encoder():
    return bpe.Encoder(bpe.load_ranks(FILE.read_bytes()))


@pytest.fixture(scope="module")
def published():
    import tiktoken

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, FILE.read_bytes().splitlines())}
    return tiktoken.Encoding("own", pat_str=bpe.PATTERN, mergeable_ranks=ranks, special_tokens={})


LETTERS = st.one_of(st.characters(exclude_categories=["Cs"]), st.sampled_from(list("theaing 's  \n\t.,123日本語한국ไทยहि👩‍")))


@settings(max_examples=300, deadline=None)
@given(st.text(LETTERS, max_size=80))
def test_any_text(encoder, published, text):
    ids = encoder.encode(text)
    assert ids == published.encode_ordinary(text)
    assert encoder.decode(ids) == text


@pytest.mark.parametrize("text", ["", " ", "<|endoftext|>", "a" * 20_000, "日本" * 5_000, "x y " * 10_000, "\x00�"])
def test_special_and_long(encoder, published, text):
    assert encoder.encode(text) == published.encode_ordinary(text)


def test_small_memory(published, monkeypatch):
    monkeypatch.setattr(bpe, "REMEMBERED", 3)
    encoder = bpe.Encoder(bpe.load_ranks(FILE.read_bytes()))
    text = "many different words here, and some 日本語 again: words words"
    assert encoder.encode(text) == published.encode_ordinary(text)


def test_table(spark, published):
    rows = [(1, "hello world", "x"), (2, "", None), (3, None, "y"), (3, None, "y"), (None, "안녕 <|endoftext|>", "z")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, ids string")
    got = bpe.encode(df, "doc_id", "text")
    expected = [(i, published.encode_ordinary(t or "")) for i, t, _ in rows]
    assert sorted(map(tuple, got.collect()), key=str) == sorted(expected, key=str)
    assert dict(got.dtypes) == {"doc_id": "bigint", "ids": "array<int>"}
    back = bpe.decode(got, "doc_id").collect()
    assert sorted(map(tuple, back), key=str) == sorted(((i, t or "") for i, t, _ in rows), key=str)
    assert bpe.encode(df.limit(0), "doc_id", "text").collect() == []


def test_whole_documents(spark, data, published):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{data}/documents.parquet").collect()}
    got = bpe.encode(spark.read.parquet(f"{data}/documents.parquet"), "doc_id", "text").collect()
    assert {r.doc_id: r.ids for r in got} == {i: published.encode_ordinary(t or "") for i, t in docs.items()}
