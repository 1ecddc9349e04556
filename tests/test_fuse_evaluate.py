import numpy as np
import pytest

from glyphmill.config import IndexConfig
from glyphmill.operators import evaluate as E
from glyphmill.operators import fuse
from glyphmill.operators.index import build_index, postings
from glyphmill.plans.oracle import SMALL_CORPUS

RNG = np.random.default_rng(1)


@pytest.mark.parametrize("n", [0, 1, 2, 3, 10, 100, 5000])
@pytest.mark.parametrize("bits", [8, 9, 16])
def test_no_false_negative(n, bits):
    keys = RNG.integers(-(1 << 63), 1 << 63, n, dtype=np.int64)
    blob = fuse.build(keys, bits)
    assert len(blob) == fuse.blob_size(len(np.unique(keys)), bits)
    assert fuse.Filter(blob).contains(keys).all()


def test_false_positive_rate():
    keys = RNG.integers(-(1 << 63), 1 << 63, 50_000, dtype=np.int64)
    held = fuse.Filter(fuse.build(keys, 9)).contains(RNG.integers(-(1 << 63), 1 << 63, 200_000, dtype=np.int64))
    assert 0.5 * 2**-9 < held.mean() < 1.5 * 2**-9


def test_repeats_and_determinism():
    keys = np.array([5, 5, 7, 7, 7, -1], np.int64)
    assert fuse.build(keys, 9) == fuse.build(np.array([-1, 7, 5], np.int64), 9)


def test_filter_errors():
    blob = fuse.build(np.arange(100), 9)
    for bad in (b"", blob[:20], blob[:-1]):
        with pytest.raises(fuse.FilterError):
            fuse.Filter(bad)
    with pytest.raises(fuse.FilterError):
        fuse.build(np.arange(3), 17)


def test_packing():
    values = RNG.integers(0, 1 << 11, 1000).astype(np.uint16)
    assert (fuse._unpack(fuse._pack(values, 11), 11, 1000) == values).all()


def test_high_product():
    a = RNG.integers(0, 1 << 63, 1000, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    assert fuse._high(a, 123_457).tolist() == [int(x) * 123_457 >> 64 for x in a.tolist()]


def test_keys(spark):
    import xxhash

    rows = spark.createDataFrame([("hello",), ("한글",), ("",)], "t string").select("t", fuse.token_key("t").alias("k")).collect()
    assert all(r.k & ((1 << 64) - 1) == xxhash.xxh64_intdigest(r.t.encode(), seed=0) for r in rows)


def test_filters_of_postings(spark, monkeypatch):
    monkeypatch.setattr(fuse, "SHARD_KEYS", 10)
    corpus = spark.createDataFrame(SMALL_CORPUS, "doc_id bigint, title string, url string, body string, author string, date string")
    keys = fuse.pair_keys(postings(corpus, IndexConfig(indexed_fields=("title", "body"))))
    filters = fuse.build_filters(keys)
    assert filters.count() > 2
    assert {r.held for r in fuse.probe(keys.select("tier", "key"), filters).collect()} == {True}
    sizes = {r.tier: (r["keys"], r["bytes"]) for r in fuse.filter_statistics(postings(corpus, IndexConfig(indexed_fields=("title", "body")))).collect()}
    assert sizes["lo"] == (n := keys.where("tier = 'lo'").count(), fuse.blob_size(n, 9))
    assert fuse.build_filters(keys.limit(0)).collect() == []


def test_filter_search(spark):
    corpus = spark.createDataFrame(SMALL_CORPUS, "doc_id bigint, title string, url string, body string, author string, date string")
    index = build_index(corpus, IndexConfig(indexed_fields=("title", "body")))
    filters = fuse.build_filters(fuse.pair_keys(index.postings))
    for query in ("hello world", "progr", "ㅇㄴ", "hello programming", "", "zzz"):
        exact = {(r.doc_id, r.hits, r.title_hits) for r in index.search(query).collect()}
        got = fuse.filter_search(index.documents, filters, query).collect()
        assert {r.doc_id for r in got} >= {e[0] for e in exact}
        assert all(any(r.doc_id == d and r.hits >= h and r.title_hits >= t for r in got) for d, h, t in exact)
        assert [r["rank"] for r in got] == list(range(1, len(got) + 1))


def corpus(spark):
    rows = [(0, "Alpha one", "/a", "shared x1"), (1, "Beta two", "/b", "shared alpha"), (2, "안녕하세요 친구", "/c", None), (3, None, None, ""), (4, "가a나", "/e", "b")]
    return spark.createDataFrame(rows, "doc_id bigint, title string, url string, body string")


def test_frequency_and_known_items(spark):
    assert {r.token: r.df for r in E.document_frequency(corpus(spark)).collect()}["alpha"] == 2
    assert {r.doc_id: r.query for r in E.known_items(corpus(spark)).collect()} == {0: "one", 1: "beta", 2: "안녕하세요", 4: "가a나"}


def test_sample(spark):
    frequency = spark.createDataFrame([(f"w{i:04}", 1) for i in range(250)] + [("가나", 1), ("x", 1), ("y" * 13, 1)], "token string, df int")
    got = {(r.token, r.stratum) for r in E.vocabulary_sample(frequency).collect()}
    assert got == {(f"w{i:04}", "other") for i in range(0, 240, 4)} | {("가나", "hangul")}


def test_initials_queries(spark):
    assert {r.doc_id: r.query for r in E.initials_queries(corpus(spark)).collect()} == {2: "ㅇㄴㅎ"}


def test_measures(spark):
    c = corpus(spark)
    index = build_index(c, IndexConfig(indexed_fields=("title", "body")))
    assert E.negative_rate(index, c).first().asDict() == {"queries": 200, "returned": 0, "fp_rate": 0.0}
    assert E.mean_reciprocal_rank(index, c).first().mrr == 1.0
    assert E.initials_retrieval(index, c).first().asDict() == {"tried": 1, "found": 1}
    quality = E.recall_precision(index, c).first()
    assert 0.9 <= quality.recall <= 1 and 0.8 <= quality.precision <= 1


def test_negative_tokens():
    words = E.negative_tokens()
    assert len(words) == 400 and all(len(w) == 10 and w.startswith("zq") for w in words) and words == E.negative_tokens()
