from dataclasses import replace

import pytest
from pyspark.sql import functions as F

from glyphmill.config import IndexConfig, PrefixFieldNotIndexed
from glyphmill.operators import index as I
from glyphmill.operators.search import results_json, score_batch
from glyphmill.plans.oracle import SMALL_CORPUS
from glyphmill.streaming.append import append_index, postings_stream

SCHEMA = "doc_id bigint, title string, url string, body string, author string, date string"
CONFIG = IndexConfig(indexed_fields=("title", "body"), metadata_fields=("author", "date"))


@pytest.fixture(scope="module")
def small(spark):
    return I.build_index(spark.createDataFrame(SMALL_CORPUS, SCHEMA), CONFIG).cache()


def found(index, query, n=0):
    return [(r.title, r.hits, r.title_hits) for r in index.search(query, n).orderBy("rank").collect()]


EXPECTED = {
    "hello": [("Hello World", 1, 1), ("Hello 안녕", 1, 1)],
    "안녕": [("Hello 안녕", 1, 1), ("안녕하세요", 1, 0)],
    "hel": [("Hello World", 1, 0), ("Hello 안녕", 1, 0)],
    "progr": [("Zig Programming", 1, 0)],
    "ㅎ": [],
    "ㅇ": [("안녕하세요", 1, 1), ("Hello 안녕", 1, 1)],
    "ㅇㄴ": [("안녕하세요", 1, 1), ("Hello 안녕", 1, 1)],
    "ㅇㄴㅎㅅ": [],
    "hello world": [("Hello World", 2, 2), ("Hello 안녕", 2, 1)],
    "hello programming": [("Hello World", 2, 1), ("Zig Programming", 1, 1), ("Hello 안녕", 1, 1)],
    "hello zzznonexistentzzz": [("Hello World", 1, 1), ("Hello 안녕", 1, 1)],
    "progr hello": [("Hello World", 1, 1), ("Hello 안녕", 1, 1)],
    "HELLO": [("Hello World", 1, 1), ("Hello 안녕", 1, 1)],
    "": [], " ... ": [], "zzznonexistentzzz": [], "ㅋㅋㅋ": [],
}


@pytest.mark.parametrize("query", EXPECTED)
def test_searches(small, query):
    assert found(small, query) == EXPECTED[query]


def test_limit_and_null(small):
    assert found(small, "quern", 2) == [("Hello World", 1, 0), ("Zig Programming", 1, 0)]
    assert len(found(small, "quern", 500)) == 5
    assert found(small, None) == []


def test_repeats_count_and_cap(small):
    assert found(small, " ".join(["hello"] * 20))[0] == ("Hello World", 16, 16)
    assert found(small, "hello " * 15 + "x progr") == [("Hello World", 15, 15), ("Hello 안녕", 15, 15)]


def test_batch_is_the_single_search(spark, small):
    rows = [(i, q, 0) for i, q in enumerate(EXPECTED)] + [(99, None, 0), (98, "quern", 2)]
    got = small.search_batch(spark.createDataFrame(rows, "query_id int, query string, max_results int")).orderBy("query_id", "rank").collect()
    for i, q in enumerate(EXPECTED):
        assert [(r.title, r.hits, r.title_hits) for r in got if r.query_id == i] == EXPECTED[q]
    assert [r.title for r in got if r.query_id == 98] == ["Hello World", "Zig Programming"]
    assert not [r for r in got if r.query_id == 99]
    assert small.search_batch(spark.createDataFrame([], "query_id int, query string, max_results int")).collect() == []


def test_batch_without_broadcast(spark, small, monkeypatch):
    monkeypatch.setattr("glyphmill.operators.search.BROADCAST_PROBES", 0)
    got = score_batch(small.postings, spark.createDataFrame([(1, "hello world", 0)], "query_id int, query string, max_results int"))
    assert [(r.doc_id, r.hits) for r in got.orderBy("rank").collect()] == [(0, 2), (3, 2)]


def test_large_batch_is_never_broadcast(spark, small, monkeypatch):
    monkeypatch.setattr("glyphmill.operators.search.BROADCAST_PROBES", 0)
    queries = spark.createDataFrame([(1, "hello world", 0), (2, "progr", 3)], "query_id int, query string, max_results int").repartition(2, "query").distinct()
    got = score_batch(small.postings, queries)
    rows, plan = got.collect(), got._jdf.queryExecution().executedPlan().toString()  # as it ran, with its sizes known
    assert rows and "BroadcastExchange" not in plan and "BroadcastHashJoin" not in plan


def test_stored_fields(small):
    assert small.document_count == 5
    assert small.metadata_fields == ("author", "date")
    assert small.document(1) == {"doc_id": 1, "title": "Zig Programming", "url": "/zig", "meta": {"author": "bob", "date": "2026-02-20"}}
    assert small.document(9) is None
    row = small.search("fast").first()
    assert (row.url, row.meta["author"]) == ("/zig", "bob")
    assert '"title":"Zig Programming"' in results_json(small.search("fast")).first().result


def test_posting_numbers(small):
    counts = {r.doc_id: r["count"] for r in small.postings.groupBy("doc_id").count().collect()}
    assert [counts[i] for i in range(5)] == [12, 15, 16, 13, 10]
    assert small.postings.count() == small.postings.distinct().count()
    assert small.tier("lo").count() + small.tier("hi").count() == sum(counts.values())


def test_save_and_load(spark, small, tmp_path):
    path = str(tmp_path / "index")
    small.save(path)
    again = I.SearchIndex.load(spark, path)
    assert found(again, "hello world") == EXPECTED["hello world"]
    assert again.metadata_fields == ("author", "date") and again.document_count == 5
    assert sorted(map(tuple, again.postings.collect())) == sorted(map(tuple, small.postings.collect()))
    plan = again.postings_for({"exact"}, {"hello"})._jdf.queryExecution().toString()
    pruned = plan.split("PartitionFilters: [")[1].split("PushedFilters")[0]
    assert "bucket" in pruned and "kind" in pruned and "EqualTo(token,hello)" in plan
    opened = again.stored.where("kind = 'exact'").where(F.col("bucket") == I.token_bucket(F.lit("hello"), again.buckets))
    assert {r.token for r in opened.collect()} >= {"hello"} and opened.count() < again.stored.where("kind = 'exact'").count()
    with pytest.raises(I.IndexError_):
        again.filter("lo")


def test_stored_filters(spark, small, tmp_path):
    path = str(tmp_path / "index")
    small.save(path, filters=True)
    again = I.SearchIndex.load(spark, path)
    assert again.filter("lo").first().n == small.tier("lo").count() and again.filter("hi").first().n == small.tier("hi").count()
    for query in ("hello world", "progr", "ㅇㄴ", ""):
        got = {(r.doc_id, r.hits, r.title_hits) for r in again.filter_search(query).collect()}
        assert {r.doc_id for r in small.search(query).collect()} <= {g[0] for g in got}


def test_unstored_corpus_is_narrowed(spark):
    index = I.build_index(spark.createDataFrame(SMALL_CORPUS, SCHEMA), CONFIG)
    for query in EXPECTED:
        assert found(index, query) == EXPECTED[query]
    plan = index.search("fast")._jdf.queryExecution().optimizedPlan().toString()
    assert "Contains" in plan or "contains" in plan.lower()


def test_stored_bytes(spark, small, tmp_path):
    small.save(str(tmp_path / "i"))
    assert I.SearchIndex.stored_bytes(spark, str(tmp_path / "i")) > 1000


def test_load_errors(spark, small, tmp_path, monkeypatch):
    with pytest.raises(I.IndexError_):
        I.SearchIndex.load(spark, str(tmp_path / "nothing"))
    monkeypatch.setattr(I, "VERSION", 99)
    small.save(str(tmp_path / "other"))
    monkeypatch.undo()
    with pytest.raises(I.IndexError_, match="version 99"):
        I.SearchIndex.load(spark, str(tmp_path / "other"))


def test_config_roles(spark):
    corpus = spark.createDataFrame([(0, "Alpha beta", "the gamma", "/p", 5)], "doc_id bigint, title string, body string, path string, views int")
    body = I.postings(corpus, IndexConfig(indexed_fields=("body",), prefix_fields=("body",)))
    assert {tuple(r)[1:] for r in body.collect()} == {("exact", "the"), ("exact", "gamma"), ("prefix", "th"), ("prefix", "ga"), ("prefix", "gam"), ("prefix", "gamm")}
    stop = I.postings(corpus, replace(CONFIG, stopwords=("the", "alpha")))
    assert {r.token for r in stop.collect()} == {"gamma", "beta", "be", "bet"}
    other = I.stored_documents(corpus, IndexConfig(url_field="path", metadata_fields=("views", "missing"))).first()
    assert (other.url, other.meta) == ("/p", {"views": "5", "missing": ""})
    assert I.postings(corpus, IndexConfig(indexed_fields=("views", "missing"), prefix_fields=())).collect() == []
    with pytest.raises(PrefixFieldNotIndexed):
        I.build_index(corpus, IndexConfig(indexed_fields=("body",)))


def test_initials_lengths(spark):
    corpus = spark.createDataFrame([(0, "안녕", "한글날")], "doc_id bigint, title string, body string")
    kinds = lambda n: {(r.kind, r.token) for r in I.postings(corpus, replace(CONFIG, initials_max_len=n)).collect() if "cho" in r.kind}
    assert kinds(0) == set()
    assert kinds(1) == {("cho", "ㅇ"), ("title_cho", "ㅇ")}
    assert kinds(3) == {("cho", "ㅇ"), ("cho", "ㅇㄴ"), ("title_cho", "ㅇ"), ("title_cho", "ㅇㄴ"), ("cho", "ㅎㄱ"), ("cho", "ㅎㄱㄴ")}


def test_dirty_rows(spark):
    rows = [(0, None, None, None), (1, "", " ", ""), (2, "x" * 50_000, "y " * 20_000, "u")]
    index = I.build_index(spark.createDataFrame(rows, "doc_id bigint, title string, body string, url string"), IndexConfig(indexed_fields=("title", "body")))
    assert [r.doc_id for r in index.search("y").collect()] == [2]
    empty = I.build_index(spark.createDataFrame([], SCHEMA), CONFIG)
    assert empty.search("x").collect() == [] and empty.document_count == 0


def test_pretokenized(spark):
    df = spark.createDataFrame([(0, ["안녕", "안녕", "a", None, ""]), (1, None)], "doc_id bigint, tokens array<string>")
    assert {tuple(r) for r in I.pretokenized_postings(df, "tokens").collect()} == {(0, "exact", "안녕"), (0, "exact", "a"), (0, "exact", ""), (0, "cho", "ㅇㄴ")}


def test_building_shuffles_nothing(spark):
    plan = I.postings(spark.createDataFrame(SMALL_CORPUS, SCHEMA), CONFIG)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Python" not in plan


def test_streaming(spark, tmp_path):
    source = str(tmp_path / "in")
    spark.createDataFrame(SMALL_CORPUS[:3], SCHEMA).write.parquet(source)
    stream = spark.readStream.schema(SCHEMA).parquet(source)
    assert postings_stream(stream, CONFIG).isStreaming
    out = str(tmp_path / "out")
    append_index(stream, CONFIG, out, str(tmp_path / "cp")).awaitTermination(120)
    spark.createDataFrame(SMALL_CORPUS[3:], SCHEMA).write.mode("append").parquet(source)
    append_index(stream, CONFIG, out, str(tmp_path / "cp")).awaitTermination(120)
    index = I.SearchIndex.load(spark, out)
    for query in ("hello world", "quern", "ㅇㄴ"):
        assert found(index, query) == found(I.build_index(spark.createDataFrame(SMALL_CORPUS, SCHEMA), CONFIG), query)
    assert index.metadata_fields == ("author", "date") and index.document_count == 5
    assert spark.read.parquet(f"{out}/documents").agg(F.countDistinct("batch")).first()[0] == 2


def test_command_line(spark, tmp_path, capsys):
    import json

    from glyphmill.__main__ import main

    (tmp_path / "c.json").write_text(json.dumps([dict(zip(("title", "url", "body"), r[1:4], strict=True)) for r in SMALL_CORPUS]))
    (tmp_path / "k.json").write_text('{"schema": {"indexed_fields": ["title", "body"]}}')
    assert main(["build", str(tmp_path / "c.json"), "-o", str(tmp_path / "i"), "--config", str(tmp_path / "k.json")], spark) == 0
    assert "5 documents" in capsys.readouterr().out
    assert main(["search", str(tmp_path / "i"), "hello world"], spark) == 0
    assert capsys.readouterr().out.splitlines()[0] == "1\t2\tHello World\t/hello"
    assert main([], spark) == 0
