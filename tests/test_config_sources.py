import json

import pytest

from glyphmill.config import ConfigError, IndexConfig, PrefixFieldNotIndexed
from glyphmill.sources import corpus, stopwords


def config(**root):
    return IndexConfig.from_json(json.dumps(root))


def test_defaults():
    c = IndexConfig()
    assert (c.indexed_fields, c.metadata_fields, c.url_field, c.prefix_fields, c.initials_max_len) == (("title",), (), "url", ("title",), 3)
    assert IndexConfig.from_json("{}") == c
    assert IndexConfig.from_json('["title"]') == c


def test_settings():
    c = config(schema={"indexed_fields": ["title", "body"], "metadata_fields": ["a", 3, None], "prefix_fields": ["body"], "url_field": "path"})
    assert (c.indexed_fields, c.metadata_fields, c.prefix_fields, c.url_field) == (("title", "body"), ("a", "", ""), ("body",), "path")
    assert config(schema={"indexed_fields": "title", "url_field": 7}) == IndexConfig()
    assert config(schema=[], korean=3) == IndexConfig()


def test_initials_switch():
    assert config(korean={"choseong_search": False}).initials_max_len == 0
    assert config(korean={"choseong_search": False, "choseong_max_len": 2}).initials_max_len == 2
    assert config(korean={"choseong_search": "no", "choseong_max_len": True}).initials_max_len == 3
    assert config(korean={"choseong_max_len": 2.0}).initials_max_len == 3


@pytest.mark.parametrize("text", ['{"schema": ', "", None])
def test_not_json(text):
    with pytest.raises(ConfigError):
        IndexConfig.from_json(text)


def test_checks():
    with pytest.raises(PrefixFieldNotIndexed):
        config(schema={"indexed_fields": ["body"]}).checked()
    with pytest.raises(ConfigError):
        config(korean={"choseong_max_len": 256}).checked()
    assert config(schema={"indexed_fields": ["body"], "prefix_fields": []}).checked()


def test_stopword_lines(spark):
    lines = ["# no", "  the ", "The", "was\r", "\tand\t", "", "  ", "#x", "it's", "ＡＮＤ", None, "number one"]
    got = stopwords.parse_lines(spark.createDataFrame([(x,) for x in lines], "line string"), "line")
    assert {r.word for r in got.collect()} == {"the", "was", "and", "it's", "ＡＮＤ", "number one"}


def test_stopword_file(spark, tmp_path):
    (tmp_path / "s.txt").write_bytes(b"# c\r\nBeta\r\nalpha\r\n\r\n")
    assert stopwords.read_file(spark, str(tmp_path / "s.txt")) == ("alpha", "beta")


def test_default_stopwords():
    assert len(stopwords.DEFAULT_STOPWORDS) == len(set(stopwords.DEFAULT_STOPWORDS)) == 185


ROWS = [
    {"title": "A", "url": "/a", "body": "x", "views": 12, "ok": True, "score": 2.50, "tags": ["t"], "none": None},
    {"title": 7, "url": ["u"], "views": "12", "score": -1e21, "extra": 1},
    {},
]


def test_json_array(spark, tmp_path):
    (tmp_path / "c.json").write_text(json.dumps(ROWS))
    got = corpus.from_json_array(spark, str(tmp_path / "c.json"), ["title", "url", "body"], ["views", "ok", "score", "tags", "none"]).orderBy("doc_id").collect()
    assert [r.doc_id for r in got] == [0, 1, 2]
    assert [(r.title, r.url, r.body) for r in got] == [("A", "/a", "x"), (None, None, None), (None, None, None)]
    assert [(r.views, r.ok, r.tags, r.none) for r in got] == [("12", "true", "", ""), ("12", "", "", ""), ("", "", "", "")]
    assert [r.score for r in got] == ["2.5", "-1000000000000000000000", ""]


def test_plain_numbers(spark):
    from pyspark.sql import functions as F

    numbers = [2.5, 3.0, -0.001, 1e21, 0.0, None, 123456.789, 1e-7, 1e300]
    got = [r.s for r in spark.createDataFrame([(x,) for x in numbers], "x double").select(corpus.plain_number(F.col("x")).alias("s")).collect()]
    assert got[:8] == ["2.5", "3", "-0.001", "1000000000000000000000", "0", None, "123456.789", "0.0000001"] and float(got[8]) == 1e300


def test_json_numbers(spark, tmp_path):
    (tmp_path / "c.json").write_text('[{"n": 1.50}, {"n": 3.0}, {"n": -7}, {"n": 100}, {"n": 12345678901234567890}]')
    got = corpus.from_json_array(spark, str(tmp_path / "c.json"), [], ["n"]).orderBy("doc_id").collect()
    assert [r.n for r in got] == ["1.5", "3", "-7", "100", "12345678901234567890"]


def test_json_errors(spark, tmp_path):
    (tmp_path / "o.json").write_text('{"title": "A"}')
    with pytest.raises(Exception, match="NotAnArray"):
        corpus.from_json_array(spark, str(tmp_path / "o.json"), ["title"]).collect()
    (tmp_path / "n.json").write_text('[{"title": "A"}, 3]')
    with pytest.raises(Exception, match="NotAnObject"):
        corpus.from_json_array(spark, str(tmp_path / "n.json"), ["title"]).collect()


def test_json_array_too_large(spark, tmp_path, monkeypatch):
    (tmp_path / "c.json").write_text(json.dumps(ROWS))
    monkeypatch.setattr(corpus, "JSON_ARRAY_LIMIT", 10)
    with pytest.raises(corpus.CorpusError):
        corpus.from_json_array(spark, str(tmp_path / "c.json"), ["title"])


def test_json_lines(spark, tmp_path):
    (tmp_path / "c.jsonl").write_text("\n".join(map(json.dumps, ROWS)) + "\n\n")
    got = corpus.from_json_lines(spark, str(tmp_path / "c.jsonl"), ["title"], ["views"]).orderBy("doc_id").collect()
    assert [tuple(r) for r in got] == [(0, "A", "12"), (1, None, "12"), (2, None, "")]


def test_json_lines_of_unequal_files(spark, tmp_path):
    sizes = {"a.jsonl": 3, "b.jsonl": 400, "c.jsonl": 1, "d.jsonl": 90}
    names = [f"{f}{i}" for f, n in sizes.items() for i in range(n)]
    for f, n in sizes.items():
        (tmp_path / f).write_text("\n".join(json.dumps({"title": f"{f}{i}", "body": "x" * 50}) for i in range(n)))
    got = corpus.from_json_lines(spark, str(tmp_path), ["title"]).orderBy("doc_id").collect()
    assert [r.title for r in got] == names and [r.doc_id for r in got] == list(range(len(names)))


def test_dense_ids(spark):
    df = spark.range(0, 1000, 1, 7).selectExpr("1000 - id AS k").where("k % 3 <> 0")
    got = corpus.with_doc_id(df, ["k"]).orderBy("doc_id").collect()
    assert [r.doc_id for r in got] == list(range(len(got)))
    assert [r.k for r in got] == sorted(r.k for r in got)
    assert corpus.with_doc_id(df.limit(0)).collect() == []


def test_attach(spark):
    from glyphmill.operators.tables import attach

    rows = spark.createDataFrame([(i, "hot" if i % 3 else f"k{i}") for i in range(60)] + [(99, "none"), (98, None)], "id int, k string")
    table = spark.createDataFrame([("hot", 1, True)] + [(f"k{i}", i, False) for i in range(0, 60, 3)], "k string, v int, many boolean")
    got = {(r.id, r.k, r.v) for r in attach(rows, table, "k", "many").collect()}
    assert got == {(i, "hot", 1) if i % 3 else (i, f"k{i}", i) for i in range(60)}


def test_release(spark):
    from glyphmill.operators.tables import cut_lineage, release

    df = cut_lineage(spark.range(10))
    path = df._jdf.queryExecution().logical().rdd().getCheckpointFile().get()
    jvm = spark._jvm
    exists = lambda: jvm.org.apache.hadoop.fs.Path(path).getFileSystem(spark._jsc.hadoopConfiguration()).exists(jvm.org.apache.hadoop.fs.Path(path))
    assert df.count() == 10 and exists()
    release(df)
    assert not exists()
    release(spark.range(3))
