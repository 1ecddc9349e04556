import unicodedata

import duckdb
import pyarrow as pa
import regex
from hypothesis import given, settings
from hypothesis import strategies as st

from glyphmill.llm import canon

CON = duckdb.connect(config={"threads": 1})


def forms(texts):
    CON.register("batch", pa.table({"i": list(range(len(texts))), "x": pa.array(texts, pa.string())}))
    rows = CON.sql(canon.canonical_sql(["x"], ["i"], True)).fetchall()
    return [(x, d) for _, x, d in sorted(rows, key=lambda r: r[0])]


CASES = [
    ("ａｂＣ１２", "abC12", True), ("ｶﾞﾊﾟｱ", "ガパア", True), ("café", "café", True), ("が", "が", True), ("K", "K", True), ("林", "林", True),
    ("a​b­c﻿", "abc", True), ("a b c　d e", "a b c d e", True), ("thе mοved", "the moved", True), ("paди Oсккес", "ради Осккес", True),
    ("Пеллун α-form Ω", "Пеллун α-form Ω", False), ("👩‍🚀 👨‍👩‍👧", "👩‍🚀 👨‍👩‍👧", False), ("a‍b", "ab", True),
    ("km² ½ ™ “q” – — …", "km² ½ ™ “q” – — …", False), ("，。！（）「」", "，。！（）「」", False), ("a\tb\r\nc\n", "a\tb\r\nc\n", False), ("", "", False), (None, None, False), ("plain", "plain", False),
    ("한글 日本 ไทย हिन्दी", "한글 日本 ไทย हिन्दी", False), ("ﾞ", "゙", True), ("αβв", "αβв", False), ("it's", "it's", False),
]


def test_examples():
    assert forms([c[0] for c in CASES]) == [c[1:] for c in CASES]


LETTERS = st.sampled_from(list("abcxyzABC аеоЖдΑοβ1２ａＢｶﾞ​‍ ゙́か👩🚀é林林.,-'\n"))


@settings(max_examples=30, deadline=None)
@given(st.lists(st.text(LETTERS, max_size=40), min_size=1, max_size=20))
def test_form_is_stable_and_clean(texts):
    once = forms(texts)
    again = forms([x for x, _ in once])
    assert [x for x, _ in again] == [x for x, _ in once]
    for text, (form, deviates) in zip(texts, once, strict=True):
        assert unicodedata.is_normalized("NFC", form)
        assert not regex.search(r"[ ​０-９Ａ-Ｚａ-ｚｦ-ﾟ]", form)
        assert deviates or form == text


def test_dirty_table(spark):
    rows = [(1, "ａ", None, "k"), (1, "ａ", None, "k"), (None, "", "x​" * 30_000, None), (3, None, None, None)]
    df = spark.createDataFrame(rows, "id bigint, title string, body string, title_deviates string")
    got = canon.canonical(df, ["title", "body"], ["id"], flags=True)
    assert got.columns == ["id", "title", "body", "title_deviates", "body_deviates"]
    assert sorted(map(tuple, got.collect()), key=str) == sorted([(1, "a", None, True, False), (1, "a", None, True, False), (None, "", "x" * 30_000, False, True), (3, None, None, False, False)], key=str)
    assert canon.canonical(df.limit(0), ["title"], ["id"]).collect() == []


def test_nothing_is_shuffled(spark):
    plan = canon.canonical(spark.createDataFrame([(1, "a")], "id bigint, t string"), ["t"], ["id"])._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan
