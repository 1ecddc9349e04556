"""Tokenization and expansion against the rules, written as a state machine of their own."""

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from glyphmill.functions import text as T
from glyphmill.operators.search import query_tokens

RANGES = {
    "latin": [(0x41, 0x5A), (0x61, 0x7A), (0xC0, 0xD6), (0xD8, 0xF6), (0xF8, 0x2AF), (0x1E00, 0x1EFF)],
    "hangul": [(0xAC00, 0xD7A3), (0x1100, 0x11FF), (0x3130, 0x318F), (0xFFA0, 0xFFDC)],
    "han": [(0x4E00, 0x9FFF), (0x3400, 0x4DBF), (0xF900, 0xFAFF), (0x20000, 0x2FFFF)],
    "hiragana": [(0x3040, 0x309F)],
    "katakana": [(0x30A0, 0x30FF), (0x31F0, 0x31FF), (0xFF65, 0xFF9F)],
    "number": [(0x30, 0x39), (0xFF10, 0xFF19)],
    "mark": [(0x300, 0x36F), (0x1AB0, 0x1AFF), (0x1DC0, 0x1DFF), (0x20D0, 0x20FF), (0xFE20, 0xFE2F)],
}


def group(c):
    return next((g for g, rs in RANGES.items() for a, b in rs if a <= ord(c) <= b), "delimiter")


def machine(text):
    out, run, kind = [], "", None
    for c in text:
        g = group(c)
        if g == "mark":
            run += c if run else ""
            continue
        if g != kind and run:
            out.append(run)
            run = ""
        kind = g
        if g != "delimiter":
            run += chr(ord(c) + 32) if "A" <= c <= "Z" else c
    return out + [run] * bool(run)


CASES = [
    ("HelloWorld", ["helloworld"]), ("안녕hello", ["안녕", "hello"]), ("URL이 없다", ["url", "이", "없다"]), ("Covid19", ["covid", "19"]),
    ("日本語ABC", ["日本語", "abc"]), ("あア", ["あ", "ア"]), ("hello🔥world", ["hello", "world"]), ("́", []), ("가́hello", ["가́", "hello"]),
    ("１２３", ["１２３"]), ("Étre É", ["Étre", "É"]), ("a×b÷c", ["a", "b", "c"]), ("𠀀𠀁x", ["𠀀𠀁", "x"]), ("Привет ab", ["ab"]), ("", []), ("  \n", []), ("ｆｕｌｌ", []),
]


def tokens(spark, texts):
    rows = spark.createDataFrame(list(enumerate(texts)), "i int, t string").select("i", T.tokenize(F.col("t")).alias("w")).collect()
    return [r.w for r in sorted(rows)]


def test_examples(spark):
    assert tokens(spark, [c[0] for c in CASES]) == [c[1] for c in CASES]


def test_null(spark):
    assert tokens(spark, [None]) == [None]


LETTERS = st.sampled_from([chr(x + d) for rs in RANGES.values() for a, b in rs for x in (a, b) for d in (-1, 0, 1)] + list("aZ09 .-가힣ㅋ漢かカ́🔥é×"))


@settings(max_examples=5, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.text(LETTERS, max_size=30), min_size=50, max_size=200))
def test_any_text(spark, texts):
    expected = [machine(t) for t in texts]
    assert tokens(spark, texts) == expected
    assert [query_tokens(t) for t in texts] == expected


def expanded(spark, words, make):
    rows = spark.createDataFrame(list(enumerate(words)), "i int, w string").select("i", make(F.col("w")).alias("x")).collect()
    return [r.x for r in sorted(rows)]


def test_edge_ngrams(spark):
    got = expanded(spark, ["hello", "ab", "a", "", "abc", "abcdefghijkl", "𠀀𠀁𠀂"], T.edge_ngrams)
    assert got == [["he", "hel", "hell"], [], [], [], ["ab"], ["abcdefghijkl"[:k] for k in range(2, 9)], ["𠀀𠀁"]]


def test_initials(spark):
    assert expanded(spark, ["안녕하세요", "애니", "ㅋ하", "abc", "꽃a잎", "힣"], T.initials) == ["ㅇㄴㅎㅅㅇ", "ㅇㄴ", "ㅎ", "", "ㄲㅇ", "ㅎ"]


def test_initials_prefixes(spark):
    assert expanded(spark, ["안녕하세요", "안", "abc"], lambda c: T.initials_prefixes(c, 1, 3)) == [["ㅇ", "ㅇㄴ", "ㅇㄴㅎ"], ["ㅇ"], []]
    assert expanded(spark, ["안녕하세요", "안"], lambda c: T.initials_prefixes(c, 2, 3)) == [["ㅇㄴ", "ㅇㄴㅎ"], []]
    assert expanded(spark, ["안녕"], lambda c: T.initials_prefixes(c, 2, 1)) == [[]]


def test_is_initials(spark):
    assert expanded(spark, ["ㄱㅎ", "ㄳ", "가", "ㄱa", "", "ㅏ"], T.is_initials) == [True, False, False, False, False, False]


def test_script_groups(spark):
    words = ["abc", "가", "漢", "あ", "ア", "１", "́", "п"]
    assert expanded(spark, words, T.script_group) == [group(w[0]) for w in words]


def test_sql_functions(spark):
    T.register_sql(spark)
    row = spark.sql("SELECT gm_tokenize('URL이 없다') AS a, gm_initials('안녕x') AS b, gm_edge_ngrams('hello') AS c, gm_edge_ngrams('ab') AS d").first()
    assert (row.a, row.b, row.c, row.d) == (["url", "이", "없다"], "ㅇㄴ", ["he", "hel", "hell"], [])


def test_very_long_text(spark):
    assert len(tokens(spark, ["word1 " * 100_000])[0]) == 200_000
