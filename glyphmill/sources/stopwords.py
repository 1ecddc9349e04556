"""Stopwords: the default list, and lists read from raw lines."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from glyphmill.functions.text import ascii_lower

# Words left out of an index unless another list is given.
DEFAULT_STOPWORDS = tuple(
    """
    a an the and or but if else of at by for let const with about against between into through during before after above
    below to from up down in out on off over under again further then once here there all any both each few more most
    other some such no nor not only own same so than too very just also is am are was were be been being have has had do
    does did would wouldn shall should shouldn might must can could i j k l you he we she they me him her them my your his
    its our their this that these those who whom whose which what as continue break s t d
    가 것 그 나 네 니 다 단 등 마 못 사 수 아 안 야 오 이 예 자 차 카 타 파 하 허 저 너 내 뭐 좀
    이것 그것 저것 이러한 그러한 저러한 여기 거기 저기 이곳 그곳 저곳 때 뿐 및 또는 또한 또 즉 그리고 그러나 그래서 하지만 때문
    있다 없다 이다 아니다 하다 되다 같은 다른 모든 어떤
    """.split()
)


def parse_lines(lines: DataFrame, column: str) -> DataFrame:
    """word: the distinct stopwords of raw lines, trimmed and lower-cased; blank lines and those that start with # are no words."""
    word = F.btrim(F.col(column), F.lit(" \t\r"))
    return lines.select(word.alias("word")).where((F.col("word") != "") & ~F.col("word").startswith("#")).select(ascii_lower(F.col("word")).alias("word")).distinct()


def read_file(spark: SparkSession, path: str) -> tuple[str, ...]:
    """Stopwords of a text file, for a configuration."""
    return tuple(r.word for r in parse_lines(spark.read.text(path), "value").orderBy("word").collect())
