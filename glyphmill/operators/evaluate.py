"""Measuring retrieval quality against a tokenizer that is not the index's own.

The truth for a token is every document whose title or body holds it as a run of letters and digits, lower-cased. All
measures are joins and aggregates over one batch search.
"""

from __future__ import annotations

import random

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from glyphmill.functions.text import FIRST_SYLLABLE, LAST_SYLLABLE, LOWER, initials
from glyphmill.operators.index import SearchIndex
from glyphmill.operators.search import score_batch
from glyphmill.operators.tables import attach, cut_lineage

WORD = r"[\p{L}\p{N}]+"
HANGUL = r"\p{IsHangul}"
SAMPLE = 60
NEGATIVES = 200
#: Tokens that can each have that part of all (document, token) pairs; only so many are joined by broadcast.
HOT_TOKENS = 20_000


def neutral_tokens(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit(WORD), F.lit(0))


def truth(corpus: DataFrame) -> DataFrame:
    """doc_id, url and token: distinct neutral tokens of title and body."""
    both = F.concat_ws(" ", F.coalesce("title", F.lit("")), F.coalesce("body", F.lit("")))
    return corpus.select("doc_id", F.coalesce("url", F.lit("")).alias("url"), F.explode(F.array_distinct(neutral_tokens(both))).alias("token"))


def document_frequency(corpus: DataFrame) -> DataFrame:
    """token and df, the number of documents that hold it."""
    return truth(corpus).groupBy("token").agg(F.count("*").alias("df"))


def vocabulary_sample(frequency: DataFrame, n: int = SAMPLE) -> DataFrame:
    """token and stratum: of the tokens of 2 to 12 characters, in order, every so-manieth Hangul and other one, n of each."""
    vocabulary = frequency.where(F.length("token").between(2, 12)).select("token", F.when(F.col("token").rlike(HANGUL), "hangul").otherwise("other").alias("stratum"))
    # Ranks without gathering a stratum in one task: count by first character, shift, and rank inside it.
    head = F.substring("token", 1, 1)
    counted = vocabulary.groupBy("stratum", head.alias("head")).agg(F.count("*").alias("n"))
    shifts = counted.select("stratum", "head", F.coalesce(F.sum("n").over(Window.partitionBy("stratum").orderBy("head").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    totals = counted.groupBy("stratum").agg(F.sum("n").alias("total"))
    ranked = vocabulary.withColumn("head", head).withColumn("own", F.row_number().over(Window.partitionBy("stratum", "head").orderBy("token")) - 1)
    placed = ranked.join(shifts, ["stratum", "head"]).join(totals, "stratum").withColumn("i", F.col("own") + F.col("before"))
    step = F.greatest(F.lit(1), F.floor(F.col("total") / n))
    return placed.where((F.col("i") % step == 0) & (F.col("i") / step < n)).select("token", "stratum")


def negative_tokens(n: int = 2 * NEGATIVES) -> list[str]:
    """Made-up words of zq and eight letters from a fixed random sequence."""
    draw = random.Random(42)
    return ["zq" + "".join(draw.choices(LOWER, k=8)) for _ in range(n)]


def _queries(tokens: DataFrame, limit: int) -> DataFrame:
    """Tokens as a batch: the token is its own query id."""
    return tokens.select(F.col("token").alias("query_id"), F.col("token").alias("query"), F.lit(limit).alias("max_results"))


def recall_precision(index: SearchIndex, corpus: DataFrame) -> DataFrame:
    """queries, recall (of at most 20) and precision over the vocabulary sample."""
    held = truth(corpus)
    sample = cut_lineage(vocabulary_sample(held.groupBy("token").agg(F.count("*").alias("df"))).select("token"))  # used four times
    urls = held.join(F.broadcast(sample), "token").select("token", "url").distinct()  # at most 2 * SAMPLE tokens are broadcast
    sizes = urls.groupBy("token").agg(F.count("*").alias("size"))
    got = score_batch(index.postings, _queries(sample, 20)).select(F.col("query_id").alias("token"), "doc_id")
    got = got.join(corpus.select("doc_id", F.coalesce("url", F.lit("")).alias("url")), "doc_id")
    hits = got.join(urls.withColumn("right", F.lit(1)), ["token", "url"], "left").groupBy("token").agg(F.count("right").alias("hit"), F.count("*").alias("got"))
    each = sizes.join(hits, "token", "left").select((F.coalesce("hit", F.lit(0)) / F.least("size", F.lit(20))).alias("recall"), (F.col("hit") / F.col("got")).alias("precision"))
    return each.agg(F.count("*").alias("queries"), F.round(F.avg("recall"), 6).alias("recall"), F.round(F.avg("precision"), 6).alias("precision"))


def negative_rate(index: SearchIndex, corpus: DataFrame) -> DataFrame:
    """queries, returned and fp_rate over made-up words that no document holds."""
    spark: SparkSession = index.spark
    words = spark.createDataFrame(list(enumerate(negative_tokens())), "i int, token string")
    held = truth(corpus).join(F.broadcast(words), "token", "left_semi").select("token").distinct()
    absent = cut_lineage(words.join(held, "token", "left_anti").orderBy("i").limit(NEGATIVES))
    found = score_batch(index.postings, _queries(absent, 20))
    documents = corpus.count()
    return found.agg(F.count("*").alias("returned")).select(F.lit(NEGATIVES).cast("bigint").alias("queries"), "returned", F.round(F.col("returned") / F.lit(float(NEGATIVES * max(1, documents))), 6).alias("fp_rate"))


def known_items(corpus: DataFrame) -> DataFrame:
    """doc_id, url and query: the rarest title token of each document, the longer one of equally rare ones."""
    titles = corpus.select("doc_id", F.coalesce("url", F.lit("")).alias("url"), F.explode(F.array_distinct(neutral_tokens(F.coalesce("title", F.lit(""))))).alias("token"))
    frequency = cut_lineage(document_frequency(corpus))
    total = frequency.agg(F.sum("df")).first()[0] or 0
    hot = F.col("df") > F.lit(total // HOT_TOKENS)
    best = attach(titles.where(F.length("token") >= 2), frequency.withColumn("hot", hot), "token", "hot")
    order = F.struct("df", (-F.length("token")).alias("shorter"), "token")
    return best.groupBy("doc_id", "url").agg(F.min(order).alias("o")).select("doc_id", "url", F.col("o.token").alias("query"))


def _found_rank(index: SearchIndex, corpus: DataFrame, items: DataFrame, limit: int) -> DataFrame:
    """items (doc_id, url, query) with the first rank at which their url comes, null if it doesn't."""
    items = cut_lineage(items)
    asked = items.select(F.col("query").alias("token")).distinct()
    got = score_batch(index.postings, _queries(asked, limit)).select(F.col("query_id").alias("query"), "rank", "doc_id")
    got = got.join(corpus.select("doc_id", F.coalesce("url", F.lit("")).alias("url")), "doc_id").groupBy("query", "url").agg(F.min("rank").alias("rank"))
    return items.join(got, ["query", "url"], "left")


def mean_reciprocal_rank(index: SearchIndex, corpus: DataFrame) -> DataFrame:
    """items and mrr, the mean of 1 / rank within 10."""
    ranks = _found_rank(index, corpus, known_items(corpus), 10)
    return ranks.agg(F.count("*").alias("items"), F.round(F.avg(F.coalesce(1 / F.col("rank"), F.lit(0.0))), 6).alias("mrr"))


def initials_queries(corpus: DataFrame) -> DataFrame:
    """doc_id, url and query: up to three initials of the first title word made of Hangul only."""
    word = F.get(F.filter(neutral_tokens(F.coalesce("title", F.lit(""))), lambda t: t.rlike(f"^{HANGUL}+$")), 0)
    syllables = F.regexp_extract("word", f"^[{chr(FIRST_SYLLABLE)}-{chr(LAST_SYLLABLE)}]*", 0)  # it ends at the first other character
    wanted = F.least(F.lit(3), F.length("word"))
    rows = corpus.select("doc_id", F.coalesce("url", F.lit("")).alias("url"), word.alias("word")).where("word IS NOT NULL").where(F.length(syllables) >= wanted)
    return rows.select("doc_id", "url", initials(F.substring(syllables, F.lit(1), wanted)).alias("query"))


def initials_retrieval(index: SearchIndex, corpus: DataFrame) -> DataFrame:
    """tried and found: documents that a search for the initials of a title word brings among 20."""
    ranks = _found_rank(index, corpus, initials_queries(corpus), 20)
    return ranks.agg(F.count("*").alias("tried"), F.count("rank").alias("found"))


