"""How characteristic each term is of each record: residuals of correspondence analysis.

With n the number of tokens in all records, a record of r tokens and a term with c occurrences, the expected count is
r * c / n. The score of a term that occurs o times in the record is (o - expected) / sqrt(expected); the adjusted score
divides by sqrt((1 - r / n) * (1 - c / n)) as well, so that scores of large rows and columns compare with others.

A row of the table is a record, also where its id is repeated. Null and empty texts hold no term, an empty table gives an
empty result, and an adjusted score whose variance is 0 (one record, or one term only) is 0.

Plan: terms are counted inside the row, so no shuffle goes by record. The margins of the terms are aggregated (map side
first), written once, and joined back in one pass over the texts: terms frequent enough that there can be at most HOT_TERMS
of them by a broadcast join, the others by a shuffle in which no key has more than 1 / HOT_TERMS of the pairs.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from glyphmill.llm.termfreq import all_tokens
from glyphmill.operators.tables import attach, cut_lineage, run_lengths

#: Bound of the broadcast side: only so many terms can each have that part of all (record, term) pairs.
HOT_TERMS = 20_000


def record_terms(df: DataFrame, id_col: str, texts: list[str]) -> DataFrame:
    """id, row_total, term and tf, one row for each distinct term of each row of df."""
    rows = df.select(F.col(id_col).alias("id"), all_tokens(texts).alias("tokens")).where(F.size("tokens") > 0)
    return rows.select("id", F.size("tokens").cast("bigint").alias("row_total"), F.inline(run_lengths(F.col("tokens"))))


def distinctiveness(df: DataFrame, id_col: str, texts: list[str]) -> DataFrame:
    """id_col, term, tf, records, expected, residual, adjusted for every term of every record."""
    pairs = record_terms(df, id_col, texts)
    margins = cut_lineage(pairs.groupBy("term").agg(F.sum("tf").alias("column_total"), F.count("*").alias("records")))
    sums = margins.agg(F.sum("column_total").alias("n"), F.sum("records").alias("pairs")).first()
    n, hot_from = float(sums["n"] or 1), (sums["pairs"] or 0) // HOT_TERMS + 1
    joined = attach(pairs, margins.withColumn("hot", F.col("records") >= hot_from), "term", "hot")
    expected = F.col("row_total") * F.col("column_total") / F.lit(n)
    spread = (1 - F.col("row_total") / F.lit(n)) * (1 - F.col("column_total") / F.lit(n))
    residual = (F.col("tf") - F.col("expected")) / F.sqrt("expected")
    return (
        joined.withColumn("expected", expected)
        .withColumn("residual", residual)
        .withColumn("adjusted", F.when(spread > 0, F.col("residual") / F.sqrt(spread)).otherwise(F.lit(0.0)))
        .select(F.col("id").alias(id_col), "term", "tf", "records", "expected", "residual", "adjusted")
    )
