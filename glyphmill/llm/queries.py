"""Queries of the text operators, by name: callables of (spark, sf_dir)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from glyphmill.llm import bpe, canon, distinctive, leakage, markup, neardup, sentences, termfreq
from glyphmill.operators.tables import read_table

FIELDS = ["title", "body"]
#: Signs without which a body holds no markup, but for runs of marks at the start of a line.
MARKUP_SIGNS = r"[<>&\\\[{|`$*_~'#=-]"
#: White space of any kind, for Java's patterns and DuckDB's.
WHITE = r"[ \t-\r\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]+"

#: The terms of problem 1: pieces of four characters, a similarity of 0.6, at least 80 letters and digits in the body.
ALIKE = {"id_col": "doc_id", "main": "body", "others": ["title"], "similarity": 0.6, "piece": 4, "least": 80}


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.similar_pairs(read_table(spark, sf_dir, "search_index"), **ALIKE)


def p1_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.groups(read_table(spark, sf_dir, "search_index"), **ALIKE)


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = distinctive.distinctiveness(read_table(spark, sf_dir, "search_index"), "doc_id", FIELDS)
    # A term is found with its score: every term has one, as its expected count is above 0.
    return scored.where((F.col("tf") >= 3) & F.col("records").between(2, 5) & F.col("adjusted").isNotNull()).select("doc_id", "term")


def p2_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = distinctive.distinctiveness(read_table(spark, sf_dir, "search_index"), "doc_id", FIELDS)
    return scored.select("doc_id", "term", "tf", "records", *(F.round(c, 4).alias(c) for c in ("expected", "residual", "adjusted")))


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    forms = canon.canonical(read_table(spark, sf_dir, "search_index"), FIELDS, ["doc_id"], flags=True)
    field = F.explode(F.array(*(F.when(F.col(f"{c}_deviates"), F.lit(c)) for c in FIELDS))).alias("field")
    return forms.where(F.col("title_deviates") | F.col("body_deviates")).select("doc_id", field).where(F.col("field").isNotNull())


def p3_canonical(spark: SparkSession, sf_dir: str) -> DataFrame:
    return canon.canonical(read_table(spark, sf_dir, "search_index"), FIELDS, ["doc_id"])


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return termfreq.usefulness(read_table(spark, sf_dir, "search_index"), "doc_id", FIELDS).where("verdict <> 'useful'").select("term", "verdict")


def p4_frequencies(spark: SparkSession, sf_dir: str) -> DataFrame:
    return termfreq.usefulness(read_table(spark, sf_dir, "search_index"), "doc_id", FIELDS).select("term", "occurrences", "records", "verdict")


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return markup.clean_bodies(read_table(spark, sf_dir, "search_index"), "doc_id", "body").select("doc_id", F.explode("kinds").alias("kind"))


def p5_clean(spark: SparkSession, sf_dir: str) -> DataFrame:
    return markup.clean_bodies(read_table(spark, sf_dir, "search_index"), "doc_id", "body").select("doc_id", "text")


def p5_plain(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the operator makes of bodies without any sign that markup needs: themselves."""
    known = read_table(spark, sf_dir, "search_index").select(F.struct("doc_id", F.col("body").alias("stored")).alias("k"), "body")
    return markup.clean_bodies(known, "k", "body").where(~F.col("k.stored").rlike(MARKUP_SIGNS)).select("k.doc_id", "text")


def p6_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode(read_table(spark, sf_dir, "documents"), "doc_id", "text")


def p6_decoded(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.decode(p6_ids(spark, sf_dir), "doc_id")


def p7_near(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents, items = read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "eval_items")
    return leakage.leaked(documents, "doc_id", "text", items, "item_id", "text", "lang", max_edits=1)


def p7_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of the passages within an edit those that are equal."""
    return p7_near(spark, sf_dir).where("edits = 0").select("doc_id", "item_id")


def p8_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sentences.sentence_units(read_table(spark, sf_dir, "documents"), "doc_id", "text", with_text=False).select("doc_id", "end_pos")


def p8_units(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sentences.sentence_units(read_table(spark, sf_dir, "documents"), "doc_id", "text")


def p8_cover(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The units of each text one behind the other, without white space."""
    units = sentences.sentence_units(read_table(spark, sf_dir, "documents"), "doc_id", "text")
    ordered = F.array_sort(F.collect_list(F.struct("unit_no", "unit")))  # the units of one text
    joined = F.array_join(F.transform(ordered, lambda u: u["unit"]), "")
    return units.groupBy("doc_id").agg(F.regexp_replace(joined, WHITE, "").alias("text"))


QUERIES = {f.__name__: f for f in (p1_found, p1_groups, p2_found, p2_scores, p3_found, p3_canonical, p4_found, p4_frequencies, p5_found, p5_clean, p5_plain, p6_ids, p6_decoded, p7_found, p7_near, p8_found, p8_units, p8_cover)}
