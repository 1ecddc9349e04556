"""Corpora: documents with a dense doc_id in input order, from JSON or any DataFrame.

A corpus has doc_id BIGINT and the fields of its documents; the index reads the fields its configuration names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from glyphmill.operators.tables import cut_lineage

#: Largest JSON array read as one value; larger corpora come as JSON lines or Parquet.
JSON_ARRAY_LIMIT = 100 * 1024 * 1024


class CorpusError(ValueError):
    """Input that is no corpus."""


def plain_number(number: Column) -> Column:
    """A floating-point number without exponent and without needless zeros: 2.5, 3, 1000000000000000000000."""
    return _short(F.coalesce(*(number.try_cast(f"decimal(38,{d})").cast("string") for d in (18, 6, 0)), number.cast("string")))


def _short(digits: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(digits, r"(\.\d*?)0+$", "$1"), r"\.$", "")


def stringified(value: Column) -> Column:
    """A variant as text: strings, numbers and truth values in their plain form, everything else (and a missing value) empty."""
    kind = F.schema_of_variant(value)
    number = _short(F.regexp_replace(F.to_json(value), r"^\"|\"$", ""))
    plain = F.when(kind == "STRING", F.try_variant_get(value, "$", "string")).when(kind.isin("BIGINT", "BOOLEAN") | kind.startswith("DECIMAL"), number)
    return F.coalesce(plain.when(kind.isin("DOUBLE", "FLOAT"), plain_number(F.try_variant_get(value, "$", "double"))), F.lit(""))


def string_only(value: Column) -> Column:
    """A variant's text if it is a string, else null."""
    return F.when(F.schema_of_variant(value) == "STRING", F.try_variant_get(value, "$", "string"))


def _fields(objects: DataFrame, texts: list[str], metadata: list[str]) -> DataFrame:
    field = lambda name: F.try_variant_get(F.col("value"), "$['" + name.replace("'", "\\'") + "']", "variant")
    columns = [string_only(field(n)).alias(n) for n in texts] + [stringified(field(n)).alias(n) for n in metadata if n not in texts]
    is_object = F.schema_of_variant("value").startswith("OBJECT")
    return objects.select("doc_id", F.when(is_object, F.col("value")).otherwise(F.raise_error(F.lit("NotAnObject: an item of the corpus is no JSON object"))).alias("value")).select("doc_id", *columns)


def from_json_array(spark: SparkSession, path: str, texts: list[str], metadata: list[str] = ()) -> DataFrame:
    """Corpus of a file that holds one JSON array of objects; doc_id is the position. Raises at run time if it isn't one."""
    files = spark.read.format("binaryFile").load(path).select(F.max("length").alias("n"), F.count("*").alias("files")).first()
    if files["files"] != 1 or files["n"] > JSON_ARRAY_LIMIT:
        raise CorpusError(f"{path}: one file of at most {JSON_ARRAY_LIMIT} bytes is read as a JSON array; use JSON lines or Parquet")
    root = spark.read.option("wholetext", True).text(path).select(F.parse_json("value").alias("root"))
    array = F.when(F.schema_of_variant("root").startswith("ARRAY"), F.col("root")).otherwise(F.raise_error(F.lit("NotAnArray: the corpus is no JSON array")))
    root.select(array.alias("root")).createOrReplaceTempView("glyphmill_json_array")
    items = spark.sql("SELECT CAST(e.pos AS BIGINT) AS doc_id, e.value FROM glyphmill_json_array, LATERAL variant_explode(root) AS e")
    return _fields(items, list(texts), list(metadata))


def from_json_lines(spark: SparkSession, path: str, texts: list[str], metadata: list[str] = ()) -> DataFrame:
    """Corpus of files with one JSON object a line; doc_id follows the order of the files' paths and of the lines in them.

    Spark packs parts of files by size, so the lines are written once and numbered by path, place of the part, and line.
    """
    columns = (F.col("_metadata.file_path").alias("_gm_file"), F.col("_metadata.file_block_start").alias("_gm_start"))
    lines = cut_lineage(spark.read.text(path).select("value", *columns).where(F.trim("value") != "").withColumn("_gm_line", F.monotonically_increasing_id()))
    order = ["_gm_file", "_gm_start", "_gm_line"]
    return _fields(with_doc_id(lines, order).select("doc_id", F.parse_json("value").alias("value")), list(texts), list(metadata))


def with_doc_id(df: DataFrame, order_by: list[str] | None = None) -> DataFrame:
    """df with a dense doc_id from 0: in the order of the columns, or of its partitions.

    Rows are numbered inside their partition and shifted by the rows of the partitions before it, so no task holds more
    than its own partition; the table of shifts has one row for each partition. The numbered rows are written once, as
    computing them again could cut the partitions elsewhere.
    """
    from pyspark.sql import Window

    ordered = df.orderBy(*order_by) if order_by else df
    columns = df.columns
    numbered = ordered.withColumn("_gm_id", F.monotonically_increasing_id())
    numbered = cut_lineage(numbered)
    part, row = F.shiftright("_gm_id", 33).cast("int"), F.col("_gm_id").bitwiseAND(F.lit((1 << 33) - 1))
    counts = numbered.groupBy(part.alias("_gm_part")).agg(F.count("*").alias("n"))
    shift = F.sum("n").over(Window.orderBy("_gm_part").rowsBetween(Window.unboundedPreceding, -1))
    shifts = counts.select("_gm_part", F.coalesce(shift, F.lit(0)).alias("_gm_shift"))
    return numbered.withColumn("_gm_part", part).join(F.broadcast(shifts), "_gm_part").select((row + F.col("_gm_shift")).cast(T.LongType()).alias("doc_id"), *columns)
