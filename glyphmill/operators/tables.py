"""Helpers that every operator shares: row-wise text preparation, counting inside a row, cutting lineage."""

from __future__ import annotations

import tempfile

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def let(value: Column, body) -> Column:
    """body(value) with value computed once, although body may use it inside lambdas."""
    return F.element_at(F.transform(F.array(value), body), 1)


def run_lengths(items: Column) -> Column:
    """Distinct items of a list with their counts, as array<struct<term, tf>>, inside the row: sort, find where a run starts, subtract."""

    def starts(ordered: Column) -> Column:
        return F.filter(F.sequence(F.lit(0), F.size(ordered) - 1), lambda i: (i == 0) | (F.get(ordered, i) != F.get(ordered, i - 1)))

    def pairs(ordered: Column, at: Column) -> Column:
        end = lambda p: F.coalesce(F.get(at, p + 1), F.size(ordered))
        return F.transform(at, lambda i, p: F.struct(F.get(ordered, i).alias("term"), (end(p) - i).cast("bigint").alias("tf")))

    counted = let(F.array_sort(items), lambda ordered: let(starts(ordered), lambda at: pairs(ordered, at)))
    return F.when(F.size(items) > 0, counted)


def cut_lineage(df: DataFrame) -> DataFrame:
    """df written once to the shared checkpoint folder. The session's spark.checkpoint.dir is used; a local folder only where it is unset."""
    sc = df.sparkSession.sparkContext
    if sc.getCheckpointDir() is None:
        folder = df.sparkSession.conf.get("spark.checkpoint.dir", None)
        if folder is None and not (sc.master == "local" or sc.master.startswith("local[")):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        sc.setCheckpointDir(folder or tempfile.mkdtemp(prefix="glyphmill-"))
    return df.checkpoint()


def release(df: DataFrame) -> None:
    """Delete the files of a table that cut_lineage wrote, when nothing will read it again. Does nothing for any other table."""
    try:
        written = df._jdf.queryExecution().logical().rdd().getCheckpointFile()
    except Exception:  # a plan on top of the written table, or none
        return
    if written.isDefined():
        jvm = df.sparkSession._jvm
        path = jvm.org.apache.hadoop.fs.Path(written.get())
        path.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(path, True)


def release_shuffles(df: DataFrame) -> None:
    """Delete the shuffle files of a plan that has run and will not run again, which else stay until the driver collects its garbage. Does nothing for a plan that has none."""
    try:
        ids = list(df._jdf.queryExecution().executedPlan().context().shuffleIds().keySet())
        cleaner = df.sparkSession._jsc.sc().cleaner().get()
    except Exception:  # not an adaptive plan, or a session without a cleaner
        return
    for i in ids:
        cleaner.doCleanupShuffle(i, True)


def attach(rows: DataFrame, table: DataFrame, key: str, hot: str, spread: int = 997) -> DataFrame:
    """rows joined with the row of table for their key (one row a key, none null), in one pass and without a hot key.

    The keys with the boolean column `hot` are joined by broadcast, so the caller must make sure that only a bounded number
    of keys can have it; their rows then go to any task, by a salt, and the others to the task of their key. Columns of the
    table come behind those of rows, without `hot`.
    """
    values = [c for c in table.columns if c not in (key, hot)]
    packed = F.struct(*values)
    hots = table.where(F.col(hot)).select(key, packed.alias("_hot"))
    colds = table.where(~F.col(hot)).select(key, F.lit(0).alias("_salt"), packed.alias("_cold"))
    salt = F.when(F.col("_hot").isNull(), F.lit(0)).otherwise(1 + F.pmod(F.hash(*rows.columns), F.lit(spread)))
    joined = rows.join(F.broadcast(hots), key, "left").withColumn("_salt", salt).join(colds.hint("merge"), [key, "_salt"], "left")
    found = F.coalesce("_hot", "_cold").alias("_found")
    return joined.select(*rows.columns, found).where(F.col("_found").isNotNull()).select(*rows.columns, *(F.col(f"_found.{v}").alias(v) for v in values))


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A test table. One that lies in fewer parts than there are cores (a single small file) is spread over them; others stay as they are."""
    table = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    cores = spark.sparkContext.defaultParallelism
    return table if table.rdd.getNumPartitions() >= cores else table.repartition(cores)
