"""What the operators of this subpackage share; tables in the shared folder and
connected components come from the library."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from nearfield.operators.components import components
from nearfield.sources.shared import discard, materialize, shared_dir

__all__ = ["ascii_lower", "bounded_sample", "components", "discard", "materialize", "pick", "read", "running_sum", "shared_dir", "slices", "word_count"]

#: The letters that normalising changes. Words are runs of characters
#: other than space and the five control characters from tab to carriage return.
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
WORD, BETWEEN = r"[^\x20\x09-\x0D]+", " \t\n\x0b\f\r"


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def ascii_lower(text: Column) -> Column:
    """A-Z lower-cased, nothing else; null counts as empty."""
    return F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER)


def pick(df: DataFrame, **columns: str) -> DataFrame:
    """The named columns of ``df`` under new names; other columns, whatever their
    names, go."""
    return df.select(*(F.col(f"`{old}`").alias(new) for new, old in columns.items()))


def slices(batches, rows: int = 100):
    """The Arrow batches of a task in slices of ``rows``: what a function makes of one
    slice it yields before the next. Spark bounds the bytes of a batch itself
    (spark.sql.execution.arrow.maxBytesPerBatch), so long texts fit as well."""
    for b in batches:
        for at in range(0, b.num_rows, rows):
            yield b.slice(at, rows)


def word_count(text: Column) -> Column:
    """The number of words of the whole text; null: 0. One pass makes each word one
    letter, so no list of words is built."""
    letters = F.translate(F.regexp_replace(F.coalesce(text, F.lit("")), WORD, "x"), BETWEEN, "")
    return F.length(letters).cast("long")


def running_sum(df: DataFrame, group: str, key: str, ties: list[str], value: str, into: str, rows_per_bucket: int = 50_000) -> DataFrame:
    """``df`` with the inclusive running sum of ``value`` within ``group`` (null is a
    group), in the order of ``key``, a column of hexadecimal digests, then ``ties``.

    Digests spread evenly, so a few of their first digits cut even a group with all
    rows into small buckets. The rows cross the network once; the sums of earlier
    buckets come from a table of a row per group and bucket."""
    rows, digits = df.count(), 1
    while rows > rows_per_bucket * 16**digits:
        digits += 1
    cut = df.withColumn("_bucket", F.substring(key, 1, digits))
    sums = cut.groupBy(group, "_bucket").agg(F.sum(value).alias("_sum"))
    before = Window.partitionBy(group).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select(F.col(group).alias("_group"), F.col("_bucket").alias("_b"), F.coalesce(F.sum("_sum").over(before), F.lit(0)).alias("_before"))
    within = Window.partitionBy(group, "_bucket").orderBy(key, *ties).rowsBetween(Window.unboundedPreceding, 0)
    inner = cut.withColumn(into, F.sum(value).over(within))
    joined = inner.join(sums, F.col(group).eqNullSafe(F.col("_group")) & (F.col("_bucket") == F.col("_b")))
    return joined.withColumn(into, F.col(into) + F.col("_before")).drop("_bucket", "_group", "_b", "_before")


def bounded_sample(docs: DataFrame, keys: DataFrame, id_col: str, rows: int) -> DataFrame:
    """The rows of ``docs`` whose id is one of the ``rows`` first of ``keys`` (distinct
    ids, column id) in the order of their md5. At most ``rows`` ids are broadcast."""
    chosen = keys.where("id is not null").orderBy(F.md5(F.col("id").cast("string")), "id").limit(rows)
    return docs.join(F.broadcast(chosen.withColumnRenamed("id", "_id")), F.col(f"`{id_col}`") == F.col("_id"), "left_semi")
