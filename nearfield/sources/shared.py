"""Tables in the folder that all executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

#: Rows of a file, at least, of a table with a known bound of rows, but for its last.
ROWS_PER_FILE = 100_000


def shared_dir(spark: SparkSession) -> str:
    """The folder that ``spark.checkpoint.dir`` names; where it is unset, a local
    folder in local mode and an error elsewhere."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        found = tempfile.mkdtemp(prefix="nearfield-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def _own_dir(spark: SparkSession) -> str:
    return f"{shared_dir(spark)}/nearfield-{spark.sparkContext.applicationId}"


def _delete(spark: SparkSession, path: str) -> None:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def release(spark: SparkSession) -> None:
    """Deletes all tables that materialize() wrote in this application: for when no
    result that reads them is needed any more."""
    _delete(spark, _own_dir(spark))


def materialize(df: DataFrame, *parts: str, rows: int | None = None) -> DataFrame:
    """``df`` written as a table in the shared folder and read back: its lineage ends
    there, it survives lost executors, and what is not a function of its rows alone
    (row names) is fixed from then on. ``parts`` are columns that get folders of their
    own, so that reading some of their values reads nothing else. ``rows`` is a bound
    of the number of rows where one is known: a small table is then written by as few
    tasks as its rows ask for and not by one for each partition of a shuffle, each of
    whose files costs the executor calls and processes of its own."""
    spark = df.sparkSession
    path = f"{_own_dir(spark)}/{uuid.uuid4().hex}"
    if rows is not None:
        df = df.coalesce(max(1, -(-rows // ROWS_PER_FILE)))
    (df.write.partitionBy(*parts) if parts else df.write).parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._written_to = path
    return out


def discard(*tables: DataFrame) -> None:
    """Deletes tables that materialize() returned: for when everything that is made of
    them has been written itself."""
    for t in tables:
        _delete(t.sparkSession, t._written_to)
