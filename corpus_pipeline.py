"""The corpus pipeline: quality, exact duplicates, near duplicates, mixing, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written and
read back as the next stage's docs. All but the last keep the columns of documents, and
other columns, whatever their names, go. No stage goes by doc_id where rows may share
one or have none: rows are told apart by where they lie in the files of ``docs``. An
empty table gives no rows in each stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from nearfield.llm import quality as q
from nearfield.llm.common import materialize, read
from nearfield.llm.exact_dedup import exact_dedup
from nearfield.llm.mixing import mix
from nearfield.llm.packing import pack
from nearfield.llm.simhash import near_dedup

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def _named(docs: DataFrame) -> DataFrame:
    """``docs`` with a name for each row, the file it lies in and its place there, so
    that ids may repeat or be null and no text is written again. What is no plain table
    of files is written first."""
    if docs._jdf.queryExecution().analyzed().getClass().getSimpleName() != "LogicalRelation":
        docs = materialize(docs.select(*COLUMNS))
    file = F.unhex(F.md5(F.col("_metadata.file_path")))
    return docs.select(*COLUMNS, F.struct(file.alias("file"), F.col("_metadata.row_index").alias("at")).alias("_row"))


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a score below 0.5 go. The labels are those of the corpus.

    A null or empty text is scored as one empty line; repeated rows have one score and
    stay or go together; null ids are scored like others and teach nothing."""
    model = q.fit(docs, read(spark, sf_dir, "labels"))
    return q.score_quality(docs, model, into="_score").where("_score >= 0.5").select(*COLUMNS)


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the one with the largest doc_id stays, and of rows that tie in it,
    or have none, one. It is rows that go: others with the same doc_id stay. Null texts
    are equal to empty ones; a null id is smaller than any other."""
    rows = _named(docs)
    # the name as part of the id makes every id another, null ones too
    named = exact_dedup(rows.select(F.struct("doc_id", "_row").alias("_id"), "text"), "_id")
    gone = materialize(named.where("not kept").select("_id._row"))
    return rows.join(gone, "_row", "left_anti").select(*COLUMNS)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates stays, the smallest doc_id.

    Rows with one id are one document and stay or go together; rows without id are in
    no group and stay. Texts without words are near duplicates of each other."""
    return near_dedup(docs).select(*COLUMNS)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each row as often as the mix takes it, which may be never; those without words
    (null texts among them) stay once. Rows that share an id, or have none, are each
    taken by themselves; a null source is a source of its own."""
    rows = _named(docs)
    times = F.when(F.col("size") == 0, 1).otherwise(F.col("passes")).cast("int")
    taken = materialize(mix(rows, row_col="_row").select("_row", times.alias("_times")).where("_times > 0"))
    out = rows.join(taken, "_row").withColumn("_time", F.explode(F.sequence(F.lit(1), F.col("_times"))))
    return out.select(*COLUMNS)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A row for each piece of each document with its place in a bin; see pack. Each row
    of ``docs`` is packed, repeated ones and those without id too; texts without words,
    null ones among them, have one row without a bin."""
    return pack(docs)


STAGES = [("quality", quality), ("exact_dedup", exact), ("near_dedup", near), ("mixing", mixing), ("packing", packing)]

#: The classifier is trained and the near duplicates are hashed, which SQL cannot say.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage for ``documents``; each stage reads what the one
    before it has written."""
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stage(spark, docs, sf_dir)
        if name != STAGES[-1][0]:
            docs = materialize(docs)
    return docs
