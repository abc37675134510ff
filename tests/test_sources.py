import zipfile

import numpy as np
import pytest
from pyspark.ml.linalg import Vectors

from nearfield.sources import shared
from nearfield.sources.rows import from_csr, from_vectors, read_matrix_market, read_npz


def as_set(df):
    return {(r["id"], tuple(r["features"]), tuple(r["values"])) for r in df.collect()}


WANT = {(0, (1, 3), (2.0, 5.0)), (2, (0,), (1.5,))}


def test_csr(spark):
    got = as_set(from_csr(spark, [0, 2, 2, 4], [3, 1, 0, 2], [5.0, 2.0, 1.5, 0.0]))
    assert got == WANT | {(1, (), ())}


def test_matrix_market(spark, tmp_path):
    (tmp_path / "m.mtx").write_text("%%MatrixMarket matrix coordinate real general\n% a comment\n3 4 3\n1 4 5.0\n1 2 2.0\n3 1 1.5\n")
    assert as_set(read_matrix_market(spark, str(tmp_path / "m.mtx"))) == WANT


def test_npz(spark, tmp_path):
    np.savez(tmp_path / "m.npz", indptr=np.array([0, 2, 2, 3]), indices=np.array([3, 1, 0]), data=np.array([5.0, 2.0, 1.5]))
    assert zipfile.is_zipfile(tmp_path / "m.npz")
    assert as_set(read_npz(spark, str(tmp_path / "m.npz"))) == WANT


def test_matrix_market_of_other_kinds(spark, tmp_path):
    def read(kind, *lines):
        (tmp_path / "m.mtx").write_text("\n".join([f"%%MatrixMarket matrix {kind}", "% a comment", "3 3 2", *lines]))
        return as_set(read_matrix_market(spark, str(tmp_path / "m.mtx")))

    assert read("coordinate real symmetric", "2 1 5.0", "3 3 1.5") == {(1, (0,), (5.0,)), (0, (1,), (5.0,)), (2, (2,), (1.5,))}
    assert read("coordinate integer skew-symmetric", "2 1 5", "3 1 2") == {(1, (0,), (5.0,)), (2, (0,), (2.0,)), (0, (1, 2), (-5.0, -2.0))}
    assert read("coordinate pattern general", "2 1", "3 3") == {(1, (0,), (1.0,)), (2, (2,), (1.0,))}
    for kind in ("array real general", "coordinate complex general", "coordinate real hermitian"):
        with pytest.raises(ValueError):
            read(kind, "1 1 1 0")


def test_npz_of_other_formats(spark, tmp_path):
    path = str(tmp_path / "m.npz")
    np.savez(path, format=np.array(b"csc"), indptr=np.array([0, 1, 2, 2, 3]), indices=np.array([2, 0, 0]), data=np.array([1.5, 2.0, 5.0]), shape=np.array([3, 4]))
    assert as_set(read_npz(spark, path)) == WANT
    np.savez(path, format=np.array(b"coo"), row=np.array([2, 0, 0]), col=np.array([0, 1, 3]), data=np.array([1.5, 2.0, 5.0]))
    assert as_set(read_npz(spark, path)) == WANT
    np.savez(str(tmp_path / "n.npz"), format=np.array(b"bsr"), data=np.zeros(1))
    with pytest.raises(ValueError):
        read_npz(spark, str(tmp_path / "*.npz"))
    with pytest.raises(Exception, match="no such format"):
        read_npz(spark, str(tmp_path / "n.npz")).collect()


def test_vectors(spark):
    df = spark.createDataFrame([(0, Vectors.sparse(4, [1, 3], [2.0, 5.0])), (2, Vectors.dense(1.5, 0, 0, 0))], ["k", "v"])
    assert as_set(from_vectors(df, "k", "v")) == WANT


def test_tables_in_the_shared_folder_can_be_released(spark):
    from pathlib import Path

    kept = shared.materialize(spark.range(5))
    assert kept.count() == 5 and shared.materialize(spark.range(0)).count() == 0
    where = Path(shared._own_dir(spark))
    assert any(where.iterdir())
    shared.release(spark)
    assert not where.exists()


def test_words_are_counted_where_they_lie(spark):
    """Ids that repeat, across files and batches too, add up; null ids, texts and words
    and empty words drop out; what crosses the network is lists of counts, once."""
    from pyspark.sql import functions as F

    from nearfield.sources.rows import from_long, from_words

    made = [(7, ["a", "b", "", "a"]), (3, ["é", None, "ß", "é"]), (7, ["b", "c"]), (None, ["a"]), (4, None), (5, []), (6, ["", None]), (9, ["x"] * 300), (7, ["a"]), (-2, ["a"])]
    df = spark.createDataFrame(made, "id long, words array<string>")
    long = df.select("id", F.explode("words").alias("w")).where("w <> ''").select("id", F.conv(F.substring(F.md5("w"), 1, 6), 16, 10).cast("long").alias("f"), F.lit(1.0).alias("v"))
    want = as_set(from_long(long))
    assert {i for i, *_ in want} == {7, 3, 9, -2}
    for size in (1, 2, 10000):
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", size)
        for parts in (1, 4):
            got = from_words(df.repartition(parts))
            assert got.dtypes == [("id", "bigint"), ("features", "array<bigint>"), ("values", "array<double>")] and as_set(got) == want
    spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    plan = from_words(df)._jdf.queryExecution().executedPlan().toString()
    assert sum("Exchange" in x for x in plan.splitlines()) == 1 and "HashAggregate" not in plan
    assert as_set(from_words(df.where("id in (4, 5, 6)"))) == set()
    named = df.withColumn("id", F.col("id").cast("string"))
    assert {(int(i), *r) for i, *r in as_set(from_words(named))} == want
