"""Sparse rows from many forms.

The row layout is (id, features, values), feature ids in order; the long layout is
(id, f, v), a row for each value that is not zero. Feature ids are whole numbers from 0
to 2**31 - 1.
"""

from __future__ import annotations

import hashlib
import io
import zipfile

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

MOST_FEATURE = 2**31 - 1


def _checked(f: Column) -> Column:
    bad = F.raise_error(F.concat(F.lit("feature id out of range: "), f.cast("string"))).cast("long")
    return F.when((f < 0) | (f > MOST_FEATURE), bad).otherwise(f.cast("long"))


def from_long(df: DataFrame, id: str = "id", f: str = "f", v: str = "v") -> DataFrame:
    """The row layout of a long table; zeros and nulls drop out, values of one feature
    add up, so any row count of a feature gives one value."""
    cells = df.select(F.col(id).alias("id"), _checked(F.col(f)).alias("f"), F.col(v).cast("double").alias("v"))
    cells = cells.where("v <> 0 and id is not null and f is not null").groupBy("id", "f").agg(F.sum("v").alias("v"))
    rows = cells.groupBy("id").agg(F.array_sort(F.collect_list(F.struct("f", "v"))).alias("c"))
    return rows.select("id", F.col("c.f").alias("features"), F.col("c.v").alias("values"))


def whole(batches):
    """Lists of slices of the batches, in order and each with all rows of its ids, of
    which no two are apart."""
    held = []
    for batch in batches:
        if not batch.num_rows:
            continue
        ids = batch.column("id").to_numpy(zero_copy_only=False)
        last = int(np.searchsorted(ids, ids[-1]))  # this id may go on in the next batch
        if held and (last or held[-1].column("id")[-1].as_py() != ids[0]):
            cut = int(np.searchsorted(ids, held[-1].column("id")[-1].as_py(), "right"))
            yield [*held, batch.slice(0, cut)] if cut else held
            held, last, batch = [], last - cut, batch.slice(cut)
        if last > 0:
            yield [batch.slice(0, last)]
            batch = batch.slice(last)
        if batch.num_rows:
            held.append(batch)
    if held:
        yield held


#: Features of words that a task remembers at most.
MOST_WORDS = 1_000_000


def from_words(df: DataFrame, id: str = "id", words: str = "words") -> DataFrame:
    """The row layout of lists of words: the feature of a word is the first six
    hexadecimal digits of its md5, the value its count over all lists of the id. Words
    are counted where they lie, each different word of a batch is hashed once, and a
    list crosses the network as its counts."""
    kind = dict(df.dtypes)[id]

    def cells(place: np.ndarray, features: np.ndarray, counts: np.ndarray, n: int):
        """(list offsets, features, counts) of ``n`` rows, features in order."""
        keys = (place << 31) | features
        if counts is None:  # one each
            keys.sort()
        else:
            order = np.argsort(keys, kind="stable")
            keys, counts = keys[order], counts[order]
        start = np.flatnonzero(np.diff(keys, prepend=-1))
        sums = np.diff(start, append=len(keys)) if counts is None or not len(start) else np.add.reduceat(counts, start)
        ends = np.concatenate(([0], np.cumsum(np.bincount(keys[start] >> 31, minlength=n)))).astype(np.int32)
        return pa.array(ends), keys[start] & (2**31 - 1), sums

    def counted(batches):
        known = {}
        for batch in batches:
            for at in range(0, batch.num_rows, 1000):
                c = batch.slice(at, 1000)
                lists = c.column("words")
                coded = lists.flatten().cast(pa.binary()).dictionary_encode()
                place = np.repeat(np.arange(c.num_rows), np.array(lists.value_lengths().fill_null(0), dtype=np.int64))
                if len(known) > MOST_WORDS:
                    known.clear()
                feature = []
                for w in coded.dictionary.to_pylist():
                    if (f := known.get(w)) is None:
                        f = known[w] = int.from_bytes(hashlib.md5(w, usedforsecurity=False).digest()[:3], "big") if w else -1
                    feature.append(f)
                codes = coded.indices.fill_null(-1).to_numpy(zero_copy_only=False)
                f = np.array([*feature, -1], dtype=np.int64)[codes]
                there = f >= 0  # neither null nor empty
                ends, features, counts = cells(place[there], f[there], None, c.num_rows)
                made = [pa.ListArray.from_arrays(ends, pa.array(x, pa.int32())) for x in (features, counts)]
                yield pa.RecordBatch.from_arrays([c.column("id"), *made], names=["id", "f", "n"])

    def added(batches):
        for parts in whole(batches):
            ids = pa.concat_arrays([p.column("id") for p in parts])
            f, n = (pa.concat_arrays([p.column(x) for p in parts]) for x in ("f", "n"))
            values = ids.to_numpy(zero_copy_only=False)
            new = np.concatenate(([True], values[1:] != values[:-1]))
            ends, features, counts = f.offsets, f.flatten().to_numpy(), n.flatten().to_numpy()
            if not new.all():
                place = np.repeat(np.cumsum(new) - 1, np.diff(f.offsets.to_numpy()))
                ends, features, counts = cells(place, features.astype(np.int64), counts, int(new.sum()))
                ids = ids.filter(pa.array(new))
            else:
                ends = pa.array(ends.to_numpy() - ends[0].as_py())
            made = [pa.ListArray.from_arrays(ends, pa.array(x.astype(t))) for x, t in ((features, np.int64), (counts, np.float64))]
            yield pa.RecordBatch.from_arrays([ids, *made], names=["id", "features", "values"])

    rows = df.where(F.col(id).isNotNull()).select(F.col(id).alias("id"), F.col(words).alias("words"))
    found = rows.mapInArrow(counted, f"id {kind}, f array<int>, n array<int>").where("size(f) > 0")
    return found.repartition("id").sortWithinPartitions("id").mapInArrow(added, f"id {kind}, features array<bigint>, values array<double>")


def to_long(rows: DataFrame) -> DataFrame:
    cells = rows.select("id", F.explode(F.arrays_zip("features", "values")).alias("c"))
    return cells.select("id", F.col("c.features").alias("f"), F.col("c.values").alias("v"))


def from_dense(df: DataFrame, id: str, vector: str) -> DataFrame:
    """Rows of an array column; position is the feature, zeros and nulls drop out."""
    cells = F.filter(F.transform(F.col(vector), lambda x, i: F.struct(i.cast("long").alias("f"), x.cast("double").alias("v"))), lambda c: c["v"] != 0)
    return df.select(F.col(id).alias("id"), cells.alias("c")).select("id", F.col("c.f").alias("features"), F.col("c.v").alias("values"))


def from_vectors(df: DataFrame, id: str, vector: str) -> DataFrame:
    """Rows of a column of pyspark.ml vectors, sparse or dense."""
    from pyspark.ml.functions import vector_to_array

    return from_dense(df.withColumn("_v", vector_to_array(vector)), id, "_v")


def from_csr(spark: SparkSession, indptr, indices, data) -> DataFrame:
    """Rows of the three arrays of a compressed matrix that the driver holds."""
    rows = []
    for i, (a, b) in enumerate(zip(indptr[:-1], indptr[1:])):
        cells = sorted((int(f), float(v)) for f, v in zip(indices[a:b], data[a:b]) if v != 0)
        rows.append((i, [f for f, _ in cells], [v for _, v in cells]))
    return spark.createDataFrame(rows, "id long, features array<long>, values array<double>")


def read_matrix_market(spark: SparkSession, path: str) -> DataFrame:
    """The row layout of a coordinate file, 1-based in the file and 0-based here: real,
    integer or pattern, and general, symmetric or skew-symmetric (the other half is
    filled in). Anything else, array and complex files among it, is a ValueError. The
    line of sizes is the first that is no comment."""
    text = spark.read.text(path).where("trim(value) <> ''")
    header = text.where("lower(value) like '!%!%matrixmarket%' escape '!'").first()
    kind = header["value"].lower().split()[1:] if header else ["matrix", "coordinate", "real", "general"]
    if len(kind) != 4 or kind[:2] != ["matrix", "coordinate"] or kind[2] not in ("real", "integer", "pattern") or kind[3] not in ("general", "symmetric", "skew-symmetric"):
        raise ValueError(f"no coordinate file of real numbers: {' '.join(kind)}")
    numbered = text.where("value not like '!%%' escape '!'").withColumn("n", F.monotonically_increasing_id())
    cells = numbered.where(F.col("n") > numbered.agg(F.min("n")).scalar())
    parts = F.split(F.trim("value"), r"\s+")
    value = F.when(F.size(parts) > 2, F.get(parts, F.lit(2))).otherwise("1").cast("double")
    cells = cells.select((parts[0].cast("long") - 1).alias("id"), (parts[1].cast("long") - 1).alias("f"), value.alias("v"))
    if kind[3] != "general":
        sign = 1 if kind[3] == "symmetric" else -1
        cells = cells.unionByName(cells.where("id <> f").select(F.col("f").alias("id"), F.col("id").alias("f"), (F.col("v") * sign).alias("v")))
    return from_long(cells)


def read_npz(spark: SparkSession, path: str) -> DataFrame:
    """The row layout of one .npz file of a sparse matrix: csr (taken for granted where
    the file names no format), csc or coo. Other formats, and several files, whose rows
    would share ids, are a ValueError."""
    files = spark.read.format("binaryFile").load(path)
    if files.count() != 1:
        raise ValueError(f"not one file: {path}")

    def rows(batches):
        for b in batches:
            for raw in b.column("content").to_pylist():
                with zipfile.ZipFile(io.BytesIO(raw)) as z:
                    held = {n[:-4]: np.lib.format.read_array(io.BytesIO(z.read(n))) for n in z.namelist()}
                form = held.get("format", np.array(b"csr")).item()
                form = form.decode() if isinstance(form, bytes) else form
                if form == "coo":
                    ids, features = held["row"], held["col"]
                elif form in ("csr", "csc"):
                    major = np.repeat(np.arange(len(held["indptr"]) - 1), np.diff(held["indptr"]))
                    ids, features = (major, held["indices"]) if form == "csr" else (held["indices"], major)
                else:
                    raise ValueError(f"no such format: {form}")
                yield pa.RecordBatch.from_arrays([pa.array(ids.astype(np.int64)), pa.array(features.astype(np.int64)), pa.array(held["data"].astype(np.float64))], names=["id", "f", "v"])

    return from_long(files.select("content").mapInArrow(rows, "id long, f long, v double"))
