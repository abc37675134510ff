import numpy as np
from hypothesis import given
from hypothesis import strategies as st
from pyspark.sql import functions as F

from nearfield.functions.hashing import fingerprint, hash32, hash32_array

GOLDEN = [(1, 1, 316017654), (2, 1, 632037349), (6, 1, 1896154809), (1, 42, 2006371508), (101, 43, 3637504954), (2147483648, 3, 1699865937), (123456789, 987654321, 1845985385), (4294967295, 4294967295, 316017654)]
M = 2**32 - 1


def plain(key, seed):
    k = key * seed & M
    k = (~k + (k << 15)) & M
    k ^= k >> 12
    k = k + (k << 2) & M
    k ^= k >> 4
    k = k * 2057 & M
    return k ^ k >> 16


def test_golden_arrays():
    for key, seed, h in GOLDEN:
        assert plain(key, seed) == h == int(hash32_array(np.array([key], dtype=np.uint32), seed)[0])


def test_golden_columns(spark):
    df = spark.createDataFrame(GOLDEN, "k long, s long, h long")
    assert df.where(hash32(F.col("k"), F.col("s")) != F.col("h")).count() == 0
    assert df.where("s = 42").select(hash32(F.col("k"), 42).alias("h")).first()["h"] == 2006371508


@given(st.lists(st.integers(0, M), min_size=1, max_size=20), st.integers(0, M))
def test_arrays_are_plain(keys, seed):
    assert hash32_array(np.array(keys, dtype=np.uint32), seed).tolist() == [plain(k, seed) for k in keys]


def test_fingerprint(spark):
    lists = [[], [0], [0, 5, 2**31 - 1], None]
    got = spark.createDataFrame([(i, x) for i, x in enumerate(lists)], "i int, f array<long>").select("i", fingerprint(F.col("f")).alias("p")).collect()

    def fold(x):
        s = 0
        for f in x:
            s = plain(f + 1, s + 1 & M)
        return s

    assert {r["i"]: r["p"] for r in got} == {i: None if x is None else fold(x) for i, x in enumerate(lists)}
