import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from nearfield import MinHash, WtaHash
from nearfield.operators.index import bucket_sizes, build_index, kept_buckets
from nearfield.operators.signature import _minhash, _shingled, _wta, long_signatures, minhash_sql, signatures, slots
from nearfield.sources.rows import from_long, to_long
from tests.test_hashing import plain

ROWS = "id long, features array<long>, values array<double>"


def rows(spark, lists):
    return spark.createDataFrame([(i, list(f), [float(1 + x % 7) for x in f]) for i, f in enumerate(lists)], ROWS)


features = st.sets(st.integers(0, 2**31 - 1), min_size=1, max_size=12).map(sorted)


@settings(max_examples=40, deadline=None)
@given(st.lists(features, min_size=1, max_size=5))
def test_minhash_is_argmin(lists):
    flat, at = np.concatenate([np.array(x) for x in lists]), np.cumsum([0] + [len(x) for x in lists[:-1]])
    got = _minhash(flat, at, 5)
    for j in range(5):
        assert got[j].tolist() == [min((plain(f + 1, j + 1), f) for f in x)[1] + 1 for x in lists]


@settings(max_examples=40, deadline=None)
@given(st.lists(features, min_size=1, max_size=5), st.integers(1, 6), st.randoms(use_true_random=False))
def test_wta_is_winner_among_least(lists, k, random):
    flat, sizes = np.concatenate([np.array(x) for x in lists]), np.array([len(x) for x in lists])
    values = np.array([random.choice([-1.0, 0.5, 2.0, 3.0]) for _ in flat])
    at = np.cumsum(sizes) - sizes
    got = _wta(flat, values, at, sizes, 3, k)
    for j in range(3):
        for i, x in enumerate(lists):
            least = sorted((plain(f + 1, 42 + j), values[at[i] + n]) for n, f in enumerate(x))[:k]
            best = max(((v, -h) for h, v in least if v > 0), default=None)
            assert got[j, i] == (0 if best is None else -best[1])


def test_shingles_have_a_short_last_block():
    raw = np.array([[3], [4], [5], [6], [7]])
    got = _shingled(raw, 2)
    assert got[:, 0].tolist() == [plain(5, 4), plain(7, 6), 7]
    assert slots(10, 2, 1, 3) == (20, 7) and slots(10, 5, 0, 4) == (10, 10)


def test_edge_rows(spark):
    df = rows(spark, [[], [0], [0], range(4), range(5), range(8), [2**31 - 1]])
    got = {r["id"]: r["signature"] for r in signatures(df, 16).collect()}
    assert 0 not in got
    assert got[1] == got[2] == [1] * 16
    assert set(got[5]) <= set(range(1, 9)) and got[6] == [2**31] * 16
    native = {(r["id"], r["slot"]): r["val"] for r in minhash_sql(df, 16).collect()}
    assert native == {(i, j): v for i, s in got.items() for j, v in enumerate(s)}


def test_wta_without_positive_values_has_no_entries(spark):
    df = spark.createDataFrame([(1, [3, 4], [-1.0, -2.0]), (2, [3, 4], [-1.0, -2.0])], ROWS)
    assert WtaHash(number_of_hash_functions=8).fit(df).index.count() == 0


def test_scaled_rows_collide_everywhere(spark):
    df = spark.createDataFrame([(1, [3, 9], [1.0, 2.0]), (2, [3, 9], [2.0, 4.0])], ROWS)
    model = MinHash(number_of_hash_functions=10, n_neighbors=1).fit(df)
    assert {r["distance"] for r in model.kneighbors(fast=True).collect()} == {0.0}
    assert [round(r["distance"], 9) for r in model.kneighbors(similarity=True).collect()] == [1.0, 1.0]
    assert [round(r["distance"], 9) for r in model.kneighbors().collect()] == [round(5**0.5, 9)] * 2


def test_cap_and_prune_borders(spark):
    sig = spark.createDataFrame([(i, 0, v) for v, n in ((7, 3), (8, 4), (9, 2)) for i in range(n)], "id long, slot int, val long")
    assert {r["val"] for r in build_index(sig, 4).collect()} == {7, 9}
    assert {r["val"] for r in build_index(sig, 5, prune=2).collect()} == {7, 8}


def test_slot_removal_keeps_all_when_none_is_left(spark):
    sig = spark.createDataFrame([(i, s, 5 + i) for s in range(3) for i in range(2)], "id long, slot int, val long")
    assert kept_buckets(bucket_sizes(sig), 50, less_entries=0).count() == 6
    assert kept_buckets(bucket_sizes(sig), 50, less_entries=3).count() == 0


def test_order_of_features_and_partitions_do_not_matter(spark):
    df = rows(spark, [[1, 5, 9], [2, 5, 70], [5, 9, 11, 12]])
    turned = spark.createDataFrame([(r["id"], r["features"][::-1], r["values"][::-1]) for r in df.collect()], ROWS).repartition(3)
    a, b = ({tuple(r) for r in long_signatures(signatures(x, 12)).collect()} for x in (df, turned))
    assert a == b


def test_long_rows_add_up_and_are_checked(spark):
    df = spark.createDataFrame([(1, 5, 2.0), (1, 5, 3.0), (1, 2, 0.0), (1, 4, 1.0), (None, 4, 1.0)], "id long, f long, v double")
    assert [tuple(r) for r in from_long(df).collect()] == [(1, [4, 5], [1.0, 5.0])]
    assert {tuple(r) for r in to_long(from_long(df)).collect()} == {(1, 4, 1.0), (1, 5, 5.0)}
    with pytest.raises(Exception, match="out of range"):
        from_long(spark.createDataFrame([(1, 2**31, 1.0)], "id long, f long, v double")).collect()
    assert from_long(spark.createDataFrame([(1, 2**31 - 1, 1.0)], "id long, f long, v double")).count() == 1
