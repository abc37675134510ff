import pytest
from pyspark.sql import functions as F

from nearfield import MinHash, MinHashClassifier, WtaHash
from nearfield.operators.classify import majority, probabilities, votes
from nearfield.operators.cluster import dbscan
from nearfield.operators.components import components
from nearfield.operators.graph import as_arrays
from nearfield.plans.presets import PRESETS
from nearfield.sources import datasets
from tests.conftest import SF


@pytest.fixture(scope="module")
def rows(spark):
    return datasets.baskets(spark, SF).persist()


def model(**options):
    return MinHash(**{"number_of_hash_functions": 16, "precision": 6, **options})


def as_set(df):
    return {tuple(r) for r in df.collect()}


def test_presets_and_options():
    assert MinHash(speed_optimized=True).params["number_of_hash_functions"] == 200
    assert WtaHash(accuracy_optimized=True).params["rangeK_wta"] == PRESETS["wta", "accuracy"]["rangeK_wta"] == 23
    assert MinHash(speed_optimized=True).n_slots == 200 and MinHash().n_slots == 400
    assert MinHash(number_of_cores=4, chunk_size=3).params == MinHash().params
    with pytest.raises(ValueError):
        MinHash(speed_optimized=True, accuracy_optimized=True)
    with pytest.raises(TypeError):
        MinHash(no_such_option=1)


def test_fit_replaces_and_partial_fit_adds(rows):
    even, odd = rows.where("id % 2 = 0"), rows.where("id % 2 = 1")
    whole = as_set(model().fit(rows).kneighbors())
    assert as_set(model().fit(odd).fit(rows).kneighbors()) == whole
    assert as_set(model().fit(even).partial_fit(odd).kneighbors()) == whole
    assert as_set(model().partial_fit(rows).kneighbors()) == whole
    assert as_set(model().fit_kneighbors(rows)) == whole


def test_fast_distances_and_self(rows):
    found = model().fit(rows).kneighbors(fast=True)
    assert found.where("id = neighbor_id or distance < 0 or distance >= 1").count() == 0
    plain = model().fit(rows).kneighbors(fast=True, return_distance=False)
    assert plain.columns == ["id", "rank", "neighbor_id"]


def test_symmetric_graph_is_its_transpose(rows):
    m = model().fit(rows)
    for edges in (m.kneighbors_graph(mode="distance"), m.radius_neighbors_graph(radius=0.9, fast=True, mode="distance")):
        assert as_set(edges) == as_set(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "weight"))
    assert m.kneighbors_graph(fast=True, include_self=True).where("src = dst").count() > 0
    with pytest.raises(ValueError):
        m.kneighbors_graph(mode="other")
    with pytest.raises(ValueError):
        m.radius_neighbors(pAbsoluteNumbers=True)


def test_the_fit_variants_agree(rows):
    m = model().fit(rows)
    assert as_set(model().fit_kneighbor_graph(rows, fast=True)) == as_set(m.kneighbors_graph(fast=True))
    assert as_set(model().fit_radius_neighbors(rows, radius=0.8, fast=True)) == as_set(m.radius_neighbors(radius=0.8, fast=True))
    assert as_set(model().fit_radius_neighbors_graph(rows, radius=0.8, fast=True)) == as_set(m.radius_neighbors_graph(radius=0.8, fast=True))


def test_save_and_load(spark, rows, tmp_path):
    m = model(n_neighbors=3).fit(rows)
    m.save(str(tmp_path / "m"))
    assert as_set(MinHash.load(spark, str(tmp_path / "m")).kneighbors(fast=True)) == as_set(m.kneighbors(fast=True))
    with pytest.raises(ValueError):
        WtaHash.load(spark, str(tmp_path / "m"))


def test_arrays_are_filled(spark):
    ids = spark.createDataFrame([(1,), (2,)], "id long")
    found = spark.createDataFrame([(1, 2, 7, 0.5), (1, 1, 9, 0.25)], "id long, rank int, neighbor_id long, distance double")
    assert as_set(as_arrays(found, ids, 3).select("id", F.col("neighbors").cast("string"), F.col("distances").cast("string"))) == {(1, "[9, 7, -1]", "[0.25, 0.5, 0.0]"), (2, "[-1, -1, -1]", "[0.0, 0.0, 0.0]")}
    assert [len(r["neighbors"]) for r in as_arrays(found, ids).orderBy("id").collect()] == [2, 0]


def test_votes_ties_and_rows_without_neighbours(spark):
    ids = spark.createDataFrame([(1,), (2,), (3,)], "id long")
    found = spark.createDataFrame([(1, 10), (1, 11), (2, 10), (2, 12)], "id long, neighbor_id long")
    labels = spark.createDataFrame([(10, 5), (11, 4), (12, 5), (13, None)], "id long, label int")
    v = votes(found, labels)
    assert as_set(majority(v, ids)) == {(1, 4), (2, 5), (3, -1)}
    assert as_set(probabilities(v, ids, [4, 5])) == {(1, 0.5, 0.5), (2, 0.0, 1.0), (3, 0.0, 0.0)}


def test_classifier(spark, rows):
    labels = rows.select("id", (F.col("id") % 3).alias("label"))
    m = MinHashClassifier(fast=True, number_of_hash_functions=16).fit(rows.where("id % 2 = 0"), labels.where("id % 2 = 0"))
    m.partial_fit(rows.where("id % 2 = 1"), labels.where("id % 2 = 1"))
    assert m.predict(rows.where("id < 40")).count() == rows.where("id < 40").count()
    assert 0 <= m.score(rows.where("id < 40"), labels) <= 1
    assert m.predict_proba(rows.where("id < 40")).columns == ["id", "p_0", "p_1", "p_2"]


def test_a_classifier_of_several_outputs(spark, rows):
    both = rows.select("id", (F.col("id") % 3).alias("a"), (F.col("id") % 2).alias("b"))
    m = MinHashClassifier(fast=True, number_of_hash_functions=16).fit(rows, both)
    got = m.predict()
    assert got.columns == ["id", "a", "b"]
    for c in "ab":
        one = MinHashClassifier(fast=True, number_of_hash_functions=16).fit(rows, both.select("id", F.col(c).alias("label")))
        assert as_set(got.select("id", c)) == as_set(one.predict())
    truth, found = {r["id"]: (r["a"], r["b"]) for r in both.collect()}, {r["id"]: (r["a"], r["b"]) for r in got.collect()}
    assert abs(m.score(rows.where("id < 50"), both) - sum(m_ == truth[i] for i, m_ in {r["id"]: (r["a"], r["b"]) for r in m.predict(rows.where("id < 50")).collect()}.items()) / rows.where("id < 50").count()) < 1e-9
    assert m.predict_proba().columns == ["id", "a_p_0", "a_p_1", "a_p_2", "b_p_0", "b_p_1"] and len(found) == len(truth)


def test_principal_components_are_those_of_the_covariance(spark):
    import numpy as np
    from pyspark.ml.linalg import Vectors

    from nearfield.operators.cluster import reduced

    r = np.random.default_rng(4)
    x = r.standard_normal((80, 12)) @ np.diag([9, 6, 4, 1, *[0.2] * 8]) + 3
    x[np.abs(x) < 0.5] = 0
    df = spark.createDataFrame([(i, Vectors.sparse(12, [(j, v) for j, v in enumerate(row) if v]) if i % 2 else Vectors.dense(row)) for i, row in enumerate(x)], ["id", "features"])
    got = np.array([row["features"].toArray() for row in reduced(df, 3).orderBy("id").collect()])
    u, s, _ = np.linalg.svd(x - x.mean(axis=0), full_matrices=False)
    assert np.allclose(np.abs(got), np.abs(u[:, :3] * s[:3]), atol=1e-3)
    assert len(reduced(df, None).first()["features"]) == 12


def test_clustering_takes_the_options_of_embeddings(spark, rows):
    from pyspark.ml.clustering import KMeans

    from nearfield import MinHashClustering

    few = rows.where("id < 60")
    c = MinHashClustering(model(fast=True), KMeans(k=3, seed=1, maxIter=3))
    for options in ({"pUmap": False, "pUmapDict": None}, {"pPca": True, "pPcaDimensions": None, "pUmap": False}, {"pSaveMemory": 0.1, "pPca": True, "pPcaDimensions": 4}):
        assert c.fit_predict(few, None, **options).count() == few.count() == c.predict(few, None, **options).count()
    with pytest.raises(ValueError):
        c.fit(few, pUmap=True)
    assert c.fit_predict(few, pUmap=True, pUmapDict={"n": 1}, transform=lambda f, n: f).where("label is null").count() == 0


def test_components_of_chains_and_rings(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 101), (101, 102), (102, 100), (7, 7), (200, 5)] + [(1000, n) for n in range(900, 960)]
    got = {r["node"]: r["component"] for r in components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert {got[i] for i in range(41)} == {0} and got[200] == 0 and {got[i] for i in (100, 101, 102)} == {100} and got[1000] == got[959] == 900
    assert components(spark.createDataFrame([], "u long, v long")).count() == 0


def test_dbscan_against_plain(spark):
    import random

    random.seed(3)
    points = {i: random.choice((0, 10, 30)) + random.random() * 3 for i in range(60)}
    edges = [(a, b, abs(points[a] - points[b])) for a in points for b in points if a != b]
    eps, least = 0.25, 4
    near = {a: {b for x, b, w in edges if x == a and w <= eps} for a in points}
    core = {a for a in points if len(near[a]) + 1 >= least}
    label = {a: a for a in core}
    changed = True
    while changed:
        changed = False
        for a in core:
            low = min([label[a], *(label[b] for b in near[a] & core)])
            changed |= low < label[a]
            label[a] = low
    want = {a: label.get(a, min((label[b] for b in near[a] & core), default=-1)) for a in points}
    got = dbscan(spark.createDataFrame(edges, "src long, dst long, weight double"), spark.createDataFrame([(a,) for a in points], "id long"), eps, least)
    assert {r["id"]: r["label"] for r in got.collect()} == want


def test_power_iteration_against_plain(spark):
    """Clusters are intervals of the vector that plain power iteration ends with."""
    import numpy as np

    from nearfield.operators.cluster import power_iteration

    r = np.random.default_rng(5)
    n, k, rounds = 48, 3, 6
    w = np.triu(r.random((n, n)) * (r.random((n, n)) < 0.3), 1)
    for at, size in ((0, 8), (8, 16), (24, 24)):  # dense groups of several sizes
        w[at : at + size, at : at + size] = np.triu(r.random((size, size)), 1) * size
    w += w.T
    edges = [(int(a), int(b), float(w[a, b])) for a, b in zip(*np.nonzero(w))]
    degree = w.sum(axis=1)
    v = degree / degree.sum()
    for _ in range(rounds):
        v = (w / degree[:, None]) @ v
        v /= np.abs(v).sum()
    got = {row["id"]: row["label"] for row in power_iteration(spark.createDataFrame(edges, "src long, dst long, weight double"), k, rounds).collect()}
    assert set(got) == set(range(n)) and set(got.values()) == set(range(k))
    labels = [got[int(i)] for i in np.argsort(v)]
    assert sum(a != b for a, b in zip(labels, labels[1:])) == k - 1


def test_rows_held_and_rows_joined_agree(spark, rows, monkeypatch):
    from nearfield.operators import exact
    from nearfield.sources.rows import to_long

    pairs = model().fit(rows).kneighbors(fast=True).select("id", "neighbor_id").unionByName(spark.createDataFrame([(1, 10**9), (10**9, 1)], "id long, neighbor_id long"))
    queries = rows.where("id % 5 = 0")
    held = as_set(exact.dot_products(pairs, rows, rows)), as_set(exact.dot_products(pairs, queries, rows)), as_set(exact.exact_neighbors(rows, 4, queries, precision=6))
    monkeypatch.setattr(exact, "MOST_CELLS", exact._cells(queries) // 2)  # blocks of queries
    blocks = as_set(exact.exact_neighbors(rows, 4, queries, precision=6))
    monkeypatch.setattr(exact, "MOST_CELLS", 0)
    joined = as_set(exact.dot_products(pairs, rows, rows)), as_set(exact.dot_products(pairs, queries, rows)), blocks
    assert held == joined and all(held)
    named = [d.withColumn("id", F.lpad(F.col("id").cast("string"), 9, "0")) for d in (rows, queries)]
    by_features = exact.exact_neighbors(named[0], 4, named[1], precision=6)
    assert held[2] == as_set(by_features.withColumn("id", F.col("id").cast("long")).withColumn("neighbor_id", F.col("neighbor_id").cast("long")))
    a = {(r["id"], r["f"]): r["v"] for r in to_long(rows).collect()}
    want = {}
    for i, n, *_ in held[0]:
        want[i, n] = sum(v * a.get((n, f), 0.0) for (r, f), v in a.items() if r == i)
    assert all(abs(xy - want[i, n]) < 1e-6 for i, n, _, _, xy in held[0])
    none = rows.where("1 = 0")
    assert exact.dot_products(pairs, none, none).count() == 0


def test_rows_travel_as_bytes_without_loss(spark):
    """A cell of small whole numbers takes 2 to 4 bytes, not 16; any other is exact."""
    from nearfield.operators import exact

    made = [
        (1, [0, 7, 255], [1.0, 255.0, 3.0]), (2, [3, 70000], [256.0, 65535.0]), (3, [2**24, 2**31 - 1], [0.5, -2.0]), (4, [300], [0.1]), (5, [], []),
        (6, [1, 2], [float("inf"), 1e300]), (7, [5], [-1.0]), (8, [9], [65536.0]),
    ]
    packed = exact._packed(spark.createDataFrame(made, "id long, features array<long>, values array<double>").coalesce(1)).toArrow().combine_chunks().to_batches()[0]
    sizes, f, v = exact._unpacked(packed.column("cells"))
    assert packed.column("id").to_pylist() == [m[0] for m in made] and sizes.tolist() == [len(m[1]) for m in made]
    assert f.tolist() == [x for m in made for x in m[1]] and v.tolist() == [x for m in made for x in m[2]]
    assert [len(c) for c in packed.column("cells").to_pylist()] == [1 + 3 * 2, 1 + 2 * 5, 1 + 2 * 8, 1 + 10, 1, 1 + 2 * 9, 1 + 5, 1 + 5]


def test_round_one_is_measured_once(rows, monkeypatch):
    """It is read three times, and was made anew for each."""
    from nearfield.operators import exact

    written = []
    monkeypatch.setattr(exact, "materialize", lambda df: written.append(df) or df.persist())
    found = model().fit(rows).kneighbors()
    assert len(written) == 1 and written[0].columns == ["id", "neighbor_id", "distance", "rank"]
    assert found.count() > 0
    written[0].unpersist()


def test_no_row_goes_to_the_driver(rows, monkeypatch):
    from nearfield.operators import exact

    monkeypatch.setattr(exact, "_Table", None)  # rows that the driver collects
    pairs = model().fit(rows).kneighbors(fast=True)
    assert exact.dot_products(pairs, rows, rows).count() == pairs.count()


def test_pairs_of_unknown_ids_and_slices_of_a_group(spark, monkeypatch):
    """An id without a row has no measures, wherever it comes among the others; a group
    of partners that is cut into slices is matched as a whole one."""
    from nearfield.operators import exact

    made = spark.createDataFrame([(i, [0, i, 1000], [1.0, 2.0, float(i)]) for i in range(2, 40)], "id long, features array<long>, values array<double>").coalesce(1)
    pairs = spark.createDataFrame([(a, b) for a in (1, 2, 5, 30, 41, 99) for b in (1, 3, 30, 39, 77)], "id long, neighbor_id long")
    want = {(a, b, 1.0 + 4 + a * a, 1.0 + 4 + b * b, 1.0 + a * b + (4.0 if a == b else 0.0)) for a in (2, 5, 30) for b in (3, 30, 39)}
    assert as_set(exact.dot_products(pairs, made, made)) == want
    monkeypatch.setattr(exact, "_PIECE", 20)
    assert as_set(exact.dot_products(pairs, made, made)) == want


@pytest.mark.parametrize("far", [1, 2**50])
def test_collisions_are_ranked_as_by_window(spark, far):
    """Ties, a least number, ids far apart and below 0, queries, and groups that go on
    in the next batch; and no exchange of pairs."""
    import random

    from nearfield.operators import candidates as cand

    random.seed(8)
    cells = [((i - 30) * far, s, random.randrange(6)) for i in range(60) for s in range(8)]
    index = spark.createDataFrame(cells, "id long, slot int, val long").select("slot", "val", "id")
    asked = spark.createDataFrame([(i + 7, s, random.randrange(9)) for i in range(20) for s in range(8)], "id long, slot int, val long")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 7)
    try:
        for queries in (None, asked):
            for n, least, ties in ((3, 1, False), (3, 1, True), (2**31 - 1, 2, False), (4, 3, True)):
                want = cand.by_collisions(cand.collisions(index, queries, least), n, ties)
                got = cand.ranked(index, n, queries, least, ties)
                assert got.dtypes == want.dtypes and as_set(got) == as_set(want) and want.count()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    plan = cand.ranked(index, 3)._jdf.queryExecution().executedPlan().toString()
    assert "neighbor_id" not in "".join(x for x in plan.splitlines() if "Exchange" in x)
    named = index.withColumn("id", F.col("id").cast("string"))
    assert as_set(cand.ranked(named, 3)) == as_set(cand.by_collisions(cand.collisions(named), 3))
    assert cand.ranked(index.where("1 = 0"), 3).count() == 0


def test_a_fast_radius_counts_no_pair_twice(rows):
    m = model().fit(rows)
    every = m._collisions(None).select("id", "neighbor_id", (1 - F.col("cnt") / 16).alias("distance"))
    for radius in (0.8, 0.9375, 1.0, 0.0):
        got = m.radius_neighbors(radius=radius, fast=True)
        assert as_set(got.select("id", "neighbor_id", "distance")) == as_set(every.where(F.col("distance") <= radius))
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "Window" not in plan  # ranks come with the counts


def test_a_symmetric_graph_finds_its_edges_once(rows):
    edges = model().fit(rows).kneighbors_graph(fast=True)
    plan = edges._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("MapInArrow counted(") == 1 and "Union" not in plan


def test_a_radius_is_measured_in_the_buckets(spark, rows, monkeypatch):
    """All pairs within the radius, once each, ranked; with a least number of common
    buckets too; and a row goes to its buckets, not to each of its pairs."""
    from nearfield.operators import exact

    for least in (1, 2):
        m = model(minimal_blocks_in_common=least).fit(rows)
        for similarity, radius in ((False, 250.0), (True, 0.97), (False, 1e9), (True, -1.0)):
            pairs = exact.measured(m._collisions(None), m.rows, m.rows, similarity, 6)
            near = pairs.where((1 - F.col("distance") if similarity else F.col("distance")) <= radius)
            want = exact.nearest(near, 2**31 - 1, similarity).select("id", "rank", "neighbor_id", "distance")
            got = m.radius_neighbors(radius=radius, similarity=similarity)
            assert got.dtypes == want.dtypes and as_set(got) == as_set(want) and got.count() == want.count()
        assert want.count() == 0
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "neighbor_id" not in "".join(x for x in plan.splitlines() if "Exchange" in x and "cells" in x) and "Window" not in plan


def test_products_of_small_and_large_buckets_agree(monkeypatch):
    import numpy as np

    from nearfield.operators import exact

    r = np.random.default_rng(2)
    made = [(b, np.sort(r.choice(40, r.integers(1, 12), replace=False))) for b, n in enumerate((2, 9, 5, 30, 2)) for _ in range(n)]
    place, ends = np.array([b for b, _ in made]), np.cumsum([len(f) for _, f in made])
    f, v = np.concatenate([f for _, f in made]), r.standard_normal(ends[-1])
    dense = np.zeros((len(made), 40))
    dense[np.repeat(np.arange(len(made)), np.diff(ends, prepend=0)), f] = v
    want = {(i, j) for i in range(len(made)) for j in range(i + 1, len(made)) if place[i] == place[j]}
    for most in (8_000_000, 100, 1):
        monkeypatch.setattr(exact, "_MOST_PRODUCTS", most)
        got = {(int(i), int(j)): x for part in exact._products(place, ends, f, v) for i, j, x in zip(*part)}
        assert set(got) == want and all(abs(x - dense[i] @ dense[j]) < 1e-9 for (i, j), x in got.items())
        first = got if most == 8_000_000 else first
        assert got == first  # to the last bit


def test_principal_components_send_each_column_once(spark):
    """However many tasks the rows are dealt over."""
    from pyspark.ml.linalg import Vectors
    from pyspark.sql.classic.dataframe import DataFrame as Frame

    from nearfield.operators.cluster import reduced

    df = spark.createDataFrame([(i, Vectors.sparse(400, [(i % 400, 1.0), ((i * 7 + 1) % 400, 2.0)] if i % 400 != (i * 7 + 1) % 400 else [])) for i in range(400)], ["id", "features"])
    sent, plain = [], Frame.toLocalIterator

    def counted(self, *args):
        for row in plain(self, *args):
            sent.append(len(row["part"]))
            yield row

    Frame.toLocalIterator = counted
    try:
        got = {}
        for parts in (1, 16):
            sent.clear()
            got[parts] = {r["id"]: r["features"].toArray() for r in reduced(df.repartition(parts), 2).collect()}
            assert sum(sent) <= 8 * 400 * (12 * 5 + 1)
    finally:
        Frame.toLocalIterator = plain
    assert all(abs(got[1][i] - got[16][i]).max() < 1e-6 for i in got[1]) and len(got[1]) == 400


@pytest.mark.parametrize("similarity", [False, True])
def test_round_two_goes_through_neighbours(rows, similarity):
    """All pairs of a row and the neighbours of those it asks, with slices that cut a
    group; no row is dealt by pair."""
    from nearfield.operators import exact

    queries = rows.where("id % 3 = 0")
    for few in (rows, queries):
        known = model().fit(rows).kneighbors(fast=True).select("id", "neighbor_id")
        asked = known.join(few.select("id"), "id", "left_semi").select("id", F.col("neighbor_id").alias("via"))
        pairs = asked.join(known.select(F.col("id").alias("via"), "neighbor_id"), "via").select("id", "neighbor_id")
        want = exact.dot_products(pairs.distinct(), few, rows)
        for piece in (8_000_000, 2_000):
            exact._PIECE, kept = piece, exact._PIECE
            got = exact._through(asked, known, few, rows)
            exact._PIECE = kept
            assert got.count() == pairs.count() and as_set(got) == as_set(want)
    found = model().fit(rows).kneighbors(similarity=similarity)
    assert found.groupBy("id", "neighbor_id").count().where("count > 1").count() == 0 < found.count()


def test_truth_is_the_same_dense_sparse_and_in_blocks(spark, monkeypatch):
    """Whole numbers go through the dense product, others do not; ties that rounding
    makes are kept; and a row that falls behind those before it leaves no task."""
    import numpy as np

    from nearfield.operators import exact

    r = np.random.default_rng(6)
    made = [(i, sorted(int(f) for f in r.choice(30, 8, replace=False)), [float(x) for x in r.integers(1, 6, 8)]) for i in range(90)]
    for scale in (1.0, 0.37):
        df = spark.createDataFrame([(i, f, [x * scale for x in v]) for i, f, v in made], "id long, features array<long>, values array<double>").repartition(2)
        q = df.where("id % 4 = 0")
        for precision in (2, 6):
            pairs = q.select("id").crossJoin(df.select(F.col("id").alias("neighbor_id"))).where("id <> neighbor_id")
            every = exact.dot_products(pairs, q, df).where("xy <> 0")
            want = as_set(exact.nearest(every.select("id", "neighbor_id", F.round(exact.cosine(), precision).alias("distance")), 5, True))
            for dense in (512, 0):
                monkeypatch.setattr(exact, "_MOST_DENSE", dense)
                assert as_set(exact.exact_neighbors(df, 5, q, precision=precision)) == want
    sent = exact._against(df.coalesce(1), q, 5, 1e-6).count()
    assert q.count() * 5 <= sent
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 10)
    try:
        assert exact._against(df.coalesce(1), q, 5, 1e-6).count() < q.count() * 45  # not 5 of each batch of 10
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
