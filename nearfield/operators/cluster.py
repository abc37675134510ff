"""Clustering over the graph of neighbours."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.ml.clustering import PowerIterationClustering
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

from nearfield.operators.components import components
from nearfield.plans.model import MinHash
from nearfield.sources.shared import materialize


def dbscan(edges: DataFrame, ids: DataFrame, eps: float = 0.5, min_samples: int = 5) -> DataFrame:
    """(id, label): density clusters over symmetric edges (src, dst, weight). A core has
    ``min_samples`` rows within ``eps``, itself included; connected cores are a cluster,
    named by its smallest core; another row joins its smallest adjacent cluster; the
    rest have -1."""
    close = materialize(edges.where((F.col("weight") <= eps) & (F.col("src") != F.col("dst"))).select("src", "dst").distinct())
    degree = close.groupBy("src").agg((F.count("*") + 1).alias("n")).where(F.col("n") >= min_samples)
    core = ids.select("id") if min_samples <= 1 else degree.select(F.col("src").alias("id"))
    core = materialize(core)
    among = close.join(core, F.col("src") == F.col("id"), "left_semi").join(core, F.col("dst") == F.col("id"), "left_semi")
    named = core.join(components(among.select(F.col("src").alias("u"), F.col("dst").alias("v"))).withColumnRenamed("node", "id"), "id", "left")
    named = materialize(named.select("id", F.coalesce("component", "id").alias("label")))
    border = close.join(named, F.col("dst") == F.col("id")).groupBy("src").agg(F.min("label").alias("near"))
    out = ids.select("id").join(named, "id", "left").join(border, F.col("id") == F.col("src"), "left")
    return out.select("id", F.coalesce("label", "near", F.lit(-1)).cast("long").alias("label"))


def power_iteration(edges: DataFrame, n_clusters: int, iterations: int = 20) -> DataFrame:
    """(id, label) by power iteration, a spectral method, on an affinity graph."""
    half = edges.where("src < dst and weight > 0").withColumn("weight", F.col("weight").cast("double"))
    pic = PowerIterationClustering(k=n_clusters, maxIter=iterations, weightCol="weight", initMode="degree")
    return pic.assignClusters(half.select("src", "dst", "weight")).select("id", F.col("cluster").alias("label"))


def graph_features(edges: DataFrame, ids: DataFrame) -> DataFrame:
    """(id, features): the row of each id in the graph as a sparse vector over the
    positions of the sorted ids."""
    from pyspark.ml.linalg import VectorUDT

    place = ids.select("id").distinct()
    ordered = materialize(place.repartitionByRange("id").sortWithinPartitions("id").withColumn("n", F.monotonically_increasing_id()))
    parts = ordered.withColumn("p", F.shiftright("n", 33)).groupBy("p").agg(F.count("*").alias("c")).collect()  # a row for each partition
    start, at = {}, 0
    for r in sorted(parts, key=lambda r: r["p"]):
        start[r["p"]] = at
        at += r["c"]
    size = at
    base = F.create_map(*[F.lit(x) for kv in start.items() for x in kv]) if start else F.create_map()
    position = ordered.select("id", (base[F.shiftright("n", 33)] + F.col("n").bitwiseAND(F.lit((1 << 33) - 1))).cast("int").alias("at"))
    cells = edges.join(position, F.col("dst") == F.col("id")).groupBy("src").agg(F.array_sort(F.collect_list(F.struct("at", "weight"))).alias("c"))

    def vectors(batches):
        kind = pa.struct([("type", pa.int8()), ("size", pa.int32()), ("indices", pa.list_(pa.int32())), ("values", pa.list_(pa.float64()))])
        for b in batches:
            held = [[(x["at"], float(x["weight"])) for x in c or []] for c in b.column("c").to_pylist()]
            made = [{"type": 0, "size": size, "indices": [i for i, _ in c], "values": [v for _, v in c]} for c in held]
            yield pa.RecordBatch.from_arrays([b.column("id"), pa.array(made, kind)], names=["id", "features"])

    every = ids.select("id").join(cells, F.col("id") == F.col("src"), "left").select("id", "c")
    return every.mapInArrow(vectors, StructType([every.schema["id"], StructField("features", VectorUDT())]))


def reduced(features: DataFrame, dimensions: int | None = None, seed: int = 7, rounds: int = 4) -> DataFrame:
    """(id, features): the first principal components of centred features (None: as
    many as there are columns, or rows), each up to its sign.

    The matrix is never made dense and no covariance is formed: a random block of
    ``dimensions`` + 10 columns is multiplied by the sparse rows and their transpose
    ``rounds`` times (subspace iteration), so that the driver holds columns x block
    numbers, and rows stay where they are."""
    from pyspark.ml.functions import array_to_vector

    features = features.select("id", "features").persist()
    n, head = features.count(), features.first()
    if head is None:
        return features
    columns = head["features"].size
    k = min(dimensions or columns, columns, n)
    block = min(k + 10, columns)
    basis = np.linalg.qr(np.random.Generator(np.random.PCG64(seed)).standard_normal((columns, block)))[0]

    def cells(batch):
        lists = batch.column("features")
        index, value = lists.field("indices"), lists.field("values")
        dense = np.array(lists.field("type").to_pylist()) == 1
        for r in range(batch.num_rows):
            v = value[r].values.to_numpy()
            yield np.arange(len(v)) if dense[r] else index[r].values.to_numpy(), v

    def gathered(at, parts):
        """The different columns among ``at``, and the sums of their ``parts``."""
        found, of = np.unique(at, return_inverse=True)
        return found, np.array([np.bincount(of, weights=p, minlength=len(found)) for p in parts.T]).T.reshape(len(found), parts.shape[1])

    def summed(held, width):
        """The sum over the rows of what is made of them, ``width`` numbers a column.
        A task sends the columns alone that its rows have, and those of one column are
        added up before the driver gets them, so it gets each number once."""
        shared = features.sparkSession.sparkContext.broadcast(held)
        made = lambda at, sums: pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array([r.tobytes() for r in sums], pa.binary())], names=["at", "part"])

        def add(batches):
            for b in batches:
                every = list(cells(b))
                if not every:
                    continue
                at = np.concatenate([i for i, _ in every])
                if shared.value is None:
                    parts = np.concatenate([v for _, v in every])[:, None]
                else:
                    parts = np.concatenate([v[:, None] * (v @ shared.value[0][i] - shared.value[1])[None, :] for i, v in every])
                yield made(*gathered(at, parts))

        def total(batches):
            at, sums = np.zeros(0, dtype=np.int32), np.zeros((0, width))
            for b in batches:
                new = np.frombuffer(b"".join(b.column("part").to_pylist())).reshape(-1, width)
                at, sums = gathered(np.concatenate((at, b.column("at").to_numpy())), np.concatenate((sums, new)))
            yield made(at, sums)

        schema = "at int, part binary"
        out = np.zeros((columns, width))
        for p in features.select("features").mapInArrow(add, schema).repartition("at").mapInArrow(total, schema).toLocalIterator():
            out[p["at"]] = np.frombuffer(bytes(p["part"]))
        return out

    mean = summed(None, 1)[:, 0] / n
    for _ in range(rounds):
        # X'X B of the centred X: its rows are x - mean, and sum to nothing
        basis = np.linalg.qr(summed((basis, mean @ basis), block))[0]
    spread = basis.T @ summed((basis, mean @ basis), block)
    values, turn = np.linalg.eigh((spread + spread.T) / 2)
    basis = basis @ turn[:, np.argsort(values)[::-1][:k]]
    shared, shift = features.sparkSession.sparkContext.broadcast(basis), mean @ basis

    def project(batches):
        for b in batches:
            made = [(v @ shared.value[i] - shift).tolist() for i, v in cells(b)]
            yield pa.RecordBatch.from_arrays([b.column("id"), pa.array(made, pa.list_(pa.float64()))], names=["id", "p"])

    return features.mapInArrow(project, f"id {dict(features.dtypes)['id']}, p array<double>").select("id", array_to_vector("p").alias("features"))


class MinHashClustering:
    """Any pyspark.ml estimator over the rows of the distance graph, with principal
    components or a transformation of one's own in between. ``labels_`` is (id, label)."""

    def __init__(self, minHashObject, clusteringObject, transform=None):
        self.model, self.estimator, self.transform = minHashObject, clusteringObject, transform
        self.labels_: DataFrame | None = None

    def fit(self, X: DataFrame, y=None, pSaveMemory: float | None = None, pPca: bool = False, pPcaDimensions: int | None = 300, pUmap: bool = False, pUmapDict: dict | None = None, transform=None):
        """``pSaveMemory`` is accepted and does nothing: rows are never held at once.
        ``transform`` takes and returns (id, features), for other embeddings; ``pUmap``
        needs one that takes ``pUmapDict`` as keywords, as no UMAP comes with this."""
        transform = transform or self.transform
        if pUmap and transform is None:
            raise ValueError("pUmap needs a transform: no UMAP comes with this package")
        self.model.fit(X)
        edges = self.model.kneighbors_graph(mode="distance")
        features = graph_features(edges, X)
        if pPca:
            features = reduced(features, pPcaDimensions)
        if transform:
            features = transform(features, **(pUmapDict or {})) if pUmap else transform(features)
        self.fitted = self.estimator.fit(features)
        self.labels_ = self.fitted.transform(features).select("id", F.col("prediction").alias("label"))
        return self

    def fit_predict(self, X: DataFrame, y=None, **options) -> DataFrame:
        return self.fit(X, y, **options).labels_

    def predict(self, X: DataFrame | None = None, y=None, **options) -> DataFrame:
        """The labels of the rows of the last fit; with options (see fit) ``X`` is
        fitted anew."""
        if X is None:
            return self.labels_
        return self.fit(X, y, **options).labels_ if options else X.select("id").join(self.labels_, "id", "left")


class MinHashDBSCAN:
    """Density clusters over the Euclidean graph of neighbours."""

    def __init__(self, eps: float = 0.5, min_samples: int = 5, n_neighbors: int = 5, **options):
        self.eps, self.min_samples = eps, min_samples
        self.model = MinHash(n_neighbors=n_neighbors, **options)
        self.labels_: DataFrame | None = None

    def fit(self, X: DataFrame, y=None, pSaveMemory: float | None = None):
        self.model.fit(X)
        edges = self.model.kneighbors_graph(mode="distance", symmetric=True, similarity=False)
        self.labels_ = dbscan(edges, X, self.eps, self.min_samples)
        return self

    def fit_predict(self, X: DataFrame, y=None, pSaveMemory: float | None = None) -> DataFrame:
        return self.fit(X, y, pSaveMemory).labels_


class MinHashSpectralClustering:
    """Power iteration over the cosine graph; rows without neighbours have label -1."""

    def __init__(self, n_clusters: int = 8, n_neighbors: int = 5, iterations: int = 20, **options):
        self.n_clusters, self.iterations = n_clusters, iterations
        self.model = MinHash(n_neighbors=n_neighbors, **options)
        self.labels_: DataFrame | None = None

    def fit(self, X: DataFrame, y=None, pSaveMemory: float | None = None):
        self.model.fit(X)
        edges = self.model.kneighbors_graph(mode="distance", symmetric=True, similarity=True)
        found = power_iteration(edges, self.n_clusters, self.iterations)
        self.labels_ = X.select("id").join(found, "id", "left").select("id", F.coalesce("label", F.lit(-1)).alias("label"))
        return self

    def fit_predict(self, X: DataFrame, y=None, pSaveMemory: float | None = None) -> DataFrame:
        return self.fit(X, y, pSaveMemory).labels_
