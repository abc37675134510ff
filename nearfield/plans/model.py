"""The models: fitted rows, their signatures and index, and the ways to query them."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from nearfield.operators import candidates as cand
from nearfield.operators import exact, graph, index
from nearfield.operators.signature import long_signatures, signatures, slots
from nearfield.plans.presets import DEFAULTS, INERT, PRESETS


class _Hash:
    algorithm = "minhash"
    extra: dict = {}

    def __init__(self, *, speed_optimized: bool | None = None, accuracy_optimized: bool | None = None, precision: int | None = None, **options):
        """Options are those of ``DEFAULTS``; ``precision`` rounds exact measures, which
        makes ranks independent of the order of sums."""
        known = DEFAULTS | self.extra
        unknown = [o for o in options if o not in known and o not in INERT]
        if unknown:
            raise TypeError(f"unknown options: {unknown}")
        if speed_optimized and accuracy_optimized:
            raise ValueError("speed_optimized and accuracy_optimized exclude each other")
        preset = PRESETS[self.algorithm, "speed" if speed_optimized else "accuracy"] if speed_optimized or accuracy_optimized else {}
        given = {o: v for o, v in options.items() if v is not None and o in known}
        self.params = known | given | {o: v for o, v in preset.items() if o in known}
        self.precision = precision
        self.rows: DataFrame | None = None
        self.signed: DataFrame | None = None
        self._index: DataFrame | None = None

    # fitting

    def _sign(self, rows: DataFrame) -> DataFrame:
        p = self.params
        return signatures(rows, p["number_of_hash_functions"], algorithm=self.algorithm, range_k=p.get("rangeK_wta", 20), block_size=p["block_size"], shingle=p["shingle"], shingle_size=p["shingle_size"])

    @property
    def n_slots(self) -> int:
        p = self.params
        return slots(p["number_of_hash_functions"], p["block_size"], p["shingle"], p["shingle_size"])[1]

    def fit(self, X: DataFrame, y=None):
        """``X`` is (id, features, values). Fitting again replaces what was fitted. The
        signatures and the index are kept by the executors until close()."""
        self.close()
        self.rows = X.select("id", "features", "values").persist()
        self.signed = self._sign(self.rows).persist()
        return self

    def partial_fit(self, X: DataFrame, y=None):
        """Adds rows with ids of their own; caps and pruning hold for all rows."""
        if self.rows is None:
            return self.fit(X)
        old = [self.rows, self.signed, self._index]
        self.rows = self.rows.unionByName(X.select("id", "features", "values")).persist()
        self.signed = self.signed.unionByName(self._sign(X)).persist()
        self._index = None
        self._old = [*getattr(self, "_old", []), *[d for d in old if d is not None]]
        return self

    def close(self) -> None:
        for d in (self.rows, self.signed, self._index, *getattr(self, "_old", [])):
            if d is not None:
                d.unpersist()
        self.rows = self.signed = self._index = None
        self._old = []

    @property
    def index(self) -> DataFrame:
        if self._index is None:
            p = self.params
            self._index = index.build_index(
                long_signatures(self.signed), p["max_bin_size"], prune=p["prune_inverse_index"], less_entries=p["remove_hash_function_with_less_entries_as"], least_significant_bits=p["store_value_with_least_sigificant_bit"]
            ).persist()
        return self._index

    def get_distribution_of_inverse_index(self) -> tuple[DataFrame, DataFrame, DataFrame]:
        return index.distribution(self.index)

    # querying

    def _collisions(self, X: DataFrame | None) -> DataFrame:
        queries = None if X is None else long_signatures(self._sign(X))
        return cand.collisions(self.index, queries, self.params["minimal_blocks_in_common"])

    def _ranked(self, X: DataFrame | None, n: int, least: int = 1) -> DataFrame:
        queries = None if X is None else long_signatures(self._sign(X))
        return cand.ranked(self.index, n, queries, max(least, self.params["minimal_blocks_in_common"]))

    def _chosen(self, options: dict) -> dict:
        return {k: self.params[k] if v is None else v for k, v in options.items()}

    def _found(self, X, k, fast, similarity, absolute):
        if fast:
            distance = cand.fast_distance(self.n_slots, absolute)
            return self._ranked(X, k).select("id", "rank", "neighbor_id", distance.alias("distance"))
        excess = self.params["excess_factor"]
        top = self._ranked(X, k * excess).select("id", "neighbor_id")
        own = None if X is None else self._ranked(None, k * excess).select("id", "neighbor_id")
        queries = self.rows if X is None else X.select("id", "features", "values")
        return exact.refined(top, k, excess, queries, self.rows, similarity, own, precision=self.precision).select("id", "rank", "neighbor_id", "distance")

    def kneighbors(self, X: DataFrame | None = None, n_neighbors: int | None = None, return_distance: bool = True, fast: bool | None = None, similarity: bool | None = None, pAbsoluteNumbers: bool | None = None) -> DataFrame:
        """(id, rank, neighbor_id[, distance]); without ``X`` the fitted rows query, and
        no row is its own neighbour. ``fast`` ranks by collisions alone."""
        c = self._chosen({"n_neighbors": n_neighbors, "fast": fast, "similarity": similarity, "absolute_numbers": pAbsoluteNumbers})
        out = self._found(X, c["n_neighbors"], c["fast"], c["similarity"], c["absolute_numbers"])
        return out if return_distance else out.drop("distance")

    def radius_neighbors(self, X: DataFrame | None = None, radius: float | None = None, return_distance: bool = True, fast: bool | None = None, similarity: bool | None = None, pAbsoluteNumbers: bool | None = None) -> DataFrame:
        """All candidates within ``radius``; for cosine one minus it counts."""
        c = self._chosen({"radius": radius, "fast": fast, "similarity": similarity, "absolute_numbers": pAbsoluteNumbers})
        if c["absolute_numbers"]:
            raise ValueError("a radius has no meaning for absolute numbers of collisions")
        if c["fast"]:
            # so many collisions are within the radius, and more of them are nearer
            least = next((n for n in range(1, self.n_slots + 1) if 1 - n / self.n_slots <= c["radius"]), self.n_slots + 1)
            out = self._ranked(X, 2**31 - 1, least).withColumn("distance", cand.fast_distance(self.n_slots))
        elif X is None:
            out = exact.within(self.index, self.rows, c["radius"], c["similarity"], self.params["minimal_blocks_in_common"], self.precision)
        else:
            queries = X.select("id", "features", "values")
            all_ = exact.measured(self._collisions(X).select("id", "neighbor_id"), queries, self.rows, c["similarity"], self.precision)
            within = all_.where((1 - F.col("distance") if c["similarity"] else F.col("distance")) <= c["radius"])
            out = exact.nearest(within, 2**31 - 1, c["similarity"])
        out = out.select("id", "rank", "neighbor_id", "distance")
        return out if return_distance else out.drop("distance")

    def kneighbors_graph(self, X: DataFrame | None = None, n_neighbors: int | None = None, mode: str = "connectivity", fast: bool | None = None, symmetric: bool = True, similarity: bool | None = None, pAbsoluteNumbers: bool | None = None, include_self: bool = False) -> DataFrame:
        found = self.kneighbors(X, n_neighbors, True, fast, similarity, pAbsoluteNumbers)
        return graph.graph(found, mode, symmetric and X is None, include_self)

    def radius_neighbors_graph(self, X: DataFrame | None = None, radius: float | None = None, mode: str = "connectivity", fast: bool | None = None, symmetric: bool = True, similarity: bool | None = None, pAbsoluteNumbers: bool | None = None, include_self: bool = False) -> DataFrame:
        found = self.radius_neighbors(X, radius, True, fast, similarity, pAbsoluteNumbers)
        return graph.graph(found, mode, symmetric and X is None, include_self)

    def fit_kneighbors(self, X: DataFrame, *args, **options) -> DataFrame:
        return self.fit(X).kneighbors(None, *args, **options)

    def fit_kneighbor_graph(self, X: DataFrame, *args, **options) -> DataFrame:
        return self.fit(X).kneighbors_graph(None, *args, **options)

    fit_kneighbors_graph = fit_kneighbor_graph

    def fit_radius_neighbors(self, X: DataFrame, *args, **options) -> DataFrame:
        return self.fit(X).radius_neighbors(None, *args, **options)

    def fit_radius_neighbors_graph(self, X: DataFrame, *args, **options) -> DataFrame:
        return self.fit(X).radius_neighbors_graph(None, *args, **options)

    # keeping

    def save(self, path: str) -> None:
        spark = self.rows.sparkSession
        self.rows.write.mode("overwrite").parquet(f"{path}/rows")
        self.signed.write.mode("overwrite").parquet(f"{path}/signatures")
        state = json.dumps({"algorithm": self.algorithm, "params": self.params, "precision": self.precision})
        spark.createDataFrame([(state,)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/params")

    @classmethod
    def load(cls, spark: SparkSession, path: str):
        state = json.loads(spark.read.text(f"{path}/params").first()["value"])
        if state["algorithm"] != cls.algorithm:
            raise ValueError(f"the model at {path} is a {state['algorithm']} model")
        model = cls(precision=state["precision"], **state["params"])
        model.rows, model.signed = spark.read.parquet(f"{path}/rows"), spark.read.parquet(f"{path}/signatures")
        return model


class MinHash(_Hash):
    """Neighbours by MinHash signatures of the features present."""


class WtaHash(_Hash):
    """Neighbours by winner-takes-all signatures, which follow the order of values."""

    algorithm = "wta"
    extra = {"rangeK_wta": 20}
