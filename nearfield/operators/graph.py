"""Graphs and array forms of neighbours."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def graph(neighbors: DataFrame, mode: str = "connectivity", symmetric: bool = True, include_self: bool = False, self_weight: float = 0.0) -> DataFrame:
    """Edges (src, dst, weight) from (id, neighbor_id, distance): weight 1 in mode
    connectivity, else the distance. Symmetric: both directions of every edge, with the
    mean weight where it was found from both sides."""
    if mode not in ("connectivity", "distance"):
        raise ValueError(f"mode is connectivity or distance, not {mode}")
    weight = F.lit(1.0) if mode == "connectivity" else F.col("distance").cast("double")
    edges = neighbors.select(F.col("id").alias("src"), F.col("neighbor_id").alias("dst"), weight.alias("weight"))
    if symmetric:
        # each edge twice where it is: a union would make the edges anew for each half
        turned = F.struct(F.col("dst").alias("src"), F.col("src").alias("dst"), "weight")
        both = edges.select(F.inline(F.array(F.struct("src", "dst", "weight"), turned)))
        edges = both.groupBy("src", "dst").agg(F.avg("weight").alias("weight"))
    if include_self:
        own = neighbors.select("id").distinct()
        edges = edges.unionByName(own.select(F.col("id").alias("src"), F.col("id").alias("dst"), F.lit(1.0 if mode == "connectivity" else self_weight).alias("weight")))
    return edges


def as_arrays(neighbors: DataFrame, ids: DataFrame, k: int | None = None) -> DataFrame:
    """(id, neighbors, distances), a row for each of ``ids``: in order of rank, filled
    with -1 and 0.0 up to ``k``; without ``k`` as long as the list is."""
    lists = neighbors.groupBy("id").agg(F.array_sort(F.collect_list(F.struct("rank", "neighbor_id", "distance"))).alias("c"))
    out = ids.select("id").join(lists, "id", "left")
    near = F.coalesce(F.col("c.neighbor_id").cast("array<bigint>"), F.array().cast("array<bigint>"))
    far = F.coalesce(F.col("c.distance").cast("array<double>"), F.array().cast("array<double>"))
    if k is not None:
        fill = F.greatest(F.lit(0), F.lit(k) - F.size(near))
        near = F.slice(F.concat(near, F.array_repeat(F.lit(-1).cast("bigint"), fill)), 1, k)
        far = F.slice(F.concat(far, F.array_repeat(F.lit(0.0), fill)), 1, k)
    return out.select("id", near.alias("neighbors"), far.alias("distances"))
