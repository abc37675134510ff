"""Connected components by contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from nearfield.sources.shared import discard, materialize


def components(edges: DataFrame, rows: int | None = None) -> DataFrame:
    """(node, component) for each node of ``edges`` (u, v): component is the smallest
    node reachable. Each round hooks every node to its smallest neighbour, halves the
    chains and contracts the graph, so the number of rounds grows as the logarithm of
    the longest chain. No round gathers links anywhere: minima are pre-aggregated and
    the joins have plain exchanges on both sides, which adaptive execution can split.
    ``rows`` is a bound of the number of edges where one is known.
    """
    left = materialize(edges.select("u", "v").where("u <> v").distinct(), rows=rows)
    found, nodes = None, 0
    while n := left.count():  # from the footers of the files
        nodes = nodes or 2 * n
        both = left.union(left.select("v", "u"))
        first = both.groupBy("u").agg(F.min("v").alias("v")).select("u", F.least("u", "v").alias("p"))
        first = hook = materialize(first, rows=2 * n)
        for _ in range(2):
            up = hook.select(F.col("u").alias("p"), F.col("p").alias("pp"))
            hook = hook.join(up, "p").select("u", F.col("pp").alias("p"))
        hook = materialize(hook, rows=2 * n)
        at_u = hook.select("u", F.col("p").alias("pu"))
        at_v = hook.select(F.col("u").alias("v"), F.col("p").alias("pv"))
        rest = materialize(
            left.join(at_u, "u").join(at_v, "v").where("pu <> pv")
            .select(F.least("pu", "pv").alias("u"), F.greatest("pu", "pv").alias("v")).distinct(),
            rows=n,
        )
        discard(left, first)
        left = rest
        if found is None:
            found = hook
        else:
            up = hook.select(F.col("u").alias("p"), F.col("p").alias("pp"))
            longer = materialize(found.join(up, "p", "left").select("u", F.coalesce("pp", "p").alias("p")), rows=nodes)
            discard(found, hook)
            found = longer
    if found is None:
        return left.select(F.col("u").alias("node"), F.col("v").alias("component"))
    discard(left)
    return found.select(F.col("u").alias("node"), F.col("p").alias("component"))
