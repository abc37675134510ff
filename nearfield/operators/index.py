"""The inverted index: rows (slot, val, id) that survive sampling, cap and pruning.

Bucket sizes are pre-aggregated counts, so a value that a third of all rows share is
counted without bringing its rows together, and then dropped by the cap.
"""

from __future__ import annotations

import warnings

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from nearfield.operators.signature import usable


def sampled(sig: DataFrame, least_significant_bits: int = 0) -> DataFrame:
    """Usable values whose lowest bits are all zero."""
    kept = sig.where(usable(F.col("val")))
    return kept.where(F.col("val").bitwiseAND(F.lit((1 << least_significant_bits) - 1).cast("long")) == 0) if least_significant_bits > 0 else kept


def bucket_sizes(sig: DataFrame) -> DataFrame:
    return sig.groupBy("slot", "val").agg(F.count("*").alias("n"))


def kept_buckets(sizes: DataFrame, max_bin_size: int, prune: int = -1, less_entries: int = -1) -> DataFrame:
    """(slot, val, n) of the buckets that stay: fewer than ``max_bin_size`` rows, more
    than ``prune``; then slots with at least ``less_entries`` different values (0: at
    least mean plus standard deviation; where that empties the index all slots stay)."""
    kept = sizes.where(F.col("n") < max_bin_size)
    if prune >= 0:
        kept = kept.where(F.col("n") > prune)
    if less_entries < 0:
        return kept
    values = kept.groupBy("slot").agg(F.count("*").alias("values"))
    if less_entries > 0:
        good = values.where(F.col("values") >= less_entries)
    else:
        level = values.agg((F.avg("values") + F.stddev_pop("values")).alias("level"))
        good = values.join(F.broadcast(level)).where("values >= level")  # one row
        if good.isEmpty():
            warnings.warn("no slot has mean plus deviation many values; all slots stay", stacklevel=2)
            return kept
    return kept.join(good.select("slot"), "slot", "left_semi")


def build_index(sig: DataFrame, max_bin_size: int = 50, *, prune: int = -1, less_entries: int = -1, least_significant_bits: int = 0) -> DataFrame:
    """(slot, val, id) from long signatures."""
    sig = sampled(sig, least_significant_bits)
    kept = kept_buckets(bucket_sizes(sig), max_bin_size, prune, less_entries)
    return sig.join(kept.select("slot", "val"), ["slot", "val"], "left_semi").select("slot", "val", "id")


def distribution(index: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The histogram (bucket_size, n); per slot (slot, n_values, sum_size, mean_size,
    std_size); and one row (mean_values, std_values) over the slots."""
    sizes = bucket_sizes(index)
    histogram = sizes.groupBy(F.col("n").alias("bucket_size")).agg(F.count("*").alias("n"))
    per_slot = sizes.groupBy("slot").agg(F.count("*").alias("n_values"), F.sum("n").alias("sum_size"), F.avg("n").alias("mean_size"), F.stddev_pop("n").alias("std_size"))
    return histogram, per_slot, per_slot.agg(F.avg("n_values").alias("mean_values"), F.stddev_pop("n_values").alias("std_values"))
