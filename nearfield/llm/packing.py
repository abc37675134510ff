"""Packing documents into sequences of several permitted lengths by best fit.

A document longer than the longest permitted length fills sequences of its own, and
its rest is packed with the others. The plan is made from the histogram of lengths,
which has fewer rows than the longest permitted length however large the corpus: for
the longest length left, each permitted capacity is tried as a new bin and filled by
best fit (again and again the longest length left that fits); the capacity with the
least cost for each token opens, as often as the histogram can repeat its contents;
in the end each bin is downsized to the smallest permitted length that holds its
contents. Documents then find their place by their rank among those of their length.
"""

from __future__ import annotations

from bisect import bisect_right

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from nearfield.llm.common import materialize, pick, running_sum, word_count

#: The production parameters: permitted lengths, and what a sequence costs besides.
CAPACITIES, OVERHEAD = (512, 1024, 2048, 4096), 16


def plan_bins(histogram: dict[int, int], capacities: tuple[int, ...] = CAPACITIES, overhead: int = OVERHEAD) -> list[tuple[int, int, list[tuple[int, int]]]]:
    """[(bins, capacity, [(length, times), ...]), ...], longest length first. Each
    entry uses up a length, so there are no more entries than lengths."""
    left = {n: c for n, c in histogram.items() if c > 0}
    lengths = sorted(left)
    sizes, out = sorted(capacities), []
    while lengths:
        best = None
        for capacity in sizes:
            if capacity < lengths[-1]:
                continue
            room, at, held = capacity, len(lengths), []
            while room and (at := bisect_right(lengths, room, 0, at)):
                n = lengths[at - 1]
                times = min(left[n], room // n)
                held.append((n, times))
                room -= n * times
                at -= 1
            cost = (capacity + overhead) / (capacity - room)
            if best is None or cost <= best[0]:
                best = cost, capacity - room, held
        _, filled, held = best
        bins = min(left[n] // times for n, times in held)
        out.append((bins, next(c for c in sizes if c >= filled), held))
        for n, times in held:
            left[n] -= bins * times
            if not left[n]:
                lengths.pop(bisect_right(lengths, n) - 1)
    return out


def pack(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, length_col: str | None = None, capacities: tuple[int, ...] = CAPACITIES, overhead: int = OVERHEAD) -> DataFrame:
    """(id, piece, first, length, bin_id, bin_capacity, bin_offset): a row for each
    piece of each document; it holds ``length`` words from ``first`` on, and lies in
    the bin from ``bin_offset`` on. Bins have numbers from 0 without gaps.

    Lengths are numbers of words, or ``length_col`` (null: 0). A document without
    words has one row of length 0 and null for its bin. Repeated rows are packed as
    often as they occur, null ids like others; an empty table gives no rows. Plain
    order within a length is that of md5(id), so reruns give the same bins.
    """
    most = max(capacities)
    given = pick(docs, id=id_col, **({"words": length_col} if length_col else {"text": text_col}))
    words = F.coalesce(F.col("words").cast("long"), F.lit(0).cast("long")) if length_col else word_count(F.col("text"))
    sized = given.select("id", words.alias("words")).withColumn("row", F.monotonically_increasing_id())
    sized = materialize(sized.withColumn("key", F.md5(F.coalesce(F.col("id").cast("string"), F.lit("")))))
    whole, rest = F.expr(f"words div {most}"), F.col("words") % most
    parts = F.array(F.struct(F.lit(most).alias("length"), whole.alias("times")), F.struct(rest.cast("int").alias("length"), F.lit(1).cast("long").alias("times")))
    items = sized.select("id", "row", "key", "words", F.explode(parts).alias("p")).select("id", "row", "key", "words", "p.*").where("times > 0 and length > 0")
    histogram = {r["length"]: r["n"] for r in items.where(F.col("length") < most).groupBy("length").agg(F.count("*").alias("n")).collect()}
    n_whole = items.where(F.col("length") == most).agg(F.sum("times")).first()[0] or 0
    # for each length, in order: rank of the first, number in a bin, first bin, capacity, offset
    places: dict[int, list[tuple[int, int, int, int, int]]] = {most: [(0, 1, 0, most, 0)]} if n_whole else {}
    used, first_bin = {}, n_whole
    for bins, capacity, held in plan_bins(histogram, capacities, overhead):
        offset = 0
        for n, times in held:
            start = used.get(n, 0)
            places.setdefault(n, []).append((start, times, first_bin, capacity, offset))
            used[n] = start + bins * times
            offset += n * times
        first_bin += bins
    tables = {n: np.array(p, dtype=np.int64).T for n, p in places.items()}

    def place(batches):
        for b in batches:
            length, rank = b.column("length").to_numpy(), b.column("rank").to_numpy()
            out = np.zeros((3, len(rank)), dtype=np.int64)
            for n in np.unique(length):
                mine = length == n
                start, times, bin0, capacity, offset = tables[n]
                at = np.searchsorted(start, rank[mine], side="right") - 1
                beyond = rank[mine] - start[at]
                out[:, mine] = bin0[at] + beyond // times[at], capacity[at], offset[at] + n * (beyond % times[at])
            cols = [b.column(c) for c in ("id", "row", "words", "length", "piece")]
            yield pa.RecordBatch.from_arrays([*cols, *map(pa.array, out)], names=["id", "row", "words", "length", "piece", "bin_id", "bin_capacity", "bin_offset"])

    ranked = running_sum(items, "length", "key", ["id", "words", "row"], "times", "upto")
    ranked = ranked.select("id", "row", "words", "length", "upto", "times", F.explode(F.sequence(F.lit(0).cast("long"), F.col("times") - 1)).alias("i"))
    ranked = ranked.withColumn("rank", F.col("upto") - F.col("times") + F.col("i")).withColumn("piece", F.when(F.col("length") == most, F.col("i")).otherwise(F.expr(f"words div {most}")))
    id_type = dict(sized.dtypes)["id"]
    placed = ranked.select("id", "row", "words", "length", "rank", "piece").mapInArrow(place, f"id {id_type}, row long, words long, length int, piece long, bin_id long, bin_capacity long, bin_offset long")
    none = F.lit(None).cast("long")
    empty = sized.where("words = 0").select("id", F.lit(0).cast("int").alias("length"), F.lit(0).cast("long").alias("piece"), none.alias("bin_id"), none.alias("bin_capacity"), none.alias("bin_offset"))
    out = placed.select("id", "length", "piece", "bin_id", "bin_capacity", "bin_offset").unionByName(empty)
    return out.select(F.col("id").alias(id_col), "piece", (F.col("piece") * most).alias("first"), F.col("length").cast("long").alias("length"), "bin_id", "bin_capacity", "bin_offset")
