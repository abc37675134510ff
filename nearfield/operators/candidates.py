"""Candidates: rows that share buckets, ranked by how many."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from nearfield.sources.rows import whole

#: A neighbour's number and its id's place in a batch share 63 bits.
_PLACE = 20


def collisions(index: DataFrame, queries: DataFrame | None = None, minimal_blocks: int = 1) -> DataFrame:
    """(id, neighbor_id, cnt): in how many slots a query row and an indexed row have the
    same value. Without ``queries`` (long signatures) the indexed rows query themselves,
    from lists of buckets, which the index's cap bounds, instead of a self-join."""
    if queries is None:
        lists = index.groupBy("slot", "val").agg(F.collect_list("id").alias("ids")).where("size(ids) > 1")
        met = lists.select("ids", F.explode("ids").alias("id")).select("id", F.explode("ids").alias("neighbor_id")).where("id <> neighbor_id")
    else:
        met = queries.join(index.withColumnRenamed("id", "neighbor_id"), ["slot", "val"]).select("id", "neighbor_id")
    counted = met.groupBy("id", "neighbor_id").agg(F.count("*").alias("cnt"))
    return counted.where(F.col("cnt") >= minimal_blocks) if minimal_blocks > 1 else counted


def _lists(index: DataFrame, queries: DataFrame | None) -> DataFrame:
    """(id, ids): for each bucket that a row is in, the rows of the index there."""
    lists = index.groupBy("slot", "val").agg(F.collect_list("id").alias("ids"))
    if queries is None:
        return lists.where("size(ids) > 1").select("ids", F.explode("ids").alias("id"))
    return queries.join(lists, ["slot", "val"]).select("ids", "id")


def _tally(owner: np.ndarray, ids: np.ndarray, met: np.ndarray, n: int, least: int, ties: bool, self_too: bool):
    """(place, neighbour, count, rank) of the first ``n`` of each place: ``owner`` is
    the place in ``ids`` that each of ``met`` was met by."""
    if not self_too:
        other = met != ids[owner]
        owner, met = owner[other], met[other]
    low = int(met.min()) if len(met) else 0
    if not len(met) or len(ids) < 1 << _PLACE and int(met.max()) - low < 1 << (63 - _PLACE):
        keys = (owner << (63 - _PLACE)) | (met - low)
        keys.sort()
        start = np.flatnonzero(np.diff(keys, prepend=-1))
        owner, met = keys[start] >> (63 - _PLACE), (keys[start] & ((1 << (63 - _PLACE)) - 1)) + low
        count = np.diff(start, append=len(keys))
    else:  # ids too far apart for one number
        order = np.lexsort((met, owner))
        owner, met = owner[order], met[order]
        start = np.flatnonzero((np.diff(owner, prepend=-1) != 0) | (np.concatenate(([True], met[1:] != met[:-1]))))
        count = np.diff(start, append=len(met))
        owner, met = owner[start], met[start]
    if least > 1:
        kept = count >= least
        owner, met, count = owner[kept], met[kept], count[kept]
    order = np.lexsort((-count, owner)) if (count > 1).any() else np.arange(len(count))
    owner, met, count = owner[order], met[order], count[order]
    new = np.diff(owner, prepend=-1) != 0
    at = np.arange(len(owner))
    rank = at - np.maximum.accumulate(np.where(new, at, 0))
    if ties:
        level = new | (np.diff(count, prepend=0) != 0)
        rank = rank[np.maximum.accumulate(np.where(level, at, 0))]
    kept = rank < n
    return owner[kept], met[kept], count[kept], rank[kept] + 1


def ranked(index: DataFrame, n: int, queries: DataFrame | None = None, minimal_blocks: int = 1, ties: bool = False) -> DataFrame:
    """(id, neighbor_id, cnt, rank): the first ``n`` of collisions() of each id, by their
    number and the neighbour's id, as by_collisions() has them. A bucket goes as a list to
    each of its ids, and an id's lists are counted where they meet: a pair is one number
    in a list, and no row of a table or of an aggregation."""
    kind = dict(index.dtypes)["id"]
    if kind not in ("bigint", "int") or queries is not None and dict(queries.dtypes)["id"] not in ("bigint", "int"):
        return by_collisions(collisions(index, queries, minimal_blocks), n, ties)
    own = kind if queries is None else dict(queries.dtypes)["id"]
    dealt = _lists(index, queries).repartition("id").sortWithinPartitions("id")
    most, self_too = min(n, 2**31 - 1), queries is not None

    def count(parts):
        """Whole ids only: ``parts`` are slices of batches, in order."""
        ids = np.concatenate([p.column("id").to_numpy() for p in parts]).astype(np.int64)
        sizes = np.concatenate([np.diff(p.column("ids").offsets.to_numpy()) for p in parts])
        met = np.concatenate([p.column("ids").flatten().to_numpy() for p in parts]).astype(np.int64)
        new = np.diff(ids, prepend=ids[0]) != 0
        place = np.cumsum(new)
        ids = np.concatenate((ids[:1], ids[new]))
        owner, met, count, rank = _tally(np.repeat(place, sizes), ids, met, most, minimal_blocks, ties, self_too)
        return pa.RecordBatch.from_arrays(
            [pa.array(ids[owner]).cast(arrow[own]), pa.array(met).cast(arrow[kind]), pa.array(count), pa.array(rank.astype(np.int32))], names=["id", "neighbor_id", "cnt", "rank"]
        )

    arrow = {"bigint": pa.int64(), "int": pa.int32()}

    def counted(batches):
        yield from map(count, whole(batches))

    return dealt.select("id", "ids").mapInArrow(counted, f"id {own}, neighbor_id {kind}, cnt bigint, rank int")


def first(df: DataFrame, n: int, *order, ties: bool = False) -> DataFrame:
    """The first ``n`` rows of each id by ``order``, with their rank."""
    rank = (F.rank() if ties else F.row_number()).over(Window.partitionBy("id").orderBy(*order))
    return df.withColumn("rank", rank).where(F.col("rank") <= n)


def by_collisions(counted: DataFrame, n: int, ties: bool = False) -> DataFrame:
    order = [F.col("cnt").desc()] if ties else [F.col("cnt").desc(), F.col("neighbor_id")]
    return first(counted, n, *order, ties=ties)


def fast_distance(n_slots: int, absolute: bool = False):
    """One minus the share of slots that agree, or their number."""
    return F.col("cnt").cast("double") if absolute else 1 - F.col("cnt") / n_slots
