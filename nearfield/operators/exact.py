"""Exact measures of pairs of sparse rows, and the refinement of candidates."""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from nearfield.operators.candidates import first
from nearfield.sources.rows import to_long, whole
from nearfield.sources.shared import materialize

#: Neighbours of round one at most, whatever k and the excess factor are.
MOST_ROUND_ONE = 100
#: Cells of a table that goes to every executor (16 bytes each, so 64 MB) at most.
MOST_CELLS = 4_000_000


#: How values are kept in a row of bytes.
_KINDS = ("<u1", "<u2", "<f4", "<f8")
_BYTES = np.array([1, 2, 4, 8])
#: Bytes of lists and rows that are worked on at once.
_PIECE = 8_000_000


def squared_norm(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda s, v: s + v * v)


class _Table:
    """Rows that are few enough for every executor, in the order of their ids."""

    def __init__(self, rows: DataFrame):
        got = rows.select("id", "features", "values").toArrow().combine_chunks()
        order = np.argsort(got["id"].to_numpy(), kind="stable")
        got = got.take(pa.array(order)).combine_chunks()
        self.ids = got["id"].to_numpy()
        lists = pa.concat_arrays(got["features"].chunks) if got.num_rows else pa.array([], pa.list_(pa.int64()))
        values = pa.concat_arrays(got["values"].chunks) if got.num_rows else pa.array([], pa.list_(pa.float64()))
        self.sizes = np.array(lists.value_lengths().fill_null(0), dtype=np.int64)
        self.offsets = np.concatenate(([0], np.cumsum(self.sizes)))
        self.features, self.values = lists.flatten().to_numpy(), values.flatten().to_numpy()
        self.norms = np.bincount(np.repeat(np.arange(len(self.ids)), self.sizes), weights=self.values**2, minlength=len(self.ids)).astype(np.float64)

    @classmethod
    def again(cls, parts: dict) -> "_Table":
        """From the arrays of a broadcast, which workers read before they have the class."""
        table = cls.__new__(cls)
        vars(table).update(parts)
        return table


def _cells(rows: DataFrame) -> int | None:
    """How many cells a table of the rows has; None where ids are no whole numbers."""
    if dict(rows.dtypes)["id"] not in ("bigint", "int"):
        return None
    return rows.agg(F.sum(F.size("features") + 4)).first()[0] or 0


def _packed(rows: DataFrame) -> DataFrame:
    """(id, norm, cells): each row as bytes, nothing lost: one byte that says how many
    bytes a feature and a value have, then its cells, each a feature and a value. Values
    that are small whole numbers take a byte or two, others four or eight."""
    piece = _PIECE

    def pack(batches):
        for batch in batches:
            for c in _pieces(batch, "features", 8, piece):
                lists, n = c.column("features"), c.num_rows
                sizes = np.array(lists.value_lengths().fill_null(0), dtype=np.int64)
                f, v = lists.flatten().to_numpy(), c.column("values").flatten().to_numpy()
                of = np.repeat(np.arange(n), sizes)
                most = np.zeros(n, dtype=np.int64)
                np.maximum.at(most, of, f)
                with np.errstate(all="ignore"):  # of values out of range
                    kinds = [(v == np.clip(np.trunc(v), 0, top)) for top in (255, 65535)] + [v == v.astype(np.float32)]
                kind = np.full(n, 3)
                for k, fits in reversed(list(enumerate(kinds))):
                    kind[np.bincount(of[~fits], minlength=n) == 0] = k
                wide = 1 + (most > 0xFF) + (most > 0xFFFF) + (most > 0xFFFFFF)
                offsets = np.concatenate(([0], np.cumsum(1 + sizes * (wide + _BYTES[kind]))))
                out = np.zeros(offsets[-1], dtype=np.uint8)
                out[offsets[:-1]] = wide * 4 + kind
                inner = np.arange(len(f)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
                for code in np.unique(wide * 4 + kind):
                    w, k = divmod(int(code), 4)
                    here = np.flatnonzero((wide * 4 + kind == code)[of])
                    at = offsets[of[here]] + 1 + inner[here] * (w + _BYTES[k])
                    for byte in range(w):
                        out[at + byte] = (f[here] >> 8 * byte) & 0xFF
                    raw = v[here].astype(_KINDS[k]).view(np.uint8).reshape(len(here), -1)
                    for byte in range(raw.shape[1]):
                        out[at + w + byte] = raw[:, byte]
                norms = np.bincount(of, weights=v * v, minlength=n).astype(np.float64)
                cells = pa.LargeBinaryArray.from_buffers(pa.large_binary(), n, [None, pa.py_buffer(offsets), pa.py_buffer(out)]).cast(pa.binary())
                yield pa.RecordBatch.from_arrays([c.column("id"), pa.array(norms), cells], names=["id", "norm", "cells"])

    return rows.select("id", "features", "values").mapInArrow(pack, f"id {dict(rows.dtypes)['id']}, norm double, cells binary")


def _pieces(batch, column: str, width: int, piece: int):
    """A batch in slices of about ``piece`` bytes of a column of lists or bytes."""
    ends = np.asarray(batch.column(column).offsets if width > 1 else _offsets(batch.column(column)))[1:].astype(np.int64)
    cuts = np.flatnonzero(np.diff((ends - ends[:1]) * width // piece)) + 1 if len(ends) else []
    for low, high in zip((0, *cuts), (*cuts, batch.num_rows)):
        if high > low:
            yield batch.slice(low, high - low)


def _offsets(column) -> np.ndarray:
    kind = np.int64 if pa.types.is_large_binary(column.type) else np.int32
    return np.frombuffer(column.buffers()[1], dtype=kind)[column.offset : column.offset + len(column) + 1].astype(np.int64)


def _unpacked(column) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(sizes, features, values) of rows as _packed has them."""
    offsets, data = _offsets(column), np.frombuffer(column.buffers()[2] or b"", dtype=np.uint8)
    codes = data[offsets[:-1]]
    sizes = (np.diff(offsets) - 1) // (codes // 4 + _BYTES[codes % 4])
    of = np.repeat(np.arange(len(codes)), sizes)
    inner = np.arange(len(of)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    features, values = np.zeros(len(of), dtype=np.int64), np.empty(len(of))
    for code in np.unique(codes):
        w, k = divmod(int(code), 4)
        here = np.flatnonzero((codes == code)[of])
        at = offsets[of[here]] + 1 + inner[here] * (w + _BYTES[k])
        for byte in range(w):
            features[here] |= data[at + byte].astype(np.int64) << 8 * byte
        values[here] = data[at[:, None] + np.arange(w, w + _BYTES[k])].view(_KINDS[k])[:, 0]
    return sizes, features, values


def dot_products(pairs: DataFrame, left: DataFrame, right: DataFrame) -> DataFrame:
    """``pairs`` (id, neighbor_id) with xx, yy and xy, looked up in ``left`` and
    ``right``. Rows travel as bytes (see _packed): that of a neighbour goes to each of
    its pairs, that of an id once, to be matched there with all of its partners. No row
    goes to the driver, and a task holds one id's row and a slice of its partners."""
    kind, piece = dict(pairs.dtypes), _PIECE
    schema = f"id {kind['id']}, neighbor_id {kind['neighbor_id']}, xx double, yy double, xy double"
    a = _packed(left)
    b = a if left is right else _packed(right)
    there = pairs.select("id", "neighbor_id").join(b.withColumnRenamed("id", "neighbor_id"), "neighbor_id").select("id", "neighbor_id", "norm", "cells")
    own = a.select(F.col("id").cast(kind["id"]).alias("id"), F.lit(None).cast(kind["neighbor_id"]).alias("neighbor_id"), "norm", "cells")
    # an id's own row comes before its pairs
    dealt = there.unionByName(own).repartition("id").sortWithinPartitions("id", F.col("neighbor_id").asc_nulls_first())

    def dots(batches):
        last = None
        for batch in batches:
            for c in _pieces(batch, "cells", 1, piece):
                if last is not None:
                    c = pa.Table.from_batches([last, c]).combine_chunks().to_batches()[0]
                first = np.flatnonzero(np.asarray(c.column("neighbor_id").is_null()))
                if not len(first):
                    continue
                last = c.slice(first[-1], 1)
                # the own row that each row comes after, and whether it is of the same id
                after = first[np.maximum(np.searchsorted(first, np.arange(c.num_rows), "right") - 1, 0)]
                alike = np.asarray(pc.equal(c.column("id"), c.column("id").take(pa.array(after))))
                alike[first] = False
                sizes, f, v = _unpacked(c.column("cells"))
                ends = np.concatenate(([0], np.cumsum(sizes)))
                products = np.zeros(len(f))
                for n, (low, high) in enumerate(zip(first, (*first[1:], c.num_rows))):
                    mine, theirs = slice(ends[low], ends[low + 1]), slice(ends[low + 1], ends[high])
                    if mine.stop > mine.start and theirs.stop > theirs.start:
                        at = np.searchsorted(f[mine], f[theirs])
                        at[at == mine.stop - mine.start] = 0
                        products[theirs] = v[mine][at] * v[theirs] * (f[mine][at] == f[theirs])
                xy = np.bincount(np.repeat(np.arange(len(sizes)), sizes), weights=products, minlength=len(sizes)).astype(np.float64)
                kept, norms = np.flatnonzero(alike), c.column("norm")
                cols = [c.column("id"), c.column("neighbor_id"), norms.take(pa.array(after)), norms, pa.array(xy)]
                yield pa.RecordBatch.from_arrays([x.take(pa.array(kept)) for x in cols], names=["id", "neighbor_id", "xx", "yy", "xy"])

    return dealt.mapInArrow(dots, schema)


#: Products of cells of two rows that are made at once, but for those of one row.
_MOST_PRODUCTS = 8_000_000


def _products(place: np.ndarray, ends: np.ndarray, f: np.ndarray, v: np.ndarray):
    """(i, j, xy) for all rows i < j of a bucket, in parts: ``place`` is the bucket of
    each row, in order, and ``ends`` is where its cells end. Cells of a bucket that have
    a feature in common meet in a sorted list, so rows cost what they have in common;
    sums run in the order of features."""
    sizes = np.diff(ends, prepend=0)
    row = np.repeat(np.arange(len(sizes)), sizes)
    keys = (place[row] << 31) | f
    order = np.argsort(keys, kind="stable")
    keys, row, v_ = keys[order], row[order], v[order]
    start = np.flatnonzero(np.diff(keys, prepend=-1))
    after = np.repeat(np.append(start[1:], len(keys)), np.diff(start, append=len(keys))) - 1 - np.arange(len(keys))
    members = np.bincount(place)
    first = np.cumsum(members) - members
    made = np.bincount(place[row], weights=after, minlength=len(members)) + members.astype(np.float64) ** 2
    cell = np.searchsorted(keys, np.arange(len(members) + 1) << 31)
    cuts = np.flatnonzero(np.diff(np.cumsum(made) // _MOST_PRODUCTS)) + 1
    for low, high in zip((0, *cuts), (*cuts, len(members))):
        rows = np.arange(first[low], first[high - 1] + members[high - 1])
        if high - low == 1 and made[low] > 2 * _MOST_PRODUCTS:  # row by row
            for i in rows[:-1]:
                mine, theirs = slice(ends[i] - sizes[i], ends[i]), slice(ends[i], ends[rows[-1]])
                xy = np.zeros(rows[-1] - i)
                if mine.stop > mine.start and theirs.stop > theirs.start:
                    at = np.searchsorted(f[mine], f[theirs])
                    at[at == sizes[i]] = 0
                    which = np.repeat(np.arange(len(xy)), sizes[i + 1 : rows[-1] + 1])
                    xy = np.bincount(which, weights=v[mine][at] * v[theirs] * (f[mine][at] == f[theirs]), minlength=len(xy)).astype(np.float64)
                yield np.full(len(xy), i), np.arange(i + 1, rows[-1] + 1), xy
            continue
        inner = slice(cell[low], cell[high])
        n = after[inner]
        a = np.repeat(np.arange(inner.start, inner.stop), n)
        b = a + 1 + np.arange(len(a)) - np.repeat(np.cumsum(n) - n, n)
        square = np.cumsum(members[low:high] ** 2) - members[low:high] ** 2
        at = lambda i, j: square[place[i] - low] + (i - first[place[i]]) * members[place[i]] + j - first[place[i]]
        sums = np.bincount(at(row[a], row[b]), weights=v_[a] * v_[b], minlength=int((members[low:high] ** 2).sum())).astype(np.float64)
        later = first[place[rows]] + members[place[rows]] - 1 - rows
        i = np.repeat(rows, later)
        j = i + 1 + np.arange(len(i)) - np.repeat(np.cumsum(later) - later, later)
        yield i, j, sums[at(i, j)]


def within(index: DataFrame, rows: DataFrame, radius: float, similarity: bool, minimal_blocks: int = 1, precision: int | None = None) -> DataFrame:
    """(id, rank, neighbor_id, distance): all pairs of indexed ``rows`` with enough
    buckets in common that are within ``radius`` (for cosine one minus it counts). A row
    goes as bytes to its buckets, whose number its slots bound, and not to its pairs,
    and pairs are measured there; those beyond the radius leave no task. A pair that
    several buckets have is counted and kept once where the neighbours of an id are
    ranked."""
    kind = dict(rows.dtypes)["id"]
    lists = index.groupBy("slot", "val").agg(F.collect_list("id").alias("ids")).where("size(ids) > 1")
    members = lists.select(F.expr("slot * 4294967296L + val").alias("bucket"), F.explode("ids").alias("id"))
    dealt = members.join(_packed(rows), "id").select(F.col("bucket").alias("id"), F.col("id").alias("row"), "norm", "cells").repartition("id").sortWithinPartitions("id", "row")
    # what rounding may bring within the radius
    most, piece = radius * (1 + 1e-9) + 1e-6 + (10.0**-precision if precision is not None else 0), _PIECE

    def meet(batches):
        for parts in whole(b for batch in batches for b in _pieces(batch, "cells", 1, piece)):
            ids, row, norm = (pa.concat_arrays([p.column(c) for p in parts]) for c in ("id", "row", "norm"))
            cells = [_unpacked(p.column("cells")) for p in parts]
            sizes, f, v = (np.concatenate([c[n] for c in cells]) for n in range(3))
            place = np.cumsum(np.diff(ids.to_numpy(), prepend=ids[0].as_py()) != 0)
            norm = norm.to_numpy()
            root = np.sqrt(norm)
            for i, j, xy in _products(place, np.cumsum(sizes), f, v):
                if similarity:
                    both = root[i] * root[j]
                    far = 1 - np.maximum(0, np.divide(xy, both, out=np.zeros(len(xy)), where=both > 0))
                else:
                    far = np.sqrt(np.maximum(0, norm[i] - 2 * xy + norm[j]))
                kept = np.flatnonzero(~(far > most))
                i, j = i[kept], j[kept]
                yield pa.RecordBatch.from_arrays([row.take(pa.array(i)), row.take(pa.array(j)), pa.array(norm[i]), pa.array(norm[j]), pa.array(xy[kept])], names=["id", "neighbor_id", "xx", "yy", "xy"])

    measure = cosine() if similarity else euclid()
    measure = F.round(measure, precision) if precision is not None else measure
    met = dealt.mapInArrow(meet, f"id {kind}, neighbor_id {kind}, xx double, yy double, xy double").select("id", "neighbor_id", measure.alias("distance"))
    near = met.where((1 - F.col("distance") if similarity else F.col("distance")) <= radius)
    turned = F.struct(F.col("neighbor_id").alias("id"), F.col("id").alias("neighbor_id"), "distance")
    both = near.select(F.inline(F.array(F.struct("id", "neighbor_id", "distance"), turned)))
    ordered = both.repartition("id").sortWithinPartitions("id", F.col("distance").desc() if similarity else "distance", "neighbor_id")

    def rank(batches):
        for parts in whole(batches):
            ids, other, far = (pa.concat_arrays([p.column(c) for p in parts]) for c in ("id", "neighbor_id", "distance"))
            i, j = (x.to_numpy(zero_copy_only=False) for x in (ids, other))
            new = np.concatenate(([True], i[1:] != i[:-1]))
            start = np.flatnonzero(new | np.concatenate(([True], j[1:] != j[:-1])))
            start = start[np.diff(start, append=len(i)) >= minimal_blocks]
            if not len(start):
                continue
            place = np.cumsum(new)[start]
            at = np.arange(len(start))
            ranks = at - np.maximum.accumulate(np.where(np.diff(place, prepend=-1) != 0, at, 0)) + 1
            kept = pa.array(start)
            yield pa.RecordBatch.from_arrays([ids.take(kept), pa.array(ranks.astype(np.int32)), other.take(kept), far.take(kept)], names=["id", "rank", "neighbor_id", "distance"])

    return ordered.mapInArrow(rank, f"id {kind}, rank int, neighbor_id {kind}, distance double")


def euclid() -> Column:
    return F.sqrt(F.greatest(F.lit(0.0), F.col("xx") - 2 * F.col("xy") + F.col("yy")))


def cosine() -> Column:
    norms = F.sqrt("xx") * F.sqrt("yy")
    return F.coalesce(F.greatest(F.lit(0.0), F.col("xy") / F.when(norms > 0, norms)), F.lit(0.0))


def measured(pairs: DataFrame, left: DataFrame, right: DataFrame, similarity: bool, precision: int | None = None) -> DataFrame:
    """(id, neighbor_id, distance): the Euclidean distance, or with ``similarity`` the
    cosine. A ``precision`` rounds the measure before anything is ranked by it."""
    measure = cosine() if similarity else euclid()
    measure = F.round(measure, precision) if precision is not None else measure
    return dot_products(pairs, left, right).select("id", "neighbor_id", measure.alias("distance"))


def nearest(df: DataFrame, n: int, similarity: bool) -> DataFrame:
    key = F.col("distance").desc() if similarity else F.col("distance").asc()
    return first(df, n, key, "neighbor_id")


def refined(found: DataFrame, k: int, excess: int, queries: DataFrame, indexed: DataFrame, similarity: bool, indexed_found: DataFrame | None = None, expand: bool = True, precision: int | None = None) -> DataFrame:
    """(id, neighbor_id, distance, rank): the k nearest of the candidates ``found`` (the
    first k * excess by collisions, columns id and neighbor_id) and, with ``expand``, of
    the round-one neighbours of the first k of them. ``indexed_found`` are candidates of
    the indexed rows; without it ``found`` are those, the queries being indexed."""
    limit = min(MOST_ROUND_ONE, k + excess)
    one = nearest(measured(found, queries, indexed, similarity, precision), limit, similarity)
    if not expand:
        return one.where(F.col("rank") <= k)
    one = materialize(one)  # read more than once
    second = one if indexed_found is None else nearest(measured(indexed_found, indexed, indexed, similarity, precision), limit, similarity)
    measure = cosine() if similarity else euclid()
    measure = F.round(measure, precision) if precision is not None else measure
    more = _through(one.where(F.col("rank") <= k).select("id", F.col("neighbor_id").alias("via")), second, queries, indexed)
    if indexed_found is None:
        more = more.where("id <> neighbor_id")
    every = one.select("id", "neighbor_id", "distance").unionByName(more.select("id", "neighbor_id", measure.alias("distance")))
    # a pair that several neighbours lead to has the same measure from each
    return nearest(every.repartition("id").groupBy("id", "neighbor_id").agg(F.first("distance").alias("distance")), k, similarity)


def _through(asked: DataFrame, known: DataFrame, queries: DataFrame, indexed: DataFrame) -> DataFrame:
    """(id, neighbor_id, xx, yy, xy) of each row of ``queries`` and the neighbours in
    ``known`` (id, neighbor_id) of each ``via`` that it asks; a pair comes once for each
    ``via``. Rows travel as bytes to what they are asked through, not to each pair: as
    many as a row asks, and the neighbours of those that are asked at all. A task holds
    the neighbours of one ``via`` and a slice of the rows that ask it."""
    kind, far = dict(asked.dtypes), dict(known.dtypes)["neighbor_id"]
    a = _packed(queries)
    b = a if queries is indexed else _packed(indexed)
    asks = asked.join(a, "id").select("via", F.col("id").cast(kind["id"]).alias("id"), F.lit(None).cast(far).alias("neighbor_id"), "norm", "cells")
    wanted = known.select(F.col("id").alias("via"), "neighbor_id").join(asked.select("via").distinct(), "via", "left_semi")
    told = wanted.join(b.withColumnRenamed("id", "neighbor_id"), "neighbor_id").select("via", F.lit(None).cast(kind["id"]).alias("id"), "neighbor_id", "norm", "cells")
    dealt = told.unionByName(asks).repartition("via").sortWithinPartitions("via", F.col("neighbor_id").asc_nulls_last())
    piece = _PIECE

    def cross(batches):
        held = None
        for batch in batches:
            for c in _pieces(batch, "cells", 1, piece):
                if held is not None:
                    c = pa.Table.from_batches([held, c]).combine_chunks().to_batches()[0]
                place = np.concatenate(([0], np.cumsum(np.asarray(pc.not_equal(c.column("via")[1:], c.column("via")[:-1])))))
                is_far = np.asarray(c.column("neighbor_id").is_valid())
                held = c.take(pa.array(np.flatnonzero(is_far & (place == place[-1]))))
                fars, asks = np.flatnonzero(is_far), np.flatnonzero(~is_far)
                if not len(asks) or not len(fars):
                    continue
                members = np.bincount(place[fars], minlength=place[-1] + 1)
                start = np.cumsum(members) - members
                inner = np.zeros(c.num_rows, dtype=np.int64)
                inner[fars] = np.arange(len(fars)) - start[place[fars]]
                width = members[place[asks]]
                inner[asks] = np.cumsum(width) - width  # where an asking row's pairs begin
                sizes, f, v = _unpacked(c.column("cells"))
                row = np.repeat(np.arange(c.num_rows), sizes)
                keys = (place[row] << 31) | f
                theirs, mine = np.flatnonzero(is_far[row]), np.flatnonzero(~is_far[row])
                theirs = theirs[np.argsort(keys[theirs], kind="stable")]
                low, high = (np.searchsorted(keys[theirs], keys[mine], side) for side in ("left", "right"))
                xy = np.zeros(int(width.sum()))
                for part in np.split(np.arange(len(mine)), np.flatnonzero(np.diff(np.cumsum(high - low) // 4_000_000)) + 1):
                    n = (high - low)[part]
                    met = theirs[np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n) + np.repeat(low[part], n)]
                    cell = np.repeat(mine[part], n)
                    np.add.at(xy, inner[row[cell]] + inner[row[met]], v[cell] * v[met])
                i = np.repeat(asks, width)
                j = fars[start[place[i]] + np.arange(len(i)) - inner[i]]
                i, j, norm = pa.array(i), pa.array(j), c.column("norm")
                yield pa.RecordBatch.from_arrays([c.column("id").take(i), c.column("neighbor_id").take(j), norm.take(i), norm.take(j), pa.array(xy)], names=["id", "neighbor_id", "xx", "yy", "xy"])

    return dealt.mapInArrow(cross, f"id {kind['id']}, neighbor_id {far}, xx double, yy double, xy double")


def recall(found: DataFrame, truth: DataFrame) -> DataFrame:
    """One row: the share of the true (id, neighbor_id) that were found."""
    hits = truth.select("id", "neighbor_id").join(found.select("id", "neighbor_id").withColumn("hit", F.lit(1)), ["id", "neighbor_id"], "left")
    return hits.agg((F.count("hit") / F.count("*")).alias("recall"))


#: Features of a block of queries that are laid out densely, at most.
_MOST_DENSE = 512


def _whole(values: np.ndarray, norms: np.ndarray) -> bool:
    """Whether sums of products are exact in any order: whole numbers, none too large."""
    return bool((values == np.trunc(values)).all() and (norms < 2.0**53).all())


def _against(rows: DataFrame, q: DataFrame, k: int, slack: float) -> DataFrame:
    """(id, neighbor_id, xx, yy, xy) of the queries ``q``, which go to every executor,
    and rows with a common feature; of the rows of a task those alone that were among
    the first ``k`` of a query, or ``slack`` below, when they were read. Features that
    many queries have are multiplied as a dense matrix, where that is exact, and the
    others are matched one by one."""
    id_type = dict(rows.dtypes)["id"]
    held, most_dense = rows.sparkSession.sparkContext.broadcast(vars(_Table(q))), _MOST_DENSE

    def compare(batches):
        t = _Table.again(held.value)
        n_queries = len(t.ids)
        order = np.argsort(t.features, kind="stable")
        features, values = t.features[order], t.values[order]
        of = np.repeat(np.arange(n_queries), t.sizes)[order]
        root = np.maximum(np.sqrt(t.norms), 1e-300)
        known, times = np.unique(features, return_counts=True)
        dense = np.zeros(0, dtype=known.dtype)
        if _whole(t.values, t.norms):
            common = np.argsort(-times, kind="stable")[:most_dense]
            dense = np.sort(known[common[times[common] * 32 > n_queries]])
        laid = np.zeros((len(dense), n_queries))
        if len(dense):
            at = np.minimum(np.searchsorted(dense, features), len(dense) - 1)
            there = dense[at] == features
            laid[at[there], of[there]] = values[there]
        best = np.full((k, n_queries), -np.inf)
        for batch in batches:
            # as many rows at a time as make a block of 4 million pairs
            step = max(1, 4_000_000 // max(1, n_queries))
            for at in range(0, batch.num_rows, step):
                c = batch.slice(at, step)
                lists, v = c.column("features"), c.column("values").flatten().to_numpy()
                row = np.repeat(np.arange(c.num_rows), np.diff(lists.offsets.to_numpy()))
                f = lists.flatten().to_numpy()
                norm = np.bincount(row, weights=v * v, minlength=c.num_rows).astype(np.float64)
                low, high = np.searchsorted(features, f, "left"), np.searchsorted(features, f, "right")
                if len(dense) and _whole(v, norm):
                    place = np.minimum(np.searchsorted(dense, f), len(dense) - 1)
                    there = dense[place] == f
                    own = np.zeros((c.num_rows, len(dense)))
                    own[row[there], place[there]] = v[there]
                    block = (own @ laid).reshape(-1)
                    high = np.where(there, low, high)
                else:
                    block = np.zeros(c.num_rows * n_queries)
                found = np.cumsum(high - low)
                for part in np.split(np.arange(len(f)), np.flatnonzero(np.diff(found // 4_000_000)) + 1):
                    n = (high - low)[part]
                    cell = np.repeat(part, n)
                    hit = np.arange(len(cell)) - np.repeat(np.cumsum(n) - n, n) + low[cell]
                    np.add.at(block, row[cell] * n_queries + of[hit], v[cell] * values[hit])
                block = block.reshape(c.num_rows, n_queries)
                ids = c.column("id").to_numpy()
                if n_queries:
                    same = np.minimum(np.searchsorted(t.ids, ids), n_queries - 1)
                    itself = np.flatnonzero(t.ids[same] == ids)
                    block[itself, same[itself]] = 0
                near = block / np.maximum(np.sqrt(norm), 1e-300)[:, None]
                near /= root[None, :]
                r, s = np.nonzero((near >= best[-1] - slack) & (block != 0))
                if not len(r):
                    continue
                # the first k of each query among those, and those before
                order = np.lexsort((-near[r, s], s))
                r, s = r[order], s[order]
                who, first_at, n = np.unique(s, return_index=True, return_counts=True)
                rank = np.arange(len(s)) - np.repeat(first_at, n)
                top = np.full((k, len(who)), -np.inf)
                few = rank < k
                top[rank[few], np.repeat(np.arange(len(who)), n)[few]] = near[r[few], s[few]]
                best[:, who] = -np.sort(-np.concatenate((best[:, who], top)), axis=0)[:k]
                keep = near[r, s] >= best[-1][s] - slack
                r, s = r[keep], s[keep]
                yield pa.RecordBatch.from_arrays([pa.array(t.ids[s]), pa.array(ids[r]), pa.array(t.norms[s]), pa.array(norm[r]), pa.array(block[r, s])], names=["id", "neighbor_id", "xx", "yy", "xy"])

    return rows.mapInArrow(compare, f"id {id_type}, neighbor_id {id_type}, xx double, yy double, xy double")


def exact_neighbors(rows: DataFrame, k: int, queries: DataFrame | None = None, precision: int | None = None) -> DataFrame:
    """The true k nearest by cosine, the yardstick of recall: rows without a common
    feature have cosine 0, so matching features finds all others. Queries go to every
    executor, cut by a hash of their ids into blocks of half of MOST_CELLS cells on
    average, and each block is compared with the rows where those lie: a feature that
    all rows have costs no exchange. Rows whose ids are no whole numbers are joined on
    features instead."""
    q = rows if queries is None else queries
    cells = _cells(q)
    measure = F.round(cosine(), precision) if precision is not None else cosine()
    slack = 1e-6 + (10.0**-precision if precision is not None else 0)  # what rounding may make equal
    best = lambda full: nearest(full.select("id", "neighbor_id", measure.alias("distance")), k, True)
    if cells is not None and cells <= MOST_CELLS:
        return best(_against(rows, q, k, slack))
    if cells is not None:
        blocks = -(-2 * cells // MOST_CELLS)
        rows, q = materialize(rows.select("id", "features", "values")), materialize(q.select("id", "features", "values"))
        # one after another, so that no more than a block is held at a time
        parts = [materialize(best(_against(rows, q.where(F.pmod(F.xxhash64("id"), F.lit(blocks)) == b), k, slack))) for b in range(blocks)]
        return reduce(DataFrame.unionByName, parts)
    a, b = to_long(q), to_long(rows).withColumnRenamed("id", "neighbor_id").withColumnRenamed("v", "w")
    sums = a.join(b, "f").where("id <> neighbor_id").groupBy("id", "neighbor_id").agg(F.sum(F.col("v") * F.col("w")).alias("xy"))
    norm = lambda d, i, n: d.select(F.col("id").alias(i), squared_norm(F.col("values")).alias(n))
    return best(sums.join(norm(q, "id", "xx"), "id").join(norm(rows, "neighbor_id", "yy"), "neighbor_id"))
