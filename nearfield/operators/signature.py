"""A signature of each row: MinHash or winner-takes-all, plain or shingled.

Rows are hashed in Arrow batches, all rows of a batch at once for each slot: the work
is slots x values of pure array arithmetic, needs no exchange, and is far faster than
interpreted array functions. ``minhash_sql`` is the same in plain DataFrame functions.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from nearfield.functions.hashing import MASK, hash32, hash32_array, wang32_array
from nearfield.sources.rows import to_long

WTA_SEED = 42


def slots(number_of_hash_functions: int, block_size: int = 1, shingle: int = 0, shingle_size: int = 1) -> tuple[int, int]:
    """(raw slots, slots of the signature)."""
    if not shingle:
        return number_of_hash_functions, number_of_hash_functions
    raw = number_of_hash_functions * block_size
    return raw, math.ceil(raw / shingle_size)


def _minhash(features: np.ndarray, at: np.ndarray, n: int) -> np.ndarray:
    """(slots, rows): of the feature with the least hash, ties to the least feature,
    its id plus one. ``at`` is where each row begins; no row is empty."""
    key, low = (features + 1).astype(np.uint32), features.astype(np.uint64)
    out = np.empty((n, len(at)), dtype=np.int64)
    for j in range(n):
        packed = (hash32_array(key, j + 1).astype(np.uint64) << np.uint64(31)) | low
        out[j] = (np.minimum.reduceat(packed, at) & np.uint64(2**31 - 1)).astype(np.int64) + 1
    return out


def _wta(features: np.ndarray, values: np.ndarray, at: np.ndarray, sizes: np.ndarray, n: int, range_k: int) -> np.ndarray:
    """(slots, rows): among the ``range_k`` least hashes of a row that of the greatest
    positive value, ties to the least hash; 0 where no value is positive."""
    key, row = (features + 1).astype(np.uint32), np.repeat(np.arange(len(at)), sizes)
    out = np.zeros((n, len(at)), dtype=np.int64)
    inner = np.arange(len(row)) - at[row]
    for j in range(n):
        h = hash32_array(key, WTA_SEED + j).astype(np.int64)
        order = np.lexsort((h, row))
        order = order[(inner < range_k) & (values[order] > 0)]
        order = order[np.lexsort((h[order], -values[order], row[order]))]
        who, first = np.unique(row[order], return_index=True)
        out[j, who] = h[order[first]]
    return out


def _shingled(raw: np.ndarray, size: int) -> np.ndarray:
    """Blocks of ``size`` slots, the last may be shorter, each folded to one value."""
    out = []
    for at in range(0, len(raw), size):
        s = raw[at].astype(np.uint32)
        for v in raw[at + 1 : at + size]:
            s = wang32_array((v + 1).astype(np.uint32) * (s + np.uint32(1)))
        out.append(s.astype(np.int64))
    return np.array(out)


def signatures(rows: DataFrame, number_of_hash_functions: int = 400, *, algorithm: str = "minhash", range_k: int = 20, block_size: int = 5, shingle: int = 0, shingle_size: int = 4) -> DataFrame:
    """(id, signature) for each row with features: an array of a long for each slot.
    Rows without features, or null ones, have no signature."""
    raw_slots, _ = slots(number_of_hash_functions, block_size, shingle, shingle_size)
    if algorithm not in ("minhash", "wta"):
        raise ValueError(f"no such algorithm: {algorithm}")

    def hashed(batches):
        for b in batches:
            for part in range(0, b.num_rows, 4096):
                c = b.slice(part, 4096)
                lists, values = c.column("features"), c.column("values")
                sizes = np.diff(lists.offsets.to_numpy())
                at = lists.offsets.to_numpy()[:-1] - lists.offsets.to_numpy()[0]
                features = lists.flatten().to_numpy()
                raw = _minhash(features, at, raw_slots) if algorithm == "minhash" else _wta(features, values.flatten().to_numpy(), at, sizes, raw_slots, range_k)
                if shingle:
                    raw = _shingled(raw, shingle_size)
                flat = np.ascontiguousarray(raw.T).reshape(-1)
                ends = np.arange(c.num_rows + 1, dtype=np.int32) * len(raw)
                yield pa.RecordBatch.from_arrays([c.column("id"), pa.ListArray.from_arrays(pa.array(ends), pa.array(flat))], names=["id", "signature"])

    full = rows.where("size(features) > 0").select("id", "features", "values")
    return full.mapInArrow(hashed, f"id {dict(rows.dtypes)['id']}, signature array<bigint>")


def long_signatures(signed: DataFrame) -> DataFrame:
    """(id, slot, val), a row for each slot."""
    return signed.select("id", F.posexplode("signature").alias("slot", "val"))


def minhash_sql(rows: DataFrame, number_of_hash_functions: int) -> DataFrame:
    """(id, slot, val) of the unshingled MinHash without Python: every value meets
    every slot, and a pre-aggregated minimum of hash and feature in one long remains."""
    cells = to_long(rows).withColumn("slot", F.explode(F.sequence(F.lit(0), F.lit(number_of_hash_functions - 1))))
    h = hash32((F.col("f") + 1), F.col("slot").cast("long") + 1)
    least = cells.groupBy("id", "slot").agg(F.min(h * 2**31 + F.col("f")).alias("least"))
    return least.select("id", "slot", (F.col("least") % 2**31 + 1).alias("val"))


def usable(val: Column) -> Column:
    """Values that the index and lookups take."""
    return (val != 0) & (val != MASK)
