"""The 32-bit hash of (key, seed): Wang's integer mix of their product.

Unsigned 32-bit numbers are longs from 0 to 2**32 - 1 in columns. The first step of
the mix, ~k + (k << 15), is 32767 * k - 1 modulo 2**32, so that k occurs once.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

MASK = 0xFFFFFFFF


def _low(c: Column) -> Column:
    return c.bitwiseAND(F.lit(MASK).cast("long"))


def _fold(c: Column, bits: int) -> Column:
    return c.bitwiseXOR(F.shiftrightunsigned(c, bits))


def wang32(k: Column) -> Column:
    k = _low(k * 32767 + MASK)
    k = _low(_fold(k, 12) * 5)
    return _fold(_low(_fold(k, 4) * 2057), 16)


def times32(a: Column, b: Column) -> Column:
    """The product of two unsigned 32-bit numbers modulo 2**32, without overflow."""
    low = a.bitwiseAND(F.lit(0xFFFF).cast("long")) * b
    high = (F.shiftrightunsigned(a, 16) * b).bitwiseAND(F.lit(0xFFFF).cast("long")) * 65536
    return _low(low + high)


def hash32(key: Column, seed: Column | int) -> Column:
    """Hash of unsigned 32-bit numbers. A seed that is a plain small number needs no
    split product."""
    if isinstance(seed, int) and seed < 1 << 20:
        return wang32(_low(key * seed))
    return wang32(times32(key, F.lit(seed).cast("long") if isinstance(seed, int) else seed))


def fingerprint(features: Column) -> Column:
    """A number for a list of feature ids, folded in their order; null for null."""
    return F.aggregate(features, F.lit(0).cast("long"), lambda s, f: hash32(f + 1, s + 1))


def wang32_array(k: np.ndarray) -> np.ndarray:
    """The mix of an array of uint32."""
    k = k * np.uint32(32767) - np.uint32(1)
    k = (k ^ (k >> np.uint32(12))) * np.uint32(5)
    k = (k ^ (k >> np.uint32(4))) * np.uint32(2057)
    return k ^ (k >> np.uint32(16))


def hash32_array(key: np.ndarray, seed) -> np.ndarray:
    return wang32_array(key * np.asarray(seed, dtype=np.uint32))
