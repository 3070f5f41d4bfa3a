"""A bitmap of fixed size that lets a scan drop most rows which a later hash join would drop.

It can only let too much pass, never too little; the exact join follows. Its size does not depend
on the data (``BITS`` bits, 2 MB), so it may go to every task.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BITS = 1 << 24


def bitmap(keys: DataFrame, key: str) -> np.ndarray:
    """The bits of all values of the long column ``key``: at most BITS / 64 words reach the driver."""
    at = F.explode(F.array(F.pmod(F.col(key), F.lit(BITS)), F.pmod(F.shiftrightunsigned(key, 32), F.lit(BITS)))).alias("at")
    words = keys.select(at).groupBy(F.shiftright("at", 6).alias("w")).agg(F.bit_or(F.expr("shiftleft(1L, int(at & 63))")).alias("bits")).toArrow()
    out = np.zeros(BITS // 64, np.uint64)
    out[words.column("w").to_numpy()] = words.column("bits").to_numpy().view(np.uint64)
    return out


def maybe(bits: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """Which of the 64-bit keys may be among those of the bitmap."""
    k = keys.view(np.uint64)
    hit = np.ones(len(k), bool)
    for at in (k & np.uint64(BITS - 1), (k >> np.uint64(32)) & np.uint64(BITS - 1)):
        hit &= (bits[at >> np.uint64(6)] >> (at & np.uint64(63))) & np.uint64(1) == 1
    return hit
