"""A bitmap of fixed size that tells which 64-bit hashes cannot be in a set.

It is the one thing about a set of any size that may be sent to every task: its
size is a parameter, not a matter of the data. It never denies a member. The more
members it has, the more other hashes it lets through, so it may only save work.
"""

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: 8 MB.
BITS = 1 << 26


def bitmap_of(hashes: DataFrame, bits=BITS) -> np.ndarray:
    """Bitmap of the one column of `hashes` (long); `bits` is a power of two.

    The driver gets one row per 64 bits at most.
    """
    h = F.col(hashes.columns[0])
    shift = 64 - (bits.bit_length() - 1)
    places = hashes.select(F.explode(F.array(h.bitwiseAND(F.lit(bits - 1)), F.shiftrightunsigned(h, shift))).alias("p"))
    words = places.groupBy(F.shiftright("p", 6).alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, cast(p & 63 as int))")).alias("bits"))
    rows = words.where("word is not null").toArrow()
    out = np.zeros(bits >> 6, np.uint64)
    out[rows.column("word").to_numpy()] = rows.column("bits").to_numpy().view(np.uint64)
    return out


def possible(bitmap: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """True where an unsigned 64-bit hash may be a member."""
    bits = len(bitmap) << 6
    low, high = hashes & np.uint64(bits - 1), hashes >> np.uint64(64 - (bits.bit_length() - 1))
    one = np.uint64(1)
    both = [bitmap[(p >> np.uint64(6)).astype(np.int64)] >> (p & np.uint64(63)) & one for p in (low, high)]
    return (both[0] & both[1]).astype(bool)
