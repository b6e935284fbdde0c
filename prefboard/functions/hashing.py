"""Repeatable pseudo-random bits and order keys from a seed and row keys.

`rand()` would change when a task is retried; md5 of seed and key does not. Every
use names its purpose, so uses that share a seed are still independent.
"""

from pyspark.sql import Column
from pyspark.sql import functions as F


def order_key(purpose, seed, *keys) -> Column:
    """Hex digest by which rows are put in random but repeatable order."""
    return F.md5(F.concat_ws(":", F.lit(purpose), F.lit(str(seed)), *[F.col(k).cast("string") for k in keys]))


def coin(purpose, seed, *keys) -> Column:
    """True for half of all keys."""
    return F.substring(order_key(purpose, seed, *keys), 1, 1) < F.lit("8")


def part(purpose, seed, parts, *keys) -> Column:
    """Number from 0 to `parts - 1` that splits all keys evenly."""
    return F.pmod(F.xxhash64(F.lit(purpose), F.lit(str(seed)), *keys), F.lit(parts))
