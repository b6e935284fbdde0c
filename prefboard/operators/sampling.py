"""Exact, repeatable samples that need no single task to see a whole stratum.

Rows are ordered by an md5 key of seed and row key. The first rows of a stratum
are found by the leading digits of the key, in rounds of three digits: counts per
bucket give the bucket in which the last row to take falls; all rows of earlier
buckets are taken, and only that bucket goes into the next round, with three more
digits. After three rounds a stratum of 10^11 rows has one or two rows left to
rank. Every round works alike, whatever the sizes.
"""

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from prefboard.functions.hashing import order_key
from prefboard.session import materialise

ROUNDS = (3, 6, 9)


def take_first(keyed: DataFrame, by, key, caps: DataFrame, ties=(), name="border", rounds=ROUNDS) -> DataFrame:
    """The first `_cap` rows of every stratum `by` in the order of `key`.

    `keyed` is read once per round and should be repeatable; `key` is a column of
    hexadecimal digits, of which each of the `rounds` looks at some more, and `ties` are
    the columns that decide between equal keys.
    `caps` has one row per stratum. Rows are joined on stratum and bucket, so no
    stratum is one hot key.
    """
    columns = keyed.columns
    rows, room, taken = keyed, caps.select(*by, F.col("_cap").alias("_room")), []
    for digits in rounds:
        placed = rows.withColumn("_bucket", F.substring(key, 1, digits))
        sizes = placed.groupBy(*by, "_bucket").agg(F.count(F.lit(1)).alias("_size"))
        upto = F.sum("_size").over(W.partitionBy(*by).orderBy("_bucket"))
        running = sizes.withColumn("_upto", upto).join(room, list(by))
        reached = running.where(F.col("_upto") - F.col("_size") < F.col("_room"))
        reached = materialise(
            reached.select(
                *by,
                "_bucket",
                (F.col("_upto") <= F.col("_room")).alias("_whole"),
                (F.col("_room") - F.col("_upto") + F.col("_size")).alias("_left"),
            ),
            f"{name}-buckets",
        )
        marked = placed.join(reached, [*by, "_bucket"])
        taken.append(marked.where("_whole").select(*columns))
        rows = materialise(marked.where("not _whole").select(*columns), name)
        room = reached.where("not _whole").select(*by, F.col("_left").alias("_room"))
        if rows.isEmpty():
            return reduce(DataFrame.unionByName, taken)
    rank = F.row_number().over(W.partitionBy(*by).orderBy(key, *ties))
    last = rows.withColumn("_rank", rank).join(room, list(by)).where(F.col("_rank") <= F.col("_room"))
    return reduce(DataFrame.unionByName, [*taken, last.select(*columns)])


def _sample(df: DataFrame, groups, strata, cap, keys, seed) -> DataFrame:
    """First rows by hash per (groups, strata); `cap` is an expression over `n`
    (rows of the stratum), `k` (strata in the group) and the smallest stratum."""
    rows = df.dropna("any", subset=strata) if strata else df
    if not groups:
        rows, groups = rows.withColumn("_all", F.lit(0)), ["_all"]
    by = [*groups, *strata]
    keyed = rows.withColumn("_key", order_key("sample", seed, *keys))
    totals = keyed.groupBy(*by).agg(F.count(F.lit(1)).alias("n"))
    in_group = W.partitionBy(*groups)
    caps = totals.select(
        *by, cap(F.col("n"), F.count(F.lit(1)).over(in_group), F.min("n").over(in_group)).alias("_cap")
    )
    return take_first(keyed, by, F.col("_key"), caps, keys, "sample").select(*df.columns)


def stratified_sample(df: DataFrame, n: int, column="scores", groups=("language",), keys=("language", "id"), seed=42):
    """Equally many rows per value of `column` in every group.

    A group with k values gives min(n // k, rows of its rarest value) of each;
    rows without a value are left out.
    """
    return _sample(
        df,
        list(groups),
        [column],
        lambda rows, k, smallest: F.least(F.floor(F.lit(n) / k), smallest),
        list(keys),
        seed,
    )


def random_subset(df: DataFrame, size: int, groups=("language",), keys=("language", "id"), seed=42):
    """`min(size, rows)` rows of every group, without replacement."""
    return _sample(df, list(groups), [], lambda rows, k, smallest: F.least(F.lit(size), rows), list(keys), seed)


#: Rounds over the digits of `_number_digits`: sign, length and three digits, then three more each.
NUMBER_ROUNDS = (5, 8, 11, 14, 18, 24, 31)


def _number_digits(number):
    """Hexadecimal digits that are in the order of the numbers; null comes last.

    Sign and length stand in front of the digits, so a few of them tell small numbers
    apart whatever the largest one is. Numbers with a fraction have 13 digits for it
    behind; beyond the range of 64 bits they keep their order as the ends of it.
    """
    whole = F.floor(number).cast("long")
    size = F.when(whole >= 0, whole).otherwise(-(whole + 1))
    digits = F.lower(F.hex(size))
    shown = F.concat(F.lower(F.hex(F.length(digits) - 1)), digits)
    below = F.translate(shown, "0123456789abcdef", "fedcba9876543210")
    ordered = F.when(whole >= 0, F.concat(F.lit("1"), shown)).otherwise(F.concat(F.lit("0"), below))
    fraction = F.floor((number.cast("double") - F.floor(number.cast("double"))) * F.lit(16.0**13)).cast("long")
    behind = F.lpad(F.lower(F.hex(fraction)), 13, "0")
    return F.coalesce(F.concat(F.rpad(ordered, 18, "0"), behind), F.lit("2"))


def first_per_group(df: DataFrame, n: int, order: str, groups) -> DataFrame:
    """The first `n` rows of every group by the number `order`; nulls come last.

    Rounds over the digits of the number find the border: counts of one round give the
    bucket that the next looks into, wherever the smallest and the largest number are,
    so a group is never ranked as a whole. Of rows with the border's number as many are
    taken as fit.
    """
    whole_number = df.schema[order].dataType.typeName() in ("byte", "short", "integer", "long")
    rounds = NUMBER_ROUNDS[:5] if whole_number else NUMBER_ROUNDS
    keyed = df.withColumn("_key", _number_digits(F.col(order)))
    caps = keyed.select(*groups).distinct().withColumn("_cap", F.lit(n))
    return take_first(keyed, list(groups), F.col("_key"), caps, [F.asc_nulls_last(order)], "first", rounds).select(*df.columns)
