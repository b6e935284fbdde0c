"""Places of rows in a global order, without bringing all rows into one task.

A sorted frame has its partitions in order, so a place is the place within the
partition plus the rows of the partitions before. Only their sizes are added up.
"""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from prefboard.session import materialise

#: A row number within its partition has so many bits in `monotonically_increasing_id`.
_BITS = 33


def numbered(ordered: DataFrame, into="place", first=1) -> DataFrame:
    """A sorted frame with the place of each row. It is written once."""
    spark, names = ordered.sparkSession, [c for c in ordered.columns if c != into]
    rows = materialise(ordered.select(*names, F.monotonically_increasing_id().alias("_row")), "sorted")
    part = F.shiftright("_row", _BITS)
    sizes = sorted(tuple(r) for r in rows.groupBy(part.alias("part")).agg(F.count(F.lit(1)).alias("n")).collect())
    before, at = [], first
    for number, size in sizes:  # one row per partition
        before.append((number, at))
        at += size
    starts = spark.createDataFrame(before, "_part long, _before long")
    placed = rows.withColumn("_part", part).join(F.broadcast(starts), "_part")
    place = F.col("_before") + F.col("_row").bitwiseAND(F.lit((1 << _BITS) - 1))
    return placed.select(*names, place.alias(into))


def places(df: DataFrame, groups, order: str, into="place", first=0) -> DataFrame:
    """`df` with the place of each row in the order of one column within its group.

    Rows of one group may lie in any number of partitions. Equal values have different
    places, in no order of their own.
    """
    ordered = df.orderBy(*groups, order)
    placed = materialise(numbered(ordered, "_place"), "placed")
    least = placed.groupBy(*groups).agg(F.min("_place").alias("_least"))
    shown = placed.join(least, list(groups)) if groups else placed.withColumn("_least", F.lit(1).cast("long"))
    return shown.select(*[c for c in df.columns if c != into], (F.col("_place") - F.col("_least") + first).alias(into))
