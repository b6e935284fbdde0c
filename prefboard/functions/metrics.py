"""Aggregate expressions shared by the operators."""

from pyspark.sql import Column
from pyspark.sql import functions as F

LABELS = (0, 1, 2)


def pct_correct(hit: Column) -> Column:
    """Share of rows for which `hit` is true; null counts as a miss."""
    return F.avg(F.when(hit, 1.0).otherwise(0.0))


def kappa_sums(first: Column, second: Column):
    """Integer sums from which Cohen's kappa of two label columns follows."""
    sums = [F.count(F.lit(1)).alias("n"), F.count_if(first == second).alias("agreed")]
    for k in LABELS:
        sums.append(F.count_if(first == k).alias(f"a{k}"))
        sums.append(F.count_if(second == k).alias(f"b{k}"))
    return sums


def kappa_from_sums() -> Column:
    """(p_o - p_e) / (1 - p_e) over integers; null where p_e is 1."""
    chance = sum((F.col(f"a{k}") * F.col(f"b{k}") for k in LABELS[1:]), F.col("a0") * F.col("b0"))
    square = F.col("n") * F.col("n")
    return F.when(
        square != chance,
        (F.col("n") * F.col("agreed") - chance).cast("double") / (square - chance).cast("double"),
    )


def complete_only(value: Column, present: Column, expected: int) -> Column:
    """`value`, or null when fewer than `expected` entries were present."""
    return F.when(present == expected, value)
