"""Small fixed tables as local relations."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from prefboard.functions import fixed


def _literal(value):
    if value is None:
        return "NULL"
    if isinstance(value, (int, float)):
        return str(value)
    return "'" + str(value).replace("\\", "\\\\").replace("'", "\\'") + "'"


def values_frame(spark: SparkSession, columns, rows) -> DataFrame:
    """A local relation from literal rows; its size is known to the optimizer."""
    body = ", ".join("(" + ", ".join(_literal(v) for v in row) + ")" for row in rows)
    return spark.sql(f"SELECT * FROM VALUES {body} AS t({', '.join(columns)})")


def subset_weights(spark: SparkSession) -> DataFrame:
    """`subset, category, weight` of the 23 weighted subsets, for broadcasting."""
    return F.broadcast(values_frame(spark, ["subset", "category", "weight"], fixed.SUBSETS))


def category_sizes(spark: SparkSession) -> DataFrame:
    """`category, n_subsets` of the four categories, for broadcasting."""
    names = [category for _, category, _ in fixed.SUBSETS]
    rows = [(category, names.count(category)) for category in fixed.CATEGORIES]
    return F.broadcast(values_frame(spark, ["category", "n_subsets"], rows))
