"""Registry of queries and their SQL counterparts."""

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from prefboard.plans.views import using

QUERIES = {}
ORACLE = {}


def query(name, views="", sql=None):
    """Registers a `(spark, folder) -> DataFrame` function; `sql` may use `views`."""

    def register(function):
        QUERIES[name] = function
        if sql is not None:
            ORACLE[name] = using(views, sql)
        return function

    return register


def placed(ordered):
    """A sorted board, of one row per model, with the `place` of each row, so that its order is compared too."""
    numbered = ordered.withColumn("_order", F.monotonically_increasing_id())
    return numbered.withColumn("place", F.row_number().over(W.orderBy("_order"))).drop("_order")


def r6(column, name=None):
    """A double rounded to six digits, as the SQL side does."""
    column = F.col(column) if isinstance(column, str) else column
    rounded = F.round(column, 6)
    return rounded.alias(name) if name else rounded
