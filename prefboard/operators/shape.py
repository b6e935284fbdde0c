"""Shaping preference pairs: projections, dialogue forms and row filters."""

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from prefboard.functions import fixed
from prefboard.functions.text import message
from prefboard.operators.sampling import first_per_group


def require_columns(df: DataFrame, columns) -> None:
    """Fail with the names of the columns that `df` does not have."""
    missing = [c for c in columns if c not in df.columns]
    if missing:
        raise ValueError(f"column(s) not found: {', '.join(missing)}")


def project(df: DataFrame, columns, rename=None, drop=()) -> DataFrame:
    """Select, then rename, then drop."""
    require_columns(df, columns)
    return df.select(*columns).withColumnsRenamed(rename or {}).drop(*drop)


def language_side(df: DataFrame, english=False) -> DataFrame:
    """The target-language or the English texts of bilingual pairs."""
    prefix = "en_" if english else ""
    columns = ["id", "source", "language", f"{prefix}input", f"{prefix}chosen", f"{prefix}rejected"]
    names = {f"{prefix}input": "prompt", f"{prefix}chosen": "chosen", f"{prefix}rejected": "rejected"}
    return project(df, columns, names)


def _exchange(prompt, answer):
    return F.array(message("user", prompt), message("assistant", answer))


def to_turns(df: DataFrame) -> DataFrame:
    """`chosen` and `rejected` become user/assistant message lists."""
    return df.withColumns(
        {
            "chosen": _exchange(F.col("prompt"), F.col("chosen")),
            "rejected": _exchange(F.col("prompt"), F.col("rejected")),
        }
    )


def dialogues(df: DataFrame) -> DataFrame:
    """Adds `text_chosen` and `text_rejected` message lists.

    A string prompt becomes the user message; a prompt that is a message list
    already is continued with the answer.
    """
    several_turns = isinstance(df.schema["prompt"].dataType, T.ArrayType)

    def messages(answer):
        if several_turns:
            return F.concat(F.col("prompt"), F.array(message("assistant", F.col(answer))))
        return _exchange(F.col("prompt"), F.col(answer))

    return df.withColumns({"text_chosen": messages("chosen"), "text_rejected": messages("rejected")})


def keep_max_turns(df: DataFrame, max_turns: int) -> DataFrame:
    """Rows whose chosen dialogue has at most `max_turns` messages."""
    if max_turns <= 0:
        raise ValueError("max_turns must be greater than 0")
    return df.where(F.size("text_chosen") <= max_turns)


def is_code(subset="subset"):
    return F.startswith(F.col(subset), F.lit(fixed.CODE_PREFIX))


def route_code(df: DataFrame) -> DataFrame:
    """Adds `route`: code subsets have only their prompt translated."""
    return df.withColumn("route", F.when(is_code(), "prompt_only").otherwise("all_columns"))


def first_rows(df: DataFrame, n: int, order="position", groups=()) -> DataFrame:
    """The first `n` rows in input order, of all rows or of every group.

    A debugging sample. Over all rows every task keeps `n` of its own; by group the
    rows are cut by counts, so no group is ranked in one task.
    """
    return first_per_group(df, n, order, groups) if groups else df.orderBy(order).limit(n)


def drop_missing(df: DataFrame, subset=None) -> DataFrame:
    return df.dropna("any", subset=subset)


def exclude_value(df: DataFrame, column: str, value) -> DataFrame:
    """Rows whose column differs from `value`; null rows stay."""
    return df.where(~F.col(column).eqNullSafe(F.lit(value)))


def to_percent(df: DataFrame, columns=None) -> DataFrame:
    """Floating-point columns (or the named ones) times 100."""
    if columns is None:
        columns = [f.name for f in df.schema if isinstance(f.dataType, (T.DoubleType, T.FloatType))]
    return df.withColumns({c: F.col(c) * 100 for c in columns})


def strip_prefix(df: DataFrame, column: str, prefix: str) -> DataFrame:
    """Removes a leading `prefix` from the values of a column, once."""
    value = F.col(column)
    stripped = F.expr(f"substring(`{column}`, {len(prefix) + 1})")
    return df.withColumn(column, F.when(F.startswith(value, F.lit(prefix)), stripped).otherwise(value))


def keep_values(df: DataFrame, column: str, allowed) -> DataFrame:
    return df.where(F.col(column).isin(list(allowed)))


def bounds(df: DataFrame, columns) -> DataFrame:
    """Smallest and largest value over several columns, as one row."""
    lows, highs = [F.min(c) for c in columns], [F.max(c) for c in columns]
    return df.agg(F.least(*lows).alias("low"), F.greatest(*highs).alias("high"))


def value_counts(df: DataFrame, column: str) -> DataFrame:
    """Rows per value, most frequent first; nulls are left out."""
    counts = df.where(F.col(column).isNotNull()).groupBy(column).agg(F.count(F.lit(1)).alias("n"))
    return counts.orderBy(F.desc("n"), column)


def distinct_values(df: DataFrame, column: str) -> DataFrame:
    return df.select(column).distinct().orderBy(column)


def stack_frames(*frames: DataFrame) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b), frames)
