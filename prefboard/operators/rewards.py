"""Scalar rewards: scoring job, wins, statistics and histogram."""

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from prefboard.functions.portions import joined, portions


def win(chosen="chosen", rejected="rejected") -> Column:
    """1 when the chosen score is larger, else 0; ties, nulls and NaN lose."""
    both = ~F.isnan(chosen) & ~F.isnan(rejected)
    return F.when(both & (F.col(chosen) > F.col(rejected)), 1).otherwise(0)


def with_wins(scores: DataFrame) -> DataFrame:
    return scores.withColumn("result", win())


def reward_stats(scores: DataFrame) -> DataFrame:
    """Mean and population deviation of both scores, mean margin and accuracy."""
    return scores.agg(
        F.count(F.lit(1)).alias("n"),
        F.avg("chosen").alias("mean_chosen"),
        F.stddev_pop("chosen").alias("std_chosen"),
        F.avg("rejected").alias("mean_rejected"),
        F.stddev_pop("rejected").alias("std_rejected"),
        F.avg(F.col("chosen") - F.col("rejected")).alias("mean_margin"),
        F.avg(win()).alias("accuracy"),
    )


def reward_histogram(scores: DataFrame, bins=30) -> DataFrame:
    """Counts of `bins` equal bins between each column's own minimum and maximum.

    The bounds are one row per column; the binned rows are counted per task before
    the exchange. Bins are half-open, the last one is closed; a value next to an
    edge is placed by comparison with the edge itself, as NumPy does. A column
    with a single value gets a range of one around it.
    """
    columns = ["chosen", "rejected"]
    long = scores.unpivot([], columns, "side", "score").where(
        F.col("score").isNotNull() & ~F.isnan("score")
    )
    ends = long.groupBy("side").agg(F.min("score").alias("lowest"), F.max("score").alias("highest"))
    flat = F.col("lowest") == F.col("highest")
    ends = ends.select(
        "side",
        F.when(flat, F.col("lowest") - 0.5).otherwise(F.col("lowest")).alias("low"),
        F.when(flat, F.col("highest") + 0.5).otherwise(F.col("highest")).alias("high"),
    )
    # two rows, one per score column
    ranged = long.join(F.broadcast(ends), "side")
    step = (F.col("high") - F.col("low")) / bins
    share = (F.col("score") - F.col("low")) / (F.col("high") - F.col("low"))
    ranged = ranged.withColumns(
        {"step": step, "bin": F.least(F.floor(share * bins).cast("int"), F.lit(bins - 1))}
    )

    def edge(number):
        return number * F.col("step") + F.col("low")

    below = F.col("score") < edge(F.col("bin"))
    above = (F.col("score") >= edge(F.col("bin") + 1)) & (F.col("bin") < bins - 1)
    ranged = ranged.withColumn("bin", F.col("bin") - below.cast("int") + above.cast("int"))
    return ranged.groupBy("side", "bin").agg(
        F.count(F.lit(1)).alias("n"), F.min(edge(F.col("bin"))).alias("bin_low")
    )


def _scoring(scorer):
    """Column function: dialogue -> score, null where the scorer gives none or NaN."""

    def scored(dialogues):
        batch = [[{"role": m["role"], "content": m["content"]} for m in dialogue] for dialogue in dialogues]
        scores = np.asarray(scorer(batch), dtype="float64")
        if scores.shape != (len(batch),):
            raise ValueError("the scorer must return one number per dialogue")
        return scores

    @F.arrow_udf(returnType=T.DoubleType())
    def score(dialogues: pa.Array) -> pa.Array:
        return joined((scored(part) for (part,) in portions(dialogues)), pa.float64())

    return score


def score_pairs(df: DataFrame, scorer) -> DataFrame:
    """Scores both dialogues of every pair with `scorer(dialogues) -> numbers`.

    A dialogue is a list of messages with `role` and `content`. Only the two
    dialogue columns travel to Python; both calls share one crossing, in which the
    scorer gets a part of the batch at a time. Adds `chosen_score`, `rejected_score`
    and `result`.
    """
    call = _scoring(scorer).asNondeterministic()
    scored = df.withColumns({"chosen_score": call("text_chosen"), "rejected_score": call("text_rejected")})
    return scored.withColumn("result", win("chosen_score", "rejected_score"))


def length_scorer(dialogues):
    """A rule-based scorer for tests: characters of the last message."""
    return [float(len(dialogue[-1]["content"])) for dialogue in dialogues]
