"""Leaderboards over models and languages, and what is computed from them.

Input of most operators is the long frame `model, model_type, language, category,
score`, where `category` is `Overall` or one of the four categories. It holds one
row per run and category, however many instances were scored.
"""

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from prefboard.functions import fixed, metrics
from prefboard.operators import ranking
from prefboard.session import materialise

ENGLISH = fixed.ENGLISH


def board(long: DataFrame, languages) -> DataFrame:
    """Average, standard deviation and English score per model and category.

    `languages` lists the languages of the evaluation. English stays out of the
    average and the deviation; both are null when a model misses a language. The
    published deviation takes the average as one more value with one degree of
    freedom less, which equals the population deviation of the language scores.
    """
    others = [code for code in languages if code != ENGLISH]
    score = F.when(F.col("language").isin(others), F.col("score"))
    present = F.count(score)
    return long.groupBy("category", "model").agg(
        F.min_by("model_type", "language").alias("model_type"),
        F.max(F.when(F.col("language") == ENGLISH, F.col("score"))).alias("eng_Latn"),
        metrics.complete_only(F.avg(score), present, len(others)).alias("avg_multilingual"),
        metrics.complete_only(F.stddev_pop(score), present, len(others)).alias("std"),
    )


def wide_board(long: DataFrame, languages) -> DataFrame:
    """The published layout, `model, model_type, avg, std` and a column per language.

    Averages and language columns come from one aggregation.
    """
    others = [code for code in languages if code != ENGLISH]
    score = F.when(F.col("language").isin(others), F.col("score"))
    present = F.count(score)
    return long.groupBy("model").agg(
        F.min_by("model_type", "language").alias("model_type"),
        metrics.complete_only(F.avg(score), present, len(others)).alias("avg"),
        metrics.complete_only(F.stddev_pop(score), present, len(others)).alias("std"),
        *[F.max(F.when(F.col("language") == code, F.col("score"))).alias(code) for code in languages],
    )


def sorted_board(frame: DataFrame) -> DataFrame:
    """By model type, then average, both descending."""
    return frame.orderBy(F.desc("model_type"), F.desc_nulls_last("avg_multilingual"), "model")


def sort_scores(frame: DataFrame, column: str, ascending=False, ties=("model",)) -> DataFrame:
    """By one score column; nulls last, equal scores by the `ties` columns."""
    order = F.asc_nulls_last(column) if ascending else F.desc_nulls_last(column)
    return frame.orderBy(order, *ties)


def pivot_languages(long: DataFrame, languages) -> DataFrame:
    """Models as rows, languages as columns; a missing run is null."""
    return long.groupBy("model").pivot("language", list(languages)).agg(F.max("score"))


def align_languages(long: DataFrame, languages) -> DataFrame:
    """Full outer alignment of the languages' model lists, with the model type."""
    return (
        long.groupBy("model")
        .pivot("language", list(languages))
        .agg(F.max("score").alias("score"), F.max("model_type").alias("model_type"))
    )


def unpivot_languages(wide: DataFrame, languages, keys=("model",)) -> DataFrame:
    """Languages as rows; missing scores are left out."""
    return wide.unpivot(list(keys), list(languages), "language", "score").where(F.col("score").isNotNull())


def long_from_wide(wide: DataFrame, languages, category="Overall") -> DataFrame:
    """A published wide leaderboard as long `model, model_type, language, category, score`."""
    long = unpivot_languages(wide, languages, ("model", "model_type"))
    return long.withColumn("category", F.lit(category))


def order_columns(wide: DataFrame, languages, first=("model", "avg")) -> DataFrame:
    """Leading columns, then the language columns in alphabetical order."""
    return wide.select(*first, *sorted(languages))


def top_models(frame: DataFrame, n=10, by="avg_multilingual") -> DataFrame:
    """The `n` best models."""
    return sort_scores(frame, by).limit(n)


def top_in_order(frame: DataFrame, n: int, order) -> DataFrame:
    """The first `n` rows by an explicit order."""
    return frame.orderBy(*order).limit(n)


def english_drop(frame: DataFrame) -> DataFrame:
    """(average - English) / English * 100, without models that miss either."""
    drop = (F.col("avg_multilingual") - F.col("eng_Latn")) / F.nullif("eng_Latn", F.lit(0.0)) * 100
    return frame.withColumn("drop_pct", drop).where(F.col("drop_pct").isNotNull())


def english_drop_table(frame: DataFrame) -> DataFrame:
    """Drop per model, overall and per category, in one aggregation."""
    drops = english_drop(frame)
    columns = {"Overall": "overall", "Chat": "chat", "Chat Hard": "chat_hard", "Safety": "safety", "Reasoning": "reasoning"}
    return drops.groupBy("model").agg(
        *[F.max(F.when(F.col("category") == c, F.col("drop_pct"))).alias(name) for c, name in columns.items()]
    )


def extremes(frame: DataFrame, by: str, n=3) -> DataFrame:
    """The `n` smallest rows, then the `n` largest, marked in `section`."""
    known = frame.where(F.col(by).isNotNull())
    lowest = known.orderBy(F.asc(by), "model").limit(n).withColumn("section", F.lit("lowest"))
    highest = known.orderBy(F.desc(by), "model").limit(n).withColumn("section", F.lit("highest"))
    return lowest.unionByName(highest)


def english_delta(frame: DataFrame, sign=1) -> DataFrame:
    """English minus average in percentage points; `sign=-1` turns it round."""
    complete = frame.dropna("any", subset=["eng_Latn", "avg_multilingual"])
    delta = (F.col("eng_Latn") - F.col("avg_multilingual")) * 100 * sign
    return complete.withColumn("delta", delta)


def category_deltas(frame: DataFrame) -> DataFrame:
    """Average minus English per category, side by side, for each model."""
    delta = (F.col("avg_multilingual") - F.col("eng_Latn")) * 100
    columns = {"Chat": "chat", "Chat Hard": "chat_hard", "Safety": "safety", "Reasoning": "reasoning"}
    return frame.groupBy("model").agg(
        *[F.max(F.when(F.col("category") == c, delta)).alias(name) for c, name in columns.items()]
    )


def pearson(frame: DataFrame, first="eng_Latn", second="avg_multilingual") -> DataFrame:
    complete = frame.dropna("any", subset=[first, second])
    return complete.agg(F.corr(first, second).alias("pearson"))


def _average_ranks(frame: DataFrame, column: str, into: str) -> DataFrame:
    """Values of a column with their ranks: the mean of the places that equal ones take."""
    placed = ranking.numbered(frame.select(column).orderBy(column), "_place")
    return placed.groupBy(column).agg(F.avg("_place").alias(into))


def spearman(frame: DataFrame, first="eng_Latn", second="avg_multilingual") -> DataFrame:
    """Rank correlation with average ranks; rows that miss a value are left out. Null where
    all ranks are equal.

    Rows are ordered over many tasks, and equal values share one row of the ranks.
    """
    complete = materialise(frame.dropna("any", subset=[first, second]).select(first, second), "complete")
    ranked = complete.join(_average_ranks(complete, first, "_r1"), first)
    ranked = ranked.join(_average_ranks(complete, second, "_r2"), second)
    spread = F.stddev_pop("_r1") * F.stddev_pop("_r2")
    return ranked.agg(F.try_divide(F.covar_pop("_r1", "_r2"), spread).alias("spearman"))


def merge_scripts(long: DataFrame) -> DataFrame:
    """The two Chinese scripts as one language `zho` with the mean of their scores."""
    language = F.when(F.col("language").isin("zho_Hans", "zho_Hant"), "zho").otherwise(F.col("language"))
    return (
        long.withColumn("language", language)
        .groupBy("category", "model", "language")
        .agg(F.avg("score").alias("score"))
    )


def language_variance(long: DataFrame) -> DataFrame:
    """Sample variance of a model's scores over the non-English languages, in percent."""
    merged = merge_scripts(long).where(F.col("language") != ENGLISH)
    return merged.groupBy("category", "model").agg(F.var_samp(F.col("score") * 100).alias("variance"))


def language_stats(long: DataFrame) -> DataFrame:
    """Mean and sample deviation over models, per non-English language, in percent."""
    return (
        long.where(F.col("language") != ENGLISH)
        .groupBy("category", "language")
        .agg((F.avg("score") * 100).alias("avg"), (F.stddev_samp("score") * 100).alias("std"))
    )


def with_language_metadata(frame: DataFrame, metadata: DataFrame) -> DataFrame:
    """Adds resource class, family and script; languages without metadata drop out."""
    columns = ["language", "resource_type", "family", "script"]
    return frame.join(metadata.select(*columns), "language")


def linguistic_dimensions(stats: DataFrame) -> DataFrame:
    """Mean of language means and deviations per resource class, family and script.

    Class-0 languages are left out. One pass with grouping sets; rows whose key is
    null are dropped.
    """
    kept = stats.where(~F.col("resource_type").eqNullSafe(F.lit("Class-0")))
    sets = [[F.col("resource_type")], [F.col("family")], [F.col("script")]]
    rolled = kept.groupingSets(sets, "resource_type", "family", "script").agg(
        F.avg("avg").alias("avg"), F.avg("std").alias("std"), F.grouping_id("resource_type", "family", "script").alias("g")
    )
    dimension = F.when(F.col("g") == 3, "resource_type").when(F.col("g") == 5, "family").otherwise("script")
    value = F.coalesce("resource_type", "family", "script")
    return rolled.select(dimension.alias("dimension"), value.alias("value"), "avg", "std").where(
        F.col("value").isNotNull()
    )


def compare_systems(first: DataFrame, second: DataFrame, names) -> DataFrame:
    """Averages of two translation systems; models and types of the first are kept."""
    left = first.select("model", "model_type", F.col("avg_multilingual").alias(names[0]))
    right = second.select("model", F.col("avg_multilingual").alias(names[1]))
    return left.join(right, "model", "left")


def order_by_list(frame: DataFrame, column: str, values) -> DataFrame:
    """Rows whose value is in the list, sorted by its place in the list."""
    order = F.array(*[F.lit(v) for v in values])
    place = F.array_position(order, F.col(column))
    return frame.where(F.col(column).isin(list(values))).orderBy(place)
