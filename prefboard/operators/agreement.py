"""Cohen's kappa between a language and English, and its distributions.

Labels are long rows `model, language, instance_id, label`; (model, language,
instance_id) is their key.
"""

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from prefboard.functions import fixed, metrics


def labels_side_by_side(labels: DataFrame, languages) -> DataFrame:
    """One row per instance and model with a label column per language.

    The aggregation combines before the exchange, so copies of a row and an
    instance that is repeated very often shrink in the tasks that read them. Rows
    of one key with different labels fail the job.
    Models without an English label of the instance are left out.
    """

    def label_in(code):
        label = F.when(F.col("language") == code, F.col("label"))
        unclear = F.raise_error(
            F.concat(F.lit(f"different labels in {code} of "), F.col("model"), F.lit(" for "), F.col("instance_id").cast("string"))
        )
        return F.when(F.min(label) == F.max(label), F.max(label)).when(F.min(label).isNotNull(), unclear.cast("int")).alias(code)

    known = labels.where(F.col("label").isin(*metrics.LABELS))
    wide = known.groupBy("instance_id", "model").agg(*[label_in(code) for code in languages])
    return wide.where(F.col(fixed.ENGLISH).isNotNull())


def _pairs_with_english(wide, languages):
    """Long pairs of a language's label and the English one.

    Laid out within the row: unlike an unpivot, this keeps the partitioning.
    """
    cells = ", ".join(
        f"named_struct('language', '{code}', 'label', `{code}`)" for code in languages if code != fixed.ENGLISH
    )
    long = wide.selectExpr("instance_id", "model", f"{fixed.ENGLISH} as label_eng", f"inline(array({cells}))")
    return long.where(F.col("label").isNotNull())


def label_pairs(labels: DataFrame, languages) -> DataFrame:
    """Each non-English label next to the model's English label; no self-join."""
    return _pairs_with_english(labels_side_by_side(labels, languages), languages)


def kappa_by(pairs: DataFrame, *keys) -> DataFrame:
    """Kappa of `label` and `label_eng` per group; null where it is undefined."""
    sums = pairs.groupBy(*keys).agg(*metrics.kappa_sums(F.col("label"), F.col("label_eng")))
    return sums.select(*keys, metrics.kappa_from_sums().alias("kappa"))


def instance_kappa(labels: DataFrame, languages) -> DataFrame:
    """Agreement of all models' labels in a language with English, per instance.

    An instance has at most one row per model by now. Bringing these compact rows
    together by instance moves far less than counters per instance and language
    would, and the aggregation behind it needs no exchange of its own.
    """
    together = labels_side_by_side(labels, languages).repartition("instance_id")
    pairs = _pairs_with_english(together, languages)
    return kappa_by(pairs, "instance_id", "language").where(F.col("kappa").isNotNull())


def model_kappa(labels: DataFrame, languages) -> DataFrame:
    """Agreement over all instances, per model and language."""
    return kappa_by(label_pairs(labels, languages), "model", "language").where(F.col("kappa").isNotNull())


def innermodel_agreement(labels: DataFrame, languages) -> DataFrame:
    """Mean and deviation over languages of each model's kappa, lowest first."""
    return (
        model_kappa(labels, languages)
        .groupBy("model")
        .agg(F.avg("kappa").alias("mean_kappa"), F.stddev_samp("kappa").alias("std_kappa"))
        .orderBy("mean_kappa", "model")
    )


def kappa_with_pairs(kappa: DataFrame, pairs: DataFrame) -> DataFrame:
    """Kappa joined to the pair texts of the same language; ids compare as text."""
    keyed = kappa.withColumn("instance_id", F.col("instance_id").cast("string"))
    texts = pairs.select(
        F.col("id").cast("string").alias("instance_id"), "language", "subset", "prompt", "chosen", "rejected"
    )
    return keyed.join(texts, ["language", "instance_id"])


def _bin(width):
    """Bin of a value in [-1, 1]; the last bin is closed."""
    n_bins = round(2.0 / width)
    place = F.floor((F.col("kappa") + 1.0) / F.lit(width)).cast("int")
    return F.least(place, F.lit(n_bins - 1))


def kappa_histogram(kappa: DataFrame, width=0.1) -> DataFrame:
    """Instances per kappa bin and language."""
    return (
        kappa.groupBy("language", _bin(width).alias("bin"))
        .agg(F.count(F.lit(1)).alias("n"))
        .withColumn("low", F.col("bin") * F.lit(width) - 1.0)
    )


def category_share(kappa: DataFrame, width=0.1) -> DataFrame:
    """Share of each category in every bin.

    The window runs over the counts (bins x categories), not over instances.
    """
    counts = kappa.groupBy("language", _bin(width).alias("bin"), "category").agg(F.count(F.lit(1)).alias("n"))
    in_bin = F.sum("n").over(W.partitionBy("language", "bin"))
    return counts.withColumn("share", F.col("n") / in_bin)


def with_category(frame: DataFrame, weights: DataFrame) -> DataFrame:
    """Adds the category of `subset`; null for subsets outside the table."""
    return frame.join(weights.select("subset", "category"), "subset", "left")
