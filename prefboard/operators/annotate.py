"""Annotation tasks for humans and the agreement of their answers."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from prefboard.functions import metrics
from prefboard.functions.hashing import coin

HIDDEN = ["chosen_model", "rejected_model", "subset", "scores", "swapped"]


def answer_key(pairs: DataFrame, seed=0, keys=("language", "id")) -> DataFrame:
    """Completions in gold order (A is chosen) with the swap bit of every row."""
    renamed = pairs.withColumnsRenamed({"chosen": "completion_a", "rejected": "completion_b"})
    return renamed.withColumn("swapped", coin("swap", seed, *keys).cast("int"))


def annotation_task(key: DataFrame) -> DataFrame:
    """What annotators see: completions exchanged where swapped, origin hidden."""
    swap = F.col("swapped") == 1
    shown = key.withColumns(
        {
            "completion_a": F.when(swap, F.col("completion_b")).otherwise(F.col("completion_a")),
            "completion_b": F.when(swap, F.col("completion_a")).otherwise(F.col("completion_b")),
        }
    )
    return shown.drop(*HIDDEN)


def unswap(preference: Column, swapped: Column) -> Column:
    """A human answer in gold order; null stays null."""
    return (
        F.when((swapped == 1) & (preference == "A"), F.lit("B"))
        .when((swapped == 1) & (preference == "B"), F.lit("A"))
        .otherwise(preference)
    )


def join_annotations(key: DataFrame, annotations: DataFrame, drop_missing=False, keys=("language", "id")) -> DataFrame:
    """Answer key with human, gold and model preference per row.

    Translated pairs share ids, so an answer belongs to a language and an id.
    """
    answers = annotations.select(*keys, "human_preference", "notes")
    joined = key.join(answers, list(keys)).withColumns(
        {
            "gold_preference": F.lit("A"),
            "model_preference": F.when(F.col("scores") == 1, "A").otherwise("B"),
            "human_preference": unswap(F.col("human_preference"), F.col("swapped")),
        }
    )
    return joined.dropna("any", subset=["human_preference"]) if drop_missing else joined


def human_agreement(joined: DataFrame) -> DataFrame:
    """Three accuracies in one pass; a missing human answer counts as wrong."""
    gold = F.col("human_preference").eqNullSafe(F.col("gold_preference"))
    model = F.col("human_preference").eqNullSafe(F.col("model_preference"))
    decided = ~F.col("scores").eqNullSafe(F.lit(0.5))

    def among_decided(hit):
        return F.avg(F.when(decided, hit.cast("double")))

    return joined.agg(
        F.count(F.lit(1)).alias("n"),
        F.count_if(decided).alias("n_decided"),
        metrics.pct_correct(gold).alias("human_vs_gold"),
        among_decided(gold).alias("human_vs_gold_decided"),
        among_decided(model).alias("human_vs_model_decided"),
    )


def disagreements(joined: DataFrame) -> DataFrame:
    """Rows on which the human differs from gold or, where it decided, the model."""
    from_gold = ~F.col("human_preference").eqNullSafe(F.col("gold_preference"))
    from_model = ~F.col("scores").eqNullSafe(F.lit(0.5)) & ~F.col("human_preference").eqNullSafe(F.col("model_preference"))
    against = F.filter(
        F.array(F.when(from_gold, "gold"), F.when(from_model, "model")), lambda x: x.isNotNull()
    )
    return joined.withColumn("against", F.explode(against))
