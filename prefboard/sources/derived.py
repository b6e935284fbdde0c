"""Preference data derived by Spark from the benchmark tables.

Every frame is a narrow projection of a stored table (plus literal dimensions),
so its size grows with the table and column pruning reaches the Parquet scan.
"""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from prefboard.functions import fixed, lookups

# language, document language, language name, resource class, family, script
LANGUAGES = [
    ("eng_Latn", "en", "English", "Class-5", "Indo-European", "Latin"),
    ("deu_Latn", "de", "German", "Class-5", "Indo-European", "Latin"),
    ("fra_Latn", "fr", "French", "Class-5", "Indo-European", "Latin"),
    ("spa_Latn", "es", "Spanish", "Class-5", "Indo-European", "Latin"),
    ("zho_Hans", None, "Chinese_Simplified", "Class-4", "Sino-Tibetan", "Han"),
    ("zho_Hant", None, "Chinese_Traditional", "Class-0", "Sino-Tibetan", "Han"),
]
LANGUAGE_CODES = [row[0] for row in LANGUAGES]
MODELS = [
    ("org/model-0", "Generative RM"),
    ("org/model-1", "Generative RM"),
    ("org/model-2", "Generative RM"),
    ("org/model-3", "Generative RM"),
    ("org/model-4", "DPO"),
    ("org/model-5", "DPO"),
    ("org/model-6", "Sequence Classifier"),
    ("org/model-7", "Sequence Classifier"),
]
# the language of translated annotation tasks
TRANSLATED = "zho_Hans"
# model 7 has no Spanish rows: its strict average must be null
ABSENT = ("org/model-7", "spa_Latn")

# Model names as they are passed to a run; some are known to a provider or to
# the display-name table, some to neither.
RUN_MODELS = [
    "openai/gpt-4-turbo-2024-04-09",
    "google/gemma-2-9b-it",
    "meta-llama/Meta-Llama-3.1-70B-Instruct",
    "CIR-AMS/BTRM_Qwen2_7b_0613",
    "cohere/c4ai-aya-23-35b",
    "gpt-4o-2024-05-13",
    "claude-3-haiku-20240307",
    "gemini-1.5-pro-001",
    "command-r-plus",
    "prometheus-eval/prometheus-7b-v2.0",
    "THUDM/glm-4-9b-chat",
    "org/unlisted-model",
]


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def language_dimension(spark: SparkSession) -> DataFrame:
    rows = [(i, *row) for i, row in enumerate(LANGUAGES)]
    columns = ["lang_idx", "language", "doc_lang", "language_name", "resource_type", "family", "script"]
    return F.broadcast(lookups.values_frame(spark, columns, rows))


def subset_dimension(spark: SparkSession) -> DataFrame:
    rows = [(i, *row) for i, row in enumerate(fixed.SUBSETS)]
    return F.broadcast(lookups.values_frame(spark, ["subset_idx", "subset", "category", "weight"], rows))


def pairs(spark: SparkSession, folder: str) -> DataFrame:
    """Preference pairs cut from whole documents.

    The first third of a document is the prompt. The answers are the remaining
    two thirds, the middle third or the last third, depending on the id.
    """
    docs = table(spark, folder, "documents")
    languages = language_dimension(spark).select("language", "doc_lang")
    subsets = subset_dimension(spark).select("subset_idx", "subset")
    third = "length(text) div 3"
    rest = f"substring(text, {third} + 1)"
    return (
        docs.join(languages, docs.lang == languages.doc_lang)
        .join(subsets, docs.doc_id % len(fixed.SUBSETS) == subsets.subset_idx)
        .select(
            F.col("doc_id").alias("id"),
            F.col("doc_id").alias("position"),
            "language",
            "subset",
            F.expr(f"substring(text, 1, {third})").alias("prompt"),
            F.expr(
                f"case when doc_id % 2 = 0 then {rest} else substring(text, {third} + 1, {third}) end"
            ).alias("chosen"),
            F.expr(f"case when doc_id % 3 = 0 then {rest} else substring(text, 2 * ({third}) + 1) end").alias(
                "rejected"
            ),
            F.col("source").alias("chosen_model"),
            F.concat(F.lit("alt-"), "source").alias("rejected_model"),
        )
    )


def bilingual_pairs(spark: SparkSession, folder: str) -> DataFrame:
    """Pairs with the same texts in an English and a target-language column."""
    return pairs(spark, folder).select(
        "id",
        F.col("chosen_model").alias("source"),
        "language",
        F.col("prompt").alias("input"),
        "chosen",
        "rejected",
        *[
            F.concat(F.lit("EN: "), column).alias(name)
            for column, name in (("prompt", "en_input"), ("chosen", "en_chosen"), ("rejected", "en_rejected"))
        ],
    )


def judgements(spark: SparkSession, folder: str) -> DataFrame:
    """Results of every model in every language for every document."""
    grid = ", ".join(
        f"named_struct('model', '{model}', 'model_type', '{model_type}', 'language', '{language}', "
        f"'model_idx', {m}, 'lang_idx', {n})"
        for m, (model, model_type) in enumerate(MODELS)
        for n, language in enumerate(LANGUAGE_CODES)
        if (model, language) != ABSENT
    )
    docs = table(spark, folder, "documents").select("doc_id")
    subsets = subset_dimension(spark).drop("weight")
    placed = docs.join(subsets, docs.doc_id % len(fixed.SUBSETS) == subsets.subset_idx)
    cells = placed.selectExpr("doc_id", "subset", "category", f"inline(array({grid}))")
    h = "(doc_id * 7 + model_idx * 3 + (doc_id % 17) * (lang_idx + 2) + (doc_id % 13) * model_idx) % 10"
    return cells.withColumn("h", F.expr(h)).select(
        "model",
        "model_type",
        "language",
        F.col("doc_id").alias("instance_id"),
        "subset",
        "category",
        F.expr("case when h < 6 then 1.0d when h < 9 then 0.0d else 0.5d end").alias("result"),
        F.expr("case when h < 6 then 2 when h < 9 then 0 else 1 end").alias("label"),
    )


def rewards(spark: SparkSession, folder: str) -> DataFrame:
    """Scalar scores of the chosen and the rejected answer of every document."""
    return table(spark, folder, "documents").select(
        F.col("doc_id").alias("id"),
        F.expr("cast((doc_id * 37 + n_chars) % 1000 as double) / 100 - 4").alias("chosen"),
        F.expr("cast((doc_id * 53 + n_chars * 3) % 1000 as double) / 100 - 5").alias("rejected"),
    )


def votes(spark: SparkSession, folder: str) -> DataFrame:
    """Votes of three judges on every document."""
    judged = table(spark, folder, "documents").select(
        F.col("doc_id").alias("instance_id"), F.explode(F.array(*[F.lit(j) for j in range(3)])).alias("judge")
    )
    vote = "element_at(array('A', 'A', 'B', 'B', 'error'), cast((instance_id * 5 + judge * (instance_id % 7)) % 5 as int) + 1)"
    return judged.withColumn("vote", F.expr(vote))


def verdicts(spark: SparkSession, folder: str) -> DataFrame:
    """Raw judge answers, one per document."""
    answers = (
        "array('Reason. [[A]]', 'Reason. [[B]]', '[[B]] then [[A]]', 'Feedback: ok [RESULT] A', "
        "'Feedback: ok [RESULT] B ', 'no verdict')"
    )
    return table(spark, folder, "documents").select(
        F.col("doc_id").alias("id"),
        F.expr(f"element_at({answers}, cast(doc_id % 6 as int) + 1)").alias("judgment"),
    )


def in_two_languages(pairs: DataFrame) -> DataFrame:
    """Pairs and their translations, which share the ids of the originals."""
    return pairs.unionByName(pairs.withColumn("language", F.lit(TRANSLATED)))


def annotations(spark: SparkSession, folder: str) -> DataFrame:
    """Human answers for the labelled documents and for their translations.

    The two answers to one id differ for documents whose id divides by four.
    """
    languages = language_dimension(spark).select("language", "doc_lang")
    docs = table(spark, folder, "documents").select("doc_id", "lang").join(languages, F.col("lang") == F.col("doc_lang"))
    labelled = table(spark, folder, "labels").join(docs, "doc_id").select("doc_id", "language", "quality", "toxic")
    both = in_two_languages(labelled)
    says_a = F.expr(f"(quality = 1) <> (language = '{TRANSLATED}' and doc_id % 4 = 0)")
    return both.select(
        F.col("doc_id").alias("id"),
        "language",
        F.when(F.col("doc_id") % 11 != 0, F.when(says_a, "A").otherwise("B")).alias("human_preference"),
        F.expr("case when toxic = 1 then 'toxic' end").alias("notes"),
    )


def done(spark: SparkSession, folder: str) -> DataFrame:
    """Rows a translation job has written already: the labelled documents."""
    return table(spark, folder, "labels").select(
        F.col("doc_id").alias("id"), F.lit("deu_Latn").alias("target_language")
    )


def run_models(spark: SparkSession, folder: str) -> DataFrame:
    """One evaluated model name (and the ensemble it may belong to) per document."""
    names = F.array(*[F.lit(name) for name in RUN_MODELS])

    def pick(offset):
        return F.get(names, ((F.col("doc_id") + offset) % len(RUN_MODELS)).cast("int"))

    return table(spark, folder, "documents").select(
        F.col("doc_id").alias("id"),
        pick(0).alias("model"),
        F.when(F.col("doc_id") % 3 == 0, F.array(pick(0), pick(1), pick(2)))
        .otherwise(F.array(pick(0)))
        .alias("judges"),
    )


def conversations(spark: SparkSession, folder: str) -> DataFrame:
    """All messages of every conversation that ends with an assistant's answer.

    A conversation is one row, as it is for every later step.
    """
    turns = table(spark, folder, "conversations")
    ordered = F.array_sort(F.collect_list(F.struct("turn", "role", F.col("text").alias("content"))))
    listed = turns.groupBy("conv_id").agg(
        F.transform(ordered, lambda m: F.struct(m["role"].alias("role"), m["content"].alias("content"))).alias(
            "messages"
        )
    )
    return listed.where(F.element_at("messages", -1)["role"] == "assistant")


def multi_turn_pairs(spark: SparkSession, folder: str) -> DataFrame:
    """Pairs whose prompt is a message list and whose answer is the last message."""
    last = F.element_at("messages", -1)["content"]
    return conversations(spark, folder).select(
        F.col("conv_id").alias("id"),
        F.slice("messages", F.lit(1), F.size("messages") - 1).alias("prompt"),
        last.alias("chosen"),
        F.concat(F.lit("[alt] "), last).alias("rejected"),
    )
