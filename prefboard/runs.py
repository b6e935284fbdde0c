"""Whole runs: judging, scoring, leaderboards, annotation tasks and their reports.

A run's folder holds `documents` (one JSON document per model and language) and
`instances` (one JSON line per pair). Runs of several models share a folder; a
run that is repeated replaces its earlier files.
"""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from prefboard.functions import fixed
from prefboard.operators import annotate, judging, leaderboard, naming, results, rewards, sampling, shape
from prefboard.operators.answers import AnswerStore, open_run
from prefboard.session import materialise, spread
from prefboard.sources import readers, writers

INSTANCE_COLUMNS = ["model", "model_type", "language", "subset", "id", "position", "result"]


def run_judges(
    pairs: DataFrame, judges: dict, folder, dataset, name_languages=False, answer_language="English", seed=0, tasks=None, sample=None,
    max_turns=None, all_turns=True, answers=None, parts=8,
) -> DataFrame:
    """Judges all pairs with one judge or an odd ensemble and stores the run.

    `judges` maps model names to judge functions. The prompt family follows from
    the name of a single judge; an ensemble uses the default prompts.
    `name_languages` puts the language of the question and the `answer_language`
    into the prompts. `sample` takes the first rows of every language. Dialogues of
    more than `max_turns` messages are not judged, where that is given. The
    prompt shows every message; without `all_turns` the first four.

    Answers are stored in `parts` parts while the run goes on: a stopped run that is
    started again asks only what is missing, and equal prompts are asked once. A repeated
    run asks anew. With `answers`, a folder shared by several runs, none of them asks
    what another had answered.

    Returns all rows with their `status`; only judged ones are stored and counted.
    """
    names = list(judges)
    given = F.array(*[F.lit(n) for n in names])
    family = naming.prompt_family_of(names[0]) if len(names) == 1 else None
    chosen = shape.first_rows(pairs, sample, groups=("language",)) if sample else pairs
    languages = (None, None)
    if name_languages:
        languages = (F.coalesce(naming.language_name(F.col("language")), F.col("language")), F.lit(answer_language))
    spark = pairs.sparkSession
    if answers:
        store, finish = AnswerStore(spark, answers), None
    else:
        store, finish = open_run(spark, f"{folder}/answers/{'+'.join(n.replace('/', '___') for n in names)}-{dataset}")
    judged = judging.judge_pairs_from(
        shape.dialogues(chosen), judges, store, family, *languages, seed, max_turns, all_turns=all_turns, parts=parts, tasks=tasks
    )
    named = judged.withColumns(
        {
            "model": naming.qualified_model(given),
            "model_type": F.lit("Generative RM PoLL" if len(names) > 1 else "Generative RM"),
        }
    )
    # everything below reads the written rows
    rows = materialise(named.select(*INSTANCE_COLUMNS, "votes", "is_shuffled", "status"), "judged")
    _store(rows.where(F.col("status") == "judged").drop("status"), folder, dataset)
    if finish:
        finish()
    return rows


def run_scorer(
    pairs: DataFrame, scorer, model: str, folder, dataset, ref_model=None, core_dataset=True, tasks=None, **texts
) -> DataFrame:
    """Scores all pairs with a reward model and stores the run with its raw scores."""
    scored = rewards.score_pairs(spread(shape.dialogues(pairs), tasks), scorer)
    kind = "DPO" if ref_model else "Sequence Classifier"
    named = scored.withColumns({"model": F.lit(model), "model_type": F.lit(kind)})
    scores = {"chosen_score": "chosen", "rejected_score": "rejected"}
    rows = materialise(named.select(*INSTANCE_COLUMNS, *scores), "scored").withColumnsRenamed(scores)
    return _store(rows, folder, dataset, core_dataset=core_dataset, ref_model=ref_model, **texts)


def _store(rows, folder, dataset, **options):
    writers.replace_instances(rows, f"{folder}/instances")
    documents = results.result_documents(rows, dataset, **options)
    writers.write_result_documents(documents, f"{folder}/documents")
    return rows


def score_table(spark: SparkSession, documents_path, strict=True, multi_line=True) -> DataFrame:
    """Long overall and category scores of all stored documents."""
    documents = readers.read_result_documents(spark, documents_path, multi_line)
    return results.document_scores(results.classify_documents(documents), strict)


def leaderboard_tables(spark: SparkSession, documents_path, languages, strict=True, multi_line=True) -> dict:
    """The published tables of one folder of documents.

    `boards` has the five leaderboards in long form, `overall` the wide overall
    leaderboard, `complete` its models with all languages for the tables per model
    type, `english_drop` the drop per model and category.
    """
    long = score_table(spark, documents_path, strict, multi_line)
    boards = leaderboard.board(long, languages)
    overall = leaderboard.wide_board(long.where(F.col("category") == "Overall"), languages)
    others = sorted(set(languages) - {fixed.ENGLISH})
    complete = shape.drop_missing(overall, ["avg", *others]).withColumnRenamed("avg", "avg_multilingual")
    english = [code for code in languages if code == fixed.ENGLISH]
    return {
        "boards": boards,
        "overall": overall.orderBy(F.desc("model_type"), F.desc_nulls_last("avg"), "model"),
        "complete": complete.select("model_type", "model", "avg_multilingual", *others, *english),
        "english_drop": leaderboard.english_drop_table(boards),
    }


def flat_table(spark: SparkSession, documents_path, prefix="", n=10, multi_line=True) -> DataFrame:
    """Subset scores in percent of the `n` most accurate models of a flat folder.

    Long rows `model, accuracy, subset, score`; `prefix` is cut from subset names.
    """
    documents = readers.read_result_documents(spark, documents_path, multi_line)
    best = leaderboard.top_models(results.flat_documents(documents), n, by="accuracy")
    rows = results.explode_scores(best, ["model", "accuracy"])
    return shape.to_percent(shape.strip_prefix(rows, "subset", prefix), ["accuracy", "score"])


def main_table(wide: DataFrame, languages, n=10) -> DataFrame:
    """The `n` best models in percent: average, variance and short language columns.

    Both Chinese scripts count as one language; English is left out. `wide` is the
    overall leaderboard with `model, model_type, avg` and a column per language.
    """
    best = leaderboard.top_models(wide, n, by="avg")
    long = leaderboard.long_from_wide(best, languages)
    merged = leaderboard.merge_scripts(long).where(F.col("language") != fixed.ENGLISH)
    labelled = naming.short_language(shape.to_percent(merged))
    present = sorted({code.split("_")[0] for code in languages if code != fixed.ENGLISH})
    columns = [fixed.LANGUAGE_LABELS.get(code, code) for code in present]
    scores = leaderboard.pivot_languages(labelled, columns)
    variance = leaderboard.language_variance(long).select("model", "variance")
    average = shape.to_percent(best.select("model", "avg"))
    table = average.join(variance, "model", "left").join(scores, "model", "left")
    return naming.display_model(leaderboard.sort_scores(table, "avg"))


def linguistic_table(wide: DataFrame, metadata: DataFrame, languages, n=None, order=("model",)) -> DataFrame:
    """Mean score and deviation per resource class, family and script, best first.

    `n` keeps the first models by an explicit `order`.
    """
    chosen = leaderboard.top_in_order(wide, n, order) if n else wide
    stats = leaderboard.language_stats(leaderboard.long_from_wide(chosen, languages))
    table = leaderboard.linguistic_dimensions(leaderboard.with_language_metadata(stats, metadata))
    # resource classes by descending class, the other dimensions by score
    by_class = F.when(F.col("dimension") == "resource_type", F.col("value"))
    return table.orderBy("dimension", F.desc_nulls_last(by_class), F.desc_nulls_last("avg"))


def sampled_pairs(pairs: DataFrame, instances: DataFrame, sample_size: int, seed=42) -> DataFrame:
    """Pairs with `scores`, equally many per language and score.

    The sample is drawn from ids and scores and written; the written table's size
    tells Spark whether to broadcast it when the texts are fetched.
    """
    keys = ["language", "position"]
    # the sample reads these narrow rows several times; the join runs once
    scored = materialise(results.attach_results(pairs.select(*keys, "id"), instances), "scored-ids")
    sample = sampling.stratified_sample(scored, sample_size, seed=seed).select(*keys, "scores")
    return pairs.join(materialise(sample, "sample"), keys)


def annotation_files(pairs: DataFrame, folder, instances=None, sample_size=None, seed=42) -> DataFrame:
    """Writes `answer_key` and `annotation` CSV folders, one part per language.

    With `instances` (one model's results) the sample has equally many wins,
    losses and ties per language.
    """
    if instances is not None and sample_size:
        pairs = sampled_pairs(pairs, instances, sample_size, seed)
    elif instances is not None:
        pairs = results.attach_results(pairs, instances)
    # both files and the result come from one copy, so the texts are joined once
    key = materialise(annotate.answer_key(pairs, seed), "answer-key")
    writers.write_csv_table(key, f"{folder}/answer_key", partition_by=("language",))
    writers.write_csv_table(annotate.annotation_task(key), f"{folder}/annotation", partition_by=("language",))
    return key


def human_report(key: DataFrame, annotations: DataFrame, drop_missing=False) -> dict:
    """Agreement of the human answers with gold and model, and the rows that differ."""
    joined = annotate.join_annotations(key, annotations, drop_missing)
    return {"agreement": annotate.human_agreement(joined), "disagreements": annotate.disagreements(joined)}
