"""Queries on accuracies, category scores and result documents."""

from pyspark.sql import functions as F

from prefboard.functions import fixed, lookups
from prefboard.operators import results, shape
from prefboard.operators.ranking import places
from prefboard.plans.registry import query, r6
from prefboard.session import fresh_path, materialise
from prefboard.sources import derived, readers, writers
from prefboard.sources.documents import read_instance_lists, write_instance_lists

_RUN = "model, model_type, language"


@query(
    "overall_accuracy",
    "judgements",
    f"""select {_RUN}, sum(result) as num_correct, count(*) as num_total, round(sum(result) / count(*), 6) as accuracy
from judgements group by {_RUN}""",
)
def overall_accuracy(spark, folder):
    return results.overall_accuracy(derived.judgements(spark, folder)).withColumn("accuracy", r6("accuracy"))


def _subset_accuracy(spark, folder):
    return results.subset_accuracy(derived.judgements(spark, folder))


@query(
    "subset_accuracy",
    "subset_acc",
    f"select {_RUN}, subset, num_correct, num_total, round(accuracy, 6) as accuracy from subset_acc",
)
def subset_accuracy(spark, folder):
    return _subset_accuracy(spark, folder).withColumn("accuracy", r6("accuracy"))


@query(
    "to_percent",
    "subset_acc",
    f"select {_RUN}, subset, round(accuracy * 100, 6) as accuracy from subset_acc",
)
def to_percent(spark, folder):
    percent = shape.to_percent(_subset_accuracy(spark, folder), ["accuracy"])
    return percent.select("model", "model_type", "language", "subset", r6("accuracy", "accuracy"))


@query("category_scores", "category_acc", f"select {_RUN}, category, round(score, 6) as score from category_acc")
def category_scores(spark, folder):
    return results.category_scores(_subset_accuracy(spark, folder)).withColumn("score", r6("score"))


@query(
    "category_scores_lenient",
    "subset_acc",
    f"""select {_RUN.replace("model,", "a.model,")}, s.category, round(sum(a.accuracy * s.weight) / sum(s.weight), 6) as score
from subset_acc a join dim_subsets s on s.subset = a.subset where not starts_with(a.subset, 'hep-')
group by {_RUN.replace("model,", "a.model,")}, s.category""",
)
def category_scores_lenient(spark, folder):
    """Category scores of runs that were judged without the code subsets."""
    without_code = derived.judgements(spark, folder).where(~shape.is_code())
    scores = results.category_scores(results.subset_accuracy(without_code), strict=False)
    return scores.withColumn("score", r6("score"))


@query("overall_score", "overall_acc", f"select {_RUN}, round(score, 6) as score from overall_acc")
def overall_score(spark, folder):
    categories = results.category_scores(_subset_accuracy(spark, folder))
    return results.overall_score(categories).withColumn("score", r6("score"))


@query(
    "metadata_with_scores",
    "long_board",
    f"""select {_RUN}, round(max(score) filter (category = 'Overall'), 6) as overall,
 round(max(score) filter (category = 'Chat'), 6) as chat, round(max(score) filter (category = 'Chat Hard'), 6) as chat_hard,
 round(max(score) filter (category = 'Safety'), 6) as safety, round(max(score) filter (category = 'Reasoning'), 6) as reasoning
from long_board group by {_RUN}""",
)
def metadata_with_scores(spark, folder):
    wide = results.score_columns(_subset_accuracy(spark, folder))
    names = {"Overall": "overall", "Chat": "chat", "Chat Hard": "chat_hard", "Safety": "safety", "Reasoning": "reasoning"}
    return wide.select(*results.RUN, *[r6(c, name) for c, name in names.items()])


def _documents(spark, folder):
    reference = F.when(F.col("model_type") == "DPO", F.concat("model", F.lit("-ref")))
    return results.result_documents(derived.judgements(spark, folder), ref_model=reference)


_SUBSET_COLUMNS = ", ".join(
    f"""round(max(accuracy) filter (subset = '{s}'), 6) as "{s}\"""" for s, _, _ in fixed.SUBSETS
)


@query(
    "metadata_with_subsets",
    "overall_acc",
    f"""select o.model, o.model_type, o.language, round(o.score, 6) as overall, s.* exclude (model, model_type, language)
from overall_acc o join (select {_RUN}, {_SUBSET_COLUMNS} from subset_acc group by {_RUN}) s
 on s.model = o.model and s.language = o.language""",
)
def metadata_with_subsets(spark, folder):
    wide = results.subset_columns(_subset_accuracy(spark, folder))
    names = [s for s, _, _ in fixed.SUBSETS]
    return wide.select(*results.RUN, r6("Overall", "overall"), *[r6(F.col(f"`{n}`"), n) for n in names])


@query(
    "result_document",
    "category_acc",
    """select t.model, t.language, case when g then 'preference-set' end as dataset,
 case when g then round(t.accuracy, 6) end as generative_accuracy,
 case when not g then round(t.accuracy, 6) end as classifier_accuracy,
 case when g then t.num_correct end as num_correct, t.num_total as num_total,
 case when t.model_type = 'DPO' then t.model || '-ref' end as ref_model,
 case when g then round(c.chat, 6) end as chat, case when g then round(c.chat_hard, 6) end as chat_hard,
 case when g then round(c.safety, 6) end as safety, case when g then round(c.reasoning, 6) end as reasoning,
 t.n_subsets as n_subsets, round(t.math, 6) as math_prm
from (select model, model_type, language, starts_with(model_type, 'Generative') as g, sum(num_correct) as num_correct,
  sum(num_total)::bigint as num_total, sum(num_correct) / sum(num_total) as accuracy, count(*) as n_subsets,
  max(accuracy) filter (subset = 'math-prm') as math from subset_acc group by all) t
join (select model, language, max(score) filter (category = 'Chat') as chat, max(score) filter (category = 'Chat Hard') as chat_hard,
  max(score) filter (category = 'Safety') as safety, max(score) filter (category = 'Reasoning') as reasoning
 from category_acc group by model, language) c on c.model = t.model and c.language = t.language""",
)
def result_document(spark, folder):
    documents = _documents(spark, folder)
    subsets = F.coalesce("subset", "subset_results")

    def section(name):
        return r6(F.try_element_at("leaderboard", F.lit(name)))

    return documents.select(
        "model",
        "language",
        "dataset",
        r6(F.col("scores")["accuracy"], "generative_accuracy"),
        r6("accuracy", "classifier_accuracy"),
        F.col("scores")["num_correct"].alias("num_correct"),
        F.coalesce(F.col("scores")["num_total"], "num_prompts").alias("num_total"),
        "ref_model",
        section("Chat").alias("chat"),
        section("Chat Hard").alias("chat_hard"),
        section("Safety").alias("safety"),
        section("Reasoning").alias("reasoning"),
        F.size(subsets).cast("long").alias("n_subsets"),
        r6(F.try_element_at(subsets, F.lit("math-prm")), "math_prm"),
    )


def _stored(spark, folder):
    """Documents as a reader sees them: JSON text parsed with the common schema."""
    documents = _documents(spark, folder)
    return readers.parse_documents(results.document_json(documents))


def _sum_of(scores):
    return F.aggregate(F.map_values(scores), F.lit(0.0), lambda total, v: total + v)


@query(
    "classify_result",
    "subset_acc",
    f"""select {_RUN}, count(*) as n_subsets, round(sum(accuracy), 6) as sum_accuracy from subset_acc group by {_RUN}""",
)
def classify_result(spark, folder):
    classified = results.classify_documents(_stored(spark, folder))
    return classified.select(
        "model",
        "model_type",
        "language",
        F.size("subset_scores").cast("long").alias("n_subsets"),
        r6(_sum_of("subset_scores"), "sum_accuracy"),
    )


@query(
    "classify_result_flat",
    "subset_acc",
    """select model, language, round(sum(num_correct) / sum(num_total), 6) as accuracy, count(*) as n_subsets,
 round(sum(accuracy), 6) as sum_accuracy from subset_acc group by model, language""",
)
def classify_result_flat(spark, folder):
    flat = results.flat_documents(_stored(spark, folder))
    return flat.select(
        "model",
        "language",
        r6("accuracy", "accuracy"),
        F.size("subset_scores").cast("long").alias("n_subsets"),
        r6(_sum_of("subset_scores"), "sum_accuracy"),
    )


@query(
    "convert_results",
    "category_acc",
    """select t.model, t.model_type, case when t.model_type = 'Generative RM' then 'upstream-set' end as dataset,
 case when t.model_type = 'DPO' then t.model || '-ref' end as ref_model,
 case when t.model_type <> 'Generative RM' then 2985 end as num_prompts,
 case when t.model_type = 'Generative RM' then round(t.chat, 6) end as chat,
 case when t.model_type = 'Generative RM' then round(t.reasoning, 6) end as reasoning,
 case when t.model_type = 'Generative RM' then 23 end as n_subset, case when t.model_type <> 'Generative RM' then 23 end as n_extra,
 split_part(t.model, '/', 2) || '-eng_Latn.json' as file_name
from (select model, model_type, max(score) filter (category = 'Chat') as chat, max(score) filter (category = 'Reasoning') as reasoning
 from category_acc where language = 'eng_Latn' group by model, model_type) t""",
)
def convert_results(spark, folder):
    converted = _converted(spark, folder)
    return converted.select(
        "model",
        "model_type",
        "dataset",
        "ref_model",
        "num_prompts",
        r6(F.try_element_at("leaderboard", F.lit("Chat")), "chat"),
        r6(F.try_element_at("leaderboard", F.lit("Reasoning")), "reasoning"),
        F.when(F.col("subset").isNotNull(), F.size("subset")).alias("n_subset"),
        F.when(F.col("extra_results").isNotNull(), F.size("extra_results")).alias("n_extra"),
        "file_name",
    )


def _converted(spark, folder):
    """Imported results are English ones; they are flat maps of subset scores."""
    english = derived.judgements(spark, folder).where(F.col("language") == fixed.ENGLISH)
    flat = results.score_map(results.subset_accuracy(english), "subset", "accuracy", "scores").select(
        "model",
        "model_type",
        F.lit(None).cast("string").alias("chat_template"),
        F.when(F.col("model_type") == "DPO", F.concat("model", F.lit("-ref"))).alias("ref_model"),
        "scores",
    )
    return results.convert_imported(flat, "upstream-set")


@query(
    "stored_imports",
    "subset_acc category_acc",
    """select a.model, a.model_type, a.language, a.subset, round(a.accuracy, 6) as score, round(c.score, 6) as category_score
from subset_acc a join dim_subsets s on s.subset = a.subset
join category_acc c on c.model = a.model and c.language = a.language and c.category = s.category where a.language = 'eng_Latn'""",
)
def stored_imports(spark, folder):
    """Converted imports written as documents, read again and classified."""
    path = fresh_path(spark, "imports")
    writers.write_result_documents(_converted(spark, folder), path)
    classified = materialise(results.classify_documents(readers.read_result_documents(spark, path)), "classified")
    scores = results.explode_scores(classified, results.RUN)
    categories = results.document_scores(classified).withColumnRenamed("score", "category_score")
    weights = lookups.subset_weights(spark).select("subset", "category")
    joined = scores.join(weights, "subset").join(categories, [*results.RUN, "category"])
    return joined.select(*results.RUN, "subset", r6("score", "score"), r6("category_score", "category_score"))


@query(
    "stored_instances",
    "judgements",
    """select language, model, row_number() over (partition by language, model order by instance_id) - 1 as position, result
from judgements""",
)
def stored_instances(spark, folder):
    """Instance results of all models from the lists inside stored documents."""
    path = fresh_path(spark, "inline-results")
    rows = derived.judgements(spark, folder)
    # documents have the same ids for every model: their places, without a window over all of them
    place = places(rows.select("language", "instance_id").distinct(), ["language"], "instance_id", "position")
    placed = rows.join(place, ["language", "instance_id"]).select("language", "model", "position", "result")
    write_instance_lists(placed, path, elements=1_000)
    return read_instance_lists(spark, path)


@query(
    "explode_scores",
    "subset_acc",
    f"select {_RUN}, subset, round(accuracy, 6) as score from subset_acc",
)
def explode_scores(spark, folder):
    classified = results.classify_documents(_stored(spark, folder))
    return results.explode_scores(classified, results.RUN).withColumn("score", r6("score"))


@query(
    "scan_results",
    "long_board",
    f"select {_RUN}, category, round(score, 6) as score from long_board",
)
def scan_results(spark, folder):
    path = fresh_path(spark, "documents")
    writers.write_result_documents(_documents(spark, folder), path)
    classified = results.classify_documents(readers.read_result_documents(spark, path))
    return results.document_scores(classified).withColumn("score", r6("score"))


@query(
    "model_documents",
    "long_board",
    f"select {_RUN}, category, round(score, 6) as score from long_board where model in ('org/model-1', 'org/model-3')",
)
def model_documents(spark, folder):
    """Scores of two models from the stored documents of all; other files are not opened."""
    path = fresh_path(spark, "documents")
    writers.write_result_documents(_documents(spark, folder), path)
    documents = readers.read_result_documents(spark, path, models=["org/model-1", "org/model-3"])
    return results.document_scores(results.classify_documents(documents)).withColumn("score", r6("score"))


@query(
    "model_results_lookup",
    "judgements",
    "select model, language, instance_id, result from judgements where model = 'org/model-1'",
)
def model_results_lookup(spark, folder):
    found = results.model_results(derived.judgements(spark, folder), "org/model-1")
    return found.select("model", "language", "instance_id", "result")


@query(
    "attach_results",
    "pairs judgements",
    """select p.id, p.language, p.subset, p.prompt, p.chosen, p.rejected, j.result as scores
from pairs p join judgements j on j.language = p.language and j.instance_id = p.position and j.model = 'org/model-1'""",
)
def attach_results(spark, folder):
    return scored_pairs(spark, folder).select("id", "language", "subset", "prompt", "chosen", "rejected", "scores")


def model_rows(spark, folder):
    """The instance results of one model."""
    rows = derived.judgements(spark, folder).where(F.col("model") == "org/model-1")
    return rows.select("language", F.col("instance_id").alias("position"), "result")


def scored_pairs(spark, folder):
    """Pairs with the results of one model as `scores`."""
    return results.attach_results(derived.pairs(spark, folder), model_rows(spark, folder))
