"""From per-instance results to subset, category and overall scores and documents."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from prefboard.functions import fixed, lookups

RUN = ["model", "model_type", "language"]


def overall_accuracy(results: DataFrame) -> DataFrame:
    """Sum of results over rows, per model and language; a tie counts one half."""
    return results.groupBy(*RUN).agg(
        F.sum("result").alias("num_correct"),
        F.count("result").alias("num_total"),
        F.avg("result").alias("accuracy"),
    )


def subset_accuracy(results: DataFrame) -> DataFrame:
    """Mean result per model, language and subset present in the data."""
    return results.groupBy(*RUN, "subset").agg(
        F.sum("result").alias("num_correct"),
        F.count("result").alias("num_total"),
        F.avg("result").alias("accuracy"),
    )


def category_scores(subsets: DataFrame, strict=True) -> DataFrame:
    """Subset accuracies averaged per category with the fixed subset weights.

    `strict`: null unless every subset of the category is present; otherwise the
    weights of the present subsets are used.
    """
    spark = subsets.sparkSession
    weighted = F.sum(F.col("accuracy") * F.col("weight")) / F.sum("weight")
    scores = (
        subsets.join(lookups.subset_weights(spark), "subset")
        .groupBy(*RUN, "category")
        .agg(weighted.alias("score"), F.count("accuracy").alias("present"))
    )
    if strict:
        scores = scores.join(lookups.category_sizes(spark), "category").withColumn(
            "score", F.when(F.col("present") == F.col("n_subsets"), F.col("score"))
        )
    return scores.select(*RUN, "category", "score")


def overall_score(categories: DataFrame, strict=True) -> DataFrame:
    """Unweighted mean of the category scores."""
    complete = F.count("score") == len(fixed.CATEGORIES) if strict else F.lit(True)
    return categories.groupBy(*RUN).agg(F.when(complete, F.avg("score")).alias("score"))


def _category_aggregates(strict):
    """Weighted category averages as aggregates over weighted subset rows."""
    columns = {}
    for category in fixed.CATEGORIES:
        n_subsets = sum(1 for _, c, _ in fixed.SUBSETS if c == category)
        inside = f"filter (where category = '{category}')"
        average = f"sum(accuracy * weight) {inside} / sum(weight) {inside}"
        if strict:
            average = f"if(count(accuracy) {inside} = {n_subsets}, {average}, null)"
        columns[category] = F.expr(average)
    return columns


def score_columns(subsets: DataFrame, strict=True) -> DataFrame:
    """One row per run: its metadata, `Overall` and a column per category.

    All five scores come from one aggregation of the subset rows.
    """
    weighted = subsets.join(lookups.subset_weights(subsets.sparkSession), "subset")
    wide = weighted.groupBy(*RUN).agg(*[c.alias(name) for name, c in _category_aggregates(strict).items()])
    return wide.withColumn("Overall", _mean_of_categories(strict))


def subset_columns(subsets: DataFrame, strict=True) -> DataFrame:
    """One row per run: its metadata, `Overall` and a column per known subset."""
    weighted = subsets.join(lookups.subset_weights(subsets.sparkSession), "subset")
    by_subset = [
        F.expr(f"max(accuracy) filter (where subset = '{subset}')").alias(subset) for subset, _, _ in fixed.SUBSETS
    ]
    categories = [c.alias(name) for name, c in _category_aggregates(strict).items()]
    wide = weighted.groupBy(*RUN).agg(*categories, *by_subset)
    return wide.withColumn("Overall", _mean_of_categories(strict)).drop(*fixed.CATEGORIES)


def _mean_of_categories(strict):
    """Unweighted mean of the four category columns; `strict` needs all of them."""
    columns = [f"`{c}`" for c in fixed.CATEGORIES]
    if strict:
        return F.expr(f"({' + '.join(columns)}) / {len(columns)}")
    total = " + ".join(f"coalesce({c}, 0d)" for c in columns)
    present = " + ".join(f"cast({c} is not null as int)" for c in columns)
    return F.expr(f"({total}) / nullif({present}, 0)")


def all_scores(subsets: DataFrame, strict=True) -> DataFrame:
    """Long frame with the four categories and `Overall` of every run."""
    wide = score_columns(subsets, strict)
    return wide.unpivot(RUN, ["Overall", *fixed.CATEGORIES], "category", "score")


def score_map(scores: DataFrame, key: str, value: str, name: str) -> DataFrame:
    """One map column per run from long score rows.

    The number of entries is the number of subsets or categories, never of rows.
    """
    entries = F.sort_array(F.collect_list(F.struct(key, value)))
    return scores.groupBy(*RUN).agg(F.map_from_entries(entries).alias(name))


def result_documents(
    results: DataFrame, dataset="preference-set", core_dataset=True, ref_model=None, tokenizer=None, chat_template=None
) -> DataFrame:
    """One result document per model and language, without the instance list.

    `ref_model`, `tokenizer` and `chat_template` are texts or columns over the
    run's model, type and language. Generative runs and classifier / implicit-reward runs have different fields;
    the fields of the other kind are null and thereby absent from the JSON. The
    instance results stay rows (`writers.write_instances`): a list of them inside
    one document would put a whole run into one row.
    """
    subsets = subset_accuracy(results)
    weighted = subsets.join(lookups.subset_weights(results.sparkSession), "subset", "left")
    sections = [x for name, c in _category_aggregates(strict=False).items() for x in (F.lit(name), c)]
    runs = weighted.groupBy(*RUN).agg(
        F.sum("num_correct").alias("num_correct"),
        F.sum("num_total").alias("num_total"),
        F.map_from_entries(F.sort_array(F.collect_list(F.struct("subset", "accuracy")))).alias("by_subset"),
        F.map_filter(F.create_map(*sections), lambda _, v: v.isNotNull()).alias("leaderboard"),
    )
    runs = runs.withColumn("accuracy", F.col("num_correct") / F.col("num_total"))
    generative = F.startswith(F.col("model_type"), F.lit("Generative"))

    def only(condition, column):
        return F.when(condition, column)

    def given(value):
        return value if isinstance(value, Column) else F.lit(value).cast("string")

    scores = F.struct("accuracy", "num_correct", "num_total")
    return runs.select(
        "language",
        "model_type",
        only(generative, F.lit(dataset)).alias("dataset"),
        "model",
        given(chat_template).alias("chat_template"),
        only(generative, scores).alias("scores"),
        only(generative, F.col("leaderboard")).alias("leaderboard"),
        only(generative, F.col("by_subset")).alias("subset"),
        only(~generative, F.col("accuracy")).alias("accuracy"),
        only(~generative, F.col("num_total")).alias("num_prompts"),
        only(~generative, given(ref_model)).alias("ref_model"),
        only(~generative, given(tokenizer)).alias("tokenizer"),
        only(~generative & F.lit(core_dataset), F.col("by_subset")).alias("extra_results"),
        only(~generative, F.col("by_subset")).alias("subset_results"),
    )


def document_json(documents: DataFrame) -> DataFrame:
    """Documents as JSON text: `language, model, document`.

    In a generative document the subset map also carries the run's metadata.
    """
    metadata = F.struct("model", "model_type", "chat_template")
    subset_text = F.when(
        F.col("subset").isNotNull(),
        _merge_objects(F.to_json(metadata), F.to_json("subset")),
    )
    plain = F.to_json(
        F.struct(
            "dataset",
            "model",
            "chat_template",
            "scores",
            "leaderboard",
            "accuracy",
            "num_prompts",
            "ref_model",
            "tokenizer",
            "extra_results",
            "subset_results",
        )
    )
    with_subset = _merge_objects(plain, F.concat(F.lit('{"subset":'), subset_text, F.lit("}")))
    return documents.select("language", "model", F.coalesce(with_subset, plain).alias("document"))


def _merge_objects(first: Column, second: Column) -> Column:
    """JSON text of two objects in one; both must have members."""
    head = F.regexp_replace(first, "}$", "")
    return F.concat(head, F.lit(","), F.regexp_replace(second, "^\\{", ""))


def numeric_entries(scores: Column) -> Column:
    """A text-valued score map as doubles, without metadata and null entries.

    A score that is no number fails the job: an average without it would look whole.
    """
    kept = F.map_filter(scores, lambda k, v: ~k.isin(fixed.SUBSET_METADATA_KEYS) & v.isNotNull())

    def number(name, value):
        broken = F.raise_error(F.concat(F.lit("score of "), name, F.lit(" is no number: "), value))
        return F.coalesce(value.try_cast("double"), broken.cast("double"))

    return F.transform_values(kept, number)


def classify_documents(documents: DataFrame) -> DataFrame:
    """Model, type and score maps of stored documents, told apart by their fields.

    A document with `subset` is generative and names its own type; of the others,
    a non-empty `ref_model` makes it an implicit-reward model. Category scores
    are stored in generative documents and computed for the others.
    """
    generative = F.col("subset").isNotNull()
    implicit = F.coalesce(F.length("ref_model"), F.lit(0)) > 0
    return documents.select(
        "language",
        F.when(generative, F.col("subset")["model"]).otherwise(F.col("model")).alias("model"),
        F.when(generative, F.col("subset")["model_type"])
        .when(implicit, F.lit("DPO"))
        .otherwise(F.lit("Sequence Classifier"))
        .alias("model_type"),
        F.when(generative, F.col("subset")["chat_template"]).otherwise(F.col("chat_template")).alias("chat_template"),
        F.col("leaderboard").alias("stored_categories"),
        numeric_entries(F.when(generative, F.col("subset")).otherwise(F.col("extra_results"))).alias("subset_scores"),
    )


def _map_average(scores, category, strict):
    """SQL text of the weighted category average over the entries of a score map."""
    weights = {f"{scores}['{s}']": w for s, c, w in fixed.SUBSETS if c == category}
    if strict:
        total = " + ".join(f"{entry} * {w}" for entry, w in weights.items())
        return f"({total}) / {sum(weights.values())}"
    total = " + ".join(f"coalesce({entry}, 0d) * {w}" for entry, w in weights.items())
    present = " + ".join(f"if({entry} is null, 0, {w})" for entry, w in weights.items())
    return f"({total}) / nullif({present}, 0)"


def document_scores(classified: DataFrame, strict=True) -> DataFrame:
    """Long `model, model_type, language, category, score` with `Overall` rows.

    The category average of a document uses only its own map entries, so it is a
    column expression: no shuffle is needed. Stored categories are averaged as
    they are; `strict` concerns computed ones.
    """
    columns = {
        c: F.expr(f"if(stored_categories is not null, stored_categories['{c}'], {_map_average('subset_scores', c, strict)})")
        for c in fixed.CATEGORIES
    }
    stored_mean = F.expr(
        "aggregate(map_values(stored_categories), 0d, (total, x) -> total + x) / nullif(size(stored_categories), 0)"
    )
    wide = classified.withColumns(columns)
    overall = F.when(F.col("stored_categories").isNotNull(), stored_mean).otherwise(_mean_of_categories(strict))
    wide = wide.select(*RUN, overall.alias("Overall"), *[f"`{c}`" for c in fixed.CATEGORIES])
    return wide.unpivot(RUN, ["Overall", *fixed.CATEGORIES], "category", "score")


def flat_documents(documents: DataFrame) -> DataFrame:
    """Overall accuracy and subset scores of documents in a flat folder."""
    has_board, has_subsets = F.col("leaderboard").isNotNull(), F.col("subset_results").isNotNull()
    chosen = (
        F.when(has_board, F.col("subset")).when(has_subsets, F.col("subset_results")).otherwise(F.col("extra_results"))
    )
    return documents.select(
        "language",
        "model",
        F.when(has_board, F.col("scores")["accuracy"]).otherwise(F.col("accuracy")).alias("accuracy"),
        numeric_entries(chosen).alias("subset_scores"),
    )


def convert_imported(imported: DataFrame, dataset: str) -> DataFrame:
    """Flat imported English results in the shape of stored documents.

    Input: `model, model_type, chat_template, ref_model` and a `subset -> score`
    map `scores`. What the import does not state stays null. The result can be
    written by `writers.write_result_documents` and, read again, be classified.
    """
    generative = F.col("model_type") == "Generative RM"
    averages = ", ".join(f"'{c}', {_map_average('scores', c, strict=False)}" for c in fixed.CATEGORIES)
    board = F.expr(f"map({averages})")
    scores = F.lit(None).cast("struct<accuracy:double,num_correct:double,num_total:long>")
    return imported.select(
        F.lit(fixed.ENGLISH).alias("language"),
        F.when(generative, F.lit(dataset)).alias("dataset"),
        scores.alias("scores"),
        F.lit(None).cast("string").alias("tokenizer"),
        "model",
        "model_type",
        "chat_template",
        F.when(~generative, F.col("ref_model")).alias("ref_model"),
        F.lit(None).cast("double").alias("accuracy"),
        F.when(~generative, F.lit(fixed.IMPORTED_NUM_PROMPTS)).alias("num_prompts"),
        F.when(generative, board).alias("leaderboard"),
        F.when(generative, F.col("scores")).alias("subset"),
        F.when(~generative, F.col("scores")).alias("extra_results"),
        F.lit(None).cast("map<string,double>").alias("subset_results"),
        F.concat(F.split_part("model", F.lit("/"), F.lit(2)), F.lit("-eng_Latn.json")).alias("file_name"),
    )


def explode_scores(frame: DataFrame, keys, column="subset_scores", name="subset", value="score") -> DataFrame:
    """A map of scores as long rows."""
    return frame.select(*keys, F.explode(column).alias(name, value))


def model_results(results: DataFrame, model: str, language=None) -> DataFrame:
    """Per-instance results of exactly one model; reading fails when there are none.

    The check is part of the query: no job runs while it is put together.
    """
    found = results.where(F.col("model") == model)
    if language is not None:
        found = found.where(F.col("language") == language)
    where = f"no results of model '{model}'" + (f" in {language}" if language else "")
    # one row that fails when the count is 0, and adds nothing otherwise
    count = found.agg(F.count(F.lit(1)).alias("n")).where("n = 0")
    none = count.select(F.raise_error(F.lit(where)).cast("boolean").alias("_none"))
    failing = none.where(F.col("_none"))
    return found.unionByName(failing.select(*[F.lit(None).cast(f.dataType).alias(f.name) for f in found.schema]))


def instance_rows(documents: DataFrame) -> DataFrame:
    """Inline result lists of stored documents as rows with their position."""
    return documents.select("language", "model", F.posexplode(F.col("scores")["results"]).alias("position", "result"))


def attach_results(pairs: DataFrame, results: DataFrame, strict=True) -> DataFrame:
    """Adds one model's result as `scores`, joined by language and stored position.

    `strict`: a pair without a result fails the job; otherwise it drops out. The
    result rows are narrow; select the pair columns that are needed, as they are
    what the join moves.
    """
    keys = ["language", "position"]
    scored = results.select(*keys, F.col("result").alias("scores"), F.lit(True).alias("_found"))
    if not strict:
        return pairs.join(scored, keys).drop("_found")
    missing = F.raise_error(
        F.concat(F.lit("no result for position "), F.col("position").cast("string"), F.lit(" in "), F.col("language"))
    )
    joined = pairs.join(scored, keys, "left")
    return joined.withColumn("scores", F.when(F.col("_found"), F.col("scores")).otherwise(missing)).drop("_found")
