"""Queries on pair shaping, names and text segmentation."""

from pyspark.sql import functions as F

from prefboard.functions import fixed, lookups, text
from prefboard.operators import naming, shape
from prefboard.operators.ranking import numbered
from prefboard.plans.registry import query
from prefboard.plans.views import quote, sql_sentences
from prefboard.sources import derived


def _case(column, mapping):
    arms = " ".join(f"when {quote(k)} then {quote(v)}" for k, v in mapping.items())
    return f"case {column} {arms} else {column} end"


@query(
    "project_pairs",
    "bilingual",
    "select id, source, language, input as prompt, chosen, rejected from bilingual",
)
def project_pairs(spark, folder):
    columns = [
        "id", "source", "language", "input", "chosen", "rejected", "en_input", "en_chosen", "en_rejected",
    ]
    english = ["en_input", "en_chosen", "en_rejected"]
    return shape.project(derived.bilingual_pairs(spark, folder), columns, {"input": "prompt"}, english)


@query(
    "project_prefixed",
    "bilingual",
    "select id, source, language, en_input as prompt, en_chosen as chosen, en_rejected as rejected from bilingual",
)
def project_prefixed(spark, folder):
    return shape.language_side(derived.bilingual_pairs(spark, folder), english=True)


def _flat_messages(df, column, name):
    return [
        F.size(column).alias(f"{name}_size"),
        F.col(column)[0]["role"].alias(f"{name}_role_0"),
        F.col(column)[0]["content"].alias(f"{name}_text_0"),
        F.col(column)[1]["role"].alias(f"{name}_role_1"),
        F.col(column)[1]["content"].alias(f"{name}_text_1"),
    ]


_FLAT_TURNS = """
select id, language,
 2 as chosen_size, 'user' as chosen_role_0, prompt as chosen_text_0, 'assistant' as chosen_role_1, chosen as chosen_text_1,
 2 as rejected_size, 'user' as rejected_role_0, prompt as rejected_text_0, 'assistant' as rejected_role_1, rejected as rejected_text_1
from pairs"""


@query("to_turns", "pairs", _FLAT_TURNS)
def to_turns(spark, folder):
    turns = shape.to_turns(derived.pairs(spark, folder))
    return turns.select(
        "id", "language", *_flat_messages(turns, "chosen", "chosen"), *_flat_messages(turns, "rejected", "rejected")
    )


@query("dialogue_core", "pairs", _FLAT_TURNS.replace("select id, language,", "select id, language, prompt, chosen, rejected,"))
def dialogue_core(spark, folder):
    """Dialogues stand beside the texts they are made of."""
    d = shape.dialogues(derived.pairs(spark, folder))
    return d.select(
        "id", "language", "prompt", "chosen", "rejected", *_flat_messages(d, "text_chosen", "chosen"), *_flat_messages(d, "text_rejected", "rejected")
    )


def _joined_dialogue(column):
    def member(name):
        return F.array_join(F.transform(column, lambda m: m[name]), "|")

    return member("role"), member("content")


def _multi_output(d):
    chosen_roles, chosen_text = _joined_dialogue("text_chosen")
    _, rejected_text = _joined_dialogue("text_rejected")
    return d.select(
        "id",
        F.size("text_chosen").cast("long").alias("n_messages"),
        chosen_roles.alias("roles"),
        chosen_text.alias("chosen_text"),
        rejected_text.alias("rejected_text"),
    )


_MULTI_SQL = """
select id, n_messages, array_to_string(list_append(roles[1:-2], 'assistant'), '|') as roles,
 array_to_string(texts, '|') as chosen_text,
 array_to_string(list_append(texts[1:-2], '[alt] ' || texts[-1]), '|') as rejected_text
from multi_turn"""


@query("dialogue_multi", "multi_turn", _MULTI_SQL)
def dialogue_multi(spark, folder):
    return _multi_output(shape.dialogues(derived.multi_turn_pairs(spark, folder)))


@query("filter_max_turns", "multi_turn", _MULTI_SQL + " where n_messages <= 4")
def filter_max_turns(spark, folder):
    return _multi_output(shape.keep_max_turns(shape.dialogues(derived.multi_turn_pairs(spark, folder)), 4))


@query(
    "route_code_subsets",
    "pairs",
    "select id, subset, case when starts_with(subset, 'hep-') then 'prompt_only' else 'all_columns' end as route from pairs",
)
def route_code_subsets(spark, folder):
    return shape.route_code(derived.pairs(spark, folder)).select("id", "subset", "route")


@query(
    "limit_first",
    "pairs",
    "select id, language, subset, prompt from pairs order by position limit 100",
)
def limit_first(spark, folder):
    rows = derived.pairs(spark, folder).select("id", "language", "subset", "prompt", "position")
    return shape.first_rows(rows, 100).drop("position")


@query(
    "relabel_model_type",
    "judgements",
    """select case model_type when 'DPO' then 'Implicit RM' when 'Sequence Classifier' then 'Classifier RM' else model_type end as model_type,
 count(*) as n, sum(result) as won from judgements group by 1""",
)
def relabel_model_type(spark, folder):
    relabelled = naming.relabel_model_type(derived.judgements(spark, folder))
    return relabelled.groupBy("model_type").agg(F.count(F.lit(1)).alias("n"), F.sum("result").alias("won"))


@query(
    "standardize_models",
    "run_models",
    f"select id, {_case('model', fixed.MODEL_TITLES)} as model from run_models",
)
def standardize_models(spark, folder):
    return naming.display_model(derived.run_models(spark, folder).select("id", "model"))


@query(
    "display_subsets",
    "pairs",
    f"select id, {_case('subset', fixed.SUBSET_TITLES)} as subset from pairs",
)
def display_subsets(spark, folder):
    return naming.display_subset(derived.pairs(spark, folder).select("id", "subset"))


@query(
    "standardize_langs",
    "judgements",
    f"""select {_case("split_part(language, '_', 1)", fixed.LANGUAGE_LABELS)} as language, count(*) as n
from judgements group by 1""",
)
def standardize_langs(spark, folder):
    named = naming.short_language(derived.judgements(spark, folder))
    return named.groupBy("language").agg(F.count(F.lit(1)).alias("n"))


_PROVIDER_ARMS = " ".join(
    f"when model in ({', '.join(quote(m) for m in models)}) then '{provider}/' || model"
    for provider, models in fixed.PROVIDER_MODELS.items()
)


@query(
    "qualify_model",
    "run_models",
    f"""select id, case when id % 3 = 0 then 'PoLL/' || model || '_' || model_2 || '_' || model_3
 {_PROVIDER_ARMS} else model end as run_name from run_models""",
)
def qualify_model(spark, folder):
    return derived.run_models(spark, folder).select("id", naming.qualified_model(F.col("judges")).alias("run_name"))


_FAMILY_ARMS = " ".join(f"when contains(model, {quote(k)}) then {quote(v)}" for k, v in fixed.PROMPT_FAMILIES)


@query("model_modifier", "run_models", f"select id, model, case {_FAMILY_ARMS} end as family from run_models")
def model_modifier(spark, folder):
    models = derived.run_models(spark, folder)
    return models.select("id", "model", naming.prompt_family(F.col("model")).alias("family"))


@query(
    "drop_missing",
    "annotations",
    "select id, language, human_preference, notes from annotations where human_preference is not null",
)
def drop_missing(spark, folder):
    return shape.drop_missing(derived.annotations(spark, folder), ["human_preference"])


@query(
    "strip_prefix",
    "pairs",
    r"""select id, regexp_replace(case when id % 2 = 0 then 'maple-' || subset else 'x-maple-' || subset end, '^maple-', '') as subset
from pairs""",
)
def strip_prefix(spark, folder):
    raw = derived.pairs(spark, folder).select(
        "id",
        F.concat(F.when(F.col("id") % 2 == 0, "maple-").otherwise("x-maple-"), "subset").alias("subset"),
    )
    return shape.strip_prefix(raw, "subset", "maple-")


@query(
    "isin_filter",
    "judgements",
    """select model, language, count(*) as n, sum(result) as won from judgements
where language in ('deu_Latn', 'spa_Latn', 'zho_Hans') group by model, language""",
)
def isin_filter(spark, folder):
    kept = shape.keep_values(derived.judgements(spark, folder), "language", ["deu_Latn", "spa_Latn", "zho_Hans"])
    return kept.groupBy("model", "language").agg(F.count(F.lit(1)).alias("n"), F.sum("result").alias("won"))


@query(
    "segment_lines",
    "pairs",
    "select id, len(string_split(chosen, chr(10))) as n_lines, chosen as rejoined from pairs",
)
def segment_lines(spark, folder):
    return derived.pairs(spark, folder).select(
        "id",
        F.size(text.lines(F.col("chosen"))).cast("long").alias("n_lines"),
        text.join_lines(text.lines(F.col("chosen"))).alias("rejoined"),
    )


@query(
    "segment_sentences",
    "pairs",
    f"""select id, len(parts) as n_sentences, array_to_string(parts, ' ') as rejoined
from (select id, {sql_sentences("chosen")} as parts from pairs)""",
)
def segment_sentences(spark, folder):
    return derived.pairs(spark, folder).select(
        "id",
        F.size(text.sentences(F.col("chosen"))).cast("long").alias("n_sentences"),
        text.join_sentences(text.sentences(F.col("chosen"))).alias("rejoined"),
    )


@query(
    "subset_category",
    "pairs",
    "select p.id, p.subset, s.category from pairs p left join dim_subsets s on s.subset = p.subset",
)
def subset_category(spark, folder):
    weights = lookups.subset_weights(spark).select("subset", "category")
    return derived.pairs(spark, folder).select("id", "subset").join(weights, "subset", "left")


@query(
    "model_file_key",
    "run_models",
    """select id, replace(model, '/', '___') as result_key, replace(model, '/', '_') as translation_key,
 split_part(model, '/', 2) as imported_key from run_models""",
)
def model_file_key(spark, folder):
    model = F.col("model")
    return derived.run_models(spark, folder).select(
        "id",
        naming.result_key(model).alias("result_key"),
        naming.translation_key(model).alias("translation_key"),
        naming.imported_key(model).alias("imported_key"),
    )


@query(
    "value_counts",
    "pairs",
    """select subset, count(*) as n, row_number() over (order by count(*) desc, subset) as place
from pairs where subset is not null group by subset""",
)
def value_counts(spark, folder):
    return numbered(shape.value_counts(derived.pairs(spark, folder), "subset"))


@query("distinct_values", "judgements", "select distinct subset from judgements")
def distinct_values(spark, folder):
    return shape.distinct_values(derived.judgements(spark, folder), "subset")


@query(
    "union_samples",
    "pairs done",
    """select id, language, 'open' as state from pairs p where not exists (select 1 from done d where d.id = p.id)
union all select p.id, p.language, 'done' as state from pairs p join done d on d.id = p.id""",
)
def union_samples(spark, folder):
    pairs = derived.pairs(spark, folder).select("id", "language")
    written = derived.done(spark, folder).select("id")
    still_open = pairs.join(written, "id", "left_anti").withColumn("state", F.lit("open"))
    finished = pairs.join(written, "id").withColumn("state", F.lit("done"))
    return shape.stack_frames(still_open, finished)
