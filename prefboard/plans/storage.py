"""Queries on readers, writers and the translation job.

Written tables go to the session's shared folder and are read back; the SQL side
states what a loss-free round trip returns.
"""

from pyspark.sql import functions as F

from prefboard import schemas
from prefboard.operators import naming, shape, translate
from prefboard.operators.answers import AnswerStore
from prefboard.plans import agreement, boards
from prefboard.plans.registry import query, r6
from prefboard.plans.views import sql_sentences
from prefboard.session import fresh_path
from prefboard.sources import derived, readers, writers

_PAIR_COLUMNS = ["id", "language", "subset", "prompt", "chosen", "rejected"]


@query("scan_preferences", "pairs", f"select {', '.join(_PAIR_COLUMNS)} from pairs")
def scan_preferences(spark, folder):
    path = fresh_path(spark, "pairs")
    stored = derived.pairs(spark, folder).withColumn("split", F.lit("filtered"))
    stored.write.partitionBy("split").parquet(path)
    return readers.read_pairs(spark, path).select(*_PAIR_COLUMNS)


_KEY_COLUMNS = ["id", "language", "subset", "completion_a", "completion_b", "scores", "swapped"]


@query("scan_csv", "answer_key", f"select {', '.join(_KEY_COLUMNS)} from answer_key")
def scan_csv(spark, folder):
    path = fresh_path(spark, "answer-key")
    writers.write_csv_table(agreement.answer_key(spark, folder).select(*_KEY_COLUMNS), path)
    return readers.read_csv_table(spark, path, schemas.ANSWER_KEY, line_breaks=True)


@query("scan_rewards", "rewards", "select id, chosen, rejected from rewards")
def scan_rewards(spark, folder):
    path = fresh_path(spark, "rewards")
    writers.write_instances(derived.rewards(spark, folder), path)
    return readers.read_rewards(spark, path)


@query(
    "sink_json",
    "pairs",
    "select id, language, prompt as user_text, chosen as chosen_text, rejected as rejected_text from pairs",
)
def sink_json(spark, folder):
    path = fresh_path(spark, "turns")
    turns = shape.to_turns(derived.pairs(spark, folder)).select("id", "language", "prompt", "chosen", "rejected")
    writers.write_json(turns, path)
    return (
        spark.read.schema(turns.schema)
        .json(path)
        .select(
            "id",
            "language",
            F.col("chosen")[0]["content"].alias("user_text"),
            F.col("chosen")[1]["content"].alias("chosen_text"),
            F.col("rejected")[1]["content"].alias("rejected_text"),
        )
    )


def _sql_translate(column, between="chr(10)"):
    """The replacements, and a mark around every segment."""
    for word, other in translate.SAMPLE_DICTIONARY:
        column = f"replace({column}, '{word}', '{other}')"
    return f"'<' || replace({column}, {between}, '>' || {between} || '<') || '>'"


def _translated(pairs, segment="lines"):
    return translate.translate_columns(
        pairs, ["prompt", "chosen", "rejected"], translate.dictionary_translator, "deu_Latn", segment
    )


_TRANSLATED_SQL = f"""select id, language, subset, {_sql_translate("prompt")} as prompt,
 case when starts_with(subset, 'hep-') then chosen else {_sql_translate("chosen")} end as chosen,
 case when starts_with(subset, 'hep-') then rejected else {_sql_translate("rejected")} end as rejected,
 'deu_Latn' as target_language from pairs"""


@query("translate_columns", "pairs", _TRANSLATED_SQL)
def translate_columns(spark, folder):
    return _translated(derived.pairs(spark, folder).select(*_PAIR_COLUMNS))


@query("translate_distinct", "pairs", _TRANSLATED_SQL)
def translate_distinct(spark, folder):
    """Every different line of all texts is translated once."""
    store = AnswerStore(spark, fresh_path(spark, "segments"))
    pairs = derived.pairs(spark, folder).select(*_PAIR_COLUMNS)
    columns = ["prompt", "chosen", "rejected"]
    return translate.translate_distinct(pairs, columns, translate.dictionary_translator, "deu_Latn", store, parts=2)


@query(
    "translate_sentences",
    "pairs",
    f"""select id, array_to_string(list_transform({sql_sentences("prompt")}, lambda s: {_sql_translate("s", "chr(1)")}), ' ') as prompt,
 'deu_Latn' as target_language from pairs""",
)
def translate_sentences(spark, folder):
    pairs = derived.pairs(spark, folder).select("id", "prompt")
    return translate.translate_columns(
        pairs, ["prompt"], translate.dictionary_translator, "deu_Latn", "sentences"
    )


@query(
    "translate_bilingual",
    "bilingual",
    f"""select id, source, 'deu_Latn' as language, {_sql_translate("en_input")} as prompt,
 {_sql_translate("en_chosen")} as chosen_text, {_sql_translate("en_rejected")} as rejected_text from bilingual""",
)
def translate_bilingual(spark, folder):
    turned = translate.translate_bilingual(
        derived.bilingual_pairs(spark, folder), translate.dictionary_translator, "deu_Latn"
    )
    return turned.select(
        "id",
        "source",
        "language",
        "prompt",
        F.col("chosen")[1]["content"].alias("chosen_text"),
        F.col("rejected")[1]["content"].alias("rejected_text"),
    )


@query(
    "untranslated_anti",
    "pairs done",
    "select id, language, subset from pairs p where not exists (select 1 from done d where d.id = p.id and d.target_language = 'deu_Latn')",
)
def untranslated_anti(spark, folder):
    pairs = derived.pairs(spark, folder).select("id", "language", "subset")
    return translate.untranslated(pairs, derived.done(spark, folder), "deu_Latn")


@query("sink_translated", "pairs", _TRANSLATED_SQL)
def sink_translated(spark, folder):
    path = fresh_path(spark, "translated")
    translated = _translated(derived.pairs(spark, folder).select(*_PAIR_COLUMNS))
    writers.write_translated(translated, path)
    return spark.read.schema(translated.schema).json(path)


@query("sink_append", "pairs", _TRANSLATED_SQL)
def sink_append(spark, folder):
    """A job that was stopped after the labelled documents and is run again."""
    path = fresh_path(spark, "appended")
    pairs = derived.pairs(spark, folder).select(*_PAIR_COLUMNS)
    columns = ["prompt", "chosen", "rejected"]
    first = pairs.join(derived.done(spark, folder).select("id"), "id", "left_semi")
    translate.run_translation(first, path, columns, translate.dictionary_translator, "deu_Latn")
    translate.run_translation(pairs, path, columns, translate.dictionary_translator, "deu_Latn", parts=2)
    return translate.read_translation(spark, path, pairs.schema.add("target_language", "string"))


@query(
    "sink_instances",
    "judgements",
    "select model, language, instance_id as position, result from judgements",
)
def sink_instances(spark, folder):
    path = fresh_path(spark, "instances")
    rows = derived.judgements(spark, folder).select(
        "model", "language", F.col("instance_id").alias("position"), "result"
    )
    writers.write_instances(rows, path)
    return readers.read_instances(spark, path)


@query(
    "scan_label_matrix",
    "judgements",
    "select model, language, instance_id::varchar as instance_id, label from judgements",
)
def scan_label_matrix(spark, folder):
    """Models x instances files of labels of every language, with few lines of any length."""
    path = fresh_path(spark, "labels")
    writers.write_label_matrix(derived.judgements(spark, folder).select("model", "language", "instance_id", "label"), path)
    return readers.read_label_matrix(spark, path)


@query(
    "sink_csv",
    "board",
    """select category, model, model_type, round(eng_Latn, 6) as eng_Latn, round(avg_multilingual, 6) as avg_multilingual,
 round(std, 6) as std from board""",
)
def sink_csv(spark, folder):
    path = fresh_path(spark, "leaderboards")
    board = boards.boards(spark, folder)
    writers.write_csv_table(board, path)
    stored = readers.read_csv_table(spark, path, board.schema)
    return stored.withColumns({c: r6(c) for c in ("eng_Latn", "avg_multilingual", "std")})


@query(
    "language_names",
    "pairs dim_languages",
    "select l.language, l.language_name, count(*) as n from pairs p join dim_languages l on l.language = p.language group by 1, 2",
)
def language_names(spark, folder):
    named = derived.pairs(spark, folder).withColumn("language_name", naming.language_name(F.col("language")))
    return named.groupBy("language", "language_name").agg(F.count(F.lit(1)).alias("n"))
