"""Queries on leaderboards and what is derived from them."""

from pyspark.sql import functions as F

from prefboard.operators import leaderboard as lb
from prefboard.operators import naming, results, shape
from prefboard.plans.registry import placed, query, r6
from prefboard.sources import derived

LANGUAGES = derived.LANGUAGE_CODES
_ROUNDED = ["eng_Latn", "avg_multilingual", "std"]
_BOARD = (
    "round(eng_Latn, 6) as eng_Latn, round(avg_multilingual, 6) as avg_multilingual, round(std, 6) as std"
)


def long_scores(spark, folder):
    """Long scores of every run from one scan of the judgements."""
    return results.all_scores(results.subset_accuracy(derived.judgements(spark, folder)))


def boards(spark, folder):
    return lb.board(long_scores(spark, folder), LANGUAGES)


def overall_board(spark, folder):
    return boards(spark, folder).where(F.col("category") == "Overall")


def overall_long(spark, folder):
    return long_scores(spark, folder).where(F.col("category") == "Overall")


def _rounded(frame, columns=_ROUNDED):
    return frame.withColumns({c: r6(c) for c in columns})


@query(
    "leaderboard_avg",
    "board",
    "select category, model, model_type, round(eng_Latn, 6) as eng_Latn, round(avg_multilingual, 6) as avg_multilingual from board",
)
def leaderboard_avg(spark, folder):
    return _rounded(boards(spark, folder)).drop("std")


@query("leaderboard_std", "board", "select category, model, round(std, 6) as std from board")
def leaderboard_std(spark, folder):
    return boards(spark, folder).select("category", "model", r6("std", "std"))


@query("join_model_type", "board", "select distinct model, model_type from board")
def join_model_type(spark, folder):
    return overall_board(spark, folder).select("model", "model_type")


@query(
    "leaderboard_sorted",
    "board",
    f"""select model, model_type, {_BOARD},
 row_number() over (order by model_type desc, avg_multilingual desc nulls last, model) as place from board where category = 'Overall'""",
)
def leaderboard_sorted(spark, folder):
    ordered = lb.sorted_board(overall_board(spark, folder))
    return _rounded(placed(ordered)).drop("category")


@query(
    "top_models",
    "board",
    f"""select model, {_BOARD}, row_number() over (order by avg_multilingual desc nulls last, model) as place
from board where category = 'Overall' order by avg_multilingual desc nulls last, model limit 10""",
)
def top_models(spark, folder):
    return _rounded(placed(lb.top_models(overall_board(spark, folder)))).drop("category", "model_type")


@query(
    "top_n",
    "board",
    """select model, model_type, round(eng_Latn * 100, 6) as eng_Latn, round(avg_multilingual * 100, 6) as avg_multilingual,
 row_number() over (order by model) as place from (select model, case model_type when 'DPO' then 'Implicit RM' when 'Sequence Classifier' then 'Classifier RM' else model_type end as model_type,
 eng_Latn, avg_multilingual from board where category = 'Overall' and avg_multilingual is not null and eng_Latn is not null
 order by model limit 5)""",
)
def top_n(spark, folder):
    complete = shape.drop_missing(overall_board(spark, folder), ["eng_Latn", "avg_multilingual"])
    first = lb.top_in_order(naming.relabel_model_type(complete), 5, ["model"])
    percent = shape.to_percent(placed(first), ["eng_Latn", "avg_multilingual"])
    return _rounded(percent, ["eng_Latn", "avg_multilingual"]).drop("category", "std")


@query(
    "sorted_by_score",
    "overall_acc",
    "select model, model_type, language, round(score, 6) as score from overall_acc",
)
def sorted_by_score(spark, folder):
    ordered = lb.sort_scores(overall_long(spark, folder), "score")
    return ordered.drop("category").withColumn("score", r6("score"))


@query(
    "sorted_by_drop",
    "drops",
    "select model, round(drop_pct, 6) as drop_pct, row_number() over (order by drop_pct, model) as place from drops",
)
def sorted_by_drop(spark, folder):
    drops = lb.english_drop(overall_board(spark, folder)).select("model", "drop_pct")
    return placed(lb.sort_scores(drops, "drop_pct", ascending=True)).withColumn("drop_pct", r6("drop_pct"))


@query(
    "sorted_by_delta",
    "board",
    """select model, round(delta, 6) as delta, row_number() over (order by delta desc, model) as place
from (select model, (eng_Latn - avg_multilingual) * 100 as delta from board
 where category = 'Overall' and avg_multilingual is not null and eng_Latn is not null)""",
)
def sorted_by_delta(spark, folder):
    delta = lb.english_delta(overall_board(spark, folder)).select("model", "delta")
    return placed(lb.sort_scores(delta, "delta")).withColumn("delta", r6("delta"))


_DROP = "(avg_multilingual - eng_Latn) / nullif(eng_Latn, 0) * 100"


@query(
    "english_drop",
    "board",
    f"""select model, round(max({_DROP}) filter (category = 'Overall'), 6) as overall,
 round(max({_DROP}) filter (category = 'Chat'), 6) as chat, round(max({_DROP}) filter (category = 'Chat Hard'), 6) as chat_hard,
 round(max({_DROP}) filter (category = 'Safety'), 6) as safety, round(max({_DROP}) filter (category = 'Reasoning'), 6) as reasoning
from board where {_DROP} is not null group by model""",
)
def english_drop(spark, folder):
    table = lb.english_drop_table(boards(spark, folder))
    return _rounded(table, ["overall", "chat", "chat_hard", "safety", "reasoning"])


@query(
    "extremes",
    "drops",
    """select model, round(drop_pct, 6) as drop_pct, section from (
 (select model, drop_pct, 'lowest' as section from drops order by drop_pct, model limit 3)
 union all (select model, drop_pct, 'highest' as section from drops order by drop_pct desc, model limit 3))""",
)
def extremes(spark, folder):
    drops = lb.english_drop(overall_board(spark, folder)).select("model", "drop_pct")
    return lb.extremes(drops, "drop_pct").withColumn("drop_pct", r6("drop_pct"))


@query(
    "english_delta",
    "board",
    """select model, round((eng_Latn - avg_multilingual) * 100, 6) as delta,
 round((avg_multilingual - eng_Latn) * 100, 6) as reverse_delta
from board where category = 'Overall' and avg_multilingual is not null and eng_Latn is not null""",
)
def english_delta(spark, folder):
    delta = lb.english_delta(overall_board(spark, folder))
    reverse = lb.english_delta(delta.withColumnRenamed("delta", "forward"), sign=-1)
    return reverse.select("model", r6("forward", "delta"), r6("delta", "reverse_delta"))


@query(
    "category_delta_join",
    "board",
    """select model,
 round(max((avg_multilingual - eng_Latn) * 100) filter (category = 'Chat'), 6) as chat,
 round(max((avg_multilingual - eng_Latn) * 100) filter (category = 'Chat Hard'), 6) as chat_hard,
 round(max((avg_multilingual - eng_Latn) * 100) filter (category = 'Safety'), 6) as safety,
 round(max((avg_multilingual - eng_Latn) * 100) filter (category = 'Reasoning'), 6) as reasoning
from board group by model""",
)
def category_delta_join(spark, folder):
    return _rounded(lb.category_deltas(boards(spark, folder)), ["chat", "chat_hard", "safety", "reasoning"])


@query(
    "pearson_eng",
    "board",
    """select round(corr(eng_Latn, avg_multilingual), 6) as pearson from board
where category = 'Overall' and avg_multilingual is not null and eng_Latn is not null""",
)
def pearson_eng(spark, folder):
    return lb.pearson(overall_board(spark, folder)).select(r6("pearson", "pearson"))


@query(
    "spearman_eng",
    "board",
    """select round(corr(r1, r2), 6) as spearman from (
 select rank() over (order by eng_Latn) + (count(*) over (partition by eng_Latn) - 1) / 2.0 as r1,
  rank() over (order by avg_multilingual) + (count(*) over (partition by avg_multilingual) - 1) / 2.0 as r2
 from board where category = 'Overall' and avg_multilingual is not null and eng_Latn is not null)""",
)
def spearman_eng(spark, folder):
    return lb.spearman(overall_board(spark, folder)).select(r6("spearman", "spearman"))


@query(
    "score_bounds",
    "board",
    """select round(least(min(eng_Latn), min(avg_multilingual)), 6) as low,
 round(greatest(max(eng_Latn), max(avg_multilingual)), 6) as high from board where category = 'Overall'""",
)
def score_bounds(spark, folder):
    return _rounded(shape.bounds(overall_board(spark, folder), ["eng_Latn", "avg_multilingual"]), ["low", "high"])


_MERGED = """(select category, model, case when language in ('zho_Hans', 'zho_Hant') then 'zho' else language end as language,
 avg(score) as score from long_board group by 1, 2, 3)"""


@query(
    "merge_chinese",
    "long_board",
    f"select category, model, language, round(score, 6) as score from {_MERGED}",
)
def merge_chinese(spark, folder):
    return lb.merge_scripts(long_scores(spark, folder)).withColumn("score", r6("score"))


@query(
    "language_variance",
    "long_board",
    f"select category, model, round(var_samp(score * 100), 6) as variance from {_MERGED} where language <> 'eng_Latn' group by category, model",
)
def language_variance(spark, folder):
    return lb.language_variance(long_scores(spark, folder)).withColumn("variance", r6("variance"))


_STATS = """(select category, language, avg(score) * 100 as avg, stddev_samp(score) * 100 as std
 from long_board where language <> 'eng_Latn' group by category, language)"""


@query(
    "language_stats",
    "long_board",
    f"select category, language, round(avg, 6) as avg, round(std, 6) as std from {_STATS}",
)
def language_stats(spark, folder):
    return _rounded(lb.language_stats(long_scores(spark, folder)), ["avg", "std"])


def _described(spark, folder):
    stats = lb.language_stats(long_scores(spark, folder)).where(F.col("category") == "Overall")
    return lb.with_language_metadata(stats, derived.language_dimension(spark))


@query(
    "join_langdata",
    "long_board dim_languages",
    f"""select s.language, round(s.avg, 6) as avg, round(s.std, 6) as std, l.resource_type, l.family, l.script
from {_STATS} s join dim_languages l on l.language = s.language where s.category = 'Overall'""",
)
def join_langdata(spark, folder):
    return _rounded(_described(spark, folder), ["avg", "std"]).drop("category")


@query(
    "exclude_class0",
    "long_board dim_languages",
    f"""select s.language, l.resource_type, round(s.avg, 6) as avg
from {_STATS} s join dim_languages l on l.language = s.language
where s.category = 'Overall' and l.resource_type is distinct from 'Class-0'""",
)
def exclude_class0(spark, folder):
    kept = shape.exclude_value(_described(spark, folder), "resource_type", "Class-0")
    return kept.select("language", "resource_type", r6("avg", "avg"))


@query(
    "ling_dims",
    "language_rows",
    """select 'resource_type' as dimension, resource_type as value, round(avg(avg), 6) as avg, round(avg(std), 6) as std
from language_rows group by 2
union all select 'family', family, round(avg(avg), 6), round(avg(std), 6) from language_rows group by 2
union all select 'script', script, round(avg(avg), 6), round(avg(std), 6) from language_rows group by 2""",
)
def ling_dims(spark, folder):
    return _rounded(lb.linguistic_dimensions(_described(spark, folder)), ["avg", "std"])


@query(
    "compare_systems",
    "board",
    """select a.model, a.model_type, round(a.avg_multilingual, 6) as avg_first, round(b.avg_multilingual, 6) as avg_second
from board a left join (select * from board where category = 'Overall' and model_type <> 'DPO') b on b.model = a.model
where a.category = 'Overall'""",
)
def compare_systems(spark, folder):
    """The second system was not run with the implicit-reward models."""
    first = overall_board(spark, folder)
    judged = derived.judgements(spark, folder).where(F.col("model_type") != "DPO")
    scores = results.all_scores(results.subset_accuracy(judged)).where(F.col("category") == "Overall")
    second = lb.board(scores, LANGUAGES)
    return _rounded(
        lb.compare_systems(first, second, ("avg_first", "avg_second")), ["avg_first", "avg_second"]
    )


_ORDER = ["org/model-6", "org/model-1", "org/model-3", "org/model-0"]


@query(
    "order_by_list",
    "board",
    f"""select model, round(avg_multilingual, 6) as avg_multilingual,
 list_position([{', '.join(repr(m) for m in _ORDER)}], model) as place from board
where category = 'Overall' and model in ({', '.join(repr(m) for m in _ORDER)})""",
)
def order_by_list(spark, folder):
    ordered = lb.order_by_list(overall_board(spark, folder), "model", _ORDER)
    return placed(ordered.select("model", r6("avg_multilingual", "avg_multilingual")))


_PIVOT = ", ".join(
    f"round(max(score) filter (language = '{code}'), 6) as {code}" for code in derived.LANGUAGE_CODES
)


@query("pivot_leaderboard", "overall_acc", f"select model, {_PIVOT} from overall_acc group by model")
def pivot_leaderboard(spark, folder):
    return _rounded(lb.pivot_languages(overall_long(spark, folder), LANGUAGES), LANGUAGES)


_ALIGNED = ", ".join(
    f"round(max(score) filter (language = '{code}'), 6) as {code}_score, max(model_type) filter (language = '{code}') as {code}_model_type"
    for code in derived.LANGUAGE_CODES
)


@query("align_languages", "overall_acc", f"select model, {_ALIGNED} from overall_acc group by model")
def align_languages(spark, folder):
    aligned = lb.align_languages(overall_long(spark, folder), LANGUAGES)
    return _rounded(aligned, [f"{code}_score" for code in LANGUAGES])


@query(
    "unpivot_leaderboard",
    "overall_acc",
    "select model, language, round(score, 6) as score from overall_acc where score is not null",
)
def unpivot_leaderboard(spark, folder):
    wide = lb.pivot_languages(overall_long(spark, folder), LANGUAGES)
    return lb.unpivot_languages(wide, LANGUAGES).withColumn("score", r6("score"))


@query(
    "order_columns",
    "overall_acc board",
    f"""select b.model, round(b.avg_multilingual, 6) as avg, {', '.join('p.' + c for c in sorted(derived.LANGUAGE_CODES))}
from (select * from board where category = 'Overall') b
join (select model, {_PIVOT} from overall_acc group by model) p on p.model = b.model""",
)
def order_columns(spark, folder):
    wide = lb.wide_board(overall_long(spark, folder), LANGUAGES)
    return _rounded(lb.order_columns(wide, LANGUAGES), ["avg", *LANGUAGES])
