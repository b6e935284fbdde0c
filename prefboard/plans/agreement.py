"""Queries on label agreement, sampling and human annotation."""

from pyspark.sql import functions as F

from prefboard import runs
from prefboard.functions import lookups
from prefboard.operators import agreement, annotate, leaderboard, results, sampling
from prefboard.plans.registry import placed, query, r6
from prefboard.plans.scores import model_rows
from prefboard.session import fresh_path
from prefboard.sources import derived


@query(
    "align_english",
    "label_pairs",
    "select model, language, instance_id, label, label_eng from label_pairs",
)
def align_english(spark, folder):
    return agreement.label_pairs(derived.judgements(spark, folder), derived.LANGUAGE_CODES)


@query(
    "cohen_kappa",
    "kappa",
    "select instance_id, language, round(kappa, 6) as kappa from kappa where kappa is not null",
)
def cohen_kappa(spark, folder):
    return agreement.instance_kappa(derived.judgements(spark, folder), derived.LANGUAGE_CODES).withColumn("kappa", r6("kappa"))


@query(
    "innermodel_agreement",
    "model_kappa",
    """select model, round(avg(kappa), 6) as mean_kappa, round(stddev_samp(kappa), 6) as std_kappa
from model_kappa where kappa is not null group by model""",
)
def innermodel_agreement(spark, folder):
    rows = agreement.innermodel_agreement(derived.judgements(spark, folder), derived.LANGUAGE_CODES)
    return rows.withColumns({c: r6(c) for c in ("mean_kappa", "std_kappa")})


@query(
    "sorted_by_kappa",
    "model_kappa",
    """select model, round(mean_kappa, 6) as mean_kappa, row_number() over (order by mean_kappa desc, model) as place
from (select model, avg(kappa) as mean_kappa from model_kappa where kappa is not null group by model)""",
)
def sorted_by_kappa(spark, folder):
    rows = agreement.innermodel_agreement(derived.judgements(spark, folder), derived.LANGUAGE_CODES)
    ordered = leaderboard.sort_scores(rows.select("model", "mean_kappa"), "mean_kappa")
    return placed(ordered).withColumn("mean_kappa", r6("mean_kappa"))


def _kappa_with_pairs(spark, folder):
    kappa = agreement.instance_kappa(derived.judgements(spark, folder), derived.LANGUAGE_CODES)
    return agreement.kappa_with_pairs(kappa, derived.pairs(spark, folder))


@query(
    "kappa_with_pairs",
    "kappa pairs",
    """select k.language, k.instance_id::varchar as instance_id, round(k.kappa, 6) as kappa, p.subset, p.prompt, p.chosen, p.rejected
from kappa k join pairs p on p.id = k.instance_id and p.language = k.language where k.kappa is not null""",
)
def kappa_with_pairs(spark, folder):
    return _kappa_with_pairs(spark, folder).withColumn("kappa", r6("kappa"))


_BIN = "least(floor((kappa + 1.0) / 0.1::double), 19)::int"


@query(
    "kappa_histogram",
    "kappa",
    f"select language, {_BIN} as bin, count(*) as n, round({_BIN} * 0.1::double - 1.0, 6) as low from kappa where kappa is not null group by language, 2, 4",
)
def kappa_histogram(spark, folder):
    kappa = agreement.instance_kappa(derived.judgements(spark, folder), derived.LANGUAGE_CODES)
    return agreement.kappa_histogram(kappa).withColumn("low", r6("low"))


@query(
    "kappa_category_share",
    "kappa pairs",
    f"""select language, bin, category, n, round(n / sum(n) over (partition by language, bin), 6) as share
from (select k.language, {_BIN} as bin, s.category, count(*) as n
 from kappa k join pairs p on p.id = k.instance_id and p.language = k.language join dim_subsets s on s.subset = p.subset
 where kappa is not null group by 1, 2, 3)""",
)
def kappa_category_share(spark, folder):
    joined = _kappa_with_pairs(spark, folder).select("language", "subset", "kappa")
    placed = agreement.with_category(joined, lookups.subset_weights(spark))
    return agreement.category_share(placed).withColumn("share", r6("share"))


_SCORED = """scored as (select p.id, p.language, p.subset, p.prompt, j.result as scores
 from pairs p join judgements j on j.language = p.language and j.instance_id = p.position and j.model = 'org/model-1')"""


_SCORED_TWO = _SCORED.replace("from pairs p", "from two_languages p").replace("p.prompt", "p.chosen, p.rejected")


@query(
    "stratified_sample",
    "pairs judgements",
    f"""select id, language, subset, prompt, scores from (
 select s.*, row_number() over (partition by s.language, s.scores order by md5('sample:42:' || s.language || ':' || s.id), s.language, s.id) as r, c.cap
 from (with {_SCORED} select * from scored) s
 join (with {_SCORED} select language, least(60 // count(*), min(n)) as cap
  from (select language, scores, count(*) as n from scored group by 1, 2) group by language) c on c.language = s.language)
where r <= cap""",
)
def stratified_sample(spark, folder):
    sample = runs.sampled_pairs(derived.pairs(spark, folder), model_rows(spark, folder), 60)
    return sample.select("id", "language", "subset", "prompt", "scores")


@query(
    "random_subset",
    "pairs",
    """select id, language, subset, prompt from (
 select *, row_number() over (partition by language order by md5('sample:42:' || language || ':' || id), language, id) as r from pairs)
where r <= 50""",
)
def random_subset(spark, folder):
    return sampling.random_subset(derived.pairs(spark, folder).select("id", "language", "subset", "prompt"), 50)


def answer_key(spark, folder):
    pairs = derived.in_two_languages(derived.pairs(spark, folder))
    return annotate.answer_key(results.attach_results(pairs, model_rows(spark, folder)), seed=7)


@query(
    "annotation_files",
    "two_languages judgements",
    f"""select id, language, scores, swapped, case when swapped = 1 then rejected else chosen end as shown_a,
 case when swapped = 1 then chosen else rejected end as shown_b from (
 select s.*, case when substring(md5('swap:42:' || s.language || ':' || s.id), 1, 1) < '8' then 1 else 0 end as swapped,
  row_number() over (partition by s.language, s.scores order by md5('sample:42:' || s.language || ':' || s.id)) as r, c.cap
 from (with {_SCORED_TWO} select * from scored) s
 join (with {_SCORED_TWO} select language, least(300 // count(*), min(n)) as cap
  from (select language, scores, count(*) as n from scored group by 1, 2) group by language) c on c.language = s.language)
where r <= cap""",
)
def annotation_files(spark, folder):
    """A whole annotation round: sample, answer key, blind task, both read back."""
    path = fresh_path(spark, "annotation")
    pairs = derived.in_two_languages(derived.pairs(spark, folder))
    runs.annotation_files(pairs, path, model_rows(spark, folder), 300)
    key = _read_back(spark, f"{path}/answer_key", "scores double, swapped int")
    task = _read_back(spark, f"{path}/annotation", "completion_a string, completion_b string")
    shown = task.withColumnsRenamed({"completion_a": "shown_a", "completion_b": "shown_b"})
    return key.join(shown, ["language", "id"]).select("id", "language", "scores", "swapped", "shown_a", "shown_b")


def _read_back(spark, path, columns):
    """The named columns of a CSV folder by language, found by its header."""
    header = spark.read.option("header", True).option("multiLine", True).option("quote", '"').option("escape", '"').csv(path)
    names = [part.split() for part in columns.split(", ")]
    return header.select("language", F.col("id").cast("long").alias("id"), *[F.col(n).cast(t).alias(n) for n, t in names])


@query(
    "annotation_swap",
    "answer_key",
    """select id, language, swapped, completion_a as key_a, completion_b as key_b,
 case when swapped = 1 then completion_b else completion_a end as shown_a,
 case when swapped = 1 then completion_a else completion_b end as shown_b from answer_key""",
)
def annotation_swap(spark, folder):
    key = answer_key(spark, folder).withColumns(
        {"key_a": F.col("completion_a"), "key_b": F.col("completion_b"), "swap_bit": F.col("swapped")}
    )
    task = annotate.annotation_task(key)
    return task.select(
        "id",
        "language",
        F.col("swap_bit").alias("swapped"),
        "key_a",
        "key_b",
        F.col("completion_a").alias("shown_a"),
        F.col("completion_b").alias("shown_b"),
    )


def joined_annotations(spark, folder, drop_missing=False):
    return annotate.join_annotations(answer_key(spark, folder), derived.annotations(spark, folder), drop_missing)


@query(
    "join_annotations",
    "human",
    "select id, language, subset, scores, swapped, notes, gold_preference, model_preference from human",
)
def join_annotations(spark, folder):
    return joined_annotations(spark, folder).select(
        "id", "language", "subset", "scores", "swapped", "notes", "gold_preference", "model_preference"
    )


@query("human_unswap", "human", "select id, swapped, human_preference from human")
def human_unswap(spark, folder):
    return joined_annotations(spark, folder).select("id", "swapped", "human_preference")


_HUMAN_EVAL = """select count(*) as n, count(*) filter (scores <> 0.5) as n_decided,
 round(avg(case when human_preference = 'A' then 1.0 else 0.0 end), 6) as human_vs_gold,
 round(avg(case when human_preference = 'A' then 1.0 else 0.0 end) filter (scores <> 0.5), 6) as human_vs_gold_decided,
 round(avg(case when human_preference = model_preference then 1.0 else 0.0 end) filter (scores <> 0.5), 6) as human_vs_model_decided
from human"""


def _rounded_agreement(joined):
    agreed = annotate.human_agreement(joined)
    return agreed.select("n", "n_decided", *[r6(c, c) for c in agreed.columns[2:]])


@query("human_eval", "human", _HUMAN_EVAL)
def human_eval(spark, folder):
    return _rounded_agreement(joined_annotations(spark, folder))


@query("human_eval_dropna", "human", _HUMAN_EVAL + " where human_preference is not null")
def human_eval_dropna(spark, folder):
    return _rounded_agreement(joined_annotations(spark, folder, drop_missing=True))


@query(
    "disagreements",
    "human",
    """select id, language, scores, human_preference, model_preference, 'gold' as against, completion_a, completion_b
from human where human_preference is distinct from gold_preference
union all select id, language, scores, human_preference, model_preference, 'model', completion_a, completion_b
from human where scores <> 0.5 and human_preference is distinct from model_preference""",
)
def disagreements(spark, folder):
    return annotate.disagreements(joined_annotations(spark, folder)).select(
        "id", "language", "scores", "human_preference", "model_preference", "against", "completion_a", "completion_b"
    )
