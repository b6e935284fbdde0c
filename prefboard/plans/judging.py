"""Queries on judge prompts, verdicts, votes and the judging and scoring jobs."""

import string
from functools import reduce

from pyspark.sql import functions as F

from prefboard import runs
from prefboard.functions import prompt_texts as P
from prefboard.functions import text
from prefboard.functions.hashing import coin
from prefboard.operators import judging, rewards, shape
from prefboard.operators.answers import AnswerStore
from prefboard.plans.registry import query, r6
from prefboard.plans.views import quote
from prefboard.session import fresh_path
from prefboard.sources import derived, readers


def _sql_fill(template, **values):
    parts = []
    for literal, name, _, _ in string.Formatter().parse(template):
        if literal:
            parts.append(quote(literal))
        if name:
            parts.append(values[name])
    return " || ".join(parts)


_COIN = "substring(md5('shuffle:3:' || language || ':' || id), 1, 1) < '8'"
_SHUFFLED = f"""(select id, language, subset, prompt, {_COIN} as is_shuffled,
 case when {_COIN} then rejected else chosen end as a, case when {_COIN} then chosen else rejected end as b from pairs)"""
_SINGLE_USER = _sql_fill(P.JUDGE_USER, question="prompt", answer_a="a", answer_b="b")


def _prompted(spark, folder, modifier=None, languages=False):
    pairs = shape.dialogues(derived.pairs(spark, folder))
    src = tgt = None
    if languages:
        names = derived.language_dimension(spark).select("language", "language_name")
        pairs = pairs.join(names, "language")
        src, tgt = F.col("language_name"), F.lit("English")
    shuffled = judging.shuffle_positions(pairs, seed=3)
    return judging.with_prompts(shuffled, modifier, src, tgt)


@query(
    "judge_prompt_single",
    "pairs",
    f"select id, language, {quote(P.JUDGE_SYSTEM)} as system_prompt, {_SINGLE_USER} as user_prompt from {_SHUFFLED}",
)
def judge_prompt_single(spark, folder):
    return _prompted(spark, folder).select("id", "language", "system_prompt", "user_prompt")


_TWO_TURN_USER = _sql_fill(
    P.TWO_TURN_USER,
    question_1="a[1]",
    question_2="a[3]",
    answer_a_1="a[2]",
    answer_b_1="b[2]",
    answer_a_2="a[4]",
    answer_b_2="b[4]",
)


def _sql_conversation(messages, side):
    said = f"case when m[1] = 'user' then '### User:' else '### Assistant {side}:' end || chr(10) || m[2] || chr(10) || chr(10)"
    return f"""'<|The Start of Assistant {side}''s Conversation with User|>' || chr(10) || chr(10)
 || array_to_string(list_transform(list_zip(speakers, {messages}), lambda m: {said}), '')
 || '<|The End of Assistant {side}''s Conversation with User|>'"""


_MANY_TURN_USER = f"{_sql_conversation('a', 'A')} || chr(10) || chr(10) || chr(10) || {_sql_conversation('b', 'B')}"


@query(
    "judge_prompt_multi",
    "multi_turn",
    f"""select id, n_messages,
 case when len(a) > 4 then {quote(P.MANY_TURN_SYSTEM)} when len(a) > 2 then {quote(P.TWO_TURN_SYSTEM)} else {quote(P.JUDGE_SYSTEM)} end as system_prompt,
 case when len(a) > 4 then {_MANY_TURN_USER} when len(a) > 2 then {_TWO_TURN_USER} else {_sql_fill(P.JUDGE_USER, question="a[1]", answer_a="a[2]", answer_b="b[2]")} end as user_prompt
from (select id, n_messages, speakers, talk as a, list_append(talk[1:-2], '[alt] ' || talk[-1]) as b from multi_turn)""",
)
def judge_prompt_multi(spark, folder):
    d = shape.dialogues(derived.multi_turn_pairs(spark, folder))
    system, user = text.judge_prompts(F.col("text_chosen"), F.col("text_rejected"))
    return d.select(
        "id",
        F.size("text_chosen").cast("long").alias("n_messages"),
        system.alias("system_prompt"),
        user.alias("user_prompt"),
    )


_RUBRIC_USER = _sql_fill(
    P.RUBRIC_USER, orig_instruction="prompt", response_A="a", response_B="b", score_rubric=quote(P.SCORE_RUBRIC)
)


@query(
    "judge_prompt_rubric",
    "pairs",
    f"select id, language, {quote(P.RUBRIC_SYSTEM)} as system_prompt, {_RUBRIC_USER} as user_prompt from {_SHUFFLED}",
)
def judge_prompt_rubric(spark, folder):
    return _prompted(spark, folder, "prometheus").select("id", "language", "system_prompt", "user_prompt")


@query(
    "judge_prompt_prefix",
    "pairs",
    f"""select id, language, cast(null as varchar) as system_prompt,
 {quote(P.PREFIX_INSTRUCTION)} || {_SINGLE_USER} as user_prompt from {_SHUFFLED}""",
)
def judge_prompt_prefix(spark, folder):
    return _prompted(spark, folder, "gemini").select("id", "language", "system_prompt", "user_prompt")


_NAMED = {"src_lang": "language_name", "tgt_lang": "'English'"}


@query(
    "judge_prompt_lang",
    "pairs dim_languages",
    f"""select s.id, s.language, {_sql_fill(P.JUDGE_SYSTEM_LANG, **_NAMED)} as system_prompt,
 {_sql_fill(P.RUBRIC_SYSTEM_LANG, **_NAMED)} as rubric_system_prompt,
 {_sql_fill(P.PREFIX_INSTRUCTION_LANG, **_NAMED)} || {_SINGLE_USER} as prefixed_user_prompt
from {_SHUFFLED} s join dim_languages l on l.language = s.language""",
)
def judge_prompt_lang(spark, folder):
    prompted = _prompted(spark, folder, languages=True)
    names = (F.col("language_name"), F.lit("English"))
    answers = (F.col("answer_a"), F.col("answer_b"))
    return prompted.select(
        "id",
        "language",
        "system_prompt",
        text.judge_prompts(*answers, "prometheus", *names)[0].alias("rubric_system_prompt"),
        text.judge_prompts(*answers, "gemini", *names)[1].alias("prefixed_user_prompt"),
    )


@query(
    "merge_system",
    "pairs",
    f"""select id, language, 1 as n_merged, 'user' as merged_role,
 {quote(P.JUDGE_SYSTEM)} || chr(10) || chr(10) || {_SINGLE_USER} as merged_text,
 2 as n_separate, 'system' as separate_role, {quote(P.JUDGE_SYSTEM)} as separate_text from {_SHUFFLED}""",
)
def merge_system(spark, folder):
    prompted = _prompted(spark, folder)
    prompts = (F.col("system_prompt"), F.col("user_prompt"))
    return prompted.withColumns(
        {"merged": text.chat_messages(*prompts, "gemma"), "separate": text.chat_messages(*prompts, "llama-3.1")}
    ).select(
        "id",
        "language",
        *[
            c.alias(f"{end}")
            for name in ("merged", "separate")
            for c, end in (
                (F.size(name), f"n_{name}"),
                (F.col(name)[0]["role"], f"{name}_role"),
                (F.col(name)[0]["content"], f"{name}_text"),
            )
        ],
    )


_VERDICT = "case when contains(judgment, '[[A]]') then 'A' when contains(judgment, '[[B]]') then 'B' else 'error' end"


@query("parse_verdict", "verdicts", f"select id, {_VERDICT} as verdict from verdicts")
def parse_verdict(spark, folder):
    return derived.verdicts(spark, folder).select("id", text.parse_verdict(F.col("judgment")).alias("verdict"))


@query(
    "parse_verdict_rubric",
    "verdicts",
    """select id, case when contains(judgment, '[RESULT]') and right(judgment, 1) in ('A', 'B')
 then right(judgment, 1) else 'error' end as verdict from verdicts""",
)
def parse_verdict_rubric(spark, folder):
    verdict = text.parse_verdict(F.col("judgment"), "prometheus")
    return derived.verdicts(spark, folder).select("id", verdict.alias("verdict"))


@query("shuffle_positions", "pairs", f"select id, language, is_shuffled, a as answer_a, b as answer_b from {_SHUFFLED}")
def shuffle_positions(spark, folder):
    shuffled = judging.shuffle_positions(shape.dialogues(derived.pairs(spark, folder)), seed=3)
    return shuffled.select(
        "id",
        "language",
        "is_shuffled",
        F.col("answer_a")[1]["content"].alias("answer_a"),
        F.col("answer_b")[1]["content"].alias("answer_b"),
    )


@query(
    "verdict_score",
    "verdicts",
    f"""select id, verdict, case when verdict = 'error' then 0.5
 when (verdict = 'B') = (substring(md5('shuffle:5:' || id), 1, 1) < '8') then 1.0 else 0.0 end::double as result
from (select id, {_VERDICT} as verdict from verdicts)""",
)
def verdict_score(spark, folder):
    parsed = derived.verdicts(spark, folder).select("id", text.parse_verdict(F.col("judgment")).alias("verdict"))
    return parsed.withColumn("result", judging.verdict_result(F.col("verdict"), coin("shuffle", 5, "id")))


@query(
    "poll_vote",
    "votes",
    """select instance_id, arg_min(vote, (-n, vote)) as winner
from (select instance_id, vote, count(*) as n from votes group by instance_id, vote) group by instance_id""",
)
def poll_vote(spark, folder):
    return judging.majority_of_rows(derived.votes(spark, folder)).select("instance_id", "winner")


_MARGINS = (0, 20, 50)
_VOTES = ", ".join(
    f"case when length(a) > length(b) + {m} then 'A' when length(b) > length(a) + {m} then 'B' else 'error' end as v{m}"
    for m in _MARGINS
)


def _sql_votes(verdict):
    return " + ".join(f"(v{m} = '{verdict}')::int" for m in _MARGINS)


@query(
    "judge_pairs",
    "pairs",
    f"""select id, language, is_shuffled, winner, case when winner = 'error' then 0.5
 when (winner = 'B') = is_shuffled then 1.0 else 0.0 end::double as result
from (select *, case when {_sql_votes("A")} > 1 then 'A' when {_sql_votes("B")} > 1 then 'B'
  when {_sql_votes("error")} > 1 then 'error' else 'A' end as winner
 from (select *, {_VOTES} from {_SHUFFLED}))""",
)
def judge_pairs(spark, folder):
    judges = [judging.length_judge(m) for m in _MARGINS]
    judged = judging.judge_pairs(shape.dialogues(derived.pairs(spark, folder)), judges, seed=3)
    return judged.select("id", "language", "is_shuffled", "winner", "result")


def _multi_turn_pairs(spark, folder):
    return derived.multi_turn_pairs(spark, folder).withColumns(
        {"language": F.lit("eng_Latn"), "subset": F.lit("alpacaeval-easy"), "position": F.col("id")}
    )


def _counted(df, **columns):
    return df.groupBy(F.lit("eng_Latn").alias("language")).agg(*[c.alias(name) for name, c in columns.items()])


@query(
    "resume_judging",
    "multi_turn",
    """select 'eng_Latn' as language, count(*) as num_total, sum(0.0) as num_correct,
 count(distinct prompt) filter (n_messages <= 4) as asked_first, count(distinct prompt) as asked
from (select n_messages, case when substring(md5('shuffle:3:eng_Latn:' || id), 1, 1) < '8' then [alt, talk] else [talk, alt] end as prompt
 from (select *, list_append(talk[1:-2], '[alt] ' || talk[-1]) as alt from multi_turn))""",
)
def resume_judging(spark, folder):
    """A run that has stopped behind the dialogues of up to four messages and is run again.

    `asked` counts the answers stored, one for each different prompt, whichever run asked.
    """
    store, judge = AnswerStore(spark, fresh_path(spark, "answers")), {"org/by-length": judging.length_judge()}
    pairs = shape.dialogues(_multi_turn_pairs(spark, folder))
    judging.judge_pairs_from(pairs, judge, store, seed=3, max_turns=4)
    first = _counted(store.known(), asked_first=F.count(F.lit(1)))
    judged = judging.judge_pairs_from(pairs, judge, store, seed=3, parts=3)
    counts = [
        _counted(judged, num_total=F.count("result"), num_correct=F.sum("result")),
        first,
        _counted(store.known(), asked=F.count(F.lit(1))),
    ]
    every = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), counts)
    return every.groupBy("language").agg(*[F.sum(c).alias(c) for c in every.columns if c != "language"])


@query(
    "run_judges",
    "multi_turn",
    """select 'eng_Latn' as language, count(*) filter (n_messages <= 6) as num_total,
 sum(0.0) filter (n_messages <= 6) as num_correct, avg(0.0) filter (n_messages <= 6) as accuracy,
 count(*) filter (n_messages > 6) as not_judged from multi_turn""",
)
def run_judges(spark, folder):
    """A whole judging run over dialogues of one or several turns, from stored documents.

    The sample judge prefers the longer conversation, here always the rejected one.
    """
    path = fresh_path(spark, "judged")
    pairs = _multi_turn_pairs(spark, folder)
    rows = runs.run_judges(pairs, {"org/by-length": judging.length_judge()}, path, "dialogues", max_turns=6)
    documents = readers.read_result_documents(spark, f"{path}/documents")
    left_out = rows.where("status <> 'judged'").groupBy("language").agg(F.count(F.lit(1)).alias("not_judged"))
    scores = documents.select("language", "scores.*").join(left_out, "language", "left")
    return scores.select(
        "language", "num_total", "num_correct", r6("accuracy", "accuracy"), F.coalesce("not_judged", F.lit(0)).alias("not_judged")
    )


@query(
    "score_pairs",
    "pairs",
    """select id, language, length(chosen)::double as chosen_score, length(rejected)::double as rejected_score,
 case when length(chosen) > length(rejected) then 1 else 0 end as result from pairs""",
)
def score_pairs(spark, folder):
    scored = rewards.score_pairs(shape.dialogues(derived.pairs(spark, folder)), rewards.length_scorer)
    return scored.select("id", "language", "chosen_score", "rejected_score", "result")


@query(
    "reward_win",
    "rewards",
    "select id, chosen, rejected, case when chosen > rejected then 1 else 0 end as result from rewards",
)
def reward_win(spark, folder):
    return rewards.with_wins(derived.rewards(spark, folder))


@query(
    "reward_stats",
    "rewards",
    """select count(*) as n, round(avg(chosen), 6) as mean_chosen, round(stddev_pop(chosen), 6) as std_chosen,
 round(avg(rejected), 6) as mean_rejected, round(stddev_pop(rejected), 6) as std_rejected,
 round(avg(chosen - rejected), 6) as mean_margin, round(avg(case when chosen > rejected then 1 else 0 end), 6) as accuracy
from rewards""",
)
def reward_stats(spark, folder):
    stats = rewards.reward_stats(derived.rewards(spark, folder))
    return stats.select("n", *[r6(c, c) for c in stats.columns if c != "n"])


@query(
    "reward_histogram",
    "rewards",
    """select side, bin, count(*) as n, round(min(bin * step + low), 6) as bin_low
from (select side, low, step, b0 - (score < b0 * step + low)::int
  + (score >= (b0 + 1) * step + low and b0 < 29)::int as bin
 from (select *, (high - low) / 30 as step, least(floor((score - low) / (high - low) * 30), 29)::int as b0
  from (select side, score, min(score) over (partition by side) as low, max(score) over (partition by side) as high
   from (select 'chosen' as side, chosen as score from rewards union all select 'rejected', rejected from rewards))))
group by side, bin""",
)
def reward_histogram(spark, folder):
    bins = rewards.reward_histogram(derived.rewards(spark, folder))
    return bins.withColumn("bin_low", r6("bin_low"))
