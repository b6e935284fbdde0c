"""Pairwise judging: position shuffle, prompts, judge calls, votes and results.

A judge is a function `judge(systems, users) -> answers` over equally long lists
of texts. It runs inside Spark tasks on Arrow batches; retries, threads and rate
limits of a model service belong inside it.
"""

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from prefboard.functions import text
from prefboard.functions.hashing import coin
from prefboard.operators.answers import prompt_key

VERDICTS = ("A", "B", "error")


def shuffle_positions(df: DataFrame, seed=0, keys=("language", "id")) -> DataFrame:
    """Adds `is_shuffled`, and `answer_a` / `answer_b` exchanged where it is set."""
    flagged = df.withColumn("is_shuffled", coin("shuffle", seed, *keys))
    swap = F.col("is_shuffled")
    return flagged.withColumns(
        {
            "answer_a": F.when(swap, F.col("text_rejected")).otherwise(F.col("text_chosen")),
            "answer_b": F.when(swap, F.col("text_chosen")).otherwise(F.col("text_rejected")),
        }
    )


def verdict_result(verdict: Column, is_shuffled: Column) -> Column:
    """1 when the chosen answer won, 0 when it lost, 0.5 for anything else."""
    winner = F.when(is_shuffled, "B").otherwise("A")
    return F.when(verdict == winner, 1.0).when(verdict.isin("A", "B"), 0.0).otherwise(0.5)


def majority(votes: Column) -> Column:
    """Most frequent verdict of a vote list; the smallest label among equals."""

    def count_of(verdict):
        return F.size(F.filter(votes, lambda vote: vote == verdict))

    counts = {v: count_of(v) for v in VERDICTS}
    top = F.greatest(*counts.values())
    return F.coalesce(*[F.when(n == top, v) for v, n in counts.items()])


def majority_of_rows(votes: DataFrame, keys=("instance_id",)) -> DataFrame:
    """Most frequent vote per instance from one row per vote.

    Three counters with partial aggregation; no vote list is collected.
    """
    counted = votes.groupBy(*keys).agg(
        *[F.count_if(F.col("vote") == v).alias(f"n_{v}") for v in VERDICTS]
    )
    top = F.greatest(*[F.col(f"n_{v}") for v in VERDICTS])
    return counted.withColumn("winner", F.coalesce(*[F.when(F.col(f"n_{v}") == top, v) for v in VERDICTS]))


def judge_column(judge, system: Column, user: Column) -> Column:
    """A judge's answers as a column; calls are never repeated by the optimizer.

    A row without a user prompt is not asked and has no answer.
    """

    @F.pandas_udf(T.StringType())
    def ask(systems: pd.Series, users: pd.Series) -> pd.Series:
        asked = users.notna()
        answers = pd.Series([None] * len(users), index=users.index, dtype=object)
        if asked.any():
            answers[asked] = list(judge(systems[asked].tolist(), users[asked].tolist()))
        return answers

    return ask.asNondeterministic()(system, user)


def with_prompts(df: DataFrame, modifier=None, src_lang=None, tgt_lang=None, all_turns=True) -> DataFrame:
    """Adds `system_prompt` and `user_prompt` for the shuffled answers."""
    system, user = text.judge_prompts(F.col("answer_a"), F.col("answer_b"), modifier, src_lang, tgt_lang, all_turns)
    return df.withColumns({"system_prompt": system, "user_prompt": user})


def asked_pairs(
    df: DataFrame, modifier=None, src_lang=None, tgt_lang=None, seed=0, max_turns=None, keys=("language", "id"), all_turns=True
) -> DataFrame:
    """Dialogue pairs with shuffled answers, `status`, `system_prompt` and the `user_prompt` to ask.

    `status` is `judged`; `too_long` for dialogues of more than `max_turns` messages,
    where that is given; `no_prompt` for dialogues that do not fill the prompt (of one
    message or three). Only judged rows have a user prompt.
    """
    prompted = with_prompts(shuffle_positions(df, seed, keys), modifier, src_lang, tgt_lang, all_turns)
    too_long = F.size("text_chosen") > max_turns if max_turns else F.lit(False)
    status = F.when(too_long, "too_long").when(F.col("user_prompt").isNull(), "no_prompt").otherwise("judged")
    prompted = prompted.withColumn("status", status)
    if modifier == "gemma":
        # this family has no system role: its text goes in front of the question
        merged = F.concat("system_prompt", F.lit("\n\n"), "user_prompt")
        prompted = prompted.withColumns({"user_prompt": merged, "system_prompt": F.lit(None).cast("string")})
    return prompted.withColumn("user_prompt", F.when(F.col("status") == "judged", F.col("user_prompt")))


def voted_pairs(answered: DataFrame, n_judges: int, modifier=None) -> DataFrame:
    """Asked pairs with `judgment_0` and so on as `votes`, `winner` and `result`; prompts are left out."""
    votes = F.array(*[text.parse_verdict(F.col(f"judgment_{i}"), modifier) for i in range(n_judges)])
    votes = F.when(F.col("status") == "judged", votes)
    voted = answered.withColumn("votes", votes).withColumn("winner", F.when(votes.isNotNull(), majority(F.col("votes"))))
    result = F.when(F.col("winner").isNotNull(), verdict_result(F.col("winner"), F.col("is_shuffled")))
    helpers = ["answer_a", "answer_b", "system_prompt", "user_prompt"]
    return voted.withColumn("result", result).drop(*helpers)


def require_odd(judges) -> None:
    if len(judges) % 2 == 0:
        raise ValueError("an ensemble needs an odd number of judges")


def judge_pairs(
    df: DataFrame, judges, modifier=None, src_lang=None, tgt_lang=None, seed=0, max_turns=None, keys=("language", "id"),
    all_turns=True,
) -> DataFrame:
    """Results of an ensemble of judges on dialogue pairs.

    `judges` is one judge or an odd number of them. Every judge adds one column,
    so the vote needs neither a join nor a shuffle. Adds `votes`, `winner`,
    `result` and the `status` of `asked_pairs`. Only judged rows are asked; the
    others have neither votes nor a result. Dialogues are shown whole; without
    `all_turns` those of more than four messages by their first four.
    """
    judges = list(judges) if isinstance(judges, (list, tuple)) else [judges]
    require_odd(judges)
    asked = asked_pairs(df, modifier, src_lang, tgt_lang, seed, max_turns, keys, all_turns)
    answers = [judge_column(j, F.col("system_prompt"), F.col("user_prompt")) for j in judges]
    return voted_pairs(asked.withColumns({f"judgment_{i}": a for i, a in enumerate(answers)}), len(judges), modifier)


def judge_pairs_from(
    df: DataFrame, judges: dict, store, modifier=None, src_lang=None, tgt_lang=None, seed=0, max_turns=None,
    keys=("language", "id"), all_turns=True, parts=1, tasks=None,
) -> DataFrame:
    """`judge_pairs` with answers from a store (`answers.AnswerStore`), which is filled first.

    `judges` maps names to judges. What the store lacks is asked in `parts` parts, each
    of which stays answered if the run stops behind it.
    """
    require_odd(judges)
    asked = asked_pairs(df, modifier, src_lang, tgt_lang, seed, max_turns, keys, all_turns)
    keyed = asked.withColumn("prompt_key", prompt_key(F.col("system_prompt"), F.col("user_prompt")))
    store.ask(keyed.select(F.col("prompt_key").alias("key"), "system_prompt", "user_prompt"), judges, parts, tasks)
    return voted_pairs(store.attach(keyed, list(judges)), len(judges), modifier).drop("prompt_key")


def length_judge(margin=0):
    """A rule-based judge for tests: the side longer by more than `margin` wins.

    A side is the answer of a single turn, or the conversation of two turns.
    """
    marks = {
        side: [
            (f"[The Start of Assistant {side}'s Answer]\n", f"\n[The End of Assistant {side}'s Answer]"),
            (f"<|The Start of Assistant {side}'s Conversation", f"<|The End of Assistant {side}'s Conversation"),
        ]
        for side in "AB"
    }

    def answer_length(user, side):
        start, end = next(m for m in marks[side] if m[0] in user)
        head = user.index(start) + len(start)
        return user.index(end, head) - head

    def judge(systems, users):
        answers = []
        for user in users:
            a, b = answer_length(user, "A"), answer_length(user, "B")
            verdict = "[[A]]" if a > b + margin else "[[B]]" if b > a + margin else "no verdict"
            answers.append(f"By length: {verdict}")
        return answers

    return judge
