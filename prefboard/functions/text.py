"""Prompt building, verdict parsing and text segmentation as native columns."""

import string
import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from prefboard.functions import prompt_texts as P


def fill(template: str, **values) -> Column:
    """`template` with its placeholders replaced by columns.

    The pieces are concatenated, so braces inside user text stay as they are.
    """
    parts = []
    for text, name, _, _ in string.Formatter().parse(template):
        if text:
            parts.append(F.lit(text))
        if name:
            parts.append(values[name])
    return F.concat(*parts)


def without_system(messages: Column) -> Column:
    """The messages of user and assistant."""
    return F.filter(messages, lambda m: m["role"] != "system")


def content(messages: Column, index: int) -> Column:
    """Text of the message at a zero-based index, null when there is none."""
    return F.get(messages, index)["content"]


def _system(plain, with_languages, src_lang, tgt_lang):
    if src_lang is None:
        return F.lit(plain)
    return fill(with_languages, src_lang=src_lang, tgt_lang=tgt_lang)


def single_turn_user(question: Column, answer_a: Column, answer_b: Column) -> Column:
    return fill(P.JUDGE_USER, question=question, answer_a=content(answer_a, 1), answer_b=content(answer_b, 1))


def two_turn_user(question: Column, answer_a: Column, answer_b: Column) -> Column:
    return fill(
        P.TWO_TURN_USER,
        question_1=question,
        question_2=content(answer_a, 2),
        answer_a_1=content(answer_a, 1),
        answer_b_1=content(answer_b, 1),
        answer_a_2=content(answer_a, 3),
        answer_b_2=content(answer_b, 3),
    )


def _conversation(messages: Column, side: str) -> Column:
    """All messages of one side, laid out like those of the two-turn prompt."""
    start = F.lit(f"<|The Start of Assistant {side}'s Conversation with User|>\n\n")

    def said(so_far, m):
        speaker = F.when(m["role"] == "user", "### User:\n").otherwise(f"### Assistant {side}:\n")
        return F.concat(so_far, speaker, m["content"], F.lit("\n\n"))

    return F.concat(F.aggregate(messages, start, said), F.lit(f"<|The End of Assistant {side}'s Conversation with User|>"))


def many_turn_user(answer_a: Column, answer_b: Column) -> Column:
    return F.concat(_conversation(answer_a, "A"), F.lit("\n\n\n"), _conversation(answer_b, "B"))


def rubric_user(question: Column, answer_a: Column, answer_b: Column) -> Column:
    return fill(
        P.RUBRIC_USER,
        orig_instruction=question,
        response_A=content(answer_a, 1),
        response_B=content(answer_b, 1),
        score_rubric=F.lit(P.SCORE_RUBRIC),
    )


def judge_prompts(answer_a: Column, answer_b: Column, modifier=None, src_lang=None, tgt_lang=None, all_turns=True):
    """System and user prompt columns for one prompt family.

    Both answers are message lists; system messages are no part of the question or
    the answers. The question is the first other message. Lists of more than two
    other messages get the two-turn texts, which show four; lists of more than four get
    texts that show them all, or their first four without `all_turns`. The rubric
    family has no two-turn form: such rows fail the job. The prefix family has no system
    prompt; its instruction stands in front of the user prompt.
    """
    answer_a, answer_b = without_system(answer_a), without_system(answer_b)
    question = content(answer_a, 0)
    two_turns = F.size(answer_a) > 2
    many_turns = (F.size(answer_a) > 4) if all_turns else F.lit(False)
    if modifier == "prometheus":
        user = F.when(
            two_turns, F.raise_error(F.lit("the rubric prompts do not support several turns"))
        ).otherwise(rubric_user(question, answer_a, answer_b))
        return _system(P.RUBRIC_SYSTEM, P.RUBRIC_SYSTEM_LANG, src_lang, tgt_lang), user
    user = (
        F.when(many_turns, many_turn_user(answer_a, answer_b))
        .when(two_turns, two_turn_user(question, answer_a, answer_b))
        .otherwise(single_turn_user(question, answer_a, answer_b))
    )
    if modifier == "gemini":
        prefix = _system(P.PREFIX_INSTRUCTION, P.PREFIX_INSTRUCTION_LANG, src_lang, tgt_lang)
        return F.lit(None).cast("string"), F.concat(prefix, user)
    system = (
        F.when(many_turns, _system(P.MANY_TURN_SYSTEM, P.MANY_TURN_SYSTEM_LANG, src_lang, tgt_lang))
        .when(two_turns, _system(P.TWO_TURN_SYSTEM, P.TWO_TURN_SYSTEM_LANG, src_lang, tgt_lang))
        .otherwise(_system(P.JUDGE_SYSTEM, P.JUDGE_SYSTEM_LANG, src_lang, tgt_lang))
    )
    return system, user


def message(role: str, text: Column) -> Column:
    return F.struct(F.lit(role).alias("role"), text.alias("content"))


def chat_messages(system: Column, user: Column, modifier=None) -> Column:
    """Messages sent to a chat model; gemma takes the system text in the user message."""
    if modifier == "gemma":
        return F.array(message("user", F.concat(system, F.lit("\n\n"), user)))
    return F.when(system.isNull(), F.array(message("user", user))).otherwise(
        F.array(message("system", system), message("user", user))
    )


def parse_verdict(judgment: Column, modifier=None) -> Column:
    """`A`, `B` or `error` from a judge's answer."""
    if modifier == "prometheus":
        last = F.right(judgment, F.lit(1))
        return F.when(judgment.contains("[RESULT]") & last.isin("A", "B"), last).otherwise(F.lit("error"))
    return (
        F.when(judgment.contains("[[A]]"), F.lit("A"))
        .when(judgment.contains("[[B]]"), F.lit("B"))
        .otherwise(F.lit("error"))
    )


def lines(text: Column) -> Column:
    return F.split(text, "\n")


def join_lines(segments: Column) -> Column:
    """Lines put together again; a line break inside a segment is dropped."""
    return F.array_join(F.transform(segments, lambda s: F.replace(s, F.lit("\n"), F.lit(""))), "\n")


# Marks that end a sentence before white space (Latin, Greek, Cyrillic, Hebrew,
# Arabic, Urdu and Indic texts) and without it (Chinese and Japanese), and what may close behind.
SENTENCE_END, SENTENCE_END_CJK = ".!?\u2026\u061f\u06d4\u0964\u0965\u05c3\u037e", "\u3002\uff01\uff1f\uff61"
SENTENCE_CLOSE = "\"')\u00bb\u2019\u201d\u203a\u300d\u300f\u3011\uff09]"
# Abbreviations behind which a sentence goes on.
ABBREVIATIONS = (
    "Dr", "Mr", "Mrs", "Ms", "Prof", "St", "Sr", "Jr", "vs", "etc", "e.g", "i.e", "cf", "No", "Nr", "Fig", "approx",
    "z.B", "d.h", "u.a", "bzw", "ca", "Sra", "Dra", "p.ej", "Mme", "Mlle", "p.ex", "Sig", "Dott", "\u0434\u0440", "\u0442.\u0435",
)


def sentence_marks():
    """`(pattern, replacement)` in turn, which put U+0001 at every boundary of a text.

    The patterns mean the same to every engine of regular expressions; groups are `$1`.
    """
    white, close = "[ \\t\\r\\n\\f]", SENTENCE_CLOSE.replace("]", "\\]")
    known = "|".join(a.replace(".", "\\.") for a in ABBREVIATIONS)
    return [
        (f"([{SENTENCE_END}][{close}]*)({white})", "$1\x01$2"),
        (f"([{SENTENCE_END_CJK}]+[{close}]*)([^{SENTENCE_END_CJK}{close}\x01])", "$1\x01$2"),
        # abbreviations, initials and ordinals do not end a sentence
        (f"(^|[^\\p{{L}}\\p{{N}}])((?:{known}|\\p{{Lu}}|[0-9]{{1,2}})\\.)\x01", "$1$2"),
    ]


def sentences(text: Column) -> Column:
    """Sentences of a text in any of the languages.

    A full stop or another ending mark, with closing quotes or brackets behind it, ends a
    sentence before white space; Chinese and Japanese marks need none. Abbreviations, single
    capital letters and numbers of one or two digits go on behind their full stop, and a
    full stop inside a word or number is none.
    """
    for pattern, replacement in sentence_marks():
        text = F.regexp_replace(text, pattern, replacement)
    return F.split(text, "\x01[ \\t\\r\\n\\f]*")


def join_sentences(segments: Column) -> Column:
    return F.array_join(segments, " ")


@F.pandas_udf(T.StringType())
def _nfkc(texts: pd.Series) -> pd.Series:
    return texts.map(lambda t: unicodedata.normalize("NFKC", t), na_action="ignore")


def normalize_nfkc(text: Column) -> Column:
    """NFKC form; ASCII texts are already normal and do not travel to Python."""
    non_ascii = F.when(text.rlike("[^\\x00-\\x7F]"), text)
    return F.coalesce(_nfkc(non_ascii), text)
