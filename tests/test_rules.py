"""Rules of the operators on small hand-made frames."""

import hashlib
import math
import statistics
import tracemalloc
import unicodedata

import duckdb
import numpy as np
import pandas as pd
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from prefboard.functions import fixed, hashing, text
from prefboard.operators import (
    agreement,
    annotate,
    judging,
    leaderboard,
    naming,
    ranking,
    results,
    rewards,
    sampling,
    shape,
    translate,
)
from prefboard.plans import views
from prefboard.sources import batches

CODES = ["eng_Latn", "deu_Latn", "fra_Latn"]


def pair_frame(spark, n=40):
    rows = [
        (i, CODES[i % 3], fixed.SUBSETS[i % 23][0], f"question {i} {{x}}", "c" * (i % 7 + 1), "r" * (i % 5 + 1))
        for i in range(n)
    ]
    return spark.createDataFrame(rows, "id long, language string, subset string, prompt string, chosen string, rejected string")


# prompts and verdicts


def test_language_names_reach_the_system_prompt(spark):
    question = "Ilan ang 7 + 5? Sabihin kung bakit."
    rows = [(1, "eng_Latn", question, "12.", "Labindalawa ang sagot.")]
    pairs = spark.createDataFrame(rows, "id long, language string, prompt string, chosen string, rejected string")
    d = shape.dialogues(pairs)
    for modifier, place in ((None, 0), ("prometheus", 0), ("gemini", 1)):
        prompts = text.judge_prompts(
            F.col("text_chosen"), F.col("text_rejected"), modifier, F.lit("Filipino"), F.lit("English")
        )
        value = d.select(prompts[place]).first()[0]
        assert "Filipino" in value and "English" in value


def test_braces_in_user_text_stay(spark):
    d = shape.dialogues(pair_frame(spark, 3))
    _, user = text.judge_prompts(F.col("text_chosen"), F.col("text_rejected"))
    assert "question 0 {x}" in d.orderBy("id").select(user).first()[0]


@pytest.mark.parametrize(
    "judgment,plain,rubric",
    [
        ("[[A]]", "A", "error"),
        ("[[B]]", "B", "error"),
        ("I don't know", "error", "error"),
        ("[[B]] then [[A]]", "A", "error"),
        ("Feedback: x [RESULT] B", "error", "B"),
        ("Feedback: x [RESULT] A ", "error", "error"),
        ("no mark A", "error", "error"),
        ("", "error", "error"),
    ],
)
def test_verdicts(spark, judgment, plain, rubric):
    row = spark.createDataFrame([(judgment,)], "j string").select(
        text.parse_verdict(F.col("j")), text.parse_verdict(F.col("j"), "prometheus")
    )
    assert tuple(row.first()) == (plain, rubric)


def test_rubric_prompts_reject_several_turns(spark):
    messages = "array<struct<role:string,content:string>>"
    turns = [("user", "q"), ("assistant", "a"), ("user", "q2")]
    pairs = spark.createDataFrame([(1, "eng_Latn", turns, "x", "y")], f"id long, language string, prompt {messages}, chosen string, rejected string")
    _, user = text.judge_prompts(F.col("text_chosen"), F.col("text_rejected"), "prometheus")
    with pytest.raises(Exception, match="several turns"):
        shape.dialogues(pairs).select(user).collect()


def test_gemma_takes_one_message(spark):
    frame = spark.createDataFrame([("s", "u")], "s string, u string")
    merged, separate = (text.chat_messages(F.col("s"), F.col("u"), m) for m in ("gemma", "qwen-2"))
    row = frame.select(merged.alias("m"), separate.alias("n")).first()
    assert [tuple(x) for x in row.m] == [("user", "s\n\nu")]
    assert [tuple(x) for x in row.n] == [("system", "s"), ("user", "u")]


@pytest.mark.parametrize(
    "name,family",
    [
        ("prometheus-gemini", "prometheus"),
        ("gemini-1.5-pro-001", "gemini"),
        ("meta-llama/Meta-Llama-3.1-70B-Instruct", "llama-3.1"),
        ("google/gemma-2-9b-it", "gemma"),
        ("THUDM/glm-4-9b-chat", "glm-4"),
        ("CIR-AMS/BTRM_Qwen2_7b_0613", "qwen-2"),
        ("gpt-4", None),
    ],
)
def test_prompt_families(spark, name, family):
    assert spark.range(1).select(naming.prompt_family(F.lit(name))).first()[0] == family


def test_run_names(spark):
    frame = spark.createDataFrame([(["gpt-4"],), (["command-r"],), (["x/y"],), (["gpt-4", "b", "c"],)], "j array<string>")
    names = [r[0] for r in frame.select(naming.qualified_model(F.col("j"))).collect()]
    assert names == ["openai/gpt-4", "cohere/command-r", "x/y", "PoLL/gpt-4_b_c"]


# judging


def test_position_blind_judge_ignores_the_shuffle(spark):
    d = shape.dialogues(pair_frame(spark))
    scores = [
        {r.id: r.result for r in judging.judge_pairs(d, judging.length_judge(), seed=s).collect()} for s in (1, 2)
    ]
    assert scores[0] == scores[1]
    lengths = {r.id: (len(r.chosen), len(r.rejected)) for r in pair_frame(spark).collect()}
    assert scores[0] == {i: 1.0 if c > r else 0.0 if c < r else 0.5 for i, (c, r) in lengths.items()}


def test_a_judge_that_always_says_a_splits_with_the_bit(spark):
    judged = judging.judge_pairs(shape.dialogues(pair_frame(spark)), lambda s, u: ["[[A]]"] * len(u)).collect()
    assert {r.result for r in judged} == {0.0, 1.0}
    assert all(r.result == (0.0 if r.is_shuffled else 1.0) for r in judged)


def test_gemma_judges_get_no_system_prompt(spark):
    def judge(systems, users):
        assert set(systems) == {None}
        assert all(u.startswith("Please act as an impartial judge") and "\n\n[User Question]" in u for u in users)
        return ["[[B]]" for _ in users]

    judged = judging.judge_pairs(shape.dialogues(pair_frame(spark)), judge, "gemma").collect()
    assert {r.winner for r in judged} == {"B"}


def turns(n):
    """A prompt of `n` messages, so that the dialogue has one more."""
    return [(("user", "assistant")[i % 2], f"m{i}") for i in range(n)]


def test_rows_that_are_not_judged_say_so(spark):
    messages = "array<struct<role:string,content:string>>"
    rows = [(n, "eng_Latn", turns(n - 1), "x", "yy") for n in range(1, 9)]
    rows.append((10, "eng_Latn", [("system", "s"), *turns(1)], "x", "yy"))
    pairs = spark.createDataFrame(rows, f"id long, language string, prompt {messages}, chosen string, rejected string")

    def judge(systems, users):
        assert None not in users
        return ["[[A]]" for _ in users]

    found = {r.id: r for r in judging.judge_pairs(shape.dialogues(pairs), judge, max_turns=6).collect()}
    assert {i: r.status for i, r in found.items()} == {
        1: "no_prompt", 2: "judged", 3: "no_prompt", 4: "judged", 5: "judged", 6: "judged", 7: "too_long", 8: "too_long", 10: "judged",
    }
    assert all((r.result is None) == (r.winner is None) == (r.votes is None) == (r.status != "judged") for r in found.values())
    assert all(r.result in (0.0, 1.0) for r in found.values() if r.status == "judged")
    every = judging.judge_pairs(shape.dialogues(pairs), judge).where("status = 'too_long'")
    assert every.count() == 0


@pytest.mark.parametrize("modifier", [None, "gemini", "gemma"])
def test_long_dialogues_are_judged_on_all_turns(spark, modifier):
    messages = "array<struct<role:string,content:string>>"
    rows = [(n, "eng_Latn", turns(n - 1), "x" * (n % 2 + 1), "yy" if n % 2 == 0 else "y") for n in (2, 4, 5, 6, 9)]
    rows.append((11, "eng_Latn", [*turns(4), ("user", None)], "x", "yy"))
    pairs = spark.createDataFrame(rows, f"id long, language string, prompt {messages}, chosen string, rejected string")
    by_length = judging.length_judge()

    def judge(systems, users):
        for u, s in zip(users, systems):
            if "m5" in u or u.count("### User") > 4:
                assert all(u.count(f"\nm{i}\n") == 2 for i in range(5)) and (s is None or "the last user question" in s)
        return by_length(systems, users)

    d = shape.dialogues(pairs)
    found = {r.id: r for r in judging.judge_pairs(d, judge, modifier, all_turns=True).collect()}
    assert {i: r.result for i, r in found.items()} == {2: 0.0, 4: 0.0, 5: 1.0, 6: 0.0, 9: 1.0, 11: None}
    assert found[11].status == "no_prompt"


def test_even_ensembles_are_refused(spark):
    with pytest.raises(ValueError, match="odd"):
        judging.judge_pairs(shape.dialogues(pair_frame(spark)), [judging.length_judge()] * 2)


def test_vote_ties_go_to_the_smallest_label(spark):
    cases = [(["A", "B", "error"], "A"), (["error", "B", "B"], "B"), (["error", "error", "A"], "error")]
    frame = spark.createDataFrame([(i, c[0]) for i, c in enumerate(cases)], "instance_id long, votes array<string>")
    in_row = [r[0] for r in frame.orderBy("instance_id").select(judging.majority(F.col("votes"))).collect()]
    long = frame.select("instance_id", F.explode("votes").alias("vote"))
    in_rows = [r.winner for r in judging.majority_of_rows(long).orderBy("instance_id").collect()]
    assert in_row == in_rows == [c[1] for c in cases]


def test_max_turns(spark):
    with pytest.raises(ValueError, match="greater than 0"):
        shape.keep_max_turns(shape.dialogues(pair_frame(spark)), 0)
    assert shape.keep_max_turns(shape.dialogues(pair_frame(spark)), 1).count() == 0


# scores and documents


def result_frame(spark, drop=(), languages=CODES):
    rows = [
        (model, kind, language, i, subset, [1.0, 0.0, 0.5][(i * 7 + len(language) + m) % 3])
        for m, (model, kind) in enumerate([("o/g", "Generative RM"), ("o/d", "DPO"), ("o/c", "Sequence Classifier")])
        for language in languages
        for i in range(69)
        for subset in [fixed.SUBSETS[i % 23][0]]
        if (model, language, subset) not in drop
    ]
    return spark.createDataFrame(
        rows, "model string, model_type string, language string, instance_id long, subset string, result double"
    )


def brute_category(accuracies, category):
    weights = {s: w for s, c, w in fixed.SUBSETS if c == category and s in accuracies}
    return sum(accuracies[s] * w for s, w in weights.items()) / sum(weights.values())


def test_missing_subset_is_null_unless_lenient(spark):
    frame = result_frame(spark, drop={("o/g", "deu_Latn", "math-prm")})
    subsets = results.subset_accuracy(frame)
    accuracies = {r.subset: r.accuracy for r in subsets.where("model = 'o/g' and language = 'deu_Latn'").collect()}
    for strict in (True, False):
        rows = results.all_scores(subsets, strict).where("model = 'o/g' and language = 'deu_Latn'").collect()
        scores = {r.category: r.score for r in rows}
        assert scores["Chat"] == pytest.approx(brute_category(accuracies, "Chat"))
        if strict:
            assert scores["Reasoning"] is None and scores["Overall"] is None
        else:
            assert scores["Reasoning"] == pytest.approx(brute_category(accuracies, "Reasoning"))
            assert scores["Overall"] == pytest.approx(statistics.mean(scores[c] for c in fixed.CATEGORIES))
        long = {
            r.category: r.score
            for r in results.category_scores(subsets, strict).where("model = 'o/g' and language = 'deu_Latn'").collect()
        }
        assert {c: pytest.approx(v) if v is not None else None for c, v in long.items()} == {
            c: scores[c] for c in fixed.CATEGORIES
        }


def test_missing_language_makes_average_and_deviation_null(spark):
    frame = result_frame(spark).where("not (model = 'o/d' and language = 'fra_Latn')")
    board = leaderboard.board(results.all_scores(results.subset_accuracy(frame)), CODES).where("category = 'Overall'")
    found = {r.model: r for r in board.collect()}
    assert found["o/d"].avg_multilingual is None and found["o/d"].std is None and found["o/d"].eng_Latn is not None
    assert found["o/g"].avg_multilingual is not None


def test_deviation_is_the_published_one(spark):
    rows = [("m", "t", code, "Overall", score) for code, score in zip(CODES + ["spa_Latn"], (0.9, 0.5, 0.7, 0.65))]
    long = spark.createDataFrame(rows, "model string, model_type string, language string, category string, score double")
    wide = pd.DataFrame({r[2]: [r[4]] for r in rows}).drop(columns="eng_Latn")
    wide["Avg"] = wide.mean(axis=1)
    found = leaderboard.board(long, CODES + ["spa_Latn"]).first()
    assert found.avg_multilingual == pytest.approx(wide["Avg"][0])
    assert found.std == pytest.approx(wide.std(axis=1)[0])


def test_pivot_and_unpivot_are_inverse(spark):
    long = results.all_scores(results.subset_accuracy(result_frame(spark))).where("category = 'Overall'")
    rows = {(r.model, r.language): r.score for r in long.collect()}
    back = leaderboard.unpivot_languages(leaderboard.pivot_languages(long, CODES), CODES)
    assert {(r.model, r.language): r.score for r in back.collect()} == rows


def test_model_type_comes_from_the_first_language(spark):
    rows = [("m", "DPO", "fra_Latn", "Overall", 0.1), ("m", "Sequence Classifier", "deu_Latn", "Overall", 0.2)]
    long = spark.createDataFrame(rows, "model string, model_type string, language string, category string, score double")
    assert leaderboard.board(long, CODES).first().model_type == "Sequence Classifier"


def test_lookup_is_exact_and_fails_without_rows(spark):
    frame = result_frame(spark)
    assert results.model_results(frame, "o/g", "deu_Latn").count() == 69
    with pytest.raises(Exception, match="no results of model 'o'"):
        results.model_results(frame, "o").count()


def test_english_drop_without_english(spark):
    rows = [("a", "Overall", 0.5, 0.4), ("b", "Overall", 0.0, 0.4), ("c", "Overall", None, 0.4), ("d", "Overall", 0.5, None)]
    frame = spark.createDataFrame(rows, "model string, category string, eng_Latn double, avg_multilingual double")
    found = leaderboard.english_drop(frame).collect()
    assert [(r.model, pytest.approx(-20.0)) for r in found] == [(r.model, r.drop_pct) for r in found]
    assert [r.model for r in found] == ["a"]


def test_rank_correlation_with_ties(spark):
    first, second = [0.1, 0.2, 0.2, 0.4, 0.5, 0.5], [3.0, 1.0, 2.0, 2.0, 5.0, 6.0]
    frame = spark.createDataFrame(list(zip(first, second)), "eng_Latn double, avg_multilingual double")
    data = pd.DataFrame({"a": first, "b": second})
    assert leaderboard.spearman(frame).first()[0] == pytest.approx(data.a.rank().corr(data.b.rank()))
    assert leaderboard.pearson(frame).first()[0] == pytest.approx(data.a.corr(data.b))


def test_chinese_scripts_merge_and_keep_single_values(spark):
    rows = [("m", "x", "zho_Hans", "Overall", 0.2), ("m", "x", "zho_Hant", "Overall", 0.6), ("n", "x", "zho_Hans", "Overall", 0.3)]
    long = spark.createDataFrame(rows, "model string, model_type string, language string, category string, score double")
    found = {(r.model, r.language): r.score for r in leaderboard.merge_scripts(long).collect()}
    assert found == {("m", "zho"): pytest.approx(0.4), ("n", "zho"): 0.3}


def test_exclusion_keeps_null(spark):
    frame = spark.createDataFrame([("Class-0",), ("Class-1",), (None,)], "c string")
    assert {r.c for r in shape.exclude_value(frame, "c", "Class-0").collect()} == {"Class-1", None}


def test_imported_results(spark):
    scores = {s: 0.5 for s, _, _ in fixed.SUBSETS if s != "math-prm"}
    rows = [("o/a", "Generative RM", None, None, scores), ("o/b", "DPO", None, "o/ref", scores)]
    frame = spark.createDataFrame(rows, "model string, model_type string, chat_template string, ref_model string, scores map<string,double>")
    a, b = results.convert_imported(frame, "set").orderBy("model").collect()
    assert (a.dataset, a.num_prompts, a.extra_results, a.file_name) == ("set", None, None, "a-eng_Latn.json")
    assert a.leaderboard["Reasoning"] == pytest.approx(0.5)
    assert (b.dataset, b.num_prompts, b.ref_model, b.leaderboard, b.accuracy) == (None, 2985, "o/ref", None, None)


# rewards


def test_reward_ties_and_nan_lose(spark):
    rows = [(2.0, 1.0), (1.0, 1.0), (0.0, 1.0), (float("nan"), 1.0), (1.0, float("nan")), (None, 1.0)]
    frame = spark.createDataFrame(rows, "chosen double, rejected double")
    assert [r[0] for r in frame.select(rewards.win()).collect()] == [1, 0, 0, 0, 0, 0]


def test_reward_histogram_equals_numpy(spark):
    rng = np.random.default_rng(3)
    chosen, rejected = rng.normal(size=500).round(3), np.full(500, 2.0)
    frame = spark.createDataFrame(pd.DataFrame({"chosen": chosen, "rejected": rejected}))
    rows = rewards.reward_histogram(frame).collect()
    for side, values in (("chosen", chosen), ("rejected", rejected)):
        found = np.zeros(30, dtype=int)
        for r in rows:
            if r.side == side:
                found[r.bin] = r.n
        assert found.tolist() == np.histogram(values, bins=30)[0].tolist()


def test_reward_scoring(spark):
    scored = rewards.score_pairs(shape.dialogues(pair_frame(spark)), rewards.length_scorer).collect()
    assert all(r.chosen_score == len(r.chosen) and r.result == int(len(r.chosen) > len(r.rejected)) for r in scored)


# agreement


def brute_kappa(pairs):
    n = len(pairs)
    observed = sum(a == b for a, b in pairs) / n
    chance = sum(sum(a == k for a, _ in pairs) * sum(b == k for _, b in pairs) for k in (0, 1, 2)) / n**2
    return None if chance == 1 else (observed - chance) / (1 - chance)


def test_kappa_against_brute_force(spark):
    rng = np.random.default_rng(1)
    labels = {(m, c, i): int(rng.integers(0, 3)) for m in range(5) for c in CODES for i in range(30) if rng.random() > 0.1}
    rows = [(f"m{m}", c, i, v) for (m, c, i), v in labels.items()]
    # a third of all rows are copies of one cell
    copies = [r for r in rows if r[0] == "m0" and r[2] == 7] * 40
    frame = spark.createDataFrame(rows + copies, "model string, language string, instance_id long, label int")
    for grouped, key in (
        (agreement.instance_kappa(frame, CODES), lambda m, c, i: (i, c)),
        (agreement.model_kappa(frame, CODES), lambda m, c, i: (f"m{m}", c)),
    ):
        groups = {}
        for (m, c, i), v in labels.items():
            if c != "eng_Latn" and (m, "eng_Latn", i) in labels:
                groups.setdefault(key(m, c, i), []).append((v, labels[(m, "eng_Latn", i)]))
        wanted = {k: brute_kappa(v) for k, v in groups.items()}
        found = {tuple(r[:2]): r.kappa for r in grouped.collect()}
        assert found == {k: pytest.approx(v) for k, v in wanted.items() if v is not None}


def test_kappa_of_equal_labels_is_one_or_undefined(spark):
    rows = [(f"m{m}", c, i, (m * i) % 3) for m in range(4) for c in CODES for i in range(6)]
    frame = spark.createDataFrame(rows, "model string, language string, instance_id long, label int")
    found = agreement.instance_kappa(frame, CODES).collect()
    assert {r.kappa for r in found} == {1.0}
    assert {r.instance_id for r in found} == {1, 2, 4, 5}


# sampling


def md5_order(seed, *keys):
    return hashlib.md5(":".join(str(k) for k in (seed, *keys)).encode()).hexdigest()


def scored_rows(n=600):
    return [(i, CODES[i % 2], [1.0, 1.0, 1.0, 0.0, 0.5, None][i % 6], "x") for i in range(n)]


@pytest.mark.parametrize("rounds", [(3, 6, 9), (1, 2)])
@pytest.mark.parametrize("n", [3, 250, 10_000])
def test_stratified_sample_against_brute_force(spark, monkeypatch, n, rounds):
    monkeypatch.setattr(sampling, "ROUNDS", rounds)
    rows = scored_rows()
    frame = spark.createDataFrame(rows, "id long, language string, scores double, prompt string")
    wanted = set()
    for language in CODES[:2]:
        strata = {}
        for i, code, score, _ in rows:
            if code == language and score is not None:
                strata.setdefault(score, []).append(i)
        cap = min(n // len(strata), min(len(v) for v in strata.values()))
        for ids in strata.values():
            wanted |= set(sorted(ids, key=lambda i: md5_order("sample", 42, language, i))[:cap])
    found = [r.id for r in sampling.stratified_sample(frame, n).collect()]
    assert sorted(found) == sorted(wanted)


@pytest.mark.parametrize("size", [1, 50, 5_000])
def test_random_subset_against_brute_force(spark, size):
    frame = spark.createDataFrame(scored_rows(), "id long, language string, scores double, prompt string")
    for groups in (("language",), ()):
        wanted = []
        for ids in ([[i for i in range(600) if i % 2 == k] for k in (0, 1)] if groups else [list(range(600))]):
            wanted += sorted(ids, key=lambda i: md5_order("sample", 42, CODES[i % 2], i))[:size]
        found = sampling.random_subset(frame, size, groups=groups)
        assert found.columns == frame.columns
        assert sorted(r.id for r in found.collect()) == sorted(wanted)


@pytest.mark.parametrize("n", [1, 7, 5_000])
def test_first_rows_by_group(spark, n):
    rows = [(i * i, CODES[0] if i % 3 else CODES[1]) for i in range(900)] + [(4, CODES[0])] * 5
    frame = spark.createDataFrame(rows, "position long, language string").repartition(7)
    wanted = [p for code in CODES[:2] for p in sorted(p for p, c in rows if c == code)[:n]]
    assert sorted(r.position for r in shape.first_rows(frame, n, groups=("language",)).collect()) == sorted(wanted)


@pytest.mark.parametrize("far", [10**15, -(10**15)])
def test_first_rows_with_one_far_position(spark, monkeypatch, far):
    rows = [(i, "a") for i in range(-40, 3000)] + [(far, "a"), (None, "a"), (5, "b"), (None, "b")]
    frame = spark.createDataFrame(rows, "position long, g string").repartition(5)
    left = []

    def kept(df, name="stage"):
        out = materialise(df, name)
        if name == "first":
            left.append(out.count())
        return out

    materialise = sampling.materialise
    monkeypatch.setattr(sampling, "materialise", kept)
    for n in (1, 100, 2990, 3041):
        wanted = sorted(p for p, g in rows if g == "a" and p is not None)[:n]
        found = shape.first_rows(frame, n, groups=("g",)).where("g = 'a' and position is not null").collect()
        assert sorted(r.position for r in found) == wanted
    # what a round passes on is a bucket, not the group; at last equal numbers only
    assert max(left) <= 300 and sorted(left)[0] == 0


@pytest.mark.parametrize("n", [3, 50, 400])
def test_first_rows_by_numbers_with_fractions(spark, n):
    values = [(-1) ** i * (i % 37) / 64 * 10 ** (i % 5) for i in range(500)] + [None, 0.5, 0.5]
    frame = spark.createDataFrame([(v, "a") for v in values], "position double, g string")
    found = [r.position for r in shape.first_rows(frame, n, groups=("g",)).collect()]
    assert sorted(found) == sorted(v for v in values if v is not None)[:n]


def test_places_without_a_window_over_all(spark):
    rows = [(i % 3, i * 7 % 101, i) for i in range(101)]
    frame = spark.createDataFrame(rows, "g int, v int, i int").repartition(6)
    found = ranking.places(frame, ["g"], "v")
    assert "Window" not in found._jdf.queryExecution().optimizedPlan().toString()
    for g in range(3):
        wanted = [v for k, v, _ in sorted(rows, key=lambda r: r[1]) if k == g]
        assert [r.v for r in found.where(f"g = {g}").orderBy("place").collect()] == wanted
        assert [r.place for r in found.where(f"g = {g}").orderBy("place").collect()] == list(range(len(wanted)))
    ordered = ranking.numbered(frame.orderBy(F.desc("v"))).orderBy("place").collect()
    assert [(r.place, r.v) for r in ordered] == list(enumerate(sorted((v for _, v, _ in rows), reverse=True), 1))


SENTENCES = [
    ("Dr. Who is here. He left at 3.5 km. \"Really?\" Yes! (It was.) So\u2026  ok", ["Dr. Who is here.", "He left at 3.5 km.", '"Really?"', "Yes!", "(It was.)", "So\u2026", "ok"]),
    ("\u4eca\u65e5\u306f\u6674\u308c\u3002\u672c\u5f53\uff1f\u300c\u306f\u3044\u3002\u300d\u305d\u3046\u3002", ["\u4eca\u65e5\u306f\u6674\u308c\u3002", "\u672c\u5f53\uff1f", "\u300c\u306f\u3044\u3002\u300d", "\u305d\u3046\u3002"]),
    ("\u092e\u0948\u0902 \u0939\u0942\u0901\u0964 \u0906\u092a?", ["\u092e\u0948\u0902 \u0939\u0942\u0901\u0964", "\u0906\u092a?"]),
    ("\u0645\u0631\u062d\u0628\u0627\u061f \u0628\u062e\u064a\u0631\u06d4 \u0646\u0639\u0645", ["\u0645\u0631\u062d\u0628\u0627\u061f", "\u0628\u062e\u064a\u0631\u06d4", "\u0646\u0639\u0645"]),
    ("Am 3. Mai 2020. Dann z.B. das.  J. Smith", ["Am 3. Mai 2020.", "Dann z.B. das.", "J. Smith"]),
    ("a.\nb!\tc? ", ["a.", "b!", "c?", ""]),
    ("", [""]),
]


def test_sentences_of_many_languages(spark):
    frame = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(SENTENCES)], "i int, t string")
    found = {r.i: list(r.s) for r in frame.select("i", text.sentences(F.col("t")).alias("s")).collect()}
    assert found == {i: s for i, (_, s) in enumerate(SENTENCES)}
    connection = duckdb.connect()
    for i, (t, sentences) in enumerate(SENTENCES):
        assert connection.execute(f"select {views.sql_sentences(views.quote(t))}").fetchall() == [(sentences,)]


def test_contradictory_labels_fail(spark):
    rows = [("m", "eng_Latn", 1, 0), ("m", "eng_Latn", 1, 2), ("m", "deu_Latn", 1, 2)]
    frame = spark.createDataFrame(rows, "model string, language string, instance_id long, label int")
    with pytest.raises(Exception, match="different labels in eng_Latn"):
        agreement.label_pairs(frame, CODES).collect()


def test_scores_that_are_no_numbers_fail(spark):
    frame = spark.createDataFrame([({"a": "0.5", "model": "m", "b": None},)], "s map<string,string>")
    assert frame.select(results.numeric_entries(F.col("s"))).first()[0] == {"a": 0.5}
    with pytest.raises(Exception, match="no number: x"):
        frame.select(results.numeric_entries(F.create_map(F.lit("a"), F.lit("x")))).collect()


def test_uses_of_one_seed_are_independent(spark):
    frame = spark.range(20_000).select(F.lit("x").alias("language"), "id")
    both = frame.select(hashing.coin("swap", 0, "id").alias("a"), hashing.coin("shuffle", 0, "id").alias("b"))
    assert 0.23 < both.where("a and b").count() / 20_000 < 0.27


def test_sample_sizes_hold_when_a_third_of_all_rows_share_an_id(spark):
    rows = [(0, "eng_Latn", 1.0, "x")] * 400 + [(i, "eng_Latn", [1.0, 0.0][i % 2], "x") for i in range(1, 801)]
    frame = spark.createDataFrame(rows, "id long, language string, scores double, prompt string")
    counts = frame.groupBy("scores").count().collect()
    assert {r["count"] for r in counts} == {800, 400}
    for n, each in ((10, 5), (500, 250), (5_000, 400)):
        sampled = sampling.stratified_sample(frame, n).groupBy("scores").count().collect()
        assert {(r.scores, r["count"]) for r in sampled} == {(0.0, each), (1.0, each)}


# annotation


def annotated(spark):
    pairs = pair_frame(spark).withColumn("scores", F.element_at(F.array(F.lit(1.0), F.lit(0.0), F.lit(0.5)), (F.col("id") % 3 + 1).cast("int")))
    pairs = pairs.withColumns({"chosen_model": F.lit("m"), "rejected_model": F.lit("n")})
    return annotate.answer_key(pairs, seed=1)


def test_annotators_see_nothing_that_tells_the_origin(spark):
    key = annotated(spark)
    task = annotate.annotation_task(key)
    assert set(task.columns) == {"id", "language", "prompt", "completion_a", "completion_b"}
    shown = {r.id: r for r in task.collect()}
    rows = key.collect()
    assert {r.swapped for r in rows} == {0, 1}
    for r in rows:
        sides = (shown[r.id].completion_a, shown[r.id].completion_b)
        assert sides == ((r.completion_b, r.completion_a) if r.swapped else (r.completion_a, r.completion_b))


def test_task_without_model_scores(spark):
    key = annotate.answer_key(pair_frame(spark))
    assert "scores" not in annotate.annotation_task(key).columns


def test_unswap_undoes_the_swap(spark):
    rows = [(p, s) for p in ("A", "B", None) for s in (0, 1)]
    frame = spark.createDataFrame(rows, "p string, s int")
    once = annotate.unswap(F.col("p"), F.col("s"))
    twice = annotate.unswap(once, F.col("s"))
    assert all(r[0] == r[1] for r in frame.select("p", twice).collect())


def test_missing_human_answers_count_as_wrong_unless_dropped(spark):
    key = annotated(spark)
    says = F.when(F.col("id") % 4 != 0, "A").alias("human_preference")
    answers = key.select("language", "id", says, F.lit("").alias("notes"))
    other = answers.select(F.lit("xxx_Latn").alias("language"), "id", F.lit("B").alias("human_preference"), "notes")
    answers = answers.union(other)
    data = annotate.join_annotations(key, answers).toPandas()
    for drop in (False, True):
        joined = annotate.join_annotations(key, answers, drop_missing=drop)
        df = data.dropna(subset=["human_preference"]) if drop else data
        found = annotate.human_agreement(joined).first()
        sub = df[df.scores != 0.5]
        assert found.n == len(df) and found.n_decided == len(sub)
        assert found.human_vs_gold == pytest.approx((df.human_preference == "A").mean())
        assert found.human_vs_gold_decided == pytest.approx((sub.human_preference == "A").mean())
        assert found.human_vs_model_decided == pytest.approx((sub.human_preference == sub.model_preference).mean())
        against = annotate.disagreements(joined).groupBy("against").count().collect()
        assert {r["against"]: r["count"] for r in against} == {
            "gold": int((df.human_preference != "A").sum()),
            "model": int((sub.human_preference != sub.model_preference).sum()),
        }


# translation


def test_missing_columns_are_named(spark):
    with pytest.raises(ValueError, match="answer"):
        translate.translate_columns(pair_frame(spark), ["prompt", "answer"], translate.dictionary_translator, "deu_Latn")


def test_code_rows_keep_their_answers(spark):
    shout = lambda texts, language: [f"{language}:{t}" for t in texts]
    pairs = pair_frame(spark)
    out = translate.translate_columns(pairs, ["prompt", "chosen"], shout, "fra_Latn", batch_size=2)
    before = {r.id: r for r in pairs.collect()}
    for r in out.collect():
        b = before[r.id]
        assert r.prompt == "fra_Latn:" + b.prompt
        assert r.chosen == (b.chosen if b.subset.startswith("hep-") else "fra_Latn:" + b.chosen)
        assert (r.rejected, r.target_language) == (b.rejected, "fra_Latn")


def test_segments_and_batches(spark):
    sizes = []

    def keep(texts, language):
        assert len(texts) <= 4
        return [t.upper() + "\n" for t in texts]

    rows = [(1, "one\n\ntwo. Three!  Four\n"), (2, None), (3, "")]
    pairs = spark.createDataFrame(rows, "id long, prompt string")
    by_line = translate.translate_columns(pairs, ["prompt"], keep, "x", "lines", batch_size=4).orderBy("id")
    assert [r.prompt for r in by_line.collect()] == ["ONE\n\nTWO. THREE!  FOUR\n", None, ""]
    plain = lambda texts, language: [t.upper() for t in texts]
    by_sentence = translate.translate_columns(pairs, ["prompt"], plain, "x", "sentences").orderBy("id")
    assert [r.prompt for r in by_sentence.collect()] == ["ONE\n\nTWO. THREE! FOUR\n", None, ""]
    assert sizes == []


def test_a_function_that_loses_texts_fails(spark):
    with pytest.raises(Exception, match="one text per text"):
        translate.translate_columns(pair_frame(spark), ["prompt"], lambda t, _: t[:-1], "x").collect()


def test_resumed_job_adds_nothing_twice(spark, tmp_path):
    pairs = pair_frame(spark)
    path = str(tmp_path / "out")
    arguments = (path, ["prompt", "chosen", "rejected"], translate.dictionary_translator)
    translate.run_translation(pairs.where("id < 10"), *arguments, "deu_Latn", parts=3, tasks=2)
    translate.run_translation(pairs, *arguments, "deu_Latn", parts=3)
    translate.run_translation(pairs, *arguments, "deu_Latn")
    translate.run_translation(pairs, *arguments, "fra_Latn", parts=2)
    written = spark.read.json(path)
    assert written.count() == 80
    assert written.select("id", "target_language").distinct().count() == 80
    assert written.select("subset").distinct().count() == 23


def test_a_job_that_broke_off_behind_its_output_adds_nothing_twice(spark, tmp_path, monkeypatch):
    pairs, path = pair_frame(spark), str(tmp_path / "out")
    arguments = (pairs, path, ["prompt"], translate.dictionary_translator, "deu_Latn")
    with monkeypatch.context() as m:
        m.setattr(batches.Batches, "close", lambda self, batch: 1 / 0)
        with pytest.raises(ZeroDivisionError):
            translate.run_translation(*arguments, parts=3)
    assert 0 < spark.read.json(path).count() < 40  # files of an open batch
    assert translate.read_translation(spark, path, "id long").count() == 0
    translate.run_translation(*arguments, parts=3)
    written = translate.read_translation(spark, path, "id long, target_language string, prompt string")
    assert written.count() == written.select("id").distinct().count() == 40


def test_what_is_done_is_not_looked_up_in_the_output(spark, tmp_path):
    pairs, path = pair_frame(spark), str(tmp_path / "out")
    translate.run_translation(pairs, path, ["prompt"], translate.dictionary_translator, "deu_Latn", parts=2)
    plan = translate.Output(spark, path).done()._jdf.queryExecution().optimizedPlan().toString()
    assert "json" not in plan and plan.count("Relation") == 1
    assert set(translate.Output(spark, path).done().inputFiles()).isdisjoint(spark.read.json(path).inputFiles())


def test_parts_are_read_from_their_own_folders(spark, tmp_path, monkeypatch):
    plans = []

    def kept(rows, *others, **options):
        plans.append(rows._jdf.queryExecution().optimizedPlan().toString())
        return translate_columns(rows, *others, **options)

    translate_columns = translate.translate_columns
    monkeypatch.setattr(translate, "translate_columns", kept)
    pairs = pair_frame(spark)
    translate.run_translation(pairs, str(tmp_path / "out"), ["prompt"], translate.dictionary_translator, "x", parts=4)
    assert len(plans) == 4 and all("Join" not in p and p.count("Relation") == 1 for p in plans)


def test_random_part_of_the_pairs(spark, tmp_path):
    pairs = pair_frame(spark)
    path = str(tmp_path / "out")
    for _ in range(2):
        translate.run_translation(pairs, path, ["prompt"], translate.dictionary_translator, "deu_Latn", size=7)
    wanted = sorted(range(40), key=lambda i: md5_order("sample", 42, i))[:7]
    assert sorted(r.id for r in spark.read.json(path).collect()) == sorted(wanted)


def test_bilingual_job_is_turn_based_and_normalised(spark):
    rows = [(1, "s", "deu_Latn", "ｆｕｌｌ ①\nthe", "ﬁne", "and")]
    pairs = spark.createDataFrame(rows, "id long, source string, language string, en_input string, en_chosen string, en_rejected string")
    r = translate.translate_bilingual(pairs, translate.dictionary_translator, "fra_Latn").first()
    assert (r.language, r.prompt) == ("fra_Latn", "<full 1>\n<der>")
    assert [tuple(m) for m in r.chosen] == [("user", "<full 1>\n<der>"), ("assistant", "<fine>")]
    assert [tuple(m) for m in r.rejected] == [("user", "<full 1>\n<der>"), ("assistant", "<und>")]


def test_nfkc(spark, folder):
    texts = spark.read.parquet(f"{folder}/documents.parquet").select("text")
    extra = spark.createDataFrame([("Å ﬁ ①",), ("plain",), (None,)], "text string")
    rows = texts.unionByName(extra).select("text", text.normalize_nfkc(F.col("text")).alias("n")).collect()
    assert all(r.n == (None if r.text is None else unicodedata.normalize("NFKC", r.text)) for r in rows)


def test_fixed_weights():
    sums = {c: sum(w for _, k, w in fixed.SUBSETS if k == c) for c in fixed.CATEGORIES}
    assert sums == {"Chat": 296, "Chat Hard": 407, "Safety": 736, "Reasoning": 1966}
    assert len(fixed.SUBSETS) == 23 and len(fixed.SUBSET_TITLES) == 30
    assert len(fixed.LANGUAGE_NAMES) == 24 and len(fixed.LANGUAGE_LABELS) == 22
    assert math.isclose(sum(sums.values()), 3405)


def test_a_batch_is_translated_in_portions():
    # 30 MB of lines, which as Python texts of a whole batch took more than as much again
    rows = [[f"{i} " * 150, "x" * 1_000, ""] if i % 10 else None for i in range(20_000)]
    cells, kept = pa.array(rows, pa.list_(pa.string())), []

    def upper(texts, language):
        kept.append((len(texts), tracemalloc.get_traced_memory()[0]))
        return [t.upper() for t in texts]

    run = translate._translated_segments(upper, "x", 32, False).func
    tracemalloc.start()
    try:
        found = run(cells)
    finally:
        tracemalloc.stop()
    assert found.to_pylist() == [r and [t.upper() for t in r] for r in rows]
    assert max(n for n, _ in kept) == 32 and sum(n for n, _ in kept) == 3 * 18_000
    assert max(size for _, size in kept) < 12 << 20
    assert run(pa.array([], pa.list_(pa.string()))).to_pylist() == []
    assert run(pa.array([None, []], pa.list_(pa.string()))).to_pylist() == [None, []]


def test_a_batch_is_scored_in_portions():
    dialogues = [[{"role": "user", "content": "q"}, {"role": "assistant", "content": "x" * (i % 4_000)}] for i in range(10_000)]
    kind = pa.list_(pa.struct([("role", pa.string()), ("content", pa.string())]))
    column, kept = pa.array(dialogues, kind), []

    def scorer(batch):
        kept.append((len(batch), tracemalloc.get_traced_memory()[0]))
        scores = rewards.length_scorer(batch)
        return [None if s == 7 else math.nan if s == 8 else s for s in scores]

    score = rewards._scoring(scorer).func
    tracemalloc.start()
    try:
        found = score(column).to_pylist()
    finally:
        tracemalloc.stop()
    assert found == [None if i % 4_000 in (7, 8) else float(i % 4_000) for i in range(10_000)]
    assert sum(n for n, _ in kept) == 10_000 and max(size for _, size in kept) < 8 << 20
    assert len(score(column.slice(0, 0))) == 0
    with pytest.raises(ValueError, match="one number per dialogue"):
        rewards._scoring(lambda batch: [1.0]).func(column)
