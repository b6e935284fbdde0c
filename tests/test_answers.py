"""Answers kept while a judging run goes on."""

import os
import tracemalloc
import uuid

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from prefboard import runs
from prefboard.operators import answers, judging, shape, translate
from prefboard.sources.batches import Batches

PAIRS = "id long, position long, language string, subset string, prompt string, chosen string, rejected string, chosen_model string, rejected_model string"


class CountingJudge:
    """The longer answer wins; every prompt asked leaves a file, and the run breaks at one of them."""

    def __init__(self, folder, breaks_at=None):
        self.folder, self.breaks_at = str(folder), breaks_at
        os.makedirs(self.folder, exist_ok=True)

    def __call__(self, systems, users):
        if self.breaks_at and any(self.breaks_at in u for u in users):
            raise RuntimeError("the service is down")
        for user in users:
            with open(f"{self.folder}/{uuid.uuid4().hex}", "w") as out:
                out.write(user)
        return judging.length_judge()(systems, users)

    def asked(self):
        return sorted(open(f"{self.folder}/{name}").read() for name in os.listdir(self.folder))


@pytest.fixture
def pairs(spark):
    rows = [(i, i, "eng_Latn", "alpacaeval-easy", f"question {i % 20}.", "c" * (i % 20 + 1), "r" * 7, "m", "n") for i in range(60)]
    return spark.createDataFrame(rows, PAIRS)


def results_of(df):
    return {(r["language"], r["id"]): (r["result"], r["winner"], r["votes"], r["status"]) for r in df.collect()}


def test_same_results_as_without_a_store(spark, pairs, tmp_path):
    judges = {name: judging.length_judge(margin) for name, margin in (("a", 0), ("b", 1), ("c", 9))}
    dialogues = shape.dialogues(pairs)
    store = answers.AnswerStore(spark, tmp_path / "answers")
    found = judging.judge_pairs_from(dialogues, judges, store, seed=3, parts=2, tasks=2)
    plain = judging.judge_pairs(dialogues, list(judges.values()), seed=3)
    assert results_of(found) == results_of(plain) and sorted(found.columns) == sorted(plain.columns)


def test_a_stopped_run_asks_only_what_is_missing(spark, pairs, tmp_path):
    dialogues = shape.dialogues(pairs)
    first, second = CountingJudge(tmp_path / "first", "question 7."), CountingJudge(tmp_path / "second")
    store = answers.AnswerStore(spark, tmp_path / "answers")
    with pytest.raises(Exception, match="the service is down"):
        judging.judge_pairs_from(dialogues, {"j": first}, store, parts=8)
    kept = store.known().count()
    assert 0 < kept < 40
    found = judging.judge_pairs_from(dialogues, {"j": second}, store, parts=3)
    wanted = judging.asked_pairs(dialogues).select("user_prompt").distinct().count()
    assert len(second.asked()) == len(set(second.asked())) == wanted - kept
    assert results_of(found) == results_of(judging.judge_pairs(dialogues, judging.length_judge()))
    judging.judge_pairs_from(dialogues, {"j": second}, store)
    assert len(second.asked()) == wanted - kept
    # another judge has answered nothing
    third = CountingJudge(tmp_path / "third")
    judging.judge_pairs_from(dialogues, {"k": third}, store)
    assert len(third.asked()) == wanted


def test_no_answer_is_asked_for_again(spark, pairs, tmp_path):
    store = answers.AnswerStore(spark, tmp_path / "answers")
    found = judging.judge_pairs_from(shape.dialogues(pairs), {"j": lambda s, u: [None] * len(u)}, store)
    assert {r[0] for r in results_of(found).values()} == {0.5}
    assert store.known().isEmpty()


def test_runs_resume_and_repeated_runs_ask_anew(spark, pairs, tmp_path):
    folder = str(tmp_path / "run")
    broken, counted = CountingJudge(tmp_path / "broken", "question 3."), CountingJudge(tmp_path / "counted")
    with pytest.raises(Exception, match="the service is down"):
        runs.run_judges(pairs, {"org/m": broken}, folder, "set", parts=6)
    rows = runs.run_judges(pairs, {"org/m": counted}, folder, "set", parts=2)
    n = len(counted.asked())
    prompts = judging.asked_pairs(shape.dialogues(pairs)).select("user_prompt").distinct().count()
    assert rows.count() == 60 and 0 < n < prompts
    runs.run_judges(pairs, {"org/m": counted}, folder, "set", parts=2)
    assert len(counted.asked()) == n + prompts
    # a folder of answers that runs share
    for name in ("one", "two"):
        runs.run_judges(pairs, {"org/m": counted}, str(tmp_path / name), "set", parts=2, answers=str(tmp_path / "shared"))
    assert len(counted.asked()) == n + 2 * prompts


def test_rows_without_a_prompt_are_not_asked(spark, pairs, tmp_path):
    missing = pairs.withColumn("chosen", F.when(F.col("id") > 2, F.col("chosen")))
    counted = CountingJudge(tmp_path / "c")
    found = judging.judge_pairs_from(shape.dialogues(missing), {"j": counted}, answers.AnswerStore(spark, tmp_path / "a"))
    assert {r.status for r in found.where("id <= 2").collect()} == {"no_prompt"}
    assert not any("None" in a for a in counted.asked())


def test_even_ensembles_are_refused(spark, pairs, tmp_path):
    with pytest.raises(ValueError, match="odd"):
        judging.judge_pairs_from(shape.dialogues(pairs), {"a": None, "b": None}, answers.AnswerStore(spark, tmp_path / "a"))


def test_equal_prompts_of_different_parts_have_different_keys(spark):
    rows = [("a", "bc"), ("ab", "c"), (None, "abc"), ("", "abc"), ("a", None)]
    keys = spark.createDataFrame(rows, "s string, u string").select(answers.prompt_key(F.col("s"), F.col("u"))).collect()
    assert len({k[0] for k in keys}) == 5 and keys[4][0] is None


def test_open_batches_are_no_part_of_a_table(spark, tmp_path):
    table = Batches(spark, tmp_path / "t")
    assert table.closed() == [] and table.read("n long").count() == 0
    frame = spark.range(5).withColumnRenamed("id", "n")
    name = table.write(frame)
    table.store(frame, "open")
    assert table.closed() == [name] and table.read("n long").count() == 5
    table.close("open")
    assert table.read("n long").count() == 10
    table.write(frame.where("n > 9"))
    assert table.read("n long").count() == 10 and table.read("n long", [name]).count() == 5


class CountingTranslator:
    def __init__(self, folder, breaks_at=None):
        self.judge = CountingJudge(folder)
        self.breaks_at = breaks_at

    def __call__(self, texts, language):
        if self.breaks_at in texts:
            raise RuntimeError("the service is down")
        self.judge([None] * len(texts), [f"[The Start of Assistant A's Answer]\n\n[The End of Assistant A's Answer][The Start of Assistant B's Answer]\n\n[The End of Assistant B's Answer]{t}" for t in texts])
        return [f"<{t}>" for t in texts]

    def asked(self):
        return [a.rsplit("]", 1)[1] for a in self.judge.asked()]


def test_equal_lines_are_translated_once(spark, tmp_path):
    rows = [(i, f"the same\nline {i % 7}\n", None if i == 3 else "the same", "hep-x" if i % 5 == 0 else "other") for i in range(50)]
    pairs = spark.createDataFrame(rows, "id long, prompt string, chosen string, subset string")
    plain = translate.translate_columns(pairs, ["prompt", "chosen"], lambda ts, _: [f"<{t}>" for t in ts], "x")
    store = answers.AnswerStore(spark, tmp_path / "segments")
    broken, counted = CountingTranslator(tmp_path / "b", "line 2"), CountingTranslator(tmp_path / "c")
    with pytest.raises(Exception, match="the service is down"):
        translate.translate_distinct(pairs, ["prompt", "chosen"], broken, "x", store, parts=6)
    kept = broken.asked()
    found = translate.translate_distinct(pairs, ["prompt", "chosen"], counted, "x", store, parts=2)
    assert sorted(map(str, found.collect())) == sorted(map(str, plain.collect()))
    distinct = {"the same", "", *(f"line {i}" for i in range(7))}
    asked = counted.asked()
    # what was in work when the job broke off is asked again, what was stored is not
    assert len(asked) == len(set(asked)) and set(asked) | set(kept) == distinct and 0 < len(asked) < len(distinct) + 1
    again = translate.translate_distinct(pairs, ["prompt", "chosen"], counted, "x", store)
    assert again.count() == 50 and len(counted.asked()) == len(asked)
    other = translate.translate_distinct(pairs, ["prompt"], counted, "y", store)
    assert other.count() == 50 and len(counted.asked()) == len(asked) + len(distinct)


def test_one_long_text_does_not_widen_the_others():
    # 10,000 short answers and a long one: as fixed-width texts they took 4 GB
    users = ["short"] * 9_999 + ["long " * 20_000]
    ask = answers._asking({"j": lambda systems, texts: [f"<{t}>" for t in texts]}).func
    tracemalloc.start()
    try:
        found = ask(*[pa.array(c, pa.string()) for c in (["j"] * len(users), [None] * len(users), users)])
        most = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert found.to_pylist() == [f"<{t}>" for t in users]
    assert most < 50 << 20


def test_answers_of_several_judges_and_portions_keep_their_places():
    names, users = ["a", "b", "a"] * 700, [f"{i} " * 1_500 for i in range(2_100)]
    sizes = []

    def judge(name):
        return lambda systems, texts: sizes.append(len(texts)) or [None if t.startswith("7 ") else name + t for t in texts]

    ask = answers._asking({n: judge(n) for n in "ab"}).func
    found = ask(pa.array(names), pa.nulls(len(users), pa.string()), pa.array(users))
    assert found.to_pylist() == [None if i == 7 else n + u for i, (n, u) in enumerate(zip(names, users))]
    assert sum(sizes) == len(users) and max(sizes) < 1_000
    with pytest.raises(ValueError):
        answers._asking({"a": lambda systems, texts: texts[1:]}).func(pa.array(["a"]), pa.nulls(1, pa.string()), pa.array(["x"]))
    assert len(ask(*[pa.array([], pa.string())] * 3)) == 0
