"""Physical plans: what must not appear in them, and what must."""

import re

import pytest

from prefboard.plans import catalog

QUERIES = catalog.QUERIES
# run_judges and resume_judging return what they have written
PYTHON = {"stored_instances", "judge_pairs", "score_pairs", "translate_columns", "translate_sentences", "translate_bilingual"}
WRITING = {n for n in QUERIES if n.startswith(("sink_", "scan_"))}


def plan_of(spark, folder, name):
    return QUERIES[name](spark, folder)._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", sorted(set(QUERIES) - WRITING))
def test_no_nested_loops_and_python_only_where_it_is_called_for(spark, folder, name):
    plan = plan_of(spark, folder, name)
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan
    assert ("EvalPython" in plan) == (name in PYTHON)


@pytest.mark.parametrize(
    "name", ["leaderboard_sorted", "english_drop", "category_delta_join", "ling_dims", "result_document", "order_columns"]
)
def test_boards_scan_the_ids_once(spark, folder, name):
    plan = plan_of(spark, folder, name)
    assert re.findall(r"ReadSchema: (\S+)", plan) == ["struct<doc_id:bigint>"]


def test_kappa_pairs_labels_without_a_join(spark, folder):
    plan = plan_of(spark, folder, "cohen_kappa")
    assert "SortMergeJoin" not in plan
    assert plan.count("Exchange hashpartitioning") == 2


@pytest.mark.parametrize("name", ["judge_pairs", "score_pairs", "translate_columns", "parse_verdict", "judge_prompt_lang"])
def test_row_wise_work_does_not_shuffle(spark, folder, name):
    assert "Exchange hashpartitioning" not in plan_of(spark, folder, name)


@pytest.mark.parametrize("name", ["route_code_subsets", "random_subset", "value_counts", "language_names"])
def test_texts_are_read_only_where_used(spark, folder, name):
    wanted = name == "random_subset"
    assert ("text:string" in plan_of(spark, folder, name)) == wanted


def test_values_are_placed_without_one_window(spark, folder):
    plan = plan_of(spark, folder, "value_counts")
    assert "Window" not in plan


@pytest.mark.parametrize("name", ["scan_csv", "scan_label_matrix", "stored_instances"])
def test_files_are_read_in_ranges(spark, folder, name):
    plan = QUERIES[name](spark, folder)._jdf.queryExecution().optimizedPlan().toString()
    formats = set(re.findall(r"Relation \[[^\]]*\] (\w+)", plan))
    assert "text" in formats and formats <= {"text", "parquet"}


@pytest.mark.parametrize("name", ["run_judges", "resume_judging", "translate_distinct"])
def test_results_of_calls_come_from_the_store(spark, folder, name):
    assert "EvalPython" not in plan_of(spark, folder, name)
