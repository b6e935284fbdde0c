"""Runs from pairs to leaderboards and human reports."""

import json

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from prefboard import runs, schemas
from prefboard.functions import fixed
from prefboard.operators import judging, leaderboard, results, rewards
from prefboard.sources import readers

CODES = ["eng_Latn", "deu_Latn", "fra_Latn"]


@pytest.fixture(scope="module")
def pairs(spark):
    rows = [
        (n * 1000 + i, i, code, fixed.SUBSETS[i % 23][0], f"q{i}", "c" * (i * (n + 2) % 9 + 1), "r" * (i % 7 + 1), "m", "n")
        for n, code in enumerate(CODES)
        for i in range(92)
    ]
    names = "id long, position long, language string, subset string, prompt string, chosen string, rejected string, chosen_model string, rejected_model string"
    return spark.createDataFrame(rows, names)


@pytest.fixture(scope="module")
def folder(spark, pairs, tmp_path_factory):
    folder = str(tmp_path_factory.mktemp("runs") / "eval")
    runs.run_judges(pairs, {"gpt-4": judging.length_judge()}, folder, "set", name_languages=True)
    ensemble = {n: judging.length_judge(m) for n, m in (("a", 0), ("b", 1), ("c", 2))}
    runs.run_judges(pairs, ensemble, folder, "set", tasks=3)
    runs.run_scorer(pairs, rewards.length_scorer, "org/dpo", folder, "set", ref_model="org/base", chat_template="raw")
    runs.run_scorer(pairs, rewards.length_scorer, "org/seq", folder, "set", tasks=2)
    return folder


def test_stored_documents_give_the_same_leaderboard_as_the_instances(spark, folder):
    instances = spark.read.json(folder + "/instances")
    assert instances.count() == 4 * 3 * 92
    direct = leaderboard.board(results.all_scores(results.subset_accuracy(instances)), CODES)
    stored = runs.leaderboard_tables(spark, folder + "/documents", CODES)

    def rows(frame):
        return {(r.category, r.model): r for r in frame.collect()}

    found, wanted = rows(stored["boards"]), rows(direct)
    assert set(found) == set(wanted) and len(found) == 5 * 4
    for key, row in found.items():
        assert row.model_type == wanted[key].model_type
        for column in ("eng_Latn", "avg_multilingual", "std"):
            assert row[column] == pytest.approx(wanted[key][column])
    assert {m for _, m in found} == {"openai/gpt-4", "PoLL/a_b_c", "org/dpo", "org/seq"}
    kinds = {m: row.model_type for (_, m), row in found.items()}
    assert kinds == {
        "openai/gpt-4": "Generative RM",
        "PoLL/a_b_c": "Generative RM PoLL",
        "org/dpo": "DPO",
        "org/seq": "Sequence Classifier",
    }
    overall = [r.model for r in stored["overall"].collect()]
    assert overall[0] == "org/seq" and overall[-1] == "org/dpo"
    assert stored["english_drop"].count() == 4


def test_judge_and_scorer_agree_but_for_ties(spark, folder):
    instances = spark.read.json(folder + "/instances")
    wide = instances.groupBy("id").pivot("model", ["openai/gpt-4", "org/seq"]).agg(F.first("result")).collect()
    assert all(r["org/seq"] == (1.0 if r["openai/gpt-4"] == 1.0 else 0.0) for r in wide)


def test_prompts_name_the_languages(spark, pairs, tmp_path):
    def judge(systems, users):
        for system, user in zip(systems, users):
            assert "question provided is in French. " in system and "responses are in Tamil. " in system
        return ["[[A]]"] * len(users)

    french = pairs.where("language = 'fra_Latn'")
    runs.run_judges(french, {"org/m": judge}, str(tmp_path / "r"), "set", name_languages=True, answer_language="Tamil")


def test_complete_models_only(spark, folder):
    tables = runs.leaderboard_tables(spark, folder + "/documents", CODES)
    assert tables["complete"].columns == ["model_type", "model", "avg_multilingual", "deu_Latn", "fra_Latn", "eng_Latn"]
    assert tables["complete"].count() == 4
    assert runs.leaderboard_tables(spark, folder + "/documents", [*CODES, "pol_Latn"])["complete"].count() == 0


def test_flat_table(spark, tmp_path):
    for i in range(12):
        subsets = {"maple-code": i / 20, "other-maple-x": 0.5}
        document = {"model": f"o/m{i}", "accuracy": i / 12, "extra_results": None, "subset_results": subsets}
        (tmp_path / f"m{i}.json").write_text(json.dumps(document, indent=2))
    rows = runs.flat_table(spark, str(tmp_path), "maple-").collect()
    found = {(r.model, r.subset): (r.accuracy, r.score) for r in rows}
    wanted = {
        (f"o/m{i}", s): (pytest.approx(i / 12 * 100), pytest.approx(v * 100))
        for i in range(2, 12)
        for s, v in (("code", i / 20), ("other-maple-x", 0.5))
    }
    assert found == wanted


def test_sampled_run(spark, pairs, tmp_path):
    rows = runs.run_judges(pairs, {"org/m": judging.length_judge()}, str(tmp_path / "r"), "set", sample=10)
    assert rows.groupBy("language").count().collect() and rows.count() == 30
    assert rows.agg(F.max("position")).first()[0] == 9


def test_a_repeated_run_replaces_its_files(spark, pairs, tmp_path):
    folder = str(tmp_path / "r")
    other = pairs.where("language <> 'eng_Latn'")
    runs.run_judges(pairs, {"org/m": judging.length_judge()}, folder, "set")
    runs.run_judges(pairs, {"org/n": judging.length_judge()}, folder, "set")
    runs.run_judges(other, {"org/m": lambda s, u: ["[[C]]"] * len(u)}, folder, "set")
    instances = spark.read.json(folder + "/instances")
    assert instances.count() == 2 * 3 * 92
    changed = instances.where("model = 'org/m' and language <> 'eng_Latn'")
    assert {r.result for r in changed.select("result").distinct().collect()} == {0.5}
    scores = runs.score_table(spark, folder + "/documents").where("category = 'Overall'").collect()
    assert len(scores) == 6
    assert all((r.score == 0.5) == (r.model == "org/m" and r.language != "eng_Latn") for r in scores)


def test_pairs_without_a_result_fail_unless_allowed(spark, pairs):
    instances = pairs.where("position <> 3").select("language", "position", F.lit(1.0).alias("result"))
    with pytest.raises(Exception, match="no result for position 3"):
        results.attach_results(pairs, instances).collect()
    assert results.attach_results(pairs, instances, strict=False).count() == 3 * 91


def test_annotation_round(spark, pairs, folder, tmp_path):
    instances = spark.read.json(folder + "/instances").where("model = 'openai/gpt-4'")
    out = str(tmp_path / "task")
    key = runs.annotation_files(pairs, out, instances.select("language", "position", "result"), sample_size=12)
    per_stratum = key.groupBy("language", "scores").count().collect()
    assert {r["count"] for r in per_stratum} == {4} and len(per_stratum) == 9
    stored = readers.read_csv_table(
        spark, out + "/answer_key", "position long, id long, subset string, prompt string, completion_a string, completion_b string, chosen_model string, rejected_model string, scores double, swapped int, language string", line_breaks=True
    )
    assert stored.count() == 36
    task = spark.read.option("header", True).csv(out + "/annotation")
    assert not {"scores", "swapped", "subset", "chosen_model"} & set(task.columns)
    # a human who always picks the chosen answer, seen through the swap
    answers = stored.select(
        "language", "id", F.when(F.col("swapped") == 1, "B").otherwise("A").alias("human_preference"), F.lit("").alias("notes")
    )
    report = runs.human_report(stored, answers)
    agreement = report["agreement"].first()
    assert agreement.human_vs_gold == 1.0 and agreement.human_vs_model_decided == 0.5
    assert report["disagreements"].count() == 12


def test_a_sample_is_swapped_by_an_independent_coin(spark, tmp_path):
    rows = [(i, i, "eng_Latn", "alpacaeval-easy", "q", "a", "b", "m", "n") for i in range(3000)]
    columns = "id long, position long, language string, subset string, prompt string, chosen string, rejected string, chosen_model string, rejected_model string"
    frame = spark.createDataFrame(rows, columns)
    scored = frame.select("language", "position", (F.col("id") % 2).cast("double").alias("result"))
    key = runs.annotation_files(frame, str(tmp_path / "task"), scored, sample_size=300)
    assert key.count() == 300 and 120 <= key.where("swapped = 1").count() <= 180


def test_leaderboard_without_one_language(spark, folder):
    tables = runs.leaderboard_tables(spark, folder + "/documents", CODES + ["spa_Latn"])
    assert all(r.avg is None and r.std is None for r in tables["overall"].collect())


ALL = list(fixed.LANGUAGE_NAMES)


def published(n=14):
    """A wide leaderboard in the layout of the published file."""
    rng = np.random.default_rng(5)
    data = pd.DataFrame(rng.uniform(0.3, 0.9, (n, len(ALL))), columns=ALL)
    names = list(fixed.MODEL_TITLES) + [f"org/m{i}" for i in range(n)]
    data.insert(0, "model", names[:n])
    data.insert(1, "model_type", "DPO")
    data["avg"] = data[ALL].drop(columns="eng_Latn").mean(axis=1)
    return data


def test_main_table_against_pandas(spark):
    data = published()
    best = data.sort_values("avg", ascending=False).head(10)
    wanted = best[[*ALL, "avg"]].drop(columns="eng_Latn") * 100
    wanted["zho"] = wanted[["zho_Hans", "zho_Hant"]].mean(axis=1)
    wanted = wanted.drop(columns=["zho_Hans", "zho_Hant"]).rename(columns=lambda c: c.split("_")[0])
    wanted["variance"] = wanted[list(fixed.LANGUAGE_LABELS)].var(axis=1)
    wanted = wanted.rename(columns=fixed.LANGUAGE_LABELS)
    found = runs.main_table(spark.createDataFrame(data), ALL).toPandas()
    assert found["model"].tolist() == [fixed.MODEL_TITLES.get(m, m) for m in best["model"]]
    assert set(found.columns) == {"model", *wanted.columns} and len(wanted.columns) == 24
    assert np.allclose(found[wanted.columns].to_numpy(), wanted.to_numpy())


def test_linguistic_table_against_pandas(spark):
    data = published()
    metadata = pd.DataFrame(
        [(c, f"Class-{i % 6}", f"f{i % 4}" if i else None, f"s{i % 3}") for i, c in enumerate(ALL) if c != "pol_Latn"],
        columns=["language", "resource_type", "family", "script"],
    )
    first = data.sort_values("model").head(6)
    scores = first[[c for c in ALL if c != "eng_Latn"]].T
    combined = metadata.set_index("language").join(
        pd.DataFrame({"avg": scores.mean(axis=1) * 100, "std": scores.std(axis=1) * 100}), how="inner"
    )
    combined = combined[combined["resource_type"] != "Class-0"]
    wanted = {
        (dim, value): tuple(row)
        for dim in ("resource_type", "family", "script")
        for value, row in combined.groupby(dim)[["avg", "std"]].mean().iterrows()
    }
    table = runs.linguistic_table(spark.createDataFrame(data), spark.createDataFrame(metadata), ALL, n=6).collect()
    assert {(r.dimension, r.value): (pytest.approx(r.avg), pytest.approx(r["std"])) for r in table} == wanted
    classes = [r.value for r in table if r.dimension == "resource_type"]
    assert classes == sorted(classes, reverse=True)


def test_schemas_parse(spark):
    for text in (schemas.PAIR, schemas.TRANSLATED_PAIR, schemas.DOCUMENT, schemas.leaderboard(CODES)):
        assert spark.createDataFrame([], text).columns
