"""Readers and writers on files in the layouts that evaluations leave behind."""

import json

import pytest
from pyspark.sql import functions as F

from prefboard import schemas
from prefboard.functions import fixed
from prefboard.operators import results
from prefboard.session import fresh_path, materialise, shared_folder
from prefboard.sources import readers, writers

ACCURACY = {s: (i % 5) / 4 for i, (s, _, _) in enumerate(fixed.SUBSETS)}


def weighted(category):
    rows = [(ACCURACY[s], w) for s, c, w in fixed.SUBSETS if c == category]
    return sum(a * w for a, w in rows) / sum(w for _, w in rows)


BOARD = {c: weighted(c) for c in fixed.CATEGORIES}


@pytest.fixture()
def imported(tmp_path):
    """Indented documents, one file per model, in one folder per language."""
    for language in ("deu_Latn", "eng_Latn"):
        folder = tmp_path / "results" / language
        folder.mkdir(parents=True)
        generative = {
            "dataset": "set",
            "model": "openai/judge",
            "chat_template": None,
            "scores": {"accuracy": 0.5, "num_correct": 1.5, "num_total": 3, "results": [1, 0, 0.5]},
            "leaderboard": BOARD,
            "subset": {"model": "openai/judge", "model_type": "Generative RM", "chat_template": None, **ACCURACY},
        }
        (folder / f"openai___judge-{language}.json").write_text(json.dumps(generative, indent=4))
        for name, ref in (("dpo", "org/base"), ("seq", None), ("seq2", "")):
            document = {
                "accuracy": 0.25,
                "num_prompts": 23,
                "model": f"org/{name}",
                "ref_model": ref,
                "tokenizer": "t",
                "chat_template": "raw",
                "extra_results": ACCURACY,
                "subset_results": ACCURACY,
            }
            (folder / f"org___{name}-{language}.json").write_text(json.dumps(document))
    return str(tmp_path / "results")


def test_documents_of_all_kinds(spark, imported):
    documents = readers.read_result_documents(spark, imported, multi_line=True)
    classified = results.classify_documents(documents)
    kinds = {(r.language, r.model): r.model_type for r in classified.collect()}
    assert kinds == {
        (language, model): kind
        for language in ("deu_Latn", "eng_Latn")
        for model, kind in (
            ("openai/judge", "Generative RM"),
            ("org/dpo", "DPO"),
            ("org/seq", "Sequence Classifier"),
            ("org/seq2", "Sequence Classifier"),
        )
    }
    assert all(r.subset_scores == ACCURACY for r in classified.collect())
    for r in results.document_scores(classified).collect():
        wanted = sum(BOARD.values()) / 4 if r.category == "Overall" else BOARD[r.category]
        assert r.score == pytest.approx(wanted)
    flat = {r.model: r.accuracy for r in results.flat_documents(documents).collect()}
    assert flat == {"openai/judge": 0.5, "org/dpo": 0.25, "org/seq": 0.25, "org/seq2": 0.25}


def test_inline_results_become_rows(spark, imported):
    documents = readers.read_result_documents(spark, imported, multi_line=True)
    rows = results.instance_rows(documents.where(F.col("language") == "deu_Latn")).orderBy("position").collect()
    assert [(r.model, r.position, r.result) for r in rows] == [
        ("openai/judge", 0, 1.0),
        ("openai/judge", 1, 0.0),
        ("openai/judge", 2, 0.5),
    ]


def test_missing_subset_in_a_document(spark):
    partial = {s: a for s, a in ACCURACY.items() if s != "hep-go"}
    rows = [("deu_Latn", json.dumps({"model": "o/m", "extra_results": partial}))]
    classified = results.classify_documents(readers.parse_documents(spark.createDataFrame(rows, "language string, document string")))
    strict = {r.category: r.score for r in results.document_scores(classified).collect()}
    lenient = {r.category: r.score for r in results.document_scores(classified, strict=False).collect()}
    assert strict["Reasoning"] is None and strict["Overall"] is None
    kept = [(partial[s], w) for s, c, w in fixed.SUBSETS if c == "Reasoning" and s in partial]
    assert lenient["Reasoning"] == pytest.approx(sum(a * w for a, w in kept) / sum(w for _, w in kept))
    assert strict["Chat"] == lenient["Chat"] == pytest.approx(BOARD["Chat"])


def test_stored_categories_are_averaged_as_they_are(spark):
    document = {"subset": {"model": "o/m", "model_type": "Generative RM"}, "leaderboard": {"Chat": 0.5, "Safety": 0.9}}
    frame = spark.createDataFrame([("deu_Latn", json.dumps(document))], "language string, document string")
    rows = results.document_scores(results.classify_documents(readers.parse_documents(frame))).collect()
    scores = {r.category: r.score for r in rows}
    assert scores == {"Overall": pytest.approx(0.7), "Chat": 0.5, "Chat Hard": None, "Safety": 0.9, "Reasoning": None}


def _files_opened(df):
    """Rows, and the files that the scan behind them opens."""
    rows = df.collect()
    scan = df._jdf.queryExecution().executedPlan().collectLeaves().head()
    files = scan.metrics().get("numFiles")
    assert files.isDefined() or not rows  # no scan is left where nothing can be found
    return rows, files.get().value() if files.isDefined() else 0


def test_files_of_other_models_are_not_opened(spark, imported, tmp_path):
    read = lambda path=imported, **options: _files_opened(readers.read_result_documents(spark, path, **options))
    rows, files = read(models=["org/seq"])
    assert {(r.model, r.language) for r in rows} == {("org/seq", "deu_Latn"), ("org/seq", "eng_Latn")} and files == 2
    rows, files = read(models=["org/seq", "org/dpo"], languages=["deu_Latn"])
    assert sorted(r.model for r in rows) == ["org/dpo", "org/seq"] and files == 2
    rows, files = read(languages=["eng_Latn"])
    assert {r.language for r in rows} == {"eng_Latn"} and files == len(rows) == 4
    assert read(models=["none/such"]) == ([], 0) and read(models=[]) == ([], 0)
    rows, files = read()
    assert len(rows) == files == 8
    frame = spark.createDataFrame(
        [(m, "DPO", k, s, 1.0) for m in ("o/a", "o/a-1", "o/a b") for k in ("deu_Latn", "fra_Latn") for s in ACCURACY],
        "model string, model_type string, language string, subset string, result double",
    )
    path = str(tmp_path / "documents")
    writers.write_result_documents(results.result_documents(frame, "set", ref_model=F.lit("r")), path)
    rows, files = read(path, models=["o/a"])
    assert [r.model for r in rows] == ["o/a"] * 2 and files == 2
    assert [r.model for r in read(path, models=["o/a b"], languages=["fra_Latn"])[0]] == ["o/a b"]


def test_written_documents_have_the_published_fields(spark, tmp_path):
    rows = [
        (m, k, "deu_Latn", s, v)
        for m, k in (("o/g", "Generative RM"), ("o/d", "DPO"), ("o/c", "Sequence Classifier"))
        for s in ACCURACY
        for v in (1.0, 0.5)
    ]
    frame = spark.createDataFrame(rows, "model string, model_type string, language string, subset string, result double")
    path = str(tmp_path / "documents")
    reference = F.when(F.col("model_type") == "DPO", F.concat("model", F.lit("-ref")))
    writers.write_result_documents(results.result_documents(frame, "set", ref_model=reference), path)
    files = [f for f in (tmp_path / "documents" / "language=deu_Latn").rglob("part-*") if f.is_file()]
    found = {f.parent.name: json.loads(f.read_text()) for f in files}
    assert set(found) == {"model_key=o___g", "model_key=o___d", "model_key=o___c"}
    generative = found["model_key=o___g"]
    assert generative["scores"] == {"accuracy": 0.75, "num_correct": 34.5, "num_total": 46}
    assert set(generative["leaderboard"]) == set(fixed.CATEGORIES)
    assert generative["subset"] == {"model": "o/g", "model_type": "Generative RM", **{s: 0.75 for s in ACCURACY}}
    assert found["model_key=o___d"]["ref_model"] == "o/d-ref"
    assert "ref_model" not in found["model_key=o___c"] and "subset" not in found["model_key=o___c"]
    assert found["model_key=o___c"]["extra_results"] == {s: 0.75 for s in ACCURACY}
    without = results.result_documents(frame, "set", core_dataset=False).where("model = 'o/c'").first()
    assert without.extra_results is None and len(without.subset_results) == 23


def test_csv_keeps_awkward_texts(spark, tmp_path):
    rows = [(1, " a\nb ", None, ""), (2, 'say "x", y', "A", "\\n"), (3, "é\r\nz\t", "B", "#")]
    frame = spark.createDataFrame(rows, "id long, notes string, human_preference string, more string")
    path = str(tmp_path / "csv")
    writers.write_csv_table(frame, path)
    found = [tuple(r) for r in readers.read_csv_table(spark, path, frame.schema, line_breaks=True).orderBy("id").collect()]
    assert found == [(1, " a\nb ", None, None), *rows[1:]]


def test_label_matrix(spark, tmp_path):
    path = tmp_path / "labels.csv"
    path.write_text("model,10,11\nm1,0,2\nm2,1,\n")
    rows = readers.read_label_matrix(spark, str(path), "deu_Latn").collect()
    assert sorted((r.model, r.language, r.instance_id, r.label) for r in rows if r.label is not None) == [
        ("m1", "deu_Latn", "10", 0),
        ("m1", "deu_Latn", "11", 2),
        ("m2", "deu_Latn", "10", 1),
    ]
    assert len(rows) == 4


def test_wide_label_matrix(spark, tmp_path):
    path = tmp_path / "labels.csv"
    n = 3000
    path.write_text("model," + ",".join(map(str, range(n))) + "\n" + "".join(f"m{k}," + ",".join(str((i + k) % 3) for i in range(n)) + "\n" for k in range(3)))
    rows = readers.read_label_matrix(spark, str(path), "deu_Latn").collect()
    assert {(r.model, r.instance_id): r.label for r in rows} == {(f"m{k}", str(i)): (i + k) % 3 for k in range(3) for i in range(n)}


def test_pairs_of_one_language_and_split(spark, tmp_path):
    rows = [(i, i, c, s, "x", "p", "c", "r", "m", "n") for i, (c, s) in enumerate([("deu_Latn", "filtered"), ("deu_Latn", "raw"), ("fra_Latn", "filtered")])]
    path = str(tmp_path / "pairs")
    spark.createDataFrame(rows, schemas.PAIR).write.partitionBy("language", "split").parquet(path)
    assert [r.id for r in readers.read_pairs(spark, path, "deu_Latn").collect()] == [0]
    assert [r.id for r in readers.read_pairs(spark, path, "deu_Latn", "raw").collect()] == [1]
    assert readers.read_pairs(spark, path, split=None).count() == 3
    plan = readers.read_pairs(spark, path, "deu_Latn")._jdf.queryExecution().executedPlan().toString()
    # both conditions prune folders; no row filter is left
    assert "PartitionFilters: [is" in plan and "Filter (" not in plan


def test_json_keeps_null_columns(spark, tmp_path):
    path = str(tmp_path / "json")
    writers.write_json(spark.createDataFrame([(1, None)], "id long, notes string"), path)
    assert spark.read.json(path).columns == ["id", "notes"]


def test_materialised_frames_come_from_files(spark):
    frame = materialise(spark.range(10).withColumn("x", F.rand()))
    assert frame.collect() == frame.collect()
    folder = shared_folder(spark).removeprefix("file:")
    assert frame.inputFiles() and all(folder in f for f in frame.inputFiles())
    assert fresh_path(spark, "a") != fresh_path(spark, "a")
