"""Result lists of any length inside stored documents."""

import json
import random

import pytest
from pyspark.sql import functions as F

from prefboard.sources import documents
from prefboard.sources.blocks import pieces


@pytest.fixture
def ranges(spark):
    names = ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")
    before = {n: spark.conf.get(n) for n in names}

    def set_to(size):
        spark.conf.set(names[0], str(size))
        spark.conf.set(names[1], "1")

    yield set_to
    for name, value in before.items():
        spark.conf.set(name, value)


def document(draw, model, n, **more):
    results = [draw.choice([1, 0, 0.5, 1.0, None, 1e-3]) for _ in range(n)]
    strange = {"chat_template": 'a, "results": [7, 8], {"scores": {"results": [9]}} \\', "extra_results": {"results": [3, 4]}, "results": [5, 6]}
    scores = {"accuracy": 0.5, "lists": [[1, 2], []], "results": results, "num_total": n}
    return {**strange, "model": model, "scores": scores, **more, "last": "x,1,2"}, results


@pytest.mark.parametrize("size", [60, 1 << 27])
@pytest.mark.parametrize("indent", [None, 2])
def test_lists_in_ranges(spark, tmp_path, ranges, size, indent):
    draw, wanted = random.Random(7), set()
    for code, lengths in (("deu_Latn", [0, 1, 2, 70]), ("language=fra_Latn", [5])):
        folder = tmp_path / code
        folder.mkdir()
        for n in lengths:
            made, results = document(draw, f"org/m{n}", n)
            (folder / f"{n}.json").write_text(json.dumps(made, indent=indent))
            wanted |= {(code.removeprefix("language="), f"org/m{n}", i, r) for i, r in enumerate(results)}
    ranges(size)
    found = documents.read_instance_lists(spark, str(tmp_path))
    assert [c for c in found.columns] == ["language", "model", "position", "result"]
    rows = [tuple(r) for r in found.collect()]
    assert len(rows) == len(set(rows)) and set(rows) == wanted
    assert (pieces(spark, str(tmp_path), ",", recursiveFileLookup=True).rdd.getNumPartitions() > 20) == (size == 60)


def test_several_documents_in_a_file(spark, tmp_path):
    draw, wanted, lines = random.Random(2), set(), []
    for part in range(3):
        made, results = document(draw, "m", 4, position_offset=part * 4)
        lines.append(json.dumps(made))
        wanted |= {("here", "m", part * 4 + i, r) for i, r in enumerate(results)}
    lines.insert(1, json.dumps({"model": "without", "scores": {"accuracy": 1}}))
    (tmp_path / "here").mkdir()
    (tmp_path / "here" / "a.json").write_text("\n".join(lines) + "\n")
    assert {tuple(r) for r in documents.read_instance_lists(spark, str(tmp_path)).collect()} == wanted


def test_round_trip_in_parts(spark, tmp_path):
    rows = [(code, model, i, float(i % 3) / 2 if i % 7 else None) for code in ("deu_Latn", "fra_Latn") for model in ("a/b", "c") for i in range(55)]
    frame = spark.createDataFrame(rows, "language string, model string, position long, result double")
    documents.write_instance_lists(frame, str(tmp_path / "d"), elements=10)
    texts = spark.read.text(str(tmp_path / "d")).collect()
    assert len(texts) == 2 * 2 * 6 and max(len(json.loads(t.value)["scores"]["results"]) for t in texts) == 10
    found = documents.read_instance_lists(spark, str(tmp_path / "d")).collect()
    assert sorted(map(str, found)) == sorted(map(str, frame.collect()))


def test_lists_stay_in_their_tasks(spark, tmp_path):
    (tmp_path / "x").mkdir()
    (tmp_path / "x" / "a.json").write_text(json.dumps({"model": "m", "scores": {"results": list(range(500))}}))
    found = documents.read_instance_lists(spark, str(tmp_path))
    assert {(r.position, r.result) for r in found.collect()} == {(i, float(i)) for i in range(500)}
    others = pieces(spark, str(tmp_path), ",", recursiveFileLookup=True).where(~F.col("value").rlike(documents._PLAIN))
    assert others.count() <= 3
