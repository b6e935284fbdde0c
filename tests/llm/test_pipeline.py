"""The stages against plain versions, each on its own input."""

import zlib

import pytest
from tokenizers import Tokenizer

import corpus_pipeline
from prefboard.llm import quality
from tests.llm import test_decontaminate, test_near_duplicates, test_packing, test_secret_scan


@pytest.fixture(scope="module")
def stages(spark, folder, tmp_path_factory):
    top = tmp_path_factory.mktemp("stages")
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    out = [docs]
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, out[-1], folder).write.parquet(f"{top}/{name}")
        out.append(spark.read.parquet(f"{top}/{name}"))
    return out


def rows_of(df):
    return sorted(map(tuple, df.collect()))


def test_all_but_the_last_return_the_columns_of_documents(stages):
    assert all(df.dtypes == stages[0].dtypes for df in stages[:-1])
    assert [name for name, _ in corpus_pipeline.STAGES] == ["quality", "near_duplicates", "decontamination", "secrets", "packing"]


@pytest.mark.parametrize("name, stage", corpus_pipeline.STAGES)
def test_batches_are_small_in_any_session(spark, folder, name, stage, monkeypatch):
    rows = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(rows)
    spark.conf.set(rows, "10000")
    try:
        stage(spark, spark.read.parquet(f"{folder}/documents.parquet").limit(5), folder)
        assert spark.conf.get(rows) == "1000"
    finally:
        spark.conf.set(rows, before)


def test_quality_stage(spark, folder, stages):
    labels = spark.read.parquet(f"{folder}/labels.parquet")
    scores = quality.quality_scores(stages[0], labels).where("predicted = 1").select("doc_id")
    assert rows_of(stages[1]) == rows_of(stages[0].join(scores, "doc_id", "left_semi"))
    good = {r["doc_id"] for r in labels.where("quality = 1").collect()} & {r["doc_id"] for r in stages[0].collect()}
    assert len(good & {r["doc_id"] for r in stages[1].collect()}) > 0.95 * len(good)


def test_near_duplicate_stage(stages):
    rows = stages[1].collect()
    _, roots = test_near_duplicates.plainly(rows)
    assert rows_of(stages[2]) == sorted(tuple(r) for r in rows if roots[r["doc_id"]] == r["doc_id"])
    assert stages[2].count() < len(rows)


def test_decontamination_stage(spark, folder, stages):
    words = lambda t: [w for w in test_decontaminate.decontaminate.alnum_words((t or "").encode())]
    items = [(r["item_id"], words(r["text"])) for r in spark.read.parquet(f"{folder}/benchmark.parquet").collect()]
    seen = {tuple(w[k : k + 13]) for _, w in items for k in range(max(1, len(w) - 12))}
    kept = []
    for r in stages[2].collect():
        own = words(r["text"])
        hit = {p for k in range(len(own) - 12) if tuple(own[k : k + 13]) in seen for p in range(k, k + 13)}
        if not (hit and 20 * len(hit) >= len(own)):
            left = [w for p, w in enumerate(own) if p not in hit]
            kept.append((r, left, hit))
    after = {r["doc_id"]: r for r in stages[3].collect()}
    assert len(after) == len(kept) == stages[3].count() < stages[2].count()
    for r, left, hit in kept:
        if hit:
            assert words(after[r["doc_id"]]["text"]) == left and after[r["doc_id"]]["n_chars"] == len(after[r["doc_id"]]["text"])
        else:
            assert after[r["doc_id"]] == r
    assert all(len(w) >= 13 for _, w in items if w)


def test_secret_stage(stages):
    before = {r["doc_id"]: r for r in stages[3].collect()}
    after = {r["doc_id"]: r for r in stages[4].collect()}
    assert set(before) == set(after)
    for i, r in after.items():
        spans, text, parts, at = test_secret_scan.plainly(before[i]["text"] or ""), before[i]["text"], [], 0
        for _, start, end in spans:
            if start >= at:
                parts += [text[at:start], "<secret>"]
            at = max(at, end)
        assert r["text"] == ("".join(parts) + text[at:] if spans else text)
        assert r["n_chars"] == (len(r["text"]) if spans else before[i]["n_chars"])


def test_packing_stage(spark, folder, stages):
    tokenizer = Tokenizer.from_file(test_packing.PATH)
    texts = stages[4].collect()
    ids = [e.ids for e in tokenizer.encode_batch([r["text"] or "" for r in texts], add_special_tokens=False)]
    expected = [p for r, i in zip(texts, ids) for p in test_packing.pieces_of(r["doc_id"], i, 2048)]
    test_packing.check(stages[5].collect(), expected, 2048)
    assert zlib.crc32(str(sorted(expected)).encode()) == zlib.crc32(
        str(sorted((str(r["doc_id"]), *r[1:5]) for r in corpus_pipeline.run(spark, folder).collect())).encode()
    )


def test_stages_on_odd_rows(spark, folder, odd, none, clashing):
    """Nulls, blank and long texts, repeated rows, no rows, clashing names."""
    for docs in (odd, none, clashing):
        for name, stage in corpus_pipeline.STAGES:
            out = stage(spark, docs, folder)
            if name == "packing":
                assert (out.count() > 0) == (docs.count() > 0)
                continue
            assert out.columns == docs.columns
            kept = {r["doc_id"] for r in out.collect()}
            if docs is none:
                assert not kept
            elif name == "near_duplicates":
                assert kept == {1, 2, 3, 4, 5, 8, 9, 10, 11, None}
            elif name in ("decontamination", "secrets"):
                assert kept == {r["doc_id"] for r in docs.collect()}
