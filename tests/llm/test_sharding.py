import zlib

import pytest

from prefboard.llm import queries, sharding
from tests.llm.conftest import COPY


def check(rows, shards):
    by = {}
    for r in rows:
        by.setdefault(r["shard"], []).append(r["slot"])
    assert set(by) <= set(range(shards))
    assert all(sorted(slots) == list(range(len(slots))) for slots in by.values())


def test_query_on_whole_table(spark, folder):
    texts = {r["doc_id"]: (r["text"] or "").encode() for r in spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text").collect()}
    rows = queries.QUERIES["op8_histogram_sort"](spark, folder).collect()
    check(rows, 40)
    assert len(rows) == len(texts)
    for r in rows:
        data = texts[r["doc_id"]]
        assert (r["size"], r["text_crc32"], r["law"], r["grown_shard"]) == (len(data) + 16, zlib.crc32(data), "bytes", None)
    total, largest = sum(r["size"] for r in rows), max(r["size"] for r in rows)
    sums = [sum(r["size"] for r in rows if r["shard"] == k) for k in range(40)]
    assert all(abs(s - total / 40) <= largest + 0.002 * total / 40 for s in sums)


@pytest.mark.parametrize("tolerance", [0.0, 0.001, 0.3])
def test_splitters_meet_the_tolerance(spark, tolerance):
    rows = [(i, "same text" if i % 3 else f"text {i % 50} " * (i % 7)) for i in range(3000)]
    keys = sharding.with_keys(spark.createDataFrame(rows, "doc_id long, text string")).cache()
    ordered = sorted((r["sort_key"], r["size"]) for r in keys.collect())
    total, largest = sum(s for _, s in ordered), max(s for _, s in ordered)
    for number, splitter in enumerate(sharding.find_splitters(keys, 10, tolerance), 1):
        below = sum(s for k, s in ordered if k < splitter)
        assert abs(below - total * number / 10) <= max(tolerance * total / 10, largest)


def test_odd_rows(odd, none, clashing):
    for df in (odd, clashing):
        rows = sharding.shard_documents(df, 4).collect()
        check(rows, 4)
        assert len(rows) == df.count()
        assert {r["size"] for r in rows if r["doc_id"] in (1, 2)} == {16}
        copies = sorted(r["sort_key"] for r in rows if r["doc_id"] in (5, 6, None))
        assert {k[:8] for k in copies} == {f"{zlib.crc32(COPY.encode()):08x}"}
    assert sharding.shard_documents(none, 4).count() == 0
    assert {r["shard"] for r in sharding.shard_documents(odd, 1).collect()} == {0}


def test_only_native_nodes(spark, folder):
    plan = queries.QUERIES["op8_histogram_sort"](spark, folder)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan
