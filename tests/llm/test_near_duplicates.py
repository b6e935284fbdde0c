import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from prefboard import session
from prefboard.llm import components, metric_join, minhash
from tests.llm.conftest import COPY


def shingles(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", (text or "").encode().lower().decode())
    if len(words) < 5:
        return frozenset([tuple(words)] if words else [])
    return frozenset(tuple(words[i : i + 5]) for i in range(len(words) - 4))


def roots(nodes, links):
    parent = {n: n for n in nodes}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


def plainly(rows):
    sets = {r["doc_id"]: shingles(r["text"]) for r in rows if r["doc_id"] is not None}
    links = [
        (a, b)
        for a, x in sets.items()
        for b, y in sets.items()
        if a < b and x and y and 100 * len(x & y) >= 75 * len(x | y)
    ]
    return sets, roots(sets, links)


@pytest.mark.parametrize("links", [[], [(1, 1)], [(i, i + 1) for i in range(40)], [(9, 1), (9, 2), (5, 2), (7, 8), (8, 7), (None, 3)]])
def test_components(spark, links):
    df = spark.createDataFrame(links, "u long, v long")
    got = {r["node"]: r["root"] for r in components.components(df).collect()}
    known = [(a, b) for a, b in links if a is not None and a != b]
    wanted = roots({n for link in known for n in link}, known)
    assert got == {n: r for n, r in wanted.items() if n != r}


def test_odd_rows(odd, none, clashing):
    rows = minhash.near_duplicates(odd).collect()
    sets, wanted = plainly(odd.collect())
    assert len(rows) == odd.count()
    for r in rows:
        if r["doc_id"] is None:
            assert (r["component_id"], r["kept"], r["n_shingles"]) == (None, False, len(shingles(COPY)))
        else:
            assert (r["n_shingles"], r["component_id"]) == (len(sets[r["doc_id"]]), wanted[r["doc_id"]])
            assert r["kept"] == (r["doc_id"] == r["component_id"])
    assert minhash.near_duplicates(none).count() == 0
    assert sorted(map(str, minhash.near_duplicates(clashing).collect())) == sorted(map(str, rows))
    assert {r["doc_id"] for r in minhash.drop_near_duplicates(odd).collect()} == {1, 2, 3, 4, 5, 8, 9, 10, 11, None}


def test_groups_whose_members_differ(spark):
    """Chains and dense groups at the threshold: nobody may be lost between leaders."""
    random.seed(4)
    rows = []
    for group in range(6):
        words = [f"g{group}w{i}" for i in range(60)]
        for k in range(25):
            copy = list(words)
            for at in random.sample(range(60), random.choice([0, 1, 2, 3])):
                copy[at] = f"new{group}.{k}.{at}"
            rows.append((len(rows), " ".join(copy)))
            if k % 5 == 0:
                words = copy
    df = spark.createDataFrame(rows, "doc_id long, text string")
    _, wanted = plainly(df.collect())
    for rounds in (1, 2):
        got = {r["doc_id"]: r["component_id"] for r in minhash.near_duplicates(df, star_rounds=rounds).collect()}
        assert got == wanted
    assert 6 < len(set(wanted.values())) < 150


def test_small_tables_go_to_few_files(spark, monkeypatch):
    """Not to a file for each of many shuffle partitions; all links are kept."""
    random.seed(6)
    rows = []
    for group in range(40):
        words = [f"g{group}w{i}" for i in range(60)]
        rows += [(len(rows) + k, " ".join([*words, f"own{group}.{k}"])) for k in range(10)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    _, wanted = plainly(rows := df.collect())
    written, fresh = [], session.fresh_path
    monkeypatch.setattr(session, "fresh_path", lambda s, name: written.append((name, path := fresh(s, name))) or path)
    held = {"spark.sql.shuffle.partitions": "60", "spark.sql.adaptive.coalescePartitions.enabled": "false", "spark.sql.autoBroadcastJoinThreshold": "-1"}
    before = {key: spark.conf.get(key) for key in held}
    for key, value in held.items():
        spark.conf.set(key, value)
    try:
        got = {r["doc_id"]: r["component_id"] for r in minhash.near_duplicates(df).collect()}
        links = spark.createDataFrame([(i, i + 1) for i in range(500)], "u long, v long").repartition(50)
        ends = {(r["node"], r["root"]) for r in components.components(links).collect()}
    finally:
        for key, value in before.items():
            spark.conf.set(key, value)
    assert got == wanted and ends == {(i, 0) for i in range(1, 501)}
    files = {name: spark.read.parquet(path).select(F.input_file_name()).distinct().count() for name, path in written}
    few = set(files) - {"candidate-texts", "confirmed", "links-across", "links"}
    assert {"classes", "bands", "buckets", "signatures", "large-star", "small-star"} <= few
    assert max(files[name] for name in few) <= spark.sparkContext.defaultParallelism


def test_signatures_estimate_similarity():
    a = minhash.shingle_set(" ".join(f"w{i}" for i in range(400)).encode())
    b = minhash.shingle_set(" ".join(f"w{i}" for i in range(40, 440)).encode())
    same = (np.frombuffer(minhash.signature(a), "<u4") == np.frombuffer(minhash.signature(b), "<u4")).mean()
    assert abs(same - len(np.intersect1d(a, b)) / len(np.union1d(a, b))) < 0.12
    assert minhash.similar(a, a) and not minhash.similar(a, b[: len(b) // 2])


# embeddings


def vector_rows():
    random.seed(2)
    make = np.random.default_rng(5)
    rows, number = [], 0
    for label in (0, 1, None):
        for _ in range(6):
            middle = make.normal(size=8)
            for _ in range(8):
                rows.append((number, (middle + make.normal(size=8) * 0.15).tolist(), label))
                number += 1
    rows += [(number + i, rows[3][1], 0) for i in range(5)]
    odd = [None, [], [0.0] * 8, [float("nan")] * 8, [float("inf")] + [0.0] * 7, [None] + [1.0] * 7, rows[3][1][:7]]
    rows += [(200 + i, v, 0) for i, v in enumerate(odd)]
    rows += [(300, [2 * x for x in rows[3][1]], 0), (300, [2 * x for x in rows[3][1]], 0), (None, rows[3][1], 0)]
    return rows


def vectors_plainly(rows, cosine):
    usable = [
        (i, np.array(v, float), label)
        for i, v, label in rows
        if i is not None and label is not None and v and None not in v and np.isfinite(v).all() and any(v)
    ]
    counts, links = {i: 0 for i, _, _ in rows}, []
    for x, (i, a, la) in enumerate(usable):
        for y, (j, b, lb) in enumerate(usable):
            if x != y and la == lb and len(a) == len(b) and a @ b / (np.sqrt(a @ a) * np.sqrt(b @ b)) >= cosine:
                counts[i] += 1
                links.append((i, j))
    repeated = {i for i, _, _ in usable if sum(k == i for k, _, _ in usable) > 1}
    for i in repeated:
        counts[i] //= sum(k == i for k, _, _ in usable)
    return counts, roots([i for i in counts if i is not None], [(a, b) for a, b in links if a != b])


@pytest.mark.parametrize("cosine, cell, block", [(0.93, 4096, 2048), (0.93, 10, 6), (0.8, 7, 3)])
def test_vectors(spark, cosine, cell, block):
    rows = vector_rows()
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    got = metric_join.near_vectors(df, cosine=cosine, cell=cell, block=block).collect()
    counts, wanted = vectors_plainly(rows, cosine)
    assert len(got) == len(rows)
    for r in got:
        if r["vec_id"] is None:
            assert (r["n_links"], r["component_id"], r["kept"]) == (0, None, False)
        else:
            i = r["vec_id"]
            assert (i, r["n_links"], r["component_id"]) == (i, counts[i], wanted[i])
            assert r["kept"] == (wanted[i] == i)


def test_one_row_per_vector_of_an_id(spark):
    a, b, c = [1.0, 0.0], [0.0, 1.0], [0.0, -1.0]
    rows = [(5, a, 0, "x"), (5, b, 0, "x"), (5, b, 0, "x"), (3, a, 0, "y"), (7, b, 0, "y"), (8, c, 0, "y"), (8, None, 0, "y")]
    df = spark.createDataFrame(rows, "vec_id int, embedding array<float>, label int, row string")
    for named in (df, df.withColumns({n: F.lit("z") for n in ("id", "v", "n", "name", "least", "class_root", "component_id", "n_links")})):
        got = metric_join.near_vectors(named)
        assert sorted(tuple(r) for r in got.collect()) == [
            (3, 1, 3, True), (5, 1, 3, False), (5, 2, 5, True), (5, 2, 5, True), (7, 2, 5, False), (8, 0, 8, True), (8, 0, 8, True),
        ]


def test_no_vectors(spark):
    df = spark.createDataFrame([], "vec_id long, embedding array<float>, label int, id int, v int")
    assert metric_join.near_vectors(df).count() == 0
