import random

import pytest
from pyspark.sql import functions as F

from prefboard.llm import decontaminate


def plainly(items, words, window):
    hit, found = set(), set()
    for item, own in items:
        size = min(window, len(own))
        windows = {tuple(own[k : k + size]) for k in range(len(own) - size + 1)} if own else set()
        for k in range(len(words) - size + 1):
            if tuple(words[k : k + size]) in windows:
                hit.update(range(k, k + size))
                found.add(item)
    return hit, found


@pytest.mark.parametrize("seed", range(200))
def test_automaton_equals_all_windows(seed):
    random.seed(seed)
    for _ in range(10):
        window, letters = random.choice([1, 2, 3, 4]), "abc"[: random.choice([1, 2, 3])]
        items = [(i % 5, random.choices(letters, k=random.randint(0, 9))) for i in range(random.randint(0, 6))]
        words = random.choices(letters + "x", k=random.randint(0, 40))
        spans, found = decontaminate.SuffixAutomaton(items, window).overlaps(words)
        assert ({k for a, b in spans for k in range(a, b)}, found) == plainly(items, words, window)
        assert all(a[1] < b[0] for a, b in zip(spans, spans[1:]))


@pytest.fixture(scope="module")
def benchmark(spark):
    random.seed(1)
    rows = [(i, " ".join(random.choices("abcdefgh", k=random.choice([3, 12, 13, 20])))) for i in range(8)]
    rows += [(8, ""), (9, None), (None, rows[0][1]), (10, "..."), (11, "One"), (3, rows[3][1])]
    return spark.createDataFrame(rows, "item_id long, text string")


@pytest.mark.parametrize("max_words", [10**6, 15])
def test_groups_of_items_give_the_same(spark, odd, benchmark, max_words):
    random.seed(3)
    items = [(r["item_id"], (r["text"] or "").lower().split()) for r in benchmark.collect() if r["text"] != "..."]
    parts = [" ".join(w) for _, w in items if w]
    rows = [(100 + i, " X ".join(random.choices(parts, k=3)) + " z" * (i % 9)) for i in range(20)]
    df = odd.select("doc_id", "text").union(spark.createDataFrame(rows, "doc_id long, text string"))
    got = decontaminate.find_overlaps(df, benchmark, max_words=max_words).collect()
    assert len(got) == df.count()
    for r in got:
        words = [w.decode() for w in decontaminate.alnum_words((r["text"] or "").encode())]
        hit, found = plainly(items, words, 13)
        overlap = r["overlap"]
        assert overlap["n_words"] == len(words) and set(overlap["items"]) == {str(i) for i in found if i is not None}
        assert {k for a, b in overlap["spans"] for k in range(a, b)} == hit


def test_nothing_to_compare(odd, none, clashing, benchmark):
    assert all(r["overlap"]["spans"] == [] for r in decontaminate.find_overlaps(clashing, benchmark.limit(0)).collect())
    assert decontaminate.find_overlaps(none, benchmark).count() == 0


def test_contaminated_rows_go(spark, benchmark):
    item = benchmark.where("length(text) > 30").first()["text"]
    rows = [(1, item), (2, item + " clean" * 1000), (3, "clean"), (4, None)]
    kept = decontaminate.drop_contaminated(spark.createDataFrame(rows, "doc_id long, text string"), benchmark)
    assert {r["doc_id"] for r in kept.collect()} == {2, 3, 4} and kept.columns == ["doc_id", "text"]


def test_spans_beyond_the_limits_are_cut(spark, odd, none, clashing):
    long, short = " ".join(f"q{i}" for i in range(40)), "short item"
    benchmark = spark.createDataFrame([(1, long), (2, short)], "item_id long, text string")
    clean = " ".join(f"c{i}" for i in range(2000))
    texts = {
        1: (f"é {long.upper()}, ü " + clean, "é , ü " + clean),
        2: (f"{clean}\n({short}) {clean}", f"{clean}\n({short}) {clean}"),
        3: (f"a (Short, Item) b {short}", "a () b "),
        4: (f"{clean} {' '.join(long.split()[5:20])}! and {short} ", f"{clean} ! and {short} "),
        5: (long, ""),
        6: ("", ""),
        7: (None, None),
        8: (f"{clean} {' '.join(long.split()[:12])}", f"{clean} {' '.join(long.split()[:12])}"),
    }
    rows = [(i, t, "en", "a", -1) for i, (t, _) in texts.items()]
    df = spark.createDataFrame(rows, odd.schema)
    got = {r["doc_id"]: r for r in decontaminate.remove_spans(df, benchmark).collect()}
    assert {i: r["text"] for i, r in got.items()} == {i: after for i, (_, after) in texts.items()}
    assert all(r["n_chars"] == (-1 if texts[i][0] == texts[i][1] else len(r["text"])) for i, r in got.items())
    patient = {r["doc_id"]: r["text"] for r in decontaminate.remove_spans(df, benchmark, longest=40).collect()}
    assert patient[1] == texts[1][0] and patient[5] == ""
    assert decontaminate.remove_spans(clashing, benchmark).columns == clashing.columns
    assert decontaminate.remove_spans(clashing, benchmark).select(*odd.columns).exceptAll(odd).count() == 0
    assert decontaminate.remove_spans(none, benchmark).count() == 0


def test_many_groups_go_in_passes(spark, odd, benchmark):
    """No task holds more automata than a worker keeps."""
    whole = decontaminate.find_overlaps(odd, benchmark)
    parts = decontaminate.find_overlaps(odd, benchmark, max_words=15)
    assert len(list(decontaminate.item_groups(benchmark, max_words=15))) > decontaminate.KEPT
    assert 0 < parts._jdf.queryExecution().optimizedPlan().toString().count("ArrowEvalPython") <= decontaminate.KEPT
    overlap = lambda df: sorted(map(str, df.select("doc_id", "overlap").collect()))
    assert overlap(whole) == overlap(parts)


def test_items_without_an_id_and_with_text_ids(spark, odd):
    rows = [(None, " ".join(f"copied{i}" for i in range(20))), ("ü-1", " ".join(f"copied{i}" for i in range(15, 40))), ("b", "Ünïcode ß")]
    benchmark = spark.createDataFrame(rows, "item_id string, text string")
    found = {r["doc_id"]: r["overlap"] for r in decontaminate.find_overlaps(odd.dropDuplicates(["doc_id"]), benchmark).collect()}
    assert found[5]["spans"] == [[0, 40]] and found[5]["items"] == ["ü-1"]
    assert found[8]["items"] == ["b"]
    alone = spark.createDataFrame(rows[:1], "item_id string, text string")
    kept = decontaminate.drop_contaminated(odd, alone)
    assert {5, 6, 7}.isdisjoint({r["doc_id"] for r in kept.collect()})


def test_documents_go_or_lose_their_spans(spark, odd, none, clashing):
    item = " ".join(f"q{i}" for i in range(40))
    benchmark = spark.createDataFrame([(1, item), (2, "short item")], "item_id long, text string")
    clean = " ".join(f"c{i}" for i in range(1000))
    texts = {
        1: (f"{clean} ({item}). {clean}", f"{clean} (). {clean}"),
        2: (f"{item} {clean[:100]}", None),
        3: (f"{clean} short item", f"{clean} short item"),
        4: (clean, clean),
        5: ("", ""),
    }
    df = spark.createDataFrame([(i, t, "en", "a", -1) for i, (t, _) in texts.items()], odd.schema).withColumn("overlap", F.lit(3))
    df = df.withColumn("_overlap", F.lit(4)).withColumn("cleaned", F.lit(5)).unionByName(df.limit(0), allowMissingColumns=True)
    got = {r["doc_id"]: r for r in decontaminate.decontaminate(df, benchmark).collect()}
    assert {i: r["text"] for i, r in got.items()} == {i: after for i, (_, after) in texts.items() if i != 2}
    assert all((r["overlap"], r["_overlap"], r["cleaned"]) == (3, 4, 5) for r in got.values())
    assert got[1]["n_chars"] == len(texts[1][1]) and got[3]["n_chars"] == -1
    assert decontaminate.decontaminate(clashing, benchmark).columns == clashing.columns
    assert decontaminate.decontaminate(odd, benchmark).exceptAll(odd).count() == 0
    assert decontaminate.decontaminate(none, benchmark).count() == 0


def test_cutting_crosses_to_python_once(spark):
    docs = spark.createDataFrame([(1, "a b", 3)], "doc_id long, text string, n_chars long")
    items = spark.createDataFrame([("x", "a b c")], "item_id string, text string")
    for made in (decontaminate.decontaminate(docs, items), decontaminate.remove_spans(docs, items)):
        plan = made._jdf.queryExecution().executedPlan().toString()
        assert plan.count("ArrowEvalPython") == 1
