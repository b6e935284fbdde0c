import itertools
import math
import sys
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from prefboard.llm import ctw, quality, queries
from prefboard.llm.texts import hashed_spaced_words


def tokens(text):
    return [*(text or "").encode().lower().split(), None]


def base_plainly(rows):
    learned = [r for r in rows if r["doc_id"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 5 != 1]
    counts = Counter(t for r in learned for t in tokens(r["text"]))
    total, floor = sum(counts.values()), 0.5 * (len(counts) + 1)
    for r in rows:
        own = tokens(r["text"])
        score = sum(math.log10((counts[t] + 0.5) / (total + floor)) for t in own)
        yield r["doc_id"], len(own), sum(counts[t] > 0 for t in own), total, score


def agree(got, rows):
    wanted = list(base_plainly(rows))
    assert len(got) == len(wanted)
    key = lambda r: tuple(str(x) for x in r[:4]) + (round(r[4], 6),)
    mine = [(r["doc_id"], r["n_tokens"], r["n_known"], r["train_tokens"], r["base_score"]) for r in got]
    for a, b in zip(sorted(mine, key=key), sorted(wanted, key=key)):
        assert a[:4] == b[:4] and a[4] == pytest.approx(b[4], rel=1e-9, abs=1e-9)


def test_base_score_on_whole_table(spark, folder):
    got = queries.QUERIES["op4_context_tree_score"](spark, folder).collect()
    agree(got, spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text").collect())
    held = [r for r in got if r["held_out"]]
    size = {r["doc_id"]: len((r["text"] or "").encode()) + 1 for r in spark.read.parquet(f"{folder}/documents.parquet").collect()}
    bits = -sum(r["score"] for r in held) / math.log10(2) / sum(size[r["doc_id"]] for r in held)
    assert 1.5 < bits < 2.6


@pytest.mark.parametrize("max_words", [1_000_000, 20])
def test_odd_rows(odd, none, clashing, max_words):
    for df in (odd, clashing):
        got = ctw.score_texts(df, max_words=max_words).collect()
        agree(got, odd.collect())
        assert all(r["score"] < 0 and math.isfinite(r["score"]) for r in got)
    assert ctw.score_texts(none).count() == 0


def test_nothing_to_learn_from(spark):
    held = next(i for i in range(100) if zlib.crc32(str(i).encode()) % 5 == 1)
    row = ctw.score_texts(spark.createDataFrame([(held, "ab")], "doc_id long, text string")).first()
    assert row["score"] == pytest.approx(24 * math.log10(0.5), rel=1e-6) and row["n_known"] == 0


def kt(zeros, ones):
    value = 1.0
    for k in range(zeros):
        value *= (k + 0.5) / (k + 1)
    for k in range(ones):
        value *= (k + 0.5) / (zeros + k + 1)
    return value


def test_weights_follow_the_recursion(spark):
    """Each node by the textbook: half its estimate, half the product below it."""
    texts = ["abab", "abba", "bbbb", "a"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    contexts = Counter()
    for t in texts:
        data = b"\xff" * 4 + t.encode() + b"\xff"
        for at in range(4, len(data)):
            contexts[data[at - 4 : at], data[at]] += 1

    def bits(context, prefix, depth):
        zeros = ones = 0
        for (seen, symbol), n in contexts.items():
            path = format(symbol, "08b")
            if seen.endswith(context) and path.startswith(prefix):
                zeros, ones = zeros + n * (path[depth] == "0"), ones + n * (path[depth] == "1")
        return zeros, ones

    def weighted(context, prefix):
        own = kt(*bits(context, prefix, len(prefix)))
        if len(context) == 4:
            return own
        longer = {seen[-len(context) - 1 :] for seen, _ in contexts if seen.endswith(context)}
        return 0.5 * own + 0.5 * math.prod(weighted(c, prefix) for c in sorted(longer))

    def probability(context, prefix, bit):
        """Of a one or zero behind four bytes, mixed over the path."""
        mixed, left = 0.0, 1.0
        for depth in range(5):
            here = context[4 - depth :]
            zeros, ones = bits(here, prefix, len(prefix))
            estimate = ((ones if bit else zeros) + 0.5) / (zeros + ones + 1)
            if depth == 4:
                return mixed + left * estimate
            stay = 0.5 * kt(zeros, ones) / weighted(here, prefix)
            mixed, left = mixed + left * stay * estimate, left * (1 - stay)

    keys, codes = ctw.train(ctw.corpus_counts(df), max_contexts=1 << 16)
    rows = ctw.ContextRows(keys)
    for context, symbol in itertools.product({c for c, _ in contexts}, (ord("a"), ord("b"), 0xFF, ord("z"))):
        path = format(symbol, "08b")
        wanted = sum(math.log10(probability(context, path[:k], path[k] == "1")) for k in range(8))
        row = rows.find(np.array([int.from_bytes(context, "big")], np.uint32))[0]
        assert codes[row, symbol] == pytest.approx(wanted, rel=1e-5)


def test_few_contexts_still_make_a_distribution(spark, folder):
    texts = spark.read.parquet(f"{folder}/documents.parquet").select("text")
    counts = ctw.corpus_counts(texts)
    for most in (1, 50, 5000):
        keys, codes = ctw.train(counts, most)
        assert len(keys) <= 1 + 4 * most + 4
        assert np.allclose((10.0 ** codes.astype(np.float64)).sum(axis=1), 1, atol=1e-4)


def code_lengths(df, depth):
    """Scores by the recursion in plain Python, contexts shortest first."""
    learned, held = {}, []
    for doc_id, text in df.collect():
        data = b"\xff" * depth + text.encode() + b"\xff"
        runs_ = [(data[at - depth : at], data[at]) for at in range(depth, len(data))]
        held.append((doc_id, runs_))
        if zlib.crc32(str(doc_id).encode()) % 5 != 1:
            for seen, symbol in runs_:
                path = format(symbol, "08b")
                for d in range(depth + 1):
                    for k in range(8):
                        node = learned.setdefault((seen[depth - d :], path[:k]), [0, 0, 0.0])
                        node[int(path[k])] += 1
    log_kt = lambda a, b: math.lgamma(a + 0.5) + math.lgamma(b + 0.5) - math.lgamma(a + b + 1) - math.log(math.pi)
    stay = {}
    for (seen, prefix), (zeros, ones, below) in sorted(learned.items(), key=lambda x: -len(x[0][0])):
        below, own = learned[seen, prefix][2], log_kt(zeros, ones)
        weighted = own if len(seen) == depth else float(np.logaddexp(own, below)) - math.log(2)
        stay[seen, prefix] = math.exp(own - math.log(2) - weighted)
        if seen:
            learned[seen[1:], prefix][2] += weighted
    found = {}
    for doc_id, runs_ in held:
        found[doc_id] = 0.0
        for seen, symbol in runs_:
            path = format(symbol, "08b")
            for k in range(8):
                mixed, left = 0.0, 1.0
                for d in range(depth + 1):
                    name = seen[depth - d :], path[:k]
                    zeros, ones, _ = learned.get(name, (0, 0, 0.0))
                    one = ((ones if path[k] == "1" else zeros) + 0.5) / (zeros + ones + 1)
                    share = 1.0 if d == depth else stay.get(name, 0.5)
                    mixed, left = mixed + left * share * one, left * (1 - share)
                found[doc_id] += math.log10(mixed)
    return found


@pytest.mark.parametrize("depth, max_runs", [(5, 1 << 22), (5, 50), (4, 1), (6, 1000)])
def test_rare_contexts_count_in_a_large_corpus(spark, folder, depth, max_runs):
    """Above 65,536 bytes too, every context that occurs is a node."""
    rows = spark.read.parquet(f"{folder}/documents.parquet").where("text is not null and length(text) > 0")
    some = rows.orderBy("doc_id").limit(45).select("doc_id", "text")
    wanted = code_lengths(some, depth)
    assert sum(len(r["text"].encode()) for r in some.collect()) > 1 << 16
    got = ctw.score_texts(some, max_runs=max_runs, depth=depth).collect()
    assert len(got) == len(wanted) and any(r["held_out"] for r in got)
    for r in got:
        assert r["score"] == pytest.approx(wanted[r["doc_id"]], rel=1e-6)


def test_counting_makes_no_call_for_each_word():
    texts = [" ".join(f"w{i} x{i * i}" for i in range(k, k + 2500)) for k in range(0, 10_000, 2500)]
    batch = pa.record_batch([pa.array(texts), pa.array([True] * len(texts))], ["text", "learned"])
    calls = Counter()
    sys.setprofile(lambda frame, event, arg: calls.update([event]))
    try:
        rows = list(ctw._count([batch], 5))
    finally:
        sys.setprofile(None)
    words = Counter(w for t in texts for w in t.split())
    assert len(words) > 15_000 and calls.total() < 5000
    found = [n for r in rows for kind, n in zip(r["kind"].to_pylist(), r["n"].to_pylist()) if kind == 0]
    assert sorted(found) == sorted(words.values())


def test_words_are_told_apart_by_their_hashes():
    texts = [b"", b" \t\n\x0b ", b"a\0 a A a\0\0 \0 b", b"x" * 64 + b" " + b"x" * 65 + b"\x0c" + b"X" * 72 + b"\rx\x1c\xff x", b"", b"eightlet eightlett"]
    texts += [b" ".join(bytes([97 + i % 3]) * i + b"%d" % k for i in range(80)) for k in range(20)]
    hashed, lengths = hashed_spaced_words(texts)
    words = [w for t in texts for w in t.lower().split()]
    assert lengths.tolist() == [len(t.split()) for t in texts]
    assert len(set(zip(words, hashed.tolist()))) == len(set(words)) == len(set(hashed.tolist()))
    alone = [h for w in words for h in hashed_spaced_words([w])[0].tolist()]
    assert alone == hashed.tolist()
    assert [len(x) for x in hashed_spaced_words([b""])] == [0, 1]


@pytest.mark.parametrize("seldom, held", [(60, 61), (99, 100), (100, 1), (5000, 1)])
def test_frequent_words_are_held_up_to_the_bound(spark, seldom, held):
    rows = [(ctw._WORDS, -1, 10_000), *((ctw._WORDS, k, 10) for k in range(seldom)), (ctw._GRAMS, 7, 9)]
    counts = spark.createDataFrame(rows, "kind int, key long, n long")
    *_, keys, n = ctw.frequent_words(counts, 100)
    assert len(keys) == held and dict(zip(keys.tolist(), n.tolist()))[-1] == 10_000


@pytest.mark.parametrize("size", [0, 1, 2, 3, 1000, 4096])
def test_what_is_held_is_found(size):
    make = np.random.default_rng(size)
    keys = np.unique(np.concatenate([[-1, 0, 1], make.integers(-(1 << 63), (1 << 63) - 1, 5000)]))
    make.shuffle(keys)
    values = make.random(size)
    asked = np.concatenate([keys, keys[::-1]])
    wanted = dict(zip(keys[:size].tolist(), values.tolist()))
    found = ctw.Held(keys[:size], values).find(asked)
    assert np.array_equal(found, [wanted.get(k, math.nan) for k in asked.tolist()], equal_nan=True)


# quality


def test_held_out_accuracy(spark, folder):
    got = queries.QUERIES["op6_quality_classifier"](spark, folder).toPandas()
    assert len(got) == spark.read.parquet(f"{folder}/documents.parquet").count()
    assert got.score.between(0, 1).all() and ((got.score >= 0.7) == (got.predicted == 1)).all()
    rows = got.merge(spark.read.parquet(f"{folder}/labels.parquet").toPandas(), on="doc_id")
    held = rows[rows.held_out]
    assert (held.predicted == held.quality).mean() > 0.93
    assert (held[held.quality == 0].predicted == 0).mean() > 0.9
    again = queries.QUERIES["op6_quality_classifier"](spark, folder).toPandas()
    assert got.sort_values("doc_id").score.tolist() == again.sort_values("doc_id").score.tolist()


def test_quality_of_odd_rows(spark, odd, none, clashing):
    labels = spark.createDataFrame(
        [(1, 0, 0), (2, None, 1), (5, 1, 0), (5, 1, 0), (None, 1, 0), (77, 0, 0), (9, 0, 0), (10, 7, 0)], "doc_id long, quality int, toxic int"
    )
    rows = quality.quality_scores(odd, labels).collect()
    assert len(rows) == odd.count() and all(0 <= r["score"] <= 1 for r in rows)
    assert len({r["score"] for r in rows if r["doc_id"] == 6}) == 1
    assert quality.quality_scores(clashing, labels).count() == odd.count()
    assert quality.quality_scores(none, labels).count() == 0
    assert {r["score"] for r in quality.quality_scores(odd, labels.limit(0)).collect()} == {0.5}
    kept = quality.keep_good(odd, labels.where("quality = 1"))
    assert kept.columns == odd.columns and kept.count() == odd.count()


def test_temperature_is_fitted():
    make = np.random.default_rng(0)
    x = make.normal(size=(2000, 5))
    y = (make.random(2000) < 1 / (1 + np.exp(-2 * x[:, 0]))).astype(int)
    network = quality.Network(x, y)
    fresh = make.normal(size=(4000, 5))
    truth = 1 / (1 + np.exp(-2 * fresh[:, 0]))
    assert np.abs(network.predict(fresh) - truth).mean() < 0.1
