import random
import re
import tracemalloc
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from prefboard.llm import collocations


def pieces_of(text):
    lowered = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    return [re.findall("[^ \t]+", p) for p in re.split("[.,;:!?\n\x0b\x0c\r]", lowered)]


def plain(rows, min_count, top=2000, longest=4):
    """The contract word for word, on lists."""
    n, f = Counter(), Counter()
    for lang, text in rows:
        for words in pieces_of(text):
            n[lang or "und"] += len(words)
            for size in range(1, longest + 1):
                f.update((lang or "und", tuple(words[i : i + size])) for i in range(len(words) - size + 1))
    often = {k: a for k, a in f.items() if a >= min_count and len(k[1]) > 1}
    held = {}
    for (lang, p), a in often.items():
        for size in range(2, len(p)):
            for i in range(len(p) - size + 1):
                part = (lang, p[i : i + size])
                held[part] = max(held.get(part, 0), a)
    out = {}
    for (lang, p), a in often.items():
        if 100 * held.get((lang, p), 0) >= 80 * a:
            continue
        cuts = [(2_000_000 * a // (f[lang, p[:c]] + f[lang, p[c:]]), c) for c in range(1, len(p))]
        score, c = min(cuts)
        out.setdefault(lang, []).append((-score, -a, " ".join(p).encode(), f[lang, p[:c]], f[lang, p[c:]]))
    return {
        (lang, rank, phrase.decode(), -a, l, r, n[lang], -score)
        for lang, found in out.items()
        for rank, (score, a, phrase, l, r) in enumerate(sorted(found)[:top], 1)
    }


def found(df, **options):
    return {tuple(r) for r in collocations.collocations(df, **options).collect()}


def text(draw, words, n):
    return "".join(draw.choice(words) + draw.choice(["  ", " ", "\t", " ", " ", ". ", "\n", ","]) for _ in range(n))


@pytest.fixture(scope="module")
def rows():
    draw = random.Random(6)
    out = []
    for number in range(40):
        words = [["a", "B", "ü", "x-y"], ["a", "b", "漢字", "of", "the", "The", "\xa0", "\x1c"]][number % 2]
        out.append((["en", "de", None][number % 3], text(draw, words, draw.choice([0, 1, 30, 200])) + " tail of the text"))
    return out + [("en", None), ("en", ""), (None, " \t"), ("en", "...!!!"), ("fr", "only once here")]


@pytest.mark.parametrize("shard, bits", [(1 << 20, collocations.BITS), (50, collocations.BITS), (50, 64)])
def test_equals_counting_all_phrases(spark, rows, monkeypatch, shard, bits):
    monkeypatch.setattr(collocations, "SHARD", shard)
    df = spark.createDataFrame(rows, "lang string, text string").repartition(3)
    assert found(df, min_count=5, bits=bits) == plain(rows, 5)
    assert found(df, min_count=5, top=3, longest=3) == plain(rows, 5, 3, 3)


def test_a_shard_holds_words_not_texts():
    batch = pa.record_batch([pa.array(["en"] * 4000), pa.array([f"{i % 50:06d} word, " * 700 for i in range(4000)])], ["lang", "text"])
    tracemalloc.start()
    assert sum(int((places > 0).sum()) for places, *_ in collocations.shards_of([batch])) == 2 * 700 * 4000
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert most < 44 << 20


def test_runs_of_rare_words_are_one_separator():
    places, ids = np.array([0, 1, 2, 2, 0, 2, 1, 0, 0]), np.array([0, 5, 9], np.uint64)
    bitmap = np.zeros(1, np.uint64)
    bitmap[0] = 1 << 5 | 1  # the low and the high bits of 5
    assert collocations._only(places, ids, bitmap).tolist() == [0, 1, 0, 1, 0]


def test_odd_rows(spark, odd, clashing, none):
    rows = [(r["lang"], r["text"]) for r in odd.collect()]
    wanted = plain(rows, 2)
    assert len(wanted) > 30
    assert found(odd, min_count=2) == wanted
    assert found(clashing.withColumns({w: F.lit(1) for w in ("w1", "n", "phrase", "rank", "part")}), min_count=2) == wanted
    assert found(none) == set()
    assert found(odd, min_count=1000) == set()


def test_ties_keep_the_first_cut_and_byte_order(spark):
    rows = [("en", "é b c. z y. f g. é b c. z y. f g. 😀 ￿. 😀 ￿")]
    df = spark.createDataFrame(rows, "lang string, text string")
    result = found(df, min_count=2)
    assert result == plain(rows, 2)
    assert [r[2] for r in sorted(result, key=lambda r: r[1])] == ["f g", "z y", "é b c", "😀 ￿"]


def test_an_interval_in_both_indexes():
    draw = np.random.default_rng(3)
    places = np.append(draw.integers(0, 6, 400), 0)
    index = collocations.TwoWayIndex(places, 5)
    listed = places.tolist()
    for ways in ([True, False, True], [False, False, False], [True, True, True], [False, True, False]):
        phrases = index.words()
        for left in ways:
            phrases = index.extend(phrases, left)
            size = phrases[0].shape[1]
            windows = Counter(tuple(listed[i : i + size]) for i in range(len(listed) - size + 1))
            wanted = {w: n for w, n in windows.items() if 0 not in w}
            assert dict(zip(map(tuple, phrases[0].tolist()), phrases[3].tolist())) == wanted
            if size < 4:  # the intervals hold the places of the phrase
                for words, low, width in zip(phrases[0].tolist(), phrases[1], phrases[3]):
                    before = Counter(index.forward.before[low : low + width].tolist())
                    at = [i for i in range(len(listed)) if listed[i : i + size] == words]
                    assert before == Counter(listed[i - 1] for i in at)


def test_counts_beyond_64_bits(spark):
    big = 1 << 61
    rows = [(1, 0, 0, 0, big), (2, 0, 0, 0, big + 1), (1, 2, 0, 0, big - 1)]
    phrases = spark.createDataFrame(rows, "w1 long, w2 long, w3 long, w4 long, f long")
    (row,) = collocations._scored(phrases, 4, collocations.SCALE).collect()
    assert (row["a"], row["l"], row["r"], row["score"]) == (big - 1, big, big + 1, 2_000_000 * (big - 1) // (2 * big + 1))


def test_lengths_beyond_four_are_refused(none):
    with pytest.raises(ValueError):
        collocations.collocations(none, longest=5)
