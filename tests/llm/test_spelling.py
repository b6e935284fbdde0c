import random
import re
import zlib
from collections import Counter

import pytest

from prefboard.llm import spelling


def one_apart(a, b):
    if abs(len(a) - len(b)) > 1 or a == b:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    a, b = sorted((a, b), key=len)
    return any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def plain_variants(counts, much_more=5):
    near = {w: [o for o in counts if one_apart(w, o)] for w in counts}
    form = {}
    for word, others in near.items():
        best = min(others, key=lambda o: (-counts[o], o), default=None)
        form[word] = best if best and counts[best] >= much_more * counts[word] else None

    def root(word):
        return root(form[word]) if form[word] else word

    return {(w, form[w], root(w), counts[w], len(near[w]), counts.get(form[w])) for w in counts}


def variants_of(spark, counts):
    words = spark.createDataFrame(list(counts.items()), "word string, n long")
    return {tuple(r) for r in spelling.spelling_variants(words).select("word", "form", "root", "n", "n_near", "form_n").collect()}


@pytest.mark.parametrize("letters", ["ab", "abcé", "abcdefghijàöÿ"])
def test_equals_comparison_of_all_words(spark, letters):
    draw = random.Random(letters)
    counts = {}
    for _ in range(400):
        word = "".join(draw.choices(letters, k=draw.randint(6, 9)))
        counts[word] = draw.choice([5, 6, 7, 30, 150, 800, 4000])
        at = draw.randrange(len(word))
        counts[word[:at] + draw.choice(letters) + word[at + draw.randint(0, 1) :]] = draw.choice([5, 40])
    assert variants_of(spark, counts) == plain_variants(counts)


def test_near_words_share_a_key():
    draw = random.Random(5)
    for _ in range(300):
        a = "".join(draw.choices("abcdé", k=draw.randint(1, 12)))
        at, kind = draw.randrange(len(a)), draw.randint(0, 2)
        b = a[:at] + ("" if kind == 0 else draw.choice("abcdéÿ")) + a[at + (kind < 2) :]
        if b:
            keys = spelling.signature_keys([a, b])
            assert a == b or set(keys[0]) & set(keys[1])


def test_chains_and_ties(spark):
    chain = {"abcdef": 5, "abcdeg": 25, "abcdhg": 125, "abcihg": 625, "abjihg": 3125, "akjihg": 15625}
    rows = {r[0]: r for r in variants_of(spark, chain)}
    assert rows["abcdef"][1:3] == ("abcdeg", "akjihg") and rows["akjihg"][1:3] == (None, "akjihg")
    ties = {"mmmmmm": 5, "mmmmmz": 25, "mmmmma": 25, "ammmmm": 24}
    rows = {r[0]: r for r in variants_of(spark, ties)}
    assert rows["mmmmmm"] == ("mmmmmm", "mmmmma", "mmmmma", 5, 3, 25)
    assert rows["ammmmm"][1] is None


def plain_counts(rows):
    counts = Counter()
    for row_id, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            word = re.sub("[A-Z]", lambda m: m[0].lower(), run)
            h = zlib.crc32(f"{'' if row_id is None else row_id}:{word}".encode())
            counts[word if h % 199 else word[: h % len(word)] + word[h % len(word) + 1 :]] += 1
    return {(w, n) for w, n in counts.items() if len(w) >= 6 and n >= 5}


def test_counts_of_odd_rows(spark, odd, clashing, none):
    rows = [(r["doc_id"], r["text"]) for r in odd.collect()] + [(i, "Übermäßig ÜBERMÄSSIG×÷ naïvely " * 3) for i in range(400, 1000)]
    more = odd.select("doc_id", "text").union(spark.createDataFrame(rows[-600:], "doc_id long, text string"))
    found = {tuple(r) for r in spelling.count_words(more).collect()}
    assert found == plain_counts(rows)
    assert any(len(w) == 8 and w.startswith(("Üb", "be")) for w, _ in found)  # some have lost a letter
    assert {tuple(r) for r in spelling.count_words(clashing).collect()} == plain_counts(rows[:-600])
    assert spelling.spelling_variants(spelling.count_words(none)).isEmpty()


def test_counts_held_in_portions(spark, monkeypatch):
    monkeypatch.setattr(spelling, "MOST_HELD", 3)
    batches = spark.createDataFrame([(i, "second secund " * 5) for i in range(20)], "doc_id long, text string").toArrow().to_batches()
    total = Counter()
    for batch in spelling._counted(None)(batches):
        for row in batch.to_pylist():
            total[row["word"]] += row["n"]
    assert total == {"second": 100, "secund": 100}


def test_very_long_words(spark):
    long = "abcdefgh" * 5_000
    assert variants_of(spark, {long: 5, long + "x": 30}) == plain_variants({long: 5, long + "x": 30})
