import random

import pytest

from prefboard.llm import license_scan
from prefboard.llm.license_scan import Index, NOTICES, PHRASES, Template
from prefboard.llm.texts import alnum_words


def plainly(text, templates):
    """All blocks against all templates, no filter."""
    tail = max(len(t.text.split()) for t in templates if t.exact) - 1 if any(t.exact for t in templates) else 0
    words, found, at = alnum_words(text.encode()), [], 0
    for number, line in enumerate(text.split("\n")):
        own = alnum_words(line.encode())
        longer = words[at : at + len(own) + tail]
        for t in templates if own else ():
            wanted = alnum_words(t.text.encode())
            part = longer if t.exact else own
            share = len(set(wanted) & set(part)) / len(set(wanted))
            if share + 1e-9 < t.threshold:
                continue
            if t.exact:
                places = [i for i in range(len(own)) if part[i : i + len(wanted)] == wanted]
            else:
                places = [next(i for i, w in enumerate(part) if w in wanted)]
            found += [(t.label, t.exact, number, at + i, share) for i in places]
        at += len(own)
    return len(words), sorted(found)


@pytest.mark.parametrize("seed", range(60))
def test_filters_lose_nothing(seed):
    random.seed(seed)
    vocabulary = [f"w{i}" for i in range(8)]
    templates = [
        Template(f"t{k}", " ".join(random.choices(vocabulary, k=random.randint(1, 7))), random.choice([0.5, 0.7, 0.8, 1.0]))
        for k in range(5)
    ]
    templates += [Template("e", " ".join(random.choices(vocabulary, k=2)), 1.0, True)]
    frequencies = {w.encode(): random.randint(0, 9) for w in vocabulary}
    index = Index(templates, frequencies)
    for _ in range(10):
        words = random.choices([*vocabulary, "other", "é", "-", "\n", "\n"], k=random.randint(0, 40))
        count, found = index.matches(" ".join(words).encode())
        assert (count, sorted(found)) == plainly(" ".join(words), templates)


def windows_plainly(text, templates):
    """Every window that begins with a word of a template, no filter."""
    words, found = alnum_words(text.encode()), []
    for t in templates:
        wanted = alnum_words(t.text.encode())
        size, groups = len(wanted) + (len(wanted) + 1) // 2, []
        for i, w in enumerate(words):
            share = len(set(wanted) & set(words[i : i + size])) / len(set(wanted))
            if w in wanted and share + 1e-9 >= t.threshold:
                if not groups or i >= groups[-1][-1][0] + size:
                    groups.append([])
                groups[-1].append((i, share))
        found += [(t.label, *max(g, key=lambda m: (m[1], -m[0]))) for g in groups]
    return sorted(found)


@pytest.mark.parametrize("seed", range(60))
def test_windows_lose_nothing(seed):
    random.seed(seed)
    vocabulary = [f"w{i}" for i in range(9)]
    templates = [
        Template(f"t{k}", " ".join(random.choices(vocabulary, k=random.randint(1, 8))), random.choice([0.5, 0.7, 0.8, 1.0]))
        for k in range(5)
    ]
    index = Index(templates, {w.encode(): random.randint(0, 9) for w in vocabulary})
    for _ in range(10):
        text = " ".join(random.choices([*vocabulary, "other", "more", "é", "-", "\n"], k=random.randint(0, 90)))
        found = index.matches(text.encode(), windows=True)[1]
        assert sorted((m[0], m[3], m[4]) for m in found) == windows_plainly(text, templates)
        lines = [n for n, line in enumerate(text.split("\n")) for _ in alnum_words(line.encode())]
        assert all(m[2] == lines[m[3]] for m in found)


def test_wrapped_notices_and_scattered_words(spark):
    filler = lambda n: " ".join(["filler"] * n)
    texts, wanted = [], {}
    for t in NOTICES:
        words = t.text.split()
        for width in (1, 3, len(words) // 2):
            lines = [" * " + " ".join(words[i : i + width]) for i in range(0, len(words), width)]
            wanted[len(texts)] = t.label
            texts.append(filler(20) + "\n" + "\n".join(lines) + "\n" + filler(20))
    for t in NOTICES:
        wanted[len(texts)] = None
        texts.append(f" {filler(1000)} ".join(t.text.split()))
    df = license_scan.find_licenses(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), NOTICES)
    for r in df.collect():
        found = {m["label"] for m in r["licenses"]["matches"]}
        assert wanted[r["doc_id"]] in found if wanted[r["doc_id"]] else not found


def test_phrases_over_lines_and_signs(spark):
    rows = [
        (1, "All Rights\nReserved. ALL-RIGHTS/reserved cc\n\n by; xcc by cc byx"),
        (2, "gnu general public license, general publicé license"),
        (3, "all rights reserved all rights reserved"),
    ]
    df = license_scan.find_licenses(spark.createDataFrame(rows, "doc_id long, text string"), PHRASES)
    got = {r["doc_id"]: [(m["label"], m["start"]) for m in r["licenses"]["matches"]] for r in df.collect()}
    assert got == {1: [("reserved", 0), ("reserved", 3), ("cc-by", 6)], 2: [("gpl", 1)], 3: [("reserved", 0), ("reserved", 3)]}


def test_odd_rows(odd, none, clashing):
    for df in (odd, clashing):
        found = license_scan.find_licenses(df)
        rows = found.collect()
        assert len(rows) == odd.count() and found.columns.count("licenses") == 1
        assert all(r["licenses"]["matches"] == [] for r in rows)
        assert all(r["licenses"]["n_words"] == len(alnum_words((r["text"] or "").encode())) for r in rows)
    assert license_scan.find_licenses(none).count() == 0


@pytest.mark.parametrize("windows", [True, False])
def test_whole_table_with_all_templates(spark, folder, windows):
    texts = spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text")
    rows = license_scan.find_licenses(texts, windows=windows).collect()
    some = 0
    for r in rows:
        text, matches = r["text"] or "", sorted(tuple(m) for m in r["licenses"]["matches"])
        count, expected = plainly(text, PHRASES + NOTICES)
        if windows:
            assert [m for m in matches if m[1]] == [m for m in expected if m[1]]
            assert sorted((m[0], m[3], m[4]) for m in matches if not m[1]) == windows_plainly(text, NOTICES)
        else:
            assert matches == expected
        assert r["licenses"]["n_words"] == count
        some += bool(matches)
    assert some > 5
