import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from prefboard.llm import packing, queries

PATH = public_tokenizers.path("word_bpe_49k.json")


@pytest.fixture(scope="module")
def tokenizer():
    return Tokenizer.from_file(PATH)


def check(rows, expected, capacity):
    """Every id of every document once, no sequence over capacity, offsets gapless."""
    rows = [r.asDict() for r in rows]
    got = sorted((str(r["doc_id"]), r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in rows)
    assert got == sorted(expected)
    sequences = {}
    for r in rows:
        sequences.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for pieces in sequences.values():
        at = 0
        for offset, length in sorted(pieces):
            assert offset == at
            at += length
        assert at <= capacity
    return sequences


def pieces_of(doc_id, ids, capacity):
    ids = [*ids, 0]
    for piece, start in enumerate(range(0, len(ids), capacity)):
        part = np.array(ids[start : start + capacity], "<u4")
        yield str(doc_id), piece, start, len(part), zlib.crc32(part.tobytes())


def test_query_on_whole_table(spark, folder, tokenizer):
    texts = spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text").collect()
    rows = queries.QUERIES["op7_best_fit_packing"](spark, folder).collect()
    ids = [e.ids for e in tokenizer.encode_batch([r["text"] or "" for r in texts], add_special_tokens=False)]
    expected = [p for r, i in zip(texts, ids) for p in pieces_of(r["doc_id"], i, 2048)]
    sequences = check(rows, expected, 2048)
    assert len(sequences) <= 1.01 * -(-sum(p[3] for p in expected) // 2048)


def test_odd_rows(odd, none, clashing, tokenizer):
    expected = [
        p
        for r in odd.collect()
        for p in pieces_of(r["doc_id"], tokenizer.encode(r["text"] or "", add_special_tokens=False).ids, 64)
    ]
    check(packing.pack_documents(odd, PATH, 64).collect(), expected, 64)
    check(packing.pack_documents(clashing, PATH, 64).collect(), expected, 64)
    assert packing.pack_documents(none, PATH).count() == 0


ODD_TEXTS = [
    "It's <|endoftext|> A<|x LOVE!!.,x 3.14 don't'll \x01 \x00a\xa0b a\x1cb\x85c",
    "é, É, ÀÉ. ﬁx İstanbul ΑΣ ΑΣ. straße ẞ x́,y 漢字, 한국 Å ｱ à.",
    "",
    "  \t\n ",
    "...,",
    "a,b.c ,. <|startoftext|>Word, WORD the-end. (x). 'tis   y",
]


@pytest.mark.parametrize("text", ODD_TEXTS)
def test_parts_give_the_ids_of_the_whole_text(tokenizer, text):
    ids = np.array(tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()
    assert packing.WordTokenizer(PATH, most=5).encode(text.encode()) == ids


class _Counting:
    """A tokenizer, or its merges, that notes what it is asked."""

    def __init__(self, of):
        self.of, self.asked = of, []

    def tokenize(self, text):
        self.asked.append(text)
        return self.of.tokenize(text)

    def encode(self, text, **how):
        self.asked.append(text)
        return self.of.encode(text, **how)


def test_rare_parts_do_not_drive_out_frequent_ones(tokenizer):
    words = packing.WordTokenizer(PATH, most=100)
    merges = words._parts._model = _Counting(words._parts._model)
    frequent = ["alpha", "beta", "gamma", "delta"]
    draw = random.Random(5)
    rare = ["".join(draw.choices("bcdfgh", k=9)) for _ in range(2000)]
    text = " ".join(w for i, r in enumerate(rare) for w in (frequent[i % 4], r))
    assert words.encode(text.encode()) == np.array(tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()
    assert sum(merges.asked.count(w) for w in frequent) <= 2 * len(frequent)


def test_plain_parts_need_the_merges_alone(tokenizer):
    words = packing.WordTokenizer(PATH)
    text = "a$$$ re%%%x, È. ÉTÉ_12 (a.b);c [x]^{y}~ " + "a" * 60 + "…" + " end"
    whole = words._parts._tokenizer = _Counting(words._parts._tokenizer)
    assert words.encode(text.encode()) == np.array(tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()
    assert whole.asked == ["a" * 60 + "…"]


def one_by_one(counts, capacity):
    """Best two fit, a sequence at a time."""
    left = sorted((x for x, n in counts.items() for _ in range(n)), reverse=True)
    out = []
    while left:
        gap, filled = capacity, []
        for x in list(left):
            if x <= gap:
                filled.append(x)
                left.remove(x)
                gap -= x
        if gap:
            small, best = min(filled), None
            for i, a in enumerate(left):
                for b in left[i + 1 :]:
                    if a + b <= gap + small and a + b > (best and sum(best) or small):
                        best = (a, b)
            if best:
                filled.remove(small)
                left = sorted([*left, small], reverse=True)
                for x in best:
                    filled.append(x)
                    left.remove(x)
        out.append(sum(filled))
    return out


@pytest.mark.parametrize("seed", range(30))
def test_repeated_fillings_equal_packing_one_by_one(seed):
    random.seed(seed)
    counts = {random.randint(1, 30): random.randint(1, 40) for _ in range(random.randint(1, 10))}
    plan = packing.best_two_fit(counts, 30)
    assert sorted(sum(x * m for x, m in f) for t, f in plan for _ in range(t)) == sorted(one_by_one(counts, 30))
    used = {}
    for times, filling in plan:
        for length, many in filling:
            used[length] = used.get(length, 0) + many * times
    assert used == counts
