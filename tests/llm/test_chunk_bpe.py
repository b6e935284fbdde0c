import hashlib
import random
import tracemalloc

import public_tokenizers
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from prefboard.llm import chunk_bpe, queries

PATH = public_tokenizers.path("word_bpe_49k.json")
PLAIN = Tokenizer.from_file(PATH)

PARTS = """the over-fitting naïveté été ΟΔΟΣ İstanbul Straße 漢字かな don't WE'LL 12345 ½x² ́alone a b tab\there
<|endoftext|> <|ENDOFTEXT|> x<|startoftext|>y <| |> ... ?!« » 👩‍👩‍👧‍👦 été. (however), ﬁne 각 ​zero end""".split(" ")


def ids_of(text):
    return PLAIN.encode(text or "", add_special_tokens=False).ids


def odd_text(draw, n):
    return "".join(draw.choice(PARTS) + draw.choice([" ", "\n", "", "  ", "\r\n", "\t"]) for _ in range(n))


@pytest.fixture
def small_chunks(monkeypatch):
    monkeypatch.setattr(chunk_bpe, "LEAST", 1)
    monkeypatch.setattr(chunk_bpe, "MOST", 40)
    monkeypatch.setattr(chunk_bpe, "CUT_BITS", 4)


def test_joins_of_chunks_anywhere(small_chunks):
    tokens, draw = chunk_bpe.Tokens(PATH), random.Random(4)
    for n in list(range(40)) + [2000]:
        text = odd_text(draw, n).encode()
        ends = chunk_bpe.chunk_ends(text)
        chunks = [(a, b, tokens.encode(text[a:b])) for a, b in zip([0, *ends], ends)]
        assert b"".join(text[a:b] for a, b, _ in chunks) == text
        for known in (chunks, chunks[::2], chunks[1::3], []):
            assert chunk_bpe.put_together(text, known, tokens) == tokens.whole(text)


def test_window_grows_over_parts_without_blanks(small_chunks):
    tokens = chunk_bpe.Tokens(PATH)
    text = ("internationalisation" * 300).encode()
    ends = chunk_bpe.chunk_ends(text)
    assert max(b - a for a, b in zip(ends, ends[1:])) <= 40 < len(ends)
    assert chunk_bpe.put_together(text, [(a, b, tokens.encode(text[a:b])) for a, b in zip([0, *ends], ends)], tokens) == tokens.whole(text)


def test_a_wrong_neighbour_is_not_believed():
    tokens = chunk_bpe.Tokens(PATH)
    text = b"some plain words and mo" + b"re plain words here"
    wrong = bytearray(tokens.encode(b"other plain words or mo"))
    chunk_bpe._append(wrong, tokens.encode(text[23:]), text, 23, len(text), tokens)
    assert bytes(wrong) == tokens.whole(text)


def test_chunks_follow_the_content():
    draw = random.Random(8)
    shared = " ".join(str(draw.random()) for _ in range(2000))
    cuts = []
    for front in ("", "x" * 77, "é" * 5001):
        text = (front + shared).encode()
        ends = chunk_bpe.chunk_ends(text)
        assert all(chunk_bpe.LEAST <= b - a <= chunk_bpe.MOST for a, b in zip(ends, ends[1:-1]))
        cuts.append(set(chunk_bpe.chunk_digests(text)[1]))
    assert len(cuts[0] & cuts[1]) > 0.9 * len(cuts[0]) and len(cuts[0] & cuts[2]) > 0.9 * len(cuts[0])
    assert chunk_bpe.chunk_ends(b"") == [] and chunk_bpe.chunk_ends(b"a") == [1]
    assert max(b - a for a, b in zip([0], chunk_bpe.chunk_ends(b"a" * 100_000))) <= chunk_bpe.MOST


@pytest.mark.parametrize("bits", [64, chunk_bpe.BITS])
def test_ids_of_odd_rows(spark, clashing, bits):
    draw = random.Random(2)
    passage = odd_text(draw, 700)
    texts = [odd_text(draw, n) + passage[draw.randrange(9) :] + odd_text(draw, n) for n in range(12)]
    more = spark.createDataFrame([(100 + i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    rows = clashing.withColumns({"ids": F.lit(1), "row": F.lit("r"), "known": F.lit(2)})
    rows = rows.unionByName(more, allowMissingColumns=True)
    encoded = chunk_bpe.encode_texts(rows, PATH, bits=bits)
    assert sorted(encoded.columns) == sorted(rows.columns)
    found = chunk_bpe.decode_ids(encoded, PATH).select("doc_id", "text", "ids", "decoded").collect()
    assert sorted((r["doc_id"] or -1, r["text"] or "") for r in found) == sorted((r["doc_id"] or -1, r["text"] or "") for r in rows.collect())
    for r in found:
        assert list(r["ids"]) == ids_of(r["text"])
        assert r["decoded"] == PLAIN.decode(ids_of(r["text"]), skip_special_tokens=False)


def test_no_rows(spark, none):
    assert chunk_bpe.encode_texts(none, PATH).isEmpty()


def test_null_ids(spark):
    rows = spark.createDataFrame([(1, None), (2, []), (3, [320, 49407])], "n int, ids array<int>")
    assert [r["decoded"] for r in chunk_bpe.decode_ids(rows, PATH).orderBy("n").collect()] == [None, "", "a</w> <|endoftext|>"]


def test_a_batch_becomes_texts_by_portions():
    batch = pa.record_batch([pa.array([f"{i:06d} " * 1000 for i in range(4000)])], ["text"])
    tracemalloc.start()
    assert sum(len(texts) for _, texts in chunk_bpe._portioned([batch])) == 4000
    assert sum(part.num_rows for part, _ in chunk_bpe._portioned([batch])) == 4000
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert most < 8 << 20


def test_ids_are_digested_where_they_are_made(spark, folder):
    plan = queries.op11_chunk_bpe(spark, folder)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("MapInArrow") == 2  # texts without and with shared chunks


def test_other_tokenizers_are_refused():
    with pytest.raises(ValueError):
        chunk_bpe.Tokens(public_tokenizers.path("byte_bpe_50k.json"))


def test_query_equals_the_tokenizer(spark, folder):
    found = {tuple(r) for r in queries.op11_chunk_bpe(spark, folder).collect()}
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    wanted = set()
    for r in spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text").collect():
        ids = ids_of(r["text"])
        decoded = PLAIN.decode(ids, skip_special_tokens=False)
        wanted.add((r["doc_id"], len(ids), sha(" ".join(map(str, ids))), sha(decoded)))
    assert found == wanted
