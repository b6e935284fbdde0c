"""BPE encoding with reuse of content-defined chunks, and decoding.

A rolling hash of the last 32 bytes cuts every text into chunks, so passages that
documents share have the same chunks wherever they stand. A chunk that occurs more
than once is encoded once; a text is put together from the ids of its shared chunks
and of the runs between them. A cut may fall into a word, and then the ids at the
join are wrong: the parts on both sides of it are encoded anew, with one more part
on either side, until these outer parts come out as they stood, and the new ids
replace the old ones.

Which chunks are shared follows from counting their hashes. Tasks learn it from a
bitmap of fixed size, which may take a chunk for shared that is not: it then takes
the longer way, to the same ids. Texts without shared chunks are encoded where they
are read; of the others only the shared chunks are moved for encoding.

For tokenizers that drop white space and never join across it.
"""

from functools import lru_cache
from hashlib import sha256

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from prefboard.llm.bitmap import BITS, bitmap_of, possible
from prefboard.llm.packing import MAX_CACHED_PARTS, WordTokenizer, _PartIds
from prefboard.llm.texts import bytes_by_portions, lookup_table, portions
from prefboard.session import materialise

#: Bytes of a chunk: at least, at most, and the bits that the hash needs at a cut
#: (one place in 1,024 is one).
LEAST, MOST, CUT_BITS = 256, 1 << 14, 10
#: Digests a task keeps to send a chunk on once.
MOST_SEEN = 200_000

_GEAR = np.random.Generator(np.random.PCG64(23)).integers(0, 1 << 32, 256, np.uint32)


def chunk_ends(text: bytes) -> list:
    """Where the chunks of a text end; cuts lie between code points."""
    n = len(text)
    ends, last = [], 0

    def forced(until):
        nonlocal last
        while until - last > MOST:
            last += MOST
            while text[last] & 0xC0 == 0x80:
                last -= 1
            ends.append(last)

    if n > LEAST:
        raw = np.frombuffer(text, np.uint8)
        hashed = _GEAR[raw]
        for step in (1, 2, 4, 8, 16):  # doubles the bytes that a hash covers
            hashed[step:] += hashed[:-step] << np.uint32(step)
        cut = (hashed[:-1] >> np.uint32(32 - CUT_BITS) == 0) & (raw[1:] & 0xC0 != 0x80)
        for at in (np.flatnonzero(cut) + 1).tolist():
            forced(at)
            if at - last >= LEAST:
                ends.append(at)
                last = at
    forced(n)
    return ends + [n] if n > last else ends


def chunk_digests(text: bytes) -> tuple:
    """`(ends, 128-bit digests, their first 64 bits as numbers)` of a text's chunks."""
    ends = chunk_ends(text)
    digests = [xxhash.xxh3_128_digest(text[a:b]) for a, b in zip([0, *ends], ends)]
    return ends, digests, np.frombuffer(b"".join(digests), "<u8")[::2]


class Tokens(WordTokenizer):
    """A tokenizer by parts (`encode`) and on whole texts; ids as little-endian 32-bit bytes."""

    def __init__(self, path, most=MAX_CACHED_PARTS):
        from tokenizers import Tokenizer

        self._whole = Tokenizer.from_file(path)
        self._whole.no_truncation()
        self._whole.no_padding()
        self._parts = lookup_table(_PartIds(self._whole, most))
        if self.whole(b"a bc\nd") != self.whole(b"a") + self.whole(b"bc") + self.whole(b"d"):
            raise ValueError("the tokenizer does not drop white space")

    def whole(self, text: bytes) -> bytes:
        return np.array(self._whole.encode(text.decode(), add_special_tokens=False).ids, "<u4").tobytes()


class Decoder:
    """Texts of token ids, special tokens included."""

    def __init__(self, path):
        from tokenizers import Tokenizer

        whole = Tokenizer.from_file(path)
        self._whole = whole if whole.decoder is not None else None
        size = whole.get_vocab_size(with_added_tokens=True)
        self._shown = np.array([whole.id_to_token(i) or "" for i in range(size)], object)
        self._digits = np.array([b"%d" % i for i in range(size)], object)

    def decode(self, ids: np.ndarray) -> str:
        """Without a decoder, tokens stand as they are with a space between them."""
        if self._whole is None:
            return " ".join(self._shown[ids])
        return self._whole.decode(ids.tolist(), skip_special_tokens=False)

    def listed(self, ids: np.ndarray) -> bytes:
        """Decimal ids with a space between them."""
        return b" ".join(self._digits[ids])


@lru_cache(1)
def _tokens(path):
    return Tokens(path)


@lru_cache(1)
def _decoder(path):
    return Decoder(path)


def _part_start(text, at, parts):
    """Start of the last so many blank-separated parts of `text[:at]`."""
    for _ in range(parts):
        reach = 64
        while True:
            low = max(0, at - reach)
            found = max(text.rfind(b" ", low, at), text.rfind(b"\n", low, at))
            if found >= 0 or not low:
                break
            reach *= 4
        if found < 0:
            return 0
        at = found
    return at + 1


def _part_end(text, at, end, parts):
    """End of the first so many blank-separated parts of `text[at:end]`."""
    at -= 1
    for _ in range(parts):
        reach = 64
        while True:
            high = min(end, at + 1 + reach)
            found = [f for f in (text.find(b" ", at + 1, high), text.find(b"\n", at + 1, high)) if f >= 0]
            if found or high == end:
                break
            reach *= 4
        if not found:
            return end
        at = min(found)
    return at


def _append(ids: bytearray, more: bytes, text: bytes, at: int, end: int, tokens):
    """`ids` of `text[:at]` become those of `text[:end]`; `more` are those of `text[at:end]`."""
    wide = 1
    while True:
        outer, left = _part_start(text, at, wide + 1), _part_start(text, at, wide)
        right, last = _part_end(text, at, end, wide), _part_end(text, at, end, wide + 1)
        before, behind = tokens.encode(text[outer:left]), tokens.encode(text[right:last])
        tail, head = tokens.encode(text[left:at]), tokens.encode(text[at:right])
        window = tokens.whole(text[outer:last])
        known = before + tail
        agree = (
            window.startswith(before)
            and window.endswith(behind)
            and len(window) >= len(before) + len(behind)
            and ids[len(ids) - len(known) :] == known
            and more.startswith(head + behind)
        )
        if agree:
            del ids[len(ids) - len(tail) :]
            ids += window[len(before) : len(window) - len(behind)]
            ids += more[len(head) :]
            return
        if not outer and last == end:
            ids[:] = window
            return
        wide *= 2


def put_together(text: bytes, known: list, tokens) -> bytes:
    """Ids of a text, from `(start, end, ids)` of some of its chunks in order."""
    ids, at = bytearray(), 0
    for start, end, of_chunk in [*known, (len(text), len(text), b"")]:
        for a, b, more in ((at, start, None), (start, end, of_chunk)):
            if b > a:
                more = tokens.encode(text[a:b]) if more is None else more
                if a:
                    _append(ids, more, text, a, b, tokens)
                else:
                    ids += more
        at = end
    return bytes(ids)


def _id_lists(encoded: list) -> pa.Array:
    offsets = np.concatenate([[0], np.cumsum([len(e) // 4 for e in encoded])]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.frombuffer(b"".join(encoded), "<i4")))


def _portioned(batches):
    """Batches in portions of bounded size, each with the texts of its column `text`."""
    for batch in batches:
        at = 0
        for texts in bytes_by_portions(batch.column("text")):
            for first, last in portions(texts):
                yield batch.slice(at + first, last - first), texts[first:last]
            at += len(texts)


def _hashes(batches):
    for _, texts in _portioned(batches):
        found = [chunk_digests(t)[2] for t in texts]
        yield pa.record_batch([pa.array(np.concatenate(found).view(np.int64))], ["hash"])


def encode_texts(df: DataFrame, tokenizer: str, text="text", into="ids", bits=BITS, of_ids=None, keep_text=True) -> DataFrame:
    """`df` with the token ids of each whole text in `into` (`array<int>`), without special tokens added.

    `tokenizer` is the file of a tokenizer that every executor can open. The ids are those
    of the tokenizer on the whole text. Null, empty and blank texts have no ids. Repeated
    rows have the same ids. All other columns stay; one named like `into` is replaced.
    No rows: no rows. Texts are read three times: chunks counted, texts without and
    texts with shared chunks encoded.

    With `of_ids`, a pair of a type and a function from a list of id arrays to an Arrow
    array (`digests_of`), `into` holds what it makes of the ids, in the task that has them.
    Without `keep_text` the texts stay away from the result.
    """
    kind, finished = (T.ArrayType(T.IntegerType()), _id_lists) if of_ids is None else (of_ids[0], lambda e: of_ids[1]([np.frombuffer(i, "<i4") for i in e]))
    spark = df.sparkSession
    names = [n for n in df.columns if n != into]
    rows = df.select(F.struct(F.lit(0).alias(""), *[F.col(f"`{n}`") for n in names if n != text]).alias("row"), F.col(f"`{text}`").alias("text"))
    if rows.schema["text"].dataType != T.StringType():
        rows = rows.withColumn("text", F.col("text").cast("string"))
    given = rows.schema.names if keep_text else ["row"]
    with_ids = T.StructType([*[rows.schema[n] for n in given], T.StructField("ids", kind)])
    with_key = T.StructType([*rows.schema.fields, T.StructField("key", T.BinaryType())])

    hashes = rows.select("text").mapInArrow(_hashes, "hash long")
    shared = materialise(hashes.groupBy("hash").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("hash"), "shared-chunks")
    members = spark.sparkContext.broadcast(bitmap_of(shared, bits))

    def known_in(value):
        """`(start, end, digest)` of the chunks that may be shared."""
        ends, digests, numbers = chunk_digests(value)
        if not ends:
            return []
        return [((0, *ends)[i], ends[i], digests[i]) for i in np.flatnonzero(possible(members.value, numbers)).tolist()]

    def without_shared(batches):
        for part, texts in _portioned(batches):
            alone = [i for i, t in enumerate(texts) if not known_in(t)]
            if alone:
                made = finished([_tokens(tokenizer).encode(texts[i]) for i in alone])
                kept = part.select(given).take(pa.array(alone, pa.int32()))
                yield pa.record_batch([*kept.columns, made], with_ids.names)

    def with_shared(batches):
        for part, texts in _portioned(batches):
            some = [i for i, t in enumerate(texts) if known_in(t)]
            kept = part.take(pa.array(some, pa.int32()))
            yield pa.record_batch([*kept.columns, pa.array([xxhash.xxh3_128_digest(texts[i]) for i in some], pa.binary())], with_key.names)

    def chunk_texts(batches):
        seen = set()
        for _, texts in _portioned(batches):
            out = {}
            for value in texts:
                for start, end, key in known_in(value):
                    if key not in seen:
                        if len(seen) >= MOST_SEEN:
                            seen.clear()
                        seen.add(key)
                        out[key] = value[start:end]
            yield pa.record_batch([pa.array(out, pa.binary()), pa.array(out.values(), pa.binary())], ["digest", "text"])

    def encoded_chunks(batches):
        for part, texts in _portioned(batches):
            ids = pa.array([_tokens(tokenizer).encode(t) for t in texts], pa.binary())
            yield pa.record_batch([part.column("digest"), ids], ["digest", "ids"])

    def places_of_chunks(batches):
        for part, texts in _portioned(batches):
            found = [(key, *k) for key, t in zip(part.column("key").to_pylist(), texts) for k in known_in(t)]
            yield pa.RecordBatch.from_pylist([dict(zip(places.names, f)) for f in found], places)

    places = pa.schema([("key", pa.binary()), ("start", pa.int32()), ("end", pa.int32()), ("digest", pa.binary())])

    def joined(batches):
        for part, texts in _portioned(batches):
            out, chunks = [], part.column("chunks")
            for i, value in enumerate(texts):
                known = sorted((k["start"], k["end"], k["ids"]) for k in chunks[i].as_py() or [])
                out.append(put_together(value, known, _tokens(tokenizer)))
            yield pa.record_batch([*part.select(given).columns, finished(out)], with_ids.names)

    alone = rows.mapInArrow(without_shared, with_ids)
    marked = materialise(rows.mapInArrow(with_shared, with_key), "texts-with-shared-chunks")
    # each shared chunk is encoded once ...
    chunks = marked.select("text").mapInArrow(chunk_texts, "digest binary, text binary")
    chunks = chunks.groupBy("digest").agg(F.first("text").alias("text"))
    chunks = materialise(chunks.mapInArrow(encoded_chunks, "digest binary, ids binary"), "encoded-chunks")
    # ... and goes to the texts in which it stands; equal texts ask for it once
    asked = marked.select("key", "text").mapInArrow(places_of_chunks, "key binary, start int, end int, digest binary").distinct()
    by_text = asked.join(chunks, "digest").groupBy("key").agg(F.collect_list(F.struct("start", "end", "ids")).alias("chunks"))
    by_text = materialise(by_text, "chunks-of-texts")  # so that copies of one text are split over tasks in the join
    together = marked.join(by_text, "key", "left").select("row", "text", "chunks").mapInArrow(joined, with_ids)

    back = [F.col("text").cast(df.schema[n].dataType).alias(n) if n == text else F.col(f"row.`{n}`") for n in names if n != text or keep_text]
    return alone.unionByName(together).select(*back, F.col("ids").alias(into))


def _mapped_ids(df, ids, into, kind, values):
    """`df` with one more column, made in portions of bounded size from the ids of each row."""
    names = [n for n in df.columns if n != into]
    rows = df.select(F.struct(F.lit(0).alias(""), *[F.col(f"`{n}`") for n in names if n != ids]).alias("row"), F.col(f"`{ids}`").cast("array<int>").alias("ids"))
    made = T.StructType([*rows.schema.fields, T.StructField("made", kind)])

    def run(batches):
        for batch in batches:
            sizes = [range(n or 0) for n in pc.list_value_length(batch.column("ids")).to_pylist()]
            for first, last in portions(sizes, 1 << 18):
                part = batch.slice(first, last - first)
                column = part.column("ids")
                flat, offsets, known = column.values.to_numpy(), column.offsets.to_numpy(), column.is_valid().to_pylist()
                lists = [flat[a:b] if k else None for a, b, k in zip(offsets, offsets[1:], known)]
                yield pa.record_batch([*part.columns, values(lists)], made.names)

    out = rows.mapInArrow(run, made)
    back = [F.col("ids").cast(df.schema[n].dataType).alias(n) if n == ids else F.col(f"row.`{n}`") for n in names if n != into]
    return out.select(*back, F.col("made").alias(into))


def decode_ids(df: DataFrame, tokenizer: str, ids="ids", into="decoded") -> DataFrame:
    """`df` with the decoded text of the ids in `into`, special tokens included.

    Null ids give null, no ids an empty text. All other columns stay; one named like
    `into` is replaced.
    """

    def decoded(lists):
        return pa.array([None if i is None else _decoder(tokenizer).decode(i) for i in lists], pa.string())

    return _mapped_ids(df, ids, into, T.StringType(), decoded)


_DIGESTS = T.StructType([T.StructField("n", T.LongType()), T.StructField("ids", T.StringType()), T.StructField("decoded", T.StringType())])


def digests_of(tokenizer: str) -> tuple:
    """Type and function (for `encode_texts`) of a struct of the number of ids, and SHA-256 of
    their decimal list and of their decoded text; texts as in `decode_ids`."""

    def digests(lists):
        decoder, rows = _decoder(tokenizer), []
        for i in lists:
            told = None
            if i is not None:
                told = {"n": len(i), "ids": sha256(decoder.listed(i)).hexdigest(), "decoded": sha256(decoder.decode(i).encode()).hexdigest()}
            rows.append(told)
        return pa.array(rows, pa.struct([("n", pa.int64()), ("ids", pa.string()), ("decoded", pa.string())]))

    return _DIGESTS, digests


def digest_ids(df: DataFrame, tokenizer: str, ids="ids", into="digests") -> DataFrame:
    """`df` with the digests of `digests_of` in `into`; decoded texts need not leave the task for that."""
    return _mapped_ids(df, ids, into, *digests_of(tokenizer))
