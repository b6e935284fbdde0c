"""Documents packed into sequences of a fixed number of tokens: best two fit.

A sequence is filled greedily with the longest piece that still fits. Then its
smallest piece is replaced by two unpacked pieces, when two together fit the gap
that it leaves more tightly than it did.

The choice of pieces depends on lengths alone, so it is made on the histogram of
lengths, which has at most `capacity` entries however many documents there are:
while no length it uses runs out, the same filling repeats, and is taken as many
times as the counts allow. The result is a plan of a few thousand fillings. Every
piece then finds its place in the plan from its number among pieces of its length.
"""

import re
import zlib
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from prefboard.llm.texts import each_as_bytes, in_use, lookup_table
from prefboard.session import materialise

CAPACITY = 2048
RANK_PARTS = 64
MAX_CACHED_PARTS = 100_000

PIECES = T.ArrayType(
    T.StructType(
        [
            T.StructField("piece", T.IntegerType(), False),
            T.StructField("start", T.LongType(), False),
            T.StructField("length", T.LongType(), False),
            T.StructField("ids_crc32", T.LongType(), False),
        ]
    ),
    False,
)
_ARROW_PIECES = pa.list_(
    pa.struct([("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64())])
)


_LETTERS = "A-Za-z\xc0-\xd6\xd8-\xf6\xf8-\xff"
#: Parts that the tokenizer cuts into runs of Latin letters, digits and runs of ASCII signs:
#: letters that every normal form keeps, no apostrophe, no mark of a special token.
_PLAIN = re.compile(f"[{_LETTERS}!-&(-;=-@\\[-`{{-~]+").fullmatch
_runs = re.compile(f"[{_LETTERS}]+|[0-9]|[^{_LETTERS}0-9]+").findall


class _PartIds(dict):
    """Token ids of a blank-separated part as little-endian 32-bit bytes.

    Runs of plain parts go straight to the tokenizer's merges; any other part goes
    through the whole tokenizer. New parts wait apart until they are asked for
    again, so that the many rare ones do not drive out the frequent ones.
    """

    #: Runs of signs kept, and bytes of one at most.
    SIGNS, LONGEST_SIGNS = 4096, 8

    def __init__(self, tokenizer, most):
        self._tokenizer, self._model, self._most = tokenizer, tokenizer.model, most
        self._new, self._signs = {}, {}
        # a byte-level tokenizer shows printable bytes as themselves, others from 256 on
        shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
        hidden = iter(range(256, 512))
        self._letters = "".join(chr(b) if b in shown else chr(next(hidden)) for b in range(256))

    def __bool__(self):
        return bool(len(self) or self._new)

    def clear(self):
        super().clear()
        self._new.clear()

    def __missing__(self, part):
        ids = self._new.pop(part, None)
        if ids is not None:
            if len(self) >= self._most:
                super().clear()
            self[part] = ids
            return ids
        ids = self._made(part)
        if len(self._new) >= self._most // 2:
            self._new.clear()
        self._new[part] = ids
        return ids

    def _made(self, part):
        if part.isalpha():
            return self._merged(part.decode().lower())
        text = part.decode()
        if not text:
            return b""
        if not _PLAIN(text):
            return np.array(self._tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()
        return b"".join([self._of_word(run) if run[0].isalpha() else self._of_signs(run) for run in _runs(text.lower())])

    def _of_word(self, run):
        ids = self.get(run.encode())
        return self._merged(run) if ids is None else ids

    def _of_signs(self, run):
        ids = self._signs.get(run)
        if ids is None:
            ids = self._merged(run)
            if len(run) <= self.LONGEST_SIGNS and len(self._signs) < self.SIGNS:
                self._signs[run] = ids
        return ids

    def _merged(self, run):
        shown = run if run.isascii() else run.encode().decode("latin-1").translate(self._letters)
        return b"".join([t.id.to_bytes(4, "little") for t in self._model.tokenize(shown)])


class WordTokenizer:
    """Token ids as little-endian 32-bit bytes, kept for each blank-separated part.

    For byte-level tokenizers that lower-case, drop white space and never join
    across it: a text's ids are then those of its lower-cased parts in turn. At most
    `most` parts that came again are kept, and half as many new ones.
    """

    def __init__(self, path, most=MAX_CACHED_PARTS):
        from tokenizers import Tokenizer

        self._parts = lookup_table(_PartIds(Tokenizer.from_file(path), most))

    def encode(self, text: bytes) -> bytes:
        parts = text if b"<|" in text else text.lower()  # special tokens are matched before anything else
        return b"".join(map(in_use(self._parts).__getitem__, parts.replace(b"\n", b" ").split(b" ")))


@lru_cache(1)
def _tokenizer(path):
    return WordTokenizer(path)


def cut_pieces(ids: bytes, capacity: int) -> list:
    """`(piece, start, length, crc32)` of a document's ids; only long ones are cut."""
    total = len(ids) // 4
    out = []
    for piece, start in enumerate(range(0, total, capacity)):
        length = min(capacity, total - start)
        out.append((piece, start, length, zlib.crc32(ids[4 * start : 4 * (start + length)])))
    return out


def tokenize_pieces(df: DataFrame, tokenizer: str, capacity=CAPACITY, text="text", row_id="doc_id") -> DataFrame:
    """`row_id, piece, start, length, ids_crc32`: one row per piece of a document."""

    @F.arrow_udf(returnType=PIECES)
    def pieces(column: pa.Array) -> pa.Array:
        encode = _tokenizer(tokenizer).encode
        names = ("piece", "start", "length", "ids_crc32")
        rows = []
        for value in each_as_bytes(column):
            ids = encode(value) + bytes(4)
            rows.append([dict(zip(names, p)) for p in cut_pieces(ids, capacity)])
        return pa.array(rows, _ARROW_PIECES)

    cut = df.select(F.col(row_id), pieces.asNondeterministic()(F.col(text).cast("string")).alias("__p"))
    return cut.select(row_id, F.inline("__p"))


def best_two_fit(counts: dict, capacity: int) -> list:
    """Fillings `(times, [(length, how many)])` that use up all counts.

    Equals packing one sequence after the other, since a filling can only change
    when a length it uses has too few pieces left.
    """
    left = np.zeros(capacity + 1, np.int64)
    for length, count in counts.items():
        left[length] = count
    plan = []
    while left.any():
        filling = _fill(left, capacity)
        times = min(int(left[length]) // many for length, many in filling.items())
        for length, many in filling.items():
            left[length] -= many * times
        plan.append((times, sorted(filling.items(), reverse=True)))
    return plan


def _fill(left, capacity):
    """One sequence: lengths and how many of each."""
    have = np.flatnonzero(left)
    filling, gap = {}, capacity
    while gap:
        fitting = have[: np.searchsorted(have, gap, "right")]
        fitting = fitting[left[fitting] > [filling.get(int(x), 0) for x in fitting]] if len(filling) else fitting
        if not len(fitting):
            break
        longest = int(fitting[-1])
        many = min(gap // longest, int(left[longest]) - filling.get(longest, 0))
        filling[longest] = filling.get(longest, 0) + many
        gap -= longest * many
    if gap:
        smallest = min(filling)
        filling[smallest] -= 1
        pair = _two_for(left, filling, gap + smallest)
        if pair and sum(pair) > smallest:
            for length in pair:
                filling[length] = filling.get(length, 0) + 1
        else:
            filling[smallest] += 1
        filling = {length: many for length, many in filling.items() if many}
    return filling


def _two_for(left, filling, room):
    """Two lengths with the largest sum of at most `room` among unpacked pieces."""
    free = left.copy()
    for length, many in filling.items():
        free[length] -= many
    have = np.flatnonzero(free > 0)
    best, low, high = None, 0, len(have) - 1
    while low <= high:
        pair = int(have[low]) + int(have[high])
        if pair > room:
            high -= 1
            continue
        if (low < high or free[have[low]] > 1) and (best is None or pair > sum(best)):
            best = (int(have[low]), int(have[high]))
            if pair == room:
                break
        low += 1
    return best


def _places(plan):
    """Per length, where runs of piece numbers begin and what place they have.

    `{length: (first number, first sequence, pieces in a sequence, first offset)}`
    """
    places, taken, sequence = {}, {}, 0
    for times, filling in plan:
        offset = 0
        for length, many in filling:
            number = taken.get(length, 0)
            places.setdefault(length, []).append((number, sequence, many, offset))
            taken[length] = number + many * times
            offset += length * many
        sequence += times
    return {length: np.array(rows, np.int64).T for length, rows in places.items()}


def pack_pieces(pieces: DataFrame, capacity=CAPACITY, keys=("doc_id", "piece")) -> DataFrame:
    """`pieces` with `sequence_id` and `offset`; `length` says how many tokens each has.

    `pieces` is read three times, so it should be a written table. Numbers within a
    length come from counts in 64 parts, so no task orders all pieces of one length.
    """
    parted = pieces.withColumn("__part", F.pmod(F.xxhash64(*keys), F.lit(RANK_PARTS)).cast("int"))
    counts = parted.groupBy("length", "__part").agg(F.count(F.lit(1)).alias("__n"))
    before = F.sum("__n").over(W.partitionBy("length").orderBy("__part").rowsBetween(W.unboundedPreceding, -1))
    # at most capacity x 64 rows
    starts = F.broadcast(counts.select("length", "__part", F.coalesce(before, F.lit(0)).alias("__before")))
    sizes = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}
    places = _places(best_two_fit(sizes, capacity))

    number = F.row_number().over(W.partitionBy("length", "__part").orderBy(*keys, "start", "ids_crc32"))
    numbered = (
        parted.withColumn("__row", number)
        .join(starts, ["length", "__part"])
        .withColumn("__number", F.col("__before") + F.col("__row") - 1)
        .drop("__part", "__before", "__row")
    )

    @F.arrow_udf(returnType="sequence_id long, offset long")
    def place(lengths: pa.Array, numbers: pa.Array) -> pa.Array:
        sizes, n = lengths.to_numpy(), numbers.to_numpy()
        sequence, offset = np.zeros(len(n), np.int64), np.zeros(len(n), np.int64)
        for size in np.unique(sizes):
            of = sizes == size
            first, start, many, at = places[int(size)]
            run = np.searchsorted(first, n[of], "right") - 1
            within = n[of] - first[run]
            sequence[of] = start[run] + within // many[run]
            offset[of] = at[run] + within % many[run] * size
        return pa.StructArray.from_arrays([pa.array(sequence), pa.array(offset)], ["sequence_id", "offset"])

    placed = numbered.withColumn("__place", place(F.col("length"), F.col("__number")))
    return placed.select(*pieces.columns, "__place.sequence_id", "__place.offset")


def pack_documents(df: DataFrame, tokenizer: str, capacity=CAPACITY, text="text", row_id="doc_id") -> DataFrame:
    """Pieces of all documents with the sequence and the offset of each.

    A document is its token ids and an id 0 behind; null and empty texts are that
    one id. Repeated rows are packed each. No rows: no rows. Other columns are not
    read. Texts are read once; what is written and moved has one row per piece.
    """
    pieces = materialise(tokenize_pieces(df, tokenizer, capacity, text, row_id), "pieces")
    return pack_pieces(pieces, capacity, (row_id, "piece"))
