"""Spelling variants: words that differ by one code point, grouped under their frequent form.

PartEnum: a word is the multiset of its letters, a binary vector with a dimension for
each letter's first, second, ... occurrence. One inserted or deleted code point changes
one dimension, a replaced one changes two, so near words have a Hamming distance of at
most two. The dimensions are dealt to five parts; two differing dimensions lie in at
most two of them, so of the ten ways to leave out two parts one leaves equal vectors:
ten signatures of a word, of which near words share one exactly.

The order of letters, which the multiset forgets, makes the signatures sharper: near
words also agree in their first or their last half (half of the shorter word), so the
half is a part of the key. Words with equal keys are joined and verified.
"""

import zlib
from collections import Counter, defaultdict
from itertools import combinations
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from prefboard.llm.texts import as_bytes
from prefboard.session import materialise

PARTS, DISTANCE = 5, 2
MIN_LENGTH, MIN_COUNT = 6, 5
#: A form occurs at least so many times as often as its variant.
MUCH_MORE = 5
#: Of so many occurrences, as a hash of row and word deals them, one loses a code point.
DELETE_ONE_IN = 199
#: Words a task holds before it sends their counts on.
MOST_HELD = 300_000

_RUN = re.compile("[A-Za-zÀ-ÿ]+")
_LEFT_OUT = list(combinations(range(PARTS), DISTANCE))


def damaged(word: str, hashed: int) -> str:
    """`word` without the code point that its hash points at."""
    at = hashed % len(word)
    return word[:at] + word[at + 1 :]


def _counted(delete_one_in):
    def count(batches):
        held = defaultdict(int)
        for batch in batches:
            for row_id, text in zip(batch.column(0).to_pylist(), as_bytes(batch.column(1))):
                start = zlib.crc32(f"{'' if row_id is None else row_id}:".encode())
                for word, n in Counter(_RUN.findall(text.lower().decode())).items():
                    if delete_one_in:
                        hashed = zlib.crc32(word.encode(), start)
                        if hashed % delete_one_in == 0:
                            word = damaged(word, hashed)
                    held[word] += n
                if len(held) > MOST_HELD:
                    yield _count_batch(held)
                    held.clear()
        if held:
            yield _count_batch(held)

    return count


def _count_batch(held):
    return pa.record_batch([pa.array(held, pa.string()), pa.array(held.values(), pa.int64())], ["word", "n"])


def count_words(
    df: DataFrame, text="text", row_id="doc_id", min_length=MIN_LENGTH, min_count=MIN_COUNT, delete_one_in=DELETE_ONE_IN
) -> DataFrame:
    """`word, n`: maximal runs of Latin letters, A-Z lower-cased, with their occurrences in all texts.

    With `delete_one_in`, a word of a row loses one code point when that number divides
    the CRC-32 of `<row_id>:<word>`; a null id counts as an empty text there. Words of
    fewer than `min_length` code points or `min_count` occurrences are left out. Null
    and empty texts have no words; repeated rows count each. Other columns are not read.
    """
    rows = df.select(F.col(row_id).cast("string"), F.col(text).cast("string"))
    counts = rows.mapInArrow(_counted(delete_one_in), "word string, n long").where(F.char_length("word") >= min_length)
    return counts.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= min_count)


def _mixed(x):
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def signature_keys(words: list) -> list:
    """Keys of each word, as an array of 64-bit numbers; near words share at least one."""
    if not words:
        return []
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    letters = np.frombuffer("".join(words).encode("utf-32-le"), "<u4").astype(np.uint64)
    owner = np.repeat(np.arange(len(words)), lengths)
    starts = np.cumsum(lengths) - lengths
    place = np.arange(len(letters)) - starts[owner]

    # dimension: a letter and how often it stood in the word before
    order = np.lexsort((letters, owner))
    first = np.ones(len(order), bool)
    first[1:] = (letters[order][1:] != letters[order][:-1]) | (owner[order][1:] != owner[order][:-1])
    at = np.arange(len(order))
    before = np.empty(len(order), np.int64)
    before[order] = at - np.maximum.accumulate(np.where(first, at, 0))
    dimension = _mixed((letters << np.uint64(32) | before.astype(np.uint64)) + np.uint64(1))
    part = _mixed(dimension + np.uint64(5)) % np.uint64(PARTS)

    def by_word(values):
        return np.add.reduceat(values, starts)

    zero = np.uint64(0)
    of_part = [by_word(np.where(part == p, dimension, zero)) for p in range(PARTS)]
    whole = sum(of_part[1:], of_part[0])

    def half(of_length, from_end):
        counted = lengths[owner] - 1 - place if from_end else place
        shown = _mixed(letters << np.uint64(32) | counted.astype(np.uint64))
        inside = counted < of_length[owner]
        return _mixed(by_word(np.where(inside, shown, zero)) + (of_length * 2 + from_end).astype(np.uint64))

    # half of the shorter word: of its own length, and of one code point less
    own, less = lengths // 2, (lengths - 1) // 2
    columns = []
    for number, (a, b) in enumerate(_LEFT_OUT):
        rest = _mixed(whole - of_part[a] - of_part[b] + np.uint64(number))
        for from_end in (0, 1):
            columns += [_mixed(rest + half(own, from_end)), _mixed(rest + half(less, from_end))]
    keys = np.stack(columns, axis=1).view(np.int64)
    # both halves are one where the length is odd
    return [row if n % 2 == 0 else row[::2] for row, n in zip(keys, lengths.tolist())]


@F.arrow_udf(returnType=T.ArrayType(T.LongType()))
def _keys(word: pa.Array) -> pa.Array:
    return pa.array(signature_keys(word.to_pylist()), pa.list_(pa.int64()))


def near_pairs(words: DataFrame) -> DataFrame:
    """`u, u_n, v, v_n` of all distinct words `word, n` that differ by one code point; `u < v`.

    Words must be distinct and not empty.
    """
    rows = materialise(words.select("word", "n", F.explode(_keys.asNondeterministic()("word")).alias("key")), "spelling-keys")
    left = rows.select("key", F.col("word").alias("u"), F.col("n").alias("u_n"))
    right = rows.select("key", F.col("word").alias("v"), F.col("n").alias("v_n"))
    same_key = left.join(right, "key").where(F.col("u") < F.col("v"))
    verified = same_key.where(F.levenshtein("u", "v", 1) == 1)
    return verified.select("u", "u_n", "v", "v_n").distinct()


def _roots(words: DataFrame) -> DataFrame:
    """`word, root` of the words that have a form: the end of the chain of forms.

    A form occurs several times as often as its variant, so there are no circles and
    chains are short. Every round doubles how far a word sees.
    """
    known = materialise(words.where("form is not null").select("word", F.col("form").alias("root")), "spelling-forms")
    while True:
        further = known.select(F.col("word").alias("root"), F.col("root").alias("next"))
        joined = known.join(further, "root", "left")
        longer = materialise(joined.select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")), "spelling-roots")
        if longer.where("moved").isEmpty():
            return longer.select("word", "root")
        known = longer.select("word", "root")


def spelling_variants(words: DataFrame, much_more=MUCH_MORE) -> DataFrame:
    """`word, form, root, n, n_near, form_n` of every row of `words` (`word, n`).

    Two words are near if they differ by one inserted, deleted or replaced code point;
    `n_near` counts them. `form` is the most frequent near word (of equal ones the first
    in code-point order) if it occurs at least `much_more` times as often, else null;
    `root` is where the chain of forms ends, the word itself if it has none. Words must
    be distinct; no words: no rows. Other columns are not read.
    """
    words = materialise(words.select("word", "n"), "spelling-words")
    pairs = materialise(near_pairs(words), "spelling-pairs")

    def side(a, b):
        return F.struct(F.col(a).alias("word"), F.col(b).alias("other"), F.col(f"{b}_n").alias("other_n"))

    sides = pairs.select(F.inline(F.array(side("u", "v"), side("v", "u"))))
    best = F.min(F.struct((-F.col("other_n")).alias("less"), "other"))
    near = sides.groupBy("word").agg(F.count(F.lit(1)).alias("n_near"), best.alias("best"))
    is_form = -F.col("best.less") >= F.col("n") * much_more
    told = words.join(near, "word", "left").select(
        "word",
        "n",
        F.coalesce("n_near", F.lit(0)).alias("n_near"),
        F.when(is_form, F.col("best.other")).alias("form"),
        F.when(is_form, -F.col("best.less")).alias("form_n"),
    )
    told = materialise(told, "spelling-near")
    rooted = told.join(_roots(told), "word", "left")
    return rooted.select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
