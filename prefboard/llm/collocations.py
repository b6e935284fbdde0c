"""Phrases whose words stand together, from an FM-index per shard over word ids.

A task gathers texts to a shard, a sequence of word ids with a separator behind every
piece, and indexes it in both directions: rows are sorted by the words that follow
(precede) a place, up to the depth wanted, and hold the word on the other side, the
Burrows-Wheeler transform. All occurrences of a phrase are one interval of rows in
each index. One word to the left or right splits an interval into those of the longer
phrases, in both indexes at once; the widths are the counts in this shard. Phrases are
grown from words, to the right and to the left in turn, and counts are added up over
shards.

A phrase cannot occur often when two or three neighbouring words of it do not. So words
and pairs, and then triples of frequent pairs, are counted first, and a bitmap of fixed
size tells the shards which of them are frequent somewhere; what is not is not grown
further. The bitmap may let
others through, whose true counts then drop them.

Word ids are 64-bit hashes of language and word, the same in every shard.
"""

from collections import Counter

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from prefboard.llm.bitmap import BITS, bitmap_of, possible
from prefboard.llm.texts import as_bytes, bytes_by_portions, portions
from prefboard.session import materialise, text_batches

LONGEST, MIN_COUNT, TOP = 4, 30, 2000
#: Per cent of a phrase's occurrences inside a longer one from which it is dropped.
INSIDE = 80
SCALE = 2_000_000
NO_LANGUAGE = "und"
#: Places of a shard; one text of more is a shard of its own.
SHARD = 3 << 18
#: Bytes of the texts added to a shard at a time.
PORTION = 1 << 19

_SEPARATORS = b".,;:!?\n\x0b\x0c\r"
_END = b"\xff"  # in no UTF-8 text
_READ = bytearray(bytes(range(256)).lower())
_READ[9] = 0x20
for _byte in _SEPARATORS:
    _READ[_byte] = 0xFF
_READ = bytes(_READ)

_U = np.uint64


def piece_words(text: bytes) -> list:
    """Lower-cased (A-Z) words `[^\\x20\\x09]+` of a text, `_END` behind every piece."""
    words = text.translate(_READ).replace(_END, b" \xff ").split(b" ")
    return [w for w in words if w] + [_END]


def pair_hashes(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    x = left * _U(0x9E3779B97F4A7C15) + right
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def triple_hashes(first, second, third) -> np.ndarray:
    return pair_hashes(pair_hashes(first, second), third)


def _listed(words: pa.Array) -> list:
    """The values of a binary column from its buffers, which is faster than one by one."""
    offsets, data = np.frombuffer(words.buffers()[1], np.int32)[words.offset :], words.buffers()[2]
    data, at = data.to_pybytes() if data else b"", offsets[: len(words) + 1].tolist()
    return [data[a:b] for a, b in zip(at, at[1:])]


class Shard:
    """Texts as local word numbers, 0 between pieces, with what the numbers stand for."""

    def __init__(self):
        self._languages, self._of, self._words, self.size = {}, [], [], 0

    def add(self, languages: list, texts: list):
        """A portion of texts with the language of each; words stay in Arrow columns."""
        marked = [t.translate(_READ).replace(b"\xff ", _END).replace(_END, b" \xff ") + b" \xff" for t in texts]
        split = pc.split_pattern(pa.array(marked, pa.binary()), b" ")
        of = [self._languages.setdefault(language, len(self._languages)) for language in languages]
        self._of.append(np.repeat(np.array(of, np.int32), np.diff(split.offsets.to_numpy())))
        self._words.append(split.flatten())
        self.size += len(self._of[-1])

    def closed(self):
        """`(places, languages, words, ids)`; the last three by number, from 1 on."""
        encoded = pa.chunked_array(self._words).dictionary_encode()
        words = _listed(encoded.chunk(0).dictionary)
        word = np.concatenate([c.indices.to_numpy() for c in encoded.chunks])
        keys = np.concatenate(self._of) * np.int64(len(words)) + word + 1
        keys[word == words.index(_END)] = 0
        if b"" in words:  # between two blanks
            keys = keys[word != words.index(b"")]
        highest = len(self._languages) * len(words)
        if highest <= 8 * len(keys):
            seen = np.zeros(highest + 1, bool)
            seen[keys] = True
            named, places = np.flatnonzero(seen), (np.cumsum(seen) - 1)[keys]
        else:
            named, places = np.unique(keys, return_inverse=True)
        named = named[1:] - 1  # the first is the separator
        known, languages = list(self._languages), (named // len(words)).tolist()
        names = [words[at] for at in (named % len(words)).tolist()]
        seeds = [xxhash.xxh3_64_intdigest(language) for language in known]
        ids = np.zeros(len(names) + 1, np.uint64)
        ids[1:] = [xxhash.xxh3_64_intdigest(name, seeds[language]) or 1 for language, name in zip(languages, names)]
        return np.append(0, places), [known[language] for language in languages], names, ids


def shards_of(batches, size=None):
    """Shards of a task's rows `language, text`."""
    shard, most = Shard(), size or SHARD
    for batch in batches:
        languages, at = as_bytes(batch.column(0)), 0
        for texts in bytes_by_portions(batch.column(1)):
            for first, last in portions(texts, min(most, PORTION)):
                shard.add(languages[at + first : at + last], texts[first:last])
                if shard.size >= most:
                    yield shard.closed()
                    shard = Shard()
            at += len(texts)
    if shard.size:
        yield shard.closed()


def _grouped(keys):
    """`(order, starts, counts)` of equal keys."""
    order = np.argsort(keys)
    keys = keys[order]
    starts = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.zeros(0, np.int64)
    return order, starts, np.diff(np.append(starts, len(keys)))


class Direction:
    """FM-index of a sequence for phrases of up to four words (`LONGEST`).

    Rows are places sorted by the words from there on, so that a phrase is an interval
    of rows; `before` is the word in front of each row and `moved` the row of that word
    (last-to-first mapping). `first[w]` is the first row that starts with w.
    """

    def __init__(self, places, words):
        n = len(places)
        following = np.append(places[1:], 0)
        pairs = places * (words + 1) + following
        order, starts, counts = _grouped(pairs)
        rank = np.empty(n, np.int64)
        rank[order] = np.repeat(np.arange(len(starts)), counts)
        later = np.append(rank[2:], [0, 0])[:n]
        rows = np.argsort(rank * len(starts) + later)
        self.before = places[rows - 1]  # in front of the first place stands the last one, 0
        row_of = np.empty(n, np.int64)
        row_of[rows] = np.arange(n)
        self.moved = row_of[rows - 1]
        self.first = np.concatenate([[0], np.cumsum(np.bincount(places, minlength=words + 1))])

    def split(self, low, width):
        """Intervals `low, width` split by the word in front.

        Returns per part: the interval it comes from, the word, its first row here, its
        width, and how many rows of the interval have a smaller word in front.
        """
        offset = np.cumsum(width) - width
        owner = np.repeat(np.arange(len(low)), width)
        rows = np.arange(int(width.sum())) - offset[owner] + low[owner]
        front = self.before[rows]
        order, starts, counts = _grouped(owner * len(self.first) + front)
        parent, word = owner[order[starts]], front[order[starts]]
        moved = np.minimum.reduceat(self.moved[rows[order]], starts) if len(starts) else starts
        smaller = starts - offset[parent]
        some = word > 0
        return parent[some], word[some], moved[some], counts[some], smaller[some]


class TwoWayIndex:
    """FM-indexes of a shard and of its reversal, and phrases with their two intervals.

    Phrases are a matrix of word numbers with the first row of their interval in either
    index and its width.
    """

    def __init__(self, places, words):
        self.forward, self.backward = Direction(places, words), Direction(places[::-1], words)
        self._words = words

    def words(self):
        at = self.forward.first[1 : self._words + 1]
        width = np.diff(self.forward.first)[1:]
        return np.arange(1, self._words + 1)[:, None], at, at.copy(), width

    def extend(self, phrases, left: bool):
        """All phrases of one more word, on the left or on the right."""
        words, low, low_back, width = phrases
        index, own, other = (self.forward, low, low_back) if left else (self.backward, low_back, low)
        parent, word, moved, count, smaller = index.split(own, width)
        # in the other index they stay inside the interval, in the order of the new word
        within = other[parent] + smaller
        longer = np.column_stack([word, words[parent]] if left else [words[parent], word])
        return (longer, moved, within, count) if left else (longer, within, moved, count)


def _kept(phrases, which):
    return tuple(part[which] for part in phrases)


def frequent_phrases(places, ids, bitmap=None, longest=LONGEST, triples=False):
    """Yields `(word numbers, counts)` of the phrases of 1, 2, ... words of a shard.

    With a bitmap, only those whose words and neighbouring pairs may be in it, and
    with `triples` their neighbouring triples too.
    """
    n = len(ids) - 1
    if bitmap is not None:
        places = _only(places, ids, bitmap)
    index = TwoWayIndex(places, n)
    phrases = index.words()
    phrases = _kept(phrases, phrases[3] > 0)
    yield phrases[0], phrases[3]
    for length in range(2, longest + 1):
        left = length % 2 == 1
        phrases = index.extend(phrases, left)
        if bitmap is not None:
            new = ids[phrases[0][:, :3] if left else phrases[0][:, -3:]]  # words around the one that was added
            which = possible(bitmap, pair_hashes(*(new[:, :2] if left else new[:, -2:]).T))
            if triples and length > 2:
                which &= possible(bitmap, triple_hashes(*new.T))
            phrases = _kept(phrases, which)
        yield phrases[0], phrases[3]


def _hash_batch(hashes, counts):
    return pa.record_batch([pa.array(hashes.view(np.int64)), pa.array(counts)], ["hash", "n"])


def _only(places, ids, bitmap):
    """Places with one separator for any run of separators and words that are not in the bitmap."""
    kept = np.append(False, possible(bitmap, ids[1:])) if len(ids) > 1 else np.zeros(1, bool)
    some = kept[places]
    return np.where(some, places, 0)[some | np.append(True, some[:-1])]


def _word_and_pair_counts(batches):
    for places, _, _, ids in shards_of(batches):
        left, right = places[:-1], places[1:]
        both = (left > 0) & (right > 0)
        order, starts, counts = _grouped((left * len(ids) + right)[both])
        of = order[starts]
        pairs = pair_hashes(ids[left[both][of]], ids[right[both][of]])
        yield _hash_batch(np.append(ids[1:], pairs), np.append(np.bincount(places, minlength=len(ids))[1:], counts))


def _triple_counts(members):
    def count(batches):
        for places, _, _, ids in shards_of(batches):
            *_, (numbers, counts) = frequent_phrases(places, ids, members.value, 3)
            yield _hash_batch(triple_hashes(*ids[numbers].T), counts)

    return count


#: Rows of a shard: `n` occurrences of the words `w1` to `w4` (0 behind a shorter phrase),
#: with language and word where it is one word; all words of a language have no `w1`.
_COUNTS = "w1 long, w2 long, w3 long, w4 long, n long, lang binary, word binary"


def _phrase_counts(members, longest):
    def count(batches):
        for places, languages, words, ids in shards_of(batches):
            totals, per_word = Counter(), np.bincount(places, minlength=len(ids))[1:]
            for language, n in zip(languages, per_word.tolist()):
                totals[language] += n
            yield _count_batch(np.zeros((len(totals), 1), np.uint64), list(totals.values()), list(totals))
            for numbers, counts in frequent_phrases(places, ids, members.value, longest, triples=True):
                told = numbers[:, 0].tolist() if numbers.shape[1] == 1 else None
                for start in range(0, len(counts), 200_000):
                    part = slice(start, start + 200_000)
                    names = [] if told is None else [[of[i - 1] for i in told[part]] for of in (languages, words)]
                    yield _count_batch(ids[numbers[part]], counts[part], *names)

    return count


def _count_batch(ids, counts, *names):
    columns = np.zeros((len(ids), LONGEST), np.uint64)
    columns[:, : ids.shape[1]] = ids
    arrays = [pa.array(np.ascontiguousarray(columns[:, i]).view(np.int64)) for i in range(LONGEST)]
    texts = [pa.array(n, pa.binary()) for n in names] + [pa.nulls(len(ids), pa.binary())] * (2 - len(names))
    return pa.record_batch([*arrays, pa.array(counts, pa.int64()), *texts], ["w1", "w2", "w3", "w4", "n", "lang", "word"])


_WORDS = [f"w{i}" for i in range(1, LONGEST + 1)]


def _part(first, behind):
    """The words from number `first` to before `behind`, as the columns of a phrase."""
    columns = [F.col(w) for w in _WORDS[first:behind]]
    return [c.alias(w) for c, w in zip([*columns, *[F.lit(0).cast("long")] * LONGEST], _WORDS)]


def _exact(column):
    return (F.col(column) if isinstance(column, str) else column).cast("decimal(19,0)")


class Counts:
    """Counts of a corpus: `phrases` (`w1` to `w4, f`) that occur often enough, `words`
    (`id, lang, word`) in them, `totals` (`lang, n`)."""

    def __init__(self, df, text, lang, min_count, longest, bits):
        rows = df.select(F.coalesce(F.col(lang).cast("string"), F.lit(NO_LANGUAGE)), F.col(text).cast("string"))
        broadcast = df.sparkSession.sparkContext.broadcast

        def often(function, name):
            sums = rows.mapInArrow(function, "hash long, n long").groupBy("hash").agg(F.sum("n").alias("n"))
            with text_batches(df.sparkSession):
                found = materialise(sums.where(F.col("n") >= min_count).select("hash"), name)
            return bitmap_of(found, bits)

        pairs = often(_word_and_pair_counts, "frequent-pairs")
        members = broadcast(pairs | often(_triple_counts(broadcast(pairs)), "frequent-triples"))
        with text_batches(df.sparkSession):
            counts = materialise(rows.mapInArrow(_phrase_counts(members, longest), _COUNTS), "phrase-counts")
        summed = counts.where("w1 <> 0").groupBy(*_WORDS).agg(F.sum("n").alias("f"))
        self.phrases = materialise(summed.where(F.col("f") >= min_count), "frequent-phrases")
        text_of = lambda c: F.col(c).cast("string").alias(c)
        words = counts.where("word is not null").select(F.col("w1").alias("id"), text_of("lang"), text_of("word"))
        self.words = materialise(words.distinct(), "frequent-words")
        totals = counts.where("w1 = 0").groupBy("lang").agg(F.sum("n").alias("n"))
        self.totals = materialise(totals.select(text_of("lang"), "n"), "word-totals")


def _scored(phrases, longest, scale):
    """Phrases of two words and more as `w1` to `w4, a`, with `l, r, score` of their worst cut.

    All parts of all phrases are looked up in one join.
    """
    length = sum(((F.col(w) != 0).cast("int") for w in _WORDS[1:]), F.lit(1))
    cuts = [(n, cut) for n in range(2, longest + 1) for cut in range(1, n)]
    parts = {n: [] for n in range(2, longest + 1)}
    for n, cut in cuts:
        for side, first, behind in (("l", 0, cut), ("r", cut, n)):
            words = [c.alias(f"p{w}") for c, w in zip(_part(first, behind), _WORDS)]
            parts[n].append(F.struct(F.lit(f"{side}{cut}").alias("side"), *words))
    of_length = F.when(length == 2, F.array(*parts[2]))
    for n in range(3, longest + 1):
        of_length = of_length.when(length == n, F.array(*parts[n]))
    asked = phrases.where("w2 <> 0").select(*_WORDS, F.col("f").alias("a"), F.inline(of_length))
    known = phrases.select(*[F.col(w).alias(f"p{w}") for w in _WORDS], "f")
    found = asked.join(known, [f"p{w}" for w in _WORDS])
    sides = [F.max(F.when(F.col("side") == s, F.col("f"))).alias(s) for cut in range(1, longest) for s in (f"l{cut}", f"r{cut}")]
    counted = found.groupBy(*_WORDS, "a").agg(*sides)

    def of_cut(cut):
        left, right = F.col(f"l{cut}"), F.col(f"r{cut}")
        counted = f"(cast(l{cut} as decimal(19,0)) + cast(r{cut} as decimal(19,0)))"
        score = F.expr(f"(cast({scale} as decimal(10,0)) * cast(a as decimal(19,0))) div {counted}").cast("long")
        return F.when(left.isNotNull(), F.struct(score.alias("score"), F.lit(cut).alias("cut"), left.alias("l"), right.alias("r")))

    worst = F.array_min(F.array(*[of_cut(cut) for cut in range(1, longest)]))  # passes over nulls
    return counted.withColumn("worst", worst).select(*_WORDS, "a", "worst.l", "worst.r", "worst.score")


def _inside_longer(phrases, longest):
    """`w1` to `w4, most`: occurrences of the most frequent phrase with one word more."""
    sides = F.array(
        *[
            F.when(
                (F.col(_WORDS[n - 1]) != 0) & ((F.col(_WORDS[n]) == 0) if n < LONGEST else F.lit(True)),
                F.array(F.struct(*_part(0, n - 1)), F.struct(*_part(1, n))),
            )
            for n in range(3, longest + 1)
        ]
    )
    inner = phrases.where("w3 <> 0").select("f", F.explode(F.flatten(F.filter(sides, lambda s: s.isNotNull()))).alias("s"))
    return inner.select("s.*", "f").groupBy(*_WORDS).agg(F.max("f").alias("most"))


def _best(named, top):
    """The first `top` rows of every language: of partitions, of groups of these, of all."""
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    rows = named.withColumn("part", F.spark_partition_id())
    for keys in (["lang", "part"], ["lang", F.floor(F.col("part") / 64)], ["lang"]):
        rows = rows.withColumn("rank", F.row_number().over(W.partitionBy(*keys).orderBy(*order)).cast("long"))
        rows = rows.where(F.col("rank") <= top)
    return rows.drop("part")


def collocations(
    df: DataFrame, text="text", lang="lang", longest=LONGEST, min_count=MIN_COUNT, inside=INSIDE, top=TOP, scale=SCALE, bits=BITS
) -> DataFrame:
    """`lang, rank, phrase, a, l, r, n, score`: the best phrases of 2 to `longest` words (at most 4) per language.

    Pieces end at `[.,;:!?\\x0A-\\x0D]`; words are `[^\\x20\\x09]+` with A-Z lower-cased. A
    phrase that occurs `a` times, at least `min_count`, is cut where floor(scale * a /
    (l + r)) is smallest, l and r being the occurrences of its two parts (equal: after
    fewer words). It is dropped when `inside` per cent of `a` occurrences or more are inside
    a longer phrase; since all phrases between the two then are as frequent, one word more
    on either side tells. The first `top` of a language are kept, by score, `a` (both
    falling) and phrase. `n` is the number of words of the language; null languages are
    `und`, null texts have no words; repeated rows count each. Other columns are not read.
    """
    if not 2 <= longest <= LONGEST:
        raise ValueError(f"longest must be 2 to {LONGEST}")
    counts = Counts(df, text, lang, min_count, longest, bits)
    candidates = _scored(counts.phrases, longest, scale)
    if longest > 2:
        longer = _inside_longer(counts.phrases, longest)
        held = F.coalesce(_exact("most") * 100 >= _exact("a") * inside, F.lit(False))
        candidates = candidates.join(longer, _WORDS, "left").where(~held).drop("most")
    named = materialise(candidates, "phrase-candidates")
    for word in _WORDS:
        language = ["lang"] if word == "w1" else []
        names = counts.words.select(F.col("id").alias(word), F.col("word").alias(f"{word}_text"), *language)
        named = named.join(names, word, "inner" if word in ("w1", "w2") else "left")
    phrase = F.concat_ws(" ", *[f"{w}_text" for w in _WORDS])
    best = _best(named.select("lang", phrase.alias("phrase"), "a", "l", "r", "score"), top)
    return best.join(counts.totals, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
