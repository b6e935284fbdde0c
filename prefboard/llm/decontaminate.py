"""Benchmark passages in documents, by a generalised suffix automaton.

The automaton holds every run of consecutive words of the normalised test items.
A document's words are streamed through it; at each word it knows the longest run
that ends there and also stands in some item. A run of `window` words (or a whole
item, when that is shorter) makes its words hit.

Items are grouped into automata of a bounded number of words. Each automaton is
sent to the tasks once; with more than one, documents pass through them in turn
within the same task, so texts never move. A worker keeps `KEPT` automata; with more
groups the documents are written behind every so many, so that none is built twice.
"""

import uuid
from collections import OrderedDict
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from prefboard.functions.portions import joined, portions
from prefboard.llm.texts import alnum_places, alnum_words, unused_name
from prefboard.session import materialise

WINDOW = 13
MAX_WORDS_PER_AUTOMATON = 1_000_000
KEPT = 4

OVERLAP = T.StructType(
    [
        T.StructField("n_words", T.LongType(), False),
        T.StructField("spans", T.ArrayType(T.ArrayType(T.LongType(), False), False), False),
        T.StructField("items", T.ArrayType(T.StringType(), False), False),
    ]
)
_ARROW_OVERLAP = pa.struct(
    [("n_words", pa.int64()), ("spans", pa.list_(pa.list_(pa.int64()))), ("items", pa.list_(pa.string()))]
)


class SuffixAutomaton:
    """All runs of consecutive words of a set of items; words are small numbers."""

    def __init__(self, items, window=WINDOW):
        """`items`: `(item_id, words)`; items without words say nothing."""
        self.window = window
        self.vocabulary = {}
        self.next, self.link, self.length = [{}], [-1], [0]
        self.owners = [set()]
        #: ids of items shorter than a window, by the state of their whole text
        self.short = {}
        self.shortest = window
        numbered = []
        for item, words in items:
            if words:
                numbered.append((item, [self.vocabulary.setdefault(w, len(self.vocabulary)) for w in words]))
                self.shortest = min(self.shortest, len(words))
        for _, words in numbered:
            last = 0
            for word in words:
                last = self._extend(last, word)
        for item, words in numbered:
            self._own(item, words)

    def _add(self, length, transitions, link):
        self.next.append(transitions)
        self.length.append(length)
        self.link.append(link)
        self.owners.append(set())
        return len(self.next) - 1

    def _extend(self, last, word):
        """State of the current item's words with one more word behind."""
        if word in self.next[last]:
            old = self.next[last][word]
            return old if self.length[old] == self.length[last] + 1 else self._split(last, word, old)
        new, at = self._add(self.length[last] + 1, {}, 0), last
        while at >= 0 and word not in self.next[at]:
            self.next[at][word] = new
            at = self.link[at]
        if at >= 0:
            old = self.next[at][word]
            self.link[new] = old if self.length[old] == self.length[at] + 1 else self._split(at, word, old)
        return new

    def _split(self, at, word, old):
        """A copy of `old` for the shorter runs that reach it through `at`."""
        copy = self._add(self.length[at] + 1, dict(self.next[old]), self.link[old])
        self.link[old] = copy
        while at >= 0 and self.next[at].get(word) == old:
            self.next[at][word] = copy
            at = self.link[at]
        return copy

    def _own(self, item, words):
        """Names `item` in every state that stands for one of its windows."""
        state, size = 0, min(self.window, len(words))
        for place, word in enumerate(words):
            state = self.next[state][word]
            if place + 1 >= size:
                while self.length[self.link[state]] >= size:
                    state = self.link[state]
                if len(words) < self.window:
                    self.short.setdefault(state, (size, set()))[1].add(item)
                else:
                    self.owners[state].add(item)

    def overlaps(self, words):
        """`(spans, item ids)`: hit word ranges `[start, end)`, apart and ascending."""
        if not self.vocabulary or len(words) < self.shortest:
            return [], set()
        ids = np.fromiter(map(self.vocabulary.get, words, repeat(-1)), np.int64, len(words))
        gaps = np.flatnonzero(ids < 0)
        edges = np.concatenate([[-1], gaps, [len(ids)]])
        spans, items = [], set()
        for k in np.flatnonzero(np.diff(edges) > self.shortest):
            start = int(edges[k]) + 1
            self._stream(ids[start : int(edges[k + 1])].tolist(), start, spans, items)
        return spans, items

    def _stream(self, ids, first, spans, items):
        follow, link, length, window = self.next, self.link, self.length, self.window
        short, state, matched = self.short, 0, 0
        for place, word in enumerate(ids, first + 1):
            while word not in follow[state]:
                state = link[state]
                matched = length[state]
            state = follow[state][word]
            matched += 1
            longest = 0
            if matched >= window:
                at = state
                while length[link[at]] >= window:
                    at = link[at]
                items |= self.owners[at]
                longest = matched
            if short:
                at = state
                while at > 0:
                    size, owners = short.get(at, (0, ()))
                    if owners and size <= matched:
                        items.update(owners)
                        longest = max(longest, size)
                    at = link[at]
            if longest:
                start = place - longest
                while spans and spans[-1][1] >= start:
                    start = min(start, spans.pop()[0])
                spans.append([start, place])


def merge_spans(spans):
    """Ranges joined where they touch or overlap."""
    out = []
    for start, end in sorted(spans):
        if out and start <= out[-1][1]:
            out[-1][1] = max(out[-1][1], end)
        else:
            out.append([start, end])
    return out


def item_groups(benchmark: DataFrame, item_id="item_id", text="text", max_words=MAX_WORDS_PER_AUTOMATON):
    """Lists of `(item_id, words)` with at most `max_words` words each.

    Items come to the driver one group at a time. Ids of any type are texts here; an
    item without an id keeps its windows, which then name nothing. Texts without words
    are left out.
    """
    rows = benchmark.select(F.col(item_id).cast("string").alias("i"), F.col(text).cast("string").alias("t"))
    group, size = [], 0
    for row in rows.where("t is not null").toLocalIterator():
        words = alnum_words(row["t"].encode())
        if group and size + len(words) > max_words:
            yield group
            group, size = [], 0
        if words:
            group.append((row["i"], words))
            size += len(words)
    if group:
        yield group


def find_overlaps(
    df: DataFrame, benchmark: DataFrame, text="text", into="overlap", window=WINDOW, max_words=MAX_WORDS_PER_AUTOMATON
) -> DataFrame:
    """`df` with `n_words`, hit word ranges `spans` and ids of `items` (as texts) with a window in the text.

    Null and empty texts have no words. Without items nothing is hit. Repeated
    items count once per id; items without an id hit words, but are not in `items`. All other columns stay; one named like `into` is
    replaced. Row-wise, no shuffle; more than `KEPT` groups of items need passes.
    """
    out, finder = _but_last(df, benchmark, text, into, window, max_words)
    return out.withColumn(into, _scan(finder)(F.col(text).cast("string"), F.col(into)))


def _but_last(df, benchmark, text, into, window, max_words=MAX_WORDS_PER_AUTOMATON):
    """`df` with its overlaps with all groups of items but the last, and the finder for that one."""
    context = df.sparkSession.sparkContext
    out, finder = df.withColumn(into, F.lit(None).cast(OVERLAP)), None
    for number, group in enumerate(item_groups(benchmark, text=text, max_words=max_words)):
        if finder:
            out = out.withColumn(into, _scan(finder)(F.col(text).cast("string"), F.col(into)))
            if number % KEPT == 0:
                out = materialise(out, "overlaps")
        finder = _finder(context.broadcast(group), window)
    return out, finder or _finder(context.broadcast([]), window)


#: Automata of this Python worker, the latest last.
_built = OrderedDict()


def _automaton(key, items, window):
    if key not in _built:
        _built[key] = SuffixAutomaton(items.value, window)
        if len(_built) > KEPT:
            _built.popitem(last=False)
    return _built[key]


def _finder(items, window):
    """Function of texts and what was found in them before, by portions: lists of texts and of overlaps."""
    key = uuid.uuid4().hex

    def overlaps(automaton, value, before):
        words = alnum_words(value or b"")
        spans, found = automaton.overlaps(words)
        if before:
            spans, found = merge_spans(before["spans"] + spans), found.union(before["items"])
        return {"n_words": len(words), "spans": spans, "items": sorted(found - {None})}

    def find(column, earlier):
        automaton = _automaton(key, items, window)
        for values, before in portions(column.cast(pa.binary()), earlier):
            yield values, [overlaps(automaton, v, b) for v, b in zip(values, before)]

    return find


def _scan(finder):
    @F.arrow_udf(returnType=OVERLAP)
    def scan(column: pa.Array, earlier: pa.Array) -> pa.Array:
        return joined((found for _, found in finder(column, earlier)), _ARROW_OVERLAP)

    return scan.asNondeterministic()


def n_hit(spans: Column) -> Column:
    """Number of words inside the ranges."""
    lengths = F.transform(spans, lambda s: s[1] - s[0])
    return F.aggregate(lengths, F.lit(0).cast("long"), lambda total, n: total + n)


def is_contaminated(overlap: Column, share=20) -> Column:
    """At least one word in `share` is hit."""
    hit = n_hit(overlap["spans"])
    return (hit > 0) & (hit * share >= overlap["n_words"])


def drop_contaminated(df: DataFrame, benchmark: DataFrame, share=20, window=WINDOW) -> DataFrame:
    """Rows whose hit words stay below the coverage limit, unchanged."""
    overlap = unused_name("overlap", df.columns)
    marked = find_overlaps(df, benchmark, into=overlap, window=window)
    return marked.where(~is_contaminated(F.col(overlap), share)).drop(overlap)


_CLEANED = T.StructType([T.StructField("text", T.StringType()), T.StructField("contaminated", T.BooleanType(), False)])
_ARROW_CLEANED = pa.struct([("text", pa.binary()), ("contaminated", pa.bool_())])


def _cleaned(value, overlap, longest, share, drops):
    """The text without the spans in `overlap` beyond the limits, and whether these reach the coverage limit."""
    spans = overlap["spans"]
    hit = sum(end - start for start, end in spans)
    contaminated = hit > 0 and hit * share >= overlap["n_words"]
    if contaminated and drops:
        return {"text": None, "contaminated": True}
    if not contaminated:
        spans = [s for s in spans if s[1] - s[0] > longest]
    if value and spans:
        places, parts, at = alnum_places(value), [], 0
        for start, end in spans:
            parts.append(value[at : places[start][0]])
            at = places[end - 1][1]
        value = b"".join(parts) + value[at:]
    return {"text": value, "contaminated": contaminated}


def _without_spans(df, benchmark, longest, share, window, text, drops) -> DataFrame:
    """`df` whose texts lose the spans beyond the limits; with `drops` without contaminated rows.

    The last (mostly only) group of items is looked for and cut in one crossing to
    Python: a second one would take a second worker of every task.
    """
    names = df.columns
    overlap = unused_name("overlap", names)
    found, finder = _but_last(df, benchmark, text, overlap, window)

    @F.arrow_udf(returnType=_CLEANED)
    def clean(column: pa.Array, earlier: pa.Array) -> pa.Array:
        rows = ([_cleaned(v, o, longest, share, drops) for v, o in zip(*part)] for part in finder(column, earlier))
        texts, flags = joined(rows, _ARROW_CLEANED).flatten()
        return pa.StructArray.from_arrays([texts.cast(pa.string()), flags], _CLEANED.names)

    new = unused_name("cleaned", found.columns)
    cleaned = found.withColumn(new, clean.asNondeterministic()(F.col(text).cast("string"), F.col(overlap)))
    if drops:
        cleaned = cleaned.where(~F.col(new)["contaminated"])
    after = F.col(new)["text"]
    if "n_chars" in names:
        count = F.char_length(after).cast(df.schema["n_chars"].dataType)
        cleaned = cleaned.withColumn("n_chars", F.when(after.eqNullSafe(F.col(text)), F.col("n_chars")).otherwise(count))
    return cleaned.withColumn(text, after).select(*[F.col(f"`{n}`") for n in names])


def remove_spans(df: DataFrame, benchmark: DataFrame, longest=WINDOW - 1, share=20, window=WINDOW, text="text") -> DataFrame:
    """All rows, without the hit spans beyond the limits.

    A span of more than `longest` words goes, and every span goes where the hit words
    reach the coverage limit, one word in `share`. A span is cut from the start of its
    first word to the end of its last; what stands around it stays. Texts without such
    spans, null and empty ones stay as they are. When there is an `n_chars` column, it
    is set anew for changed texts.
    """
    return _without_spans(df, benchmark, longest, share, window, text, False)


def decontaminate(df: DataFrame, benchmark: DataFrame, longest=WINDOW - 1, share=20, window=WINDOW, text="text") -> DataFrame:
    """Rows whose hit words stay below the coverage limit, without their hit spans of
    more than `longest` words (as `remove_spans`).

    Rows at the limit go whole. All others stay, null and empty texts too, and texts
    without such a span are unchanged. One pass over the texts.
    """
    return _without_spans(df, benchmark, longest, share, window, text, True)
