"""Licence notices in texts as an exact set-similarity join with templates.

A template is found in a block when the block has at least `threshold` of the
template's distinct words. Blocks are all runs of half as many words again as the
template has, so a notice may be wrapped anywhere, and words scattered over a long
line are none. Phrases whose words must also stand consecutively are looked for in
the lines of a text, each continued by the first words after it. Words are ordered by their
frequency over all lines, rarest first. A pair is looked at only if the two share
a word within their prefixes (prefix filter), if the block has enough words of the
templates (length filter), and if enough words are left behind the shared ones
(positional filter); then the overlap is counted on the full sets. A text whose words
do not pass the filters has no run that does.

Without `windows`, lines are the blocks of all templates.

Templates are a parameter of fixed size and go to every task; texts do not move.
"""

from bisect import bisect_right
from collections import Counter
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from prefboard.llm.texts import alnum_text, alnum_words, as_bytes


@dataclass(frozen=True)
class Template:
    """`exact`: the words must also stand consecutively in the block."""

    label: str
    text: str
    threshold: float = 0.8
    exact: bool = False


# Phrases whose places are counted, with their labels.
PHRASES = (
    Template("cc-by", "cc by", 1.0, True),
    Template("gpl", "general public license", 1.0, True),
    Template("reserved", "all rights reserved", 1.0, True),
)

# Openings of widely used notices, and short names of licences.
NOTICES = (
    Template("agpl-3.0", "gnu affero general public license version 3", 1.0),
    Template("apache-2.0", "licensed under the apache license version 2.0 you may not use this file except in compliance with the license"),
    Template(
        "apache-2.0",
        "unless required by applicable law or agreed to in writing software distributed under the license is distributed on an "
        "as is basis without warranties or conditions of any kind either express or implied see the license for the specific "
        "language governing permissions and limitations under the license",
    ),
    Template("apache-2.0", "licensed under the apache license version 2.0", 1.0),
    Template("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"),
    Template("cc-by-4.0", "this work is licensed under a creative commons attribution 4.0 international license"),
    Template("cc-by-nc-4.0", "licensed under cc by nc 4.0", 1.0),
    Template("cc-by-sa-4.0", "licensed under cc by sa 4.0", 1.0),
    Template(
        "gnu",
        "is free software you can redistribute it and or modify it under the terms of the gnu general public license as "
        "published by the free software foundation either version 3 of the license or at your option any later version",
    ),
    Template("gpl-3.0", "this work is licensed under the gnu general public license version 3", 0.9),
    Template(
        "isc",
        "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted "
        "provided that the above copyright notice and this permission notice appear in all copies",
    ),
    Template("lgpl", "gnu lesser general public license", 1.0),
    Template("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software"),
    Template(
        "mit",
        "permission is hereby granted free of charge to any person obtaining a copy of this software and associated "
        "documentation files the software to deal in the software without restriction including without limitation the rights "
        "to use copy modify merge publish distribute sublicense and or sell copies of the software",
    ),
    Template("mit", "released under the mit license", 1.0),
    Template("mpl-2.0", "this source code form is subject to the terms of the mozilla public license version 2.0"),
    Template(
        "unlicense",
        "this is free and unencumbered software released into the public domain anyone is free to copy modify publish use "
        "compile sell or distribute this software either in source code form or as a compiled binary",
    ),
)

MATCH = T.StructType(
    [
        T.StructField("label", T.StringType(), False),
        T.StructField("base", T.BooleanType(), False),
        T.StructField("block", T.LongType(), False),
        T.StructField("start", T.LongType(), False),
        T.StructField("containment", T.DoubleType(), False),
    ]
)
FOUND = T.StructType(
    [T.StructField("n_words", T.LongType(), False), T.StructField("matches", T.ArrayType(MATCH, False), False)]
)
_ARROW_FOUND = pa.struct(
    [
        ("n_words", pa.int64()),
        (
            "matches",
            pa.list_(
                pa.struct(
                    [
                        ("label", pa.string()),
                        ("base", pa.bool_()),
                        ("block", pa.int64()),
                        ("start", pa.int64()),
                        ("containment", pa.float64()),
                    ]
                )
            ),
        ),
    ]
)


def blocks_of(text: bytes, tail: int):
    """`(number, first word, words, words with tail)` of every line that has words."""
    lines = [line.split() for line in alnum_text(text).split(b"\n")]
    words = [w for line in lines for w in line]
    at = 0
    for number, line in enumerate(lines):
        if line:
            yield number, at, line, words[at : at + len(line) + tail]
            at += len(line)


def _template_words(templates):
    return [alnum_words(t.text.encode()) for t in templates]


def _tail(templates):
    return max([len(w) for t, w in zip(templates, _template_words(templates)) if t.exact], default=1) - 1


def word_frequencies(df: DataFrame, templates, text="text") -> dict:
    """Number of blocks over the whole table that have each word of the templates.

    Tasks send one count per template word; the result has at most as many rows as
    the templates have words.
    """
    vocabulary = frozenset(w for ws in _template_words(templates) for w in ws)
    tail = _tail(templates)

    def count(batches):
        seen = Counter()
        for batch in batches:
            for value in as_bytes(batch.column(0)):
                for _, _, _, extended in blocks_of(value, tail):
                    seen.update(vocabulary.intersection(extended))
        words = sorted(seen)
        yield pa.RecordBatch.from_pydict({"word": words, "n": [seen[w] for w in words]}, _COUNTS)

    parts = df.select(F.col(text).cast("string")).mapInArrow(count, "word binary, n long")
    return {bytes(r["word"]): r["n"] for r in parts.groupBy("word").agg(F.sum("n").alias("n")).collect()}


_COUNTS = pa.schema([("word", pa.binary()), ("n", pa.int64())])


class Index:
    """Prefix index of the templates under one global word order."""

    def __init__(self, templates, frequencies: dict):
        self.templates = list(templates)
        self.words = _template_words(templates)
        vocabulary = {w for ws in self.words for w in ws}
        order = sorted(vocabulary, key=lambda w: (frequencies.get(w, 0), w))
        self.rank = {w: i for i, w in enumerate(order)}
        self.sets = [sorted({self.rank[w] for w in ws}) for ws in self.words]
        #: Words of a window in which a template is looked for.
        self.reach = [len(ws) + (len(ws) + 1) // 2 for ws in self.words]
        self.needed = [_at_least(t.threshold, len(s)) for t, s in zip(self.templates, self.sets)]
        self.postings = {}
        for number, (ranks, needed) in enumerate(zip(self.sets, self.needed)):
            for place, rank in enumerate(ranks[: len(ranks) - needed + 1]):
                self.postings.setdefault(rank, []).append((number, place))
        self.first_words = frozenset(order[r] for r in self.postings)
        self.tail = _tail(templates)

    def _candidates(self, ranks):
        """Numbers of the templates that pass all three filters."""
        passed, refused = {}, set()
        for place, rank in enumerate(ranks):
            for number, where in self.postings.get(rank, ()):
                needed = self.needed[number]
                if number in refused or len(ranks) < needed or place > len(ranks) - needed:
                    continue
                so_far = passed.get(number, 0) + 1
                left = min(len(ranks) - place, len(self.sets[number]) - where) - 1
                if so_far + left >= needed:
                    passed[number] = so_far
                else:
                    passed.pop(number, None)
                    refused.add(number)
        return passed

    def _windows(self, words):
        """`(template, first word, shared)` of the windows that begin with a word of the
        template and have enough of them: of those that overlap, the first of the best."""
        places = [(at, self.rank[w]) for at, w in enumerate(words) if w in self.rank]
        for number in sorted(self._candidates(sorted({r for _, r in places}))):
            if self.templates[number].exact:
                continue
            own, reach, needed = set(self.sets[number]), self.reach[number], self.needed[number]
            events = [(at, r) for at, r in places if r in own]
            have, behind, best, last = Counter(), 0, None, None
            for at, rank in events:
                while behind < len(events) and events[behind][0] < at + reach:
                    have[events[behind][1]] += 1
                    behind += 1
                if len(have) >= needed:
                    if best and at >= last + reach:
                        yield number, *best
                        best = None
                    if best is None or len(have) > best[1]:
                        best = at, len(have)
                    last = at
                have[rank] -= 1
                if not have[rank]:
                    del have[rank]
            if best:
                yield number, *best

    def matches(self, text: bytes, windows=False):
        """`(number of words, [match])` of one text, in order of place."""
        words = alnum_words(text)
        if self.first_words.isdisjoint(words):
            return len(words), []
        found = []
        blocks = list(blocks_of(text, self.tail))
        if windows:
            firsts = [first for _, first, _, _ in blocks]
            for number, at, shared in self._windows(words):
                block = blocks[bisect_right(firsts, at) - 1][0]
                found.append((self.templates[number].label, False, block, at, shared / len(self.sets[number])))
        for block, first, line, extended in blocks:
            if self.first_words.isdisjoint(extended):
                continue
            for exact, part in ((True, extended),) if windows else ((True, extended), (False, line)):
                ranks = sorted({self.rank[w] for w in part if w in self.rank})
                have = set(ranks)
                for number in sorted(self._candidates(ranks)):
                    template = self.templates[number]
                    shared = sum(r in have for r in self.sets[number])
                    if template.exact is not exact or shared < self.needed[number]:
                        continue
                    wanted = self.words[number]
                    if exact:
                        places = [i for i in range(len(line)) if part[i : i + len(wanted)] == wanted]
                    else:
                        places = [next(i for i, w in enumerate(part) if w in wanted)]
                    share = shared / len(self.sets[number])
                    found += [(template.label, exact, block, first + i, share) for i in places]
        return len(words), sorted(found, key=lambda m: (m[3], m[0]))


def _at_least(threshold, size):
    """Smallest overlap that meets the threshold, free of rounding."""
    return max(1, -(-round(threshold * 10**6) * size // 10**6))


def find_licenses(df: DataFrame, templates=PHRASES + NOTICES, text="text", into="licenses", windows=True) -> DataFrame:
    """`df` with `n_words` and `matches (label, base, block, start, containment)`.

    Of overlapping word windows that meet a template's threshold the best is a match, and
    `block` is the line it begins in (without `windows`, every line that meets it); `base` marks those
    whose words stand consecutively, one match for each place. Null and empty
    texts have 0 words and no match. All other columns stay; one named like `into`
    is replaced. Two passes over the texts, nothing is shuffled but the counts.
    """
    index = Index(templates, word_frequencies(df, templates, text))

    @F.arrow_udf(returnType=FOUND)
    def scan(column: pa.Array) -> pa.Array:
        rows = []
        for value in as_bytes(column):
            count, found = index.matches(value, windows)
            matches = [dict(zip(MATCH.names, m)) for m in found]
            rows.append({"n_words": count, "matches": matches})
        return pa.array(rows, _ARROW_FOUND)

    return df.withColumn(into, scan.asNondeterministic()(F.col(text).cast("string")))
