"""Near duplicates by MinHash: banding, signature check, exact check, components.

Documents with equal sets of shingles are one class from the start; only classes
are compared. A signature holds the minima of 128 universal hashes in 32 bands of
4, which bring a pair of similarity 0.75 together with probability 0.999995.

Within a bucket (classes that agree on a band) nobody compares all pairs. First
every class is compared with the bucket's leader: the class whose buckets are
largest over all bands, which is the middle of a group of copies if it has one.
Only buckets whose classes then lie in several components are looked at again
(under other leaders, if so chosen), and at last every class outside the bucket's
largest component is compared with all others, in blocks that send on links only.
So no two classes of one bucket end in different components uncompared.
"""

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from prefboard.llm.components import components, smallest_reached
from prefboard.llm.texts import as_bytes, each_as_bytes, spaced_words, word_hashes
from prefboard.session import materialise

WORDS = 5
BANDS, ROWS = 32, 4
PERCENT = 75
#: Share of equal minima below which a pair is not checked on the full sets. At a
#: similarity of 0.75 fewer than this agree with a probability of 4e-6.
LEAST_AGREEING = 0.58
BLOCK = 256

_numbers = np.random.Generator(np.random.PCG64(7))
_FACTORS = _numbers.integers(0, 1 << 32, BANDS * ROWS, np.uint32) | np.uint32(1)
_OFFSETS = _numbers.integers(0, 1 << 32, BANDS * ROWS, np.uint32)
_PLACES = _numbers.integers(0, 1 << 63, 64, np.uint64) * np.uint64(2) + np.uint64(1)


def _mixed(x):
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingle_set(text: bytes, words=WORDS) -> np.ndarray:
    """Sorted distinct 64-bit fingerprints of a text's shingles.

    A text with fewer words has its whole sequence as its one shingle; without
    words the set is empty.
    """
    parts = spaced_words(text)
    n = len(parts)
    if not n:
        return np.zeros(0, np.uint64)
    hashed = word_hashes(parts)
    width = min(words, n)
    # how many words there are belongs to the shingle
    total = np.full(n - width + 1, width, np.uint64)
    for place in range(width):
        total += hashed[place : n - width + 1 + place] * _PLACES[place % 64]
    return np.unique(_mixed(total))


def signature(shingles: np.ndarray) -> bytes:
    """Minima of all hashes over a non-empty set, as 32-bit numbers."""
    short = (shingles >> np.uint64(32)).astype(np.uint32)[:, None]
    least = np.full(BANDS * ROWS, 0xFFFFFFFF, np.uint32)
    for start in range(0, len(short), 512):
        hashed = short[start : start + 512] * _FACTORS
        hashed += _OFFSETS
        np.minimum(least, hashed.min(axis=0), out=least)
    return least.astype("<u4").tobytes()


def similar(a: np.ndarray, b: np.ndarray, percent=PERCENT) -> bool:
    """100 * intersection >= percent * union, on full sets that are not empty."""
    if 100 * min(len(a), len(b)) < percent * max(len(a), len(b)):
        return False
    both = np.concatenate([a, b])
    both.sort()
    shared = int(np.count_nonzero(both[1:] == both[:-1]))
    return 100 * shared >= percent * (len(both) - shared)


_PRINT = T.StructType(
    [
        T.StructField("n_shingles", T.LongType(), False),
        T.StructField("digest", T.BinaryType()),
        T.StructField("signature", T.BinaryType()),
    ]
)


@F.arrow_udf(returnType=_PRINT)
def _prints(text: pa.Array) -> pa.Array:
    sizes, digests, signatures, known = [], [], [], {}
    for value in each_as_bytes(text):
        shingles = shingle_set(value)
        sizes.append(len(shingles))
        digest = hashlib.blake2b(shingles.tobytes(), digest_size=16).digest() if len(shingles) else None
        if digest and digest not in known:
            known[digest] = signature(shingles)
        digests.append(digest)
        signatures.append(known.get(digest))
    columns = [pa.array(sizes, pa.int64()), pa.array(digests, pa.binary()), pa.array(signatures, pa.binary())]
    return pa.StructArray.from_arrays(columns, _PRINT.names)


@F.arrow_udf(returnType=T.BooleanType())
def _similar_texts(left: pa.Array, right: pa.Array) -> pa.Array:
    out, last, left_set = [], None, None
    for start in range(0, len(left), 256):
        for a, b in zip(as_bytes(left.slice(start, 256)), as_bytes(right.slice(start, 256))):
            if a != last:  # pairs come sorted by their left side
                last, left_set = a, shingle_set(a)
            out.append(similar(left_set, shingle_set(b)))
    return pa.array(out, pa.bool_())


def _numbers_of(signatures) -> np.ndarray:
    return np.frombuffer(b"".join(signatures), "<u4").reshape(len(signatures), BANDS * ROWS)


@F.arrow_udf(returnType=T.BooleanType())
def _agree(left: pa.Array, right: pa.Array) -> pa.Array:
    if not len(left):
        return pa.array([], pa.bool_())
    a, b = _numbers_of(left.to_pylist()), _numbers_of(right.to_pylist())
    return pa.array((a == b).mean(axis=1) >= LEAST_AGREEING)


def band_keys(signature: Column) -> Column:
    """One 64-bit key per band; equal keys mean equal minima of that band."""
    width = 4 * ROWS
    return F.array(*[F.xxhash64(F.lit(b), F.substring(signature, 1 + width * b, width)) for b in range(BANDS)])


class _Classes:
    """Candidate classes of one run: their signatures, texts and buckets.

    No table of numbers has more rows than there are bands of documents; the texts and
    the pairs compared in Python stay in the tasks of their joins.
    """

    def __init__(self, df, prints, text, row_id):
        self.most = BANDS * prints.count()
        alone = prints.where("digest is not null and id is not null")
        self.classes = materialise(alone.groupBy("digest").agg(F.min("id").alias("class")), "classes", self.most)
        members = alone.join(
            self.classes, (alone["digest"] == self.classes["digest"]) & (alone["id"] == self.classes["class"])
        ).select("class", "signature")
        keys = members.select("class", F.explode(band_keys(F.col("signature"))).alias("key"))
        rows = materialise(keys, "bands", self.most)
        sizes = rows.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
        shared = materialise(rows.join(materialise(sizes, "shared-bands", self.most), "key"), "shared", self.most)
        weights = shared.groupBy("class").agg(F.sum("n").alias("weight"))
        self.buckets = materialise(shared.join(materialise(weights, "weights", self.most), "class"), "buckets", self.most)
        ids = materialise(self.buckets.select("class").distinct(), "candidates", self.most)
        self.signatures = materialise(members.join(ids, "class", "left_semi"), "signatures", self.most)
        texts = df.select(F.col(row_id).cast("long").alias("class"), F.col(text).cast("string").alias("text"))
        self.texts = materialise(texts.join(ids, "class", "left_semi"), "candidate-texts")

    def links(self, pairs: DataFrame) -> DataFrame:
        """Those of the pairs `(u, v)` that are similar on their full sets."""
        found = self.agreeing(pairs)
        left = self.texts.withColumnsRenamed({"class": "u", "text": "left"})
        right = self.texts.withColumnsRenamed({"class": "v", "text": "right"})
        checked = found.join(right, "v").join(left, "u")
        same = _similar_texts.asNondeterministic()(F.col("left"), F.col("right"))
        return materialise(checked.withColumn("same", same).where("same").select("u", "v"), "confirmed")

    def agreeing(self, pairs: DataFrame) -> DataFrame:
        left = self.signatures.withColumnsRenamed({"class": "u", "signature": "left"})
        right = self.signatures.withColumnsRenamed({"class": "v", "signature": "right"})
        both = pairs.join(right, "v").join(left, "u")
        agree = _agree.asNondeterministic()(F.col("left"), F.col("right"))
        return both.withColumn("agree", agree).where("agree").select("u", "v").distinct()

    def with_leaders(self, buckets: DataFrame, *order) -> DataFrame:
        """Pairs of each class with the leader of each of its buckets, the first in `order`."""
        first = F.min(F.struct(*[o.alias(f"o{i}") for i, o in enumerate(order)], "class")).alias("first")
        leaders = buckets.groupBy("key").agg(first).select("key", F.col("first.class").alias("u"))
        pairs = buckets.join(materialise(leaders, "leaders", self.most), "key").where(F.col("class") != F.col("u"))
        return pairs.select(F.least("u", "class").alias("u"), F.greatest("u", "class").alias("v")).distinct()

    def mixed(self, roots: DataFrame) -> DataFrame:
        """Rows `key, class, n, root` of the buckets with several components."""
        rooted = self.buckets.where("n > 2").join(roots.withColumnRenamed("node", "class"), "class", "left")
        rooted = rooted.select("key", "class", "n", F.coalesce("root", "class").alias("root"))
        rooted = materialise(rooted, "rooted", self.most)
        several = rooted.groupBy("key").agg(F.min("root").alias("a"), F.max("root").alias("b")).where("a <> b")
        keys = materialise(several.select("key"), "mixed-keys", self.most)
        return materialise(rooted.join(keys, "key", "left_semi"), "mixed", self.most)

    def across(self, mixed: DataFrame) -> DataFrame:
        """Links between different components of one bucket.

        The largest component of a bucket needs no look inside; the others are
        compared with everything, in blocks of about 256 classes on either side.
        Signatures name the pairs to check on the full sets, there and then.
        """
        sizes = mixed.groupBy("key", "root").agg(F.count(F.lit(1)).alias("size"))
        largest = sizes.groupBy("key").agg(
            F.max_by("root", F.struct("size", "root")).alias("largest"),
            (F.sum("size") - F.max("size")).alias("others"),
        )
        largest = materialise(largest, "largest", self.most)
        rows = mixed.join(largest, "key").join(self.signatures, "class").join(self.texts, "class")
        spread = F.xxhash64("class", F.lit("block"))
        blocks = lambda n: F.ceil(n / BLOCK).cast("int")
        here = F.sequence(F.lit(0), blocks(F.col("others")) - 1)
        there = F.sequence(F.lit(0), blocks(F.col("n")) - 1)
        columns = ("key", "class", "root", "signature", "text")
        targets = rows.select(
            *columns, F.lit(False).alias("asks"), F.explode(here).alias("i"), F.pmod(spread, blocks(F.col("n"))).cast("int").alias("j")
        )
        askers = rows.where("root <> largest").select(
            *columns, F.lit(True).alias("asks"), F.pmod(spread, blocks(F.col("others"))).cast("int").alias("i"), F.explode(there).alias("j")
        )
        blocked = targets.unionByName(askers).groupBy("key", "i", "j")
        return materialise(blocked.applyInArrow(_links_across, "u long, v long"), "links-across")


def _links_across(table: pa.Table) -> pa.Table:
    """Links of the asking classes with the others; a link of every class to the
    smallest that it reaches."""
    asks = table.column("asks").to_numpy()
    ids, roots = table.column("class").to_numpy(), table.column("root").to_numpy()
    numbers = _numbers_of(table.column("signature").to_pylist())
    texts, sets = as_bytes(table.column("text").combine_chunks()), {}

    def shingles(at):
        if at not in sets:
            sets[at] = shingle_set(texts[at])
        return sets[at]

    component = {int(r): int(r) for r in roots}

    def find(r):
        while component[r] != r:
            r = component[r]
        return r

    targets, links = np.flatnonzero(~asks), []
    for a in np.flatnonzero(asks):
        close = (numbers[targets] == numbers[a]).mean(axis=1) >= LEAST_AGREEING
        for b in targets[close & (roots[targets] != roots[a])]:
            x, y = find(int(roots[a])), find(int(roots[b]))
            if x != y and similar(shingles(a), shingles(b)):
                component[x] = y
                links.append((ids[a], ids[b]))
    u, v = np.array(links, np.int64).reshape(-1, 2).T
    nodes, reached = smallest_reached(u, v) if len(u) else (u, v)
    return pa.table({"u": nodes, "v": reached})


def near_duplicates(df: DataFrame, text="text", row_id="doc_id", star_rounds=1) -> DataFrame:
    """`row_id, n_shingles, component_id, kept` of every row.

    Documents are linked when their sets of 5-word shingles have a similarity of
    0.75 or more; `component_id` is the smallest id reachable. Null, empty and
    blank texts have an empty set and stay alone. Rows with equal sets are linked,
    repeated rows (same id) share everything. A row without an id keeps its
    `n_shingles`; it has no component and is not kept. No rows: no rows. Other
    columns are not read.
    """
    return _marked(df, text, row_id, star_rounds)[0]


def _marked(df, text, row_id, star_rounds=1):
    """The rows of `near_duplicates`, and a bound of the rows of the tables behind them."""
    made = df.select(
        F.col(row_id), F.col(row_id).cast("long").alias("id"), _prints.asNondeterministic()(F.col(text).cast("string")).alias("p")
    )
    prints = materialise(made.select(row_id, "id", "p.*"), "prints")
    run = _Classes(df, prints, text, row_id)
    roots = components(run.links(run.with_leaders(run.buckets, -F.col("weight"))))
    for round_ in range(1, star_rounds + 1):
        mixed = run.mixed(roots)
        if mixed.isEmpty():
            break
        more = run.links(run.with_leaders(mixed)) if round_ < star_rounds else run.across(mixed)
        if not more.isEmpty():
            known = roots.select(F.col("node").alias("u"), F.col("root").alias("v"))
            roots = components(known.unionByName(more))
    classes = run.classes.join(roots, F.col("class") == F.col("node"), "left")
    rooted = classes.select("digest", F.coalesce("root", "class").alias("component_id"))
    rooted = materialise(rooted, "rooted-classes", run.most)
    rows = prints.select(row_id, "id", "n_shingles", "digest")
    linked = rows.where("digest is not null").join(rooted, "digest", "left")
    alone = rows.where("digest is null").withColumn("component_id", F.col("id"))
    columns = (row_id, "id", "n_shingles", "component_id")
    every = linked.select(*columns).unionByName(alone.select(*columns))
    component = F.when(F.col("id").isNotNull(), F.col("component_id"))
    kept = F.coalesce(component == F.col("id"), F.lit(False))
    return every.select(row_id, "n_shingles", component.alias("component_id"), kept.alias("kept")), run.most


def drop_near_duplicates(df: DataFrame, text="text", row_id="doc_id") -> DataFrame:
    """`df` with one document of every component, the one with the smallest id.

    Rows without an id stay, since nothing can be said to be their copy.
    """
    marked, most = _marked(df, text, row_id)
    dropped = marked.where(~F.col("kept") & F.col(row_id).isNotNull())
    gone = materialise(dropped.select(row_id).distinct(), "near-copies", most)
    return df.join(gone, row_id, "left_anti")
