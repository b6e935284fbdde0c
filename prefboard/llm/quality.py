"""Document quality: random-indexing word vectors and a two-layer network.

Every word belongs to one of 8,192 buckets with a sparse random index vector. The
vector of a bucket is the sum of the index vectors of all words that stand near its
words, over all documents. A document is the mean of its words' vectors together
with a few shares that the mean loses (repeats, capitals, digits and the like). A
network of two layers, fitted in numpy on a bounded sample of labelled rows, turns
that into a probability, whose temperature is set on rows kept aside.
"""

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from prefboard.llm.texts import bytes_by_portions, in_use, lookup_table, portions, unused_name
from prefboard.session import materialise

BUCKETS, DIMENSIONS, NEAR = 1 << 13, 32, 2
#: Labelled rows the network is fitted on, at most; taken by a hash of their id.
MAX_LABELLED = 20_000
HIDDEN, EPOCHS = 32, 60
THRESHOLD = 0.7

_random = np.random.Generator(np.random.PCG64(11))
#: An index vector has a 1 and a -1.
_PLUS = _random.integers(0, DIMENSIONS, BUCKETS)
_MINUS = (_PLUS + _random.integers(1, DIMENSIONS, BUCKETS)) % DIMENSIONS
SHARES = 9


class _WordCodes(dict):
    """A word's bucket (13 bits), traits and hash in one number; bounded in size."""

    MAX = 100_000

    def __missing__(self, word):
        if len(self) >= self.MAX:
            self.clear()
        text = word.decode("utf-8", "replace")
        signs = sum(not c.isalnum() for c in text)
        hashed = xxhash.xxh3_64_intdigest(word)
        value = hashed >> 24 << 24 | min(len(text), 63) << 16 | hashed & (BUCKETS - 1)
        value |= (len(text) > 1 and text.isupper()) << 13 | any(c.isdigit() for c in text) << 14 | (signs > 1) << 15
        self[word] = value
        return value


_codes = lookup_table(_WordCodes())


def _coded(texts):
    """Word codes of all texts in turn, the text of each, words per text, distinct ones."""
    words = [t.split() for t in texts]
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    distinct = np.fromiter((len(set(w)) for w in words), np.int64, len(words))
    codes = np.fromiter(map(in_use(_codes).__getitem__, (w for ws in words for w in ws)), np.uint64, int(lengths.sum()))
    return codes, np.repeat(np.arange(len(words)), lengths), lengths, distinct


def _buckets(codes):
    return (codes & np.uint64(BUCKETS - 1)).astype(np.int64)


def _few(column: pa.Array):
    """Lists of consecutive texts with about 2 MB together."""
    for texts in bytes_by_portions(column):
        for first, last in portions(texts):
            yield texts[first:last]


def _near_sums(batches):
    """`cell, n`: sums of index vectors near each bucket's words, of one task."""
    total = np.zeros(BUCKETS * DIMENSIONS, np.int64)
    for batch in batches:
        for texts in _few(batch.column(0)):
            codes, owner, _, _ = _coded(texts)
            bucket = _buckets(codes)
            for apart in range(1, NEAR + 1):
                same = owner[apart:] == owner[:-apart]
                left, right = bucket[:-apart][same], bucket[apart:][same]
                for word, near in ((left, right), (right, left)):
                    total += np.bincount(word * DIMENSIONS + _PLUS[near], minlength=len(total))
                    total -= np.bincount(word * DIMENSIONS + _MINUS[near], minlength=len(total))
    cells = np.flatnonzero(total)
    for start in range(0, len(cells), 100_000):
        part = cells[start : start + 100_000]
        yield pa.record_batch([pa.array(part.astype(np.int32)), pa.array(total[part])], ["cell", "n"])


def word_vectors(df: DataFrame, text="text") -> np.ndarray:
    """Unit vectors of all buckets, from the words of all texts.

    A task sends sums of a fixed number of cells, and the driver gets as many.
    """
    parts = df.select(F.col(text).cast("string")).mapInArrow(_near_sums, "cell int, n long")
    summed = parts.groupBy("cell").agg(F.sum("n").alias("n"))
    sums = materialise(summed, "near-sums", BUCKETS * DIMENSIONS).toArrow()
    total = np.zeros(BUCKETS * DIMENSIONS)
    total[sums.column("cell").to_numpy()] = sums.column("n").to_numpy()
    rows = total.reshape(BUCKETS, DIMENSIONS)
    sizes = np.sqrt((rows * rows).sum(axis=1, keepdims=True))
    return (rows / np.where(sizes > 0, sizes, 1)).astype(np.float32)


def features(texts: list, vectors: np.ndarray) -> np.ndarray:
    """One row per text: mean word vector, then shares; zeros without words."""
    out = np.zeros((len(texts), DIMENSIONS + SHARES), np.float32)
    codes, owner, lengths, distinct = _coded(texts)
    some = np.flatnonzero(lengths)
    if not len(some):
        return out
    starts = (np.cumsum(lengths) - lengths)[some]
    n = lengths[some].astype(np.float64)
    mean = np.add.reduceat(vectors[_buckets(codes)], starts, axis=0) / n[:, None]
    out[some, :DIMENSIONS] = mean

    def share(flags):
        return np.add.reduceat(flags.astype(np.float64), starts) / n

    bit = lambda place: codes >> np.uint64(place) & np.uint64(1)
    again = np.zeros(len(codes), bool)
    again[1:] = (codes[1:] == codes[:-1]) & (owner[1:] == owner[:-1])
    length = (codes >> np.uint64(16) & np.uint64(63)).astype(np.float64)
    out[some, DIMENSIONS:] = np.stack(
        [
            share(again),
            distinct[some] / n,
            np.log(distinct[some]) / np.log(n + 1),
            share(bit(13)),
            share(bit(14)),
            share(bit(15)),
            share(length) / 10,
            np.log(n) / 10,
            np.sqrt((mean * mean).sum(axis=1)),
        ],
        axis=1,
    )
    return out


class Network:
    """Two layers with a calibrated temperature; inputs are standardised."""

    def __init__(self, rows: np.ndarray, labels: np.ndarray, seed=3, epochs=EPOCHS):
        random = np.random.Generator(np.random.PCG64(seed))
        order = random.permutation(len(rows))
        aside = order[: len(rows) // 5]
        used = order[len(rows) // 5 :]
        self.center, self.scale = rows[used].mean(axis=0), rows[used].std(axis=0) + 1e-6
        x, y = self._standard(rows), labels.astype(np.float64)
        size = x.shape[1]
        self.w = [
            random.normal(0, 1 / np.sqrt(size), (size, HIDDEN)),
            np.zeros(HIDDEN),
            random.normal(0, 1 / np.sqrt(HIDDEN), HIDDEN),
            np.zeros(1),
        ]
        self.temperature = 1.0
        self._fit(x[used], y[used], random, epochs)
        if len(aside):
            grid = np.exp(np.linspace(-2, 3, 101))
            logits = self._logits(x[aside])
            self.temperature = min(grid, key=lambda t: _loss(logits / t, y[aside]))

    def _standard(self, rows):
        return np.clip((rows - self.center) / self.scale, -10, 10)

    def _logits(self, x):
        return np.tanh(x @ self.w[0] + self.w[1]) @ self.w[2] + self.w[3]

    def _fit(self, x, y, random, epochs, batch=256, rate=0.003, decay=1e-4):
        first = [np.zeros_like(w) for w in self.w]
        second = [np.zeros_like(w) for w in self.w]
        step = 0
        for _ in range(epochs):
            order = random.permutation(len(x))
            for start in range(0, len(x), batch):
                a, b = x[order[start : start + batch]], y[order[start : start + batch]]
                hidden = np.tanh(a @ self.w[0] + self.w[1])
                error = (_sigmoid(hidden @ self.w[2] + self.w[3]) - b) / len(a)
                back = error[:, None] * self.w[2] * (1 - hidden * hidden)
                slopes = [a.T @ back, back.sum(axis=0), hidden.T @ error, error.sum(keepdims=True)]
                step += 1
                for i, slope in enumerate(slopes):
                    slope = slope + decay * self.w[i]
                    first[i] = 0.9 * first[i] + 0.1 * slope
                    second[i] = 0.999 * second[i] + 0.001 * slope * slope
                    up = first[i] / (1 - 0.9**step)
                    self.w[i] = self.w[i] - rate * up / (np.sqrt(second[i] / (1 - 0.999**step)) + 1e-8)

    def predict(self, rows: np.ndarray) -> np.ndarray:
        return _sigmoid(self._logits(self._standard(rows)) / self.temperature)


class Constant:
    """The share of label 1, where there is nothing to tell the labels apart."""

    def __init__(self, share):
        self.share = share

    def predict(self, rows):
        return np.full(len(rows), self.share)


def _sigmoid(x):
    return 0.5 * (1 + np.tanh(x / 2))


def _loss(logits, y):
    return float(np.mean(np.logaddexp(0, logits) - y * logits))


def held_out(row_id, parts=4, part=2):
    """Rows whose labels are not learned from; so are rows without an id."""
    return F.coalesce(F.crc32(F.col(row_id).cast("string")) % parts == part, F.lit(True))


class QualityModel:
    """Word vectors of a corpus and the network fitted on its labelled rows."""

    def __init__(self, vectors, network):
        self.vectors, self.network = vectors, network

    def predict(self, texts: pa.Array) -> np.ndarray:
        scores = [self.network.predict(features(few, self.vectors)) for few in _few(texts)]
        return np.concatenate([np.zeros(0), *scores])

    def score(self, df: DataFrame, text="text", into="score") -> DataFrame:
        """`df` with the probability of label 1; a column named like `into` is replaced."""
        model = df.sparkSession.sparkContext.broadcast(self)

        @F.arrow_udf(returnType=T.DoubleType())
        def probability(column: pa.Array) -> pa.Array:
            return pa.array(model.value.predict(column), pa.float64())

        return df.withColumn(into, probability.asNondeterministic()(F.col(text).cast("string")))


def fit_quality(df: DataFrame, labels: DataFrame, text="text", row_id="doc_id", label="quality", most=MAX_LABELLED) -> QualityModel:
    """A model learned from all texts of `df` and the labels of rows not held out.

    At most `most` labelled rows are used, the first by a hash of their id. Rows
    without an id or label teach nothing. Without labels of both kinds the score is
    the share of label 1, and 0.5 without any.
    """
    known = labels.select(F.col(row_id).alias("id"), F.col(label).cast("int").alias("y"))
    known = known.where(~held_out("id") & F.col("y").isin(0, 1))
    sample = known.orderBy(F.xxhash64("id", F.lit("label")), "id", "y").limit(most)
    vectors = word_vectors(df, text)
    spark = df.sparkSession
    model = spark.sparkContext.broadcast(vectors)

    @F.arrow_udf(returnType=T.ArrayType(T.FloatType()))
    def described(column: pa.Array) -> pa.Array:
        rows = [features(few, model.value) for few in _few(column)]
        return pa.array(list(np.concatenate(rows)) if rows else [], pa.list_(pa.float32()))

    # at most `most` rows of ids and labels
    texts = df.select(F.col(row_id).alias("id"), F.col(text).cast("string").alias("t")).join(F.broadcast(sample), "id")
    rows = texts.select("id", "y", described.asNondeterministic()("t").alias("x"))
    rows = rows.orderBy(F.xxhash64("id", F.lit("label")), "id", "y").limit(most).toArrow()
    y = rows.column("y").to_numpy()
    if len(set(y.tolist())) < 2:
        return QualityModel(vectors, Constant(float(y.mean()) if len(y) else 0.5))
    x = rows.column("x").combine_chunks().flatten().to_numpy().reshape(len(y), -1).astype(np.float64)
    return QualityModel(vectors, Network(x, y))


def quality_scores(df: DataFrame, labels: DataFrame, text="text", row_id="doc_id", threshold=THRESHOLD) -> DataFrame:
    """`row_id, held_out, score, predicted` of every row.

    Null, empty and blank texts are scored as texts without words. Repeated rows
    have the same score. No rows: no rows. Other columns are not read.
    """
    scored = fit_quality(df, labels, text, row_id).score(df.select(row_id, text), text, "score")
    predicted = (F.col("score") >= threshold).cast("int")
    return scored.select(row_id, held_out(row_id).alias("held_out"), "score", predicted.alias("predicted"))


def keep_good(df: DataFrame, labels: DataFrame, threshold=THRESHOLD) -> DataFrame:
    """Rows with a score of at least `threshold`, unchanged.

    All rows stay where the labels are of one kind only, or there are none.
    """
    model = fit_quality(df, labels)
    if isinstance(model.network, Constant):
        return df
    score = unused_name("score", df.columns)
    return model.score(df, into=score).where(F.col(score) >= threshold).drop(score)
