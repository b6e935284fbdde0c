"""Language-model scores of texts by context-tree weighting.

A byte is eight binary decisions, each at a node named by the bits before it and by
the last 0 to `LONGEST` bytes of the text. A node estimates its bit with the
Krichevsky-Trofimov rule; its weighted probability is half its own estimate and
half the product over its longer contexts, so all depths are mixed. Trained once,
the mixture gives a code length for every byte in every context.

Every context that occurs is a node. The tree is a table of the byte runs (a context
and the byte behind it) of all texts, those of texts that are only scored with a count
of 0. It is weighted upwards and mixed downwards in subtrees below three bytes,
which Spark deals to tasks; what is above them is a second, smaller table. A text's
score is the sum over its runs: frequent ones, `MAX_FREQUENT_RUNS` at most, are looked
up in the task, all others are joined. That bound decides where a run is looked up and
never what it is worth.

`train` builds the model of contexts up to `DEPTH` bytes as one table, without those
that make up less than one in `max_contexts` of all training bytes.

The unigram base score treats words alike: frequent ones, `MAX_FREQUENT_WORDS` at most,
are looked up in the task, all others are joined. Words are told apart by 64-bit hashes.
"""

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from prefboard.functions.portions import portions as column_portions
from prefboard.llm.texts import bytes_by_portions, hashed_spaced_words, portions
from prefboard.session import materialise

DEPTH = 4
#: Bytes of the longest contexts that texts are scored with; a run of seven bytes fits a long.
LONGEST = 5
#: Subtrees below contexts of so many bytes are worked on as a whole.
CUT = 3
MAX_CONTEXTS = 1 << 16
MAX_FREQUENT_RUNS = 1 << 22
MAX_FREQUENT_WORDS = 1_000_000
#: Ends a text and fills the context before its first byte; UTF-8 never has it.
END = 0xFF
_WORDS, _GRAMS = 0, 1
#: What makes up one in so many times the bound is held too, if that keeps to the bound.
MORE = (16, 8, 4, 2, 1)
#: Distinct keys a task gathers before it merges them, and sends them on.
GATHERED = 1 << 19
#: Bytes of texts worked on at once; arrays of their runs stay in the processor's cache.
PORTION = 1 << 18
#: Keys that are sorted at once.
SORTED = 1 << 20


def stream(texts: list, depth=DEPTH):
    """Bytes of texts with ends, and the places to be predicted in it.

    Every text is followed by its end, which is predicted, and by `depth - 1` more, so
    that the next one begins in the context of ends alone.
    """
    gap = bytes([END]) * depth
    data = np.frombuffer(gap + gap.join(texts) + gap, np.uint8)
    lengths = np.fromiter(map(len, texts), np.int64, len(texts))
    ends = np.cumsum(lengths + depth)
    wanted = np.ones(len(data), bool)
    wanted[:depth] = False
    for behind in range(1, depth):
        wanted[ends + behind] = False
    return data, np.flatnonzero(wanted), lengths + 1


def runs(data: np.ndarray, places: np.ndarray, depth=DEPTH) -> np.ndarray:
    """Each place's byte and the bytes before it as one number: the byte lowest, the
    nearest of the others highest, so that sorted runs stand in the order of the tree."""
    out = data.astype(np.int64)
    for back in range(1, depth + 1):
        out[back:] |= data[:-back].astype(np.int64) << 8 * (depth - back + 1)
    return out[places]


class _Counts:
    """Distinct keys with their counts, merged when many have gathered."""

    def __init__(self, most=GATHERED):
        self._parts, self._size, self._most = [], 0, most
        self._raw = {0: [], 1: []}

    def add(self, keys, times=1):
        """`keys`, each counted so often, 0 or 1."""
        if len(keys):
            self._raw[times].append(keys)
        if sum(map(len, self._raw[times])) >= SORTED:
            self._sort(times)

    def _sort(self, times):
        raw, self._raw[times] = self._raw[times], []
        if sum(map(len, raw)):
            distinct, counts = np.unique(np.concatenate(raw), return_counts=True)
            self._parts.append((distinct, counts * times))
            self._size += len(distinct)
            if self._size > self._most and len(self._parts) > 1:
                self._merge()

    def _merge(self):
        keys = np.concatenate([k for k, _ in self._parts])
        counts = np.concatenate([n for _, n in self._parts])
        distinct, where = np.unique(keys, return_inverse=True)
        merged = np.bincount(where, counts, len(distinct)).astype(np.int64)
        self._parts, self._size = [(distinct, merged)], len(distinct)

    def taken(self, more_than=None):
        """What was gathered, if that is more than so many keys; then starts anew.

        Without a number everything is given, if there is anything.
        """
        if more_than is None:
            more_than = 0
            for times in self._raw:
                self._sort(times)
        if self._size <= more_than:
            return None
        self._merge()
        if self._size <= more_than:
            return None
        (keys, counts), self._parts, self._size = self._parts[0], [], 0
        return keys.view(np.int64), counts


_COUNTED = pa.schema([("kind", pa.int32()), ("key", pa.int64()), ("n", pa.int64())])


def _rows(kind, counted):
    keys, counts = counted
    for start in range(0, len(keys), 100_000):
        k, n = keys[start : start + 100_000], counts[start : start + 100_000]
        yield pa.record_batch([pa.array(np.full(len(k), kind, np.int32)), pa.array(k), pa.array(n)], schema=_COUNTED)


def _count(batches, depth):
    """Counts of words and of byte runs; a task sends each about once."""
    words, grams = _Counts(), _Counts()
    for batch in batches:
        for texts, learned in column_portions(batch.column(0).cast(pa.binary()), batch.column(1)):
            texts = [t or b"" for t in texts]
            for first, last in portions(texts, PORTION):
                for times in (1, 0):
                    part = [t for t, yes in zip(texts[first:last], learned[first:last]) if yes == times]
                    if times:
                        words.add(hashed_spaced_words(part)[0])
                    if part:
                        grams.add(runs(*stream(part, depth)[:2], depth), times)
            for kind, counts in ((_WORDS, words), (_GRAMS, grams)):
                if (counted := counts.taken(GATHERED)) is not None:
                    yield from _rows(kind, counted)
    for kind, counts in ((_WORDS, words), (_GRAMS, grams)):
        if (counted := counts.taken()) is not None:
            yield from _rows(kind, counted)


def corpus_counts(df: DataFrame, text="text", learned=None, depth=DEPTH) -> DataFrame:
    """`kind, key, n` over all texts: word hashes, and byte runs of the streams.

    Of rows that are not `learned` (a condition) only the runs are given, with 0.
    """
    learned = F.lit(True) if learned is None else learned
    texts = df.select(F.col(text).cast("string"), learned)
    parts = texts.mapInArrow(lambda batches: _count(batches, depth), "kind int, key long, n long")
    return materialise(parts.groupBy("kind", "key").agg(F.sum("n").alias("n")), "corpus-counts")


def context_counts(counts: DataFrame, max_contexts=MAX_CONTEXTS) -> DataFrame:
    """`depth, context, symbol, n` of all frequent contexts of depth 0 to 4.

    A context is a number with its nearest byte lowest.
    """
    grams = counts.where(F.col("kind") == _GRAMS)
    total = grams.agg(F.sum("n")).first()[0] or 0
    depths = F.explode(F.array(*[F.lit(d) for d in range(DEPTH + 1)])).alias("depth")
    spread = grams.select("key", "n", depths)
    context = F.lit(0).cast("long")
    for back in range(1, DEPTH + 1):
        byte = F.shiftright("key", 8 * (DEPTH - back + 1)).bitwiseAND(255)
        context += F.when(F.col("depth") >= back, F.shiftleft(byte, 8 * (back - 1))).otherwise(0)
    symbols = (
        spread.select("depth", context.alias("context"), F.col("key").bitwiseAND(255).cast("int").alias("symbol"), "n")
        .groupBy("depth", "context", "symbol")
        .agg(F.sum("n").alias("n"))
    )
    symbols = materialise(symbols, "context-symbols")
    sizes = symbols.groupBy("depth", "context").agg(F.sum("n").alias("all"))
    frequent = sizes.where((F.col("all") * max_contexts >= total) | (F.col("depth") == 0)).drop("all")
    return materialise(symbols.join(materialise(frequent, "contexts"), ["depth", "context"]), "context-counts")


def _log_gamma(x):
    """Stirling's series, shifted to where it is exact to 1e-12."""
    low = np.zeros_like(x)
    for k in range(8):
        low += np.log(x + k)
    y = x + 8
    return (y - 0.5) * np.log(y) - y + 0.5 * math.log(2 * math.pi) + 1 / (12 * y) - 1 / (360 * y**3) + 1 / (1260 * y**5) - low


def _bits(symbols: np.ndarray):
    """Zeros and ones at the 255 inner nodes of each row's byte tree (heap order)."""
    tree = np.zeros((len(symbols), 512))
    tree[:, 256:] = symbols
    for node in range(255, 0, -1):
        tree[:, node] = tree[:, 2 * node] + tree[:, 2 * node + 1]
    return tree[:, 2::2][:, :255], tree[:, 3::2][:, :255]


def _log_kt(zeros, ones):
    """Log of the probability that the estimator gives to the counts, in any order."""
    return _log_gamma(zeros + 0.5) + _log_gamma(ones + 0.5) - _log_gamma(zeros + ones + 1) - math.log(math.pi)


def _kt_one(zeros, ones):
    return (ones + 0.5) / (zeros + ones + 1)


def _codes(one):
    """Log10 probability of every byte, from the probability of a one at each node."""
    logs = np.zeros((len(one), 512))
    zero, one = np.log10(1 - one), np.log10(one)
    for node in range(1, 256):
        logs[:, 2 * node] = logs[:, node] + zero[:, node - 1]
        logs[:, 2 * node + 1] = logs[:, node] + one[:, node - 1]
    return logs[:, 256:].astype("<f4")


class Subtree:
    """The contexts that end in one byte, from depth 1 down, with their weights."""

    def __init__(self, depth, context, symbol, n):
        self.contexts, self.bits, self.rest = {}, {}, {}
        tables = {}
        for d in range(1, DEPTH + 1):
            at = depth == d
            self.contexts[d], row = np.unique(context[at], return_inverse=True)
            tables[d] = np.zeros((len(self.contexts[d]), 256))
            tables[d][row, symbol[at]] = n[at]
        self.parent, self.log_weighted, self.stay = {}, {}, {}
        children = None
        for d in range(DEPTH, 0, -1):
            self.bits[d] = _bits(tables[d])
            own = _log_kt(*self.bits[d])
            if d == DEPTH:
                self.log_weighted[d] = own
            else:
                below = self.contexts[d + 1] & ((1 << 8 * d) - 1)
                self.parent[d + 1] = np.searchsorted(self.contexts[d], below)
                pooled = tables[d].copy()
                np.subtract.at(pooled, self.parent[d + 1], tables[d + 1])
                self.rest[d] = _bits(pooled)
                children = _log_kt(*self.rest[d])
                np.add.at(children, self.parent[d + 1], self.log_weighted[d + 1])
                self.log_weighted[d] = np.logaddexp(own, children) - math.log(2)
                self.stay[d] = np.exp(own - math.log(2) - self.log_weighted[d])

    def codes(self, mixed, left):
        """`(depth, contexts, codes)` given what the empty context mixes in and leaves."""
        mixed, left = mixed[None, :].repeat(len(self.contexts[1]), 0), left[None, :].repeat(len(self.contexts[1]), 0)
        for d in range(1, DEPTH + 1):
            if d > 1:
                mixed, left = mixed[self.parent[d]], left[self.parent[d]]
            one = _kt_one(*self.bits[d])
            if d == DEPTH:
                yield d, self.contexts[d], _codes(mixed + left * one)
            else:
                mixed, left = mixed + left * self.stay[d] * one, left * (1 - self.stay[d])
                yield d, self.contexts[d], _codes(mixed + left * _kt_one(*self.rest[d]))


def _subtree(table: pa.Table) -> Subtree:
    return Subtree(*[table.column(c).to_numpy() for c in ("depth", "context", "symbol", "n")])


def _weights_of(table: pa.Table) -> pa.Table:
    weighted = _subtree(table).log_weighted[1]
    return pa.table({"node": np.tile(np.arange(255), len(weighted)), "log_weighted": weighted.ravel()})


def train(counts: DataFrame, max_contexts=MAX_CONTEXTS):
    """`(keys, codes)` of the model: a row of 256 log10 probabilities per context.

    The subtrees below each last byte are weighted in parallel. The driver gets 256
    counts, 255 sums, and the finished rows: at most 1 + 256 + 3 x `max_contexts`.
    """
    rows = context_counts(counts, max_contexts)
    deeper = rows.where("depth > 0").withColumn("last", F.col("context").bitwiseAND(255))
    zero, first = np.zeros((1, 256)), np.zeros((1, 256))
    for r in rows.where("depth = 0").select("symbol", "n").collect():
        zero[0, r["symbol"]] = r["n"]
    for r in rows.where("depth = 1").groupBy("symbol").agg(F.sum("n").alias("n")).collect():
        first[0, r["symbol"]] = r["n"]
    rest, own_bits = _bits(zero - first), _bits(zero)
    children = _log_kt(*rest)[0]
    weights = deeper.groupBy("last").applyInArrow(_weights_of, "node long, log_weighted double")
    for r in weights.groupBy("node").agg(F.sum("log_weighted").alias("s")).collect():
        children[r["node"]] += r["s"]
    own = _log_kt(*own_bits)[0]
    stay = np.exp(own - np.logaddexp(own, children))
    mixed, left = stay * _kt_one(*own_bits)[0], 1 - stay

    def finished(table: pa.Table) -> pa.Table:
        keys, codes = [], []
        for depth, at, found in _subtree(table).codes(mixed, left):
            keys.append(at | depth << 32)
            codes += [row.tobytes() for row in found]
        return pa.table({"key": np.concatenate(keys), "codes": pa.array(codes, pa.binary())})

    model = materialise(deeper.groupBy("last").applyInArrow(finished, "key long, codes binary"), "model").toArrow()
    keys = np.concatenate([[0], model.column("key").to_numpy()]).astype(np.int64)
    body = b"".join(model.column("codes").to_pylist())
    codes = np.concatenate([_codes((mixed + left * _kt_one(*rest)[0])[None, :]), np.frombuffer(body, "<f4").reshape(-1, 256)])
    order = np.argsort(keys)
    return keys[order], codes[order]


class ContextRows:
    """Row of the longest known context, remembered in a table of fixed size."""

    BITS = 20

    def __init__(self, keys):
        self._keys = keys
        self._known = np.zeros(1 << self.BITS, np.uint32)
        self._row = np.full(1 << self.BITS, -1, np.int32)

    def find(self, wanted: np.ndarray) -> np.ndarray:
        slots = (wanted * np.uint32(2654435761)) >> np.uint32(32 - self.BITS)
        rows = self._row[slots]
        missing = np.flatnonzero((self._known[slots] != wanted) | (rows < 0))
        if len(missing):
            new, where = np.unique(wanted[missing], return_inverse=True)
            found = self._search(new)
            rows[missing] = found[where]
            slots = (new * np.uint32(2654435761)) >> np.uint32(32 - self.BITS)
            self._known[slots], self._row[slots] = new, found
        return rows

    def _search(self, wanted):
        found = np.full(len(wanted), -1, np.int32)
        for depth in range(DEPTH, -1, -1):
            keys = (wanted.astype(np.int64) & ((1 << 8 * depth) - 1)) | depth << 32
            at = np.minimum(np.searchsorted(self._keys, keys), len(self._keys) - 1)
            hit = (found < 0) & (self._keys[at] == keys)
            found[hit] = at[hit]
        return found


class _Branch:
    """Nodes of the contexts below some, at one bit of the byte, level by level.

    A node's name is its context, nearest byte highest, with the bits before its own
    behind it. The nodes of the deepest level are given, in any order.
    """

    def __init__(self, bit, names, zeros, ones, log_weighted, levels):
        self.names, self.zeros, self.ones, self.log_weighted = names, zeros, ones, log_weighted
        self._above = []
        low = (1 << bit) - 1
        for _ in range(levels):
            shorter = self.names >> bit + 8 << bit | self.names & low
            self.names, parent = np.unique(shorter, return_inverse=True)
            size = len(self.names)
            children = np.bincount(parent, self.log_weighted, size)
            self.zeros, self.ones = np.bincount(parent, self.zeros, size), np.bincount(parent, self.ones, size)
            own = _log_kt_counted(self.zeros, self.ones)
            self.log_weighted = np.logaddexp(own, children) - math.log(2)
            stay = np.exp(own - math.log(2) - self.log_weighted)
            self._above.append((parent, stay, _kt_one(self.zeros, self.ones)))

    def descend(self, mixed, left):
        """What the deepest nodes get of the shorter contexts, given what the highest do."""
        for parent, stay, one in reversed(self._above):
            mixed, left = mixed + left * stay * one, left * (1 - stay)
            mixed, left = mixed[parent], left[parent]
        return mixed, left


#: Counts below this have the logs of their gamma functions in a table.
_SMALL = 1 << 12
_HALF, _WHOLE = _log_gamma(np.arange(_SMALL) + 0.5), _log_gamma(np.arange(_SMALL) + 1.0)


def _log_kt_counted(zeros, ones):
    """`_log_kt` of whole counts, mostly small ones."""
    both = zeros + ones
    small = both < _SMALL
    z, o = np.where(small, zeros, 0).astype(np.int64), np.where(small, ones, 0).astype(np.int64)
    out = _HALF[z] + _HALF[o] - _WHOLE[z + o] - math.log(math.pi)
    large = np.flatnonzero(~small)
    out[large] = _log_kt(zeros[large], ones[large])
    return out


def _subtrees(batches, subtree):
    """Columns of whole subtrees, many at once; rows come sorted by `subtree(columns)`."""
    parts, size, most = [], 0, _ROWS
    for batch in batches:
        parts.append([c.to_numpy(zero_copy_only=False) for c in batch.columns])
        size += batch.num_rows
        if size < most:
            continue
        columns = [np.concatenate(c) for c in zip(*parts)]
        whose = subtree(columns)
        whole = np.searchsorted(whose, whose[-1])
        if whole:
            yield [c[:whole] for c in columns]
        parts, size = [[c[whole:] for c in columns]], len(whose) - whole
        most = max(_ROWS, 2 * size)
    if size:
        yield [np.concatenate(c) for c in zip(*parts)]


#: Rows of subtrees worked on together, if one subtree has no more.
_ROWS = 1 << 17


def _leaves(keys, n, depth):
    """Per bit of the byte: the bit, where each run's node is, the runs' bits, the branch up to the cut."""
    for bit in range(8):
        names = keys >> 8 - bit
        new = np.ones(len(names), bool)
        new[1:] = names[1:] != names[:-1]
        at = np.cumsum(new) - 1
        is_one = (keys >> 7 - bit & 1).astype(bool)
        zeros, ones = np.bincount(at, np.where(is_one, 0, n)), np.bincount(at, np.where(is_one, n, 0))
        yield bit, at, is_one, zeros, ones, _Branch(bit, names[new], zeros, ones, _log_kt_counted(zeros, ones), depth - CUT)


def _node_rows(names, *columns):
    """A batch of `at, node` and further columns, from names at each bit."""
    at = np.concatenate([ns >> bit for bit, ns in enumerate(names)])
    node = np.concatenate([ns & (1 << bit) - 1 | 1 << bit for bit, ns in enumerate(names)])
    return [pa.array(c) for c in (at, node, *[np.concatenate(c) for c in columns])]


_WEIGHED = ["at", "node", "zeros", "ones", "log_weighted"]


def _weigh(depth):
    def weigh(batches):
        for keys, n in _subtrees(batches, lambda columns: columns[0] >> 8 * (depth - CUT + 1)):
            tops = [branch for *_, branch in _leaves(keys, n, depth)]
            columns = [[getattr(b, name) for b in tops] for name in ("zeros", "ones", "log_weighted")]
            yield pa.RecordBatch.from_arrays(_node_rows([b.names for b in tops], *columns), _WEIGHED)

    return weigh


def _upper(table: pa.Table):
    """Per bit: the branch from the cut up to contexts of one byte, and the names at the cut."""
    at, node, zeros, ones, log_weighted = [table.column(c).to_numpy() for c in _WEIGHED]
    for bit in range(8):
        here = node >> bit == 1
        names = at[here] << bit | node[here] & (1 << bit) - 1
        yield names, _Branch(bit, names, zeros[here], ones[here], log_weighted[here], CUT - 1)


def _weigh_upper(table: pa.Table) -> pa.Table:
    tops = [branch for _, branch in _upper(table)]
    columns = [[getattr(b, name) for b in tops] for name in ("zeros", "ones", "log_weighted")]
    return pa.Table.from_arrays(_node_rows([b.names for b in tops], *columns), _WEIGHED)


def _mix_upper(mixed, left):
    def mix(table: pa.Table) -> pa.Table:
        names, columns = [], ([], [])
        for bit, (own, branch) in enumerate(_upper(table)):
            node = branch.names & (1 << bit) - 1 | 1 << bit
            names.append(own)
            for column, values in zip(columns, branch.descend(mixed[node], left[node])):
                column.append(values)
        return pa.Table.from_arrays(_node_rows(names, *columns), ["at", "node", "mixed", "left"])

    return mix


def _finish(depth):
    """Log10 probability of every run; a subtree's nodes come before its runs."""

    def finish(batches):
        for at, key, n, node, mixed, left in _subtrees(batches, lambda columns: columns[0]):
            given, keys = key < 0, key[key >= 0]
            logs = np.zeros(len(keys))
            for bit, where, is_one, zeros, ones, branch in _leaves(keys, n[~given], depth):
                here = np.flatnonzero(given)[node[given] >> bit == 1]
                names = at[here] << bit | node[here] & (1 << bit) - 1
                here = here[np.argsort(names)]
                m, l = branch.descend(mixed[here], left[here])
                one = (m + l * _kt_one(zeros, ones))[where]
                logs += np.log10(np.where(is_one, one, 1 - one))
            arrays = [pa.array(keys), pa.array(n[~given]), pa.array(logs.astype(np.float32))]
            yield pa.RecordBatch.from_arrays(arrays, ["key", "n", "log"])

    return finish


def run_logs(counts: DataFrame, depth=LONGEST) -> DataFrame:
    """`key, n, log` of every byte run: its log10 probability in the whole context tree.

    The driver gets 255 sums; the nodes of contexts up to three bytes are a table.
    """
    grams = counts.where(F.col("kind") == _GRAMS).select("key", "n")
    at = F.shiftright("key", 8 * (depth - CUT + 1))
    weighed = grams.repartition(at).sortWithinPartitions("key").mapInArrow(
        _weigh(depth), "at long, node long, zeros double, ones double, log_weighted double"
    )
    weighed = materialise(weighed, "nodes").withColumn("last", F.shiftright("at", 8 * (CUT - 1)))
    upper = weighed.groupBy("last").applyInArrow(
        _weigh_upper, "at long, node long, zeros double, ones double, log_weighted double"
    )
    mixed, left = np.zeros(256), np.ones(256)
    sums = upper.groupBy("node").agg(*[F.sum(c).alias(c) for c in _WEIGHED[2:]])
    for r in sums.collect():
        zeros, ones = np.array([r["zeros"]]), np.array([r["ones"]])
        own = _log_kt(zeros, ones)
        stay = np.exp(own - np.logaddexp(own, r["log_weighted"]))
        mixed[r["node"]], left[r["node"]] = (stay * _kt_one(zeros, ones))[0], 1 - stay[0]
    above = weighed.groupBy("last").applyInArrow(_mix_upper(mixed, left), "at long, node long, mixed double, left double")
    nothing, number = F.lit(0).cast("long"), F.lit(0.0)
    rows = grams.select(at.alias("at"), "key", "n", nothing.alias("node"), number.alias("mixed"), number.alias("left"))
    rows = rows.unionByName(above.withColumns({"key": F.lit(-1).cast("long"), "n": nothing}))
    done = rows.repartition("at").sortWithinPartitions("at", "key").mapInArrow(_finish(depth), "key long, n long, log float")
    return materialise(done, "run-logs")


class Held:
    """Values of the frequent keys, the latter of the given ones found sooner.

    A key stands at its own slot or at the next free one behind it; at least half of
    the slots are free.
    """

    def __init__(self, keys, values):
        self._bits = (2 * len(keys) - 1).bit_length()
        self._key = np.zeros(1 << self._bits, np.int64)
        self._value = np.full(1 << self._bits, np.nan, values.dtype)
        at = self._slots(keys)
        while len(keys):
            free = np.isnan(self._value[at])
            # of several keys of one slot the last one stays, in both tables
            self._key[at[free]], self._value[at[free]] = keys[free], values[free]
            lost = self._key[at] != keys
            keys, values, at = keys[lost], values[lost], self._next(at[lost])

    def _slots(self, wanted):
        mixed = wanted.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        return (mixed >> np.uint64(64 - self._bits)).view(np.int64)

    def _next(self, at):
        return at + 1 & len(self._key) - 1

    def find(self, wanted: np.ndarray) -> np.ndarray:
        """The values, not a number for keys that are not held."""
        at = self._slots(wanted)
        values = self._value[at]
        others = np.flatnonzero((self._key[at] != wanted) & ~np.isnan(values))
        at = at[others]
        while len(others):
            at = self._next(at)
            values[others] = found = self._value[at]
            on = (self._key[at] != wanted[others]) & ~np.isnan(found)
            others, at = others[on], at[on]
        return values


def _grouped(keys, owner):
    """`owners, keys, times` of the distinct keys of each owner."""
    order = np.lexsort((keys, owner))
    keys, owner = keys[order], owner[order]
    new = np.ones(len(keys), bool)
    new[1:] = (keys[1:] != keys[:-1]) | (owner[1:] != owner[:-1])
    first = np.flatnonzero(new)
    times = np.diff(np.append(first, len(keys)))
    return owner[first], keys[first], times


def _least(rows: DataFrame, total, most):
    """The count from which on rows are held: `most` of them, if so many make up enough."""
    least = [max(1, -(-total // (most * more))) for more in MORE]
    held = rows.agg(*[F.count(F.when(F.col("n") >= n, 1)) for n in least]).first()
    return next(n for n, rows_held in zip(least, held) if rows_held <= most)


def _held(rows: DataFrame, least, value):
    """`(keys, values)` of the rows with that count or more, the most frequent last."""
    often = rows.where(F.col("n") >= least).select("key", F.col("n").cast("float").alias("often"), F.col(value).alias("value"))
    often = often.toArrow()
    order = np.argsort(often.column("often").to_numpy())
    return [often.column(c).to_numpy()[order] for c in ("key", "value")]


def frequent_runs(logs: DataFrame, max_runs=MAX_FREQUENT_RUNS):
    """`(least count, keys, logs)`; the runs are at most `max_runs`."""
    least = _least(logs, logs.agg(F.sum("n")).first()[0] or 0, max_runs)
    return least, *_held(logs, least, "log")


def frequent_words(counts: DataFrame, max_words=MAX_FREQUENT_WORDS):
    """`(tokens, distinct, least count, hashes, counts)`; the words are at most `max_words`."""
    words = counts.where(F.col("kind") == _WORDS)
    tokens, distinct = words.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count(F.lit(1))).first()
    least = _least(words, tokens, max_words)
    return tokens, distinct, least, *_held(words, least, "n")


def _look_up(texts, known: Held, ends):
    """Per text: tokens, known ones and their sum; its other words, and whose they are.

    `ends`: known (0 or 1) and log10 of the count of the end token.
    """
    hashed, lengths = hashed_spaced_words(texts)
    hashed = hashed.view(np.int64)
    logs = known.find(hashed)
    other = np.flatnonzero(np.isnan(logs))
    owner = np.repeat(np.arange(len(texts)), lengths)
    whose = owner[other]
    n_known = lengths - np.bincount(whose, minlength=len(texts)) + ends[0]
    logs[other] = 0
    sums = np.bincount(owner, logs, len(texts)) + ends[1]
    return lengths + 1, n_known, sums, (hashed[other], whose)


def _look_up_runs(texts, known: Held, depth):
    """Per text the sum over its known runs; its other runs, and whose they are."""
    data, places, lengths = stream(texts, depth)
    keys = runs(data, places, depth)
    logs = known.find(keys)
    other = np.flatnonzero(np.isnan(logs))
    logs[other] = 0
    ends = np.cumsum(lengths)
    sums = np.add.reduceat(logs, ends - lengths, dtype=np.float64)
    return sums, (keys[other], np.searchsorted(ends, other, "right"))


def _other_keys(size, by_kind):
    """Lists of `kind, key, times`, one per text."""
    found = [_grouped(*other) for other in by_kind.values()]
    kinds = np.repeat(np.array(list(by_kind), np.int32), [len(owners) for owners, *_ in found])
    owners, keys, times = [np.concatenate(c) for c in zip(*found)]
    order = np.argsort(owners, kind="stable")
    offsets = np.concatenate([[0], np.cumsum(np.bincount(owners, minlength=size))])
    columns = [pa.array(c[order]) for c in (kinds, keys, times)]
    return pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.StructArray.from_arrays(columns, _OTHERS.names))


_OTHERS = T.StructType(
    [T.StructField("kind", T.IntegerType()), T.StructField("key", T.LongType()), T.StructField("times", T.LongType())]
)
_SCORED = T.StructType(
    [
        T.StructField("n_tokens", T.LongType()),
        T.StructField("n_known", T.LongType()),
        T.StructField("base", T.DoubleType()),
        T.StructField("score", T.DoubleType()),
        T.StructField("others", T.ArrayType(_OTHERS)),
    ]
)


def held_out(row_id, parts=5, part=1):
    """Rows that are not learned from; so are rows without an id."""
    return F.coalesce(F.crc32(F.col(row_id).cast("string")) % parts == part, F.lit(True))


def score_texts(
    df: DataFrame, text="text", row_id="doc_id", max_runs=MAX_FREQUENT_RUNS, max_words=MAX_FREQUENT_WORDS, depth=LONGEST
) -> DataFrame:
    """`row_id, held_out, n_tokens, n_known, train_tokens, base_score, score` of every row.

    Learns from the rows that are not held out. Null and empty texts are one token,
    their end, and are scored as such. Repeated rows are learned from and scored
    each. With nothing to learn from, every bit has probability 1/2. No rows: no
    rows. Other columns are not read. `depth` is 4 to 6; `max_runs` and `max_words`
    bound what a task holds and change no result.
    """
    if not CUT < depth <= 6:
        raise ValueError("contexts have 4 to 6 bytes")
    spark = df.sparkSession
    counts = corpus_counts(df, text, ~held_out(row_id), depth)
    documents = df.where(~held_out(row_id)).count()
    tokens, distinct, least_word, keys, n = frequent_words(counts, max_words)
    tokens, distinct = tokens + documents, distinct + (documents > 0)
    floor = math.log10(tokens + 0.5 * (distinct + 1))
    by_run = run_logs(counts, depth)
    least_run, *frequent = frequent_runs(by_run, max_runs)
    model = spark.sparkContext.broadcast((frequent, (keys, np.log10(n + 0.5))))
    ends = (int(documents > 0), math.log10(documents + 0.5))

    @F.arrow_udf(returnType=_SCORED)
    def score(columns: Iterator[pa.Array]) -> Iterator[pa.Array]:
        known_runs, known_words = [Held(*held) for held in model.value]
        for column in columns:
            out = []
            for texts in bytes_by_portions(column):
                for first, last in portions(texts, PORTION):
                    part = texts[first:last]
                    n_tokens, n_known, sums, words = _look_up(part, known_words, ends)
                    scores, others = _look_up_runs(part, known_runs, depth)
                    lists = _other_keys(len(part), {_WORDS: words, _GRAMS: others})
                    arrays = [pa.array(n_tokens), pa.array(n_known), pa.array(sums), pa.array(scores), lists]
                    out.append(pa.StructArray.from_arrays(arrays, _SCORED.names))
            yield pa.concat_arrays(out) if out else pa.array([], pa.struct([(f, pa.null()) for f in _SCORED.names]))

    scored = df.select(F.col(row_id), score.asNondeterministic()(F.col(text).cast("string")).alias("s"))
    scored = materialise(scored.select(F.monotonically_increasing_id().alias("row"), row_id, "s.*"), "scored")
    rare = counts.where((F.col("kind") == _WORDS) & (F.col("n") < least_word))
    rare = rare.select("kind", "key", "n", F.lit(None).cast("float").alias("log"))
    rare_runs = by_run.where(F.col("n") < least_run)
    rare = rare.unionByName(rare_runs.select(F.lit(_GRAMS).alias("kind"), "key", "n", "log"))
    others = scored.select("row", F.inline("others")).join(rare, ["kind", "key"], "left")
    is_word = F.col("kind") == _WORDS
    more = others.groupBy("row").agg(
        F.sum(F.when(is_word, F.col("times") * F.log10(F.coalesce("n", F.lit(0)) + 0.5))).alias("more"),
        F.sum(F.when(is_word & F.col("n").isNotNull(), F.col("times"))).alias("more_known"),
        F.sum(F.when(~is_word, F.col("times") * F.col("log").cast("double"))).alias("more_score"),
    )
    every = scored.drop("others").join(more, "row", "left")
    return every.select(
        row_id,
        held_out(row_id).alias("held_out"),
        "n_tokens",
        (F.col("n_known") + F.coalesce("more_known", F.lit(0))).alias("n_known"),
        F.lit(int(tokens)).cast("long").alias("train_tokens"),
        (F.col("base") + F.coalesce("more", F.lit(0.0)) - F.col("n_tokens") * F.lit(floor)).alias("base_score"),
        (F.col("score") + F.coalesce("more_score", F.lit(0.0))).alias("score"),
    )
