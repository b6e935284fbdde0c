"""Histogram sort of documents into shards of near-equal bytes.

The sort key of a document is a text of hexadecimal digits: the CRC-32 of its
text, then a hash of its id, so equal texts stand side by side and a group of any
size can still be cut. Rounds count the exact bytes below probes across all
partitions: first the keys by their first digits, then, only inside intervals
that hold a splitter and are not yet within tolerance, by two digits more. When
all splitters meet the tolerance, every row finds its shard from the literal
splitters, and one exchange numbers the rows of each shard.

DataFrame functions only; the driver gets at most 4,096 counts, then 256 for each
splitter and round.
"""

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from prefboard.session import materialise

FIRST_DIGITS = 3
MORE_DIGITS = 2
KEY_DIGITS = 8 + 16
SLOT_PARTS = 64


def with_keys(df: DataFrame, text="text", row_id="doc_id", overhead=16) -> DataFrame:
    """`df` with `size`, `text_crc32` and `sort_key`; null texts count as empty."""
    encoded = F.encode(F.coalesce(F.col(text).cast("string"), F.lit("")), "UTF-8")
    crc = F.crc32(encoded)
    own = F.xxhash64(F.col(row_id), F.lit("shard"))
    return df.withColumns(
        {
            "size": (F.octet_length(encoded) + F.lit(overhead)).cast("long"),
            "text_crc32": crc,
            "sort_key": F.lower(F.concat(F.lpad(F.hex(crc), 8, "0"), F.lpad(F.hex(own), 16, "0"))),
        }
    )


def find_splitters(keys: DataFrame, shards: int, tolerance=0.001) -> list:
    """`shards - 1` ascending keys; each is the lower bound of a shard.

    `keys` has `sort_key, size` and is read once a round, so it should be a written
    table. A splitter is settled when the bytes below it miss its target by at most
    `tolerance` of a shard, or when one key holds what is left. No rows: no bytes
    to cut, every splitter is the empty key.
    """
    digits = FIRST_DIGITS
    sums = {
        r["p"]: r["b"]
        for r in keys.groupBy(F.substring("sort_key", 1, digits).alias("p")).agg(F.sum("size").alias("b")).collect()
    }
    total = sum(sums.values())
    if not total:
        return [""] * (shards - 1)
    allowed = tolerance * total / shards
    found, open_targets = {}, {}

    def narrow(prefix_sums, start, targets):
        """Settles targets inside one histogram, or names the bin they fall in."""
        below, waiting = start, sorted(targets)
        for prefix in sorted(prefix_sums):
            above = below + prefix_sums[prefix]
            while waiting and targets_bytes[waiting[0]] <= above:
                target = waiting.pop(0)
                wanted = targets_bytes[target]
                nearest = min(wanted - below, above - wanted)
                if nearest <= allowed or digits >= KEY_DIGITS:
                    # "g" is behind every key with this prefix
                    found[target] = prefix if nearest == wanted - below else prefix + "g"
                else:
                    open_targets.setdefault(prefix, (below, []))[1].append(target)
            below = above

    targets_bytes = {k: total * k / shards for k in range(1, shards)}
    narrow(sums, 0, list(targets_bytes))
    while open_targets:
        inside = F.substring("sort_key", 1, digits).isin(*open_targets)
        digits = min(digits + MORE_DIGITS, KEY_DIGITS)
        finer = keys.where(inside).groupBy(F.substring("sort_key", 1, digits).alias("p")).agg(F.sum("size").alias("b"))
        histograms = {}
        for r in finer.collect():
            parent = next(p for p in open_targets if r["p"].startswith(p))
            histograms.setdefault(parent, {})[r["p"]] = r["b"]
        before, open_targets = open_targets, {}
        for parent, (below, targets) in before.items():
            narrow(histograms[parent], below, targets)
    return [found[k] for k in sorted(found)]


def shard_of(splitters) -> Column:
    """Number of the shard of `sort_key`, from the literal splitters."""
    bounds = F.array(*[F.lit(s) for s in splitters]) if splitters else F.array().cast("array<string>")
    return F.size(F.filter(bounds, lambda s: s <= F.col("sort_key"))).cast("int")


def with_slots(keyed: DataFrame, row_id="doc_id") -> DataFrame:
    """`slot` per row, gapless from 0 in each `shard`; the one exchange.

    A shard's rows are numbered in 64 parts by a hash of their id and begin where
    the counts of the parts before them end, so no task orders a whole shard.
    """
    part = F.pmod(F.xxhash64(F.col(row_id), F.lit("slot")), F.lit(SLOT_PARTS)).cast("int")
    parted = keyed.withColumn("__part", part)
    counts = parted.groupBy("shard", "__part").agg(F.count(F.lit(1)).alias("__n"))
    before = F.sum("__n").over(W.partitionBy("shard").orderBy("__part").rowsBetween(W.unboundedPreceding, -1))
    # at most shards x 64 rows
    starts = F.broadcast(counts.select("shard", "__part", F.coalesce(before, F.lit(0)).alias("__before")))
    number = F.row_number().over(W.partitionBy("shard", "__part").orderBy("sort_key", row_id))
    numbered = parted.withColumn("__number", number).join(starts, ["shard", "__part"])
    return numbered.withColumn("slot", F.col("__before") + F.col("__number") - 1).drop("__part", "__before", "__number")


def shard_documents(df: DataFrame, shards=40, text="text", row_id="doc_id", tolerance=0.001) -> DataFrame:
    """`row_id, size, text_crc32, sort_key, shard, slot` of every row.

    Shards are consecutive key ranges of near-equal bytes; a size is the UTF-8 bytes
    of the text plus 16. Null and empty texts have size 16. Equal texts follow each
    other and are only parted where a shard ends among them. Repeated rows (same id
    and text) have one key and share a shard. No rows: no rows. Other columns are
    not read; a clash of names cannot arise, texts are joined back by id if needed.
    """
    keys = materialise(with_keys(df.select(row_id, text), text, row_id).drop(text), "shard-keys")
    splitters = find_splitters(keys, shards, tolerance)
    return with_slots(keys.withColumn("shard", shard_of(splitters)), row_id)
