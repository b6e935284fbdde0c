"""Files whose rows cannot be told from a part of the file alone, read by many tasks.

A byte range of a CSV file does not show whether it begins inside a quoted cell, nor a
range of a very long line at which cell. Both follow from what stands in the ranges
before: every range is summed up, the sums are added up in order, and then every range
is read with its state. Texts never leave their task for that; one summary row per range
(of `spark.sql.files.maxPartitionBytes`) does.
"""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc


def pieces(spark: SparkSession, path, separator, **options) -> DataFrame:
    """`file, start, block, value`: the pieces of all files between separators.

    Pieces of one range are neighbours in one partition, in their order. `block` is a
    hash of file and first byte of the range; `options` are those of Spark's text reader.
    """
    texts = spark.read.options(**options).option("lineSep", separator).text(path)
    where = F.col("_metadata")
    named = texts.select(where["file_path"].alias("file"), where["file_block_start"].alias("start"), "value")
    return named.withColumn("block", F.xxhash64("file", "start"))


def _runs(batches):
    """`(block, values, new)` of neighbouring rows of one block; `new` at its first ones."""
    last = None
    for batch in batches:
        if not len(batch):
            continue
        blocks = batch.column("block").to_numpy()
        starts = np.flatnonzero(np.append(True, blocks[1:] != blocks[:-1]))
        for a, b in zip(starts.tolist(), [*starts[1:].tolist(), len(blocks)]):
            block = int(blocks[a])
            yield block, batch.column("value").slice(a, b - a), block != last
            last = block


class States:
    """What tasks have to know of the ranges: one short row for each, found by its hash."""

    def __init__(self, df: DataFrame, columns):
        rows = df.select("block", *columns).toArrow().sort_by("block")
        self.blocks = rows.column("block").to_numpy()
        if len(np.unique(self.blocks)) < len(self.blocks):
            raise ValueError("two ranges have the same hash")
        self.columns = {c: rows.column(c).to_numpy(zero_copy_only=False) for c in columns}

    def of(self, block):
        at = int(np.searchsorted(self.blocks, block))
        return {name: values[at].item() for name, values in self.columns.items()}


# CSV


def _quotes(values):
    return pc.count_substring(values, '"').to_numpy(zero_copy_only=False).astype(np.int64)


def _sum_quotes(batches):
    """`block, odd, starts`: whether the quotes of a range are odd in number, and whether a
    record starts in it if it begins inside a cell."""
    block, parity, starts = None, 0, False

    def told():
        columns = [pa.array([block], pa.int64()), pa.array([parity], pa.int32()), pa.array([starts], pa.bool_())]
        return pa.record_batch(columns, ["block", "odd", "starts"])

    for current, values, new in _runs(batches):
        if new:
            if block is not None:
                yield told()
            block, parity, starts = current, 0, False
        quotes = _quotes(values)
        before = (parity + np.cumsum(quotes) - quotes) % 2
        starts = starts or bool(before.any())
        parity = int((parity + quotes.sum()) % 2)
    if block is not None:
        yield told()


_RECORDS = T.StructType(
    [
        T.StructField("file_id", T.LongType()),
        T.StructField("owner", T.LongType()),
        T.StructField("at", T.LongType()),
        T.StructField("header", T.BooleanType()),
        T.StructField("record", T.StringType()),
    ]
)


def _records(states):
    """Function of batches: whole records of a range without an `owner`; the last one of
    every range, and what belongs to one that began before, as parts with one."""

    def batch_of(state, owners, at, headers, texts):
        numbers = [pa.array(n, pa.int64()) for n in ([state["file_id"]] * len(texts), owners, at)]
        return pa.record_batch([*numbers, pa.array(headers, pa.bool_()), texts], _RECORDS.names)

    def part(state, owner, at, header, lines):
        return batch_of(state, [owner], [at], [header], pa.array(["\n".join(lines)], pa.string()))

    def run(batches):
        state, parity, open_lines, owner, header = None, 0, [], None, False

        def rest():
            if open_lines:
                yield part(state, owner, state["start"], header, open_lines)

        for block, values, new in _runs(batches):
            if new:
                yield from rest()
                state = states.value.of(block)
                parity, open_lines, owner, header = state["inside"], [], state["owner"], False
                first = state["start"] == 0
            quotes = _quotes(values)
            before = (parity + np.cumsum(quotes) - quotes) % 2
            parity = int((parity + quotes.sum()) % 2)
            starts = np.flatnonzero(before == 0)
            if not len(starts):
                open_lines += values.to_pylist()
                continue
            open_lines += values.slice(0, starts[0]).to_pylist()
            if open_lines and owner == block:  # began in an earlier batch of this range
                yield part(state, None, None, header, open_lines)
            else:
                yield from rest()
            ends = np.append(starts[1:], len(values))
            whole, lines = starts[:-1], ends[:-1] - starts[:-1]
            single = values.take(pa.array(whole[lines == 1]))
            several = ["\n".join(values.slice(a, n).to_pylist()) for a, n in zip(whole[lines > 1], lines[lines > 1])]
            headers = np.zeros(len(whole), bool)
            # single ones come first below
            if first and len(whole):
                headers[0 if lines[0] == 1 else int((lines == 1).sum())] = True
            texts = pa.concat_arrays([single.cast(pa.string()), pa.array(several, pa.string())])
            if len(texts):
                none = [None] * len(texts)
                yield batch_of(state, none, none, headers, texts)
            header = first and not len(whole)
            first = False
            owner, open_lines = block, values.slice(starts[-1]).to_pylist()
        if state is not None:
            yield from rest()

    return run


def csv_records(spark: SparkSession, path, header=True) -> DataFrame:
    """`file_id, file, record`: the records of CSV files as texts, without headers and empty lines.

    A quoted cell may contain line breaks and doubled quotes. One file is read by as many
    tasks as it has ranges.
    """
    lines = pieces(spark, path, "\n")
    flat = lines.select("block", "value")
    summed = flat.mapInArrow(_sum_quotes, "block long, odd int, starts boolean")
    ranges = lines.select("file", "start", "block").distinct().join(summed, "block")
    earlier = W.partitionBy("file").orderBy("start").rowsBetween(W.unboundedPreceding, -1)
    inside = F.coalesce(F.sum("odd").over(earlier), F.lit(0)) % 2
    known = ranges.withColumns({"inside": inside.cast("int"), "file_id": F.xxhash64("file")})
    begun = F.when((F.col("inside") == 0) | F.col("starts"), F.col("block"))
    # the record at the beginning of a range belongs to the last range in which one starts
    known = known.withColumn("owner", F.coalesce(F.last(begun, ignorenulls=True).over(earlier), F.col("block")))
    states = spark.sparkContext.broadcast(States(known, ["file_id", "start", "inside", "owner"]))

    found = flat.mapInArrow(_records(states), _RECORDS)
    whole = found.where("owner is null").select("file_id", "header", "record")
    parts = found.where("owner is not null").groupBy("file_id", "owner").agg(
        F.max("header").alias("header"),
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", "record"))), lambda p: p["record"]), "\n").alias("record"),
    )
    records = whole.unionByName(parts.select("file_id", "header", "record"))
    if header:
        records = records.where(~F.col("header"))
    files = known.select("file_id", "file").distinct()
    # a line break may follow the one that ended the record
    ended = F.when(F.col("record").endswith("\r"), F.expr("left(record, length(record) - 1)")).otherwise(F.col("record"))
    return records.withColumn("record", ended).where("record <> ''").join(files, "file_id").select("file_id", "file", "record")


def read_csv_records(spark: SparkSession, path, schema, header=True) -> DataFrame:
    """CSV files whose quoted cells may contain line breaks, read in ranges.

    A column that a folder `<name>=<value>` names is not looked for in the files.
    """
    fields = (T.StructType.fromDDL(schema) if isinstance(schema, str) else schema).fields
    folders = set(spark.read.text(path).columns)
    stored = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in fields if f.name not in folders)
    row = F.from_csv("record", stored, {"quote": '"', "escape": '"', "mode": "PERMISSIVE"})

    def column(field):
        if field.name not in folders:
            return F.col(f"row.`{field.name}`")
        value = F.url_decode(F.regexp_extract("file", f"/{field.name}=([^/]*)/", 1))
        return F.when(value != "__HIVE_DEFAULT_PARTITION__", value).cast(field.dataType).alias(field.name)

    return csv_records(spark, path, header).withColumn("row", row).select(*[column(f) for f in fields])


# lines of any length


_CELLS = T.StructType(
    [
        T.StructField("file_id", T.LongType()),
        T.StructField("line", T.LongType()),
        T.StructField("place", T.LongType()),
        T.StructField("value", T.StringType()),
    ]
)


def _placed(states):
    def run(batches):
        line = place = file_id = 0
        for block, values, new in _runs(batches):
            if new:
                state = states.value.of(block)
                line, place, file_id = state["line"], state["place"], state["file_id"]
            breaks = pc.count_substring(values, "\n").to_numpy(zero_copy_only=False).astype(np.int64)
            total, n = np.cumsum(breaks), len(values)
            at = np.arange(n)
            broken = np.maximum.accumulate(np.where(breaks > 0, at, -1))
            # place of the last text of a piece, and from it that of its first
            ending = np.where(broken >= 0, at - broken, place + at)
            beginning = np.where(at > 0, np.append(0, ending[:-1]) + 1, place)
            plain = breaks == 0
            columns = [np.full(int(plain.sum()), file_id), (line + total)[plain], ending[plain]]
            cells = values.filter(pa.array(plain))
            lines, places, texts = [], [], []
            for i in np.flatnonzero(~plain).tolist():
                parts = values[i].as_py().split("\n")
                first = line + int(total[i]) - int(breaks[i])
                lines += range(first, first + len(parts))
                places += [int(beginning[i])] + [0] * (len(parts) - 1)
                texts += [p.removesuffix("\r") for p in parts]
            more = (np.full(len(lines), file_id), np.array(lines, np.int64), np.array(places, np.int64))
            columns = [np.append(a, b) for a, b in zip(columns, more)]
            cells = pa.concat_arrays([cells.cast(pa.string()), pa.array(texts, pa.string())])
            yield pa.record_batch([*map(pa.array, columns), cells], _CELLS.names)
            line, place = line + int(total[-1]), int(ending[-1]) + 1

    return run


def read_cells(spark: SparkSession, path, separator=",") -> DataFrame:
    """`file_id, file, line, place, value`: all cells of files without quotes, with their places.

    Lines and cells count from 0. A line may be longer than a task can hold: it is read
    by as many tasks as it has ranges. Empty lines have one empty cell. A separator that
    is the last thing in a file has no cell behind it.
    """
    cells = pieces(spark, path, separator).withColumn("number", F.monotonically_increasing_id())
    breaks = F.length("value") - F.length(F.replace("value", F.lit("\n"), F.lit("")))
    summed = cells.groupBy("file", "start", "block").agg(
        F.count(F.lit(1)).alias("n"),
        F.sum(breaks).alias("breaks"),
        # pieces from the last line break on; the numbers of a range have no gaps
        (F.max("number") - F.max(F.when(breaks > 0, F.col("number"))) + 1).alias("tail"),
    )
    earlier = W.partitionBy("file").orderBy("start").rowsBetween(W.unboundedPreceding, -1)
    sums = summed.withColumns(
        {
            "line": F.coalesce(F.sum("breaks").over(earlier), F.lit(0)),
            "seen": F.coalesce(F.sum("n").over(earlier), F.lit(0)),
            "file_id": F.xxhash64("file"),
        }
    )
    # pieces before the line in work, as each range with a line break leaves them
    begun = F.last(F.when(F.col("breaks") > 0, F.col("seen") + F.col("n") - F.col("tail")), ignorenulls=True).over(earlier)
    known = sums.withColumn("place", F.col("seen") - F.coalesce(begun, F.lit(0)))
    states = spark.sparkContext.broadcast(States(known, ["file_id", "line", "place"]))
    placed = cells.select("block", "value").mapInArrow(_placed(states), _CELLS)
    files = known.select("file_id", "file").distinct()
    return placed.join(files, "file_id")
