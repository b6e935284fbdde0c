"""Near-duplicate embeddings as an exact range join in a metric space.

On the unit sphere a cosine of at least `c` is a distance of at most
r = sqrt(2 - 2c). Pivots, drawn from the vectors of a label, partition these into
cells; a vector's home is the cell of its nearest pivot p. If x and y are at most r
apart and y lives with q, then d(x, q) - d(x, p) <= 2r by the triangle inequality,
and x lies within r of the plane between p and q; where both hold, x is also a
guest of q. Cells are joined independently, in blocks of at most about 2,048
vectors on either side, so a dense cell is spread over tasks.

A block sends on, per vector, how many vectors it is linked with and one link to
the smallest vector that it reaches there: never all pairs.
"""

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from prefboard.llm.components import components
from prefboard.session import materialise

COSINE = 0.93
#: One pivot for about so many vectors, and about so many pivots at most.
CELL = 4096
MAX_PIVOTS = 4096
BLOCK = 2048
_SLACK = 1e-9


def _unit(rows: np.ndarray) -> np.ndarray:
    scaled = rows / np.abs(rows).max(axis=1, keepdims=True)
    return scaled / np.sqrt((scaled * scaled).sum(axis=1, keepdims=True))


def _matrix(column) -> np.ndarray:
    """Vectors of one length as rows, in double precision."""
    array = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return array.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(array), -1)


def comparable(df: DataFrame, row_id, vector, label, *more) -> DataFrame:
    """`id, label, v` of the rows that can be linked at all, with the columns `more`."""
    v = F.col(vector).cast("array<double>")
    finite = F.forall(v, lambda x: F.coalesce(F.abs(x) < F.lit(math.inf), F.lit(False)) & ~F.isnan(x))
    some = F.exists(v, lambda x: x != 0)
    rows = df.select(F.col(row_id).cast("long").alias("id"), F.col(label).alias("label"), v.alias("v"), *more)
    ok = F.col("id").isNotNull() & F.col("label").isNotNull() & F.col("v").isNotNull()
    return rows.where(ok & F.coalesce(finite & some, F.lit(False)))


def choose_pivots(classes: DataFrame, cell=CELL, max_pivots=MAX_PIVOTS) -> dict:
    """Pivots per (label, vector length): about one in `cell` vectors, by hash.

    The share shrinks where that would be more than `max_pivots` of them; results do
    not depend on which or how many are drawn.
    """
    stride = max(cell, -(-classes.count() // max_pivots))
    drawn = classes.where(F.pmod(F.xxhash64("id", F.lit("pivot")), F.lit(stride)) == 0)
    pivots = {}
    for row in drawn.select(F.col("label").cast("string").alias("k"), F.size("v").alias("n"), "v").collect():
        pivots.setdefault((row["k"], row["n"]), []).append(row["v"])
    return {key: _unit(np.array(rows)) for key, rows in pivots.items()}


def _homes_and_guests(units: np.ndarray, pivots, radius: float) -> list:
    """Per vector its home cell, then the later cells it must visit."""
    if pivots is None or len(pivots) == 1:
        return [[0]] * len(units)
    squares = np.maximum(2 - 2 * units @ pivots.T, 0)
    far = np.sqrt(squares)
    home = squares.argmin(axis=1)
    at = np.arange(len(units))
    between = np.sqrt(np.maximum(2 - 2 * pivots @ pivots.T, 0))[home]
    near = far - far[at, home][:, None] <= 2 * radius + _SLACK
    # distance to the plane between the two pivots; equal pivots have none
    near &= squares - squares[at, home][:, None] <= 2 * between * radius + _SLACK
    near &= np.arange(len(pivots)) > home[:, None]
    return [[int(h), *np.flatnonzero(row).tolist()] for h, row in zip(home, near)]


def place(classes: DataFrame, cosine=COSINE, cell=CELL, max_pivots=MAX_PIVOTS) -> DataFrame:
    """`id, copies, label, v, cell, guest`: a row for the home and each visit."""
    radius = math.sqrt(max(0.0, 2 - 2 * cosine)) + _SLACK
    pivots = classes.sparkSession.sparkContext.broadcast(choose_pivots(classes, cell, max_pivots))

    @F.arrow_udf(returnType=T.ArrayType(T.IntegerType()))
    def cells(labels: pa.Array, vectors: pa.Array) -> pa.Array:
        out, keys = [None] * len(labels), {}
        sizes = np.diff(vectors.offsets.to_numpy())
        for at, key in enumerate(zip(labels.to_pylist(), sizes.tolist())):
            keys.setdefault(key, []).append(at)
        for key, rows in keys.items():
            units = _unit(_matrix(vectors.take(pa.array(rows))))
            for at, found in zip(rows, _homes_and_guests(units, pivots.value.get(key), radius)):
                out[at] = found
        return pa.array(out, pa.list_(pa.int32()))

    placed = classes.withColumn("cells", cells.asNondeterministic()(F.col("label").cast("string"), F.col("v")))
    exploded = placed.select("id", "copies", "label", "v", F.posexplode("cells").alias("visit", "cell"))
    return exploded.withColumn("guest", F.col("visit") > 0).drop("visit")


_FOUND = "id long, n long, root long"
_FOUND_SCHEMA = pa.schema([("id", pa.int64()), ("n", pa.int64()), ("root", pa.int64())])


def compare_block(table: pa.Table, cosine: float) -> pa.Table:
    """Links between the rows of two blocks, or inside one (`side` 0 only).

    Per linked vector: how many vectors its partners stand for, and the smallest
    id of those it reaches.
    """
    side = table.column("side").to_numpy()
    table = table.take(pa.array(np.argsort(side, kind="stable")))
    rows, units = _matrix(table.column("v")), None
    ids, copies = table.column("id").to_numpy(), table.column("copies").to_numpy()
    first, units = int((side == 0).sum()), _unit(rows)
    alone = first == len(ids)
    products = units[:first] @ (units if alone else units[first:]).T
    x, y = np.nonzero(products >= cosine - _SLACK)
    edge = np.abs(products[x, y] - cosine) <= _SLACK
    y = y + (0 if alone else first)
    keep = x < y
    # at the threshold itself: the cosine as written
    for k in np.flatnonzero(edge & keep):
        a, b = rows[x[k]], rows[y[k]]
        keep[k] = a @ b / (math.sqrt(a @ a) * math.sqrt(b @ b)) >= cosine
    x, y = x[keep], y[keep]
    counts = np.bincount(x, copies[y], len(ids)) + np.bincount(y, copies[x], len(ids))
    roots = ids.copy()
    while True:
        before = roots.copy()
        np.minimum.at(roots, x, before[y])
        np.minimum.at(roots, y, before[x])
        if np.array_equal(roots, before):
            break
    linked = np.flatnonzero(counts)
    return pa.table([ids[linked], counts[linked].astype(np.int64), roots[linked]], schema=_FOUND_SCHEMA)


def blocks(placed: DataFrame, block=BLOCK) -> DataFrame:
    """Each row once for every pair of blocks it takes part in.

    Pair (i, j): home block i with home block j >= i, or with guest block j - h.
    """
    keys = ["label", "dim", "cell"]
    rows = placed.withColumn("dim", F.size("v"))
    sizes = rows.groupBy(*keys).agg(F.count_if(~F.col("guest")).alias("homes"), F.count_if("guest").alias("guests"))
    parts = lambda n: F.ceil(F.col(n) / block).cast("int")
    sizes = sizes.select(*keys, F.greatest(parts("homes"), F.lit(1)).alias("h"), parts("guests").alias("g"))
    sized = rows.join(materialise(sizes, "cell-sizes"), keys)
    spread = F.xxhash64("id", F.lit("block"))
    own = F.when(F.col("guest"), F.col("h") + F.pmod(spread, F.col("g"))).otherwise(F.pmod(spread, F.col("h"))).cast("int")
    sized = sized.withColumn("own", own)
    as_first = sized.where("not guest").select(
        *keys, "id", "copies", "v", F.lit(0).alias("side"), F.col("own").alias("i"),
        F.explode(F.sequence(F.col("own"), F.col("h") + F.col("g") - 1)).alias("j"),
    )
    as_second = sized.select(
        *keys, "id", "copies", "v", F.lit(1).alias("side"),
        F.explode(F.sequence(F.lit(0), F.least(F.col("own"), F.col("h")) - 1)).alias("i"), F.col("own").alias("j"),
    ).where("i < j")
    return as_first.unionByName(as_second)


def near_vectors(
    df: DataFrame, row_id="vec_id", vector="embedding", label="label", cosine=COSINE, cell=CELL, block=BLOCK
) -> DataFrame:
    """`row_id, n_links, component_id, kept` of every row.

    Rows are linked when their labels are equal and the cosine of their vectors in
    double precision is `cosine` or more. Rows whose label or vector is null, and
    vectors that are empty, zero or hold null or non-finite numbers, link with
    nothing; so do vectors of different lengths. Equal vectors are one class and
    count as linked with each other; repeated rows count each. Every row is a vector
    of its own: several rows of one id with different vectors have their own links and
    components. A row without an id has no link and no component and is not kept. No
    rows: no rows. Other columns are not read.
    """
    named = df.select(
        F.col(row_id).alias("name"), F.col(row_id).alias("id"), F.col(vector).alias("v"), F.col(label).alias("label"),
        F.monotonically_increasing_id().alias("row"),
    )
    named = materialise(named, "numbered-vectors")
    rows = materialise(comparable(named, "id", "v", "label", "row"), "vectors")
    grouped = rows.groupBy("label", "v").agg(F.min("id").alias("least"), F.count(F.lit(1)).alias("copies"))
    # classes have numbers of their own, since two of them may have the same ids
    classes = materialise(grouped.withColumn("id", F.monotonically_increasing_id()), "vector-classes")
    pairs = blocks(materialise(place(classes, cosine, cell), "cells"), block)

    def compare(table: pa.Table) -> pa.Table:
        sides = set(table.column("side").to_pylist())
        same = table.column("i")[0] == table.column("j")[0]
        return compare_block(table, cosine) if 0 in sides and (same or 1 in sides) else _FOUND_SCHEMA.empty_table()

    found = materialise(pairs.groupBy("label", "dim", "cell", "i", "j").applyInArrow(compare, _FOUND), "block-links")
    roots = components(found.select(F.col("id").alias("u"), F.col("root").alias("v")))
    links = found.groupBy("id").agg(F.sum("n").alias("n"))
    known = classes.join(links, "id", "left").join(roots, F.col("id") == F.col("node"), "left")
    known = known.select(
        "label",
        "v",
        (F.coalesce("n", F.lit(0)) + F.col("copies") - 1).alias("n_links"),
        "least",
        F.coalesce("root", "id").alias("class_root"),
    )
    known = materialise(known, "class-links")
    smallest = materialise(known.groupBy("class_root").agg(F.min("least").alias("component_id")), "smallest-ids")
    linked = rows.join(known.join(smallest, "class_root"), ["label", "v"]).select("row", "n_links", "component_id")
    every = named.select("name", "row", F.col("id").cast("long").alias("id")).join(linked, "row", "left")
    component = F.coalesce("component_id", "id")
    return every.select(
        F.col("name").alias(row_id),
        F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
        component.alias("component_id"),
        F.coalesce(component == F.col("id"), F.lit(False)).alias("kept"),
    )
