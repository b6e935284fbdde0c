"""Connected components by alternating large-star and small-star.

Each task first replaces the links that it reads by a link of every node to the
smallest that it reaches there, which leaves fewer links and shorter paths. Every
step after that is an aggregation to the smallest neighbour of a node and a join
back to the edges, so a node with any number of neighbours is split over tasks;
both are written to the shared folder, which cuts the lineage. No step has more
links than the one before, so few links go to few files.
"""

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from prefboard.session import materialise


#: Links a task contracts at once, at most.
AT_ONCE = 1 << 20


def smallest_reached(u, v):
    """`(nodes, roots)` of the links between `u` and `v`, without the roots."""
    nodes, numbers = np.unique(np.concatenate([u, v]), return_inverse=True)
    a, b = numbers[: len(u)], numbers[len(u) :]
    root = np.arange(len(nodes))
    while True:
        low = np.minimum(root[a], root[b])
        new = root.copy()
        for ends in (a, b, root[a], root[b]):
            np.minimum.at(new, ends, low)
        new = new[new]
        if np.array_equal(new, root):
            break
        root = new
    moved = root != np.arange(len(nodes))
    return nodes[moved], nodes[root[moved]]


def _contract(batches):
    def out():
        nodes, roots = smallest_reached(*map(np.concatenate, zip(*waiting)))
        return pa.record_batch([pa.array(nodes), pa.array(roots)], ["u", "v"])

    waiting, size = [], 0
    for batch in batches:
        waiting.append((batch.column(0).to_numpy(), batch.column(1).to_numpy()))
        size += len(batch)
        if size >= AT_ONCE:
            yield out()
            waiting, size = [], 0
    if size:
        yield out()


def _smallest(edges: DataFrame, most) -> DataFrame:
    """`u, m`: the smallest of a node and its neighbours."""
    smallest = edges.groupBy("u").agg(F.min("v").alias("m"))
    return materialise(smallest.select("u", F.least("u", "m").alias("m")), "smallest", most)


def _large_star(edges: DataFrame, most) -> DataFrame:
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    joined = both.where("v > u").join(_smallest(both, most), "u")
    return materialise(joined.select(F.col("v").alias("u"), F.col("m").alias("v")).distinct(), "large-star", most)


def _small_star(edges: DataFrame, most) -> DataFrame:
    """`edges` lead from the larger node to the smaller, as `_large_star` leaves them."""
    smallest = _smallest(edges, most)
    moved = edges.join(smallest, "u").where("v > m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    own = smallest.select("u", F.col("m").alias("v"))
    return materialise(moved.unionByName(own).distinct(), "small-star", most)


def _finished(edges: DataFrame) -> bool:
    """Whether every larger end has one link, and its smaller end is nobody's larger end."""
    larger = edges.select(F.col("u").alias("node"), F.lit(1).alias("up"), F.lit(0).alias("down"))
    smaller = edges.select(F.col("v").alias("node"), F.lit(0).alias("up"), F.lit(1).alias("down"))
    ends = larger.unionByName(smaller).groupBy("node").agg(F.sum("up").alias("up"), F.max("down").alias("down"))
    return ends.where("up > 1 or (up = 1 and down = 1)").isEmpty()


def components(links: DataFrame) -> DataFrame:
    """`node, root` for every node of `links (u, v)` but the roots themselves.

    `root` is the smallest node reachable. Repeated links and links of a node with
    itself change nothing; links with a null end are left out; no links: no rows.
    """
    clean = links.where("u is not null and v is not null and u <> v")
    edges = materialise(clean.select("u", "v").mapInArrow(_contract, "u long, v long"), "links")
    most = 2 * edges.count()  # both ends of every link
    while not _finished(edges):
        edges = _small_star(_large_star(edges, most), most)
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
