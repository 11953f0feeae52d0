"""Connected components of an edge table by alternating large-star and small-star rounds, and joins without hot keys."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandweave.runtime import Written, cut

#: Rows of one key that a task may get in any case, and most keys whose rows are kept in place.
LEAST_HOT, MOST_HOT = 1000, 100_000


def join_counted(left: DataFrame, right: DataFrame, on: list[str], count: str, total: int) -> DataFrame:
    """Inner join with a written table of distinct keys; its column `count` says how many rows of left a key has at most.

    Keys with more than `limit` rows would each fill a task, so their rows of right are broadcast and left's rows stay
    where they are; all others are shuffled. total is the sum of count, so that there are at most MOST_HOT such keys.
    """
    limit = max(LEAST_HOT, total // MOST_HOT)
    hot = right.where(F.col(count) > limit)
    if not hot.limit(1).count():
        return left.join(right, on)
    few = left.join(F.broadcast(hot), on)
    rest = left.join(F.broadcast(hot.select(on)), on, "left_anti").join(right.where(F.col(count) <= limit), on)
    return few.unionByName(rest)


def _signature(df: DataFrame) -> tuple:
    return tuple(df.agg(F.count("*"), F.sum(F.xxhash64("u", "v").bitwiseAND(F.lit((1 << 40) - 1)))).first())


def _with_least(edges: DataFrame, both: DataFrame, name: str, rows: int) -> tuple[DataFrame, Written]:
    """both with the smallest neighbour (or itself) of u as m; the table of minima is to be dropped when done."""
    least = Written(both.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("_n")).select("u", F.least("u", "m").alias("m"), "_n"), name)
    return join_counted(both, least.df, ["u"], "_n", rows).drop("_n"), least


def connected_components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(id, component) of every end of an edge; component is the smallest id that can be reached.

    Self-edges and null ends are ignored, so an id with only those has no row. Each round takes the minimum of
    neighbours, combined before the shuffle, and joins it back; the edges of a node of high degree stay where they are
    and meet its minimum by broadcast, so no node is gathered in one task. Rounds grow with the logarithm of the
    longest path and end when nothing changes. Each round is a table in the shared folder.
    """
    e = edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where(
        F.col(a).isNotNull() & F.col(b).isNotNull() & (F.col(a) != F.col(b))
    )
    now = Written(e.distinct(), "edges")
    state = _signature(now.df)
    while state[0]:
        e = now.df
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        joined, least = _with_least(e, both, "least", 2 * state[0])
        large = Written(joined.where("v > u and v != m").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct(), "edges")
        least.drop()
        e = large.df
        joined, least = _with_least(e, e, "least", 2 * state[0])
        small = joined.select("u", F.col("m").alias("v")).unionByName(
            joined.where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        )
        after = Written(small.distinct(), "edges")
        new = _signature(after.df)
        least.drop()
        large.drop()
        now.drop()
        now = after
        if new == state:
            break
        state = new
    e = now.df
    return e.select(F.col("u").alias("id"), F.col("v").alias("component")).unionByName(
        e.select(F.col("v").alias("id"), F.col("v").alias("component")).distinct()
    )


def smallest_names(of: DataFrame, names: DataFrame) -> DataFrame:
    """(id, component, component_id): for each (id, component) the smallest name in its component; names: id, name."""
    named = cut(of.join(names, "id"), "named")
    least = cut(named.groupBy("component").agg(F.min("name").alias("component_id"), F.count("*").alias("_n")), "least")
    total = named.count()
    return join_counted(named, least, ["component"], "_n", total).select("id", "component", "component_id")


def local_roots(n: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Smallest position that each of n positions reaches over the links i-j."""
    root = np.arange(n)
    while True:
        low = np.minimum(root[i], root[j])
        new = root.copy()
        np.minimum.at(new, i, low)
        np.minimum.at(new, j, low)
        new = new[new]
        if (new == root).all():
            return root
        root = new
