"""Paths as tables: their index, expansion to reference pieces, component usage and display tables."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strandweave.functions import cs as C
from strandweave.operators.graph import path_steps, step_keys


def path_index(paths: DataFrame) -> DataFrame:
    """paths (src, dst, nodes, length) with ordinal within their pair, by length and nodes, and path_id src_dst_ordinal."""
    w = Window.partitionBy("src", "dst").orderBy("length", "nodes")
    return paths.withColumn("ordinal", F.row_number().over(w)).withColumn("path_id", F.concat_ws("_", F.col("src").cast("string"), F.col("dst").cast("string"), F.col("ordinal").cast("string")))


def _trim(cs: pd.Series, left: pd.Series, right: pd.Series) -> pd.Series:
    return pd.Series([None if c is None else C.trim_right(C.trim_left(c, int(a))[0], int(b))[0] for c, a, b in zip(cs, left, right, strict=True)])


def trim_both(cs: Column, left: Column, right: Column) -> Column:
    """cs without its first and last reference bases."""
    return F.pandas_udf(_trim, "string")(cs, left, right)


def expand(paths: DataFrame, nodes: DataFrame) -> DataFrame:
    """Reference pieces of each path in order: path_id, step, kind (node or gap), chr, st, nd, dir, cs.

    nodes: node, chr, st, nd, dir, cs. Where neighbours of one chromosome and direction overlap, each gives up its half
    of what they share (the later one the odd base); where they leave a gap, the reference between them is a piece.
    """
    s = path_steps(paths.select("path_id", "nodes"), nodes)
    w = Window.partitionBy("path_id").orderBy("step")
    s = s.withColumn("next_st", F.lead("st").over(w)).withColumn("next_nd", F.lead("nd").over(w)).withColumn("next_chr", F.lead("chr").over(w)).withColumn("next_dir", F.lead("dir").over(w))

    def shared(p: str) -> Column:
        same = (F.col(f"{p}_chr") == F.col("chr")) & (F.col(f"{p}_dir") == F.col("dir"))
        over = F.least(F.col("nd"), F.col(f"{p}_nd")) - F.greatest(F.col("st"), F.col(f"{p}_st"))
        return F.when(same & (over > 0), over).otherwise(0)

    fwd = F.col("dir") == "+"
    s = s.withColumn("_p", shared("prev")).withColumn("_n", shared("next"))
    first, last = F.col("_p") - F.floor(F.col("_p") / 2), F.floor(F.col("_n") / 2)
    s = s.withColumn("_l", F.when(fwd, first).otherwise(last)).withColumn("_r", F.when(fwd, last).otherwise(first))
    own = s.select("path_id", "step", F.lit("node").alias("kind"), "chr", (F.col("st") + F.col("_l")).alias("st"), (F.col("nd") - F.col("_r")).alias("nd"), "dir", trim_both(F.col("cs"), F.col("_l"), F.col("_r")).alias("cs"))
    gap = s.where((F.col("prev_chr") == F.col("chr")) & (F.col("prev_dir") == F.col("dir")))
    gap = gap.select("path_id", (F.col("step") - 0.5).alias("step"), F.lit("gap").alias("kind"), "chr", F.when(fwd, F.col("prev_nd")).otherwise(F.col("nd")).alias("st"), F.when(fwd, F.col("st")).otherwise(F.col("prev_st")).alias("nd"), "dir", F.lit(None).cast("string").alias("cs"))
    return own.withColumn("step", F.col("step").cast("double")).where("nd > st").unionByName(gap.where("nd > st"))


def component_usage(paths: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(components, usage): distinct typed keys of all paths with a number, and how often each path uses them.

    paths: path_id, nodes as array<struct<node, contig>>. A key shared by many paths is one component, so that its depth
    is computed once.
    """
    k = step_keys(paths)
    keys = k.select("kind", "a", "b").distinct()
    keys = keys.withColumn("component", F.row_number().over(Window.orderBy("kind", "a", "b")) - 1)  # distinct segments of a graph
    n = k.join(keys, (k["kind"] == keys["kind"]) & (k["a"] == keys["a"]) & k["b"].eqNullSafe(keys["b"])).groupBy("path_id", "component").agg(F.count("*").alias("cnt"))
    return keys, n


def bounded_pairs(paths: DataFrame, per_pair: int = 10_000) -> DataFrame:
    """At most per_pair paths of each pair of ends, the shortest first, then by nodes; a feature limit of the search."""
    w = Window.partitionBy("src", "dst").orderBy("length", "nodes")
    return paths.withColumn("_k", F.row_number().over(w)).where(F.col("_k") <= per_pair).drop("_k")


def similar_compositions(composition: DataFrame, tolerance: int = 50_000) -> DataFrame:
    """(path_id, kept): paths in order that have an earlier kept one with the same chromosomes, each within tolerance, go.

    composition: path_id, ord, chr, amount. An ordered fold within each set of chromosomes.
    """
    from strandweave.operators.leaders import greedy_leaders

    g = composition.groupBy("path_id").agg(F.min("ord").alias("ord"), F.array_sort(F.collect_list(F.struct("chr", "amount"))).alias("c"))
    g = g.withColumn("key", F.array_join(F.transform("c", lambda x: x["chr"]), ","))
    widths = [r[0] for r in g.select(F.size("c")).distinct().collect()]  # a path crosses a few chromosomes
    out = None
    for n in sorted(widths):
        part = g.where(F.size("c") == n)
        for i in range(n):
            part = part.withColumn(f"p{i}", F.col("c")[i]["amount"].cast("double"))
        got = greedy_leaders(part.drop("c"), ["key"], ["ord"], [f"p{i}" for i in range(n)], tolerance).select("path_id", F.col("is_leader").alias("kept"))
        out = got if out is None else out.unionByName(got)
    return out


def rescued_junctions(candidates: DataFrame, nodes: DataFrame) -> DataFrame:
    """Junctions of rescued queries: the outermost node rows of each, in query order. candidates: query_name."""
    d = nodes.join(candidates.select(F.col("query_name").alias("ctg_nam")).distinct(), "ctg_nam", "left_semi")
    g = d.groupBy("ctg_nam").agg(F.min_by("node_id", F.struct("ctg_str", "ctg_end", "node_id")).alias("a_id"), F.max_by("node_id", F.struct("ctg_str", "ctg_end", "node_id")).alias("b_id"))
    return g.where("a_id <> b_id").select(F.concat(F.lit("rescue_"), "ctg_nam").alias("event"), "a_id", "b_id")
