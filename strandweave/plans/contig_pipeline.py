"""Assembly alignments to typed contigs and junctions: labels, telomere trims, types, splits, anchors, connectivity."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandweave.operators import contigs as T
from strandweave.operators import graph as G
from strandweave.operators import junctions as J
from strandweave.operators.range_join import first_label


def labelled(nodes: DataFrame, telomeres: DataFrame, repeats: DataFrame, width: int = 100_000) -> DataFrame:
    """nodes with telo_label (f, b, fin, bin or null) and in_repeat. Both annotations are chr, st, nd, ord[, label]."""
    n = nodes.withColumn("st", F.col("chr_str")).withColumn("nd", F.col("chr_end")).withColumn("chr", F.col("chr_nam"))
    t = telomeres.select("chr", F.col("st").alias("r_st"), F.col("nd").alias("r_nd"), "ord", "label")
    r = repeats.select("chr", F.col("st").alias("r_st"), F.col("nd").alias("r_nd"), "ord", F.lit("r").alias("label"))
    d = first_label(n, t, ["chr"], "node_id", width).withColumnRenamed("label", "telo_label")
    d = first_label(d, r, ["chr"], "node_id", width).withColumn("in_repeat", F.col("label").isNotNull())
    return d.drop("label", "st", "nd", "chr")


def run(nodes: DataFrame, telomeres: DataFrame, repeats: DataFrame) -> dict[str, DataFrame]:
    """Typed nodes, junctions of breakend contigs, and the edges of their graph.

    nodes: node_id, ctg_nam, ctg_len, ctg_dir, chr_nam, chr_len, chr_str, chr_end, ctg_mapq, ctg_censat. Contigs that
    lie at several chromosome ends, and nothing else, are left out first.
    """
    d = labelled(T.without_contigs(nodes, T.multi_end_contigs(nodes)), telomeres, repeats)
    d = T.trim_telomeres(d).withColumn("is_telo", F.col("telo_connect").isNotNull())
    kinds = T.contig_types(d).select("ctg_nam", "ctg_typ")
    typed = d.join(kinds, "ctg_nam").where("ctg_typ > 0")
    pairs = T.junctions(typed)
    both = J.with_ends(pairs.select(F.col("ctg_nam").alias("event"), "a_id", "b_id"), typed)
    ends = both.select("event", F.explode(F.array(*[F.struct(F.col(f"{p}_id").alias("node"), F.lit(r).alias("role"), F.col(f"{p}_dir").alias("strand"), F.col(f"{p}_chr").alias("chr"), F.col(f"{p}_st").alias("st"), F.col(f"{p}_nd").alias("nd")) for p, r in (("a", "f"), ("b", "b"))])).alias("e"))
    ends = ends.select(F.col("event").alias("contig"), "e.*")
    edges = G.junction_edges(both.select(F.col("a_id").alias("a"), F.col("b_id").alias("b"))).unionByName(G.connectivity(ends)).distinct()
    return {"nodes": typed, "junctions": both, "edges": edges, "splits": T.split_at_jumps(typed)}
