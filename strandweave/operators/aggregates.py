"""Aggregates of depth, contigs and events."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def depth_summary(df: DataFrame, value: str = "meandepth") -> DataFrame:
    """Exact median, mean, population deviation and the haploid unit, half the median."""
    return df.agg(F.median(value).alias("median"), F.avg(value).alias("mean"), F.stddev_pop(value).alias("std"), (F.median(value) / 2).alias("unit"))


def normalise(main: DataFrame, reference: DataFrame, keys: list[str], value: str, offset: str, default: float = 1.0) -> DataFrame:
    """main with value divided by the offset of its keys; rows without one are divided by the default."""
    ref = reference.select(*keys, F.col(offset).alias("_offset"))
    return main.join(ref, keys, "left").withColumn("normalised", F.col(value) / F.coalesce("_offset", F.lit(default))).drop("_offset")


def align_vector(windows: DataFrame, vector: DataFrame, keys: list[str], value: str, default: float = 0.0) -> DataFrame:
    """windows with the value of their keys, or the default."""
    return windows.join(vector.select(*keys, value), keys, "left").withColumn(value, F.coalesce(value, F.lit(default)))


def contig_ratio(df: DataFrame, by: str, order: str, large: float = 1e9) -> DataFrame:
    """Estimated over summed reference length of each contig's rows (chr_str, chr_end, ctg_dir), and the span.

    The estimate runs from the first row's entry to the last row's exit, by the first row's strand; its sign tells
    backtracking. A sum of 0 gives +large.
    """
    row = F.struct("ctg_dir", "chr_str", "chr_end", "chr_nam")
    d = df.groupBy(by).agg(F.min_by(row, order).alias("f"), F.max_by(row, order).alias("l"), F.sum(F.col("chr_end") - F.col("chr_str")).alias("total"), F.count("*").alias("n_rows"))
    est = F.when(F.col("f.ctg_dir") == "+", F.col("l.chr_end") - F.col("f.chr_str")).otherwise(F.col("f.chr_end") - F.col("l.chr_str"))
    d = d.withColumn("estimated", est)
    return d.select(
        by, "estimated", "total", F.when(F.col("total") == 0, F.lit(large)).otherwise(F.col("estimated") / F.col("total")).alias("ratio"), F.abs("estimated").alias("span"), "n_rows",
        F.col("f.chr_nam").alias("first_chr"), F.col("l.chr_nam").alias("last_chr"), F.col("f.ctg_dir").alias("first_dir"), F.col("l.ctg_dir").alias("last_dir"),
    )


def main_flow(df: DataFrame, by: str, state: list[str], measure: Column, order: str) -> DataFrame:
    """The state with the largest sum of measure in each group; of equal sums the one seen first."""
    s = df.groupBy(by, *state).agg(F.sum(measure).alias("_m"), F.min(order).alias("_o"))
    return s.groupBy(by).agg(*[F.max_by(c, F.struct("_m", (-F.col("_o")).alias("n"))).alias(c) for c in state], F.max("_m").alias("total"))


def major_share(df: DataFrame, by: list[str], item: str, measure: str, share: float = 0.9) -> DataFrame:
    """Items by falling sum of measure until their cumulative share reaches `share`, the crossing one included."""
    s = df.groupBy(*by, item).agg(F.sum(measure).alias("amount"))
    whole = Window.partitionBy(*by)
    before = whole.orderBy(F.col("amount").desc(), item).rowsBetween(Window.unboundedPreceding, -1)
    s = s.withColumn("_before", F.coalesce(F.sum("amount").over(before), F.lit(0.0))).withColumn("_all", F.sum("amount").over(whole))
    return s.where(F.col("_before") / F.col("_all") < share).drop("_before", "_all")


def event_weights(usage: DataFrame, weights: DataFrame, active: DataFrame | None = None) -> DataFrame:
    """Sum of count x weight of each event over its columns (event, col, cnt) x (col, w), active columns only if given."""
    u = usage if active is None else usage.join(active.select("col").distinct(), "col", "left_semi")
    return u.join(weights, "col").groupBy("event").agg(F.sum(F.col("cnt") * F.col("w")).alias("weight"))


def _step_over_pairs(nodes: Column, keys: Column) -> Column:
    """Unordered pairs of neighbours that stand in keys, left to right; a pair found uses up both its nodes."""
    start = F.struct(F.array().cast("array<struct<a:bigint,b:bigint>>").alias("found"), F.lit(None).cast("bigint").alias("prev"))

    def step(acc: Column, x: Column) -> Column:
        pair = F.struct(F.least(acc["prev"], x).alias("a"), F.greatest(acc["prev"], x).alias("b"))
        hit = acc["prev"].isNotNull() & x.isNotNull() & F.array_contains(keys, pair)
        return F.struct(F.when(hit, F.concat(acc["found"], F.array(pair))).otherwise(acc["found"]).alias("found"), F.when(hit, F.lit(None).cast("bigint")).otherwise(x).alias("prev"))

    return F.aggregate(nodes, start, step)["found"]


def path_events(paths: DataFrame, events: DataFrame, path_id: str = "path_id", nodes: str = "nodes") -> DataFrame:
    """(path, a, b, cnt): uses of each junction (unordered pair of node ids) by each path (array of node ids).

    Junction keys that a path may use are first found by an equi-join on its neighbouring pairs, so only those, and
    not the whole catalogue, are held against a path.
    """
    pairs = paths.select(path_id, F.posexplode(nodes).alias("_i", "_x")).where("_x is not null")
    w = Window.partitionBy(path_id).orderBy("_i")
    pairs = pairs.withColumn("_p", F.lag("_x").over(w)).where("_p is not null").select(path_id, F.least("_p", "_x").alias("a"), F.greatest("_p", "_x").alias("b")).distinct()
    keys = pairs.join(events.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), ["a", "b"]).groupBy(path_id).agg(F.collect_list(F.struct("a", "b")).alias("_keys"))
    found = paths.join(keys, path_id).select(path_id, F.explode(_step_over_pairs(F.col(nodes), F.col("_keys"))).alias("e"))
    return found.groupBy(path_id, F.col("e.a").alias("a"), F.col("e.b").alias("b")).agg(F.count("*").alias("cnt"))


def composition(parts: DataFrame, path: str, item: str, measure: str, least: float = 0) -> DataFrame:
    """Amount of each item in each path, with its rank and share; items below `least` are left out first."""
    s = parts.groupBy(path, item).agg(F.sum(measure).alias("amount")).where(F.col("amount") >= least)
    w = Window.partitionBy(path)
    return s.withColumn("share", F.col("amount") / F.sum("amount").over(w)).withColumn("rank", F.rank().over(w.orderBy(F.col("amount").desc())))


def counters(df: DataFrame, reason: str, all_reasons: DataFrame) -> DataFrame:
    """Rows for each known reason, 0 where there are none."""
    return all_reasons.select(reason).join(df.groupBy(reason).agg(F.count("*").alias("n")), reason, "left").withColumn("n", F.coalesce("n", F.lit(0)))


def grouped_in_order(df: DataFrame, by: list[str], order: str, cols: list[str]) -> DataFrame:
    """Lists of rows of each group in order, with the first order value of the group."""
    return df.groupBy(*by).agg(F.array_sort(F.collect_list(F.struct(order, *cols))).alias("members"), F.min(order).alias("first_at"))


def allele_fraction(alt: Column, ref: Column) -> Column:
    return alt / F.nullif(alt + ref, F.lit(0))


def expected_depth(a: Column, a_weight: Column, b: Column, b_weight: Column) -> Column:
    """Weighted mean of two sides, of one where the other is null."""
    w = F.coalesce(F.when(a.isNotNull(), a_weight), F.lit(0)) + F.coalesce(F.when(b.isNotNull(), b_weight), F.lit(0))
    return (F.coalesce(a * a_weight, F.lit(0.0)) + F.coalesce(b * b_weight, F.lit(0.0))) / F.nullif(w, F.lit(0))


def copy_numbers(events: DataFrame, keys: list[str], weight: str, unit: float) -> DataFrame:
    """Largest copy number (weight / unit) of each key."""
    return events.groupBy(*keys).agg(F.max(F.col(weight) / unit).alias("cn"))


def covered_fraction(fasta: DataFrame, alignments: DataFrame) -> DataFrame:
    """Alignments, covered bases and fraction of each contig (name, len), 0 for those without alignments."""
    from strandweave.operators.ordered import union_length

    spans = alignments.select(F.col("qname").alias("name"), F.col("qst").alias("st"), F.col("qnd").alias("nd"))
    n = spans.groupBy("name").agg(F.count("*").alias("n_alignments"))
    d = fasta.join(n, "name", "left").join(union_length(spans, ["name"]), "name", "left")
    d = d.withColumn("n_alignments", F.coalesce("n_alignments", F.lit(0))).withColumn("covered", F.coalesce("covered", F.lit(0)))
    return d.withColumn("fraction", F.col("covered") / F.nullif(F.col("len"), F.lit(0)))
