"""Ordered analytics: islands, runs, chains, sweeps, bins and running sums as window expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strandweave.functions.intervals import overlap_length


def merge_intervals(df: DataFrame, by: list[str], gap: int = 0) -> DataFrame:
    """Union of the intervals (st, nd) of each group; intervals at most `gap` apart are joined (touching: 0)."""
    before = Window.partitionBy(*by).orderBy("st", "nd").rowsBetween(Window.unboundedPreceding, -1)
    upto = Window.partitionBy(*by).orderBy("st", "nd").rowsBetween(Window.unboundedPreceding, 0)
    d = df.select(*by, "st", "nd").withColumn("_reach", F.max("nd").over(before))
    d = d.withColumn("_new", F.when(F.col("st") <= F.col("_reach") + gap, 0).otherwise(1)).withColumn("_island", F.sum("_new").over(upto))
    return d.groupBy(*by, "_island").agg(F.min("st").alias("st"), F.max("nd").alias("nd"), F.count("*").alias("n_parts")).drop("_island")


def union_length(df: DataFrame, by: list[str]) -> DataFrame:
    """Positions that the intervals of each group cover."""
    return merge_intervals(df, by).groupBy(*by).agg(F.sum(F.col("nd") - F.col("st")).alias("covered"))


def max_overlap(df: DataFrame, by: list[str], weight: Column | None = None) -> DataFrame:
    """Largest number (or weight) of intervals of a group that share a position; ends come before starts."""
    w = F.lit(1) if weight is None else weight
    ev = df.select(*by, F.explode(F.array(F.struct(F.col("st").alias("pos"), w.alias("delta")), F.struct(F.col("nd").alias("pos"), (-w).alias("delta")))).alias("e"))
    # equal events are summed first: a position has one falling and one rising step
    ev = ev.groupBy(*by, F.col("e.pos").alias("pos"), (F.col("e.delta") > 0).alias("up")).agg(F.sum("e.delta").alias("delta"))
    run = Window.partitionBy(*by).orderBy("pos", "up").rowsBetween(Window.unboundedPreceding, 0)
    return ev.withColumn("depth", F.sum("delta").over(run)).groupBy(*by).agg(F.greatest(F.max("depth"), F.lit(0)).alias("max_overlap"))


def overlap_with_targets(df: DataFrame, targets: DataFrame, by: list[str]) -> DataFrame:
    """Most intervals that overlap at a position inside a target interval; negative or 0 where none does.

    Every target weighs twice the number of intervals of its group, which is taken off again.
    """
    n = df.groupBy(*by).agg((F.count("*") * 2).alias("_inf"))
    a = df.select(*by, "st", "nd", F.lit(1).cast("long").alias("_w"))
    t = targets.join(n, by).select(*by, "st", "nd", F.col("_inf").alias("_w"))
    got = max_overlap(a.unionByName(t), by, F.col("_w")).join(n, by)
    has = targets.select(*by).distinct().withColumn("_has", F.lit(True))
    return got.join(has, by, "left").select(*by, (F.col("max_overlap") - F.when(F.col("_has"), F.col("_inf")).otherwise(0)).alias("max_overlap"))


def chains(df: DataFrame, by: list[str], pos: str, gap: int, inclusive: bool = True, name: str = "chain") -> DataFrame:
    """df with the number (from 0) of its chain of sorted positions; a step of more than gap starts a new one.

    inclusive: a step of exactly gap stays in the chain; else it starts a new one.
    """
    w = Window.partitionBy(*by).orderBy(pos)
    step = F.col(pos) - F.lag(pos).over(w)
    new = (step > gap) if inclusive else (step >= gap)
    run = Window.partitionBy(*by).orderBy(pos).rangeBetween(Window.unboundedPreceding, Window.currentRow)
    return df.withColumn("_new", F.when(new, 1).otherwise(0)).withColumn(name, F.sum("_new").over(run)).drop("_new")


def contiguous_runs(df: DataFrame, by: list[str], pos: str, step: int, name: str = "run") -> DataFrame:
    """df with the number of its run of positions that follow each other by exactly `step`."""
    w = Window.partitionBy(*by).orderBy(pos)
    new = F.when(F.col(pos) - F.lag(pos).over(w) == step, 0).otherwise(1)
    return df.withColumn("_new", new).withColumn(name, F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)) - 1).drop("_new")


def state_runs(df: DataFrame, by: list[str], order: list[str], state: list[str], measure: str) -> DataFrame:
    """Runs of equal neighbouring states of each group: run number, state, rows, sum of measure, first order value."""
    w = Window.partitionBy(*by).orderBy(*order)
    same = F.lit(True)
    for c in state:
        same = same & F.col(c).eqNullSafe(F.lag(c).over(w))
    d = df.withColumn("_new", F.when(F.row_number().over(w) == 1, 0).when(same, 0).otherwise(1))
    d = d.withColumn("run", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return d.groupBy(*by, "run").agg(*[F.first(c).alias(c) for c in state], F.count("*").alias("n_rows"), F.sum(measure).alias("total"), F.min(order[0]).alias("first_at"))


def require_single_runs(df: DataFrame, by: list[str], order: list[str], value: str) -> DataFrame:
    """df, or an error at run time where a value comes back after another one in its group."""
    runs = state_runs(df.withColumn("_one", F.lit(1)), by, order, [value], "_one")
    again = runs.groupBy(*by, value).agg(F.count("*").alias("_n")).where("_n > 1")
    return df.crossJoin(F.broadcast(refuse(again, F.col(value), "value comes back: "))).where("_fine").drop("_fine")  # one row


def refuse(bad: DataFrame, what: Column, message: str) -> DataFrame:
    """One row, _fine = true; an error at run time, which names one of them, if `bad` has rows."""
    one = bad.agg(F.count("*").alias("_n"), F.min(what.cast("string")).alias("_x"))
    return one.select(F.when(F.col("_n") > 0, F.raise_error(F.concat(F.lit(message), F.coalesce("_x", F.lit("null")))).cast("boolean")).otherwise(True).alias("_fine"))


def rebin(df: DataFrame, by: list[str], order: list[str], n: int, total: str, length: str, st: str = "st", nd: str = "nd") -> DataFrame:
    """Each n consecutive rows of a group as one: first st, last nd, sum of total over sum of length."""
    w = Window.partitionBy(*by).orderBy(*order)
    d = df.withColumn("bin", F.floor((F.row_number().over(w) - 1) / n).cast("long"))
    return d.groupBy(*by, "bin").agg(F.min(st).alias("st"), F.max(nd).alias("nd"), (F.sum(total) / F.sum(length)).alias("depth"), F.count("*").alias("n_rows"))


def rebin_back(df: DataFrame, by: list[str], order: list[str], n: int, total: str, length: str) -> DataFrame:
    """df with the depth of its bin of n consecutive rows on each row."""
    w = Window.partitionBy(*by).orderBy(*order)
    d = df.withColumn("bin", F.floor((F.row_number().over(w) - 1) / n).cast("long"))
    own = Window.partitionBy(*by, "bin")
    return d.withColumn("depth", F.sum(total).over(own) / F.sum(length).over(own))


def running_sum(df: DataFrame, by: list[str], order: list[str], value: str, name: str = "running") -> DataFrame:
    w = Window.partitionBy(*by).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return df.withColumn(name, F.sum(value).over(w))


def cumulative_peak(df: DataFrame, by: list[str], order: list[str], value: str, digits: int | None = None) -> DataFrame:
    """Largest absolute running sum of each group and where it is reached first. digits: rounding before comparing."""
    d = running_sum(df, by, order, value)
    mag = F.abs("running") if digits is None else F.round(F.abs("running"), digits)
    d = d.withColumn("_mag", mag)
    key = F.struct(F.col("_mag").alias("m"), *[(-F.col(c).cast("double")).alias(f"o{k}") for k, c in enumerate(order)])
    return d.groupBy(*by).agg(F.max("_mag").alias("peak"), *[F.max_by(c, key).alias(f"peak_{c}") for c in order])


def weighted_depth(points: DataFrame, windows: DataFrame, on: list[str], point_id: str, width: int, value: str, how: str = "half_open") -> DataFrame:
    """Mean of windows' value over each span (st, nd) of points, weighted by overlap; null where none overlaps.

    how: half_open, closed (both ends counted) or plain (unweighted mean of windows that overlap).
    """
    from strandweave.operators.range_join import range_join

    kind = "closed" if how == "closed" else "half_open"
    hit = range_join(points.select(point_id, *on, "st", "nd"), windows, on, kind, width)
    w = F.lit(1) if how == "plain" else overlap_length(F.col("st"), F.col("nd"), F.col("r_st"), F.col("r_nd"), how == "closed")
    got = hit.withColumn("_w", w).groupBy(point_id).agg((F.sum(F.col(value) * F.col("_w")) / F.sum("_w")).alias("mean_depth"), F.count("*").alias("n_windows"))
    return points.join(got, point_id, "left")


def flank_means(points: DataFrame, bins: DataFrame, on: list[str], point_id: str, pos: str, bin_pos: str, value: str, flank: int) -> DataFrame:
    """Means of the bins in [pos - flank, pos) and [pos, pos + flank) of each point; null where there are none."""
    a = points.select(point_id, *on, pos).withColumn("_bucket", F.explode(F.array(F.floor(F.col(pos) / flank) - 1, F.floor(F.col(pos) / flank), F.floor(F.col(pos) / flank) + 1)))
    b = bins.select(*on, F.col(bin_pos).alias("_at"), F.col(value).alias("_v"), F.floor(F.col(bin_pos) / flank).alias("_bucket"))
    d = F.col("_at") - F.col(pos)
    got = a.join(b, [*on, "_bucket"]).where((d >= -flank) & (d < flank)).groupBy(point_id).agg(
        F.avg(F.when(d < 0, F.col("_v"))).alias("left_mean"), F.avg(F.when(d >= 0, F.col("_v"))).alias("right_mean")
    )
    return points.join(got, point_id, "left")


def clipped_by_previous(df: DataFrame, by: list[str], st: str, nd: str) -> DataFrame:
    """df with `clipped`: length of each interval beyond all earlier ones of its group (by st, then nd)."""
    before = Window.partitionBy(*by).orderBy(st, nd).rowsBetween(Window.unboundedPreceding, -1)
    reach = F.coalesce(F.max(nd).over(before), F.col(st))
    return df.withColumn("clipped", F.greatest(F.lit(0), F.col(nd) - F.greatest(F.col(st), reach)))


def trim_ends(df: DataFrame, by: list[str], order: list[str], drop: Column) -> DataFrame:
    """Rows of each group left after the leading and trailing rows for which `drop` holds are removed."""
    d = df.withColumn("_keep", ~F.coalesce(drop, F.lit(False)))
    front = Window.partitionBy(*by).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    back = Window.partitionBy(*by).orderBy(*order).rowsBetween(0, Window.unboundedFollowing)
    return d.withColumn("_a", F.max("_keep").over(front)).withColumn("_b", F.max("_keep").over(back)).where("_a and _b").drop("_keep", "_a", "_b")


def neighbour_changes(df: DataFrame, by: list[str], order: list[str], state: list[str]) -> DataFrame:
    """df with prev_ columns of the state before, and whether it differs (changed; false on first rows)."""
    w = Window.partitionBy(*by).orderBy(*order)
    out = df
    changed = F.lit(False)
    for c in state:
        out = out.withColumn(f"prev_{c}", F.lag(c).over(w))
        changed = changed | ~F.col(c).eqNullSafe(F.col(f"prev_{c}"))
    return out.withColumn("changed", F.when(F.row_number().over(w) == 1, False).otherwise(changed))


def nearest_different(df: DataFrame, by: list[str], order: list[str], value: str) -> DataFrame:
    """df with the closest earlier and later values of the group that differ from the row's own."""
    w = Window.partitionBy(*by).orderBy(*order)
    d = df.withColumn("_p", F.when(~F.col(value).eqNullSafe(F.lag(value).over(w)), F.lag(value).over(w)))
    d = d.withColumn("_n", F.when(~F.col(value).eqNullSafe(F.lead(value).over(w)), F.lead(value).over(w)))
    back, ahead = w.rowsBetween(Window.unboundedPreceding, 0), w.rowsBetween(0, Window.unboundedFollowing)
    return d.withColumn("prev_different", F.last("_p", ignorenulls=True).over(back)).withColumn("next_different", F.first("_n", ignorenulls=True).over(ahead)).drop("_p", "_n")


def positive_differences(df: DataFrame, by: list[str], order: list[str], value: str) -> DataFrame:
    """Differences of neighbouring rows where both values are positive."""
    w = Window.partitionBy(*by).orderBy(*order)
    d = df.withColumn("_prev", F.lag(value).over(w))
    return d.where((F.col("_prev") > 0) & (F.col(value) > 0)).withColumn("diff", F.col(value) - F.col("_prev")).drop("_prev")
