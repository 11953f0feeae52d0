"""Joins on intervals and distances: bucketed equi-joins followed by the exact predicate."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strandweave.functions.intervals import relation
from strandweave.runtime import cut


def _buckets(st: Column, nd: Column, width: int, closed: bool) -> Column:
    last = nd if closed else F.greatest(nd - 1, st)
    return F.sequence(F.floor(st / width), F.floor(last / width))


def range_join(
    left: DataFrame,
    right: DataFrame,
    on: list[str],
    kind: str,
    width: int,
    left_span: tuple[str, str] = ("st", "nd"),
    right_span: tuple[str, str] = ("r_st", "r_nd"),
    how: str = "inner",
) -> DataFrame:
    """Pairs of rows with equal `on` columns whose spans stand in the relation `kind` (see functions.intervals).

    Column names of the two sides are distinct but for `on`. Both spans are spread over buckets of `width`
    positions and met in the first bucket they share, so the join is an equi-join that Spark can shuffle, split
    where skewed, or broadcast. Spans with nd < st, or null, match nothing. how: inner, left, left_semi, left_anti, or
    left_flag for all rows of left with `matched`; all but inner write left, numbered, to the shared folder.
    For kinds that look beyond touching ends, width bounds nothing: any width gives the same rows. A good width is
    about the usual span, so that few buckets are made.
    """
    closed = kind in ("closed", "contained", "contains", "half_open_point", "strictly_inside", "strictly_spans")
    ls, ln = (F.col(c) for c in left_span)
    rs, rn = (F.col(c) for c in right_span)
    a = left.where(ls <= ln)
    keyed = how != "inner"
    if keyed:  # numbers must be the same wherever left is read, so they are written with it
        left = cut(left.withColumn("_lid", F.monotonically_increasing_id()), "left")
        a = left.where(ls <= ln).select(*on, *left_span, "_lid")
    a = a.withColumn("_bucket", F.explode(_buckets(ls, ln, width, closed)))
    b = right.where(rs <= rn).withColumn("_bucket", F.explode(_buckets(rs, rn, width, closed)))
    first = F.greatest(F.floor(ls / width), F.floor(rs / width))
    pairs = a.join(b, [*on, "_bucket"]).where((F.col("_bucket") == first) & relation(kind, ls, ln, rs, rn)).drop("_bucket")
    if how == "inner":
        return pairs
    if how in ("left_semi", "left_anti"):
        return left.join(pairs.select("_lid").distinct(), "_lid", how).drop("_lid")
    if how == "left":
        extra = [c for c in right.columns if c not in on]
        return left.join(pairs.select("_lid", *extra), "_lid", "left").drop("_lid")
    if how == "left_flag":
        return left.join(pairs.select("_lid").distinct().withColumn("matched", F.lit(True)), "_lid", "left").drop("_lid").withColumn("matched", F.coalesce("matched", F.lit(False)))
    raise ValueError(f"unknown join type {how}")


def box_candidates(
    left: DataFrame,
    right: DataFrame,
    on: list[str],
    left_box: tuple[tuple[Column, Column], tuple[Column, Column]],
    right_box: tuple[tuple[Column, Column], tuple[Column, Column]],
    widths: tuple[int, int],
    most: int = 64,
) -> DataFrame:
    """Pairs of rows with equal `on` columns, once each, among them all whose boxes share a point, ends included.

    A box is a span (start, end) in each of two dimensions; what pairs have to be is for the caller to ask. Column names
    of the two sides are distinct but for `on`. Both sides are spread over the cells of a grid and met in the first cell
    they share. Boxes over more than `most` cells are met by buckets of the first dimension only. Spans with nd < st, or
    null, match nothing. Both sides are read up to four times, so they should be written tables.
    """
    out = [*left.columns, *[c for c in right.columns if c not in on]]
    first, last = (lambda span, k, e=e: F.floor(span[e] / widths[k]) for e in (0, 1))
    cells = lambda box: (last(box[0], 0) - first(box[0], 0) + 1).cast("double") * (last(box[1], 1) - first(box[1], 1) + 1)
    sides = [d.dropna(subset=on).where((b[0][0] <= b[0][1]) & (b[1][0] <= b[1][1])) for d, b in ((left, left_box), (right, right_box))]
    small = [d.where(cells(b) <= most) for d, b in zip(sides, (left_box, right_box))]
    wide = [d.where(cells(b) > most) for d, b in zip(sides, (left_box, right_box))]

    def spread(d: DataFrame, box, s: str) -> DataFrame:
        d = d.withColumns({f"_{s}f{k}": first(box[k], k) for k in (0, 1)} | {f"_{s}e{k}": last(box[k], k) for k in (0, 1)})
        for k in (0, 1):
            d = d.withColumn(f"_{s}c{k}", F.explode(F.sequence(f"_{s}f{k}", f"_{s}e{k}"))).drop(f"_{s}e{k}")
        d = d.withColumn(f"_{s}key", F.xxhash64(*on, f"_{s}c0", f"_{s}c1"))
        return d.withColumnsRenamed({c: f"_{s}{c}" for c in on}) if s == "r" else d

    # the hash comes first, as the join sorts by its first key
    meet = F.col("_lkey") == F.col("_rkey")
    for c in on:
        meet = meet & (F.col(c) == F.col(f"_r{c}"))
    for k in (0, 1):
        meet = meet & (F.col(f"_lc{k}") == F.col(f"_rc{k}")) & (F.col(f"_lc{k}") == F.greatest(f"_lf{k}", f"_rf{k}"))
    pairs = spread(small[0], left_box, "l").join(spread(small[1], right_box, "r"), meet).select(out)
    for k, (a, b) in enumerate(((wide[0], sides[1]), (small[0], wide[1]))):
        if wide[k].limit(1).count():
            a = a.withColumns({"_lst": left_box[0][0], "_lnd": left_box[0][1]})
            b = b.withColumns({"_rst": right_box[0][0], "_rnd": right_box[0][1]})
            pairs = pairs.unionByName(range_join(a, b, on, "closed", widths[0], ("_lst", "_lnd"), ("_rst", "_rnd")).select(out))
    return pairs


def first_label(nodes: DataFrame, labels: DataFrame, on: list[str], node_id: str, width: int, kind: str = "half_open", order: str = "ord", label: str = "label") -> DataFrame:
    """nodes with the label of the first interval (by `order`) that overlaps, and `in` appended where it contains.

    nodes have st, nd; labels have r_st, r_nd, `order` and `label`. No overlap gives null.
    """
    hit = range_join(nodes.select(node_id, *on, "st", "nd"), labels, on, kind, width)
    inside = relation("contained", F.col("st"), F.col("nd"), F.col("r_st"), F.col("r_nd"))
    hit = hit.withColumn("_label", F.concat(label, F.when(inside, "in").otherwise("")))
    best = hit.groupBy(node_id).agg(F.min_by("_label", order).alias("label"))
    return nodes.join(best, node_id, "left")


def next_interval_label(nodes: DataFrame, repeats: DataFrame, on: str, node_id: str) -> DataFrame:
    """nodes labelled by one interval only: the first whose end reaches the node's start. r: overlaps, rin: contains.

    As a union of both sides ordered by position: for each node the smallest end at or beyond its start, and of equal
    ends the smallest start.
    """
    n = nodes.select(on, F.col(node_id).alias("_id"), F.col("st").alias("_pos"), F.col("st").alias("_s"), F.col("nd").alias("_e"), F.lit(0).alias("_side"))
    r = repeats.select(on, F.lit(None).cast(nodes.schema[node_id].dataType).alias("_id"), F.col("r_nd").alias("_pos"), F.col("r_st").alias("_s"), F.col("r_nd").alias("_e"), F.lit(1).alias("_side"))
    ahead = Window.partitionBy(on).orderBy("_pos", "_side", F.col("_s")).rowsBetween(0, Window.unboundedFollowing)
    both = n.unionByName(r).withColumn("_next", F.first(F.when(F.col("_side") == 1, F.struct("_s", "_e")), ignorenulls=True).over(ahead)).where("_side = 0")
    over = relation("half_open", F.col("_s"), F.col("_e"), F.col("_next._s"), F.col("_next._e"))
    # intervals that only touch are at distance 0 as well
    touch = (F.col("_next._s") == F.col("_e")) | (F.col("_next._e") == F.col("_s"))
    inside = relation("contained", F.col("_s"), F.col("_e"), F.col("_next._s"), F.col("_next._e"))
    got = both.select(F.col("_id").alias(node_id), F.when((over | touch) & inside, "rin").when(over | touch, "r").alias("label"))
    return nodes.join(got, node_id, "left")


def nearest(left: DataFrame, right: DataFrame, on: list[str], group: str, distance: Column, ties: list[str], reach: tuple[str, str, int] | None = None) -> DataFrame:
    """For each value of `group` of left, the row of right with the smallest (distance, *ties).

    reach = (left position, right position, most): only rows at most that far apart are looked at, through buckets.
    """
    if reach:
        lp, rp, most = reach
        a = left.withColumn("_bucket", F.explode(F.sequence(F.floor((F.col(lp) - most) / most), F.floor((F.col(lp) + most) / most))))
        b = right.withColumn("_bucket", F.floor(F.col(rp) / most))
        pairs = a.join(b, [*on, "_bucket"]).where(F.abs(F.col(lp) - F.col(rp)) <= most).drop("_bucket")
    else:
        pairs = left.join(right, on)
    pairs = pairs.withColumn("_d", distance)
    cols = [c for c in pairs.columns if c != group]
    best = pairs.groupBy(group).agg(F.min_by(F.struct(*cols), F.struct("_d", *ties)).alias("_best"))
    return best.select(group, "_best.*").withColumnRenamed("_d", "distance")


def next_at_or_after(left: DataFrame, right: DataFrame, on: list[str], at: str, right_at: str, carry: list[str]) -> DataFrame:
    """left with columns `carry` of the earliest row of right, within equal `on`, at or after its position."""
    keep = F.struct(F.col(right_at).alias("_pos"), *carry)
    u = left.select(*on, F.col(at).alias("_at"), F.lit(0).alias("_side"), F.struct(*left.columns).alias("_l"), F.lit(None).cast(right.select(keep.alias("k")).schema["k"].dataType).alias("_r"))
    v = right.select(*on, F.col(right_at).alias("_at"), F.lit(1).alias("_side"), F.lit(None).cast(left.select(F.struct(*left.columns).alias("k")).schema["k"].dataType).alias("_l"), keep.alias("_r"))
    ahead = Window.partitionBy(*on).orderBy("_at", "_side", "_r").rowsBetween(0, Window.unboundedFollowing)
    out = u.unionByName(v).withColumn("_n", F.first("_r", ignorenulls=True).over(ahead)).where("_side = 0")
    return out.select("_l.*", *[F.col(f"_n.{c}").alias(c) for c in carry])


def tolerance_pairs(df: DataFrame, on: list[str], id_col: str, pos: list[str], within: int, where: Column | None = None) -> DataFrame:
    """Pairs a, b of rows (a_ and b_ columns) with a's id smaller, equal `on`, and each position within tolerance.

    The first position is bucketed, so that each row meets only its neighbours; `where` may use a_ and b_ columns.
    """
    a = df.select(*[F.col(c).alias(f"a_{c}") for c in df.columns])
    b = df.select(*[F.col(c).alias(f"b_{c}") for c in df.columns])
    step = max(1, within)
    a = a.withColumn("_bucket", F.explode(F.sequence(F.floor(F.col(f"a_{pos[0]}") / step) - 1, F.floor(F.col(f"a_{pos[0]}") / step) + 1)))
    b = b.withColumn("_bucket", F.floor(F.col(f"b_{pos[0]}") / step))
    cond = (F.col(f"a_{id_col}") < F.col(f"b_{id_col}")) & (a["_bucket"] == b["_bucket"])
    for c in on:
        cond = cond & (F.col(f"a_{c}") == F.col(f"b_{c}"))
    for c in pos:
        cond = cond & (F.abs(F.col(f"a_{c}") - F.col(f"b_{c}")) <= within)
    if where is not None:
        cond = cond & where
    return a.join(b, cond).drop("_bucket")
