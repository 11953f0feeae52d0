"""Filter loops around the fit: drop, refit, and compare running sums with a fixed baseline.

Loops run on the driver, over one row per column, event or chromosome; fits and per-bin sums run in Spark.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandweave.operators import ordered as O
from strandweave.operators import solver as L


def envelope(a: DataFrame, b: DataFrame, chrom: str = "chr", pos: str = "st") -> DataFrame:
    """(chr, peak, peak_st): largest absolute running sum of a - b along each chromosome; both have chr, st, value."""
    d = a.select(chrom, pos, F.col("value").alias("_a")).join(b.select(chrom, pos, F.col("value").alias("_b")), [chrom, pos]).withColumn("_d", F.col("_a") - F.col("_b"))
    return O.cumulative_peak(d, [chrom], [pos], "_d")


def fit_failures(new: DataFrame, base: DataFrame, observed: DataFrame, limit: float = 1.5, zero_fails: bool = True) -> DataFrame:
    """(chr, ratio) where the change from base, by its envelope, is more than `limit` of base's own misfit.

    A chromosome whose base fits exactly fails when anything changed, or with zero_fails=False never.
    """
    change = envelope(new, base).select("chr", F.col("peak").alias("_n"))
    misfit = envelope(base, observed).select("chr", F.col("peak").alias("_d"))
    d = change.join(misfit, "chr").withColumn("ratio", F.when(F.col("_d") > 0, F.col("_n") / F.col("_d")).when((F.col("_n") > 0) & F.lit(zero_fails), F.lit(float("inf"))).otherwise(0.0))
    return d.where(F.col("ratio") > limit).select("chr", "ratio")


def opposite_drop(records: DataFrame, unit: float, within: int = 1_000_000, least: float = 1e-6, share: float = 0.1) -> DataFrame:
    """Junction pairs on one chromosome pair with opposite sides at both ends, close to each other, of nearly equal depth."""
    from strandweave.operators.range_join import tolerance_pairs

    where = (F.col("a_side1") != F.col("b_side1")) & (F.col("a_side2") != F.col("b_side2"))
    p = tolerance_pairs(records, ["chr1", "chr2"], "event", ["pos1", "pos2"], within, where)
    return p.where((F.abs(F.col("a_depth") - F.col("b_depth")) < share * unit) & (F.greatest("a_depth", "b_depth") >= least)).select(F.col("a_event").alias("a"), F.col("b_event").alias("b"))


def reciprocal_candidates(ends: DataFrame, within: int = 5_000) -> DataFrame:
    """Candidates (a, b) of junctions with equal chromosome pairs, other sides at both ends, and both ends close.

    ends: event, chr1, pos1, side1, chr2, pos2, side2, in canonical order; a is the one whose first side is left.
    """
    from strandweave.operators.range_join import tolerance_pairs

    where = (F.col("a_side1") != F.col("b_side1")) & (F.col("a_side2") != F.col("b_side2"))
    p = tolerance_pairs(ends, ["chr1", "chr2"], "event", ["pos1", "pos2"], within, where)
    left = F.col("a_side1") == "left"
    return p.select(F.when(left, F.col("a_event")).otherwise(F.col("b_event")).alias("a"), F.when(left, F.col("b_event")).otherwise(F.col("a_event")).alias("b"))


def step_droppable(sides: DataFrame, share: float = 0.25) -> DataFrame:
    """Events both of whose sides are droppable: no step in depth, in the expected direction, of `share` of their depth.

    sides: event, side (high side), left_mean, right_mean, depth, out_of_split. A side without bins is kept; a side out
    of the splits is droppable.
    """
    step = F.when(F.col("side") == "right", F.col("right_mean") - F.col("left_mean")).otherwise(F.col("left_mean") - F.col("right_mean"))
    drop = F.when(F.col("out_of_split"), True).when(step.isNull() | (F.col("depth") <= 0), False).otherwise(step / F.col("depth") < share)
    return sides.withColumn("_drop", drop).groupBy("event").agg(F.bool_and("_drop").alias("drop")).where("drop").select("event")


@dataclass
class Loop:
    """State of a filter loop: columns left, and events dropped with their reasons, the first one sticking."""

    active: set[int]
    reasons: dict[object, str] = field(default_factory=dict)

    def drop(self, columns: Iterable[int], event: object | None = None, reason: str | None = None) -> None:
        self.active -= set(columns)
        if event is not None and reason is not None:
            self.reasons.setdefault(event, reason)


def forbid_and_release(loop: Loop, forbidden: dict[object, set[int]], fails: Callable[[set[int]], set[object]], reason: str) -> Loop:
    """Drops all forbidden columns, refits, and gives back the sides that then fail, until none does.

    forbidden: side -> columns; fails(active) -> sides whose chromosomes no longer fit.
    """
    live = dict(forbidden)
    whole = set(loop.active)
    while True:
        gone = set().union(*live.values()) if live else set()
        back = fails(whole - gone) & set(live)
        if not back:
            loop.drop(gone)
            for side in live:
                loop.reasons.setdefault(side, reason)
            return loop
        for side in back:  # so there are at most as many rounds as sides
            del live[side]


def accumulate_failures(loop: Loop, candidates: dict[object, set[int]], chroms: dict[object, set[str]], fails: Callable[[set[int]], set[str]], reason: str) -> Loop:
    """Drops candidates that touch no failed chromosome; chromosomes that then fail are added, until none is new."""
    failed: set[str] = set()
    whole = set(loop.active)
    drop: list[object] = []
    while True:
        drop = [e for e in candidates if not (chroms.get(e, set()) & failed)]
        gone = set().union(*(candidates[e] for e in drop)) if drop else set()
        new = fails(whole - gone) - failed
        if not new:
            break
        failed |= new
    for e in drop:
        loop.drop(candidates[e], e, reason)
    return loop


def greedy_removal(
    n: L.Normal, candidates: list[tuple[object, set[int]]], accept: Callable[[dict[int, float]], bool], start: np.ndarray | None = None
) -> tuple[set[object], dict[int, float]]:
    """Removes candidates in order, refitting from the last weights, and keeps each removal that `accept` lets pass.

    accept gets the weights by column after a removal. Returns what was removed, and the final weights.
    """
    w = L.bounded_least_squares(n, start=start)
    now = dict(zip(n.columns, w.tolist(), strict=True))
    removed: set[object] = set()
    columns = list(n.columns)
    for name, cols in candidates:
        keep = [c for c in columns if c not in cols]
        sub = n.subset(keep)
        got = dict(zip(keep, L.bounded_least_squares(sub, start=np.array([now.get(c, 0.0) for c in keep])).tolist(), strict=True))
        if accept(got):
            removed.add(name)
            columns, now = keep, got
    return removed, now


def swap_plan(eligible: dict[object, set[int]], fragments: dict[str, int], chroms: dict[object, set[str]], active: set[int]) -> tuple[set[int], set[int], set[object]]:
    """(columns to bring back, fragment columns to switch off, events) of one atomic swap of rescued junctions for fragments.

    Events whose chromosome has an active fragment take part; the fragment goes off as their columns come back.
    """
    used = {e for e in eligible if chroms.get(e, set()) & {c for c, col in fragments.items() if col in active}}
    on = set().union(*(eligible[e] for e in used)) - active if used else set()
    off = {col for c, col in fragments.items() if col in active and any(c in chroms.get(e, set()) for e in used)}
    return on, off, used


def swap_until_accepted(plan_for: Callable[[set[object]], tuple[set[int], set[int], set[object]]], events: set[object], rejected_by: Callable[[set[int], set[int]], set[object]]):
    """Plans and tests a swap, leaves out the events that fail it, and plans anew, until it holds or nothing is left."""
    live = set(events)
    while True:
        on, off, used = plan_for(live)
        if not used:
            return set(), set(), set()
        bad = rejected_by(on, off) & used
        if not bad:
            return on, off, used
        live -= bad  # so there are at most as many rounds as events


def rescue_first(scores: DataFrame) -> DataFrame:
    """Column order: carriers of rescued events, then by falling score, then path id; a total order."""
    from pyspark.sql import Window

    w = Window.orderBy(F.col("is_rescue").desc(), F.col("score").desc(), "path_id")  # one row per candidate path
    return scores.withColumn("col", F.row_number().over(w) - 1)


def validate_rescue_prefix(columns: DataFrame) -> None:
    """Columns of rescued events must come before all others and be numbered from 0 without gaps."""
    r = columns.agg(F.max(F.when(F.col("is_rescue"), F.col("col"))).alias("last"), F.count(F.when(F.col("is_rescue"), 1)).alias("n"), F.max("col").alias("hi"), F.count("*").alias("all")).first()
    if r["n"] and r["last"] != r["n"] - 1 or r["all"] and r["hi"] != r["all"] - 1:
        raise ValueError("rescued columns are not a prefix")
