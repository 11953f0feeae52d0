"""Interval predicates and arithmetic as column expressions. Every predicate names its boundary convention."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

KINDS = ("closed", "half_open", "half_open_point", "contained", "contains", "strictly_inside", "strictly_spans")


def relation(kind: str, a_st: Column, a_nd: Column, b_st: Column, b_nd: Column) -> Column:
    """Whether interval a stands in this relation to interval b.

    closed: they share a position, touching ends included. half_open: [st, nd) share a position. half_open_point:
    as half_open, and an empty a (st = nd) counts as the point st. contained: a lies in b, ends included.
    contains: b lies in a. strictly_inside: a lies in b and touches neither end. strictly_spans: a reaches
    beyond b at both ends.
    """
    if kind == "closed":
        return ~((a_nd < b_st) | (a_st > b_nd))
    if kind == "half_open":
        return (a_st < b_nd) & (b_st < a_nd)
    if kind == "half_open_point":
        return F.when(a_st == a_nd, (b_st <= a_st) & (a_st < b_nd)).otherwise((a_st < b_nd) & (b_st < a_nd))
    if kind == "contained":
        return (b_st <= a_st) & (a_nd <= b_nd)
    if kind == "contains":
        return (a_st <= b_st) & (b_nd <= a_nd)
    if kind == "strictly_inside":
        return (b_st < a_st) & (a_nd < b_nd)
    if kind == "strictly_spans":
        return (a_st < b_st) & (a_nd > b_nd)
    raise ValueError(f"kind must be one of {KINDS}")


def distance(a_st: Column, a_nd: Column, b_st: Column, b_nd: Column) -> Column:
    """0 where the intervals overlap strictly, else the smaller gap between facing ends."""
    overlap = F.greatest(a_st, b_st) < F.least(a_nd, b_nd)
    return F.when(overlap, F.lit(0)).otherwise(F.least(F.abs(b_st - a_nd), F.abs(b_nd - a_st)))


def end_gap(a_st: Column, a_nd: Column, b_st: Column, b_nd: Column) -> Column:
    """The smaller gap between facing ends, whether or not the intervals overlap."""
    return F.least(F.abs(b_st - a_nd), F.abs(b_nd - a_st))


def overlap_length(a_st: Column, a_nd: Column, b_st: Column, b_nd: Column, inclusive: bool = False) -> Column:
    """Positions shared, at least 0; inclusive counts both ends."""
    return F.greatest(F.lit(0), F.least(a_nd, b_nd) - F.greatest(a_st, b_st) + (1 if inclusive else 0))


def to_one_based(st: Column, nd: Column, length: Column) -> tuple[Column, Column]:
    """Half-open 0-based interval as 1-based closed, clamped to 1..length; an empty one widens to one position."""
    lo = F.least(F.greatest(F.least(st, nd) + 1, F.lit(1)), length)
    hi = F.least(F.greatest(F.greatest(st, nd), F.lit(1)), length)
    return lo, F.greatest(lo, hi)


def centred(point: Column, width: int, length: Column) -> tuple[Column, Column]:
    """Window of this width around a point, clamped to 0..length."""
    half = width // 2
    return F.greatest(point - half, F.lit(0)), F.least(point + (width - half), length)


def stepwise(intervals: Column) -> Column:
    """Starts and ends of an array of (st, nd) both grow, and none overlaps the one before the last."""
    step = lambda i: (
        (intervals[i]["st"] > intervals[i - 1]["st"])
        & (intervals[i]["nd"] > intervals[i - 1]["nd"])
        & ((i < 2) | (intervals[i]["st"] >= F.get(intervals, i - 2)["nd"]))
    )
    n = F.size(intervals)
    return F.when(n < 2, F.lit(True)).otherwise(F.forall(F.sequence(F.lit(1), n - 1), step))


def each_within(alt: Column, segments: Column) -> Column:
    """Every (st, nd) of alt lies in some segment; the first segment is open to the left, the last to the right."""
    n = F.size(segments)

    def fits(b: Column) -> Column:
        return F.exists(
            F.transform(segments, lambda s, i: ((i == 0) | (s["st"] <= b["st"])) & ((i == n - 1) | (b["nd"] <= s["nd"]))), lambda x: x
        )

    return F.forall(alt, fits)


def inner_interval(a_st: Column, a_nd: Column, b_st: Column, b_nd: Column) -> tuple[Column, Column]:
    """Gap between two spans, or what they share."""
    lo, hi = F.greatest(a_st, b_st), F.least(a_nd, b_nd)
    return F.least(lo, hi), F.greatest(lo, hi)


def outer_interval(a_st: Column, a_nd: Column, b_st: Column, b_nd: Column) -> tuple[Column, Column]:
    """Smallest interval that holds both spans."""
    return F.least(a_st, b_st), F.greatest(a_nd, b_nd)
