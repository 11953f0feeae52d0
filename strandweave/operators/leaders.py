"""Greedy leader clustering: rows in order join the first earlier leader that is close enough, else lead themselves."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def greedy_leaders(df: DataFrame, by: list[str], order: list[str], pos: list[str], within: float, strict: bool = False, weight: str | None = None) -> DataFrame:
    """df with leader (number of the leader in its group), is_leader and, with weight, the leader's total.

    The first leader (in order of appearance) whose every position is within the tolerance takes the row; strict: less
    than it. The outcome depends on order by definition, so each group is one ordered fold; leaders are found through
    buckets of the first position, so a row meets only leaders near it. Groups stream in order through a task and only
    leaders are held.
    """
    schema = T.StructType([*df.schema.fields, T.StructField("leader", T.LongType()), T.StructField("is_leader", T.BooleanType())])

    def fold(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        group, leaders, buckets = object(), [], {}
        step = max(float(within), 1e-9)
        for pdf in batches:
            keys = list(zip(*(pdf[c] for c in by), strict=True)) if by else [()] * len(pdf)
            places = pdf[pos].to_numpy(float)
            lead, own = np.empty(len(pdf), np.int64), np.zeros(len(pdf), bool)
            for i, (key, p) in enumerate(zip(keys, places, strict=True)):
                if key != group:
                    group, leaders, buckets = key, [], {}
                b = int(p[0] // step)
                near = sorted(x for k in (b - 1, b, b + 1) for x in buckets.get(k, ()))
                for x in near:
                    d = np.abs(leaders[x] - p)
                    if (d < within).all() if strict else (d <= within).all():
                        lead[i] = x
                        break
                else:
                    lead[i], own[i] = len(leaders), True
                    buckets.setdefault(b, []).append(len(leaders))
                    leaders.append(p)
            yield pdf.assign(leader=lead, is_leader=own)

    dealt = df.repartition(*[F.col(c) for c in by]) if by else df.repartition(1)
    out = dealt.sortWithinPartitions(*by, *order).mapInPandas(fold, schema)
    if weight:
        total = out.groupBy(*by, "leader").agg(F.sum(weight).alias("leader_weight"))
        out = out.join(total, [*by, "leader"])
    return out


def max_aligned_match(a: list[tuple[str, int]], b: list[tuple[str, int]]) -> int:
    """Largest length over which two sequences of (label, length) agree when one is slid along the other.

    What two sequences share is piecewise linear in the shift, and bends only where ends meet, so those shifts suffice.
    """
    ae = np.concatenate([[0], np.cumsum([n for _, n in a])]) if a else np.zeros(1)
    be = np.concatenate([[0], np.cumsum([n for _, n in b])]) if b else np.zeros(1)
    if not a or not b:
        return 0
    same = np.array([[x == y for y, _ in b] for x, _ in a])
    best = 0
    for shift in np.unique(ae[:, None] - be[None, :]):
        lo = np.maximum(ae[:-1, None], be[None, :-1] + shift)
        hi = np.minimum(ae[1:, None], be[None, 1:] + shift)
        best = max(best, int((np.maximum(hi - lo, 0) * same).sum()))
    return best


def joins_leader(a: list[tuple[str, int]], b: list[tuple[str, int]], same_ends: float = 0.8, other: float = 0.9) -> bool:
    """The best alignment covers enough of the longer sequence; less is asked where first and last labels agree."""
    longest = max(sum(n for _, n in a), sum(n for _, n in b))
    if not a or not b or longest == 0:
        return False
    ends = (a[0][0], a[-1][0]) == (b[0][0], b[-1][0])
    return max_aligned_match(a, b) / longest >= (same_ends if ends else other)


def karyotype_clusters(paths: list[tuple[object, float, int, list[tuple[str, int]]]], least_weight: float) -> list[tuple[object, float, list[object]]]:
    """Clusters of (id, weight, n_junctions, pieces) in order: (representative, weight, members), those above least_weight.

    A path joins the first leader that it matches; the representative has the fewest junctions, the first of equals.
    """
    leaders: list[list] = []
    for path in paths:
        for group in leaders:
            if joins_leader(group[0][3], path[3]):
                group.append(path)
                break
        else:
            leaders.append([path])
    out = []
    for group in leaders:
        total = sum(p[1] for p in group)
        if total > least_weight:
            out.append((min(group, key=lambda p: p[2])[0], total, [p[0] for p in group]))
    return out
