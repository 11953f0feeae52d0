"""Robust noise, total-variation denoising, rank tests and filters: the sequential ones run per group in Python."""

from __future__ import annotations

import math
from collections import deque

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from strandweave.operators import ordered as O
from strandweave.runtime import cut

#: 0.75 quantile of the normal distribution.
MAD_QUANTILE = 0.6744897501960817
#: 0.975 quantile of the normal distribution.
NORMAL_975 = 1.959963984540054


def robust_sigma(df: DataFrame, by: list[str], value: str) -> DataFrame:
    """Median absolute deviation over the normal quantile, of each group, with its count."""
    w = df.groupBy(*by).agg(F.median(value).alias("_mid"))
    return df.join(w, by).groupBy(*by).agg((F.median(F.abs(F.col(value) - F.col("_mid"))) / MAD_QUANTILE).alias("sigma"), F.count("*").alias("n"))


def noise_sigma(df: DataFrame, chrom: str, run: str, pos: str, depth: str, least: int = 20) -> DataFrame:
    """Noise of each chromosome from differences of neighbouring positive bins; the global one where there are few.

    A track without any gives 1.
    """
    diffs = O.positive_differences(df, [chrom, run], [pos], depth)
    own = robust_sigma(diffs, [chrom], "diff").select(chrom, (F.col("sigma") / math.sqrt(2)).alias("own"), "n")
    whole = robust_sigma(diffs.withColumn("_all", F.lit(1)), ["_all"], "diff").select((F.col("sigma") / math.sqrt(2)).alias("g"))
    whole = whole.agg(F.max("g").alias("g")).select(F.when(F.col("g") > 0, F.col("g")).otherwise(1.0).alias("g"))
    d = df.select(chrom).distinct().join(own, chrom, "left").crossJoin(F.broadcast(whole))  # one row
    return d.select(chrom, F.when((F.col("n") >= least) & (F.col("own") > 0), F.col("own")).otherwise(F.col("g")).alias("sigma"))


def tv_denoise_values(y: np.ndarray, lam: float) -> np.ndarray:
    """argmin_x of half the squared distance to y plus lam times the sum of absolute steps, by dynamic programming.

    Going right, the derivative of the best cost as a function of the current value is piecewise linear; it is kept as
    knots, clipped to [-lam, lam] at each step, and where it was clipped bounds the value on the way back.
    """
    y = np.asarray(y, float)
    n = len(y)
    if n <= 1 or lam <= 0:
        return y.copy()
    knots: deque[tuple[float, float, float]] = deque()  # position, change of slope, change of intercept
    lower, upper = np.empty(n), np.empty(n)
    lower[0], upper[0] = y[0] - lam, y[0] + lam
    knots.append((lower[0], 1.0, -y[0] + lam))
    knots.append((upper[0], -1.0, y[0] + lam))
    for k in range(1, n):
        last = k == n - 1
        bound = 0.0 if last else lam
        slope, icept = 1.0, -lam - y[k]
        while knots and slope * knots[0][0] + icept <= -bound:
            _, a, b = knots.popleft()
            slope, icept = slope + a, icept + b
        lower[k] = (-bound - icept) / slope
        if last:
            break
        left = (slope, icept)
        slope, icept = -1.0, -lam + y[k]
        while knots and -slope * knots[-1][0] - icept >= bound:
            _, a, b = knots.pop()
            slope, icept = slope + a, icept + b
        upper[k] = (bound + icept) / -slope
        knots.appendleft((lower[k], left[0], left[1] + lam))
        knots.append((upper[k], slope, icept + lam))
    out = np.empty(n)
    out[-1] = lower[-1]
    for k in range(n - 2, -1, -1):
        out[k] = min(max(out[k + 1], lower[k]), upper[k])
    return out


def tv_denoise(df: DataFrame, by: list[str], pos: str, value: str, lam: str, floor: float | None = 0.0) -> DataFrame:
    """df with `denoised`: the values of each run (group) denoised with its own lam, not below floor."""
    schema = df.withColumn("denoised", F.lit(0.0)).schema

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(pos, kind="stable")
        out = tv_denoise_values(pdf[value].to_numpy(float), float(pdf[lam].iloc[0]))
        return pdf.assign(denoised=out if floor is None else np.maximum(out, floor))

    return df.groupBy(*by).applyInPandas(run, schema)


def denoised_error(df: DataFrame, chrom: str, pos: str, observed: str, predicted: str, step: int, multiplier: float = 3.0) -> DataFrame:
    """Norm of prediction minus denoised observation over the norm of the latter; runs end at gaps. A zero norm is null."""
    d = O.contiguous_runs(df, [chrom], pos, step)
    d = d.join(noise_sigma(d, chrom, "run", pos, observed), chrom).withColumn("_lam", F.col("sigma") * multiplier)
    t = tv_denoise(d, [chrom, "run"], pos, observed, "_lam")
    e = F.sqrt(F.sum((F.col(predicted) - F.col("denoised")) ** 2)) / F.nullif(F.sqrt(F.sum(F.col("denoised") ** 2)), F.lit(0.0))
    return t.agg(e.alias("denoised_relative_error"))


def misfit_labels(df: DataFrame, predicted: str, observed: str, amplitude: float, excluded: str) -> DataFrame:
    """df with label: excluded where that column says so, misfit where the prediction, 0 at least, is off by more than
    the 0.975 quantile of noise of this amplitude, else fit."""
    off = F.abs(F.greatest(F.col(predicted), F.lit(0.0)) - F.col(observed)) > amplitude * NORMAL_975
    return df.withColumn("label", F.when(F.col(excluded), "excluded").when(off, "misfit").otherwise("fit"))


def rank_sum_test(df: DataFrame, by: list[str], group: str, value: str) -> DataFrame:
    """Mann-Whitney U of group 1 against group 0 in each partition of df: u, n1, n0, z and two-sided p.

    Ranks of ties are averaged; p is the normal approximation with tie and continuity corrections.
    """
    c = df.groupBy(*by, value).agg(F.count("*").alias("t"), F.sum(F.when(F.col(group) == 1, 1).otherwise(0)).alias("t1"))
    before = Window.partitionBy(*by).orderBy(value).rowsBetween(Window.unboundedPreceding, -1)
    c = c.withColumn("_r", F.coalesce(F.sum("t").over(before), F.lit(0)) + (F.col("t") + 1) / 2)
    g = c.groupBy(*by).agg(
        F.sum("t1").alias("n1"), F.sum(F.col("t") - F.col("t1")).alias("n0"), F.sum(F.col("_r") * F.col("t1")).alias("r1"),
        F.sum(F.pow("t", F.lit(3.0)) - F.col("t")).alias("ties"),
    )
    n1, n0 = F.col("n1").cast("double"), F.col("n0").cast("double")
    n = n1 + n0
    g = g.withColumn("u", F.col("r1") - n1 * (n1 + 1) / 2).withColumn("_sd", F.sqrt(n1 * n0 / 12 * ((n + 1) - F.col("ties") / (n * (n - 1)))))
    g = g.withColumn("z", (F.greatest(F.abs(F.col("u") - n1 * n0 / 2) - 0.5, F.lit(0.0))) / F.nullif(F.col("_sd"), F.lit(0.0)))

    @F.arrow_udf("double")
    def two_sided(z: pa.Array) -> pa.Array:  # a row per group
        return pa.array([None if x is None else min(1.0, math.erfc(x / math.sqrt(2))) for x in z.to_pylist()], pa.float64())

    return g.select(*by, "n1", "n0", "u", "z").withColumn("p", two_sided("z"))


def mann_whitney(a: np.ndarray, b: np.ndarray) -> float:
    """Two-sided p: exact where one sample has at most 8 values and there are no ties, else normal approximation."""
    a, b = np.asarray(a, float), np.asarray(b, float)
    n, m = len(a), len(b)
    if not n or not m:
        return float("nan")
    both = np.concatenate([a, b])
    _, inverse, counts = np.unique(both, return_inverse=True, return_counts=True)
    rank = (np.cumsum(counts) - (counts - 1) / 2)[inverse]
    u = rank[:n].sum() - n * (n + 1) / 2
    if min(n, m) <= 8 and (counts == 1).all():
        ways = np.zeros((n + 1, n * m + 1))
        ways[0, 0] = 1
        for j in range(1, n + m + 1):  # sums of ranks, one value at a time
            for k in range(min(n, j), 0, -1):
                shift = j - k
                if shift <= n * m:
                    ways[k, shift:] += ways[k - 1, : n * m + 1 - shift] if shift else ways[k - 1]
        dist = ways[n] / ways[n].sum()
        top = max(u, n * m - u)
        return float(min(1.0, 2 * dist[int(math.ceil(top)) :].sum()))
    ties = (counts.astype(float) ** 3 - counts).sum()
    total = n + m
    sd = math.sqrt(n * m / 12 * (total + 1 - ties / (total * (total - 1))))
    if sd == 0:
        return float("nan")
    z = (abs(u - n * m / 2) - 0.5) / sd
    return float(min(1.0, math.erfc(z / math.sqrt(2))))


def merge_splits(splits: DataFrame, windows: DataFrame, p_value: float = 0.01, least: int = 5) -> DataFrame:
    """splits (chr, pos, fixed) with `merged`: whether the depths at the two sides of a split don't differ.

    windows: chr, st, nd, depth. The sides of a split reach to the splits that are left on its chromosome, or to its ends,
    and a window that crosses a border counts at both. Each round tests all splits of all chromosomes at once and merges
    the first one of each chromosome whose sides, of at least `least` windows each, are alike; rounds end when none is.
    Fixed splits stay. Splits are few to a chromosome, so they are broadcast to the windows.
    """
    every = splits.select("chr", F.col("pos").cast("double").alias("pos"), "fixed").distinct()
    reach = windows.groupBy("chr").agg(F.max("nd").cast("double").alias("_end"))
    open_ = cut(every.join(reach, "chr", "left"), "splits")
    order = Window.partitionBy("chr").orderBy("pos")

    def test(pdf: pd.DataFrame) -> pd.DataFrame:
        left, right = pdf.loc[pdf["below"], "depth"], pdf.loc[pdf["above"], "depth"]
        p = mann_whitney(left, right) if len(left) >= least and len(right) >= least else float("nan")
        return pd.DataFrame({"chr": pdf["chr"].iloc[:1], "pos": pdf["pos"].iloc[:1], "p": [p]})

    while True:
        spans = open_.withColumn("lo", F.coalesce(F.lag("pos").over(order), F.lit(0.0))).withColumn("hi", F.coalesce(F.lead("pos").over(order), "_end"))
        near = windows.select("chr", "st", "nd", "depth").join(F.broadcast(spans.where("not fixed")), "chr").where("nd > lo and st < hi")
        near = near.select("chr", "pos", (F.col("st") < F.col("pos")).alias("below"), (F.col("nd") > F.col("pos")).alias("above"), "depth")
        alike = near.groupBy("chr", "pos").applyInPandas(test, "chr string, pos double, p double").where(f"not isnan(p) and p >= {p_value}")
        gone = cut(alike.groupBy("chr").agg(F.min("pos").alias("pos")), "merged")
        if not gone.limit(1).count():
            return every.join(open_.select("chr", "pos", F.lit(False).alias("_open")), ["chr", "pos"], "left").select("chr", "pos", "fixed", F.col("_open").isNull().alias("merged"))
        open_ = cut(open_.join(F.broadcast(gone), ["chr", "pos"], "left_anti"), "splits")


def butterworth_highpass(x: np.ndarray, cutoff: float, rate: float, order: int = 3) -> np.ndarray:
    """Zero-phase high-pass: a Butterworth filter by bilinear transform, run forwards and backwards over padded data."""
    x = np.asarray(x, float)
    warped = 4 * math.tan(math.pi * (cutoff / (0.5 * rate)) / 2)
    poles = -np.exp(1j * math.pi * np.arange(-order + 1, order, 2) / (2 * order))
    poles = warped / poles
    z_poles = (4 + poles) / (4 - poles)
    a = np.real(np.poly(z_poles))
    b = np.real(np.poly(np.ones(order)))
    b *= np.abs(np.polyval(a, -1) / np.polyval(b, -1))
    pad = 3 * (order + 1)
    if len(x) <= pad:
        raise ValueError(f"more than {pad} values are needed")
    ext = np.concatenate([2 * x[0] - x[pad:0:-1], x, 2 * x[-1] - x[-2 : -pad - 2 : -1]])
    companion = np.zeros((order, order))
    companion[:, 0] = -a[1:]
    companion[:-1, 1:] = np.eye(order - 1)
    start = np.linalg.solve(np.eye(order) - companion, b[1:] - a[1:] * b[0])

    def once(v: np.ndarray) -> np.ndarray:
        state, out = start * v[0], np.empty(len(v))
        for i, s in enumerate(v):
            y = b[0] * s + state[0]
            state = np.append(state[1:], 0.0) + b[1:] * s - a[1:] * y
            out[i] = y
        return out

    return once(once(ext)[::-1])[::-1][pad:-pad]


def noise_amplitude(df: DataFrame, by: list[str], pos: str, value: str, cutoff: float, rate: float) -> DataFrame:
    """Population deviation of the high-passed values of each group; null for short ones."""
    schema = df.select(*by).withColumn("noise", F.lit(0.0)).schema

    def run(key, pdf: pd.DataFrame) -> pd.DataFrame:
        v = pdf.sort_values(pos, kind="stable")[value].to_numpy(float)
        return pd.DataFrame([[*key, float(np.std(butterworth_highpass(v, cutoff, rate))) if len(v) > 12 else None]], columns=[*by, "noise"])

    return df.groupBy(*by).applyInPandas(run, schema)
