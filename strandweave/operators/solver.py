"""Non-negative and bounded least squares: normal equations added up in Spark, coordinate descent on the driver.

The driver holds the Gram matrix of the active columns only: p columns take 8 p^2 bytes, and more than `max_columns`
is refused, so its memory doesn't grow with the number of bins.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandweave.operators import matrix as M


@dataclass
class Normal:
    """A^T A, A^T b, the squared norm of b and the number of rows, over named columns."""

    columns: list[int]
    gram: np.ndarray
    right: np.ndarray
    target_square: float
    rows: int

    def places(self) -> dict[int, int]:
        return {c: k for k, c in enumerate(self.columns)}

    def subset(self, keep: list[int]) -> "Normal":
        place = self.places()
        at = [place[c] for c in keep]
        return Normal(list(keep), self.gram[np.ix_(at, at)], self.right[at], self.target_square, self.rows)


def normal_equations(matrix: DataFrame, target: DataFrame, max_columns: int = 12_000) -> Normal:
    """Collects the normal equations of a long matrix; bins without target take no part."""
    m = matrix.join(target.select("bin"), "bin", "left_semi")
    columns = [r[0] for r in m.select("col").distinct().orderBy("col").limit(max_columns + 1).collect()]
    if len(columns) > max_columns:
        raise ValueError(f"more than {max_columns} columns")
    at = {c: k for k, c in enumerate(columns)}
    gram = np.zeros((len(columns), len(columns)))
    for r in M.gram_blocks(m, columns).toLocalIterator():
        part = np.frombuffer(r["cells"], "<f8").reshape(r["rows"], -1)
        i, j = r["bi"] * M.BLOCK, r["bj"] * M.BLOCK
        gram[i : i + part.shape[0], j : j + part.shape[1]] = part
        gram[j : j + part.shape[1], i : i + part.shape[0]] = part.T
    right = np.zeros(len(columns))
    for r in M.right_side(m, target).toLocalIterator():
        right[at[r["col"]]] = r["value"]
    t = target.agg(F.sum(F.col("value") ** 2), F.count("*")).first()
    return Normal(columns, gram, right, float(t[0] or 0), int(t[1]))


def bounded_least_squares(
    n: Normal, lower: float | np.ndarray = 0.0, upper: float | np.ndarray = np.inf, start: np.ndarray | None = None, tol: float = 1e-7, max_sweeps: int = 100_000
) -> np.ndarray:
    """Coordinate descent with active sets for half the mean squared error under bounds.

    Inner sweeps go over the active set until the largest v d^2 falls under tol times the variance of the target; then
    columns that violate optimality come in, and the fit ends when there are none.
    """
    p = len(n.columns)
    scale = max(n.rows, 1)
    gram, right = n.gram / scale, n.right / scale
    lower, upper = np.broadcast_to(lower, p).astype(float), np.broadcast_to(upper, p).astype(float)
    x = np.clip(np.zeros(p) if start is None else np.asarray(start, float), lower, upper)
    var = max(n.target_square / scale, 1e-300)
    v = np.diag(gram).copy()
    grad = right - gram @ x
    active = (x > lower) | (lower != 0)
    sweeps = 0
    eps = 1e-9 * max(1.0, float(np.abs(right).max(initial=0)))
    while True:
        while True:
            worst = 0.0
            for k in np.flatnonzero(active & (v > 0)):
                new = min(max(x[k] + grad[k] / v[k], lower[k]), upper[k])
                d = new - x[k]
                if d:
                    x[k] = new
                    grad -= gram[:, k] * d
                    worst = max(worst, v[k] * d * d)
            sweeps += 1
            if worst <= tol * tol * var:
                break
            if sweeps > max_sweeps:
                raise RuntimeError("no convergence")
        up = (grad > eps) & (x < upper) & (v > 0)
        down = (grad < -eps) & (x > lower) & (v > 0)
        new = (up | down) & ~active
        if not new.any():
            return x
        active |= new


def optimality_gap(n: Normal, x: np.ndarray) -> float:
    """Largest violation of the optimality conditions of non-negative least squares, relative to |A^T b|."""
    grad = n.right - n.gram @ x
    bad = np.where(x > 0, np.abs(grad), np.maximum(grad, 0))
    return float(bad.max(initial=0) / max(1e-300, np.abs(n.right).max(initial=0)))


def squared_error(n: Normal, x: np.ndarray) -> float:
    return float(x @ n.gram @ x - 2 * x @ n.right + n.target_square)


def weights_frame(spark: SparkSession, n: Normal, x: np.ndarray) -> DataFrame:
    return spark.createDataFrame([(int(c), float(w)) for c, w in zip(n.columns, x, strict=True)], "col int, w double")


def fit(matrix: DataFrame, target: DataFrame, start: dict[int, float] | None = None, **options) -> DataFrame:
    """(col, w) of the non-negative fit, on clean bins only if target has is_clean."""
    t = target.where("is_clean") if "is_clean" in target.columns else target
    n = normal_equations(matrix, t)
    s = None if start is None else np.array([start.get(c, 0.0) for c in n.columns])
    return weights_frame(matrix.sparkSession, n, bounded_least_squares(n, start=s, **options))


def removal_errors(spark: SparkSession, n: Normal, candidates: dict[str, list[int]], warm: np.ndarray) -> DataFrame:
    """(candidate, error, relative): squared error when each candidate's columns are left out, solved side by side."""
    held = spark.sparkContext.broadcast((n, warm))  # 8 p^2 bytes with p at most max_columns
    base = squared_error(n, bounded_least_squares(n, start=warm))
    rows = spark.createDataFrame([(k, list(map(int, v))) for k, v in candidates.items()], "candidate string, cols array<int>")

    def solve(batches):
        eq, start = held.value
        place = eq.places()
        for pdf in batches:
            out = []
            for cols in pdf["cols"]:
                gone = set(map(int, cols))
                keep = [c for c in eq.columns if c not in gone]
                sub = eq.subset(keep)
                out.append(squared_error(sub, bounded_least_squares(sub, start=start[[place[c] for c in keep]])))
            yield pdf.assign(error=out)[["candidate", "error"]]

    got = rows.repartition(max(1, min(len(candidates), 64))).mapInPandas(solve, "candidate string, error double")
    return got.withColumn("relative", F.sqrt(F.greatest(F.col("error"), F.lit(0.0)) / max(base, 1e-300)))
