"""Depth-by-feature matrices in long form (col, bin, value) and everything that is added up over them."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def window_coverage(blocks: DataFrame, by: list[str], width: int) -> DataFrame:
    """Mean coverage of each window of `width` positions: aligned length in it (half-open st, nd) over its width.

    Windows without alignments have no row.
    """
    b = blocks.where("nd > st").select(*by, "st", "nd", F.explode(F.sequence(F.floor(F.col("st") / width), F.floor((F.col("nd") - 1) / width))).alias("bin"))
    part = F.least("nd", F.col("bin") * width + width) - F.greatest("st", F.col("bin") * width)
    return b.groupBy(*by, "bin").agg((F.sum(part) / float(width)).alias("coverage"))


def alignment_blocks(paf: DataFrame, cigar: str = "cigar") -> DataFrame:
    """Reference blocks (qname, tname, st, nd) of alignments whose CIGAR aligns bases there (M, = and X)."""
    ops = F.regexp_extract_all(cigar, F.lit("([0-9]+[MIDNSHP=X])"), F.lit(1))
    start = F.struct(F.col("tst").alias("at"), F.array().cast("array<struct<st:bigint,nd:bigint>>").alias("out"))

    def step(acc, op):
        n, kind = F.regexp_extract(op, "^([0-9]+)", 1).cast("long"), F.right(op, F.lit(1))
        moves = kind.isin("M", "=", "X", "D", "N")
        aligned = kind.isin("M", "=", "X")
        piece = F.array(F.struct(acc["at"].alias("st"), (acc["at"] + n).alias("nd")))
        return F.struct((acc["at"] + F.when(moves, n).otherwise(0)).alias("at"), F.when(aligned, F.concat(acc["out"], piece)).otherwise(acc["out"]).alias("out"))

    return paf.select("qname", "tname", F.explode(F.aggregate(ops, start, step)["out"]).alias("b")).select("qname", "tname", "b.st", "b.nd")


def path_matrix(parts: DataFrame, component_depth: DataFrame) -> DataFrame:
    """Matrix of columns that are sums of components: (col, component, sign) x (component, bin, value)."""
    return parts.join(component_depth, "component").groupBy("col", "bin").agg(F.sum(F.col("value") * F.col("sign")).alias("value")).where("value <> 0")


def jump_columns(base: DataFrame, over: DataFrame, kind: DataFrame) -> DataFrame:
    """Columns of jumps: over - base for front jumps, over + base for back jumps (col, kind)."""
    b = base.join(kind, "col").select("col", "bin", (F.col("value") * F.when(F.col("kind") == "front_jump", -1).otherwise(1)).alias("value"))
    return b.unionByName(over.select("col", "bin", "value")).groupBy("col", "bin").agg(F.sum("value").alias("value"))


def gram(matrix: DataFrame) -> DataFrame:
    """A^T A in long form (i <= j), as a self join on the bin. Rows per bin are the columns that are not 0 there."""
    a = matrix.select("bin", F.col("col").alias("i"), F.col("value").alias("vi"))
    b = matrix.select("bin", F.col("col").alias("j"), F.col("value").alias("vj"))
    return a.join(b, "bin").where("i <= j").groupBy("i", "j").agg(F.sum(F.col("vi") * F.col("vj")).alias("value"))


#: Columns of a block of A^T A, and bytes of the dense rows of A that a task multiplies at a time.
BLOCK, ROWS_BYTES = 512, 1 << 27


def gram_blocks(matrix: DataFrame, columns: list[int]) -> DataFrame:
    """A^T A as blocks (bi, bj, rows, cells: row-major doubles) with bi <= bj, over columns in the order given.

    Tasks hold whole bins, put them together as dense rows and multiply; partial blocks are added up by block, pair by
    pair. There are as many tasks as ROWS_BYTES go into A, but at least 8; each shuffles half of A^T A at most.
    """
    p = len(columns)
    order = np.argsort(np.array(columns, np.int64), kind="stable")
    known = np.array(columns, np.int64)[order]
    lows = range(0, p, BLOCK)
    most = max(1, ROWS_BYTES // (8 * max(p, 1)))
    parts = max(8, -(-matrix.agg(F.approx_count_distinct("bin")).first()[0] // most))

    def multiply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[tuple[int, int], np.ndarray] = {}
        rows: dict[int, int] = {}
        x = np.zeros((most, p))

        def add() -> None:
            dense = x[: len(rows)]
            for a in lows:
                for b in lows:
                    if a <= b:
                        got = dense[:, a : a + BLOCK].T @ dense[:, b : b + BLOCK]
                        total[a, b] = total[a, b] + got if (a, b) in total else got

        for batch in batches:
            bins, cols = batch.column("bin").to_pylist(), order[np.searchsorted(known, batch.column("col").to_numpy())]
            for k, c, v in zip(bins, cols.tolist(), batch.column("value").to_pylist(), strict=True):
                if k not in rows:
                    if len(rows) == most:  # bins come one after the other
                        add()
                        x[:] = 0
                        rows.clear()
                    rows[k] = len(rows)
                x[rows[k], c] += v
        if rows:
            add()
        for (a, b), cells in total.items():
            yield pa.RecordBatch.from_pydict({"bi": [a // BLOCK], "bj": [b // BLOCK], "rows": [cells.shape[0]], "cells": pa.array([cells.tobytes()], pa.binary())})

    def add_up(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        out = np.zeros(len(pdf["cells"].iloc[0]) // 8)
        for cells in pdf["cells"]:
            out += np.frombuffer(cells, "<f8")
        return pd.DataFrame({"bi": [key[0]], "bj": [key[1]], "rows": pdf["rows"].iloc[:1].tolist(), "cells": [out.tobytes()]})

    shape = "bi int, bj int, rows int, cells binary"
    rows = matrix.select("bin", F.col("col").cast("long").alias("col"), F.col("value").cast("double").alias("value")).repartition(parts, "bin").sortWithinPartitions("bin")
    return rows.mapInArrow(multiply, "bi long, bj long, rows long, cells binary").select(F.col("bi").cast("int"), F.col("bj").cast("int"), F.col("rows").cast("int"), "cells").groupBy("bi", "bj").applyInPandas(add_up, shape)


def right_side(matrix: DataFrame, target: DataFrame) -> DataFrame:
    """A^T b (col, value)."""
    return matrix.join(target.select("bin", F.col("value").alias("_t")), "bin").groupBy("col").agg(F.sum(F.col("value") * F.col("_t")).alias("value"))


def predict(matrix: DataFrame, weights: DataFrame) -> DataFrame:
    """A w (bin, value)."""
    return matrix.join(weights.select("col", "w"), "col").groupBy("bin").agg(F.sum(F.col("value") * F.col("w")).alias("value"))


def scatter(columns: DataFrame, weights: DataFrame) -> DataFrame:
    """Weights of a subset on all columns, 0 elsewhere."""
    return columns.select("col").join(weights.select("col", "w"), "col", "left").withColumn("w", F.coalesce("w", F.lit(0.0)))


def fit_metrics(predicted: DataFrame, target: DataFrame) -> DataFrame:
    """L2 error of a prediction and its ratio to the norm of the target; bins that aren't predicted count as 0."""
    d = target.select("bin", F.col("value").alias("b")).join(predicted.select("bin", F.col("value").alias("p")), "bin", "left").withColumn("p", F.coalesce("p", F.lit(0.0)))
    e = F.sqrt(F.sum((F.col("p") - F.col("b")) ** 2))
    return d.agg(e.alias("l2_error"), (e / F.sqrt(F.sum(F.col("b") ** 2))).alias("relative_error"))


def prior_rows(matrix: DataFrame, prior_columns: DataFrame, n_rows: int, strength: float) -> DataFrame:
    """(col, scale) of normal columns: sqrt(strength * n_rows / sum of base squares * own square)."""
    norm = matrix.join(prior_columns.select("col", "is_base"), "col").groupBy("col", "is_base").agg(F.sum(F.col("value") ** 2).alias("sq"))
    base = norm.where("is_base").agg(F.sum("sq").alias("base"))
    return norm.crossJoin(F.broadcast(base)).select("col", F.sqrt(F.lit(strength) * n_rows / F.col("base") * F.col("sq")).alias("scale"))  # base: one row


def with_prior(matrix: DataFrame, target: DataFrame, prior: DataFrame, first_bin: int) -> tuple[DataFrame, DataFrame]:
    """Matrix and target with one more bin for each prior (col, scale, target), numbered from first_bin by col."""
    from pyspark.sql import Window

    p = prior.withColumn("bin", (F.row_number().over(Window.orderBy("col")) - 1 + first_bin).cast("int"))  # a few normal columns
    m = matrix.select("col", "bin", "value").unionByName(p.select("col", "bin", F.col("scale").alias("value")))
    t = target.select("bin", "value").unionByName(p.select("bin", (F.col("scale") * F.col("target")).alias("value")))
    return m, t
