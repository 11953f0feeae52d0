"""Quality classifier: histogram gradient-boosted trees over document statistics.

Statistics are computed by vectorised kernels over the bytes of whole texts. The trees are grown on the driver
from a bounded sample of labelled rows, level by level over binned features, and flattened into arrays (feature,
threshold, value of each node of complete trees), through which numpy moves all rows of a batch at once.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from strandweave.llm import bytekit as bk

_KIND = np.zeros(256, np.uint8)  # classes of bytes
for _bytes, _k in (
    (range(97, 123), 1), (range(65, 91), 2), (range(48, 58), 3), (b" \t\r\x0b\x0c", 4), (b"\n", 5), (b".,;:?'\"()-", 6),
    (b"!", 7), (b"|", 8), (b"#$%&*+=<>@[]\\^_`{}~/", 9), (range(128, 192), 10), (range(192, 256), 11),
):
    _KIND[list(_bytes)] = _k
N_KINDS = 12
FEATURES = (
    [f"share_kind_{k}" for k in range(N_KINDS)]
    + ["log_bytes", "log_words", "bytes_per_word", "upper_of_letters", "distinct_words", "repeat_next", "repeat_pairs", "distinct_lines",
       "words_per_line", "longest_word", "short_words", "symbol_words", "top_word"]
)


def _block_statistics(data: np.ndarray, offs: np.ndarray) -> np.ndarray:
    n = len(offs) - 1
    out = np.zeros((n, len(FEATURES)))
    size = np.diff(offs).astype(float)
    some = np.maximum(size, 1)
    kinds = _KIND[data]
    full = size > 0
    row_of_byte_counts = np.zeros((n, N_KINDS))
    for k in range(N_KINDS):
        if full.any() and len(data):
            row_of_byte_counts[full, k] = np.add.reduceat(kinds == k, offs[:-1][full], dtype=np.int64)
    out[:, :N_KINDS] = row_of_byte_counts / some[:, None]
    letters = row_of_byte_counts[:, 1] + row_of_byte_counts[:, 2]
    starts, ends, row = bk.spans(data, offs, bk.NOT_SPACE)
    words = np.bincount(row, minlength=n).astype(float)
    w = np.maximum(words, 1)
    length = (ends - starts).astype(float)
    c = N_KINDS
    out[:, c] = np.log1p(size)
    out[:, c + 1] = np.log1p(words)
    out[:, c + 2] = np.bincount(row, length, n) / w
    out[:, c + 3] = row_of_byte_counts[:, 2] / np.maximum(letters, 1)
    h = bk.hashes(data, starts, ends)
    one, one_offs = bk.shingles(h, row, n, 1)
    out[:, c + 4] = np.diff(one_offs) / w
    same = (h[1:] == h[:-1]) & (row[1:] == row[:-1])
    out[:, c + 5] = np.bincount(row[1:][same], minlength=n) / w
    _, two_offs = bk.shingles(h, row, n, 2)
    out[:, c + 6] = np.diff(two_offs) / np.maximum(words - 1, 1)
    ls, le, lrow = bk.spans(data, offs, bk.NOT_NEWLINE)
    lines = np.bincount(lrow, minlength=n).astype(float)
    _, line_offs = bk.shingles(bk.hashes(data, ls, le), lrow, n, 1)
    out[:, c + 7] = np.diff(line_offs) / np.maximum(lines, 1)
    out[:, c + 8] = words / np.maximum(lines, 1)
    longest = np.zeros(n)
    np.maximum.at(longest, row, length)
    out[:, c + 9] = longest
    out[:, c + 10] = np.bincount(row[length <= 2], minlength=n) / w
    if len(starts):
        out[:, c + 11] = np.bincount(row[np.isin(kinds[ends - 1], (7, 8, 9))], minlength=n) / w
        order = np.lexsort((h, row))
        hs, rs = h[order], row[order]
        first = np.flatnonzero(np.concatenate([[True], (hs[1:] != hs[:-1]) | (rs[1:] != rs[:-1])]))
        run = np.diff(np.concatenate([first, [len(hs)]]))
        top = np.zeros(n)
        np.maximum.at(top, rs[first], run)
        out[:, c + 12] = top / w
    return out


def statistics(col: pa.Array) -> np.ndarray:
    """Rows x FEATURES of a string column; null counts as empty. Memory follows the largest text."""
    data, offs = bk.buffers(col)
    parts = [_block_statistics(data[offs[i] : offs[j]], offs[i : j + 1] - offs[i]) for i, j in bk.blocks(offs)]
    return np.concatenate(parts) if parts else np.zeros((0, len(FEATURES)))


@dataclass
class Forest:
    """Complete trees of one depth: inner nodes in breadth-first order, leaves after them."""

    feature: np.ndarray  # trees x (2**depth - 1)
    threshold: np.ndarray
    value: np.ndarray  # trees x 2**depth
    base: float

    def margin(self, x: np.ndarray) -> np.ndarray:
        depth = self.value.shape[1].bit_length() - 1
        out = np.full(len(x), self.base)
        at = np.arange(len(x))
        for f, t, v in zip(self.feature, self.threshold, self.value, strict=True):
            node = np.zeros(len(x), np.int64)
            for _ in range(depth):
                node = 2 * node + 1 + (x[at, f[node]] > t[node])
            out += v[node - len(f)]
        return out

    def probability(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.margin(x), -40, 40)))


def fit_forest(
    x: np.ndarray, y: np.ndarray, weight: np.ndarray | None = None, trees: int = 80, depth: int = 4, rate: float = 0.15, bins: int = 64, l2: float = 1.0, least: float = 5.0
) -> Forest:
    """Logistic boosting. y: 0 or 1 (or a share). Without rows, or with one class, every row gets that base rate."""
    n, m = x.shape
    weight = np.ones(n) if weight is None else weight
    mean = np.clip(np.average(y, weights=weight) if n else 0.5, 1e-3, 1 - 1e-3)
    base = float(np.log(mean / (1 - mean)))
    inner, leaves = 2**depth - 1, 2**depth
    if n == 0:
        return Forest(np.zeros((0, inner), int), np.zeros((0, inner)), np.zeros((0, leaves)), base)
    cuts = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, bins + 1)[1:-1])) for j in range(m)]
    code = np.stack([np.searchsorted(cuts[j], x[:, j], "left") for j in range(m)], 1)  # bin b: x <= cuts[b]
    score = np.full(n, base)
    features, thresholds, values = [], [], []
    for _ in range(trees):
        p = 1 / (1 + np.exp(-score))
        g, h = (p - y) * weight, np.maximum(p * (1 - p), 1e-6) * weight
        node = np.zeros(n, np.int64)
        feat, thr = np.zeros(inner, np.int64), np.full(inner, np.inf)
        for d in range(depth):
            k = 2**d
            first = k - 1
            best = np.full(k, 1e-9)
            local = node - first
            total_g, total_h = np.bincount(local, g, k), np.bincount(local, h, k)
            for j in range(m):
                if not len(cuts[j]):
                    continue
                key = local * bins + code[:, j]
                gs = np.bincount(key, g, k * bins).reshape(k, bins).cumsum(1)[:, : len(cuts[j])]
                hs = np.bincount(key, h, k * bins).reshape(k, bins).cumsum(1)[:, : len(cuts[j])]
                rg, rh = total_g[:, None] - gs, total_h[:, None] - hs
                gain = gs**2 / (hs + l2) + rg**2 / (rh + l2) - (total_g**2 / (total_h + l2))[:, None]
                gain[(hs < least * 0.05) | (rh < least * 0.05)] = 0
                b = gain.argmax(1)
                top = gain[np.arange(k), b]
                better = top > best
                best[better] = top[better]
                feat[first : first + k][better] = j
                thr[first : first + k][better] = cuts[j][b[better]]
            node = 2 * node + 1 + (x[np.arange(n), feat[node]] > thr[node])
        leaf = node - inner
        value = -rate * np.bincount(leaf, g, leaves) / (np.bincount(leaf, h, leaves) + l2)
        score = score + value[leaf]
        features.append(feat)
        thresholds.append(thr)
        values.append(value)
    return Forest(np.array(features), np.array(thresholds), np.array(values), base)


def held_out(id_col: str = "doc_id") -> Column:
    """crc32 of the id as text, modulo 4, is 2; never of a null id."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 4 == 2, F.lit(False))


def fit_quality(docs: DataFrame, labels: DataFrame, max_rows: int = 16_000, **options) -> Forest:
    """Fits on at most max_rows labelled documents, those whose id hashes lowest; held-out ids never take part.

    Labels that are null or of a null id are left out; contradicting labels of one id count as their share. Of rows that
    repeat an id the one whose text hashes lowest is learned from, so that the driver gets at most max_rows rows.
    """
    known = labels.where(F.col("doc_id").isNotNull() & F.col("quality").isNotNull() & ~held_out())
    known = known.groupBy("doc_id").agg(F.avg(F.when(F.col("quality") > 0, 1.0).otherwise(0.0)).alias("_y"))
    known = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_rows)
    rows = docs.select("doc_id", F.col("text").cast("string").alias("text"), F.xxhash64(F.col("text").cast("string")).alias("_th"))
    rows = rows.join(F.broadcast(known), "doc_id").select("doc_id", "text", "_th", "_y")  # at most max_rows ids

    def take(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = statistics(b.column("text"))
            listed = pa.FixedSizeListArray.from_arrays(pa.array(x.ravel()), len(FEATURES)).cast(pa.list_(pa.float64()))
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("_th"), b.column("_y"), listed], ["doc_id", "_th", "_y", "x"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    got = rows.mapInArrow(take, f"doc_id {kind}, _th long, _y double, x array<double>")
    got = got.groupBy("doc_id").agg(F.min(F.struct("_th", "_y", "x")).alias("_one")).select("doc_id", "_one._y", "_one.x").toPandas().sort_values("doc_id", kind="stable")
    x = np.array(got["x"].tolist(), float).reshape(len(got), len(FEATURES))
    return fit_forest(x, got["_y"].to_numpy(float), **options)


def quality_score(model: Forest, text: str = "text") -> Column:
    """Score in 0..1 of each whole text; null counts as empty."""
    held = SparkSession.getActiveSession().sparkContext.broadcast(model)

    @F.arrow_udf("double")
    def score(col: pa.Array) -> pa.Array:
        return pa.array(held.value.probability(statistics(col)))

    return score(F.col(text).cast("string"))


def score_quality(docs: DataFrame, labels: DataFrame, threshold: float = 0.7, **options) -> DataFrame:
    """doc_id, held_out, score, predicted of every row of docs. An empty table of labels gives every row 0.5.

    Null text is empty and has a score as any; rows that repeat an id are scored by their own texts; null ids are never
    held out. predicted is 1 where the score reaches the threshold, equality included.
    """
    model = fit_quality(docs, labels, **options)
    out = docs.select("doc_id", held_out().alias("held_out"), quality_score(model).alias("score"))
    return out.withColumn("predicted", (F.col("score") >= threshold).cast("int"))


def keep_quality(docs: DataFrame, labels: DataFrame, threshold: float = 0.7, **options) -> DataFrame:
    """The rows of docs, with all their columns, whose score reaches the threshold; rows are judged one by one, as score_quality
    does, whatever their ids. An empty table of labels keeps nothing at a threshold above 0.5."""
    model = fit_quality(docs, labels, **options)
    name = "_quality_score"
    while name in docs.columns:
        name += "_"
    return docs.withColumn(name, quality_score(model)).where(F.col(name) >= threshold).drop(name)
