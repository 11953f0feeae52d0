"""Embedding near-duplicates: iterative quantisation, multi-index Hamming tables, rerank with original vectors.

Vectors are compared within one label. A rotation learned on a bounded sample makes balanced binary codes of
the vectors; disjoint substrings of the code key hash tables, and vectors that share a key of any table are
compared by cosine in double precision. Equal vectors are one class from the start, so copies are never
compared with each other. Substring width follows the number of classes of the largest label, and the number
of tables follows from the width, so that a pair at the threshold shares a key with probability `recall`. Codes
are of vectors less their label's mean, which widens the angle of a pair: the number of tables is that of the
widened angle, by the norms of the centred sample. A label that crowds so closely around its mean that this takes
more than `WIDEST` times the tables isn't centred.

Pairs are not rows: each group of a table yields, for each vector, how many links it found (a link counts in
the first table whose key the two share) and one edge to the first vector it reaches within the group. A
key with more than `block` vectors is cut into blocks, and each pair of blocks is a group of its own, so no
task gathers a whole hot key and no pair is lost. Hot keys meet their sizes by broadcast, without a shuffle.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandweave.operators.components import connected_components, join_counted, local_roots, smallest_names
from strandweave.runtime import cut


def fit_itq(x: np.ndarray, rotations: int, seed: int = 7, rounds: int = 30) -> np.ndarray:
    """Rotations (rotations x d x d) of centred vectors x whose signs lose least: ITQ from several random starts."""
    d = x.shape[1]
    _, _, basis = np.linalg.svd(x, full_matrices=False) if len(x) >= d else (0, 0, np.eye(d))
    out = []
    for k in range(rotations):
        r = np.linalg.qr(np.random.default_rng(seed + k).normal(size=(d, d)))[0]
        v = x @ basis.T
        for _ in range(rounds if len(x) >= d else 0):
            b = np.where(v @ r > 0, 1.0, -1.0)
            left, _, right = np.linalg.svd(b.T @ v)
            r = (left @ right).T
        out.append(basis.T @ r)
    return np.array(out)


#: Times the tables of uncentred vectors that centring may take.
WIDEST = 8


#: Vectors of a label and dimension that a sample must hold for their mean to be taken off.
LEAST_CENTRED = 50


class Codes:
    """Model of the codes: centres by label, rotations by dimension, and the shape of the tables.

    tables is the number that uncentred vectors need; labels that are centred may raise it. Each dimension has its own
    rotation; one with fewer sampled vectors than components gets random ones, whose codes are as valid.
    """

    def __init__(self, names: np.ndarray, vectors: pa.ListArray, width: int, tables: int, threshold: float, recall: float):
        self.width, self.tables = width, tables
        units: dict[int, np.ndarray] = {}
        offs, flat = vectors.offsets.to_numpy(), np.asarray(vectors.values.to_numpy(zero_copy_only=False), float)
        dims = np.diff(offs)
        self.rotation, self.centre = {}, {}
        for d in np.unique(dims).tolist():
            at = np.flatnonzero(dims == d)
            x = flat[offs[:-1][at][:, None] + np.arange(d)]
            x /= np.linalg.norm(x, axis=1)[:, None]
            labels = names[at]
            for label in set(labels.tolist()):
                own = labels == label
                if own.sum() >= LEAST_CENTRED:
                    centre = x[own].mean(0)
                    need = tables_of_centred(np.linalg.norm(x[own] - centre, axis=1), width, threshold, recall, WIDEST * tables)
                    if need is not None:
                        self.tables = max(self.tables, need)
                        self.centre[label, d] = centre
                        x[own] -= centre
            units[d] = x
        for d, x in units.items():
            self.rotation[d] = fit_itq(x, math.ceil(width * self.tables / d))

    def keys(self, label: int, unit: np.ndarray) -> np.ndarray:
        """One integer for each vector and table. A dimension that the sample lacks gets random rotations."""
        d = unit.shape[1]
        if d not in self.rotation:
            self.rotation[d] = fit_itq(np.zeros((0, d)), math.ceil(self.width * self.tables / d), seed=d)
        x = unit - self.centre[label, d] if (label, d) in self.centre else unit
        bits = np.concatenate([x @ r > 0 for r in self.rotation[d]], axis=1)[:, : self.width * self.tables]
        return bits.reshape(len(x), self.tables, self.width) @ (1 << np.arange(self.width, dtype=np.int64))


def shape_of_tables(n: int, threshold: float, recall: float, bucket: int = 16) -> tuple[int, int]:
    """Width of a key and number of tables for n vectors in a label."""
    width = int(min(24, max(4, round(math.log2(max(n, 1) / bucket))))) if n > bucket else 4
    same = (1 - math.acos(threshold) / math.pi) ** width
    return width, max(1, math.ceil(math.log(1 - recall) / math.log(1 - same)))


def tables_of_centred(norms: np.ndarray, width: int, threshold: float, recall: float, most: int) -> int | None:
    """Tables for pairs at the threshold of unit vectors whose centred norms are given; None if more than `most`.

    The difference of a pair stays what it is, so its angle is widest where both have the smaller one's norm.
    """
    half = math.sqrt(max(0.0, (1 - threshold) / 2))
    angle = 2 * np.arcsin(np.minimum(1.0, half / np.maximum(norms, 1e-12)))
    same = (1 - angle / math.pi) ** width

    def enough(tables: int) -> bool:
        return bool(np.mean((1 - same) ** tables) <= 1 - recall)

    if not enough(most):
        return None
    low, high = 0, most
    while high - low > 1:
        mid = (low + high) // 2
        low, high = (low, mid) if enough(mid) else (mid, high)
    return high


def _group_links(t: int, ids, weight, x, codes, side, threshold: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Positions with links in a group, what the links add to n_links, and the position of the local root.

    side: 0 for all pairs of the group; else 1 and 2, and only pairs across the sides count.
    """
    order = np.argsort(ids, kind="stable")
    ids, weight, x, codes, side = ids[order], weight[order], x[order], codes[order], side[order]
    found_i, found_j = [], []
    for a in range(0, len(ids), 1024):
        sim = x[a : a + 1024] @ x[a:].T
        i, j = np.nonzero(sim >= threshold)
        ok = i < j
        i, j = i[ok] + a, j[ok] + a
        if side[0] or side[-1]:
            ok = side[i] != side[j]
            i, j = i[ok], j[ok]
        ok = (codes[i] == codes[j]).argmax(1) == t
        found_i.append(i[ok])
        found_j.append(j[ok])
    i, j = np.concatenate(found_i), np.concatenate(found_j)
    add = np.bincount(i, weight[j], len(ids)) + np.bincount(j, weight[i], len(ids))
    root = local_roots(len(ids), i, j)
    has = np.flatnonzero(add)
    return order[has], add[has], order[root[has]]


def near_duplicate_vectors(
    df: DataFrame,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    label_col: str = "label",
    threshold: float = 0.98,
    recall: float = 0.9995,
    sample_rows: int = 20_000,
    block: int = 2048,
) -> DataFrame:
    """One row per row of df: id, n_links (other rows linked directly), component_id, kept (id = component_id).

    A label or vector that is null, a vector of no length, with null or non-finite components or of norm 0 links
    with nothing; such rows and rows without links are components of their own. Vectors of different dimension
    never link. Rows that repeat an id are rows of their own, each with the links of its own vector; component_id is
    the smallest id of a component's rows. A null id gives null component_id, kept true. An empty table gives an empty
    result. Other columns of df are not looked at.
    """
    spark = df.sparkSession
    rows = df.select(F.col(id_col).alias("vec_id"), F.col(label_col).alias("_label"), F.col(vector_col).cast("array<double>").alias("_v"))
    norm = F.aggregate("_v", F.lit(0.0), lambda acc, e: acc + e * e)
    good = F.col("_label").isNotNull() & F.col("vec_id").isNotNull() & (norm > 0) & (norm < float("inf"))
    rows = rows.withColumn("_ok", F.coalesce(good, F.lit(False)))
    keyed = rows.where("_ok").select("vec_id", "_label", F.xxhash64(F.lit(1), "_v").alias("_h1"), F.xxhash64(F.lit(2), "_v").alias("_h2"), "_v")
    # equal vectors of a label are one class, with a number of its own
    classes = keyed.groupBy("_label", "_h1", "_h2").agg(F.min("vec_id").alias("_name"), F.count("*").alias("_n"), F.first("_v").alias("_v"))
    classes = cut(classes.select(F.monotonically_increasing_id().alias("_rep"), "_label", "_h1", "_h2", "_name", "_n", "_v"), "classes")
    most, total = classes.groupBy("_label").agg(F.count("*").alias("n")).agg(F.max("n"), F.sum("n")).first()
    width, tables = shape_of_tables(most or 0, threshold, recall)
    sample = classes.orderBy(F.xxhash64("_name", "_h1"), "_name", "_h1").limit(sample_rows).select("_label", "_v").toArrow().combine_chunks()
    vectors = sample.column("_v").combine_chunks() if len(sample) else pa.array([], pa.list_(pa.float64()))
    codes = Codes(sample.column("_label").to_numpy(), vectors, width, tables, threshold, recall)
    tables = codes.tables
    model = spark.sparkContext.broadcast(codes)

    def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            labels = b.column("_label").to_numpy(zero_copy_only=False)
            vecs = b.column("_v")
            offs = vecs.offsets.to_numpy()
            flat = np.asarray(vecs.values.to_numpy(zero_copy_only=False), float)
            dims = np.diff(offs)
            keys = np.empty((len(dims), tables), np.int64)
            for d in np.unique(dims).tolist():
                at = np.flatnonzero(dims == d)
                x = flat[offs[:-1][at][:, None] + np.arange(d)]
                x = x / np.linalg.norm(x, axis=1)[:, None]
                for label in np.unique(labels[at]).tolist():
                    own = labels[at] == label
                    keys[at[own]] = model.value.keys(label, x[own])
            yield pa.RecordBatch.from_arrays(
                [b.column("_label"), b.column("_rep"), b.column("_n"), vecs, pa.FixedSizeListArray.from_arrays(pa.array(keys.ravel()), tables).cast(pa.list_(pa.int64()))],
                ["_label", "_rep", "_n", "_v", "_codes"],
            )

    label_type = classes.schema["_label"].dataType.simpleString()
    coded = classes.select("_label", "_rep", "_n", "_v").mapInArrow(code, f"_label {label_type}, _rep long, _n long, _v array<double>, _codes array<long>")
    coded = cut(coded, "codes")
    spread = coded.select("_label", F.size("_v").alias("_dim"), "_rep", "_n", "_v", "_codes", F.posexplode("_codes").alias("_t", "_key"))
    bucket = ["_label", "_dim", "_t", "_key"]
    sizes = cut(spread.groupBy(*bucket).agg(F.count("*").alias("_size")).where("_size > 1"), "sizes")
    grouped = join_counted(spread, sizes, bucket, "_size", (total or 0) * tables).withColumn("_blocks", F.ceil(F.col("_size") / block).cast("int"))
    own = F.pmod(F.xxhash64("_rep"), F.col("_blocks")).cast("int")
    pair = F.when(F.col("_blocks") == 1, F.array(F.struct(F.lit(0).alias("lo"), F.lit(0).alias("hi"), F.lit(0).alias("side")))).otherwise(
        F.transform(
            F.sequence(F.lit(0), F.col("_blocks") - 1),
            lambda o: F.struct(
                F.least(o, own).alias("lo"),
                F.greatest(o, own).alias("hi"),
                F.when(o == own, 0).when(own < o, 1).otherwise(2).alias("side"),
            ),
        )
    )
    grouped = grouped.withColumn("_pair", F.explode(pair)).select(
        F.xxhash64(*bucket, "_pair.lo", "_pair.hi").alias("_g"), "_t", "_rep", "_n", "_v", "_codes", F.col("_pair.side").alias("_side")
    )
    grouped = grouped.repartition("_g").sortWithinPartitions("_g")

    def link(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []

        def run(b: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
            g = b.column("_g").to_numpy()
            ids, n = b.column("_rep").to_numpy(), b.column("_n").to_numpy()
            t, side = b.column("_t").to_numpy(), b.column("_side").to_numpy()
            offs = b.column("_v").offsets.to_numpy()
            flat = b.column("_v").values.to_numpy(zero_copy_only=False)
            codes = b.column("_codes").values.to_numpy().reshape(-1, tables)
            first = b.column("_codes").offsets[0].as_py() // tables if len(b) else 0
            codes = codes[first : first + len(b)]
            cuts = np.concatenate([[0], np.flatnonzero(np.diff(g)) + 1, [len(g)]])
            out: list[tuple] = []
            for a, z in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
                if z - a < 2:
                    continue
                x = flat[offs[a] : offs[z]].reshape(z - a, -1)
                x = x / np.linalg.norm(x, axis=1)[:, None]
                at, add, root = _group_links(int(t[a]), ids[a:z], n[a:z].astype(float), x, codes[a:z], side[a:z], threshold)
                if len(at):
                    out.append((ids[a:z][at], add.astype(np.int64), ids[a:z][root]))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*out, strict=True)], ["_rep", "_add", "_root"])

        for b in batches:  # a group may span batches: what follows the last change of group waits
            if not len(b):
                continue
            g = b.column("_g").to_numpy()
            change = np.flatnonzero(np.diff(g))
            if held and held[-1].column("_g")[-1].as_py() != g[0]:
                yield from run(pa.Table.from_batches(held).combine_chunks().to_batches()[0])
                held = []
            if len(change):
                z = int(change[-1]) + 1
                yield from run(pa.Table.from_batches([*held, b.slice(0, z)]).combine_chunks().to_batches()[0])
                held, b = [], b.slice(z)
            held.append(b)
        if held:
            yield from run(pa.Table.from_batches(held).combine_chunks().to_batches()[0])

    links = cut(grouped.mapInArrow(link, "_rep long, _add long, _root long"), "links")
    names = classes.select(F.col("_rep").alias("id"), F.col("_name").cast("long").alias("name"))
    of = smallest_names(cut(connected_components(links, "_rep", "_root"), "tied"), names).select(F.col("id").alias("_rep"), "component_id")
    of_class = classes.select("_label", "_h1", "_h2", "_rep", "_name", "_n").join(links.groupBy("_rep").agg(F.sum("_add").alias("_add")), "_rep", "left").join(of, "_rep", "left")
    of_class = of_class.select(
        "_label", "_h1", "_h2", "_n", (F.coalesce("_add", F.lit(0)) + F.col("_n") - 1).alias("n_links"), F.coalesce("component_id", F.col("_name").cast("long")).alias("component_id")
    )
    of_class = cut(of_class, "named")
    linked = join_counted(keyed.drop("_v"), of_class, ["_label", "_h1", "_h2"], "_n", of_class.agg(F.sum("_n")).first()[0] or 0).select("vec_id", "n_links", "component_id")
    alone = rows.where("not _ok").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").cast("long").alias("component_id"))
    out = linked.unionByName(alone)
    return out.select(F.col("vec_id").alias(id_col), "n_links", "component_id", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)).alias("kept"))
