"""Packing token sequences as a cutting-stock problem solved by column generation.

A document of n tokens gives n // size full pieces, each a sequence of its own, and a rest. The rests are the
items: their length histogram (binned, at most about 300 bins, whatever the number of documents) is covered by
patterns of at most `size` tokens. A linear program over patterns is solved by column generation, each new
pattern priced by an unbounded knapsack over the dual prices; pattern counts are rounded down and what is left
is placed first-fit by decreasing length. Items are ranked within their bin, ranks are dealt out to the
pattern slots of that bin in order, and so every piece finds its sequence by arithmetic on its rank.

Rests that don't fit together are cut: patterns filled to less than `full` aren't used, and the items that they would
take are laid end to end and cut where a sequence is full. So whatever the lengths, all sequences but one are filled to
`full`, less what binning rounds up (1 part in 100 of an item at most).

Only the total histogram, a row per bin, reaches the driver. Ranks and positions add up counts of input partitions by
windows over one row per partition (and bin).
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from strandweave.llm.tokens import default_tokenizer, encoder
from strandweave.runtime import cut


def bin_edges(size: int, exact: int = 128) -> np.ndarray:
    """Upper edges of the length bins: every length to `exact`, then steps of less than 1 part in 64."""
    edges, x = [], 0
    while x < size - 1:
        x += max(1, (x - exact) // 96 + 1) if x >= exact else 1
        edges.append(min(x, size - 1))
    return np.array(edges or [1])


def _price(value: np.ndarray, length: np.ndarray, size: int) -> tuple[float, np.ndarray]:
    """Best unbounded knapsack of capacity size by dual values, and how often it takes each item."""
    useful = np.flatnonzero(value > 1e-12)
    w, v = length[useful], value[useful]  # lengths grow
    usable = np.searchsorted(w, np.arange(size + 1), "right").tolist()
    best, take = np.zeros(size + 1), [-1] * (size + 1)
    for c in range(1, size + 1):
        n = usable[c]
        best[c] = best[c - 1]
        if n:
            cand = best[c - w[:n]] + v[:n]
            k = int(cand.argmax())
            if cand[k] > best[c] + 1e-12:
                best[c], take[c] = cand[k], k
    pattern, c = np.zeros(len(value), np.int64), size
    while c > 0:
        if take[c] < 0:
            c -= 1
        else:
            pattern[useful[take[c]]] += 1
            c -= int(w[take[c]])
    return float(best[size]), pattern


def first_fit(length: np.ndarray, demand: np.ndarray, size: int) -> list[tuple[np.ndarray, int]]:
    """Patterns by decreasing length, each used as often as demand allows; they cover demand exactly."""
    left, out = demand.astype(np.int64).copy(), []
    while left.any():
        room, pattern = size, np.zeros(len(length), np.int64)
        for i in np.flatnonzero(left)[::-1].tolist():
            if length[i] <= room:
                n = min(int(left[i]), room // int(length[i]))
                pattern[i] = n
                room -= n * int(length[i])
        some = pattern > 0
        n = int((left[some] // pattern[some]).min())
        out.append((pattern, n))
        left -= n * pattern
    return out


def solve_patterns(length: np.ndarray, demand: np.ndarray, size: int, rounds: int = 250, gap: float = 4e-3) -> list[tuple[np.ndarray, int]]:
    """Patterns (items taken of each bin) and how many sequences use each; together they cover demand exactly.

    The linear program starts from patterns of one bin each, takes in those of first fit, and then the column that the
    knapsack finds at each round, until no solution can be better by more than gap: by the knapsack's bound, or by the
    tokens themselves (or until rounds end). Counts are rounded down and the rest is placed by first fit; where first fit alone needs no more sequences, its patterns are used.
    """
    m = len(length)
    plain = first_fit(length, demand, size)
    if m == 0:
        return plain
    # products of a few hundred numbers are summed plainly: threads of a linear-algebra library cost more than they save
    times = lambda a, v: (a * v).sum(1)
    columns = [np.where(np.arange(m) == i, size // length[i], 0) for i in range(m)]
    basis = np.array(columns, float).T
    inverse = np.diag(1.0 / np.diag(basis))
    x = times(inverse, demand)
    ready = [p for p, _ in sorted(plain, key=lambda pn: -pn[1])] * 2
    material = float((demand * length).sum()) / size
    for step in range(rounds + len(ready)):
        dual = inverse.sum(0)
        if step < len(ready):
            pattern = ready[step]
            if (dual * pattern).sum() <= 1 + 1e-9:
                continue
        else:
            if x.sum() <= material * (1 + gap):
                break
            value, pattern = _price(dual, length, size)
            if value <= 1 + gap:  # no solution uses less than this one's sequences divided by value
                break
        d = times(inverse, pattern)
        up = d > 1e-10
        ratio = np.full(m, np.inf)
        ratio[up] = x[up] / d[up]
        r = int(ratio.argmin())
        columns[r] = pattern
        basis[:, r] = pattern
        row = inverse[r] / d[r]
        inverse = inverse - np.outer(d, row)
        inverse[r] = row
        x = times(inverse, demand)
        if np.abs(times(basis, x) - demand).max() > 1e-6 * demand.max():  # what rounding has added up
            inverse = np.linalg.inv(basis)
            x = times(inverse, demand)
        x = np.maximum(x, 0)
    left = demand.astype(np.int64).copy()
    out: list[tuple[np.ndarray, int]] = []
    for k in np.argsort(-x, kind="stable").tolist():
        some = columns[k] > 0
        n = min(int(x[k] + 1e-9), int((left[some] // columns[k][some]).min()))
        if n > 0:
            out.append((columns[k], n))
            left -= n * columns[k]
    out += first_fit(length, left, size)
    return out if sum(n for _, n in out) <= sum(n for _, n in plain) else plain


def _slots(plan: list[tuple[np.ndarray, int]], base: int) -> list[tuple[int, int, int, int, int, int]]:
    """(bin, first rank, end of ranks, items per sequence, first sequence, first slot) of each pattern and bin."""
    used: dict[int, int] = {}
    rows, seq = [], base
    for pattern, n in plan:
        slot = 0
        for i in np.flatnonzero(pattern)[::-1].tolist():
            a, k = used.get(i, 0), int(pattern[i])
            rows.append((i, a, a + k * n, k, seq, slot))
            used[i] = a + k * n
            slot += k
        seq += n
    return rows


_PIECE = ["doc_id", "start", "length", "ids_crc32", "doc_tokens"]


def pack(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    size: int = 1024,
    tokenizer: str | None = None,
    end_id: int = 0,
    full: float = 0.994,
) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    Null text is empty and still has its end id. Rows that repeat a doc_id are documents of their own; a null
    doc_id stays null. An empty table gives an empty result. Extra columns are not looked at. sequence_id runs
    from 0 without gaps; offset is gapless in each sequence. full: patterns filled to less than this share are not used,
    and their items are cut to fit; at 0 no rest is ever cut.
    """
    spark = docs.sparkSession
    path = tokenizer or default_tokenizer()
    edges = bin_edges(size)

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part = TaskContext.get().partitionId()
        enc, end = encoder(path), struct.pack("<I", end_id)
        ranks = np.zeros(len(edges) + 1, np.int64)
        kinds = [pa.int64()] * 5 + [pa.int32()] * 2 + [pa.int64(), pa.binary()]
        for b in batches:
            rows: list[tuple] = []
            for doc, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                ids = enc.ids(text) + end
                n = len(ids) // 4
                for a in range(0, n, size):
                    piece = ids[4 * a : 4 * (a + size)]
                    k = len(piece) // 4
                    at = len(edges) if k == size else int(np.searchsorted(edges, k))
                    rows.append((doc, a, k, zlib.crc32(piece), n, part, at, int(ranks[at]), None if k == size else piece))
                    ranks[at] += 1
            cols = list(zip(*rows, strict=True)) or [[]] * 9
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], [*_PIECE, "_part", "_bin", "_rank", "_ids"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    shape = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, _part int, _bin int, _rank long, _ids binary"
    made = cut(rows.mapInArrow(pieces, shape), "pieces")
    # ranks within a part become ranks of all by the counts of the parts before it
    before = Window.partitionBy("_bin").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    cells = cut(made.groupBy("_part", "_bin").agg(F.count("*").alias("_n")).withColumn("_base", F.coalesce(F.sum("_n").over(before), F.lit(0).cast("long"))), "cells")
    total = np.zeros(len(edges) + 1, np.int64)
    for r in cells.groupBy("_bin").agg(F.sum("_n").alias("n")).collect():
        total[r["_bin"]] = r["n"]
    have = np.flatnonzero(total[:-1])
    plan = solve_patterns(edges[have], total[:-1][have], size) if len(have) else []
    plan = [(p, n) for p, n in plan if (p * edges[have]).sum() >= full * size]
    whole = int(total[-1])
    slots = [(int(have[i]), *rest) for i, *rest in _slots(plan, whole)]
    if whole:
        slots.append((len(edges), 0, whole, 1, 0, 0))
    laid_from = whole + sum(n for _, n in plan)
    deal = spark.createDataFrame(slots, "_bin int, _from long, _to long, _each long, _seq long, _slot long")
    by_bin = deal.groupBy("_bin").agg(F.array_sort(F.collect_list(F.struct("_from", "_to", "_each", "_seq", "_slot"))).alias("_deal"))  # a row per bin
    ranked = made.join(cells.drop("_n"), ["_part", "_bin"]).withColumn("_rank", F.col("_rank") + F.col("_base")).drop("_base")
    put = ranked.join(F.broadcast(by_bin), "_bin", "left").withColumn("_d", F.expr("get(filter(_deal, d -> d._from <= _rank and _rank < d._to), 0)")).drop("_deal")
    k = F.col("_rank") - F.col("_d._from")
    dealt = put.where("_d is not null").select(*_PIECE, (F.col("_d._seq") + F.floor(k / F.col("_d._each"))).alias("sequence_id"), (F.col("_d._slot") + k % F.col("_d._each")).alias("_slot"))
    ahead = Window.partitionBy("sequence_id").orderBy("_slot").rowsBetween(Window.unboundedPreceding, -1)
    dealt = dealt.withColumn("offset", F.coalesce(F.sum("length").over(ahead), F.lit(0))).drop("_slot")
    if int(total[:-1].sum()) == sum(int(p.sum()) * n for p, n in plan):
        return dealt
    # the others stand end to end, by part, bin and rank
    rest = put.where("_d is null").select(*_PIECE, "_part", "_bin", "_rank", "_ids")
    over = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)  # a row per part
    parts = rest.groupBy("_part").agg(F.sum("length").alias("_l")).withColumn("_before", F.coalesce(F.sum("_l").over(over), F.lit(0).cast("long"))).drop("_l")
    along = Window.partitionBy("_part").orderBy("_bin", "_rank").rowsBetween(Window.unboundedPreceding, -1)
    rest = rest.withColumn("_at", F.coalesce(F.sum("length").over(along), F.lit(0).cast("long"))).join(parts, "_part").withColumn("_at", F.col("_at") + F.col("_before"))
    first, last = F.floor(F.col("_at") / size), F.floor((F.col("_at") + F.col("length") - 1) / size)
    rest = rest.withColumn("_s", F.explode(F.sequence(first, last)))
    a, z = F.greatest(F.col("_at"), F.col("_s") * size), F.least(F.col("_at") + F.col("length"), (F.col("_s") + 1) * size)
    rest = rest.withColumn("_a", a - F.col("_at")).withColumn("_n", z - a)
    piece = F.expr("substring(_ids, cast(4 * _a + 1 as int), cast(4 * _n as int))")
    laid = rest.select(
        "doc_id", (F.col("start") + F.col("_a")).alias("start"), F.col("_n").alias("length"),
        F.when(F.col("_n") == F.col("length"), F.col("ids_crc32")).otherwise(F.crc32(piece)).alias("ids_crc32"), "doc_tokens",
        (F.col("_s") + laid_from).alias("sequence_id"), (F.col("_at") + F.col("_a") - F.col("_s") * size).alias("offset"),
    )
    return dealt.unionByName(laid)
