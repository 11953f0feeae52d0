"""Near-duplicate texts by MinHash with tensored banding, confirmed on full shingle sets.

Two collections of `half` short keys each are made from few minhashes (half keys of `width` minhashes); a table
key combines one half key of each collection, so that 2 * half * width minhashes give half * half tables of
2 * width minhashes. Texts with equal shingle sets are one class from the start, and all that follows is about classes.

Classes that share a table key, a bucket, are candidates, and only verified links tie buckets together:

1. Each bucket's members are compared with its hub, the member that meets most others in all its buckets: that is the
   text of which the others are copies, if there is one. A pair that several buckets name is compared once.
2. Buckets whose other members the links found so far leave in more than one component have all pairs of these
   compared. Such buckets that have components in common are put together, so that a text is sent out once for many
   buckets; where that makes more than WIDE blocks, each bucket is compared by itself, and buckets of equal members are
   one. What is found is one edge for each component tied to another.

Comparisons are on the words of the whole texts, by posting lists that add up every intersection. A group of more than
`block` shingles is cut: the first step compares the hub with each block, the second cuts by set size and hash,
and each pair of blocks whose sizes can reach the threshold is a group of its own. So no task gathers a hot bucket, no
candidate pair is left out unless links tie it already, and nothing grows with the square of a component. Blocks yield
one edge per linked text, not their pairs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandweave.llm import bytekit as bk
from strandweave.operators.components import connected_components, join_counted, local_roots, smallest_names
from strandweave.runtime import by_ids, cut

#: Blocks in a group that is put together from several buckets, at most.
WIDE = 16

_SEEDS = np.random.default_rng(20240229).integers(1, 1 << 63, 4096, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def signatures(col: pa.Array, k: int, half: int, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Set size, two sums that identify the set (rows x 2), and half keys (rows x 2 * half) of each text."""
    n_hash = 2 * half * width
    sizes, ids, keys = [], [], []
    for _, n, h, row in bk.word_hashes(col, bk.NOT_SPACE):
        s, offs = bk.shingles(h, row, n, k)
        size = np.diff(offs)
        full = size > 0
        at = offs[:-1][full]
        digest, sketch = np.zeros((n, 2), np.uint64), np.zeros((n, n_hash), np.uint64)
        if len(s):
            digest[full, 0] = np.add.reduceat(s * _SEEDS[4000], at)
            digest[full, 1] = np.add.reduceat(bk.mix(s ^ _SEEDS[4001]), at)
            for j in range(n_hash):
                sketch[full, j] = np.minimum.reduceat((s ^ _SEEDS[2 * j]) * _SEEDS[2 * j + 1], at)
        key = np.zeros((n, 2 * half), np.uint64)
        for j in range(width):
            key = bk.mix((key + np.uint64(j + 1)) * _SEEDS[4002] ^ sketch[:, j::width])
        sizes.append(size)
        ids.append(digest)
        keys.append(key)
    if not sizes:
        return np.zeros(0, np.int64), np.zeros((0, 2), np.uint64), np.zeros((0, 2 * half), np.uint64)
    return np.concatenate(sizes), np.concatenate(ids), np.concatenate(keys)


def shingle_set(text: str | None, k: int) -> set:
    """Distinct k-word shingles; with fewer words the whole sequence as one; none without words."""
    words = (text or "").encode("utf-8", "replace").lower().split()
    if not words:
        return set()
    if len(words) < k:
        return {tuple(words)}
    return set(zip(*(words[i:] for i in range(k)), strict=False))


def linked_within(ids: np.ndarray, sets: list[set], side: np.ndarray, num: int, den: int, known: np.ndarray | None = None) -> list[tuple[int, int]]:
    """(id, smallest id that its links reach here) of texts whose sets reach num / den of intersection over union.

    side: 0 for all pairs of the group; else 1 and 2, and only pairs across the sides count. known: components that the
    texts are known to be in, by which the result is named instead; pairs within one add nothing. Intersections are
    exact: shingles are numbered by equality, and each text adds up the posting lists of its own.
    """
    if len(ids) < 2:
        return []
    order = np.argsort(ids, kind="stable")
    ids, side = ids[order], side[order]
    known = ids if known is None else known[order]
    names, label = np.unique(known, return_inverse=True)
    if len(names) < 2:
        return []
    number: dict = {}
    coded = [np.fromiter((number.setdefault(x, len(number)) for x in sets[k]), np.int64, len(sets[k])) for k in order.tolist()]
    size = np.array([len(c) for c in coded])
    every = np.concatenate(coded)
    owner = np.repeat(np.arange(len(coded)), size)
    by = np.argsort(every, kind="stable")
    posting = owner[by]
    first = np.searchsorted(every[by], np.arange(len(number) + 1))
    found_i, found_j = [], []
    # across sides each pair is met once, from the side with fewer texts
    turns = range(len(coded)) if not side.any() else np.flatnonzero(side == (1 if (side == 1).sum() <= (side == 2).sum() else 2)).tolist()
    for i in turns:
        mine = coded[i]
        n = first[mine + 1] - first[mine]
        many = n > 1
        if not many.any():
            continue
        n, start = n[many], first[mine[many]]
        at = np.repeat(start - np.concatenate([[0], n.cumsum()[:-1]]), n) + np.arange(n.sum())
        both = np.bincount(posting[at], minlength=len(coded))
        both[label == label[i]] = 0
        if side[i]:
            both[side == side[i]] = 0
        else:
            both[: i + 1] = 0
        j = np.flatnonzero(den * both >= num * (size[i] + size - both))
        j = j[both[j] > 0]
        found_i.append(np.full(len(j), label[i]))
        found_j.append(label[j])
    if not found_i:
        return []
    root = local_roots(len(names), np.concatenate(found_i), np.concatenate(found_j))
    own = np.flatnonzero(root != np.arange(len(names)))
    return list(zip(names[own].tolist(), names[root[own]].tolist(), strict=True))


def _placed_by_size(members: DataFrame, percent: int, block: int) -> DataFrame:
    """(c, _g, _side, known) of groups whose pairs together are all pairs of members (key, c, n, s, known) of a key that sizes allow.

    s: shingles of the key. Keys of at most `block` are one group; others are cut by set size, in steps within which
    sizes can reach the threshold, and each step by hash.
    """
    small = members.where(F.col("s") <= block).select("c", F.xxhash64("key").alias("_g"), F.lit(0).alias("_side"), "known")
    large = members.where(F.col("s") > block).withColumn("band", F.floor(F.log("n") / F.log(F.lit(100 / percent))).cast("int"))
    large = cut(large.select("key", "c", "n", "known", "band"), "large")
    total = large.count()
    if not total:
        return small
    bands = cut(large.groupBy("key", "band").agg(F.ceil(F.sum("n") / block).cast("int").alias("nb"), F.count("*").alias("_n")), "bands")
    around = bands.select("key", F.explode(F.array(F.col("band") - 1, F.col("band"), F.col("band") + 1)).alias("band"), F.struct("band", "nb").alias("other"))
    around = around.groupBy("key", "band").agg(F.collect_list("other").alias("near"))  # at most three bands
    around = cut(around.join(bands, ["key", "band"]), "around")
    own = F.struct(F.col("band").alias("b"), F.pmod(F.xxhash64("c"), F.col("nb")).cast("int").alias("k"))
    others = F.flatten(F.transform("near", lambda o: F.transform(F.sequence(F.lit(0), o["nb"] - 1), lambda k: F.struct(o["band"].alias("b"), k.cast("int").alias("k")))))
    pairs = F.transform(others, lambda o: F.struct(F.least(o, own).alias("lo"), F.greatest(o, own).alias("hi"), F.when(o == own, 0).when(own < o, 1).otherwise(2).alias("side")))
    placed = join_counted(large, around, ["key", "band"], "_n", total).select("key", "c", "known", F.explode(pairs).alias("_p"))
    return small.unionByName(placed.select("c", F.xxhash64("key", "_p.lo.b", "_p.lo.k", "_p.hi.b", "_p.hi.k").alias("_g"), F.col("_p.side").alias("_side"), "known"))


def _placed_by_first(ties: DataFrame, block: int) -> DataFrame:
    """(c, _g, _side, known) of groups of one pivot (side 1) and a block of those tied to it (side 2); ties: pivot, c, pn, n."""
    pivots = cut(ties.groupBy("pivot").agg(F.ceil(F.sum("n") / block).cast("int").alias("nb"), F.count("*").alias("_n")), "pivots")
    tied = join_counted(ties, pivots, ["pivot"], "_n", ties.count())
    tied = tied.select("c", F.xxhash64("pivot", F.pmod(F.xxhash64("c"), F.col("nb"))).alias("_g"), F.lit(2).alias("_side"), F.col("c").alias("known"))
    first = pivots.select(F.col("pivot").alias("c"), F.explode(F.sequence(F.lit(0).cast("long"), (F.col("nb") - 1).cast("long"))).alias("_b"), F.col("pivot"))
    return tied.unionByName(first.select("c", F.xxhash64("pivot", "_b").alias("_g"), F.lit(1).alias("_side"), F.col("c").alias("known")))


def _links(placed: DataFrame, texts: DataFrame, k: int, percent: int) -> DataFrame:
    """Edges (a, b) of known components with classes that reach the threshold, found in each group of placed
    (c, _g, _side, known)."""
    work = placed.join(texts, "c").repartition("_g").sortWithinPartitions("_g")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, ids, sets, side, known = None, [], [], [], []
        done: list[tuple[int, int]] = []

        def close() -> None:
            done.extend(linked_within(np.array(ids, np.int64), sets, np.array(side), percent, 100, np.array(known, np.int64)))

        for b in batches:
            columns = (b.column(name).to_pylist() for name in ("_g", "c", "_side", "known"))
            for g, i, s, r, text in zip(*columns, b.column("text"), strict=True):
                if g != now:
                    close()
                    now, ids, sets, side, known = g, [], [], [], []
                ids.append(i)
                sets.append(shingle_set(text.as_py(), k))
                side.append(s)
                known.append(r)
        close()
        if done:
            yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in done], pa.int64()), pa.array([x[1] for x in done], pa.int64())], ["a", "b"])

    return cut(work.mapInArrow(compare, "a long, b long"), "links")


def _class_links(classes: DataFrame, rows: DataFrame, k: int, percent: int, half: int, block: int) -> DataFrame:
    """(id, component) of the classes that links tie to others; rows: id, _th, text."""
    table_keys = F.explode(
        F.flatten(
            F.transform(
                F.sequence(F.lit(1), F.lit(half)),
                lambda i: F.transform(F.sequence(F.lit(1), F.lit(half)), lambda j: F.xxhash64(i, j, F.element_at("keys", i), F.element_at("keys", j + half))),
            )
        )
    )
    entries = classes.select("c", "n", table_keys.alias("key"))
    total = classes.count() * half * half
    shared = cut(entries.groupBy("key").agg(F.count("*").alias("size")).where("size > 1"), "shared")
    met = cut(join_counted(entries, shared, ["key"], "size", total).select("key", "c", "n", "size"), "met")
    met = cut(met.join(met.groupBy("c").agg(F.sum("size").alias("meets")), "c"), "met")  # at most a row per table and class
    rank = F.struct("meets", F.xxhash64("c"), "c")
    hubs = met.groupBy("key").agg(F.max_by("c", rank).alias("pivot"), F.max_by("n", rank).alias("pn"), F.count("*").alias("_n"))
    hubs = cut(hubs, "hubs")
    members = cut(join_counted(met.drop("meets"), hubs, ["key"], "_n", total).where("c <> pivot").select("key", "c", "n", "pivot", "pn", "size"), "members")
    reach = 100 * F.least("n", "pn") >= percent * F.greatest("n", "pn")
    ties = cut(members.where(reach).select("pivot", "c", "pn", "n").distinct(), "ties")
    wanted = met.select("c").distinct()
    wanted = cut(classes.join(wanted, "c").select("c", "id", "_th"), "wanted")
    texts = by_ids(rows, wanted, ["id", "_th"], "inner").groupBy("c").agg(F.first("text").alias("text"))  # rows may repeat
    texts = cut(texts, "texts")
    found = cut(connected_components(_links(_placed_by_first(ties, max(1, block // 4)), texts, k, percent)), "tied")
    # what is left: buckets with members, besides the first one, in more than one component
    rest = members.where("size > 2").join(found.select(F.col("id").alias("c"), "component"), "c", "left").withColumn("_root", F.coalesce("component", "c"))
    rest = cut(rest.select("key", "c", "n", "_root"), "rest")
    mixed = rest.groupBy("key").agg(
        F.min("_root").alias("_lo"), F.max("_root").alias("_hi"), F.count("*").alias("_n"), F.sum("n").alias("s"),
        F.bit_xor(F.xxhash64(F.lit(1), "c")).alias("_x"), F.bit_xor(F.xxhash64(F.lit(2), "c")).alias("_y"),
    ).where("_lo <> _hi").groupBy("_x", "_y", "_n", "s", "_lo").agg(F.min("key").alias("key"))
    mixed = cut(mixed.select("key", "s", "_n", "_lo"), "mixed")
    left = mixed.agg(F.sum("_n")).first()[0]
    if left:
        again = cut(join_counted(rest, mixed, ["key"], "_n", left).select("key", "c", "n", "s", "_root", "_lo"), "again")
        more = _links(_placed_together(again, left, percent, block), texts, k, percent)
        found = cut(connected_components(found.select(F.col("id").alias("a"), F.col("component").alias("b")).unionByName(more)), "tied")
    return found


def _placed_together(members: DataFrame, total: int, percent: int, block: int) -> DataFrame:
    """_placed_by_size of buckets (key, c, n, s, _root, _lo: their least root), put together by the roots they share."""
    single = cut(members.select("c", "n", "_root").distinct(), "single")
    of = connected_components(members.select("_lo", "_root").distinct(), "_lo", "_root").select(F.col("id").alias("_root"), F.col("component").alias("g"))
    roots = cut(single.groupBy("_root").agg(F.sum("n").alias("_s"), F.count("*").alias("_n")).join(of, "_root"), "roots")
    groups = cut(roots.groupBy("g").agg(F.sum("_s").alias("s"), F.count("*").alias("_m")), "groups")
    n_roots = roots.count()
    roots = cut(join_counted(roots.drop("_s"), groups, ["g"], "_m", n_roots).select("_root", "_n", "g", "s"), "roots")
    fits = F.col("s") <= WIDE * block
    near = join_counted(single, roots, ["_root"], "_n", total).where(fits).select(F.col("g").alias("key"), "c", "n", "s", F.col("_root").alias("known"))
    wide = roots.where(~fits)
    apart = by_ids(members, wide.select("_root"), "_root", "left_semi").select("key", "c", "n", "s", F.col("_root").alias("known"))
    return _placed_by_size(near, percent, block).unionByName(_placed_by_size(apart, percent, block))


def _classified(docs: DataFrame, id_col: str, text_col: str, k: int, percent: int, half: int, width: int, block: int) -> DataFrame:
    """id, _th (hash of the text), n, root (class that names the component), component_id, kept of every row; written."""
    if not 1 <= percent <= 100:
        raise ValueError("percent must be 1 to 100")
    n_keys = 2 * half

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            size, digest, keys = signatures(b.column("text"), k, half, width)
            yield pa.RecordBatch.from_arrays(
                [
                    b.column("id"), b.column("_th"), pa.array(size.astype(np.int64)), pa.array(digest[:, 0].view(np.int64)), pa.array(digest[:, 1].view(np.int64)),
                    pa.FixedSizeListArray.from_arrays(pa.array(keys.view(np.int64).ravel()), n_keys).cast(pa.list_(pa.int64())),
                ],
                ["id", "_th", "n", "d1", "d2", "keys"],
            )

    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text")).withColumn("_th", F.xxhash64("text"))
    signed = cut(rows.mapInArrow(sign, "id long, _th long, n long, d1 long, d2 long, keys array<long>"), "signatures")
    full = signed.where("n > 0 and id is not null")
    # equal sets are one class, and their keys are equal as well; a class is named by a number of its own
    classes = full.groupBy("n", "d1", "d2").agg(F.min(F.struct("id", "_th")).alias("_at"), F.first("keys").alias("keys"), F.count("*").alias("_m"))
    classes = cut(classes.select(F.monotonically_increasing_id().alias("c"), "n", "d1", "d2", "_at.id", "_at._th", "keys", "_m"), "classes")
    named = classes.select("n", "d1", "d2", "_m", "c", F.col("id").alias("rep"))
    if percent < 100:  # else equal sets only
        of = smallest_names(_class_links(classes, rows, k, percent, half, block), classes.select(F.col("c").alias("id"), F.col("id").alias("name")))
        named = named.join(of.withColumnRenamed("id", "c"), "c", "left")
        named = named.select("n", "d1", "d2", "_m", F.coalesce("component", "c").alias("root"), F.coalesce("component_id", "rep").alias("component_id"))
    else:
        named = named.select("n", "d1", "d2", "_m", F.col("c").alias("root"), F.col("rep").alias("component_id"))
    named = cut(named, "named")
    linked = join_counted(full.select("id", "_th", "n", "d1", "d2"), named, ["n", "d1", "d2"], "_m", signed.count())
    linked = linked.select("id", "_th", "n", "root", "component_id")
    alone = signed.where("n = 0 or id is null").select("id", "_th", "n", F.lit(None).cast("long").alias("root"), F.col("id").alias("component_id"))
    out = linked.unionByName(alone)
    return out.withColumn("kept", F.coalesce(F.col("id") == F.col("component_id"), F.lit(True)))


def duplicate_classes(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    k: int = 5,
    percent: int = 80,
    half: int = 8,
    width: int = 2,
    block: int = 120_000,
) -> DataFrame:
    """id, n_shingles, component_id, kept of every row of docs.

    Words are runs of non-white-space, A-Z lower-cased; two rows are linked when 100 * intersection >= percent *
    union of their sets of distinct k-word shingles; percent is 1 to 100, at 100 equal sets are linked. component_id is
    the smallest id that links reach. Text that is null or without words is linked with nothing. Rows that repeat an id
    are rows of their own, each with the result of its own text. A row of null id is linked with nothing: its
    component_id is null, kept true. An empty table gives an empty result; other columns are not looked at.
    """
    out = _classified(docs, id_col, text_col, k, percent, half, width, block)
    return out.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), "component_id", "kept")


def _free(df: DataFrame, name: str) -> str:
    while name in df.columns:
        name += "_"
    return name


def keep_one_of_each(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = 5, percent: int = 80, half: int = 8, width: int = 2, block: int = 120_000
) -> DataFrame:
    """The rows of docs, with all their columns, that are the smallest id of their component.

    Rows of null id stay. Rows that repeat an id are judged by their own texts; where several of one component have its
    smallest id, one stays, the largest by text and then by the other columns. Of rows without words that repeat an id
    and a text one stays as well.
    """
    found = cut(_classified(docs, id_col, text_col, k, percent, half, width, block), "found")
    hashed = _free(docs, "_th")
    found = found.select(F.col("id").cast(docs.schema[id_col].dataType).alias(id_col), F.col("_th").alias(hashed), "root", "kept")
    out = docs.withColumn(hashed, F.xxhash64(F.col(text_col).cast("string")))
    gone = cut(found.where("not kept").select(id_col, hashed).distinct(), "gone")
    out = by_ids(out, gone, [id_col, hashed], "left_anti")
    group = F.xxhash64(F.col("root").isNull(), F.coalesce("root", hashed)).alias(_free(docs, "_group"))
    stay = found.where(F.col("kept") & F.col(id_col).isNotNull()).select(id_col, hashed, group)
    again = cut(stay.groupBy(id_col, stay.columns[-1]).count().where("count > 1").select(id_col).distinct(), "again")
    if again.limit(1).count():
        rest = [c for c in docs.columns if c not in (id_col, text_col)]
        several = by_ids(out, again, id_col, "left_semi").join(by_ids(stay, again, id_col, "left_semi").distinct(), [id_col, hashed])
        several = several.groupBy(id_col, stay.columns[-1]).agg(F.max(F.struct(text_col, *rest)).alias("_one")).select(id_col, "_one.*")
        out = by_ids(out, again, id_col, "left_anti").select(docs.columns).unionByName(several.select(docs.columns))
    return out.select(docs.columns)
