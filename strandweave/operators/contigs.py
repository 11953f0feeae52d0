"""Contig-level filters, labels and types over node rows (one row per aligned chunk of a contig)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strandweave.operators import aggregates as A
from strandweave.operators import ordered as O
from strandweave.operators.range_join import range_join


def clean_failed_layout(windows: DataFrame, excluded: DataFrame, on: list[str], value: str, factor: float = 3.0, width: int = 1_000_000) -> DataFrame:
    """windows with is_failed: value above factor x median, or contained in an excluded interval; order (is_failed, row_id)."""
    mid = windows.agg((F.median(value) * factor).alias("_limit"))
    d = range_join(windows, excluded, on, "contained", width, how="left_flag").crossJoin(F.broadcast(mid))  # mid: one row
    return d.withColumn("is_failed", (F.col(value) > F.col("_limit")) | F.col("matched")).drop("_limit", "matched")


def multi_end_contigs(nodes: DataFrame, window: int = 500_000) -> DataFrame:
    """Contigs all of whose rows lie within `window` of a chromosome end, over at least two ends."""
    front = F.when(F.col("chr_end") <= F.least(F.lit(window), F.col("chr_len")), F.concat("chr_nam", F.lit("f")))
    back = F.when(F.col("chr_str") >= F.greatest(F.lit(0), F.col("chr_len") - window), F.concat("chr_nam", F.lit("b")))
    d = nodes.select("ctg_nam", F.array_compact(F.array(front, back)).alias("ends"))
    got = d.groupBy("ctg_nam").agg(F.bool_and(F.size("ends") > 0).alias("all_ends"), F.size(F.array_distinct(F.flatten(F.collect_set("ends")))).alias("n_ends"))
    return got.where("all_ends and n_ends >= 2").select("ctg_nam")


def untrusted_contigs(paf: DataFrame, least_mapq: int = 60) -> DataFrame:
    """Contigs with a row that isn't primary, or of low mapping quality."""
    bad = ~F.array_contains("tags", "tp:A:P") | (F.col("mapq") < least_mapq)
    return paf.groupBy("qname").agg(F.bool_or(F.coalesce(bad, F.lit(True))).alias("bad")).where("bad").select("qname")


def repeat_only_contigs(nodes: DataFrame, label: str, order: str = "node_id", baseline: float = 0.0, terminals_in_repeat: Column | None = None) -> DataFrame:
    """Contigs whose share of reference length without a label is 0 or under baseline (and whose terminals qualify)."""
    span = F.col("chr_end") - F.col("chr_str")
    d = nodes.groupBy("ctg_nam").agg(F.sum(span).alias("total"), F.sum(F.when(F.col(label).isNull() | (F.col(label) == "0"), span).otherwise(0)).alias("plain"),
                                     F.bool_and(F.lit(True) if terminals_in_repeat is None else terminals_in_repeat).alias("ok"))
    return d.where(F.col("ok") & ((F.col("plain") == 0) | (F.col("plain") < baseline * F.col("total")))).select("ctg_nam")


def breakend_contigs(nodes: DataFrame) -> DataFrame:
    return nodes.where("ctg_typ in (1, 2)").select("ctg_nam").distinct()


def without_contigs(nodes: DataFrame, gone: DataFrame) -> DataFrame:
    return nodes.join(gone.select("ctg_nam").distinct(), "ctg_nam", "left_anti")


def contig_types(nodes: DataFrame, order: str = "node_id", bound: float = 0.1, repeat_bound: float = 0.2, least_length: int = 100_000) -> DataFrame:
    """Type of each contig: 1 chromosomes of the terminal rows differ, 2 only strands differ, 3 collinear, 4 a jump, 0 dropped.

    nodes: ctg_nam, ctg_len, ctg_dir, chr_nam, chr_str, chr_end, `order`, is_telo, in_repeat. The ratio's bound is
    wider where a terminal row is in a repeat. Collinear contigs need length, a telomere or a single row. Any chrM row
    drops the contig.
    """
    r = A.contig_ratio(nodes, "ctg_nam", order)
    x = nodes.groupBy("ctg_nam").agg(
        F.max("ctg_len").alias("ctg_len"), F.bool_or("is_telo").alias("telo"), F.bool_or(F.col("chr_nam") == "chrM").alias("m"),
        (F.min_by("in_repeat", order) | F.max_by("in_repeat", order)).alias("rpt"),
    )
    d = r.join(x, "ctg_nam")
    near = F.abs(F.col("ratio") - 1) < F.when(F.col("rpt"), repeat_bound).otherwise(bound)
    keeps = (F.col("ctg_len") > least_length) | F.col("telo") | (F.col("n_rows") == 1)
    kind = (
        F.when(F.col("m"), 0)
        .when(F.col("first_chr") != F.col("last_chr"), 1)
        .when(F.col("first_dir") != F.col("last_dir"), 2)
        .when(near, F.when(keeps, 3).otherwise(0))
        .otherwise(4)
    )
    return d.withColumn("ctg_typ", kind)


def split_at_jumps(nodes: DataFrame, order: str = "node_id", bound: float = 0.1, repeat_bound: float = 0.2, least: int = 1_000_000) -> DataFrame:
    """Two-row contigs around the internal jumps of collinear contigs: neighbours of one state whose ratio is off by
    more than the bound over a reference length beyond `least`. New names end in _split and the number of the jump.
    """
    w = Window.partitionBy("ctg_nam").orderBy(order)
    cols = ["chr_nam", "ctg_dir", "chr_str", "chr_end", "in_repeat", order]
    d = nodes.where("ctg_typ = 3")
    for c in cols:
        d = d.withColumn(f"n_{c}", F.lead(c).over(w))
    total = (F.col("chr_end") - F.col("chr_str")) + (F.col("n_chr_end") - F.col("n_chr_str"))
    est = F.when(F.col("ctg_dir") == "+", F.col("n_chr_end") - F.col("chr_str")).otherwise(F.col("chr_end") - F.col("n_chr_str"))
    limit = F.when(F.col("in_repeat") | F.col("n_in_repeat"), repeat_bound).otherwise(bound)
    cut = d.where((F.col("chr_nam") == F.col("n_chr_nam")) & (F.col("ctg_dir") == F.col("n_ctg_dir")) & (F.abs(1 - est / total) > limit) & (F.abs(total) > least))
    cut = cut.withColumn("k", F.row_number().over(w)).select("ctg_nam", "k", F.explode(F.array(F.col(order), F.col(f"n_{order}"))).alias(order))
    return nodes.join(cut, ["ctg_nam", order]).withColumn("ctg_nam", F.concat("ctg_nam", F.lit("_split"), F.col("k").cast("string"))).drop("k")


def split_at_telomeres(nodes: DataFrame, order: str = "node_id", telomere: str = "ctg_teldir", connected: str = "telo_connected") -> DataFrame:
    """Contigs with two or more telomeric rows inside, and unconnected ends, as their parts up to the first and from the last such row."""
    has = F.col(telomere).isNotNull() & (F.col(telomere) != "0")
    w = Window.partitionBy("ctg_nam")
    o = w.orderBy(order)
    d = nodes.withColumn("_k", F.row_number().over(o)).withColumn("_n", F.count("*").over(w))
    inside = has & (F.col("_k") > 1) & (F.col("_k") < F.col("_n"))
    end = ((F.col("_k") == 1) | (F.col("_k") == F.col("_n"))) & F.coalesce(F.col(connected), F.lit(False))
    d = d.withColumn("_inside", F.sum(inside.cast("int")).over(w)).withColumn("_tied", F.max(end).over(w)).where("_inside >= 2 and not _tied")
    d = d.withColumn("_first", F.min(F.when(has, F.col("_k"))).over(w)).withColumn("_last", F.max(F.when(has, F.col("_k"))).over(w))
    part = F.when(F.col("_k") <= F.col("_first"), F.array(F.lit(1))).otherwise(F.array().cast("array<int>"))
    part = F.concat(part, F.when(F.col("_k") >= F.col("_last"), F.array(F.lit(2))).otherwise(F.array().cast("array<int>")))
    d = d.withColumn("_part", F.explode(part)).withColumn("ctg_nam", F.concat("ctg_nam", F.lit("_telomere"), F.col("_part").cast("string")))
    return d.select(nodes.columns)


def trim_repeats(nodes: DataFrame, order: str = "node_id", least_mapq: int = 60) -> DataFrame:
    """Rows left after terminal low-quality repeat rows inside the telomere-connected ends are taken off.

    Collinear contigs stay whole. Of the repeat rows of an end the innermost stays when the row after it is no repeat.
    """
    w = Window.partitionBy("ctg_nam")
    o = w.orderBy(order)
    tel = F.col("ctg_telcon").isNotNull() & (F.col("ctg_telcon") != "0")
    rep = F.col("ctg_rptchr").isNotNull() & (F.col("ctg_rptchr") != "0")
    weak = rep & (F.col("ctg_mapq") < least_mapq)
    d = nodes.withColumn("_k", F.row_number().over(o)).withColumn("_n", F.count("*").over(w)).withColumn("_tel", tel).withColumn("_rep", rep).withColumn("_weak", weak)
    d = d.withColumn("_f0", F.coalesce(F.min(F.when(~F.col("_tel"), F.col("_k"))).over(w), F.col("_n") + 1)).withColumn("_b0", F.coalesce(F.max(F.when(~F.col("_tel"), F.col("_k"))).over(w), F.lit(0)))
    d = d.withColumn("_f1", F.coalesce(F.min(F.when((F.col("_k") >= F.col("_f0")) & ~F.col("_weak"), F.col("_k"))).over(w), F.col("_n") + 1))
    d = d.withColumn("_b1", F.coalesce(F.max(F.when((F.col("_k") <= F.col("_b0")) & ~F.col("_weak"), F.col("_k"))).over(w), F.lit(0)))
    plain_f = F.max(F.when(F.col("_k") == F.col("_f1"), ~F.col("_rep"))).over(w)
    plain_b = F.max(F.when(F.col("_k") == F.col("_b1"), ~F.col("_rep"))).over(w)
    d = d.withColumn("_f", F.when((F.col("_f1") <= F.col("_n")) & (F.col("_f1") > F.col("_f0")) & plain_f, F.col("_f1") - 1).otherwise(F.col("_f1")))
    d = d.withColumn("_b", F.when((F.col("_b1") >= 1) & (F.col("_b1") < F.col("_b0")) & plain_b, F.col("_b1") + 1).otherwise(F.col("_b1")))
    stay = (F.col("ctg_typ") == 3) | (F.col("_k") < F.col("_f0")) | (F.col("_k") > F.col("_b0")) | ((F.col("_k") >= F.col("_f")) & (F.col("_k") <= F.col("_b")))
    return d.where(stay).select(nodes.columns)


def trim_telomeres(nodes: DataFrame, order: str = "node_id", label: str = "telo_label") -> DataFrame:
    """Rows left after contained telomere rows are taken off both ends, with telo_connect on rows that meet a telomere.

    label: null, f or b where the row overlaps a telomere, fin or bin where it lies in one. Both ends are treated as
    mirror images: contained rows at an end are cut, and the next row is connected to the end that its strand faces;
    a partly covered row that faces the telomere is connected itself; one that faces away keeps its end as it is.
    A contig whose every row is labelled is dropped unless a terminal row faces away.
    """
    w = Window.partitionBy("ctg_nam")
    o = w.orderBy(order)
    d = nodes.withColumn("_k", F.row_number().over(o)).withColumn("_n", F.count("*").over(w))
    has = F.col(label).isNotNull()
    d = d.withColumn("_f", F.coalesce(F.min(F.when(~has, F.col("_k"))).over(w), F.col("_n") + 1)).withColumn("_b", F.coalesce(F.max(F.when(~has, F.col("_k"))).over(w), F.lit(0)))
    at = lambda k, c: F.max(F.when(F.col("_k") == k, F.col(c))).over(w)
    d = d.withColumn("_l1", at(F.lit(1), label)).withColumn("_d1", at(F.lit(1), "ctg_dir")).withColumn("_ln", at(F.col("_n"), label)).withColumn("_dn", at(F.col("_n"), "ctg_dir"))
    away_front = F.coalesce(F.concat("_l1", "_d1").isin("b+", "f-"), F.lit(False))
    away_back = F.coalesce(F.concat("_ln", "_dn").isin("b-", "f+"), F.lit(False))
    d = d.withColumn("_af", away_front).withColumn("_ab", away_back).where((F.col("_f") <= F.col("_n")) | F.col("_af") | F.col("_ab"))
    inside_front, inside_back = F.coalesce(F.length("_l1") > 1, F.lit(False)), F.coalesce(F.length("_ln") > 1, F.lit(False))
    facing_front = ((F.col("_l1") == "f") & (F.col("ctg_dir") == "+")) | ((F.col("_l1") == "b") & (F.col("ctg_dir") == "-"))
    facing_back = ((F.col("_ln") == "f") & (F.col("ctg_dir") == "-")) | ((F.col("_ln") == "b") & (F.col("ctg_dir") == "+"))
    edge_f = F.max(F.when(F.col("_k") == F.col("_f") - 1, facing_front)).over(w)
    edge_b = F.max(F.when(F.col("_k") == F.col("_b") + 1, facing_back)).over(w)
    d = d.withColumn("_ef", F.coalesce(edge_f, F.lit(False))).withColumn("_eb", F.coalesce(edge_b, F.lit(False)))
    st = F.when((F.col("_f") == 1) | F.col("_af"), F.lit(1)).when(inside_front | ~F.col("_ef"), F.col("_f")).otherwise(F.col("_f") - 1)
    ed = F.when((F.col("_b") == F.col("_n")) | F.col("_ab"), F.col("_n")).when(inside_back | ~F.col("_eb"), F.col("_b")).otherwise(F.col("_b") + 1)
    d = d.withColumn("_st", st).withColumn("_ed", ed)
    joined_front = (F.col("_f") > 1) & ~F.col("_af") & (F.col("_k") == F.col("_st"))
    joined_back = (F.col("_b") < F.col("_n")) & ~F.col("_ab") & (F.col("_k") == F.col("_ed"))
    end_front = F.when(F.col("ctg_dir") == "+", "f").otherwise("b")
    end_back = F.when(F.col("ctg_dir") == "+", "b").otherwise("f")
    d = d.withColumn("telo_connect", F.when(joined_front, F.concat("chr_nam", end_front)).when(joined_back, F.concat("chr_nam", end_back)))
    return d.where("_k >= _st and _k <= _ed").select(*nodes.columns, "telo_connect")


def simple_transitions(nodes: DataFrame, order: str = "node_id", least: int = 10_000, share: float = 0.9) -> DataFrame:
    """Neighbouring long rows of a contig, both on major chromosomes, whose chromosome changes; same_dir tells strands."""
    span = F.abs(F.col("chr_end") - F.col("chr_str"))
    long = nodes.where(span > least).withColumn("_span", span.cast("double"))
    major = A.major_share(long, ["ctg_nam"], "chr_nam", "_span", share).select("ctg_nam", "chr_nam")
    d = O.neighbour_changes(long.join(major, ["ctg_nam", "chr_nam"]), ["ctg_nam"], [order], ["chr_nam", "ctg_dir", order])
    return d.where(F.col("prev_chr_nam").isNotNull() & (F.col("prev_chr_nam") != F.col("chr_nam"))).select(
        "ctg_nam", F.col(f"prev_{order}").alias("left_id"), F.col(order).alias("right_id"), (F.col("prev_ctg_dir") == F.col("ctg_dir")).alias("same_dir")
    )


def inward_bounds(nodes: DataFrame, order: str = "node_id", least: int = 10_000, share: float = 0.9) -> DataFrame:
    """For contigs that end on two chromosomes: innermost rows that still carry the state of each terminal row.

    Short rows and rows on minor chromosomes are looked through. No result where the bounds meet or cross.
    """
    span = F.abs(F.col("chr_end") - F.col("chr_str"))
    w = Window.partitionBy("ctg_nam")
    d = nodes.withColumn("_span", F.when(span > least, span.cast("double")))
    major = A.major_share(d.where("_span is not null"), ["ctg_nam"], "chr_nam", "_span", share).select("ctg_nam", "chr_nam", F.lit(True).alias("_major"))
    d = d.join(major, ["ctg_nam", "chr_nam"], "left").withColumn("_s", F.concat("chr_nam", F.col("ctg_dir")))
    ends = d.groupBy("ctg_nam").agg(F.min_by(F.struct(F.col("_s").alias("s"), F.col("chr_nam").alias("c"), F.col(order).alias("o")), order).alias("L"),
                                    F.max_by(F.struct(F.col("_s").alias("s"), F.col("chr_nam").alias("c"), F.col(order).alias("o")), order).alias("R"))
    d = d.join(ends.where("L.c <> R.c"), "ctg_nam").where("(_span is not null and _major) or " + order + " = L.o or " + order + " = R.o")
    front = w.orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    back = w.orderBy(order).rowsBetween(0, Window.unboundedFollowing)
    d = d.withColumn("_lok", F.min(F.col("_s") == F.col("L.s")).over(front)).withColumn("_rok", F.min(F.col("_s") == F.col("R.s")).over(back))
    got = d.groupBy("ctg_nam").agg(F.max(F.when(F.col("_lok"), F.col(order))).alias("left_id"), F.min(F.when(F.col("_rok"), F.col(order))).alias("right_id"))
    return got.where("left_id < right_id")


def junctions(nodes: DataFrame, order: str = "node_id", tolerance: float = 0.1) -> DataFrame:
    """(ctg_nam, a_id, b_id) of breakend contigs: the anchors moved inwards from both ends.

    The left anchor moves while rows keep the first row's state and the reference ratio from the first row stays
    within the tolerance of 1; the right one mirrors it. Anchors never cross; a contig without room keeps its ends.
    """
    w = Window.partitionBy("ctg_nam")
    d = nodes.where("ctg_typ in (1, 2)").withColumn("_s", F.concat("chr_nam", F.col("ctg_dir")))
    span = F.col("chr_end") - F.col("chr_str")
    front = w.orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    back = w.orderBy(order).rowsBetween(0, Window.unboundedFollowing)

    def ratio(frame, first: bool):
        head = F.first(F.struct("chr_str", "chr_end", "ctg_dir")).over(frame) if first else F.last(F.struct("chr_str", "chr_end", "ctg_dir")).over(frame)
        plus = head["ctg_dir"] == "+"
        if first:
            est = F.when(plus, F.col("chr_end") - head["chr_str"]).otherwise(head["chr_end"] - F.col("chr_str"))
        else:
            est = F.when(plus, head["chr_end"] - F.col("chr_str")).otherwise(F.col("chr_end") - head["chr_str"])
        return est / F.nullif(F.sum(span).over(frame), F.lit(0))

    d = d.withColumn("_first", F.first("_s").over(front)).withColumn("_last", F.last("_s").over(back))
    d = d.withColumn("_fr", ratio(front, True)).withColumn("_br", ratio(back, False))
    d = d.withColumn("_fok", F.min((F.col("_s") == F.col("_first")) & (F.abs(F.col("_fr") - 1) <= tolerance)).over(front))
    d = d.withColumn("_bok", F.min((F.col("_s") == F.col("_last")) & (F.abs(F.col("_br") - 1) <= tolerance)).over(back))
    got = d.groupBy("ctg_nam").agg(F.max(F.when(F.col("_fok"), F.col(order))).alias("a_id"), F.min(F.when(F.col("_bok"), F.col(order))).alias("b_id"), F.min(order).alias("_lo"), F.max(order).alias("_hi"))
    ok = F.col("a_id") < F.col("b_id")
    return got.select("ctg_nam", F.when(ok, F.col("a_id")).otherwise(F.col("_lo")).alias("a_id"), F.when(ok, F.col("b_id")).otherwise(F.col("_hi")).alias("b_id")).where("a_id < b_id")


def centromere_steps(depth: DataFrame, satellites: DataFrame, flanks: tuple[int, ...] = (1_000_000, 5_000_000, 10_000_000),
                     rules: tuple[tuple[int, float], ...] = ((1, 0.20), (2, 0.15), (3, 0.10)), apart: float = 0.30) -> DataFrame:
    """Depth steps over satellites: chr, mid, diff, dir (true: higher on the right).

    For each flank, right minus left mean depth, weighted by overlap. A rule (k, t) holds when the first k steps exist,
    have one sign and are at least t x median, and lie within `apart` x median of the first. depth: chr, st, nd,
    meandepth; satellites: chr, st, nd, one per chromosome.
    """
    sides = F.explode(F.array(*[F.struct(F.lit(k).alias("k"), F.lit(f).alias("flank")) for k, f in enumerate(flanks)]))
    s = satellites.select("chr", F.col("st").alias("c_st"), F.col("nd").alias("c_nd"), sides.alias("f"))
    pts = s.select("chr", "c_st", "c_nd", "f.k", "f.flank").select("*", F.explode(F.array(F.lit("left"), F.lit("right"))).alias("side"))
    pts = pts.withColumn("st", F.when(F.col("side") == "left", F.col("c_st") - F.col("flank")).otherwise(F.col("c_nd"))).withColumn("nd", F.when(F.col("side") == "left", F.col("c_st")).otherwise(F.col("c_nd") + F.col("flank")))
    pts = pts.withColumn("pid", F.concat_ws(":", "chr", "k", "side"))
    win = depth.select("chr", F.col("st").alias("r_st"), F.col("nd").alias("r_nd"), "meandepth")
    got = O.weighted_depth(pts, win, ["chr"], "pid", max(1, flanks[0] // 4), "meandepth")
    mid = depth.agg(F.median("meandepth").alias("m"))
    agg = got.groupBy("chr", "c_st", "c_nd").agg(*[(F.max(F.when((F.col("k") == k) & (F.col("side") == "right"), F.col("mean_depth"))) - F.max(F.when((F.col("k") == k) & (F.col("side") == "left"), F.col("mean_depth")))).alias(f"d{k}") for k in range(len(flanks))])
    agg = agg.crossJoin(F.broadcast(mid))  # one row
    ok = F.lit(False)
    for k, t in rules:
        r = F.lit(True)
        for i in range(k):
            x = F.coalesce(F.col(f"d{i}"), F.lit(0.0))
            r = r & (x != 0) & (F.signum(x) == F.signum("d0")) & (F.abs(x) >= t * F.col("m")) & (F.abs(x - F.col("d0")) <= apart * F.col("m"))
        ok = ok | r
    return agg.where(ok).select("chr", ((F.col("c_st") + F.col("c_nd")) / 2).cast("long").alias("mid"), F.abs("d0").alias("diff"), (F.col("d0") > 0).alias("dir"))


def near_end(nodes: DataFrame, within: int) -> Column:
    """Whether a row lies within this distance of either end of its chromosome."""
    return (F.col("chr_str") <= within) | (F.col("chr_end") >= F.col("chr_len") - within)


def prefer_simple(pairs: DataFrame, group: list[str], simple: str = "is_simple") -> DataFrame:
    """Of each group the simple members, where there are any; else all."""
    w = Window.partitionBy(*group)
    return pairs.withColumn("_any", F.max(F.col(simple)).over(w)).where(F.col(simple) | ~F.col("_any")).drop("_any")


def conflicting_tips(pairs: DataFrame, a: str = "a_orientations", b: str = "b_orientations") -> DataFrame:
    """Pairs whose ends share no orientation near chromosome ends (arrays of inward, outward)."""
    return pairs.where(~F.coalesce(F.arrays_overlap(a, b), F.lit(False)))


def fragment_direction_ok(chrom_dir: Column, strand: Column, end: Column) -> Column:
    """A telomere-connected satellite row points as the centromere fragment wants: - where the q arm is high."""
    norm = F.when(end == "f", strand).otherwise(F.translate(strand, "+-", "-+"))
    return norm == F.when(chrom_dir, "-").otherwise("+")


def telomere_choice(candidates: DataFrame, by: str, distance: str, length: str, collapse_within: int = 500_000, apart: int = 100_000) -> DataFrame:
    """Telomere attachments kept at each end: the nearest one; of those within `collapse_within` only the most distal,
    of equal ones the shorter contig; and further ones unless within `apart` of one that is kept already."""
    from strandweave.operators.leaders import greedy_leaders

    near = candidates.where(F.col(distance) <= collapse_within)
    best = near.groupBy(by).agg(F.min_by(F.struct(*candidates.columns), F.struct(distance, length)).alias("_b")).select("_b.*")
    far = candidates.where(F.col(distance) > collapse_within)
    kept = greedy_leaders(far.withColumn("_one", F.lit(0)), [by], [distance, length], [distance], apart, strict=True).where("is_leader").select(candidates.columns)
    return best.unionByName(kept)
