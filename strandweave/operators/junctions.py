"""Junction pairs as relations: pruning by satellites, clusters, conjoined pairs, synthetic nodes and depth support.

A junction row has event, and for its ends p = a, b: {p}_id, {p}_chr, {p}_st, {p}_nd, {p}_dir, and where a function
says so {p}_sat (stands on a satellite), {p}_mapq, {p}_telo_sat (on one that reaches a chromosome end). a is the end
that the path leaves, b the one that it enters.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strandweave.functions import intervals as I
from strandweave.functions import strands as S
from strandweave.operators import ordered as O
from strandweave.operators.leaders import greedy_leaders
from strandweave.operators.range_join import box_candidates, nearest, range_join
from strandweave.runtime import cut

SIDES = ("a", "b")


def with_ends(pairs: DataFrame, nodes: DataFrame) -> DataFrame:
    """pairs (event, a_id, b_id) with the columns of both end nodes."""
    out = pairs
    for p in SIDES:
        cols = [F.col("node_id").alias(f"{p}_id"), F.col("chr_nam").alias(f"{p}_chr"), F.col("chr_str").alias(f"{p}_st"), F.col("chr_end").alias(f"{p}_nd"), F.col("ctg_dir").alias(f"{p}_dir"), F.col("ctg_mapq").alias(f"{p}_mapq"),
                (F.col("ctg_censat").isNotNull() & (F.col("ctg_censat") != "0")).alias(f"{p}_sat")]
        out = out.join(nodes.select(cols), f"{p}_id")
    return out


def canonical(junctions: DataFrame) -> DataFrame:
    """Junctions as lo_ and hi_ columns: ends by chromosome rank and position, directions as read in that order."""
    key = lambda p: F.struct(F.coalesce(S.chromosome_rank(F.col(f"{p}_chr")), F.lit(1 << 20)).alias("r"), F.col(f"{p}_st").alias("s"), F.col(f"{p}_nd").alias("e"))
    pick = lambda c, lo: F.when(F.col("_swap") == F.lit(lo), F.col(f"b_{c}")).otherwise(F.col(f"a_{c}"))
    d = junctions.withColumn("_swap", key("b") < key("a"))
    for c in ("id", "chr", "st", "nd", "dir"):
        d = d.withColumn(f"lo_{c}", pick(c, True)).withColumn(f"hi_{c}", pick(c, False))
    fwd = F.col("lo_id") < F.col("hi_id")
    return d.withColumn("lo_dir", S.corrected(F.col("lo_dir"), fwd)).withColumn("hi_dir", S.corrected(F.col("hi_dir"), fwd)).drop("_swap")


def opposite_pairs(junctions: DataFrame, within: int = 100_000, together: int = 1_000) -> DataFrame:
    """(x, y): junctions of one chromosome pair whose directions (+ or -) differ at both ends, both ends at most `within` apart.

    Each pair is met once, from its junction with + at the lower end. Where equal spans are many, junctions of the same
    spans and directions meet as one row of up to `together` events, and its events are paired after that.
    """
    spans = ("lo_st", "lo_nd", "hi_st", "hi_nd")
    place = ["lo_chr", "hi_chr", *spans, "lo_dir", "hi_dir"]
    d = cut(canonical(junctions).select("event", *place), "junctions").dropna()
    n, different = d.select(F.count("*"), F.approx_count_distinct(F.xxhash64(*place))).first()
    copies = 2 * different <= n
    if copies:
        piece = F.floor((F.row_number().over(Window.partitionBy(*place).orderBy("event")) - 1) / together)
        d = cut(d.withColumn("_piece", piece).groupBy(*place, "_piece").agg(F.collect_list("event").alias("event")).drop("_piece"), "spans")
    side = lambda p, sign, hi: d.where(F.col("lo_dir") == sign).select("lo_chr", "hi_chr", hi.alias("hi_dir"), *[F.col(c).alias(f"{p}_{c}") for c in ("event", *spans)])
    ends = lambda p, e: (F.col(f"{p}_{e}_st"), F.col(f"{p}_{e}_nd"))
    box = lambda p, wider: tuple((F.least(*ends(p, e)) - wider, F.greatest(*ends(p, e)) + wider) for e in ("lo", "hi"))
    width = 2 * within + 1
    hit = box_candidates(side("x", "+", F.col("hi_dir")), side("y", "-", S.invert(F.col("hi_dir"))), ["lo_chr", "hi_chr", "hi_dir"], box("x", within), box("y", 0), (width, width))
    far = lambda e: I.distance(*ends("x", e), *ends("y", e))
    hit = hit.where((far("lo") <= within) & (far("hi") <= within)).select("x_event", "y_event")
    if copies:
        hit = hit.withColumn("x_event", F.explode("x_event")).withColumn("y_event", F.explode("y_event"))
    return hit.where(F.col("x_event") != F.col("y_event")).select(F.least("x_event", "y_event").alias("x"), F.greatest("x_event", "y_event").alias("y"))


def prune_satellite_pairs(junctions: DataFrame, fragments: DataFrame, least_mapq: int = 60, within: int = 100_000) -> DataFrame:
    """Junctions without those between two satellites that fail: at a chromosome end, within a chromosome with unlike
    directions, with a well-mapped opposite one, poorly mapped, or against a centromere fragment's direction.

    fragments: chr, dir (true: higher on the right). The entering end counts with its direction inverted.
    """
    both = F.col("a_sat") & F.col("b_sat")
    well = (F.col("a_mapq") >= least_mapq) & (F.col("b_mapq") >= least_mapq)
    op = opposite_pairs(junctions.where(both & well), within)
    op = op.select(F.explode(F.array("x", "y")).alias("event")).distinct().withColumn("_opposite", F.lit(True))
    d = junctions.join(op, "event", "left")
    want = lambda p: F.when(F.col(f"_{p}f"), "-").otherwise("+")
    for p in SIDES:
        d = d.join(F.broadcast(fragments.select(F.col("chr").alias(f"{p}_chr"), F.col("dir").alias(f"_{p}f"))), f"{p}_chr", "left")  # a row per chromosome
    against = (F.col("_af").isNotNull() & (F.col("a_dir") != want("a"))) | (F.col("_bf").isNotNull() & (S.invert(F.col("b_dir")) != want("b")))
    same = (F.col("a_chr") == F.col("b_chr")) & (F.col("a_dir") != F.col("b_dir"))
    bad = both & (F.col("a_telo_sat") | F.col("b_telo_sat") | same | F.coalesce("_opposite", F.lit(False)) | ~well | against)
    return d.where(~F.coalesce(bad, F.lit(False))).select(junctions.columns)


def satellite_clusters(junctions: DataFrame, centromeres: DataFrame, within: int = 100_000, order: str = "event") -> DataFrame:
    """(event, master): junctions that reach a centromere from one side, with the first of their kind.

    Kind: which side of the centromere, the other end's chromosome, and both directions, all as seen from the
    centromere. A junction joins the first master whose other end lies within the distance. centromeres: chr, left,
    right (flank bounds).
    """
    c = lambda p: centromeres.select(F.col("chr").alias(f"{p}_chr"), F.col("left").alias(f"_{p}l"), F.col("right").alias(f"_{p}r"))
    d = junctions.join(F.broadcast(c("a")), "a_chr", "left").join(F.broadcast(c("b")), "b_chr", "left")  # a row per chromosome
    side = (
        F.when((F.col("a_st") <= F.col("_al")) & (F.col("a_dir") == "+"), "la").when((F.col("b_st") <= F.col("_bl")) & (F.col("b_dir") == "-"), "lb")
        .when((F.col("a_nd") >= F.col("_ar")) & (F.col("a_dir") == "-"), "ra").when((F.col("b_nd") >= F.col("_br")) & (F.col("b_dir") == "+"), "rb")
    )
    d = d.withColumn("_side", side).where("_side is not null")
    at_a = F.col("_side").endswith("a")
    d = d.select(F.col(order).alias("_order"), "event", F.substring("_side", 1, 1).alias("arm"), F.when(at_a, F.col("b_chr")).otherwise(F.col("a_chr")).alias("o_chr"), F.when(at_a, F.col("b_st")).otherwise(F.col("a_st")).alias("o_st"), F.when(at_a, F.col("b_nd")).otherwise(F.col("a_nd")).alias("o_nd"),
                 F.when(at_a, F.col("b_dir")).otherwise(S.invert(F.col("a_dir"))).alias("o_dir"))
    got = greedy_leaders(d, ["arm", "o_chr", "o_dir"], ["_order"], ["o_st", "o_nd"], within)
    first = got.where("is_leader").select("arm", "o_chr", "o_dir", "leader", F.col("event").alias("master"))
    return got.join(first, ["arm", "o_chr", "o_dir", "leader"]).select("event", "master")


def conjoined_jumps(junctions: DataFrame, within: int = 1_000_000, flip_from: int = 100_000, least: int = 5_000_000, bound: float = 0.1) -> DataFrame:
    """Pairs of inversion junctions of one chromosome that together make an insertion or deletion: x, y, kind, estimated.

    Junctions of some span are also read the other way. The exit of x must meet the entry of y in one direction within
    the distance; the reference ratio from x's entry to y's exit must be off 1 by more than the bound, over at least
    `least` bases. A negative ratio is an insertion.
    """
    one = F.struct(*[F.col(f"{p}_{c}").alias(f"{p}_{c}") for p in SIDES for c in ("st", "nd", "dir")])
    other = F.struct(*[(S.invert(F.col(f"{q}_dir")) if c == "dir" else F.col(f"{q}_{c}")).alias(f"{p}_{c}") for p, q in (("a", "b"), ("b", "a")) for c in ("st", "nd", "dir")])
    ways = F.when(F.abs(F.col("a_st") - F.col("b_st")) >= flip_from, F.array(one, other)).otherwise(F.array(one))
    d = junctions.where("a_chr = b_chr").select("event", F.col("a_chr").alias("chr"), F.explode(ways).alias("w")).select("event", "chr", "w.*")
    x = d.select("chr", F.col("event").alias("x"), *[F.col(f"{p}_{c}").alias(f"x{p}_{c}") for p in SIDES for c in ("st", "nd", "dir")]).withColumn("st", F.col("xb_st") - within).withColumn("nd", F.col("xb_nd") + within)
    y = d.select("chr", F.col("event").alias("y"), *[F.col(f"{p}_{c}").alias(f"y{p}_{c}") for p in SIDES for c in ("st", "nd", "dir")]).withColumn("r_st", F.col("ya_st")).withColumn("r_nd", F.col("ya_nd"))
    hit = range_join(x, y, ["chr"], "closed", within)
    gap = I.distance(F.col("xb_st"), F.col("xb_nd"), F.col("ya_st"), F.col("ya_nd"))
    hit = hit.where((F.col("x") < F.col("y")) & (F.col("xb_dir") == F.col("ya_dir")) & (gap < within))
    est = F.when(F.col("xa_dir") == "+", F.col("yb_nd") - F.col("xa_st")).otherwise(F.col("xa_nd") - F.col("yb_st"))
    total = (F.col("xa_nd") - F.col("xa_st")) + (F.col("yb_nd") - F.col("yb_st"))
    hit = hit.withColumn("estimated", est).withColumn("ratio", est / F.nullif(total, F.lit(0)))
    hit = hit.where((F.abs(F.col("ratio") - 1) > bound) & (F.abs("estimated") > least))
    return hit.select("x", "y", F.when(F.col("ratio") < 0, "insertion").otherwise("deletion").alias("kind"), F.abs("estimated").alias("estimated")).distinct()


def rescued_by_templates(inversions: DataFrame, templates: DataFrame, within: int = 200_000) -> DataFrame:
    """Inversion junctions with an end next to a translocation's end on their chromosome: (event, template, side).

    Which end must be near, and on which side, follows from the template end's role and strand; overlap always counts.
    """
    t = templates.select(F.col("event").alias("template"), F.explode(F.array(*[F.struct(F.lit(p).alias("role"), F.col(f"{p}_chr").alias("chr"), F.col(f"{p}_st").alias("r_st"), F.col(f"{p}_nd").alias("r_nd"), F.col(f"{p}_dir").alias("dir")) for p in SIDES])).alias("t")).select("template", "t.*")
    ends = inversions.select("event", F.explode(F.array(*[F.struct(F.lit(p).alias("side"), F.col(f"{p}_chr").alias("chr"), F.col(f"{p}_st").alias("e_st"), F.col(f"{p}_nd").alias("e_nd")) for p in SIDES])).alias("e")).select("event", "e.*")
    e = ends.withColumn("st", F.col("e_st") - within).withColumn("nd", F.col("e_nd") + within)
    hit = range_join(e, t, ["chr"], "closed", within)
    before = (F.col("role") == "a") == (F.col("dir") == "+")  # the exit end lies before the template, else the entry end after it
    gap = I.distance(F.col("e_st"), F.col("e_nd"), F.col("r_st"), F.col("r_nd"))
    side = F.when(before, "b").otherwise("a")
    placed = F.when(before, F.col("e_nd") < F.col("r_st")).otherwise(F.col("e_st") > F.col("r_nd"))
    return hit.where((F.col("side") == side) & ((gap == 0) | ((gap < within) & placed))).select("event", "template", "side").distinct()


def inside_counts(jumps: DataFrame, breakends: DataFrame, width: int = 1_000_000) -> DataFrame:
    """jumps (jump, chr, st, nd) with the number of junctions that have a breakend (event, chr, pos) in them, ends included.

    Within a span, a junction has one more distinct position than steps between neighbouring ones. So each distinct span counts
    positions and takes off steps, both as sums over equal ones: neither meets jumps or junctions singly.
    """
    at = breakends.select("event", "chr", "pos").dropna().distinct()
    step = F.lag("pos").over(Window.partitionBy("event", "chr").orderBy("pos"))
    at = at.select("chr", F.col("pos").alias("r_nd"), step.alias("_from"))
    own = jumps.select("jump", "chr", "st", "nd").where(F.col("st") <= F.col("nd")).dropna().distinct()
    spans = own.select("chr", "st", "nd").distinct()
    steps = at.where("_from is not null").groupBy("chr", F.col("_from").alias("r_st"), "r_nd").agg(F.count("*").alias("_n"))
    longest = spans.agg(F.max(F.col("nd") - F.col("st")).alias("_most"))
    steps = steps.join(F.broadcast(longest), F.col("r_nd") - F.col("r_st") <= F.col("_most")).drop("_most")  # one row
    points = at.groupBy("chr", "r_nd").agg(F.count("*").alias("_n")).select("chr", F.col("r_nd").alias("r_st"), "r_nd", "_n")
    sums = [range_join(spans, s, ["chr"], "contains", width).groupBy("chr", "st", "nd").agg(F.sum(F.col("_n") * sign).alias("_n")) for s, sign in ((points, 1), (steps, -1))]
    counts = sums[0].unionByName(sums[1]).groupBy("chr", "st", "nd").agg(F.sum("_n").alias("_n"))
    # a jump of several spans counts a junction in any of them once
    several = own.groupBy("jump").agg(F.count("*").alias("_k")).where("_k > 1").select("jump")
    one = own.join(several, "jump", "left_anti").join(counts, ["chr", "st", "nd"]).select("jump", F.col("_n").alias("n_inside"))
    b = breakends.select("event", "chr", F.col("pos").alias("r_st"), F.col("pos").alias("r_nd"))
    more = range_join(own.join(several, "jump", "left_semi"), b, ["chr"], "closed", width).groupBy("jump").agg(F.countDistinct("event").alias("n_inside"))
    return jumps.join(one.unionByName(more), "jump", "left").withColumn("n_inside", F.coalesce("n_inside", F.lit(0)))


def jump_edges(jumps: DataFrame) -> DataFrame:
    """Graph edges of jumps (jump, kind, a_id, b_id, n_inside): insertions need two junctions inside."""
    from strandweave.operators.graph import junction_edges

    return junction_edges(jumps.where("kind <> 'insertion' or n_inside >= 2").select(F.col("a_id").alias("a"), F.col("b_id").alias("b")))


def jump_candidates(ratios: DataFrame, satellites: DataFrame, min_span: int, width: int = 1_000_000) -> DataFrame:
    """Jumps of contigs (jump, chr, st, nd, ratio) that are long enough: kind by the ratio's sign; deletions only across
    a satellite."""
    d = ratios.where((F.col("nd") - F.col("st") >= min_span) & (F.col("ratio") != 0)).withColumn("kind", F.when(F.col("ratio") < 0, "insertion").otherwise("deletion"))
    over = range_join(d.select("jump", "chr", "st", "nd"), satellites.select("chr", F.col("st").alias("r_st"), F.col("nd").alias("r_nd")), ["chr"], "half_open", width).select("jump").distinct().withColumn("over_satellite", F.lit(True))
    d = d.join(over, "jump", "left").withColumn("over_satellite", F.coalesce("over_satellite", F.lit(False)))
    return d.where("kind = 'insertion' or over_satellite")


def depth_supported(jumps: DataFrame, depth: DataFrame, satellites: DataFrame, unit: float, share: float, flank: int = 500_000) -> DataFrame:
    """jumps with reason: pass, endpoint_satellite, missing_depth or step.

    The depth steps at both ends, in the direction the kind asks for (a deletion is lower inside), must each reach share
    x unit.
    """
    ends = jumps.select("jump", "chr", "kind", F.explode(F.array(F.struct(F.lit("l").alias("e"), F.col("st").alias("pos")), F.struct(F.lit("r").alias("e"), F.col("nd").alias("pos")))).alias("x")).select("jump", "chr", "kind", "x.*")
    ends = ends.withColumn("pid", F.concat_ws(":", F.col("jump").cast("string"), "e"))
    pts = ends.select("pid", "chr", F.explode(F.array(F.struct(F.lit("L").alias("s"), (F.col("pos") - flank).alias("st"), F.col("pos").alias("nd")), F.struct(F.lit("R").alias("s"), F.col("pos").alias("st"), (F.col("pos") + flank).alias("nd")))).alias("y")).select("pid", "chr", "y.*").withColumn("qid", F.concat_ws(":", "pid", "s"))
    win = depth.select("chr", F.col("st").alias("r_st"), F.col("nd").alias("r_nd"), "meandepth")
    m = O.weighted_depth(pts, win, ["chr"], "qid", flank, "meandepth").groupBy("pid").agg(F.max(F.when(F.col("s") == "L", F.col("mean_depth"))).alias("lm"), F.max(F.when(F.col("s") == "R", F.col("mean_depth"))).alias("rm"))
    high_left = (F.col("kind") == "deletion") == (F.col("e") == "l")
    step = F.when(high_left, F.col("lm") - F.col("rm")).otherwise(F.col("rm") - F.col("lm"))
    sat = range_join(ends.select("pid", "chr", F.col("pos").alias("st"), (F.col("pos") + 1).alias("nd")), satellites.select("chr", F.col("st").alias("r_st"), F.col("nd").alias("r_nd")), ["chr"], "half_open", flank).select("pid").distinct().withColumn("on_sat", F.lit(True))
    e = ends.join(m, "pid", "left").join(sat, "pid", "left").groupBy("jump").agg(F.max(F.coalesce("on_sat", F.lit(False))).alias("s"), F.max(step.isNull()).alias("n"), F.min(step).alias("m"))
    why = F.when(F.col("s"), "endpoint_satellite").when(F.col("n"), "missing_depth").when(F.col("m") >= share * unit, "pass").otherwise("step")
    return jumps.join(e.select("jump", why.alias("reason"), F.col("m").alias("min_step")), "jump")


def removal_tiers(junctions: DataFrame) -> DataFrame:
    """Junctions that may be removed: no end of tier 3, and both ends' tiers vote for it by how many ends are valid.

    columns a_valid, b_valid, a_tier, b_tier, and is_virtual; satellite ends count as valid.
    """
    n = (F.col("a_valid") | F.col("a_sat")).cast("int") + (F.col("b_valid") | F.col("b_sat")).cast("int")
    vote = lambda p: F.when(F.col(f"{p}_tier") == 1, n <= 1).when(F.col(f"{p}_tier") == 2, n == 0).otherwise(False)
    return junctions.where(~F.col("is_virtual") & vote("a") & vote("b"))


def endpoint_spans(pos: Column, length: Column, path_dir: Column, leaves: Column, flank: int = 1_000) -> tuple[Column, Column]:
    """Reference span of a synthetic node that ends (leaves) or starts at pos, in the path's direction; never empty."""
    p = F.greatest(F.lit(1), F.least(pos, length))
    width = F.least(F.lit(flank), F.greatest(F.lit(1), length))
    behind = (path_dir == "+") == leaves
    st = F.when(behind, F.greatest(F.lit(0), p - width)).otherwise(p)
    nd = F.when(behind, p).otherwise(F.least(length, p + width))
    empty = nd <= st
    return F.when(empty, F.greatest(st - 1, F.lit(0))).otherwise(st), F.when(empty, F.greatest(st, F.lit(1))).otherwise(nd)


def synthetic_nodes(junctions: DataFrame, lengths: DataFrame, first_id: int, flank: int = 1_000) -> DataFrame:
    """Two nodes for each junction of a variant file (ord, name, chr, pos, dir_a, mate_chr, mate_pos, dir_b), numbered
    from first_id in order."""
    ends = F.array(
        F.struct(F.lit(0).alias("k"), F.col("chr").alias("chr_nam"), F.col("pos").alias("pos"), F.col("dir_a").alias("ctg_dir")),
        F.struct(F.lit(1).alias("k"), F.col("mate_chr").alias("chr_nam"), F.col("mate_pos").alias("pos"), F.col("dir_b").alias("ctg_dir")),
    )
    d = junctions.select("ord", F.col("name").alias("ctg_nam"), F.explode(ends).alias("e")).select("ord", "ctg_nam", "e.*").join(F.broadcast(lengths.select(F.col("chr").alias("chr_nam"), F.col("len").alias("chr_len"))), "chr_nam")  # a row per chromosome
    st, nd = endpoint_spans(F.col("pos"), F.col("chr_len"), F.col("ctg_dir"), F.col("k") == 0, flank)
    number = F.row_number().over(Window.orderBy("ord", "k")) - 1 + first_id  # variant files hold thousands of junctions
    return d.select(number.alias("node_id"), "ctg_nam", "ctg_dir", "chr_nam", "chr_len", st.alias("chr_str"), nd.alias("chr_end"), F.lit(60).alias("ctg_mapq"), F.lit(1).alias("ctg_typ"))


def missing_telomeres(lengths: DataFrame, present: DataFrame, flank: int = 1_000) -> DataFrame:
    """Virtual telomere spans (chr, side, st, nd) of chromosome ends without one (present: chr, side)."""
    both = lengths.select("chr", "len", F.explode(F.array(F.lit("f"), F.lit("b"))).alias("side")).join(present, ["chr", "side"], "left_anti")
    front = F.col("side") == "f"
    return both.select("chr", "side", F.when(front, 0).otherwise(F.greatest(F.col("len") - flank, F.lit(0))).alias("st"), F.when(front, F.least(F.lit(flank), F.col("len"))).otherwise(F.col("len")).alias("nd"))


def nearest_partners(groups: DataFrame, ends: DataFrame, within: int) -> DataFrame:
    """For each group (grp, chr, pos) the nearest end (end_id, chr, at) within reach, by distance, then position, then id."""
    return nearest(groups, ends, ["chr"], "grp", F.abs(F.col("pos") - F.col("at")), ["at", "end_id"], ("pos", "at", within))


def count_candidates(junctions: DataFrame) -> DataFrame:
    """Distinct junctions (unordered) with both display points, for read counting."""
    a, b = (S.breakend_coord(F.col(f"{p}_dir"), F.lit(p == "a"), F.col(f"{p}_st"), F.col(f"{p}_nd")) for p in SIDES)
    d = junctions.select(F.least("a_id", "b_id").alias("lo"), F.greatest("a_id", "b_id").alias("hi"), "a_chr", a.alias("a_pos"), "b_chr", b.alias("b_pos"), "event")
    return d.groupBy("lo", "hi").agg(F.min_by(F.struct("event", "a_chr", "a_pos", "b_chr", "b_pos"), "event").alias("_e")).select("lo", "hi", "_e.*")


def inversion_junctions(records: DataFrame, caller: str | None = None) -> tuple[DataFrame, DataFrame]:
    """(junctions, skipped) of symbolic inversions (line, chr, pos, end, m): both junctions of each, or for manta the one
    that INV3 or INV5 names; with both or neither of these a record is skipped."""
    three, five = F.map_contains_key("m", F.lit("INV3")), F.map_contains_key("m", F.lit("INV5"))
    left = F.struct(F.lit("left").alias("role"), F.lit("+").alias("dir_a"), F.lit("-").alias("dir_b"))
    right = F.struct(F.lit("right").alias("role"), F.lit("-").alias("dir_a"), F.lit("+").alias("dir_b"))
    if caller == "manta":
        roles = F.when(three & ~five, F.array(left)).when(five & ~three, F.array(right))
        why = F.when(three & five, "conflicting_inv3_inv5").when(~three & ~five, "missing_inv3_inv5")
    else:
        roles, why = F.array(left, right), F.lit(None).cast("string")
    d = records.withColumn("_why", F.when(F.col("end").isNull(), "no_end").otherwise(why))
    made = d.where("_why is null").select("line", "chr", "pos", F.explode(roles).alias("r"), F.col("chr").alias("mate_chr"), F.col("end").alias("mate_pos"))
    return made.select("line", "chr", "pos", "r.dir_a", "mate_chr", "mate_pos", "r.dir_b", "r.role"), d.where("_why is not null").select("line", F.col("_why").alias("reason"))


def visible(calls: DataFrame, weight: str, median: float, share: float) -> DataFrame:
    """Calls whose weight is more than share x half the median depth."""
    return calls.where(F.col(weight) > share * median / 2)


def is_absent(windows: DataFrame, chrom: str, satellites: DataFrame, least_share: float = 0.7, width: int = 1_000_000) -> bool:
    """Whether too few of a chromosome's windows outside satellites have any depth."""
    sat = satellites.select("chr", F.col("st").alias("r_st"), F.col("nd").alias("r_nd"))
    w = range_join(windows.where(F.col("chr") == chrom), sat, ["chr"], "half_open", width, how="left_anti")
    share = w.agg(F.avg(F.when(F.col("meandepth") != 0, 1.0).otherwise(0.0))).first()[0]
    return share is None or share < least_share


def track_tables(tracks: DataFrame, calls: DataFrame, bins: int = 10) -> dict[str, DataFrame]:
    """Tidy tables for drawing: depth tracks of `bins` windows each, and links of calls between chromosomes."""
    t = O.rebin(tracks.withColumn("_one", F.lit(1.0)), ["chr"], ["st"], bins, "observed", "_one", "st", "st")
    links = calls.where("a_chr <> b_chr").select("a_chr", "a_st", "b_chr", "b_st", "weight")
    return {"tracks": t, "links": links}
