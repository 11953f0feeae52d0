"""Event catalogues, variant pairing, filter provenance, event calling and report tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strandweave.functions import strands as S
from strandweave.functions import vcf_text as V
from strandweave.operators import ordered as O

STAGES = ("initial", "base", "filter", "cluster")
#: What a stage says of events that lose their last active carrier there.
COFILTERED = {
    "initial": "FILTERED_02_COFILTERED_PATH",
    "base": "FILTERED_23_COFILTERED_PATH",
    "filter": "FILTERED_24_COFILTERED_PATH",
    "cluster": "FILTERED_24_CLUSTER_COFILTERED_PATH",
}
NO_PATH = "FILTERED_02_NO_ELIGIBLE_PATH"


def catalogue(pairs: DataFrame, nodes: DataFrame, order: str = "ord") -> DataFrame:
    """Junction events in order of pairs (a, b, ord): unordered key, ends, directions as read forwards, running number.

    A pair that comes twice, in either order, is an error at run time.
    """
    a = nodes.select(F.col("node_id").alias("a"), F.col("chr_nam").alias("start_chr"), F.col("chr_str").alias("start_pos"), F.col("ctg_dir").alias("_da"), F.col("ctg_nam").alias("contig"))
    b = nodes.select(F.col("node_id").alias("b"), F.col("chr_nam").alias("end_chr"), F.col("chr_str").alias("end_pos"), F.col("ctg_dir").alias("_db"))
    d = pairs.join(a, "a").join(b, "b").withColumn("lo", F.least("a", "b")).withColumn("hi", F.greatest("a", "b"))
    fwd = F.col("a") < F.col("b")
    n = F.count("*").over(Window.partitionBy("lo", "hi"))
    d = d.withColumn("_n", n).withColumn("lo", F.when(F.col("_n") > 1, F.raise_error(F.concat(F.lit("event comes twice: "), F.col("lo"), F.lit("-"), F.col("hi"))).cast("bigint")).otherwise(F.col("lo")))
    number = F.row_number().over(Window.orderBy(order))  # a catalogue has thousands of rows
    return d.select(
        number.alias("number"), "lo", "hi", F.lit("bnd").alias("kind"), "start_chr", "start_pos", S.corrected(F.col("_da"), fwd).alias("start_dir"),
        "end_chr", "end_pos", S.corrected(F.col("_db"), fwd).alias("end_dir"), "contig",
    )


def first_seen(sources: list[DataFrame], key: list[str], order: str = "ord") -> DataFrame:
    """Union of sources without repeats: each key's row of the first source that has it, then by order."""
    u = None
    for k, s in enumerate(sources):
        s = s.withColumn("_src", F.lit(k))
        u = s if u is None else u.unionByName(s, allowMissingColumns=True)
    w = Window.partitionBy(*key).orderBy("_src", order)
    return u.withColumn("_k", F.row_number().over(w)).where("_k = 1").drop("_k", "_src")


def merged_by_key(events: DataFrame, key: list[str], ids: str, order: str) -> DataFrame:
    """One row per key: the first row in order, with the ids of all in order."""
    rest = [c for c in events.columns if c not in key]
    g = events.groupBy(*key).agg(F.min_by(F.struct(*rest), order).alias("_first"), F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), F.col(ids).alias("i")))).alias("_ids"))
    return g.select(*key, "_first.*", F.transform("_ids", lambda x: x["i"]).alias("all_ids"))


def same_sets(a: DataFrame, b: DataFrame) -> bool:
    """Both tables hold the same distinct rows."""
    return a.distinct().exceptAll(b.distinct()).limit(1).count() == 0 and b.distinct().exceptAll(a.distinct()).limit(1).count() == 0


def covering_columns(usage: DataFrame, required: DataFrame) -> DataFrame:
    """Columns whose events include every required one (relational division); all columns if none is required."""
    n = required.select("event").distinct().count()
    have = usage.where("cnt > 0").join(required.select("event").distinct(), "event").groupBy("col").agg(F.countDistinct("event").alias("_n"))
    return have.where(F.col("_n") == n).select("col") if n else usage.select("col").distinct()


def subset_columns(usage: DataFrame, allowed: DataFrame) -> DataFrame:
    """Columns all of whose events are allowed."""
    bad = usage.where("cnt > 0").join(allowed.select("event").distinct(), "event", "left_anti").select("col").distinct()
    return usage.select("col").distinct().join(bad, "col", "left_anti")


def carriers(usage: DataFrame, active: DataFrame | None = None) -> DataFrame:
    """Events with at least one (active) column that uses them."""
    u = usage.where("cnt > 0")
    return (u if active is None else u.join(active.select("col").distinct(), "col", "left_semi")).select("event").distinct()


def initial_reasons(events: DataFrame, usage: DataFrame, active: DataFrame, explicit: DataFrame) -> DataFrame:
    """(event, reason) of the first stage; events without a row pass. An explicit reason comes first."""
    any_ = carriers(usage).withColumn("_any", F.lit(True))
    act = carriers(usage, active).withColumn("_act", F.lit(True))
    d = events.select("event").join(explicit.select("event", F.col("reason").alias("_x")), "event", "left").join(any_, "event", "left").join(act, "event", "left")
    r = F.when(F.col("_x").isNotNull(), F.col("_x")).when(F.col("_any").isNull(), NO_PATH).when(F.col("_act").isNull(), COFILTERED["initial"])
    return d.select("event", r.alias("reason")).where("reason is not null")


def next_reasons(events: DataFrame, previous: DataFrame, usage: DataFrame, active: DataFrame, direct: DataFrame, stage: str, forced: DataFrame | None = None, previous_active: DataFrame | None = None) -> DataFrame:
    """(event, reason) of a later stage: an earlier reason stays; then a forced one; an event with an active carrier
    passes; else its direct reason, or that it was filtered along with others.

    Columns may not come back: with previous_active given, an active column that isn't among them is an error.
    """
    if previous_active is not None and active.select("col").join(previous_active, "col", "left_anti").limit(1).count():
        raise ValueError(f"stage {stage} brings columns back")
    act = carriers(usage, active).withColumn("_act", F.lit(True))
    d = events.select("event").join(previous.select("event", F.col("reason").alias("_p")), "event", "left").join(act, "event", "left")
    d = d.join(direct.select("event", F.col("reason").alias("_d")), "event", "left")
    d = d.join(forced.select("event", F.col("reason").alias("_f")), "event", "left") if forced is not None else d.withColumn("_f", F.lit(None).cast("string"))
    r = F.coalesce("_p", "_f", F.when(F.col("_act").isNull(), F.coalesce("_d", F.lit(COFILTERED.get(stage, f"FILTERED_{stage.upper()}")))))
    return d.select("event", r.alias("reason")).where("reason is not null")


def stage_report(events: DataFrame, stages: dict[str, tuple[DataFrame, DataFrame] | None], unit: float) -> DataFrame:
    """events with cn_ and reason_ of each stage: weight / unit where it passes, -1 with its reason where it doesn't,
    NA where the stage wasn't run. stages: name -> (weights: event, weight; reasons: event, reason)."""
    out = events
    for name, made in stages.items():
        if made is None:
            out = out.withColumn(f"cn_{name}", F.lit("NA")).withColumn(f"reason_{name}", F.lit("NA"))
            continue
        w, r = made
        out = out.join(w.select("event", F.col("weight").alias("_w")), "event", "left").join(r.select("event", F.col("reason").alias("_r")), "event", "left")
        cn = F.when(F.col("_r").isNotNull(), "-1").otherwise(F.format_string("%.2f", F.bround(F.coalesce("_w", F.lit(0.0)) / unit, 2)))
        out = out.withColumn(f"cn_{name}", cn).withColumn(f"reason_{name}", F.coalesce("_r", F.lit("PASS"))).drop("_w", "_r")
    return out


def resolve_mates(records: DataFrame) -> DataFrame:
    """Pairs (first, second) of breakend records, each used once, the first in file order.

    records: line, id, chr, pos, mate_id, mate_chr, mate_pos. A unique match of MATEID wins, whatever the coordinates;
    else the one record whose coordinates and mate coordinates are reciprocal. A record in several pairs stays in the
    one that starts first.
    """
    r = records.select("line", "id", "chr", "pos", "mate_id", "mate_chr", "mate_pos")
    one_id = r.where("id is not null and id <> '.'").groupBy("id").agg(F.min("line").alias("_m"), F.count("*").alias("_n")).where("_n = 1").select(F.col("id").alias("mate_id"), "_m")
    by_id = r.join(one_id, "mate_id").where("_m <> line").select("line", F.col("_m").alias("by_id"))
    o = r.select(F.col("line").alias("_l"), F.col("chr").alias("mate_chr"), F.col("pos").alias("mate_pos"), F.col("mate_chr").alias("chr"), F.col("mate_pos").alias("pos"))
    by_pos = r.join(o, ["chr", "pos", "mate_chr", "mate_pos"]).where("_l <> line").groupBy("line").agg(F.min("_l").alias("by_pos"), F.count("*").alias("_n")).where("_n = 1").drop("_n")
    d = r.select("line").join(by_id, "line", "left").join(by_pos, "line", "left").withColumn("mate", F.coalesce("by_id", "by_pos")).where("mate is not null")
    d = d.select(F.least("line", "mate").alias("first"), F.greatest("line", "mate").alias("second")).distinct()
    used = d.select("first", "second", F.explode(F.array("first", "second")).alias("line"))
    w = Window.partitionBy("line").orderBy("first", "second")
    keep = used.withColumn("_k", F.row_number().over(w)).groupBy("first", "second").agg(F.max("_k").alias("_k")).where("_k = 1")
    return keep.select("first", "second")


#: What STRANDS of a breakend may say.
STRANDS = ("++", "--", "+-", "-+")
#: The first version of severus whose breakend alleles are in the order of their records.
SEVERUS_FIXED = (1, 7)


def _directed(b: DataFrame, caller: str | None, version: tuple[int, ...] | None) -> DataFrame:
    """b with directions as meant, and `fault` where they can't be known.

    Severus before 1.7 wrote the alleles of breakends with different strands the other way round at both ends; its
    STRANDS tells which these are. Without its version no breakend can be read.
    """
    none = F.lit(None).cast("string")
    if caller != "severus":
        return b.withColumn("fault", none)
    if version is None:
        return b.withColumn("fault", F.lit("version_unknown"))
    if V.padded(version) >= V.padded(SEVERUS_FIXED):
        return b.withColumn("fault", none)
    mixed = F.col("strands").isin("+-", "-+")
    for side in ("dir_a", "dir_b"):
        b = b.withColumn(side, F.when(mixed, S.invert(F.col(side))).otherwise(F.col(side)))
    return b.withColumn("fault", F.when(~F.coalesce(F.col("strands").isin(*STRANDS), F.lit(False)), "strands_missing"))


def normalise_breakends(
    records: DataFrame,
    caller: str | None = None,
    version: tuple[int, ...] | None = None,
    min_span: int = 100_000,
    filters: tuple[str, ...] = ("PASS", "."),
    lengths: DataFrame | None = None,
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(junctions, indels, skipped) of variant records (line, chr, pos, id, alt, filter, info).

    BND pairs give one junction, from the first record's ALT; where both lie on one chromosome with one direction the
    pair is a front jump (deletion) or back jump of at least min_span instead. INV gives the junctions of its two ends (or
    for manta the one that INV3 or INV5 names), with role left or right. DEL and DUP take their END, INS its SVLEN.

    A record is skipped, with its mate, for the first reason that holds: filtered (a member fails the filter; the other
    member is mate_filtered), contig_absent (a chromosome that lengths (chr, len) lacks, if given), version_unknown or
    strands_missing (severus, see _directed), mate_direction (the alleles of two mates aren't each other's reverse),
    small, no_end, what inversion_junctions says, single_breakend, malformed (a BND without readable allele), unsupported.
    """
    from strandweave.operators.junctions import inversion_junctions

    info = records.withColumn("m", V.info_map(F.col("info")))
    info = info.withColumn("svtype", F.upper(F.coalesce(F.col("m")["SVTYPE"], F.regexp_extract("alt", "^<([A-Za-z]+)", 1)))).withColumn("a", V.breakend_alt(F.col("alt")))
    info = info.withColumn("svtype", F.when(F.col("a").isNotNull(), "BND").otherwise(F.col("svtype"))).withColumn("ok", F.col("filter").isin(list(filters)))
    known = None
    if lengths is not None:
        known = lengths.select("chr").distinct()  # a row per chromosome
        info = info.join(F.broadcast(known.withColumn("_here", F.lit(True))), "chr", "left").withColumn("here", F.coalesce("_here", F.lit(False))).drop("_here")
    else:
        info = info.withColumn("here", F.lit(True))
    b = info.where("svtype = 'BND' and a is not null")
    b = b.select("line", "id", "chr", "pos", "ok", "here", F.split(F.coalesce(F.col("m")["MATEID"], F.col("m")["MATE_ID"]), ",")[0].alias("mate_id"), F.col("m")["STRANDS"].alias("strands"), "a.*")
    if known is not None:
        b = b.join(F.broadcast(known.select(F.col("chr").alias("mate_chr"), F.lit(True).alias("_there"))), "mate_chr", "left").withColumn("here", F.col("here") & F.coalesce("_there", F.lit(False))).drop("_there")
    pairs = resolve_mates(b)
    b = _directed(b, caller, version)
    second = b.select(F.col("line").alias("second"), *[F.col(c).alias(f"{c}2") for c in ("ok", "here", "fault", "dir_a", "dir_b")])
    p = b.join(pairs, b["line"] == pairs["first"]).join(second, "second")
    lone = b.join(pairs.select(F.explode(F.array("first", "second")).alias("line")), "line", "left_anti")
    every = p.drop("first").unionByName(lone, allowMissingColumns=True)
    paired = F.col("second").isNotNull()
    turned = paired & ((F.col("dir_a2") != S.invert(F.col("dir_b"))) | (F.col("dir_b2") != S.invert(F.col("dir_a"))))
    same = (F.col("chr") == F.col("mate_chr")) & (F.col("dir_a") == F.col("dir_b"))
    skip = (
        F.when(~F.col("ok"), "filtered").when(paired & ~F.col("ok2"), "mate_filtered").when(~F.col("here") | (paired & ~F.col("here2")), "contig_absent")
        .when(F.coalesce("fault", "fault2").isNotNull(), F.coalesce("fault", "fault2")).when(turned, "mate_direction").when(same & (F.abs(F.col("mate_pos") - F.col("pos")) < min_span), "small")
    )
    every = every.withColumn("skip", skip)
    live = every.where("skip is null")
    none = F.lit(None).cast("string")
    junctions = live.where(~same).select("line", "second", "id", "chr", "pos", "dir_a", "mate_chr", "mate_pos", "dir_b", none.alias("role"))
    front = ((F.col("dir_a") == "+") & (F.col("pos") < F.col("mate_pos"))) | ((F.col("dir_a") == "-") & (F.col("pos") > F.col("mate_pos")))
    jumps = live.where(same).select("line", "id", F.lit("BND").alias("svtype"), F.when(front, "front_jump").otherwise("back_jump").alias("event_type"), "chr", F.least("pos", "mate_pos").alias("st"), F.greatest("pos", "mate_pos").alias("nd"))
    other = info.where("svtype in ('DEL', 'DUP', 'INS', 'INV')").withColumn("end", V.optional_int(F.col("m")["END"])).withColumn("len", F.abs(V.optional_int(F.col("m")["SVLEN"])))
    nd = F.when(F.col("svtype") == "INS", F.col("pos") + F.col("len")).otherwise(F.col("end"))
    small = (F.col("svtype") != "INV") & (F.col("nd") - F.col("pos") < min_span)
    other = other.withColumn("nd", nd).withColumn("skip", F.when(~F.col("ok"), "filtered").when(~F.col("here"), "contig_absent").when(F.col("nd").isNull(), "no_end").when(small, "small"))
    kind = F.when(F.col("svtype") == "DEL", "front_jump").otherwise("back_jump")
    simple = other.where("skip is null and svtype <> 'INV'").select("line", "id", "svtype", kind.alias("event_type"), "chr", F.col("pos").alias("st"), "nd")
    turns, unread = inversion_junctions(other.where("skip is null and svtype = 'INV'").select("line", "chr", "pos", "end", "m"), caller)
    turns = turns.join(info.select("line", "id"), "line").withColumn("second", F.lit(None).cast(records.schema["line"].dataType))
    gone = every.where("skip is not null").select("line", F.col("skip").alias("reason"))
    mates = F.when(F.col("skip") == "filtered", F.when(F.col("ok2"), "mate_filtered").otherwise("filtered")).when(F.col("skip") == "mate_filtered", "filtered").otherwise(F.col("skip"))
    gone = gone.unionByName(every.where(F.col("skip").isNotNull() & paired).select(F.col("second").alias("line"), mates.alias("reason")))
    gone = gone.unionByName(other.where("skip is not null").select("line", F.col("skip").alias("reason"))).unionByName(unread)
    rest = info.where("svtype is null or svtype not in ('BND', 'DEL', 'DUP', 'INS', 'INV') or (svtype = 'BND' and a is null)")
    why = F.when(V.is_single_breakend(F.col("alt")), "single_breakend").when(F.col("svtype") == "BND", "malformed").otherwise("unsupported")
    return junctions.unionByName(turns.select(junctions.columns)), jumps.unionByName(simple), gone.unionByName(rest.select("line", why.alias("reason")))


def check_contigs(header: DataFrame, lengths: DataFrame) -> DataFrame:
    """Header contigs (chr, len) that the reference (chr, len) lacks; a length that differs is an error at run time."""
    d = header.join(F.broadcast(lengths.select("chr", F.col("len").alias("_len"))), "chr", "left")  # a row per chromosome
    bad = F.raise_error(F.concat(F.lit("contig length differs: "), F.col("chr"))).cast("boolean")
    return d.where(F.when(F.col("len") != F.col("_len"), bad).otherwise(F.col("_len").isNull())).select("chr", "len")


def records_of_nodes(nodes: DataFrame, records: DataFrame) -> DataFrame:
    """(node, part, key): the input records behind the nodes (node) of variants, by their names.

    records: key, id (strings). A node of an inversion is named vcf_inv_ID, with _left or _right after it, one of a
    breakend vcf_bnd_ID or vcf_bnd_ID_MATEID, with sanitised ids. As ids may hold underscores, every place where a name
    can be cut is tried by equi-joins, and the longest first id wins whose rest is nothing or an id. Several records may
    share a sanitised id. A name that fits no id stands for itself; other nodes have no row.
    """
    ids = records.select(V.sanitize_id(F.col("id")).alias("sid"), "key")
    known = ids.select("sid").distinct()
    named = nodes.where(F.col("node").rlike("^vcf_(inv|bnd)_")).select("node").distinct()
    inversion = F.col("node").startswith("vcf_inv_")
    rest = F.substring("node", len("vcf_inv_") + 1, 1 << 20)
    named = named.withColumn("_body", F.when(inversion, F.regexp_replace(rest, "_(left|right)$", "")).otherwise(rest)).withColumn("_w", F.split("_body", "_"))
    n = F.size("_w")
    cut_at = lambda k: F.struct(F.array_join(F.slice("_w", F.lit(1), k), "_").alias("a"), F.when(k < n, F.array_join(F.slice("_w", k + 1, n), "_")).alias("b"))
    tries = F.when(inversion, F.array(F.struct(F.col("_body").alias("a"), F.lit(None).cast("string").alias("b")))).otherwise(F.transform(F.sequence(F.lit(1), n), cut_at))
    tried = named.select("node", F.explode(tries).alias("t")).select("node", "t.*").join(known.withColumnRenamed("sid", "a"), "a")
    tried = tried.join(known.select(F.col("sid").alias("b"), F.lit(True).alias("_mate")), "b", "left").where("b is null or _mate")
    best = tried.groupBy("node").agg(F.max_by(F.array_compact(F.array("a", "b")), F.length("a")).alias("_parts"))
    parts = named.join(best, "node", "left").select("node", F.posexplode(F.coalesce("_parts", F.array("_body"))).alias("part", "sid"))
    return parts.join(ids, "sid", "left").select("node", "part", F.coalesce("key", "sid").alias("key"))


def graph_events(indels: DataFrame) -> DataFrame:
    """Events that may become graph edges: those of DEL, DUP and BND records."""
    return indels.where(F.upper("svtype").isin("DEL", "DUP", "BND"))


def merge_indels(indels: DataFrame, tolerance: int = 10_000, order: str = "ord") -> DataFrame:
    """Indels of one type and chromosome whose both ends lie within the tolerance of an earlier one are that one."""
    from strandweave.operators.leaders import greedy_leaders

    d = indels.withColumn("_lo", F.least("st", "nd")).withColumn("_hi", F.greatest("st", "nd"))
    got = greedy_leaders(d, ["event_type", "chr"], [order], ["_lo", "_hi"], tolerance)
    g = got.groupBy("event_type", "chr", "leader").agg(F.min_by("_lo", order).alias("st"), F.min_by("_hi", order).alias("nd"), F.sum("weight").alias("weight"), F.array_sort(F.collect_list(F.struct(order, "source"))).alias("_s"), F.min(order).alias(order))
    names = F.array_distinct(F.transform("_s", lambda x: x["source"]))
    label = F.when(F.size(names) <= 3, F.array_join(names, "|")).otherwise(F.concat(F.array_join(F.slice(names, 1, 3), "|"), F.lit("|+"), (F.size(names) - 3).cast("string")))
    return g.select("event_type", "chr", "st", "nd", "weight", label.alias("source"), order)


def match_edges(edges: DataFrame, indels: DataFrame, tolerance: int = 10_000) -> DataFrame:
    """(edge, event) of graph edges with the nearest indel of their type within the tolerance at both ends.

    An edge without any is an error at run time.
    """
    step = max(1, tolerance)
    at = ["event_type", "chr"]
    # equal spans have one answer: of equal indels that is the smallest event, and equal edges share it
    e = edges.select(*at, F.col("st").alias("e_st"), F.col("nd").alias("e_nd")).dropna().distinct().withColumn("_b", F.explode(F.sequence(F.floor(F.col("e_st") / step) - 1, F.floor(F.col("e_st") / step) + 1)))
    i = indels.groupBy(*at, "st", "nd").agg(F.min("event").alias("event")).withColumn("_b", F.floor(F.col("st") / step))
    d1, d2 = F.abs(F.col("st") - F.col("e_st")), F.abs(F.col("nd") - F.col("e_nd"))
    near = F.min(F.struct((d1 + d2).alias("d"), F.col("event"))).alias("_near")
    hit = e.join(i, [*at, "_b"]).where((d1 <= tolerance) & (d2 <= tolerance) & F.col("event").isNotNull()).groupBy(*at, "e_st", "e_nd").agg(near)
    out = edges.select("edge", *at, F.col("st").alias("e_st"), F.col("nd").alias("e_nd")).join(hit, [*at, "e_st", "e_nd"], "left")
    out = out.select("edge", F.min("_near").over(Window.partitionBy("edge"))["event"].alias("event"))
    kind = indels.schema["event"].dataType
    return out.withColumn("event", F.coalesce("event", F.raise_error(F.concat(F.lit("no indel for edge "), F.col("edge").cast("string"))).cast(kind)))


def indel_calls(merged: DataFrame, unit: float, least_weight: float, least_span: int = 100_000) -> DataFrame:
    return merged.where((F.col("weight") > least_weight) & (F.col("nd") - F.col("st") >= least_span)).withColumn("cn", F.col("weight") / unit)


def amplicon_calls(circuits: DataFrame, weights: DataFrame, unit: float, least_weight: float) -> DataFrame:
    """Span of each circuit (circuit, chr, st, nd per node) on each of its chromosomes, with the circuit's copy number,
    twice its weight over the unit."""
    g = circuits.groupBy("circuit", "chr").agg(F.min("st").alias("st"), F.max("nd").alias("nd"))
    return g.join(weights, "circuit").where(F.col("weight") > least_weight).withColumn("cn", F.col("weight") / unit * 2)


def virtual_inversions(records: DataFrame, least_vaf: float = 0.2, balance: float = 1.1) -> DataFrame:
    """Candidates that reads support: both points spanned, depth balanced, and a fraction above least_vaf at a side.

    Pairs between chromosomes give an event for each side.
    """
    ok = F.col("a_spanned") & F.col("b_spanned") & (F.greatest("depth_a", "depth_b") <= balance * F.least("depth_a", "depth_b"))
    d = records.where(ok & (F.greatest(F.coalesce("vaf_a", F.lit(0.0)), F.coalesce("vaf_b", F.lit(0.0))) > least_vaf))
    side = lambda p: F.struct(F.col(f"chr_{p}").alias("chr"), F.col(f"pos_{p}").alias("pos"))
    same = F.col("chr_a") == F.col("chr_b")
    parts = F.when(same, F.array(F.struct(F.col("chr_a").alias("chr"), F.least("pos_a", "pos_b").alias("st"), F.greatest("pos_a", "pos_b").alias("nd")))).otherwise(
        F.transform(F.array(side("a"), side("b")), lambda x: F.struct(x["chr"].alias("chr"), x["pos"].alias("st"), x["pos"].alias("nd")))
    )
    return d.select("record", F.explode(parts).alias("e")).select("record", "e.*")


def karyotype_pieces(steps: DataFrame, path: str = "path_id", order: str = "step", least: int = 0) -> DataFrame:
    """Runs of one chromosome and strand along each path with their length; runs under `least` are left out."""
    runs = O.state_runs(steps, [path], [order], ["chr", "strand"], "length")
    return runs.where(F.col("total") >= least).select(path, "run", "chr", "strand", F.col("total").alias("length"))


def foreign_inserts(rows: DataFrame, share: float = 0.2, order: str = "row") -> DataFrame:
    """Stretches inside a contig edge that lie on another chromosome than its ends and hold at least `share` of it."""
    w = Window.partitionBy("edge")
    d = rows.withColumn("_first", F.first("chr").over(w.orderBy(order))).withColumn("_last", F.last("chr").over(w.orderBy(order).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)))
    d = d.withColumn("length", F.col("nd") - F.col("st")).withColumn("_all", F.sum(F.col("nd") - F.col("st")).over(w))
    runs = O.state_runs(d, ["edge", "_first", "_last", "_all"], [order], ["chr", "strand"], "length")
    return runs.where((F.col("chr") != F.col("_first")) & (F.col("chr") != F.col("_last")) & (F.col("total") >= share * F.col("_all"))).select("edge", "run", "chr", "strand", F.col("total").alias("length"))


def test_coordinates(junctions: DataFrame, nodes: DataFrame) -> DataFrame:
    """(event, chr, pos, side) of both ends of junctions (event, a, b), sorted by position in use."""
    n = nodes.select("node_id", F.col("chr_nam").alias("chr"), "chr_str", "chr_end", "ctg_dir")
    a = junctions.join(n, F.col("a") == F.col("node_id")).select("event", "chr", S.breakend_coord(F.col("ctg_dir"), F.lit(True), F.col("chr_str"), F.col("chr_end")).alias("pos"), S.high_side(F.col("ctg_dir"), F.lit(True)).alias("side"))
    b = junctions.join(n, F.col("b") == F.col("node_id")).select("event", "chr", S.breakend_coord(F.col("ctg_dir"), F.lit(False), F.col("chr_str"), F.col("chr_end")).alias("pos"), S.high_side(F.col("ctg_dir"), F.lit(False)).alias("side"))
    return a.unionByName(b)


def classify_jump(chr_a: Column, chr_b: Column, dir_a: Column, dir_b: Column, pos_a: Column, pos_b: Column, least: int = 100_000) -> Column:
    """front_jump (deletion) or back_jump (duplication) of a junction within a chromosome and direction; else null."""
    ok = (chr_a == chr_b) & (dir_a == dir_b) & (F.abs(pos_a - pos_b) >= least)
    return F.when(ok, F.when((dir_a == "+") == (pos_a < pos_b), "front_jump").otherwise("back_jump"))


def anchor_support(alignments: DataFrame, anchors: DataFrame, width: int = 10_000) -> DataFrame:
    """(pair, count, n_reads): reads that cover both anchors of a key in agreeing orientation and query order.

    alignments: read, flag, chr, st, nd, strand, qst (query position of st, counted along the read); anchors: pair,
    count, anchor (1, 2), chr, pos, strand. Unmapped, secondary, failed and duplicate alignments (mask 1796) are left
    out. A read counts once for each key.
    """
    from strandweave.operators.range_join import range_join

    a = alignments.where(F.col("flag").bitwiseAND(1796) == 0)
    p = anchors.select("pair", "count", "anchor", "chr", F.col("pos").alias("r_st"), (F.col("pos") + 1).alias("r_nd"), F.col("strand").alias("want"))
    hit = range_join(a, p, ["chr"], "half_open", width)
    q = F.when(F.col("strand") == "+", F.col("qst") + F.col("r_st") - F.col("st")).otherwise(F.col("qst") + F.col("nd") - 1 - F.col("r_st"))
    hit = hit.select("read", "pair", "count", "anchor", q.alias("q"), (F.col("strand") == F.col("want")).alias("as_wanted")).distinct()
    # of each read and key the extreme query positions decide, so hits are never paired with each other
    x = hit.groupBy("read", "pair", "count").agg(
        F.min(F.when((F.col("anchor") == 1) & F.col("as_wanted"), F.col("q"))).alias("q1f"), F.max(F.when((F.col("anchor") == 2) & F.col("as_wanted"), F.col("q"))).alias("q2f"),
        F.max(F.when((F.col("anchor") == 1) & ~F.col("as_wanted"), F.col("q"))).alias("q1r"), F.min(F.when((F.col("anchor") == 2) & ~F.col("as_wanted"), F.col("q"))).alias("q2r"),
    )
    good = x.where(F.coalesce(F.col("q1f") <= F.col("q2f"), F.lit(False)) | F.coalesce(F.col("q2r") <= F.col("q1r"), F.lit(False)))
    return good.groupBy("pair", "count").agg(F.countDistinct("read").alias("n_reads"))


def rescue_candidates(aligned: DataFrame, original: DataFrame, satellites: DataFrame, width: int = 100_000) -> DataFrame:
    """Queries whose two terminal aligned states are the states, in order, of their original alignments, with both
    terminal rows on satellites; the longest query of each canonical pair of states.

    aligned, original: query_name, query_length, query_start, strand, target_name, target_start, target_end.
    """
    from strandweave.operators.range_join import range_join

    row = F.struct(F.col("target_name").alias("c"), F.col("strand").alias("s"))
    t = aligned.groupBy("query_name").agg(F.max("query_length").alias("query_length"), F.min_by(row, "query_start").alias("a"), F.max_by(row, "query_start").alias("b"), F.count("*").alias("n"))
    o = O.state_runs(original.withColumn("_one", F.lit(1)), ["query_name"], ["query_start"], ["target_name", "strand"], "_one")
    o = o.groupBy("query_name").agg(F.array_sort(F.collect_list(F.struct("run", F.struct(F.col("target_name").alias("c"), F.col("strand").alias("s")).alias("x")))).alias("r"))
    o = o.select("query_name", F.transform("r", lambda y: y["x"]).alias("states"))
    sat = satellites.select(F.col("chr").alias("target_name"), F.col("st").alias("r_st"), F.col("nd").alias("r_nd"))
    on = range_join(aligned.select("query_name", "query_start", "target_name", F.col("target_start").alias("st"), F.col("target_end").alias("nd")), sat, ["target_name"], "half_open", width)
    on = on.select("query_name", "query_start").distinct()
    ends = aligned.groupBy("query_name").agg(F.min("query_start").alias("q0"), F.max("query_start").alias("q1"))
    both = ends.select("query_name", F.explode(F.array("q0", "q1")).alias("query_start")).join(on, ["query_name", "query_start"]).groupBy("query_name").agg(F.countDistinct("query_start").alias("k")).where("k = 2").select("query_name")
    d = t.where("n >= 2 and a <> b").join(o, "query_name").where((F.size("states") == 2) & (F.col("states")[0] == F.col("a")) & (F.col("states")[1] == F.col("b"))).join(both, "query_name")
    flip = lambda x: F.struct(x["c"].alias("c"), S.invert(x["s"]).alias("s"))
    key = F.least(F.struct(F.col("a"), F.col("b")), F.struct(flip(F.col("b")).alias("a"), flip(F.col("a")).alias("b")))
    return d.withColumn("key", key).groupBy("key").agg(F.max_by(F.struct("query_name", "query_length"), F.struct("query_length", "query_name")).alias("_q")).select("_q.*", "key.a", "key.b")


def bnd_alt(first_dir: Column, second_dir: Column, mate_chr: Column, mate_pos: Column, ref: str = "N") -> Column:
    """ALT text of a breakend by the directions of its path."""
    bracket = F.when(second_dir == "+", "[").otherwise("]")
    inner = F.concat(bracket, mate_chr, F.lit(":"), mate_pos.cast("string"), bracket)
    return F.when(first_dir == "+", F.concat(F.lit(ref), inner)).otherwise(F.concat(inner, F.lit(ref)))


def vcf_lines(junctions: DataFrame, indels: DataFrame, prefix: str = "event") -> DataFrame:
    """Body lines (ord, k, line) of junctions as mate pairs and of indels as symbolic alleles.

    junctions: ord, chr, pos, dir_a, mate_chr, mate_pos, dir_b, cn; indels: ord, event_type, chr, st, nd, cn.
    """
    number = F.concat(F.lit(f"{prefix}."), F.col("ord").cast("string"))
    tail = F.concat(F.lit(";CN="), F.format_string("%.2f", "cn"))

    def mate(k: int, c: str, p: str, d1: Column, d2: Column, mc: str, mp: str) -> Column:
        text = F.concat_ws("\t", c, F.col(p).cast("string"), F.concat(number, F.lit(f".{k}")), F.lit("N"), bnd_alt(d1, d2, F.col(mc), F.col(mp)), F.lit("."), F.lit("PASS"),
                           F.concat(F.lit("SVTYPE=BND;MATEID="), number, F.lit(f".{3 - k}"), F.lit(";STRANDS="), S.strands_of(d1, d2), tail))
        return F.struct(F.lit(k).alias("k"), text.alias("line"))

    a, b = F.col("dir_a"), F.col("dir_b")
    pair = F.array(mate(1, "chr", "pos", a, b, "mate_chr", "mate_pos"), mate(2, "mate_chr", "mate_pos", S.invert(b), S.invert(a), "chr", "pos"))
    out = junctions.select("ord", F.explode(pair).alias("r")).select("ord", "r.*")
    kind = F.when(F.col("event_type") == "front_jump", "DEL").when(F.col("event_type") == "back_jump", "DUP").otherwise("INV")
    sym = indels.select("ord", F.lit(1).alias("k"), F.concat_ws("\t", "chr", F.col("st").cast("string"), number, F.lit("N"), F.concat(F.lit("<"), kind, F.lit(">")), F.lit("."), F.lit("PASS"),
                        F.concat(F.lit("SVTYPE="), kind, F.lit(";END="), F.col("nd").cast("string"), F.lit(";SVLEN="), (F.col("nd") - F.col("st")).cast("string"), tail)).alias("line"))
    return out.unionByName(sym)


def bed_lines(calls: DataFrame, unit: float) -> DataFrame:
    """chr, st, nd, class and weight in units with two decimals; points become one position wide."""
    return calls.select("chr", "st", F.greatest(F.col("nd"), F.col("st") + 1).alias("nd"), "class", F.bround(F.col("weight") / unit, 2).alias("n"))
