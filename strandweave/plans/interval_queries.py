"""Interval, depth and sweep queries over the driver's tables.

Suppliers play chromosomes and days since 1995 play positions: a line item is an interval of l_quantity days from its
ship date, an order a position of its customer, and two fixed intervals per supplier play an annotation track.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandweave.functions import intervals as I
from strandweave.functions import strands as S
from strandweave.operators import aggregates as A
from strandweave.operators import ordered as O
from strandweave.operators import range_join as R
from strandweave.runtime import table

_DAY = "date_diff('day', DATE '1995-01-01', CAST({} AS DATE))"
SQL_IV = (
    "iv AS (SELECT l_suppkey AS chr, l_orderkey AS okey, l_linenumber AS line, l_extendedprice AS depth, "
    + _DAY.format("l_shipdate") + " AS st, " + _DAY.format("l_shipdate") + " + CAST(l_quantity AS BIGINT) AS nd FROM lineitem)"
)
SQL_BED = (
    "bed AS (SELECT s_suppkey AS chr, k AS ord, CASE WHEN k = 0 THEN 'f' ELSE 'b' END AS label, (s_suppkey * 37 + s_nationkey * 11) % 1500 + k * 700 AS r_st, "
    "(s_suppkey * 37 + s_nationkey * 11) % 1500 + k * 700 + 60 AS r_nd FROM supplier, (VALUES (0), (1)) t(k))"
)


def days(column: str):
    return F.datediff(F.to_date(column), F.lit("1995-01-01").cast("date")).cast("long")


def intervals(spark: SparkSession, d: str) -> DataFrame:
    l = table(spark, d, "lineitem")
    return l.select(
        F.col("l_suppkey").alias("chr"), F.col("l_orderkey").alias("okey"), F.col("l_linenumber").alias("line"), F.col("l_extendedprice").alias("depth"),
        days("l_shipdate").alias("st"), (days("l_shipdate") + F.col("l_quantity").cast("long")).alias("nd"),
    )


def track(spark: SparkSession, d: str) -> DataFrame:
    s = table(spark, d, "supplier")
    base = (F.col("s_suppkey") * 37 + F.col("s_nationkey") * 11) % 1500
    t = s.select(F.col("s_suppkey").alias("chr"), base.alias("base"), F.explode(F.array(F.lit(0), F.lit(1))).alias("ord"))
    st = F.col("base") + F.col("ord") * 700
    return t.select("chr", "ord", F.when(F.col("ord") == 0, "f").otherwise("b").alias("label"), st.alias("r_st"), (st + 60).alias("r_nd"))


def depth_normalise(spark, d):
    """Price over the median of its return flag and line status, where that flag is R; others over 1."""
    l = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_returnflag", "l_linestatus", "l_extendedprice")
    ref = l.where("l_returnflag = 'R'").groupBy("l_returnflag", "l_linestatus").agg(F.median("l_extendedprice").alias("mid"))
    out = A.normalise(l, ref, ["l_returnflag", "l_linestatus"], "l_extendedprice", "mid")
    return out.groupBy("l_returnflag", "l_linestatus").agg(F.count("*").alias("n"), F.round(F.sum("normalised"), 3).alias("total"), F.round(F.max("normalised"), 6).alias("top"))


SQL_depth_normalise = """
WITH ref AS (SELECT l_returnflag, l_linestatus, median(l_extendedprice) AS mid FROM lineitem WHERE l_returnflag = 'R' GROUP BY ALL)
SELECT l.l_returnflag, l.l_linestatus, count(*) AS n, round(sum(l_extendedprice / coalesce(mid, 1.0)), 3) AS total, round(max(l_extendedprice / coalesce(mid, 1.0)), 6) AS top
FROM lineitem l LEFT JOIN ref ON l.l_returnflag = ref.l_returnflag AND l.l_linestatus = ref.l_linestatus GROUP BY ALL"""


def depth_summary(spark, d):
    """G1: exact median, mean, population deviation and unit of order totals."""
    got = A.depth_summary(table(spark, d, "orders"), "o_totalprice")
    return got.select(*[F.round(c, 4).alias(c) for c in got.columns])


SQL_depth_summary = """SELECT round(median(o_totalprice), 4) AS median, round(avg(o_totalprice), 4) AS mean, round(stddev_pop(o_totalprice), 4) AS std,
round(median(o_totalprice) / 2, 4) AS unit FROM orders"""


def window_layout(spark, d):
    """Rows over 2 medians, or contained in a track interval, fail; clean rows come first, each in input order."""
    from strandweave.operators.contigs import clean_failed_layout

    iv = intervals(spark, d).withColumn("row_id", F.col("okey") * 1000 + F.col("line") * 100 + F.col("st") % 100)
    got = clean_failed_layout(iv, track(spark, d), ["chr"], "depth", factor=2.0, width=64)
    return got.groupBy("is_failed").agg(F.count("*").alias("n"), F.round(F.sum("depth"), 2).alias("total"), F.min("row_id").alias("first_row"), F.max("row_id").alias("last_row"))


SQL_window_layout = f"""WITH {SQL_IV}, {SQL_BED}, m AS (SELECT median(depth) AS mid FROM iv),
f AS (SELECT iv.*, okey * 1000 + line * 100 + st % 100 AS row_id, depth > 2 * mid OR EXISTS (SELECT 1 FROM bed WHERE bed.chr = iv.chr AND r_st <= st AND nd <= r_nd) AS is_failed FROM iv, m)
SELECT is_failed, count(*) AS n, round(sum(depth), 2) AS total, min(row_id) AS first_row, max(row_id) AS last_row FROM f GROUP BY is_failed"""


def interval_overlap_join(spark, d):
    """Overlaps of line items with the track, half-open, with what they share."""
    hit = R.range_join(intervals(spark, d), track(spark, d), ["chr"], "half_open", 64)
    share = I.overlap_length(F.col("st"), F.col("nd"), F.col("r_st"), F.col("r_nd"))
    return hit.groupBy("chr", "ord").agg(F.count("*").alias("n"), F.sum(share).alias("shared"), F.min("st").alias("first_st"))


SQL_interval_overlap_join = f"""WITH {SQL_IV}, {SQL_BED} SELECT iv.chr, ord, count(*) AS n, CAST(sum(least(nd, r_nd) - greatest(st, r_st)) AS BIGINT) AS shared, min(st) AS first_st
FROM iv JOIN bed ON iv.chr = bed.chr AND st < r_nd AND r_st < nd GROUP BY ALL"""


def interval_semi_closed(spark, d):
    """Line items that share a day with the track, touching ends included, and those that don't."""
    iv, bed = intervals(spark, d), track(spark, d)
    hit = R.range_join(iv, bed, ["chr"], "closed", 64, how="left_semi").groupBy("chr").agg(F.count("*").alias("n_hit"))
    miss = R.range_join(iv, bed, ["chr"], "closed", 64, how="left_anti").groupBy("chr").agg(F.count("*").alias("n_miss"))
    return miss.join(hit, "chr", "full").select("chr", F.coalesce("n_hit", F.lit(0)).alias("n_hit"), F.coalesce("n_miss", F.lit(0)).alias("n_miss"))


SQL_interval_semi_closed = f"""WITH {SQL_IV}, {SQL_BED}, h AS (SELECT iv.*, EXISTS (SELECT 1 FROM bed WHERE bed.chr = iv.chr AND NOT (nd < r_st OR st > r_nd)) AS hit FROM iv)
SELECT chr, count(*) FILTER (hit) AS n_hit, count(*) FILTER (NOT hit) AS n_miss FROM h GROUP BY chr"""


def strict_spanning(spark, d):
    """Line items that reach beyond a track interval at both ends, and those strictly inside one."""
    bed = track(spark, d).withColumn("r_nd", F.col("r_st") + 25)
    span = R.range_join(intervals(spark, d), bed, ["chr"], "strictly_spans", 64).groupBy("chr").agg(F.count("*").alias("n_spanning"))
    inside = R.range_join(intervals(spark, d), track(spark, d), ["chr"], "strictly_inside", 64).groupBy("chr").agg(F.count("*").alias("n_inside"))
    return span.join(inside, "chr", "full").na.fill(0)


SQL_strict_spanning = f"""WITH {SQL_IV}, {SQL_BED}, a AS (SELECT iv.chr, count(*) AS n_spanning FROM iv JOIN bed ON iv.chr = bed.chr AND st < r_st AND nd > r_st + 25 GROUP BY 1),
b AS (SELECT iv.chr, count(*) AS n_inside FROM iv JOIN bed ON iv.chr = bed.chr AND r_st < st AND nd < r_nd GROUP BY 1)
SELECT coalesce(a.chr, b.chr) AS chr, coalesce(n_spanning, 0) AS n_spanning, coalesce(n_inside, 0) AS n_inside FROM a FULL JOIN b ON a.chr = b.chr"""


def interval_contain_label(spark, d):
    """The first track interval that overlaps, f or b, with `in` where it contains the line item."""
    iv = intervals(spark, d).withColumn("id", F.xxhash64("okey", "line", "chr", "st", "nd", "depth")).dropDuplicates(["id"])
    got = R.first_label(iv, track(spark, d), ["chr"], "id", 64)
    return got.groupBy("chr", F.coalesce("label", F.lit("0")).alias("label")).agg(F.count("*").alias("n"), F.sum("st").alias("sum_st"))


SQL_interval_contain_label = f"""WITH {SQL_IV}, {SQL_BED}, u AS (SELECT DISTINCT chr, okey, line, depth, st, nd FROM iv),
j AS (SELECT u.*, label, ord, r_st <= st AND nd <= r_nd AS inside, row_number() OVER (PARTITION BY u.chr, okey, line, depth, st, nd ORDER BY ord) AS k
FROM u LEFT JOIN bed ON u.chr = bed.chr AND st < r_nd AND r_st < nd)
SELECT chr, coalesce(label || CASE WHEN inside THEN 'in' ELSE '' END, '0') AS label, count(*) AS n, CAST(sum(st) AS BIGINT) AS sum_st FROM j WHERE k = 1 GROUP BY ALL"""


def next_repeat_label(spark, d):
    """Only the first track interval whose end reaches the start is looked at: r, or rin where it contains."""
    iv = intervals(spark, d).withColumn("id", F.xxhash64("okey", "line", "chr", "st", "nd", "depth")).dropDuplicates(["id"])
    got = R.next_interval_label(iv, track(spark, d).select("chr", "r_st", "r_nd"), "chr", "id")
    return got.groupBy("chr", F.coalesce("label", F.lit("0")).alias("label")).agg(F.count("*").alias("n"))


SQL_next_repeat_label = f"""WITH {SQL_IV}, {SQL_BED}, u AS (SELECT DISTINCT chr, okey, line, depth, st, nd FROM iv),
j AS (SELECT u.*, r_st, r_nd, row_number() OVER (PARTITION BY u.chr, okey, line, depth, st, nd ORDER BY r_nd, r_st) AS k FROM u LEFT JOIN bed ON u.chr = bed.chr AND r_nd >= st)
SELECT chr, CASE WHEN r_st IS NULL OR (nd < r_st OR r_nd < st) THEN '0' WHEN r_st <= st AND nd <= r_nd THEN 'rin' ELSE 'r' END AS label, count(*) AS n FROM j WHERE k = 1 GROUP BY ALL"""


def interval_merge(spark, d):
    """Union of the line items of each supplier, touching ones joined, with the covered length."""
    m = O.merge_intervals(intervals(spark, d), ["chr"])
    return m.groupBy("chr").agg(F.count("*").alias("n_islands"), F.sum(F.col("nd") - F.col("st")).alias("covered"), F.sum("n_parts").alias("n_parts"), F.max(F.col("nd") - F.col("st")).alias("longest"))


def _islands(gap: int) -> str:
    return f"""a AS (SELECT *, max(nd) OVER (PARTITION BY chr ORDER BY st, nd ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM iv),
b AS (SELECT *, sum(CASE WHEN st <= reach + {gap} THEN 0 ELSE 1 END) OVER (PARTITION BY chr ORDER BY st, nd ROWS UNBOUNDED PRECEDING) AS island FROM a),
m AS (SELECT chr, island, min(st) AS st, max(nd) AS nd, count(*) AS n_parts FROM b GROUP BY chr, island)"""


SQL_interval_merge = f"""WITH {SQL_IV}, {_islands(0)} SELECT chr, count(*) AS n_islands, CAST(sum(nd - st) AS BIGINT) AS covered, CAST(sum(n_parts) AS BIGINT) AS n_parts, max(nd - st) AS longest FROM m GROUP BY chr"""


def interval_merge_gap(spark, d):
    """G7 with a gap: intervals of a customer's orders (5 days each) at most 30 days apart are fetched together."""
    o = table(spark, d, "orders").select(F.col("o_custkey").alias("chr"), days("o_orderdate").alias("st"), (days("o_orderdate") + 5).alias("nd"))
    return O.merge_intervals(o, ["chr"], 30).select("chr", "st", "nd", "n_parts")


SQL_interval_merge_gap = f"""WITH iv AS (SELECT o_custkey AS chr, {_DAY.format('o_orderdate')} AS st, {_DAY.format('o_orderdate')} + 5 AS nd FROM orders), {_islands(30)} SELECT chr, st, nd, n_parts FROM m"""


def max_overlap_sweep(spark, d):
    """Most line items of a supplier that are open at once; ends come before starts."""
    return O.max_overlap(intervals(spark, d), ["chr"])


SQL_max_overlap_sweep = f"""WITH {SQL_IV}, e AS (SELECT chr, st AS pos, 1 AS delta FROM iv UNION ALL SELECT chr, nd, -1 FROM iv),
s AS (SELECT chr, sum(delta) OVER (PARTITION BY chr ORDER BY pos, delta ROWS UNBOUNDED PRECEDING) AS depth FROM e) SELECT chr, CAST(greatest(max(depth), 0) AS BIGINT) AS max_overlap FROM s GROUP BY chr"""


def max_overlap_in_targets(spark, d):
    """G8 with targets: most line items that overlap inside a track interval."""
    bed = track(spark, d).select("chr", F.col("r_st").alias("st"), F.col("r_nd").alias("nd"))
    return O.overlap_with_targets(intervals(spark, d), bed, ["chr"])


SQL_max_overlap_in_targets = f"""WITH {SQL_IV}, {SQL_BED}, n AS (SELECT chr, 2 * count(*) AS inf FROM iv GROUP BY chr),
e AS (SELECT chr, st AS pos, 1 AS delta FROM iv UNION ALL SELECT chr, nd, -1 FROM iv UNION ALL SELECT bed.chr, r_st, inf FROM bed JOIN n ON bed.chr = n.chr UNION ALL SELECT bed.chr, r_nd, -inf FROM bed JOIN n ON bed.chr = n.chr),
s AS (SELECT chr, sum(delta) OVER (PARTITION BY chr ORDER BY pos, delta ROWS UNBOUNDED PRECEDING) AS depth FROM e)
SELECT s.chr, CAST(greatest(max(depth), 0) - max(CASE WHEN EXISTS (SELECT 1 FROM bed WHERE bed.chr = s.chr) THEN inf ELSE 0 END) AS BIGINT) AS max_overlap FROM s JOIN n ON s.chr = n.chr GROUP BY s.chr"""


def weighted_mean_flank(spark, d):
    """Mean price of the line items around each track interval (30 days to both sides), weighted by overlap."""
    pts = track(spark, d).select("chr", (F.col("chr") * 2 + F.col("ord")).alias("pid"), (F.col("r_st") - 30).alias("st"), (F.col("r_nd") + 30).alias("nd"))
    win = intervals(spark, d).select("chr", F.col("st").alias("r_st"), F.col("nd").alias("r_nd"), "depth")
    got = O.weighted_depth(pts, win, ["chr"], "pid", 64, "depth")
    return got.select("pid", "chr", F.round("mean_depth", 4).alias("mean_depth"), "n_windows")


SQL_weighted_mean_flank = f"""WITH {SQL_IV}, {SQL_BED}, p AS (SELECT chr, chr * 2 + ord AS pid, r_st - 30 AS ps, r_nd + 30 AS pn FROM bed)
SELECT pid, p.chr, round(sum(depth * (least(nd, pn) - greatest(st, ps))) / sum(CASE WHEN iv.chr IS NOT NULL THEN least(nd, pn) - greatest(st, ps) END), 4) AS mean_depth, nullif(count(iv.chr), 0) AS n_windows
FROM p LEFT JOIN iv ON p.chr = iv.chr AND ps < nd AND st < pn GROUP BY pid, p.chr"""


def weighted_mean_closed(spark, d):
    """G5, closed: both ends count towards the overlap."""
    pts = track(spark, d).select("chr", (F.col("chr") * 2 + F.col("ord")).alias("pid"), F.col("r_st").alias("st"), F.col("r_nd").alias("nd"))
    win = intervals(spark, d).select("chr", F.col("st").alias("r_st"), F.col("nd").alias("r_nd"), "depth")
    got = O.weighted_depth(pts, win, ["chr"], "pid", 64, "depth", how="closed")
    return got.select("pid", F.round("mean_depth", 4).alias("mean_depth"), "n_windows")


SQL_weighted_mean_closed = f"""WITH {SQL_IV}, {SQL_BED}, p AS (SELECT chr, chr * 2 + ord AS pid, r_st AS ps, r_nd AS pn FROM bed)
SELECT pid, round(sum(depth * (least(nd, pn) - greatest(st, ps) + 1)) / sum(CASE WHEN iv.chr IS NOT NULL THEN least(nd, pn) - greatest(st, ps) + 1 END), 4) AS mean_depth, nullif(count(iv.chr), 0) AS n_windows
FROM p LEFT JOIN iv ON p.chr = iv.chr AND ps <= nd AND st <= pn GROUP BY pid"""


def flank_step(spark, d):
    """Mean order total of a customer's nation in the 90 days before and from each track start."""
    pts = track(spark, d).select((F.col("chr") * 2 + F.col("ord")).alias("pid"), (F.col("chr") % 25).cast("int").alias("chr"), F.col("r_st").alias("pos"))
    o = table(spark, d, "orders").join(table(spark, d, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    bins = o.select(F.col("c_nationkey").alias("chr"), days("o_orderdate").alias("bin"), "o_totalprice")
    got = O.flank_means(pts, bins, ["chr"], "pid", "pos", "bin", "o_totalprice", 90)
    return got.select("pid", F.round("left_mean", 4).alias("left_mean"), F.round("right_mean", 4).alias("right_mean"), F.round(F.col("right_mean") - F.col("left_mean"), 4).alias("step"))


SQL_flank_step = f"""WITH {SQL_BED}, p AS (SELECT chr * 2 + ord AS pid, chr % 25 AS c, r_st AS pos FROM bed),
b AS (SELECT c_nationkey AS c, {_DAY.format('o_orderdate')} AS bin, o_totalprice AS v FROM orders JOIN customer ON o_custkey = c_custkey)
SELECT pid, round(avg(v) FILTER (bin < pos), 4) AS left_mean, round(avg(v) FILTER (bin >= pos), 4) AS right_mean, round(avg(v) FILTER (bin >= pos) - avg(v) FILTER (bin < pos), 4) AS step
FROM p LEFT JOIN b ON p.c = b.c AND bin >= pos - 90 AND bin < pos + 90 GROUP BY pid"""


def rebin_n(spark, d):
    """Four consecutive orders of a customer as one bin: first and last day, sum over sum."""
    o = table(spark, d, "orders").select("o_custkey", "o_orderkey", days("o_orderdate").alias("st"), (days("o_orderdate") + 1).alias("nd"), "o_totalprice", F.lit(1.0).alias("one"))
    got = O.rebin(o, ["o_custkey"], ["st", "o_orderkey"], 4, "o_totalprice", "one")
    return got.select("o_custkey", "bin", "st", "nd", F.round("depth", 4).alias("depth"), "n_rows")


SQL_rebin_n = f"""WITH o AS (SELECT o_custkey, {_DAY.format('o_orderdate')} AS st, o_totalprice, (row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) - 1) // 4 AS bin FROM orders)
SELECT o_custkey, bin, min(st) AS st, max(st) + 1 AS nd, round(sum(o_totalprice) / count(*), 4) AS depth, count(*) AS n_rows FROM o GROUP BY o_custkey, bin"""


def rebin_broadcast_back(spark, d):
    """Each order with the depth of its bin of four."""
    o = table(spark, d, "orders").select("o_custkey", "o_orderkey", days("o_orderdate").alias("st"), "o_totalprice", F.lit(1.0).alias("one"))
    got = O.rebin_back(o, ["o_custkey"], ["st", "o_orderkey"], 4, "o_totalprice", "one")
    return got.select("o_orderkey", "bin", F.round("depth", 4).alias("depth"))


SQL_rebin_broadcast_back = """WITH o AS (SELECT *, (row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) - 1) // 4 AS bin FROM orders)
SELECT o_orderkey, bin, round(avg(o_totalprice) OVER (PARTITION BY o_custkey, bin), 4) AS depth FROM o"""


def align_depth_vector(spark, d):
    """Order counts per day and status on the full calendar of order days, 0 where there are none."""
    o = table(spark, d, "orders").withColumn("day", days("o_orderdate"))
    windows = o.select("day").distinct().crossJoin(o.select("o_orderstatus").distinct())  # days x 3 statuses
    vec = o.groupBy("day", "o_orderstatus").agg(F.round(F.sum("o_totalprice"), 2).alias("v"))
    return A.align_vector(windows, vec, ["day", "o_orderstatus"], "v")


SQL_align_depth_vector = f"""WITH o AS (SELECT *, {_DAY.format('o_orderdate')} AS day FROM orders), w AS (SELECT * FROM (SELECT DISTINCT day FROM o), (SELECT DISTINCT o_orderstatus FROM o)),
v AS (SELECT day, o_orderstatus, round(sum(o_totalprice), 2) AS v FROM o GROUP BY ALL) SELECT w.day, w.o_orderstatus, coalesce(v, 0.0) AS v FROM w LEFT JOIN v ON w.day = v.day AND w.o_orderstatus = v.o_orderstatus"""


def absence_test(spark, d):
    """Share of a nation's suppliers' line items outside the track with a high price; under 0.7 is absent."""
    iv = R.range_join(intervals(spark, d), track(spark, d), ["chr"], "closed", 64, how="left_anti")
    got = iv.groupBy((F.col("chr") % 25).alias("grp")).agg(F.avg(F.when(F.col("depth") > 30000, 1.0).otherwise(0.0)).alias("share"))
    return got.select("grp", F.round("share", 6).alias("share"), (F.round("share", 6) < 0.7).alias("absent"))


SQL_absence_test = f"""WITH {SQL_IV}, {SQL_BED}, k AS (SELECT * FROM iv WHERE NOT EXISTS (SELECT 1 FROM bed WHERE bed.chr = iv.chr AND NOT (nd < r_st OR st > r_nd)))
SELECT chr % 25 AS grp, round(avg(CASE WHEN depth > 30000 THEN 1.0 ELSE 0.0 END), 6) AS share, round(avg(CASE WHEN depth > 30000 THEN 1.0 ELSE 0.0 END), 6) < 0.7 AS absent FROM k GROUP BY 1"""


def interval_arithmetic(spark, d):
    """distance, shared length and 1-based clamped form of line items against their first track interval."""
    iv = intervals(spark, d).join(track(spark, d).where("ord = 0"), "chr")
    a = (F.col("st"), F.col("nd"), F.col("r_st"), F.col("r_nd"))
    lo, hi = I.to_one_based(F.col("st"), F.col("nd"), F.lit(2000))
    g = iv.select("chr", I.distance(*a).alias("dist"), I.overlap_length(*a).alias("shared"), I.end_gap(*a).alias("gap"), lo.alias("lo"), hi.alias("hi"))
    return g.groupBy("chr").agg(*[F.sum(c).alias(c) for c in ("dist", "shared", "gap", "lo", "hi")])


SQL_interval_arithmetic = f"""WITH {SQL_IV}, {SQL_BED}, j AS (SELECT iv.*, r_st, r_nd FROM iv JOIN bed ON iv.chr = bed.chr WHERE ord = 0),
k AS (SELECT chr, CASE WHEN greatest(st, r_st) < least(nd, r_nd) THEN 0 ELSE least(abs(r_st - nd), abs(r_nd - st)) END AS dist, greatest(0, least(nd, r_nd) - greatest(st, r_st)) AS shared,
least(abs(r_st - nd), abs(r_nd - st)) AS gap, least(greatest(st + 1, 1), 2000) AS lo, greatest(least(greatest(st + 1, 1), 2000), least(greatest(nd, 1), 2000)) AS hi FROM j)
SELECT chr, CAST(sum(dist) AS BIGINT) AS dist, CAST(sum(shared) AS BIGINT) AS shared, CAST(sum(gap) AS BIGINT) AS gap, CAST(sum(lo) AS BIGINT) AS lo, CAST(sum(hi) AS BIGINT) AS hi FROM k GROUP BY chr"""


def chromosome_order(spark, d):
    """T5: natural order of chromosome names made of nation keys."""
    n = table(spark, d, "nation").select(F.when(F.col("n_nationkey") == 23, "chrX").when(F.col("n_nationkey") == 24, "chrY").otherwise(F.concat(F.lit("chr"), F.col("n_nationkey") + 1)).alias("chr"))
    return n.select("chr", S.chromosome_rank(F.col("chr")).alias("rank"), S.chromosome_rank(F.col("chr"), 23, 24, 25).alias("rank_m"))


SQL_chromosome_order = """WITH n AS (SELECT CASE WHEN n_nationkey = 23 THEN 'chrX' WHEN n_nationkey = 24 THEN 'chrY' ELSE 'chr' || (n_nationkey + 1) END AS chr FROM nation)
SELECT chr, CASE chr WHEN 'chrX' THEN 24 WHEN 'chrY' THEN 25 ELSE CAST(substr(chr, 4) AS INT) END AS rank, CASE chr WHEN 'chrX' THEN 23 WHEN 'chrY' THEN 24 ELSE CAST(substr(chr, 4) AS INT) END AS rank_m FROM n"""


def block_coverage(spark, d):
    """Mean coverage of 100-day windows by line items: overlap spread over windows, over the window's length."""
    from strandweave.operators.matrix import window_coverage

    got = window_coverage(intervals(spark, d), ["chr"], 100)
    return got.select("chr", "bin", F.round("coverage", 6).alias("coverage"))


SQL_block_coverage = f"""WITH {SQL_IV}, x AS (SELECT chr, unnest(generate_series(st // 100, (nd - 1) // 100)) AS bin, st, nd FROM iv WHERE nd > st)
SELECT chr, bin, round(sum(least(nd, bin * 100 + 100) - greatest(st, bin * 100)) / 100.0, 6) AS coverage FROM x GROUP BY chr, bin"""


_NAMES = [n for n in list(globals()) if n.startswith("SQL_") and n not in ("SQL_IV", "SQL_BED")]
ORACLE = {n[4:]: globals()[n] for n in _NAMES}
QUERIES = {n: globals()[n] for n in ORACLE}
