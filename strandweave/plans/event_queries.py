"""Event, sequence, text-format and graph queries over the driver's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandweave.functions import cs as C
from strandweave.functions import strands as S
from strandweave.functions import values as X
from strandweave.functions import vcf_text as V
from strandweave.operators import aggregates as A
from strandweave.operators import events as E
from strandweave.operators import graph as G
from strandweave.operators import matrix as M
from strandweave.operators import ordered as O
from strandweave.operators import range_join as R
from strandweave.operators import stats as Q
from strandweave.plans.interval_queries import days
from strandweave.runtime import table


def events(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").withColumn("sec", F.unix_seconds(F.col("ts").cast("timestamp")))


SQL_EV = "ev AS (SELECT *, CAST(floor(epoch(ts)) AS BIGINT) AS sec FROM events)"


def pair_tolerance_join(spark, d):
    """A user's events of two different types within two hours, each pair once, the smaller id first."""
    e = events(spark, d).select("event_id", "user_id", "event_type", "sec")
    p = R.tolerance_pairs(e, ["user_id"], "event_id", ["sec"], 7200, F.col("a_event_type") != F.col("b_event_type"))
    return p.select("a_event_id", "b_event_id", F.abs(F.col("a_sec") - F.col("b_sec")).alias("apart"))


SQL_pair_tolerance_join = f"""WITH {SQL_EV} SELECT a.event_id AS a_event_id, b.event_id AS b_event_id, abs(a.sec - b.sec) AS apart FROM ev a JOIN ev b
ON a.user_id = b.user_id AND a.event_id < b.event_id AND a.event_type <> b.event_type AND abs(a.sec - b.sec) <= 7200"""


def nearest_join(spark, d):
    """For each purchase the nearest view of the same user within a day: by distance, then id."""
    e = events(spark, d)
    left = e.where("event_type = 'purchase'").select("user_id", F.col("event_id").alias("pid"), F.col("sec").alias("p_sec"))
    right = e.where("event_type = 'view'").select("user_id", F.col("event_id").alias("vid"), F.col("sec").alias("v_sec"))
    got = R.nearest(left, right, ["user_id"], "pid", F.abs(F.col("p_sec") - F.col("v_sec")), ["vid"], ("p_sec", "v_sec", 86400))
    return got.select("pid", "vid", "distance")


SQL_nearest_join = f"""WITH {SQL_EV}, j AS (SELECT p.event_id AS pid, v.event_id AS vid, abs(p.sec - v.sec) AS distance FROM ev p JOIN ev v ON p.user_id = v.user_id AND p.event_type = 'purchase' AND v.event_type = 'view' AND abs(p.sec - v.sec) <= 86400)
SELECT pid, vid, distance FROM (SELECT *, row_number() OVER (PARTITION BY pid ORDER BY distance, vid) AS k FROM j) WHERE k = 1"""


def next_event_asof(spark, d):
    """As-of: each order with its customer's next order on or after 30 days later (by day, then key)."""
    o = table(spark, d, "orders").select("o_orderkey", "o_custkey", days("o_orderdate").alias("day"))
    left = o.select("o_custkey", "o_orderkey", (F.col("day") + 30).alias("due"))
    right = o.select("o_custkey", F.col("day").alias("r_day"), F.col("o_orderkey").alias("next_key"))
    return R.next_at_or_after(left, right, ["o_custkey"], "due", "r_day", ["next_key"]).select("o_orderkey", "next_key")


SQL_next_event_asof = """WITH o AS (SELECT o_orderkey, o_custkey, date_diff('day', DATE '1995-01-01', CAST(o_orderdate AS DATE)) AS day FROM orders)
SELECT o_orderkey, next_key FROM (SELECT a.o_orderkey, b.o_orderkey AS next_key, row_number() OVER (PARTITION BY a.o_orderkey ORDER BY b.day, b.o_orderkey) AS k
FROM o a LEFT JOIN o b ON a.o_custkey = b.o_custkey AND b.day >= a.day + 30) WHERE k = 1"""


def anchor_pair_support(spark, d):
    """Users (reads) that cover both anchors of a key in an agreeing orientation and order, on events as alignments."""
    e = events(spark, d)
    strand = F.when(F.col("event_id") % 2 == 0, "+").otherwise("-")
    aln = e.select(F.col("user_id").alias("read"), F.lit(0).alias("flag"), F.col("event_type").alias("chr"), F.floor(F.col("sec") % 1000).alias("st"), (F.floor(F.col("sec") % 1000) + 40).alias("nd"), strand.alias("strand"), (F.col("event_id") % 97).alias("qst"))
    anchors = spark.createDataFrame([(p, 1, a, t, pos, w) for p, (t1, x, t2, y) in enumerate([("view", 100, "click", 300), ("click", 500, "purchase", 120), ("error", 700, "signup", 900)]) for a, t, pos, w in ((1, t1, x, "+"), (2, t2, y, "+"))], "pair int, count int, anchor int, chr string, pos long, strand string")
    return E.anchor_support(aln, anchors, 64)


SQL_anchor_pair_support = f"""WITH {SQL_EV}, aln AS (SELECT user_id AS read, event_type AS chr, sec % 1000 AS st, sec % 1000 + 40 AS nd, CASE WHEN event_id % 2 = 0 THEN '+' ELSE '-' END AS strand, event_id % 97 AS qst FROM ev),
anc(pair, count, anchor, chr, pos) AS (VALUES (0, 1, 1, 'view', 100), (0, 1, 2, 'click', 300), (1, 1, 1, 'click', 500), (1, 1, 2, 'purchase', 120), (2, 1, 1, 'error', 700), (2, 1, 2, 'signup', 900)),
h AS (SELECT read, pair, count, anchor, strand, CASE WHEN strand = '+' THEN qst + pos - st ELSE qst + nd - 1 - pos END AS q FROM aln JOIN anc ON aln.chr = anc.chr AND st <= pos AND pos < nd)
SELECT a.pair, a.count, count(DISTINCT a.read) AS n_reads FROM h a JOIN h b ON a.read = b.read AND a.pair = b.pair AND a.count = b.count AND a.anchor = 1 AND b.anchor = 2 AND a.strand = b.strand
AND ((a.strand = '+' AND a.q <= b.q) OR (a.strand = '-' AND b.q <= a.q)) GROUP BY a.pair, a.count"""


def mate_resolution(spark, d):
    """Turns of conversations as breakend records: even turns name the next one, others match by reciprocal position."""
    c = table(spark, d, "conversations").select("conv_id", "turn").distinct()
    other = F.when(F.col("turn") % 2 == 0, F.col("turn") + 1).otherwise(F.col("turn") - 1)
    line = F.col("conv_id") * 1000 + F.col("turn")
    r = c.select(
        line.alias("line"), F.concat(F.lit("c"), "conv_id", F.lit("_"), "turn").alias("id"), F.col("conv_id").cast("string").alias("chr"), F.col("turn").alias("pos"),
        F.when((F.col("conv_id") % 3 == 0) & (F.col("turn") % 2 == 0), F.concat(F.lit("c"), "conv_id", F.lit("_"), F.col("turn") + 1)).alias("mate_id"),
        F.col("conv_id").cast("string").alias("mate_chr"), other.alias("mate_pos"),
    )
    return E.resolve_mates(r)


SQL_mate_resolution = """WITH c AS (SELECT DISTINCT conv_id, turn FROM conversations)
SELECT a.conv_id * 1000 + a.turn AS first, b.conv_id * 1000 + b.turn AS second FROM c a JOIN c b ON a.conv_id = b.conv_id AND a.turn % 2 = 0 AND b.turn = a.turn + 1"""


def gaps_chain_groups(spark, d):
    """Sessions of users' events by gaps of more than four hours, and of four hours or more."""
    e = events(spark, d).select("event_id", "user_id", (F.col("sec") - F.col("sec") % 1200).alias("slot"))
    a = O.chains(e, ["user_id"], "slot", 14400, True, "chain_le")
    b = O.chains(a, ["user_id"], "slot", 14400, False, "chain_lt")
    return b.groupBy("user_id").agg((F.max("chain_le") + 1).alias("n_le"), (F.max("chain_lt") + 1).alias("n_lt"), F.sum("chain_le").alias("sum_le"))


SQL_gaps_chain_groups = f"""WITH {SQL_EV}, s AS (SELECT event_id, user_id, sec - sec % 1200 AS slot FROM ev), g AS (SELECT *, slot - lag(slot) OVER (PARTITION BY user_id ORDER BY slot) AS step FROM s),
c AS (SELECT *, sum(CASE WHEN step > 14400 THEN 1 ELSE 0 END) OVER w AS le, sum(CASE WHEN step >= 14400 THEN 1 ELSE 0 END) OVER w AS lt FROM g WINDOW w AS (PARTITION BY user_id ORDER BY slot RANGE UNBOUNDED PRECEDING))
SELECT user_id, CAST(max(le) + 1 AS BIGINT) AS n_le, CAST(max(lt) + 1 AS BIGINT) AS n_lt, CAST(sum(le) AS BIGINT) AS sum_le FROM c GROUP BY user_id"""


def contiguous_runs(spark, d):
    """Runs of consecutive order days of each status."""
    o = table(spark, d, "orders").select("o_orderstatus", days("o_orderdate").alias("day")).distinct()
    r = O.contiguous_runs(o, ["o_orderstatus"], "day", 1)
    return r.groupBy("o_orderstatus", "run").agg(F.min("day").alias("st"), F.max("day").alias("nd"), F.count("*").alias("n"))


SQL_contiguous_runs = """WITH o AS (SELECT DISTINCT o_orderstatus, date_diff('day', DATE '1995-01-01', CAST(o_orderdate AS DATE)) AS day FROM orders),
r AS (SELECT *, day - row_number() OVER (PARTITION BY o_orderstatus ORDER BY day) AS g FROM o), k AS (SELECT o_orderstatus, g, min(day) AS st, max(day) AS nd, count(*) AS n FROM r GROUP BY ALL)
SELECT o_orderstatus, row_number() OVER (PARTITION BY o_orderstatus ORDER BY st) - 1 AS run, st, nd, n FROM k"""


def state_rle_merge(spark, d):
    """Runs of equal event types of a user in order of time, with summed values."""
    r = O.state_runs(events(spark, d), ["user_id"], ["ts", "event_id"], ["event_type"], "value")
    return r.select("user_id", "run", "event_type", "n_rows", F.round("total", 4).alias("total"))


SQL_state_rle_merge = """WITH a AS (SELECT *, CASE WHEN lag(event_type) OVER w IS NULL OR lag(event_type) OVER w = event_type THEN 0 ELSE 1 END AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
b AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS run FROM a)
SELECT user_id, CAST(run AS BIGINT) AS run, any_value(event_type) AS event_type, count(*) AS n_rows, round(sum(value), 4) AS total FROM b GROUP BY user_id, run"""


def neighbour_states(spark, d):
    """Changes of type between a user's neighbouring events, and the nearest different type before."""
    e = O.neighbour_changes(events(spark, d), ["user_id"], ["ts", "event_id"], ["event_type"])
    e = O.nearest_different(e, ["user_id"], ["ts", "event_id"], "event_type")
    return e.groupBy("event_type", "prev_event_type", "changed", "prev_different").agg(F.count("*").alias("n"))


SQL_neighbour_states = """WITH a AS (SELECT *, lag(event_type) OVER w AS prev_event_type, row_number() OVER w AS k FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
b AS (SELECT a.*, CASE WHEN prev_event_type IS DISTINCT FROM event_type THEN k END AS brk FROM a), c AS (SELECT *, max(brk) OVER (PARTITION BY user_id ORDER BY k ROWS UNBOUNDED PRECEDING) AS start FROM b)
SELECT c.event_type, c.prev_event_type, c.k > 1 AND c.prev_event_type <> c.event_type AS changed, p.event_type AS prev_different, count(*) AS n
FROM c LEFT JOIN c p ON p.user_id = c.user_id AND p.k = c.start - 1 GROUP BY ALL"""


def cumulative_peak(spark, d):
    """Largest absolute running deviation of a user's values from their mean, and the event where it is reached first."""
    e = events(spark, d)
    mean = e.groupBy("user_id").agg(F.round(F.avg("value"), 6).alias("m"))
    e = e.join(mean, "user_id").withColumn("dev", F.col("value") - F.col("m"))
    p = O.cumulative_peak(e, ["user_id"], ["event_id"], "dev", 4)
    return p.select("user_id", "peak", "peak_event_id")


SQL_cumulative_peak = """WITH m AS (SELECT user_id, round(avg(value), 6) AS m FROM events GROUP BY user_id), r AS (SELECT e.user_id, event_id, round(abs(sum(value - m) OVER (PARTITION BY e.user_id ORDER BY event_id ROWS UNBOUNDED PRECEDING)), 4) AS mag FROM events e JOIN m ON e.user_id = m.user_id)
SELECT user_id, max(mag) AS peak, arg_max(event_id, (mag, -event_id)) AS peak_event_id FROM r GROUP BY user_id"""


def major_share(spark, d):
    """Nations of each region by order value to nine tenths, the crossing one included."""
    o = table(spark, d, "orders").join(table(spark, d, "customer"), F.col("o_custkey") == F.col("c_custkey")).join(table(spark, d, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    s = o.withColumn("cents", F.round(F.col("o_totalprice") * 100).cast("long").cast("double"))
    return A.major_share(s, ["n_regionkey"], "n_name", "cents").select("n_regionkey", "n_name", "amount")


SQL_major_share = """WITH s AS (SELECT n_regionkey, n_name, sum(CAST(round(o_totalprice * 100) AS BIGINT))::DOUBLE AS amount FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey GROUP BY ALL),
w AS (SELECT *, coalesce(sum(amount) OVER (PARTITION BY n_regionkey ORDER BY amount DESC, n_name ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS b, sum(amount) OVER (PARTITION BY n_regionkey) AS t FROM s)
SELECT n_regionkey, n_name, amount FROM w WHERE b / t < 0.9"""


def mainflow_argmax(spark, d):
    """Flag and status with the most quantity of each order, of equal ones the one of the smallest price."""
    l = table(spark, d, "lineitem").withColumn("ord", F.round(F.col("l_extendedprice") * 100).cast("long"))
    return A.main_flow(l, "l_orderkey", ["l_returnflag", "l_linestatus"], F.col("l_quantity"), "ord")


SQL_mainflow_argmax = """WITH s AS (SELECT l_orderkey, l_returnflag, l_linestatus, sum(l_quantity) AS m, min(CAST(round(l_extendedprice * 100) AS BIGINT)) AS o FROM lineitem GROUP BY ALL)
SELECT l_orderkey, l_returnflag, l_linestatus, m AS total FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY m DESC, o) AS k FROM s) WHERE k = 1"""


def contig_ratio(spark, d):
    """Orders as contigs, their line items as aligned rows: estimated over summed length and span."""
    l = table(spark, d, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.max("l_shipdate").alias("s"), F.max("l_quantity").alias("q"), F.max("l_returnflag").alias("f"), F.max("l_suppkey").alias("k"))
    n = l.select("l_orderkey", "l_linenumber", F.when(F.col("f") == "R", "-").otherwise("+").alias("ctg_dir"), F.col("k").cast("string").alias("chr_nam"), days("s").alias("chr_str"), (days("s") + F.col("q").cast("long")).alias("chr_end"))
    return A.contig_ratio(n, "l_orderkey", "l_linenumber").select("l_orderkey", "estimated", "total", F.round("ratio", 6).alias("ratio"), "span", "n_rows")


SQL_contig_ratio = """WITH l AS (SELECT l_orderkey, l_linenumber, CASE WHEN max(l_returnflag) = 'R' THEN '-' ELSE '+' END AS dir, date_diff('day', DATE '1995-01-01', CAST(max(l_shipdate) AS DATE)) AS st, date_diff('day', DATE '1995-01-01', CAST(max(l_shipdate) AS DATE)) + CAST(max(l_quantity) AS BIGINT) AS nd FROM lineitem GROUP BY ALL),
g AS (SELECT l_orderkey, arg_min(dir, l_linenumber) AS d, arg_min(st, l_linenumber) AS fs, arg_min(nd, l_linenumber) AS fe, arg_max(st, l_linenumber) AS ls, arg_max(nd, l_linenumber) AS le, CAST(sum(nd - st) AS BIGINT) AS total, count(*) AS n_rows FROM l GROUP BY 1),
h AS (SELECT *, CASE WHEN d = '+' THEN le - fs ELSE fe - ls END AS estimated FROM g) SELECT l_orderkey, estimated, total, round(CASE WHEN total = 0 THEN 1e9 ELSE estimated / total END, 6) AS ratio, abs(estimated) AS span, n_rows FROM h"""


def event_weight_agg(spark, d):
    """Parts as events, orders as columns: counts times order totals, over active (not F) orders."""
    l = table(spark, d, "lineitem").groupBy(F.col("l_partkey").alias("event"), F.col("l_orderkey").alias("col")).agg(F.count("*").alias("cnt"))
    o = table(spark, d, "orders")
    w = o.select(F.col("o_orderkey").alias("col"), F.col("o_totalprice").alias("w"))
    got = A.event_weights(l, w, o.where("o_orderstatus <> 'F'").select(F.col("o_orderkey").alias("col")))
    return got.select("event", F.round("weight", 2).alias("weight"))


SQL_event_weight_agg = """SELECT l_partkey AS event, round(sum(o_totalprice), 2) AS weight FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE o_orderstatus <> 'F' GROUP BY 1"""


def usage_counter(spark, d):
    """Types of a user's successive events as nodes: uses of three junctions, a use taking up both its events."""
    e = events(spark, d)
    code = F.when(F.col("event_type") == "view", 1).when(F.col("event_type") == "click", 2).when(F.col("event_type") == "purchase", 3).otherwise(4)
    p = e.withColumn("n", code.cast("long")).groupBy(F.col("user_id").alias("path_id")).agg(F.transform(F.array_sort(F.collect_list(F.struct("event_id", "n"))), lambda x: x["n"]).alias("nodes"))
    j = spark.createDataFrame([(1, 2), (2, 3), (4, 1)], "a long, b long")
    return A.path_events(p, j)


SQL_usage_counter = """WITH RECURSIVE e AS (SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS k, CASE event_type WHEN 'view' THEN 1 WHEN 'click' THEN 2 WHEN 'purchase' THEN 3 ELSE 4 END AS n FROM events),
p AS (SELECT a.user_id, a.k, least(a.n, b.n) AS a, greatest(a.n, b.n) AS b, (least(a.n, b.n), greatest(a.n, b.n)) IN ((1, 2), (2, 3), (1, 4)) AS hit FROM e a JOIN e b ON a.user_id = b.user_id AND b.k = a.k + 1),
r AS (SELECT user_id, CAST(1 AS BIGINT) AS k FROM e WHERE k = 1 UNION ALL SELECT r.user_id, r.k + CASE WHEN p.hit THEN 2 ELSE 1 END FROM r JOIN p ON p.user_id = r.user_id AND p.k = r.k)
SELECT p.user_id AS path_id, CAST(p.a AS BIGINT) AS a, CAST(p.b AS BIGINT) AS b, count(*) AS cnt FROM r JOIN p ON p.user_id = r.user_id AND p.k = r.k WHERE p.hit GROUP BY ALL"""


def path_composition(spark, d):
    """Value of each event type of a user, with share and rank, types under 20 left out."""
    e = events(spark, d).withColumn("cents", F.round(F.col("value") * 100).cast("long"))
    c = A.composition(e, "user_id", "event_type", "cents", 2000)
    return c.select("user_id", "event_type", "amount", F.round("share", 6).alias("share"), "rank")


SQL_path_composition = """WITH s AS (SELECT user_id, event_type, CAST(sum(CAST(round(value * 100) AS BIGINT)) AS BIGINT) AS amount FROM events GROUP BY ALL HAVING sum(CAST(round(value * 100) AS BIGINT)) >= 2000)
SELECT user_id, event_type, amount, round(amount / sum(amount) OVER (PARTITION BY user_id), 6) AS share, CAST(rank() OVER (PARTITION BY user_id ORDER BY amount DESC) AS INT) AS rank FROM s"""


def reason_counters(spark, d):
    """Orders of each priority by status, zeros included."""
    o = table(spark, d, "orders")
    return A.counters(o.where("o_orderstatus = 'P' and o_totalprice > 499000"), "o_orderpriority", o.select("o_orderpriority").distinct())


SQL_reason_counters = """SELECT p.o_orderpriority, count(o.o_orderkey) AS n FROM (SELECT DISTINCT o_orderpriority FROM orders) p LEFT JOIN orders o ON o.o_orderpriority = p.o_orderpriority AND o_orderstatus = 'P' AND o_totalprice > 499000 GROUP BY 1"""


def covered_fraction(spark, d):
    """Customers as contigs of 2,500 days: their orders (40 days each), covered days and fraction."""
    c = table(spark, d, "customer").select(F.col("c_custkey").alias("name"), F.lit(2500).alias("len"))
    o = table(spark, d, "orders").select(F.col("o_custkey").alias("qname"), days("o_orderdate").alias("qst"), (days("o_orderdate") + 40).alias("qnd"))
    return A.covered_fraction(c, o).select("name", "n_alignments", "covered", F.round("fraction", 6).alias("fraction"))


SQL_covered_fraction = """WITH iv AS (SELECT o_custkey AS chr, date_diff('day', DATE '1995-01-01', CAST(o_orderdate AS DATE)) AS st, date_diff('day', DATE '1995-01-01', CAST(o_orderdate AS DATE)) + 40 AS nd FROM orders),
a AS (SELECT *, max(nd) OVER (PARTITION BY chr ORDER BY st, nd ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM iv), g AS (SELECT chr, count(*) AS n, CAST(sum(greatest(0, nd - greatest(st, coalesce(reach, st)))) AS BIGINT) AS c FROM a GROUP BY chr)
SELECT c_custkey AS name, coalesce(n, 0) AS n_alignments, coalesce(c, 0) AS covered, round(coalesce(c, 0) / 2500.0, 6) AS fraction FROM customer LEFT JOIN g ON c_custkey = chr"""


def vaf_balance(spark, d):
    """Returned against other quantity of each part, and whether the two are balanced."""
    l = table(spark, d, "lineitem").groupBy("l_partkey").agg(F.sum(F.when(F.col("l_returnflag") == "R", F.col("l_quantity")).otherwise(0.0)).alias("alt"), F.sum(F.when(F.col("l_returnflag") != "R", F.col("l_quantity")).otherwise(0.0)).alias("ref"))
    return l.select("l_partkey", F.round(A.allele_fraction(F.col("alt"), F.col("ref")), 6).alias("vaf"), X.balanced(F.col("alt"), F.col("ref"), 1.5).alias("balanced"), X.similar(F.col("alt"), F.col("ref"), 1.25, 5.0, False).alias("similar"))


SQL_vaf_balance = """WITH l AS (SELECT l_partkey, sum(CASE WHEN l_returnflag = 'R' THEN l_quantity ELSE 0.0 END) AS alt, sum(CASE WHEN l_returnflag <> 'R' THEN l_quantity ELSE 0.0 END) AS ref FROM lineitem GROUP BY 1)
SELECT l_partkey, round(alt / nullif(alt + ref, 0), 6) AS vaf, greatest(alt, ref) <= 1.5 * least(alt, ref) AS balanced, CASE WHEN least(alt, ref) = 0 THEN false ELSE greatest(alt, ref) <= 1.25 * least(alt, ref) OR greatest(alt, ref) - least(alt, ref) < 5 END AS similar FROM l"""


def set_algebra(spark, d):
    """Customers with dear orders or urgent ones, with both, and with dear ones only."""
    o = table(spark, d, "orders")
    a, b = o.where("o_totalprice > 400000").select("o_custkey"), o.where("o_orderpriority = '1-URGENT'").select("o_custkey")
    parts = [a.union(b).distinct().withColumn("op", F.lit("union")), a.intersect(b).withColumn("op", F.lit("both")), a.distinct().join(b.distinct(), "o_custkey", "left_anti").withColumn("op", F.lit("only"))]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


SQL_set_algebra = """WITH a AS (SELECT o_custkey FROM orders WHERE o_totalprice > 400000), b AS (SELECT o_custkey FROM orders WHERE o_orderpriority = '1-URGENT')
SELECT *, 'union' AS op FROM (SELECT * FROM a UNION SELECT * FROM b) UNION ALL SELECT *, 'both' FROM (SELECT * FROM a INTERSECT SELECT * FROM b) UNION ALL SELECT *, 'only' FROM (SELECT * FROM a EXCEPT SELECT * FROM b)"""


def first_seen_union(spark, d):
    """Keys of three sources in order, each from the first that has it."""
    o = table(spark, d, "orders").select(F.col("o_custkey").alias("key"), F.col("o_orderkey").alias("ord"), "o_orderstatus")
    got = E.first_seen([o.where(f"o_orderstatus = '{s}'") for s in ("P", "O", "F")], ["key"])
    return got.select("key", "ord", "o_orderstatus")


SQL_first_seen_union = """SELECT o_custkey AS key, o_orderkey AS ord, o_orderstatus FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY CASE o_orderstatus WHEN 'P' THEN 0 WHEN 'O' THEN 1 ELSE 2 END, o_orderkey) AS k FROM orders WHERE o_orderstatus IN ('P', 'O', 'F')) WHERE k = 1"""


def merge_ids_by_key(spark, d):
    """Orders of one customer, day and status are one event with all their keys."""
    o = table(spark, d, "orders").select("o_custkey", "o_orderdate", "o_orderstatus", "o_orderkey", "o_totalprice")
    g = E.merged_by_key(o, ["o_custkey", "o_orderdate", "o_orderstatus"], "o_orderkey", "o_orderkey")
    return g.select("o_custkey", "o_orderdate", "o_orderstatus", "o_totalprice", F.array_join(F.transform("all_ids", lambda x: x.cast("string")), ",").alias("ids"))


SQL_merge_ids_by_key = """SELECT o_custkey, o_orderdate, o_orderstatus, arg_min(o_totalprice, o_orderkey) AS o_totalprice, string_agg(CAST(o_orderkey AS VARCHAR), ',' ORDER BY o_orderkey) AS ids FROM orders GROUP BY ALL"""


def relational_division(spark, d):
    """U4: users with every event type of value over 40, and users whose events are all under 150."""
    e = events(spark, d)
    usage = e.groupBy(F.col("user_id").alias("col"), F.col("event_type").alias("event")).agg(F.sum(F.when(F.col("value") > 40, 1).otherwise(0)).alias("cnt"))
    a = E.covering_columns(usage, e.select(F.col("event_type").alias("event")))
    low = e.withColumn("event", F.when(F.col("value") >= 150, "high").otherwise("low")).groupBy(F.col("user_id").alias("col"), "event").agg(F.count("*").alias("cnt"))
    b = E.subset_columns(low, spark.createDataFrame([("low",)], "event string"))
    return a.withColumn("kind", F.lit("all")).unionByName(b.withColumn("kind", F.lit("low")))


SQL_relational_division = """SELECT user_id AS col, 'all' AS kind FROM events WHERE value > 40 GROUP BY user_id HAVING count(DISTINCT event_type) = (SELECT count(DISTINCT event_type) FROM events)
UNION ALL SELECT user_id, 'low' FROM events GROUP BY user_id HAVING max(value) < 150"""


def top_representative(spark, d):
    """Longest document of each source, of equal ones the smallest id, and the rank order of the longest three."""
    t = table(spark, d, "documents").select("doc_id", "source", F.char_length("text").cast("long").alias("n"))
    from pyspark.sql import Window

    w = Window.partitionBy("source").orderBy(F.col("n").desc(), "doc_id")
    return t.withColumn("rank", F.row_number().over(w)).where("rank <= 3").select("source", "rank", "doc_id", "n")


SQL_top_representative = """SELECT source, CAST(rank AS INT) AS rank, doc_id, n FROM (SELECT doc_id, source, length(text) AS n, row_number() OVER (PARTITION BY source ORDER BY length(text) DESC, doc_id) AS rank FROM documents) WHERE rank <= 3"""


def ordered_groups(spark, d):
    """Nations of each region in order, with the first."""
    n = table(spark, d, "nation")
    g = A.grouped_in_order(n, ["n_regionkey"], "n_nationkey", ["n_name"])
    return g.select("n_regionkey", F.array_join(F.transform("members", lambda m: m["n_name"]), ",").alias("names"), "first_at")


SQL_ordered_groups = """SELECT n_regionkey, string_agg(n_name, ',' ORDER BY n_nationkey) AS names, min(n_nationkey) AS first_at FROM nation GROUP BY 1"""


def _cs(k: str, q: str, p: str):
    return F.concat(F.lit(":"), k, F.lit("*ag+"), F.repeat(F.lit("ac"), (F.col(q) % 4 + 1).cast("int")), F.lit("-"), F.repeat(F.lit("t"), (F.col(p) % 5 + 1).cast("int")), F.lit(":"), q, F.lit(":"), p)


def cs_parse(spark, d):
    """difference strings made of keys: CIGAR, matched and aligned lengths."""
    p = table(spark, d, "part").select(F.col("p_partkey"), (F.col("p_partkey") + 1).cast("string").alias("k"), (F.col("p_size")).cast("string").alias("q"), (F.col("p_size") + 3).cast("string").alias("p"))
    p = p.withColumn("cs", _cs("k", "q", "p"))
    return p.select("p_partkey", C.cigar(F.col("cs")).alias("cigar"), C.stats(F.col("cs"))["matched"].alias("matched"), C.stats(F.col("cs"))["aligned"].alias("aligned"))


SQL_cs_parse = """SELECT p_partkey, (p_partkey + 1) || '=1X' || (2 * (p_size % 4 + 1)) || 'I' || ((p_size + 3) % 5 + 1) || 'D' || (2 * p_size + 3) || '=' AS cigar,
CAST(p_partkey + 1 + 2 * p_size + 3 AS BIGINT) AS matched, CAST(p_partkey + 1 + 2 * p_size + 3 + 1 + (p_size + 3) % 5 + 1 AS BIGINT) AS aligned FROM part"""


def info_parse(spark, d):
    """INFO text made of orders: an integer of a list, a text with = in it, a flag."""
    o = table(spark, d, "orders").select("o_orderkey", F.concat(F.lit("SVLEN=-"), "o_custkey", F.lit(",7;IMPRECISE;NOTE=a="), "o_orderstatus", F.lit(";END="), (F.col("o_custkey") + 0.5).cast("string")).alias("info"))
    m = V.info_map(F.col("info"))
    return o.select("o_orderkey", V.optional_int(m["SVLEN"]).alias("svlen"), m["NOTE"].alias("note"), V.optional_int(m["END"]).alias("end_pos"), F.map_contains_key(m, F.lit("IMPRECISE")).alias("imprecise"), F.size(m).alias("n"))


SQL_info_parse = """SELECT o_orderkey, CAST(-o_custkey AS BIGINT) AS svlen, 'a=' || o_orderstatus AS note, o_custkey AS end_pos, true AS imprecise, 4 AS n FROM orders"""


def bracket_alt_parse(spark, d):
    """breakend alleles of all four forms made of orders, with their strands and inverses."""
    o = table(spark, d, "orders").select("o_orderkey", "o_custkey", (F.col("o_orderkey") % 4).alias("k"))
    mate = F.concat(F.lit("chr"), (F.col("o_custkey") % 22 + 1).cast("string"), F.lit(":"), (F.col("o_orderkey") + 1).cast("string"))
    alt = F.when(F.col("k") == 0, F.concat(F.lit("N["), mate, F.lit("["))).when(F.col("k") == 1, F.concat(F.lit("N]"), mate, F.lit("]"))).when(F.col("k") == 2, F.concat(F.lit("["), mate, F.lit("[N"))).otherwise(F.concat(F.lit("]"), mate, F.lit("]N")))
    o = o.withColumn("a", V.breakend_alt(alt))
    return o.select("o_orderkey", "a.mate_chr", "a.mate_pos", F.concat("a.dir_a", "a.dir_b").alias("dirs"), S.strands_of(F.col("a.dir_a"), F.col("a.dir_b")).alias("strands"), "a.shape")


SQL_bracket_alt_parse = """SELECT o_orderkey, 'chr' || (o_custkey % 22 + 1) AS mate_chr, o_orderkey + 1 AS mate_pos, CASE o_orderkey % 4 WHEN 0 THEN '++' WHEN 1 THEN '+-' WHEN 2 THEN '-+' ELSE '--' END AS dirs,
CASE o_orderkey % 4 WHEN 0 THEN '+-' WHEN 1 THEN '++' WHEN 2 THEN '--' ELSE '-+' END AS strands, CASE o_orderkey % 4 WHEN 0 THEN 'prefix[' WHEN 1 THEN 'prefix]' WHEN 2 THEN 'suffix[' ELSE 'suffix]' END AS shape FROM orders"""


def info_upsert(spark, d):
    """K5: two keys set in INFO text, others and their order as they were."""
    o = table(spark, d, "orders").select("o_orderkey", F.concat(F.lit("A=1;CN=9;FLAG;B="), "o_orderstatus").alias("info"), F.col("o_custkey").cast("string").alias("cn"))
    return o.select("o_orderkey", V.upsert_info(F.col("info"), ["CN", "KIND"], [F.col("cn"), F.when(F.col("o_orderkey") % 2 == 0, F.lit("x"))]).alias("info"))


SQL_info_upsert = """SELECT o_orderkey, 'A=1;FLAG;B=' || o_orderstatus || ';CN=' || o_custkey || CASE WHEN o_orderkey % 2 = 0 THEN ';KIND=x' ELSE '' END AS info FROM orders"""


def identifier_sanitize(spark, d):
    """page addresses as identifiers."""
    return table(spark, d, "pages").select("page_id", V.sanitize_id(F.col("url")).alias("name"))


SQL_identifier_sanitize = """SELECT page_id, regexp_replace(CASE WHEN url IS NULL OR url = '' THEN 'unknown' ELSE url END, '[^A-Za-z0-9_.-]+', '_', 'g') AS name FROM pages"""


def karyotype_text(spark, d):
    """users' event runs as chromosomes and strands: karyotype text."""
    e = events(spark, d).select("user_id", "event_id", F.concat(F.lit("chr"), F.when(F.col("event_type") == "view", "1").when(F.col("event_type") == "click", "2").otherwise("X")).alias("chr"), F.when(F.col("value") > 50, "-").otherwise("+").alias("strand"), F.lit(1).alias("length"))
    p = E.karyotype_pieces(e.withColumnRenamed("user_id", "path_id").withColumnRenamed("event_id", "step"), "path_id", "step")
    g = p.groupBy("path_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("run", "chr", "strand"))), lambda x: F.struct(x["chr"].alias("chr"), x["strand"].alias("strand"))).alias("pieces"))
    return g.select("path_id", X.karyotype(F.col("pieces")).alias("text"))


SQL_karyotype_text = """WITH e AS (SELECT user_id, event_id, CASE event_type WHEN 'view' THEN '1' WHEN 'click' THEN '2' ELSE 'X' END AS c, CASE WHEN value > 50 THEN '-' ELSE '+' END AS s FROM events),
a AS (SELECT *, CASE WHEN lag(c || s) OVER w IS NULL OR lag(c || s) OVER w = c || s THEN 0 ELSE 1 END AS new FROM e WINDOW w AS (PARTITION BY user_id ORDER BY event_id)), b AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY event_id ROWS UNBOUNDED PRECEDING) AS run FROM a),
r AS (SELECT user_id, run, any_value(c) AS c, any_value(s) AS s FROM b GROUP BY ALL), t AS (SELECT *, lag(c) OVER w AS pc, lag(s) OVER w AS ps FROM r WINDOW w AS (PARTITION BY user_id ORDER BY run)),
u AS (SELECT user_id, run, CASE WHEN pc IS NULL THEN NULL WHEN pc <> c THEN 't(' || pc || ';' || c || ')' WHEN ps <> s THEN 'inv(' || pc || ')' END AS x FROM t),
f AS (SELECT user_id, x, min(run) AS run FROM u WHERE x IS NOT NULL GROUP BY ALL), g AS (SELECT user_id, string_agg(x, ',' ORDER BY run) AS text FROM f GROUP BY user_id)
SELECT r.user_id AS path_id, coalesce(g.text, r.c) AS text FROM r LEFT JOIN g ON r.user_id = g.user_id WHERE r.run = 0"""


def simple_paths_k(spark, d):
    """R2: simple paths of one to three steps between nations, over edges from customers' nations to suppliers' they buy most from."""
    e = nation_edges(spark, d)
    n = e.select(F.col("src").alias("node")).distinct()
    p = G.simple_paths(e, n, e.select(F.col("dst").alias("node")).distinct(), 3)
    return p.select("src", "dst", F.array_join(F.transform("nodes", lambda x: x.cast("string")), ">").alias("path"))


def nation_edges(spark, d, most: int = 3):
    from pyspark.sql import Window

    l = table(spark, d, "lineitem").join(table(spark, d, "orders"), F.col("l_orderkey") == F.col("o_orderkey")).join(table(spark, d, "customer"), F.col("o_custkey") == F.col("c_custkey")).join(table(spark, d, "supplier"), F.col("l_suppkey") == F.col("s_suppkey"))
    g = l.groupBy(F.col("c_nationkey").alias("src"), F.col("s_nationkey").alias("dst")).agg(F.sum("l_quantity").alias("q")).where("src <> dst")
    w = Window.partitionBy("src").orderBy(F.col("q").desc(), "dst")
    return g.withColumn("k", F.row_number().over(w)).where(F.col("k") <= most).select("src", "dst")


_EDGES = """g AS (SELECT c_nationkey AS src, s_nationkey AS dst, sum(l_quantity) AS q FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN supplier ON l_suppkey = s_suppkey WHERE c_nationkey <> s_nationkey GROUP BY ALL),
e AS (SELECT src, dst FROM (SELECT *, row_number() OVER (PARTITION BY src ORDER BY q DESC, dst) AS k FROM g) WHERE k <= 3)"""
SQL_simple_paths_k = f"""WITH RECURSIVE {_EDGES}, p AS (SELECT src, dst, [src, dst] AS nodes, 1 AS n FROM e UNION ALL SELECT p.src, e.dst, list_append(nodes, e.dst), n + 1 FROM p JOIN e ON p.dst = e.src WHERE n < 3 AND NOT list_contains(nodes, e.dst))
SELECT src, dst, array_to_string(nodes, '>') AS path FROM p"""


def circuits_len4(spark, d):
    """Directed circuits of four nations in the same graph, as sorted tuples."""
    return G.circuits_of_four(nation_edges(spark, d))


SQL_circuits_len4 = f"""WITH {_EDGES}, c AS (SELECT a.src AS x1, b.src AS x2, c.src AS x3, d.src AS x4 FROM e a JOIN e b ON a.dst = b.src JOIN e c ON b.dst = c.src JOIN e d ON c.dst = d.src AND d.dst = a.src),
s AS (SELECT list_sort([x1, x2, x3, x4]) AS l FROM c WHERE x1 <> x2 AND x1 <> x3 AND x1 <> x4 AND x2 <> x3 AND x2 <> x4 AND x3 <> x4) SELECT DISTINCT l[1] AS n1, l[2] AS n2, l[3] AS n3, l[4] AS n4 FROM s"""


def shortest_fill(spark, d):
    """Shortest distances between all nations in the same graph, an edge costing 1 + its end's key."""
    e = nation_edges(spark, d).withColumn("dist", (F.col("dst") + 1).cast("double"))
    pairs = e.select("src").distinct().crossJoin(e.select("dst").distinct()).where("src <> dst")  # 25 x 25 nations
    return G.shortest_distances(e, pairs).select("src", "dst", F.col("dist").cast("long").alias("dist"))


SQL_shortest_fill = f"""WITH RECURSIVE {_EDGES}, p AS (SELECT src, dst, dst + 1 AS dist, [src, dst] AS seen FROM e UNION ALL SELECT p.src, e.dst, p.dist + e.dst + 1, list_append(seen, e.dst) FROM p JOIN e ON p.dst = e.src WHERE NOT list_contains(seen, e.dst) AND len(seen) < 10)
SELECT src, dst, CAST(min(dist) AS BIGINT) AS dist FROM p GROUP BY ALL"""


def label_components(spark, d):
    """Parts sold together often: components of parts joined by orders with the same customer and day."""
    o = table(spark, d, "orders").select("o_custkey", "o_orderdate", "o_orderkey")
    low = o.groupBy("o_custkey", "o_orderdate").agg(F.min("o_orderkey").alias("a"))
    e = o.join(low, ["o_custkey", "o_orderdate"]).where("a <> o_orderkey").select("a", F.col("o_orderkey").alias("b"))
    return G.components(e)


SQL_label_components = """WITH o AS (SELECT o_orderkey, min(o_orderkey) OVER (PARTITION BY o_custkey, o_orderdate) AS component, count(*) OVER (PARTITION BY o_custkey, o_orderdate) AS n FROM orders) SELECT o_orderkey AS id, component FROM o WHERE n > 1"""


def gram_matrix(spark, d):
    """Gram matrix of the components of all vectors."""
    e = table(spark, d, "embeddings").select(F.col("vec_id").alias("bin"), F.posexplode("embedding").alias("col", "value"))
    g = M.gram(e.withColumn("value", F.col("value").cast("double")))
    return g.select("i", "j", F.round("value", 4).alias("value"))


SQL_gram_matrix = """WITH e AS (SELECT vec_id AS bin, unnest(generate_series(0, len(embedding) - 1)) AS col, embedding FROM embeddings), v AS (SELECT bin, col, CAST(embedding[col + 1] AS DOUBLE) AS value FROM e)
SELECT CAST(a.col AS INT) AS i, CAST(b.col AS INT) AS j, round(sum(a.value * b.value), 4) AS value FROM v a JOIN v b ON a.bin = b.bin AND a.col <= b.col GROUP BY ALL"""


def fit_metrics(spark, d):
    """Error of predicting order totals by thrice their number of items times 20,000."""
    o = table(spark, d, "orders").select(F.col("o_orderkey").alias("bin"), F.col("o_totalprice").alias("value"))
    l = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("bin"), F.lit(0).alias("col"), F.lit(1.0).alias("value"))
    w = spark.createDataFrame([(0, 60000.0)], "col int, w double")
    return M.fit_metrics(M.predict(l, w), o).select(F.round("l2_error", 2).alias("l2_error"), F.round("relative_error", 6).alias("relative_error"))


SQL_fit_metrics = """WITH p AS (SELECT l_orderkey AS bin, count(*) * 60000.0 AS p FROM lineitem GROUP BY 1) SELECT round(sqrt(sum(pow(coalesce(p, 0) - o_totalprice, 2))), 2) AS l2_error, round(sqrt(sum(pow(coalesce(p, 0) - o_totalprice, 2))) / sqrt(sum(pow(o_totalprice, 2))), 6) AS relative_error FROM orders LEFT JOIN p ON bin = o_orderkey"""


def robust_sigma(spark, d):
    """Robust noise of differences between a type's neighbouring values."""
    diffs = O.positive_differences(events(spark, d), ["event_type"], ["event_id"], "value")
    return Q.robust_sigma(diffs, ["event_type"], "diff").select("event_type", F.round("sigma", 5).alias("sigma"), "n")


SQL_robust_sigma = """WITH a AS (SELECT event_type, value, lag(value) OVER (PARTITION BY event_type ORDER BY event_id) AS p FROM events), b AS (SELECT event_type, value - p AS diff FROM a WHERE p > 0 AND value > 0),
m AS (SELECT event_type, median(diff) AS mid FROM b GROUP BY 1) SELECT b.event_type, round(median(abs(diff - mid)) / 0.6744897501960817, 5) AS sigma, count(*) AS n FROM b JOIN m ON b.event_type = m.event_type GROUP BY 1"""


def mann_whitney_u(spark, d):
    """Q3: rank test of values of even against odd users, for each type."""
    e = events(spark, d).withColumn("g", F.col("user_id") % 2)
    return Q.rank_sum_test(e, ["event_type"], "g", "value").select("event_type", "n1", "n0", F.round("u", 2).alias("u"), F.round("z", 5).alias("z"))


SQL_mann_whitney_u = """WITH r AS (SELECT event_type, user_id % 2 AS g, value, rank() OVER (PARTITION BY event_type ORDER BY value) + (count(*) OVER (PARTITION BY event_type, value) - 1) / 2.0 AS rk, count(*) OVER (PARTITION BY event_type, value) AS t FROM events),
s AS (SELECT event_type, count(*) FILTER (g = 1) AS n1, count(*) FILTER (g = 0) AS n0, sum(rk) FILTER (g = 1) AS r1, sum(t * t - 1.0) AS ties FROM r GROUP BY 1)
SELECT event_type, n1, n0, round(r1 - n1 * (n1 + 1) / 2.0, 2) AS u, round(greatest(abs(r1 - n1 * (n1 + 1) / 2.0 - n1 * n0 / 2.0) - 0.5, 0) / sqrt(n1::DOUBLE * n0 / 12.0 * ((n1 + n0 + 1) - ties / ((n1 + n0)::DOUBLE * (n1 + n0 - 1)))), 5) AS z FROM s"""


def filter_provenance(spark, d):
    """Parts as events, orders as columns: reasons of two stages, the first one sticking."""
    l = table(spark, d, "lineitem").groupBy(F.col("l_partkey").alias("event"), F.col("l_orderkey").alias("col")).agg(F.count("*").alias("cnt"))
    ev = table(spark, d, "part").select(F.col("p_partkey").alias("event"))
    o = table(spark, d, "orders").withColumnRenamed("o_orderkey", "col")
    act0, act1 = o.where("o_totalprice > 300000"), o.where("o_totalprice > 300000 and o_orderstatus = 'F' and o_orderpriority = '1-URGENT'")
    part = table(spark, d, "part").withColumnRenamed("p_partkey", "event")
    explicit = part.where("p_size >= 49").select("event", F.lit("EXPLICIT").alias("reason"))
    direct = part.where("p_retailprice > 950").select("event", F.lit("DIRECT").alias("reason"))
    r0 = E.initial_reasons(ev, l, act0, explicit)
    r1 = E.next_reasons(ev, r0, l, act1, direct, "base")
    return r1.groupBy("reason").agg(F.count("*").alias("n"), F.sum("event").alias("sum_event"))


SQL_filter_provenance = """WITH u AS (SELECT DISTINCT l_partkey AS event, l_orderkey AS col FROM lineitem), a AS (SELECT p_partkey AS event, p_size, p_retailprice, EXISTS (SELECT 1 FROM u WHERE u.event = p_partkey) AS c, EXISTS (SELECT 1 FROM u JOIN orders ON o_orderkey = col WHERE u.event = p_partkey AND o_totalprice > 300000) AS a0,
EXISTS (SELECT 1 FROM u JOIN orders ON o_orderkey = col WHERE u.event = p_partkey AND o_totalprice > 300000 AND o_orderstatus = 'F' AND o_orderpriority = '1-URGENT') AS a1 FROM part),
r AS (SELECT event, CASE WHEN p_size >= 49 THEN 'EXPLICIT' WHEN NOT c THEN 'FILTERED_02_NO_ELIGIBLE_PATH' WHEN NOT a0 THEN 'FILTERED_02_COFILTERED_PATH' WHEN a1 THEN NULL WHEN p_retailprice > 950 THEN 'DIRECT' ELSE 'FILTERED_23_COFILTERED_PATH' END AS reason FROM a)
SELECT reason, count(*) AS n, CAST(sum(event) AS BIGINT) AS sum_event FROM r WHERE reason IS NOT NULL GROUP BY 1"""


def stage_report(spark, d):
    """K7: parts with copy numbers and reasons of two stages that ran and one that didn't."""
    ev = table(spark, d, "part").select(F.col("p_partkey").alias("event"), "p_size", "p_retailprice")
    w = ev.select("event", F.col("p_size").cast("double").alias("weight"))
    r = ev.where("p_size < 10").select("event", F.lit("SMALL").alias("reason"))
    rep = E.stage_report(ev.select("event"), {"base": (w, r), "filter": (w, ev.where("p_size < 10 and p_retailprice > 950").select("event", F.lit("SMALL").alias("reason"))), "cluster": None}, 4.0)
    return rep


SQL_stage_report = """SELECT p_partkey AS event, CASE WHEN p_size < 10 THEN '-1' ELSE printf('%.2f', p_size / 4.0) END AS cn_base, CASE WHEN p_size < 10 THEN 'SMALL' ELSE 'PASS' END AS reason_base,
CASE WHEN p_size < 10 AND p_retailprice > 950 THEN '-1' ELSE printf('%.2f', p_size / 4.0) END AS cn_filter, CASE WHEN p_size < 10 AND p_retailprice > 950 THEN 'SMALL' ELSE 'PASS' END AS reason_filter, 'NA' AS cn_cluster, 'NA' AS reason_cluster FROM part"""


def nnls_fit(spark, d):
    """Non-negative fit of a vector's last component by all others."""
    from strandweave.operators import solver as L

    e = table(spark, d, "embeddings").where("size(embedding) >= 2")
    m = e.select(F.col("vec_id").cast("int").alias("bin"), F.posexplode(F.slice("embedding", F.lit(1), F.size("embedding") - 1)).alias("col", "value")).withColumn("value", F.col("value").cast("double"))
    t = e.select(F.col("vec_id").cast("int").alias("bin"), F.element_at("embedding", -1).cast("double").alias("value"))
    return L.fit(m, t).withColumn("w", F.round("w", 8))


def tv_denoise(spark, d):
    """Q2: values of each type denoised in order of time with three times their noise."""
    e = events(spark, d).withColumn("run", F.lit(0))
    s = Q.noise_sigma(e, "event_type", "run", "event_id", "value")
    e = e.select("event_id", "event_type", "value").join(s.withColumn("lam", F.col("sigma") * 3).select("event_type", "lam"), "event_type")
    return Q.tv_denoise(e, ["event_type"], "event_id", "value", "lam").select("event_id", "event_type", F.round("denoised", 6).alias("denoised"))


def greedy_leader(spark, d):
    """Events of a user and type in order of id join the first leader within an hour and 10 of value."""
    from strandweave.operators.leaders import greedy_leaders

    e = events(spark, d).select("event_id", "user_id", "event_type", F.col("sec").cast("double").alias("sec"), "value")
    g = greedy_leaders(e.withColumn("v", F.col("value") * 360), ["event_type", "user_id"], ["event_id"], ["sec", "v"], 36000)
    return g.select("event_id", "leader", "is_leader")


SQL_greedy_leader = f"""WITH RECURSIVE {SQL_EV}, e AS (SELECT event_id, event_type AS t, user_id AS u, CAST(sec AS DOUBLE) AS s, value * 360 AS v, row_number() OVER (PARTITION BY event_type, user_id ORDER BY event_id) AS rn FROM ev),
f AS (SELECT t, u, rn, event_id, [{{'s': s, 'v': v}}] AS leaders, CAST(0 AS BIGINT) AS leader, true AS is_leader FROM e WHERE rn = 1 UNION ALL
SELECT t, u, rn, event_id, CASE WHEN hit IS NULL THEN list_append(leaders, {{'s': s, 'v': v}}) ELSE leaders END, CAST(coalesce(hit - 1, len(leaders)) AS BIGINT), hit IS NULL
FROM (SELECT e.*, f.leaders, nullif(coalesce(list_position(list_transform(f.leaders, lambda l: abs(l.s - e.s) <= 36000 AND abs(l.v - e.v) <= 36000), true), 0), 0) AS hit FROM f JOIN e ON e.t = f.t AND e.u = f.u AND e.rn = f.rn + 1))
SELECT event_id, leader, is_leader FROM f"""


_NAMES = [n for n in list(globals()) if n.startswith("SQL_") and n != "SQL_EV"]
ORACLE = {n[4:]: globals()[n] for n in _NAMES}
QUERIES = {n: globals()[n] for n in ORACLE} | {"nnls_fit": nnls_fit, "tv_denoise": tv_denoise, "greedy_leader": greedy_leader}
