"""Contig, junction, variant and file queries over the driver's tables, each by the library operator that it names.

Rows of `junction_queries.rows` play aligned chunks of contigs; r_id numbers them. Files are written to the shared folder
and read back.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from strandweave.functions import intervals as I
from strandweave.functions import values as X
from strandweave.functions import vcf_text as V
from strandweave.operators import cascade as K
from strandweave.operators import contigs as T
from strandweave.operators import events as E
from strandweave.operators import graph as G
from strandweave.operators import junctions as J
from strandweave.operators import matrix as M
from strandweave.operators import paths as P
from strandweave.operators import solver as L
from strandweave.operators import stats as Q
from strandweave.plans import event_queries, junction_queries, limits
from strandweave.plans.interval_queries import days
from strandweave.plans.junction_queries import SQL_ROWS, rows
from strandweave.runtime import cut, new_folder, table
from strandweave.sources import readers as R
from strandweave.sources import sinks as W

_N = f"{SQL_ROWS}, n AS (SELECT *, ctg * 8 + line AS id, lead(line) OVER w AS line2, lead(chr) OVER w AS chr2, lead(dir) OVER w AS dir2, lead(st) OVER w AS st2, lead(nd) OVER w AS nd2, lead(q) OVER w AS q2 FROM r WINDOW w AS (PARTITION BY ctg ORDER BY line))"


def numbered(spark: SparkSession, d: str) -> DataFrame:
    return rows(spark, d).withColumn("id", F.col("ctg_nam") * 8 + F.col("node_id"))


def followed(spark: SparkSession, d: str) -> DataFrame:
    """Rows with those that follow them in their contig."""
    w = Window.partitionBy("ctg_nam").orderBy("node_id")
    r = numbered(spark, d)
    for c in ("id", "node_id", "chr_nam", "ctg_dir", "chr_str", "chr_end", "q"):
        r = r.withColumn(f"{c}2", F.lead(c).over(w))
    return r


def untrusted_contigs(spark, d):
    """P5: contigs with a secondary or poorly mapped row."""
    r = rows(spark, d).select(F.col("ctg_nam").alias("qname"), F.array(F.lit("cg:Z:*"), F.when(F.col("q") % 13 == 0, "tp:A:S").otherwise("tp:A:P")).alias("tags"), F.when(F.col("q") % 17 == 0, 59).otherwise(60).alias("mapq"))
    return T.untrusted_contigs(r)


SQL_untrusted_contigs = f"WITH {SQL_ROWS} SELECT ctg AS qname FROM r GROUP BY ctg HAVING bool_or(q % 13 = 0 OR q % 17 = 0)"


def repeat_only_contigs(spark, d):
    """Contigs of whose reference length less than 0.3 has no label."""
    return T.repeat_only_contigs(rows(spark, d).withColumn("label", F.when(F.col("q") <= 25, F.when(F.col("q") % 2 == 0, "r1").otherwise("r2")).otherwise(F.when(F.col("q") % 2 == 0, "0"))), "label", baseline=0.3)


SQL_repeat_only_contigs = f"""WITH {SQL_ROWS}, s AS (SELECT ctg, sum(nd - st) AS total, sum(CASE WHEN q > 25 THEN nd - st ELSE 0 END) AS plain FROM r GROUP BY ctg) SELECT ctg AS ctg_nam FROM s WHERE plain = 0 OR plain < 0.3 * total"""


def rows_without_breakends(spark, d):
    """Rows of contigs none of which is of type 1 or 2."""
    r = rows(spark, d).withColumn("ctg_typ", F.col("q") % 9)
    return T.without_contigs(r, T.breakend_contigs(r)).select("ctg_nam", "node_id")


SQL_rows_without_breakends = f"WITH {SQL_ROWS} SELECT ctg AS ctg_nam, line AS node_id FROM r WHERE ctg NOT IN (SELECT ctg FROM r WHERE q % 9 IN (1, 2))"


def rows_near_ends(spark, d):
    """Rows near an end of their chromosome."""
    r = numbered(spark, d).withColumn("chr_len", F.lit(2600))
    return r.where(T.near_end(r, 150)).select("id")


SQL_rows_near_ends = f"WITH {_N} SELECT id FROM n WHERE st <= 150 OR nd >= 2450"


def simple_members(spark, d):
    """The simple rows of each contig, or all where there is none."""
    return T.prefer_simple(numbered(spark, d).withColumn("is_simple", F.col("q") > 40), ["ctg_nam"]).select("id")


SQL_simple_members = f"WITH {_N} SELECT id FROM (SELECT id, q, max(q) OVER (PARTITION BY ctg) AS most FROM n) WHERE q > 40 OR most <= 40"


def conflicting_tips(spark, d):
    """Neighbours whose directions near ends have nothing in common."""
    r = followed(spark, d).where("id2 is not null")
    both = lambda c, q: F.when(F.col(q) % 4 == 0, F.array(F.lit("+"), F.lit("-"))).when(F.col(q) % 4 == 1, F.array().cast("array<string>")).otherwise(F.array(F.col(c)))
    return T.conflicting_tips(r.withColumn("a_orientations", both("ctg_dir", "q")).withColumn("b_orientations", both("ctg_dir2", "q2"))).select("id")


SQL_conflicting_tips = f"WITH {_N} SELECT id FROM n WHERE line2 IS NOT NULL AND (q % 4 = 1 OR q2 % 4 = 1 OR (q % 4 <> 0 AND q2 % 4 <> 0 AND dir <> dir2))"


def split_at_jumps(spark, d):
    """D3: two-row contigs around jumps."""
    r = rows(spark, d).withColumn("ctg_typ", F.when(F.col("ctg_nam") % 5 == 0, 4).otherwise(3)).withColumn("in_repeat", F.col("q") < 5)
    return T.split_at_jumps(r, bound=0.5, repeat_bound=2.5, least=40).select("ctg_nam", "node_id")


SQL_split_at_jumps = f"""WITH {_N}, c AS (SELECT ctg, line, line2, abs(1 - (CASE WHEN dir = '+' THEN nd2 - st ELSE nd - st2 END) / CAST(nd - st + nd2 - st2 AS DOUBLE)) AS off, CASE WHEN q < 5 OR q2 < 5 THEN 2.5 ELSE 0.5 END AS lim, nd - st + nd2 - st2 AS total
FROM n WHERE ctg % 5 <> 0 AND chr = chr2 AND dir = dir2), k AS (SELECT ctg, line, line2, row_number() OVER (PARTITION BY ctg ORDER BY line) AS k FROM c WHERE off > lim AND total > 40)
SELECT ctg || '_split' || k AS ctg_nam, line AS node_id FROM k UNION ALL SELECT ctg || '_split' || k, line2 FROM k"""


def split_at_telomeres(spark, d):
    """Parts of contigs with telomeric rows inside."""
    r = rows(spark, d).withColumn("ctg_teldir", F.when(F.col("q") % 3 == 0, "f").when(F.col("q") % 3 == 1, "0")).withColumn("telo_connected", F.col("q") % 7 == 0)
    return T.split_at_telomeres(r).select("ctg_nam", "node_id")


SQL_split_at_telomeres = f"""WITH {SQL_ROWS}, a AS (SELECT *, row_number() OVER (PARTITION BY ctg ORDER BY line) AS k, count(*) OVER (PARTITION BY ctg) AS n FROM r),
b AS (SELECT *, count(*) FILTER (q % 3 = 0 AND k > 1 AND k < n) OVER (PARTITION BY ctg) AS inside, count(*) FILTER (q % 7 = 0 AND (k = 1 OR k = n)) OVER (PARTITION BY ctg) AS tied,
min(CASE WHEN q % 3 = 0 THEN k END) OVER (PARTITION BY ctg) AS f, max(CASE WHEN q % 3 = 0 THEN k END) OVER (PARTITION BY ctg) AS l FROM a), c AS (SELECT * FROM b WHERE inside >= 2 AND tied = 0)
SELECT ctg || '_telomere1' AS ctg_nam, line AS node_id FROM c WHERE k <= f UNION ALL SELECT ctg || '_telomere2', line FROM c WHERE k >= l"""


def end_connectivity(spark, d):
    """Junction ends of an order that face each other or overlap."""
    r = numbered(spark, d).select(F.col("id").alias("node"), F.col("node_id").alias("contig"), F.when(F.col("q") % 2 == 0, "f").otherwise("b").alias("role"), F.col("ctg_dir").alias("strand"), F.col("ctg_nam").alias("chr"), F.col("chr_str").alias("st"), F.col("chr_end").alias("nd"))
    return G.connectivity(r)


SQL_end_connectivity = f"""WITH {_N}, e AS (SELECT id, ctg, st, nd, q % 2 = 0 AS front, dir = '+' AS plus FROM n), p AS (SELECT x.id AS i, y.id AS j, x.front AS fi, y.front AS fj FROM e x JOIN e y ON x.ctg = y.ctg AND x.id <> y.id
WHERE (greatest(x.st, y.st) < least(x.nd, y.nd) AND ((x.front AND x.plus AND ((y.front AND NOT y.plus) OR (NOT y.front AND y.plus))) OR (NOT x.front AND NOT x.plus AND ((y.front AND NOT y.plus) OR (NOT y.front AND y.plus)))))
OR (x.front AND x.plus AND y.front AND NOT y.plus AND x.st > y.st) OR (x.front AND x.plus AND NOT y.front AND y.plus AND x.st > y.nd) OR (NOT x.front AND NOT x.plus AND NOT y.front AND y.plus AND x.nd > y.nd) OR (NOT x.front AND NOT x.plus AND y.front AND NOT y.plus AND x.nd > y.st))
SELECT DISTINCT CASE WHEN fi THEN {G.BAK} ELSE {G.FOR} END AS src_dir, i AS src, CASE WHEN fj THEN {G.FOR} ELSE {G.BAK} END AS dst_dir, j AS dst FROM p
UNION SELECT DISTINCT CASE WHEN fj THEN {G.BAK} ELSE {G.FOR} END, j, CASE WHEN fi THEN {G.FOR} ELSE {G.BAK} END, i FROM p"""


def both_ways(spark, d):
    """Edges both ways through the junctions of neighbours."""
    r = followed(spark, d).where("id2 is not null")
    return G.junction_edges(r.select(F.col("id").alias("a"), F.col("id2").alias("b")))


SQL_both_ways = f"WITH {_N} SELECT {G.FOR} AS src_dir, id AS src, {G.FOR} AS dst_dir, ctg * 8 + line2 AS dst FROM n WHERE line2 IS NOT NULL UNION ALL SELECT {G.BAK}, ctg * 8 + line2, {G.BAK}, id FROM n WHERE line2 IS NOT NULL"


def extreme_edges(spark, d):
    """Edges of each pair of contigs that touch its extreme nodes."""
    o = table(spark, d, "orders").select(F.col("o_orderkey").alias("src"), F.col("o_custkey").alias("dst"), (F.col("o_custkey") % 11).alias("contig_a"), F.col("o_orderpriority").alias("contig_b"))
    return G.extreme_edges(o)


SQL_extreme_edges = """SELECT src, dst, contig_a, contig_b FROM (SELECT o_orderkey AS src, o_custkey AS dst, o_custkey % 11 AS contig_a, o_orderpriority AS contig_b, min(o_orderkey) OVER w AS s0, max(o_orderkey) OVER w AS s1, min(o_custkey) OVER w AS d0, max(o_custkey) OVER w AS d1
FROM orders WINDOW w AS (PARTITION BY o_custkey % 11, o_orderpriority)) WHERE src IN (s0, s1) OR dst IN (d0, d1)"""


def nearest_links(spark, d):
    """Of links of a chromosome the nearest one in each direction, and all that overlap."""
    r = numbered(spark, d).select("id", F.col("chr_nam").alias("chr"), F.col("ctg_dir").alias("dir"), F.col("ctg_nam").alias("ctg"), F.greatest(F.col("q") - 10, F.lit(0)).alias("distance"))
    return G.nearest_neighbours(r.select("distance", "id", "chr", "dir", "ctg"), ["chr", "dir"], "distance", "ctg").select("id", "distance")


SQL_nearest_links = f"""WITH {_N}, l AS (SELECT id, chr, dir, ctg, greatest(q - 10, 0) AS distance FROM n) SELECT id, distance FROM l WHERE distance = 0
UNION ALL SELECT id, distance FROM (SELECT *, row_number() OVER (PARTITION BY chr, dir, ctg ORDER BY distance, id) AS k FROM l WHERE distance > 0) WHERE k = 1"""


def path_neighbours(spark, d):
    """Steps of paths with the chromosome of the step before."""
    r = numbered(spark, d)
    paths = r.groupBy(F.col("ctg_nam").alias("path_id")).agg(F.array_sort(F.collect_list("id")).alias("nodes"))
    return G.path_steps(paths, r.select(F.col("id").alias("node"), F.col("chr_nam").alias("chr"))).select("path_id", "step", "chr", "prev_chr")


SQL_path_neighbours = f"WITH {SQL_ROWS} SELECT ctg AS path_id, CAST(row_number() OVER w - 1 AS INT) AS step, chr, lag(chr) OVER w AS prev_chr FROM r WINDOW w AS (PARTITION BY ctg ORDER BY line)"


def component_keys(spark, d):
    """how often paths use each kind of typed key."""
    r = numbered(spark, d).groupBy(F.col("ctg_nam").alias("path_id")).agg(F.transform(F.array_sort(F.collect_list(F.struct("node_id", "id", "chr_nam"))), lambda x: F.struct(x["id"].alias("node"), x["chr_nam"].alias("contig"))).alias("nodes"))
    return G.step_keys(r).groupBy("kind").agg(F.count("*").alias("n"), F.sum("a").alias("a"), F.sum("b").alias("b"))


SQL_component_keys = f"""WITH {SQL_ROWS}, s AS (SELECT ctg * 8 + line AS id, ctg, chr, lag(ctg * 8 + line) OVER w AS p, lag(chr) OVER w AS pc, lead(line) OVER w IS NULL AS last FROM r WINDOW w AS (PARTITION BY ctg ORDER BY line)),
k AS (SELECT 'TEL' AS kind, id AS a, NULL AS b FROM s WHERE p IS NULL OR last UNION ALL SELECT CASE WHEN chr = pc THEN 'CTG_IN' ELSE 'BND' END, least(p, id), greatest(p, id) FROM s WHERE p IS NOT NULL)
SELECT kind, count(*) AS n, CAST(sum(a) AS BIGINT) AS a, CAST(sum(b) AS BIGINT) AS b FROM k GROUP BY kind"""


def paths_per_pair(spark, d):
    """At most two paths of each pair of ends, the shortest first."""
    o = table(spark, d, "orders").select((F.col("o_custkey") % 40).alias("src"), F.col("o_orderpriority").alias("dst"), F.length("o_orderstatus").alias("length"), F.array(F.col("o_orderkey")).alias("nodes"))
    return P.bounded_pairs(o, 2).select("src", "dst", F.get("nodes", F.lit(0)).alias("node"))


SQL_paths_per_pair = "SELECT src, dst, node FROM (SELECT o_custkey % 40 AS src, o_orderpriority AS dst, o_orderkey AS node, row_number() OVER (PARTITION BY o_custkey % 40, o_orderpriority ORDER BY length(o_orderstatus), o_orderkey) AS k FROM orders) WHERE k <= 2"


def chain_components(spark, d):
    """Orders of a customer in chains of steps of at most 60 days: components over many steps."""
    o = table(spark, d, "orders").select("o_orderkey", "o_custkey", days("o_orderdate").alias("day"))
    w = Window.partitionBy("o_custkey").orderBy("day", "o_orderkey")
    e = o.withColumn("before", F.lag("o_orderkey").over(w)).withColumn("gap", F.col("day") - F.lag("day").over(w)).where("gap <= 60")
    return G.components(e.select(F.col("before").alias("a"), F.col("o_orderkey").alias("b")))


SQL_chain_components = """WITH o AS (SELECT o_orderkey, o_custkey, date_diff('day', DATE '1995-01-01', CAST(o_orderdate AS DATE)) AS day FROM orders), g AS (SELECT *, CASE WHEN day - lag(day) OVER w <= 60 THEN 0 ELSE 1 END AS new FROM o WINDOW w AS (PARTITION BY o_custkey ORDER BY day, o_orderkey)),
c AS (SELECT *, sum(new) OVER (PARTITION BY o_custkey ORDER BY day, o_orderkey ROWS UNBOUNDED PRECEDING) AS chain FROM g) SELECT id, component FROM (SELECT o_orderkey AS id, min(o_orderkey) OVER p AS component, count(*) OVER p AS n FROM c WINDOW p AS (PARTITION BY o_custkey, chain)) WHERE n > 1"""


def event_catalogue(spark, d):
    """Junction events of neighbours, with directions as read forwards."""
    r = followed(spark, d).where("id2 is not null")
    turned = F.col("node_id") % 2 == 0
    pairs = r.select(F.when(turned, F.col("id2")).otherwise(F.col("id")).alias("a"), F.when(turned, F.col("id")).otherwise(F.col("id2")).alias("b"), F.col("id").alias("ord"))
    return E.catalogue(pairs, numbered(spark, d).select(F.col("id").alias("node_id"), "chr_nam", "chr_str", "ctg_dir", "ctg_nam")).select("number", "lo", "hi", "start_chr", "start_pos", "start_dir", "end_chr", "end_pos", "end_dir")


SQL_event_catalogue = f"""WITH {_N}, p AS (SELECT *, line % 2 = 0 AS turned, CAST(row_number() OVER (ORDER BY id) AS INT) AS number FROM n WHERE line2 IS NOT NULL)
SELECT number, id AS lo, ctg * 8 + line2 AS hi, CASE WHEN turned THEN chr2 ELSE chr END AS start_chr, CASE WHEN turned THEN st2 ELSE st END AS start_pos, CASE WHEN turned THEN CASE dir2 WHEN '+' THEN '-' ELSE '+' END ELSE dir END AS start_dir,
CASE WHEN turned THEN chr ELSE chr2 END AS end_chr, CASE WHEN turned THEN st ELSE st2 END AS end_pos, CASE WHEN turned THEN CASE dir WHEN '+' THEN '-' ELSE '+' END ELSE dir2 END AS end_dir FROM p"""


def indel_calls(spark, d):
    """Indels of enough weight and length with their copy number."""
    r = numbered(spark, d).select("id", F.col("chr_str").alias("st"), F.col("chr_end").alias("nd"), F.col("q").cast("double").alias("weight"))
    return E.indel_calls(r, 8.0, 20.0, 30).select("id", "cn")


SQL_indel_calls = f"WITH {_N} SELECT id, q / CAST(8 AS DOUBLE) AS cn FROM n WHERE q > 20 AND nd - st >= 30"


def virtual_inversions(spark, d):
    """Inversion candidates that reads support."""
    r = followed(spark, d).where("id2 is not null")
    return E.virtual_inversions(
        r.select(
            F.col("id").alias("record"), (F.col("q") % 2 == 0).alias("a_spanned"), (F.col("q2") % 3 != 0).alias("b_spanned"), F.col("q").cast("double").alias("depth_a"), F.col("q2").cast("double").alias("depth_b"),
            (F.col("q") / 80).alias("vaf_a"), F.when(F.col("q2") % 5 != 0, F.col("q2") / 60).alias("vaf_b"), F.col("chr_nam").alias("chr_a"), F.col("chr_nam2").alias("chr_b"), F.col("chr_str").alias("pos_a"), F.col("chr_str2").alias("pos_b"),
        ), 0.25, 1.4
    )


SQL_virtual_inversions = f"""WITH {_N}, v AS (SELECT * FROM n WHERE line2 IS NOT NULL AND q % 2 = 0 AND q2 % 3 <> 0 AND greatest(q, q2) <= 1.4 * least(q, q2) AND greatest(q / 80, CASE WHEN q2 % 5 <> 0 THEN q2 / 60 ELSE 0 END) > 0.25)
SELECT id AS record, chr, least(st, st2) AS st, greatest(st, st2) AS nd FROM v WHERE chr = chr2 UNION ALL SELECT id, chr, st, st FROM v WHERE chr <> chr2 UNION ALL SELECT id, chr2, st2, st2 FROM v WHERE chr <> chr2"""


def visible_calls(spark, d):
    """Calls above a share of half the median depth."""
    return J.visible(numbered(spark, d), "q", 80.0, 0.9).select("id")


SQL_visible_calls = f"WITH {_N} SELECT id FROM n WHERE q > 36"


def removable_junctions(spark, d):
    """Junctions whose tiers vote for removal."""
    r = numbered(spark, d).select(
        "id", (F.col("q") % 2 == 0).alias("a_valid"), (F.col("q") % 3 == 0).alias("b_valid"), (F.col("q") % 5 == 0).alias("a_sat"), (F.col("q") % 7 == 0).alias("b_sat"), (F.col("node_id") % 3 + 1).alias("a_tier"), (F.col("q") % 4 + 1).alias("b_tier"),
        (F.col("ctg_nam") % 10 == 0).alias("is_virtual"),
    )
    return J.removal_tiers(r).select("id")


SQL_removable_junctions = f"""WITH {_N}, v AS (SELECT id, ctg, line % 3 + 1 AS ta, q % 4 + 1 AS tb, CAST(q % 2 = 0 OR q % 5 = 0 AS INT) + CAST(q % 3 = 0 OR q % 7 = 0 AS INT) AS n FROM n)
SELECT id FROM v WHERE ctg % 10 <> 0 AND CASE ta WHEN 1 THEN n <= 1 WHEN 2 THEN n = 0 ELSE false END AND CASE tb WHEN 1 THEN n <= 1 WHEN 2 THEN n = 0 ELSE false END"""


def synthetic_spans(spark, d):
    """reference spans of synthetic nodes at both kinds of ends."""
    r = numbered(spark, d)
    st, nd = J.endpoint_spans(F.col("chr_str") - 30, F.lit(2400).cast("long"), F.col("ctg_dir"), F.col("q") % 2 == 0, 50)
    return r.select("id", st.alias("st"), nd.alias("nd"))


SQL_synthetic_spans = f"""WITH {_N}, p AS (SELECT id, greatest(1, least(st - 30, 2400)) AS p, (dir = '+') = (q % 2 = 0) AS behind FROM n), s AS (SELECT id, CASE WHEN behind THEN greatest(0, p - 50) ELSE p END AS st, CASE WHEN behind THEN p ELSE least(2400, p + 50) END AS nd FROM p)
SELECT id, CASE WHEN nd <= st THEN greatest(st - 1, 0) ELSE st END AS st, CASE WHEN nd <= st THEN greatest(st, 1) ELSE nd END AS nd FROM s"""


def _ends(spark, d):
    o = table(spark, d, "orders")
    return o.select(F.col("o_orderkey").alias("event"), F.col("o_custkey").alias("chr1"), (F.col("o_custkey") % 7).alias("chr2"), days("o_orderdate").alias("pos1"), (days("o_orderdate") + F.col("o_orderkey") % 50).alias("pos2"),
                    F.when(F.col("o_orderstatus") == "F", "left").otherwise("right").alias("side1"), F.when(F.col("o_orderpriority") < "3", "left").otherwise("right").alias("side2"), F.col("o_totalprice").alias("depth"))


_SQL_ENDS = "e AS (SELECT o_orderkey AS event, o_custkey AS c, date_diff('day', DATE '1995-01-01', CAST(o_orderdate AS DATE)) AS p1, date_diff('day', DATE '1995-01-01', CAST(o_orderdate AS DATE)) + o_orderkey % 50 AS p2, o_orderstatus = 'F' AS l1, o_orderpriority < '3' AS l2, o_totalprice AS depth FROM orders)"


def reciprocal_ends(spark, d):
    """Junctions of a chromosome pair with other sides at both ends, both close."""
    return K.reciprocal_candidates(_ends(spark, d), 120)


SQL_reciprocal_ends = f"WITH {_SQL_ENDS} SELECT x.event AS a, y.event AS b FROM e x JOIN e y ON x.c = y.c AND x.l1 AND NOT y.l1 AND x.l2 <> y.l2 AND abs(x.p1 - y.p1) <= 120 AND abs(x.p2 - y.p2) <= 120"


def drops_of_opposites(spark, d):
    """L1: opposite junctions of nearly equal depth."""
    return K.opposite_drop(_ends(spark, d), 1_000_000.0, 200, 50_000.0, 0.05)


SQL_drops_of_opposites = f"WITH {_SQL_ENDS} SELECT least(x.event, y.event) AS a, greatest(x.event, y.event) AS b FROM e x JOIN e y ON x.c = y.c AND x.event < y.event AND x.l1 <> y.l1 AND x.l2 <> y.l2 AND abs(x.p1 - y.p1) <= 200 AND abs(x.p2 - y.p2) <= 200 WHERE abs(x.depth - y.depth) < 50000 AND greatest(x.depth, y.depth) >= 50000"


def droppable_events(spark, d):
    """Events none of whose sides has a step in depth."""
    r = rows(spark, d).select(F.col("ctg_nam").alias("event"), F.when(F.col("ctg_dir") == "+", "right").otherwise("left").alias("side"), F.when(F.col("q") % 11 != 0, (F.col("chr_str") % 100).cast("double")).alias("left_mean"), (F.col("chr_end") % 100).cast("double").alias("right_mean"),
                              (F.col("q") * 3).cast("double").alias("depth"), (F.col("q") == 7).alias("out_of_split"))
    return K.step_droppable(r, 0.25)


SQL_droppable_events = f"""WITH {SQL_ROWS} SELECT ctg AS event FROM r GROUP BY ctg HAVING bool_and(CASE WHEN q = 7 THEN true WHEN q % 11 = 0 THEN false ELSE (CASE WHEN dir = '+' THEN nd % 100 - st % 100 ELSE st % 100 - nd % 100 END) / (q * 3) < 0.25 END)"""


def same_customers(spark, d):
    """Whether tables hold the same rows."""
    o, c = table(spark, d, "orders").select(F.col("o_custkey").alias("k")), table(spark, d, "customer").select(F.col("c_custkey").alias("k"))
    return spark.createDataFrame([("orders", E.same_sets(o, c)), ("customer", E.same_sets(c, c.unionByName(c)))], "tables string, same boolean")


SQL_same_customers = "SELECT 'customer' AS tables, true AS same UNION ALL SELECT 'orders', NOT EXISTS (SELECT c_custkey FROM customer EXCEPT SELECT o_custkey FROM orders) AND NOT EXISTS (SELECT o_custkey FROM orders EXCEPT SELECT c_custkey FROM customer)"


def stepwise_contigs(spark, d):
    """contigs whose rows advance step by step."""
    r = rows(spark, d).groupBy("ctg_nam").agg(F.transform(F.array_sort(F.collect_list(F.struct("node_id", "chr_str", "chr_end"))), lambda x: F.struct(x["chr_str"].alias("st"), x["chr_end"].alias("nd"))).alias("i"))
    return r.select("ctg_nam", I.stepwise(F.col("i")).alias("stepwise"))


SQL_stepwise_contigs = f"""WITH {SQL_ROWS} SELECT ctg AS ctg_nam, bool_and(coalesce(ps IS NULL OR (st > ps AND nd > pe AND (bn IS NULL OR st >= bn)), true)) AS stepwise FROM (SELECT *, lag(st) OVER w AS ps, lag(nd) OVER w AS pe, lag(nd, 2) OVER w AS bn FROM r WINDOW w AS (PARTITION BY ctg ORDER BY line)) GROUP BY ctg"""


def spans_of_neighbours(spark, d):
    """inner and outer intervals of neighbours."""
    r = followed(spark, d).where("id2 is not null")
    i = I.inner_interval(*[F.col(c) for c in ("chr_str", "chr_end", "chr_str2", "chr_end2")])
    o = I.outer_interval(*[F.col(c) for c in ("chr_str", "chr_end", "chr_str2", "chr_end2")])
    return r.select("id", i[0].alias("i_st"), i[1].alias("i_nd"), o[0].alias("o_st"), o[1].alias("o_nd"))


SQL_spans_of_neighbours = f"WITH {_N} SELECT id, least(greatest(st, st2), least(nd, nd2)) AS i_st, greatest(greatest(st, st2), least(nd, nd2)) AS i_nd, least(st, st2) AS o_st, greatest(nd, nd2) AS o_nd FROM n WHERE line2 IS NOT NULL"


def divided(spark, d):
    """quotients, also by zero."""
    x = X.safe_divide(F.col("q") - 25, F.col("node_id") - 3)
    return numbered(spark, d).select("id", F.when(F.isnan(x), "nan").when(x > 1e300, "up").when(x < -1e300, "down").otherwise("number").alias("kind"), F.when(F.abs(x) < 1e300, F.round(x, 4)).alias("value"))


SQL_divided = f"WITH {_N} SELECT id, CASE WHEN line <> 3 THEN 'number' WHEN q > 25 THEN 'up' WHEN q < 25 THEN 'down' ELSE 'nan' END AS kind, CASE WHEN line <> 3 THEN round((q - 25) / CAST(line - 3 AS DOUBLE), 4) END AS value FROM n"


def segment_labels(spark, d):
    """labels of the first segments of contigs."""
    r = rows(spark, d).groupBy("ctg_nam").agg(F.transform(F.array_sort(F.collect_list(F.struct("node_id", "chr_nam", "chr_str", "chr_end"))), lambda x: F.struct(x["chr_nam"].alias("chr"), (x["chr_str"] - x["chr_str"] % 500).alias("st"), (x["chr_end"] - x["chr_end"] % 500).alias("nd"))).alias("s"))
    return r.select("ctg_nam", X.segments_text(F.col("s")).alias("text"))


SQL_segment_labels = f"""WITH {SQL_ROWS}, l AS (SELECT ctg, line, chr || ':' || (st - st % 500) || '-' || (nd - nd % 500) AS label FROM r), f AS (SELECT ctg, label, min(line) AS line FROM l GROUP BY ALL), k AS (SELECT *, row_number() OVER (PARTITION BY ctg ORDER BY line) AS k FROM f)
SELECT ctg AS ctg_nam, string_agg(label, '|' ORDER BY line) AS text FROM k WHERE k <= 3 GROUP BY ctg"""


def header_sources(spark, d):
    """callers and versions that header lines name."""
    c = table(spark, d, "customer").withColumn("name", F.element_at(F.array(*[F.lit(x) for x in ("Sniffles2_", "severus v", "other ", "NanomonSV-", "manta ")]), (F.col("c_custkey") % 5 + 1).cast("int")))
    line = F.when(F.col("c_custkey") % 7 == 0, F.concat(F.lit("##gripssVersion="), F.col("c_nationkey"))).when(F.col("c_custkey") % 7 == 1, F.concat(F.lit("##SOURCE="), "name")).otherwise(F.concat(F.lit("##source="), "name", F.col("c_custkey") % 9, F.lit("."), "c_nationkey", F.lit("-beta.7")))
    g = V.source_rows(c.select(line.alias("value")))
    return g.groupBy("in_source", "caller", F.array_join(F.coalesce("version", F.array()), ".").alias("version")).agg(F.count("*").alias("n"))


SQL_header_sources = """WITH c AS (SELECT c_custkey, c_nationkey, c_custkey % 7 AS m, CASE c_custkey % 5 WHEN 0 THEN 'sniffles2' WHEN 1 THEN 'severus' WHEN 3 THEN 'nanomonsv' WHEN 4 THEN 'manta' END AS name FROM customer)
SELECT m <> 0 AS in_source, CASE WHEN m = 0 THEN 'gripss' ELSE name END AS caller, CASE WHEN m = 0 THEN CAST(c_nationkey AS VARCHAR) WHEN m = 1 THEN '' ELSE (c_custkey % 9) || '.' || c_nationkey END AS version, count(*) AS n FROM c WHERE m = 0 OR name IS NOT NULL GROUP BY ALL"""


def _variants(spark, d):
    """Two breakend records of each order: all four forms of ALT, failing filters, absent contigs, alleles that disagree."""
    o = table(spark, d, "orders").select(F.col("o_orderkey").alias("k"), F.col("o_custkey").alias("c"))
    flip = lambda x: F.when(x == "+", "-").otherwise("+")
    o = o.withColumn("da", F.when(F.col("k") % 4 < 2, "+").otherwise("-")).withColumn("db", F.when(F.col("k") % 2 == 0, "+").otherwise("-"))
    o = o.withColumn("c1", F.concat(F.lit("c"), F.col("c") % 5)).withColumn("c2", F.concat(F.lit("c"), F.col("k") % 5)).withColumn("p1", F.col("k") * 10 + 1).withColumn("p2", F.col("k") * 10 + 1 + F.col("c") % 1000 * 1000)
    one = F.struct((F.col("k") * 2).alias("line"), F.col("c1").alias("chr"), F.col("p1").alias("pos"), F.concat(F.lit("a"), "k").alias("id"), E.bnd_alt(F.col("da"), F.col("db"), F.col("c2"), F.col("p2")).alias("alt"),
                   F.when(F.col("k") % 7 == 0, "LowQual").otherwise("PASS").alias("filter"), F.concat(F.lit("SVTYPE=BND;MATEID=b"), "k").alias("info"))
    wrong = F.when(F.col("k") % 11 == 0, F.col("db")).otherwise(flip(F.col("db")))
    two = F.struct((F.col("k") * 2 + 1).alias("line"), F.col("c2").alias("chr"), F.col("p2").alias("pos"), F.concat(F.lit("b"), "k").alias("id"), E.bnd_alt(wrong, flip(F.col("da")), F.col("c1"), F.col("p1")).alias("alt"),
                   F.when(F.col("k") % 5 == 0, "LowQual").otherwise("PASS").alias("filter"), F.concat(F.lit("MATEID=a"), "k", F.lit(";SVTYPE=BND")).alias("info"))
    lengths = spark.createDataFrame([(f"c{i}", 1 << 40) for i in range(4)], "chr string, len long")
    return E.normalise_breakends(o.select(F.explode(F.array(one, two)).alias("r")).select("r.*"), lengths=lengths)


_SQL_VAR = """v AS (SELECT *, CASE WHEN k % 7 = 0 THEN 'filtered' WHEN k % 5 = 0 THEN 'mate_filtered' WHEN c1 = 'c4' OR c2 = 'c4' THEN 'contig_absent' WHEN k % 11 = 0 THEN 'mate_direction' WHEN c1 = c2 AND da = db AND p2 - p1 < 100000 THEN 'small' END AS why FROM
(SELECT o_orderkey AS k, 'c' || (o_custkey % 5) AS c1, 'c' || (o_orderkey % 5) AS c2, o_orderkey * 10 + 1 AS p1, o_orderkey * 10 + 1 + o_custkey % 1000 * 1000 AS p2, CASE WHEN o_orderkey % 4 < 2 THEN '+' ELSE '-' END AS da, CASE WHEN o_orderkey % 2 = 0 THEN '+' ELSE '-' END AS db FROM orders))"""


def variant_junctions(spark, d):
    """Junctions of breakend pairs."""
    return _variants(spark, d)[0].select("line", "second", "chr", "pos", "dir_a", "mate_chr", "mate_pos", "dir_b")


SQL_variant_junctions = f"WITH {_SQL_VAR} SELECT k * 2 AS line, k * 2 + 1 AS second, c1 AS chr, p1 AS pos, da AS dir_a, c2 AS mate_chr, p2 AS mate_pos, db AS dir_b FROM v WHERE why IS NULL AND NOT (c1 = c2 AND da = db)"


def variant_jumps(spark, d):
    """Front and back jumps of breakend pairs on one chromosome."""
    return _variants(spark, d)[1].select("line", "svtype", "event_type", "chr", "st", "nd")


SQL_variant_jumps = f"WITH {_SQL_VAR} SELECT k * 2 AS line, 'BND' AS svtype, CASE WHEN da = '+' THEN 'front_jump' ELSE 'back_jump' END AS event_type, c1 AS chr, p1 AS st, p2 AS nd FROM v WHERE why IS NULL AND c1 = c2 AND da = db"


def variant_skips(spark, d):
    """Why records are skipped."""
    return _variants(spark, d)[2].select("line", "reason")


SQL_variant_skips = f"""WITH {_SQL_VAR} SELECT k * 2 AS line, why AS reason FROM v WHERE why IS NOT NULL
UNION ALL SELECT k * 2 + 1, CASE why WHEN 'filtered' THEN CASE WHEN k % 5 = 0 THEN 'filtered' ELSE 'mate_filtered' END WHEN 'mate_filtered' THEN 'filtered' ELSE why END FROM v WHERE why IS NOT NULL"""


def junction_opposites_30(spark, d):
    """Opposite junctions within 30 days."""
    return junction_queries.junction_opposites(spark, d, 30)


SQL_junction_opposites_30 = junction_queries.SQL_junction_opposites.replace("<= 8", "<= 30")


def records_behind_nodes(spark, d):
    """Input records behind variant nodes, by sanitised ids that hold underscores."""
    o = table(spark, d, "orders").select(F.col("o_orderkey").alias("k"))
    o = o.withColumn("next", F.lead("k").over(Window.orderBy("k")))
    raw = lambda k: F.when(k % 2 == 0, F.concat(F.lit("r 0/"), k)).otherwise(F.concat(F.lit("q"), k))
    sid = lambda k: V.sanitize_id(raw(k))
    kind = F.col("k") % 6
    mate = F.when(F.col("next").isNotNull(), F.concat(F.lit("_"), sid(F.col("next")))).otherwise("")
    node = (
        F.when(kind == 0, F.concat(F.lit("vcf_inv_"), sid(F.col("k")), F.when(F.col("k") % 4 == 0, "_left").otherwise("_right"))).when(kind == 1, F.concat(F.lit("vcf_bnd_"), sid(F.col("k"))))
        .when(kind.isin(2, 5), F.concat(F.lit("vcf_bnd_"), sid(F.col("k")), mate)).when(kind == 3, F.concat(F.lit("vcf_bnd_r_0_x"), "k")).otherwise(F.concat(F.lit("ctg"), "k"))
    )
    return E.records_of_nodes(o.select(node.alias("node")), o.select(F.col("k").cast("string").alias("key"), raw(F.col("k")).alias("id")))


SQL_records_behind_nodes = """WITH o AS (SELECT o_orderkey AS k, lead(o_orderkey) OVER (ORDER BY o_orderkey) AS nx FROM orders), n AS (SELECT *, CASE WHEN k % 2 = 0 THEN 'r_0_' ELSE 'q' END || k AS a, CASE WHEN nx % 2 = 0 THEN 'r_0_' ELSE 'q' END || nx AS b FROM o)
SELECT 'vcf_inv_' || a || CASE WHEN k % 4 = 0 THEN '_left' ELSE '_right' END AS node, 0 AS part, CAST(k AS VARCHAR) AS key FROM n WHERE k % 6 = 0 UNION ALL SELECT 'vcf_bnd_' || a, 0, CAST(k AS VARCHAR) FROM n WHERE k % 6 = 1
UNION ALL SELECT 'vcf_bnd_' || a || coalesce('_' || b, ''), 0, CAST(k AS VARCHAR) FROM n WHERE k % 6 IN (2, 5) UNION ALL SELECT 'vcf_bnd_' || a || '_' || b, 1, CAST(nx AS VARCHAR) FROM n WHERE k % 6 IN (2, 5) AND nx IS NOT NULL
UNION ALL SELECT 'vcf_bnd_r_0_x' || k, 0, 'r_0_x' || k FROM n WHERE k % 6 = 3"""


def misfit_rows(spark, d):
    """Q5: rows whose prediction is off by more than noise explains."""
    r = numbered(spark, d).withColumn("predicted", (F.col("q") - 20).cast("double")).withColumn("observed", (F.col("node_id") * 3).cast("double")).withColumn("out", F.col("ctg_nam") % 9 == 0)
    return Q.misfit_labels(r, "predicted", "observed", 6.0, "out").select("id", "label")


SQL_misfit_rows = f"WITH {_N} SELECT id, CASE WHEN ctg % 9 = 0 THEN 'excluded' WHEN abs(greatest(q - 20, 0) - line * 3) > 6 * 1.959963984540054 THEN 'misfit' ELSE 'fit' END AS label FROM n"


def nnls_optimality(spark, d):
    """Whether each weight of a non-negative fit is optimal: no negative ones, and gradients that are 0 where a weight
    isn't and nowhere below 0, from the predictions of the long matrix."""
    e = table(spark, d, "embeddings").where("size(embedding) >= 2")
    m = e.select(F.col("vec_id").cast("int").alias("bin"), F.posexplode(F.slice("embedding", F.lit(1), F.size("embedding") - 1)).alias("col", "value")).withColumn("value", F.col("value").cast("double"))
    t = e.select(F.col("vec_id").cast("int").alias("bin"), F.element_at("embedding", -1).cast("double").alias("value"))
    w = cut(L.fit(m, t, tol=1e-12), "weights")
    p = M.predict(m, w)
    off = t.join(p.withColumnRenamed("value", "_p"), "bin", "left").select("bin", (F.coalesce("_p", F.lit(0.0)) - F.col("value")).alias("value"))
    size = M.right_side(m.withColumn("value", F.abs("value")), t.withColumn("value", F.abs("value"))).withColumnRenamed("value", "_size")
    g = M.right_side(m, off).join(size, "col").join(w, "col")
    small = 1e-4 * F.col("_size")
    return g.select("col", ((F.col("w") >= 0) & (F.col("value") >= -small) & ((F.col("w") == 0) | (F.col("value") <= small))).alias("optimal"))


SQL_nnls_optimality = "SELECT CAST(unnest(range(0, most - 1)) AS INT) AS col, true AS optimal FROM (SELECT max(len(embedding)) AS most FROM embeddings)"


def unique_event_names(spark, d):
    """names of events that no two lines share."""
    o = table(spark, d, "orders").select(F.col("o_orderkey").alias("line"), F.concat(F.lit("vcf_bnd_"), V.sanitize_id(F.concat(F.lit("c:"), F.col("o_custkey") % 50, F.when(F.col("o_orderkey") % 97 == 0, F.concat(F.lit("_L"), F.col("o_orderkey") + 1)).otherwise("")))).alias("base"))
    return V.unique_names(o, "base", "line").select("line", "name")


SQL_unique_event_names = """WITH o AS (SELECT o_orderkey AS line, 'vcf_bnd_c_' || (o_custkey % 50) || CASE WHEN o_orderkey % 97 = 0 THEN '_L' || (o_orderkey + 1) ELSE '' END AS base FROM orders), c AS (SELECT line, base, line = min(line) OVER (PARTITION BY base) AS first FROM o),
n AS (SELECT line, first, CASE WHEN first THEN base ELSE base || '_L' || line END AS name FROM c) SELECT line, name || CASE WHEN k > 1 THEN '_' || k ELSE '' END AS name FROM (SELECT *, row_number() OVER (PARTITION BY name ORDER BY first DESC, line) AS k FROM n)"""


def all_nation_paths(spark, d):
    """R2: simple paths of one to three steps over the edges of all pairs of nations."""
    e = event_queries.nation_edges(spark, d, 24)
    p = G.simple_paths(e, e.select(F.col("src").alias("node")).distinct(), e.select(F.col("dst").alias("node")).distinct(), 3)
    return p.select("src", "dst", F.array_join(F.transform("nodes", lambda x: x.cast("string")), ">").alias("path"))


SQL_all_nation_paths = event_queries.SQL_simple_paths_k.replace("k <= 3", "k <= 24")


# files, written and read back


def _file(spark: SparkSession, lines: DataFrame, order: list[str], name: str) -> str:
    """One part of text lines (line) in order."""
    path = new_folder(spark, name)
    lines.repartitionByRange(1, *order).sortWithinPartitions(*order).select("line").write.text(path)
    return path


def depth_round_trip(spark, d):
    """Depth windows, without those of chrM."""
    r = numbered(spark, d).select(F.when(F.col("q") == 1, "chrM").otherwise(F.col("chr_nam")).alias("chr"), F.col("id").alias("st"), F.col("chr_end").alias("nd"), F.col("q").alias("length"), (F.col("q") - 1).alias("covsite"), (F.col("q") * 2.5).alias("totaldepth"), F.lit(0.5).alias("cov"), (F.col("q") / 4).alias("meandepth"))
    path = new_folder(spark, "depth")
    W.write_depth(r, path)
    return R.read_depth(spark, path)


SQL_depth_round_trip = f"WITH {_N} SELECT chr, id AS st, nd, q AS length, q - 1 AS covsite, q * CAST(2.5 AS DOUBLE) AS totaldepth, CAST(0.5 AS DOUBLE) AS cov, q / CAST(4 AS DOUBLE) AS meandepth FROM n WHERE q <> 1"


def paf_round_trip(spark, d):
    """Alignments of some length, with their tags."""
    r = numbered(spark, d).select(F.col("ctg_nam").cast("string").alias("qname"), F.when(F.col("q") % 6 == 0, 0).otherwise(900).cast("long").alias("qlen"), F.lit(0).cast("long").alias("qst"), F.when(F.col("q") % 10 == 0, 0).otherwise(F.col("q")).alias("qnd"), F.col("ctg_dir").alias("strand"), F.col("chr_nam").alias("tname"),
                                  F.lit(9999).cast("long").alias("tlen"), F.col("chr_str").alias("tst"), F.col("chr_end").alias("tnd"), F.col("q").alias("matches"), F.when(F.col("q") % 7 == 0, 0).otherwise(F.col("id")).alias("block"), (F.col("q") % 61).cast("int").alias("mapq"),
                                  F.array(F.lit("tp:A:P"), F.concat(F.lit("xi:Z:P_"), "id")).alias("tags"), F.when(F.col("q") % 9 != 0, F.concat("q", F.lit("M"))).alias("cigar"))
    path = new_folder(spark, "paf")
    W.write_paf(r, path, "cigar")
    back = R.query_rows(R.read_paf(spark, path, strict=True))
    return back.select("qname", "qst", "qnd", "mapq", "origin_kind", "origin_row")


SQL_paf_round_trip = f"WITH {_N} SELECT CAST(ctg AS VARCHAR) AS qname, CAST(0 AS BIGINT) AS qst, q AS qnd, CAST(q % 61 AS INT) AS mapq, 'P' AS origin_kind, id AS origin_row FROM n WHERE q % 6 <> 0 AND q % 10 <> 0 AND q % 7 <> 0 AND q % 9 <> 0"


def bed_round_trip(spark, d):
    """Intervals that are long enough, past comments and empty lines."""
    r = numbered(spark, d)
    line = F.when(F.col("q") == 2, "# note").when(F.col("q") == 3, "").otherwise(F.concat_ws("\t", "chr_nam", "id", F.col("id") + F.col("q"), F.lit("x")))
    path = _file(spark, r.select("id", line.alias("line")), ["id"], "bed")
    return R.read_bed(spark, path, longer_than=20).select("chr", "st", "nd", "ord")


SQL_bed_round_trip = f"WITH {_N} SELECT chr, st, nd, ord FROM (SELECT chr, id AS st, id + q AS nd, q, row_number() OVER (ORDER BY id) - 1 AS ord FROM n) WHERE q > 20"


def fasta_lengths(spark, d):
    """Lengths of sequences counted from their lines, and those of an index."""
    s = table(spark, d, "supplier").select("s_suppkey", F.explode(F.sequence(F.lit(0), (F.col("s_suppkey") % 4).cast("int"))).alias("k"))
    line = F.when(F.col("k") == 0, F.concat(F.lit(">s"), "s_suppkey", F.lit(" of a supplier"))).otherwise(F.repeat(F.lit("A"), (F.col("s_suppkey") % 60).cast("int")))
    path = _file(spark, s.select("s_suppkey", "k", line.alias("line")), ["s_suppkey", "k"], "fasta")
    return R.read_fasta_lengths(spark, path)


SQL_fasta_lengths = "SELECT 's' || s_suppkey AS name, CAST((s_suppkey % 4) * (s_suppkey % 60) AS BIGINT) AS len FROM supplier"


def index_lengths(spark, d):
    """Names and lengths of a sequence index."""
    path = _file(spark, table(spark, d, "part").select("p_partkey", F.concat_ws("\t", F.concat(F.lit("c"), "p_partkey"), F.col("p_size") * 100, F.lit("7"), F.lit("60"), F.lit("61")).alias("line")), ["p_partkey"], "fai")
    return R.read_lengths(spark, path)


SQL_index_lengths = "SELECT 'c' || p_partkey AS chr, CAST(p_size * 100 AS BIGINT) AS len FROM part"


def telomere_sides(spark, d):
    """Telomere intervals by the half that they start in, widened inwards."""
    r = numbered(spark, d)
    bed = r.select(F.col("chr_nam").alias("chr"), F.col("chr_str").alias("st"), F.col("chr_end").alias("nd"), F.col("id").alias("ord"))
    lengths = spark.createDataFrame([(f"chr{k}", 2000 + 300 * k) for k in (1, 2, 3)], "chr string, len long")
    return R.telomeres(bed, lengths, 100).select("ord", "label", "st", "nd")


SQL_telomere_sides = f"WITH {_N}, l AS (SELECT *, 2000 + 300 * CAST(substr(chr, 4) AS INT) AS len FROM n) SELECT id AS ord, CASE WHEN st > len / 2 THEN 'b' ELSE 'f' END AS label, CASE WHEN st > len / 2 THEN greatest(st - 100, 0) ELSE st END AS st, CASE WHEN st > len / 2 THEN nd ELSE least(nd + 100, len) END AS nd FROM l"


def vcf_round_trip(spark, d):
    """Variant records written and read, with what can't be used."""
    o = table(spark, d, "orders")
    line = F.concat_ws("\t", F.concat(F.lit("c"), F.col("o_custkey") % 9), F.when(F.col("o_orderkey") % 10 == 0, "x").otherwise(F.col("o_orderkey").cast("string")), F.concat(F.lit("v"), "o_orderkey"), F.lit("N"), F.lit("<DEL>"), F.lit("."), F.lit("PASS"), F.concat(F.lit("SVTYPE=DEL;END="), F.col("o_orderkey") + 5))
    body = o.select(F.col("o_orderkey").alias("ord"), F.lit(0).alias("k"), F.when(F.col("o_orderkey") % 13 == 0, "short\tline").otherwise(line).alias("line"))
    path = new_folder(spark, "vcf")
    W.write_vcf(body, [("c1", 1000), ("c2", 2000)], path)
    records, contigs, source = R.read_vcf(spark, path)
    return records.select("chr", "pos", "id", V.optional_int(V.info_map(F.col("info"))["END"]).alias("end"), "fault", F.lit(source.caller is None and contigs.count() == 2).alias("plain"))


SQL_vcf_round_trip = """SELECT CASE WHEN s THEN 'short' ELSE 'c' || (c % 9) END AS chr, CASE WHEN NOT s AND k % 10 <> 0 THEN k END AS pos, CASE WHEN NOT s THEN 'v' || k END AS id, CASE WHEN NOT s THEN k + 5 END AS end, CASE WHEN s THEN 'fewer than 8 columns' WHEN k % 10 = 0 THEN 'bad position' END AS fault, true AS plain
FROM (SELECT o_orderkey AS k, o_custkey AS c, o_orderkey % 13 = 0 AS s FROM orders)"""


def tsv_round_trip(spark, d):
    """K3, K8: a tab-separated table with a mark for null."""
    path = new_folder(spark, "tsv")
    W.write_tsv(numbered(spark, d).select("id", F.when(F.col("q") % 3 != 0, F.col("chr_nam")).alias("chr"), "q"), path)
    return spark.read.option("sep", "\t").option("header", True).option("nullValue", "*").schema("id long, chr string, q long").csv(path)


SQL_tsv_round_trip = f"WITH {_N} SELECT id, CASE WHEN q % 3 <> 0 THEN chr END AS chr, q FROM n"


def json_round_trip(spark, d):
    """K9: a summary as JSON."""
    path = new_folder(spark, "json")
    W.write_json(rows(spark, d).groupBy(F.col("chr_nam").alias("chr")).agg(F.count("*").alias("n"), F.sum("q").alias("total")), path)
    return spark.read.schema("chr string, n long, total long").json(path)


SQL_json_round_trip = f"WITH {SQL_ROWS} SELECT chr, count(*) AS n, CAST(sum(q) AS BIGINT) AS total FROM r GROUP BY chr"


def artifact_round_trip(spark, d):
    """A table of a run directory."""
    path = new_folder(spark, "run")
    W.write_artifact(numbered(spark, d).select("id", "q"), path, "weights")
    return R.read_artifact(spark, path, "weights").where(F.lit(R.read_artifact(spark, path, "absent", required=False) is None))


SQL_artifact_round_trip = f"WITH {_N} SELECT id, q FROM n"


def matrix_round_trip(spark, d):
    """The part of a written matrix that selected columns hold."""
    path = new_folder(spark, "matrix")
    m = numbered(spark, d).select((F.col("q") % 20).cast("int").alias("col"), F.col("id").alias("bin"), F.col("q").cast("double").alias("value"))
    W.write_matrix(m, m.groupBy("bin").agg(F.sum("value").alias("value")), path)
    return W.read_matrix(spark, path, spark.createDataFrame([(3,), (4,), (4,), (99,)], "col int"))


SQL_matrix_round_trip = f"WITH {_N} SELECT CAST(q % 20 AS INT) AS col, id AS bin, CAST(q AS DOUBLE) AS value FROM n WHERE q % 20 IN (3, 4)"


def report_round_trip(spark, d):
    """Chromosomes that a read report excludes."""
    c = table(spark, d, "customer")
    path = new_folder(spark, "report")
    side = lambda k: F.when(F.col("c_custkey") % k != 0, F.concat(F.lit("n"), "c_nationkey"))
    flag = lambda k: F.when(F.col("c_custkey") % k == 0, "TRUE").when(F.col("c_custkey") % k == 1, "0").otherwise("false")
    W.write_tsv(c.select(side(3).alias("chrom_a"), side(4).alias("chrom_b"), flag(50).alias("point_a_no_spanning_rawread"), flag(70).alias("point_b_no_spanning_rawread")), path)
    return R.excluded_chromosomes(R.read_report(spark, path))


SQL_report_round_trip = "SELECT 'n' || c_nationkey AS chr FROM customer WHERE c_custkey % 50 = 0 AND c_custkey % 3 <> 0 UNION SELECT 'n' || c_nationkey FROM customer WHERE c_custkey % 70 = 0 AND c_custkey % 4 <> 0"


def query_spans(spark, d):
    """Reference spans and rows of queries."""
    p = numbered(spark, d).select(F.col("ctg_nam").alias("qname"), F.col("chr_nam").alias("tname"), F.col("chr_str").alias("tst"), F.col("chr_end").alias("tnd"), F.col("id").alias("line"))
    return R.query_spans(p).select("qname", "chr", "st", "nd", F.array_join(F.transform("rows", lambda x: x.cast("string")), ",").alias("rows"))


SQL_query_spans = f"WITH {_N} SELECT ctg AS qname, arg_min(chr, id) AS chr, min(st) AS st, max(nd) AS nd, string_agg(CAST(id AS VARCHAR), ',' ORDER BY id) AS rows FROM n GROUP BY ctg"


def limits_round_trip(spark, d):
    """limits of the path search, recorded and read."""
    path = new_folder(spark, "limits")
    limits.save_limits(spark, path, 3, 5)
    return spark.createDataFrame([limits.load_limits(spark, path)], "chr_limit int, dir_limit int")


SQL_limits_round_trip = "SELECT 3 AS chr_limit, 5 AS dir_limit"


_NAMES = [n for n in list(globals()) if n.startswith("SQL_") and n != "SQL_ROWS"]
ORACLE = {n[4:]: globals()[n] for n in _NAMES}
QUERIES = {n: globals()[n] for n in ORACLE}
