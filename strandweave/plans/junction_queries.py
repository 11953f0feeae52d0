"""Contig, junction and reporting queries over the driver's tables.

Orders play contigs and their line items (one per line number) aligned rows: suppliers modulo 3 play chromosomes, ship
days positions, return flags strands.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandweave.functions import values as X
from strandweave.operators import aggregates as A
from strandweave.operators import cascade as K
from strandweave.operators import contigs as T
from strandweave.operators import events as E
from strandweave.operators import junctions as J
from strandweave.operators import matrix as M
from strandweave.operators import ordered as O
from strandweave.plans.interval_queries import days
from strandweave.runtime import table

_D = "date_diff('day', DATE '1995-01-01', CAST({} AS DATE))"
SQL_ROWS = (
    "r AS (SELECT l_orderkey AS ctg, l_linenumber AS line, CASE WHEN max(l_returnflag) = 'R' THEN '-' ELSE '+' END AS dir, 'chr' || (max(l_suppkey) % 3 + 1) AS chr, "
    + _D.format("max(l_shipdate)") + " AS st, " + _D.format("max(l_shipdate)") + " + CAST(max(l_quantity) AS BIGINT) AS nd, CAST(max(l_quantity) AS BIGINT) AS q FROM lineitem GROUP BY 1, 2)"
)


def rows(spark: SparkSession, d: str) -> DataFrame:
    l = table(spark, d, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.max("l_returnflag").alias("f"), F.max("l_suppkey").alias("k"), F.max("l_shipdate").alias("s"), F.max("l_quantity").alias("q"))
    return l.select(F.col("l_orderkey").alias("ctg_nam"), F.col("l_linenumber").alias("node_id"), F.when(F.col("f") == "R", "-").otherwise("+").alias("ctg_dir"), F.concat(F.lit("chr"), F.col("k") % 3 + 1).alias("chr_nam"),
                    days("s").alias("chr_str"), (days("s") + F.col("q").cast("long")).alias("chr_end"), F.col("q").cast("long").alias("q"))


def contig_types(spark, d):
    """Types of contigs; long, telomeric or single-row ones may be collinear."""
    r = rows(spark, d).withColumn("ctg_len", F.col("ctg_nam") % 1000).withColumn("is_telo", F.col("chr_str") < 40).withColumn("in_repeat", F.col("q") < 5)
    t = T.contig_types(r, bound=0.5, repeat_bound=0.9, least_length=500)
    return t.select("ctg_nam", "ctg_typ")


SQL_contig_types = f"""WITH {SQL_ROWS}, g AS (SELECT ctg, arg_min(dir, line) AS fd, arg_max(dir, line) AS ld, arg_min(chr, line) AS fc, arg_max(chr, line) AS lc, arg_min(st, line) AS fs, arg_min(nd, line) AS fe, arg_max(st, line) AS ls, arg_max(nd, line) AS le,
sum(nd - st) AS total, count(*) AS n, bool_or(st < 40) AS telo, arg_min(q, line) < 5 OR arg_max(q, line) < 5 AS rpt FROM r GROUP BY ctg),
h AS (SELECT *, CASE WHEN total = 0 THEN 1e9 ELSE (CASE WHEN fd = '+' THEN le - fs ELSE fe - ls END) / total END AS ratio FROM g)
SELECT ctg AS ctg_nam, CASE WHEN fc <> lc THEN 1 WHEN fd <> ld THEN 2 WHEN abs(ratio - 1) < CASE WHEN rpt THEN 0.9 ELSE 0.5 END THEN CASE WHEN ctg % 1000 > 500 OR telo OR n = 1 THEN 3 ELSE 0 END ELSE 4 END AS ctg_typ FROM h"""


def multi_end_filter(spark, d):
    """Contigs all of whose rows lie within 700 days of a chromosome end (length 2,500), over two ends at least."""
    r = rows(spark, d).withColumn("chr_len", F.lit(2500))
    return T.multi_end_contigs(r, 700)


SQL_multi_end_filter = f"""WITH {SQL_ROWS}, a AS (SELECT ctg, nd <= 700 AS f, st >= 1800 AS b, chr FROM r), e AS (SELECT ctg, count(*) FILTER (NOT f AND NOT b) AS bad, count(DISTINCT CASE WHEN f THEN chr || 'f' END) + count(DISTINCT CASE WHEN b THEN chr || 'b' END) AS ends FROM a GROUP BY ctg)
SELECT ctg AS ctg_nam FROM e WHERE bad = 0 AND ends >= 2"""


def terminal_trim(spark, d):
    """Rows of contigs left after leading and trailing ones of a quantity under 15 are taken off."""
    got = O.trim_ends(rows(spark, d), ["ctg_nam"], ["node_id"], F.col("q") < 15)
    return got.select("ctg_nam", "node_id")


SQL_terminal_trim = f"""WITH {SQL_ROWS}, b AS (SELECT ctg, min(line) FILTER (q >= 15) AS lo, max(line) FILTER (q >= 15) AS hi FROM r GROUP BY ctg) SELECT r.ctg AS ctg_nam, line AS node_id FROM r JOIN b ON r.ctg = b.ctg WHERE line BETWEEN lo AND hi"""


def clipped_pieces(spark, d):
    """Length of each row beyond all earlier ones of its contig and chromosome."""
    got = O.clipped_by_previous(rows(spark, d), ["ctg_nam", "chr_nam"], "chr_str", "chr_end")
    return got.groupBy("ctg_nam", "chr_nam").agg(F.sum("clipped").alias("clipped"))


SQL_clipped_pieces = f"""WITH {SQL_ROWS}, a AS (SELECT *, coalesce(max(nd) OVER (PARTITION BY ctg, chr ORDER BY st, nd ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), st) AS reach FROM r)
SELECT ctg AS ctg_nam, chr AS chr_nam, CAST(sum(greatest(0, nd - greatest(st, reach))) AS BIGINT) AS clipped FROM a GROUP BY ALL"""


def jump_classification(spark, d):
    """Deletions and duplications of contigs whose first and last rows share chromosome and strand, 100 days or more apart."""
    r = A.contig_ratio(rows(spark, d), "ctg_nam", "node_id")
    row = F.struct("chr_str", "chr_end")
    e = rows(spark, d).groupBy("ctg_nam").agg(F.min_by(row, "node_id").alias("f"), F.max_by(row, "node_id").alias("l")).join(r, "ctg_nam")
    k = E.classify_jump(F.col("first_chr"), F.col("last_chr"), F.col("first_dir"), F.col("last_dir"), F.col("f.chr_end"), F.col("l.chr_str"), 100)
    return e.select("ctg_nam", k.alias("kind")).where("kind is not null")


SQL_jump_classification = f"""WITH {SQL_ROWS}, g AS (SELECT ctg, arg_min(dir, line) AS fd, arg_max(dir, line) AS ld, arg_min(chr, line) AS fc, arg_max(chr, line) AS lc, arg_min(nd, line) AS p, arg_max(st, line) AS q FROM r GROUP BY ctg)
SELECT ctg AS ctg_nam, CASE WHEN (fd = '+') = (p < q) THEN 'front_jump' ELSE 'back_jump' END AS kind FROM g WHERE fc = lc AND fd = ld AND abs(p - q) >= 100"""


def inside_span_count(spark, d):
    """Distinct customers with an order day inside each supplier's first 40 days of each line item's window."""
    jumps = table(spark, d, "supplier").select(F.col("s_suppkey").alias("jump"), (F.col("s_nationkey") % 5).cast("string").alias("chr"), (F.col("s_suppkey") * 17 % 2000).alias("st"), (F.col("s_suppkey") * 17 % 2000 + 40).alias("nd"))
    o = table(spark, d, "orders")
    b = o.select(F.col("o_custkey").cast("string").alias("event"), (F.col("o_custkey") % 5).cast("string").alias("chr"), days("o_orderdate").alias("pos"))
    return J.inside_counts(jumps, b, 64).select("jump", "n_inside")


SQL_inside_span_count = f"""SELECT s_suppkey AS jump, count(DISTINCT o_custkey) AS n_inside FROM supplier LEFT JOIN orders ON o_custkey % 5 = s_nationkey % 5 AND {_D.format('o_orderdate')} BETWEEN s_suppkey * 17 % 2000 AND s_suppkey * 17 % 2000 + 40 GROUP BY 1"""


def tolerance_match(spark, d):
    """Orders, moved by up to four days, as graph edges: nearest order of their status and group within ten days at both ends."""
    o = table(spark, d, "orders").select("o_orderkey", F.col("o_orderstatus").alias("event_type"), (F.col("o_custkey") % 50).cast("string").alias("chr"), days("o_orderdate").alias("st"), (days("o_orderdate") + F.col("o_custkey") % 20).alias("nd"))
    shift = F.col("o_orderkey") % 5
    e = o.withColumn("st", F.col("st") + shift).withColumn("nd", F.col("nd") + shift).withColumnRenamed("o_orderkey", "edge")
    return E.match_edges(e, o.withColumnRenamed("o_orderkey", "event"), 10)


SQL_tolerance_match = f"""WITH o AS (SELECT o_orderkey, o_orderstatus AS t, o_custkey % 50 AS c, {_D.format('o_orderdate')} AS st, {_D.format('o_orderdate')} + o_custkey % 20 AS nd FROM orders),
e AS (SELECT o_orderkey, t, c, st + o_orderkey % 5 AS st, nd + o_orderkey % 5 AS nd FROM o),
j AS (SELECT a.o_orderkey AS edge, b.o_orderkey AS event, row_number() OVER (PARTITION BY a.o_orderkey ORDER BY abs(a.st - b.st) + abs(a.nd - b.nd), b.o_orderkey) AS k FROM e a JOIN o b ON a.t = b.t AND a.c = b.c AND abs(a.st - b.st) <= 10 AND abs(a.nd - b.nd) <= 10)
SELECT edge, event FROM j WHERE k = 1"""


def junction_opposites(spark, d, within: int = 8):
    """Junctions of customers' order pairs whose directions differ at both ends, both ends within 8 days."""
    o = table(spark, d, "orders").select(F.col("o_orderkey"), (F.col("o_custkey") % 2 + 1).alias("c1"), (F.col("o_custkey") % 3 + 1).alias("c2"), days("o_orderdate").alias("day"), (F.col("o_totalprice") % 2000).cast("long").alias("p"))
    j = o.select(F.col("o_orderkey").cast("string").alias("event"), (F.col("o_orderkey") * 2).alias("a_id"), F.concat(F.lit("chr"), "c1").alias("a_chr"), F.col("day").alias("a_st"), (F.col("day") + 3).alias("a_nd"), F.when(F.col("p") % 2 == 0, "+").otherwise("-").alias("a_dir"),
                 (F.col("o_orderkey") * 2 + 1).alias("b_id"), F.concat(F.lit("chr"), F.col("c2") + 10).alias("b_chr"), F.col("p").alias("b_st"), (F.col("p") + 3).alias("b_nd"), F.when(F.col("p") % 3 == 0, "+").otherwise("-").alias("b_dir"))
    return J.opposite_pairs(j, within)


SQL_junction_opposites = f"""WITH o AS (SELECT CAST(o_orderkey AS VARCHAR) AS event, o_custkey % 2 AS c1, o_custkey % 3 AS c2, {_D.format('o_orderdate')} AS s, CAST(trunc(o_totalprice % 2000) AS BIGINT) AS p FROM orders)
SELECT a.event AS x, b.event AS y FROM o a JOIN o b ON a.c1 = b.c1 AND a.c2 = b.c2 AND a.event < b.event AND (a.p % 2 = 0) <> (b.p % 2 = 0) AND (a.p % 3 = 0) <> (b.p % 3 = 0)
AND (abs(a.s - b.s) < 3 OR least(abs(b.s - a.s - 3), abs(b.s + 3 - a.s)) <= 8) AND (abs(a.p - b.p) < 3 OR least(abs(b.p - a.p - 3), abs(b.p + 3 - a.p)) <= 8)"""


def rescue_order(spark, d):
    """Columns in order: rescued first, then by falling score, then id."""
    p = table(spark, d, "part").select(F.col("p_partkey").alias("path_id"), (F.col("p_size") > 45).alias("is_rescue"), F.col("p_retailprice").alias("score"))
    return K.rescue_first(p).select("path_id", "col")


SQL_rescue_order = """SELECT p_partkey AS path_id, CAST(row_number() OVER (ORDER BY p_size > 45 DESC, p_retailprice DESC, p_partkey) - 1 AS INT) AS col FROM part"""


def amplicon_spans(spark, d):
    """Span and copy number of circuits made of each customer's orders."""
    o = table(spark, d, "orders")
    c = o.select(F.col("o_custkey").alias("circuit"), F.lit("chr1").alias("chr"), days("o_orderdate").alias("st"), (days("o_orderdate") + 2).alias("nd"))
    w = o.groupBy(F.col("o_custkey").alias("circuit")).agg(F.count("*").cast("double").alias("weight"))
    return E.amplicon_calls(c, w, 4.0, 8.0).select("circuit", "st", "nd", F.round("cn", 4).alias("cn"))


SQL_amplicon_spans = f"""SELECT o_custkey AS circuit, min({_D.format('o_orderdate')}) AS st, max({_D.format('o_orderdate')}) + 2 AS nd, round(count(*) / 4.0 * 2, 4) AS cn FROM orders GROUP BY 1 HAVING count(*) > 8"""


def copy_number_max(spark, d):
    """Largest copy number of each customer over orders."""
    return A.copy_numbers(table(spark, d, "orders"), ["o_custkey"], "o_totalprice", 1000.0).select("o_custkey", F.round("cn", 5).alias("cn"))


SQL_copy_number_max = "SELECT o_custkey, round(max(o_totalprice / 1000.0), 5) AS cn FROM orders GROUP BY 1"


def variant_lines(spark, d):
    """K4: breakend pairs and symbolic alleles as text, made of orders."""
    o = table(spark, d, "orders")
    j = o.where("o_orderstatus = 'F'").select(F.col("o_orderkey").alias("ord"), F.lit("chr1").alias("chr"), F.col("o_custkey").alias("pos"), F.when(F.col("o_orderkey") % 2 == 0, "+").otherwise("-").alias("dir_a"), F.lit("chr2").alias("mate_chr"), (F.col("o_custkey") + 5).alias("mate_pos"), F.when(F.col("o_orderkey") % 4 < 2, "+").otherwise("-").alias("dir_b"), (F.col("o_custkey") / 4).alias("cn"))
    i = o.where("o_orderstatus = 'O'").select(F.col("o_orderkey").alias("ord"), F.when(F.col("o_orderkey") % 2 == 0, "front_jump").otherwise("back_jump").alias("event_type"), F.lit("chr1").alias("chr"), F.col("o_custkey").alias("st"), (F.col("o_custkey") + 7).alias("nd"), F.lit(1.5).alias("cn"))
    return E.vcf_lines(j, i, "e")


SQL_variant_lines = r"""WITH o AS (SELECT *, CASE WHEN o_orderkey % 2 = 0 THEN '+' ELSE '-' END AS a, CASE WHEN o_orderkey % 4 < 2 THEN '+' ELSE '-' END AS b, printf('%.2f', o_custkey / 4) AS cn FROM orders),
m AS (SELECT *, CASE WHEN b = '+' THEN '[' ELSE ']' END AS k1, CASE WHEN a = '+' THEN ']' ELSE '[' END AS k2 FROM o WHERE o_orderstatus = 'F')
SELECT o_orderkey AS ord, 1 AS k, concat_ws(chr(9), 'chr1', o_custkey, 'e.' || o_orderkey || '.1', 'N', CASE WHEN a = '+' THEN 'N' ELSE '' END || k1 || 'chr2:' || (o_custkey + 5) || k1 || CASE WHEN a = '+' THEN '' ELSE 'N' END, '.', 'PASS', 'SVTYPE=BND;MATEID=e.' || o_orderkey || '.2;STRANDS=' || a || CASE WHEN b = '+' THEN '-' ELSE '+' END || ';CN=' || cn) AS line FROM m
UNION ALL SELECT o_orderkey, 2, concat_ws(chr(9), 'chr2', o_custkey + 5, 'e.' || o_orderkey || '.2', 'N', CASE WHEN b = '-' THEN 'N' ELSE '' END || k2 || 'chr1:' || o_custkey || k2 || CASE WHEN b = '-' THEN '' ELSE 'N' END, '.', 'PASS', 'SVTYPE=BND;MATEID=e.' || o_orderkey || '.1;STRANDS=' || CASE WHEN b = '+' THEN '-' ELSE '+' END || a || ';CN=' || cn) FROM m
UNION ALL SELECT o_orderkey, 1, concat_ws(chr(9), 'chr1', o_custkey, 'e.' || o_orderkey, 'N', CASE WHEN a = '+' THEN '<DEL>' ELSE '<DUP>' END, '.', 'PASS', 'SVTYPE=' || CASE WHEN a = '+' THEN 'DEL' ELSE 'DUP' END || ';END=' || (o_custkey + 7) || ';SVLEN=7;CN=1.50') FROM o WHERE o_orderstatus = 'O'"""


def bed_classes(spark, d):
    """K6: calls of parts as BED rows with their class and weight."""
    p = table(spark, d, "part").select(F.lit("chr1").alias("chr"), F.col("p_partkey").alias("st"), (F.col("p_partkey") + F.col("p_size") % 3).alias("nd"), F.col("p_type").alias("class"), F.col("p_size").cast("double").alias("weight"))
    return E.bed_lines(p, 8.0).select("chr", "st", "nd", "class", F.col("n").cast("string").alias("n"))


SQL_bed_classes = """SELECT 'chr1' AS chr, p_partkey AS st, greatest(p_partkey + p_size % 3, p_partkey + 1) AS nd, p_type AS class, CAST(round_even(p_size / 8.0, 2) AS VARCHAR) AS n FROM part"""


def path_label_parse(spark, d):
    """F8: two chromosome ends in canonical order."""
    n = table(spark, d, "nation").select("n_nationkey", X.path_labels(F.concat(F.lit("chr"), F.col("n_nationkey") % 9 + 1, F.when(F.col("n_nationkey") % 2 == 0, "f").otherwise("b"), F.lit("_chr"), F.col("n_nationkey") % 5 + 1, F.lit("f"))).alias("p"))
    return n.select("n_nationkey", "p.*")


SQL_path_label_parse = """WITH n AS (SELECT n_nationkey, 'chr' || (n_nationkey % 9 + 1) AS c1, CASE WHEN n_nationkey % 2 = 0 THEN 'f' ELSE 'b' END AS e1, 'chr' || (n_nationkey % 5 + 1) AS c2, 'f' AS e2 FROM nation)
SELECT n_nationkey, CASE WHEN (c1, e1) <= (c2, e2) THEN c1 ELSE c2 END AS first_chr, CASE WHEN (c1, e1) <= (c2, e2) THEN e1 ELSE e2 END AS first_end, CASE WHEN (c1, e1) <= (c2, e2) THEN c2 ELSE c1 END AS second_chr, CASE WHEN (c1, e1) <= (c2, e2) THEN e2 ELSE e1 END AS second_end FROM n"""


def flag_parse(spark, d):
    """Flags and numbers in text form."""
    e = table(spark, d, "events").select("event_id", F.when(F.col("event_id") % 5 == 0, " True").when(F.col("event_id") % 5 == 1, "0").when(F.col("event_id") % 5 == 2, "FALSE ").when(F.col("event_id") % 5 == 3, "1").otherwise("maybe").alias("t"), F.when(F.col("event_id") % 3 == 0, "inf").otherwise(F.col("value").cast("string")).alias("v"))
    return e.select("event_id", X.flag(F.col("t")).alias("flag"), X.optional_double(F.col("v")).alias("number"))


SQL_flag_parse = """SELECT event_id, CASE event_id % 5 WHEN 0 THEN true WHEN 1 THEN false WHEN 2 THEN false WHEN 3 THEN true END AS flag, CASE WHEN event_id % 3 = 0 THEN NULL ELSE value END AS number FROM events"""


def prior_scales(spark, d):
    """Scales of the prior of normal columns: vector components as columns, those under 32 as base."""
    e = table(spark, d, "embeddings").select(F.col("vec_id").alias("bin"), F.posexplode("embedding").alias("col", "value")).withColumn("value", F.col("value").cast("double"))
    cols = e.select("col").distinct().select("col", (F.col("col") < 32).alias("is_base"))
    return M.prior_rows(e, cols, 500, 0.01).select("col", F.round("scale", 6).alias("scale"))


SQL_prior_scales = """WITH e AS (SELECT unnest(generate_series(0, len(embedding) - 1)) AS col, embedding FROM embeddings), s AS (SELECT col, sum(pow(CAST(embedding[col + 1] AS DOUBLE), 2)) AS sq FROM e GROUP BY 1)
SELECT CAST(col AS INT) AS col, round(sqrt(0.01 * 500 / (SELECT sum(sq) FROM s WHERE col < 32) * sq), 6) AS scale FROM s"""


def fit_failure_ratio(spark, d):
    """Nations whose change from a baseline, by running sums over days, is over 1.5 of the baseline's misfit."""
    o = table(spark, d, "orders").join(table(spark, d, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    b = o.groupBy(F.col("c_nationkey").cast("string").alias("chr"), days("o_orderdate").alias("st")).agg(F.count("*").alias("n"), F.sum(F.col("o_custkey") % 7).alias("x"), F.sum(F.col("o_custkey") % 5).alias("y"))
    col = lambda c: b.select("chr", "st", F.col(c).cast("double").alias("value"))
    return K.fit_failures(col("x"), col("n"), col("y"), 1.5).select("chr", F.round("ratio", 6).alias("ratio"))


SQL_fit_failure_ratio = f"""WITH b AS (SELECT CAST(c_nationkey AS VARCHAR) AS chr, {_D.format('o_orderdate')} AS st, count(*) AS n, sum(o_custkey % 7) AS x, sum(o_custkey % 5) AS y FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY ALL),
r AS (SELECT chr, abs(sum(x - n) OVER w) AS u, abs(sum(n - y) OVER w) AS v FROM b WINDOW w AS (PARTITION BY chr ORDER BY st ROWS UNBOUNDED PRECEDING)), m AS (SELECT chr, max(u) AS u, max(v) AS v FROM r GROUP BY chr)
SELECT chr, round(u / v, 6) AS ratio FROM m WHERE v > 0 AND u / v > 1.5"""


def foreign_insert_runs(spark, d):
    """E5: stretches inside a contig on another chromosome than its ends, at least a fifth of it."""
    r = rows(spark, d).where("chr_end > chr_str").select(F.col("ctg_nam").alias("edge"), F.col("node_id").alias("row"), F.col("chr_nam").alias("chr"), F.lit("+").alias("strand"), F.col("chr_str").alias("st"), F.col("chr_end").alias("nd"))
    return E.foreign_inserts(r, 0.2).select("edge", "run", "chr", "length")


SQL_foreign_insert_runs = f"""WITH {SQL_ROWS}, a AS (SELECT *, nd - st AS len, sum(nd - st) OVER (PARTITION BY ctg) AS total, first_value(chr) OVER (PARTITION BY ctg ORDER BY line) AS fc, first_value(chr) OVER (PARTITION BY ctg ORDER BY line DESC) AS lc, CASE WHEN lag(chr) OVER (PARTITION BY ctg ORDER BY line) <> chr THEN 1 ELSE 0 END AS new FROM r WHERE nd > st),
b AS (SELECT *, sum(new) OVER (PARTITION BY ctg ORDER BY line ROWS UNBOUNDED PRECEDING) AS run FROM a) SELECT ctg AS edge, CAST(run AS BIGINT) AS run, any_value(chr) AS chr, CAST(sum(len) AS BIGINT) AS length FROM b GROUP BY ctg, run, fc, lc, total HAVING any_value(chr) <> fc AND any_value(chr) <> lc AND sum(len) >= 0.2 * total"""


_NAMES = [n for n in list(globals()) if n.startswith("SQL_") and n != "SQL_ROWS"]
ORACLE = {n[4:]: globals()[n] for n in _NAMES}
QUERIES = {n: globals()[n] for n in ORACLE}
