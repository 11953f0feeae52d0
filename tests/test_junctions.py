import random

from pyspark.sql import functions as F

from strandweave.operators import events as E
from strandweave.operators import junctions as J
from strandweave.operators import range_join as R
from strandweave.plans import contig_pipeline


def frame(spark, rows):
    cols = "event string, a_id long, a_chr string, a_st long, a_nd long, a_dir string, b_id long, b_chr string, b_st long, b_nd long, b_dir string"
    return spark.createDataFrame(rows, cols)


def joined_rows(p):
    """Rows that the largest join of an executed plan made."""
    kids = [p.children().apply(i) for i in range(p.children().size())] or ([p.plan()] if p.getClass().getSimpleName().endswith("QueryStageExec") else [])
    own = [p.metrics().apply("numOutputRows").value()] if p.metrics().contains("numOutputRows") and "Join" in p.nodeName() else []
    return max(own + [joined_rows(k) for k in kids], default=0)


def test_satellite_pruning(spark):
    j = frame(spark, [("x", 1, "chr1", 100, 200, "+", 2, "chr2", 100, 200, "+"), ("y", 3, "chr1", 150, 250, "-", 4, "chr2", 150, 250, "-"), ("z", 5, "chr3", 1, 9, "+", 6, "chr4", 1, 9, "+"), ("w", 7, "chr1", 1, 9, "+", 8, "chr1", 50, 90, "-")])
    j = j.withColumn("a_sat", F.lit(True)).withColumn("b_sat", F.col("event") != "z").withColumn("a_mapq", F.lit(60)).withColumn("b_mapq", F.lit(60)).withColumn("a_telo_sat", F.lit(False)).withColumn("b_telo_sat", F.lit(False))
    assert {(r.x, r.y) for r in J.opposite_pairs(j, 100).where("x in ('x', 'y')").collect()} >= {("x", "y")}
    none = spark.createDataFrame([], "chr string, dir boolean")
    assert {r.event for r in J.prune_satellite_pairs(j, none, within=100).collect()} == {"z"}
    alone = j.where("event = 'x'")
    assert J.prune_satellite_pairs(alone, none).count() == 1
    against = spark.createDataFrame([("chr1", True)], "chr string, dir boolean")
    assert J.prune_satellite_pairs(alone, against).count() == 0


def test_conjoined_and_rescued(spark):
    j = frame(spark, [("p", 1, "chr1", 0, 1000, "+", 2, "chr1", 20_000_000, 20_001_000, "-"), ("q", 3, "chr1", 20_100_000, 20_101_000, "-", 4, "chr1", 9_000_000, 9_001_000, "+")])
    got = J.conjoined_jumps(j).collect()
    assert {(r.x, r.y, r.kind) for r in got} == {("p", "q", "deletion")}
    t = frame(spark, [("t", 9, "chr1", 20_050_000, 20_060_000, "+", 10, "chr7", 5, 9, "+")])
    assert {(r.event, r.side) for r in J.rescued_by_templates(j, t).collect()} == {("p", "b")}


def test_jump_support(spark):
    jumps = spark.createDataFrame([(1, "c", 1_000_000, 2_000_000, "deletion"), (2, "c", 1_000_000, 2_000_000, "insertion"), (3, "c", 5_000_000, 6_000_000, "deletion")], "jump int, chr string, st long, nd long, kind string")
    depth = spark.createDataFrame([("c", s, s + 100_000, 10.0 if 1_000_000 <= s < 2_000_000 else 30.0) for s in range(0, 4_000_000, 100_000)], "chr string, st long, nd long, meandepth double")
    none = spark.createDataFrame([], "chr string, st long, nd long")
    assert {r.jump: r.reason for r in J.depth_supported(jumps, depth, none, 15.0, 0.5).collect()} == {1: "pass", 2: "step", 3: "missing_depth"}
    sat = spark.createDataFrame([("c", 999_000, 1_001_000)], "chr string, st long, nd long")
    assert J.depth_supported(jumps.where("jump = 1"), depth, sat, 15.0, 0.5).first().reason == "endpoint_satellite"
    ratios = spark.createDataFrame([(1, "c", 900_000, 1_500_000, 2.0), (2, "c", 2_000_000, 2_500_000, 2.0), (3, "c", 0, 500_000, -1.0), (4, "c", 0, 5, -1.0)], "jump int, chr string, st long, nd long, ratio double")
    assert {r.jump: r.kind for r in J.jump_candidates(ratios, sat, 100_000).collect()} == {1: "deletion", 3: "insertion"}
    ends = spark.createDataFrame([("a", "c", 1_000_000), ("a", "c", 1_200_000), ("b", "c", 1_300_000)], "event string, chr string, pos long")
    assert {r.jump: r.n_inside for r in J.inside_counts(jumps, ends).collect()} == {1: 2, 2: 2, 3: 0}
    assert J.is_absent(depth.withColumn("meandepth", F.lit(0.0)), "c", none) and not J.is_absent(depth, "c", none)


def test_synthetic_nodes(spark):
    j = spark.createDataFrame([(1, "v1", "chr1", 50, "+", "chr2", 1, "-")], "ord int, name string, chr string, pos long, dir_a string, mate_chr string, mate_pos long, dir_b string")
    lens = spark.createDataFrame([("chr1", 1000), ("chr2", 1000)], "chr string, len long")
    got = J.synthetic_nodes(j, lens, 7, flank=100).orderBy("node_id").collect()
    assert [(r.node_id, r.chr_nam, r.chr_str, r.chr_end) for r in got] == [(7, "chr1", 0, 50), (8, "chr2", 0, 1)]
    assert J.missing_telomeres(lens, spark.createDataFrame([("chr1", "f")], "chr string, side string")).count() == 3


def test_inversions_and_tiers(spark):
    r = spark.createDataFrame([(1, "c", 5, 90, {"INV3": None}), (2, "c", 5, 90, {}), (3, "c", 5, None, {"INV5": None})], "line int, chr string, pos long, end long, m map<string,string>")
    made, skipped = J.inversion_junctions(r, "manta")
    assert [(x.line, x.role) for x in made.collect()] == [(1, "left")] and {x.line: x.reason for x in skipped.collect()} == {2: "missing_inv3_inv5", 3: "no_end"}
    assert J.inversion_junctions(r)[0].count() == 4
    t = spark.createDataFrame([(1, True, False, 1, 1, False), (2, False, False, 2, 2, False), (3, True, False, 2, 1, False), (4, False, False, 3, 1, False), (5, False, False, 1, 1, True)], "event int, a_valid boolean, b_valid boolean, a_tier int, b_tier int, is_virtual boolean")
    t = t.withColumn("a_sat", F.lit(False)).withColumn("b_sat", F.lit(False))
    assert {x.event for x in J.removal_tiers(t).collect()} == {1, 2}


def test_clusters(spark):
    j = frame(spark, [("a", 1, "chr1", 90, 100, "+", 2, "chr2", 5000, 5100, "+"), ("b", 3, "chr1", 95, 99, "+", 4, "chr2", 5050, 5150, "+"), ("c", 5, "chr1", 95, 99, "+", 6, "chr2", 900_000, 900_100, "+"), ("d", 7, "chr2", 5000, 5100, "-", 8, "chr1", 90, 100, "-")])
    cen = spark.createDataFrame([("chr1", 100, 200)], "chr string, left long, right long")
    got = {r.event: r.master for r in J.satellite_clusters(j, cen, 1000).collect()}
    assert got["a"] == "a" and got["b"] == "a" and got["c"] == "c" and got["d"] == "a"


def test_contig_pipeline(spark):
    cols = "node_id long, ctg_nam string, ctg_len long, ctg_dir string, chr_nam string, chr_len long, chr_str long, chr_end long, ctg_mapq long, ctg_censat string"
    n = 10_000_000
    rows = [(1, "t", 9000, "+", "chr1", n, 2_000_000, 2_010_000, 60, "0"), (2, "t", 9000, "+", "chr2", n, 3_000_000, 3_010_000, 60, "0"), (3, "u", 9000, "+", "chr1", n, 4_000_000, 4_010_000, 60, "0"), (4, "u", 9000, "-", "chr3", n, 5_000_000, 5_010_000, 60, "0"),
            (5, "m", 9, "+", "chr1", n, 0, 10, 60, "0"), (6, "m", 9, "+", "chr2", n, 0, 10, 60, "0")]
    tel = spark.createDataFrame([("chr1", 0, 5000, 0, "f")], "chr string, st long, nd long, ord long, label string")
    rep = spark.createDataFrame([], "chr string, st long, nd long, ord long")
    out = contig_pipeline.run(spark.createDataFrame(rows, cols), tel, rep)
    assert {(r.event, r.a_id, r.b_id) for r in out["junctions"].collect()} == {("t", 1, 2), ("u", 3, 4)}
    edges = {tuple(r) for r in out["edges"].collect()}
    assert (0, 1, 0, 2) in edges and (1, 4, 1, 3) in edges


def test_opposites_equal_nested_loops(spark):
    rng, rows = random.Random(5), []
    for k in range(260):
        a, b = rng.randrange(300), rng.randrange(300)
        n, m = rng.choice([0, 3, 9, 400 if k % 40 == 0 else 5]), rng.choice([0, 3, 9, 700 if k % 50 == 0 else 5])
        rows.append((f"e{k % 250}", 2 * k, "chr1", a, a + n, rng.choice("+-"), 2 * k + 1, f"chr{rng.randrange(2, 4)}", b, b + m, rng.choice("+-")))
    far = lambda p, q, r, s: 0 if max(p, r) < min(q, s) else min(abs(r - q), abs(s - p))
    for within in (0, 7, 30):
        want = sorted((x[0], y[0]) for x in rows for y in rows if x[0] < y[0] and x[7] == y[7] and x[5] != y[5] and x[10] != y[10] and far(*x[3:5], *y[3:5]) <= within and far(*x[8:10], *y[8:10]) <= within)
        assert want and sorted(map(tuple, J.opposite_pairs(frame(spark, rows), within).collect())) == want
    unplaced = [("x", 1, "chr1", 5, 9, "+", 2, "chr2", None, None, "+"), ("y", 3, "chr1", 5, 9, "-", 4, "chr2", 5, 9, "-")]
    assert J.opposite_pairs(frame(spark, unplaced), 7).count() == 0


def test_opposites_of_equal_spans_meet_once(spark):
    """Many junctions on few spans: the grid joins spans, in pieces of seven events, and every pair of events comes out."""
    rng = random.Random(6)
    places = [("chr1", a := rng.randrange(60), a + 3, rng.choice("+-"), "chr2", b := rng.randrange(60), b + 3, rng.choice("+-")) for _ in range(12)]
    rows = [(f"e{k % 590}", 2 * k, *places[k % 12][:4], 2 * k + 1, *places[k % 12][4:]) for k in range(600)]
    far = lambda p, q, r, s: 0 if max(p, r) < min(q, s) else min(abs(r - q), abs(s - p))
    want = sorted((x[0], y[0]) for x in rows for y in rows if x[0] < y[0] and x[5] != y[5] and x[10] != y[10] and far(*x[3:5], *y[3:5]) <= 30 and far(*x[8:10], *y[8:10]) <= 30)
    got = J.opposite_pairs(frame(spark, rows), 30, together=7)
    assert len(want) > 10_000 and sorted(map(tuple, got.collect())) == want
    assert 0 < joined_rows(got._jdf.queryExecution().executedPlan().finalPhysicalPlan()) < len(want) / 10


def test_opposites_meet_at_both_ends(spark):
    """A thousand junctions that share one end only: hardly a pair comes up for comparison."""
    n = spark.range(1000).select(F.lit("c").alias("c"), (F.col("id") * 100).alias("p"), F.lit(5).alias("q"))
    y = n.select("c", (F.col("p") + 40).alias("u"), F.col("q").alias("v"))
    box = lambda p, q: ((F.col(q), F.col(q) + 3), (F.col(p), F.col(p) + 3))
    assert R.box_candidates(n, y, ["c"], box("p", "q"), box("u", "v"), (15, 15)).count() < 1000
    assert R.box_candidates(n, y, ["c"], box("p", "q"), box("u", "v"), (15, 200)).count() >= 1000


def test_inside_counts_equal_nested_loops(spark):
    rng = random.Random(9)
    jumps = [(k % 45, rng.choice("cd"), s := rng.randrange(100), s + rng.choice([0, 4, 30, -1])) for k in range(50)]
    ends = [(rng.choice([*"abcdefgh", None]), rng.choice(["c", "d", None]), rng.choice([rng.randrange(120), None])) for _ in range(150)]
    want = sorted((j, s, n, len({e for e, c, p in ends for i, d, a, b in jumps if i == j and e and c == d and p is not None and a <= p <= b})) for j, _, s, n in jumps)
    a, b = spark.createDataFrame(jumps, "jump int, chr string, st long, nd long"), spark.createDataFrame(ends, "event string, chr string, pos long")
    assert sorted((r.jump, r.st, r.nd, r.n_inside) for r in J.inside_counts(a, b, 16).collect()) == want


def test_inside_counts_meet_equal_spans_once(spark):
    """Two thousand equal jumps over two thousand equal breakends: no join makes a row of each pair."""
    a = spark.range(2000).select(F.col("id").alias("jump"), F.lit("c").alias("chr"), F.lit(5).alias("st"), F.lit(9).alias("nd"))
    b = spark.range(2000).select(F.col("id").alias("event"), F.lit("c").alias("chr"), F.lit(7).alias("pos"))
    got = J.inside_counts(a, b)
    assert got.where("n_inside = 2000").count() == 2000

    got.collect()
    assert 0 < joined_rows(got._jdf.queryExecution().executedPlan().finalPhysicalPlan()) <= 2000


def test_match_edges_by_distinct_spans(spark):
    rng = random.Random(4)
    made = lambda n: [(rng.randrange(n * 9 // 10), rng.choice("FO"), "c", s := rng.randrange(60), s + rng.randrange(6)) for _ in range(n)]
    edges, indels = made(60), made(400)
    gap = lambda e, i: (abs(e[3] - i[3]), abs(e[4] - i[4]))
    want = {e: min((sum(gap(x, i)), i[0]) for x in edges if x[0] == e for i in indels if i[1] == x[1] and max(gap(x, i)) <= 7)[1] for e in {x[0] for x in edges}}
    a, b = spark.createDataFrame(edges, "edge long, event_type string, chr string, st long, nd long"), spark.createDataFrame(indels, "event long, event_type string, chr string, st long, nd long")
    assert sorted(map(tuple, E.match_edges(a, b, 7).collect())) == sorted((x[0], want[x[0]]) for x in edges)
    many = spark.range(2000).select(F.col("id").alias("edge"), F.lit("F").alias("event_type"), F.lit("c").alias("chr"), F.lit(5).alias("st"), F.lit(9).alias("nd"))
    got = E.match_edges(many, many.withColumnRenamed("edge", "event"), 7)
    assert {r.event for r in got.collect()} == {0}
    assert 0 < joined_rows(got._jdf.queryExecution().executedPlan().finalPhysicalPlan()) <= 2000
