import math
import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from strandweave.operators import cascade as K
from strandweave.operators import contigs as T
from strandweave.operators import events as E
from strandweave.operators import graph as G
from strandweave.operators import leaders as D
from strandweave.operators import solver as L
from strandweave.operators import stats as Q


def system(spark, a, b):
    m = spark.createDataFrame([(j, i, float(a[i, j])) for i in range(a.shape[0]) for j in range(a.shape[1]) if a[i, j]], "col int, bin int, value double")
    t = spark.createDataFrame([(i, float(v)) for i, v in enumerate(b)], "bin int, value double")
    return m, t


def test_nnls_is_optimal(spark):
    rng = np.random.default_rng(1)
    a, b = rng.normal(size=(40, 7)), rng.normal(size=40)
    a[:, 6] = a[:, 0]  # collinear columns
    m, t = system(spark, a, b)
    n = L.normal_equations(m, t)
    assert np.allclose(n.gram, a.T @ a) and np.allclose(n.right, a.T @ b)
    x = L.bounded_least_squares(n, tol=1e-9)
    assert (x >= 0).all() and L.optimality_gap(n, x) < 1e-5
    warm = L.bounded_least_squares(n, start=x)
    assert abs(L.squared_error(n, warm) - L.squared_error(n, x)) < 1e-8
    y = L.bounded_least_squares(n, lower=-0.1, upper=0.1)
    assert (np.abs(y) <= 0.1 + 1e-12).all()
    errors = {r.candidate: r.error for r in L.removal_errors(spark, n, {"one": [1], "two": [2, 3]}, x).collect()}
    keep = [0, 2, 3, 4, 5, 6]
    assert abs(errors["one"] - L.squared_error(n.subset(keep), L.bounded_least_squares(n.subset(keep)))) < 1e-6


def test_tv_minimises():
    rng = np.random.default_rng(2)
    for n, lam in ((1, 1.0), (2, 0.3), (30, 0.7), (30, 50.0), (25, 0.0)):
        y = rng.normal(size=n).cumsum()
        x = Q.tv_denoise_values(y, lam)
        cost = lambda v: 0.5 * ((v - y) ** 2).sum() + lam * np.abs(np.diff(v)).sum()  # noqa: E731, B023
        for _ in range(200):
            assert cost(x) <= cost(x + rng.normal(size=n) * rng.choice([1e-3, 0.1])) + 1e-9
    assert np.allclose(Q.tv_denoise_values(np.array([1.0, 5.0, 3.0]), 100), 3.0)


def brute_p(a, b):
    import itertools

    u = lambda x, y: sum((p > q) + 0.5 * (p == q) for p in x for q in y)
    both, n = [*a, *b], len(a)
    mid, own = len(a) * len(b) / 2, u(a, b)
    every = [u([both[i] for i in c], [both[i] for i in range(len(both)) if i not in c]) for c in itertools.combinations(range(len(both)), n)]
    return min(1.0, 2 * sum(v >= mid + abs(own - mid) - 1e-9 for v in every) / len(every))


def test_rank_sum_exact_and_normal():
    rng = random.Random(5)
    for n, m in ((3, 4), (5, 5), (1, 6)):
        v = rng.sample(range(100), n + m)
        assert abs(Q.mann_whitney(v[:n], v[n:]) - brute_p(v[:n], v[n:])) < 1e-9
    assert math.isnan(Q.mann_whitney([1, 1, 1], [1, 1]))
    assert Q.mann_whitney(list(range(50)), list(range(100, 150))) < 1e-6


def test_split_merging(spark):
    flat = [("flat", i * 10, i * 10 + 10, 5.0 + i % 3) for i in range(40)]
    step = [("step", a, z, v + (50 if a >= 200 else 0)) for _, a, z, v in flat]
    short = [("short", 0, 10, 1.0), ("short", 10, 20, 9.0)]
    windows = spark.createDataFrame([*flat, *step, *short, *[("kept", *r[1:]) for r in flat]], "chr string, st long, nd long, depth double")
    splits = [("flat", 100.0, False), ("flat", 200.0, False), ("flat", 390.0, False), ("step", 200.0, False), ("step", 300.0, False), ("kept", 200.0, True), ("short", 10.0, False)]
    got = {(r.chr, r.pos): r.merged for r in Q.merge_splits(spark.createDataFrame(splits, "chr string, pos double, fixed boolean"), windows).collect()}
    # 390 is tested last: by then its left side reaches back to 0, its right side is one window
    assert got == {("flat", 100.0): True, ("flat", 200.0): True, ("flat", 390.0): False, ("step", 200.0): False, ("step", 300.0): True, ("kept", 200.0): False, ("short", 10.0): False}


def test_highpass_removes_the_level():
    t = np.arange(400)
    x = 7 + np.sin(t * 2.5)
    y = Q.butterworth_highpass(x, 0.05, 1.0)
    assert abs(y.mean()) < 0.02 and abs(y[50:-50].std() - np.sin(t * 2.5)[50:-50].std()) < 0.02


def test_leaders_follow_order(spark):
    rows = [("c", i, float(p)) for i, p in enumerate([0, 8, 15, 30, 22])]
    d = spark.createDataFrame(rows, "chr string, ord int, pos double")
    got = {r.ord: r.leader for r in D.greedy_leaders(d, ["chr"], ["ord"], ["pos"], 10).collect()}
    assert got == {0: 0, 1: 0, 2: 1, 3: 2, 4: 1}
    back = {r.ord: r.leader for r in D.greedy_leaders(d.withColumn("neg", -F.col("ord")), ["chr"], ["neg"], ["pos"], 10).collect()}
    assert back != got  # order decides, as documented


def test_aligned_match_and_clusters():
    a, b = [("1+", 10), ("2+", 5)], [("2+", 5), ("1+", 10)]
    assert D.max_aligned_match(a, a) == 15 and D.max_aligned_match(a, b) == 10 and D.max_aligned_match(a, []) == 0
    paths = [("p", 1.0, 3, a), ("q", 2.0, 1, a), ("r", 5.0, 2, b)]
    assert D.karyotype_clusters(paths, 2.5) == [("q", 3.0, ["p", "q"]), ("r", 5.0, ["r"])]


def test_simple_paths_equal_recursion(spark):
    rng = random.Random(7)
    e = spark.createDataFrame(list({(rng.randrange(7), rng.randrange(7)) for _ in range(16)}), "src long, dst long").where("src <> dst")
    nodes = spark.range(7).withColumnRenamed("id", "node")
    e.createOrReplaceTempView("e_paths")
    want = sorted((r.src, r.dst, tuple(r.nodes)) for r in G.recursive_paths_sql(spark, "e_paths", 3).collect())
    got = sorted((r.src, r.dst, tuple(r.nodes)) for r in G.simple_paths(e, nodes, nodes, 3).collect())
    assert got == want
    with pytest.raises(G.TooManyPaths):
        G.simple_paths(e, nodes, nodes, 3, total=1)


def test_limit_search():
    def attempt(c, d):
        if c > 2:
            raise G.TooManyPaths
        return (c * 10, None)

    assert G.limit_search(4, False, attempt, 1000)[0] == (2, 1)
    assert G.limit_search(4, True, attempt, 1000)[0] == (2, 1)
    assert G.limit_search(4, True, attempt, 5)[0] == (2, 1)


def test_connectivity(spark):
    ends = spark.createDataFrame([(1, "a", "f", "+", "c", 500, 600), (2, "b", "f", "-", "c", 100, 200), (3, "b", "b", "-", "c", 900, 950)], "node long, contig string, role string, strand string, chr string, st long, nd long")
    got = {tuple(r) for r in G.connectivity(ends).collect()}
    assert got == {(G.BAK, 1, G.FOR, 2), (G.BAK, 2, G.FOR, 1)}  # f+ beyond f-


def test_connectivity_of_all_kinds(spark):
    """Every pair of kinds of ends, before, after and overlapping: what faces each other connects."""
    rows, spans = [], [(100, 200), (500, 600), (550, 650)]
    for k, (role, strand, span) in enumerate((r, s, x) for r in "fb" for s in "+-" for x in spans):
        rows += [(2 * k, "a", role, strand, "c", *span), (2 * k + 1, "b", role, strand, "c", *span)]
    got = {tuple(r) for r in G.connectivity(spark.createDataFrame(rows, "node long, contig string, role string, strand string, chr string, st long, nd long")).collect()}
    want = set()
    for n, c, r, s, _, st, nd in rows:
        for n2, c2, r2, s2, _, st2, nd2 in rows:
            up, up2 = (r == "b") == (s == "+"), (r2 == "b") == (s2 == "+")
            at, at2 = st if r == "f" else nd, st2 if r2 == "f" else nd2
            if c != c2 and up and not up2 and (at2 > at or max(st, st2) < min(nd, nd2)):
                leave, enter = {"f": G.BAK, "b": G.FOR}, {"f": G.FOR, "b": G.BAK}
                want |= {(leave[r], n, enter[r2], n2), (leave[r2], n2, enter[r], n)}
    assert got == want and want


def test_directions_mates_and_contigs_of_variants(spark):
    cols = "line long, chr string, pos long, id string, alt string, filter string, info string"
    rec = [
        (1, "c1", 1000, "a", "N]c2:5000]", "PASS", "SVTYPE=BND;STRANDS=+-;MATEID=b"), (2, "c2", 5000, "b", "N]c1:1000]", "PASS", "SVTYPE=BND;STRANDS=+-;MATEID=a"),
        (3, "c1", 2000, "c", "N[c2:7000[", "PASS", "SVTYPE=BND;STRANDS=++"), (4, "c2", 7000, "d", "]c1:2000]N", "PASS", "SVTYPE=BND;STRANDS=++"),
        (5, "c1", 3000, "e", "N[c2:8000[", "PASS", "SVTYPE=BND"), (6, "c2", 8000, "f", "]c1:3000]N", "PASS", "SVTYPE=BND;STRANDS=++"),
        (7, "c1", 4000, "g", "N[c2:9000[", "PASS", "SVTYPE=BND;STRANDS=++"), (8, "c2", 9000, "h", "N[c1:4000[", "PASS", "SVTYPE=BND;STRANDS=++"),
        (9, "c1", 10, "i", "N[cX:9[", "PASS", "SVTYPE=BND;STRANDS=++"), (10, "c1", 10, "j", "<INV>", "PASS", "SVTYPE=INV;END=900"), (11, "cX", 10, "k", "<DEL>", "PASS", "SVTYPE=DEL;END=900000"),
        (12, "c1", 50, "l", "odd", "PASS", "SVTYPE=BND"), (13, "c1", 60, "m", "<CNV>", "PASS", "SVTYPE=CNV"), (14, "c1", 10, "n", "<INV>", "PASS", "SVTYPE=INV"),
    ]
    d = spark.createDataFrame(rec, cols)
    lengths = spark.createDataFrame([("c1", 10**7), ("c2", 10**7)], "chr string, len long")
    rest = {7: "mate_direction", 8: "mate_direction", 9: "contig_absent", 11: "contig_absent", 12: "malformed", 13: "unsupported", 14: "no_end"}
    turns = [(10, "+", "-", "left"), (10, "-", "+", "right")]

    def run(*source):
        j, i, s = E.normalise_breakends(d, *source, lengths=lengths)
        assert not i.collect()
        return sorted((r.line, r.dir_a, r.dir_b, r.role) for r in j.collect()), {r.line: r.reason for r in s.collect()}

    assert run() == (sorted([(1, "+", "-", None), (3, "+", "+", None), (5, "+", "+", None), *turns], key=lambda x: x[:3]), rest)
    assert run("severus", (1, 7, 0)) == run()
    assert run("severus", (1, 6)) == (sorted([(1, "-", "+", None), (3, "+", "+", None), *turns], key=lambda x: x[:3]), rest | {5: "strands_missing", 6: "strands_missing"})
    assert run("severus")[0] == turns and {k: v for k, v in run("severus")[1].items() if v == "version_unknown"}.keys() == {1, 2, 3, 4, 5, 6, 7, 8}
    m = E.normalise_breakends(spark.createDataFrame([(1, "c1", 10, "i", "<INV>", "PASS", "SVTYPE=INV;END=90;INV5"), (2, "c1", 10, "i", "<INV>", "PASS", "SVTYPE=INV;END=90")], cols), "manta")
    assert [(r.line, r.role) for r in m[0].collect()] == [(1, "right")] and [r.line for r in m[2].collect()] == [2]
    header = spark.createDataFrame([("c1", 10**7), ("cY", 5)], "chr string, len long")
    assert [r.chr for r in E.check_contigs(header, lengths).collect()] == ["cY"]
    with pytest.raises(Exception, match="length differs"):
        E.check_contigs(spark.createDataFrame([("c1", 5)], "chr string, len long"), lengths).collect()


def test_gram_blocks_equal_the_product(spark, monkeypatch):
    from strandweave.operators import matrix as M
    from strandweave.operators import solver as L

    monkeypatch.setattr(M, "BLOCK", 4)
    monkeypatch.setattr(M, "ROWS_BYTES", 8 * 11 * 3)
    rng = np.random.default_rng(0)
    a, t = rng.normal(size=(40, 11)) * (rng.random((40, 11)) < 0.6), rng.normal(size=40)
    cells = [(int(j * 7), int(i), float(a[i, j])) for i in range(40) for j in range(11) if a[i, j]]
    n = L.normal_equations(spark.createDataFrame(cells, "col long, bin long, value double"), spark.createDataFrame([(i, float(v)) for i, v in enumerate(t)], "bin long, value double"))
    assert n.columns == [7 * j for j in range(11)] and np.allclose(n.gram, a.T @ a) and np.allclose(n.right, a.T @ t)
    assert np.allclose(n.subset([14, 0]).gram, (a.T @ a)[np.ix_([2, 0], [2, 0])])


def test_variant_pairs(spark):
    rec = [
        (1, "chr1", 1000, "a", "N[chr2:5000[", "PASS", "SVTYPE=BND;MATEID=b"), (2, "chr2", 5000, "b", "]chr1:1000]N", "PASS", "SVTYPE=BND;MATEID=a"),
        (3, "chr1", 2000, "c", "N[chr1:502000[", "PASS", "SVTYPE=BND"), (4, "chr1", 502000, "d", "]chr1:2000]N", "PASS", "SVTYPE=BND"),
        (5, "chr3", 10, "e", "<DEL>", "PASS", "SVTYPE=DEL;END=200010"), (6, "chr3", 10, "f", "<DEL>", "PASS", "SVTYPE=DEL;END=20"), (7, "chr3", 10, "g", "<DUP>", "LowQual", "SVTYPE=DUP;END=900000"),
        (8, "chr4", 5, "h", "N.", "PASS", "SVTYPE=BND"), (9, "chr5", 7, "i", "N[chr6:8[", "LowQual", "SVTYPE=BND"), (10, "chr6", 8, "j", "]chr5:7]N", "PASS", "SVTYPE=BND"),
    ]
    d = spark.createDataFrame(rec, "line long, chr string, pos long, id string, alt string, filter string, info string")
    j, i, s = E.normalise_breakends(d)
    assert [(r.line, r.second, r.mate_chr) for r in j.collect()] == [(1, 2, "chr2")]
    assert sorted((r.line, r.event_type, r.st, r.nd) for r in i.collect()) == [(3, "front_jump", 2000, 502000), (5, "front_jump", 10, 200010)]
    assert {r.line: r.reason for r in s.collect()} == {6: "small", 7: "filtered", 8: "single_breakend", 9: "filtered", 10: "mate_filtered"}


def test_catalogue_and_report(spark):
    nodes = spark.createDataFrame([(1, "chr1", 10, 20, "+", "k"), (2, "chr2", 30, 40, "-", "k")], "node_id long, chr_nam string, chr_str long, chr_end long, ctg_dir string, ctg_nam string")
    c = E.catalogue(spark.createDataFrame([(2, 1, 0)], "a long, b long, ord int"), nodes).first()
    assert (c.lo, c.hi, c.start_chr, c.start_dir, c.end_dir) == (1, 2, "chr2", "+", "-")
    with pytest.raises(Exception, match="twice"):
        E.catalogue(spark.createDataFrame([(2, 1, 0), (1, 2, 1)], "a long, b long, ord int"), nodes).collect()


def test_columns_may_not_come_back(spark):
    f = lambda rows, s: spark.createDataFrame(rows, s)
    ev, use = f([("e",)], "event string"), f([("e", 1, 1)], "event string, col int, cnt int")
    none = f([], "event string, reason string")
    with pytest.raises(ValueError, match="back"):
        E.next_reasons(ev, none, use, f([(1,)], "col int"), none, "base", previous_active=f([(2,)], "col int"))


def test_contig_types_and_trims(spark):
    cols = "ctg_nam string, node_id long, ctg_len long, ctg_dir string, chr_nam string, chr_str long, chr_end long, is_telo boolean, in_repeat boolean"
    rows = [("t", 1, 9, "+", "chr1", 0, 10, False, False), ("t", 2, 9, "+", "chr2", 0, 10, False, False), ("i", 3, 9, "+", "chr1", 0, 10, False, False), ("i", 4, 9, "-", "chr1", 20, 30, False, False),
            ("c", 5, 200000, "+", "chr1", 0, 10, False, False), ("c", 6, 200000, "+", "chr1", 10, 20, False, False), ("d", 7, 9, "+", "chr1", 0, 10, False, False), ("d", 8, 9, "+", "chr1", 500, 510, False, False),
            ("m", 9, 9, "+", "chrM", 0, 10, False, False), ("s", 10, 9, "+", "chr1", 0, 10, False, False)]
    got = {r.ctg_nam: r.ctg_typ for r in T.contig_types(spark.createDataFrame(rows, cols)).collect()}
    assert got == {"t": 1, "i": 2, "c": 3, "d": 4, "m": 0, "s": 3}
    tel = [("x", 1, "+", "chr1", "fin"), ("x", 2, "+", "chr1", None), ("x", 3, "+", "chr1", "b"), ("y", 4, "-", "chr1", "f"), ("y", 5, "+", "chr1", None)]
    out = T.trim_telomeres(spark.createDataFrame(tel, "ctg_nam string, node_id long, ctg_dir string, chr_nam string, telo_label string")).orderBy("node_id").collect()
    assert [(r.node_id, r.telo_connect) for r in out] == [(2, "chr1f"), (3, "chr1b"), (4, None), (5, None)]


def test_loops():
    fails = lambda active: {"s1"} if 1 not in active else set()
    loop = K.forbid_and_release(K.Loop({1, 2, 3}), {"s1": {1}, "s2": {2}}, fails, "X")
    assert loop.active == {1, 3} and loop.reasons == {"s2": "X"}
    loop = K.accumulate_failures(K.Loop({1, 2}), {"a": {1}, "b": {2}}, {"a": {"c1"}, "b": {"c2"}}, lambda act: {"c1"} if 1 not in act else set(), "Y")
    assert loop.active == {1} and loop.reasons == {"b": "Y"}
    assert K.swap_plan({"e": {5}}, {"c1": 9, "c2": 8}, {"e": {"c1"}}, {9, 8}) == ({5}, {9}, {"e"})


def test_failures_and_noise(spark):
    f = lambda v: spark.createDataFrame([("c", i, float(x)) for i, x in enumerate(v)], "chr string, st long, value double")
    base, obs = f([1, 1, 1]), f([1, 2, 1])
    assert [tuple(r) for r in K.fit_failures(f([1, 4, 1]), base, obs).collect()] == [("c", 3.0)]
    assert K.fit_failures(base, base, obs).count() == 0
    n = Q.noise_sigma(f([5.0] * 30).withColumn("run", F.lit(0)), "chr", "run", "st", "value").first()
    assert n.sigma == 1.0


def test_denoised_error_is_scale_free(spark):
    rng = np.random.default_rng(0)
    y = np.repeat([5.0, 9.0], 40) + rng.normal(size=80) * 0.1
    pdf = pd.DataFrame({"chr": "c", "st": np.arange(80) * 100, "o": y, "p": np.repeat([5.0, 9.0], 40)})
    e = Q.denoised_error(spark.createDataFrame(pdf), "chr", "st", "o", "p", 100).first()[0]
    assert 0 < e < 0.02
