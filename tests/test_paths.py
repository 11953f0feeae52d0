import pytest
from pyspark.sql import functions as F

from strandweave.operators import paths as P
from strandweave.plans import limits


def test_expansion(spark):
    nodes = spark.createDataFrame([(1, "c", 0, 10, "+", ":10"), (2, "c", 5, 20, "+", ":15"), (3, "c", 30, 40, "+", ":10"), (4, "d", 50, 60, "-", ":10"), (5, "d", 45, 53, "-", ":8")], "node long, chr string, st long, nd long, dir string, cs string")
    p = spark.createDataFrame([("p", [1, 2, 3, 4, 5])], "path_id string, nodes array<long>")
    got = [(r.kind, r.chr, r.st, r.nd, r.cs) for r in P.expand(p, nodes).orderBy("step").collect()]
    assert got == [("node", "c", 0, 8, ":8"), ("node", "c", 8, 20, ":12"), ("gap", "c", 20, 30, None), ("node", "c", 30, 40, ":10"), ("node", "d", 51, 60, ":9"), ("node", "d", 45, 51, ":6")]


def test_index_and_usage(spark):
    p = spark.createDataFrame([(1, 9, [1, 5, 9], 3.0), (1, 9, [1, 9], 2.0), (2, 9, [2, 9], 1.0)], "src long, dst long, nodes array<long>, length double")
    i = P.path_index(p)
    assert {r.path_id: len(r.nodes) for r in i.collect()} == {"1_9_1": 2, "1_9_2": 3, "2_9_1": 2}
    assert P.bounded_pairs(p, 1).count() == 2
    typed = i.select("path_id", F.transform("nodes", lambda n: F.struct(n.alias("node"), (n % 4).cast("string").alias("contig"))).alias("nodes"))
    keys, n = P.component_usage(typed)
    assert keys.where("kind = 'TEL'").count() == 3 and n.agg(F.sum("cnt")).first()[0] == 2 * 3 + 2 + 1 + 1


def test_similar_compositions(spark):
    rows = [("a", 0, "c1", 100), ("a", 0, "c2", 50), ("b", 1, "c1", 105), ("b", 1, "c2", 52), ("d", 2, "c1", 200), ("d", 2, "c2", 50), ("e", 3, "c1", 100)]
    c = spark.createDataFrame(rows, "path_id string, ord int, chr string, amount long")
    assert {r.path_id: r.kept for r in P.similar_compositions(c, 10).collect()} == {"a": True, "b": False, "d": True, "e": True}


def test_rescued(spark):
    nodes = spark.createDataFrame([(1, "q", 0, 5), (2, "q", 5, 9), (3, "z", 0, 1)], "node_id long, ctg_nam string, ctg_str long, ctg_end long")
    got = P.rescued_junctions(spark.createDataFrame([("q",), ("z",)], "query_name string"), nodes).collect()
    assert [(r.event, r.a_id, r.b_id) for r in got] == [("rescue_q", 1, 2)]


def test_limits(spark, tmp_path):
    limits.save_limits(spark, str(tmp_path / "l"), 3, 1)
    assert limits.load_limits(spark, str(tmp_path / "l")) == (3, 1)
    for bad in ("x", "[]", '{"chr": 1}', '{"chr": true, "dir": 1}', '{"chr": -1, "dir": 1}'):
        with pytest.raises(ValueError):
            limits.parse_limits(bad)
