import itertools
import random

import pytest
from pyspark.sql import functions as F

from strandweave.functions import intervals as I
from strandweave.operators import ordered as O
from strandweave.operators import range_join as R


def brute(kind, a, b, c, d):
    return {
        "closed": not (b < c or a > d),
        "half_open": a < d and c < b,
        "half_open_point": (c <= a < d) if a == b else (a < d and c < b),
        "contained": c <= a and b <= d,
        "contains": a <= c and d <= b,
        "strictly_inside": c < a and b < d,
        "strictly_spans": a < c and b > d,
    }[kind]


@pytest.fixture(scope="module")
def sides(spark):
    rng = random.Random(3)
    make = lambda n, w: [(i, f"c{rng.randrange(3)}", s := rng.randrange(200), s + rng.choice([0, 1, 5, w])) for i in range(n)]
    left, right = make(120, 40), make(60, 70)
    return left, right, spark.createDataFrame(left, "id long, chr string, st long, nd long"), spark.createDataFrame(right, "rid long, chr string, r_st long, r_nd long")


@pytest.mark.parametrize("kind", I.KINDS)
@pytest.mark.parametrize("width", [7, 64])
def test_range_join_equals_nested_loops(kind, width, sides):
    left, right, a, b = sides
    want = {(x[0], y[0]) for x, y in itertools.product(left, right) if x[1] == y[1] and brute(kind, x[2], x[3], y[2], y[3])}
    got = [(r.id, r.rid) for r in R.range_join(a, b, ["chr"], kind, width).collect()]
    assert len(got) == len(set(got)) and set(got) == want
    ids = {x for x, _ in want}
    assert {r.id for r in R.range_join(a, b, ["chr"], kind, width, how="left_semi").collect()} == ids
    assert {r.id for r in R.range_join(a, b, ["chr"], kind, width, how="left_anti").collect()} == {x[0] for x in left} - ids
    assert R.range_join(a, b, ["chr"], kind, width, how="left").count() == len(want) + len(left) - len(ids)


def test_merge_is_idempotent_and_covers(sides):
    _, _, a, _ = sides
    m = O.merge_intervals(a, ["chr"]).cache()
    again = O.merge_intervals(m, ["chr"])
    assert sorted(map(tuple, m.select("chr", "st", "nd").collect())) == sorted(map(tuple, again.select("chr", "st", "nd").collect()))
    points = {(r.chr, p) for r in a.collect() for p in range(r.st, r.nd)}
    assert points == {(r.chr, p) for r in m.collect() for p in range(r.st, r.nd)}


def test_array_predicates(spark):
    d = spark.createDataFrame([(1, [(0, 5), (3, 9), (5, 12)]), (2, [(0, 5), (3, 9), (4, 12)]), (3, [(0, 5)]), (4, [(3, 5), (3, 9)])], "id int, iv array<struct<st:long,nd:long>>")
    assert {r.id: r.ok for r in d.select("id", I.stepwise(F.col("iv")).alias("ok")).collect()} == {1: True, 2: False, 3: True, 4: False}
    e = spark.createDataFrame([(1, [(0, 5), (8, 10)], [(-3, 4), (9, 30)]), (2, [(0, 5), (8, 10)], [(4, 9)])], "id int, s array<struct<st:long,nd:long>>, a array<struct<st:long,nd:long>>")
    assert {r.id: r.ok for r in e.select("id", I.each_within(F.col("a"), F.col("s")).alias("ok")).collect()} == {1: True, 2: False}


def test_empty_and_null_spans(spark):
    a = spark.createDataFrame([(1, "c", None, 5), (2, "c", 9, 3), (3, None, 1, 2)], "id long, chr string, st long, nd long")
    b = spark.createDataFrame([("c", 0, 10)], "chr string, r_st long, r_nd long")
    assert R.range_join(a, b, ["chr"], "half_open", 4).count() == 0
    assert R.range_join(a, b, ["chr"], "half_open", 4, how="left_anti").count() == 3
    assert R.range_join(a, b.limit(0), ["chr"], "closed", 4).count() == 0


def test_single_runs(spark):
    ok = spark.createDataFrame([(1, 1, "a"), (1, 2, "a"), (1, 3, "b")], "g int, o int, v string")
    assert O.require_single_runs(ok, ["g"], ["o"], "v").count() == 3
    bad = ok.union(spark.createDataFrame([(1, 4, "a")], "g int, o int, v string"))
    with pytest.raises(Exception, match="comes back"):
        O.require_single_runs(bad, ["g"], ["o"], "v").collect()
