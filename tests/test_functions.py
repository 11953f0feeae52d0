import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from strandweave.functions import cs as C
from strandweave.functions import strands as S
from strandweave.functions import values as X
from strandweave.functions import vcf_text as V


def one(spark, *cols):
    return spark.range(1).select(*cols).first()


def test_cs(spark):
    t = F.lit("cs:Z::5*ag+tt-ccc:3:4")
    r = one(spark, C.cigar(t).alias("c"), C.stats(t).alias("s"), C.cigar(F.lit(":5?:3"), True).alias("bad"), C.cigar(F.lit(""), True).alias("none"), C.cigar(F.lit(":5:2"), True).alias("ok"))
    assert r.c == "5=1X2I3D7=" and tuple(r.s) == (12, 16) and r.bad is None and r.none is None and r.ok == "7="


def cs_strings():
    tok = st.one_of(st.integers(1, 9).map(lambda n: f":{n}"), st.sampled_from(["*ag", "*ct"]), st.text("acgt", min_size=1, max_size=4).map(lambda s: "+" + s), st.text("acgt", min_size=1, max_size=4).map(lambda s: "-" + s))
    return st.lists(tok, min_size=1, max_size=8).map("".join)


def lengths(cs):
    ref = query = 0
    for k, v in C.parse(cs):
        n = int(v) if k == ":" else 1 if k == "*" else len(v)
        ref += n if k != "+" else 0
        query += n if k != "-" else 0
    return ref, query


@settings(max_examples=200, deadline=None)
@given(cs_strings(), st.integers(0, 20))
def test_trims_take_what_they_say(cs, n):
    ref, query = lengths(cs)
    for trim in (C.trim_left, C.trim_right):
        text, r, q = trim(cs, n)
        assert r == min(n, ref)
        assert lengths(text) == (ref - r, query - q)


def test_split_overlap(spark):
    r = one(spark, C.split_overlap(F.lit(":10"), F.lit(":10"), F.lit(5)).alias("x")).x
    assert tuple(r) == (":8", 2, ":7", 3)


def test_variant_fields(spark):
    m = V.info_map(F.lit("A=1;FLAG;B=x=y;A=2"))
    r = one(spark, m.alias("m"), V.info_map(F.lit(".")).alias("e"), V.breakend_alt(F.lit("]chr1:5]N,x")).alias("a"), V.breakend_alt(F.lit("N[chr1:5]")).alias("bad"), V.breakend_alt(F.lit("<DEL>")).alias("sym"),
            V.is_single_breakend(F.lit("A.")).alias("s1"), V.is_single_breakend(F.lit(".")).alias("s2"), V.sanitize_id(F.lit("a b/c")).alias("i"), V.sanitize_id(F.lit(None).cast("string")).alias("u"), V.optional_int(F.lit("-3.7,2")).alias("n"))
    assert r.m == {"A": "2", "FLAG": None, "B": "x=y"} and r.e == {} and tuple(r.a) == ("chr1", 5, "-", "-", "suffix]") and r.bad is None and r.sym is None
    assert r.s1 and not r.s2 and r.i == "a_b_c" and r.u == "unknown" and r.n == -3


def test_sources(spark):
    def found(*lines):
        return V.detect_source(spark.createDataFrame([(x,) for x in lines], "value string"))

    assert found("##source=Sniffles2_2.0.7") == V.Source("sniffles2", (2, 0, 7))
    assert found("##source=Severus_v1.6", "##fileformat=VCFv4.2").version == (1, 6)
    assert found("##source=Severus_v1", "##source=Manta 2") == V.Source(None, None) and found("##source=Severus_v1", "##source=severus 2") == V.Source("severus", None)
    assert found("##gripssVersion=2.3.4") == V.Source("gripss", (2, 3, 4)) and found("##source=other") == V.Source(None, None) and found("##source=other", "##gripssVersion=2") == V.Source("gripss", (2,))
    assert found("##source=savana") == V.Source("savana", None) and found("##fileformat=VCFv4.2") == V.Source(None, None)
    assert V.padded((1, 6)) < V.padded((1, 7)) and not V.padded((1, 7, 0)) < V.padded((1, 7))


def test_strands(spark):
    d = spark.createDataFrame([("chr1", 5, "+", "chr2", 9, "-")], "c1 string, p1 long, d1 string, c2 string, p2 long, d2 string")
    a = F.struct(F.col("c1").alias("chr"), F.col("p1").alias("pos"), F.col("d1").alias("dir"))
    b = F.struct(F.col("c2").alias("chr"), F.col("p2").alias("pos"), F.col("d2").alias("dir"))
    flip = lambda x: F.struct(x["chr"].alias("chr"), x["pos"].alias("pos"), S.invert(x["dir"]).alias("dir"))
    r = d.select(S.canonical_pair(a, b).alias("x"), S.canonical_pair(flip(b), flip(a)).alias("y"), S.strands_of(F.lit("+"), F.lit("+")).alias("s"), S.dirs_of(F.lit("-+")).alias("d"), S.dirs_of(F.lit("?")).alias("n")).first()
    assert r.x == r.y and r.s == "+-" and tuple(r.d) == ("-", "-") and r.n is None
    e = spark.createDataFrame([("+", True), ("+", False), ("-", True), ("-", False)], "s string, f boolean")
    assert [(x.c, x.h) for x in e.select(S.breakend_coord(F.col("s"), F.col("f"), F.lit(1), F.lit(2)).alias("c"), S.high_side(F.col("s"), F.col("f")).alias("h")).collect()] == [(2, "left"), (1, "right"), (1, "right"), (2, "left")]


def test_values(spark):
    r = one(spark, X.similar(F.lit(0.0), F.lit(3.0), 1.2).alias("z"), X.similar(F.lit(0.0), F.lit(3.0), 1.2, zero=True).alias("y"), X.similar(F.lit(10.0), F.lit(12.0), 1.1).alias("d"), X.safe_divide(F.lit(-1.0), F.lit(0.0)).alias("i"),
            X.flag(F.lit(" True ")).alias("t"), X.flag(F.lit("x")).alias("n"), X.optional_double(F.lit("inf")).alias("o"), X.copy_text(F.lit(0.125)).alias("c"), X.path_labels(F.lit("chr2b_chr1f")).alias("p"))
    assert not r.z and r.y and r.d and r.i == float("-inf") and r.t and r.n is None and r.o is None and r.c == "0.12" and tuple(r.p) == ("chr1", "f", "chr2", "b")


def test_karyotype_text(spark):
    d = spark.createDataFrame([(1, [("chr1", "+"), ("chr2", "+"), ("chr2", "-")]), (2, [("chrX", "+")]), (3, [])], "i int, p array<struct<chr:string,strand:string>>")
    assert [r.t for r in d.orderBy("i").select(X.karyotype(F.col("p")).alias("t")).collect()] == ["t(1;2),inv(2)", "X", None]


@pytest.mark.parametrize("chrom,rank", [("chr7", 7), ("chrX", 24), ("chrY", 25), ("chrUn", None)])
def test_rank(spark, chrom, rank):
    assert one(spark, S.chromosome_rank(F.lit(chrom)).alias("r")).r == rank
