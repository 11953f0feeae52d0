import gzip
import struct
import zlib

import pytest
from pyspark.sql import functions as F

from strandweave.plans import full_assembly, modes
from strandweave.sources import readers as S
from strandweave.sources import sinks as W
from strandweave.sources.bam import BamSource


def write(path, text):
    path.write_text(text)
    return str(path)


def test_depth(spark, tmp_path):
    p = tmp_path / "d.win.stat.gz"
    with gzip.open(p, "wt") as f:
        f.write("#chr\tx\nchr1\t0\t100\t100\t90\t300\t0.9\t3.0\nchr\tst\tnd\tlength\tcovsite\ttotaldepth\tcov\tmeandepth\nchrM\t0\t1\t1\t1\t1\t1\t1\nchr2\t0\t100\tx\t90\t300\t0.9\t2.5\n")
    rows = S.read_depth(spark, str(p)).orderBy("chr").collect()
    assert [(r.chr, r.length, r.meandepth) for r in rows] == [("chr1", 100, 3.0), ("chr2", None, 2.5)]


def test_paf_and_lines(spark, tmp_path):
    ok = "q\t10\t0\t5\t+\tchr1\t100\t5\t10\t5\t5\t60\ttp:A:P\tcs:Z::5\txi:Z:P_7"
    p = write(tmp_path / "a.paf", ok + "\n\n" + ok + "\n")
    rows = S.read_paf(spark, p, strict=True).orderBy("line").collect()
    assert [r.line for r in rows] == [0, 2] and rows[0].tags == ["tp:A:P", "cs:Z::5", "xi:Z:P_7"]
    assert S.query_rows(S.read_paf(spark, p)).first().origin_row == 7
    for bad in ("q\t10\t0", ok.replace("\t+\t", "\t?\t"), ok.replace("\t0\t5\t", "\t5\t5\t"), ok.replace("\t60\t", "\tx\t")):
        with pytest.raises(Exception, match="line 0"):
            S.read_paf(spark, write(tmp_path / "b.paf", bad + "\n"), strict=True).collect()


def test_fasta_bed_telomeres(spark, tmp_path):
    fa = write(tmp_path / "x.fa", ">a one\nACGT\nAC\n>b\n>c\nA\n")
    assert {r.name: r.len for r in S.read_fasta_lengths(spark, fa).collect()} == {"a": 6, "b": 0, "c": 1}
    with pytest.raises(Exception, match="bad sequence name"):
        S.read_fasta_lengths(spark, write(tmp_path / "y.fa", ">a\nA\n>a\nC\n")).collect()
    bed = S.read_bed(spark, write(tmp_path / "t.bed", "chr1\t0\t100\nchr1\t9900\t10000\n"))
    lens = spark.createDataFrame([("chr1", 10000)], "chr string, len long")
    assert [(r.label, r.st, r.nd) for r in S.telomeres(bed, lens, 50).orderBy("st").collect()] == [("f", 0, 150), ("b", 9850, 10000)]
    assert S.read_bed(spark, str(tmp_path / "t.bed"), longer_than=100).count() == 0


def test_vcf_round_trip(spark, tmp_path):
    head = "##fileformat=VCFv4.3\n##source=Sniffles2_2.2\n##contig=<ID=chr1,length=1000>\n#CHROM\tPOS\tID\tREF\tALT\tQUAL\tFILTER\tINFO\n"
    p = write(tmp_path / "v.vcf", head + "chr1\t5\ta\tN\t<DEL>\t.\tPASS\tSVTYPE=DEL;X\nchr1\tx\tb\tN\t<DEL>\t.\tPASS\t.\n")
    rec, contigs, source = S.read_vcf(spark, p)
    assert [r.fault for r in rec.orderBy("line").collect()] == [None, "bad position"] and contigs.first().len == 1000 and source.caller == "sniffles2"
    ann = spark.createDataFrame([(4, "1.50")], "line long, CN string")
    lines = {r.line: r.raw for r in W.annotate_vcf(rec.select("line", "raw"), ann, ["CN"]).collect()}
    assert lines[4].endswith("SVTYPE=DEL;X;CN=1.50") and lines[5].endswith("\t.")
    with pytest.raises(ValueError, match="exactly one"):
        S.read_vcf(spark, write(tmp_path / "w.vcf", head + head))
    with pytest.raises(ValueError, match="compressed"):
        S.read_vcf(spark, "x.vcf.gz")


def test_written_variants(spark, tmp_path):
    from strandweave.operators.events import vcf_lines

    j = spark.createDataFrame([(1, "chr1", 10, "+", "chr2", 20, "-", 1.5)], "ord long, chr string, pos long, dir_a string, mate_chr string, mate_pos long, dir_b string, cn double")
    i = spark.createDataFrame([(2, "front_jump", "chr1", 5, 50, 2.0)], "ord long, event_type string, chr string, st long, nd long, cn double")
    W.write_vcf(vcf_lines(j, i), [("chr1", 100)], str(tmp_path / "o"))
    text = [r[0] for r in spark.read.text(str(tmp_path / "o")).collect()]
    assert text[0] == "##fileformat=VCFv4.3" and "N]chr2:20]" in text[-3] and "N]chr1:10]" in text[-2] and "<DEL>" in text[-1]
    rec, _, _ = S.read_vcf(spark, str(tmp_path / "o"))
    assert rec.where("fault is null").count() == 3


def test_depth_files(spark):
    d = lambda *n: spark.createDataFrame([(x,) for x in n], "name string")
    assert S.depth_files(d("1_base.win.stat.gz", "1.win.stat.gz", "2_base.win.stat.gz", "2_type2_merge_3.win.stat.gz", "other")).count() == 4
    for bad in (d("1.win.stat.gz", "3.win.stat.gz"), d("1.win.stat.gz", "1_type2_merge_1.win.stat.gz")):
        with pytest.raises(Exception, match="numbered"):
            S.depth_files(bad).collect()


def bam_bytes():
    head = b"BAM\x01" + struct.pack("<i", 0) + struct.pack("<i", 1) + struct.pack("<i", 5) + b"chr1\0" + struct.pack("<i", 1000)
    recs = b""
    for name, flag, pos, ops in (("r1", 0, 100, [(10, 0)]), ("r2", 16, 200, [(5, 4), (8, 0), (3, 2)])):
        body = struct.pack("<iiBBHHHiiii", 0, pos, len(name) + 1, 60, 0, len(ops), flag, 0, -1, -1, 0) + name.encode() + b"\0" + b"".join(struct.pack("<I", n << 4 | o) for n, o in ops)
        recs += struct.pack("<i", len(body)) + body
    raw, out = head + recs, b""
    for part in (raw[:60], raw[60:], b""):
        c = zlib.compressobj(6, zlib.DEFLATED, -15)
        d = c.compress(part) + c.flush()
        out += b"\x1f\x8b\x08\x04" + b"\0" * 6 + struct.pack("<H", 6) + b"BC" + struct.pack("<HH", 2, len(d) + 25) + d + struct.pack("<II", zlib.crc32(part), len(part))
    return out


def test_bam(spark, tmp_path):
    p = tmp_path / "a.bam"
    p.write_bytes(bam_bytes())
    spark.dataSource.register(BamSource)
    rows = spark.read.format("bam").option("path", str(p)).load().orderBy("read").collect()
    assert [(r.read, r.flag, r.chr, r.st, r.nd, r.cigar, r.strand, r.qst) for r in rows] == [("r1", 0, "chr1", 100, 110, "10M", "+", 0), ("r2", 16, "chr1", 200, 211, "5S8M3D", "-", 0)]
    assert spark.read.format("bam").option("path", str(p)).option("regions", "chr1:0-105").load().count() == 1


def test_modes(spark, tmp_path):
    m = modes.make_mode("karyotype", 20_000)
    assert m.is_variant and "asked for karyotype" in m.describe() and not modes.make_mode("karyotype", vcf_path="x").runs_hypothesis_test
    modes.save_mode(spark, m, str(tmp_path))
    assert modes.load_mode(spark, str(tmp_path)) == m
    with pytest.raises(ValueError):
        modes.make_mode("other")


def test_full_assembly(spark, tmp_path):
    fa = write(tmp_path / "a.fa", "".join(f">c{i}\n{'A' * 1000}\n" for i in (1, 2, 3)))
    rows = [("c1", "chr1", 0, 1000), ("c2", "chr1", 1000, 2000), ("c3", "chr2", 0, 500)]
    paf = "".join(f"{q}\t1000\t0\t{e - s}\t+\t{t}\t5000\t{s}\t{e}\t{e - s}\t{e - s}\t60\ttp:A:P\tcs:Z::{e - s}\n" for q, t, s, e in rows)
    paf += "c1\t1000\t0\t1000\t+\tchr2\t5000\t0\t1000\t1000\t1000\t0\ttp:A:S\tcs:Z::1000\n"
    want = {"c1": 4.0, "c2": 2.0, "c3": 2.0}
    depth = "".join(f"{c}\t{s}\t{s + 100}\t100\t100\t0\t1\t{d}\n" for c, s, d in [("chr1", s, 4.0 if s < 1000 else 2.0) for s in range(0, 2000, 100)] + [("chr2", s, 2.0 if s < 500 else 0.0) for s in range(0, 1000, 100)])
    args = (write(tmp_path / "a.paf", paf), fa, write(tmp_path / "d.tsv", depth), write(tmp_path / "s.bed", ""))
    out = full_assembly.run(spark, *args, str(tmp_path / "run"), width=100, least_piece=0)
    got = {r.name: r for r in out["weights"].collect()}
    assert {k: round(v.raw_weight, 4) for k, v in got.items()} == want and round(got["c1"].copies, 4) == 4.0
    assert out["metrics"].first().relative_error < 1e-4
    assert {r.name: r.karyotype for r in out["karyotype"].collect()} == {"c1": "1", "c2": "1", "c3": "2"}
    again = full_assembly.run(spark, *args, str(tmp_path / "run"), width=100, start_at="karyotype", least_piece=0)
    assert again["weights"].count() == 3


def test_artifacts(spark, tmp_path):
    d = W.write_artifact(spark.range(3), str(tmp_path), "x")
    assert d.count() == 3 and S.read_artifact(spark, str(tmp_path), "none", required=False) is None
    with pytest.raises(FileNotFoundError):
        S.read_artifact(spark, str(tmp_path), "none")
    m = spark.createDataFrame([(0, 0, 1.0), (1, 0, 2.0)], "col int, bin int, value double")
    W.write_matrix(m, m, str(tmp_path))
    assert W.read_matrix(spark, str(tmp_path), m.where("col = 1")).count() == 1


def test_streams(spark, tmp_path):
    from strandweave.streaming.windows import sessions, tumbling

    spark.sql("select timestamp'2024-01-01 00:10:00' t, 1 k, 2.0D v union all select timestamp'2024-01-01 00:50:00', 1, 3.0D union all select timestamp'2024-01-01 09:00:00', 1, 1.0D").write.parquet(str(tmp_path / "in"))
    src = lambda: spark.readStream.schema("t timestamp, k int, v double").parquet(str(tmp_path / "in"))
    for name, df in (("tw", tumbling(src(), "t", ["k"], "v")), ("ss", sessions(src(), "t", ["k"]))):
        q = df.writeStream.outputMode("complete" if name == "tw" else "append").format("memory").queryName(name).trigger(availableNow=True).start()
        q.awaitTermination(60)
    assert {(r.n, r.total) for r in spark.table("tw").collect()} == {(2, 5.0), (1, 1.0)}
    assert spark.table("ss").agg(F.max("n")).first()[0] == 2
