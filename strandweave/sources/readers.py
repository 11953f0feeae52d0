"""Readers of text inputs: typed frames, nothing inferred, with rules on bad rows stated for each."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from strandweave import schemas
from strandweave.functions import vcf_text as V
from strandweave.operators.ordered import refuse


def _lines(spark: SparkSession, path: str, blocks: bool = False) -> DataFrame:
    """value and line (physical number from 0) of a text file; blocks: its file and block as well, as _f and _b.

    Numbers come from the order of blocks in each file and the counts before them, so no line is gathered anywhere;
    an unsplittable (gzip) file is one block.
    """
    t = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("_f"), F.col("_metadata.file_block_start").alias("_b"), F.monotonically_increasing_id().alias("_i"))
    counts = t.groupBy("_f", "_b").agg(F.count("*").alias("_n"), F.min("_i").alias("_i0"))
    w = Window.partitionBy("_f").orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.withColumn("_before", F.coalesce(F.sum("_n").over(w), F.lit(0))).select("_f", "_b", "_i0", "_before")
    return t.join(F.broadcast(counts), ["_f", "_b"]).select(*(["_f", "_b"] if blocks else []), "value", (F.col("_before") + F.col("_i") - F.col("_i0")).alias("line"))  # one row per file block


def read_depth(spark: SparkSession, path: str) -> DataFrame:
    """Depth windows: tab-separated (gzip or not), # comments, eight columns; chrM and embedded header rows are left
    out; numbers that aren't are null."""
    t = spark.read.schema(schemas.DEPTH_TEXT).option("sep", "\t").option("comment", "#").csv(path)
    t = t.where("chr <> 'chrM' and coalesce(meandepth, '') <> 'meandepth'")
    return t.select(*[F.col(f.name) if f.dataType.simpleString() == "string" else F.col(f.name).try_cast(f.dataType).alias(f.name) for f in schemas.DEPTH])


def read_paf(spark: SparkSession, path: str, strict: bool = False) -> DataFrame:
    """Alignments with their tags and line number. Short rows and bad numbers are null-filled rows, or with strict an
    error at run time that names the line; so are bad strands and intervals out of bounds."""
    t = _lines(spark, path).where("trim(value) <> ''").withColumn("p", F.split("value", "\t"))
    names = [f.name for f in schemas.PAF][:12]
    cols = [F.get("p", F.lit(k)).try_cast(schemas.PAF[n].dataType).alias(n) for k, n in enumerate(names)]
    d = t.select(*cols, F.when(F.size("p") > 12, F.slice("p", 13, F.size("p"))).otherwise(F.array().cast("array<string>")).alias("tags"), "line", F.size("p").alias("_n"))
    if strict:
        reason = paf_fault()
        d = d.withColumn("line", F.when(reason.isNotNull(), F.raise_error(F.concat(F.lit("line "), F.col("line").cast("string"), F.lit(": "), reason)).cast("long")).otherwise(F.col("line")))
    return d.drop("_n")


def paf_fault() -> Column:
    """Why a row of read_paf can't be used, or null."""
    return (
        F.when(F.col("_n") < 12, "fewer than 12 fields")
        .when(F.greatest(*[F.col(c).isNull() for c in ("qlen", "qst", "qnd", "tlen", "tst", "tnd", "matches", "block", "mapq")]), "not a number")
        .when(~F.col("strand").isin("+", "-"), "bad strand")
        .when((F.col("qst") < 0) | (F.col("qst") >= F.col("qnd")) | (F.col("qnd") > F.col("qlen")), "query interval out of bounds")
        .when((F.col("tst") < 0) | (F.col("tst") >= F.col("tnd")) | (F.col("tnd") > F.col("tlen")), "target interval out of bounds")
    )


def read_paf_csv(spark: SparkSession, path: str) -> DataFrame:
    """The comma-separated dialect with a header that starts with qry_name."""
    d = spark.read.option("header", True).csv(path)
    named = dict(zip(d.columns[:12], [f.name for f in schemas.PAF][:12], strict=True))
    return d.select(*[F.col(a).try_cast(schemas.PAF[b].dataType).alias(b) for a, b in named.items()])


def tag(name: str) -> Column:
    """Value of a tag of read_paf rows, null without it."""
    hit = F.filter("tags", lambda t: t.startswith(f"{name}:"))
    return F.regexp_replace(F.get(hit, F.lit(0)), "^[^:]*:[^:]*:", "")


def query_rows(paf: DataFrame) -> DataFrame:
    """qname, query interval, mapq and the row of the original file that tag xi links to; first and last row of each
    contig."""
    d = paf.select("qname", "qst", "qnd", "mapq", "line", F.regexp_extract(F.coalesce(tag("xi"), F.lit("")), "^(.)_([0-9]+)$", 1).alias("origin_kind"), F.regexp_extract(F.coalesce(tag("xi"), F.lit("")), "^(.)_([0-9]+)$", 2).try_cast("long").alias("origin_row"))
    w = Window.partitionBy("qname")
    return d.withColumn("first_row", F.min("line").over(w)).withColumn("last_row", F.max("line").over(w))


def read_nodes(spark: SparkSession, path: str) -> DataFrame:
    """Preprocessed nodes of 22 tab-separated columns, with node_id, their line."""
    t = _lines(spark, path).where("trim(value) <> ''").withColumn("p", F.split("value", "\t"))
    return t.select(F.col("line").alias("node_id"), *[F.get("p", F.lit(k)).try_cast(f.dataType).alias(f.name) for k, f in enumerate(schemas.NODE)])


def read_lengths(spark: SparkSession, path: str) -> DataFrame:
    """Names and lengths of a FASTA index."""
    return spark.read.option("sep", "\t").csv(path).select(F.col("_c0").alias("chr"), F.col("_c1").try_cast("long").alias("len"))


def read_fasta_lengths(spark: SparkSession, path: str) -> DataFrame:
    """Names and lengths counted from FASTA text; an empty or repeated name is an error at run time.

    Each line belongs to the last name before it: names are counted block by block, within a block in order, so that no
    line meets another sequence's name.
    """
    t = _lines(spark, path, blocks=True).withColumn("head", F.col("value").startswith(">").cast("long"))
    w = Window.partitionBy("_f").orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    before = t.groupBy("_f", "_b").agg(F.sum("head").alias("_h")).withColumn("_before", F.coalesce(F.sum("_h").over(w), F.lit(0))).drop("_h")  # a row per block
    along = Window.partitionBy("_f", "_b").orderBy("line").rowsBetween(Window.unboundedPreceding, 0)
    t = t.join(F.broadcast(before), ["_f", "_b"]).withColumn("_seq", F.col("_before") + F.sum("head").over(along)).where("_seq > 0")
    name = F.max(F.when(F.col("head") == 1, F.regexp_extract("value", r"^>\s*(\S*)", 1))).alias("name")
    size = F.sum(F.when(F.col("head") == 0, F.length(F.trim("value"))).otherwise(0)).alias("len")
    each = t.groupBy("_f", "_seq").agg(name, size)
    n = F.count("*").over(Window.partitionBy("name"))
    bad = F.raise_error(F.concat(F.lit("bad sequence name: "), F.col("name")))
    return each.withColumn("_n", n).select(F.when((F.col("name") == "") | (F.col("_n") > 1), bad).otherwise(F.col("name")).alias("name"), "len")


def read_bed(spark: SparkSession, path: str, longer_than: int | None = None) -> DataFrame:
    """chr, st, nd and ord (line) of three or more columns; longer_than keeps intervals whose length is above it."""
    t = _lines(spark, path).where("trim(value) <> '' and value not like '#%' and value not like 'track%'").withColumn("p", F.split("value", r"\s+"))
    d = t.select(F.get("p", F.lit(0)).alias("chr"), F.get("p", F.lit(1)).try_cast("long").alias("st"), F.get("p", F.lit(2)).try_cast("long").alias("nd"), F.col("line").alias("ord"))
    return d if longer_than is None else d.where(F.abs(F.col("nd") - F.col("st")) > longer_than)


def telomeres(bed: DataFrame, lengths: DataFrame, reach: int = 5_000) -> DataFrame:
    """Telomere intervals as f or b by which half of the chromosome they start in, widened inwards by `reach`."""
    d = bed.join(F.broadcast(lengths), "chr")  # a few dozen chromosomes
    back = F.col("st") > F.col("len") / 2
    return d.select("chr", F.when(back, F.greatest(F.col("st") - reach, F.lit(0))).otherwise(F.col("st")).alias("st"), F.when(back, F.col("nd")).otherwise(F.least(F.col("nd") + reach, F.col("len"))).alias("nd"), F.when(back, "b").otherwise("f").alias("label"), "ord")


def read_vcf(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame, V.Source]:
    """(records, contigs, source) of plain-text variants; compressed files and anything but one #CHROM line are errors.

    records: line, chr, pos, id, ref, alt, qual, filter, info, raw, fault (why a row can't be used, else null).
    contigs: chr, len of header lines.
    """
    if path.endswith((".gz", ".bgz", ".bcf")):
        raise ValueError("compressed variant files are not read")
    t = _lines(spark, path)
    if t.where(F.col("value").startswith("#CHROM")).count() != 1:
        raise ValueError("there must be exactly one #CHROM line")
    head = t.where(F.col("value").startswith("##"))
    contigs = head.where("value like '##contig=<%>'").select(F.regexp_extract("value", "[<,]ID=([^,>]+)", 1).alias("chr"), F.regexp_extract("value", "[<,]length=([0-9]+)", 1).try_cast("long").alias("len")).where("chr <> '' and len is not null")
    source = V.detect_source(head)
    p = t.where("value not like '#%' and trim(value) <> ''").withColumn("p", F.split("value", "\t"))
    names = ["chr", "pos", "id", "ref", "alt", "qual", "filter", "info"]
    d = p.select("line", *[(F.get("p", F.lit(k)).try_cast("long") if n == "pos" else F.get("p", F.lit(k))).alias(n) for k, n in enumerate(names)], F.col("value").alias("raw"), F.size("p").alias("_n"))
    fault = F.when(F.col("_n") < 8, "fewer than 8 columns").when(F.col("pos").isNull() | (F.col("pos") < 1), "bad position").when(F.col("chr") == "", "no chromosome").when(F.col("ref") == "", "no reference")
    return d.withColumn("fault", fault).drop("_n"), contigs, source


def unitig_spans(paf: DataFrame) -> DataFrame:
    """chr, st, nd of alignments of unitigs (names that start with utg)."""
    return paf.where("qname like 'utg%' and tnd >= tst").select(F.col("tname").alias("chr"), F.col("tst").alias("st"), F.col("tnd").alias("nd"))


def satellite_inversions(paf: DataFrame, satellites: DataFrame, width: int = 100_000) -> DataFrame:
    """Contigs of two or more rows, all of positive quality and inside satellites of one chromosome, that end on
    opposite strands."""
    from strandweave.operators.range_join import range_join

    rows = paf.select("qname", "qst", "qnd", "strand", "mapq", F.col("tname").alias("chr"), F.col("tst").alias("st"), F.col("tnd").alias("nd"))
    sat = satellites.select("chr", F.col("st").alias("r_st"), F.col("nd").alias("r_nd"))
    inside = range_join(rows.select("qname", "qst", "qnd", "chr", "st", "nd"), sat, ["chr"], "contained", width).select("qname", "qst", "qnd", "st", "nd").distinct().groupBy("qname").agg(F.count("*").alias("n_inside"))
    g = rows.dropDuplicates(["qname", "qst", "qnd", "st", "nd"]).groupBy("qname").agg(
        F.count("*").alias("n"), F.min("mapq").alias("q"), F.countDistinct("chr").alias("chrs"), F.min_by("strand", F.struct("qst", "qnd")).alias("s0"), F.max_by("strand", F.struct("qst", "qnd")).alias("s1"), F.first("chr").alias("chr")
    )
    return g.join(inside, "qname").where("n >= 2 and q > 0 and chrs = 1 and s0 <> s1 and n_inside = n").select("qname", "chr", "n")


def query_spans(paf: DataFrame) -> DataFrame:
    """chr, reference span and rows of each query's alignments."""
    return paf.groupBy("qname").agg(F.min_by("tname", "line").alias("chr"), F.min("tst").alias("st"), F.max("tnd").alias("nd"), F.array_sort(F.collect_list("line")).alias("rows"))


def depth_files(names: DataFrame) -> DataFrame:
    """(kind, index, name) of per-component depth files by their names: base, over and merged kinds.

    Each kind must be numbered 1..n without gaps, and an index has exactly one primary file (over, or merged); anything
    else is an error at run time.
    """
    pat = r"^([0-9]+)(_base|_type2_merge_[0-9]+)?\.win\.stat\.gz$"
    d = names.where(F.col("name").rlike(pat)).select("name", F.regexp_extract("name", pat, 1).cast("int").alias("index"), F.when(F.regexp_extract("name", pat, 2) == "_base", "base").otherwise("over").alias("kind"))
    g = d.groupBy("kind").agg(F.count("*").alias("n"), F.countDistinct("index").alias("k"), F.min("index").alias("lo"), F.max("index").alias("hi"))
    fine = refuse(g.where("n <> k or lo <> 1 or hi <> k"), F.col("kind"), "files are not numbered 1..n, one each: ")
    return d.crossJoin(F.broadcast(fine)).where("_fine").select("kind", "index", "name")  # one row


def read_artifact(spark: SparkSession, run_dir: str, name: str, required: bool = True) -> DataFrame | None:
    """A table of a run directory; a missing one is an error, or None."""
    from strandweave.runtime import _hadoop_path

    path = f"{run_dir.rstrip('/')}/{name}.parquet"
    p, fs = _hadoop_path(spark, path)
    if not fs.exists(p):
        if required:
            raise FileNotFoundError(path)
        return None
    return spark.read.parquet(path)


def read_report(spark: SparkSession, path: str) -> DataFrame:
    """Junction read report: chromosomes (* is null) and flags as booleans; a bad flag is an error at run time."""
    from strandweave.functions.values import flag

    d = spark.read.option("sep", "\t").option("header", True).csv(path)
    for c in ("chrom_a", "chrom_b"):
        d = d.withColumn(c, F.when(F.col(c) != "*", F.col(c)))
    for c in ("point_a_no_spanning_rawread", "point_b_no_spanning_rawread"):
        d = d.withColumn(c, F.coalesce(flag(F.col(c)), F.raise_error(F.concat(F.lit("bad flag: "), F.coalesce(F.col(c), F.lit("null")))).cast("boolean")))
    return d


def excluded_chromosomes(report: DataFrame) -> DataFrame:
    """Chromosomes with a point that no read spans; they take no part in the normal prior."""
    a = report.where("point_a_no_spanning_rawread").select(F.col("chrom_a").alias("chr"))
    return a.unionByName(report.where("point_b_no_spanning_rawread").select(F.col("chrom_b").alias("chr"))).where("chr is not null").distinct()
