"""Writers: tab-separated tables, alignment and variant text, run artifacts. Text comes out as a folder of parts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from strandweave import schemas
from strandweave.functions import vcf_text as V


def write_depth(df: DataFrame, path: str) -> None:
    df.select([f.name for f in schemas.DEPTH]).write.mode("overwrite").option("sep", "\t").option("compression", "gzip").csv(path)


def paf_line(cigar: str | None = None) -> Column:
    """One alignment row as text, with its tags and, if given, a CIGAR column as the tag cg."""
    cols = [F.col(f.name).cast("string") for f in schemas.PAF][:12]
    tags = F.when(F.size("tags") > 0, F.array_join("tags", "\t"))
    tail = [tags] if cigar is None else [tags, F.concat(F.lit("cg:Z:"), F.col(cigar))]
    return F.concat_ws("\t", *cols, *tail)


def write_paf(df: DataFrame, path: str, cigar: str | None = None) -> None:
    """Rows of some length on query, target and in block, with, if asked for, a CIGAR; others are left out."""
    ok = F.expr("qlen > 0 and qnd > qst and tnd > tst and block > 0")
    if cigar is not None:
        ok = ok & ~F.coalesce(F.trim(cigar), F.lit("")).isin("", "*")
    df.where(ok).select(paf_line(cigar).alias("value")).write.mode("overwrite").text(path)


def write_tsv(df: DataFrame, path: str, header: bool = True, null: str = "*") -> None:
    df.write.mode("overwrite").option("sep", "\t").option("header", header).option("nullValue", null).option("emptyValue", null).csv(path)


def write_json(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def vcf_header(contigs: list[tuple[str, int]], source: str = "strandweave") -> list[str]:
    return [
        "##fileformat=VCFv4.3", f"##source={source}", *(f"##contig=<ID={c},length={n}>" for c, n in contigs),
        '##INFO=<ID=SVTYPE,Number=1,Type=String,Description="Type of structural variant">',
        '##INFO=<ID=MATEID,Number=1,Type=String,Description="Mate of a breakend">',
        '##INFO=<ID=STRANDS,Number=1,Type=String,Description="Sides of the breakpoint">',
        '##INFO=<ID=END,Number=1,Type=Integer,Description="End position">',
        '##INFO=<ID=SVLEN,Number=1,Type=Integer,Description="Length">',
        '##INFO=<ID=CN,Number=1,Type=Float,Description="Copy number">',
        "#CHROM\tPOS\tID\tREF\tALT\tQUAL\tFILTER\tINFO",
    ]


def write_vcf(lines: DataFrame, contigs: list[tuple[str, int]], path: str) -> None:
    """Header, then body lines (ord, k, line) in order, as one part: calls are few whatever the input."""
    spark = lines.sparkSession
    head = spark.createDataFrame([(-1, i, x) for i, x in enumerate(vcf_header(contigs))], "ord long, k long, line string")
    body = lines.select(F.col("ord").cast("long"), F.col("k").cast("long"), "line")
    head.unionByName(body).repartitionByRange(1, "ord", "k").sortWithinPartitions("ord", "k").select("line").write.mode("overwrite").text(path)


def annotate_vcf(lines: DataFrame, annotations: DataFrame, keys: list[str]) -> DataFrame:
    """Raw lines (line, raw) with INFO keys set from annotations (line, one column per key); others unchanged."""
    d = lines.join(annotations, "line", "left").withColumn("p", F.split("raw", "\t"))
    known = F.lit(False)
    for k in keys:
        known = known | F.col(k).isNotNull()
    info = V.upsert_info(F.get("p", F.lit(7)), keys, [F.col(k).cast("string") for k in keys])
    new = F.concat(F.slice("p", 1, 7), F.array(info), F.when(F.size("p") > 8, F.slice("p", 9, F.size("p"))).otherwise(F.array().cast("array<string>")))
    changed = F.array_join(new, "\t")
    return d.select("line", F.when(~F.col("raw").startswith("#") & (F.size("p") >= 8) & known, changed).otherwise(F.col("raw")).alias("raw"))


def write_artifact(df: DataFrame, run_dir: str, name: str) -> DataFrame:
    """Writes a table of a run directory and reads it back; the committer makes it appear as a whole."""
    path = f"{run_dir.rstrip('/')}/{name}.parquet"
    df.write.mode("overwrite").parquet(path)
    return df.sparkSession.read.parquet(path)


def write_matrix(matrix: DataFrame, target: DataFrame, run_dir: str) -> None:
    matrix.select("col", "bin", "value").write.mode("overwrite").parquet(f"{run_dir.rstrip('/')}/matrix.parquet")
    target.write.mode("overwrite").parquet(f"{run_dir.rstrip('/')}/target.parquet")


def read_matrix(spark: SparkSession, run_dir: str, columns: DataFrame | None = None) -> DataFrame:
    """The matrix, or the part of it that selected columns hold."""
    m = spark.read.parquet(f"{run_dir.rstrip('/')}/matrix.parquet")
    return m if columns is None else m.join(columns.select("col").distinct(), "col", "left_semi")
