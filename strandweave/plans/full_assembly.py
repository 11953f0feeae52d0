"""Full assembly: contig alignments and depth windows to copy numbers of contigs and their karyotype texts.

Each step's table is written to the run directory, and a run resumes at any step whose predecessors are there.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from strandweave.functions import cs as C
from strandweave.functions import values as X
from strandweave.operators import aggregates as A
from strandweave.operators import events as E
from strandweave.operators import matrix as M
from strandweave.operators import ordered as O
from strandweave.operators import solver as L
from strandweave.operators import stats as Q
from strandweave.operators.contigs import clean_failed_layout
from strandweave.sources import readers as S
from strandweave.sources.sinks import write_artifact

STEPS = ("coverage", "matrix", "weights", "karyotype")


def primary(paf: DataFrame) -> DataFrame:
    """Alignments that aren't tagged secondary and have a trace of their bases (cs or cg)."""
    d = paf.withColumn("_tp", S.tag("tp")).withColumn("_cs", S.tag("cs")).withColumn("_cg", S.tag("cg"))
    d = d.where("(_tp is null or _tp = 'P') and (_cs is not null or _cg is not null)")
    return d.withColumn("cigar", F.coalesce("_cg", C.cigar(F.col("_cs"), strict=True))).drop("_tp", "_cs", "_cg")


def contig_coverage(paf: DataFrame, width: int) -> DataFrame:
    """Coverage of each window (chr, st) by each contig that aligns there."""
    c = M.window_coverage(M.alignment_blocks(primary(paf)), ["qname", "tname"], width)
    return c.select(F.col("qname").alias("name"), F.col("tname").alias("chr"), (F.col("bin") * width).alias("st"), F.col("coverage").alias("value"))


def contig_columns(fasta: DataFrame, paf: DataFrame) -> DataFrame:
    """Contigs with alignments, numbered by name, with their covered share."""
    d = A.covered_fraction(fasta, primary(paf)).where("n_alignments > 0")
    return d.withColumn("col", (F.row_number().over(Window.orderBy("name")) - 1).cast("int"))  # one row per contig


def depth_matrix(depth: DataFrame, excluded: DataFrame, columns: DataFrame, coverage: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(matrix, target): bins are depth windows in order, clean ones first; target has is_clean."""
    w = depth.withColumn("row_id", F.row_number().over(Window.orderBy("chr", "st")) - 1)  # windows of one genome
    lay = clean_failed_layout(w, excluded.select("chr", F.col("st").alias("r_st"), F.col("nd").alias("r_nd")), ["chr"], "meandepth")
    lay = lay.withColumn("bin", (F.row_number().over(Window.orderBy("is_failed", "row_id")) - 1).cast("int"))
    target = lay.select("bin", F.col("meandepth").alias("value"), (~F.col("is_failed")).alias("is_clean"), "chr", "st")
    m = coverage.join(columns.select("name", "col"), "name").join(target.select("bin", "chr", "st"), ["chr", "st"]).select("col", "bin", "value")
    return m, target


def copy_numbers(weights: DataFrame, columns: DataFrame, depth: DataFrame) -> DataFrame:
    """Contigs with raw weight and copies in units of half the median depth; unused ones have 0."""
    unit = depth.agg((F.median("meandepth") / 2).alias("unit"))
    w = columns.join(weights, "col", "left").crossJoin(F.broadcast(unit))  # one row
    return w.select("name", "col", F.coalesce("w", F.lit(0.0)).alias("raw_weight"), X.safe_divide(F.coalesce("w", F.lit(0.0)), F.col("unit")).alias("copies"))


def karyotypes(paf: DataFrame, copies: DataFrame, least_piece: int = 1_000_000) -> DataFrame:
    """Karyotype text of each contig in use: alignments in query order, clipped by earlier ones, merged by state."""
    d = primary(paf).select(F.col("qname").alias("path_id"), "qst", "qnd", F.col("tname").alias("chr"), "strand")
    d = O.clipped_by_previous(d, ["path_id"], "qst", "qnd").where("clipped > 0").withColumnRenamed("clipped", "length").withColumn("step", F.col("qst"))
    p = E.karyotype_pieces(d, "path_id", "step", least_piece)
    again = E.karyotype_pieces(p.withColumn("step", F.col("run")), "path_id", "step")
    g = again.groupBy("path_id").agg(F.array_sort(F.collect_list(F.struct("run", "chr", "strand", "length"))).alias("_p"))
    text = X.karyotype(F.transform("_p", lambda x: F.struct(x["chr"].alias("chr"), x["strand"].alias("strand"))))
    return copies.where("raw_weight > 0").join(g.withColumnRenamed("path_id", "name"), "name").select("name", "copies", text.alias("karyotype"), F.aggregate("_p", F.lit(0).cast("long"), lambda a, x: a + x["length"]).alias("length"))


def run(spark: SparkSession, paf_path: str, fasta_path: str, depth_path: str, satellites_path: str, run_dir: str, width: int = 100_000, start_at: str = "coverage", least_piece: int = 1_000_000) -> dict[str, DataFrame]:
    """All steps from start_at on; earlier tables are read from the run directory. Returns weights, metrics, karyotype."""
    if start_at not in STEPS:
        raise ValueError(f"start_at must be one of {STEPS}")
    first = STEPS.index(start_at)
    paf, depth, sat = S.read_paf(spark, paf_path, strict=True), S.read_depth(spark, depth_path), S.read_bed(spark, satellites_path)

    def table(step: str, name: str, make) -> DataFrame:
        return write_artifact(make(), run_dir, name) if STEPS.index(step) >= first else S.read_artifact(spark, run_dir, name)

    fasta = S.read_fasta_lengths(spark, fasta_path)
    columns = table("coverage", "columns", lambda: contig_columns(fasta, paf))
    coverage = table("coverage", "coverage", lambda: contig_coverage(paf, width))
    target = table("matrix", "target", lambda: depth_matrix(depth, sat, columns, coverage)[1])
    matrix = table("matrix", "matrix", lambda: coverage.join(columns.select("name", "col"), "name").join(target.select("bin", "chr", "st"), ["chr", "st"]).select("col", "bin", "value"))
    weights = table("weights", "weights", lambda: copy_numbers(L.fit(matrix, target), columns, depth))
    fitted = M.predict(matrix, weights.select("col", F.col("raw_weight").alias("w")))
    metrics = M.fit_metrics(fitted, target.where("is_clean"))
    karyotype = table("karyotype", "karyotype", lambda: karyotypes(paf, weights, least_piece))
    tracks = target.join(fitted.select("bin", F.col("value").alias("predicted")), "bin", "left").select("chr", "st", F.col("value").alias("observed"), F.coalesce("predicted", F.lit(0.0)).alias("predicted"), "is_clean")
    noise = Q.noise_sigma(O.contiguous_runs(depth, ["chr"], "st", width), "chr", "run", "st", "meandepth")
    return {"weights": weights, "metrics": metrics, "karyotype": karyotype, "tracks": tracks, "noise": noise}
