"""Run modes: what a run does, saved beside its tables."""

from __future__ import annotations

import json
from dataclasses import asdict, dataclass

from pyspark.sql import SparkSession

MODES = ("karyotype", "variant", "full_assembly")


@dataclass(frozen=True)
class Mode:
    requested: str
    actual: str
    junctions: int | None = None
    vcf_input: bool = False
    vcf_path: str | None = None

    @property
    def is_karyotype(self) -> bool:
        return self.actual == "karyotype"

    @property
    def is_variant(self) -> bool:
        return self.actual == "variant"

    @property
    def is_full_assembly(self) -> bool:
        return self.actual == "full_assembly"

    @property
    def runs_hypothesis_test(self) -> bool:
        return not self.vcf_input and not self.is_full_assembly

    @property
    def runs_filter_loops(self) -> bool:
        return self.is_karyotype and not self.vcf_input

    def describe(self) -> str:
        why = "" if self.requested == self.actual else f" (asked for {self.requested})"
        return f"{self.actual}{why}" + (" from variants" if self.vcf_input else "")


def make_mode(requested: str = "karyotype", junctions: int | None = None, limit: int = 10_000, vcf_path: str | None = None) -> Mode:
    """Variant input and too many junctions make a karyotype run a variant run; anything unknown is an error."""
    if requested not in MODES:
        raise ValueError(f"mode must be one of {MODES}")
    if requested == "full_assembly":
        if vcf_path:
            raise ValueError("a full assembly takes no variants")
        return Mode(requested, requested)
    many = junctions is not None and junctions > limit
    return Mode(requested, "variant" if vcf_path or many else requested, junctions, vcf_path is not None, vcf_path)


def save_mode(spark: SparkSession, mode: Mode, run_dir: str) -> None:
    spark.createDataFrame([(json.dumps(asdict(mode)),)], "value string").coalesce(1).write.mode("overwrite").text(f"{run_dir.rstrip('/')}/mode")


def load_mode(spark: SparkSession, run_dir: str) -> Mode:
    return Mode(**json.loads(spark.read.text(f"{run_dir.rstrip('/')}/mode").first()[0]))
