"""Explicit schemas of all inputs; nothing is inferred."""

from __future__ import annotations

from pyspark.sql import types as T


def _struct(spec: str) -> T.StructType:
    return T.StructType([T.StructField(n, _TYPES[k]) for n, k in (f.split(":") for f in spec.split())])


_TYPES = {"s": T.StringType(), "l": T.LongType(), "i": T.IntegerType(), "d": T.DoubleType(), "a": T.ArrayType(T.StringType()), "b": T.BooleanType()}

DEPTH = _struct("chr:s st:l nd:l length:l covsite:l totaldepth:d cov:d meandepth:d")
DEPTH_TEXT = T.StructType([T.StructField(f.name, T.StringType()) for f in DEPTH])
PAF = _struct("qname:s qlen:l qst:l qnd:l strand:s tname:s tlen:l tst:l tnd:l matches:l block:l mapq:i tags:a line:l")
NODE = _struct(
    "ctg_nam:s ctg_len:l ctg_str:l ctg_end:l ctg_dir:s chr_nam:s chr_len:l chr_str:l chr_end:l ctg_mapq:l ctg_typ:l ctg_strnd:l ctg_endnd:l "
    "ctg_telchr:s ctg_teldir:s ctg_telcon:s ctg_rptchr:s ctg_rptcase:s ctg_censat:s ctg_mainflowdir:s ctg_mainflowchr:s ctg_globalidx:s"
)
BED = _struct("chr:s st:l nd:l")
LENGTHS = _struct("chr:s len:l")
MATRIX = _struct("col:i bin:i value:d")
TARGET = _struct("bin:i value:d is_clean:b")
