"""Limits of the path search, as a small JSON file that fixes or records them."""

from __future__ import annotations

import json

from pyspark.sql import SparkSession


def parse_limits(text: str) -> tuple[int, int]:
    """(chromosome changes, direction changes) of {"chr": n, "dir": m}; anything else is an error."""
    try:
        got = json.loads(text)
    except ValueError as e:
        raise ValueError("limits are not JSON") from e
    if not isinstance(got, dict) or set(got) != {"chr", "dir"}:
        raise ValueError("limits must have chr and dir, and nothing else")
    out = []
    for k in ("chr", "dir"):
        if isinstance(got[k], bool) or not isinstance(got[k], int) or got[k] < 0:
            raise ValueError(f"{k} must be a whole number from 0")
        out.append(got[k])
    return out[0], out[1]


def load_limits(spark: SparkSession, path: str) -> tuple[int, int]:
    return parse_limits("\n".join(r[0] for r in spark.read.option("wholetext", True).text(path).limit(1).collect()))


def save_limits(spark: SparkSession, path: str, chr_limit: int, dir_limit: int) -> None:
    spark.createDataFrame([(json.dumps({"chr": chr_limit, "dir": dir_limit}),)], "value string").coalesce(1).write.mode("overwrite").text(path)
