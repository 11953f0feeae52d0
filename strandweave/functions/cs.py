"""Difference strings of alignments (cs tags) and the run-length operations (CIGAR) made of them."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

TOKEN = r":[0-9]+|\*[a-z]{2}|[+-][A-Za-z]+"


def _body(cs: Column) -> Column:
    return F.regexp_replace(cs, r"^cs:Z:", "")


def tokens(cs: Column) -> Column:
    """Tokens of a cs string in order."""
    return F.regexp_extract_all(_body(cs), F.lit(f"({TOKEN})"), F.lit(1))


def _ops(cs: Column) -> Column:
    """(op, n) of each token: = matched, X replaced, I inserted in the query, D missing from it."""
    return F.transform(
        tokens(cs),
        lambda t: F.struct(
            F.when(t.startswith(":"), "=").when(t.startswith("*"), "X").when(t.startswith("+"), "I").otherwise("D").alias("op"),
            F.when(t.startswith(":"), F.substring(t, 2, 20).cast("long")).when(t.startswith("*"), F.lit(1).cast("long")).otherwise((F.length(t) - 1).cast("long")).alias("n"),
        ),
    )


def cigar(cs: Column, strict: bool = False) -> Column:
    """CIGAR of a cs string, equal neighbours merged. strict: null unless the tokens make up the whole string."""
    first = F.struct(F.array().cast("array<string>").alias("done"), F.lit("").alias("op"), F.lit(0).cast("long").alias("n"))

    def step(acc: Column, x: Column) -> Column:
        same = acc["op"] == x["op"]
        closed = F.when(same | (acc["op"] == ""), acc["done"]).otherwise(F.concat(acc["done"], F.array(F.concat(acc["n"].cast("string"), acc["op"]))))
        return F.struct(closed.alias("done"), x["op"].alias("op"), F.when(same, acc["n"] + x["n"]).otherwise(x["n"]).alias("n"))

    last = F.aggregate(_ops(cs), first, step)
    text = F.concat(F.array_join(last["done"], ""), F.when(last["op"] == "", "").otherwise(F.concat(last["n"].cast("string"), last["op"])))
    whole = (F.array_join(tokens(cs), "") == _body(cs)) & (F.length(_body(cs)) > 0)
    return F.when(whole, text) if strict else text


def stats(cs: Column) -> Column:
    """struct(matched, aligned): matched bases, and bases of the reference that are covered."""
    ops = _ops(cs)
    total = lambda keep: F.aggregate(ops, F.lit(0).cast("long"), lambda acc, x: acc + F.when(keep(x["op"]), x["n"]).otherwise(0))
    return F.struct(total(lambda o: o == "=").alias("matched"), total(lambda o: o != "I").alias("aligned"))


def parse(cs: str) -> list[tuple[str, str]]:
    """(kind, value) of each token."""
    return [(t[0], t[1:]) for t in re.findall(TOKEN, cs.removeprefix("cs:Z:"))]


def build(parts: list[tuple[str, str]]) -> str:
    """cs string of tokens, with neighbouring matches merged and empty ones left out."""
    out: list[tuple[str, str]] = []
    for kind, value in parts:
        if kind == ":" and int(value) == 0 or not value:
            continue
        if kind == ":" and out and out[-1][0] == ":":
            out[-1] = (":", str(int(out[-1][1]) + int(value)))
        else:
            out.append((kind, value))
    return "".join(k + v for k, v in out)


def trim_left(cs: str, ref: int) -> tuple[str, int, int]:
    """The string without its first `ref` reference bases, and how many reference and query bases went.

    An insertion that follows the last removed reference base goes as well; a deletion is cut where it must be.
    """
    parts = parse(cs)
    gone_ref = gone_query = k = 0
    while k < len(parts) and gone_ref < ref:
        kind, value = parts[k]
        if kind == "+":
            gone_query += len(value)
            k += 1
            continue
        n = int(value) if kind == ":" else 1 if kind == "*" else len(value)
        use = min(n, ref - gone_ref)
        gone_ref += use
        gone_query += use if kind in ":*" else 0
        if use < n:
            parts[k] = (kind, str(n - use) if kind == ":" else value[use:])
        else:
            k += 1
    while ref > 0 and k < len(parts) and parts[k][0] == "+":
        gone_query += len(parts[k][1])
        k += 1
    return build(parts[k:]), gone_ref, gone_query


def trim_right(cs: str, ref: int) -> tuple[str, int, int]:
    """As trim_left, from the other end."""
    mirrored = build([(k, v[::-1] if k in "+-" else v) for k, v in reversed(parse(cs))])
    text, r, q = trim_left(mirrored, ref)
    return build([(k, v[::-1] if k in "+-" else v) for k, v in reversed(parse(text))]), r, q


def _split(a: pd.Series, b: pd.Series, shared: pd.Series) -> pd.DataFrame:
    rows = []
    for x, y, n in zip(a, b, shared, strict=True):
        n = max(0, int(n or 0))
        left, _, lq = trim_right(x or "", n // 2)
        right, _, rq = trim_left(y or "", n - n // 2)
        rows.append((left, lq, right, rq))
    return pd.DataFrame(rows, columns=["left", "left_query", "right", "right_query"])


def split_overlap(a: Column, b: Column, shared: Column) -> Column:
    """Two neighbouring alignments that share reference bases, each trimmed to the middle of what they share."""
    udf = F.pandas_udf(_split, "struct<left:string,left_query:long,right:string,right_query:long>")
    return udf(a, b, shared.cast("long"))
