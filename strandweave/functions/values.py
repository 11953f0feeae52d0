"""Numbers, flags and labels."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def similar(a: Column, b: Column, ratio: float, difference: float = 5.0, zero: bool = False) -> Column:
    """max / min <= ratio, or max - min < difference; what a zero gives is a parameter."""
    lo, hi = F.least(a, b), F.greatest(a, b)
    return F.when(lo == 0, F.lit(zero)).otherwise((hi <= ratio * lo) | (hi - lo < difference))


def safe_divide(a: Column, b: Column) -> Column:
    """a / b with signed infinity for b = 0 (and NaN for 0 / 0)."""
    inf = F.when(a > 0, F.lit(float("inf"))).when(a < 0, F.lit(float("-inf"))).otherwise(F.lit(float("nan")))
    return F.when(b == 0, inf).otherwise(a.cast("double") / b)


def flag(text: Column) -> Column:
    """1, true and 0, false in any case as booleans; null for anything else."""
    t = F.lower(F.trim(text.cast("string")))
    return F.when(t.isin("1", "true"), True).when(t.isin("0", "false"), False)


def optional_double(text: Column) -> Column:
    """A finite number, or null."""
    x = F.trim(text.cast("string")).try_cast("double")
    return F.when(F.isnan(x) | (F.abs(x) == float("inf")), None).otherwise(x)


def ratio(part: Column, rest: Column) -> Column:
    """part / (part + rest), null where both are 0."""
    return part / F.nullif(part + rest, F.lit(0))


def balanced(a: Column, b: Column, limit: float = 1.1) -> Column:
    """The larger is at most `limit` times the smaller; two zeros are balanced."""
    return F.greatest(a, b) <= limit * F.least(a, b)


def copy_text(value: Column) -> Column:
    """A copy number with two decimals, half to even; * for null."""
    return F.coalesce(F.format_string("%.2f", F.bround(value, 2)), F.lit("*"))


def event_id(prefix: str, number: Column) -> Column:
    return F.concat(F.lit(f"{prefix}."), number.cast("string"))


def path_labels(text: Column) -> Column:
    """struct(first_chr, first_end, second_chr, second_end) of chrAf_chrBb, the smaller end first; else null."""
    pattern = r"^(chr[0-9A-Za-z]+)([fb])_(chr[0-9A-Za-z]+)([fb])$"
    part = lambda k: F.regexp_extract(text, pattern, k)
    a = F.struct(part(1).alias("chr"), part(2).alias("end"))
    b = F.struct(part(3).alias("chr"), part(4).alias("end"))
    lo, hi = F.least(a, b), F.greatest(a, b)
    return F.when(part(1) != "", F.struct(lo["chr"].alias("first_chr"), lo["end"].alias("first_end"), hi["chr"].alias("second_chr"), hi["end"].alias("second_end")))


def short_chromosome(chrom: Column) -> Column:
    return F.regexp_replace(chrom, "^chr", "")


def karyotype(pieces: Column, extra: Column | None = None) -> Column:
    """Text of an ordered array of pieces (chr, strand): t(a;b) where the chromosome changes, inv(a) where only the
    strand does, chr alone where neither; extra labels follow."""
    n = F.size(pieces)
    steps = F.transform(F.sequence(F.lit(1), n - 1), lambda i: F.struct(F.get(pieces, i - 1).alias("p"), F.get(pieces, i).alias("q")))
    told = F.transform(
        steps,
        lambda s: F.when(
            s["p"]["chr"] != s["q"]["chr"], F.concat(F.lit("t("), short_chromosome(s["p"]["chr"]), F.lit(";"), short_chromosome(s["q"]["chr"]), F.lit(")"))
        ).when(s["p"]["strand"] != s["q"]["strand"], F.concat(F.lit("inv("), short_chromosome(s["p"]["chr"]), F.lit(")"))),
    )
    changes = F.when(n > 1, F.filter(told, lambda x: x.isNotNull())).otherwise(F.array().cast("array<string>"))
    if extra is not None:
        changes = F.concat(changes, F.coalesce(extra, F.array().cast("array<string>")))
    return F.when(n == 0, None).when(F.size(changes) == 0, short_chromosome(F.get(pieces, F.lit(0))["chr"])).otherwise(F.array_join(F.array_distinct(changes), ","))


def segments_text(segments: Column, most: int = 3) -> Column:
    """Distinct labels of the first segments (chr, st, nd), joined by |."""
    text = F.transform(segments, lambda s: F.format_string("%s:%d-%d", s["chr"], s["st"], s["nd"]))
    return F.array_join(F.slice(F.array_distinct(text), 1, most), "|")
