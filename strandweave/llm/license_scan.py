"""License scan: ordered signature rules over normalised words, in DataFrame expressions only.

A text becomes its words (runs of digits, letters and characters beyond ASCII) joined by single spaces. A cheap
gate of substrings decides which texts meet any rule; a rule's own keyword decides whether its pattern is run.
Each match is an interval of words. An interval that lies within one of a rule of the same or a higher
priority is suppressed; what stays gives the labels. Base phrases come first of all and are never suppressed.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Rule:
    priority: int  # 0 first
    label: str
    confidence: float
    keyword: str  # a substring, in lower case, of every text that the pattern matches
    pattern: str  # over words and single spaces, in lower case; matched whatever the case of A-Z
    base: bool = False


#: The base phrases and their labels.
BASE = (("under the mit license", "mit"), ("apache license version 2", "apache-2"), ("cc by nc", "cc-by-nc"))

#: Families as (label, keyword, pattern of the name, pattern of the SPDX identifier in words). Names
#: without a substring in common are rows of their own; the SPDX identifier stands in one of these.
FAMILIES = (
    ("mit", "mit", r"mit", r"mit"),
    ("mit", "expat", r"expat", None),
    ("mit", "x11", r"x11", None),
    ("mit-0", "mit", r"mit 0|mit no attribution", r"mit 0"),
    ("apache-2", "apache", r"apache(?: software)? licen[sc]e v?2(?: 0)?|apache 2(?: 0)?|apache version 2(?: 0)?", r"apache 2 0"),
    ("apache-1", "apache", r"apache(?: software)? licen[sc]e (?:version )?1(?: [01])?|apache 1(?: [01])?", r"apache 1 [01]"),
    ("gpl-3", "gnu", r"gnu (?:general public licen[sc]e|gpl)(?: version| v)? ?3(?: 0)?", r"gpl 3 0(?: only| or later)?"),
    ("gpl-2", "gnu", r"gnu (?:general public licen[sc]e|gpl)(?: version| v)? ?2(?: 0)?", r"gpl 2 0(?: only| or later)?"),
    ("gpl", "gnu", r"gnu (?:general public licen[sc]e|gpl)", r"gpl"),
    ("gpl-3", "gpl", r"gpl ?v?3(?: 0)?", r"gplv3"),
    ("gpl-2", "gpl", r"gpl ?v?2(?: 0)?", r"gplv2"),
    ("lgpl-3", "lesser", r"gnu lesser general public licen[sc]e(?: version| v)? ?3(?: 0)?", r"lgpl 3 0(?: only| or later)?"),
    ("lgpl-2", "lesser", r"gnu lesser general public licen[sc]e(?: version| v)? ?2(?: [01])?", r"lgpl 2 [01](?: only| or later)?"),
    ("lgpl-2", "library", r"gnu library general public licen[sc]e(?: version| v)? ?2(?: [01])?", None),
    ("lgpl", "lgpl", r"lgpl ?(?:v?[23](?: [01])?)?", r"lgpl"),
    ("agpl-3", "affero", r"gnu affero general public licen[sc]e(?: version| v)?(?: ?3(?: 0)?)?", r"agpl 3 0(?: only| or later)?"),
    ("agpl-3", "agpl", r"agpl ?v?3?(?: 0)?", r"agpl"),
    ("bsd-2", "bsd", r"(?:2|two) clause bsd|bsd (?:2|two) clause|simplified bsd|freebsd", r"bsd 2 clause"),
    ("bsd-3", "bsd", r"(?:3|three) clause bsd|bsd (?:3|three) clause|new bsd|modified bsd|revised bsd", r"bsd 3 clause"),
    ("bsd-4", "bsd", r"(?:4|four) clause bsd|bsd (?:4|four) clause|original bsd", r"bsd 4 clause"),
    ("bsd", "bsd", r"bsd(?: style)?", r"bsd"),
    ("0bsd", "bsd", r"zero clause bsd|bsd zero clause|0bsd", r"0bsd"),
    ("isc", "isc", r"isc", r"isc"),
    ("isc", "internet systems", r"internet systems consortium", None),
    ("mpl-2", "moz", r"mozilla public licen[sc]e(?: version| v)? ?2(?: 0)?", r"mpl 2 0"),
    ("mpl-1", "moz", r"mozilla public licen[sc]e(?: version| v)? ?1(?: [01])?", r"mpl 1 [01]"),
    ("mpl", "moz", r"mozilla public licen[sc]e", r"mpl"),
    ("mpl", "mpl", r"mpl", None),
    ("epl-2", "ecl", r"eclipse public licen[sc]e(?: version| v)? ?2(?: 0)?", r"epl 2 0"),
    ("epl-1", "ecl", r"eclipse public licen[sc]e(?: version| v)? ?1(?: 0)?", r"epl 1 0"),
    ("cddl", "development", r"common development and distribution licen[sc]e(?:(?: version| v)? 1(?: [01])?)?", r"cddl 1 [01]"),
    ("eupl", "european union", r"european union public licen[sc]e(?:(?: version| v)? 1(?: [012])?)?", r"eupl 1 [012]"),
    ("artistic", "artistic", r"artistic licen[sc]e(?: 2(?: 0)?)?", r"artistic [12] 0"),
    ("zlib", "zlib", r"zlib(?: libpng)?", r"zlib"),
    ("boost", "boost", r"boost software licen[sc]e(?:(?: version| v)? 1(?: 0)?)?", r"bsl 1 0"),
    ("unlicense", "unlicen", r"unlicen[sc]e", r"unlicense"),
    ("wtfpl", "wtfpl", r"wtfpl", r"wtfpl"),
    ("python-2", "python", r"python software foundation licen[sc]e", r"python 2 0"),
    ("python-2", "psf", r"psf licen[sc]e", None),
    ("ofl", "open font", r"sil open font licen[sc]e(?:(?: version| v)? 1(?: [01])?)?", r"ofl 1 [01]"),
    ("odbl", "open database", r"open database licen[sc]e", r"odbl 1 0"),
    ("gfdl", "free documentation", r"gnu free documentation licen[sc]e(?:(?: version| v)? 1(?: [123])?)?", r"gfdl 1 [123](?: only| or later)?"),
    ("cc0", "cc0", r"cc0(?: 1 0)?", r"cc0 1 0"),
    ("cc-by-nc-nd", "cc by nc nd", r"cc by nc nd(?: [1-4] [05])?", r"cc by nc nd [1-4] [05]"),
    ("cc-by-nc-sa", "cc by nc sa", r"cc by nc sa(?: [1-4] [05])?", r"cc by nc sa [1-4] [05]"),
    ("cc-by-nc", "cc by nc", r"cc by nc(?: [1-4] [05])?", r"cc by nc [1-4] [05]"),
    ("cc-by-nd", "cc by nd", r"cc by nd(?: [1-4] [05])?", r"cc by nd [1-4] [05]"),
    ("cc-by-sa", "cc by sa", r"cc by sa(?: [1-4] [05])?", r"cc by sa [1-4] [05]"),
    ("cc-by", "cc by", r"cc by(?: [1-4] [05])?", r"cc by [1-4] [05]"),
    ("cc-by-nc", "attribution noncommercial", r"(?:creative commons )?attribution noncommercial(?: [1-4] [05])?", r"creative commons by nc"),
    ("cc-by-sa", "attribution share", r"(?:creative commons )?attribution share ?alike(?: [1-4] [05])?", r"creative commons by sa"),
    ("cc", "creative commons", r"creative commons", r"creative commons"),
)

#: Sentences around a name, most specific first, as (priority, confidence, pattern with NAME).
TEMPLATES = (
    (1, 0.99, r"spdx licen[sc]e identifier SPDX"),
    (2, 0.95, r"(?:is |are )?(?:licen[sc]ed|released|distributed|available|published|provided) under (?:the )?(?:terms of (?:the )?)?(?:NAME)(?: licen[sc]e)?"),
    (3, 0.9, r"under (?:the )?(?:terms of (?:the )?)?(?:NAME)(?: licen[sc]e)?"),
    (4, 0.85, r"(?:NAME)(?: public)? licen[sc]e"),
    (5, 0.8, r"licen[sc]e (?:is )?(?:NAME)"),
)

#: Notices that belong to no family.
NOTICES = (
    Rule(6, "public-domain", 0.7, "public domain", r"(?:dedicated to|placed in|released into|in) the public domain"),
    Rule(6, "all-rights-reserved", 0.6, "rights reserved", r"all rights reserved"),
    Rule(6, "copyright", 0.5, "copyright", r"copyright (?:c )?(?:19|20)[0-9]{2}"),
    Rule(6, "no-warranty", 0.5, "without warrant", r"without warrant(?:y|ies) of any kind"),
    Rule(6, "proprietary", 0.6, "proprietary", r"proprietary (?:and confidential|licen[sc]e)"),
)
PRIORITIES = 7

#: Every text that a rule of this module matches holds one of these; rules given by the caller add their own keywords.
GATE = ("licen", "under the ", "under ", "cc by", "attribution", "public domain", "rights reserved", "copyright", "warrant", "proprietary")


def rules() -> list[Rule]:
    """All rules in order: base phrases, families by template, notices."""
    out = [Rule(0, label, 1.0, phrase.split()[-2] if "cc" not in phrase else "cc by nc", phrase, True) for phrase, label in BASE]
    for priority, confidence, template in TEMPLATES:
        for label, keyword, name, spdx in FAMILIES:
            spdx_rule = "SPDX" in template
            if spdx_rule and spdx is None:
                continue
            out.append(Rule(priority, label, confidence, "spdx" if spdx_rule else keyword, template.replace("NAME", name).replace("SPDX", f"(?:{spdx})")))
    out.extend(Rule(4, label, 0.85, keyword, name) for label, keyword, name, _ in FAMILIES if label.startswith("cc-"))
    return [*out, *NOTICES]


def words_of(text: Column) -> Column:
    """Words joined by single spaces; '' for null."""
    return F.trim(F.regexp_replace(F.coalesce(text, F.lit("")), r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", " "))


def _count(words: Column) -> Column:
    """Number of words in a trimmed or untrimmed string of words and single spaces."""
    t = F.trim(words)
    return F.when(t == "", 0).otherwise(F.length(t) - F.length(F.replace(t, F.lit(" "), F.lit(""))) + 1)


def scan_licenses(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", extra: list[Rule] | None = None) -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score, detections of every row.

    n_base counts the places of all base phrases; first_word and last_word are the smallest and largest of their
    starts (words from 0; null without any). labels holds base labels and those of detections that stay; both are
    distinct, sorted, comma-joined, empty without any. score is the confidence of the best detection that stays, 0
    without any. detections lists (start, end, label) of those. Null text has no words. Rows that repeat an id are
    rows of their own; null ids pass through; other columns are not looked at; an empty table gives none. A very long text
    is matched whole. extra: rules of the caller's after those of this module; any text may stand in them, a pattern
    matches only texts that hold its keyword, and priorities from 0 to 6 suppress as described.
    """
    table = [*rules(), *(extra or [])]
    rule_list = F.array(
        *[
            F.struct(
                F.lit(k).alias("k"), F.lit(r.priority).alias("p"), F.lit(r.label).alias("label"), F.lit(float(r.confidence)).alias("conf"), F.lit(r.keyword.lower()).alias("kw"),
                F.lit(f"(?i)(?<![^ ])(?:{r.pattern})(?![^ ])").alias("re"), F.lit(r.base).alias("base"),
            )
            for k, r in enumerate(table)
        ]
    )
    text = F.col(text_col).cast("string")
    low = F.lower("_w")
    gate = F.lit(False)
    for g in (*GATE, *(r.keyword.lower() for r in extra or [])):
        gate = gate | F.contains(low, F.lit(g))
    rows = docs.select(F.monotonically_increasing_id().alias("_rid"), F.col(id_col).alias("doc_id"), words_of(text).alias("_w"))
    rows = rows.withColumn("n_words", _count(F.col("_w")).cast("long"))
    rows = rows.withColumn("_rules", F.when(gate, F.filter(rule_list, lambda r: F.contains(F.lower("_w"), r["kw"]))))
    rows = rows.select("_rid", "doc_id", "n_words", "_w", F.explode_outer("_rules").alias("_r"))
    rows = rows.withColumn("_found", F.regexp_extract_all("_w", F.col("_r.re"), F.lit(0)))
    hit = F.when(F.size("_found") > 0, F.arrays_zip(F.split("_w", F.col("_r.re")).alias("gap"), F.col("_found").alias("match")))
    rows = rows.select("_rid", "doc_id", "n_words", "_r.k", "_r.p", "_r.label", "_r.conf", "_r.base", F.posexplode_outer(hit).alias("_pos", "_m"))
    rows = rows.select(
        "_rid", "doc_id", "n_words", "k", "p", "label", "conf", "base", "_pos",
        _count(F.col("_m.gap")).alias("_gap"), F.when(F.col("_m.match").isNotNull(), _count(F.col("_m.match"))).alias("_len"),
    ).where("_pos is null or _len is not null or _pos = 0").repartition("_rid")
    along = Window.partitionBy("_rid", "k").orderBy("_pos")
    upto, before = along.rowsBetween(Window.unboundedPreceding, 0), along.rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("start", F.sum("_gap").over(upto) + F.coalesce(F.sum("_len").over(before), F.lit(0)))
    rows = rows.withColumn("start", F.when(F.col("_len").isNotNull(), F.col("start"))).withColumn("end", F.col("start") + F.col("_len"))
    earlier = Window.partitionBy("_rid").orderBy(F.col("start").asc_nulls_last(), F.col("end").desc(), "p", "k").rowsBetween(Window.unboundedPreceding, -1)
    reach = F.array(*[F.max(F.when(F.col("p") <= q, F.col("end"))).over(earlier) for q in range(PRIORITIES)])
    rows = rows.withColumn("_reach", reach)
    covered = F.coalesce(F.element_at("_reach", F.least(F.col("p"), F.lit(PRIORITIES - 1)) + 1) >= F.col("end"), F.lit(False))
    rows = rows.withColumn("_stays", F.col("start").isNotNull() & (F.col("base") | ~covered))
    base = F.col("base") & F.col("start").isNotNull()

    def joined(names: Column) -> Column:
        return F.array_join(F.array_sort(F.collect_set(names)), ",")

    return rows.groupBy("_rid").agg(
        F.first("doc_id").alias("doc_id"),
        F.first("n_words").alias("n_words"),
        F.count(F.when(base, 1)).alias("n_base"),
        F.min(F.when(base, F.col("start"))).cast("long").alias("first_word"),
        F.max(F.when(base, F.col("start"))).cast("long").alias("last_word"),
        joined(F.when(base, F.col("label"))).alias("base_labels"),
        joined(F.when(F.col("_stays"), F.col("label"))).alias("labels"),
        F.coalesce(F.max(F.when(F.col("_stays"), F.col("conf"))), F.lit(0.0)).alias("score"),
        F.array_sort(F.collect_list(F.when(F.col("_stays"), F.struct("start", "end", "label")))).alias("detections"),
    ).drop("_rid")
