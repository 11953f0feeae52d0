"""Token counts by field or section: whole documents are encoded once, tokens are attributed by character offsets.

A section is a span of characters. The tokens of the whole document, sorted by the character at which they start,
are joined to the sections, sorted by theirs. A token that crosses a boundary goes where its rule says:
"first": to the section of its first character; "last": to that of its last one; "most": to the section that
holds most of its characters, the first of equals.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandweave.llm.tokens import default_tokenizer, encoder

RULES = ("first", "last", "most")


def attribute(starts: np.ndarray, n_chars: int, cuts: np.ndarray, rule: str = "first") -> tuple[np.ndarray, np.ndarray]:
    """Tokens of each section, and tokens that cross out of it to a later one.

    starts: first character of each token, ascending; a token ends where the next other character starts. cuts: the
    first character of each section, ascending from 0; a section ends where the next one starts.
    """
    if rule not in RULES:
        raise ValueError(f"rule must be one of {RULES}")
    n = len(cuts)
    if not len(starts):
        return np.zeros(n, np.int64), np.zeros(n, np.int64)
    following = np.searchsorted(starts, starts, "right")  # tokens of one character share their span
    ends = np.append(starts, n_chars)[following]
    first = np.searchsorted(cuts, starts, "right") - 1
    last = np.searchsorted(cuts, np.maximum(ends - 1, starts), "right") - 1
    crossing = np.bincount(first[last > first], minlength=n)
    own = first.copy()
    if rule == "last":
        own = last
    elif rule == "most":
        bounds = np.append(cuts, n_chars)
        for i in np.flatnonzero(last > first).tolist():
            s = np.arange(first[i], last[i] + 1)
            held = np.minimum(bounds[s + 1], ends[i]) - np.maximum(bounds[s], starts[i])
            own[i] = s[held.argmax()]
    return np.bincount(own, minlength=n), crossing


def line_sections(text: str) -> np.ndarray:
    """First characters of the lines of text; a line keeps its line end. The empty text has one line."""
    marks = [0]
    at = text.find("\n")
    while 0 <= at < len(text) - 1:
        marks.append(at + 1)
        at = text.find("\n", at + 1)
    return np.array(marks, np.int64)


def _emit(counted: list[tuple], id_field: pa.Array) -> pa.RecordBatch:
    each = np.array([len(c[0]) for c in counted], np.int64)
    cols = [np.concatenate(c) if counted else np.zeros(0, np.int64) for c in (zip(*counted, strict=True) if counted else [[]] * 4)]
    take = pa.array(np.repeat(np.arange(len(counted)), each))
    section = np.concatenate([np.arange(n) for n in each.tolist()]) if counted else np.zeros(0, np.int64)
    return pa.RecordBatch.from_arrays(
        [id_field.take(take), pa.array(section, pa.int32()), *(pa.array(c.astype(np.int64)) for c in cols)],
        ["doc_id", "section", "start_char", "end_char", "n_tokens", "n_crossing"],
    )


def tokens_by_line(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rule: str = "first", tokenizer: str | None = None) -> DataFrame:
    """doc_id, section (line from 0), start_char, end_char, n_tokens, n_crossing of every line of every text.

    n_tokens of a document's lines add up to the tokens of its whole text. Null or empty text has one section of no
    tokens. Rows that repeat an id, and null ids, are rows as any; an empty table gives an empty result.
    """
    path = tokenizer or default_tokenizer()
    if rule not in RULES:
        raise ValueError(f"rule must be one of {RULES}")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(path)
        for b in batches:
            for i in range(0, max(1, len(b)), 256):
                part = b.slice(i, 256)
                counted = []
                for text in part.column("text").to_pylist():
                    text = text or ""
                    cuts = line_sections(text)
                    n, crossing = attribute(enc.starts(text), len(text), cuts, rule)
                    counted.append((cuts, np.append(cuts[1:], len(text)), n, crossing))
                if counted:
                    yield _emit(counted, part.column("doc_id"))

    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(run, f"doc_id {kind}, section int, start_char long, end_char long, n_tokens long, n_crossing long")


def tokens_by_field(df: DataFrame, id_col: str, fields: list[str], joiner: str = "\n", rule: str = "first", tokenizer: str | None = None) -> DataFrame:
    """id, field, n_tokens, n_crossing of the fields of each row, encoded as one text joined by `joiner`.

    A field's span includes the joiner that follows it. Null fields are empty and have a row with what falls on
    their joiner; a row's n_tokens add up to the tokens of its joined text. Rows that repeat an id, and null ids, are rows
    as any; an empty table gives an empty result; other columns, and fields named id or field, do no harm.
    """
    if rule not in RULES:
        raise ValueError(f"rule must be one of {RULES}")
    path = tokenizer or default_tokenizer()
    names = list(fields)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(path)
        for b in batches:
            cols = [b.column(1 + k).to_pylist() for k in range(len(names))]
            out = []
            for row in zip(*cols, strict=True):
                parts = [(x or "") + (joiner if k < len(names) - 1 else "") for k, x in enumerate(row)]
                cuts = np.cumsum([0, *map(len, parts)])[:-1]
                text = "".join(parts)
                # an empty last field starts at the end of the text and gets nothing
                out.append(attribute(enc.starts(text), len(text), cuts, rule))
            at = pa.array(np.repeat(np.arange(len(b)), len(names)))
            n = np.concatenate([o[0] for o in out]) if out else np.zeros(0, np.int64)
            x = np.concatenate([o[1] for o in out]) if out else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays([b.column(0).take(at), pa.array(names * len(b), pa.string()), pa.array(n), pa.array(x)], ["id", "field", "n_tokens", "n_crossing"])

    kind = df.schema[id_col].dataType.simpleString()
    rows = df.select(F.col(id_col).alias("id"), *(F.col(f).cast("string").alias(f"f{k}") for k, f in enumerate(names)))
    return rows.mapInArrow(run, f"id {kind}, field string, n_tokens long, n_crossing long")
