"""Benchmark decontamination with a generalised suffix automaton of the normalised benchmark items.

Every document's words stream through the automaton, which keeps the longest match that ends at each word. Where
that reaches `window` words, the last `window` of them stand in some item; items with fewer words count as one
window each. The union of such occurrences is what is hit.

Items are dealt by a hash of their id to automata of about `shard_words` words (some 300 bytes of worker memory a word),
so that a benchmark of any size is matched: the items are written to the shared folder, workers read those of one
automaton and build it, and each automaton passes over the same documents. The spans of all automata are put together
before anything is judged or cut, so the number of automata changes no result. The driver holds no items.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.dataset as pads
import pyarrow.fs as pafs
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandweave.llm import bytekit as bk
from strandweave.runtime import cut, new_folder

#: Bytes that are not part of a word become spaces; A-Z become a-z.
_TABLE = bytes((b + 32 if 65 <= b <= 90 else b) if bk.ALNUM[b] else 32 for b in range(256))


def words(text: str | None) -> list[bytes]:
    """Maximal runs of digits, letters and characters beyond ASCII, A-Z lower-cased."""
    return (text or "").encode("utf-8", "replace").translate(_TABLE).split()


class Automaton:
    """Generalised suffix automaton over word numbers, with the items behind each window."""

    def __init__(self, items: list[tuple[str, list[bytes]]], window: int):
        self.window = window
        self.vocabulary: dict[bytes, int] = {}
        self.next: list[dict[int, int]] = [{}]
        self.link, self.length = [-1], [0]
        coded = [(item, [self.vocabulary.setdefault(w, len(self.vocabulary)) for w in ws]) for item, ws in items if ws]
        for _, ws in coded:
            last = 0
            for w in ws:
                last = self._extend(last, w)
        # the state that holds the last `window` words of any match at least that long
        order = sorted(range(1, len(self.link)), key=self.length.__getitem__)
        self.window_state = [0] * len(self.link)
        for v in order:
            if self.length[v] >= window:
                up = self.link[v]
                self.window_state[v] = v if self.length[up] < window else self.window_state[up]
        self.items_at: dict[int, set[int]] = {}
        short: dict[int, list[tuple[int, int]]] = {}
        for item, ws in coded:
            v = 0
            for i, w in enumerate(ws):
                v = self.next[v][w]  # prefixes of items are strings of the automaton
                if i + 1 >= window:
                    self.items_at.setdefault(self.window_state[v], set()).add(item)
            if len(ws) < window:
                short.setdefault(v, []).append((len(ws), item))
        self.short: dict[int, list[tuple[int, int]]] = {}
        if short:
            for v in order:
                own = short.get(v, []) + self.short.get(self.link[v], [])
                if own:
                    self.short[v] = own

    def _extend(self, last: int, w: int) -> int:
        nxt, link, length = self.next, self.link, self.length
        if w in nxt[last]:
            q = nxt[last][w]
            if length[q] == length[last] + 1:
                return q
            return self._clone(last, w, q)
        cur = len(link)
        nxt.append({})
        link.append(0)
        length.append(length[last] + 1)
        p = last
        while p >= 0 and w not in nxt[p]:
            nxt[p][w] = cur
            p = link[p]
        if p >= 0:
            q = nxt[p][w]
            link[cur] = q if length[q] == length[p] + 1 else self._clone(p, w, q)
        return cur

    def _clone(self, p: int, w: int, q: int) -> int:
        c = len(self.link)
        self.next.append(dict(self.next[q]))
        self.link.append(self.link[q])
        self.length.append(self.length[p] + 1)
        self.link[q] = c
        while p >= 0 and self.next[p].get(w) == q:
            self.next[p][w] = c
            p = self.link[p]
        return c

    def scan(self, doc: list[bytes]) -> tuple[list[tuple[int, int]], set[int], int]:
        """Occurrences (word intervals, merged), items that occur, and the longest match in words."""
        nxt, link, length, window, short = self.next, self.link, self.length, self.window, self.short
        found: list[tuple[int, int]] = []
        items: set[int] = set()
        v = best = matched = 0
        for i, w in enumerate(map(self.vocabulary.get, doc)):
            if w is None:
                v = matched = 0
                continue
            while v and w not in nxt[v]:
                v = link[v]
                matched = length[v]
            v = nxt[v].get(w, 0)
            matched = matched + 1 if v else 0
            if matched > best:
                best = matched
            if matched >= window:
                found.append((i + 1 - window, i + 1))
                items |= self.items_at.get(self.window_state[v], set())
            if short and v in short:
                for n, item in short[v]:
                    if n <= matched:
                        found.append((i + 1 - n, i + 1))
                        items.add(item)
        return merge(found), items, best


def merge(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def without_spans(text: str, spans: list[tuple[int, int]]) -> str:
    """text without the words of these intervals, and without what stands between a span and the next word."""
    data = text.encode("utf-8", "replace")
    flat, at, starts = data.translate(_TABLE), 0, []
    for w in flat.split():
        at = flat.index(w, at)
        starts.append(at)
        at += len(w)
    out, last = [], 0
    for a, b in spans:
        out.append(data[last : starts[a]])
        last = starts[b] if b < len(starts) else len(data)
    out.append(data[last:])
    return b"".join(out).decode("utf-8")


@functools.lru_cache(maxsize=1)
def _automaton(folder: str, shard: int, window: int) -> Automaton:
    """The automaton of one shard of written items; a worker keeps the last one that it has built."""
    fs, root = pafs.FileSystem.from_uri(folder)
    items = pads.dataset(root, filesystem=fs, format="parquet").to_table(filter=pads.field("shard") == shard)
    rows = sorted(zip(items.column("item").to_pylist(), items.column("text").to_pylist(), strict=True))
    return Automaton([(item, words(text)) for item, text in rows], window)


def write_items(benchmark: DataFrame, shard_words: int) -> tuple[str, int]:
    """Writes (shard, item, text) of all items with id and text to the shared folder; the folder and number of shards."""
    items = benchmark.where("item_id is not null and text is not null").select(F.col("item_id").cast("string").alias("item"), F.col("text").cast("string").alias("text"))
    size = items.agg(F.sum(F.size(F.split("text", r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")))).first()[0] or 0
    shards = max(1, -(-size // shard_words))
    folder = new_folder(benchmark.sparkSession, "items")
    items.select(F.pmod(F.xxhash64("item"), F.lit(shards)).cast("int").alias("shard"), "item", "text").repartition("shard").write.parquet(folder)
    return folder, shards


_SPANS = "array<struct<start:long,end:long>>"
_SPAN_TYPE = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))


def _scanned(folder: str, shard: int, window: int):
    """Arrow UDF: struct of n_words, spans, items and longest of each text, by one automaton."""

    @F.arrow_udf(f"n_words long, spans {_SPANS}, items array<string>, longest long")
    def scan(col: pa.Array) -> pa.Array:
        automaton = _automaton(folder, shard, window)
        n, spans, items, longest = [], [], [], []
        for text in col:
            ws = words(text.as_py())
            s, i, m = automaton.scan(ws)
            n.append(len(ws))
            spans.append([{"start": x, "end": y} for x, y in s])
            items.append(sorted(i))
            longest.append(m)
        return pa.StructArray.from_arrays(
            [pa.array(n, pa.int64()), pa.array(spans, _SPAN_TYPE), pa.array(items, pa.list_(pa.string())), pa.array(longest, pa.int64())], ["n_words", "spans", "items", "longest"]
        )

    return scan


def _merged(spans: Column) -> Column:
    """Spans sorted and put together where they meet."""

    def step(acc: Column, s: Column) -> Column:
        last = F.get(acc, F.size(acc) - 1)
        joined = F.struct(last["start"].alias("start"), F.greatest(last["end"], s["end"]).alias("end"))
        head = F.slice(acc, F.lit(1), F.greatest(F.size(acc) - 1, F.lit(0)))
        return F.when((F.size(acc) > 0) & (s["start"] <= last["end"]), F.concat(head, F.array(joined))).otherwise(F.concat(acc, F.array(s)))

    return F.aggregate(F.array_sort(spans), F.array().cast(_SPANS), step)


def _matched(rows: DataFrame, row: str, items: tuple[str, int], window: int) -> DataFrame:
    """row, n_words, spans, items, longest by all automata; rows (row, text) must be a written table if there are several."""
    folder, shards = items
    found = [rows.select(row, _scanned(folder, k, window)("text").alias("_m")).select(row, "_m.*") for k in range(shards)]
    if shards == 1:
        return found[0]
    every = functools.reduce(DataFrame.unionByName, found)
    by = every.groupBy(row).agg(
        F.first("n_words").alias("n_words"), F.flatten(F.collect_list("spans")).alias("spans"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"), F.max("longest").alias("longest"),
    )
    return by.withColumn("spans", F.when(F.size("spans") > 1, _merged(F.col("spans"))).otherwise(F.col("spans")))


def match_benchmark(docs: DataFrame, benchmark: DataFrame, window: int = 13, shard_words: int = 200_000) -> DataFrame:
    """doc_id, n_words, spans (word intervals hit), items (ids, as strings, with an occurring window), longest (match in words).

    One row per row of docs; ids are of any type. Null text has no words; items of null id or text, or without words,
    never occur; rows that repeat an item_id are one item with several texts. Empty tables give no rows, or rows without
    hits. A very long text is scanned whole; memory follows its number of words. shard_words changes no result.
    """
    items = write_items(benchmark, shard_words)
    rows = docs.select(F.monotonically_increasing_id().alias("_rid"), "doc_id", F.col("text").cast("string").alias("text"))
    if items[1] == 1:
        return rows.select("doc_id", _scanned(items[0], 0, window)("text").alias("_m")).select("doc_id", "_m.*")
    rows = cut(rows, "documents")
    return rows.select("_rid", "doc_id").join(_matched(rows, "_rid", items, window), "_rid").drop("_rid")


def contamination(docs: DataFrame, benchmark: DataFrame, window: int = 13, coverage: int = 20, **options) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256, contaminated, longest of every row of docs.

    contaminated: n_hit > 0 and coverage * n_hit >= n_words. items_sha256 without items is that of the empty string.
    """
    found = match_benchmark(docs, benchmark, window, **options)
    hit = F.aggregate("spans", F.lit(0).cast("long"), lambda acc, s: acc + s["end"] - s["start"])
    joined = F.array_join("items", ",")  # sorted as strings
    out = found.select("doc_id", "n_words", hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"), F.sha2(joined.cast("binary"), 256).alias("items_sha256"), "longest")
    return out.withColumn("contaminated", (F.col("n_hit") > 0) & (coverage * F.col("n_hit") >= F.col("n_words"))).select(
        "doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated", "longest"
    )


def decontaminate(docs: DataFrame, benchmark: DataFrame, window: int = 13, coverage: int = 20, remove: str = "documents", shard_words: int = 200_000) -> DataFrame:
    """docs, with all their columns, without benchmark text.

    remove="documents": rows whose hit words reach 1 / coverage of their words go, all others stay as they are.
    remove="spans": every row stays, and the words that windows of any item hit are cut out of its text, all at once. Null
    texts, and texts without a hit, stay as they are. Repeated rows and null ids are rows as any.
    """
    if remove not in ("documents", "spans"):
        raise ValueError("remove must be documents or spans")
    folder, shards = write_items(benchmark, shard_words)
    if shards == 1:
        text = F.col("text").cast("string")
        return docs.withColumn("text", _cut_udf(folder, window)(text)) if remove == "spans" else docs.where(~_judge_udf(folder, window, coverage)(text))
    name, spans = "_row", "_spans"
    while {name, spans} & set(docs.columns):
        name, spans = name + "_", spans + "_"
    rows = cut(docs.withColumn(name, F.monotonically_increasing_id()), "documents")
    found = _matched(rows.select(name, F.col("text").cast("string").alias("text")), name, (folder, shards), window)
    found = found.where(F.size("spans") > 0)
    hit = F.aggregate("spans", F.lit(0).cast("long"), lambda acc, s: acc + s["end"] - s["start"])
    if remove == "documents":
        return rows.join(found.where(coverage * hit >= F.col("n_words")).select(name), name, "left_anti").drop(name)
    out = rows.join(found.select(name, F.col("spans").alias(spans)), name, "left")
    return out.withColumn("text", F.when(F.col(spans).isNotNull(), _cut_spans_udf()(F.col("text").cast("string"), F.col(spans))).otherwise(F.col("text"))).select(docs.columns)


def _judge_udf(folder: str, window: int, coverage: int):
    @F.arrow_udf("boolean")
    def judge(col: pa.Array) -> pa.Array:
        automaton, out = _automaton(folder, 0, window), []
        for text in col:
            ws = words(text.as_py())
            hit = sum(b - a for a, b in automaton.scan(ws)[0])
            out.append(hit > 0 and coverage * hit >= len(ws))
        return pa.array(out, pa.bool_())

    return judge


def _cut_udf(folder: str, window: int):
    @F.arrow_udf("string")
    def cut_out(col: pa.Array) -> pa.Array:
        automaton, out = _automaton(folder, 0, window), []
        for text in col:
            t = text.as_py()
            spans = automaton.scan(words(t))[0]
            out.append(without_spans(t, spans) if spans else t)
        return pa.array(out, pa.string())

    return cut_out


def _cut_spans_udf():
    @F.arrow_udf("string")
    def cut_out(col: pa.Array, spans: pa.Array) -> pa.Array:
        out = []
        for text, s in zip(col.to_pylist(), spans.to_pylist(), strict=True):
            out.append(without_spans(text, [(x["start"], x["end"]) for x in s]) if text is not None and s else text)
        return pa.array(out, pa.string())

    return cut_out
