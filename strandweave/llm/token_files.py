"""Token-id files: independent zstandard frames, a trailing seek table, a checksum for each frame.

One file holds documents in ascending order of id:

    frame 0 | frame 1 | ... | seek table (zstandard) | length of the table, 8 bytes | b"STWVTOK2"

A frame holds the little-endian unsigned 32-bit ids of consecutive whole documents, each ended by `end_id`, and is closed
by the document that brings it to `frame_ids` ids; by default each document is a frame of its own. The seek table has
columns: for each frame its offset, compressed and raw length, the unsigned crc32 of its raw bytes and its number of
documents; for each document its id (and whether it is null) and its number of ids. A reader fetches the footer and then
only the frames that hold the requested documents, and checks each frame it opens.

Each attempt of a task writes a file of its own name; the manifest lists those of the attempts that counted.
"""

from __future__ import annotations

import io
import struct
import uuid
import zlib
from array import array
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandweave.llm.tokens import default_tokenizer, encoder
from strandweave.runtime import cut, new_folder

MAGIC = b"STWVTOK2"
_FRAME_COLUMNS = (("offset", "<u8"), ("packed", "<u8"), ("raw", "<u8"), ("crc32", "<u4"), ("docs", "<u4"))
_DOC_COLUMNS = (("doc", "<i8"), ("null", "u1"), ("count", "<u8"))


class FrameWriter:
    """Writes documents to a binary file object in the order in which they are added."""

    def __init__(self, out, frame_ids: int = 1, level: int = 1):
        self.out, self.frame_ids, self.at, self.held = out, frame_ids, 0, 0
        self.pack = zstandard.ZstdCompressor(level=level, write_checksum=True, write_content_size=True)
        self.parts: list[bytes] = []
        self.frames: dict[str, array] = {name: array("Q") for name, _ in _FRAME_COLUMNS}
        self.docs = {"doc": array("q"), "null": array("B"), "count": array("Q")}

    def add(self, doc_id: int | None, ids: bytes) -> None:
        self.parts.append(ids)
        self.docs["doc"].append(doc_id or 0)
        self.docs["null"].append(doc_id is None)
        self.docs["count"].append(len(ids) // 4)
        self.held += len(ids) // 4
        if self.held >= self.frame_ids:
            self._flush()

    def _flush(self) -> None:
        if not self.parts:
            return
        raw = b"".join(self.parts)
        packed = self.pack.compress(raw)
        self.out.write(packed)
        for column, x in zip(self.frames.values(), (self.at, len(packed), len(raw), zlib.crc32(raw), len(self.parts)), strict=True):
            column.append(x)
        self.at += len(packed)
        self.parts, self.held = [], 0

    def close(self) -> None:
        self._flush()
        raw = struct.pack("<QQ", len(self.frames["raw"]), len(self.docs["doc"]))
        for columns, held in ((_FRAME_COLUMNS, self.frames), (_DOC_COLUMNS, self.docs)):
            raw += b"".join(np.array(held[name], kind).tobytes() for name, kind in columns)
        table = self.pack.compress(raw)
        self.out.write(table + struct.pack("<Q", len(table)) + MAGIC)


class FrameReader:
    """Reads documents from a seekable binary file object."""

    def __init__(self, source):
        self.source = source
        source.seek(0, io.SEEK_END)
        end = source.tell()
        source.seek(max(0, end - 16))
        tail = source.read(16)
        if len(tail) < 16 or tail[8:] != MAGIC:
            raise ValueError("not a token file, or cut short")
        (size,) = struct.unpack("<Q", tail[:8])
        source.seek(end - 16 - size)
        self.unpack = zstandard.ZstdDecompressor()
        raw = self.unpack.decompress(source.read(size))
        n_frames, n_docs = struct.unpack("<QQ", raw[:16])
        at = 16
        self.columns: dict[str, np.ndarray] = {}
        for columns, n in ((_FRAME_COLUMNS, n_frames), (_DOC_COLUMNS, n_docs)):
            for name, kind in columns:
                self.columns[name] = np.frombuffer(raw, kind, n, at)
                at += self.columns[name].nbytes
        self.starts = np.concatenate([[0], np.cumsum(self.columns["count"].astype(np.int64))])
        self.first = np.concatenate([[0], np.cumsum(self.columns["docs"].astype(np.int64))])

    def _frame(self, f: dict) -> bytes:
        self.source.seek(f["offset"])
        raw = self.unpack.decompress(self.source.read(f["packed"]), max_output_size=max(1, f["raw"]))
        if len(raw) != f["raw"] or zlib.crc32(raw) != f["crc32"]:
            raise ValueError(f"frame at {f['offset']} is damaged")
        return raw

    def places(self, wanted: Iterable[int] | None = None) -> Iterator[tuple[int | None, int, bytes]]:
        """(doc_id, ids before it in this file, ids) in file order; of wanted documents only, if given: other frames
        aren't read."""
        docs, null = self.columns["doc"], self.columns["null"] != 0
        keep = np.ones(len(docs), bool) if wanted is None else np.isin(docs, np.array(sorted({x for x in wanted if x is not None}), np.int64)) & ~null
        asked = np.flatnonzero(keep)
        frame_of = np.searchsorted(self.first, asked, "right") - 1
        opened, raw, names = -1, b"", [name for name, _ in _FRAME_COLUMNS]
        for low in range(0, len(asked), 4096):
            at, of = asked[low : low + 4096], frame_of[low : low + 4096]
            places = zip(*(self.columns[name][of].tolist() for name in names), strict=True)
            starts, within = self.starts[at], self.starts[at] - self.starts[self.first[of]]
            rows = zip(of.tolist(), docs[at].tolist(), null[at].tolist(), starts.tolist(), within.tolist(), self.columns["count"][at].tolist(), places, strict=True)
            for k, doc, is_null, start, a, n, place in rows:
                if k != opened:
                    opened, raw = k, self._frame(dict(zip(names, place, strict=True)))
                yield (None if is_null else doc), start, raw[4 * a : 4 * (a + n)]

    def documents(self, wanted: Iterable[int] | None = None) -> Iterator[tuple[int | None, bytes]]:
        """(doc_id, ids) in file order, as by places."""
        for doc, _, ids in self.places(wanted):
            yield doc, ids


def open_file(path: str, mode: str):
    fs, p = pafs.FileSystem.from_uri(path)
    if mode == "w":
        fs.create_dir(p.rsplit("/", 1)[0], recursive=True)
        return fs.open_output_stream(p)
    return fs.open_input_file(p)


def write_token_files(
    docs: DataFrame,
    folder: str,
    id_col: str = "doc_id",
    text_col: str = "text",
    tokenizer: str | None = None,
    end_id: int = 0,
    frame_ids: int = 1,
    partitions: int | None = None,
) -> DataFrame:
    """Encodes every text (null: empty), writes files to folder, and returns their manifest, itself a written table.

    The manifest has a row per file: file, part, n_docs, n_ids, first_doc, last_doc (smallest and largest id, null ones
    left out); files in order of part hold ascending ids. Null ids come first; rows that repeat an id stay rows, ordered
    by a hash of their text. An empty table has no file with documents. folder is a URI that every executor can write
    (file, s3, gs or hdfs). What a lost task has left there is in no manifest and is ignored.
    """
    path = tokenizer or default_tokenizer()
    keyed = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    keyed = keyed.withColumn("_tie", F.xxhash64("text"))
    order = ["doc_id", "_tie"]
    ranged = keyed.repartitionByRange(partitions, *order) if partitions else keyed.repartitionByRange(*order)
    ranged = ranged.sortWithinPartitions(*order)

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part = TaskContext.get().partitionId()
        enc, end = encoder(path), struct.pack("<I", end_id)
        name = f"part-{part:06d}-{uuid.uuid4().hex}.stwv"
        fs, root = pafs.FileSystem.from_uri(folder)
        fs.create_dir(root, recursive=True)
        n_docs = n_ids = 0
        first = last = None
        try:
            with fs.open_output_stream(f"{root}/{name}") as out:
                w = FrameWriter(out, frame_ids)
                for b in batches:
                    for doc, text in zip(b.column("doc_id").to_pylist(), b.column("text").to_pylist(), strict=True):
                        ids = enc.ids(text) + end
                        w.add(doc, ids)
                        n_docs, n_ids = n_docs + 1, n_ids + len(ids) // 4
                        first, last = doc if first is None else first, doc
                w.close()
        except BaseException:
            fs.delete_file(f"{root}/{name}")
            raise
        yield pa.RecordBatch.from_pydict(
            {
                "file": [f"{folder}/{name}"], "part": pa.array([part], pa.int32()), "n_docs": [n_docs], "n_ids": [n_ids],
                "first_doc": pa.array([first], pa.int64()), "last_doc": pa.array([last], pa.int64()),
            }
        )

    return cut(ranged.mapInArrow(write, "file string, part int, n_docs long, n_ids long, first_doc long, last_doc long"), "manifest")


def read_token_files(spark: SparkSession, manifest: list, wanted: list[int] | None = None) -> DataFrame:
    """doc_id, start (ids of all documents before it in all files), n_tokens and ids (binary) of each document.

    manifest: collected rows of write_token_files, one per file. A task reads whole files, or where documents are asked
    for, only their frames of those files whose range of ids holds any.
    """
    asked = None if wanted is None else np.array(sorted({int(x) for x in wanted if x is not None}), np.int64)
    at, rows = 0, []
    for r in sorted(manifest, key=lambda r: r["part"]):
        if asked is None or r["first_doc"] is not None and np.searchsorted(asked, r["first_doc"]) < np.searchsorted(asked, r["last_doc"], "right"):
            rows.append((r["file"], at))
        at += r["n_ids"]
    files = spark.createDataFrame(rows, "file string, base long")
    files = files.repartition(max(1, len(rows)), "file")

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for file, base in zip(b.column("file").to_pylist(), b.column("base").to_pylist(), strict=True):
                with open_file(file, "r") as src:
                    held: list[tuple] = []
                    size = 0
                    for doc, start, ids in FrameReader(src).places(asked):
                        held.append((doc, base + start, len(ids) // 4, ids))
                        size += len(ids)
                        if size >= 1 << 20 or len(held) >= 4096:
                            yield _documents(held)
                            held, size = [], 0
                    if held:
                        yield _documents(held)

    return files.mapInArrow(read, "doc_id long, start long, n_tokens long, ids binary")


def _documents(held: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.int64(), pa.int64(), pa.int64(), pa.binary())
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*held, strict=True), kinds, strict=True)], ["doc_id", "start", "n_tokens", "ids"])


def token_file_index(docs: DataFrame, **options) -> DataFrame:
    """Writes token files to the shared folder and returns, read back from them, doc_id, start, n_tokens, ids_crc32."""
    spark = docs.sparkSession
    folder = new_folder(spark, "tokens")
    manifest = write_token_files(docs, folder, **options).collect()  # one row per file
    back = read_token_files(spark, manifest)
    return back.select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))
