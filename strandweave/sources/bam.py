"""Alignment files (BAM) as a Python data source: one partition per file, blocks decompressed as they are read.

    spark.dataSource.register(BamSource)
    spark.read.format("bam").option("path", "a.bam").load()

Rows: read, flag, chr, st (0-based), nd, mapq, cigar, strand, qst. The path must be readable where tasks run (local,
or any file system that pyarrow opens by URI).
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

_OPS = "MIDNSHP=X"


def _blocks(src) -> Iterator[bytes]:
    while head := src.read(18):
        if len(head) < 18 or head[:4] != b"\x1f\x8b\x08\x04":
            raise ValueError("not a blocked gzip file")
        (xlen,) = struct.unpack("<H", head[10:12])
        extra = head[12:] + src.read(xlen - 6)
        at, size = 0, None
        while at + 4 <= len(extra):
            kind, n = extra[at : at + 2], struct.unpack("<H", extra[at + 2 : at + 4])[0]
            if kind == b"BC":
                (size,) = struct.unpack("<H", extra[at + 4 : at + 6])
            at += 4 + n
        if size is None:
            raise ValueError("a block has no size")
        body = src.read(size - xlen - 19)
        src.read(8)
        yield zlib.decompress(body, -15)


class _Stream:
    def __init__(self, src):
        self.blocks, self.held = _blocks(src), b""

    def take(self, n: int) -> bytes:
        parts, have = [self.held], len(self.held)
        while have < n:
            more = next(self.blocks, None)
            if more is None:
                break
            parts.append(more)
            have += len(more)
        data = b"".join(parts)
        self.held = data[n:]
        return data[:n]


def records(src) -> Iterator[tuple]:
    """Rows of a BAM stream."""
    s = _Stream(src)
    if s.take(4) != b"BAM\x01":
        raise ValueError("not a BAM file")
    s.take(struct.unpack("<i", s.take(4))[0])
    names = []
    for _ in range(struct.unpack("<i", s.take(4))[0]):
        names.append(s.take(struct.unpack("<i", s.take(4))[0])[:-1].decode())
        s.take(4)
    while len(head := s.take(4)) == 4:
        b = s.take(struct.unpack("<i", head)[0])
        ref, pos, n_name, mapq, _, n_cigar, flag, _ = struct.unpack("<iiBBHHHi", b[:20])
        name = b[32 : 32 + n_name - 1].decode()
        ops = [(x >> 4, _OPS[x & 15]) for x in struct.unpack(f"<{n_cigar}I", b[32 + n_name : 32 + n_name + 4 * n_cigar])]
        span = sum(n for n, o in ops if o in "MDN=X")
        clip = ops[-1] if flag & 16 and ops else ops[0] if ops else (0, "M")
        yield (name, flag, names[ref] if ref >= 0 else None, pos, pos + span, mapq, "".join(f"{n}{o}" for n, o in ops), "-" if flag & 16 else "+", clip[0] if clip[1] in "SH" else 0)


class BamReader(DataSourceReader):
    def __init__(self, options):
        self.paths = [p for p in options["path"].split(",") if p]
        self.regions = [r for r in options.get("regions", "").split(",") if r]

    def partitions(self):
        return [InputPartition(p) for p in self.paths]

    def read(self, partition):
        import pyarrow.fs as pafs

        wanted = []
        for r in self.regions:
            chrom, span = r.rsplit(":", 1)
            a, b = map(int, span.split("-"))
            wanted.append((chrom, a, b))
        fs, path = pafs.FileSystem.from_uri(partition.value) if "://" in partition.value else (pafs.LocalFileSystem(), partition.value)
        with fs.open_input_stream(path, compression=None) as src:
            for r in records(src):
                if not wanted or any(r[2] == c and r[3] < b and r[4] > a for c, a, b in wanted):
                    yield r


class BamSource(DataSource):
    @classmethod
    def name(cls):
        return "bam"

    def schema(self):
        return "read string, flag int, chr string, st long, nd long, mapq int, cigar string, strand string, qst long"

    def reader(self, schema):
        return BamReader(self.options)
