"""Token ids in wavelet-matrix shards: one compressed file each, with access, rank and select.

A shard covers consecutive documents in ascending doc_id order. Its ids are kept as one bit
plane per bit of the largest id, most significant first; each plane's order is that of the
stable partition by the plane before (zeros, then ones). A plane carries running counts of ones
at every ``SUPER`` bits, so access, rank and select of any symbol cost a few steps per plane.

File layout, little-endian: ``WVM1``, u32 length of the JSON header, the header (number of
documents and tokens, planes, zeros of each plane, and name -> offsets of a section's blocks and
its end), then the sections, cut into blocks of ``BLOCK_BYTES`` that are compressed with zstd each
on its own: ``doc_ids`` (i64, null as the least value), ``lengths`` (u32), ``plane<k>`` (bits, high
bit first), ``ones<k>`` (u32). So one step of a query inflates a block of a plane, not the plane.

Shards are binary values of a Parquet table written by Spark's committer, so a lost executor
leaves no half file and any Hadoop file system can hold them; a value is a complete file.

Null and empty texts have the end id alone. Rows of one doc_id follow each other in text order,
repeated rows are stored each. An empty table has no shards. A very long text fills a shard of its
own; building one takes about six bytes a token beside the ids. Other columns aren't stored.
"""

from __future__ import annotations

import json
import struct
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tonewright.llm.common import arrow_map, documents, fresh_path, in_order, raw, slices
from tonewright.llm.tokens import WORD_BPE, encoder, vocabulary

MAGIC = b"WVM1"
SUPER = 512
#: Tokens at which a shard is closed; a longer document has a shard for itself.
SHARD_TOKENS = 2_000_000
#: Bytes of a section that are compressed together.
BLOCK_BYTES = 65_536
NO_ID = -(2**63)


def build(ids: np.ndarray, doc_ids: list[int | None], lengths: list[int]) -> bytes:
    """The file of one shard."""
    import zstandard

    squeeze = zstandard.ZstdCompressor(level=1).compress
    planes = max(1, int(ids.max(initial=0)).bit_length())
    rest = ids.astype(np.uint16 if planes <= 16 else np.uint32)
    sections: dict[str, bytes] = {
        "doc_ids": np.array([NO_ID if d is None else d for d in doc_ids], "<i8").tobytes(),
        "lengths": np.array(lengths, "<u4").tobytes(),
    }
    zeros = []
    for k in range(planes):
        one = (rest & rest.dtype.type(1 << (planes - 1 - k))) != 0
        plane = np.packbits(one)
        sections[f"plane{k}"] = plane.tobytes()
        ones = _ones_before(plane)
        zeros.append(int(len(rest) - ones[-1]))
        sections[f"ones{k}"] = ones.astype("<u4").tobytes()
        if k + 1 < planes:
            rest = rest.take(np.concatenate([np.flatnonzero(~one), np.flatnonzero(one)]))
    at, where, body = 0, {}, []
    for name, data in sections.items():
        where[name] = [at]
        for start in range(0, len(data), BLOCK_BYTES):
            block = squeeze(data[start : start + BLOCK_BYTES])
            body.append(block)
            at += len(block)
            where[name].append(at)
    head = json.dumps({"documents": len(doc_ids), "tokens": len(ids), "planes": planes, "zeros": zeros, "sections": where}).encode()
    return b"".join([MAGIC, struct.pack("<I", len(head)), head, *body])


def _ones_before(plane: np.ndarray) -> np.ndarray:
    """Ones in the plane before every ``SUPER`` bits, and in all."""
    words = np.zeros(-(-len(plane) // (SUPER // 8)) * (SUPER // 64), np.uint64)
    words.view(np.uint8)[: len(plane)] = plane
    per = np.bitwise_count(words).reshape(-1, SUPER // 64).sum(axis=1, dtype=np.uint32)
    return np.concatenate([np.zeros(1, np.uint32), np.cumsum(per, dtype=np.uint32)])


class Shard:
    """Reader of one file; blocks of sections are inflated when asked for, and a bounded number of
    them is remembered."""

    def __init__(self, data: bytes):
        if data[:4] != MAGIC:
            raise ValueError("not a wavelet shard")
        (n,) = struct.unpack_from("<I", data, 4)
        self.head = json.loads(data[8 : 8 + n])
        self._data, self._base = memoryview(data), 8 + n
        self.n, self.planes, self.zeros = self.head["tokens"], self.head["planes"], self.head["zeros"]
        self._block = lru_cache(maxsize=256)(self._inflate)

    def _inflate(self, name: str, block: int) -> bytes:
        import zstandard

        at, end = self.head["sections"][name][block : block + 2]
        return zstandard.ZstdDecompressor().decompress(bytes(self._data[self._base + at : self._base + end]))

    def _section(self, name: str, kind: str) -> np.ndarray:
        """A whole section."""
        blocks = len(self.head["sections"][name]) - 1
        return np.frombuffer(b"".join([self._inflate(name, k) for k in range(blocks)]), kind)

    def _bytes(self, name: str, lo: int, hi: int) -> bytes:
        """Bytes lo to hi of a section."""
        if hi <= lo:
            return b""
        first, last = lo // BLOCK_BYTES, (hi - 1) // BLOCK_BYTES
        got = b"".join([self._block(name, k) for k in range(first, min(last + 1, len(self.head["sections"][name]) - 1))])
        return got[lo - first * BLOCK_BYTES : hi - first * BLOCK_BYTES]

    def _before(self, k: int, block: int) -> int:
        """Ones of plane k before a block of ``SUPER`` bits."""
        return int.from_bytes(self._bytes(f"ones{k}", 4 * block, 4 * block + 4), "little")

    @property
    def doc_ids(self) -> list[int | None]:
        return [None if d == NO_ID else d for d in self._section("doc_ids", "<i8").tolist()]

    @property
    def lengths(self) -> np.ndarray:
        return self._section("lengths", "<u4")

    def _bit(self, k: int, i: int) -> int:
        return self._bytes(f"plane{k}", i >> 3, (i >> 3) + 1)[0] >> (7 - (i & 7)) & 1

    def _ones(self, k: int, i: int) -> int:
        """Ones among the first i bits of plane k."""
        block = i // SUPER
        n = self._before(k, block)
        if i % SUPER:
            bits = self._bytes(f"plane{k}", block * SUPER // 8, (i + 7) >> 3)
            n += (int.from_bytes(bits, "big") >> (-i & 7)).bit_count()
        return n

    def access(self, i: int) -> int:
        """The i-th id."""
        if not 0 <= i < self.n:
            raise IndexError(i)
        out = 0
        for k in range(self.planes):
            bit, ones = self._bit(k, i), self._ones(k, i)
            i = self.zeros[k] + ones if bit else i - ones
            out = out << 1 | bit
        return out

    def _walk(self, symbol: int, i: int) -> tuple[int, int]:
        """Where the symbol's run starts below the last plane, and its occurrences before i."""
        lo = 0
        for k in range(self.planes):
            a, b = self._ones(k, lo), self._ones(k, i)
            if symbol >> (self.planes - 1 - k) & 1:
                lo, i = self.zeros[k] + a, self.zeros[k] + b
            else:
                lo, i = lo - a, i - b
        return lo, i - lo

    def rank(self, symbol: int, i: int) -> int:
        """Occurrences of the symbol among the first i ids."""
        if symbol < 0 or symbol >> self.planes:
            return 0
        return self._walk(symbol, min(max(i, 0), self.n))[1]

    def count(self, symbol: int, lo: int = 0, hi: int | None = None) -> int:
        return self.rank(symbol, self.n if hi is None else hi) - self.rank(symbol, lo)

    def select(self, symbol: int, nth: int) -> int:
        """Place of the nth (from 0) occurrence of the symbol."""
        if nth < 0 or nth >= self.rank(symbol, self.n):
            raise IndexError(nth)
        i = self._walk(symbol, 0)[0] + nth
        for k in reversed(range(self.planes)):
            bit = symbol >> (self.planes - 1 - k) & 1
            i = self._find(k, bit, i - self.zeros[k] if bit else i)
        return i

    def _find(self, k: int, bit: int, nth: int) -> int:
        """Place of the nth (from 0) bit of this kind in plane k."""
        lo, hi = 0, -(-self.n // SUPER)  # the block is the last that has at most nth such bits before it
        while hi - lo > 1:
            mid = (lo + hi) // 2
            before = self._before(k, mid) if bit else min(mid * SUPER, self.n) - self._before(k, mid)
            lo, hi = (mid, hi) if before <= nth else (lo, mid)
        at = lo * SUPER
        before = self._before(k, lo) if bit else at - self._before(k, lo)
        plane = np.frombuffer(self._bytes(f"plane{k}", at // 8, (at + SUPER) // 8), np.uint8)
        bits = np.unpackbits(plane)[: self.n - at]
        return at + int(np.flatnonzero(bits == bit)[nth - before])

    def occurrences(self, symbol: int) -> list[int]:
        """Places of all occurrences, in one walk up the planes."""
        if symbol < 0 or symbol >> self.planes:
            return []
        lo, n = self._walk(symbol, self.n)
        at = np.arange(lo, lo + n)
        for k in reversed(range(self.planes)) if n else ():
            bit = symbol >> (self.planes - 1 - k) & 1
            bits = np.unpackbits(self._section(f"plane{k}", "u1"), count=self.n)
            at = np.flatnonzero(bits == bit)[at - self.zeros[k] if bit else at]
        return at.tolist()

    def ids(self) -> np.ndarray:
        """All ids, by undoing the partitions from the last plane up."""
        kind = np.uint16 if self.planes <= 16 else np.uint32
        out = np.zeros(self.n, kind)
        for k in reversed(range(self.planes)):
            one = np.unpackbits(self._section(f"plane{k}", "u1"), count=self.n).view(np.bool_)
            up = np.empty(self.n, kind)
            up[np.flatnonzero(~one)] = out[: self.zeros[k]]
            up[np.flatnonzero(one)] = out[self.zeros[k] :] | kind(1 << (self.planes - 1 - k))
            out = up
        return out


def write_shards(docs: DataFrame, tokenizer: str | None = None, end_id: int = 2, shard_tokens: int = SHARD_TOKENS, path: str | None = None) -> str:
    """Encode (doc_id, text), write shards in ascending doc_id order; returns the table's path.

    Columns: range, part (order of shards), documents, tokens, shard (the file).
    """
    name = tokenizer or vocabulary(WORD_BPE)
    end = end_id.to_bytes(4, "little")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = encoder(name)
        held: list[bytes] = []
        docs_held: list[int | None] = []
        sizes: list[int] = []
        at = None
        part = total = 0

        def close() -> Iterator[pa.RecordBatch]:
            nonlocal part, total
            if docs_held:
                data = build(np.frombuffer(b"".join(held), "<u4"), docs_held, sizes)
                row = ([at], [part], [len(docs_held)], [total], [data])
                kinds = (pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(row, kinds, strict=True)], ["range", "part", "documents", "tokens", "shard"])
                part += 1
                total = 0
                held.clear(), docs_held.clear(), sizes.clear()

        for batch in batches:
            for piece in slices(batch):
                encoded = own.encode_all(raw(piece))
                for r, doc, ids in zip(piece.column("range").to_pylist(), piece.column("doc_id").to_pylist(), encoded, strict=True):
                    ids += end
                    n = len(ids) // 4
                    if r != at or total and total + n > shard_tokens:
                        yield from close()
                        part = 0 if r != at else part
                        at = r
                    held.append(ids)
                    docs_held.append(doc)
                    sizes.append(n)
                    total += n
        yield from close()

    path = path or fresh_path(docs.sparkSession, "wavelet")
    shards = arrow_map(in_order(documents(docs), "doc_id", "text"), run, "range int, part long, documents long, tokens long, shard binary")
    shards.write.option("compression", "uncompressed").parquet(path)
    return path


def digest_shards(spark, path: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of every document, read from the files."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r, p, data in zip(*(batch.column(c).to_pylist() for c in ("range", "part", "shard")), strict=True):
                own = Shard(data)
                ids = own.ids().astype("<u4").tobytes()
                ends = np.cumsum(own.lengths, dtype=np.int64)
                starts = ends - own.lengths
                crc = [zlib.crc32(ids[4 * a : 4 * b]) for a, b in zip(starts.tolist(), ends.tolist(), strict=True)]
                n = len(crc)
                cols = [pa.array([r] * n, pa.int32()), pa.array([p] * n, pa.int64()), pa.array(own.doc_ids, pa.int64())]
                cols += [pa.array(starts, pa.int64()), pa.array(own.lengths.astype(np.int64)), pa.array(crc, pa.int64())]
                yield pa.RecordBatch.from_arrays(cols, ["range", "part", "doc_id", "at", "n_tokens", "ids_crc32"])

    table = spark.read.parquet(path)
    # shards are summed inside their range; only totals of ranges, as many as partitions wrote
    # them, pass through the one window
    ranges = table.groupBy("range").agg(F.sum("tokens").alias("all"))
    ranges = ranges.select("range", (F.sum("all").over(Window.orderBy("range")) - F.col("all")).alias("base"))
    so_far = F.sum("tokens").over(Window.partitionBy("range").orderBy("part"))
    starts = table.select("range", "part", (so_far - F.col("tokens")).alias("in_range")).join(ranges, "range")
    starts = starts.select("range", "part", (F.col("base") + F.col("in_range")).alias("first"))
    rows = table.select("range", "part", "shard").mapInArrow(run, "range int, part long, doc_id long, at long, n_tokens long, ids_crc32 long")
    return rows.join(starts, ["range", "part"]).select("doc_id", (F.col("first") + F.col("at")).alias("start"), "n_tokens", "ids_crc32")
