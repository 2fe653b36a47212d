"""Cost-balanced packing of token ids into sequences of fixed capacity.

The cost of a piece of l tokens is ``linear * l + l * l``: the per-token work and the attention
inside the piece. A document gives as many whole sequences as it fills; what is left of it, of
less than a sequence, joins a block. A block opens the least number of sequences that can hold
its tokens, and takes its pieces in descending length: each goes to the sequence of lowest cost
that has room for it. A piece that no sequence has room for is cut: the sequences of lowest cost
with any room take what they can. So a block pads less than one sequence in all.

Packing runs where documents are read, without a shuffle; a task holds one block of pieces.
Numbers of sequences are unique, not dense: the partition's number stands in the upper bits.

Null and empty texts have the end id alone. Repeated rows are packed one by one. Equal lengths
keep the order of rows, equal costs take the lower sequence number.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

from tonewright.llm.common import arrow_map, raw, slices
from tonewright.llm.tokens import BYTE_BPE, encoder, vocabulary

CAPACITY = 1024
LINEAR = 4096
#: Documents of a block.
BLOCK = 2048

_PIECES = (
    "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, "
    "offset long, piece_cost long"
)


def balance(lengths: list[int], capacity: int = CAPACITY, linear: int = LINEAR) -> list[list[tuple[int, int, int]]]:
    """For each of these lengths (1 to capacity) its parts: (sequence, offset there, length)."""
    parts: list[list[tuple[int, int, int]]] = [[] for _ in lengths]
    if not lengths:
        return parts
    n = -(-sum(lengths) // capacity)
    room = np.full(n, capacity, np.int64)
    cost = np.zeros(n, np.float64)

    def put(item: int, s: int, length: int) -> None:
        parts[item].append((s, int(capacity - room[s]), length))
        room[s] -= length
        cost[s] += linear * length + length * length

    for item in sorted(range(len(lengths)), key=lambda i: -lengths[i]):
        left = lengths[item]
        at = int(np.argmin(np.where(room >= left, cost, np.inf)))
        if room[at] >= left:
            put(item, at, left)
            continue
        while left:
            at = int(np.argmin(np.where(room > 0, cost, np.inf)))
            took = min(left, int(room[at]))
            put(item, at, took)
            left -= took
    return parts


def pack_documents(
    docs: DataFrame,
    tokenizer: str | None = None,
    end_id: int = 0,
    capacity: int = CAPACITY,
    linear: int = LINEAR,
    with_ids: bool = False,
) -> DataFrame:
    """One row per piece of (doc_id, text): where it lies in its document and its sequence."""
    path = tokenizer or vocabulary(BYTE_BPE)
    end = end_id.to_bytes(4, "little")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = encoder(path)
        base = TaskContext.get().partitionId() << 40
        count = 0
        rows: list[tuple] = []
        rest: list[tuple[int | None, int, int, bytes]] = []  # doc_id, start, doc_tokens, ids

        def piece(doc, start, ids, total, seq, offset):
            n = len(ids) // 4
            got = (doc, start, n, zlib.crc32(ids), total, base + seq, offset, linear * n + n * n)
            rows.append((*got, np.frombuffer(ids, "<u4").astype(np.int32)) if with_ids else got)

        def close():
            nonlocal count
            fits = balance([len(r[3]) // 4 for r in rest], capacity, linear)
            for (doc, start, total, ids), parts in zip(rest, fits, strict=True):
                at = 0
                for seq, offset, length in parts:
                    piece(doc, start + at, ids[4 * at : 4 * (at + length)], total, count + seq, offset)
                    at += length
            count += 1 + max((p[0] for parts in fits for p in parts), default=-1)
            rest.clear()

        def out() -> pa.RecordBatch:
            cols = [pa.array([r[i] for r in rows], pa.int64()) for i in range(8)]
            names = [c.split()[0] for c in _PIECES.split(", ")]
            if with_ids:
                cols.append(pa.array([r[8] for r in rows], pa.list_(pa.int32())))
                names.append("ids")
            rows.clear()
            return pa.RecordBatch.from_arrays(cols, names)

        for batch in batches:
            for part in slices(batch):
                for doc, ids in zip(part.column("doc_id").to_pylist(), own.encode_all(raw(part)), strict=True):
                    ids += end
                    total = len(ids) // 4
                    whole = total - total % capacity
                    for start in range(0, whole, capacity):
                        piece(doc, start, ids[4 * start : 4 * (start + capacity)], total, count, 0)
                        count += 1
                    if whole < total:
                        rest.append((doc, whole, total, ids[4 * whole :]))
                        if len(rest) == BLOCK:
                            close()
                if rows:
                    yield out()
        close()
        if rows:
            yield out()

    return arrow_map(docs, run, _PIECES + (", ids array<int>" if with_ids else ""))
