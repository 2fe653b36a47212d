"""Repeated runs of lines, found by winnowing.

The lines of a document that hold a word are hashed; of every ``WINDOW`` consecutive lines the
least hash, the rightmost of equals, is a fingerprint. Two places with the same window have the
same fingerprint there, so each run of ``WINDOW`` lines or more that two places share shows up
in the join of fingerprints by hash. From each joined position the match is extended both ways,
to the windows that chose it; where a window stands in an earlier place as well (smaller doc_id,
or further up in the same document) its lines go. Neighbouring windows merge to whole runs.

Fingerprints are counted, and first places taken, before the shuffle; no place is paired with all
others of its hash. Windows are compared by 96 bits of their lines' hashes.

Null and empty texts and those of fewer than ``WINDOW`` lines with words lose nothing. Rows that
repeat doc_id and text count as one place and share their fate. Rows with a null doc_id are
neither searched nor cut. Lines without words stay.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tonewright.llm.common import arrow_map, columns, free_name, raw, saved, slices
from tonewright.llm.substring_index import rolled

WINDOW = 3
_A, _B = 0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93


def line_hashes(text: bytes) -> np.ndarray:
    import xxhash

    lines = [x for x in text.split(b"\n") if x.strip()]
    return np.fromiter(map(xxhash.xxh3_64_intdigest, lines), np.uint64, len(lines))


def chosen(h: np.ndarray, window: int = WINDOW) -> np.ndarray:
    """For every window the place of its least hash, the rightmost of equals."""
    n = len(h) - window + 1
    if n <= 0:
        return np.zeros(0, np.int64)
    view = np.lib.stride_tricks.sliding_window_view(h, window)
    return np.arange(n) + window - 1 - np.argmin(view[:, ::-1], axis=1)


def fingerprints(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """(fp, doc_id, rid, windows): each chosen place's hash, and the windows that chose it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("start", pa.int32()), ("w1", pa.int64()), ("w2", pa.int32())]))
        for batch in batches:
            for part in slices(batch):
                fps, ids, rids, lists = [], [], [], []
                for doc, rid, text in zip(part.column("doc_id").to_pylist(), part.column("rid").to_pylist(), raw(part), strict=True):
                    h = line_hashes(text)
                    at = chosen(h, window)
                    if not len(at):
                        continue
                    w1 = rolled(h, window, _A).view(np.int64).tolist()
                    w2 = (rolled(h, window, _B) >> np.uint64(32)).astype(np.uint32).view(np.int32).tolist()
                    held: dict[int, list] = {}
                    for s, p in enumerate(at.tolist()):
                        held.setdefault(p, []).append({"start": s, "w1": w1[s], "w2": w2[s]})
                    fps += h[list(held)].view(np.int64).tolist()
                    ids += [doc] * len(held)
                    rids += [rid] * len(held)
                    lists += held.values()
                cols = [pa.array(fps, pa.int64()), pa.array(ids, pa.int64()), pa.array(rids, pa.int64()), pa.array(lists, kind)]
                yield pa.RecordBatch.from_arrays(cols, ["fp", "doc_id", "rid", "windows"])

    return arrow_map(docs, run, "fp long, doc_id long, rid long, windows array<struct<start:int,w1:long,w2:int>>")


def _keyed(docs: DataFrame) -> tuple[DataFrame, str]:
    """Texts without nulls, and the column of a number that tells texts of one doc_id apart."""
    rid = free_name("rid", docs.columns)
    return docs.withColumn("text", F.coalesce("text", F.lit(""))).withColumn(rid, F.xxhash64("text")), rid


def repeated_windows(keyed: DataFrame, window: int = WINDOW) -> DataFrame:
    """(doc_id, rid, start) of the windows that an earlier place has too."""
    found = saved(fingerprints(keyed.select("doc_id", "rid", "text").where("doc_id IS NOT NULL"), window), "winnowed")
    again = found.groupBy("fp").agg(F.count(F.lit(1)).alias("n"), F.max(F.size("windows")).alias("m")).where("n > 1 OR m > 1").select("fp")
    places = found.join(again, "fp").select("doc_id", "rid", F.inline("windows"))
    firsts = places.groupBy("w1", "w2").agg(F.min(F.struct("doc_id", "rid", "start")).alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1").drop("n")
    later = places.join(firsts, ["w1", "w2"]).where("struct(doc_id, rid, start) > first")
    return later.select("doc_id", "rid", "start").distinct()


def cut_lines(text: bytes, starts: np.ndarray, window: int = WINDOW) -> tuple[bytes, int, int]:
    """The text without these windows' lines, the number of lines with words, and of cut ones."""
    lines = text.split(b"\n")
    own = [k for k, x in enumerate(lines) if x.strip()]
    gone = {own[s + j] for s in starts.tolist() for j in range(window)}
    return b"\n".join([x for k, x in enumerate(lines) if k not in gone]), len(own), len(gone)


def _cut(docs: DataFrame, window: int) -> tuple[DataFrame, str]:
    """The rows with the starts of the windows they lose, and the name of that column."""
    keyed, rid = _keyed(docs)
    starts = free_name("starts", docs.columns)
    again = repeated_windows(keyed.select("doc_id", F.col(rid).alias("rid"), "text"), window)
    lost = again.groupBy("doc_id", F.col("rid").alias(rid)).agg(F.collect_list("start").alias(starts))
    return keyed.join(lost, ["doc_id", rid], "left").select(*columns(docs.columns), starts), starts


def line_digest(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """(doc_id, n_lines, n_removed, kept_sha256) of each document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        none = np.zeros(0, np.int32)
        for batch in batches:
            for part in slices(batch):
                starts = part.column("starts")
                rows = [cut_lines(t, starts[k].values.to_numpy() if starts[k].is_valid else none, window) for k, t in enumerate(raw(part))]
                cols = [part.column("doc_id"), pa.array([r[1] for r in rows], pa.int64()), pa.array([r[2] for r in rows], pa.int64())]
                cols.append(pa.array([hashlib.sha256(r[0]).hexdigest() for r in rows]))
                yield pa.RecordBatch.from_arrays(cols, ["doc_id", "n_lines", "n_removed", "kept_sha256"])

    return arrow_map(_cut(docs.select("doc_id", "text"), window)[0], run, "doc_id long, n_lines long, n_removed long, kept_sha256 string")


def cut_documents(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """The rows of ``docs`` without later repeated runs, n_chars anew; a document that had words
    and lost them all goes."""
    names = docs.columns
    marked, gone = _cut(docs, window)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                starts, texts = part.column(gone), raw(part)
                new = [cut_lines(t, starts[k].values.to_numpy(), window)[0] if starts[k].is_valid else t for k, t in enumerate(texts)]
                text = pa.array([t.decode() for t in new], part.schema.field("text").type)
                out = pa.RecordBatch.from_arrays([text if n == "text" else part.column(n) for n in names], names=names)
                yield out.filter(pa.array([bool(n.strip()) or not t.strip() for n, t in zip(new, texts, strict=True)], pa.bool_()))

    out = arrow_map(marked, run, marked.drop(gone).schema)
    if "n_chars" in names:
        out = out.withColumn("n_chars", F.char_length("text").cast(docs.schema["n_chars"].dataType))
    return out
