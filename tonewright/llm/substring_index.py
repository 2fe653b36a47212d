"""Incremental substring deduplication over a log-structured fingerprint index.

A window is ``WINDOW`` consecutive words. Its fingerprint is the least hash of its ``GRAM``-word
grams, so equal windows have equal fingerprints and neighbours mostly share theirs: a document
adds about two for every nine words. The index is a list of immutable runs of (hash, doc_id). A
run is dealt to the index's buckets by hash and sorted inside them, one file a bucket. A new batch

1. becomes the next run: its fingerprints are the only ones that are shuffled;
2. is merge-joined with itself and every older run, bucket by bucket and in their order, without
   shuffling or sorting history: this tells the hashes that occur in two documents at least;
3. is verified: for documents with such hashes, old and new, the windows that have them are
   compared by 96 bits of the window's words, and the first document of each window found;
4. gives for each of its documents the windows that an earlier document has.

Runs hold no texts. So a batch that meets a filled index comes with the indexed texts; if they are
missing, or one of a document that shares a hash with the batch is, that is an error.

When ``fanout`` runs of a level have come together they are merged into one of the next level.
Earlier means: in the index already, or in the batch with a smaller doc_id. A whole table is taken
in batches that double in size, so that all history they meet is smaller than the table.

Counts of hashes and first documents are aggregated before the shuffle; where a window is in a
third of all documents, the join that follows is a sort-merge join whose skewed partitions Spark
splits, and a hash of a third of all documents meets one row of counts, not its copies.

Every step of a batch is written, and its shuffle files go with it: the disk holds one step's.

Null and empty texts, and those of under 13 words, lose nothing. Rows of one doc_id are one
document for this purpose: they never remove words from each other, and each loses what an
earlier document has. Rows with a null doc_id are neither indexed nor cut. An empty table gives no
rows. A very long text is hashed whole, with some arrays of eight bytes a word beside it. Columns
other than doc_id and text pass through ``cut_documents`` unchanged, whatever their names.
"""

from __future__ import annotations

import hashlib
import json
import re
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.errors import PythonException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tonewright.llm.common import arrow_map, bounded_batches, columns, forget, free_name, fresh_path, raw, read_file, remove, saved, slices, spent_shuffles, write_file

WINDOW = 13
GRAM = 5
BATCHES = 3
FANOUT = 2
#: Documents for each bucket of an index that is made for a table; buckets of other indexes.
BUCKET_DOCUMENTS, BUCKETS = 20_000, 16

_WORDS = re.compile(rb"[^\x20\x09-\x0D]+")
_A, _B = 0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93
_MISSING = "indexed documents that share hashes with the batch are missing from the corpus"


def word_hashes(text: bytes) -> np.ndarray:
    import xxhash

    words = text.split()
    return np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))


def rolled(h: np.ndarray, size: int, factor: int) -> np.ndarray:
    """A mixed polynomial hash of every ``size`` consecutive values."""
    n = len(h) - size + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = h[:n].copy()
    f = np.uint64(factor)
    for j in range(1, size):
        out *= f
        out += h[j : n + j]
    out ^= out >> np.uint64(32)
    out *= np.uint64(_B)
    out ^= out >> np.uint64(29)
    return out


def window_minima(h: np.ndarray) -> np.ndarray:
    """For every window the least hash of its grams."""
    g = rolled(h, GRAM, _A)
    n = len(h) - WINDOW + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = g[:n].copy()
    for j in range(1, WINDOW - GRAM + 1):
        np.minimum(out, g[j : n + j], out=out)
    return out


def _signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)


def anchors(docs: DataFrame) -> DataFrame:
    """(hash, doc_id): the different fingerprints of each document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                found = [_signed(np.unique(window_minima(word_hashes(t)))) for t in raw(part)]
                ids = np.repeat(part.column("doc_id").to_numpy(), [len(f) for f in found])
                flat = np.concatenate(found) if found else np.zeros(0, np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(flat), pa.array(ids, pa.int64())], ["hash", "doc_id"])

    return arrow_map(docs, run, "hash long, doc_id long")


def _windows(docs: DataFrame) -> DataFrame:
    """(w1, w2, doc_id, new): different windows of each document whose fingerprint is in ``hashes``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.column("text").null_count:
                raise ValueError(_MISSING)
            for part in slices(batch):
                w1s, w2s, sizes = [], [], []
                col = part.column("hashes")
                for text, k in zip(raw(part), range(part.num_rows), strict=True):
                    h = word_hashes(text)
                    asked = np.sort(col[k].values.to_numpy())
                    least = _signed(window_minima(h))
                    hit = asked[np.minimum(np.searchsorted(asked, least), len(asked) - 1)] == least
                    w1 = rolled(h, WINDOW, _A)[hit]
                    w1, at = np.unique(w1, return_index=True)
                    w1s.append(_signed(w1))
                    w2s.append((rolled(h, WINDOW, _B)[hit][at] >> np.uint64(32)).astype(np.uint32).view(np.int32))
                    sizes.append(len(w1))
                ids = np.repeat(part.column("doc_id").to_numpy(), sizes)
                new = np.repeat(part.column("new").to_numpy(zero_copy_only=False), sizes)
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(w1s)), pa.array(np.concatenate(w2s)), pa.array(ids, pa.int64()), pa.array(new, pa.bool_())], ["w1", "w2", "doc_id", "new"])

    return arrow_map(docs, run, "w1 long, w2 int, doc_id long, new boolean")


class FingerprintIndex:
    """The runs of one index, kept below ``path`` with a manifest that names them.

    ``buckets`` is fixed when an index begins; an index that goes on keeps its own.
    """

    def __init__(self, spark: SparkSession, path: str | None = None, fanout: int = FANOUT, buckets: int = BUCKETS):
        self.spark, self.fanout = spark, fanout
        self.path = path or fresh_path(spark, "fingerprint-index")
        held = read_file(spark, f"{self.path}/manifest.json")
        found = json.loads(held) if held else {"runs": [], "buckets": buckets}
        self.buckets: int = found["buckets"]
        #: (level, folder), oldest first
        self.runs: list[tuple[int, str]] = [tuple(r) for r in found["runs"]]

    def _commit(self, runs: list[tuple[int, str]]) -> None:
        gone = {r for _, r in self.runs} - {r for _, r in runs}
        write_file(self.spark, f"{self.path}/manifest.json", json.dumps({"window": WINDOW, "gram": GRAM, "buckets": self.buckets, "runs": runs}))
        self.runs = runs
        for r in gone:
            remove(self.spark, r)

    def _write(self, rows: DataFrame, level: int, dealt: bool = False) -> str:
        """Write (hash, doc_id) as a run; returns its folder. ``dealt``: partitions are buckets."""
        folder = f"{self.path}/run-{level}-{uuid.uuid4().hex}"
        name = f"tonewright_run_{uuid.uuid4().hex}"
        rows = rows.select("hash", "doc_id")
        rows = (rows if dealt else rows.repartition(self.buckets, "hash")).sortWithinPartitions("hash", "doc_id")
        with bounded_batches(self.spark):
            rows.write.format("parquet").bucketBy(self.buckets, "hash").sortBy("hash").option("path", folder).saveAsTable(name)
        self.spark.sql(f"DROP TABLE {name}")  # the files stay
        return folder

    @contextmanager
    def opened(self, folders: list[str]) -> Iterator[list[DataFrame]]:
        """Runs as tables whose buckets and order Spark knows; the catalogue forgets them after."""
        names = [f"tonewright_run_{uuid.uuid4().hex}" for _ in folders]
        order = "spark.sql.legacy.bucketedTableScan.outputOrdering"
        before = self.spark.conf.get(order)
        self.spark.conf.set(order, "true")
        try:
            for name, folder in zip(names, folders, strict=True):
                self.spark.sql(f"CREATE TABLE {name} (hash BIGINT, doc_id BIGINT) USING parquet CLUSTERED BY (hash) SORTED BY (hash) INTO {self.buckets} BUCKETS LOCATION '{folder}'")
            yield [self.spark.table(name) for name in names]
        finally:
            self.spark.conf.set(order, before)
            for name in names:
                self.spark.sql(f"DROP TABLE IF EXISTS {name}")

    def _met(self, folder: str) -> DataFrame:
        """(hash, doc_id, new): the rows of a new run and of the older ones whose hash some other
        row has, at least one of the two being new."""
        with self.opened([folder, *[r for _, r in self.runs]]) as (new, *old):
            own = new.groupBy("hash").agg(F.count(F.lit(1)).alias("n"))
            every = new.hint("merge").join(own.hint("merge"), "hash")
            again = F.col("n") > 1
            for k, run in enumerate(old):
                held = run.groupBy("hash").agg(F.lit(True).alias(f"in{k}"))
                every = every.join(held.hint("merge"), "hash", "left")
                again = again | F.coalesce(f"in{k}", F.lit(False))
            met = every.where(again).select("hash", "doc_id", F.lit(True).alias("new"))
            for run in old:
                asked = new.groupBy("hash").agg(F.lit(1).alias("one")).drop("one")
                met = met.union(run.hint("merge").join(asked.hint("merge"), "hash", "left_semi").select("hash", "doc_id", F.lit(False).alias("new")))
            return saved(met, "met")

    def append(self, batch: DataFrame, corpus: DataFrame | None = None) -> DataFrame:
        """Deduplicate (doc_id, text) against the index, and add it.

        ``corpus`` holds the texts of indexed documents (others do no harm); an index with runs
        needs it. Returns (doc_id, w1): hashes of the windows that each document of the batch
        has to lose. Nothing is added to the index if a text is missing.
        """
        if self.runs and corpus is None:
            raise ValueError("the index has runs: the texts of indexed documents are needed to verify what they share with the batch")
        with spent_shuffles(self.spark):
            return self._append(batch, corpus)

    def _append(self, batch: DataFrame, corpus: DataFrame | None) -> DataFrame:
        spark = self.spark
        batch = batch.where("doc_id IS NOT NULL")
        folder = self._write(anchors(batch), 0)
        met = self._met(folder)
        wanted = met.groupBy("doc_id", "new").agg(F.collect_list("hash").alias("hashes"))
        given = lambda df, new: df.select("doc_id", F.coalesce("text", F.lit("")).alias("text"), F.lit(new).alias("new"))
        texts = given(batch, True)
        if self.runs:
            texts = texts.union(given(corpus, False))
        # a null text after this join is one that the corpus doesn't have
        try:
            windows = saved(_windows(texts.join(wanted, ["doc_id", "new"], "right")), "windows")
        except PythonException as e:
            remove(spark, folder)
            if _MISSING in str(e):
                raise ValueError(_MISSING) from e
            raise
        forget(met)
        # plain numbers, so that the aggregation hashes; a struct's minimum would have to sort
        firsts = windows.groupBy("w1", "w2").agg(F.min("doc_id").alias("first"), F.bool_and("new").alias("fresh"), F.count(F.lit(1)).alias("n")).where("n > 1").drop("n")
        lost = windows.where("new").join(firsts, ["w1", "w2"]).where("NOT fresh OR doc_id > first").select("doc_id", "w1")
        out = saved(lost, "lost")
        forget(windows)
        self._commit([*self.runs, (0, folder)])
        self.compact()
        return out

    def compact(self) -> None:
        """Merge runs while ``fanout`` of a level have come together."""
        while True:
            levels = [level for level, _ in self.runs]
            full = next((x for x in sorted(set(levels)) if levels.count(x) >= self.fanout), None)
            if full is None:
                return
            with self.opened([r for level, r in self.runs if level == full]) as runs:
                # the union of runs has their buckets, so nothing is shuffled; a row is kept once
                rows = reduce(DataFrame.union, runs).groupBy("hash", "doc_id").agg(F.lit(1).alias("one"))
                folder = self._write(rows, full + 1, dealt=True)
            self._commit([*[r for r in self.runs if r[0] != full], (full + 1, folder)])


def doubling_bounds(docs: DataFrame, batches: int) -> list[int]:
    """Split points of doc_id into ``batches`` of which each holds about twice the one before."""
    parts = 2**batches - 1
    if batches < 2:
        return []
    got = docs.approxQuantile("doc_id", [(2**k - 1) / parts for k in range(1, batches)], 0.1 / parts)
    return sorted({int(x) for x in got})


def lost_windows(docs: DataFrame, batches: int = BATCHES, index: FingerprintIndex | None = None, corpus: DataFrame | None = None) -> DataFrame:
    """(doc_id, w1) for the whole table, taken in ``batches`` of ascending doc_id.

    ``corpus`` holds the texts of what ``index`` has already, if it has anything. An index made
    here lives as long as the call."""
    spark = docs.sparkSession
    own = index is None
    index = index or FingerprintIndex(spark, buckets=max(BUCKETS, -(-docs.count() // BUCKET_DOCUMENTS)))
    if index.runs and corpus is None:
        raise ValueError("the index has runs: the texts of indexed documents are needed")
    bounds = doubling_bounds(docs.select("doc_id"), batches)
    parts = []
    for k in range(len(bounds) + 1):
        inside = F.lit(True)
        if k:
            inside = F.col("doc_id") >= bounds[k - 1]
        if k < len(bounds):
            inside = inside & (F.col("doc_id") < bounds[k])
        before = docs.where(F.col("doc_id") < bounds[k - 1]).select("doc_id", "text") if k else None
        if corpus is not None:
            known = corpus.select("doc_id", "text")
            before = known if before is None else known.union(before)
        parts.append(index.append(docs.where(inside), before))
    if own:
        remove(spark, index.path)
    return reduce(DataFrame.union, parts)


def covered(text: bytes, lost: np.ndarray) -> np.ndarray:
    """Which words of a text lie in a window to lose."""
    h = word_hashes(text)
    mark = np.zeros(len(h), bool)
    at = np.flatnonzero(np.isin(_signed(rolled(h, WINDOW, _A)), lost))
    for j in range(WINDOW):
        mark[at + j] = True
    return mark


def _with_lost(docs: DataFrame, lost: DataFrame) -> tuple[DataFrame, str]:
    """The rows with the windows they lose, and the name of that column."""
    name = free_name("lost", docs.columns)
    lists = lost.groupBy("doc_id").agg(F.collect_list("w1").alias(name))
    return docs.join(lists, "doc_id", "left").select(*columns(docs.columns), name), name


def word_digest(docs: DataFrame, batches: int = BATCHES) -> DataFrame:
    """(doc_id, n_words, n_removed, kept_sha256): kept words joined by single spaces."""

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in parts:
            for part in slices(batch):
                rows = []
                lost = part.column("lost")
                for k, text in enumerate(raw(part)):
                    words = text.split()
                    n = len(words)
                    if lost[k].is_valid:
                        mark = covered(text, lost[k].values.to_numpy())
                        words = [w for w, gone in zip(words, mark.tolist(), strict=True) if not gone]
                    rows.append((n, n - len(words), hashlib.sha256(b" ".join(words)).hexdigest()))
                cols = [part.column("doc_id")] + [pa.array([r[i] for r in rows], t) for i, t in enumerate((pa.int64(), pa.int64(), pa.string()))]
                yield pa.RecordBatch.from_arrays(cols, ["doc_id", "n_words", "n_removed", "kept_sha256"])

    docs = docs.select("doc_id", "text")
    return arrow_map(_with_lost(docs, lost_windows(docs, batches))[0], run, "doc_id long, n_words long, n_removed long, kept_sha256 string")


def cut(text: bytes, lost: np.ndarray) -> bytes:
    """The text without covered words; what separates kept words stays, once."""
    mark = covered(text, lost)
    out, end = [], None
    for m, gone in zip(_WORDS.finditer(text), mark.tolist(), strict=True):
        if gone:
            continue
        # the space or break in front of a kept word joins it to the kept word before
        out.append(text[max(m.start() - 1, 0) : m.end()] if end is not None and end < m.start() - 1 else text[m.start() if end is None else end : m.end()])
        end = m.end()
    return b"".join(out)


def cut_documents(docs: DataFrame, batches: int = BATCHES) -> DataFrame:
    """The rows of ``docs`` without repeated windows in text, n_chars anew; a document that has
    words but keeps none goes."""
    keyed = docs.withColumn("text", F.coalesce("text", F.lit("")))
    marked, lost = _with_lost(keyed, lost_windows(keyed.select("doc_id", "text"), batches))
    names = docs.columns

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in parts:
            for part in slices(batch):
                gone = part.column(lost)
                texts = raw(part)
                new = [cut(t, gone[k].values.to_numpy()) if gone[k].is_valid else t for k, t in enumerate(texts)]
                text = pa.array([t.decode() for t in new], part.schema.field("text").type)
                out = pa.RecordBatch.from_arrays([text if n == "text" else part.column(n) for n in names], names=names)
                yield out.filter(pa.array([bool(n.strip()) or not t.strip() for n, t in zip(new, texts, strict=True)], pa.bool_()))

    out = arrow_map(marked, run, marked.drop(lost).schema)
    if "n_chars" in names:
        out = out.withColumn("n_chars", F.char_length("text").cast(docs.schema["n_chars"].dataType))
    return out
