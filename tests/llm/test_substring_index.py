import hashlib
import random
import re
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from tonewright.llm import substring_index as si
from tonewright.llm.common import documents

from . import fixtures as fx

WORD = re.compile(r"[^\x20\x09-\x0D]+")
N = 13


def brute(rows):
    """Marks of the words to lose, row by row: every window against all rows."""
    texts = [WORD.findall(t or "") for _, t in rows]
    first: dict[tuple, int] = {}
    for (d, _), w in zip(rows, texts, strict=True):
        for i in range(len(w) - N + 1):
            if d is not None:
                key = tuple(w[i : i + N])
                first[key] = min(d, first.get(key, d))
    out = []
    for (d, _), w in zip(rows, texts, strict=True):
        mark = [False] * len(w)
        for i in range(len(w) - N + 1):
            if d is not None and first[tuple(w[i : i + N])] < d:
                mark[i : i + N] = [True] * N
        out.append((w, mark))
    return out


def digest(rows):
    out = []
    for (d, _), (w, mark) in zip(rows, brute(rows), strict=True):
        kept = " ".join(x for x, gone in zip(w, mark, strict=True) if not gone)
        out.append((d, hashlib.sha256(kept.encode()).hexdigest(), sum(mark), len(w)))
    return fx.by_row(out)


def shared(seed=2):
    """Passages that many documents share, at their ends, in a row, overlapping, and just too short."""
    rng = random.Random(seed)
    passages = [fx.words(rng, n, 50) for n in (12, 13, 14, 40, 60)]
    rows = fx.awkward()
    for k in range(60):
        w = fx.words(rng, 20, 10_000)
        for p in rng.sample(passages, rng.randrange(3)):
            at = rng.randrange(len(w) + 1)
            w[at:at] = p
        rows.append((rng.randrange(200, 1000), ("\n" if k % 2 else "  ").join(w)))
    return rows


@pytest.mark.parametrize("batches", [1, 2, 5])
def test_whole_operator(spark, batches):
    rows = shared()
    got = si.word_digest(documents(fx.table(spark, rows)), batches)
    assert fx.found(got, "doc_id", "n_words", "n_removed", "kept_sha256") == digest(rows)


def test_empty_table(spark):
    assert si.word_digest(documents(fx.table(spark, []))).collect() == []
    assert si.cut_documents(fx.table(spark, [])).collect() == []


def test_cut_documents(spark):
    rows = shared(9)
    df = fx.table(spark, rows)
    got = si.cut_documents(df)
    assert got.columns == df.columns and got.dtypes == df.dtypes
    wanted = []
    for (d, t), (w, mark) in zip(rows, brute(rows), strict=True):
        kept = [x for x, gone in zip(w, mark, strict=True) if not gone]
        if kept or not w:
            wanted.append((d, kept))
    texts = got.select("doc_id", "text", "n_chars").collect()
    assert fx.by_row((r.doc_id, WORD.findall(r.text)) for r in texts) == fx.by_row(wanted)
    assert all(r.n_chars == len(r.text) for r in texts)
    extra = {(r.doc_id, r.lost) for r in got.collect()}
    assert extra <= {(r.doc_id, r.lost) for r in df.collect()}


def test_untouched_texts_stay_byte_for_byte(spark):
    rows = [(1, "  odd \t spacing\n\n of words "), (2, "other"), (3, None)]
    got = {r.doc_id: r.text for r in si.cut_documents(fx.table(spark, rows)).collect()}
    assert got == {1: "  odd \t spacing\n\n of words ", 2: "other", 3: ""}


def test_index_lives_on(spark, tmp_path):
    """A second index object on the same folder takes up where the first has ended."""
    rows = [r for r in shared(4) if r[0] is not None]
    rows.sort(key=lambda r: r[0])
    docs = documents(fx.table(spark, rows)).cache()
    path = f"file://{tmp_path}/index"
    lost = []
    bounds = [0, 12, 150, 600, 2000]
    for k, (a, b) in enumerate(zip(bounds, bounds[1:], strict=False)):
        index = si.FingerprintIndex(spark, path)
        before = docs.where(f"doc_id < {a}") if k else None
        lost += index.append(docs.where(f"doc_id >= {a} AND doc_id < {b}"), before).collect()
    assert len(si.FingerprintIndex(spark, path).runs) < 4  # compacted on the way
    hit = {r.doc_id for r in lost}
    assert hit == {d for (d, _), (_, mark) in zip(rows, brute(rows), strict=True) if any(mark)}


def test_new_documents_against_a_filled_index(spark, tmp_path):
    """Windows that stand only in an indexed document count, in every batch; no text may be missing."""
    rows = sorted((r for r in shared(5) if r[0] is not None), key=lambda r: r[0])
    docs = documents(fx.table(spark, rows)).cache()
    old, new = docs.where("doc_id < 400"), docs.where("doc_id >= 400")
    index = si.FingerprintIndex(spark, f"file://{tmp_path}/index")
    si.lost_windows(old, 2, index)
    runs = list(index.runs)
    for refused in (lambda: index.append(new), lambda: si.lost_windows(new, 2, index), lambda: index.append(new, old.where("doc_id < 300"))):
        with pytest.raises(ValueError, match="indexed documents"):
            refused()
        assert index.runs == runs
    lost = si.lost_windows(new, 3, index, old).groupBy("doc_id").agg(F.collect_list("w1").alias("w1")).collect()
    gone = {r.doc_id: np.array(r.w1, np.int64) for r in lost}
    none = np.zeros(0, np.int64)
    wanted = [(d, mark) for (d, _), (_, mark) in zip(rows, brute(rows), strict=True) if d >= 400]
    assert fx.by_row((d, si.covered(t.encode(), gone.get(d, none)).tolist()) for d, t in rows if d >= 400) == fx.by_row(wanted)


def _operators(df):
    plan = df._jdf.queryExecution().executedPlan().toString()
    return plan.split("== Initial Plan ==")[0]


def test_history_is_merged_in_place(spark, tmp_path):
    """The join of a new run with older ones neither shuffles nor sorts them."""
    rows = sorted((r for r in shared(6) if r[0] is not None), key=lambda r: r[0])
    docs = documents(fx.table(spark, rows)).cache()
    index = si.FingerprintIndex(spark, f"file://{tmp_path}/index", fanout=9, buckets=4)
    before = None
    for k, (a, b) in enumerate(((0, 100), (100, 400), (400, 2000))):
        index.append(docs.where(f"doc_id >= {a} AND doc_id < {b}"), before)
        before = docs.where(f"doc_id < {b}")
        assert len(index.runs) == k + 1
    with index.opened([r for _, r in index.runs]) as (new, *old):
        for run in old:
            asked = new.groupBy("hash").agg(F.lit(1).alias("one")).drop("one")
            plan = _operators(run.hint("merge").join(asked.hint("merge"), "hash", "left_semi"))
            assert "SortMergeJoin" in plan and "Exchange" not in plan
            # the one sort is that of the new run's different hashes
            assert plan.count("+- Sort [") == 1 and plan.count("Bucketed: true") == 2
        merged = new.union(old[0]).groupBy("hash", "doc_id").count()
        assert "Exchange" not in _operators(merged)
        held = [r for run in (new, *old) for r in run.collect()]
    whole = {(r.hash, r.doc_id) for r in si.anchors(docs).collect()}
    assert {(r.hash, r.doc_id) for r in held} == whole


def _shuffled(spark):
    """Names of the shuffle files that lie on disk."""
    held = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()
    return {f for f in (held.apply(k).getName() for k in range(held.size())) if re.fullmatch(r"shuffle_\d+_\d+_\d+\.data", f)}


def test_shuffle_files_go_with_their_statement(spark, tmp_path, monkeypatch):
    """They don't wait for the driver to collect its garbage; the setting is the caller's again at the end."""
    rows = sorted((r for r in shared(8) if r[0] is not None), key=lambda r: r[0])
    docs = documents(fx.table(spark, rows)).cache()
    docs.count()
    old, new = docs.where("doc_id < 400"), docs.where("doc_id >= 400")
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    setting = spark.conf.get(name)
    left = []

    def watched(statement):
        def run(*args, **more):
            before = _shuffled(spark)
            out = statement(*args, **more)
            for _ in range(50):
                if not (stay := _shuffled(spark) - before):
                    break
                time.sleep(0.1)
            left.append((spark.conf.get(name), stay))
            return out

        return run

    monkeypatch.setattr(si, "saved", watched(si.saved))
    monkeypatch.setattr(si.FingerprintIndex, "_write", watched(si.FingerprintIndex._write))
    index = si.FingerprintIndex(spark, f"file://{tmp_path}/index")
    index.append(old)
    lost = index.append(new, old)
    assert left == [("true", set())] * 9  # four statements a batch, and one that compacts
    assert spark.conf.get(name) == setting
    assert lost.count() > 0


def test_rows_read_of_many_batches(spark, tmp_path):
    """Compaction keeps few runs, however many batches come; none is lost."""
    rows = [(k, " ".join(fx.words(random.Random(k % 9), 20, 500))) for k in range(24)]
    docs = documents(fx.table(spark, rows)).cache()
    index = si.FingerprintIndex(spark, f"file://{tmp_path}/index", buckets=2)
    cut = set()
    for k in range(12):
        inside = docs.where(f"doc_id >= {2 * k} AND doc_id < {2 * k + 2}")
        cut |= {r.doc_id for r in index.append(inside, docs.where(f"doc_id < {2 * k}") if k else None).collect()}
        assert len(index.runs) <= (k + 1).bit_length()
    assert cut == set(range(9, 24))
