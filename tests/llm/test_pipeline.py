"""The pipeline against plain Python, stage by stage, and end to end."""

import random
import re
import zlib
from collections import defaultdict

import numpy as np

import corpus_pipeline
from tonewright.llm import quality

from . import fixtures as fx
from .test_simhash import similar_groups
from .test_substring_index import brute as lost_words
from .test_tokens import library

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def corpus(seed=5):
    rng = random.Random(seed)
    line = lambda n=12: " ".join(fx.words(rng, n, 4000)) + "."
    texts = ["\n".join(line() for _ in range(rng.randrange(5, 15))) for _ in range(40)]
    run = "\n".join(line() for _ in range(4))
    passage = " ".join(fx.words(rng, 70, 4000))
    rows = list(enumerate(texts))
    for k in range(20):
        t = texts[k]
        rows.append((200 + k, t + "\n" + line(10) if k % 2 else t))  # copies and near copies
    for k in range(20):
        own = [line() for _ in range(8)]
        own[3:3] = [run] if k % 2 else ["Start of it " + passage + " end of it."]
        rows.append((300 + k, "\n".join(own)))
    rows += [(400, None), (401, ""), (402, "too short."), (403, "\n".join(["Home | News | Shop"] * 30)), (404, "\n".join(line() for _ in range(2000)))]
    rows += [(405, rows[3][1]), (405, rows[3][1])]
    return rows


def plain_lines(rows):
    """Rows without later repeats of runs of three lines."""
    seen, out = set(), []
    for k in sorted(range(len(rows)), key=lambda k: rows[k][0]):
        d, t = rows[k]
        ls = t.split("\n")
        own = [i for i, x in enumerate(ls) if WORD.search(x)]
        gone = set()
        for j in range(len(own) - 2):
            key = tuple(ls[own[j + i]] for i in range(3))
            if key in seen:
                gone |= set(own[j : j + 3])
            seen.add(key)
        new = "\n".join(x for i, x in enumerate(ls) if i not in gone)
        if WORD.search(new) or not own:
            out.append((d, new))
    return out


def plain_run(rows):
    judged = [(d, quality.judge((t or "").encode())) for d, t in rows]
    rows = [(d, v[8].decode()) for d, v in judged if v[6]]
    yield rows
    rows = plain_lines(rows)
    yield rows
    of = similar_groups(rows)
    leasts = {}
    for k, (d, _) in enumerate(rows):
        leasts[of[k]] = min(d, leasts.get(of[k], d))
    rows = [(d, t) for k, (d, t) in enumerate(rows) if d == leasts[of[k]]]
    yield rows
    kept = [(d, " ".join(x for x, gone in zip(w, mark, strict=True) if not gone)) for (d, _), (w, mark) in zip(rows, lost_words(rows), strict=True)]
    yield [(d, t) for d, t in kept if t]


def test_every_stage_and_the_end(spark, tmp_path):
    rows = [r for k, r in enumerate(corpus()) if r[0] != 405]
    fx.table(spark, rows).write.parquet(f"{tmp_path}/documents.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    for (name, stage), wanted in zip(corpus_pipeline.STAGES, plain_run(rows), strict=False):
        out = stage(spark, docs, str(tmp_path))
        assert out.columns == list(corpus_pipeline.COLUMNS), name
        out.write.parquet(f"{tmp_path}/{name}")
        docs = spark.read.parquet(f"{tmp_path}/{name}")
        got = docs.collect()
        assert {r.doc_id for r in got} == {d for d, _ in wanted}, name
        assert fx.by_row((r.doc_id, WORD.findall(r.text)) for r in got) == fx.by_row((d, WORD.findall(t)) for d, t in wanted), name
        assert all(r.n_chars == len(r.text) for r in got), name
    texts = {r.doc_id: r.text for r in docs.collect()}
    pieces = corpus_pipeline.run(spark, str(tmp_path)).collect()
    lib, by = library("byte_bpe_50k.json"), defaultdict(list)
    for r in pieces:
        by[r.doc_id].append(r)
    assert set(by) == set(texts)
    for d, ps in by.items():
        ids = [*lib(texts[d]), 0]
        at = 0
        for r in sorted(ps, key=lambda r: r.start):
            assert r.start == at and r.ids_crc32 == zlib.crc32(np.array(ids[at : at + r.length], "<u4").tobytes())
            at += r.length
        assert at == len(ids) == ps[0].doc_tokens


def test_stages_take_awkward_tables(spark, tmp_path):
    for label, rows in (("awkward", fx.awkward()), ("empty", [])):
        fx.table(spark, rows).write.parquet(f"{tmp_path}/{label}/documents.parquet")
        out = corpus_pipeline.run(spark, f"{tmp_path}/{label}").collect()
        assert bool(out) == bool(rows)
        for name, stage in corpus_pipeline.STAGES:
            got = stage(spark, fx.table(spark, rows), f"{tmp_path}/{label}")
            if name != corpus_pipeline.STAGES[-1][0]:
                assert got.columns == list(corpus_pipeline.COLUMNS)
            assert bool(got.collect()) == bool(rows)


def test_repeated_rows_do_not_remove_each_other(spark, tmp_path):
    rows = [r for r in corpus() if r[0] == 405]
    fx.table(spark, rows).write.parquet(f"{tmp_path}/documents.parquet")
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert {r.doc_id for r in got} == {405} and sum(r.length for r in got) == 2 * got[0].doc_tokens
