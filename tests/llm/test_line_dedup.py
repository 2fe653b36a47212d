import random

from tonewright.llm import line_dedup as ld
from tonewright.llm.common import documents
from tonewright.llm.oracles import LINES_SQL

from . import fixtures as fx


def shared(seed=3):
    rng = random.Random(seed)
    runs = [[" ".join(fx.words(rng, 6, 50)) for _ in range(n)] for n in (2, 3, 4, 9)]
    # the SQL tells texts of one doc_id apart by nothing, so doc_ids differ here
    rows = [(d, t) for d, t in {d: t for d, t in fx.awkward() if d is not None}.items()]
    for k in range(50):
        own = [rng.choice(["", "  ", "* * *", f"line {rng.randrange(10_000)} of {k}"]) for _ in range(8)]
        for r in rng.sample(runs, rng.randrange(4)):
            at = rng.randrange(len(own) + 1)
            own[at:at] = r
        if k % 5 == 0:
            own += runs[3] + runs[3]  # twice in the same document
        rows.append((1000 + k, "\n".join(own)))
    rows += [(2000, "same\nsame\nsame\nsame\nsame"), (2001, "same\n\nsame\nsame")]
    return rows


def test_against_sql(spark):
    rows = shared()
    assert fx.found(ld.line_digest(documents(fx.table(spark, rows)))) == fx.oracle(LINES_SQL, rows)


def test_repeated_rows_and_null_ids(spark):
    lines = "a b\nc d\ne f\ng h"
    rows = [(2, lines), (2, lines), (1, "x\n" + lines), (None, lines), (3, lines + "\nown end"), (2, "z\n" + lines)]
    got = [(r.doc_id, r.n_removed) for r in ld.line_digest(documents(fx.table(spark, rows))).collect()]
    assert fx.by_row(got) == fx.by_row([(1, 0), (2, 4), (2, 4), (2, 4), (3, 4), (None, 0)])


def test_winnowing_guarantee():
    """Every window has its fingerprint among the chosen places, the rightmost of equals."""
    rng = random.Random(1)
    import numpy as np

    for _ in range(50):
        h = np.array([rng.randrange(4) for _ in range(rng.randrange(12))], np.uint64)
        got = ld.chosen(h).tolist()
        assert got == [max((-int(h[j]), j) for j in range(i, i + 3))[1] for i in range(max(0, len(h) - 2))]


def test_cut_documents(spark):
    rows = shared(8) + [(None, "a\nb\nc"), (None, None)]
    df = fx.table(spark, rows)
    got = ld.cut_documents(df)
    assert got.columns == df.columns and got.dtypes == df.dtypes
    texts = got.collect()
    assert all(r.n_chars == len(r.text) for r in texts)
    sizes = {d: (n, gone) for d, _, n, gone in fx.oracle(LINES_SQL, [r for r in rows if r[0] is not None])}
    wanted = {d: n - gone for d, (n, gone) in sizes.items() if n > gone or not n}
    assert {r.doc_id: sum(1 for x in r.text.split("\n") if x.encode().strip()) for r in texts if r.doc_id is not None} == wanted
    assert sum(r.doc_id is None for r in texts) == 2
    extra = {(r.doc_id, r.rid, r.starts) for r in texts}
    assert extra <= {(r.doc_id, r.rid, r.starts) for r in df.collect()}


def test_empty_table(spark):
    assert ld.line_digest(documents(fx.table(spark, []))).collect() == []
    assert ld.cut_documents(fx.table(spark, [])).collect() == []
