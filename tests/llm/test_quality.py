import random

import pytest

from tonewright.llm import quality
from tonewright.llm.common import documents
from tonewright.llm.oracles import QUALITY_SQL

from . import fixtures as fx


def mixed(seed=6):
    rng = random.Random(seed)
    odd = ["Home | About | Contact", "###### $$$ ***", "Buy NOW!!! WOW!!! ?? !!", "All Rights Reserved by us, forever and a day.", "short bit", "A real sentence ends here.", "a » b » c", "Tab\tand  double", "日本語 です。", "same line again and again."]
    rows = fx.awkward()
    for k in range(60):
        rows.append((300 + k, "\n".join(rng.choice(odd) if rng.random() < 0.4 else " ".join(fx.words(rng, rng.randrange(1, 20), 3000)) + rng.choice([".", "", "!"]) for _ in range(rng.randrange(1, 20)))))
    return rows


def test_against_sql(spark):
    rows = mixed()
    assert fx.found(quality.assess(documents(fx.table(spark, rows)))) == fx.oracle(QUALITY_SQL, rows)


def test_empty_table(spark):
    assert quality.assess(documents(fx.table(spark, []))).collect() == []
    assert quality.clean_documents(fx.table(spark, [])).collect() == []


@pytest.mark.parametrize(
    ("line", "rule"),
    [("Home page | News of today | Sport results", "navigation"), ("%%%%%% a", "symbols"), ("no!! way??", "shouting"), ("see more", "remnant"), ("The end.", ""), ("This text is Licensed Under the terms below.", "boilerplate"), ("", ""), ("four words are fine", ""), ("one of two | parts of this", "")],
)
def test_line_rules(line, rule):
    assert quality.line_fails(line.encode()) == rule


def test_clean_documents(spark):
    rows = mixed(8)
    df = fx.table(spark, rows)
    got = quality.clean_documents(df)
    assert got.columns == df.columns and got.dtypes == df.dtypes
    verdict = [(d, quality.judge((t or "").encode())) for d, t in rows]
    assert fx.by_row((r.doc_id, r.text) for r in got.collect()) == fx.by_row((d, v[8].decode()) for d, v in verdict if v[6])
    assert all(r.n_chars == len(r.text) for r in got.collect())


def test_clean_prose_is_kept_whole():
    rng = random.Random(2)
    text = "\n".join(" ".join(fx.words(rng, 15, 5000)) + "." for _ in range(10)).encode()
    assert quality.judge(text)[6:] == (True, 0, text)


def test_repeat_words():
    def plain(w):
        grams = [tuple(w[i : i + 3]) for i in range(len(w) - 2)]
        return len({i + j for i, g in enumerate(grams) if grams.count(g) > 1 for j in range(3)})

    rng = random.Random(4)
    for _ in range(100):
        w = [b"%d" % rng.randrange(4) for _ in range(rng.randrange(20))]
        assert quality.repeat_words(w) == plain(w)
