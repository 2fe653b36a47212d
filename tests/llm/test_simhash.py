import random
from collections import Counter

import numpy as np
import xxhash
from pyspark.sql import functions as F

from . import fixtures as fx
from tonewright.llm import simhash
from tonewright.llm.common import documents
from tonewright.llm.graph import components

ASCII = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def shingles(text, n):
    w = (text or "").translate(ASCII).encode().split()
    return [b" ".join(w[i : i + n]) for i in range(max(1, len(w) - n + 1))] if w else []


def plain_fingerprint(text, n=3):
    h = [xxhash.xxh64_intdigest(s, seed=42) for s in shingles(text, n)]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def test_whole_operator(spark):
    rows = fx.awkward()
    fps = [plain_fingerprint(t) for _, t in rows]
    of = fx.components(len(rows), [(i, j) for i in range(len(rows)) for j in range(i) if (fps[i] ^ fps[j]).bit_count() <= 2])
    least: dict[int, int] = {}
    for k, (d, _) in enumerate(rows):
        if d is not None:
            least[of[k]] = min(d, least.get(of[k], d))
    wanted = fx.by_row((least.get(of[k]), d, f"{fps[k]:016x}") for k, (d, _) in enumerate(rows))
    assert fx.found(simhash.near_duplicates(documents(fx.table(spark, rows)))) == wanted


def test_empty_table(spark):
    assert simhash.near_duplicates(documents(fx.table(spark, []))).collect() == []
    assert simhash.keep_one(fx.table(spark, [])).collect() == []


def _linked(spark, values, **how):
    nodes = spark.createDataFrame([(v - (1 << 64) if v >> 63 else v,) for v in values], "fp long")
    return {(r.a % (1 << 64), r.b % (1 << 64)) for r in simhash.links(nodes, **how).collect()}


def test_links_lose_none_and_add_none(spark):
    rng = random.Random(3)
    seeds = [rng.getrandbits(64) for _ in range(6)]
    values = {0, (1 << 64) - 1}
    for s in seeds:
        values.add(s)
        for _ in range(40):
            values.add(s ^ sum(1 << b for b in rng.sample(range(64), rng.randrange(1, 6))))
    values = sorted(values)
    pairs = {(a, b) for a in values for b in values if a < b and (a ^ b).bit_count() <= 2}
    small = {tuple(sorted(p)) for p in _linked(spark, values, cell=10_000)}
    assert small == pairs
    # crowded cells give stars: the same components, and each edge is a true link
    crowded = {tuple(sorted(p)) for p in _linked(spark, values, cell=2)}
    assert crowded <= pairs
    place = {v: k for k, v in enumerate(values)}
    both = [fx.components(len(values), [(place[a], place[b]) for a, b in found]) for found in (pairs, crowded)]
    assert both[0] == both[1]


def test_manhattan_is_a_lower_bound(spark):
    rng = random.Random(5)
    rows = [(rng.getrandbits(63), rng.getrandbits(63)) for _ in range(200)]
    df = spark.createDataFrame(rows, "a long, b long")
    got = df.select("a", "b", F.bit_count(simhash.embedded(F.col("a")).bitwiseXOR(simhash.embedded(F.col("b")))).alias("d")).collect()
    for r in got:
        counts = lambda x: [(x >> 2 * s & 3).bit_count() for s in range(32)]
        assert r.d == sum(abs(x - y) for x, y in zip(counts(r.a), counts(r.b), strict=True)) <= (r.a ^ r.b).bit_count()


def test_components(spark):
    rng = random.Random(1)
    edges = [(k, k + 1) for k in range(0, 60)] + [(rng.randrange(100, 160), rng.randrange(100, 160)) for _ in range(40)] + [(7, 7), (3, 2)]
    of = fx.components(200, edges)
    got = {r.node: r.component for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {n: of[n] for e in edges for n in e if e[0] != e[1] or n in got}
    assert components(spark.createDataFrame([], "a long, b long")).collect() == []


def similar_groups(rows, n=5, least=0.8):
    sets = [frozenset(shingles(t, n)) for _, t in rows]
    return fx.components(len(rows), [(i, j) for i in range(len(rows)) for j in range(i) if sets[i] == sets[j] or len(sets[i] & sets[j]) >= least * len(sets[i] | sets[j])])


def test_keep_one_of_similar(spark):
    rng = random.Random(11)
    rows = [r for r in fx.awkward() if r[0] != 18]
    rows = [r for k, r in enumerate(rows) if r not in rows[:k]]
    base = fx.words(rng, 300, 100_000)
    for k in range(70):  # one crowd of near copies, each with a change of its own
        rows.append((500 + k, " ".join(base[: 4 * k] + [f"own{k}"] + base[4 * k + 1 :])))
    for k in range(30):
        some = fx.words(rng, 80, 100_000)
        rows += [(700 + 2 * k, " ".join(some)), (701 + 2 * k, " ".join(some[:40] + ["x"] + some[41:]))]
    known = [r for r in rows if r[0] is not None]
    of = similar_groups(known)
    wanted = Counter(d for k, (d, _) in enumerate(known) if d == min(known[j][0] for j in range(len(known)) if of[j] == of[k]))
    wanted[None] = len(rows) - len(known)
    df = fx.table(spark, rows)
    kept = simhash.keep_one(df)
    assert kept.columns == df.columns
    assert Counter(r.doc_id for r in kept.collect()) == wanted


def test_passages_that_many_share(spark):
    """In groups that meet through a common passage every true pair is found."""
    rng = random.Random(12)
    passage = fx.words(rng, 45, 100_000)
    rows = []
    for k in range(120):
        own = fx.words(rng, 30, 100_000)
        rows.append((2 * k, " ".join(passage + own)))
        if k % 3 == 0:
            rows.append((2 * k + 1, " ".join(passage + own[:-1] + ["other"])))
    of = similar_groups(rows)
    got = {r.doc_id: r.component_id for r in simhash.similar(documents(fx.table(spark, rows))).collect()}
    assert got == {d: rows[of[k]][0] for k, (d, _) in enumerate(rows)}
    assert len(set(got.values())) == 120


def test_parities_bound_the_difference():
    rng = random.Random(13)
    for _ in range(100):
        x, y = (set(rng.sample(range(1 << 32), rng.randrange(200))) for _ in range(2))
        y |= set(rng.sample(sorted(x), len(x) // 2))
        px, py = (simhash.parities(np.array(sorted(z), np.uint32)) for z in (x, y))
        assert sum((int(a) ^ int(b)).bit_count() for a, b in zip(px.view(np.uint64), py.view(np.uint64), strict=True)) <= len(x ^ y)
