import hashlib
import random
import statistics

import numpy as np
import pytest

from tonewright.llm import edit_fingerprint as ef
from tonewright.llm.common import documents

from . import fixtures as fx


def plain_walk(text, begin=0):
    """One character after the other, one shared bit at a time."""
    bits = np.unpackbits(np.frombuffer(hashlib.shake_256(b"edit walk").digest(ef.CLASSES * ef.PERIOD // 8), np.uint8)).reshape(ef.CLASSES, ef.PERIOD)
    t, out = begin, []
    for c in text:
        cls = (ord(c) * 0x9E3779B1 & 0xFFFFFFFF) >> 26
        out.append(t)
        held = 0
        while True:
            moves = bits[cls, t % ef.PERIOD]
            t += 1
            held += 1
            if moves or held == 200:
                break
    return [*out, t]


def test_walk_is_the_shared_random_walk():
    rng = random.Random(1)
    texts = ["", "a", "ab" * 30, "é中😀" * 7] + ["".join(rng.choice("abcdefg hij") for _ in range(rng.randrange(300))) for _ in range(100)]
    begin = np.array([rng.randrange(10_000) for _ in texts], np.int64)
    got = ef.walk([ef.points(t.encode()) for t in texts], begin)
    for t, b, w in zip(texts, begin.tolist(), got, strict=True):
        assert w.tolist() == plain_walk(t, b)


def edited(rows):
    """(text, edited text, next text) as the contract words it, by ascending doc_id."""
    order = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] or ""))
    texts = [t or "" for _, t in order]
    out = []
    for k, (d, _) in enumerate(order):
        t, nxt = texts[k], texts[(k + 1) % len(texts)]
        cut = len(t) // 4
        out.append((d, t, t[: len(t) - cut] + nxt[:cut], nxt))
    return out


@pytest.mark.parametrize("which", ["unique", "with nulls"])
def test_whole_operator(spark, which):
    rows = fx.awkward()
    if which == "unique":
        rows = list({d: (d, t) for d, t in rows if d is not None}.values())
    wanted = []
    for d, t, e, nxt in edited(rows):
        a, b, c = ef.fingerprints([t.encode()])[0], ef.fingerprints([e.encode()])[0], ef.fingerprints([nxt.encode()])[0]
        wanted.append((d, len(t), hashlib.sha256(e.encode()).hexdigest(), a, b, ef.likeness(a, b), ef.likeness(a, c)))
    names = ("doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next")
    order = sorted(range(len(names)), key=lambda i: names[i])
    got = ef.edited_likeness(documents(fx.table(spark, rows)))
    assert fx.found(got) == fx.by_row(tuple(w[i] for i in order) for w in wanted)


def test_few_rows(spark):
    assert ef.edited_likeness(documents(fx.table(spark, []))).collect() == []
    (r,) = ef.edited_likeness(documents(fx.table(spark, [(5, "abcdefgh")]))).collect()
    assert (r.doc_id, r.n_chars, r.near_next) == (5, 8, 1.0)
    assert r.edited_sha256 == hashlib.sha256(b"abcdefab").hexdigest()
    rows = ef.edited_likeness(documents(fx.table(spark, [(5, None), (6, "")]))).collect()
    assert [(r.n_chars, r.near_edited, r.near_next) for r in rows] == [(0, 1.0, 1.0)] * 2


def test_likeness_tells_edits_from_strangers():
    rng = random.Random(3)
    near, far = [], []
    for _ in range(60):
        t = " ".join(fx.words(rng, 120, 3000))
        other = " ".join(fx.words(rng, 120, 3000))
        at = rng.randrange(len(t))
        changed = t[:at] + rng.choice(["", "x", "yz"]) + t[at + rng.randrange(3) :]
        a, b, c = ef.fingerprints([t.encode(), changed.encode(), other.encode()])
        near.append(ef.likeness(a, b))
        far.append(ef.likeness(a, c))
    assert statistics.median(near) > 0.6 and statistics.quantiles(near, n=10)[0] > max(far)


def test_likeness_falls_with_distance():
    rng = random.Random(4)
    t = "".join(rng.choice("abcdefghijklmnop ") for _ in range(4000))
    said = []
    for edits in (1, 20, 100, 500):
        s = list(t)
        for _ in range(edits):
            s[rng.randrange(len(s))] = rng.choice(["", "q", "rs"])
        a, b = ef.fingerprints([t.encode(), "".join(s).encode()])
        said.append(ef.likeness(a, b))
    assert said[0] > said[1] > max(said[2:]) and said[0] > 0.8 and said[3] < 0.5


def test_edit_distance():
    def plain(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            row, old = [i], row
            for j, y in enumerate(b, 1):
                row.append(min(row[-1] + 1, old[j] + 1, old[j - 1] + (x != y)))
        return row[-1]

    rng = random.Random(5)
    for _ in range(300):
        a, b = ("".join(rng.choice("abc") for _ in range(rng.randrange(90))) for _ in range(2))
        assert ef.edit_distance(a, b) == plain(a, b)


def test_near_pairs(spark):
    rng = random.Random(6)
    rows, wanted = [], set()
    for k in range(25):
        t = " ".join(fx.words(rng, 150, 3000))
        rows += [(2 * k, t), (2 * k + 1, t[:200] + "!" + t[201:])]
        wanted.add((2 * k, 2 * k + 1))
    rows += [(100, rows[0][1]), (101, None), (102, "")]
    got = {(r.a, r.b): r for r in ef.near_pairs(documents(fx.table(spark, rows))).collect()}
    assert len(wanted & set(got)) > 0.7 * len(wanted)
    text = dict(rows)
    for (a, b), r in got.items():
        x, y = text[a] or "", text[b] or ""
        assert r.edit_similarity == pytest.approx(1 - ef.edit_distance(x, y) / max(len(x), len(y), 1)) and r.edit_similarity >= 0.8


def test_near_pairs_recall(spark):
    """Nine tenths of the pairs that brute force finds, at 1 to 20 % edits of characters or words."""
    rng = random.Random(12)
    vocabulary = ["".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(rng.randrange(2, 10))) for _ in range(2000)]
    rows, wanted = [], {}
    for share in (0.01, 0.05, 0.1, 0.15, 0.2):
        for kind in ("characters", "words"):
            for n in [15] * 10 + [120] * 15:
                t = [rng.choice(vocabulary) for _ in range(n)]
                t = t if kind == "words" else list(" ".join(t))
                u = list(t)
                for i in rng.sample(range(len(t)), round(share * len(t))):
                    u[i] = rng.choice(vocabulary) if kind == "words" else rng.choice(["", "q", "rs", t[i] + "x"])
                x, y = ((" " if kind == "words" else "").join(s) for s in (t, u))
                k = len(rows)
                rows += [(k, x), (k + 1, y)]
                if x != y and 1 - ef.edit_distance(x, y) / max(len(x), len(y)) >= 0.8:
                    wanted.setdefault((share, kind), set()).add((k, k + 1))
    got = {(r.a, r.b) for r in ef.near_pairs(documents(fx.table(spark, rows))).collect()}
    assert len(wanted) == 10 and all(len(w & got) >= 0.9 * len(w) for w in wanted.values())


def test_near_pairs_of_a_shared_template(spark):
    """Texts that meet only in buckets of a long common passage, which many strangers have too."""
    rng = random.Random(13)
    letters = "abcdefghijklmnopqrstuvwxyz"
    passage = "".join(rng.choice(letters) for _ in range(60))
    rows = [(k, passage + "".join(rng.choice(letters) for _ in range(240))) for k in range(30)]

    def spread(t):
        """The passage left as it is, every sixth character of the rest changed."""
        return t[:60] + "".join("#" if k % 6 == 0 else c for k, c in enumerate(t[60:]))

    rows += [(100 + k, spread(rows[k][1])) for k in range(30)]
    # two texts of one doc_id; the greater has the near copy
    own = sorted("".join(rng.choice(letters) for _ in range(300)) for _ in range(2))
    rows += [(200, own[0]), (200, own[1]), (201, own[1][:150] + "#" + own[1][151:])]
    got = {(r.a, r.b) for r in ef.near_pairs(documents(fx.table(spark, rows))).collect()}
    assert got == {(k, 100 + k) for k in range(30)} | {(200, 201)}
