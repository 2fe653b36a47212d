"""Document fingerprints by a randomised edit embedding.

Shared random walks: at time t a walk over a text stands on one character and writes it; one
shared random bit for (class of character, t) says if it moves on. Texts at a small edit distance
fall back into step after each edit, so their written strings differ in few places: edit distance
turns into Hamming distance. A character is held until its next one-bit, so a walk costs one
table look-up per character; the bits repeat after ``PERIOD`` steps.

The written string has about two places for each character and no fixed length. Each of ``SLOTS``
sampled places is the last record of its own random sequence below the walk's end: two walks that
end at times S < T sample the same place in a slot with probability S / T, whatever their length.
A slot keeps eight bits hashed from the place and the character there; the fingerprint is the
slots in hexadecimal, and likeness the share of equal slots, which estimates the share of equal
places of the longer string.

Search (``near_pairs``) is by bit-sampled banding and verification: a band is ``BAND_BITS`` bits of
the fingerprint drawn at random, texts with an equal band are candidates, and these are verified by
exact edit distance. Edits at a tenth of the places already part most walks, so bands alone find
few of the pairs at the threshold; grams of characters, as long as a run that edits at the
threshold's rate leaves untouched, are buckets beside the bands.

Null is the empty text: its slots are zero, alike to empty texts only. Equal texts have equal
fingerprints, so repeated rows are alike. Rows are ordered by doc_id, nulls first, then by text; a
table's last row is followed by its first, also if that is the same. An empty table gives no rows.
A very long text is walked whole; its code points and its steps' times are in memory at once, about
twelve bytes a character. Other columns are not looked at.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tonewright.llm.common import SLICE_BYTES, arrow_map, documents, parts_for, range_bounds, range_of, raw, saved, slices
from tonewright.llm.simhash import PARITY_WORDS, _linked as linked_groups
from tonewright.llm.substring_index import rolled

SLOTS = 128
PERIOD = 4096
CLASSES = 64
#: Below so many texts still walking, each is walked by itself.
FEW = 48
#: Untouched runs as long as a gram that a pair at the threshold has, as expected of random edits.
RUNS = 6
#: Bands of a fingerprint, and sampled bits of each.
BANDS, BAND_BITS = 24, 48
_A, _B = 0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93


def _holds() -> np.ndarray:
    """For each class and time: how long a character that comes on then is held."""
    bits = np.unpackbits(np.frombuffer(hashlib.shake_256(b"edit walk").digest(CLASSES * PERIOD // 8), np.uint8)).reshape(CLASSES, PERIOD)
    out = np.zeros((CLASSES, PERIOD), np.uint8)
    nxt = np.full(CLASSES, PERIOD, np.int64)
    for t in range(2 * PERIOD - 1, -1, -1):
        k = t % PERIOD
        nxt = np.where(bits[:, k] == 1, 1, np.minimum(nxt + 1, 200))
        out[:, k] = nxt
    return out


HOLDS = _holds().reshape(-1)
_HOLD_BYTES = HOLDS.tobytes()


def points(text: bytes) -> np.ndarray:
    """Code points of a text."""
    return np.frombuffer(text.decode().encode("utf-32-le"), "<u4")


def _rows_of(cp: np.ndarray) -> np.ndarray:
    """Where the character's class begins in the table."""
    return (((cp * np.uint32(0x9E3779B1)) >> np.uint32(26)) * np.uint32(PERIOD)).astype(np.int32)


def walk(texts: list[np.ndarray], begin: np.ndarray) -> list[np.ndarray]:
    """For each text (code points) the times at which its characters come on, and its end."""
    out = [np.empty(len(t) + 1, np.int64) for t in texts]
    order = sorted(range(len(texts)), key=lambda i: -len(texts[i]))
    rows = [_rows_of(texts[i]) for i in order]
    lengths = np.array([len(r) for r in rows], np.int64)
    now = np.array([begin[i] for i in order], np.int64)
    steps = int(lengths[FEW - 1]) if len(order) >= FEW else 0
    if steps:
        # time-major: the k-th characters of all texts that have one lie together
        alive = np.searchsorted(-lengths, -np.arange(steps), side="left")
        first = np.concatenate([[0], np.cumsum(alive)])
        flat = np.empty(int(first[-1]), np.int32)
        for r, row in enumerate(rows):
            m = min(len(row), steps)
            flat[first[:m] + r] = row[:m]
        times = np.empty(len(flat), np.int64)
        mask = PERIOD - 1
        for k in range(steps):
            a, b = first[k], first[k + 1]
            t = now[: b - a]
            times[a:b] = t
            t += HOLDS.take(flat[a:b] + (t & mask))
        for r, i in enumerate(order):
            m = min(len(rows[r]), steps)
            out[i][:m] = times[first[:m] + r]
    for r, i in enumerate(order):
        m, t = min(len(rows[r]), steps), int(now[r])
        rest = []
        for x in rows[r][m:].tolist():
            rest.append(t)
            t += _HOLD_BYTES[x + (t & (PERIOD - 1))]
        rest.append(t)
        out[i][m:] = rest
    return out


def _uniform(*parts: int) -> float:
    h = hashlib.blake2b(b",".join(b"%d" % p for p in parts), digest_size=8).digest()
    return (int.from_bytes(h, "big") + 1) / 2**64


class Places:
    """Record sequences of the slots, drawn as far as they have been needed."""

    def __init__(self, slots: int = SLOTS):
        self.records: list[list[int]] = [[0] for _ in range(slots)]
        self.arrays = [np.zeros(1, np.int64)] * slots
        self.upto = 0

    def below(self, ends: np.ndarray) -> np.ndarray:
        """For each walk's end (at least 1) and slot the sampled place."""
        most = int(ends.max(initial=1))
        if most > self.upto:
            for k, rec in enumerate(self.records):
                while rec[-1] < most:  # the next place whose draw is lower than all before
                    rec.append(max(rec[-1] + 1, int((rec[-1] + 1) / _uniform(k, rec[-1]))))
                self.arrays[k] = np.array(rec, np.int64)
            self.upto = most
        return np.stack([a[np.searchsorted(a, ends, side="left") - 1] for a in self.arrays], axis=1)


_places = Places()


def _symbols(place: np.ndarray, cp: np.ndarray) -> np.ndarray:
    """One to 255 from a slot's place and the character there."""
    x = place.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + cp.astype(np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F)
    x += np.arange(place.shape[-1], dtype=np.uint64) * np.uint64(0x165667B19E3779F9)
    x ^= x >> np.uint64(31)
    x *= np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(32)
    return (x % np.uint64(255) + np.uint64(1)).astype(np.uint8)


def _sample(times: list[np.ndarray], texts: list[np.ndarray]) -> np.ndarray:
    """Slots of walked texts; rows of zeros for empty ones."""
    ends = np.array([t[-1] for t in times], np.int64)
    place = _places.below(np.maximum(ends, 1))
    out = np.zeros(place.shape, np.uint8)
    for i, (t, cp) in enumerate(zip(times, texts, strict=True)):
        if len(cp):
            at = np.searchsorted(t, place[i], side="right") - 1
            out[i] = _symbols(place[i], cp[at])
    return out


def fingerprints(texts: list[bytes]) -> list[str]:
    cps = [points(t) for t in texts]
    return [f.tobytes().hex() for f in _sample(walk(cps, np.zeros(len(cps), np.int64)), cps)] if texts else []


def likeness(a: str, b: str) -> float:
    """Share of equal slots of two fingerprints."""
    x, y = np.frombuffer(bytes.fromhex(a), np.uint8), np.frombuffer(bytes.fromhex(b), np.uint8)
    return float((x == y).mean())


def chain(texts: list[bytes]) -> list[tuple]:
    """For each text but the last, against the next one: n_chars, sha256 of the edited text,
    fingerprint, the edited text's, likeness to that and to the next text's."""
    cps = [points(t) for t in texts]
    times = walk(cps, np.zeros(len(cps), np.int64))
    own = _sample(times, cps)
    keep = [len(c) - len(c) // 4 for c in cps[:-1]]
    # the edited text walks the kept part in the same steps: only its end is walked anew
    ends = [nxt[: len(c) // 4] for c, nxt in zip(cps, cps[1:], strict=False)]
    walked = walk(ends, np.array([t[k] for t, k in zip(times, keep, strict=False)], np.int64)) if keep else []
    edited = [np.concatenate([c[:k], e]) for c, k, e in zip(cps, keep, ends, strict=False)]
    made = _sample([np.concatenate([t[:k], w]) for t, k, w in zip(times, keep, walked, strict=False)], edited) if keep else own[:0]
    return [
        (len(cps[i]), hashlib.sha256(edited[i].astype("<u4").tobytes().decode("utf-32-le").encode()).hexdigest(),
         own[i].tobytes().hex(), made[i].tobytes().hex(), float((own[i] == made[i]).mean()), float((own[i] == own[i + 1]).mean()))
        for i in range(len(keep))
    ]


def _followed(docs: DataFrame) -> DataFrame:
    """Rows by ranges of doc_id, in order, each range ending with the row that comes next.

    Only the least doc_id of each range, one number each, passes through the driver.
    """
    spark = docs.sparkSession
    bounds = range_bounds(docs.select("doc_id"), "doc_id", parts_for(spark))
    dealt = docs.withColumn("range", range_of("doc_id", bounds)).withColumn("guest", F.lit(False))
    least = dealt.select("doc_id", "range").groupBy("range").agg(F.min("doc_id").alias("doc_id"), F.count_if(F.col("doc_id").isNull()).alias("nulls"))
    found = sorted(tuple(r) for r in least.collect())
    if not found:
        return dealt
    after = {(None if nulls else first): before for (before, _, _), (_, first, nulls) in zip([found[-1], *found], found, strict=False)}
    first = docs.where(F.col("doc_id").isin([i for i in after if i is not None])).groupBy("doc_id").agg(F.min("text").alias("text"))
    if None in after:
        first = first.union(docs.where("doc_id IS NULL").groupBy("doc_id").agg(F.min("text").alias("text")))
    to = F.lit(after.get(None)).cast("int")
    if ids := [i for i in after if i is not None]:
        to = F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for i in ids for x in (i, after[i])]), F.col("doc_id")), to)
    guests = first.select("doc_id", "text", to.cast("int").alias("range"), F.lit(True).alias("guest"))
    return dealt.union(guests).repartitionById(len(bounds) + 1, F.col("range")).sortWithinPartitions("range", "guest", "doc_id", "text")


_COLUMNS = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def edited_likeness(docs: DataFrame) -> DataFrame:
    """(doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[int | None, bytes]] = []
        size = 0
        at = None

        def flush() -> pa.RecordBatch:
            rows = chain([t for _, t in held])
            cols = [pa.array([d for d, _ in held[:-1]], pa.int64())]
            kinds = (pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64())
            cols += [pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)]
            return pa.RecordBatch.from_arrays(cols, [c.split()[0] for c in _COLUMNS.split(", ")])

        for batch in batches:
            for part in slices(batch):
                cols = [part.column(c).to_pylist() for c in ("range", "guest", "doc_id")]
                for r, guest, doc, text in zip(*cols, raw(part), strict=True):
                    if r != at:
                        held, size, at = [], 0, r
                    held.append((doc, text))
                    size += len(text)
                    if len(held) > 1 and (guest or size > SLICE_BYTES):
                        yield flush()
                        held, size = ([] if guest else held[-1:]), len(text)

    return arrow_map(_followed(documents(docs)), run, _COLUMNS)


def fingerprint_documents(docs: DataFrame) -> DataFrame:
    """(doc_id, text_key, fingerprint) of every whole text; equal texts have equal keys. No shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                texts = raw(part)
                keys = [hashlib.blake2b(t, digest_size=16).hexdigest() for t in texts]
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(keys, pa.string()), pa.array(fingerprints(texts), pa.string())], ["doc_id", "text_key", "fingerprint"])

    return arrow_map(documents(docs), run, "doc_id long, text_key string, fingerprint string")


def edit_distance(a: str, b: str) -> int:
    """Exact Levenshtein distance; one column of the table lies in the bits of an integer."""
    if len(a) > len(b):
        a, b = b, a
    m = len(a)
    if not m:
        return len(b)
    full, top = (1 << m) - 1, m - 1
    where: dict[str, int] = {}
    for i, c in enumerate(a):
        where[c] = where.get(c, 0) | 1 << i
    up, down, score = full, 0, m
    for c in b:
        eq = where.get(c, 0)
        diagonal = (((eq & up) + up) ^ up) | eq | down
        right_up = down | (full & ~(diagonal | up))
        right_down = up & diagonal
        score += (right_up >> top & 1) - (right_down >> top & 1)
        right_up = (right_up << 1 | 1) & full
        right_down = right_down << 1 & full
        up = right_down | (full & ~(diagonal | right_up))
        down = right_up & diagonal
    return score


def gram_sizes(n: float, least: float) -> tuple[int, int]:
    """Length of grams, and of windows of grams, for texts of at least ``n`` characters.

    A window covers a run that some pair at the threshold has wherever its edits are, or a longer
    one of which random edits leave ``RUNS``.
    """
    edits = n * (1 - least)
    run = max(1, int(n * least / (edits + 1)), int(math.log(max(edits / RUNS, 1)) / -math.log(least)))
    window = max(1, min(4, run // 4))
    return run - window + 1, window


def anchors(text: bytes, least: float) -> np.ndarray:
    """Keys of a text: of every window of grams the least hash, for its class of length and the
    next. Texts whose lengths don't rule the threshold out share a class."""
    cp = points(text).astype(np.uint64)
    if not len(cp):
        return np.zeros(0, np.int64)
    own = int(math.log(len(cp)) / -math.log(least) + 1e-9)
    out = []
    for k in (own, own + 1):
        gram, window = gram_sizes(max(1.0, least ** (1 - k)), least)
        g = rolled(cp, gram, _A)
        m = len(g) - window + 1
        if m <= 0:
            continue
        low = g[:m].copy()
        for j in range(1, window):
            np.minimum(low, g[j : m + j], out=low)
        out.append(np.unique(low) * np.uint64(_B) + np.uint64(k))
    return np.concatenate(out).view(np.int64) if out else np.zeros(0, np.int64)


def _whole_texts(docs: DataFrame) -> DataFrame:
    """(node, doc_id, fingerprint, text) of each different text, by its least doc_id."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                texts = raw(part)
                nodes = [int.from_bytes(hashlib.blake2b(t, digest_size=8).digest(), "big", signed=True) for t in texts]
                yield pa.RecordBatch.from_arrays([pa.array(nodes, pa.int64()), part.column("doc_id"), pa.array(fingerprints(texts), pa.string()), part.column("text")], ["node", "doc_id", "fingerprint", "text"])

    made = arrow_map(documents(docs).where("doc_id IS NOT NULL"), run, "node long, doc_id long, fingerprint string, text string")
    return made.groupBy("node").agg(F.min("doc_id").alias("doc_id"), F.min("fingerprint").alias("fingerprint"), F.min("text").alias("text"))


def _anchored(texts: DataFrame, least: float) -> DataFrame:
    """(key, node) of all texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                found = [anchors(t, least) for t in raw(part)]
                nodes = np.repeat(part.column("node").to_numpy(), [len(f) for f in found])
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(found)), pa.array(nodes, pa.int64())], ["key", "node"])

    return arrow_map(texts.select("node", "text"), run, "key long, node long")


def _sampled_bits() -> np.ndarray:
    """The bits of each band: places in the fingerprint, in the order of a shared random draw."""
    out = []
    for band in range(BANDS):
        seed = np.frombuffer(hashlib.shake_256(b"band %d" % band).digest(32 * SLOTS), "<u4")
        out.append(np.argsort(seed[: 8 * SLOTS], kind="stable")[:BAND_BITS])
    return np.array(out)


def bands(fingerprints: list[str]) -> np.ndarray:
    """For each fingerprint its bands, each a number."""
    if not fingerprints:
        return np.zeros((0, BANDS), np.int64)
    bits = np.unpackbits(np.frombuffer(bytes.fromhex("".join(fingerprints)), np.uint8).reshape(len(fingerprints), SLOTS), axis=1)
    return bits[:, _sampled_bits()].astype(np.int64) @ (np.int64(1) << np.arange(BAND_BITS, dtype=np.int64))


def _banded(texts: DataFrame) -> DataFrame:
    """(node, size, grp, key) of the bands of all texts but the empty one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = bands(batch.column("fingerprint").to_pylist())
            n = batch.num_rows
            cols = [pa.array(np.repeat(batch.column("node").to_numpy(), BANDS)), pa.array(np.repeat(batch.column("size").to_numpy(), BANDS))]
            yield pa.RecordBatch.from_arrays([*cols, pa.array(np.tile(np.arange(1, BANDS + 1), n)), pa.array(keys.ravel())], ["node", "size", "grp", "key"])

    small = texts.select("node", F.char_length("text").alias("size"), "fingerprint").where("size > 0")
    return arrow_map(small, run, "node long, size int, grp long, key long")


def may_reach(a: str, b: str, least: float) -> bool:
    """False only if the grams of three or of four characters that two texts share are too few."""
    x, y = (points(t.encode()).astype(np.uint64) for t in (a, b))
    longer = max(len(x), len(y))
    for q in (3, 4):
        (u, n), (v, m) = (np.unique(rolled(t, q, _A), return_counts=True) for t in (x, y))
        _, i, j = np.intersect1d(u, v, assume_unique=True, return_indices=True)
        if longer - q + 1 - int(np.minimum(n[i], m[j]).sum()) > q * (1 - least) * longer + 1e-6:
            return False
    return True


def _verified(pairs: DataFrame, texts: DataFrame, least: float) -> DataFrame:
    """Of pairs (a, b) of nodes those whose edit similarity is ``least`` or more, with that and likeness."""
    sides = [texts.select(F.col("node").alias(k), F.col("fingerprint").alias(f"f{k}"), F.col("text").alias(f"t{k}")) for k in "ab"]
    both = pairs.join(sides[0], "a").join(sides[1], "b")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "ta"):
                alike, near, sure = [], [], []
                for x, y, f, g in zip(*(part.column(c).to_pylist() for c in ("ta", "tb", "fa", "fb")), strict=True):
                    longer = max(len(x), len(y), 1)
                    alike.append(likeness(f, g))
                    near.append(1 - edit_distance(x, y) / longer if min(len(x), len(y)) >= least * longer - 1e-6 and may_reach(x, y, least) else -1.0)
                    sure.append(near[-1] >= least)
                cols = [part.column("a"), part.column("b"), pa.array(alike, pa.float64()), pa.array(near, pa.float64())]
                yield pa.RecordBatch.from_arrays(cols, ["a", "b", "likeness", "edit_similarity"]).filter(pa.array(sure, pa.bool_()))

    return arrow_map(both, run, "a long, b long, likeness double, edit_similarity double")


def near_pairs(docs: DataFrame, least: float = 0.8) -> DataFrame:
    """(a, b, likeness, edit_similarity) between representatives of equal texts.

    A representative is the least doc_id of its text; texts of one doc_id are told apart. In each
    bucket pivots are held against all members, and members that no verified link ties to the
    bucket's largest component against further pivots, round by round, until every two have met
    or are tied: no link between different texts is lost to what else is in its bucket, and a
    group of near copies gives as many pairs as it has members, not their square.
    ``edit_similarity`` is 1 - distance / longer length, and at least ``least``.

    Buckets are the fingerprints' bands, and grams. Edits that are spread evenly on purpose can leave only shorter runs than
    a gram has; of random ones at the threshold's rate a few in a thousand do.
    """
    if not 0 < least < 1:
        raise ValueError("least is between 0 and 1")
    texts = saved(_whole_texts(docs), "texts")
    sizes = texts.select("node", F.char_length("text").alias("size"))
    anchored = _anchored(texts, least).join(sizes, "node").select("node", "size", F.lit(0).cast("long").alias("grp"), "key")
    keyed = saved(anchored.union(_banded(texts)), "anchors")
    # lengths rule pairs out; there are no parities
    sets = texts.select("node", F.char_length("text").alias("size"), F.array_repeat(F.lit(0).cast("long"), PARITY_WORDS).alias("parity"))
    sure: list[DataFrame] = []

    def verified(pairs: DataFrame) -> DataFrame:
        sure.append(saved(_verified(pairs, texts, least), "links"))
        return sure[-1].select("a", "b")

    linked_groups(keyed, keyed.select(F.col("node").alias("a"), F.col("node").alias("b")).limit(0), sets, least, verified)
    return _named(reduce(DataFrame.union, sure).distinct(), texts)


def _named(sure: DataFrame, texts: DataFrame) -> DataFrame:
    """Links between nodes as links between their doc_ids; of several between two doc_ids the nearest."""
    ids = texts.select("node", "doc_id")
    both = sure.join(ids.toDF("a", "da"), "a").join(ids.toDF("b", "db"), "b").where("da <> db")
    near = both.groupBy(F.least("da", "db").alias("a"), F.greatest("da", "db").alias("b"))
    return near.agg(F.max(F.struct("edit_similarity", "likeness")).alias("x")).select("a", "b", "x.likeness", "x.edit_similarity")
