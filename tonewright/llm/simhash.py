"""SimHash fingerprints and their links under a Hamming radius of two.

Segment-popcount embedding: the fingerprint is cut into segments of two bits, and a segment's
popcount (0, 1, 2) is written in unary, in the same two bits. The Manhattan distance of two
popcount vectors is then the popcount of the XOR of their embeddings, and never more than the
Hamming distance of the fingerprints. The range join runs on a grid: segments are dealt to
blocks, vectors within distance ``radius`` agree in all but ``radius`` blocks, so each
fingerprint is put into one cell for every choice of ``radius`` blocks left out. Pairs of a cell
are filtered by Manhattan distance and verified by Hamming distance.

Only different fingerprints are joined; documents follow their fingerprint. A cell with more
than ``CELL`` fingerprints gives no pairs: its fingerprints are laid out with all their one-bit
neighbours, and those that share a point (at most 65 do) are linked in a star. Two fingerprints
within distance two always share a point, and those that share one are within distance two: no
link's ends are parted.

Null and wordless texts have fingerprint zero, which links like any other. Fewer words than a
shingle has make one shingle. Repeated rows share a fingerprint. A null doc_id never names a
component unless all its members' are null.
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Callable, Iterator
from functools import lru_cache, partial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tonewright.llm.common import arrow_map, bucketed, forget, raw, saved, slices
from tonewright.llm.graph import components

SEED = 42
RADIUS = 2
CELL = 32
EVEN = 0x5555555555555555


def shingle_hashes(text: bytes, words: int) -> np.ndarray:
    """XXH64 of every shingle of the lower-cased (A-Z) text, repeats included."""
    import xxhash

    w = text.lower().split()
    if not w:
        return np.zeros(0, np.uint64)
    grams = map(b" ".join, zip(*(w[i:] for i in range(words)), strict=False)) if len(w) > words else [b" ".join(w)]
    return np.fromiter(map(partial(xxhash.xxh64_intdigest, seed=SEED), grams), np.uint64)


def fingerprint(hashes: np.ndarray) -> int:
    """The majority of each bit, unsigned; zero for no hashes."""
    if not len(hashes):
        return 0
    count = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 65_536):  # a very long text takes bounded memory
        part = hashes[at : at + 65_536].astype(">u8").view(np.uint8).reshape(-1, 8)
        count += np.unpackbits(part, axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * count > len(hashes)).tobytes(), "big")


def fingerprints(docs: DataFrame, words: int = 3) -> DataFrame:
    """(doc_id, fp long) of every whole text; fp holds the 64 bits as a signed number."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                fp = np.array([fingerprint(shingle_hashes(t, words)) for t in raw(part)], np.uint64)
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(fp.view(np.int64))], ["doc_id", "fp"])

    return arrow_map(docs, run, "doc_id long, fp long")


def embedded(fp: Column) -> Column:
    """Unary popcounts of the two-bit segments."""
    high = F.shiftrightunsigned(fp, 1)
    some = fp.bitwiseOR(high).bitwiseAND(F.lit(EVEN))
    both = fp.bitwiseAND(high).bitwiseAND(F.lit(EVEN))
    return some.bitwiseOR(F.shiftleft(both, 1))


def blocks_for(n: int, radius: int = RADIUS) -> int:
    """Blocks of the grid: the least number at which a fingerprint meets less than one stranger
    by chance (a random segment's popcount has 1.415 bits of collision entropy)."""
    for blocks in range(radius + 2, 17):
        if math.comb(blocks, radius) * max(n, 1) < 2 ** (1.415 * 32 * (blocks - radius) / blocks):
            return blocks
    return 16


def _masks(blocks: int, radius: int) -> list[int]:
    """Signed masks of the segments that stay, for each choice of blocks left out."""
    block = [sum(3 << (2 * s) for s in range(32) if s % blocks == b) for b in range(blocks)]
    out = []
    for gone in itertools.combinations(range(blocks), radius):
        keep = sum(m for b, m in enumerate(block) if b not in gone)
        out.append(keep - (1 << 64) if keep >> 63 else keep)
    return out


def links(nodes: DataFrame, radius: int = RADIUS, cell: int = CELL, blocks: int | None = None) -> DataFrame:
    """(a, b) links between the different values of ``nodes.fp``: all pairs within the radius
    from small cells, and stars that hold the fingerprints of large cells together."""
    if radius != 2:
        raise ValueError("stars of one-bit neighbours stand for links of radius two")
    blocks = blocks or blocks_for(nodes.count(), radius)
    keys = [F.struct(F.lit(k).alias("grid"), F.col("u").bitwiseAND(F.lit(m)).alias("cell")) for k, m in enumerate(_masks(blocks, radius))]
    cells = nodes.select("fp", embedded(F.col("fp")).alias("u")).select("fp", "u", F.inline(F.array(*keys)))
    sizes = cells.groupBy("grid", "cell").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    shared = saved(cells.join(sizes, ["grid", "cell"]), "cells")
    pairs = (
        shared.where(F.col("n") <= cell)
        .groupBy("grid", "cell")
        .agg(F.array_sort(F.collect_list(F.struct("fp", "u"))).alias("s"))
        .select(
            F.inline(
                F.expr(
                    "flatten(transform(s, (a, i) -> transform(filter(s, (b, j) -> j > i"
                    f" AND bit_count(a.u ^ b.u) <= {radius} AND bit_count(a.fp ^ b.fp) <= {radius}),"
                    " b -> struct(a.fp AS a, b.fp AS b))))"
                )
            )
        )
    )
    crowded = shared.where(F.col("n") > cell).select("fp").distinct()
    points = crowded.select("fp", F.explode(F.array(F.col("fp"), *[F.col("fp").bitwiseXOR(F.lit(_bit(i))) for i in range(64)])).alias("point"))
    stars = (
        points.groupBy("point")
        .agg(F.min("fp").alias("a"), F.collect_set("fp").alias("all"))
        .where("size(all) > 1")
        .select("a", F.explode("all").alias("b"))
        .where("a <> b")
    )
    out = saved(pairs.union(stars).distinct(), "links")
    forget(shared)
    return out


def _bit(i: int) -> int:
    return -(1 << 63) if i == 63 else 1 << i


def near_duplicates(docs: DataFrame, words: int = 3, radius: int = RADIUS) -> DataFrame:
    """(doc_id, fingerprint hex, component_id): the least doc_id that links lead to."""
    fps = saved(fingerprints(docs, words), "fingerprints")
    nodes = fps.groupBy("fp").agg(F.min("doc_id").alias("least"))
    found = links(nodes.select("fp"), radius)
    parts = components(found)
    linked = parts.select(F.col("node").alias("fp"), "component")
    named = nodes.join(linked, "fp", "left").withColumn("component", F.coalesce("component", "fp"))
    leasts = named.groupBy("component").agg(F.min("least").alias("component_id"))
    by_fp = named.join(leasts, "component").select("fp", "component_id")
    forget(found)
    # fingerprints and components stay: the result is read from them
    return fps.join(by_fp, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


#: Sub-fingerprints of a document in a similarity search, and sampled shingles of each.
GROUPS, SAMPLE = 30, 6
#: A group's pivots in each round: so many times as many as in the round before, from one on.
MORE = 8
#: Bits of a set's parities, in words of 64.
PARITY_WORDS = 8


@lru_cache
def _mixers() -> np.ndarray:
    import hashlib

    seed = hashlib.shake_256(b"shingle samples").digest(8 * GROUPS * SAMPLE)
    return np.frombuffer(seed, "<u8") | np.uint64(1)


def sub_fingerprints(hashes: np.ndarray) -> np.ndarray:
    """SimHash fingerprints of ``GROUPS`` samples, each of the ``SAMPLE`` shingles that are least
    under as many shared random orders: two documents share one with the power ``SAMPLE`` of
    their Jaccard similarity. No hashes give zeros."""
    if not len(hashes):
        return np.zeros(GROUPS, np.uint64)
    best = np.full(GROUPS * SAMPLE, ~np.uint64(0))
    who = np.zeros(GROUPS * SAMPLE, np.uint64)
    mix = _mixers()[:, None]
    for at in range(0, len(hashes), 4096):  # bounded memory for very long texts
        part = hashes[at : at + 4096]
        order = part[None, :] * mix
        order ^= order >> np.uint64(32)
        order *= np.uint64(0x9E3779B97F4A7C15)
        k = order.argmin(axis=1)
        low = order[np.arange(len(k)), k]
        less = low < best
        best[less], who[less] = low[less], part[k][less]
    who *= np.uint64(0xD6E8FEB86659FD93)
    who ^= who >> np.uint64(32)
    bits = np.unpackbits(who.astype(">u8").view(np.uint8).reshape(GROUPS, SAMPLE, 8), axis=2)
    return np.packbits(2 * bits.sum(axis=1, dtype=np.int64) > SAMPLE, axis=1).view(">u8").ravel().astype(np.uint64)


def parities(hashes: np.ndarray) -> np.ndarray:
    """For each class of 32-bit hashes whether an odd number of them is in the set. Two sets'
    parities differ in at most as many bits as they have members that the other hasn't."""
    at = (hashes * np.uint32(0x9E3779B1)) >> np.uint32(32 - (64 * PARITY_WORDS - 1).bit_length())
    odd = np.bincount(at, minlength=64 * PARITY_WORDS) & 1
    return np.packbits(odd.astype(np.uint8)).view(np.int64)


def _sketches(docs: DataFrame, words: int) -> DataFrame:
    """(doc_id, fp, whole, subs, size, parity, shingles): fingerprint, hash of the shingle set,
    sub-fingerprints, and the set's size, parities and members as sorted 32-bit hashes."""
    kinds = {"doc_id": "long", "fp": "long", "whole": "long", "subs": "array<long>", "size": "int", "parity": "array<long>", "shingles": "binary"}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                fps, wholes, subs, sizes, odd, sets = [], [], [], [], [], []
                for text in raw(part):
                    h = shingle_hashes(text, words)
                    fps.append(fingerprint(h))
                    h = np.unique(h)
                    wholes.append(int(np.bitwise_xor.reduce(h * _mixers()[0] ^ h >> np.uint64(29))) if len(h) else 0)
                    subs.append(sub_fingerprints(h).view(np.int64))
                    short = np.unique((h >> np.uint64(32)).astype(np.uint32))
                    sizes.append(len(short))
                    odd.append(parities(short))
                    sets.append(short.tobytes())
                cols = [part.column("doc_id")] + [pa.array(np.array(x, np.uint64).view(np.int64)) for x in (fps, wholes)]
                longs = pa.list_(pa.int64())
                cols += [pa.array(subs, longs), pa.array(sizes, pa.int32()), pa.array(odd, longs), pa.array(sets, pa.binary())]
                yield pa.RecordBatch.from_arrays(cols, list(kinds))

    return arrow_map(docs, run, ", ".join(f"{k} {v}" for k, v in kinds.items()))


def _heads(members: DataFrame, most: int) -> DataFrame:
    """Up to ``most`` pivots of each group: the least of each hash class under an order of the
    group's own, so partial aggregates stay of fixed size. Members are (grp, key, node, n); a
    group of at most ``most`` gives them all."""
    turn = F.xxhash64("grp", "node")
    kind = F.when(F.col("n") <= most, F.col("node")).otherwise(F.pmod(turn, F.lit(most)))
    least = members.select("grp", "key", "node", kind.alias("kind"), turn.alias("turn")).groupBy("grp", "key", "kind")
    return least.agg(F.min(F.struct("turn", "node")).alias("h")).select("grp", "key", F.col("h.node").alias("head"))


def _ordered(x: str, y: str) -> list[Column]:
    return [F.least(x, y).alias("a"), F.greatest(x, y).alias("b")]


def _may_reach(similarity: float) -> Column:
    """Whether two sets may be so similar, by their sizes and parities: never false if they are."""
    apart = sum(F.bit_count(F.get("parity", F.lit(i)).bitwiseXOR(F.get("head_parity", F.lit(i)))) for i in range(PARITY_WORDS))
    small, large = F.least("size", "head_size"), F.greatest("size", "head_size")
    share = (1 - similarity) / (1 + similarity)
    return (small >= large * F.lit(similarity - 1e-9)) & (apart <= (small + large) * F.lit(share + 1e-9))


def _linked(keyed: DataFrame, near: DataFrame, sets: DataFrame, similarity: float, verified: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """(node, component) of the nodes that candidates of (grp, key) groups, and the candidates
    ``near``, link; ``verified`` gives the pairs (a, b) that hold; ``keyed`` are (grp, key, node,
    size), ``sets`` (node, size, parity).

    In the first round each group holds one member, its head, against all others whose sizes allow
    it: as many pairs as members. Heads are least under one order of all nodes, so a document
    that meets its like in many groups mostly meets the same one. Members outside the group's
    largest component that haven't been pivots are drawn from in the next round, ``MORE`` times
    as many. A group is done when all of them have been pivots: every two members have met or are
    in one component already. From
    the second round on only members of different components are held together, and the join
    itself leaves out pairs whose sizes or parities tell that they aren't similar, so what it
    makes follows the similar pairs, not the pairs of a group. Groups of copies are done after one
    round, whatever their size.
    """
    order = F.xxhash64("node")
    tops = keyed.groupBy("grp", "key").agg(F.count(F.lit(1)).alias("n"), F.min_by("node", order).alias("head"), F.min_by("size", order).alias("head_size")).where("n > 1")
    members = saved(keyed.join(tops, ["grp", "key"]), "groups")
    fit = F.least("size", "head_size") >= F.greatest("size", "head_size") * F.lit(similarity - 1e-9)
    met = members.where((F.col("node") != F.col("head")) & fit).select(F.col("node").alias("a"), F.col("head").alias("b"))
    sure = verified(saved(met.union(near).where("a <> b").distinct(), "pairs"))
    used = [members]
    linked = components(sure)
    large, most = members.where("n > 2").select("grp", "key", "node"), 1
    heads = members.where("n > 2 AND node = head").select("grp", "key", "head")
    while True:
        most *= MORE
        placed = large.join(linked, "node", "left").withColumn("component", F.coalesce("component", "node"))
        parts = placed.groupBy("grp", "key", "component").agg(F.count(F.lit(1)).alias("of"))
        split = parts.groupBy("grp", "key").agg(F.max_by("component", F.struct("of", "component")).alias("main"), F.count(F.lit(1)).alias("parts")).where("parts > 1").drop("parts")
        placed = saved(placed.join(split, ["grp", "key"]).join(sets, "node"), "unsettled")
        outside = placed.where("component <> main").join(heads.withColumnRenamed("head", "node"), ["grp", "key", "node"], "left_anti").select("grp", "key", "node")
        left = outside.groupBy("grp", "key").agg(F.count(F.lit(1)).alias("n"))
        drawn = saved(_heads(outside.join(left, ["grp", "key"]), most), "pivots")
        used += [placed, drawn]
        if drawn.isEmpty():
            break
        known = placed.select("grp", "key", F.col("node").alias("head"), F.col("component").alias("own"), F.col("size").alias("head_size"), F.col("parity").alias("head_parity"))
        met = placed.join(drawn.join(known, ["grp", "key", "head"]), ["grp", "key"]).where((F.col("component") != F.col("own")) & _may_reach(similarity))
        more = verified(saved(met.select(*_ordered("node", "head")).distinct(), "pairs"))
        heads = heads.union(drawn)
        # where all members outside have been pivots now, every two have met
        large = placed.join(left.where(F.col("n") > most).select("grp", "key"), ["grp", "key"], "left_semi").select("grp", "key", "node")
        if not more.isEmpty():
            # what is linked already goes in as one edge a node
            sure = more.union(linked.toDF("a", "b"))
            used.append(linked)
            linked = components(sure)
    for df in used:
        forget(df)
    return linked


def similar(docs: DataFrame, words: int = 5, similarity: float = 0.8) -> DataFrame:
    """(doc_id, component_id) of every document with a doc_id, under links of a Jaccard
    similarity of shingle sets of at least ``similarity``.

    A radius of two bits reaches only copies with a few changed words in hundreds, so beside the
    links of whole fingerprints, equal sub-fingerprints make candidates; all are verified on the
    shingle sets. Documents with equal sets are one node. At a similarity of 0.8 a pair shares no
    sub-fingerprint in one of 10,000 cases; no pair that shares one is left out.

    Null and empty texts have the empty set, all alike. A very long text's set is taken in parts.
    """
    sketches = saved(_sketches(docs.where("doc_id IS NOT NULL"), words), "sketches")
    members = saved(sketches.select("doc_id", "whole"), "members")
    nodes = members.groupBy("whole").agg(F.min("doc_id").alias("least"))
    # a node is a set of shingles, named by its hash. Copies are put together before the shuffle;
    # they differ in their fingerprint at most, as that counts repeated shingles
    same = [F.first(c).alias(c) for c in ("subs", "size", "parity", "shingles")]
    firsts = sketches.groupBy(F.col("whole").alias("node")).agg(F.min("fp").alias("fp"), *same)
    firsts = bucketed(firsts, "nodes", "node")
    forget(sketches)
    close = links(firsts.select("fp").distinct())
    by_fp = firsts.groupBy("fp").agg(F.min("node").alias("node"))
    near = close.join(by_fp.toDF("a", "na"), "a").join(by_fp.toDF("b", "nb"), "b").select(*_ordered("na", "nb"))
    keyed = firsts.select("node", "size", F.posexplode("subs").alias("grp", "key")).union(firsts.select("node", "size", F.lit(-1).alias("grp"), F.col("fp").alias("key")))
    keyed = keyed.select("node", "size", F.col("grp").cast("long").alias("grp"), "key")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sure = []
            for x, y in zip(batch.column("sa").to_pylist(), batch.column("sb").to_pylist(), strict=True):
                x, y = np.frombuffer(x, np.uint32), np.frombuffer(y, np.uint32)
                both = len(np.intersect1d(x, y, assume_unique=True))
                sure.append(both >= similarity * (len(x) + len(y) - both))
            yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b")], ["a", "b"]).filter(pa.array(sure, pa.bool_()))

    sets = firsts.select("node", "shingles")
    found = []

    def verified(pairs: DataFrame) -> DataFrame:
        # sets lie in buckets by node and stay there; a head may be in a third of all pairs, so the
        # heads' sets, few, are dealt anew, and Spark splits the join where it is skewed
        heads = sets.join(pairs.select(F.col("b").alias("node")).distinct(), "node")
        both = pairs.join(sets.toDF("a", "sa"), "a").join(heads.toDF("b", "sb"), "b")
        found.append(saved(arrow_map(both, run, "a long, b long"), "links"))
        forget(pairs)
        return found[-1]

    linked = _linked(keyed, near, firsts.select("node", "size", "parity"), similarity, verified)
    named = nodes.join(linked.withColumnRenamed("node", "whole"), "whole", "left").withColumn("component", F.coalesce("component", "whole"))
    leasts = named.groupBy("component").agg(F.min("least").alias("component_id"))
    by_whole = named.join(leasts, "component").select("whole", "component_id")
    out = saved(members.join(by_whole, "whole").select("doc_id", "component_id"), "similar")
    for df in (firsts, members, linked, *found):
        forget(df)
    return out


def keep_one(docs: DataFrame, words: int = 5, similarity: float = 0.8) -> DataFrame:
    """The rows of ``docs`` of which each group of similar documents keeps its least doc_id.

    Rows of one doc_id stand or fall together, by the first of their groups; rows without a
    doc_id stay.
    """
    keyed = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    gone = similar(keyed, words, similarity).groupBy("doc_id").agg(F.min("component_id").alias("c")).where("doc_id <> c").select("doc_id")
    return docs.join(gone, "doc_id", "left_anti").select(*docs.columns)
