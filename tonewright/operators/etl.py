"""Relational steps of the dictionary build: merge, cross-check, enrich, count."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tonewright.functions import romanize
from tonewright.functions import text as tx
from tonewright.model import READINGS, WORDS


def settled(df: DataFrame) -> DataFrame:
    """The same rows, whose columns are computed once: no later use computes them again, and no
    filter on them goes below."""
    return df.select(F.inline(F.array(F.struct(*df.columns))))


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """The rows dealt over all tasks by keys. A small file is read by one task, which would also do
    all that its rows ask for."""
    return settled(df.repartition(3 * df.sparkSession.sparkContext.defaultParallelism, *keys))


def merge_sources(*sources: DataFrame) -> DataFrame:
    """The union of readings tables, each after those before it (column ``source_ord``)."""
    out = None
    for k, s in enumerate(sources):
        part = s.select(*READINGS.names).withColumn("source_ord", F.lit(k))
        out = part if out is None else out.unionByName(part)
    return out


def upsert(readings: DataFrame) -> DataFrame:
    """One row per (system, code point, normalized): the first display, the greatest frequency,
    all sources; readings of a code point are numbered in the order of their first coming."""
    if "source_ord" not in readings.columns:
        readings = readings.withColumn("source_ord", F.lit(0))
    turn = F.struct("source_ord", "ord", "normalized")
    one = readings.groupBy("system", "cp", "normalized").agg(
        F.min(turn).alias("turn"),
        F.min_by("display", turn).alias("display"),
        F.min_by("syllable", turn).alias("syllable"),
        F.min_by("tone", turn).alias("tone"),
        F.max("freq").alias("freq"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_list("sources")))).alias("sources"),
    )
    place = F.row_number().over(Window.partitionBy("system", "cp").orderBy("turn")) - 1
    return one.withColumn("ord", place.cast("int")).select(*READINGS.names)


def cross_check(a: DataFrame, b: DataFrame, samples: int = 100) -> tuple[DataFrame, DataFrame]:
    """Two (cp, readings) tables on the code points they share: a row of counts and the rate of
    those whose readings are disjoint, and up to ``samples`` such rows, by code point."""
    both = a.toDF("cp", "left").join(b.toDF("cp", "right"), "cp").withColumn("differs", ~F.arrays_overlap("left", "right"))
    rate = F.when(F.count(F.lit(1)) > 0, F.count_if("differs") / F.count(F.lit(1))).otherwise(0.0)
    report = both.agg(F.count(F.lit(1)).alias("compared"), F.count_if("differs").alias("disagreements"), rate.alias("rate"))
    return report, both.where("differs").drop("differs").orderBy("cp").limit(samples)


def reading_sets(readings: DataFrame, system: str) -> DataFrame:
    """(cp, readings) of a system, as sorted sets of normalized readings."""
    return readings.where(F.col("system") == system).groupBy("cp").agg(F.array_sort(F.collect_set("normalized")).alias("readings"))


def supplement(readings: DataFrame, more: DataFrame, system: str = "mandarin", source: str = "supplement") -> DataFrame:
    """Readings of ``more`` (cp, display with marks) added where a code point has some already."""
    known = readings.where(F.col("system") == system).select("cp").distinct()
    n = romanize.to_numeric(F.col("display"))
    rows = more.join(known, "cp", "left_semi").withColumn("n", n).where("n.syllable <> ''")
    extra = rows.select(
        F.lit(system).alias("system"), "cp", F.lit(1 << 20).alias("ord"), "display", F.col("n.numeric").alias("normalized"),
        F.col("n.syllable").alias("syllable"), F.col("n.tone").alias("tone"), F.lit(0).cast("long").alias("freq"), F.array(F.lit(source)).alias("sources"),
    )
    return upsert(merge_sources(readings, extra))


def derive_zhuyin(readings: DataFrame, bopomofo: DataFrame, source: str = "supplement") -> DataFrame:
    """Zhuyin readings, from a (cp, ord, display) table, of code points with Mandarin ones."""
    known = readings.where("system = 'mandarin'").select("cp").distinct()
    d = F.col("display")
    from tonewright.model import ToneConvention

    rows = bopomofo.where("display <> ''").join(known, "cp", "left_semi").select(
        F.lit("zhuyin").alias("system"), "cp", "ord", "display", d.alias("normalized"), tx.strip_tone(d, ToneConvention.ZHUYIN).alias("syllable"),
        tx.zhuyin_tone(d).alias("tone"), F.lit(0).cast("long").alias("freq"), F.array(F.lit(source)).alias("sources"),
    )
    return upsert(merge_sources(readings, rows))


def first_words(words: DataFrame) -> DataFrame:
    """Words without repeats of (system, code points, text): the first source's row stays, by the
    source's name, then its readings."""
    row = F.struct("source", *[c for c in words.columns if c != "source"])
    return words.groupBy("system", "cps", "text").agg(F.min(row).alias("row")).select(*[F.col("row")[c].alias(c) for c in words.columns])


def rebuilt_korean(chars: list[DataFrame], words: list[DataFrame]) -> tuple[DataFrame, DataFrame]:
    """The Korean tables anew: (readings, words).

    Readings are the union of the sources, in their order, one row for each reading of a code
    point. Words are told apart by code points and sound; of equal ones the first source's stays,
    and words of a single character go.
    """
    readings = upsert(merge_sources(*chars))
    turned = [w.select(*WORDS.names).withColumn("turn", F.lit(k)) for k, w in enumerate(words)]
    every = reduce(DataFrame.unionByName, turned).where("system = 'korean' AND size(cps) >= 2")
    row = F.struct("turn", "source", "readings")
    one = every.groupBy("system", "cps", "text").agg(F.min(row).alias("row"))
    return readings, one.select("system", "cps", "text", "row.readings", "row.source")


def inverted_index(pairs: DataFrame, key: str = "key", surface: str = "surface") -> DataFrame:
    """(surface, keys): sorted different keys of each surface."""
    return pairs.groupBy(surface).agg(F.array_sort(F.collect_set(key)).alias("keys"))


def capped(keys: Column, source: Column, cap: int = 24) -> Column:
    """struct(expected, total): sorted different keys with the source first, ``cap`` at most."""
    own = F.array_sort(F.array_distinct(keys))
    first = F.when(F.array_contains(own, source), F.concat(F.array(source), F.array_remove(own, source))).otherwise(own)
    return F.struct(F.slice(first, 1, cap).alias("expected"), F.size(own).alias("total"))


#: Different keys of a surface that are handed out.
CAP = 24
#: Keys of a surface above which its rows are joined where they lie instead of meeting in one task.
HOT_KEYS = 10_000


def first_keys(pairs: DataFrame, key: str = "key", surface: str = "surface", cap: int = CAP) -> DataFrame:
    """(surface, keys, total): the ``cap`` smallest different keys of each surface, sorted, and the
    number of all. No array ever holds more, however many keys share a surface."""
    one = pairs.select(surface, key).distinct()
    place = F.row_number().over(Window.partitionBy(surface).orderBy(F.asc_nulls_last(key)))
    first = one.withColumn("place", place).where(F.col("place") <= cap).groupBy(surface).agg(F.array_sort(F.collect_list(key)).alias("keys"))
    return first.join(one.groupBy(surface).agg(F.count(key).alias("total")), surface)


def with_first_keys(rows: DataFrame, index: DataFrame, surface: str, source: str, cap: int = CAP) -> DataFrame:
    """Rows with expected, the first ``cap`` keys of their surface after their own, and expectedTotal.

    ``index`` (surface, key) must hold every row's own key. Surfaces with more than ``HOT_KEYS``
    keys are sent to every task: there is at most one to as many rows.
    """
    firsts = first_keys(index, "key", surface, cap)
    found = F.struct("keys", "total")
    hot = firsts.where(F.col("total") > HOT_KEYS).select(surface, found.alias("hot"))
    cold = firsts.where(F.col("total") <= HOT_KEYS).select(F.col(surface).alias("at"), found.alias("cold"))
    # rows of hot surfaces have keys of their own, which no surface has
    at = F.when(F.col("hot").isNull(), F.col(surface)).otherwise(F.concat(F.lit("\0"), F.col(source)))
    got = rows.join(F.broadcast(hot), surface, "left").withColumn("at", at).join(cold, "at", "left").withColumn("c", F.coalesce("hot", "cold")).where("c IS NOT NULL")
    own = F.when(F.col(source).isNull(), F.col("c.keys")).otherwise(F.concat(F.array(source), F.array_remove("c.keys", F.col(source))))
    return got.withColumn("expected", F.slice(own, 1, cap)).withColumn("expectedTotal", F.col("c.total")).drop("at", "hot", "cold", "c")


#: Kinds of missing readings up to which each word is held against all of them.
FEW_KINDS = 1_000


def reproducible(words: DataFrame, readings: DataFrame, toned: bool = False) -> DataFrame:
    """Words whose every character carries the reading that the word gives it.

    A word passes if it has one reading per code point and no (code point, reading) of it is
    missing from the table. Missing ones are looked up once for each kind of place; if there are
    few kinds, words are tested where they lie, else by an anti-join. Words are never compared.
    """
    part = "normalized" if toned else "syllable"
    kind = lambda cp, said: F.concat(cp.cast("string"), F.lit("\0"), "system", F.lit("\0"), said)
    even = words.where("size(cps) = size(readings)")
    kinds = F.transform(F.arrays_zip("cps", F.transform("readings", lambda r: r[part]).alias("said")), lambda z: kind(z["cps"], z["said"]))
    held = readings.select(kind(F.col("cp"), F.col(part)).alias("kind")).distinct()
    lacking = even.select(F.explode(kinds).alias("kind")).distinct().join(held, "kind", "left_anti")
    few = [r.kind for r in lacking.limit(FEW_KINDS + 1).collect()]
    if len(few) > FEW_KINDS:
        marked = even.withColumn("word", F.struct("system", "cps", "text", "readings"))
        bad = marked.select("word", F.explode(kinds).alias("kind")).join(held, "kind", "left_anti").select("word").distinct()
        return marked.join(bad, "word", "left_anti").select(*words.columns)
    if None in few:
        even = even.where(~F.exists(kinds, lambda k: k.isNull()))
    named = [F.lit(k) for k in few if k is not None]
    return even.where(~F.arrays_overlap(kinds, F.array(*named))) if named else even


def equivalents(readings: DataFrame, a: str = "mandarin", b: str = "zhuyin") -> DataFrame:
    """Code points that both systems have."""
    return readings.where(F.col("system") == a).select("cp").intersect(readings.where(F.col("system") == b).select("cp"))


def statistics(readings: DataFrame, words: DataFrame) -> DataFrame:
    """(system, chars, words)."""
    c = readings.groupBy("system").agg(F.countDistinct("cp").alias("chars"))
    w = words.groupBy("system").agg(F.count(F.lit(1)).alias("words"))
    return c.join(w, "system", "full").select("system", F.coalesce("chars", F.lit(0)).alias("chars"), F.coalesce("words", F.lit(0)).alias("words"))


def sampled(df: DataFrame, key: Column, count: int, seed: int) -> DataFrame:
    """``count`` rows drawn by MD5 of a key and a seed: the same ones wherever it runs."""
    return df.withColumn("_draw", F.md5(F.concat_ws("|", key, F.lit(seed)).cast("binary"))).orderBy("_draw").limit(count).drop("_draw")
