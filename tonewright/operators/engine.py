"""The engine: a session's readings, and predicates over columns of text."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tonewright.functions import text as tx
from tonewright.functions.keyboards import BULSIK2, CHOSEONG, shuangpin
from tonewright.model import CANTONESE, JAPANESE, KOREAN, MANDARIN, ZHUYIN, MatchMode, Options, PhoneticSystem, PolyphoneMode
from tonewright.plans.compiler import FORCED, CompiledQuery, Lattice
from tonewright.plans.lattice import lattice, useful


def mandarin_quanpin(**changes) -> Options:
    return Options(MANDARIN, **changes)


def cantonese_quanpin(**changes) -> Options:
    return Options(CANTONESE, **changes)


def zhuyin(**changes) -> Options:
    return Options(ZHUYIN, **changes)


def japanese_romaji(**changes) -> Options:
    return Options(JAPANESE, **changes)


def mandarin_shuangpin(scheme: str, **changes) -> Options:
    return Options(MANDARIN, keyboard=shuangpin(scheme), **changes)


def korean_bulsik2(**changes) -> Options:
    return Options(KOREAN, keyboard=BULSIK2, **changes)


def korean_choseong(**changes) -> Options:
    return Options(KOREAN, keyboard=CHOSEONG, **changes)


class Engine:
    """Predicates and searchers over one readings table (see ``model.READINGS``).

    ``systems`` limits the table to some systems; a table partitioned by system then reads
    only theirs. The engine itself holds no state besides lattices by options.
    """

    def __init__(self, spark: SparkSession, readings: DataFrame, systems: Iterable[PhoneticSystem] | None = None):
        self.spark = spark
        names = None if systems is None else [s.name for s in systems]
        self.readings = readings if names is None else readings.where(F.col("system").isin(names))
        self._lattices: dict[Options, DataFrame] = {}

    def lattice(self, options: Options) -> DataFrame:
        if options not in self._lattices:
            self._lattices[options] = lattice(self.readings, options)
        return self._lattices[options]

    def compile(self, query: str, options: Options) -> CompiledQuery:
        """Lay a query out: only dictionary rows that can consume some of it reach the driver."""
        if not query:
            return CompiledQuery(query, options, {})
        rows = useful(self.lattice(options), query, True).orderBy("ch", "ord").collect()
        held: Lattice = {}
        for r in rows:
            held.setdefault(r.ch, []).append(list(zip(r.surfaces, r.initials, strict=True)))
        if options.polyphone is PolyphoneMode.PRECISE:
            held |= self._forced(options, held, query)
        return CompiledQuery(query, options, held)

    def _forced(self, options: Options, held: Lattice, query: str) -> Lattice:
        """Keys of characters inside words: the first reading of the forced syllable alone, or
        all readings where the character has no such reading."""
        words = options.table.words
        inside = sorted({(c, r) for w, rs in words for c, r in zip(w, rs, strict=True)})
        if not inside:
            return {}
        asked = self.spark.createDataFrame(inside, "ch string, forced string").select("ch", tx.strip_tone(F.col("forced"), options.table.system.tones).alias("forced")).distinct()
        own = self.lattice(options).join(asked, "ch").where("syllable = forced")
        first = own.groupBy("ch", "forced").agg(F.min_by(F.struct("surfaces", "initials"), "ord").alias("r")).select("ch", "forced", "r.*").collect()
        chosen = {(r.ch, r.forced): list(zip(r.surfaces, r.initials, strict=True)) for r in first}
        out: Lattice = {}
        for ch, forced in (tuple(r) for r in asked.collect()):
            if (ch, forced) in chosen:
                out[f"{ch}{FORCED}{forced}"] = [chosen[ch, forced]]
            elif ch in held:
                out[f"{ch}{FORCED}{forced}"] = held[ch]
            elif ch in query:
                out[f"{ch}{FORCED}{forced}"] = []
        return out

    def contains(self, text: Column, query: str, options: Options) -> Column:
        return self.compile(query, options).contains(text)

    def begins(self, text: Column, query: str, options: Options) -> Column:
        return self.compile(query, options).begins(text)

    def matches(self, text: Column, query: str, options: Options) -> Column:
        return self.compile(query, options).matches(text)

    def search(self, names: DataFrame, query: str, options: Options, mode: MatchMode = MatchMode.CONTAINS, column: str = "name") -> DataFrame:
        """The rows of ``names`` that a query spells."""
        return names.where(self.compile(query, options).by(mode, F.col(column)))

    def char_entry(self, cps: DataFrame, system: PhoneticSystem) -> DataFrame:
        """Readings of the code points in ``cps.cp``, in order; null where there are none."""
        own = self.readings.where(F.col("system") == system.name)
        packed = own.groupBy("cp").agg(F.array_sort(F.collect_list(F.struct("ord", "normalized", "syllable"))).alias("readings"))
        return cps.join(packed, "cp", "left")

    def counts(self) -> DataFrame:
        """(system, chars, readings)."""
        return self.readings.groupBy("system").agg(F.countDistinct("cp").alias("chars"), F.count(F.lit(1)).alias("readings"))
