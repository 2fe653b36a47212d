"""From readings to what a character may be typed as, under given options."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tonewright.functions import fuzzy, text
from tonewright.model import Options, TonePolicy


def surfaces(normalized: Column, syllable: Column, options: Options) -> Column:
    """Array of the strings that one reading may be typed as.

    Strict tones on the plain keyboard leave the normalized form alone. Else rules vary the
    toneless syllable, each by itself, and the keyboard encodes every variant.
    """
    if options.keyboard.identity and options.tone is TonePolicy.STRICT:
        return F.array(normalized)
    out = fuzzy.variants(syllable, options.effective_fuzzies)
    if not options.keyboard.identity:
        out = F.transform(out, options.keyboard.encode)
    return F.array_distinct(F.filter(out, lambda s: s.isNotNull() & (s != "")))


def routed(readings: DataFrame, options: Options) -> DataFrame:
    """The readings that the options use: of the system, or of the one a code point routes to."""
    if options.system:
        return readings.where(F.col("system") == options.system.name)
    known = [s.name for s in options.systems]
    return readings.where(F.col("system").isin(known) & (F.col("system") == options.router.system_of(F.col("cp"))))


def lattice(readings: DataFrame, options: Options) -> DataFrame:
    """(ch, ord, syllable, surfaces, initials): the typed forms of each reading, and the lengths
    of initials that may stand for them (none unless abbreviation is on)."""
    r = routed(readings, options).select(
        text.char_of(F.col("cp")).alias("ch"), "ord", "syllable", surfaces(F.col("normalized"), F.col("syllable"), options).alias("surfaces")
    )
    lengths = F.transform("surfaces", text.initial_length) if options.by_initials else F.transform("surfaces", lambda s: F.lit(0))
    return r.where(F.size("surfaces") > 0).withColumn("initials", lengths)


def useful(lat: DataFrame, query: str, partial: bool) -> DataFrame:
    """The rows of a lattice that may consume some part of a query; bounded by the dictionary."""
    q = F.lit(query)

    def helps(s: Column, initial: Column) -> Column:
        found = F.contains(q, s) | ((initial > 0) & F.contains(q, F.substring(s, F.lit(1), initial)))
        if partial and query:
            ends = [F.startswith(s, F.lit(query[-k:])) for k in range(1, min(len(query), 12) + 1)]
            found = found | reduce(lambda a, b: a | b, ends)
        return found

    return lat.where(F.exists(F.arrays_zip("surfaces", "initials"), lambda z: helps(z["surfaces"], z["initials"])))
