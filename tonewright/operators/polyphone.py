"""Word segmentation with forced readings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tonewright.functions import text as tx
from tonewright.model import MANDARIN, Options, PolyphoneMode, PolyphoneTable
from tonewright.plans.compiler import FORCED, forced_keys


def segment(text: Column, table: PolyphoneTable) -> Column:
    """Forced reading of each character, null outside words: the longest word at each place,
    from left to right, without overlaps."""
    by_word = dict(table.words)
    if not by_word:
        return F.transform(tx.chars(text), lambda c: F.lit(None).cast("string"))
    order = sorted(by_word, key=lambda w: (-len(w), w))
    pattern = "|".join("".join(f"\\x{{{ord(c):X}}}" for c in w) for w in order)
    cut = F.regexp_extract_all(text, F.lit(f"(?s){pattern}|."), F.lit(0))
    held = F.map_from_arrays(F.array(*[F.lit(w) for w in by_word]), F.array(*[F.array(*[F.lit(r) for r in rs]) for rs in by_word.values()]))
    return F.flatten(F.transform(cut, lambda t: F.coalesce(F.try_element_at(held, t), F.array(F.lit(None).cast("string")))))


def words_in(text: Column, table: PolyphoneTable) -> Column:
    """The words that segmentation takes, in order."""
    names = [w for w, _ in table.words]
    order = sorted(names, key=lambda w: (-len(w), w))
    pattern = "|".join("".join(f"\\x{{{ord(c):X}}}" for c in w) for w in order)
    return F.regexp_extract_all(text, F.lit(f"(?s){pattern}"), F.lit(0)) if names else F.array().cast("array<string>")


def precise_keys(text: Column, table: PolyphoneTable) -> Column:
    """struct(ch, forced syllable) of each character: what a precise index is keyed by."""
    options = Options(table.system, polyphone=PolyphoneMode.PRECISE, table=table)
    return F.transform(
        forced_keys(text, options),
        lambda k: F.struct(F.substring(k, 1, 1).alias("ch"), F.when(F.contains(k, F.lit(FORCED)), F.substring_index(k, FORCED, -1)).alias("forced")),
    )


def entries(spark: SparkSession, table: PolyphoneTable) -> DataFrame:
    """(cps, text, readings) of a table, by text."""
    rows = [(w, list(r)) for w, r in table.words]
    df = spark.createDataFrame(rows, "text string, readings array<string>")
    return df.select(tx.to_codepoints(F.col("text")).alias("cps"), "text", "readings")


def collected(words: DataFrame, limit: int = 1_000_000) -> PolyphoneTable:
    """A table from a (text, readings) DataFrame; a word list beyond ``limit`` is an error."""
    rows = words.select("text", "readings").limit(limit + 1).collect()
    if len(rows) > limit:
        raise ValueError(f"more than {limit} words")
    return PolyphoneTable.of({r.text: r.readings for r in rows}, MANDARIN)
