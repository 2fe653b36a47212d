"""Checks of a built dictionary, each a DataFrame of what is wrong or a report row."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tonewright.functions import fuzzy, keyboards
from tonewright.functions import text as tx
from tonewright.model import SYSTEMS, AbbrevPolicy, MatchMode, Options, TonePolicy
from tonewright.operators.engine import Engine
from tonewright.operators.search import search_batch

#: Least numbers of characters and words of a full build, and of cases and syllables.
MIN_CHARS = {"mandarin": 40_000, "cantonese": 28_000, "zhuyin": 40_000, "japanese": 10_000, "korean": 18_000}
MIN_WORDS = {"mandarin": 100_000, "japanese": 100_000}
MIN_CASES, MIN_SYLLABLES, MAX_DISAGREEMENT = 1_500_000, 400, 0.02


def _check(spark_df: DataFrame, name: str, value, ok) -> DataFrame:
    return spark_df.select(F.lit(name).alias("check") if isinstance(name, str) else name.alias("check"), value.cast("double").alias("value"), ok.alias("ok"))


def row_minimums(readings: DataFrame, words: DataFrame, chars=MIN_CHARS, least_words=MIN_WORDS) -> DataFrame:
    """(check, value, ok): characters and words of each system against their least numbers."""
    out = None
    for kind, table, count, least in (("chars", readings, F.countDistinct("cp"), chars), ("words", words, F.count(F.lit(1)), least_words)):
        wanted = readings.sparkSession.createDataFrame([(s, n) for s, n in least.items()], "system string, least long")
        got = wanted.join(table.groupBy("system").agg(count.alias("n")), "system", "left").withColumn("n", F.coalesce("n", F.lit(0)))
        part = _check(got, F.concat(F.lit(kind + "-"), "system"), F.col("n"), F.col("n") >= F.col("least"))
        out = part if out is None else out.union(part)
    return out


def bad_tones(readings: DataFrame) -> DataFrame:
    """Readings of systems with numbered tones whose tone isn't one of 0 to 9."""
    return readings.where("system IN ('mandarin', 'cantonese') AND (tone IS NULL OR tone NOT BETWEEN 0 AND 9)")


def missing_files(manifest: DataFrame, listed: DataFrame) -> DataFrame:
    """Listed paths that a manifest hasn't."""
    return listed.join(manifest, "path", "left_anti")


def keymap_gaps(readings: DataFrame) -> DataFrame:
    """(scheme, syllables): how many different syllables each scheme can type."""
    s = readings.where("system = 'mandarin'").select("syllable").distinct()
    each = F.array(*[F.struct(F.lit(n).alias("scheme"), keyboards.shuangpin_code(F.col("syllable"), n).alias("code")) for n in keyboards.SCHEMES])
    return s.select(F.inline(each)).where("code IS NOT NULL").groupBy("scheme").agg(F.count(F.lit(1)).alias("syllables"))


def unreachable_fuzzy(cases: DataFrame, readings: DataFrame) -> DataFrame:
    """Fuzzy cases with an unknown rule, or an input that their entry hasn't under it."""
    one = cases.where("variant = 'FUZZY'").withColumn("rule", F.get("fuzzies", F.lit(0)))
    said = readings.select(F.upper("system").alias("system"), F.concat(F.lit("U+"), F.hex("cp")).alias("sourceEntry"), "normalized", F.col("system").alias("own"))
    stripped = F.when(F.col("own") == "zhuyin", F.regexp_replace(F.regexp_replace("normalized", r"[ˊˇˋ˙]\z", ""), "^˙", "")).when(F.col("own") == "cantonese", F.regexp_replace("normalized", r"[1-9]+\z", "")).otherwise(tx.strip_all_tones(F.col("normalized")))
    reach = F.array(*[F.struct(F.lit(r).alias("rule"), fuzzy.variants(F.col("s"), (r,)).alias("forms")) for r in fuzzy.rules()])
    forms = said.withColumn("s", stripped).select("system", "sourceEntry", F.inline(reach)).select("system", "sourceEntry", "rule", F.explode("forms").alias("input"))
    return one.join(forms.distinct(), ["system", "sourceEntry", "rule", "input"], "left_anti").select("id")


def lost_sources(cases: DataFrame) -> DataFrame:
    """Positive cases whose own entry isn't expected."""
    return cases.where("polarity = 'POSITIVE' AND NOT array_contains(expected, sourceEntry)").select("id")


def options_of(system: str, keyboard: str, variant: str, fuzzies: tuple[str, ...]) -> Options | None:
    """The options that a case is matched under; None for cases of several systems."""
    if system.lower() not in SYSTEMS:
        return None
    return Options(
        SYSTEMS[system.lower()], keyboard=keyboards.by_name(keyboard), fuzzies=fuzzies,
        abbrev=AbbrevPolicy.INITIALS if variant == "ABBREV" else AbbrevPolicy.OFF, tone=TonePolicy.STRICT if variant == "TONED" else TonePolicy.IGNORE,
    )


def failing_samples(cases: DataFrame, engine: Engine, each: int = 30) -> DataFrame:
    """Of ``each`` positive cases of every kind, drawn by their ids' hash, those whose own entry the
    engine doesn't find: (id, input). A kind is a case's system, level, mode, keyboard, variant and
    rules; each is one batch search of its inputs in its entries' texts."""
    kind = ["system", "level", "mode", "keyboard", "variant", "rules"]
    own = cases.where("polarity = 'POSITIVE'").withColumn("rules", F.array_join("fuzzies", ","))
    turn = F.row_number().over(Window.partitionBy(*kind).orderBy(F.md5(F.col("id").cast("binary")), "id"))
    cps = F.transform(F.split("sourceEntry", ","), tx.parse_codepoint)
    drawn = own.withColumn("turn", turn).where(F.col("turn") <= each).select("id", "input", *kind, F.coalesce("sourceText", tx.from_codepoints(cps)).alias("name")).cache()
    bad = []
    for k in drawn.select(*kind).distinct().collect():  # as many as kinds of cases
        options = options_of(k.system, k.keyboard, k.variant, tuple(r for r in k.rules.split(",") if r))
        if options is None:
            continue
        some = drawn.where(reduce(lambda a, b: a & b, [F.col(c) == k[c] for c in kind])).select(F.row_number().over(Window.orderBy("id")).cast("long").alias("n"), "id", "input", "name")
        hits = search_batch(engine, some.select(F.col("n").alias("id"), "name"), some.select(F.col("n").alias("qid"), F.col("input").alias("query")), options, MatchMode[k.mode])
        bad.append(some.join(hits.where("qid = id").select(F.col("id").alias("n")), "n", "left_anti").select("id", "input"))
    return reduce(DataFrame.union, bad) if bad else drawn.select("id", "input").limit(0)


def report(readings: DataFrame, words: DataFrame, cases: DataFrame, rate: float = 0.0, manifest: DataFrame | None = None, listed: DataFrame | None = None, engine: Engine | None = None) -> DataFrame:
    """All checks in one table (check, value, ok); files are checked if a manifest and the
    listed paths are given, sampled cases if an engine is."""
    count = lambda df, name: _check(df.agg(F.count(F.lit(1)).alias("n")), name, F.col("n"), F.col("n") == 0)
    out = row_minimums(readings, words)
    out = out.union(count(bad_tones(readings), "bad-tones")).union(count(unreachable_fuzzy(cases, readings), "unreachable-fuzzy")).union(count(lost_sources(cases), "lost-sources"))
    if manifest is not None:
        out = out.union(count(missing_files(manifest, listed), "missing-files"))
    if engine is not None:
        out = out.union(count(failing_samples(cases, engine), "failing-samples"))
    out = out.union(_check(keymap_gaps(readings), F.concat(F.lit("keymap-"), "scheme"), F.col("syllables"), F.col("syllables") >= MIN_SYLLABLES))
    out = out.union(_check(cases.agg(F.count(F.lit(1)).alias("n")), "cases", F.col("n"), F.col("n") >= MIN_CASES))
    return out.union(_check(readings.sparkSession.range(1), "cross-check", F.lit(rate), F.lit(rate <= MAX_DISAGREEMENT)))
