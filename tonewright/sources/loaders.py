"""Readers of dictionary sources: each gives a readings or words DataFrame.

Line files are read as text and split by hand: they have no quoting, and columns by place.
``ord`` columns keep the order of lines, on which first- and last-wins rules rest.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tonewright.functions import romanize
from tonewright.functions import text as tx
from tonewright.model import MANDARIN, PhoneticSystem, PolyphoneTable, ToneConvention


def lines(spark: SparkSession, path: str) -> DataFrame:
    """(line, value) without a byte-order mark, comments and blank lines."""
    df = spark.read.text(path).select(F.monotonically_increasing_id().alias("line"), F.regexp_replace("value", "^﻿", "").alias("value"))
    return df.where(~F.startswith("value", F.lit("#")) & (F.trim("value") != ""))


def _column(k: int) -> Column:
    return F.get(F.split("value", "\t", -1), F.lit(k))


def _readings(df: DataFrame, system: Column | str, normalized: Column, tones: ToneConvention, **more: Column) -> DataFrame:
    name = F.lit(system) if isinstance(system, str) else system
    digit = F.coalesce(F.regexp_extract(normalized, r"([0-9])\z", 1).try_cast("int"), F.lit(0))
    cols = {
        "system": name, "cp": F.col("cp"), "ord": F.col("ord").cast("int"), "display": normalized, "normalized": normalized,
        "syllable": tx.strip_tone(normalized, tones), "tone": digit if tones is ToneConvention.DIGIT else F.lit(0),
        "freq": F.lit(0).cast("long"), "sources": F.array().cast("array<string>"),
    } | more
    return df.select(*[c.alias(k) for k, c in cols.items()], *[c for c in ("line",) if c in df.columns])


def char_table(spark: SparkSession, path: str, system: PhoneticSystem) -> DataFrame:
    """A character table: code point in column 0, readings in column 3, at least five columns.
    Rows without a code point or readings are skipped; of a code point's rows the last counts."""
    raw = lines(spark, path).where(F.size(F.split("value", "\t", -1)) >= 5)
    rows = raw.select("line", tx.parse_codepoint(F.trim(_column(0))).alias("cp"), F.filter(F.transform(F.split(_column(3), ","), lambda x: F.trim(x)), lambda r: r != "").alias("r"))
    last = rows.where((F.col("cp") >= 0) & (F.size("r") > 0)).groupBy("cp").agg(F.max_by("r", "line").alias("r"))
    return _readings(last.select("cp", F.posexplode("r").alias("ord", "n")), system.name, F.col("n"), system.tones)


def polyphone_rows(spark: SparkSession, path: str) -> DataFrame:
    """(cps, text, readings) of a polyphone table; rows of another form or count are skipped."""
    rows = lines(spark, path).where(F.size(F.split("value", "\t", -1)) >= 3)
    cps, readings = tx.parse_codepoints(F.trim(_column(0))), F.filter(F.transform(F.split(_column(2), ","), lambda x: F.trim(x)), lambda r: r != "")
    out = rows.select("line", cps.alias("cps"), readings.alias("readings")).where("cps IS NOT NULL AND size(cps) = size(readings)")
    last = out.groupBy("cps").agg(F.max_by("readings", "line").alias("readings"))
    return last.select("cps", tx.from_codepoints(F.col("cps")).alias("text"), "readings")


def polyphone_table(spark: SparkSession, path: str) -> PolyphoneTable:
    from tonewright.operators.polyphone import collected

    return collected(polyphone_rows(spark, path))


def keymap(spark: SparkSession, path: str) -> DataFrame:
    """(syllable, code) of a double-pinyin table."""
    return lines(spark, path).where(F.size(F.split("value", "\t")) >= 2).select(F.trim(_column(0)).alias("syllable"), F.trim(_column(1)).alias("code"))


def golden(spark: SparkSession, path: str) -> DataFrame:
    """(surface, variants) of a rule's table; variants may be none."""
    parts = F.split("value", "\t", 2)
    listed = F.filter(F.split(F.coalesce(F.get(parts, F.lit(1)), F.lit("")), ","), lambda v: v != "")
    return lines(spark, path).select(F.get(parts, F.lit(0)).alias("surface"), listed.alias("variants"))


CASE = (
    "id string, system string, level string, mode string, keyboard string, input string, variant string, fuzzies array<string>, "
    "expected array<string>, expectedTotal int, sourceEntry string, sourceText string, polarity string"
)


def cases(spark: SparkSession, path: str, share: float = 1.0, seed: int = 42) -> DataFrame:
    """Match cases, or a share of them that depends on ids and the seed alone."""
    df = spark.read.schema(CASE).json(path)
    return df if share >= 1 else df.where(F.pmod(F.xxhash64("id", F.lit(seed)), F.lit(1_000_000)) < int(share * 1_000_000))


def unihan_fields(spark: SparkSession, path: str) -> DataFrame:
    """A Unihan readings file as one row per code point with a column per field."""
    rows = lines(spark, path).where(F.size(F.split("value", "\t")) >= 3).select(tx.parse_codepoint(_column(0)).alias("cp"), _column(1).alias("field"), _column(2).alias("v"))
    return rows.where("cp >= 0").groupBy("cp").pivot("field", list(UNIHAN_FIELDS)).agg(F.last("v"))


UNIHAN_FIELDS = ("kMandarin", "kHanyuPinyin", "kTGHZ2013", "kXHC1983", "kCantonese", "kHangul", "kHanyuPinlu")


def field_readings(value: Column) -> Column:
    """Readings of a field such as ``10028.100:zhōng,zhòng``: what stands before a colon goes."""
    tokens = F.filter(F.split(F.trim(value), r"\s+"), lambda t: t != "")
    after = F.transform(tokens, lambda t: F.when(t.contains(":"), F.substring(t, F.instr(t, ":") + 1, F.lit(1 << 20))).otherwise(t))
    return F.filter(F.transform(F.flatten(F.transform(after, lambda t: F.split(t, ","))), lambda x: F.trim(x)), lambda r: r != "")


def field_frequencies(value: Column) -> Column:
    """numeric reading -> count of a field such as ``zhōng(4875) zhòng(66)``."""
    tokens = F.filter(F.split(F.trim(F.coalesce(value, F.lit(""))), r"\s+"), lambda t: t.rlike(r"^.+\(\d+\)\z"))
    pairs = F.transform(tokens, lambda t: F.struct(romanize.to_numeric(F.regexp_extract(t, r"^(.+?)\(", 1))["numeric"], F.regexp_extract(t, r"\((\d+)\)\z", 1).cast("long")))
    return F.map_from_entries(F.filter(F.transform(pairs, lambda p: p), lambda p: p.isNotNull()))


def hangul_field(value: Column) -> Column:
    """Syllables of a field such as ``한:0E``."""
    return F.filter(F.transform(F.split(F.trim(value), r"\s+"), lambda t: F.substring_index(t, ":", 1)), lambda t: t != "")


def unihan(spark: SparkSession, path: str) -> DataFrame:
    """Mandarin, Cantonese and Korean readings of a Unihan file, in field order."""
    f = unihan_fields(spark, path)
    sources = F.array(F.lit("unihan"))
    mandarin = F.flatten(F.array(*[F.coalesce(field_readings(F.col(c)), F.array().cast("array<string>")) for c in UNIHAN_FIELDS[:4]]))
    m = f.select("cp", field_frequencies(F.col("kHanyuPinlu")).alias("known"), F.posexplode(mandarin).alias("ord", "d")).withColumn("n", romanize.to_numeric(F.col("d"))).where("n.syllable <> ''")
    freq = F.coalesce(F.try_element_at("known", F.col("n.numeric")), F.lit(0).cast("long"))
    out = _readings(m, "mandarin", F.col("n.numeric"), ToneConvention.DIGIT, display=F.col("d"), syllable=F.col("n.syllable"), tone=F.col("n.tone"), freq=freq, sources=sources)
    c = f.select("cp", F.posexplode(F.filter(F.split(F.trim("kCantonese"), r"\s+"), lambda t: t != "")).alias("ord", "n"))
    k = f.select("cp", F.posexplode(hangul_field(F.col("kHangul"))).alias("ord", "n"))
    return out.union(_readings(c, "cantonese", F.col("n"), ToneConvention.DIGIT, sources=sources)).union(_readings(k, "korean", F.col("n"), ToneConvention.NONE, sources=sources))


def pinyin_list(spark: SparkSession, path: str) -> DataFrame:
    """(cp, readings) of lines ``U+4E2D: zhōng,zhòng  # 中``: sets of numbered readings."""
    rows = lines(spark, path).where(F.contains("value", F.lit(":"))).select(
        tx.parse_codepoint(F.trim(F.substring_index("value", ":", 1))).alias("cp"),
        F.regexp_replace("value", "^[^:]*:|#.*", "").alias("r"),
    )
    each = rows.where("cp >= 0").select("cp", F.explode(F.split("r", ",")).alias("d")).where(F.trim("d") != "")
    return each.groupBy("cp").agg(F.array_sort(F.collect_set(romanize.to_numeric(F.trim("d"))["numeric"])).alias("readings"))


def _words(df: DataFrame, system: str, readings: Column, source: str) -> DataFrame:
    return df.select(F.lit(system).alias("system"), tx.to_codepoints(F.col("text")).alias("cps"), "text", readings.alias("readings"), F.lit(source).alias("source"))


def _plain(r: Column) -> Column:
    return F.struct(r["normalized"].alias("normalized"), r["syllable"].alias("syllable"))


def cedict(spark: SparkSession, path: str) -> DataFrame:
    """Mandarin words of ``trad simp [pin1 yin1] /gloss/`` lines, by their simplified form."""
    form = r"^(\S+) (.+?) \[(.*?)\] /"
    rows = lines(spark, path).where(F.rlike("value", F.lit(form))).select(F.regexp_extract("value", form, 2).alias("text"), F.lower(F.regexp_extract("value", form, 3)).alias("p"))
    tokens = F.filter(F.split(F.regexp_replace("p", "[uv]:", "v"), " "), lambda t: F.trim(t) != "")
    readings = F.transform(tokens, lambda t: _plain(tx.mandarin_reading(F.trim(t))))
    return _words(rows.withColumn("r", readings).where(F.size("r") > 0), "mandarin", F.col("r"), "cedict")


def cantonese_chars(spark: SparkSession, path: str) -> DataFrame:
    """Cantonese readings of a JSON file ``{char: {jyutping: count}}``, or of a list of objects
    with a char (or entry) and its jyutping (or jyut, reading, readings), text or list."""
    whole = spark.read.text(path, wholetext=True)
    counted = whole.select(F.explode(F.from_json("value", "map<string,string>")).alias("char", "info"))
    freq = F.from_json("info", "map<string,bigint>")
    maps = counted.where(F.char_length("char") == 1).select("char", F.explode(freq).alias("n", "freq"))
    named = F.coalesce(*[F.col(f"e.{k}") for k in ("jyutping", "jyut", "reading", "readings")])
    as_list = F.from_json("value", "array<struct<char:string,entry:string,jyutping:string,jyut:string,reading:string,readings:string>>")
    listed = whole.select(F.explode(as_list).alias("e")).select(F.coalesce("e.char", "e.entry").alias("char"), named.alias("r"))
    parts = F.split(F.regexp_replace("r", r'[\[\]",]', " "), r"\s+")
    flat = listed.where("char_length(char) = 1").select("char", F.explode(parts).alias("n"), F.lit(0).cast("long").alias("freq"))
    both = maps.union(flat).where("trim(n) <> ''").select(F.ascii("char").alias("cp"), F.lit(0).alias("ord"), F.trim("n").alias("n"), "freq")
    return _readings(both, "cantonese", F.col("n"), ToneConvention.DIGIT, freq=F.coalesce("freq", F.lit(0).cast("long")), sources=F.array(F.lit("wordshk-chars")))


def cantonese_words(spark: SparkSession, path: str) -> DataFrame:
    """Cantonese words of ``head<TAB>jyutping`` lines, with or without a header."""
    rows = lines(spark, path).select(F.trim(_column(0)).alias("text"), F.trim(F.coalesce(_column(1), F.lit(""))).alias("r"))
    rows = rows.where("text <> '' AND r <> '' AND NOT lower(text) LIKE 'headword%' AND lower(text) <> 'entry'")
    return _words(rows, "cantonese", F.transform(F.split("r", r"\s+"), lambda t: _plain(tx.cantonese_reading(t))), "wordshk")


def kanji(spark: SparkSession, path: str) -> DataFrame:
    """Japanese readings of a KANJIDIC-like XML file (gzip too): on, kun and name readings."""
    schema = "literal string, reading_meaning struct<rmgroup:array<struct<reading:array<struct<_VALUE:string,_r_type:string>>>>>"
    df = spark.read.schema(schema).option("rowTag", "character").format("xml").load(path)
    r = F.flatten(F.transform("reading_meaning.rmgroup", lambda g: F.coalesce(g["reading"], F.array().cast("array<struct<_VALUE:string,_r_type:string>>"))))
    used = F.filter(r, lambda x: x["_r_type"].isin("ja_on", "ja_kun", "nanori"))
    rows = df.where("literal <> ''").select(F.ascii("literal").alias("cp"), F.posexplode(used).alias("ord", "x")).select("cp", "ord", F.translate("x._VALUE", ".-", "").alias("kana")).where("kana <> ''")
    return _readings(rows, "japanese", romanize.kana_to_romaji(F.col("kana")), ToneConvention.NONE, display=F.col("kana"), sources=F.array(F.lit("kanjidic")))


def japanese_words(spark: SparkSession, path: str) -> DataFrame:
    """Japanese words of a JMdict-like XML file: the first written form with the first reading."""
    schema = "k_ele array<struct<keb:string>>, r_ele array<struct<reb:string>>"
    df = spark.read.schema(schema).option("rowTag", "entry").format("xml").load(path)
    rows = df.select(F.get("k_ele", F.lit(0))["keb"].alias("text"), F.get("r_ele", F.lit(0))["reb"].alias("kana")).where("text <> '' AND kana <> ''")
    romaji = romanize.kana_to_romaji(F.replace("kana", F.lit("."), F.lit("")))
    return _words(rows, "japanese", F.array(F.struct(romaji.alias("normalized"), romaji.alias("syllable"))), "jmdict")


def hanja_chars(spark: SparkSession, path: str) -> DataFrame:
    """Korean readings of ``hanja,hangul`` lines."""
    parts = F.split("value", ",")
    rows = lines(spark, path).where(F.size(parts) >= 2).select("line", F.trim(parts[0]).alias("h"), F.trim(parts[1]).alias("n")).where("h <> '' AND n <> ''")
    return _readings(rows.select(F.ascii("h").alias("cp"), F.lit(0).alias("ord"), "n"), "korean", F.col("n"), ToneConvention.NONE, sources=F.array(F.lit("hangul")))


def hanja_words(spark: SparkSession, path: str) -> DataFrame:
    """Korean words of ``hanja,hangul`` lines: keyed by the hanja, shown in hangul."""
    parts = F.split("value", ",")
    rows = lines(spark, path).where(F.size(parts) >= 2).select(F.trim(parts[0]).alias("h"), F.trim(parts[1]).alias("text")).where("h <> '' AND text <> ''")
    return rows.select(F.lit("korean").alias("system"), tx.to_codepoints(F.col("h")).alias("cps"), "text", F.array(F.struct(F.col("text").alias("normalized"), F.col("text").alias("syllable"))).alias("readings"), F.lit("hangul").alias("source"))


def hangul_words(spark: SparkSession, path: str) -> DataFrame:
    """Korean words of a frequency list: two syllables or more, Hangul alone."""
    rows = lines(spark, path).where(F.size(F.split(F.trim("value"), r"\s+")) >= 2).select(F.split(F.trim("value"), r"\s+")[0].alias("text")).where(F.rlike("text", F.lit(r"^[가-힣]{2,}\z")))
    return _words(rows, "korean", F.array(F.struct(F.col("text").alias("normalized"), F.col("text").alias("syllable"))), "hangul")


def char_rows(spark: SparkSession, rows: list[tuple[str, int, list[str]]], system: PhoneticSystem = MANDARIN) -> DataFrame:
    """Readings given in the program: (character, ...) as (char, _, readings)."""
    df = spark.createDataFrame([(c, list(r)) for c, _, r in rows], "c string, r array<string>")
    return _readings(df.select(F.ascii("c").alias("cp"), F.posexplode("r").alias("ord", "n")), system.name, F.col("n"), system.tones)


def word_rows(spark: SparkSession, rows: list[tuple[str, list[str]]], system: PhoneticSystem = MANDARIN) -> DataFrame:
    """Words given in the program: (text, readings)."""
    df = spark.createDataFrame([(t, list(r)) for t, r in rows], "text string, r array<string>")
    return df.select(F.lit(system.name).alias("system"), tx.to_codepoints(F.col("text")).alias("cps"), "text", _spoken(F.col("r"), system).alias("readings"), F.lit("program").alias("source"))


def word_table(spark: SparkSession, path: str, system: PhoneticSystem) -> DataFrame:
    """Words of a word table: code points, text, readings shown and normalized, source."""
    rows = lines(spark, path).where(F.size(F.split("value", "\t", -1)) >= 4)
    cps, r = tx.parse_codepoints(F.trim(_column(0))), F.filter(F.split(F.trim(_column(3)), " +"), lambda x: x != "")
    found = rows.select(F.lit(system.name).alias("system"), cps.alias("cps"), F.trim(_column(1)).alias("text"), _spoken(r, system).alias("readings"), F.coalesce(_column(4), F.lit("")).alias("source"))
    return found.where("cps IS NOT NULL AND size(readings) > 0")


def _spoken(readings: Column, system: PhoneticSystem) -> Column:
    return F.transform(readings, lambda n: F.struct(n.alias("normalized"), tx.strip_tone(n, system.tones).alias("syllable")))


def last_wins(tables: list[DataFrame], key: tuple[str, ...]) -> DataFrame:
    """The union of tables in which a key's rows come from the last table that has the key."""
    ranked = None
    for k, t in enumerate(tables):
        part = t.withColumn("_turn", F.lit(k))
        ranked = part if ranked is None else ranked.unionByName(part)
    if len(tables) == 1:
        return ranked.drop("_turn")
    last = ranked.groupBy(*key).agg(F.max("_turn").alias("_turn"))
    return ranked.join(last, [*key, "_turn"]).select(*tables[0].columns)
