"""Match cases made from readings and words: inputs with what they must find.

Ids are made of a case's own content, so they don't depend on partitions or order.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tonewright.functions import fuzzy, keyboards
from tonewright.functions import text as tx
from tonewright.operators.etl import equivalents, reproducible, sampled, settled, with_first_keys

LATIN = ("a", "x", "ab", "xy", "test", "item", "abc", "config")
COLUMNS = ("id", "system", "level", "mode", "keyboard", "input", "variant", "fuzzies", "expected", "expectedTotal", "sourceEntry", "sourceText", "polarity")


def _keyboard(system: str) -> str:
    return {"korean": "BULSIK2", "zhuyin": "ZHUYIN", "japanese": "QUANPIN"}.get(system, "QUANPIN")


def _case(df: DataFrame, prefix: str, system: str, level: str, mode: str, keyboard: str | Column, variant: str | Column, fuzzies=(), polarity="POSITIVE") -> DataFrame:
    """Complete cases of rows with input, expected, expectedTotal, sourceEntry and sourceText."""
    col = lambda x: x if isinstance(x, Column) else F.lit(x)
    own = {
        "system": F.lit(system.upper()), "level": F.lit(level), "mode": col(mode), "keyboard": col(keyboard), "input": F.col("input"),
        "variant": col(variant), "fuzzies": F.array(*[F.lit(f) for f in fuzzies]).cast("array<string>"), "expected": F.col("expected"),
        "expectedTotal": F.col("expectedTotal").cast("int"), "sourceEntry": F.col("sourceEntry"),
        "sourceText": F.col("sourceText") if "sourceText" in df.columns else F.lit(None).cast("string"), "polarity": col(polarity),
    }
    out = df.select(*[c.alias(k) for k, c in own.items()])
    mark = F.substring(F.md5(F.concat_ws("|", "mode", "keyboard", "input", "variant", "sourceEntry").cast("binary")), 1, 16)
    return out.withColumn("id", F.concat(F.lit(prefix + "-"), mark)).select(*COLUMNS)


def _indexed(df: DataFrame, index: DataFrame) -> DataFrame:
    """Rows (input, sourceEntry) with the first keys of their input in an index (input, key), which has theirs."""
    return with_first_keys(df, index, "input", "sourceEntry")


def _typed(system: str, s: Column) -> Column:
    return F.coalesce(keyboards.bulsik2(s), F.lit("")) if system == "korean" else s


def char_cases(readings: DataFrame, system: str, variants=("FULL", "PARTIAL", "TONED")) -> DataFrame:
    """One case per reading: its syllable, two letters of it, or its toned form."""
    own = readings.where(F.col("system") == system).withColumn("sourceEntry", F.concat(F.lit("U+"), F.hex("cp")))
    out = []
    for v in variants:
        said = _typed(system, F.col("normalized" if v == "TONED" else "syllable"))
        rows = own.select("sourceEntry", (F.substring(said, 1, 2) if v == "PARTIAL" else said).alias("input"))
        out.append(_case(_indexed(rows, rows.select("input", F.col("sourceEntry").alias("key"))), f"{system.upper()}-CHAR-{v}", system, "CHAR", "CONTAINS", _keyboard(system), v))
    return reduce(DataFrame.unionByName, out)


def _word_rows(words: DataFrame, spoken: Column) -> DataFrame:
    return settled(words.select(tx.key_of(F.col("cps")).alias("sourceEntry"), F.col("text").alias("sourceText"), spoken.alias("input"))).where("input <> ''")


def _joined(f) -> Column:
    return F.array_join(F.transform("readings", f), "")


def word_cases(words: DataFrame, readings: DataFrame, system: str = "mandarin") -> DataFrame:
    """Whole words in full, by initials, by the first syllable and with tones.

    Japanese words are in romaji and must be reproducible; Korean words are typed on two-set
    keys and all are used. Both are matched exactly.
    """
    own = words.where(F.col("system") == system)
    if system in ("japanese", "korean"):
        own = reproducible(own, readings) if system == "japanese" else own
        rows = _word_rows(own, _joined(lambda r: _typed(system, r["normalized"])))
        done = _indexed(rows, rows.select("input", F.col("sourceEntry").alias("key")))
        return _case(done, f"{system.upper()}-WORD-FULL", system, "WORD", "EXACT", "ROMAJI" if system == "japanese" else "BULSIK2", "FULL")
    plain, toned = reproducible(own, readings), reproducible(own, readings, toned=True)
    forms = {
        "FULL": (plain, _joined(lambda r: r["syllable"]), "EXACT"),
        "ABBREV": (plain, _joined(lambda r: tx.initial(r["syllable"])), "EXACT"),
        "PARTIAL": (plain, F.get("readings", F.lit(0))["syllable"], "BEGINS"),
        "TONED": (toned, _joined(lambda r: r["normalized"]), "EXACT"),
    }
    out = []
    for v, (src, spoken, mode) in forms.items():
        rows = _word_rows(src, spoken)
        out.append(_case(_indexed(rows, rows.select("input", F.col("sourceEntry").alias("key"))), f"{system.upper()}-WORD-{v}", system, "WORD", mode, "QUANPIN", v))
    return reduce(DataFrame.unionByName, out)


def shuangpin_cases(words: DataFrame, readings: DataFrame, scheme: str) -> DataFrame:
    """Characters (their first two readings) and words in a double-pinyin scheme."""
    own, kb = readings.where("system = 'mandarin'"), scheme.upper()
    coded = own.select("ord", F.concat(F.lit("U+"), F.hex("cp")).alias("sourceEntry"), keyboards.shuangpin_code(F.col("syllable"), scheme).alias("input")).where("input IS NOT NULL")
    chars = _indexed(coded.where("ord < 2").drop("ord"), coded.select("input", F.col("sourceEntry").alias("key")))
    said = F.transform("readings", lambda r: keyboards.shuangpin_code(r["syllable"], scheme))
    rows = _word_rows(reproducible(words.where("system = 'mandarin'"), readings), F.when(~F.exists(said, lambda c: c.isNull()), F.array_join(said, "")))
    done = _indexed(rows, rows.select("input", F.col("sourceEntry").alias("key")))
    v = f"SHUANGPIN_{kb}"
    return _case(chars, f"MANDARIN-CHAR-{v}", "mandarin", "CHAR", "CONTAINS", kb, v).unionByName(_case(done, f"MANDARIN-WORD-{v}", "mandarin", "WORD", "EXACT", kb, v))


def equivalence_cases(readings: DataFrame) -> DataFrame:
    """Toneless Mandarin inputs of characters that have Zhuyin readings too."""
    own = readings.where("system = 'mandarin' AND ord < 2").join(equivalents(readings), "cp", "left_semi")
    entry = F.concat(F.lit("U+"), F.hex("cp"))
    rows = own.select(entry.alias("sourceEntry"), F.col("syllable").alias("input"), F.array(entry).alias("expected"), F.lit(1).alias("expectedTotal"))
    return _case(rows, "CROSS-MZ", "mandarin+zhuyin", "CHAR", "CONTAINS", "QUANPIN", "FULL_TONELESS")


def fuzzy_cases(readings: DataFrame, system: str, rule: str) -> DataFrame:
    """Inputs that a character has only under a rule, with all characters that then have them."""
    own = readings.where((F.col("system") == system) & (F.col("syllable") != "")).withColumn("sourceEntry", F.concat(F.lit("U+"), F.hex("cp")))
    index = own.select(F.explode(fuzzy.variants(F.col("syllable"), (rule,))).alias("input"), F.col("sourceEntry").alias("key"))
    varied = own.where("ord < 2").select("sourceEntry", "syllable", F.explode(fuzzy.by_name(rule)(F.col("syllable"))).alias("input"))
    rows = varied.where("input <> '' AND input <> syllable").select("sourceEntry", "input").distinct()
    return _case(_indexed(rows, index), f"{system.upper()}-CHAR-FUZZY-{rule}", system, "CHAR", "CONTAINS", _keyboard(system), "FUZZY", (rule,))


#: The letters that negative inputs are drawn from.
_LETTERS = {"zhuyin": "ㄅㄆㄇㄈㄉㄊㄋㄌㄍㄎㄏㄐㄑㄒㄓㄔㄕㄖㄗㄘㄙㄧㄨㄩㄚㄛㄜㄝㄞㄟㄠㄡㄢㄣㄤㄥㄦ", "korean": "abcdefghijklmnopqrstuvwxyzQWERTOP"}


def drawn_inputs(spark, system: str, count: int, seed: int, longest: int | None = None) -> DataFrame:
    """``count`` strings of letters drawn by MD5, of two to four letters (Bopomofo: three)."""
    letters, own = letters_of(system)
    longest = longest or own
    drawn = lambda k, n: F.conv(F.substring(F.md5(F.concat_ws("|", "id", F.lit(seed), k).cast("binary")), 1, 8), 16, 10).cast("long") % n
    size = drawn(F.lit(0), longest - 1) + 2
    pick = lambda i: F.substring(F.lit(letters), (drawn(i, len(letters)) + 1).cast("int"), F.lit(1))
    return spark.range(count).select(F.array_join(F.transform(F.sequence(F.lit(1), size.cast("int")), pick), "").alias("input"))


def letters_of(system: str) -> tuple[str, int]:
    """The letters of a system's drawn inputs, and their greatest number."""
    return _LETTERS.get(system, "abcdefghijklmnopqrstuvwxyz"), 3 if system == "zhuyin" else 4


def prefix_universe(readings: DataFrame, system: str) -> DataFrame:
    """Every prefix of every typed form of a system's readings."""
    said = F.explode(F.array(_typed(system, F.col("syllable")), _typed(system, F.col("normalized")))).alias("s")
    forms = readings.where(F.col("system") == system).select(said).where("s <> ''").distinct()
    return forms.select(F.explode(F.transform(F.sequence(F.lit(1), F.length("s")), lambda n: F.substring(F.col("s"), F.lit(1), n))).alias("input")).distinct()


def negative_cases(readings: DataFrame, system: str, count: int = 20_000, seed: int = 20260711, longest: int | None = None) -> DataFrame:
    """Drawn inputs that start no reading: an anti-join on the readings' prefixes."""
    free = drawn_inputs(readings.sparkSession, system, count, seed, longest).distinct().join(prefix_universe(readings, system), "input", "left_anti")
    rows = free.select("input", F.array().cast("array<string>").alias("expected"), F.lit(0).alias("expectedTotal"), F.lit("U+AC00" if system == "korean" else None).cast("string").alias("sourceEntry"))
    return _case(rows, f"{system.upper()}-NEG", system, "CHAR", "CONTAINS", _keyboard(system), "FULL", polarity="NEGATIVE")


def _scenario(rows: DataFrame, prefix: str, fuzzies=(), polarity="POSITIVE") -> DataFrame:
    """Cases of rows (cps, text, input, variant, mode): only their own entry is expected."""
    key = tx.key_of(F.col("cps"))
    made = rows.select("input", "variant", "mode", key.alias("sourceEntry"), F.col("text").alias("sourceText"), F.array(key).alias("expected"), F.lit(1).alias("expectedTotal"))
    return _case(made, prefix, "mandarin", "WORD", F.col("mode"), "QUANPIN", F.col("variant"), fuzzies, polarity)


def _forms(words: DataFrame, *forms: Column) -> DataFrame:
    """Rows of structs (variant, mode, input)."""
    return words.select("cps", "text", F.inline(F.array(*forms)))


def _form(variant: str, spoken: Column, mode: str = "CONTAINS") -> Column:
    return F.struct(F.lit(variant).alias("variant"), F.lit(mode).alias("mode"), spoken.alias("input"))


def _said(readings: Column) -> Column:
    return F.array_join(F.transform(readings, lambda r: r["syllable"]), "")


def _short(readings: Column) -> Column:
    return F.array_join(F.transform(readings, lambda r: tx.initial(r["syllable"])), "")


_R = "readings"


def initials_mix_cases(words: DataFrame, count: int = 20_000, seed: int = 20260712) -> DataFrame:
    """One syllable in full, the others by initials, for every place of sampled words."""
    at = sampled(words, F.col("text"), count, seed).select("cps", "text", _R, F.explode(F.sequence(F.lit(0), F.size(_R) - 1)).alias("full"))
    spoken = F.array_join(F.transform(_R, lambda r, i: F.when(i == F.col("full"), r["syllable"]).otherwise(tx.initial(r["syllable"]))), "")
    return _scenario(at.select("cps", "text", F.lit("ABBREV").alias("variant"), F.lit("CONTAINS").alias("mode"), spoken.alias("input")), "MANDARIN-JIANPIN-MIX")


def long_text_cases(words: DataFrame, least: int = 5) -> DataFrame:
    """Long words in full, by initials, mixed, by their first two syllables and by windows."""
    r, k = F.col(_R), F.size(_R)
    own = words.where(F.size("cps") >= least)
    forms = _forms(
        own,
        _form("FULL", _said(r)),
        _form("ABBREV", _short(r)),
        _form("ABBREV", F.concat(_said(F.slice(r, 1, 1)), _short(F.slice(r, F.lit(2), k)))),
        _form("ABBREV", F.concat(_short(F.slice(r, F.lit(1), k - 1)), _said(F.slice(r, -1, 1)))),
        _form("FULL", _said(F.slice(r, 1, 2))),
    )
    places = F.array_distinct(F.array(F.lit(0), F.floor(k / 3).cast("int"), F.floor(2 * k / 3).cast("int"), k - 2))
    windows = own.select("cps", "text", F.lit("FULL").alias("variant"), F.lit("CONTAINS").alias("mode"), F.explode(F.transform(places, lambda p: _said(F.slice(r, p + 1, F.lit(2))))).alias("input"))
    return _scenario(forms.union(windows), "MANDARIN-LONG-TEXT")


def mixed_script_cases(words: DataFrame, count: int = 400, seed: int = 20260713) -> DataFrame:
    """A Latin token before, after and inside sampled words."""
    full, init, token = _said(F.col(_R)), _short(F.col(_R)), F.col("token")
    own = sampled(words, F.col("text"), count, seed).withColumn("token", F.explode(F.array(*[F.lit(t) for t in LATIN])))
    mid = F.floor(F.size("cps") / 2).cast("int")
    row = lambda text, v, s: F.struct(text.alias("text"), F.lit(v).alias("variant"), s.alias("input"))
    before, after = F.concat(token, "text"), F.concat("text", token)
    inside = F.concat(F.substring("text", F.lit(1), mid), token, F.substring("text", mid + 1, F.lit(1 << 20)))
    made = [row(before, "FULL", token), row(before, "FULL", full), row(before, "ABBREV", F.concat(token, init)), row(before, "FULL", F.concat(token, full))]
    made += [row(after, "FULL", token), row(after, "FULL", full), row(after, "ABBREV", F.concat(init, token)), row(after, "FULL", F.concat(full, token))]
    both = F.when(mid > 0, F.array(*made, row(inside, "FULL", token))).otherwise(F.array(*made))
    flat = own.select(F.inline(both)).select(tx.to_codepoints(F.col("text")).alias("cps"), "text", "variant", F.lit("CONTAINS").alias("mode"), "input")
    return _scenario(flat, "MANDARIN-MIXED-SCRIPT")


def fuzzy_initials_cases(words: DataFrame, count: int = 10_000, seed: int = 20260714) -> DataFrame:
    """Words with a retroflex, typed by dental initials under the three retroflex rules."""
    own = sampled(words.where(F.exists(_R, lambda r: r["syllable"].rlike("^[zcs]h"))), F.col("text"), count, seed)
    rows = _forms(own, _form("ABBREV", F.array_join(F.transform(_R, lambda r: tx.dental_initial(r["syllable"])), "")))
    return _scenario(rows, "MANDARIN-FUZZY-JIANPIN", ("FUZZY_ZH_Z", "FUZZY_CH_C", "FUZZY_SH_S"))


def mode_cases(words: DataFrame, count: int = 6_000, seed: int = 20260715) -> DataFrame:
    """Exact matches in full and by initials, and beginnings by a syllable and by an initial."""
    r = F.col(_R)
    first = F.get(_R, F.lit(0))["syllable"]
    rows = _forms(
        sampled(words.where("size(cps) >= 2"), F.col("text"), count, seed),
        _form("FULL", _said(r), "EXACT"), _form("ABBREV", _short(r), "EXACT"), _form("FULL", first, "BEGINS"), _form("ABBREV", tx.initial(first), "BEGINS"),
    )
    return _scenario(rows, "MANDARIN-MODES")


def negative_scenario_cases(words: DataFrame, count: int = 6_000, seed: int = 20260716) -> DataFrame:
    """A first syllable that is no exact match of a longer word, and a token that isn't there."""
    one = _forms(sampled(words.where("size(cps) >= 2"), F.col("text"), count, seed), _form("FULL", F.get(_R, F.lit(0))["syllable"], "EXACT"))
    mixed = sampled(words, F.col("text"), count, seed + 1).select(F.concat(F.lit("x"), "text").alias("text"))
    two = mixed.select(tx.to_codepoints(F.col("text")).alias("cps"), "text", F.lit("FULL").alias("variant"), F.lit("CONTAINS").alias("mode"), F.lit("zzz").alias("input"))
    return _scenario(one.select("cps", "text", "variant", "mode", "input").union(two), "MANDARIN-NEG", polarity="NEGATIVE")


def scenario_cases(words: DataFrame, readings: DataFrame) -> DataFrame:
    """All curated scenarios over the reproducible Mandarin words."""
    own = reproducible(words.where("system = 'mandarin'"), readings)
    makers = (initials_mix_cases, long_text_cases, mixed_script_cases, fuzzy_initials_cases, mode_cases, negative_scenario_cases)
    return reduce(DataFrame.unionByName, [m(own) for m in makers])


def korean_cases(words: DataFrame, readings: DataFrame, count: int = 20_000) -> DataFrame:
    """All cases of the Korean tables alone: characters, words, and negatives of up to five keys."""
    parts = [char_cases(readings, "korean", ("FULL", "PARTIAL")), word_cases(words, readings, "korean")]
    return reduce(DataFrame.unionByName, [*parts, negative_cases(readings, "korean", count, 20260714, longest=5)])


def write_regression(words: DataFrame, readings: DataFrame, path: str) -> None:
    """Make the curated scenarios anew and nothing else: a folder of JSON lines for each kind."""
    kind = F.regexp_extract("id", "^(.*)-[0-9a-f]{16}\\z", 1)
    scenario_cases(words, readings).withColumn("kind", kind).write.mode("overwrite").partitionBy("kind").json(path)


def all_cases(words: DataFrame, readings: DataFrame) -> DataFrame:
    """Every kind of case; systems without tones have no toned ones."""
    out = [char_cases(readings, s) for s in ("mandarin", "cantonese", "zhuyin")]
    out += [char_cases(readings, s, ("FULL", "PARTIAL")) for s in ("japanese", "korean")]
    out += [word_cases(words, readings, s) for s in ("mandarin", "japanese", "korean")]
    out += [shuangpin_cases(words, readings, s) for s in keyboards.SCHEMES]
    out.append(equivalence_cases(readings))
    out += [fuzzy_cases(readings, s, r) for s in ("mandarin", "cantonese", "zhuyin", "japanese") for r in fuzzy.rules_for(s)]
    out += [negative_cases(readings, s) for s in ("mandarin", "cantonese", "zhuyin", "japanese", "korean")]
    return reduce(DataFrame.unionByName, [*out, scenario_cases(words, readings)])
