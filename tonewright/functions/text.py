"""Code points, tones, initials and script blocks as Column functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tonewright.model import JAPANESE, KOREAN, ZHUYIN, PhoneticSystem, Router, TonePolicy, ToneConvention

ONE_LETTER_INITIALS = "bpmfdtnlgkhjqxrzcsyw"
HANGUL_FIRST, HANGUL_LAST = 0xAC00, 0xD7A3


def chars(text: Column) -> Column:
    """The characters of a text, supplementary ones whole; none for the empty text."""
    return F.when(text == "", F.array().cast("array<string>")).otherwise(F.split(text, ""))


def to_codepoints(text: Column) -> Column:
    return F.transform(chars(text), F.ascii)


def char_of(cp: Column) -> Column:
    """The character of a code point; ``chr`` would only do for Latin-1."""
    return F.decode(F.unhex(F.lpad(F.hex(cp), 8, "0")), "UTF-32")


def from_codepoints(cps: Column) -> Column:
    return F.array_join(F.transform(cps, char_of), "")


def parse_codepoint(s: Column) -> Column:
    """``U+4E2D`` to 20013; -1 for anything else."""
    hexadecimal = s.rlike(r"^[Uu]\+[0-9A-Fa-f]{1,7}\z")
    return F.when(hexadecimal, F.conv(F.substring(s, 3, 7), 16, 10).cast("int")).otherwise(-1)


def parse_codepoints(s: Column) -> Column:
    """A comma list of code points; null if one is invalid."""
    got = F.transform(F.split(s, ",", -1), lambda x: parse_codepoint(F.trim(x)))
    return F.when(~F.exists(got, lambda x: x < 0), got)


def format_codepoint(cp: Column) -> Column:
    """``U+`` and at least four hexadecimal digits."""
    digits = F.hex(cp)
    return F.concat(F.lit("U+"), F.lpad(digits, F.greatest(F.lit(4), F.length(digits)), F.lit("0")))


def key_of(cps: Column) -> Column:
    """Code points as one key, ``U+4E2D,U+56FD``, without padding."""
    return F.array_join(F.transform(cps, lambda c: F.concat(F.lit("U+"), F.hex(c))), ",")


def strip_tone(reading: Column, tones: ToneConvention) -> Column:
    """The toneless syllable: without one trailing digit, or without Bopomofo tone marks."""
    if tones is ToneConvention.DIGIT:
        return F.regexp_replace(reading, r"[0-9]\z", "")
    if tones is ToneConvention.ZHUYIN:
        return F.regexp_replace(F.regexp_replace(reading, r"[ˊˇˋ˙]\z", ""), "^˙", "")
    return reading


def surface(normalized: Column, tones: ToneConvention, policy: TonePolicy) -> Column:
    return normalized if policy is TonePolicy.STRICT else strip_tone(normalized, tones)


def strip_all_tones(reading: Column) -> Column:
    """Every trailing tone digit gone: what validation compares."""
    return F.regexp_replace(reading, r"[1-5]+\z", "")


def zhuyin_tone(reading: Column) -> Column:
    """Tone number of a Bopomofo reading: its mark, 0 for neutral, 1 for none."""
    return (
        F.when(reading.startswith("˙") | reading.endswith("˙"), 0)
        .when(reading.endswith("ˊ"), 2)
        .when(reading.endswith("ˇ"), 3)
        .when(reading.endswith("ˋ"), 4)
        .otherwise(1)
    )


def initial_length(syllable: Column) -> Column:
    """2 for zh, ch and sh, 1 for other consonants, 0 for syllables without an initial."""
    return F.when(syllable.rlike("^[zcs]h"), 2).when(syllable.rlike(f"^[{ONE_LETTER_INITIALS}]"), 1).otherwise(0)


def initial(syllable: Column) -> Column:
    """The initial; a syllable without one gives itself."""
    n = initial_length(syllable)
    return F.when(n == 0, syllable).otherwise(F.substring(syllable, F.lit(1), n))


def dental_initial(syllable: Column) -> Column:
    """The initial, with zh, ch, sh as z, c, s."""
    return F.when(syllable.rlike("^[zcs]h"), F.substring(syllable, 1, 1)).otherwise(initial(syllable))


def is_hangul_syllable(cp: Column) -> Column:
    return cp.between(HANGUL_FIRST, HANGUL_LAST)


def cantonese_reading(jyutping: Column) -> Column:
    """struct(normalized, syllable, tone) of a jyutping syllable with a tone of 1 to 9."""
    tone = F.regexp_extract(jyutping, r"([1-9])\z", 1)
    return F.struct(jyutping.alias("normalized"), F.regexp_replace(jyutping, r"[1-9]\z", "").alias("syllable"), F.coalesce(tone.try_cast("int"), F.lit(0)).alias("tone"))


def mandarin_reading(numeric: Column) -> Column:
    """struct(normalized, syllable, tone) of numbered pinyin; tone 5 is none."""
    syllable = F.regexp_replace(numeric, r"[1-5]\z", "")
    tone = F.coalesce(F.regexp_extract(numeric, r"([1-4])\z", 1).try_cast("int"), F.lit(0))
    return F.struct(F.regexp_replace(numeric, r"5\z", "").alias("normalized"), syllable.alias("syllable"), tone.alias("tone"))


_HANGUL = ((0xAC00, 0xD7AF), (0x1100, 0x11FF), (0xA960, 0xA97F), (0xD7B0, 0xD7FF), (0x3130, 0x318F))
_KANA = ((0x3040, 0x30FF), (0x31F0, 0x31FF), (0xFF65, 0xFF9F))
_BOPOMOFO = ((0x3100, 0x312F), (0x31A0, 0x31BF))
_HAN = (
    (0x3400, 0x4DBF), (0x4E00, 0x9FFF), (0xF900, 0xFAFF), (0x20000, 0x2A6DF),
    (0x2A700, 0x2CEAF), (0x2CEB0, 0x2EBEF), (0x30000, 0x3134F),
)


def _within(cp: Column, blocks) -> Column:
    out = F.lit(False)
    for lo, hi in blocks:
        out = out | cp.between(lo, hi)
    return out


def block_system(cp: Column, han: str) -> Column:
    """Name of the system that a code point's Unicode block belongs to, null if none."""
    return (
        F.when(_within(cp, _HANGUL), KOREAN.name)
        .when(_within(cp, _KANA), JAPANESE.name)
        .when(_within(cp, _BOPOMOFO), ZHUYIN.name)
        .when(_within(cp, _HAN), han)
    )


def by_block(han: PhoneticSystem) -> Router:
    """Routes by Unicode block, Han characters to ``han``."""
    return Router(f"block-{han.name}", lambda cp: block_system(cp, han.name), (han, KOREAN, JAPANESE, ZHUYIN))
