"""Pinyin with marks and with numbers, and kana to romaji, as Column functions."""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F

_TONES = "̄́̌̀"


def _marked() -> tuple[str, str, str]:
    """Marked vowels, their plain letters and their tones, in step."""
    vowels = [(v, "v" if v == "ü" else v, t) for v in "aeiouü" for t in range(1, 5)]
    return "".join(unicodedata.normalize("NFC", v + _TONES[t - 1]) for v, _, t in vowels), "".join(p for _, p, _ in vowels), "".join(str(t) for *_, t in vowels)


_MARKED, _PLAIN, _NUMBER = _marked()


def to_numeric(pinyin: Column) -> Column:
    """struct(numeric, syllable, tone): marks off, ü as v, the first mark's tone as a number."""
    syllable = F.translate(pinyin, _MARKED + "ü", _PLAIN + "v")
    tone = F.coalesce(F.translate(F.regexp_extract(pinyin, f"([{_MARKED}])", 1), _MARKED, _NUMBER).try_cast("int"), F.lit(0))
    numeric = F.concat(syllable, F.when(tone > 0, tone.cast("string")).otherwise(""))
    return F.struct(numeric.alias("numeric"), syllable.alias("syllable"), tone.alias("tone"))


def to_diacritic(numeric: Column) -> Column:
    """Numbered pinyin with its mark: on a, else e, else o, else the last of i, u, ü."""
    tone = F.coalesce(F.regexp_extract(numeric, r"([1-4])\z", 1).try_cast("int"), F.lit(0))
    plain = F.regexp_replace(numeric, r"[1-5]\z", "")
    at = F.when(plain.contains("a"), F.instr(plain, "a")).when(plain.contains("e"), F.instr(plain, "e")).when(plain.contains("o"), F.instr(plain, "o"))
    last = F.length(F.regexp_extract(plain, "(?s)^(.*[iuv])", 1))
    at = F.coalesce(at, last)
    vowel = F.substring(plain, at, F.lit(1))
    marked = F.lit("")
    for t in range(1, 5):
        marks = "".join(m for m, n in zip(_MARKED, _NUMBER, strict=True) if n == str(t))
        marked = F.when(tone == t, F.translate(vowel, "aeiouv", marks)).otherwise(marked)
    whole = F.concat(F.substring(plain, F.lit(1), at - 1), marked, F.substring(plain, at + 1, F.lit(1 << 20)))
    return F.translate(F.when((tone > 0) & (at > 0), whole).otherwise(plain), "v", "ü")


def _syllabary() -> dict[str, str]:
    """Hiragana to Hepburn."""
    rows = {
        "": "あいうえお", "k": "かきくけこ", "s": "さしすせそ", "t": "たちつてと", "n": "なにぬねの", "h": "はひふへほ",
        "m": "まみむめも", "r": "らりるれろ", "g": "がぎぐげご", "z": "ざじずぜぞ", "d": "だぢづでど", "b": "ばびぶべぼ", "p": "ぱぴぷぺぽ",
    }
    out = {kana: c + v for c, row in rows.items() for kana, v in zip(row, "aiueo", strict=True)}
    odd = {"し": "shi", "ち": "chi", "つ": "tsu", "ふ": "fu", "じ": "ji", "ぢ": "ji", "づ": "zu"}
    return out | odd | {"や": "ya", "ゆ": "yu", "よ": "yo", "わ": "wa", "を": "wo", "ん": "n"}


def _katakana(s: str) -> str:
    return "".join(chr(ord(c) + 0x60) if "ぁ" <= c <= "ゖ" else c for c in s)


def kana_to_romaji(kana: Column) -> Column:
    """Hepburn in lower case, without macrons; characters that are no kana pass.

    A small tsu doubles the next kana's first letter, small ya, yu, yo join a kana in -i, a long
    mark repeats the letter before it.
    """
    base = _syllabary()
    table = base | {_katakana(k): v for k, v in base.items()} | {"ヴ": "vu", "ヵ": "ka", "ヶ": "ke"}
    # a kana that is no base is looked up like any other when a small y follows it
    joined = {}
    for k, v in table.items():
        if v.endswith("i") and k not in "ヴヵヶ":
            stem = v[:-1]
            for y, small in (("ya", "ゃャ"), ("yu", "ゅュ"), ("yo", "ょョ")):
                joined |= {k + s: stem + (y[1:] if stem in ("sh", "ch", "j") else y) for s in small}
    small = dict(zip("ぁぃぅぇぉァィゥェォ", "aiueo" * 2, strict=True))
    known = table | joined | small
    doubled = {k: v[0] for k, v in table.items() if k not in "ヴヵヶ"}
    # units: small tsu with what it doubles (looked at, not taken), joined kana, single characters
    pairs = "|".join(sorted(joined))
    units = F.regexp_extract_all(kana, F.lit(f"(?s){pairs}|."), F.lit(0))
    spelt = F.map_from_arrays(F.array(*[F.lit(k) for k in known]), F.array(*[F.lit(v) for v in known.values()]))
    lead = F.map_from_arrays(F.array(*[F.lit(k) for k in doubled]), F.array(*[F.lit(v) for v in doubled.values()]))
    following = lambda i: F.substring(F.coalesce(F.try_element_at(units, i + 2), F.lit("")), 1, 1)
    out = F.transform(
        units,
        lambda u, i: F.when(u.isin("っ", "ッ"), F.coalesce(F.try_element_at(lead, following(i)), F.lit(""))).otherwise(F.coalesce(F.try_element_at(spelt, u), u)),
    )
    # a long mark at the start, or after nothing written, is dropped
    text = F.aggregate(out, F.lit(""), lambda a, u: F.when(u == "ー", F.concat(a, F.substring(a, -1, 1))).otherwise(F.concat(a, u)))
    return F.when(kana == "", "").otherwise(text)
