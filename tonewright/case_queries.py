"""The registered match-case queries and their DuckDB twins.

Lists of a case are joined by commas, which both engines compare alike. A twin takes syllables,
variants and codes from plain Python over the seed tables and shares no expression with the
operators.
"""

from __future__ import annotations

import itertools
import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tonewright import seed
from tonewright.functions import fuzzy, keyboards
from tonewright.functions import text as tx
from tonewright.operators import cases, etl
from tonewright.queries import _KEYS, HAN, HANGUL, KANA_HAN, Query, _bare, _derived_words, _initial, _values, _zhuyin_bare, whole_names, whole_names_sql

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}
#: The Korean rebuild: its words, and its inputs of up to five letters, which ``all_cases`` doesn't draw.
REBUILD: dict[str, Query] = {}
REBUILD_ORACLES: dict[str, str] = {}

TABLES = {"mandarin": seed.MANDARIN, "cantonese": seed.CANTONESE, "zhuyin": seed.ZHUYIN, "japanese": seed.JAPANESE}
BARE = {"mandarin": _bare, "cantonese": _bare, "zhuyin": _zhuyin_bare, "japanese": str}
KEYBOARD = {"korean": "BULSIK2", "zhuyin": "ZHUYIN"}


def _flat(df: DataFrame) -> DataFrame:
    return df.withColumn("fuzzies", F.array_join("fuzzies", ",")).withColumn("expected", F.array_join("expected", ","))


def _cases(make: Callable[[DataFrame, DataFrame], DataFrame]) -> Query:
    return lambda spark, sf: _flat(make(_derived_words(spark, sf, True).drop("id"), seed.readings(spark)))


# ---- SQL: a case query is CTEs and a union of parts


def _text(x: str | None) -> str:
    return "CAST(NULL AS VARCHAR)" if x is None else f"'{x}'"


def _part(rows: str, prefix: str, system: str, level: str, mode: str, keyboard: str, variant: str, fuzzies: tuple = (), polarity: str = "POSITIVE") -> str:
    """Cases of rows (input, expected, expectedTotal, sourceEntry, sourceText); ``mode`` and
    ``variant`` are SQL."""
    return f"""SELECT '{prefix}-' || left(md5(concat_ws('|', {mode}, '{keyboard}', input, {variant}, sourceEntry)), 16) AS id, '{system.upper()}' AS system, '{level}' AS level,
  {mode} AS mode, '{keyboard}' AS keyboard, input, {variant} AS variant, '{",".join(fuzzies)}' AS fuzzies, expected, CAST(expectedTotal AS INTEGER) AS "expectedTotal",
  sourceEntry AS "sourceEntry", sourceText AS "sourceText", '{polarity}' AS polarity FROM ({rows})"""


def _indexed(rows: str, index: str) -> str:
    """Rows (input, sourceEntry, sourceText) with the first 24 keys of their input in index (input, key)."""
    return f"""SELECT r.*, array_to_string(([r.sourceEntry] || list_filter(b.keys, lambda k: k <> r.sourceEntry))[1:24], ',') AS expected, len(b.keys) AS expectedTotal
  FROM ({rows}) AS r JOIN (SELECT input, list_sort(list(DISTINCT key)) AS keys FROM ({index}) GROUP BY input) AS b ON b.input = r.input"""


def _own(rows: str) -> str:
    """Every row's own entry as the index of its input."""
    return _indexed(rows, f"SELECT input, sourceEntry AS key FROM ({rows})")


def _readings_sql(system: str) -> str:
    """(ch, entry, ord, toned, syl): readings as they are typed."""
    if system == "korean":
        lists = [f"[{', '.join(_text(k) for k in keys)}]" for keys in (keyboards._LEAD, keyboards._VOWEL, keyboards._CLOSE)]
        keys = " || ".join(f"({x})[CAST({at} AS BIGINT) + 1]" for x, at in zip(lists, ("i // 588", "i % 588 // 28", "i % 28"), strict=True))
        return f"SELECT chr(CAST(44032 + i AS INTEGER)) AS ch, format('U+{{:X}}', 44032 + i) AS entry, 0 AS ord, {keys} AS toned, {keys} AS syl FROM range(11172) AS t(i)"
    rows = [(c, f"U+{ord(c):X}", k, r, BARE[system](r)) for c, rs in TABLES[system].items() for k, r in enumerate(rs.split())]
    return f"SELECT * FROM ({_values(rows)}) AS t(ch, entry, ord, toned, syl)"


def _char_sql(system: str, variants: tuple[str, ...]) -> str:
    said = {"FULL": "syl", "PARTIAL": "left(syl, 2)", "TONED": "toned"}
    parts = []
    for v in variants:
        rows = f"SELECT {said[v]} AS input, entry AS sourceEntry, {_text(None)} AS sourceText FROM rd"
        parts.append(_part(_own(rows), f"{system.upper()}-CHAR-{v}", system, "CHAR", "'CONTAINS'", KEYBOARD.get(system, "QUANPIN"), f"'{v}'"))
    return f"WITH rd AS ({_readings_sql(system)})\n" + "\nUNION ALL\n".join(parts)


_FIRST = {c: seed.MANDARIN[c].split()[0] for c in HAN}
#: Places of the words that names make, with their sounds; words of reproducible sounds; their lists.
_WORDS = f"""WITH rd AS ({_readings_sql("mandarin")}), h(ch, first) AS ({_values(_FIRST.items())}),
ini(syl, short, dental) AS ({_values((s, _initial(s), s[:1]) for s in sorted({_bare(r) for v in seed.MANDARIN.values() for r in v.split()}))}),
p AS (SELECT id, name, unnest(string_split(name, '')) AS ch, generate_subscripts(string_split(name, ''), 1) - 1 AS i FROM ({whole_names_sql(HAN, 4)})),
said AS (SELECT id, name, i, ch, CASE WHEN (id + i) % 5 = 0 THEN 'xia4' ELSE first END AS toned FROM p JOIN h USING (ch)),
s AS (SELECT *, rtrim(toned, '0123456789') AS syl FROM said),
w AS (
  SELECT id, name, string_agg(format('U+{{:X}}', unicode(ch)), ',' ORDER BY i) AS entry, list(syl ORDER BY i) AS syls, list(toned ORDER BY i) AS toneds,
    list(short ORDER BY i) AS shorts, list(dental ORDER BY i) AS dentals,
    bool_and(EXISTS (SELECT 1 FROM rd WHERE rd.ch = s.ch AND rd.syl = s.syl)) AS plain, bool_and(EXISTS (SELECT 1 FROM rd WHERE rd.ch = s.ch AND rd.toned = s.toned)) AS exact
  FROM s JOIN ini USING (syl) GROUP BY id, name
)"""


def _joined(x: str) -> str:
    return f"array_to_string({x}, '')"


def _word_sql() -> str:
    parts = []
    for v, (spoken, held, mode) in {
        "FULL": (_joined("syls"), "plain", "EXACT"), "ABBREV": (_joined("shorts"), "plain", "EXACT"),
        "PARTIAL": ("syls[1]", "plain", "BEGINS"), "TONED": (_joined("toneds"), "exact", "EXACT"),
    }.items():
        rows = f"SELECT {spoken} AS input, entry AS sourceEntry, name AS sourceText FROM w WHERE {held}"
        parts.append(_part(_own(rows), f"MANDARIN-WORD-{v}", "mandarin", "WORD", f"'{mode}'", "QUANPIN", f"'{v}'"))
    return f"{_WORDS}\n" + "\nUNION ALL\n".join(parts)


def code_of(syllable: str, scheme: str) -> str:
    """Two keys of a pinyin syllable of the seed table, in plain Python."""
    head = re.match("zh|ch|sh|[^aeiouv]?", syllable)[0]
    tail = syllable[len(head) :]
    if tail == "u" and head in ("j", "q", "x", "y"):
        tail = "v"
    final = keyboards._FINALS[scheme].get(tail, tail)
    if head:
        return keyboards._RETROFLEX[scheme].get(head, head) + final
    lead = keyboards._ZERO_INITIAL.get(scheme)
    return lead + final if lead else syllable[0] + (final if len(syllable) > 1 else syllable)


def _shuangpin_sql(scheme: str) -> str:
    v = f"SHUANGPIN_{scheme.upper()}"
    codes = sorted({(s, code_of(s, scheme)) for s in (_bare(r) for x in seed.MANDARIN.values() for r in x.split())})
    head = f"{_WORDS}, code(syl, code) AS ({_values(codes)}), cr AS (SELECT code AS input, entry AS sourceEntry, {_text(None)} AS sourceText, ord FROM rd JOIN code USING (syl))"
    chars = _indexed("SELECT input, sourceEntry, sourceText FROM cr WHERE ord < 2", "SELECT input, sourceEntry AS key FROM cr")
    rows = "SELECT string_agg(code, '' ORDER BY i) AS input, any_value(entry) AS sourceEntry, name AS sourceText FROM s JOIN code USING (syl) JOIN w USING (id, name) WHERE plain GROUP BY id, name"
    return f"""{head}
{_part(chars, f"MANDARIN-CHAR-{v}", "mandarin", "CHAR", "'CONTAINS'", scheme.upper(), f"'{v}'")}
UNION ALL
{_part(_own(rows), f"MANDARIN-WORD-{v}", "mandarin", "WORD", "'EXACT'", scheme.upper(), f"'{v}'")}"""


def _equivalence_sql() -> str:
    rows = f"SELECT syl AS input, entry AS expected, 1 AS expectedTotal, entry AS sourceEntry, {_text(None)} AS sourceText FROM rd WHERE ord < 2 AND ch IN (SELECT ch FROM zy)"
    return f"WITH rd AS ({_readings_sql('mandarin')}), zy AS ({_readings_sql('zhuyin')})\n" + _part(rows, "CROSS-MZ", "mandarin+zhuyin", "CHAR", "'CONTAINS'", "QUANPIN", "'FULL_TONELESS'")


def _heads(a: str, b: str) -> Callable[[str], list[str]]:
    return lambda s: [b + s[len(a) :]] if s.startswith(a) else [a + s[len(b) :]] if s.startswith(b) else []


def _tails(a: str, b: str) -> Callable[[str], list[str]]:
    return lambda s: [s[: -len(a)] + b] if s.endswith(a) else [s[: -len(b)] + a] if s.endswith(b) else []


def _u_or_v(s: str) -> list[str]:
    if s[:1] not in "nljqxy":
        return []
    return [s[0] + s[1:].replace("u", "v")] if "u" in s[1:] else [s[0] + s[1:].replace("v", "u")] if "v" in s[1:] else []


def _romaji(s: str) -> list[str]:
    pairs = list(fuzzy.HEPBURN_TO_KUNREI.items())
    out = []
    for old, new in pairs + [(b, a) for a, b in pairs]:
        got, i = "", 0
        while i < len(s):
            hit = s.startswith(old, i) and (i == 0 or s[i - 1] in "aeioun'")
            got, i = (got + new, i + len(old)) if hit else (got + s[i], i + 1)
        out.append(got)
    return out


#: The rules in plain Python: a syllable to its variants.
VARIANTS: dict[str, Callable[[str], list[str]]] = {
    "FUZZY_ZH_Z": _heads("zh", "z"), "FUZZY_CH_C": _heads("ch", "c"), "FUZZY_SH_S": _heads("sh", "s"),
    "FUZZY_ANG_AN": _tails("ang", "an"), "FUZZY_ENG_EN": _tails("eng", "en"), "FUZZY_ING_IN": _tails("ing", "in"), "FUZZY_U_V": _u_or_v,
    "FUZZY_N_L": lambda s: [] if s.startswith("ng") else _heads("n", "l")(s),
    "FUZZY_NG_OMIT": lambda s: [s[2:]] if s.startswith("ng") and len(s) > 2 else [],
    "FUZZY_GW_G": lambda s: [s[0] + s[2:]] if s[:2] in ("gw", "kw") and len(s) > 2 else [],
    "FUZZY_ZY_ZH_Z": _heads("ㄓ", "ㄗ"), "FUZZY_ZY_CH_C": _heads("ㄔ", "ㄘ"), "FUZZY_ZY_SH_S": _heads("ㄕ", "ㄙ"),
    "FUZZY_HEPBURN_KUNREI": _romaji,
    "FUZZY_LONG_VOWEL": lambda s: [s.replace(x, x[0]) for x in ("uu", "oo", "ou") if x in s],
}


def _fuzzy_sql(system: str, rule: str) -> str:
    syllables = sorted({BARE[system](r) for x in TABLES[system].values() for r in x.split()})
    varied = sorted({(s, v) for s in syllables for v in VARIANTS[rule](s) if v not in ("", s)})
    rows = f"SELECT DISTINCT var AS input, entry AS sourceEntry, {_text(None)} AS sourceText FROM rd JOIN v USING (syl) WHERE ord < 2"
    index = "SELECT var AS input, entry AS key FROM rd JOIN v USING (syl) UNION ALL SELECT syl, entry FROM rd"
    return f"WITH rd AS ({_readings_sql(system)}), v(syl, var) AS ({_values(varied or [('', '')])})\n" + _part(
        _indexed(rows, index), f"{system.upper()}-CHAR-FUZZY-{rule}", system, "CHAR", "'CONTAINS'", KEYBOARD.get(system, "QUANPIN"), "'FUZZY'", (rule,)
    )


def _negative_sql(system: str, count: int = 20_000, seed_: int = 20260711, most: int | None = None) -> str:
    letters, longest = cases.letters_of(system)
    longest = most or longest
    drawn = lambda k, n: f"(CAST('0x' || left(md5(concat_ws('|', id, {seed_}, {k})), 8) AS BIGINT) % {n})"
    entry = _text("U+AC00" if system == "korean" else None)
    rows = f"SELECT DISTINCT input, '' AS expected, 0 AS expectedTotal, {entry} AS sourceEntry, {_text(None)} AS sourceText FROM drawn WHERE input NOT IN (SELECT input FROM u)"
    return f"""WITH rd AS ({_readings_sql(system)}), f AS (SELECT syl AS s FROM rd UNION SELECT toned FROM rd),
u AS (SELECT DISTINCT left(s, n) AS input FROM f, range(1, 16) AS t(n)),
drawn AS (SELECT string_agg(substr('{letters}', 1 + {drawn("k", len(letters))}, 1), '' ORDER BY k) AS input FROM range({count}) AS t(id), range(1, {longest + 1}) AS n(k) WHERE k <= 2 + {drawn("0", longest - 1)} GROUP BY id)
""" + _part(rows, f"{system.upper()}-NEG", system, "CHAR", "'CONTAINS'", KEYBOARD.get(system, "QUANPIN"), "'FULL'", polarity="NEGATIVE")


def _drawn(count: int, seed_: int, where: str = "true") -> str:
    return f"(SELECT * FROM w WHERE plain AND {where} ORDER BY md5(name || '|{seed_}') LIMIT {count})"


def _scenario(rows: str, prefix: str, fuzzies: tuple = (), polarity: str = "POSITIVE") -> str:
    """Cases of rows (input, variant, mode, entry, name)."""
    made = f"SELECT input, variant, mode, entry AS expected, 1 AS expectedTotal, entry AS sourceEntry, name AS sourceText FROM ({rows})"
    return _part(made, prefix, "mandarin", "WORD", "mode", "QUANPIN", "variant", fuzzies, polarity)


def _spoken(source: str, *forms: tuple[str, str, str]) -> str:
    """Rows of (variant, mode, input) forms over words."""
    return " UNION ALL ".join(f"SELECT {spoken} AS input, '{v}' AS variant, '{mode}' AS mode, entry, name FROM {source}" for v, mode, spoken in forms)


def _scenario_sql() -> str:
    full, short = _joined("syls"), _joined("shorts")
    entry_of = "array_to_string(list_transform(string_split(name, ''), lambda c: format('U+{:X}', unicode(c))), ',') AS entry"
    mix = f"""SELECT array_to_string(list_transform(syls, lambda x, k: CASE WHEN k = nth THEN x ELSE shorts[k] END), '') AS input, 'ABBREV' AS variant, 'CONTAINS' AS mode, entry, name
  FROM (SELECT *, unnest(range(1, len(syls) + 1)) AS nth FROM {_drawn(20_000, 20260712)})"""
    long = "(SELECT * FROM w WHERE plain AND len(syls) >= 5)"
    n = "len(syls)"
    longs = _spoken(
        long, ("FULL", "CONTAINS", full), ("ABBREV", "CONTAINS", short), ("ABBREV", "CONTAINS", "syls[1] || " + _joined("shorts[2:]")),
        ("ABBREV", "CONTAINS", _joined(f"shorts[1:{n} - 1]") + " || syls[-1]"), ("FULL", "CONTAINS", _joined("syls[1:2]")),
    )
    longs += f""" UNION ALL SELECT {_joined("syls[nth + 1:nth + 2]")}, 'FULL', 'CONTAINS', entry, name
  FROM (SELECT *, unnest(list_distinct([0, {n} // 3, 2 * {n} // 3, {n} - 2])) AS nth FROM {long})"""
    token = f"(SELECT w.*, token, len(syls) // 2 AS mid FROM {_drawn(400, 20260713)} AS w, (VALUES {', '.join(f'({_text(t)})' for t in cases.LATIN)}) AS t(token))"
    mixed = []
    for v, text, spoken, where in (
        ("FULL", "token || name", "token", "true"), ("FULL", "token || name", full, "true"), ("ABBREV", "token || name", f"token || {short}", "true"), ("FULL", "token || name", f"token || {full}", "true"),
        ("FULL", "name || token", "token", "true"), ("FULL", "name || token", full, "true"), ("ABBREV", "name || token", f"{short} || token", "true"), ("FULL", "name || token", f"{full} || token", "true"),
        ("FULL", "substr(name, 1, mid) || token || substr(name, mid + 1)", "token", "mid > 0"),
    ):
        mixed.append(f"SELECT input, '{v}' AS variant, 'CONTAINS' AS mode, {entry_of}, name FROM (SELECT {spoken} AS input, {text} AS name FROM {token} WHERE {where})")
    dental = _spoken(_drawn(10_000, 20260714, "len(list_filter(syls, lambda x: regexp_matches(x, '^[zcs]h'))) > 0"), ("ABBREV", "CONTAINS", _joined("dentals")))
    modes = _spoken(_drawn(6_000, 20260715, "len(syls) >= 2"), ("FULL", "EXACT", full), ("ABBREV", "EXACT", short), ("FULL", "BEGINS", "syls[1]"), ("ABBREV", "BEGINS", "shorts[1]"))
    wrong = _spoken(_drawn(6_000, 20260716, "len(syls) >= 2"), ("FULL", "EXACT", "syls[1]"))
    wrong += f" UNION ALL SELECT 'zzz', 'FULL', 'CONTAINS', {entry_of}, name FROM (SELECT 'x' || name AS name FROM {_drawn(6_000, 20260717)})"
    return f"{_WORDS}\n" + "\nUNION ALL\n".join([
        _scenario(mix, "MANDARIN-JIANPIN-MIX"), _scenario(longs, "MANDARIN-LONG-TEXT"), _scenario(" UNION ALL ".join(mixed), "MANDARIN-MIXED-SCRIPT"),
        _scenario(dental, "MANDARIN-FUZZY-JIANPIN", ("FUZZY_ZH_Z", "FUZZY_CH_C", "FUZZY_SH_S")), _scenario(modes, "MANDARIN-MODES"), _scenario(wrong, "MANDARIN-NEG", polarity="NEGATIVE"),
    ])


def _word_cases(system: str, alphabet: str) -> Query:
    """Word cases of names: Korean ones said as they are written, Japanese ones by first readings."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        n = whole_names(spark, sf_dir, alphabet, 4)
        said = F.array(F.col("name"))
        if system == "japanese":
            first = F.create_map(*[F.lit(x) for c in sorted(set(alphabet)) for x in (c, seed.JAPANESE[c].split()[0])])
            said = F.transform(tx.chars(F.col("name")), lambda c: F.try_element_at(first, c))
        reading = F.transform(said, lambda r: F.struct(r.alias("normalized"), r.alias("syllable")))
        words = n.select(F.lit(system).alias("system"), tx.to_codepoints(F.col("name")).alias("cps"), F.col("name").alias("text"), reading.alias("readings"), F.lit("names").alias("source"))
        return _flat(cases.word_cases(etl.settled(words), seed.readings(spark), system))

    return run


def _word_sql_of(system: str, alphabet: str) -> str:
    """Names of the alphabet in full; each of its characters has a fixed sound or typing."""
    typed = _KEYS if system == "korean" else {c: seed.JAPANESE[c].split()[0] for c in alphabet}
    rows = f"""SELECT string_agg(k, '' ORDER BY i) AS input, string_agg(format('U+{{:X}}', unicode(ch)), ',' ORDER BY i) AS sourceEntry, name AS sourceText
  FROM (SELECT id, name, unnest(string_split(name, '')) AS ch, generate_subscripts(string_split(name, ''), 1) AS i FROM ({whole_names_sql(alphabet, 4)})) JOIN t USING (ch) GROUP BY id, name"""
    return f"WITH t(ch, k) AS ({_values(sorted(typed.items()))})\n" + _part(_own(rows), f"{system.upper()}-WORD-FULL", system, "WORD", "'EXACT'", "ROMAJI" if system == "japanese" else "BULSIK2", "'FULL'")


def _add(name: str, query: Query, sql: str) -> None:
    QUERIES[name], ORACLES[name] = query, sql


for _s in (*TABLES, "korean"):
    _v = ("FULL", "PARTIAL", "TONED") if _s in ("mandarin", "cantonese", "zhuyin") else ("FULL", "PARTIAL")
    _add(f"cases_char_{_s}", _cases(lambda w, r, s=_s, v=_v: cases.char_cases(r, s, v)), _char_sql(_s, _v))
    _add("cases_negative" if _s == "mandarin" else f"cases_negative_{_s}", _cases(lambda w, r, s=_s: cases.negative_cases(r, s)), _negative_sql(_s))
_add("cases_word_mandarin", _cases(lambda w, r: cases.word_cases(w, r)), _word_sql())
_add("cases_word_japanese", _word_cases("japanese", KANA_HAN), _word_sql_of("japanese", KANA_HAN))
_add("cases_word_korean", _word_cases("korean", HANGUL), _word_sql_of("korean", HANGUL))
for _s in keyboards.SCHEMES:
    _add(f"cases_shuangpin_{_s}", _cases(lambda w, r, s=_s: cases.shuangpin_cases(w, r, s)), _shuangpin_sql(_s))
_add("cases_equivalence", _cases(lambda w, r: cases.equivalence_cases(r)), _equivalence_sql())
for _s, _r in itertools.chain.from_iterable([(s, r) for r in fuzzy.rules_for(s)] for s in TABLES):
    _name = "cases_fuzzy" if (_s, _r) == ("mandarin", "FUZZY_ZH_Z") else f"cases_{_r.lower()}_{_s}"
    _add(_name, _cases(lambda w, r, s=_s, rule=_r: cases.fuzzy_cases(r, s, rule)), _fuzzy_sql(_s, _r))
_add("cases_scenarios", _cases(lambda w, r: cases.scenario_cases(w, r)), _scenario_sql())


def _korean(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of two lists, the second with words of the first and single characters."""
    word = lambda df, source: df.select(F.lit("korean").alias("system"), tx.to_codepoints(F.col("name")).alias("cps"), F.col("name").alias("text"), F.array(F.struct(F.col("name").alias("normalized"), F.col("name").alias("syllable"))).alias("readings"), F.lit(source).alias("source"))
    n = whole_names(spark, sf_dir, HANGUL, 4)
    first, second = word(n.where("id % 3 > 0"), "b-list"), word(n.withColumn("name", F.when(F.col("id") % 7 == 0, F.substring("name", -1, 1)).otherwise(F.col("name"))), "a-list")
    return etl.rebuilt_korean([seed.hangul(spark)], [first, second])[1].select("text", "source", F.size("cps").alias("chars"))


REBUILD["korean_rebuild"] = _korean
REBUILD_ORACLES["korean_rebuild"] = f"""
WITH n AS ({whole_names_sql(HANGUL, 4)}), w AS (SELECT name, 0 AS turn, 'b-list' AS source FROM n WHERE id % 3 > 0
  UNION ALL SELECT CASE WHEN id % 7 = 0 THEN right(name, 1) ELSE name END, 1, 'a-list' FROM n)
SELECT name AS text, arg_min(source, turn) AS source, CAST(length(name) AS INTEGER) AS chars FROM w WHERE length(name) >= 2 GROUP BY name"""
REBUILD["cases_negative_korean_long"] = _cases(lambda w, r: cases.negative_cases(r, "korean", 20_000, 20260714, longest=5))
REBUILD_ORACLES["cases_negative_korean_long"] = _negative_sql("korean", 20_000, 20260714, 5)
