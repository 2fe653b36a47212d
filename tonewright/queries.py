"""The registered phonetic queries and their DuckDB twins.

Names in Han characters are derived from keys, digit by digit, alike in both engines. The twin of
a predicate spells names out, every typed form of every character, by recursion over the name and
compares strings; it shares nothing with the query compiler.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tonewright import seed
from tonewright.functions import fuzzy, keyboards, romanize
from tonewright.functions import text as tx
from tonewright.model import AbbrevPolicy, MatchMode, Options, PolyphoneMode, PolyphoneTable, TonePolicy, ToneConvention
from tonewright.operators import cases, engine as en, etl, polyphone, search
from tonewright.operators.engine import Engine

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}

DIGITS = "0123456789"
WIDTH = 6
HAN = seed.ALPHABET
HANGUL = "가나다라마중한글객차"
KANA_HAN = "中人国風通" * 2
CANTON = "我你國中人" * 2
BOPOMOFO = "中国人上了" * 2
MIXED = "中한国글大a会객人1"
WORDY = "大会人大会人大会中国"
TABLE = PolyphoneTable.of({w: r for w, r in seed.POLYPHONES.words if set(w) <= set("大会人")})


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def names(spark: SparkSession, sf_dir: str, alphabet: str = HAN, width: int = WIDTH, table: str = "part", key: str = "p_partkey") -> DataFrame:
    """(id, name): keys written in an alphabet of ten characters."""
    k = F.col(key)
    return _table(spark, sf_dir, table).select(k.alias("id"), F.translate(F.lpad(k.cast("string"), width, "0"), DIGITS, alphabet).alias("name"))


def names_sql(alphabet: str = HAN, width: int = WIDTH, table: str = "part", key: str = "p_partkey") -> str:
    return f"SELECT {key} AS id, translate(lpad(CAST({key} AS VARCHAR), {width}, '0'), '{DIGITS}', '{alphabet}') AS name FROM {table}"


def whole_names(spark: SparkSession, sf_dir: str, alphabet: str = HAN, width: int = WIDTH) -> DataFrame:
    """(id, name) of part: keys in at least ``width`` characters; no digit of a longer one is cut off."""
    k = F.col("p_partkey").cast("string")
    padded = F.when(F.length(k) < width, F.lpad(k, width, "0")).otherwise(k)
    return etl.spread(_table(spark, sf_dir, "part").select("p_partkey"), "p_partkey").select(F.col("p_partkey").alias("id"), F.translate(padded, DIGITS, alphabet).alias("name"))


def whole_names_sql(alphabet: str = HAN, width: int = WIDTH) -> str:
    k = "CAST(p_partkey AS VARCHAR)"
    return f"SELECT p_partkey AS id, translate(lpad({k}, CAST(greatest({width}, length({k})) AS INTEGER), '0'), '{DIGITS}', '{alphabet}') AS name FROM part"


def _engine(spark: SparkSession) -> Engine:
    return Engine(spark, seed.readings(spark))


def _values(rows) -> str:
    q = lambda x: "NULL" if x is None else str(x) if isinstance(x, int) else "'" + x.replace("'", "''") + "'"
    return "VALUES " + ", ".join("(" + ", ".join(q(c) for c in r) + ")" for r in rows)


# ---- forms of characters, for the twins: plain Python over the seed tables


def _bare(r: str) -> str:
    return r.rstrip("0123456789")


def _zhuyin_bare(r: str) -> str:
    return r.rstrip("ˊˇˋ˙").lstrip("˙")


def _forms(table: dict[str, str], alphabet: str, form=_bare) -> list[tuple[str, str]]:
    """(character, typed form), every character standing for itself too."""
    out = {(c, c) for c in alphabet}
    for c in alphabet:
        for r in table.get(c, "").split():
            got = form(r)
            out |= {(c, f) for f in ([got] if isinstance(got, str) else got)}
    return sorted(out)


def _initial(s: str) -> str:
    return s[:2] if s[:2] in ("zh", "ch", "sh") else s[:1]


def _swap(s: str) -> list[str]:
    pairs = (("zh", "z"), ("ch", "c"), ("sh", "s"))
    for a, b in pairs:
        if s.startswith(a):
            return [s, b + s[2:]]
        if s.startswith(b):
            return [s, a + s[1:]]
    return [s]


def _nasal(s: str) -> list[str]:
    return [s] + ([s[:-1]] if s.endswith("ang") else [s + "g"] if s.endswith("an") else [])


def spelled_sql(source: str, forms: list[tuple[str, str]], query: str, mode: MatchMode, keys: str = "string_split(name, '')") -> str:
    """Names of ``source`` that some choice of forms spells the query with."""
    start = "unnest(range(1, len(ks) + 1))" if mode is MatchMode.CONTAINS else "1"
    hit = f"sp = '{query}' AND pos = len(ks) + 1" if mode is MatchMode.EXACT else f"starts_with(sp, '{query}')"
    return f"""
WITH RECURSIVE lat(k, form) AS ({_values(forms)}), n AS (SELECT id, name, {keys} AS ks FROM ({source})),
st AS (SELECT id, ks, {start} AS pos, '' AS sp FROM n),
ex AS (
  SELECT id, ks, CAST(pos AS BIGINT) AS pos, sp FROM st
  UNION
  SELECT id, ks, pos + 1, sp || form FROM ex JOIN lat ON lat.k = ks[pos]
  WHERE pos <= len(ks) AND length(sp) < {len(query)} AND starts_with('{query}', sp)
)
SELECT id, name FROM n WHERE id IN (SELECT id FROM ex WHERE {hit})"""


def _spell(name: str, options: Options, query: str, mode: MatchMode, forms: list[tuple[str, str]], alphabet: str = HAN) -> None:
    QUERIES[name] = lambda spark, sf: _engine(spark).search(names(spark, sf, alphabet), query, options, mode)
    ORACLES[name] = spelled_sql(names_sql(alphabet), forms, query, mode)


_Q = en.mandarin_quanpin()
_PLAIN = _forms(seed.MANDARIN, HAN)
for _mode in MatchMode:
    _m = _mode.value
    _spell(f"{_m}_quanpin", _Q, {"contains": "huiren", "begins": "zhongzhongg", "exact": "zhongzhongguodahuiren"}[_m], _mode, _PLAIN)
    _spell(f"{_m}_strict", _Q.but(tone=TonePolicy.STRICT), {"contains": "da4hui", "begins": "zhong1zhong4guo2", "exact": "zhong1zhong1zhong4da4tai4hui4"}[_m], _mode, _forms(seed.MANDARIN, HAN, lambda r: r))
    _spell(f"{_m}_abbrev", _Q.but(abbrev=AbbrevPolicy.INITIALS), {"contains": "shxiar", "begins": "zhzhongg", "exact": "zhzhgdhr"}[_m], _mode, _forms(seed.MANDARIN, HAN, lambda r: [_bare(r), _initial(_bare(r))]))
    _spell(f"{_m}_fuzzy", _Q.but(fuzzies=("FUZZY_ZH_Z", "FUZZY_SH_S", "FUZZY_ANG_AN")), {"contains": "sangx", "begins": "zongzhong", "exact": "zongzongzongguosangxia"}[_m], _mode, _forms(seed.MANDARIN, HAN, lambda r: sorted({*_swap(_bare(r)), *_nasal(_bare(r))})))
    _spell(f"{_m}_mixed_query", _Q, {"contains": "guo大hui", "begins": "中zhong国", "exact": "中中zhong中中guo"}[_m], _mode, _PLAIN)
_spell("contains_abbrev_fuzzy", _Q.but(abbrev=AbbrevPolicy.INITIALS, fuzzies=("FUZZY_ZH_Z",)), "zgd", MatchMode.CONTAINS,
       _forms(seed.MANDARIN, HAN, lambda r: sorted({f for s in ([_bare(r), "z" + _bare(r)[2:]] if r.startswith("zh") else [_bare(r), "zh" + _bare(r)[1:]] if r.startswith("z") else [_bare(r)]) for f in (s, _initial(s))})))

#: Codes of the alphabet's syllables, written out.
_CODES = {
    "flypy": "zhong=vs guo=go da=da dai=dd tai=td hui=hv kuai=kk ren=rf min=mb shang=uh xia=xx zuo=zo you=yz",
    "zrm": "zhong=vs guo=go da=da dai=dl tai=tl hui=hv kuai=ky ren=rf min=mn shang=uh xia=xw zuo=zo you=yb",
    "mspy": "zhong=vs guo=go da=da dai=dl tai=tl hui=hv kuai=ky ren=rf min=mn shang=uh xia=xw zuo=zo you=yb",
    "pyjj": "zhong=vy guo=go da=da dai=ds tai=ts hui=hv kuai=kx ren=rr min=ml shang=ig xia=xb zuo=zo you=yp",
    "abc": "zhong=as guo=go da=da dai=dl tai=tl hui=hm kuai=kc ren=rf min=mc shang=vh xia=xd zuo=zo you=yb",
}
for _s, _c in _CODES.items():
    _map = dict(x.split("=") for x in _c.split())
    _spell(f"contains_shuangpin_{_s}", en.mandarin_shuangpin(_s), _map["guo"] + _map["dai"] + _map["kuai"][:1], MatchMode.CONTAINS, _forms(seed.MANDARIN, HAN, lambda r, m=_map: m[_bare(r)]))
    QUERIES[f"shuangpin_encode_{_s}"] = lambda spark, sf, s=_s, m=tuple(_map): spark.createDataFrame([(x,) for x in m], "syllable string").select("syllable", keyboards.shuangpin_code(F.col("syllable"), s).alias("code"))
    ORACLES[f"shuangpin_encode_{_s}"] = f"SELECT * FROM ({_values(_map.items())}) AS t(syllable, code)"

_KEYS = {c: k for c, k in zip(HANGUL, "rk sk ek fk ak wnd gks rmf ror ck".split(), strict=True)}
_CHO = {c: k for c, k in zip(HANGUL, "r s e f a w g r r c".split(), strict=True)}
_spell("contains_bulsik2", en.korean_bulsik2(), "skekf", MatchMode.CONTAINS, _forms(_KEYS, HANGUL, lambda r: r), HANGUL)
_spell("begins_choseong", en.korean_choseong(), "rrsr", MatchMode.BEGINS, _forms(_CHO, HANGUL, lambda r: r), HANGUL)
_spell("contains_japanese", en.japanese_romaji(fuzzies=("FUZZY_LONG_VOWEL",)), "hitochu", MatchMode.CONTAINS,
       _forms(seed.JAPANESE, KANA_HAN, lambda r: sorted({r, r.replace("uu", "u")})), KANA_HAN)
_spell("contains_cantonese", en.cantonese_quanpin(fuzzies=("FUZZY_NG_OMIT", "FUZZY_GW_G", "FUZZY_N_L")), "oleig", MatchMode.CONTAINS,
       _forms({"我": "ngo o", "你": "nei lei", "國": "gwok gok", "中": "zung", "人": "jan"}, CANTON), CANTON)
_spell("contains_zhuyin", en.zhuyin(), "ㄍㄨㄛㄖㄣㄕ", MatchMode.CONTAINS, _forms(seed.ZHUYIN, BOPOMOFO, _zhuyin_bare), BOPOMOFO)
_spell("contains_zhuyin_strict", en.zhuyin(tone=TonePolicy.STRICT), "ㄖㄣˊㄕㄤˋ", MatchMode.CONTAINS, _forms(seed.ZHUYIN, BOPOMOFO, lambda r: r), BOPOMOFO)
_ROUTED = Options(router=tx.by_block(en.MANDARIN), keyboard=keyboards.BULSIK2)
_spell("contains_multi", _ROUTED, "zhonggksg", MatchMode.CONTAINS, _forms({c: " ".join(sorted({_bare(x) for x in seed.MANDARIN[c].split()})) for c in "中国大会人"} | {c: _KEYS[c] for c in "한글객"}, MIXED), MIXED)

_PRECISE = _Q.but(polyphone=PolyphoneMode.PRECISE, table=TABLE)
_TOKENS = "|".join(sorted((w for w, _ in TABLE.words), key=lambda w: (-len(w), w)))
_KEYED = "flatten(list_transform(regexp_extract_all(name, '" + _TOKENS + "|.'), lambda x: CASE x " + " ".join(
    f"WHEN '{w}' THEN [" + ", ".join(f"'{c}!{_bare(r)}'" for c, r in zip(w, rs, strict=True)) + "]" for w, rs in TABLE.words
) + " ELSE [x] END))"
_FORCED = _PLAIN + sorted({(f"{c}!{_bare(r)}", f) for w, rs in TABLE.words for c, r in zip(w, rs, strict=True) for f in (_bare(r), c)})
for _mode, _text in ((MatchMode.CONTAINS, "dahuirend"), (MatchMode.BEGINS, "dadadadah"), (MatchMode.EXACT, "dadadahuirenren")):
    QUERIES[f"{_mode.value}_precise"] = lambda spark, sf, q=_text, m=_mode: _engine(spark).search(names(spark, sf, WORDY), q, _PRECISE, m)
    ORACLES[f"{_mode.value}_precise"] = spelled_sql(names_sql(WORDY), _FORCED, _text, _mode, _KEYED)


def _segment(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = names(spark, sf_dir, WORDY)
    return n.select("id", F.array_join(polyphone.words_in(F.col("name"), TABLE), " ").alias("words"), F.array_join(polyphone.segment(F.col("name"), TABLE), " ", "-").alias("forced"))


QUERIES["segment_words"] = _segment
ORACLES["segment_words"] = f"""
SELECT id, array_to_string(list_filter(ts, lambda x: length(x) > 1), ' ') AS words,
  array_to_string(list_transform(ts, lambda x: CASE x {" ".join(f"WHEN '{w}' THEN '{' '.join(r)}'" for w, r in TABLE.words)} ELSE '-' END), ' ') AS forced
FROM (SELECT id, regexp_extract_all(name, '{_TOKENS}|.') AS ts FROM ({names_sql(WORDY)}))"""

# ---- literal predicates, which reach the scan


def _literal(name: str, table: str, column: str, key: str, query: str, mode: MatchMode) -> None:
    QUERIES[name] = lambda spark, sf: _engine(spark).search(_table(spark, sf, table).select(key, column), query, _Q, mode, column)
    test = {"contains": f"contains({column}, '{query}')", "begins": f"starts_with({column}, '{query}')", "exact": f"{column} = '{query}'"}[mode.value]
    ORACLES[name] = f"SELECT {key}, {column} FROM {table} WHERE {test}"


_literal("contains_literal", "documents", "text", "doc_id", "thonti", MatchMode.CONTAINS)
_literal("begins_literal", "customer", "c_mktsegment", "c_custkey", "BUILD", MatchMode.BEGINS)
_literal("exact_literal", "events", "event_type", "event_id", "click", MatchMode.EXACT)

# ---- scalar functions

_SYLLABLES = "zhong zi cha ca shi si ang an sheng shen jing jin nv lu jue que lve ngo ng nei lau gwok kwan gw chuu too tou shashin tsuchi chou hutu sya tya ji zi a er o ㄓㄨㄥ ㄗㄨ ㄔ ㄘㄚ ㄕㄤ ㄙ".split()


def _over(values: list[str], **columns) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return spark.createDataFrame([(v,) for v in values], "s string").select("s", *[f(F.col("s")).alias(k) for k, f in columns.items()])

    return run


def _case(cases_: list[tuple[str, str]]) -> str:
    return "CASE " + " ".join(f"WHEN {a} THEN {b}" for a, b in cases_) + " ELSE '' END"


def _swap_sql(a: str, b: str) -> str:
    return _case([(f"starts_with(s, '{a}')", f"'{b}' || substr(s, {len(a) + 1})"), (f"starts_with(s, '{b}')", f"'{a}' || substr(s, {len(b) + 1})")])


def _final_sql(a: str, b: str) -> str:
    return _case([(f"ends_with(s, '{a}')", f"left(s, length(s) - {len(a)}) || '{b}'"), (f"ends_with(s, '{b}')", f"left(s, length(s) - {len(b)}) || '{a}'")])


_RULE_SQL = {
    "FUZZY_ZH_Z": _swap_sql("zh", "z"), "FUZZY_CH_C": _swap_sql("ch", "c"), "FUZZY_SH_S": _swap_sql("sh", "s"),
    "FUZZY_ANG_AN": _final_sql("ang", "an"), "FUZZY_ENG_EN": _final_sql("eng", "en"), "FUZZY_ING_IN": _final_sql("ing", "in"),
    "FUZZY_U_V": _case([("NOT regexp_matches(s, '^[nljqxy]')", "''"), ("contains(substr(s, 2), 'u')", "s[1] || replace(substr(s, 2), 'u', 'v')"), ("contains(substr(s, 2), 'v')", "s[1] || replace(substr(s, 2), 'v', 'u')")]),
    "FUZZY_N_L": _case([("starts_with(s, 'ng')", "''"), ("starts_with(s, 'n')", "'l' || substr(s, 2)"), ("starts_with(s, 'l')", "'n' || substr(s, 2)")]),
    "FUZZY_NG_OMIT": _case([("starts_with(s, 'ng')", "substr(s, 3)")]),
    "FUZZY_GW_G": _case([("length(s) > 2 AND (starts_with(s, 'gw') OR starts_with(s, 'kw'))", "s[1] || substr(s, 3)")]),
    "FUZZY_ZY_ZH_Z": _swap_sql("ㄓ", "ㄗ"), "FUZZY_ZY_CH_C": _swap_sql("ㄔ", "ㄘ"), "FUZZY_ZY_SH_S": _swap_sql("ㄕ", "ㄙ"),
    "FUZZY_LONG_VOWEL": "array_to_string(list_sort(list_distinct(list_filter([CASE WHEN contains(s, 'uu') THEN replace(s, 'uu', 'u') END, CASE WHEN contains(s, 'oo') THEN replace(s, 'oo', 'o') END, CASE WHEN contains(s, 'ou') THEN replace(s, 'ou', 'o') END], lambda x: x IS NOT NULL))), ',')",
}
_HEPBURN = {"chuu": "tyuu", "shashin": "shasin,syashin", "tsuchi": "tsuti,tuchi", "chou": "tyou", "hutu": "futu,hutsu", "sya": "sha", "tya": "cha", "ji": "zi", "zi": "ji", "jin": "zin", "jing": "zing", "jue": "zyue", "shi": "si", "si": "shi", "cha": "tya"}
_RULE_SQL["FUZZY_HEPBURN_KUNREI"] = "CASE s " + " ".join(f"WHEN '{a}' THEN '{b}'" for a, b in _HEPBURN.items()) + " ELSE '' END"
for _r in fuzzy.rules():
    QUERIES[_r.lower()] = _over(_SYLLABLES, variants=lambda s, r=_r: F.array_join(F.array_sort(fuzzy.by_name(r)(s)), ","))
    ORACLES[_r.lower()] = f"SELECT s, {_RULE_SQL[_r]} AS variants FROM ({_values((x,) for x in _SYLLABLES)}) AS t(s)"

_TONED = "zhong1 zhong le liao3 nv3 gwok3 a5 11 ˙ㄌㄜ ㄍㄨㄛˊ ㄓㄨㄥ ㄕㄤˋ".split()
QUERIES["strip_tones"] = _over(_TONED, digit=lambda s: tx.strip_tone(s, ToneConvention.DIGIT), bopomofo=lambda s: tx.strip_tone(s, ToneConvention.ZHUYIN), every=tx.strip_all_tones, zhuyin_tone=tx.zhuyin_tone)
ORACLES["strip_tones"] = f"""SELECT s, regexp_replace(s, '[0-9]$', '') AS digit, regexp_replace(regexp_replace(s, '[ˊˇˋ˙]$', ''), '^˙', '') AS bopomofo,
  regexp_replace(s, '[1-5]+$', '') AS every, CAST(CASE WHEN contains(s, '˙') THEN 0 WHEN ends_with(s, 'ˊ') THEN 2 WHEN ends_with(s, 'ˇ') THEN 3 WHEN ends_with(s, 'ˋ') THEN 4 ELSE 1 END AS INTEGER) AS zhuyin_tone
FROM ({_values((x,) for x in _TONED)}) AS t(s)"""
QUERIES["initials"] = _over(_SYLLABLES, length=tx.initial_length, initial=tx.initial, dental=tx.dental_initial)
ORACLES["initials"] = f"""SELECT s, CAST(n AS INTEGER) AS length, CASE WHEN n = 0 THEN s ELSE left(s, n) END AS initial, CASE n WHEN 0 THEN s ELSE left(s, 1) END AS dental
FROM (SELECT s, CASE WHEN left(s, 2) IN ('zh', 'ch', 'sh') THEN 2 WHEN contains('{tx.ONE_LETTER_INITIALS}', left(s, 1)) THEN 1 ELSE 0 END AS n FROM ({_values((x,) for x in _SYLLABLES)}) AS t(s))"""
_MARKS = [("zhōng", "zhong1"), ("nǚ", "nv3"), ("lüè", "lve4"), ("ma", "ma"), ("xióng", "xiong2"), ("guì", "gui4"), ("liú", "liu2"), ("ér", "er2"), ("shuài", "shuai4"), ("lü", "lv")]
QUERIES["pinyin_marks"] = _over([a for a, _ in _MARKS], numeric=lambda s: romanize.to_numeric(s)["numeric"], back=lambda s: romanize.to_diacritic(romanize.to_numeric(s)["numeric"]))
ORACLES["pinyin_marks"] = f"SELECT s, n AS numeric, s AS back FROM ({_values(_MARKS)}) AS t(s, n)"
_KANA = [("きゃ", "kya"), ("がっこう", "gakkou"), ("ラーメン", "raamen"), ("ヴァ", "vua"), ("しょ", "sho"), ("コーヒー", "koohii"), ("っきゃ", "kkya"), ("ふじさん", "fujisan"), ("abcカ", "abcka")]
QUERIES["kana_romaji"] = _over([a for a, _ in _KANA], romaji=romanize.kana_to_romaji)
ORACLES["kana_romaji"] = f"SELECT s, r AS romaji FROM ({_values(_KANA)}) AS t(s, r)"
QUERIES["hangul_keys"] = _over([*HANGUL, "객차", "a한"], keys=keyboards.bulsik2, leads=keyboards.choseong)
ORACLES["hangul_keys"] = f"SELECT s, k AS keys, c AS leads FROM ({_values([(c, _KEYS[c], _CHO[c]) for c in HANGUL] + [('객차', 'rorck', 'rc'), ('a한', 'agks', 'ag')])}) AS t(s, k, c)"


def _codepoints(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = names(spark, sf_dir, MIXED)
    cps = tx.to_codepoints(F.col("name"))
    first = tx.format_codepoint(F.get(cps, F.lit(0)))
    return n.select("id", F.array_join(cps, ",").alias("cps"), tx.from_codepoints(cps).alias("name"), first.alias("first"), tx.parse_codepoint(first).alias("parsed"), F.array_join(F.transform(cps, lambda c: F.coalesce(tx.block_system(c, "mandarin"), F.lit("-"))), ",").alias("systems"))


QUERIES["codepoints"] = _codepoints
ORACLES["codepoints"] = f"""SELECT id, array_to_string(list_transform(cs, lambda c: CAST(unicode(c) AS VARCHAR)), ',') AS cps, name, 'U+' || lpad(upper(to_hex(unicode(cs[1]))), 4, '0') AS first,
  CAST(unicode(cs[1]) AS INTEGER) AS parsed, array_to_string(list_transform(cs, lambda c: CASE WHEN c IN ('a', '1') THEN '-' WHEN contains('{HAN}', c) THEN 'mandarin' ELSE 'korean' END), ',') AS systems
FROM (SELECT id, name, string_split(name, '') AS cs FROM ({names_sql(MIXED)}))"""

# ---- many queries at once

_MANY = {
    MatchMode.CONTAINS: ["huiren", "guod", "da", "zhonggu", "shangxia", "renmin", "zz", "xiazuoy", "tai", "左you"],
    MatchMode.BEGINS: ["zhong", "zhongzhongguo", "guo", "zhongda", "中zhong", "q"],
    MatchMode.EXACT: ["zhongzhongguodahuiren", "zhongzhongzhongguoguoguo", "zhongzhongzhongrenminshang", "zhong", "中中中中国国"],
}


def _batch(mode: MatchMode) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        asked = spark.createDataFrame(list(enumerate(_MANY[mode])), "qid long, query string")
        return search.search_batch(_engine(spark), names(spark, sf_dir), asked, _Q, mode)

    return run


for _mode in MatchMode:
    QUERIES[f"search_batch_{_mode.value}"] = _batch(_mode)
    _parts = [f"SELECT CAST({i} AS BIGINT) AS qid, id FROM ({spelled_sql(names_sql(), _PLAIN, q, _mode)})" for i, q in enumerate(_MANY[_mode])]
    ORACLES[f"search_batch_{_mode.value}"] = "\nUNION ALL\n".join(_parts)

# ---- dictionary build, over readings and words derived from the tables

_SOUNDS = "zhong1 zhong4 guo2 da4 dai4 tai4 hui4 kuai4 ren2 min2 shang4 shang3 xia4".split()


def _derived(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Readings of three sources: code points and sounds from lineitem's keys."""
    sounds = F.array(*[F.lit(s) for s in _SOUNDS])
    li = _table(spark, sf_dir, "lineitem").where("l_linenumber <= 3")
    n = F.get(sounds, ((F.col("l_partkey") * 7 + F.col("l_linenumber")) % len(_SOUNDS)).cast("int"))
    return li.select(
        F.lit("mandarin").alias("system"), (F.lit(0x4E00) + F.col("l_partkey") % 997).cast("int").alias("cp"), F.col("l_orderkey").cast("int").alias("ord"),
        n.alias("display"), n.alias("normalized"), F.regexp_replace(n, "[0-9]$", "").alias("syllable"), F.substring(n, -1, 1).cast("int").alias("tone"),
        F.col("l_quantity").cast("long").alias("freq"), F.array(F.concat(F.lit("s"), F.col("l_linenumber").cast("string"))).alias("sources"), F.col("l_linenumber").cast("int").alias("source_ord"),
    )


_DERIVED_SQL = f"""
SELECT CAST(19968 + l_partkey % 997 AS INTEGER) AS cp, CAST(l_orderkey AS INTEGER) AS o, l_linenumber AS so, CAST(l_quantity AS BIGINT) AS freq,
  (ARRAY[{", ".join(f"'{s}'" for s in _SOUNDS)}])[CAST((l_partkey * 7 + l_linenumber) % {len(_SOUNDS)} AS INTEGER) + 1] AS n FROM lineitem WHERE l_linenumber <= 3"""


def _upserted(spark: SparkSession, sf_dir: str) -> DataFrame:
    return etl.upsert(_derived(spark, sf_dir)).select("cp", "ord", "normalized", "syllable", "tone", "freq", F.array_join("sources", ",").alias("sources"))


QUERIES["upsert_readings"] = _upserted
ORACLES["upsert_readings"] = f"""
SELECT cp, CAST(row_number() OVER (PARTITION BY cp ORDER BY so, o, n) - 1 AS INTEGER) AS ord, n AS normalized, regexp_replace(n, '[0-9]$', '') AS syllable,
  CAST(right(n, 1) AS INTEGER) AS tone, freq, sources FROM (
  SELECT cp, n, min(so) AS so, arg_min(o, CAST(so AS BIGINT) * 1000000000 + o) AS o, max(freq) AS freq, array_to_string(list_sort(list_distinct(list('s' || so))), ',') AS sources
  FROM ({_DERIVED_SQL}) GROUP BY cp, n)"""


def _checked(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = _derived(spark, sf_dir)
    a, b = (etl.reading_sets(d.where(F.col("source_ord") == k), "mandarin") for k in (1, 2))
    return etl.cross_check(a, b)[0]


QUERIES["cross_check"] = _checked
ORACLES["cross_check"] = f"""
WITH d AS ({_DERIVED_SQL}), a AS (SELECT cp, list(DISTINCT n) AS r FROM d WHERE so = 1 GROUP BY cp), b AS (SELECT cp, list(DISTINCT n) AS r FROM d WHERE so = 2 GROUP BY cp)
SELECT count(*) AS compared, count(*) FILTER (NOT list_has_any(a.r, b.r)) AS disagreements, coalesce(count(*) FILTER (NOT list_has_any(a.r, b.r)) / count(*), 0.0)::DOUBLE AS rate FROM a JOIN b USING (cp)"""


def _capped(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = _derived(spark, sf_dir).select("syllable", "cp").distinct()
    index = etl.inverted_index(d, "cp", "syllable")
    got = d.join(index, "syllable").withColumn("c", etl.capped(F.col("keys"), F.col("cp")))
    return got.select("syllable", "cp", F.array_join("c.expected", ",").alias("expected"), F.col("c.total").alias("total"))


QUERIES["inverted_index_cap"] = _capped
ORACLES["inverted_index_cap"] = f"""
WITH d AS (SELECT DISTINCT regexp_replace(n, '[0-9]$', '') AS syllable, cp FROM ({_DERIVED_SQL})), i AS (SELECT syllable, list_sort(list(cp)) AS keys FROM d GROUP BY syllable)
SELECT syllable, cp, array_to_string(([cp] || list_filter(keys, lambda k: k <> cp))[1:24], ',') AS expected, CAST(len(keys) AS INTEGER) AS total FROM d JOIN i USING (syllable)"""


def _derived_words(spark: SparkSession, sf_dir: str, whole: bool = False) -> DataFrame:
    """Names as words, with the sounds that some of their digits really have."""
    n = whole_names(spark, sf_dir, HAN, 4) if whole else etl.spread(names(spark, sf_dir, HAN, 4), "id")
    sound = lambda c, i: F.when((F.col("id") + i) % 5 == 0, "xia4").otherwise(F.try_element_at(F.create_map(*[F.lit(x) for c in HAN for x in (c, seed.MANDARIN[c].split()[0])]), c))
    n = etl.settled(n.select("id", "name", F.transform(tx.chars(F.col("name")), sound).alias("said")))
    reading = F.transform("said", lambda r: F.struct(r.alias("normalized"), F.regexp_replace(r, "[0-9]$", "").alias("syllable")))
    return etl.settled(n.select("id", F.lit("mandarin").alias("system"), tx.to_codepoints(F.col("name")).alias("cps"), F.col("name").alias("text"), reading.alias("readings"), F.lit("names").alias("source")))


def _reproducible(spark: SparkSession, sf_dir: str, whole: bool = False) -> DataFrame:
    got = etl.reproducible(_derived_words(spark, sf_dir, whole), seed.readings(spark))
    return got.select("id", "text", F.array_join(F.transform("readings", lambda r: r["syllable"]), "").alias("spoken"))


QUERIES["word_reproducible"] = _reproducible
QUERIES["word_reproducible_whole_keys"] = lambda spark, sf: _reproducible(spark, sf, True)
ORACLES["word_reproducible"] = f"""
WITH h(ch, first) AS ({_values((c, _bare(seed.MANDARIN[c].split()[0])) for c in HAN)}), r(ch, syl) AS ({_values(sorted({(c, _bare(x)) for c in HAN for x in seed.MANDARIN[c].split()}))}),
p AS (SELECT id, name, unnest(string_split(name, '')) AS ch, generate_subscripts(string_split(name, ''), 1) - 1 AS i FROM ({names_sql(HAN, 4)})),
s AS (SELECT id, name, i, ch, CASE WHEN (id + i) % 5 = 0 THEN 'xia' ELSE first END AS syl FROM p JOIN h USING (ch))
SELECT id, name AS text, string_agg(s.syl, '' ORDER BY i) AS spoken FROM s LEFT JOIN r ON r.ch = s.ch AND r.syl = s.syl GROUP BY id, name HAVING bool_and(r.syl IS NOT NULL)"""

ORACLES["word_reproducible_whole_keys"] = ORACLES["word_reproducible"].replace(names_sql(HAN, 4), whole_names_sql(HAN, 4))

QUERIES["negatives_anti"] = lambda spark, sf: _table(spark, sf, "part").select(F.col("p_partkey").alias("id"), F.translate(F.substring(F.md5(F.col("p_partkey").cast("string").cast("binary")), 1, 2), DIGITS, "ghijklmnop").alias("input")).join(cases.prefix_universe(seed.readings(spark), "mandarin"), "input", "left_anti").select("id", "input")
ORACLES["negatives_anti"] = f"""
WITH f(s) AS ({_values(sorted({(f,) for v in seed.MANDARIN.values() for r in v.split() for f in (r, _bare(r))}))}), u AS (SELECT DISTINCT left(s, n) AS input FROM f, range(1, 8) AS t(n))
SELECT id, input FROM (SELECT p_partkey AS id, translate(left(md5(CAST(p_partkey AS VARCHAR)), 2), '{DIGITS}', 'ghijklmnop') AS input FROM part) WHERE input NOT IN (SELECT input FROM u)"""

_COUNTS = {"mandarin": seed.MANDARIN, "cantonese": seed.CANTONESE, "zhuyin": seed.ZHUYIN, "japanese": seed.JAPANESE}
QUERIES["dictionary_counts"] = lambda spark, sf: etl.statistics(seed.readings(spark), _derived_words(spark, sf))
ORACLES["dictionary_counts"] = f"""SELECT system, CAST(chars AS BIGINT) AS chars, CASE system WHEN 'mandarin' THEN (SELECT count(*) FROM part) ELSE 0 END AS words
FROM ({_values([(s, len(t)) for s, t in _COUNTS.items()] + [('korean', 11172)])}) AS t(system, chars)"""
QUERIES["equivalents_intersect"] = lambda spark, sf: etl.equivalents(seed.readings(spark))
ORACLES["equivalents_intersect"] = f"SELECT CAST(unicode(c) AS INTEGER) AS cp FROM ({_values((c,) for c in sorted(set(seed.MANDARIN) & set(seed.ZHUYIN)))}) AS t(c)"


def _lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    cps = names(spark, sf_dir, MIXED, 4).select("id", F.ascii(F.substring("name", 4, 1)).alias("cp"))
    got = _engine(spark).char_entry(cps, en.MANDARIN)
    return got.select("id", "cp", F.array_join(F.transform("readings", lambda r: r["normalized"]), ",").alias("readings"))


QUERIES["char_lookup"] = _lookup
ORACLES["char_lookup"] = f"""
WITH r(cp, readings) AS ({_values((ord(c), ",".join(v.split())) for c, v in seed.MANDARIN.items())})
SELECT id, CAST(unicode(right(name, 1)) AS INTEGER) AS cp, readings FROM ({names_sql(MIXED, 4)}) LEFT JOIN r ON r.cp = unicode(right(name, 1))"""



def _lookup_whole(spark: SparkSession, sf_dir: str) -> DataFrame:
    cps = whole_names(spark, sf_dir, MIXED, 4).select("id", F.ascii(F.substring("name", -1, 1)).alias("cp"))
    return _engine(spark).char_entry(cps, en.MANDARIN).select("id", "cp", F.array_join(F.transform("readings", lambda r: r["normalized"]), ",").alias("readings"))


QUERIES["char_lookup_whole_keys"] = _lookup_whole
ORACLES["char_lookup_whole_keys"] = ORACLES["char_lookup"].replace(names_sql(MIXED, 4), whole_names_sql(MIXED, 4))

# ---- the same over every line of lineitem: all its line numbers are sources


def _all_lines(spark: SparkSession, sf_dir: str, sources: int = 7) -> DataFrame:
    """Readings of ``sources`` sources that every line of lineitem is dealt to."""
    sounds = F.array(*[F.lit(s) for s in _SOUNDS])
    n = F.get(sounds, ((F.col("l_partkey") * 7 + F.col("l_linenumber")) % len(_SOUNDS)).cast("int"))
    so = ((F.col("l_linenumber") - 1) % sources + 1).cast("int")
    return _table(spark, sf_dir, "lineitem").select(
        F.lit("mandarin").alias("system"), (F.lit(0x4E00) + F.col("l_partkey") % 997).cast("int").alias("cp"), F.col("l_orderkey").cast("int").alias("ord"),
        n.alias("display"), n.alias("normalized"), F.regexp_replace(n, "[0-9]$", "").alias("syllable"), F.substring(n, -1, 1).cast("int").alias("tone"),
        F.col("l_quantity").cast("long").alias("freq"), F.array(F.concat(F.lit("s"), so.cast("string"))).alias("sources"), so.alias("source_ord"),
    )


def _all_lines_sql(sources: int = 7) -> str:
    return f"""
SELECT CAST(19968 + l_partkey % 997 AS INTEGER) AS cp, CAST(l_orderkey AS INTEGER) AS o, (l_linenumber - 1) % {sources} + 1 AS so, CAST(l_quantity AS BIGINT) AS freq,
  (ARRAY[{", ".join(f"'{s}'" for s in _SOUNDS)}])[CAST((l_partkey * 7 + l_linenumber) % {len(_SOUNDS)} AS INTEGER) + 1] AS n FROM lineitem"""


QUERIES["upsert_readings_all_lines"] = lambda spark, sf: etl.upsert(_all_lines(spark, sf)).select("cp", "ord", "normalized", "syllable", "tone", "freq", F.array_join("sources", ",").alias("sources"))
ORACLES["upsert_readings_all_lines"] = ORACLES["upsert_readings"].replace(_DERIVED_SQL, _all_lines_sql())


def _checked_all_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of odd numbers against those of even ones."""
    d = _all_lines(spark, sf_dir, 2)
    a, b = (etl.reading_sets(d.where(F.col("source_ord") == k), "mandarin") for k in (1, 2))
    return etl.cross_check(a, b)[0]


QUERIES["cross_check_all_lines"] = _checked_all_lines
ORACLES["cross_check_all_lines"] = ORACLES["cross_check"].replace(_DERIVED_SQL, _all_lines_sql(2))


def _capped_all_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = _all_lines(spark, sf_dir).select("syllable", "cp").distinct()
    got = d.join(etl.inverted_index(d, "cp", "syllable"), "syllable").withColumn("c", etl.capped(F.col("keys"), F.col("cp")))
    return got.select("syllable", "cp", F.array_join("c.expected", ",").alias("expected"), F.col("c.total").alias("total"))


QUERIES["inverted_index_cap_all_lines"] = _capped_all_lines
ORACLES["inverted_index_cap_all_lines"] = ORACLES["inverted_index_cap"].replace(_DERIVED_SQL, _all_lines_sql())
