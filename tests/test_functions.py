import pytest
from pyspark.sql import functions as F

from tonewright.functions import fuzzy, keyboards, romanize
from tonewright.functions import text as tx
from tonewright.model import ToneConvention


def over(spark, values, f):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, s string")
    return [r[0] for r in df.orderBy("i").select(f(F.col("s"))).collect()]


def test_codepoints(spark):
    assert over(spark, ["中𪚥a", "", None], tx.to_codepoints) == [[20013, 0x2A6A5, 97], [], None]
    assert over(spark, ["中𪚥a", ""], lambda s: tx.from_codepoints(tx.to_codepoints(s))) == ["中𪚥a", ""]
    assert over(spark, ["U+4E2D", "u+2a6a5", "x", "U+", "U+XY"], tx.parse_codepoint) == [0x4E2D, 0x2A6A5, -1, -1, -1]
    assert over(spark, ["U+4E2D, U+61", "U+61,x"], tx.parse_codepoints) == [[0x4E2D, 0x61], None]
    assert over(spark, ["a", "中", "𪚥"], lambda s: tx.format_codepoint(F.ascii(s))) == ["U+0061", "U+4E2D", "U+2A6A5"]


def test_tones(spark):
    strip = lambda t: lambda s: tx.strip_tone(s, t)
    assert over(spark, ["zhong1", "ma", "a55", "1"], strip(ToneConvention.DIGIT)) == ["zhong", "ma", "a5", ""]
    assert over(spark, ["ㄍㄨㄛˊ", "˙ㄌㄜ", "ㄓㄨㄥ"], strip(ToneConvention.ZHUYIN)) == ["ㄍㄨㄛ", "ㄌㄜ", "ㄓㄨㄥ"]
    assert over(spark, ["zhong1"], strip(ToneConvention.NONE)) == ["zhong1"]
    assert over(spark, ["de5", "zhong1", "lv"], lambda s: tx.mandarin_reading(s)["normalized"]) == ["de", "zhong1", "lv"]


def test_initials(spark):
    assert over(spark, ["zhong", "zi", "an", "er", "shi", ""], tx.initial_length) == [2, 1, 0, 0, 2, 0]
    assert over(spark, ["zhong", "zi", "an"], tx.initial) == ["zh", "z", "an"]
    assert over(spark, ["zhong", "ci", "an"], tx.dental_initial) == ["z", "c", "an"]


def test_router(spark):
    got = over(spark, list("한にカㄅ中𪚥a1"), lambda s: tx.block_system(F.ascii(s), "cantonese"))
    assert got == ["korean", "japanese", "japanese", "zhuyin", "cantonese", "cantonese", None, None]


def test_keyboards(spark):
    assert over(spark, ["가", "한", "중", "객차", "a", ""], keyboards.bulsik2) == ["rk", "gks", "wnd", "rorck", "a", None]
    assert over(spark, ["한글"], keyboards.choseong) == ["gr"]
    for scheme, code in {"flypy": "vsgo", "zrm": "vsgo", "pyjj": "vygo", "abc": "asgo", "mspy": "vsgo"}.items():
        assert "".join(over(spark, ["zhong", "guo"], lambda s, c=scheme: keyboards.shuangpin_code(s, c))) == code
    assert over(spark, ["bing", "a", "xx", "hng"], lambda s: keyboards.shuangpin_code(s, "MSPY")) == ["b;", "oa", None, "hng"]
    with pytest.raises(ValueError):
        keyboards.shuangpin("none")


@pytest.mark.parametrize(
    "rule, given, expected",
    [
        ("FUZZY_HEPBURN_KUNREI", "hutu", {"futu", "hutsu"}),
        ("FUZZY_HEPBURN_KUNREI", "chuu", {"tyuu"}),
        ("FUZZY_NG_OMIT", "ngo", {"o"}),
        ("FUZZY_NG_OMIT", "ng", set()),
        ("FUZZY_GW_G", "gwo", {"go"}),
        ("FUZZY_GW_G", "gu", set()),
        ("FUZZY_U_V", "lue", {"lve"}),
        ("FUZZY_U_V", "bu", set()),
        ("FUZZY_N_L", "ngo", set()),
        ("FUZZY_LONG_VOWEL", "tou", {"to"}),
        ("FUZZY_ZY_ZH_Z", "ㄗㄨ", {"ㄓㄨ"}),
    ],
)
def test_rules(spark, rule, given, expected):
    assert set(over(spark, [given], fuzzy.by_name(rule))[0]) == expected


def test_rules_dont_compose(spark):
    got = over(spark, ["zhang"], lambda s: fuzzy.variants(s, ("FUZZY_ZH_Z", "FUZZY_ANG_AN")))[0]
    assert got == ["zhang", "zang", "zhan"]
    assert len(fuzzy.rules()) == 15 and fuzzy.by_name("fuzzy_zh_z") is None
    with pytest.raises(ValueError):
        fuzzy.variants(F.lit("a"), ("NO_RULE",))


def test_romanize(spark):
    assert over(spark, ["nv3", "gui4", "liu2", "ma5", "lve4"], romanize.to_diacritic) == ["nǚ", "guì", "liú", "ma", "lüè"]
    assert over(spark, ["zhōng", "nǚ"], lambda s: romanize.to_numeric(s)["numeric"]) == ["zhong1", "nv3"]
    assert over(spark, ["がっこう", "しゃ", "ラー", "x", ""], romanize.kana_to_romaji) == ["gakkou", "sha", "raa", "x", ""]
