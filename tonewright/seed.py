"""A small table of readings, for tests and examples; real tables come as DataFrames."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tonewright.functions import romanize, text
from tonewright.model import READINGS, SYSTEMS, PolyphoneTable, ToneConvention

#: The digits of the keys that names are made of.
ALPHABET = "中国大会人民上下左右"
MANDARIN = {
    "中": "zhong1 zhong4", "国": "guo2", "大": "da4 dai4 tai4", "会": "hui4 kuai4", "人": "ren2", "民": "min2",
    "上": "shang4 shang3", "下": "xia4", "左": "zuo3", "右": "you4", "华": "hua2", "心": "xin1", "美": "mei3",
    "山": "shan1", "水": "shui3", "王": "wang2", "银": "yin2", "行": "xing2 hang2", "一": "yi1", "重": "zhong4 chong2",
    "要": "yao4", "新": "xin1", "了": "le liao3", "红": "hong2", "石": "shi2", "粉": "fen3", "长": "chang2 zhang3",
    "安": "an1", "岩": "yan2", "女": "nv3",
}
CANTONESE = {"我": "ngo5", "你": "nei5", "國": "gwok3", "中": "zung1 zung3", "人": "jan4"}
ZHUYIN = {"中": "ㄓㄨㄥ ㄓㄨㄥˋ", "国": "ㄍㄨㄛˊ", "人": "ㄖㄣˊ", "上": "ㄕㄤˋ", "了": "˙ㄌㄜ"}
JAPANESE = {"中": "chuu naka", "人": "jin hito", "国": "koku kuni", "風": "fuu kaze", "通": "tsuu"}
POLYPHONES = PolyphoneTable.of({
    "银行": ("yin2", "hang2"), "一行": ("yi1", "xing2"), "重要": ("zhong4", "yao4"), "重新": ("chong2", "xin1"),
    "红石粉": ("hong2", "shi2", "fen3"), "红石": ("hong2", "shi2"), "行长": ("hang2", "zhang3"),
    "大会": ("da4", "hui4"), "大人": ("da4", "ren2"), "会大": ("kuai4", "tai4"),
})


def rows() -> list[tuple]:
    """(system, cp, ord, normalized) of the tables above."""
    tables = {"mandarin": MANDARIN, "cantonese": CANTONESE, "zhuyin": ZHUYIN, "japanese": JAPANESE}
    return [(s, ord(c), i, r) for s, t in tables.items() for c, rs in t.items() for i, r in enumerate(rs.split())]


def hangul(spark: SparkSession) -> DataFrame:
    """A reading of each of the 11,172 Hangul syllables: itself."""
    cps = spark.range(text.HANGUL_FIRST, text.HANGUL_LAST + 1, 1, 1).selectExpr("CAST(id AS INT) AS cp")
    char = text.char_of(cps["cp"])
    return _complete(cps.selectExpr("'korean' AS system", "cp", "0 AS ord").withColumn("normalized", char))


def _complete(df: DataFrame) -> DataFrame:
    """The columns of a readings table from system, cp, ord and normalized."""
    from pyspark.sql import functions as F

    n = df["normalized"]
    syllable = n
    for s in SYSTEMS.values():
        if s.tones is not ToneConvention.NONE:
            syllable = F.when(df["system"] == s.name, text.strip_tone(n, s.tones)).otherwise(syllable)
    display = F.when(df["system"] == "mandarin", romanize.to_diacritic(n)).otherwise(n)
    tone = F.when(df["system"] == "zhuyin", text.zhuyin_tone(n)).otherwise(F.coalesce(F.regexp_extract(n, r"([0-9])\z", 1).try_cast("int"), F.lit(0)))
    out = df.select("system", "cp", "ord", display.alias("display"), "normalized", syllable.alias("syllable"), tone.alias("tone"), F.lit(0).cast("long").alias("freq"), F.array(F.lit("seed")).alias("sources"))
    return out.select(*[out[f.name].cast(f.dataType) for f in READINGS])


def readings(spark: SparkSession) -> DataFrame:
    """All seed readings with Hangul, as a readings table."""
    return _complete(spark.createDataFrame(rows(), "system string, cp int, ord int, normalized string")).union(hangul(spark))
