import json

from pyspark.sql import functions as F

from tonewright import seed
from tonewright.functions import text as tx
from tonewright.model import MANDARIN, READINGS
from tonewright.operators import cases, etl, validate
from tonewright.sources import loaders, sinks


def put(tmp_path, name, text):
    p = tmp_path / name
    p.write_text(text, encoding="utf-8")
    return str(p)


def test_char_table_round_trip(spark, tmp_path):
    path = put(tmp_path, "c.tsv", "# head\n\nU+4E2D\t中\ta\tzhong1, zhong4,\t1,4\t0\tx\nU+4E2D\t中\ta\tzhong1\t1\n\nbad\nU+XY\ta\tb\tc1\t1\nU+56FD\t国\tguó\t\t2\nU+20000\t𠀀\tx\thou4\t4\n")
    df = loaders.char_table(spark, path, MANDARIN)
    assert [(r.cp, r.ord, r.normalized, r.syllable, r.tone) for r in df.orderBy("cp").collect()] == [(0x4E2D, 0, "zhong1", "zhong", 1), (0x20000, 0, "hou4", "hou", 4)]
    own = seed.readings(spark).where("system = 'mandarin'")
    out = str(tmp_path / "out")
    sinks.write_lines(sinks.char_lines(own, "mandarin"), out)
    back = loaders.char_table(spark, out, MANDARIN)
    key = lambda d: sorted((r.cp, r.ord, r.normalized) for r in d.collect())
    assert key(back) == key(own)


def test_polyphone_rows(spark, tmp_path):
    path = put(tmp_path, "p.tsv", "# c\nU+94F6,U+884C\t银行\tyin2, hang2\tx\t0.9\nno tab\nU+4E00\t一\tyi1,er4\n")
    assert loaders.polyphone_table(spark, path).words == (("银行", ("yin2", "hang2")),)
    out = str(tmp_path / "out")
    sinks.write_lines(sinks.polyphone_lines(spark, seed.POLYPHONES), out)
    assert loaders.polyphone_table(spark, out) == seed.POLYPHONES


def test_sources(spark, tmp_path):
    u = put(tmp_path, "u.txt", "# x\nU+4E2D\tkMandarin\tzhōng\nU+4E2D\tkHanyuPinyin\t10028.100:zhōng,zhòng\nU+4E2D\tkHanyuPinlu\tzhōng(4875) zhòng(66)\nU+4E2D\tkCantonese\tzung1 zung3\nU+4E2D\tkHangul\t중:0E\n")
    rows = {(r.system, r.normalized, r.freq) for r in etl.upsert(loaders.unihan(spark, u).drop("line")).collect()}
    assert rows == {("mandarin", "zhong1", 4875), ("mandarin", "zhong4", 66), ("cantonese", "zung1", 0), ("cantonese", "zung3", 0), ("korean", "중", 0)}
    p = put(tmp_path, "m.txt", "U+4E2D: zhōng,zhòng  # 中\nx\n")
    assert loaders.pinyin_list(spark, p).first().readings == ["zhong1", "zhong4"]
    c = put(tmp_path, "c.u8", "# CC\n銀行 银行 [yin2 hang2] /bank/\n女兒 女儿 [nu:3 er5] /x/\nbroken\n")
    words = {r.text: [x.normalized for x in r.readings] for r in loaders.cedict(spark, c).collect()}
    assert words == {"银行": ["yin2", "hang2"], "女儿": ["nv3", "er"]}
    j = put(tmp_path, "j.json", json.dumps({"我": {"ngo5": 7}, "ab": {"x1": 1}}, ensure_ascii=False))
    assert [(r.cp, r.normalized, r.freq) for r in loaders.cantonese_chars(spark, j).collect()] == [(ord("我"), "ngo5", 7)]
    j2 = put(tmp_path, "j2.json", json.dumps([{"char": "我", "jyutping": ["ngo5", "o5"]}, {"entry": "你", "jyut": "nei5"}], ensure_ascii=False))
    assert {(r.cp, r.normalized) for r in loaders.cantonese_chars(spark, j2).collect()} == {(ord("我"), "ngo5"), (ord("我"), "o5"), (ord("你"), "nei5")}
    w = put(tmp_path, "w.tsv", "headword\tjyutping\n我你\tngo5 nei5\nx\n")
    assert [r.text for r in loaders.cantonese_words(spark, w).collect()] == ["我你"]
    h = put(tmp_path, "h.csv", "﻿樂園,낙원\n,x\n")
    assert [(r.text, r.cps) for r in loaders.hanja_words(spark, h).collect()] == [("낙원", [ord("樂"), ord("園")])]
    k = put(tmp_path, "k.txt", "나라 10\n가 9\nab 3\n")
    assert [r.text for r in loaders.hangul_words(spark, k).collect()] == ["나라"]


def test_xml(spark, tmp_path):
    k = put(tmp_path, "k.xml", '<k><character><literal>中</literal><reading_meaning><rmgroup><reading r_type="ja_on">チュウ</reading><reading r_type="ja_kun">なか.ば</reading><reading r_type="pinyin">zhong1</reading></rmgroup></reading_meaning></character></k>')
    assert [r.normalized for r in loaders.kanji(spark, k).orderBy("ord").collect()] == ["chuu", "nakaba"]
    j = put(tmp_path, "j.xml", "<J><entry><k_ele><keb>中国</keb></k_ele><r_ele><reb>ちゅうごく</reb></r_ele></entry><entry><r_ele><reb>x</reb></r_ele></entry></J>")
    assert [(r.text, r.readings[0].normalized) for r in loaders.japanese_words(spark, j).collect()] == [("中国", "chuugoku")]


def _words(spark):
    rows = [("中国大会人", "zhong1 guo2 da4 hui4 ren2"), ("中国", "zhong1 guo2"), ("山水", "shan1 shui3"), ("沿儿", "yanr2"), ("大会", "dai4 hui2")]
    df = spark.createDataFrame([(t, [(x, x[:-1]) for x in r.split()]) for t, r in rows], "text string, readings array<struct<normalized:string,syllable:string>>")
    return df.select(F.lit("mandarin").alias("system"), tx.to_codepoints(F.col("text")).alias("cps"), "text", "readings", F.lit("t").alias("source"))


def test_build(spark):
    r = seed.readings(spark).where("system <> 'korean'")
    assert {w.text for w in etl.reproducible(_words(spark), r).collect()} == {"中国大会人", "中国", "山水", "大会"}
    assert {w.text for w in etl.reproducible(_words(spark), r, toned=True).collect()} == {"中国大会人", "中国", "山水"}
    twice = etl.upsert(etl.merge_sources(r, r))
    assert sorted(map(str, twice.collect())) == sorted(map(str, r.select(*READINGS.names).collect()))
    report, bad = etl.cross_check(spark.createDataFrame([(1, ["a"]), (2, ["b"]), (3, ["c"])], "cp int, r array<string>"), spark.createDataFrame([(1, ["a", "x"]), (2, ["y"])], "cp int, r array<string>"))
    assert tuple(report.first()) == (2, 1, 0.5) and [b.cp for b in bad.collect()] == [2]
    more = spark.createDataFrame([(ord("国"), "guō"), (1, "a")], "cp int, display string")
    assert {x.normalized for x in etl.supplement(r, more).where(F.col("cp") == ord("国")).where("system = 'mandarin'").collect()} == {"guo2", "guo1"}
    z = etl.derive_zhuyin(r, spark.createDataFrame([(ord("大"), 0, "ㄉㄚˋ")], "cp int, ord int, display string"))
    assert [(x.syllable, x.tone) for x in z.where(F.col("cp") == ord("大")).where("system = 'zhuyin'").collect()] == [("ㄉㄚ", 4)]


def test_first_keys(spark, monkeypatch):
    """Rows get their own key and the least others; no array holds all keys of a surface."""
    pairs = [("a", f"k{i:03}") for i in range(60)] + [("b", f"k{i:03}") for i in range(3)] + [("a", "k001")]
    df = spark.createDataFrame(pairs, "input string, key string")
    rows = df.withColumnRenamed("key", "sourceEntry")
    expected = []
    for s, k in pairs:
        every = sorted({x for t, x in pairs if t == s})
        expected.append((s, k, ([k] + [x for x in every if x != k])[:24], len(every)))
    for hot in (etl.HOT_KEYS, 10):
        monkeypatch.setattr(etl, "HOT_KEYS", hot)
        got = etl.with_first_keys(rows, df, "input", "sourceEntry").select("input", "sourceEntry", "expected", "expectedTotal")
        assert sorted(map(tuple, got.collect())) == sorted(expected)
    made = cases.word_cases(_words(spark), seed.readings(spark))
    assert "collect_set" not in made._jdf.queryExecution().optimizedPlan().toString()


def test_words_are_tested_where_they_lie(spark, monkeypatch):
    """Few kinds of missing readings: no word is shuffled; many: the same words by a join."""
    r = seed.readings(spark).where("system <> 'korean'")
    odd = spark.createDataFrame([("mandarin", [20013], "中", [(None, None)], "t"), (None, [20013], "中", [("zhong1", "zhong")], "t"), (None, [], "", [], "t")], "system string, cps array<int>, text string, readings array<struct<normalized:string,syllable:string>>, source string")
    words = _words(spark).union(odd)
    texts = lambda toned: sorted((w.text, w.system or "") for w in etl.reproducible(words, r, toned).collect())
    assert "Exchange" not in etl.reproducible(words, r)._jdf.queryExecution().executedPlan().toString()
    near = texts(False), texts(True)
    assert [len(x) for x in near] == [5, 4]
    monkeypatch.setattr(etl, "FEW_KINDS", 0)
    assert (texts(False), texts(True)) == near


def test_spread(spark):
    """Rows of one file are dealt over all tasks before anything is asked of them."""
    one = spark.range(100_000, numPartitions=1)
    df = etl.spread(one, "id").where("id % 7 > 0").select((F.col("id") * 2).alias("x"))
    lines = df._jdf.queryExecution().executedPlan().toString().splitlines()
    at = lambda word: next(i for i, x in enumerate(lines) if word in x)
    assert at("Filter") < at("Exchange") and df.count() == 85_714
    assert sum(df.rdd.mapPartitions(lambda rows: [any(True for _ in rows)]).collect()) > 4


def test_cases_match(spark):
    """Every positive case finds its source, every negative doesn't, by the engine itself."""
    from tonewright.functions import keyboards
    from tonewright.model import AbbrevPolicy, MatchMode, TonePolicy
    from tonewright.operators import engine as en

    r = seed.readings(spark).where("system = 'mandarin'").cache()
    e = en.Engine(spark, r)
    made = cases.scenario_cases(_words(spark), r).unionByName(cases.word_cases(_words(spark), r)).unionByName(cases.shuangpin_cases(_words(spark), r, "flypy"))
    rows = made.where("sourceText IS NOT NULL").collect()
    assert {x.polarity for x in rows} == {"POSITIVE", "NEGATIVE"} and len({x.id for x in rows}) > 100
    picked = sorted(rows, key=lambda x: x.id)[:: max(1, len(rows) // 60)]
    cols = []
    for x in picked:
        o = en.mandarin_quanpin(keyboard=keyboards.by_name(x.keyboard), fuzzies=tuple(x.fuzzies), abbrev=AbbrevPolicy.INITIALS if x.variant == "ABBREV" else AbbrevPolicy.OFF, tone=TonePolicy.STRICT if x.variant == "TONED" else TonePolicy.IGNORE)
        cols.append(e.compile(x.input, o).by(MatchMode[x.mode], F.lit(x.sourceText)))
    got = spark.range(1).select(*[c.alias(f"c{i}") for i, c in enumerate(cols)]).first()
    assert [bool(g) for g in got] == [x.polarity == "POSITIVE" for x in picked]


def test_validation(spark, tmp_path):
    r = seed.readings(spark).where("system = 'mandarin'")
    made = cases.fuzzy_cases(r, "mandarin", "FUZZY_ZH_Z").unionByName(cases.char_cases(r, "mandarin"))
    assert validate.unreachable_fuzzy(made, r).isEmpty() and validate.lost_sources(made).isEmpty() and validate.bad_tones(r).isEmpty()
    broken = made.withColumn("input", F.lit("qqq"))
    assert not validate.unreachable_fuzzy(broken, r).isEmpty()
    assert {x.check: x.ok for x in validate.report(r, _words(spark), made).collect()}["chars-mandarin"] is False
    assert cases.negative_cases(r, "mandarin", 200).join(cases.prefix_universe(r, "mandarin"), "input").isEmpty()
    sinks.write_cases(made, str(tmp_path / "cases"))
    back = loaders.cases(spark, str(tmp_path / "cases"))
    assert back.count() == made.count() and 0 < loaders.cases(spark, str(tmp_path / "cases"), 0.5).count() < back.count()
    sinks.write_keymaps(r, str(tmp_path / "maps"))
    assert "files" in json.loads(sinks.manifest_json(spark, str(tmp_path / "cases"), stats={"totalCases": 1}))
