import pytest
from pyspark.sql import functions as F

from tonewright import seed
from tonewright.functions import text as tx
from tonewright.functions.keyboards import BULSIK2
from tonewright.model import MANDARIN, AbbrevPolicy, MatchMode, Options, PhoneticSystem, PolyphoneMode
from tonewright.operators import cases, etl, validate
from tonewright.operators import engine as en
from tonewright.operators.name_index import NameIndex
from tonewright.sources import sinks
from tonewright.sources.catalogue import Catalogue

Q = en.mandarin_quanpin()


def words_of(spark, *pairs):
    rows = [("mandarin", [ord(c) for c in t], t, [(r, r.rstrip("0123456789")) for r in rs.split()], "s") for t, rs in pairs]
    return spark.createDataFrame(rows, "system string, cps array<int>, text string, readings array<struct<normalized:string,syllable:string>>, source string")


def as_file(df, folder, path):
    """A single-file table where the catalogue looks for it."""
    sinks.write_lines(df, str(folder / "made"))
    (part,) = (folder / "made").glob("part-*.txt")
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_bytes(part.read_bytes())
    for f in (folder / "made").iterdir():
        f.unlink()


def test_catalogue(spark, tmp_path):
    r = seed.readings(spark)
    as_file(sinks.char_lines(r, "mandarin"), tmp_path, tmp_path / "data/mandarin/chars.tsv")
    as_file(sinks.word_lines(words_of(spark, ("中国", "zhong1 guo2")), "mandarin"), tmp_path, tmp_path / "data/mandarin/words.tsv")
    lines = (tmp_path / "data/mandarin/chars.tsv").read_text().splitlines()
    assert lines[0].startswith("# codepoint") and lines[1:] == sorted(lines[1:], key=lambda x: int(x.split("\t")[0][2:], 16))
    c = Catalogue(spark, [f"file://{tmp_path}/none", f"file://{tmp_path}/data"])
    assert c.open_resource("mandarin/chars.tsv").endswith("/data/mandarin/chars.tsv") and c.open_resource("x") is None
    assert not c.is_loaded(MANDARIN)
    assert c.load(MANDARIN, "japanese") is c and c.is_loaded("mandarin") and c.is_loaded("japanese")
    assert c.char_count("mandarin") == len(seed.MANDARIN) and c.char_count("japanese") == 0
    key = lambda x: (x.cp, x.ord, x.normalized, x.syllable, x.tone)
    assert sorted(map(key, c.readings([MANDARIN]).collect())) == sorted(map(key, r.where("system = 'mandarin'").collect()))
    assert [(w.text, [x.syllable for x in w.readings]) for w in c.words().collect()] == [("中国", ["zhong", "guo"])]
    names = spark.createDataFrame([(1, "中国"), (2, "丘"), (3, "大")], "id long, name string")
    assert [x.id for x in c.engine(Q).search(names, "zhongguo", Q).collect()] == [1]
    c.put_char(MANDARIN, "丘", "qiu1").put_char(MANDARIN, "大", "tai9").add_word(MANDARIN, "丘大", "qiu1", "tai9")
    assert [x.id for x in c.engine(Q).search(names, "qiu", Q).collect()] == [2]
    assert c.engine(Q).search(names, "da", Q).count() == 0 and c.engine(Q).search(names, "tai", Q).count() == 1
    assert c.words().count() == 2
    with pytest.raises(ValueError):
        c.add_word(MANDARIN, "丘大", "qiu1")
    assert not c.clear_data(MANDARIN).is_loaded(MANDARIN) and c.readings().count() == 0
    own = PhoneticSystem("mine")
    c.put_char(own, "石", "rock")
    assert [x.id for x in c.engine(Options(own)).search(spark.createDataFrame([(7, "石")], "id long, name string"), "roc", Options(own)).collect()] == [7]
    routed = Catalogue(spark, str(tmp_path / "data")).load_for(Options(router=tx.by_block(MANDARIN), keyboard=BULSIK2))
    assert all(routed.is_loaded(s) for s in ("mandarin", "korean"))


@pytest.mark.parametrize("mode", list(MatchMode))
@pytest.mark.parametrize("options", [Q, Q.but(abbrev=AbbrevPolicy.INITIALS), Q.but(polyphone=PolyphoneMode.PRECISE, table=seed.POLYPHONES)], ids=["plain", "initials", "precise"])
def test_name_index(spark, tmp_path, mode, options):
    names = spark.createDataFrame([(0, "中国"), (1, "大会"), (2, "大人"), (3, ""), (4, "中华中国"), (5, "大会"), (6, "银行"), (7, "aA中"), (8, None)], "id long, name string")
    engine = en.Engine(spark, seed.readings(spark).where("system = 'mandarin'"))
    index = NameIndex.build(engine, options, mode, names, str(tmp_path / "index"))
    for query in ("zhongguo", "da", "dah", "", "guo", "xing", "hang", "中国", "zhg", "A", "a", "q"):
        wanted = sorted(r.id for r in engine.search(names.where("name IS NOT NULL"), query, options, mode).collect())
        assert sorted(r.id for r in index.search(query).collect()) == wanted, query
    plan = index.rows_for("guo")._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(unit" in plan


def test_korean_rebuild(spark):
    word = lambda t, s: ("korean", [ord(c) for c in t], t, [(t, t)], s)
    schema = "system string, cps array<int>, text string, readings array<struct<normalized:string,syllable:string>>, source string"
    first = spark.createDataFrame([word("가나", "b"), word("다라", "b")], schema)
    second = spark.createDataFrame([word("가나", "a"), word("마", "a"), word("바사", "a")], schema)
    hangul = seed.hangul(spark)
    more = hangul.where("cp = 44032").withColumn("normalized", F.lit("다른")).withColumn("syllable", F.lit("다른"))
    chars, words = etl.rebuilt_korean([hangul, more, hangul], [first, second])
    assert sorted((w.text, w.source) for w in words.collect()) == [("가나", "b"), ("다라", "b"), ("바사", "a")]
    assert [x.normalized for x in chars.where("cp = 44032").orderBy("ord").collect()] == ["가", "다른"] and chars.count() == 11_173
    made = cases.korean_cases(words, chars.where("cp < 44100"), 300)
    assert {x.polarity for x in made.select("polarity").distinct().collect()} == {"POSITIVE", "NEGATIVE"}
    assert max(len(x.input) for x in made.where("polarity = 'NEGATIVE'").collect()) == 5
    assert made.where("level = 'WORD' AND mode = 'EXACT'").count() == 3


def test_regression_and_samples(spark, tmp_path):
    r = seed.readings(spark).where("system = 'mandarin'").cache()
    words = words_of(spark, ("中国大会人", "zhong1 guo2 da4 hui4 ren2"), ("山水", "shan1 shui3"), ("大会", "da4 hui4"))
    cases.write_regression(words, r, str(tmp_path / "regression"))
    back = spark.read.json(str(tmp_path / "regression"))
    assert back.count() == cases.scenario_cases(words, r).count() and back.select("kind").distinct().count() == 6
    engine = en.Engine(spark, r)
    made = cases.char_cases(r, "mandarin").unionByName(cases.shuangpin_cases(words, r, "flypy"))
    assert validate.failing_samples(made, engine, 5).collect() == []
    wrong = made.limit(1).withColumn("id", F.lit("wrong")).withColumn("input", F.lit("qqq"))
    assert [x.id for x in validate.failing_samples(wrong, engine).collect()] == ["wrong"]
    manifest, listed = (spark.createDataFrame([(p,) for p in ps], "path string") for ps in (["a", "b"], ["a", "c"]))
    got = {x.check: (x.value, x.ok) for x in validate.report(r, words, wrong, manifest=manifest, listed=listed, engine=engine).collect()}
    assert got["missing-files"] == (1.0, False) and got["failing-samples"] == (1.0, False)
