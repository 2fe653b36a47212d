import itertools

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tonewright import seed
from tonewright.functions import text as tx
from tonewright.functions.keyboards import BULSIK2
from tonewright.model import MANDARIN, AbbrevPolicy, MatchMode, Options, PolyphoneMode, PolyphoneTable, TonePolicy
from tonewright.operators import engine as en
from tonewright.operators import polyphone, search
from tonewright.plans import compiler
from tonewright.streaming.predicates import matching

Q = en.mandarin_quanpin()
INITIALS = Q.but(abbrev=AbbrevPolicy.INITIALS)
PRECISE = Q.but(polyphone=PolyphoneMode.PRECISE, table=seed.POLYPHONES)
MULTI = Options(router=tx.by_block(MANDARIN), keyboard=BULSIK2)


@pytest.fixture(scope="module")
def engine(spark):
    return en.Engine(spark, seed.readings(spark).cache())


def test_predicates(spark, engine):
    C, B, X = MatchMode.CONTAINS, MatchMode.BEGINS, MatchMode.EXACT
    cases = [
        ("中国", "zhongguo", Q, C, True), ("中国", "ongg", Q, C, False), ("中国", "zhong", Q, X, False), ("中国", "guo", Q, B, False),
        ("中国", "zhg", INITIALS, C, True), ("中国", "zg", INITIALS, C, False), ("中国", "zg", INITIALS.but(fuzzies=("FUZZY_ZH_Z",)), C, True),
        ("", "", Q, X, True), ("a", "", Q, X, False), ("a", "", Q, C, True), ("", "a", Q, C, False), ("a中", "azhong", Q, X, True),
        ("中国", "zhong1guo2", Q.but(tone=TonePolicy.STRICT), X, True), ("中国", "zhong2", Q.but(tone=TonePolicy.STRICT), C, False),
        ("银行", "yinhang", PRECISE, C, True), ("银行", "yinxing", PRECISE, C, False), ("了", "liao", PRECISE, C, True),
        ("银行一行", "yinhangyixing", PRECISE, X, True), ("银行一行", "yinxingyihang", PRECISE, C, False), ("银行", "yinxing", Q, C, True),
        ("中한", "zhong", MULTI, C, True), ("中한", "gks", MULTI, C, True), ("中한", "naka", MULTI, C, False),
        ("𪚥", "𪚥", Q, C, False), ("banana", "a" + "z" * 32, Q, C, False), ("b" * 70, "b" * 66, Q, C, True),
    ]
    for text, query, options, mode, expected in cases:
        df = spark.createDataFrame([(text,)], "t string")
        assert df.select(engine.compile(query, options).by(mode, F.col("t"))).first()[0] is expected, (text, query, mode)


def test_literal_query_reaches_the_scan(engine):
    plan = str(engine.compile("ABC", Q).contains(F.col("t")))
    assert "contains" in plan.lower() and "rlike" not in plan.lower()


def _spell(name, abbrev):
    forms = []
    for c in name:
        own = {c}
        for r in seed.MANDARIN.get(c, "").split():
            s = r.rstrip("0123456789")
            own |= {s, s[:2] if s[:2] in ("zh", "ch", "sh") else s[:1]} if abbrev else {s}
        forms.append(own)
    return {"".join(p) for p in itertools.product(*forms)}


@settings(max_examples=12, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.text("中国大会人a", max_size=4), min_size=1, max_size=12), st.text("zhonguda中", min_size=1, max_size=5), st.booleans())
def test_strategies_agree_with_spelling_out(spark, engine, names, query, abbrev):
    compiled = engine.compile(query, INITIALS if abbrev else Q)
    df = spark.createDataFrame([(n,) for n in names], "t string")
    for mode in MatchMode:
        table = compiler.moves(query, compiled.lattice, mode.partial)
        cols = [compiled.by(mode, F.col("t"))]
        if table:
            keys = tx.chars(F.col("t"))
            cols += [(F.col("t") != "") & f(keys, len(query), table, mode) for f in (compiler._masked, compiler._listed)]
        for row in df.select("t", *[c.alias(f"c{i}") for i, c in enumerate(cols)]).collect():
            t = row[0]
            if mode is MatchMode.EXACT:
                expected = query in _spell(t, abbrev)
            else:
                starts = range(len(t)) if mode is MatchMode.CONTAINS else range(min(1, len(t)))
                expected = any(x.startswith(query) for i in starts for x in _spell(t[i:], abbrev))
            assert set(row[1:]) == {expected}, (t, query, mode)


def test_options():
    with pytest.raises(ValueError):
        Options()
    with pytest.raises(ValueError):
        Options(MANDARIN, router=tx.by_block(MANDARIN))
    with pytest.raises(ValueError):
        Options(MANDARIN, polyphone=PolyphoneMode.PRECISE)
    with pytest.raises(ValueError):
        PolyphoneTable.of({"银行": ["yin2"]})
    assert hash(Q) == hash(en.mandarin_quanpin()) and Q == en.mandarin_quanpin() and Q != INITIALS


def test_segment(spark):
    df = spark.createDataFrame([("银行一行红石粉红石",), ("",), ("无",)], "t string")
    rows = [r[0] for r in df.select(polyphone.segment(F.col("t"), seed.POLYPHONES)).collect()]
    assert rows == [["yin2", "hang2", "yi1", "xing2", "hong2", "shi2", "fen3", "hong2", "shi2"], [], [None]]
    assert polyphone.entries(spark, seed.POLYPHONES).count() == len(seed.POLYPHONES.words)


@pytest.mark.parametrize("mode", list(MatchMode))
@pytest.mark.parametrize("options", [Q, INITIALS, PRECISE], ids=["plain", "initials", "precise"])
def test_batch_search_is_single_search(spark, engine, mode, options):
    names = spark.createDataFrame([(0, "中国", 0), (1, "大会", 1), (2, "大人", 2), (3, "", 3), (4, "中华中国", 4), (5, "大会", 5), (6, "银行", 6)], "id long, name string, put_order int")
    asked = ["zhongguo", "da", "dah", "", "guo", "xing", "中国", "zhg"]
    queries = spark.createDataFrame(list(enumerate(asked)), "qid long, query string")
    searcher = search.Searcher.best(engine, mode, options, names)
    got = sorted(tuple(r) for r in searcher.search_all(queries).collect())
    expected = sorted((k, r.id) for k, q in enumerate(asked) for r in searcher.search(q).collect())
    assert got == expected


def test_batch_search_steps(spark, engine, monkeypatch):
    """A step is one join, with moves that lead from prefix to prefix, whether they are sent or not."""
    names = spark.createDataFrame([(0, "中国"), (1, "大会人"), (2, "人大"), (3, "国中国")], "id long, name string")
    queries = spark.createDataFrame([(0, "guo"), (1, "zhongg"), (2, "daihui"), (3, "r")], "qid long, query string")
    moves = search.query_moves(search.name_index(engine, names, Q), queries.select("query"), True)
    got = {(m.spelt, m.key, m.next, m.whole, m.full) for m in moves.collect()}
    assert got == {("", "国", "guo", True, True), ("", "大", "da", False, True), ("", "中", "zhong", False, True), ("zhong", "国", "zhongg", True, False), ("", "大", "dai", False, True), ("dai", "会", "daihui", True, True), ("", "人", "r", True, False)}
    plan = search.search_batch(engine, names, queries, Q)._jdf.queryExecution().optimizedPlan().toString()
    assert "RepartitionByExpression [id" in plan  # one task's names become work for all
    expected = {(0, 0), (0, 3), (1, 0), (1, 3), (2, 1), (3, 1), (3, 2)}
    for most in (search.SENT_MOVES, 0):
        monkeypatch.setattr(search, "SENT_MOVES", most)
        assert {tuple(r) for r in search.search_batch(engine, names, queries, Q).collect()} == expected


def test_put(spark, engine):
    s = search.Searcher.best(engine, MatchMode.CONTAINS, Q).put(spark.createDataFrame([(1, "中国"), (1, "中国")], "id long, name string"))
    assert s.search("guo").count() == 2
    with pytest.raises(Exception, match="0000"):
        s.put(spark.createDataFrame([(2, "a\0b")], "id long, name string")).search("zz").collect()


def test_stream(spark, engine, tmp_path):
    spark.createDataFrame([("中国",), ("美国",), ("x",)], "name string").write.parquet(str(tmp_path / "in"))
    hits = matching(spark.readStream.schema("name string").parquet(str(tmp_path / "in")), engine, "guo", Q, "name")
    q = hits.writeStream.format("memory").queryName("stream_hits").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "cp")).start()
    q.awaitTermination(60)
    assert {r.name for r in spark.table("stream_hits").collect()} == {"中国", "美国"}
