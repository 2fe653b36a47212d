"""Registered queries over whole tables, against their twins on small tables."""

import duckdb
import pytest

from helpers import asked, found
from tonewright import case_queries as cq
from tonewright import queries as q
from tonewright.operators import cases, etl


def tables(spark, tmp_path):
    lines = [(o, 37 * o + 11 * n, n, float(o % 50 + n)) for o in range(1, 200) for n in range(1, 8) if n <= o % 7 + 1]
    spark.createDataFrame(lines, "l_orderkey long, l_partkey long, l_linenumber int, l_quantity double").write.parquet(f"{tmp_path}/lineitem.parquet")
    parts = [(k,) for k in (1, 42, 999, 1000, 9999, 10_000, 10_001, 12_345, 12_346, 123_456, 1_234_567)]
    spark.createDataFrame(parts, "p_partkey long").write.parquet(f"{tmp_path}/part.parquet")
    con = duckdb.connect()
    for t in ("lineitem", "part"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{tmp_path}/{t}.parquet/*.parquet'")
    return str(tmp_path), con


def twin(con, name):
    return asked(con, q.ORACLES[name])


def test_all_lines(spark, tmp_path):
    sf, con = tables(spark, tmp_path)
    for name in ("upsert_readings_all_lines", "cross_check_all_lines", "inverted_index_cap_all_lines"):
        assert found(q.QUERIES[name](spark, sf)) == twin(con, name), name
    seen = {s for r in q.QUERIES["upsert_readings_all_lines"](spark, sf).collect() for s in r.sources.split(",")}
    assert seen == {f"s{k}" for k in range(1, 8)}


def test_whole_keys(spark, tmp_path):
    sf, con = tables(spark, tmp_path)
    for name in ("word_reproducible_whole_keys", "char_lookup_whole_keys"):
        assert found(q.QUERIES[name](spark, sf)) == twin(con, name), name
    for width in (4, 6):
        got = q.whole_names(spark, sf, width=width).collect()
        assert len({r.name for r in got}) == len(got) == 11
        assert all(int(r.name.translate(str.maketrans(q.HAN, q.DIGITS))) == r.id and len(r.name) >= width for r in got)


@pytest.mark.parametrize("name", sorted(cq.QUERIES))
def test_cases(spark, tmp_path, name):
    sf, con = tables(spark, tmp_path)
    got = found(cq.QUERIES[name](spark, sf))
    assert got == asked(con, cq.ORACLES[name])
    assert got or name == "cases_fuzzy_zy_ch_c_zhuyin"  # no seed syllable has these initials


def test_every_kind_of_case_has_a_query(spark, tmp_path):
    """The union of all kinds is what the queries give, id by id."""
    sf, _ = tables(spark, tmp_path)
    words = q._derived_words(spark, sf, True).drop("id")
    whole = {r.id for r in cases.all_cases(words, q.seed.readings(spark)).select("id").collect()}
    parts = {r.id for n in cq.QUERIES if n not in ("cases_word_japanese", "cases_word_korean") for r in cq.QUERIES[n](spark, sf).select("id").collect()}
    assert whole == parts


@pytest.mark.parametrize("name", sorted(cq.REBUILD))
def test_rebuild(spark, tmp_path, name):
    sf, con = tables(spark, tmp_path)
    got = found(cq.REBUILD[name](spark, sf))
    assert got and got == asked(con, cq.REBUILD_ORACLES[name])


def test_every_query_is_registered():
    import __spark_entry__ as entry

    assert entry.queries().keys() >= q.QUERIES.keys() | cq.QUERIES.keys() | cq.REBUILD.keys()
    assert entry.oracle_sql().keys() >= cq.ORACLES.keys() | cq.REBUILD_ORACLES.keys()


def test_first_words(spark):
    rows = [("mandarin", [1], "a", [("x1", "x")], s) for s in ("two", "one", "three")] + [("mandarin", [2], "b", [("y1", "y")], "two")]
    df = spark.createDataFrame(rows, "system string, cps array<int>, text string, readings array<struct<normalized:string,syllable:string>>, source string").repartition(3)
    assert sorted((r.text, r.source) for r in etl.first_words(df).collect()) == [("a", "one"), ("b", "two")]
