"""Searchers over tables of names: one query as a filter, many queries as joins."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tonewright.functions import text as tx
from tonewright.model import MatchMode, Options, PolyphoneMode
from tonewright.operators.engine import Engine
from tonewright.operators.etl import spread
from tonewright.plans.compiler import FORCED, forced_keys


@dataclass(frozen=True)
class Searcher:
    """Names bound to options and one way of matching. ``names`` has id and name; results come
    in ``put_order`` if the table has that column."""

    engine: Engine
    options: Options
    mode: MatchMode
    names: DataFrame

    @classmethod
    def best(cls, engine: Engine, mode: MatchMode, options: Options, names: DataFrame | None = None) -> Searcher:
        """A searcher, empty unless names are given; strategies are chosen by query, not here."""
        if names is None:
            names = engine.spark.createDataFrame([], "id long, name string")
        return cls(engine, options, mode, names)

    def put(self, names: DataFrame) -> Searcher:
        """With more names; a name put twice is found twice. U+0000 in a name is an error."""
        checked = names.withColumn("name", F.when(F.instr("name", "\0") > 0, F.raise_error(F.lit("a name holds U+0000"))).otherwise(F.col("name")))
        return Searcher(self.engine, self.options, self.mode, self.names.unionByName(checked, allowMissingColumns=True))

    def search(self, query: str) -> DataFrame:
        """Rows whose name the query spells: a filter on the scan of names."""
        out = self.engine.search(self.names, query, self.options, self.mode)
        return out.orderBy("put_order") if "put_order" in out.columns else out

    def search_all(self, queries: DataFrame) -> DataFrame:
        return search_batch(self.engine, self.names, queries, self.options, self.mode)


def name_index(engine: Engine, names: DataFrame, options: Options) -> DataFrame:
    """(key, surfaces): what each key that occurs in names may be typed as, itself included.

    A key is a character, or in precise mode also a character with a forced syllable; the table
    is as large as the names' alphabet, not as the names.
    """
    keys = forced_keys(F.col("name"), options) if options.polyphone is PolyphoneMode.PRECISE else tx.chars(F.col("name"))
    found = names.select(F.explode(keys).alias("key")).distinct()
    found = found.select("key", F.substring("key", 1, 1).alias("ch"), F.when(F.contains("key", F.lit(FORCED)), F.substring_index("key", FORCED, -1)).alias("forced"))
    lat = engine.lattice(options)
    every = lat.groupBy("ch").agg(F.collect_list(F.struct("ord", "syllable", "surfaces", "initials")).alias("readings"))
    r = F.array_sort("readings")
    same = F.filter(r, lambda x: x["syllable"] == F.col("forced"))
    chosen = F.when(F.col("forced").isNotNull() & (F.size(same) > 0), F.slice(same, 1, 1)).otherwise(r)
    forms = lambda x: F.concat(x["surfaces"], F.transform(F.arrays_zip(x["surfaces"], x["initials"]), lambda z: F.substring(z["surfaces"], F.lit(1), z["initials"])))
    typed = F.filter(F.flatten(F.transform(chosen, forms)), lambda s: s != "")
    literal = F.when(F.ascii("ch") <= 0xFFFF, F.array("ch")).otherwise(F.array().cast("array<string>"))
    # full forms may end a query early, initials may not: they are the same prefixes anyway
    return found.join(every, "ch", "left").select("key", F.array_distinct(F.concat(F.coalesce(typed, F.array().cast("array<string>")), literal)).alias("surfaces"))


#: Moves from a prefix of a query to a longer one up to which their table is sent to every task.
SENT_MOVES = 200_000
#: Steps after which equal spellings of a name are merged.
MERGE_STEPS = 4


def query_moves(index: DataFrame, texts: DataFrame, partial: bool) -> DataFrame:
    """(spelt, key, next, whole, full): from a prefix of some query, by a key, to a longer prefix.

    ``whole``: that prefix is a query; ``full``: the key's form is typed to its end (else the query
    ends inside it). As large as the queries' prefixes times the keys that sound alike.
    """
    cut = lambda c, n: F.substring(c, F.lit(1), n)
    ends = F.transform(F.sequence(F.lit(1), F.length("query")), lambda n: F.struct(cut(F.col("query"), n).alias("next"), (n == F.length("query")).alias("whole")))
    targets = texts.select(F.inline(ends)).groupBy("next").agg(F.max("whole").alias("whole"))
    parted = F.transform(F.sequence(F.lit(0), F.length("next") - 1), lambda n: F.struct(cut(F.col("next"), n).alias("spelt"), F.substring("next", n + 1, F.length("next")).alias("form")))
    typed = index.select("key", F.explode("surfaces").alias("s")).where("s <> ''")
    if partial:
        forms = typed.select("key", F.inline(F.transform(F.sequence(F.lit(1), F.length("s")), lambda n: F.struct(cut(F.col("s"), n).alias("form"), (n == F.length("s")).alias("full")))))
    else:
        forms = typed.select("key", F.col("s").alias("form"), F.lit(True).alias("full"))
    moves = targets.select("next", "whole", F.inline(parted)).join(forms, "form").where("full OR whole")
    return moves.groupBy("spelt", "key", "next").agg(F.max("whole").alias("whole"), F.max("full").alias("full"))


def search_batch(engine: Engine, names: DataFrame, queries: DataFrame, options: Options, mode: MatchMode = MatchMode.CONTAINS) -> DataFrame:
    """(qid, id) of all queries (qid, query) against all names (id, name).

    Names are spelt from each place a match may start at, a character at a time; what has been
    spelt stays only while it is a prefix of some query. Every step is one join by equality, of the
    spelling and the next character with the moves between the queries' prefixes. So work follows
    the spellings that lead somewhere, never names times queries, and there are as many steps as
    the longest query or name has characters. Found spellings pass through later steps as they
    are, so that all steps are one plan. The moves are sent to every task while they are counted to
    be few, and joined by shuffle beyond. Names are dealt over all tasks first.
    """
    queries = queries.select("qid", "query")
    named = spread(names.select("id", "name"), "id")
    blank = queries.where("query = ''").select("qid")
    every = named.where("name = ''") if mode is MatchMode.EXACT else named
    asked = queries.where("query <> ''")
    texts = asked.select("query").distinct()
    longest = texts.agg(F.coalesce(F.max(F.length("query")), F.lit(0))).first()[0]
    moves = query_moves(name_index(engine, named, options), texts, mode.partial)
    if moves.limit(SENT_MOVES + 1).count() <= SENT_MOVES:
        moves = F.broadcast(moves)
    keys = forced_keys(F.col("name"), options) if options.polyphone is PolyphoneMode.PRECISE else tx.chars(F.col("name"))
    spelt = named.where("name <> ''").select("id", keys.alias("keys"))
    if mode is MatchMode.EXACT:
        spelt = spelt.where(F.size("keys") <= longest)
    starts = F.sequence(F.lit(1), F.size("keys")) if mode is MatchMode.CONTAINS else F.array(F.lit(1))
    # no match takes more characters than its query has
    state = spelt.select("id", F.explode(F.transform(starts, lambda i: F.slice(F.col("keys"), i, F.lit(longest)))).alias("keys"), F.lit("").alias("spelt"), F.lit(False).alias("done"))
    steps = min(longest, named.agg(F.coalesce(F.max(F.length("name")), F.lit(0))).first()[0]) if longest else 0
    for at in range(1, steps + 1):
        # found spellings have keys that no character has, a different one for each name
        key = F.when(F.col("done"), F.concat(F.lit("\x02-"), F.xxhash64("id").cast("string"))).otherwise(F.get("keys", F.lit(at - 1)))
        ends = F.size("keys") == at if mode is MatchMode.EXACT else F.lit(True)
        found = F.when(F.col("whole") & ends, F.struct(F.col("next").alias("spelt"), F.lit(True).alias("done")))
        goes_on = F.when(F.col("full") & (F.size("keys") > at), F.struct(F.col("next").alias("spelt"), F.lit(False).alias("done")))
        as_is = F.array(F.struct("spelt", "done"))
        step = state.withColumn("key", key).join(moves, ["spelt", "key"], "left").where("done OR next IS NOT NULL")
        state = step.select("id", "keys", F.inline(F.when(F.col("done"), as_is).otherwise(F.array_compact(F.array(found, goes_on)))))
        # what is found needs its name's characters no more
        state = state.withColumn("keys", F.when(~F.col("done"), F.col("keys")))
        if at % MERGE_STEPS == 0:
            state = state.distinct()
    out = state.where("done").select("id", "spelt").distinct().join(asked.withColumnRenamed("query", "spelt"), "spelt").select("qid", "id")
    if blank.isEmpty():
        return out
    ids = [r.qid for r in blank.collect()]
    return out.union(every.select(F.explode(F.array(*[F.lit(i) for i in ids])).alias("qid"), "id"))
