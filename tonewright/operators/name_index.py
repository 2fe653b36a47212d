"""A standing index of names: spelt once, searched often.

Every place of a name where a match may begin is one row: (unit, id, name, suffix), with a unit for
each first letter that the place may be typed by. Rows are partitioned by unit and sorted, so a
search reads the partitions of its query's first letter alone, and checks there that the query
begins the suffix. A name is in as many rows as it has places and first letters, whatever is asked.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tonewright.functions import text as tx
from tonewright.model import MatchMode, Options, PolyphoneMode
from tonewright.operators.engine import Engine
from tonewright.operators.search import name_index
from tonewright.plans.compiler import forced_keys


@dataclass(frozen=True)
class NameIndex:
    """The index at ``path``, made under these options for this way of matching."""

    engine: Engine
    options: Options
    mode: MatchMode
    path: str

    @classmethod
    def build(cls, engine: Engine, options: Options, mode: MatchMode, names: DataFrame, path: str) -> NameIndex:
        """Spell (id, name) and write the index. Null names are in no index, empty ones in none
        but that of the empty query; a name put twice is found twice if its rows have different ids."""
        named = names.select("id", "name").where("name IS NOT NULL")
        keys = forced_keys(F.col("name"), options) if options.polyphone is PolyphoneMode.PRECISE else tx.chars(F.col("name"))
        units = name_index(engine, named, options).select("key", F.array_distinct(F.transform("surfaces", lambda s: F.substring(s, 1, 1))).alias("units"))
        every = F.posexplode(keys) if mode is MatchMode.CONTAINS else F.posexplode(F.slice(keys, 1, 1))
        places = named.select("id", "name", every.alias("at", "key")).join(units, "key")
        rows = places.select(F.explode("units").alias("unit"), "id", "name", F.substring("name", F.col("at") + 1, F.length("name")).alias("suffix"))
        # the empty query meets every name (an exact one the empty name): they lie under no unit
        whole = named.where("name = ''") if mode is MatchMode.EXACT else named
        rows = rows.union(whole.select(F.lit(""), "id", "name", F.col("name")))
        # code points name the folders, so letters of either case stay apart on any file system
        rows = rows.withColumn("unit", F.when(F.col("unit") == "", F.lit(-1)).otherwise(F.ascii("unit")))
        rows.hint("rebalance", "unit").sortWithinPartitions("unit", "suffix").write.mode("overwrite").partitionBy("unit").parquet(path)
        return cls(engine, options, mode, path)

    def rows_for(self, query: str) -> DataFrame:
        """The part of the index that a query reads."""
        table = self.engine.spark.read.schema("unit int, id long, name string, suffix string").parquet(self.path)
        return table.where(F.col("unit") == (ord(query[0]) if query else -1))

    def search(self, query: str) -> DataFrame:
        """(id, name) of the names that the query spells, each id once."""
        rows = self.rows_for(query)
        if query:
            compiled = self.engine.compile(query, self.options)
            if self.mode is MatchMode.CONTAINS and self.options.polyphone is not PolyphoneMode.PRECISE:
                rows = rows.where(compiled.begins(rows.suffix))
            else:  # forced readings hang on the whole name
                rows = rows.where(compiled.by(self.mode, rows.name))
        return rows.select("id", "name").dropDuplicates(["id"])
