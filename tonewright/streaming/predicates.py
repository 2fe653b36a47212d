"""Phonetic predicates on streams: they hold no state, so they run as on tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tonewright.model import MatchMode, Options
from tonewright.operators.engine import Engine


def matching(stream: DataFrame, engine: Engine, query: str, options: Options, column: str, mode: MatchMode = MatchMode.CONTAINS) -> DataFrame:
    """The rows of a stream that a query spells; the query is compiled once, on the driver."""
    return stream.where(engine.compile(query, options).by(mode, F.col(column)))


def windowed_hits(stream: DataFrame, engine: Engine, query: str, options: Options, column: str, time: str, width: str = "1 hour", late: str = "10 minutes", mode: MatchMode = MatchMode.CONTAINS) -> DataFrame:
    """(window, hits) of matching rows; state of windows older than the watermark is dropped."""
    hits = matching(stream, engine, query, options, column, mode)
    return hits.withWatermark(time, late).groupBy(F.window(time, width)).agg(F.count(F.lit(1)).alias("hits"))
