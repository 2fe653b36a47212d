"""A built data set as one object: which systems are loaded, and what has been put in by hand.

A data set is a folder, on any file system that Spark reads, of ``<system>/chars.tsv``,
``<system>/words.tsv`` and ``<scheme>/keymap.tsv``. Nothing is read before an action asks for it.
"""

from __future__ import annotations

from collections.abc import Iterable, Sequence
from functools import reduce

from pyspark.sql import DataFrame, SparkSession

from tonewright.model import READINGS, SYSTEMS, WORDS, Options, PhoneticSystem
from tonewright.operators.engine import Engine
from tonewright.sources import loaders


class Catalogue:
    """Systems of data sets below ``roots``; of several roots the first that has a file gives it."""

    def __init__(self, spark: SparkSession, roots: str | Sequence[str]):
        self.spark = spark
        self.roots = [roots] if isinstance(roots, str) else list(roots)
        self._chars: dict[str, list[DataFrame]] = {}
        self._words: dict[str, list[DataFrame]] = {}
        self._systems: dict[str, PhoneticSystem] = dict(SYSTEMS)

    def open_resource(self, name: str) -> str | None:
        """The path of a file of the data set, None if no root has it."""
        jvm = self.spark.sparkContext._jvm
        for root in self.roots:
            path = f"{root.rstrip('/')}/{name}"
            where = jvm.org.apache.hadoop.fs.Path(path)
            if where.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).exists(where):
                return path
        return None

    def is_loaded(self, system: PhoneticSystem | str) -> bool:
        return _name(system) in self._chars

    def load(self, *systems: PhoneticSystem | str) -> Catalogue:
        """Take up systems that aren't loaded yet; one without files is loaded and empty."""
        for given in systems:
            name = _name(given)
            if isinstance(given, PhoneticSystem):
                self._systems[name] = given
            if name in self._chars:
                continue
            system = self._systems.get(name) or PhoneticSystem(name)
            chars, words = self.open_resource(f"{name}/chars.tsv"), self.open_resource(f"{name}/words.tsv")
            self._chars[name] = [loaders.char_table(self.spark, chars, system)] if chars else []
            self._words[name] = [loaders.word_table(self.spark, words, system)] if words else []
        return self

    def load_for(self, options: Options) -> Catalogue:
        """Load the systems that options can route to."""
        return self.load(*options.systems)

    def put_char(self, system: PhoneticSystem, char: str, *readings: str) -> Catalogue:
        """Add a character by hand; it takes the place of what a file says of it."""
        self.load(system)
        self._chars[system.name].append(loaders.char_rows(self.spark, [(char, 0, list(readings))], system))
        return self

    def add_word(self, system: PhoneticSystem, text: str, *readings: str) -> Catalogue:
        """Add a word with a reading for each of its characters."""
        self.load(system)
        if len(readings) != len(text):
            raise ValueError(f"{text!r} has {len(text)} characters and {len(readings)} readings")
        self._words[system.name].append(loaders.word_rows(self.spark, [(text, list(readings))], system))
        return self

    def clear_data(self, system: PhoneticSystem | str) -> Catalogue:
        """Forget a system: it isn't loaded any more."""
        self._chars.pop(_name(system), None)
        self._words.pop(_name(system), None)
        return self

    def readings(self, systems: Iterable[PhoneticSystem | str] | None = None) -> DataFrame:
        """Readings of loaded systems. Of a character's rows the table that came last counts."""
        tables = [(k, df) for s in self._asked(systems) for k, df in enumerate(self._chars[s])]
        return loaders.last_wins([df.select(*READINGS.names) for _, df in tables], ("system", "cp")) if tables else self.spark.createDataFrame([], READINGS)

    def words(self, systems: Iterable[PhoneticSystem | str] | None = None) -> DataFrame:
        """Words of loaded systems, in no order."""
        tables = [df.select(*WORDS.names) for s in self._asked(systems) for df in self._words[s]]
        return reduce(DataFrame.union, tables) if tables else self.spark.createDataFrame([], WORDS)

    def char_count(self, system: PhoneticSystem | str) -> int:
        return self.readings([system]).select("cp").distinct().count()

    def engine(self, options: Options | None = None) -> Engine:
        """An engine over the systems of some options, or over all that are loaded."""
        if options is not None:
            self.load_for(options)
        return Engine(self.spark, self.readings(), None if options is None else options.systems)

    def _asked(self, systems: Iterable[PhoneticSystem | str] | None) -> list[str]:
        return [s for s in (list(self._chars) if systems is None else map(_name, systems)) if s in self._chars]


def _name(system: PhoneticSystem | str) -> str:
    return system if isinstance(system, str) else system.name
