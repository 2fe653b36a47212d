"""Systems, options and enumerations of the phonetic engine."""

from __future__ import annotations

import dataclasses
from collections.abc import Callable, Mapping
from dataclasses import dataclass, field
from enum import Enum

from pyspark.sql import Column
from pyspark.sql import types as T


class MatchMode(Enum):
    """How a query lies in a text."""

    CONTAINS = "contains"
    BEGINS = "begins"
    EXACT = "exact"

    @property
    def partial(self) -> bool:
        """Whether the query may end inside a syllable."""
        return self is not MatchMode.EXACT


#: What a searcher's logic is called; the same three ways.
SearcherLogic = MatchMode


class TonePolicy(Enum):
    IGNORE = "ignore"
    STRICT = "strict"


class AbbrevPolicy(Enum):
    OFF = "off"
    INITIALS = "initials"


class PolyphoneMode(Enum):
    OFF = "off"
    PRECISE = "precise"


class ToneConvention(Enum):
    """How a normalized reading carries its tone."""

    NONE = "none"
    DIGIT = "digit"
    ZHUYIN = "zhuyin"


@dataclass(frozen=True)
class PhoneticSystem:
    """A phonetic system; systems with one name are equal."""

    name: str
    abbreviable: bool = field(default=False, compare=False)
    tones: ToneConvention = field(default=ToneConvention.NONE, compare=False)
    default_fuzzies: tuple[str, ...] = field(default=(), compare=False)


MANDARIN = PhoneticSystem("mandarin", True, ToneConvention.DIGIT)
CANTONESE = PhoneticSystem("cantonese", False, ToneConvention.DIGIT)
ZHUYIN = PhoneticSystem("zhuyin", False, ToneConvention.ZHUYIN)
JAPANESE = PhoneticSystem("japanese")
KOREAN = PhoneticSystem("korean")
SYSTEMS = {s.name: s for s in (MANDARIN, CANTONESE, ZHUYIN, JAPANESE, KOREAN)}

READING = T.StructType([T.StructField("normalized", T.StringType()), T.StructField("syllable", T.StringType())])
#: One row per reading of a character; ``ord`` keeps the order of a character's readings.
READINGS = T.StructType(
    [
        T.StructField("system", T.StringType(), False),
        T.StructField("cp", T.IntegerType(), False),
        T.StructField("ord", T.IntegerType(), False),
        T.StructField("display", T.StringType()),
        T.StructField("normalized", T.StringType(), False),
        T.StructField("syllable", T.StringType(), False),
        T.StructField("tone", T.IntegerType()),
        T.StructField("freq", T.LongType()),
        T.StructField("sources", T.ArrayType(T.StringType())),
    ]
)
WORDS = T.StructType(
    [
        T.StructField("system", T.StringType(), False),
        T.StructField("cps", T.ArrayType(T.IntegerType()), False),
        T.StructField("text", T.StringType(), False),
        T.StructField("readings", T.ArrayType(READING), False),
        T.StructField("source", T.StringType()),
    ]
)


@dataclass(frozen=True)
class Keyboard:
    """A layout: ``encode`` maps a toneless syllable to keys (null: no such keys). None: as is."""

    name: str
    encode: Callable[[Column], Column] | None = field(default=None, compare=False)

    @property
    def identity(self) -> bool:
        return self.encode is None


IDENTITY = Keyboard("quanpin")


@dataclass(frozen=True)
class Router:
    """Which system spells a code point, as a Column function; null leaves it literal."""

    name: str
    system_of: Callable[[Column], Column] = field(compare=False)
    systems: tuple[PhoneticSystem, ...] = ()


@dataclass(frozen=True)
class PolyphoneTable:
    """Words and the normalized reading of each of their characters."""

    words: tuple[tuple[str, tuple[str, ...]], ...]
    system: PhoneticSystem = MANDARIN

    @classmethod
    def of(cls, words: Mapping[str, list[str] | tuple[str, ...]], system: PhoneticSystem = MANDARIN) -> PolyphoneTable:
        """From word -> readings; a word without characters or with another count is an error."""
        out = {}
        for word, readings in words.items():
            readings = tuple(r.strip() for r in readings)
            if not word or len(readings) != len(word):
                raise ValueError(f"{word!r} has {len(word)} characters and {len(readings)} readings")
            out[word] = readings
        return cls(tuple(sorted(out.items())), system)

    @property
    def max_word_length(self) -> int:
        return max((len(w) for w, _ in self.words), default=0)


@dataclass(frozen=True)
class Options:
    """What a query is matched under. One of ``system`` and ``router`` is set."""

    system: PhoneticSystem | None = None
    router: Router | None = None
    keyboard: Keyboard = IDENTITY
    tone: TonePolicy = TonePolicy.IGNORE
    abbrev: AbbrevPolicy = AbbrevPolicy.OFF
    fuzzies: tuple[str, ...] | None = None
    polyphone: PolyphoneMode = PolyphoneMode.OFF
    table: PolyphoneTable | None = None

    def __post_init__(self) -> None:
        if (self.system is None) == (self.router is None):
            raise ValueError("give a system or a router, not both")
        if self.polyphone is PolyphoneMode.PRECISE and (self.table is None or self.router is not None):
            raise ValueError("precise readings need a polyphone table and a single system")

    @property
    def systems(self) -> tuple[PhoneticSystem, ...]:
        return (self.system,) if self.system else self.router.systems

    @property
    def effective_fuzzies(self) -> tuple[str, ...]:
        if self.fuzzies is not None:
            return tuple(dict.fromkeys(self.fuzzies))
        return self.system.default_fuzzies if self.system else ()

    @property
    def by_initials(self) -> bool:
        """Whether a syllable's initial alone may stand for it."""
        return self.abbrev is AbbrevPolicy.INITIALS and self.system is not None and self.system.abbreviable and self.keyboard.identity

    def but(self, **changes) -> Options:
        """A copy with these changes."""
        return dataclasses.replace(self, **changes)
