"""Queries compiled to Catalyst expressions.

A query of n characters has n + 1 offsets. For each character that can consume a part of it the
driver lays down which lengths it consumes at which offset. Short queries become one regular
expression, which stays inside generated code; larger ones a fold over the text's characters with
the reachable offsets in a bit mask, or, beyond 62 offsets, in an array. A query that only literal
characters can consume becomes a plain string comparison, which reaches the scan.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from tonewright.functions import text as tx
from tonewright.model import MatchMode, Options, PolyphoneMode

#: Alternatives of a regular expression beyond which the mask is used.
MAX_PATHS = 512
MAX_MASK = 62
#: Between a character and the syllable that a word forces on it.
FORCED = "\x01"

#: character (or character, FORCED, syllable) -> its readings, each (surface, initial length) pairs
Lattice = dict[str, list[list[tuple[str, int]]]]
Moves = dict[str, list[set[int]]]


def moves(query: str, lattice: Lattice, partial: bool) -> Moves:
    """For every key the lengths it consumes at each offset of the query."""
    n = len(query)
    out: Moves = {}

    def at(key: str) -> list[set[int]]:
        return out.setdefault(key, [set() for _ in range(n)])

    for key, readings in lattice.items():
        for start in range(n):
            for surface, initial in (pair for r in readings for pair in r):
                size = 0
                for a, b in zip(query[start:], surface, strict=False):
                    if a != b:
                        break
                    size += 1
                if (partial and start + size == n) or size == len(surface):
                    at(key)[start].add(size)
                if initial and size >= initial:
                    at(key)[start].add(initial)
    # a character stands for itself, but for those outside the basic plane
    for i, c in enumerate(query):
        if ord(c) <= 0xFFFF:
            for key in {c} | {k for k in lattice if k.startswith(c + FORCED)}:
                at(key)[i].add(1)
    return {k: m for k, m in out.items() if any(m)}


def _escaped(c: str) -> str:
    return f"\\x{{{ord(c):X}}}"


def regex(query: str, table: Moves, mode: MatchMode, limit: int = MAX_PATHS) -> str | None:
    """The table as a regular expression; None if it takes more than ``limit`` alternatives."""
    n = len(query)
    tail = r"\z" if mode is MatchMode.EXACT else ""
    count = 0

    def rest(i: int) -> str | None:
        """What follows offset i; None if nothing can."""
        nonlocal count
        if i == n:
            return tail
        options = []
        for size in sorted({s for m in table.values() for s in m[i]}):
            count += 1
            if count > limit:
                raise OverflowError
            if (after := rest(i + size)) is not None:
                own = sorted(k for k, m in table.items() if size in m[i])
                options.append("[" + "".join(map(_escaped, own)) + "]" + after)
        return None if not options else options[0] if len(options) == 1 else "(?:" + "|".join(options) + ")"

    try:
        body = rest(0)
    except OverflowError:
        return None
    if body is None:
        return "(?!)"
    return body if mode is MatchMode.CONTAINS else "^" + body


def _masked(keys: Column, n: int, table: Moves, mode: MatchMode) -> Column:
    """A fold with reachable offsets as bits of a number."""
    accept = 1 << n
    masks = {k: [sum(1 << (i + s) for s in m[i]) for i in range(n)] for k, m in table.items()}
    by_key = F.map_from_arrays(F.array(*[F.lit(k) for k in masks]), F.array(*[F.array(*[F.lit(x).cast("long") for x in m]) for m in masks.values()]))
    nothing = F.array(*[F.lit(0).cast("long")] * n)
    bit = lambda a, i: a.bitwiseAND(F.lit(1 << i).cast("long")) != 0

    def step(a: Column, row: Column) -> Column:
        out = F.lit(0).cast("long")
        for i in range(n):
            out = out.bitwiseOR(F.when(bit(a, i), row[i]).otherwise(F.lit(0).cast("long")))
        if mode is not MatchMode.EXACT:
            out = out.bitwiseOR(a.bitwiseAND(F.lit(accept).cast("long")))
        return out.bitwiseOR(F.lit(1).cast("long")) if mode is MatchMode.CONTAINS else out

    rows = F.transform(keys, lambda k: F.coalesce(F.try_element_at(by_key, k), nothing))
    return F.aggregate(rows, F.lit(1).cast("long"), step).bitwiseAND(F.lit(accept).cast("long")) != 0


def _listed(keys: Column, n: int, table: Moves, mode: MatchMode) -> Column:
    """The same fold with offsets in an array, for queries of any length."""
    none = F.array().cast("array<array<int>>")
    by_key = F.map_from_arrays(
        F.array(*[F.lit(k) for k in table]),
        F.array(*[F.array(*[F.array(*[F.lit(i + s) for s in sorted(m[i])]).cast("array<int>") for i in range(n)]) for m in table.values()]),
    )

    def step(a: Column, row: Column) -> Column:
        out = F.flatten(F.transform(a, lambda i: F.coalesce(F.get(row, i), F.array().cast("array<int>"))))
        if mode is not MatchMode.EXACT:
            out = F.concat(out, F.filter(a, lambda i: i == n))
        return F.array_distinct(F.concat(out, F.array(F.lit(0))) if mode is MatchMode.CONTAINS else out)

    rows = F.transform(keys, lambda k: F.coalesce(F.try_element_at(by_key, k), none))
    return F.array_contains(F.aggregate(rows, F.array(F.lit(0)), step), n)


def forced_keys(text: Column, options: Options) -> Column:
    """Keys of a text's characters, with the syllable a word forces on them.

    The text is cut greedily, longest word first, from left to right: what a regular expression
    does with the words sorted by falling length and any character as the last resort.
    """
    words = {w: r for w, r in options.table.words if w}
    if not words:
        return tx.chars(text)
    order = sorted(words, key=lambda w: (-len(w), w))
    cut = F.regexp_extract_all(text, F.lit("(?s)" + "|".join("".join(map(_escaped, w)) for w in order) + "|."), F.lit(0))
    tones = options.table.system.tones
    held = F.map_from_arrays(
        F.array(*[F.lit(w) for w in words]),
        F.array(*[F.array(*[F.concat(F.lit(c + FORCED), tx.strip_tone(F.lit(r), tones)) for c, r in zip(w, rs, strict=True)]) for w, rs in words.items()]),
    )
    return F.flatten(F.transform(cut, lambda t: F.coalesce(F.try_element_at(held, t), F.array(t))))


@dataclass(frozen=True)
class CompiledQuery:
    """A query laid out under options; its three methods give boolean Columns."""

    query: str
    options: Options
    #: lattice of the characters that help, for the two kinds of end
    lattice: Lattice

    def _column(self, text: Column, mode: MatchMode) -> Column:
        q, n = self.query, len(self.query)
        if not n:
            return text == "" if mode is MatchMode.EXACT else text.isNotNull()
        precise = self.options.polyphone is PolyphoneMode.PRECISE
        table = moves(q, self.lattice, mode.partial)
        if not precise:
            if not self.lattice and all(ord(c) <= 0xFFFF for c in q):
                plain = {MatchMode.CONTAINS: text.contains(q), MatchMode.BEGINS: text.startswith(q), MatchMode.EXACT: text == q}
                return plain[mode]
            if (pattern := regex(q, table, mode)) is not None:
                return text.rlike(pattern)
        if not table:
            return text.isNotNull() & F.lit(False)
        keys = forced_keys(text, self.options) if precise else tx.chars(text)
        fold = _masked if n <= MAX_MASK else _listed
        return (text != "") & fold(keys, n, table, mode)

    def contains(self, text: Column) -> Column:
        return self._column(text, MatchMode.CONTAINS)

    def begins(self, text: Column) -> Column:
        return self._column(text, MatchMode.BEGINS)

    def matches(self, text: Column) -> Column:
        return self._column(text, MatchMode.EXACT)

    def by(self, mode: MatchMode, text: Column) -> Column:
        return self._column(text, mode)
