"""Line-first quality rules: judge every line, remove failing lines, then reject documents
that lose too much.

A line with at least one word fails when one of these holds (k words, c code points in words):

* symbols: more than a tenth of its code points are ``# * $ % & | < >``
* shouting: more ``!`` and ``?`` than words
* navigation: at least two words are bare separators, and these are an eighth of the words
* remnant: fewer than ``min_line_words`` words and no closing punctuation
* boilerplate: licence, cookie, script or sign-up wording
* repeat: equal to an earlier line of the document

A document is rejected if it fails the base rules (under 50 words; over half of its words lie
in repeated 3-word windows) or if over three tenths of its words stood in failing lines.

Null and empty texts have no words, hence fail the base rules. Repeated rows are judged one by
one, alike. Extra columns never reach the rules.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tonewright.llm.common import arrow_map, raw, slices

SYMBOLS = b"#*$%&|<>"
SEPARATORS = ("|", ">", "»", "·", "•", "/", "::")
CLOSING = ".!?…\"'”’»:;)。！？"
BOILERPLATE = (
    "licensed under|all rights reserved|terms of (use|service)|privacy policy|"
    "cookie policy|accept cookies|enable javascript|lorem ipsum|sign up now|click here to"
)


@dataclass(frozen=True)
class Rules:
    """Limits of the rules; the defaults are the production parameters."""

    min_words: int = 50
    repeat_percent: int = 50
    min_line_words: int = 4
    lost_percent: int = 30


_SEP = frozenset(s.encode() for s in SEPARATORS)
_CLOSE = tuple(c.encode() for c in CLOSING)
_BOILER = re.compile(BOILERPLATE.encode())


def line_fails(line: bytes, rules: Rules = Rules()) -> str:
    """Name of the first rule that a line fails, '' if none; lines without words pass."""
    words = line.split()
    k = len(words)
    if not k:
        return ""
    chars = len(b"".join(words).decode())
    if 10 * sum(line.count(s) for s in SYMBOLS) > chars:
        return "symbols"
    if line.count(b"!") + line.count(b"?") > k:
        return "shouting"
    seps = sum(w in _SEP for w in words) if b"|" in line or not _SEP.isdisjoint(words) else 0
    if seps >= 2 and 8 * seps >= k:
        return "navigation"
    if k < rules.min_line_words and not words[-1].endswith(_CLOSE):
        return "remnant"
    if _BOILER.search(line.lower()):
        return "boilerplate"
    return ""


def repeat_words(words: list[bytes]) -> int:
    """Words inside 3-word windows that occur at least twice in the text."""
    n = len(words)
    if n < 4:
        return 0
    seen: dict[bytes, int] = {}
    code = np.array([seen.setdefault(w, len(seen)) for w in words], np.int64)
    if len(seen) > 2_000_000:  # else the triple fits a signed 64-bit integer
        pair = np.unique(code[:-1] * len(seen) + code[1:], return_inverse=True)[1]
        key = pair[:-1] * len(seen) + code[2:]
    else:
        key = (code[:-2] * len(seen) + code[1:-1]) * len(seen) + code[2:]
    _, where, count = np.unique(key, return_inverse=True, return_counts=True)
    hit = count[where] > 1
    mark = np.zeros(n, bool)
    for shift in range(3):
        mark[shift : n - 2 + shift] |= hit
    return int(mark.sum())


def judge(text: bytes, rules: Rules = Rules()) -> tuple[int, int, int, int, int, bool, bool, int, bytes]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept,
    words in failing lines, and the text without failing lines."""
    words = text.split()
    n = len(words)
    seen: set[bytes] = set()
    stay: list[bytes] = []
    dup = lost = 0
    for line in text.split(b"\n"):
        if not line.strip():
            stay.append(line)
            continue
        again = line in seen
        dup += again
        seen.add(line)
        if again or line_fails(line, rules):
            lost += len(line.split())
        else:
            stay.append(line)
    repeated = repeat_words(words)
    failed = n < rules.min_words or 100 * repeated > rules.repeat_percent * n
    kept = not failed and 100 * lost <= rules.lost_percent * n
    chars = len(b"".join(words).decode())
    return (n, chars, sum(text.count(s) for s in SYMBOLS), dup, repeated, failed, kept, lost, b"\n".join(stay))


_COUNTS = (
    "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, "
    "base_failed boolean, kept boolean, lost_words long"
)


def assess(docs: DataFrame, rules: Rules = Rules(), with_text: bool = False) -> DataFrame:
    """One row per document: its measures, the verdict and, if asked, the cleaned text.

    No shuffle: each document is judged alone, inside one Arrow pass over the scan.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                got = [judge(t, rules) for t in raw(part)]
                cols = [part.column("doc_id")]
                kinds = [pa.int64()] * 5 + [pa.bool_(), pa.bool_(), pa.int64()]
                cols += [pa.array([g[i] for g in got], k) for i, k in enumerate(kinds)]
                names = ["doc_id", *(c.split()[0] for c in _COUNTS.split(", "))]
                if with_text:
                    cols.append(pa.array([g[8].decode() for g in got], pa.string()))
                    names.append("clean_text")
                yield pa.RecordBatch.from_arrays(cols, names)

    schema = f"doc_id long, {_COUNTS}" + (", clean_text string" if with_text else "")
    return arrow_map(docs, run, schema)


def clean_documents(docs: DataFrame, rules: Rules = Rules()) -> DataFrame:
    """The rows of ``docs`` that pass, with failing lines gone from text and n_chars anew.

    All other columns stay as they are. Rows are judged where they are read: no join.
    """
    fields = docs.schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                got = [judge(t, rules) for t in raw(part)]
                text = pa.array([g[8].decode() for g in got], part.schema.field("text").type)
                cols = [text if n == "text" else part.column(n) for n in part.schema.names]
                out = pa.RecordBatch.from_arrays(cols, names=part.schema.names)
                yield out.filter(pa.array([g[6] for g in got], pa.bool_()))

    out = arrow_map(docs, run, fields)
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.char_length("text").cast(fields["n_chars"].dataType))
    return out
