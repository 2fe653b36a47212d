"""Small tables with the awkward cases that every operator has to take."""

from __future__ import annotations

import random

import duckdb
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

#: Columns that operators might use for themselves, beside those of ``documents``.
CLASHING = ("range", "guest", "hash", "new", "lost", "hashes", "rid", "starts", "fp", "fingerprint", "component_id", "node", "n", "w1", "shared", "digest", "revisits", "clean_text", "at", "part", "row")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"`{c}` string" for c in CLASHING)
PLAIN = "doc_id long, text string, lang string, source string, n_chars long"


def table(spark: SparkSession, rows: list[tuple[int | None, str | None]], clashing: bool = True, partitions: int = 3) -> DataFrame:
    """A documents table of (doc_id, text); extra columns hold nulls and other values."""
    full = [(d, t, None if k % 2 else "en", None, None if t is None else len(t), *(([f"{c}-{k}" if k % 3 else None for c in CLASHING]) if clashing else [])) for k, (d, t) in enumerate(rows)]
    schema = T.StructType.fromDDL(SCHEMA if clashing else PLAIN)
    return spark.createDataFrame(full, schema).repartition(partitions)


def words(rng: random.Random, n: int, vocabulary: int = 400) -> list[str]:
    return [f"w{rng.randrange(vocabulary)}" for _ in range(n)]


def awkward(seed: int = 7) -> list[tuple[int | None, str | None]]:
    """Null and empty texts, white space alone, one word, ties, repeated rows, near copies, a
    very long text, odd characters, repeated doc_ids with different texts, and a null doc_id."""
    rng = random.Random(seed)
    base = words(rng, 120)
    near = base[:60] + ["changed"] + base[61:]
    lines = "\n".join(" ".join(words(rng, 9)) for _ in range(8))
    out: list[tuple[int | None, str | None]] = [
        (1, None), (2, ""), (3, " \t\n "), (4, "one"), (5, "two words"), (6, " ".join(base)), (7, " ".join(near)),
        (8, " ".join(base)), (8, " ".join(base)), (9, "a b c " * 40), (10, lines), (11, "Head line of its own.\n" + lines + "\ntail"),
        (12, " ".join(words(rng, 30_000, 5000))), (13, "naïve ▁mark  double space　wide\r\nend 中国 😀 \x00 nul"), (14, "UPPER lower UPPER lower " * 20),
        (15, lines), (16, " ".join(base[20:90]) + "\n" + lines), (17, "x" * 40_000), (18, "<|endoftext|> is text </s> <s>"), (18, "other text of the same number"),
    ]
    out += [(100 + k, " ".join(words(rng, rng.randrange(1, 200), 60))) for k in range(40)]
    out += [(None, " ".join(base)), (None, None)]
    return out


def oracle(sql: str, rows: list[tuple[int | None, str | None]]) -> list[tuple]:
    """Rows of DuckDB SQL over a documents table, columns by name, sorted."""
    con = duckdb.connect()
    frame = pd.DataFrame({"doc_id": pd.array([d for d, _ in rows], "Int64"), "text": pd.array([t for _, t in rows], "string")})
    con.register("given", frame)
    con.execute("CREATE TABLE documents AS SELECT CAST(doc_id AS BIGINT) AS doc_id, CAST(text AS VARCHAR) AS text FROM given")
    got = con.execute(sql)
    names = [c[0] for c in got.description]
    order = sorted(range(len(names)), key=lambda i: names[i])
    return by_row(tuple(r[i] for i in order) for r in got.fetchall())


def found(df: DataFrame, *columns: str) -> list[tuple]:
    """Rows of a DataFrame as ``oracle`` gives them."""
    names = sorted(columns or df.columns)
    return by_row(tuple(r) for r in df.select(*names).collect())


def by_row(rows) -> list[tuple]:
    return sorted(rows, key=lambda r: tuple((x is None, str(type(x)), x if x is not None else 0) for x in r))


def components(n: int, linked) -> list[int]:
    """Least member of each node's component, for links between 0..n-1."""
    up = list(range(n))

    def top(i: int) -> int:
        while up[i] != i:
            i = up[i]
        return i

    for a, b in linked:
        a, b = sorted((top(a), top(b)))
        up[b] = a
    return [top(i) for i in range(n)]
