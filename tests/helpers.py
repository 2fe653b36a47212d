"""Rows of DataFrames and of DuckDB, to compare."""


def by_row(rows) -> list[tuple]:
    return sorted(rows, key=lambda r: tuple((x is None, str(type(x)), x if x is not None else 0) for x in r))


def found(df) -> list[tuple]:
    names = sorted(df.columns)
    return by_row(tuple(r) for r in df.select(*names).collect())


def asked(con, sql: str) -> list[tuple]:
    got = con.execute(sql)
    names = [c[0] for c in got.description]
    order = sorted(range(len(names)), key=lambda i: names[i])
    return by_row(tuple(r[i] for i in order) for r in got.fetchall())
