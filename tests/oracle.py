"""Compare a query's rows with its SQL's, as sorted text."""


def _text(v):
    if v is None or v != v:
        return "NULL"
    if isinstance(v, float):
        return repr(round(v, 6))
    return str(v)


def _rows(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple(_text(r[i]) for i in order) for r in rows)


def assert_same(df, con, sql):
    said = con.execute(sql)
    columns = [c[0] for c in said.description]
    assert sorted(columns) == sorted(df.columns)
    want = _rows(columns, said.fetchall())
    got = _rows(df.columns, [tuple(r) for r in df.collect()])
    assert len(got) == len(want)
    assert got == want
