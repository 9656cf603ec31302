"""Comparing rows of Spark and DuckDB."""

import math


def flat(v):
    if v is None or isinstance(v, bool):
        return str(v)
    if isinstance(v, (int, float)):
        return v
    if type(v).__name__ == "Decimal":
        return float(v)
    if isinstance(v, (list, tuple)):
        return str([str(x) for x in v])
    return str(v)[:19]


def key(row):
    return tuple("~%.3g" % v if isinstance(v, float) else "%020d" % v if isinstance(v, int) else v for v in sorted(row, key=lambda v: isinstance(v, float)))


def same(a, b):
    if isinstance(a, (int, float)) and isinstance(b, (int, float)):
        return a == b or math.isclose(a, b, rel_tol=1e-9, abs_tol=2e-6)
    return a == b


def compare(df, con, sql):
    cols = sorted(df.columns)
    got = sorted((tuple(flat(v) for v in r) for r in df.select(*[f"`{c}`" for c in cols]).collect()), key=key)
    res = con.execute(sql)
    names = [c[0] for c in res.description]
    assert sorted(names) == cols
    at = [names.index(c) for c in cols]
    want = sorted((tuple(flat(r[i]) for i in at) for r in res.fetchall()), key=key)
    assert len(got) == len(want)
    for g, w in zip(got, want):
        assert all(same(a, b) for a, b in zip(g, w)), (g, w)
