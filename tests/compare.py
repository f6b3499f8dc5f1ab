"""Compares a Spark result with a DuckDB result, whatever the order of rows and columns."""

import math


def cell(v):
    if v is None or isinstance(v, float) and math.isnan(v):
        return None
    if isinstance(v, bool):
        return int(v)
    if hasattr(v, "tolist"):
        v = v.tolist()
    if isinstance(v, (list, tuple)):
        return tuple(cell(x) for x in v)
    if isinstance(v, (int, float)) or type(v).__name__ == "Decimal":
        return round(float(v), 5)
    return str(v)


def rows(names, data):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted((tuple(cell(r[i]) for i in order) for r in data), key=repr)


def assert_same(df, relation):
    got, want = df.columns, relation.columns
    assert sorted(got) == sorted(want)
    a, b = rows(got, df.collect()), rows(want, relation.fetchall())
    assert len(a) == len(b)
    wrong = [(x, y) for x, y in zip(a, b) if any(not (p == q or isinstance(p, float) and isinstance(q, float) and math.isclose(p, q, rel_tol=1e-6, abs_tol=2e-5)) for p, q in zip(x, y))]
    assert not wrong, wrong[:3]
