"""Rows of Spark and DuckDB in one comparable form."""

import datetime
import decimal

import numpy as np

SMALL = "/root/testdata/sf0.001"


def plain(x):
    if x is None or isinstance(x, (bool, np.bool_)):
        return None if x is None else bool(x)
    if isinstance(x, (list, tuple, np.ndarray)):
        return tuple(plain(y) for y in x)
    if isinstance(x, dict):
        return tuple(plain(y) for y in x.values())
    if isinstance(x, (float, np.floating, decimal.Decimal)):
        return None if x != x else round(float(x), 9) + 0.0
    if isinstance(x, (int, np.integer)):
        return int(x)
    if isinstance(x, datetime.datetime):
        return x.replace(tzinfo=None).isoformat()
    return str(x)


def rows_of(columns, rows):
    at = [list(columns).index(c) for c in sorted(columns)]
    return sorted((tuple(plain(r[k]) for k in at) for r in rows), key=repr)


def assert_same(df, relation):
    assert sorted(df.columns) == sorted(relation.columns)
    assert rows_of(df.columns, [tuple(r) for r in df.collect()]) == rows_of(relation.columns, relation.fetchall())
