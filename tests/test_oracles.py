"""Every registered query against its oracle, by column names and values."""

from __future__ import annotations

import math

import pytest

from oracles import ALL
from siteglass.plans.catalog import QUERIES


def cell(v):
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return ""
    if isinstance(v, float):
        return str(int(v)) if v == int(v) else repr(round(v, 6))
    return str(v)


@pytest.mark.parametrize("name", sorted(ALL))
def test_query_matches_oracle(spark, sf_dir, duck, name):
    df = QUERIES[name](spark, sf_dir)
    cursor = duck.execute(ALL[name])
    theirs = [c[0] for c in cursor.description]
    columns = sorted(df.columns)
    assert columns == sorted(theirs)
    ours = sorted(tuple(cell(r[c]) for c in columns) for r in df.collect())
    places = [theirs.index(c) for c in columns]
    assert ours == sorted(tuple(cell(r[i]) for i in places) for r in cursor.fetchall())


def test_every_query_is_registered_once():
    assert set(ALL) <= set(QUERIES)
    assert set(QUERIES) == set(ALL)
