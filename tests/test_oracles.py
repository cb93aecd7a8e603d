import math

import pytest

from logfold.plans import catalog

INTEGERS = {"bigint", "int", "smallint", "tinyint"}


def comparable(v):
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 6)
    return v


def rows(columns, records):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(comparable(r[i]) for i in order) for r in records), key=repr)


@pytest.mark.parametrize("name", sorted(catalog.queries()))
def test_query_equals_its_oracle(spark, duck, sf_dir, name):
    got = catalog.queries()[name](spark, sf_dir)
    want = duck.execute(catalog.oracle_sql()[name])
    columns = [d[0] for d in want.description]
    assert sorted(columns) == sorted(got.columns)
    kinds = {d[0]: str(d[1]).upper() for d in want.description}
    for c, t in got.dtypes:
        if t in ("bigint", "int"):
            assert kinds[c] == {"bigint": "BIGINT", "int": "INTEGER"}[t], (c, t, kinds[c])
    assert rows(got.columns, [tuple(r) for r in got.collect()]) == rows(columns, want.fetchall())


def test_every_query_has_an_oracle():
    assert set(catalog.queries()) == set(catalog.oracle_sql())
