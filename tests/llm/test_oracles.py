import pytest

from logfold.llm import queries


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_query_equals_its_oracle(duck, whole, name):
    got = whole(name)
    want = duck.execute(queries.oracle_sql()[name])
    columns = [d[0] for d in want.description]
    assert sorted(columns) == sorted(got.columns)
    kinds = {d[0]: str(d[1]).upper() for d in want.description}
    assert all(kinds[c] == {"bigint": "BIGINT", "string": "VARCHAR", "boolean": "BOOLEAN"}[t] for c, t in got.dtypes)
    order = sorted(columns)
    assert sorted(repr([r[c] for c in order]) for r in got.collect()) == sorted(repr([r[columns.index(c)] for c in order]) for r in want.fetchall())
