"""Every registered query against its SQL on the smallest tables."""

import pytest

from colloquy.plans.registry import entries
from tests.conftest import SF

ENTRIES = entries()


@pytest.mark.parametrize("name", sorted(ENTRIES))
def test_query(spark, duck, name):
    fn, sql = ENTRIES[name]
    df = fn(spark, SF)
    rows = df.collect()
    if sql is None:
        assert rows
        return
    found = duck.execute(sql)
    names = [d[0] for d in found.description]
    want = found.fetchall()
    assert sorted(df.columns) == sorted(names)
    a = [df.columns.index(n) for n in sorted(names)]
    b = [names.index(n) for n in sorted(names)]
    assert sorted(repr([r[i] for i in a]) for r in rows) == sorted(repr([r[i] for i in b]) for r in want)
