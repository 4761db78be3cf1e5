"""The queries of training-data operators that SQL can express, on the smallest tables."""

import pytest

from rasterjobs.llm.queries import ORACLES, QUERIES
from tests.test_oracles import SF, duck, rows  # noqa: F401  (duck is a fixture)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_matches_its_sql(spark, duck, name):  # noqa: F811
    df = QUERIES[name](spark, SF)
    want = duck.sql(ORACLES[name])
    assert sorted(want.columns) == sorted(df.columns)
    got, expected = rows(df.columns, df.collect()), rows(want.columns, want.fetchall())
    assert len(got) == len(expected)
    for a, b in zip(got, expected, strict=True):
        assert [x if isinstance(x, str) or x is None else pytest.approx(x, rel=1e-9) for x in a] == list(b)
