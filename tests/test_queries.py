"""Every query against DuckDB on the smallest tables."""

import math

import pytest

from spotweave.plans.queries import ORACLE_SQL, QUERIES
from tests.conftest import SF


def canonical(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    shown = lambda v: f"{v:.9g}" if isinstance(v, float) and not math.isnan(v) else str(v)
    return [columns[i] for i in order], sorted(tuple(shown(r[i]) for i in order) for r in rows)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_matches_sql(spark, duck, name):
    got = QUERIES[name](spark, SF)
    rows = [tuple(r) for r in got.collect()]
    if name not in ORACLE_SQL:
        return
    want = duck.execute(ORACLE_SQL[name])
    assert canonical(got.columns, rows) == canonical([d[0] for d in want.description], want.fetchall())
