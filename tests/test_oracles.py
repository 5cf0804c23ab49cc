"""Every engine query against its SQL on the smallest tables."""

import os

import pytest

duckdb = pytest.importorskip("duckdb")
SMALL = "/root/testdata/sf0.001"

import pulseframe.queries_given  # noqa: E402,F401
import pulseframe.queries_models  # noqa: E402,F401
import pulseframe.queries_recordings  # noqa: E402,F401
from pulseframe.queries import oracle_sql, queries  # noqa: E402


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for f in os.listdir(SMALL):
        p = f"{SMALL}/{f}"
        c.execute(f"CREATE VIEW {f[:-8]} AS SELECT * FROM '{p}{'/*.parquet' if os.path.isdir(p) else ''}'")
    return c


def plain(v):
    if isinstance(v, float):
        return f"{v:.8g}"
    return str(v)


@pytest.mark.parametrize("name", sorted(oracle_sql()))
def test_same_rows(spark, con, name):
    df = queries()[name](spark, SMALL)
    cols = sorted(df.columns)
    got = sorted(tuple(plain(r[c]) for c in cols) for r in df.collect())
    r = con.execute(oracle_sql()[name])
    names = [d[0] for d in r.description]
    assert sorted(names) == cols
    assert got == sorted(tuple(plain(row[names.index(c)]) for c in cols) for row in r.fetchall())


def test_saturation_rule_decides_trials(con):
    sql = oracle_sql()["trial_status_saturated"]
    assert set(con.execute(sql).fetchall()) != set(con.execute(sql.replace("ratio > 0.3", "ratio > 2")).fetchall())
