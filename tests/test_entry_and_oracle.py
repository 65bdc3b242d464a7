"""Driver contract: entry runs, every oracle has a query, oracles match at sf0.001."""

import duckdb
import pytest

import __spark_entry__ as ent
from cohortlab.sources.tables import TABLES

from conftest import SF_SMALL

SLOW = {"stream_drift"}


def test_entry(spark):
    df = ent.entry(spark)
    assert df.count() > 0 and df.columns == ["feature", "corr"]


def test_oracle_keys_are_queries():
    assert set(ent.oracle_sql()) <= set(ent.queries())


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF_SMALL}/{t}.parquet')")
    return c


def _norm(rows):
    def n(v):
        if isinstance(v, float):
            return "nan" if v != v else repr(v)
        if isinstance(v, (list, tuple)):
            return "[" + ",".join(n(x) for x in v) + "]"
        return "None" if v is None else str(v)
    return sorted("|".join(n(x) for x in r) for r in rows)


@pytest.mark.parametrize("name", sorted(ent.oracle_sql()))
def test_oracle_match(spark, con, name):
    sdf = ent.queries()[name](spark, SF_SMALL)
    cols = sorted(sdf.columns)
    srows = [tuple(r[c] for c in cols) for r in sdf.collect()]
    from tools.type_check import SPARK_TO_DUCK
    rel = con.sql(ent.oracle_sql()[name])
    dtypes = {c: str(t) for c, t in zip(rel.columns, rel.types)}
    for f in sdf.schema.fields:
        st = f.dataType.simpleString()
        assert SPARK_TO_DUCK.get(st, st) == dtypes[f.name], (f.name, st, dtypes[f.name])
    res = con.execute(ent.oracle_sql()[name])
    dcols = [d[0] for d in res.description]
    assert sorted(dcols) == cols
    idx = [dcols.index(c) for c in cols]
    drows = [tuple(r[i] for i in idx) for r in res.fetchall()]
    assert _norm(srows) == _norm(drows)
