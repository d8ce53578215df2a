"""Every query with SQL against DuckDB, and the others for their rows."""

from __future__ import annotations

import math

import duckdb
import pytest

from logtide.catalog import oracle_sql, queries

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def con(sf_dir):
    c = duckdb.connect()
    c.execute("set timezone='UTC'")
    for t in TABLES:
        c.execute(f"create view {t} as select * from '{sf_dir}/{t}.parquet'")
    return c


def _norm(v):
    if isinstance(v, float):
        return None if math.isnan(v) else float(f"{v:.8g}")
    return v


@pytest.mark.parametrize("name", sorted(oracle_sql()))
def test_matches_sql(spark, con, sf_dir, name):
    df = queries()[name](spark, sf_dir)
    cols = sorted(df.columns)
    got = sorted((tuple(map(_norm, r)) for r in df.select(*cols).collect()), key=repr)
    cur = con.execute(oracle_sql()[name])
    names = [x[0] for x in cur.description]
    assert sorted(names) == cols
    want = sorted((tuple(_norm(r[names.index(c)]) for c in cols) for r in cur.fetchall()), key=repr)
    assert got == want


@pytest.mark.parametrize("name", sorted(set(queries()) - set(oracle_sql()) - {"logistic_scores", "pca_spe_scores", "isolation_forest"}))
def test_has_rows(spark, sf_dir, name):
    assert queries()[name](spark, sf_dir).count() > 0


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
