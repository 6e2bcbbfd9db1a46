"""Every registered query of the property graph against its SQL on the smallest tables."""

import duckdb
import pytest

from strandgraph.plans import queries as Q

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


def _rows(rows):
    return sorted((tuple(round(x, 6) if isinstance(x, float) else x for x in r) for r in rows), key=lambda r: tuple((x is None, str(x)) for x in r))


@pytest.mark.parametrize("name", sorted(Q.SQL))
def test_against_sql(spark, con, name):
    df = Q.QUERIES[name](spark, SF)
    want = con.sql(Q.SQL[name])
    assert sorted(df.columns) == sorted(want.columns)
    order = [want.columns.index(c) for c in df.columns]
    assert _rows(df.collect()) == _rows([tuple(r[k] for k in order) for r in want.fetchall()])


@pytest.mark.parametrize("name", sorted(set(Q.QUERIES) - set(Q.SQL)))
def test_without_sql(spark, name):
    assert Q.QUERIES[name](spark, SF).count() > 0


def test_reasons_of_every_kind_of_node(spark):
    got = {r["id"] for r in Q.QUERIES["silence_reasons"](spark, SF).select("id").distinct().collect()}
    assert any(1_000_000_000 <= i <= 2_999_999_999 for i in got) and any(i > 2_999_999_999 for i in got)
