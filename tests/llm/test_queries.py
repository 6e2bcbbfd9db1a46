"""The registered queries against their SQL, on the smallest tables."""

import duckdb
import pytest

from strandgraph.llm import queries as Q

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(Q.SQL))
def test_against_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "embeddings", "benchmark", "conversations"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    got, want = Q.QUERIES[name](spark, SF), con.sql(Q.SQL[name])
    assert sorted(got.columns) == sorted(want.columns)
    order = [want.columns.index(c) for c in got.columns]
    assert sorted(map(tuple, got.collect()), key=str) == sorted((tuple(r[k] for k in order) for r in want.fetchall()), key=str)


def test_every_operator_has_a_query():
    assert [int(n[2:].split("_")[0]) for n in Q.QUERIES] == list(range(1, 11))
