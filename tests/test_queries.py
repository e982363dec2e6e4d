"""Every query with SQL gives DuckDB's rows on the smallest tables."""

import duckdb
import pytest
from conftest import SF

from lutrin.plans.oracles import ORACLE_SQL
from lutrin.plans.queries import QUERIES


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_rows(spark, name):
    ours = QUERIES[name](spark, SF).toPandas()
    if name not in ORACLE_SQL:
        assert len(ours)
        return
    con = duckdb.connect()
    for t in ("documents", "benchmark", "embeddings", "labels", "conversations", "pages"):
        con.sql(f"create view {t} as select * from '{SF}/{t}.parquet'")
    theirs = con.sql(ORACLE_SQL[name]).df()
    names = sorted(ours.columns)
    assert names == sorted(theirs.columns)
    rows = lambda df: sorted(map(str, df[names].astype(object).where(df[names].notna(), None).values.tolist()))
    assert rows(ours) == rows(theirs)
