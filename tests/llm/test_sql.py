"""The queries of the operators against their SQL, on the smallest tables."""

import os

import duckdb
import pytest

from quillspark.llm import registry

DIR = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


def plain(v):
    return None if v != v else float(f"{v:.9g}") if isinstance(v, float) else v


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_query_matches_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "embeddings", "pages", "benchmark"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DIR}/{t}.parquet'")
    df = registry.queries()[name](spark, DIR)
    columns = sorted(df.columns)
    cursor = con.execute(registry.oracle_sql()[name])
    names = [d[0] for d in cursor.description]
    assert sorted(names) == columns
    got = sorted(str([plain(r[c]) for c in columns]) for r in df.collect())
    assert got and got == sorted(str([plain(r[names.index(c)]) for c in columns]) for r in cursor.fetchall())
