"""Every registered query that has SQL, against another engine on the same tables."""

import duckdb
import pytest

import __spark_entry__ as entry
from larkspan.plans import registry

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(v):
    return round(v, 5) if isinstance(v, float) else v


def both(spark, sf_dir, name, make, sql):
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    df = make(spark, sf_dir)
    cols = sorted(df.columns)
    rel = con.sql(sql)
    assert cols == sorted(rel.columns)
    mine = sorted(repr([plain(v) for v in r]) for r in df.select(*cols).collect())
    theirs = sorted(repr([plain(v) for v in r]) for r in rel.project(", ".join(f'"{c}"' for c in cols)).fetchall())
    return mine, theirs


@pytest.mark.parametrize("name", list(registry.ORACLE_SQL))
def test_against_sql(spark, sf_dir, name):
    mine, theirs = both(spark, sf_dir, name, registry.QUERIES[name], registry.ORACLE_SQL[name])
    assert mine == theirs


def test_registry(spark):
    assert set(registry.ORACLE_SQL) <= set(registry.QUERIES) <= set(entry.queries())
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert entry.entry(spark).count() == 8
