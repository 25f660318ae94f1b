"""A sample of the registered queries against their SQL; tools/check_oracle.py runs them all."""

import duckdb
import pytest

import __spark_entry__ as entry
from tools.check_oracle import TABLES, norm

FOLDER = "/root/testdata/sf0.001"
SAMPLE = ["column_stats", "relations_nested", "evaluated_grouping", "group_stats", "top_deviants", "kruskal_wallis",
          "smoothed_trace", "quality_scores", "verified_group_means", "document_chunks", "alpha_per_criterion"]


def test_every_oracle_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert len(entry.queries()) > 150


@pytest.mark.parametrize("name", SAMPLE)
def test_against_sql(spark, name):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{FOLDER}/{t}.parquet'")
    df = entry.queries()[name](spark, FOLDER)
    cur = con.execute(entry.oracle_sql()[name])
    cols = [c[0] for c in cur.description]
    assert sorted(cols) == sorted(df.columns)
    want = sorted(tuple(norm(r[cols.index(c)]) for c in sorted(cols)) for r in cur.fetchall())
    got = sorted(tuple(norm(r[c]) for c in sorted(cols)) for r in df.collect())
    assert got == want and got


def test_entry_runs(spark):
    assert entry.entry(spark).count() > 0
