"""Every query with an oracle against DuckDB on the small tables."""

import duckdb
import pytest

import __spark_entry__ as entry

DATA = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", ["chunk_documents", "top_keywords", "query_topk", "indexed_topk", "file_names", "entity_aggregate", "cache_decision", "lint_duplicates", "bio_spans"])
def test_equals_oracle(spark, name):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{DATA}/documents.parquet'")
    want = con.execute(entry.oracle_sql()[name]).df()
    got = entry.queries()[name](spark, DATA).toPandas()
    columns = sorted(want.columns)
    assert sorted(got.columns) == columns
    rows = lambda df: sorted(map(tuple, df[columns].astype(str).to_numpy().tolist()))
    assert rows(got) == rows(want)


def test_entry(spark):
    assert entry.entry(spark).count() > 0
