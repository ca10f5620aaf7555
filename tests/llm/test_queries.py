"""All queries on the smallest tables; those with SQL against it."""

import os

import duckdb
import pytest

from quarry.llm.queries import QUERIES, SQL


@pytest.mark.parametrize("name", list(QUERIES))
def test_runs(spark, small, name):
    frame = QUERIES[name](spark, small)
    rows = frame.collect()
    if name in SQL:
        connection = duckdb.connect()
        for table in os.listdir(small):
            connection.execute(f"CREATE VIEW {table.split('.')[0]} AS SELECT * FROM read_parquet('{small}/{table}')")
        result = connection.execute(SQL[name])
        names = [d[0] for d in result.description]
        assert sorted(names) == sorted(frame.columns)
        assert sorted(tuple(r[c] for c in names) for r in rows) == sorted(result.fetchall())


def test_columns(spark, small):
    columns = {"p1_found": ["chunk_id"], "p2_found": ["file_id"], "p3_found": ["chunk_id_a", "chunk_id_b"], "p5_found": ["query_id", "chunk_id"], "p6_ids": ["doc_id", "ids"], "p7_found": ["doc_id"], "p8_found": ["doc_id_a", "doc_id_b"]}
    for name, expected in columns.items():
        assert QUERIES[name](spark, small).columns == expected
