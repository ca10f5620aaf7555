"""Queries against their SQL on the smallest tables; the others at least give rows of a stable shape."""

import math
import os
import re

import duckdb
import numpy as np
import pytest

import __spark_entry__ as entry

QUERIES, SQL = entry.queries(), entry.oracle_sql()
OTHERS = re.compile(r"p[1235678]_")
CORE = [n for n in SQL if not OTHERS.match(n)]


@pytest.fixture(scope="module")
def views(small):
    connection = duckdb.connect()
    for name in os.listdir(small):
        connection.execute(f"CREATE VIEW {name.split('.')[0]} AS SELECT * FROM read_parquet('{small}/{name}')")
    return connection


def plain(value):
    if value is None or isinstance(value, float) and math.isnan(value):
        return "∅"
    if isinstance(value, float):
        return repr(round(value, 9) + 0.0)
    if isinstance(value, (list, np.ndarray)):
        return str([plain(x) for x in value])
    return str(value)


@pytest.mark.parametrize("name", CORE)
def test_same_as_sql(spark, small, views, name):
    frame = QUERIES[name](spark, small)
    columns = sorted(frame.columns)
    mine = sorted(tuple(plain(r[c]) for c in columns) for r in frame.collect())
    result = views.execute(SQL[name])
    names = [d[0] for d in result.description]
    assert sorted(names) == columns
    theirs = sorted(tuple(plain(r[names.index(c)]) for c in columns) for r in result.fetchall())
    assert mine == theirs


@pytest.mark.parametrize("name", [n for n in QUERIES if n not in SQL and not OTHERS.match(n)])
def test_gives_rows(spark, small, name):
    assert QUERIES[name](spark, small).count() > 0


def test_entry_points(spark):
    assert set(SQL) <= set(QUERIES)
    assert entry.entry(spark).columns


def test_hybrid_end_to_end_moves_no_pairs(spark, tmp_path):
    """Same as the SQL, with ties, repeats, kinds, missing and short vectors; and what is shuffled doesn't follow chunks times queries."""
    connection, chunks, queries = duckdb.connect(), 6000, 100
    vector = "list_transform(range(8), lambda j: (hash({} * 8 + j) % 2000)::FLOAT / 1000 - 1)"
    tables = {
        "files": "SELECT i AS file_id, '/f/' || i AS path, i AS size, i AS modified_nanoseconds, '' AS content_hash, TIMESTAMP '2026-01-01' AS recorded_at FROM range(300) t(i)",
        "chunks": f"""SELECT least(i, {chunks - 10}) AS chunk_id, i % 310 AS file_id, ['text', 'PDF', 'audio', NULL][i % 4 + 1] AS kind, 'common ' || if(i % 7 = 0, 'usual ', '') || 'w' || (i % 90) AS text,
          CASE WHEN i % 50 = 0 THEN NULL WHEN i % 51 = 0 THEN [1]::FLOAT[] ELSE {vector.format('i % 2500')} END AS embedding, TIMESTAMP '2026-01-01' + INTERVAL (i) SECOND AS recorded_at FROM range({chunks}) t(i)""",
        "search_queries": f"SELECT i AS query_id, 'common ' || CASE i % 4 WHEN 0 THEN 'usual' WHEN 1 THEN 'nowhere' ELSE 'w' || i END AS query_text, if(i % 5 = 0, NULL, i % 3)::DOUBLE AS keyword_weight, if(i % 6 = 0, 'Text', NULL) AS kind, 10 AS result_limit FROM range({queries}) t(i)",
        "embeddings": f"SELECT i AS vec_id, {vector.format('(i + 9000)')} AS embedding FROM range({queries - 3}) t(i)",
    }
    for name, sql in tables.items():
        connection.execute(f"COPY ({sql}) TO '{tmp_path}/{name}.parquet' (FORMAT parquet)")
        connection.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{tmp_path}/{name}.parquet')")
    java = spark.sparkContext._gateway
    context = spark.sparkContext._jsc.sc()

    def shuffled() -> int:
        context.listenerBus().waitUntilEmpty(30_000)
        stages = context.statusStore().stageList(None, False, False, java.new_array(java.jvm.double, 0), java.jvm.java.util.ArrayList())
        return sum(stages.apply(i).shuffleWriteRecords() for i in range(stages.size()))

    before = shuffled()
    mine = sorted(tuple(map(plain, r)) for r in QUERIES["hybrid_end_to_end"](spark, str(tmp_path)).collect())
    assert shuffled() - before < chunks * queries / 2
    assert mine == sorted(tuple(map(plain, r)) for r in connection.execute(SQL["hybrid_end_to_end"]).fetchall())
    assert len(mine) > 900
