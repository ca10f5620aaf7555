"""Queries on new and changed records (problem 4)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from quarry.operators import changes
from quarry.session import table


def p4_intervals(spark: SparkSession, sf: str) -> DataFrame:
    return changes.content_intervals(table(spark, sf, "files"), table(spark, sf, "scan_runs"), table(spark, sf, "file_sightings"))


def p4_found(spark: SparkSession, sf: str) -> DataFrame:
    return changes.paths_to_process(table(spark, sf, "files"), table(spark, sf, "scan_runs"), table(spark, sf, "file_sightings"))


QUERIES = {f.__name__: f for f in (p4_found, p4_intervals)}

_STATES = r"""
runs AS (
  SELECT scan_id, row_number() OVER (ORDER BY started_at NULLS LAST, scan_id) AS number
  FROM (SELECT *, row_number() OVER (PARTITION BY scan_id ORDER BY recorded_at DESC, finished_at DESC NULLS LAST) AS k FROM scan_runs)
  WHERE k = 1 AND run_status = 'succeeded'),
states AS (
  SELECT path, 0 AS number, content FROM (
    SELECT path, lower(regexp_replace(content_hash, '^\s*[A-Za-z][A-Za-z0-9_-]*:', '')) AS content,
      row_number() OVER (PARTITION BY path ORDER BY recorded_at DESC) AS k FROM files WHERE path IS NOT NULL) WHERE k = 1
  UNION ALL
  SELECT path, number, content FROM (
    SELECT path, number, lower(regexp_replace(content_hash, '^\s*[A-Za-z][A-Za-z0-9_-]*:', '')) AS content,
      row_number() OVER (PARTITION BY path, s.scan_id ORDER BY seen_at DESC, arrived_at DESC) AS k
    FROM file_sightings s JOIN runs r ON s.scan_id = r.scan_id WHERE path IS NOT NULL) WHERE k = 1)
"""
SQL = {
    "p4_found": f"""WITH {_STATES},
present AS (SELECT *, number - row_number() OVER (PARTITION BY path ORDER BY number) AS stay FROM states),
known AS (SELECT *, last_value(content IGNORE NULLS) OVER (PARTITION BY path, stay ORDER BY number ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM present)
SELECT r.scan_id, k.path FROM known k JOIN runs r ON k.number = r.number
WHERE k.content IS NOT NULL AND k.content IS DISTINCT FROM k.before""",
    "p4_intervals": f"""WITH {_STATES},
present AS (SELECT *, number - row_number() OVER (PARTITION BY path ORDER BY number) AS stay FROM states),
known AS (SELECT *, last_value(content IGNORE NULLS) OVER (PARTITION BY path, stay ORDER BY number ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM present),
versions AS (SELECT *, sum((content IS NOT NULL AND content IS DISTINCT FROM before)::INT) OVER (PARTITION BY path, stay ORDER BY number) AS version FROM known)
SELECT path, max(content) AS content, min(number) AS from_number, max(number) AS to_number FROM versions WHERE version > 0 GROUP BY path, stay, version""",
}
