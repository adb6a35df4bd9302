"""Registered queries of the general operators for training data, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from plumbline.operators.snapshots import manifest_changes
from plumbline.session import ship, table


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    ship(spark)
    return manifest_changes(table(spark, sf_dir, "file_snapshots"), table(spark, sf_dir, "snapshots"))


QUERIES = {"p1_found": p1_found}

SQL = {
    "p1_found": r"""
WITH cleaned AS (
  SELECT repo, snapshot_no, delivered_at, lower(sha256) AS sha, size_bytes, mtime_ns,
         nfc_normalize(list_reduce(list_filter(string_split(replace(path, '\', '/'), '/'), lambda p: p <> '' AND p <> '.'),
           lambda acc, p: CASE WHEN p = '..' THEN regexp_replace(acc, '/[^/]*$', '') ELSE acc || '/' || p END, '')) AS p
  FROM file_snapshots),
state AS (
  SELECT repo, snapshot_no, ltrim(p, '/') AS path, sha, size_bytes, mtime_ns FROM cleaned
  QUALIFY row_number() OVER (PARTITION BY repo, snapshot_no, p
    ORDER BY delivered_at DESC, sha DESC NULLS LAST, size_bytes DESC NULLS LAST, mtime_ns DESC NULLS LAST) = 1),
seq AS (SELECT repo, snapshot_no, row_number() OVER (PARTITION BY repo ORDER BY snapshot_no) AS s FROM snapshots),
r AS (SELECT state.*, s FROM state JOIN seq USING (repo, snapshot_no)),
j AS (
  SELECT coalesce(a.repo, b.repo) AS repo, coalesce(a.s, b.s + 1) AS s, coalesce(a.path, b.path) AS path,
    CASE WHEN b.repo IS NULL THEN 'added' WHEN a.repo IS NULL THEN 'removed'
         WHEN a.sha IS NOT NULL AND b.sha IS NOT NULL THEN CASE WHEN a.sha <> b.sha THEN 'changed' END
         WHEN a.size_bytes IS DISTINCT FROM b.size_bytes OR a.mtime_ns IS DISTINCT FROM b.mtime_ns THEN 'changed' END AS change
  FROM r a FULL OUTER JOIN r b ON a.repo = b.repo AND a.s = b.s + 1 AND a.path = b.path)
SELECT j.repo, seq.snapshot_no, j.path, j.change FROM j JOIN seq ON seq.repo = j.repo AND seq.s = j.s
WHERE j.change IS NOT NULL AND j.s > 1
""",
}
