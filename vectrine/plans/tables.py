"""Queries over the record feeds: schema drift and incremental processing."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from vectrine.operators.schema_drift import drift_report, one_table
from vectrine.session import table
from vectrine.sources.sync import run_deltas

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(f):
    QUERIES[f.__name__] = f
    return f


@query
def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return drift_report(table(spark, sf_dir, "vectors"), table(spark, sf_dir, "serialized_records"), table(spark, sf_dir, "export_files"))


@query
def p2_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All records of all files under one schema."""
    return one_table(table(spark, sf_dir, "vectors"), table(spark, sf_dir, "serialized_records"), table(spark, sf_dir, "export_files"))


@query
def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return run_deltas(table(spark, sf_dir, "vectors"), table(spark, sf_dir, "sync_runs"))


SQL["p5_found"] = """
WITH r AS (SELECT run_id, started_at, row_number() OVER (ORDER BY started_at, run_id) AS n FROM sync_runs WHERE status = 'succeeded' AND started_at IS NOT NULL),
v AS (SELECT id, coalesce(CASE WHEN "timestamp" IS NULL OR "timestamp" = 0 THEN last_accessed ELSE "timestamp" END, -9223372036854775808) AS c, ingested_at FROM vectors WHERE id IS NOT NULL),
s AS (SELECT run_id, n, id, max(c) AS c FROM r JOIN v ON ingested_at <= started_at GROUP BY ALL)
SELECT a.run_id, a.id FROM s a LEFT JOIN s b ON b.id = a.id AND b.n = a.n - 1 WHERE b.id IS NULL OR a.c > b.c
"""

SQL["p2_found"] = """
WITH f AS (SELECT file_no, kind, lag(file_no) OVER (PARTITION BY stream ORDER BY seq_no) AS former_no FROM export_files WHERE stream IS NOT NULL AND seq_no IS NOT NULL),
body AS (
  SELECT v.file_no, 'r:' || v.id AS id, v.metadata::JSON AS m, NULL::JSON AS p FROM vectors v JOIN f ON f.file_no = v.file_no AND f.kind = 'rows' WHERE json_valid(v.metadata) AND json_type(v.metadata) = 'OBJECT'
  UNION ALL
  SELECT s.file_no, 'j:' || CASE WHEN json_type(payload, '$.id') = 'NULL' THEN NULL ELSE (payload::JSON -> '$.id')::VARCHAR END, payload::JSON -> '$.metadata', payload::JSON
  FROM serialized_records s JOIN f ON f.file_no = s.file_no AND f.kind = 'json' WHERE json_valid(payload) AND json_type(payload) = 'OBJECT'),
records AS (SELECT file_no, count(*) AS n FROM body GROUP BY file_no),
cells AS (
  SELECT file_no, id, 'metadata.' || k AS field, m -> ('$."' || k || '"') AS v FROM (SELECT *, unnest(json_keys(m)) AS k FROM body WHERE json_type(m) = 'OBJECT')
  UNION ALL
  SELECT file_no, id, k, p -> ('$."' || k || '"') FROM (SELECT *, unnest(json_keys(p)) AS k FROM body WHERE p IS NOT NULL) WHERE k NOT IN ('id', 'metadata')),
held AS (SELECT *, CASE json_type(v) WHEN 'VARCHAR' THEN 'string' WHEN 'BOOLEAN' THEN 'boolean' WHEN 'ARRAY' THEN 'array' WHEN 'OBJECT' THEN 'object' ELSE 'number' END AS kind FROM cells WHERE json_type(v) <> 'NULL'),
counted AS (SELECT file_no, field, kind, count(*) AS c FROM held GROUP BY ALL),
schemas AS (SELECT file_no, field, arg_min(kind, (-c, kind)) AS kind FROM counted JOIN records USING (file_no) GROUP BY file_no, field, n HAVING sum(c) >= n * 0.25),
later AS (SELECT f.file_no, former_no, field, s.kind FROM f JOIN schemas s USING (file_no) WHERE former_no IS NOT NULL),
former AS (SELECT f.file_no, former_no, field, s.kind FROM f JOIN schemas s ON s.file_no = f.former_no),
came AS (SELECT l.* FROM later l ANTI JOIN former o ON o.file_no = l.file_no AND o.field = l.field),
went AS (SELECT o.* FROM former o ANTI JOIN later l ON o.file_no = l.file_no AND o.field = l.field),
now AS (SELECT c.file_no, c.field, id, list_sort(list(DISTINCT v::VARCHAR)) AS vs FROM came c JOIN held h ON h.file_no = c.file_no AND h.field = c.field WHERE id IS NOT NULL GROUP BY ALL),
was AS (SELECT c.file_no, c.field, id, list_sort(list(DISTINCT v::VARCHAR)) AS vs FROM went c JOIN held h ON h.file_no = c.former_no AND h.field = c.field WHERE id IS NOT NULL GROUP BY ALL),
renamed AS (SELECT n.file_no, n.field, w.field AS former_field FROM now n JOIN was w ON w.file_no = n.file_no AND w.id = n.id GROUP BY ALL HAVING bool_and(n.vs = w.vs))
SELECT file_no, 'renamed' AS change, field, former_field FROM renamed
UNION ALL SELECT c.file_no, 'added', field, '' FROM came c ANTI JOIN renamed r ON r.file_no = c.file_no AND r.field = c.field
UNION ALL SELECT c.file_no, 'removed', field, '' FROM went c ANTI JOIN renamed r ON r.file_no = c.file_no AND r.former_field = c.field
UNION ALL SELECT l.file_no, 'retyped', l.field, '' FROM later l JOIN former o ON o.file_no = l.file_no AND o.field = l.field WHERE l.kind <> o.kind
"""
