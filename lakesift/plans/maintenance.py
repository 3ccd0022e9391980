"""Queries of the table-maintenance operators (snapshot changes, deliveries, nested records, rolling totals)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lakesift.operators.delivery import SeenState, dropped_in_batches
from lakesift.operators.finding_tables import child_records
from lakesift.operators.rolling import ScanTotals, averages, load_by_last_day
from lakesift.operators.snapshots import finding_changes
from lakesift.runtime import fresh_path, table

COUNTS = ("findings_7d", "critical_7d", "findings_30d", "critical_30d")


def p1_found(spark: SparkSession, sf: str) -> DataFrame:
    """Fingerprints added, removed or changed in each snapshot against the one before."""
    changes = finding_changes(table(spark, sf, "finding_snapshots"))
    return changes.select("project_name", "snapshot_no", "change_kind", "file", "pii_type", "code_snippet_norm", "sink_kind")


def p1_change_counts(spark: SparkSession, sf: str) -> DataFrame:
    """Number of changes by project, snapshot and kind."""
    changes = finding_changes(table(spark, sf, "finding_snapshots"))
    return changes.groupBy("project_name", "snapshot_no", "change_kind").agg(F.count("*").alias("n"))


def p2_found(spark: SparkSession, sf: str) -> DataFrame:
    """Deliveries to be dropped; two batches in the order of arrival, so that the second meets stored bits."""
    state = SeenState(spark, fresh_path(spark, "deliveries-seen"))
    return dropped_in_batches(table(spark, sf, "stripe_messages"), "id", "delivery_no", state)


def p3_found(spark: SparkSession, sf: str) -> DataFrame:
    """Child records of findings, saved and stored as JSON text."""
    saved = child_records(table(spark, sf, "findings"), "findings")
    return saved.unionByName(child_records(table(spark, sf, "scan_findings"), "scan_findings"))


def _scan_totals(spark: SparkSession, sf: str) -> DataFrame:
    return load_by_last_day(table(spark, sf, "scans"), ScanTotals(spark, fresh_path(spark, "scan-totals")))


def p6_found(spark: SparkSession, sf: str) -> DataFrame:
    """Trailing 7- and 30-day totals per team and day."""
    return _scan_totals(spark, sf).select(
        F.col("entity").alias("team_id"), F.date_format("day", "yyyy-MM-dd").alias("scan_day"), *COUNTS
    )


def p6_averages(spark: SparkSession, sf: str) -> DataFrame:
    """Trailing 7- and 30-day daily averages per team and day."""
    state = averages(_scan_totals(spark, sf), ["findings", "critical"], [7, 30])
    return state.select(
        F.col("entity").alias("team_id"),
        F.date_format("day", "yyyy-MM-dd").alias("scan_day"),
        *[f"{a}_avg_{p}d" for p in (7, 30) for a in ("findings", "critical")],
    )


QUERIES = {f.__name__: f for f in (p1_found, p1_change_counts, p2_found, p3_found, p6_found, p6_averages)}

_CHANGES = r"""
WITH s AS (
  SELECT DISTINCT project_name, CAST(snapshot_no AS BIGINT) AS n,
    trim(regexp_replace(replace(file, '\', '/'), '\s+', ' ', 'g')) AS file,
    trim(regexp_replace(pii_type, '\s+', ' ', 'g')) AS pii_type,
    trim(regexp_replace(code_snippet_norm, '\s+', ' ', 'g')) AS code_snippet_norm,
    trim(regexp_replace(coalesce(sink_kind, ''), '\s+', ' ', 'g')) AS sink_kind,
    lower(trim(severity)) AS sv, line
  FROM finding_snapshots WHERE project_name IS NOT NULL AND snapshot_no IS NOT NULL),
o AS (
  SELECT project_name, n, lag(n) OVER w AS before, lead(n) OVER w AS after
  FROM (SELECT DISTINCT project_name, n FROM s) WINDOW w AS (PARTITION BY project_name ORDER BY n)),
a AS (SELECT s.* FROM s JOIN o USING (project_name, n) WHERE before IS NOT NULL),
b AS (SELECT s.* REPLACE (o.after AS n) FROM s JOIN o USING (project_name, n) WHERE after IS NOT NULL),
changes AS (
  SELECT coalesce(a.project_name, b.project_name) AS project_name, coalesce(a.n, b.n) AS snapshot_no,
    CASE WHEN b.n IS NULL THEN 'added' WHEN a.n IS NULL THEN 'removed'
         WHEN a.sv IS DISTINCT FROM b.sv OR a.line IS DISTINCT FROM b.line THEN 'changed' END AS change_kind,
    coalesce(a.file, b.file) AS file, coalesce(a.pii_type, b.pii_type) AS pii_type,
    coalesce(a.code_snippet_norm, b.code_snippet_norm) AS code_snippet_norm, coalesce(a.sink_kind, b.sink_kind) AS sink_kind
  FROM a FULL JOIN b ON a.project_name = b.project_name AND a.n = b.n AND a.file IS NOT DISTINCT FROM b.file
    AND a.pii_type IS NOT DISTINCT FROM b.pii_type AND a.code_snippet_norm IS NOT DISTINCT FROM b.code_snippet_norm
    AND a.sink_kind = b.sink_kind)
"""

_ROLLING = """
WITH one AS (SELECT id, any_value(team_id) AS team_id, CAST(min(created_at) AS DATE) AS d,
    coalesce(any_value(findings_count), 0) AS f, coalesce(any_value(critical_count), 0) AS c
  FROM scans GROUP BY id),
daily AS (SELECT team_id, d, sum(f) AS f, sum(c) AS c FROM one WHERE team_id IS NOT NULL AND d IS NOT NULL GROUP BY ALL),
span AS (SELECT team_id, min(d) AS lo, max(d) AS hi FROM daily GROUP BY ALL),
cal AS (SELECT team_id, CAST(unnest(generate_series(lo, hi, INTERVAL 1 DAY)) AS DATE) AS d FROM span),
filled AS (SELECT team_id, d, coalesce(f, 0) AS f, coalesce(c, 0) AS c FROM cal LEFT JOIN daily USING (team_id, d)),
rolled AS (SELECT team_id, strftime(d, '%Y-%m-%d') AS scan_day,
    CAST(sum(f) OVER s AS BIGINT) AS findings_7d, CAST(sum(c) OVER s AS BIGINT) AS critical_7d,
    CAST(sum(f) OVER m AS BIGINT) AS findings_30d, CAST(sum(c) OVER m AS BIGINT) AS critical_30d
  FROM filled WINDOW s AS (PARTITION BY team_id ORDER BY d ROWS 6 PRECEDING), m AS (PARTITION BY team_id ORDER BY d ROWS 29 PRECEDING))
"""

_CHILDREN = r"""
WITH sf1 AS (SELECT id, any_value(data_flow) AS a, any_value(framework_mappings) AS b FROM scan_findings GROUP BY id),
v AS (SELECT id, CASE WHEN json_valid(a) THEN a END AS a, CASE WHEN json_valid(b) THEN b END AS b FROM sf1),
w AS (SELECT id, CASE WHEN json_type(a) = 'VARCHAR' THEN json_extract_string(a, '$') ELSE a END AS a,
    CASE WHEN json_type(b) = 'VARCHAR' THEN json_extract_string(b, '$') ELSE b END AS b FROM v),
x AS (SELECT id, CASE WHEN json_valid(a) THEN CAST(a AS JSON) END AS a, CASE WHEN json_valid(b) THEN CAST(b AS JSON) END AS b FROM w),
y AS (SELECT id,
    CASE WHEN json_type(a) = 'OBJECT' THEN a WHEN json_type(a) = 'ARRAY' AND json_array_length(a) = 1 AND json_type(a->0) = 'OBJECT' THEN a->0 END AS a,
    CASE WHEN json_type(b) = 'ARRAY' THEN b WHEN json_type(b) = 'OBJECT' THEN json_array(b) END AS b FROM x),
ends AS (SELECT id, 'flow_' || k AS child, 0 AS pos, a->k AS e FROM y, (VALUES ('source'), ('sink')) t(k)),
steps AS (SELECT id, p, unnest(range(CAST(json_array_length(p) AS BIGINT))) AS pos
  FROM (SELECT id, CASE WHEN json_type(a->'path') = 'ARRAY' THEN a->'path' WHEN json_type(a->'path') IN ('OBJECT', 'VARCHAR') THEN json_array(a->'path') END AS p FROM y)),
maps AS (SELECT id, b, unnest(range(CAST(json_array_length(b) AS BIGINT))) AS pos FROM y),
f AS (SELECT id, any_value(data_flow) AS a, any_value(framework_mappings) AS b FROM findings GROUP BY id)
SELECT 'scan_findings' AS source_table, id AS finding_id, child, CAST(pos AS BIGINT) AS pos,
  CASE WHEN json_type(e) = 'OBJECT' THEN e->>'kind' ELSE json_extract_string(e, '$') END AS item
FROM ends WHERE json_type(e) IN ('OBJECT', 'VARCHAR')
UNION ALL SELECT 'scan_findings', id, 'flow_path', CAST(pos AS BIGINT),
  CASE WHEN json_type(p->pos) = 'OBJECT' THEN (p->pos)->>'file' ELSE json_extract_string(p->pos, '$') END
FROM steps WHERE json_type(p->pos) IN ('OBJECT', 'VARCHAR')
UNION ALL SELECT 'scan_findings', id, 'mapping', CAST(pos AS BIGINT), (b->pos)->>'article' FROM maps WHERE json_type(b->pos) = 'OBJECT'
UNION ALL SELECT 'findings', id, 'flow_source', 0, a.source.kind FROM f WHERE a.source IS NOT NULL
UNION ALL SELECT 'findings', id, 'flow_sink', 0, a.sink.kind FROM f WHERE a.sink IS NOT NULL
UNION ALL SELECT 'findings', id, 'flow_path', pos - 1, a.path[pos].file FROM (SELECT id, a, unnest(range(1, len(a.path) + 1)) AS pos FROM f) WHERE a.path[pos] IS NOT NULL
UNION ALL SELECT 'findings', id, 'mapping', pos - 1, b[pos].article FROM (SELECT id, b, unnest(range(1, len(b) + 1)) AS pos FROM f) WHERE b[pos] IS NOT NULL
"""

SQL = {
    "p1_found": _CHANGES + "SELECT * FROM changes WHERE change_kind IS NOT NULL",
    "p1_change_counts": _CHANGES
    + "SELECT project_name, snapshot_no, change_kind, count(*) AS n FROM changes WHERE change_kind IS NOT NULL GROUP BY ALL",
    "p2_found": r"""
SELECT id, delivery_no FROM (
  SELECT regexp_replace(id, '^\s+|\s+$', '', 'g') AS id, delivery_no,
    min(delivery_no) OVER (PARTITION BY regexp_replace(id, '^\s+|\s+$', '', 'g')) AS lowest
  FROM stripe_messages WHERE id IS NOT NULL) WHERE delivery_no > lowest""",
    "p3_found": _CHILDREN,
    "p6_found": _ROLLING + "SELECT * FROM rolled",
    "p6_averages": _ROLLING
    + """SELECT team_id, scan_day, round(findings_7d / 7.0, 6) AS findings_avg_7d, round(critical_7d / 7.0, 6) AS critical_avg_7d,
  round(findings_30d / 30.0, 6) AS findings_avg_30d, round(critical_30d / 30.0, 6) AS critical_avg_30d FROM rolled""",
}
