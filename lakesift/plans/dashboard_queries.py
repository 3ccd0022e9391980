"""Queries of the dashboard, over whole tables. "Now" is a constant of the test tables; pages and top-n reports keep their limits."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lakesift.operators import dashboard as d
from lakesift.operators import reports
from lakesift.runtime import fresh_path, table

TEAM = "9e8465c9-0000-407e-8000-000000000001"
WEEK, WEEK_END = "2025-06-09 00:00:00", "2025-06-16 00:00:00"
SINCE = "2025-06-20 00:00:00"
BOUNDS, LABELS = [0, 10, 50, 100, 500, 1000], ["0", "1-10", "11-50", "51-100", "101-500", "501-1000", "1000+"]
MS, MS_LABELS = [100, 500, 1000, 5000, 30000], ["<100ms", "100-500ms", "500ms-1s", "1-5s", "5-30s", "30s+"]


def _scans(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "scans")


def _single(spark: SparkSession, sf: str) -> DataFrame:
    """Scans with each id once, as received last."""
    return d.latest_by(_scans(spark, sf), "id", F.col("received_at"))


def scans_page(spark: SparkSession, sf: str) -> DataFrame:
    """The second page of a team's scans."""
    return d.list_scans(_single(spark, sf), TEAM, 10, 10).select("id", "project_name", "findings_count")


def scan_drilldown(spark: SparkSession, sf: str) -> DataFrame:
    """Findings of the scans of every team, by scan and severity rank."""
    found = d.scan_findings(table(spark, sf, "scan_findings"), _scans(spark, sf))
    return found.groupBy("scan_id", "severity_rank").agg(F.count("*").alias("n"), F.min("line").alias("first_line"))


def trend_daily(spark: SparkSession, sf: str) -> DataFrame:
    """Daily scans and findings."""
    return d.daily_trend(_single(spark, sf)).withColumn("day", F.date_format("day", "yyyy-MM-dd"))


def trend_window(spark: SparkSession, sf: str) -> DataFrame:
    """Daily scans and findings over the trailing 30 days."""
    return d.daily_trend(_single(spark, sf), F.lit("2025-06-30").cast("date"), 30).withColumn("day", F.date_format("day", "yyyy-MM-dd"))


def trend_weekly(spark: SparkSession, sf: str) -> DataFrame:
    """Findings per team and week against the week before."""
    return d.weekly_stats(_single(spark, sf)).withColumn("week", F.date_format("week", "yyyy-MM-dd"))


def top_projects(spark: SparkSession, sf: str) -> DataFrame:
    """The five projects with the most findings."""
    return d.top_projects(_single(spark, sf))


def type_distribution(spark: SparkSession, sf: str) -> DataFrame:
    """Types over the ten latest scans of every team."""
    return d.type_distribution(_single(spark, sf))


def active_teams(spark: SparkSession, sf: str) -> DataFrame:
    """Teams with a scan in the last days."""
    return d.active_teams(table(spark, sf, "teams"), _scans(spark, sf), F.lit(SINCE).cast("timestamp_ntz")).select("id", "name")


def subscriptions(spark: SparkSession, sf: str) -> DataFrame:
    """The current row of every subscription."""
    return d.subscriptions(table(spark, sf, "stripe_messages")).select("subscription", "customer", "status", "price", "period_end", "route", d.plan_of(F.col("status")).alias("plan"))


def subscriptions_merged(spark: SparkSession, sf: str) -> DataFrame:
    """The table of subscriptions after its messages were merged in two batches, the later ones first."""
    messages, kept = table(spark, sf, "stripe_messages"), d.Subscriptions(spark, fresh_path(spark, "subscriptions"))
    late = F.pmod("delivery_no", F.lit(2)) == 1
    for n, part in enumerate((messages.where(late), messages.where(~late))):
        kept.load(part, f"batch {n}")
    return kept.current().select("subscription", "customer", "status", "price", "period_end", "route", d.plan_of(F.col("status")).alias("plan"))


def weekly_summary(spark: SparkSession, sf: str) -> DataFrame:
    """The weekly report's row of every team with a scan in a week, with its top types."""
    return d.weekly_summary(_single(spark, sf), F.lit(WEEK).cast("timestamp_ntz"), F.lit(WEEK_END).cast("timestamp_ntz"))


def top_types_of_week(spark: SparkSession, sf: str) -> DataFrame:
    """The five most frequent types of every team in a week."""
    return d.top_types(_single(spark, sf), F.lit(WEEK).cast("timestamp_ntz"), F.lit(WEEK_END).cast("timestamp_ntz"))


def team_plans(spark: SparkSession, sf: str) -> DataFrame:
    """Every team's plan by its latest subscription."""
    return d.team_plans(table(spark, sf, "teams"), table(spark, sf, "stripe_messages"))


def event_routes(spark: SparkSession, sf: str) -> DataFrame:
    """Deliveries by the route of their event type."""
    return d.billing_events(table(spark, sf, "stripe_messages")).groupBy("route", "event_type").agg(F.count("*").alias("n"))


def scan_alerts(spark: SparkSession, sf: str) -> DataFrame:
    """Scans that call for a message."""
    return reports.alerts(_single(spark, sf))


def bucket_sizes(spark: SparkSession, sf: str) -> DataFrame:
    """Scans by size and duration class."""
    rows = _single(spark, sf)
    return rows.groupBy(reports.bucket(F.col("files_scanned"), BOUNDS, LABELS).alias("files"), reports.bucket(F.col("duration_ms"), MS, MS_LABELS).alias("duration")).agg(F.count("*").alias("n"))


def latest_per_user(spark: SparkSession, sf: str) -> DataFrame:
    """The latest event of every user: what a document stream keeps per key."""
    return d.latest_by(table(spark, sf, "events"), "user_id", F.struct("ts", "event_id")).select("user_id", "event_id", "event_type")


def key_hashes(spark: SparkSession, sf: str) -> DataFrame:
    """Hashes of customer keys."""
    return table(spark, sf, "teams").select("id", d.hashed_key(F.col("stripe_customer_id")).alias("key_hash"))


QUERIES = {
    f.__name__: f
    for f in (
        scans_page, scan_drilldown, trend_daily, trend_window, trend_weekly, top_projects, type_distribution, active_teams, subscriptions, subscriptions_merged, weekly_summary, top_types_of_week, team_plans, event_routes, scan_alerts, bucket_sizes,
        latest_per_user, key_hashes,
    )
}

_ONE = "WITH one AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY received_at DESC) AS rn FROM scans WHERE id IS NOT NULL) WHERE rn = 1)"
_TREND = """SELECT strftime(created_at, '%Y-%m-%d') AS day, count(*) AS scans, CAST(coalesce(sum(findings_count), 0) AS BIGINT) AS findings_count,
  CAST(coalesce(sum(critical_count), 0) AS BIGINT) AS critical_count, CAST(coalesce(sum(high_count), 0) AS BIGINT) AS high_count FROM one WHERE created_at IS NOT NULL"""
_ROUTE = """CASE WHEN event_type = 'checkout.session.completed' THEN 'checkout' WHEN event_type IN ('customer.subscription.created', 'customer.subscription.updated') THEN 'upsert'
  WHEN event_type = 'customer.subscription.deleted' THEN 'cancel' WHEN event_type = 'invoice.payment_failed' THEN 'payment_failed' ELSE 'ignored' END"""
_BILLING = f"""WITH e AS (SELECT delivery_no, event_type, {_ROUTE} AS route, payload->>'$.object.id' AS subscription, payload->>'$.object.customer' AS customer, payload->>'$.object.status' AS status,
  payload->>'$.object.items.data[0].price.id' AS price, CAST(payload->>'$.object.current_period_end' AS BIGINT) AS period_end FROM stripe_messages)"""


def _bucket(col: str, bounds: list[int], labels: list[str]) -> str:
    return "CASE " + " ".join(f"WHEN {col} <= {b} THEN '{x}'" for b, x in zip(bounds, labels, strict=False)) + f" WHEN {col} IS NOT NULL THEN '{labels[-1]}' END"


_TOP = f""", wk AS (SELECT * FROM one WHERE team_id IS NOT NULL AND created_at >= TIMESTAMP '{WEEK}' AND created_at < TIMESTAMP '{WEEK_END}'),
x AS (SELECT team_id, unnest(json_keys(CAST(pii_type_summary AS JSON))) AS pii_type, CAST(pii_type_summary AS JSON) AS j FROM wk WHERE pii_type_summary IS NOT NULL),
r AS (SELECT *, row_number() OVER (PARTITION BY team_id ORDER BY n DESC, pii_type) AS place FROM (SELECT team_id, pii_type, CAST(sum(CAST(j->>pii_type AS BIGINT)) AS BIGINT) AS n FROM x GROUP BY ALL)) """

SQL = {
    "scans_page": _ONE + f"SELECT id, project_name, findings_count FROM one WHERE team_id = '{TEAM}' ORDER BY created_at DESC, id LIMIT 10 OFFSET 10",
    "scan_drilldown": """SELECT scan_id, CASE lower(trim(severity)) WHEN 'critical' THEN 3 WHEN 'high' THEN 2 WHEN 'medium' THEN 1 ELSE 0 END AS severity_rank, count(*) AS n, min(line) AS first_line
FROM scan_findings WHERE scan_id IN (SELECT id FROM scans WHERE team_id IS NOT NULL) GROUP BY ALL""",
    "trend_daily": _ONE + _TREND + " GROUP BY day",
    "trend_window": _ONE + _TREND + " AND CAST(created_at AS DATE) > DATE '2025-06-30' - 30 GROUP BY day",
    "trend_weekly": _ONE
    + """, w AS (SELECT team_id, CAST(date_trunc('week', created_at) AS DATE) AS wk, count(*) AS scans, CAST(coalesce(sum(findings_count), 0) AS BIGINT) AS findings FROM one
  WHERE team_id IS NOT NULL AND created_at IS NOT NULL GROUP BY ALL)
SELECT a.team_id, strftime(a.wk, '%Y-%m-%d') AS week, a.scans, a.findings, coalesce(b.findings, 0) AS before,
  CASE WHEN a.findings > coalesce(b.findings, 0) THEN 'up' WHEN a.findings < coalesce(b.findings, 0) THEN 'down' ELSE 'stable' END AS trend
FROM w a LEFT JOIN w b ON a.team_id = b.team_id AND b.wk = a.wk - 7""",
    "top_projects": _ONE + "SELECT project_name, CAST(coalesce(sum(findings_count), 0) AS BIGINT) AS total FROM one GROUP BY project_name ORDER BY total DESC, project_name LIMIT 5",
    "type_distribution": _ONE
    + """, l AS (SELECT team_id, CAST(pii_type_summary AS JSON) AS j FROM (SELECT *, row_number() OVER (PARTITION BY team_id ORDER BY created_at DESC, id DESC) AS k FROM one WHERE team_id IS NOT NULL) WHERE k <= 10),
x AS (SELECT team_id, unnest(json_keys(j)) AS pii_type, j FROM l)
SELECT team_id, pii_type, CAST(sum(CAST(j->>pii_type AS BIGINT)) AS BIGINT) AS n FROM x GROUP BY ALL""",
    "active_teams": f"SELECT id, name FROM teams WHERE id IN (SELECT team_id FROM scans WHERE created_at >= TIMESTAMP '{SINCE}')",
    "subscriptions": _BILLING
    + """SELECT subscription, customer, status, price, period_end, route, CASE WHEN status IN ('active', 'trialing') THEN 'pro' ELSE 'free' END AS plan
FROM (SELECT *, row_number() OVER (PARTITION BY subscription ORDER BY delivery_no DESC) AS rn FROM e WHERE subscription IS NOT NULL) WHERE rn = 1""",
    "top_types_of_week": _ONE + _TOP + "SELECT team_id, pii_type, n, CAST(place AS INTEGER) AS place FROM r WHERE place <= 5",
    "weekly_summary": _ONE
    + _TOP
    + """, now AS (SELECT team_id, count(*) AS scans, CAST(coalesce(sum(findings_count), 0) AS BIGINT) AS findings FROM wk GROUP BY team_id),
old AS (SELECT team_id, CAST(coalesce(sum(findings_count), 0) AS BIGINT) AS f FROM one WHERE team_id IS NOT NULL AND created_at >= TIMESTAMP '"""
    + WEEK
    + "' - INTERVAL 7 DAY AND created_at < TIMESTAMP '"
    + WEEK
    + """' GROUP BY team_id),
t AS (SELECT team_id, string_agg(pii_type, ',' ORDER BY place) AS top_types FROM r WHERE place <= 5 GROUP BY team_id)
SELECT now.team_id, scans, findings, coalesce(f, 0) AS findings_before, CASE WHEN findings > coalesce(f, 0) THEN 'up' WHEN findings < coalesce(f, 0) THEN 'down' ELSE 'stable' END AS trend, coalesce(top_types, '') AS top_types
FROM now LEFT JOIN old USING (team_id) LEFT JOIN t USING (team_id)""",
    "team_plans": _BILLING
    + """, l AS (SELECT customer, status FROM (SELECT *, row_number() OVER (PARTITION BY customer ORDER BY delivery_no DESC) AS rn FROM e WHERE customer IS NOT NULL) WHERE rn = 1)
SELECT id, name, stripe_customer_id, CASE WHEN status IN ('active', 'trialing') THEN 'pro' ELSE 'free' END AS current_plan FROM teams LEFT JOIN l ON customer = stripe_customer_id""",
    "event_routes": _BILLING + "SELECT route, event_type, count(*) AS n FROM e GROUP BY ALL",
    "bucket_sizes": _ONE + f"SELECT {_bucket('files_scanned', BOUNDS, LABELS)} AS files, {_bucket('duration_ms', MS, MS_LABELS)} AS duration, count(*) AS n FROM one GROUP BY ALL",
    "latest_per_user": "SELECT user_id, event_id, event_type FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS rn FROM events WHERE user_id IS NOT NULL) WHERE rn = 1",
    "key_hashes": "SELECT id, sha256(stripe_customer_id) AS key_hash FROM teams",
    "scan_alerts": _ONE
    + """, a AS (SELECT * FROM one WHERE coalesce(critical_count, 0) > 0 OR coalesce(high_count, 0) > 0),
k AS (SELECT id, unnest(json_keys(CAST(pii_type_summary AS JSON))) AS t, CAST(pii_type_summary AS JSON) AS j FROM a),
l AS (SELECT id, string_agg(t, ',' ORDER BY CAST(j->>t AS BIGINT) DESC, t) AS top_types FROM k GROUP BY id)
SELECT id, team_id, project_name, critical_count, high_count, CASE WHEN pii_type_summary IS NULL THEN NULL ELSE coalesce(top_types, '') END AS top_types FROM a LEFT JOIN l USING (id)""",
}
SQL["subscriptions_merged"] = SQL["subscriptions"]
