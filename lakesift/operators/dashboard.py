"""Dashboard analytics over the tables of scans, findings, teams and billing events. ``now`` and page bounds are parameters."""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lakesift.functions.names import rank
from lakesift.operators.versions import Versions
from lakesift.rules.dictionary import SEVERITY_RANK

MAX_PAGE, MAX_DAYS = 100, 365
PAID = ("active", "trialing")


def list_scans(scans: DataFrame, team_id: str, limit: int = 50, offset: int = 0) -> DataFrame:
    """A page of a team's scans, newest first."""
    return scans.where(F.col("team_id") == team_id).orderBy(F.col("created_at").desc(), "id").offset(offset).limit(min(limit, MAX_PAGE))


def get_scan(scans: DataFrame, team_id: str, scan_id: str) -> DataFrame:
    """One scan of a team."""
    return scans.where((F.col("team_id") == team_id) & (F.col("id") == scan_id))


def scan_findings(findings: DataFrame, scans: DataFrame, team_id: str | None = None) -> DataFrame:
    """Findings of a team's scans (of all with a team), with their severity rank, worst first in a scan."""
    own = scans.where(F.col("team_id") == team_id if team_id else F.col("team_id").isNotNull()).select(F.col("id").alias("scan_id")).distinct()
    return findings.join(own, "scan_id", "left_semi").withColumn("severity_rank", rank(F.col("severity"), SEVERITY_RANK))


def daily_trend(scans: DataFrame, now: Column | None = None, days: int = 30) -> DataFrame:
    """Scans and findings per day; with ``now``, over the trailing days only."""
    rows = scans if now is None else scans.where(F.to_date("created_at") > F.date_sub(F.to_date(now), min(days, MAX_DAYS)))
    return rows.where("created_at is not null").groupBy(F.to_date("created_at").alias("day")).agg(
        F.count("*").alias("scans"), *[F.coalesce(F.sum(c), F.lit(0)).cast("bigint").alias(c) for c in ("findings_count", "critical_count", "high_count")]
    )


def type_distribution(scans: DataFrame, per_team: int = 10) -> DataFrame:
    """Types over each team's latest scans: the JSON maps, summed by key. Spark limits each team's rows before the shuffle already."""
    newest = Window.partitionBy("team_id").orderBy(F.col("created_at").desc(), F.col("id").desc())
    latest = scans.where("team_id is not null").select("team_id", "pii_type_summary", F.row_number().over(newest).alias("_n")).where(F.col("_n") <= per_team)
    each = latest.select("team_id", F.explode(F.from_json("pii_type_summary", "map<string,bigint>")).alias("pii_type", "n"))
    return each.groupBy("team_id", "pii_type").agg(F.sum("n").cast("bigint").alias("n"))


def active_teams(teams: DataFrame, scans: DataFrame, since: Column) -> DataFrame:
    """Teams with a scan since a time."""
    recent = scans.where(F.col("created_at") >= since).select(F.col("team_id").alias("id")).distinct()
    return teams.join(recent, "id", "left_semi")


def weekly_stats(scans: DataFrame) -> DataFrame:
    """Scans and findings per team and week (weeks begin on Monday), with the sum of the week before and the direction."""
    week = F.to_date(F.date_trunc("week", "created_at"))
    per = scans.where("team_id is not null and created_at is not null").groupBy("team_id", week.alias("week")).agg(
        F.count("*").alias("scans"), F.coalesce(F.sum("findings_count"), F.lit(0)).cast("bigint").alias("findings")
    )
    before = per.select("team_id", F.date_add("week", 7).alias("week"), F.col("findings").alias("before"))
    joined = per.join(before, ["team_id", "week"], "left").withColumn("before", F.coalesce("before", F.lit(0)))
    return joined.withColumn("trend", F.when(F.col("findings") > F.col("before"), "up").when(F.col("findings") < F.col("before"), "down").otherwise("stable"))


def top_projects(scans: DataFrame, n: int = 5) -> DataFrame:
    """The projects with the most findings (a top-n report)."""
    per = scans.groupBy("project_name").agg(F.coalesce(F.sum("findings_count"), F.lit(0)).cast("bigint").alias("total"))
    return per.orderBy(F.col("total").desc(), "project_name").limit(n)


def top_types(scans: DataFrame, since: Column, until: Column, n: int = 5) -> DataFrame:
    """The ``n`` most frequent types of each team's scans in a span of time: (team_id, pii_type, n, place)."""
    week = scans.where((F.col("created_at") >= since) & (F.col("created_at") < until) & F.col("team_id").isNotNull())
    each = week.select("team_id", F.explode(F.from_json("pii_type_summary", "map<string,bigint>")).alias("pii_type", "n"))
    sums = each.groupBy("team_id", "pii_type").agg(F.sum("n").cast("bigint").alias("n"))
    place = F.row_number().over(Window.partitionBy("team_id").orderBy(F.col("n").desc(), "pii_type"))  # types are bounded by the rules
    return sums.withColumn("place", place).where(F.col("place") <= n)


def owners(teams: DataFrame, users: DataFrame, key: str = "team_id", role: str = "role") -> DataFrame:
    """(team_id, user_id, email) of each team's owner, the oldest of several."""
    own = users.where((F.col(role) == "owner") & F.col(key).isNotNull())
    first = own.groupBy(key).agg(F.min_by(F.struct("id", "email"), F.struct("created_at", "id")).alias("u"))
    return teams.select(F.col("id").alias(key)).join(first, key).select(key, F.col("u.id").alias("user_id"), F.col("u.email").alias("email"))


def weekly_summary(scans: DataFrame, since: Column, until: Column) -> DataFrame:
    """One row per team with a scan in a week: scans, findings, those of the week before, the direction and the top types."""

    def per(a: Column, b: Column, *names: str) -> DataFrame:
        rows = scans.where((F.col("created_at") >= a) & (F.col("created_at") < b) & F.col("team_id").isNotNull())
        found = F.coalesce(F.sum("findings_count"), F.lit(0)).cast("bigint")
        return rows.groupBy("team_id").agg(F.count("*").alias(names[0]), found.alias(names[1]))

    span = until - since
    now, before = per(since, until, "scans", "findings"), per(since - span, since, "scans_before", "findings_before")
    types = top_types(scans, since, until).groupBy("team_id").agg(F.array_sort(F.collect_list(F.struct("place", "pii_type"))).alias("t"))
    joined = now.join(before, "team_id", "left").join(types, "team_id", "left").fillna(0, ["scans_before", "findings_before"])
    trend = F.when(F.col("findings") > F.col("findings_before"), "up").when(F.col("findings") < F.col("findings_before"), "down").otherwise("stable")
    return joined.select("team_id", "scans", "findings", "findings_before", trend.alias("trend"), F.coalesce(F.array_join("t.pii_type", ","), F.lit("")).alias("top_types"))


def latest_by(rows: DataFrame, key: str, order: Column) -> DataFrame:
    """The latest row of every key, one without an order only where no other is there; combines before the shuffle, so a busy key is one row per task."""
    every = F.struct(*[F.col(f"`{c}`") for c in rows.columns])
    place = F.struct(order.isNotNull(), order)
    return rows.where(F.col(key).isNotNull()).groupBy(key).agg(F.max_by(every, place).alias("_r")).select("_r.*")


def billing_events(messages: DataFrame) -> DataFrame:
    """Billing events as columns: subscription, customer, status, price and period end from the payload, and the route of the event type."""
    j = F.get_json_object
    kind = F.col("event_type")
    route = (
        F.when(kind == "checkout.session.completed", "checkout").when(kind.isin("customer.subscription.created", "customer.subscription.updated"), "upsert")
        .when(kind == "customer.subscription.deleted", "cancel").when(kind == "invoice.payment_failed", "payment_failed").otherwise("ignored")
    )
    return messages.select(
        "delivery_no", F.regexp_replace("id", r"(?U)^\s+|\s+$", "").alias("event_id"), "event_type", "received_at", route.alias("route"),
        j("payload", "$.object.id").alias("subscription"), j("payload", "$.object.customer").alias("customer"), j("payload", "$.object.status").alias("status"),
        j("payload", "$.object.items.data[0].price.id").alias("price"), j("payload", "$.object.current_period_end").cast("bigint").alias("period_end"),
    )


def subscriptions(messages: DataFrame) -> DataFrame:
    """The current row of every subscription: that of its last delivery."""
    return latest_by(billing_events(messages), "subscription", F.col("delivery_no"))


class Subscriptions(Versions):
    """The current row of every subscription as a versioned table that batches of messages are merged into."""

    def current(self) -> DataFrame | None:
        m = self.manifest()
        return self.spark.read.parquet(f"{self.path}/{m['folder']}/rows") if m else None

    def load(self, messages: DataFrame, batch: str | None = None) -> None:
        """Merge a batch: of each subscription the delivery with the greatest number holds, whatever batch it came in. A batch loaded before is not loaded again."""
        if self.committed(batch):
            return
        held, folder = self.current(), self.new_folder()
        fresh = billing_events(messages)
        merged = fresh if held is None else held.unionByName(fresh)
        self.write(latest_by(merged, "subscription", F.col("delivery_no")), folder, "rows")
        self.publish(self.version() + 1, {"folder": folder, "batch": batch if batch is not None else folder})


def plan_of(status: Column) -> Column:
    """Plan that a subscription status gives."""
    return F.when(status.isin(*PAID), "pro").otherwise("free")


def team_plans(teams: DataFrame, messages: DataFrame) -> DataFrame:
    """Teams with the plan of their customer's latest subscription; free without one."""
    latest = latest_by(billing_events(messages), "customer", F.col("delivery_no")).select(F.col("customer").alias("stripe_customer_id"), "status")
    return teams.join(latest, "stripe_customer_id", "left").select("id", "name", "stripe_customer_id", F.coalesce(F.when(F.col("status").isNotNull(), plan_of(F.col("status"))), F.lit("free")).alias("current_plan"))


def stored_scan(scans: DataFrame) -> DataFrame:
    """Scans as they are stored: arrays and maps as JSON text."""
    kinds = dict(scans.dtypes)
    return scans.withColumns({c: F.to_json(c) for c in scans.columns if kinds[c].startswith(("array", "map", "struct"))})


def signed(payload: Column, header: Column, secret: str, now: Column, tolerance: int = 300) -> Column:
    """Whether a webhook's header (``t=<seconds>,v1=<hex>``) signs its payload with the secret, within ``tolerance`` seconds of ``now`` (seconds since 1970)."""
    at = F.regexp_extract(header, r"(?:^|,)\s*t=(\d+)", 1)
    given = F.regexp_extract_all(header, F.lit(r"(?:^|,)\s*v1=([0-9a-fA-F]{64})"), F.lit(1))
    message = F.concat(at, F.lit("."), payload)
    key = secret.encode()
    key = (hashlib.sha256(key).digest() if len(key) > 64 else key).ljust(64, b"\0")
    inner, outer = (F.lit(bytes(b ^ x for b in key)) for x in (0x36, 0x5C))
    digest = F.sha2(F.concat(outer, F.unhex(F.sha2(F.concat(inner, F.encode(message, "UTF-8")), 256))), 256)
    fresh = F.abs(now - at.try_cast("bigint")) <= tolerance
    return F.coalesce((at != "") & fresh & F.array_contains(F.transform(given, F.lower), digest), F.lit(False))


def hashed_key(key: Column) -> Column:
    """SHA-256 of an access key."""
    return F.sha2(key, 256)
