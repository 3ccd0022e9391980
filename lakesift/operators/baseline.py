"""Baseline diff of two scans: each current finding against the first baseline finding of its fingerprint.

A fingerprint is path, type, snippet and sink in compared form; it is hashed once, and both joins are on the hash. Unmatched current findings
are added; baseline findings (all of them) whose fingerprint is gone are removed.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lakesift.functions.names import rank
from lakesift.operators.snapshots import one_blank, row_hash
from lakesift.rules.dictionary import SEVERITY_RANK

KINDS = ["added", "modified", "removed", "unchanged"]


def fingerprint(f: DataFrame) -> Column:
    """Hash of a finding's fingerprint."""
    sink = F.coalesce(F.col("data_flow.sink.kind"), F.lit(""))
    return row_hash([F.translate("location.file", "\\", "/"), F.col("pii_type"), one_blank(F.col("code_snippet")), sink])


def _changes(old: str, new: str) -> Column:
    def text(side: str, what: str) -> Column:
        c = F.col(f"{side}.{what}")
        return F.coalesce(c.cast("string"), F.lit("none"))

    def flow(side: str) -> Column:
        return F.when(F.col(f"{side}.data_flow").isNull(), "none").otherwise("present")

    def count(side: str) -> Column:
        return F.concat(F.coalesce(F.size(F.col(f"{side}.framework_mappings")), F.lit(0)).cast("string"), F.lit(" mapping(s)"))

    pairs = [
        ("severity", text(old, "severity"), text(new, "severity")),
        ("line", text(old, "location.line"), text(new, "location.line")),
        ("data_flow", flow(old), flow(new)),
        ("framework_mappings", count(old), count(new)),
        ("confidence", text(old, "confidence"), text(new, "confidence")),
    ]
    each = [F.when(a != b, F.struct(F.lit(n).alias("field"), a.alias("old_value"), b.alias("new_value"))) for n, a, b in pairs]
    return F.filter(F.array(*each), lambda x: x.isNotNull())


def diff(baseline: DataFrame, current: DataFrame, order: Column | None = None) -> DataFrame:
    """(change, finding, changes) of every current finding and every removed one.

    ``order`` tells which of several baseline findings with one fingerprint comes first (by default path order: line, column, id).
    """
    every = F.struct(*[F.col(c) for c in baseline.columns])
    place = order if order is not None else F.struct("location.line", "location.column", "id")
    old = baseline.withColumn("_k", fingerprint(baseline))
    first = old.groupBy("_k").agg(F.min_by(every, place).alias("old"))
    now = current.select(fingerprint(current).alias("_k"), F.struct(*[F.col(c) for c in current.columns]).alias("finding"))
    matched = now.join(first, "_k", "left").withColumn("changes", F.when(F.col("old").isNotNull(), _changes("old", "finding")))
    change = F.when(F.col("old").isNull(), "added").when(F.size("changes") > 0, "modified").otherwise("unchanged")
    kept = matched.select(change.alias("change"), "finding", F.coalesce("changes", F.array().cast(matched.schema["changes"].dataType)).alias("changes"))
    gone = old.join(now.select("_k").distinct(), "_k", "left_anti").select(
        F.lit("removed").alias("change"), every.alias("finding"), F.array().cast(matched.schema["changes"].dataType).alias("changes")
    )
    return kept.unionByName(gone, allowMissingColumns=True)


def in_order(diffed: DataFrame) -> DataFrame:
    """Added, modified, removed, unchanged; in each the worst first, then by path component and line."""
    kind = F.array_position(F.array(*[F.lit(k) for k in KINDS]), F.col("change"))
    return diffed.orderBy(kind, rank(F.col("finding.severity"), SEVERITY_RANK).desc(), F.split("finding.location.file", "/"), "finding.location.line", "finding.id")


def summary(diffed: DataFrame) -> DataFrame:
    """One row: the four counts and the totals of both sides."""
    n = {k: F.count_if(F.col("change") == k).alias(k) for k in KINDS}
    return diffed.agg(*n.values()).withColumns(
        {"total_baseline": F.col("modified") + F.col("removed") + F.col("unchanged"), "total_current": F.col("added") + F.col("modified") + F.col("unchanged")}
    )


def displayed(diffed: DataFrame) -> DataFrame:
    """Without what is unchanged."""
    return diffed.where("change <> 'unchanged'")
