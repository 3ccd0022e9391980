"""Reports and sinks: counts, tables, SARIF, Markdown, HTML, JSON, uploads and alerts."""

from __future__ import annotations

import html

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lakesift.functions.names import level_of, rank
from lakesift.operators.baseline import displayed
from lakesift.operators.frameworks import article_report
from lakesift.operators.suggest import described
from lakesift.rules.dictionary import SEVERITY_RANK

LEVELS = ["critical", "high", "medium", "low"]


def severity_summary(findings: DataFrame, *by: str) -> DataFrame:
    """Number of findings of each severity (case ignored), whole or by columns."""
    low = F.lower(F.trim("severity"))
    return findings.groupBy(*by).agg(*[F.count_if(low == s).alias(s) for s in LEVELS], F.count("*").alias("total"))


def type_counts(findings: DataFrame) -> DataFrame:
    """Findings by type."""
    return findings.groupBy("pii_type").agg(F.count("*").alias("n"))


def upload_payload(findings: DataFrame) -> DataFrame:
    """One row: counts by severity, the number of findings and the map of types; types are bounded by the rules, findings are not collected."""
    types = type_counts(findings).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("pii_type", "n")))).alias("pii_type_summary"))
    return severity_summary(findings).crossJoin(F.broadcast(types))  # one row each


def relative(path: Column, root: str) -> Column:
    """A path without the scan root."""
    return F.regexp_replace(path, "^\\Q" + root.rstrip("/") + "\\E/", "")


def display_path(path: Column, width: int = 38) -> Column:
    """The end of a long path."""
    return F.when(F.length(path) > width, F.concat(F.lit("..."), F.substring(path, -(width - 3), width - 3))).otherwise(path)


def table_rows(findings: DataFrame) -> DataFrame:
    """What the terminal table shows."""
    articles = F.array_join(F.array_distinct(F.transform("framework_mappings", lambda m: F.concat(m["framework"], F.lit(" "), m["article"]))), ", ")
    return findings.select("id", "severity", "pii_type", display_path(F.col("location.file")).alias("file"), F.col("location.line").alias("line"), articles.alias("articles"))


def sarif_level(severity: Column) -> Column:
    """SARIF level of a severity."""
    r = rank(severity, SEVERITY_RANK)
    return F.when(r >= 2, "error").when(r == 1, "warning").otherwise("note")


def sarif_results(findings: DataFrame) -> DataFrame:
    """One SARIF result per finding, flat; writing them as JSON lines scales, a single SARIF file is for what a person reads."""
    return findings.select(
        "id", F.col("pii_type").alias("rule_id"), sarif_level(F.col("severity")).alias("level"),
        F.concat(F.lit("PII detected: "), F.col("pii_type"), F.lit(" ("), F.lower("severity"), F.lit(")")).alias("message"),
        F.col("location.file").alias("uri"), F.col("location.line").alias("start_line"), F.col("location.column").alias("start_column"),
    )


def sarif_lines(findings: DataFrame) -> DataFrame:
    """SARIF result objects as JSON text, one a row."""
    r = sarif_results(findings)
    region = F.struct(F.col("start_line").alias("startLine"), F.col("start_column").alias("startColumn"))
    place = F.struct(F.struct(F.struct(F.col("uri")).alias("artifactLocation"), region.alias("region")).alias("physicalLocation"))
    return r.select("id", F.to_json(F.struct(F.col("rule_id").alias("ruleId"), "level", F.struct(F.col("message").alias("text")).alias("message"), F.array(place).alias("locations"))).alias("result"))


#: Findings in one document of a saved scan.
SET_SIZE = 10_000


def save_scan(findings: DataFrame, path: str, metadata: dict | None = None) -> None:
    """A scan as JSON documents ``{"findings": [...], "metadata": {...}}`` of about ``SET_SIZE`` findings, one a file; a scan of no more is one document. ``sources.files.saved_scan`` reads it."""
    sets = -(-findings.count() // SET_SIZE)
    every = F.struct(*[F.col(f"`{c}`") for c in findings.columns])
    kinds = {"path": "string", "files_scanned": "bigint", "files_skipped": "bigint", "duration": "bigint", "frameworks": "array<string>", "tool_version": "string"}
    known = metadata or {}
    about = F.struct(*[(F.array(*[F.lit(x) for x in known.get(k) or []]) if t.startswith("array") else F.lit(known.get(k))).cast(t).alias(k) for k, t in kinds.items()])
    number = F.pmod(F.xxhash64(every), F.lit(max(1, sets)))
    if sets:
        grouped = findings.groupBy(number.alias("_set")).agg(F.collect_list(every).alias("findings"))
    else:
        grouped = findings.sparkSession.range(1).select(F.array().cast(f"array<{findings.select(every.alias('s')).schema['s'].dataType.simpleString()}>").alias("findings"))
    grouped.select("findings", about.alias("metadata")).write.mode("overwrite").option("maxRecordsPerFile", 1).option("ignoreNullFields", "false").json(path)


def append_scans(scans: DataFrame, path: str, findings: DataFrame | None = None, findings_path: str | None = None) -> None:
    """Append to the scans table, partitioned by team, and its findings to theirs: findings first, so a scan that shows has all of its own."""
    if findings is not None and findings_path:
        findings.write.mode("append").parquet(findings_path)
    scans.write.mode("append").partitionBy("team_id").parquet(path)


def stored_findings(findings: DataFrame, scan_id: Column, created_at: Column) -> DataFrame:
    """Findings as rows of the stored table: flat, with flow and mappings as JSON text."""
    return findings.select(
        "id", scan_id.alias("scan_id"), "pii_type", "severity", F.col("location.file").alias("file_path"), F.col("location.line").alias("line"), "code_snippet",
        F.to_json("data_flow").alias("data_flow"), F.to_json("framework_mappings").alias("framework_mappings"), created_at.alias("created_at"),
    )


def diff_rows(diffed: DataFrame) -> DataFrame:
    """What the diff table shows: change, severity, type, place and the changes as ``field: old -> new``; unchanged findings are left out."""
    said = F.array_join(F.transform("changes", lambda c: F.concat(c["field"], F.lit(": "), c["old_value"], F.lit(" -> "), c["new_value"])), ", ")
    place = F.concat(display_path(F.col("finding.location.file")), F.lit(":"), F.col("finding.location.line").cast("string"))
    return displayed(diffed).select("change", F.col("finding.id").alias("id"), F.col("finding.severity").alias("severity"), F.col("finding.pii_type").alias("pii_type"), place.alias("place"), said.alias("changes"))


def diff_lines(diffed: DataFrame) -> DataFrame:
    """Every entry of a diff as a JSON object, one a row."""
    return diffed.select("change", F.to_json(F.struct(F.col("change").alias("kind"), "finding", "changes")).alias("entry"))


def suggestion_lines(suggestions: DataFrame) -> DataFrame:
    """Suggestions as JSON objects, one a row, next to their diff text."""
    return suggestions.select("finding_id", F.to_json(F.struct(*suggestions.columns)).alias("suggestion"), F.col("unified_diff").alias("diff"))


def ranked(findings: DataFrame, n: int) -> list:
    """The ``n`` worst findings in display order."""
    return findings.orderBy(rank(F.col("severity"), SEVERITY_RANK).desc(), F.split("location.file", "/"), "location.line", "id").limit(n).collect()


def markdown(findings: DataFrame, framework: str) -> str:
    """A regulation report; the driver sees counts per article, ten findings and twenty flows."""
    relevant = findings.where(F.exists("framework_mappings", lambda m: m["framework"] == framework))
    s = severity_summary(relevant).first()
    out = [f"# {framework.upper()} report", "", f"Findings: {s.total if s else 0}", ""]
    out += [f"- {k}: {s[k] if s else 0}" for k in LEVELS] + ["", "| Article | Title | Findings | Worst | Status |", "|---|---|---|---|---|"]
    names = {v: k for k, v in SEVERITY_RANK.items()}
    out += [f"| {r.article} | {r.title} | {r.findings} | {names[r.max_rank]} | {r.status} |" for r in article_report(relevant, framework).orderBy("article").collect()]
    top = ranked(relevant, 11)
    out += ["", "## Findings", ""] + [f"- {r.id} {r.severity} {r.pii_type} {r.location.file}:{r.location.line} `{r.code_snippet}`" for r in top[:10]]
    if len(top) > 10:
        out.append(f"- ... and {s.total - 10} more")
    flows = ranked(relevant.where("data_flow is not null"), 20)
    out += ["", "## Flows", ""] + [f"- {r.data_flow.source.label} -> {r.data_flow.sink.label} ({r.data_flow.sink.kind}) {r.location.file}:{r.location.line}" for r in flows]
    return "\n".join(out) + "\n"


def html_report(findings: DataFrame, framework: str) -> str:
    """The report as HTML, escaped."""
    return f"<html><body><pre>{html.escape(markdown(findings, framework))}</pre></body></html>"


def diagnostics(findings: DataFrame) -> DataFrame:
    """Editor diagnostics: critical is an error, high a warning, medium information, low a hint; the first finding of a line carries the title of its quick fix."""
    r = rank(F.col("severity"), SEVERITY_RANK)
    level = F.when(r == 3, "ERROR").when(r == 2, "WARNING").when(r == 1, "INFORMATION").otherwise("HINT")
    first = findings.groupBy("location.file", "location.line").agg(F.min("id").alias("_first")).select(F.col("file").alias("_f"), F.col("line").alias("_l"), "_first")
    here = F.col("location.file").eqNullSafe(F.col("_f")) & F.col("location.line").eqNullSafe(F.col("_l"))
    title = F.when(F.col("id") == F.col("_first"), described(F.col("pii_type"), F.col("data_flow.sink.kind")))
    return findings.join(first, here, "left").select(
        F.col("location.file").alias("uri"), F.col("location.line").alias("line"), level.alias("level"), "pii_type", F.substring("code_snippet", 1, 80).alias("text"), title.alias("quick_fix")
    )


def alerts(scans: DataFrame) -> DataFrame:
    """Scans that call for a message: any critical or high finding; with their types, most frequent first."""
    entries = F.map_entries(F.from_json("pii_type_summary", "map<string,bigint>"))
    top = F.transform(F.array_sort(F.transform(entries, lambda e: F.struct((-e["value"]).alias("n"), e["key"].alias("k")))), lambda s: s["k"])
    return scans.where((F.coalesce("critical_count", F.lit(0)) > 0) | (F.coalesce("high_count", F.lit(0)) > 0)).select(
        "id", "team_id", "project_name", "critical_count", "high_count", F.array_join(top, ",").alias("top_types")
    )


def bucket(value: Column, bounds: list[int], labels: list[str]) -> Column:
    """Label of the first bound a value does not exceed."""
    out = F.when(value <= bounds[0], labels[0])
    for b, label in zip(bounds[1:], labels[1:-1], strict=True):
        out = out.when(value <= b, label)
    return F.when(value.isNotNull(), out.otherwise(labels[-1]))


def worst(findings: DataFrame, *by: str) -> DataFrame:
    """The worst severity by columns."""
    return findings.groupBy(*by).agg(level_of(F.max(rank(F.col("severity"), SEVERITY_RANK)), SEVERITY_RANK).alias("worst"))
