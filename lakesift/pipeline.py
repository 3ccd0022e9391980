"""The scan: files to findings, in a fixed order of steps.

skip rules, fact extraction (written to the shared folder: every later step reads it), names and literals, allow and ignore lists, severity rules, flows,
allowed sinks, cross-file findings, regulation mappings.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lakesift.config import Config
from lakesift.functions.names import rank
from lakesift.operators.detect import detect, not_skipped
from lakesift.operators.facts import extract
from lakesift.operators.flow import with_flow
from lakesift.operators.frameworks import with_mappings
from lakesift.operators.graph import propagate
from lakesift.rules.dictionary import CONFIDENCE_RANK, SEVERITY_RANK
from lakesift.runtime import materialise

COLUMNS = ("id", "severity", "pii_type", "category", "location", "code_snippet", "data_flow", "framework_mappings", "confidence")


def scan_parsed(parsed: DataFrame, keys: list[str], config: Config, cross_file: bool = True) -> DataFrame:
    """Findings of files whose facts are extracted; ``keys`` and path name a file once, and imports resolve within equal ``keys``."""
    found = with_flow(detect(parsed, keys, config), parsed, keys, config.custom_sinks)
    if cross_file:
        found = materialise(found, "findings")
        crossed = propagate(found, parsed, keys)
        if crossed is not None:
            found = found.unionByName(crossed.select(found.columns))
    return with_mappings(found, config.frameworks)


def scan(files: DataFrame, keys: list[str] | None = None, config: Config | None = None, cross_file: bool = True) -> DataFrame:
    """Findings of files (path, language, source and ``keys``), with the finding columns, ``keys`` and ``path``."""
    config, keys = config or Config(), keys or []
    parsed = materialise(extract(not_skipped(files, config), keys), "facts")
    found = scan_parsed(parsed, keys, config, cross_file)
    place = F.struct(F.col("path").alias("file"), "line", "column")
    return found.withColumn("location", place).select(*keys, "path", *COLUMNS)


def shown(findings: DataFrame, min_severity: str = "low") -> DataFrame:
    """Findings at or above a severity (an unknown one counts as low), without those of low confidence."""
    least = SEVERITY_RANK.get(min_severity.lower(), 0)
    return findings.where((rank(F.col("severity"), SEVERITY_RANK) >= least) & (rank(F.col("confidence"), CONFIDENCE_RANK) > 0))


def in_order(findings: DataFrame) -> DataFrame:
    """Worst first, then by path component, line and id."""
    return findings.orderBy(rank(F.col("severity"), SEVERITY_RANK).desc(), F.split("location.file", "/"), "location.line", "id")


def gate(findings: DataFrame, level: str = "high", *by: str) -> DataFrame:
    """Whether any finding is at or above a level (an unknown level counts as high), with the worst rank, whole or by columns."""
    r = rank(F.col("severity"), SEVERITY_RANK)
    return findings.groupBy(*by).agg(F.coalesce(F.bool_or(r >= SEVERITY_RANK.get(level.lower(), 2)), F.lit(False)).alias("fails"), F.max(r).alias("worst"))


def fails(findings: DataFrame, level: str = "high") -> bool:
    """Whether the scan as a whole fails."""
    return gate(findings, level).first().fails
