"""Queries of the operators on source code."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lakesift.llm.credentials import credentials, redact
from lakesift.llm.handwritten import judged, not_by_hand
from lakesift.llm.syntax import invalid_files, rates, verdicts
from lakesift.runtime import table


def p4_found(spark: SparkSession, sf: str) -> DataFrame:
    """Files that are not valid in their language."""
    return invalid_files(table(spark, sf, "parsed_files"))


def p4_rates(spark: SparkSession, sf: str) -> DataFrame:
    """Share of invalid files per repository and language."""
    return rates(table(spark, sf, "parsed_files"))


def p4_faults(spark: SparkSession, sf: str) -> DataFrame:
    """The first fault of every file that is not valid."""
    found = verdicts(table(spark, sf, "parsed_files")).where("not valid")
    return found.select("file_id", "repository", "language", "line", "column", "message")


def p5_found(spark: SparkSession, sf: str) -> DataFrame:
    """Credentials written out in snippets of both finding tables."""
    parts = []
    for name in ("findings", "scan_findings"):
        found = credentials(table(spark, sf, name), "id", "code_snippet")
        parts.append(found.select(F.lit(name).alias("source_table"), F.col("id").alias("finding_id"), "credential"))
    return parts[0].unionByName(parts[1])


def p5_redacted(spark: SparkSession, sf: str) -> DataFrame:
    """Every row of both finding tables with its masked snippet."""
    parts = []
    for name in ("findings", "scan_findings"):
        rows = redact(table(spark, sf, name).select("id", "code_snippet"), "code_snippet")
        parts.append(rows.select(F.lit(name).alias("source_table"), "id", F.col("code_snippet_masked").alias("snippet")))
    return parts[0].unionByName(parts[1])


def p7_found(spark: SparkSession, sf: str) -> DataFrame:
    """Files that were not written by hand."""
    return not_by_hand(table(spark, sf, "parsed_files"), table(spark, sf, "scan_configs"))


def p7_by_language(spark: SparkSession, sf: str) -> DataFrame:
    """Files by extension, and how many of them were written by hand."""
    files = table(spark, sf, "parsed_files")
    sides = judged(files, table(spark, sf, "scan_configs")).join(files.select("file_id", "path"), "file_id")
    extension = F.lower(F.regexp_extract("path", r"\.(\w+)$", 1)).alias("extension")
    return sides.groupBy(extension).agg(F.count("*").alias("files"), F.count_if("by_hand").alias("by_hand"))


QUERIES = {f.__name__: f for f in (p4_found, p4_rates, p4_faults, p5_found, p5_redacted, p7_found, p7_by_language)}
SQL: dict[str, str] = {}
