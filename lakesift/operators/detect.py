"""Detection: names and literals of parsed files against the rules, per file, first match first.

Everything runs in the JVM. Names are matched once per distinct name; one finding is kept per file, line and type by an aggregate that
combines before the shuffle (names before literals, then the order of the text). Ids are hashes of place and type, the same in every run.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lakesift.config import Config
from lakesift.functions.names import in_dictionary_sql, in_example_context, in_test_context, level_of, literal_type, match_names, rank
from lakesift.rules.dictionary import SEVERITY_RANK
from lakesift.sources.files import any_glob


def not_skipped(files: DataFrame, config: Config) -> DataFrame:
    """Without the files an exception tells to skip; placed before parsing."""
    globs = [g for e in config.exceptions if e.action == "skip" for g in e.paths]
    return files.where(~any_glob(F.col("path"), globs)) if globs else files


def _with_snippets(parsed: DataFrame, facts: Column, keys: list[str], value: str) -> DataFrame:
    """One row per fact with its line's text; the lines themselves stay behind."""
    each = F.transform(
        facts,
        lambda x: F.struct(
            x["ord"].alias("ord"), x[value].alias(value), x["line"].alias("line"), x["column"].alias("column"),
            F.coalesce(F.get(F.col("lines"), x["line"] - 1), F.lit("")).alias("code_snippet"),
        ),
    )
    return parsed.select(*keys, "path", F.explode(each).alias("_f")).select(*keys, "path", "_f.*")


def identifier_findings(parsed: DataFrame, keys: list[str], config: Config) -> DataFrame:
    """Names of the dictionary; low confidence does not count in tests, and nothing counts in examples. Other names never leave their file's array."""
    known = F.expr(f"filter(identifiers, x -> {in_dictionary_sql('x.name', config.custom_types)})")
    names = _with_snippets(parsed, known, keys, "name").where(~in_example_context(F.col("code_snippet")))
    found = match_names(names, "name", config.custom_types)
    return found.where(~((F.col("confidence") == "low") & in_test_context(F.col("path")))).withColumn("detector", F.lit(0)).drop("name")


def literal_findings(parsed: DataFrame, keys: list[str]) -> DataFrame:
    """Literals that hold personal data: the first type that fits, always medium."""
    some = F.filter("literals", lambda x: literal_type(x["value"]).isNotNull())
    texts = _with_snippets(parsed, some, keys, "value").withColumn("pii_type", literal_type(F.col("value"))).where("pii_type is not null")
    return texts.drop("value").withColumns(
        {"category": F.lit("contact_info"), "severity": F.lit("medium"), "confidence": F.lit("medium"), "detector": F.lit(1)}
    )


def apply_rules(found: DataFrame, config: Config) -> DataFrame:
    """Allow list, ignored types, and severity rules in their order."""
    out = found
    if config.allow:
        out = out.where(~reduce(lambda a, s: a | F.col("code_snippet").contains(s), config.allow, F.lit(False)))
    if config.ignore_types:
        out = out.where(~F.col("pii_type").isin(config.ignore_types))
    severity: Column = rank(F.col("severity"), SEVERITY_RANK)
    for e in config.exceptions:
        here = any_glob(F.col("path"), e.paths)
        if e.action == "reduce_severity" and e.max_severity in SEVERITY_RANK:
            severity = F.when(here, F.least(severity, F.lit(SEVERITY_RANK[e.max_severity]))).otherwise(severity)
        elif e.action == "suppress_low":
            out = out.where(~(here & (severity == 0)))
    return out.withColumn("severity", level_of(severity, SEVERITY_RANK))


def once_per_line(found: DataFrame, keys: list[str]) -> DataFrame:
    """The first finding of each file, line and type."""
    every = F.struct(*[F.col(c) for c in found.columns])
    return (
        found.groupBy(*keys, "path", "line", "pii_type").agg(F.min_by(every, F.struct("detector", "ord", "column")).alias("_r")).select("_r.*")
    )


def detect(parsed: DataFrame, keys: list[str], config: Config | None = None) -> DataFrame:
    """Findings of every file, before flows: keys, path, line, column, ord, detector, pii_type, category, severity, confidence, code_snippet, id."""
    config = config or Config()
    found = identifier_findings(parsed, keys, config).unionByName(literal_findings(parsed, keys))
    kept = once_per_line(apply_rules(found, config), keys)
    place = F.concat_ws("\x1f", *keys, "path", F.col("line").cast("string"), "pii_type", F.col("detector").cast("string"))
    return kept.withColumn("id", F.concat(F.lit("PII-"), F.substring(F.sha2(place, 256), 1, 16)))
