"""Regulation mapping: rules are constants, so a finding's mappings are one array expression, without a join."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lakesift.rules.articles import ARTICLES
from lakesift.rules.frameworks import GROUPS, RULES


def _fires(trigger: str, pii_type: Column, sink: Column) -> Column:
    if trigger.startswith("sink:"):
        return sink == trigger[5:]
    if trigger == "flow":
        return sink.isNotNull()
    return pii_type.isin(GROUPS[trigger])


def mappings(pii_type: Column, sink: Column, frameworks: Sequence[str]) -> Column:
    """Mappings of a finding: frameworks in the given order, rules in theirs; an empty array for none."""
    each = [
        F.when(
            _fires(trigger, pii_type, sink),
            F.struct(*[F.lit(v).alias(n) for n, v in (("framework", f), ("article", a), ("title", t), ("risk_description", r), ("recommendation", c))]),
        )
        for wanted in frameworks
        for f, a, t, trigger, r, c in RULES
        if f == wanted
    ]
    kind = "array<struct<framework:string,article:string,title:string,risk_description:string,recommendation:string>>"
    return F.filter(F.array(*each), lambda x: x.isNotNull()) if each else F.array().cast(kind)


def with_mappings(findings: DataFrame, frameworks: Sequence[str]) -> DataFrame:
    """``findings`` with ``framework_mappings``."""
    return findings.withColumn("framework_mappings", mappings(F.col("pii_type"), F.col("data_flow.sink.kind"), frameworks))


def article_table(spark: SparkSession) -> DataFrame:
    """(framework, article, title, description) of every described article."""
    return spark.createDataFrame(ARTICLES, "framework string, article string, title string, description string")


def article_report(findings: DataFrame, framework: str) -> DataFrame:
    """Per article of a framework: findings, worst severity rank, title and status; each finding counts once per article."""
    from lakesift.functions.names import rank
    from lakesift.rules.dictionary import SEVERITY_RANK

    own = F.filter("framework_mappings", lambda m: m["framework"] == framework)
    rows = findings.select("id", rank(F.col("severity"), SEVERITY_RANK).alias("rank"), F.posexplode(own).alias("pos", "m"))
    per = rows.groupBy(F.col("m.article").alias("article")).agg(
        F.count_distinct("id").alias("findings"), F.max("rank").alias("max_rank"), F.min_by("m.title", F.struct("pos", "id")).alias("title")
    )
    return per.withColumn("status", F.when(F.col("max_rank") >= 2, "AT RISK").otherwise("REVIEW"))
