"""Data flow within a file: a finding and the first call that takes its value out.

Findings, of which there are few, meet the calls of their file that take data somewhere by one join on the file; these stay an array, searched in order.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lakesift.config import CustomSink
from lakesift.functions.binding import let
from lakesift.functions.names import sink_kind


def variable_of(snippet: Column) -> Column:
    """The member of the first ``a.b``, else the name that is assigned to, else null."""
    member = F.nullif(F.regexp_extract(snippet, r"(\w+)\.(\w+)", 2), F.lit(""))
    assigned = F.nullif(F.regexp_extract(snippet, r"(?:const|let|var|)\s*(\w+)\s*=", 1), F.lit(""))
    return F.coalesce(member, assigned)


def sink_calls(calls: Column, custom: Sequence[CustomSink] = ()) -> Column:
    """The calls that take data somewhere, in order, each with its kind: judged once a call, whatever the number of findings."""
    kind = lambda c: let(F.lower(c["callee"]), lambda low: sink_kind(c["callee"], custom, low))
    return F.filter(F.transform(calls, lambda c: F.struct(c.alias("call"), kind(c).alias("kind"))), lambda s: s["kind"].isNotNull())


def first_sink(sinks: Column, variable: Column, pii_type: Column) -> Column:
    """The first of ``sink_calls`` that uses the variable or a name like the type."""

    def uses(c: Column) -> Column:
        args = c["argument_identifiers"]
        return F.array_contains(args, variable) | F.array_contains(args, pii_type) | c["callee"].contains(variable)

    return F.get(F.filter(sinks, lambda s: F.coalesce(uses(s["call"]), F.lit(False))), F.lit(0))


def location(path: Column, line: Column, column: Column) -> Column:
    return F.struct(path.alias("file"), line.alias("line"), column.alias("column"))


def with_flow(findings: DataFrame, parsed: DataFrame, keys: list[str], custom: Sequence[CustomSink] = ()) -> DataFrame:
    """``findings`` with ``data_flow``; findings whose sink an allowed custom sink names are dropped."""
    sinks = parsed.select(*keys, "path", sink_calls(F.col("calls"), custom).alias("_sinks")).where(F.size("_sinks") > 0)
    joined = findings.join(sinks, [*keys, "path"], "left").withColumn("_v", variable_of(F.col("code_snippet")))
    hit = joined.withColumn("_s", F.when(F.col("_v").isNotNull(), first_sink(F.col("_sinks"), F.col("_v"), F.col("pii_type")))).drop("_sinks")
    here = location(F.col("path"), F.col("line"), F.col("column"))
    there = location(F.col("path"), F.col("_s.call.line"), F.col("_s.call.column"))
    flow = F.struct(
        F.struct(F.lit("user_input").alias("kind"), F.col("_v").alias("label"), here.alias("location")).alias("source"),
        F.struct(F.col("_s.kind").alias("kind"), F.col("_s.call.callee").alias("label"), there.alias("location")).alias("sink"),
        F.array(here, there).alias("path"),
    )
    out = hit.withColumn("data_flow", F.when(F.col("_s").isNotNull(), flow)).drop("_v", "_s")
    allowed = [s.pattern for s in custom if s.allowed]
    if allowed:
        label = F.col("data_flow.sink.label")
        out = out.where(~F.coalesce(reduce(lambda a, p: a | label.rlike(p), allowed, F.lit(False)), F.lit(False)))
    return out
