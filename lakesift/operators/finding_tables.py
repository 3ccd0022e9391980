"""Findings, saved or stored with JSON text, as flat tables of flow ends, flow steps and mappings."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lakesift.operators.inlining import analyse, one_per_key, shred
from lakesift.sources.nested_json import flow_of, mappings_of

FIELDS = ("data_flow", "framework_mappings")
NAMES = {"source": "flow_end", "path": "step", "location": "location", "framework_mappings": "mapping"}


def nested_findings(findings: DataFrame) -> DataFrame:
    """(id, data_flow, framework_mappings) as structures, one row per id; JSON text is read, structures pass as they are."""
    slim = one_per_key(findings.select("id", *FIELDS), "id")
    read = {"data_flow": flow_of, "framework_mappings": mappings_of}
    cols = {n: f(F.col(n)) for n, f in read.items() if dict(slim.dtypes)[n] == "string"}
    return slim.withColumns(cols) if cols else slim


def child_records(findings: DataFrame, source_table: str) -> DataFrame:
    """(source_table, finding_id, child, pos, item) of every flow end, flow step and mapping.

    The rows come from the shredded tables: flow ends are the shared flow-end structure, steps are the locations held by ``path``.
    """
    nested = nested_findings(findings)
    graph = analyse(nested.schema, FIELDS, NAMES)
    by_sig = {sig: name for sig, name in graph.own.items()}
    rows = shred(nested, "id", FIELDS, graph)
    flow = nested.schema["data_flow"].dataType
    end = by_sig[flow["source"].dataType.simpleString()]
    step = by_sig[flow["path"].dataType.elementType.simpleString()]
    mapping = by_sig[nested.schema["framework_mappings"].dataType.elementType.simpleString()]
    role = F.col("role")
    child = (
        F.when((F.col("table") == end) & role.endswith("source"), "flow_source")
        .when((F.col("table") == end) & role.endswith("sink"), "flow_sink")
        .when((F.col("table") == step) & role.endswith("path"), "flow_path")
        .when(F.col("table") == mapping, "mapping")
    )
    item = F.coalesce(F.col(f"`{end}`.kind"), F.col(f"`{step}`.file"), F.col(f"`{mapping}`.article"))
    return rows.select(
        F.lit(source_table).alias("source_table"), F.col("root_id").alias("finding_id"), child.alias("child"), "pos", item.alias("item")
    ).where("child is not null")
