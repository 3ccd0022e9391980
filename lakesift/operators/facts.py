"""Fact extraction: files to names, literals, calls, imports, exports and parse warnings.

One map over the files in Arrow batches (Python has the only parsers here), without a shuffle; every later operator runs in the JVM on the
fact columns. Filters on path, language and size belong before it.

Defined cases: a null source has no facts. A file that does not parse still gives the facts its tokens show, and at most five warnings.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lakesift.functions.lexing import facts_of
from lakesift.runtime import spread

FACTS = {
    "identifiers": "ord int, name string, line int, column int, context string",
    "literals": "ord int, value string, line int, column int",
    "calls": "ord int, callee string, line int, column int, argument_identifiers array<string>",
    "imports": "ord int, source string, line int, specifiers array<struct<kind:string,local:string,imported:string>>",
    "exports": "ord int, name string, kind string, reexport_source string, line int",
    "warnings": "line int, message string, hint string",
}


def _arrow(ddl: str) -> pa.DataType:
    kinds = {"int": pa.int32(), "string": pa.string(), "array<string>": pa.list_(pa.string())}
    spec = pa.list_(pa.struct([("kind", pa.string()), ("local", pa.string()), ("imported", pa.string())]))
    fields = [p.split(" ", 1) for p in ddl.split(", ")]
    return pa.list_(pa.struct([(n, kinds.get(t, spec)) for n, t in fields]))


def extract(files: DataFrame, keys: list[str]) -> DataFrame:
    """``keys``, path, language and the lines (without blanks at the ends) of every file, with one array column per kind of fact."""
    columns = [*keys, "path", "language"]
    slim = spread(files.select(*columns, "source"), *keys, "path")
    n = len(columns)
    types = {k: _arrow(d) for k, d in FACTS.items()}

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found: dict[str, list] = {k: [] for k in FACTS}
            lines = []
            for source, language in zip(batch.column(n).to_pylist(), batch.column(n - 1).to_pylist(), strict=True):
                facts = facts_of(source, language) if source is not None else None
                lines.append([x.strip() for x in source.replace("\r\n", "\n").split("\n")] if source is not None else [])
                for k in FACTS:
                    found[k].append(getattr(facts, k) if facts else [])
            arrays = [batch.column(i) for i in range(n)] + [pa.array(lines, pa.list_(pa.string()))] + [pa.array(found[k], types[k]) for k in FACTS]
            yield pa.RecordBatch.from_arrays(arrays, [*columns, "lines", *FACTS])

    schema = ", ".join(
        [f"{c} {dict(slim.dtypes)[c]}" for c in columns]
        + ["lines array<string>"]
        + [f"{k} array<struct<{d.replace(', ', ',').replace(' ', ':')}>>" for k, d in FACTS.items()]
    )
    return slim.mapInArrow(read, schema)


def facts_table(parsed: DataFrame, kind: str, keys: list[str]) -> DataFrame:
    """One row per fact of a kind, with the file's keys and path."""
    return parsed.select(*keys, "path", F.explode(kind).alias("_f")).select(*keys, "path", "_f.*")


def line_of(source: Column, line: Column) -> Column:
    """A line of a source by its number from 1, without blanks at the ends; '' if there is none."""
    lines = F.split(source, "\r?\n")
    return F.coalesce(F.regexp_replace(F.get(lines, line - 1), r"(?U)^\s+|\s+$", ""), F.lit(""))
