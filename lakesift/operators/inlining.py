"""Nested records into related flat tables, by shared inlining.

The schema graph has a node for each structure and an edge for each field that holds one. A structure that is held once, by one
field, is inlined into its holder's table (columns named ``field_inner``). A structure gets a table of its own if it is repeated
(inside an array), shared (the same structure held by several fields) or, in schemas that name their structures, recursive.
Arrays of plain values get a table as well. Every row of a table has

    root_id      the record's key
    node         the row's own place in the record, unique in it (for example ``data_flow.path[2]``)
    parent       the ``node`` of the row that holds it ('' for the record itself): the foreign key
    parent_table the table of that row
    role         the field chain from the holder to it
    pos          the place in the array from 0; 0 where the holder is no array

One pass makes all tables: the record is turned into an array of tagged rows by higher-order functions inside the JVM and
generated once, without a join and without a shuffle; a table is a filter and projection of that.

Defined cases: null structures and null array elements give no row, and elements after a null keep their place. Empty arrays give
none. A null key gives rows with a null ``root_id``. Repeated records give repeated rows (``one_per_key`` removes them first). Columns
outside the shredded fields are left out, so names that clash cannot meet.
"""

from __future__ import annotations

from collections import Counter, defaultdict
from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def signature(t: T.DataType) -> str:
    """Equal for structures with equal fields."""
    return t.simpleString()


@dataclass
class SchemaGraph:
    """Which structures get tables, by signature; ``tables`` names them, ``columns`` lists each table's flat columns."""

    own: dict[str, str]
    columns: dict[str, dict[str, T.DataType]] = field(default_factory=dict)


def analyse(schema: T.StructType, fields: Sequence[str], names: dict[str, str] | None = None) -> SchemaGraph:
    """The graph of ``fields``; ``names`` gives table names by the first field (chain) that holds the structure."""
    held: Counter[str] = Counter()
    first: dict[str, str] = {}
    repeated: set[str] = set()
    structs: dict[str, T.DataType] = {}
    seen_edges: set[tuple[str, str]] = set()

    def visit(t: T.DataType, owner: str, name: str, in_array: bool) -> None:
        if isinstance(t, T.ArrayType):
            if not isinstance(t.elementType, (T.StructType, T.ArrayType)):
                key = f"array<{owner}.{name}>"
                repeated.add(key)
                first.setdefault(key, name)
                structs[key] = t.elementType
            visit(t.elementType, owner, name, True)
        elif isinstance(t, T.StructType):
            sig = signature(t)
            if (owner, name) not in seen_edges:
                seen_edges.add((owner, name))
                held[sig] += 1
            first.setdefault(sig, name)
            if in_array:
                repeated.add(sig)
            if sig not in structs:
                structs[sig] = t
                for f in t.fields:
                    visit(f.dataType, sig, f.name, False)

    for f in fields:
        visit(schema[f].dataType, "root", f, False)
    own: dict[str, str] = {}
    used: Counter[str] = Counter()
    for sig in structs:
        if sig in repeated or held[sig] > 1:
            name = (names or {}).get(first[sig], first[sig])
            used[name] += 1
            own[sig] = name if used[name] == 1 else f"{name}_{used[name]}"
    graph = SchemaGraph(own)
    for sig, name in own.items():
        graph.columns[name] = (
            dict(_flat(structs[sig], own, "")) if isinstance(structs[sig], T.StructType) else {"value": structs[sig]}
        )
    return graph


def _flat(t: T.StructType, own: dict[str, str], prefix: str):
    """(column, type) of a structure's table: plain fields, and those of inlined singletons."""
    for f in t.fields:
        if isinstance(f.dataType, T.StructType):
            if signature(f.dataType) not in own:
                yield from _flat(f.dataType, own, f"{prefix}{f.name}_")
        elif not isinstance(f.dataType, T.ArrayType):
            yield f"{prefix}{f.name}", f.dataType


def shred(df: DataFrame, key: str, fields: Sequence[str], graph: SchemaGraph) -> DataFrame:
    """All rows of all tables: the linking columns, ``table``, and one structure column per table (null in others' rows)."""
    structs = {n: T.StructType([T.StructField(c, t) for c, t in cols.items()]) for n, cols in graph.columns.items()}

    def row(table: str, flat: list[Column], node: Column, parent: Column, ptable: str, role: str, pos: Column) -> Column:
        bodies = [
            (F.struct(*flat) if n == table else F.lit(None)).cast(s).alias(n) for n, s in structs.items()
        ]
        return F.struct(
            F.lit(table).alias("table"), node.alias("node"), parent.alias("parent"), F.lit(ptable).alias("parent_table"),
            F.lit(role).alias("role"), pos.cast("bigint").alias("pos"), *bodies,
        )

    def flat_values(x: Column, t: T.StructType) -> list[Column]:
        out = []
        for f in t.fields:
            if isinstance(f.dataType, T.StructType):
                if signature(f.dataType) not in graph.own:
                    out += flat_values(x.getField(f.name), f.dataType)
            elif not isinstance(f.dataType, T.ArrayType):
                out.append(x.getField(f.name))
        return out

    def emit(x: Column, t: T.DataType, owner: str, name: str, node: Column, parent: Column, ptable: str, role: str, pos: Column) -> list[Column]:
        """Arrays of rows for the value ``x`` of type ``t``."""
        if isinstance(t, T.ArrayType):
            inner = t.elementType

            def each(e: Column, i: Column) -> Column:
                at = F.concat(node, F.lit("["), i.cast("string"), F.lit("]"))
                if isinstance(inner, (T.StructType, T.ArrayType)):
                    return F.concat(*emit(e, inner, owner, name, at, parent, ptable, role, i))
                one = row(graph.own[f"array<{owner}.{name}>"], [e], at, parent, ptable, role, i)
                return F.when(e.isNotNull(), F.array(one))

            return [F.coalesce(F.flatten(F.filter(F.transform(x, each), lambda r: r.isNotNull())), F.array())]
        if not isinstance(t, T.StructType):
            return []
        sig = signature(t)
        parts: list[Column] = []
        if sig in graph.own:
            table = graph.own[sig]
            one = row(table, flat_values(x, t), node, parent, ptable, role, pos)
            parts.append(F.when(x.isNotNull(), F.array(one)))
            owner, parent, ptable, prefix = sig, node, table, ""
        else:
            owner, prefix = sig, role + "."
        for f in t.fields:
            if isinstance(f.dataType, (T.StructType, T.ArrayType)):
                inner_node = F.concat(node, F.lit("." + f.name))
                parts += emit(x.getField(f.name), f.dataType, owner, f.name, inner_node, parent, ptable, prefix + f.name, F.lit(0))
        none = F.array().cast(T.ArrayType(_row_type(structs)))
        return [F.coalesce(p, none) for p in parts]

    arrays: list[Column] = []
    for f in fields:
        arrays += emit(F.col(f), df.schema[f].dataType, "root", f, F.lit(f), F.lit(""), "root", f, F.lit(0))
    none = F.array().cast(T.ArrayType(_row_type(structs)))
    every = F.concat(*[F.coalesce(a, none) for a in arrays]) if arrays else none
    return df.select(F.col(key).alias("root_id"), F.explode(every).alias("_r")).select("root_id", "_r.*")


def _row_type(structs: dict[str, T.StructType]) -> T.StructType:
    links = [(n, T.StringType()) for n in ("table", "node", "parent", "parent_table", "role")] + [("pos", T.LongType())]
    return T.StructType([T.StructField(n, t) for n, t in links] + [T.StructField(n, s) for n, s in structs.items()])


def tables(df: DataFrame, key: str, fields: Sequence[str], names: dict[str, str] | None = None) -> dict[str, DataFrame]:
    """Every table by name, each with the linking columns and its flat columns."""
    graph = analyse(df.schema, fields, names)
    rows = shred(df, key, fields, graph)
    return {
        n: rows.where(F.col("table") == n).select("root_id", "node", "parent", "parent_table", "role", "pos", f"{n}.*")
        for n in graph.columns
    }


def one_per_key(df: DataFrame, key: str) -> DataFrame:
    """One record of each key: of unequal copies the one whose hash is smallest. A null key counts as one key."""
    every = F.struct(*[F.col(f"`{c}`") for c in df.columns])
    return df.groupBy(key).agg(F.min_by(every, F.xxhash64(every)).alias("_r")).select("_r.*")
