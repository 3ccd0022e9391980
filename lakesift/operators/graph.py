"""Module graph: which file imports which, exports that bear findings, and where importers let them out.

Edges, exports and resolved names are tables; every step is an equi-join. Reachability is a frontier loop: each round joins the new
nodes only, writes only these to the shared folder and stops when nothing new is met, so cycles end.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lakesift.operators.flow import location, sink_calls
from lakesift.runtime import fresh_path, materialise

SUFFIXES = ("", ".ts", ".tsx", ".js", ".jsx", ".mts", ".py", "/index.ts", "/index.js", "/__init__.py")


def _folder(path: Column) -> Column:
    return F.regexp_replace(path, r"/?[^/]*$", "")


def _normal(path: Column) -> Column:
    """Without ``.`` and ``..`` parts: a fold over the parts."""
    parts = F.filter(F.split(path, "/"), lambda p: (p != "") & (p != "."))
    stack = F.aggregate(
        parts, F.array().cast("array<string>"),
        lambda acc, p: F.when(p == "..", F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(0)))).otherwise(F.concat(acc, F.array(p))),
    )
    return F.array_join(stack, "/")


def candidates(importer: Column, source: Column) -> Column:
    """Paths a relative import may mean, in the order in which they are tried."""
    base = _normal(F.concat_ws("/", _folder(importer), source))
    stem = F.regexp_replace(base, r"\.[^./]*$", "")  # a suffix takes the place of what follows the last dot
    tries = [F.concat(base if s == "" or s.startswith("/") else stem, F.lit(s)) for s in SUFFIXES]
    module = F.translate(F.regexp_replace(source, r"^\.+", ""), ".", "/")
    dotted = _normal(F.concat_ws("/", _folder(importer), module))
    return F.array(*tries, F.concat(dotted, F.lit(".py")), F.concat(dotted, F.lit("/__init__.py")))


def resolved_imports(parsed: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, importer, imported, ord, specifiers): relative imports whose first existing candidate is a scanned file."""
    imports = parsed.select(*keys, F.col("path").alias("importer"), F.explode("imports").alias("i")).where(F.col("i.source").startswith("."))
    tried = imports.select(
        *keys, "importer", F.col("i.ord").alias("ord"), F.col("i.specifiers").alias("specifiers"),
        F.posexplode(candidates(F.col("importer"), F.col("i.source"))).alias("pos", "imported"),
    )
    there = parsed.select(*keys, F.col("path").alias("imported")).distinct()
    return (
        tried.join(there, [*keys, "imported"])
        .groupBy(*keys, "importer", "ord")
        .agg(F.min_by(F.struct("imported", "specifiers"), "pos").alias("r"))
        .select(*keys, "importer", "ord", "r.imported", "r.specifiers")
    )


def edges(resolved: DataFrame, keys: list[str]) -> DataFrame:
    """One edge per resolved import statement."""
    return resolved.select(*keys, "importer", "imported")


def export_index(parsed: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, path, name, kind, line) of every export."""
    return parsed.select(*keys, "path", F.explode("exports").alias("e")).select(*keys, "path", "e.name", "e.kind", "e.line")


def resolved_names(resolved: DataFrame, exports: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, importer, imported, local, exported): names an importer gets; a whole module counts as ``*``."""
    each = resolved.select(*keys, "importer", "imported", F.explode("specifiers").alias("s")).select(*keys, "importer", "imported", "s.kind", "s.local", F.col("s.imported").alias("name"))
    known = exports.select(*keys, F.col("path").alias("imported"), "name").distinct()
    named = each.where("kind = 'named'").join(known, [*keys, "imported", "name"], "left_semi").withColumn("exported", F.col("name"))
    default = each.where("kind = 'default'")
    by_default = default.join(known.where("name = 'default'").drop("name"), [*keys, "imported"], "left_semi")
    by_name = default.join(known.withColumnRenamed("name", "local"), [*keys, "imported", "local"], "left_semi")
    defaults = by_default.unionByName(by_name).distinct().withColumn("exported", F.lit("default"))
    whole = each.where("kind = 'namespace'").withColumn("exported", F.lit("*"))
    columns = [*keys, "importer", "imported", "local", "exported"]
    return named.select(columns).unionByName(defaults.select(columns)).unionByName(whole.select(columns))


def bearing_exports(findings: DataFrame, exports: DataFrame, keys: list[str]) -> DataFrame:
    """Findings joined with the exports they sit on or whose name their line holds."""
    e = exports.select(*keys, "path", F.col("name").alias("exported"), F.col("line").alias("export_line"))
    return findings.join(e, [*keys, "path"]).where((F.col("export_line") == F.col("line")) | F.col("code_snippet").contains(F.col("exported")))


def propagate(findings: DataFrame, parsed: DataFrame, keys: list[str]) -> DataFrame | None:
    """Cross-file findings: an export that bears a finding, imported by name elsewhere and let out there by a built-in sink. None if no import resolves."""
    resolved = materialise(resolved_imports(parsed, keys), "resolved")
    if resolved.isEmpty():
        return None
    exports = export_index(parsed, keys)
    names = resolved_names(resolved, exports, keys).withColumnRenamed("imported", "path")
    borne = bearing_exports(findings, exports, keys).join(names, [*keys, "path", "exported"])
    sinks = parsed.select(*keys, F.col("path").alias("importer"), sink_calls(F.col("calls")).alias("_sinks")).where(F.size("_sinks") > 0)
    sym = F.col("local")

    def uses(s: Column) -> Column:
        return F.exists(s["call"]["argument_identifiers"], lambda a: a.contains(sym)) | s["call"]["callee"].contains(sym)

    used = borne.join(sinks, [*keys, "importer"]).withColumn("_s", F.get(F.filter("_sinks", uses), F.lit(0)))
    hit = used.where("_s is not null").select("*", F.col("_s.call").alias("_c"), F.col("_s.kind").alias("_kind")).drop("_sinks", "_s")
    name = F.element_at(F.split("importer", "/"), -1)
    origin = location(F.col("path"), F.col("line"), F.col("column"))
    there = location(F.col("importer"), F.col("_c.line"), F.col("_c.column"))
    first_line = location(F.col("importer"), F.lit(1), F.lit(1))
    flow = F.struct(
        F.struct(F.lit("user_input").alias("kind"), F.concat(sym, F.lit(" (from "), F.col("path"), F.lit(")")).alias("label"), origin.alias("location")).alias("source"),
        F.struct(F.col("_kind").alias("kind"), F.col("_c.callee").alias("label"), there.alias("location")).alias("sink"),
        F.array(origin, first_line, there).alias("path"),
    )
    return hit.select(
        *keys, F.concat("id", F.lit("->"), name).alias("id"), F.col("importer").alias("path"), F.col("_c.line").alias("line"), F.lit(1).alias("column"), "ord",
        F.lit(2).alias("detector"), "pii_type", "category", "severity", "confidence", F.col("code_snippet"), flow.alias("data_flow"),
    )


def reach(edge_table: DataFrame, start: DataFrame, source: str, target: str, keys: list[str], max_rounds: int = 100_000) -> DataFrame:
    """(keys, start, node): every node that edges lead to from each start; a start is met itself only through a cycle.

    A round writes the nodes it meets for the first time and reads those of the rounds before. More than ``max_rounds`` rounds (a path that long) are an error, never an incomplete result.
    """
    spark = edge_table.sparkSession
    step = materialise(edge_table.select(*keys, F.col(source).alias("_from"), F.col(target).alias("_to")).distinct(), "edges")
    frontier = start.select(*keys, F.col("start"), F.col("start").alias("node")).distinct()
    schema, rounds = frontier.schema, fresh_path(spark, "reached")
    for n in range(max_rounds):
        met = frontier.join(step, (F.col("node") == F.col("_from")) & _same(frontier, step, keys)).select(
            *[frontier[k] for k in keys], frontier["start"], F.col("_to").alias("node")
        ).distinct()
        if n:
            seen = spark.read.schema(schema).parquet(*[f"{rounds}/{i}" for i in range(n)])
            met = _unseen(met, seen, keys)
        met.write.parquet(f"{rounds}/{n}")
        frontier = spark.read.schema(schema).parquet(f"{rounds}/{n}")
        if frontier.isEmpty():
            return spark.read.schema(schema).parquet(*[f"{rounds}/{i}" for i in range(n + 1)])
    raise RuntimeError(f"nodes are still met after {max_rounds} rounds")


def _unseen(met: DataFrame, seen: DataFrame, keys: list[str]) -> DataFrame:
    """The rows of ``met`` that are not in ``seen``; null keys are equal."""
    condition = F.lit(True)
    for c in [*keys, "start", "node"]:
        condition = condition & met[c].eqNullSafe(seen[c])
    return met.join(seen, condition, "left_anti")


def _same(a: DataFrame, b: DataFrame, keys: list[str]) -> Column:
    out = F.lit(True)
    for k in keys:
        out = out & a[k].eqNullSafe(b[k])
    return out


def dependents(edge_table: DataFrame, start: DataFrame, keys: list[str]) -> DataFrame:
    """Files that import a start, directly or through others."""
    return reach(edge_table, start, "imported", "importer", keys)


def dependencies(edge_table: DataFrame, start: DataFrame, keys: list[str]) -> DataFrame:
    """Files a start imports, directly or through others."""
    return reach(edge_table, start, "importer", "imported", keys)
