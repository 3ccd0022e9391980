"""Fix suggestions: a finding's line rewritten by where its data goes. Row-wise expressions in the JVM; nothing is written to sources."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lakesift.functions.binding import let
from lakesift.rules.sinks import MASKS
from lakesift.rules.suggestions import BY_SINK, ENCRYPT, OTHERWISE, REDACTED


def names_type(name: Column, pii_type: Column) -> Column:
    """Whether a name is, or holds, the type's name, with or without underscores."""
    low, t = F.lower(name), F.lower(pii_type)
    return low.contains(t) | low.contains(F.replace(t, F.lit("_"), F.lit("")))


def expression_of(line: Column, pii_type: Column) -> Column:
    """The first dotted path whose last part names the type, else the first word that does, else null."""
    paths = F.regexp_extract_all(line, F.lit(r"\b(\w+\.\w+(?:\.\w+)*)"), F.lit(1))
    words = F.regexp_extract_all(line, F.lit(r"\b(\w+)\b"), F.lit(1))
    path = F.get(F.filter(paths, lambda p: names_type(F.element_at(F.split(p, r"\."), -1), pii_type)), F.lit(0))
    return F.coalesce(path, F.get(F.filter(words, lambda w: names_type(w, pii_type)), F.lit(0)))


def mask_of(pii_type: Column) -> Column:
    """Name of the mask function of a type."""
    pairs = [x for k, v in MASKS.items() for x in (F.lit(k), F.lit(v))]
    return F.coalesce(F.try_element_at(F.create_map(*pairs), pii_type), F.lit("maskPii"))


def _patched(line: Column, pii_type: Column, kind: Column) -> Column:
    indent = F.regexp_extract(line, r"^(\s*)", 1)

    def note(texts: tuple[str, str, str, str]) -> Column:
        return F.concat(indent, F.lit(texts[2]), pii_type, F.lit(texts[3]))

    def patch(e: Column) -> Column:
        called = lambda f: F.replace(line, e, F.concat(f, F.lit("("), e, F.lit(")")))
        by_kind = {"log_output": called(mask_of(pii_type)), "third_party_api": called(mask_of(pii_type)), "response": F.replace(line, e, F.lit(REDACTED)), "database": called(F.lit(ENCRYPT))}
        each = [F.when(kind == k, F.when(e.isNotNull(), new).otherwise(note(BY_SINK[k]))) for k, new in by_kind.items()]
        return F.when(F.coalesce(kind.isin(list(by_kind)), F.lit(False)), F.coalesce(*each)).otherwise(note(OTHERWISE))

    return let(expression_of(line, pii_type), patch)


def described(pii_type: Column, kind: Column) -> Column:
    """What a suggestion for a type and sink says."""
    each = [F.when(kind == k, F.concat(F.lit(t[0]), pii_type, F.lit(t[1]))) for k, t in BY_SINK.items()]
    return F.coalesce(*each, F.concat(F.lit(OTHERWISE[0]), pii_type, F.lit(OTHERWISE[1])))


def unified_diff(file: Column, line: Column, old: Column, new: Column) -> Column:
    """A diff of one line."""
    at = line.cast("string")
    return F.concat(F.lit("--- a/"), file, F.lit("\n+++ b/"), file, F.lit("\n@@ -"), at, F.lit(",1 +"), at, F.lit(",1 @@\n-"), old, F.lit("\n+"), new, F.lit("\n"))


def suggest(findings: DataFrame, sources: DataFrame | None = None, ids: list[str] | None = None) -> DataFrame:
    """(finding_id, file, line, description, original_line, replacement_line, unified_diff).

    The line is that of ``sources`` (path, source) where it is there, else the snippet. Findings without a line of either kind give no row.
    """
    rows = findings.where(F.col("id").isin(ids)) if ids else findings
    base = rows.select(
        "id", F.col("location.file").alias("file"), F.col("location.line").alias("line"), "pii_type", "code_snippet", F.col("data_flow.sink.kind").alias("kind")
    )
    original = F.col("code_snippet")
    if sources is not None:
        # A file's wanted lines are cut out once, however many findings it has; findings then meet their line, not the text.
        wanted = base.groupBy("file").agg(F.array_sort(F.collect_set("line")).alias("_wanted"))
        lines = F.split("source", "\r?\n")
        cut = sources.select(F.col("path").alias("file"), "source").join(wanted, "file").select(
            "file", F.explode(F.transform("_wanted", lambda n: F.struct(n.alias("line"), F.get(lines, n - 1).alias("text")))).alias("_l")
        )
        base = base.join(cut.select("file", "_l.line", F.col("_l.text").alias("_text")), ["file", "line"], "left")
        original = F.coalesce("_text", original)
    lined = base.withColumn("original_line", original).where("original_line is not null and trim(original_line) <> ''")
    patched = lined.withColumn("replacement_line", _patched(F.col("original_line"), F.col("pii_type"), F.col("kind")))
    return patched.select(
        F.col("id").alias("finding_id"), "file", "line", described(F.col("pii_type"), F.col("kind")).alias("description"), "original_line", "replacement_line",
        unified_diff(F.col("file"), F.col("line"), F.col("original_line"), F.col("replacement_line")).alias("unified_diff"),
    )


def applied(sources: DataFrame, suggestions: DataFrame) -> DataFrame:
    """(path, source, patches): sources with the suggestions whose line still reads the same put in; to be written to a new place.

    Suggestions meet their file by one join; a file's suggestions are few (at most one per line is used).
    """
    one = suggestions.groupBy("file", "line").agg(F.min_by(F.struct("original_line", "replacement_line"), "finding_id").alias("s"))
    by_file = one.groupBy("file").agg(F.map_from_entries(F.collect_list(F.struct("line", "s"))).alias("patches"))
    lines = F.split("source", "\n")

    def put(text: Column, i: Column) -> Column:
        p = F.try_element_at(F.col("patches"), i + 1)
        return F.when(p.isNotNull() & (F.trim(text) == F.trim(p["original_line"])), p["replacement_line"]).otherwise(text)

    return sources.join(by_file.withColumnRenamed("file", "path"), "path").select(
        "path", F.array_join(F.transform(lines, put), "\n").alias("source"), F.size("patches").alias("patches")
    )
