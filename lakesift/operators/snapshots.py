"""What changed between consecutive full snapshots of a table.

The primary key and the compared values of a row are each brought into one spelling. All snapshots of a key meet in one sorted run, where
each row sees the key's rows before and after it. Most rows are settled there: nothing lies between a snapshot and the next whole number, so
a row whose neighbours carry the next lower and the next higher number, with equal values, gives nothing. Only the others (additions, removals, changes and rows at
gaps of the numbering) are joined with the list of snapshots, which tells which snapshot precedes which. Nothing is compared
pairwise and rows are shuffled by a hash of the key, so one project that owns a third of all rows still spreads over all partitions.

Defined cases: rows that repeat count once. Nulls in a key or value column are values of their own, equal to each other and
to nothing else. Of rows with one key in one snapshot but unequal values, the one loaded last holds (ties: the greatest
values). A group or snapshot number that is null belongs to no snapshot and gives nothing. A group's first snapshot gives
nothing. Extra columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lakesift.runtime import materialise

#: Rows (group, number and its neighbours) up to which the list of snapshots is broadcast; about 20 MB.
LISTED = 200_000
#: Rows of a snapshot beyond which it is read in parts.
PART = 200_000


def one_blank(c: Column) -> Column:
    """White space runs as one blank, none at the ends."""
    return F.regexp_replace(F.regexp_replace(c, r"(?U)\s+", " "), "^ | $", "")


def row_hash(cols: Sequence[Column]) -> Column:
    """SHA-256 over the values in order, nulls told apart from every text."""
    parts = []
    for c in cols:
        s = c.cast("string")
        parts.append(F.coalesce(F.concat(F.length(s).cast("string"), F.lit(":"), s), F.lit("~")))
    return F.unhex(F.sha2(F.concat(*parts), 256))


def snapshot_changes(
    rows: DataFrame,
    group: str,
    number: str,
    key: Mapping[str, Column],
    values: Mapping[str, Column],
    loaded_at: str | None = None,
    listed: int = LISTED,
    part: int = PART,
) -> DataFrame:
    """Added, removed and changed keys of each snapshot against the group's next lower number present.

    ``key`` and ``values`` map output names to the canonical form of a column. Returns ``group``, ``number`` (bigint, the
    later snapshot), ``change_kind`` and the key columns, with ``old_<value>`` and ``new_<value>`` for each value.

    One shuffle, by the key hash, carries all rows; those of snapshots with more than ``part`` rows have their repeats combined by a shuffle before it. Which
    snapshot precedes which is one row per group and number: it is broadcast if it has at most ``listed`` rows (counted), else sorted and joined, with a
    salt from the key hash for each ``part`` rows of a snapshot, so no shuffle ever puts the rows of one group or large snapshot together. What else is broadcast is
    the list of the snapshots read in parts, at most ``LISTED``: parts are larger where there would be more.
    """
    number_ = F.col(number).cast("bigint")
    numbered = rows.where(F.col(group).isNotNull() & F.col(number).isNotNull())
    base = numbered.select(
        F.xxhash64(group, *key.values()).alias("_k"),
        F.col(group).alias("_g"),
        F.struct(*[c.alias(n) for n, c in key.items()]).alias("_key"),
        number_.alias("_n"),
        F.struct((F.col(loaded_at) if loaded_at else F.lit(0)).alias("_at"), F.struct(*[c.alias(n) for n, c in values.items()]).alias("_val")).alias("_last"),
    )
    same, last = ("_k", "_g", "_key", "_n"), F.max("_last").alias("_last")
    w = Window.partitionBy("_g").orderBy("_n")
    sizes = numbered.groupBy(F.col(group).alias("_g"), number_.alias("_n")).agg(F.count("*").alias("_rows"))
    order = materialise(sizes.withColumns({"_before": F.lag("_n").over(w), "_after": F.lead("_n").over(w)}), "snapshot-order")
    snapshots, total, largest = order.agg(F.count("*"), F.coalesce(F.sum("_rows"), F.lit(0)), F.coalesce(F.max("_rows"), F.lit(0))).first()
    part = max(part, total // LISTED + 1)
    order = order.withColumn("_parts", F.ceil(F.col("_rows") / part)).drop("_rows")
    large = F.broadcast(order.where("_parts > 1").select("_g", "_n", "_parts"))  # fewer than LISTED rows
    if largest > part:
        combined = base.join(large, ["_g", "_n"], "left_semi").groupBy(*same).agg(last)
        base = base.join(large, ["_g", "_n"], "left_anti").unionByName(combined)
    once = base.repartition("_k").groupBy(*same).agg(last).select(*same, "_last._val")
    run = Window.partitionBy("_k", "_g", "_key").orderBy("_n")
    near = once.withColumns({"_was": F.lag("_n").over(run), "_old": F.lag("_val").over(run), "_next": F.lead("_n").over(run)})
    changed = ~F.col("_old").eqNullSafe(F.col("_val"))
    follows = F.col("_was").eqNullSafe(F.try_subtract("_n", F.lit(1))) & F.col("_next").eqNullSafe(F.try_add("_n", F.lit(1)))
    open_ = near.where(~follows | changed)
    if snapshots <= listed:
        placed = open_.join(F.broadcast(order), ["_g", "_n"])
    else:
        salted = order.withColumn("_salt", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("_parts") - 1))).drop("_parts")
        salt = F.coalesce(F.pmod("_k", "_parts"), F.lit(0).cast("bigint"))
        # Hinted, since Spark would judge by the size of its files that a list of millions of rows may be broadcast.
        placed = open_.join(large, ["_g", "_n"], "left").withColumn("_salt", salt).join(salted.hint("merge"), ["_g", "_n", "_salt"])
    met = F.col("_was").eqNullSafe(F.col("_before"))
    here = F.when(~met, "added").when(changed, "changed")
    kind = F.when(F.col("_before").isNotNull(), here)
    gone = F.col("_after").isNotNull() & ~F.col("_next").eqNullSafe(F.col("_after"))
    later = F.struct(F.col("_n").alias("n"), kind.alias("kind"), F.when(met, F.col("_old")).alias("old"), F.col("_val").alias("new"))
    nothing = F.when(F.lit(False), F.col("_val"))
    removed = F.struct(F.col("_after").alias("n"), F.lit("removed").alias("kind"), F.col("_val").alias("old"), nothing.alias("new"))
    each = F.explode(F.array_compact(F.array(F.when(kind.isNotNull(), later), F.when(gone, removed))))
    return placed.select("_g", "_key", each.alias("_c")).select(
        F.col("_g").alias(group),
        F.col("_c.n").alias(number),
        F.col("_c.kind").alias("change_kind"),
        *[F.col("_key").getField(n).alias(n) for n in key],
        *[F.col("_c.old").getField(n).alias(f"old_{n}") for n in values],
        *[F.col("_c.new").getField(n).alias(f"new_{n}") for n in values],
    )


def fingerprint_key() -> dict[str, Column]:
    """The compared form of a finding's fingerprint: ``/`` in paths, single blanks, a missing sink as ''."""
    return {
        "file": one_blank(F.translate("file", "\\", "/")),
        "pii_type": one_blank(F.col("pii_type")),
        "code_snippet_norm": one_blank(F.col("code_snippet_norm")),
        "sink_kind": F.coalesce(one_blank(F.col("sink_kind")), F.lit("")),
    }


def finding_changes(snapshots: DataFrame) -> DataFrame:
    """Changes of finding fingerprints per project; severity (case ignored) and line are the compared values."""
    return snapshot_changes(
        snapshots,
        "project_name",
        "snapshot_no",
        fingerprint_key(),
        {"severity": F.lower(one_blank(F.col("severity"))), "line": F.col("line")},
        "loaded_at",
    )
