"""At-least-once messages: keep exactly one delivery of each identifier.

Identifiers are dictionary-encoded exactly: each gets a shard (a hash of it) and, within the shard, the next free number, so
two identifiers never share a code. What has been seen is a bitmap per shard and bucket of 32,768 codes, stored as compressed
Parquet. A batch keeps, for each identifier whose bit is not set, its first delivery; the new bits are then united with the
stored ones. Deliveries kept and dropped are written into the folder of the version that holds their bits, and both become current by
one rename (see ``versions``): a job lost at any point leaves no identifier seen but unwritten, and a batch run again under its
name is given what it was given first.

No group of equal identifiers is ever gathered: first deliveries are a minimum (combined before the shuffle), and the rows to
drop are told from the rows to keep by a join on the pair (identifier, delivery number), which spreads an identifier that holds
a third of all rows over every partition. New codes are numbered in groups of about ``GROUP_ROWS`` identifiers, whatever the batch's size.

Defined cases: white space at the ends of an identifier does not count, letter case does. A null identifier cannot be compared;
its delivery is always kept and never counted as seen. Deliveries of one identifier that share the smallest number (or have
none: null counts as greater than any number) keep the one whose row hashes lowest, exactly one; only deliveries with a greater
number count as dropped by ``dropped_deliveries``. Extra columns come along; an empty batch keeps and drops nothing.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lakesift.operators.versions import COMPACT_AFTER, Versions

BUCKET_BITS = 32768
GROUP_ROWS = 50_000


def trimmed(c: Column) -> Column:
    """Without white space at the ends."""
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


@dataclass
class SeenState(Versions):
    """Versions of ``dict`` (id, shard, code; a version adds rows, every ``COMPACT_AFTER`` all are written anew) and ``bits`` (shard, bucket, bitmap; whole)."""

    shards: int = 1024

    def stored(self, what: str) -> DataFrame:
        """The current dictionary or bits."""
        m = self.manifest()
        if what == "dict":
            return self.read(m.get("dicts", []), "dict", "id string, shard int, code bigint")
        return self.read([m["folder"]] if m else [], "bits", "shard int, bucket bigint, bits binary")

    def commit(self, folder: str, codes: DataFrame, batch: str) -> None:
        """Unite the bits of ``codes`` with the stored ones and publish them with what ``folder`` holds."""
        n, m = self.version(), self.manifest()
        fresh_bits = codes.groupBy("shard", "bucket").agg(F.bitmap_construct_agg("bit").alias("bits"))
        united = fresh_bits.unionByName(self.stored("bits")).groupBy("shard", "bucket").agg(F.bitmap_or_agg("bits").alias("bits"))
        self.write(united, folder, "bits")
        new, dicts = codes.where("not old").select("id", "shard", "code"), m.get("dicts", [])
        if len(dicts) >= COMPACT_AFTER:
            new, dicts = new.unionByName(self.stored("dict")), []
        self.write(new, folder, "dict")
        self.publish(n + 1, {"folder": folder, "batch": batch, "dicts": [*dicts, folder], "shards": self.shards})


def _encode(firsts: DataFrame, known: DataFrame, shards: int, groups: int) -> DataFrame:
    """(id, first, shard, code, old): known identifiers keep their code, new ones get the next numbers of their shard.

    The new ones of a shard are numbered in ``groups`` groups: a group begins where the counts of those before it end.
    """
    tops = known.groupBy("shard").agg((F.max("code") + 1).alias("base"))
    found = firsts.withColumns(
        {"shard": F.pmod(F.xxhash64("id"), F.lit(shards)).cast("int"), "part": F.pmod(F.xxhash64("id", F.lit(1)), F.lit(groups)).cast("int")}
    ).join(known.select("id", F.col("code").alias("known")), "id", "left")
    before = Window.partitionBy("shard").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    starts = (
        found.where("known is null").groupBy("shard", "part").agg(F.count("*").alias("n"))
        .withColumn("start", F.coalesce(F.sum("n").over(before), F.lit(0))).drop("n")
        .join(tops, "shard", "left").select("shard", "part", (F.col("start") + F.coalesce("base", F.lit(0))).alias("start"))
    )
    within = Window.partitionBy("shard", "part", F.col("known").isNull()).orderBy("id")
    fresh = F.row_number().over(within) - 1 + F.col("start")
    return found.join(starts, ["shard", "part"], "left").select(
        "id", "first", "shard", F.coalesce("known", fresh).cast("bigint").alias("code"), F.col("known").isNotNull().alias("old")
    )


def _bit_is_set() -> Column:
    """Whether ``bit`` is set in ``bits``; no bitmap means no."""
    byte = F.conv(F.hex(F.expr("substring(bits, cast(bit div 8 as int) + 1, 1)")), 16, 10).cast("bigint")
    return F.coalesce(F.expr("0") + F.pmod(F.floor(byte / F.pow(F.lit(2), F.pmod("bit", F.lit(8)))), F.lit(2)) == 1, F.lit(False))


def _codes(rows: DataFrame, id_col: str, order_col: str, state: SeenState, folder: str) -> DataFrame:
    """(id, first, shard, bucket, bit, code, old) of every identifier of a batch, written to the version's folder."""
    rank = F.struct(F.col(order_col).isNull().alias("z"), F.col(order_col).alias("n"))
    firsts = (
        rows.select(trimmed(F.col(id_col)).alias("id"), rank.alias("rank"))
        .where("id is not null")
        .groupBy("id")
        .agg(F.min("rank").alias("first"))
    )
    shards = state.manifest().get("shards", state.shards)
    groups = 1 + rows.count() // (shards * GROUP_ROWS)
    coded = _encode(firsts, state.stored("dict"), shards, groups)
    places = {"bucket": F.expr(f"code div {BUCKET_BITS}"), "bit": F.expr(f"code % {BUCKET_BITS}")}
    state.write(coded.withColumns(places), folder, "codes")
    return state.spark.read.parquet(f"{state.path}/{folder}/codes")


def dedup_deliveries(rows: DataFrame, id_col: str, order_col: str, state: SeenState, batch: str | None = None) -> tuple[DataFrame, DataFrame]:
    """(kept, dropped) of one batch; afterwards ``state`` holds the batch's identifiers too.

    ``kept`` has all columns of ``rows``: one delivery of every identifier not seen before, and every delivery without an
    identifier. ``dropped`` has the columns too: every delivery with a smaller-numbered or earlier-batch copy. Both are read from the committed version.
    A ``batch`` that was committed before is not loaded again: its own former result comes back.
    """

    def result(folder: str) -> tuple[DataFrame, DataFrame]:
        kept, dropped = (state.spark.read.schema(rows.schema).parquet(f"{state.path}/{folder}/{w}") for w in ("kept", "dropped"))
        return kept, dropped

    done = state.committed(batch)
    if done:
        return result(done)
    folder = state.new_folder()
    codes = _codes(rows, id_col, order_col, state, folder)
    unseen = codes.join(state.stored("bits"), ["shard", "bucket"], "left").where(~_bit_is_set())
    chosen = unseen.select(F.col("id").alias("c_id"), F.col("first.n").alias("c_n"))
    every = F.struct(*[F.col(f"`{c}`") for c in rows.columns])  # the row travels whole: its names cannot meet those of the join
    keyed = rows.select(trimmed(F.col(id_col)).alias("m_id"), F.col(order_col).alias("m_n"), every.alias("r"))
    named = keyed.where("m_id is not null")
    same = F.col("m_id").eqNullSafe(F.col("c_id")) & F.col("m_n").eqNullSafe(F.col("c_n"))
    dropped = named.join(chosen, same, "left_anti").select("r.*")
    kept = (
        named.join(chosen, same, "left_semi")
        .groupBy("m_id")
        .agg(F.min_by("r", F.sha2(F.to_json("r"), 256)).alias("r"))
        .select("r.*")
        .unionByName(keyed.where("m_id is null").select("r.*"))
    )
    state.write(kept, folder, "kept")
    state.write(dropped, folder, "dropped")
    state.commit(folder, codes, batch if batch is not None else uuid.uuid4().hex)
    state.drop(folder, "codes")
    return result(folder)


def dropped_deliveries(rows: DataFrame, id_col: str, order_col: str, state: SeenState, batch: str | None = None) -> DataFrame:
    """(``id_col`` without white space at the ends, ``order_col``) of every delivery to be dropped; reads these columns only."""
    slim = rows.select(id_col, order_col)
    _, dropped = dedup_deliveries(slim, id_col, order_col, state, batch)
    return dropped.select(trimmed(F.col(id_col)).alias(id_col), order_col)


def dropped_in_batches(rows: DataFrame, id_col: str, order_col: str, state: SeenState, batches: int = 2) -> DataFrame:
    """``dropped_deliveries`` of a whole table, loaded batch by batch in the order of a numeric ``order_col``; rows without a number come last."""
    n = F.col(order_col)
    low, high = rows.agg(F.min(n), F.max(n)).first()  # one row
    cuts = [low + (high - low + 1) * i // batches for i in range(1, batches)] if low is not None else []
    out = None
    for i, (a, b) in enumerate(zip([None, *cuts], [*cuts, None], strict=True)):
        fits = (F.lit(True) if a is None else n >= a) & (F.lit(True) if b is None else n < b)
        part = rows.where(F.coalesce(fits, F.lit(b is None)))
        dropped = dropped_deliveries(part, id_col, order_col, state, f"batch {i}")
        out = dropped if out is None else out.unionByName(dropped)
    return out
