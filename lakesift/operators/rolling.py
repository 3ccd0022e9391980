"""Rolling totals over trailing periods, kept as versioned daily state.

State is one row per entity and day: the day's amounts and, for each period of p days, the trailing total. It obeys
``total(d) = total(d - 1) + arrivals(d) - amounts(d - p)``. A batch of arrivals (today's, late ones or corrections with
negative amounts) turns into one signed event at its day and one at its day plus p; the running sum of those events is what
the recurrence adds to the stored totals: stored raw rows are never read again, dates before the first affected day keep their
totals, and the result is the next version. The first load is the same step on an empty state. ``ScanTotals`` stores the versions,
of which each writes only what its arrivals can change, with the ids they counted, so a scan delivered again in a later batch adds nothing.

Amounts are summed per entity and day before the running sum (combined before the shuffle), so a task's group is one entity's
calendar: days, not rows, however busy the entity.

Defined cases: a null amount counts 0; rows with a null entity or time give nothing; days before an entity's first count 0;
every day from the first to the last day with a row is present. Extra columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lakesift.operators.versions import COMPACT_AFTER, Versions
from lakesift.runtime import file_system


def once(rows: DataFrame, id_col: str, first_by: Column) -> DataFrame:
    """One row of each id, the one with the smallest ``first_by``; rows without an id all stay."""
    every = F.struct(*[F.col(f"`{c}`") for c in rows.columns])
    have = rows.where(F.col(id_col).isNotNull()).groupBy(id_col).agg(F.min_by(every, first_by).alias("_r")).select("_r.*")
    return have.unionByName(rows.where(F.col(id_col).isNull()))


def daily_amounts(rows: DataFrame, entity: str, at: str, amounts: Sequence[str]) -> DataFrame:
    """(entity, day, amounts...) summed per entity and calendar day."""
    return (
        rows.where(F.col(entity).isNotNull() & F.col(at).isNotNull())
        .groupBy(F.col(entity).alias("entity"), F.to_date(at).alias("day"))
        .agg(*[F.coalesce(F.sum(a), F.lit(0)).cast("bigint").alias(a) for a in amounts])
    )


def _total(amount: str, period: int) -> str:
    return f"{amount}_{period}d"


def advance(state: DataFrame | None, arrivals: DataFrame, amounts: Sequence[str], periods: Sequence[int]) -> DataFrame:
    """The next version of the state: ``state`` with the daily amounts ``arrivals`` taken in.

    ``arrivals`` has (entity, day, amounts...), at most one row per entity and day. ``state`` is a former result or None.
    Both sides are keyed by entity; one shuffle by entity serves the running sum and the calendar.
    """
    events = arrivals.select("entity", "day", F.lit(True).alias("is_day"), F.lit(0).alias("period"), *amounts)
    for p in periods:
        ends = [(-F.col(a)).alias(a) for a in amounts]
        events = events.unionByName(
            arrivals.select("entity", F.date_add("day", p).alias("day"), F.lit(False).alias("is_day"), F.lit(p).alias("period"), *ends)
        )
    sums = {a: F.sum(F.when(F.col("period") == 0, F.col(a))).alias(a) for a in amounts}
    moves = [
        F.coalesce(F.sum(F.when(F.col("period").isin(0, p), F.col(a))), F.lit(0)).alias(f"_move_{_total(a, p)}")
        for a in amounts
        for p in periods
    ]
    per_day = events.groupBy("entity", "day").agg(F.max("is_day").alias("is_day"), *sums.values(), *moves)
    if state is not None:
        stored = state.select("entity", "day", *amounts, *[_total(a, p) for a in amounts for p in periods])
        held = stored.select(
            "entity",
            "day",
            F.lit(True).alias("_s_day"),
            *[F.col(a).alias(f"_s_{a}") for a in amounts],
            *[F.col(_total(a, p)).alias(f"_s_{_total(a, p)}") for a in amounts for p in periods],
        )
        per_day = per_day.join(held, ["entity", "day"], "full_outer")
    else:
        nothing = {f"_s_{a}": F.lit(None).cast("bigint") for a in amounts}
        nothing |= {f"_s_{_total(a, p)}": F.lit(None).cast("bigint") for a in amounts for p in periods}
        per_day = per_day.withColumns(nothing | {"_s_day": F.lit(None).cast("boolean")})
    by_day = Window.partitionBy("entity").orderBy("day")
    so_far = by_day.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    whole = Window.partitionBy("entity")
    real = F.coalesce("is_day", F.lit(False)) | F.coalesce("_s_day", F.lit(False))
    running = per_day.withColumns(
        {f"_run_{_total(a, p)}": F.sum(F.coalesce(f"_move_{_total(a, p)}", F.lit(0))).over(so_far) for a in amounts for p in periods}
        | {"_next": F.lead("day").over(by_day), "_last": F.max(F.when(real, F.col("day"))).over(whole)}
    )
    # Between two events nothing moves, and without stored rows there is nothing else to add: fill the days up to the next one.
    upto = F.least(F.coalesce(F.date_sub("_next", 1), F.col("_last")), F.col("_last"))
    filled = running.where(F.col("day") <= F.col("_last")).withColumn(
        "_d", F.explode(F.sequence("day", F.greatest(upto, F.col("day"))))
    )
    own = F.col("_d") == F.col("day")
    out = filled.select(
        "entity",
        F.col("_d").alias("day"),
        *[F.when(own, F.coalesce(a, F.lit(0)) + F.coalesce(f"_s_{a}", F.lit(0))).otherwise(0).cast("bigint").alias(a) for a in amounts],
        *[
            (F.col(f"_run_{_total(a, p)}") + F.when(own, F.coalesce(f"_s_{_total(a, p)}", F.lit(0))).otherwise(0))
            .cast("bigint")
            .alias(_total(a, p))
            for a in amounts
            for p in periods
        ],
        F.when(own, F.col("_s_day")).otherwise(False).alias("_had"),
    )
    if state is None:
        return out.drop("_had")
    return _carry(out, amounts, periods)


def _carry(out: DataFrame, amounts: Sequence[str], periods: Sequence[int]) -> DataFrame:
    """Days the former version did not hold (a new last day, a gap before an older first day) get its trailing totals from amounts.

    The former totals cover the former calendar only. Days added before it had no former amounts; days added after it still
    carry amounts of the last p days, taken from the stored amounts by a range frame over the entity's calendar.
    """
    day_no = F.unix_date("day")
    fixed = {}
    for p in periods:
        frame = Window.partitionBy("entity").orderBy(day_no).rangeBetween(-(p - 1), 0)
        for a in amounts:
            fixed[_total(a, p)] = F.when(F.coalesce("_had", F.lit(False)), F.col(_total(a, p))).otherwise(F.sum(a).over(frame))
    return out.withColumns(fixed).drop("_had")


def averages(state: DataFrame, amounts: Sequence[str], periods: Sequence[int]) -> DataFrame:
    """``state`` with the trailing daily averages (total divided by the days of the period, quiet days included)."""
    return state.withColumns(
        {f"{a}_avg_{p}d": F.round(F.col(_total(a, p)) / F.lit(p), 6) for a in amounts for p in periods}
    )


def first_received(scans: DataFrame) -> DataFrame:
    """The columns of scans that count, each scan id once, as first received."""
    slim = scans.select("id", "team_id", "created_at", "received_at", "findings_count", "critical_count")
    return once(slim, "id", F.struct(F.col("received_at").isNull(), F.col("received_at"), F.col("created_at")))


AMOUNTS, PERIODS = ["findings", "critical"], [7, 30]


def _daily_scans(single: DataFrame) -> DataFrame:
    return daily_amounts(single.withColumnsRenamed({"findings_count": "findings", "critical_count": "critical"}), "team_id", "created_at", AMOUNTS)


def scan_state(scans: DataFrame, state: DataFrame | None = None) -> DataFrame:
    """Rolling 7- and 30-day totals of findings and critical findings per team; each scan id counts once in a batch, as first received."""
    return advance(state, _daily_scans(first_received(scans)), AMOUNTS, PERIODS)


BLOCK_DAYS = 32
_TOTALS = "entity string, day date, findings bigint, critical bigint, findings_7d bigint, findings_30d bigint, critical_7d bigint, critical_30d bigint"


@dataclass
class ScanTotals(Versions):
    """Stored versions of ``scan_state``.

    ``totals`` are kept in blocks of ``BLOCK_DAYS`` days. A version writes anew only the blocks from the first day whose totals its arrivals can change
    and takes the earlier ones over from the version before, unread but for the last ``max(PERIODS) - 1`` days before that. ``spans`` (first and last day of each
    entity, whole) tells where an entity's calendar goes on after a quiet spell; ``ids`` (each version adds those it counted) keeps a scan
    delivered again from counting again.
    """

    def totals(self) -> DataFrame | None:
        """The current totals, None before the first version."""
        m = self.manifest()
        return self._blocks(m["blocks"]) if m else None

    def _blocks(self, blocks: dict[str, str]) -> DataFrame:
        paths = [f"{self.path}/{folder}/totals/block={b}" for b, folder in sorted(blocks.items())]
        return self.spark.read.schema(_TOTALS).parquet(*paths) if paths else self.read([], "totals", _TOTALS)

    def _spans(self, m: dict) -> DataFrame:
        return self.read([m["folder"]] if m else [], "spans", "entity string, first date, last date")

    def load(self, scans: DataFrame, batch: str | None = None) -> None:
        """Take a batch in: the next version is the stored totals with the scans whose id no version before has counted. A batch loaded before is not loaded again."""
        if self.committed(batch):
            return
        n, m, folder = self.version(), self.manifest(), self.new_folder()
        single = first_received(scans).withColumn("id", F.col("id").cast("string"))
        seen = m.get("ids", [])
        known = self.read(seen, "ids", "id string")
        if seen:
            single = single.join(known, "id", "left_anti")  # a null id equals none and stays
        self.write(single, folder, "arrivals")
        single = self.spark.read.schema(single.schema).parquet(f"{self.path}/{folder}/arrivals")
        daily = _daily_scans(single)
        spans = self._spans(m)
        reached = daily.groupBy("entity").agg(F.min("day").alias("low"), F.max("day").alias("high"))
        # An entity's totals change from its first new day on, and new days follow its last stored one.
        begins = F.least(F.col("low"), F.when(F.col("high") > F.col("last"), F.date_add("last", 1)))
        start = reached.join(spans, "entity", "left").agg(F.min(begins).alias("d")).first().d  # one row
        blocks = dict(m.get("blocks", {}))
        if start is not None:
            day_no = (start - dt.date(1970, 1, 1)).days
            first, look = day_no // BLOCK_DAYS, (day_no - max(PERIODS) + 1) // BLOCK_DAYS
            state = self._blocks({b: f for b, f in blocks.items() if int(b) >= look}) if m else None
            block = F.floor(F.unix_date("day") / F.lit(BLOCK_DAYS)).cast("int")
            after = advance(state, daily, AMOUNTS, PERIODS).withColumn("block", block).where(F.col("block") >= first)
            self.write(after.repartition("block", "entity"), folder, "totals", partition_by="block")
            blocks = {b: f for b, f in blocks.items() if int(b) < first} | {b: folder for b in self._written(folder)}
        grown = spans.select("entity", "first", "last").unionByName(reached.select("entity", F.col("low").alias("first"), F.col("high").alias("last")))
        self.write(grown.groupBy("entity").agg(F.min("first").alias("first"), F.max("last").alias("last")), folder, "spans")
        ids = single.where("id is not null").select("id")
        if len(seen) >= COMPACT_AFTER:
            ids, seen = ids.unionByName(known), []
        self.write(ids, folder, "ids")
        self.publish(n + 1, {"folder": folder, "batch": batch if batch is not None else folder, "blocks": blocks, "ids": [*seen, folder]})
        self.drop(folder, "arrivals")

    def _written(self, folder: str) -> list[str]:
        """Blocks a version has written."""
        fs, p = file_system(self.spark, self.path)
        names = [s.getPath().getName() for s in fs.listStatus(p(f"{self.path}/{folder}/totals"))]
        return [x[6:] for x in names if x.startswith("block=")]


def load_by_last_day(scans: DataFrame, state: ScanTotals) -> DataFrame:
    """The totals of ``scans`` through stored versions: first what was received before the last day, then that day's arrivals and rows without a time."""
    last = scans.agg(F.max(F.to_date("received_at")).alias("d")).first().d  # one row
    if last is not None:
        before = F.coalesce(F.to_date("received_at") < F.lit(last), F.lit(False))
        state.load(scans.where(before), "before the last day")
        scans = scans.where(~before)
    state.load(scans, "last day")
    return state.totals()
