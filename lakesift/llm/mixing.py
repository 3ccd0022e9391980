"""Mixing sources to target weights of tokens.

Each source s with share w(s), size(s) tokens and at most r(s) uses of a document gets the budget w(s) * T. T is given, or the
greatest total that every source can fill: min over s of r(s) * size(s) / w(s). Whole epochs come first: every document of the
source is used floor(budget / size) times. What is left of the budget is filled once more by weighted sampling without replacement
(Efraimidis-Spirakis): a document with quality weight q draws the key -ln(u) / q, u being uniform and derived from its id and a seed,
and documents are taken in the order of the keys until their running sum of tokens meets the rest. The document at the edge is
taken if that comes closer to the budget, so a share is off by half a document at most.

No source is ever sorted in one task: keys fall into buckets on a logarithmic scale whose number follows the number of documents,
the bucket sums (small, one row per source and bucket) are summed up in order, and only within a bucket are keys sorted.
The table of sources is bounded (``MAX_SOURCES``, checked) and read by the driver; nothing of the documents is.

Defined cases: a document whose source (case, blanks, ``-`` and ``_`` alike) is null or has no target, and a document without tokens
(null or empty text) is not used. A target without documents gets nothing and does not hold back the others; its share is reported as 0.
A null or negative number of uses counts as 0. Repeated ids draw the same key; the tokens and then the text's hash order them.
"""

from __future__ import annotations

import base64
import math
import os
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lakesift.llm.bpe import VOCABULARY_LIMIT, WORDS, default_path
from lakesift.runtime import materialise, ship_package, spread

MAX_SOURCES = 10_000
ROWS_PER_BUCKET = 50_000


def proper_source(c: Column) -> Column:
    """One spelling for a source: lower case, words joined by ``_``."""
    return F.regexp_replace(F.lower(F.trim(c)), r"[\s_-]+", "_")


def quality(text: Column) -> Column:
    """Weight in [0.1, 1]: the part of letters and blanks in a text, less for texts under 200 characters."""
    n = F.length(text)
    plain = n - F.length(F.regexp_replace(text, r"[\p{L}\s]", ""))
    return F.lit(0.1) + 0.9 * F.coalesce(plain / F.greatest(n, F.lit(1)), F.lit(0.0)) * F.least(n / F.lit(200.0), F.lit(1.0))


def token_counts(docs: DataFrame, text_col: str, path: str | None = None) -> DataFrame:
    """``docs`` with its text replaced by ``tokens``, the number of tokens of the public byte-level tokenizer (0 for null)."""
    ship_package(docs.sparkSession)
    path = path or default_path().replace(".json", ".tiktoken")
    if os.path.getsize(path) > VOCABULARY_LIMIT:
        raise ValueError(f"{path} is larger than {VOCABULARY_LIMIT} bytes, too large to broadcast")
    with open(path, "rb") as f:
        ranks = docs.sparkSession.sparkContext.broadcast(f.read())
    cache: dict[str, object] = {}

    @F.pandas_udf("bigint")
    def count(texts):  # noqa: ANN001, ANN202
        import tiktoken

        if "e" not in cache:
            table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, ranks.value.splitlines())}
            cache["e"] = tiktoken.Encoding("own", pat_str=WORDS, mergeable_ranks=table, special_tokens={})
        return texts.map(lambda t: len(cache["e"].encode_ordinary(t)) if t else 0)

    return docs.withColumn("tokens", count(F.col(text_col))).drop(text_col)


@dataclass
class Target:
    share: float
    repeats: int
    size: int = 0
    epochs: int = 0
    rest: float = 0.0


def plan_budgets(targets: dict[str, Target], total: float | None) -> float:
    """Fill in epochs and rest of every target; returns the total."""
    live = [t for t in targets.values() if t.size and t.share > 0]
    if total is None:
        total = min((t.repeats * t.size / t.share for t in live), default=0.0)
    for t in live:
        budget = min(t.share * total, float(t.repeats * t.size))
        t.epochs = min(math.floor(budget / t.size + 1e-12), t.repeats)
        t.rest = max(0.0, budget - t.epochs * t.size) if t.epochs < t.repeats else 0.0
    return total


def mix(
    docs: DataFrame, mix_targets: DataFrame, id_col: str = "doc_id", text_col: str = "text", total: float | None = None, seed: int = 17
) -> tuple[DataFrame, DataFrame]:
    """(used, shares): each used document with its number of copies, and what every target asked for and got."""
    spark = docs.sparkSession
    rows = mix_targets.groupBy(proper_source(F.col("source")).alias("s")).agg(F.sum("target_share"), F.max("max_repeats")).limit(MAX_SOURCES + 1).collect()
    if len(rows) > MAX_SOURCES:
        raise ValueError(f"more than {MAX_SOURCES} sources")
    targets = {r[0]: Target(float(r[1] or 0), max(0, int(r[2] or 0))) for r in rows if r[0] is not None}
    slim = docs.select(F.col(id_col).alias("id"), proper_source(F.col("source")).alias("source"), F.col(text_col).alias("text"))
    slim = spread(slim, "id").where(F.col("source").isin(list(targets)))
    u = (F.pmod(F.xxhash64(F.col("id"), F.lit(seed)), F.lit(1 << 52)) + 0.5) / F.lit(float(1 << 52))
    drawn = slim.withColumns({"key": -F.ln(u) / quality(F.col("text")), "tie": F.xxhash64("text")})
    sized = materialise(token_counts(drawn, "text").where("tokens > 0"), "mix-sizes")
    n = 0
    for r in sized.groupBy("source").agg(F.sum("tokens"), F.count("*")).collect():  # one row per target: bounded
        targets[r[0]].size = int(r[1])
        n += r[2]
    plan_budgets(targets, total)
    per_octave = max(4, n // (4 * ROWS_PER_BUCKET))
    plan = spark.createDataFrame(
        [(s, t.share, t.repeats, t.size, t.epochs, t.rest) for s, t in targets.items()],
        "source string, target_share double, max_repeats int, size bigint, epochs int, rest double",
    )
    bucketed = sized.withColumn("bucket", F.floor(F.log2(F.greatest("key", F.lit(1e-300))) * per_octave))
    by_key = Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    sums = bucketed.groupBy("source", "bucket").agg(F.sum("tokens").alias("t"))
    offsets = sums.select("source", "bucket", F.coalesce(F.sum("t").over(by_key), F.lit(0)).alias("before"))
    within = Window.partitionBy("source", "bucket").orderBy("key", "tokens", "tie", "id").rowsBetween(Window.unboundedPreceding, -1)
    placed = (
        bucketed.withColumn("inner", F.coalesce(F.sum("tokens").over(within), F.lit(0)))
        .join(offsets, ["source", "bucket"])
        .join(F.broadcast(plan), "source")  # at most MAX_SOURCES rows
    )
    taken = (F.col("before") + F.col("inner") + F.col("tokens") / 2 <= F.col("rest")).cast("int")
    used = placed.withColumn("copies", F.col("epochs") + taken).where("copies > 0").select(F.col("id").alias(id_col), "source", "tokens", "copies")
    got = used.groupBy("source").agg(
        F.sum(F.col("tokens") * F.col("copies")).alias("tokens"), F.count("*").alias("documents"), F.max("copies").alias("most_copies")
    )
    every = plan.join(got, "source", "left")
    whole = every.groupBy().agg(F.sum("tokens").alias("whole"))
    shares = every.crossJoin(F.broadcast(whole)).select(  # one row
        "source", "target_share", F.coalesce("tokens", F.lit(0)).alias("tokens"), F.coalesce("documents", F.lit(0)).alias("documents"),
        F.coalesce("most_copies", F.lit(0)).alias("most_copies"), "max_repeats",
        F.coalesce(F.round(F.col("tokens") / F.col("whole"), 6), F.lit(0.0)).alias("actual_share"),
    )
    return used, shares


def copies_of(docs: DataFrame, used: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """The mixed corpus itself: every used document as often as it is used, numbered by ``copy`` from 0."""
    return docs.join(used.select(id_col, "copies"), id_col).withColumn("copy", F.explode(F.sequence(F.lit(0), F.col("copies") - 1))).drop("copies")

