"""Subject areas of documents, by curated terms.

One automaton (Aho-Corasick) holds the terms of all subjects and languages, slips of two neighbouring letters in longer words and
common turns of phrase in which a term means something else. A document is read sentence by sentence: of
overlapping matches the longest counts, and identifiers are read as
words (``wishListRef`` holds "wish list"). Code blocks, paths, links and headings are left out.

Counts become a score: a term that several subjects claim speaks, with a part of its weight, for that of them which the document's other
terms speak for most (and for none if there are no others), a rare term (few documents of the
whole corpus have it) counts more than a common one, a term of several words ``PHRASE_WEIGHT`` times as much as a single word, and the sum is divided by the document's length in sentences, short documents
counting as ``floor`` sentences. A subject is assigned if its score reaches the threshold. Floor and threshold are those with the best F1 on
the documents labelled by people.

The automaton runs once over every whole text, as a map without a shuffle (but ``spread`` for small inputs), and its counts are
written to the shared folder. Rarity is an aggregate over all documents with one row per term. Scoring reads those counts. Floor and threshold
are the best over every labelled document: F1 at each density comes from running sums over buckets of densities, never sorted in one task. The driver
sees one row per term, and one of the chosen floor and threshold.

Defined cases: null, empty and blank texts have no subject. Without usable labels floor and threshold are ``DEFAULT``. Repeated ids
are judged together, as one document. A document may have none, one or several subjects.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lakesift.llm.subject_terms import IDIOMS, PHRASE_WEIGHT, TERMS
from lakesift.runtime import materialise, spread

PER_OCTAVE = 256
DEFAULT = (16, 0.13)
FLOORS = (4, 6, 8, 10, 12, 16, 24)
SHARED_WEIGHT = 0.8

_CODE = re.compile(r"```.*?(?:```|\Z)", re.S)
_LINES = re.compile(r"^#+ .*$|^\w+\([^)\n]*\)!?:|\S*/\S*", re.M)
_CAMEL = re.compile(r"([a-z])([A-Z])")
_SENTENCE = re.compile(r"(?<=[.?!。])\s*|\n")


def subjects() -> list[str]:
    """All subjects, in order."""
    return sorted(TERMS)


def term_table() -> list[tuple[str, list[str]]]:
    """Every term with its subjects, in order."""
    held: dict[str, set[str]] = {}
    for subject, by_lang in TERMS.items():
        for listed in by_lang.values():
            for t in listed.split(","):
                held.setdefault(t.strip(), set()).add(subject)
    return [(t, sorted(held[t])) for t in sorted(held)]


def _slips(term: str) -> set[str]:
    """A term with two neighbouring letters of one of its words swapped."""
    out = set()
    for i in range(1, len(term) - 1):
        a, b = term[i], term[i + 1]
        if a != b and a.isalpha() and b.isalpha() and term[i - 1].isalpha():
            out.add(term[:i] + b + a + term[i + 2 :])
    return {s for s in out if len(s) >= 5 and s.isascii()}


def automaton():  # noqa: ANN201
    """Patterns to (kind, term number, pattern, whether it needs word ends)."""
    import ahocorasick

    auto = ahocorasick.Automaton()
    terms = term_table()
    known = {t for t, _ in terms}
    english = {t.strip() for by_lang in TERMS.values() for t in by_lang["en"].split(",")}
    for n, (t, _) in enumerate(terms):
        for s in (_slips(t) if t in english else set()) - known:
            auto.add_word(s, ("term", n, len(s), True))
    for n, (t, _) in enumerate(terms):
        auto.add_word(t, ("term", n, len(t), ord(t[0]) < 0x3000))
    for t in IDIOMS.split(","):
        auto.add_word(t.strip(), ("idiom", -1, len(t.strip()), True))
    auto.make_automaton()
    return auto


def _wordlike(c: str) -> bool:
    return c.isalnum() or c == "-"


def count_terms(auto, text: str) -> tuple[Counter, int]:  # noqa: ANN001
    """How often each term stands in a text, and the number of sentences."""
    t = _LINES.sub(" ", _CODE.sub(" ", text))
    t = _CAMEL.sub(r"\1 \2", t).replace("_", " ").lower()
    counts: Counter = Counter()
    sentences = 0
    for s in _SENTENCE.split(t):
        if not s or s.isspace():
            continue
        sentences += 1
        found = []
        for end, (kind, n, size, bounded) in auto.iter(s):
            start, stop = end - size + 1, end + 1
            if bounded:
                if start and _wordlike(s[start - 1]):
                    continue
                if stop < len(s) and s[stop] == "s":
                    stop += 1
                if stop < len(s) and _wordlike(s[stop]):
                    continue
            found.append((start, -size, stop, kind, n))
        at = 0
        for start, _, stop, kind, n in sorted(found):
            if start >= at:
                at = stop
                if kind == "term":
                    counts[n] += 1
    return counts, sentences


def term_counts(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, sentences, hits array<struct<term, n>>) of every document with a text."""
    slim = spread(docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")), "id").where("text is not null")
    kept: list = []

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if not kept:
            kept.append(automaton())
        hit = pa.list_(pa.struct([("term", pa.int32()), ("n", pa.int32())]))
        for batch in batches:
            counted = [count_terms(kept[0], t) for t in batch.column(1).to_pylist()]
            hits = pa.array([[{"term": k, "n": v} for k, v in sorted(c.items())] for c, _ in counted], hit)
            size = pa.array([n for _, n in counted], pa.int32())
            yield pa.RecordBatch.from_arrays([batch.column(0), size, hits], ["id", "sentences", "hits"])

    kind = slim.schema["id"].dataType.simpleString()
    return slim.mapInArrow(read, f"id {kind}, sentences int, hits array<struct<term:int,n:int>>")


def rarities(counts: DataFrame, total: int) -> list[float]:
    """For each term its weight times ln(1 + N / documents with it), which is scaled to a mean of 1 and held within [0.8, 1.25]."""
    rows = counts.select(F.explode("hits.term").alias("term")).groupBy("term").agg(F.count("*").alias("df")).collect()  # one row per term
    df = {r.term: r.df for r in rows}
    raw = [math.log1p(total / df[n]) if n in df else 0.0 for n in range(len(term_table()))]
    seen = [r for r in raw if r]
    mean = sum(seen) / len(seen) if seen else 1.0
    weights = [PHRASE_WEIGHT if " " in t else 1.0 for t, _ in term_table()]
    return [w * min(1.25, max(0.8, (r or mean) / mean)) for r, w in zip(raw, weights, strict=True)]


def score_hits(hits: list[tuple[int, int]], rarity: list[float], terms: list[tuple[str, list[str]]]) -> dict[str, float]:
    """Score of each subject for a document's (term, count) pairs."""
    own: dict[str, float] = {}
    for t, n in hits:
        if len(terms[t][1]) == 1:
            s = terms[t][1][0]
            own[s] = own.get(s, 0.0) + n * rarity[t]
    out = dict(own)
    for t, n in hits:
        rivals = terms[t][1]
        if len(rivals) > 1:
            most = max(own.get(s, 0.0) for s in rivals)
            for s in rivals:
                if most and own.get(s, 0.0) == most:
                    out[s] += n * rarity[t] * SHARED_WEIGHT
    return out


def scores(counts: DataFrame, rarity: list[float]) -> DataFrame:
    """(id, sentences, subject, score) of every subject a document's terms speak for; sees counts only, no texts."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        terms = term_table()
        for batch in batches:
            ids, sentences, names, values = [], [], [], []
            for i, (size, hits) in enumerate(zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True)):
                for s, v in score_hits([(h["term"], h["n"]) for h in hits], rarity, terms).items():
                    ids.append(i)
                    sentences.append(size)
                    names.append(s)
                    values.append(round(v, 6))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(ids, pa.int64())), pa.array(sentences, pa.int32()), pa.array(names, pa.string()), pa.array(values, pa.float64())],
                ["id", "sentences", "subject", "score"],
            )

    kind = counts.schema["id"].dataType.simpleString()
    return counts.where(F.size("hits") > 0).select("id", "sentences", "hits").mapInArrow(read, f"id {kind}, sentences int, subject string, score double")


def calibrate(scored: DataFrame, labels: DataFrame, id_col: str) -> tuple[int, float]:
    """Floor and threshold with the best F1 on all labelled documents (ties: the smaller floor, then the greater threshold)."""
    by_doc = labels.where(F.col("subject").isNotNull()).groupBy(F.col(id_col).alias("id")).agg(F.collect_set("subject").alias("labels"))
    wanted = by_doc.agg(F.sum(F.size("labels"))).first()[0]
    if not wanted:
        return DEFAULT
    good = F.array_contains("labels", F.col("subject")).cast("bigint")
    judged = scored.where("score != 0").join(by_doc, "id").groupBy("score", F.greatest("sentences", F.lit(min(FLOORS))).alias("sentences"))
    points = materialise(judged.agg(F.count("*").alias("n"), F.sum(good).alias("good")), "subject-points")
    floored = points.withColumn("floor", F.explode(F.array(*map(F.lit, FLOORS))))
    density = (F.col("score") / F.greatest("sentences", "floor")).alias("density")
    edges = floored.groupBy("floor", density).agg(F.sum("n").alias("n"), F.sum("good").alias("good"))
    bucketed = edges.withColumn("bucket", F.floor(F.log2("density") * PER_OCTAVE))
    sums = bucketed.groupBy("floor", "bucket").agg(F.sum("n").alias("n"), F.sum("good").alias("good"), F.max("density").alias("top"))
    by_bucket = Window.partitionBy("floor").orderBy(F.desc("bucket"))
    above = by_bucket.rowsBetween(Window.unboundedPreceding, -1)
    offsets = sums.select(
        "floor", "bucket", F.coalesce(F.sum("n").over(above), F.lit(0)).alias("n_above"), F.coalesce(F.sum("good").over(above), F.lit(0)).alias("good_above"),
        F.lead("top").over(by_bucket).alias("next_top"),
    )
    within = Window.partitionBy("floor", "bucket").orderBy(F.desc("density"))
    so_far = within.rowsBetween(Window.unboundedPreceding, 0)
    summed = bucketed.select(
        "floor", "bucket", "density", F.sum("n").over(so_far).alias("n"), F.sum("good").over(so_far).alias("good"), F.lead("density").over(within).alias("next")
    ).join(offsets, ["floor", "bucket"])
    f1 = 2 * (F.col("good_above") + F.col("good")) / (F.col("n_above") + F.col("n") + F.lit(wanted))
    below = F.coalesce("next", "next_top", F.lit(0.0))
    best = summed.select("floor", "density", below.alias("below"), f1.alias("f1")).orderBy(F.desc("f1"), "floor", F.desc("density")).limit(1).collect()
    return (best[0].floor, (best[0].density + best[0].below) / 2) if best else DEFAULT


def subject_of(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id_col, subject) of every document."""
    raw = materialise(term_counts(docs, id_col, text_col), "subject-terms")
    total = raw.count()
    scored = scores(raw, rarities(raw, total))
    # Only repeated ids have several rows of a subject; each other row passes as it is.
    together = materialise(scored.groupBy("id", "subject").agg(F.sum("sentences").alias("sentences"), F.sum("score").alias("score")), "subject-scores")
    floor, threshold = calibrate(together, labels, id_col)
    density = F.col("score") / F.greatest(F.col("sentences"), F.lit(floor))
    return together.where(density >= threshold).select(F.col("id").alias(id_col), "subject")


def unlabelled_subjects(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, subject) of the documents without a label."""
    found = subject_of(docs, labels)
    return found.join(labels.select("doc_id").distinct(), "doc_id", "left_anti")
