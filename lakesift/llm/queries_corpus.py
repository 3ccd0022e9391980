"""Queries of the operators on documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from lakesift.llm.bpe import encode_corpus
from lakesift.llm.mixing import mix
from lakesift.llm.subjects import unlabelled_subjects
from lakesift.runtime import table


def p8_ids(spark: SparkSession, sf: str) -> DataFrame:
    """Token ids of every document."""
    return encode_corpus(table(spark, sf, "documents"))


def p9_mix(spark: SparkSession, sf: str) -> DataFrame:
    """Documents of the mixture and how often each is used."""
    return mix(table(spark, sf, "documents"), table(spark, sf, "mix_targets"))[0]


def p9_shares(spark: SparkSession, sf: str) -> DataFrame:
    """Shares reached by every target."""
    return mix(table(spark, sf, "documents"), table(spark, sf, "mix_targets"))[1]


def p10_found(spark: SparkSession, sf: str) -> DataFrame:
    """Subjects of the documents nobody has labelled."""
    return unlabelled_subjects(table(spark, sf, "documents"), table(spark, sf, "doc_labels"))


QUERIES = {f.__name__: f for f in (p8_ids, p9_mix, p9_shares, p10_found)}
SQL: dict[str, str] = {}
