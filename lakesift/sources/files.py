"""Sources: files of a tree, tables of parsed files, saved scans, event lines, databases and document streams."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lakesift.config import LANGUAGES, Config
from lakesift.functions.globs import glob_regex

LOCATION = "struct<file:string,line:int,column:int>"
FLOW = f"struct<source:struct<kind:string,label:string,location:{LOCATION}>,sink:struct<kind:string,label:string,location:{LOCATION}>,path:array<{LOCATION}>>"
MAPPINGS = "array<struct<framework:string,article:string,title:string,risk_description:string,recommendation:string>>"
FINDING = (
    f"id string, severity string, pii_type string, category string, location {LOCATION}, code_snippet string, data_flow {FLOW}, framework_mappings {MAPPINGS}, confidence string"
)


def language_of(path: Column) -> Column:
    """The language of a path's extension (case ignored), or null."""
    pairs = [x for e, lang in LANGUAGES.items() for x in (F.lit(e), F.lit(lang))]
    return F.try_element_at(F.create_map(*pairs), F.lower(F.regexp_extract(path, r"\.(\w+)$", 1)))


def any_glob(path: Column, globs: Sequence[str]) -> Column:
    """Whether a path (``\\`` read as ``/``) matches one of the globs."""
    if not globs:
        return F.lit(False)
    return F.translate(path, "\\", "/").rlike("|".join(f"(?:{glob_regex(g)})" for g in globs))


def excluded(relative: Column, globs: Sequence[str]) -> Column:
    """Whether a path or one of its folders matches an exclude glob: a matching folder takes its whole subtree along."""
    parts = F.split(F.translate(relative, "\\", "/"), "/")
    prefixes = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.array_join(F.slice(parts, 1, n), "/"))
    return F.exists(prefixes, lambda p: any_glob(p, globs))


def discover(spark: SparkSession, root: str, config: Config | None = None) -> tuple[DataFrame, DataFrame]:
    """(files, skipped): path relative to ``root``, language, length and source of every file to scan; the number skipped.

    Extension, size and globs are judged on file metadata; contents of other files are not read. Files too large and files that
    are not UTF-8 count as skipped; files of no known language do not.
    """
    config = config or Config()
    listed = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.{" + ",".join(LANGUAGES) + "}").load(root)
    base = root.rstrip("/").replace("file://", "")
    relative = F.regexp_replace("path", f"^(?:file:)?(?://)?{'/' if not base.startswith('/') else ''}\\Q{base}\\E/", "")
    known = listed.withColumns({"file": relative, "language": language_of(F.col("path"))}).where(F.col("language").isin(config.languages) & ~excluded(F.col("file"), config.exclude))
    if config.include:
        known = known.where(any_glob(F.col("file"), config.include))
    small = known.where(F.col("length") <= config.max_file_size)
    text = small.select(F.col("file").alias("path"), "language", "length", F.try_validate_utf8("content").alias("source"))
    files = text.where("source is not null")
    skipped = known.where(F.col("length") > config.max_file_size).select(F.lit(1).alias("n")).unionByName(text.where("source is null").select(F.lit(1).alias("n")))
    return files, skipped.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("files_skipped"))


def table_files(parsed: DataFrame, config: Config | None = None) -> DataFrame:
    """Rows of a parsed_files table as files to scan, without a ``config`` all of any size; the language is that of the path's extension."""
    config = config or Config(languages=sorted(set(LANGUAGES.values())), exclude=[], max_file_size=(1 << 63) - 1)
    path = F.regexp_replace(F.translate("path", "\\", "/"), r"^(?:\./)+", "")
    rows = parsed.select("file_id", "repository", path.alias("path"), language_of(path).alias("language"), "source")
    kept = rows.where(F.col("source").isNotNull() & F.col("language").isin(config.languages) & (F.octet_length("source") <= config.max_file_size))
    if config.exclude:
        kept = kept.where(~excluded(F.col("path"), config.exclude))
    if config.include:
        kept = kept.where(any_glob(F.col("path"), config.include))
    return kept


def staged(files: DataFrame, changed: DataFrame, path_col: str = "path") -> DataFrame:
    """The files whose path is, or ends in ``/`` and, a path of the list of changes: a semi-join on every suffix of a path's folders."""
    parts = F.split(path_col, "/")
    suffixes = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.array_join(F.slice(parts, n, F.size(parts)), "/"))
    keyed = files.withColumn("_suffix", F.explode(suffixes))
    hit = keyed.join(changed.select(F.col(path_col).alias("_suffix")).distinct(), "_suffix", "left_semi")
    return hit.dropDuplicates([c for c in files.columns if c in ("file_id", path_col)]).drop("_suffix")


METADATA = "struct<path:string,files_scanned:bigint,files_skipped:bigint,duration:bigint,frameworks:array<string>,tool_version:string>"


def _documents(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(f"findings array<struct<{FINDING.replace(', ', ',').replace(' ', ':')}>>, metadata {METADATA}").json(path, multiLine=True)


def saved_scan(spark: SparkSession, path: str) -> DataFrame:
    """Findings of a saved scan (one JSON document with ``findings`` and ``metadata``, or a folder of them); a custom type stored as an object reads as its name."""
    out = _documents(spark, path).select(F.explode("findings").alias("f")).select("f.*")
    name = F.when(F.col("pii_type").startswith("{"), F.get_json_object("pii_type", "$.custom")).otherwise(F.col("pii_type"))
    return out.withColumn("pii_type", name)


def saved_metadata(spark: SparkSession, path: str) -> DataFrame:
    """What a saved scan says of itself, one row."""
    return _documents(spark, path).select("metadata.*").limit(1)


def event_lines(spark: SparkSession, path: str, schema: str = "event string, machine_id string, session_id string, timestamp bigint, properties map<string,string>") -> DataFrame:
    """Events, one JSON object a line; lines that do not parse are dropped."""
    return spark.read.schema(schema).option("mode", "DROPMALFORMED").json(path)


def database_table(spark: SparkSession, url: str, name: str, partition_column: str | None = None, bounds: tuple[str, str] | None = None, parts: int = 64) -> DataFrame:
    """A table over JDBC, read in parallel by ranges of a column where one is given."""
    reader = spark.read.format("jdbc").option("url", url).option("dbtable", name)
    if partition_column and bounds:
        reader = reader.options(partitionColumn=partition_column, lowerBound=bounds[0], upperBound=bounds[1], numPartitions=str(parts))
    return reader.load()
