"""Source files that do not parse in the language their extension stands for.

Every file is cut into tokens and parsed whole, by generalised LR parsing with tables built from the grammars of the six languages in ``parsing`` (see there).
The first token that no reading of the file can take is reported. Stored warnings come along for comparison but decide nothing: they are neither complete nor right.

One map over the files in Arrow batches, without a shuffle (but ``spread`` for small inputs); rates are a partial aggregate. Tables are built
once per Python worker, in about a second. Parsing takes time in proportion to the tokens.

Defined cases: a null source is no case and does not count in rates. An empty source is a valid file in every language but Go, where a file begins with its package.
A path whose extension stands for none of the six languages, or a null path, has no verdict. Files nested too deeply for the parser are reported as
such. Repeated rows give repeated rows; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lakesift.llm.parsing import first_fault, language_of
from lakesift.runtime import spread


def verdicts(files: DataFrame) -> DataFrame:
    """(file_id, repository, language, valid, line, column, message) of every file with a source in a known language."""
    slim = spread(files.select("file_id", "repository", "path", "source"), "file_id").where("source is not null")

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows: list[tuple] = []
            for i, (path, source) in enumerate(zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True)):
                language = language_of(path)
                if language is None:
                    continue
                fault = first_fault(source, language)
                rows.append((i, language, fault is None, *((fault.line, fault.column, fault.what) if fault else (None, None, None))))
            kept = pa.array([r[0] for r in rows], pa.int64())
            columns = [batch.column(0).take(kept), batch.column(1).take(kept)]
            kinds = (pa.string(), pa.bool_(), pa.int32(), pa.int32(), pa.string())
            columns += [pa.array([r[k + 1] for r in rows], t) for k, t in enumerate(kinds)]
            yield pa.RecordBatch.from_arrays(columns, ["file_id", "repository", "language", "valid", "line", "column", "message"])

    kind = slim.schema["file_id"].dataType.simpleString()
    return slim.mapInArrow(read, f"file_id {kind}, repository string, language string, valid boolean, line int, column int, message string")


def invalid_files(files: DataFrame) -> DataFrame:
    """(file_id) of the files that are not valid."""
    return verdicts(files).where("not valid").select("file_id")


def rates(files: DataFrame) -> DataFrame:
    """Files and invalid files per repository and language, with the rate; a null repository is a group of its own."""
    return (
        verdicts(files)
        .groupBy("repository", "language")
        .agg(F.count("*").alias("files"), F.count_if(~F.col("valid")).alias("invalid"))
        .withColumn("rate", F.round(F.col("invalid") / F.col("files"), 6))
    )
