"""Versioned state in a folder that all executors share.

Each version is written whole into a folder with a name of its own and becomes current by one rename of a pointer file, which names what the version
consists of. A job lost half-way leaves the earlier version current; what it wrote is never read. Of two writers of one version the
second finds the pointer taken and fails without having touched anything of the first. A batch that has an id is committed with it: a job that
runs the batch again is given what was committed. (A rename onto an existing name is refused by HDFS itself; on a plain local file system two
renames within the same instant could both pass, so the pointer is read again after it.)
"""

from __future__ import annotations

import hashlib
import json
import uuid
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from lakesift.runtime import file_system

#: Versions whose additions are read one by one before the next version writes them whole.
COMPACT_AFTER = 32


class LostRaceError(RuntimeError):
    """Another job committed the version first."""


@dataclass
class Versions:
    """A folder of versions, the highest committed of which is current."""

    spark: SparkSession
    path: str

    def _read_text(self, path: str) -> str:
        fs, p = file_system(self.spark, path)
        with_lines = fs.open(p(path))
        try:
            return self.spark._jvm.org.apache.commons.io.IOUtils.toString(with_lines, "UTF-8")
        finally:
            with_lines.close()

    def _write_text(self, path: str, text: str) -> None:
        fs, p = file_system(self.spark, path)
        out = fs.create(p(path), True)
        try:
            out.write(bytearray(text.encode()))
        finally:
            out.close()

    def version(self) -> int:
        """Number of the current version, 0 before the first."""
        fs, p = file_system(self.spark, self.path)
        if not fs.exists(p(self.path)):
            return 0
        names = [s.getPath().getName() for s in fs.listStatus(p(self.path))]
        return max([0, *(int(n[8:]) for n in names if n.startswith("CURRENT-"))])

    def manifest(self, n: int | None = None) -> dict:
        """What a version (the current one) consists of; empty before the first."""
        n = self.version() if n is None else n
        return json.loads(self._read_text(f"{self.path}/CURRENT-{n}")) if n else {}

    def new_folder(self) -> str:
        """Name of a folder for the next version; nobody else writes there."""
        return f"v-{uuid.uuid4().hex}"

    def write(self, df: DataFrame, folder: str, what: str, partition_by: str | None = None) -> None:
        writer = df.write.option("compression", "zstd")
        (writer.partitionBy(partition_by) if partition_by else writer).parquet(f"{self.path}/{folder}/{what}")

    def read(self, folders: list[str], what: str, schema: str) -> DataFrame:
        """Rows of ``what`` in several folders, none for no folder."""
        if not folders:
            cols = ", ".join("CAST(NULL AS {1}) AS {0}".format(*c.split()) for c in schema.split(", "))
            return self.spark.sql(f"SELECT {cols} LIMIT 0")
        return self.spark.read.schema(schema).parquet(*[f"{self.path}/{f}/{what}" for f in folders])

    def _marker(self, batch: str) -> str:
        return f"{self.path}/batches/{hashlib.sha256(batch.encode()).hexdigest()}"

    def committed(self, batch: str | None) -> str | None:
        """The folder with which a batch was committed, or None."""
        current = self.manifest()
        if current.get("batch") is not None:  # the job may have ended between pointer and marker
            self._write_text(self._marker(current["batch"]), current["folder"])
        if batch is None:
            return None
        fs, p = file_system(self.spark, self.path)
        return self._read_text(self._marker(batch)) if fs.exists(p(self._marker(batch))) else None

    def publish(self, n: int, manifest: dict) -> None:
        """Make version ``n`` (its ``folder`` is written whole) current by one rename; fails if another job has done so."""
        pending, pointer = f"{self.path}/_pending-{manifest['folder']}", f"{self.path}/CURRENT-{n}"
        self._write_text(pending, json.dumps(manifest))
        jvm = self.spark._jvm
        fs, p = file_system(self.spark, self.path)
        try:
            context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(fs.getUri(), self.spark._jsc.hadoopConfiguration())
            none = self.spark.sparkContext._gateway.new_array(getattr(jvm.org.apache.hadoop.fs, "Options$Rename"), 0)
            context.rename(p(pending), p(pointer), none)
        except Exception as e:
            if fs.exists(p(pointer)):
                fs.delete(p(pending), False)
                raise LostRaceError(f"version {n} of {self.path} was committed by another job") from e
            raise
        if self.manifest(n)["folder"] != manifest["folder"]:
            raise LostRaceError(f"version {n} of {self.path} was committed by another job")
        self.committed(None)

    def drop(self, folder: str, what: str) -> None:
        """Remove an intermediate table of a version."""
        fs, p = file_system(self.spark, self.path)
        fs.delete(p(f"{self.path}/{folder}/{what}"), True)
