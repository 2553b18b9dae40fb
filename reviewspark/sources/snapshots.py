"""Tables that grow by whole files and change in one step: a numbered manifest names the files that count.

Files are written first, to folders of their own; then the next manifest is written under another name and
renamed. A reader takes the highest manifest, so that a write that broke off leaves nothing but files that nothing names. A manifest's
number can be taken once: of two writers the second fails and may try again. The ledger holds the last numbered write of each
source, so that a repeated one changes nothing.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType


class Conflict(RuntimeError):
    """Another writer has made the same manifest."""


class Snapshots:
    """A table in a folder that all executors share."""

    def __init__(self, spark: SparkSession, folder: str, schema: StructType | str, partition_by: tuple[str, ...] = ()) -> None:
        self.spark, self.folder, self.partition_by = spark, folder.rstrip("/"), partition_by
        self.schema = spark.createDataFrame([], schema).schema
        self.fs = spark._jvm.org.apache.hadoop.fs.Path(self.folder).getFileSystem(spark._jsc.hadoopConfiguration())

    def _path(self, *parts: str):  # noqa: ANN202
        return self.spark._jvm.org.apache.hadoop.fs.Path("/".join([self.folder, *parts]))

    def versions(self) -> list[int]:
        top = self._path("manifests")
        return sorted(int(s.getPath().getName()[:-5]) for s in self.fs.listStatus(top) if s.getPath().getName().endswith(".json")) if self.fs.exists(top) else []

    def manifest(self, version: int | None = None) -> dict:
        """``version``, ``folders`` and ``ledger`` of a version, the last if none is given."""
        known = self.versions()
        if not known:
            return {"version": 0, "folders": [], "ledger": {}}
        at = known[-1] if version is None else version
        stream = self.fs.open(self._path("manifests", f"{at:012d}.json"))
        try:
            return json.loads(bytes(stream.readAllBytes()).decode())
        finally:
            stream.close()

    def _commit(self, before: dict, folders: list[str], mark: tuple[str, int] | None) -> int:
        made = {"version": before["version"] + 1, "folders": folders, "ledger": before["ledger"] | (dict([mark]) if mark else {})}
        temp, final = self._path("manifests", f"_{uuid.uuid4().hex}"), self._path("manifests", f"{made['version']:012d}.json")
        stream = self.fs.create(temp, False)
        stream.write(bytearray(json.dumps(made).encode()))
        stream.close()
        if self.fs.exists(final) or not self.fs.rename(temp, final):
            self.fs.delete(temp, False)
            raise Conflict(f"version {made['version']} of {self.folder} exists")
        return made["version"]

    def _write(self, rows: DataFrame) -> str:
        name = uuid.uuid4().hex
        rows.select(self.schema.fieldNames()).write.partitionBy(*self.partition_by).parquet(f"{self.folder}/data/{name}")
        return name

    def read(self, version: int | None = None) -> DataFrame:
        """The rows of a version."""
        folders = self.manifest(version)["folders"]
        if not folders:
            return self.spark.createDataFrame([], self.schema)
        out = None
        for f in folders:  # each folder has its own partition columns
            one = self.spark.read.schema(self.schema).parquet(f"{self.folder}/data/{f}").select(self.schema.fieldNames())
            out = one if out is None else out.unionByName(one)
        return out

    def append(self, rows: DataFrame, mark: tuple[str, int] | None = None) -> int:
        """Add rows; nothing happens where a write with this mark (source, number) or a later one has been made. Returns the version."""
        before = self.manifest()
        if mark and before["ledger"].get(mark[0], -1) >= mark[1]:
            return before["version"]
        return self._commit(before, [*before["folders"], self._write(rows)], mark)

    def replace(self, rows: DataFrame) -> int:
        """Put rows in place of all others, for instance those of many small appends in one. Older versions stay readable."""
        before = self.manifest()
        return self._commit(before, [self._write(rows)], None)
