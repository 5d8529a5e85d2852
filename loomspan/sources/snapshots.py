"""Tables that change by whole snapshots: a reader sees all of one or all of the next, and a failed write leaves the last one."""

from __future__ import annotations

import json
import tempfile
import uuid
from collections.abc import Sequence
from functools import reduce
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T


def shared_dir(spark: SparkSession) -> str:
    """A new folder below ``spark.checkpoint.dir``; where that is unset, below a temporary folder in local mode and nowhere else."""
    sc = spark.sparkContext
    base = sc.getConf().get("spark.checkpoint.dir") or (str(sc.getCheckpointDir()) if sc.getCheckpointDir() else None)
    if not base:
        if not sc.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        base = tempfile.mkdtemp(prefix="loomspan-")
        sc.setCheckpointDir(base)
    path = f"{base}/table-{uuid.uuid4().hex}"
    jpath = sc._jvm.org.apache.hadoop.fs.Path(path)
    jpath.getFileSystem(sc._jsc.hadoopConfiguration()).deleteOnExit(jpath)
    return path


def stored(df: DataFrame) -> DataFrame:
    """The table written to the shared folder and read again: lineage ends, and later reads cost no recomputation."""
    path = shared_dir(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


class Conflict(RuntimeError):
    """Another writer has published since this one read."""


class Snapshots:
    """Named tables below one path. Each snapshot is a numbered file that lists the folders of every table; data folders never change.

    A writer writes new folders first and then puts the next number's file in place by a rename that fails if the number is taken, so
    of two writers that started from one snapshot the second gets ``Conflict`` and may start again from the new one.
    """

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path
        self._fs = spark._jvm.org.apache.hadoop.fs
        self._conf = spark._jsc.hadoopConfiguration()
        self._files = self._fs.Path(path).getFileSystem(self._conf)

    def number(self) -> int:
        """The number of the last snapshot, 0 if there is none."""
        folder = self._fs.Path(f"{self.path}/snapshots")
        if not self._files.exists(folder):
            return 0
        names = [f.getPath().getName() for f in self._files.listStatus(folder)]
        return max((int(n.removesuffix(".json")) for n in names if n.endswith(".json") and n[0] != "."), default=0)

    def manifest(self, number: int | None = None) -> dict[str, Any]:
        number = self.number() if number is None else number
        if not number:
            return {"tables": {}, "notes": {}}
        stream = self._files.open(self._fs.Path(f"{self.path}/snapshots/{number}.json"))
        try:
            return json.loads(self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()

    def read(self, name: str, number: int | None = None) -> DataFrame:
        """A table as of a snapshot, the last one if none is named."""
        return self.load(self.manifest(number)["tables"][name])

    def load(self, entry: dict) -> DataFrame:
        """The rows of an entry, published or not."""
        schema = T.StructType.fromJson(entry["schema"])
        return reduce(DataFrame.unionByName, [self.spark.read.schema(schema).parquet(f"{self.path}/{f}") for f in entry["folders"]])

    def write(self, df: DataFrame, partition_by: Sequence[str] = (), after: dict | None = None) -> dict:
        """A table's rows in a new folder, which no reader sees before it is published; behind those of ``after``, an entry of a manifest."""
        folder = f"data/{uuid.uuid4().hex}"
        (df.write.partitionBy(*partition_by) if partition_by else df.write).parquet(f"{self.path}/{folder}")
        return {"folders": [*(after["folders"] if after else []), folder], "schema": json.loads(df.schema.json())}

    def publish(self, base: int, tables: dict[str, dict], notes: dict[str, Any]) -> int:
        """Make the entries the next snapshot after ``base``, which must still be the last."""
        number, names = base + 1, self._fs.Path
        if self.number() != base:
            raise Conflict(f"snapshot {number} is there already")
        draft = names(f"{self.path}/snapshots/.{uuid.uuid4().hex}")
        out = self._files.create(draft, True)
        out.write(bytearray(json.dumps({"tables": tables, "notes": notes}).encode()))
        out.close()
        context = self._fs.FileContext.getFileContext(draft.toUri(), self._conf) if draft.toUri().getScheme() else self._fs.FileContext.getFileContext(self._conf)
        none = self.spark.sparkContext._gateway.new_array(self._fs.Options.Rename, 0)
        try:
            context.rename(draft, names(f"{self.path}/snapshots/{number}.json"), none)
        except Exception as e:
            self._files.delete(draft, False)
            if self.number() >= number:
                raise Conflict(f"snapshot {number} is there already") from e
            raise
        return number
