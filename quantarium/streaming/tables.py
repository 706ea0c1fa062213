"""A table that a stream adds to: a folder a batch, and a log of commits that names the folders that count.

A batch is written to a folder of its own; its line in the log comes last. A batch that was killed in between leaves a
folder that no line names, and one that is run again finds its number in the log: neither adds anything. Nothing that has
been written is written again.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from ..sources.shared import exists

_LOG = "batch_id long, folder string"


class BatchTable:
    """Frames by name, each of one schema, in the folder ``root`` of a store that Spark reads."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def commits(self) -> list:
        """(batch_id, folder) of the batches that count, in order; one row a batch."""
        log = f"{self.root}/log"
        return self.spark.read.schema(_LOG).parquet(log).orderBy("batch_id").collect() if exists(self.spark, log) else []

    def has(self, batch_id: int) -> bool:
        return any(c.batch_id >= batch_id for c in self.commits())

    def read(self, name: str, schema, last: bool = False) -> DataFrame:
        """The rows of all batches, or of the last one."""
        folders = [f"{c.folder}/{name}" for c in self.commits()]
        found = folders[-1:] if last else folders
        return self.spark.read.schema(schema).parquet(*found) if found else self.spark.createDataFrame([], schema)

    def write(self, frames: dict[str, DataFrame]) -> str:
        """A new folder with these frames, which doesn't count yet."""
        folder = f"{self.root}/batch-{uuid.uuid4().hex}"
        for name, df in frames.items():
            df.write.parquet(f"{folder}/{name}")
        return folder

    def log(self, batch_id: int, folder: str) -> None:
        self.spark.createDataFrame([(batch_id, folder)], _LOG).coalesce(1).write.mode("append").parquet(f"{self.root}/log")

    def commit(self, batch_id: int, frames: dict[str, DataFrame]) -> None:
        if not self.has(batch_id):
            self.log(batch_id, self.write(frames))
