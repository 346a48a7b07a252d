"""A grid kept in storage by a stream's batches.

Every batch leaves its cells in a folder of its own, ``batch=<id>``, which a replay overwrites: so a batch counts
once however often it runs, and after a restart nothing is read but what is new.  Counts of cells add up, so the grid
is the sum over the folders.  ``compact`` sums the folders up to a batch into ``upto=<id>``; readers take the greatest
complete one and the batches after it, so a compaction that fails halfway changes nothing.
"""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def scratch_folder(spark: SparkSession, what: str) -> str:
    """A new path in spark.checkpoint.dir, or in a folder of our own in local mode where that is unset."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="axisloom-")
    return f"{found.rstrip('/')}/{what}-{uuid.uuid4().hex}"


class GridStore:
    """Counts by keys, as columns of a stream, kept under a path of any Hadoop file system."""

    def __init__(self, spark: SparkSession, path: str, keys: tuple[str, ...] = ("ix", "iy", "cls")):
        self.spark, self.path, self.keys = spark, path.rstrip("/"), keys

    def _folders(self) -> dict[tuple[str, int], str]:
        """The complete folders, by kind and batch."""
        jvm, conf = self.spark.sparkContext._jvm, self.spark.sparkContext._jsc.hadoopConfiguration()
        top = jvm.org.apache.hadoop.fs.Path(self.path)
        fs = top.getFileSystem(conf)
        out = {}
        for f in fs.listStatus(top) if fs.exists(top) else ():
            m = re.fullmatch(r"(batch|upto)=(\d+)", f.getPath().getName())
            if m and fs.exists(jvm.org.apache.hadoop.fs.Path(f.getPath(), "_SUCCESS")):
                out[m[1], int(m[2])] = f"{self.path}/{m[0]}"
        return out

    def write_batch(self, batch: DataFrame, batch_id: int) -> None:
        """For foreachBatch: the batch's rows, counted by key, in place of what the batch has left before."""
        batch.groupBy(*self.keys).agg(F.count("*").alias("count")).write.mode("overwrite").parquet(f"{self.path}/batch={batch_id}")

    def _live(self) -> tuple[list[str], int]:
        found = self._folders()
        base = max((k for kind, k in found if kind == "upto"), default=-1)
        return [p for (kind, k), p in sorted(found.items()) if (kind == "upto" and k == base) or (kind == "batch" and k > base)], max((k for _, k in found), default=-1)

    def read(self) -> DataFrame | None:
        """(keys, count) over all batches; None before the first."""
        live, _ = self._live()
        return self.spark.read.parquet(*live).groupBy(*self.keys).agg(F.sum("count").alias("count")) if live else None

    def compact(self) -> None:
        """Sums all batches so far into one folder.  The stream that writes the store must not run meanwhile."""
        grid, (_, last) = self.read(), self._live()
        if grid is not None and ("upto", last) not in self._folders():
            grid.write.mode("overwrite").parquet(f"{self.path}/upto={last}")

    def start(self, rows: DataFrame, checkpoint: str, once: bool = False) -> StreamingQuery:
        """Keeps the grid of a stream of rows with the key columns; with once, of what is there now."""
        writer = rows.writeStream.foreachBatch(self.write_batch).option("checkpointLocation", checkpoint)
        return (writer.trigger(availableNow=True) if once else writer).start()
