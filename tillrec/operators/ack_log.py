"""Acknowledgements as a snapshot and a log of what came since.

``append`` writes a batch of its own (a repeated batch replaces itself); ``compact`` folds the batches so far into a new
snapshot, one row per alert, last acknowledgement wins, and the state is read from the newest whole snapshot
and the batches after it. The snapshot's number is the last batch in it, so nothing counts twice or is lost when
a compaction breaks off, and old batches may go once a later snapshot is there.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_ACKS = "alert_id string, ack_at timestamp_ntz"


class AckLog:
    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def _numbers(self, name: str) -> list[int]:
        """Numbers of the folders that were written whole."""
        hadoop = self.spark._jvm.org.apache.hadoop.fs
        root = hadoop.Path(f"{self.path}/{name}")
        fs = root.getFileSystem(self.spark._jsc.hadoopConfiguration())
        if not fs.exists(root):
            return []
        return sorted(int(s.getPath().getName().split("=")[1]) for s in fs.listStatus(root)
                      if fs.exists(hadoop.Path(s.getPath(), "_SUCCESS")))

    def append(self, acks: DataFrame, batch: int) -> None:
        """Batches are numbered upwards; a batch already in a snapshot can't be written again."""
        if batch <= self.snapshot():
            raise ValueError(f"batch {batch} is already part of a snapshot")
        acks.select("alert_id", F.col("ack_at").cast("timestamp_ntz").alias("ack_at")).write.mode("overwrite").parquet(f"{self.path}/log/batch={batch}")

    def snapshot(self) -> int:
        """The last batch in the newest snapshot, -1 if there is none."""
        return max(self._numbers("snapshot"), default=-1)

    def _rows(self, upto: int | None = None) -> DataFrame:
        last = self.snapshot()
        paths = [f"{self.path}/snapshot/upto={last}"] if last >= 0 else []
        paths += [f"{self.path}/log/batch={b}" for b in self._numbers("log") if b > last and (upto is None or b <= upto)]
        return self.spark.read.schema(_ACKS).parquet(*paths) if paths else self.spark.createDataFrame([], _ACKS)

    def state(self) -> DataFrame:
        """(alert_id, ack_at): the latest acknowledgement of every alert; an input for ``alerts.alert_state``."""
        return self._rows().groupBy("alert_id").agg(F.max("ack_at").alias("ack_at"))

    def compact(self) -> int:
        """Fold all batches so far into a new snapshot; its number."""
        last = max(self._numbers("log"), default=-1)
        if last > self.snapshot():
            self._rows(last).groupBy("alert_id").agg(F.max("ack_at").alias("ack_at")).write.mode("overwrite") \
                .parquet(f"{self.path}/snapshot/upto={last}")
        return self.snapshot()
