"""The archives as streams: each micro-batch merges into a versioned table.

foreachBatch delivers at least once, so a merge is keyed by the batch: version
n holds the state after batch n, is written once, and a repeated batch starts
from version n - 1 again.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from helixframe.operators import archives

Merge = Callable[[DataFrame | None, DataFrame], DataFrame]


def threshold_merge(score: str, least: float) -> Merge:
    def merge(state, batch):
        new = archives.threshold(batch, score, least)
        return new if state is None else state.unionByName(new)

    return merge


def top_distinct_merge(k: int, seq: str = "seq", score: str = "score", step: str = "step") -> Merge:
    def merge(state, batch):
        rows = batch.select(seq, score, step)
        return archives.top_distinct(rows if state is None else state.select(seq, score, step).unionByName(rows), k, seq, score, step)

    return merge


def top_margin_merge(k: int, margin: str, *ties: str) -> Merge:
    def merge(state, batch):
        return archives.top_margin(batch if state is None else state.unionByName(batch), k, margin, *ties)

    return merge


def per_step_merge(k: int, score: str, *ties: str) -> Merge:
    """A step may come in several batches, so the ranks are taken anew over state and batch."""

    def merge(state, batch):
        return archives.per_step(batch if state is None else state.drop("rank").unionByName(batch), k, score, *ties)

    return merge


def budget_merge(capacity: int, signals: list[str], key: str = "row_id") -> Merge:
    def merge(state, batch):
        return archives.budget_merge(state, batch, capacity, signals, key)

    return merge


class Archive:
    """A merge and the folder that holds its versions."""

    def __init__(self, folder: str, merge: Merge):
        self.folder, self.merge = folder.rstrip("/"), merge

    def _path(self, version: int) -> str:
        return f"{self.folder}/version={version}"

    def _versions(self, spark) -> list[int]:
        root = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(self.folder)
        files = root.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        if not files.exists(root):
            return []
        names = [s.getPath().getName() for s in files.listStatus(root)]
        done = [int(n.split("=")[1]) for n in names if n.startswith("version=")]
        jvm_path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
        return sorted(v for v in done if files.exists(jvm_path(f"{self._path(v)}/_SUCCESS")))

    def apply(self, batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        before = [v for v in self._versions(spark) if v < batch_id]
        state = spark.read.parquet(self._path(before[-1])) if before else None
        self.merge(state, batch).write.mode("overwrite").parquet(self._path(batch_id))

    def read(self, spark) -> DataFrame:
        have = self._versions(spark)
        if not have:
            raise FileNotFoundError(self.folder)
        return spark.read.parquet(self._path(have[-1]))

    def start(self, stream: DataFrame, checkpoint: str) -> StreamingQuery:
        return stream.writeStream.foreachBatch(self.apply).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def hourly_counts(events: DataFrame, late: str = "2 hours") -> DataFrame:
    """Windowed counts and sums of an event stream, late rows dropped behind the watermark."""
    timed = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)
    return timed.groupBy(F.window("ts", "1 hour"), "event_type").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total"))
