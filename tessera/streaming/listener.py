"""Progress of streaming queries as rows, instead of pushing samples to each listener."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQueryListener


class ProgressLog(StreamingQueryListener):
    """Keeps the last `most` progress reports of the session's streams, and how each stream ended."""

    def __init__(self, spark: SparkSession, most: int = 10_000):
        self.spark, self.most, self.rows, self.ends = spark, most, [], {}

    def onQueryStarted(self, event) -> None:
        self.ends[str(event.id)] = "running"

    def onQueryProgress(self, event) -> None:
        p = event.progress
        self.rows.append((str(p.id), int(p.batchId), p.timestamp, int(p.numInputRows), float(p.inputRowsPerSecond or 0), float(p.processedRowsPerSecond or 0), int(p.batchDuration)))
        del self.rows[: -self.most]

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        self.ends[str(event.id)] = "error" if event.exception else "completed"

    def table(self) -> DataFrame:
        """(id, batch, at, rows, rows_in_per_s, rows_done_per_s, duration_ms)."""
        return self.spark.createDataFrame(self.rows, "id string, batch long, at string, rows long, rows_in_per_s double, rows_done_per_s double, duration_ms long")
