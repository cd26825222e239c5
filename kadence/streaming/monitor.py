"""Liveness and progress of running queries, kept as rows instead of behind a port."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQueryListener

SCHEMA = "query string, event string, epoch_id bigint, input_rows bigint, at string"
LOADS = "query string, epoch_id bigint, at string, duration_ms bigint, lag bigint"


class Heartbeat(StreamingQueryListener):
    """Knows which queries are alive, and keeps every event.

    Events wait in memory until ``flush`` appends them to the table at ``path``; it runs by itself
    with each progress that finds ``flush_every`` of them, so what waits stays small.
    """

    def __init__(self, spark: SparkSession, path: str, flush_every: int = 1_000):
        self.spark, self.path, self.flush_every = spark, path, flush_every
        self.alive: dict[str, bool] = {}
        self.names: dict[str, str] = {}
        self.events: list[tuple] = []
        self.loads: list[tuple] = []

    def flush(self) -> None:
        waiting, self.events = self.events, []
        if waiting:
            frame = self.spark.createDataFrame(waiting, SCHEMA).coalesce(1)
            try:
                frame.write.mode("append").parquet(self.path)
            except Exception:
                self.events = waiting + self.events
                raise
        waiting, self.loads = self.loads, []
        if waiting:
            frame = self.spark.createDataFrame(waiting, LOADS).coalesce(1)
            try:
                frame.write.mode("append").parquet(f"{self.path}_loads")
            except Exception:
                self.loads = waiting + self.loads
                raise

    def onQueryStarted(self, event):
        query = event.name or str(event.id)
        self.names[str(event.id)] = query
        self.alive[query] = True
        self.events.append((query, "started", None, None, event.timestamp))

    def onQueryProgress(self, event):
        p = event.progress
        query = p.name or str(p.id)
        self.alive[query] = True
        self.events.append((query, "progress", p.batchId, p.numInputRows, p.timestamp))
        took = (p.durationMs or {}).get("triggerExecution")
        # Records of the topic that no batch has taken yet, where the source tells.
        behind = [s.metrics["maxOffsetsBehindLatest"] for s in p.sources if "maxOffsetsBehindLatest" in (s.metrics or {})]
        lag = max(int(float(b)) for b in behind) if behind else None
        self.loads.append((query, p.batchId, p.timestamp, took, lag))
        if len(self.events) >= self.flush_every:
            self.flush()

    def onQueryIdle(self, event):
        self.events.append(
            (self.names.get(str(event.id), str(event.id)), "idle", None, None, event.timestamp)
        )

    def onQueryTerminated(self, event):
        query = self.names.get(str(event.id), str(event.id))
        self.alive[query] = False
        self.events.append((query, "failed" if event.exception else "ended", None, None, None))

    def rows(self) -> DataFrame:
        """All events so far."""
        self.flush()
        return self.spark.read.schema(SCHEMA).parquet(self.path)

    def durations(self) -> DataFrame:
        """Duration and lag of every batch so far."""
        self.flush()
        return self.spark.read.schema(LOADS).parquet(f"{self.path}_loads")


#: Accuracy of a sketch: ranks are met within about 1.3 %.
K = 200


def hourly_sketches(measured: DataFrame, by: list[str], at: Column, value: str, k: int = K) -> DataFrame:
    """``by, hour, sketch, n``: a mergeable quantile sketch of ``value`` per hour, of bounded size each."""
    hour = F.date_trunc("hour", at).alias("hour")
    known = measured.where(F.col(value).isNotNull())
    return known.groupBy(*by, hour).agg(
        F.kll_sketch_agg_double(F.col(value).cast("double"), k).alias("sketch"), F.count("*").alias("n")
    )


def merged_quantiles(hours: DataFrame, by: list[str], shares: list[float], k: int = K) -> DataFrame:
    """``by, n, quantiles`` of all values behind some hours' sketches; the values themselves are not needed."""
    merged = hours.groupBy(*by).agg(F.kll_merge_agg_double("sketch", k).alias("sketch"), F.sum("n").alias("n"))
    asked = F.array(*(F.lit(s) for s in shares))
    return merged.select(*by, "n", F.kll_sketch_get_quantile_double("sketch", asked).alias("quantiles"))
