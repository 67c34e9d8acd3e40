"""Listeners of event streams, runs of one or many spiders, and a set of seen keys that outlives runs."""

from __future__ import annotations

import logging
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from corpusmill.operators import stats
from corpusmill.streaming.events import run_available

Listener = Callable[[DataFrame, int], None]


class Listeners:
    """Functions of (events, batch number) that get every batch of a stream, in the order in which they were added."""

    def __init__(self):
        self.next, self.held = 0, {}

    def on(self, listener: Listener, *kinds: str) -> int:
        """Add a listener, of events of these types or of all; returns its number."""
        self.next += 1
        self.held[self.next] = (listener, kinds)
        return self.next

    def unsubscribe(self, number: int) -> bool:
        return self.held.pop(number, None) is not None

    def __call__(self, events: DataFrame, batch: int) -> None:
        for listener, kinds in list(self.held.values()):
            listener(events.filter(F.col("event_type").isin(*kinds)) if kinds else events, batch)


def logging_listener(log: logging.Logger | None = None) -> Listener:
    """Logs the number of events of each type of a batch."""
    log = log or logging.getLogger("corpusmill.events")

    def listen(events: DataFrame, batch: int) -> None:
        for r in events.groupBy("event_type").agg(F.count(F.lit(1)).alias("n")).orderBy("event_type").collect():
            log.info("batch %d: %d %s", batch, r.n, r.event_type)

    return listen


def metrics_listener(path: str) -> Listener:
    """Writes each batch's count by type below path; a batch that is repeated replaces its own counts. metrics_of() sums them."""

    def listen(events: DataFrame, batch: int) -> None:
        counts = events.groupBy("event_type").agg(F.count(F.lit(1)).alias("n"))
        counts.write.mode("overwrite").parquet(f"{path}/batch={batch}")

    return listen


def metrics_of(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path).groupBy("event_type").agg(F.sum("n").alias("n"))


def run_stream(events: DataFrame, checkpoint: str, path: str, listeners: Listeners | None = None) -> None:
    """Write the events that there are below path, a folder a batch, and tell the listeners; a restart goes on behind the last whole batch, and a
    batch that was broken off is written again in its place, so each event is there once."""

    def sink(df: DataFrame, batch: int) -> None:
        df.write.mode("overwrite").parquet(f"{path}/batch={batch}")
        if listeners:
            listeners(df.sparkSession.read.schema(df.schema).parquet(f"{path}/batch={batch}"), batch)

    run_available(events, checkpoint, sink)


def done(spark: SparkSession, path: str) -> DataFrame:
    """The last row of a run: its statistics."""
    return stats.crawl_stats(spark.read.parquet(path).drop("batch"))


def run_stream_many(streams: dict[str, DataFrame], checkpoint: str, path: str) -> DataFrame:
    """Run the stream of each spider and return their statistics, a row each; a spider without events has none."""
    for name, events in streams.items():
        run_stream(events, f"{checkpoint}/{name}", f"{path}/spider_name={name}")
    spark = next(iter(streams.values())).sparkSession
    return stats.crawl_stats(spark.read.parquet(path).drop("batch").withColumn("spider", F.col("spider_name")))


class SeenTable:
    """The first event of each key over all batches and runs. new_of(batch) gives the events whose key was in no earlier batch, and remembers them; a batch that is
    repeated gives the same ones again. With ttl_ms, keys older than that, by ts_ms against now, are forgotten."""

    def __init__(self, path: str, key: str = "url", order: str = "seq", ttl_ms: int | None = None):
        self.path, self.key, self.order, self.ttl_ms = path, key, order, ttl_ms

    def known(self, spark: SparkSession, before: int, now_ms: int | None = None) -> DataFrame:
        rows = spark.createDataFrame([], "k_ string, ts_ms long, batch int")
        try:
            rows = spark.read.schema("k_ string, ts_ms long, batch int").parquet(self.path)
        except Exception as e:  # noqa: BLE001
            if "PATH_NOT_FOUND" not in str(e):
                raise
        rows = rows.filter(F.col("batch") < before)
        return rows if self.ttl_ms is None or now_ms is None else rows.filter(F.col("ts_ms") + self.ttl_ms >= now_ms)

    def new_of(self, events: DataFrame, batch: int, now_ms: int | None = None) -> DataFrame:
        rest = [c for c in events.columns if c != self.key]
        first = events.groupBy(self.key).agg(F.min_by(F.struct(*rest), F.col(self.order)).alias("r_")).select(self.key, *[F.col(f"r_.`{c}`").alias(c) for c in rest])
        new = first.join(self.known(events.sparkSession, batch, now_ms).select("k_").distinct(), F.col(self.key).cast("string") == F.col("k_"), "left_anti").select(*events.columns)
        ts = F.col("ts_ms").cast("long") if "ts_ms" in events.columns else F.lit(0).cast("long")
        new.select(F.col(self.key).cast("string").alias("k_"), ts.alias("ts_ms")).write.mode("overwrite").parquet(f"{self.path}/batch={batch}")
        return new
