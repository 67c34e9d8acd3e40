"""Event streams: projections, stateful dedup, windows, and the autoscale decision replay."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from corpusmill.operators import scan


def event_source(spark: SparkSession, folder: str, schema, files_per_trigger: int = 8) -> DataFrame:
    """A stream over the Parquet files of a folder; several queries may read it, each with all events."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(folder)


def timed(events: DataFrame, ts_col: str = "ts", delay: str = "1 hour") -> DataFrame:
    """Events with a watermark; a timestamp without zone is taken as UTC."""
    return events.withColumn(ts_col, F.col(ts_col).cast("timestamp")).withWatermark(ts_col, delay)


def of_type(events: DataFrame, *kinds: str) -> DataFrame:
    return events.filter(F.col("event_type").isin(*kinds))


def typed_events(**sources: DataFrame) -> DataFrame:
    """Tables of different kinds of events as one table with event_type and nullable columns."""
    out = None
    for kind, df in sources.items():
        rows = df.withColumn("event_type", F.lit(kind))
        out = rows if out is None else out.unionByName(rows, allowMissingColumns=True)
    return out


def first_seen(events: DataFrame, keys: list[str]) -> DataFrame:
    """The first event of each key; in a stream, keys are remembered as long as the watermark holds them."""
    return events.dropDuplicatesWithinWatermark(keys) if events.isStreaming else events.dropDuplicates(keys)


def tumbling(events: DataFrame, size: str, *by: str, ts_col: str = "ts", value: str = "value") -> DataFrame:
    return _windowed(events, F.window(ts_col, size), by, value)


def sliding(events: DataFrame, size: str, slide: str, *by: str, ts_col: str = "ts", value: str = "value") -> DataFrame:
    return _windowed(events, F.window(ts_col, size, slide), by, value)


def sessions(events: DataFrame, gap: str, *by: str, ts_col: str = "ts", value: str = "value") -> DataFrame:
    return _windowed(events, F.session_window(ts_col, gap), by, value)


def _windowed(events: DataFrame, window: Column, by: tuple[str, ...], value: str) -> DataFrame:
    got = events.groupBy(window.alias("w"), *by).agg(F.count(F.lit(1)).alias("n"), F.sum(value).alias("total"))
    return got.select(F.col("w.start").alias("win_start"), F.col("w.end").alias("win_end"), *by, "n", "total")


def run_available(stream: DataFrame, checkpoint: str, sink: Callable[[DataFrame, int], None], mode: str = "append") -> None:
    """Process what there is, batch by batch, and stop; a restart goes on where the checkpoint ended."""
    stream.writeStream.outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(sink).start().awaitTermination()


def attempts(failures: DataFrame, key: str = "url", order: str = "seq", most: int = 3) -> DataFrame:
    """failures with the number of the attempt and whether it is tried again; a key of many failures is split."""
    n = scan.numbered(failures, [key], [order], "attempt")
    return n.withColumn("attempt", (F.col("attempt") + 1).cast("int")).withColumn("again", F.col("attempt") <= most)


def autoscale(samples: DataFrame, start: int, least: int, most: int, key: str = "spider", error_limit: float = 0.2, low: float = 0.7, high: float = 0.9, up: int = 2, down: int = 4, up_every_ms: int = 5000, down_every_ms: int = 2000) -> DataFrame:
    """key, ts_ms, target after each sample of (key, ts_ms, error_rate, saturation).

    Down by `down` when errors exceed the limit or saturation is below low; up by `up` when it is above high with less than half
    the limit of errors; each at most once in its interval, within least and most. A state machine per key, over its
    samples, of which there is one a second."""

    def replay(pdf: pd.DataFrame) -> pd.DataFrame:
        now, last_up, last_down, out = start, None, None, []
        for t, e, s in pdf.sort_values("ts_ms")[["ts_ms", "error_rate", "saturation"]].itertuples(index=False):
            if (e > error_limit or s < low) and (last_down is None or t - last_down >= down_every_ms):
                new = max(now - down, least)
                if new < now:
                    now, last_down = new, t
            if s > high and e < error_limit * 0.5 and (last_up is None or t - last_up >= up_every_ms):
                new = min(now + up, most)
                if new > now:
                    now, last_up = new, t
            out.append((pdf[key].iloc[0], t, now))
        return pd.DataFrame(out, columns=[key, "ts_ms", "target"])

    kind = dict(samples.dtypes)[key]
    return samples.groupBy(key).applyInPandas(replay, f"`{key}` {kind}, ts_ms long, target int")
