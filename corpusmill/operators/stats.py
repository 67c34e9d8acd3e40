"""Crawl statistics, and stop conditions as predicates over running counts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from corpusmill.operators import scan


def crawl_stats(events: DataFrame) -> DataFrame:
    """Per spider: items, pages, errors, blocked, retries, offsite, cache_hits, duration_ms. Pages from the cache are no pages.
    events: spider, event_type, from_cache, ts_ms."""
    n = lambda kind: F.count_if((F.col("event_type") == kind))
    cached = F.coalesce("from_cache", F.lit(False))
    return events.groupBy("spider").agg(n("item").alias("items"), F.count_if((F.col("event_type") == "page") & ~cached).alias("pages"), n("error").alias("errors"), n("blocked").alias("blocked"), n("retry").alias("retries"), n("offsite").alias("offsite"), F.count_if((F.col("event_type") == "page") & cached).alias("cache_hits"), (F.max("ts_ms") - F.min("ts_ms")).alias("duration_ms"))


def histogram(rows: DataFrame, by: Column, name: str, keys: tuple[str, ...] = ("spider",)) -> DataFrame:
    return rows.groupBy(*keys, by.alias(name)).agg(F.count(F.lit(1)).alias("n"))


def histogram_map(rows: DataFrame, by: Column, name: str, keys: tuple[str, ...] = ("spider",)) -> DataFrame:
    """The histogram as one map a key; as many entries as there are values of `by`."""
    return histogram(rows, by, "k_", keys).groupBy(*keys).agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("k_", "n")))).alias(name))


def metrics(responses: DataFrame) -> DataFrame:
    """responses, errors, cache_hits, elapsed_ms and its integer average. responses: elapsed_ms, from_cache, error."""
    got = responses.agg(F.count(F.lit(1)).alias("responses"), F.count_if(F.col("error").isNotNull()).alias("errors"), F.count_if("from_cache").alias("cache_hits"), F.coalesce(F.sum("elapsed_ms"), F.lit(0)).alias("elapsed_ms"))
    return got.withColumn("avg_ms", F.when(F.col("responses") > 0, F.expr("elapsed_ms div responses")).otherwise(F.lit(0).cast("long")))


def totals(stats: DataFrame, *counts: str) -> DataFrame:
    """Sums over all spiders: of pages, or of the counts that are named."""
    return stats.agg(*[F.coalesce(F.sum(c), F.lit(0)).cast("long").alias(c) for c in counts or ("pages",)])


def item_counts(items: DataFrame, *members: str) -> DataFrame:
    """items and, for each member of the payload that is named, the number of its distinct values as distinct_<member>."""
    of = lambda m: F.count_distinct(F.get_json_object("value", f"$.{m}")).alias(f"distinct_{m}")
    return items.agg(F.count(F.lit(1)).alias("items"), *[of(m) for m in members])


def hot_frames(samples: DataFrame, n: int = 40, by: tuple[str, ...] = ("leaf",), process: str | None = None) -> DataFrame:
    """The n heaviest leaf frames (or stacks, or frames by thread): by, weight, percent of all weight. samples: process, thread, stack (array of frames,
    the leaf last, or null), weight. Samples without a stack count for the whole only."""
    rows = samples if process is None else samples.filter(F.contains(F.coalesce("process", F.lit("")), F.lit(process)))
    rows = rows.withColumn("leaf", F.try_element_at("stack", F.lit(-1)))
    whole = rows.agg(F.sum("weight").alias("whole_"))
    top = rows.filter("stack is not null").groupBy(*by).agg(F.sum("weight").alias("weight")).orderBy(F.desc("weight"), *by).limit(n)
    return top.join(whole, F.lit(True)).select(*by, "weight", (100 * F.try_divide("weight", "whole_")).alias("percent"))


def error_rates(samples: DataFrame, key: str = "spider") -> DataFrame:
    """samples (key, seq, pages, errors, in_flight, current) with error_rate since the sample before and saturation; 0 where nothing happened.
    pages and errors are counts so far, so that those of the sample before are the largest before."""
    samples = scan.running(samples, [key], ["seq"], maxima={"pages_": F.col("pages"), "errors_": F.col("errors")})
    d = lambda c: F.col(c) - F.coalesce(F.col(f"{c}_"), F.lit(0))
    rate = F.coalesce(F.try_divide(d("errors"), d("pages") + d("errors")), F.lit(0.0))
    return samples.withColumns({"error_rate": rate, "saturation": F.coalesce(F.try_divide(F.col("in_flight"), F.col("current")), F.lit(0.0))}).drop("pages_", "errors_")


class Stop:
    """A stop condition: a column over rows with counts so far (pages, items, errors, by callback), and elapsed_ms."""

    def __init__(self, column: Column):
        self.column = column

    def __and__(self, other: Stop) -> Stop:
        return Stop(self.column & other.column)

    def __or__(self, other: Stop) -> Stop:
        return Stop(self.column | other.column)

    def __invert__(self) -> Stop:
        return Stop(~self.column)


def max_pages(n: int) -> Stop:
    return Stop(F.col("pages_") >= n)


def max_items(n: int) -> Stop:
    return Stop(F.col("items_") >= n)


def max_errors(n: int) -> Stop:
    return Stop(F.col("errors_") >= n)


def max_pages_by_callback(n: int) -> Stop:
    """For the row's own callback."""
    return Stop(F.col("callback_pages_") >= n)


def timeout(ms: int) -> Stop:
    return Stop(F.col("elapsed_") >= ms)


def never() -> Stop:
    return Stop(F.lit(False))


def dispatched(events: DataFrame, stop: Stop, spider: str = "spider", seq: str = "seq", callback: str = "callback", ts_ms: str = "ts_ms") -> DataFrame:
    """The page rows at whose turn the condition did not hold, counts being those of the rows before them.

    events: event_type page, item or error, and seq, which tells a spider's rows apart. Counts run over ranges of a spider's rows, and of a callback's, so that a spider
    that has all rows is split (see scan.running)."""
    one = lambda kind: F.when(F.col("event_type") == kind, 1).otherwise(0).cast("long")
    counted = scan.running(events, [spider], [seq], {"pages_": one("page"), "items_": one("item"), "errors_": one("error")})
    counted = scan.running(counted, [spider, callback], [seq], {"callback_pages_": one("page")})
    begins = events.groupBy(F.col(spider).alias("of_")).agg(F.min(ts_ms).alias("begin_"))
    counted = counted.join(begins, F.col(spider).eqNullSafe(F.col("of_"))).withColumn("elapsed_", F.col(ts_ms) - F.col("begin_"))
    return counted.filter((F.col("event_type") == "page") & ~stop.column).select(*events.columns)
