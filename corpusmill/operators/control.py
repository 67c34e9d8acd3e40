"""What stops, skips or repeats requests: control tables, request and item hooks, retries and recovery."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, functions as F

from corpusmill.operators import scan

PROCEED, SKIP, DELAY, ABORT = "proceed", "skip", "delay", "abort"


def control_filter(requests: DataFrame, control: DataFrame, key: str = "url") -> tuple[DataFrame, DataFrame]:
    """Requests that may go on, and those that wait as they are paused. control: url (null for all) and state, cancelled, paused or
    shutdown; a cancelled url is dropped, and after a shutdown nothing goes on or waits."""
    is_ = lambda state: F.col("state") == state
    named = control.filter("url is not null").groupBy(F.col("url").alias("c_url")).agg(F.bool_or(is_("cancelled")).alias("cancelled_"), F.bool_or(is_("paused")).alias("paused_"))
    everything = control.agg(F.bool_or(is_("shutdown")).alias("down_"), F.bool_or(is_("cancelled") & F.col("url").isNull()).alias("all_cancelled_"), F.bool_or(is_("paused") & F.col("url").isNull()).alias("all_paused_"))
    any_of = lambda *names: F.coalesce(F.greatest(*[F.coalesce(F.col(n), F.lit(False)) for n in names]), F.lit(False))
    marked = requests.join(named, F.col(key) == F.col("c_url"), "left").join(everything, F.lit(True))
    alive, waits = marked.filter(~any_of("down_", "all_cancelled_", "cancelled_")), any_of("all_paused_", "paused_")
    return alive.filter(~waits).select(*requests.columns), alive.filter(waits).select(*requests.columns)


def request_hook(requests: DataFrame, action: Column, delay_ms: Column | None = None, order: str = "seq") -> DataFrame:
    """Requests that the hook lets through, with delay_ms. action: proceed, skip, delay or abort; a null proceeds. An abort ends the
    run: neither that request nor any behind it goes on."""
    wait = F.lit(0).cast("long") if delay_ms is None else F.coalesce(delay_ms, F.lit(0)).cast("long")
    said = requests.withColumn("action_", F.coalesce(action, F.lit(PROCEED)))
    first = said.filter(F.col("action_") == ABORT).agg(F.min(order).alias("abort_"))
    kept = said.join(first, F.lit(True)).filter(F.col("abort_").isNull() | (F.col(order) < F.col("abort_")))
    kept = kept.filter(F.col("action_").isin(PROCEED, DELAY)).withColumn("delay_ms", F.when(F.col("action_") == DELAY, wait).otherwise(F.lit(0).cast("long")))
    return kept.drop("action_", "abort_")


def on_item(items: DataFrame, hook: Callable[[Column], Column]) -> DataFrame:
    """Items with hook(value) as their payload; where that is null the item is dropped."""
    return items.withColumn("value", hook(F.col("value"))).filter("value is not null")


def numbered_attempts(failures: DataFrame, key: str = "url", order: str = "seq", kind: str = "kind", retries: int = 3, refetches: int = 5) -> DataFrame:
    """failures with attempt, counted for each key and kind (retry or refetch) by itself, and again: whether it is tried once more. order tells failures apart;
    a key of many failures is split."""
    n = scan.numbered(failures, [key, kind], [order], "attempt")
    most = F.when(F.col(kind) == "refetch", refetches).otherwise(retries)
    return n.withColumn("attempt", (F.col("attempt") + 1).cast("int")).withColumn("again", F.col("attempt") <= most)


def recovery(failures: DataFrame, retries: int = 3) -> DataFrame:
    """failures with step: upgrade (mode auto, first failure, nothing learned for it yet), else retry (retryable, below the limit), else fail.
    failures: mode, attempt, learned, retryable."""
    upgrade = (F.col("mode") == "auto") & (F.col("attempt") == 1) & ~F.coalesce("learned", F.lit(False))
    retry = F.coalesce("retryable", F.lit(False)) & (F.col("attempt") <= retries)
    return failures.withColumn("step", F.when(upgrade, "upgrade").when(retry, "retry").otherwise("fail"))
