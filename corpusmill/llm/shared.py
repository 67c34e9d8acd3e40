"""Tables written to the folder that the driver and all executors share, and checks of columns."""

from __future__ import annotations

from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from corpusmill.sources.shared import discard, free_prefix, new_path, shared_dir, without, written

__all__ = ["arrow_rows", "discard", "free_prefix", "need", "new_path", "perhaps", "shared_dir", "without", "written"]


def need(df: DataFrame, *columns: str) -> None:
    missing = [c for c in columns if c not in df.columns]
    if missing:
        raise ValueError(f"columns {missing} are missing; there are {df.columns}")


@contextmanager
def arrow_rows(spark: SparkSession, most: int):
    """For actions within: at most so many rows at once go to a Python worker, whose memory they take."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, most)
    try:
        yield
    finally:
        spark.conf.set(name, before)


def perhaps(rows: DataFrame, key: Column, keys: DataFrame, most: int = 1 << 24) -> DataFrame:
    """rows with a column `perhaps`: true where key (a 64-bit hash) is in keys (a table of one column, key), and for one in a thousand of
    the others, so that only what is true must be shuffled to be held against the keys themselves. What is broadcast are 16 bits of each
    key in arrays of some 64, about three bytes a key. With more than `most` keys nothing is broadcast and all rows are true."""
    count = keys.count()
    if count > most:
        return rows.withColumn("perhaps", F.lit(True))
    place, bits = (lambda k: F.pmod(k, F.lit(count // 64 + 1))), (lambda k: F.shiftright(k, 48).cast("short"))
    held = keys.groupBy(place(F.col("key")).alias("place_")).agg(F.collect_set(bits(F.col("key"))).alias("held_"))
    met = rows.join(F.broadcast(held), place(key) == F.col("place_"), "left")
    return met.withColumn("perhaps", F.coalesce(F.array_contains("held_", bits(key)), F.lit(False))).drop("place_", "held_")
