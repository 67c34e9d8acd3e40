"""Running sums and maxima in an order, of which a key's rows may be more than one task should hold.

Rows are sorted into ranges of (key, order). A key's ranges give one row of totals each, over which offsets run; inside a range the
counts run from there. So no task holds a key, only a range, and what runs over all of a key is as many rows as it has ranges.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from corpusmill.sources.shared import written


def running(rows: DataFrame, keys: list[str], order: list[str], sums: dict[str, Column] | None = None, maxima: dict[str, Column] | None = None) -> DataFrame:
    """rows with a column for each name: the sum (0 if there is none), or the maximum (null if there is none), of its expression over the rows of the same key that come before, not counting the row
    itself. Rows of equal key and order are in no fixed order among themselves, so order should tell rows apart. Null keys are a key; rows are all kept."""
    sums, maxima = sums or {}, maxima or {}
    held = rows.withColumns({f"_v_{n}": e for n, e in (sums | maxima).items()})
    ranged = written(held.repartitionByRange(*keys, *order).withColumn("_part", F.spark_partition_id()), "ranges")
    total = lambda n: F.sum(f"_v_{n}") if n in sums else F.max(f"_v_{n}")
    names = [*sums, *maxima]
    blocks = ranged.groupBy(*keys, "_part").agg(*[total(n).alias(f"_t_{n}") for n in names])
    before = Window.partitionBy(*keys).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    over = lambda n, column, w: (F.sum(column) if n in sums else F.max(column)).over(w)
    offsets = blocks.select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)], F.col("_part").alias("_p"), *[over(n, f"_t_{n}", before).alias(f"_o_{n}") for n in names])
    inside = Window.partitionBy(*keys, "_part").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    counted = ranged.withColumns({f"_i_{n}": over(n, f"_v_{n}", inside) for n in names})
    same = F.col("_part") == F.col("_p")
    for i, k in enumerate(keys):
        same &= F.col(k).eqNullSafe(F.col(f"_k{i}"))
    out = counted.join(offsets, same)
    zero = lambda c: F.coalesce(F.col(c), F.lit(0))
    found = {n: zero(f"_o_{n}") + zero(f"_i_{n}") for n in sums} | {n: F.greatest(f"_o_{n}", f"_i_{n}") for n in maxima}
    return out.select(*rows.columns, *[e.alias(n) for n, e in found.items()])


def numbered(rows: DataFrame, keys: list[str], order: list[str], name: str = "place") -> DataFrame:
    """rows with their place among those of their key, from 0."""
    return running(rows, keys, order, {name: F.lit(1).cast("long")})


def paced(rows: DataFrame, keys: list[str], order: list[str], arrival: str, gap: int, burst: int = 1, out: str = "starts") -> DataFrame:
    """rows with the time at which each may start, at or after its arrival: of each key, burst at once after a pause, and on average one in gap.

    A token bucket: the i-th request of a key moves the bucket's time t to max(t, a_i) + gap, and starts at max(a_i, t - (burst - 1) * gap).
    Each step is a shift and a floor, x -> max(x + gap, a_i + gap), and such steps combine into steps of the same kind: t before the i-th
    is gap * i + max over j < i of (a_j - gap * j). So places and a running maximum suffice, and hot keys are split. Rows whose arrival is null start at no
    time and hold up none."""
    at = F.col(arrival)
    placed = running(rows, keys, order, {"_i": F.when(at.isNotNull(), 1).otherwise(0).cast("long")})
    held = running(placed, keys, order, maxima={"_m": at - gap * F.col("_i")})
    t = F.col("_m") + gap * F.col("_i")
    return held.withColumn(out, F.when(at.isNotNull(), F.greatest(at, t - (burst - 1) * gap))).drop("_i", "_m")
