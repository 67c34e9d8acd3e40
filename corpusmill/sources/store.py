"""Readers: tables of a scale folder, the response cache, a key-value table with time to live, checkpoints of a crawl."""

from __future__ import annotations

import warnings

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from corpusmill.functions import urls as U
from corpusmill.operators.frontier import latest
from corpusmill.operators.rules import live
from corpusmill.sources.shared import written

KV = "namespace string, key string, value binary, ttl_secs long, cached_at long"


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def responses(pages: DataFrame, body_limit: int = 64 << 20, html_col: str = "html") -> DataFrame:
    """Stored pages as responses; a body above the limit is null, and error says so."""
    large = F.octet_length(html_col) > body_limit
    error = F.when(large, F.format_string(f"body of %d bytes, more than {body_limit}", F.octet_length(html_col)))
    return pages.withColumn("error", error).withColumn(html_col, F.when(F.coalesce(~large, F.lit(True)), F.col(html_col)))


def one_page(pages: DataFrame, html_col: str = "html", url_col: str = "url", keep: tuple[str, ...] = ()) -> DataFrame:
    """url, title, html and bytes of pages whose url may be fetched, and the columns in keep."""
    title = F.regexp_extract(html_col, "(?is)<title[^>]*>(.*?)</title>", 1)
    return pages.filter(U.valid_url(F.col(url_col))).select(*keep, url_col, title.alias("title"), html_col, F.octet_length(html_col).alias("bytes"))


def cache_key(method: Column, url: Column) -> Column:
    return F.concat_ws("|", method, url)


def with_cache(requests: DataFrame, cache: DataFrame, now: int) -> tuple[DataFrame, DataFrame]:
    """Requests answered by the cache (marked from_cache, with its columns) and the others. cache: method, url, cached_at, ttl_secs, ...; of several entries
    for one method and url the latest counts, so a request is in one of the two results, once."""
    keys = ["method", "url"]
    order = F.struct("cached_at", F.col("ttl_secs").isNull(), "ttl_secs")  # of one time the longest-lived
    c = latest(cache.withColumn("o_", order), keys, "o_").drop("o_").filter(live(F.col("cached_at"), F.col("ttl_secs"), F.lit(now)))
    return requests.join(c, keys).withColumn("from_cache", F.lit(True)), requests.join(c.select(keys), keys, "left_anti")


def cacheable(answers: DataFrame, now: int, ttl: int | None = 300) -> DataFrame:
    """The cache rows of fresh answers of status 200 to 399, the latest for each method and url."""
    rows = answers.filter((F.col("status") >= 200) & (F.col("status") < 400) & ~F.coalesce("from_cache", F.lit(False)))
    rows = rows.withColumns({"cached_at": F.lit(now).cast("long"), "ttl_secs": F.lit(ttl).cast("long")})
    return latest(rows, ["method", "url"], "seq")


class KeyValue:
    """A key-value table of Parquet files by namespace; each write appends, and the latest entry of a key counts."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    def _rows(self) -> DataFrame:
        try:
            return self.spark.read.schema(KV + ", version long, deleted boolean").parquet(self.path)
        except Exception as e:  # noqa: BLE001
            if "PATH_NOT_FOUND" not in str(e):
                raise
            return self.spark.createDataFrame([], KV + ", version long, deleted boolean")

    def _append(self, rows: DataFrame, deleted: bool, version: int) -> None:
        rows.withColumns({"version": F.lit(version).cast("long"), "deleted": F.lit(deleted)}).write.mode("append").partitionBy("namespace").parquet(self.path)

    def set(self, rows: DataFrame, now: int, version: int) -> None:
        """rows: namespace, key, value and ttl_secs or none."""
        ttl = F.col("ttl_secs") if "ttl_secs" in rows.columns else F.lit(None)
        self._append(rows.select("namespace", "key", F.col("value").cast("binary").alias("value"), ttl.cast("long").alias("ttl_secs"), F.lit(now).cast("long").alias("cached_at")), False, version)

    def delete(self, keys: DataFrame, version: int) -> None:
        self._append(keys.select("namespace", "key", F.lit(None).cast("binary").alias("value"), F.lit(None).cast("long").alias("ttl_secs"), F.lit(None).cast("long").alias("cached_at")), True, version)

    def get(self, now: int, namespace: str | None = None, key: str | None = None) -> DataFrame:
        """Entries that live at `now`; the namespace prunes folders."""
        rows = self._rows()
        rows = rows if namespace is None else rows.filter(F.col("namespace") == namespace)
        rows = rows if key is None else rows.filter(F.col("key") == key)
        now_rows = latest(rows, ["namespace", "key"], "version")
        return now_rows.filter(~F.col("deleted") & live(F.col("cached_at"), F.col("ttl_secs"), F.lit(now))).drop("version", "deleted")


class Checkpoint:
    """pending, seen and stats of a crawl as tables in one folder per version; the newest complete one counts."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    def _fs(self):
        p = self.spark._jvm.org.apache.hadoop.fs.Path(self.path)
        return p, p.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def due(self, pages: int, interval: int = 100) -> bool:
        return pages > 0 and pages % interval == 0

    def write(self, version: int, **tables: DataFrame) -> None:
        for name, df in tables.items():
            df.write.mode("overwrite").parquet(f"{self.path}/v{version:09d}/{name}")
        self.spark.range(1).write.mode("overwrite").parquet(f"{self.path}/v{version:09d}/complete")

    def read(self) -> dict[str, DataFrame] | None:
        """The newest version whose tables can all be read; none if there is none. A damaged one is skipped with a warning."""
        p, fs = self._fs()
        if not fs.exists(p):
            return None
        for folder in sorted((s.getPath().toString() for s in fs.listStatus(p)), reverse=True):
            sub = self.spark._jvm.org.apache.hadoop.fs.Path(folder)
            names = [s.getPath().getName() for s in fs.listStatus(sub)]
            if "complete" not in names:
                continue
            try:
                tables = {n: self.spark.read.parquet(f"{folder}/{n}") for n in names if n != "complete"}
                for t in tables.values():
                    t.write.format("noop").mode("overwrite").save()
                return tables
            except Exception as e:  # noqa: BLE001
                warnings.warn(f"checkpoint {folder} is damaged: {str(e)[:200]}", stacklevel=2)
        return None

    def delete(self) -> None:
        p, fs = self._fs()
        fs.delete(p, True)


class MemoryStore:
    """Entries that live with the session, the latest of each key, and at most `capacity` of them: the oldest go first. For small tables; each
    write makes a new one from the one before."""

    def __init__(self, spark: SparkSession, capacity: int = 100_000):
        self.spark, self.capacity = spark, capacity
        self.rows = spark.createDataFrame([], KV + ", version long")

    def set(self, rows: DataFrame, now: int, version: int) -> None:
        ttl = F.col("ttl_secs") if "ttl_secs" in rows.columns else F.lit(None)
        new = rows.select("namespace", "key", F.col("value").cast("binary").alias("value"), ttl.cast("long").alias("ttl_secs"), F.lit(now).cast("long").alias("cached_at"), F.lit(version).cast("long").alias("version"))
        self.rows = written(evicted(latest(self.rows.union(new), ["namespace", "key"], "version"), self.capacity), "memory-store")

    def delete(self, keys: DataFrame, version: int) -> None:
        self.rows = written(self.rows.join(keys.select("namespace", "key"), ["namespace", "key"], "left_anti"), "memory-store")

    def get(self, now: int, namespace: str | None = None, key: str | None = None) -> DataFrame:
        rows = self.rows if namespace is None else self.rows.filter(F.col("namespace") == namespace)
        rows = rows if key is None else rows.filter(F.col("key") == key)
        return rows.filter(live(F.col("cached_at"), F.col("ttl_secs"), F.lit(now))).drop("version")


def evicted(rows: DataFrame, capacity: int = 100_000) -> DataFrame:
    """The `capacity` entries that were written last; of one moment those of later keys go first."""
    return rows.orderBy(F.desc("cached_at"), F.desc("version"), "namespace", "key").limit(capacity)


def open_store(spark: SparkSession, path: str = "") -> KeyValue | MemoryStore:
    """A store for the session where path is empty or :memory:, else one of Parquet files in that folder."""
    return MemoryStore(spark) if path in ("", ":memory:") else KeyValue(spark, path)
