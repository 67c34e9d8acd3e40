"""A priority frontier and a set of seen urls as tables in the shared folder, of which an operation reads the parts that it needs.

The frontier lies in a directory for each priority, in order of arrival, and a small table says how many requests each directory has got and how many of
them have been taken: a pop reads the directories of the highest priorities that hold enough, and no other. The seen set lies in directories by hash of
the url, each with a Bloom filter beside it: urls that a filter does not know are new, and only the others are held against the table.
"""

from __future__ import annotations

import shutil
import tempfile
import uuid
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from corpusmill.operators.frontier import placed
from corpusmill.sources.shared import new_path, written


class _Versions:
    """Small tables, of which the last one that was written whole counts; a write that is broken off leaves the one before."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    def _all(self) -> list[int]:
        jvm = self.spark._jvm
        root = jvm.org.apache.hadoop.fs.Path(self.path)
        fs = root.getFileSystem(self.spark._jsc.hadoopConfiguration())
        if not fs.exists(root):
            return []
        return sorted(int(x.getPath().getName()[1:]) for x in fs.listStatus(root) if fs.exists(jvm.org.apache.hadoop.fs.Path(x.getPath(), "_SUCCESS")))

    def read(self) -> DataFrame | None:
        found = self._all()
        return self.spark.read.parquet(f"{self.path}/v{found[-1]}") if found else None

    def write(self, rows: DataFrame) -> None:
        n = (self._all() or [0])[-1] + 1
        rows.coalesce(1).write.mode("overwrite").parquet(f"{self.path}/v{n}")


class PriorityFrontier:
    """Requests that wait, highest priority first, and first come first among equals. One writer at a time.

    Priorities are whole numbers of which there are few (as depths are): each has a directory. All columns of the requests are kept, but seq and priority
    are ours: seq is the place of arrival."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path, self.counts = spark, path, _Versions(spark, f"{path}/counts")

    def _counts(self) -> dict[int, tuple[int, int, list[str]]]:
        """Per priority the requests that came, the seq up to which they have been taken (-1: none), and the directories of its pushes."""
        rows = self.counts.read()
        return {} if rows is None else {r.priority: (r.n, r.taken, list(r.parts)) for r in rows.collect()}

    def _put(self, counts: dict) -> None:
        self.counts.write(self.spark.createDataFrame([(p, n, t, d) for p, (n, t, d) in counts.items()], "priority int, n long, taken long, parts array<string>"))

    def push(self, requests: DataFrame, order: str = "seq") -> None:
        """Append requests (priority, null: 0) in the order of a column; an empty push changes nothing."""
        counts = self._counts()
        base = 1 + max((s for _, _, parts in counts.values() for s in (int(x.rsplit("-", 1)[1]) for x in parts)), default=-1)
        rows = placed(requests.withColumn("priority", F.coalesce(F.col("priority").cast("int"), F.lit(0))), F.asc(order))
        rows = rows.withColumn("seq", F.col("place") + base).drop("place").withColumn("of_", F.col("priority"))
        name = f"push-{uuid.uuid4().hex}"
        rows.repartition("of_").sortWithinPartitions("of_", "seq").write.partitionBy("of_").parquet(f"{self.path}/{name}")
        came = self.spark.read.parquet(f"{self.path}/{name}").groupBy("of_").agg(F.count(F.lit(1)).alias("n"), F.max("seq").alias("last")).collect() if not rows.isEmpty() else []
        for r in came:
            n, taken, parts = counts.get(r.of_, (0, -1, []))
            counts[r.of_] = (n + r.n, taken, [*parts, f"{name}/of_={r.of_}-{r['last']}"])
        if came:
            self._put(counts)

    def _read(self, priorities: list[int], counts: dict) -> DataFrame | None:
        """Requests of these priorities that have not been taken; other directories are not read."""
        got = None
        for p in priorities:
            _, taken, parts = counts[p]
            names = [f"{self.path}/{x.rsplit('-', 1)[0]}" for x in parts if int(x.rsplit("-", 1)[1]) > taken]
            if names:
                rows = self.spark.read.parquet(*names).filter(F.col("seq") > taken)
                got = rows if got is None else got.unionByName(rows, allowMissingColumns=True)
        return got

    def pending(self) -> DataFrame | None:
        counts = self._counts()
        return self._read(list(counts), counts)

    def __len__(self) -> int:
        rows = self.pending()
        return 0 if rows is None else rows.count()

    def plan(self, k: int) -> list[int]:
        """The priorities that a pop of k reads: the highest ones that have k requests, counted by what came and was taken."""
        counts, found, out = self._counts(), 0, []
        for p in sorted(counts, reverse=True):
            if found >= k:
                break
            left = self._left(p, counts)
            if left:
                out.append(p)
                found += left
        return out

    def _left(self, p: int, counts: dict) -> int:
        n, taken, parts = counts[p]
        if taken < 0:
            return n
        rows = self._read([p], counts)
        return 0 if rows is None else rows.count()

    def pop(self, k: int) -> DataFrame | None:
        """Take the k requests of highest priority, first come first among equals; None if there are none."""
        counts = self._counts()
        rows = self._read(self.plan(k), counts)
        if rows is None:
            return None
        got = written(rows.orderBy(F.desc("priority"), "seq").limit(k), "popped")
        for r in got.groupBy("priority").agg(F.max("seq").alias("last")).collect():
            n, _, parts = counts[r.priority]
            counts[r.priority] = (n, r["last"], parts)
        self._put(counts)
        return got

    def compact(self) -> None:
        """Write what waits anew, without what has been taken, one directory a priority."""
        counts, fresh, name = self._counts(), {}, f"push-{uuid.uuid4().hex}"
        rows = self._read(list(counts), counts)
        if rows is not None:
            rows = rows.withColumn("of_", F.col("priority"))
            rows.repartition("of_").sortWithinPartitions("of_", "seq").write.partitionBy("of_").parquet(f"{self.path}/{name}")
            for r in self.spark.read.parquet(f"{self.path}/{name}").groupBy("of_").agg(F.count(F.lit(1)).alias("n"), F.max("seq").alias("last")).collect():
                fresh[r.of_] = (r.n, -1, [f"{name}/of_={r.of_}-{r['last']}"])
        self._put(fresh)


# ---- seen urls


@lru_cache(maxsize=4096)
def _bits(file: str) -> np.ndarray:
    """A filter in a memory map; from a store that is no local folder it is copied into a file without a name first."""
    fs, path = pafs.FileSystem.from_uri(file)
    if isinstance(fs, pafs.LocalFileSystem):
        return np.memmap(path, np.uint8, "r")
    with tempfile.TemporaryFile() as copy, fs.open_input_stream(path) as stream:
        shutil.copyfileobj(stream, copy)
        copy.flush()
        return np.memmap(copy, np.uint8, "r")


def _places(a: np.ndarray, b: np.ndarray, hashes: int, bits: int) -> np.ndarray:
    """Bit places of urls by their two hashes, a row each."""
    steps = np.arange(hashes, dtype=np.uint64)
    return (a.astype(np.uint64)[:, None] + steps * (b.astype(np.uint64)[:, None] | np.uint64(1))) % np.uint64(bits)


class SeenSet:
    """Urls that have been pushed, exactly. expected: about how many there will be; more only make more urls be looked up in the table. One writer at a time."""

    def __init__(self, spark: SparkSession, path: str, expected: int = 1_000_000, bits_per_url: int = 10, hashes: int = 5, urls_per_bucket: int = 1 << 18):
        self.spark, self.path, self.hashes = spark, path, hashes
        self.buckets = max(8, -(-expected // urls_per_bucket))
        self.bytes = max(64, -(-expected * bits_per_url // self.buckets // 8))
        self.filters = _Versions(spark, f"{path}/filters")

    def _bucket(self, url: Column) -> Column:
        return F.pmod(F.xxhash64(url), F.lit(self.buckets)).cast("int")

    def _files(self) -> dict[int, str]:
        rows = self.filters.read()
        return {} if rows is None else {r.bucket: r.file for r in rows.collect()}

    def maybe(self, requests: DataFrame, url_col: str = "url", out: str = "maybe") -> DataFrame:
        """requests with whether the filters know the url: false only if it has not been seen."""
        files, hashes, bits_ = self._files(), self.hashes, 8 * self.bytes

        @F.pandas_udf("boolean")
        def known(bucket: pd.Series, a: pd.Series, b: pd.Series) -> pd.Series:
            hit = np.zeros(len(bucket), bool)
            at = _places(a.to_numpy(), b.to_numpy(), hashes, bits_)
            of = bucket.to_numpy()
            for k in np.unique(of).tolist():
                if k in files:
                    rows, bits = np.flatnonzero(of == k), _bits(files[k])
                    p = at[rows]
                    hit[rows] = (bits[p >> np.uint64(3)] >> (p & np.uint64(7)).astype(np.uint8) & 1).all(1)
            return pd.Series(hit)

        url = F.col(url_col).cast("string")
        return requests.withColumn(out, known(self._bucket(url), F.xxhash64(url, F.lit(1)), F.xxhash64(url, F.lit(2))))

    def new_of(self, requests: DataFrame, url_col: str = "url") -> DataFrame:
        """The requests whose url has not been seen, all of them if several have it. Only urls that a filter knows are joined with the table."""
        marked = written(self.maybe(requests, url_col, "maybe_"), "maybe-seen")
        new = marked.filter("not maybe_").drop("maybe_")
        again = marked.filter("maybe_").drop("maybe_")
        table = self.urls()
        if table is not None:
            again = again.join(table.select(F.col("url").alias("s_url")), F.col(url_col).cast("string") == F.col("s_url"), "left_anti")
        return new.unionByName(again)

    def urls(self) -> DataFrame | None:
        rows = self.filters.read()
        parts = sorted({p for r in ([] if rows is None else rows.select("parts").collect()) for p in r.parts})
        return self.spark.read.parquet(*[f"{self.path}/{p}" for p in parts]).select("url") if parts else None

    def add(self, urls: DataFrame, url_col: str = "url") -> None:
        """Remember urls, which may hold some that are known. Filters are written anew where urls were added, from the hashes of these alone."""
        old, size, hashes = self._files(), self.bytes, self.hashes
        before = self.filters.read()
        parts = sorted({p for r in ([] if before is None else before.select("parts").collect()) for p in r.parts})
        url = F.col(url_col).cast("string")
        name, folder = f"urls-{uuid.uuid4().hex}", new_path(self.spark, "filters")
        rows = urls.select(url.alias("url")).filter("url is not null").distinct()
        rows.withColumn("bucket", self._bucket(F.col("url"))).write.parquet(f"{self.path}/{name}")
        hashed = self.spark.read.parquet(f"{self.path}/{name}").select("bucket", F.xxhash64("url", F.lit(1)).alias("a"), F.xxhash64("url", F.lit(2)).alias("b"))

        def build(batches):
            bucket, bits = None, None

            def put():
                file = f"{folder}/{bucket}-{uuid.uuid4().hex}"
                fs, path = pafs.FileSystem.from_uri(file)
                fs.create_dir(path.rsplit("/", 1)[0], recursive=True)
                with fs.open_output_stream(path) as out:
                    out.write(bits.tobytes())
                return pa.RecordBatch.from_arrays([pa.array([bucket], pa.int32()), pa.array([file])], names=["bucket", "file"])

            for batch in batches:
                of, a, b = (np.asarray(batch.column(i)) for i in range(3))
                for k in np.unique(of).tolist():
                    if k != bucket:
                        if bucket is not None:
                            yield put()
                        bucket, bits = k, np.array(_bits(old[k])) if k in old else np.zeros(size, np.uint8)
                    p = _places(a[of == k], b[of == k], hashes, 8 * size).ravel()
                    np.bitwise_or.at(bits, (p >> np.uint64(3)).astype(np.int64), (1 << (p & np.uint64(7))).astype(np.uint8))
            if bucket is not None:
                yield put()

        made = {r.bucket: r.file for r in hashed.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(build, "bucket int, file string").collect()}
        self.filters.write(self.spark.createDataFrame([(b, f, [*parts, name]) for b, f in {**old, **made}.items()], "bucket int, file string, parts array<string>"))
