"""Folders that the driver and all executors share, and tables written there to cut lineage."""

from __future__ import annotations

import tempfile
import uuid
import weakref

from pyspark.sql import DataFrame, SparkSession

_CONF = "spark.checkpoint.dir"
_BATCH = "spark.sql.execution.arrow.maxBytesPerBatch"
_PATHS: weakref.WeakKeyDictionary[DataFrame, str] = weakref.WeakKeyDictionary()  # of the tables that written() returned


def shared_dir(spark: SparkSession) -> str:
    """The folder that the cluster names in spark.checkpoint.dir. Where it is unset and all tasks run on this machine (tests), a
    temporary one is set; on a cluster that is an error, as executors would not see each other's files."""
    root = spark.conf.get(_CONF, None)
    if not root:
        master = spark.conf.get("spark.master", "")
        if not master.split("[")[0] == "local":
            raise ValueError(f"{_CONF} must name a folder that all machines of {master} share")
        root = "file://" + tempfile.mkdtemp(prefix="corpusmill-")
        spark.conf.set(_CONF, root)
    return root.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/corpusmill/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str, partition_by: str | None = None) -> DataFrame:
    """df as a Parquet table in the shared folder, read back: later stages never recompute it, executors may be lost."""
    path = new_path(df.sparkSession, name)
    w = df.write.option("compression", "zstd")
    if partition_by:
        w = w.partitionBy(partition_by)
    w.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    _PATHS[out] = path
    return out


def discard(*tables: DataFrame) -> None:
    """Delete tables that written() returned and that no later plan reads: what was made of them must be written itself."""
    for t in tables:
        path = _PATHS.pop(t, None)
        if path is not None:
            jvm = t.sparkSession._jvm
            p = jvm.org.apache.hadoop.fs.Path(path)
            p.getFileSystem(t.sparkSession._jsc.hadoopConfiguration()).delete(p, True)


def free_prefix(df: DataFrame, prefix: str = "_cm") -> str:
    """A prefix that no column of df begins with, in any case, for columns in between."""
    while any(c.lower().startswith(prefix) for c in df.columns):
        prefix += "_"
    return prefix + "_"


def without(df: DataFrame, names, *but: str) -> list[str]:
    """The columns of df, as Spark names them, that are not among names in any case, or are in but."""
    taken = {n.lower() for n in names} - {b.lower() for b in but}
    return [f"`{c.replace('`', '``')}`" for c in df.columns if c.lower() not in taken]


def spread(df: DataFrame, least: int = 256 << 10) -> DataFrame:
    """df over all cores: a scan of fewer partitions than there are cores, as of one small file, is dealt out anew before Python works
    on it. Inputs below `least` bytes, larger inputs, and plans that shuffle anyway stay as they are."""
    if df.isStreaming:
        return df
    plan = df._jdf.queryExecution()
    cores = df.sparkSession.sparkContext.defaultParallelism
    if int(plan.optimizedPlan().stats().sizeInBytes()) < least:
        return df
    if plan.executedPlan().nodeName().startswith("AdaptiveSparkPlan") or plan.toRdd().getNumPartitions() >= cores:
        return df
    return df.repartition(cores)


def small_batches(spark: SparkSession, most: int = 4 << 20) -> None:
    """Rows go to Python in Arrow batches of `most` bytes (Spark: 64 MB and 10,000 rows), as what functions on pages make of a batch, trees aside, is many times its
    size and held at once. A smaller limit of the session stays; the setting holds for all that is run from then on."""
    limit = spark._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(spark.conf.get(_BATCH))
    if limit <= 0 or limit > most:
        spark.conf.set(_BATCH, f"{most}b")
