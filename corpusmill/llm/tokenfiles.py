"""Token ids of documents in ORC: run-length encoded integers, row indexes, Bloom filters on document ids.

One file a partition, in ascending order of ids, so that readers take stripes in parallel, skip stripes and row
groups by their minimum and maximum id, and look single ids up by the Bloom filters.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from corpusmill.llm.bpe import encoder, slices
from corpusmill.llm.shared import need, written

_SCHEMA = "doc_id long, part int, start_in_part long, n_tokens int, ids array<int>"
_ARROW = pa.schema([("doc_id", pa.int64()), ("part", pa.int32()), ("start_in_part", pa.int64()), ("n_tokens", pa.int32()), ("ids", pa.list_(pa.int32()))])


def write_token_files(docs: DataFrame, path: str, tokenizer: str, end_id: int, id_col: str = "doc_id", text_col: str = "text", stripe_bytes: int = 64 << 20, row_group: int = 10_000, false_positives: float = 0.01) -> None:
    """Encode every text, append end_id, and write files in ascending order of id_col.

    A null text is written as end_id alone. Rows with a null id come first; rows of one id are ordered by a hash of their text, and by the text, and may
    fill several files.
    Without rows, files without rows are written. Only the two named columns are read.
    """
    need(docs, id_col, text_col)

    def encode(batches):
        part, at = TaskContext.get().partitionId(), 0
        for whole in batches:
            for batch in slices(whole, "text"):
                offsets, ids = encoder(tokenizer).encode(batch.column(1), end_id)
                sizes = np.diff(offsets)
                starts, at = at + offsets[:-1], at + int(offsets[-1])
                n = batch.num_rows
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.full(n, part, np.int32)), pa.array(starts), pa.array(sizes.astype(np.int32)), pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(ids.view(np.int32)))], schema=_ARROW)

    source = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    rows = source.repartitionByRange("doc_id", F.xxhash64("text")).sortWithinPartitions("doc_id", F.xxhash64("text"), "text").mapInArrow(encode, _SCHEMA)
    options = {"compression": "zstd", "orc.bloom.filter.columns": "doc_id", "orc.bloom.filter.fpp": false_positives, "orc.create.index": "true", "orc.row.index.stride": row_group, "orc.stripe.size": stripe_bytes}
    rows.write.options(**options).orc(path)


def read_token_files(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, part, start_in_part, n_tokens and ids; filters on doc_id skip stripes and row groups. A folder without rows gives
    none; columns that other writers added are not read."""
    return spark.read.schema(_SCHEMA).orc(path)


def with_starts(rows: DataFrame, parts: DataFrame) -> DataFrame:
    """start: the number of ids in all documents before. parts is read_token_files() of the whole folder, of which only
    the counts are read; there is one sum a file, whose table Spark broadcasts if it is small. Every row of rows gets its start, rows with
    null or repeated ids as well; without rows there are none."""
    sums = parts.groupBy("part").agg(F.sum("n_tokens").alias("n"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    sums = written(sums, "token-file-sums")  # of known size, so that rows are not shuffled while Spark finds it out
    return rows.join(sums, "part").withColumn("start", F.col("before") + F.col("start_in_part")).drop("before")


def digests(rows: DataFrame) -> DataFrame:
    """ids replaced by ids_crc32, the unsigned CRC-32 of the ids as little-endian unsigned 32-bit integers.

    rows are those of read_token_files(); null or repeated doc_ids stay as they are, null ids are not written and so not expected; no
    rows give no rows; other columns are dropped."""

    def crc(batches):
        for batch in batches:
            lists = batch.column(batch.schema.names.index("ids"))
            bounds, flat = np.asarray(lists.offsets), np.ascontiguousarray(np.asarray(lists.values), dtype="<i4")
            found = [zlib.crc32(flat[a:b]) for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(i) for i in range(4)] + [pa.array(found, pa.int64())], names=[*batch.schema.names[:4], "ids_crc32"])

    return rows.select("doc_id", "part", "start_in_part", "n_tokens", "ids").mapInArrow(crc, "doc_id long, part int, start_in_part long, n_tokens int, ids_crc32 long")
