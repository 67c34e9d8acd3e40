"""From raw documents to packed training sequences: quality rules, near duplicates, secrets, packing."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from corpusmill.llm import jaccard, packing, quality, secrets
from corpusmill.llm.shared import discard, perhaps, written
from corpusmill.sources.shared import small_batches

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rules keep, without the lines that many documents of their host share.

    Null and empty texts fail the rules and go, as do those of fewer than ten words. Null hosts (source) are a host of their own. Rows that
    repeat, or share an id, are judged each. Texts of any length are measured whole. No rows give no rows; columns other than those of documents
    are dropped."""
    found = quality.quality_rules(docs).filter("kept")
    return found.withColumn("text", F.col("clean_text")).withColumn("n_chars", F.length("text").cast("long")).select(COLUMNS)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that of the smallest id, of each group linked by a similarity of 0.8 or more on five-word shingles.

    Of rows that are equal in id and text, one stays; rows with one id and different texts are different documents. A null id counts as
    larger than any other. Texts without words (null and empty ones, too) link with nothing and all stay, but for rows
    with the same id and text. Texts of any length are compared whole. No rows give no rows; columns other than those of documents are dropped."""
    rows = jaccard.joined_rows(docs, k=5, num=80, den=100)
    order = F.struct(F.col("doc_id").isNull(), "doc_id", "t")
    keepers = rows.filter("component is not null").groupBy(F.col("component").alias("of")).agg(F.min(order).alias("least"), F.count(F.lit(1)).alias("rows"))
    keepers = written(keepers.filter("rows > 1").select("of", "least"), "keepers")  # a table of its own, so that the join splits large components
    gone = rows.join(keepers, F.col("component") == F.col("of")).filter(order != F.col("least")).select(F.col("doc_id").alias("g_id"), F.col("t").alias("g_t"))
    again = rows.groupBy("doc_id", "t").agg(F.count(F.lit(1)).alias("rows")).filter("rows > 1").select(F.col("doc_id").alias("a_id"), F.col("t").alias("a_t"))
    gone, again = written(gone.distinct(), "copies"), written(again, "repeated-rows")
    discard(rows, keepers)
    text = F.xxhash64(F.col("text").cast("string"))
    keys = gone.select(F.xxhash64("g_id", "g_t").alias("key")).union(again.select(F.xxhash64("a_id", "a_t")))
    docs = perhaps(docs.select(COLUMNS), F.xxhash64(F.col("doc_id").cast("long"), text), keys)  # so the texts of all others, which stay, need no shuffle
    kept = docs.filter("perhaps").join(gone, (text == F.col("g_t")) & F.col("doc_id").eqNullSafe(F.col("g_id")), "left_anti")
    same = (text == F.col("a_t")) & F.col("doc_id").eqNullSafe(F.col("a_id"))
    once = kept.join(again, same, "left_anti").union(kept.join(again, same, "left_semi").dropDuplicates(["doc_id", "text"]))
    return docs.filter("not perhaps").union(once).select(COLUMNS)


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with the secrets in their texts replaced by a mark; spans that overlap or touch become one mark.

    A null text stays null and an empty one empty; texts of any length are scanned whole; repeated rows are treated alike, with null ids or
    not. No rows give no rows; columns other than those of documents are dropped."""
    small_batches(spark)
    found = secrets.redact(secrets.scan(docs, out="secret_spans"), spans_col="secret_spans")
    return found.withColumn("n_chars", F.length("text").cast("long")).select(COLUMNS)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of sequences of 2048 token ids, each document closed by the vocabulary's end-of-text id.

    A null or empty text is that id alone; long ones fill sequences of their own and share the last; rows with null or repeated ids are
    packed each. No rows give no pieces; other columns are not read."""
    import public_tokenizers

    return packing.pack(docs, public_tokenizers.path("byte_bpe_50k.json"), end_id=50256, at_once=1 << 20)


STAGES = [("quality_rules", quality_rules), ("near_duplicates", near_duplicates), ("secret_scan", secret_scan), ("packing", packed)]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (name, stage) in enumerate(STAGES):
        before, docs = docs, stage(spark, docs, sf_dir)
        if i + 1 < len(STAGES):
            docs = written(docs, f"stage-{name}")
            discard(before)
    return docs
