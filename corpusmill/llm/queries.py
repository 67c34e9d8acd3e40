"""One query for each operator, over whole tables and with production parameters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from corpusmill.llm import align, embeddings, html_text, jaccard, packing, phrases, pieces, quality, secrets, tokenfiles, url_filter, warc, whiten
from corpusmill.llm.oracle import ORACLE_SQL
from corpusmill.llm.shared import new_path


def _vocabulary(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = packing.pack(spark.read.parquet(f"{sf_dir}/documents.parquet"), _vocabulary(), end_id=1)
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = quality.quality_rules(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return found.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "n_removed_words")


def op3_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = html_text.extract(spark.read.parquet(f"{sf_dir}/pages.parquet"))
    return found.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))


def op4_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secrets.scan(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")).select("doc_id", "spans")
    base = tuple(r.kind for r in secrets.BASE)
    counts = [F.size(secrets.of_kinds(F.col("spans"), (k,))).cast("long").alias(f"n_{k}") for k in base]
    return found.select("doc_id", *counts, F.sha2(secrets.span_list(F.col("spans"), base), 256).alias("base_sha256"), secrets.span_list(F.col("spans")).alias("spans"))


def op5_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = url_filter.judge(spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url"))
    return found.select("page_id", "host", "path", "rule", "verdict")


def op6_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    index = warc.write_archives(spark.read.parquet(f"{sf_dir}/pages.parquet"), warc.archive_path(spark))
    return warc.read_records(index, with_payload=False).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op7_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embeddings.near_duplicates(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), threshold=0.98)


def op8_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.jaccard_classes(spark.read.parquet(f"{sf_dir}/documents.parquet"), k=4, num=85, den=100)


def op9_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = _vocabulary("piece_bpe_32k.model")
    found = pieces.decode(pieces.encode(spark.read.parquet(f"{sf_dir}/documents.parquet"), path), path)
    return found.select("doc_id", (F.octet_length("ids") / 4).cast("long").alias("n_pieces"), F.crc32("ids").alias("ids_crc32"), F.crc32(F.encode("decoded", "UTF-8")).alias("text_crc32"))


def op10_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = new_path(spark, "token-files")
    tokenfiles.write_token_files(spark.read.parquet(f"{sf_dir}/documents.parquet"), path, _vocabulary(), end_id=0)
    rows = tokenfiles.read_token_files(spark, path)
    found = tokenfiles.with_starts(tokenfiles.digests(rows), rows)
    return found.select("doc_id", "start", F.col("n_tokens").cast("long").alias("n_tokens"), "ids_crc32")


def op11_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, fits = whiten.whiten(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), components=16)
    found = whiten.by_component(rows, fits)
    return found.select("vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error")


def op12_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phrases.compare_with_edits(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def op13_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = align.align(spark.read.parquet(f"{sf_dir}/documents.parquet"), _vocabulary(), _vocabulary("piece_bpe_32k.model"))
    return found.select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")


QUERIES = {f.__name__: f for f in (op1_packing, op2_quality_rules, op3_html_text, op4_secrets, op5_url_filter, op6_warc, op7_embeddings, op8_jaccard, op9_pieces, op10_token_files, op11_whitening, op12_fingerprints, op13_alignment)}
__all__ = ["ORACLE_SQL", "QUERIES"]
