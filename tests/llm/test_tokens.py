import random
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from corpusmill.llm import packing, tokenfiles
from corpusmill.llm.bpe import encoder
from corpusmill.llm.shared import new_path
from tests.llm.common import tokenizer

PARTS = [" ", "  ", " \n", "\n", "\t", "a", "b'll", "éß", "123", "!", " ", "　", "漢字", "<|endoftext|>", "🙂", "\x1c", "it's", "the ", "hello,", " world."]


def texts(n=300, seed=1):
    r = random.Random(seed)
    return ["".join(r.choice(PARTS) for _ in range(r.randint(0, 30))) for _ in range(n)] + [None, "", " ", "word " * 3000]


def test_encoder_equals_the_library():
    path, tok = tokenizer()
    rows = texts()
    for end in (None, 7):
        offsets, ids = encoder(path).encode(pa.array(rows), end)
        for i, t in enumerate(rows):
            assert ids[offsets[i] : offsets[i + 1]].tolist() == tok.encode(t or "", add_special_tokens=False).ids + ([end] if end else [])
    assert encoder(path).encode(pa.array([], pa.string()))[1].size == 0


def frame(spark, rows):
    return spark.createDataFrame([(i, t, 1, "x") for i, t in enumerate(rows)], "doc_id long, text string, ids int, offset string").repartition(3)


def check_pieces(rows, pieces, end):
    _, tok = tokenizer()
    by_doc = {}
    for p in pieces:
        by_doc.setdefault(p.doc_id, []).append(p)
    for i, t in enumerate(rows):
        want = np.array([*tok.encode(t or "", add_special_tokens=False).ids, end], np.uint32)
        at = 0
        for p in sorted(by_doc[i], key=lambda p: p.start):
            assert (p.start, p.doc_tokens) == (at, len(want)) and bytes(p.ids) == want[at : at + p.length].tobytes()
            at += p.length
        assert at == len(want)
    sequences = {}
    for p in pieces:
        sequences.setdefault(p.sequence_id, []).append((p.offset, p.length))
    sizes = []
    for found in sequences.values():
        at = 0
        for offset, length in sorted(found):
            assert offset == at
            at += length
        sizes.append(at)
    return sizes


def test_packing(spark):
    path, _ = tokenizer()
    rows = texts()
    got = packing.pack(frame(spark, rows), path, end_id=1, seq_len=256, windows=4, min_cut=8, fan_in=2).collect()
    sizes = check_pieces(rows, got, 1)
    assert max(sizes) <= 256
    padding = sum(0 if n & (n - 1) == 0 else 256 - n for n in sizes)
    assert padding < 0.03 * sum(sizes)
    assert packing.pack(frame(spark, rows).limit(0), path, end_id=1).count() == 0


def test_packing_of_repeated_rows(spark):
    path, _ = tokenizer()
    df = spark.createDataFrame([(1, "same text"), (1, "same text"), (None, None)], "doc_id long, text string")
    got = packing.pack(df, path, end_id=1).collect()
    assert sum(p.length for p in got if p.doc_id == 1) == 6 and [p.length for p in got if p.doc_id is None] == [1]


def test_token_files(spark):
    path, tok = tokenizer()
    rows = texts(seed=2)
    out = new_path(spark, "test-ids")
    tokenfiles.write_token_files(frame(spark, rows), out, path, end_id=0)
    read = tokenfiles.read_token_files(spark, out)
    got = tokenfiles.with_starts(tokenfiles.digests(read), read).orderBy("doc_id").collect()
    at = 0
    for i, (t, r) in enumerate(zip(rows, got, strict=True)):
        ids = np.array([*tok.encode(t or "", add_special_tokens=False).ids, 0], np.uint32)
        assert (r.doc_id, r.start, r.n_tokens, r.ids_crc32) == (i, at, len(ids), zlib.crc32(ids.tobytes()))
        at += len(ids)
    plan = read.filter(F.col("doc_id") == 5)._jdf.queryExecution().toString()
    assert "PushedFilters: [IsNotNull(doc_id), EqualTo(doc_id,5)]" in plan
    empty = new_path(spark, "test-ids")
    tokenfiles.write_token_files(frame(spark, rows).limit(0), empty, path, end_id=0)
    assert tokenfiles.read_token_files(spark, empty).count() == 0


LONG = ["word\n" * 100_000, "漢字仮名\n" * 2000, "\n".join(f"https://e.com/a/{i}?x={i * 7}" for i in range(3000)), "x" * 1_000_000, "漢" * 100_000, "a\n\nb\n c\nd \ne\x1c\nf\x85\ng\n" * 20, "..." * 5000 + "\nab,,,,\n,", "one word\nof lines " * 20_000]


def test_long_texts_equal_the_library():
    path, tok = tokenizer()
    coder = encoder(path)
    for t in LONG:
        assert coder.encode(pa.array([t]))[1].tolist() == tok.encode(t, add_special_tokens=False).ids, t[:20]
    assert all(len(k) <= 2 for k in coder.short)


def test_long_texts_through_the_operators(spark):
    path, _ = tokenizer()
    check_pieces(LONG, packing.pack(frame(spark, LONG), path, end_id=1).collect(), 1)


def test_files_have_bloom_filters_and_their_stripes_are_skipped(spark):
    path, _ = tokenizer()
    out = new_path(spark, "test-ids")
    rows = [(2 * i, f"text number {i} " * 40) for i in range(4000)]
    df = spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)
    tokenfiles.write_token_files(df, out, path, end_id=0, stripe_bytes=4096, row_group=1000)
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    files = [s.getPath() for s in jvm.org.apache.hadoop.fs.Path(out).getFileSystem(conf).listStatus(jvm.org.apache.hadoop.fs.Path(out)) if s.getPath().getName().endswith(".orc")]
    orc = jvm.org.apache.orc.OrcFile
    rows_of = groups = blooms = 0
    for f in files:
        reader = orc.createReader(f, orc.readerOptions(conf))
        rows_of += reader.getNumberOfRows()
        for stripe in reader.getStripes():
            footer = reader.rows().readStripeFooter(stripe)
            kinds = [footer.getStreams(i).getKind().toString() for i in range(footer.getStreamsCount())]
            blooms += any(k.startswith("BLOOM_FILTER") for k in kinds)
            groups += "ROW_INDEX" in kinds
    assert rows_of == 4000 and blooms == groups > 0
    read = tokenfiles.read_token_files(spark, out)
    assert read.filter("doc_id = 5").count() == 0 and read.filter("doc_id = 6").count() == 1
    some = read.filter("doc_id >= 7000")
    assert some.count() == 500


def test_odd_rows_of_token_files(spark):
    path, _ = tokenizer()
    df = spark.createDataFrame([(1, None, "x"), (1, "", "x"), (1, "a b", "x"), (None, "c", "x"), (None, None, None)], "doc_id long, text string, Part string")
    out = new_path(spark, "test-ids")
    tokenfiles.write_token_files(df, out, path, end_id=0)
    read = tokenfiles.read_token_files(spark, out)
    got = tokenfiles.with_starts(tokenfiles.digests(read), read).orderBy("start").collect()
    assert [r.doc_id for r in got] == [None, None, 1, 1, 1] and sorted(r.n_tokens for r in got) == [1, 1, 1, 2, 3]
    assert got[-1].start + got[-1].n_tokens == sum(r.n_tokens for r in got)


def test_rows_of_one_id_spread_over_files(spark):
    docs = spark.range(4000).select(F.when(F.col("id") % 2 == 0, 7).cast("long").alias("doc_id"), F.concat(F.lit("text number "), "id").alias("text"))
    path = new_path(spark, "token-files-test")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # which would put so few rows together
    tokenfiles.write_token_files(docs, path, tokenizer()[0], end_id=0)
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    rows = tokenfiles.read_token_files(spark, path)
    sizes = [r["count"] for r in rows.groupBy("part").count().collect()]
    assert len(sizes) == 4 and max(sizes) < 2000
    starts = tokenfiles.with_starts(tokenfiles.digests(rows), rows).orderBy("start").collect()
    assert [r.doc_id for r in starts] == [None] * 2000 + [7] * 2000
    assert all(b.start == a.start + a.n_tokens for a, b in zip(starts, starts[1:], strict=False))
