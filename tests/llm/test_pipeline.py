import random

from pyspark.sql import functions as F

import corpus_pipeline as P
from corpusmill.llm import packing, queries
from corpusmill.llm.shared import perhaps
from tests.llm.common import jaccard, shuffled
from tests.llm.test_text_operators import base_rules, brute_secrets


def documents():
    r = random.Random(8)
    word = lambda: "".join(r.choice("abcdefgh") for _ in range(r.randint(2, 7)))
    rows = []
    for _ in range(40):
        w = [word() for _ in range(r.randint(12, 60))]
        rows.append(" ".join(w))
        if r.random() < 0.5:
            w[r.randrange(len(w))] = word()
            rows += [" ".join(w), " ".join(w)]
    rows += [None, "", "too short", "again and again we say " * 20, " ".join(word() for _ in range(20)) + " password=abcdef123456"]
    return [(i, t, "en", f"h{i % 3}", len(t or "")) for i, t in enumerate(rows)]


def test_stages(spark):
    rows = documents()
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    kept = {r[0]: r[1] for r in rows if not base_rules(r[1])[-1]}
    after = {}
    for name, stage in P.STAGES[:-1]:
        docs = stage(spark, docs, "")
        assert docs.columns == P.COLUMNS
        after[name] = {r.doc_id: r.text for r in docs.collect()}
    assert after["quality_rules"] == kept
    classes = jaccard(list(kept.items()), 5, 80, 100)
    assert set(after["near_duplicates"]) == {i for i, (_, c) in classes.items() if i == c}
    for i, t in after["secret_scan"].items():
        assert (t == kept[i]) == (not brute_secrets(kept[i])) and not brute_secrets(t)
    packed = P.STAGES[-1][1](spark, docs, "")
    assert {r.doc_id for r in packed.select("doc_id").distinct().collect()} == set(after["secret_scan"])
    assert packed.agg(F.sum("length")).first()[0] == packed.select("doc_id", "doc_tokens").distinct().agg(F.sum("doc_tokens")).first()[0]


def test_queries_run_on_the_smallest_folder(spark):
    folder = "/root/testdata/sf0.001"
    for name in ("op2_quality_rules", "op4_secrets", "op5_url_filter"):
        assert queries.QUERIES[name](spark, folder).count() > 0


def test_stages_on_odd_rows(spark):
    """Nulls in every column, empty texts, repeated rows and ids, extra columns, no rows."""
    good = " ".join(f"word{i}" for i in range(40))
    near = good + " more"
    rows = [(3, near, "en", "h", 1), (1, good, None, None, None), (1, good, None, None, None), (None, good, "x", "h", 2), (4, None, None, None, None), (4, "", "en", "h", 0), (5, near[::-1], "en", "h", 9), (5, "other " + " ".join(f"w{i}x" for i in range(30)) + " secret=abcdefgh1", "en", "h", 9), (None, None, None, None, None), (6, "漢" * 200_000, "zh", "h", 1), (7, "line of it\n" * 20_000, "en", "h", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").withColumns({c: F.lit("x") for c in ("Kept", "node", "t", "spans", "_cm_hot", "ids")})
    kept = P.quality_rules(spark, docs, "")
    assert kept.columns == P.COLUMNS
    assert sorted((r.doc_id or 0) for r in kept.collect()) == [0, 1, 1, 3, 5, 5]
    left = P.near_duplicates(spark, docs, "")
    got = sorted(((r.doc_id or 0), (r.text or "")[:5]) for r in left.collect())
    assert got == sorted([(1, good[:5]), (4, ""), (4, ""), (5, near[::-1][:5]), (5, "other"), (0, ""), (6, "漢" * 5), (7, "line ")])
    marked = {(r.doc_id, r.text) for r in P.secret_scan(spark, left, "").collect() if r.text and "[secret]" in r.text}
    assert [i for i, _ in marked] == [5]
    pieces = P.packed(spark, left, "").collect()
    assert sum(p.doc_id == 4 for p in pieces) == 2 and sum(p.length for p in pieces if p.doc_id is None) == 1
    for _, stage in P.STAGES:
        assert stage(spark, docs.limit(0), "").count() == 0


def test_texts_that_stay_are_not_shuffled(spark):
    """Also where the table of the copies is too large for a broadcast."""
    r = random.Random(3)
    texts = [" ".join(f"{r.randrange(10**12):x}" for _ in range(400)) for _ in range(300)]
    rows = [(i, t, "en", "h", len(t)) for i, t in enumerate(texts)] + [(i + 1000, texts[i], "en", "h", 0) for i in range(20)] + [(i, texts[i], "en", "h", 0) for i in range(10, 25)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    name = "spark.sql.autoBroadcastJoinThreshold"
    before = spark.conf.get(name)
    spark.conf.set(name, "-1")
    try:
        left = P.near_duplicates(spark, docs, "")
        found = []
        moved = shuffled(spark, lambda: found.extend(left.select("doc_id", "text").collect()))
    finally:
        spark.conf.set(name, before)
    assert sorted(map(tuple, found)) == list(enumerate(texts))
    assert moved < sum(map(len, texts)) / 4


def test_keys_that_perhaps_are_there(spark):
    keys = spark.range(5000).select(F.xxhash64("id").alias("key")).union(spark.range(7).select(F.xxhash64("id"))).union(spark.createDataFrame([(0,), (-1,), (2**63 - 1,), (-(2**63),)], "key long"))
    rows = keys.select("key", F.lit(True).alias("in")).union(spark.range(5000, 105_000).select(F.xxhash64("id"), F.lit(False)))
    count = lambda df: {(r["in"], r.perhaps): r["count"] for r in df.groupBy("in", "perhaps").count().collect()}
    got = count(perhaps(rows, F.col("key"), keys))
    assert got[True, True] == 5011 and (True, False) not in got and got[False, True] < 300
    assert count(perhaps(rows, F.col("key"), keys, most=5010)) == {(True, True): 5011, (False, True): 100_000}
    assert count(perhaps(rows, F.col("key"), keys.limit(0))) == {(True, False): 5011, (False, False): 100_000}


def test_pieces_are_the_same_with_less_encoded_at_once(spark):
    import public_tokenizers

    docs = spark.createDataFrame(documents(), "doc_id long, text string, lang string, source string, n_chars long")
    rows = lambda most: sorted(map(tuple, packing.pack(docs, public_tokenizers.path("byte_bpe_50k.json"), end_id=50256, at_once=most).collect()), key=str)
    assert rows(500) == rows(4 << 20)
