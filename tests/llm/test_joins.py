import random

import numpy as np
import pytest
import pyarrow as pa
from pyspark.sql import functions as F

from corpusmill.llm import embeddings, graph, jaccard, pieces
from tests.llm.common import cosines, jaccard as brute, joined, shuffled


def corpus(seed=5, n=260):
    r = random.Random(seed)
    voc = [f"w{i}" for i in range(40)]
    base = [[r.choice(voc) for _ in range(r.randint(1, 60))] for _ in range(12)]
    rows = []
    for i in range(n):
        w = list(r.choice(base))
        for _ in range(r.choice([0, 0, 1, 1, 2, 3])):
            w[r.randrange(len(w))] = r.choice(voc)
        w += [r.choice(voc)] * (r.random() < 0.3)
        rows.append((i, " ".join(x.upper() if r.random() < 0.2 else x for x in w)))
    return [*rows, (900, None), (901, ""), (902, " \n"), (903, "é É a"), (904, "é É A"), (905, "é é a")]


@pytest.mark.parametrize(("k", "num", "small", "most"), [(4, 85, 64, 1 << 20), (5, 80, 64, 1 << 20), (4, 85, 2, 9), (5, 80, 64, 12)])
def test_jaccard_equals_all_pairs(spark, monkeypatch, k, num, small, most):
    monkeypatch.setattr(jaccard.cross_pairs, "__defaults__", (small,))
    monkeypatch.setattr(jaccard.shard_links, "__defaults__", (8,))
    monkeypatch.setattr(jaccard.hot_nodes, "__defaults__", (256 if most == 1 << 20 else 2,))
    rows = corpus()
    df = spark.createDataFrame([(i, t, 1) for i, t in rows], "doc_id long, text string, n long")
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard.joined_rows(df, k=k, num=num, most=most).collect()}
    assert got == brute(rows, k, num)


def test_jaccard_of_nothing_and_of_repeats(spark):
    other = "z y x w v u t s"
    rows = [(1, "a b c d e"), (1, "a b c d e"), (None, "a b c d e"), (5, "a b c d e"), (5, other), (3, other), (None, "q"), (None, "q"), (7, None), (None, None), (None, " ")]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumns({c: F.lit("x") for c in ("Node", "n", "T", "component_id")})
    got = sorted(((r.doc_id or 0, r.n_shingles, r.component_id or 0) for r in jaccard.jaccard_classes(df).collect()))
    assert got == sorted([(0, 0, 0), (0, 0, 0), (0, 1, 0), (0, 1, 0), (0, 2, 1), (1, 2, 1), (1, 2, 1), (3, 5, 3), (5, 2, 1), (5, 5, 3), (7, 0, 7)])
    assert jaccard.jaccard_classes(df.limit(0)).count() == 0


def test_pairs_of_a_hot_node_are_dealt_out(spark):
    sets = [set(range(i % 4, 20)) for i in range(400)]
    pairs = [(0, i) for i in range(1, 400)] + [(i, 399) for i in range(1, 40)]
    packed = [(i, np.array(sorted(s), np.uint64).tobytes()) for i, s in enumerate(sets)]
    known = spark.createDataFrame([*packed, *packed[:7]], "node long, s binary")  # some twice
    table = spark.createDataFrame(pairs, "a long, b long")
    hot = jaccard.hot_nodes(table, 16)
    assert {r.h_node: r.blocks for r in hot.collect()} == {0: 25, 399: 3}
    bounds = jaccard.Bounds(90, 100)
    got = sorted((r.a, r.b) for r in jaccard.verified(table, known, hot, bounds).collect())
    assert got == sorted((a, b) for a, b in pairs if 100 * len(sets[a] & sets[b]) >= 90 * len(sets[a] | sets[b]))
    none = table.limit(0)
    assert jaccard.verified(none, known, jaccard.hot_nodes(none), bounds).count() == 0


def test_texts_that_are_not_asked_for_are_not_shuffled(spark):
    """With more documents than are broadcast."""
    r = random.Random(4)
    rows = [(i, " ".join(f"{r.randrange(10**12):x}" for _ in range(400))) for i in range(300)] + [(None, "a b c"), (None, None), (7, "d e f")]
    source = jaccard._Source(spark.createDataFrame(rows, "doc_id long, text string"), "doc_id", "text", 2, jaccard.Bounds(80, 100))
    reps = source.rows.filter("doc_id < 20 or doc_id is null").select(F.monotonically_increasing_id().alias("node"), "doc_id", "t")
    reps = spark.createDataFrame(reps.collect(), reps.schema)
    name = "spark.sql.autoBroadcastJoinThreshold"
    before = spark.conf.get(name)
    spark.conf.set(name, "-1")
    try:
        found = []
        moved = shuffled(spark, lambda: found.extend(source.sets(reps, most=5).collect()))
    finally:
        spark.conf.set(name, before)
    assert len(found) == 23 and sorted(map(tuple, found)) == sorted(map(tuple, source.sets(reps).collect()))
    assert moved < sum(len(t or "") for _, t in rows) / 4


def test_shingles():
    got = jaccard.shingle_sets(pa.array(["A b c d", "a B c d e", "x", None, "  "]), 4)
    assert [len(x) for x in got] == [1, 2, 1, 0, 0] and got[0][0] in got[1]


def test_words_that_a_polynomial_hash_confuses():
    one, other = "a", "b"  # Thue-Morse words
    for _ in range(11):
        one, other = one + other, other + one
    sets = jaccard.shingle_sets(pa.array([f"x {one} y z", f"x {other} y z", f"x {one.upper()} y z"]), 4)
    assert sets[0][0] != sets[1][0] and sets[0][0] == sets[2][0]


def test_components(spark):
    r = random.Random(2)
    links = [(r.randrange(60), r.randrange(60)) for _ in range(45)] + [(0, i) for i in range(200, 260)] + [(300 + i, 301 + i) for i in range(30)]
    root = joined(400, links)
    got = {x.node: x.component for x in graph.components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {i: root[i] for i in {x for a, b in links if a != b for x in (a, b)}}
    assert graph.components(spark.createDataFrame([], "a long, b long")).count() == 0


def vectors(n=240):
    rng = np.random.default_rng(0)
    base = rng.normal(size=(8, 5))
    rows = [(i, int(i % 3) if i % 40 else None, (base[i % 8] + rng.normal(size=5) * 0.12 * rng.integers(0, 2)).astype(np.float32).tolist()) for i in range(n)]
    return rows + [(1000, 0, None), (1001, 0, [0.0] * 5), (1002, 0, [1.0, None, 0.0, 0.0, 0.0]), (1003, 0, [float("nan")] * 5), (1004, 0, [1.0]), (1005, 0, [2.0]), (1006, 0, []), (1007, 0, [float("inf"), 1.0])] + [(2000 + i, 1, [1.0, 2.0, 3.0, 4.0, 5.0]) for i in range(20)]


@pytest.mark.parametrize("block", [4096, 7])
def test_embeddings_equal_all_pairs(spark, block):
    rows = vectors()
    df = spark.createDataFrame(rows, "vec_id long, label int, embedding array<float>").withColumn("links", F.lit(1))
    got = {r.vec_id: (r.n_links, r.component_id) for r in embeddings.near_duplicates(df, block=block).collect()}
    assert got == cosines(rows, 0.98)
    assert embeddings.near_duplicates(df.limit(0)).count() == 0


def test_close_pairs_stop_early_but_miss_nothing():
    rng = np.random.default_rng(1)
    x = rng.normal(size=(60, 40))
    y = np.vstack([x[:20] + rng.normal(size=(20, 40)) * 0.1, rng.normal(size=(20, 40))])
    axes = np.linalg.eigh(x.T @ x)[1][:, ::-1]
    got = {(i, j) for a, b in embeddings.close_pairs(x, y, axes, 0.98, False, step=7) for i, j in zip(a.tolist(), b.tolist(), strict=True)}
    c = (x / np.linalg.norm(x, axis=1, keepdims=True)) @ (y / np.linalg.norm(y, axis=1, keepdims=True)).T
    assert got == {(int(i), int(j)) for i, j in np.argwhere(c >= 0.98)}


def piece_path():
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def chunked(m, t, c):
    s, edge = "▁" + t.replace(" ", "▁"), m.longest + 1
    parts, n = [], -(-(len(t) + 1) // c)
    for i in range(n):
        a = max(0, i * c - edge)
        parts.append((s[a : (i + 1) * c + edge], i * c - a, min((i + 1) * c, len(s)) - a))
    states = pieces.boundary_states([m.transfer(*p, i == 0, i + 1 == n) for i, p in enumerate(parts)])
    return [x for p, left, right in zip(parts, states[:-1], states[1:], strict=True) for x in m.backtrace(*p, left, right)]


def test_chunks_equal_the_library():
    m = pieces.model(piece_path())
    r = random.Random(1)
    parts = ["the ", "  ", "   ", "a", "an", "ing", "tion", "é", "漢", "\n", "🙂", "▁", "http://", "0", "12", "        ", "==", " ", "Hello"]
    cases = ["".join(r.choice(parts) for _ in range(r.randint(1, 200))) for _ in range(120)] + ["".join(r.choice("abcdetion") for _ in range(400)) for _ in range(6)] + [" " * 200, "a" * 300]
    for t in cases:
        for c in (17, 64):
            assert chunked(m, t, c) == m.sp.encode(t), t


def test_matrices_combine_associatively():
    m = pieces.model(piece_path())
    s = "▁" + "internationalisations" * 6
    cuts = [0, 30, 61, 90, len(s)]
    a, b, c, d = (m.transfer(s, x, y, x == 0, y == len(s)) for x, y in zip(cuts, cuts[1:], strict=False))
    left = pieces.combine(pieces.combine(pieces.combine(a, b), c), d)
    assert left == pieces.combine(pieces.combine(a, b), pieces.combine(c, d)) == {(pieces.EDGE, pieces.EDGE)}


def test_pieces(spark):
    path = piece_path()
    sp = pieces.model(path).sp
    rows = ["", None, "short text", "word " * 200, "unbroken" * 90, "a  b\n" * 60]
    df = spark.createDataFrame([(i, t, b"") for i, t in enumerate(rows)] + [(2, "short text", b"")], "doc_id long, text string, ids binary")
    got = pieces.decode(pieces.encode(df, path, chunk=100), path).collect()
    assert len(got) == len(rows) + 1 and len({r.key for r in got}) == len(got)
    for r in got:
        assert np.frombuffer(r.ids, np.uint32).tolist() == sp.encode(rows[r.doc_id] or "")
        assert r.decoded == (rows[r.doc_id] or "")
    assert pieces.encode(df.limit(0), path).count() == 0


def test_vectors_of_any_size_and_repeated_ids(spark):
    rows = [(1, 0, [1e200, 2e200]), (2, 0, [2e200, 4e200]), (3, 0, [1e-200, 2e-200]), (4, 0, [5e-324, 0.0]), (9, 0, [3.0, 0.0]), (10, 0, [1e-300, -1e300])]
    rows += [(5, 1, [1.0, 0.0]), (5, 1, [0.0, 1.0]), (7, 1, [2.0, 0.01]), (8, 1, [0.01, 2.0])]
    df = spark.createDataFrame(rows, "vec_id long, label int, embedding array<double>")
    got = sorted((r.vec_id, r.n_links, r.component_id) for r in embeddings.near_duplicates(df).collect())
    assert got == [(1, 2, 1), (2, 2, 1), (3, 2, 1), (4, 1, 4), (5, 1, 5), (5, 1, 5), (7, 1, 5), (8, 1, 5), (9, 1, 4), (10, 0, 10)]


def unigram_model(folder, seed=3):
    """A unigram model file with made-up scores."""
    from sentencepiece import sentencepiece_model_pb2 as pb

    r, m = random.Random(seed), pb.ModelProto()
    add = lambda piece, score, kind: m.pieces.add(piece=piece, score=score, type=kind)
    add("<unk>", 0, 2), add("<s>", 0, 3), add("</s>", 0, 3)
    for b in range(256):
        add(f"<0x{b:02X}>", 0, 6)
    parts = {"▁", *"abcdef", "é"} | {"".join(r.choice("abcdef▁") for _ in range(r.randint(2, 7))) for _ in range(400)}
    for p in sorted(parts):
        add(p, -r.uniform(2, 12) * (1 + len(p) / 4), 1)
    m.trainer_spec.model_type, m.trainer_spec.byte_fallback, m.trainer_spec.vocab_size = 1, True, len(m.pieces)
    m.normalizer_spec.name, m.normalizer_spec.add_dummy_prefix, m.normalizer_spec.remove_extra_whitespaces, m.normalizer_spec.escape_whitespaces = "identity", True, False, True
    path = f"{folder}/unigram.model"
    with open(path, "wb") as f:
        f.write(m.SerializeToString())
    return path


def test_unigram_chunks_equal_the_library(spark, tmp_path):
    path = unigram_model(tmp_path)
    m, r = pieces.model(path), random.Random(8)
    assert m.scored and not m.simple
    texts = ["".join(r.choice("abcdef é漢") for _ in range(r.randint(1, 300))) for _ in range(60)] + [None, "", " ", " " * 40]
    for chunk in (3, 11, 64):
        got = {x.doc_id: np.frombuffer(x.ids, np.uint32).tolist() for x in pieces.encode(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3), path, chunk=chunk).collect()}
        assert got == {i: m.sp.encode(t or "") for i, t in enumerate(texts)}


def test_max_plus_products_are_associative(tmp_path):
    m, r = pieces.model(unigram_model(tmp_path, 4)), random.Random(2)
    s = "▁" + "".join(r.choice("abcdef▁") for _ in range(120))
    cuts = [0, 1, 5, 40, 41, 100, len(s)]
    parts = [m.matrix(s, a, b, a == 0, b == len(s)) for a, b in zip(cuts, cuts[1:], strict=False)]
    states = pieces.best_states(parts)
    ids = [i for k, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False)) for i in m.best_path(s, a, b, states[k], states[k + 1])]
    assert ids == m.best_path(s, 0, len(s), 0, 0) == m.sp.encode(s[1:].replace("▁", " "))
    whole = m.matrix(s, 0, len(s), True, True)[0, 0]
    for k in range(1, len(parts)):
        left = m.matrix(s, 0, cuts[k], True, False)
        right = m.matrix(s, cuts[k], len(s), False, True)
        assert abs((left[0] + right[:, 0]).max() - whole) < 1e-9
