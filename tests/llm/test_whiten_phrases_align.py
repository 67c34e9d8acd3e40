"""Operators 11 to 13 against brute force."""

import hashlib
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from corpusmill.llm import align, phrases, whiten


def brute_whitening(vectors):
    """n, deviations and the leading components of the distinct grid vectors, by exact integers and numpy."""
    grids = [tuple(math.floor(64 * float(c)) + 1_000_000 for c in v) for v in vectors]
    fit = sorted(set(grids))
    n, d = len(fit), len(fit[0])
    sums = [sum(g[i] for g in fit) for i in range(d)]
    centred = np.array([[n * g[i] - sums[i] for i in range(d)] for g in fit], float) / n
    e, axes = np.linalg.eigh(centred.T @ centred / n)
    e, axes = e[::-1], axes[:, ::-1]
    deviations = [sum((n * g[i] - sums[i]) ** 2 for i in range(d)) for g in grids]
    white = (np.array([[n * g[i] - sums[i] for i in range(d)] for g in grids], float) / n) @ axes / np.sqrt(e)
    return n, deviations, white, e / e.sum()


def test_whitening_equals_brute_force(spark):
    r = np.random.default_rng(3)
    base = r.normal(size=(60, 20)) * np.linspace(0.3, 2, 20)
    rows = [(i, v.tolist()) for i, v in enumerate(base)] + [(100 + i, base[7].tolist()) for i in range(40)]
    bad = [(200, None), (201, [None] + [0.0] * 19), (202, [float("nan")] + [0.0] * 19), (203, [float("inf")] * 20)]
    more = [(None, base[0].tolist()), (5, base[5].tolist())]
    docs = spark.createDataFrame(rows + bad + more, "vec_id long, embedding array<double>").withColumns({"n": F.lit("x"), "x": F.lit(1), "id": F.lit(2)})
    found, fits = whiten.whiten(docs)
    n, deviations, white, shares = brute_whitening([v for _, v in rows])
    got = {}
    for row in whiten.by_component(found, fits).collect():
        got.setdefault(row.vec_id, []).append(row)
    assert set(got) == {i for i, _ in rows} | {None} and len(got[5]) == 32 and n == 60
    signs = None
    for k, (i, _) in enumerate(rows):
        mine = sorted(got[i], key=lambda x: x.component)[:: 2 if i == 5 else 1]
        assert [x.component for x in mine] == list(range(1, 17))
        assert {x.n for x in mine} == {n} and {x.deviation for x in mine} == {deviations[k]}
        w = np.array([x.whitened for x in mine])
        if signs is None:
            signs = np.sign(w * white[k][:16])
        assert np.allclose(w * signs, white[k][:16], atol=1e-8)
        assert np.allclose([x.explained for x in mine], shares[:16], rtol=1e-9)
        assert len({x.identity_error for x in mine}) == 1 and mine[0].identity_error < 1e-8


def test_whitening_of_odd_tables(spark):
    schema = "vec_id long, embedding array<double>"
    run = lambda rows: whiten.by_component(*whiten.whiten(spark.createDataFrame(rows, schema))).collect()
    assert run([]) == [] and run([(1, None), (2, [])]) == [] and run([(1, [1.0, 2.0]), (2, [1.0, 2.0])]) == []
    two = run([(1, [0.0, 0.0]), (2, [1.0, 0.0]), (3, [5.0])])
    assert sorted((r.vec_id, r.component, r.n, r.deviation) for r in two) == [(1, 1, 2, 64 * 64), (2, 1, 2, 64 * 64)]
    assert all(abs(abs(r.whitened) - 1) < 1e-12 and r.explained == pytest.approx(1) for r in two)
    huge = run([(1, [1e300, 0.0]), (2, [-1e300, 1.0]), (3, [2.0**40, 2.0])])
    assert {r.deviation for r in huge if r.vec_id in (1, 2)} == {None} and all(math.isfinite(r.whitened) for r in huge)
    single = spark.createDataFrame([(i, [float(i), float(i * i)]) for i in range(9)], schema).select("vec_id", F.col("embedding").cast("array<float>"))
    rows = whiten.by_component(*whiten.whiten(single)).collect()
    assert len(rows) == 18 and rows[0].identity_error < 1e-9


def walk(text):
    """Names of all levels of one text, symbol by symbol."""

    def toss(values, first):
        out = [first(values[0])]
        for a, b in zip(values, values[1:], strict=False):
            p = ((a ^ b) & -(a ^ b)).bit_length() - 1
            out.append(2 * p + (b >> p & 1))
        return out

    mix = lambda x: int(phrases.mix(np.array([x], np.uint64))[0])
    mask, levels = (1 << 64) - 1, []
    symbols, level = list(text.encode()), 0
    while symbols and (len(symbols) > 1 or level == 0):
        runs = []
        for s in symbols:
            if runs and runs[-1][0] == s:
                runs[-1][1] += 1
            else:
                runs.append([s, 1])
        values = [int(phrases._BYTE_NAMES[s]) if level == 0 else s for s, _ in runs]
        values = [v if n == 1 else mix(v + n * 0xD1B54A32D192ED03 & mask) for v, (_, n) in zip(values, runs, strict=True)]
        labels = [s for s, _ in runs]
        for _ in range(3 if level == 0 else 4):
            labels = toss(labels, lambda x: x & 1)
        assert max(labels) < 6 and all(a != b for a, b in zip(labels, labels[1:], strict=False))
        last = len(labels) - 1
        starts = [0] + [i for i in range(2, last) if labels[i - 1] < labels[i] > labels[i + 1]]
        names = []
        for a, b in zip(starts, [*starts[1:], len(values)], strict=True):
            h = sum(v * int(phrases._POWERS[j & 63]) for j, v in enumerate(values[a:b]))
            names.append(mix(h + level + 1 & mask))
        symbols, level = names, level + 1
        levels.append(names)
    return levels


def brute_fingerprint(text):
    levels = walk(text)
    out = (levels[-1][0] if levels else 0).to_bytes(8, "little")
    own = [int(phrases.mix(phrases._BYTE_NAMES[b : b + 1])[0]) for b in text.encode()] if len(text.encode()) <= phrases.SMALL else []
    for width, names in zip(phrases.BINS, (own, levels[0] if levels else [], [n for x in levels[1:] for n in x]), strict=True):
        bins = {}
        for n in names:
            k = n >> (64 - width.bit_length() + 1)
            bins[k] = min(bins.get(k, n), n)
        out += bytes(1 + bins[k] % 255 if k in bins else 0 for k in range(width))
    return out


TEXTS = ["", "a", "ab", "aaaa", "aaaaaaaaab", "abababababab" * 9, "漢字🙂 é", "the quick brown fox " * 40, "  \n\n  ", "x" * 5000 + "y"]


def test_fingerprints_equal_brute_force():
    r = random.Random(5)
    texts = TEXTS + ["".join(r.choice("abc d") for _ in range(r.randint(0, 400))) for _ in range(60)] + [" ".join(r.choice(["lorem", "ipsum", "dolor", "sit", "amet"]) for _ in range(300))]
    rows = phrases.fingerprints(texts)
    for t, row in zip(texts, rows, strict=True):
        assert row.tobytes() == brute_fingerprint(t) == phrases.fingerprints([t])[0].tobytes()


def test_blocks_of_names_do_not_change_them(monkeypatch):
    text = "".join(random.Random(2).choice("abcdefgh ") for _ in range(3000))
    before = phrases.fingerprints([text, "x", text[5:]])
    monkeypatch.setattr(phrases, "_BLOCK", 100)
    assert (phrases.fingerprints([text, "x", text[5:]]) == before).all()


def test_equal_substrings_share_interior_names():
    r = random.Random(8)
    shared = " ".join("".join(r.choice("abcdefghij") for _ in range(r.randint(2, 9))) for _ in range(800))
    one, two = walk("Some head. " + shared), walk("Another, longer head 123! " + shared + " and a tail")
    for level in range(4):
        common = set(one[level]) & set(two[level])
        assert len(common) >= len(set(one[level])) - 12
    x, y, z = phrases.fingerprints(["Some head. " + shared, "Another, longer head 123! " + shared, "".join(r.sample(shared, len(shared)))])
    assert phrases.likeness(x[None], y[None])[0] > 0.85 and phrases.likeness(x[None], z[None])[0] < 0.1


def expected_edits(rows):
    """rows in order; compared by brute force."""
    out = []
    for i, (doc_id, text) in enumerate(rows):
        after = rows[(i + 1) % len(rows)][1] or ""
        text = text or ""
        m = len(text) // 3
        changed = text[: len(text) - m] + after[:m]
        a, b, c = (np.frombuffer(brute_fingerprint(x), np.uint8)[None] for x in (text, changed, after))
        out.append((doc_id, len(text), hashlib.sha256(changed.encode()).hexdigest(), a.tobytes().hex(), b.tobytes().hex(), phrases.likeness(a, b)[0], phrases.likeness(a, c)[0]))
    return out


def test_edits_equal_brute_force(spark):
    r = random.Random(4)
    texts = TEXTS + [None] + [" ".join(r.choice(["lorem", "ipsum", "dolor", "sit", "amet", "🙂"]) for _ in range(r.randint(0, 60))) for _ in range(40)]
    rows = [(i * 7 % 101, t) for i, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumns({"part": F.lit("x"), "kind": F.lit(1), "n_chars": F.lit("n")}).repartition(5)
    got = [tuple(x) for x in phrases.compare_with_edits(docs).collect()]
    assert sorted(got) == sorted(expected_edits(sorted(rows, key=lambda x: -x[0])))
    assert all(0 <= x[5] <= 1 and 0 <= x[6] <= 1 for x in got)


def test_edits_of_odd_tables(spark):
    run = lambda rows: [tuple(x) for x in phrases.compare_with_edits(spark.createDataFrame(rows, "doc_id long, text string")).collect()]
    assert run([]) == []
    assert run([(1, "hello world")]) == expected_edits([(1, "hello world")])
    same = run([(None, "a text of some words")] * 3 + [(4, None)])
    assert sorted(same, key=str) == sorted(expected_edits([(4, None)] + [(None, "a text of some words")] * 3), key=str)
    long = "word and other words, " * 60_000
    assert sorted(run([(1, long), (2, "short")])) == sorted(expected_edits([(2, "short"), (1, long)]))


def test_null_ids_spread_over_tasks(spark):
    docs = spark.range(4000).select(F.lit(None).cast("long").alias("doc_id"), F.concat(F.lit("text number "), "id").alias("text"))
    key = (F.col("doc_id").desc_nulls_last(), F.xxhash64("text"))
    sizes = [r["count"] for r in docs.repartitionByRange(4, *key).groupBy(F.spark_partition_id()).count().collect()]
    assert len(sizes) == 4 and max(sizes) < 2000
    assert phrases.compare_with_edits(docs).count() == 4000


def test_fingerprint_column(spark):
    docs = spark.createDataFrame([(1, "abc", "old"), (2, None, "old"), (3, "abc", None)], "doc_id long, text string, fingerprint string")
    got = {r.doc_id: r.fingerprint for r in phrases.with_fingerprint(docs).collect()}
    assert got[1] == got[3] == brute_fingerprint("abc").hex() and got[2] == "00" * phrases.SIZE


def paths():
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")


def brute_alignment(rows):
    """Per row its counts, with the libraries on whole texts and loops over tokens."""
    import sentencepiece
    from tokenizers import Tokenizer

    a_path, b_path = paths()
    tok, sp = Tokenizer.from_file(a_path), sentencepiece.SentencePieceProcessor(model_file=b_path)
    tok.encode_special_tokens = True
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    of = {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(x for x in range(256) if x not in shown)}
    docs, holding = [], {}
    for doc_id, text in rows:
        ids_a = tok.encode(" " + text, add_special_tokens=False).ids if text else []
        ids_b = sp.encode(text) if text else []
        a = [bytes(of[c] for c in tok.id_to_token(i)) for i in ids_a]
        b = [bytes([int(p[3:5], 16)]) if sp.is_byte(i) else p.replace("▁", " ").encode() for i in ids_b for p in [sp.id_to_piece(i)]]
        if not text or not b"".join(a) == b"".join(b) == (" " + text).encode():
            docs.append((doc_id, [], []))
            continue
        groups, i, j, at_a, at_b, left, right = [], 0, 0, 0, 0, [], []
        while i < len(a) or j < len(b):
            if at_a <= at_b and i < len(a):
                at_a, i = at_a + len(a[i]), i + 1
                left.append(ids_a[i - 1])
            else:
                at_b, j = at_b + len(b[j]), j + 1
                right.append(ids_b[j - 1])
            if at_a == at_b:
                groups.append((left, right))
                left, right = [], []
        links = [(x, y) for left, right in groups for x in left for y in right]
        for p in set(links):
            holding[p] = holding.get(p, 0) + 1
        docs.append((doc_id, groups, links))
    best = {}
    for (x, _), n in holding.items():
        best[x] = max(best.get(x, 0), n)
    out = []
    for doc_id, groups, links in docs:
        text = ";".join(",".join(map(str, x)) + "|" + ",".join(map(str, y)) for x, y in groups)
        out.append((doc_id, sum(len(x) for x, _ in groups), sum(len(y) for _, y in groups), len(groups), len(links), sum(holding[p] == best[p[0]] for p in links), sum(holding[p] for p in links), hashlib.sha256(text.encode()).hexdigest() if groups else ""))
    return out


ALIGN_COLUMNS = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
PARTS = [" ", "  ", "\n", "\t", "a", "hello", "the ", "Straße", "漢字", "🙂", "<|endoftext|>", "<s>", "</s>", "<0x0A>", "it's", "12345", "antidisestablishment", "　", "ﬁ", "=" * 9, "\x00"]


def mixed(n, seed):
    r = random.Random(seed)
    return ["".join(r.choice(PARTS) for _ in range(r.randint(1, 25))) for _ in range(n)]


def test_alignment_equals_brute_force(spark):
    texts = mixed(150, 1) + [None, "", " ", "a▁b", "word " * 50, "one two three"] * 2
    rows = list(enumerate(texts)) + [(3, "a second text of that id"), (None, "no id at all")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumns({"steps": F.lit(1), "times": F.lit("x"), "n_a": F.lit(None)}).repartition(4)
    got = [tuple(r) for r in align.align(docs, *paths()).select(ALIGN_COLUMNS).collect()]
    assert sorted(got, key=str) == sorted(brute_alignment(rows), key=str)


def test_alignment_of_long_groups_and_small_steps(spark, monkeypatch):
    texts = ["=" * 3000, "x" * 700 + " y", " " * 500 + "end", "🙂" * 300, "ab" * 900]
    rows = list(enumerate(texts))
    import pyarrow as pa

    for size in (7, 1000, 1 << 20):
        monkeypatch.setattr(align, "_SLICE", size)
        x = align.Aligned(pa.array(texts), *(align.vocabulary(p) for p in paths()))
        doc, key, times = x.links()
        assert (np.lexsort((key, doc)) == np.arange(len(key))).all()
        assert x.n_links.tolist() == [r[4] for r in brute_alignment(rows)] == np.bincount(doc, times, minlength=len(texts)).tolist()
        assert [hashlib.sha256(g.encode()).hexdigest() for g in x.digests(as_text=True)] == [r[7] for r in brute_alignment(rows)]


def test_alignment_of_no_rows_and_no_tokens(spark):
    for rows in ([], [(1, None), (2, "")]):
        got = align.align(spark.createDataFrame(rows, "doc_id long, text string"), *paths()).select(ALIGN_COLUMNS).collect()
        assert sorted(tuple(r) for r in got) == [(i, 0, 0, 0, 0, 0, 0, "") for i, _ in rows]


def test_pieces_by_word_equal_the_library():
    import pyarrow as pa

    texts = [*mixed(400, 9), "", "two  spaces", "end ", " begin", "a b c"]
    pieces = align.vocabulary(paths()[1]).encoder
    offsets, ids = pieces.encode(pa.array(texts))
    for i, t in enumerate(texts):
        assert ids[offsets[i] : offsets[i + 1]].tolist() == pieces.sp.encode(t)
