"""Fingerprints of texts by locally consistent parsing.

Level by level a text's symbols, bytes at first, are cut into phrases, and each phrase gets a name that is the symbol of the
next level. Runs of one symbol are made one first. Then deterministic coin tossing gives every symbol a label from its value and those
of a few symbols before it: the position of the lowest bit in which it differs from its neighbour, and that bit, and the same again with the labels,
until there are six of them; neighbours always differ. Phrases begin where labels peak. So a cut depends on the symbols near it
alone, and equal substrings get equal names, wherever they stand, but for a few phrases at their two ends on each level.

A fingerprint is the name of the whole text and, of the names of the bytes, of the first level and of all higher levels, the least in each of
a number of bins, a byte each (one-permutation minwise hashing). Likeness is the share of filled bins that agree, an estimate of the share of
common phrases.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window, functions as F

from corpusmill.llm.bpe import slices
from corpusmill.llm.shared import arrow_rows, need, written

BINS = (16, 32, 128)  # of bytes (texts up to SMALL bytes only), first-level phrases, higher phrases
FILLED = (1, 4, 8)  # bins that both sides must have filled for their likeness to be that of this tier
SMALL = 64
SIZE = 8 + sum(BINS)
_NONE = np.uint64(0xFFFFFFFFFFFFFFFF)
_BLOCK = 1 << 20  # symbols whose names are computed at once


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit (the finaliser of splitmix64, whose constants these are)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _coin_table(n: int) -> np.ndarray:
    """For symbols a before b below n, at a * n + b: twice the lowest bit's place where they differ, plus that bit of b."""
    a, b = np.arange(n)[:, None], np.arange(n)[None, :]
    differ = a ^ b
    place = np.where(differ > 0, np.log2(np.maximum(differ & -differ, 1)).astype(np.int64), 0)
    return (2 * place + (b >> place & 1)).astype(np.uint8).ravel()


_OF_BYTES, _OF_128, _OF_16 = _coin_table(256), _coin_table(128), _coin_table(16)
_BYTE_NAMES = mix(np.arange(1, 257, dtype=np.uint64))
_POWERS = np.cumprod(np.full(64, 0x9E3779B97F4A7C15, np.uint64), dtype=np.uint64)


def _labels(symbols: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Labels 0 to 5 of symbols whose neighbours differ; first: where texts begin."""

    def toss(of, table, bits):
        index = of.astype(np.uint16)
        index[1:] |= index[:-1] << np.uint16(bits)
        out = table[index]
        out[first] = of[first] & of.dtype.type(1)
        return out

    if symbols.dtype == np.uint8:
        labels = toss(symbols, _OF_BYTES, 8)
    else:
        differ = symbols.copy()
        differ[1:] ^= symbols[:-1]
        differ[first] = 1
        low = differ & (~differ + np.uint64(1))
        place = np.maximum((low.astype(np.float64).view(np.int64) >> 52) - 1023, 0).astype(np.uint64)
        labels = (place << np.uint64(1) | symbols >> place & np.uint64(1)).astype(np.uint8)
        labels = toss(labels, _OF_128, 7)
    for _ in range(2):
        labels = toss(labels, _OF_16, 4)
    return labels


def _names(values: np.ndarray, starts: np.ndarray, level: int) -> np.ndarray:
    """A name for each phrase, of its symbols' values in order; a bounded number of symbols at a time."""
    out = np.empty(len(starts), np.uint64)
    ends = np.append(starts[1:], len(values))
    cuts = np.unique(np.append(np.searchsorted(starts, np.arange(0, len(values), _BLOCK)), len(starts)))
    for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
        at, to = starts[a], ends[b - 1]
        place = np.arange(to - at) - np.repeat(starts[a:b] - at, ends[a:b] - starts[a:b])
        out[a:b] = np.add.reduceat(values[at:to] * _POWERS[place & 63], starts[a:b] - at)
    return mix(out + np.uint64(level + 1))


def _next_level(symbols: np.ndarray, first: np.ndarray, level: int) -> tuple[np.ndarray, np.ndarray]:
    """Names of the phrases of all texts, and where each text's begin. Every text of two symbols or more becomes shorter."""
    change = np.empty(len(symbols), bool)
    change[0], change[1:] = True, symbols[1:] != symbols[:-1]
    change[first] = True
    lengths = None
    if not change.all():
        keep = np.flatnonzero(change)
        lengths = np.diff(np.append(keep, len(symbols)))
        symbols, first = symbols[keep], np.searchsorted(keep, first)
    values = _BYTE_NAMES[symbols] if symbols.dtype == np.uint8 else symbols
    if lengths is not None:
        runs = np.flatnonzero(lengths > 1)
        values = values.copy()
        values[runs] = mix(values[runs] + lengths[runs].astype(np.uint64) * np.uint64(0xD1B54A32D192ED03))
    labels = _labels(symbols, first)
    peak = np.zeros(len(symbols), bool)
    peak[1:-1] = (labels[1:-1] > labels[:-2]) & (labels[1:-1] > labels[2:])
    peak[np.minimum(first + 1, len(peak) - 1)] = False  # a text's first and last phrase have two symbols, too
    peak[first[1:] - 1] = False
    peak[first] = True
    starts = np.flatnonzero(peak)
    return _names(values, starts, level), np.searchsorted(starts, first)


def _fill(bins: np.ndarray, docs: np.ndarray, names: np.ndarray) -> None:
    width = bins.shape[1]
    np.minimum.at(bins.ravel(), docs * width + (names >> np.uint64(65 - width.bit_length())).astype(np.int64), names)


def fingerprints(texts: list[str]) -> np.ndarray:
    """A row of SIZE bytes for each text; equal texts have equal rows. An empty text's row is all zeros."""
    n = len(texts)
    parts = [t.encode("utf-8", "surrogatepass") for t in texts]
    sizes = np.fromiter(map(len, parts), np.int64, n)
    symbols = np.frombuffer(b"".join(parts), np.uint8)
    del parts
    bins = [np.full((n, b), _NONE) for b in BINS]
    roots = np.zeros(n, np.uint64)
    small = sizes <= SMALL
    if small.any():
        of = np.repeat(np.arange(n), sizes)
        some = small[of] if len(of) else np.zeros(0, bool)
        _fill(bins[0], of[some], mix(_BYTE_NAMES[symbols[some]]))
    docs = np.flatnonzero(sizes)
    counts, level = sizes[docs], 0
    while len(docs):
        first = np.cumsum(counts) - counts
        symbols, first = _next_level(symbols, first, level)
        counts, level = np.diff(np.append(first, len(symbols))), level + 1
        of = np.repeat(docs, counts)
        _fill(bins[min(level, 2)], of, symbols)
        done = counts == 1
        if done.any():
            roots[docs[done]] = symbols[first[done]]
            symbols = symbols[~np.repeat(done, counts)]
            docs, counts = docs[~done], counts[~done]
    out = np.zeros((n, SIZE), np.uint8)
    out[:, :8] = roots[:, None].view(np.uint8)
    at = 8
    for b in bins:
        out[:, at : at + b.shape[1]] = np.where(b == _NONE, 0, 1 + b % np.uint64(255))
        at += b.shape[1]
    return out


def likeness(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """From 0 to 1, row by row, of two arrays of fingerprints: by the highest tier of phrases of which both have enough, 1 for equal ones."""
    out, open_, to = np.zeros(len(a)), np.ones(len(a), bool), SIZE
    for width, least in zip(BINS[::-1], FILLED[::-1], strict=True):
        x, y = a[:, to - width : to], b[:, to - width : to]
        to -= width
        take = open_ & ((x > 0).sum(1) >= least) & ((y > 0).sum(1) >= least)
        either = np.maximum(((x > 0) | (y > 0)).sum(1), 1)
        out = np.where(take, ((x == y) & (x > 0)).sum(1) / either, out)
        open_ &= ~take
    return np.where((a == b).all(1), 1.0, out)


def with_fingerprint(docs: DataFrame, text_col: str = "text", out: str = "fingerprint") -> DataFrame:
    """docs with the fingerprint of each text as lowercase hex digits; null counts as empty. Every other column stays, but one named like
    out is replaced; repeated rows get the same; no rows give no rows. Texts are parsed whole, however long."""
    need(docs, text_col)

    @F.pandas_udf("string")
    def made(texts: pd.Series) -> pd.Series:
        rows = [fingerprints([t or ""])[0] for t in texts]
        return pd.Series([r.tobytes().hex() for r in rows], dtype=object)

    return docs.withColumn(out, made(F.col(text_col).cast("string")))


def edited(text: str, after: str) -> str:
    """text whose last third, rounded down, is replaced by as many of the first characters of after, or all it has."""
    n = len(text) // 3
    return text[: len(text) - n] + after[:n]


_ROWS = "kind int, part int, doc_id long, n_chars long, sha binary, own binary, other binary, near_edited double, near_next double, text string"
_ARROW = pa.schema([("kind", pa.int32()), ("part", pa.int32()), ("doc_id", pa.int64()), ("n_chars", pa.int64()), ("sha", pa.binary()), ("own", pa.binary()), ("other", pa.binary()), ("near_edited", pa.float64()), ("near_next", pa.float64()), ("text", pa.string())])
_DONE, _HEAD, _LAST = 0, 1, 2


def _compared(part: int, ids: list, texts: list[str], own: np.ndarray) -> pa.RecordBatch:
    """Of all texts but the last, each held against its edited form and the text after it."""
    n = len(texts) - 1
    changed = [edited(texts[i], texts[i + 1]) for i in range(n)]
    other = fingerprints(changed)
    columns = [np.full(n, _DONE, np.int32), np.full(n, part, np.int32), pa.array(ids[:n], pa.int64()), pa.array([len(t) for t in texts[:n]], pa.int64())]
    columns += [pa.array([hashlib.sha256(t.encode("utf-8", "surrogatepass")).digest() for t in changed], pa.binary())]
    columns += [pa.array([r.tobytes() for r in rows], pa.binary()) for rows in (own[:n], other)]
    columns += [likeness(own[:n], other), likeness(own[:n], own[1:]), pa.nulls(n, pa.string())]
    return pa.RecordBatch.from_arrays([pa.array(c) if isinstance(c, np.ndarray) else c for c in columns], schema=_ARROW)


def _end(kind: int, part: int, doc_id, text: str) -> pa.RecordBatch:
    row = {"kind": kind, "part": part, "doc_id": doc_id, "text": text}
    return pa.RecordBatch.from_arrays([pa.array([row.get(f.name)], f.type) for f in _ARROW], schema=_ARROW)


def compare_with_edits(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row id_col, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited and near_next.

    The next document is the one after this in descending order of id, of equal ids in the order of their texts' hashes, null ids last; after the last
    comes the first, and a single document is its own next. A null text counts as empty; an empty one has likeness 1 to an empty one and 0 to
    others. Repeated rows are compared each, and follow one another. Texts are parsed whole, however long. Only the two
    named columns are read; no rows give no rows.

    Texts are shuffled once, into ranges of (id, hash), so that rows of one id spread over tasks. In a range, the next row is the next document; the last
    row of each range, and the first one of the range after it, come out with their texts, and these few are matched by range.
    """
    need(docs, id_col, text_col)

    def walk(batches):
        part, held = TaskContext.get().partitionId(), None
        for whole in batches:
            for batch in slices(whole, "text", 1 << 20):
                ids, texts = batch.column(0).to_pylist(), [t or "" for t in batch.column(1).to_pylist()]
                own = fingerprints(texts)
                if held is None:
                    yield _end(_HEAD, part, ids[0], texts[0])
                else:
                    ids, texts, own = [held[0], *ids], [held[1], *texts], np.concatenate([held[2], own])
                if len(ids) > 1:
                    yield _compared(part, ids, texts, own)
                held = ids[-1], texts[-1], own[-1:]
        if held is not None:
            yield _end(_LAST, part, held[0], held[1])

    def finish(batches):
        for batch in batches:
            for part, doc_id, text, after in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
                yield _compared(part, [doc_id, None], [text, after], fingerprints([text, after]))

    source = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    key = (F.col("doc_id").desc_nulls_last(), F.xxhash64("text"))
    with arrow_rows(docs.sparkSession, 1000):
        table = written(source.repartitionByRange(*key).sortWithinPartitions(*key, "text").mapInArrow(walk, _ROWS), "fingerprints")
    heads = table.filter(F.col("kind") == _HEAD).select("part", F.col("text").alias("after"))
    parts = Window.orderBy("part")
    order = written(heads.select("part", F.coalesce(F.lead("part").over(parts), F.first("part").over(parts)).alias("then")), "fingerprint-ranges")
    last = table.filter(F.col("kind") == _LAST).select("part", "doc_id", "text").join(order, "part")
    matched = last.join(heads.withColumnRenamed("part", "then"), "then").select("part", "doc_id", "text", "after")
    rows = table.filter(F.col("kind") == _DONE).union(matched.mapInArrow(finish, _ROWS))
    return rows.select(F.col("doc_id").alias(id_col), "n_chars", F.lower(F.hex("sha")).alias("edited_sha256"), F.lower(F.hex("own")).alias("fingerprint"), F.lower(F.hex("other")).alias("edited_fingerprint"), "near_edited", "near_next")
