"""Which tokens of two vocabularies stand for the same bytes, counted over a corpus.

The tokens of both cut a text's bytes; where both cut, a group of tokens ends, and in a group every token of one is linked with every
token of the other. A pair of ids is packed into one 64-bit key. Each task counts its documents' distinct keys with np.unique; the partial counts
are sorted by range of key, runs are added up, and each range is written as two files, of sorted keys and of their counts. Lookups map these files
into memory, so that all tasks of a machine share what they read, and search the sorted keys.
"""

from __future__ import annotations

import hashlib
import shutil
import tempfile
from array import array
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyarrow import fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from corpusmill.llm.bpe import BpeEncoder, slices
from corpusmill.llm.pieces import model
from corpusmill.llm.shared import arrow_rows, need, new_path, written

_SLICE = 1 << 20  # bytes of text, and pairs of one step
_HELD = 1 << 21  # distinct keys that a task keeps before it hands their counts on


class PlainBytes(BpeEncoder):
    """A byte-level vocabulary for which the strings of special tokens are ordinary text; sizes: bytes of each id, table: their bytes."""

    def __init__(self, path: str):
        super().__init__(path)
        self.tok.encode_special_tokens = True
        self.added = []
        of = {c: b for b, c in self.bytes_table.items()}
        n = self.tok.get_vocab_size()
        special = {x.content for x in self.tok.get_added_tokens_decoder().values()}
        shown = [self.tok.id_to_token(i) or "" for i in range(n)]
        self.table = [s.encode() if s in special else bytes(of[c] for c in s) for s in shown]


class PlainPieces(BpeEncoder):
    """A SentencePiece model. Where no piece goes on beyond the space before a word, each distinct word is encoded once; texts with other spaces
    than single ones between words are encoded whole."""

    def __init__(self, path: str, memo: int = 250_000):
        m = model(path)
        self.sp, self.plain, self.memo = m.sp, m.simple, memo
        self.keys, self.begin, self.sizes, self.ids = pa.array([], pa.large_string()), np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint32)
        self.table = [self._bytes(i) for i in range(self.sp.get_piece_size())]

    def _bytes(self, i: int) -> bytes:
        if self.sp.is_byte(i):
            return bytes([int(self.sp.id_to_piece(i)[3:5], 16)])
        return self.sp.id_to_piece(i).replace("▁", " ").encode()

    def _whole(self, text: str) -> array:
        return array("I", self.sp.encode(text))

    def _chunk(self, chunk: str) -> array:
        return array("I", self.sp.encode(chunk[1:] if chunk[:1] == " " else chunk))

    def encode(self, texts: pa.Array, end_id: int | None = None) -> tuple[np.ndarray, np.ndarray]:
        texts = texts.cast(pa.large_string()).fill_null("")
        odd = np.asarray(pc.match_substring_regex(texts, "^ |  | $|▁")).astype(bool)
        if not odd.any() or not self.plain:
            return super().encode(texts, end_id)
        offsets, ids = super().encode(pc.if_else(pa.array(odd), "", texts), end_id)
        return self._with_odd(texts, odd, offsets, ids, end_id)


class Vocabulary:
    """An encoder with its ids' bytes as arrays."""

    def __init__(self, encoder: BpeEncoder):
        self.encoder = encoder
        self.sizes = np.fromiter(map(len, encoder.table), np.int64, len(encoder.table))
        self.begin = np.cumsum(self.sizes) - self.sizes
        self.flat = np.frombuffer(b"".join(encoder.table), np.uint8)
        digits = [str(i) for i in range(len(encoder.table))]
        self.comma, self.bar, self.semicolon = ([d + c for d in digits] for c in ",|;")

    def bytes_of(self, ids: np.ndarray) -> np.ndarray:
        sizes = self.sizes[ids]
        ends = np.cumsum(sizes)
        return self.flat[np.repeat(self.begin[ids] - (ends - sizes), sizes) + np.arange(int(ends[-1]) if len(ends) else 0)]


@lru_cache(maxsize=4)
def vocabulary(path: str) -> Vocabulary:
    """One a worker process. A .json file is a byte-level vocabulary of the tokenizers library, a .model file one of SentencePiece."""
    return Vocabulary(PlainBytes(path) if path.endswith(".json") else PlainPieces(path))


def _kept(offsets: np.ndarray, ids: np.ndarray, keep: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Tokens of the documents that keep names, and how many each document has then."""
    counts = np.diff(offsets)
    return ids[np.repeat(keep, counts)].astype(np.int64), np.where(keep, counts, 0)


class Aligned:
    """Groups and links of a run of texts. Of each text n_a, n_b, n_groups, n_links; group_a, group_b: the group of each token, numbered on over
    all texts."""

    def __init__(self, texts: pa.Array, a: Vocabulary, b: Vocabulary):
        n = len(texts)
        texts = texts.cast(pa.large_string()).fill_null("")
        spaced = pc.binary_join_element_wise(pa.scalar(" ", pa.large_string()), texts, pa.scalar("", pa.large_string()))
        (oa, ia), (ob, ib) = a.encoder.encode(spaced), b.encoder.encode(texts)
        sizes = np.asarray(pc.binary_length(texts)).astype(np.int64)
        total = lambda o, w: np.diff(np.append(0, np.cumsum(w))[o])
        keep = (sizes > 0) & (total(oa, a.sizes[ia]) == sizes + 1) & (total(ob, b.sizes[ib]) == sizes + 1)
        self.a, self.b, self.shift = a, b, max(1, (len(b.sizes) - 1).bit_length())
        while True:  # the second time around only if some text's bytes differ
            (self.ids_a, self.n_a), (self.ids_b, self.n_b) = _kept(oa, ia, keep), _kept(ob, ib, keep)
            own = np.frombuffer("".join(pc.filter(spaced, pa.array(keep)).to_pylist()).encode(), np.uint8)
            wrong = np.flatnonzero((a.bytes_of(self.ids_a) != own) | (b.bytes_of(self.ids_b) != own))
            if not len(wrong):
                break
            of = np.repeat(np.flatnonzero(keep), sizes[keep] + 1)
            keep[np.unique(of[wrong])] = False
        end_a, end_b = np.cumsum(a.sizes[self.ids_a]), np.cumsum(b.sizes[self.ids_b])
        cuts = np.intersect1d(end_a, end_b, assume_unique=True)
        self.group_a, self.group_b = np.searchsorted(cuts, end_a), np.searchsorted(cuts, end_b)
        self.per_a, self.per_b = np.bincount(self.group_a, minlength=len(cuts)), np.bincount(self.group_b, minlength=len(cuts))
        self.doc = np.searchsorted(np.cumsum(np.where(keep, sizes + 1, 0)), cuts)  # of each group
        self.n_groups = np.bincount(self.doc, minlength=n)
        self.n_links = np.zeros(n, np.int64)
        np.add.at(self.n_links, self.doc, self.per_a * self.per_b)

    def digests(self, as_text: bool = False) -> list:
        """`a1,a2|b1;a3|b2,b3` per text, or its SHA-256 in hex; '' of texts without tokens."""
        last = lambda g: np.append(g[1:] != g[:-1], True)
        na, nb = len(self.a.sizes), len(self.b.sizes)
        words = [*self.a.comma, *self.a.bar, *self.b.comma, *self.b.semicolon]
        codes = np.concatenate([self.ids_a + na * last(self.group_a), 2 * na + self.ids_b + nb * last(self.group_b)]) if len(self.ids_a) else np.zeros(0, np.int64)
        begin = np.cumsum(self.per_a + self.per_b) - self.per_a - self.per_b
        before_a, before_b = np.cumsum(self.per_a) - self.per_a, np.cumsum(self.per_b) - self.per_b
        place_a = begin[self.group_a] + np.arange(len(self.ids_a)) - before_a[self.group_a]
        place_b = begin[self.group_b] + self.per_a[self.group_b] + np.arange(len(self.ids_b)) - before_b[self.group_b]
        order = np.empty(len(codes), np.int64)
        order[np.concatenate([place_a, place_b])] = codes
        out, at, shown = [], 0, words.__getitem__
        for n in (self.n_a + self.n_b).tolist():
            text = "".join(map(shown, order[at : at + n].tolist()))[:-1]
            out.append(text if as_text else hashlib.sha256(text.encode()).hexdigest() if n else "")
            at += n
        return out

    def _some(self, groups: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The linked keys of some groups, all occurrences, and their documents."""
        begin_a, begin_b = np.cumsum(self.per_a) - self.per_a, np.cumsum(self.per_b) - self.per_b
        na, nb = self.per_a[groups], self.per_b[groups]
        left = np.repeat(begin_a[groups] - (np.cumsum(na) - na), na) + np.arange(int(na.sum()))
        times = np.repeat(nb, na)
        right = np.arange(int(times.sum())) - np.repeat(np.cumsum(times) - times, times) + np.repeat(np.repeat(begin_b[groups], na), times)
        keys = np.repeat(self.ids_a[left], times) << self.shift | self.ids_b[right]
        return np.repeat(np.repeat(self.doc[groups], na), times), keys

    def links(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Document, key and number of links of each distinct pair of each document, sorted by document and key. Groups of many tokens are
        taken by their distinct ids, some rows of them at a time."""
        pairs = self.per_a * self.per_b
        parts = []

        def add(doc, key, times=None):
            order = np.lexsort((key, doc)) if len(self.n_a) > 1 else np.argsort(key, kind="stable")
            doc, key = doc[order], key[order]
            new = np.flatnonzero(np.append(True, (key[1:] != key[:-1]) | (doc[1:] != doc[:-1]))) if len(key) else np.zeros(0, np.int64)
            many = np.diff(np.append(new, len(key))) if times is None else np.add.reduceat(times[order], new) if len(new) else times[:0]
            parts.append((doc[new], key[new], many))

        usual = np.flatnonzero(pairs <= _SLICE)
        step = np.cumsum(pairs[usual]) // _SLICE
        for block in np.split(usual, np.flatnonzero(np.diff(step)) + 1) if len(usual) else []:
            add(*self._some(block))
        for g in np.flatnonzero(pairs > _SLICE).tolist():
            (ua, ca), (ub, cb) = (np.unique(ids[group == g], return_counts=True) for ids, group in ((self.ids_a, self.group_a), (self.ids_b, self.group_b)))
            rows = max(1, _SLICE // len(ub))
            for i in range(0, len(ua), rows):
                key = (ua[i : i + rows, None] << self.shift | ub).ravel()
                add(np.full(len(key), self.doc[g]), key, (ca[i : i + rows, None] * cb).ravel())
        if len(parts) > 1:
            doc, key, times = (np.concatenate(x) for x in zip(*parts, strict=True))
            parts = []
            add(doc, key, times)
        return parts[0] if parts else (np.zeros(0, np.int64),) * 3


_LINKS = "doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, steps array<long>, times array<long>"


def linked(docs: DataFrame, a_path: str, b_path: str, id_col: str = "doc_id", text_col: str = "text", with_groups: bool = False) -> DataFrame:
    """Per row id_col as doc_id, n_a, n_b, n_groups, n_links, groups_sha256, and its distinct linked pairs: sorted keys as differences (steps) and the
    number of links of each (times); with_groups: the groups as text, too.

    The first vocabulary encodes a space and the text, the second the text. Null and empty texts, and those whose joined bytes differ from a space
    and the text under either vocabulary, have no tokens: zeros, '' and no pairs. Rows with repeated or null ids are aligned each. Texts are aligned whole,
    however long; a group of very many tokens is taken by its distinct ids. Only the two named columns are read; no rows give no rows."""
    need(docs, id_col, text_col)

    def align(batches):
        for whole in batches:
            for batch in slices(whole, "text", _SLICE):
                x = Aligned(batch.column(1), vocabulary(a_path), vocabulary(b_path))
                doc, key, times = x.links()
                bounds = np.searchsorted(doc, np.arange(len(x.n_a) + 1))
                steps = np.diff(key, prepend=0)
                heads = bounds[:-1][np.diff(bounds) > 0]
                steps[heads] = key[heads]
                ends = pa.array(bounds.astype(np.int32))
                columns = [batch.column(0), *(pa.array(c.astype(np.int64)) for c in (x.n_a, x.n_b, x.n_groups, x.n_links)), pa.array(x.digests()), pa.ListArray.from_arrays(ends, pa.array(steps)), pa.ListArray.from_arrays(ends, pa.array(times.astype(np.int64)))]
                if with_groups:
                    columns.append(pa.array(x.digests(as_text=True)))
                yield pa.RecordBatch.from_arrays(columns, names=[c.split()[0] for c in schema.split(", ")])

    schema = _LINKS + (", groups string" if with_groups else "")
    source = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return source.mapInArrow(align, schema)


def _keys(batch: pa.RecordBatch, name: str = "steps") -> tuple[np.ndarray, np.ndarray]:
    """Where each row's keys begin, and all keys; steps are differences within a row."""
    column = batch.column(batch.schema.names.index(name))
    bounds = np.asarray(column.offsets).astype(np.int64)
    steps = np.asarray(column.flatten())
    bounds = bounds - bounds[0]
    sums = np.cumsum(steps)
    before = np.append(0, sums)[bounds[:-1]]
    return bounds, sums - np.repeat(before, np.diff(bounds))


def _summed(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of sorted keys each once, with its sum."""
    new = np.flatnonzero(np.append(True, keys[1:] != keys[:-1])) if len(keys) else np.zeros(0, np.int64)
    return keys[new], np.add.reduceat(counts, new) if len(new) else counts[:0]


class Shards:
    """Sorted pair counts in files. rows: file, n, low, high of each; best: per id of the first vocabulary its highest count."""

    def __init__(self, rows: list[tuple[str, int, int, int]], best: np.ndarray, shift: int):
        self.rows, self.best, self.shift = sorted(rows, key=lambda r: r[2]), best, shift

    def counts(self, keys: np.ndarray) -> np.ndarray:
        """Of sorted keys, 0 where there is none."""
        out = np.zeros(len(keys), np.int64)
        for name, _, low, high in self.rows:
            a, b = np.searchsorted(keys, low), np.searchsorted(keys, high, "right")
            if a < b:
                sorted_keys, counts = _mapped(name)
                at = np.minimum(np.searchsorted(sorted_keys, keys[a:b]), len(sorted_keys) - 1)
                out[a:b] = np.where(sorted_keys[at] == keys[a:b], counts[at], 0)
        return out


@lru_cache(maxsize=4096)
def _mapped(name: str) -> tuple[np.ndarray, np.ndarray]:
    """A shard's two files in memory maps; from a store that is no local folder they are copied into files without a name first, which
    end with the process."""
    fs, path = pafs.FileSystem.from_uri(name)
    maps = []
    for end in (".keys", ".counts"):
        if isinstance(fs, pafs.LocalFileSystem):
            maps.append(np.memmap(path + end, "<i8", "r"))
            continue
        with tempfile.TemporaryFile() as copy, fs.open_input_stream(path + end) as stream:
            shutil.copyfileobj(stream, copy)
            copy.flush()
            maps.append(np.memmap(copy, "<i8", "r"))
    return maps[0], maps[1]


def pair_counts(links: DataFrame, a_path: str, b_path: str) -> Shards:
    """The number of rows of linked() that hold each pair, as shards in the shared folder. Written files are named after the task's attempt, and only those of
    attempts that ended well are listed. The driver gets a line a shard and, of each id of the first vocabulary, a number a shard that has it.
    No pairs give no shards."""
    spark = links.sparkSession
    ids, shift = len(vocabulary(a_path).sizes), max(1, (len(vocabulary(b_path).sizes) - 1).bit_length())
    folder = new_path(spark, "pair-counts")

    def partial(batches):
        held, size = [], 0

        def merged():
            keys, counts = (np.concatenate(x) for x in zip(*held, strict=True))
            order = np.argsort(keys, kind="stable")
            return _summed(keys[order], counts[order])

        def handed(keys, counts):
            for i in range(0, len(keys), 1 << 18):
                yield pa.RecordBatch.from_arrays([pa.array(keys[i : i + (1 << 18)]), pa.array(counts[i : i + (1 << 18)])], names=["key", "n"])

        for batch in batches:
            keys, counts = np.unique(_keys(batch)[1], return_counts=True)
            held.append((keys, counts.astype(np.int64)))
            size += len(keys)
            if size > 2 * _HELD:
                held = [merged()]
                size = len(held[0][0])
                if size > _HELD:
                    yield from handed(*held[0])
                    held, size = [], 0
        if held:
            yield from handed(*merged())

    def write(batches):
        context = TaskContext.get()
        name, files = f"{folder}/part-{context.partitionId():05d}-{context.taskAttemptId()}", None
        best, n, low, last = np.zeros(ids, np.int64), 0, 0, None

        def put(keys, counts):
            nonlocal n, low, files
            if not len(keys):
                return
            if files is None:
                fs, path = pafs.FileSystem.from_uri(name)
                fs.create_dir(path.rsplit("/", 1)[0], recursive=True)
                files, low = [fs.open_output_stream(path + end) for end in (".keys", ".counts")], int(keys[0])
            files[0].write(keys.astype("<i8").tobytes())
            files[1].write(counts.astype("<i8").tobytes())
            np.maximum.at(best, keys >> shift, counts)
            n += len(keys)

        for batch in batches:
            keys, counts = (np.asarray(batch.column(i)) for i in range(2))
            if last is not None:
                keys, counts = np.append(last[0], keys), np.append(last[1], counts)
            keys, counts = _summed(keys, counts)
            put(keys[:-1], counts[:-1])
            last = (keys[-1:], counts[-1:]) if len(keys) else last
        if last is not None:
            put(*last)
        if files is not None:
            for f in files:
                f.close()
            some = np.flatnonzero(best)
            yield pa.RecordBatch.from_arrays([pa.array([name]), pa.array([n]), pa.array([low]), pa.array([int(last[0][0])]), pa.array([some.tolist()], pa.list_(pa.int64())), pa.array([best[some].tolist()], pa.list_(pa.int64()))], names=["file", "n", "low", "high", "ids", "best"])

    counted = written(links.select("steps").mapInArrow(partial, "key long, n long"), "pair-partial-counts")
    shards = counted.repartitionByRange("key").sortWithinPartitions("key").mapInArrow(write, "file string, n long, low long, high long, ids array<long>, best array<long>")
    best, rows = np.zeros(ids, np.int64), []
    for r in shards.collect():
        rows.append((r.file, r.n, r.low, r.high))
        np.maximum.at(best, np.array(r.ids), np.array(r.best))
    return Shards(rows, best, shift)


def weighed(links: DataFrame, shards: Shards) -> DataFrame:
    """rows of linked() with n_best, the links whose pair has the highest count of its first id's, and count_sum, the sum of all links' counts, instead of
    the pairs. Rows without pairs have zeros."""
    names = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256"]

    def weigh(batches):
        for batch in batches:
            bounds, keys = _keys(batch)
            times = np.asarray(batch.column(batch.schema.names.index("times")).flatten())
            distinct, at = np.unique(keys, return_inverse=True)
            counts = shards.counts(distinct)
            top = counts == shards.best[distinct >> shards.shift]
            sums = [np.diff(np.append(0, np.cumsum(v))[bounds]) for v in (times * top[at], times * counts[at])]
            yield pa.RecordBatch.from_arrays([batch.column(batch.schema.names.index(n)) for n in names] + [pa.array(s.astype(np.int64)) for s in sums], names=[*names, "n_best", "count_sum"])

    schema = "doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, n_best long, count_sum long"
    return links.select(*names, "steps", "times").mapInArrow(weigh, schema)


def align(docs: DataFrame, a_path: str, b_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """linked(), pair_counts() over all rows, and weighed()."""
    with arrow_rows(docs.sparkSession, 1000):
        links = written(linked(docs, a_path, b_path, id_col, text_col), "token-links")
    return weighed(links, pair_counts(links, a_path, b_path)).withColumnRenamed("doc_id", id_col)
