"""Packing of token ids into fixed-length sequences: bounded-space online best fit.

Each partition keeps a fixed number of open windows. What a document has beyond whole sequences goes where it
leaves least room; when it fits nowhere, the fullest window is emitted and a new one opened. Windows that are
still open when a partition ends are merged: their pieces of a few partitions are packed again, longest first,
level by level, until one group is left, so no task ever holds more than a few partitions' open windows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from corpusmill.llm.bpe import encoder, slices
from corpusmill.llm.shared import arrow_rows, need, written

_SCHEMA = "doc_id long, start long, length long, doc_tokens long, ids binary, sequence_id long, offset long, grp long"
_NAMES = [x.split()[0] for x in _SCHEMA.split(", ")]
_ARROW = pa.schema([(n, pa.binary() if n == "ids" else pa.int64()) for n in _NAMES])
_ROWS = 2000


class Packer:
    """Places pieces (doc_id, start, doc_tokens, ids) and hands out finished sequences.

    A piece that fits into no open window fills the fullest one if at least min_cut ids go there, and only its
    rest opens a window; so a sequence lacks fewer than min_cut ids when it is emitted.
    """

    def __init__(self, seq_len: int, windows: int, min_cut: int, base: int):
        self.seq_len, self.most, self.min_cut, self.next_id = seq_len, windows, min_cut, base
        self.open: list[tuple[int, list]] = []  # (room, pieces)
        self.done: list[tuple] = []

    def add(self, doc_id, start, doc_tokens, ids: np.ndarray) -> None:
        n = self.seq_len
        while len(ids) >= n:
            self.emit([(doc_id, start, doc_tokens, ids[:n])])
            start, ids = start + n, ids[n:]
        if not len(ids):
            return
        best = min((k for k, (room, _) in enumerate(self.open) if room >= len(ids)), key=lambda k: self.open[k][0], default=None)
        if best is None and len(self.open) == self.most:
            k = min(range(len(self.open)), key=lambda k: self.open[k][0])
            room, pieces = self.open.pop(k)
            if room >= self.min_cut:
                pieces.append((doc_id, start, doc_tokens, ids[:room]))
                start, ids = start + room, ids[room:]
            self.emit(pieces)
        if best is None:
            self.open.append((n - len(ids), [(doc_id, start, doc_tokens, ids)]))
            return
        room, pieces = self.open[best]
        pieces.append((doc_id, start, doc_tokens, ids))
        if room == len(ids):
            del self.open[best]
            self.emit(pieces)
        else:
            self.open[best] = (room - len(ids), pieces)

    def emit(self, pieces) -> None:
        at = 0
        for doc_id, start, doc_tokens, ids in pieces:
            self.done.append((doc_id, start, len(ids), doc_tokens, ids.tobytes(), self.next_id, at, None))
            at += len(ids)
        self.next_id += 1

    def left(self, grp: int) -> list[tuple]:
        return [(d, s, len(i), t, i.tobytes(), None, None, grp) for _, pieces in self.open for d, s, t, i in pieces]

    def flush(self) -> None:
        """The last windows: what is left goes into whole sequences and at the end into powers of two, which need no padding."""
        ids = [p for _, pieces in sorted(self.open, key=lambda w: w[0]) for p in pieces]
        self.open, room, held = [], 0, []
        total = sum(len(p[3]) for p in ids)
        sizes = [self.seq_len] * (total // self.seq_len) + [1 << b for b in range(self.seq_len.bit_length() - 1, -1, -1) if total % self.seq_len >> b & 1]
        sizes = iter(sizes)
        for doc_id, start, doc_tokens, x in ids:
            while len(x):
                room = room or next(sizes)
                held.append((doc_id, start, doc_tokens, x[:room]))
                took = len(held[-1][3])
                start, x, room = start + took, x[took:], room - took
                if not room:
                    self.emit(held)
                    held = []

    def batches(self, final: list[tuple] = ()):
        rows, self.done = [*self.done, *final], []
        for at in range(0, len(rows), _ROWS):
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows[at : at + _ROWS], strict=True), _ARROW, strict=True)], schema=_ARROW)


def pack(docs: DataFrame, tokenizer: str, end_id: int, id_col: str = "doc_id", text_col: str = "text", seq_len: int = 2048, windows: int = 32, min_cut: int = 16, fan_in: int = 8, at_once: int = 4 << 20) -> DataFrame:
    """One row per piece: doc_id, start and length within its document's ids, doc_tokens, ids (little-endian
    unsigned 32-bit), sequence_id, offset in the sequence.

    Each document's ids end with end_id; every id lies in exactly one piece, and each sequence is filled from
    offset 0 without gaps. seq_len is a power of two. A null text counts as empty (end_id alone); null or repeated
    ids of documents stay as they are, each row being packed by itself. Without rows there are no pieces. Only the
    two named columns are read. tokenizer is a file that is present on all machines. at_once: bytes of text that are encoded at once;
    fewer take less memory and more time, and give the same pieces.
    """
    if seq_len < 1 or seq_len & (seq_len - 1):
        raise ValueError("seq_len must be a power of two")
    need(docs, id_col, text_col)

    def first(batches):
        grp = TaskContext.get().partitionId()
        packer = Packer(seq_len, windows, min_cut, grp << 32)
        for whole in batches:
            for batch in slices(whole, "text", at_once):
                offsets, ids = encoder(tokenizer).encode(batch.column(1), end_id)
                for k, doc_id in enumerate(batch.column(0).to_pylist()):
                    own = ids[offsets[k] : offsets[k + 1]]
                    packer.add(doc_id, 0, len(own), own)
                yield from packer.batches()
        yield from packer.batches(packer.left(grp // fan_in))

    def again(level: int, last: bool):
        def merge(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
            grp = key[0].as_py()
            packer = Packer(seq_len, windows, min_cut, (level << 56) + (grp << 32))
            rows = sorted(zip(*(table.column(n).to_pylist() for n in ("doc_id", "start", "doc_tokens", "ids")), strict=True), key=lambda r: (-len(r[3]), r[0] is None, r[0] or 0, r[1], r[3]))
            for doc_id, start, doc_tokens, ids in rows:
                packer.add(doc_id, start, doc_tokens, np.frombuffer(ids, np.uint32))
            if last:
                packer.flush()
            return pa.Table.from_batches(packer.batches([] if last else packer.left(grp // fan_in)), _ARROW)

        return merge

    source = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    with arrow_rows(docs.sparkSession, 1000):
        table = written(source.mapInArrow(first, _SCHEMA), "pack0")
    out, level = [table.filter("sequence_id is not null")], 0
    groups = (table.agg(F.max("grp")).first()[0] or 0) + 1
    while True:
        level += 1
        merged = written(table.filter("sequence_id is null").groupBy("grp").applyInArrow(again(level, groups == 1), _SCHEMA), f"pack{level}")
        out.append(merged.filter("sequence_id is not null"))
        if groups == 1:
            break
        table, groups = merged, -(-groups // fan_in)
    result = out[0]
    for x in out[1:]:
        result = result.union(x)
    return result.drop("grp")
