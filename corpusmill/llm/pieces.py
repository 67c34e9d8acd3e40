"""SentencePiece encoding and decoding, giant documents in parallel by a max-plus scan over chunks.

For a unigram model an encoding is the best path of a lattice of pieces, by the sum of their scores. What a chunk does to it is a max-plus matrix from the
characters by which a piece may reach over its left end to those by which one may reach over its right end. For byte-pair encoding the weights are others: its result is the one sequence of pieces in which every two neighbours are
compatible: encoding their joint text gives these two. So it is a best path with weight 0
for compatible neighbours and minus infinity for others, and the states are
the pieces that may lie across a chunk's ends. As the weights are 0 and minus infinity, such a
matrix is kept as the set of its finite entries. Matrices of either kind are combined associatively, which gives the piece
across each chunk end; then every chunk backtraces its own path. Where a word begins a piece begins, so a chunk with a
word has a matrix of rank one, and what lies between its first and last word is encoded by the library.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from corpusmill.llm.bpe import slices
from corpusmill.llm.shared import need, written

_SPACE = "▁"
State = tuple[int, int]  # a piece across a chunk end: its characters before the end, and all of them
EDGE: State = (0, 0)  # the end of the document


class PieceModel:
    """A byte-pair model file. simple: without normalisation and with a space put before the text, as chunks need it."""

    def __init__(self, path: str):
        import sentencepiece as spm
        from sentencepiece import sentencepiece_model_pb2 as pb

        m = pb.ModelProto()
        with open(path, "rb") as f:
            m.ParseFromString(f.read())
        self.sp = spm.SentencePieceProcessor(model_file=path)
        self.scores = {p.piece: p.score for p in m.pieces if p.type in (1, 4, 5)}
        self.ids = {p.piece: i for i, p in enumerate(m.pieces) if p.type in (1, 4, 5)}
        n, t = m.normalizer_spec, m.trainer_spec
        crossing = any(_SPACE in p.lstrip(_SPACE) for p in self.scores)
        plain = t.byte_fallback and not t.treat_whitespace_as_suffix and not n.precompiled_charsmap and n.add_dummy_prefix and not n.remove_extra_whitespaces and n.escape_whitespaces and all(p.type != 4 for p in m.pieces)
        self.scored = t.model_type == 1 and plain
        self.unknown = min((p.score for p in m.pieces if p.type == 1), default=0.0) - 10  # fixed value: the library's penalty
        self.simple = t.model_type == 2 and t.byte_fallback and not t.treat_whitespace_as_suffix and not n.precompiled_charsmap and n.add_dummy_prefix and not n.remove_extra_whitespaces and n.escape_whitespaces and not crossing and all(p.type != 4 for p in m.pieces)
        self.longest = max(map(len, self.scores))
        self.byte_ids = [self.sp.piece_to_id(f"<0x{b:02X}>") for b in range(256)] if t.byte_fallback else []
        self.pairs: dict = {}

    def merged(self, text: str) -> list[str]:
        """Pieces of a short text, by merging the best-scored neighbours, the leftmost of equals."""
        out = list(text)
        while True:
            best, at = None, -1
            for i in range(len(out) - 1):
                s = self.scores.get(out[i] + out[i + 1])
                if s is not None and (best is None or s > best):
                    best, at = s, i
            if at < 0:
                return out
            out[at : at + 2] = [out[at] + out[at + 1]]

    def compatible(self, a: str, b: str) -> bool:
        got = self.pairs.get((a, b))
        if got is None:
            got = self.merged(a + b) == [a, b]
            if len(self.pairs) < 100_000:
                self.pairs[a, b] = got
        return got

    def weighed(self, s: str, p: int):
        """The pieces that s may have at p in a unigram model, with their scores; a character that is no piece has the score of unknown ones."""
        for n in range(1, min(self.longest, len(s) - p) + 1):
            score = self.scores.get(s[p : p + n])
            if score is not None:
                yield n, score
            elif n == 1:
                yield 1, self.unknown

    def matrix(self, s: str, b: int, e: int, first: bool, last: bool) -> np.ndarray:
        """The best score, over pieces that begin in s[b:e], from each place b + i to each place e + j; i and j are 0 at the document's ends."""
        n, width = e - b, self.longest
        best = np.full((n + width + 1, width), -np.inf)
        starts = 1 if first else width
        best[np.arange(starts), np.arange(starts)] = 0
        for p in range(n):
            row = best[p]
            if row.max() > -np.inf:
                for size, score in self.weighed(s, b + p):
                    np.maximum(best[p + size], row + score, out=best[p + size])
        out = best[n : n + width].T.copy()
        if last:
            out[:, 1:] = -np.inf
        return out

    def best_path(self, s: str, b: int, e: int, left: int, right: int) -> list[int]:
        """Ids of the pieces that begin in s[b:e], on the best path from b + left to e + right."""
        best, back = {b + left: 0.0}, {}
        for p in range(b + left, e):
            if p in best:
                for size, score in self.weighed(s, p):
                    if best[p] + score > best.get(p + size, -np.inf):
                        best[p + size], back[p + size] = best[p] + score, p
        at, pieces = e + right, []
        while at in back:
            pieces.append(s[back[at] : at])
            at = back[at]
        return self.piece_ids(pieces[::-1])

    def piece_ids(self, pieces: list[str]) -> list[int]:
        return [x for p in pieces for x in ([self.ids[p]] if p in self.ids else [self.byte_ids[b] for b in p.encode()])]

    def at(self, s: str, p: int) -> list[str]:
        """The pieces that s may have at p: any single character, and longer ones of the vocabulary."""
        return [s[p : p + n] for n in range(1, min(self.longest, len(s) - p) + 1) if n == 1 or s[p : p + n] in self.scores]

    def states(self, s: str, b: int) -> list[State]:
        """The pieces that may cross, or end at, position b."""
        return [(k, len(t)) for k in range(1, min(self.longest, b) + 1) for t in self.at(s, b - k) if len(t) >= k]

    def lattice(self, s: str, starts: list[tuple[int, str | None]], end: int):
        """Nodes (position, piece) with the starts that lead there as bits, and their predecessors. A start is a position and the
        piece that ends there; None stands for a word's or the document's begin."""
        ending: dict[int, list] = {}
        for i, (p, t) in enumerate(starts):
            ending.setdefault(p, []).append((t, 1 << i, None))
        nodes: dict = {}
        for p in range(min((p for p, _ in starts), default=end), end):
            before = ending.get(p)
            if not before:
                continue
            for t in self.at(s, p):
                bits, from_ = 0, []
                for u, m, node in before:
                    if u is None or self.compatible(u, t):
                        bits |= m
                        from_.append((m, node))
                if bits:
                    nodes[p, t] = (bits, from_)
                    ending.setdefault(p + len(t), []).append((t, bits, (p, t)))
        return nodes, ending

    @staticmethod
    def back(nodes: dict, node, start: int) -> list[str]:
        out = []
        while node is not None:
            out.append(node[1])
            node = next(n for m, n in nodes[node][1] if m >> start & 1)
        return out[::-1]

    def _words(self, s: str, b: int, e: int) -> tuple[int, int] | None:
        """The first and last position in [b, e) where a word begins."""
        at = [i for i in (self._next(s, b, e, 1), self._next(s, b, e, -1)) if i >= 0]
        return (at[0], at[1]) if at else None

    @staticmethod
    def _next(s: str, b: int, e: int, step: int) -> int:
        for i in range(b, e) if step > 0 else range(e - 1, b - 1, -1):
            if s[i] == _SPACE and (i == 0 or s[i - 1] != _SPACE):
                return i
        return -1

    def _starts(self, s: str, b: int, lefts: list[State]):
        return [(b, None) if x == EDGE else (b - x[0] + x[1], s[b - x[0] : b - x[0] + x[1]]) for x in lefts]

    def transfer(self, s: str, b: int, e: int, first: bool, last: bool) -> set[tuple[State, State]]:
        """The finite entries of the chunk s[b:e]; around it s goes on for at least the longest piece, unless first or last."""
        lefts = [EDGE] if first else self.states(s, b)
        rights = [EDGE] if last else self.states(s, e)
        words = self._words(s, b, e)
        over = {(x, (x[0] + e - b, x[1])) for x in lefts if x != EDGE and x[1] - x[0] > e - b}
        if words is None:
            nodes, ending = self.lattice(s, self._starts(s, b, lefts), e)
            return over | {(x, y) for x, y, _ in self._ends(s, e, nodes, ending, lefts, rights)}
        nodes, ending = self.lattice(s, self._starts(s, b, lefts), words[0])
        bits = 0
        for _, m, _ in ending.get(words[0], []):
            bits |= m
        good = [x for i, x in enumerate(lefts) if bits >> i & 1]
        nodes, ending = self.lattice(s, [(words[1], None)], e)
        right = {y for _, y, _ in self._ends(s, e, nodes, ending, [EDGE], rights)}
        return over | {(x, y) for x in good for y in right}

    def _ends(self, s, e, nodes, ending, lefts, rights):
        """(left, right, node) for the pieces across e, or that end at the document's end."""
        for y in rights:
            found = [(m, n) for _, m, n in ending.get(e, [])] if y == EDGE else []
            if y != EDGE:
                piece = (e - y[0], s[e - y[0] : e - y[0] + y[1]])
                found = [(nodes[piece][0], piece)] if piece in nodes else []
                found += [(m, None) for t, m, n in ending.get(e - y[0] + y[1], []) if n is None and t is not None and t == piece[1]]
            for m, n in found:
                for i, x in enumerate(lefts):
                    if m >> i & 1:
                        yield x, y, n

    def backtrace(self, s: str, b: int, e: int, left: State, right: State) -> list[int]:
        """Ids of the pieces that begin in s[b:e]."""
        if left != EDGE and left[1] - left[0] > e - b:
            return []
        words = self._words(s, b, e)
        starts = self._starts(s, b, [left])
        if words is None:
            nodes, ending = self.lattice(s, starts, e)
            node = next((n for _, y, n in self._ends(s, e, nodes, ending, [left], [right]) if y == right), None)
            return self.piece_ids(self.back(nodes, node, 0))
        nodes, ending = self.lattice(s, starts, words[0])
        head = next((n for _, _, n in ending.get(words[0], [])), None)
        ids = self.piece_ids(self.back(nodes, head, 0))
        if words[1] > words[0]:
            ids += self.sp.encode(s[words[0] + 1 : words[1]].replace(_SPACE, " "))
        nodes, ending = self.lattice(s, [(words[1], None)], e)
        node = next(n for _, y, n in self._ends(s, e, nodes, ending, [EDGE], [right]) if y == right)
        return ids + self.piece_ids(self.back(nodes, node, 0))


def combine(a: set, b: set) -> set:
    """The max-plus product of two matrices given by their finite entries; associative."""
    after: dict = {}
    for x, y in b:
        after.setdefault(x, []).append(y)
    return {(x, z) for x, y in a for z in after.get(y, ())}


def boundary_states(matrices: list[set]) -> list[State]:
    """The state at each end between chunks, and at the document's two ends: prefixes by a scan in doubling steps, then the last
    states, each of which leaves one before it."""
    prefix, step = list(matrices), 1
    while step < len(prefix):
        prefix = [combine(prefix[i - step], x) if i >= step else x for i, x in enumerate(prefix)]
        step *= 2
    out = [EDGE]
    for i in range(len(matrices) - 1, 0, -1):
        reachable = {y for x, y in prefix[i - 1] if x == EDGE}
        out.append(next(x for x, y in sorted(matrices[i]) if y == out[-1] and x in reachable))
    return [EDGE, *out[::-1]]


def best_states(matrices: list[np.ndarray]) -> list[int]:
    """As boundary_states(), of a unigram model: at each end between chunks, and at the document's two ends, the characters by which the best path's piece reaches over it."""
    product = lambda a, b: (a[:, :, None] + b[None, :, :]).max(1)
    prefix, step = [m[:1] if i == 0 else m for i, m in enumerate(matrices)], 1
    while step < len(prefix):
        prefix = [product(prefix[i - step], x) if i >= step else x for i, x in enumerate(prefix)]
        step *= 2
    out = [0]
    for i in range(len(matrices) - 1, 0, -1):
        out.append(int((prefix[i - 1][0] + matrices[i][:, out[-1]]).argmax()))
    return [0, *out[::-1]]


@lru_cache(maxsize=2)
def model(path: str) -> PieceModel:
    return PieceModel(path)


_FIRST = "key long, doc_id long, chunk int, chunks int, b int, e int, s string, ids binary"


def encode(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", chunk: int = 16384) -> DataFrame:
    """doc_id, key (of the row), ids (little-endian unsigned 32-bit), as the library gives them for the whole text.

    Texts up to `chunk` characters are encoded by the library at once; longer ones are cut into chunks of that many, which go
    to tasks of their own. In a chunk the lattice covers what lies before its first and after its last word; the words in between
    have the same pieces whatever surrounds them, and are encoded by the library. Null and empty texts have no ids. Rows with repeated or null doc_ids stay apart by key.
    Of a unigram model the matrices hold scores, in double precision; where two segmentations score the same, or differ by less than the rounding of the library's single precision,
    which grows with the text, ids may be those of the other one. A model that normalises texts, lacks bytes, or is of another kind, is applied to whole texts only.
    """
    need(docs, id_col, text_col)

    def first(batches):
        key = TaskContext.get().partitionId() << 40
        for whole in batches:
            for batch in slices(whole, "text", 4 << 20):
                m = model(path)
                rows = []
                texts = batch.column(1).to_pylist()
                whole_only = not (m.simple or m.scored)
                small = [t or "" if not t or len(t) <= chunk or whole_only else "" for t in texts]
                for doc_id, t, ids in zip(batch.column(0).to_pylist(), texts, m.sp.encode(small, num_threads=1), strict=True):
                    key += 1
                    if not t or len(t) <= chunk or whole_only:
                        rows.append((key, doc_id, 0, 1, 0, 0, None, np.array(ids, np.uint32).tobytes()))
                        continue
                    s, edge = _SPACE + t.replace(" ", _SPACE), m.longest + 1
                    n = -(-len(s) // chunk)
                    for i in range(n):
                        a = max(0, i * chunk - edge)
                        rows.append((key, doc_id, i, n, i * chunk - a, min((i + 1) * chunk, len(s)) - a, s[a : (i + 1) * chunk + edge], None))
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), [pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.int32(), pa.string(), pa.binary()], strict=True)], names=[x.split()[0] for x in _FIRST.split(", ")])

    def transfers(batches):
        for pdf in batches:
            found = []
            for r in pdf.itertuples():
                m, ends = model(path), (r.chunk == 0, r.chunk + 1 == r.chunks)
                found.append(m.matrix(r.s, r.b, r.e, *ends).tolist() if m.scored else [[float(v) for v in (*x, *y)] for x, y in sorted(m.transfer(r.s, r.b, r.e, *ends))])
            yield pd.DataFrame({"key": pdf["key"], "chunk": pdf["chunk"], "m": found})

    def scan(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("chunk")
        if model(path).scored:
            states = [[x] for x in best_states([np.stack(m) for m in pdf["m"]])]
        else:
            states = boundary_states([{((int(a), int(b)), (int(c), int(d))) for a, b, c, d in m} for m in pdf["m"]])
        return pd.DataFrame({"key": pdf["key"], "chunk": pdf["chunk"], "l": [list(x) for x in states[:-1]], "r": [list(x) for x in states[1:]]})

    def trace(batches):
        for pdf in batches:
            m = model(path)
            ids = [np.array(m.best_path(r.s, r.b, r.e, int(r.l[0]), int(r.r[0])) if m.scored else m.backtrace(r.s, r.b, r.e, tuple(r.l), tuple(r.r)), np.uint32).tobytes() for r in pdf.itertuples()]
            yield pd.DataFrame({"key": pdf["key"], "doc_id": pdf["doc_id"], "chunk": pdf["chunk"], "ids": ids})

    def join(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("chunk")
        return pd.DataFrame({"key": pdf["key"][:1], "doc_id": pdf["doc_id"][:1], "ids": [b"".join(pdf["ids"])]})

    source = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    rows = written(source.mapInArrow(first, _FIRST), "pieces")
    long = rows.filter("chunks > 1").repartition("key", "chunk")
    matrices = written(long.select("key", "chunk", "chunks", "b", "e", "s").mapInPandas(transfers, "key long, chunk int, m array<array<double>>"), "piece-matrices")
    tasks = max(1, matrices.count() // 256)  # else Spark would put the small matrices of many documents into one task
    states = written(matrices.repartition(tasks, "key").groupBy("key").applyInPandas(scan, "key long, chunk int, l array<int>, r array<int>"), "piece-states")
    traced = rows.filter("chunks > 1").join(states, ["key", "chunk"]).select("key", "doc_id", "chunk", "b", "e", "s", "l", "r").mapInPandas(trace, "key long, doc_id long, chunk int, ids binary")
    whole = traced.groupBy("key").applyInPandas(join, "key long, doc_id long, ids binary")
    return rows.filter("chunks = 1").select("key", "doc_id", "ids").union(whole.select("key", "doc_id", "ids"))


def decode(rows: DataFrame, path: str, ids_col: str = "ids", out: str = "decoded") -> DataFrame:
    """rows with the text of their ids; null for null, empty for none. Ids of any number are decoded whole; every other column stays, but
    one named like out, in any case, is replaced; repeated rows get the same text; no rows give no rows."""
    need(rows, ids_col)

    @F.pandas_udf("string")
    def text(column: pd.Series) -> pd.Series:
        sp = model(path).sp
        return pd.Series([None if x is None else sp.decode(np.frombuffer(x, np.uint32).tolist()) for x in column], dtype=object)

    return rows.withColumn(out, text(F.col(ids_col)))

