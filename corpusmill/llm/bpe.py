"""Byte-level BPE ids of whole Arrow columns, from the tokenizers library.

A text splits exactly before a space that begins a run of white space or ends one, as the pre-tokenizer never
joins what stands on the two sides of such a place. So a column is cut at spaces by Arrow, each distinct chunk
is encoded once, and the chunks' ids are gathered with numpy. Texts with a space inside a run of white space,
and chunks with unusual characters, go through the library's own encode().
"""

from __future__ import annotations

import gc
import json
import os
import re
from array import array
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

# Fixed value: the pre-tokenizer's pattern for this vocabulary family.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
_WS = r"[\s\x0b\x1c-\x1f\x{85}\p{Z}]"
_INNER_SPACE = rf"{_WS} (?:{_WS}|$)"
_FEED = re.compile(r"(?<=\S)\n(?=\S)")


class BpeEncoder:
    """memo: once a worker remembers so many distinct chunks (some 60 bytes each), it encodes further ones anew."""

    def __init__(self, path: str, memo: int = 250_000):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import regex
        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            conf = json.load(f)
        pre, model = conf.get("pre_tokenizer") or {}, conf.get("model") or {}
        self.plain = (
            pre.get("type") == "ByteLevel" and not pre.get("add_prefix_space") and pre.get("use_regex", True) and not conf.get("normalizer") and not conf.get("truncation") and not conf.get("padding")
            and model.get("type", "BPE") == "BPE" and not model.get("dropout")
            and not any(x.get("lstrip") or x.get("rstrip") or x.get("single_word") or " " in x["content"] for x in conf.get("added_tokens", []))
        )
        self.added = [x["content"] for x in conf.get("added_tokens", [])]
        self.pattern = regex.compile(PATTERN)
        self.usual = regex.compile(r"[ -~\n\tÀ-ɏ]*")
        shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
        hidden = [b for b in range(256) if b not in set(shown)]
        self.bytes_table = {**{b: chr(b) for b in shown}, **{b: chr(256 + i) for i, b in enumerate(hidden)}}
        self.memo, self.short, self.words = memo, {}, {}
        self.keys, self.begin, self.sizes, self.ids = pa.array([], pa.large_string()), np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint32)

    def _whole(self, text: str) -> array:
        return array("I", self.tok.encode(text, add_special_tokens=False).ids)

    def _piece(self, piece: str) -> array:
        shown = piece.replace(" ", "\u0120") if piece.isascii() and piece.isprintable() else piece.encode().decode("latin-1").translate(self.bytes_table)
        return array("I", [t.id for t in self.tok.model.tokenize(shown)])

    def _chunk(self, chunk: str) -> array:
        """Ids of a chunk. A line feed between characters that are no white space is a piece of its own, so lines are coded one by one."""
        if "\n" not in chunk or any(a in chunk for a in self.added):
            return self._line(chunk)
        out, feed = array("I"), self._short("\n")
        for i, line in enumerate(_FEED.split(chunk)):
            if i:
                out += feed
            out += self._line(line)
        return out

    def _line(self, chunk: str) -> array:
        head = chunk.rstrip(".,")
        if head[:1] == " " and head[1:].isalpha():
            got = self.words.get(head)
            if got is None:
                got = self._piece(head)
                if len(self.words) < self.memo // 5:
                    self.words[head] = got
            return got if len(head) == len(chunk) else got + self._short(chunk[len(head) :])
        if not chunk.isascii() and head.isalpha():
            return self._piece(head) + (self._short(chunk[len(head) :]) if len(head) < len(chunk) else array("I"))
        if not self.usual.fullmatch(chunk) or any(a in chunk for a in self.added):
            return self._whole(chunk)
        out = array("I")
        for piece in self.pattern.findall(chunk):
            out += self._short(piece)
        return out

    def _short(self, piece: str) -> array:
        """Remembers pieces of one or two characters only, so that what it holds has a bound."""
        if len(piece) > 2:
            return self._piece(piece)
        got = self.short.get(piece)
        if got is None:
            got = self._piece(piece)
            if len(self.short) < self.memo // 5:
                self.short[piece] = got
        return got

    def _encoded(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of distinct chunks: where each one's ids begin, how many they are, and the ids."""
        at = np.asarray(pc.fill_null(pc.index_in(words, value_set=self.keys), -1)).astype(np.int64)
        new = np.flatnonzero(at < 0)
        gc.disable()  # it would walk the library's many small objects again and again
        got = [self._chunk(w) for w in words.take(pa.array(new)).to_pylist()]
        gc.enable()
        lens = np.fromiter(map(len, got), np.int64, len(got))
        fresh = np.frombuffer(b"".join(got), dtype=np.uint32)
        begin = np.where(at >= 0, self.begin[at] if len(self.begin) else 0, 0)
        sizes = np.where(at >= 0, self.sizes[at] if len(self.sizes) else 0, 0)
        begin[new], sizes[new] = len(self.ids) + np.cumsum(lens) - lens, lens
        table = np.concatenate([self.ids, fresh])
        if len(self.keys) < self.memo:
            self.keys = pa.concat_arrays([self.keys, words.take(pa.array(new))])
            self.begin, self.sizes, self.ids = np.concatenate([self.begin, begin[new]]), np.concatenate([self.sizes, lens]), table
        return begin, sizes, table

    def encode(self, texts: pa.Array, end_id: int | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Offsets (one more than texts) and ids (uint32) of a string array; null counts as empty; end_id closes each text."""
        texts = texts.cast(pa.large_string()).fill_null("")
        n = len(texts)
        if n == 0:
            return np.zeros(1, np.int64), np.zeros(0, np.uint32)
        odd = np.asarray(pc.match_substring_regex(texts, _INNER_SPACE)) if self.plain else np.ones(n, bool)
        cut = pc.split_pattern(pc.if_else(pa.array(odd), "", texts), " ")
        starts = np.asarray(cut.offsets).astype(np.int64)
        starts, flat = starts - starts[0], cut.flatten()
        coded = pc.dictionary_encode(flat)
        codes, words = np.asarray(coded.indices).astype(np.int64), coded.dictionary
        first, at = np.unique(codes[starts[:-1]], return_inverse=True)
        codes[starts[:-1]] = len(words) + at
        spaced = pc.binary_join_element_wise(pa.scalar("", pa.large_string()), words, pa.scalar(" ", pa.large_string()))
        begin, lens, table = self._encoded(pa.concat_arrays([spaced, words.take(pa.array(first))]))
        if end_id is not None:  # one more chunk at the end of each text
            table, lens, begin = np.append(table, np.uint32(end_id)), np.append(lens, 1), np.append(begin, len(table))
            codes = np.insert(codes, starts[1:], len(lens) - 1)
            starts = starts + np.arange(n + 1)
        sizes = lens[codes]
        ends = np.cumsum(sizes)
        total = int(ends[-1]) if len(ends) else 0
        ids = table[np.repeat(begin[codes] - (ends - sizes), sizes) + np.arange(total)]
        offsets = np.concatenate([[0], ends])[starts]
        if odd.any():
            return self._with_odd(texts, odd, offsets, ids, end_id)
        return offsets, ids

    def _with_odd(self, texts, odd, offsets, ids, end_id):
        tail = array("I", [] if end_id is None else [end_id])
        parts = [(self._whole(texts[i].as_py()) + tail).tobytes() if odd[i] else ids[offsets[i] : offsets[i + 1]].tobytes() for i in range(len(texts))]
        lens = np.fromiter((len(p) // 4 for p in parts), np.int64, len(parts))
        return np.concatenate([[0], np.cumsum(lens)]), np.frombuffer(b"".join(parts), dtype=np.uint32)


@lru_cache(maxsize=4)
def encoder(path: str) -> BpeEncoder:
    """One encoder a worker process, so that its memo serves all tasks of that worker."""
    return BpeEncoder(path)


def slices(batch: pa.RecordBatch, column: str, most: int = 4 << 20):
    """The batch in runs of rows whose texts take about `most` bytes, a single longer text being a run of its own."""
    lens = np.asarray(pc.fill_null(pc.binary_length(batch.column(column)), 0)).astype(np.int64)
    at, held = 0, 0
    for i, size in enumerate(lens.tolist()):
        if held and held + size > most:
            yield batch.slice(at, i - at)
            at, held = i, 0
        held += size
    if at < batch.num_rows:
        yield batch.slice(at)
