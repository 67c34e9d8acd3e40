"""Secret scan by a trigram index: Boolean trigram queries derived from the rules, posting lists, verification.

The index is partitioned by documents: each block of documents has its own posting lists, which hold the trigrams
that some rule's query names. A rule's query, ANDs and ORs of trigrams that any match must contain, is answered
by intersecting and uniting postings; the documents found are verified with the rule's expression on their
whole text. A rule from which no mandatory trigram follows scans every document.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from functools import lru_cache
from itertools import product
from re import _constants as sre, _parser as sre_parse

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from corpusmill.llm.bpe import slices
from corpusmill.llm.shared import need


@dataclass(frozen=True)
class Rule:
    """kind, a Python expression, the least length of the value, and the group that is the value (0: the match)."""

    kind: str
    pattern: str
    least: int
    group: int = 0


# The three base kinds.
BASE = (
    Rule("assign", r"(?ai:(password|passwd|secret|token|api_?key))[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", 6, 2),
    Rule("access", r"AKIA[A-Z0-9]+", 20),
    Rule("hex", r"[0-9a-f]+", 24),
)
MORE = (
    Rule("private_key", r"-----BEGIN [A-Z ]*PRIVATE KEY-----(?:[A-Za-z0-9+/=\s]*-----END [A-Z ]*PRIVATE KEY-----)?", 20),
    Rule("jwt", r"(?<![A-Za-z0-9_-])eyJ[A-Za-z0-9_-]+\.eyJ[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+", 30),
    Rule("github", r"(?:ghp|gho|ghu|ghs|ghr)_[A-Za-z0-9]+", 36),
    Rule("chat_token", r"xox[abprs]-[A-Za-z0-9-]+", 20),
    Rule("api_key", r"AIza[A-Za-z0-9_-]+", 39),
    Rule("live_key", r"sk_live_[A-Za-z0-9]+", 24),
)
RULES = BASE + MORE

_MOST = 16  # strings kept apart at one place of an expression; with more, that place counts as unknown


def trigram_query(pattern: str) -> tuple | None:
    """("and" | "or", operands) over lower-case trigrams that each match contains, or None: no trigram is mandatory."""
    return _simple(_walk(sre_parse.parse(pattern))[2])


def _walk(nodes):
    """(exact strings or None, as it ends in known text, query) of a sequence: strings are gathered as long as they are
    few, and each maximal run of known text gives an AND of its trigrams."""
    runs: list = [{""}]
    queries: list = []
    whole = True  # the run is all of the sequence so far

    def close() -> None:
        queries.append(_of(runs[0]))
        runs[0] = {""}

    for op, arg in nodes:
        options, query = _strings(op, arg)
        if options is None:
            queries.append(query)
            close()
            whole = False
        elif len(runs[0]) * len(options) <= _MOST:
            runs[0] = {a + b for a, b in product(runs[0], options)}
        else:
            close()
            runs[0] = options
            whole = False
    return runs[0] if whole else None, None, ("and", [*queries, _of(runs[0])])


def _strings(op, arg):
    """The strings that a node can match, or None if they are many, and the query that holds in any case."""
    if op is sre.LITERAL:
        return {chr(arg).lower()}, None
    if op is sre.IN:
        chars: set = set()
        for kind, x in arg:
            if kind is sre.LITERAL:
                chars.add(chr(x).lower())
            elif kind is sre.RANGE and x[1] - x[0] < 3 * _MOST:
                chars |= {chr(c).lower() for c in range(x[0], x[1] + 1)}
            else:
                return None, None
        return (chars, None) if len(chars) <= 8 else (None, None)
    if op is sre.SUBPATTERN:
        exact, _, query = _walk(arg[-1])
        return exact, query
    if op is sre.BRANCH:
        parts = [_walk(x) for x in arg[1]]
        exact = set().union(*(p[0] or () for p in parts)) if all(p[0] is not None for p in parts) else None
        return (exact if exact is not None and len(exact) <= _MOST else None), ("or", [p[2] for p in parts])
    if op in (sre.MAX_REPEAT, sre.MIN_REPEAT):
        least, most, sub = arg
        exact, _, query = _walk(sub)
        if exact is not None and most == 1 and len(exact) < _MOST:
            return exact | {""} if least == 0 else exact, query if least else None
        return None, query if least else None
    if op in (sre.AT, sre.ASSERT_NOT):
        return {""}, None
    return None, None


def _of(strings):
    """Each of the strings is in a match, or another of them: OR over them of the AND of their trigrams."""
    return ("or", [("and", [s[i : i + 3] for i in range(len(s) - 2)]) for s in sorted(strings)])


def _simple(query):
    """Without operands that say nothing; None if nothing is left. An OR with such an operand says nothing."""
    if query is None or isinstance(query, str):
        return query
    kind, parts = query
    parts = [_simple(p) for p in parts]
    if kind == "or" and any(p is None for p in parts):
        return None
    parts = list(dict.fromkeys(p if isinstance(p, str) else (p[0], tuple(p[1])) for p in parts if p is not None))
    return None if not parts else parts[0] if len(parts) == 1 else (kind, tuple(parts))


def _named(query) -> set[str]:
    return set() if query is None else {query} if isinstance(query, str) else set().union(*map(_named, query[1]))


class TrigramIndex:
    """Posting lists of the given trigrams over one block of texts."""

    def __init__(self, texts: pa.Array, table: np.ndarray, begins: np.ndarray, numbers: dict[str, int]):
        texts = texts.cast(pa.large_binary())
        offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
        data = np.frombuffer(texts.buffers()[2], np.uint8) if texts.buffers()[2] else np.zeros(0, np.uint8)
        self.numbers, self.n, self.postings = numbers, len(texts), {}
        found_at, found = [], []
        for a in range(int(offsets[0]), max(int(offsets[-1]) - 2, int(offsets[0])), 4 << 20):  # a few MB at a time
            x = _LOWER[data[a : min(a + (4 << 20) + 2, int(offsets[-1]))]]
            first = np.flatnonzero(begins[x[:-2]])  # few letters begin a named trigram
            b, c = x[first + 1], x[first + 2]
            codes = table[x[first].astype(np.int32) << 14 | (b & 127).astype(np.int32) << 7 | c & 127]
            hit = np.flatnonzero((codes > 0) & ((b | c) < 128))
            found.append(codes[hit])
            found_at.append(first[hit] + a)
        at, code = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (found_at, found))
        rows = np.searchsorted(offsets, at, side="right") - 1
        inside = at + 2 < offsets[np.minimum(rows + 1, self.n)]
        rows, code = rows[inside], code[inside]
        for number in np.unique(code):
            self.postings[int(number)] = np.unique(rows[code == number])

    def answer(self, query) -> np.ndarray:
        if query is None:
            return np.arange(self.n)
        if isinstance(query, str):
            return self.postings.get(self.numbers[query], np.zeros(0, np.int64))
        lists = sorted(map(self.answer, query[1]), key=len)
        out = lists[0]
        for x in lists[1:]:
            out = np.intersect1d(out, x, assume_unique=True) if query[0] == "and" else np.union1d(out, x)
        return out


_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


@lru_cache(maxsize=4)
def _compiled(rules: tuple[Rule, ...]):
    """Per rule its expression and query; the trigrams' numbers; a table from three bytes to a number; and the bytes that begin one.

    Trigrams beyond ASCII are left out of queries: case folding there is not byte by byte."""
    queries = [trigram_query(r.pattern) for r in rules]
    queries = [q if q is None or all(t.isascii() for t in _named(q)) else None for q in queries]
    numbers = {t: i + 1 for i, t in enumerate(sorted(set().union(*map(_named, queries))))}
    table = np.zeros(1 << 21, np.int16)
    for t, i in numbers.items():
        table[ord(t[0]) << 14 | ord(t[1]) << 7 | ord(t[2])] = i
    begins = np.zeros(256, bool)
    begins[[ord(t[0]) for t in numbers]] = True
    return [(r, re.compile(_longer(r)), q) for r, q in zip(rules, queries, strict=True)], numbers, table, begins


def _longer(rule: Rule) -> str:
    """A lone class with + finds maximal runs, so shorter runs need not be found to be dropped."""
    return rule.pattern[:-1] + f"{{{rule.least},}}" if rule.group == 0 and re.fullmatch(r"\[[^\]\\]+\]\+", rule.pattern) else rule.pattern


def find(texts: pa.Array, rules: tuple[Rule, ...] = RULES) -> list[list[tuple[int, str, int]]]:
    """(start, kind, end) of each text, by start, then in the order of rules; leftmost and not overlapping per kind."""
    compiled, numbers, table, begins = _compiled(rules)
    index = TrigramIndex(texts, table, begins, numbers)
    out: list[list] = [[] for _ in range(len(texts))]
    for k, (rule, expression, query) in enumerate(compiled):
        for row in index.answer(query).tolist():
            for m in expression.finditer(texts[row].as_py()):
                if m.end(rule.group) - m.start(rule.group) >= rule.least:
                    out[row].append((m.start(), k, m.end()))
    return [[(a, rules[k].kind, b) for a, k, b in sorted(x)] for x in out]


_SPANS = "array<struct<start:int,kind:string,end:int>>"


def scan(docs: DataFrame, text_col: str = "text", out: str = "spans", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """docs with an array of the secrets' spans: start, kind, end, in code points, the end exclusive.

    A null text has none. Every other column stays, but one named like out is replaced. Rows keep their order and
    number; a repeated row gets the same spans.
    """
    need(docs, text_col)

    @F.pandas_udf(_SPANS)
    def spans(texts: pd.Series) -> pd.Series:
        batch = pa.RecordBatch.from_arrays([pa.array(texts.fillna(""), pa.large_string())], names=["text"])
        got: list = []
        for part in slices(batch, "text"):
            got += [[{"start": a, "kind": kind, "end": b} for a, kind, b in x] for x in find(part.column(0), rules)]
        return pd.Series(got, dtype=object)

    return docs.withColumn(out, spans(F.col(text_col).cast("string")))


def of_kinds(spans: Column, kinds: tuple[str, ...]) -> Column:
    return F.filter(spans, lambda x: x["kind"].isin(*kinds))


def span_list(spans: Column, kinds: tuple[str, ...] = ()) -> Column:
    """kind:start:end, comma-joined, of the given kinds or all."""
    kept = of_kinds(spans, kinds) if kinds else spans
    return F.array_join(F.transform(kept, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ",")


def redact(docs: DataFrame, text_col: str = "text", spans_col: str = "spans", mark: str = "[secret]") -> DataFrame:
    """docs with each stretch of text_col that spans cover replaced by mark; spans that overlap or touch count as one.

    A null text, null spans and an empty list of them leave the text as it is. Expressions only: the text is cut between the spans. Every
    other column stays."""
    text, start, end = F.col(text_col), lambda s: s["start"], lambda s: s["end"]
    spans = F.array_sort(F.transform(spans_col, lambda s: F.struct(start(s).alias("start"), end(s).alias("end"))))
    first = F.struct(F.lit("").alias("done"), F.lit(-1).alias("at"))

    def add(acc: Column, s: Column) -> Column:
        apart = (acc["at"] < 0) | (start(s) > acc["at"])
        done = F.when(apart, F.concat(acc["done"], text.substr(F.greatest(acc["at"], F.lit(0)) + 1, start(s) - F.greatest(acc["at"], F.lit(0))), F.lit(mark))).otherwise(acc["done"])
        return F.struct(done.alias("done"), F.greatest(acc["at"], end(s)).alias("at"))

    redacted = F.aggregate(spans, first, add, lambda acc: F.concat(acc["done"], text.substr(acc["at"] + 1, F.length(text))))
    return docs.withColumn(text_col, F.when((F.size(spans_col) > 0) & text.isNotNull(), redacted).otherwise(text))
