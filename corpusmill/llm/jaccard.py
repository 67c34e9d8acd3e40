"""Exact n-gram Jaccard join by grouped prefixes.

Documents with equal shingle sets are one class, and classes with equal prefixes and sizes form one group. The prefix of
a group is the n - ceil(t n) + l smallest hashes of its n shingles: two documents of similarity t or more have at
least min(l, l') of them in common. So shingles that no other group's prefix has are dropped, and a group
with fewer than that left has no partner. Of what is left, ordered by the number of groups that have it, the rarest
lead to candidates. In each such bucket the groups are compared with one leader first; after the links that this
gives, only groups of different components still meet. Group pairs are filtered by size, expanded to their
members, and verified on the whole sets.

Prefix shingles are packed into blocks, a row for each of many buckets, whose number grows with the input. Shingles
that very many groups have are found beforehand; they need no counting, come last in the order, and are dealt out by group.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

from corpusmill.llm.bpe import slices
from corpusmill.llm.graph import components, forest
from corpusmill.llm.shared import arrow_rows, discard, need, perhaps, written

_BASE = np.uint64(0x9E3779B97F4A7C55)
_SLICE, _ROWS = 1 << 20, 1000  # bytes of text at once; rows that go to a Python worker at once


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection on 64-bit numbers that spreads every bit."""
    x = x.astype(np.uint64, copy=True)
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        x ^= x >> np.uint64(shift)
        x *= np.uint64(factor)
    return x ^ (x >> np.uint64(31))


def _words(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Number of words of each text, and the words' SipHash values in order."""
    split = pc.ascii_split_whitespace(texts.cast(pa.large_string()).fill_null(""))
    flat, counts = split.flatten().cast(pa.large_binary()), np.asarray(pc.list_value_length(split)).astype(np.int64)
    some = np.asarray(pc.binary_length(flat)) > 0
    doc = np.repeat(np.arange(len(counts)), counts)[some]
    coded = pc.dictionary_encode(flat.filter(pa.array(some)))
    lower = np.array([None, *(w.lower() for w in coded.dictionary.to_pylist())], object)[1:]  # of bytes, so A-Z only
    hashes = pd.util.hash_array(lower, categorize=False) if len(lower) else np.zeros(0, np.uint64)
    return np.bincount(doc, minlength=len(counts)), hashes[np.asarray(coded.indices)]


_ONE = np.ones(1, bool)


def shingle_sets(texts: pa.Array, k: int) -> list[np.ndarray]:
    """Of each text the sorted distinct 64-bit hashes of its k-word shingles; with fewer words, of all of them as one."""
    counts, words = _words(texts)
    at = np.concatenate([[0], np.cumsum(counts)])
    h = words[: max(0, len(words) - k + 1)].copy()
    for j in range(1, k):
        h = mix(h * _BASE + words[j : j + len(h)])
    out = []
    for i, n in enumerate(counts.tolist()):
        a = at[i]
        if n >= k:
            x = np.sort(h[a : a + n - k + 1])
            out.append(x[np.concatenate([_ONE, x[1:] != x[:-1]])])
        elif n:
            x = words[a : a + 1].copy()
            for j in range(1, n):
                x = mix(x * _BASE + words[a + j : a + j + 1])
            out.append(mix(x + np.uint64(n)))
        else:
            out.append(np.zeros(0, np.uint64))
    return out


class Bounds:
    """What similarity num / den or more means for a set of n shingles."""

    def __init__(self, num: int, den: int):
        self.num, self.den = num, den

    def overlap(self, n):
        """Shingles in common with any partner, at least."""
        return -(-self.num * n // self.den)

    def extra(self, n):
        return np.maximum(1, 2 * (self.den - self.num) * n // (3 * self.den))

    def prefix(self, n):
        return np.minimum(n, n - self.overlap(n) + self.extra(n))

    def shared(self, n):
        """Prefix shingles in common with any partner, at least: of the smallest one, which has overlap(n) shingles."""
        return self.extra(self.overlap(n))

    def fit(self, n, m):
        """Column: sizes of which one set may be as similar to the other as asked for."""
        return self.den * F.least(n, m) >= self.num * F.greatest(n, m)

    def linked(self, a: np.ndarray, b: np.ndarray) -> bool:
        common = len(np.intersect1d(a, b, assume_unique=True))
        return self.den * common >= self.num * (len(a) + len(b) - common)


def _low(q: np.ndarray) -> np.ndarray:
    """The size that a step of a twelfth of a power of two stands for, at most as large as the sizes of that step."""
    return np.maximum(1, np.floor(2.0 ** (q / 12) * (1 - 1e-9))).astype(np.int64)


def _step(n: np.ndarray) -> np.ndarray:
    return np.minimum(255, np.floor(12 * np.log2(np.maximum(n, 1)))).astype(np.uint8)


def _sums(sets: list[np.ndarray], salt: int) -> np.ndarray:
    """A hash of each set, independent of order."""
    n = np.array([len(s) for s in sets], np.int64)
    out, some = np.zeros(len(sets), np.uint64), n > 0
    if some.any():
        flat = mix(np.concatenate(sets) + np.uint64(salt))
        out[some] = np.add.reduceat(flat, (np.cumsum(n) - n)[some])
    return out


def _prefixes(sets: list[np.ndarray], bounds: Bounds) -> tuple[np.ndarray, list[np.ndarray], np.ndarray, np.ndarray]:
    """Sizes, prefixes, the group of each (which stands for prefix and size), and a second hash of it."""
    n = np.array([len(s) for s in sets], np.int64)
    p = [s[:m] for s, m in zip(sets, bounds.prefix(n).tolist(), strict=True)]
    return n, p, mix(_sums(p, 3) + n.astype(np.uint64)).view(np.int64), mix(_sums(p, 5) ^ n.astype(np.uint64)).view(np.int64)


class _Seen:
    """The groups that a task has met."""

    def __init__(self):
        self.held: set = set()

    def new(self, g: np.ndarray, g2: np.ndarray, n: np.ndarray) -> list[int]:
        out = []
        for i, key in enumerate(zip(g.tolist(), g2.tolist(), strict=True)):
            if n[i] and key not in self.held:
                self.held.add(key)
                out.append(i)
        return out


def _scatter(bucket: np.ndarray, *columns: np.ndarray) -> list[tuple]:
    """A row for each bucket that occurs, with its entries of the columns as binary."""
    order = np.argsort(bucket, kind="stable")
    bucket = bucket[order]
    cuts, counts = _runs(bucket)
    columns = [c[order] for c in columns]
    return [(int(bucket[a]), *(c[a : a + n].tobytes() for c in columns)) for a, n in zip(cuts.tolist(), counts.tolist(), strict=True)]


def _blocks(rows: list[tuple], names: str):
    schema = pa.schema([(n, pa.int32() if n == "bucket" else pa.binary()) for n in names.split()])
    for a in range(0, len(rows), 4096):
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows[a : a + 4096], strict=True), schema, strict=True)], schema=schema)


def _by_bucket(batches):
    """(bucket, columns as lists of binary) of rows that are sorted by bucket; one bucket is held at a time."""
    at, held = None, []
    for batch in batches:
        columns = [batch.column(i).to_pylist() for i in range(batch.num_columns)]
        for row in zip(*columns, strict=True):
            if row[0] != at:
                if held:
                    yield at, list(zip(*held, strict=True))[1:]
                at, held = row[0], []
            held.append(row)
    if held:
        yield at, list(zip(*held, strict=True))[1:]


def _runs(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    cuts = np.flatnonzero(np.concatenate([_ONE, x[1:] != x[:-1]])) if len(x) else np.zeros(0, int)
    return cuts, np.append(cuts[1:], len(x))[: len(cuts)] - cuts


_PACKED = "bucket int, tok binary, g binary, q binary"


class _Source:
    """The texts to be joined, and what is made of them task by task."""

    def __init__(self, docs: DataFrame, id_col: str, text_col: str, k: int, bounds: Bounds):
        text = F.col(text_col).cast("string")
        self.k, self.bounds = k, bounds
        self.rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), text.alias("text"), F.xxhash64(text).alias("t"))

    def hashed(self, chunk: int = 1 << 21, listed: int = 8) -> DataFrame:
        """doc_id, t (hash of the text), n, h1 and h2 (for the set), g (for prefix and size) of each row. Rows with n = -1 list, in often,
        the prefix shingles that at least `listed` of the groups in a run of `chunk` prefix shingles have, and their numbers."""
        k, bounds = self.k, self.bounds
        types = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary()]
        names = ["doc_id", "t", "n", "h1", "h2", "g", "often"]

        def often(held: list[np.ndarray]):
            tok, count = np.unique(np.concatenate(held), return_counts=True)
            tok, count = tok[count >= listed], count[count >= listed]
            packed = tok.tobytes() + count.astype(np.uint64).tobytes()
            return pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip((None, 0, -1, 0, 0, 0, packed), types, strict=True)], names=names)

        def run(batches):
            seen, held, size = _Seen(), [], 0
            for whole in batches:
                for batch in slices(whole, "text", _SLICE):
                    sets = shingle_sets(batch.column(1), k)
                    n, p, g, g2 = _prefixes(sets, bounds)
                    yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(n), pa.array(_sums(sets, 1).view(np.int64)), pa.array(_sums(sets, 2).view(np.int64)), pa.array(g), pa.nulls(len(n), pa.binary())], names=names)
                    for i in seen.new(g, g2, n):
                        held.append(p[i])
                        size += len(p[i])
                    if size >= chunk:
                        yield often(held)
                        held, size = [], 0
            if held:
                yield often(held)

        return self.rows.mapInArrow(run, "doc_id long, t long, n long, h1 long, h2 long, g long, often binary")

    def blocks(self, buckets: int, hot: np.ndarray) -> DataFrame:
        """Prefix shingles by bucket: tok (4 bytes, which with the bucket name the shingle), g and size of each group that a task meets.
        Shingles in hot (sorted) go to buckets by group, from `buckets` on, with tok as 8 bytes."""
        k, bounds = self.k, self.bounds

        def run(batches):
            seen = _Seen()
            for whole in batches:
                for batch in slices(whole, "text", _SLICE):
                    n, p, g, g2 = _prefixes(shingle_sets(batch.column(1), k), bounds)
                    new = seen.new(g, g2, n)
                    if not new:
                        continue
                    lens = np.array([len(p[i]) for i in new])
                    raw = np.concatenate([p[i] for i in new])
                    name = _names(raw, buckets)
                    owner = np.repeat(np.arange(len(new)), lens)
                    own, q = g[new], _step(n[new])
                    order = np.lexsort((name, owner))
                    same = (owner[order][1:] == owner[order][:-1]) & (name[order][1:] == name[order][:-1])
                    if same.any():  # shingles of one set with one name: the group asks for as many fewer in common
                        for i, c in zip(*np.unique(owner[order][1:][same], return_counts=True), strict=True):
                            want = max(1, int(bounds.shared(n[new[i]])) - int(c))
                            while q[i] and bounds.shared(_low(q[i : i + 1]))[0] > want:
                                q[i] -= 1
                    is_hot = hot[np.minimum(np.searchsorted(hot, raw), len(hot) - 1)] == raw if len(hot) else np.zeros(len(raw), bool)
                    cold, warm = ~is_hot, np.flatnonzero(is_hot)
                    rows = _scatter((name & np.uint64(buckets - 1))[cold].astype(np.int64), (name[cold] >> np.uint64(32)).astype(np.uint32), own[owner[cold]], q[owner[cold]])
                    if len(warm):
                        rows += _scatter(buckets + (mix(own[owner[warm]].view(np.uint64)) & np.uint64(buckets - 1)).astype(np.int64), name[warm], own[owner[warm]], q[owner[warm]])
                    yield from _blocks(rows, "bucket tok g q")

        return self.rows.mapInArrow(run, _PACKED)

    def sets(self, reps: DataFrame, most: int = 1_000_000) -> DataFrame:
        """node and s (the whole set) of the documents in reps: node, doc_id, t; a written table, which is broadcast while it has `most`
        rows at most (24 bytes each), so that only the sets are shuffled; beyond that the texts that reps name are, by their hash. Equal rows of
        the input repeat."""
        k = self.k

        def run(batches):
            for whole in batches:
                for batch in slices(whole, "text", _SLICE):
                    yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([s.tobytes() for s in shingle_sets(batch.column(1), k)], pa.binary())], names=["node", "s"])

        wanted = reps.select("node", F.col("doc_id").alias("r_id"), F.col("t").alias("r_t"))
        if reps.count() <= most:
            rows, wanted = self.rows, F.broadcast(wanted)
        else:
            keys = wanted.select(F.xxhash64("r_id", "r_t").alias("key"))
            rows = perhaps(self.rows, F.xxhash64("doc_id", "t"), keys).filter("perhaps").drop("perhaps")
        found = rows.join(wanted, (F.col("t") == F.col("r_t")) & F.col("doc_id").eqNullSafe(F.col("r_id")))
        return found.select("node", "text").mapInArrow(run, "node long, s binary")


def _names(tok: np.ndarray, buckets: int) -> np.ndarray:
    """The lowest bits are a shingle's bucket, the upper 32 its name there; nothing in between."""
    return mix(tok) & np.uint64(0xFFFFFFFF << 32 | buckets - 1)


def hot_shingles(rows: DataFrame, most: int) -> np.ndarray:
    """Sorted prefix shingles that are listed with `most` groups or more. There are at most as many as the input has prefix shingles,
    divided by `most`; each takes 8 bytes on the driver and in the tasks."""

    def listed(batches):
        for batch in batches:
            for x in batch.column(0).to_pylist():
                tok, count = np.split(np.frombuffer(x, np.uint64), 2)
                yield pa.RecordBatch.from_arrays([pa.array(tok.view(np.int64)), pa.array(count.view(np.int64))], names=["tok", "c"])

    counts = rows.filter("n = -1").select("often").mapInArrow(listed, "tok long, c long").groupBy("tok").agg(F.sum("c").alias("c"))
    return np.sort(np.array([r.tok for r in counts.filter(F.col("c") >= most).select("tok").collect()], np.int64).view(np.uint64))


def candidate_keys(blocks: DataFrame, buckets: int, bounds: Bounds) -> DataFrame:
    """tok, g, m: the buckets that each group is in, and how many of its prefix shingles other groups have."""
    counted = _PACKED + ", often binary"

    def shared_only(batches):
        for bucket, (toks, gs, qs) in _by_bucket(batches):
            if bucket >= buckets:
                tok, g, q = (np.frombuffer(b"".join(x), t) for x, t in ((toks, np.uint64), (gs, np.int64), (qs, np.uint8)))
                many = np.ones(len(tok), bool)
                df = np.full(len(tok), 255, np.uint8)
            else:
                tok, g, q = (np.frombuffer(b"".join(x), t) for x, t in ((toks, np.uint32), (gs, np.int64), (qs, np.uint8)))
                order = np.lexsort((q, g, tok))
                tok, g, q = tok[order], g[order], q[order]
                first = np.concatenate([_ONE, (tok[1:] != tok[:-1]) | (g[1:] != g[:-1])]) if len(tok) else np.zeros(0, bool)
                tok, g, q = tok[first], g[first], q[first]  # tasks that met the same group
                _, counts = _runs(tok)
                df = np.repeat(np.minimum(254, 6 * np.log2(counts)).astype(np.uint8), counts)
                many = np.repeat(counts > 1, counts)
                tok = tok.astype(np.uint64) << np.uint64(32) | np.uint64(bucket)
            yield from _blocks(_scatter((mix(g[many].view(np.uint64)) & np.uint64(buckets - 1)).astype(np.int64), tok[many], g[many], q[many], df[many]), "bucket tok g q often")

    def rarest(batches):
        for _, columns in _by_bucket(batches):
            tok, g, q, df = (np.frombuffer(b"".join(x), t) for x, t in zip(columns, (np.uint64, np.int64, np.uint8, np.uint8), strict=True))
            order = np.lexsort((tok, df, g))
            tok, g, q = tok[order], g[order], q[order]
            first = np.concatenate([_ONE, (tok[1:] != tok[:-1]) | (g[1:] != g[:-1])]) if len(tok) else np.zeros(0, bool)
            least = np.minimum.reduceat(q, _runs(g)[0]) if len(g) else q
            tok, g = tok[first], g[first]
            cuts, m = _runs(g)
            keep = np.arange(len(g)) - np.repeat(cuts, m) < np.repeat(m - bounds.shared(bounds_low(least)) + 1, m)
            yield pa.RecordBatch.from_arrays([pa.array(tok[keep].view(np.int64)), pa.array(g[keep]), pa.array(np.repeat(m, m)[keep])], names=["tok", "g", "m"])

    bounds_low = _low
    dealt = blocks.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(shared_only, counted)
    return dealt.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(rarest, "tok long, g long, m long")


_PAIR = "a long, b long"


def leader_pairs(keys: DataFrame, bounds: Bounds) -> DataFrame:
    """a < b: in each bucket the group with the largest part of its prefix shared, with all that fit it in size.
    keys: tok, gid, n, m. Leaders are an aggregate, so no bucket is gathered."""
    leads = keys.groupBy("tok").agg(F.max_by(F.struct("gid", "n"), F.struct(F.col("m") / F.col("n"), -F.col("gid"))).alias("l"), F.count(F.lit(1)).alias("size")).filter("size > 1")
    met = keys.join(leads.select("tok", F.col("l.gid").alias("lead"), F.col("l.n").alias("lead_n")), "tok").filter((F.col("gid") != F.col("lead")) & bounds.fit(F.col("n"), F.col("lead_n")))
    return met.select(F.least("gid", "lead").alias("a"), F.greatest("gid", "lead").alias("b")).distinct()


def cross_pairs(keys: DataFrame, bounds: Bounds, small: int = 64) -> tuple[DataFrame, DataFrame]:
    """Of the buckets with several components, pairs a < b and shards. keys: tok, node, n, component.

    Buckets of up to `small` documents give the pairs that fit in size and are in different components; larger ones
    (shard, node, component), where the shard is named by its smallest document; shards of many buckets coincide, as
    large buckets come from the same copies or passages."""
    stats = keys.groupBy("tok").agg(F.min("component").alias("low"), F.max("component").alias("high"), F.count(F.lit(1)).alias("size"), F.min("node").alias("shard")).filter("low <> high")
    several = written(keys.join(stats.drop("low", "high"), "tok"), "several")
    a = several.filter(F.col("size") <= small).select("tok", F.col("node").alias("a"), F.col("n").alias("a_n"), F.col("component").alias("a_c"))
    b = a.select("tok", F.col("a").alias("b"), F.col("a_n").alias("b_n"), F.col("a_c").alias("b_c"))
    pairs = a.join(b, "tok").filter((F.col("a") < F.col("b")) & (F.col("a_c") != F.col("b_c")) & bounds.fit(F.col("a_n"), F.col("b_n"))).select("a", "b").distinct()
    return pairs, several.filter(F.col("size") > small).select("shard", F.col("node").alias("id"), "component").distinct()


def shard_links(shards: DataFrame, sets: DataFrame, bounds: Bounds, block: int = 512) -> DataFrame:
    """a, b: links that join the components of the documents of each shard. shards: shard, id, component; sets: id, s.

    Documents are laid into blocks, those of a large component into blocks of their own, and pairs of blocks
    compared, but for two of one component. A pair of blocks gives at most as many links as it has documents.
    """
    sized = shards.groupBy("shard", "component").agg(F.count(F.lit(1)).alias("c"))
    sized = sized.withColumn("kind", F.when(F.col("c") >= block // 2, F.col("component")))
    kinds = sized.groupBy("shard", "kind").agg(F.ceil(F.sum("c") / block).cast("int").alias("blocks"))
    kinds = written(kinds.select("shard", F.coalesce(F.col("kind").cast("string"), F.lit("-")).alias("kind"), "blocks"), "shard-kinds")
    named = shards.join(written(sized.select("shard", "component", F.coalesce(F.col("kind").cast("string"), F.lit("-")).alias("kind")), "shard-components"), ["shard", "component"])
    own = named.join(kinds, ["shard", "kind"]).withColumn("own", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int"))
    other = kinds.select(F.col("shard").alias("of"), F.col("kind").alias("o_kind"), F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("o"))
    me, it = F.concat_ws(":", "kind", "own"), F.concat_ws(":", "o_kind", "o")
    met = own.join(other, (F.col("shard") == F.col("of")) & ((F.col("kind") != F.col("o_kind")) | (F.col("kind") == "-")))
    met = met.select("shard", F.least(me, it).alias("i"), F.greatest(me, it).alias("j"), (me <= it).alias("left"), (me >= it).alias("right"), "id", "component")
    rows = met.join(sets.withColumnRenamed("id", "s_id"), F.col("id") == F.col("s_id")).drop("s_id")

    def compare(table: pa.Table) -> pa.Table:
        left, right = (np.asarray(table.column(c).combine_chunks().cast(pa.int8())).astype(bool) for c in ("left", "right"))
        ids, comp = (np.asarray(table.column(c).combine_chunks()) for c in ("id", "component"))
        sets = [np.frombuffer(x, np.uint64) for x in table.column("s").to_pylist()]
        n = np.array([len(x) for x in sets])
        _, tok = np.unique(np.concatenate(sets), return_inverse=True)
        doc = np.repeat(np.arange(len(sets)), n)
        often = np.bincount(tok)
        common = np.zeros((len(sets), len(sets)), np.float32)
        order = np.argsort(tok, kind="stable")
        tok, doc = tok[order], doc[order]
        keep = often[tok] > 1
        tok, doc = np.unique(tok[keep], return_inverse=True)[1], doc[keep]
        for a in range(0, int(tok.max()) + 1 if len(tok) else 0, 4096):  # some shingles at a time
            lo, hi = np.searchsorted(tok, (a, a + 4096))
            x = np.zeros((len(sets), 4096), np.float32)
            x[doc[lo:hi], tok[lo:hi] - a] = 1
            common += x @ x.T
        common = common.astype(np.int64)
        ok = bounds.den * common >= bounds.num * (n[:, None] + n[None, :] - common)
        ok &= (left[:, None] & right[None, :]) & (comp[:, None] != comp[None, :])
        i, j = np.nonzero(ok)
        names, at = np.unique(comp, return_inverse=True)  # one link is enough to join two components
        a, b = forest(len(names), at[i], at[j])
        return pa.table({"a": pa.array(names[a]), "b": pa.array(names[b])})

    return rows.groupBy("shard", "i", "j").applyInArrow(compare, _PAIR)


def hot_nodes(pairs: DataFrame, block: int = 256) -> DataFrame:
    """node and blocks of those with more than `block` pairs in either role, as the leaders of large buckets; a written table."""
    ends = pairs.select(F.explode(F.array("a", "b")).alias("h_node")).groupBy("h_node").agg(F.count(F.lit(1)).alias("c"))
    return written(ends.filter(F.col("c") > block).select("h_node", F.ceil(F.col("c") / block).cast("int").alias("blocks")), "jaccard-hot-nodes")


def verified(pairs: DataFrame, sets: DataFrame, hot: DataFrame, bounds: Bounds) -> DataFrame:
    """The pairs whose sets are as similar as asked for. sets: node, s, where rows may repeat; hot: of hot_nodes(pairs).

    The pairs of a hot node are dealt out to its blocks by their other node, and its set goes to each of the blocks, so no task gets all of
    them. Both joins read one shuffle of the sets, which also drops the repeats."""

    def check(batches):
        for batch in batches:
            a, b, x, y = (batch.column(i) for i in range(4))
            ok = [bounds.linked(np.frombuffer(p.as_buffer(), np.uint64), np.frombuffer(q.as_buffer(), np.uint64)) for p, q in zip(x, y, strict=True)]
            yield pa.RecordBatch.from_arrays([a, b], names=["a", "b"]).filter(pa.array(ok, pa.bool_()))

    blocks = F.coalesce("blocks", F.lit(1))
    each = sets.join(hot, F.col("node") == F.col("h_node"), "left").select("node", "s", F.explode(F.sequence(F.lit(0), blocks - 1)).alias("block_")).dropDuplicates(["node", "block_"])

    def with_set(met: DataFrame, end: str, other: str, out: str) -> DataFrame:
        dealt = met.join(hot, F.col(end) == F.col("h_node"), "left").withColumn("block_", F.pmod(F.xxhash64(other), blocks).cast("int")).drop("h_node", "blocks")
        return dealt.join(each.select(F.col("node").alias(end), "block_", F.col("s").alias(out)), [end, "block_"]).drop("block_")

    both = with_set(with_set(pairs, "b", "a", "y"), "a", "b", "x")
    return both.select("a", "b", "x", "y").mapInArrow(check, _PAIR)


def joined_rows(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = 4, num: int = 85, den: int = 100, most: int = 1 << 20, bucket: int = 1 << 20) -> DataFrame:
    """doc_id, t (xxhash64 of the text), n_shingles, component_id (the smallest id that links lead to) and component (a number
    for it) of every row.

    Words are [^\\x20\\x09-\\x0D]+ with A-Z lower-cased; a text with fewer than k words has them as one shingle. Two
    rows link when den * intersection >= num * union. Rows whose text is null, or has no words, link with nothing: n_shingles is 0,
    component null, component_id their own id. Rows with one id and different texts are different documents; equal rows are
    linked. Where all ids of a component are null, component_id is null. Texts of any length are taken whole. No rows give no rows; other
    columns are not read. most: a shingle that so many groups have is dealt out by group. bucket: shingles of a bucket, on average.
    """
    need(docs, id_col, text_col)
    spark, bounds = docs.sparkSession, Bounds(num, den)
    source = _Source(docs, id_col, text_col, k, bounds)
    with arrow_rows(spark, _ROWS):
        hashed = written(source.hashed(), "jaccard-rows")
    rows = hashed.filter("n >= 0")
    numbered = rows.filter("n > 0").groupBy("n", "h1", "h2", "g").agg(F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "t")).alias("rep"))
    classes = written(numbered.select("n", "h1", "h2", "g", F.col("rep.doc_id").alias("doc_id"), F.col("rep.t").alias("t"), F.monotonically_increasing_id().alias("node")), "jaccard-classes")
    groups = written(classes.groupBy("n", "g").agg(F.min("node").alias("gid"), F.count(F.lit(1)).alias("members")), "jaccard-groups")
    members = written(classes.join(groups, ["n", "g"]).select("gid", "node", "n", "members"), "jaccard-members")

    total = (rows.agg(F.sum("n")).first()[0] or 0) * 5 * (den - num) // (3 * den)
    buckets = min(1 << 22, max(1024, 1 << (total // bucket).bit_length()))
    with arrow_rows(spark, _ROWS):
        found = candidate_keys(source.blocks(buckets, hot_shingles(hashed, most)), buckets, bounds)
        found = written(found, "jaccard-found")
    keys = written(found.join(groups.select("g", "gid", "n"), "g").select("tok", "gid", "n", "m"), "jaccard-keys")

    def links_of(pairs: DataFrame, name: str) -> DataFrame:
        ids = pairs.select(F.col("a").alias("node")).union(pairs.select("b")).distinct()
        wanted = written(classes.join(ids, "node", "left_semi").select("node", "doc_id", "t"), name + "-ids")
        hot = hot_nodes(pairs)
        with arrow_rows(spark, _ROWS):
            out = written(verified(pairs, source.sets(wanted), hot, bounds), name + "-links")
        discard(wanted, hot)
        return out

    inner = members.filter("members > 1 and gid <> node").select(F.col("gid").alias("a"), F.col("node").alias("b"))
    tested = written(leader_pairs(keys, bounds).union(inner).distinct(), "jaccard-leader-pairs")
    stars = links_of(tested, "jaccard-leader")
    known = written(components(stars), "jaccard-components")
    member = members.join(known.withColumnRenamed("node", "of"), F.col("node") == F.col("of"), "left").select("gid", "node", "n", "members", F.coalesce("component", "node").alias("component"))
    member = written(member, "jaccard-member-components")
    met = keys.select("tok", "gid").join(member, "gid").select("tok", "node", "n", "component")
    met = met.union(member.filter("members > 1").select(F.xxhash64(F.lit("group"), "gid"), "node", "n", "component"))  # a group is a bucket, too
    pairs, shards = cross_pairs(met, bounds)
    left = written(pairs.join(tested, ["a", "b"], "left_anti"), "jaccard-cross-pairs")
    more = links_of(left, "jaccard-cross")
    shards = written(shards, "jaccard-shards")
    if not shards.isEmpty():
        ids = written(classes.join(shards.select(F.col("id").alias("node")).distinct(), "node", "left_semi").select("node", "doc_id", "t"), "jaccard-shard-ids")
        with arrow_rows(spark, _ROWS):
            across = written(shard_links(shards, source.sets(ids).dropDuplicates(["node"]).withColumnRenamed("node", "id"), bounds), "jaccard-shard-links")
        discard(ids)
        more = more.union(across)
    comps = written(components(stars.union(more)), "jaccard-components")
    of_class = classes.join(comps.withColumnRenamed("node", "of"), F.col("node") == F.col("of"), "left").select("n", "h1", "h2", "g", "doc_id", F.coalesce("component", "node").alias("component"))
    of_class = written(of_class, "jaccard-class-components")
    least = of_class.groupBy(F.col("component").alias("of")).agg(F.min("doc_id").alias("least"), F.count(F.lit(1)).alias("c")).filter("c > 1")
    least = written(least.select("of", "least"), "jaccard-least")  # a table of its own, so that the join splits large components, or needs no shuffle
    of_class = of_class.join(least, F.col("component") == F.col("of"), "left").withColumn("component_id", F.when(F.col("of").isNull(), F.col("doc_id")).otherwise(F.col("least")))
    named = written(of_class.select(F.col("n").alias("c_n"), F.col("h1").alias("c_h1"), F.col("h2").alias("c_h2"), F.col("g").alias("c_g"), "component", "component_id"), "jaccard-classes")
    out = rows.drop("often").join(named, (F.col("h1") == F.col("c_h1")) & (F.col("h2") == F.col("c_h2")) & (F.col("n") == F.col("c_n")) & (F.col("g") == F.col("c_g")), "left")
    out = written(out.select("doc_id", "t", F.col("n").alias("n_shingles"), F.when(F.col("component").isNull(), F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"), "component"), "jaccard-rows")
    discard(hashed, classes, groups, members, found, keys, tested, stars, known, member, left, shards, of_class, comps, named, least)
    return out


def jaccard_classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = 4, num: int = 85, den: int = 100) -> DataFrame:
    """id_col, n_shingles, component_id of every row: the smallest id that links lead to, itself included; see joined_rows()."""
    return joined_rows(docs, id_col, text_col, k, num, den).select(F.col("doc_id").alias(id_col), "n_shingles", "component_id")
