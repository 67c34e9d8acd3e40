"""Near-duplicate embeddings: all pairs of one label with a cosine at or above a threshold, compared in tiles.

Unit vectors are turned into principal axes, the leading ones first. Cosine t means a distance of at most
sqrt(2 - 2t), and so at most that much on each axis: vectors are laid into cells of that width on the two leading
axes, and only neighbouring cells are compared. In a tile, products are summed over the leading axes first; pairs
whose sum plus the product of the remaining norms stays below t are given up, and those left are decided by
their cosine in double precision. Equal vectors are collapsed beforehand, and cells of many vectors are cut into
blocks, so that no task holds more than two blocks.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from corpusmill.llm.graph import components, forest
from corpusmill.llm.shared import discard, need, written

_SLACK = 1e-9  # beyond rounding errors of sums in double precision


def scaled(x: np.ndarray) -> np.ndarray:
    """Rows in double precision, each times the power of two that brings its largest component below one, so that no square overflows, and
    none that counts vanishes. Cosines do not change by it."""
    x = np.asarray(x, dtype=np.float64)
    return np.ldexp(x, -np.frexp(np.abs(x).max(1, keepdims=True, initial=0))[1])


def principal_axes(vectors: DataFrame, parts: int = 16) -> dict[int, np.ndarray]:
    """Per number of dimensions an orthogonal matrix whose columns are the axes, of falling variance. vectors: v, array of
    numbers. Second moments are summed over all rows, in tasks first; the driver gets at most `parts` matrices
    per number of dimensions."""

    def partial(batches):
        sums: dict = {}
        for pdf in batches:
            for d, group in pdf.groupby(pdf["v"].map(len)):
                x = scaled(np.stack(group["v"].to_numpy()))
                x /= np.linalg.norm(x, axis=1, keepdims=True)
                sums[d] = sums.get(d, 0) + x.T @ x
        from pyspark import TaskContext

        part = TaskContext.get().partitionId() % parts
        for d, m in sums.items():
            yield pd.DataFrame({"d": [d], "part": [part], "m": [m.tobytes()]})

    def total(pdf: pd.DataFrame) -> pd.DataFrame:
        m = sum(np.frombuffer(x, np.float64) for x in pdf["m"])
        return pd.DataFrame({"d": pdf["d"][:1], "part": pdf["part"][:1], "m": [m.tobytes()]})

    schema = "d int, part int, m binary"
    rows = vectors.select("v").mapInPandas(partial, schema).groupBy("d", "part").applyInPandas(total, schema).collect()
    moments: dict = {}
    for r in rows:
        moments[r.d] = moments.get(r.d, 0) + np.frombuffer(r.m, np.float64).reshape(r.d, r.d)
    return {d: np.linalg.eigh(m)[1][:, ::-1].copy() for d, m in moments.items()}


def close_pairs(x: np.ndarray, y: np.ndarray, axes: np.ndarray, t: float, same: bool, step: int = 512):
    """Index pairs (i of x, j of y) with cosine >= t; if same, x is y and i < j. Yields arrays, some rows of x at a time."""
    x, y = scaled(x), scaled(y)
    nx, ny = np.linalg.norm(x, axis=1), np.linalg.norm(y, axis=1)
    zx, zy = x / nx[:, None] @ axes, y / ny[:, None] @ axes
    d = x.shape[1]
    cuts = [0] + [c for c in (4, 8, 16, 32, 64, 128, 256) if c < d] + [d]
    rest = lambda z, c: np.sqrt(np.maximum((z[:, c:] ** 2).sum(1), 0))
    rests = [(rest(zx, c), rest(zy, c)) for c in cuts]
    for a in range(0, len(x), step):
        rows = slice(a, a + step)
        first = a if same else 0
        part = zx[rows, : cuts[1]] @ zy[first:, : cuts[1]].T
        alive = part + rests[1][0][rows, None] * rests[1][1][None, first:] >= t - _SLACK
        i, j = np.nonzero(np.triu(alive, 1) if same else alive)
        p = part[i, j]
        i, j = i + a, j + first
        for k in range(1, len(cuts) - 1):
            kept_i, kept_j, kept_p = [], [], []
            for b in range(0, len(i), 1 << 18):  # a bounded number of pairs at a time
                ii, jj = i[b : b + (1 << 18)], j[b : b + (1 << 18)]
                pp = p[b : b + (1 << 18)] + np.einsum("ij,ij->i", zx[ii, cuts[k] : cuts[k + 1]], zy[jj, cuts[k] : cuts[k + 1]])
                ok = pp + rests[k + 1][0][ii] * rests[k + 1][1][jj] >= t - _SLACK
                kept_i.append(ii[ok]), kept_j.append(jj[ok]), kept_p.append(pp[ok])
            if not kept_i:
                break
            i, j, p = np.concatenate(kept_i), np.concatenate(kept_j), np.concatenate(kept_p)
        for b in range(0, len(i), 1 << 18):
            ii, jj = i[b : b + (1 << 18)], j[b : b + (1 << 18)]
            ok = np.einsum("ij,ij->i", x[ii], y[jj]) / (nx[ii] * ny[jj]) >= t
            yield ii[ok], jj[ok]


def _numbers(vectors: DataFrame, column: str) -> Column:
    """Single precision stays as it is until products are formed, which are in double precision."""
    single = dict(vectors.dtypes)[column] == "array<float>"
    return F.col(column) if single else F.col(column).cast("array<double>")


def near_duplicates(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", threshold: float = 0.98, block: int = 4096) -> DataFrame:
    """id_col, n_links, component_id, kept per row of vectors.

    Rows link when their labels are equal and not null and their vectors, of one length, have a cosine of threshold
    at least. A vector that is null, empty or zero, or has a null or non-finite component, links with nothing, not even
    an equal one. Repeated rows, and rows with one id and different vectors, count as different vectors; component_id is the smallest id in the component,
    kept is id = component_id. Ids are longs; rows with a null id have no links and null results besides. No rows,
    no result.
    """
    need(vectors, id_col, vector_col, label_col)
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(label_col).alias("label"), _numbers(vectors, vector_col).alias("v"))
    finite = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    sound = F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.col("v").isNotNull() & F.coalesce(finite, F.lit(False)) & F.exists("v", lambda x: x != 0)
    rows = rows.withColumn("v", F.when(sound, F.col("v")))
    reps = written(rows.filter("v is not null").groupBy("label", "v").agg(F.min("vec_id").alias("least_id"), F.count(F.lit(1)).alias("copies")).withColumn("rep", F.monotonically_increasing_id()), "vectors")
    axes = principal_axes(reps)
    width = float(np.sqrt(max(0.0, 2 - 2 * threshold)) + 1e-6)

    @F.pandas_udf("struct<c0:long,c1:long>")
    def cell(v: pd.Series) -> pd.DataFrame:
        out = np.zeros((len(v), 2), np.int64)
        for d, index in v.groupby(v.map(len)).groups.items():
            x = scaled(np.stack(v.loc[index].to_numpy()))
            x /= np.linalg.norm(x, axis=1, keepdims=True)
            z = np.floor(x @ axes[d][:, :2] / width).astype(np.int64)
            out[v.index.get_indexer(index), : z.shape[1]] = z
        return pd.DataFrame(out, columns=["c0", "c1"])

    placed = written(reps.withColumn("c", cell("v")).select("rep", "copies", "v", "label", F.size("v").alias("d"), F.col("c.c0").alias("c0"), F.col("c.c1").alias("c1")), "vector-cells")
    sizes = written(placed.groupBy("label", "d", "c0", "c1").agg(F.ceil(F.count(F.lit(1)) / block).cast("int").alias("blocks")), "cell-sizes")
    # Each cell's vectors also visit the half of its neighbours that lie before it, so that each pair of cells meets once.
    moves = F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for a, b in ((0, 0), (-1, -1), (-1, 0), (-1, 1), (0, -1))])
    key = ["label", "d", "c0", "c1"]
    of_own = placed.join(sizes.withColumnRenamed("blocks", "own_blocks"), key)
    of_own = of_own.withColumn("own", F.pmod(F.xxhash64("rep"), F.col("own_blocks")).cast("int")).select("*", F.explode(moves).alias("m"))
    moved = of_own.withColumns({"guest": ((F.col("m.a") != 0) | (F.col("m.b") != 0)), "c0": F.col("c0") + F.col("m.a"), "c1": F.col("c1") + F.col("m.b"), "from": F.when((F.col("m.a") == 0) & (F.col("m.b") == 0), F.lit(0)).otherwise((F.col("m.a") + 2) * 3 + F.col("m.b") + 2)})
    moved = moved.join(sizes, key)
    homes = moved.filter("not guest")
    # A home block meets itself and later home blocks, and each block of the visitors from each neighbour.
    inner = homes.select("*", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other")).select("label", "d", "c0", "c1", F.lit(0).alias("from"), F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), (F.col("own") <= F.col("other")).alias("left"), (F.col("own") >= F.col("other")).alias("right"), "rep", "copies", "v")
    visits = moved.filter("guest").select("*", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("i")).select("label", "d", "c0", "c1", "from", "i", F.col("own").alias("j"), F.lit(False).alias("left"), F.lit(True).alias("right"), "rep", "copies", "v")
    met = written(visits.select("label", "d", "c0", "c1", "from", "j").distinct(), "visits")
    hosts = homes.select("label", "d", "c0", "c1", F.col("own").alias("i"), "rep", "copies", "v").join(met, key).select("label", "d", "c0", "c1", "from", "i", "j", F.lit(True).alias("left"), F.lit(False).alias("right"), "rep", "copies", "v")
    tiles = inner.unionByName(visits).unionByName(hosts)

    def compare(table: pa.Table) -> pa.Table:
        left, right = (np.asarray(table.column(c).combine_chunks().cast(pa.int8())).astype(bool) for c in ("left", "right"))
        flat = np.asarray(table.column("v").combine_chunks().flatten(), dtype=np.float64)
        x = flat.reshape(table.num_rows, -1)
        rep, copies = (np.asarray(table.column(c).combine_chunks()) for c in ("rep", "copies"))
        li, ri = np.flatnonzero(left), np.flatnonzero(right)
        same = bool((left & right).any())
        links, ends = np.zeros(table.num_rows, np.int64), []
        if len(li) and len(ri):
            for i, j in close_pairs(x[li], x[ri], axes[x.shape[1]], threshold, same):
                i, j = li[i], ri[j]
                np.add.at(links, i, copies[j])
                np.add.at(links, j, copies[i])
                ends.append(np.stack(forest(len(x), i, j)))
        a, b = forest(len(x), *np.concatenate(ends, axis=1)) if ends else (np.zeros(0, int),) * 2
        some = np.flatnonzero(links)
        none = lambda n: pa.nulls(n, pa.int64())
        return pa.table({"rep": pa.concat_arrays([pa.array(rep[some]), none(len(a))]), "links": pa.concat_arrays([pa.array(links[some]), none(len(a))]), "a": pa.concat_arrays([none(len(some)), pa.array(rep[a])]), "b": pa.concat_arrays([none(len(some)), pa.array(rep[b])])})

    found = written(tiles.groupBy("label", "d", "c0", "c1", "from", "i", "j").applyInArrow(compare, "rep long, links long, a long, b long"), "vector-links")
    near = found.filter("rep is not null").groupBy("rep").agg(F.sum("links").alias("links"))
    comps = components(found.filter("a is not null").select("a", "b"))
    least = reps.select("rep", "least_id").join(comps, F.col("rep") == F.col("node")).groupBy("component").agg(F.min("least_id").alias("component_id"))
    found_in = written(comps.join(least, "component").select("node", "component_id"), "vector-components")
    known = reps.join(near, "rep", "left").join(found_in, F.col("rep") == F.col("node"), "left")
    known = written(known.select("label", "v", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("component_id", "least_id").alias("component_id")), "vector-classes")
    discard(found, placed, sizes, met, reps, found_in)
    known = known.withColumnsRenamed({"label": "k_label", "v": "k_v"})
    out = rows.join(known, (F.col("label") == F.col("k_label")) & (F.col("v") == F.col("k_v")), "left")
    return out.select(F.col("vec_id").alias(id_col), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("component_id", "vec_id").alias("component_id")).withColumn("kept", F.col(id_col) == F.col("component_id"))
