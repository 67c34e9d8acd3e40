"""Structural operators on the table of elements, by intervals: an element of number node_id holds those from node_id + 1 to last_id.

Intervals of one page either nest or do not meet. So whether an element lies below one of a set is a running maximum of ends, how many of a set it
holds is a difference of running counts, and pairs come from one pass over both sets in document order with a stack of what is open. No
operator here compares all elements of a page with one another.
"""

from __future__ import annotations

from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from corpusmill.operators.selectors import SelectorError, parse_list


def _arrow(kind: str) -> pa.DataType:
    return {"bigint": pa.int64(), "int": pa.int32(), "string": pa.string()}[kind]


def contained(outer: DataFrame, inner: DataFrame, id_col: str = "page_id", nearest: bool = False) -> DataFrame:
    """id_col, outer, inner, distance: the ids of each outer element and each inner one below it, and the outer one's place among those around the inner
    one, 1 for the closest; nearest: only that. Both have id_col, node_id and last_id; ids of pages are longs, ints or strings. The two sets are sorted together by page and place, and the work is in proportion to them and the pairs."""
    kind = dict(outer.dtypes)[id_col]
    rows = outer.select(F.col(id_col).alias("page"), "node_id", "last_id", F.lit(1).alias("out")).union(inner.select(id_col, "node_id", "last_id", F.lit(0)))
    # of an element that is in both sets, the inner row comes first, so that it does not hold itself
    rows = rows.filter("page is not null").repartition("page").sortWithinPartitions("page", "node_id", "out")

    def match(batches):
        page, stack, found = None, [], ([], [], [], [])

        def batch():
            made = pa.RecordBatch.from_arrays([pa.array(found[0], _arrow(kind)), pa.array(found[1], pa.int32()), pa.array(found[2], pa.int32()), pa.array(found[3], pa.int32())], names=[id_col, "outer", "inner", "distance"])
            for x in found:
                x.clear()
            return made

        for b in batches:
            for p, node, last, out in zip(*(b.column(i).to_pylist() for i in range(4)), strict=True):
                if p != page:
                    page, stack = p, []
                while stack and stack[-1][1] < node:
                    stack.pop()
                if out:
                    stack.append((node, last))
                    continue
                around = stack[-1:] if nearest else stack
                found[0].extend([p] * len(around))
                found[1].extend(a for a, _ in around)
                found[2].extend([node] * len(around))
                found[3].extend(range(len(around), 0, -1))
                if len(found[0]) > 50_000:
                    yield batch()
        if found[0]:
            yield batch()

    return rows.mapInArrow(match, f"`{id_col}` {kind}, outer int, inner int, distance int")


def count_inside(outer: DataFrame, inner: DataFrame, id_col: str = "page_id") -> DataFrame:
    """outer with inside, the number of inner elements below each: the running count at its end less that at its begin."""
    ends = outer.select(F.col(id_col).alias("p_"), F.col("node_id").alias("of_"), F.explode(F.array(F.struct(F.col("node_id").alias("at_"), F.lit(-1).alias("sign_")), F.struct(F.col("last_id").alias("at_"), F.lit(1).alias("sign_")))).alias("e_"))
    marks = ends.select("p_", F.col("e_.at_").alias("at_"), F.lit(0).alias("one_"), "of_", F.col("e_.sign_").alias("sign_"))
    marks = marks.union(inner.select(id_col, "node_id", F.lit(1), F.lit(None).cast("int"), F.lit(0)))
    # the inner element of a place is counted before the ends of that place
    so_far = F.sum("one_").over(Window.partitionBy("p_").orderBy("at_", F.desc("one_")).rowsBetween(Window.unboundedPreceding, 0))
    counts = marks.withColumn("n_", so_far).filter("sign_ <> 0").groupBy("p_", "of_").agg(F.sum(F.col("n_") * F.col("sign_")).alias("inside"))
    return outer.join(counts, (F.col(id_col) == F.col("p_")) & (F.col("node_id") == F.col("of_"))).drop("p_", "of_")


def descendants() -> Column:
    """The number of elements below each."""
    return F.col("last_id") - F.col("node_id")


def intervals(e: DataFrame, id_col: str = "page_id") -> DataFrame:
    """A whole element table (id_col, node_id in document order, depth) with last_id, the number of the last element below each, from the depths alone."""
    kind = dict(e.dtypes)[id_col]
    rows = e.select(F.col(id_col).alias("page"), "node_id", "depth").filter("page is not null").repartition("page").sortWithinPartitions("page", "node_id")

    def ends(batches):
        page, stack, before, found = None, [], 0, ([], [], [])

        def close(depth: int) -> None:
            while stack and stack[-1][1] >= depth:
                found[0].append(page), found[1].append(stack.pop()[0]), found[2].append(before)

        def batch():
            made = pa.RecordBatch.from_arrays([pa.array(found[0], _arrow(kind)), pa.array(found[1], pa.int32()), pa.array(found[2], pa.int32())], names=["p_", "n_", "last_id"])
            for x in found:
                x.clear()
            return made

        for b in batches:
            for p, node, depth in zip(*(b.column(i).to_pylist() for i in range(3)), strict=True):
                if p != page:
                    close(-1)
                    page = p
                close(depth)
                stack.append((node, depth))
                before = node
                if len(found[0]) > 50_000:
                    yield batch()
        close(-1)
        if found[0]:
            yield batch()

    last = rows.mapInArrow(ends, f"p_ {kind}, n_ int, last_id int")
    return e.join(last, (F.col(id_col) == F.col("p_")) & (F.col("node_id") == F.col("n_"))).drop("p_", "n_")


def ancestors(e: DataFrame, id_col: str = "page_id") -> DataFrame:
    """(id_col, node_id, ancestor, distance), up to the root: a row for each pair, which in deep trees are many; contained() and select_rows() ask what they
    have to of intervals instead. e is a whole element table, with last_id or, if that is missing, with depth."""
    e = e if "last_id" in e.columns else intervals(e, id_col)
    return contained(e, e, id_col).select(id_col, F.col("inner").alias("node_id"), F.col("outer").alias("ancestor"), "distance")


# ---- selectors as plans


def _counted(k: Column, a: int, b: int) -> Column:
    return k == b if a == 0 else (F.pmod(k - b, F.lit(abs(a))) == 0) & ((k - b) * (1 if a > 0 else -1) >= 0)


def _attribute(name: str, op: str | None, v: str | None, fold: bool) -> Column:
    own = F.try_element_at("attrs", F.lit(name))
    if op is None:
        return own.isNotNull()
    if fold:
        own, v = F.lower(own), v.lower()
    if op == "=":
        found = own == v
    elif op == "|=":
        found = (own == v) | F.startswith(own, F.lit(v + "-"))
    elif not v:
        found = F.lit(False)
    elif op == "~=":
        found = F.array_contains(F.split(own, r"\s+"), v)
    else:
        found = {"^=": F.startswith, "$=": F.endswith, "*=": F.contains}[op](own, F.lit(v))
    return F.coalesce(found, F.lit(False))


class _Plan:
    """Adds a boolean column for every compound of a selector, from the left; each asks the column before it for what its combinator means."""

    def __init__(self, e: DataFrame, id_col: str):
        self.e, self.id_col, self.next = e, id_col, 0

    def name(self) -> str:
        self.next += 1
        return f"_s{self.next}"

    def flag(self, condition: Column) -> str:
        """A column of the condition, which is made beforehand, as it may need columns of its own."""
        name = self.name()
        self.e = self.e.withColumn(name, condition)
        return name

    def page(self, first: int, last: int):
        return Window.partitionBy(self.id_col).orderBy("node_id").rowsBetween(first, last)

    def brothers(self, first: int, last: int):
        return Window.partitionBy(self.id_col, "parent_id").orderBy("sibling_idx").rowsBetween(first, last)

    def beside(self, comb: str, flag: str) -> Column:
        """Whether an element of flag stands to the left of comb."""
        start = Window.unboundedPreceding
        if comb == " ":
            return F.coalesce(F.max(F.when(F.col(flag), F.col("last_id"))).over(self.page(start, -1)) >= F.col("node_id"), F.lit(False))
        if comb == ">":
            up = self.name()
            marked = self.e.filter(F.col(flag)).select(F.col(self.id_col).alias(f"{up}p"), F.col("node_id").alias(f"{up}n"))
            self.e = self.e.join(marked, (F.col(self.id_col) == F.col(f"{up}p")) & (F.col("parent_id") == F.col(f"{up}n")), "left")
            self.e = self.e.withColumn(up, F.col(f"{up}n").isNotNull()).drop(f"{up}p", f"{up}n")
            return F.col(up)
        before = self.brothers(-1 if comb == "+" else start, -1)
        return F.col("parent_id").isNotNull() & F.coalesce(F.bool_or(flag).over(before), F.lit(False))

    def complex(self, parts: tuple) -> str:
        flag = ""
        for comb, tests in parts:
            held = self.flag(reduce(lambda a, b: a & b, [self.test(t) for t in tests]))
            if comb:
                beside = self.beside(comb, flag)
                held = self.flag(F.col(held) & beside)
            flag = held
        return flag

    def any_of(self, found: tuple) -> Column:
        return reduce(lambda a, b: a | b, [F.col(self.complex(parts)) for parts in found])

    def test(self, t: tuple) -> Column:
        kind = t[0]
        if kind == "tag":
            return F.col("tag") == t[1]
        if kind == "class":
            return F.coalesce(F.array_contains(F.split(F.try_element_at("attrs", F.lit("class")), r"\s+"), t[1]), F.lit(False))
        if kind == "id":
            return F.coalesce(F.try_element_at("attrs", F.lit("id")) == t[1], F.lit(False))
        if kind == "attr":
            return _attribute(*t[1:])
        if kind == "nth":
            k, of = ("type_idx", "type_count") if t[4] else ("sibling_idx", "siblings")
            return _counted(F.col(of) - F.col(k) if t[3] else F.col(k) + 1, t[1], t[2])
        if kind == "is":
            return self.any_of(t[1])
        if kind == "not":
            return ~self.any_of(t[1])
        if kind == "has":
            return reduce(lambda a, b: a | b, [self.having(parts) for parts in t[1]])
        if kind == "empty":
            return F.col("is_empty")
        return F.col("parent_id").isNull() if kind == "root" else F.lit(True)

    def having(self, parts: tuple) -> Column:
        if len(parts) > 1:
            raise SelectorError(":has() with combinators inside is evaluated in the parsing stage only")
        comb, end = parts[0][0], Window.unboundedFollowing
        flag = self.flag(reduce(lambda a, b: a & b, [self.test(t) for t in parts[0][1]]))
        if comb == " ":
            return F.coalesce(F.min(F.when(F.col(flag), F.col("node_id"))).over(self.page(1, end)) <= F.col("last_id"), F.lit(False))
        if comb == ">":
            up = self.name()
            marked = self.e.filter(F.col(flag)).select(F.col(self.id_col).alias(f"{up}p"), F.col("parent_id").alias(f"{up}n")).filter(F.col(f"{up}n").isNotNull()).distinct()
            self.e = self.e.join(marked, (F.col(self.id_col) == F.col(f"{up}p")) & (F.col("node_id") == F.col(f"{up}n")), "left")
            self.e = self.e.withColumn(up, F.col(f"{up}n").isNotNull()).drop(f"{up}p", f"{up}n")
            return F.col(up)
        after = self.brothers(1, 1 if comb == "+" else end)
        return F.col("parent_id").isNotNull() & F.coalesce(F.bool_or(flag).over(after), F.lit(False))


def select_rows(e: DataFrame, selectors: dict[str, str], id_col: str = "page_id") -> DataFrame:
    """e (of elements() with positions) with a boolean column for each named selector, all in one plan of JVM expressions: running maxima over pages and siblings for
    what stands above and before, and joins for parents. The html element is not matched, as a page's matches are those below it. An invalid selector matches nothing."""
    plan = _Plan(e, id_col)
    below = F.col("parent_id").isNotNull()
    for name, css in selectors.items():
        try:
            found = parse_list(css)
        except SelectorError:
            plan.e = plan.e.withColumn(name, F.lit(False))
            continue
        flag = plan.any_of(found)  # it may add columns to plan.e
        plan.e = plan.e.withColumn(name, flag & below)
    return plan.e.select(*e.columns, *selectors)
