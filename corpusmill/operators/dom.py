"""HTML trees: a parser with the usual repairs, CSS selectors, and element operators on a table of elements.

A page is parsed once, in an Arrow stage, into a row per element. Navigation and predicates are then DataFrame
operations; css() and select_all() evaluate selectors in the parsing stage itself, so only matches leave it.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

from corpusmill.functions import text as T
from corpusmill.operators.html_tree import ENDS_P, Node, parse, parse_fragment
from corpusmill.operators.selectors import Matcher, matches, select
from corpusmill.operators.structure import ancestors
from corpusmill.sources.shared import spread


def generate_selector(attrs: Column) -> Column:
    """#id, else tag.firstclass, else tag[k="v"] of the first other attribute by name; the tag is the attribute of that name, or div."""
    a = lambda k: F.try_element_at(attrs, F.lit(k))
    tag = F.coalesce(a("tag"), F.lit("div"))
    first = F.get(F.filter(F.split(F.coalesce(a("class"), F.lit("")), r"\s+"), lambda x: x != ""), F.lit(0))
    other = F.get(F.array_sort(F.filter(F.map_entries(attrs), lambda e: ~e["key"].isin("tag", "class", "id"))), F.lit(0))
    return F.when(a("id").isNotNull(), F.concat(F.lit("#"), a("id"))).when(first.isNotNull(), F.concat(tag, F.lit("."), first)).when(other.isNotNull(), F.concat(tag, F.lit("["), other["key"], F.lit('="'), other["value"], F.lit('"]'))).otherwise(tag)


# ---- DataFrame stages

NODE = "struct<node_id:int,tag:string,attrs:map<string,string>,text:string,html:string,outer_html:string>"


def _row(n: Node) -> dict:
    return {"node_id": n.id, "tag": n.tag, "attrs": dict(n.attrs), "text": n.text(), "html": n.inner_html(), "outer_html": n.outer_html()}


__all__ = ["Matcher", "ancestors", "matches", "parse", "parse_fragment", "select"]
NAVIGATION = ("parent_tag", "next_sibling", "prev_sibling", "first_child", "last_child", "children")


POSITIONS = ("siblings", "type_idx", "type_count")


def elements(pages: DataFrame, id_col: str = "page_id", html_col: str = "html", with_html: bool = False, with_text: bool = True, with_navigation: bool = False, with_positions: bool = False) -> DataFrame:
    """A row per element: id_col, node_id (document order), last_id (of the last element below it, else its own), parent_id, depth, sibling_idx, tag, attrs; text, that of everything
    below it, unless with_text is off (on deep trees it is many times the page); html and outer_html with with_html; with with_navigation the parent's tag,
    the ids of the next and previous sibling and of the first and last child, and the number of children; and with with_positions the number of siblings with itself, the place among
    those of its tag and their number, and whether it is empty. Null html has no elements."""
    kind = dict(pages.dtypes)[id_col]
    schema = f"`{id_col}` {kind}, node_id int, last_id int, parent_id int, depth int, sibling_idx int, tag string, attrs map<string,string>"
    schema += ", text string" * with_text + ", html string, outer_html string" * with_html
    schema += ", parent_tag string, next_sibling int, prev_sibling int, first_child int, last_child int, children int" * with_navigation
    schema += ", siblings int, type_idx int, type_count int, is_empty boolean" * with_positions

    def near(n: Node, brothers: list, kids: list) -> tuple:
        after = brothers[n.index + 1].id if n.index + 1 < len(brothers) else None
        before = brothers[n.index - 1].id if n.index > 0 and brothers else None
        return None if n.parent is None else n.parent.tag, after, before, kids[0].id if kids else None, kids[-1].id if kids else None, len(kids)

    def parsed(batches):
        for pdf in batches:
            rows: list[tuple] = []
            for key, html in zip(pdf[id_col], pdf[html_col], strict=True):
                if html is None:
                    continue
                root = parse(html)
                places = Matcher(root) if with_positions else None
                todo: list[tuple[Node, int, list]] = [(root, 0, [])]
                while todo:
                    n, depth, brothers = todo.pop()
                    kids = n.elements()
                    todo += [(c, depth + 1, kids) for c in kids[::-1]]
                    row = (key, n.id, n.last, None if n.parent is None else n.parent.id, depth, n.index, n.tag, dict(n.attrs))
                    row += (n.text(),) * with_text
                    if with_html:
                        row += (n.inner_html(), n.outer_html())
                    if with_navigation:
                        row += near(n, brothers, kids)
                    rows.append((*row, len(brothers) or 1, *places.of_type(n), not n.children) if places else row)
                    if len(rows) > 20_000:
                        yield _frame(rows, schema)
                        rows = []
            if rows:
                yield _frame(rows, schema)

    return spread(pages.select(id_col, html_col)).mapInPandas(parsed, schema)


def _frame(rows: list[tuple], schema: str) -> pd.DataFrame:
    names = [x.strip().split()[0].strip("`") for x in re.split(r", (?=`?\w+`? )", schema)]
    out = pd.DataFrame(rows, columns=names)
    whole = ["parent_id", *NAVIGATION[1:5]]
    return out.astype({c: "Int32" for c in whole if c in names})


def select_all(html: Column, css: str) -> Column:
    """The matches of a selector as an array of nodes; empty for an invalid one."""

    @F.pandas_udf(f"array<{NODE}>")
    def found(pages: pd.Series) -> pd.Series:
        return pd.Series([None if h is None else [_row(n) for n in select(parse(h), css)] for h in pages], dtype=object)

    return found(html)


def css(pages: DataFrame, html_col: str, fields: dict[str, tuple[str, str | None]]) -> DataFrame:
    """pages with an array of strings per field: of each match of (selector, attribute) the attribute ("" if missing), or the
    text if no attribute is named. Each page is parsed once for all fields."""
    schema = ", ".join(f"`{k}` array<string>" for k in fields)

    @F.pandas_udf(schema)
    def extracted(pages: pd.Series) -> pd.DataFrame:
        out = {k: [] for k in fields}
        for h in pages:
            found = [[] for _ in fields] if h is None else Matcher(parse(h)).select(selector for selector, _ in fields.values())
            for (k, (_, attr)), nodes in zip(fields.items(), found, strict=True):
                out[k].append([n.text() if attr is None else n.attrs.get(attr, "") for n in nodes])
        return pd.DataFrame(out)

    return spread(pages).withColumn("css_", extracted(F.col(html_col))).select(*pages.columns, *[F.col(f"css_.{k}").alias(k) for k in fields])


def content_text(html: Column, selectors: tuple[str, ...]) -> Column:
    """The text of the first match of the first selector that matches anything, with lines trimmed and empty ones dropped."""

    @F.pandas_udf("string")
    def raw(pages: pd.Series) -> pd.Series:
        out = []
        for h in pages:
            out.append(next((found[0].text() for found in Matcher(parse(h or "")).select(selectors) if found), ""))
        return pd.Series(out, dtype=object)

    return T.clean_lines(raw(html))


def nested_select(html: Column, outer: str, inner: str) -> Column:
    """Texts of inner matches under each outer match in turn; nested outer matches give theirs twice."""

    def within(html: str) -> list[str]:
        outside, inside = Matcher(parse(html)).select([outer, inner])
        ids = [n.id for n in inside]
        return [n.text() for o in outside for n in inside[bisect_right(ids, o.id) : bisect_right(ids, o.last)]]

    @F.pandas_udf("array<string>")
    def found(pages: pd.Series) -> pd.Series:
        return pd.Series([[] if h is None else within(h) for h in pages], dtype=object)

    return found(html)


def parent(e: DataFrame, id_col: str = "page_id") -> DataFrame:
    """Each element with its parent's columns as p_*."""
    p = e.select(F.col(id_col).alias("p_page"), *[F.col(c).alias(f"p_{c}") for c in ("node_id", "tag", "attrs", "text")])
    return e.join(p, (F.col(id_col) == F.col("p_page")) & (F.col("parent_id") == F.col("p_node_id")), "left").drop("p_page")


def siblings(e: DataFrame, id_col: str = "page_id") -> DataFrame:
    """Each element with the ids of its next and previous sibling and its first and last child."""
    w = Window.partitionBy(id_col, "parent_id").orderBy("sibling_idx")
    with_siblings = e.withColumns({"next_sibling": F.lead("node_id").over(w), "prev_sibling": F.lag("node_id").over(w)})
    kids = e.filter("parent_id is not null").groupBy(F.col(id_col).alias("k_page"), F.col("parent_id").alias("k_parent")).agg(F.min("node_id").alias("first_child"), F.max_by("node_id", "sibling_idx").alias("last_child"), F.count(F.lit(1)).alias("children"))
    return with_siblings.join(kids, (F.col(id_col) == F.col("k_page")) & (F.col("node_id") == F.col("k_parent")), "left").drop("k_page", "k_parent")


def find_by_text(e: DataFrame, text: str, tag: str | None = None, exact: bool = False) -> DataFrame:
    own = T.trim(F.col("text")) == text.strip() if exact else F.contains("text", F.lit(text))
    return e.filter(own & ((F.col("tag") == tag) if tag else F.lit(True)))


def _kinds(e: DataFrame, id_col: str) -> DataFrame:
    """Elements with a parent, and what makes them similar to siblings: tag, number of classes, number of attributes."""
    words = F.size(F.filter(F.split(F.coalesce(F.try_element_at("attrs", F.lit("class")), F.lit("")), r"\s+"), lambda x: x != ""))
    return e.filter("parent_id is not null").select(id_col, "parent_id", "tag", words.alias("cls"), F.size("attrs").alias("n_attrs"), "node_id")


def similar_kinds(e: DataFrame, id_col: str = "page_id") -> DataFrame:
    """id_col, parent_id, tag, cls, n_attrs, like_cls, like_attrs, n, n_like: of the children of each parent the kinds that are there, in pairs that are similar, with the
    number of elements of either kind; a kind is also similar to itself. As many rows as kinds, not as elements: each kind is looked up under
    the 15 kinds around it."""
    key = [id_col, "parent_id", "tag"]
    kinds = _kinds(e, id_col).groupBy(*key, "cls", "n_attrs").agg(F.count(F.lit(1)).alias("n"))
    around = F.array(*[F.struct(F.lit(a).alias("c"), F.lit(b).alias("a")) for a in (-1, 0, 1) for b in (-2, -1, 0, 1, 2)])
    near = kinds.select("*", F.explode(around).alias("m")).withColumns({"like_cls": F.col("cls") + F.col("m.c"), "like_attrs": F.col("n_attrs") + F.col("m.a")}).drop("m")
    other = kinds.select(*key, F.col("cls").alias("like_cls"), F.col("n_attrs").alias("like_attrs"), F.col("n").alias("n_like"))
    return near.join(other, [*key, "like_cls", "like_attrs"]).select(*key, "cls", "n_attrs", "like_cls", "like_attrs", "n", "n_like")


def count_similar(e: DataFrame, id_col: str = "page_id") -> DataFrame:
    """id_col, node_id, similar: how many siblings of each element with a parent are similar to it (see find_similar), without making the pairs."""
    key = [id_col, "parent_id", "tag", "cls", "n_attrs"]
    counts = similar_kinds(e, id_col).groupBy(*key).agg((F.sum("n_like") - 1).alias("similar"))
    return _kinds(e, id_col).join(counts, key).select(id_col, "node_id", "similar")


def find_similar(e: DataFrame, id_col: str = "page_id", of: DataFrame | None = None) -> DataFrame:
    """(id_col, node_id, similar): siblings of the same tag whose classes differ by one at most in number, attributes by two. of: the elements (id_col, node_id)
    for which they are wanted; without it all pairs come out, whose number grows with the square of that of siblings."""
    key = [id_col, "parent_id", "tag"]
    a = _kinds(e, id_col)
    wanted = a if of is None else a.join(of.select(id_col, "node_id").distinct(), [id_col, "node_id"], "left_semi").select(a.columns)
    likes = similar_kinds(e, id_col).select(*key, "cls", "n_attrs", "like_cls", "like_attrs")
    b = a.select(*key, F.col("cls").alias("like_cls"), F.col("n_attrs").alias("like_attrs"), F.col("node_id").alias("similar"))
    pairs = wanted.join(likes, [*key, "cls", "n_attrs"]).join(b, [*key, "like_cls", "like_attrs"])
    return pairs.filter("node_id <> similar").select(id_col, "node_id", "similar")


# ---- parts of responses, fragments and lists of nodes


def select_response(body: Column, content_type: Column, css: str) -> Column:
    """The matches in a response's body, decoded as its content type and the body itself say."""
    return select_all(T.decode(body, content_type), css)


def fragment(html: Column) -> Column:
    """The first element of a fragment as a node; null for null."""

    @F.pandas_udf(NODE)
    def parsed(parts: pd.Series) -> pd.DataFrame:
        names = [x.split(":")[0] for x in re.findall(r"(\w+:)", NODE)]
        return pd.DataFrame([dict.fromkeys(names) if h is None else _row(parse_fragment(h)) for h in parts], columns=names)

    return F.when(html.isNotNull(), parsed(html))


def matches_css(html: Column, css: str) -> Column:
    """Whether the first element of a fragment, such as an outer_html, matches; false for an invalid selector, null for null."""

    @F.pandas_udf("boolean")
    def found(parts: pd.Series) -> pd.Series:
        return pd.Series([None if h is None else matches(parse_fragment(h), css) for h in parts], dtype=object)

    return found(html)


def contains_text(text: Column, part: str) -> Column:
    return F.contains(text, F.lit(part))


def count_nodes(nodes: Column) -> Column:
    return F.greatest(F.coalesce(F.size(nodes), F.lit(0)), F.lit(0))


def is_empty(nodes: Column) -> Column:
    return count_nodes(nodes) == 0


def node_at(nodes: Column, i: int) -> Column:
    """The i-th node from 0, or from the end if i is negative; null if there is none."""
    return F.try_element_at(nodes, F.lit(i + 1 if i >= 0 else i))


def filter_nodes(nodes: Column, keep: Callable[[Column], Column]) -> Column:
    """The nodes for which keep(node) holds, in their order."""
    return F.filter(nodes, keep)


def texts(nodes: Column) -> Column:
    return F.transform(nodes, lambda n: n["text"])


def attributes(nodes: Column, name: str) -> Column:
    """That attribute of each node, "" where it is missing."""
    return F.transform(nodes, lambda n: F.coalesce(F.try_element_at(n["attrs"], F.lit(name)), F.lit("")))


def htmls(nodes: Column) -> Column:
    return F.transform(nodes, lambda n: n["outer_html"])


# ---- Markdown

_SKIPPED = frozenset("script style head title noscript template".split())


def _opened(c: Node):
    """What is made of the parts that an element's content gives; None for content that stands as it is."""
    if re.fullmatch("h[1-6]", c.tag):
        return lambda ts: f"\n\n{'#' * int(c.tag[1])} {' '.join(''.join(ts).split())}\n\n"
    if c.tag in ("strong", "b", "em", "i") and c.text().strip():
        mark = "**" if c.tag in ("strong", "b") else "*"
        return lambda ts: f"{mark}{''.join(ts).strip()}{mark}"
    if c.tag == "a" and "href" in c.attrs:
        return lambda ts: f"[{''.join(ts).strip()}]({c.attrs['href']})"
    if c.tag == "blockquote":
        return lambda ts: "\n\n" + "\n".join(("> " + x).rstrip() for x in _tidy("".join(ts)).split("\n")) + "\n\n"
    if c.tag in ("ul", "ol"):
        mark = lambda i: f"{i}. " if c.tag == "ol" else "*   "
        return lambda ts: "\n\n" + "\n".join(mark(i) + _tidy(x).replace("\n", "\n" + " " * len(mark(i))) for i, x in enumerate(ts, 1)) + "\n\n"
    if c.tag in ENDS_P or c.tag in ("body", "tr"):
        return lambda ts: "\n\n" + "".join(ts) + "\n\n"
    return None


def _plain(c: Node) -> str | None:
    """Elements whose content is not looked into."""
    if c.tag in _SKIPPED:
        return ""
    if c.tag == "img":
        return f"![{c.attrs.get('alt', '')}]({c.attrs.get('src', '')})"
    if c.tag in ("br", "hr"):
        return "  \n" if c.tag == "br" else "\n\n* * *\n\n"
    if c.tag == "pre":
        return "\n\n```\n" + c.text().strip("\n") + "\n```\n\n"
    return f"`{c.text()}`" if c.tag == "code" else None


def to_markdown(root: Node) -> str:
    """A list keeps its items only; trees of any depth are walked without recursion."""
    parts: list[list[str]] = [[]]
    todo: list = list(root.children[::-1])
    while todo:
        c = todo.pop()
        if isinstance(c, str):
            parts[-1].append(re.sub(r"\s+", " ", c))
        elif callable(c):
            done = parts.pop()
            parts[-1].append(c(done))
        elif (flat := _plain(c)) is not None:
            parts[-1].append(flat)
        else:
            close = _opened(c)
            listed = c.tag in ("ul", "ol")
            if close is not None:
                parts.append([])
                todo.append(close)
            for x in c.children[::-1]:
                if not listed:
                    todo.append(x)
                elif isinstance(x, Node) and x.tag == "li":
                    todo += ["".join, *x.children[::-1], _OPEN]
        if todo and todo[-1] is _OPEN:
            todo.pop()
            parts.append([])
    return _tidy("".join(parts[0]))


_OPEN = object()  # where the parts of a list item begin


def _tidy(text: str) -> str:
    text = re.sub(r"[ \t]+\n(?! *\n)", lambda m: "  \n" if m[0].startswith("  ") else "\n", text)
    return re.sub(r"\n{3,}", "\n\n", "\n".join(x if x.startswith(("    ", "`")) else x.strip(" ") + ("  " if x.endswith("  ") and x.strip() else "") for x in text.split("\n"))).strip()


def html_to_markdown(html: Column) -> Column:
    @F.pandas_udf("string")
    def converted(pages: pd.Series) -> pd.Series:
        return pd.Series([None if h is None else to_markdown(parse(h)) for h in pages], dtype=object)

    return converted(html)
