"""URL filter: rules by host and path, and for the rest a tree of path templates judged by labelled purity.

Per host, paths form a tree of segments. Segments that are numbers, long hexadecimal strings or mixtures with digits
become wildcards by their form, and at every level those among very many siblings by their rarity. A branch whose
share of bad labels does not differ significantly from that of the branch it grows from merges with
that one and takes its share; others have their own, smoothed towards it, and those without labels go back towards the share
of all hosts. A template is rejected when its share is high.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from corpusmill.llm.shared import discard, free_prefix, need, without, written


@dataclass(frozen=True)
class UrlRule:
    """Fits host and its subdomains where the path begins with path. verdict: allow or block."""

    host: str
    path: str
    verdict: str


# The production rules.
RULES = (UrlRule("com", "/", "allow"), UrlRule("example.com", "/en/", "block"), UrlRule("www.example.com", "/en/", "allow"), UrlRule("net", "/es/", "block"), UrlRule("net", "/fr/", "block"))
_MOST_RULES = 500
_OUT = ["host", "path", "rule", "verdict", "template", "bad_share"]


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host: after the first :// up to / ? # or the end, A-Z in lower case; path: from there up to ? # or the end."""
    host = F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)
    path = F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1)
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return F.coalesce(F.translate(host, upper, upper.lower()), F.lit("")), F.coalesce(path, F.lit(""))


def _fits(rule: UrlRule, host: Column, path: Column) -> Column:
    own = (host == rule.host) | host.endswith("." + rule.host)
    return own & path.startswith(rule.path) if rule.path else own


def longest_rule(rules: tuple[UrlRule, ...], host: Column, path: Column) -> tuple[Column, Column]:
    """The longest fitting rule, as host and path together, and its verdict; of two as long, that of the longer host."""
    name, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for r in sorted(rules, key=lambda r: (len(r.host + r.path), len(r.host), r.verdict)):
        name = F.when(_fits(r, host, path), F.lit(r.host + r.path)).otherwise(name)
        verdict = F.when(_fits(r, host, path), F.lit(r.verdict)).otherwise(verdict)
    return name, verdict


def _shape(path: Column) -> Column:
    """The path's segments, those that vary by their form as wildcards; extensions stay."""
    form = lambda s: F.when(s == "", s).when(s.rlike(r"^\d+(?:\.[A-Za-z]{1,5})?$|^[0-9a-fA-F-]{16,}(?:\.[A-Za-z]{1,5})?$|\d.*\d.*\d"), F.concat(F.lit("*"), F.regexp_extract(s, r"(\.[A-Za-z]{1,5})$", 1))).otherwise(s)
    return F.transform(F.split(path, "/"), form)


def _nodes(k_from: int = 0) -> Column:
    """Of segs the branches that the template lies in, from level k_from on: level, and hash of all segments up to there. Last comes the
    end of the template itself, which has its labels without those of longer ones."""
    ended = F.concat("segs", F.array(F.lit("/")))
    return F.transform(F.sequence(F.lit(k_from), F.greatest(F.size("segs") + 1, F.lit(k_from))), lambda k: F.struct(k.alias("k"), F.xxhash64(k, F.slice(ended, F.lit(1), k)).alias("node")))


def template_tree(counted: DataFrame, max_children: int = 50, min_share: float = 0.02) -> DataFrame:
    """counted, a written table, with segs as the template. counted: host, shape (distinct per host), segs, n, bad, labelled.

    Of a branch with more than max_children children those with less than min_share of its urls become one wildcard, the upper
    levels first. A round makes one level's wildcards, and goes to the next one that needs any, so there are as many rounds as such levels.
    All steps are aggregates and joins over distinct shapes.
    """
    tree, level = counted, 0
    while True:
        at = tree.filter(F.size("segs") > level).select("host", "segs", "n", F.explode(F.filter(_nodes(level), lambda x: x["k"] < F.size("segs"))).alias("x"))
        kids = at.select("host", "x.k", "x.node", F.get("segs", F.col("x.k")).alias("child"), "n").groupBy("host", "k", "node", "child").agg(F.sum("n").alias("n"))
        wide = kids.groupBy("host", "k", "node").agg(F.count(F.lit(1)).alias("children"), F.sum("n").alias("all")).filter(F.col("children") > max_children)
        rare = kids.join(wide, ["host", "k", "node"]).filter((F.col("n") < min_share * F.col("all")) & ~F.col("child").isin("", "*"))
        rare = written(rare.select(F.col("host").alias("r_host"), F.col("k").alias("r_k"), F.col("node").alias("r_node"), F.col("child").alias("r_child")), "rare-branches")
        level = rare.agg(F.min("r_k")).first()[0]
        if level is None:
            discard(rare)
            return tree
        node = F.xxhash64(F.lit(level), F.slice("segs", 1, level))
        hit = (F.col("host") == F.col("r_host")) & (node == F.col("r_node")) & (F.get("segs", F.lit(level)) == F.col("r_child")) & (F.size("segs") > level)
        starred = F.transform("segs", lambda s, i: F.when(i == level, F.lit("*")).otherwise(s))  # noqa: B023
        grown = tree.join(rare.filter(F.col("r_k") == level), hit, "left").withColumn("segs", F.when(F.col("r_child").isNotNull(), starred).otherwise(F.col("segs")))
        before, tree = tree, written(grown.select(*tree.columns), "template-tree")
        discard(rare, before)
        level += 1


def judged_templates(tree: DataFrame, reject: float = 0.9, z: float = 1.96, strength: float = 2.0) -> DataFrame:
    """host, shape, template, bad_share and rejected.

    From the host down: the host's share is (bad + strength * prior) / (labelled + strength), prior being (bad + 1) / (labelled + 2) over all hosts, but 1/2 at most;
    a branch with labels whose own share is within z standard errors of that of the branch above merges with it and takes its share; else its share is (bad + strength * above) /
    (labelled + strength). A branch without labels is no evidence of being like the one above: with every such level the share that it inherits goes half of the
    way back to the prior, so that one labelled branch, of a host whose labels can only be bad, say, does not reject the others.
    """
    sums = tree.agg(F.coalesce(F.sum("bad"), F.lit(0)).alias("bad"), F.coalesce(F.sum("labelled"), F.lit(0)).alias("labelled")).first()
    prior = min(0.5, (sums.bad + 1) / (sums.labelled + 2))
    tree = tree.withColumn("template", F.array_join("segs", "/"))
    at = tree.select("host", "template", "bad", "labelled", F.explode(_nodes()).alias("x")).select("host", "template", "bad", "labelled", "x.k", "x.node")
    nodes = at.groupBy("host", "k", "node").agg(F.sum("bad").alias("bad"), F.sum("labelled").alias("labelled"))
    chains = at.select("host", "template", "k", "node").distinct().join(nodes, ["host", "k", "node"])
    chains = chains.groupBy("host", "template").agg(F.array_sort(F.collect_list(F.struct("k", "bad", "labelled"))).alias("chain"))

    def below(above: Column, x: Column) -> Column:
        own = (x["bad"] + strength * above) / (x["labelled"] + strength)
        n = F.greatest(x["labelled"], F.lit(1))
        alike = F.abs(x["bad"] / n - above) <= z * F.sqrt(above * (1 - above) / n)
        return F.when((x["k"] > 0) & (x["labelled"] == 0), (above + prior) / 2).when((x["k"] > 0) & alike, above).otherwise(own)

    judged = chains.select("host", "template", F.aggregate("chain", F.lit(prior), below).alias("bad_share"))
    return tree.select("host", "shape", "template").join(judged, ["host", "template"]).withColumn("rejected", F.col("bad_share") >= reject)


def judge(pages: DataFrame, rules: tuple[UrlRule, ...] = RULES, url_col: str = "url", labels: DataFrame | None = None, max_children: int = 50, min_share: float = 0.02, reject: float = 0.9) -> DataFrame:
    """pages with host, path, rule, verdict, template and bad_share.

    The longest rule decides; where none fits, the template tree does. Its labels are the rules' verdicts on the urls that they fit,
    and, if given, labels (url, bad: 0 or 1), in which repeated rows count as often as they occur. Urls that are null or without :// have an empty host and path, and are
    judged like others; paths of any length are taken whole. Repeated rows count as often as they occur. No rows give no rows. Input columns named like results, in
    any case, are replaced. At most 500 rules, which become one expression.
    """
    need(pages, url_col)
    if len(rules) > _MOST_RULES:
        raise ValueError(f"at most {_MOST_RULES} rules")
    rest, p = without(pages, _OUT, url_col), free_prefix(pages)

    def placed(rows: DataFrame) -> DataFrame:
        host, path = host_and_path(F.col(url_col).cast("string"))
        rows = rows.withColumns({f"{p}host": host, f"{p}path": path})
        name, verdict = longest_rule(rules, F.col(f"{p}host"), F.col(f"{p}path"))
        return rows.withColumns({f"{p}rule": name, f"{p}said": verdict, f"{p}segs": _shape(F.col(f"{p}path"))}).withColumn(f"{p}shape", F.array_join(f"{p}segs", "/"))

    found = placed(pages.select(*rest))
    said = F.col(f"{p}said")
    each = found.select(f"{p}host", f"{p}shape", f"{p}segs", F.lit(1).alias("n"), F.coalesce((said == "block").cast("long"), F.lit(0)).alias("bad"), said.isNotNull().cast("long").alias("labelled"))
    if labels is not None:
        need(labels, "url", "bad")
        given = placed(labels.select(F.col("url").alias(url_col), F.col("bad").cast("long").alias(f"{p}bad")).filter(F.col(f"{p}bad").isNotNull()))
        each = each.union(given.select(f"{p}host", f"{p}shape", f"{p}segs", F.lit(0), f"{p}bad", F.lit(1).cast("long")))
    counted = each.groupBy(F.col(f"{p}host").alias("host"), F.col(f"{p}shape").alias("shape")).agg(F.first(f"{p}segs").alias("segs"), F.sum("n").alias("n"), F.sum("bad").alias("bad"), F.sum("labelled").alias("labelled"))
    tree = template_tree(written(counted, "paths"), max_children, min_share)
    judged = written(judged_templates(tree, reject), "templates")
    discard(tree)
    judged = judged.select(F.col("host").alias(f"{p}of_host"), F.col("shape").alias(f"{p}of_shape"), "template", "bad_share", F.col("rejected").alias(f"{p}rejected"))
    found = found.join(judged, (F.col(f"{p}host") == F.col(f"{p}of_host")) & (F.col(f"{p}shape") == F.col(f"{p}of_shape")), "left")
    method = F.when(F.col(f"{p}rejected"), F.lit("block")).otherwise(F.lit("allow"))
    return found.select(*rest, F.col(f"{p}host").alias("host"), F.col(f"{p}path").alias("path"), F.col(f"{p}rule").alias("rule"), F.coalesce(said, method).alias("verdict"), "template", "bad_share")
