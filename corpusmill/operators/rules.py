"""Rules: robots files, sitemaps, fetch-mode rules, request routing, time to live."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

from corpusmill.functions import urls as U
from corpusmill.functions.text import trim
from corpusmill.sources.shared import written


def robots_rules(files: DataFrame, origin_col: str = "origin", body_col: str = "body") -> DataFrame:
    """origin, disallowed, crawl_delay, request_rate of the sections for all agents. One origin's file is one group."""
    line = files.select(origin_col, F.posexplode(F.split(body_col, r"\r?\n")).alias("pos", "line")).withColumn("line", trim(F.col("line")))
    line = line.filter((F.col("line") != "") & ~F.col("line").startswith("#"))
    agent = F.when(F.col("line").startswith("User-agent:"), trim(F.substring("line", 12, 1 << 20)) == "*")
    w = Window.partitionBy(origin_col).orderBy("pos")
    ours = line.withColumn("agent", agent).withColumn("in", F.last("agent", ignorenulls=True).over(w)).filter("in and agent is null")
    rest = lambda name: F.when(F.col("line").startswith(name), trim(F.substring("line", len(name) + 1, 1 << 20)))
    rate = F.split(rest("Request-rate:"), "/", 2)
    n, d = rate[0].try_cast("double"), F.regexp_extract(trim(F.get(rate, F.lit(1))), r"^(\S*)", 1)
    d = F.when(d == "", F.lit("1")).otherwise(d).try_cast("double")
    parsed = ours.select(origin_col, "pos", F.nullif(rest("Disallow:"), F.lit("")).alias("path"), rest("Crawl-delay:").try_cast("double").alias("delay"), F.when((F.size(rate) > 1) & (n > 0) & (d > 0), n / d).alias("rate"))
    found = parsed.groupBy(origin_col).agg(F.transform(F.array_sort(F.collect_list(F.when(F.col("path").isNotNull(), F.struct("pos", "path")))), lambda x: x["path"]).alias("disallowed"), F.max_by("delay", F.when(F.col("delay").isNotNull(), F.col("pos"))).alias("crawl_delay"), F.max_by("rate", F.when(F.col("rate").isNotNull(), F.col("pos"))).alias("request_rate"))
    out = files.select(F.col(origin_col).alias("o_")).distinct().join(found, F.col("o_").eqNullSafe(F.col(origin_col)), "left")
    return out.select(F.col("o_").alias(origin_col), F.coalesce("disallowed", F.array().cast("array<string>")).alias("disallowed"), "crawl_delay", "request_rate")


def robots_allowed(requests: DataFrame, rules: DataFrame, url_col: str = "url") -> DataFrame:
    """Requests whose path begins with no disallowed prefix of their origin; an origin without rules allows all."""
    r = rules.select(F.col("origin").alias("r_origin"), "disallowed")
    path = U.path(F.col(url_col))
    joined = requests.join(r, U.origin(F.col(url_col)) == F.col("r_origin"), "left")
    hit = F.exists("disallowed", lambda d: path.startswith(d))
    return joined.filter(~F.coalesce(hit, F.lit(False))).drop("r_origin", "disallowed")


def sitemap(files: DataFrame, callback: str, body_col: str = "body") -> DataFrame:
    """A request per location of a sitemap: depth 0, priority 0."""
    found = files.select(F.explode(F.regexp_extract_all(body_col, F.lit(r"<loc>\s*(.*?)\s*</loc>"), F.lit(1))).alias("url"))
    return found.select(trim(F.col("url")).alias("url"), F.lit(callback).alias("callback"), F.lit(0).alias("depth"), F.lit(0).alias("priority")).filter("url <> ''")


def learned_rules(seen: DataFrame, most: int = 1000) -> DataFrame:
    """pattern, mode, rule_order: a rule per generalised path, the last mode winning, the first `most` patterns counting. seen: url, mode, seq."""
    rows = seen.withColumn("pattern", U.generalize_url(F.col("url"))).groupBy("pattern").agg(F.max_by("mode", "seq").alias("mode"), F.min("seq").alias("rule_order"))
    return rows.orderBy("rule_order").limit(most)


GRAM = 3


def required_literal(pattern: str) -> str:
    """The longest text that every match of a regular expression contains, as far as the pattern's plain characters tell; '' if they tell nothing."""
    if re.search(r"\(\?[a-zA-Z]*i|\\Q", pattern):
        return ""
    runs, run, i, depth = [], "", 0, 0
    while i < len(pattern):
        c = pattern[i]
        i += 1
        if c == "|" and not depth:
            return ""  # either side may match
        if c == "\\" and i < len(pattern):
            c, i = pattern[i], i + 1
            plain = not c.isalnum()
        elif c == "[":
            i += pattern[i : i + 1] == "^"
            i += pattern[i : i + 1] == "]"
            while i < len(pattern) and pattern[i] != "]":
                i += 1 + (pattern[i] == "\\")
            i, plain = i + 1, False
        elif c in "()":
            depth += 1 if c == "(" else -1
            plain = False
        else:
            plain = c not in ".^$|"
        many = re.match(r"[*+?]|\{(\d*)[^}]*\}", pattern[i:])
        if plain and not depth and not (many and (many[0] in "*?" or many[1] is not None and int(many[1] or 0) == 0)):
            run += c
            if not many:
                continue
        runs.append(run)
        run = ""
        if many:
            i += many.end()
            i += pattern[i : i + 1] in ("?", "+") and i < len(pattern)
    return max([*runs, run], key=len)


def _first(patterns: list[str], values: list, kind: str, path: Column, url: Column) -> Column:
    """The value that belongs to the first pattern of the list that fits; null if none does."""
    found = F.lit(None).cast(kind)
    for i in reversed(range(0, len(patterns), 100)):  # literal patterns, which are compiled once
        case = F
        for pattern, value in zip(patterns[i : i + 100], values[i : i + 100], strict=True):
            case = case.when(F.rlike(path, F.lit(pattern)) | F.rlike(url, F.lit(pattern)), F.lit(value))
        found = case.otherwise(found)
    return found


def resolve_modes(requests: DataFrame, rules: DataFrame, url_col: str = "url", few: int = 500) -> DataFrame:
    """requests with mode: of the first rule whose pattern is found in the path or the url, user rules before learned ones; null without one.

    rules: kind (user or auto), rule_order, pattern, mode; any number. Up to `few` patterns become one expression. More are an index: every pattern that requires a text of three
    characters is kept under that three-character part of it which the fewest urls have, distinct urls are joined by their parts, and only pairs
    whose url has the whole required text are matched. Patterns that require no such text are expressions, a thousand of them at a time."""
    rule = F.min(F.struct((F.col("kind") != "user").alias("auto"), F.col("rule_order").cast("long").alias("rule_order"), "pattern", "mode"))
    keyed = rules.filter("pattern is not null").groupBy("pattern").agg(rule.alias("r_")).select("r_.*")  # of equal patterns only the first rule can count
    order = lambda r: (r.auto, r.rule_order, r.pattern)
    url = F.col(url_col)
    path_of = lambda u: F.when(U.authority(u) != "", U.path(u)).otherwise(u)
    listed = keyed.limit(few + 1).collect()
    if len(listed) <= few:
        listed = sorted(listed, key=order)
        return requests.withColumn("mode", _first([r.pattern for r in listed], [r.mode for r in listed], "string", path_of(url), url))

    @F.pandas_udf("string")
    def literal(patterns: pd.Series) -> pd.Series:
        return patterns.map(required_literal)

    keyed = written(keyed.withColumn("literal", literal("pattern")), "mode-rules")
    grams = lambda c: F.when(F.length(c) >= GRAM, F.array_distinct(F.transform(F.sequence(F.lit(1), F.length(c) - GRAM + 1), lambda i: F.substr(c, i, F.lit(GRAM))))).otherwise(F.array().cast("array<string>"))
    urls = written(requests.filter(url.isNotNull()).select(url.alias("u_")).distinct(), "mode-urls")
    parts = urls.select("u_", F.explode(grams(F.col("u_"))).alias("gram"))
    wanted = keyed.filter(F.length("literal") >= GRAM).select("*", F.explode(grams(F.col("literal"))).alias("gram"))
    counts = written(parts.join(wanted.select("gram").distinct(), "gram", "left_semi").groupBy("gram").agg(F.count(F.lit(1)).alias("n")), "mode-grams")
    # a part that no url has leaves no row of counts: such a rule fits nothing
    rarest = wanted.join(counts, "gram", "left").groupBy("auto", "rule_order", "pattern", "mode", "literal").agg(F.min_by("gram", F.struct(F.coalesce("n", F.lit(0)).alias("n"), "gram")).alias("gram"), F.min(F.coalesce("n", F.lit(0))).alias("n"))
    index = written(rarest.filter("n > 0").drop("n"), "mode-index")
    pairs = parts.join(index.select("gram").distinct(), "gram", "left_semi").join(index, "gram").filter(F.contains("u_", F.col("literal")))
    pairs = pairs.withColumn("p_", path_of(F.col("u_"))).filter(F.rlike("p_", F.col("pattern")) | F.rlike("u_", F.col("pattern")))
    first = F.struct("auto", "rule_order", "pattern", "mode")
    best = written(pairs.groupBy("u_").agg(F.min(first).alias("best_")), "mode-found")
    general = sorted(keyed.filter(F.length("literal") < GRAM).drop("literal").collect(), key=order)
    found = urls.join(best, "u_", "left")
    for i in range(0, len(general), 1000):
        some = general[i : i + 1000]
        named = requests.sparkSession.createDataFrame([(k, tuple(r)) for k, r in enumerate(some)], "k_ int, of_ struct<auto:boolean,rule_order:long,pattern:string,mode:string>")
        fits = found.withColumn("k_", _first([r.pattern for r in some], list(range(len(some))), "int", path_of(F.col("u_")), F.col("u_")))
        found = written(fits.join(named, "k_", "left").select("u_", F.least("best_", "of_").alias("best_")), "mode-found")
    found = found.select("u_", F.col("best_.mode").alias("mode"))
    return requests.join(found, url == F.col("u_"), "left").drop("u_")


def route(requests: DataFrame, owners: DataFrame) -> DataFrame:
    """requests with routed: the named spider if it exists, else the only owner of the callback, else null.
    owners: spider, callback."""
    names = owners.select(F.col("spider").alias("named_")).distinct()
    only = owners.groupBy(F.col("callback").alias("cb_")).agg(F.count_distinct("spider").alias("n_"), F.min("spider").alias("only_")).filter("n_ = 1")
    got = requests.join(names, F.col("spider") == F.col("named_"), "left").join(only, F.coalesce("callback", F.lit("default")) == F.col("cb_"), "left")
    return got.withColumn("routed", F.when(F.col("spider").isNotNull(), F.col("named_")).otherwise(F.col("only_"))).drop("named_", "cb_", "n_", "only_")


def cached_rules(fetched: DataFrame, now: int, failed_ttl: int = 60) -> DataFrame:
    """origin, disallowed, crawl_delay, request_rate as a cache of robots files has them at `now`: the last fetch of each origin counts. A file that
    was fetched stays; a failed fetch means no rules for failed_ttl seconds, and after that the origin is unknown. fetched: origin, body (null:
    failed), fetched_at."""
    last = fetched.groupBy("origin").agg(F.max_by(F.struct("body", "fetched_at"), F.col("fetched_at")).alias("l"))
    known = last.select("origin", "l.body", "l.fetched_at").filter(F.col("body").isNotNull() | (F.lit(now) < F.col("fetched_at") + failed_ttl))
    return robots_rules(known.select("origin", F.coalesce("body", F.lit("")).alias("body")))


def live(cached_at: Column, ttl: Column, now: Column) -> Column:
    """Not older than its time to live; without one, for ever."""
    return ttl.isNull() | (now <= cached_at + ttl)


def file_entry_live(expires_at_ms: Column, now_ms: Column) -> Column:
    return (expires_at_ms == 0) | (now_ms <= expires_at_ms)
