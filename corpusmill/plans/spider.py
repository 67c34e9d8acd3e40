"""Crawl plans over stored pages: handlers by label, middleware and pipelines as ordered stages, a site crawl by selector."""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from corpusmill.functions import items as I, urls as U
from corpusmill.operators import cookies, dom, frontier, rules, scan
from corpusmill.sources import store

Stage = Callable[[DataFrame], DataFrame]


@dataclass(frozen=True)
class Options:
    """What a crawl takes into account, and what default_chain() makes a chain of."""

    max_pages: int | None = None
    max_depth: int | None = None
    allowed_domains: tuple[str, ...] = ()
    blocked_domains: tuple[str, ...] = ()
    block_ads: bool = False
    respect_robots: bool = True
    headers: tuple[tuple[str, str], ...] = ()
    user_agents: tuple[str, ...] = ()
    proxies: tuple[str, ...] = ()
    proxy_choice: str = "sequential"  # or random, or sticky by host
    delay_ms: int = 0
    retries: int = 3
    refetches: int = 5
    cache_ttl: int | None = 300
    now: int = 0

    def blocker(self) -> frontier.Blocker:
        own = frontier.Blocker(self.blocked_domains)
        return own.enable_ad_blocking() if self.block_ads else own


@dataclass
class Spider:
    """Handlers by label: each takes the pages of its callback, and gives items (value, source_url) and links to follow."""

    name: str
    start_urls: tuple[str, ...] = ()
    handlers: dict[str, Callable[[DataFrame], tuple[DataFrame | None, DataFrame | None]]] = field(default_factory=dict)

    def on(self, label: str, handler) -> Spider:
        return Spider(self.name, self.start_urls, self.handlers | {label: handler})

    def run(self, pages: DataFrame) -> tuple[DataFrame | None, DataFrame | None]:
        """Items and follows of the pages; those of a label without a handler go to `default`, and without that nowhere."""
        if not self.handlers:
            raise ValueError("a spider needs a handler")
        label = F.coalesce("callback", F.lit("default"))
        known = [k for k in self.handlers if k != "default"]
        items, follows = [], []
        for name, handler in self.handlers.items():
            own = pages.filter(~label.isin(*known) if name == "default" and known else label == name if name != "default" else F.lit(True))
            i, f = handler(own)
            items += [] if i is None else [i]
            follows += [] if f is None else [f]
        union = lambda xs: reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), xs) if xs else None
        got = union(items)
        return (None if got is None else as_items(got, self.name)), union(follows)


def as_items(rows: DataFrame, spider: str) -> DataFrame:
    """value, source_url, spider, callback, id; rows whose payload is null are left out."""
    cb = F.col("callback") if "callback" in rows.columns else F.lit(None).cast("string")
    return rows.filter("value is not null").select("value", "source_url", F.lit(spider).alias("spider"), cb.alias("callback"), I.item_id(F.col("value"), F.col("source_url"), cb).alias("id"))


def filter_item_fields(items: DataFrame, *fields: str) -> DataFrame:
    """Items with only these members of their payload, and a new id."""
    value = I.filter_fields(F.col("value"), fields)
    return items.withColumn("value", value).withColumn("id", I.item_id(F.col("value"), F.col("source_url"), F.col("callback")))


def pipeline(items: DataFrame, *stages: Stage) -> DataFrame:
    return reduce(lambda df, f: df.transform(f), stages, items)


@dataclass(frozen=True)
class Middleware:
    """A stage of requests or responses; lower priorities come first, equal ones in the order given."""

    priority: int
    stage: Stage
    name: str = ""


# The default order.
PRIORITIES = {"cache": 3, "robots": 8, "headers": 10, "delay": 15, "user_agent": 20, "proxy": 30, "dynamic": 40, "stealth": 45, "cookie": 50, "blocked": 80, "retry": 90}


def chain(df: DataFrame, middlewares: list[Middleware]) -> DataFrame:
    return pipeline(df, *[m.stage for m in sorted(middlewares, key=lambda m: m.priority)])


def default_chain(options: Options, cache: DataFrame | None = None, robots: DataFrame | None = None, jar: DataFrame | None = None) -> list[Middleware]:
    """The request stages that the options ask for, each at its priority: those that the cache (method, url, cached_at, ttl_secs) answers are left out,
    then those that robots rules (origin, disallowed) or the block list forbid; headers, delay, user agent, proxy and cookies (see cookies_for())
    are added; and of failures (attempt) those beyond the number of retries are left out."""
    steps: dict[str, Stage] = {}
    if cache is not None:
        steps["cache"] = lambda df: store.with_cache(df, cache, options.now)[1]
    if options.respect_robots and robots is not None:
        steps["robots"] = lambda df: rules.robots_allowed(df, robots)
    if options.headers:
        steps["headers"] = lambda df: with_headers(df, dict(options.headers))
    if options.delay_ms:
        steps["delay"] = lambda df: delayed(df, options.delay_ms)
    if options.user_agents:
        steps["user_agent"] = lambda df: rotated(df, list(options.user_agents), "user_agent")
    if options.proxies:
        steps["proxy"] = lambda df: proxied(df, list(options.proxies), options.proxy_choice)
    if jar is not None:
        steps["cookie"] = lambda df: cookies.cookie_headers(df, jar)
    if options.blocked_domains or options.block_ads:
        steps["blocked"] = lambda df: options.blocker().allowed(df, F.col("url"))
    steps["retry"] = lambda df: df.filter(F.col("attempt") <= options.retries) if "attempt" in df.columns else df
    return [Middleware(PRIORITIES[name], stage, name) for name, stage in steps.items()]


def with_headers(requests: DataFrame, headers: dict[str, str]) -> DataFrame:
    extra = F.create_map(*[F.lit(x) for kv in headers.items() for x in kv])
    old = F.coalesce("headers", F.create_map().cast("map<string,string>"))
    return requests.withColumn("headers", F.map_concat(F.map_filter(old, lambda k, _: ~k.isin(*headers)), extra))


def rotated(requests: DataFrame, values: list[str], out: str, seq: str = "seq", key: str | None = None) -> DataFrame:
    """A value per request in turn, or one that sticks to a key."""
    n = F.col(seq) if key is None else F.xxhash64(key)
    return requests.withColumn(out, F.element_at(F.array(*[F.lit(v) for v in values]), (F.pmod(n, F.lit(len(values))) + 1).cast("int")))


def proxied(requests: DataFrame, proxies: list[str], choice: str = "sequential", seq: str = "seq", seed: int = 0) -> DataFrame:
    """requests with proxy: in turn, by a hash of the request's number and the seed (random), or the same for each host (sticky)."""
    if choice == "sequential":
        return rotated(requests, proxies, "proxy", seq)
    key = F.concat_ws(":", F.col(seq).cast("string"), F.lit(str(seed))) if choice == "random" else U.host(F.col("url"))
    return rotated(requests.withColumn("by_", key), proxies, "proxy", key="by_").drop("by_")


def delayed(requests: DataFrame, delay_ms: int, seq: str = "seq") -> DataFrame:
    """requests with not_before_ms, after the start: those of one origin follow each other by delay_ms. seq tells an origin's requests apart; origins
    with many requests are split."""
    turn = scan.numbered(requests.withColumn("of_", U.origin(F.col("url"))), ["of_"], [seq], "turn_")
    return turn.withColumn("not_before_ms", (F.col("turn_") * delay_ms).cast("long")).drop("of_", "turn_")


def throttled(requests: DataFrame, delay_ms: int, burst: int = 1, arrival: str = "arrives_ms", seq: str = "seq") -> DataFrame:
    """requests with not_before_ms: when each may be sent if an origin takes `burst` at once and one more every delay_ms, in the order of their
    arrival (see scan.paced)."""
    paced = scan.paced(requests.withColumn("of_", U.origin(F.col("url"))), ["of_"], [arrival, seq], arrival, delay_ms, burst, "not_before_ms")
    return paced.drop("of_")


def on_links(selectors: tuple[str, ...], callback: str, meta_for=None, limit: int | None = None, keep=None):
    """A handler that follows the links of the first selector that matches, at most `limit` of each page."""
    return lambda pages: (None, frontier.follow_links(pages, selectors, callback, meta_for, limit, keep))


def content_handler(selectors: tuple[str, ...], clean: Callable[[Column], Column] = lambda c: c):
    """A handler whose items are on_content()."""
    return lambda pages: (on_content(pages, selectors, clean), None)


def on_content(pages: DataFrame, selectors: tuple[str, ...], clean: Callable[[Column], Column] = lambda c: c) -> DataFrame:
    """Items of the request's meta members with content and url."""
    meta = F.from_json(F.coalesce("meta", F.lit("{}")), "map<string,variant>")
    new = F.create_map(F.lit("content"), F.to_variant_object(F.array(clean(dom.content_text(F.col("html"), selectors)))), F.lit("url"), F.to_variant_object(F.array(F.col("url"))))
    first = F.transform_values(new, lambda _, v: F.variant_get(v, "$[0]", "variant"))
    old = F.map_filter(F.coalesce(meta, F.create_map().cast("map<string,variant>")), lambda k, _: ~k.isin("content", "url"))
    # never null, and Spark knows it: a filter on it, as of as_items(), would have pages parsed twice
    value = F.coalesce(F.to_json(F.map_concat(old, first)), F.lit("{}"))
    return pages.select(value.alias("value"), F.col("url").alias("source_url"), *(["callback"] if "callback" in pages.columns else []))


def crawl_site(pages: DataFrame, start_urls: list[str], css: str, follow: str | None = None, options: Options = Options(), robots: DataFrame | None = None, state: str | None = None) -> DataFrame:
    """Items {text, html} of the matches of css on all pages reached from start_urls by links, over stored pages.

    Links must match `follow` if given, stay within the options' domains and depth, not be blocked, and be allowed by robots (origin, body of the robots
    files) unless respect_robots is off; an origin without a file allows all. At most max_pages pages (100 if not given,
    1000 at most), in the order of their requests. It goes on until no link is left or so many pages are reached, however many hops that takes. Links are
    taken out of the pages once, beforehand; state is a folder from which a crawl that was broken off goes on."""
    if not start_urls:
        raise ValueError("start_urls is empty")
    spark = pages.sparkSession
    if follow:
        re.compile(follow)
    start = spark.createDataFrame(list(enumerate(start_urls)), "place long, url string")
    if start.filter(~U.valid_url(F.col("url"))).count():
        raise ValueError("a start url is not allowed")
    known = rules.robots_rules(robots) if options.respect_robots and robots is not None else None

    def allowed(urls: DataFrame, own: bool = True) -> DataFrame:
        if own:
            urls = options.blocker().allowed(frontier.in_domains(urls, list(options.allowed_domains), U.host(F.col("url"))), F.col("url"))
        return urls if known is None else rules.robots_allowed(urls, known)

    links = frontier.links(pages.select("url", "html"), keep=(lambda t: F.rlike(t, F.lit(follow))) if follow else None)
    links = allowed(links.select(F.col("url").alias("source"), F.col("idx").alias("place"), F.col("target").alias("url")))
    table = frontier.LinkTable(links.withColumn("callback", F.lit("default")), pages)
    most = min(options.max_pages or 100, 1000)
    requests = frontier.crawl(table, allowed(start, own=False), state, most=most, max_depth=options.max_depth or None)
    visited = requests.filter("stored").orderBy("place").limit(most).select("url", "place")
    nodes = pages.join(visited, "url").select("url", F.explode(dom.select_all(F.col("html"), css)).alias("n"))
    return as_items(nodes.select(F.to_json(F.struct(F.col("n.html").alias("html"), F.col("n.text").alias("text"))).alias("value"), F.col("url").alias("source_url")), "site")


def scrape(html: Column, selector: str, attr: str | None = None) -> Column:
    """The texts, or one attribute, of a selector's matches."""
    got = dom.select_all(html, selector)
    return F.transform(got, lambda n: F.coalesce(F.try_element_at(n["attrs"], F.lit(attr)), F.lit("")) if attr else n["text"])

