"""Link expansion and the frontier: follow, dedup, priority, domain and depth filters, multi-hop crawls over stored pages."""

from __future__ import annotations

from collections.abc import Callable
from itertools import count

import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

from corpusmill.functions import urls as U
from corpusmill.operators import dom
from corpusmill.sources.shared import new_path, spread, written


def follow(base: Column, href: Column, depth: Column, callback: Column | None = None, meta: Column | None = None, priority: Column | None = None) -> Column:
    """A frontier row: url (null if not http or https), depth one more, priority minus that depth unless given."""
    deeper = (depth + 1).cast("int")
    return F.struct(U.resolve_href(base, href).alias("url"), F.lit("GET").alias("method"), deeper.alias("depth"), (-deeper if priority is None else priority).cast("int").alias("priority"), (F.lit(None).cast("string") if callback is None else callback).alias("callback"), (F.lit(None).cast("string") if meta is None else meta).alias("meta"))


def links(pages: DataFrame, selectors: tuple[str, ...] = ("a[href]",), html_col: str = "html", url_col: str = "url", limit: int | None = None, keep: Callable[[Column], Column] | None = None) -> DataFrame:
    """pages, without html, with a row per link: idx (place among the matches), href, title, target.

    The first selector that matches anything counts; links without href or text, or that resolve to no http url, and
    those that keep(target) rejects, are left out; limit is per row of pages, also where urls repeat, over valid links."""

    @F.pandas_udf("array<struct<idx:int,href:string,title:string>>")
    def found(htmls: pd.Series) -> pd.Series:
        out = []
        for h in htmls:
            root = dom.parse(h or "")
            nodes = next((n for s in selectors if (n := dom.select(root, s))), [])
            out.append([{"idx": i, "href": n.attrs["href"], "title": t} for i, n in enumerate(nodes) if n.attrs.get("href") and (t := n.text().strip())])
        return pd.Series(out, dtype=object)

    rest = [c for c in pages.columns if c != html_col]
    rows = spread(pages).withColumn("page_", F.monotonically_increasing_id()).select(*rest, "page_", F.explode(found(html_col)).alias("link")).select(*rest, "page_", "link.*")
    rows = rows.withColumn("target", U.resolve_href(F.col(url_col), F.col("href"))).filter("target is not null")
    if keep is not None:
        rows = rows.filter(keep(F.col("target")))
    if limit is None:
        return rows.drop("page_")
    w = Window.partitionBy("page_").orderBy("idx")
    return rows.withColumn("nth_", F.row_number().over(w)).filter(F.col("nth_") <= limit).drop("nth_", "page_")


def follow_links(pages: DataFrame, selectors: tuple[str, ...] = ("a[href]",), callback: str | None = None, meta_for: Callable[[Column, Column], Column] | None = None, limit: int | None = None, keep: Callable[[Column], Column] | None = None) -> DataFrame:
    """Frontier rows of the links of each page: url, method, depth, priority, callback, meta, and source_url.

    meta_for(idx, title) is the metadata of the request, as JSON; idx is the link's place among all matches, those that give no
    request included. pages: url, html, and depth if not 0."""
    depth = F.col("depth") if "depth" in pages.columns else F.lit(0)
    found = links(pages.select("url", "html", depth.alias("depth_")), selectors, limit=limit, keep=keep)
    meta = F.lit(None).cast("string") if meta_for is None else meta_for(F.col("idx"), F.col("title")).cast("string")
    request = follow(F.col("url"), F.col("target"), F.col("depth_"), F.lit(callback).cast("string"), meta)
    return found.select(F.col("url").alias("source_url"), request.alias("r")).select("r.*", "source_url")


def seeds(spark, spiders: dict[str, list[str]] | DataFrame) -> DataFrame:
    """A depth-0 request per start url, each url once: of the spider that names it first. spiders: start urls by name, or a table of url, spider, seq."""
    df = spiders
    if not isinstance(spiders, DataFrame):
        rows = [(u, s, i) for i, (u, s) in enumerate((u, s) for s, us in spiders.items() for u in us)]
        df = spark.createDataFrame(rows, "url string, spider string, seq long")
    return push(df.withColumns({"depth": F.lit(0), "priority": F.lit(0), "method": F.lit("GET")}))


def push(requests: DataFrame, seen: DataFrame | None = None, url_col: str = "url", seq_col: str = "seq") -> DataFrame:
    """The first request of each url string that is not in seen; min_by aggregates before the shuffle, so repeats cost little."""
    if seen is not None:
        requests = requests.join(seen.select(F.col("url").alias("seen_")).distinct(), F.col(url_col) == F.col("seen_"), "left_anti")
    rest = [c for c in requests.columns if c != url_col]
    first = requests.groupBy(url_col).agg(F.min_by(F.struct(*rest), F.col(seq_col)).alias("r_"))
    return first.select(url_col, *[F.col(f"r_.`{c}`").alias(c) for c in rest]).select(*requests.columns)


def push_fingerprints(requests: DataFrame, url_col: str = "url", seq_col: str = "seq") -> DataFrame:
    """As push(), by a 64-bit fingerprint of the url: less state, and a collision drops an url."""
    marked = requests.withColumn("url_", F.xxhash64(url_col))
    return push(marked, url_col="url_", seq_col=seq_col).drop("url_")


def pop(frontier: DataFrame, k: int) -> DataFrame:
    """The k requests of highest priority, first come first among equals."""
    return frontier.orderBy(F.desc("priority"), "seq").limit(k)


def page_cap(pages: DataFrame, most: int, seq_col: str = "seq") -> DataFrame:
    return pages.orderBy(seq_col).limit(most)


def latest(rows: DataFrame, keys: list[str], order_col: str) -> DataFrame:
    """The last row of each key: cookies, key-value entries and learned rules are replaced that way."""
    rest = [c for c in rows.columns if c not in keys]
    got = rows.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.col(order_col)).alias("r_"))
    return got.select(*keys, *[F.col(f"r_.`{c}`").alias(c) for c in rest]).select(*rows.columns)


def merge_checkpoint(pending: DataFrame, in_flight: DataFrame) -> DataFrame:
    """Requests to run again: pending ones, then those in flight, each url once."""
    both = pending.withColumn("from_", F.lit(0)).unionByName(in_flight.withColumn("from_", F.lit(1)))
    return push(both.withColumn("order_", F.struct("from_", "seq")), seq_col="order_").drop("from_", "order_")


def pending_urls(frontier: DataFrame) -> DataFrame:
    """url and place (from 0) of the requests that wait, in the order in which they would be taken."""
    return placed(frontier, F.desc("priority"), F.asc("seq")).select("url", "place")


def placed(rows: DataFrame, *order: Column) -> DataFrame:
    """rows with place, from 0 in the given order: sorted by ranges, numbered in each, and shifted by the sizes of the ranges before, of which
    there is one row a range."""
    ranged = written(rows.orderBy(*order).withColumn("place_", F.monotonically_increasing_id()), "sorted")
    part = F.shiftright("place_", 33)
    sizes = ranged.groupBy(part.alias("part_")).agg(F.count(F.lit(1)).alias("n_"))
    before = sizes.select("part_", (F.sum("n_").over(Window.orderBy("part_")) - F.col("n_")).alias("before_"))
    return ranged.join(before, part == F.col("part_")).withColumn("place", F.col("before_") + F.col("place_") % (1 << 33)).drop("place_", "part_", "before_")


def seen_urls(requests: DataFrame, fingerprints: bool = False) -> DataFrame:
    """What has been pushed: urls, or their fingerprints as decimal strings."""
    key = F.xxhash64("url").cast("string") if fingerprints else F.col("url")
    return requests.select(key.alias("url")).distinct()


def import_state(frontier: DataFrame, seen: DataFrame, pending: DataFrame, more_seen: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The frontier with pending behind its own requests, none of them dropped, and the set of seen urls with those of both."""
    top = frontier.agg(F.coalesce(F.max("seq"), F.lit(-1)).alias("top_"))
    behind = placed(pending, F.asc("seq")).join(top, F.lit(True)).withColumn("seq", (F.col("top_") + 1 + F.col("place")).cast("long")).select(*frontier.columns)
    return frontier.unionByName(behind), seen.select("url").union(more_seen.select("url")).union(pending.select("url")).distinct()


def seen_warning(seen: DataFrame, most: int) -> DataFrame:
    """One row, warning, when more than `most` urls have been seen, and else none."""
    n = seen.agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > most)
    return n.select(F.format_string(f"%d urls have been seen, more than {most}", "n").alias("warning"))


def host_suffixes(host: Column) -> Column:
    """The host and its parent domains."""
    labels = F.split(F.lower(host), r"\.")
    return F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))


def in_domains(rows: DataFrame, domains: list[str] | DataFrame, host: Column, keep: bool = True, most: int = 1000) -> DataFrame:
    """Rows whose host is one of the domains or below one; with keep=False the others.

    A list of up to `most` becomes an expression; a longer one, or a table (column domain), is joined by the host's suffixes,
    which Spark broadcasts only if the table is small."""
    if not isinstance(domains, DataFrame):
        if not domains:
            return rows if keep else rows.filter(F.lit(False))
        if len(domains) <= most:
            hit = F.coalesce(F.arrays_overlap(host_suffixes(host), F.array(*[F.lit(d.lower()) for d in domains])), F.lit(False))
            return rows.filter(hit if keep else ~hit)
        domains = rows.sparkSession.createDataFrame([(d,) for d in domains], "domain string")
    names = domains.select(F.lower("domain").alias("domain_")).distinct()
    hosts = rows.select(host.alias("host_")).distinct().select("host_", F.explode(host_suffixes(F.col("host_"))).alias("suffix_"))
    hit = hosts.join(names, F.col("suffix_") == F.col("domain_"), "left_semi").select("host_").distinct()
    return rows.join(hit, host.eqNullSafe(F.col("host_")), "left_semi" if keep else "left_anti")


def depth_limit(rows: DataFrame, most: int | None) -> DataFrame:
    return rows if not most else rows.filter(F.col("depth") <= most)


# Domains of advertising and tracking services. Those with a path are listed and counted, but are no host's name.
AD_DOMAINS = (
    "doubleclick.net",
    "googlesyndication.com",
    "googleadservices.com",
    "google-analytics.com",
    "googletagmanager.com",
    "googletagservices.com",
    "adservice.google.com",
    "pagead2.googlesyndication.com",
    "facebook.net",
    "fbcdn.net",
    "connect.facebook.net",
    "adnxs.com",
    "adsrvr.org",
    "adform.net",
    "adcolony.com",
    "admob.com",
    "adroll.com",
    "adtech.de",
    "adtechus.com",
    "advertising.com",
    "adzerk.net",
    "appnexus.com",
    "buysellads.com",
    "carbonads.com",
    "casalemedia.com",
    "chitika.net",
    "contextweb.com",
    "conversantmedia.com",
    "criteo.com",
    "criteo.net",
    "dotomi.com",
    "exponential.com",
    "indexexchange.com",
    "infolinks.com",
    "inner-active.com",
    "integralads.com",
    "intentiq.com",
    "intercom.io",
    "kargo.com",
    "krxd.net",
    "lijit.com",
    "liveintent.com",
    "liveramp.com",
    "mathtag.com",
    "media.net",
    "mediaplex.com",
    "moatads.com",
    "mookie1.com",
    "nexage.com",
    "openx.net",
    "outbrain.com",
    "owneriq.net",
    "pubmatic.com",
    "quantserve.com",
    "revcontent.com",
    "rubiconproject.com",
    "serving-sys.com",
    "sharethrough.com",
    "smaato.net",
    "smartadserver.com",
    "spotxchange.com",
    "taboola.com",
    "tapad.com",
    "tidaltv.com",
    "tribalfusion.com",
    "turn.com",
    "undertone.com",
    "yieldmo.com",
    "mixpanel.com",
    "segment.io",
    "segment.com",
    "amplitude.com",
    "heap.io",
    "hotjar.com",
    "fullstory.com",
    "mouseflow.com",
    "crazyegg.com",
    "clicktale.com",
    "kissmetrics.com",
    "chartbeat.com",
    "newrelic.com",
    "nr-data.net",
    "omtrdc.net",
    "scorecardresearch.com",
    "quantcount.com",
    "comscore.com",
    "twitter.com/i/adsct",
    "platform.twitter.com",
    "platform.linkedin.com",
    "snap.licdn.com",
    "pinterest.com/ct",
    "cloudfront.net/ads",
    "akamaihd.net/ads",
    "fastly.net/ads",
    "popads.net",
    "popcash.net",
    "propellerads.com",
    "revive-adserver.com",
    "cnzz.com",
    "hm.baidu.com",
    "pos.baidu.com",
    "cpro.baidu.com",
    "tongji.baidu.com",
    "51.la",
    "tanx.com",
    "alimama.com",
    "mmstat.com",
    "irs01.com",
    "suning.com/ads",
    "qq.com/ads",
    "gtimg.cn/ads",
    "mailtrack.io",
    "bananatag.com",
    "yesware.com",
    "bugsnag.com",
    "sentry.io",
    "rollbar.com",
    "raygun.io",
    "airbrake.io",
    "honeybadger.io",
    "fingerprintjs.com",
    "threatmetrix.com",
    "iovation.com",
    "sift.com",
    "quantcast.mgr.consensu.org",
    "trustarc.com",
    "onetrust.com",
    "cookiebot.com",
    "usercentrics.eu",
    "jwpcdn.com/ads",
    "videoplaza.tv",
    "spotx.tv",
    "freewheel.tv",
    "mgid.com",
    "zemanta.com",
    "nativo.com",
    "shareaholic.com",
    "onesignal.com",
    "pushcrew.com",
    "pusher.com/ads",
    "gravitec.net",
    "coinhive.com",
    "coin-hive.com",
    "cryptoloot.pro",
    "webminepool.com",
)


class Blocker:
    """Domains to block, with their subdomains; names are compared in lower case."""

    def __init__(self, domains: tuple[str, ...] = ()):
        self.domains = tuple(dict.fromkeys(d.lower() for d in domains))

    def block_domain(self, *domains: str) -> Blocker:
        return Blocker((*self.domains, *domains))

    def enable_ad_blocking(self) -> Blocker:
        return self.block_domain(*AD_DOMAINS)

    def __len__(self) -> int:
        return len(self.domains)

    def patterns(self) -> list[str]:
        return block_patterns(list(self.domains))

    def table(self, spark) -> DataFrame:
        return spark.createDataFrame([(d,) for d in self.domains], "domain string")

    def allowed(self, rows: DataFrame, url: Column) -> DataFrame:
        return blocked_hosts(rows, url, list(self.domains), keep_blocked=False) if self.domains else rows


def is_blocked(url: Column, domains: list[str]) -> Column:
    """Whether the url's host is one of the domains or below one; false without a host. The list becomes an expression."""
    names = F.array(*[F.lit(d.lower()) for d in domains]).cast("array<string>")
    return F.coalesce(F.arrays_overlap(host_suffixes(U.host(url)), names), F.lit(False))


def blocked_hosts(rows: DataFrame, url: Column, domains: list[str] | None = None, keep_blocked: bool = True) -> DataFrame:
    """Rows whose url's host is on the block list (the built-in one if none is given); urls without a host never are."""
    return in_domains(rows, list(AD_DOMAINS) if domains is None else [d.lower() for d in domains], U.host(url), keep_blocked)


def block_patterns_of(domain: Column) -> Column:
    """The patterns of block_patterns() for a domain of each row, as an array."""
    return F.array(F.concat(F.lit("*://*."), domain, F.lit("/*")), F.concat(F.lit("*://"), domain, F.lit("/*")))


def block_patterns(domains: list[str]) -> list[str]:
    return [p for d in domains for p in (f"*://*.{d}/*", f"*://{d}/*")]


# ---- crawls: a search over a table of links


class LinkTable:
    """Links in the shared folder, in directories by a hash of their source, so that a round of a crawl reads those of its frontier's sources only.

    links: source, place (of the link among the source's), url, and, where they matter, callback and meta of the request, and only_for (the callback
    of the source for which the link is followed; null: any). stored: url of all pages that there are."""

    FORM = "source string, place long, url string, callback string, meta string, only_for string"

    def __init__(self, links: DataFrame, stored: DataFrame, buckets: int | None = None, rows_per_bucket: int = 500_000):
        self.spark = links.sparkSession
        if buckets is None:  # a directory holds about so many links
            links = written(links, "all-links")
            buckets = min(1024, 1 + links.count() // rows_per_bucket)
        self.buckets = buckets
        root = new_path(self.spark, "links")
        self.links_path, self.stored_path = f"{root}/links", f"{root}/stored"
        for name in ("callback", "meta", "only_for"):
            if name not in links.columns:
                links = links.withColumn(name, F.lit(None).cast("string"))
        rows = links.select("source", F.col("place").cast("long").alias("place"), "url", "callback", "meta", "only_for", self.bucket("source"))
        rows.repartition(4 * buckets, "bucket_", F.pmod("place", F.lit(4))).write.partitionBy("bucket_").parquet(self.links_path)
        stored.select("url").distinct().withColumn("bucket_", self.bucket("url")).repartition(buckets, "bucket_").write.partitionBy("bucket_").parquet(self.stored_path)

    def bucket(self, url: str) -> Column:
        return F.pmod(F.xxhash64(url), F.lit(self.buckets)).cast("int").alias("bucket_")

    def links(self, buckets: list[int]) -> DataFrame:
        return self.spark.read.schema(self.FORM + ", bucket_ int").parquet(self.links_path).filter(F.col("bucket_").isin(buckets))

    def stored(self, buckets: list[int]) -> DataFrame:
        return self.spark.read.schema("url string, bucket_ int").parquet(self.stored_path).filter(F.col("bucket_").isin(buckets))


_FEW = 100_000  # rows that one window may take
_ROUND = "url string, callback string, meta string, depth int, place long, stored boolean, round int, bucket_ int"


def _below(spark, path: str, name: str, whole: bool = False) -> list[int]:
    """The values of name=value directories below path; whole: only those whose writing ended well."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = at.getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.exists(at):
        return []
    found = [x.getPath() for x in fs.listStatus(at) if x.getPath().getName().startswith(f"{name}=")]
    return sorted(int(p.getName().split("=")[1]) for p in found if not whole or fs.exists(spark._jvm.org.apache.hadoop.fs.Path(p, "_SUCCESS")))


def crawl(table: LinkTable, start: DataFrame, state: str | None = None, rounds: int | None = None, most: int | None = None, max_depth: int | None = None) -> DataFrame:
    """url, callback, meta, depth, place, stored, round of all requests that links lead to from start (url, place, and callback and meta if they matter), each
    url once, stored or not; place is the order of requests, from 0.

    Rounds go from the requests found last to those that they lead to and that were not found before, so that no link is followed twice. As in a
    queue of one crawler, the first push of an url wins: of a round's links to it, the one of the earliest source, and of that the first in place; that link gives callback,
    metadata and depth. A round reads the links of its own sources' buckets, and the requests so far of its targets' buckets. It ends when nothing new is found, at max_depth, with
    the round in which `most` stored pages are reached, or after `rounds` more rounds.

    Every round is a table below state, which is a checkpoint: with the same state a crawl that was broken off goes on behind its last whole round."""
    spark = table.spark
    state = state or new_path(spark, "crawl")
    path = f"{state}/requests"

    def put(rows: DataFrame, r: int) -> None:
        near = table.stored(buckets) if (buckets := _below(spark, f"{state}/new/step={r}", "bucket_")) else None
        if near is None:
            spark.createDataFrame([], _ROUND).drop("round").write.mode("overwrite").partitionBy("bucket_").parquet(f"{path}/round={r}")
            return
        near = near.select(F.col("url").alias("n_url"))
        rows = rows.join(near, F.col("url") == F.col("n_url"), "left").select("url", "callback", "meta", "depth", "place", F.col("n_url").isNotNull().alias("stored"), table.bucket("url"))
        rows.repartition(table.buckets, "bucket_").write.mode("overwrite").partitionBy("bucket_").parquet(f"{path}/round={r}")

    def step(rows: DataFrame, r: int) -> DataFrame:
        """The first push of each url, by the order of sources and places; a table by buckets."""
        first = rows.groupBy("url").agg(F.min_by(F.struct("callback", "meta", "depth"), F.struct("source_place", "place")).alias("r_"), F.min(F.struct("source_place", "place")).alias("o_"))
        first = first.select("url", "r_.*", "o_.*", table.bucket("url"))
        first.repartition(table.buckets, "bucket_").write.mode("overwrite").partitionBy("bucket_").parquet(f"{state}/new/step={r}")
        return spark.read.schema("url string, callback string, meta string, depth int, source_place long, place long, bucket_ int").parquet(f"{state}/new/step={r}")

    def ordered(rows: DataFrame, base: int, most_rows: int) -> DataFrame:
        """rows numbered on from base; a bounded number of them in one window, which takes fewer jobs, and more of them by ranges."""
        rows, order = rows.withColumnRenamed("place", "link_place"), (F.asc("source_place"), F.asc("link_place"), F.asc("url"))
        if most_rows <= _FEW:
            return rows.withColumn("place", F.row_number().over(Window.orderBy(*order)) - 1 + F.lit(base).cast("long"))
        return placed(rows, *order).withColumn("place", F.col("place") + base)

    def so_far(last: int) -> DataFrame:
        return spark.read.schema(_ROUND).parquet(path).filter(F.col("round") <= last)

    whole = _below(spark, path, "round", whole=True)
    if not whole:
        for name in ("callback", "meta"):
            if name not in start.columns:
                start = start.withColumn(name, F.lit(None).cast("string"))
        rows = start.select("url", "callback", "meta", F.lit(0).alias("depth"), F.lit(0).cast("long").alias("source_place"), F.col("place").cast("long").alias("place"))
        first = step(rows, 0)
        put(ordered(first, 0, first.count()), 0)
        whole = [0]
    r = whole[-1]
    counts = so_far(r).agg(F.count(F.lit(1)).alias("n"), F.count_if("stored").alias("stored"), F.count_if(F.col("round") == r).alias("last")).first()
    n, found, last = counts.n, counts.stored, counts.last
    for _ in count() if rounds is None else range(rounds):
        if not last or most is not None and found >= most or max_depth is not None and r >= max_depth:
            break
        here = spark.read.schema(_ROUND).parquet(path).filter((F.col("round") == r) & F.col("stored"))
        here = here.select(F.col("url").alias("source"), F.col("callback").alias("of_callback"), F.col("place").alias("source_place"))
        links_ = table.links(_below(spark, f"{path}/round={r}", "bucket_")).join(here, "source").filter("only_for is null or only_for = of_callback")
        new = step(links_.select("url", "callback", "meta", F.lit(r + 1).alias("depth"), "source_place", "place"), r + 1)
        buckets = _below(spark, f"{state}/new/step={r + 1}", "bucket_")
        known = so_far(r).filter(F.col("bucket_").isin(buckets)).select(F.col("url").alias("k_url")) if buckets else None
        put(ordered(new if known is None else new.join(known, F.col("url") == F.col("k_url"), "left_anti"), n, new.count()), r + 1)
        r += 1
        got = spark.read.schema(_ROUND.replace(" round int,", "")).parquet(f"{path}/round={r}").agg(F.count(F.lit(1)).alias("n"), F.count_if("stored").alias("stored")).first()
        last, n, found = got.n, n + got.n, found + got.stored
    return so_far(r).drop("bucket_")
