"""Cookies and sessions joined to urls."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from corpusmill.functions import urls as U, web
from corpusmill.operators.frontier import host_suffixes, latest


def cookies_for(requests: DataFrame, cookies: DataFrame, url_col: str = "url") -> DataFrame:
    """A row per url and cookie name that fits: of several cookies of one name the first in source order. cookies: name, value, domain, path,
    ord (order of the stores). The join is by the host's suffixes, so it is an equi-join; paths are a filter on it."""
    urls = requests.select(F.col(url_col).alias("url")).distinct().withColumns({"host": U.host(F.col("url")), "path": U.path(F.col("url"))})
    sides = urls.select("url", "host", "path", F.explode(host_suffixes(F.col("host"))).alias("suffix"))
    jar = cookies.select("name", "value", "domain", F.col("path").alias("c_path"), "ord", F.lower(F.regexp_replace("domain", r"^\.", "")).alias("c_domain"))
    fits = sides.join(jar, F.col("suffix") == F.col("c_domain")).filter(web.cookie_matches(F.lower("domain"), F.col("c_path"), F.col("host"), F.col("path")))
    first = fits.groupBy("url", "name").agg(F.min_by("value", F.struct("ord", "c_domain", "c_path")).alias("value"))
    return first


def cookie_headers(requests: DataFrame, cookies: DataFrame, url_col: str = "url") -> DataFrame:
    """requests with cookie: their cookies by name, as a header, or null."""
    found = cookies_for(requests, cookies, url_col).groupBy(F.col("url").alias("u_")).agg(F.array_sort(F.collect_list(F.struct("name", "value"))).alias("jar_"))
    return requests.join(found, F.col(url_col) == F.col("u_"), "left").withColumn("cookie", web.cookie_header(F.col("jar_"))).drop("u_", "jar_")


def session_keys(host: Column) -> Column:
    """Where a session of a host may be kept: the host, .host, then its parents of two labels or more, each with and without the dot."""
    labels = F.split(host, r"\.")
    kept = F.filter(F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.struct(i.alias("i"), F.array_join(F.slice(labels, i, F.size(labels)), ".").alias("s"))), lambda x: (x["i"] == 1) | (x["i"] <= F.size(labels) - 1))
    return F.flatten(F.transform(kept, lambda x: F.when((x["i"] == 1) & x["s"].startswith("."), F.array(x["s"])).otherwise(F.array(x["s"], F.concat(F.lit("."), x["s"])))))


def session_for(requests: DataFrame, sessions: DataFrame, url_col: str = "url") -> DataFrame:
    """requests with session: that of the first candidate key that has one. sessions: key, session."""
    hosts = requests.select(U.host(F.col(url_col)).alias("h_")).distinct()
    tried = hosts.select("h_", F.posexplode(session_keys(F.col("h_"))).alias("pos_", "key_"))
    first = tried.join(sessions.select(F.col("key").alias("k_"), "session"), F.col("key_") == F.col("k_")).groupBy("h_").agg(F.min_by("session", "pos_").alias("session"))
    return requests.join(first, U.host(F.col(url_col)) == F.col("h_"), "left").drop("h_")


def set_cookies(cookies: DataFrame, order_col: str = "seq") -> DataFrame:
    """The last cookie set for each name, domain and path."""
    return latest(cookies, ["name", "domain", "path"], order_col)
