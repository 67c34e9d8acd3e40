"""Functions held against rows written by hand; the queries over tables are in the package."""

import duckdb
import pytest
from pyspark.sql import Window, functions as F

from corpusmill.functions import text as T, urls as U, web
from corpusmill.operators import frontier, rules
from corpusmill.plans import tools
from corpusmill.sources import sinks
from corpusmill.streaming import events as E

CASES = {}


def query(sql):
    def add(f):
        CASES[f.__name__] = (f, sql)
        return f

    return add


@query("SELECT * FROM (VALUES ('*://*.ads.example/*'), ('*://ads.example/*')) t(pattern)")
def q_block_patterns(spark, d):
    return spark.createDataFrame([(p,) for p in frontier.block_patterns(["ads.example"])], "pattern string")


@query(r"""SELECT * FROM (VALUES ('turnstile'), ('js_challenge'), ('managed'), ('none')) t(kind)""")
def q_challenge_type(spark, d):
    rows = [('<div class="cf-turnstile">',), ("<title>Just a moment...</title>",), ('<p id="challenge-stage">',), ("<p>hello",)]
    return spark.createDataFrame(rows, "html string").select(web.challenge_type(F.col("html")).alias("kind"))


_ROBOTS = [("https://a.example", "User-agent: *\nDisallow: /private\nDisallow:\nCrawl-delay: 2\nRequest-rate: 1/5\nUser-agent: bot\nDisallow: /\n"), ("https://b.example", "# none\nUser-agent: x\nDisallow: /\n"), ("https://c.example", "User-agent: *\r\nDisallow: /a\r\nCrawl-delay: abc")]


@query("""SELECT * FROM (VALUES ('https://a.example', '/private', 2.0::DOUBLE, 0.2::DOUBLE), ('https://b.example', '', NULL, NULL), ('https://c.example', '/a', NULL, NULL)) t(origin, disallowed, crawl_delay, request_rate)""")
def q_robots_parse(spark, d):
    r = rules.robots_rules(spark.createDataFrame(_ROBOTS, "origin string, body string"))
    return r.withColumn("disallowed", F.array_join("disallowed", ","))


@query("SELECT * FROM (VALUES ('https://x.example/1', 'content', 0, 0), ('https://x.example/2?a=b', 'content', 0, 0)) t(url, callback, depth, priority)")
def q_sitemap(spark, d):
    xml = "<urlset><url><loc> https://x.example/1 </loc></url><url><loc>https://x.example/2?a=b</loc></url><url><loc></loc></url></urlset>"
    return rules.sitemap(spark.createDataFrame([(xml,)], "body string"), "content")


_HREFS = [("https://e.com/a/b?x#y", "/p q", "https://e.com/p%20q"), ("https://e.com/a/b", "c/../d", "https://e.com/a/d"), ("https://e.com/a/b", "//o.org/x", "https://o.org/x"), ("https://e.com/a", "mailto:x@y.z", None), ("https://e.com/a", "javascript:void(0)", None), ("https://e.com/a", "HTTP://O.org:80/É", "http://o.org/%C3%89"), ("nope", "/x", None), ("https://e.com/a", "http://O.org/É", "http://O.org/É"), ("https://e.com/a?q=1", "#f", "https://e.com/a?q=1#f"), ("https://e.com/a/b", "?z=1", "https://e.com/a/b?z=1")]


@query("SELECT * FROM (VALUES " + ", ".join("(" + ", ".join("NULL" if x is None else f"'{x}'" for x in r) + ")" for r in _HREFS) + ") t(base, href, target)")
def q_resolve_href(spark, d):
    rows = spark.createDataFrame([r[:2] for r in _HREFS], "base string, href string")
    return rows.withColumn("target", U.resolve_href(F.col("base"), F.col("href")))


_SAFE = [("https://example.com/x", True), ("http://127.0.0.1/", False), ("http://10.1.2.3/", False), ("http://172.20.0.1/", False), ("http://172.32.0.1/", True), ("http://192.168.1.1:8080/", False), ("http://169.254.1.1/", False), ("http://0.0.0.0/", False), ("http://224.0.0.1/", False), ("http://8.8.8.8/", True), ("ftp://example.com/", False), ("http://[::1]/", False), ("http://[fe80::1]/", False), ("http://[2001:db8::1]/", True), ("nonsense", False), (" https://e.org ", True)]


@query("SELECT * FROM (VALUES " + ", ".join(f"('{u}', {ok})" for u, ok in _SAFE) + ") t(url, ok)")
def q_valid_url(spark, d):
    return spark.createDataFrame([(u,) for u, _ in _SAFE], "url string").withColumn("ok", U.valid_url(F.col("url")))


_BODIES = [("C4E3BAC3", "text/html; charset=gbk", "你好"), ("A741A66E", "text/html; charset=big5", "你好"), ("82B182F182C982BF82CD", "text/html; charset=Shift_JIS", "こんにちは"), ("CFF0E8E2E5F2", "text/plain; charset=windows-1251", "Привет"), ("EFBBBF68C3A9", "text/html; charset=gbk", "hé"), ("68C3A9", "", "hé"), ("3C6D65746120636861727365743D67626B3EC4E3BAC3", "", "<meta charset=gbk>你好"), ("68FF", "", "h�"), ("68", "text/html; charset=unknown", "h")]


@query("SELECT * FROM (VALUES " + ", ".join(f"('{h}', '{s}')" for h, _, s in _BODIES) + ") t(hexed, decoded)")
def q_decode(spark, d):
    rows = spark.createDataFrame([r[:2] for r in _BODIES], "hexed string, content_type string")
    return rows.select("hexed", T.decode(F.unhex("hexed"), F.col("content_type")).alias("decoded"))


@query("SELECT * FROM (VALUES ('a=1; b=2', '403 c=3', true, false)) t(header, again, same, other)")
def q_cookies(spark, d):
    row = spark.range(1)
    jar = F.array(F.struct(F.lit("a").alias("name"), F.lit("1").alias("value")), F.struct(F.lit("b").alias("name"), F.lit("2").alias("value")))
    again = F.concat(F.lit("403 "), web.cookie_challenge(F.lit(403), F.lit("short"), F.lit("c=3; path=/"), F.lit("")))
    match = lambda h: web.cookie_matches(F.lit(".e.com"), F.lit("/"), F.lit(h), F.lit("/x"))
    return row.select(web.cookie_header(jar).alias("header"), again.alias("again"), match("a.e.com").alias("same"), match("ae.com").alias("other"))


@query("SELECT * FROM (VALUES (1, 10), (2, 6), (3, 6), (4, 8)) t(step, target)")
def q_autoscale(spark, d):
    rows = [("s", 0, 0.0, 0.8), ("s", 1000, 0.5, 0.5), ("s", 2000, 0.5, 0.5), ("s", 9000, 0.0, 0.95)]
    got = E.autoscale(spark.createDataFrame(rows, "spider string, ts_ms long, error_rate double, saturation double"), 10, 2, 20)
    return got.select(F.row_number().over(Window.partitionBy("spider").orderBy("ts_ms")).alias("step"), "target")


@query("SELECT * FROM (VALUES ('https://a.example/1', 'a', 0, 0, 'GET'), ('https://a.example/2', 'a', 0, 0, 'GET'), ('https://b.example/', 'b', 0, 0, 'GET')) t(url, spider, depth, priority, method)")
def q_seeds(spark, d):
    spiders = {"a": ["https://a.example/1", "https://a.example/2", "https://a.example/1"], "b": ["https://a.example/2", "https://b.example/"]}
    return frontier.seeds(spark, spiders).select("url", "spider", "depth", "priority", "method")


@query("""SELECT * FROM (VALUES ('{"value":{"a":1},"source_url":"","spider":"","callback":null,"id":""}', 2::BIGINT), ('{"value":2,"source_url":"","spider":"","callback":null,"id":""}', 2::BIGINT)) t(line, n)""")
def q_items(spark, d):
    held = sinks.Items.from_values(spark, ['{"a":1}', "2"])
    return held.to_jsonl().select(F.col("value").alias("line"), F.lit(len(held)).cast("long").alias("n"))


@query("SELECT 300::BIGINT AS waiting, 400::BIGINT AS seen, 399::BIGINT AS last_seq, 200::BIGINT AS fingerprints")
def q_import_state(spark, d):
    f = lambda a, b: spark.range(a, b).select(F.col("id").cast("string").alias("url"), F.col("id").alias("seq"))
    own, more = f(0, 200), f(100, 200)
    left, seen = frontier.import_state(own, frontier.seen_urls(own), more, f(200, 400).select("url"))
    one = left.agg(F.count(F.lit(1)).alias("waiting"), (F.max("seq") + 100).alias("last_seq"))
    return one.join(seen.agg(F.count(F.lit(1)).alias("seen")), F.lit(True)).join(frontier.seen_urls(own, fingerprints=True).agg(F.count(F.lit(1)).alias("fingerprints")), F.lit(True))


@query("SELECT * FROM (VALUES ('https://a.example', '/x'), ('https://b.example', '')) t(origin, disallowed)")
def q_robots_cache(spark, d):
    body = "User-agent: *\nDisallow: /x"
    fetched = [("https://a.example", None, 900), ("https://a.example", body, 10), ("https://a.example", body, 950), ("https://b.example", None, 960), ("https://c.example", None, 930), ("https://c.example", body, 20)]
    known = rules.cached_rules(spark.createDataFrame(fetched, "origin string, body string, fetched_at long"), now=1000)
    return known.select("origin", F.array_join("disallowed", ",").alias("disallowed"))


@query("""SELECT * FROM (VALUES (0, 'initialize', 'corpusmill'), (1, 'tools/list', '3'), (2, 'tools/call', '["a", "b"]'), (3, 'tools/call', '-32603'), (4, 'nothing', '-32601'), (5, '{', '-32700'), (6, 'fetch', '<p>x')) t(n, message, answer)""")
def q_rpc(spark, d):
    pages = spark.createDataFrame([("https://e.com/", "<p>x")], "url string, html string")
    call = lambda name, args: {"method": "tools/call", "id": 1, "params": {"name": name, "arguments": args}}
    sent = [("initialize", {"method": "initialize", "id": 1}, lambda x: x["result"]["serverInfo"]["name"]), ("tools/list", {"method": "tools/list", "id": 1}, lambda x: str(len(x["result"]["tools"]))), ("tools/call", call("extract_css", {"html": "<p>a<p>b", "selector": "p"}), lambda x: x["result"]["content"][0]["text"]), ("tools/call", call("fetch_page", {"url": "https://none.com/"}), lambda x: str(x["error"]["code"])), ("nothing", {"method": "nothing", "id": 1}, lambda x: str(x["error"]["code"])), ("{", None, lambda x: str(x["error"]["code"])), ("fetch", call("fetch_page", {"url": "https://e.com/"}), lambda x: x["result"]["content"][0]["text"])]
    import json

    rows = [(i, name, pick(json.loads(tools.handle(pages, "{" if message is None else json.dumps(message))))) for i, (name, message, pick) in enumerate(sent)]
    return spark.createDataFrame(rows, "n int, message string, answer string")


@pytest.mark.parametrize("name", sorted(CASES))
def test_constants(spark, name):
    make, sql = CASES[name]
    df = make(spark, None)
    cur = duckdb.connect().execute(sql)
    names = [c[0] for c in cur.description]
    assert sorted(str(list(r)) for r in df.select(names).collect()) == sorted(str(list(r)) for r in cur.fetchall())
