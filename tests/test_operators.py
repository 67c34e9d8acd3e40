import pytest
from pyspark.sql import functions as F

from corpusmill.operators import dom, frontier, rules, stats
from corpusmill.plans import queries as Q, spider as S
from corpusmill.sources import sinks, store
from corpusmill.streaming import events as E


def test_select():
    t = dom.parse('<div class="item">First</div><div class="item">Second</div><p id="x" data-a="b c">P</p>')
    assert [n.text() for n in dom.select(t, "div.item")] == ["First", "Second"]
    assert dom.select(t, "p[onclick=alert(") == [] and dom.select(t, "") == []
    assert [n.tag for n in dom.select(t, "#x, p[data-a~=c]")] == ["p"]
    assert dom.matches(dom.select(t, "p")[0], "div + p:last-child") and not dom.matches(dom.select(t, "p")[0], "!!")
    li = dom.parse("<ul><li>A<li>B<li>C</ul>")
    assert [n.text() for n in dom.select(li, "li:nth-child(2n+1)")] == ["A", "C"]
    assert [n.text() for n in dom.select(li, "li ~ li:not(:last-child)")] == ["B"]


def test_tree():
    t = dom.parse("<!doctype html><title>a &amp; b</title><p>x<p>y<br>z<table><tr><td>1<td>2</table><script>if (a<b) {}</script><div>cut <b>off")
    assert t.outer_html() == "<html><head><title>a &amp; b</title></head><body><p>x</p><p>y<br>z</p><table><tbody><tr><td>1</td><td>2</td></tr></tbody></table><script>if (a<b) {}</script><div>cut <b>off</b></div></body></html>"
    assert dom.parse_fragment("<td>cell</td>").tag == "td"
    assert dom.parse_fragment('<a href="/x" class="link">t</a>').attrs == {"href": "/x", "class": "link"}
    assert dom.parse_fragment("just text").text() == "just text"


def test_elements(spark):
    pages = spark.createDataFrame([(1, "<ul><li class='a'>x</li><li>y</li><li data-q=1 data-r=2 data-s=3>z</li></ul>"), (2, None), (3, "")], "page_id long, html string")
    e = dom.elements(pages, with_html=True)
    assert {r.page_id for r in e.collect()} == {1, 3}
    li = dom.siblings(dom.parent(e)).filter("tag = 'li'").orderBy("node_id").collect()
    assert [r.p_tag for r in li] == ["ul"] * 3 and li[0].next_sibling == li[1].node_id and li[2].next_sibling is None
    assert dom.find_by_text(e, "y", "li", exact=True).count() == 1
    pairs = {(r.node_id, r.similar) for r in dom.find_similar(e).collect()}
    a, b, c = (r.node_id for r in li)
    assert pairs == {(b, a), (a, b), (a, c), (c, a)}
    assert dom.ancestors(e).filter(F.col("node_id") == a).orderBy("distance").count() == 3
    assert [r[0] for r in e.filter("tag = 'li'").orderBy("node_id").select(dom.generate_selector(F.col("attrs"))).collect()] == ["div.a", "div", 'div[data-q="1"]']


def test_ancestors_of_deep_elements(spark):
    rows = [(p, i, i - 1 if i else None, i) for p, n in ((1, 300), (2, 3)) for i in range(n)]
    e = spark.createDataFrame(rows, "page_id long, node_id int, parent_id int, depth int")
    got = sorted(tuple(r) for r in dom.ancestors(e).collect())
    assert got == sorted((p, i, i - d, d) for p, i, _, _ in rows for d in range(1, i + 1))


def test_follow(spark):
    html = '<a href="/1">one</a><a>no</a><a href="">x</a><a href="/2"> </a><a href="mailto:q">m</a><a href="https://o.org/É">o</a><a href="3#f">three</a>'
    pages = spark.createDataFrame([("https://e.com/d/", html)], "url string, html string")
    got = [(r.idx, r.target) for r in frontier.links(pages, ("b a", "a")).orderBy("idx").collect()]
    assert got == [(0, "https://e.com/1"), (5, "https://o.org/É"), (6, "https://e.com/d/3#f")]
    assert frontier.links(pages, ("a",), limit=1).count() == 1
    assert frontier.links(pages, ("a",), keep=lambda t: t.contains("o.org")).count() == 1
    f = pages.select(frontier.follow(F.col("url"), F.lit("x"), F.lit(1)).alias("f")).first().f
    assert (f.url, f.depth, f.priority) == ("https://e.com/d/x", 2, -2)


def test_frontier(spark):
    rows = spark.createDataFrame([("a", 1, 0), ("b", 2, 5), ("a", 3, 9), ("c", 4, 5), (None, 5, 0)], "url string, seq long, priority int")
    assert {(r.url, r.seq) for r in frontier.push(rows).collect()} == {("a", 1), ("b", 2), ("c", 4), (None, 5)}
    seen = spark.createDataFrame([("a",)], "url string")
    assert {r.url for r in frontier.push(rows, seen).collect()} == {"b", "c", None}
    assert [r.seq for r in frontier.pop(rows, 3).collect()] == [3, 2, 4]
    assert frontier.push_fingerprints(rows.dropna()).count() == 3
    merged = frontier.merge_checkpoint(rows.dropna().filter("seq > 1"), rows.filter("seq = 1"))
    assert {(r.url, r.seq) for r in merged.collect()} == {("a", 3), ("b", 2), ("c", 4)}
    hosts = spark.createDataFrame([("x.E.com",), ("e.com",), ("ae.com",), ("",), (None,)], "h string")
    assert [r.h for r in frontier.in_domains(hosts, ["e.com"], F.col("h")).collect()] == ["x.E.com", "e.com"]
    table = spark.createDataFrame([("e.com",)], "domain string")
    assert {r.h for r in frontier.in_domains(hosts, table, F.col("h"), keep=False).collect()} == {"ae.com", "", None}
    ads = spark.createDataFrame([("https://x.doubleclick.net/a",), ("https://e.com",), ("bad",)], "url string")
    assert frontier.blocked_hosts(ads, F.col("url")).count() == 1


def test_modes_and_router(spark):
    r = spark.createDataFrame([("auto", 0, ".*", "Http"), ("user", 0, "^/a", "Dynamic")], "kind string, rule_order int, pattern string, mode string")
    u = spark.createDataFrame([("https://e.com/a/1",), ("https://e.com/b",)], "url string")
    assert [x.mode for x in rules.resolve_modes(u, r).collect()] == ["Dynamic", "Http"]
    assert [x.mode for x in rules.resolve_modes(u, r.limit(0)).collect()] == [None, None]


@pytest.mark.parametrize("n", [0, 3, 100])
def test_stop(spark, n):
    rows = [("s", i, "page", "c", i * 10) for i in range(6)]
    e = spark.createDataFrame(rows, "spider string, seq long, event_type string, callback string, ts_ms long")
    assert stats.dispatched(e, stats.max_pages(n)).count() == min(n, 6)
    assert stats.dispatched(e, stats.timeout(25) | stats.never()).count() == 3


def test_store(spark, tmp_path):
    kv = store.KeyValue(spark, f"file://{tmp_path}/kv")
    assert kv.get(0).count() == 0
    kv.set(spark.createDataFrame([("n", "a", b"1", 10), ("n", "b", b"2", None)], "namespace string, key string, value binary, ttl_secs long"), now=100, version=1)
    kv.set(spark.createDataFrame([("n", "a", b"3")], "namespace string, key string, value binary"), now=105, version=2)
    assert {(r.key, bytes(r.value)) for r in kv.get(200, "n").collect()} == {("a", b"3"), ("b", b"2")}
    kv.delete(spark.createDataFrame([("n", "a"), ("n", "zz")], "namespace string, key string"), version=3)
    assert [r.key for r in kv.get(200, "n").collect()] == ["b"]
    c = store.Checkpoint(spark, f"file://{tmp_path}/cp")
    assert c.read() is None
    c.write(1, pending=spark.range(3), seen=spark.range(5))
    assert c.read()["seen"].count() == 5
    c.delete()
    assert c.read() is None


def test_cache_with_several_entries_of_an_url(spark, tmp_path):
    """Each request is answered once or left, by the latest entry; and the query's pages have entries of their own where urls repeat."""
    asked = spark.createDataFrame([("GET", u, i) for i, u in enumerate("aabcd")], "method string, url string, n int")
    entries = [("a", 5, None, "old"), ("a", 9, None, "new"), ("b", 1, None, "old"), ("b", 2, 3, "gone"), ("c", 4, None, "for ever"), ("c", 4, 1, "gone"), ("d", None, 5, "no time")]
    cache = spark.createDataFrame([("GET", *e) for e in entries], "method string, url string, cached_at long, ttl_secs long, body string")
    hit, miss = store.with_cache(asked, cache, now=10)
    assert sorted((x.n, x.body) for x in hit.collect()) == [(0, "new"), (1, "new"), (3, "for ever")]
    assert sorted(x.n for x in miss.collect()) == [2, 4]
    spark.range(120).select(F.col("id").alias("page_id"), F.format_string("https://a.example/%d", F.col("id") % 40).alias("url"), F.lit("").alias("html")).write.parquet(f"{tmp_path}/pages.parquet")
    got = {x.page_id: x.hit for x in Q.QUERIES["q_cache_hit_split"](spark, str(tmp_path)).collect()}
    assert got == {i: i % 3 == 0 and (i % 2 == 0 or i >= 50) for i in range(120)}


HEADINGS = ("a &amp", "b &quot;x", "c &am", "d &lt;&amp;amp;&gt;", "e &", "f", "g &#65;&eacute;", "h &l")


def _rows_and_sql(spark, tmp_path, name: str) -> tuple[list, list]:
    """Rows of a query and of its SQL over a page of each heading."""
    import duckdb

    from corpusmill.plans import operator_queries  # noqa: F401  adds its queries

    pages = [(i, f"https://a.example/{i}", f"<html><body><article><h1>{h}</h1><p>x</article></body></html>") for i, h in enumerate(HEADINGS)]
    spark.createDataFrame(pages, "page_id long, url string, html string").write.parquet(f"{tmp_path}/pages.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW pages AS SELECT * FROM '{tmp_path}/pages.parquet/*.parquet'")
    return sorted((x.page_id, x.heading) for x in Q.QUERIES[name](spark, str(tmp_path)).collect()), sorted(con.execute(f"SELECT page_id, heading FROM ({Q.ORACLE_SQL[name]})").fetchall())


def test_references_that_the_sql_does_not_know(spark, tmp_path):
    got, want = _rows_and_sql(spark, tmp_path, "q_response_parse")
    assert got == want and got[0] == (0, "a &amp") and got[3] == (3, "d <&amp;>")
    body = spark.range(1).select(F.encode(F.lit(f"<h1>{HEADINGS[0]}</h1><h1>{HEADINGS[1]}</h1>"), "UTF-8").alias("b"))
    read = body.select(dom.texts(dom.select_response(F.col("b"), F.lit(""), "h1")).alias("t")).first().t
    assert read == ["a &", 'b "x']  # the operator reads references as HTML does


def test_pages_go_to_python_in_batches_of_bytes_and_once(spark, tmp_path):
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    spark.conf.set(name, "64m")
    pages = spark.range(4000).coalesce(1).select(F.col("id").alias("page_id"), F.format_string("https://a.example/%d", "id").alias("url"), F.repeat(F.lit("<p>x"), 1000).alias("html"))
    pages.write.parquet(f"{tmp_path}/pages.parquet")

    @F.pandas_udf("int")
    def rows(html):
        return html.map(lambda _: len(html))

    assert Q._t(spark, str(tmp_path), "pages").select(rows("html").alias("n")).agg(F.max("n")).first()[0] < 1500
    assert spark.conf.get(name) == f"{4 << 20}b"
    spark.conf.set(name, "1m")
    Q._t(spark, str(tmp_path), "pages")
    assert spark.conf.get(name) == "1m"  # the session's own, smaller one
    spark.conf.unset(name)
    items, _ = S.Spider("s").on("default", S.content_handler(("p",))).run(pages.withColumns({"callback": F.lit(None).cast("string"), "meta": F.lit("{}")}))
    assert items._jdf.queryExecution().optimizedPlan().toString().count("ArrowEvalPython") == 1


def test_headings_of_a_crawl_as_they_are_written(spark, tmp_path):
    got, want = _rows_and_sql(spark, tmp_path, "q_crawl_site")
    assert got == want and len(got) > 4 and {h for _, h in got} <= set(HEADINGS)


def test_sinks(spark, tmp_path):
    items = S.as_items(spark.createDataFrame([('{"html":"<h1>T</h1>"}', "https://e.com/a"), ('{"text":"t\\n"}', "https://e.com/b"), (None, "x")], "value string, source_url string"), "s")
    out = sinks.ItemOutput(f"file://{tmp_path}/j", "json")
    with pytest.raises(RuntimeError):
        out.write(items)
    out.open().open().write(items)
    out.close()
    import glob
    import json

    text = "".join(open(f).read() for f in sorted(glob.glob(f"{tmp_path}/j/part=*/part-*")))
    assert len(json.loads(text)) == 2
    sinks.write_jsonl(items, f"file://{tmp_path}/l")
    assert {r.callback for r in spark.read.json(f"file://{tmp_path}/l", schema="callback string, id string").collect()} == {None}
    assert sorted(r.markdown for r in sinks.markdown_blocks(items).collect()) == ["# T\n\n---\n\n", "t\n\n"]
    assert sinks.write_markdown_pages(items, f"file://{tmp_path}/m").collect()[0].name == "e.com_a.md"
    sinks.write_warc(items, f"file://{tmp_path}/w", "2024-01-01T00:00:00Z")
    data = b"".join(open(f, "rb").read() for f in glob.glob(f"{tmp_path}/w/part-*"))
    assert data.startswith(b"WARC/1.1\r\n") and data.endswith(b"<h1>T</h1>\r\n\r\n")


def test_stream_equals_batch(spark, tmp_path):
    e = spark.createDataFrame([(i, f"2024-01-0{1 + i % 3} 00:00:00", "view" if i % 2 else "click", float(i)) for i in range(30)], "event_id long, ts string, event_type string, value double").withColumn("ts", F.col("ts").cast("timestamp_ntz"))
    e.repartition(3).write.parquet(f"{tmp_path}/e")
    got = []
    stream = E.tumbling(E.timed(E.event_source(spark, f"{tmp_path}/e", e.schema)), "1 day", "event_type")
    E.run_available(stream, f"{tmp_path}/c", lambda df, _: got.append({(str(r.win_start), r.event_type): r.n for r in df.collect()}), mode="complete")
    assert got[-1] == {(str(r.win_start), r.event_type): r.n for r in E.tumbling(E.timed(e), "1 day", "event_type").collect()}
    firsts = []
    E.run_available(E.first_seen(E.timed(E.event_source(spark, f"{tmp_path}/e", e.schema), delay="100 days"), ["event_type"]), f"{tmp_path}/d", lambda df, _: firsts.extend(df.collect()))
    assert len(firsts) == 2


def site_of(spark, details: int = 10, chapters: int = 30):
    """A three-level site: a home page, detail pages, and their chapter pages of 8 KB."""
    base = "https://site.example"
    n = spark.range(details).withColumnRenamed("id", "b")
    home = spark.range(1).select(F.lit(f"{base}/").alias("url"), F.concat(F.lit("<ul>"), F.array_join(F.transform(F.sequence(F.lit(0), F.lit(details - 1)), lambda i: F.format_string('<li><a class="book" href="/book/%d">b%d</a></li>', i, i)), ""), F.lit("</ul>")).alias("html"))
    detail = n.select(F.format_string(f"{base}/book/%d", "b").alias("url"), F.concat(F.lit("<ol>"), F.array_join(F.transform(F.sequence(F.lit(0), F.lit(chapters - 1)), lambda i: F.format_string('<li><a href="/book/%d/%d">c</a></li>', F.col("b"), i)), ""), F.lit("</ol>")).alias("html"))
    chapter = n.select("b", F.explode(F.sequence(F.lit(0), F.lit(chapters - 1))).alias("c")).select(F.format_string(f"{base}/book/%d/%d", "b", "c").alias("url"), F.concat(F.lit('<div class="text">'), F.repeat(F.lit("lorem "), 1300), F.lit("</div>")).alias("html"))
    return home.union(detail).union(chapter)


def test_site(spark):
    site = site_of(spark, 2, 3)
    got = S.crawl_site(site, ["https://site.example/"], "div.text", follow="/book/", options=S.Options(max_depth=2))
    assert got.count() == 6
    assert S.crawl_site(site, ["https://site.example/"], "div.text", options=S.Options(max_depth=1)).count() == 0
    with pytest.raises(ValueError):
        S.crawl_site(site, ["http://127.0.0.1/"], "p")


def test_site_with_a_long_chain(spark):
    rows = [(f"https://site.example/{i}", f'<p>{i}</p><a href="/{i + 1}">next</a><a href="/0">first</a>') for i in range(20)]
    site = spark.createDataFrame(rows, "url string, html string")
    got = S.crawl_site(site, ["https://site.example/0"], "p", options=S.Options(max_pages=1000))
    assert sorted(r.source_url for r in got.collect()) == sorted(u for u, _ in rows)
    got = S.crawl_site(site, ["https://site.example/0"], "p", options=S.Options(max_pages=3))
    assert sorted(r.source_url for r in got.collect()) == [u for u, _ in rows[:3]]


def test_entry_without_llm(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_deep_trees(spark):
    deep = "<div>" * 5000 + "<b>x</b>"
    row = spark.createDataFrame([(1, deep)], "page_id long, html string")
    assert dom.to_markdown(dom.parse(deep)) == "**x**"
    assert row.select(F.size(dom.select_all(F.col("html"), "b"))).first()[0] == 1
    e = dom.elements(row, with_text=False, with_navigation=True)
    assert e.count() == 5004 and e.agg(F.max("depth")).first()[0] == 5002
    item = S.crawl_site(row.select(F.lit("https://e.com/").alias("url"), "html"), ["https://e.com/"], "body > div").first()
    assert item.value.count("</div>") == 5000 - 1


def test_navigation_of_the_parser_equals_the_joins(spark):
    html = "<ul><li>a<li>b<b>c</b><li>d</ul><p>x</p>"
    pages = spark.createDataFrame([(i, html * i) for i in range(3)], "page_id long, html string")
    names = ["page_id", "node_id", "next_sibling", "prev_sibling", "first_child", "last_child"]
    own = dom.elements(pages, with_navigation=True)
    joined = dom.siblings(dom.elements(pages))
    assert sorted(map(str, own.select(names).collect())) == sorted(map(str, joined.select(names).collect()))


def test_damaged_checkpoint(spark, tmp_path):
    c = store.Checkpoint(spark, f"file://{tmp_path}/cp")
    c.write(1, seen=spark.range(3))
    c.write(2, seen=spark.range(5))
    for f in (tmp_path / "cp/v000000002/seen").glob("*.parquet"):
        f.write_bytes(b"damaged")
        (f.parent / f".{f.name}.crc").unlink(missing_ok=True)
    with pytest.warns(UserWarning):
        assert c.read()["seen"].count() == 3


def test_batches_and_clashing_names(spark, tmp_path):
    items = S.as_items(spark.createDataFrame([('{"html":"<p>1"}', "https://e.com/a"), ('{"html":"<p>2"}', "https://e.com/a"), ('{"html":"<p>3"}', "https://e.com/a?b")], "value string, source_url string"), "s")
    assert sorted(r.name for r in sinks.write_markdown_pages(items, f"file://{tmp_path}/m").collect()) == ["e.com_a.md", "e.com_a_2.md", "e.com_a_3.md"]
    assert sorted(p.read_text() for p in (tmp_path / "m").iterdir() if p.suffix == ".md") == ["1", "2", "3"]
    path = str(tmp_path / "batches")

    def flush(rows):
        with open(path, "a") as f:
            f.write(f"{len(rows)}\n")

    sinks.write_batches(items.coalesce(1), 2, flush)
    assert open(path).read() == "2\n1\n"


def test_limits_of_repeated_pages(spark):
    html = "".join(f'<a href="/{i}">x</a>' for i in range(3))
    pages = spark.createDataFrame([("https://e.com/", html)] * 2, "url string, html string")
    assert frontier.links(pages, limit=2).count() == 4


def test_command_line(spark, tmp_path, capsys):
    from corpusmill.__main__ import main

    spark.createDataFrame([("https://e.com/", "<h1>T</h1><p>x</p>")], "url string, html string").write.parquet(f"{tmp_path}/p")
    assert main(["dump", f"{tmp_path}/p", "https://e.com/", "--markdown"], spark) == 0
    assert capsys.readouterr().out == "# T\n\nx\n"
    assert main(["dump", f"{tmp_path}/p", "https://no.com/"], spark) == 1
    assert main(["scrape", f"{tmp_path}/p", "p", f"{tmp_path}/out"], spark) == 0
    assert '"text":"x"' in spark.read.text(f"{tmp_path}/out").first().value


def test_broken_import_of_a_subpackage_is_an_error(tmp_path):
    import shutil
    import subprocess
    import sys

    root = tmp_path / "copy"
    shutil.copytree(Q.__file__.rsplit("/corpusmill/", 1)[0], root, ignore=shutil.ignore_patterns(".git", "tests", "*.md", "*.json"))
    run = lambda: subprocess.run([sys.executable, "-c", "import __spark_entry__ as e; print(len(e.queries()))"], cwd=root, env={"PATH": "/usr/bin:/bin"}, capture_output=True, text=True)
    if (root / "corpusmill/llm/queries.py").exists():
        (root / "corpusmill/llm/packing.py").write_text("import nothing_of_this_name\n")
        assert "nothing_of_this_name" in run().stderr
        shutil.rmtree(root / "corpusmill/llm")
    (root / "corpus_pipeline.py").unlink(missing_ok=True)
    assert run().stdout.strip() == str(len(Q.QUERIES)), run().stderr
