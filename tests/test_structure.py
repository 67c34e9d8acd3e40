"""Structural operators against the trees, running counts against windows, crawls against a queue, and keyed state against the events in order."""

import random

import pytest
from pyspark.sql import Window, functions as F

from corpusmill.operators import control, dom, frontier, queues, rules, scan, stats, structure
from corpusmill.operators.html_tree import parse
from corpusmill.operators.selectors import Matcher
from corpusmill.plans import spider as S
from corpusmill.streaming import events as E, keyed
from tests.test_html import some_selector, some_tree


@pytest.fixture(scope="module")
def trees(spark):
    r = random.Random(21)
    pages = [(i, some_tree(r).outer_html()) for i in range(25)] + [(90, ""), (91, None)]
    df = spark.createDataFrame(pages, "page_id long, html string")
    e = dom.elements(df, with_text=False, with_positions=True).persist()
    return {i: parse(h) for i, h in pages if h is not None}, e


def test_intervals_and_positions(trees):
    roots, e = trees
    rows = {(r.page_id, r.node_id): r for r in e.collect()}
    for p, root in roots.items():
        for n in [root, *root.walk()]:
            r = rows.pop((p, n.id))
            brothers = n.parent.elements() if n.parent else [n]
            same = [c for c in brothers if c.tag == n.tag]
            assert r.last_id - r.node_id == sum(1 for _ in n.walk()) and r.siblings == len(brothers) and r.type_count == len(same) and same[r.type_idx] is n and r.is_empty == (not n.children)
    assert not rows


def test_contained_and_counts(trees):
    roots, e = trees
    div, p = e.filter("tag in ('div', 'ul')"), e.filter("tag in ('p', 'div')")
    want, counts = set(), {}
    for page, root in roots.items():
        for n in root.walk():
            if n.tag in ("div", "ul"):
                counts[page, n.id] = 0
        for n in root.walk():
            around = [a for a in n.ancestors() if a.tag in ("div", "ul")]
            if n.tag in ("p", "div"):
                want |= {(page, a.id, n.id, k) for k, a in enumerate(around, 1)}
                for a in around:
                    counts[page, a.id] += 1
    assert {tuple(r) for r in structure.contained(div, p).collect()} == want
    assert {tuple(r) for r in structure.contained(div, p, nearest=True).collect()} == {x for x in want if x[3] == 1}
    assert {(r.page_id, r.node_id): r.inside for r in structure.count_inside(div, p).collect()} == counts
    again = structure.intervals(e.drop("last_id")).select("page_id", "node_id", "last_id").collect()
    assert {tuple(r) for r in again} == {(r.page_id, r.node_id, r.last_id) for r in e.collect()}
    up = {(p, n.id, a.id, k) for p, root in roots.items() for n in root.walk() for k, a in enumerate(n.ancestors(), 1)}
    assert {tuple(r) for r in dom.ancestors(e).collect()} == up
    assert structure.contained(div.limit(0), p).count() == structure.contained(div, p.limit(0)).count() == 0


def test_selectors_as_plans_equal_those_in_the_tree(trees):
    roots, e = trees
    r, css = random.Random(5), {}
    while len(css) < 14:
        c = some_selector(r)
        if "has" not in c:
            css[f"c{len(css)}"] = c
    css |= {"h0": "div:has(p)", "h1": "ul:has(> li)", "h2": "li:has(+ li), p:has(~ *)", "bad": "p[", "h3": "*:not(:has(.x))"}
    for names in (list(css)[:7], list(css)[7:14], list(css)[14:]):
        got = structure.select_rows(e, {n: css[n] for n in names}).select("page_id", "node_id", *names).collect()
        for p, root in roots.items():
            for name, found in zip(names, Matcher(root).select([css[n] for n in names]), strict=True):
                assert {x.node_id for x in got if x.page_id == p and x[name]} == {n.id for n in found}, css[name]
    with pytest.raises(ValueError):
        structure.select_rows(e, {"x": "p:has(a b)"})


def test_similar_siblings(spark):
    r = random.Random(3)
    html = "<ul>" + "".join(f"<li{r.choice(['', ' class=a', ' class="a b"', ' class="a b c" id=q', ' x y z w'])}>" for _ in range(40)) + "</ul><div></div>"
    e = dom.elements(spark.createDataFrame([(1, html)], "page_id long, html string"), with_text=False)
    kinds = [(x.node_id, x.parent_id, x.tag, len((x.attrs.get("class") or "").split()), len(x.attrs)) for x in e.collect() if x.parent_id is not None]
    want = {(a[0], b[0]) for a in kinds for b in kinds if a[0] != b[0] and a[1:3] == b[1:3] and abs(a[3] - b[3]) <= 1 and abs(a[4] - b[4]) <= 2}
    assert {(x.node_id, x.similar) for x in dom.find_similar(e).collect()} == want
    some = e.filter("sibling_idx < 3")
    assert {(x.node_id, x.similar) for x in dom.find_similar(e, of=some).collect()} == {x for x in want if x[0] in {y.node_id for y in some.collect()}}
    assert {x.node_id: x.similar for x in dom.count_similar(e).collect()} == {a[0]: sum(x == a[0] for x, _ in want) for a in kinds}
    many = dom.elements(spark.createDataFrame([(1, "<ul>" + "<li class=x>a" * 100_000 + "</ul>")], "page_id long, html string"), with_text=False)
    assert dom.count_similar(many).filter("similar = 99999").count() == 100_000


def test_running_counts_equal_a_window(spark):
    rows = spark.range(3000).select(F.when(F.col("id") % 3 == 0, F.col("id") % 7).alias("k"), ((F.col("id") * 7919) % 3001).alias("o"), (F.col("id") % 11 - 5).alias("v"), F.lit("x").alias("_part_"))
    w = Window.partitionBy("k").orderBy("o").rowsBetween(Window.unboundedPreceding, -1)
    want = rows.withColumns({"s": F.coalesce(F.sum("v").over(w), F.lit(0)), "m": F.max("v").over(w)}).collect()
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    got = scan.running(rows, ["k"], ["o"], {"s": F.col("v")}, {"m": F.col("v")}).collect()
    hot = scan.written(rows.withColumn("k", F.lit(1)).repartitionByRange("k", "o").withColumn("p", F.spark_partition_id()), "t")
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert sorted(map(tuple, got), key=str) == sorted(map(tuple, want), key=str)
    sizes = [r["count"] for r in hot.groupBy("p").count().collect()]  # one key with all rows: no range holds it
    assert len(sizes) == 4 and max(sizes) < 1500
    assert scan.running(rows.limit(0), ["k"], ["o"], {"s": F.col("v")}).count() == 0


def test_stop_conditions_of_one_spider(spark):
    r = random.Random(2)
    rows = [("s", i, r.choice(["page", "item", "error"]), r.choice([None, "a", "b"]), 10 * i) for i in range(400)]
    df = spark.createDataFrame(rows, "spider string, seq long, event_type string, callback string, ts_ms long")
    for stop, holds in ((stats.max_pages(30) | stats.max_errors(25), lambda p, i, e, c, t: p >= 30 or e >= 25), (stats.max_pages_by_callback(20) & stats.max_items(5), lambda p, i, e, c, t: c >= 20 and i >= 5), (~stats.timeout(1000), lambda p, i, e, c, t: t < 1000)):
        n, by, want = {"page": 0, "item": 0, "error": 0}, {}, []
        for _, seq, kind, callback, ts in rows:
            if kind == "page" and not holds(n["page"], n["item"], n["error"], by.get(callback, 0), ts):
                want.append(seq)
            n[kind] += 1
            by[callback] = by.get(callback, 0) + (kind == "page")
        assert sorted(x.seq for x in stats.dispatched(df, stop).collect()) == want


def test_paced_requests(spark):
    r = random.Random(7)
    rows = [(r.choice(["a", "b", None]), i, r.choice([None, r.randint(0, 4000)])) for i in range(300)]
    df = spark.createDataFrame(rows, "k string, seq long, at long")
    for gap, burst in ((100, 1), (70, 4), (0, 2)):
        want = {}
        for key in ("a", "b", None):
            bucket = None
            for _, seq, at in sorted((x for x in rows if x[0] == key and x[2] is not None), key=lambda x: (x[2], x[1])):
                bucket = at if bucket is None else max(bucket, at)
                want[seq] = max(at, bucket - (burst - 1) * gap)
                bucket += gap
        got = {x.seq: x.starts for x in scan.paced(df, ["k"], ["at", "seq"], "at", gap, burst).collect()}
        assert got == {seq: want.get(seq) for _, seq, _ in rows}
    urls = spark.createDataFrame([("https://a.example/1", 0, 5), ("https://a.example/2", 1, 5), ("https://b.example/", 2, 9)], "url string, seq long, arrives_ms long")
    assert [x.not_before_ms for x in S.throttled(urls, 50).orderBy("seq").collect()] == [5, 55, 9]
    assert [x.not_before_ms for x in S.delayed(urls, 50).orderBy("seq").collect()] == [0, 50, 0]


def queue(links, stored, start, most_depth):
    """url -> (callback, depth, place), by a queue of one crawler."""
    found, order = {}, []
    for u in start:
        if u not in found:
            found[u] = (None, 0)
            order.append(u)
    i = 0
    while i < len(order):
        u = order[i]
        i += 1
        callback, depth = found[u]
        if u not in stored or depth >= most_depth:
            continue
        for _, _, target, cb, only in sorted((x for x in links if x[0] == u), key=lambda x: x[1]):
            if (only is None or only == callback) and target not in found:
                found[target] = (cb, depth + 1)
                order.append(target)
    return {u: (*found[u], k) for k, u in enumerate(order)}


@pytest.mark.parametrize("limit", [100_000, 0])
def test_crawl_equals_a_queue(spark, limit, monkeypatch):
    r = random.Random(13)
    names = [f"u{i}" for i in range(60)]
    links = list({(s, k): (s, k, r.choice(names), r.choice(["a", "b"]), r.choice(["", "", "a"])) for s in names[:45] for k in range(r.randint(0, 4))}.values())
    links = [(*x[:4], x[4] or None) for x in links]
    stored = names[:50]
    df = spark.createDataFrame(links, "source string, place long, url string, callback string, only_for string")
    table = frontier.LinkTable(df, spark.createDataFrame([(u,) for u in stored], "url string"), buckets=5)
    start = spark.createDataFrame([(u, i) for i, u in enumerate(["u3", "u9", "u3"])], "url string, place long")
    key = lambda rows: {x.url: (x.callback, x.depth, x.place) for x in rows}
    monkeypatch.setattr(frontier, "_FEW", limit)  # all numbering in one window, or none
    got = frontier.crawl(table, start).collect()
    assert key(got) == queue_of(links, stored, 99) and all(x.stored == (x.url in stored) for x in got)
    state = frontier.new_path(spark, "crawl-test")
    assert key(frontier.crawl(table, start, state, rounds=1).collect()) == queue_of(links, stored, 1)
    assert key(frontier.crawl(table, start, state, rounds=1).collect()) == queue_of(links, stored, 2)
    spark.range(1).write.parquet(f"{state}/requests/round=3/_temporary/x")  # a round that was broken off
    assert key(frontier.crawl(table, start, state).collect()) == queue_of(links, stored, 99)
    assert frontier.crawl(table, start.limit(0)).count() == 0
    few = frontier.crawl(table, start, most=4)
    assert few.filter("stored").count() >= 4 and few.agg(F.max("round")).first()[0] < max(d for _, d, _ in queue_of(links, stored, 99).values())


def queue_of(links, stored, most_depth):
    return queue(links, stored, ["u3", "u9", "u3"], most_depth)


def run(spark, events, folder, at, out, ttl):
    first = keyed.first_of_key(E.event_source(spark, folder, events, 1).withWatermark("ts", "10 seconds"), ["k"], order=["ts_ms", "seq"], ttl_ms=ttl)
    first.writeStream.format("parquet").option("path", out).option("checkpointLocation", at).outputMode("append").trigger(availableNow=True).start().awaitTermination()


def test_state_expires_and_outlives_restarts(spark, tmp_path):
    keyed.use_rocks(spark)
    folder, at, out = (f"{tmp_path}/{x}" for x in ("events", "at", "out"))
    batches = [[("a", 0, 1), ("b", 2, 2), ("a", 5, 3), ("a", 31, 4), ("a", 30, 5)], [("b", 20, 6), ("c", 100, 7), (None, 101, 8)], [("a", 150, 9), ("d", 40, 10), ("c", 125, 11), (None, 130, 12)], [("c", 160, 13)]]
    schema = None
    for rows in batches:  # the stream ends and starts again between the batches
        df = spark.createDataFrame(rows, "k string, s long, seq long").select("k", "seq", F.timestamp_seconds(F.col("s") + 1000).alias("ts"), ((F.col("s") + 1000) * 1000).alias("ts_ms"))
        df.coalesce(1).write.mode("append").parquet(folder)
        schema = df.schema
        run(spark, schema, folder, at, out, 30_000)
    got = sorted(r.seq for r in spark.read.parquet(out).collect())
    # times are from 1000 s; 31 is more than 30 s after 0, 30 is not; d at 40 is late, as the watermark is 91 by then; 125 is within 30 s of 100 and 130 of 101, 160 is not within 30 of 100
    assert got == [1, 2, 4, 7, 8, 9, 13]
    firsts = keyed.first_of_key(E.event_source(spark, folder, schema, 2), ["k"], order=["seq"])
    E.run_available(firsts, f"{tmp_path}/at2", lambda df, batch: df.write.mode("append").parquet(f"{tmp_path}/out2"))
    assert sorted(r.seq for r in spark.read.parquet(f"{tmp_path}/out2").collect()) == [1, 2, 7, 8, 10]


def test_required_literals():
    cases = {"^/en/": "/en/", r"/products/\d+": "/products/", r"\d+-lastupdate-\d+\.html": "-lastupdate-", "a|b": "", "(abc|def)ghi": "ghi", "abcd?ef": "abc", "abcd+ef": "abcd", "ab{0,2}cde": "cde", "ab{2}cde": "cde", r"[^]x]abc\.d": "abc.d", "(?i)abc": "", r"a\wbcd": "bcd", "": "", "x*yz": "yz", r"\\Qa": "", "abc$": "abc", "[a-z]+": "", r"v1\/b": "v1/b"}
    assert {p: rules.required_literal(p) for p in cases} == cases


def test_many_mode_rules_equal_the_first_that_fits(spark):
    import re

    r = random.Random(4)
    words = ["news", "shop", "item", "page", "de", "en", "archive", "v1"]
    urls = [f"https://{r.choice('abc')}.example/" + "/".join(r.choice([*words, str(r.randint(0, 99))]) for _ in range(r.randint(0, 4))) for _ in range(300)] + [None, "no url", "https://a.example"]
    shapes = [lambda: "/" + r.choice(words) + "/" + r.choice(words), lambda: rf"^/{r.choice(words)}/\d+$", lambda: r"/\d{2}" + r.choice("0123456789"), lambda: r.choice("abc") + r"\.example/" + r.choice(words), lambda: f"nothing{r.randint(0, 999)}", lambda: f"({r.choice(words)}|{r.choice(words)})/x?\\d", lambda: r"/[a-z]{" + str(r.randint(5, 9)) + "}$"]
    listed = [(r.choice(["user", "auto"]), i, r.choice(shapes)(), f"m{i}") for i in range(400)]
    requests = spark.createDataFrame([(u, i) for i, u in enumerate(urls)], "url string, n int")
    table = spark.createDataFrame(listed, "kind string, rule_order int, pattern string, mode string")
    ordered = sorted(listed, key=lambda x: (x[0] != "user", x[1]))

    def first(u):
        path = None if u is None else re.match(r"[a-z]+://[^/]*(.*)", u)
        path = u if not path else path[1] or "/"
        return None if u is None else next((m for _, _, p, m in ordered if re.search(p, path) or re.search(p, u)), None)

    want = {i: first(u) for i, u in enumerate(urls)}
    for few in (500, 3):
        assert {x.n: x.mode for x in rules.resolve_modes(requests, table, few=few).collect()} == want
    many = spark.range(100_000).select(F.lit("auto").alias("kind"), F.col("id").cast("int").alias("rule_order"), F.format_string("/book/%d/", "id").alias("pattern"), F.format_string("m%d", "id").alias("mode"))
    asked = spark.createDataFrame([(f"https://a.example/book/{i}/x", i) for i in range(0, 100_000, 997)], "url string, n int")
    assert all(x.mode == f"m{x.n}" for x in rules.resolve_modes(asked, many).collect())


def test_rules_of_one_pattern_are_met_once(spark, monkeypatch):
    """Of many rules with equal patterns the first counts, and only it is held against urls: a table of rules is left with a row for each pattern."""
    kept = []
    monkeypatch.setattr(rules, "written", lambda df, name: kept.append((name, df.count())) or df)
    table = spark.range(3000).select(F.when(F.col("id") % 1000 == 999, "user").otherwise("auto").alias("kind"), F.col("id").cast("int").alias("rule_order"), F.format_string("^/part/%d", F.col("id") % 6).alias("pattern"), F.format_string("m%d", "id").alias("mode"))
    table = table.union(spark.createDataFrame([("user", 0, None, "none")], "kind string, rule_order int, pattern string, mode string"))
    asked = spark.createDataFrame([(f"https://a.example/part/{i}/x", i) for i in range(8)], "url string, n int")
    got = {x.n: x.mode for x in rules.resolve_modes(asked, table, few=3).collect()}
    assert got == {0: "m0", 1: "m1999", 2: "m2", 3: "m999", 4: "m4", 5: "m2999", 6: None, 7: None}
    assert dict(kept)["mode-rules"] == 6


def test_priority_frontier_equals_a_sort(spark):
    r, waiting, seq = random.Random(6), [], 0
    f = queues.PriorityFrontier(spark, frontier.new_path(spark, "priority"))
    assert f.pop(3) is None and len(f) == 0
    for step in range(4):
        rows = [(f"u{step}-{i}", r.choice([-3, -1, 0, 0, 5, None]), i) for i in range(12)]
        f.push(spark.createDataFrame(rows, "url string, priority int, seq long"))
        for u, p, _ in rows:
            waiting.append((-(p or 0), seq, u))
            seq += 1
        k = r.randint(1, 9)
        want, waiting = sorted(waiting)[:k], sorted(waiting)[k:]
        got = f.pop(k)
        assert [x.url for x in got.orderBy(F.desc("priority"), "seq").collect()] == [u for _, _, u in want]
        again = queues.PriorityFrontier(spark, f.path)  # what is on disk is all there is
        assert sorted((-x.priority, x.url) for x in again.pending().collect()) == sorted((p, u) for p, _, u in waiting)
        if step == 1:
            f.compact()
    top = f.plan(1)
    assert top == [-min(waiting)[0]] and all(f"of_={top[0]}/" in x for x in f._read(top, f._counts()).inputFiles())
    f.push(spark.createDataFrame([], "url string, priority int, seq long"))
    assert len(f) == len(waiting)


def test_seen_set_is_exact_and_joins_little(spark):
    s = queues.SeenSet(spark, frontier.new_path(spark, "seen"), expected=20_000, urls_per_bucket=2000)
    url = lambda a, b: spark.range(a, b).select(F.format_string("https://e.com/%d", "id").alias("url"), "id")
    assert s.new_of(url(0, 10)).count() == 10
    s.add(url(0, 8000))
    s.add(url(7000, 12_000))
    asked = url(10_000, 30_000).union(url(29_999, 30_000)).union(spark.createDataFrame([(None, 1)], "url string, id long"))
    assert s.maybe(url(0, 12_000)).filter("maybe").count() == 12_000  # none is missed
    wrong = s.maybe(url(12_000, 30_000)).filter("maybe").count()
    assert wrong < 0.02 * 18_000, wrong
    got = s.new_of(asked).collect()
    assert sorted((x.id, x.url is None) for x in got) == sorted([(i, False) for i in range(12_000, 30_000)] + [(29_999, False), (1, True)])
    assert queues.SeenSet(spark, s.path, expected=20_000, urls_per_bucket=2000).urls().distinct().count() == 12_000


def test_control_states(spark):
    r = spark.createDataFrame([("a", 1), ("b", 2), ("c", 3), ("d", 4), (None, 5)], "url string, seq int")

    def split(rows):
        going, waiting = control.control_filter(r, spark.createDataFrame(rows, "url string, state string"))
        return sorted(x.seq for x in going.collect()), sorted(x.seq for x in waiting.collect())

    assert split([]) == ([1, 2, 3, 4, 5], [])
    assert split([("a", "cancelled"), ("b", "paused"), ("b", "cancelled"), ("c", "paused"), ("c", "paused")]) == ([4, 5], [3])
    assert split([(None, "paused"), ("a", "cancelled")]) == ([], [2, 3, 4, 5])
    assert split([(None, "cancelled")]) == split([("x", "shutdown")]) == split([(None, "shutdown"), ("a", "paused")]) == ([], [])
