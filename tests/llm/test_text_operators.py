import base64
import collections
import hashlib
import random
import re

import pyarrow as pa
from pyspark.sql import functions as F

from corpusmill.llm import html_text, quality, secrets, url_filter, warc
from tests.llm.common import WORD


def base_rules(t):
    t = t or ""
    w = WORD.findall(t)
    seen = collections.Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4))
    covered = {j for i in range(len(w) - 4) if seen[tuple(w[i : i + 5])] > 1 for j in range(i, i + 5)}
    lines = [x for x in t.split("\n") if WORD.search(x)]
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), len(covered), len(w) < 10 or 100 * len(covered) > 20 * len(w)


def quality_rows():
    r = random.Random(4)
    word = lambda: r.choice(["a", "b", "c", "d", "e", "#x", "ü&", "漢"]) + r.choice("xyz") * r.randint(0, 3)
    texts = [r.choice([" ", "\n", "\t"]).join(word() for _ in range(r.randint(0, 60))) for _ in range(150)]
    return [*texts, None, "", "\n \n", "a b c d e f g h i j k l m n " * 400, "a a a a a a a a a a a a"]


def test_base_rules(spark):
    rows = quality_rows()
    df = spark.createDataFrame([(i, t, "h", True) for i, t in enumerate(rows)], "doc_id long, text string, source string, kept boolean")
    got = {x.doc_id: x for x in quality.quality_rules(df).collect()}
    for i, t in enumerate(rows):
        x = got[i]
        assert (x.n_words, x.word_chars, x.n_symbols, x.n_dup_lines, x.n_repeat_words, x.base_failed) == base_rules(t), (t, x)
    assert quality.quality_rules(df.limit(0)).count() == 0


def test_frequent_lines(spark):
    r = random.Random(5)
    body = lambda: " ".join(str(r.random()) for _ in range(30))
    footer = "All rights reserved by us 2024"
    rows = [(i, f"{body()}\n {footer.upper() if i % 2 else footer}\t", "h") for i in range(30)]
    rows += [(100 + i, f"{footer}\nmore of it\n" + " ".join("abcdefghijkl"), "other") for i in range(3)]  # rare on its host
    copy = "\n".join(body() for _ in range(4))
    rows += [(200 + i, copy, "h") for i in range(40)]  # copies of one clean document
    near = [body() for _ in range(6)]
    rows += [(300 + i, "\n".join([*near, body()]), "h") for i in range(10)]  # as many near copies as a line may have
    rows += [(400 + i, f"{footer}\n" + "tiny", "h") for i in range(20)]  # fail for being short
    rows += [(500 + i, "\n".join([footer] * 12 + [f"own words of number x{body()[:40]}"]), None) for i in range(20)]  # depleted, and repeats
    rows += [(600, f"{body()}\n{footer}", "h")] * 2
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    df = df.withColumns({c: F.lit("x") for c in ("host", "hot", "h", "k_id", "kept", "n")})
    got = quality.quality_rules(df, max_docs=10, max_share=0.01).collect()
    assert {r.host for r in got} == {r.hot for r in got} == {"x"}
    assert len(got) == len(rows)
    x = {r.doc_id: r for r in got}
    assert all(x[i].kept and x[i].n_removed_lines == 1 and "rights" not in x[i].clean_text.lower() for i in range(30))
    assert all(x[100 + i].n_removed_lines == 0 for i in range(3))
    assert all(x[200 + i].kept and x[200 + i].clean_text == copy for i in range(40))
    assert all(x[300 + i].kept and x[300 + i].n_removed_lines == 0 for i in range(10))
    assert not any(x[500 + i].kept for i in range(20))
    assert x[600].kept and x[600].n_removed_lines == 1


def test_frequent_lines_equal_a_count_of_documents(spark):
    r = random.Random(6)
    shared = [f"shared line number {i:02d} of all" for i in range(12)]
    own = lambda: f"own {r.random():.18f} of it"
    rows = [("eight", r.sample(shared[:8], 5)) for _ in range(300)]  # nothing else: depleted
    rows += [("ten", [*shared[:10], *[own() for _ in range(5)]]) for _ in range(30)]
    rows += [("mixed", [*r.sample(shared, r.randint(0, 8)), own(), own()]) for _ in range(60)]
    rows += [("few", [*shared[:3], own(), own()]) for _ in range(10)]
    same = [*shared[2:6], own(), own()]
    rows += [("copies", r.sample(same, 6)) for _ in range(25)] + [("copies", [shared[2], own(), own()]) for _ in range(9)]  # 10 with that line
    rows += [("rare", [*shared[:2], own(), own()]) for _ in range(11)] + [("rare", [own(), own()]) for _ in range(100)]  # 11 of 111
    rows += [("shell", [*shared[:10], f"t{i}"]) for i in range(300)]  # boilerplate around one short line
    rows += [("shells", [*shared[:10], f"t{i}", f"u{i}"]) for i in range(50)]
    docs, total = collections.defaultdict(set), collections.defaultdict(set)
    for host, ls in rows:
        total[host].add(frozenset(ls))
        for x in ls:
            docs[host, x].add(frozenset(ls))
    gone = {k for k, v in docs.items() if len(v) > 10 and len(v) > 0.1 * len(total[k[0]])}
    assert {h for h, _ in gone} == {"eight", "ten", "mixed", "shell", "shells"}
    df = spark.createDataFrame([(i, "\n".join(ls), h) for i, (h, ls) in enumerate(rows)], "doc_id long, text string, source string")
    got = {x.doc_id: x for x in quality.quality_rules(df, max_docs=10, max_share=0.1).collect()}
    for i, (h, ls) in enumerate(rows):
        assert got[i].clean_text.split("\n") == ([x for x in ls if (h, x) not in gone] or [""]), (h, ls, got[i])
    assert not any(got[i].kept for i, (h, _) in enumerate(rows) if h in ("eight", "shell", "shells"))


def test_headers_and_footers_that_occur_together(spark):
    r = random.Random(9)
    own = lambda: " ".join(str(r.random()) for _ in range(15))
    rows = [(i, f"The header of all pages\n{own()}\nAll rights reserved by the footer", "h", "in") for i in range(1000)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, Kept string").withColumns({c: F.lit("x") for c in ("_cm_hot", "Clean_Text", "HOST")})
    for most in (2_000_000, 0):  # by broadcast, and by a join
        got = quality.quality_rules(df, broadcast_lines=most)
        assert len(got.columns) == len({c.lower() for c in got.columns})
        found = got.agg(F.sum("n_removed_lines"), F.count_if("kept"), F.min("HOST"), F.min("_cm_hot")).first()
        assert tuple(found) == (2000, 1000, "x", "x")


def brute_secrets(t):
    out = [(m.start(), k, m.end()) for k, r in enumerate(secrets.RULES) for m in re.finditer(r.pattern, t or "") if m.end(r.group) - m.start(r.group) >= r.least]
    return [(a, secrets.RULES[k].kind, b) for a, k, b in sorted(out)]


SECRET_PARTS = ["password", "PassWD", "api_key", "apikey", "secret", "token", "=", ":", " ", '"', "'", "AKIA", "ABCD1234", "deadbeef", "0123456789abcdef", "é", "ſecret", "toKen", "漢", "\n", "eyJabc.eyJdef.", "ghp_", "x" * 30, "-----BEGIN RSA PRIVATE KEY-----", "sk_live_", "A" * 40, "xoxb-", "AIza"]


def test_secrets_equal_a_full_scan():
    r = random.Random(3)
    rows = ["".join(r.choice(SECRET_PARTS) for _ in range(r.randint(0, 20))) for _ in range(3000)] + [""]
    assert secrets.find(pa.array(rows)) == [brute_secrets(t) for t in rows]
    assert secrets.find(pa.array([], pa.string())) == []


def test_trigram_queries():
    assert secrets.trigram_query("abcd") == ("and", ("abc", "bcd"))
    assert secrets.trigram_query("[0-9]+") is None
    assert secrets.trigram_query("(foo|ba)x*") is None  # ba says nothing
    assert secrets.trigram_query("(foo|bar)") == ("or", ("bar", "foo"))
    assert secrets.trigram_query("a?bcd") is not None


def test_groups_of_many_strings_are_verified():
    rule = secrets.Rule("k", "x([abc][abc][abc])y", 1)
    assert secrets.trigram_query(rule.pattern) is None
    assert secrets.find(pa.array(["xabcy", "xby", "no"]), (rule,)) == [[(0, "k", 5)], [], []]
    assert secrets.find(pa.array(["preabcendpost"]), (secrets.Rule("k", "pre([abc][abc][abc]end)post", 1),)) == [[(0, "k", 13)]]


def test_scan_and_redact(spark):
    df = spark.createDataFrame([(1, "é password=abcdef12 end", 0), (2, None, 0), (3, "clean", 0)], "doc_id long, text string, start int")
    got = secrets.scan(df).orderBy("doc_id")
    assert [r[0] for r in got.select(secrets.span_list(F.col("spans"))).collect()] == ["assign:2:19", "", ""]
    assert [r.text for r in secrets.redact(got).collect()] == ["é [secret] end", None, "clean"]


PAGE = '<!DOCTYPE html><body><header><a href=x>Site</a></header><nav><ul><li><a href=/>Home</a></ul></nav><div class="cookie-banner">We use cookies to do many things on this page</div><main><article><h1>T &amp; x</h1><p>One  two&nbsp;three<br>four<p>Five <b>six</b><script>var p="</p>";</script><div class="share">Share this with all your friends</div></article><section id="comments"><p>This comment of a reader is quite long, and it goes on and on</p></section></main><aside>side bar text</aside><form><label>Name</label></form><footer>&copy; us</footer>'


def test_main_text(spark):
    df = spark.createDataFrame([(1, PAGE, "old"), (2, None, ""), (3, "", ""), (4, "<article><p>cut off <a hre", ""), (5, "<p", "")], "page_id long, html string, text string")
    got = {r.page_id: r.text for r in html_text.extract(df).collect()}
    assert got == {1: "T & x\nOne two three four\nFive six", 2: "", 3: "", 4: "cut off", 5: ""}


def test_unclosed_hidden_elements():
    shown = lambda html: [b.text for b in html_text.blocks(html)]
    for tag in sorted(html_text._HIDDEN - html_text._RAW - {'annotation', 'metadata'}):
        assert shown(f"<p>a</p><{tag}>x</{tag}><p>b</p><{tag} class=c><p>c</p><{tag}><p>d") == ["a", "b", "c", "d"], tag
    for tag in html_text._RAW:
        assert shown(f"<p>a</p><{tag}>x</{tag}><p>b</p><{tag}><p>c</p>") == ["a", "b"], tag


def test_tree_on_pages_it_has_not_seen():
    x, y = html_text.labelled_blocks(150, seed=99)
    assert (html_text.trained().predict(x) == y).mean() > 0.98


def test_url_rules(spark):
    urls = {"https://a.com/x": ("com/", "allow"), "https://EXAMPLE.com/en/1": ("example.com/en/", "block"), "https://www.example.com/en/": ("www.example.com/en/", "allow"), "http://x.net/es/q?u": ("net/es/", "block"), "http://x.net/de/": (None, "allow"), "https://a.com": (None, "allow"), "nothing": (None, "allow"), None: (None, "allow"), "a://b://c/d": (None, "allow")}
    df = spark.createDataFrame([(i, u, "old") for i, u in enumerate(urls)], "page_id long, url string, verdict string")
    df = df.withColumns({c: F.lit("x") for c in ("rejected", "shape", "segs", "host", "n")})
    got = {r.page_id: (r.rule, r.verdict) for r in url_filter.judge(df).collect()}
    assert [got[i] for i in range(len(urls))] == list(urls.values())
    hosts = {r.page_id: (r.host, r.path) for r in url_filter.judge(df).collect()}
    assert hosts[1] == ("example.com", "/en/1") and hosts[5] == ("a.com", "") and hosts[6] == ("", "") and hosts[8] == ("b:", "//c/d")
    assert url_filter.judge(df.limit(0)).count() == 0


def test_templates_reject_by_purity(spark):
    block = (url_filter.UrlRule("bad.com", "/ads/1", "block"),)
    rows = [f"https://bad.com/ads/1{i}" for i in range(30)] + [f"https://bad.com/ads/2{i}" for i in range(30)] + [f"https://bad.com/news/{i}" for i in range(30)]
    df = spark.createDataFrame([(i, u) for i, u in enumerate(rows)], "page_id long, url string")
    got = {r.url: r.verdict for r in url_filter.judge(df, block).collect()}
    assert got["https://bad.com/ads/21"] == "block" and got["https://bad.com/news/3"] == "allow"  # no label says anything of it
    one_sided = [f"https://x.net/es/{i}" for i in range(40)] + ["https://x.net/", "https://x.net/about", "https://x.net"] + [f"https://x.net/de/news/{i}" for i in range(9)]
    found = url_filter.judge(spark.createDataFrame([(u,) for u in one_sided], "url string")).collect()
    assert {r.url for r in found if r.verdict == "allow"} == set(one_sided[40:]) and {r.verdict for r in found if r.rule} == {"block"}
    good = spark.createDataFrame([(f"https://bad.com/news/{i}", 0) for i in range(9)], "url string, bad int")
    got = {r.url: r.verdict for r in url_filter.judge(df, block, labels=good).collect()}
    assert got["https://bad.com/ads/21"] == "block" and got["https://bad.com/news/3"] == "allow"
    words = [f"https://h.org/tag/word{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(100)]
    counted = url_filter.judge(spark.createDataFrame([(u,) for u in words], "url string"), block, max_children=20).select("template").distinct().collect()
    assert [r.template for r in counted] == ["/tag/*"]


def brute_shares(rows, z=1.96, strength=2.0):
    """(host, template) -> share, for templates (tuples of segments) with labels 0, 1 or None."""
    nodes = collections.defaultdict(lambda: [0, 0])
    rows = [(host, (*t, "end"), bad) for host, t, bad in rows]
    for host, t, bad in rows:
        for k in range(len(t) + 1):
            if bad is not None:
                nodes[host, t[:k]][0] += bad
                nodes[host, t[:k]][1] += 1
    out = {}
    known = [bad for _, _, bad in rows if bad is not None]
    prior = min(0.5, (sum(known) + 1) / (len(known) + 2))
    for host, t, _ in rows:
        share = prior
        for k in range(len(t) + 1):
            bad, n = nodes[host, t[:k]]
            if k and n == 0:
                share = (share + prior) / 2
                continue
            if k and abs(bad / n - share) <= z * (share * (1 - share) / n) ** 0.5:
                continue
            share = (bad + strength * share) / (n + strength)
        out[host, t[:-1]] = share
    return out


def test_template_tree_equals_a_count(spark):
    r = random.Random(11)
    kinds = [(f"h{h}.org", ("", a, b, "*")) for h in range(4) for a in ("x", "y", "z") for b in ("p", "q")]
    purity = {k: r.choice([0.0, 0.05, 0.95, 1.0]) for k in kinds}
    rows = [(h, t, (int(r.random() < purity[h, t])) if r.random() < 0.5 and t[1] != "z" else None) for h, t in (r.choice(kinds) for _ in range(900))]
    urls = [(f"https://{h}" + "/".join(t).replace("*", str(1000 + i)), bad) for i, (h, t, bad) in enumerate(rows)]
    df = spark.createDataFrame([(u,) for u, _ in urls], "url string")
    labels = spark.createDataFrame([x for x in urls if x[1] is not None] + [("https://h0.org/x/p/5", None)], "url string, bad int")
    got = {(r.host, tuple(r.template.split("/"))): (r.bad_share, r.verdict) for r in url_filter.judge(df, (), labels=labels).collect()}
    want = brute_shares(rows)
    assert got.keys() == want.keys()
    assert all(abs(got[k][0] - want[k]) < 1e-9 and got[k][1] == ("block" if want[k] >= 0.9 else "allow") for k in want)
    held_out = [(got[h, t][1] == "block") == (purity[h, t] > 0.5) for h, t, bad in rows if bad is None and t[1] != "z"]
    assert sum(held_out) > 0.9 * len(held_out)


def test_odd_urls(spark):
    deep = "https://d.org" + "".join(f"/s{chr(97 + i % 26)}" for i in range(300))
    rows = [(1, deep + "/a"), (2, deep + "/b"), (3, None), (3, None), (4, ""), (5, "https://e.org/" + "x" * 100_000), (None, "https://d.org")]
    df = spark.createDataFrame(rows, "page_id long, url string").withColumns({c: F.lit("x") for c in ("Host", "VERDICT", "_cm_shape", "segs", "node")})
    got = url_filter.judge(df).collect()
    assert len(got) == len(rows) and len({r.template for r in got if r.page_id in (1, 2)}) == 2
    assert {(r["_cm_shape"], r.node) for r in got} == {("x", "x")} and len(df.columns) + 4 == len(got[0])
    many = spark.createDataFrame([(f"https://t.org/{a}/{b}w{c}",) for a in "ab" for b in "klmnopq" for c in "abcdefghijkl"], "url string")
    assert {r.template for r in url_filter.judge(many, (), max_children=20).select("template").distinct().collect()} == {"/a/*", "/b/*"}


def test_warc(spark):
    rows = [(1, "u", "a"), (2, "v\r\nx", "a"), (3, None, None), (4, "w", ""), (5, "é", "bé"), (6, "q", "long text"), (7, "q", "long text")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("file", F.lit("clash"))
    index = warc.write_archives(df, warc.archive_path(spark))
    got = {r.page_id: r for r in warc.read_records(index).collect()}
    for i, _, html in rows:
        data = (html or "").encode()
        assert got[i].payload_bytes == len(data) and got[i].payload_digest == base64.b32encode(hashlib.sha1(data).digest()).decode()
        last = max(j for j, _, h in rows if (h or "") == (html or ""))
        assert (got[i].record_type, got[i].refers_to) == (("response", None) if last == i else ("revisit", last))
    assert got[2].url == "v  x"
    some = warc.read_records(index.filter("record_type = 'response'"), stripe=64, max_gap=0)
    assert {r.page_id: bytes(r.payload) for r in some.collect()} == {2: b"a", 4: b"", 5: "bé".encode(), 7: b"long text"}
    kept = {r.page_id: r.record_type for r in warc.read_records(warc.write_archives(df, warc.archive_path(spark), min_bytes=5)).collect()}
    assert [i for i, t in kept.items() if t == "revisit"] == [6]
    assert warc.read_records(warc.write_archives(df.limit(0), warc.archive_path(spark))).count() == 0


def test_secrets_of_odd_texts(spark):
    import time

    began = time.time()
    assert secrets.find(pa.array(["eyJ" * 200_000, "x" * 1_000_000, "token " * 100_000])) == [[], [], []]
    assert time.time() - began < 20
    df = spark.createDataFrame([(1, "password=abcdef12", 3), (1, "password=abcdef12", 3), (None, None, None), (2, "", 0)], "doc_id long, text string, Spans int")
    got = secrets.redact(secrets.scan(df)).collect()
    assert sorted((r.doc_id or 0, r.text or "") for r in got) == [(0, ""), (1, "[secret]"), (1, "[secret]"), (2, "")]
    assert secrets.redact(secrets.scan(df.limit(0))).count() == 0


TEXT = "The river rose during the night and by morning the lower fields lay under water as far as the old mill and its bridge"
MORE_TEXT = "Nobody in the village could remember a flood that came so early in the year, and most had moved their animals up the hill"
# Pages written by hand: html, and the texts that are the article's.
WRITTEN = [
    (f"<body><div><ul><li><a href=/>Home</a><li><a href=/n>News</a></ul></div><div><h1>Flood</h1><p>{TEXT}</p><p>{MORE_TEXT}</p></div><div><p>Copyright the paper</p></div></body>", ["Flood", TEXT, MORE_TEXT]),
    (f"<html><body><h1>Flood in the valley</h1><p>{TEXT}<p>{MORE_TEXT}</body></html>", ["Flood in the valley", TEXT, MORE_TEXT]),
    (f"<table><tr><td><a href=1>Start</a> <a href=2>Archive</a></td><td><h1>Flood</h1><p>{TEXT}</p><h2>After</h2><p>{MORE_TEXT}</p></td></tr></table>", ["Flood", TEXT, "After", MORE_TEXT]),
    (f'<div id="wrapper"><div id="masthead"><a href=/>The Paper</a></div><div class="story-body"><h1>Flood</h1><p>Short.</p><p>{TEXT}</p></div><div class="sidebar-right"><p>{MORE_TEXT}</p></div></div>', ["Flood", "Short.", TEXT]),
    (f'<main><header><h1>Flood</h1></header><p>{TEXT}</p><aside>{MORE_TEXT}</aside></main><footer><p>{MORE_TEXT}</p></footer>', ["Flood", TEXT]),
    (f'<article><p>{TEXT}</p><blockquote>Yes.</blockquote><ul><li>one</li><li>two</li></ul><form><input><button>Send</button></form></article><section id=comments><p>{MORE_TEXT}</p></section>', [TEXT, "Yes.", "one", "two"]),
    (f'<body><div class="cookie-notice"><p>{MORE_TEXT}</p><button>OK</button></div><div role="main"><h1>A &amp; B</h1><p>{TEXT} &#233;</p></div></body>', ["A & B", TEXT + " é"]),
    (f'<article><h1>Flood</h1><p>{TEXT}</p><div class="ad-slot">Buy now</div><p>{MORE_TEXT}</p><div class="share-buttons"><a href=#>Share</a></div></article>', ["Flood", TEXT, MORE_TEXT]),
    (f'<div class="post"><pre>line one\nline  two</pre><p>{TEXT}</p></div><div class="related-posts"><ul><li><a href=/1>{MORE_TEXT}</a></li></ul></div>', ["line one line two", TEXT]),
    (f'<nav><a href=/>Home</a></nav><article lang=de><p>Kurz</p><p>{TEXT}</p></article><script>document.write("<p>{MORE_TEXT}</p>")</script><style>p {{}}</style>', ["Kurz", TEXT]),
]


def test_main_text_of_pages_written_by_hand():
    tree = html_text.trained()
    for html, want in WRITTEN:
        assert html_text.main_text(html, tree).split("\n") == want, html


# Pages whose names contradict their content, or have none.
MISNAMED = [
    (f'<main><div class="content with-sidebar"><h1>T</h1><p>{TEXT}</p></div></main>', ["T", TEXT]),
    (f'<main><div class="post has-comments"><h1>T</h1><p>{TEXT}</p></div></main>', ["T", TEXT]),
    (f'<main><div class="social-story"><h1>T</h1><p>{TEXT}</p></div></main>', ["T", TEXT]),
    (f'<form id="aspnetForm"><nav><a href=1>Home</a></nav><div id="content"><h1>T</h1><p>{TEXT}</p><p>{MORE_TEXT}</p></div></form>', ["T", TEXT, MORE_TEXT]),
    (f'<div class="sidebar-layout"><main><h1>T</h1><p>{TEXT}</p></main><div class="sidebar"><ul><li><a href=1>Other</a></li></ul></div></div>', ["T", TEXT]),
    (f"<article><p>The height <math><mi>h</mi><mo>=</mo><mn>3</mn></math> was measured. {TEXT}</p></article>", [f"The height h=3 was measured. {TEXT}"]),
    (f"<article><p>{TEXT}</p><noscript><p>{MORE_TEXT}</p></noscript><object><p>{TEXT}</p></object></article>", [TEXT, MORE_TEXT, TEXT]),
    ("<h1>News</h1><p>Short text here.</p>", ["News", "Short text here."]),
    (f'<article><h1>T</h1><p>{TEXT}</p></article><section class="related"><article><p>{MORE_TEXT}</p></article></section>', ["T", TEXT]),
    (f'<article><h1>T</h1><p>{TEXT}</p></article><div id="comments">' + f"<p>{MORE_TEXT}</p>" * 9 + "</div>", ["T", TEXT]),
]


def test_main_text_of_pages_with_misleading_names(spark):
    tree = html_text.trained()
    for html, want in MISNAMED:
        assert html_text.main_text(html, tree).split("\n") == want, html
    assert html_text.extract(spark.createDataFrame([], "page_id long, html string")).count() == 0


def test_names():
    says = {"content with-sidebar": 1, "post has-comments": 1, "social-story": 1, "sidebar-content": -1, "siteHeader": -2, "post-header": 0, "related-article": -1, "comment-body": -1, "ad": -1, "side-bar": -1, "col-8 main": 1, "shareholder": 0, "entry-content": 1, "": 0, "navbar navbar-top": -1}
    assert {k: html_text._says(k) for k in says} == says


def test_blocks_without_names_are_judged_by_their_shape():
    x, y = html_text.labelled_blocks(300, seed=5)
    x[:, [html_text.FEATURES.index(n) for n in html_text.NAMED]] = 0
    assert (html_text.trained().predict(x) == y).mean() > 0.78


def test_main_text_of_odd_pages():
    tree = html_text.trained()
    deep = "<div>" * 20_000 + f"<article><p>{TEXT}</p>"
    assert html_text.main_text(deep, tree) == TEXT
    long = "<article>" + f"<p>{TEXT}</p>" * 20_000
    assert html_text.main_text(long, tree).count("\n") == 19_999
    assert html_text.main_text("<article><p>" + "x" * 1_000_000, tree) == "x" * 1_000_000
