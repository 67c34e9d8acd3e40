import hashlib
import json

import pytest
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from corpusmill.functions import items as I, text as T, urls as U, web


def values(spark, rows, column, schema="s string"):
    return [r[0] for r in spark.createDataFrame([r if isinstance(r, tuple) else (r,) for r in rows], schema).select(column).collect()]


def test_text(spark):
    s = F.col("s")
    assert values(spark, ["  hello   world  \n\t foo  ", "a 　b", "", None], T.clean(s)) == ["hello world foo", "a b", "", None]
    assert values(spark, ["hello world", "hello", "é漢字x"], T.truncate(s, 5)) == ["hello...", "hello", "é漢字x"]
    assert values(spark, ["<p>Hi <b>x</b></p>", "a < b"], T.strip_tags(s)) == ["Hi x", "a < b"]
    assert values(spark, ["a@b.co, x.y+z@q.org!"], T.extract_emails(s)) == [["a@b.co", "x.y+z@q.org"]]
    assert values(spark, ['see http://a.b/c?d=e "https://f.g"'], T.extract_urls(s)) == [["http://a.b/c?d=e", "https://f.g"]]
    assert values(spark, ["a1b22"], T.extract_regex(s, r"\d+")) == [["1", "22"]]
    assert values(spark, ["a1b22"], T.extract_regex(s, "(")) == [[]]
    assert values(spark, [" a \n\n b ad \r\n c"], T.clean_lines(s, ("ad",))) == ["a\nc"]


def test_charsets(spark):
    s = F.col("s")
    assert values(spark, ['text/html; CHARSET="gbk"; x', "text/html"], T.extract_charset(s)) == ["gbk", None]
    assert values(spark, ["<meta charset=utf-8>"], T.extract_meta_charset(s)) == ["utf-8"]


@pytest.mark.parametrize(("url", "safe"), [("http://user:pass@h/p", "http://***:***@h/p"), ("http://user@example.com", "http://***@example.com/"), ("http://h/p", "http://h/p"), ("none", "none")])
def test_sanitize_url(spark, url, safe):
    assert values(spark, [url], U.sanitize_url(F.col("s"))) == [safe]


def test_file_names(spark):
    name = U.url_to_filename(F.col("s"), F.lit(5))
    got = values(spark, ["https://example.com/", "https://example.com/a/b.html", "not-a-url", "https://e.com/CON", "https://e.com/" + "x" * 300], name)
    assert got[:4] == ["example.com_index.md", "example.com_a_b.html.md", "page_5.md", "e.com_safe_CON.md"]
    assert len(got[4]) == 103


def test_generalize(spark):
    pairs = {"https://a.b/products/123": r"/products/\d+", "https://a.b/shuku/0-lastupdate-0-1.html": r"/shuku/\d+-lastupdate-\d+-\d+\.html", "https://a.b/v1/a1b2c3d4e5f6": r"/v\d+/[a-f0-9-]+", "https://a.b/about": "/about", "/page/2": r"/page/\d+", "https://a.b/user/deadbeef-cafe-1234/posts": "/user/[a-f0-9-]+/posts"}
    assert values(spark, list(pairs), U.generalize_url(F.col("s"))) == list(pairs.values())


def test_origin(spark):
    got = values(spark, ["https://E.com:443/a", "http://e.com:8080", "ftp://x/", "https://u:p@h/x", None], U.origin(F.col("s")))
    assert got == ["https://e.com", "http://e.com:8080", None, "https://h", None]


@settings(max_examples=20, deadline=None)
@given(st.text(max_size=40))
def test_keys_are_safe(spark, key):
    got = values(spark, [key], U.sanitize_key(F.col("s")))[0]
    assert not set('/\\:*?"<>|') & set(got)
    assert len(got) <= 200


def test_item_id(spark):
    def want(value, url, callback):
        h = hashlib.sha256()
        for x in (url.encode(), (callback or "default").encode(), value.encode()):
            h.update(len(x).to_bytes(8, "little") + x)
        return h.hexdigest()

    rows = [('{"a":1}', "https://é", None), ('{"a":1}', "https://é", "cb")]
    assert values(spark, rows, I.item_id(F.col("v"), F.col("u"), F.col("c")), "v string, u string, c string") == [want(*r) for r in rows]


def test_meta(spark):
    rows = ['{"k":"x","n":3}', '{"k":1,"n":-3}', "{}", "broken", None]
    assert values(spark, rows, I.meta_str(F.col("s"), "k", "d")) == ["x", "d", "d", "d", "d"]
    assert values(spark, rows, I.meta_u64(F.col("s"), "n")) == [3, 0, 0, 0, 0]
    kept = values(spark, ['{"b":[1,{"c":2}],"a":"x"}', "[1,2]"], I.filter_fields(F.col("s"), ("b",)))
    assert json.loads(kept[0]) == {"b": [1, {"c": 2}]}
    assert kept[1] == "[1,2]"


def test_blocked(spark):
    rows = [(403, "", {}), (200, "Just a MOMENT", {}), (200, "x", {"CF-Chl-Bypass": "1"}), (200, "challenge-platform", {}), (200, " " * 65536 + "access denied", {}), (407, "x", {})]
    got = values(spark, rows, web.blocked_reason(F.col("s"), F.encode("b", "UTF-8"), F.col("h")), "s int, b string, h map<string,string>")
    assert got == ["status_code", "body:just a moment", "header:cf-chl", None, None, None]
    assert values(spark, [(404,), (444,), (200,)], web.blocked_status(F.col("s")), "s int") == [False, True, False]


def test_cookies(spark):
    c = web.cookie_from_json(F.col("s"))
    got = values(spark, ['{"name":"a","value":"b"}', '{"name":"a"}'], c)
    assert got[0].path == "/" and got[0].domain == "" and got[1] is None
