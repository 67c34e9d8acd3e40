"""Tools over stored pages by JSON-RPC messages, and as SQL functions."""

from __future__ import annotations

import json
from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F

from corpusmill.functions import urls as U
from corpusmill.operators import dom
from corpusmill.plans import spider as S

# Codes of JSON-RPC errors.
PARSE_ERROR, NO_METHOD, FAILED = -32700, -32601, -32603
VERSION = "2024-11-05"
TOOLS = {
    "fetch_page": ("The stored page of a url.", ("url",)),
    "extract_css": ("Texts, or one attribute, of what a selector matches in a text of HTML.", ("html", "selector")),
    "crawl_site": ("Items of what a selector matches on the pages that links lead to.", ("start_urls", "selector")),
}


def register(spark: SparkSession) -> None:
    """extract_css(html, selector, attr) as a SQL function: attr null for texts."""

    def extract(html: pd.Series, selector: pd.Series, attr: pd.Series) -> pd.Series:
        found = []
        for h, s, a in zip(html, selector, attr, strict=True):
            nodes = [] if h is None or s is None else dom.select(dom.parse(h), s)
            found.append([n.text() if a is None else n.attrs.get(a, "") for n in nodes])
        return pd.Series(found, dtype=object)

    spark.udf.register("extract_css", F.pandas_udf(extract, "array<string>"))


def _fetch_page(pages: DataFrame, url: str) -> str:
    row = pages.filter((F.col("url") == url) & U.valid_url(F.col("url"))).select("html").first()
    if row is None:
        raise ValueError(f"no page of {url}")
    return row.html or ""


def _extract_css(pages: DataFrame, html: str, selector: str, attr: str | None = None) -> str:
    return json.dumps([n.text() if attr is None else n.attrs.get(attr, "") for n in dom.select(dom.parse(html), selector)], ensure_ascii=False)


def _crawl_site(pages: DataFrame, start_urls: list[str], selector: str, follow: str | None = None, max_pages: int | None = None, max_depth: int | None = None) -> str:
    items = S.crawl_site(pages, start_urls, selector, follow, S.Options(max_pages=max_pages, max_depth=max_depth))
    return "[" + ",".join(r.value for r in items.orderBy("source_url", "id").collect()) + "]"  # of 1000 pages at most


_CALLS: dict[str, Callable[..., str]] = {"fetch_page": _fetch_page, "extract_css": _extract_css, "crawl_site": _crawl_site}


def handle(pages: DataFrame, message: str) -> str | None:
    """The answer to a message, or none to a notification. pages: url, html."""
    try:
        request = json.loads(message)
        method, params = request["method"], request.get("params") or {}
    except (ValueError, KeyError, TypeError, AttributeError) as e:
        return _answer(None, error=(PARSE_ERROR, str(e)))
    if "id" not in request:
        return None
    key = request["id"]
    if method == "initialize":
        return _answer(key, {"protocolVersion": VERSION, "capabilities": {"tools": {}}, "serverInfo": {"name": "corpusmill", "version": "1"}})
    if method == "tools/list":
        return _answer(key, {"tools": [{"name": n, "description": d, "inputSchema": {"type": "object", "required": list(r)}} for n, (d, r) in TOOLS.items()]})
    if method in ("resources/list", "prompts/list"):
        return _answer(key, {method.split("/")[0]: []})
    if method != "tools/call" or params.get("name") not in _CALLS:
        return _answer(key, error=(NO_METHOD, f"unknown: {params.get('name') if method == 'tools/call' else method}"))
    try:
        return _answer(key, {"content": [{"type": "text", "text": _CALLS[params["name"]](pages, **(params.get("arguments") or {}))}]})
    except Exception as e:  # noqa: BLE001  whatever a call raises is its answer
        return _answer(key, error=(FAILED, str(e)[:500]))


def _answer(key, result=None, error: tuple[int, str] | None = None) -> str:
    out = {"jsonrpc": "2.0", "id": key}
    out |= {"result": result} if error is None else {"error": {"code": error[0], "message": error[1]}}
    return json.dumps(out, ensure_ascii=False)
