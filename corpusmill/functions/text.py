"""Text and encoding functions as Column expressions; legacy charsets decode in one Arrow function."""

from __future__ import annotations

import codecs
import re

import pandas as pd
from pyspark.sql import Column, functions as F

# Unicode white space as a class that Java and RE2 read alike.
SPACE = r"[\t\n\x0B\f\r \x{85}\p{Z}]"
# The patterns of e-mail addresses, urls and tags.
EMAIL = r"[a-zA-Z0-9._%+\-]+@[a-zA-Z0-9.\-]+\.[a-zA-Z]{2,}"
URL = r"https?://[^\t\n\x0B\f\r \x{85}\p{Z}<>\"']+"
TAG = r"<[^>]*>"
# Labels that mean another charset than their name says.
CHARSETS = {"gb2312": "gb18030", "gbk": "gb18030", "gb18030": "gb18030", "big5": "big5hkscs", "euc-jp": "euc_jp", "shift_jis": "cp932", "shift-jis": "cp932", "sjis": "cp932", "euc-kr": "cp949", "windows-1251": "cp1251", "cp1251": "cp1251", "windows-1252": "cp1252", "cp1252": "cp1252", "latin1": "cp1252", "iso-8859-1": "cp1252", "ascii": "cp1252", "us-ascii": "cp1252", "utf-8": "utf-8", "utf8": "utf-8"}


def trim(s: Column) -> Column:
    return F.regexp_replace(s, f"^{SPACE}+|{SPACE}+$", "")


def clean(s: Column) -> Column:
    """White space runs as one space, trimmed."""
    return F.trim(F.regexp_replace(s, f"{SPACE}+", " "))


def extract_regex(s: Column, pattern: str) -> Column:
    """All whole matches; of an invalid pattern none."""
    try:
        re.compile(re.sub(r"\\p\{\w+\}|\\x\{\w+\}", "x", pattern))
    except re.error:
        return F.when(s.isNotNull(), F.array().cast("array<string>"))
    return F.regexp_extract_all(s, F.lit(pattern), F.lit(0))


def extract_emails(s: Column) -> Column:
    return extract_regex(s, EMAIL)


def extract_urls(s: Column) -> Column:
    return extract_regex(s, URL)


def truncate(s: Column, n: int) -> Column:
    """The first n characters and ... if there are more."""
    return F.when(F.length(s) <= n, s).otherwise(F.concat(F.substring(s, 1, n), F.lit("...")))


def strip_tags(s: Column) -> Column:
    return F.regexp_replace(s, TAG, "")


def clean_lines(s: Column, without: tuple[str, ...] = ()) -> Column:
    """Lines trimmed; empty ones, and those that contain one of the phrases, dropped."""

    def good(x: Column) -> Column:
        ok = x != ""
        for phrase in without:
            ok = ok & ~F.contains(x, F.lit(phrase))
        return ok

    return F.array_join(F.filter(F.transform(F.split(s, r"\r?\n"), trim), good), "\n")


def extract_charset(content_type: Column) -> Column:
    """The label after charset=, or null."""
    return F.nullif(F.regexp_extract(content_type, "(?i)charset=[\"']*([^\"'; ]+)", 1), F.lit(""))


def extract_meta_charset(html: Column) -> Column:
    return F.nullif(F.regexp_extract(html, "(?i)charset=[\"']*([^\"'>; ]+)", 1), F.lit(""))


def _codec(label: str | None) -> str | None:
    if not label:
        return None
    label = label.strip().lower()
    try:
        return CHARSETS.get(label) or codecs.lookup(label).name
    except LookupError:
        return None


def _decoded(body: bytes, label: str | None) -> str | None:
    name = _codec(label)
    return None if name is None else body.decode(name, "replace")


def decode(body: Column, content_type: Column) -> Column:
    """Text of a body: byte order mark, then the content type's charset, then UTF-8 if valid, then a charset named in the
    first 2048 bytes, then UTF-8 with replacements. Only bodies in another charset leave the JVM."""

    @F.pandas_udf("string")
    def legacy(bodies: pd.Series, labels: pd.Series) -> pd.Series:
        return pd.Series([None if b is None else _decoded(b, x) for b, x in zip(bodies, labels, strict=True)], dtype=object)

    lossy = F.make_valid_utf8(body.cast("string"))
    label = F.lower(F.trim(extract_charset(F.coalesce(content_type, F.lit("")))))
    preview = F.make_valid_utf8(F.substring(body, 1, 2048).cast("string"))
    meta = extract_meta_charset(preview)
    bom = F.hex(F.substring(body, 1, 3)) == "EFBBBF"
    utf8 = F.is_valid_utf8(body.cast("string"))
    foreign = label.isNotNull() & ~label.isin("utf-8", "utf8")
    by_type = legacy(F.when(foreign & ~bom, body), label)
    by_meta = legacy(F.when(~utf8 & ~bom, body), meta)
    return F.when(bom, F.make_valid_utf8(F.substring(body, 4, 2**31 - 1).cast("string"))).when(label.isin("utf-8", "utf8"), lossy).otherwise(F.coalesce(F.when(foreign, by_type), F.when(utf8, lossy), F.when(~utf8, by_meta), lossy))
