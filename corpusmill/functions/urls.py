"""URL functions. The usual forms are Column expressions; the urls that need a full parser go through one Arrow function."""

from __future__ import annotations

import ipaddress
from urllib.parse import quote, urljoin, urlsplit

import pandas as pd
from pyspark.sql import Column, functions as F

from corpusmill.functions.text import trim

# Names that a file must not have on some systems.
RESERVED = ("CON", "PRN", "AUX", "NUL", "COM1", "COM2", "COM3", "COM4", "COM5", "COM6", "COM7", "COM8", "COM9", "LPT1", "LPT2", "LPT3", "LPT4", "LPT5", "LPT6", "LPT7", "LPT8", "LPT9")
_ABSOLUTE = r"(?s)^([A-Za-z][A-Za-z0-9+.-]*)://([^/?#]*)([^?#]*)(\?[^#]*)?(#.*)?$"


def scheme(url: Column) -> Column:
    return F.lower(F.regexp_extract(url, _ABSOLUTE, 1))


def authority(url: Column) -> Column:
    return F.regexp_extract(url, _ABSOLUTE, 2)


def path(url: Column) -> Column:
    found = F.regexp_extract(url, _ABSOLUTE, 3)
    return F.when(F.rlike(url, F.lit(_ABSOLUTE)) & (found == ""), F.lit("/")).otherwise(found)


def host(url: Column) -> Column:
    return F.lower(F.regexp_replace(F.regexp_replace(authority(url), "^.*@", ""), r":\d*$", ""))


def origin(url: Column) -> Column:
    """scheme://host[:port], without a default port; null for other than http and https."""
    port = F.regexp_extract(authority(url), r":(\d+)$", 1)
    default = ((scheme(url) == "http") & (port == "80")) | ((scheme(url) == "https") & (port == "443"))
    text = F.concat(scheme(url), F.lit("://"), host(url), F.when((port == "") | default, F.lit("")).otherwise(F.concat(F.lit(":"), port)))
    return F.when(scheme(url).isin("http", "https") & (host(url) != ""), text)


def _join(base: str, href: str) -> str | None:
    try:
        parts = urlsplit(urljoin(base.strip(), href.strip()))
        if parts.scheme not in ("http", "https") or not parts.hostname or not urlsplit(base.strip()).netloc:
            return None
        port = "" if parts.port is None or parts.port == {"http": 80, "https": 443}[parts.scheme] else f":{parts.port}"
        name = parts.hostname if ":" not in parts.hostname else f"[{parts.hostname}]"
        user = parts.netloc.rpartition("@")[0]
        safe = "!$%&'()*+,/:;=@[]|~-._"
        out = f"{parts.scheme}://{user + '@' if user else ''}{name}{port}{quote(parts.path, safe=safe) or '/'}"
        out += "?" + quote(parts.query, safe=safe + "?`{}^\\") if parts.query else ""
        return out + ("#" + quote(parts.fragment, safe=safe + "?#{}^\\") if parts.fragment else "")
    except ValueError:
        return None


def resolve_href(base: Column, href: Column) -> Column:
    """The absolute url of a link, or null where it is not http or https.

    A link that begins with http:// or https:// stays as it is. A plain root-relative one is put behind the origin;
    others, and those with characters to be escaped, are joined by a parser."""

    @F.pandas_udf("string")
    def joined(bases: pd.Series, hrefs: pd.Series) -> pd.Series:
        return pd.Series([None if b is None or h is None else _join(b, h) for b, h in zip(bases, hrefs, strict=True)], dtype=object)

    verbatim = href.startswith("http://") | href.startswith("https://")
    plain = F.rlike(href, F.lit(r"^/(?:[A-Za-z0-9_~!$&'()*+,;=:@%-]+(?:\.[A-Za-z0-9_~-]+)*/?)*(?:\?[A-Za-z0-9_~!$&()*+,;=:@%./-]+)?$")) & ~F.contains(authority(base), F.lit("@"))
    other = F.when(~verbatim & ~F.coalesce(plain, F.lit(False)), href)
    return F.when(verbatim, href).when(plain, F.concat(origin(base), href)).otherwise(joined(F.when(other.isNotNull(), base), other))


def sanitize_url(url: Column) -> Column:
    """User and password as ***; an url without a user stays as it is."""
    user = F.regexp_extract(authority(url), "^([^:@]+)(:[^@]*)?@", 1)
    masked = F.when(F.length(F.regexp_extract(authority(url), "^[^:@]+:([^@]+)@", 1)) > 0, F.lit("***:***@")).otherwise(F.lit("***@"))
    rest = F.regexp_replace(authority(url), "^.*@", "")
    whole = F.concat(scheme(url), F.lit("://"), masked, F.lower(rest), path(url), F.coalesce(F.regexp_extract(url, _ABSOLUTE, 4), F.lit("")), F.coalesce(F.regexp_extract(url, _ABSOLUTE, 5), F.lit("")))
    return F.when(user != "", whole).otherwise(url)


def _unreserved(s: Column, prefix: str) -> Column:
    return F.when(F.upper(s).isin(*RESERVED), F.concat(F.lit(prefix), s)).otherwise(s)


def url_to_filename(url: Column, n: Column, prefix: str = "safe_") -> Column:
    """host_path, or host_index, cut to 100 characters, and .md; page_n where url is none. prefix goes before reserved names."""
    part = _unreserved(F.translate(F.regexp_replace(path(url), "^/+|/+$", ""), "/\\", "__"), prefix)
    base = F.when(F.rlike(url, F.lit(_ABSOLUTE)) & (host(url) != ""), F.concat(host(url), F.lit("_"), F.when(part == "", F.lit("index")).otherwise(part))).otherwise(F.concat(F.lit("page_"), n.cast("string")))
    return F.concat(F.substring(base, 1, 100), F.lit(".md"))


def sanitize_key(key: Column, prefix: str = "safe_") -> Column:
    return F.substring(_unreserved(F.translate(key, '/\\:*?"<>|', "_________"), prefix), 1, 200)


def _public_v6(name: str) -> bool:
    try:
        ip = ipaddress.IPv6Address(name.strip("[]").partition("%")[0])
    except ValueError:
        return False
    first = int(ip) >> 112
    return not (ip.is_loopback or ip.is_unspecified or ip.is_multicast or first & 0xFE00 == 0xFC00 or first & 0xFFC0 == 0xFE80)


def valid_url(url: Column) -> Column:
    """http or https, with a host that is no private, local, reserved or broadcast address."""

    @F.pandas_udf("boolean")
    def v6(names: pd.Series) -> pd.Series:
        return pd.Series([None if x is None else _public_v6(x) for x in names], dtype=object)

    u = trim(url)
    h, literal6 = host(u), F.regexp_extract(authority(u), r"(\[[^\]]*\])", 1)
    octet = lambda i: F.try_element_at(F.split(h, r"\."), F.lit(i)).try_cast("int")
    v4 = F.rlike(h, F.lit(r"^\d{1,3}(?:\.\d{1,3}){3}$"))
    a, b = octet(1), octet(2)
    private = a.isin(127, 10, 0) & ((a != 0) | (h == "0.0.0.0")) | ((a == 172) & b.between(16, 31)) | ((a == 192) & (b == 168)) | ((a == 169) & (b == 254)) | a.between(224, 239) | (h == "255.255.255.255")
    v4_ok = ~private & F.forall(F.split(h, r"\."), lambda x: x.cast("int") <= 255)
    known = scheme(u).isin("http", "https") & (h != "")
    return F.coalesce(F.when(~known, F.lit(False)).when(literal6 != "", v6(F.when(literal6 != "", literal6))).when(v4, F.when(v4, v4_ok)).otherwise(F.lit(True)), F.lit(False))


_ESCAPED = r"([\\.+*?()|\[\]{}^$])"


def generalize_url(url: Column) -> Column:
    """The path as an expression: numbers as \\d+, hashes and uuids as [a-f0-9-]+, the rest escaped."""
    p = F.when(F.rlike(url, F.lit(_ABSOLUTE)), path(url)).otherwise(url)

    def segment(s: Column) -> Column:
        digits = F.rlike(s, F.lit("^[0-9]+$"))
        hashed = F.rlike(s, F.lit("^[0-9a-fA-F-]{8,}$")) & F.rlike(s, F.lit("[0-9]"))
        mixed = F.regexp_replace(F.regexp_replace(s, _ESCAPED, r"\\$1"), "[0-9]+", r"\\d+")
        literal = F.regexp_replace(s, r"([\\.+*?()|\[\]{}^$#&~-])", r"\\$1")
        return F.when(s == "", s).when(digits, F.lit(r"\d+")).when(hashed, F.lit("[a-f0-9-]+")).when(F.rlike(s, F.lit("[0-9]")), mixed).otherwise(literal)

    return F.array_join(F.transform(F.split(p, "/"), segment), "/")
