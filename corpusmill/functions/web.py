"""Responses: status, blocked and challenge pages, dynamic pages, cookies."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# Reason phrases.
REASONS = {100: "Continue", 101: "Switching Protocols", 200: "OK", 201: "Created", 202: "Accepted", 204: "No Content", 206: "Partial Content", 301: "Moved Permanently", 302: "Found", 303: "See Other", 304: "Not Modified", 307: "Temporary Redirect", 308: "Permanent Redirect", 400: "Bad Request", 401: "Unauthorized", 403: "Forbidden", 404: "Not Found", 405: "Method Not Allowed", 407: "Proxy Authentication Required", 408: "Request Timeout", 409: "Conflict", 410: "Gone", 429: "Too Many Requests", 444: "No Response", 500: "Internal Server Error", 502: "Bad Gateway", 503: "Service Unavailable", 504: "Gateway Timeout"}
# Status codes of blocked pages, and what their bodies say.
BLOCKED = (401, 403, 407, 429, 444, 500, 502, 503, 504)
BLOCKED_BODY = r"(?i)(just a moment|cf-challenge|attention required|access denied)"
# Signs of pages that scripts build.
SPA = r"__NUXT_DATA__|__NEXT_DATA__|react-app\.embeddedData|data-reactroot|ng-version|data-v-app|gatsby-chunk-mapping|/_nuxt/|/_next/static/"
MUTATION = r"\.createElement\(|\.innerHTML|\.outerHTML|history\.pushState|history\.replaceState|fetch\(|new XMLHttpRequest"


def status_text(status: Column) -> Column:
    names = F.create_map(*[F.lit(x) for pair in REASONS.items() for x in pair])
    return F.coalesce(F.try_element_at(names, status.cast("int")), F.lit("Unknown"))


def is_ok(status: Column) -> Column:
    return status.between(200, 299)


def blocked_status(status: Column, codes: tuple[int, ...] = BLOCKED) -> Column:
    return status.isin(*codes)


def _head(body: Column, size: int) -> Column:
    return F.make_valid_utf8(F.substring(body.cast("binary"), 1, size).cast("string"))


def blocked_reason(status: Column, body: Column, headers: Column) -> Column:
    """status_code, header:cf-chl, or body: and the first phrase within 64 KiB; else null."""
    phrase = F.lower(F.regexp_extract(_head(body, 65536), BLOCKED_BODY, 1))
    challenged = F.exists(F.map_keys(headers), lambda k: F.lower(k).startswith("cf-chl"))
    return F.when(status.isin(403, 429, 503), F.lit("status_code")).when(challenged, F.lit("header:cf-chl")).when(phrase != "", F.concat(F.lit("body:"), phrase))


def dynamic_score(body: Column) -> Column:
    head = _head(body, 262144)
    return F.when(F.rlike(head, F.lit(SPA)), F.lit(10)).when(F.rlike(head, F.lit(MUTATION)), F.lit(7)).when(F.regexp_count(head, F.lit("<script")) >= 6, F.lit(7)).otherwise(F.lit(0))


def needs_upgrade(status: Column, body: Column) -> Column:
    return (status == 200) & (dynamic_score(body) >= 7)


def is_html(content_type: Column) -> Column:
    return (content_type == "") | F.contains(F.lower(content_type), F.lit("html"))


def challenge_type(html: Column) -> Column:
    """turnstile, js_challenge, managed or none, by what the stored page contains."""
    has = lambda *xs: F.rlike(html, F.lit("|".join(xs)))
    title = F.regexp_extract(html, "(?is)<title[^>]*>(.*?)</title>", 1)
    turnstile = has("cf-turnstile", "cf-chl-widget", r"<iframe[^>]+(?:src=[\"'][^\"']*challenges\.cloudflare\.com|id=[\"'][^\"']*cf-chl)") | (has("_cf_chl_opt") & has(r"cType\s*:\s*['\"]interactive['\"]"))
    script = F.rlike(title, F.lit("Just a moment|Attention Required")) | has("id=[\"']?challenge-running\\b", "cf-browser-verification", "cf-challenge-running")
    return F.when(turnstile, F.lit("turnstile")).when(script, F.lit("js_challenge")).when(has("id=[\"']?challenge-stage\\b", "managed_checking_msg"), F.lit("managed")).otherwise(F.lit("none"))


def cookie_challenge(status: Column, body: Column, set_cookie: Column, cookie: Column, most: int = 3) -> Column:
    """The Cookie header to ask again with, where a short 403 sets a new cookie; else null."""
    pair = F.element_at(F.split(set_cookie, ";"), 1)
    held = F.coalesce(cookie, F.lit(""))
    new = F.when(held == "", pair).when(~F.contains(held, pair), F.concat(held, F.lit("; "), pair))
    return F.when((status == 403) & (F.octet_length(body) < 200) & (pair != "") & (F.size(F.split(new, "; ")) <= most), new)


def cookie_header(cookies: Column) -> Column:
    """name=value, joined by "; "; null for none. cookies: array of structs."""
    return F.when(F.size(cookies) > 0, F.array_join(F.transform(cookies, lambda c: F.concat(c["name"], F.lit("="), c["value"])), "; "))


def cookie_from_json(text: Column) -> Column:
    """A cookie of a browser's JSON; null unless it has a name and a value."""
    c = F.from_json(text, "name string, value string, domain string, path string, secure boolean, httpOnly boolean, sameSite string, expires double")
    return F.when(c["name"].isNotNull() & c["value"].isNotNull(), F.struct(c["name"].alias("name"), c["value"].alias("value"), F.coalesce(c["domain"], F.lit("")).alias("domain"), F.coalesce(c["path"], F.lit("/")).alias("path"), F.coalesce(c["secure"], F.lit(False)).alias("secure"), F.coalesce(c["httpOnly"], F.lit(False)).alias("http_only"), c["sameSite"].alias("same_site"), c["expires"].alias("expires")))


def cookie_matches(domain: Column, cookie_path: Column, host: Column, path: Column) -> Column:
    d = F.regexp_replace(domain, r"^\.", "")
    return ((host == d) | host.endswith(F.concat(F.lit("."), d))) & path.startswith(cookie_path)
