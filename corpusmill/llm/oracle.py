"""SQL that gives the rows of the queries whose operators SQL can express, for DuckDB over the same tables."""

from __future__ import annotations

from corpusmill.llm import secrets
from corpusmill.llm.url_filter import RULES

_SPACE = r"[\x20\x09-\x0D]+"
_WORDS = "list_filter(string_split_regex({0}, '" + _SPACE + "'), lambda w: w <> '')"


def _words(x: str) -> str:
    return _WORDS.format(x)


# Lines are compared as they are written here, documents by their sorted sets of lines.
QUALITY = rf"""
WITH d AS (SELECT doc_id, source AS host, coalesce(text, '') AS t FROM documents),
w AS (SELECT *, {_words("t")} AS ws, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ls FROM d),
grams AS (SELECT doc_id, i, array_to_string(ws[i : i + 4], ' ') AS g FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 3)) AS i FROM w)),
twice AS (SELECT doc_id, i FROM grams QUALIFY count(*) OVER (PARTITION BY doc_id, g) > 1),
repeated AS (SELECT doc_id, count(DISTINCT i + j) AS n FROM twice, range(5) r(j) GROUP BY doc_id),
plain AS (SELECT doc_id, host, list_transform(ls, lambda x: trim(regexp_replace(lower(x), '{_SPACE}', ' ', 'g'))) AS ps, list_transform(ls, lambda x: len({_words("x")})) AS ns FROM w),
docs AS (SELECT doc_id, host, list_sort(list_distinct(ps)) AS doc FROM plain),
lines AS (SELECT DISTINCT host, doc, unnest(doc) AS l FROM docs),
totals AS (SELECT host, count(DISTINCT doc) AS host_docs FROM lines GROUP BY host),
counted AS (SELECT host, l, count(DISTINCT doc) AS docs FROM lines GROUP BY host, l HAVING count(DISTINCT doc) > 10),
frequent AS (SELECT c.host, c.l FROM counted c JOIN totals t ON c.host IS NOT DISTINCT FROM t.host WHERE c.docs > 0.001 * t.host_docs),
removed AS (SELECT e.doc_id, sum(e.n) AS n FROM (SELECT doc_id, host, unnest(ps) AS l, unnest(ns) AS n FROM plain) e JOIN frequent f ON e.l = f.l AND e.host IS NOT DISTINCT FROM f.host GROUP BY e.doc_id),
counts AS (SELECT w.doc_id, len(ws)::BIGINT AS n_words, coalesce(list_sum(list_transform(ws, lambda x: length(x))), 0)::BIGINT AS word_chars, (length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols,
  (len(ls) - len(list_distinct(ls)))::BIGINT AS n_dup_lines, coalesce(r.n, 0)::BIGINT AS n_repeat_words, coalesce(m.n, 0)::BIGINT AS n_removed_words FROM w LEFT JOIN repeated r USING (doc_id) LEFT JOIN removed m USING (doc_id)),
judged AS (SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed FROM counts)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND n_words - n_removed_words >= 10 AND 100 * (n_words - n_removed_words) >= 30 * n_words AS kept, n_removed_words FROM judged"""


def _either_case(word: str) -> str:
    return "".join(f"[{c}{c.upper()}]" if c.isalpha() else c for c in word)


# The rules in the syntax of RE2, with what stands before a match as the first group, the match as the second and its value, if it is less, as the last.
_NAMES = "|".join(map(_either_case, ("password", "passwd", "secret", "token", "api_?key")))
_SECRETS = {"assign": (rf"()((?:{_NAMES})[\"'']?\x20*[:=]\x20*[\"'']?([A-Za-z0-9+/_.=-]+))", 3), "jwt": (r"(^|[^A-Za-z0-9_-])(eyJ[A-Za-z0-9_-]+\.eyJ[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+)", 2)}


def _secrets_of(k: int, rule: secrets.Rule) -> str:
    """Texts cut at the matches: pieces and matches in turn, whose lengths give the places."""
    pattern, group = _SECRETS.get(rule.kind, (f"()({rule.pattern})", 2))
    cut = rf"string_split(regexp_replace(coalesce(text, ''), '{pattern}', '\1' || chr(57344) || '\2' || chr(57344), 'g'), chr(57344))"
    value = f"regexp_extract(piece, '{pattern}', {group})"
    return f"""SELECT doc_id, {k} AS k, '{rule.kind}' AS kind, place AS a, place + length(piece) AS b FROM (
  SELECT doc_id, piece, i, sum(length(piece)) OVER (PARTITION BY doc_id ORDER BY i) - length(piece) AS place FROM (SELECT doc_id, unnest(p) AS piece, unnest(range(len(p))) AS i FROM (SELECT doc_id, {cut} AS p FROM documents)))
  WHERE i % 2 = 1 AND length({value}) >= {rule.least}"""


_BASE_KINDS = ", ".join(f"'{r.kind}'" for r in secrets.BASE)
SECRETS = f"""
WITH found AS ({" UNION ALL ".join(_secrets_of(k, r) for k, r in enumerate(secrets.RULES))}),
listed AS (SELECT doc_id, {", ".join(f"count(*) FILTER (kind = '{r.kind}') AS n_{r.kind}" for r in secrets.BASE)},
  string_agg(kind || ':' || a || ':' || b, ',' ORDER BY a, k) FILTER (kind IN ({_BASE_KINDS})) AS base, string_agg(kind || ':' || a || ':' || b, ',' ORDER BY a, k) AS spans FROM found GROUP BY doc_id)
SELECT d.doc_id, {", ".join(f"coalesce(n_{r.kind}, 0) AS n_{r.kind}" for r in secrets.BASE)}, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans FROM documents d LEFT JOIN listed USING (doc_id)"""

_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def _rule_case(then) -> str:
    ordered = sorted(RULES, key=lambda r: len(r.host + r.path), reverse=True)
    return "CASE " + " ".join(f"WHEN (host = '{r.host}' OR ends_with(host, '.{r.host}')) AND starts_with(path, '{r.path}') THEN '{then(r)}'" for r in ordered) + " END"


# No branch of the tables has more than 50 children, once segments that vary by their form are wildcards, so that none becomes one by its rarity.
_SEGMENT = r"""CASE WHEN s <> '' AND regexp_matches(s, '^\d+(?:\.[A-Za-z]{1,5})?$|^[0-9a-fA-F-]{16,}(?:\.[A-Za-z]{1,5})?$|\d.*\d.*\d') THEN '*' || regexp_extract(s, '(\.[A-Za-z]{1,5})$', 1) ELSE s END"""
URLS = rf"""
WITH RECURSIVE u AS (SELECT page_id, coalesce(translate(regexp_extract(url, '^(?s:.*?)://([^/?#]*)', 1), '{_UPPER}', '{_UPPER.lower()}'), '') AS host, coalesce(regexp_extract(url, '^(?s:.*?)://[^/?#]*([^?#]*)', 1), '') AS path FROM pages),
r AS (SELECT *, {_rule_case(lambda r: r.host + r.path)} AS rule, {_rule_case(lambda r: r.verdict)} AS said, list_transform(string_split(path, '/'), lambda s: {_SEGMENT}) AS segs FROM u),
t AS (SELECT host, segs, count(said) AS labelled, count(*) FILTER (said = 'block') AS bad FROM r GROUP BY host, segs),
x AS (SELECT host, k, list_append(segs, '/')[1:k] AS node, sum(labelled) AS n, sum(bad) AS bad FROM (SELECT *, unnest(range(len(segs) + 2)) AS k FROM t) GROUP BY ALL),
g AS (SELECT least(0.5::DOUBLE, (sum(bad) + 1)::DOUBLE / (sum(labelled) + 2)) AS prior FROM t),
f AS (SELECT t.host, t.segs, 0 AS k, (x.bad + 2 * prior) / (x.n + 2) AS share FROM t JOIN x ON x.host = t.host AND x.k = 0, g
  UNION ALL SELECT f.host, f.segs, x.k, CASE WHEN x.n = 0 THEN (f.share + prior) / 2 WHEN abs(x.bad::DOUBLE / x.n - f.share) <= 1.96 * sqrt(f.share * (1 - f.share) / x.n) THEN f.share ELSE (x.bad + 2 * f.share) / (x.n + 2) END
  FROM f JOIN x ON x.host = f.host AND x.k = f.k + 1 AND x.node = list_append(f.segs, '/')[1 : f.k + 1] AND f.k <= len(f.segs), g)
SELECT page_id, r.host, r.path, r.rule, coalesce(said, CASE WHEN f.share >= 0.9 THEN 'block' ELSE 'allow' END) AS verdict FROM r JOIN f ON f.host = r.host AND f.segs = r.segs AND f.k = len(f.segs) + 1"""

_BITS = "('0x' || substr(hex, 5 * (i // 4) + 1, 5))::BIGINT"
WARC = f"""
WITH p AS (SELECT page_id, coalesce(html, '') AS html, sha1(coalesce(html, '')) AS hex FROM pages),
k AS (SELECT hex, max(page_id) AS keeper, count(*) AS n FROM p GROUP BY hex)
SELECT page_id, octet_length(encode(html))::BIGINT AS payload_bytes, array_to_string(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', (({_BITS} >> (15 - 5 * (i % 4))::INTEGER) & 31)::INTEGER + 1, 1)), '') AS payload_digest,
  CASE WHEN page_id = keeper THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> keeper THEN keeper END AS refers_to FROM p JOIN k USING (hex)"""

def _components(nodes: str, links: str) -> str:
    """Names of CTEs (of a WITH RECURSIVE) that give low: a, b, the smallest node that links lead to from each."""
    return f"""both_ways AS (SELECT a, b FROM ({links}) UNION SELECT b, a FROM ({links})),
reach AS (SELECT id AS a, id AS b FROM ({nodes}) UNION SELECT r.a, l.b FROM reach r JOIN both_ways l ON r.b = l.a),
low AS (SELECT a, min(b) AS b FROM reach GROUP BY a)"""


EMBEDDINGS = f"""
WITH RECURSIVE v AS (SELECT vec_id, label, embedding::DOUBLE[] AS e FROM embeddings),
s AS (SELECT vec_id, label, e, sqrt(list_sum(list_transform(e, lambda x: x * x))) AS norm FROM v WHERE label IS NOT NULL AND len(e) > 0 AND len(list_filter(e, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(e, lambda x: x <> 0)) > 0),
links AS MATERIALIZED (SELECT a.vec_id AS a, b.vec_id AS b FROM s a JOIN s b ON a.label = b.label AND a.vec_id < b.vec_id AND len(a.e) = len(b.e) AND list_dot_product(a.e, b.e) / (a.norm * b.norm) >= 0.98),
{_components("SELECT vec_id AS id FROM embeddings", "SELECT a, b FROM links")},
degree AS (SELECT a, count(*) AS n FROM both_ways GROUP BY a)
SELECT vec_id, coalesce(d.n, 0)::BIGINT AS n_links, low.b AS component_id, vec_id = low.b AS kept FROM embeddings JOIN low ON low.a = vec_id LEFT JOIN degree d ON d.a = vec_id"""

JACCARD = f"""
WITH RECURSIVE w AS (SELECT doc_id, {_words(f"translate(coalesce(text, ''), '{_UPPER}', '{_UPPER.lower()}')")} AS ws FROM documents),
sh AS MATERIALIZED (SELECT DISTINCT doc_id, unnest(CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 4 THEN [array_to_string(ws, ' ')] ELSE list_transform(range(1, len(ws) - 2), lambda i: array_to_string(ws[i : i + 3], ' ')) END) AS s FROM w),
sizes AS (SELECT doc_id, count(*) AS n FROM sh GROUP BY doc_id),
common AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS c FROM sh x JOIN sh y ON x.s = y.s AND x.doc_id < y.doc_id GROUP BY 1, 2),
links AS MATERIALIZED (SELECT a, b FROM common JOIN sizes x ON x.doc_id = a JOIN sizes y ON y.doc_id = b WHERE 100 * c >= 85 * (x.n + y.n - c)),
{_components("SELECT doc_id AS id FROM documents", "SELECT a, b FROM links")}
SELECT d.doc_id, coalesce(n, 0)::BIGINT AS n_shingles, low.b AS component_id FROM documents d LEFT JOIN sizes USING (doc_id) JOIN low ON low.a = d.doc_id"""

ORACLE_SQL = {"op2_quality_rules": QUALITY, "op4_secrets": SECRETS, "op5_url_filter": URLS, "op6_warc": WARC, "op7_embeddings": EMBEDDINGS, "op8_jaccard": JACCARD}
