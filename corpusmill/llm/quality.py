"""Quality rules on documents, and removal of lines that many documents of a host share. DataFrame operations only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from corpusmill.llm.shared import discard, free_prefix, need, without, written

_SPACE = r"[\x20\x09-\x0D]+"
_OUT = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "n_removed_words", "n_removed_lines", "clean_text", "kept"]


def words_of(text: Column) -> Column:
    return F.array_remove(F.split(text, _SPACE), "")


def _let(value: Column, body) -> Column:
    """body(x) with x computed once, although body uses it in lambdas."""
    return F.transform(F.array(value), body)[0]


def repeated_words(words: Column, window: int) -> Column:
    """The number of words in windows whose words occur twice or more. Windows are compared by 64-bit hashes."""

    def covered(hashes: Column) -> Column:
        placed = F.array_sort(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
        twice = _let(placed, lambda s: F.filter(s, lambda x, i: ((i > 0) & (x["h"] == F.get(s, i - 1)["h"])) | (x["h"] == F.get(s, i + 1)["h"])))
        starts = F.array_sort(F.transform(twice, lambda x: x["i"]))
        new = lambda acc, i: F.struct(i.alias("last"), (acc["n"] + F.least(F.lit(window), i - acc["last"]).cast("long")).alias("n"))
        total = F.aggregate(starts, F.struct(F.lit(-window).alias("last"), F.lit(0).cast("long").alias("n")), new, lambda acc: acc["n"])
        return F.when(F.size(F.array_distinct(hashes)) < F.size(hashes), total).otherwise(F.lit(0).cast("long"))

    def hashes(w: Column) -> Column:
        return F.transform(F.sequence(F.lit(0), F.size(w) - window), lambda i: F.xxhash64(*[F.get(w, i + k) for k in range(window)]))

    found = _let(F.transform(words, lambda w: F.xxhash64(w)), lambda w: _let(hashes(w), covered))
    return F.when(F.size(words) > window, found).otherwise(F.lit(0).cast("long"))


def _lines(text: Column) -> Column:
    return F.filter(F.split(text, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))


def _plain_line(line: Column) -> Column:
    """The line in lower case, with white space runs as one space, and trimmed: lines are compared so."""
    return F.trim(F.regexp_replace(F.lower(line), _SPACE, " "))


def _line_hash(line: Column) -> Column:
    return F.xxhash64(_plain_line(line))


def frequent_lines(lines: DataFrame, max_docs: int, max_share: float) -> DataFrame:
    """host, h of lines in more distinct documents of a host than both limits allow. lines: a row per line of each document, with host, doc (a hash
    of its whole set of lines) and h. Documents with the same set of lines are one; all others count each, however alike they are."""
    total = lines.groupBy(F.col("host").alias("of_host")).agg(F.countDistinct("doc").alias("host_docs"))
    often = lines.groupBy("host", "h").agg(F.countDistinct("doc").alias("docs")).filter(F.col("docs") > max_docs)
    return often.join(total, F.col("host").eqNullSafe(F.col("of_host"))).filter(F.col("docs") > F.lit(max_share) * F.col("host_docs")).select("host", "h")


def host_tables(frequent: DataFrame) -> DataFrame:
    """host, hot: a host's frequent lines as a hash table, an array of arrays of which the h-th, counted modulo its size, has h."""
    sized = frequent.groupBy(F.col("host").alias("of_host")).agg(F.greatest(F.lit(1), F.least(F.lit(256), F.expr("count(1) div 4"))).cast("int").alias("slots"))
    placed = frequent.join(sized, F.col("host").eqNullSafe(F.col("of_host")))
    slots = placed.groupBy("host", "slots", F.pmod("h", F.col("slots")).cast("int").alias("slot")).agg(F.collect_set("h").alias("hs"))
    hosts = slots.groupBy("host", "slots").agg(F.map_from_entries(F.collect_list(F.struct("slot", "hs"))).alias("by_slot"))
    filled = F.transform(F.sequence(F.lit(0), F.col("slots") - 1), lambda i: F.coalesce(F.try_element_at("by_slot", i), F.array().cast("array<bigint>")))
    return hosts.select("host", filled.alias("hot"))


def _is_hot(hot: Column, line: Column) -> Column:
    return _let(_line_hash(line), lambda h: F.array_contains(F.get(hot, F.pmod(h, F.size(hot)).cast("int")), h))


def quality_rules(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source", min_words: int = 10, window: int = 5, max_repeat_percent: int = 20, max_docs: int = 10, max_share: float = 0.001, min_left_percent: int = 30, broadcast_lines: int = 2_000_000) -> DataFrame:
    """docs with counts, clean_text (text without frequent lines) and kept.

    Base rules: n_words below min_words, or more than max_repeat_percent of the words in windows that repeat within
    the text, fail. A line is removed where more than max_docs distinct documents, and more than max_share of the
    distinct documents, of its host have it (see frequent_lines); a document is depleted, and not kept, if fewer than min_words words or less
    than min_left_percent of its words are left.

    Only line hashes are shuffled. The frequent lines become one row a host, in which each document's lines are
    looked up; these rows are broadcast while they have broadcast_lines hashes at most (some 16 bytes each), and beyond that
    joined by host, where Spark splits large hosts.

    Null texts count as empty, and fail. Very long ones are measured whole. Null hosts form a host of their own. Rows that repeat, or share
    an id, get a result each. Input columns named like results, in any case, are replaced. No rows give no rows.
    """
    need(docs, id_col, text_col, host_col)
    rest = without(docs, _OUT, id_col, text_col, host_col)
    p = free_prefix(docs)
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))

    hashed = docs.select(F.col(host_col).alias("host"), F.array_sort(F.array_distinct(F.transform(_lines(text), _line_hash))).alias("hs"))
    lines = written(hashed.select("host", F.xxhash64("hs").alias("doc"), F.explode("hs").alias("h")), "lines")
    frequent = written(frequent_lines(lines, max_docs, max_share), "frequent-lines")
    discard(lines)
    hosts = written(host_tables(frequent), "frequent-by-host").select(F.col("host").alias(f"{p}host"), F.col("hot").alias(f"{p}hot"))
    if frequent.count() <= broadcast_lines:
        hosts = F.broadcast(hosts)
    discard(frequent)

    hot = F.col(f"{p}hot")
    measured = docs.select(*rest).join(hosts, F.col(host_col).eqNullSafe(F.col(f"{p}host")), "left")
    measured = measured.withColumns({f"{p}words": words_of(text), f"{p}lines": _lines(text)})
    measured = measured.withColumns({
        "n_words": F.size(f"{p}words").cast("long"),
        "word_chars": F.length(F.array_join(f"{p}words", "")).cast("long"),
        "n_symbols": (F.length(text) - F.length(F.regexp_replace(text, "[#*$%&|<>]", ""))).cast("long"),
        "n_dup_lines": (F.size(f"{p}lines") - F.size(F.array_distinct(f"{p}lines"))).cast("long"),
        "n_repeat_words": repeated_words(F.col(f"{p}words"), window),
        f"{p}gone": F.when(hot.isNotNull(), F.transform(F.filter(f"{p}lines", lambda x: _is_hot(hot, x)), lambda x: F.size(words_of(x)))),
    })
    measured = measured.withColumns({
        "base_failed": (F.col("n_words") < min_words) | (100 * F.col("n_repeat_words") > max_repeat_percent * F.col("n_words")),
        "n_removed_words": F.coalesce(F.aggregate(f"{p}gone", F.lit(0).cast("long"), lambda a, n: a + n), F.lit(0).cast("long")),
        "n_removed_lines": F.coalesce(F.size(f"{p}gone"), F.lit(0)).cast("long"),
    })
    without_hot = F.array_join(F.filter(F.split(text, "\n"), lambda x: ~_is_hot(hot, x)), "\n")
    left = F.col("n_words") - F.col("n_removed_words")
    measured = measured.withColumns({
        "clean_text": F.when(F.col("n_removed_lines") == 0, F.col(text_col)).otherwise(without_hot),
        "kept": ~F.col("base_failed") & (left >= min_words) & (100 * left >= min_left_percent * F.col("n_words")),
    })
    return measured.select(*rest, *_OUT)
