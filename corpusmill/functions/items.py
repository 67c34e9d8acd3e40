"""Items: JSON payloads with provenance and a stable id."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def _length(b: Column) -> Column:
    """The byte length as eight little-endian bytes."""
    h = F.lpad(F.hex(F.octet_length(b).cast("long")), 16, "0")
    return F.unhex(F.concat(*[F.substring(h, i, 2) for i in range(15, 0, -2)]))


def item_id(value: Column, url: Column, callback: Column) -> Column:
    """SHA-256 over length and bytes of url, callback (or default) and the payload's compact JSON."""
    parts = [F.encode(x, "UTF-8") for x in (url, F.coalesce(callback, F.lit("default")), value)]
    return F.sha2(F.concat(*[x for p in parts for x in (_length(p), p)]), 256)


def canonical_json(text: Column) -> Column:
    """Compact, with sorted keys."""
    return F.to_json(F.try_parse_json(text))


def meta_str(meta: Column, key: str, default: str = "") -> Column:
    """A string member; of another type or missing, the default."""
    v = F.try_variant_get(F.try_parse_json(meta), f"$.{key}", "variant")
    return F.coalesce(F.when(F.schema_of_variant(v) == "STRING", F.try_variant_get(F.try_parse_json(meta), f"$.{key}", "string")), F.lit(default))


def meta_u64(meta: Column, key: str) -> Column:
    v = F.try_variant_get(F.try_parse_json(meta), f"$.{key}", "variant")
    n = F.try_variant_get(F.try_parse_json(meta), f"$.{key}", "long")
    return F.when((F.schema_of_variant(v) == "BIGINT") & (n >= 0), n).otherwise(F.lit(0).cast("long"))


def typed(value: Column, schema: str) -> Column:
    """The payload as a struct; null where it does not fit."""
    return F.from_json(value, schema)


def filter_fields(value: Column, fields: tuple[str, ...]) -> Column:
    """Only the named members of an object; other payloads stay as they are."""
    members = F.from_json(value, "map<string,string>")
    kept = F.map_filter(F.from_json(value, "map<string,variant>"), lambda k, _: k.isin(*fields))
    return F.when(F.ltrim(value).startswith("{") & members.isNotNull(), F.to_json(kept)).otherwise(value)


def response_json(body: Column, content_type: Column) -> Column:
    """The decoded body as JSON; null where it is none."""
    from corpusmill.functions.text import decode

    return F.try_parse_json(decode(body, content_type))


def map_value(items, change):
    """Items with change(value) as payload, and the id that goes with it; a null payload stays an item with a null payload's id."""
    return items.withColumn("value", change(F.col("value"))).withColumn("id", item_id(F.col("value"), F.col("source_url"), F.col("callback")))


def with_value(items, value: Column):
    """Items with another payload, and the id that goes with it."""
    return map_value(items, lambda _: value)


def random_suffix(n: int = 8) -> Column:
    """n random hexadecimal digits for each row, at most 32."""
    return F.substring(F.replace(F.uuid(), F.lit("-"), F.lit("")), 1, n)


def summary(pages: Column, items: Column, errors: Column, ms: Column) -> Column:
    return F.format_string("%d pages / %d items / %d errors / %d ms", pages.cast("long"), items.cast("long"), errors.cast("long"), ms.cast("long"))
