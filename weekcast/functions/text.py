"""Catalog and URL text rules as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from weekcast.constants import FAMILY_PREFIXES, NAME_ALIASES, TRACKING_PARAMETERS


def canonical_name(name: Column) -> Column:
    """Lower-case name without parentheses, apostrophes folded, known aliases applied."""
    base = F.lower(F.trim(F.regexp_replace(name, r"\s*\([^)]*\)", "")))
    base = F.replace(F.replace(base, F.lit("’"), F.lit("'")), F.lit("lion's mane"), F.lit("lions mane"))
    aliased = F.lit(None).cast("string")
    for alias, target in NAME_ALIASES.items():
        aliased = F.when(base == alias, target).otherwise(aliased)
    return F.coalesce(aliased, base)


def slug(name: Column) -> Column:
    return F.btrim(F.regexp_replace(F.lower(name), "[^a-z0-9]+", "-"), F.lit("-"))


def family(name: Column) -> Column:
    rule = F.lit(None).cast("string")
    for prefix in FAMILY_PREFIXES:
        rule = F.when(name.startswith(prefix), prefix).otherwise(rule)
    return F.coalesce(rule, slug(name))


def folded(text: Column) -> Column:
    """Case- and edge-whitespace-insensitive form used for term matching."""
    return F.lower(F.trim(text))


def _form_decode(text: Column) -> Column:
    return F.coalesce(F.try_url_decode(text), text)


def _form_encode(text: Column) -> Column:
    # url_encode leaves '*' bare and escapes '~'; the canonical form has it the other way round.
    return F.replace(F.replace(F.url_encode(text), F.lit("*"), F.lit("%2A")), F.lit("%7E"), F.lit("~"))


def bind(value: Column, body) -> Column:
    """``body`` applied to ``value`` evaluated once (a one-element transform), not once per mention."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _sorted_query(query: Column) -> Column:
    """Query pairs decoded, without tracking ones, sorted and encoded again."""

    def pair(part: Column) -> Column:
        name = F.substring_index(part, "=", 1)
        value = F.substr(part, F.length(name) + 2)
        return F.struct(_form_decode(name).alias("name"), _form_decode(value).alias("value"))

    def keep(item: Column) -> Column:
        name = F.lower(item["name"])
        return ~name.startswith("utm_") & ~name.isin(*TRACKING_PARAMETERS)

    parts = F.filter(F.split(query, "&"), lambda part: part != "")
    pairs = F.array_sort(F.filter(F.transform(parts, pair), keep))
    return F.array_join(
        F.transform(pairs, lambda p: F.concat(_form_encode(p["name"]), F.lit("="), _form_encode(p["value"]))),
        "&",
    )


def canonical_url(url: Column) -> Column:
    """Web link without fragment and tracking parameters, query sorted; NULL if not acceptable.

    Only http(s) links with a host and without credentials or control characters pass.
    Queries are decoded, sorted by (name, value) and encoded again, so equal links compare equal.
    """
    def split_query(clean: Column) -> Column:
        before = F.substring_index(clean, "?", 1)
        return F.struct(before.alias("before"), F.substr(clean, F.length(before) + 2).alias("query"))

    def split_scheme(cut: Column) -> Column:
        scheme = F.substring_index(cut["before"], "://", 1)
        return F.struct(
            F.lower(scheme).alias("scheme"), F.substr(cut["before"], F.length(scheme) + 4).alias("rest"), cut["query"].alias("query")
        )

    def split_host(cut: Column) -> Column:
        netloc = F.substring_index(cut["rest"], "/", 1)
        path = F.rtrim(F.substr(cut["rest"], F.length(netloc) + 1), F.lit("/"))
        return F.struct(cut["scheme"].alias("scheme"), F.lower(netloc).alias("netloc"), path.alias("path"), cut["query"].alias("query"))

    def join(cut: Column) -> Column:
        netloc = cut["netloc"]
        host = F.substring_index(netloc, "@", -1)
        acceptable = (
            cut["scheme"].isin("http", "https")
            & ~(F.contains(netloc, F.lit("@")) & netloc.rlike(r"[^:@].*@"))
            & (host != "")
            & ~host.startswith(":")
        )
        address = F.concat(
            cut["scheme"],
            F.lit("://"),
            netloc,
            F.when(cut["path"] == "", "/").otherwise(cut["path"]),
            F.when(cut["query"] == "", "").otherwise(F.rtrim(F.concat(F.lit("?"), _sorted_query(cut["query"])), F.lit("?"))),
        )
        return F.when(acceptable, address)

    clean = F.when(~url.rlike(r"[\x00-\x1f]"), F.substring_index(F.trim(url), "#", 1))
    return bind(bind(bind(bind(clean, split_query), split_scheme), split_host), join)


def safe_url(url: Column) -> Column:
    """Trimmed http(s) link, else NULL; used where a stored link is only shown."""
    clean = F.trim(url)
    usable = ~url.rlike(r"[\x00-\x1f]") & clean.rlike(r"(?i)^https?://[^/?#]+")
    return F.when(usable, clean)
