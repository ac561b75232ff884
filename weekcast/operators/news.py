"""News context: validation, association, windowing, de-duplication and search worklists.

News is never a model feature. Results are flat tables (leads, and their ingredients, brands and
related sources), so that an event reported by very many sources is never gathered in one row.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from weekcast.constants import EVIDENCE, NEWS_MONTHS, NEWS_WORDS, REGIONS, SOURCE_KINDS
from weekcast.functions.dates import strict_date, window_start
from weekcast.functions.text import canonical_url, folded, safe_url
from weekcast.operators.components import connected_components
from weekcast.operators.scale import spread_join
from weekcast.session import stage

RELATED = "array<struct<title:string,url:string,source:string,published_at:string,evidence:string,source_kind:string>>"
ITEM = (
    "id string, title string, url string, source string, summary string, region string, category string, "
    "evidence string, source_kind string, relevance_note string, date_evidence string, region_evidence string, "
    "verification_note string, event_id string, published_at string, event_at string, retrieved_at string, "
    f"ingredient_ids array<string>, ingredient_keywords array<string>, brands array<string>, related_sources {RELATED}"
)
REQUIRED = ("title", "source", "summary", "category", "relevance_note")
VERIFIED_NOTES = ("date_evidence", "region_evidence", "verification_note")
ISO_TIMESTAMP = r"^\d{4}-\d{2}-\d{2}([T ]\d{2}(:\d{2}(:\d{2}(\.\d+)?)?)?(Z|[+-]\d{2}:?\d{2})?)?$"


def _blank(column: Column) -> Column:
    return F.coalesce(F.trim(column), F.lit("")) == ""


def _has_blank(values: Column) -> Column:
    return F.exists(values, lambda v: F.coalesce(F.trim(v), F.lit("")) == "")


def _clean_list(values: Column) -> Column:
    """Trimmed, distinct, first-seen order."""
    return F.array_distinct(F.transform(F.coalesce(values, F.array().cast("array<string>")), lambda v: F.trim(v)))


def normalize_items(items: DataFrame) -> DataFrame:
    """Trimmed and defaulted items with the first validation ``error`` (NULL when good).

    ``items``: item_key (unique) and the fields of ``ITEM``, or rows that this function has returned; absent
    columns count as missing values.
    """
    for field in ITEM.split(", "):
        name, kind = field.split(" ", 1)
        if name not in items.columns:
            items = items.withColumn(name, F.lit(None).cast(kind))
        elif kind == "string":  # a stored table has dates where a file has text
            items = items.withColumn(name, F.col(name).cast(kind))
    evidence = F.coalesce("evidence", F.lit("unverified"))
    kind = F.coalesce(
        "source_kind", F.when(evidence == "verified_secondary", "independent_media").otherwise("brand_announcement")
    )
    related = F.transform(
        "related_sources", lambda r: r.withField("url", canonical_url(r["url"]))
    )
    staged = items.withColumns(
        {
            "_url": canonical_url(F.col("url")),
            "_published": strict_date(F.col("published_at")),
            "_event_at": strict_date(F.col("event_at")),
            "_related": F.coalesce(related, F.array().cast(RELATED)),
            "evidence": evidence,
            "source_kind": kind,
            "region": F.coalesce("region", F.lit("unknown")),
            "model_feature": F.lit(False),
        }
    )
    error = F.lit(None).cast("string")
    rules: list[tuple[Column, str]] = [(_blank(F.col(name)), f"missing_{name}") for name in REQUIRED]
    rules.append((F.col("_url").isNull(), "invalid_url"))
    lists = ("ingredient_ids", "ingredient_keywords", "brands")
    rules += [(F.coalesce(_has_blank(F.col(name)), F.lit(False)), f"invalid_{name}") for name in lists[:2]]
    nothing = (F.coalesce(F.size("ingredient_ids"), F.lit(0)) <= 0) & (F.coalesce(F.size("ingredient_keywords"), F.lit(0)) <= 0)
    rules.append((nothing, "no_ingredient_association"))
    rules.append((F.coalesce(_has_blank(F.col("brands")), F.lit(False)), "invalid_brands"))
    rules.append((~F.col("evidence").isin(*EVIDENCE), "unknown_evidence"))
    rules.append((~F.col("source_kind").isin(*SOURCE_KINDS), "unknown_source_kind"))
    rules.append(((F.coalesce("published_at", F.lit("")) != "") & F.col("_published").isNull(), "invalid_published_at"))
    rules.append(((F.coalesce("event_at", F.lit("")) != "") & F.col("_event_at").isNull(), "invalid_event_at"))
    rules.append((F.col("retrieved_at").isNull(), "missing_retrieved_at"))
    stamp = F.col("retrieved_at").rlike(ISO_TIMESTAMP) & F.col("retrieved_at").try_cast("timestamp").isNotNull()
    rules.append((~stamp, "invalid_retrieved_at"))
    verified = F.col("evidence").startswith("verified")
    rules += [(verified & _blank(F.col(name)), f"verified_without_{name}") for name in VERIFIED_NOTES]
    rules.append((F.col("id").isNotNull() & _blank(F.col("id")), "invalid_id"))
    rules.append((F.exists("_related", lambda r: r["url"].isNull()), "invalid_related_source"))
    dated = lambda r: (F.coalesce(r["published_at"], F.lit("")) != "") & strict_date(r["published_at"]).isNull()
    rules.append((F.exists("_related", dated), "invalid_related_date"))
    for condition, code in reversed(rules):
        error = F.when(condition, code).otherwise(error)
    return (
        staged.withColumn("error", error)
        .withColumns(
            {
                **{name: F.trim(name) for name in REQUIRED},
                **{name: _clean_list(F.col(name)) for name in lists},
                "url": F.col("_url"),
                "published_at": F.col("_published"),
                "event_at": F.col("_event_at"),
                "related_sources": F.col("_related"),
                "id": F.coalesce("id", F.concat(F.lit("news-"), F.substring(F.sha2("_url", 256), 1, 16))),
            }
        )
        .drop("_url", "_published", "_event_at", "_related")
    )


def associate(items: DataFrame, catalog: DataFrame) -> DataFrame:
    """(item_key, ingredient_id): known explicit ids, and exact term matches. Brands never match.

    ``catalog``: id, keyword, name, aliases. A term or id that very many items name is spread over tasks.
    """
    names = F.concat(F.array("keyword", "name"), F.coalesce("aliases", F.array().cast("array<string>")))
    terms = (
        catalog.select(F.col("id").alias("ingredient_id"), F.explode(names).alias("term"))
        .select("ingredient_id", folded(F.col("term")).alias("term"))
        .filter("term <> ''")
        .distinct()
    )
    named = items.select("item_key", F.explode("ingredient_ids").alias("id"))
    explicit = spread_join(named, catalog.select("id").distinct(), ["id"], "inner").select(
        "item_key", F.col("id").alias("ingredient_id")
    )
    worded = items.select("item_key", F.explode("ingredient_keywords").alias("term")).select(
        "item_key", folded(F.col("term")).alias("term")
    )
    matched = spread_join(worded, terms, ["term"], "inner").select("item_key", "ingredient_id")
    return explicit.unionByName(matched).distinct()


def route_items(
    items: DataFrame, as_of: Column, regions: Sequence[str] = tuple(REGIONS), months: int = NEWS_MONTHS, associated: DataFrame | None = None
) -> DataFrame:
    """Add ``route`` (current, background, excluded) and ``reason``.

    With ``associated`` (from :func:`associate`), items without a catalog ingredient are excluded.
    """
    linked = F.lit(True)
    rows = items
    if associated is not None:
        having = associated.select("item_key").distinct().withColumn("_linked", F.lit(True))
        rows = items.join(having, "item_key", "left")
        linked = F.coalesce("_linked", F.lit(False))
    day = F.col("published_at")
    reason = (
        F.when(F.col("error").isNotNull(), F.col("error"))
        .when(~F.col("region").isin(*regions), "outside_region_or_region_unverified")
        .when(~linked, "ingredient_not_in_catalog")
        .when(F.col("evidence") == "unverified", "source_unverified")
        .when(day > as_of, "future_publication")
    )
    background = F.when(day.isNull(), "undated").when(day < window_start(as_of, months), "outside_window")
    return (
        rows.withColumn("_reason", reason)
        .withColumn("_background", background)
        .withColumn(
            "route",
            F.when(F.col("_reason").isNotNull(), "excluded").when(F.col("_background").isNotNull(), "background").otherwise("current"),
        )
        .withColumn("reason", F.coalesce("_reason", "_background"))
        .drop("_reason", "_background", "_linked")
    )


def item_components(items: DataFrame, keys: Sequence[str] = ("item_key",)) -> DataFrame:
    """(keys, component): items linked, directly or through others, by URL or event id.

    Copies of one (url, event) pair are one edge between two key nodes, so a much copied story adds
    a single edge; items take the component of their URL node.
    """
    url_node = F.concat(F.lit("u:"), "url")
    event_node = F.when(F.coalesce("event_id", F.lit("")) != "", F.concat(F.lit("e:"), "event_id")).otherwise(url_node)
    edges = items.select(url_node.alias("u"), event_node.alias("v")).distinct()
    found = connected_components(edges).withColumnRenamed("node", "_node")
    tagged = items.select(*keys, url_node.alias("_node"))
    return spread_join(tagged, found, ["_node"], "inner").drop("_node")


def lead_order() -> Column:
    """Verified before unverified, independent media first, then earliest date and URL."""
    return F.struct(
        (F.col("evidence") == "unverified").alias("unverified"),
        (F.col("source_kind") != "independent_media").alias("not_independent"),
        F.coalesce(F.col("published_at").cast("string"), F.lit("9999")).alias("published"),
        F.col("url").alias("url"),
        F.col("item_key").alias("item_key"),
    )


def lead_items(items: DataFrame, components: DataFrame) -> DataFrame:
    """One lead per component (by aggregate, not by sorting the group) with its number of items."""
    lead = F.min_by(F.struct(*[c for c in items.columns]), lead_order())
    return (
        items.join(components, "item_key")
        .groupBy("component")
        .agg(lead.alias("_lead"), F.count("*").alias("n_items"))
        .select("component", "n_items", "_lead.*")
    )


def lead_values(items: DataFrame, components: DataFrame, column: str) -> DataFrame:
    """Distinct values of an array column over each component, with the order of first sight.

    ``first_seen`` sorts values as they appear going through the items in lead order.
    """
    rows = items.join(components, "item_key").select("component", lead_order().alias("_o"), F.posexplode(column).alias("_p", "value"))
    return rows.groupBy("component", "value").agg(F.min(F.struct("_o", "_p")).alias("first_seen"))


def lead_related(items: DataFrame, components: DataFrame, leads: DataFrame) -> DataFrame:
    """Other sources of every component, one row per URL, the lead's own URL left out.

    A URL told more than once keeps the last telling: the lead's own list first, then items in order.
    """
    top = leads.select("component", F.col("url").alias("_lead_url"), F.col("item_key").alias("_lead_key"))
    placed = items.join(components, "item_key").join(top, "component")
    own = placed.filter("item_key = _lead_key").select(
        "component", "_lead_url", F.lit(0).alias("_stage"), lead_order().alias("_o"), F.posexplode("related_sources").alias("_p", "_r")
    ).select("component", "_lead_url", "_stage", "_o", "_p", "_r.*")
    rest = placed.filter("item_key <> _lead_key").select(
        "component", "_lead_url", F.lit(1).alias("_stage"), lead_order().alias("_o"), F.lit(0).alias("_p"),
        "title", "url", "source", F.col("published_at").cast("string").alias("published_at"), "evidence", "source_kind",
    )
    fields = ("title", "source", "published_at", "evidence", "source_kind")
    return (
        own.unionByName(rest)
        .filter("url <> _lead_url")
        .groupBy("component", "url")
        .agg(F.max_by(F.struct(*fields), F.struct("_stage", "_o", "_p")).alias("_last"))
        .select("component", "url", "_last.*")
    )


class Digest:
    """News digest of a day: routed items, leads and coverage. Records are validated once and staged."""

    def __init__(self, items: DataFrame, as_of: Column, catalog: DataFrame | None = None, regions: Sequence[str] = tuple(REGIONS), months: int = NEWS_MONTHS):
        self.raw = items
        normal = stage(normalize_items(items), "news")
        good = normal.filter("error is null")
        self.links = associate(good, catalog) if catalog is not None else good.select(
            "item_key", F.explode("ingredient_ids").alias("ingredient_id")
        )
        self.routed = route_items(normal, as_of, regions, months, self.links if catalog is not None else None)

    def side(self, route: str) -> tuple[DataFrame, DataFrame, DataFrame]:
        """(items, components, leads) of ``current`` or ``background`` items."""
        items = stage(self.routed.filter(F.col("route") == route), route)
        components = item_components(items)
        return items, components, lead_items(items, components)

    def coverage(self, items: DataFrame, leads: DataFrame, components: DataFrame) -> DataFrame:
        """One row: shown items, raw records, duplicates removed and distinct ingredients."""
        ingredients = self.links.join(components.select("item_key"), "item_key", "left_semi").agg(
            F.countDistinct("ingredient_id").alias("ingredients")
        )
        return leads.agg(F.count("*").alias("items")).select(
            F.when(F.col("items") > 0, "verified_items_available").otherwise("no_verified_news_in_window").alias("status"),
            "items",
            self.raw.agg(F.count("*").alias("n")).scalar().alias("raw_records"),
            (items.agg(F.count("*").alias("n")).scalar() - F.col("items")).alias("duplicates_removed"),
            ingredients.scalar().alias("ingredients"),
        )


def newest_first(leads: DataFrame) -> DataFrame:
    """Display order: published date and id, both descending; undated last."""
    return leads.orderBy(F.coalesce(F.col("published_at").cast("string"), F.lit("")).desc(), F.col("id").desc())


def merge_store(existing: DataFrame, incoming: DataFrame) -> DataFrame:
    """Upsert by canonical URL; incoming rows win, later rows of one side win over earlier ones."""
    both = existing.withColumn("_side", F.lit(0)).unionByName(incoming.withColumn("_side", F.lit(1)))
    row = F.struct(*existing.columns)
    return both.groupBy("url").agg(F.max_by(row, F.struct("_side", "item_key")).alias("_row")).select("_row.*")


def import_news(existing: DataFrame, incoming: DataFrame) -> DataFrame:
    """Validated merge; a single invalid record refuses the whole import."""
    fresh, kept = stage(normalize_items(incoming), "incoming"), stage(normalize_items(existing), "existing")
    bad = fresh.unionByName(kept).filter("error is not null").select("item_key", "error").first()
    if bad is not None:
        raise ValueError(f"news record {bad['item_key']}: {bad['error']}")
    return merge_store(kept, fresh)


def search_worklist(
    catalog: DataFrame, as_of: Column, regions: Sequence[str] = tuple(REGIONS), languages: Sequence[str] = ("en",)
) -> DataFrame:
    """One web search per ingredient, region, language and brand (or none), one day of slack each side."""
    quoted = lambda c: F.replace(F.trim(c), F.lit('"'), F.lit(""))
    keyword = quoted(F.coalesce(F.nullif("keyword", F.lit("")), F.nullif("name", F.lit("")), F.lit("")))
    brands = F.array_distinct(
        F.transform(
            F.filter(F.coalesce("brands", F.array().cast("array<string>")), lambda b: F.trim(b) != ""),
            lambda b: F.replace(F.trim(b), F.lit('"'), F.lit("")),
        )
    )
    region = F.explode(F.array(*[F.struct(F.lit(k).alias("region"), F.lit(REGIONS[k]).alias("_country")) for k in regions]))
    language = F.explode(F.array(*[F.struct(F.lit(k).alias("language"), F.lit(NEWS_WORDS[k]).alias("_words")) for k in languages]))
    rows = (
        catalog.select(F.col("id").alias("ingredient_id"), keyword.alias("keyword"), brands.alias("_brands"))
        .filter("keyword <> ''")
        .withColumn("brand", F.explode(F.concat(F.array(F.lit(None).cast("string")), "_brands")))
        .withColumn("_r", region)
        .withColumn("_l", language)
        .select("ingredient_id", "keyword", "brand", "_r.*", "_l.*")
    )
    start = window_start(as_of)
    terms = F.concat(F.lit('"'), "keyword", F.lit('"'), F.coalesce(F.concat(F.lit(' "'), "brand", F.lit('"')), F.lit("")))
    return rows.select(
        "ingredient_id",
        "keyword",
        "brand",
        "region",
        "language",
        start.alias("window_start"),
        as_of.alias("window_end"),
        F.concat(
            terms, F.lit(" "), "_country", F.lit(" "), "_words", F.lit(" after:"), F.date_sub(start, 1).cast("string"),
            F.lit(" before:"), F.date_add(as_of, 1).cast("string"),
        ).alias("query"),
    )


def rewindow(items: DataFrame, as_of: Column) -> DataFrame:
    """Report-time split of saved items: unusable links become NULL, undated or old ones background."""
    day = F.substring(F.col("published_at").cast("string"), 1, 10)
    published = strict_date(day)
    inside = published.between(window_start(as_of), as_of)
    return items.withColumns(
        {
            "url": safe_url(F.col("url")),
            "route": F.when(F.coalesce(inside, F.lit(False)), "current").otherwise("background"),
            "background_reason": F.when(published.isNull(), "undated").when(~inside, "outside_window"),
        }
    )
