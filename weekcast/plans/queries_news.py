"""News queries: orders as dated items that share URLs and event ids, pages for links, parts for searches."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from weekcast.constants import REGIONS
from weekcast.functions.dates import window_start
from weekcast.functions.text import canonical_url, slug
from weekcast.operators import news as W
from weekcast.plans import testbed as T
from weekcast.plans.registry import plain, query
from weekcast.session import stage

NEWS_AS_OF = dt.date(2001, 5, 31)
CUT = "DATE '2001-05-31'"


def items(spark, folder):
    """Orders as news items with faults, tracked links, shared events and related sources."""
    key, cust = F.col("o_orderkey"), F.col("o_custkey")
    text = lambda c: c.cast("string")
    priority = F.substring("o_orderpriority", 1, 1)
    region = (
        F.when(priority == "1", "US").when(priority == "2", "CA").when(priority == "3", "MX").when(priority == "4", "GB")
    )
    evidence = F.when(F.col("o_orderstatus") == "F", "verified_primary").when(F.col("o_orderstatus") == "O", "verified_secondary").otherwise("unverified")
    url = F.when(key % 50 == 7, "ftp://files.example.com/x").otherwise(
        F.concat(F.lit("https://News.example.com/c/"), text(cust), F.lit("?utm_source=t"), text(key % 3), F.lit("&id="), text(cust % 7))
    )
    related = F.array(
        F.struct(
            F.lit("other").alias("title"), F.concat(F.lit("https://other.example.com/"), text(key % 5), F.lit("/")).alias("url"),
            F.lit("Other").alias("source"), F.lit("2001-05-01").alias("published_at"),
            F.lit("unverified").alias("evidence"), F.lit("official").alias("source_kind"),
        )
    )
    brand = cust % 30 + 1
    return T.table(spark, folder, "orders").select(
        F.lpad(text(key), 12, "0").alias("item_key"),
        F.concat(F.lit("n"), text(key)).alias("id"),
        F.when(key % 97 == 5, " ").otherwise(F.concat(F.lit(" Title "), text(key))).alias("title"),
        url.alias("url"),
        F.lit("Publisher").alias("source"),
        F.lit("Summary").alias("summary"),
        F.lit("Announcement").alias("category"),
        F.lit("Direct mention").alias("relevance_note"),
        region.alias("region"),
        evidence.alias("evidence"),
        F.when(key % 4 == 0, "independent_media").when(key % 4 == 1, "research").alias("source_kind"),
        F.when(key % 89 != 4, "date on page").alias("date_evidence"),
        F.lit("market named").alias("region_evidence"),
        F.lit("opened").alias("verification_note"),
        F.when(key % 7 == 0, F.concat(F.lit("ev"), F.floor(key / 49).cast("string"))).alias("event_id"),
        F.when(key % 11 != 3, F.date_format("o_orderdate", "yyyy-MM-dd")).alias("published_at"),
        F.lit("2001-08-01T00:00:00Z").alias("retrieved_at"),
        F.when(key % 3 == 0, F.array(F.concat(F.lit("Brand#"), text(brand)))).alias("ingredient_ids"),
        F.array(F.concat(F.lit(" BRAND#"), text(cust % 26 + 1))).alias("ingredient_keywords"),
        F.array(F.concat(F.lit("b"), text(key % 4)), F.concat(F.lit("b"), text(cust % 3))).alias("brands"),
        F.when(key % 13 == 0, related).alias("related_sources"),
    )


def catalog(spark, folder):
    brands = T.table(spark, folder, "part").select(F.col("p_brand").alias("id")).distinct()
    return brands.select("id", F.lower("id").alias("keyword"), F.lit(None).cast("string").alias("name"), F.array("id").alias("aliases"))


def digest(spark, folder):
    return W.Digest(items(spark, folder), F.lit(NEWS_AS_OF), catalog(spark, folder))


_ITEMS_SQL = f"""brands AS (SELECT DISTINCT p_brand AS id FROM part),
items AS (SELECT lpad(CAST(o_orderkey AS VARCHAR), 12, '0') AS item_key, 'n' || o_orderkey AS id, o_orderkey AS k, o_custkey AS c,
  'https://news.example.com/c/' || o_custkey || '?id=' || (o_custkey % 7) AS url,
  CASE o_orderpriority[1] WHEN '1' THEN 'US' WHEN '2' THEN 'CA' WHEN '3' THEN 'MX' WHEN '4' THEN 'GB' ELSE 'unknown' END AS region,
  CASE o_orderstatus WHEN 'F' THEN 'verified_primary' WHEN 'O' THEN 'verified_secondary' ELSE 'unverified' END AS evidence,
  CASE o_orderkey % 4 WHEN 0 THEN 'independent_media' WHEN 1 THEN 'research' ELSE CASE o_orderstatus WHEN 'O' THEN 'independent_media' ELSE 'brand_announcement' END END AS source_kind,
  CASE WHEN o_orderkey % 7 = 0 THEN 'ev' || (o_orderkey // 49) END AS event_id,
  CASE WHEN o_orderkey % 11 <> 3 THEN CAST(o_orderdate AS DATE) END AS published_at,
  CASE WHEN o_orderkey % 97 = 5 THEN 'missing_title' WHEN o_orderkey % 50 = 7 THEN 'invalid_url'
       WHEN o_orderstatus <> 'P' AND o_orderkey % 89 = 4 THEN 'verified_without_date_evidence' END AS error FROM orders),
links AS (SELECT item_key, 'Brand#' || (c % 30 + 1) AS ingredient_id FROM items WHERE error IS NULL AND k % 3 = 0 AND 'Brand#' || (c % 30 + 1) IN (SELECT id FROM brands)
  UNION SELECT item_key, 'Brand#' || (c % 26 + 1) FROM items WHERE error IS NULL AND 'Brand#' || (c % 26 + 1) IN (SELECT id FROM brands)),
judged AS (SELECT *, CASE WHEN error IS NOT NULL THEN error WHEN region NOT IN ('US', 'CA', 'MX') THEN 'outside_region_or_region_unverified'
    WHEN item_key NOT IN (SELECT item_key FROM links) THEN 'ingredient_not_in_catalog' WHEN evidence = 'unverified' THEN 'source_unverified'
    WHEN published_at > {CUT} THEN 'future_publication' END AS excluded,
  CASE WHEN published_at IS NULL THEN 'undated' WHEN published_at < DATE '2001-02-28' THEN 'outside_window' END AS background FROM items),
routed AS (SELECT *, CASE WHEN excluded IS NOT NULL THEN 'excluded' WHEN background IS NOT NULL THEN 'background' ELSE 'current' END AS route,
  coalesce(excluded, background) AS reason FROM judged)"""


def _components_sql(source: str) -> str:
    """CTEs nodes and labelled (item_key, component) over the rows of ``source``."""
    return f"""node_edges AS (SELECT DISTINCT 'u:' || url AS u, CASE WHEN event_id IS NULL THEN 'u:' || url ELSE 'e:' || event_id END AS v FROM {source}),
both_ways AS (SELECT u, v FROM node_edges UNION SELECT v, u FROM node_edges),
reach AS (SELECT u AS node, u AS other FROM both_ways UNION SELECT r.node, b.v FROM reach r JOIN both_ways b ON b.u = r.other),
labels AS (SELECT node, min(other) AS component FROM reach GROUP BY 1),
labelled AS (SELECT s.*, l.component FROM {source} s JOIN labels l ON l.node = 'u:' || s.url)"""


_GOOD = "good AS (SELECT * FROM items WHERE error IS NULL)"
_CURRENT = "cur AS (SELECT * FROM routed WHERE route = 'current')"
_ORDER = "(evidence = 'unverified', source_kind <> 'independent_media', coalesce(CAST(published_at AS VARCHAR), '9999'), url, item_key)"


@query(
    "canonical_url",
    """WITH forms AS (SELECT page_id, url AS raw, 0 AS form FROM pages
        UNION ALL SELECT page_id, replace(split_part(url, '#', 1), 'http', 'HTTP') || CASE WHEN contains(url, '?') THEN '&' ELSE '?' END || 'z=1&utm_medium=x&a=b+c%20d&FBCLID=1&e=~*&blank=#frag', 1 FROM pages
        UNION ALL SELECT page_id, replace(url, '://', '://user:pw@'), 2 FROM pages
        UNION ALL SELECT page_id, 'ftp' || url, 3 FROM pages),
      parts AS (SELECT *, lower(regexp_extract(raw, '^([A-Za-z]+)://([^/?#]*)([^?#]*)(\\?([^#]*))?', 1)) AS scheme, lower(regexp_extract(raw, '^([A-Za-z]+)://([^/?#]*)([^?#]*)(\\?([^#]*))?', 2)) AS host,
        rtrim(regexp_extract(raw, '^([A-Za-z]+)://([^/?#]*)([^?#]*)(\\?([^#]*))?', 3), '/') AS path, regexp_extract(raw, '^([A-Za-z]+)://([^/?#]*)([^?#]*)(\\?([^#]*))?', 5) AS qs FROM forms),
      pairs AS (SELECT page_id, form, unnest(string_split(qs, '&')) AS p FROM parts),
      named AS (SELECT page_id, form, url_decode(replace(split_part(p, '=', 1), '+', ' ')) AS name, url_decode(replace(CASE WHEN contains(p, '=') THEN substr(p, strpos(p, '=') + 1) ELSE '' END, '+', ' ')) AS value FROM pairs WHERE p <> ''),
      joined AS (SELECT page_id, form, string_agg(replace(url_encode(name), '%20', '+') || '=' || replace(url_encode(value), '%20', '+'), '&' ORDER BY name, value) AS q
        FROM named WHERE NOT starts_with(lower(name), 'utm_') AND lower(name) NOT IN ('fbclid', 'gclid', 'mc_cid', 'mc_eid') GROUP BY 1, 2)
      SELECT page_id, CAST(form AS BIGINT) AS form, CASE WHEN scheme IN ('http', 'https') AND NOT contains(host, '@') THEN
        scheme || '://' || host || CASE WHEN path = '' THEN '/' ELSE path END || coalesce('?' || q, '') END AS url FROM parts LEFT JOIN joined USING (page_id, form)""",
)
def canonical_url_query(spark, folder):
    """Links without tracking, sorted and encoded alike; unacceptable ones NULL."""
    url = F.col("url")
    tracked = F.concat(
        F.replace(F.substring_index(url, "#", 1), F.lit("http"), F.lit("HTTP")),
        F.when(F.contains(url, F.lit("?")), "&").otherwise("?"),
        F.lit("z=1&utm_medium=x&a=b+c%20d&FBCLID=1&e=~*&blank=#frag"),
    )
    forms = [url, tracked, F.replace(url, F.lit("://"), F.lit("://user:pw@")), F.concat(F.lit("ftp"), url)]
    shapes = F.posexplode(F.array(*forms)).alias("form", "raw")
    return T.table(spark, folder, "pages").select("page_id", shapes).select("page_id", "form", canonical_url(F.col("raw")).alias("url"))


@query("news_window", plain(f"SELECT DISTINCT CAST(o_orderdate AS DATE) AS as_of, CAST(CAST(o_orderdate AS DATE) - INTERVAL 3 MONTH AS DATE) AS window_start FROM orders", ("as_of", "window_start")))
def news_window(spark, folder):
    """Trailing calendar months with clipped month ends."""
    days = T.table(spark, folder, "orders").select(F.to_date("o_orderdate").alias("as_of")).distinct()
    return days.withColumn("window_start", window_start(F.col("as_of")))


@query("news_validation", f"WITH {_ITEMS_SQL} SELECT item_key, id, CASE WHEN error IS DISTINCT FROM 'invalid_url' AND NOT (k % 50 = 7) THEN url END AS url, region, evidence, source_kind, error FROM items")
def news_validation(spark, folder):
    """Normalised records with their first error."""
    return W.normalize_items(items(spark, folder)).select("item_key", "id", "url", "region", "evidence", "source_kind", "error")


@query("news_association", f"WITH {_ITEMS_SQL} SELECT item_key, ingredient_id FROM links")
def news_association(spark, folder):
    """Explicit known ids and exact term matches."""
    return digest(spark, folder).links


@query("news_routes", f"WITH {_ITEMS_SQL} SELECT item_key, route, reason FROM routed")
def news_routes(spark, folder):
    """Current, background or excluded, and why."""
    return digest(spark, folder).routed.select("item_key", "route", "reason")


@query("news_components", f"WITH RECURSIVE {_ITEMS_SQL}, {_GOOD}, {_components_sql('good')} SELECT item_key, component FROM labelled")
def news_components(spark, folder):
    """Items joined through shared links or events, over any number of steps."""
    good = stage(W.normalize_items(items(spark, folder)), "news").filter("error is null")
    return W.item_components(good)


@query(
    "news_leads",
    f"""WITH RECURSIVE {_ITEMS_SQL}, {_CURRENT}, {_components_sql('cur')} SELECT component, count(*) AS n_items, arg_min(id, {_ORDER}) AS id,
      arg_min(source_kind, {_ORDER}) AS source_kind, CAST(arg_min(published_at, {_ORDER}) AS VARCHAR) AS published_at FROM labelled GROUP BY 1""",
)
def news_leads(spark, folder):
    """The lead record of every current story."""
    leads = digest(spark, folder).side("current")[2]
    return leads.select("component", "n_items", "id", "source_kind", "published_at")


@query(
    "news_related",
    f"""WITH RECURSIVE {_ITEMS_SQL}, {_CURRENT}, {_components_sql('cur')},
      lead AS (SELECT component, arg_min(url, {_ORDER}) AS lead_url, arg_min(item_key, {_ORDER}) AS lead_key FROM labelled GROUP BY 1)
      SELECT component, url FROM labelled JOIN lead USING (component) WHERE url <> lead_url
      UNION SELECT component, 'https://other.example.com/' || (k % 5) || '' FROM labelled JOIN lead USING (component) WHERE item_key = lead_key AND k % 13 = 0""",
)
def news_related(spark, folder):
    """Further sources of every current story."""
    current, components, leads = digest(spark, folder).side("current")
    return W.lead_related(current, components, leads).select("component", "url")


@query(
    "news_brands",
    f"""WITH RECURSIVE {_ITEMS_SQL}, {_CURRENT}, {_components_sql('cur')},
      each AS (SELECT component, unnest(['b' || (k % 4), 'b' || (c % 3)]) AS value FROM labelled) SELECT DISTINCT component, value FROM each""",
)
def news_brands(spark, folder):
    """Union of the brands of a story."""
    current, components, _ = digest(spark, folder).side("current")
    return W.lead_values(current, components, "brands").select("component", "value")


@query(
    "news_coverage",
    f"""WITH RECURSIVE {_ITEMS_SQL}, {_CURRENT}, {_components_sql('cur')} SELECT 'verified_items_available' AS status, count(DISTINCT component) AS items,
      (SELECT count(*) FROM items) AS raw_records, count(*) - count(DISTINCT component) AS duplicates_removed,
      (SELECT count(DISTINCT ingredient_id) FROM links WHERE item_key IN (SELECT item_key FROM cur)) AS ingredients FROM labelled""",
)
def news_coverage(spark, folder):
    """Coverage of a digest."""
    made = digest(spark, folder)
    current, components, leads = made.side("current")
    return made.coverage(current, leads, components)


@query(
    "news_upsert",
    f"""WITH {_ITEMS_SQL} SELECT url, arg_max(id, (CASE evidence WHEN 'verified_primary' THEN 0 ELSE 1 END, item_key)) AS id FROM items WHERE error IS NULL GROUP BY 1""",
)
def news_upsert(spark, folder):
    """Store keyed by canonical link, incoming records win."""
    good = stage(W.normalize_items(items(spark, folder)), "news").filter("error is null")
    first = F.col("evidence") == "verified_primary"
    return W.merge_store(good.filter(first), good.filter(~first)).select("url", "id")


@query(
    "news_rewindow",
    f"""WITH {_ITEMS_SQL} SELECT item_key, CASE WHEN k % 50 <> 7 THEN 'https://News.example.com/c/' || c || '?utm_source=t' || (k % 3) || '&id=' || (c % 7) END AS url,
      CASE WHEN published_at BETWEEN DATE '2001-02-28' AND {CUT} THEN 'current' ELSE 'background' END AS route,
      CASE WHEN published_at IS NULL THEN 'undated' WHEN NOT published_at BETWEEN DATE '2001-02-28' AND {CUT} THEN 'outside_window' END AS background_reason FROM items""",
)
def news_rewindow(spark, folder):
    """Saved items split again at report time."""
    return W.rewindow(items(spark, folder), F.lit(NEWS_AS_OF)).select("item_key", "url", "route", "background_reason")


def search_catalog(spark, folder):
    part = T.table(spark, folder, "part")
    return part.groupBy("p_name").agg(F.array_sort(F.collect_set(F.concat("p_brand", F.lit('"')))).alias("brands")).select(
        slug(F.col("p_name")).alias("id"), F.col("p_name").alias("keyword"), F.col("p_name").alias("name"), "brands"
    )


@query(
    "search_worklist",
    f"""WITH named AS (SELECT p_name, unnest([NULL] || list(DISTINCT p_brand)) AS brand FROM part GROUP BY p_name),
      regions(region, country) AS (VALUES {', '.join(f"('{k}', '{v}')" for k, v in REGIONS.items())}),
      languages(language, words) AS (VALUES ('en', 'news launch research announcement'), ('es', 'noticias lanzamiento investigación comunicado'))
      SELECT replace(p_name, ' ', '-') AS ingredient_id, p_name AS keyword, brand, region, language, '2001-02-28' AS window_start, '2001-05-31' AS window_end,
        '"' || p_name || '"' || coalesce(' "' || brand || '"', '') || ' ' || country || ' ' || words || ' after:2001-02-27 before:2001-06-01' AS query
      FROM named CROSS JOIN regions CROSS JOIN languages""",
)
def search_worklist(spark, folder):
    """Searches per ingredient, region, language and brand."""
    return W.search_worklist(search_catalog(spark, folder), F.lit(NEWS_AS_OF), languages=("en", "es"))
