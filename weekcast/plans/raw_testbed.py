"""Raw vendor files written out of the driver tables, with every kind of fault at known places.

The brand number decides which faults an ingredient's files get, so the expected outcome is a rule.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from weekcast.constants import VENDOR_A, VENDOR_B
from weekcast.plans import testbed as T
from weekcast.session import stage

RAW_AS_OF = dt.date(2001, 8, 5)


def brand_number(name: str = "ingredient_id") -> Column:
    return F.substring(F.col(name), 7, 9).cast("int")


def catalog(spark: SparkSession, folder: str) -> DataFrame:
    """Catalog of brands: reviewed terms for some, two brand numbers not selected."""
    brands = T.table(spark, folder, "part").select(F.col("p_brand").alias("id")).distinct()
    number = brand_number("id")
    terms = F.create_map(
        F.lit(VENDOR_A), F.concat(F.lit("term a "), number.cast("string")),
        F.lit(VENDOR_B), F.concat(F.lit("Term B "), number.cast("string")),
    )
    return brands.select(
        "id",
        F.col("id").alias("family_id"),
        F.lower("id").alias("keyword"),
        F.concat(F.lit("cn "), "id").alias("name_cn"),
        F.when(number % 4 == 0, terms).otherwise(F.create_map().cast("map<string,string>")).alias("queries"),
        ((number % 13) != 12).alias("selected"),
    )


def _term(provider: str) -> Column:
    number = brand_number()
    own = "term a " if provider == VENDOR_A else "Term B "
    return F.when(number % 4 == 0, F.concat(F.lit(own), number.cast("string"))).otherwise(F.lower("ingredient_id"))


def _wrap(result: Column) -> Column:
    """Result as the JSON text of a content block."""
    block = F.struct(F.lit("text").alias("type"), result.alias("text"))
    return F.to_json(F.struct(F.array(block).alias("content")))


def _file(source: Column, tool: str, request: Column, fetched: Column, result: Column) -> Column:
    """Envelope text; ``request`` and ``result`` are JSON texts put in unquoted."""
    head = F.to_json(F.struct(source.alias("source"), F.lit(tool).alias("tool"), fetched.alias("fetched_at")))
    return F.concat(
        F.regexp_replace(head, r"\}$", ""), F.lit(',"request":'), request, F.lit(',"result":'), result, F.lit("}")
    )


def vendor_a_files(spark: SparkSession, folder: str) -> DataFrame:
    """Six Amazon files per brand: good, outranked, newer, too new, broken and failed."""
    number = brand_number()
    sales = T.sales_a(spark, folder)
    row = F.struct(
        F.date_format("week_end", "yyyyMMdd").alias("label"),
        F.col("searches").cast("bigint").alias("searches"),
        F.col("rank").cast("bigint").alias("rank"),
    )
    # One row per week of the calendar in each list.
    history = sales.groupBy("ingredient_id").agg(F.sort_array(F.collect_list(row)).alias("rows"))
    own = F.concat(F.lit(f"data/raw/{VENDOR_A}/US/"), "ingredient_id", F.lit("/amazon/"))
    old = F.concat(F.lit("data/raw/US/"), "ingredient_id", F.lit("/amazon/"))
    places = [
        (1, own, "2001-07-30-a"),
        (2, old, "2001-07-30-b"),
        (3, own, "2001-08-03"),
        (4, own, "2001-08-20"),
        (5, own, "2001-08-04"),
        (6, own, "2001-08-04-c"),
    ]
    copies = F.explode(
        F.array(*[F.struct(F.lit(n).alias("copy"), F.concat(at, F.lit(f"{stem}.json")).alias("path")) for n, at, stem in places])
    )
    moved = F.transform(
        "rows",
        lambda r: F.struct(r["label"].alias("label"), (r["searches"] + F.col("copy")).alias("searches"), r["rank"].alias("rank")),
    )
    friday = F.array(F.struct(F.lit("20010727").alias("label"), F.lit(1).cast("bigint").alias("searches"), F.lit(1).cast("bigint").alias("rank")))
    listed = history.withColumn("_c", copies).select("ingredient_id", "rows", "_c.copy", "_c.path")
    rows = F.when(number % 11 == 5, F.concat(moved, friday)).when(number % 7 == 6, F.concat(moved, F.slice(moved, 1, 1))).otherwise(moved)
    body = F.to_json(F.struct(F.when(F.col("copy") == 6, "ERROR").otherwise("OK").alias("code"), rows.alias("data")))
    keyword = F.when((F.col("copy") == 3) & (number % 3 == 0), "something else").otherwise(_term(VENDOR_A))
    request = F.to_json(F.struct(keyword.alias("keyword"), F.lit("US").alias("marketplace"), F.lit("W").alias("timeGranularity")))
    source = F.when(F.col("copy") == 2, "").otherwise(VENDOR_A)
    result = F.when(number % 2 == 0, _wrap(body)).otherwise(body)
    text = _file(source, "aba_research_trend", request, F.lit("2001-08-01T00:00:00Z"), result)
    return listed.select(
        "path", F.when(F.col("copy") == 5, F.substring(text, 1, 60)).otherwise(text).alias("text")
    )


def trend_files(spark: SparkSession, folder: str) -> DataFrame:
    """One trend file per brand; some have a label that is not a Sunday."""
    number = brand_number()
    points = T.trend(T.sales_a(spark, folder)).withColumn("start", F.date_sub("week_end", 6))
    item = F.struct((F.unix_date("start").cast("bigint") * 86400000).alias("time"), "value")
    history = points.groupBy("ingredient_id").agg(F.sort_array(F.collect_list(item)).alias("items"))
    monday = F.transform(F.slice("items", 1, 1), lambda x: F.struct((x["time"] + 86400000).alias("time"), x["value"].alias("value")))
    items = F.when(number % 5 == 4, F.concat("items", monday)).otherwise(F.col("items"))
    data = F.struct(_term(VENDOR_A).alias("keyword"), F.lit("US").alias("marketplace"), items.alias("items"))
    inner = F.struct(
        _term(VENDOR_A).alias("keyword"), F.lit("US").alias("marketplace"), F.lit("web").alias("googleProp"), F.lit(False).alias("monthly")
    )
    text = _file(
        F.lit(VENDOR_A), "google_trend", F.to_json(F.struct(inner.alias("request"))), F.lit("2001-08-01T00:00:00Z"),
        F.to_json(F.struct(F.lit("OK").alias("code"), data.alias("data"))),
    )
    path = F.concat(F.lit(f"data/raw/{VENDOR_A}/US/"), "ingredient_id", F.lit("/google/2001-08-01.json"))
    return history.select(path.alias("path"), text.alias("text"))


def vendor_b_rows(spark: SparkSession, folder: str) -> DataFrame:
    """Vendor B observations in delivery order, with repeats, Saturday copies and faults by brand number."""
    number = brand_number()
    sales = T.sales_b(spark, folder).filter(F.col("week_end") < F.lit(RAW_AS_OF))
    by_week = Window.partitionBy("ingredient_id").orderBy("week_end")
    base = sales.select(
        "ingredient_id",
        (F.row_number().over(by_week) * 10).alias("pos"),
        F.date_sub("week_end", 6).alias("day"),
        F.col("searches").cast("bigint").alias("volume"),
        F.col("rank").cast("bigint").alias("rank"),
    )
    same = lambda shift, day, volume: F.struct((F.col("pos") + shift).alias("pos"), day.alias("day"), volume.alias("volume"), F.col("rank").alias("rank"))
    day, volume, few = F.col("day"), F.col("volume"), number <= 10
    extra = F.array(
        F.when((number % 6 == 1) & (F.col("pos") == 10), same(1, day, volume)),
        F.when((number % 6 == 2) & (F.col("pos") == 30), same(-1, F.date_sub(day, 1), volume)),
        F.when(few & (number % 6 == 3) & (F.col("pos") == 20), same(1, day, volume + 1)),
        F.when(few & (number % 6 == 4) & (F.col("pos") == 20), same(1, F.date_add(day, 3), volume)),
        F.when(few & (number % 9 == 4) & (F.col("pos") == 10), same(1000000, day, volume)),
    )
    copies = base.withColumn("_x", F.explode(F.filter(extra, lambda x: x.isNotNull()))).select("ingredient_id", "_x.*")
    return base.unionByName(copies)


def vendor_b_entries(spark: SparkSession, folder: str) -> DataFrame:
    """Vendor B histories as parallel arrays with ``latest``; some have a wrong latest volume."""
    number = brand_number()
    rows = vendor_b_rows(spark, folder)
    packed = rows.groupBy("ingredient_id").agg(F.sort_array(F.collect_list(F.struct("pos", "day", "volume", "rank"))).alias("r"))
    tail = F.element_at("r", -1)
    return packed.select(
        "ingredient_id",
        _term(VENDOR_B).alias("keyword"),
        F.transform("r", lambda x: x["day"].cast("string")).alias("dates"),
        F.transform("r", lambda x: x["volume"].cast("string")).alias("volumes"),
        F.transform("r", lambda x: x["rank"].cast("string")).alias("ranks"),
        F.struct(
            tail["day"].cast("string").alias("date"),
            (tail["volume"] + F.when((number <= 10) & (number % 6 == 5), 1).otherwise(0)).cast("string").alias("volume"),
            tail["rank"].cast("string").alias("rank"),
        ).alias("latest"),
    )


def vendor_b_files(spark: SparkSession, folder: str) -> DataFrame:
    """Vendor B envelopes, one per brand, some only at the migration place."""
    number = brand_number()
    entries = vendor_b_entries(spark, folder)
    entry = F.struct("keyword", "dates", "volumes", "ranks")
    body = F.struct(F.lit("US").alias("country"), F.lit("week").alias("granularity"), F.array(entry).alias("keywords"))
    request = F.to_json(
        F.struct(F.array("keyword").alias("keywords"), F.lit("US").alias("country"), F.lit("week").alias("granularity"))
    )
    text = _file(F.lit(VENDOR_B), "market_get_keyword_history", request, F.when(number % 8 == 7, "").otherwise("2001-08-01"), F.to_json(body))
    path = F.when(
        number % 8 == 7, F.concat(F.lit("data/raw/US/_sif_envelopes_all/"), "ingredient_id", F.lit(".json"))
    ).otherwise(F.concat(F.lit(f"data/raw/{VENDOR_B}/US/"), "ingredient_id", F.lit("/amazon/2001-08-01-x.json")))
    return entries.select(path.alias("path"), text.alias("text"))


def landed_vendor_a(spark: SparkSession, folder: str) -> DataFrame:
    """Landed vendor A responses (ingredient_id, result), one brand in five of each fault."""
    number = brand_number()
    sales = T.sales_a(spark, folder)
    label = F.date_format("week_end", "yyyyMMdd")
    row = F.struct(
        F.when(number % 5 == 2, F.substring(label, 1, 7)).otherwise(label).alias("label"),
        F.col("searches").cast("bigint").cast("string").alias("searches"),
        F.when(number % 5 != 3, F.col("rank").cast("bigint").cast("string")).alias("rank"),
    )
    history = sales.groupBy("ingredient_id").agg(F.sort_array(F.collect_list(row)).alias("rows"))
    rows = F.when(number % 5 == 1, F.slice("rows", 1, 0)).when(number % 7 == 6, F.concat("rows", F.slice("rows", 1, 1))).otherwise(F.col("rows"))
    body = F.to_json(F.struct(F.when(number % 5 == 0, "LIMIT").otherwise("OK").alias("code"), rows.alias("data")))
    return history.select("ingredient_id", F.size(rows).alias("n_rows"), _wrap(body).alias("result"))


def vendor_b_batches(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    """(batches, items): brands in groups of five by number; batch 3 answers one keyword too few.

    Both come from the same written entries, for a stream reads the items again with each micro-batch.
    """
    entries = stage(vendor_b_entries(spark, folder), "vendor-b-entries").withColumn("batch_id", F.floor((brand_number() - 1) / 5).cast("int"))
    entry = F.struct("keyword", "dates", "volumes", "ranks", "latest")
    # At most five histories per batch.
    grouped = entries.groupBy("batch_id").agg(
        F.sort_array(F.collect_list(entry)).alias("answers"), F.array_sort(F.collect_list(F.upper("keyword"))).alias("keywords")
    )
    answers = F.when(F.col("batch_id") == 3, F.slice("answers", F.lit(2), F.size("answers"))).otherwise(F.col("answers"))
    body = F.to_json(F.struct(F.lit("US").alias("country"), F.lit("week").alias("granularity"), answers.alias("keywords")))
    batches = grouped.select("batch_id", "keywords", _wrap(body).alias("result"))
    return batches, entries.select("batch_id", F.col("ingredient_id").alias("id"), "keyword")
