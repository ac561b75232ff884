"""Raw vendor envelopes: scan, parse, date, identify and pick the newest valid one.

Every envelope is parsed once, in its own row. Only the winner per (ingredient, kind) is shuffled
with its payload; picking it is an aggregate with map-side combine, so an ingredient with very many
snapshots is no hot task.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from weekcast.constants import (
    MARKETPLACE,
    VENDOR_A,
    VENDOR_A_TOOLS,
    VENDOR_B,
    VENDOR_B_TOOLS,
)
from weekcast.functions.dates import epoch_ms_date, is_sunday, strict_date
from weekcast.operators.histories import panel_entries, vendor_a_history

ENVELOPE = (
    "source string, tool string, request string, fetched_at string, result string, provenance string, "
    "collection_run_id string, collection_job_id string, _corrupt string"
)
RESULT = "code string, message string, data string, isError boolean, content array<struct<type:string,text:string>>"
SECOND_BODY = (
    "country string, granularity string, keywords array<struct<keyword:string,dates:array<string>,"
    "volumes:array<string>,ranks:array<string>,latest:struct<date:string,volume:string,rank:string>>>"
)


def layout(path: Column, provider: str) -> Column:
    """(ingredient_id, kind, priority) of a file path, NULL if it is none of the provider's places."""
    spots = [
        (rf"/?data/raw/{provider}/US/([^/]+)/([^/]+)/[^/]+\.json$", 0),
        (rf"/?data/raw/US/([^/]+)/([^/]+)/{provider}/[^/]+\.json$", 1),
        (r"/?data/raw/US/([^/]+)/([^/]+)/[^/]+\.json$", 2),
    ]
    found = F.lit(None).cast("struct<ingredient_id:string,kind:string,priority:int>")
    if provider == VENDOR_B:
        migrated = r"/?data/raw/US/_sif_envelopes_all/([^/]+)\.json$"
        found = F.when(path.rlike(migrated), _spot(F.regexp_extract(path, migrated, 1), F.lit("amazon"), 3)).otherwise(found)
    for pattern, priority in reversed(spots):
        spot = _spot(F.regexp_extract(path, pattern, 1), F.regexp_extract(path, pattern, 2), priority)
        found = F.when(path.rlike(pattern), spot).otherwise(found)
    return found


def _spot(ingredient: Column, kind: Column, priority: int) -> Column:
    return F.struct(ingredient.alias("ingredient_id"), kind.alias("kind"), F.lit(priority).alias("priority"))


def _exists(spark: SparkSession, path: str) -> bool:
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark._jsc.hadoopConfiguration()).exists(place)


def _raw_places(spark: SparkSession, root: str) -> list[str]:
    """Spark's scan passes over folders that start with an underscore, so the migration folder is named."""
    raw = f"{root.rstrip('/')}/data/raw"
    migrated = f"{raw}/US/_sif_envelopes_all"
    return [raw, *([migrated] if _exists(spark, migrated) else [])]


def file_day(path: Column) -> Column:
    """Date at the front of a file name, or NULL."""
    return strict_date(F.substring(F.regexp_extract(path, r"([^/]+)\.json$", 1), 1, 10))


def list_raw(spark: SparkSession, root: str) -> DataFrame:
    """(path, bytes, modified) of all JSON files below ``root``/data/raw; no file is opened."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.json").load(_raw_places(spark, root))
    return files.select("path", F.col("length").alias("bytes"), F.col("modificationTime").alias("modified"))


def read_raw(spark: SparkSession, root: str, provider: str | None = None, kind: str | None = None, as_of: dt.date | None = None) -> DataFrame:
    """JSON files below ``root``/data/raw as (path, text).

    With ``provider``, ``kind`` or ``as_of`` only files that can win are opened: the scan drops the others by their
    path, while it lists files. A name without a date may have any.
    """
    files = spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", "*.json").text(_raw_places(spark, root), wholetext=True)
    # The scan gives paths as in a URL, in which a plus sign stands for itself.
    path = F.try_url_decode(F.replace(F.col("_metadata.file_path"), F.lit("+"), F.lit("%2B")))
    if provider is not None:
        files = files.filter(layout(path, provider).isNotNull())
    if provider is not None and kind is not None:
        files = files.filter(layout(path, provider)["kind"] == kind)
    if as_of is not None:
        files = files.filter(F.coalesce(file_day(path) <= F.lit(as_of), F.lit(True)))
    return files.select(path.alias("path"), F.col("value").alias("text"))


def envelope_provider(source: Column, tool: Column) -> Column:
    """Explicit source wins, else the tool tells, else NULL."""
    return F.coalesce(
        F.nullif(F.lower(source), F.lit("")),
        F.when(tool.isin(*VENDOR_B_TOOLS), VENDOR_B),
        F.when(tool.isin(*VENDOR_A_TOOLS.values()), VENDOR_A),
    )


def parse_envelopes(raw: DataFrame, provider: str) -> DataFrame:
    """(path, text) to one row per readable envelope of ``provider`` at one of its places."""
    placed = raw.withColumn("_place", layout(F.col("path"), provider)).filter("_place is not null")
    parsed = placed.withColumn(
        "_e", F.from_json("text", ENVELOPE, {"columnNameOfCorruptRecord": "_corrupt", "mode": "PERMISSIVE"})
    )
    return (
        parsed.filter("_e is not null and _e._corrupt is null")
        .select("path", "_place", "_e.*")
        .select("path", "_place.*", *[c.split()[0] for c in ENVELOPE.split(", ") if "_corrupt" not in c])
        .withColumn("provider", envelope_provider(F.col("source"), F.col("tool")))
        .filter(F.col("provider") == provider)
    )


def snapshot_date(path: Column, fetched_at: Column, provider: Column, labels: Column) -> Column:
    """Date in the file name, else of the fetch, else (vendor B) a week after the last label."""
    newest = F.array_max(labels)
    return F.coalesce(
        file_day(path),
        strict_date(F.substring(fetched_at, 1, 10)),
        F.when(provider == VENDOR_B, F.date_add(strict_date(newest), 7)),
    )


def unwrap(envelopes: DataFrame) -> DataFrame:
    """Add ``payload`` (JSON text) and ``payload_error``: direct results or JSON text inside content."""
    outer = F.from_json("result", RESULT)
    text = F.get(F.filter(F.col("_r.content"), lambda block: block["type"] == "text"), F.lit(0))["text"]
    inner = F.from_json("_text", "code string, message string, data string")
    return (
        envelopes.withColumn("_r", outer)
        .withColumn("_text", F.when(F.col("_r.code").isNull(), text))
        .withColumn("_b", inner)
        .withColumn("_code", F.coalesce("_r.code", "_b.code"))
        .withColumn(
            "payload_error",
            F.when(F.col("_r.code").isNull() & F.coalesce("_r.isError", F.lit(False)), "tool_error")
            .when(F.col("_r.code").isNull() & F.col("_text").isNull(), "no_text_content")
            .when(F.coalesce("_code", F.lit("")) != "OK", "provider_failure"),
        )
        .withColumn("payload", F.when(F.col("payload_error").isNull(), F.coalesce("_r.data", "_b.data")))
        .drop("_r", "_b", "_text", "_code")
    )


def query_term(queries: Column, keyword: Column, provider: str) -> Column:
    """Reviewed search term of a provider, else the keyword."""
    return F.coalesce(F.nullif(F.try_element_at(queries, F.lit(provider)), F.lit("")), keyword)


def _request_is(request: Column, expected: dict[str, Column]) -> Column:
    fields = F.from_json(request, "map<string,string>")
    same = F.size(fields) == len(expected)
    for name, value in expected.items():
        same = same & (F.try_element_at(fields, F.lit(name)) == value)
    return F.coalesce(same, F.lit(False))


def check_vendor_a(envelopes: DataFrame, kind: str) -> DataFrame:
    """Identity check of vendor A envelopes joined with their catalog ``term``; adds ``error``."""
    term = F.col("term")
    if kind == "amazon":
        request_ok = _request_is(
            F.col("request"),
            {"keyword": term, "marketplace": F.lit(MARKETPLACE), "timeGranularity": F.lit("W")},
        )
        body_ok = F.lit(True)
    else:
        nested = F.try_element_at(F.from_json("request", "map<string,string>"), F.lit("request"))
        request_ok = (F.size(F.from_json("request", "map<string,string>")) == 1) & _request_is(
            nested,
            {
                "keyword": term,
                "marketplace": F.lit(MARKETPLACE),
                "googleProp": F.lit("web"),
                "monthly": F.lit("false"),
            },
        )
        body = F.from_json("payload", "keyword string, marketplace string")
        body_ok = F.coalesce((F.lower(body["keyword"]) == F.lower(term)) & (body["marketplace"] == MARKETPLACE), F.lit(False))
    identity = F.coalesce(request_ok & (F.col("tool") == VENDOR_A_TOOLS[kind]), F.lit(False))
    return unwrap(envelopes).withColumn(
        "error",
        F.when(~identity, "identity_mismatch").when(F.col("payload_error").isNotNull(), F.col("payload_error")).when(
            ~body_ok, "payload_identity_mismatch"
        ),
    )


def check_vendor_b(envelopes: DataFrame) -> DataFrame:
    """Identity and history check of vendor B envelopes joined with their ``term``; adds ``error`` and ``history``."""
    term = F.lower(F.col("term"))
    request = F.from_json("request", "keywords array<string>, country string, granularity string")
    parsed = envelopes.withColumn("_q", request).withColumn("_body", F.from_json("result", SECOND_BODY))
    matches = F.filter("_body.keywords", lambda entry: F.lower(entry["keyword"]) == term)
    identity = (
        F.col("tool").isin(*VENDOR_B_TOOLS)
        & (F.col("_q.country") == MARKETPLACE)
        & (F.col("_q.granularity") == "week")
        & F.array_contains(F.transform("_q.keywords", F.lower), term)
        & (F.col("_body.country") == MARKETPLACE)
        & (F.col("_body.granularity") == "week")
    )
    picked = parsed.withColumn("_matches", matches).withColumn("_entry", F.get("_matches", F.lit(0)))
    checked = panel_entries(
        picked.withColumns({"dates": F.col("_entry.dates"), "volumes": F.col("_entry.volumes"), "ranks": F.col("_entry.ranks")})
    )
    error = (
        F.when(~F.coalesce(identity, F.lit(False)), "identity_mismatch")
        .when(F.coalesce(F.size("_matches"), F.lit(0)) != 1, "not_exactly_one_entry")
        .otherwise(F.col("entry_error"))
    )
    return checked.withColumn("error", error).drop(
        "_q", "_body", "_matches", "_entry", "dates", "volumes", "ranks", "entry_error"
    )


def candidates(raw: DataFrame, catalog: DataFrame, kind: str, provider: str) -> DataFrame:
    """Envelopes of selected catalog entries with snapshot date, history and validity.

    ``catalog``: id, keyword, queries, selected. Adds ``error`` (NULL when valid) and, for Amazon kinds,
    ``history``; for trends ``items``.
    """
    labels = F.flatten(F.transform(F.from_json("result", SECOND_BODY)["keywords"], lambda e: e["dates"]))
    dated = (
        parse_envelopes(raw, provider)
        .filter(F.col("kind") == kind)
        .withColumn("snapshot", snapshot_date(F.col("path"), F.col("fetched_at"), F.col("provider"), labels))
        .filter("snapshot is not null")
    )
    terms = catalog.filter("selected").select(
        F.col("id").alias("ingredient_id"), query_term(F.col("queries"), F.col("keyword"), provider).alias("term")
    )
    joined = dated.join(terms, "ingredient_id")
    if provider == VENDOR_B:
        return check_vendor_b(joined).drop("payload", "payload_error")
    checked = check_vendor_a(joined, kind)
    if kind == "amazon":
        return checked.withColumn("history", vendor_a_history(F.col("payload"))).drop("payload", "payload_error")
    items = F.transform(
        F.from_json("payload", "items array<struct<time:bigint,value:string>>")["items"],
        lambda x: F.struct(epoch_ms_date(x["time"]).alias("start"), x["value"].alias("value")),
    )
    return checked.withColumn("items", items).drop("payload", "payload_error")


def latest_files(found: DataFrame, as_of: Column) -> DataFrame:
    """(ingredient_id, path) of the newest valid envelope: latest snapshot, then best place, then greatest path.

    Only these keys are shuffled and compared, whatever else ``found`` has.
    """
    usable = found.filter(F.col("error").isNull() & (F.col("snapshot") <= as_of))
    order = F.struct("snapshot", -F.col("priority"), "path")
    return usable.groupBy("ingredient_id").agg(F.max(order).alias("_best")).select("ingredient_id", F.col("_best.path").alias("path"))


def latest_valid(found: DataFrame, as_of: Column) -> DataFrame:
    """Newest valid envelope per ingredient with its payload, which is joined to the winners' keys."""
    return found.join(latest_files(found, as_of), ["ingredient_id", "path"], "left_semi")


def trend_problem(items: Column, as_of: Column) -> Column:
    """Why a trend history cannot be used, else NULL."""
    starts = F.transform(items, lambda x: x["start"])
    done = F.filter(starts, lambda s: F.date_add(s, 6) < as_of)
    return F.when(
        F.exists(starts, lambda s: ~F.coalesce(is_sunday(s), F.lit(False))), "trend_not_sunday"
    ).when(F.size(F.array_distinct(done)) < F.size(done), "trend_duplicate_weeks")
