"""Read side of the usage ledger: roll-ups, rate windows, admissibility and audits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation, Window, functions as F

from weekcast.constants import COUNTED_STATUSES, FINAL_FAILURES, VENDOR_A
from weekcast.operators.scale import previous_value, running_total, spread_join
from weekcast.session import stage

RATE_SECONDS = 60


def counted(status: Column) -> Column:
    return status.isin(*COUNTED_STATUSES)


def hard_limit(project_limit: Column, available: Column, reserve: Column) -> Column:
    return F.least(project_limit, F.greatest(F.lit(0), available - reserve))


def status_rollup(jobs: DataFrame) -> DataFrame:
    """Jobs and units by provider, period and status."""
    return jobs.groupBy("provider", "period", "status").agg(
        F.count("*").alias("jobs"), F.coalesce(F.sum("units"), F.lit(0)).alias("units")
    )


def spent_units(jobs: DataFrame, legacy: DataFrame) -> DataFrame:
    """Counted units per provider and period; legacy reservations count whatever their status."""
    current = jobs.filter(counted(F.col("status"))).select("provider", "period", "units")
    return (
        current.unionByName(legacy.select("provider", "period", "units"))
        .groupBy("provider", "period")
        .agg(F.sum("units").alias("counted_units"))
    )


def budgets(jobs: DataFrame, legacy: DataFrame, quotas: DataFrame) -> DataFrame:
    """Hard limit, counted and remaining units of every quota."""
    limit = hard_limit(F.col("project_limit"), F.col("available"), F.col("reserve"))
    used = F.coalesce("counted_units", F.lit(0))
    return quotas.join(spent_units(jobs, legacy), ["provider", "period"], "left").select(
        "provider",
        "period",
        limit.alias("hard_limit"),
        used.alias("counted_units"),
        F.greatest(F.lit(0), limit - used).alias("remaining"),
        F.greatest(F.lit(0), F.col("available") - used).alias("estimated_remaining_account"),
    )


def recent_calls(events: DataFrame, seconds: int = RATE_SECONDS, counts: Column | None = None) -> DataFrame:
    """Add ``recent``: counted calls of the provider in the last ``seconds`` before each event.

    Earlier calls only, strictly newer than ``ts - seconds``; ``counts`` says which count, by default those of a
    counted ``status``. A provider is cut into blocks of ``seconds`` and each event is handed to the next block
    too, so a busy provider is many tasks. ``events``: provider, ts (TIMESTAMP) and what ``counts`` needs; all
    other columns stay.
    """
    span = seconds * 1_000_000
    timed = events.withColumn("_us", F.unix_micros("ts")).withColumn("_block", F.expr(f"_us div {span}"))
    spread = timed.withColumn("_home", F.explode(F.array("_block", F.col("_block") + 1)))
    near = Window.partitionBy("provider", "_home").orderBy("_us").rangeBetween(-(span - 1), -1)
    taken = counted(F.col("status")) if counts is None else counts
    return spread.withColumn("recent", F.count_if(taken).over(near)).filter("_home = _block").drop("_us", "_block", "_home")


def admissibility(proposals: DataFrame, jobs: DataFrame, legacy: DataFrame, quotas: DataFrame) -> DataFrame:
    """Verdict per proposed call, as if the calls were made one after the other by ``ts`` and ``id``.

    Only calls that are granted take units, count against the rate and make later calls with their key repeats. A
    verdict depends on earlier verdicts only, so the rounds here, which start with every call granted and judge
    all calls by the grants of the round before, settle from the first call on and end at the one consistent answer.
    ``proposals``: id, provider, ts, units, dedupe_key; ``jobs``: provider, ts, period, units, status,
    dedupe_key. ``units_before`` (granted in this run) and ``recent`` are null where no limit had to be looked at.
    """
    limits = quotas.join(spent_units(jobs, legacy), ["provider", "period"], "left").select(
        "provider",
        F.col("period").alias("_period"),
        "per_minute",
        hard_limit(F.col("project_limit"), F.col("available"), F.col("reserve")).alias("hard_limit"),
        F.coalesce("counted_units", F.lit(0)).alias("_spent"),
    )
    existing = jobs.filter(F.col("status") != "failed_before_send").select("dedupe_key").distinct().withColumn("_existing", F.lit(True))
    asked = proposals.withColumn("period", F.date_format("ts", "yyyy-MM")).join(limits, "provider", "left")
    fixed = (
        F.when(F.col("_period").isNull(), "no_quota")
        .when(F.col("units") < 1, "invalid_units")
        .when(F.col("period") != F.col("_period"), "period_expired")
        .when(F.coalesce("_existing", F.lit(False)), "existing_job")
    )
    asked = stage(spread_join(asked, existing, ["dedupe_key"]).withColumn("_fixed", fixed).drop("_existing", "_period"), "proposals")
    known = jobs.filter(counted(F.col("status"))).select("provider", "ts")
    known = stage(known.unionByName(legacy.filter(F.col("provider") == VENDOR_A).select("provider", "ts")), "known-calls")
    known = known.withColumn("_granted", F.lit(True))
    minute = F.date_trunc("minute", "ts")
    open_calls = asked.filter("_fixed is null").drop("_fixed").withColumns({"_granted": F.lit(True), "_minute": minute})
    order, changed = [F.col("ts"), F.col("id")], None
    while changed != 0:
        rated = recent_calls(open_calls.unionByName(known, allowMissingColumns=True), counts=F.col("_granted")).filter("id is not null")
        summed = running_total(rated, ["provider"], "_minute", order, F.when(F.col("_granted"), F.col("units")).otherwise(0), "units_before")
        firsts = open_calls.filter("_granted").groupBy("dedupe_key").agg(F.min(F.struct(*order)).alias("_first"))
        verdict = (
            F.when(F.col("_first") < F.struct(*order), "existing_job")
            .when(F.col("_spent") + F.col("units_before") + F.col("units") > F.col("hard_limit"), "over_limit")
            .when(F.col("recent") >= F.col("per_minute"), "over_rate")
            .otherwise("admissible")
        )
        judged = spread_join(summed, firsts, ["dedupe_key"]).withColumn("verdict", verdict).drop("_first")
        seen = Observation()
        judged = stage(judged.observe(seen, F.count_if(F.col("_granted") != (F.col("verdict") == "admissible")).alias("n")), "verdicts")
        changed = seen.get["n"]
        open_calls = judged.withColumn("_granted", F.col("verdict") == "admissible").drop("verdict", "recent", "units_before")
    shown = ["id", "provider", "period", "units", "units_before", "recent", "verdict"]
    unread = {"verdict": F.col("_fixed"), "units_before": F.lit(None).cast("bigint"), "recent": F.lit(None).cast("bigint")}
    return judged.select(*shown).unionByName(asked.filter("_fixed is not null").withColumns(unread).select(*shown))


def allowed_edges() -> list[tuple[str | None, str]]:
    """Source and target states a job may move between (None: not there yet)."""
    edges = [
        (None, "reserved"),
        ("failed_before_send", "reserved"),
        ("reserved", "calling"),
        ("calling", "received"),
        ("received", "staged"),
        ("failed_invalid_response", "staged"),
        ("staged", "saved"),
        ("reserved", "failed_before_send"),
    ]
    for failure in FINAL_FAILURES:
        if failure != "failed_before_send":
            edges += [(state, failure) for state in ("calling", "received", "staged", "saved")]
    return edges


def transition_violations(history: DataFrame) -> DataFrame:
    """Job events that follow an event they may not follow.

    ``history``: job_id, event_id, ts, status. Each job is cut into days, so an endless job is no hot task.
    """
    dated = history.withColumn("_day", F.to_date("ts"))
    order = [F.col("ts"), F.col("event_id")]
    stepped = previous_value(dated, ["job_id"], "_day", order, "status", "previous")
    allowed = F.lit(False)
    for source, target in allowed_edges():
        before = F.col("previous").isNull() if source is None else F.col("previous") == source
        allowed = allowed | F.coalesce(before & (F.col("status") == target), F.lit(False))
    return stepped.filter(~allowed).select("job_id", "event_id", "ts", "previous", "status")


def verify_stored(jobs: DataFrame, files: DataFrame) -> DataFrame:
    """Saved jobs against their files: ``verified``, or ``corrupt`` when missing or different.

    ``files``: path and content (binary or text).
    """
    hashes = files.select(F.col("path").alias("destination"), F.sha2("content", 256).alias("_sha"))
    saved = jobs.filter(F.col("status") == "saved")
    same = F.coalesce(F.col("_sha") == F.col("response_sha256"), F.lit(False))
    return saved.join(hashes, "destination", "left").select(
        "id", "destination", F.when(same, "verified").otherwise("corrupt").alias("outcome")
    )
