"""Relational helpers that keep hot groups out of a single task.

Ranking, running totals and quantiles over one huge group are split here by value range or by
time block, so that no task ever holds a whole group.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from weekcast.session import shared_folder, stage

#: A key is hot from this share of all rows on, so a list of hot keys has at most as many entries.
SHARES = 256


def spread_join(
    facts: DataFrame,
    lookup: DataFrame,
    on: Sequence[str],
    how: str = "left",
    counts: DataFrame | None = None,
    rows: int | None = None,
) -> DataFrame:
    """Join many rows per key to one row per key; a key with over 1/256 of all rows becomes several tasks.

    Each hot key gets as many parts as it has shares of 1/256, so no part is larger than a share, whatever
    the size. Only hot keys are salted, and only their lookup rows are copied. Rows with a null key never
    match and are spread too. The list of hot keys is broadcast: it has fewer than 256 entries. ``counts``
    (``on``, ``_n``) and ``rows`` may give the number of rows per key and in all where they are known already.
    """
    if counts is None:
        counts = facts.groupBy(*on).agg(F.count("*").alias("_n"))
    if rows is None:
        rows = facts.count()
    share = max(1, -(-rows // SHARES))
    hot = F.broadcast(counts.filter(F.col("_n") > share).select(*on, F.ceil(F.col("_n") / share).cast("int").alias("_parts")))
    missing = F.lit(False)
    for c in on:
        missing = missing | F.col(c).isNull()
    parts = F.when(missing, SHARES).otherwise(F.coalesce("_parts", F.lit(1)))
    spot = F.pmod(F.xxhash64(*[F.col(c) for c in facts.columns]), parts).cast("int")
    salted = facts.join(hot, list(on), "left").withColumn("_salt", spot).drop("_parts")
    places = F.sequence(F.lit(0), F.coalesce("_parts", F.lit(1)) - 1)
    copies = lookup.join(hot, list(on), "left").withColumn("_salt", F.explode(places)).drop("_parts")
    return salted.join(copies, [*on, "_salt"], how).drop("_salt")


def global_index(df: DataFrame, *order: Column, name: str = "position") -> DataFrame:
    """0-based position in a total order, without sorting everything in one task.

    Rows are range-partitioned once and checkpointed with their partition number, so counts and
    rows always come from the same split. ``order`` must identify a row.
    """
    shared_folder(df.sparkSession)
    split = df.repartitionByRange(*order).withColumn("_part", F.spark_partition_id()).checkpoint()
    sizes = split.groupBy("_part").agg(F.count("*").alias("_size"))
    # One row per partition: bounded by the shuffle width, so a single-task window is fine.
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select("_part", F.coalesce(F.sum("_size").over(before), F.lit(0)).alias("_offset"))
    inner = Window.partitionBy("_part").orderBy(*order)
    return (
        split.withColumn("_row", F.row_number().over(inner))
        .join(F.broadcast(offsets), "_part")
        .withColumn(name, (F.col("_offset") + F.col("_row") - 1).cast("bigint"))
        .drop("_part", "_row", "_offset")
    )


def running_total(
    df: DataFrame, keys: Sequence[str], block: str, order: Sequence[Column], amount: Column, name: str
) -> DataFrame:
    """Sum of ``amount`` over all earlier rows of the key (the row itself excluded).

    Each key is cut into ``block``s (an existing column that follows the order): totals of earlier
    blocks come from a small table, only the rest is summed inside a block.
    """
    full = [*keys, block]
    totals = df.groupBy(*full).agg(F.sum(amount).alias("_block_total"))
    earlier = Window.partitionBy(*keys).orderBy(block).rowsBetween(Window.unboundedPreceding, -1)
    starts = totals.select(*full, F.coalesce(F.sum("_block_total").over(earlier), F.lit(0)).alias("_start"))
    inside = Window.partitionBy(*full).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    return (
        df.withColumn("_inside", F.coalesce(F.sum(amount).over(inside), F.lit(0)))
        .join(starts, full)
        .withColumn(name, F.col("_start") + F.col("_inside"))
        .drop("_start", "_inside")
    )


def previous_value(
    df: DataFrame, keys: Sequence[str], block: str, order: Sequence[Column], value: str, name: str
) -> DataFrame:
    """Value of the previous row of the key; a row's predecessor may lie in an earlier block."""
    full = [*keys, block]
    inside = Window.partitionBy(*full).orderBy(*order)
    last = df.groupBy(*full).agg(F.max_by(value, F.struct(*order)).alias("_last"))
    across = Window.partitionBy(*keys).orderBy(block)
    carried = last.select(*full, F.lag("_last").over(across).alias("_carried"))
    return (
        df.withColumn("_first", F.row_number().over(inside) == 1)
        .withColumn("_near", F.lag(value).over(inside))
        .join(carried, full)
        .withColumn(name, F.when(F.col("_first"), F.col("_carried")).otherwise(F.col("_near")))
        .drop("_first", "_near", "_carried")
    )


def _bracketed_quantiles(
    df: DataFrame, keys: Sequence[str], value: str, probabilities: Sequence[float], accuracy: int, margin: float
) -> DataFrame:
    """``keys``, ``probability``, ``quantile``, ``n`` and whether the brackets held the wanted ranks (``sound``)."""
    marks = [p for q in probabilities for p in (max(0.0, q - margin), min(1.0, q + margin))]
    sketch = df.groupBy(*keys).agg(
        F.count(value).alias("n"), F.percentile_approx(value, F.array(*map(F.lit, marks)), accuracy).alias("_marks")
    )
    brackets = F.array(
        *[
            F.struct(F.lit(float(q)).alias("probability"), F.col("_marks")[2 * i].alias("low"), F.col("_marks")[2 * i + 1].alias("high"))
            for i, q in enumerate(probabilities)
        ]
    )
    side = F.when(F.col("_v") < F.col("low"), -1).when(F.col("_v") > F.col("high"), 1).otherwise(0)
    # Values below and above a bracket are one row each, with the value next to the bracket.
    counted = (
        df.select(*keys, F.col(value).cast("double").alias("_v"))
        .filter("_v is not null")
        .join(F.broadcast(sketch.select(*keys, "n", brackets.alias("_brackets"))), list(keys))
        .select(*keys, "n", "_v", F.inline("_brackets"))
        .groupBy(*keys, "probability", "n", side.alias("_side"), F.when(side == 0, F.col("_v")).alias("_inside"))
        .agg(F.count("*").alias("_c"), F.min("_v").alias("_min"), F.max("_v").alias("_max"))
        .withColumn("_v", F.when(F.col("_side") < 0, F.col("_max")).otherwise(F.col("_min")))
    )
    order = Window.partitionBy(*keys, "probability").orderBy("_v").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    ranked = counted.withColumn("_cum", F.sum("_c").over(order))
    place = F.col("probability") * (F.col("n") - 1)
    low_rank, high_rank = F.floor(place) + 1, F.ceil(place) + 1
    picked = ranked.groupBy(*keys, "probability", "n").agg(
        F.min(F.when(F.col("_cum") >= low_rank, F.col("_v"))).alias("_low"),
        F.min(F.when(F.col("_cum") >= high_rank, F.col("_v"))).alias("_high"),
        F.max(F.when(F.col("_side") < 0, F.col("_cum")).otherwise(0)).alias("_below"),
        F.max(F.when(F.col("_side") <= 0, F.col("_cum")).otherwise(0)).alias("_to"),
    )
    sound = (low_rank >= F.col("_below")) & (high_rank <= F.col("_to") + 1)
    quantile = F.col("_low") + (F.col("_high") - F.col("_low")) * (place - F.floor(place))
    return picked.select(*keys, "probability", quantile.alias("quantile"), "n", sound.alias("sound"))


def exact_quantiles(
    df: DataFrame, keys: Sequence[str], value: str, probabilities: Sequence[float], accuracy: int = 10_000
) -> DataFrame:
    """Exact linearly interpolated quantiles for a few keys with arbitrarily many rows each.

    Output: ``keys``, ``probability``, ``quantile``, ``n``. A rank sketch brackets every wanted
    order statistic; rows outside a bracket are only counted, and equal values inside it are counted
    together, so the ranking window sees about n * 10 / accuracy values at most. A bracket that misses
    its rank is widened and tried again; groups of any size take the same way.

    The number of distinct ``keys`` must be small and fixed (it is broadcast).
    """
    margin = 5 / accuracy
    while True:
        found = stage(_bracketed_quantiles(df, keys, value, probabilities, accuracy, margin), "quantiles")
        if margin >= 1 or found.filter("not sound").isEmpty():
            return found.drop("sound")
        margin *= 10
