import numpy as np
import pandas as pd
import pytest
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from weekcast import session
from weekcast.operators import scale
from weekcast.operators.components import connected_components


@pytest.mark.parametrize("accuracy", [10_000, 40, 3])
def test_exact_quantiles_match_numpy(spark, accuracy):
    """One group with many values, one that is half one value, small groups; coarse sketches must be widened."""
    rng = np.random.default_rng(1)
    parts = {"a": rng.normal(size=30_000), "b": np.concatenate([rng.integers(0, 5, 15_000), np.full(15_000, 3)]), "c": [7.5], "d": [1, 2], "e": range(11)}
    frame = pd.DataFrame([(g, float(v)) for g, values in parts.items() for v in values], columns=["g", "v"])
    got = scale.exact_quantiles(spark.createDataFrame(frame), ["g"], "v", (0.0, 0.1, 0.5, 0.9, 1.0), accuracy).collect()
    assert len(got) == 25
    for row in got:
        assert row["quantile"] == pytest.approx(np.quantile(frame.v[frame.g == row["g"]], row["probability"]))


def test_staged_tables_can_be_released(spark):
    session.release_staged(spark)
    kept = session.work_path(spark, "kept")
    spark.range(3).write.parquet(kept)
    tables = [session.stage(spark.range(n), "some") for n in (4, 5)]
    assert [t.count() for t in tables] == [4, 5]
    assert session.release_staged(spark) == 2 and session.release_staged(spark) == 0
    assert spark.read.parquet(kept).count() == 3
    with pytest.raises(Exception, match="(?i)not.exist|not_found|no such file"):
        spark.read.parquet(tables[0].inputFiles()[0]).count()


def test_staged_tables_have_few_files(spark):
    """Many small partitions share files; before, each made one."""
    staged = session.stage(spark.range(0, 1000, 1, 211), "some")
    assert len(staged.inputFiles()) <= session.FILES_PER_CORE * spark.sparkContext.defaultParallelism
    assert sorted(r.id for r in staged.collect()) == list(range(1000))
    session.release_staged(spark)


def test_global_index_is_a_dense_total_order(spark):
    df = spark.range(5000).select(F.xxhash64("id").alias("k"), "id").repartition(7)
    rows = scale.global_index(df, F.col("k")).orderBy("position").collect()
    assert [r["position"] for r in rows] == list(range(5000))
    assert [r["k"] for r in rows] == sorted(r["k"] for r in rows)


@pytest.mark.parametrize("how", ["left", "inner"])
def test_spread_join_with_a_hot_and_a_null_key(spark, how):
    """Half of all rows have one key, a sixth have none."""
    key = F.when(F.col("id") % 2 == 0, 0).when(F.col("id") % 3 == 0, None).otherwise(F.col("id"))
    facts = spark.range(9000).select(key.alias("k"), "id")
    lookup = spark.range(9000).select(F.col("id").alias("k"), (F.col("id") * 2).alias("w")).filter("k % 5 <> 1")
    plain = facts.join(lookup, "k", how)
    spread = scale.spread_join(facts, lookup, ["k"], how)
    assert spread.exceptAll(plain).count() == 0 and spread.count() == plain.count()


def test_running_total_and_previous_value_cross_blocks(spark):
    rows = [("a", d, i, (i * 7) % 5) for d in range(4) for i in range(d * 10, d * 10 + 10) if d != 2]
    df = spark.createDataFrame(rows, "k string, day int, t int, x int")
    got = scale.running_total(df, ["k"], "day", [F.col("t")], F.col("x"), "before").orderBy("t").collect()
    total = 0
    for r in got:
        assert r["before"] == total
        total += r["x"]
    seen = scale.previous_value(df, ["k"], "day", [F.col("t")], "x", "prev").orderBy("t").collect()
    assert [r["prev"] for r in seen] == [None, *[r["x"] for r in seen[:-1]]]


def components_by_hand(edges):
    parent = {}

    def find(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for u, v in edges:
        a, b = find(u), find(v)
        parent[max(a, b)] = min(a, b)
    return {x: find(x) for x in list(parent)}


@settings(max_examples=4, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 40), st.integers(0, 40)), min_size=1, max_size=45))
def test_components_equal_union_find(spark, edges):
    named = [(f"{u:03d}", f"{v:03d}") for u, v in edges]
    got = {r["node"]: r["component"] for r in connected_components(spark.createDataFrame(named, "u string, v string")).collect()}
    assert got == components_by_hand(named)


def test_components_of_a_long_chain_and_a_star(spark):
    chain = [(f"a{i:04d}", f"a{i + 1:04d}") for i in range(300)]
    star = [("b0000", f"b{i:04d}") for i in range(1, 500)]
    got = connected_components(spark.createDataFrame(chain + star, "u string, v string")).collect()
    assert {r["component"] for r in got} == {"a0000", "b0000"} and len(got) == 801
