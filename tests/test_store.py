"""Versions of tables, imports that are refused whole, and panels that grow by changed weeks."""

import datetime as dt
import json

import pandas as pd
import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from weekcast.plans import raw_testbed as R
from weekcast.session import work_path
from weekcast.sources import envelopes as E, versions as V
from weekcast.streaming.increments import _changes, current_weeks

DAY = dt.datetime(2026, 1, 1, tzinfo=dt.timezone.utc)


def test_a_version_is_seen_whole_or_not_at_all(spark, tmp_path):
    path = str(tmp_path)
    assert V.read_newest(spark, path, "a") == {}
    V.publish({"x": spark.range(3), "empty": spark.range(0)}, path, "a", "one", DAY)
    V.publish({"x": spark.range(9)}, path, "b", "other", DAY + dt.timedelta(days=2))
    bad = spark.range(5).withColumn("id", F.raise_error(F.lit("lost")).cast("long"))
    with pytest.raises(PySparkException):
        V.publish({"x": spark.range(4), "y": bad}, path, "a", "two", DAY + dt.timedelta(days=1))
    seen = V.read_newest(spark, path, "a")
    assert {name: t.count() for name, t in seen.items()} == {"x": 3, "empty": 0}
    assert {(r.owner, r.version, r.table, r.rows) for r in V.versions(spark, path).collect()} == {("a", "one", "x", 3), ("a", "one", "empty", 0), ("b", "other", "x", 9)}


class Held:
    """Stands in for the state of one group."""

    exists, get = False, None

    def update(self, value):
        self.exists, self.get = True, value


def land(state, *files):
    part = pd.DataFrame([(*f[:3], json.dumps(f[3])) for f in files], columns=["snapshot", "priority", "path", "weeks"])
    return [tuple(r) for frame in _changes(("i",), [part], state) for r in frame[["change", "week_end", "searches", "gone"]].itertuples(index=False)]


def test_only_changed_weeks_come_out():
    one, two = "2026-01-03", "2026-01-10"
    state, day = Held(), lambda text: dt.date.fromisoformat(text)
    assert land(state, ("2026-02-01", 1, "p", {one: ["5", "1"], two: ["6", "1"]})) == [(1, day(one), "5", False), (1, day(two), "6", False)]
    assert land(state, ("2026-01-15", 0, "older", {one: ["9", "1"]})) == []
    assert land(state, ("2026-02-01", 1, "p", {one: ["5", "1"], two: ["6", "1"]})) == []
    assert land(state, ("2026-02-01", 0, "a", {one: ["5", "1"], two: ["7", "1"]})) == [(2, day(two), "7", False)]
    assert land(state, ("2026-03-01", 0, "b", {two: ["7", "1"]})) == [(3, day(one), None, True)]


def test_last_change_of_a_week_counts(spark):
    rows = [("i", 1, dt.date(2026, 1, 3), "5", "1", False), ("i", 3, dt.date(2026, 1, 3), None, None, True), ("i", 2, dt.date(2026, 1, 10), "7", "1", False)]
    changes = spark.createDataFrame(rows, "ingredient_id string, change long, week_end date, searches string, rank string, gone boolean")
    assert [(r.week_end, r.searches) for r in current_weeks(changes).collect()] == [(dt.date(2026, 1, 10), "7")]


def test_losing_files_are_not_opened(spark, tmp_path):
    names = ["sellersprite/US/b #1+/amazon/2026-01-01", "US/b #1+/amazon/sellersprite/2026-01-02", "US/b #1+/amazon/undated", "sellersprite/US/b #1+/google/2026-01-01", "sellersprite/US/b #1+/amazon/2026-03-01", "US/b #1+/notes"]
    for name in names:
        file = tmp_path / "data/raw" / f"{name}.json"
        file.parent.mkdir(parents=True, exist_ok=True)
        file.write_text("{}")
    read = E.read_raw(spark, str(tmp_path), "sellersprite", "amazon", dt.date(2026, 2, 1))
    assert sorted(r.path.split("data/raw/")[1] for r in read.collect()) == sorted(f"{n}.json" for n in names[:3])
    assert E.list_raw(spark, str(tmp_path)).count() == 6


def test_items_of_batches_do_not_read_the_sales_again(spark, monkeypatch):
    """A stream joins the items anew in each micro-batch, so they must not be made from the sales each time."""
    day = dt.date(2001, 7, 8)
    sales = spark.createDataFrame([(f"Brand#{n}", day, 5.0 * n, 1.0) for n in (11, 12, 16)], "ingredient_id string, week_end date, searches double, rank double")
    sales.write.parquet(sales_path := work_path(spark, "sales"))
    monkeypatch.setattr(R.T, "sales_b", lambda session, folder: session.read.parquet(sales_path))
    batches, items = R.vendor_b_batches(spark, "none")
    assert not [f for t in (batches, items) for f in t.inputFiles() if sales_path in f]
    assert {(r.batch_id, r.id) for r in items.collect()} == {(2, "Brand#11"), (2, "Brand#12"), (3, "Brand#16")}
    assert {r.batch_id: len(r.keywords) for r in batches.collect()} == {2: 2, 3: 1}
