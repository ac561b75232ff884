import datetime as dt
import json

import pytest
from pyspark.sql import functions as F

from weekcast.constants import VENDOR_A, VENDOR_B
from weekcast.functions.hashing import sorted_json
from weekcast.operators import planning as N
from weekcast.operators.histories import normalize_entries
from weekcast.plans.dataset import assemble_panel
from weekcast.sources import landing as L
from weekcast.sources.envelopes import candidates, latest_valid, read_raw

AS_OF = dt.date(2024, 3, 13)
LAST_WEEK = dt.date(2024, 3, 9)
WEEKS = 16
SATURDAYS = [LAST_WEEK - dt.timedelta(weeks=WEEKS - 1 - w) for w in range(WEEKS)]
NAMES = ["oat", "rye", "teff", "spelt", "millet", "quinoa", "barley", "sorghum", "emmer"]


def searches_of(i, w):
    return 1000 * (i + 1) + 7 * w


def trend_of(i, w):
    return (11 * i + 3 * w) % 101


def is_gap(i, w):
    """Every fifth week of a series is missing, at another place in each; never the first or last."""
    return 0 < w < WEEKS - 1 and (w + i) % 5 == 0


def put(root, path, value):
    target = root / path
    target.parent.mkdir(parents=True, exist_ok=True)
    target.write_text(value if isinstance(value, str) else json.dumps(value), encoding="utf-8")


def ms(day):
    return int(dt.datetime.combine(day, dt.time(), dt.timezone.utc).timestamp() * 1000)


@pytest.fixture
def catalog(spark):
    return spark.createDataFrame(
        [(n, f"grains-{n[0]}", f"{n} flour", f"cn {n}", {}, True) for n in NAMES],
        "id string, family_id string, keyword string, name_cn string, queries map<string,string>, selected boolean",
    )


def amazon_file(root, i, rows=None, day="2024-03-12", **request):
    """Weekly history of ingredient ``i`` from vendor A, with gaps, and one week that isn't over."""
    if rows is None:
        weeks = [w for w in range(WEEKS + 1) if not is_gap(i, w)]
        rows = [(LAST_WEEK + dt.timedelta(weeks=w - WEEKS + 1), searches_of(i, w), w + 1) for w in weeks]
    put(root, f"data/raw/US/{NAMES[i]}/amazon/{day}.json", {
        "tool": "aba_research_trend", "fetched_at": f"{day}T06:30:00Z",
        "request": {"keyword": f"{NAMES[i]} flour", "marketplace": "US", "timeGranularity": "W", **request},
        "result": {"code": "OK", "data": [{"label": f"{d:%Y%m%d}", "searches": v, "rank": r} for d, v, r in rows]},
    })


def trend_file(root, i, **request):
    """Sunday-dated interest of ingredient ``i``: the week that ends on Saturday w has ``trend_of(i, w)``."""
    keyword = f"{NAMES[i]} flour"
    points = [{"time": ms(d - dt.timedelta(days=6)), "value": trend_of(i, w)} for w, d in enumerate(SATURDAYS)]
    put(root, f"data/raw/US/{NAMES[i]}/google/2024-03-12.json", {
        "tool": "google_trend", "fetched_at": "2024-03-12T06:31:00Z",
        "request": {"request": {"keyword": keyword, "marketplace": "US", "monthly": False, "googleProp": "web", **request}},
        "result": {"code": "OK", "data": {"keyword": keyword, "marketplace": "US", "items": points}},
    })


def vendor_b_file(root, i, days=None, volumes=None, ranks=None, path=None, **top):
    """Sunday-dated history of ingredient ``i`` from vendor B; ``keywords``, ``country``, ``granularity`` change the request."""
    days = days or [d - dt.timedelta(days=6) for d in SATURDAYS]
    volumes = volumes or [searches_of(i, w) for w in range(len(days))]
    request = {"keywords": [f"{NAMES[i]} flour"], "country": "US", "granularity": "week"}
    request |= {k: top.pop(k) for k in list(top) if k in request}
    body = {"keyword": f"{NAMES[i]} flour", "dates": [str(d) for d in days], "volumes": volumes, "ranks": ranks or [w + 1 for w in range(len(days))]}
    put(root, path or f"data/raw/US/{NAMES[i]}/amazon/2024-03-12.json", {
        "source": "sif", "tool": "market_get_keyword_history", "fetched_at": "2024-03-12", **top, "request": request,
        "result": {"country": "US", "granularity": "week", "keywords": [body]},
    })


def panel_of(spark, root, catalog, provider=VENDOR_A, as_of=AS_OF):
    made = assemble_panel(read_raw(spark, str(root)), catalog, as_of, provider)
    rows = {(r["ingredient_id"], r["week_end"]): (r["searches"], r["rank"], r["google_trend"]) for r in made.panel.collect()}
    return made, rows


def test_panels_are_dense_lagged_and_end_with_the_last_whole_week(spark, tmp_path, catalog):
    for i in range(4):
        amazon_file(tmp_path, i)
        trend_file(tmp_path, i)
    put(tmp_path, "data/raw/US/oat/amazon/2024-03-13.json", '{"tool": ')
    made, rows = panel_of(spark, tmp_path, catalog)
    want = {}
    for i in range(4):
        for w, day in enumerate(SATURDAYS):
            known = (None, None) if is_gap(i, w) else (float(searches_of(i, w)), float(w + 1))
            want[NAMES[i], day] = (*known, float(trend_of(i, w - 1)) if w else None)
    assert rows == want
    gaps = {NAMES[i]: sum(is_gap(i, w) for w in range(WEEKS)) for i in range(4)}
    assert {r["ingredient_id"]: (r["weeks"], r["missing_amazon"], r["missing_google"]) for r in made.quality.filter("weeks > 0").collect()} == {n: (WEEKS, g, 1) for n, g in gaps.items()}
    assert made.inputs.groupBy("dataset").count().collect() == made.inputs.groupBy("dataset").count().filter("count = 4").collect()
    assert made.manifest.first()["rows"] == 4 * WEEKS


def test_trend_counts_only_for_the_right_request(spark, tmp_path, catalog):
    faults = [{}, {"monthly": True}, {"googleProp": "news"}, {"keyword": "wheat flour"}, {"marketplace": "CA"}]
    for i, fault in enumerate(faults):
        amazon_file(tmp_path, i)
        trend_file(tmp_path, i, **fault)
    _, rows = panel_of(spark, tmp_path, catalog)
    with_trend = {name for (name, _), r in rows.items() if r[2] is not None}
    assert with_trend == {NAMES[0]} and {name for name, _ in rows} == set(NAMES[: len(faults)])


def test_ingredients_without_a_usable_history_are_warned_about(spark, tmp_path, catalog):
    amazon_file(tmp_path, 0)
    amazon_file(tmp_path, 1, keyword="wheat flour")
    amazon_file(tmp_path, 2, rows=[(d + dt.timedelta(days=2), 5, 5) for d in SATURDAYS[:-2]])
    for i in range(3, len(NAMES)):
        amazon_file(tmp_path, i)
    made, rows = panel_of(spark, tmp_path, catalog)
    assert {name for name, _ in rows} == {NAMES[0], *NAMES[3:]}
    told = {(r["ingredient_id"], r["code"]) for r in made.warnings.collect() if r["ingredient_id"] in NAMES[:3]}
    assert {(NAMES[1], "missing_amazon_history"), (NAMES[2], "non_saturday")} <= told


def test_numbers_that_cannot_be_used_become_null(spark, tmp_path, catalog):
    """Each kind of bad value stands in its own week, for searches and rank alike; text digits are numbers."""
    bad = ["-Infinity", "NaN", -1, "n/a", None, "3d", "12f", "0x10", True]
    rows = [(d, bad[w] if w < len(bad) else f"{w}.5", bad[w] if w < len(bad) else f"{w}") for w, d in enumerate(SATURDAYS)]
    amazon_file(tmp_path, 0, rows=rows)
    amazon_file(tmp_path, 1, rows=[(d, 0, 0) for d in SATURDAYS])
    made, rows = panel_of(spark, tmp_path, catalog)
    for w, day in enumerate(SATURDAYS):
        assert rows["oat", day][:2] == ((None, None) if w < len(bad) else (w + 0.5, float(w))), bad[w : w + 1]
        assert rows["rye", day][:2] == (0.0, None)
    assert {r["ingredient_id"]: r["invalid_rank_values"] for r in made.quality.filter("weeks > 0").collect()} == {"oat": len(bad), "rye": WEEKS}


def test_sunday_starts_are_moved_to_their_saturdays(spark, tmp_path, catalog):
    for i in range(3):
        vendor_b_file(tmp_path, i)
    vendor_b_file(tmp_path, 3, tool="sif_market_get_keyword_history", fetched_at="", path="data/raw/US/_sif_envelopes_all/spelt.json")
    made, rows = panel_of(spark, tmp_path, catalog, VENDOR_B)
    assert rows == {(NAMES[i], d): (float(searches_of(i, w)), float(w + 1), None) for i in range(4) for w, d in enumerate(SATURDAYS)}
    assert "secondary_provider_scale" in {r["code"] for r in made.warnings.collect()}
    snapshots = {r["ingredient_id"]: r["snapshot"] for r in made.amazon.collect()}
    assert snapshots["oat"] == dt.date(2024, 3, 12) and snapshots["spelt"] == LAST_WEEK + dt.timedelta(days=1)


def test_vendor_b_histories_are_taken_whole_or_not_at_all(spark, tmp_path, catalog):
    """One fault for each ingredient; the first and the last have none, and the last repeats rows that agree."""
    days = [d - dt.timedelta(days=6) for d in SATURDAYS]
    faults = [
        {}, {"source": "sellersprite"}, {"keywords": ["wheat flour"]}, {"country": "FR"}, {"granularity": "day"}, {"volumes": [5] * (WEEKS - 1)},
        {"days": [*days[:-1], days[-2]], "volumes": list(range(WEEKS))}, {"days": [*days[:-2], days[-1], days[-2]]},
        {"days": [*days, days[0], days[5]], "volumes": [8] * (WEEKS + 2), "ranks": [2] * (WEEKS + 2)},
    ]
    for i, fault in enumerate(faults):
        vendor_b_file(tmp_path, i, **fault)
    _, rows = panel_of(spark, tmp_path, catalog, VENDOR_B)
    assert {name for name, _ in rows} == {NAMES[0], NAMES[8]}
    assert len(rows) == 2 * WEEKS and {r[:2] for (name, _), r in rows.items() if name == NAMES[8]} == {(8.0, 2.0)}


def test_newest_valid_file_up_to_the_day_counts(spark, tmp_path, catalog):
    days = [f"2024-03-{d:02d}" for d in range(4, 18)]
    for i in range(3):
        for k, day in enumerate(days):
            wrong = {"keyword": "wheat flour"} if k % (i + 2) else {}
            amazon_file(tmp_path, i, day=day, **wrong)
    found = candidates(read_raw(spark, str(tmp_path)), catalog, "amazon", VENDOR_A)
    got = {r["ingredient_id"]: r["path"].rsplit("/", 1)[-1][:10] for r in latest_valid(found, F.lit(AS_OF)).collect()}
    assert got == {NAMES[i]: max(d for k, d in enumerate(days) if k % (i + 2) == 0 and d <= str(AS_OF)) for i in range(3)}


ENTRY = "name string, dates array<string>, volumes array<string>, ranks array<string>, latest struct<date:string,volume:string,rank:string>"


def test_landing_history_rules(spark):
    """Histories made from a run of Sundays by one change each; the expected error and counts follow the change."""
    run = [dt.date(2024, 1, 7) + dt.timedelta(weeks=k) for k in range(6)]

    def history(days, values=None, latest=None):
        return [str(d) for d in days], [str(v) for v in values or range(len(days))], ["4"] * len(days), latest

    eve = run[3] - dt.timedelta(days=1)
    cases = {
        "as it is": (history(run, latest=(str(run[-1]), "5", "4")), None, 0, 0),
        "two weeks given twice": (history(sorted([*run[:2], *run]), [0, 0, 1, 1, 2, 3, 4, 5]), None, 2, 0),
        "eve with the same values": (history([*run[:3], eve, *run[3:]], [0, 1, 2, 3, 3, 4, 5]), None, 0, 1),
        "eve with other values": (history([*run[:3], eve, *run[3:]], [0, 1, 2, 9, 3, 4, 5]), "non_sunday", 0, 0),
        "a week given twice, differing": (history(sorted([*run, run[4]]), [0, 1, 2, 3, 4, 7, 5]), "conflicting_repeat", 1, 0),
        "reversed": (history(run[::-1]), "not_ascending", 0, 0),
        "month first": ((["01/07/2024"], ["1"], ["4"], None), "invalid_date", 0, 0),
        "a value too few": ((*history(run)[:1], ["1"] * 5, ["4"] * 6, None), "length_mismatch", 0, 0),
        "nothing": (history([]), "empty_array", 0, 0),
        "another last value": (history(run, latest=(str(run[-1]), "6", "4")), "latest_mismatch", 0, 0),
    }
    df = spark.createDataFrame([(k, *v[0]) for k, v in cases.items()], ENTRY)
    for row in normalize_entries(df).collect():
        _, error, same, aside = cases[row["name"]]
        assert row["entry_error"] == error, row["name"]
        if error is None:
            assert (row["same_date_duplicates"], row["misaligned_duplicates"]) == (same, aside), row["name"]


def content(body):
    return json.dumps({"content": [{"type": "text", "text": json.dumps(body)}]})


def test_batch_needs_the_exact_keyword_set(spark):
    """Answers to a question for k names: complete in any case and order, one short, one too many, one twice, no body."""
    asked = NAMES[:5]
    entry = lambda k: {"keyword": k, "dates": ["2024-02-04"], "volumes": [3], "ranks": [8]}
    answers = {
        None: [entry(k.upper()) for k in asked[::-1]],
        "keyword_set_mismatch": [entry(k) for k in asked[1:]],
        "duplicate_keyword": [entry(k) for k in [*asked, asked[0].title()]],
    }
    rows = [(n, asked, content({"keywords": a})) for n, a in enumerate(answers.values())]
    rows += [(3, asked, content({"code": 500, "data": {}})), (4, asked, content({"code": 200, "data": {"keywords": answers[None]}}))]
    rows += [(5, asked, content({"keywords": [entry(k) for k in NAMES[:6]]}))]
    batches = spark.createDataFrame(rows, "batch_id int, keywords array<string>, result string")
    errors = {r["batch_id"]: r["batch_error"] for r in L.batch_entries(batches).select("batch_id", "batch_error").distinct().collect()}
    assert errors == {**dict(enumerate(answers)), 3: "no_body", 4: None, 5: "keyword_set_mismatch"}


def items_of(spark, n):
    rows = [(f"thing-{i}", f"thing {i}", {}, True) for i in range(n)]
    return spark.createDataFrame(rows, "id string, keyword string, queries map<string,string>, selected boolean")


NO_SNAPSHOTS = "ingredient_id string, kind string, provider string, snapshot date, path string"


@pytest.mark.parametrize("n", [1, 5, 23])
def test_batches_hold_five_at_most(spark, n):
    empty = spark.createDataFrame([], NO_SNAPSHOTS)
    hits, single, batched = N.collection_plan(items_of(spark, n), empty, F.lit(AS_OF), VENDOR_B)
    assert hits.count() == 0 and single.count() == n
    sizes = [r["n_items"] for r in batched.orderBy("batch_index").collect()]
    assert sum(sizes) == n and set(sizes[:-1]) <= {5} and len(sizes) == -(-n // 5)


def test_a_forced_refresh_asks_again_for_histories_only(spark):
    seen = [(f"thing-{i}", kind, VENDOR_A, AS_OF, "p") for i in range(4) for kind in ("amazon", "google") if (i, kind) != (3, "google")]
    fresh, four = spark.createDataFrame(seen, NO_SNAPSHOTS), items_of(spark, 4)
    asked = {}
    for force in (False, True):
        hits, single, _ = N.collection_plan(four, fresh, F.lit(AS_OF), VENDOR_A, refresh_amazon=force)
        asked[force] = sorted((r["ingredient_id"], r["kind"]) for r in single.collect())
        assert hits.count() + len(asked[force]) == 8
    assert asked == {False: [("thing-3", "google")], True: sorted([("thing-3", "google"), *((f"thing-{i}", "amazon") for i in range(4))])}


def test_sorted_json_is_compact_and_sorted(spark):
    row = spark.range(1).select(sorted_json(b=F.lit("ü/"), a=F.lit(1), c=F.lit(None).cast("string")).alias("j")).first()
    assert row["j"] == json.dumps({"a": 1, "b": "ü/", "c": None}, ensure_ascii=False, sort_keys=True, separators=(",", ":"))
