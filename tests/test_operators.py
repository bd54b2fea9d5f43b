"""Hand-made cases of the rules, and invariants."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from scorefield.functions import scalars as S
from scorefield.functions.scalars import haversine_km
from scorefield.operators import aggregates as A
from scorefield.operators import draws as D
from scorefield.operators import filters as X
from scorefield.operators import joins as J
from scorefield.operators import ledger as L
from scorefield.operators import ranking as T
from scorefield.operators import sets as O
from scorefield.operators import text_gates as G
from scorefield.operators import windows as W
from scorefield.sources import readers as R
from scorefield.streaming import tape as ST


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


def test_percentile_goldens(spark):
    ten = spark.createDataFrame([(i, "c", float(i)) for i in range(1, 11)] + [(90 + i, "small", float(v)) for i, v in enumerate([1, 2, 3, 5])] + [(99, "c", None)], "id int, cohort string, v double")
    got = {r["id"]: r["percentile"] for r in W.midrank_percentile(ten, ["cohort"], "v").collect()}
    assert got[10] == 100 and got[1] == 0 and got[93] is None and got[99] is None
    low = {r["id"]: r["percentile"] for r in W.midrank_percentile(ten, ["cohort"], "v", "lower").collect()}
    assert low[1] == 100 and low[10] == 0


def test_percentile_ties_share_the_middle(spark):
    df = spark.createDataFrame([(i, 1.0 if i < 5 else 2.0) for i in range(10)], "id int, v double").withColumn("c", F.lit(1))
    assert {r["percentile"] for r in W.midrank_percentile(df, ["c"], "v").collect()} == {22, 78}


@pytest.mark.parametrize("n,want", [(40, "HIGH"), (20, "MEDIUM"), (8, "LIMITED"), (7, "INSUFFICIENT")])
def test_tiers(spark, n, want):
    assert one(spark, S.tier("rounds", F.lit(n))) == want


@pytest.mark.parametrize("text,want", [("E", 0), ("−3", -3), ("+2", 2), ("-", None), ("x", None), (None, None)])
def test_to_par(spark, text, want):
    assert one(spark, S.to_par(F.lit(text).cast("string"))) == want


def test_cells(spark):
    c = one(spark, S.score_cell(F.lit("72-66-66-73=277")))
    assert (c["periods"], c["total"], c["consistent"]) == ([72, 66, 66, 73], 277, True)
    for text, want in {"T8": (8, True, "finished"), "CUT": (None, None, "cut"), "WD": (None, None, "withdrawn"), "DQ": (None, None, "disqualified"), "MDF": (None, None, "unknown")}.items():
        assert tuple(one(spark, S.place_cell(F.lit(text)))) == want


def test_date_range(spark):
    day = dt.date
    for text, want in {"April 10–13, 2025": (day(2025, 4, 10), day(2025, 4, 13)), "March 30 – April 2, 2025": (day(2025, 3, 30), day(2025, 4, 2)), "May 4, 2025": (day(2025, 5, 4), day(2025, 5, 4))}.items():
        assert tuple(one(spark, S.date_range(F.lit(text)))) == want


def test_round_half_up_goes_toward_plus_infinity(spark):
    assert [one(spark, S.round_half_up(F.lit(x), 1)) for x in (0.25, -0.25, 0.35)] == [0.3, -0.2, 0.4]


def test_ordinals_and_lists(spark):
    assert [one(spark, S.ordinal(F.lit(n))) for n in (1, 2, 3, 4, 11, 12, 13, 21, 111)] == ["1st", "2nd", "3rd", "4th", "11th", "12th", "13th", "21st", "111th"]
    assert one(spark, S.join_words(F.array(F.lit("a"), F.lit("b"), F.lit("c")))) == "a, b and c"


def test_wind(spark):
    labels = [one(spark, S.wind_components(F.lit(float(d)), F.lit(10.0), F.lit(0.0)))["label"] for d in (0, 45, 90, 180, 270, 315)]
    assert labels == ["headwind", "quartering right", "cross from right", "tailwind", "cross from left", "quartering left"]


def test_unmeasured_zero_is_null(spark):
    df = spark.createDataFrame([("rate", 0.0, None), ("rate", 0.0, 3), ("wins", 0.0, None)], "code string, value double, rank int")
    assert [r["value"] for r in X.clean_stat(df, "code", "value", "rank", ["rate"]).collect()] == [None, 0.0, 0.0]


def test_upsert_twice_is_unchanged(spark):
    old = spark.createDataFrame([(1, 72, "a"), (2, None, "b")], "id int, v int, c string")
    new = spark.createDataFrame([("1", "72"), ("2", "5"), ("3", None)], "id string, v string")
    target, actions = O.merge_upsert(old, new, "id", ["v"])
    assert {r["id"]: r["action"] for r in actions.collect()} == {1: "unchanged", 2: "updated", 3: "inserted"}
    assert {r["action"] for r in O.merge_upsert(target, new, "id", ["v"])[1].collect()} == {"unchanged"}
    assert {r["id"]: r["c"] for r in target.collect()} == {1: "a", 2: "b", 3: None}


def test_future_rows_never_change_history(spark):
    rows = [(1, "a", dt.date(2025, 1, d), d) for d in (1, 5, 9)]
    df = spark.createDataFrame(rows, "k int, e string, on date, v int")
    past = {(r["on"]): r["prior_total"] for r in J.history_before(df, "e", "on", "v").collect()}
    more = spark.createDataFrame(rows + [(9, "a", dt.date(2025, 2, 1), 100)], df.schema)
    again = {(r["on"]): r["prior_total"] for r in J.history_before(more, "e", "on", "v").collect()}
    assert all(again[k] == v for k, v in past.items()) and past[dt.date(2025, 1, 9)] == 6


def test_grading_truth_table(spark):
    res = spark.createDataFrame([(1, 10, True, 4, "finished", 10, True, 4, 140), (1, 14, True, 4, "finished", 14, True, 4, 141), (1, 90, True, 4, "cut", None, True, 2, 150), (1, 91, True, 4, "cut", None, True, 2, 151), (1, 92, True, 4, "dns", None, True, 0, None), (2, 10, True, 4, "finished", 1, False, 4, 140), (3, 10, True, 1, "finished", 1, True, 1, 70)], "event int, entity int, final boolean, periods int, status string, position int, real_cut boolean, entity_periods int, early int")
    locks = spark.createDataFrame([(1, 10, "top10", None), (1, 14, "top10", None), (1, 90, "top20", None), (1, 92, "top10", None), (2, 10, "make_cut", None), (1, 90, "h2h", 91), (1, 91, "h2h", 90), (1, 10, "h2h", 90), (3, 10, "winner", None), (4, 10, "winner", None), (2, 10, "winner", None)], "event int, entity int, family string, opponent int")
    got = [r["grade"] for r in L.grade(locks, res, "event", "entity", "family", "opponent").orderBy("event", "entity", "family").collect()]
    want = {(1, 10, "h2h"): "WIN", (1, 10, "top10"): "WIN", (1, 14, "top10"): "LOSS", (1, 90, "h2h"): "WIN", (1, 90, "top20"): "LOSS", (1, 91, "h2h"): "LOSS", (1, 92, "top10"): "VOID", (2, 10, "make_cut"): "VOID", (2, 10, "winner"): "WIN", (3, 10, "winner"): "VOID", (4, 10, "winner"): "PENDING"}
    assert got == [want[k] for k in sorted(want)]


def test_ledger_audit_finds_tampering(spark):
    probs = spark.createDataFrame([(1, "a", 0.5), (2, "b", 0.4)], "event int, key string, p double")
    ready = spark.createDataFrame([(1, True), (2, True), (3, False)], "event int, ready boolean")
    locks = L.lock(probs, ready, "event", "key", "2025-01-01 00:00:00")
    events = spark.createDataFrame([(1, "2025-01-02", True), (2, "2024-12-31", True)], "event int, s string, over boolean").withColumn("starts_at", F.col("s").cast("timestamp"))
    grades = spark.createDataFrame([("a",), ("b",)], "key string")
    assert [tuple(r) for r in L.audit_ledger(locks, grades, events, "key", "event").collect()] == [("b", "late")]
    forged = locks.withColumn("p", F.lit(0.9))
    assert {r["problem"] for r in L.audit_ledger(forged, grades, events, "key", "event").collect()} == {"seal", "late"}


def test_draw_probabilities_sum_to_one(spark):
    draws = spark.createDataFrame([(1, d, e, p, (d * 7 + e * 3 + p) % 5) for d in range(20) for e in range(12) for p in (1, 2, 3)], "event int, draw int, entity int, period int, score int")
    out = D.draw_outcomes(draws, "event", "entity", "period", "score", 6).collect()
    assert abs(sum(r["win"] for r in out) - 1) < 1e-9 and all(0 <= r["make"] <= 1 for r in out)


def test_item_buckets_sum_to_sample(spark):
    df = spark.createDataFrame([(1, i % 7 - 3) for i in range(50)], "item int, diff int")
    r = A.item_stats(df, ["item"], "diff").first()
    assert r["eagle"] + r["under"] + r["level"] + r["over"] + r["double"] == r["n"] == 50


def test_strength_replay_uses_only_the_past(spark):
    rows = [(e, dt.date(2025, 1, 1) + dt.timedelta(days=30 * e), p, float((p * 13 + e * 7) % 11)) for e in range(3) for p in range(12)]
    df = spark.createDataFrame(rows, "event int, on date, entity int, v double")
    days = sorted({r[1] for r in rows})
    cut = lambda df: spark.createDataFrame(df.collect(), df.schema)
    full = {(r["event"], r["entity"]): r["residual"] for r in A.rating_replay(df, "on", ["event"], "entity", "v", days, cut).collect()}
    part = {(r["event"], r["entity"]): r["residual"] for r in A.rating_replay(df, "on", ["event"], "entity", "v", days[:2], cut).collect()}
    assert all(abs(full[k] - v) < 1e-9 for k, v in part.items()) and len(full) == 36


def test_gates(spark):
    drafts = spark.createDataFrame([(1, "word " * 40 + "{f:a}"), (2, "word " * 40 + "{f:zz} and 3 or seven"), (3, "short"), (4, None), (5, "word " * 40 + "thirteen"), (6, "word " * 40 + "a top-ten, then the back nine in the third round"), (7, "word " * 40 + "ten was second")], "k int, text string")
    facts = spark.createDataFrame([(1, "a"), (2, "a")], "k int, fact_id string")
    got = {r["k"]: r["reasons"] for r in G.text_gates(drafts, facts, "k", "text", {}).collect()}
    assert got == {1: [], 2: ["unknown_fact", "digits", "number_word"], 3: ["length"], 4: ["length"], 5: ["number_word"], 6: [], 7: ["number_word", "ordinal_word"]}


def test_gates_of_a_whole_draft(spark):
    body = "word " * 40
    drafts = [
        (1, "{e:p1} leads after a calm opening day", "A quiet start for the field, and one clear leader by the evening.", body + "{f:a} {f:b} {f:c} {e:p1}"),
        (2, "Short", None, body + "{f:a} {f:a} {e:p9} and Ann Lee or Bob Ray won"),
        (3, "{e:p1} leads after a calm opening day", "A quiet start for the field, and one clear leader by the evening.", "word " * 20 + "{f:a} {f:b} {f:c}"),
    ]
    d = spark.createDataFrame(drafts, "k int, headline string, dek string, text string").withColumn("fewest", F.when(F.col("k") == 3, 15))
    facts = spark.createDataFrame([(k, f) for k in (1, 2, 3) for f in "abc"], "k int, fact_id string")
    people = spark.createDataFrame([(k, "p1", "Ann Lee") for k in (1, 2, 3)], "k int, entity_key string, name string")
    got = {r["k"]: r["reasons"] for r in G.text_gates(d, facts, "k", "text", {}, entities=people, headline="headline", dek="dek", facts_used=3, fewest="fewest").collect()}
    assert got[1] == [] and got[3] == []
    assert got[2] == ["unknown_entity", "unknown_name", "too_few_facts", "headline_length", "dek_length"]


def test_greedy_selection_never_reuses(spark):
    p = spark.createDataFrame([(1, e, f, (e * 7 + k) % 10 / 10) for e in range(8) for k, f in enumerate(["win", "top"])], "event int, entity int, family string, p double")
    got = T.greedy_select(p, [("win", 1, 0.0), ("top", 3, 0.2)], "event", "entity", "family", "p").collect()
    assert len({r["entity"] for r in got}) == len(got) == 4


def test_readers(spark, tmp_path):
    (tmp_path / "s.csv").write_text('TYPE,WND,TMP\nFM-15,"320,5,N,0041,5","+0123,1"\nFM-15,"999,9,V,9999,9","+9999,9"\nSOD,"1,1,N,0001,1","+0001,1"\n')
    got = R.read_packed_csv(spark, str(tmp_path / "s.csv"), {"speed": ("WND", 3, "9999", 0.1), "temp": ("TMP", 0, "9999", 0.1)}, kind="TYPE", kinds=["FM-15"]).collect()
    assert [(None if r["speed"] is None else round(r["speed"], 3), None if r["temp"] is None else round(r["temp"], 3)) for r in got] == [(4.1, 12.3), (None, None)]
    (tmp_path / "f.xml").write_text('<feed><entry><id>1</id><title>A</title><updated>2025-01-01T00:00:00Z</updated><link href="http://x"/></entry></feed>')
    f = R.read_feed(spark, str(tmp_path / "f.xml")).first()
    assert (f["id"], f["title"], f["updated"]) == ("1", "A", dt.datetime(2025, 1, 1))
    (tmp_path / "e.json").write_text('{"id": 7, "tags": {"name": "Oak", "golf": "hole"}, "geometry": [{"lat": 1.0, "lon": 2.0}]}\n')
    e = R.read_elements(spark, str(tmp_path / "e.json")).first()
    assert (e["id"], e["name"], e["role"], e["points"][0]["lat"]) == (7, "Oak", "hole", 1.0)
    pages = spark.createDataFrame([(1, "<table><tr><th>A</th><td> <b>x</b> y</td></tr></table>"), (2, None)], "id int, html string")
    assert [(r["row"], r["col"], r["text"]) for r in R.extract_page_tables(pages, "id", "html").collect()] == [(0, 0, "A"), (0, 1, "x y")]


def snap(spark, rows):
    return spark.createDataFrame([(1, e, dt.datetime(2025, 1, 1, h), p, s, pos, t, th) for e, h, p, s, pos, t, th in rows], "event_id long, entity_id long, observed_at timestamp, period int, status string, position long, total long, thru int")


def test_tape_events_are_provable(spark):
    s = snap(spark, [(1, 1, 1, "active", 12, 5, 9), (1, 2, 1, "active", 9, 3, 18), (2, 1, 1, "active", 2, 0, 3), (2, 2, 1, "withdrawn", 2, 0, 3), (3, 1, 1, "active", 30, 9, 1), (3, 2, 2, "active", 3, 0, 18), (4, 1, 1, "active", 24, 5, 1), (4, 2, 1, "active", 18, 5, 2), (4, 2, 1, "active", 18, 5, 2)])
    got = sorted((r["entity_id"], r["kind"], r["detail"]) for r in ST.delta_tape_batch(s).collect())
    assert got == [(1, "finish", "3"), (1, "top10", "9"), (2, "status", "withdrawn"), (4, "move", "6")]


def test_tape_of_one_time_does_not_depend_on_the_order_of_rows(spark, tmp_path):
    rows = [(1, 1, 1, "active", 12, 5, 9), (1, 2, 1, "active", 9, 3, 18), (1, 2, 1, "active", 4, 3, 18), (1, 2, 1, None, 4, 3, None)]
    for k, given in enumerate((rows, rows[::-1])):
        got = sorted((r["kind"], r["detail"]) for r in ST.delta_tape_batch(snap(spark, given).coalesce(1)).collect())
        assert got == [("top5", "4")]
        snap(spark, given).coalesce(1).write.parquet(str(tmp_path / f"in{k}"))
        seen = []
        ST.replay(ST.delta_tape(spark.readStream.schema(snap(spark, rows).schema).parquet(str(tmp_path / f"in{k}"))), lambda b, n: seen.extend(b.collect()), str(tmp_path / f"state{k}"))
        assert [(r["kind"], r["detail"]) for r in seen] == got


def test_asof_join_keeps_any_type(spark):
    left = spark.createDataFrame([(1, dt.date(2025, 1, 3)), (2, dt.date(2025, 1, 3))], "k int, at date")
    right = spark.createDataFrame([(1, dt.date(2025, 1, 1), [1, 2], ("a", 1.5)), (1, dt.date(2025, 1, 2), [3], ("b", None)), (2, dt.date(2025, 1, 4), [9], None)], "k int, at date, v array<int>, s struct<x:string,y:double>")
    for value in ("v", "s"):
        got = J.asof_join(left, right, ["k"], "at", value)
        assert got.schema[value].dataType == right.schema[value].dataType and got.schema["at_matched"].dataType == right.schema["at"].dataType
    assert {r["k"]: (r["v"], r["at_matched"]) for r in J.asof_join(left, right, ["k"], "at", "v").collect()} == {1: ([3], dt.date(2025, 1, 2)), 2: (None, None)}


def test_nearest_station_anywhere_on_the_globe(spark):
    """Against all pairs: near both poles, across the date line, at any latitude."""
    r = random.Random(4)
    place = lambda: (r.choice([90.0, -90.0, 89.97, 89.5, -89.9, 80.0, r.uniform(-90, 90)]), r.choice([180.0, -180.0, r.uniform(-180, 180)]))
    ps, ss = [(i, *place()) for i in range(120)], [(i, *place()) for i in range(120)]
    ps.append((500, 89.97, 0.0)), ss.append((500, 89.97, 170.0))
    p, s = spark.createDataFrame(ps, "id int, lat double, lon double"), spark.createDataFrame(ss, "station int, lat double, lon double")
    for km in (10.0, 300.0):
        every = p.crossJoin(s.selectExpr("station", "lat as la", "lon as lo")).withColumn("km", haversine_km("lat", "lon", "la", "lo")).where(F.col("km") <= km)
        want = {x["id"]: x["m"][1] for x in every.groupBy("id").agg(F.min(F.struct("km", "station")).alias("m")).collect()}
        assert {x["id"]: x["station"] for x in J.nearest_within(p, s, "id", "station", km).collect()} == want and want[500] is not None


def test_snapshot_totals_are_never_made_up(spark):
    df = spark.createDataFrame([([1, 2],), ([1, None],), ([],), (None,)], "scores array<int>")
    assert [r["total"] for r in ST.normalise_snapshot(df).collect()] == [3, None, None, None]


def test_nearest_station_across_the_date_line(spark):
    p = spark.createDataFrame([(1, 60.0, 179.95), (2, 0.0, 0.0), (3, None, 5.0)], "id int, lat double, lon double")
    s = spark.createDataFrame([(7, 60.0, -179.95), (8, 0.5, 0.5)], "station int, lat double, lon double")
    assert {r["id"]: r["station"] for r in J.nearest_within(p, s, "id", "station", 25.0).collect()} == {1: 7}


def test_schema_contract(spark):
    df = spark.createDataFrame([(1, "a")], "x int, y string")
    assert {(r["field"], r["problem"]) for r in O.check_schema(df, {"x": "bigint", "z": "int"}).collect()} == {("x", "type"), ("z", "missing"), ("y", "extra")}


def test_boundary_match_is_unique(spark):
    from scorefield.operators import studies as U

    square = lambda x: [(x, 0.0), (x + 10.0, 0.0), (x + 10.0, 10.0), (x, 10.0)]
    rings = spark.createDataFrame([(1, "Oak Hill", square(0.0)), (2, "Oak Hill", square(30.0)), (3, "Other", square(13.0))], "rid int, rname string, ring array<struct<x:double,y:double>>")
    points = spark.createDataFrame([(1, 11.0, 5.0, "Oak Hill Club"), (2, 28.0, 5.0, "Elm"), (3, 500.0, 5.0, "Oak")], "pid int, x double, y double, pname string")
    got = U.near_boundary_join(points, rings, "pid", "rid", 3.0, S.token_overlap("pname", "rname"), 0.5).collect()
    assert [(r["pid"], r["rid"], r["distance"]) for r in got] == [(1, 1, 1.0)]


def test_contains_join(spark):
    rings = spark.createDataFrame([(1, [(0.0, 0.0), (4.0, 0.0), (4.0, 4.0), (0.0, 4.0)]), (2, [(2.0, 2.0), (6.0, 2.0), (6.0, 6.0), (2.0, 6.0)])], "rid int, ring array<struct<x:double,y:double>>")
    points = spark.createDataFrame([(1, 1.0, 1.0), (2, 3.0, 3.0), (3, 9.0, 9.0), (4, None, 1.0)], "pid int, x double, y double")
    assert {r["pid"]: (r["rid"], r["verdict"]) for r in J.contains_join(points, rings, "pid", "rid", 3.0).collect()} == {1: (1, "match"), 2: (None, "review"), 3: (None, "none"), 4: (None, "none")}


def test_publishing_is_refused_on_regressions(spark, tmp_path):
    from scorefield.operators import publish as U

    live = spark.createDataFrame([(1, 5, "a"), (2, 5, "b")], "k int, n int, c string")
    worse = spark.createDataFrame([(1, 4, "a")], "k int, n int, c string")
    path = str(tmp_path / "out")
    assert not U.guarded_overwrite(live, worse, path, "k", ["n"], ["c"])
    allow = spark.createDataFrame([(1, ["count_lost"]), (2, ["row_removed"])], "k int, allow array<string>")
    assert U.guarded_overwrite(live, worse, path, "k", ["n"], ["c"], allow) and U.read_published(spark, path).count() == 1


def test_items_on_routes(spark):
    from scorefield.operators import studies as U

    routes = spark.createDataFrame([(1, 4, [(0.0, 0.0), (200.0, 0.0), (200.0, 200.0)]), (2, 3, [(0.0, 0.0), (150.0, 0.0)])], "item int, item_class int, points array<struct<x:double,y:double>>")
    features = spark.createDataFrame([(1, "sand", 100.0, 10.0), (1, "water", 100.0, 90.0), (2, "sand", 140.0, -5.0)], "item int, kind string, x double, y double")
    got = {r["item"]: r for r in U.item_intelligence(routes, features, ["item"], 20.0).collect()}
    assert (got[1]["length"], got[1]["shape"], [(f["kind"], f["along"], f["side"]) for f in got[1]["features"]]) == (400.0, "dogleg left", [("sand", 100.0, 1.0)])
    assert (got[2]["shape"], [(f["along"], f["side"]) for f in got[2]["features"]]) == (None, [(140.0, -1.0)])


def test_covariate_study(spark):
    from scorefield.operators import studies as U

    scores = spark.createDataFrame([(e, float(v)) for e in range(12) for v in (e, e + 1)], "event int, v double")
    points = spark.createDataFrame([(e, float(e), 0.0) for e in range(12)], "event int, lat double, lon double")
    stations = spark.createDataFrame([(e, float(e), 0.1) for e in range(11)], "station int, lat double, lon double")
    readings = spark.createDataFrame([(e, float(e % 3)) for e in range(11)], "station int, wind double")
    corr, bins = U.covariate_study(scores, points, stations, readings, "event", "v", "wind")
    assert corr.first()["n"] == 22 and bins.first()["n"] == 22


def test_replay_twice_adds_nothing(spark, tmp_path):
    df = snap(spark, [(1, h, 1, "active", 12 - h, 5, 9) for h in range(1, 6)])
    df.write.parquet(str(tmp_path / "in"))
    seen = []
    for _ in range(2):
        ST.replay(ST.delta_tape(spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))), lambda b, n: seen.append(b.count()), str(tmp_path / "state"))
    assert sum(seen) == ST.delta_tape_batch(df).count() == 1


def test_late_rows_are_dropped(spark):
    df = spark.createDataFrame([("a", 1, 5), ("a", 2, 3), ("a", 3, 5), ("a", 4, 6), ("b", 1, 1)], "k string, arrival int, t int")
    assert sorted((r["k"], r["t"]) for r in ST.drop_late(df, ["k"], "t", "arrival").collect()) == [("a", 5), ("a", 6), ("b", 1)]
