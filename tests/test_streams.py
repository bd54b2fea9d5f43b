"""Stateful streams against their batch twins over several micro-batches, with late, repeated and missing rows."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from scorefield.plans.streams import in_slices
from scorefield.streaming import tape as ST

T0 = dt.datetime(2025, 1, 1)
ROW = "k string, ts timestamp, status string, big long, price double, ids array<int>"


def ticks(seed=2, n=160):
    r = random.Random(seed)
    rows = [(r.choice("abc"), T0 + dt.timedelta(hours=i, microseconds=i * 7), r.choice(["x", "x", "y", None]), r.choice([None, (1 << 60) + i]), r.choice([None, i / 3]), r.choice([None, [i, i + 1]])) for i in range(n)]
    r.shuffle(rows)
    return rows


def by_time(spark, rows, schema, at, cuts):
    """Slices by time: each is a run of the stream, in which rows come in any order."""
    edges = [dt.datetime.min, *cuts, dt.datetime.max]
    return [spark.createDataFrame([x for x in rows if lo <= x[at] < hi], schema).repartition(3) for lo, hi in zip(edges, edges[1:])]


def rows(df, drop=("batch",)):
    df = df.drop(*drop)
    return sorted((str(r.asDict()) for r in df.select(*sorted(df.columns)).collect()))


@pytest.mark.parametrize("name", ["change_only", "carry_forward", "time_since_change"])
def test_streams_equal_their_twins(spark, name):
    given = ticks()
    make = {
        "change_only": (lambda x: ST.change_only_stream(x, ["k"], "ts", ["status", "ids"]), lambda x: ST.change_only(x, ["k"], "ts", ["status", "ids"])),
        "carry_forward": (lambda x: ST.carry_forward_stream(x, ["k"], "ts", ["big", "price"]), lambda x: ST.carry_forward(x, ["k"], "ts", ["big", "price"])),
        "time_since_change": (lambda x: ST.time_since_change_stream(x, ["k"], "ts", "status"), lambda x: ST.time_since_change(x, ["k"], "ts", "status")),
    }[name]
    slices = by_time(spark, given, ROW, 1, [T0 + dt.timedelta(hours=50), T0 + dt.timedelta(hours=90)])
    late = spark.createDataFrame([("a", T0 - dt.timedelta(days=1), "z", 5, 1.0, None)], ROW)  # older than the state: ignored
    got = in_slices([slices[0], slices[1].unionByName(late), slices[2]], make[0], name)
    want = make[1](spark.createDataFrame(given, ROW))
    assert rows(got) == rows(want) and [f.dataType for f in got.drop("batch").schema] == [f.dataType for f in want.schema]


def test_late_rows_are_dropped_on_streams(spark):
    r = random.Random(3)
    given = [(r.choice("ab"), i, r.randint(0, 60)) for i in range(120)]
    schema = "k string, arrival int, t int"
    ts = lambda df: df.withColumn("ts", F.timestamp_seconds("t"))
    slices = [ts(spark.createDataFrame([x for x in given if x[1] % 120 // 40 == j], schema).repartition(2)) for j in range(3)]
    got = in_slices(slices, lambda x: ST.drop_late_stream(x, ["k"], "ts", "arrival"), "late")
    assert rows(got) == rows(ST.drop_late(ts(spark.createDataFrame(given, schema)), ["k"], "ts", "arrival"))


SNAP = "event_id long, entity_id long, observed_at timestamp, period int, status string, position long, total long, thru int, items array<struct<item:int,strokes:int,par:int>>, row_observed_at timestamp"


def board(seed=6, hours=14, field=9):
    r = random.Random(seed)
    cards = {e: [] for e in range(field)}
    out = []
    for h in range(hours):
        at = T0 + dt.timedelta(hours=h)
        period = 1 + h // 8
        if h == 8:
            cards = {e: [] for e in range(field)}
        for e in range(field):
            for _ in range(r.randint(0, 3)):
                if len(cards[e]) < 18:
                    cards[e].append((len(cards[e]) + 1, r.choice([3, 4, 5, None]), 4))
        totals = {e: sum(s - p for _, s, p in c if s is not None) + (r.random() < 0.2) for e, c in cards.items()}
        for e in range(field):
            if r.random() < 0.9:
                status = "withdrawn" if e == 3 and h > 10 else r.choice(["active"] * 9 + [None])
                place = 1 + sum(t < totals[e] for t in totals.values()) * r.choice([1, 1, 1, 3])
                out.append((1 + e % 2, e, at, r.choice([period, period, period, None]) if h == 5 else period, status, r.choice([place] * 9 + [None]), totals[e], len(cards[e]), list(cards[e]) if r.random() < 0.95 else None, r.choice([None, at, at - dt.timedelta(hours=1)])))
    return out


def test_tape_and_leads_of_streams_equal_their_twins(spark):
    given = board()
    cuts = [T0 + dt.timedelta(hours=4), T0 + dt.timedelta(hours=9)]
    for stream, batch, name, kinds in ((ST.delta_tape, ST.delta_tape_batch, "tape", {"item", "status"}), (ST.lead_changes, ST.lead_changes_batch, "leads", {"lead", "lost_lead"})):
        got = in_slices(by_time(spark, given, SNAP, 2, cuts), stream, name)
        want = batch(spark.createDataFrame(given, SNAP))
        assert rows(got) == rows(want) and kinds <= {r["kind"] for r in want.collect()}


def snap(spark, *rows):
    at = lambda h: T0 + dt.timedelta(hours=h)
    return spark.createDataFrame([(1, e, at(h), 1, "active", pos, total, len(items), [(i, 4 + d, 4) for i, d in items], None if seen is None else at(seen)) for e, h, pos, total, items, seen in rows], SNAP)


def test_items_move_the_total_only_where_it_reconciles(spark):
    df = snap(spark, (1, 0, 3, 0, [(1, 0)], None), (1, 1, 4, -1, [(1, 0), (2, -1)], None), (1, 2, 4, 5, [(1, 0), (2, -1), (3, 2), (4, 0)], None), (1, 3, 2, 5, [(1, 0), (2, -1), (3, 2), (4, 0)], None))
    assert [(r["kind"], r["detail"]) for r in ST.delta_tape_batch(df).orderBy("observed_at", "detail").collect()] == [("item", "2/-1/-1"), ("item", "3/2/"), ("item", "4/0/")]


def test_a_row_that_was_not_read_again_has_no_place_events_and_new_items_no_move(spark):
    df = snap(spark, (1, 0, 30, 0, [], None), (1, 1, 8, 0, [], 0), (2, 0, 30, 0, [], None), (2, 1, 8, 0, [], 1), (3, 0, 24, 0, [], None), (3, 1, 18, 0, [], None), (4, 0, 24, 0, [], None), (4, 1, 18, -1, [(1, -1)], None))
    assert sorted((r["entity_id"], r["kind"], r["detail"]) for r in ST.delta_tape_batch(df).collect()) == [(2, "top10", "8"), (3, "move", "6"), (4, "item", "1/-1/-1")]


def test_the_bounded_tape_keeps_the_newest(spark):
    r = random.Random(9)
    given = [(r.choice("ab"), i % 70, T0 + dt.timedelta(minutes=i % 70)) for i in range(140)]
    schema = "k string, n int, ts timestamp"
    given = list({(k, n): (k, n, t) for k, n, t in given}.values())
    slices = [spark.createDataFrame([x for x in given if lo <= x[1] < hi or x[1] % 9 == 0 and x[1] < hi], schema) for lo, hi in ((0, 20), (20, 45), (45, 70))]
    got = in_slices(slices, lambda x: ST.bounded_tape(x, ["k"], ["n"], "ts", 6), "kept", "update")
    sizes = {(r["k"], r["version"]): r["count"] for r in got.groupBy("k", "version").count().collect()}
    assert set(sizes.values()) == {6}
    last = got.groupBy("k").agg(F.max("version").alias("version"))
    assert rows(got.join(last, ["k", "version"], "left_semi"), ("batch", "version")) == rows(ST.keep_newest(spark.createDataFrame(given, schema), ["k"], ["n"], "ts", 6))
