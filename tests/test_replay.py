"""Ratings replayed bucket by bucket with a state table, and the choice of a setting on the tuning fold."""

import datetime as dt
import math
import random

from pyspark.sql import functions as F

from scorefield.operators import aggregates as A
from scorefield.operators import ledger as L


def history(seed=5, weeks=6, entities=14):
    r = random.Random(seed)
    days = [dt.date(2024, 1, 1) + dt.timedelta(days=40 * k) for k in range(weeks)]
    rows = [(d, f"e{k}", p, f"p{i}", None if r.random() < 0.05 else 70 + i / 3 + r.gauss(0, 3)) for k, d in enumerate(days) for p in (1, 2) for i in range(entities) if r.random() < 0.9]
    return days, rows


def brute(days, rows, tau=730.0, k=3.0, mu0=0.5, sigma0=2.9, kv=40.0, least=10):
    state, out = {}, {}
    for d in days:
        pre = {}
        for _, _, _, i, _ in [x for x in rows if x[0] == d]:
            w, s, q, t = state.get(i, (0, 0, 0, d))
            f = math.exp(-max(0, (d - t).days) / tau)
            w, s, q = w * f, s * f, q * f
            raw = max(0, q / w - (s / w) ** 2) if w > 1 else sigma0**2
            v = (w * raw + kv * sigma0**2) / (w + kv)
            pre[i] = (w, s, q, (s + k * mu0) / (w + k), math.sqrt(v), math.sqrt(v / (w + k)))
        new = {}
        for e in {x[1] for x in rows if x[0] == d}:
            for p in (1, 2):
                field = [x for x in rows if x[0] == d and x[1] == e and x[2] == p and x[4] is not None]
                if len(field) < least:
                    continue
                mean, strength = sum(x[4] for x in field) / len(field), sum(pre[x[3]][3] for x in field) / len(field)
                for x in field:
                    out[e, p, x[3]] = (x[4] - mean + strength, *pre[x[3]][3:])
                    new.setdefault(x[3], []).append(x[4] - mean + strength)
        for i, xs in new.items():
            state[i] = (pre[i][0] + len(xs), pre[i][1] + sum(xs), pre[i][2] + sum(x * x for x in xs), d)
    return out


def table(spark, rows):
    return spark.createDataFrame(rows, "on date, event string, period int, entity string, v double")


def test_replay_is_the_plain_loop(spark):
    days, rows = history()
    want = brute(days, rows)
    got = A.rating_replay(table(spark, rows), "on", ["event", "period"], "entity", "v", days).where("residual is not null").collect()
    assert len(got) == len(want) > 100
    for r in got:
        assert all(abs(a - b) < 1e-9 for a, b in zip((r["residual"], r["mu"], r["sd"], r["se"]), want[r["event"], r["period"], r["entity"]]))


def test_settings_are_replayed_at_once_and_each_bucket_reads_its_own_rows(spark):
    days, rows = history()
    grid = [{}, {"tau": 90.0, "kv": 10.0}]
    both = A.rating_replay(table(spark, rows), "on", ["event", "period"], "entity", "v", days, grid=grid).where("residual is not null")
    for i, g in enumerate(grid):
        want = brute(days, rows, **g)
        got = {(r["event"], r["period"], r["entity"]): r["residual"] for r in both.where(F.col("setting") == i).collect()}
        assert got.keys() == want.keys() and all(abs(got[k] - want[k][0]) < 1e-9 for k in got)


def loss(x):
    v = x[2] ** 2 + x[3] ** 2
    return 0.5 * math.log(2 * math.pi * v) + (x[0] - x[1]) ** 2 / (2 * v)


def test_later_folds_have_no_say_in_the_choice(spark):
    days, rows = history(weeks=7)
    grid = [{"k": 0.5, "mu0": 40.0}, {}, {"tau": 60.0}]
    cut = [str(days[2]), str(days[4]), str(days[5])]
    folds = [("tune", cut[0], cut[1]), ("validate", cut[1], cut[2]), ("holdout", cut[2], "9999-01-01")]
    rank = lambda rows: {(r["fold"], r["setting"]): (r["n"], round(r["nll"], 9), r["place"], r["chosen"]) for r in L.grid_ranking(table(spark, rows), "on", ["event", "period"], "entity", "v", days, folds, grid).collect()}
    got = rank(rows)
    tuned = {}
    for i, g in enumerate(grid):
        xs = [loss(x) for (e, _, _), x in brute(days, rows, **g).items() if e in ("e2", "e3")]
        tuned[i] = (len(xs), round(sum(xs) / len(xs), 9))
    order = sorted(tuned, key=lambda i: (tuned[i][1], i))
    assert {k: v for k, v in got.items() if k[0] == "tune"} == {("tune", i): (*tuned[i], order.index(i) + 1, i == order[0]) for i in tuned}
    assert {k for k in got if k[0] != "tune"} == {("validate", order[0]), ("holdout", order[0])}
    other = rank([x if x[0] < days[4] else (*x[:4], None if x[4] is None else x[4] * 9) for x in rows])
    assert {k: v for k, v in other.items() if k[0] == "tune"} == {k: v for k, v in got.items() if k[0] == "tune"} and other["holdout", order[0]] != got["holdout", order[0]]
