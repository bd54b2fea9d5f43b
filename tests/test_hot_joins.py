"""Joins over few, very common keys: the same rows as by brute force, and no join that grows with the square of a key."""

import datetime as dt
import itertools
import random

from pyspark.sql import functions as F

from scorefield.functions.scalars import name_keys
from scorefield.operators import joins as J
from scorefield.operators import studies as U


def most_joined(df) -> int:
    """The most rows that a join of the plan gave, once df has been collected."""

    def walk(node) -> int:
        kind = node.nodeName()
        if kind == "AdaptiveSparkPlan":
            return walk(node.executedPlan())
        if "QueryStage" in kind:
            return walk(node.plan())
        rows = node.metrics().get("numOutputRows")
        own = rows.get().value() if "Join" in kind and rows.isDefined() else 0
        return max([own, *(walk(node.children().apply(i)) for i in range(node.children().size()))])

    return walk(df._jdf.queryExecution().executedPlan())


def test_candidate_pairs_of_small_tiles(spark, monkeypatch):
    monkeypatch.setattr(J, "TILE", 3)
    pick = random.Random(5)
    names = [(i, " ".join(pick.choice(["Ann", "Bo", "Lee-Ek", "lee", "ek"]) for _ in range(pick.randint(1, 3)))) for i in range(90)] + [(3, "Bo Ek"), (91, None), (92, ""), (None, "Ann Bo")]
    df = spark.createDataFrame(names, "id int, name string")
    keys: dict[int, set] = {}
    for r in df.select("id", name_keys("name").alias("k")).collect():
        keys.setdefault(r["id"], set()).update(r["k"] or [])
    ids = sorted(i for i in keys if i is not None)
    want = [(a, b) for a, b in itertools.combinations(ids, 2) if keys[a] & keys[b]]
    assert sorted(map(tuple, J.candidate_pairs(df, "id", "name").collect())) == want and len(want) > 100


def test_candidate_pairs_are_not_shuffled(spark):
    plan = J.candidate_pairs(spark.createDataFrame([(1, "a b"), (2, "b a")], "id int, name string"), "id", "name")._jdf.queryExecution().optimizedPlan().toString()
    above = plan.split("Join")[0]
    assert "Join" in plan and "Aggregate" not in above and "Repartition" not in above


DAY = dt.date(2026, 4, 12)
WORDS = ["Masters", "Valley", "Cup", "Tour", "open", "Crown"]


def words(name) -> set:
    return {w for w in (name or "").lower().split() if len(w) > 3 and w != "open"}


def near(a, b) -> bool:
    """(name, end, year) of two rows."""
    return None not in (*a[1:], *b[1:]) and a[2] == b[2] and abs((a[1] - b[1]).days) <= 1 and bool(words(a[0]) & words(b[0]))


def some(pick):
    return (" ".join(pick.choice(WORDS) for _ in range(pick.randint(0, 2))) or None, pick.choice([None] + [DAY + dt.timedelta(days=i) for i in range(7)]), pick.choice([None, 1, 1, 2, 2]))


def test_events_with_one_candidate(spark):
    pick = random.Random(3)
    a, b = [(i if i else None, *some(pick)) for i in [*range(200), 5, 6]], [(i if i else None, *some(pick)) for i in [*range(20), 5]]
    want = set()
    for k in {r[0] for r in a}:
        found = {r[0] for r in b for x in a if x[0] == k and near(x[1:], r[1:])}
        want |= {(k, *found)} if len(found) == 1 else set()
    frame = lambda rows, k: spark.createDataFrame(rows, f"{k} int, name string, end date, year int")
    got = J.match_events(frame(a, "a"), frame(b, "b"), "year", "end", "name", "a", "b", generic=["open"]).collect()
    assert len(got) == len(want) > 5 and set(map(tuple, got)) == want


def test_events_of_a_common_word_are_no_pairs(spark):
    rows = lambda k, n: spark.range(n).selectExpr(f"id AS {k}", "'Valley Cup' AS name", "DATE '2026-04-12' AS end", "1 AS year")
    found = J.match_events(rows("a", 2000), rows("b", 2000), "year", "end", "name", "a", "b")
    assert found.collect() == [] and most_joined(found) <= 2000
    assert J.match_events(rows("a", 2000), rows("b", 1), "year", "end", "name", "a", "b").count() == 2000


def test_editions_against_brute_force(spark):
    pick = random.Random(8)
    own = lambda: pick.choice([None, "men", "women"])
    events = [(str(i), *some(pick), own()) for i in [*range(80), 7]]
    editions = [(f"e{i:02}", *some(pick), pick.random() < 0.1, str(pick.randint(0, 160)) if pick.random() < 0.4 else None, own(), pick.choice([None, False, False, True])) for i in [*range(50), 3]]
    live = [r for r in editions if not r[7]]
    want = []
    for k, *e, d in events:
        seen = {(r[0], *r[4:7], x[4]) for r in live for x in events if x[0] == k and near(x[1:4], r[1:4])}
        canon = [r for r in seen if r[1]]
        fits = [r for r in seen if r[4] is None or r[4] == r[3]]
        exact = [r[0] for r in live if r[5] == k]
        if len(canon) == 1:
            want.append((k, canon[0][0], "canonical", tuple(sorted({r[0] for r in seen if not r[1]} - {canon[0][0]}))))
        else:
            want.append((k, min(exact), "exact_id", ()) if exact else (k, fits[0][0], "unique", ()) if len(fits) == 1 else (k, None, None, ()))
    a = spark.createDataFrame(events, "k string, name string, end date, year int, division string")
    b = spark.createDataFrame(editions, "e string, name string, end date, year int, canonical boolean, provider string, division string, superseded boolean")
    got = J.match_editions(a, b, "k", "e", "name", "end", "year", "canonical", "provider", "division", "superseded").collect()
    assert sorted(map(str, want)) == sorted(str((*r[:3], tuple(r[3]))) for r in got)
    assert {w[2] for w in want} == {None, "canonical", "exact_id", "unique"} and any(w[3] for w in want)


def test_editions_of_a_common_word_are_no_pairs(spark):
    rows = lambda k, n: spark.range(n).selectExpr(f"id AS {k}", "'Valley Cup' AS name", "DATE '2026-04-12' AS end", "1 AS year", "id % 3 AS division", "id % 2 = 0 AS canonical", "CAST(NULL AS long) AS provider", "false AS superseded")
    found = J.match_editions(rows("k", 2000).select("k", "name", "end", "year", "division"), rows("e", 2000), "k", "e", "name", "end", "year", "canonical", "provider", "division", "superseded")
    assert {tuple(r[1:3]) for r in found.collect()} == {(None, None)} and most_joined(found) <= 2000


def square(x, y, h):
    return [(x - h, y - h), (x + h, y - h), (x + h, y + h), (x - h, y + h)]


def test_near_boundaries_in_rounds(spark, monkeypatch):
    from scorefield.session import written

    joined = []

    def watched(df, name, by=()):
        df.collect()
        joined.append(most_joined(df))
        return written(df, name, by)

    monkeypatch.setattr(U, "FIRST_EDGES", 4, raising=False)
    monkeypatch.setattr(U, "MORE_EDGES", 3, raising=False)
    monkeypatch.setattr(U, "written", watched, raising=False)
    pick = random.Random(4)
    at = lambda: (float(pick.randint(0, 60)), float(pick.randint(0, 60)))
    crowd = [(100 + i, 200.0, 200.0) for i in range(300)]
    points = [(i, *at()) for i in [*range(150), 7, 8]] + [(99, None, 1.0), (9, *at()), *crowd]
    rings = [(i, *at(), float(pick.randint(1, 6))) for i in [*range(12), 3]] + [(None, *at(), 2.0), (50, 1.0, 1.0, 0.0)] + [(1000 + i, 200.0, 200.0, 2.0) for i in range(300)]

    def far(x, y, cx, cy, h):
        dx, dy = abs(x - cx), abs(y - cy)
        return min(h - dx, h - dy) if dx <= h and dy <= h else (max(dx - h, 0) ** 2 + max(dy - h, 0) ** 2) ** 0.5

    hits: dict[int, list] = {}
    for k, x, y in points:
        for r, *ring in rings:
            if x is not None and ((r or 0) + k) % 3 and far(x, y, *ring) <= 3.0:
                hits.setdefault(k, []).append((r, round(far(x, y, *ring), 6)))
    want = sorted((k, *h[0]) for k, h in hits.items() if len(h) == 1)
    p = spark.createDataFrame(points, "id int, x double, y double")
    b = spark.createDataFrame([(r, square(*ring)) for r, *ring in rings], "ring_id int, ring array<struct<x:double,y:double>>")
    agree = F.when(F.pmod(F.coalesce("ring_id", F.lit(0)) + F.col("id"), F.lit(3)) == 0, 0.2).otherwise(0.8)
    found = U.near_boundary_join(p, b, "id", "ring_id", 3.0, agree)
    assert sorted(((r["id"], r["ring_id"], round(r["distance"], 6)) for r in found.collect()), key=str) == sorted(want, key=str) and len(want) > 10
    assert max([most_joined(found), *joined]) < 300 * 300 / 2


def test_pairs_without_another_candidate(spark):
    pick = random.Random(2)
    side = lambda n: [(pick.choice([None, *range(n)]), pick.choice([None, *range(14)]), pick.choice(["x", "y"])) for _ in range(n)]
    l, r = side(26), side(24)
    pairs = {(a[0], b[0]) for a in l for b in r if a[1:] == b[1:] and a[1] is not None}
    want = [p for p in pairs if sum(p[0] == q[0] for q in pairs) == 1 == sum(p[1] == q[1] for q in pairs)]
    frame = lambda rows, k: spark.createDataFrame(rows, f"{k} int, e int, s string")
    got = J.match_unique(frame(l, "l"), frame(r, "r"), ["e", "s"], "l", "r").collect()
    assert sorted(map(tuple, got), key=str) == sorted(want, key=str) and len(want) > 2


def test_ties_of_one_key_are_no_pairs(spark):
    rows = lambda k: spark.range(2000).selectExpr(f"id AS {k}", "IF(id < 5, id, -1) AS e")
    found = J.match_unique(rows("l"), rows("r"), ["e"], "l", "r")
    assert sorted(map(tuple, found.collect())) == [(i, i) for i in range(5)] and most_joined(found) <= 2000


def test_points_and_rings_of_one_place(spark):
    pick = random.Random(6)
    at = lambda: (float(pick.randint(0, 9)) + 0.5, float(pick.randint(0, 9)) + 0.5)
    points = [(i, *at()) for i in range(120)] + [(5, *at()), (200, None, 1.5)] + [(1000 + i, 50.5, 50.5) for i in range(500)]
    rings = [(i, *(float(pick.randint(0, 9)) for _ in range(2)), float(pick.randint(1, 2))) for i in range(25)] + [(500 + i, 50.0, 50.0, 2.0) for i in range(500)]
    want = {}
    for k, x, y in points:
        held = [r for r, cx, cy, h in rings if x is not None and abs(x - cx) < h and abs(y - cy) < h]
        want.setdefault(k, []).extend(held)
    p = spark.createDataFrame(points, "id int, x double, y double")
    b = spark.createDataFrame([(r, square(*ring)) for r, *ring in rings], "rid int, ring array<struct<x:double,y:double>>")
    found = J.contains_join(p, b, "id", "rid", 3.0)
    got = sorted((r["id"], r["rings"], r["rid"], r["verdict"]) for r in found.collect())
    assert got == sorted((k, len(h), h[0] if len(h) == 1 else None, "match" if len(h) == 1 else "review" if h else "none") for k, h in want.items())
    assert {r[3] for r in got} == {"match", "review", "none"} and most_joined(found) <= len(points)


def test_nearest_pairs_of_a_line(spark):
    pick = random.Random(9)
    at = lambda: pick.choice([None, *range(-40, 60)])
    left = [(i, pick.choice([None, "u", "v"]), at()) for i in [*range(150), 3, 4]]
    right = [(i, pick.choice([None, "u", "v"]), at()) for i in [*range(40), 6]]
    pairs = [(a, b, abs(x - y)) for a, k, x in left for b, m, y in right if k and k == m and None not in (x, y)]
    frame = lambda rows, k: spark.createDataFrame(rows, f"{k} int, kind string, at int")
    found = J.nearest_pairs(frame(left, "a"), frame(right, "b"), ["kind"], "a", "b", "at", 7)
    want = J.assign_exclusive(spark.createDataFrame(pairs, "a int, b int, distance int"), "a", "b", "distance", 7, 2).collect()
    got = J.assign_exclusive(found, "a", "b", "distance", 7, 2).collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, want)) and len(want) > 10
    two = {}
    for a, b, d in sorted(pairs, key=lambda p: (p[2], p[1])):
        if d <= 7 and a not in (3, 4):
            two.setdefault(a, []).append((a, b, d))
    assert sorted(tuple(r) for r in found.where("a not in (3, 4)").collect()) == sorted(p for ps in two.values() for p in ps[:2])


def test_exclusive_assignment_makes_no_pairs(spark, tmp_path):
    from scorefield.plans import QUERIES

    spark.range(2000).selectExpr("id AS c_custkey", "'c' AS c_name", "1 AS c_nationkey").write.parquet(f"{tmp_path}/customer.parquet")
    spark.range(300).selectExpr("id AS s_suppkey", "'s' AS s_name", "1 AS s_nationkey").write.parquet(f"{tmp_path}/supplier.parquet")
    found = QUERIES["j18_assign_exclusive"](spark, str(tmp_path))
    pairs = spark.sql("SELECT c.id AS a, s.id AS b, abs((c.id * 37) % 1000 - (s.id * 91) % 1000) AS d FROM range(2000) c, range(300) s")
    assert sorted(map(tuple, found.collect())) == sorted(map(tuple, J.assign_exclusive(pairs, "a", "b", "d", 60, 15).collect()))
    assert most_joined(found) <= 2000
