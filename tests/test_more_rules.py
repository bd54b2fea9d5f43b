"""Editions, ledger audit, champions' facts and the rules of whole drafts by hand."""

import datetime as dt

from pyspark.sql import functions as F

from scorefield.operators import joins as J
from scorefield.operators import ledger as L
from scorefield.operators import studies as U
from scorefield.operators import text_gates as G

D = dt.date(2026, 4, 12)
EDITION = "e string, name string, end date, year int, canonical boolean, provider string, division string, superseded boolean"


def match(spark, events, editions):
    a = spark.createDataFrame(events, "k string, name string, end date, year int, division string")
    b = spark.createDataFrame(editions, EDITION)
    return {r["k"]: (r["match"], r["basis"], r["superseded"]) for r in J.match_editions(a, b, "k", "e", "name", "end", "year", "canonical", "provider", "division", "superseded").collect()}


def test_canonical_editions_win_and_duplicates_give_way(spark):
    editions = [("wd", "2026 Masters Tournament", D, 2026, True, None, "men", None), ("dup", "2026 Masters Tournament", D, 2026, False, None, "men", False), ("own", "Masters Tournament", D, 2026, None, "7", "men", None), ("gone", "Masters", D, 2026, True, None, "men", True), ("far", "Masters", D + dt.timedelta(days=3), 2026, True, None, "men", None), ("old", "Masters", D.replace(year=2025), 2025, True, None, "men", None)]
    assert match(spark, [("7", "Masters Tournament", D, 2026, "men")], editions) == {"7": ("wd", "canonical", ["dup", "own"])}
    assert match(spark, [("7", "Masters Tournament", D, 2026, "men")], editions[1:]) == {"7": ("own", "exact_id", [])}
    assert match(spark, [("8", "The Masters", D + dt.timedelta(days=1), 2026, "men"), ("9", "Open Championship", D, 2026, "men"), ("10", None, None, None, None)], editions[1:2]) == {"8": ("dup", "unique", []), "9": (None, None, []), "10": (None, None, [])}
    two = [("a", "Valley Cup", D, 2026, None, None, "men", None), ("b", "Valley Cup", D, 2026, None, None, "women", None)]
    assert match(spark, [("1", "Valley Cup", D, 2026, "women"), ("2", "Valley Cup", D, 2026, None)], two) == {"1": ("b", "unique", []), "2": (None, None, [])}
    both = [(*two[0][:4], True, *two[0][5:]), (*two[1][:4], True, *two[1][5:])]
    assert match(spark, [("1", "Valley Cup", D, 2026, "women")], both) == {"1": ("b", "unique", [])}


def test_grades_of_another_lock(spark):
    probs = spark.createDataFrame([(i, 0.5) for i in range(4)], "id int, p double")
    locks = L.lock(probs, probs.select("id", F.lit(True).alias("ready")), "id", "id", "2026-01-01 00:00:00")
    seals = {r["id"]: r["seal"] for r in locks.collect()}
    grades = spark.createDataFrame([(0, seals[0]), (1, seals[0]), (2, seals[2]), (2, "x")], "id int, seal string")
    events = spark.createDataFrame([(i, dt.datetime(2026, 2, 1), True) for i in range(4)], "id int, starts_at timestamp, over boolean")
    assert sorted(map(tuple, L.audit_ledger(locks, grades, events, "id", "id").collect())) == [(1, "wrong_lock"), (2, "wrong_lock"), (3, "missing_grade")]


def test_facts_about_a_champion(spark):
    marks = {1: [-1] * 4 + [0] * 14, 2: [0] * 7 + [-1, -1, -1, -2] + [1] + [0] * 6}  # the run of four crosses the turn: two and two
    items = [(1, 7, p, i + 1, v, 3 if i < 9 else 4) for p, vs in marks.items() for i, v in enumerate(vs)] + [(1, 8, 2, 1, -1, 3)]
    scores = [(1, 7, 1, -4), (1, 7, 2, -4), (1, 8, 1, -6), (1, 8, 2, 0), (1, 9, 1, 0), (1, 9, 2, -5), (1, 10, 1, -9), (1, 10, 2, None)]
    frame = lambda rows, schema: spark.createDataFrame(rows, schema)
    found = U.champion_facts(
        frame([(1, 7)], "event_id int, entity_id int"), frame(scores, "event_id int, entity_id int, period int, to_par int"), frame(items, "event_id int, entity_id int, period int, item int, to_par int, item_class int"),
        frame([(7, 3, 85), (7, 4, 99)], "entity_id int, item_class int, percentile int"), 2,
    )
    got = {r["fact"]: r["value"] for r in found.collect()}
    assert got == {"after_1": -4, "spread": 0, "ahead_entering": 2, "within_three": 2, "front": -2, "back": -2, "closing": 0, "birdies": 3, "eagles": 1, "bogeys": 1, "class_3": -6, "class_4": -2, "metric_match": 3}
    cards = frame([r for r in items if r[3] != 18 or r[2] == 1], "event_id int, entity_id int, period int, item int, to_par int, item_class int")
    less = {r["fact"] for r in U.champion_facts(frame([(1, 7)], "event_id int, entity_id int"), frame(scores, "event_id int, entity_id int, period int, to_par int"), cards, frame([], "entity_id int, item_class int, percentile int"), 2).collect()}
    assert less == {"after_1", "spread", "ahead_entering", "within_three"}


def test_rules_of_whole_drafts(spark):
    body, dek = "word " * 40, "A quiet start for the field, and one clear leader by the evening."
    drafts = [
        (1, "{e:p1} leads at {f:where}", dek, body + "as she did before", "she", ["a", "none"], ["trend"]), (2, "Ann Lee leads after the first day", dek, body + "as He did", "she", None, []),
        (3, "Nobody leads after the first day", dek, body + "her lead", None, ["zz"], ["map", "none"]), (4, "{e:p1}", dek, body, "he", [], None), (5, "A day without any subject at all", dek, body + "theirs and heroes", None, None, None),
    ]
    d = spark.createDataFrame(drafts, "k int, headline string, dek string, text string, who string, em array<string>, charts array<string>")
    facts = spark.createDataFrame([(k, f, v) for k in range(1, 6) for f, v in (("a", "1"), ("where", "Augusta National"))], "k int, fact_id string, display string")
    entities = spark.createDataFrame([(k, "p1", "Ann Lee") for k in range(1, 6)], "k int, entity_key string, name string")
    charts = spark.createDataFrame([(1, "trend"), (3, "trend")], "k int, chart string")
    subjects = spark.createDataFrame([(k, "Ann Lee") for k in (1, 2, 3, 4)] + [(1, None), (2, "Bo Ek")], "k int, name string")
    found = G.text_gates(d, facts, "k", "text", {}, entities=entities, headline="headline", dek="dek", pronoun="who", emphasis="em", modules="charts", charts=charts, subjects=subjects)
    assert {r["k"]: r["reasons"] for r in found.collect()} == {1: [], 2: ["pronoun"], 3: ["pronoun", "unknown_emphasis", "unknown_module", "headline_without_subject"], 4: ["headline_length"], 5: []}
