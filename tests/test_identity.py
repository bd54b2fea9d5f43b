"""Identity: who a record is, which records are one, and whom a text names."""

import datetime as dt
import random

from pyspark.sql import functions as F

from scorefield.functions import scalars as S
from scorefield.operators import joins as J
from scorefield.operators import text_gates as G

D = dt.date


def resolve(spark, cands, canon, walk=(), members=()):
    c = spark.createDataFrame(cands, "k string, name string, birth date, event int")
    known = spark.createDataFrame(canon, "cid int, name string, birth date, year int")
    return {r["k"]: (r["cid"], r["outcome"]) for r in J.resolve_identity(c, spark.createDataFrame(list(walk), "k string, cid int"), known, "k", "name", "birth", "cid", "year", "event", spark.createDataFrame(list(members), "event int, cid int")).collect()}


def test_identity_by_the_first_rule_that_leaves_one(spark):
    canon = [(1, "José Ruiz", D(1990, 1, 1), None), (2, "Jose Ruiz", D(1991, 1, 1), None), (3, "Ann Lee", D(1980, 5, 5), None), (4, "Bo Ek", None, 1970), (5, "Jose-Luis Ruiz", D(1985, 2, 2), None), (6, "Cy Po", None, None), (7, "Cy Po", D(1999, 9, 9), None)]
    cands = [
        ("dated", "Jose Ruiz", D(1990, 1, 1), 1), ("undated", "Jose Ruiz", None, 1), ("other date", "Ann  Lee", D(1980, 9, 9), 1), ("none", "Xi Yu", None, 1), ("walked", "Ann Lee", None, 1),
        ("year", "Bo Ek", D(1970, 3, 4), 1), ("other year", "Bo Ek", D(1971, 3, 4), 1), ("variant", "Ruiz Jose Luis", D(1985, 2, 2), 1), ("variant undated", "Ruiz Jose Luis", None, 1), ("variant other", "Ruiz Jose Luis", D(1985, 2, 3), 1),
        ("in event", "Jose Ruiz", None, 9), ("in event, veto", "Ann Lee", D(1980, 9, 9), 9), ("in event, open", "Cy Po", D(2000, 1, 1), 9), ("in event, two", "Cy Po", None, 8), ("null", None, None, None),
    ]
    members = [(9, 1), (9, 3), (9, 6), (9, 7), (8, 6), (8, 7)]
    assert resolve(spark, cands, canon, [("walked", 9)], members) == {
        "dated": (1, "name_birth"), "undated": (None, "multiple_namesakes"), "other date": (None, "namesake_without_corroboration"), "none": (None, "new"), "walked": (9, "crosswalk"),
        "year": (4, "name_year"), "other year": (None, "namesake_without_corroboration"), "variant": (5, "variant_birth"), "variant undated": (None, "variant_without_birth"), "variant other": (None, "variant_without_birth"),
        "in event": (1, "name_event"), "in event, veto": (None, "namesake_without_corroboration"), "in event, open": (6, "name_event"), "in event, two": (None, "multiple_namesakes"), "null": (None, "new"),
    }


def test_a_common_name_makes_no_pairs(spark):
    n = 20_000
    canon = spark.range(n).select(F.col("id").alias("cid"), F.lit("Kim Min").alias("name"), F.date_add(F.lit("1900-01-01").cast("date"), F.col("id").cast("int")).alias("birth"))
    cands = spark.range(n).select(F.col("id").alias("k"), F.lit("Kim Min").alias("name"), F.date_add(F.lit("1900-01-01").cast("date"), F.col("id").cast("int")).alias("birth"))
    got = J.resolve_identity(cands, spark.createDataFrame([], "k long, cid long"), canon, "k", "name", "birth", "cid")
    assert got.where("cid = k and outcome = 'name_birth'").count() == n


def test_name_keys_of_variants_meet(spark):
    names = ["Nicolás Pérez", "Perez Nicolas", "Hwang You-min", "Youmin Hwang", "Jin Young Ko", "Ko Jin-young", "Sean O'Hair", "OHair Sean", "Pelé", "", None]
    rows = spark.createDataFrame([(n,) for n in names], "n string").select(S.name_keys("n").alias("k")).collect()
    keys = [set(r["k"]) if r["k"] is not None else None for r in rows]
    for i in range(0, 8, 2):
        assert keys[i] & keys[i + 1] and all(not keys[i] & keys[j] for j in range(8) if j // 2 != i // 2)
    assert keys[8:] == [{"pele"}, set(), None]


def decide(spark, rows):
    df = spark.createDataFrame(rows, "k int, name string, birth date, canon boolean")
    return {r["k"]: (r["decision"], r["target"], r["reasons"]) for r in J.merge_decisions(df, "k", "name", "birth", "canon").collect()}


def test_merge_decisions(spark):
    a, b = D(1990, 1, 1), D(1991, 1, 1)
    rows = [
        (1, "You-min Hwang", a, True), (2, "Hwang Youmin", a, None), (3, "Youmin Hwang", b, False), (4, "Hwang You Min", None, False),
        (10, "Bo Ek", a, True), (11, "Ek Bo", a, True), (12, "Bo Ek", a, False), (20, "Cy Po", a, False), (21, "Po Cy", a, False), (30, "Alone Here", a, True), (40, None, a, True), (50, "Di Fo", a, True), (51, "Fo Di", a, False),
    ]
    missing, differ, unclear = "birth_date_missing", "birth_dates_differ", "canonical_unclear"
    assert decide(spark, rows) == {
        1: ("keep", None, [missing, differ]), 2: ("merge", 1, [missing, differ]), 3: ("hold", None, [missing, differ]), 4: ("hold", None, [missing]),
        10: ("hold", None, [unclear]), 11: ("hold", None, [unclear]), 12: ("hold", None, [unclear]), 20: ("hold", None, [unclear]), 21: ("hold", None, [unclear]), 50: ("keep", None, []), 51: ("merge", 50, []),
    }


def test_families_reach_through_others(spark):
    """a b c, a bc and bc a, and cb a share keys in turn only: a chain of variants is one family."""
    a = D(1990, 1, 1)
    rows = [(1, "Jin Young Ko", a, True), (2, "Ko Jin-Young", a, False), (3, "Jinyoung Ko", a, False), (4, "Ko Young Jin", a, False), (5, "Young-Jin Ko", a, False), (6, "Youngjin Ko", a, False)]
    got = decide(spark, rows)
    assert got[1] == ("keep", None, []) and all(got[k] == ("merge", 1, []) for k in range(2, 7))


def test_a_block_of_equal_names_is_not_squared(spark):
    n = 100_000
    df = spark.range(n).select(F.col("id").alias("k"), F.lit("Kim Min").alias("name"), F.when(F.col("id") % 4 > 0, F.lit("1990-01-01").cast("date")).alias("birth"), (F.col("id") == 1).alias("canon"))
    got = {(r["decision"], r["target"], tuple(r["reasons"])): r["count"] for r in J.merge_decisions(df, "k", "name", "birth", "canon").groupBy("decision", "target", "reasons").count().collect()}
    assert got == {("keep", None, ("birth_date_missing",)): 1, ("merge", 1, ("birth_date_missing",)): n * 3 // 4 - 1, ("hold", None, ("birth_date_missing",)): n // 4}


def test_names_of_several_words_are_found_in_texts(spark):
    names = [("Ann Lee", 1), ("José Luis Ruiz", 2), ("Bo Ek", 3), ("Bo  Ek", 4), ("Pelé", 5), ("Sean O'Hair", 6), ("Di Fo", 7), (None, 8)]
    texts = [
        (1, "Watch Ann Lee and Jose Luis Ruiz: final round highlights", None), (2, "Joann Lee, Ann Leeds", None), (3, "bo ek", None), (4, "Pele; SEAN OHAIR!", None), (5, None, None), (6, "", None),
        (7, "The Masters 2024 round 2 highlights", D(2030, 1, 1)), (8, "Masters day", D(2025, 4, 20)), (9, "Masters with Di Fo", D(2025, 8, 1)), (10, "open championship", D(2025, 4, 14)), (11, "Masters and Open Championship", D(2025, 4, 16)),
    ]
    events = [(24, "The Masters", 2024, D(2024, 4, 11), D(2024, 4, 14)), (25, "Masters", 2025, D(2025, 4, 10), D(2025, 4, 13)), (25, "Augusta Week", 2025, D(2025, 4, 10), D(2025, 4, 13)), (26, "The Open Championship", 2025, D(2025, 4, 12), D(2025, 4, 15)), (27, "Cup", 2025, D(2025, 4, 12), D(2025, 4, 15))]
    t = spark.createDataFrame(texts, "id int, text string, at date")
    n, e = spark.createDataFrame(names, "name string, entity int"), spark.createDataFrame(events, "event int, event_name string, year int, start date, end date")
    got = {r["id"]: (r["family"], r["entities"], r["event"], r["basis"], r["period"], r["confidence"], r["status"]) for r in G.link_texts(t, "id", "text", {"highlights": "(?i)highlights"}, n, "name", "entity", "at", e, strong=["highlights"]).collect()}
    low = (None, [], None, None, None, "low", "review")
    assert got == {
        1: ("highlights", [1, 2], None, None, None, "low", "review"), 2: low, 3: low, 4: (None, [6], None, None, None, "medium", "published"), 5: low, 6: low,
        7: ("highlights", [], 24, "title_year", 2, "high", "published"), 8: (None, [], 25, "date_window", None, "medium", "published"), 9: (None, [7], None, None, None, "medium", "published"),
        10: (None, [], 26, "date_window", None, "medium", "published"), 11: low,
    }


def test_mentions_against_contains(spark):
    r = random.Random(3)
    word = lambda: r.choice(["a", "b", "ab", "ba", "c"])
    texts = [(i, " ".join(word() for _ in range(r.randint(0, 12)))) for i in range(150)]
    names = sorted({" ".join(word() for _ in range(r.randint(1, 4))) for _ in range(60)})
    want = sorted((i, n) for i, t in texts for n in names if f" {n} " in f" {t} ")
    got = G.mentions(spark.createDataFrame(texts, "id int, text string"), "id", "text", spark.createDataFrame([(n,) for n in names], "name string"), "name")
    assert sorted(map(tuple, got.collect())) == want
    assert G.mentions(spark.createDataFrame(texts, "id int, text string"), "id", "text", spark.createDataFrame([], "name string"), "name").count() == 0
