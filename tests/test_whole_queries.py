"""Queries over whole tables: rows that the narrower queries of the same operator leave out."""

import re

from scorefield.functions import scalars as S
from scorefield.plans import QUERIES


def test_fold_documents_takes_every_row_and_the_whole_text(spark, tmp_path):
    import hashlib

    docs = [(1, "a" * 70 + " Élan", "en"), (2, "Ñandú -- Ō9", "de"), (3, "šŽ x", None), (4, None, "fr"), (5, "", "zh")]
    spark.createDataFrame(docs, "doc_id long, text string, lang string").write.parquet(f"{tmp_path}/documents.parquet")
    table = str.maketrans(S.ACCENTED, S.PLAIN)
    fold = lambda t: re.sub("[^a-z0-9]+", " ", t.translate(table).lower()).strip(" ")
    want = {i: None if t is None else hashlib.md5(fold(t).encode()).hexdigest() for i, t, _ in docs}
    assert {r["doc_id"]: r["folded"] for r in QUERIES["f01_f02_fold_slug"](spark, str(tmp_path)).collect()} == want


def test_draws_take_every_event_and_period(spark):
    from scorefield.plans.bindings import view

    sf = "/root/testdata/sf0.001"
    field = view(spark, sf, "scores").select("event_id", "entity_id", "period")
    got = QUERIES["d01_bootstrap_draws"](spark, sf)
    assert got.groupBy("event_id", "entity_id", "period").count().where("count = 8").count() == field.count() == field.distinct().count()
    events = field.select("event_id").distinct().count()
    assert events > 2
    for name in ("d02_draw_outcomes", "d03_pair_probability"):
        assert QUERIES[name](spark, sf).select("event_id").distinct().count() > 2
    assert QUERIES["d02_draw_outcomes"](spark, sf).select("event_id").distinct().count() == events


def test_pairs_events_and_parts_are_not_chosen_by_key(spark):
    from scorefield.plans.bindings import view

    sf = "/root/testdata/sf0.001"
    entries = view(spark, sf, "entries")
    for name in ("j21_common_dims", "s05_shared_keys"):
        assert QUERIES[name](spark, sf).select("a").distinct().count() == entries.select("entity_id").distinct().count() - 1
    assert QUERIES["p03_field_context"](spark, sf).count() == entries.select("event_id").distinct().count()
    assert QUERIES["f14_f15_route"](spark, sf).count() == view(spark, sf, "part").count()
