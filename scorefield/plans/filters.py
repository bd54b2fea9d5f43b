"""Queries of the filters, gates and classifications."""

from pyspark.sql import functions as F

from ..operators import filters as X
from .bindings import oracle, view
from .registry import query


def orders(spark, sf_dir):
    return view(spark, sf_dir, "results").withColumn("end_on", F.date_add("start_on", (F.col("entry_id") % 6).cast("int")))


ORD = "SELECT *, start_on + CAST(entry_id % 6 AS INT) AS end_on FROM results"


@query("src01_pruned_scan", oracle("SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderdate >= TIMESTAMP '1997-01-01'"))
def src01(spark, sf_dir):
    return view(spark, sf_dir, "orders").where("o_orderdate >= timestamp'1997-01-01'").select("o_orderkey", "o_totalprice")


@query("flt01_complete_only", oracle("SELECT event_id, entity_id, periods FROM entries WHERE periods IS NULL OR periods >= 2"))
def flt01(spark, sf_dir):
    return X.complete_only(view(spark, sf_dir, "entries").select("event_id", "entity_id", "periods"), "periods", 2)


@query("flt02_valid_scores", oracle("SELECT * FROM scores WHERE score BETWEEN 10 AND 45"))
def flt02(spark, sf_dir):
    return X.valid_scores(view(spark, sf_dir, "scores"), "score", 10, 45)


@query("flt03_drop_superseded", oracle("SELECT event_id FROM events WHERE json_extract(props, '$.superseded_by') IS NULL AND CAST(json_extract(props, '$.k') AS BIGINT) < 50"))
def flt03(spark, sf_dir):
    e = view(spark, sf_dir, "events").select("event_id", "props")
    return X.drop_superseded(e, "props").where(F.get_json_object("props", "$.k").cast("long") < 50).select("event_id")


@query("flt04_drop_merged", oracle("SELECT event_id, entity_id FROM entries WHERE entity_id % 10 <> 3"))
def flt04(spark, sf_dir):
    e = view(spark, sf_dir, "entries").select("event_id", "entity_id")
    merged = view(spark, sf_dir, "supplier").where("s_suppkey % 10 = 3").select(F.col("s_suppkey").alias("entity_id"))
    return X.drop_merged({"entries": e}, merged, "entity_id")["entries"]


@query("flt05_coverage", oracle("""WITH v AS (SELECT DISTINCT event_id + event_id % 2 * 100000 AS event_id, 20 + event_id % 60 AS declared FROM scores), n AS (SELECT event_id, count(*) AS stored FROM entries GROUP BY 1)
SELECT v.event_id, declared, coalesce(stored, 0) AS stored, CASE WHEN stored IS NULL THEN 'schedule_only' WHEN stored < 0.8 * declared THEN 'partial' ELSE 'full_field' END AS label FROM v LEFT JOIN n USING (event_id)"""))
def flt05(spark, sf_dir):
    v = view(spark, sf_dir, "scores").select((F.col("event_id") + F.col("event_id") % 2 * 100000).alias("event_id"), (F.col("event_id") % 60 + 20).alias("declared"), F.lit("full_field").alias("label")).distinct()
    return X.coverage(v, view(spark, sf_dir, "entries"), "event_id", "declared", "label")


@query("flt06_clean_stat", oracle("SELECT entity_id, season, code, CASE WHEN NOT (code IN ('1-URGENT', '2-HIGH') AND value - 1 = 0 AND rank IS NULL) THEN value - 1 END AS value FROM stats"))
def flt06(spark, sf_dir):
    s = view(spark, sf_dir, "stats").withColumn("value", F.col("value") - 1)
    return X.clean_stat(s, "code", "value", "rank", ["1-URGENT", "2-HIGH"]).drop("rank")


@query("flt07_event_status", oracle(f"SELECT entry_id, CASE WHEN start_on > DATE '1997-06-15' THEN 'scheduled' WHEN end_on < DATE '1997-06-15' THEN 'completed' ELSE 'in_progress' END AS status FROM ({ORD})"))
def flt07(spark, sf_dir):
    return orders(spark, sf_dir).select("entry_id", X.event_status("start_on", "end_on", "1997-06-15").alias("status"))


@query("flt08_event_state", oracle(f"SELECT entry_id, CASE WHEN start_on <= date_trunc('week', DATE '1997-06-15') + INTERVAL 6 DAY AND end_on >= date_trunc('week', DATE '1997-06-15') THEN 'this_week' WHEN start_on > DATE '1997-06-15' THEN 'upcoming' ELSE 'completed' END AS state FROM ({ORD})"))
def flt08(spark, sf_dir):
    return orders(spark, sf_dir).select("entry_id", X.event_state("start_on", "end_on", "1997-06-15").alias("state"))


@query("flt09_live_state", oracle("""WITH n AS (SELECT max(ts) AS t FROM events), e AS (SELECT event_id, ['final', 'suspended', 'pre', 'end_period', 'in', 'odd'][event_id % 6 + 1] AS s, (epoch(TIMESTAMP '2024-01-20') - epoch(ts)) // 1 / 60.0 / 300 AS age, event_id % 3 AS posted FROM events)
SELECT event_id, CASE WHEN s = 'final' THEN 'final' WHEN age > 60 THEN 'unavailable' WHEN s = 'suspended' THEN CASE WHEN age <= 20 THEN 'suspended' ELSE 'stale' END WHEN s = 'pre' THEN 'pre' WHEN s = 'end_period' THEN CASE WHEN age <= 20 THEN 'round_complete' ELSE 'stale' END WHEN s = 'in' AND posted > 0 THEN CASE WHEN age <= 5 THEN 'live' ELSE 'stale' END WHEN s = 'in' THEN 'pre' ELSE 'unavailable' END AS state FROM e"""))
def flt09(spark, sf_dir):
    e = view(spark, sf_dir, "events").select("event_id", F.element_at(F.array(*(F.lit(x) for x in ("final", "suspended", "pre", "end_period", "in", "odd"))), (F.col("event_id") % 6 + 1).cast("int")).alias("s"), "ts", (F.col("event_id") % 3).alias("posted"))
    return e.select("event_id", X.live_state("s", "ts", "2024-01-20", "posted", (5 * 300, 20 * 300, 60 * 300)).alias("state"))


@query("flt10_facet", oracle("SELECT entry_id FROM results WHERE kind = '1-URGENT' AND season = 1996"))
def flt10(spark, sf_dir):
    return X.facet(view(spark, sf_dir, "results"), kind="1-URGENT", season=1996).select("entry_id")


@query("flt11_search", oracle("""WITH n AS (SELECT p_partkey, p_name, p_size, trim(regexp_replace(lower(p_name), '[^a-z0-9]+', ' ', 'g')) AS n FROM part), s AS (SELECT *, CASE WHEN n = 'blue bo' THEN 100 WHEN starts_with(n, 'blue bo') THEN 80 WHEN len(list_filter(string_split(n, ' '), lambda w: starts_with(w, 'blue'))) > 0 AND len(list_filter(string_split(n, ' '), lambda w: starts_with(w, 'bo'))) > 0 THEN 60 WHEN contains(n, 'blue bo') THEN 40 END + least(10.0, p_size / 5.0) AS score FROM n)
SELECT p_partkey, CAST(score AS DOUBLE) AS score FROM s WHERE score IS NOT NULL ORDER BY score DESC, p_name, p_partkey LIMIT 12"""))
def flt11(spark, sf_dir):
    return X.search(view(spark, sf_dir, "part").select("p_partkey", "p_name", "p_size"), "Blue bo", "p_partkey", "p_name", "p_size").select("p_partkey", "score")


@query("flt12_approved_only", oracle("SELECT l_orderkey, l_linenumber FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey WHERE n_regionkey = 2"))
def flt12(spark, sf_dir):
    li = view(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.col("l_suppkey").alias("s_suppkey"))
    good = view(spark, sf_dir, "nation").where("n_regionkey = 2").select(F.col("n_nationkey").alias("s_nationkey"))
    return X.approved_only(li, view(spark, sf_dir, "supplier"), good, "s_suppkey", "s_nationkey").drop("s_suppkey")


@query("flt13_has_provenance", oracle("SELECT c_custkey FROM src_b WHERE c_mktsegment IS NOT NULL AND cents IS NOT NULL"))
def flt13(spark, sf_dir):
    return X.has_provenance(view(spark, sf_dir, "src_b"), ["c_mktsegment", "cents"]).select("c_custkey")


@query("flt14_licence_verdict", oracle("""SELECT doc_id, CASE WHEN regexp_matches(text, 'All rights reserved') THEN 'deny:reserved' WHEN regexp_matches(text, 'BY-NC') THEN 'deny:non_commercial' WHEN regexp_matches(text, 'MIT License') THEN 'allow:mit' WHEN regexp_matches(text, 'CC BY|CC0') THEN 'allow:cc' ELSE 'unknown' END AS verdict FROM documents"""))
def flt14(spark, sf_dir):
    return view(spark, sf_dir, "documents").select("doc_id", X.licence_verdict("text", {"reserved": "All rights reserved", "non_commercial": "BY-NC"}, {"mit": "MIT License", "cc": "CC BY|CC0"}).alias("verdict"))


@query("flt15_classify_text", oracle(r"""SELECT doc_id, CASE WHEN regexp_matches(text, '[\w.]+@[\w.]+') THEN 'contact' WHEN regexp_matches(text, '[A-Z]{4,}!!') THEN 'shout' WHEN regexp_matches(text, '\d{3,}') THEN 'number' END AS family, CASE WHEN regexp_matches(text, '[\w.]+@[\w.]+') THEN regexp_extract(text, '[\w.]+@[\w.]+') WHEN regexp_matches(text, '[A-Z]{4,}!!') THEN regexp_extract(text, '[A-Z]{4,}!!') WHEN regexp_matches(text, '\d{3,}') THEN regexp_extract(text, '\d{3,}') END AS evidence FROM documents"""))
def flt15(spark, sf_dir):
    return view(spark, sf_dir, "documents").select("doc_id", X.classify_text("text", {"contact": r"[\w.]+@[\w.]+", "shout": "[A-Z]{4,}!!", "number": r"\d{3,}"}).alias("c")).select("doc_id", "c.*")


@query("flt16_resolve_key", oracle("SELECT entity_id, CASE WHEN entity_id % 3 = 0 THEN 'a' || entity_id % 7 WHEN entity_id % 5 = 0 THEN 'b' ELSE 'unassigned' END AS k FROM cohort"))
def flt16(spark, sf_dir):
    c = view(spark, sf_dir, "cohort").select("entity_id")
    a = c.where("entity_id % 3 = 0").withColumn("k", F.concat(F.lit("a"), (F.col("entity_id") % 7).cast("string")))
    return X.resolve_key(c, [(a, "entity_id"), (c.where("entity_id % 5 = 0").withColumn("k", F.lit("b")), "entity_id")], "k")


@query("flt17_outcome", oracle("SELECT event_id, entity_id, CASE WHEN status = 'cut' AND event_id % 2 = 0 THEN 'missed_cut' ELSE 'finished' END AS outcome FROM entries"))
def flt17(spark, sf_dir):
    return view(spark, sf_dir, "entries").withColumn("real", F.col("event_id") % 2 == 0).select("event_id", "entity_id", X.outcome("status", "real").alias("outcome"))


@query("flt18_in_window", oracle(f"SELECT entry_id FROM ({ORD}) WHERE start_on - 1 <= DATE '1997-06-15' AND end_on + 2 >= DATE '1997-06-15'"))
def flt18(spark, sf_dir):
    return X.in_window(orders(spark, sf_dir), "start_on", "end_on", "1997-06-15", 1, 2).select("entry_id")


@query("flt19_needs_refresh", oracle("SELECT event_id, event_type = 'click' OR event_id % 50 <= 10 OR epoch(TIMESTAMP '2024-01-20') - floor(epoch(ts)) >= 86400 AS refresh FROM events"))
def flt19(spark, sf_dir):
    e = view(spark, sf_dir, "events").select("event_id", F.when(F.col("event_type") == "click", "in").otherwise("x").alias("s"), (F.col("event_id") % 50).alias("p"), "ts")
    return e.select("event_id", X.needs_refresh("s", "p", "ts", "2024-01-20", 1440).alias("refresh"))


@query("flt20_validate_rows", oracle("SELECT l_orderkey, l_linenumber, array_to_string(list_filter([CASE WHEN NOT l_quantity < 40 THEN 'quantity' END, CASE WHEN NOT l_discount < 0.09 THEN 'discount' END], lambda x: x IS NOT NULL), ',') AS violations FROM lineitem"))
def flt20(spark, sf_dir):
    v = X.validate_rows(view(spark, sf_dir, "lineitem"), {"quantity": F.col("l_quantity") < 40, "discount": F.col("l_discount") < 0.09})
    return v.select("l_orderkey", "l_linenumber", F.array_join("violations", ",").alias("violations"))


@query("flt21_complete_card", oracle("""WITH c AS (SELECT l_orderkey, CAST(sum(CAST(l_quantity AS BIGINT)) AS BIGINT) AS total, count(*) = 4 AND count(DISTINCT l_linenumber) = 4 AND min(l_linenumber) = 1 AND max(l_linenumber) = 4 AS complete FROM lineitem GROUP BY 1)
SELECT l_orderkey, total, complete, CASE WHEN total = o_custkey % 200 THEN 'accepted' ELSE 'hold' END AS verdict FROM c LEFT JOIN orders ON l_orderkey = o_orderkey"""))
def flt21(spark, sf_dir):
    card = X.complete_card(view(spark, sf_dir, "lineitem").withColumn("q", F.col("l_quantity").cast("long")), ["l_orderkey"], "l_linenumber", "q", 4)
    stated = view(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("l_orderkey"), (F.col("o_custkey") % 200).alias("stated"))
    return X.reconciled_total(card, stated, "l_orderkey", "total", "stated").drop("stated")


@query("flt22_notable", oracle("SELECT event_id, entity_id FROM entries WHERE total >= 90 OR position = 1"))
def flt22(spark, sf_dir):
    return X.notable(view(spark, sf_dir, "entries").withColumn("won", F.col("position") == 1), "total", "won").select("event_id", "entity_id")


@query("flt23_known_coords", oracle("SELECT s_suppkey, CASE WHEN s_suppkey % 3 > 0 AND s_suppkey % 4 > 0 THEN s_suppkey % 90 END AS lat, CASE WHEN s_suppkey % 3 > 0 AND s_suppkey % 4 > 0 THEN s_suppkey % 180 END AS lon FROM supplier"))
def flt23(spark, sf_dir):
    s = view(spark, sf_dir, "supplier").selectExpr("s_suppkey", "CASE WHEN s_suppkey % 3 > 0 THEN s_suppkey % 90 END AS lat", "CASE WHEN s_suppkey % 4 > 0 THEN s_suppkey % 180 END AS lon")
    return X.known_coords(s, "lat", "lon")


@query("flt24_signal_available", oracle("""WITH v AS (SELECT event_id % 12 AS venue_id, count(DISTINCT event_id) AS events, count(DISTINCT entity_id) AS entities, count(*) AS n FROM scores GROUP BY 1) SELECT venue_id, NOT (events < 3 OR entities < 50 OR n < 100) AS available, CASE WHEN events < 3 THEN 'events' WHEN entities < 50 THEN 'entities' WHEN n < 100 THEN 'scores' END AS reason FROM v"""))
def flt24(spark, sf_dir):
    v = view(spark, sf_dir, "scores").groupBy((F.col("event_id") % 12).alias("venue_id")).agg(F.count_distinct("event_id").alias("events"), F.count_distinct("entity_id").alias("entities"), F.count("*").alias("n"))
    return v.select("venue_id", X.signal_available("events", "entities", "n").alias("s")).select("venue_id", "s.*")
