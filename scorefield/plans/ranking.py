"""Queries of the orders, limits and top-k."""

from pyspark.sql import functions as F

from ..operators import filters as X
from ..operators import ranking as T
from .bindings import oracle, view
from .filters import ORD, orders
from .registry import query

STATE = "CASE WHEN start_on <= date_trunc('week', DATE '1997-06-15') + INTERVAL 6 DAY AND end_on >= date_trunc('week', DATE '1997-06-15') THEN 'this_week' WHEN start_on > DATE '1997-06-15' THEN 'upcoming' ELSE 'completed' END"


@query("t01_board_order", oracle("SELECT event_id, entity_id, row_number() OVER (PARTITION BY event_id ORDER BY CASE status WHEN 'finished' THEN 0 WHEN 'cut' THEN 1 ELSE 99 END, position NULLS LAST, total NULLS LAST, entity_id) AS place FROM entries"))
def t01(spark, sf_dir):
    e = view(spark, sf_dir, "entries")
    return T.keep_first(e, ["event_id"], T.board_order(e, {"finished": 0, "cut": 1}, "status", "position", "total", "entity_id"), 1 << 30, "place").select("event_id", "entity_id", "place")


@query("t02_directory", oracle("SELECT kind, count(*) AS n FROM results GROUP BY 1"))
def t02(spark, sf_dir):
    return T.directory(view(spark, sf_dir, "results"), ["kind"], "kind")


@query("t03_upcoming", oracle(f"SELECT entry_id FROM ({ORD}) WHERE start_on > DATE '1997-06-15' ORDER BY start_on, entry_id LIMIT 12"))
def t03(spark, sf_dir):
    return T.top_k(orders(spark, sf_dir).where("start_on > date'1997-06-15'"), [F.col("start_on"), F.col("entry_id")], 12).select("entry_id")


@query("t04_now_next", oracle(f"""WITH s AS (SELECT kind, entry_id, start_on, {STATE} AS state FROM ({ORD})), k AS (SELECT *, row_number() OVER (PARTITION BY kind, state ORDER BY start_on, entry_id) AS a, row_number() OVER (PARTITION BY kind, state ORDER BY start_on DESC, entry_id DESC) AS b FROM s),
r AS (SELECT kind, entry_id, CASE WHEN state = 'this_week' THEN 'now' WHEN state = 'upcoming' AND a = 1 THEN 'next' WHEN state = 'upcoming' AND a <= 4 THEN 'later' WHEN state = 'completed' AND b = 1 THEN 'last' END AS role FROM k) SELECT * FROM r WHERE role IS NOT NULL"""))
def t04(spark, sf_dir):
    o = orders(spark, sf_dir).withColumn("state", X.event_state("start_on", "end_on", "1997-06-15"))
    return T.now_next(o, "kind", "state", "start_on", "entry_id").select("kind", "entry_id", "role")


@query("t05_top_per_group", oracle("SELECT kind, entry_id, k FROM (SELECT kind, entry_id, row_number() OVER (PARTITION BY kind ORDER BY status, points DESC, entry_id) AS k FROM results) WHERE k <= 5"))
def t05(spark, sf_dir):
    return T.keep_first(view(spark, sf_dir, "results"), ["kind"], [F.col("status"), F.col("points").desc(), F.col("entry_id")], 5, "k").select("kind", "entry_id", "k")


@query("t06_priority_order", oracle("SELECT entry_id FROM results ORDER BY status = 'O' DESC, points > 200000 DESC, season DESC, kind, entry_id LIMIT 50"))
def t06(spark, sf_dir):
    order = [(F.col("status") == "O").desc(), (F.col("points") > 200000).desc(), F.col("season").desc(), F.col("kind"), F.col("entry_id")]
    return T.top_k(view(spark, sf_dir, "results"), order, 50).select("entry_id")


@query("t07_keep_last", oracle("SELECT entity, tick FROM (SELECT entity, tick, row_number() OVER (PARTITION BY entity ORDER BY tick DESC) AS k FROM ticks) WHERE k <= 4"))
def t07(spark, sf_dir):
    return T.keep_first(view(spark, sf_dir, "ticks"), ["entity"], [F.col("tick").desc()], 4).select("entity", "tick")


@query("t08_greedy_select", oracle("""WITH a AS (SELECT season, event_id * 10 + entity_id AS id, family, mille FROM probs), k0 AS (SELECT season, id, family, row_number() OVER (PARTITION BY season ORDER BY mille DESC, id) AS k FROM a WHERE family = 0), s0 AS (SELECT season, id, family FROM k0 WHERE k <= 1),
k1 AS (SELECT season, id, family, row_number() OVER (PARTITION BY season ORDER BY mille DESC, id) AS k FROM a WHERE family = 1 AND mille >= 20 AND (season, id) NOT IN (SELECT (season, id) FROM s0)), s1 AS (SELECT season, id, family FROM k1 WHERE k <= 3) SELECT * FROM s0 UNION ALL SELECT * FROM s1"""))
def t08(spark, sf_dir):
    p = view(spark, sf_dir, "probs").select("season", (F.col("event_id") * 10 + F.col("entity_id")).alias("id"), "family", "mille")
    return T.greedy_select(p, [(0, 1, 0), (1, 3, 20)], "season", "id", "family", "mille").drop("mille")


@query("t09_neighbour_pairs", oracle("""WITH k AS (SELECT event_id, entity_id, row_number() OVER (PARTITION BY event_id ORDER BY total, entity_id) AS n FROM entries) SELECT a.event_id, a.entity_id AS a, b.entity_id AS b FROM k a JOIN k b ON a.event_id = b.event_id AND b.n = a.n + 1 WHERE a.n % 2 = 1 AND b.n <= 40"""))
def t09(spark, sf_dir):
    return T.neighbour_pairs(view(spark, sf_dir, "entries"), ["event_id"], [F.col("total"), F.col("entity_id")], "entity_id")


@query("t10_pick_series", oracle("""WITH p AS (SELECT entity_id % 5 AS g, event_id AS ts, entity_id, rank() OVER (PARTITION BY entity_id % 5, event_id ORDER BY total) AS position FROM entries), l AS (SELECT *, max(ts) OVER (PARTITION BY g) AS last FROM p), a AS (SELECT g, entity_id, min(position) FILTER (ts = last) AS now, min(position) AS best FROM l GROUP BY 1, 2)
SELECT g, entity_id FROM (SELECT *, row_number() OVER (PARTITION BY g ORDER BY now NULLS LAST, best, entity_id) AS k FROM a WHERE now <= 5 OR best = 1) WHERE k <= 7"""))
def t10(spark, sf_dir):
    p = view(spark, sf_dir, "entries").selectExpr("entity_id % 5 AS g", "event_id AS ts", "entity_id", "rank() OVER (PARTITION BY entity_id % 5, event_id ORDER BY total) AS position")
    return T.pick_series(p, ["g"], "ts", "entity_id", "position").select("g", "entity_id")


@query("t11_best_by_score", oracle("""WITH s AS (SELECT entity_id, entry_id, CASE WHEN status = 'F' THEN 2 ELSE 0 END + CASE WHEN points > 150000 THEN 3 ELSE 0 END AS score FROM results) SELECT entity_id, entry_id, score FROM (SELECT *, row_number() OVER (PARTITION BY entity_id ORDER BY score DESC, entry_id) AS k FROM s WHERE score >= 3) WHERE k = 1"""))
def t11(spark, sf_dir):
    return T.best_by_score(view(spark, sf_dir, "results"), ["entity_id"], [(F.col("status") == "F", 2), (F.col("points") > 150000, 3)], 3, "entry_id").select("entity_id", "entry_id", "score")


@query("t12_extremes", oracle("WITH m AS (SELECT *, min(score) OVER (PARTITION BY event_id) AS low FROM scores) SELECT event_id, low, min(entity_id) AS key, count(*) AS shared FROM m WHERE score = low GROUP BY 1, 2"))
def t12(spark, sf_dir):
    return T.extremes(view(spark, sf_dir, "scores"), ["event_id"], "score", "entity_id")


@query("t13_order_events", oracle("SELECT event_id, row_number() OVER (ORDER BY event_id % 3, count(*) DESC, event_id) AS place FROM entries GROUP BY event_id ORDER BY place LIMIT 20"))
def t13(spark, sf_dir):
    e = view(spark, sf_dir, "entries").groupBy("event_id").agg(F.count("*").alias("n")).withColumn("g", F.lit(1))
    return T.keep_first(e, ["g"], [F.col("event_id") % 3, F.col("n").desc(), F.col("event_id")], 20, "place").select("event_id", "place")


@query("t14_tail_since", oracle("SELECT event_id FROM events WHERE ts > TIMESTAMP '2024-01-10' ORDER BY ts DESC, event_id DESC LIMIT 400"))
def t14(spark, sf_dir):
    return T.tail_since(view(spark, sf_dir, "events"), "ts", "2024-01-10", 400, "event_id").select("event_id")


@query("t15_review_queue", oracle("SELECT * FROM (SELECT p_partkey, array_to_string(list_filter([CASE WHEN p_size > 45 THEN 'large' END, CASE WHEN p_retailprice < 950 THEN 'cheap' END], lambda x: x IS NOT NULL), ',') AS flags FROM part) WHERE flags <> ''"))
def t15(spark, sf_dir):
    q = T.review_queue(view(spark, sf_dir, "part").select("p_partkey", "p_size", "p_retailprice"), {"large": F.col("p_size") > 45, "cheap": F.col("p_retailprice") < 950}, "p_partkey")
    return q.select("p_partkey", F.array_join("flags", ",").alias("flags"))


@query("t16_diverse_top_k", oracle("""WITH f AS (SELECT *, row_number() OVER (PARTITION BY entity_id, kind ORDER BY points DESC, entry_id) = 1 AS first FROM results) SELECT entity_id, entry_id FROM (SELECT *, row_number() OVER (PARTITION BY entity_id ORDER BY first DESC, points DESC, entry_id) AS k FROM f) WHERE k <= 3"""))
def t16(spark, sf_dir):
    return T.diverse_top_k(view(spark, sf_dir, "results"), ["entity_id"], "kind", [F.col("points").desc()], "entry_id").select("entity_id", "entry_id")


@query("t17_dimension_picks", oracle("""WITH m AS (SELECT entity_id, code AS metric, sum(value) AS sample, (sum(value) * 17 + entity_id) % 101 AS pct FROM stats GROUP BY 1, 2), t AS (SELECT *, CASE WHEN sample >= 6 THEN 3 WHEN sample >= 3 THEN 2 WHEN sample >= 2 THEN 1 ELSE 0 END AS t FROM m)
SELECT entity_id, arg_max(metric, (pct, metric)) AS best, arg_max(metric, (t, sample, pct, metric)) AS reliable, coalesce(string_agg(metric, ',' ORDER BY metric) FILTER (pct >= 75 AND t >= 2), '') AS strengths FROM t GROUP BY 1"""))
def t17(spark, sf_dir):
    from ..functions.scalars import tier

    m = view(spark, sf_dir, "stats").groupBy("entity_id", F.col("code").alias("metric")).agg(F.sum("value").alias("sample")).withColumn("pct", (F.col("sample") * 17 + F.col("entity_id")) % 101).withColumn("tier", tier("events", "sample"))
    return T.dimension_picks(m, "entity_id", "metric", "tier", "sample", "pct")


@query("t18_group_directory", oracle(f"""SELECT entity_id, arg_min(entry_id, (start_on, entry_id)) FILTER (start_on > DATE '1997-06-15') AS next, arg_max(entry_id, (end_on, entry_id)) FILTER (end_on < DATE '1997-06-15') AS last, count(*) FILTER (start_on <= DATE '1997-06-15' AND end_on >= DATE '1997-06-15') AS in_progress
FROM ({ORD}) GROUP BY 1 ORDER BY in_progress > 0 DESC, min(start_on) FILTER (start_on > DATE '1997-06-15') NULLS LAST, max(end_on) FILTER (end_on < DATE '1997-06-15') DESC NULLS LAST, entity_id LIMIT 8"""))
def t18(spark, sf_dir):
    return T.group_directory(orders(spark, sf_dir), "entity_id", "start_on", "end_on", "entry_id", "1997-06-15").select("entity_id", "next", "last", "in_progress")
