"""Queries of the composed studies and what is left of the scalar functions and checks."""

from pyspark.sql import functions as F

from ..functions import scalars as S
from ..operators import ledger as L
from ..operators import sets as O
from ..operators import studies as U
from ..streaming import tape as ST
from .bindings import oracle, view
from .registry import query
from .streams import in_slices, shared
from .windows import AFTER, ROLL


@query("p09_audit_ledger", oracle("WITH p AS (SELECT event_id * 10 + entity_id AS id, min(season) AS season, max(hit) AS hit FROM probs GROUP BY 1) SELECT id, 'late' AS problem FROM p WHERE season >= 1998 UNION ALL SELECT id, 'missing_grade' FROM p WHERE hit = 1 UNION ALL SELECT id, 'wrong_lock' FROM p WHERE hit = 0 AND id % 5 = 0"))
def p09(spark, sf_dir):
    p = view(spark, sf_dir, "probs").selectExpr("event_id * 10 + entity_id AS id", "mille", "season", "hit").groupBy("id").agg(F.min("mille").alias("mille"), F.min("season").alias("season"), F.max("hit").alias("hit"))
    locks = L.lock(p.drop("hit"), p.select("id", F.lit(True).alias("ready")), "id", "id", "1998-01-01 00:00:00")
    events = p.select("id", F.make_timestamp(F.when(F.col("season") >= 1998, 1998).otherwise(1999), F.lit(1), F.lit(1), F.lit(0), F.lit(0), F.lit(0)).alias("starts_at"), F.lit(True).alias("over"))
    grades = p.where("hit = 0").join(locks.select("id", "seal"), "id").withColumn("seal", F.when(F.col("id") % 5 == 0, F.sha2("seal", 256)).otherwise(F.col("seal")))
    return L.audit_ledger(locks, grades, events, "id", "id")


@query("p15_narrative_facts", oracle(f"""WITH a AS ({AFTER.format(n=2)}), b AS (SELECT *, total - min(total) OVER (PARTITION BY event_id) AS deficit FROM ({AFTER.format(n=1)})),
r AS ({ROLL}), f AS (SELECT *, rank() OVER (PARTITION BY event_id, period ORDER BY running) = 1 AS lead, max(period) OVER (PARTITION BY event_id) AS last FROM r WHERE n = period),
e AS (SELECT *, max(period) OVER (PARTITION BY event_id, entity_id) AS last FROM scores), t AS (SELECT event_id, entity_id, count(*) AS n, max(score) FILTER (period = last) AS last, sum(score) FILTER (period < last) AS s FROM e GROUP BY 1, 2)
SELECT a.event_id, a.entity_id, 'comeback' AS fact, CAST(deficit AS DOUBLE) AS value FROM a JOIN b USING (event_id, entity_id) JOIN scores p ON p.event_id = a.event_id AND p.entity_id = a.entity_id AND p.period = 2 WHERE a.position = 1 AND deficit > 0
UNION ALL SELECT event_id, entity_id, 'wire_to_wire', CAST(count(*) AS DOUBLE) FROM f GROUP BY 1, 2 HAVING bool_and(lead) AND count(*) = max(last)
UNION ALL SELECT event_id, entity_id, 'surge', s / (n - 1) - last FROM t WHERE n >= 3 AND s / (n - 1) - last >= 3"""))
def p15(spark, sf_dir):
    return U.narrative_facts(view(spark, sf_dir, "scores"), 2)


#: Cards of the first two periods, made from the scores' keys; the scores against par are their sums.
CARDS = """SELECT event_id, entity_id, period, item, CAST((entity_id * 7 + event_id * 3 + period * 5 + item * item) % 5 AS BIGINT) - CASE WHEN item % 4 = 0 THEN 3 ELSE 2 END AS to_par, CAST(3 + item % 3 AS INT) AS item_class FROM scores, (SELECT unnest(range(1, 19)) AS item) WHERE period <= 2"""


@query("p15_champion_facts", oracle(f"""WITH i AS ({CARDS}), s AS (SELECT event_id, entity_id, period, sum(to_par) AS v FROM i GROUP BY 1, 2, 3), b AS (SELECT event_id, entity_id, sum(v) AS total, max(v) - min(v) AS spread FROM s GROUP BY 1, 2 HAVING count(*) = 2),
w AS (SELECT event_id, entity_id, total, spread FROM b QUALIFY row_number() OVER (PARTITION BY event_id ORDER BY total, entity_id) = 1), o AS (SELECT * FROM s WHERE period = 1), c AS (SELECT i.* FROM i JOIN w USING (event_id, entity_id)), l AS (SELECT * FROM c WHERE period = 2),
e AS (SELECT w.event_id, w.entity_id, count(*) FILTER (o.v < m.v) AS ahead, count(*) FILTER (o.v = m.v) AS level, min(o.v) FILTER (o.v > m.v) - any_value(m.v) AS lead FROM w JOIN o m ON m.event_id = w.event_id AND m.entity_id = w.entity_id JOIN o ON o.event_id = w.event_id GROUP BY 1, 2),
n AS (SELECT w.event_id, w.entity_id, count(*) - 1 AS near FROM w JOIN b ON b.event_id = w.event_id AND b.total - w.total <= 3 GROUP BY 1, 2), r AS (SELECT event_id, entity_id, count(*) AS n FROM (SELECT *, item - row_number() OVER (PARTITION BY event_id, entity_id, item <= 9 ORDER BY item) AS g FROM l WHERE to_par < 0) GROUP BY event_id, entity_id, item <= 9, g),
k AS (SELECT event_id, entity_id, item_class, sum(to_par) AS v FROM c GROUP BY 1, 2, 3), z AS (SELECT *, count(*) OVER (PARTITION BY event_id, entity_id, v) AS same, min(v) OVER (PARTITION BY event_id, entity_id) AS lo FROM k),
f AS (SELECT event_id, entity_id, 'after_1' AS fact, v AS value FROM o JOIN w USING (event_id, entity_id) UNION ALL SELECT event_id, entity_id, 'spread', spread FROM w UNION ALL SELECT event_id, entity_id, 'ahead_entering', ahead FROM e WHERE ahead > 0 UNION ALL SELECT event_id, entity_id, 'lead_entering', lead FROM e WHERE ahead = 0 AND level = 1 AND lead IS NOT NULL UNION ALL SELECT event_id, entity_id, 'within_three', near FROM n WHERE near > 0
UNION ALL SELECT event_id, entity_id, CASE x WHEN 0 THEN 'front' WHEN 1 THEN 'back' WHEN 2 THEN 'closing' WHEN 3 THEN 'birdies' WHEN 4 THEN 'bogeys' ELSE 'eagles' END, CASE x WHEN 0 THEN sum(to_par) FILTER (item <= 9) WHEN 1 THEN sum(to_par) FILTER (item > 9) WHEN 2 THEN sum(to_par) FILTER (item >= 13) WHEN 3 THEN count(*) FILTER (to_par = -1) WHEN 4 THEN count(*) FILTER (to_par > 0) ELSE count(*) FILTER (to_par <= -2) END AS v FROM l, (SELECT unnest(range(0, 6)) AS x) GROUP BY event_id, entity_id, x HAVING x < 5 OR count(*) FILTER (to_par <= -2) > 0
UNION ALL SELECT event_id, entity_id, 'run', max(n) FROM r GROUP BY 1, 2 HAVING max(n) >= 3 UNION ALL SELECT event_id, entity_id, 'class_' || item_class, v FROM k UNION ALL SELECT event_id, entity_id, 'metric_match', item_class FROM z WHERE v = lo AND v < 0 AND same = 1 AND (entity_id + item_class) % 3 > 0)
SELECT event_id, entity_id, fact, CAST(value AS DOUBLE) AS value FROM f"""))
def p15_champions(spark, sf_dir):
    s = view(spark, sf_dir, "scores").where("period <= 2").select("event_id", "entity_id", "period", F.explode(F.sequence(F.lit(1), F.lit(18))).alias("item"))
    cards = s.select("*", (F.expr("(entity_id * 7 + event_id * 3 + period * 5 + item * item) % 5") - F.when(F.col("item") % 4 == 0, 3).otherwise(2)).alias("to_par"), (F.col("item") % 3 + 3).alias("item_class"))
    scores = cards.groupBy("event_id", "entity_id", "period").agg(F.sum("to_par").alias("to_par"))
    totals = scores.groupBy("event_id", "entity_id").agg(F.sum("to_par").alias("total"), F.count("*").alias("n")).where("n = 2")
    winners = totals.groupBy("event_id").agg(F.min(F.struct("total", "entity_id")).alias("w")).select("event_id", "w.entity_id")
    strengths = winners.select("entity_id").distinct().withColumn("item_class", F.explode(F.array(F.lit(3), F.lit(4), F.lit(5)))).withColumn("percentile", F.when((F.col("entity_id") + F.col("item_class")) % 3 > 0, 85).otherwise(70))
    return U.champion_facts(winners, scores, cards, strengths, 2)


@query("p20_coordinate_level", oracle("SELECT entity_id, CASE WHEN count(*) FILTER (status = 'F') = 1 THEN 'course' WHEN count(*) FILTER (kind = '1-URGENT') = 1 THEN 'complex' WHEN count(*) FILTER (points > 200000) = 1 THEN 'locality' ELSE 'unknown' END AS level FROM results GROUP BY 1"))
def p20(spark, sf_dir):
    return U.coordinate_level(view(spark, sf_dir, "results"), "entity_id", {"course": F.col("status") == "F", "complex": F.col("kind") == "1-URGENT", "locality": F.col("points") > 200000})


@query("p22_default_setup", oracle("""WITH k AS (SELECT entity_id, entry_id, row_number() OVER (PARTITION BY entity_id ORDER BY start_on DESC, entry_id DESC) AS k FROM results WHERE start_on <= DATE '1997-06-15') SELECT entity_id, arg_min(entry_id, CASE WHEN entry_id % 2 = 0 THEN k ELSE k + 10 END) AS entry_id FROM k WHERE k <= 3 GROUP BY 1"""))
def p22(spark, sf_dir):
    r = view(spark, sf_dir, "results")
    return U.default_setup(r, r.where("entry_id % 2 = 0"), "entity_id", "entry_id", "start_on", "1997-06-15")


@query("p23_status_report", oracle("SELECT source, count(*) AS rows, count(*) FILTER (lang IN ('de', 'fr')) AS affected, min(nullif(regexp_extract(text, '([A-Z]{5,})!!', 1), '')) AS reason FROM documents GROUP BY 1"))
def p23(spark, sf_dir):
    return U.status_report(view(spark, sf_dir, "documents"), "source", "lang", ["de", "fr"], "text", ["([A-Z]{5,})!!"])


@query("p24_plan_rows", oracle("""SELECT l_orderkey, l_linenumber, CASE WHEN l_suppkey % 10 = 3 THEN 'no_identity' WHEN l_quantity <> 20 THEN 'total_differs' ELSE 'write' END AS reason FROM lineitem"""))
def p24(spark, sf_dir):
    li = view(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_suppkey", "l_quantity", F.lit(20.0).alias("stated"))
    known = view(spark, sf_dir, "supplier").where("s_suppkey % 10 <> 3").select(F.col("s_suppkey").alias("l_suppkey"), F.col("s_suppkey").alias("entity_id"))
    rows, held = U.plan_rows(li, known, "l_suppkey", "entity_id", "l_quantity", "stated")
    return rows.withColumn("reason", F.lit("write")).unionByName(held).select("l_orderkey", "l_linenumber", "reason")


@query("f26_period_from_text", oracle("SELECT p_partkey, CASE p_partkey % 3 WHEN 0 THEN 4 WHEN 1 THEN p_size % 4 + 1 END AS period FROM part"))
def f26(spark, sf_dir):
    t = F.expr("CASE p_partkey % 3 WHEN 0 THEN concat(p_name, ' Final Round') WHEN 1 THEN concat('Round ', p_size % 4 + 1, ' ', p_name) ELSE p_name END")
    return view(spark, sf_dir, "part").select("p_partkey", S.period_from_text(t).alias("period"))


@query("f30_sanitize_params", oracle("SELECT p_partkey, CASE WHEN p_partkey % 2 = 0 THEN 'a=' || replace(p_name, ' ', '-') ELSE '' END AS params FROM part"))
def f30(spark, sf_dir):
    m = F.create_map(F.lit("a"), F.when(F.col("p_partkey") % 2 == 0, F.regexp_replace("p_name", " ", "-")).otherwise(F.lit("Not A Slug!")), F.lit("b"), F.lit("x"))
    clean = S.sanitize_params(m, ["a"])
    return view(spark, sf_dir, "part").select("p_partkey", F.array_join(F.transform(F.map_entries(clean), lambda e: F.concat(e["key"], F.lit("="), e["value"])), ",").alias("params"))


@query("f32_sub_tokens", oracle("SELECT p_partkey, replace(p_name, ' ', ',') AS tokens FROM part"))
def f32(spark, sf_dir):
    return view(spark, sf_dir, "part").select("p_partkey", F.array_join(S.sub_tokens(F.concat(F.lit("Main ("), F.col("p_name"), F.lit(") x"))), ",").alias("tokens"))


@query("dq07_check_required", oracle("SELECT c_custkey, 'c_mktsegment' AS missing FROM src_b WHERE c_mktsegment IS NULL"))
def dq07b(spark, sf_dir):
    from ..operators.filters import validate_rows

    v = validate_rows(view(spark, sf_dir, "src_b"), {c: F.col(c).isNotNull() for c in ("c_mktsegment", "cents")})
    return v.where(F.size("violations") > 0).select("c_custkey", F.array_join("violations", ",").alias("missing"))


@query("snk10_bundle", oracle("SELECT 'nation' AS kind, CAST(n_nationkey AS VARCHAR) AS key FROM nation UNION ALL SELECT 'region', CAST(r_regionkey AS VARCHAR) FROM region"))
def snk10(spark, sf_dir):
    n, r = view(spark, sf_dir, "nation"), view(spark, sf_dir, "region")
    return U.bundle({"nation": n.withColumnRenamed("n_nationkey", "key"), "region": r.withColumnRenamed("r_regionkey", "key")}, "key").select("kind", "key")


@query("st01_normalise_snapshot", oracle("SELECT l_orderkey, CASE WHEN count(*) FILTER (l_quantity <= 5) = 0 THEN CAST(sum(CAST(l_quantity AS BIGINT)) AS BIGINT) END AS total FROM lineitem GROUP BY 1"))
def st01(spark, sf_dir):
    li = view(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.transform(F.collect_list(F.struct(F.when(F.col("l_quantity") > 5, F.col("l_quantity").cast("int")).alias("v"))), lambda x: x["v"]).alias("scores"))
    return ST.normalise_snapshot(li).select("l_orderkey", "total")


@query("st11_drop_late", oracle("SELECT event_id FROM (SELECT event_id, ts, max(ts) OVER (PARTITION BY user_id ORDER BY event_id % 97, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS seen FROM events) WHERE seen IS NULL OR ts > seen"))
def st11(spark, sf_dir):
    e = view(spark, sf_dir, "events").withColumn("arrival", F.struct(F.col("event_id") % 97, "event_id"))
    return ST.drop_late(e, ["user_id"], "ts", "arrival").select("event_id")


@query("st11_drop_late_stream", oracle("SELECT event_id FROM (SELECT event_id, ts, max(ts) OVER (PARTITION BY user_id ORDER BY event_id % 97, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS seen FROM events) WHERE seen IS NULL OR ts > seen"))
def st11s(spark, sf_dir):
    e = view(spark, sf_dir, "events").select("event_id", "user_id", "ts", (F.col("event_id") % 97 * 1_000_000_000 + F.col("event_id")).alias("arrival"))
    return in_slices([e.where("event_id % 97 < 40"), e.where("event_id % 97 >= 40")], lambda x: ST.drop_late_stream(x, ["user_id"], "ts", "arrival"), "late").select("event_id")


@query("st13_decayed_state_stream", oracle("""WITH e AS (SELECT entity_id, total, date_diff('day', start_on, max(start_on) OVER (PARTITION BY entity_id)) AS d FROM entries) SELECT entity_id AS entity, round(sum(exp(-d / 730.0)), 6) AS weight, round(sum(exp(-d / 730.0) * total), 6) AS s FROM e GROUP BY 1"""))
def st13(spark, sf_dir):
    path = shared(spark, "ratings")
    e = view(spark, sf_dir, "entries").select("entity_id", F.col("start_on").cast("timestamp").alias("start_on"), "total")
    e.write.parquet(f"{path}/in")
    state = ST.decayed_state(spark.readStream.schema(e.schema).parquet(f"{path}/in"), "entity_id", "start_on", "total")
    put = lambda batch, n: batch.withColumn("batch", F.lit(n)).write.mode("overwrite").parquet(f"{path}/out/{n}")
    state.writeStream.outputMode("update").foreachBatch(put).option("checkpointLocation", f"{path}/state").trigger(availableNow=True).start().awaitTermination()
    rows = spark.read.parquet(f"{path}/out/*")
    last = rows.groupBy("entity").agg(F.max_by(F.struct("weight", "s"), "batch").alias("last"))  # each entity as its latest batch has it
    return last.select("entity", F.round("last.weight", 6).alias("weight"), F.round("last.s", 6).alias("s"))


@query("f13_nearest_on_route", oracle("SELECT p_partkey, CAST(p_size AS DOUBLE) AS distance, CAST(p_partkey % 90 + 5 AS DOUBLE) AS along, 1.0 AS side FROM part"))
def f13(spark, sf_dir):
    pts = F.expr("array(named_struct('x', 0D, 'y', 0D), named_struct('x', 100D, 'y', 0D), named_struct('x', 100D, 'y', -500D))")
    p = view(spark, sf_dir, "part").select("p_partkey", F.col("p_size").cast("double").alias("y"), (F.col("p_partkey") % 90 + 5).cast("double").alias("x"))
    return p.select("p_partkey", S.nearest_on_route("x", "y", pts).alias("n")).select("p_partkey", "n.*")


@query("f14_f15_route", oracle("SELECT p_partkey, CASE WHEN 2 * degrees(atan(p_size / 150.0)) < 12 THEN 'straight' WHEN 2 * degrees(atan(p_size / 150.0)) >= 20 AND p_size >= 20 THEN 'dogleg right' END AS shape, 2 AS marks FROM part"))
def f14_whole(spark, sf_dir):
    pts = F.expr("array(named_struct('x', 0D, 'y', 0D), named_struct('x', 150D, 'y', cast(p_size as double)), named_struct('x', 300D, 'y', 0D))")
    p = view(spark, sf_dir, "part").select("p_partkey", pts.alias("pts"))
    return p.select("p_partkey", S.route_shape("pts", F.lit(4)).alias("shape"), F.size(S.route_markers("pts", [100, 150, 1000])).alias("marks"))
