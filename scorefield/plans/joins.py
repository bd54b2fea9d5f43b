"""Queries of the joins."""

from pyspark.sql import functions as F

from ..operators import joins as J
from .bindings import oracle, view
from .registry import query
from .scalars import NAME_KEYS, NAME_WORDS


def people(spark, sf_dir, table, p):
    return view(spark, sf_dir, table).select(F.col(f"{p}_{'custkey' if p == 'c' else 'suppkey'}").alias("id"), F.col(f"{p}_nationkey").alias("nation"), F.col(f"{p}_name").alias("name"))


@query("j01_star_assembly", oracle("SELECT event_id, cohort, count(*) AS n, CAST(sum(score) AS BIGINT) AS score FROM scores JOIN cohort USING (entity_id) JOIN venue USING (event_id) GROUP BY 1, 2"))
def j01(spark, sf_dir):
    s = view(spark, sf_dir, "scores").join(view(spark, sf_dir, "cohort"), "entity_id").join(view(spark, sf_dir, "venue"), "event_id")
    return s.groupBy("event_id", "cohort").agg(F.count("*").alias("n"), F.sum("score").alias("score"))


@query("j02_join_preferred", oracle("SELECT c_custkey, entry_id, kind FROM customer LEFT JOIN (SELECT *, row_number() OVER (PARTITION BY entity_id ORDER BY kind, entry_id) AS k FROM results) r ON c_custkey = entity_id AND k = 1"))
def j02(spark, sf_dir):
    r = view(spark, sf_dir, "results").withColumnRenamed("entity_id", "c_custkey")
    return J.join_preferred(view(spark, sf_dir, "customer").select("c_custkey"), r, ["c_custkey"], "kind", "entry_id").select("c_custkey", "entry_id", "kind")


@query("j03_fold_alias", oracle("SELECT c_custkey AS old, CASE WHEN c_custkey % 5 = 0 AND c_custkey - 1 IN (SELECT c_custkey FROM customer) THEN c_custkey - 1 ELSE c_custkey END AS id FROM customer"))
def j03(spark, sf_dir):
    c = view(spark, sf_dir, "customer").select(F.col("c_custkey").alias("old"), F.col("c_custkey").alias("id"))
    return J.fold_alias(c, c.where("id % 5 = 0").select("id", (F.col("id") - 1).alias("primary")), "id").select("old", "id")


@query("j04_previous_period", oracle("WITH y AS (SELECT entity_id, season, CAST(sum(points) AS BIGINT) AS points FROM results GROUP BY 1, 2) SELECT a.entity_id, a.season, a.points, b.points AS previous_points FROM y a LEFT JOIN y b ON a.entity_id = b.entity_id AND a.season = b.season + 1"))
def j04(spark, sf_dir):
    y = view(spark, sf_dir, "results").groupBy("entity_id", "season").agg(F.sum("points").alias("points"))
    return J.previous_period(y, ["entity_id"], "season", "points")


@query("j05_history_before", oracle("SELECT a.entry_id, count(b.entry_id) AS prior, CAST(sum(b.points) AS BIGINT) AS prior_total FROM results a LEFT JOIN results b ON a.entity_id = b.entity_id AND b.start_on < a.start_on AND b.start_on >= a.start_on - 365 GROUP BY 1"))
def j05(spark, sf_dir):
    return J.history_before(view(spark, sf_dir, "results"), "entity_id", "start_on", "points", 365).select("entry_id", "prior", "prior_total")


@query("j06_asof_join", oracle("""WITH l AS (SELECT event_id, user_id, ts FROM events WHERE event_type = 'click'), r AS (SELECT user_id, ts, max(event_id) AS seen FROM events WHERE event_type <> 'click' GROUP BY 1, 2)
SELECT l.event_id, CASE WHEN r.ts > l.ts - INTERVAL 2 DAY THEN seen END AS seen FROM l ASOF LEFT JOIN r ON l.user_id = r.user_id AND l.ts >= r.ts"""))
def j06(spark, sf_dir):
    e = view(spark, sf_dir, "events")
    right = e.where("event_type <> 'click'").groupBy("user_id", "ts").agg(F.max("event_id").alias("seen"))
    return J.asof_join(e.where("event_type = 'click'").select("event_id", "user_id", "ts"), right, ["user_id"], "ts", "seen", "2 days").select("event_id", "seen")


@query("j07_asof_prior", oracle("SELECT entry_id, lag(points) OVER (PARTITION BY entity_id ORDER BY start_on, entry_id) AS prior_points FROM results"))
def j07(spark, sf_dir):
    return J.asof_prior(view(spark, sf_dir, "results"), ["entity_id"], ["start_on", "entry_id"], "points").select("entry_id", "prior_points")


@query("j08_nearest_interval_join", oracle("""WITH p AS (SELECT entry_id AS point, entity_id, start_on AS day0 FROM results WHERE kind = '1-URGENT'), i AS (SELECT entry_id AS interval_id, entity_id, start_on AS s, start_on + 3 AS e FROM results WHERE kind <> '1-URGENT'),
m AS (SELECT point, interval_id, abs(date_diff('day', day0, e)) AS days FROM p JOIN i USING (entity_id) WHERE day0 BETWEEN s - 10 AND e + 45), k AS (SELECT *, row_number() OVER (PARTITION BY point ORDER BY days, interval_id) AS k, lead(days) OVER (PARTITION BY point ORDER BY days, interval_id) AS nxt FROM m)
SELECT point, interval_id, days FROM k WHERE k = 1 AND (nxt IS NULL OR nxt - days > 7)"""))
def j08(spark, sf_dir):
    r = view(spark, sf_dir, "results")
    p = r.where("kind = '1-URGENT'").select(F.col("entry_id").alias("point"), "entity_id", F.col("start_on").alias("at"))
    i = r.where("kind <> '1-URGENT'").select(F.col("entry_id").alias("interval_id"), "entity_id", F.col("start_on").alias("s"), F.date_add("start_on", 3).alias("e"))
    return J.nearest_interval_join(p, i, ["entity_id"], "at", "s", "e", "interval_id", "point")


@query("j09_match_events", oracle("""WITH p AS (SELECT p_partkey AS id, p_size, list_distinct(list_filter(string_split(trim(regexp_replace(lower(p_name), '[^a-z0-9]+', ' ', 'g')), ' '), lambda x: length(x) > 3 AND x <> 'part')) AS w FROM part),
a AS (SELECT id, p_size, unnest(w) AS w FROM p WHERE id % 2 = 0), b AS (SELECT id, p_size, unnest(w) AS w FROM p WHERE id % 2 = 1), m AS (SELECT DISTINCT a.id AS a, b.id AS b FROM a JOIN b USING (p_size, w) WHERE abs(a.id % 5 - b.id % 5) <= 1), n AS (SELECT *, count(*) OVER (PARTITION BY a) AS n FROM m) SELECT a, b FROM n WHERE n = 1"""))
def j09(spark, sf_dir):
    p = view(spark, sf_dir, "part").select("p_partkey", "p_size", "p_name", F.date_add(F.lit("2000-01-01").cast("date"), (F.col("p_partkey") % 5).cast("int")).alias("end"))
    a, b = p.where("p_partkey % 2 = 0").withColumnRenamed("p_partkey", "a"), p.where("p_partkey % 2 = 1").withColumnRenamed("p_partkey", "b")
    return J.match_events(a, b, "p_size", "end", "p_name", "a", "b", generic=["part"])


@query("j09_match_editions", oracle("""WITH p AS (SELECT p_partkey AS id, p_name AS name, p_size % 4 AS year, CASE WHEN p_partkey % 9 > 0 THEN p_size % 2 END AS division, DATE '2000-01-01' + CAST(p_partkey % 5 AS INT) AS e, list_distinct(list_filter(string_split(trim(regexp_replace(lower(p_name), '[^a-z0-9]+', ' ', 'g')), ' '), lambda x: length(x) > 3 AND x <> 'part')) AS w FROM part),
l AS (SELECT *, id % 7 = 0 AS canon, CASE WHEN id % 11 = 0 THEN id - 1 END AS provider FROM p WHERE id % 2 = 1 AND id % 13 > 0), a AS (SELECT * FROM p WHERE id % 2 = 0), near AS (SELECT a.id, a.division AS own, l.id AS e, canon, provider, l.division FROM a JOIN l ON a.year = l.year AND abs(a.e - l.e) <= 1 AND len(list_intersect(a.w, l.w)) > 0),
g AS (SELECT id, count(*) FILTER (canon) AS cs, min(e) FILTER (canon) AS c, count(*) FILTER (own IS NULL OR own = division) AS us, min(e) FILTER (own IS NULL OR own = division) AS u, list_sort(list(e) FILTER (NOT canon OR coalesce(provider = id, false))) AS y FROM near GROUP BY 1), x AS (SELECT provider AS id, min(id) AS x FROM l WHERE provider IS NOT NULL GROUP BY 1)
SELECT a.id, CASE WHEN cs = 1 THEN c WHEN x IS NOT NULL THEN x WHEN us = 1 THEN u END AS "match", CASE WHEN cs = 1 THEN 'canonical' WHEN x IS NOT NULL THEN 'exact_id' WHEN us = 1 THEN 'unique' END AS basis, CASE WHEN cs = 1 THEN array_to_string(list_filter(coalesce(y, []), lambda v: v <> c), ',') ELSE '' END AS superseded FROM a LEFT JOIN g ON g.id = a.id LEFT JOIN x ON x.id = a.id"""))
def j09_editions(spark, sf_dir):
    p = view(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.col("p_name").alias("name"), F.date_add(F.lit("2000-01-01").cast("date"), (F.col("p_partkey") % 5).cast("int")).alias("end"), (F.col("p_size") % 4).alias("year"), F.when(F.col("p_partkey") % 9 > 0, F.col("p_size") % 2).alias("division"))
    editions = p.where("id % 2 = 1").select("*", (F.col("id") % 7 == 0).alias("canonical"), F.when(F.col("id") % 11 == 0, F.col("id") - 1).alias("provider"), (F.col("id") % 13 == 0).alias("superseded"))
    found = J.match_editions(p.where("id % 2 = 0"), editions.withColumnRenamed("id", "edition"), "id", "edition", "name", "end", "year", "canonical", "provider", "division", "superseded", generic=["part"])
    return found.withColumn("superseded", F.array_join(F.transform("superseded", lambda x: x.cast("string")), ","))


@query("j10_resolve_identity", oracle("""WITH m AS (SELECT DISTINCT event, seen AS person FROM sightings WHERE sighting % 6 = 1), x AS (SELECT s.sighting, s.birth AS b, p.person, p.birth, p.year, s.birth = p.birth AS e, s.birth IS NOT NULL AND p.birth IS NULL AND p.year = year(s.birth) AS y,
m.person IS NOT NULL AND (s.birth IS NULL OR p.birth IS NULL OR s.birth = p.birth) AS v FROM sightings s JOIN people p ON lower(s.name) = p.name LEFT JOIN m ON m.event = s.event AND m.person = p.person),
g AS (SELECT sighting, count(*) AS names, count(*) FILTER (e) AS ne, max(person) FILTER (e) AS pe, count(*) FILTER (y) AS ny, max(person) FILTER (y) AS py, count(*) FILTER (v) AS nv, max(person) FILTER (v) AS pv FROM x GROUP BY 1),
r AS (SELECT s.sighting, count(*) AS n, count(*) FILTER (s.birth = p.birth) AS ne, max(person) FILTER (s.birth = p.birth) AS pe FROM sightings s JOIN people p ON lower(s.name) = string_split(p.name, ' ')[2] || ' ' || string_split(p.name, ' ')[1] GROUP BY 1),
o AS (SELECT s.sighting, CASE WHEN s.sighting % 90 = 1 THEN 'crosswalk' WHEN g.ne = 1 THEN 'name_birth' WHEN g.ne = 0 AND ny = 1 THEN 'name_year' WHEN nv = 1 THEN 'name_event' WHEN names > 1 THEN 'multiple_namesakes' WHEN names = 1 THEN 'namesake_without_corroboration' WHEN r.ne = 1 THEN 'variant_birth' WHEN n > 0 THEN 'variant_without_birth' ELSE 'new' END AS outcome,
s.seen, g.pe, py, pv, r.pe AS pr FROM sightings s LEFT JOIN g ON g.sighting = s.sighting LEFT JOIN r ON r.sighting = s.sighting)
SELECT sighting, CASE outcome WHEN 'crosswalk' THEN seen WHEN 'name_birth' THEN pe WHEN 'name_year' THEN py WHEN 'name_event' THEN pv WHEN 'variant_birth' THEN pr END AS person, outcome FROM o"""))
def j10(spark, sf_dir):
    s = view(spark, sf_dir, "sightings")
    members = s.where("sighting % 6 = 1").select("event", F.col("seen").alias("person")).distinct()
    return J.resolve_identity(s, s.where("sighting % 90 = 1").select("sighting", F.col("seen").alias("person")), view(spark, sf_dir, "people"), "sighting", "name", "birth", "person", "year", "event", members)


@query("j11_candidate_pairs", oracle(f"WITH n AS (SELECT p_partkey AS id, {NAME_WORDS.format('p_name')} AS t FROM part), k AS (SELECT id, unnest({NAME_KEYS}) AS b FROM n) SELECT DISTINCT a.id AS a, c.id AS b FROM k a JOIN k c ON a.b = c.b AND a.id < c.id"))
def j11(spark, sf_dir):
    return J.candidate_pairs(view(spark, sf_dir, "part").select("p_partkey", "p_name"), "p_partkey", "p_name")


@query("j11_merge_decisions", oracle("""WITH RECURSIVE p AS (SELECT person, CASE WHEN person % 2 = 0 THEN string_split(name, ' ')[2] || string_split(name, ' ')[1] || ' z' ELSE string_split(name, ' ')[2] || ' ' || string_split(name, ' ')[1] || ' z' END AS name, birth, person // 60 % 2 = 0 AS canon FROM people), w AS (SELECT person, birth, canon, {words} AS t FROM p),
k AS (SELECT person, birth, canon, unnest({keys}) AS block FROM w), b AS (SELECT block, count(*) AS n, count(*) FILTER (birth IS NULL) AS missing, min(birth) AS lo, max(birth) AS hi FROM k GROUP BY 1 HAVING count(*) > 1),
f AS (SELECT person, birth, canon, bool_or(birth IS NULL OR missing > 0) AS m, coalesce(bool_or(lo <> birth OR hi <> birth), false) AS d FROM k JOIN b USING (block) GROUP BY 1, 2, 3),
hub AS (SELECT DISTINCT k.person, block, birth FROM k JOIN b USING (block) WHERE birth IS NOT NULL), low AS (SELECT person, block, birth, min(person) OVER (PARTITION BY block, birth) AS p FROM hub), e AS (SELECT DISTINCT person AS x, p AS y FROM low UNION SELECT p, person FROM low),
reach(x, y) AS (SELECT DISTINCT person, person FROM hub UNION SELECT reach.x, e.y FROM reach JOIN e ON e.x = reach.y), fam AS (SELECT x AS person, min(y) AS family FROM reach GROUP BY 1),
s AS (SELECT family, count(*) AS size, count(*) FILTER (canon) AS canons, min(person) FILTER (canon) AS target FROM fam JOIN f USING (person) GROUP BY 1), j AS (SELECT f.*, coalesce(size > 1 AND canons = 1, false) AS merges, coalesce(size > 1, false) AS several, target FROM f LEFT JOIN fam USING (person) LEFT JOIN s USING (family))
SELECT person, CASE WHEN merges AND NOT canon THEN 'merge' WHEN merges THEN 'keep' ELSE 'hold' END AS decision, CASE WHEN merges AND NOT canon THEN target END AS target,
array_to_string(list_filter([CASE WHEN m THEN 'birth_date_missing' END, CASE WHEN d THEN 'birth_dates_differ' END, CASE WHEN several AND NOT merges THEN 'canonical_unclear' END], lambda x: x IS NOT NULL), ',') AS reasons FROM j""".format(words=NAME_WORDS.format("name"), keys=NAME_KEYS)))
def j11_decisions(spark, sf_dir):
    first, last = F.split("name", " ")[0], F.split("name", " ")[1]
    p = view(spark, sf_dir, "people").select("person", F.when(F.col("person") % 2 == 0, F.concat(last, F.lit("-"), first, F.lit(" z"))).otherwise(F.concat_ws(" ", last, first, F.lit("z"))).alias("name"), "birth", F.expr("person div 60 % 2 = 0").alias("canon"))
    return J.merge_decisions(p, "person", "name", "birth", "canon").withColumn("reasons", F.array_join("reasons", ","))


@query("j12_absorb_children", oracle("""WITH m AS (SELECT entry_id, entity_id, season, entity_id - 1 AS p FROM results WHERE entity_id % 5 = 0) SELECT entry_id, CASE WHEN EXISTS (SELECT 1 FROM results r WHERE r.entity_id = p AND r.season = m.season) THEN 'kept' ELSE 'moved' END AS action FROM m"""))
def j12(spark, sf_dir):
    r = view(spark, sf_dir, "results").select("entry_id", "entity_id", "season")
    dup = r.where("entity_id % 5 = 0").select("entity_id", (F.col("entity_id") - 1).alias("primary")).distinct()
    return J.absorb_children(r, dup, "entity_id", ["season"]).select("entry_id", "action")


@query("j13_corroborate", oracle("""WITH e AS (SELECT * FROM entries), m AS (SELECT a.event_id, a.entity_id AS a, b.entity_id + 1000 AS b FROM e a JOIN e b USING (event_id, position, total)), u AS (SELECT *, count(*) OVER (PARTITION BY event_id, a) AS na, count(*) OVER (PARTITION BY event_id, b) AS nb FROM m) SELECT event_id * 100000 + a AS l, event_id * 100000 + b AS r FROM u WHERE na = 1 AND nb = 1"""))
def j13(spark, sf_dir):
    e = view(spark, sf_dir, "entries").select("event_id", "position", "total", "entity_id")
    l = e.withColumn("l", F.col("event_id") * 100000 + F.col("entity_id")).drop("entity_id")
    r = e.withColumn("r", F.col("event_id") * 100000 + F.col("entity_id") + 1000).drop("entity_id")
    return J.match_unique(l, r, ["event_id", "position", "total"], "l", "r")


@query("j14_resolve_alias", oracle("""WITH RECURSIVE a AS (SELECT c_custkey AS k, c_custkey // 2 AS t FROM customer WHERE c_custkey % 2 = 0), h(c_custkey, resolved, n) AS (SELECT c_custkey, c_custkey, 0 FROM customer UNION ALL SELECT h.c_custkey, t, n + 1 FROM h JOIN a ON k = resolved WHERE n < 3) SELECT c_custkey, arg_max(resolved, n) AS resolved FROM h GROUP BY 1"""))
def j14(spark, sf_dir):
    c = view(spark, sf_dir, "customer").select("c_custkey")
    return J.resolve_alias(c, c.where("c_custkey % 2 = 0").withColumn("target", F.floor(F.col("c_custkey") / 2)), "c_custkey")


@query("j15_nearest_within", oracle("""WITH p AS (SELECT c_custkey AS id, (c_custkey * 37) % 160 - 80 + (c_custkey % 7) / 10.0::DOUBLE AS lat, (c_custkey * 53) % 360 - 180 + (c_custkey % 11) / 10.0::DOUBLE AS lon FROM customer), s AS (SELECT s_suppkey AS station, (s_suppkey * 37) % 160 - 80::DOUBLE AS lat, (s_suppkey * 53) % 360 - 180::DOUBLE AS lon FROM supplier),
d AS (SELECT id, station, 2 * 6371.0::DOUBLE * asin(sqrt(least(1, power(sin(radians(s.lat - p.lat) / 2), 2) + cos(radians(p.lat)) * cos(radians(s.lat)) * power(sin(radians(s.lon - p.lon) / 2), 2)))) AS km FROM p, s)
SELECT id, arg_min(station, (km, station)) AS station, round(min(km), 6) AS km FROM d WHERE km <= 300 GROUP BY 1"""))
def j15(spark, sf_dir):
    p = view(spark, sf_dir, "customer").selectExpr("c_custkey AS id", "(c_custkey * 37) % 160 - 80 + (c_custkey % 7) / 10D AS lat", "(c_custkey * 53) % 360 - 180 + (c_custkey % 11) / 10D AS lon")
    s = view(spark, sf_dir, "supplier").selectExpr("s_suppkey AS station", "CAST((s_suppkey * 37) % 160 - 80 AS DOUBLE) AS lat", "CAST((s_suppkey * 53) % 360 - 180 AS DOUBLE) AS lon")
    return J.nearest_within(p, s, "id", "station", 300.0).withColumn("km", F.round("km", 6))


@query("j16_contains_join", oracle("""WITH p AS (SELECT p_partkey AS id, (p_partkey * 37) % 100 + 0.5 AS x, (p_partkey * 53) % 100 + 0.5 AS y FROM part), r AS (SELECT s_suppkey AS ring_id, (s_suppkey * 7) % 90 AS x0, (s_suppkey * 11) % 90 AS y0 FROM supplier),
m AS (SELECT id, count(ring_id) AS rings, min(ring_id) AS r FROM p LEFT JOIN r ON x > x0 AND x < x0 + 5 AND y > y0 AND y < y0 + 5 GROUP BY 1) SELECT id, rings, CASE WHEN rings = 1 THEN r END AS ring_id, CASE WHEN rings = 1 THEN 'match' WHEN rings > 1 THEN 'review' ELSE 'none' END AS verdict FROM m"""))
def j16(spark, sf_dir):
    p = view(spark, sf_dir, "part").selectExpr("p_partkey AS id", "(p_partkey * 37) % 100 + 0.5D AS x", "(p_partkey * 53) % 100 + 0.5D AS y")
    r = view(spark, sf_dir, "supplier").selectExpr("s_suppkey AS ring_id", "CAST((s_suppkey * 7) % 90 AS DOUBLE) AS a", "CAST((s_suppkey * 11) % 90 AS DOUBLE) AS b").selectExpr("ring_id", "array(named_struct('x', a, 'y', b), named_struct('x', a + 5, 'y', b), named_struct('x', a + 5, 'y', b + 5), named_struct('x', a, 'y', b + 5)) AS ring")
    return J.contains_join(p, r, "id", "ring_id", 10.0)


@query("j18_assign_exclusive", oracle("""WITH d AS (SELECT c_custkey AS a, s_suppkey AS b, abs((c_custkey * 37) % 1000 - (s_suppkey * 91) % 1000) AS d FROM customer JOIN supplier ON c_nationkey = s_nationkey), h AS (SELECT * FROM d WHERE d <= 60),
k AS (SELECT *, row_number() OVER (PARTITION BY a ORDER BY d, b) AS k, lead(d) OVER (PARTITION BY a ORDER BY d, b) AS nxt FROM h), c AS (SELECT a, b, d, row_number() OVER (PARTITION BY b ORDER BY d, a) AS m FROM k WHERE k = 1 AND (nxt IS NULL OR nxt - d >= 15)) SELECT a, b, d FROM c WHERE m = 1"""))
def j18(spark, sf_dir):
    at = lambda table, p, step, name: people(spark, sf_dir, table, p).select(F.col("id").alias(name), "nation", ((F.col("id") * step) % 1000).alias("at"))
    pairs = J.nearest_pairs(at("customer", "c", 37, "a"), at("supplier", "s", 91, "b"), ["nation"], "a", "b", "at", 60).withColumnRenamed("distance", "d")
    return J.assign_exclusive(pairs, "a", "b", "d", 60, 15)


@query("j19_hold_shared", oracle("SELECT entry_id, count(*) OVER (PARTITION BY entity_id, start_on) > 1 AS held FROM results"))
def j19(spark, sf_dir):
    r = view(spark, sf_dir, "results").withColumn("t", F.concat_ws(":", F.col("entity_id").cast("string"), F.col("start_on").cast("string")))
    return J.hold_shared(r, "t").select("entry_id", "held")


H2H = """WITH e AS (SELECT event_id, entity_id, CASE WHEN status = 'finished' THEN position ELSE 900 END AS r FROM entries) SELECT x.entity_id AS a, y.entity_id AS b, count(*) AS shared, count(*) FILTER (NOT (x.r >= 900 AND y.r >= 900) AND x.r < y.r) AS a_higher, count(*) FILTER (NOT (x.r >= 900 AND y.r >= 900) AND x.r > y.r) AS b_higher,
count(*) FILTER (NOT (x.r >= 900 AND y.r >= 900) AND x.r = y.r) AS level, count(*) FILTER (x.r >= 900 AND y.r >= 900) AS both_missed FROM e x JOIN e y ON x.event_id = y.event_id AND y.entity_id = x.entity_id + 1 GROUP BY 1, 2"""


@query("j20_head_to_head", oracle(H2H))
def j20(spark, sf_dir):
    e = view(spark, sf_dir, "entries")
    pairs = e.select(F.col("entity_id").alias("a"), (F.col("entity_id") + 1).alias("b")).distinct()
    return J.head_to_head(e, pairs, "event_id", "entity_id", "position", "status")


@query("j21_common_dims", oracle("WITH h AS (SELECT entity_id, event_id % 12 AS venue_id, count(*) AS n FROM entries GROUP BY 1, 2) SELECT a.entity_id AS a, a.venue_id, a.n AS na, b.n AS nb FROM h a JOIN h b USING (venue_id) WHERE b.entity_id = a.entity_id + 1"))
def j21_pairs(spark, sf_dir):
    h = view(spark, sf_dir, "entries").groupBy("entity_id", (F.col("event_id") % 12).alias("venue_id")).agg(F.count("*").alias("n"))
    return J.common_dims(h.select(F.col("entity_id").alias("a"), "venue_id", F.col("n").alias("na")), h.select((F.col("entity_id") - 1).alias("a"), "venue_id", F.col("n").alias("nb")), ["a", "venue_id"])


@query("j22_parity", oracle("""WITH m AS (SELECT a.c_custkey AS k, b.c_custkey IS NULL AS gone, a.cents AS ca, b.cents - (b.c_custkey % 5) AS cb, a.c_mktsegment AS ma, b.c_mktsegment AS mb FROM src_a a LEFT JOIN src_b b ON a.c_custkey = b.c_custkey),
x AS (SELECT k AS c_custkey, unnest(list_filter([CASE WHEN gone THEN 'row_removed' END, CASE WHEN NOT gone AND coalesce(cb, 0) < coalesce(ca, 0) THEN 'count_lost:cents' END, CASE WHEN NOT gone AND ma IS NOT NULL AND mb IS NULL THEN 'field_missing:c_mktsegment' END], lambda x: x IS NOT NULL)) AS kind FROM m) SELECT c_custkey, kind, c_custkey % 2 = 0 AND kind = 'row_removed' AS explained FROM x"""))
def j22(spark, sf_dir):
    a, b = view(spark, sf_dir, "src_a"), view(spark, sf_dir, "src_b").withColumn("cents", F.col("cents") - F.col("c_custkey") % 5)
    rev = a.where("c_custkey % 2 = 0").select("c_custkey", F.array(F.lit("row_removed")).alias("allow"))
    return J.parity(a, b, "c_custkey", ["cents"], ["c_mktsegment"], revocations=rev)


@query("j23_reconcile", oracle("""SELECT coalesce(a.c_nationkey, b.c_nationkey) AS c_nationkey, count(*) FILTER (a.c_custkey IS NOT NULL AND b.c_custkey IS NOT NULL) AS compared, count(*) FILTER (b.c_custkey IS NULL) AS only_a, count(*) FILTER (a.c_custkey IS NULL) AS only_b,
count(*) FILTER (a.c_custkey IS NOT NULL AND b.c_custkey IS NOT NULL AND (a.cents IS DISTINCT FROM b.cents OR a.c_mktsegment IS DISTINCT FROM b.c_mktsegment)) AS mismatched FROM src_a a FULL JOIN src_b b ON a.c_custkey = b.c_custkey AND a.c_nationkey = b.c_nationkey GROUP BY 1"""))
def j23(spark, sf_dir):
    return J.reconcile(view(spark, sf_dir, "src_a"), view(spark, sf_dir, "src_b"), ["c_custkey"], ["cents", "c_mktsegment"], ["c_nationkey"])


@query("j24_conflicts", oracle("SELECT c_custkey, 'cents' AS field, CAST(a.cents AS VARCHAR) AS a, CAST(b.cents AS VARCHAR) AS b FROM src_a a JOIN src_b b USING (c_custkey) WHERE a.cents <> b.cents UNION ALL SELECT c_custkey, 'c_mktsegment', a.c_mktsegment, b.c_mktsegment FROM src_a a JOIN src_b b USING (c_custkey) WHERE a.c_mktsegment <> b.c_mktsegment"))
def j24(spark, sf_dir):
    return J.conflicts(view(spark, sf_dir, "src_a"), view(spark, sf_dir, "src_b"), "c_custkey", ["cents", "c_mktsegment"])


@query("j25_pairs_in_top", oracle("""WITH r AS (SELECT event_id, entity_id, row_number() OVER (PARTITION BY event_id ORDER BY total, entity_id) AS k FROM entries), p AS (SELECT a.event_id, a.entity_id AS a, b.entity_id AS b, row_number() OVER (PARTITION BY a.event_id ORDER BY a.k, b.k) AS n FROM r a JOIN r b ON a.event_id = b.event_id AND a.k < b.k WHERE a.k <= 4 AND b.k <= 4) SELECT event_id, a, b FROM p WHERE n <= 3"""))
def j25(spark, sf_dir):
    return J.pairs_in_top(view(spark, sf_dir, "entries"), ["event_id"], [F.col("total"), F.col("entity_id")], "entity_id", 4, 3)


@query("j26_apply_crosswalk", oracle("""WITH m AS (SELECT l_orderkey, l_linenumber, CASE WHEN l_linenumber < 5 THEN l_linenumber * 10 END AS item FROM lineitem) SELECT l_orderkey, count(DISTINCT l_linenumber) AS keys, count(DISTINCT item) AS items, count(*) FILTER (item IS NULL) AS missing, CASE WHEN count(DISTINCT l_linenumber) = 4 AND count(DISTINCT item) = 4 AND count(*) FILTER (item IS NULL) = 0 THEN 'applied' ELSE 'review' END AS verdict FROM m GROUP BY 1"""))
def j26(spark, sf_dir):
    li = view(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber")
    xw = li.select("l_linenumber").distinct().where("l_linenumber < 5").withColumn("item", F.col("l_linenumber") * 10)
    return J.apply_crosswalk(li, xw, "l_orderkey", "l_linenumber", "item", 4)


@query("j27_with_provenance", oracle("SELECT entity_id, event_id, r_name FROM (SELECT entity_id, event_id, entity_id % 7 AS k FROM entries) LEFT JOIN region ON r_regionkey = k"))
def j27(spark, sf_dir):
    e = view(spark, sf_dir, "entries").select("entity_id", "event_id", (F.col("entity_id") % 7).alias("r_regionkey"))
    return J.with_provenance(e, view(spark, sf_dir, "region"), "r_regionkey").select("entity_id", "event_id", "r_name")


@query("j28_missing", oracle("SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'P' AND o_orderpriority = '1-URGENT')"))
def j28(spark, sf_dir):
    """Customers without an open urgent order."""
    urgent = view(spark, sf_dir, "orders").where("o_orderstatus = 'P' and o_orderpriority = '1-URGENT'")
    return J.missing(view(spark, sf_dir, "customer").select("c_custkey"), urgent.select(F.col("o_custkey").alias("c_custkey")), ["c_custkey"])


@query("j30_resolve_duplicates", oracle("""WITH c AS (SELECT entity_id, entry_id, status = 'F' AS ok, count(*) OVER (PARTITION BY entity_id) AS n, count(*) FILTER (status = 'F') OVER (PARTITION BY entity_id) AS m FROM results) SELECT entity_id, entry_id FROM c WHERE n = 1 OR (ok AND m = 1)"""))
def j30(spark, sf_dir):
    return J.resolve_duplicates(view(spark, sf_dir, "results"), "entity_id", "entry_id", F.col("status") == "F")


@query("j31_detect_renumbering", oracle("SELECT l_orderkey, l_linenumber, l_quantity > 25 AND count(*) FILTER (l_quantity > 25 AND l_tax > 0.04) OVER (PARTITION BY l_orderkey) >= 2 AS withheld FROM lineitem"))
def j31(spark, sf_dir):
    li = view(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity", "l_tax")
    return J.detect_renumbering(li, "l_orderkey", (F.col("l_quantity") > 25) & (F.col("l_tax") > 0.04), F.col("l_quantity") > 25).drop("l_quantity", "l_tax")


@query("j32_auto_identity", oracle("SELECT p_partkey, CASE WHEN p_partkey % 9 = 0 THEN 'shared_name' WHEN p_size < 15 THEN 'not_proven' WHEN p_size % 20 + 5 < 15 THEN 'lengths_differ' WHEN p_retailprice < 1000 THEN 'name_differs' ELSE 'identity' END AS verdict FROM part"))
def j32(spark, sf_dir):
    p = view(spark, sf_dir, "part").select("p_partkey", "p_size", (F.col("p_size") % 20 + 5).alias("agree"), (F.col("p_retailprice") / 1000 * 0.75).alias("name"), (F.col("p_partkey") % 9 == 0).alias("shared"))
    return J.auto_identity(p, "p_size", "agree", "name", "shared").select("p_partkey", "verdict")
