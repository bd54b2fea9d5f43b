"""Compositions that users see: profiles, documents, contexts, matchups, boards, packets and gates."""

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions.scalars import ACCENTED, PLAIN, fold
from ..operators import aggregates as A
from ..operators import joins as J
from ..operators import ledger as L
from ..operators import ranking as T
from ..operators import studies as U
from ..operators import text_gates as G
from ..operators import windows as W
from .aggregates import DIST, HIST, REPLAY, by_year, venue_entries
from .bindings import oracle, view
from .joins import H2H
from .registry import query
from .windows import ROLL


@query("p01_entity_profile", oracle(f"""WITH d AS ({DIST}), f AS (SELECT entity_id, sum(total) / count(*) AS form FROM (SELECT *, row_number() OVER (PARTITION BY entity_id ORDER BY event_id DESC) AS k FROM entries) WHERE k <= 10 GROUP BY 1), v AS (SELECT entity_id, count(DISTINCT event_id % 12) AS venues FROM entries GROUP BY 1)
SELECT entity_id, cohort, starts, wins, top10, made, form, venues FROM d JOIN f USING (entity_id) JOIN v USING (entity_id) JOIN cohort USING (entity_id)"""))
def p01(spark, sf_dir):
    e = view(spark, sf_dir, "entries")
    d = A.finish_distribution(e, ["entity_id"], "position", "status").select("entity_id", "starts", "wins", "top10", "made")
    form = W.last_n_mean(e, "entity_id", ["event_id"], "total").select("entity_id", F.col("mean").alias("form"))
    venues = A.distinct_dims(venue_entries(spark, sf_dir), "entity_id", "venue_id").select("entity_id", F.col("distinct").alias("venues"))
    return d.join(form, "entity_id").join(venues, "entity_id").join(view(spark, sf_dir, "cohort"), "entity_id")


@query("p02_event_document", oracle("""WITH m AS (SELECT event_id, entity_id, total, position, lead(total) OVER w - total AS gap, row_number() OVER w AS k FROM entries WINDOW w AS (PARTITION BY event_id ORDER BY total, entity_id)), c AS (SELECT event_id, count(*) AS field, count(*) FILTER (status = 'cut') AS missed FROM entries GROUP BY 1)
SELECT m.event_id, event_id % 12 AS venue_id, field, missed, entity_id AS leader, total AS winning, gap AS margin FROM m JOIN c USING (event_id) WHERE k = 1"""))
def p02(spark, sf_dir):
    e = view(spark, sf_dir, "entries")
    lead = T.keep_first(W.margins(e.select("event_id", "entity_id", "total"), ["event_id"], "total", "entity_id"), ["event_id"], [F.col("total"), F.col("entity_id")], 1)
    field = e.groupBy("event_id").agg(F.count("*").alias("field"), F.count_if(F.col("status") == "cut").alias("missed"))
    return lead.join(field, "event_id").join(view(spark, sf_dir, "venue"), "event_id").select("event_id", "venue_id", "field", "missed", F.col("entity_id").alias("leader"), F.col("total").alias("winning"), "margin")


def shown(column: str, *fields: str):
    """The rows of a nested array as text, so that they can be compared."""
    return F.array_join(F.transform(column, lambda x: F.concat_ws(":", *(F.coalesce(x[f].cast("string"), F.lit("-")) for f in fields))), ",").alias(column)


@query("p01_entity_document", oracle(f"""WITH d AS ({DIST}), s AS (SELECT entity_id, event_id // 100 AS season, count(*) AS starts, count(*) FILTER (position = 1) AS wins, min(total) AS best FROM entries GROUP BY 1, 2), v AS (SELECT entity_id, event_id % 12 AS venue_id, count(*) AS starts, count(*) FILTER (position = 1) AS wins, min(position) AS best FROM entries GROUP BY 1, 2),
l AS (SELECT entity_id, event_id, position, total FROM entries QUALIFY row_number() OVER (PARTITION BY entity_id ORDER BY event_id DESC) <= 5), ss AS (SELECT entity_id, string_agg(season || ':' || starts || ':' || wins || ':' || best, ',' ORDER BY season) AS seasons FROM s GROUP BY 1),
vv AS (SELECT entity_id, string_agg(venue_id || ':' || starts || ':' || wins || ':' || best, ',' ORDER BY venue_id) AS venues FROM v GROUP BY 1), ll AS (SELECT entity_id, string_agg(event_id || ':' || position || ':' || total, ',' ORDER BY event_id) AS results FROM l GROUP BY 1)
SELECT entity_id, cohort, starts, wins, top10, made, seasons, venues, results FROM d JOIN cohort USING (entity_id) JOIN ss USING (entity_id) JOIN vv USING (entity_id) JOIN ll USING (entity_id)"""))
def p01_document(spark, sf_dir):
    """Summary, seasons, venue history and the latest results of each entity."""
    e = view(spark, sf_dir, "entries")
    base = A.finish_distribution(e, ["entity_id"], "position", "status").select("entity_id", "starts", "wins", "top10", "made").join(view(spark, sf_dir, "cohort"), "entity_id")
    season = e.groupBy("entity_id", F.expr("event_id div 100").alias("season")).agg(F.count("*").alias("starts"), F.count_if(F.col("position") == 1).alias("wins"), F.min("total").alias("best"))
    venue = A.venue_history(venue_entries(spark, sf_dir), "entity_id", "venue_id", "event_id", "position", "status").select("entity_id", "venue_id", "starts", "wins", "best")
    latest = T.keep_first(e.select("entity_id", "event_id", "position", "total"), ["entity_id"], [F.col("event_id").desc()], 5)
    done = U.nest(base, "entity_id", {"seasons": (season, ["season"]), "venues": (venue, ["venue_id"]), "results": (latest, ["event_id"])})
    return done.select("entity_id", "cohort", "starts", "wins", "top10", "made", shown("seasons", "season", "starts", "wins", "best"), shown("venues", "venue_id", "starts", "wins", "best"), shown("results", "event_id", "position", "total"))


@query("p02_event_timeline", oracle(f"""WITH r AS ({ROLL}), b AS (SELECT *, min(running) OVER (PARTITION BY event_id, period) AS best FROM r WHERE n = period), t AS (SELECT event_id, period, CAST(best AS BIGINT) AS best, count(*) AS holders FROM b WHERE running = best GROUP BY 1, 2, 3), w AS (SELECT event_id, entity_id, total FROM entries QUALIFY row_number() OVER (PARTITION BY event_id ORDER BY total, entity_id) = 1),
p AS (SELECT a.event_id, b.event_id AS past, b.entity_id, b.total FROM w a JOIN w b ON a.event_id % 100 = b.event_id % 100 AND b.event_id < a.event_id), q AS (SELECT event_id, entity_id, row_number() OVER (PARTITION BY event_id ORDER BY total, entity_id) AS k FROM entries), m AS (SELECT x.event_id, x.entity_id AS a, y.entity_id AS b FROM q x JOIN q y ON x.event_id = y.event_id AND y.k = x.k + 1 WHERE x.k IN (1, 3)),
tt AS (SELECT event_id, string_agg(period || ':' || best || ':' || holders, ',' ORDER BY period) AS timeline FROM t GROUP BY 1), pp AS (SELECT event_id, string_agg(past || ':' || entity_id || ':' || total, ',' ORDER BY past) AS editions FROM p GROUP BY 1), mm AS (SELECT event_id, string_agg(a || ':' || b, ',' ORDER BY a) AS matchups FROM m GROUP BY 1)
SELECT event_id, entity_id AS winner, total, coalesce(timeline, '') AS timeline, coalesce(editions, '') AS editions, coalesce(matchups, '') AS matchups FROM w LEFT JOIN tt USING (event_id) LEFT JOIN pp USING (event_id) LEFT JOIN mm USING (event_id)"""))
def p02_timeline(spark, sf_dir):
    """The winner of each event, who led after each period, who won its past editions, and the pairs at the top."""
    e = view(spark, sf_dir, "entries").select("event_id", "entity_id", "total")
    ranked = e.withColumn("k", F.row_number().over(Window.partitionBy("event_id").orderBy("total", "entity_id")))
    winners = ranked.where("k = 1").select("event_id", F.col("entity_id").alias("winner"), "total")
    past = winners.select(F.expr("event_id % 100").alias("series"), F.col("event_id").alias("past"), F.col("winner").alias("past_winner"), F.col("total").alias("past_total"))
    editions = winners.withColumn("series", F.expr("event_id % 100")).join(past, "series").where("past < event_id").select("event_id", "past", "past_winner", "past_total")
    pairs = ranked.withColumn("b", F.lead("entity_id").over(Window.partitionBy("event_id").orderBy("k"))).where("k in (1, 3) and b is not null").select("event_id", F.col("entity_id").alias("a"), "b")
    led = W.leaders_timeline(view(spark, sf_dir, "scores")).select("event_id", "period", "best", "holders")
    done = U.nest(winners, "event_id", {"timeline": (led, ["period"]), "editions": (editions, ["past"]), "matchups": (pairs, ["a"])})
    return done.select("event_id", "winner", "total", shown("timeline", "period", "best", "holders"), shown("editions", "past", "past_winner", "past_total"), shown("matchups", "a", "b"))


@query("p03_field_context", oracle("""WITH h AS (SELECT a.event_id, a.entity_id, count(b.total) AS prior, CAST(sum(b.total) AS BIGINT) AS prior_total FROM entries a LEFT JOIN entries b ON a.entity_id = b.entity_id AND b.start_on < a.start_on AND b.start_on >= a.start_on - 365 GROUP BY 1, 2),
r AS (SELECT *, row_number() OVER (PARTITION BY event_id ORDER BY prior_total / prior NULLS LAST, entity_id) AS k FROM h) SELECT event_id, count(*) AS field, count(*) FILTER (prior = 0) AS first_appearances, max(entity_id) FILTER (k = 1) AS form_leader FROM r GROUP BY 1"""))
def p03_whole(spark, sf_dir):
    h = J.history_before(view(spark, sf_dir, "entries"), "entity_id", "start_on", "total", 365)
    form = F.col("prior_total") / F.nullif("prior", F.lit(0))
    return h.groupBy("event_id").agg(F.count("*").alias("field"), F.count_if(F.col("prior") == 0).alias("first_appearances"), F.min_by("entity_id", F.struct(form.isNull(), form, "entity_id")).alias("form_leader"))


@query("p04_venue_document", oracle(f"""WITH h AS ({HIST}), k AS (SELECT *, row_number() OVER (PARTITION BY venue_id ORDER BY mean_finish NULLS LAST, entity_id) AS k FROM h WHERE starts >= 2), n AS (SELECT event_id % 12 AS venue_id, count(DISTINCT event_id) AS events FROM entries GROUP BY 1) SELECT venue_id, events, entity_id AS leader, starts FROM k JOIN n USING (venue_id) WHERE k = 1"""))
def p04(spark, sf_dir):
    e = venue_entries(spark, sf_dir)
    h = A.venue_history(e, "entity_id", "venue_id", "event_id", "position", "status", F.col("event_id") < 199706).where("starts >= 2")
    lead = T.keep_first(h, ["venue_id"], [F.col("mean_finish").asc_nulls_last(), F.col("entity_id")], 1)
    return lead.join(e.groupBy("venue_id").agg(F.count_distinct("event_id").alias("events")), "venue_id").select("venue_id", "events", F.col("entity_id").alias("leader"), "starts")


@query("p05_index_tables", oracle("""WITH y AS (SELECT kind, season, count(*) AS n, CAST(sum(points) AS BIGINT) AS points FROM results GROUP BY 1, 2) SELECT a.kind, a.season, a.n, a.points, b.points AS previous_points FROM y a LEFT JOIN y b ON a.kind = b.kind AND a.season = b.season + 1"""))
def p05(spark, sf_dir):
    y = view(spark, sf_dir, "results").groupBy("kind", "season").agg(F.count("*").alias("n"), F.sum("points").alias("points"))
    return J.previous_period(y, ["kind"], "season", "points")


@query("p06_matchup", oracle(f"""WITH h AS ({H2H}), v AS (SELECT entity_id, event_id % 12 AS venue_id, count(*) AS n FROM entries GROUP BY 1, 2) SELECT a, b, any_value(shared) AS shared, any_value(a_higher) AS a_higher, count(*) AS common_venues FROM h JOIN v x ON x.entity_id = a JOIN v y ON y.entity_id = b AND x.venue_id = y.venue_id GROUP BY 1, 2"""))
def p06(spark, sf_dir):
    e = view(spark, sf_dir, "entries")
    pairs = e.select(F.col("entity_id").alias("a"), (F.col("entity_id") + 1).alias("b")).distinct()
    h = J.head_to_head(e, pairs, "event_id", "entity_id", "position", "status").select("a", "b", "shared", "a_higher")
    v = e.select("entity_id", (F.col("event_id") % 12).alias("venue_id")).distinct()
    both = J.common_dims(h.join(v.withColumnRenamed("entity_id", "a"), "a"), v.withColumnRenamed("entity_id", "b"), ["b", "venue_id"])
    return both.groupBy("a", "b").agg(F.max("shared").alias("shared"), F.max("a_higher").alias("a_higher"), F.count("*").alias("common_venues"))


@query("p07_live_board", oracle("""WITH l AS (SELECT entity, state, status, row_number() OVER (PARTITION BY entity ORDER BY tick DESC) AS k FROM states), b AS (SELECT *, max(state) OVER (PARTITION BY status) - state AS behind FROM l WHERE k = 1) SELECT entity, status, state, rank() OVER (PARTITION BY status ORDER BY state DESC) AS position, behind FROM b"""))
def p07(spark, sf_dir):
    now = W.latest_per(view(spark, sf_dir, "states"), ["entity"], ["tick"]).withColumn("neg", -F.col("state"))
    b = W.competition_rank(now, ["status"], "neg")
    return b.select("entity", "status", "state", "position", (F.col("neg") - F.min("neg").over(W.Window.partitionBy("status"))).alias("behind"))


def result_table(spark, sf_dir):
    e = view(spark, sf_dir, "entries")
    return e.selectExpr("event_id", "entity_id", "event_id % 10 <> 3 AS final", "4 AS periods", "CASE WHEN entity_id % 19 = 0 THEN 'dns' ELSE status END AS status", "position", "event_id % 2 = 0 AS real_cut", "periods AS entity_periods", "total AS early")


@query("p08_grade", oracle("""WITH w AS (SELECT event_id, count(*) AS winners FROM entries WHERE position = 1 GROUP BY 1), r AS (SELECT e.event_id, entity_id, event_id % 10 <> 3 AS final, CASE WHEN entity_id % 19 = 0 THEN 'dns' ELSE status END AS s, position, event_id % 2 = 0 AS real_cut, winners FROM entries e LEFT JOIN w USING (event_id)),
f AS (SELECT *, ['winner', 'top10', 'make_cut'][entity_id % 3 + 1] AS family FROM r) SELECT event_id, entity_id, family, CASE WHEN entity_id % 23 = 0 THEN 'PENDING' WHEN NOT final THEN 'VOID' WHEN family = 'winner' THEN CASE WHEN s = 'dns' OR (position = 1 AND winners > 1) THEN 'VOID' WHEN position = 1 THEN 'WIN' ELSE 'LOSS' END
WHEN family = 'top10' THEN CASE WHEN s = 'dns' THEN 'VOID' WHEN s = 'finished' AND position <= 10 THEN 'WIN' ELSE 'LOSS' END ELSE CASE WHEN NOT real_cut THEN 'VOID' WHEN s = 'finished' THEN 'WIN' WHEN s = 'cut' THEN 'LOSS' ELSE 'VOID' END END AS grade FROM f WHERE (event_id, entity_id) NOT IN (SELECT (event_id, entity_id) FROM f WHERE entity_id % 23 = 0 AND position = 1)"""))
def p08(spark, sf_dir):
    r = result_table(spark, sf_dir)
    locks = r.where("not (entity_id % 23 = 0 and position = 1)").select("event_id", "entity_id", F.element_at(F.array(F.lit("winner"), F.lit("top10"), F.lit("make_cut")), (F.col("entity_id") % 3 + 1).cast("int")).alias("family"))
    return L.grade(locks, r.where("entity_id % 23 <> 0 or position = 1"), "event_id", "entity_id", "family")


@query("p10_public_record", oracle("SELECT family, count(*) AS n, count(*) FILTER (hit = 1) AS win, count(*) FILTER (hit = 0 AND entity_id <> 7) AS loss, count(*) FILTER (hit = 0 AND entity_id = 7) AS void FROM probs WHERE entity_id <> 6 GROUP BY 1"))
def p10(spark, sf_dir):
    g = view(spark, sf_dir, "probs").selectExpr("family", "CASE WHEN entity_id = 6 THEN 'PENDING' WHEN hit = 1 THEN 'WIN' WHEN entity_id = 7 THEN 'VOID' ELSE 'LOSS' END AS grade")
    return L.public_record(g, "family")


@query("p11_walk_forward", oracle("""WITH c AS (SELECT * FROM (VALUES ('tune', DATE '1995-01-01', DATE '1996-01-01'), ('validate', DATE '1996-01-01', DATE '1997-01-01'), ('holdout', DATE '1997-01-01', DATE '1998-01-01')) f(fold, lo, hi), (VALUES (0, 365.0::DOUBLE), (1, 730.0::DOUBLE)) g(setting, tau)),
r AS (SELECT fold, setting, entity_id, (sum(exp(-date_diff('day', start_on, lo) / tau) * total) + 1.5) / (sum(exp(-date_diff('day', start_on, lo) / tau)) + 3) AS mu FROM entries, c WHERE start_on < lo GROUP BY 1, 2, 3),
p AS (SELECT c.fold, c.setting, (position <= 10)::INT AS y, 1 / (1 + exp(coalesce(mu, 0) / 100)) AS p FROM entries e JOIN c ON e.start_on >= lo AND e.start_on < hi LEFT JOIN r ON r.fold = c.fold AND r.setting = c.setting AND r.entity_id = e.entity_id),
b AS (SELECT fold, setting, least(floor(p * 10), 9) AS b, count(*) AS n, sum(-(y * ln(greatest(1e-4, least(1 - 1e-4, p))) + (1 - y) * ln(1 - greatest(1e-4, least(1 - 1e-4, p))))) AS loss, sum((p - y) * (p - y)) AS brier, sum(y) AS hits, sum(p) AS ps FROM p GROUP BY 1, 2, 3)
SELECT fold, setting, CAST(sum(n) AS BIGINT) AS n, round(sum(loss) / sum(n), 9) AS log_loss, round(sum(brier) / sum(n), 9) AS brier, round(sum(abs(hits - ps)) / sum(n), 9) AS ece, round(sum(hits) / sum(n), 9) AS base_rate, round(sum(ps) / sum(n), 9) AS mean_p FROM b GROUP BY 1, 2"""))
def p11(spark, sf_dir):
    e = view(spark, sf_dir, "entries").withColumn("hit", (F.col("position") <= 10).cast("int"))
    found = L.walk_forward(e, "entity_id", "start_on", "total", "hit", [("tune", "1995-01-01", "1996-01-01"), ("validate", "1996-01-01", "1997-01-01"), ("holdout", "1997-01-01", "1998-01-01")], [{"tau": 365.0}, {"tau": 730.0}])
    return found.withColumns({c: F.round(c, 9) for c in ("log_loss", "brier", "ece", "base_rate", "mean_p")})


@query("p11_grid_ranking", oracle(f"""WITH RECURSIVE g AS (SELECT * FROM (VALUES (0, 180.0::DOUBLE, 3.0::DOUBLE, 0.5::DOUBLE, 40.0::DOUBLE), (1, 730.0, 3.0, 0.5, 40.0), (2, 730.0, 12.0, 0.5, 10.0), (3, 365.0, 6.0, 2.0, 20.0)) v(setting, tau, k, mu0, kv)), {REPLAY},
l AS (SELECT CASE WHEN y IN (1996, 1997) THEN 'tune' WHEN y = 1998 THEN 'validate' WHEN y > 1998 THEN 'holdout' END AS fold, setting, count(*) AS n, avg(0.5 * ln(2 * pi() * (sd * sd + se * se)) + power(residual - mu, 2) / (2 * (sd * sd + se * se))) AS nll FROM x WHERE residual IS NOT NULL AND y > 1995 GROUP BY 1, 2),
o AS (SELECT *, CASE WHEN fold = 'tune' THEN row_number() OVER (PARTITION BY fold ORDER BY nll, setting) END AS place FROM l), b AS (SELECT setting AS best FROM o WHERE place = 1) SELECT fold, setting, n, round(nll, 6) AS nll, CAST(place AS INT) AS place, setting = best AS chosen FROM o, b WHERE fold = 'tune' OR setting = best"""))
def p11_grid(spark, sf_dir):
    e, days = by_year(spark, sf_dir)
    grid = [{"tau": 180.0}, {}, {"k": 12.0, "kv": 10.0}, {"tau": 365.0, "k": 6.0, "mu0": 2.0, "kv": 20.0}]
    folds = [("tune", "1996-01-01", "1998-01-01"), ("validate", "1998-01-01", "1999-01-01"), ("holdout", "1999-01-01", "9999-01-01")]
    return L.grid_ranking(e, "on", ["event_id"], "entity_id", "total", days, folds, grid, 5).withColumn("nll", F.round("nll", 6))


@query("p13_fact_packets", oracle("""WITH l AS (SELECT c_custkey, CAST(c_nationkey AS VARCHAR) AS source, 'cents' AS f, CAST(cents AS VARCHAR) AS value, 'balance' AS label FROM src_b WHERE cents IS NOT NULL UNION ALL SELECT c_custkey, CAST(c_nationkey AS VARCHAR), 'c_mktsegment', c_mktsegment, 'segment' FROM src_b WHERE c_mktsegment IS NOT NULL),
h AS (SELECT c_custkey, sha256(string_agg(c_custkey || ':' || f || '=' || value, ';' ORDER BY c_custkey || ':' || f || '=' || value)) AS packet_hash FROM l GROUP BY 1) SELECT c_custkey, CAST(source AS INT) AS source, value, label, c_custkey || ':' || f AS fact_id, 'A' AS class, packet_hash FROM l JOIN h USING (c_custkey)"""))
def p13(spark, sf_dir):
    return G.fact_packets(view(spark, sf_dir, "src_b"), "c_custkey", {"cents": "balance", "c_mktsegment": "segment"}, "c_nationkey")


@query("p14_story_candidates", oracle("""WITH s AS (SELECT entry_id, CASE WHEN points > 250000 THEN 3.0 ELSE 0 END + CASE WHEN status = 'F' THEN 1.0 ELSE 0 END + CASE WHEN kind = '1-URGENT' THEN 2.0 ELSE 0 END AS m, array_to_string(list_filter([CASE WHEN points > 250000 THEN 'large' END, CASE WHEN status = 'F' THEN 'done' END, CASE WHEN kind = '1-URGENT' THEN 'urgent' END], lambda x: x IS NOT NULL), ',') AS reasons FROM results) SELECT entry_id, CAST(m AS DOUBLE) AS material, reasons FROM s WHERE m >= 3"""))
def p14(spark, sf_dir):
    terms = {"large": (F.col("points") > 250000, 3), "done": (F.col("status") == "F", 1), "urgent": (F.col("kind") == "1-URGENT", 2)}
    return G.story_candidates(view(spark, sf_dir, "results"), "entry_id", terms).withColumn("reasons", F.array_join("reasons", ","))


@query("p16_publish_decision", oracle("""WITH a AS (SELECT c_nationkey AS k, c_custkey AS f, cents AS v FROM src_a), b AS (SELECT c_nationkey AS k, c_custkey AS f, cents AS v FROM src_b), m AS (SELECT coalesce(a.k, b.k) AS k, a.f IS NULL AS added, b.f IS NULL AS removed, a.f IS NOT NULL AND b.f IS NOT NULL AND a.v IS DISTINCT FROM b.v AS changed FROM a FULL JOIN b ON a.k = b.k AND a.f = b.f),
g AS (SELECT k AS c_nationkey, count(*) FILTER (changed) AS changed, count(*) FILTER (added) AS added, count(*) FILTER (removed) AS removed FROM m GROUP BY 1) SELECT *, CASE WHEN changed + added + removed = 0 THEN 'unchanged' WHEN changed = 0 AND removed = 0 THEN 'enrichment' WHEN changed = 0 THEN 'rewrite' ELSE 'correction' END AS decision FROM g"""))
def p16(spark, sf_dir):
    return G.publish_decision(view(spark, sf_dir, "src_a"), view(spark, sf_dir, "src_b"), "c_nationkey", "c_custkey", "cents")


@query("p17_text_gates", oracle(r"""WITH d AS (SELECT doc_id, regexp_replace(lower(coalesce(text, '')), '\{[fe]:[^}]*\}', ' ', 'g') AS t FROM documents),
c AS (SELECT doc_id, t, regexp_replace(t, '\b(front nine|back nine|top-ten)\b', ' ', 'g') AS c, regexp_replace(t, '\b(second|third|fourth|fifth|sixth|seventh|eighth|ninth|tenth)\b round', ' ', 'g') AS o, len(regexp_extract_all(t, '\S+')) AS n FROM d)
SELECT doc_id, array_to_string(list_filter([CASE WHEN regexp_matches(t, '[0-9]') THEN 'digits' END,
CASE WHEN regexp_matches(c, '\b(two|three|four|five|six|seven|eight|nine|ten|eleven|twelve|thirteen|fourteen|fifteen|sixteen|seventeen|eighteen|nineteen|twenty|thirty|forty|fifty|hundred|dozen)\b') THEN 'number_word' END,
CASE WHEN regexp_matches(o, '\b(second|third|fourth|fifth|sixth|seventh|eighth|ninth|tenth)\b') THEN 'ordinal_word' END,
CASE WHEN regexp_matches(t, '(idiot|moron|scum)') THEN 'banned:abuse' END, CASE WHEN n < 35 OR n > 1400 THEN 'length' END], lambda x: x IS NOT NULL), ',') AS reasons FROM c"""))
def p17(spark, sf_dir):
    d = view(spark, sf_dir, "documents")
    gates = G.text_gates(d, d.select("doc_id", F.lit("x").alias("fact_id")), "doc_id", "text", {"abuse": "(idiot|moron|scum)"})
    return gates.withColumn("reasons", F.array_join("reasons", ","))


@query("p18_pick_highlights", oracle("""WITH k AS (SELECT entity_id, entry_id, row_number() OVER (PARTITION BY entity_id ORDER BY points, entry_id) AS k, count(*) OVER (PARTITION BY entity_id) AS n FROM results WHERE season <> 1995) SELECT entity_id, string_agg(entry_id, ',' ORDER BY k) AS facts FROM k WHERE k <= 5 AND n >= 3 GROUP BY 1"""))
def p18(spark, sf_dir):
    r = view(spark, sf_dir, "results")
    return G.pick_highlights(r, "entity_id", "points", "entry_id", r.where("season = 1995"))


_FOLDED = f"trim(regexp_replace(lower(translate(regexp_replace({{}}, '[''’]', '', 'g'), '{ACCENTED}', '{PLAIN}')), '[^a-z0-9]+', ' ', 'g'))"


@query("p19_link_texts", oracle(rf"""WITH d AS (SELECT doc_id, text || ' ' || (1990 + doc_id % 50) AS text, 1990 + doc_id % 50 AS year, DATE '2024-01-01' + CAST(doc_id % 300 AS INT) AS seen FROM documents), t AS (SELECT *, ' ' || {_FOLDED.format('text')} || ' ' AS f FROM d),
i AS (SELECT item_id, string_split({_FOLDED.format('text')}, ' ') AS w FROM benchmark), n AS (SELECT array_to_string(w[1:2], ' ') AS name, item_id AS entity FROM i UNION ALL SELECT array_to_string(w[2:4], ' '), item_id + 1000 FROM i), u AS (SELECT name, min(entity) AS entity FROM n WHERE contains(name, ' ') GROUP BY name HAVING min(entity) = max(entity)),
v AS (SELECT item_id + k * 100 AS event, array_to_string(w[3:4], ' ') AS name, 1990 + (item_id + k) % 50 AS year, DATE '2024-01-01' + CAST((item_id * 7 + k * 20) % 300 AS INT) AS s, DATE '2024-01-03' + CAST((item_id * 7 + k * 20) % 300 AS INT) AS e FROM i, (VALUES (0), (1)) k(k)), h AS (SELECT DISTINCT event, regexp_replace(name, '^the ', '') AS name, year, s, e FROM v WHERE length(regexp_replace(name, '^the ', '')) >= 6),
l AS (SELECT doc_id, list_sort(list(DISTINCT entity)) AS l FROM t JOIN u ON contains(f, ' ' || name || ' ') GROUP BY 1), c AS (SELECT DISTINCT doc_id, event, h.year = t.year AS same, seen BETWEEN s - 10 AND e + 45 AS near, abs(e - seen) AS far FROM t JOIN h ON contains(f, ' ' || name || ' ')),
y AS (SELECT doc_id, min(event) AS titled FROM c WHERE same GROUP BY 1 HAVING min(event) = max(event)), o AS (SELECT doc_id, event, far, row_number() OVER w AS k, lead(far) OVER w AS next FROM c WHERE near WINDOW w AS (PARTITION BY doc_id ORDER BY far, event)), z AS (SELECT doc_id, event AS dated FROM o WHERE k = 1 AND (next IS NULL OR next - far > 7)),
r AS (SELECT t.doc_id, regexp_matches(text, 'License') AS fam, coalesce(l, []) AS l, coalesce(titled, dated) AS event, CASE WHEN titled IS NOT NULL THEN 'title_year' WHEN dated IS NOT NULL THEN 'date_window' END AS basis FROM t LEFT JOIN l ON l.doc_id = t.doc_id LEFT JOIN y ON y.doc_id = t.doc_id LEFT JOIN z ON z.doc_id = t.doc_id),
q AS (SELECT *, CASE WHEN basis IS NOT NULL AND (len(l) > 0 OR coalesce(fam, false)) THEN 'high' WHEN basis IS NOT NULL OR len(l) = 1 THEN 'medium' ELSE 'low' END AS confidence FROM r)
SELECT doc_id, CASE WHEN fam THEN 'licence' END AS family, array_to_string(l[1:6], ',') AS entities, len(l) AS n_entities, event, basis, confidence, CASE WHEN confidence = 'low' THEN 'review' ELSE 'published' END AS status FROM q"""))
def p19(spark, sf_dir):
    """Names and events are runs of words of the benchmark's items, which some documents hold; the year stands at the end."""
    d = view(spark, sf_dir, "documents").select("doc_id", F.concat_ws(" ", "text", (F.col("doc_id") % 50 + 1990).cast("string")).alias("text"), F.date_add(F.lit("2024-01-01").cast("date"), (F.col("doc_id") % 300).cast("int")).alias("at"))
    w = spark.read.parquet(f"{sf_dir}/benchmark.parquet").select("item_id", F.split(fold(F.regexp_replace("text", "['’]", "")), " ").alias("w"))
    run = lambda i, n: F.array_join(F.slice("w", i, n), " ").alias("name")
    names = w.select(run(1, 2), F.col("item_id").alias("entity")).unionByName(w.select(run(2, 3), (F.col("item_id") + 1000).alias("entity")))
    day = F.date_add(F.lit("2024-01-01").cast("date"), ((F.col("item_id") * 7 + F.col("k") * 20) % 300).cast("int"))
    held = w.withColumn("k", F.explode(F.array(F.lit(0), F.lit(1))))
    events = held.select((F.col("item_id") + F.col("k") * 100).alias("event"), run(3, 2), ((F.col("item_id") + F.col("k")) % 50 + 1990).alias("year"), day.alias("s"), F.date_add(day, 2).alias("e"))
    found = G.link_texts(d, "doc_id", "text", {"licence": "License"}, names, "name", "entity", "at", events, "event", "name", "year", "s", "e", strong=["licence"])
    return found.drop("evidence", "period").withColumn("entities", F.array_join(F.transform("entities", lambda x: x.cast("string")), ","))


@query("p25_collapse_multivalue", oracle("SELECT entity_id, CASE WHEN count(DISTINCT status) = 1 THEN max(status) END AS status, CASE WHEN count(DISTINCT kind) = 1 THEN max(kind) END AS kind, count(DISTINCT status) AS n_status, count(DISTINCT kind) AS n_kind FROM results GROUP BY 1"))
def p25(spark, sf_dir):
    return G.collapse_multivalue(view(spark, sf_dir, "results"), "entity_id", ["status", "kind"])


@query("p26_dated_snapshot", oracle("SELECT b.c_custkey, b.cents, CASE WHEN a.c_custkey IS NOT NULL AND a.cents = b.cents THEN DATE '2026-01-01' ELSE DATE '2026-10-01' END AS effective_on FROM src_b b LEFT JOIN src_a a USING (c_custkey)"))
def p26(spark, sf_dir):
    on = lambda df, d: df.select("c_custkey", "cents", F.lit(d).cast("date").alias("effective_on"))
    return G.dated_snapshot(on(view(spark, sf_dir, "src_a"), "2026-01-01"), on(view(spark, sf_dir, "src_b"), "2026-10-01"), ["c_custkey"], "cents", "effective_on")
