"""Queries of the window operators, and the flagship query."""

from pyspark.sql import functions as F

from ..functions import scalars as S
from ..operators import windows as W
from .bindings import oracle, view
from .registry import query

ROLL = "SELECT event_id, entity_id, period, sum(score) OVER w AS running, count(*) OVER w AS n FROM scores WINDOW w AS (PARTITION BY event_id, entity_id ORDER BY period ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"
AFTER = "SELECT event_id, entity_id, CAST(sum(score) AS BIGINT) AS total, rank() OVER (PARTITION BY event_id ORDER BY sum(score)) AS position FROM scores WHERE period <= {n} GROUP BY 1, 2 HAVING count(*) = {n}"


@query("flagship_scoring_percentile", oracle("""
WITH field AS (SELECT event_id, period, sum(score) AS s, count(*) AS n FROM scores GROUP BY 1, 2 HAVING count(*) >= 20),
d AS (SELECT entity_id, CAST(floor(s / n * 1000000 + 0.5) AS BIGINT) - score * 1000000 AS micro FROM scores JOIN field USING (event_id, period)),
e AS (SELECT entity_id, CAST(sum(micro) AS BIGINT) AS micro, count(*) AS rounds FROM d GROUP BY 1),
m AS (SELECT e.*, cohort, floor(micro / rounds / 10000 + 0.5) / 100 AS scoring, CASE WHEN rounds >= 40 THEN 'HIGH' WHEN rounds >= 20 THEN 'MEDIUM' WHEN rounds >= 8 THEN 'LIMITED' ELSE 'INSUFFICIENT' END AS tier FROM e JOIN cohort USING (entity_id)),
v AS (SELECT *, CASE WHEN tier <> 'INSUFFICIENT' THEN scoring END AS v FROM m),
r AS (SELECT *, rank() OVER (PARTITION BY cohort ORDER BY v NULLS LAST) - 1 AS worse, count(v) OVER (PARTITION BY cohort, v) AS eq, count(v) OVER (PARTITION BY cohort) AS n FROM v)
SELECT entity_id, cohort, rounds, scoring, tier, n AS cohort_size, CASE WHEN v IS NOT NULL AND n >= 10 THEN CAST(floor(100.0 * (worse + (eq - 1) / 2.0) / (n - 1) + 0.5) AS BIGINT) END AS percentile FROM r"""))
def flagship(spark, sf_dir):
    """Field averages, field-relative deltas, scoring per entity, tier, and mid-rank percentile in the cohort."""
    scores = view(spark, sf_dir, "scores")
    field = scores.groupBy("event_id", "period").agg(F.sum("score").alias("s"), F.count("*").alias("n")).where("n >= 20")
    micro = F.floor(F.col("s") / F.col("n") * 1000000 + 0.5).cast("long") - F.col("score") * 1000000
    each = scores.join(field, ["event_id", "period"]).groupBy("entity_id").agg(F.sum(micro).alias("micro"), F.count("*").alias("rounds"))
    metric = each.join(view(spark, sf_dir, "cohort"), "entity_id").withColumn("scoring", F.floor(F.col("micro") / F.col("rounds") / 10000 + 0.5) / 100).withColumn("tier", S.tier("rounds", "rounds"))
    ranked = W.midrank_percentile(metric, ["cohort"], "scoring", eligible=F.col("tier") != "INSUFFICIENT")
    return ranked.select("entity_id", "cohort", "rounds", "scoring", "tier", "cohort_size", "percentile")


@query("w02_percentile_simple", oracle("SELECT event_id, entity_id, 100.0 * (rank() OVER (PARTITION BY event_id ORDER BY total DESC) - 1 + count(*) OVER (PARTITION BY event_id, total) / 2.0) / count(*) OVER (PARTITION BY event_id) AS percentile FROM entries"))
def w02(spark, sf_dir):
    return W.percentile_simple(view(spark, sf_dir, "entries"), ["event_id"], "total", "lower", 1).select("event_id", "entity_id", "percentile")


@query("w03_competition_rank", oracle("SELECT event_id, entity_id, total, rank() OVER (PARTITION BY event_id ORDER BY total) AS position, count(*) OVER (PARTITION BY event_id, total) > 1 AS tied FROM entries"))
def w03(spark, sf_dir):
    return W.competition_rank(view(spark, sf_dir, "totals"), ["event_id"], "total").select("event_id", "entity_id", "total", "position", "tied")


@query("w04_apply_playoff", oracle("""
WITH e AS (SELECT event_id, entity_id, position, count(*) OVER (PARTITION BY event_id, total) > 1 AS tied FROM entries), w AS (SELECT event_id, max(entity_id) AS win FROM e WHERE position = 1 GROUP BY 1 HAVING count(*) > 1),
o AS (SELECT e.*, win, sum(CASE WHEN position = 1 AND entity_id <> win THEN 1 END) OVER (PARTITION BY e.event_id) AS others FROM e LEFT JOIN w ON e.event_id = w.event_id)
SELECT event_id, entity_id, CAST(CASE WHEN position = 1 AND win IS NOT NULL THEN CASE WHEN entity_id = win THEN 1 ELSE 2 END ELSE position END AS BIGINT) AS position,
CASE WHEN position = 1 AND win IS NOT NULL THEN CASE WHEN entity_id = win THEN false ELSE others > 1 END ELSE tied END AS tied FROM o"""))
def w04(spark, sf_dir):
    ranked = W.competition_rank(view(spark, sf_dir, "totals"), ["event_id"], "total")
    winner = ranked.where("position = 1").groupBy("event_id").agg(F.max("entity_id").alias("entity_id"), F.count("*").alias("n")).where("n > 1").drop("n")
    return W.apply_playoff(ranked, winner, "event_id", "entity_id").select("event_id", "entity_id", "position", "tied")


@query("w05_last_n_mean", oracle("SELECT entity_id, count(*) AS sample, CAST(sum(total) AS BIGINT) AS total, sum(total) / count(*) AS mean FROM (SELECT *, row_number() OVER (PARTITION BY entity_id ORDER BY event_id DESC) AS k FROM entries) WHERE k <= 10 GROUP BY 1"))
def w05(spark, sf_dir):
    return W.last_n_mean(view(spark, sf_dir, "entries"), "entity_id", ["event_id"], "total")


@query("w06_leaders_timeline", oracle(f"WITH r AS ({ROLL}), b AS (SELECT *, min(running) OVER (PARTITION BY event_id, period) AS best FROM r WHERE n = period) SELECT event_id, period, CAST(best AS BIGINT) AS best, count(*) AS holders, min(entity_id) AS first_holder FROM b WHERE running = best GROUP BY 1, 2, 3"))
def w06(spark, sf_dir):
    return W.leaders_timeline(view(spark, sf_dir, "scores"))


@query("w07_standings_after", oracle(AFTER.format(n=2)))
def w07(spark, sf_dir):
    return W.standings_after(view(spark, sf_dir, "scores"), 2).drop("tied")


@query("w08_trend", oracle("""WITH k AS (SELECT entity_id, total, row_number() OVER (PARTITION BY entity_id ORDER BY event_id DESC) AS k FROM entries),
t AS (SELECT entity_id, count(*) AS n, avg(total) FILTER (k <= 3) AS recent, avg(total) FILTER (k > 3) AS before FROM k WHERE k <= 6 GROUP BY 1)
SELECT *, CASE WHEN n < 4 THEN NULL WHEN recent - before > 0.4 THEN 'up' WHEN recent - before < -0.4 THEN 'down' ELSE 'level' END AS direction FROM t"""))
def w08(spark, sf_dir):
    return W.trend(view(spark, sf_dir, "entries"), "entity_id", ["event_id"], "total")


@query("w09_runs", oracle("""WITH k AS (SELECT entity, moved, row_number() OVER (PARTITION BY entity ORDER BY tick) AS k, count(*) OVER (PARTITION BY entity) AS n FROM ticks),
g AS (SELECT *, k - sum(CASE WHEN moved > 5000 THEN 1 ELSE 0 END) OVER (PARTITION BY entity ORDER BY k) AS g FROM k)
SELECT entity, min(k) AS first, count(*) AS length, max(k) = max(n) AS trailing FROM g WHERE moved > 5000 GROUP BY entity, g"""))
def w09(spark, sf_dir):
    return W.runs(view(spark, sf_dir, "ticks"), ["entity"], ["tick"], F.col("moved") > 5000)


@query("w10_difficulty_rank", oracle("""WITH v AS (SELECT event_id, period, sum(score) / count(*) AS mean, count(*) AS n FROM scores GROUP BY 1, 2 HAVING count(*) >= 10)
SELECT event_id, period, mean, n, rank() OVER (PARTITION BY event_id ORDER BY floor(mean * 1000 + 0.5) DESC) AS rank, count(*) OVER (PARTITION BY event_id, floor(mean * 1000 + 0.5)) > 1 AS tied FROM v"""))
def w10(spark, sf_dir):
    means = view(spark, sf_dir, "scores").groupBy("event_id", "period").agg((F.sum("score") / F.count("*")).alias("mean"), F.count("*").alias("n"))
    return W.difficulty_rank(means, ["event_id"], "mean", "n")


@query("w11_movement", oracle("SELECT entity, tick, state, previous, state - previous AS change FROM (SELECT entity, tick, state, lag(state) OVER (PARTITION BY entity ORDER BY tick) AS previous, row_number() OVER (PARTITION BY entity ORDER BY tick DESC) AS k FROM states) WHERE k = 1"))
def w11(spark, sf_dir):
    return W.movement(view(spark, sf_dir, "states").select("entity", "tick", "state"), ["entity"], "tick", "state")


@query("w12_biggest_mover", oracle("SELECT entity, count(*) AS n, arg_min(state, tick) AS first, arg_max(state, tick) AS last, arg_max(state, tick) - arg_min(state, tick) AS change FROM states GROUP BY 1 HAVING count(*) >= 3"))
def w12(spark, sf_dir):
    return W.biggest_mover(view(spark, sf_dir, "states"), ["entity"], "tick", "state")


@query("w13_climbers", oracle(f"""WITH a AS ({AFTER.format(n=2)}), b AS ({AFTER.format(n=1)}),
m AS (SELECT a.event_id, a.entity_id, a.position AS now, b.position AS before, b.position - a.position AS gain FROM a JOIN b USING (event_id, entity_id)),
k AS (SELECT *, row_number() OVER (PARTITION BY event_id ORDER BY gain DESC, entity_id) AS k FROM m WHERE gain > 0 AND ((now <= 10 AND before > 10) OR gain >= 8)) SELECT event_id, entity_id, now, before, gain FROM k WHERE k <= 3"""))
def w13(spark, sf_dir):
    return W.climbers(view(spark, sf_dir, "scores"), 2)


@query("w14_latest_per", oracle("SELECT entity, status, tick, state FROM (SELECT *, row_number() OVER (PARTITION BY entity, status ORDER BY tick DESC) AS k FROM states) WHERE k = 1"))
def w14(spark, sf_dir):
    return W.latest_per(view(spark, sf_dir, "states"), ["entity", "status"], ["tick"]).select("entity", "status", "tick", "state")


@query("w15_current_and_history", oracle("WITH x AS (SELECT entity_id, array_agg(kind ORDER BY start_on DESC, kind DESC) AS a FROM results GROUP BY 1) SELECT entity_id, a[1] AS current, array_to_string(a[2:], ',') AS history FROM x"))
def w15(spark, sf_dir):
    held = W.current_and_history(view(spark, sf_dir, "results"), ["entity_id"], "start_on", "kind")
    return held.withColumn("history", F.array_join("history", ","))


@query("w16_version_changes", oracle("""WITH v AS (SELECT entity_id, entry_id, kind, lag(kind) OVER w AS k0, status, lag(status) OVER w AS s0 FROM results WINDOW w AS (PARTITION BY entity_id ORDER BY entry_id))
SELECT entity_id, entry_id, 'kind' AS slot, k0 AS before, kind AS after FROM v WHERE k0 <> kind UNION ALL SELECT entity_id, entry_id, 'status', s0, status FROM v WHERE s0 <> status"""))
def w16(spark, sf_dir):
    return W.version_changes(view(spark, sf_dir, "results"), ["entity_id"], "entry_id", ["kind", "status"])


@query("w17_margins", oracle("""WITH m AS (SELECT event_id, entity_id, total, lead(total) OVER w - total AS gap, row_number() OVER w AS k FROM entries WINDOW w AS (PARTITION BY event_id ORDER BY total, entity_id)) SELECT event_id, entity_id, total, gap, CASE WHEN k = 1 THEN gap END AS margin FROM m"""))
def w17(spark, sf_dir):
    return W.margins(view(spark, sf_dir, "totals").select("event_id", "entity_id", "total"), ["event_id"], "total", "entity_id")


HALVES = "SELECT event_id, entity_id, CAST((period - 1) // 4 + 1 AS BIGINT) AS period, CAST(sum(score) AS BIGINT) AS score FROM scores GROUP BY 1, 2, 3"


@query("w18_wire_to_wire", oracle(f"""WITH h AS ({HALVES}), r AS ({ROLL.replace("scores", "h")}), f AS (SELECT *, rank() OVER (PARTITION BY event_id, period ORDER BY running) = 1 AS lead, max(period) OVER (PARTITION BY event_id) AS last FROM r WHERE n = period)
SELECT event_id, entity_id, count(*) AS periods FROM f GROUP BY 1, 2 HAVING bool_and(lead) AND count(*) = max(last)"""))
def w18(spark, sf_dir):
    """First after each half of an event."""
    halves = view(spark, sf_dir, "scores").groupBy("event_id", "entity_id", F.floor((F.col("period") - 1) / 4 + 1).alias("period")).agg(F.sum("score").alias("score"))
    return W.wire_to_wire(halves)


@query("w19_comeback", oracle(f"""WITH a AS ({AFTER.format(n=2)}), b AS (SELECT *, total - min(total) OVER (PARTITION BY event_id) AS deficit FROM ({AFTER.format(n=1)})),
p AS (SELECT event_id, entity_id, rank() OVER (PARTITION BY event_id ORDER BY score) AS period_rank FROM scores WHERE period = 2)
SELECT a.event_id, a.entity_id, deficit, b.position - 1 AS ahead, period_rank FROM a JOIN b USING (event_id, entity_id) JOIN p USING (event_id, entity_id) WHERE a.position = 1"""))
def w19(spark, sf_dir):
    return W.comeback(view(spark, sf_dir, "scores"), 2)


@query("w20_minmax", oracle("""SELECT event_id, entity_id, CASE WHEN count(*) OVER w < 9 THEN NULL WHEN max(total) OVER w = min(total) OVER w THEN 0.5 ELSE (total - min(total) OVER w) / (max(total) OVER w - min(total) OVER w) END AS scaled FROM entries WINDOW w AS (PARTITION BY event_id)"""))
def w20(spark, sf_dir):
    return W.minmax(view(spark, sf_dir, "totals"), ["event_id"], "total").select("event_id", "entity_id", "scaled")


@query("w21_step_gaps", oracle("""WITH g AS (SELECT entity, tick, date_diff('second', tick, lead(tick) OVER (PARTITION BY entity ORDER BY tick)) AS gap FROM ticks) SELECT entity, tick, gap, coalesce(gap > 86400, false) AS long_gap FROM g"""))
def w21(spark, sf_dir):
    return W.step_gaps(view(spark, sf_dir, "ticks").select("entity", "tick"), ["entity"], "tick", 86400)


@query("w22_status_since", oracle("""WITH c AS (SELECT *, CASE WHEN status IS DISTINCT FROM lag(status) OVER (PARTITION BY entity ORDER BY tick) THEN 1 ELSE 0 END AS c FROM states),
r AS (SELECT *, sum(c) OVER (PARTITION BY entity ORDER BY tick) AS run FROM c), s AS (SELECT *, min(tick) OVER (PARTITION BY entity, run) AS since, row_number() OVER (PARTITION BY entity ORDER BY tick DESC) AS k FROM r) SELECT entity, tick, status, since FROM s WHERE k = 1"""))
def w22(spark, sf_dir):
    return W.status_since(view(spark, sf_dir, "states"), ["entity"], "tick", "status").select("entity", "tick", "status", "since")


@query("w23_narrative_signals", oracle("""WITH e AS (SELECT *, max(period) OVER (PARTITION BY event_id, entity_id) AS last FROM scores),
t AS (SELECT event_id, entity_id, count(*) AS n, CAST(max(score) FILTER (period = last) AS BIGINT) AS last, max(score) - min(score) AS spread, sum(score) FILTER (period < last) AS s FROM e GROUP BY 1, 2 HAVING count(*) > 1)
SELECT event_id, entity_id, n, last, spread, s / (n - 1) - last AS improvement, s / (n - 1) - last >= 3 AS surge, spread <= 3 AS consistent FROM t"""))
def w23(spark, sf_dir):
    return W.narrative_signals(view(spark, sf_dir, "scores"))


@query("w24_within_k", oracle("""WITH b AS (SELECT event_id, entity_id, total, total - min(total) OVER (PARTITION BY event_id) AS behind FROM entries) SELECT *, count(*) OVER (PARTITION BY event_id) AS within FROM b WHERE behind <= 2"""))
def w24(spark, sf_dir):
    return W.within_k(view(spark, sf_dir, "totals").select("event_id", "entity_id", "total"), ["event_id"], "total", 2)


@query("w25_streak_until", oracle("""WITH s AS (SELECT *, max(CASE WHEN status = 'F' THEN 1 ELSE 0 END) OVER (PARTITION BY entity_id ORDER BY start_on DESC, entry_id ROWS UNBOUNDED PRECEDING) AS stopped FROM results) SELECT entity_id, count(*) FILTER (stopped = 0 AND status = 'O') AS streak FROM s GROUP BY 1"""))
def w25(spark, sf_dir):
    return W.streak_until(view(spark, sf_dir, "results"), ["entity_id"], [F.col("start_on").desc(), F.col("entry_id")], F.col("status") == "O", F.col("status") == "F")
