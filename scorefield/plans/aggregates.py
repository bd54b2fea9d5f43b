"""Queries of the aggregates."""

from pyspark.sql import functions as F

from ..operators import aggregates as A
from ..operators import windows as W
from .bindings import oracle, view
from .registry import query

DIST = "SELECT entity_id, count(*) AS starts, count(*) FILTER (position <= 1) AS wins, count(*) FILTER (position <= 5) AS top5, count(*) FILTER (position <= 10) AS top10, count(*) FILTER (position <= 25) AS top25, count(*) FILTER (status = 'finished') AS made, count(*) FILTER (status = 'cut') AS missed, 0 AS wd_dq, 0 AS unknown FROM entries GROUP BY 1"
ITEMS = "SELECT l_partkey AS item, l_suppkey AS entity_id, CAST(l_linenumber % 3 AS BIGINT) AS item_class, CAST(l_quantity AS BIGINT) AS strokes, CAST(l_quantity AS BIGINT) % 6 - 2 AS diff, year(l_shipdate) AS season FROM lineitem"


def items(spark, sf_dir):
    return view(spark, sf_dir, "lineitem").selectExpr("l_partkey AS item", "l_suppkey AS entity_id", "CAST(l_linenumber % 3 AS BIGINT) AS item_class", "CAST(l_quantity AS BIGINT) AS strokes", "CAST(l_quantity AS BIGINT) % 6 - 2 AS diff", "CAST(year(l_shipdate) AS BIGINT) AS season")


@query("a01_field_stats", oracle("SELECT event_id, period, count(*) AS n, sum(score) / count(*) AS mean, round(stddev_samp(score), 6) AS sd FROM scores GROUP BY 1, 2 HAVING count(*) >= 20"))
def a01(spark, sf_dir):
    return A.field_stats(view(spark, sf_dir, "scores"), ["event_id", "period"], "score").withColumn("sd", F.round("sd", 6))


@query("a02_field_relative", oracle("SELECT event_id, entity_id, period, CASE WHEN count(*) OVER w >= 20 THEN sum(score) OVER w / count(*) OVER w - score END AS delta FROM scores WINDOW w AS (PARTITION BY event_id, period)"))
def a02(spark, sf_dir):
    return A.field_relative(view(spark, sf_dir, "scores"), ["event_id", "period"], "score").drop("score")


@query("a03_entity_metrics", oracle("""WITH g AS (SELECT entity_id, count(*) AS n, sum(total) AS s, CASE WHEN count(*) > 1 THEN stddev_samp(total) END AS sd, count(*) FILTER (status = 'finished') AS made, count(*) FILTER (position <= 10) AS ten, count(*) FILTER (position <= 5) AS five FROM entries GROUP BY 1),
m AS (SELECT entity_id, n, 'scoring' AS metric, floor(s / n * 100.0 + 0.5) / 100 AS value FROM g UNION ALL SELECT entity_id, n, 'consistency', floor(sd * 100.0 + 0.5) / 100 FROM g UNION ALL SELECT entity_id, n, 'cuts', floor(made * 100.0 / n * 10 + 0.5) / 10 FROM g
UNION ALL SELECT entity_id, n, 'top10', floor(ten * 100.0 / n * 10 + 0.5) / 10 FROM g UNION ALL SELECT entity_id, n, 'contention', floor(five * 100.0 / n * 10 + 0.5) / 10 FROM g) SELECT entity_id, n AS sample, metric, value FROM m"""))
def a03(spark, sf_dir):
    return A.entity_metrics(view(spark, sf_dir, "entries"), "entity_id", "total", "position", "status")


@query("a04_metrics_by_window", oracle("""WITH e AS (SELECT *, unnest(CASE WHEN start_on >= DATE '1998-06-01' - 730 THEN ['all', 'recent'] ELSE ['all'] END) AS w FROM entries WHERE start_on <= DATE '1998-06-01') SELECT entity_id, w AS "window", count(*) AS sample, sum(total) / count(*) AS mean FROM e GROUP BY 1, 2"""))
def a04(spark, sf_dir):
    return A.metrics_by_window(view(spark, sf_dir, "entries"), "start_on", "entity_id", "total", "1998-06-01", {"recent": 730, "all": None})


@query("a05_finish_distribution", oracle(DIST))
def a05(spark, sf_dir):
    return A.finish_distribution(view(spark, sf_dir, "entries"), ["entity_id"], "position", "status")


@query("a06_season_rollup", oracle("SELECT entity_id, season, count(*) AS starts, count(*) FILTER (status = 'F') AS won, CAST(sum(points) AS BIGINT) AS total, max(points) AS best FROM results GROUP BY 1, 2"))
def a06(spark, sf_dir):
    return A.season_rollup(view(spark, sf_dir, "results"), "entity_id", "season", "points", "status", "F")


def venue_entries(spark, sf_dir):
    return view(spark, sf_dir, "entries").withColumn("venue_id", F.col("event_id") % 12)


@query("a07_venue_profile", oracle("""WITH e AS (SELECT event_id % 12 AS venue_id, event_id, sum(total) / count(*) AS mean, CASE WHEN count(*) > 1 THEN stddev_samp(total) END AS sd, min(total) FILTER (position = 1) AS win, count(*) FILTER (status = 'cut') / count(*) AS cut FROM entries GROUP BY 1, 2)
SELECT venue_id, count(*) AS events, round(avg(mean), 6) AS difficulty, round(avg(sd), 6) AS spread, round(avg(win), 6) AS winning, round(avg(cut), 6) AS cut_share FROM e GROUP BY 1"""))
def a07(spark, sf_dir):
    p = A.venue_profile(venue_entries(spark, sf_dir), "venue_id", "event_id", "total", "position", "status")
    return p.select("venue_id", "events", *(F.round(c, 6).alias(c) for c in ("difficulty", "spread", "winning", "cut_share")))


@query("a08_venue_dna", oracle("""WITH e AS (SELECT event_id % 12 AS venue_id, event_id, sum(total) / count(*) AS mean FROM entries GROUP BY 1, 2), p AS (SELECT venue_id, count(*) AS events, floor(avg(mean) * 1000 + 0.5) / 1000 AS difficulty FROM e GROUP BY 1),
r AS (SELECT *, rank() OVER (ORDER BY difficulty) - 1 AS worse, count(*) OVER (PARTITION BY difficulty) AS eq, count(*) OVER () AS n FROM p WHERE events >= 2)
SELECT venue_id, events, difficulty, n AS cohort_size, CASE WHEN n >= 10 THEN CAST(floor(100.0 * (worse + (eq - 1) / 2.0) / (n - 1) + 0.5) AS BIGINT) END AS percentile FROM r"""))
def a08(spark, sf_dir):
    p = A.venue_profile(venue_entries(spark, sf_dir), "venue_id", "event_id", "total", "position", "status").where("events >= 2")
    p = p.select("venue_id", "events", (F.floor(F.col("difficulty") * 1000 + 0.5) / 1000).alias("difficulty"), F.lit("all").alias("cohort"))
    return W.midrank_percentile(p, ["cohort"], "difficulty").drop("cohort")


HIST = "SELECT entity_id, event_id % 12 AS venue_id, count(*) AS starts, count(*) FILTER (status = 'finished') AS cuts, count(*) FILTER (position = 1) AS wins, count(*) FILTER (position <= 10) AS top10, min(position) AS best, sum(position) FILTER (status = 'finished') / nullif(count(*) FILTER (status = 'finished'), 0) AS mean_finish FROM entries WHERE event_id < 199706 GROUP BY 1, 2"


@query("a09_venue_history", oracle(HIST))
def a09(spark, sf_dir):
    return A.venue_history(venue_entries(spark, sf_dir), "entity_id", "venue_id", "event_id", "position", "status", F.col("event_id") < 199706)


@query("a10_venue_fit", oracle(f"""WITH h AS ({HIST}), e AS (SELECT event_id % 12 AS venue_id, event_id, sum(total) / count(*) AS mean FROM entries GROUP BY 1, 2), p AS (SELECT venue_id, avg(mean) AS difficulty FROM e GROUP BY 1)
SELECT entity_id, count(*) FILTER (difficulty >= 28) AS hard_venues, count(*) FILTER (difficulty < 28) AS easy_venues, round(avg(mean_finish) FILTER (difficulty >= 28), 6) AS hard_finish, round(avg(mean_finish) FILTER (difficulty < 28), 6) AS easy_finish, CAST(NULL AS DOUBLE) AS composite FROM h JOIN p USING (venue_id) GROUP BY 1"""))
def a10(spark, sf_dir):
    entries = venue_entries(spark, sf_dir)
    history = A.venue_history(entries, "entity_id", "venue_id", "event_id", "position", "status", F.col("event_id") < 199706)
    fit = A.venue_fit(history, A.venue_profile(entries, "venue_id", "event_id", "total", "position", "status"), "entity_id", "venue_id", 28)
    return fit.withColumns({c: F.round(c, 6) for c in ("hard_finish", "easy_finish")})


@query("a11_period_profile", oracle("SELECT entity_id, period, count(*) AS sample, sum(score) / count(*) AS mean, min(score) AS best FROM scores GROUP BY 1, 2"))
def a11(spark, sf_dir):
    return A.profile(view(spark, sf_dir, "scores"), ["entity_id", "period"], "score")


@query("a12_series_profile", oracle("""WITH x AS (SELECT entity_id, count(*) AS appearances, count(*) FILTER (position = 1) AS wins, min(position) AS best, array_agg(position ORDER BY event_id DESC) AS a FROM entries GROUP BY 1) SELECT entity_id, appearances, wins, best, array_to_string(a[1:5], ',') AS latest FROM x"""))
def a12(spark, sf_dir):
    return A.series_profile(view(spark, sf_dir, "entries"), ["entity_id"], "event_id", "position")


@query("a13_item_class_scoring", oracle(f"""WITH i AS ({ITEMS}), d AS (SELECT *, CASE WHEN count(*) OVER w >= 20 THEN sum(strokes) OVER w / count(*) OVER w - strokes END AS delta FROM i WINDOW w AS (PARTITION BY item)) SELECT entity_id, item_class, count(*) AS sample, round(avg(delta), 6) AS mean_delta FROM d WHERE delta IS NOT NULL GROUP BY 1, 2"""))
def a13(spark, sf_dir):
    return A.item_class_scoring(items(spark, sf_dir), ["item"], "entity_id", "item_class", "strokes").withColumn("mean_delta", F.round("mean_delta", 6))


@query("a14_item_difficulty", oracle(f"SELECT item, count(*) AS n, sum(strokes) / count(*) AS difficulty FROM ({ITEMS}) GROUP BY 1 HAVING count(*) >= 30"))
def a14(spark, sf_dir):
    return A.item_difficulty(items(spark, sf_dir), ["item"], "strokes")


@query("a15_item_stats", oracle(f"""WITH s AS (SELECT entity_id, count(*) AS n, count(diff) AS known, count(*) FILTER (diff <= -2) AS eagle, count(*) FILTER (diff = -1) AS under, count(*) FILTER (diff = 0) AS level, count(*) FILTER (diff = 1) AS over, count(*) FILTER (diff >= 2) AS double, sum(diff) AS s FROM ({ITEMS}) GROUP BY 1 HAVING count(*) >= 10)
SELECT entity_id, n, known, eagle, under, level, over, double, floor(eagle * 100.0 / n * 10 + 0.5) / 10 AS eagle_pct, floor(under * 100.0 / n * 10 + 0.5) / 10 AS under_pct, floor(level * 100.0 / n * 10 + 0.5) / 10 AS level_pct, floor(over * 100.0 / n * 10 + 0.5) / 10 AS over_pct, floor(double * 100.0 / n * 10 + 0.5) / 10 AS double_pct, CASE WHEN known = n THEN s / n END AS mean FROM s"""))
def a15(spark, sf_dir):
    return A.item_stats(items(spark, sf_dir), ["entity_id"], "diff")


@query("a16_scoring_cohort", oracle("SELECT event_id, count(DISTINCT entity_id) AS entities, CASE WHEN count(DISTINCT entity_id) <= 20 THEN 'contender sample' ELSE 'observed field' END AS cohort FROM scores GROUP BY 1"))
def a16(spark, sf_dir):
    return A.scoring_cohort(view(spark, sf_dir, "scores"), ["event_id"], "entity_id")


@query("a17_coverage_report", oracle("WITH o AS (SELECT count(*) AS n, count(cents) AS cents, count(c_mktsegment) AS seg FROM src_b) SELECT n, 'cents' AS field, cents AS known, cents / n AS share FROM o UNION ALL SELECT n, 'c_mktsegment', seg, seg / n FROM o"))
def a17(spark, sf_dir):
    return A.coverage_report(view(spark, sf_dir, "src_b"), ["cents", "c_mktsegment"])


GRADED = "SELECT family, season AS tour, CASE WHEN entity_id = 7 THEN 'VOID' WHEN hit = 1 THEN 'WIN' ELSE 'LOSS' END AS grade, mille / 1000.0 AS p FROM probs"


def graded(spark, sf_dir):
    return view(spark, sf_dir, "probs").selectExpr("family", "season AS tour", "CASE WHEN entity_id = 7 THEN 'VOID' WHEN hit = 1 THEN 'WIN' ELSE 'LOSS' END AS grade", "mille / 1000D AS p", "mille")


@query("a18_track_record", oracle(f"""WITH g AS ({GRADED}) SELECT family, tour, count(*) AS selections, count(*) FILTER (grade = 'WIN') AS won, count(*) FILTER (grade = 'LOSS') AS lost, count(*) FILTER (grade = 'VOID') AS void,
floor(count(*) FILTER (grade = 'WIN') / nullif(count(*) FILTER (grade IN ('WIN', 'LOSS')), 0) * 1000 + 0.5) / 1000 AS hit_rate, floor(sum(p) FILTER (grade <> 'VOID') * 10 + 0.5) / 10 AS expected, floor(avg(CAST(power(CASE WHEN grade = 'WIN' THEN 1 ELSE 0 END - p, 2) AS DOUBLE)) FILTER (grade <> 'VOID') * 10000 + 0.5) / 10000 AS brier FROM g GROUP BY GROUPING SETS ((family), (tour, family))"""))
def a18(spark, sf_dir):
    return A.track_record(graded(spark, sf_dir), "family", "tour", "grade", "p")


P = "SELECT event_id, entity_id, family, season, CAST(mille AS DOUBLE) / 1000 AS p, hit AS y FROM probs"


def probs(spark, sf_dir):
    return view(spark, sf_dir, "probs").selectExpr("event_id", "entity_id", "family", "season", "mille / 1000D AS p", "hit AS y")


@query("a19_calibration", oracle(f"""WITH q AS (SELECT *, least(floor(p * 10), 9) AS b FROM ({P})), e AS (SELECT b, count(*) AS n, sum(-(y * ln(greatest(1e-4, least(1 - 1e-4, p))) + (1 - y) * ln(1 - greatest(1e-4, least(1 - 1e-4, p))))) AS loss, sum((p - y) * (p - y)) AS brier, sum(y) AS hits, sum(p) AS ps FROM q GROUP BY 1)
SELECT CAST(sum(n) AS BIGINT) AS n, round(sum(loss) / sum(n), 9) AS log_loss, round(sum(brier) / sum(n), 9) AS brier, round(sum(abs(hits - ps)) / sum(n), 9) AS ece, round(sum(hits) / sum(n), 9) AS base_rate, round(sum(ps) / sum(n), 9) AS mean_p FROM e"""))
def a19(spark, sf_dir):
    return A.calibration(probs(spark, sf_dir), "p", "y").withColumns({c: F.round(c, 9) for c in ("log_loss", "brier", "ece", "base_rate", "mean_p")})


@query("a19_reliability", oracle(f"SELECT CAST(least(floor(p * 10), 9) AS BIGINT) AS bin, count(*) AS n, round(avg(p), 9) AS mean_p, round(avg(y), 9) AS rate FROM ({P}) GROUP BY 1"))
def a19b(spark, sf_dir):
    return A.reliability(probs(spark, sf_dir), "p", "y").withColumns({c: F.round(c, 9) for c in ("mean_p", "rate")})


@query("a20_stratified", oracle(f"SELECT family, season, count(*) AS n, round(avg((p - y) * (p - y)), 9) AS brier, round(avg(y), 9) AS base_rate FROM ({P}) GROUP BY GROUPING SETS ((), (family), (season))"))
def a20(spark, sf_dir):
    return A.stratified(probs(spark, sf_dir), ["family", "season"], "p", "y").withColumns({c: F.round(c, 9) for c in ("brier", "base_rate")})


@query("a21_ranking_metrics", oracle(f"""WITH r AS (SELECT *, row_number() OVER (PARTITION BY season ORDER BY p DESC, event_id * 10 + entity_id) AS k, rank() OVER (PARTITION BY season ORDER BY p DESC) AS r, count(*) OVER (PARTITION BY season, p) AS e FROM ({P}))
SELECT season, count(*) FILTER (k <= 10 AND y = 1) / least(count(*), 10) AS precision_at_k, min(r + (e - 1) / 2.0) FILTER (y = 1) AS winner_rank FROM r GROUP BY 1"""))
def a21(spark, sf_dir):
    return A.ranking_metrics(probs(spark, sf_dir).withColumn("id", F.col("event_id") * 10 + F.col("entity_id")), "season", "id", "p", "y")


@query("a22_demeaned_corr", oracle("WITH d AS (SELECT score - sum(score) OVER w / count(*) OVER w AS d, entity_id FROM scores WINDOW w AS (PARTITION BY event_id)) SELECT count(*) AS n, round(corr(d, entity_id), 9) AS r FROM d"))
def a22(spark, sf_dir):
    return A.demeaned_corr(view(spark, sf_dir, "scores"), ["event_id"], "score", "entity_id").withColumn("r", F.round("r", 9))


@query("a23_binned_effect", oracle("""WITH g AS (SELECT CAST((entity_id >= 20)::INT + (entity_id >= 50)::INT + (entity_id >= 98)::INT AS BIGINT) AS bin, score FROM scores) SELECT bin, count(*) AS n, CASE WHEN count(*) >= 30 THEN sum(score) / count(*) END AS mean, round(CASE WHEN count(*) >= 30 THEN stddev_samp(score) END, 6) AS sd, round(CASE WHEN count(*) >= 30 THEN 1.96 * stddev_samp(score) / sqrt(count(*)) END, 6) AS half_width FROM g GROUP BY 1"""))
def a23(spark, sf_dir):
    return A.binned_effect(view(spark, sf_dir, "scores"), "entity_id", "score", [20, 50, 98]).withColumns({c: F.round(c, 6) for c in ("sd", "half_width")})


@query("a24_cut_applied", oracle("SELECT event_id, count(*) AS field, count(*) FILTER (status = 'cut') AS missed FROM entries GROUP BY 1 HAVING count(*) FILTER (status = 'cut') >= 5 AND count(*) FILTER (status = 'cut') >= count(*) * 0.1"))
def a24(spark, sf_dir):
    return A.cut_applied(view(spark, sf_dir, "entries"), "event_id", "status")


@query("a25_cut_line", oracle("WITH t AS (SELECT event_id, entity_id, sum(score) AS t FROM scores WHERE period <= 2 GROUP BY 1, 2 HAVING count(*) = 2) SELECT event_id, CAST(max(t) AS BIGINT) AS line FROM t JOIN entries USING (event_id, entity_id) WHERE status = 'finished' GROUP BY 1"))
def a25(spark, sf_dir):
    return A.cut_line(view(spark, sf_dir, "entries"), view(spark, sf_dir, "scores"), "event_id", "entity_id", "period", "score", "status")


@query("a26_periods_complete", oracle("""WITH e AS (SELECT event_id, entity_id, status = 'cut' AS cut FROM entries), z AS (SELECT event_id, count(*) AS n, count(*) FILTER (NOT cut) AS m FROM e GROUP BY 1), k AS (SELECT event_id, n, m, unnest(range(1, 6)) AS k FROM z WHERE n >= 20),
h AS (SELECT s.event_id, period AS k, count(DISTINCT s.entity_id) AS h FROM scores s JOIN e USING (event_id, entity_id) WHERE period <= 2 OR NOT cut GROUP BY 1, 2),
b AS (SELECT k.event_id, k.k, coalesce(h, 0) >= (CASE WHEN k.k <= 2 THEN n ELSE greatest(m, 1) END) * 0.3 AS ok FROM k LEFT JOIN h ON k.event_id = h.event_id AND k.k = h.k) SELECT event_id, coalesce(min(k) FILTER (NOT ok), 6) - 1 AS complete FROM b GROUP BY 1"""))
def a26(spark, sf_dir):
    return A.periods_complete(view(spark, sf_dir, "scores"), view(spark, sf_dir, "entries"), "event_id", "entity_id", "period", "status", share=0.3)


@query("a27_period_stats", oracle("""WITH l AS (SELECT *, min(score) OVER (PARTITION BY event_id, period) AS lo FROM scores) SELECT event_id, period, count(*) AS n, sum(score) / count(*) AS mean, min(score) AS low, count(*) FILTER (score = lo) AS holders, min(entity_id) FILTER (score = lo) AS first_holder, count(*) FILTER (score < 10) AS under FROM l GROUP BY 1, 2"""))
def a27(spark, sf_dir):
    return A.period_stats(view(spark, sf_dir, "scores"), ["event_id", "period"], "entity_id", "score", 10)


@query("a28_day_summary", oracle("""WITH h AS (SELECT CAST(ts AS DATE) AS day, CASE WHEN hour(ts) < 12 THEN 'morning' ELSE 'afternoon' END AS part, event_type, CAST(floor(value * 100) AS BIGINT) AS v FROM events WHERE hour(ts) BETWEEN 7 AND 19),
m AS (SELECT day, part, event_type, row_number() OVER (PARTITION BY day, part ORDER BY count(*) DESC, event_type) AS k FROM h GROUP BY 1, 2, 3)
SELECT day, part, count(*) AS n, max(v) AS hi, min(v) AS lo, CAST(sum(v) AS BIGINT) AS total, any_value(m.event_type) AS mode FROM h JOIN (SELECT day, part, event_type FROM m WHERE k = 1) m USING (day, part) GROUP BY 1, 2"""))
def a28(spark, sf_dir):
    e = view(spark, sf_dir, "events").select("ts", "event_type", F.floor(F.col("value") * 100).cast("long").alias("v"))
    return A.day_summary(e, "ts", "v", "event_type")


@query("a29_board_snapshot", oracle("""WITH b AS (SELECT *, total - min(total) OVER (PARTITION BY event_id) AS b FROM entries) SELECT event_id, min(total) AS low, count(*) FILTER (b = 0) AS leaders, count(*) FILTER (b <= 1) AS within_1, count(*) FILTER (b <= 2) AS within_2, count(*) FILTER (b <= 3) AS within_3,
count(*) FILTER (periods >= 2) AS finished, count(*) FILTER (periods > 0 AND periods < 2) AS under_way, 0 AS not_started FROM b GROUP BY 1"""))
def a29(spark, sf_dir):
    return A.board_snapshot(view(spark, sf_dir, "entries"), ["event_id"], "total", "periods", 2)


RATING = """SELECT entity_id, sum(exp(-d / 730.0)) AS w, sum(exp(-d / 730.0) * total) AS s, sum(exp(-d / 730.0) * total * total) AS q FROM (SELECT entity_id, total, date_diff('day', start_on, DATE '1998-01-01') AS d FROM entries) WHERE d > 0 GROUP BY 1"""


@query("a30_decayed_rating", oracle(f"""WITH g AS ({RATING}), v AS (SELECT *, (w * CASE WHEN w > 1 THEN greatest(0, q / w - power(s / w, 2)) ELSE 2.9 * 2.9 END + 40 * 2.9 * 2.9) / (w + 40) AS v FROM g)
SELECT entity_id, round(w, 6) AS weight, round((s + 1.5) / (w + 3), 6) AS mu, round(sqrt(v), 6) AS sd, round(sqrt(v / (w + 3)), 6) AS se FROM v"""))
def a30(spark, sf_dir):
    r = A.decayed_rating(view(spark, sf_dir, "entries"), "entity_id", "start_on", "total", "1998-01-01")
    return r.select("entity_id", *(F.round(c, 6).alias(c) for c in ("weight", "mu", "sd", "se")))


@query("a31_strength_adjusted", oracle(f"""WITH g AS ({RATING}), m AS (SELECT entity_id, (s + 1.5) / (w + 3) AS mu FROM g), e AS (SELECT event_id, entries.entity_id, total, coalesce(mu, 0.5) AS mu FROM entries LEFT JOIN m USING (entity_id) WHERE start_on >= DATE '1998-01-01')
SELECT event_id, entity_id, round(CASE WHEN count(*) OVER w >= 10 THEN total - sum(total) OVER w / count(*) OVER w + sum(mu) OVER w / count(*) OVER w END, 6) AS residual FROM e WINDOW w AS (PARTITION BY event_id)"""))
def a31(spark, sf_dir):
    entries = view(spark, sf_dir, "entries")
    rated = A.decayed_rating(entries, "entity_id", "start_on", "total", "1998-01-01")
    r = A.strength_adjusted(entries.where("start_on >= date'1998-01-01'"), rated, ["event_id"], "entity_id", "total")
    return r.select("event_id", "entity_id", F.round("residual", 6).alias("residual"))


#: The replay of ratings over years: x has each row with what was known before its year, s the state of each entity then.
REPLAY = """e AS (SELECT event_id, entity_id, CAST(total AS DOUBLE) AS v, CAST(event_id // 100 AS INT) AS y FROM entries), s(setting, tau, k, mu0, kv, y, entity_id, w, s, q, t) AS (
SELECT setting, tau, k, mu0, kv, (SELECT min(y) FROM e), entity_id, 0.0::DOUBLE, 0.0::DOUBLE, 0.0::DOUBLE, NULL::DATE FROM g, (SELECT DISTINCT entity_id FROM e) UNION ALL
SELECT setting, any_value(tau), any_value(k), any_value(mu0), any_value(kv), y + 1, entity_id, CASE WHEN count(res) > 0 THEN any_value(w * f) + count(res) ELSE any_value(w) END, CASE WHEN count(res) > 0 THEN any_value(s * f) + sum(res) ELSE any_value(s) END, CASE WHEN count(res) > 0 THEN any_value(q * f) + sum(res * res) ELSE any_value(q) END, CASE WHEN count(res) > 0 THEN make_date(any_value(y), 1, 1) ELSE any_value(t) END
FROM (SELECT *, CASE WHEN event_id IS NOT NULL AND count(v) OVER p >= 5 THEN v - avg(v) OVER p + avg((s * f + k * mu0) / (w * f + k)) OVER p END AS res FROM (SELECT s.*, event_id, v, coalesce(exp(-date_diff('day', t, make_date(s.y, 1, 1)) / tau), 1) AS f FROM s LEFT JOIN e ON e.y = s.y AND e.entity_id = s.entity_id WHERE s.y <= (SELECT max(y) FROM e)) WINDOW p AS (PARTITION BY setting, event_id)) GROUP BY setting, y, entity_id),
z AS (SELECT s.setting, s.y, s.k, s.mu0, s.kv, s.entity_id, event_id, v, w * f AS w, s * f AS s, q * f AS q FROM (SELECT *, coalesce(exp(-date_diff('day', t, make_date(y, 1, 1)) / tau), 1) AS f FROM s) s JOIN e ON e.y = s.y AND e.entity_id = s.entity_id),
zz AS (SELECT *, (s + k * mu0) / (w + k) AS mu, (w * CASE WHEN w > 1 THEN greatest(0, q / w - power(s / w, 2)) ELSE 2.9 * 2.9 END + kv * 2.9 * 2.9) / (w + kv) AS var FROM z),
x AS (SELECT *, sqrt(var) AS sd, sqrt(var / (w + k)) AS se, CASE WHEN count(v) OVER (PARTITION BY setting, event_id) >= 5 THEN v - avg(v) OVER (PARTITION BY setting, event_id) + avg(mu) OVER (PARTITION BY setting, event_id) END AS residual FROM zz)"""


def by_year(spark, sf_dir):
    """Entries with the first day of their year, and these days."""
    e = view(spark, sf_dir, "entries").select("event_id", "entity_id", "total", F.trunc("start_on", "year").alias("on"))
    return e, sorted(r[0] for r in e.select("on").distinct().collect())


@query("a31_rating_replay", oracle(f"WITH RECURSIVE g AS (SELECT 0 AS setting, 730.0::DOUBLE AS tau, 3.0::DOUBLE AS k, 0.5::DOUBLE AS mu0, 40.0::DOUBLE AS kv), {REPLAY} SELECT event_id, entity_id, round(mu, 6) AS mu, round(sd, 6) AS sd, round(se, 6) AS se, round(residual, 6) AS residual FROM x"))
def a31_replay(spark, sf_dir):
    e, days = by_year(spark, sf_dir)
    found = A.rating_replay(e, "on", ["event_id"], "entity_id", "total", days, least=5)
    return found.select("event_id", "entity_id", *(F.round(c, 6).alias(c) for c in ("mu", "sd", "se", "residual")))


@query("a32_gaussian_nll", oracle(f"""WITH g AS ({RATING}), v AS (SELECT entity_id, (s + 1.5) / (w + 3) AS mu, (w * CASE WHEN w > 1 THEN greatest(0, q / w - power(s / w, 2)) ELSE 2.9 * 2.9 END + 40 * 2.9 * 2.9) / (w + 40) AS v, w FROM g)
SELECT count(*) AS n, round(avg(0.5 * (ln(6.283185307179586 * (v + v / (w + 3))) + power(total - mu, 2) / (v + v / (w + 3)))), 6) AS nll FROM entries JOIN v USING (entity_id) WHERE start_on >= DATE '1998-01-01'"""))
def a32(spark, sf_dir):
    entries = view(spark, sf_dir, "entries")
    rated = A.decayed_rating(entries, "entity_id", "start_on", "total", "1998-01-01")
    return A.gaussian_nll(entries.where("start_on >= date'1998-01-01'").join(rated, "entity_id"), "total", "mu", "sd", "se").withColumn("nll", F.round("nll", 6))


@query("a33_smoothed_rates", oracle("WITH b AS (SELECT sum(hit) / count(*) AS base FROM probs) SELECT family, count(*) AS n, CAST(sum(hit) AS BIGINT) AS hits, any_value(base) AS base, (sum(hit) + 5 * any_value(base)) / (count(*) + 5) AS rate FROM probs, b GROUP BY 1"))
def a33(spark, sf_dir):
    return A.smoothed_rates(view(spark, sf_dir, "probs"), "family", "hit")


@query("a34_readiness", oracle("""WITH s AS (SELECT entity, count(*) AS n, max(tick) AS last, CAST(sum(moved) AS BIGINT) AS total FROM ticks GROUP BY 1), f AS (SELECT entity, list_filter([CASE WHEN NOT n >= 30 THEN 'rows' END, CASE WHEN NOT total > 100000 THEN 'total' END, CASE WHEN NOT last >= TIMESTAMP '2024-01-15' THEN 'fresh' END], lambda x: x IS NOT NULL) AS f FROM s)
SELECT entity, array_to_string(f, ',') AS failing, len(f) = 0 AS ready, f[1] AS reason, CASE WHEN f[1] IS NULL THEN NULL WHEN f[1] = 'fresh' THEN 'technical' WHEN f[1] = 'rows' THEN 'source hold' ELSE 'policy' END AS class FROM f"""))
def a34(spark, sf_dir):
    s = view(spark, sf_dir, "ticks").groupBy("entity").agg(F.count("*").alias("n"), F.max("tick").alias("last"), F.sum("moved").alias("total"))
    r = A.readiness(s, {"rows": F.col("n") >= 30, "total": F.col("total") > 100000, "fresh": F.col("last") >= F.lit("2024-01-15").cast("timestamp")})
    return r.select("entity", F.array_join("failing", ",").alias("failing"), "ready", "reason", A.readiness_reason("reason", {"technical": ["fresh"], "source hold": ["rows"]}).alias("class"))


@query("a36_repeat_winners", oracle("SELECT entity_id, count(*) AS wins, max(event_id) AS latest FROM entries WHERE position = 1 GROUP BY 1 HAVING count(*) >= 2"))
def a36(spark, sf_dir):
    return A.repeat_winners(view(spark, sf_dir, "entries"), "entity_id", "event_id", "position")


@query("a37_composite_percentile", oracle("""WITH r AS (SELECT *, rank() OVER (PARTITION BY season, code ORDER BY value) - 1 AS worse, count(*) OVER (PARTITION BY season, code, value) AS eq, count(*) OVER (PARTITION BY season, code) AS n FROM stats),
p AS (SELECT entity_id, season, CASE WHEN n >= 10 THEN CAST(floor(100.0 * (worse + (eq - 1) / 2.0) / (n - 1) + 0.5) AS BIGINT) END AS p FROM r WHERE code IN ('1-URGENT', '2-HIGH'))
SELECT entity_id, season, CASE WHEN count(p) = 2 THEN avg(p) END AS composite, CASE WHEN count(p) <> 2 THEN 'not_published_for_player' END AS reason FROM p GROUP BY 1, 2"""))
def a37(spark, sf_dir):
    ranked = W.midrank_percentile(view(spark, sf_dir, "stats"), ["season", "code"], "value")
    return A.composite_percentile(ranked, ["entity_id", "season"], "percentile", "code", ["1-URGENT", "2-HIGH"])


@query("a38_distinct_dims", oracle("SELECT entity_id, count(DISTINCT event_id % 12) AS \"distinct\", count(*) AS starts FROM entries GROUP BY 1"))
def a38(spark, sf_dir):
    return A.distinct_dims(venue_entries(spark, sf_dir), "entity_id", "venue_id")


@query("a39_segment_totals", oracle("SELECT l_orderkey, CAST(CASE WHEN count(*) FILTER (l_linenumber <= 2) = 2 THEN sum(CAST(l_quantity AS BIGINT)) FILTER (l_linenumber <= 2) END AS BIGINT) AS front, CAST(CASE WHEN count(*) FILTER (l_linenumber BETWEEN 3 AND 5) = 3 THEN sum(CAST(l_quantity AS BIGINT)) FILTER (l_linenumber BETWEEN 3 AND 5) END AS BIGINT) AS back FROM lineitem GROUP BY 1"))
def a39(spark, sf_dir):
    li = view(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.col("l_quantity").cast("long").alias("q"))
    return A.segment_totals(li, ["l_orderkey"], "l_linenumber", "q", {"front": (1, 2), "back": (3, 5)})


@query("a40_daily_counters", oracle("SELECT date_trunc('day', ts) AS day, event_type, count(*) AS n, CAST(sum(CAST(floor(value * 100) AS BIGINT)) AS BIGINT) AS total FROM events GROUP BY 1, 2"))
def a40(spark, sf_dir):
    e = view(spark, sf_dir, "events").withColumn("v", F.floor(F.col("value") * 100).cast("long"))
    return A.daily_counters(e, "ts", ["event_type"], "v")


@query("a41_source_health", oracle("SELECT event_type, max(ts) AS last, count(*) FILTER (value < 5) AS held, count(*) AS rows, CAST(floor(date_diff('second', max(ts), TIMESTAMP '2025-01-01') / 3600) AS BIGINT) AS age_hours FROM events GROUP BY 1"))
def a41(spark, sf_dir):
    return A.source_health(view(spark, sf_dir, "events"), "event_type", "ts", F.col("value") < 5, "2025-01-01").withColumn("age_hours", F.floor("age_hours").cast("long"))


@query("a42_exclusive_buckets", oracle(f"""WITH d AS ({DIST}), g AS (SELECT *, least(wins, top5 - wins, top10 - top5, top25 - top10, made - top25, missed) >= 0 AND made + missed = starts AS good FROM d)
SELECT entity_id, CASE WHEN good THEN wins END AS b_win, CASE WHEN good THEN top5 - wins END AS b_2_5, CASE WHEN good THEN made - top25 END AS b_26, CASE WHEN good THEN missed END AS b_missed FROM g"""))
def a42(spark, sf_dir):
    return A.exclusive_buckets(A.finish_distribution(view(spark, sf_dir, "entries"), ["entity_id"], "position", "status")).select("entity_id", "b_win", "b_2_5", "b_26", "b_missed")


@query("a43_pair_verdict", oracle("""WITH e AS (SELECT entity_id, season, code AS metric, value - 1 - entity_id % 2 AS delta FROM stats), t AS (SELECT entity_id, season, count(*) AS comparable, max((abs(delta), metric, sign(delta))) AS top, max((abs(delta), metric)) FILTER (delta > 0) AS pos, max((abs(delta), metric)) FILTER (delta < 0) AS neg FROM e GROUP BY 1, 2)
SELECT entity_id, season, comparable, CASE WHEN comparable >= 3 THEN top[2] END AS edge, CASE WHEN comparable >= 3 THEN CASE WHEN top[3] > 0 THEN neg[2] ELSE pos[2] END END AS counter FROM t"""))
def a43(spark, sf_dir):
    e = view(spark, sf_dir, "stats").select("entity_id", "season", F.col("code").alias("metric"), (F.col("value") - 1 - F.col("entity_id") % 2).cast("double").alias("delta"))
    return A.pair_verdict(e, ["entity_id", "season"], "metric", "delta")


@query("a44_source_coverage", oracle("SELECT n_nationkey AS nation, (SELECT count(*) FROM customer WHERE c_nationkey = n_nationkey) AS customers, (SELECT count(*) FROM supplier WHERE s_nationkey = n_nationkey) AS suppliers FROM nation"))
def a44(spark, sf_dir):
    n = view(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("nation"))
    return A.source_coverage(n, "nation", {"customers": view(spark, sf_dir, "customer").withColumnRenamed("c_nationkey", "nation"), "suppliers": view(spark, sf_dir, "supplier").withColumnRenamed("s_nationkey", "nation")})
