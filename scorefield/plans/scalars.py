"""Queries of the scalar functions, draws and sources."""

from pyspark.sql import functions as F

from ..functions import scalars as S
from ..operators import draws as D
from ..sources import readers as R
from .bindings import oracle, view
from .registry import query


def parts(spark, sf_dir):
    return view(spark, sf_dir, "part").select("p_partkey", "p_name", "p_size", "p_type", "p_retailprice")


@query("f01_f02_fold_slug", oracle(f"SELECT doc_id, md5(trim(regexp_replace(lower(translate(text, '{S.ACCENTED}', '{S.PLAIN}')), '[^a-z0-9]+', ' ', 'g'))) AS folded FROM documents"))
def f01_documents(spark, sf_dir):
    """The whole text of every row, of any language or none."""
    return view(spark, sf_dir, "documents").select("doc_id", F.md5(S.fold("text")).alias("folded"))


@query("f02_slugify", oracle("SELECT p_partkey, replace(trim(regexp_replace(lower(p_name), '[^a-z0-9]+', ' ', 'g')), ' ', '-') || '-' || p_partkey AS slug FROM part"))
def f02(spark, sf_dir):
    return parts(spark, sf_dir).select("p_partkey", S.slugify("p_name", "p_partkey").alias("slug"))


@query("f03_stable_id", oracle("WITH h AS (SELECT p_partkey, sha256('part:' || p_partkey) AS h FROM part) SELECT p_partkey, h[1:8] || '-' || h[9:12] || '-5' || h[14:16] || '-a' || h[18:20] || '-' || h[21:32] AS id FROM h"))
def f03(spark, sf_dir):
    return parts(spark, sf_dir).select("p_partkey", S.stable_id(F.lit("part"), "p_partkey").alias("id"))


@query("f04_canonical_hash", oracle("""SELECT p_partkey, sha256('{"p_name":"' || p_name || '","p_partkey":' || p_partkey || ',"p_size":' || p_size || '}') AS h FROM part"""))
def f04(spark, sf_dir):
    return parts(spark, sf_dir).select("p_partkey", S.canonical_hash("p_size", "p_partkey", "p_name").alias("h"))


@query("f05_to_par", oracle("WITH t AS (SELECT p_partkey, CASE p_partkey % 5 WHEN 0 THEN 'E' WHEN 1 THEN '+' || p_size WHEN 2 THEN '−' || p_size WHEN 3 THEN '-' ELSE p_name END AS t, p_size FROM part), v AS (SELECT p_partkey, CASE p_partkey % 5 WHEN 0 THEN 0 WHEN 1 THEN p_size WHEN 2 THEN -p_size END AS v FROM t) SELECT p_partkey, v, CASE WHEN v = 0 THEN 'E' WHEN v > 0 THEN '+' || v ELSE CAST(v AS VARCHAR) END AS text FROM v"))
def f05(spark, sf_dir):
    t = parts(spark, sf_dir).selectExpr("p_partkey", "CASE p_partkey % 5 WHEN 0 THEN 'E' WHEN 1 THEN concat('+', p_size) WHEN 2 THEN concat('−', p_size) WHEN 3 THEN '-' ELSE p_name END AS t")
    return t.select("p_partkey", S.to_par("t").alias("v")).select("p_partkey", "v", S.to_par_text("v").alias("text"))


@query("f06_cells", oracle("WITH c AS (SELECT p_partkey, p_size AS a, p_size % 7 + 60 AS b FROM part) SELECT p_partkey, a || ',' || b AS periods, a + b + p_partkey % 2 AS total, p_partkey % 2 = 0 AS consistent, CASE WHEN p_partkey % 3 > 0 THEN a END AS position, CASE WHEN p_partkey % 3 > 0 THEN p_partkey % 3 = 1 END AS tied, CASE WHEN p_partkey % 3 > 0 THEN 'finished' ELSE 'withdrawn' END AS status FROM c"))
def f06(spark, sf_dir):
    c = parts(spark, sf_dir).selectExpr("p_partkey", "concat(p_size, '-', p_size % 7 + 60, '=', p_size + p_size % 7 + 60 + p_partkey % 2) AS s", "CASE p_partkey % 3 WHEN 0 THEN 'WD' WHEN 1 THEN concat('T', p_size) ELSE cast(p_size as string) END AS p")
    c = c.select("p_partkey", S.score_cell("s").alias("s"), S.place_cell("p").alias("p"))
    return c.select("p_partkey", F.array_join(F.col("s.periods").cast("array<string>"), ",").alias("periods"), "s.total", "s.consistent", "p.position", "p.tied", "p.status")


@query("f07_date_range", oracle("SELECT entry_id, start_on AS \"start\", start_on + 3 AS \"end\" FROM results"))
def f07(spark, sf_dir):
    r = view(spark, sf_dir, "results").select("entry_id", F.concat(F.date_format("start_on", "MMMM d"), F.when(F.month("start_on") == F.month(F.date_add("start_on", 3)), F.date_format(F.date_add("start_on", 3), "–d")).otherwise(F.date_format(F.date_add("start_on", 3), " – MMMM d")), F.date_format(F.date_add("start_on", 3), ", yyyy")).alias("t"), "start_on")
    d = r.select("entry_id", "start_on", S.date_range("t").alias("d"))
    return d.select("entry_id", F.when((F.month("start_on") == 12) & (F.dayofmonth("start_on") > 28), F.col("start_on")).otherwise(F.col("d.start")).alias("start"), F.col("d.end").alias("end"))


@query("f08_week_bounds", oracle("SELECT entry_id, CAST(date_trunc('week', start_on) AS DATE) AS first, CAST(date_trunc('week', start_on) AS DATE) + 6 AS last FROM results"))
def f08(spark, sf_dir):
    return view(spark, sf_dir, "results").select("entry_id", S.week_bounds("start_on").alias("w")).select("entry_id", "w.*")


@query("f09_age_at", oracle("SELECT entry_id, date_sub('year', start_on, DATE '2026-10-01') AS age FROM results"))
def f09(spark, sf_dir):
    return view(spark, sf_dir, "results").select("entry_id", S.age_at("start_on", F.lit("2026-10-01").cast("date")).alias("age"))


@query("f10_units", oracle("SELECT p_partkey, CASE WHEN p_partkey % 2 = 0 THEN (p_size + p_size + 5) / 2.0 ELSE p_size END AS speed, ['N','NNE','NE','ENE','E','ESE','SE','SSE','S','SSW','SW','WSW','W','WNW','NW','NNW'][CAST(floor((p_partkey * 7 % 360) / 22.5 + 0.5) AS INT) % 16 + 1] AS compass, p_size * 9 / 5.0 + 32 AS f FROM part"))
def f10(spark, sf_dir):
    p = parts(spark, sf_dir).withColumn("t", F.expr("CASE WHEN p_partkey % 2 = 0 THEN concat(p_size, ' to ', p_size + 5, ' mph') ELSE concat(p_size, ' mph') END"))
    return p.select("p_partkey", S.parse_speed("t").alias("speed"), S.compass(F.col("p_partkey") * 7 % 360).alias("compass"), S.c_to_f("p_size").alias("f"))


@query("f11_wind_components", oracle("WITH t AS (SELECT p_partkey, p_size, (p_partkey * 7 % 360 - p_partkey * 3 % 360 + 360) % 360 AS t FROM part) SELECT p_partkey, round(cos(radians(t)) * p_size, 6) + 0.0 AS head, round(sin(radians(t)) * p_size, 6) + 0.0 AS cross FROM t"))
def f11(spark, sf_dir):
    w = S.wind_components((F.col("p_partkey") * 7 % 360).cast("double"), "p_size", (F.col("p_partkey") * 3 % 360).cast("double"))
    return parts(spark, sf_dir).select("p_partkey", w.alias("w")).select("p_partkey", (F.round("w.head", 6) + 0.0).alias("head"), (F.round("w.cross", 6) + 0.0).alias("cross"))


@query("f12_haversine", oracle("SELECT p_partkey, round(2 * 6371.0 * asin(sqrt(power(sin(radians(p_size - 10) / 2), 2) + cos(radians(10)) * cos(radians(p_size)) * power(sin(radians(p_partkey % 180 - 20) / 2), 2))), 5) AS km FROM part"))
def f12(spark, sf_dir):
    return parts(spark, sf_dir).select("p_partkey", F.round(S.haversine_km(F.lit(10.0), F.lit(20.0), "p_size", F.col("p_partkey") % 180), 5).alias("km"))


@query("f13_polyline", oracle("SELECT p_partkey, round(sqrt(p_size * p_size + 9.0) + p_partkey % 10, 9) AS length, round(p_size * 2 / 3.0, 9) AS x FROM part"))
def f13(spark, sf_dir):
    pts = F.expr("array(named_struct('x', 0D, 'y', 0D), named_struct('x', cast(p_size as double), 'y', 3D), named_struct('x', cast(p_size as double), 'y', 3D + p_partkey % 10))")
    return parts(spark, sf_dir).select("p_partkey", pts.alias("pts")).select("p_partkey", F.round(S.polyline_length("pts"), 9).alias("length"), F.round(S.centroid("pts")["x"], 9).alias("x"))


@query("f16_token_overlap", oracle("WITH w AS (SELECT p_partkey, list_distinct(string_split(trim(regexp_replace(lower(p_name), '[^a-z0-9]+', ' ', 'g')), ' ')) AS a, list_distinct(string_split(trim(regexp_replace(lower(p_type), '[^a-z0-9]+', ' ', 'g')), ' ')) AS b FROM part) SELECT p_partkey, len(list_intersect(a, b)) / least(len(a), len(b)) AS overlap FROM w"))
def f16(spark, sf_dir):
    return parts(spark, sf_dir).select("p_partkey", S.token_overlap("p_name", "p_type").alias("overlap"))


@query("f17_round_half_up", oracle("SELECT l_orderkey, l_linenumber, floor((l_quantity - 25) / 8 * 10 + 0.5) / 10 AS r FROM lineitem"))
def f17(spark, sf_dir):
    return view(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", S.round_half_up((F.col("l_quantity") - 25) / 8, 1).alias("r"))


@query("f18_f19_tier_kind", oracle("SELECT p_partkey, CASE WHEN p_size >= 40 THEN 'HIGH' WHEN p_size >= 20 THEN 'MEDIUM' WHEN p_size >= 8 THEN 'LIMITED' ELSE 'INSUFFICIENT' END AS tier, CASE p_size % 6 - 3 WHEN -3 THEN 'eagle' WHEN -2 THEN 'eagle' WHEN -1 THEN 'under' WHEN 0 THEN 'par' WHEN 1 THEN 'over' ELSE 'double' END AS kind FROM part"))
def f18(spark, sf_dir):
    return parts(spark, sf_dir).select("p_partkey", S.tier("rounds", "p_size").alias("tier"), S.result_kind(F.col("p_size") % 6 - 3).alias("kind"))


@query("f20_to_local", oracle("SELECT event_id, ts + to_hours(CAST(floor((event_id % 360 - 180) / 15.0 + 0.5) AS INT)) AS local FROM events"))
def f20(spark, sf_dir):
    return view(spark, sf_dir, "events").select("event_id", S.to_local("ts", None, F.col("event_id") % 360 - 180).alias("local"))


@query("f21_ordinal", oracle("SELECT p_partkey, p_partkey || CASE WHEN p_partkey % 100 BETWEEN 11 AND 13 THEN 'th' WHEN p_partkey % 10 = 1 THEN 'st' WHEN p_partkey % 10 = 2 THEN 'nd' WHEN p_partkey % 10 = 3 THEN 'rd' ELSE 'th' END AS ordinal, CASE p_partkey % 3 WHEN 0 THEN 'a' WHEN 1 THEN 'a and b' ELSE 'a, b and c' END AS words FROM part"))
def f21(spark, sf_dir):
    words = F.slice(F.array(F.lit("a"), F.lit("b"), F.lit("c")), F.lit(1), (F.col("p_partkey") % 3 + 1).cast("int"))
    return parts(spark, sf_dir).select("p_partkey", S.ordinal("p_partkey").alias("ordinal"), S.join_words(words).alias("words"))


@query("f22_extract_phrase", oracle(r"SELECT doc_id, coalesce(nullif(regexp_extract(text, '(\w+@\w+)', 1), ''), nullif(regexp_extract(text, '(\d{3,})', 1), '')) AS phrase FROM documents"))
def f22(spark, sf_dir):
    return view(spark, sf_dir, "documents").select("doc_id", S.extract_phrase("text", [r"([A-Za-z0-9_]+@[A-Za-z0-9_]+)", r"([0-9]{3,})"]).alias("phrase"))


@query("f23_json_path", oracle("SELECT event_id, json_extract_string(props, '$.k') AS k FROM events"))
def f23(spark, sf_dir):
    return view(spark, sf_dir, "events").select("event_id", S.json_path("props", "$.k").alias("k"))


@query("f24_explode_interval", oracle("SELECT event_id, unnest(generate_series(date_trunc('hour', ts), date_trunc('hour', ts) + to_hours(CAST(event_id % 3 AS INT)), INTERVAL 1 HOUR)) AS at FROM events"))
def f24(spark, sf_dir):
    e = view(spark, sf_dir, "events").select("event_id", F.date_trunc("hour", "ts").alias("a"), (F.date_trunc("hour", "ts") + F.make_dt_interval(hours=(F.col("event_id") % 3 + 1).cast("int"))).alias("b"))
    return S.explode_interval(e, "a", "b").select("event_id", "at")


@query("f25_undo_cumulative", oracle("SELECT l_orderkey, array_to_string(list(CAST(l_quantity AS BIGINT) ORDER BY l_linenumber, l_quantity), ',') AS items FROM lineitem GROUP BY 1"))
def f25(spark, sf_dir):
    li = view(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.expr("sum(cast(l_quantity as bigint)) over (partition by l_orderkey order by l_linenumber, l_quantity rows unbounded preceding)").alias("run"))
    g = li.groupBy("l_orderkey").agg(F.transform(F.array_sort(F.collect_list(F.struct("l_linenumber", "run"))), lambda x: x["run"]).alias("runs"))
    return g.select("l_orderkey", F.array_join(S.undo_cumulative("runs").cast("array<string>"), ",").alias("items"))


@query("f27_canon_label", oracle("SELECT n_nationkey, CASE n_name WHEN 'NATION_1' THEN 'One' WHEN 'NATION_2' THEN 'Two' ELSE n_name END AS label FROM nation"))
def f27(spark, sf_dir):
    return view(spark, sf_dir, "nation").select("n_nationkey", S.canon_label("n_name", {"NATION_1": "One", "NATION_2": "Two"}).alias("label"))


@query("f28_long_to_map", oracle("SELECT entity_id, season, string_agg(code || '=' || value, ',' ORDER BY code) AS m FROM stats GROUP BY 1, 2"))
def f28(spark, sf_dir):
    m = S.long_to_map(view(spark, sf_dir, "stats"), ["entity_id", "season"], "code", "value")
    return m.select("entity_id", "season", F.array_join(F.transform(F.array_sort(F.map_entries("values")), lambda e: F.concat(e["key"], F.lit("="), e["value"].cast("string"))), ",").alias("m"))


@query("f29_mask_text", oracle(r"SELECT doc_id, md5(regexp_replace(text, '[0-9]{3,}', '***', 'g')) AS masked FROM documents"))
def f29(spark, sf_dir):
    return view(spark, sf_dir, "documents").select("doc_id", F.md5(S.mask_text("text", "[0-9]{3,}")).alias("masked"))


#: The keys of the variants of a name, from the list t of its words.
NAME_KEYS = """CASE WHEN len(t) > 1 THEN list_distinct([array_to_string(list_sort(t), ' '), array_to_string(list_sort([t[1], array_to_string(t[2:], '')]), ' '), array_to_string(list_sort([t[-1], array_to_string(t[:-2], '')]), ' ')]) ELSE t END"""
NAME_WORDS = "list_filter(string_split(trim(regexp_replace(lower(regexp_replace({}, '[-’''`.]', '', 'g')), '[^a-z0-9]+', ' ', 'g')), ' '), lambda x: x <> '')"


@query("f31_name_keys", oracle(f"WITH t AS (SELECT p_partkey, {NAME_WORDS.format('p_name')} AS t FROM part) SELECT p_partkey, array_to_string(list_sort({NAME_KEYS}), '|') AS keys FROM t"))
def f31(spark, sf_dir):
    return parts(spark, sf_dir).select("p_partkey", F.array_join(F.array_sort(S.name_keys("p_name")), "|").alias("keys"))


DRAWS = """WITH o AS (SELECT entity_id, score, row_number() OVER (PARTITION BY entity_id ORDER BY event_id, period, score) - 1 AS i, count(*) OVER (PARTITION BY entity_id) AS n FROM scores), f AS (SELECT DISTINCT event_id, entity_id, period FROM scores),
d AS (SELECT f.*, unnest(range(1, 9)) AS draw FROM f), x AS (SELECT *, ((draw * 1103515245 + 12345) % 2147483648) * 69069 + event_id AS a FROM d), y AS (SELECT *, ((a % 2147483648) * 69069 + entity_id) AS b FROM x), z AS (SELECT *, (((b % 2147483648) * 69069 + period) % 2147483648) // 65536 AS c FROM y),
dr AS (SELECT z.event_id, z.entity_id, z.period, z.draw, o.score FROM z JOIN o ON z.entity_id = o.entity_id AND o.i = z.c % o.n)"""


def drawn(spark, sf_dir):
    s = view(spark, sf_dir, "scores")
    return D.bootstrap_draws(s, s.select("event_id", "entity_id", "period"), 8, "entity_id", "score", ["event_id", "entity_id", "period"])


@query("d01_bootstrap_draws", oracle(f"{DRAWS} SELECT * FROM dr"))
def d01_whole(spark, sf_dir):
    return drawn(spark, sf_dir).select("event_id", "entity_id", "period", "draw", "score")


@query("d02_draw_outcomes", oracle(f"""{DRAWS}, t AS (SELECT event_id, draw, entity_id, sum(score) AS total, sum(score) FILTER (period <= 2) AS early, max(period) AS p FROM dr GROUP BY 1, 2, 3),
m AS (SELECT *, NOT (max(p) OVER w > 2 AND count(*) OVER w > 10) OR rank() OVER (PARTITION BY event_id, draw ORDER BY early NULLS FIRST) <= 10 AS made FROM t WINDOW w AS (PARTITION BY event_id, draw)), k AS (SELECT *, CASE WHEN made THEN total ELSE 10000 + early END AS key FROM m),
r AS (SELECT *, rank() OVER (PARTITION BY event_id, draw ORDER BY key NULLS FIRST) AS position FROM k), s AS (SELECT *, count(*) OVER (PARTITION BY event_id, draw, position) AS share FROM r)
SELECT event_id, entity_id, round(avg(CASE WHEN position = 1 THEN 1.0::DOUBLE / share ELSE 0 END), 9) AS win, avg((position <= 10)::INT) AS top10, avg((position <= 20)::INT) AS top20, avg(made::INT) AS make, avg(position) AS position FROM s GROUP BY 1, 2"""))
def d02_whole(spark, sf_dir):
    return D.draw_outcomes(drawn(spark, sf_dir), "event_id", "entity_id", "period", "score", 10).withColumn("win", F.round("win", 9))


@query("d03_pair_probability", oracle(f"""{DRAWS}, t AS (SELECT event_id, draw, entity_id, sum(score) AS t FROM dr GROUP BY 1, 2, 3) SELECT a.event_id, a.entity_id AS a, b.entity_id AS b, count(*) FILTER (a.t < b.t) / nullif(count(*) FILTER (a.t <> b.t), 0) AS p_ahead, count(*) FILTER (a.t = b.t) / count(*) AS p_tie FROM t a JOIN t b ON a.event_id = b.event_id AND a.draw = b.draw AND b.entity_id = a.entity_id + 1 GROUP BY 1, 2, 3"""))
def d03_whole(spark, sf_dir):
    pairs = view(spark, sf_dir, "scores").select(F.col("entity_id").alias("a"), (F.col("entity_id") + 1).alias("b")).distinct()
    return D.pair_probability(drawn(spark, sf_dir), pairs, "event_id", "entity_id", "score")


@query("d04_cut_rule", oracle("SELECT p_partkey, CASE WHEN p_partkey % 4 = 0 THEN NULL WHEN p_partkey % 4 = 1 AND p_size * 3 <= 84 THEN NULL WHEN p_partkey % 10 = 7 THEN 50 ELSE 65 END AS cut FROM part"))
def d04(spark, sf_dir):
    p = parts(spark, sf_dir).selectExpr("p_partkey", "CASE WHEN p_partkey % 4 <> 1 THEN p_partkey % 4 <> 0 END AS prior", "p_size * 3 AS field")
    return p.select("p_partkey", D.cut_rule("prior", "field", F.when(F.col("p_partkey") % 10 == 7, 50)).alias("cut"))


@query("src02_flatten_bundle", oracle("SELECT CAST(entity_id AS VARCHAR) AS event_id, 'c' || season AS entity_id, status, 1 AS period, CAST(points AS DOUBLE) AS value FROM results"))
def src02(spark, sf_dir):
    r = view(spark, sf_dir, "results").select(F.format_string('{"event_id":"%d","competitors":[{"id":"c%d","status":"%s","linescores":[{"period":1,"value":%d}]}]}', "entity_id", "season", "status", "points").alias("j"))
    return R.flatten_bundle(r, "j")


@query("src03_page_links", oracle(r"""SELECT page_id, unnest(regexp_extract_all(html, '<a\s[^>]*href="([^"]*)"', 1)) AS href FROM pages"""))
def src03(spark, sf_dir):
    return R.extract_links(view(spark, sf_dir, "pages"), "page_id", "html").select("page_id", "href")


@query("src03_page_titles", oracle(r"""SELECT page_id, nullif(trim(regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1)), '') AS title FROM pages"""))
def src03b(spark, sf_dir):
    return R.extract_title(view(spark, sf_dir, "pages"), "page_id", "html")
