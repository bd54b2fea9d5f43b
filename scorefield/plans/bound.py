"""Queries of readers, publishing, studies and checks over files and tables that Spark derives from the given ones."""

from pyspark.sql import functions as F

from ..operators import aggregates as A
from ..operators import publish as P
from ..operators import sets as O
from ..operators import studies as U
from ..sources import readers as R
from ..streaming import tape as ST
from .bindings import oracle, view
from .registry import query
from .streams import shared


@query("dq06_check_schema", oracle("""WITH h AS (SELECT column_name AS c, CASE column_type WHEN 'BIGINT' THEN 'bigint' WHEN 'INTEGER' THEN 'int' WHEN 'DOUBLE' THEN 'double' WHEN 'VARCHAR' THEN 'string' ELSE lower(column_type) END AS t FROM (DESCRIBE customer)),
w AS (SELECT * FROM (VALUES ('c_custkey', 'bigint'), ('c_name', 'string'), ('c_nationkey', 'bigint'), ('c_acctbal', 'double'), ('c_phone', 'string')) v(c, t))
SELECT coalesce(w.c, h.c) AS field, w.t AS wanted, h.t AS found, CASE WHEN h.c IS NULL THEN 'missing' WHEN w.c IS NULL THEN 'extra' ELSE 'type' END AS problem, (SELECT count(*) FROM customer) AS rows FROM w FULL JOIN h ON w.c = h.c WHERE w.t IS DISTINCT FROM h.t"""))
def dq06(spark, sf_dir):
    """Where the table departs from the contract, and how many rows that concerns."""
    c = view(spark, sf_dir, "customer")
    contract = {"c_custkey": "bigint", "c_name": "string", "c_nationkey": "bigint", "c_acctbal": "double", "c_phone": "string"}
    return O.check_schema(c, contract).withColumn("rows", c.agg(F.count("*")).scalar())


@query("src03_page_cells", oracle("""SELECT page_id, 0 AS "table", CAST(c // 2 AS INT) AS row, CAST(c % 2 AS INT) AS col, CASE c WHEN 0 THEN 'page' WHEN 1 THEN 'size' WHEN 2 THEN CAST(page_id AS VARCHAR) ELSE CAST(strlen(url) AS VARCHAR) || ' bytes' END AS text FROM pages, (SELECT unnest(range(0, 4)) AS c)"""))
def src03_cells(spark, sf_dir):
    """Pages with a table of their number and the size of their address put before what they hold."""
    row = F.concat(F.lit("<table class='x'><tr><th>page</th><th>size</th></tr>\n<TR><td><b>"), F.col("page_id").cast("string"), F.lit("</b></td><td align='right'> "), F.octet_length("url").cast("string"), F.lit("\n  <i>bytes</i></td></TR></table>"))
    return R.extract_page_tables(view(spark, sf_dir, "pages").withColumn("html", F.concat(row, F.coalesce("html", F.lit("")))), "page_id", "html")


@query("src03_page_tables", oracle("""SELECT page_id, t AS "table", r AS row, c AS col, replace(x, '#', CAST(page_id AS VARCHAR)) AS text FROM pages, (VALUES (0, 0, 0, 'place'), (0, 0, 1, 'name'), (0, 0, 2, 'name'), (0, 0, 3, 'money'), (0, 1, 0, 'T#'), (0, 1, 1, 'a'), (0, 1, 2, 'b'), (0, 1, 3, '7 & 9'), (0, 2, 0, 'T#'), (0, 2, 1, 'c'), (0, 2, 2, 'd'), (0, 2, 3, '7 & 9'), (0, 3, 0, 'T#'), (0, 3, 1, 'e inner'), (0, 3, 2, 'f'), (0, 3, 3, '5'), (0, 4, 0, '4'), (0, 4, 1, 'g'), (0, 4, 2, 'g'), (0, 4, 3, 'g'), (1, 0, 0, 'x < y')) v(t, r, c, x)"""))
def src03_tables(spark, sf_dir):
    """Pages with two tables after what they hold: cells that span rows and columns, a table inside a cell, no closing tags."""
    made = (
        "<table><thead><tr><th>place</th><th colspan=2>name</th><th>money</th></tr></thead>\n<tbody><tr><td rowspan='3'>T#</td><td>a</td><td>b</td><td rowspan=\"2\">7 &amp; 9</td></tr><tr><td>c<td>d"
        "<tr><td>e <table><tr><td rowspan=9>in</td></tr><tr><td>ner</td></tr></table></td><td>f</td><td>5</td></tr></tbody><tr><td>4</td><td colspan=3><b>g</b></td></tr></table><p>no</p><TABLE class=y><TR><TD>x < y</TABLE>"
    )
    return R.extract_page_tables(view(spark, sf_dir, "pages").withColumn("html", F.concat(F.coalesce("html", F.lit("")), F.replace(F.lit(made), F.lit("#"), F.col("page_id").cast("string")))), "page_id", "html")


@query("src04_packed_csv", oracle("""SELECT event_id, CASE WHEN event_id % 11 <> 0 THEN CAST(event_id % 360 AS DOUBLE) END AS direction, CASE WHEN event_id % 13 <> 0 THEN (user_id % 500) * 0.1::DOUBLE END AS speed,
CASE WHEN event_id % 7 <> 0 THEN (user_id % 90 - 40) * 0.1::DOUBLE END AS degrees FROM events WHERE event_type IN ('click', 'view')"""))
def src04(spark, sf_dir):
    """Readings of two kinds of rows, written as CSV with packed fields and read back."""
    path = shared(spark, "stations")
    wind = F.format_string("%03d,1,N,%04d,1", F.when(F.col("event_id") % 11 == 0, 999).otherwise(F.col("event_id") % 360), F.when(F.col("event_id") % 13 == 0, 9999).otherwise(F.col("user_id") % 500))
    warm = F.format_string("%+05d,1", F.when(F.col("event_id") % 7 == 0, 9999).otherwise(F.col("user_id") % 90 - 40))
    view(spark, sf_dir, "events").select("event_id", "event_type", wind.alias("wnd"), warm.alias("tmp")).write.option("header", True).csv(path)
    spec = {"direction": ("wnd", 0, "999", 1.0), "speed": ("wnd", 3, "9999", 0.1), "degrees": ("tmp", 0, "9999", 0.1)}
    read = R.read_packed_csv(spark, path, spec, ["event_id"], "event_type", ["click", "view"])
    return read.withColumn("event_id", F.col("event_id").cast("long"))


@query("src05_feed_entries", oracle("""SELECT CAST(p_partkey AS VARCHAR) AS id, p_name AS title, make_timestamp(2024, 1, CAST(p_partkey % 28 + 1 AS BIGINT), CAST(p_size % 24 AS BIGINT), 0, 0) AS updated, 'https://example.org/' || p_partkey AS link FROM part"""))
def src05(spark, sf_dir):
    path = shared(spark, "feed")
    p = view(spark, sf_dir, "part")
    entry = F.format_string('<entry><id>%d</id><title>%s</title><updated>2024-01-%02dT%02d:00:00Z</updated><link href="https://example.org/%d"/></entry>', "p_partkey", "p_name", F.col("p_partkey") % 28 + 1, F.col("p_size") % 24, "p_partkey")
    feeds = p.groupBy((F.col("p_partkey") / 1000).cast("long").alias("feed")).agg(F.concat(F.lit("<feed>"), F.array_join(F.collect_list(entry), ""), F.lit("</feed>")).alias("value"))
    feeds.write.partitionBy("feed").text(path)  # a feed has a thousand entries at most, and a file of its own
    return R.read_feed(spark, path)


@query("src07_map_elements", oracle("""SELECT p_partkey AS id, p_name AS name, CASE WHEN p_size % 2 = 0 THEN 'hole' ELSE 'park' END AS role, 1 + p_size % 3 AS points, p_partkey / 4.0::DOUBLE AS last_lat FROM part"""))
def src07(spark, sf_dir):
    path = shared(spark, "elements")
    p = view(spark, sf_dir, "part")
    tags = F.when(F.col("p_size") % 2 == 0, F.create_map(F.lit("name"), "p_name", F.lit("golf"), F.lit("hole"))).otherwise(F.create_map(F.lit("name"), "p_name", F.lit("leisure"), F.lit("park")))
    points = F.transform(F.sequence(F.lit(0), F.col("p_size") % 3), lambda i: F.struct((F.col("p_partkey") / 4).alias("lat"), i.cast("double").alias("lon")))
    p.select(F.to_json(F.struct(F.col("p_partkey").alias("id"), F.lit("way").alias("type"), tags.alias("tags"), points.alias("geometry"))).alias("value")).write.text(path)
    return R.read_elements(spark, path).select("id", "name", "role", F.size("points").alias("points"), F.element_at("points", -1)["lat"].alias("last_lat"))


@query("snk09_guarded_overwrite", oracle("SELECT c_custkey, cents + 1 AS cents, c_mktsegment, true AS first, false AS second FROM src_a"))
def snk09(spark, sf_dir):
    """A version without regressions is published; the next one, which loses rows and fields, is refused and leaves it."""
    path = shared(spark, "published")
    live = view(spark, sf_dir, "src_a").select("c_custkey", "cents", "c_mktsegment")
    better = live.withColumn("cents", F.col("cents") + 1)
    worse = view(spark, sf_dir, "src_b").select("c_custkey", "cents", "c_mktsegment")
    done = [P.guarded_overwrite(a, b, path, "c_custkey", ["cents"], ["c_mktsegment"]) for a, b in ((live, better), (better, worse))]
    return P.read_published(spark, path).select("*", F.lit(done[0]).alias("first"), F.lit(done[1]).alias("second"))


#: Two versions of an index of parts.
OLD_INDEX = """SELECT p_partkey AS slug, list_value('full', 'reviewed', 'partial', 'held', 'no-routing', 'unaudited')[p_partkey % 6 + 1] AS status, p_size AS mapped, p_brand AS element, CASE WHEN p_partkey % 4 > 0 THEN p_partkey % 4 > 1 END AS coords, p_partkey % 3 = 0 AS exact,
CASE WHEN p_partkey % 10 > 0 THEN p_size % 3 END AS fa, p_size % 7 AS fb, CASE WHEN p_partkey % 5 = 0 THEN 'r' END AS review, CASE WHEN p_partkey % 9 = 0 THEN 'c' END AS candidate, p_size AS extracted FROM part WHERE p_partkey % 11 <> 3"""
NEW_INDEX = """SELECT p_partkey AS slug, list_value('full', 'reviewed', 'partial', 'held', 'no-routing', 'unaudited')[CASE WHEN p_partkey % 7 = 0 THEN (p_partkey + 1) % 6 ELSE p_partkey % 6 END + 1] AS status, CASE WHEN p_partkey % 8 = 0 THEN p_size - 1 WHEN p_partkey % 8 = 1 THEN p_size + 1 ELSE p_size END AS mapped, CASE WHEN p_partkey % 10 = 4 THEN 'other' ELSE p_brand END AS element,
CASE WHEN p_partkey % 13 = 0 THEN NULL ELSE p_partkey % 13 > 4 END AS coords, CASE WHEN p_partkey % 6 = 0 THEN 0 ELSE p_size % 3 END AS fa, CASE WHEN p_partkey % 12 = 1 THEN p_size % 7 // 2 ELSE p_size % 7 END AS fb, CASE WHEN p_partkey % 15 = 0 THEN 'r' END AS review, CASE WHEN p_partkey % 27 = 0 THEN 'c' END AS candidate, CASE WHEN p_partkey % 14 = 0 THEN p_size - 1 ELSE p_size END AS extracted FROM part WHERE p_partkey % 12 <> 5"""
PARITY = f"""WITH o AS ({OLD_INDEX}), n AS ({NEW_INDEX}), r AS (SELECT * FROM (VALUES ('full', 3), ('reviewed', 3), ('partial', 2), ('held', 1), ('no-routing', 0), ('unaudited', 0)) v(s, k)),
m AS (SELECT coalesce(o.slug, n.slug) AS slug, o.slug IS NULL AS added, n.slug IS NULL AS gone, ro.k AS a, rn.k AS b, o.mapped AS ma, n.mapped AS mb, o.element <> n.element AS other, coalesce(o.coords, o.exact) AND n.coords = false AS lost, (o.fa > 0 AND n.fa = 0) OR (o.fb > 0 AND n.fb = 0) OR n.fa + n.fb < (coalesce(o.fa, 0) + o.fb) * 0.75 AS less, o.fa IS NOT NULL AS drawn,
o.review IS NOT NULL AND n.review IS NULL AS unreviewed, o.candidate IS NOT NULL AND n.candidate IS NULL AS nameless, n.extracted < o.extracted AS older FROM o FULL JOIN n ON o.slug = n.slug LEFT JOIN r ro ON ro.s = o.status LEFT JOIN r rn ON rn.s = n.status),
k AS (SELECT slug, unnest(list_filter([CASE WHEN gone THEN 'row_removed' END, CASE WHEN added THEN 'added' END, CASE WHEN b < a THEN 'status_downgrade' END, CASE WHEN mb < ma THEN 'mapped_lost' END, CASE WHEN a >= 2 AND b >= 2 AND other THEN 'element_changed' END, CASE WHEN lost THEN 'coords_missing' END, CASE WHEN a >= 2 AND b >= 2 AND drawn AND less THEN 'features_lost' END,
CASE WHEN NOT gone AND NOT added AND unreviewed THEN 'review_lost' END, CASE WHEN NOT gone AND NOT added AND nameless AND b <= 1 THEN 'candidate_lost' END, CASE WHEN older THEN 'older_extract' END, CASE WHEN b > a OR mb > ma THEN 'improved' END], lambda x: x IS NOT NULL)) AS kind FROM m)
SELECT slug, kind, CASE WHEN kind = 'added' THEN 'added' WHEN kind = 'improved' THEN 'improvement' WHEN slug % 2 = 0 AND kind IN ('row_removed', 'mapped_lost') THEN 'explained' ELSE 'regression' END AS outcome, CASE WHEN slug % 2 = 0 AND kind IN ('row_removed', 'mapped_lost') THEN 'e' || slug END AS evidence_id FROM k"""


def indexes(spark, sf_dir):
    p = view(spark, sf_dir, "part")
    counts = lambda drawn: F.when(drawn, F.map_from_arrays(F.array(F.lit("a"), F.lit("b")), F.array(F.col("fa").cast("int"), F.col("fb").cast("int")))).alias("features")
    as_spark = lambda sql: spark.sql(sql.replace("list_value(", "array(").replace("] AS status", "] AS status").replace(" % 6 + 1] AS", " % 6] AS").replace(" END + 1] AS", " END] AS").replace("//", "div").replace("FROM part", "FROM {part}"), part=p)
    cols = ["slug", "status", "mapped", "element", "coords", "review", "candidate", "extracted"]
    old, new = as_spark(OLD_INDEX), as_spark(NEW_INDEX)
    return old.select(*cols, "exact", counts(F.col("fa").isNotNull())), new.select(*cols, counts(F.lit(True)))


@query("j22_version_parity", oracle(PARITY))
def j22_version(spark, sf_dir):
    old, new = indexes(spark, sf_dir)
    allow = old.where("slug % 2 = 0").select("slug", F.array(F.lit("row_removed"), F.lit("mapped_lost"), F.lit("coords_missing")).alias("allow"), F.concat(F.lit("e"), F.col("slug").cast("string")).alias("evidence_id"))
    return P.version_parity(old, new, "slug", "status", "mapped", "element", "coords", F.col("exact"), "features", "review", "candidate", "extracted", allow)


@query("snk09_staged_publish", oracle("SELECT p_partkey AS slug, CASE WHEN p_partkey % 11 = 3 THEN 2 ELSE 1 END AS version, p_size AS mapped FROM part"))
def snk09_staged(spark, sf_dir):
    """Three versions of an index: the second only adds rows, the third loses some and is refused."""
    root = shared(spark, "published-index")
    every = view(spark, sf_dir, "part").select(F.col("p_partkey").alias("slug"), F.lit("full").alias("status"), F.col("p_size").alias("mapped"))
    compare = lambda a, b: P.version_parity(a, b, "slug", "status", "mapped")
    first = every.where("slug % 11 <> 3").withColumn("version", F.lit(1))
    second = every.withColumn("version", F.when(F.col("slug") % 11 == 3, 2).otherwise(1))
    third = every.where("slug % 5 <> 0").withColumn("version", F.lit(3))
    done = [P.publish(v, root, compare)["published"] for v in (first, second, third)]
    if done != [True, True, False]:
        raise ValueError(f"published: {done}")
    return P.read_published(spark, root).select("slug", "version", "mapped")


@query("j17_near_boundary_join", oracle("""WITH p AS (SELECT c_custkey AS id, CAST(c_custkey * 37 % 997 AS DOUBLE) AS x, CAST(c_custkey * 53 % 991 AS DOUBLE) AS y FROM customer), r AS (SELECT s_suppkey AS ring_id, CAST(s_suppkey * 71 % 997 AS DOUBLE) AS cx, CAST(s_suppkey * 91 % 991 AS DOUBLE) AS cy, CAST(20 + s_suppkey % 5 AS DOUBLE) AS h FROM supplier),
d AS (SELECT id, ring_id, CASE WHEN abs(x - cx) <= h AND abs(y - cy) <= h THEN least(h - abs(x - cx), h - abs(y - cy)) ELSE sqrt(power(greatest(abs(x - cx) - h, 0), 2) + power(greatest(abs(y - cy) - h, 0), 2)) END AS distance FROM p, r WHERE (id + ring_id) % 3 <> 0),
n AS (SELECT *, count(*) OVER (PARTITION BY id) AS n FROM d WHERE distance <= 15) SELECT id, ring_id, round(distance, 6) AS distance FROM n WHERE n = 1"""))
def j17(spark, sf_dir):
    p = view(spark, sf_dir, "customer").selectExpr("c_custkey AS id", "CAST(c_custkey * 37 % 997 AS DOUBLE) AS x", "CAST(c_custkey * 53 % 991 AS DOUBLE) AS y")
    s = view(spark, sf_dir, "supplier").selectExpr("s_suppkey AS ring_id", "CAST(s_suppkey * 71 % 997 AS DOUBLE) AS cx", "CAST(s_suppkey * 91 % 991 AS DOUBLE) AS cy", "CAST(20 + s_suppkey % 5 AS DOUBLE) AS h")
    ring = F.expr("transform(array(array(-1, -1), array(1, -1), array(1, 1), array(-1, 1)), c -> named_struct('x', cx + c[0] * h, 'y', cy + c[1] * h))")
    agree = F.when(F.pmod(F.col("id") + F.col("ring_id"), F.lit(3)) == 0, 0.2).otherwise(0.8)
    return U.near_boundary_join(p, s.select("ring_id", ring.alias("ring")), "id", "ring_id", 15.0, agree).withColumn("distance", F.round("distance", 6))


@query("a35_readiness_reason", oracle("""WITH g AS (SELECT entity_id, count(*) AS n, max(season) AS last, count(*) FILTER (status = 'F') AS done FROM results GROUP BY 1)
SELECT entity_id, CASE WHEN NOT n >= 8 THEN 'source hold' WHEN NOT done >= 3 THEN 'policy' WHEN NOT last >= 1998 THEN 'technical' END AS class FROM g"""))
def a35(spark, sf_dir):
    g = view(spark, sf_dir, "results").groupBy("entity_id").agg(F.count("*").alias("n"), F.max("season").alias("last"), F.count_if(F.col("status") == "F").alias("done"))
    ready = A.readiness(g, {"rows": F.col("n") >= 8, "finished": F.col("done") >= 3, "fresh": F.col("last") >= 1998})
    return ready.select("entity_id", A.readiness_reason("reason", {"technical": ["fresh"], "source hold": ["rows"]}).alias("class"))


@query("st12_replay", oracle("SELECT event_id, event_type, 0 AS again FROM events"))
def st12(spark, sf_dir):
    """Archived snapshots replayed twice with one checkpoint: the second time there is nothing new."""
    path = shared(spark, "archive")
    e = view(spark, sf_dir, "events").select("event_id", "event_type")
    e.write.parquet(f"{path}/in")
    for k in range(2):
        ST.replay(spark.readStream.schema(e.schema).parquet(f"{path}/in"), lambda batch, n, k=k: batch.withColumn("again", F.lit(k)).write.mode("overwrite").parquet(f"{path}/out/run={k}/batch={n}"), f"{path}/state")
    return spark.read.parquet(f"{path}/out").select("event_id", "event_type", "again")


@query("p12_covariate_study", oracle("""WITH p AS (SELECT DISTINCT event_id, CAST(event_id % 100 * 7 - 40 AS DOUBLE) AS lat, CAST(event_id % 7 * 40 - 120 AS DOUBLE) AS lon FROM scores), s AS (SELECT s_suppkey AS station, CAST(s_suppkey * 37 % 120 - 60 AS DOUBLE) AS lat, CAST(s_suppkey * 53 % 360 - 180 AS DOUBLE) AS lon FROM supplier),
d AS (SELECT event_id, station, 2 * 6371.0::DOUBLE * asin(sqrt(least(1, power(sin(radians(s.lat - p.lat) / 2), 2) + cos(radians(p.lat)) * cos(radians(s.lat)) * power(sin(radians(s.lon - p.lon) / 2), 2)))) AS km FROM p, s),
n AS (SELECT event_id, arg_min(station, (km, station)) AS station FROM d WHERE km <= 3000 GROUP BY 1), m AS (SELECT l_suppkey AS station, l_linenumber AS period, sum(l_quantity) / count(*) AS wind FROM lineitem GROUP BY 1, 2),
j AS (SELECT event_id, period, score, wind FROM scores JOIN n USING (event_id) JOIN m USING (station, period)), c AS (SELECT count(*) AS rows, round(corr(d, wind), 6) AS r FROM (SELECT score - sum(score) OVER (PARTITION BY event_id) / count(*) OVER (PARTITION BY event_id) AS d, wind FROM j)),
g AS (SELECT CAST((wind >= 20)::INT + (wind >= 25)::INT + (wind >= 30)::INT AS BIGINT) AS bin, score FROM j)
SELECT bin, count(*) AS n, round(CASE WHEN count(*) >= 30 THEN sum(score) / count(*) END, 6) AS mean, round(CASE WHEN count(*) >= 30 THEN stddev_samp(score) END, 4) AS sd, any_value(rows) AS rows, any_value(r) AS r FROM g, c GROUP BY 1"""))
def p12(spark, sf_dir):
    scores = view(spark, sf_dir, "scores")
    points = scores.select("event_id").distinct().selectExpr("event_id", "CAST(event_id % 100 * 7 - 40 AS DOUBLE) AS lat", "CAST(event_id % 7 * 40 - 120 AS DOUBLE) AS lon")
    stations = view(spark, sf_dir, "supplier").selectExpr("s_suppkey AS station", "CAST(s_suppkey * 37 % 120 - 60 AS DOUBLE) AS lat", "CAST(s_suppkey * 53 % 360 - 180 AS DOUBLE) AS lon")
    readings = view(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("station"), F.col("l_linenumber").alias("period"), F.col("l_quantity").alias("wind"))
    corr, bins = U.covariate_study(scores, points, stations, readings, "event_id", "score", "wind", 3000.0, "period", (20, 25, 30))
    one = corr.select(F.struct(F.col("n").alias("rows"), F.round("r", 6).alias("r")).alias("c")).scalar()
    return bins.select("bin", "n", F.round("mean", 6).alias("mean"), F.round("sd", 4).alias("sd"), one.alias("c")).select("bin", "n", "mean", "sd", "c.*")


@query("p21_item_intelligence", oracle("""WITH f AS (SELECT l_partkey, CAST(l_linenumber * 20 AS INT) AS along, l_returnflag AS kind, CASE WHEN l_quantity > 25.5 THEN 1 ELSE -1 END AS side FROM lineitem WHERE abs(l_quantity - 25.5) <= 15)
SELECT p_partkey, 300.0::DOUBLE AS length, 'straight' AS shape, string_agg(along || kind || side, ',' ORDER BY along, kind, side) AS features FROM part LEFT JOIN f ON p_partkey = l_partkey GROUP BY 1"""))
def p21(spark, sf_dir):
    line = F.expr("array(named_struct('x', 0D, 'y', 0D), named_struct('x', 150D, 'y', 0D), named_struct('x', 300D, 'y', 0D))")
    routes = view(spark, sf_dir, "part").select("p_partkey", line.alias("points"), F.lit(4).alias("item_class"))
    features = view(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("p_partkey"), (F.col("l_linenumber") * 20).cast("double").alias("x"), (F.col("l_quantity") - 25.5).alias("y"), F.col("l_returnflag").alias("kind"))
    found = U.item_intelligence(routes, features, ["p_partkey"], 15.0)
    told = F.transform("features", lambda f: F.concat(F.round(f["along"]).cast("int").cast("string"), f["kind"], f["side"].cast("int").cast("string")))
    return found.select("p_partkey", "length", "shape", F.array_join(told, ",").alias("features"))
