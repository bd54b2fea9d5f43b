"""Queries of the stream operators: batch twins with SQL, and streams run over all that is there."""

from pyspark.sql import functions as F

from ..session import shared_folder as shared
from ..streaming import tape as ST
from .bindings import oracle, view
from .registry import query

#: Snapshots: a month is a tick, and its card holds as many items as the year has months so far.
SNAP = """SELECT *, 100 * (tick // 100) + CAST(list_sum(list_transform(range(1, m + 1), lambda i: (entity_id + i) % 3 - 1)) AS BIGINT) + CASE WHEN entity_id % 4 = 1 THEN tick % 2 ELSE 0 END AS total FROM (SELECT entity_id % 3 AS event_id, entity_id, start_on AS observed_at, CAST(event_id // 100 - 1990 AS INT) AS period, CASE WHEN event_id % 50 = 7 AND entity_id % 4 = 0 THEN 'withdrawn' ELSE 'active' END AS status, rank() OVER (PARTITION BY entity_id % 3, event_id ORDER BY total) AS position, CAST(CASE WHEN event_id % 2 = 0 THEN 18 ELSE 9 END AS INT) AS thru, event_id AS tick, event_id % 100 AS m, (entity_id + event_id) % 7 = 0 AS stale FROM entries)"""


def snapshots(spark, sf_dir):
    e = view(spark, sf_dir, "entries")
    s = e.selectExpr(
        "entity_id % 3 AS event_id", "entity_id", "cast(start_on as timestamp) AS observed_at", "cast(event_id div 100 - 1990 as int) AS period", "CASE WHEN event_id % 50 = 7 AND entity_id % 4 = 0 THEN 'withdrawn' ELSE 'active' END AS status", "event_id AS tick", "total",
        "CASE WHEN event_id % 2 = 0 THEN 18 ELSE 9 END AS thru", "transform(sequence(1, cast(event_id % 100 as int)), i -> struct(i as item, cast((entity_id + i) % 3 + 3 as int) as strokes, 4 as par)) AS items", "case when (entity_id + event_id) % 7 = 0 then cast(date_sub(start_on, 1) as timestamp) end AS row_observed_at",
    )
    so_far = "100 * (tick div 100) + aggregate(items, 0L, (s, x) -> s + x.strokes - x.par) + case when entity_id % 4 = 1 then tick % 2 else 0 end AS total"
    return s.selectExpr("event_id", "entity_id", "observed_at", "period", "status", "cast(rank() over (partition by event_id, tick order by total) as bigint) AS position", so_far, "thru", "items", "row_observed_at")


def in_slices(slices, make, name, mode="append"):
    """What a stream gives that finds the slices one after the other, each run going on from the state of the one before; with the
    number of the micro-batch."""
    spark = slices[0].sparkSession
    path = shared(spark, name)
    for k, part in enumerate(slices):
        part.write.mode("append").parquet(f"{path}/in")
        stream = make(spark.readStream.schema(part.schema).parquet(f"{path}/in"))
        put = lambda batch, n: batch.write.mode("overwrite").parquet(f"{path}/out/batch={n}")
        stream.writeStream.outputMode(mode).foreachBatch(put).option("checkpointLocation", f"{path}/state").trigger(availableNow=True).start().awaitTermination()
    return spark.read.option("basePath", f"{path}/out").parquet(f"{path}/out")


def halves(df, ts, day):
    return [df.where(F.col(ts) < F.lit(day).cast("timestamp")), df.where(F.col(ts) >= F.lit(day).cast("timestamp"))]


TAPE = """WITH s AS ({snap}), d AS (SELECT *, lag(status) OVER w AS qs, lag(position) OVER w AS qp, lag(thru) OVER w AS qt, lag(period) OVER w AS qd, lag(total) OVER w AS qo, lag(m) OVER w AS qm FROM s WINDOW w AS (PARTITION BY event_id, entity_id ORDER BY observed_at)),
o AS (SELECT *, qs = 'active' AND status <> 'active' AS stop, greatest(m - qm, 0) AS fresh, qo + coalesce(list_sum(list_transform(range(qm + 1, m + 1), lambda i: (entity_id + i) % 3 - 1)), 0) = total AS known FROM d WHERE qd = period), a AS (SELECT * FROM o WHERE status = 'active'), i AS (SELECT *, unnest(range(qm + 1, m + 1)) AS i FROM a),
x AS (SELECT event_id, entity_id, observed_at, 'status' AS kind, status AS detail FROM o WHERE stop UNION ALL SELECT event_id, entity_id, observed_at, 'finish', CAST(total AS VARCHAR) FROM a WHERE qt < 18 AND thru = 18
UNION ALL SELECT event_id, entity_id, observed_at, 'item', i || '/' || ((entity_id + i) % 3 - 1) || '/' || CASE WHEN known THEN CAST(CAST(qo + list_sum(list_transform(range(qm + 1, i + 1), lambda j: (entity_id + j) % 3 - 1)) AS BIGINT) AS VARCHAR) ELSE '' END FROM i
UNION ALL SELECT event_id, entity_id, observed_at, CASE WHEN position <= 5 AND qp > 5 THEN 'top5' ELSE 'top10' END, CAST(position AS VARCHAR) FROM a WHERE NOT stale AND position <> 1 AND ((position <= 5 AND qp > 5) OR (position <= 10 AND qp > 10))
UNION ALL SELECT event_id, entity_id, observed_at, 'move', CAST(qp - position AS VARCHAR) FROM a WHERE NOT stale AND fresh = 0 AND position <> 1 AND NOT ((position <= 5 AND qp > 5) OR (position <= 10 AND qp > 10)) AND abs(position - qp) >= 5 AND position <= 25) SELECT event_id, entity_id, CAST(observed_at AS TIMESTAMP) AS observed_at, kind, detail FROM x"""


@query("st02_delta_tape_batch", oracle(TAPE.format(snap=SNAP)))
def st02(spark, sf_dir):
    return ST.delta_tape_batch(snapshots(spark, sf_dir))


@query("st02_delta_tape_stream", oracle(TAPE.format(snap=SNAP)))
def st02s(spark, sf_dir):
    """The stream gives the rows of its batch twin, over two runs."""
    return in_slices(halves(snapshots(spark, sf_dir), "observed_at", "1998-03-01"), ST.delta_tape, "tape").drop("batch")


LEADS = f"""WITH s AS ({SNAP}), h AS (SELECT event_id, observed_at, list_sort(list(entity_id) FILTER (position = 1 AND status = 'active')) AS h, list(entity_id) FILTER (status = 'active') AS act FROM s GROUP BY 1, 2), b AS (SELECT *, lag(coalesce(h, [])) OVER (PARTITION BY event_id ORDER BY observed_at) AS b FROM h), c AS (SELECT * FROM b WHERE b IS NOT NULL AND len(h) > 0 AND h <> b)
SELECT event_id, CAST(observed_at AS TIMESTAMP) AS observed_at, CASE WHEN len(h) = 1 THEN 'lead' ELSE 'tie' END AS kind, array_to_string(h, ',') AS holders FROM c UNION ALL SELECT event_id, CAST(observed_at AS TIMESTAMP), 'lost_lead', CAST(x AS VARCHAR) FROM (SELECT event_id, observed_at, h, act, unnest(b) AS x FROM c) WHERE NOT list_contains(h, x) AND list_contains(act, x)"""


@query("st03_lead_changes_batch", oracle(LEADS))
def st03(spark, sf_dir):
    return ST.lead_changes_batch(snapshots(spark, sf_dir))


@query("st03_lead_changes_stream", oracle(LEADS))
def st03s(spark, sf_dir):
    return in_slices(halves(snapshots(spark, sf_dir), "observed_at", "1998-03-01"), ST.lead_changes, "leads").drop("batch")


PULSE = f"WITH s AS ({SNAP}) SELECT entity_id, position FROM (SELECT *, lag(position) OVER (PARTITION BY entity_id ORDER BY observed_at) AS q FROM s WHERE entity_id IN (SELECT entity_id FROM s WHERE position <= 40)) WHERE position <= 10 AND q > 10"


@query("st04_pulse", oracle(PULSE))
def st04(spark, sf_dir):
    s = snapshots(spark, sf_dir)
    return ST.pulse(s, s.where("position <= 40").select("entity_id").distinct(), "entity_id", "observed_at", "position").select("entity_id", "position")


@query("st04_pulse_stream", oracle(PULSE))
def st04s(spark, sf_dir):
    s = snapshots(spark, sf_dir).select("entity_id", "observed_at", "position")
    watch = s.where("position <= 40").select("entity_id").distinct()
    return in_slices(halves(s, "observed_at", "1998-03-01"), lambda x: ST.pulse_stream(x, watch, "entity_id", "observed_at", "position"), "pulse").select("entity_id", "position")


@query("st05_with_freshness", oracle("SELECT event_id, CASE WHEN a <= 5000 THEN 'live' WHEN a <= 20000 THEN 'fresh' WHEN a <= 60000 THEN 'stale' ELSE 'old' END AS freshness FROM (SELECT event_id, (epoch(TIMESTAMP '2024-02-01') - floor(epoch(ts))) / 60 AS a FROM events)"))
def st05(spark, sf_dir):
    return ST.with_freshness(view(spark, sf_dir, "events"), "ts", "2024-02-01", (5000, 20000, 60000)).select("event_id", "freshness")


@query("st06_change_only", oracle("SELECT entity, tick FROM (SELECT *, lag(status) OVER (PARTITION BY entity ORDER BY tick) AS q FROM ticks) WHERE q IS NULL OR q <> status"))
def st06(spark, sf_dir):
    return ST.change_only(view(spark, sf_dir, "ticks"), ["entity"], "tick", ["status"]).select("entity", "tick")


@query("st06_change_only_stream", oracle("SELECT entity, tick FROM (SELECT *, lag(status) OVER (PARTITION BY entity ORDER BY tick) AS q FROM ticks) WHERE q IS NULL OR q <> status"))
def st06s(spark, sf_dir):
    t = view(spark, sf_dir, "ticks").select("entity", "tick", "status")
    return in_slices(halves(t, "tick", "2024-01-15"), lambda x: ST.change_only_stream(x, ["entity"], "tick", ["status"]), "changes").select("entity", "tick")


@query("snk05_append_snapshots", oracle("""SELECT entity, tick FROM (SELECT *, row_number() OVER (PARTITION BY entity ORDER BY tick) AS k FROM (SELECT *, lag(status) OVER (PARTITION BY entity ORDER BY tick) AS q FROM ticks) WHERE q IS NULL OR q <> status) WHERE k <= 20 AND tick >= TIMESTAMP '2024-01-15'"""))
def snk05(spark, sf_dir):
    t = view(spark, sf_dir, "ticks").select("entity", "tick", "status")
    return ST.append_snapshots(t.where("tick >= timestamp'2024-01-15'"), t.where("tick < timestamp'2024-01-15'"), ["entity"], "tick", ["status"], 20).select("entity", "tick")


@query("st07_tape_append_stream", oracle("SELECT event_id, event_type FROM events"))
def st07(spark, sf_dir):
    """Events that arrive twice are appended once."""
    path = shared(spark, "tape")
    e = view(spark, sf_dir, "events").select("event_id", "event_type", F.col("ts").cast("timestamp").alias("ts"))
    e.unionByName(e).write.parquet(f"{path}/in")
    stream = ST.tape_append(spark.readStream.schema(e.schema).parquet(f"{path}/in"), ["event_id", "event_type"], "ts", "400 days")
    ST.replay(stream, lambda batch, n: batch.write.mode("overwrite").parquet(f"{path}/out/batch={n}"), f"{path}/state")
    return spark.read.parquet(f"{path}/out").select("event_id", "event_type")


@query("st07_bounded_tape_batch", oracle("SELECT user_id, event_id FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS k FROM events) WHERE k <= 5"))
def st07b(spark, sf_dir):
    e = view(spark, sf_dir, "events").select("event_id", "user_id", F.col("ts").cast("timestamp").alias("ts"))
    return ST.keep_newest(e.unionByName(e), ["user_id"], ["event_id"], "ts", 5).select("user_id", "event_id")


@query("st07_bounded_tape_stream", oracle("SELECT user_id, event_id FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS k FROM events) WHERE k <= 5"))
def st07s(spark, sf_dir):
    """The newest five of each key are kept, however many runs there were; what arrives twice counts once."""
    e = view(spark, sf_dir, "events").select("event_id", "user_id", F.col("ts").cast("timestamp").alias("ts"))
    old, new = halves(e, "ts", "2024-01-15")
    kept = in_slices([old, new.unionByName(old.where("event_id % 3 = 0"))], lambda x: ST.bounded_tape(x, ["user_id"], ["event_id"], "ts", 5), "bounded", "update")
    last = kept.groupBy("user_id").agg(F.max("version").alias("version"))
    return kept.join(last, ["user_id", "version"], "left_semi").select("user_id", "event_id")


@query("st08_carry_forward", oracle("""WITH x AS (SELECT entity, tick, CASE WHEN n % 2 = 1 THEN moved END AS v FROM ticks) SELECT entity, tick, last_value(v IGNORE NULLS) OVER w AS v, last_value(CASE WHEN v IS NOT NULL THEN tick END IGNORE NULLS) OVER w AS row_observed_at FROM x WINDOW w AS (PARTITION BY entity ORDER BY tick ROWS UNBOUNDED PRECEDING)"""))
def st08(spark, sf_dir):
    t = view(spark, sf_dir, "ticks").select("entity", "tick", F.when(F.col("n") % 2 == 1, F.col("moved")).alias("v"))
    return ST.carry_forward(t, ["entity"], "tick", ["v"])


@query("st08_carry_forward_stream", oracle("""WITH x AS (SELECT entity, tick, CASE WHEN n % 2 = 1 THEN moved END AS v FROM ticks) SELECT entity, tick, last_value(v IGNORE NULLS) OVER w AS v, last_value(CASE WHEN v IS NOT NULL THEN tick END IGNORE NULLS) OVER w AS row_observed_at FROM x WINDOW w AS (PARTITION BY entity ORDER BY tick ROWS UNBOUNDED PRECEDING)"""))
def st08s(spark, sf_dir):
    t = view(spark, sf_dir, "ticks").select("entity", "tick", F.when(F.col("n") % 2 == 1, F.col("moved")).alias("v"))
    return in_slices(halves(t, "tick", "2024-01-15"), lambda x: ST.carry_forward_stream(x, ["entity"], "tick", ["v"]), "carried").drop("batch")


@query("st09_time_since_change", oracle("""WITH c AS (SELECT *, CASE WHEN status IS DISTINCT FROM lag(status) OVER (PARTITION BY entity ORDER BY tick) THEN tick END AS c FROM ticks), m AS (SELECT entity, tick, max(c) OVER (PARTITION BY entity ORDER BY tick) AS changed_at FROM c) SELECT *, date_diff('second', changed_at, tick) AS seconds FROM m"""))
def st09(spark, sf_dir):
    return ST.time_since_change(view(spark, sf_dir, "ticks").select("entity", "tick", "status"), ["entity"], "tick", "status").drop("status")


@query("st09_time_since_change_stream", oracle("""WITH c AS (SELECT *, CASE WHEN status IS DISTINCT FROM lag(status) OVER (PARTITION BY entity ORDER BY tick) THEN tick END AS c FROM ticks), m AS (SELECT entity, tick, max(c) OVER (PARTITION BY entity ORDER BY tick) AS changed_at FROM c) SELECT *, date_diff('second', changed_at, tick) AS seconds FROM m"""))
def st09s(spark, sf_dir):
    t = view(spark, sf_dir, "ticks").select("entity", "tick", "status")
    return in_slices(halves(t, "tick", "2024-01-15"), lambda x: ST.time_since_change_stream(x, ["entity"], "tick", "status"), "since").drop("batch", "status")


@query("st10_daily_counters_stream", oracle("SELECT date_trunc('day', ts) AS day, event_type, count(*) AS n FROM events GROUP BY 1, 2"))
def st10(spark, sf_dir):
    from ..operators.aggregates import daily_counters

    path = shared(spark, "counters")
    schema = view(spark, sf_dir, "events").schema
    source = spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(sf_dir)
    counts = daily_counters(source, "ts", ["event_type"])
    counts.writeStream.outputMode("complete").foreachBatch(lambda batch, n: batch.write.mode("overwrite").parquet(f"{path}/out")).option("checkpointLocation", f"{path}/state").trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(f"{path}/out")


@query("st14_thin_snapshots", oracle("""SELECT entity, tick FROM (SELECT entity, tick, row_number() OVER (PARTITION BY entity, CAST(tick AS DATE) ORDER BY tick DESC) AS k FROM ticks) WHERE k = 1 OR date_diff('day', CAST(tick AS DATE), DATE '2024-03-20') <= 60"""))
def st14(spark, sf_dir):
    t = view(spark, sf_dir, "ticks").select("entity", "tick", F.to_date("tick").alias("day"))
    return ST.thin_snapshots(t, ["entity", "day"], "tick", "day", "2024-03-20").drop("day")


@query("st15_changed_only", oracle("SELECT DISTINCT entity_id FROM results WHERE entity_id IN (SELECT entity_id FROM results WHERE points % 50 = 0)"))
def st15(spark, sf_dir):
    r = view(spark, sf_dir, "results")
    old = r.withColumn("points", F.when(F.col("points") % 50 == 0, F.col("points") + 1).otherwise(F.col("points")))
    none = r.select("entity_id", F.lit("").alias("signature")).distinct()
    return ST.changed_only(r, ST.changed_only(old, none, "entity_id", ["entry_id", "points"]), "entity_id", ["entry_id", "points"]).select("entity_id")


@query("st16_movement_points", oracle(f"""SELECT event_id, CAST(observed_at AS TIMESTAMP) AS observed_at, string_agg(entity_id || '=' || total, ',' ORDER BY total, entity_id) AS points FROM (SELECT *, row_number() OVER (PARTITION BY event_id, observed_at ORDER BY total, entity_id) AS k FROM ({SNAP})) WHERE k <= 5 GROUP BY 1, 2"""))
def st16(spark, sf_dir):
    return ST.movement_points(snapshots(spark, sf_dir), "event_id", "observed_at", "entity_id", "total", 5)
