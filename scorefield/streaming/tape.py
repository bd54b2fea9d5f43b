"""Snapshots over windows: the batch twins of the stateful operators in stateful.py, and what needs no state.

Snapshots have: event_id, entity_id, observed_at, period, status, position, total, thru, and where there are cards items (an
array of item, strokes, par) and row_observed_at (when the row itself was read, null for with its snapshot).
"""

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .stateful import (
    FAR, FULL, NEAR, STOPPED, bounded_tape, carry_forward_stream, change_only_stream, decayed_state, delta_tape, drop_late_stream, lead_changes, pulse_stream, snapshot_columns, time_since_change_stream,
)

__all__ = ["bounded_tape", "carry_forward_stream", "change_only_stream", "decayed_state", "delta_tape", "drop_late_stream", "lead_changes", "pulse_stream", "time_since_change_stream"]


def normalise_snapshot(df: DataFrame) -> DataFrame:
    """total only where every played period has one: scores is an array of the periods' values, null for a missing one."""
    known = (F.size("scores") > 0) & ~F.exists("scores", lambda x: x.isNull())
    return df.withColumn("total", F.when(known, F.aggregate("scores", F.lit(0).cast("long"), lambda a, x: a + x.cast("long"))))


def delta_tape_batch(df: DataFrame) -> DataFrame:
    """Events between consecutive snapshots of an entity in one period: status (nothing else then), and of those not known to be inactive item (an
    item that the older card does not hold: item/strokes against par/total so far, which is known if old total and new items
    make the new total), finish, top5 or top10, and move of at least 5 places inside 25 where no item is new. The last two only for rows
    that were read with their snapshot. Nothing across periods. Of snapshots of one time the least counts, by period, status,
    position, total and thru, nulls first, whatever the order of rows."""
    w = Window.partitionBy("event_id", "entity_id").orderBy("observed_at")
    cols = ["observed_at", "period", "status", "position", "total", "thru", "items", "row_observed_at"]
    one = snapshot_columns(df).groupBy("event_id", "entity_id", "observed_at").agg(F.min(F.struct(*cols[1:])).alias("_one")).select("event_id", "entity_id", "observed_at", "_one.*")
    d = one.withColumns({f"q_{c}": F.lag(c).over(w) for c in cols[:-1]})
    same = F.col("q_observed_at").isNotNull() & (F.col("q_period") == F.col("period"))
    stop = F.coalesce(same & (F.col("q_status") == "active") & F.col("status").isin(*STOPPED), F.lit(False))
    on = F.coalesce(same & (F.coalesce("status", F.lit("active")) == "active"), F.lit(False))
    event = lambda c, kind, detail: F.when(c, F.struct(F.lit(kind).alias("kind"), detail.cast("string").alias("detail")))
    p, q = F.col("position"), F.col("q_position")
    had = F.coalesce(F.transform("q_items", lambda x: x["item"]), F.array())
    against = F.filter(F.transform("items", lambda x: F.struct(x["item"].alias("item"), (x["strokes"] - x["par"]).alias("d"))), lambda x: x["d"].isNotNull() & x["item"].isNotNull())
    d = d.withColumn("_fresh", F.when(on, F.filter(against, lambda x: ~F.array_contains(had, x["item"]))))
    d = d.withColumn("_fresh", F.coalesce("_fresh", F.array().cast("array<struct<item:int,d:int>>")))
    total = lambda xs: F.aggregate(xs, F.lit(0).cast("long"), lambda s, x: s + x["d"])
    known = F.col("q_total") + total(F.col("_fresh")) == F.col("total")
    run = lambda i: F.when(known, (F.col("q_total") + total(F.slice("_fresh", 1, i + 1))).cast("string")).otherwise("")
    items = F.transform("_fresh", lambda x, i: F.struct(F.lit("item").alias("kind"), F.concat_ws("/", x["item"].cast("string"), x["d"].cast("string"), run(i)).alias("detail")))
    again = on & (F.col("row_observed_at").isNull() | (F.col("row_observed_at") == F.col("observed_at")))
    top = lambda k: again & (p != 1) & (p <= k) & (q > k)
    crossed = F.coalesce(top(NEAR[0]) | top(NEAR[1]), F.lit(False))
    events = F.array_compact(F.array(
        event(stop, "status", F.col("status")),
        event(on & (F.col("q_thru") < FULL) & (F.col("thru") == FULL), "finish", F.coalesce(F.col("total").cast("string"), F.lit(""))),
        F.when(top(NEAR[0]), F.struct(F.lit("top5").alias("kind"), p.cast("string").alias("detail"))).when(top(NEAR[1]), F.struct(F.lit("top10").alias("kind"), p.cast("string").alias("detail"))),
        event(again & ~crossed & (F.size("_fresh") == 0) & (p != 1) & (F.abs(p - q) >= FAR[0]) & (p <= FAR[1]), "move", q - p),
    ))
    return d.select("event_id", "entity_id", "observed_at", F.inline(F.concat(items, events)))


def lead_changes_batch(df: DataFrame) -> DataFrame:
    """Where the set of active holders of position 1 changed and is not empty: lead (one) or tie (several) with the holders, if
    any has a total; and lost_lead with each former holder that is still active."""
    active = F.col("status") == "active"
    first = active & (F.col("position") == 1)
    held = df.groupBy("event_id", "observed_at").agg(F.array_sort(F.collect_set(F.when(first, F.col("entity_id")))).alias("holders"), F.coalesce(F.max(first & F.col("total").isNotNull()), F.lit(False)).alias("_known"))
    w = Window.partitionBy("event_id").orderBy("observed_at")
    changed = held.withColumn("_before", F.lag("holders").over(w)).where("_before is not null and size(holders) > 0 and _before <> holders")
    leads = changed.where("_known").select("event_id", "observed_at", F.when(F.size("holders") == 1, "lead").otherwise("tie").alias("kind"), F.array_join(F.transform("holders", lambda x: x.cast("string")), ",").alias("holders"))
    left = changed.select("event_id", "observed_at", F.explode(F.array_except("_before", "holders")).alias("entity_id"))
    lost = left.join(df.where(active).select("event_id", "observed_at", "entity_id").distinct(), ["event_id", "observed_at", "entity_id"], "left_semi")
    return leads.unionByName(lost.select("event_id", "observed_at", F.lit("lost_lead").alias("kind"), F.col("entity_id").cast("string").alias("holders")))


def change_only(df: DataFrame, by: Sequence[str], ts: str, signature: Sequence[str]) -> DataFrame:
    """Rows whose signature differs from that of the row before."""
    h = F.sha2(F.to_json(F.struct(*signature), {"ignoreNullFields": "false"}), 256)
    return df.withColumn("_h", h).withColumn("_q", F.lag("_h").over(Window.partitionBy(*by).orderBy(ts))).where("_q is null or _q <> _h").drop("_h", "_q")


def append_snapshots(batch: DataFrame, seen: DataFrame, by: Sequence[str], ts: str, signature: Sequence[str], cap: int = 600) -> DataFrame:
    """The rows to append to seen: changed ones only, the first so many of each that the cap leaves."""
    both = seen.select(*batch.columns, F.lit(True).alias("_old")).unionByName(batch.withColumn("_old", F.lit(False)))
    kept = change_only(both, by, ts, signature).withColumn("_k", F.row_number().over(Window.partitionBy(*by).orderBy(ts)))
    return kept.where(~F.col("_old") & (F.col("_k") <= cap)).drop("_old", "_k")


def carry_forward(df: DataFrame, by: Sequence[str], ts: str, cols: Sequence[str]) -> DataFrame:
    """Rows that were not observed again keep their last values, with the time of that observation."""
    w = Window.partitionBy(*by).orderBy(ts).rowsBetween(Window.unboundedPreceding, 0)
    seen = F.when(F.coalesce(*(F.col(c).cast("string") for c in cols)).isNotNull(), F.struct(F.col(ts).alias("_at"), *cols))
    d = df.withColumn("_s", F.last(seen, ignorenulls=True).over(w))
    return d.withColumns({c: F.col("_s")[c] for c in cols}).withColumn("row_observed_at", F.col("_s._at")).drop("_s")


def time_since_change(df: DataFrame, by: Sequence[str], ts: str, col: str) -> DataFrame:
    """changed_at: the first time of the current value without interruption, and seconds since then."""
    w = Window.partitionBy(*by).orderBy(ts)
    d = df.withColumn("_new", F.when(F.row_number().over(w) == 1, 1).otherwise((~F.col(col).eqNullSafe(F.lag(col).over(w))).cast("int")))
    d = d.withColumn("changed_at", F.max(F.when(F.col("_new") == 1, F.col(ts))).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return d.withColumn("seconds", F.unix_timestamp(ts) - F.unix_timestamp("changed_at")).drop("_new")


def thin_snapshots(df: DataFrame, by: Sequence[str], ts: str, ended: str, now, keep_days: int = 60) -> DataFrame:
    """All rows of recent events; of those that ended longer ago the last row of each."""
    old = F.datediff(F.lit(now).cast("date"), F.col(ended)) > keep_days
    k = F.row_number().over(Window.partitionBy(*by).orderBy(F.col(ts).desc()))
    return df.withColumn("_k", k).where(~F.coalesce(old, F.lit(False)) | (F.col("_k") == 1)).drop("_k")


def changed_only(df: DataFrame, signatures: DataFrame, key: str, cols: Sequence[str]) -> DataFrame:
    """Keys whose signature (a hash over all their rows, whatever their order) differs from the stored one (key, signature)."""
    row = F.xxhash64(*cols)
    now = df.groupBy(key).agg(F.concat_ws(":", F.count("*").cast("string"), F.sum(row.cast("decimal(38,0)")).cast("string")).alias("signature"))
    return now.join(signatures.select(key, F.col("signature").alias("_s")), key, "left").where(~F.col("signature").eqNullSafe(F.col("_s"))).drop("_s")


def movement_points(df: DataFrame, event: str, ts: str, entity: str, value: str, k: int = 40) -> DataFrame:
    """Per tick the k lowest and their values, as text."""
    w = Window.partitionBy(event, ts).orderBy(value, entity)
    return df.withColumn("_k", F.row_number().over(w)).where(F.col("_k") <= k).groupBy(event, ts).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("_k", entity, value))), lambda x: F.concat_ws("=", x[entity].cast("string"), x[value].cast("string"))), ",").alias("points"))


def with_freshness(df: DataFrame, ts: str, now, limits: tuple[int, int, int] = (5, 20, 60), watermark: bool = False) -> DataFrame:
    """age in minutes and freshness: live, fresh, stale or old. On streams the last limit is the watermark too."""
    if watermark:
        df = df.withWatermark(ts, f"{limits[2]} minutes")
    age = (F.unix_timestamp(F.lit(now).cast("timestamp")) - F.unix_timestamp(ts)) / 60
    return df.withColumn("freshness", F.when(age <= limits[0], "live").when(age <= limits[1], "fresh").when(age <= limits[2], "stale").otherwise("old"))


def tape_append(stream: DataFrame, keys: Sequence[str], ts: str, delay: str = "1 hour") -> DataFrame:
    """Each event once: repeats inside the watermark are dropped."""
    return stream.withWatermark(ts, delay).dropDuplicatesWithinWatermark(list(keys))


def pulse(ticks: DataFrame, watch: DataFrame, entity: str, ts: str, position: str, top: int = 10) -> DataFrame:
    """Watched entities that came into the top since their observation before."""
    w = Window.partitionBy(entity).orderBy(ts)
    return ticks.join(watch.select(entity), entity, "left_semi").withColumn("_q", F.lag(position).over(w)).where((F.col(position) <= top) & (F.col("_q") > top)).drop("_q")


def replay(source: DataFrame, write, checkpoint: str) -> None:
    """Runs a stream over all that is there and stops; with the same checkpoint, again only over what is new. write takes a
    batch and its number."""
    source.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def drop_late(df: DataFrame, by: Sequence[str], ts: str, arrival: str) -> DataFrame:
    """Rows that are newer than all that arrived before them."""
    w = Window.partitionBy(*by).orderBy(arrival).rowsBetween(Window.unboundedPreceding, -1)
    return df.withColumn("_seen", F.max(ts).over(w)).where(F.col("_seen").isNull() | (F.col(ts) > F.col("_seen"))).drop("_seen")


def keep_newest(df: DataFrame, by: Sequence[str], keys: Sequence[str], ts: str, cap: int) -> DataFrame:
    """The newest cap rows of each key, each identity (keys) once, with its oldest row."""
    once = df.withColumn("_k", F.row_number().over(Window.partitionBy(*by, *keys).orderBy(ts))).where("_k = 1")
    return once.withColumn("_k", F.row_number().over(Window.partitionBy(*by).orderBy(F.col(ts).desc(), *(F.col(k).desc() for k in keys)))).where(F.col("_k") <= cap).drop("_k")
