"""Window operators: ranks, percentiles, running standings, streaks and changes. Every order ends in a unique key."""

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _desc(direction: str) -> bool:
    if direction not in ("higher", "lower"):
        raise ValueError(direction)
    return direction == "higher"


def midrank_percentile(df: DataFrame, by: Sequence[str], value: str, direction: str = "higher", min_cohort: int = 10, eligible: Column | None = None) -> DataFrame:
    """cohort_size and percentile: 100 * (worse + (equal - 1) / 2) / (n - 1), rounded half up, where the cohort is large
    enough. Only eligible rows with a value count; the others keep the size and get no percentile."""
    ok = F.col(value).isNotNull() & (F.lit(True) if eligible is None else F.coalesce(eligible, F.lit(False)))
    df = df.withColumn("_ok", ok).withColumn("_v", F.when(F.col("_ok"), F.col(value)))
    w = Window.partitionBy(*by)
    order = F.col("_v").asc_nulls_last() if _desc(direction) else F.col("_v").desc_nulls_last()
    worse = F.rank().over(w.orderBy(order)) - 1
    equal = F.count("_v").over(Window.partitionBy(*by, "_v"))
    n = F.count("_v").over(w)
    p = F.floor(F.lit(100.0) * (worse + (equal - 1) / 2.0) / (n - 1) + 0.5).cast("long")
    return df.withColumn("cohort_size", n).withColumn("percentile", F.when(F.col("_ok") & (F.col("cohort_size") >= min_cohort), p)).drop("_ok", "_v")


def percentile_simple(df: DataFrame, by: Sequence[str], value: str, direction: str = "higher", min_cohort: int = 2) -> DataFrame:
    """percentile: 100 * (worse + equal / 2) / n, not rounded."""
    w = Window.partitionBy(*by)
    order = F.col(value).asc_nulls_last() if _desc(direction) else F.col(value).desc_nulls_last()
    worse, equal, n = F.rank().over(w.orderBy(order)) - 1, F.count(value).over(Window.partitionBy(*by, value)), F.count(value).over(w)
    return df.withColumn("percentile", F.when(F.col(value).isNotNull() & (n >= min_cohort), F.lit(100.0) * (worse + equal / 2.0) / n))


def competition_rank(df: DataFrame, by: Sequence[str], value: str) -> DataFrame:
    """position (equal values share it, the next ones skip) and tied."""
    w = Window.partitionBy(*by)
    return df.withColumn("position", F.rank().over(w.orderBy(F.col(value).asc_nulls_last())).cast("long")).withColumn("tied", F.count(F.lit(1)).over(Window.partitionBy(*by, value)) > 1)


def apply_playoff(df: DataFrame, winner: DataFrame, event: str, entity: str, position: str = "position") -> DataFrame:
    """The asserted winner stands alone at 1; the other co-leaders share 2. winner: event, entity."""
    w = winner.select(F.col(event), F.col(entity).alias("_winner"))
    df = df.join(w, event, "left")
    lead = (F.col(position) == 1) & F.col("_winner").isNotNull()
    others = F.sum(F.when((F.col(position) == 1) & (F.col(entity) != F.col("_winner")), 1)).over(Window.partitionBy(event))
    place = F.when(lead & (F.col(entity) == F.col("_winner")), 1).when(lead, 2).otherwise(F.col(position)).cast("long")
    tied = F.when(lead & (F.col(entity) == F.col("_winner")), False).when(lead, others > 1).otherwise(F.col("tied"))
    return df.withColumn("tied", tied).withColumn(position, place).drop("_winner")


def last_n_mean(df: DataFrame, entity: str, order: Sequence[str], value: str, n: int = 10) -> DataFrame:
    """A row an entity: the latest n rows that have a value, their number, sum and mean."""
    w = Window.partitionBy(entity).orderBy(*(F.col(c).desc() for c in order))
    held = df.where(F.col(value).isNotNull()).withColumn("_k", F.row_number().over(w)).where(F.col("_k") <= n)
    return held.groupBy(entity).agg(F.count("*").alias("sample"), F.sum(value).alias("total"), (F.sum(value) / F.count("*")).alias("mean"))


def leaders_timeline(scores: DataFrame, event: str = "event_id", entity: str = "entity_id", period: str = "period", score: str = "score") -> DataFrame:
    """event, period, best (lowest total of entities with every period so far) and holders."""
    w = Window.partitionBy(event, entity).orderBy(period).rowsBetween(Window.unboundedPreceding, 0)
    run = scores.withColumn("running", F.sum(score).over(w)).withColumn("_n", F.count("*").over(w)).where(F.col("_n") == F.col(period))
    best = run.withColumn("best", F.min("running").over(Window.partitionBy(event, period)))
    return best.where(F.col("running") == F.col("best")).groupBy(event, period, "best").agg(F.count("*").alias("holders"), F.min(entity).alias("first_holder"))


def standings_after(scores: DataFrame, n: int, event: str = "event_id", entity: str = "entity_id", period: str = "period", score: str = "score") -> DataFrame:
    """total and position after n periods of those who have them all."""
    total = scores.where(F.col(period) <= n).groupBy(event, entity).agg(F.sum(score).alias("total"), F.count("*").alias("_n")).where(F.col("_n") == n).drop("_n")
    return competition_rank(total, [event], "total")


def trend(df: DataFrame, entity: str, order: Sequence[str], value: str, edge: float = 0.4, least: int = 4) -> DataFrame:
    """direction of the mean of the last three against the three before: up, down, level; null with fewer than least."""
    w = Window.partitionBy(entity).orderBy(*(F.col(c).desc() for c in order))
    t = df.where(F.col(value).isNotNull()).withColumn("_k", F.row_number().over(w)).where("_k <= 6").groupBy(entity)
    t = t.agg(F.count("*").alias("n"), F.avg(F.when(F.col("_k") <= 3, F.col(value))).alias("recent"), F.avg(F.when(F.col("_k") > 3, F.col(value))).alias("before"))
    gap = F.col("recent") - F.col("before")
    return t.withColumn("direction", F.when(F.col("n") < least, None).when(gap > edge, "up").when(gap < -edge, "down").otherwise("level"))


def runs(df: DataFrame, by: Sequence[str], order: Sequence[str], holds: Column) -> DataFrame:
    """A row for each unbroken run of rows where the predicate holds: its first place, length and if it is the last."""
    w = Window.partitionBy(*by).orderBy(*order)
    df = df.withColumn("_k", F.row_number().over(w)).withColumn("_holds", F.coalesce(holds, F.lit(False))).withColumn("_last", F.count("*").over(Window.partitionBy(*by)))
    df = df.withColumn("_group", F.col("_k") - F.sum(F.col("_holds").cast("int")).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return df.where("_holds").groupBy(*by, "_group", "_last").agg(F.min("_k").cast("long").alias("first"), F.count("*").alias("length"), (F.max("_k") == F.first("_last")).alias("trailing")).drop("_group", "_last")


def difficulty_rank(df: DataFrame, by: Sequence[str], value: str, sample: str, min_n: int = 10) -> DataFrame:
    """rank from the highest value, rounded to three decimals first, of rows with a large enough sample; and tied."""
    held = df.where(F.col(sample) >= min_n).withColumn("_r", F.floor(F.col(value) * 1000 + 0.5))
    return held.withColumn("rank", F.rank().over(Window.partitionBy(*by).orderBy(F.col("_r").desc())).cast("long")).withColumn("tied", F.count("*").over(Window.partitionBy(*by, "_r")) > 1).drop("_r")


def movement(df: DataFrame, by: Sequence[str], ts: str, value: str) -> DataFrame:
    """The latest row of each, with the value before it and the change."""
    w = Window.partitionBy(*by).orderBy(F.col(ts))
    df = df.withColumn("previous", F.lag(value).over(w)).withColumn("_k", F.row_number().over(Window.partitionBy(*by).orderBy(F.col(ts).desc())))
    return df.where("_k = 1").drop("_k").withColumn("change", F.col(value) - F.col("previous"))


def biggest_mover(df: DataFrame, by: Sequence[str], ts: str, value: str, least: int = 3) -> DataFrame:
    """First and last value of each with at least so many rows, and the change between them."""
    held = df.groupBy(*by).agg(F.count("*").alias("n"), F.min_by(value, ts).alias("first"), F.max_by(value, ts).alias("last")).where(F.col("n") >= least)
    return held.withColumn("change", F.col("last") - F.col("first"))


def climbers(scores: DataFrame, n: int, event: str = "event_id", entity: str = "entity_id", top: int = 10, least: int = 8, k: int = 3) -> DataFrame:
    """The k of each event that rose most between the standings after n - 1 and n periods: into the top, or by least places."""
    now = standings_after(scores, n, event, entity).select(event, entity, F.col("position").alias("now"))
    before = standings_after(scores, n - 1, event, entity).select(event, entity, F.col("position").alias("before"))
    moved = now.join(before, [event, entity]).withColumn("gain", F.col("before") - F.col("now")).where(((F.col("now") <= top) & (F.col("before") > top)) | (F.col("gain") >= least)).where("gain > 0")
    return moved.withColumn("_k", F.row_number().over(Window.partitionBy(event).orderBy(F.col("gain").desc(), F.col(entity)))).where(F.col("_k") <= k).drop("_k")


def latest_per(df: DataFrame, by: Sequence[str], order: Sequence[str]) -> DataFrame:
    """One row of each: the last one in the order."""
    return df.withColumn("_k", F.row_number().over(Window.partitionBy(*by).orderBy(*(F.col(c).desc_nulls_last() for c in order)))).where("_k = 1").drop("_k")


def current_and_history(df: DataFrame, by: Sequence[str], start: str, value: str) -> DataFrame:
    """The current value of dated assignments and the array of earlier ones, latest first."""
    held = df.groupBy(*by).agg(F.reverse(F.array_sort(F.collect_list(F.struct(start, value)))).alias("_all"))
    return held.select(*by, F.element_at("_all", 1)[value].alias("current"), F.transform(F.slice("_all", F.lit(2), F.greatest(F.size("_all") - 1, F.lit(0))), lambda x: x[value]).alias("history"))


def version_changes(df: DataFrame, by: Sequence[str], version: str, slots: Sequence[str]) -> DataFrame:
    """slot, before and after, where consecutive versions differ in a slot and both are known."""
    w = Window.partitionBy(*by).orderBy(version)
    changes = F.array(*(F.struct(F.lit(s).alias("slot"), F.lag(s).over(w).cast("string").alias("before"), F.col(s).cast("string").alias("after")) for s in slots))
    return df.select(*by, version, changes.alias("_all")).select(*by, version, F.explode("_all").alias("c")).select(*by, version, "c.*").where("before <> after")


def margins(df: DataFrame, by: Sequence[str], total: str, key: str) -> DataFrame:
    """gap of each row to the next worse total, and the margin of the leader to the runner-up."""
    w = Window.partitionBy(*by).orderBy(total, key)
    df = df.withColumn("gap", F.lead(total).over(w) - F.col(total)).withColumn("_k", F.row_number().over(w))
    return df.withColumn("margin", F.when(F.col("_k") == 1, F.col("gap"))).drop("_k")


def wire_to_wire(scores: DataFrame, event: str = "event_id", entity: str = "entity_id", period: str = "period", score: str = "score") -> DataFrame:
    """Entities that stood first, alone or not, after every period that they played, from the first on."""
    w = Window.partitionBy(event, entity).orderBy(period).rowsBetween(Window.unboundedPreceding, 0)
    run = scores.withColumn("running", F.sum(score).over(w)).withColumn("_n", F.count("*").over(w)).where(F.col("_n") == F.col(period))
    run = run.withColumn("_first", F.rank().over(Window.partitionBy(event, period).orderBy("running")) == 1).withColumn("_end", F.max(period).over(Window.partitionBy(event)))
    return run.groupBy(event, entity).agg(F.every("_first").alias("led"), F.count("*").alias("periods"), F.max("_end").alias("_end")).where("led and periods = _end").select(event, entity, "periods")


def comeback(scores: DataFrame, last: int, event: str = "event_id", entity: str = "entity_id", period: str = "period", score: str = "score") -> DataFrame:
    """Per winner after the last period: how far and behind how many they stood before it, and their rank in it."""
    before = standings_after(scores, last - 1, event, entity)
    before = before.withColumn("deficit", F.col("total") - F.min("total").over(Window.partitionBy(event))).select(event, entity, "deficit", (F.col("position") - 1).alias("ahead"))
    final = scores.where(F.col(period) == last).withColumn("period_rank", F.rank().over(Window.partitionBy(event).orderBy(score)).cast("long")).select(event, entity, "period_rank")
    return standings_after(scores, last, event, entity).where("position = 1").select(event, entity).join(before, [event, entity]).join(final, [event, entity])


def minmax(df: DataFrame, by: Sequence[str], value: str, least: int = 9) -> DataFrame:
    """value scaled to 0 .. 1 in its group; equal values give 0.5, a small group none."""
    w = Window.partitionBy(*by)
    lo, hi, n = F.min(value).over(w), F.max(value).over(w), F.count(value).over(w)
    return df.withColumn("scaled", F.when(n < least, None).when(hi == lo, F.lit(0.5)).otherwise((F.col(value) - lo) / (hi - lo)))


def step_gaps(df: DataFrame, by: Sequence[str], order: str, threshold: float) -> DataFrame:
    """gap to the next row in seconds, and if it is long."""
    gap = F.unix_timestamp(F.lead(order).over(Window.partitionBy(*by).orderBy(order))) - F.unix_timestamp(F.col(order))
    return df.withColumn("gap", gap).withColumn("long_gap", F.coalesce(F.col("gap") > threshold, F.lit(False)))


def status_since(df: DataFrame, by: Sequence[str], ts: str, status: str) -> DataFrame:
    """The last row of each with the first time of its status without interruption."""
    w = Window.partitionBy(*by).orderBy(ts)
    changed = F.coalesce((~F.col(status).eqNullSafe(F.lag(status).over(w))).cast("int"), F.lit(1))
    df = df.withColumn("_c", changed).withColumn("_run", F.sum("_c").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    df = df.withColumn("since", F.min(ts).over(Window.partitionBy(*by, "_run")))
    return latest_per(df, by, [ts]).drop("_c", "_run")


def narrative_signals(scores: DataFrame, surge: float = 3.0, spread: int = 3, event: str = "event_id", entity: str = "entity_id", period: str = "period", score: str = "score") -> DataFrame:
    """improvement of the last period over the mean of the earlier ones, spread, and flags surge and consistent."""
    end = F.max(period).over(Window.partitionBy(event, entity))
    t = scores.withColumn("_end", end).groupBy(event, entity).agg(F.count("*").alias("n"), F.sum(F.when(F.col(period) < F.col("_end"), F.col(score))).alias("_s"), F.max(F.when(F.col(period) == F.col("_end"), F.col(score))).alias("last"), (F.max(score) - F.min(score)).alias("spread"))
    t = t.where("n > 1").withColumn("improvement", F.col("_s") / (F.col("n") - 1) - F.col("last")).drop("_s")
    return t.withColumn("surge", F.col("improvement") >= surge).withColumn("consistent", F.col("spread") <= spread)


def within_k(df: DataFrame, by: Sequence[str], total: str, k: float) -> DataFrame:
    """Rows at most k behind the leader, and how many there are."""
    held = df.withColumn("behind", F.col(total) - F.min(total).over(Window.partitionBy(*by))).where(F.col("behind") <= k)
    return held.withColumn("within", F.count("*").over(Window.partitionBy(*by)))


def streak_until(df: DataFrame, by: Sequence[str], latest_first: Sequence[Column], counts: Column, stops: Column) -> DataFrame:
    """streak: rows that count, from the latest back to the first that stops; other rows neither count nor stop."""
    w = Window.partitionBy(*by).orderBy(*latest_first).rowsBetween(Window.unboundedPreceding, 0)
    df = df.withColumn("_stopped", F.max(F.coalesce(stops, F.lit(False)).cast("int")).over(w))
    return df.groupBy(*by).agg(F.count_if((F.col("_stopped") == 0) & F.coalesce(counts, F.lit(False))).alias("streak"))
