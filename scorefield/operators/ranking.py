"""Orders, limits and top-k. A global order with a limit is a distributed top-k; per group it is a window with a limit."""

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def board_order(df: DataFrame, bucket: Mapping[str, int], status: str, position: str, total: str, name: str) -> list[Column]:
    """Sort keys of a board: status bucket, position with nulls last, total, name."""
    pairs = [F.lit(x) for kv in bucket.items() for x in kv]
    return [F.coalesce(F.try_element_at(F.create_map(*pairs), F.col(status)), F.lit(99)), F.col(position).asc_nulls_last(), F.col(total).asc_nulls_last(), F.col(name).asc()]


def top_k(df: DataFrame, order: Sequence[Column], k: int) -> DataFrame:
    return df.orderBy(*order).limit(k)


def keep_first(df: DataFrame, by: Sequence[str], order: Sequence[Column], k: int, out: str | None = None) -> DataFrame:
    """The k first rows of each group, with their number if out is given."""
    r = df.withColumn("_k", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where(F.col("_k") <= k)
    return r.withColumn(out, F.col("_k").cast("long")).drop("_k") if out else r.drop("_k")


def directory(df: DataFrame, by: Sequence[str], name: str) -> DataFrame:
    """Rows of each group, the largest first."""
    return df.groupBy(*by).agg(F.count("*").alias("n")).orderBy(F.col("n").desc(), name)


def now_next(df: DataFrame, by: str, state: str, start: str, key: str) -> DataFrame:
    """Per group: those of this week, the next one, the three after it and the last completed, as role."""
    ahead = F.row_number().over(Window.partitionBy(by, state).orderBy(start, key))
    behind = F.row_number().over(Window.partitionBy(by, state).orderBy(F.col(start).desc(), F.col(key).desc()))
    r = df.withColumn("_a", ahead).withColumn("_b", behind)
    role = F.when(F.col(state) == "this_week", "now").when((F.col(state) == "upcoming") & (F.col("_a") == 1), "next").when((F.col(state) == "upcoming") & (F.col("_a") <= 4), "later").when((F.col(state) == "completed") & (F.col("_b") == 1), "last")
    return r.withColumn("role", role).where("role is not null").drop("_a", "_b")


def greedy_select(probs: DataFrame, families: Sequence[tuple[str, int, float]], event: str, entity: str, family: str, p: str) -> DataFrame:
    """Selections without reuse of an entity: for each (family, n, least), in order, the n best of what is left."""
    left, out = probs, None
    for name, n, least in families:
        picked = keep_first(left.where((F.col(family) == name) & (F.col(p) >= least)), [event], [F.col(p).desc(), F.col(entity)], n)
        out = picked if out is None else out.unionByName(picked)
        left = left.join(picked.select(event, entity), [event, entity], "left_anti")
    return out


def neighbour_pairs(df: DataFrame, by: Sequence[str], order: Sequence[Column], entity: str, top: int = 40) -> DataFrame:
    """Neighbours (1, 2), (3, 4) ... of the first rows of each group."""
    r = keep_first(df, by, order, top, "_n").withColumn("_pair", F.floor((F.col("_n") - 1) / 2))
    return r.groupBy(*by, "_pair").agg(F.min_by(entity, "_n").alias("a"), F.max_by(entity, "_n").alias("b"), F.count("*").alias("_c")).where("_c = 2").drop("_c", "_pair")


def pick_series(ticks: DataFrame, by: Sequence[str], ts: str, entity: str, position: str, top: int = 5, most: int = 7) -> DataFrame:
    """Entities in the top of the latest tick, and those that ever led, most at most."""
    last = F.max(ts).over(Window.partitionBy(*by))
    g = ticks.withColumn("_last", last).groupBy(*by, entity).agg(F.min(F.when(F.col(ts) == F.col("_last"), F.col(position))).alias("now"), F.min(position).alias("best"))
    return keep_first(g.where((F.col("now") <= top) | (F.col("best") == 1)), by, [F.col("now").asc_nulls_last(), F.col("best"), F.col(entity)], most)


def best_by_score(df: DataFrame, by: Sequence[str], terms: Mapping[Column, int] | Sequence[tuple[Column, int]], least: int, key: str) -> DataFrame:
    """The row with the highest sum of the terms that hold, if it is at least so much."""
    terms = list(terms.items()) if isinstance(terms, Mapping) else terms
    score = sum((F.when(F.coalesce(c, F.lit(False)), F.lit(w)).otherwise(0) for c, w in terms), F.lit(0))
    return keep_first(df.withColumn("score", score).where(F.col("score") >= least), by, [F.col("score").desc(), F.col(key)], 1)


def extremes(df: DataFrame, by: Sequence[str], value: str, key: str) -> DataFrame:
    """The lowest value of each group, its key, and how many share it."""
    low = F.min(value).over(Window.partitionBy(*by))
    return df.withColumn("_low", low).where(F.col(value) == F.col("_low")).groupBy(*by).agg(F.min(value).alias("low"), F.min(key).alias("key"), F.count("*").alias("shared"))


def tail_since(df: DataFrame, ts: str, since, n: int, key: str) -> DataFrame:
    return df.where(F.col(ts) > F.lit(since).cast("timestamp")).orderBy(F.col(ts).desc(), F.col(key).desc()).limit(n)


def review_queue(df: DataFrame, flags: Mapping[str, Column], key: str) -> DataFrame:
    """flags that hold, for rows with any, those with most first."""
    held = F.array_compact(F.array(*(F.when(c, F.lit(n)) for n, c in flags.items())))
    return df.withColumn("flags", held).where(F.size("flags") > 0).orderBy(F.size("flags").desc(), key)


def diverse_top_k(df: DataFrame, by: Sequence[str], purpose: str, order: Sequence[Column], key: str, k: int = 3) -> DataFrame:
    """The best of each purpose first, then the rest by order, k of each group."""
    first = F.row_number().over(Window.partitionBy(*by, purpose).orderBy(*order, key)) == 1
    return keep_first(df.withColumn("_first", first), by, [F.col("_first").desc(), *order, F.col(key)], k).drop("_first")


def dimension_picks(metrics: DataFrame, by: str, metric: str, tier: str, sample: str, percentile: str) -> DataFrame:
    """Per entity the best metric (by percentile), the most reliable one (tier, then sample, then percentile), and strengths
    (at least 75 in a tier of MEDIUM or better)."""
    level = F.when(F.col(tier) == "HIGH", 3).when(F.col(tier) == "MEDIUM", 2).when(F.col(tier) == "LIMITED", 1).otherwise(0)
    m = metrics.where(F.col(percentile).isNotNull()).withColumn("_t", level)
    strong = (F.col(percentile) >= 75) & (F.col("_t") >= 2)
    return m.groupBy(by).agg(F.max(F.struct(percentile, metric))[metric].alias("best"), F.max(F.struct("_t", sample, percentile, metric))[metric].alias("reliable"), F.array_join(F.array_sort(F.collect_list(F.when(strong, F.col(metric)))), ",").alias("strengths"))


def group_directory(events: DataFrame, by: str, start: str, end: str, key: str, today, k: int = 8) -> DataFrame:
    """Per group the first event to come and the last one over; groups in progress first, then by the next start, the latest
    end, and name."""
    t = F.lit(today).cast("date")
    ahead, over, on = F.col(start) > t, F.col(end) < t, (F.col(start) <= t) & (F.col(end) >= t)
    g = events.groupBy(by).agg(F.min_by(key, F.when(ahead, F.struct(start, key))).alias("next"), F.max_by(key, F.when(over, F.struct(end, key))).alias("last"), F.count_if(on).alias("in_progress"), F.min(F.when(ahead, F.col(start))).alias("next_start"), F.max(F.when(over, F.col(end))).alias("last_end"))
    return g.orderBy((F.col("in_progress") > 0).desc(), F.col("next_start").asc_nulls_last(), F.col("last_end").desc_nulls_last(), by).limit(k)
