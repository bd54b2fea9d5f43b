"""Aggregates. Means are sums divided last, so that results do not depend on the order of rows."""

from collections.abc import Callable, Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import round_half_up
from ..session import written


def field_stats(scores: DataFrame, by: Sequence[str], value: str, min_n: int = 20) -> DataFrame:
    """n, mean and sample deviation of each field with at least min_n rows."""
    s = scores.groupBy(*by).agg(F.count(value).alias("n"), F.sum(value).alias("_s"), F.sum(F.col(value) * F.col(value)).alias("_q")).where(F.col("n") >= min_n)
    return s.select(*by, "n", (F.col("_s") / F.col("n")).alias("mean"), F.sqrt((F.col("_q") - F.col("_s") * F.col("_s") / F.col("n")) / (F.col("n") - 1)).alias("sd"))


def field_relative(scores: DataFrame, by: Sequence[str], value: str, min_n: int = 20) -> DataFrame:
    """delta: the field's mean minus the value; null where the field is too small."""
    n, s = F.count(value).over(Window.partitionBy(*by)), F.sum(value).over(Window.partitionBy(*by))
    return scores.withColumn("delta", F.when(n >= min_n, s / n - F.col(value)))


def entity_metrics(entries: DataFrame, entity: str, total: str, position: str, status: str) -> DataFrame:
    """Long rows metric, value, sample of the metrics of starts: scoring, consistency, cuts, top10, contention."""
    g = entries.groupBy(entity).agg(
        F.count("*").alias("n"), F.sum(total).alias("s"), F.sum(F.col(total) * F.col(total)).alias("q"), F.count_if(F.col(status) == "finished").alias("made"), F.count_if(F.col(position) <= 10).alias("ten"), F.count_if(F.col(position) <= 5).alias("five")
    )
    share = lambda c: round_half_up(F.col(c) * 100.0 / F.col("n"), 1)
    sd = F.when(F.col("n") > 1, round_half_up(F.sqrt((F.col("q") - F.col("s") * F.col("s") / F.col("n")) / (F.col("n") - 1)), 2))
    wide = g.select(entity, "n", round_half_up(F.col("s") / F.col("n"), 2).alias("scoring"), sd.alias("consistency"), share("made").alias("cuts"), share("ten").alias("top10"), share("five").alias("contention"))
    return wide.unpivot([entity, "n"], ["scoring", "consistency", "cuts", "top10", "contention"], "metric", "value").withColumnRenamed("n", "sample")


def metrics_by_window(scores: DataFrame, on: str, entity: str, value: str, as_of, windows: dict[str, int | None]) -> DataFrame:
    """sample and mean of each entity in each trailing window of days that ends at as_of; None is all time."""
    flags = [F.when(F.lit(True) if days is None else F.col(on) >= F.date_sub(F.lit(as_of).cast("date"), days), F.lit(name)) for name, days in windows.items()]
    held = scores.where(F.col(on) <= F.lit(as_of).cast("date")).withColumn("window", F.explode(F.array_compact(F.array(*flags))))
    return held.groupBy(entity, "window").agg(F.count(value).alias("sample"), (F.sum(value) / F.count(value)).alias("mean"))


def finish_distribution(entries: DataFrame, by: Sequence[str], position: str, status: str) -> DataFrame:
    p, s = F.col(position), F.col(status)
    top = {"wins": 1, "top5": 5, "top10": 10, "top25": 25}
    return entries.groupBy(*by).agg(F.count("*").alias("starts"), *(F.count_if(p <= n).alias(c) for c, n in top.items()), F.count_if(s == "finished").alias("made"), F.count_if(s == "cut").alias("missed"), F.count_if(s.isin("withdrawn", "disqualified")).alias("wd_dq"), F.count_if(s.isNull() | ~s.isin("finished", "cut", "withdrawn", "disqualified")).alias("unknown"))


def exclusive_buckets(dist: DataFrame) -> DataFrame:
    """Buckets from cumulative counts; all null unless none is negative and they sum to starts."""
    parts = {"b_win": F.col("wins"), "b_2_5": F.col("top5") - F.col("wins"), "b_6_10": F.col("top10") - F.col("top5"), "b_11_25": F.col("top25") - F.col("top10"), "b_26": F.col("made") - F.col("top25"), "b_missed": F.col("missed"), "b_wd_dq": F.col("wd_dq"), "b_unknown": F.col("unknown")}
    good = (F.least(*parts.values()) >= 0) & (sum(parts.values(), F.lit(0)) == F.col("starts"))
    return dist.withColumns({c: F.when(good, v) for c, v in parts.items()})


def season_rollup(entries: DataFrame, entity: str, season: str, value: str, status: str, won: str) -> DataFrame:
    return entries.groupBy(entity, season).agg(F.count("*").alias("starts"), F.count_if(F.col(status) == won).alias("won"), F.sum(value).alias("total"), F.max(value).alias("best"))


def venue_profile(entries: DataFrame, venue: str, event: str, total: str, position: str, status: str) -> DataFrame:
    """Means over a venue's events of the event's mean, deviation, winning total and cut share."""
    e = entries.groupBy(venue, event).agg(F.count("*").alias("n"), F.sum(total).alias("s"), F.sum(F.col(total) * F.col(total)).alias("q"), F.min(F.when(F.col(position) == 1, F.col(total))).alias("win"), F.count_if(F.col(status) == "cut").alias("cut"))
    sd = F.when(F.col("n") > 1, F.sqrt((F.col("q") - F.col("s") * F.col("s") / F.col("n")) / (F.col("n") - 1)))
    return e.groupBy(venue).agg(F.count("*").alias("events"), F.avg(F.col("s") / F.col("n")).alias("difficulty"), F.avg(sd).alias("spread"), F.avg("win").alias("winning"), F.avg(F.col("cut") / F.col("n")).alias("cut_share"))


def venue_history(entries: DataFrame, entity: str, venue: str, event: str, position: str, status: str, before: Column | None = None) -> DataFrame:
    """What an entity has done at a venue, before an event where one is given."""
    held = entries if before is None else entries.where(before)
    made = F.col(status) == "finished"
    return held.groupBy(entity, venue).agg(F.count("*").alias("starts"), F.count_if(made).alias("cuts"), F.count_if(F.col(position) == 1).alias("wins"), F.count_if(F.col(position) <= 10).alias("top10"), F.min(position).alias("best"), (F.sum(F.when(made, F.col(position))) / F.nullif(F.count_if(made), F.lit(0))).alias("mean_finish"))


def venue_fit(history: DataFrame, profile: DataFrame, entity: str, venue: str, edge: float) -> DataFrame:
    """Mean finish at hard and at easier venues, by a threshold of difficulty; no composite."""
    h = history.join(profile.select(venue, "difficulty"), venue)
    hard = F.col("difficulty") >= edge
    return h.groupBy(entity).agg(F.count_if(hard).alias("hard_venues"), F.count_if(~hard).alias("easy_venues"), F.avg(F.when(hard, F.col("mean_finish"))).alias("hard_finish"), F.avg(F.when(~hard, F.col("mean_finish"))).alias("easy_finish"), F.lit(None).cast("double").alias("composite"))


def profile(df: DataFrame, by: Sequence[str], value: str) -> DataFrame:
    """sample, mean, best of a value by any keys (periods, series)."""
    return df.groupBy(*by).agg(F.count(value).alias("sample"), (F.sum(value) / F.count(value)).alias("mean"), F.min(value).alias("best"))


def series_profile(entries: DataFrame, by: Sequence[str], order: str, position: str, k: int = 5) -> DataFrame:
    """appearances, wins, best and the positions of the latest k."""
    held = entries.groupBy(*by).agg(F.count("*").alias("appearances"), F.count_if(F.col(position) == 1).alias("wins"), F.min(position).alias("best"), F.reverse(F.array_sort(F.collect_list(F.struct(order, position)))).alias("_all"))
    return held.withColumn("latest", F.array_join(F.transform(F.slice("_all", 1, k), lambda x: x[position].cast("string")), ",")).drop("_all")


def item_class_scoring(items: DataFrame, field: Sequence[str], entity: str, item_class: str, value: str, min_n: int = 20) -> DataFrame:
    """Mean delta of an entity by class of item, from fields of at least min_n."""
    return field_relative(items, field, value, min_n).where("delta is not null").groupBy(entity, item_class).agg(F.count("*").alias("sample"), F.avg("delta").alias("mean_delta"))


def item_difficulty(items: DataFrame, by: Sequence[str], value: str, min_n: int = 30) -> DataFrame:
    return items.groupBy(*by).agg(F.count(value).alias("n"), (F.sum(value) / F.count(value)).alias("difficulty")).where(F.col("n") >= min_n)


def item_stats(items: DataFrame, by: Sequence[str], diff: str, min_n: int = 10) -> DataFrame:
    """Counts and shares of five buckets of a difference, which sum to the sample; the mean only if all are known."""
    d = F.col(diff)
    buckets = {"eagle": d <= -2, "under": d == -1, "level": d == 0, "over": d == 1, "double": d >= 2}
    s = items.groupBy(*by).agg(F.count("*").alias("n"), F.count(diff).alias("known"), F.sum(diff).alias("_s"), *(F.count_if(v).alias(c) for c, v in buckets.items())).where(F.col("n") >= min_n)
    return s.withColumns({f"{c}_pct": round_half_up(F.col(c) * 100.0 / F.col("n"), 1) for c in buckets}).withColumn("mean", F.when(F.col("known") == F.col("n"), F.col("_s") / F.col("n"))).drop("_s")


def scoring_cohort(df: DataFrame, by: Sequence[str], entity: str, small: int = 20) -> DataFrame:
    return df.groupBy(*by).agg(F.count_distinct(entity).alias("entities")).withColumn("cohort", F.when(F.col("entities") <= small, "contender sample").otherwise("observed field"))


def coverage_report(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """A row a column: rows, known values and their share."""
    one = df.agg(F.count("*").alias("n"), *(F.count(c).alias(c) for c in columns))
    return one.unpivot(["n"], list(columns), "field", "known").withColumn("share", F.col("known") / F.nullif("n", F.lit(0)))


def track_record(graded: DataFrame, family: str, tour: str, grade: str, p: str) -> DataFrame:
    """Selections, grades, hit rate, expected wins and Brier score by family, and by tour and family."""
    sets = graded.groupingSets([[F.col(family)], [F.col(tour), F.col(family)]], F.col(family), F.col(tour))
    won, lost = F.count_if(F.col(grade) == "WIN"), F.count_if(F.col(grade) == "LOSS")
    settled = F.col(grade).isin("WIN", "LOSS")
    error = F.pow((F.col(grade) == "WIN").cast("double") - F.col(p), 2)
    return sets.agg(F.count("*").alias("selections"), won.alias("won"), lost.alias("lost"), F.count_if(F.col(grade) == "VOID").alias("void"), round_half_up(won / F.nullif(won + lost, F.lit(0)), 3).alias("hit_rate"), round_half_up(F.sum(F.when(settled, F.col(p))), 1).alias("expected"), round_half_up(F.avg(F.when(settled, error)), 4).alias("brier"))


def calibration(df: DataFrame, p: str, y: str, by: Sequence[str] = (), bins: int = 10, clip: float = 1e-4) -> DataFrame:
    """n, log loss (clipped), Brier score, expected calibration error over equal bins, base rate and mean probability."""
    q = F.greatest(F.lit(clip), F.least(F.lit(1 - clip), F.col(p)))
    loss = -(F.col(y) * F.log(q) + (1 - F.col(y)) * F.log(1 - q))
    each = df.withColumn("_bin", F.least(F.floor(F.col(p) * bins), F.lit(bins - 1))).groupBy(*by, "_bin").agg(F.count("*").alias("n"), F.sum(loss).alias("loss"), F.sum(F.pow(F.col(p) - F.col(y), 2)).alias("brier"), F.sum(y).alias("hits"), F.sum(p).alias("ps"))
    n = F.sum("n")
    return each.groupBy(*by).agg(n.alias("n"), (F.sum("loss") / n).alias("log_loss"), (F.sum("brier") / n).alias("brier"), (F.sum(F.abs(F.col("hits") - F.col("ps"))) / n).alias("ece"), (F.sum("hits") / n).alias("base_rate"), (F.sum("ps") / n).alias("mean_p"))


def reliability(df: DataFrame, p: str, y: str, bins: int = 10) -> DataFrame:
    return df.groupBy(F.least(F.floor(F.col(p) * bins), F.lit(bins - 1)).alias("bin")).agg(F.count("*").alias("n"), F.avg(p).alias("mean_p"), F.avg(y).alias("rate"))


def stratified(df: DataFrame, strata: Sequence[str], p: str, y: str) -> DataFrame:
    """n, Brier score and base rate over all rows and over each stratum by itself."""
    sets = df.groupingSets([[], *([F.col(s)] for s in strata)], *(F.col(s) for s in strata))
    return sets.agg(F.count("*").alias("n"), F.avg(F.pow(F.col(p) - F.col(y), 2)).alias("brier"), F.avg(y).alias("base_rate"))


def ranking_metrics(df: DataFrame, event: str, entity: str, p: str, y: str, k: int = 10) -> DataFrame:
    """Per event: precision at k, and the winner's rank with ties in the middle: 1 + better + (equal - 1) / 2."""
    w = Window.partitionBy(event)
    r = df.withColumn("_k", F.row_number().over(w.orderBy(F.col(p).desc(), entity))).withColumn("_r", F.rank().over(w.orderBy(F.col(p).desc()))).withColumn("_e", F.count("*").over(Window.partitionBy(event, p)))
    return r.groupBy(event).agg((F.count_if((F.col("_k") <= k) & (F.col(y) == 1)) / F.least(F.count("*"), F.lit(k))).alias("precision_at_k"), F.min(F.when(F.col(y) == 1, F.col("_r") + (F.col("_e") - 1) / 2.0)).alias("winner_rank"))


def demeaned_corr(df: DataFrame, by: Sequence[str], value: str, covariate: str, least: int = 10) -> DataFrame:
    """n and Pearson correlation of a value less its group's mean with a covariate; null for few rows."""
    w = Window.partitionBy(*by)
    d = df.where(F.col(value).isNotNull() & F.col(covariate).isNotNull()).withColumn("_d", F.col(value) - F.sum(value).over(w) / F.count(value).over(w))
    return d.agg(F.count("*").alias("n"), F.corr("_d", covariate).alias("r")).withColumn("r", F.when(F.col("n") >= least, F.col("r")))


def binned_effect(df: DataFrame, covariate: str, value: str, edges: Sequence[float], least: int = 30) -> DataFrame:
    """Per bin between fixed edges: n, mean, deviation and half width of the 95 % interval, suppressed for few rows."""
    bin_ = F.lit(0)
    for e in edges:
        bin_ = bin_ + (F.col(covariate) >= e).cast("int")
    g = df.where(F.col(covariate).isNotNull() & F.col(value).isNotNull()).groupBy(bin_.cast("long").alias("bin")).agg(F.count("*").alias("n"), F.sum(value).alias("_s"), F.sum(F.col(value) * F.col(value)).alias("_q"))
    shown = F.col("n") >= least
    sd = F.sqrt((F.col("_q") - F.col("_s") * F.col("_s") / F.col("n")) / (F.col("n") - 1))
    return g.select("bin", "n", F.when(shown, F.col("_s") / F.col("n")).alias("mean"), F.when(shown, sd).alias("sd"), F.when(shown, F.lit(1.96) * sd / F.sqrt("n")).alias("half_width"))


def cut_applied(entries: DataFrame, event: str, status: str, least: int = 5, share: float = 0.1) -> DataFrame:
    """Events with a real cut: enough rows that missed it, and enough of the field."""
    g = entries.groupBy(event).agg(F.count("*").alias("field"), F.count_if(F.col(status) == "cut").alias("missed"))
    return g.where((F.col("missed") >= least) & (F.col("missed") >= F.col("field") * share))


def cut_line(entries: DataFrame, scores: DataFrame, event: str, entity: str, period: str, score: str, status: str, after: int = 2) -> DataFrame:
    """The worst total after so many periods of those who made it."""
    total = scores.where(F.col(period) <= after).groupBy(event, entity).agg(F.sum(score).alias("_t"), F.count("*").alias("_n")).where(F.col("_n") == after)
    return total.join(entries.where(F.col(status) == "finished").select(event, entity), [event, entity]).groupBy(event).agg(F.max("_t").alias("line"))


def periods_complete(scores: DataFrame, entries: DataFrame, event: str, entity: str, period: str, status: str, share: float = 0.9, field: int = 20, most: int = 5) -> DataFrame:
    """The largest k so that every period up to it is played by enough of those eligible: all but withdrawn and
    disqualified, and up to period two those who missed the cut."""
    e = entries.where(~F.col(status).isin("withdrawn", "disqualified")).select(event, entity, (F.col(status) == "cut").alias("_cut"))
    size = e.groupBy(event).agg(F.count("*").alias("_all"), F.count_if(~F.col("_cut")).alias("_in")).withColumn("k", F.explode(F.sequence(F.lit(1), F.lit(most))))
    had = scores.where(F.col(period) <= most).select(event, entity, F.col(period).alias("k")).distinct().join(e, [event, entity]).where((F.col("k") <= 2) | ~F.col("_cut")).groupBy(event, "k").agg(F.count("*").alias("_had"))
    ok = F.coalesce("_had", F.lit(0)) >= F.when(F.col("k") <= 2, F.col("_all")).otherwise(F.greatest("_in", F.lit(1))) * share
    t = size.join(had, [event, "k"], "left").where(F.col("_all") >= field).groupBy(event).agg(F.min(F.when(~ok, F.col("k"))).alias("_stop"))
    return t.select(event, (F.coalesce("_stop", F.lit(most + 1)) - 1).cast("long").alias("complete"))


def period_stats(scores: DataFrame, by: Sequence[str], entity: str, value: str, under: float) -> DataFrame:
    """n, mean, low, its holders and the number below a mark."""
    w = scores.withColumn("_low", F.min(value).over(Window.partitionBy(*by)))
    return w.groupBy(*by).agg(F.count("*").alias("n"), (F.sum(value) / F.count("*")).alias("mean"), F.min(value).alias("low"), F.count_if(F.col(value) == F.col("_low")).alias("holders"), F.min(F.when(F.col(value) == F.col("_low"), F.col(entity))).alias("first_holder"), F.count_if(F.col(value) < under).alias("under"))


def day_summary(hours: DataFrame, ts: str, value: str, label: str, lo: int = 7, hi: int = 19) -> DataFrame:
    """Per day and part of the day, from local hours lo to hi: max, sum, min, rows and the most frequent label (ties: first)."""
    h = hours.withColumn("_h", F.hour(ts)).where((F.col("_h") >= lo) & (F.col("_h") <= hi)).withColumn("part", F.when(F.col("_h") < 12, "morning").otherwise("afternoon")).withColumn("day", F.to_date(ts))
    each = h.groupBy("day", "part", label).agg(F.count("*").alias("n"), F.max(value).alias("hi"), F.min(value).alias("lo"), F.sum(value).alias("total"))
    each = each.withColumn("_k", F.row_number().over(Window.partitionBy("day", "part").orderBy(F.col("n").desc(), label)))
    return each.groupBy("day", "part").agg(F.sum("n").alias("n"), F.max("hi").alias("hi"), F.min("lo").alias("lo"), F.sum("total").alias("total"), F.max(F.when(F.col("_k") == 1, F.col(label))).alias("mode"))


def board_snapshot(rows: DataFrame, by: Sequence[str], total: str, played: str, full: int) -> DataFrame:
    """leaders, within 1, 2, 3 of them, and how many are finished, under way or not started."""
    behind = F.col(total) - F.min(total).over(Window.partitionBy(*by))
    r = rows.withColumn("_b", behind)
    return r.groupBy(*by).agg(F.min(total).alias("low"), F.count_if(F.col("_b") == 0).alias("leaders"), *(F.count_if(F.col("_b") <= k).alias(f"within_{k}") for k in (1, 2, 3)), F.count_if(F.col(played) >= full).alias("finished"), F.count_if((F.col(played) > 0) & (F.col(played) < full)).alias("under_way"), F.count_if(F.coalesce(F.col(played), F.lit(0)) == 0).alias("not_started"))


def decayed_rating(obs: DataFrame, entity: str, ts: str, value: str, at, tau: float = 730.0, k: float = 3.0, mu0: float = 0.5, sigma0: float = 2.9, kv: float = 40.0) -> DataFrame:
    """Rating at a date from observations before it, weighted by exp(-days / tau) and shrunk: mu, sd, se and weight. One
    grouped sum; an observation that arrives late is decayed from its own date."""
    days = F.datediff(F.lit(at).cast("date"), F.col(ts))
    w = F.exp(-days / tau)
    g = obs.where((days > 0) & F.col(value).isNotNull()).groupBy(entity).agg(F.sum(w).alias("weight"), F.sum(w * F.col(value)).alias("s"), F.sum(w * F.col(value) * F.col(value)).alias("q"))
    raw = F.when(F.col("weight") > 1, F.greatest(F.lit(0.0), F.col("q") / F.col("weight") - F.pow(F.col("s") / F.col("weight"), 2))).otherwise(sigma0**2)
    v = (F.col("weight") * raw + kv * sigma0**2) / (F.col("weight") + kv)
    return g.select(entity, "weight", ((F.col("s") + k * mu0) / (F.col("weight") + k)).alias("mu"), F.sqrt(v).alias("sd"), F.sqrt(v / (F.col("weight") + k)).alias("se"))


def strength_adjusted(scores: DataFrame, ratings: DataFrame, by: Sequence[str], entity: str, value: str, mu0: float = 0.5, least: int = 10) -> DataFrame:
    """residual: value - field mean + mean rating of the field before the event; null for fields under least."""
    r = scores.join(ratings.select(entity, F.col("mu").alias("_mu")), entity, "left").withColumn("_mu", F.coalesce("_mu", F.lit(mu0)))
    w = Window.partitionBy(*by)
    n = F.count("*").over(w)
    return r.withColumn("residual", F.when(n >= least, F.col(value) - F.sum(value).over(w) / n + F.sum("_mu").over(w) / n)).drop("_mu")


#: What the ratings are computed with unless a setting says otherwise.
RATING = {"tau": 730.0, "k": 3.0, "mu0": 0.5, "sigma0": 2.9, "kv": 40.0}


def rating_replay(
    scores: DataFrame,
    order: str,
    field: Sequence[str],
    entity: str,
    value: str,
    buckets: Sequence,
    materialize: Callable[[DataFrame], DataFrame] | None = None,
    tau: float = RATING["tau"],
    least: int = 10,
    grid: Sequence[Mapping[str, float]] | None = None,
    **kw: float,
) -> DataFrame:
    """Residuals adjusted by ratings that know earlier buckets only (dates of the column order, ascending): field, order,
    entity, value, mu, sd and se before the bucket, and residual, null in fields under least rows.

    The state is a table of one row an entity: weight, sum and sum of squares of its residuals at the date of its last one. A
    bucket reads its own rows, which lie in a folder of their own, and that table; it predicts from the state decayed to its
    date, and the entities that it has residuals of get a new state. So the work grows with the history, not its square.
    grid: several settings (tau, k, mu0, sigma0, kv; what one leaves out is as given here) are replayed at once, told apart by
    the column setting (their number). materialize cuts the lineage after each bucket; without it tables are written in the
    shared folder. Rows of dates that are no bucket are left out, null values have no residual.
    """
    cut = materialize or (lambda df: written(df, "replay"))
    base = RATING | {"tau": tau} | kw
    settings = [base | dict(g) for g in (grid if grid is not None else [{}])]
    held = F.array(*(F.struct(F.lit(i).alias("setting"), *(F.lit(float(g[n])).alias(f"_{n}") for n in RATING)) for i, g in enumerate(settings)))
    given = scores.select(*field, order, entity, F.col(value).cast("double").alias(value))
    given = given if materialize else written(given, "replay-scores", [order])
    where = Window.partitionBy("setting", order, *field)
    known = F.count(value).over(where) >= least
    state, parts = None, []
    for at in buckets:
        now = given.where(F.col(order) == F.lit(at)).select("*", F.inline(held))
        if state is None:
            now = now.select("*", *(F.lit(0.0).alias(c) for c in ("_w", "_s", "_q")), F.lit(None).cast("date").alias("_t"))
        else:
            now = now.join(state, ["setting", entity], "left")
        decay = F.coalesce(F.exp(-F.greatest(F.lit(0), F.datediff(F.col(order), F.col("_t"))) / F.col("_tau")), F.lit(1.0))
        now = now.withColumns({c: F.coalesce(F.col(c), F.lit(0.0)) * decay for c in ("_w", "_s", "_q")})
        raw = F.when(F.col("_w") > 1, F.greatest(F.lit(0.0), F.col("_q") / F.col("_w") - F.pow(F.col("_s") / F.col("_w"), 2))).otherwise(F.col("_sigma0") * F.col("_sigma0"))
        now = now.withColumn("mu", (F.col("_s") + F.col("_k") * F.col("_mu0")) / (F.col("_w") + F.col("_k"))).withColumn("_v", (F.col("_w") * raw + F.col("_kv") * F.col("_sigma0") * F.col("_sigma0")) / (F.col("_w") + F.col("_kv")))
        residual = F.when(known, F.col(value) - F.avg(value).over(where) + F.avg(F.when(F.col(value).isNotNull(), F.col("mu"))).over(where))
        done = cut(now.withColumns({"residual": residual, "sd": F.sqrt("_v"), "se": F.sqrt(F.col("_v") / (F.col("_w") + F.col("_k")))}).select("setting", *field, order, entity, value, "mu", "sd", "se", "residual", "_w", "_s", "_q"))
        parts.append(done.drop("_w", "_s", "_q"))
        x = F.col("residual")
        moved = done.where("residual is not null").groupBy("setting", entity).agg((F.first("_w") + F.count("*")).alias("_w"), (F.first("_s") + F.sum(x)).alias("_s"), (F.first("_q") + F.sum(x * x)).alias("_q"), F.max(F.to_date(F.col(order))).alias("_t"))
        state = cut(moved if state is None else moved.unionByName(state.join(moved.select("setting", entity), ["setting", entity], "left_anti")))
    out = reduce(DataFrame.unionByName, parts)
    return out if grid is not None else out.drop("setting")


def gaussian_nll(df: DataFrame, value: str, mu: str, sd: str, se: str) -> DataFrame:
    var = F.col(sd) * F.col(sd) + F.col(se) * F.col(se)
    return df.agg(F.count(value).alias("n"), F.avg(F.lit(0.5) * (F.log(F.lit(6.283185307179586) * var) + F.pow(F.col(value) - F.col(mu), 2) / var)).alias("nll"))


def smoothed_rates(hist: DataFrame, entity: str, hit: str, a: float = 5.0, by: Sequence[str] = ()) -> DataFrame:
    """rate: (hits + a * base) / (n + a), where base is the overall rate."""
    g = hist.groupBy(*by, entity).agg(F.count("*").alias("n"), F.sum(hit).alias("hits"))
    base = hist.groupBy(*by).agg((F.sum(hit) / F.count("*")).alias("base"))
    if by:
        g = g.join(base, list(by))
    else:  # one row
        g = g.withColumn("_k", F.lit(1)).join(F.broadcast(base.withColumn("_k", F.lit(1))), "_k").drop("_k")
    return g.withColumn("rate", (F.col("hits") + a * F.col("base")) / (F.col("n") + a))


def readiness(df: DataFrame, checks: dict[str, Column]) -> DataFrame:
    """failing (the names of checks that don't hold, in their order), ready and the first reason. An unknown check fails."""
    failing = F.array_compact(F.array(*(F.when(~F.coalesce(c, F.lit(False)), F.lit(n)) for n, c in checks.items())))
    return df.withColumn("failing", failing).withColumn("ready", F.size("failing") == 0).withColumn("reason", F.get("failing", F.lit(0)))


def readiness_reason(reason: str | Column, classes: dict[str, Sequence[str]], other: str = "policy") -> Column:
    c = F.col(reason) if isinstance(reason, str) else reason
    out = F.when(c.isNull(), None)
    for name, members in classes.items():
        out = out.when(c.isin(*members), name)
    return out.otherwise(other)


def repeat_winners(entries: DataFrame, entity: str, event: str, position: str, least: int = 2) -> DataFrame:
    return entries.where(F.col(position) == 1).groupBy(entity).agg(F.count("*").alias("wins"), F.max(event).alias("latest")).where(F.col("wins") >= least)


def composite_percentile(stats: DataFrame, by: Sequence[str], percentile: str, code: str, components: Sequence[str]) -> DataFrame:
    """The mean of the components' percentiles if all are there, and the reason if not."""
    g = stats.where(F.col(code).isin(*components)).groupBy(*by).agg(F.count(percentile).alias("known"), F.avg(percentile).alias("_m"))
    full = F.col("known") == len(components)
    return g.select(*by, F.when(full, F.col("_m")).alias("composite"), F.when(~full, "not_published_for_player").alias("reason"))


def distinct_dims(df: DataFrame, entity: str, dim: str) -> DataFrame:
    return df.groupBy(entity).agg(F.count_distinct(dim).alias("distinct"), F.count("*").alias("starts"))


def segment_totals(items: DataFrame, by: Sequence[str], item: str, value: str, segments: dict[str, tuple[int, int]]) -> DataFrame:
    """Sums of ranges of items, null unless all items of the range are there."""
    out = []
    for name, (lo, hi) in segments.items():
        inside = F.col(item).between(lo, hi)
        out.append(F.when(F.count_if(inside & F.col(value).isNotNull()) == hi - lo + 1, F.sum(F.when(inside, F.col(value)))).alias(name))
    return items.groupBy(*by).agg(*out)


def daily_counters(df: DataFrame, ts: str, keys: Sequence[str], value: str | None = None) -> DataFrame:
    """Rows (and a sum) by day and keys; batch and stream alike."""
    aggs = [F.count("*").alias("n")] + ([F.sum(value).alias("total")] if value else [])
    return df.groupBy(F.window(ts, "1 day").alias("_w"), *keys).agg(*aggs).select(F.col("_w.start").alias("day"), *keys, *[a for a in ("n", "total") if a == "n" or value])


def source_health(df: DataFrame, source: str, ts: str, held: Column, now) -> DataFrame:
    """The last write of each source, its age in hours, and held rows."""
    return df.groupBy(source).agg(F.max(ts).alias("last"), F.count_if(held).alias("held"), F.count("*").alias("rows")).withColumn("age_hours", ((F.unix_timestamp(F.lit(now).cast("timestamp")) - F.unix_timestamp("last")) / 3600).cast("double"))


def pair_verdict(edges: DataFrame, by: Sequence[str], metric: str, delta: str, least: int = 3) -> DataFrame:
    """The metric with the largest gap, and the best one for the other side; null under so many comparable metrics."""
    d = edges.where(F.col(delta).isNotNull())
    size = lambda c: F.struct(F.abs(F.col(delta)).alias("a"), F.col(metric).alias("m"), F.signum(delta).alias("side")) if c is None else F.when(c, F.struct(F.abs(F.col(delta)).alias("a"), F.col(metric).alias("m")))
    g = d.groupBy(*by).agg(F.count("*").alias("comparable"), F.max(size(None)).alias("top"), F.max(size(F.col(delta) > 0)).alias("pos"), F.max(size(F.col(delta) < 0)).alias("neg"))
    enough = F.col("comparable") >= least
    return g.select(*by, "comparable", F.when(enough, F.col("top.m")).alias("edge"), F.when(enough, F.when(F.col("top.side") > 0, F.col("neg.m")).otherwise(F.col("pos.m"))).alias("counter"))


def source_coverage(sources: DataFrame, key: str, tables: dict[str, DataFrame]) -> DataFrame:
    """The rows that each table has of each source; 0 where there are none."""
    out = sources.select(key).distinct()
    for name, t in tables.items():
        out = out.join(t.groupBy(key).agg(F.count("*").alias(name)), key, "left").fillna(0, [name])
    return out
