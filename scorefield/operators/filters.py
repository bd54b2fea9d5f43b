"""Filters, gates and classifications, as predicates and columns."""

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import fold


def complete_only(df: DataFrame, col: str, n: int = 18) -> DataFrame:
    """Rows with at least n items, or where that is not known."""
    return df.where(F.col(col).isNull() | (F.col(col) >= n))


def valid_scores(df: DataFrame, col: str, lo, hi=None) -> DataFrame:
    return df.where(F.col(col) >= lo if hi is None else F.col(col).between(lo, hi))


def drop_superseded(df: DataFrame, rules: str, path: str = "$.superseded_by") -> DataFrame:
    return df.where(F.get_json_object(rules, path).isNull())


def drop_merged(tables: Mapping[str, DataFrame], merged: DataFrame, key: str) -> dict[str, DataFrame]:
    """Each table without rows of merged identities."""
    return {name: t.join(merged.select(key), key, "left_anti") for name, t in tables.items()}


def coverage(events: DataFrame, entries: DataFrame, event: str, declared: str, label: str) -> DataFrame:
    """The label, downgraded to partial where stored rows are under 0.8 of the declared ones, to schedule_only where none are."""
    n = entries.groupBy(event).agg(F.count("*").alias("stored"))
    out = events.join(n, event, "left").withColumn("stored", F.coalesce("stored", F.lit(0)).cast("long"))
    return out.withColumn(label, F.when(F.col("stored") == 0, "schedule_only").when(F.col("stored") < 0.8 * F.col(declared), "partial").otherwise(F.col(label)))


def clean_stat(df: DataFrame, code: str, value: str, rank: str, rates: Sequence[str]) -> DataFrame:
    """A zero of a rate without a positive rank was not measured: it is null."""
    unmeasured = F.col(code).isin(*rates) & (F.col(value) == 0) & ~F.coalesce(F.col(rank) > 0, F.lit(False))
    return df.withColumn(value, F.when(~F.coalesce(unmeasured, F.lit(False)), F.col(value)))


def event_status(start: str, end: str, today, winner: str | None = None, cancelled: str | None = None) -> Column:
    t = F.lit(today).cast("date")
    c = F.when(F.coalesce(F.col(cancelled), F.lit(False)), "cancelled") if cancelled else F.when(F.lit(False), "")
    c = c.when(F.col(winner).isNotNull(), "completed") if winner else c
    return c.when(F.col(start).isNull(), "unknown").when(F.col(start) > t, "scheduled").when(F.coalesce(F.col(end), F.col(start)) < t, "completed").otherwise("in_progress")


def event_state(start: str, end: str, today) -> Column:
    """completed, this_week (touches the Monday week of today), upcoming or unknown."""
    t = F.lit(today).cast("date")
    monday = F.date_trunc("week", t).cast("date")
    last = F.coalesce(F.col(end), F.col(start))
    return F.when(F.col(start).isNull(), "unknown").when((F.col(start) <= F.date_add(monday, 6)) & (last >= monday), "this_week").when(F.col(start) > t, "upcoming").otherwise("completed")


def live_state(status: str, observed: str, now, posted: str, minutes: tuple[int, int, int] = (5, 20, 60)) -> Column:
    """The first that holds: unavailable, final, unavailable when too old, suspended, pre, round_complete, live, stale, pre."""
    live, fresh, stale = minutes
    age = (F.unix_timestamp(F.lit(now).cast("timestamp")) - F.unix_timestamp(observed)) / 60
    s = F.col(status)
    return (
        F.when(F.col(observed).isNull(), "unavailable").when(s == "final", "final").when(age > stale, "unavailable")
        .when(s == "suspended", F.when(age <= fresh, "suspended").otherwise("stale")).when(s.isin("pre", "scheduled"), "pre")
        .when(s.isin("play_complete", "end_period"), F.when(age <= fresh, "round_complete").otherwise("stale"))
        .when((s == "in") & F.coalesce(F.col(posted) > 0, F.lit(False)), F.when(age <= live, "live").otherwise("stale")).when(s == "in", "pre").otherwise("unavailable")
    )


def facet(df: DataFrame, **eq) -> DataFrame:
    for c, v in eq.items():
        df = df.where(F.col(c) == v)
    return df


def search(df: DataFrame, q: str, key: str, name: str, boost: str, k: int = 12) -> DataFrame:
    """The k best rows for a text: exact 100, prefix 80, each term a word's prefix 60, contained 40, and boost / 5 up to 10."""
    import re
    import unicodedata

    t = re.sub("[^a-z0-9]+", " ", unicodedata.normalize("NFKD", q.lower()).encode("ascii", "ignore").decode()).strip()
    n = fold(name)
    terms = F.lit(True)
    for term in t.split():
        terms = terms & F.concat(F.lit(" "), n).contains(f" {term}")
    base = F.when(n == t, 100).when(n.startswith(t), 80).when(terms, 60).when(n.contains(t), 40)
    scored = df.withColumn("score", (base + F.least(F.lit(10.0), F.coalesce(F.col(boost), F.lit(0)) / 5)).cast("double")).where(F.col("score").isNotNull() & F.lit(len(t) >= 2))
    return scored.orderBy(F.col("score").desc(), name, key).limit(k)


def approved_only(rows: DataFrame, captures: DataFrame, sources: DataFrame, capture: str, source: str) -> DataFrame:
    """Rows whose capture comes from one of the given, approved sources."""
    good = captures.join(sources.select(source), source, "left_semi").select(capture)
    return rows.join(good, capture, "left_semi")


def has_provenance(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    return df.dropna(subset=list(cols))


def licence_verdict(text: str, deny: Mapping[str, str], allow: Mapping[str, str]) -> Column:
    """deny:<reason> of the first pattern that matches, else allow:<reason>, else unknown."""
    out = None
    for verdict, rules in (("deny", deny), ("allow", allow)):
        for reason, pattern in rules.items():
            hit = F.coalesce(F.col(text).rlike(pattern), F.lit(False))
            out = F.when(hit, f"{verdict}:{reason}") if out is None else out.when(hit, f"{verdict}:{reason}")
    return out.otherwise("unknown")


def classify_text(text: str, families: Mapping[str, str]) -> Column:
    """family and evidence of the first pattern that matches."""
    family = evidence = None
    for name, pattern in families.items():
        hit, found = F.col(text).rlike(pattern), F.regexp_extract(text, f"({pattern})", 1)
        family = F.when(hit, name) if family is None else family.when(hit, name)
        evidence = F.when(hit, found) if evidence is None else evidence.when(hit, found)
    return F.struct(family.alias("family"), evidence.alias("evidence"))


def resolve_key(df: DataFrame, registry: Sequence[tuple[DataFrame, str]], out: str, other: str = "unassigned") -> DataFrame:
    """The key of the first registry (key column, out) that knows the row."""
    found = []
    for i, (table, on) in enumerate(registry):
        df = df.join(table.select(F.col(on), F.col(out).alias(f"_{i}")), on, "left")
        found.append(F.col(f"_{i}"))
    return df.withColumn(out, F.coalesce(*found, F.lit(other))).drop(*(f"_{i}" for i in range(len(registry))))


def outcome(status: str, real_cut: str) -> Column:
    s = F.col(status)
    return F.when(s == "disqualified", "disqualified").when(s == "withdrawn", "withdrawn").when(s == "dns", "dns").when((s == "cut") & F.coalesce(F.col(real_cut), F.lit(False)), "missed_cut").otherwise("finished")


def in_window(df: DataFrame, start: str, end: str, now, before: int, after: int) -> DataFrame:
    """Rows active at now: from so many days before their start to so many after their end."""
    t = F.lit(now).cast("date")
    return df.where((F.date_sub(F.col(start), before) <= t) & (F.date_add(F.col(end), after) >= t))


def needs_refresh(status: str, position: str, changed: str, now, minutes: int = 5) -> Column:
    """In play, in the top ten, or not changed for some minutes."""
    age = F.unix_timestamp(F.lit(now).cast("timestamp")) - F.unix_timestamp(changed)
    return F.coalesce(F.col(status) == "in", F.lit(False)) | F.coalesce(F.col(position) <= 10, F.lit(False)) | F.coalesce(age >= minutes * 60, F.lit(True))


def validate_rows(df: DataFrame, rules: Mapping[str, Column]) -> DataFrame:
    """violations: the names of the rules that do not hold; a rule that is unknown does not count."""
    return df.withColumn("violations", F.array_compact(F.array(*(F.when(~c, F.lit(n)) for n, c in rules.items()))))


def complete_card(df: DataFrame, by: Sequence[str], item: str, value: str, n: int) -> DataFrame:
    """complete: n distinct items, from 1 to n, all with a value; and their total."""
    g = df.groupBy(*by).agg(F.count_distinct(item).alias("_d"), F.count(value).alias("_v"), F.count("*").alias("_n"), F.min(item).alias("_lo"), F.max(item).alias("_hi"), F.sum(value).alias("total"))
    return g.select(*by, "total", ((F.col("_d") == n) & (F.col("_v") == n) & (F.col("_n") == n) & (F.col("_lo") == 1) & (F.col("_hi") == n)).alias("complete"))


def reconciled_total(parts: DataFrame, published: DataFrame, key: str, total: str, stated: str) -> DataFrame:
    """verdict: accepted where the parts sum to the published total, hold where they do not or it is missing."""
    return parts.join(published.select(key, stated), key, "left").withColumn("verdict", F.when(F.col(total) == F.col(stated), "accepted").otherwise("hold"))


def notable(df: DataFrame, percentile: str, won: str, least: int = 90) -> DataFrame:
    return df.where(F.coalesce(F.col(percentile) >= least, F.lit(False)) | F.coalesce(F.col(won), F.lit(False)))


def known_coords(df: DataFrame, lat: str, lon: str) -> DataFrame:
    """Both coordinates or neither."""
    both = F.col(lat).isNotNull() & F.col(lon).isNotNull()
    return df.withColumns({lat: F.when(both, F.col(lat)), lon: F.when(both, F.col(lon))})


def signal_available(events: str, entities: str, scores: str) -> Column:
    """available and the reason why not."""
    reason = F.when(F.col(events) < 3, "events").when(F.col(entities) < 50, "entities").when(F.col(scores) < 100, "scores")
    return F.struct(reason.isNull().alias("available"), reason.alias("reason"))
