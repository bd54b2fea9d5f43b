"""Joins: time-safe histories, as-of and interval matches, identity, parity and assignment.

Range conditions always come with an equality (a key, a time bucket or a grid cell), so that no Cartesian product is
planned. Matches must be unique where a rule says so; several candidates are held, not guessed.
"""

import math
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StructField, StructType

from ..functions.scalars import fold, haversine_km, name_keys
from ..session import written


def join_preferred(left: DataFrame, right: DataFrame, on: Sequence[str], priority: str, tie: str) -> DataFrame:
    """Left join with the one right row of the lowest priority number."""
    best = right.withColumn("_k", F.row_number().over(Window.partitionBy(*on).orderBy(F.col(priority).asc_nulls_last(), tie))).where("_k = 1").drop("_k")
    return left.join(best, list(on), "left")


def fold_alias(df: DataFrame, alias: DataFrame, key: str) -> DataFrame:
    """Keys replaced by their primary, one level, where both exist in df. alias: key, primary."""
    known = df.select(F.col(key).alias("_known")).distinct()
    real = alias.select(F.col(key), "primary").join(known, F.col("primary") == F.col("_known"), "left_semi")
    return df.join(real, key, "left").withColumn(key, F.coalesce("primary", key)).drop("primary")


def previous_period(df: DataFrame, by: Sequence[str], year: str, value: str) -> DataFrame:
    """The value of the year before, by key."""
    before = df.select(*by, (F.col(year) + 1).alias(year), F.col(value).alias(f"previous_{value}"))
    return df.join(before, [*by, year], "left")


def history_before(entries: DataFrame, by: str, start: str, value: str, days: int | None = None) -> DataFrame:
    """For each row the number and sum of the entity's rows that lie strictly before its date, and not more than days. Rows of
    the same date never count. One sort per entity instead of a self join."""
    day = F.datediff(F.col(start), F.lit("1970-01-01").cast("date"))
    w = Window.partitionBy(by).orderBy("_day")
    w = w.rangeBetween(Window.unboundedPreceding if days is None else -days, -1)
    return entries.withColumn("_day", day).withColumn("prior", F.count(value).over(w)).withColumn("prior_total", F.sum(value).over(w)).drop("_day")


def asof_join(left: DataFrame, right: DataFrame, by: Sequence[str], on: str, value: str, tolerance: str | None = None) -> DataFrame:
    """The right value with the latest time at or before each left row, if it is younger than the tolerance: one union and
    one sorted pass, whatever the number of matches."""
    carried = StructType([StructField("t", right.schema[on].dataType), StructField("v", right.schema[value].dataType)])
    ours = left.withColumn("_side", F.lit(1)).withColumn("_v", F.lit(None).cast(carried))
    theirs = right.select(*by, on, F.lit(0).alias("_side"), F.struct(F.col(on).alias("t"), F.col(value).alias("v")).alias("_v"))
    w = Window.partitionBy(*by).orderBy(on, "_side").rowsBetween(Window.unboundedPreceding, 0)
    out = ours.unionByName(theirs, allowMissingColumns=True).withColumn("_m", F.last("_v", ignorenulls=True).over(w)).where("_side = 1")
    fresh = F.lit(True) if tolerance is None else F.col("_m.t") > F.col(on) - F.expr(f"interval {tolerance}")
    return out.withColumn(value, F.when(fresh, F.col("_m.v"))).withColumn(f"{on}_matched", F.when(fresh, F.col("_m.t"))).drop("_side", "_v", "_m")


def asof_prior(df: DataFrame, by: Sequence[str], order: Sequence[str], value: str) -> DataFrame:
    return df.withColumn(f"prior_{value}", F.lag(value).over(Window.partitionBy(*by).orderBy(*order)))


def nearest_interval_join(points: DataFrame, intervals: DataFrame, by: Sequence[str], at: str, start: str, end: str, key: str, point_key: str, before: int = 10, after: int = 45, margin: int = 7) -> DataFrame:
    """The interval of the same key whose end is nearest, from days before its start to days after its end, accepted only if
    the next best is more than margin days farther."""
    p = points.withColumn("_day", F.datediff(F.col(at), F.lit("1970-01-01").cast("date")))
    i = intervals.withColumn("_s", F.datediff(F.date_sub(start, before), F.lit("1970-01-01").cast("date"))).withColumn("_e", F.datediff(F.date_add(end, after), F.lit("1970-01-01").cast("date")))
    # weeks make an equality of the range
    i = i.withColumn("_week", F.explode(F.sequence(F.floor(F.col("_s") / 7), F.floor(F.col("_e") / 7))))
    m = p.withColumn("_week", F.floor(F.col("_day") / 7)).join(i, [*by, "_week"]).where("_day between _s and _e").withColumn("_far", F.abs(F.datediff(F.col(end), F.col(at))))
    w = Window.partitionBy(point_key).orderBy("_far", key)
    m = m.withColumn("_k", F.row_number().over(w)).withColumn("_next", F.lead("_far").over(w)).where("_k = 1")
    return m.where(F.col("_next").isNull() | (F.col("_next") - F.col("_far") > margin)).select(point_key, key, F.col("_far").cast("long").alias("days"))


def match_unique(left: DataFrame, right: DataFrame, on: Sequence[str], left_key: str, right_key: str) -> DataFrame:
    """Pairs that agree on all keys where neither side has another candidate.

    Candidates are no rows: of each side, the rows of a key are one row with the least and greatest of them, and a row has a single candidate
    where the least and greatest of all its keys are the same.
    """
    l, r = left.select(*on, F.struct(F.col(left_key).alias("k")).alias("_l")), right.select(*on, F.struct(F.col(right_key).alias("k")).alias("_r"))
    ends = lambda df, c: df.groupBy(*on).agg(F.min(c).alias(c), F.max(c).alias("_last"))
    single = lambda df, own, others, c: df.join(ends(others, c), list(on)).groupBy(own).agg(F.min(c).alias(c), F.max("_last").alias("_last")).where(F.col(c) == F.col("_last")).select("_l", "_r")
    return single(l, "_l", r, "_r").join(single(r, "_r", l, "_l"), ["_l", "_r"]).select(F.col("_l.k").alias(left_key), F.col("_r.k").alias(right_key))


def _distinctive(name, generic: Sequence[str]) -> Column:
    """The words of a name over three letters and not generic, each once, in order of the alphabet."""
    return F.array_sort(F.array_distinct(F.filter(F.split(fold(name), " "), lambda x: (F.length(x) > 3) & ~x.isin(*generic) if generic else F.length(x) > 3)))


def _seconds(c: str) -> Column:
    return F.unix_timestamp(F.col(c).cast("timestamp"))


def _meet(asks: DataFrame, held: DataFrame, days: float) -> DataFrame:
    """Rows of asks (_at) beside those of held (_end) that agree in _year, _word and _for (null beside null) and whose seconds are
    at most days apart. Days make an equality of the range."""
    day = lambda c: F.floor(c / 86400)
    reach = int(days * 86400)
    a = asks.withColumn("_day", day(F.col("_at"))).alias("a")
    h = held.withColumn("_day", F.explode(F.sequence(day(F.col("_end") - reach), day(F.col("_end") + reach)))).alias("h")
    same = (F.col("a._year") == F.col("h._year")) & (F.col("a._word") == F.col("h._word")) & (F.col("a._day") == F.col("h._day")) & F.col("a._for").eqNullSafe(F.col("h._for"))
    ours = [c for c in held.columns if c not in ("_year", "_word", "_for")]
    return a.join(h, same & (F.abs(F.col("h._end") - F.col("a._at")) <= days * 86400)).select("a.*", *(f"h.{c}" for c in ours)).drop("_day")


def match_events(a: DataFrame, b: DataFrame, year: str, end: str, name: str, key_a: str, key_b: str, days: float = 1.01, generic: Sequence[str] = ()) -> DataFrame:
    """Events of one year whose ends are at most days apart and whose names share a distinctive word (over three letters and
    not generic); a left row with several candidates is not matched.

    Candidates are no rows: the right rows of a year, word and end are one row with the least and greatest of their keys, left rows
    of one year, end and set of words ask once, and a row has a single candidate where the least and greatest of all are the same.
    """
    kind = F.struct(F.col(year).alias("y"), _seconds(end).alias("at"), _distinctive(name, generic).alias("words")).alias("_kind")
    l = a.select(key_a, kind)
    r = b.select(F.struct(F.col(key_b).alias("k")).alias("_b"), F.col(year).alias("_year"), _seconds(end).alias("_end"), F.explode(_distinctive(name, generic)).alias("_word"))
    held = r.groupBy("_year", "_word", "_end", F.lit(None).cast("int").alias("_for")).agg(F.min("_b").alias("_lo"), F.max("_b").alias("_hi"))
    asks = l.select("_kind").distinct().select("_kind", F.col("_kind.y").alias("_year"), F.col("_kind.at").alias("_at"), F.lit(None).cast("int").alias("_for"), F.explode("_kind.words").alias("_word"))
    lohi = [F.min("_lo").alias("_lo"), F.max("_hi").alias("_hi")]
    near = _meet(asks, held, days).groupBy("_kind").agg(*lohi)
    return l.join(near, "_kind").groupBy(key_a).agg(*lohi).where(F.col("_lo") == F.col("_hi")).select(key_a, F.col("_lo.k").alias(key_b))


#: Words that tell no events apart.
GENERIC = ("championship", "tournament", "classic", "open", "golf", "presented", "invitational")


def match_editions(events: DataFrame, editions: DataFrame, key: str, edition: str, name: str, end: str, year: str, canonical: str, provider: str, division: str, superseded: str, days: float = 1.01, generic: Sequence[str] = GENERIC) -> DataFrame:
    """key, match, basis and superseded of each event: the edition that it is, and the duplicates that give way to it.

    Near editions are of the event's year, end at most days from it, and share a distinctive word of its name (over three
    letters, not generic); superseded ones are out. A single canonical one among them wins (basis canonical), and the near ones
    that are not canonical, or carry the event's own id, are superseded. Else the edition with the event's id (column provider) is it, the
    least of several (exact_id). Else the near edition of its division (any, where the event has none) if it is a single one
    (unique). Else there is no match. events: key, name, end, year, division; editions: edition, the same, and canonical, provider and superseded. Nulls
    agree with nothing, and a null canonical or superseded is false.

    Near editions are no rows: those of a year, word, end and division (and of all divisions) are one row with the least and greatest of them
    and of the canonical ones; events of one year, end, division and set of words ask once. Only where a single canonical one is near are the
    others listed, once for all events that ask alike: beside it they are the near ones that are not canonical.
    """
    live = editions.where(~F.coalesce(F.col(superseded), F.lit(False))).select(F.col(edition).alias("_e"), _distinctive(name, generic).alias("_words"), F.col(year).alias("_year"), _seconds(end).alias("_end"), F.coalesce(F.col(canonical), F.lit(False)).alias("_canon"), F.col(provider).cast("string").alias("_provider"), F.col(division).alias("_division"))
    kind = F.struct(F.col(year).alias("y"), _seconds(end).alias("at"), F.col(division).alias("own"), _distinctive(name, generic).alias("words")).alias("_kind")
    asked = events.select(F.col(key), F.col(key).cast("string").alias("_id"), kind)
    every = lambda c: F.explode(F.array_distinct(F.array(F.nullif(c, c), c))).alias("_for")  # noqa: E731  # null stands for all divisions
    asks = asked.select("_kind").distinct().select("_kind", F.col("_kind.y").alias("_year"), F.col("_kind.at").alias("_at"), F.explode("_kind.words").alias("_word"))
    one = F.struct("_e", "_provider", "_division", "_canon")
    canon = F.when(F.col("_canon"), one)
    rows = live.select("*", F.explode("_words").alias("_word"))
    held = rows.select("*", every(F.col("_division"))).groupBy("_year", "_word", "_end", "_for").agg(F.min(canon).alias("_c0"), F.max(canon).alias("_c1"), F.min(one).alias("_u0"), F.max(one).alias("_u1"))
    met = _meet(asks.select("*", every(F.col("_kind.own"))), held, days)
    of = lambda which, c: F.when(which & F.col(c).isNotNull(), F.struct(F.col(c).alias("row"), F.col("_kind.own").alias("own")))
    ends = lambda f: [F.min(f("_c0")).alias("_c0"), F.max(f("_c1")).alias("_c1"), F.min(f("_u0")).alias("_u0"), F.max(f("_u1")).alias("_u1")]
    near = met.groupBy("_kind").agg(*ends(lambda c: of(F.col("_for").isNull() if c[1] == "c" else F.col("_for").eqNullSafe(F.col("_kind.own")), c)))
    near = asked.join(near, "_kind").groupBy(key).agg(*ends(F.col))
    single = lambda c: F.coalesce(F.col(f"_{c}0") == F.col(f"_{c}1"), F.lit(False))
    g = near.select(key, F.when(single("c"), F.col("_c0.row._e")).alias("_c"), F.when(single("u"), F.col("_u0.row._e")).alias("_u"), single("c").alias("_canonical"), single("u").alias("_unique"))
    beside = asked.join(g.where("_canonical").select(key), key).select(key, "_kind")
    nowhere = F.lit(None).cast("int").alias("_for")
    listed = _meet(asks.join(beside.select("_kind").distinct(), "_kind").select("*", nowhere), rows.where("not _canon").select("_e", "_year", "_end", "_word", nowhere), days).groupBy("_kind").agg(F.collect_set("_e").alias("_yield"))
    listed = beside.join(listed, "_kind").groupBy(key).agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("_yield")))).alias("_yield"))
    exact = live.where("_provider is not null").groupBy(F.col("_provider").alias("_id")).agg(F.min("_e").alias("_x"))
    m = asked.select(key, "_id").join(g, key, "left").join(listed, key, "left").join(exact, "_id", "left")
    basis = F.when(F.col("_canonical"), "canonical").when(F.col("_x").isNotNull(), "exact_id").when(F.col("_unique"), "unique")
    none = F.array().cast(ArrayType(editions.schema[edition].dataType))
    m = m.withColumn("basis", basis)
    match = F.when(F.col("basis") == "canonical", F.col("_c")).when(F.col("basis") == "exact_id", F.col("_x")).when(F.col("basis") == "unique", F.col("_u"))
    return m.select(key, match.alias("match"), "basis", F.when(F.col("basis") == "canonical", F.array_remove(F.coalesce("_yield", none), F.col("_c"))).otherwise(none).alias("superseded"))


def resolve_identity(cands: DataFrame, crosswalk: DataFrame, canon: DataFrame, key: str, name: str, birth: str, canon_key: str, year: str | None = None, event: str | None = None, members: DataFrame | None = None) -> DataFrame:
    """canon_key and outcome of each candidate, by the first rule that leaves one canonical row:

    crosswalk; name_birth (exact name and full date); name_year (exact name, and the canonical row has only the year of birth
    of it); name_event (exact name, a member of the candidate's event, no two full dates that differ). Where no exact name
    agrees, variant_birth (a variant of the name and the full date). What has a namesake and no rule is held:
    multiple_namesakes, namesake_without_corroboration, variant_without_birth. Only what has none at all is new.

    canon: canon_key, name, birth, and year where given; members: event and canon_key; event is a column of cands. A null name
    has no namesakes and a null date agrees with none. Each rule asks for keys (a name and a date, say), and a key's canonical
    rows are one row with the least and greatest of them, so a common name makes no pairs.
    """
    known = canon.select(F.col(canon_key).alias("_id"), fold(name).alias("_name"), F.col(birth).cast("date").alias("_birth"), (F.col(year).cast("int") if year else F.lit(None).cast("int")).alias("_year"), name_keys(name).alias("_variants"))
    asked = cands.select(F.col(key), fold(name).alias("_name"), F.col(birth).cast("date").alias("_birth"), (F.col(event).cast("string") if event else F.lit(None).cast("string")).alias("_event"), name_keys(name).alias("_variants"))
    text = lambda kind, *parts: F.when(reduce(lambda a, b: a & b, (F.col(p).isNotNull() if isinstance(p, str) else p.isNotNull() for p in parts)), F.struct(F.lit(kind).alias("kind"), F.concat_ws("|", *(F.col(p).cast("string") if isinstance(p, str) else p for p in parts)).alias("ask")))
    variants = lambda kind, *parts: F.transform("_variants", lambda v: text(kind, v, *parts))
    every = lambda *singles: F.filter(F.concat(F.array(*singles), variants("variant"), variants("variant_birth", "_birth")), lambda x: x.isNotNull())
    has_name = F.col("_name") != ""
    own = known.withColumn("_name", F.when(has_name, F.col("_name"))).select("_id", F.inline(every(text("name", "_name"), text("name_birth", "_name", "_birth"), F.when(F.col("_birth").isNull(), text("name_year", "_name", "_year")))))
    if event and members is not None:
        met = members.select(F.col(canon_key).alias("_id"), F.col(event).cast("string").alias("_event")).join(known.where(has_name), "_id")
        own = own.unionByName(met.select("_id", F.inline(F.array_compact(F.array(text("event", "_event", "_name"), F.when(F.col("_birth").isNull(), text("event_undated", "_event", "_name")), text("event_birth", "_event", "_name", "_birth"))))))
    spans = own.groupBy("kind", "ask").agg(F.min("_id").alias("lo"), F.max("_id").alias("hi"))
    dated = F.col("_birth").isNotNull()
    asks = asked.withColumn("_name", F.when(has_name, F.col("_name"))).select(key, F.inline(every(
        text("name", "_name"), text("name_birth", "_name", "_birth"), text("name_year", "_name", F.year("_birth")),
        F.when(~dated, text("event", "_event", "_name")), F.when(dated, text("event_undated", "_event", "_name")), F.when(dated, text("event_birth", "_event", "_name", "_birth")),
    )))
    lo = lambda *kinds: F.min(F.when(F.col("kind").isin(*kinds), F.col("lo")))
    hi = lambda *kinds: F.max(F.when(F.col("kind").isin(*kinds), F.col("hi")))
    rules = {"name": ["name"], "name_birth": ["name_birth"], "name_year": ["name_year"], "name_event": ["event", "event_undated", "event_birth"], "variant": ["variant"], "variant_birth": ["variant_birth"]}
    found = asks.join(spans, ["kind", "ask"]).groupBy(key).agg(*(f(*kinds).alias(f"{rule}_{side}") for rule, kinds in rules.items() for side, f in (("lo", lo), ("hi", hi))))
    one = lambda rule: F.coalesce(F.col(f"{rule}_lo") == F.col(f"{rule}_hi"), F.lit(False))
    some = lambda rule: F.col(f"{rule}_lo").isNotNull()
    rule = F.when(F.col("_x").isNotNull(), "crosswalk").when(one("name_birth"), "name_birth").when(~some("name_birth") & one("name_year"), "name_year").when(some("name") & one("name_event"), "name_event")
    rule = rule.when(some("name") & ~one("name"), "multiple_namesakes").when(some("name"), "namesake_without_corroboration").when(one("variant_birth"), "variant_birth").when(some("variant"), "variant_without_birth").otherwise("new")
    out = cands.select(key).join(crosswalk.select(key, F.col(canon_key).alias("_x")), key, "left").join(found, key, "left").withColumn("outcome", rule)
    chosen = F.when(F.col("outcome") == "crosswalk", F.col("_x"))
    for r in ("name_birth", "name_year", "name_event", "variant_birth"):
        chosen = chosen.when(F.col("outcome") == r, F.col(f"{r}_lo"))
    return out.select(key, chosen.alias(canon_key), "outcome")


#: Rows of a tile of candidate_pairs, about.
TILE = 4096


def candidate_pairs(df: DataFrame, key: str, name: str) -> DataFrame:
    """Pairs a < b that share a key of their names' variants, each once. All pairs of a key are rows: where many rows may share
    one, merge_decisions decides without them.

    The rows of a name's key are dealt into tiles and tiles meet by twos, so a task holds one tile however common a name is. A pair
    that shares several keys comes from the least of them alone, so pairs are never shuffled or told apart afterwards.
    """
    k = df.where(F.col(key).isNotNull()).select(F.col(key).alias("_id"), name_keys(name).alias("_keys"))
    k = k.groupBy("_id").agg(F.array_sort(F.array_distinct(F.filter(F.flatten(F.collect_set("_keys")), lambda x: x != ""))).alias("_keys"))
    k = k.select("_id", "_keys", F.posexplode("_keys").alias("_n", "_block")).select("_id", "_block", F.when(F.col("_n") > 0, F.slice("_keys", F.lit(1), F.col("_n"))).alias("_before"))
    many = k.groupBy("_block").agg(F.count("*").alias("_rows")).where("_rows > 1").select("_block", F.ceil(F.col("_rows") / TILE).alias("_tiles"))
    k = k.join(many, "_block").withColumn("_t", F.pmod(F.xxhash64("_id"), F.col("_tiles")))
    l = k.select("_block", F.col("_t").alias("_p"), F.explode(F.sequence("_t", F.col("_tiles") - 1)).alias("_q"), F.col("_id").alias("_l"), F.col("_before").alias("_lb"))
    r = k.select("_block", F.explode(F.sequence(F.lit(0).cast("long"), "_t")).alias("_p"), F.col("_t").alias("_q"), F.col("_id").alias("_r"), F.col("_before").alias("_rb"))
    tiles, tasks = ["_block", "_p", "_q"], int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    m = l.repartition(tasks, *tiles).hint("merge").join(r.repartition(tasks, *tiles), tiles).where((F.col("_p") < F.col("_q")) | (F.col("_l") < F.col("_r")))
    return m.where(F.col("_lb").isNull() | F.col("_rb").isNull() | ~F.arrays_overlap("_lb", "_rb")).select(F.least("_l", "_r").alias("a"), F.greatest("_l", "_r").alias("b"))


def _families(rows: DataFrame, most_rounds: int = 40) -> DataFrame:
    """_id and _family (the least _id reachable) where rows (_id, _hub) that share a hub belong together. Labels spread from rows
    to hubs and back, as grouped minima, until none changes; each round is a written table."""
    edges = written(rows.distinct(), "family-hubs")
    labels = edges.select("_id", F.col("_id").alias("_family")).distinct()
    for _ in range(most_rounds):
        hubs = edges.join(labels, "_id").groupBy("_hub").agg(F.min("_family").alias("_h"))
        spread = edges.join(hubs, "_hub").groupBy("_id").agg(F.min("_h").alias("_h"))
        after = written(labels.join(spread, "_id").select("_id", F.least("_family", "_h").alias("_family"), (F.col("_h") < F.col("_family")).alias("_moved")), "families")
        labels = after.drop("_moved")
        if after.where("_moved").isEmpty():
            return labels
    raise RuntimeError(f"families have not settled in {most_rounds} rounds")


def merge_decisions(records: DataFrame, key: str, name: str, birth: str, canonical: str) -> DataFrame:
    """key, decision, target and reasons of the records whose names are variants of another's.

    Records of one family share a variant of their names and the full date of birth, directly or through others. A family with
    one canonical record merges: the others into it (merge, target), itself kept. Else they are held with reasons, in the order
    of the alphabet: birth_date_missing (on either side), birth_dates_differ, canonical_unclear (a family of several records
    with no canonical one, or more than one). A merged record keeps the reasons that hold against further namesakes.
    canonical: a boolean column, null as false. Records that share no key with another give no row, nor do null names.

    A block of namesakes is never squared: what a record's reasons need of its block are counts and extremes, and families are
    stars around their name and date.
    """
    r = records.select(F.col(key).alias("_id"), F.col(birth).cast("date").alias("_birth"), F.coalesce(F.col(canonical), F.lit(False)).alias("_canon"), F.explode(name_keys(name)).alias("_block"))
    blocks = r.groupBy("_block").agg(F.count("*").alias("_n"), F.count_if(F.col("_birth").isNull()).alias("_missing"), F.min("_birth").alias("_first"), F.max("_birth").alias("_last")).where("_n > 1")
    met = written(r.join(blocks, "_block"), "namesakes")
    flags = met.groupBy("_id", "_birth", "_canon").agg(F.max(F.col("_birth").isNull() | (F.col("_missing") > 0)).alias("_m"), F.max(F.coalesce((F.col("_first") != F.col("_birth")) | (F.col("_last") != F.col("_birth")), F.lit(False))).alias("_d"))
    labels = _families(met.where("_birth is not null").select("_id", F.struct("_block", "_birth").alias("_hub")))
    family = flags.select("_id", "_canon").join(labels, "_id").groupBy("_family").agg(F.count("*").alias("_size"), F.count_if("_canon").alias("_canons"), F.min(F.when(F.col("_canon"), F.col("_id"))).alias("_target"))
    out = flags.join(labels, "_id", "left").join(family, "_family", "left")
    several = F.coalesce(F.col("_size") > 1, F.lit(False))
    merges = several & (F.col("_canons") == 1)
    decision = F.when(merges & ~F.col("_canon"), "merge").when(merges, "keep").otherwise("hold")
    reasons = F.array_compact(F.array(F.when(F.col("_m"), F.lit("birth_date_missing")), F.when(F.col("_d"), F.lit("birth_dates_differ")), F.when(several & ~merges, F.lit("canonical_unclear"))))
    return out.select(F.col("_id").alias(key), decision.alias("decision"), F.when(merges & ~F.col("_canon"), F.col("_target")).alias("target"), reasons.alias("reasons"))


def absorb_children(children: DataFrame, dup_map: DataFrame, key: str, on: Sequence[str]) -> DataFrame:
    """moved: children of a duplicate that its primary has no match for; kept: those that it has. dup_map: key, primary."""
    m = children.join(dup_map, key)
    held = children.select(F.col(key).alias("primary"), *on, F.lit(True).alias("_has")).distinct()
    return m.join(held, ["primary", *on], "left").withColumn("action", F.when(F.col("_has"), "kept").otherwise("moved")).drop("_has")


def resolve_alias(df: DataFrame, alias: DataFrame, key: str, hops: int = 3) -> DataFrame:
    """key followed through alias (key, target) for at most so many hops."""
    out = df.withColumn("resolved", F.col(key))
    for _ in range(hops):
        step = alias.select(F.col(key).alias("resolved"), F.col("target").alias("_t"))
        out = out.join(step, "resolved", "left").withColumn("resolved", F.coalesce("_t", "resolved")).drop("_t")
    return out


def _columns(band: Column, size: float, km: float) -> Column:
    """Cells in a band of latitude: as many as leave each at least as wide as points within km are apart, one at a pole."""
    top = F.least(F.lit(90.0), (F.greatest(F.abs(band), F.abs(band + 1)) + 1) * size)
    ratio = math.sin(min(km / 6371.0 * 1.001, math.pi) / 2) / F.greatest(F.cos(F.radians(top)), F.lit(1e-12))
    apart = F.when(ratio >= 1, F.lit(360.0)).otherwise(F.degrees(2 * F.asin(F.least(ratio, F.lit(1.0)))))
    return F.greatest(F.lit(1), F.floor(360 / apart)).cast("long")


def nearest_within(points: DataFrame, stations: DataFrame, key: str, station: str, km: float, valid: Column | None = None) -> DataFrame:
    """The nearest station within km. Points and stations have lat and lon. Cells make an equality: bands of latitude of that
    size, cut in longitude as the latitude asks for; a station goes to its own cell and the neighbours in three bands."""
    size = km / 111.0
    band, turn = F.floor(F.col("lat") / size), F.pmod(F.col("lon") + 180, F.lit(360.0)) / 360
    p = points.withColumn("_y", band).withColumn("_x", F.floor(turn * _columns(F.col("_y"), size, km)))
    others = [c for c in stations.columns if c not in (station, "lat", "lon")]
    s = stations.withColumn("_turn", turn).withColumn("_y", F.explode(F.sequence(band - 1, band + 1))).withColumn("_many", _columns(F.col("_y"), size, km))
    here = F.floor(F.col("_turn") * F.col("_many"))
    cells = F.array_distinct(F.array(*(F.pmod(here + step, F.col("_many")) for step in (-1, 0, 1))))
    s = s.select(station, F.col("lat").alias("_lat"), F.col("lon").alias("_lon"), *others, "_y", F.explode(cells).alias("_x"))
    m = p.join(s, ["_y", "_x"]).withColumn("km", haversine_km("lat", "lon", "_lat", "_lon")).where(F.col("km") <= km)
    m = m if valid is None else m.where(valid)
    return m.withColumn("_k", F.row_number().over(Window.partitionBy(key).orderBy("km", station))).where("_k = 1").select(key, station, "km")


def inside_ring(x: Column, y: Column, ring: Column) -> Column:
    """If a point is inside a ring of structs x, y, by crossings of a ray."""
    n = F.size(ring)
    edges = F.zip_with(ring, F.concat(F.slice(ring, F.lit(2), F.greatest(n - 1, F.lit(0))), F.slice(ring, F.lit(1), F.lit(1))), lambda a, b: F.struct(a.alias("a"), b.alias("b")))
    crosses = lambda e: ((e["a"]["y"] > y) != (e["b"]["y"] > y)) & (x < (e["b"]["x"] - e["a"]["x"]) * (y - e["a"]["y"]) / (e["b"]["y"] - e["a"]["y"]) + e["a"]["x"])
    return F.pmod(F.size(F.filter(edges, lambda e: F.coalesce(crosses(e), F.lit(False)))), F.lit(2)) == 1


def contains_join(points: DataFrame, rings: DataFrame, key: str, ring_key: str, cell: float) -> DataFrame:
    """A row a point: verdict match (one ring holds it), review (several) or none. Points: x, y; rings: ring; cells of the rings'
    boxes make an equality. Points of one place meet the rings once, and equal rings are one with their number and least key."""
    b = rings.groupBy("ring").agg(F.count("*").alias("_many"), F.min(ring_key).alias("_ring"))
    b = b.select("*", F.expr("array_min(transform(ring, p -> p.x))").alias("_x0"), F.expr("array_max(transform(ring, p -> p.x))").alias("_x1"), F.expr("array_min(transform(ring, p -> p.y))").alias("_y0"), F.expr("array_max(transform(ring, p -> p.y))").alias("_y1"))
    b = b.withColumn("_cx", F.explode(F.sequence(F.floor(F.col("_x0") / cell), F.floor(F.col("_x1") / cell)))).withColumn("_cy", F.explode(F.sequence(F.floor(F.col("_y0") / cell), F.floor(F.col("_y1") / cell))))
    places = points.select("x", "y").distinct().withColumn("_cx", F.floor(F.col("x") / cell)).withColumn("_cy", F.floor(F.col("y") / cell))
    m = places.join(b, ["_cx", "_cy"]).where((F.col("x") >= F.col("_x0")) & (F.col("x") <= F.col("_x1")) & (F.col("y") >= F.col("_y0")) & (F.col("y") <= F.col("_y1"))).where(inside_ring(F.col("x"), F.col("y"), F.col("ring")))
    g = m.groupBy("x", "y").agg(F.sum("_many").alias("_many"), F.min("_ring").alias("_ring"))
    out = points.select(key, "x", "y").join(g, ["x", "y"], "left").groupBy(key).agg(F.coalesce(F.sum("_many"), F.lit(0)).cast("long").alias("rings"), F.min("_ring").alias("_ring"))
    return out.select(key, "rings", F.when(F.col("rings") == 1, F.col("_ring")).alias(ring_key), F.when(F.col("rings") == 1, "match").when(F.col("rings") > 1, "review").otherwise("none").alias("verdict"))


def nearest_pairs(left: DataFrame, right: DataFrame, by: Sequence[str], a: str, b: str, at: str, reach: float) -> DataFrame:
    """a, b and distance of what assign_exclusive asks of pairs within reach along a line: the two nearest right rows (ties to the
    least b) of each left row, of the same by. at: the place of either side's rows.

    The nearest on either side are those before and after in the order of places, so no pairs are made: rows of a cell as wide as
    the reach and its neighbours pass in order, each way once.
    """
    cell = F.floor(F.col(at) / ((reach or 1) * 1.001))
    told = F.struct(F.col(at).alias("at"), F.col(b).alias("b"))
    known = reduce(lambda x, y: x & y, (F.col(c).isNotNull() for c in [*by, at]))
    l = left.where(known).select(*by, F.col(a).alias("_a"), F.col(at).alias("_at"), cell.alias("_cell"), F.lit(1).alias("_side"))
    r = right.where(known).select(*by, F.col(at).alias("_at"), F.explode(F.array(cell - 1, cell, cell + 1)).alias("_cell"), F.lit(0).alias("_side"), F.col(b).alias("_b"), told.alias("_one"))
    within = lambda *order: Window.partitionBy(*by, "_cell").orderBy(*order)
    up, down = [F.col("_at"), F.col("_side"), F.col("_b").desc()], [F.col("_at").desc(), F.col("_side").desc(), F.col("_b").desc()]
    # of one place the rows of the right come before those of the left on the way up, and after them on the way down
    carried = lambda w: F.last("_two", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0))
    rows = l.unionByName(r, allowMissingColumns=True).repartition(*by, "_cell")
    for name, order in (("_up", up), ("_down", down)):
        rows = rows.withColumn("_two", F.when(F.col("_side") == 0, F.array("_one", F.lag("_one").over(Window.partitionBy(*by, "_cell", "_side").orderBy(*order)))))
        rows = rows.withColumn(name, carried(within(*order)))
    far = F.transform(F.array_compact(F.concat(F.coalesce("_up", F.array().cast(rows.schema["_up"].dataType)), F.coalesce("_down", F.array().cast(rows.schema["_up"].dataType)))), lambda x: F.struct(F.abs(F.col("_at") - x["at"]).alias("distance"), x["b"].alias(b)))
    near = F.slice(F.array_sort(F.filter(far, lambda x: x["distance"] <= reach)), 1, 2)
    return rows.where("_side = 1").select(F.col("_a").alias(a), F.inline(near)).select(a, b, "distance")


def assign_exclusive(pairs: DataFrame, a: str, b: str, distance: str, reach: float, margin: float) -> DataFrame:
    """Of pairs within reach: a takes its nearest b if the next is at least margin farther, and b keeps its nearest taker."""
    held = pairs.where(F.col(distance) <= reach)
    w = Window.partitionBy(a).orderBy(distance, b)
    clear = held.withColumn("_k", F.row_number().over(w)).withColumn("_next", F.lead(distance).over(w)).where("_k = 1").where(F.col("_next").isNull() | (F.col("_next") - F.col(distance) >= margin))
    return clear.withColumn("_k", F.row_number().over(Window.partitionBy(b).orderBy(distance, a))).where("_k = 1").select(a, b, distance)


def hold_shared(df: DataFrame, target: str) -> DataFrame:
    """held: the target is claimed by several rows."""
    return df.withColumn("held", F.col(target).isNotNull() & (F.count("*").over(Window.partitionBy(target)) > 1))


def head_to_head(entries: DataFrame, pairs: DataFrame, event: str, entity: str, position: str, status: str) -> DataFrame:
    """Per pair (a, b): shared events and how often a stood higher, level, or both missed."""
    rank = F.when(F.col(status) == "finished", F.coalesce(position, F.lit(500))).when(F.col(status) == "cut", 900).otherwise(1000)
    e = entries.select(event, F.col(entity), rank.alias("_r"))
    m = pairs.join(e.select(event, F.col(entity).alias("a"), F.col("_r").alias("_ra")), "a").join(e.select(event, F.col(entity).alias("b"), F.col("_r").alias("_rb")), ["b", event])
    missed = (F.col("_ra") >= 900) & (F.col("_rb") >= 900)
    return m.groupBy("a", "b").agg(F.count("*").alias("shared"), F.count_if(~missed & (F.col("_ra") < F.col("_rb"))).alias("a_higher"), F.count_if(~missed & (F.col("_ra") > F.col("_rb"))).alias("b_higher"), F.count_if(~missed & (F.col("_ra") == F.col("_rb"))).alias("level"), F.count_if(missed).alias("both_missed"))


def common_dims(a: DataFrame, b: DataFrame, on: Sequence[str]) -> DataFrame:
    return a.join(b, list(on))


def parity(live: DataFrame, next_: DataFrame, key: str, counts: Sequence[str], fields: Sequence[str], status: str | None = None, ranks: dict | None = None, revocations: DataFrame | None = None) -> DataFrame:
    """Regressions from one version to the next: row_removed, status_downgrade, count_lost and field_missing, with whether a
    revocation (key, allow) explains the kind."""
    l, n = live.select(key, *(F.col(c).alias(f"_l_{c}") for c in [*counts, *fields, *([status] if status else [])])), next_.select(key, *(F.col(c).alias(f"_n_{c}") for c in [*counts, *fields, *([status] if status else [])]), F.lit(True).alias("_there"))
    gone = F.col("_there").isNull()
    found = [F.when(gone, F.lit("row_removed"))]
    if status:
        rank = lambda c: F.element_at(F.create_map(*[F.lit(x) for kv in (ranks or {}).items() for x in kv]), c)
        found.append(F.when(~gone & (rank(F.col(f"_n_{status}")) < rank(F.col(f"_l_{status}"))), F.lit("status_downgrade")))
    found += [F.when(~gone & (F.coalesce(f"_n_{c}", F.lit(0)) < F.coalesce(f"_l_{c}", F.lit(0))), F.lit(f"count_lost:{c}")) for c in counts]
    found += [F.when(~gone & F.col(f"_l_{c}").isNotNull() & F.col(f"_n_{c}").isNull(), F.lit(f"field_missing:{c}")) for c in fields]
    out = l.join(n, key, "left").select(key, F.explode(F.array_compact(F.array(*found))).alias("kind"))
    if revocations is not None:
        out = out.join(revocations.select(key, "allow"), key, "left").withColumn("explained", F.coalesce(F.array_contains("allow", F.split("kind", ":")[0]), F.lit(False))).drop("allow")
    return out


def reconcile(a: DataFrame, b: DataFrame, key: Sequence[str], cols: Sequence[str], by: Sequence[str]) -> DataFrame:
    """Per group: rows compared, missing on either side, and mismatches of any column."""
    l = a.select(*key, *by, *(F.col(c).alias(f"_a_{c}") for c in cols), F.lit(1).alias("_a"))
    r = b.select(*key, *by, *(F.col(c).alias(f"_b_{c}") for c in cols), F.lit(1).alias("_b"))
    on = list(dict.fromkeys([*key, *by]))
    both = F.col("_a").isNotNull() & F.col("_b").isNotNull()
    same = F.lit(True)
    for c in cols:
        same = same & F.col(f"_a_{c}").eqNullSafe(F.col(f"_b_{c}"))
    return l.join(r, on, "full_outer").groupBy(*by).agg(F.count_if(both).alias("compared"), F.count_if(F.col("_b").isNull()).alias("only_a"), F.count_if(F.col("_a").isNull()).alias("only_b"), F.count_if(both & ~same).alias("mismatched"))


def conflicts(a: DataFrame, b: DataFrame, key: str, cols: Sequence[str]) -> DataFrame:
    """A row for each column where both sides have a value and they differ."""
    m = a.select(key, *(F.col(c).cast("string").alias(f"_a_{c}") for c in cols)).join(b.select(key, *(F.col(c).cast("string").alias(f"_b_{c}") for c in cols)), key)
    pairs = F.array(*(F.struct(F.lit(c).alias("field"), F.col(f"_a_{c}").alias("a"), F.col(f"_b_{c}").alias("b")) for c in cols))
    return m.select(key, F.inline(pairs)).where("a <> b")


def pairs_in_top(df: DataFrame, by: Sequence[str], order: Sequence[Column], entity: str, k: int, most: int) -> DataFrame:
    """Pairs i < j of the k first rows of each group, the first so many by (i, j)."""
    r = df.withColumn("_k", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where(F.col("_k") <= k)
    p = r.select(*by, F.col(entity).alias("a"), F.col("_k").alias("i")).join(r.select(*by, F.col(entity).alias("b"), F.col("_k").alias("j")), list(by)).where("i < j")
    return p.withColumn("_n", F.row_number().over(Window.partitionBy(*by).orderBy("i", "j"))).where(F.col("_n") <= most).drop("_n", "i", "j")


def apply_crosswalk(df: DataFrame, xw: DataFrame, by: str, key: str, item: str, n: int) -> DataFrame:
    """verdict applied only if a group's n distinct keys all map to n distinct items, else review. xw: key, item."""
    m = df.join(xw.select(key, item), key, "left")
    return m.groupBy(by).agg(F.count_distinct(key).alias("keys"), F.count_distinct(item).alias("items"), F.count_if(F.col(item).isNull()).alias("missing")).withColumn("verdict", F.when((F.col("keys") == n) & (F.col("items") == n) & (F.col("missing") == 0), "applied").otherwise("review"))


def with_provenance(df: DataFrame, captures: DataFrame, key: str = "capture_id") -> DataFrame:
    return df.join(captures, key, "left")


def missing(df: DataFrame, known: DataFrame, on: Sequence[str]) -> DataFrame:
    return df.join(known, list(on), "left_anti")


def resolve_duplicates(cands: DataFrame, by: str, key: str, agrees: Column) -> DataFrame:
    """The single candidate of each reference; of several, the one that agrees, if it is the only one."""
    w = Window.partitionBy(by)
    c = cands.withColumn("_n", F.count("*").over(w)).withColumn("_ok", F.coalesce(agrees, F.lit(False))).withColumn("_m", F.count_if(F.col("_ok")).over(w))
    return c.where((F.col("_n") == 1) | (F.col("_ok") & (F.col("_m") == 1))).select(by, key)


def detect_renumbering(df: DataFrame, by: str, differs_both: Column, differs_length: Column, least: int = 2) -> DataFrame:
    """withheld: rows whose length differs in groups where at least so many rows differ in both attributes."""
    return df.withColumn("withheld", F.coalesce(differs_length, F.lit(False)) & (F.count_if(F.coalesce(differs_both, F.lit(False))).over(Window.partitionBy(by)) >= least))


def auto_identity(df: DataFrame, proven: str, agree: str, name: str, shared: str, least: int = 15, score: float = 0.75) -> DataFrame:
    return df.withColumn("verdict", F.when(F.coalesce(F.col(shared), F.lit(True)), "shared_name").when(F.col(proven) < least, "not_proven").when(F.col(agree) < least, "lengths_differ").when(F.col(name) < score, "name_differs").otherwise("identity"))
