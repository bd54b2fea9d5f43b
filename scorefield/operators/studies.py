"""Compositions: covariate studies, evidence levels, setups, status reports, planners, narrative facts and guarded publishing."""

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import written
from . import aggregates as A
from . import joins as J
from . import windows as W


def covariate_study(
    scores: DataFrame,
    points: DataFrame,
    stations: DataFrame,
    readings: DataFrame,
    event: str,
    value: str,
    covariate: str,
    km: float = 25.0,
    day: str | None = None,
    edges: Sequence[float] = (),
) -> tuple[DataFrame, DataFrame]:
    """Correlation of values less their event's mean with the mean reading of the nearest station, and values by bins of it.

    points: event, lat, lon; stations: station, lat, lon; readings: station, covariate and, where given, the day that scores
    have too. Without a day an event has one reading, so only the bins tell something.
    """
    near = J.nearest_within(points, stations, event, "station", km)
    days = [] if day is None else [day]
    mean = readings.groupBy("station", *days).agg((F.sum(covariate) / F.count(covariate)).alias(covariate))
    joined = scores.join(near.select(event, "station"), event).join(mean, ["station", *days])
    return A.demeaned_corr(joined, [event], value, covariate), A.binned_effect(joined, covariate, value, edges)


def coordinate_level(cands: DataFrame, key: str, levels: Mapping[str, Column]) -> DataFrame:
    """The first level, in the given order, that exactly one candidate of the key supports; unknown where none does."""
    flags = [F.count_if(F.coalesce(c, F.lit(False))).alias(f"_{n}") for n, c in levels.items()]
    g = cands.groupBy(key).agg(*flags)
    out = None
    for n in levels:
        hit = F.col(f"_{n}") == 1
        out = F.when(hit, n) if out is None else out.when(hit, n)
    return g.select(key, out.otherwise("unknown").alias("level"))


def default_setup(events: DataFrame, items: DataFrame, by: str, event: str, start: str, today, tried: int = 3) -> DataFrame:
    """The latest started event of each group, one with items if any of the latest few has them."""
    begun = events.where(F.col(start) <= F.lit(today).cast("date"))
    latest = begun.withColumn("_k", F.row_number().over(Window.partitionBy(by).orderBy(F.col(start).desc(), F.col(event).desc()))).where(F.col("_k") <= tried)
    held = latest.join(items.select(event).distinct().withColumn("_has", F.lit(True)), event, "left")
    return held.groupBy(by).agg(F.min_by(event, F.struct(F.coalesce(~F.col("_has"), F.lit(True)), "_k")).alias(event))


def status_report(board: DataFrame, by: str, status: str, affected: Sequence[str], text: str, patterns: Sequence[str]) -> DataFrame:
    """rows, affected rows and the first reason that a text of the group gives."""
    from ..functions.scalars import extract_phrase

    found = board.withColumn("_r", extract_phrase(text, patterns))
    return found.groupBy(by).agg(F.count("*").alias("rows"), F.count_if(F.col(status).isin(*affected)).alias("affected"), F.min("_r").alias("reason"))


def plan_rows(parsed: DataFrame, identity: DataFrame, key: str, entity: str, total: str, stated: str) -> tuple[DataFrame, DataFrame]:
    """Rows to write and rows to hold: without an identity, or whose parts don't sum to what is published."""
    m = parsed.join(identity.select(key, entity), key, "left")
    reason = F.when(F.col(entity).isNull(), "no_identity").when(~F.coalesce(F.col(total) == F.col(stated), F.lit(False)), "total_differs")
    m = m.withColumn("reason", reason)
    return m.where("reason is null").drop("reason"), m.where("reason is not null")


def narrative_facts(scores: DataFrame, last: int, event: str = "event_id", entity: str = "entity_id") -> DataFrame:
    """Comeback, wire-to-wire and surge of each entity, as rows event, entity, fact, value."""
    came = W.comeback(scores, last, event, entity).where("deficit > 0").select(event, entity, F.lit("comeback").alias("fact"), F.col("deficit").cast("double").alias("value"))
    led = W.wire_to_wire(scores, event, entity).select(event, entity, F.lit("wire_to_wire").alias("fact"), F.col("periods").cast("double").alias("value"))
    surge = W.narrative_signals(scores, event=event, entity=entity).where("surge and n >= 3").select(event, entity, F.lit("surge").alias("fact"), F.col("improvement").cast("double").alias("value"))
    return came.unionByName(led).unionByName(surge)


#: Items of a card and of its first half, the first of the closing items, how near contention is, how long a run is, and how high a percentile a strength is.
CARD, HALF, CLOSING, CONTENTION, RUN, STRENGTH = 18, 9, 13, 3, 3, 80


def champion_facts(winners: DataFrame, scores: DataFrame, items: DataFrame, strengths: DataFrame, last: int, event: str = "event_id", entity: str = "entity_id") -> DataFrame:
    """event, entity, fact and value of each winner, from scores (period, to_par) and cards (items: period, item, to_par and
    item_class); strengths: entity, item_class, percentile.

    Progress, where all periods are there: after_<k> (total after period k), spread (worst period less best). Entering the last
    period: ahead_entering (how many were ahead, if any), lead_entering (to the next, if alone in the lead). Contention:
    within_three (others who ended within three, if any). The last card, if whole: front, back, closing (items 13 to 18), birdies, eagles
    (two under or better, if any), bogeys, and run (the longest of three or more under par in a row, not across the turn). The
    week by class, if all cards are whole: class_<c>. metric_match: the class that alone is lowest and under par, if it is also a strength (percentile 80
    or more). What a rule cannot show gives no row; unknown scores count as missing. Each rule is a grouped sum or a join on the event.
    """
    ids = [event, entity]
    w = winners.select(*ids).distinct()
    s = scores.where((F.col("period") <= last) & F.col("to_par").isNotNull()).select(*ids, "period", F.col("to_par").cast("long").alias("v"))
    fact = lambda df, *named: df.select(*ids, F.inline(F.filter(F.array(*(F.struct((F.lit(n) if isinstance(n, str) else n).alias("fact"), v.cast("double").alias("value")) for n, v in named)), lambda x: x["value"].isNotNull())))
    upto = lambda k: s.where(F.col("period") <= k).groupBy(*ids).agg(F.count("*").alias("n"), F.sum("v").alias("total"), (F.max("v") - F.min("v")).alias("spread")).where(F.col("n") == k)
    whole = upto(last)
    mine = s.join(w, ids, "left_semi").join(whole.select(*ids), ids, "left_semi")
    running = mine.withColumn("so_far", F.sum("v").over(Window.partitionBy(*ids).orderBy("period"))).where(F.col("period") < last)
    out = [fact(running, (F.concat(F.lit("after_"), F.col("period").cast("string")), F.col("so_far"))), fact(whole.join(w, ids), ("spread", F.col("spread")))]

    def against(board: DataFrame) -> DataFrame:
        own = board.join(w, ids).select(*ids, F.col("total").alias("own"))
        return board.select(event, "total").join(own, event).groupBy(*ids, "own").agg(F.count_if(F.col("total") < F.col("own")).alias("ahead"), F.count_if(F.col("total") == F.col("own")).alias("level"), F.min(F.when(F.col("total") > F.col("own"), F.col("total"))).alias("next"), F.count_if(F.col("total") - F.col("own") <= CONTENTION).alias("near"))

    if last > 1:
        before = against(upto(last - 1))
        out.append(fact(before, ("ahead_entering", F.when(F.col("ahead") > 0, F.col("ahead"))), ("lead_entering", F.when((F.col("ahead") == 0) & (F.col("level") == 1), F.col("next") - F.col("own")))))
    out.append(fact(against(whole), ("within_three", F.when(F.col("near") > 1, F.col("near") - 1))))

    held = items.join(w, ids, "left_semi").where((F.col("period") <= last) & F.col("to_par").isNotNull() & F.col("item").between(1, CARD)).select(*ids, "period", "item", F.col("to_par").cast("long").alias("v"), "item_class")
    card = held.where(F.col("period") == last)
    some = lambda c: F.sum(F.when(c, F.col("v")).otherwise(0))
    lines = card.groupBy(*ids).agg(F.count_distinct("item").alias("n"), F.count("*").alias("rows"), some(F.col("item") <= HALF).alias("front"), some(F.col("item") > HALF).alias("back"), some(F.col("item") >= CLOSING).alias("closing"), F.count_if(F.col("v") == -1).alias("birdies"), F.count_if(F.col("v") <= -2).alias("eagles"), F.count_if(F.col("v") > 0).alias("bogeys"))
    lines = lines.where((F.col("n") == CARD) & (F.col("rows") == CARD))
    out.append(fact(lines, *((c, F.col(c)) for c in ("front", "back", "closing", "birdies", "bogeys")), ("eagles", F.when(F.col("eagles") > 0, F.col("eagles")))))
    under = card.join(lines.select(*ids), ids, "left_semi").where("v < 0").withColumn("half", F.col("item") <= HALF)
    island = F.col("item") - F.row_number().over(Window.partitionBy(*ids, "half").orderBy("item"))
    runs = under.withColumn("island", island).groupBy(*ids, "half", "island").agg(F.count("*").alias("n")).groupBy(*ids).agg(F.max("n").alias("n"))
    out.append(fact(runs, ("run", F.when(F.col("n") >= RUN, F.col("n")))))

    every = held.groupBy(*ids).agg(F.count_distinct("period", "item").alias("n"), F.count("*").alias("rows")).where((F.col("n") == CARD * last) & (F.col("rows") == CARD * last))
    week = held.join(every.select(*ids), ids, "left_semi").groupBy(*ids, "item_class").agg(F.sum("v").alias("v"))
    out.append(fact(week, (F.concat(F.lit("class_"), F.col("item_class").cast("string")), F.col("v"))))
    lowest = week.groupBy(*ids).agg(F.min("v").alias("v"), F.min_by("item_class", "v").alias("item_class"), F.array_agg("v").alias("all"))
    alone = lowest.where((F.col("v") < 0) & (F.size(F.filter("all", lambda x: x == F.col("v"))) == 1))
    strong = strengths.where(F.col("percentile") >= STRENGTH).select(entity, "item_class").distinct()
    out.append(fact(alone.join(strong, [entity, "item_class"]), ("metric_match", F.col("item_class"))))
    return reduce(DataFrame.unionByName, out)


#: Edges of a cell that all its points meet first, and how many times as many each later round has met.
FIRST_EDGES, MORE_EDGES = 128, 16


def near_boundary_join(points: DataFrame, rings: DataFrame, key: str, ring_key: str, reach: float, overlap: Column, least: float = 0.5) -> DataFrame:
    """The one ring whose boundary is within reach of a point and whose name agrees enough; several or none give no row.
    Points: x, y; rings: ring; cells of the widened boxes of the rings' edges make an equality.

    Points of crowded cells meet its edges in rounds, some at first and many times more in each later one. Who has met two rings that
    are near has no row whatever the others are, and stays out of the rounds to come; who has met none or one meets them all. Each round is a
    written table of a row a point with a near ring.
    """
    size, wide = reach * 2, reach * 1.001
    nth = lambda by, *order: F.row_number().over(Window.partitionBy(by).orderBy(*order))  # noqa: E731  # tells rows of one key apart
    same = F.when(F.col(ring_key).isNull(), -nth(ring_key, "ring")).otherwise(nth(ring_key, "ring"))
    turned = F.concat(F.slice("ring", F.lit(2), F.greatest(F.size("ring") - 1, F.lit(0))), F.slice("ring", F.lit(1), F.lit(1)))
    edge = F.zip_with("ring", turned, lambda a, b: F.struct(a["x"].alias("_ax"), a["y"].alias("_ay"), b["x"].alias("_bx"), b["y"].alias("_by"), F.sqrt(F.pow(b["x"] - a["x"], 2) + F.pow(b["y"] - a["y"], 2)).alias("_long")))
    b = rings.withColumn("_same", same).select("*", F.inline(edge))
    low, high = lambda c: F.least(f"_a{c}", f"_b{c}") - wide, lambda c: F.greatest(f"_a{c}", f"_b{c}") + wide
    for c in ("x", "y"):
        b = b.withColumn(f"_c{c}", F.explode(F.sequence(F.floor(low(c) / size), F.floor(high(c) / size))))
    most = b.groupBy("_cx", "_cy").count().agg(F.max("count")).first()[0] or 0
    cells = points.withColumn("_point", nth(key, "x", "y", F.xxhash64(*points.columns))).withColumn("_cx", F.floor(F.col("x") / size)).withColumn("_cy", F.floor(F.col("y") / size))
    told = (ring_key, "_same", "_point")
    ends = lambda lo, hi: [*(F.min(c).alias(f"_lo{i}") for i, c in enumerate(lo)), *(F.max(c).alias(f"_hi{i}") for i, c in enumerate(hi)), F.min("distance").alias("distance")]

    def near(p: DataFrame, some: DataFrame) -> DataFrame:
        x, y, ax, ay, bx, by = (F.col(c) for c in ("x", "y", "_ax", "_ay", "_bx", "_by"))
        t = F.when(F.col("_long") > 0, F.greatest(F.lit(0.0), F.least(F.lit(1.0), ((x - ax) * (bx - ax) + (y - ay) * (by - ay)) / F.pow("_long", 2)))).otherwise(0.0)
        inside = x.between(low("x"), high("x")) & y.between(low("y"), high("y"))
        m = p.join(some, ["_cx", "_cy"]).where(inside & (overlap >= least)).withColumn("_t", t)
        m = m.withColumn("distance", F.sqrt(F.pow(x - ax - F.col("_t") * (bx - ax), 2) + F.pow(y - ay - F.col("_t") * (by - ay), 2))).where(F.col("distance") <= reach)
        return m.groupBy(key).agg(*ends(told, told))

    one = F.col("_lo0").eqNullSafe(F.col("_hi0")) & (F.col("_lo1") == F.col("_hi1")) & (F.col("_lo2") == F.col("_hi2"))
    named = [key, F.col("_lo0").alias(ring_key), "distance"]
    if most <= FIRST_EDGES:
        return near(cells, b).where(one).select(*named)
    order = Window.partitionBy("_cx", "_cy").orderBy(F.xxhash64(ring_key, "_ax", "_ay"), ring_key, "_same", "_ax", "_ay", "_bx", "_by")
    dealt = written(b.withColumn("_nth", F.row_number().over(order)), "dealt-edges")
    found, done, upto = None, 0, FIRST_EDGES
    while done < most:
        open_ = cells if found is None else cells.join(found.where(~one).select(key), key, "left_anti")
        met = near(open_, dealt.where((F.col("_nth") > done) & (F.col("_nth") <= upto)))
        met = met if found is None else found.unionByName(met).groupBy(key).agg(*ends([f"_lo{i}" for i in range(3)], [f"_hi{i}" for i in range(3)]))
        found, done, upto = written(met, "near-rings"), upto, upto * MORE_EDGES
    return found.where(one).select(*named)


def item_intelligence(routes: DataFrame, features: DataFrame, by: Sequence[str], reach: float) -> DataFrame:
    """Per item: length, shape and the features within reach of its route with their distance along it and side."""
    from ..functions.scalars import nearest_on_route, polyline_length, route_shape

    r = routes.withColumn("length", polyline_length("points")).withColumn("shape", route_shape("points", "item_class"))
    m = features.join(r, list(by)).withColumn("_at", nearest_on_route("x", "y", "points")).where(F.col("_at.distance") <= reach)
    near = m.groupBy(*by).agg(F.array_sort(F.collect_list(F.struct(F.col("_at.along").alias("along"), "kind", F.col("_at.side").alias("side")))).alias("features"))
    return r.select(*by, "length", "shape").join(near, list(by), "left")


def nest(base: DataFrame, key: str, parts: Mapping[str, tuple[DataFrame, Sequence[str]]]) -> DataFrame:
    """A document a row of base: its columns, and for each part (name -> rows with the key, and columns that order them) an
    array of the key's rows; empty where it has none. An array holds what one document shows of a key (its seasons, say)."""
    for name, (df, order) in parts.items():
        columns = [*order, *(c for c in df.columns if c != key and c not in order)]
        rows = df.groupBy(key).agg(F.array_sort(F.collect_list(F.struct(*columns))).alias(name))
        base = base.join(rows, key, "left").withColumn(name, F.coalesce(name, F.array().cast(rows.schema[name].dataType)))
    return base


def bundle(docs: Mapping[str, DataFrame], key: str, least: int = 1) -> DataFrame:
    """kind, key and doc (JSON) of all kinds; refuses if a kind has fewer rows than least."""
    out = None
    for kind, df in docs.items():
        if len(df.take(least)) < least:
            raise ValueError(f"{kind} has fewer than {least} documents")
        row = df.select(F.lit(kind).alias("kind"), F.col(key).cast("string").alias("key"), F.to_json(F.struct(*sorted(df.columns))).alias("doc"))
        out = row if out is None else out.unionByName(row)
    return out
