"""Scalar, array, map, JSON and date functions: columns in, a column out. Unknown stays null and is never made zero."""

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Accented Latin letters and their base letters.
ACCENTED = "áàâäãåāéèêëēíìîïīóòôöõōúùûüūñçýÿšžÁÀÂÄÃÅĀÉÈÊËĒÍÌÎÏĪÓÒÔÖÕŌÚÙÛÜŪÑÇÝŠŽ"
PLAIN = "aaaaaaaeeeeeiiiiioooooouuuuuncyyszAAAAAAAEEEEEIIIIIOOOOOOUUUUUNCYSZ"
#: Compass points of 22.5 degrees, from north clockwise.
COMPASS = ["N", "NNE", "NE", "ENE", "E", "ESE", "SE", "SSE", "S", "SSW", "SW", "WSW", "W", "WNW", "NW", "NNW"]
#: Sample sizes of the tiers HIGH, MEDIUM and LIMITED by basis.
TIERS = {"holes": (200, 100, 36), "rounds": (40, 20, 8), "starts": (12, 6, 3), "events": (6, 3, 2)}
MONTHS = ["january", "february", "march", "april", "may", "june", "july", "august", "september", "october", "november", "december"]


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def fold(col) -> Column:
    """Without accents, lower case, anything but letters and digits as one space, trimmed."""
    return F.trim(F.regexp_replace(F.lower(F.translate(_c(col), ACCENTED, PLAIN)), "[^a-z0-9]+", " "))


def slugify(col, id_col=None) -> Column:
    slug = F.regexp_replace(fold(col), " ", "-")
    return slug if id_col is None else F.concat_ws("-", slug, _c(id_col).cast("string"))


def stable_id(*cols) -> Column:
    """The SHA-256 of the joined key in the shape of a version 5 UUID."""
    h = F.sha2(F.concat_ws(":", *(_c(c).cast("string") for c in cols)), 256)
    return F.concat(F.substring(h, 1, 8), F.lit("-"), F.substring(h, 9, 4), F.lit("-5"), F.substring(h, 14, 3), F.lit("-a"), F.substring(h, 18, 3), F.lit("-"), F.substring(h, 21, 12))


def canonical_hash(*cols: str) -> Column:
    """The SHA-256 of the JSON of the columns in the order of their names, nulls kept."""
    return F.sha2(F.to_json(F.struct(*(F.col(c) for c in sorted(cols))), {"ignoreNullFields": "false"}), 256)


def to_par(col) -> Column:
    """E is 0, signed numbers are themselves (a minus sign of any kind), anything else is unknown."""
    t = F.trim(F.translate(_c(col), "−–", "--"))
    return F.when(F.upper(t) == "E", F.lit(0)).when(t.rlike(r"^[+-]?\d+$"), F.regexp_replace(t, r"^\+", "").cast("int"))


def to_par_text(col) -> Column:
    c = _c(col)
    return F.when(c == 0, "E").when(c > 0, F.concat(F.lit("+"), c.cast("string"))).otherwise(c.cast("string"))


def score_cell(col) -> Column:
    """`72-66-66-73=277`: periods, total and if they agree."""
    t = F.regexp_replace(F.translate(_c(col), "−–", "--"), r"\s", "")
    periods = F.transform(F.split(F.regexp_extract(t, r"^(\d+(?:-\d+)*)", 1), "-"), lambda x: x.try_cast("int"))
    total = F.regexp_extract(t, r"=(\d+)$", 1).try_cast("int")
    return F.struct(F.filter(periods, lambda x: x.isNotNull()).alias("periods"), total.alias("total"), (F.aggregate(periods, F.lit(0), lambda a, x: a + F.coalesce(x, F.lit(0))) == total).alias("consistent"))


def place_cell(col) -> Column:
    """`T8`, `CUT`, `WD`: position, tied and status."""
    t = F.upper(F.trim(_c(col)))
    position = F.regexp_extract(t, r"^T?(\d+)$", 1).try_cast("int")
    status = F.when(position.isNotNull(), "finished").when(t.isin("CUT", "MC"), "cut").when(t == "WD", "withdrawn").when(t.isin("DQ", "DSQ"), "disqualified").otherwise("unknown")
    return F.struct(position.alias("position"), F.when(position.isNotNull(), t.startswith("T")).alias("tied"), status.alias("status"))


def date_range(col) -> Column:
    """`April 10–13, 2025`, `March 30 – April 2, 2025` or `May 4, 2025`: start and end."""
    t = F.regexp_replace(F.lower(F.translate(_c(col), "–—", "--")), r"\s+", " ")
    month = lambda name: F.nullif(F.array_position(F.array(*(F.lit(m) for m in MONTHS)), name), F.lit(0)).cast("int")
    pattern = r"([a-z]+) (\d{1,2})(?: ?- ?(?:([a-z]+) )?(\d{1,2}))?, (\d{4})"
    g = [F.regexp_extract(t, pattern, i) for i in range(1, 6)]
    year = g[4].try_cast("int")
    start = F.try_make_date(year, month(g[0]), g[1].try_cast("int")) if hasattr(F, "try_make_date") else F.make_date(year, month(g[0]), g[1].try_cast("int"))
    last_month = F.when(g[2] == "", g[0]).otherwise(g[2])
    end = F.when(g[3] == "", start).otherwise(F.make_date(year, month(last_month), g[3].try_cast("int")))
    return F.struct(start.alias("start"), end.alias("end"))


def week_bounds(col) -> Column:
    monday = F.date_trunc("week", _c(col)).cast("date")
    return F.struct(monday.alias("first"), F.date_add(monday, 6).alias("last"))


def age_at(birth, as_of) -> Column:
    return F.floor(F.months_between(_c(as_of), _c(birth)) / 12).cast("long")


def parse_speed(col) -> Column:
    """`10 to 15 mph` is 12.5, `8 mph` is 8; anything else is unknown."""
    a = F.regexp_extract(_c(col), r"(\d+(?:\.\d+)?)", 1).try_cast("double")
    b = F.regexp_extract(_c(col), r"\d\s*(?:to|-)\s*(\d+(?:\.\d+)?)", 1).try_cast("double")
    return (a + F.coalesce(b, a)) / 2


def compass(deg) -> Column:
    return F.element_at(F.array(*(F.lit(x) for x in COMPASS)), (F.pmod(F.floor(_c(deg) / 22.5 + 0.5), F.lit(16)) + 1).cast("int"))


def c_to_f(col) -> Column:
    return _c(col) * 9 / 5 + 32


def wind_components(from_deg, speed, bearing) -> Column:
    """Head (positive against) and cross (positive from the right) parts, and a label by sectors of 45 degrees."""
    turn = F.pmod(_c(from_deg) - _c(bearing), F.lit(360.0))
    a = F.radians(turn)
    label = F.when((turn <= 22.5) | (turn >= 337.5), "headwind").when((turn >= 157.5) & (turn <= 202.5), "tailwind").when(turn < 180, F.when((turn >= 67.5) & (turn <= 112.5), "cross from right").otherwise("quartering right")).otherwise(F.when((turn >= 247.5) & (turn <= 292.5), "cross from left").otherwise("quartering left"))
    return F.struct((F.cos(a) * _c(speed)).alias("head"), (F.sin(a) * _c(speed)).alias("cross"), label.alias("label"))


def haversine_km(lat1, lon1, lat2, lon2) -> Column:
    p, q = F.radians(_c(lat1)), F.radians(_c(lat2))
    h = F.pow(F.sin((q - p) / 2), 2) + F.cos(p) * F.cos(q) * F.pow(F.sin(F.radians(_c(lon2) - _c(lon1)) / 2), 2)
    return F.lit(2 * 6371.0) * F.asin(F.sqrt(F.least(h, F.lit(1.0))))


def bearing(lat1, lon1, lat2, lon2) -> Column:
    p, q, d = F.radians(_c(lat1)), F.radians(_c(lat2)), F.radians(_c(lon2) - _c(lon1))
    return F.pmod(F.degrees(F.atan2(F.sin(d) * F.cos(q), F.cos(p) * F.sin(q) - F.sin(p) * F.cos(q) * F.cos(d))), F.lit(360.0))


def polyline_length(pts) -> Column:
    """Of an array of structs x, y."""
    p = _c(pts)
    steps = F.zip_with(F.slice(p, F.lit(1), F.greatest(F.size(p) - 1, F.lit(0))), F.slice(p, F.lit(2), F.greatest(F.size(p) - 1, F.lit(0))), lambda a, b: F.sqrt(F.pow(b["x"] - a["x"], 2) + F.pow(b["y"] - a["y"], 2)))
    return F.aggregate(steps, F.lit(0.0), lambda s, x: s + x)


def centroid(pts) -> Column:
    p = _c(pts)
    mean = lambda k: F.aggregate(p, F.lit(0.0), lambda s, q: s + q[k]) / F.size(p)
    return F.when(F.size(p) > 0, F.struct(mean("x").alias("x"), mean("y").alias("y")))


def token_overlap(a, b, stop: Sequence[str] = ()) -> Column:
    """Shared words over the smaller number of words, without stop words; null if either side has none."""
    stops = F.array(*(F.lit(s) for s in stop)) if stop else F.array().cast("array<string>")
    words = lambda c: F.array_except(F.array_distinct(F.split(fold(c), " ")), F.array_union(stops, F.array(F.lit(""))))
    x, y = words(a), words(b)
    least = F.least(F.size(x), F.size(y))
    return F.when(least > 0, F.size(F.array_intersect(x, y)) / least)


def round_half_up(col, dp: int = 0) -> Column:
    """Half goes up, toward plus infinity."""
    return F.floor(_c(col) * F.lit(float(10**dp)) + 0.5) / float(10**dp)


def tier(basis: str, n) -> Column:
    high, medium, low = TIERS[basis]
    return F.when(_c(n) >= high, "HIGH").when(_c(n) >= medium, "MEDIUM").when(_c(n) >= low, "LIMITED").otherwise("INSUFFICIENT")


def result_kind(diff) -> Column:
    d = _c(diff)
    return F.when(d.isNull(), None).when(d <= -2, "eagle").when(d == -1, "under").when(d == 0, "par").when(d == 1, "over").otherwise("double")


def to_local(ts, tz=None, lon=None) -> Column:
    """In the named zone; where none is known, by the solar offset of the longitude."""
    solar = _c(ts) + F.make_dt_interval(hours=F.floor(_c(lon) / 15 + 0.5).cast("int"))
    return solar if tz is None else F.when(_c(tz).isNotNull(), F.from_utc_timestamp(_c(ts), _c(tz))).otherwise(solar)


def ordinal(col) -> Column:
    n = _c(col)
    teen = F.pmod(n, F.lit(100)).between(11, 13)
    last = F.pmod(n, F.lit(10))
    return F.concat(n.cast("string"), F.when(teen, "th").when(last == 1, "st").when(last == 2, "nd").when(last == 3, "rd").otherwise("th"))


def join_words(arr) -> Column:
    a = _c(arr)
    n = F.size(a)
    return F.when(n <= 1, F.array_join(a, "")).otherwise(F.concat(F.array_join(F.slice(a, F.lit(1), n - 1), ", "), F.lit(" and "), F.element_at(a, -1)))


def extract_phrase(col, patterns: Sequence[str]) -> Column:
    """The first group of the first pattern that matches; null if none does."""
    return F.coalesce(*(F.nullif(F.regexp_extract(_c(col), p, 1), F.lit("")) for p in patterns))


def json_path(col, path: str) -> Column:
    return F.get_json_object(_c(col), path)


def explode_interval(df: DataFrame, start: str, end: str, step: str = "1 hour", out: str = "at") -> DataFrame:
    """A row for each step from start up to before end."""
    last = F.col(end) - F.expr(f"interval {step}")
    return df.where(F.col(end) > F.col(start)).withColumn(out, F.explode(F.sequence(F.col(start), F.greatest(F.col(start), last), F.expr(f"interval {step}"))))


def undo_cumulative(arr, start: int = 0) -> Column:
    """Differences of a cumulative series from a start."""
    a = _c(arr)
    return F.zip_with(a, F.concat(F.array(F.lit(start).cast("long")), F.transform(F.slice(a, F.lit(1), F.greatest(F.size(a) - 1, F.lit(0))), lambda x: x.cast("long"))), lambda x, p: x - p)


def period_from_text(col, last: int = 4) -> Column:
    t = F.lower(_c(col))
    return F.when(t.rlike(r"\bfinal round\b"), F.lit(last)).otherwise(F.regexp_extract(t, r"\bround (\d)\b", 1).try_cast("int"))


def canon_label(col, aliases: Mapping[str, str]) -> Column:
    pairs = [F.lit(x) for kv in aliases.items() for x in kv]
    return F.coalesce(F.try_element_at(F.create_map(*pairs), F.upper(F.trim(_c(col)))), F.trim(_c(col)))


def mask_text(col, pattern: str, repl: str = "***") -> Column:
    return F.regexp_replace(_c(col), pattern, repl)


def sanitize_params(map_col, allow: Sequence[str]) -> Column:
    """Entries whose keys are allowed and whose values look like slugs."""
    return F.map_filter(_c(map_col), lambda k, v: k.isin(*allow) & v.rlike("^[a-z0-9][a-z0-9-]{0,63}$"))


def name_keys(col) -> Column:
    """Keys under which variants of a name meet: its words in order of the alphabet, and its first or last word beside the others
    written as one, in that order too. Hyphens, apostrophes and periods inside words vanish. One word is its own key, and no
    word has none."""
    words = F.filter(F.split(fold(F.regexp_replace(_c(col), "[-’'`.]", "")), " "), lambda x: x != "")
    key = lambda parts: F.array_join(F.array_sort(parts), " ")
    whole = lambda parts: F.array_join(parts, "")
    n = F.size(words)
    ends = [F.array(F.get(words, F.lit(0)), whole(F.slice(words, 2, n))), F.array(F.get(words, n - 1), whole(F.slice(words, 1, n - 1)))]
    return F.when(n > 1, F.array_distinct(F.array(key(words), *(key(e) for e in ends)))).otherwise(words)


def sub_tokens(col) -> Column:
    """Words of a parenthesised part."""
    inner = F.regexp_extract(_c(col), r"\(([^)]*)\)", 1)
    return F.filter(F.split(fold(inner), " "), lambda x: x != "")


def long_to_map(df: DataFrame, key: Sequence[str], code: str, value: str, out: str = "values") -> DataFrame:
    """A row a key with a map from code to value; nulls are left out."""
    return df.where(F.col(value).isNotNull()).groupBy(*key).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct(code, value)))).alias(out))


def nearest_on_route(x, y, pts) -> Column:
    """Nearest point of a polyline: distance, along (from its start) and side (1 left, -1 right, 0 on it)."""
    p = _c(pts)
    n = F.greatest(F.size(p) - 1, F.lit(0))
    legs = F.zip_with(F.slice(p, F.lit(1), n), F.slice(p, F.lit(2), n), lambda a, b: F.struct(a.alias("a"), b.alias("b"), F.sqrt(F.pow(b["x"] - a["x"], 2) + F.pow(b["y"] - a["y"], 2)).alias("l")))
    px, py = _c(x), _c(y)

    def step(s, leg):
        ax, ay, bx, by = leg["a"]["x"], leg["a"]["y"], leg["b"]["x"], leg["b"]["y"]
        t = F.when(leg["l"] > 0, F.greatest(F.lit(0.0), F.least(F.lit(1.0), ((px - ax) * (bx - ax) + (py - ay) * (by - ay)) / F.pow(leg["l"], 2)))).otherwise(0.0)
        d = F.sqrt(F.pow(px - ax - t * (bx - ax), 2) + F.pow(py - ay - t * (by - ay), 2))
        side = F.signum((bx - ax) * (py - ay) - (by - ay) * (px - ax)).cast("double")
        near = s["d"].isNull() | (d < s["d"])
        return F.struct((s["run"] + leg["l"]).alias("run"), F.when(near, d).otherwise(s["d"]).alias("d"), F.when(near, s["run"] + t * leg["l"]).otherwise(s["along"]).alias("along"), F.when(near, side).otherwise(s["side"]).alias("side"))

    none = F.lit(None).cast("double")
    out = F.aggregate(legs, F.struct(F.lit(0.0).alias("run"), none.alias("d"), none.alias("along"), none.alias("side")), step)
    return F.struct(out["d"].alias("distance"), out["along"].alias("along"), out["side"].alias("side"))


def route_shape(pts, item_class) -> Column:
    """straight, dogleg left or right by the vertex farthest from the chord; null where the bend is unclear, for class 3, for
    fewer than three points and for chords under 50."""
    p = _c(pts)
    a, b = F.element_at(p, 1), F.element_at(p, -1)
    chord = F.sqrt(F.pow(b["x"] - a["x"], 2) + F.pow(b["y"] - a["y"], 2))
    inner = F.slice(p, F.lit(2), F.greatest(F.size(p) - 2, F.lit(0)))
    bend = F.array_max(F.transform(inner, lambda q: F.struct(F.abs((b["x"] - a["x"]) * (q["y"] - a["y"]) - (b["y"] - a["y"]) * (q["x"] - a["x"])).alias("o"), q["x"].alias("x"), q["y"].alias("y"))))
    turn = F.degrees(F.atan2(b["y"] - bend["y"], b["x"] - bend["x"]) - F.atan2(bend["y"] - a["y"], bend["x"] - a["x"]))
    turn = F.pmod(turn + 180, F.lit(360.0)) - 180
    usable = (F.size(p) >= 3) & (_c(item_class) != 3) & (chord >= 50)
    return F.when(usable, F.when((F.abs(turn) >= 20) & (bend["o"] / chord >= 20), F.when(turn > 0, "dogleg left").otherwise("dogleg right")).when(F.abs(turn) < 12, "straight"))


def route_markers(pts, marks: Sequence[float]) -> Column:
    """The points of a polyline at given distances before its end; those longer than it are left out."""
    p = _c(pts)
    n = F.greatest(F.size(p) - 1, F.lit(0))
    legs = F.zip_with(F.slice(p, F.lit(1), n), F.slice(p, F.lit(2), n), lambda a, b: F.struct(a.alias("a"), b.alias("b"), F.sqrt(F.pow(b["x"] - a["x"], 2) + F.pow(b["y"] - a["y"], 2)).alias("l")))
    total = polyline_length(p)

    def at(mark):
        goal = total - mark
        end = F.struct(F.lit(0.0).alias("run"), F.lit(None).cast("double").alias("x"), F.lit(None).cast("double").alias("y"))

        def step(s, leg):
            here = s["x"].isNull() & (s["run"] + leg["l"] >= goal) & (leg["l"] > 0)
            t = (goal - s["run"]) / leg["l"]
            return F.struct((s["run"] + leg["l"]).alias("run"), F.when(here, leg["a"]["x"] + t * (leg["b"]["x"] - leg["a"]["x"])).otherwise(s["x"]).alias("x"), F.when(here, leg["a"]["y"] + t * (leg["b"]["y"] - leg["a"]["y"])).otherwise(s["y"]).alias("y"))

        return F.when(goal >= 0, F.aggregate(legs, end, step, lambda s: F.struct(mark.alias("mark"), s["x"].alias("x"), s["y"].alias("y"))))

    return F.array_compact(F.transform(F.array(*(F.lit(float(m)) for m in marks)), at))
