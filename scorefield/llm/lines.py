"""Line dedup: an exact set-similarity join between lines, in DataFrame functions only.

A line's tokens are its words, each once. A line goes if an earlier one has the same text or a Jaccard similarity of 0.8 or
more. Lines of the same text are collapsed to their first place; all others meet by keys.

Which keys. Two similar lines of n and m tokens differ in at most (n + m) / 9 tokens, both ways together. Deal the tokens of a
line into buckets by their hashes; a token that differs spoils one bucket, so of the filled buckets of each line all but
(n + m) / 9 are the same in the other, tokens and all. Take these whole buckets as the elements of a line, in an order that
depends on their content only: within the first (n + m) / 9 + 2 of both lines there are two common ones (prefix filter). The order
puts buckets of many letters first, for long words are rare and several words together rarer; so a key has few lines, where
single words have ever more as the corpus grows. Two further elements that all lines of a level have come last in the order, so
that a line of fewer filled buckets has keys enough.

How many buckets depends on n + m, in classes (levels) that double: a line takes part in the level of its least and of its
greatest possible n + m, which are the same or neighbours.

Lines of one key are sorted by place. Each meets the first and the HEAVY lines before it; sizes and a sketch (64 or 128
parities of the tokens, of which similar lines differ in no more than in tokens) leave nearly only similar ones, which are
verified on all their tokens, one for each key, and what else passed for lines that are not found so. That is all for keys of so
few lines. Similar lines that share no such key share two keys of more lines: each two of a line's larger keys make a key
together, which few lines share, and these meet in the same way. Where even those are large, a line that is still not found meets
the lines further before, in three steps, the last without end. So a group of near copies makes a few pairs a line.
"""

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import LOWEST, discard, materialize, read_table

#: The similarity as a fraction, so that bounds are exact.
NUM, DEN = 4, 5
#: How many lines before it a line of a key meets at first, besides the first one.
HEAVY = 16
#: The most tokens that two similar lines share for certain in their windows.
DEPTH = 3
#: Low bits of a token that hold the length of its word, and how many buckets a level has beyond the least number.
SLOT_BITS, LEAST = 8, 4
#: Low bits of a key that hold its level.
LEVEL_BITS = 5
#: Lines of more tokens than this carry a second sketch.
LONG = 64
SPACES = "\t\x0b\x0c\r"
#: A list of lines goes to all tasks if it names so many at most (some 10 MB), and is joined by shuffling beyond that.
BROADCAST_LINES = 1_000_000


def words(line: Column) -> Column:
    odd = reduce(lambda a, b: a | b, (F.contains(line, F.lit(c)) for c in SPACES))
    return F.array_remove(F.split(F.when(odd, F.translate(line, SPACES, "    ")).otherwise(line), " "), "")


def tokens(line: Column) -> Column:
    """Distinct hashes of a line's words in order; none for a blank line."""
    return F.sort_array(F.array_distinct(F.transform(words(line), lambda x: F.xxhash64(x))))


def _blank(line: str) -> Column:
    return F.btrim(line, F.lit(" " + SPACES)) == ""


def _sized(word: Column) -> Column:
    """48 bits of a word's hash, and its length in the low bits: sums of these keep both."""
    return F.shiftleft(F.shiftrightunsigned(F.xxhash64(word), 16), SLOT_BITS).bitwiseOR(F.least(F.octet_length(word), F.lit(31)).cast("long"))


def lacking(n: Column) -> Column:
    """How many tokens of n a similar line may lack."""
    return n - F.ceil(n * NUM / DEN).cast("int")


def window(n: Column) -> Column:
    """How many tokens in order of hash are looked at: 0.4 n + 8."""
    return F.least(n, F.floor(n * 2 / 5).cast("int") + 8)


def needed(n: str, m: str) -> str:
    """SQL for how many tokens two similar lines of n and m tokens share at least in their windows."""
    return f"(cast((4 * ({n} + {m}) + 8) div 9 as int) - {outside(f'greatest({n}, {m})')})"


def outside(n: str) -> str:
    """SQL for how many of n tokens are outside the window."""
    return f"greatest(0, {n} - 8 - cast({n} * 2 div 5 as int))"


def _few(listed: DataFrame) -> DataFrame:
    """A written table, marked for broadcasting if it is counted to have few rows."""
    return F.broadcast(listed) if listed.count() <= BROADCAST_LINES else listed


def _by_document(places: DataFrame, out: str) -> DataFrame:
    """d and the lines named for it, marked for broadcasting if they are counted to be few. places: a written table."""
    few = places.count() <= BROADCAST_LINES
    held = places.groupBy("d").agg(F.sort_array(F.collect_set("pos")).alias(out))
    return F.broadcast(held) if few else held


def _tokens_at(documents: DataFrame, places: DataFrame) -> DataFrame:
    """d, pos and tokens of the lines at the given places (of each text, where texts share a d)."""
    held = documents.join(_by_document(places, "places"), "d")
    named = F.filter(F.split("text", "\n"), lambda x, i: F.array_contains("places", i))
    held = held.select("d", F.inline(F.arrays_zip(F.col("places").alias("pos"), named.alias("line"))))
    return held.where("line is not null").select("d", "pos", tokens(F.col("line")).alias("tokens"))


def _level(total: Column) -> Column:
    """The level of n + m tokens: the least j for which (n + m) / 9 is under 2 ** j."""
    least = F.floor((total + 9) / 9).cast("long")
    return F.when(least <= 1, 0).otherwise(F.length(F.bin(least - 1)))


def _keyed(parts: DataFrame) -> DataFrame:
    """key, d, p (line number and tokens in one number), s and r (sketches) of each line and key. parts: d, pos and tokens t."""
    low = (1 << SLOT_BITS) - 1
    n = F.size("t")
    most = 2 * n + F.shiftright(n, 2)  # n + m at most; at least it is 2 n less what a similar line may lack
    rows = parts.select("d", F.shiftleft(F.col("pos").cast("long"), 32).bitwiseOR(n.cast("long")).alias("p"), "t", most.alias("most"), n.alias("n"))
    bit = f"shiftleft({{}}, cast(shiftright(x, {SLOT_BITS}) & 63 as int))"
    fold = lambda one: F.expr(f"aggregate(t, 0L, (a, x) -> a ^ {bit.format(one)})")
    rows = rows.withColumns({"s": fold("1L"), "r": F.when(F.col("n") > LONG, fold(f"shiftright(x, {SLOT_BITS + 6}) & 1L"))})
    rows = rows.withColumn("level", F.explode_outer(F.sequence(_level(2 * F.col("n") - lacking(F.col("n"))), _level(F.col("most")))))
    rows = rows.withColumn("buckets", F.expr(f"if(level = 0, 1L, shiftleft(1L, level) + {LEAST})"))
    rows = rows.withColumn("kept", F.expr("cast(least(shiftleft(9L, level) - 1, most) div 9 as int) + 2"))
    rows = rows.withColumn("of", F.expr(f"transform(t, x -> shiftright(shiftright(x, {SLOT_BITS + 17}) * buckets, 31))"))  # in the order of t
    rows = rows.withColumn("at", F.expr("transform(array_distinct(of), x -> cast(array_position(of, x) as int))"))
    # a bucket is the sum of its tokens, whose low bits sum up the lengths; these lead the order
    whole = "aggregate(slice(t, x, coalesce(get(at, i + 1), n + 1) - x), 0L, (a, y) -> (a + y) & 4611686018427387903L)"
    order = f"shiftleft(x & {low >> 1}, {64 - SLOT_BITS}) | shiftleft(shiftrightunsigned(x, {SLOT_BITS + LEVEL_BITS}), {LEVEL_BITS}) | level"
    keys = F.expr(f"sort_array(transform(transform(at, (x, i) -> {whole}), x -> {order}), false)")
    # the two elements of all lines; on level 0 similar lines have the same tokens, so the bucket gives them
    last = [F.when(F.col("level") == 0, F.get("keys", F.lit(0)) + F.lit(k << LEVEL_BITS)).otherwise(F.col("level").cast("long") - F.lit(k << LEVEL_BITS)) for k in (1, 2)]
    rows = rows.withColumn("keys", keys).withColumn("keys", F.slice(F.concat("keys", F.array(*last)), 1, F.col("kept")))
    # explode_outer, as Spark filters by the size of what explode gets and works it out once more for that; here and below none is empty
    return rows.select(F.explode_outer("keys").alias("key"), "d", "p", "s", "r")


def _paired(met: DataFrame, settled: DataFrame) -> DataFrame:
    """Each two of a line's keys of many lines as one key, with d, p, s, r, and open: if the line is not among the settled ones.
    met: as _met gives it. settled: a written table."""
    level = F.expr(f"key & {(1 << LEVEL_BITS) - 1}").alias("level")
    held = met.where("rank is not null").groupBy("d", "p", "pos", "s", "r", level).agg(F.sort_array(F.collect_set("key")).alias("keys")).where("size(keys) > 1")
    held = held.join(_few(settled.withColumn("open", F.lit(False))), ["d", "pos"], "left").withColumn("open", F.coalesce("open", F.lit(True)))
    ones = held.select("d", "p", "s", "r", "open", "keys", F.posexplode("keys").alias("i", "one"))
    return ones.select("d", "p", "s", "r", "open", "one", F.explode_outer(F.expr("slice(keys, i + 2, size(keys))")).alias("other")).where("other is not null").select(F.xxhash64("one", "other").alias("key"), "d", "p", "s", "r", "open")


def _near(a: str, b: str) -> str:
    """SQL for whether a row a of an earlier line and one b of a later line pass the bounds on sizes and sketches."""
    n, m = (f"({x}p & 4294967295L)" for x in (a, b))
    wide = f"bit_count({a}r ^ {b}r) + bit_count({a}s ^ {b}s ^ {a}r ^ {b}r)"
    return (
        f"({a}d < {b}d or ({a}d = {b}d and shiftright({a}p, 32) < shiftright({b}p, 32))) and {n} * {DEN} >= {m} * {NUM} and {m} * {DEN} >= {n} * {NUM} "
        f"and 9 * bit_count({a}s ^ {b}s) <= {n} + {m} and ({a}r is null or {b}r is null or 9 * ({wide}) <= {n} + {m})"
    )


def _met(keyed: DataFrame) -> DataFrame:
    """The rows that meet something: those with candidates, the places of earlier lines of their key that pass (found), and
    those of keys of more lines than each meets here (rank; null in others). Only open lines look for candidates, and keys
    without an open line are left out."""
    place = Window.partitionBy("key").orderBy("d", "p")
    rows = keyed.withColumns({"rank": F.row_number().over(place), "next": F.lead("d").over(place)})
    rows = rows.where("rank > 1 or next is not null").drop("next")
    line = F.struct("d", "p", "s", "r")
    before = F.collect_list(line).over(place.rowsBetween(-HEAVY, -1))
    whole = place.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    first, many, wanted = F.first(line).over(place), F.count("*").over(whole), F.max("open").over(whole)
    rows = rows.select("key", "d", "p", "s", "r", "open", "rank", first.alias("first"), before.alias("before"), many.alias("many"), wanted.alias("wanted")).where("wanted")
    passing = F.expr(f"transform(filter(case when not open then slice(before, 1, 0) when rank > {HEAVY} + 1 then array_prepend(before, first) else before end, x -> {_near('x.', '')}), x -> struct(x.d as d, cast(shiftright(x.p, 32) as int) as pos))")
    crowded = F.col("many") > HEAVY + 1
    rows = rows.select(*(F.when(crowded, F.col(c)).alias(c) for c in ("key", "rank", "s", "r")), "d", "p", passing.alias("found"))
    return materialize(rows.where("rank is not null or size(found) > 0"), "met-lines", random=True)


def _verified(documents: DataFrame, pairs: DataFrame) -> DataFrame:
    """d and pos of the later lines of pairs (ad, apos, bd, bpos) whose Jaccard similarity is high enough."""
    pairs = materialize(pairs.distinct(), "line-pairs")
    places = materialize(pairs.selectExpr("ad as d", "apos as pos").unionByName(pairs.selectExpr("bd as d", "bpos as pos")).distinct(), "line-places")
    held = materialize(_tokens_at(documents, places), "line-tokens")
    left, right = held.selectExpr("d as ad", "pos as apos", "tokens as at"), held.selectExpr("d as bd", "pos as bpos", "tokens as bt")
    both = F.size(F.array_intersect("at", "bt"))
    alike = pairs.join(left, ["ad", "apos"]).join(right, ["bd", "bpos"]).where(both * DEN >= (F.size("at") + F.size("bt") - both) * NUM)
    found = materialize(alike.selectExpr("bd as d", "bpos as pos").distinct(), "similar-lines")
    for table in (pairs, places, held):
        discard(table)
    return found


def _equal_lines(documents: DataFrame) -> DataFrame:
    """d, pos and hash of the lines whose text stands at an earlier place."""
    every = documents.select("d", F.posexplode_outer(F.split("text", "\n")).alias("pos", "line")).where(~_blank("line"))
    every = every.select("d", "pos", F.xxhash64("line").alias("h"), F.xxhash64(F.lit(1), "line").alias("g"))
    firsts = every.groupBy("h", "g").agg(F.min(F.struct("d", "pos")).alias("first"), F.count("*").alias("many")).where("many > 1").drop("many")
    firsts = _few(materialize(firsts, "first-lines"))
    return materialize(every.join(firsts, ["h", "g"]).where("d <> first.d or pos <> first.pos").select("d", "pos", "h"), "equal-lines")


def repeated_lines(documents: DataFrame) -> DataFrame:
    """d and pos of each line that an earlier line equals or resembles. documents: d (bigint, not null) and text."""
    equal = _equal_lines(documents)
    few = equal.count() <= BROADCAST_LINES
    gone = equal.groupBy("d").agg(F.collect_set(F.struct("pos", "h")).alias("gone"))
    every = documents.join(F.broadcast(gone) if few else gone, "d", "left").select("d", "gone", F.posexplode_outer(F.split("text", "\n")).alias("pos", "line"))
    every = every.where("gone is null or not array_contains(gone, named_struct('pos', pos, 'h', xxhash64(line)))")
    parts = every.where(~_blank("line")).select("d", "pos", F.sort_array(F.array_distinct(F.transform(words(F.col("line")), _sized))).alias("t"))
    met = _met(_keyed(parts).withColumn("open", F.lit(True))).withColumn("pos", F.expr("cast(shiftright(p, 32) as int)"))

    # one candidate for each key at first, then all that passed and those of paired keys, for the lines that these don't settle
    pairs = ("ad", "apos", "bd", "bpos")
    settled = [_verified(documents, met.where("size(found) > 0").selectExpr("found[0].d", "found[0].pos", "d", "pos").toDF(*pairs))]
    joint = _met(_paired(met, settled[0])).withColumn("pos", F.expr("cast(shiftright(p, 32) as int)"))
    more = met.where("size(found) > 1").select("d", "pos", "found").unionByName(joint.where("size(found) > 0").select("d", "pos", "found"))
    still = more.join(settled[0], ["d", "pos"], "left_anti")
    settled.append(_verified(documents, still.select(F.explode("found").alias("a"), "d", "pos").select("a.d", "a.pos", "d", "pos").toDF(*pairs)))

    # in large paired keys the lines further before, then those before these, and all at last: who finds one needs no others
    line = ("d", "p", "s", "r", "rank")
    a = joint.where("rank is not null").select("key", *(F.col(c).alias(f"a{c}") for c in line))
    reach = HEAVY
    for wider in (8 * HEAVY, 64 * HEAVY, 1 << 31):
        known = reduce(DataFrame.unionByName, settled).distinct()
        b = joint.where(F.col("rank") > reach + 1).join(known, ["d", "pos"], "left_anti").select("key", *(F.col(c).alias(f"b{c}") for c in line))
        b = materialize(b, "open-lines")
        if b.isEmpty():
            break
        crowd = a.join(b, "key").where(f"brank - arank > {reach} and brank - arank <= {wider}L and {_near('a', 'b')}")
        settled.append(_verified(documents, crowd.selectExpr("ad", "cast(shiftright(ap, 32) as int)", "bd", "cast(shiftright(bp, 32) as int)").toDF(*pairs)))
        reach = wider
    return reduce(DataFrame.unionByName, settled, equal.select("d", "pos")).distinct()


def dedup_lines(documents: DataFrame, counts: bool = True) -> DataFrame:
    """The documents without the lines that an earlier line (smaller doc_id, or the same one and an earlier line) equals or
    resembles, that is whose token sets have a Jaccard similarity of 0.8 or more, removed or not; columns as they are, and with
    counts n_lines and n_removed (which documents may have columns of the same names beside).

    Blank lines are never removed. Null texts stay null and have no lines. Rows that share a doc_id stand at one place: what
    is removed from one is removed from each. A null doc_id stands before all others. Lines and texts of any length are taken
    whole; no documents give no rows.
    """
    extra = {c: f"_extra_{i}" for i, c in enumerate(documents.columns) if c not in ("doc_id", "text")}
    docs = documents.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(LOWEST)).alias("d"), F.col("text").cast("string").alias("text"), *(F.col(c).alias(x) for c, x in extra.items()))
    gone = _by_document(materialize(repeated_lines(docs.select("d", "text")), "repeated-lines"), "gone")
    held = F.split("text", "\n")
    left = F.filter(held, lambda x, i: ~F.array_contains("gone", i))
    kept = F.when(F.col("gone").isNull(), F.col("text")).otherwise(F.array_join(left, "\n"))
    many = F.coalesce(F.array_size(held), F.lit(0))
    removed = F.when(F.col("gone").isNull() | F.col("text").isNull(), F.lit(0)).otherwise(F.array_size(held) - F.array_size(left))
    # values first, names after: a column that is called like one of ours is no alias of it
    done = docs.join(gone, "d", "left").select("d", *extra.values(), kept.alias("_kept"), many.cast("long").alias("_many"), removed.cast("long").alias("_removed"))
    kind = documents.schema["doc_id"].dataType.simpleString()
    columns = {"doc_id": F.nullif("d", F.lit(LOWEST)).cast(kind), "text": F.col("_kept")} | {c: F.col(x) for c, x in extra.items()}
    more = [F.col("_many").alias("n_lines"), F.col("_removed").alias("n_removed")] if counts else []
    return done.select(*(columns[c].alias(c) for c in documents.columns), *more)


def op7_line_dedup(spark, sf_dir):
    found = dedup_lines(read_table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("doc_id", "n_lines", "n_removed", F.sha2("text", 256).alias("kept_sha256"))


ORACLE = r"""
WITH l AS (SELECT doc_id, string_split(text, chr(10)) AS ls FROM documents),
line AS (SELECT doc_id, unnest(ls) AS x, unnest(range(0, len(ls))) AS pos FROM l),
w AS (SELECT doc_id, pos, x, regexp_extract_all(x, '[^\x20\x09-\x0D]+') AS w FROM line),
f AS (SELECT x, any_value(w) AS w, min((doc_id, pos)) AS place FROM w WHERE len(w) > 0 GROUP BY x),
s AS (SELECT x, place, list_distinct(w) AS t FROM f),
e AS (SELECT x, place, len(t) AS n, unnest(t) AS t FROM s),
q AS (SELECT t, count(*) AS c FROM e GROUP BY t),
p AS (SELECT x, place, n, t, row_number() OVER (PARTITION BY x ORDER BY c, t) AS i FROM e JOIN q USING (t)),
r AS (SELECT x, place, n, t FROM p WHERE i <= n - ceil(n * 4 / 5.0) + 1),
c AS (SELECT DISTINCT a.x AS ax, b.x AS bx FROM r a JOIN r b ON a.t = b.t AND a.place < b.place AND least(a.n, b.n) * 5 >= greatest(a.n, b.n) * 4),
m AS (SELECT bx AS x FROM c JOIN s a ON a.x = ax JOIN s b ON b.x = bx WHERE len(list_intersect(a.t, b.t)) * 5 >= (len(a.t) + len(b.t) - len(list_intersect(a.t, b.t))) * 4),
gone AS (SELECT w.doc_id, w.pos FROM w JOIN f ON w.x = f.x WHERE (w.doc_id, w.pos) <> f.place OR w.x IN (SELECT x FROM m)),
kept AS (SELECT doc_id, count(*) AS n, string_agg(x, chr(10) ORDER BY pos) AS text FROM line ANTI JOIN gone USING (doc_id, pos) GROUP BY doc_id)
SELECT l.doc_id, CAST(coalesce(len(ls), 0) AS BIGINT) AS n_lines, CAST(coalesce(len(ls), 0) - coalesce(n, 0) AS BIGINT) AS n_removed, CASE WHEN ls IS NOT NULL THEN sha256(coalesce(text, '')) END AS kept_sha256
FROM l LEFT JOIN kept USING (doc_id)
"""
