"""Fact packets, their comparison, publish decisions and gates on texts before publication."""

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import fold
from ..session import written

#: Number words that a text may not use outside tokens, phrases that hold one and count nothing, and ordinals,
#: which may stand before "round".
NUMBER_WORDS = [
    "two", "three", "four", "five", "six", "seven", "eight", "nine", "ten", "eleven", "twelve", "thirteen", "fourteen", "fifteen", "sixteen",
    "seventeen", "eighteen", "nineteen", "twenty", "thirty", "forty", "fifty", "hundred", "dozen",
]
NOT_COUNTS = ["front nine", "back nine", "top-ten"]
ORDINALS = ["second", "third", "fourth", "fifth", "sixth", "seventh", "eighth", "ninth", "tenth"]
#: Length limits in characters, words and facts.
LIMITS = {"headline": (20, 120), "dek": (40, 300), "words": (35, 1400), "facts": 3}
#: The pronouns of each subject pronoun.
PRONOUNS = {"she": ["she", "her", "hers", "herself"], "he": ["he", "him", "his", "himself"]}


def fact_packets(df: DataFrame, key: str, spec: Mapping[str, str], source: str, klass: str = "A") -> DataFrame:
    """A row for each known value of the given columns (column -> label): fact_id, value, label, source, class, and the hash
    of the packet. A null is never a fact."""
    wide = df.select(key, F.col(source).alias("source"), *(F.col(c).cast("string").alias(c) for c in spec))
    long = wide.unpivot([key, "source"], list(spec), "field", "value").where("value is not null")
    labels = F.create_map(*[F.lit(x) for kv in spec.items() for x in kv])
    long = long.withColumn("label", labels[F.col("field")]).withColumn("fact_id", F.concat_ws(":", F.col(key).cast("string"), "field")).withColumn("class", F.lit(klass))
    digest = long.groupBy(key).agg(F.sha2(F.array_join(F.array_sort(F.collect_list(F.concat_ws("=", "fact_id", "value"))), ";"), 256).alias("packet_hash"))
    return long.join(digest, key).drop("field")


def publish_decision(prev: DataFrame, next_: DataFrame, key: str, fact: str, value: str, forecast: str | None = None) -> DataFrame:
    """Per packet: unchanged, update (forecasts), enrichment (facts were only added), rewrite (none changed or added but some
    are gone) or correction, with the number of changed, added and removed facts."""
    a = prev.select(key, fact, F.col(value).alias("_was"), F.lit(True).alias("_a"))
    b = next_.select(key, fact, F.col(value).alias("_now"), F.lit(True).alias("_b"))
    m = a.join(b, [key, fact], "full_outer")
    both = F.col("_a") & F.col("_b")
    g = m.groupBy(key).agg(F.count_if(F.coalesce(both, F.lit(False)) & ~F.col("_was").eqNullSafe(F.col("_now"))).alias("changed"), F.count_if(F.col("_a").isNull()).alias("added"), F.count_if(F.col("_b").isNull()).alias("removed"))
    same = (F.col("changed") == 0) & (F.col("added") == 0) & (F.col("removed") == 0)
    kind = F.when(same, "unchanged")
    if forecast is not None:
        g = g.join(next_.groupBy(key).agg(F.max(forecast).alias("_f")), key, "left")
        kind = kind.when(F.coalesce(F.col("_f"), F.lit(False)), "update")
    kind = kind.when((F.col("changed") == 0) & (F.col("removed") == 0), "enrichment").when(F.col("changed") == 0, "rewrite").otherwise("correction")
    return g.select(key, "changed", "added", "removed", kind.alias("decision"))


def _unknown(drafts: DataFrame, body: Column, known: DataFrame, key: str, kind: str, name: str, out: str) -> DataFrame:
    """key and out: how many different tokens {kind:name} of the draft aren't known for it."""
    used = drafts.select(key, F.explode(F.array_distinct(F.regexp_extract_all(body, F.lit(rf"\{{{kind}:([^}}]+)\}}"), F.lit(1)))).alias(name))
    return used.join(known.select(key, name), [key, name], "left_anti").groupBy(key).agg(F.count("*").alias(out))


def _unknown_names(drafts: DataFrame, plain: Column, entities: DataFrame, key: str) -> DataFrame:
    """key and _names: runs of two or more capitalised words that no name of the draft's entities holds."""
    runs = F.explode(F.array_distinct(F.regexp_extract_all(plain, F.lit(r"(\p{Lu}[\p{L}'’-]+(?:\s+\p{Lu}[\p{L}'’-]+)+)"), F.lit(1))))
    found = drafts.select(key, runs.alias("_run")).withColumn("_run", F.lower(F.regexp_replace("_run", r"\s+", " ")))
    names = entities.select(key, F.lower("name").alias("_name"))
    return found.join(names, (found[key] == names[key]) & F.contains("_name", "_run"), "left_anti").groupBy(key).agg(F.count("*").alias("_names"))


def _shown(facts: DataFrame, entities: DataFrame | None, key: str) -> DataFrame:
    """key and _shown: what a reader sees for each token of a draft."""
    token = lambda kind, name: F.concat(F.lit("{" + kind + ":"), name, F.lit("}")).alias("_t")
    every = facts.select(key, token("f", "fact_id"), F.col("display").cast("string").alias("_v"))
    if entities is not None:
        every = every.unionByName(entities.select(key, token("e", "entity_key"), F.col("name").alias("_v")))
    one = every.where("_t is not null").groupBy(key, "_t").agg(F.coalesce(F.min("_v"), F.lit("")).alias("_v"))
    return one.groupBy(key).agg(F.map_from_entries(F.collect_list(F.struct("_t", "_v"))).alias("_shown"))


def render(text: Column, shown: Column) -> Column:
    """A text with its tokens as a reader sees them; unknown ones as nothing."""
    tokens = F.array_distinct(F.regexp_extract_all(text, F.lit(r"\{[fe]:[^}]*\}"), F.lit(0)))
    return F.aggregate(tokens, text, lambda t, x: F.replace(t, x, F.coalesce(F.try_element_at(shown, x), F.lit(""))))


def text_gates(
    drafts: DataFrame,
    facts: DataFrame,
    key: str,
    text: str,
    banned: Mapping[str, str],
    limits: Mapping[str, tuple[int, int]] | None = None,
    entities: DataFrame | None = None,
    headline: str | None = None,
    dek: str | None = None,
    facts_used: int = 0,
    fewest: str | None = None,
    pronoun: str | None = None,
    emphasis: str | None = None,
    modules: str | None = None,
    charts: DataFrame | None = None,
    subjects: DataFrame | None = None,
) -> DataFrame:
    """reasons why a draft may not be published: an unknown {f:id} token, digits, number words or ordinals outside tokens, a
    banned family (name -> pattern), or too few or many words. Empty reasons pass.

    facts: key, fact_id. With entities (key, entity_key, name) also {e:key} tokens that are not theirs, and names that none of
    theirs holds; with headline and dek their lengths, where a token counts as it stands, or as a reader sees it if facts have a
    column display; with facts_used, fewer different facts. fewest: a column with another least number of words, where it
    isn't null. pronoun: a column with she, he or null; other pronouns than its own, or any where it is null, may not stand in
    the text. emphasis: a column with a list of fact ids, which must be the draft's. modules: a column with a list of charts, which
    charts (key, chart) must have for it; none stands for no emphasis and no module. subjects (key, name): where a draft has any,
    the headline names one of them.
    """
    limits = limits or LIMITS
    lo, hi = limits["words"]
    body = F.coalesce(F.col(text), F.lit(""))
    bare = F.regexp_replace(body, r"\{[fe]:[^}]*\}", " ")
    plain = F.lower(bare)
    either = lambda words: r"\b(" + "|".join(words) + r")\b"
    counted = F.regexp_replace(plain, either(NOT_COUNTS), " ")
    placed = F.regexp_replace(plain, either(ORDINALS) + " round", " ")
    n = F.regexp_count(plain, F.lit(r"\S+"))
    least = F.lit(lo) if fewest is None else F.coalesce(F.col(fewest), F.lit(lo))
    held = drafts.join(_unknown(drafts, body, facts, key, "f", "fact_id", "_facts"), key, "left")
    rules = [F.when(F.col("_facts") > 0, F.lit("unknown_fact"))]
    if entities is not None:
        held = held.join(_unknown(drafts, body, entities, key, "e", "entity_key", "_entities"), key, "left").join(_unknown_names(drafts, bare, entities, key), key, "left")
        rules.append(F.when(F.col("_entities") > 0, F.lit("unknown_entity")))
    rules += [F.when(plain.rlike("[0-9]"), F.lit("digits")), F.when(counted.rlike(either(NUMBER_WORDS)), F.lit("number_word")), F.when(placed.rlike(either(ORDINALS)), F.lit("ordinal_word"))]
    rules += [F.when(plain.rlike(p), F.lit(f"banned:{name}")) for name, p in banned.items()]
    if entities is not None:
        rules.append(F.when(F.col("_names") > 0, F.lit("unknown_name")))
    if facts_used:
        different = F.size(F.array_distinct(F.regexp_extract_all(body, F.lit(r"\{f:([^}]+)\}"), F.lit(1))))
        rules.append(F.when(different < facts_used, F.lit("too_few_facts")))
    seen = lambda c: F.coalesce(F.col(c), F.lit(""))
    if "display" in facts.columns and (headline or dek):
        held = held.join(_shown(facts, entities, key), key, "left")
        seen = lambda c: F.trim(F.regexp_replace(render(F.coalesce(F.col(c), F.lit("")), F.col("_shown")), r"\s+", " "))
    for name, column in (("headline", headline), ("dek", dek)):
        if column is not None:
            size = F.length(seen(column))
            rules.append(F.when((size < limits[name][0]) | (size > limits[name][1]), F.lit(f"{name}_length")))
    if pronoun is not None:
        of = lambda kind: plain.rlike(either(PRONOUNS[kind]))
        may = lambda kind: F.coalesce(F.col(pronoun) == kind, F.lit(False))
        rules.append(F.when((of("she") & ~may("she")) | (of("he") & ~may("he")), F.lit("pronoun")))
    for column, known, name, reason in ((emphasis, facts, "fact_id", "unknown_emphasis"), (modules, charts, "chart", "unknown_module")):
        if column is not None:
            asked = drafts.select(key, F.explode(F.array_distinct(column)).alias(name)).where(F.col(name) != "none")
            missing = asked if known is None else asked.join(known.select(key, name), [key, name], "left_anti")
            held = held.join(missing.groupBy(key).agg(F.count("*").alias(f"_{reason}")), key, "left")
            rules.append(F.when(F.col(f"_{reason}") > 0, F.lit(reason)))
    if subjects is not None and headline is not None:
        lines = held.select(key, seen(headline).alias("_line"))
        named = subjects.where("name is not null").select(key, F.col("name").alias("_name")).join(lines, key).groupBy(key).agg(F.max(F.contains("_line", "_name")).alias("_subject"))
        held = held.join(named, key, "left")
        rules.append(F.when(~F.col("_subject"), F.lit("headline_without_subject")))
    rules.append(F.when((n < least) | (n > hi), F.lit("length")))
    return held.select(key, F.array_compact(F.array(*rules)).alias("reasons"))


def story_candidates(df: DataFrame, key: str, terms: Mapping[str, tuple[Column, float]], threshold: float = 3) -> DataFrame:
    """material (the sum of the weights of the terms that hold) and reasons, of rows at or above the threshold."""
    held = {n: F.coalesce(c, F.lit(False)) for n, (c, _) in terms.items()}
    score = sum((F.when(held[n], F.lit(float(w))).otherwise(0.0) for n, (_, w) in terms.items()), F.lit(0.0))
    return df.select(key, score.alias("material"), F.array_compact(F.array(*(F.when(held[n], F.lit(n)) for n in terms))).alias("reasons")).where(F.col("material") >= threshold)


def pick_highlights(facts: DataFrame, key: str, order: str, fact: str, shown: DataFrame | None = None, lo: int = 3, hi: int = 5) -> DataFrame:
    """The first facts of each packet that were not shown yet, hi at most; none if there are fewer than lo."""
    left = facts if shown is None else facts.join(shown.select(key, fact), [key, fact], "left_anti")
    w = Window.partitionBy(key)
    r = left.withColumn("_k", F.row_number().over(w.orderBy(order, fact))).withColumn("_n", F.count("*").over(w)).where((F.col("_k") <= hi) & (F.col("_n") >= lo))
    return r.groupBy(key).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("_k", fact))), lambda x: x[fact].cast("string")), ",").alias("facts"))


def _words(text) -> Column:
    """The words of a text, folded; apostrophes vanish."""
    return F.filter(F.split(fold(F.regexp_replace(F.col(text) if isinstance(text, str) else text, "['’]", "")), " "), lambda x: x != "")


def mentions(texts: DataFrame, key: str, text: str, names: DataFrame, name: str) -> DataFrame:
    """key and name (folded) of the names that occur in each text as whole words, in their order; each once.

    Every run of words that is as long as some name is a candidate. A filter of fixed size, which has the hashes of all names,
    goes to all tasks and leaves few candidates; these are joined with the names by equality. So names may be as many as the
    texts, and no text meets all of them. A null text mentions nothing.
    """
    known = written(names.select(_words(name).alias("_n")).where(F.size("_n") > 0).select(F.array_join("_n", " ").alias(name), F.size("_n").alias("_length")).distinct(), "names")
    lengths = [r[0] for r in known.select("_length").distinct().collect()]  # a few small numbers
    at = lambda c: (F.shiftrightunsigned(F.xxhash64(c), 48).alias("_slot"), F.xxhash64(c).bitwiseAND(63).cast("int").alias("_bit"))
    bits = known.select(*at(F.col(name))).groupBy("_slot").agg(F.bit_or(F.expr("shiftleft(1L, _bit)")).alias("_bits"))  # 2**16 rows at most
    runs = lambda n: F.when(F.size("_w") >= n, F.transform(F.sequence(F.lit(1), F.size("_w") - n + 1), lambda i: F.array_join(F.slice("_w", i, n), " "))).otherwise(F.array().cast("array<string>"))
    if not lengths:
        return texts.select(key, F.lit(None).cast("string").alias(name)).limit(0)
    grams = texts.select(F.col(key), _words(text).alias("_w")).select(key, F.explode(F.array_distinct(F.concat(*(runs(n) for n in lengths)))).alias(name))
    near = grams.select(key, name, *at(F.col(name))).join(F.broadcast(bits), "_slot").where(F.expr("(_bits & shiftleft(1L, _bit)) <> 0")).select(key, name)
    return near.join(known.select(name), name, "left_semi").select(key, name).distinct()


def link_texts(
    texts: DataFrame,
    key: str,
    text: str,
    families: Mapping[str, str],
    names: DataFrame,
    name: str,
    entity: str,
    at: str | None = None,
    events: DataFrame | None = None,
    event: str = "event",
    event_name: str = "event_name",
    year: str = "year",
    start: str = "start",
    end: str = "end",
    strong: Sequence[str] = (),
    window: tuple[int, int, int] = (10, 45, 7),
    most: int = 6,
) -> DataFrame:
    """family and evidence of texts, the entities and the event they name, and how sure that is.

    entities: those whose full name (two words or more, as whole words) the text holds and no other entity shares, in order,
    most at most; n_entities counts them all. event: events (one row for each name that one goes by, names of six letters or
    more, without a leading "the") that the text names; the one of the year in the text if that is a single one (basis
    title_year), else the one whose end is nearest to the column at, from window[0] days before its start to window[1] after
    its end, if the next is over window[2] days farther (basis date_window). period: the period that the text names, where
    there is an event. confidence: high with an event and an entity or a family of strong ones; medium with an event or a
    single entity; else low. status: review where that is low, else published. Null texts name nothing.
    """
    from ..functions.scalars import period_from_text
    from .filters import classify_text

    ids = names.select(F.array_join(_words(name), " ").alias("_name"), F.col(entity)).where("instr(_name, ' ') > 0")
    unique = ids.groupBy("_name").agg(F.min(entity).alias(entity), F.max(entity).alias("_other")).where(F.col(entity) == F.col("_other")).drop("_other")
    met = mentions(texts, key, text, unique, "_name").join(unique, "_name").groupBy(key).agg(F.array_sort(F.collect_set(entity)).alias("_all"))
    out = texts.select(key, text, classify_text(text, families).alias("_c")).join(met, key, "left")
    n = F.coalesce(F.size("_all"), F.lit(0))
    if events is None:
        out = out.withColumns({event: F.lit(None).cast("string"), "basis": F.lit(None).cast("string")})
    else:
        held = events.select(F.col(event).alias("_event"), F.regexp_replace(F.array_join(_words(event_name), " "), "^the ", "").alias("_name"), F.col(year).cast("int").alias("_year"), F.col(start).alias("_start"), F.col(end).alias("_end")).where("length(_name) >= 6").distinct()
        named = written(mentions(texts, key, text, held, "_name").join(texts.select(key, F.regexp_extract(text, r"\b(19[5-9]\d|20[0-4]\d)\b", 1).try_cast("int").alias("_year"), F.to_date(F.lit(None) if at is None else F.col(at)).alias("_at")), key), "named-events")
        spans = held.groupBy("_name", "_year").agg(F.min("_event").alias("_lo"), F.max("_event").alias("_hi"))
        titled = named.join(spans, ["_name", "_year"]).groupBy(key).agg(F.min("_lo").alias("_titled"), F.max("_hi").alias("_hi")).where("_titled = _hi").drop("_hi")
        week = lambda d: F.floor(F.datediff(d, F.lit("1970-01-01").cast("date")) / 7)
        spread = held.where("_start is not null and _end >= _start").withColumn("_week", F.explode(F.sequence(week(F.date_sub("_start", window[0])), week(F.date_add("_end", window[1])))))
        near = named.drop("_year").withColumn("_week", week(F.col("_at"))).join(spread, ["_name", "_week"]).where(F.col("_at").between(F.date_sub("_start", window[0]), F.date_add("_end", window[1])))
        near = near.select(key, "_event", F.abs(F.datediff("_end", "_at")).alias("_far")).groupBy(key, "_event").agg(F.min("_far").alias("_far"))
        w = Window.partitionBy(key).orderBy("_far", "_event")
        dated = near.withColumn("_k", F.row_number().over(w)).withColumn("_next", F.lead("_far").over(w)).where("_k = 1").where(F.col("_next").isNull() | (F.col("_next") - F.col("_far") > window[2])).select(key, F.col("_event").alias("_dated"))
        out = out.join(titled, key, "left").join(dated, key, "left")
        out = out.withColumns({event: F.coalesce("_titled", "_dated"), "basis": F.when(F.col("_titled").isNotNull(), "title_year").when(F.col("_dated").isNotNull(), "date_window")})
    linked = F.col("basis").isNotNull()
    sure = F.when(linked & ((n > 0) | F.coalesce(F.col("_c.family").isin(*strong), F.lit(False))), "high").when(linked | (n == 1), "medium").otherwise("low")
    return out.select(key, F.col("_c.family").alias("family"), F.col("_c.evidence").alias("evidence"), F.coalesce(F.slice("_all", 1, most), F.array()).alias("entities"), n.cast("long").alias("n_entities"), event, "basis", F.when(linked, period_from_text(text)).alias("period"), sure.alias("confidence"), F.when(sure == "low", "review").otherwise("published").alias("status"))


def collapse_multivalue(df: DataFrame, key: str, cols: Sequence[str]) -> DataFrame:
    """Per key the value of each column if it has a single one, and how many it has."""
    return df.groupBy(key).agg(*(F.when(F.count_distinct(c) == 1, F.max(c)).alias(c) for c in cols), *(F.count_distinct(c).alias(f"n_{c}") for c in cols))


def dated_snapshot(prev: DataFrame, next_: DataFrame, key: Sequence[str], value: str, effective: str) -> DataFrame:
    """next with the date of the earlier row kept where the value is the same."""
    p = prev.select(*key, F.col(value).alias("_v"), F.col(effective).alias("_e"))
    return next_.join(p, list(key), "left").withColumn(effective, F.when(F.col("_e").isNotNull() & F.col(value).eqNullSafe(F.col("_v")), F.col("_e")).otherwise(F.col(effective))).drop("_v", "_e")
