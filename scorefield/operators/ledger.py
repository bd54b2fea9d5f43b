"""The probability ledger: locks, grades, audit and the public record; and the walk-forward backtest."""

import math
from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .aggregates import calibration, rating_replay


def lock(probs: DataFrame, ready: DataFrame, event: str, key: str, at) -> DataFrame:
    """Selections of ready events, sealed by a hash of all their columns."""
    rows = probs.join(ready.where("ready").select(event), event, "left_semi").withColumn("locked_at", F.lit(at).cast("timestamp"))
    return rows.withColumn("seal", F.sha2(F.to_json(F.struct(*(F.col(c) for c in sorted(rows.columns))), {"ignoreNullFields": "false"}), 256))


def grade(locks: DataFrame, results: DataFrame, event: str, entity: str, family: str, opponent: str | None = None) -> DataFrame:
    """grade WIN, LOSS, VOID or PENDING. results: event, entity, final, periods, status, position, real_cut, entity_periods,
    early (two-period total). Families: winner, top<N>, make_cut, h2h."""
    r = results.select(event, entity, *(F.col(c).alias(f"_{c}") for c in ("final", "periods", "status", "position", "real_cut", "entity_periods", "early")))
    co = results.where("position = 1").groupBy(event).agg(F.count("*").alias("_winners"))
    m = locks.join(r, [event, entity], "left").join(co, event, "left")
    s, f, n = F.col("_status"), F.col(family), F.regexp_extract(family, r"^top(\d+)$", 1).try_cast("int")
    out_ = lambda c: F.col(c).isin("withdrawn", "disqualified", "dns")
    g = F.when(F.col("_final").isNull(), "PENDING").when(~F.col("_final") | (F.col("_periods") < 2), "VOID")
    g = g.when(f == "winner", F.when((s == "dns") | ((F.col("_position") == 1) & (F.col("_winners") > 1)), "VOID").when(F.col("_position") == 1, "WIN").otherwise("LOSS"))
    g = g.when(n.isNotNull(), F.when(s == "dns", "VOID").when((s == "finished") & (F.col("_position") <= n), "WIN").otherwise("LOSS"))
    survived = (s == "finished") | (s.isin("withdrawn", "disqualified") & (F.col("_entity_periods") >= 3))
    g = g.when(f == "make_cut", F.when(~F.col("_real_cut"), "VOID").when(survived, "WIN").when(s == "cut", "LOSS").otherwise("VOID"))
    if opponent is not None:
        o = results.select(event, F.col(entity).alias(opponent), F.col("status").alias("_ostatus"), F.col("position").alias("_oposition"), F.col("early").alias("_oearly"))
        m = m.join(o, [event, opponent], "left")
        mine = F.when(s == "finished", F.col("_position")).otherwise(100000 + F.col("_early"))
        theirs = F.when(F.col("_ostatus") == "finished", F.col("_oposition")).otherwise(100000 + F.col("_oearly"))
        g = g.when(f == "h2h", F.when(out_("_status") | out_("_ostatus") | F.col("_ostatus").isNull() | (mine == theirs), "VOID").when(mine < theirs, "WIN").otherwise("LOSS"))
    return m.withColumn("grade", g.otherwise("VOID")).select(*locks.columns, "grade")


def revise(graded: DataFrame, ledger: DataFrame, key: str) -> DataFrame:
    """Rows to append: new keys, and keys whose grade differs from the latest revision, with their revision number."""
    last = ledger.groupBy(key).agg(F.max("revision").alias("_r"), F.max_by("grade", "revision").alias("_g"))
    return graded.join(last, key, "left").where(~F.col("grade").eqNullSafe(F.col("_g"))).withColumn("revision", F.coalesce(F.col("_r") + 1, F.lit(1))).drop("_r", "_g")


def audit_ledger(locks: DataFrame, grades: DataFrame, events: DataFrame, key: str, event: str) -> DataFrame:
    """problem of each lock: seal (it is broken), late (the lock isn't before the start), missing_grade (the event is over), and
    wrong_lock (a grade with the seal of another lock, where grades have one), each once."""
    cols = sorted(c for c in locks.columns if c != "seal")
    sealed = F.sha2(F.to_json(F.struct(*(F.col(c) for c in cols)), {"ignoreNullFields": "false"}), 256)
    of = F.col("seal") if "seal" in grades.columns else F.lit(None).cast("string")
    held = grades.select(key, of.alias("_of")).join(locks.select(key, "seal"), key, "left")
    graded = held.groupBy(key).agg(F.lit(True).alias("_g"), F.coalesce(F.max(F.col("_of") != F.col("seal")), F.lit(False)).alias("_other"))
    m = locks.withColumn("_ok", sealed == F.col("seal")).join(events.select(event, "starts_at", "over"), event, "left").join(graded, key, "left")
    found = F.array_compact(F.array(F.when(~F.col("_ok"), F.lit("seal")), F.when(F.col("locked_at") >= F.col("starts_at"), F.lit("late")), F.when(F.col("over") & F.col("_g").isNull(), F.lit("missing_grade")), F.when(F.col("_other"), F.lit("wrong_lock"))))
    return m.select(key, F.explode(found).alias("problem"))


def public_record(graded: DataFrame, family: str) -> DataFrame:
    """Counts of settled selections by family; open ones stay out."""
    return graded.where("grade <> 'PENDING'").groupBy(family).agg(F.count("*").alias("n"), *(F.count_if(F.col("grade") == g).alias(g.lower()) for g in ("WIN", "LOSS", "VOID")))


def walk_forward(obs: DataFrame, entity: str, ts: str, value: str, hit: str, folds: Sequence[tuple[str, str, str]], grid: Sequence[Mapping[str, float]]) -> DataFrame:
    """For each fold (name, from, to) and setting (tau, k, mu0): ratings from what lies before the fold, turned into
    probabilities and scored on the fold. Folds and grid are short lists, which each row is held against in one pass."""
    day = lambda d: F.lit(d).cast("date")
    every = [
        F.struct(F.lit(name).alias("fold"), day(lo).alias("_lo"), day(hi).alias("_hi"), F.lit(i).alias("setting"), *(F.lit(float(g.get(n, v))).alias(f"_{n}") for n, v in (("tau", 730.0), ("k", 3.0), ("mu0", 0.5))))
        for name, lo, hi in folds
        for i, g in enumerate(grid)
    ]
    rows = obs.select(entity, ts, value, hit, F.inline(F.array(*every)))
    w = F.exp(-F.datediff("_lo", ts) / F.col("_tau"))
    past = rows.where((F.datediff("_lo", ts) > 0) & F.col(value).isNotNull())
    mu = (F.sum(w * F.col(value)) + F.first("_k") * F.first("_mu0")) / (F.sum(w) + F.first("_k"))
    rated = past.groupBy("fold", "setting", entity).agg(mu.alias("mu"))
    p = rows.where((F.col(ts) >= F.col("_lo")) & (F.col(ts) < F.col("_hi"))).join(rated, ["fold", "setting", entity], "left")
    p = p.withColumn("p", 1 / (1 + F.exp(F.coalesce("mu", F.lit(0.0)) / 100)))
    return calibration(p, "p", hit, ["fold", "setting"])


def grid_ranking(scores: DataFrame, order: str, field: Sequence[str], entity: str, value: str, buckets: Sequence, folds: Sequence[tuple[str, str, str]], grid: Sequence[Mapping[str, float]], least: int = 10) -> DataFrame:
    """fold, setting, n, nll, place and chosen: how well ratings under each setting foretell residuals.

    folds: name, from and to (without that day), the first of them to tune on; a row belongs to the first that holds its date.
    All settings are replayed in one pass (rating_replay) over all buckets; the loss is the mean Gaussian negative
    log-likelihood of the residuals under the mean and spread known before their bucket. place ranks the settings on the first
    fold, the least loss first, ties by number, and its best is chosen. Of the other folds only the chosen setting has a row, so no
    row of theirs can have a say in the choice. Folds without residuals have no row.
    """
    replayed = rating_replay(scores, order, field, entity, value, buckets, least=least, grid=grid).where("residual is not null")
    fold = reduce(lambda c, f: c.when((F.col(order) >= F.lit(f[1]).cast("date")) & (F.col(order) < F.lit(f[2]).cast("date")), f[0]), folds, F)
    var = F.col("sd") * F.col("sd") + F.col("se") * F.col("se")
    loss = 0.5 * F.log(F.lit(2 * math.pi) * var) + F.pow(F.col("residual") - F.col("mu"), 2) / (2 * var)
    losses = replayed.withColumn("fold", fold).where("fold is not null").groupBy("fold", "setting").agg(F.count("*").alias("n"), F.avg(loss).alias("nll"))
    tuned = F.col("fold") == folds[0][0]
    best = F.min(F.when(tuned, F.struct("nll", "setting"))).over(Window.partitionBy(F.lit(0)))  # a row a fold and setting
    placed = losses.withColumn("_best", best["setting"]).withColumn("place", F.when(tuned, F.row_number().over(Window.partitionBy("fold").orderBy("nll", "setting"))))
    return placed.where(tuned | (F.col("setting") == F.col("_best"))).select("fold", "setting", "n", "nll", "place", (F.col("setting") == F.col("_best")).alias("chosen"))
