"""Tables of draws: a deterministic bootstrap of residuals, and outcome probabilities from it."""

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def bootstrap_draws(obs: DataFrame, field: DataFrame, n: int, entity: str, value: str, keys: Sequence[str]) -> DataFrame:
    """A row for each of n draws and row of the field (keys, with entity): an observed value of the entity, picked by a linear
    congruence of the draw and the keys. Draws come from a sequence, observations by an equality of entity and number."""
    w = Window.partitionBy(entity)
    numbered = obs.where(F.col(value).isNotNull()).select(entity, value, *[c for c in obs.columns if c not in (entity, value)]).withColumn("_i", F.row_number().over(w.orderBy(*[c for c in obs.columns if c != value], value)) - 1).select(entity, "_i", value)
    sizes = numbered.groupBy(entity).agg(F.count("*").alias("_n"))
    mix = F.col("draw") * 1103515245 + 12345
    for k in keys:
        mix = F.pmod(mix, F.lit(2147483648)) * 69069 + F.col(k)
    drawn = field.join(sizes, entity).withColumn("draw", F.explode(F.sequence(F.lit(1), F.lit(n)))).withColumn("draw", F.col("draw").cast("long")).withColumn("_i", F.pmod(F.floor(F.pmod(mix, F.lit(2147483648)) / 65536), F.col("_n")))
    return drawn.join(numbered, [entity, "_i"]).drop("_i", "_n")


def draw_outcomes(draws: DataFrame, event: str, entity: str, period: str, value: str, cut_rank: int | None = None, after: int = 2) -> DataFrame:
    """win (split among co-leaders), top10, top20, make and position per entity, over draws. With a cut, those worse than the
    total at its rank after two periods stand behind all who made it."""
    t = draws.groupBy(event, "draw", entity).agg(F.sum(value).alias("total"), F.sum(F.when(F.col(period) <= after, F.col(value))).alias("early"), F.max(period).alias("_p"))
    w = Window.partitionBy(event, "draw")
    if cut_rank is None:
        t = t.withColumn("made", F.lit(True))
    else:
        t = t.withColumn("_r", F.rank().over(w.orderBy("early"))).withColumn("_real", (F.max("_p").over(w) > after) & (F.count("*").over(w) > cut_rank)).withColumn("made", ~F.col("_real") | (F.col("_r") <= cut_rank))
    t = t.withColumn("key", F.when(F.col("made"), F.col("total")).otherwise(F.lit(10000) + F.col("early"))).withColumn("position", F.rank().over(w.orderBy("key"))).withColumn("_share", F.count("*").over(Window.partitionBy(event, "draw", "position")))
    mean = lambda c: F.avg(c.cast("double"))
    return t.groupBy(event, entity).agg(F.avg(F.when(F.col("position") == 1, F.lit(1.0) / F.col("_share")).otherwise(0.0)).alias("win"), mean(F.col("position") <= 10).alias("top10"), mean(F.col("position") <= 20).alias("top20"), mean(F.col("made")).alias("make"), F.avg("position").alias("position"))


def pair_probability(draws: DataFrame, pairs: DataFrame, event: str, entity: str, value: str) -> DataFrame:
    """Per pair (a, b): the chance that a is ahead (lower), given no tie, and the chance of a tie."""
    t = draws.groupBy(event, "draw", entity).agg(F.sum(value).alias("_t"))
    a, b = t.select(event, "draw", F.col(entity).alias("a"), F.col("_t").alias("_a")), t.select(event, "draw", F.col(entity).alias("b"), F.col("_t").alias("_b"))
    m = pairs.join(a, "a").join(b, [event, "draw", "b"])
    tie, ahead = F.count_if(F.col("_a") == F.col("_b")), F.count_if(F.col("_a") < F.col("_b"))
    return m.groupBy(event, "a", "b").agg((ahead / F.nullif(F.count("*") - tie, F.lit(0))).alias("p_ahead"), (tie / F.count("*")).alias("p_tie"))


def cut_rule(prior: str, field: str, special: Column | None = None) -> Column:
    """The rank of the cut: none without one before, none for small fields of unknown prior, special cases, else 65."""
    out = F.when(F.coalesce(~F.col(prior), F.lit(False)), None).when(F.col(prior).isNull() & (F.col(field) <= 84), None)
    return (out if special is None else out.when(special.isNotNull(), special)).otherwise(65)
