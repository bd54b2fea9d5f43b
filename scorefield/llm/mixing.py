"""Mixing sources to target weights: each source is cut at its exact budget of words, and repeated where it is short.

Documents get hash-random keys. Within a source they are ordered by key in ranges of equal width, which random keys fill
evenly; the ranges' sums give each range its offset, and a running sum inside each range gives each document its own. So
no task holds a source, however large its share. A source whose budget exceeds its words is taken in whole epochs first.
"""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize, read_table

WORD = r"[^\x20\x09-\x0D]+"
WEIGHTS, SHARE, MOST_EPOCHS = (5, 2, 1), 1.5, 2
#: Hex digits of the key that number its range: 4096 ranges a source.
RANGE_DIGITS = 3


def with_sizes(documents: DataFrame) -> DataFrame:
    """doc_id, source, size (words), key (md5 of the doc_id in hex) and range."""
    key = F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit("")))
    return documents.select("doc_id", F.col("source").cast("string").alias("source"), F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long").alias("size"), key.alias("key")).withColumn("range", F.substring("key", 1, RANGE_DIGITS))


def targets(sizes: DataFrame, weights=WEIGHTS, share: float = SHARE, most: float = MOST_EPOCHS) -> DataFrame:
    """source, source_size, target: sources by code point, null last, take the weights in turn and divide share times all
    words by them; no target exceeds most times its source, and the excess goes to the others by weight.

    In the order of limit to weight, the sources at their limit come first; the first source whose fair part of what is
    left fits under its limit, and all after it, take their fair parts. One row a source, so the ordered sums are small.
    """
    by_source = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    turn = F.element_at(F.array(*(F.lit(float(w)) for w in weights)), (F.pmod(F.expr("row_number() over (order by source asc nulls last) - 1"), F.lit(len(weights))) + 1).cast("int"))
    w = by_source.withColumn("weight", turn).withColumn("most", F.col("source_size") * F.lit(float(most))).withColumn("rate", F.col("most") / F.col("weight"))
    order = "order by rate, source asc nulls last"
    w = w.withColumns({"total": F.expr(f"sum(source_size) over () * {float(share)}D"), "before": F.expr(f"coalesce(sum(most) over ({order} rows between unbounded preceding and 1 preceding), 0D)"), "left": F.expr(f"sum(weight) over ({order} rows between current row and unbounded following)")})
    w = w.withColumn("fair", (F.col("total") - F.col("before")) / F.col("left"))
    w = w.withColumn("place", F.expr(f"row_number() over ({order})"))
    level = F.expr("min(case when fair <= rate then struct(place, fair) end) over ()").getField("fair")
    return w.withColumn("level", level).select("source", "source_size", F.least(F.col("most"), F.coalesce(F.col("level") * F.col("weight"), F.col("most"))).alias("target"))


def mix_sources(documents: DataFrame, weights=WEIGHTS, share: float = SHARE, most: float = MOST_EPOCHS) -> DataFrame:
    """Per row of documents: doc_id, source, size, source_size, target and taken (words that the mix takes, repeats counted).

    A source's taken words are its target's whole part: every document once for each whole epoch, then documents by key
    until the budget is met, of which the last gives its first words only. The order depends on doc_id alone, so reruns
    agree; rows that share one follow each other by size, and equal rows take the same or stand side by side at the cut. A null
    text has no words, a null source is a source of its own, and a null doc_id has the key of an empty one. Texts of any length are counted whole; an
    empty table gives no rows. Other columns are ignored.
    """
    sizes = materialize(with_sizes(documents), "sizes")
    goal = targets(sizes, weights, share, most)
    ranges = sizes.groupBy("source", "range").agg(F.sum("size").alias("n"))
    offsets = ranges.withColumn("offset", F.expr("sum(n) over (partition by source order by range) - n")).select(F.col("source").alias("_s"), F.col("range").alias("_r"), "offset")
    goal = goal.withColumn("epochs", F.when(F.col("source_size") > 0, F.floor(F.floor("target") / F.col("source_size"))).otherwise(F.lit(0))).withColumn("budget", F.floor("target") - F.col("epochs") * F.col("source_size")).withColumnRenamed("source", "_s")
    cut = offsets.join(goal, offsets._s.eqNullSafe(goal._s)).drop(goal._s)
    inside = F.expr("sum(size) over (partition by source, range order by key, doc_id, size rows between unbounded preceding and current row) - size")
    at = sizes.withColumn("inside", inside).join(cut, F.col("source").eqNullSafe(F.col("_s")) & (F.col("range") == F.col("_r")))
    part = F.greatest(F.lit(0), F.least(F.col("size"), F.col("budget") - F.col("offset") - F.col("inside")))
    return at.select("doc_id", "source", "size", "source_size", "target", (F.col("epochs") * F.col("size") + part).cast("long").alias("taken"))


def op2_source_mixing(spark, sf_dir):
    return mix_sources(read_table(spark, sf_dir, "documents")).drop("source")


ORACLE = r"""
WITH d AS (SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size, md5(CAST(doc_id AS VARCHAR)) AS key FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size, [5.0, 2.0, 1.0][CAST((row_number() OVER (ORDER BY source ASC NULLS LAST) - 1) % 3 + 1 AS INT)]::DOUBLE AS weight FROM d GROUP BY source),
r AS (SELECT *, source_size * 2.0::DOUBLE AS most, source_size * 2.0::DOUBLE / weight AS rate, sum(source_size) OVER () * 1.5::DOUBLE AS total FROM s),
f AS (SELECT *, (total - coalesce(sum(most) OVER (ORDER BY rate, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) / sum(weight) OVER (ORDER BY rate, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS fair, row_number() OVER (ORDER BY rate, source NULLS LAST) AS place FROM r),
t AS (SELECT source, source_size, least(most, coalesce((SELECT fair FROM f WHERE fair <= rate ORDER BY place LIMIT 1) * weight, most)) AS target FROM f),
g AS (SELECT *, CASE WHEN source_size > 0 THEN floor(floor(target) / source_size) ELSE 0 END AS epochs FROM t),
p AS (SELECT d.*, sum(size) OVER (PARTITION BY source ORDER BY key ROWS UNBOUNDED PRECEDING) - size AS before FROM d)
SELECT doc_id, size, source_size, target, CAST(epochs * size + greatest(0, least(size, floor(target) - epochs * source_size - before)) AS BIGINT) AS taken
FROM p JOIN g ON p.source IS NOT DISTINCT FROM g.source
"""
