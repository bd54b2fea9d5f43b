"""Hard-negative mining: exact scores by a residue number system, then selection inside windows.

Weights are taken modulo a few primes so small that a product of two matrices of residues is exact in float32 (a term's
size times the terms of a strip stay below 2**24). One float32 product a prime and strip, reduced, gives the score's residue;
the Chinese remainder theorem (in mixed radix) gives the score itself, with its sign, as long as the primes' product
exceeds twice the largest score. That bound is measured on the data, and decides how many primes are taken.

Anchors meet the rows of their label first, which gives their positives; then they meet all rows with the windows of their
positives, and of each window the highest scores of other labels are kept.
"""

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import list_column, materialize, read_table
from .scores import BLOCK, HIGHEST, LANES, TILE, Best, first_of, matrix, meet, narrowed, weighted

EVERY, RELABEL, CLASSES = 50, 7, 10
POSITIVES, NEGATIVES = 5, 3
#: Terms of a strip, and the primes below it: half of a prime squared, times the terms, is below 2**24.
STRIP, BELOW = 64, 1023


def primes(most: float) -> list[int]:
    """Primes, the largest first, whose product exceeds twice most and one."""
    out, product = [], 1
    for p in range(BELOW, 2, -2):
        if all(p % d for d in range(3, int(p**0.5) + 1, 2)):
            out.append(p)
            product *= p
            if product > 2 * int(most) + 2:
                return out
    raise ValueError("scores are too large for the primes")


def residues(weights: np.ndarray, modulus: int) -> np.ndarray:
    """Weights modulo a prime, between minus and plus half of it, as float32."""
    r = weights % modulus
    return np.where(r > modulus // 2, r - modulus, r).astype(np.float32)


def product(a: list[np.ndarray], b: list[np.ndarray], moduli: list[int]) -> np.ndarray:
    """The inner products of all rows of a and b (their residues by prime), as integers; those beyond 64 bits are clamped."""
    terms = min(a[0].shape[1], b[0].shape[1])
    digits = []
    for p, x, y in zip(moduli, a, b):
        r = np.zeros((len(x), len(y)), np.int64)
        for lo in range(0, terms, STRIP):
            hi = min(lo + STRIP, terms)
            r += (x[:, lo:hi] @ y[:, lo:hi].T).astype(np.int64)
        r %= p
        for q, d in zip(moduli, digits):  # what the digits before leave of it
            r = (r - d) * pow(q, -1, p) % p
        digits.append(r)
    whole = 1
    for p in moduli:
        whole *= p
    kind = np.int64 if whole < 1 << 63 else object
    out, radix = np.zeros(digits[0].shape, kind), 1
    for p, d in zip(moduli, digits):
        out = out + d.astype(kind) * radix
        radix *= p
    out = np.where(out > whole // 2, out - whole, out)
    return out if kind is np.int64 else np.clip(out, -HIGHEST, HIGHEST).astype(np.int64)


def _bound(anchors: DataFrame, rows: DataFrame) -> float:
    """No score is larger: the largest norms, multiplied."""
    norm = F.sqrt(F.aggregate(F.transform("v", lambda x: x.cast("double") * x.cast("double")), F.lit(0.0), lambda s, x: s + x))
    a, b = (d.agg(F.max(norm)).first()[0] or 0.0 for d in (anchors, rows))
    return a * b * (1 + 1e-9) + 1


def _ordered(block: pa.Table) -> tuple[pa.Table, np.ndarray, np.ndarray]:
    """The block by vec_id, null last: of equal scores the first counts. Its vec_ids, and which are null."""
    null, ids = block["vec_id"].is_null().to_numpy(), block["vec_id"].fill_null(0).to_numpy()
    order = np.lexsort((ids, null))
    return block.take(pa.array(order)), ids[order], null[order]


def _positives(moduli: list[int], most: int):
    def select(anchors: pa.Table, blocks):
        asked, row = matrix(anchors["v"]), anchors["row"].to_numpy()
        a = [residues(asked, p) for p in moduli]
        best = Best(most)
        for block in blocks:
            block, ids, null = _ordered(block)
            own, held = block["row"].to_numpy(), matrix(block["v"])
            b = [residues(held, p) for p in moduli]
            for lo in range(0, len(row), 1024):
                scores = product([x[lo : lo + 1024] for x in a], b, moduli)
                for i, s in enumerate(scores):
                    at = first_of(s, most + 1)
                    at = at[own[at] != row[lo + i]]
                    best.add(np.full(len(at), lo + i), s[at], ids[at], null[at])
        q, score, ids, null = best.settle()
        yield pa.RecordBatch.from_arrays([pa.array(row[q]), pa.array(ids, mask=null), pa.array(score)], ["row", "positive_id", "positive_score"])

    return select


def window(positive: int) -> tuple[int, int]:
    """The least and the highest score of a negative: half and 95 hundredths of the positive's, exact."""
    return -(-positive // 2), positive // 20 * 19 + positive % 20 * 19 // 20


def _negatives(moduli: list[int], most: int):
    def select(anchors: pa.Table, blocks):
        asked, row, label = matrix(anchors["v"]), anchors["row"].to_numpy(), anchors["label"].to_numpy()
        a = [residues(asked, p) for p in moduli]
        at, positives = list_column(anchors["positives"])
        given = [[window(s) for s in positives[lo:hi].field("positive_score").to_pylist()] for lo, hi in zip(at, at[1:])]
        lows, highs = (np.array([f(w[j] for w in ws) if ws else 0 for ws in given]) for f, j in ((min, 0), (max, 1)))
        best = Best(most)
        for block in blocks:
            block, ids, null = _ordered(block)
            theirs, held = block["label"].to_numpy(), matrix(block["v"])
            b = [residues(held, p) for p in moduli]
            for lo in range(0, len(row), 1024):
                scores = product([x[lo : lo + 1024] for x in a], b, moduli)
                part = slice(lo, lo + len(scores))
                may = (scores >= lows[part, None]) & (scores <= highs[part, None]) & (label[part, None] != theirs[None, :])
                for i in np.flatnonzero(may.any(axis=1)).tolist():
                    near = np.flatnonzero(may[i])
                    s = scores[i, near]
                    for j, (low, high) in enumerate(given[lo + i]):
                        inside = np.flatnonzero((s >= low) & (s <= high))
                        chosen = inside[first_of(s[inside], most)]
                        best.add(np.full(len(chosen), at[lo + i] + j), s[chosen], ids[near[chosen]], null[near[chosen]])
        pair, score, ids, null = best.settle()
        owner = np.searchsorted(at, pair, "right") - 1
        chosen = positives.take(pa.array(pair))
        names = ["row", "anchor_id", "place", "positive_id", "positive_score", "negative_id", "negative_score"]
        ask = pa.array(owner)
        yield pa.RecordBatch.from_arrays([pa.array(row[owner]), anchors["vec_id"].combine_chunks().take(ask), chosen.field("place").cast(pa.int32()), chosen.field("positive_id"), chosen.field("positive_score"), pa.array(ids, mask=null), pa.array(score)], names)

    return select


def hard_negatives(embeddings: DataFrame, every: int = EVERY, positives: int = POSITIVES, negatives: int = NEGATIVES, relabel: int = RELABEL, tile: int = TILE, lanes: int = LANES, block: int = BLOCK) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score and negative_score.

    Anchors are the rows whose vec_id is divisible by every; their positives are the rows of their label that score highest,
    and the negatives of a positive the highest rows of other labels between half and 95 hundredths of its score. Where
    vec_id is divisible by relabel, the label is first moved on by one, modulo 10. Ties go to the smaller vec_id, null last.

    Rows of null label or vector, or with null or non-finite components, take no part. Scores are the inner products of
    floor(256 * x), exact; beyond 64 bits they count as the nearest number that fits. Vectors of different lengths meet in
    the terms that both have, and an empty one scores 0. Repeated rows are rows of their own, as anchors, positives and
    negatives; a null vec_id is no anchor. An anchor without positives or negatives gives no rows, nor does an empty table.
    Other columns are ignored. No label needs to fit into a task, however many rows it has.
    """
    moved = F.expr(f"cast(case when vec_id % {relabel} = 0 then (cast(label as decimal(20,0)) + 1) % {CLASSES} else label end as bigint)")
    rows = narrowed(weighted(embeddings.where(F.col("label").isNotNull()), moved.alias("label")))
    anchors = rows.where(F.col("vec_id") % every == 0)
    n = anchors.count()
    moduli = primes(_bound(anchors, rows))
    near = meet(anchors, rows, n, ["label"], _positives(moduli, positives), "row long, positive_id long, positive_score long", tile, lanes, block)
    near = near.withColumn("place", F.expr("row_number() over (partition by row order by positive_score desc, positive_id asc nulls last)")).where(F.col("place") <= positives)
    chosen = near.groupBy("row").agg(F.array_sort(F.collect_list(F.struct("place", "positive_id", "positive_score"))).alias("positives"))
    asking = materialize(anchors.join(chosen, "row").select("row", "vec_id", "v", "label", "positives"), "anchors")
    asked = rows.select("row", "vec_id", "v", "label", F.lit(None).cast(asking.schema["positives"].dataType).alias("positives"))
    found = meet(asking, asked, n, [], _negatives(moduli, negatives), "row long, anchor_id long, place int, positive_id long, positive_score long, negative_id long, negative_score long", tile, lanes, block)
    ranked = found.withColumn("rank", F.expr("row_number() over (partition by row, place order by negative_score desc, negative_id asc nulls last)"))
    return ranked.where(F.col("rank") <= negatives).select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")


def op13_hard_negatives(spark, sf_dir):
    return hard_negatives(read_table(spark, sf_dir, "embeddings"))


ORACLE = """
WITH v AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS e FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT a.vec_id AS anchor_id, c.vec_id, a.label = c.label AS same, CAST(list_sum(list_transform(range(1, least(len(a.e), len(c.e)) + 1), lambda i: a.e[i] * c.e[i])) AS BIGINT) AS score FROM v a JOIN v c ON a.vec_id % 50 = 0 AND a.vec_id <> c.vec_id),
p AS (SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5)
SELECT p.anchor_id, positive_id, CAST(row_number() OVER (PARTITION BY p.anchor_id, positive_id ORDER BY score DESC, vec_id) AS INT) AS rank, vec_id AS negative_id, positive_score, score AS negative_score
FROM p JOIN s ON s.anchor_id = p.anchor_id AND NOT same AND 50 * positive_score <= 100 * score AND 100 * score <= 95 * positive_score
QUALIFY row_number() OVER (PARTITION BY p.anchor_id, positive_id ORDER BY score DESC, vec_id) <= 3
"""
