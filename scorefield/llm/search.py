"""Exact top-k search: exhaustive, term at a time.

A component of a vector is a term. The candidates of a block are turned into postings: for each term the rows that hold it
with a weight other than zero, and these weights. A query row is sparse: its terms and weights. Each of its terms scatters
its postings, weighted, into a dense array of scores, one for each row of the block. Of these the highest are selected by
partition, and the selections of all blocks are merged.
"""

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import read_table
from .scores import BLOCK, HIGHEST, LANES, TILE, Best, first_of, matrix, meet, narrowed, weighted

EVERY, MOST = 50, 5


def _postings(weights: np.ndarray) -> list[tuple[np.ndarray | slice, np.ndarray]]:
    """For each term the rows that hold it, ascending, and their weights."""
    out = []
    for column in weights.T:
        rows = np.flatnonzero(column)
        out.append((slice(None), np.ascontiguousarray(column)) if len(rows) == len(column) else (rows, column[rows]))
    return out


def accumulate(terms: np.ndarray, weights: np.ndarray, postings: list, n: int, kind) -> np.ndarray:
    """The scores of n rows for one query."""
    scores = np.zeros(n, kind)
    for term, weight in zip(terms.tolist(), weights.tolist()):
        if term < len(postings):
            rows, held = postings[term]
            scores[rows] += held * weight
    return scores


def _select(most: int):
    def select(queries: pa.Table, blocks):
        asked = matrix(queries["v"])
        row = queries["row"].to_numpy()
        terms = [np.flatnonzero(q) for q in asked]
        heaviest = np.abs(asked).astype(np.float64).sum(axis=1).max(initial=0)
        best = Best(most)
        for block in blocks:
            null = block["vec_id"].is_null().to_numpy()
            ids = block["vec_id"].fill_null(0).to_numpy()
            order = np.lexsort((ids, null))  # so that of equal scores the first is the one that counts
            null, ids, own = null[order], ids[order], block["row"].to_numpy()[order]
            held = matrix(block["v"])[order]
            bound = heaviest * np.abs(held).astype(np.float64).max(initial=0)
            kind = np.int32 if bound < 2**30 else np.int64 if bound < 2**62 else object
            postings = _postings(held.astype(kind))
            for q in range(len(row)):
                scores = accumulate(terms[q], asked[q, terms[q]], postings, len(ids), kind)
                if kind is object:
                    scores = np.array([max(-HIGHEST, min(HIGHEST, s)) for s in scores], np.int64)
                at = first_of(scores, most + 1)
                at = at[own[at] != row[q]]
                best.add(np.full(len(at), q), scores[at].astype(np.int64), ids[at], null[at])
        q, score, ids, null = best.settle()
        yield pa.RecordBatch.from_arrays([pa.array(row[q]), queries["vec_id"].combine_chunks().take(pa.array(q)), pa.array(ids, mask=null), pa.array(score)], ["row", "query_id", "vec_id", "score"])

    return select


def top_k(embeddings: DataFrame, every: int = EVERY, most: int = MOST, tile: int = TILE, lanes: int = LANES, block: int = BLOCK) -> DataFrame:
    """query_id, rank (from 1), vec_id and score of the rows that score highest for each row whose vec_id is divisible by every.

    A score is the inner product of the rows' floor(256 * x), exact; beyond 64 bits it counts as the nearest number that
    fits, and so does a component. Of equal scores the smaller vec_id comes first, null last. Null vectors and those with null
    or non-finite components take no part, vectors of different lengths meet in the terms that both have, and an empty one
    scores 0. Repeated rows are rows of their own, as queries and as candidates; a row is no candidate of itself. A row of null
    vec_id asks nothing. One row alone, or none, gives no rows. Other columns are ignored.
    """
    rows = narrowed(weighted(embeddings))
    queries = rows.where(F.col("vec_id") % every == 0)
    found = meet(queries, rows, queries.count(), [], _select(most), "row long, query_id long, vec_id long, score long", tile, lanes, block)
    ranked = found.withColumn("rank", F.expr("row_number() over (partition by row order by score desc, vec_id asc nulls last)"))
    return ranked.where(F.col("rank") <= most).select("query_id", "rank", "vec_id", "score")


def op12_exact_top_k(spark, sf_dir):
    return top_k(read_table(spark, sf_dir, "embeddings"))


ORACLE = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
q AS (SELECT q.vec_id AS query_id, c.vec_id, list_sum(list_transform(range(1, least(len(q.e), len(c.e)) + 1), lambda i: q.e[i] * c.e[i])) AS score FROM v q JOIN v c ON q.vec_id % 50 = 0 AND q.vec_id <> c.vec_id)
SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INT) AS rank, vec_id, CAST(score AS BIGINT) AS score FROM q
QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) <= 5
"""
