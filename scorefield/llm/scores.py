"""Integer inner products of some rows of a table with all rows, in blocks: what exhaustive search and hard-negative mining share.

Each component x of a vector becomes floor(256 * x). Rows that ask (queries) are dealt into tiles by a hash of their number,
rows that are asked (candidates) into lanes. Each pair of a tile and a lane is one group: its queries come first and are
held, then its candidates stream by, a batch at a time. So a task holds one tile and one batch, whatever a lane holds, and
no pair of rows is ever a row of a table: a group gives only what its selection keeps of each batch.
"""

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import list_column, materialize

SCALE = 256
#: Queries of a tile on average, lanes of candidates, and candidates that are scored at once.
TILE, LANES, BLOCK = 16384, 64, 4096
#: Scores and components beyond 64 bits count as the nearest of these.
HIGHEST = (1 << 63) - 1


def usable(vector: Column) -> Column:
    """Vectors without nulls and non-finite components. The empty one is usable."""
    finite = F.forall(vector, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < F.lit(float("inf"))))
    return F.coalesce(vector.isNotNull() & finite, F.lit(False))


def weighted(embeddings: DataFrame, *columns: Column) -> DataFrame:
    """row (a number of its own), vec_id, v (the weights) and further columns of the rows that take part."""
    vector = F.col("embedding").cast("array<double>")
    rows = embeddings.where(usable(vector)).select(F.col("vec_id").cast("long").alias("vec_id"), F.transform(vector, lambda x: F.greatest(F.floor(x * SCALE), F.lit(-HIGHEST))).alias("v"), *columns)
    return materialize(rows.withColumn("row", F.monotonically_increasing_id()), "weights")


def narrowed(rows: DataFrame) -> DataFrame:
    """The same rows with the weights in the narrowest type that holds them all, since they are what is shuffled."""
    most = rows.agg(F.max(F.greatest(F.array_max(F.transform("v", lambda x: F.abs(x))), F.lit(0)))).first()[0] or 0
    kind = "smallint" if most < 1 << 15 else "int" if most < 1 << 31 else "bigint"
    return rows.withColumn("v", F.col("v").cast(f"array<{kind}>"))


def matrix(column: pa.Array) -> np.ndarray:
    """The vectors as rows; shorter ones end in zeros, which add nothing to a product."""
    at, values = list_column(column)
    n = np.diff(at)
    out = np.zeros((len(n), int(n.max(initial=0))), np.int64)
    out[np.repeat(np.arange(len(n)), n), np.arange(len(values)) - np.repeat(at[:-1], n)] = values.to_numpy(zero_copy_only=False)
    return out


def highest(group: np.ndarray, score: np.ndarray, vec_id: np.ndarray, null: np.ndarray, most: int) -> np.ndarray:
    """Which rows are among the first of their group: by score, highest first, then by vec_id, null last."""
    order = np.lexsort((vec_id, null, -score, group))
    g = group[order]
    start = np.flatnonzero(np.concatenate([[True], g[1:] != g[:-1]])) if len(g) else np.zeros(0, np.int64)
    place = np.arange(len(g)) - np.repeat(start, np.diff(np.append(start, len(g))))
    return order[place < most]


def first_of(score: np.ndarray, most: int) -> np.ndarray:
    """Where the highest scores stand; of equal ones the first. Partition selection: no full sort."""
    if len(score) <= most:
        return np.arange(len(score))
    least = np.partition(score, len(score) - most)[len(score) - most]
    above = np.flatnonzero(score > least)
    return np.concatenate([above, np.flatnonzero(score == least)[: most - len(above)]])


class Best:
    """Rows of groups as they come, of which the first of each group are kept."""

    def __init__(self, most: int):
        self.most, self.held, self.size, self.limit = most, [], 0, 1 << 18

    def add(self, *columns: np.ndarray) -> None:
        """Columns: group, score, vec_id, and whether it is null."""
        self.held.append(columns)
        self.size += len(columns[0])
        if self.size > self.limit:
            self.settle()
            self.limit = max(1 << 18, 4 * self.size)

    def settle(self) -> tuple[np.ndarray, ...]:
        if not self.held:
            return tuple(np.zeros(0, t) for t in (np.int64, np.int64, np.int64, bool))
        columns = [np.concatenate(c) for c in zip(*self.held)]
        kept = highest(*columns, self.most)
        columns = tuple(c[kept] for c in columns)
        self.held, self.size = [columns], len(kept)
        return columns


def meet(queries: DataFrame, candidates: DataFrame, n_queries: int, by: list[str], select: Callable, schema: str, tile: int = TILE, lanes: int = LANES, block: int = BLOCK) -> DataFrame:
    """What select gives for each group of a tile of queries and a lane of candidates that agree in the columns by.

    queries and candidates have the same columns, row and those of by among them. select takes the queries of a group (a
    table) and an iterator of candidates (tables of at most block rows) and yields record batches.
    """
    tiles = -(-n_queries // tile) or 1
    dealt = F.xxhash64("row")
    columns = queries.columns
    asks = queries.withColumns({"tile": F.pmod(dealt, F.lit(tiles)).cast("int"), "lane": F.explode(F.sequence(F.lit(0), F.lit(lanes - 1))), "side": F.lit(0)})
    asked = candidates.select(*columns).withColumns({"tile": F.explode(F.sequence(F.lit(0), F.lit(tiles - 1))), "lane": F.pmod(dealt, F.lit(lanes)).cast("int"), "side": F.lit(1)})
    keys = [*by, "tile", "lane"]
    both = asks.unionByName(asked).repartition(*keys).sortWithinPartitions(*keys, "side", "row").select(*keys, "side", *(c for c in columns if c not in by))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from _groups(batches, len(keys), select, block)

    return both.mapInArrow(run, schema)


def _runs(batches: Iterator[pa.RecordBatch], keys: int, block: int) -> Iterator[tuple[tuple, pa.Table]]:
    """(key and side, rows) of the sorted rows: at most block rows at a time."""
    for batch in batches:
        if not batch.num_rows:
            continue
        head = [c.to_numpy(zero_copy_only=False) for c in batch.columns[: keys + 1]]
        changed = np.logical_or.reduce([c[1:] != c[:-1] for c in head])
        edges = [0, *(np.flatnonzero(changed) + 1).tolist(), batch.num_rows]
        for lo, hi in zip(edges, edges[1:]):
            key = tuple(c[lo] for c in head)
            for i in range(lo, hi, block):
                yield key, pa.Table.from_batches([batch.slice(i, min(block, hi - i))])


def _groups(batches: Iterator[pa.RecordBatch], keys: int, select: Callable, block: int) -> Iterator[pa.RecordBatch]:
    runs = _runs(batches, keys, block)
    ahead = next(runs, None)
    while ahead is not None:
        key, asks = ahead[0][:-1], []
        while ahead is not None and ahead[0] == (*key, 0):
            asks.append(ahead[1])
            ahead = next(runs, None)

        def stream() -> Iterator[pa.Table]:
            nonlocal ahead
            while ahead is not None and ahead[0] == (*key, 1):
                yield ahead[1]
                ahead = next(runs, None)

        rest = stream()
        if asks:
            yield from select(pa.concat_tables(asks), rest)
        for _ in rest:  # candidates that no query asks for
            pass
