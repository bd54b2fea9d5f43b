"""What the operators share: tables that cut lineage, chunks of texts as numpy arrays, hashes of words and windows,
and connected components.

Texts are handled as UTF-8 bytes in chunks of bounded size. Hashes are polynomials modulo 2**64 over random symbols,
taken from prefix sums, so that all words or windows of a chunk cost a few passes of numpy.
"""

import re
import tempfile
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of text that a task holds as numpy arrays at once (a longer document makes a chunk of its own).
CHUNK_BYTES = 2 << 20
LOWEST = -(1 << 63)


_local: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Where that is unset, a session that runs in one
    process (as in tests) takes a folder of its own; a cluster has no such folder, so there it is an error."""
    context = spark.sparkContext
    if found := context.getConf().get("spark.checkpoint.dir"):
        return found
    if not re.fullmatch(r"local(\[[^\]]*\])?", context.master):
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    if context.applicationId not in _local:
        _local[context.applicationId] = tempfile.mkdtemp(prefix="spark-checkpoint-")
    return _local[context.applicationId]


def materialize(df: DataFrame, name: str, random: bool = False, parquet: dict[str, str] | None = None) -> DataFrame:
    """df, written once to a table in the shared folder and read again: later plans start there and survive lost executors.
    random: most of it are hashes, which no dictionary makes smaller. parquet: options of the writer."""
    path = f"{shared_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    options = {"parquet.enable.dictionary": "false", "compression": "lz4_raw"} if random else {}
    df.write.options(**options, **(parquet or {})).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def discard(table: DataFrame) -> None:
    """Deletes a table that materialize wrote and nothing reads any more."""
    for folder in {f.rpartition("/")[0] for f in table.inputFiles()}:
        path = table.sparkSession._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(table.sparkSession._jsparkSession.sessionState().newHadoopConf()).delete(path, True)


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def labelled_sample(documents: DataFrame, labels: DataFrame, label: str, most: int) -> DataFrame:
    """doc_id, text and label of labelled documents, most rows at most however many there are or repeat.

    Of rows that repeat a doc_id in labels the largest label counts, of those in documents the text with the smallest hash
    (then the smallest text). Null doc_ids and labels are left out. Beyond the bound the smallest hashes of doc_id stay.
    """
    known = labels.where(F.col("doc_id").isNotNull() & F.col(label).isNotNull()).groupBy("doc_id").agg(F.max(F.col(label).cast("int")).alias(label))
    n = known.count()
    order = F.xxhash64("doc_id", F.lit(1))
    if n > most:
        known = known.where(F.pmod(order, F.lit(1 << 30)) < int((1 << 30) * most / n)).orderBy(order, "doc_id").limit(most)
    found = documents.select("doc_id", F.col("text").cast("string").alias("text"), F.xxhash64("text").alias("hash")).join(F.broadcast(known), "doc_id")  # known has so many rows at most
    one = F.min(F.struct("hash", "text")).alias("one")
    return found.groupBy("doc_id", label).agg(one).select("doc_id", "one.text", label)


# --- chunks of texts --------------------------------------------------------------------------------------------------


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column and len + 1 offsets into them; a null text is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if pa.types.is_string(column.type) or pa.types.is_binary(column.type):
        kind = np.int32
    else:
        kind = np.int64
    if column.null_count:
        column = column.fill_null("" if "string" in str(column.type) else b"")
    n = len(column)
    if n == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, kind, n + 1, column.offset * np.dtype(kind).itemsize).astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw[at[0] : at[-1]], at - at[0]


def chunks(batches: Iterator[pa.RecordBatch], text: str = "text", most: int = CHUNK_BYTES) -> Iterator[pa.RecordBatch]:
    """The batches cut into slices whose texts have at most so many bytes, or a single row."""
    for batch in batches:
        n = batch.num_rows
        if n == 0:
            continue
        _, at = text_bytes(batch.column(batch.schema.get_field_index(text)))
        lo = 0
        while lo < n:
            hi = max(lo + 1, int(np.searchsorted(at, at[lo] + most, "right")) - 1)
            yield batch.slice(lo, hi - lo)
            lo = hi


# --- hashes -----------------------------------------------------------------------------------------------------------

U = np.uint64


def mix(z: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values whose output bits all depend on all input bits."""
    z = z ^ (z >> U(30))
    z *= U(0xBF58476D1CE4E5B9)
    z ^= z >> U(27)
    z *= U(0x94D049BB133111EB)
    z ^= z >> U(31)
    return z


SYMBOLS = mix(np.arange(1, 257, dtype=U) * U(0x9E3779B97F4A7C15))
BASES = (0x9E3779B97F4A7C15, 0xD1342543DE82EF95)
_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def powers(n: int, base: int) -> tuple[np.ndarray, np.ndarray]:
    """base**i and base**-i modulo 2**64 for i < n at least."""
    held = _powers.get(base)
    if held is None or len(held[0]) < n:
        size = 1 << max(16, (n - 1).bit_length())
        both = []
        for b in (base, pow(base, -1, 1 << 64)):
            p = np.full(size, b, U)
            p[0] = 1
            both.append(np.multiply.accumulate(p))
        held = (both[0], both[1])
        if size <= 1 << 22:
            _powers[base] = held
    return held


def prefix_sums(symbols: np.ndarray, base: int) -> np.ndarray:
    sums = np.zeros(len(symbols) + 1, U)
    np.cumsum(symbols * powers(len(symbols) + 1, base)[0][: len(symbols)], out=sums[1:])
    return sums


def ngram_hashes(symbols: np.ndarray, n: int, base: int = BASES[0]) -> np.ndarray:
    """A 64-bit hash of each n consecutive symbols: len(symbols) - n + 1 of them."""
    if len(symbols) < n:
        return np.zeros(0, U)
    sums = prefix_sums(symbols, base)
    return mix((sums[n:] - sums[:-n]) * powers(len(symbols) + 1, base)[1][: len(symbols) - n + 1])


def span_hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray, base: int = BASES[0], block: int = 1 << 20) -> np.ndarray:
    """A 64-bit hash of each span [start, end) of the bytes; spans are ordered and don't overlap."""
    out = np.empty(len(start), U)
    i = 0
    while i < len(start):
        j = max(i + 1, int(np.searchsorted(end, start[i] + block, "right")))
        lo, hi = int(start[i]), int(end[j - 1])
        sums = prefix_sums(SYMBOLS[data[lo:hi]], base)
        out[i:j] = (sums[end[i:j] - lo] - sums[start[i:j] - lo]) * powers(hi - lo + 1, base)[1][start[i:j] - lo]
        i = j
    return mix(out + (end - start).astype(U))


# --- words ------------------------------------------------------------------------------------------------------------


def byte_class(*spans: tuple[int, int]) -> np.ndarray:
    """A table of 256 booleans that is true outside the given inclusive spans."""
    table = np.ones(256, bool)
    for lo, hi in spans:
        table[lo : hi + 1] = False
    return table


#: [^\x20\x09-\x0D]+
NOT_SPACE = byte_class((0x20, 0x20), (0x09, 0x0D))
#: [^\x00-\x2F\x3A-\x60\x7B-\x7F]+ of text without capital letters A-Z
LETTERS = byte_class((0x00, 0x2F), (0x3A, 0x60), (0x7B, 0x7F))
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


@dataclass
class Words:
    """The words of some texts. first[i] is the number of the first word of text i, first[-1] the number of words."""

    data: np.ndarray
    at: np.ndarray
    start: np.ndarray
    end: np.ndarray
    first: np.ndarray

    @property
    def count(self) -> np.ndarray:
        return np.diff(self.first)

    def text_of(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.first) - 1), self.count)

    def last(self) -> np.ndarray:
        """For each word, the number of the first word of the next text."""
        return np.repeat(self.first[1:], self.count)

    def hashes(self) -> np.ndarray:
        return span_hashes(self.data, self.start, self.end)


def words_of(column: pa.Array, table: np.ndarray = NOT_SPACE, lower: bool = False) -> Words:
    data, at = text_bytes(column)
    if lower:
        data = LOWER[data]
    inside = np.zeros(len(data) + 2, bool)
    inside[1:-1] = table[data]
    starts = inside[1:] & ~inside[:-1]
    ends = inside[:-1] & ~inside[1:]
    edge = at[(at > 0) & (at < len(data))]  # a word never crosses from one text to the next
    cut = edge[inside[edge] & inside[edge + 1]]
    starts[cut] = True
    ends[cut] = True
    start, end = np.flatnonzero(starts), np.flatnonzero(ends)
    return Words(data, at, start, end, np.searchsorted(start, at, "left"))


def row_base() -> int:
    """Numbers that no two tasks of a stage share."""
    context = TaskContext.get()
    return (context.partitionId() if context else 0) << 33


def signed(x: np.ndarray) -> np.ndarray:
    return np.ascontiguousarray(x).view(np.int64)


def lists(first: np.ndarray, values: pa.Array) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(first.astype(np.int32)), values)


# --- connected components ---------------------------------------------------------------------------------------------


def star_edges(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The smallest index reachable from each of n nodes by the links a[i]-b[i]; links and nodes of one bounded tile."""
    root = np.arange(n)
    while True:
        low = np.minimum(root[a], root[b])
        new = root.copy()
        np.minimum.at(new, a, low)
        np.minimum.at(new, b, low)
        np.minimum.at(new, root[a], low)
        np.minimum.at(new, root[b], low)
        new = new[new]
        if (new == root).all():
            return root
        root = new


def connected_components(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """node, component_id (the smallest node reachable) for each node of the links (a, b); other nodes have none.

    Alternates large and small stars: each round links nodes to the least neighbour. The least neighbour comes from a
    grouped minimum with partial sums, and the links come back by a join, so that no task holds the links of a hot node.
    Each round is a table in the shared folder. No links give no rows; null ends and loops are ignored. Rounds grow with the
    logarithm of a component's size; should they not settle in most_rounds, that is an error.
    """

    def stars(e: DataFrame, to: DataFrame) -> DataFrame:
        least = to.groupBy("u").agg(F.min("v").alias("m"))
        return e.join(least, "u")

    def tally(e: DataFrame):
        return tuple(e.agg(F.count("*"), F.sum(F.xxhash64("a", "b") % 1000003), F.sum(F.xxhash64("b", "a") % 998244353)).first())

    e = edges.where("a is not null and b is not null and a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    e = materialize(e, "links")
    seen = tally(e)
    for _ in range(most_rounds):
        if not seen[0]:
            break
        both = e.selectExpr("a as u", "b as v").unionByName(e.selectExpr("b as u", "a as v"))
        large = stars(both, both).selectExpr("v as a", "least(m, u) as b", "u").where("a > u and a <> b").select("a", "b").distinct()
        down = large.selectExpr("a as u", "b as v")
        small = stars(down, down)
        e = materialize(small.selectExpr("v as a", "m as b").unionByName(small.selectExpr("u as a", "m as b")).where("a <> b").distinct(), "links")
        now = tally(e)
        if now == seen:
            break
        seen = now
    else:
        raise RuntimeError(f"the components have not settled in {most_rounds} rounds")
    return e.selectExpr("a as node", "b as component_id").unionByName(e.selectExpr("b as node", "b as component_id").distinct())


# --- runs of equal keys in sorted streams -----------------------------------------------------------------------------


def columns_of(batch: pa.RecordBatch) -> list[np.ndarray]:
    return [c.to_numpy(zero_copy_only=False) for c in batch.columns]


def sorted_stream(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[tuple[list[np.ndarray], np.ndarray, np.ndarray]]:
    """Columns of rows sorted by their first columns, and for each row if its keys equal those of the row before and after.

    Holds one batch and one row, however many rows share a key.
    """
    held, held_same = None, False
    for batch in batches:
        if not batch.num_rows:
            continue
        cols = columns_of(batch)
        if held is not None:
            cols = [np.concatenate([h, c]) for h, c in zip(held, cols)]
        n = len(cols[0])
        before = np.zeros(n, bool)
        before[0] = held_same
        if n > 1:
            before[1:] = np.logical_and.reduce([c[1:] == c[:-1] for c in cols[:keys]])
        if n > 1:
            yield [c[:-1] for c in cols], before[:-1], before[1:]
        held, held_same = [c[-1:] for c in cols], bool(before[-1])
    if held is not None:
        yield held, np.array([held_same]), np.array([False])


def later(before: np.ndarray, moved: np.ndarray, carried: bool) -> np.ndarray:
    """For rows sorted by key and place: if a row of the same key stands at an earlier place. moved: the place differs from
    that of the row before; carried: the answer for the row before the first."""
    n = np.arange(len(before))
    start = np.maximum.accumulate(np.where(before, -1, n))
    step = np.maximum.accumulate(np.where(before & moved, n, -1))
    return (step > start) | ((start < 0) & carried)


def list_column(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Offsets and values of a column of lists; a null list is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    lengths = column.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
    at = np.zeros(len(lengths) + 1, np.int64)
    np.cumsum(lengths, out=at[1:])
    return at, column.flatten()
