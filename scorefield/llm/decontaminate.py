"""Benchmark decontamination by winnowing.

Of each ten-word window the smallest five-word hash is kept as its fingerprint. A window of a document that equals a
window of the benchmark has the same fingerprint, so joining fingerprints finds every shared span of ten words; a hit
is then extended to its whole window, compared by a 128-bit hash. Items of fewer words are one window of their own.
"""

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import BASES, LETTERS, U, chunks, lists, materialize, mix, ngram_hashes, read_table, row_base, signed, words_of

WINDOW, GRAM = 10, 5
#: log2 of the bits of the filter of benchmark fingerprints: 2 MiB whatever the benchmark's size. A fuller filter lets more rows go on to the join, and loses none.
FILTER_BITS = 24
KEYS = ["fp", "w1", "w2", "n"]
HIT = "fp long, w1 long, w2 long, start int, n int"


def _windows(words, n: int, gram: int):
    """Start, fingerprint and two hashes of each window of n words inside one text."""
    if len(words.start) < n:
        return None
    h = words.hashes()
    start = np.flatnonzero(np.arange(len(h)) + n <= words.last())
    if not len(start):
        return None
    w1 = ngram_hashes(h, n)
    k = min(gram, n)
    low = ngram_hashes(h, k, BASES[1])
    span = n - k + 1
    fp = low[: len(low) - span + 1].copy()
    for i in range(1, span):
        np.minimum(fp, low[i : len(low) - span + 1 + i], out=fp)
    return start, fp[start] ^ U(n), w1[start], h


def _second(h: np.ndarray, start: np.ndarray, n: int) -> np.ndarray:
    """A hash of the chosen windows that is independent of the others."""
    other = mix(h ^ U(0x5851F42D4C957F2D))
    out = np.zeros(len(start), U)
    for i in range(n):
        out = out * U(BASES[1]) + other[start + i]
    return mix(out)


def benchmark_windows(benchmark: DataFrame, window: int = WINDOW, gram: int = GRAM) -> DataFrame:
    """fp, w1, w2, n, item_id of each window of the items; an item of fewer words, but not none, is one window."""

    def scan(batches):
        for part in chunks(batches):
            ids, words = part.column(0), words_of(part.column(1), LETTERS, True)
            for n in range(1, window + 1):
                if (found := _windows(words, n, gram)) is None:
                    continue
                start, fp, w1, h = found
                text = words.text_of()[start]
                keep = (words.count[text] == n) if n < window else np.ones(len(start), bool)
                if keep.any():
                    start, fp, w1, text = start[keep], fp[keep], w1[keep], text[keep]
                    yield pa.RecordBatch.from_arrays([pa.array(signed(fp)), pa.array(signed(w1)), pa.array(signed(_second(h, start, n))), pa.array(np.full(len(start), n, np.int32)), ids.take(pa.array(text))], ["fp", "w1", "w2", "n", "item_id"])

    kind = benchmark.schema["item_id"].dataType.simpleString()
    return benchmark.select("item_id", "text").mapInArrow(scan, f"fp long, w1 long, w2 long, n int, item_id {kind}").distinct()


def _filter(spark, windows: DataFrame):
    """The benchmark's fingerprints as a bit map of fixed size, and the window lengths that occur."""
    slot = F.shiftrightunsigned("fp", 64 - FILTER_BITS)
    rows = windows.groupBy(F.shiftright(slot, 6).alias("at")).agg(F.bit_or(F.expr(f"shiftleft(1L, cast(shiftrightunsigned(fp, {64 - FILTER_BITS}) & 63 as int))")).alias("bits")).collect()
    bits = np.zeros(1 << (FILTER_BITS - 6), np.int64)
    for at, value in rows:
        bits[at] = value
    lengths = sorted(r[0] for r in windows.select("n").distinct().collect())
    return spark.sparkContext.broadcast((bits.view(U), lengths))


def _set_of(*columns: str):
    """A 192-bit hash of the set of rows of a group, whatever their order, from partial sums; rows are distinct."""
    one, other = F.xxhash64(*columns), F.xxhash64(F.lit(1), *columns)
    return F.struct(F.count("*").alias("n"), F.bit_xor(one).alias("a"), F.bit_xor(other).alias("b"), F.sum(one % (1 << 40)).alias("c"))


def _items(hits: DataFrame, bench: DataFrame) -> DataFrame:
    """row and items: the sorted ids of the items that hold a window of the row. hits: row and distinct windows.

    Windows of the same items are one class, and rows of the same classes one profile; only a profile is joined with items.
    """
    named = bench.where("item_id is not null").select(*KEYS, F.col("item_id").cast("string").alias("item")).distinct()
    windows = materialize(named.groupBy(*KEYS).agg(_set_of("item").alias("class")), "window-classes")
    of_class = windows.groupBy("class").agg(F.min(F.struct(*KEYS)).alias("one")).select("class", "one.*").join(named, KEYS).select("class", "item")
    held = materialize(hits.join(windows, KEYS).select("row", "class").distinct(), "row-classes")
    profiles = materialize(held.groupBy("row").agg(_set_of("class").alias("profile")), "row-profiles")
    first = profiles.groupBy("profile").agg(F.min("row").alias("row"))
    listed = first.join(held, "row").join(of_class, "class").select("profile", "item").distinct().groupBy("profile").agg(F.array_sort(F.collect_list("item")).alias("items"))
    return profiles.join(listed, "profile").select("row", "items")


def decontaminate(documents: DataFrame, benchmark: DataFrame, window: int = WINDOW, gram: int = GRAM) -> DataFrame:
    """Per row of documents: doc_id, text_hash (xxhash64 of the text), n_words, n_hit (words inside an occurrence of a
    benchmark window), items (sorted strings: ids of the items with occurring windows) and contaminated.

    Null and empty texts have no words and are clean; repeated rows are judged each for itself; other columns are
    ignored; items with a null id count for hits, not as items; items that share an id are one. Empty tables give clean
    documents or no rows. Texts of any length are taken whole. Both hashes of a window (128 bits) come from one 64-bit hash of
    each word, so two words that collide there are taken for equal.
    """
    spark = documents.sparkSession
    bench = materialize(benchmark_windows(benchmark, window, gram), "benchmark-windows")
    held = _filter(spark, bench)

    def scan(batches):
        bits, lengths = held.value
        row = row_base()
        for part in chunks(batches):
            words, found = words_of(part.column(1), LETTERS, True), []
            for n in lengths:
                if (w := _windows(words, n, gram)) is None:
                    continue
                start, fp, w1, h = w
                slot = fp >> U(64 - FILTER_BITS)
                keep = np.flatnonzero((bits[slot >> U(6)] >> (slot & U(63))) & U(1))
                found.append((start[keep], fp[keep], w1[keep], _second(h, start[keep], n), np.full(len(keep), n, np.int32)))
            start, fp, w1, w2, n = (np.concatenate(x) for x in zip(*found)) if found else (np.zeros(0, np.int64), *[np.zeros(0, U)] * 3, np.zeros(0, np.int32))
            order = np.argsort(start, kind="stable")
            start, fp, w1, w2, n = (x[order] for x in (start, fp, w1, w2, n))
            text = np.searchsorted(words.first, start, "right") - 1
            hits = pa.StructArray.from_arrays([pa.array(signed(fp)), pa.array(signed(w1)), pa.array(signed(w2)), pa.array((start - words.first[text]).astype(np.int32)), pa.array(n)], ["fp", "w1", "w2", "start", "n"])
            m = part.num_rows
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(row, row + m)), part.column(0), part.column(2), pa.array(words.count.astype(np.int64)), lists(np.searchsorted(text, np.arange(m + 1)), hits)], ["row", "doc_id", "text_hash", "n_words", "hits"])
            row += m

    kind = documents.schema["doc_id"].dataType.simpleString()
    rows = materialize(documents.select("doc_id", "text", F.xxhash64("text").alias("text_hash")).mapInArrow(scan, f"row long, doc_id {kind}, text_hash long, n_words long, hits array<struct<{HIT.replace(' ', ':').replace(',:', ',')}>>"), "decontaminate")
    hits = materialize(rows.where(F.size("hits") > 0).select("row", F.inline("hits")).join(bench.select(KEYS).distinct(), KEYS), "benchmark-hits")
    before = F.expr("max(start + n) over (partition by row order by start, n desc rows between unbounded preceding and 1 preceding)")
    covered = hits.select("row", "start", "n").distinct().select("row", (F.col("start") + F.col("n") - F.greatest("start", F.coalesce(before, F.lit(0)))).alias("new")).groupBy("row").agg(F.sum(F.greatest("new", F.lit(0))).alias("n_hit"))
    items = _items(hits.select("row", *KEYS).distinct(), bench)
    return (
        rows.drop("hits")
        .join(covered, "row", "left")
        .join(items, "row", "left")
        .select("doc_id", "text_hash", "n_words", F.coalesce("n_hit", F.lit(0)).cast("long").alias("n_hit"), F.coalesce("items", F.array().cast("array<string>")).alias("items"), F.col("n_hit").isNotNull().alias("contaminated"))
    )


def drop_contaminated(documents: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The documents without those that hold a benchmark window; columns as they are, whatever the others are called."""
    bad = decontaminate(documents, benchmark).where("contaminated").select(F.col("doc_id").alias("bad_id"), F.col("text_hash").alias("bad_hash")).distinct()
    rows = documents.select(F.col("doc_id").alias("d"), F.xxhash64("text").alias("h"), F.struct(*(documents[f"`{c}`"] for c in documents.columns)).alias("doc"))
    return rows.join(bad, F.col("d").eqNullSafe(F.col("bad_id")) & (F.col("h") == F.col("bad_hash")), "left_anti").select("doc.*")


def op10_benchmark_decontamination(spark, sf_dir):
    found = decontaminate(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.concat_ws(",", "items"), 256).alias("items_sha256"), "contaminated")


ORACLE = r"""
WITH low AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
bw AS (SELECT DISTINCT item_id, least(len(w), 10) AS n, array_to_string(w[i:i + least(len(w), 10) - 1], ' ') AS s FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 9, least(len(w), 1)) + 1)) AS i FROM b)),
dw AS (SELECT doc_id, n, i, array_to_string(w[i:i + n - 1], ' ') AS s FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM low, (SELECT DISTINCT n FROM bw) WHERE len(w) >= n)),
hit AS (SELECT doc_id, i, dw.n AS n, item_id FROM dw JOIN bw ON dw.n = bw.n AND dw.s = bw.s),
pos AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM hit) GROUP BY doc_id),
it AS (SELECT doc_id, count(*) AS n_items, string_agg(k, ',' ORDER BY k) AS items FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS k FROM hit) GROUP BY doc_id)
SELECT low.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM low LEFT JOIN pos USING (doc_id) LEFT JOIN it USING (doc_id)
"""
