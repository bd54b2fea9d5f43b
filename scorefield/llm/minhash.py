"""Near copies by SimHash fingerprints and by the Jaccard similarity of word shingles.

Fingerprints of few differing bits (simhash.py) link most near copies. Texts of a similarity of 0.8 differ in some ten of 64
bits, too many for that; so MinHash bands find further candidates, and whole shingle sets decide on these.

Texts with equal sets are collapsed first. A text gives one key for each band of minima; texts that share a key are
candidates. Each first meets the least text of its keys; then only texts of one key that are not linked yet meet, so a
large group of near copies makes one pair a text and key, not all pairs. Links inside a component change nothing, so the
components are those of all candidate pairs. A pair of similarity s shares no key with probability (1 - s**ROWS)**BANDS.
"""

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import simhash
from .common import U, chunks, connected_components, lists, materialize, mix, ngram_hashes, signed, words_of

SHINGLE = 5
#: The similarity as a fraction, so that bounds are exact.
NUM, DEN = 4, 5
#: At similarity 0.8 three pairs in a million share no key.
ROWS, BANDS = 5, 32
NO_ID = (1 << 63) - 1
FACTORS = mix(np.arange(1, ROWS * BANDS + 1, dtype=U) * U(0xD1342543DE82EF95)) | U(1)
SALTS = mix(np.arange(7, ROWS * BANDS + 7, dtype=U) * U(0x9E3779B97F4A7C15))


def shingle_sets(column: pa.Array, shingle: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """Offsets by text and distinct hashes of its shingles in order; fewer words are one shingle, no words none."""
    words = words_of(column, lower=True)
    h, count, of = words.hashes(), words.count, words.text_of()
    grams = ngram_hashes(h, shingle)
    inside = np.arange(len(grams)) + shingle <= words.last()[: len(grams)]
    short = np.flatnonzero((count > 0) & (count < shingle))
    at = np.arange(len(h)) - words.first[of]
    sums = np.zeros(len(h) + 1, U)
    np.cumsum(np.where(count[of] < shingle, mix(h + at.astype(U)), U(0)), out=sums[1:])
    whole = mix(sums[words.first[short + 1]] - sums[words.first[short]] + count[short].astype(U))
    text, value = np.concatenate([of[: len(grams)][inside], short]), np.concatenate([grams[inside], whole])
    order = np.lexsort((value, text))
    text, value = text[order], value[order]
    new = np.ones(len(text), bool)
    new[1:] = (text[1:] != text[:-1]) | (value[1:] != value[:-1])
    text, value = text[new], value[new]
    return np.searchsorted(text, np.arange(len(count) + 1)), value


def _nodes(first: np.ndarray, value: np.ndarray) -> np.ndarray:
    """A hash of each set."""
    sums = np.zeros(len(value) + 1, U)
    np.cumsum(mix(value ^ U(0x5851F42D4C957F2D)), out=sums[1:])
    return signed(mix(sums[first[1:]] - sums[first[:-1]] + np.diff(first).astype(U)))


def _signatures(batches):
    for part in chunks(batches):
        first, value = shingle_sets(part.column(2))
        n = np.diff(first)
        some = np.flatnonzero(n)
        keys = np.zeros((len(some), BANDS), U)
        if len(some):
            for k in range(ROWS * BANDS):
                band = k // ROWS
                least = np.minimum.reduceat((value ^ SALTS[k]) * FACTORS[k], first[some])
                keys[:, band] = mix((keys[:, band] if k % ROWS else U(band)) * U(0x2545F4914F6CDD1D) + least)
        at = np.zeros(len(n) + 1, np.int64)
        np.cumsum(np.where(n > 0, BANDS, 0), out=at[1:])
        yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(_nodes(first, value)), pa.array(n), lists(at, pa.array(signed(keys.ravel())))], ["d", "h", "node", "n", "keys"])


def _sets(batches):
    for part in chunks(batches):
        first, value = shingle_sets(part.column(0))
        yield pa.RecordBatch.from_arrays([pa.array(_nodes(first, value)), lists(first, pa.array(signed(value)))], ["node", "shingles"])


def _similar(rows: DataFrame, classes: DataFrame, pairs: DataFrame) -> DataFrame:
    """The pairs (a, b) of nodes whose sets are similar enough. pairs, classes: written tables."""
    named = pairs.selectExpr("a as node").unionByName(pairs.selectExpr("b as node")).distinct()
    places = materialize(classes.join(named, "node", "left_semi").select("d", "h"), "near-places")
    held = rows.join(places, ["d", "h"], "left_semi").select("doc.text").mapInArrow(_sets, "node long, shingles array<long>")
    held = materialize(held.dropDuplicates(["node"]), "near-sets")
    left, right = held.selectExpr("node as a", "shingles as sa"), held.selectExpr("node as b", "shingles as sb")
    both = F.size(F.array_intersect("sa", "sb"))
    alike = pairs.join(left, "a").join(right, "b").where(both * DEN >= (F.size("sa") + F.size("sb") - both) * NUM)
    return materialize(alike.select("a", "b"), "near-links")


def _fingerprint_links(rows: DataFrame, marked: DataFrame) -> DataFrame:
    """Links (a, b) between the nodes of texts in one component of fingerprints of the same shingles, as stars."""
    groups = simhash.near_groups(rows.select(F.col("d").alias("doc_id"), "doc.text"), SHINGLE).distinct()
    held = marked.select(F.col("d").alias("doc_id"), F.col("h").alias("text_hash"), "node").join(groups, ["doc_id", "text_hash"])
    held = materialize(held.select("c", "node").distinct(), "near-fingerprints")
    return held.join(held.groupBy("c").agg(F.min("node").alias("a")), "c").where("node <> a").select("a", F.col("node").alias("b"))


def drop_near_copies(documents: DataFrame) -> DataFrame:
    """One row of each component of texts linked by SimHash fingerprints of their five-word shingles (case ignored) that differ
    in 4 bits at most, or by a Jaccard similarity of 0.8 or more of the sets of these: the one with the smallest doc_id, and of rows that repeat it the one with the smallest hash; columns as
    they are, whatever the others are called. Null, empty and blank texts are alike and link to no other; texts of any length are
    taken whole, and no documents give no rows."""
    rows = documents.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("d"), F.xxhash64("text").alias("h"), F.struct(*(documents[f"`{c}`"] for c in documents.columns)).alias("doc"))
    marked = rows.select("d", "h", "doc.text").mapInArrow(_signatures, "d long, h long, node long, n long, keys array<long>")
    marked = materialize(marked, "near-signatures")
    classes = marked.groupBy("node").agg(F.min(F.struct("d", "h")).alias("at"), F.min("n").alias("n"), F.min("keys").alias("keys"))
    classes = materialize(classes.select("node", "at.d", "at.h", "n", "keys"), "near-classes")

    keyed = classes.select("node", "n", F.explode("keys").alias("key"))
    pivots = materialize(keyed.groupBy("key").agg(F.min(F.struct("node", "n")).alias("p"), F.count("*").alias("many")).where("many > 1").select("key", "p"), "near-keys")
    shared = materialize(keyed.join(pivots, "key"), "near-shared")

    # lengths that rule out the similarity are left out
    fits = lambda x, y: F.least(x, y) * DEN >= F.greatest(x, y) * NUM
    pairs = materialize(shared.where((F.col("node") != F.col("p.node")) & fits("n", "p.n")).select(F.col("p.node").alias("a"), F.col("node").alias("b")).distinct(), "near-pairs")
    links = _fingerprint_links(rows, marked).unionByName(_similar(rows, classes, pairs))
    links = materialize(links, "near-links")
    found = materialize(connected_components(links), "near-components")

    # of one key, what is not linked yet
    held = shared.join(found, "node", "left").select("key", "node", "n", F.coalesce("component_id", "node").alias("c"))
    held = materialize(held, "near-rest")
    mixed = held.groupBy("key").agg(F.min("c").alias("low"), F.max("c").alias("high")).where("low <> high").select("key")
    held = materialize(held.join(mixed, "key", "left_semi"), "near-rest")
    more = held.selectExpr("key", "node as a", "n as an", "c as ac").join(held.selectExpr("key", "node as b", "n as bn", "c as bc"), "key")
    more = more.where((F.col("a") < F.col("b")) & (F.col("ac") != F.col("bc")) & fits("an", "bn")).select("a", "b").distinct()
    more = materialize(more.join(pairs, ["a", "b"], "left_anti"), "near-pairs")
    more = _similar(rows, classes, more)
    if not more.isEmpty():
        found = materialize(connected_components(links.unionByName(more)), "near-components")

    firsts = classes.join(found, "node", "left").groupBy(F.coalesce("component_id", "node").alias("c")).agg(F.min(F.struct("d", "h")).alias("k"))
    kept = rows.join(firsts.select("k.d", "k.h"), ["d", "h"], "left_semi")
    return kept.dropDuplicates(["d", "h"]).select("doc.*")
