"""SimHash near-dedup: exact links between 64-bit fingerprints of word shingles, and their components.

Fingerprints that differ in few bits agree in whole blocks of bits, so each goes to one shard for every choice of blocks;
a shard of too many is dealt out once more, by blocks of the bits that are left. Shards are ordered by population count and
cut into tiles, which are compared tile against tile with exclusive-or and bit counts; tile pairs whose population counts
differ by more than the radius are skipped. Links come out as stars, never as all pairs.
"""

from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import U, chunks, connected_components, materialize, read_table, sorted_stream, star_edges, words_of

SHINGLE, RADIUS, SEED = 4, 4, 42
#: Fingerprints of a tile, of a batch of shards (a larger shard is a batch of its own), and of a shard before it is dealt out once more.
TILE, BATCH, CROWDED = 64, 20_000, 20_000


def fingerprints(documents: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """doc_id, text_hash (xxhash64 of the text) and fingerprint (long) per row: a bit is set if it is in over half of the
    XXH64 of the shingles, repeats included; fewer words are one shingle, and no words give zero."""

    def scan(batches):
        h64 = xxhash.xxh64_intdigest
        for part in chunks(batches):
            words = words_of(part.column(1), lower=True)
            n, last = len(words.start), words.last()
            more = np.arange(n) + 1 < last
            size = words.end - words.start
            data = np.append(words.data, np.uint8(0))
            data[words.end[more]] = 32  # one space after each word that another one of its text follows
            step = np.zeros(len(data) + 1, np.int8)
            step[words.start] += 1
            np.add.at(step, words.end + more, -1)
            joined = data[np.cumsum(step)[:-1] > 0].tobytes()
            begin = np.cumsum(size + more) - size - more
            end = begin + size
            count = words.count
            many = np.maximum(count - shingle + 1, np.minimum(count, 1))
            first = np.zeros(len(count) + 1, np.int64)
            np.cumsum(many, out=first[1:])
            text = np.repeat(np.arange(len(count)), many)
            at = words.first[text] + np.arange(first[-1]) - first[text]
            hashes = np.fromiter((h64(joined[a:b], SEED) for a, b in zip(begin[at].tolist(), end[np.minimum(at + shingle, last[at]) - 1].tolist())), U, len(at))
            out = np.zeros(len(count), U)
            weights = U(1) << np.arange(64, dtype=U)
            block = 1 << 17
            for i in np.flatnonzero(many):
                ones = np.zeros(64, np.int64)
                for lo in range(first[i], first[i + 1], block):
                    bits = np.unpackbits(hashes[lo : min(lo + block, first[i + 1])].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
                    ones += bits.sum(axis=0, dtype=np.int32)
                out[i] = weights[2 * ones > many[i]].sum(dtype=U)
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(2), pa.array(out.view(np.int64))], ["doc_id", "text_hash", "fingerprint"])

    kind = documents.schema["doc_id"].dataType.simpleString()
    return documents.select("doc_id", "text", F.xxhash64("text").alias("text_hash")).mapInArrow(scan, f"doc_id {kind}, text_hash long, fingerprint long")


def blocks(radius: int) -> list[list[int]]:
    """Bit masks, one of which two fingerprints within the radius agree on: two of radius + 2 blocks. Each with the masks
    for a crowded shard: the same blocks and one of radius + 1 blocks of the other bits."""
    edges = [round(64 * i / (radius + 2)) for i in range(radius + 3)]
    masks = [((1 << hi) - 1) ^ ((1 << lo) - 1) for lo, hi in zip(edges, edges[1:])]
    out = []
    for both in (a | b for a, b in combinations(masks, 2)):
        rest = [1 << k for k in range(64) if not both >> k & 1]
        cuts = [round(len(rest) * i / (radius + 1)) for i in range(radius + 2)]
        out.append([both, *(both | sum(rest[lo:hi]) for lo, hi in zip(cuts, cuts[1:]))])
    return [[m - (1 << 64) if m >= 1 << 63 else m for m in row] for row in out]


def tile_pairs(group: np.ndarray, count: np.ndarray, radius: int, tile: int):
    """Where the tiles of each pair that may hold links start; rows are ordered by group and population count."""
    n = len(group)
    for lo in range(0, n, tile):
        last = min(lo + tile, n) - 1
        yield lo, lo
        for other in range(lo + tile, n, tile):
            if group[other] != group[last] or count[other] - count[last] > radius:
                break
            yield lo, other


def linked(group: np.ndarray, value: np.ndarray, radius: int, tile: int = TILE) -> tuple[np.ndarray, np.ndarray]:
    """Stars of the rows of one group whose values differ in at most so many bits; rows as tile_pairs takes them."""
    n = len(group)
    a_all, b_all = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for lo, other in tile_pairs(group, np.bitwise_count(value).astype(np.int64), radius, tile):
        hi, end = min(lo + tile, n), min(other + tile, n)
        a, b = np.nonzero((np.bitwise_count(value[lo:hi, None] ^ value[None, other:end]) <= radius) & (group[lo:hi, None] == group[None, other:end]))
        a, b = a + lo, b + other
        a, b = a[a < b], b[a < b]
        if len(a) > tile:  # a star for each component of the pair of tiles
            nodes, flat = np.unique(np.concatenate([a, b]), return_inverse=True)
            root = star_edges(len(nodes), flat[: len(a)], flat[len(a) :])
            a, b = nodes[root != np.arange(len(nodes))], nodes[root[root != np.arange(len(nodes))]]
        a_all.append(a)
        b_all.append(b)
    root = star_edges(n, np.concatenate(a_all), np.concatenate(b_all))
    at = np.flatnonzero(root != np.arange(n))
    return at, root[at]


def _links(radius: int, tile: int):
    def stars(group, value, node):
        at, root = linked(group, value, radius, tile)
        if len(at):
            yield pa.RecordBatch.from_arrays([pa.array(node[at]), pa.array(node[root])], ["a", "b"])

    def scan(batches):
        held, base = [], 0
        for (_, _, _, value, node), before, after in sorted_stream(batches, 2):
            group = base + np.cumsum(~before)
            base = int(group[-1])
            keep = before | after
            held.append((group[keep], value[keep].view(U), node[keep]))
            if sum(len(h[0]) for h in held) >= BATCH:
                group, value, node = (np.concatenate(x) for x in zip(*held))
                done = group < base  # the last group may go on in the next batch
                if done.any():
                    yield from stars(group[done], value[done], node[done])
                held = [(group[~done], value[~done], node[~done])]
        if held:
            group, value, node = (np.concatenate(x) for x in zip(*held))
            if len(group):
                yield from stars(group, value, node)

    return scan


def links(classes: DataFrame, radius: int, tile: int = TILE, crowded: int = CROWDED) -> DataFrame:
    """Links (a, b) between the nodes of different fingerprints, as stars. classes: a written table of fingerprint and node."""
    masks = blocks(radius)
    key = F.col("mask").bitwiseAND(F.col("fingerprint"))
    shards = classes.select(F.posexplode(F.array(*(F.lit(m[0]) for m in masks))).alias("choice", "mask"), "fingerprint", "node").select("choice", key.alias("part"), "fingerprint", "node")
    full = materialize(shards.groupBy("choice", "part").agg(F.count("*").alias("many")).where(F.col("many") > crowded).drop("many"), "crowded-shards")
    if full.count():
        again = F.element_at(F.array(*(F.array(*(F.lit(x) for x in m[1:])) for m in masks)), F.col("choice") + 1)
        dealt = shards.join(full, ["choice", "part"]).select("choice", "fingerprint", "node", F.posexplode(again).alias("more", "mask"))
        dealt = dealt.select((F.col("choice") * (radius + 1) + F.col("more") + len(masks)).alias("choice"), key.alias("part"), "fingerprint", "node")
        shards = shards.join(full, ["choice", "part"], "left_anti").unionByName(dealt)
    rows = shards.select("choice", "part", F.bit_count("fingerprint").alias("bits"), "fingerprint", "node")
    return rows.repartition("choice", "part").sortWithinPartitions("choice", "part", "bits").mapInArrow(_links(radius, tile), "a long, b long")


def _components(documents: DataFrame, shingle: int, radius: int) -> tuple[DataFrame, DataFrame]:
    """The fingerprints of all rows, and fingerprint, smallest id and component (a fingerprint) of each class of equal ones."""
    marked = materialize(fingerprints(documents, shingle), "fingerprints")
    classes = marked.groupBy("fingerprint").agg(F.min(F.col("doc_id").cast("long")).alias("id"))
    classes = materialize(classes.select("fingerprint", F.col("fingerprint").alias("node"), "id"), "fingerprint-classes")
    found = connected_components(links(classes, radius))
    return marked, materialize(classes.join(found, "node", "left").select("fingerprint", "id", F.coalesce("component_id", "node").alias("c")), "fingerprint-components")


def near_duplicates(documents: DataFrame, shingle: int = SHINGLE, radius: int = RADIUS) -> DataFrame:
    """doc_id, text_hash, fingerprint (long) and component_id (the smallest doc_id reachable by links, itself included) per
    row of documents; fingerprints link if they differ in at most so many bits.

    Null, empty and blank texts have the fingerprint zero and link like any other. Repeated rows each keep their row, texts of
    any length are taken whole, and an empty table gives no rows. Only fingerprints link: rows that share a doc_id, or have
    none, are not linked by that. A null doc_id never names a component; where a component has no other, its component_id is null. Other columns are ignored.
    """
    marked, member = _components(documents, shingle, radius)
    named = member.join(member.groupBy("c").agg(F.min("id").alias("component_id")), "c").select("fingerprint", "component_id")
    return marked.join(named, "fingerprint").select("doc_id", "text_hash", "fingerprint", "component_id")


def near_groups(documents: DataFrame, shingle: int = SHINGLE, radius: int = RADIUS) -> DataFrame:
    """doc_id, text_hash and c per row of documents, the same c for the rows of one component of near_duplicates; ids of any
    kind, null ones too."""
    marked, member = _components(documents, shingle, radius)
    return marked.join(member.select("fingerprint", "c"), "fingerprint").select("doc_id", "text_hash", "c")


def op4_simhash_near_dedup(spark, sf_dir):
    found = near_duplicates(read_table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lpad(F.lower(F.hex("fingerprint")), 16, "0").alias("fingerprint"), "component_id")
