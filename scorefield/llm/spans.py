"""Suffix-array dedup: bytes that lie in a 100-byte string which also starts earlier in the corpus are removed.

Suffix arrays are built by induced sorting over shards, and equal strings are neighbours in a shard whose common prefix
is long enough. So that equal strings meet in one shard, each 100-byte window belongs to the 32-byte gram in it that has
the smallest hash; neighbouring windows mostly share it, and such a run of windows is a region. Only regions whose hash
occurs again travel; equal regions are collapsed first, and a shard holds those that differ. A hash with more regions
than a shard may hold goes on window by window instead, which gives the same rows.
"""

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import BASES, LOWEST, SYMBOLS, U, chunks, later, list_column, mix, ngram_hashes, read_table, signed, sorted_stream, text_bytes
from .substrings import KNOWN, _collapse, anchor_batch, anchor_rows, found_earlier, repeated_places, whole_rows, window_rows
from .suffix_array import common_prefixes, suffix_array

LENGTH, GRAM = 100, 32
#: Low bits that hold a gram's place while the least one is sought; the bits above them decide first.
PLACE_BITS = 36
#: Bytes of the regions that one suffix array takes.
SHARD_BYTES = 1 << 20


def _anchor_of(data: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """The hash of each gram, and for each window where its smallest gram stands, the leftmost of equal ones."""
    g = ngram_hashes(SYMBOLS[data], GRAM)
    low = (g & ~U((1 << PLACE_BITS) - 1)) | np.arange(len(g), dtype=U)
    span, have = length - GRAM + 1, 1
    while have < span:
        step = min(have, span - have)
        low = np.minimum(low[: len(low) - step], low[step:])
        have += step
    return g, (low & U((1 << PLACE_BITS) - 1)).astype(np.int64)


def _regions(data: np.ndarray, at: np.ndarray, length: int):
    """Text, first window, number of windows and key of each region; windows are numbered in their text.

    All windows of a region have one gram as anchor, so no two of them are equal, and equal windows have equal keys.
    """
    n = np.diff(at)
    if len(data) < length or not (n >= length).any():
        return None
    g, anchor = _anchor_of(data, length)
    count = np.maximum(n - length + 1, 0)
    text = np.repeat(np.arange(len(n)), count)
    first = np.zeros(len(n) + 1, np.int64)
    np.cumsum(count, out=first[1:])
    place = np.arange(first[-1]) - first[text]
    anchor = anchor[at[text] + place]
    new = np.ones(len(anchor), bool)
    new[1:] = anchor[1:] != anchor[:-1]
    start = np.flatnonzero(new)
    return text[start], place[start], np.diff(np.append(start, len(anchor))), g[anchor[start]]


def _anchors(length: int):
    def scan(batches):
        for part in chunks(batches):
            d = part.column(0).to_numpy(zero_copy_only=False)
            data, at = text_bytes(part.column(1))
            if (found := _regions(data, at, length)) is None:
                continue
            text, place, _, key = found
            whole = np.flatnonzero(np.diff(at) >= length)
            digests = np.array([np.frombuffer(hashlib.md5(data[at[i] : at[i + 1]]).digest(), U) for i in whole])
            yield anchor_batch(anchor_rows(key, d[text], place), whole_rows(digests[:, 0], digests[:, 1], d[whole]))

    return scan


def _repeated_regions(length: int):
    """The regions at places that are known to repeat: key, two hashes of the content, document, start, windows, content."""

    def scan(batches):
        for part in chunks(batches):
            lists_at, values = list_column(part.column(3))
            values = values.to_numpy(zero_copy_only=False).astype(np.int64)
            copied = part.column(4).fill_null(False).to_numpy(zero_copy_only=False)
            if copied.all() or not len(values):
                continue
            d = part.column(1).to_numpy(zero_copy_only=False)
            data, at = text_bytes(part.column(2))
            if (found := _regions(data, at, length)) is None:
                continue
            text, place, size, key = found
            of = np.repeat(np.arange(part.num_rows), np.diff(lists_at))
            wide = int(np.diff(at).max()) + 1
            chosen = np.isin(text * wide + place, of * wide + values) & ~copied[text]
            text, place, size, key = (x[chosen] for x in (text, place, size, key))
            if not len(text):
                continue
            lo = at[text] + place
            hi = lo + size + length - 1
            digests = np.array([np.frombuffer(hashlib.md5(data[a:b]).digest(), np.int64) for a, b in zip(lo, hi)])
            doc = d[text]
            order, same, after = _collapse(digests[:, 0], digests[:, 1], (doc, place))
            order, after = order[~same | after], after[~same | after]
            # the first of equal regions in this chunk carries the content; the later ones are removed wherever they meet
            sizes = np.where(after, 0, (hi - lo)[order])
            first = np.zeros(len(order) + 1, np.int32)
            np.cumsum(sizes, out=first[1:])
            index = np.repeat(lo[order] - first[:-1], sizes) + np.arange(first[-1])
            content = pa.Array.from_buffers(pa.binary(), len(order), [None, pa.py_buffer(first), pa.py_buffer(np.ascontiguousarray(data[index]))])
            spread = np.where(after, mix(doc[order].astype(U) * U(BASES[1]) + place[order].astype(U)), key[order])
            columns = [signed(spread), digests[order, 0], digests[order, 1], doc[order], place[order].astype(np.int32), size[order].astype(np.int32)]
            yield pa.RecordBatch.from_arrays([*(pa.array(c) for c in columns), content], ["k", "r1", "r2", "d", "s", "n", "content"])

    return scan


class _Shard:
    """Regions that differ, gathered until one suffix array judges them."""

    def __init__(self, length: int):
        self.length, self.rows, self.bytes = length, [], 0

    def add(self, rows: list) -> None:
        self.rows += rows
        self.bytes += sum(len(r[3]) + 1 for r in rows)

    def judge(self):
        """Document, first window and number of windows of the runs that also stand earlier in the shard."""
        rows, self.rows, self.bytes = self.rows, [], 0
        if not rows:
            return None
        data = np.frombuffer(b"".join(b for r in rows for b in (r[3], b"\0")), np.uint8).astype(np.int16) + 2
        sizes = np.array([len(r[3]) + 1 for r in rows])
        at = np.cumsum(sizes) - sizes
        data[at + sizes - 1] = 1
        t = np.append(data, np.int16(0))
        sa = suffix_array(t)
        prefix = common_prefixes(t, sa)
        region = np.repeat(np.arange(len(rows)), sizes)
        offset = np.arange(len(t) - 1) - at[region]
        windows = np.array([r[2] for r in rows])
        valid = np.append(offset < windows[region], False)[sa]
        group = np.cumsum(prefix < self.length)[valid]
        p = sa[valid]
        doc, place = np.array([r[0] for r in rows])[region[p]], np.array([r[1] for r in rows])[region[p]] + offset[p]
        order, same, after = _collapse(group.astype(U), None, (doc, place))
        hit = np.sort(p[order[after]])
        if not len(hit):
            return None
        new = np.ones(len(hit), bool)
        new[1:] = (np.diff(hit) != 1) | (region[hit[1:]] != region[hit[:-1]])
        first = np.flatnonzero(new)
        return np.array([rows[i][0] for i in region[hit[first]]]), np.array([rows[i][1] for i in region[hit[first]]]) + offset[hit[first]], np.diff(np.append(first, len(hit)))


def _judged(length: int, most: int):
    """Rows (k, d, e, n): runs of n windows that are known to go, and single windows that are still to be judged."""
    names = ["k", "d", "e", "n"]

    def out(d, s, n):
        d, s = np.asarray(d, np.int64), np.asarray(s).astype(np.int64)
        return pa.RecordBatch.from_arrays([pa.array(signed(mix(d.astype(U) * U(BASES[1]) + s.astype(U)))), pa.array(d), pa.array(s << 2 | KNOWN), pa.array(np.asarray(n).astype(np.int32))], names)

    def hot(rows):
        for d, s, n, content in rows:
            raw = bytes(content)
            both = np.array([np.frombuffer(hashlib.md5(raw[i : i + length]).digest(), U) for i in range(n)])
            batch = window_rows(both[:, 0], both[:, 1], np.full(n, d), s + np.arange(n))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(np.ones(batch.num_rows, np.int32))], names)

    def scan(batches):
        shard, key, group, size, single = _Shard(length), None, [], 0, False
        last, carried = None, False

        def flush():
            found = shard.judge()
            if found is not None:
                yield out(*found)

        for (k, _, _, d, s, n, content), before, _ in sorted_stream(batches, 3):
            moved = np.ones(len(d), bool)
            moved[1:] = (d[1:] != d[:-1]) | (s[1:] != s[:-1])
            moved[0] = last is None or (d[0], s[0]) != last
            after = later(before, moved, carried)
            carried, last = bool(after[-1]), (d[-1], s[-1])
            after |= np.array([len(x) == 0 for x in content])
            if after.any():
                yield out(d[after], s[after], n[after])
            for i in np.flatnonzero(~before & ~after):
                row = (d[i], int(s[i]), int(n[i]), content[i])
                if k[i] != key:
                    if len(group) > 1:
                        shard.add(group)
                        if shard.bytes >= most:
                            yield from flush()
                    key, group, size, single = k[i], [], 0, False
                if single:
                    yield from hot([row])
                    continue
                group.append(row)
                size += len(row[3]) + 1
                if size > most and len(group) > 1:
                    yield from hot(group)
                    group, single = [], True
        if len(group) > 1:
            shard.add(group)
        yield from flush()

    return scan


def _removal(length: int):
    def scan(batches):
        for part in chunks(batches):
            data, at = text_bytes(part.column(2))
            n = np.diff(at)
            lists_at, values = list_column(part.column(5))
            s = values.field(0).to_numpy(zero_copy_only=False).astype(np.int64)
            count = values.field(1).to_numpy(zero_copy_only=False).astype(np.int64)
            gone = np.zeros(len(data), bool)
            if len(s):
                base = at[np.repeat(np.arange(part.num_rows), np.diff(lists_at))]
                step = np.zeros(len(data) + 1, np.int32)
                end = at[1:][np.repeat(np.arange(part.num_rows), np.diff(lists_at))]
                np.add.at(step, np.minimum(base + s, end), 1)
                np.add.at(step, np.minimum(base + s + count + length - 1, end), -1)
                gone = np.cumsum(step)[:-1] > 0
            gone |= np.repeat(part.column(4).fill_null(False).to_numpy(zero_copy_only=False), n)
            kept = np.zeros(len(data) + 1, np.int64)
            np.cumsum(~gone, out=kept[1:])
            opens = gone.copy()
            opens[1:] &= ~gone[:-1]
            edge = at[:-1][n > 0]
            opens[edge] = gone[edge]
            spans = np.zeros(len(data) + 1, np.int64)
            np.cumsum(opens, out=spans[1:])
            left = pa.Array.from_buffers(pa.binary(), part.num_rows, [None, pa.py_buffer(kept[at].astype(np.int32)), pa.py_buffer(np.ascontiguousarray(data[~gone]))])
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(n), pa.array(n - np.diff(kept[at])), pa.array(np.diff(spans[at])), left], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept"])

    return scan


def dedup_spans(documents: DataFrame, length: int = LENGTH, shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """Per row of documents: doc_id, n_bytes, n_removed, n_spans (maximal removed runs) and kept (binary: the bytes that stay).

    A byte goes if a string of so many bytes covers it that also starts earlier (smaller doc_id, or the same one and an
    earlier start); all strings are judged on the input, overlaps count, and none crosses documents. Null and empty texts
    have no bytes. Rows that share a doc_id stand at one place: they don't remove each other, and what is removed from one
    is removed from each. A null doc_id stands before all others. Texts of any length are taken whole, one at a time where one
    is longer than a chunk; an empty table gives no rows. Other columns are ignored.
    """
    if length <= GRAM:
        raise ValueError(f"a string has more than {GRAM} bytes")
    docs = documents.select("doc_id", F.coalesce(F.col("doc_id").cast("long"), F.lit(LOWEST)).alias("d"), F.col("text").cast("string").alias("text"))
    places = repeated_places(docs.select("d", "text").mapInArrow(_anchors(length), "key long, d long, rest int"))
    dealt = docs.join(places, "d", "left").select("doc_id", "d", "text", "ps", "copied")  # both uses take all of it, so that one exchange serves them
    regions = dealt.mapInArrow(_repeated_regions(length), "k long, r1 long, r2 long, d long, s int, n int, content binary")
    judged = regions.repartition("k").sortWithinPartitions("k", "r1", "r2", "d", "s").mapInArrow(_judged(length, shard_bytes), "k long, d long, e long, n int")
    gone = found_earlier(judged)
    gone = gone.groupBy("d").agg(F.collect_list(F.struct("s", "n")).alias("gone"))
    kind = documents.schema["doc_id"].dataType.simpleString()
    return dealt.join(gone, "d", "left").select("doc_id", "d", "text", "ps", "copied", "gone").mapInArrow(_removal(length), f"doc_id {kind}, n_bytes long, n_removed long, n_spans long, kept binary")


def op9_suffix_array_dedup(spark, sf_dir):
    return dedup_spans(read_table(spark, sf_dir, "documents")).select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


ORACLE = r"""
WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS x FROM documents),
win AS (SELECT doc_id, i, md5(x[2 * i + 1:2 * i + 200]) AS s FROM (SELECT doc_id, x, unnest(range(0, len(x) // 2 - 99)) AS i FROM d WHERE len(x) >= 200)),
hit AS (SELECT doc_id, i FROM (SELECT doc_id, i, row_number() OVER (PARTITION BY s ORDER BY doc_id, i) AS n FROM win) WHERE n > 1),
gap AS (SELECT doc_id, i, CASE WHEN i - lag(i) OVER (PARTITION BY doc_id ORDER BY i) <= 100 THEN 0 ELSE 1 END AS new FROM hit),
run AS (SELECT doc_id, i, sum(new) OVER (PARTITION BY doc_id ORDER BY i) AS r FROM gap),
span AS (SELECT doc_id, r, min(i) AS lo, max(i) + 100 AS hi FROM run GROUP BY doc_id, r),
edge AS (SELECT doc_id, r, lo, hi, lead(lo) OVER (PARTITION BY doc_id ORDER BY lo) AS nxt, row_number() OVER (PARTITION BY doc_id ORDER BY lo) AS k FROM span),
cut AS (SELECT doc_id, sum(hi - lo) AS n_removed, count(*) AS n_spans, min(lo) AS first, list(struct_pack(hi := hi, nxt := nxt) ORDER BY lo) AS pieces FROM edge GROUP BY doc_id)
SELECT d.doc_id, CAST(len(x) // 2 AS BIGINT) AS n_bytes, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed, CAST(coalesce(n_spans, 0) AS BIGINT) AS n_spans,
sha256(unhex(CASE WHEN first IS NULL THEN x ELSE x[1:2 * first] || array_to_string(list_transform(pieces, lambda p: x[2 * p.hi + 1:2 * coalesce(p.nxt, len(x) // 2)]), '') END)) AS kept_sha256
FROM d LEFT JOIN cut ON d.doc_id = cut.doc_id
"""
