"""Substring dedup: words that lie in a window of words which also starts earlier in the corpus are removed.

Difference-cover anchors: short windows are hashed only where the position modulo a period is in a difference cover. Any
two equal long windows, wherever they start, then hold a pair of equal anchors at the same place of each. So one shuffle
of about a third of the positions finds every stretch that may repeat; only there are the long windows hashed (91 bits)
and compared, which extends the anchors to whole matches.
"""

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import BASES, LOWEST, U, chunks, columns_of, later, list_column, mix, ngram_hashes, read_table, signed, sorted_stream, words_of

WINDOW = 20
#: A perfect difference set: every difference modulo 13 is one of two of its members.
PERIOD, COVER = 13, (0, 1, 3, 9)
SINGLE, SEVERAL, KNOWN, WHOLE = 0, 1, 2, 3


def _collapse(key: np.ndarray, check: np.ndarray | None, place: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Order by key and place; if each row repeats the key of the one before; if its place is later than the key's first."""
    order = np.lexsort((place[1], place[0], key) if check is None else (place[1], place[0], check, key))
    k, a, b = key[order], place[0][order], place[1][order]
    same = np.zeros(len(k), bool)
    same[1:] = k[1:] == k[:-1]
    if check is not None:
        c = check[order]
        same[1:] &= c[1:] == c[:-1]
    moved = np.ones(len(k), bool)
    moved[1:] = (a[1:] != a[:-1]) | (b[1:] != b[:-1])
    return order, same, later(same, moved, False)


def anchor_rows(key: np.ndarray, doc: np.ndarray, place: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rows (key, d, rest) of the anchors of a chunk, in their order, so that neighbours compress well.

    47 bits of the hash and the low 16 of the place make the key; rest has the others and the kind. Of a hash that is in
    the chunk several times one row meets the other chunks' rows; the rest are known to repeat and are dealt anywhere, so
    that a hot hash sends one row a chunk.
    """
    order, same, _ = _collapse(key, None, (doc, place))
    kind = np.empty(len(key), np.int64)
    ordered = np.where(same, KNOWN, SINGLE)
    ordered[:-1][~same[:-1] & same[1:]] = SEVERAL
    kind[order] = ordered
    key = np.where(kind == KNOWN, mix(doc.astype(U) * U(BASES[1]) + place.astype(U)), key)
    return ((key >> U(17)) << U(16)) | (place & 0xFFFF).astype(U), doc, ((place >> 16) << 2) | kind


def whole_rows(one: np.ndarray, two: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rows of whole documents by two hashes; the sign of the key tells them from anchors."""
    return one | U(1 << 63), doc, ((two >> U(35)) << U(2)).astype(np.int64) | WHOLE


def anchor_batch(*rows: tuple[np.ndarray, np.ndarray, np.ndarray]) -> pa.RecordBatch:
    key, doc, rest = (np.concatenate(x) for x in zip(*rows))
    return pa.RecordBatch.from_arrays([pa.array(signed(key)), pa.array(doc), pa.array(rest.astype(np.int32))], ["key", "d", "rest"])


def _anchors(window: int):
    gram = window - PERIOD + 1
    at_cover = np.isin(np.arange(PERIOD), COVER)

    def scan(batches):
        for part in chunks(batches):
            d, words = part.column(0).to_numpy(zero_copy_only=False), words_of(part.column(1))
            h, text, n, out = words.hashes(), words.text_of(), words.count, []
            if len(h) >= gram:
                p = np.arange(len(h) - gram + 1)
                p = p[at_cover[(p - words.first[text[p]]) % PERIOD] & (p + gram <= words.last()[p]) & (n[text[p]] >= window)]
                out.append(anchor_rows(ngram_hashes(h, gram)[p], d[text[p]], p - words.first[text[p]]))
            whole = np.flatnonzero(n >= window)
            if len(whole):
                at, weights = words.first, _weights(int(n.max()))
                one, two = (mix(np.array([np.add.reduce(x[at[i] : at[i + 1]] * weights[: n[i]]) for i in whole], U)) for x in (h, mix(h ^ U(BASES[0]))))
                out.append(whole_rows(one, two, d[whole]))
            if out:
                yield anchor_batch(*out)

    return scan


_held_weights = np.zeros(0, U)


def _weights(n: int) -> np.ndarray:
    global _held_weights
    if len(_held_weights) < n:
        _held_weights = mix(np.arange(1, 2 * n + 2, dtype=U) * U(BASES[1])) | U(1)
    return _held_weights


def repeated_places(anchors: DataFrame) -> DataFrame:
    """d, ps (places of anchors that occur again) and copied (the document is an exact copy of an earlier one)."""

    def with_class(source):
        for batch in source:
            key, d, rest = columns_of(batch)
            whole = key < 0
            low = key & 0xFFFF
            yield pa.RecordBatch.from_arrays([pa.array(key >> 16), pa.array(np.where(whole, low << 32 | rest, -1)), pa.array(np.where(whole, -1, (rest.astype(np.int64) >> 2) << 16 | low)), pa.array(rest & 3), pa.array(d)], ["h", "c", "p", "kind", "d"])

    def scan(batches):
        carried, last = False, None
        for (_, _, p, kind, d), before, after in sorted_stream(with_class(batches), 2):
            moved = np.ones(len(d), bool)
            moved[1:] = d[1:] != d[:-1]
            moved[0] = last is None or d[0] != last
            copy = later(before, moved, carried)
            carried, last = bool(copy[-1]), d[-1]
            keep = np.where(kind == WHOLE, copy, before | after | (kind != SINGLE))
            if keep.any():
                yield pa.RecordBatch.from_arrays([pa.array(d[keep]), pa.array(p[keep].astype(np.int32))], ["d", "p"])

    places = anchors.repartition(F.shiftright("key", 16)).sortWithinPartitions("key", "rest", "d").mapInArrow(scan, "d long, p int")
    return places.groupBy("d").agg(F.collect_list("p").alias("ps"), (F.min("p") < 0).alias("copied"))


def _spread(at: np.ndarray, values: np.ndarray, first: np.ndarray, n: np.ndarray, length: int, before: int = 0) -> np.ndarray:
    """A mask of words (or bytes) of a chunk: those of [value - before, value + length) of their text."""
    text = np.repeat(np.arange(len(at) - 1), np.diff(at))
    lo = first[text] + np.maximum(values - before, 0)
    hi = first[text] + np.minimum(values + length, n[text])
    step = np.zeros(int(first[-1]) + 1, np.int32)
    np.add.at(step, lo, 1)
    np.add.at(step, hi, -1)
    return np.cumsum(step)[:-1] > 0


def window_rows(key: np.ndarray, check: np.ndarray, doc: np.ndarray, place: np.ndarray) -> pa.RecordBatch:
    """Rows (k, d, e) of windows in their order: e has 27 more bits of the hash, the place and the kind.

    Rows of this chunk that are later than another of their window are known to go, and are dealt anywhere.
    """
    order, same, ordered = _collapse(key, check, (doc, place))
    after, keep = np.empty(len(key), bool), np.empty(len(key), bool)
    after[order] = ordered
    keep[order] = ~same | ordered  # rows at the very place of the key's first say nothing new
    kind = np.where(after, KNOWN, SINGLE)
    key = np.where(after, mix(doc.astype(U) * U(BASES[1]) + place.astype(U)), key)
    e = ((check >> U(37)) << U(36)).astype(np.int64) | place << 2 | kind
    return pa.RecordBatch.from_arrays([pa.array(signed(key)[keep]), pa.array(doc[keep]), pa.array(e[keep])], ["k", "d", "e"])


def found_earlier(windows: DataFrame) -> DataFrame:
    """d, s of the windows that also stand at an earlier place; where rows have n, it stays with them."""
    more = windows.columns[3:]

    def split(source):
        for batch in source:
            k, d, e, *rest = columns_of(batch)
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in (k, e >> 36, d, e >> 2 & ((1 << 34) - 1), e & 3, *rest)], ["k", "c", "d", "s", "kind", *more])

    def scan(batches):
        carried, last = False, None
        for (_, _, d, s, kind, *rest), before, _ in sorted_stream(split(batches), 2):
            moved = np.ones(len(d), bool)
            moved[1:] = (d[1:] != d[:-1]) | (s[1:] != s[:-1])
            moved[0] = last is None or (d[0], s[0]) != last
            seen = later(before, moved, carried)
            carried, last = bool(seen[-1]), (d[-1], s[-1])
            seen = seen | (kind == KNOWN)
            if seen.any():
                yield pa.RecordBatch.from_arrays([pa.array(x[seen]) for x in (d, s.astype(np.int32), *rest)], ["d", "s", *more])

    return windows.repartition("k").sortWithinPartitions("k", F.shiftright("e", 36), "d", "e").mapInArrow(scan, ", ".join(["d long, s int", *(f"{c} int" for c in more)]))


def _windows(window: int):
    gram = window - PERIOD + 1

    def scan(batches):
        for part in chunks(batches):
            at, values = list_column(part.column(3))
            copied = part.column(4).fill_null(False).to_numpy(zero_copy_only=False)
            values = values.to_numpy(zero_copy_only=False).astype(np.int64)
            keep = ~np.repeat(copied, np.diff(at)) & (values >= 0)
            if not keep.any():
                continue
            d, words = part.column(1).to_numpy(zero_copy_only=False), words_of(part.column(2))
            kept_at = np.zeros(part.num_rows + 1, np.int64)
            np.cumsum(np.bincount(np.repeat(np.arange(part.num_rows), np.diff(at))[keep], minlength=part.num_rows), out=kept_at[1:])
            mask = _spread(kept_at, values[keep], words.first, words.count, 1, window - gram)
            h, last = words.hashes(), words.last()
            start = np.flatnonzero(mask & (np.arange(len(h)) + window <= last))
            if len(start):
                text = np.searchsorted(words.first, start, "right") - 1
                yield window_rows(ngram_hashes(h, window)[start], ngram_hashes(mix(h ^ U(BASES[0])), window, BASES[1])[start], d[text], start - words.first[text])

    return scan


def _removal(window: int):
    def scan(batches):
        for part in chunks(batches, "text"):
            words, n = words_of(part.column(2)), part.num_rows
            at, values = list_column(part.column(5))
            gone = _spread(at, values.to_numpy(zero_copy_only=False).astype(np.int64), words.first, words.count, window)
            copied = part.column(4).fill_null(False).to_numpy(zero_copy_only=False)
            gone |= np.repeat(copied, words.count)
            keep = np.flatnonzero(~gone)
            text = np.searchsorted(words.first, keep, "right") - 1
            # the bytes of kept words, each followed by one space but for the last of its text
            data = np.append(words.data, np.uint8(0))
            step = np.zeros(len(data) + 1, np.int8)
            step[words.start[keep]] += 1
            more = np.zeros(len(keep), bool)
            more[:-1] = text[1:] == text[:-1]
            np.add.at(step, words.end[keep] + more, -1)
            data[words.end[keep[more]]] = 32
            mask = np.cumsum(step)[:-1] > 0
            sizes = np.bincount(text, weights=words.end[keep] - words.start[keep] + more, minlength=n).astype(np.int64)
            first = np.zeros(n + 1, np.int32)
            np.cumsum(sizes, out=first[1:])
            removed = np.bincount(np.searchsorted(words.first, np.flatnonzero(gone), "right") - 1, minlength=n)
            kept = pa.Array.from_buffers(pa.string(), n, [None, pa.py_buffer(first), pa.py_buffer(np.ascontiguousarray(data[mask[: len(data)]]))])
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(words.count.astype(np.int64)), pa.array(removed.astype(np.int64)), kept], ["doc_id", "n_words", "n_removed", "kept"])

    return scan


def dedup_substrings(documents: DataFrame, window: int = WINDOW) -> DataFrame:
    """Per row of documents: doc_id, n_words, n_removed and kept (the words that stay, joined by one space).

    A word goes if a window of so many consecutive words covers it whose words also start earlier (smaller doc_id, or the
    same one and an earlier start); all windows are judged on the input. Null and empty texts have no words. Rows that
    share a doc_id stand at one place: they don't remove each other, and what is removed from one is removed from each. A
    null doc_id stands before all others. Texts of any length are taken whole, one at a time where one is longer than a chunk; an
    empty table gives no rows. Other columns are ignored.
    """
    if window < PERIOD:
        raise ValueError(f"a window has {PERIOD} words at least")
    docs = documents.select(F.col("doc_id").alias("doc_id"), F.coalesce(F.col("doc_id").cast("long"), F.lit(LOWEST)).alias("d"), F.col("text").cast("string").alias("text"))
    places = repeated_places(docs.select("d", "text").mapInArrow(_anchors(window), "key long, d long, rest int"))
    dealt = docs.join(places, "d", "left").select("doc_id", "d", "text", "ps", "copied")  # both uses take all of it, so that one exchange serves them
    found = found_earlier(dealt.mapInArrow(_windows(window), "k long, d long, e long")).groupBy("d").agg(F.collect_list("s").alias("starts"))
    kind = documents.schema["doc_id"].dataType.simpleString()
    return dealt.join(found, "d", "left").select("doc_id", "d", "text", "ps", "copied", "starts").mapInArrow(_removal(window), f"doc_id {kind}, n_words long, n_removed long, kept string")


def op5_substring_dedup(spark, sf_dir):
    return dedup_substrings(read_table(spark, sf_dir, "documents")).select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


ORACLE = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
win AS (SELECT doc_id, i, md5(array_to_string(w[i:i + 19], ' ')) AS s FROM (SELECT doc_id, w, unnest(range(1, len(w) - 18)) AS i FROM d WHERE len(w) >= 20)),
hit AS (SELECT doc_id, i FROM (SELECT doc_id, i, row_number() OVER (PARTITION BY s ORDER BY doc_id, i) AS n FROM win) WHERE n > 1),
gone AS (SELECT DISTINCT doc_id, unnest(range(i, i + 20)) AS p FROM hit),
tok AS (SELECT doc_id, unnest(w) AS t, unnest(range(1, len(w) + 1)) AS p FROM d),
kept AS (SELECT doc_id, string_agg(t, ' ' ORDER BY p) AS kept, count(*) AS n FROM tok ANTI JOIN gone USING (doc_id, p) GROUP BY doc_id)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(len(w) - coalesce(n, 0) AS BIGINT) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM d LEFT JOIN kept USING (doc_id)
"""
